import random

from foliant.operators import parse, sections

LINES = ["Item 1. Business", "ITEM 1A. Risk Factors", "Item 2 – Properties", "Item 7: MD&A", "Item 7. see Item 8", "Item 3", "item 4. lower", "Item 5. of the plan", "Item 16. Exhibits —", "Item 9a ...", "Item 12. A", "Item 1. " + "x" * 250,
         "Items 1 and 2", "Plain text that goes on.", "More text, with Item 1 inside", "12", "—", "Überblick", "Item 6. Über", "Item 10. ünder"]


def test_sections_are_those_of_one_filing_in_memory(spark):
    r = random.Random(5)
    filings = {i: ([r.choice(LINES) if r.random() < 0.6 else "word " * r.randrange(1, 60) + "end" for _ in range(r.randrange(0, 30))], r.choice(["10-K", "20-F", "10-Q/A", "8-K", None])) for i in range(150)}
    rows = [(i, n, text, form) for i, (blocks, form) in filings.items() for n, text in enumerate(blocks)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "document_id long, block int, text string, form_type string").repartition(4)
    want = sorted((i, path, order, content) for i, (blocks, form) in filings.items() for path, order, content in parse.sections(blocks, form))
    got = sorted((x.document_id, x.section_path, x.order, x.content) for x in sections.sections(df).collect())
    assert got == want and len(want) > 200 and any(p[0] == "Unknown" and len(p) == 2 for _, p, _, _ in want)


def test_sections_of_parsed_pages(spark):
    html = "<p>Item 1. Business</p><p>Item 7. MD&amp;A</p><div>3</div><p>Item 1. Business</p><p>We sell.</p><ul><li>a<li>b</ul><p>Item 7. MD&amp;A</p><p>It grew.</p>"
    pages = spark.createDataFrame([(1, html, "8-K"), (2, None, "8-K"), (3, "<p>none</p>", "8-K")], "page_id long, html string, form_type string")
    blocks = parse.blocks(pages).join(pages.select("page_id", "form_type"), "page_id")
    got = {(r.page_id, r.order): (r.section_path, r.content) for r in sections.sections(blocks, "page_id").collect()}
    assert got == {(1, 0): (["Part I", "Item 1", "Business"], "We sell.\n\na\n\nb"), (1, 1): (["Part II", "Item 7", "MD&A"], "It grew.")}


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "Item 1. A", "8-K"), (1, 1, None, "8-K"), (2, 0, "Item 2. B", "10-K")], "document_id long, block int, text string, form_type string")
    assert sections.sections(df).count() == 0 and sections.sections(df.limit(0)).count() == 0
    assert [tuple(r) for r in sections.headings(df).orderBy("document_id").collect()] == [(1, 0, "1", "A", 0), (2, 0, "2", "B", 0)]
