import random

from foliant.operators import chunk, parse


def filing(blocks):
    return parse.text_blocks("<html><head><title>no</title></head><body>" + "".join(f"<p>{b}</p>" for b in blocks) + "</body></html>")


def test_blocks_are_leaves_without_noise():
    html = "<div>lost<p>a <ix:x>b</ix:x>&amp;c</p><script>x</script><p style='display: none'>no</p><table><tr><td>d<br>e</td></tr></table></div><p>f"
    assert parse.text_blocks(html) == ["a b &c", "d e", "f"]
    assert parse.text_blocks(None) == []


def test_end_tags_that_are_left_out():
    assert parse.text_blocks("<ul><li>one<li>two</ul><p>a<p>b<table><tr><td>x<td>y</table>") == ["one", "two", "a", "b", "x", "y"]
    assert parse.text_blocks("<p>Net<b>sales</b></p>") == ["Net sales"]
    assert parse.text_blocks("<ul><li>one<ul><li>in</ul>lost<li>two</ul>") == ["in", "two"]
    assert parse.text_blocks("<table><tr><td><table><tr><td>inner</table><td>outer<tr><td>next</table>") == ["inner", "outer", "next"]
    assert parse.text_blocks("<p>a<div>b</p>c</div>1 < 2<p>3 < 4 &lt; 5</p>") == ["a", "b c", "3 < 4 < 5"]
    assert parse.text_blocks("<head><title>t<p>body") == ["body"]


class Tree:
    """A random document: it writes itself with end tags left out where HTML allows it, and walks itself for its blocks."""

    ALLOWED = {"div": ("div", "p", "ul", "table", "b"), "li": ("p", "ul", "b"), "td": ("p", "table", "b", "div"), "p": ("b",), "b": (), "ul": ("li",), "table": ("tr",), "tr": ("td",)}

    def __init__(self, r, tag="div", depth=0):
        self.r, self.tag, self.children = r, tag, []
        for _ in range(r.randrange(1, 5) if depth < 6 else 0):
            kinds = self.ALLOWED[tag]
            if kinds and (tag in ("ul", "table", "tr") or r.random() < 0.6):
                self.children.append(Tree(r, r.choice(kinds), depth + 1))
            elif tag not in ("ul", "table", "tr"):
                if self.children and isinstance(self.children[-1], str):
                    continue
                self.children.append(r.choice(["net sales", " 1,200 ", "a&amp;b", "\n x  y"]))

    def html(self, following=None):
        out = [f"<{self.tag}>"]
        for i, c in enumerate(self.children):
            after = self.children[i + 1] if i + 1 < len(self.children) else None
            out.append(c if isinstance(c, str) else c.html(after))
        next_tag = following.tag if isinstance(following, Tree) else None
        may = (self.tag in ("li", "td", "tr") and following is None) or (self.tag == next_tag and self.tag in ("li", "td", "tr", "p")) or (self.tag == "p" and next_tag in ("div", "ul", "table"))
        return "".join(out) + ("" if may and self.r.random() < 0.6 else f"</{self.tag}>")

    def texts(self):
        for c in self.children:
            yield from [c] if isinstance(c, str) else c.texts()

    def inner(self):
        for c in self.children:
            if isinstance(c, Tree):
                yield c
                yield from c.inner()

    def blocks(self):
        for t in (self, *self.inner()):
            if t.tag in parse.BLOCKS and not any(x.tag in parse.BLOCKS for x in t.inner()):
                text = " ".join(" ".join(x.replace("&amp;", "&") for x in t.texts()).split())
                if text:
                    yield text


def test_blocks_are_those_of_a_walk_over_the_tree():
    r = random.Random(5)
    for _ in range(1500):
        t = Tree(r)
        html = t.html()
        assert parse.text_blocks(html) == list(t.blocks()), html


def test_parts_by_form():
    items = ["1", "12D", "13", "16K", "17", "19"]
    found = parse.sections(filing([x for i in items for x in (f"Item {i}. Title", "text")]), "20-F/A")
    assert [s[0][0] for s in found] == ["Part I", "Part I", "Part II", "Part II", "Part III", "Part III"]
    assert parse.part_of("7A", "10-K") == "Part II"


def test_headings_that_are_none():
    blocks = filing(["Item 17 ☐ Item 18 ☐", "Item 16G as well as rules", "Item 16G. CORPORATE GOVERNANCE", "text", "Item 17. Statements", "more"])
    assert [(i, t) for _, i, t in parse.headings(blocks)] == [("16G", "CORPORATE GOVERNANCE"), ("17", "Statements")]


def test_contents_lose_to_text_and_ties_to_the_last():
    blocks = filing(["Item 1", "Item 2", "Item 1. REAL TITLE", "a", "Item 2. OTHER", "b"])
    found = parse.sections(blocks, "20-F")
    assert [s[0][1:] for s in found] == [["Item 1", "REAL TITLE"], ["Item 2", "OTHER"]]


def test_dominant_section_becomes_the_document_for_periodic_forms():
    blocks = filing(["Item 1. A", "x", "Item 2. B", *["filler sentence"] * 200])
    assert parse.sections(blocks, "20-F")[0][0] == ["Unknown", "Full Document"]
    assert len(parse.sections(blocks, "8-K")) == 2
    assert parse.sections(filing(["nothing here"]), "10-K") == []


def test_chunks():
    words = lambda n, w="w": " ".join([w] * n)
    assert chunk.section_chunks(words(49)) == []
    assert chunk.section_chunks(words(600))[0][1] == 600
    two = chunk.section_chunks(words(400, "a") + "\n\n" + words(400, "b"))
    assert [n for _, n in two] == [400, 480] and two[1][0].startswith("a ")
    long = chunk.section_chunks("short one\n\n" + words(1300))
    assert [n for _, n in long] == [2, 600, 600, 260]


def test_chunks_of_short_and_long_paragraphs():
    words = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    text = "\n\n".join([words(300, "a"), words(250, "b"), words(100, "c"), words(700, "d"), words(1300, "e"), words(590, "f"), words(590, "g"), words(20, "h")])
    got = chunk.section_chunks(text)
    assert [n for _, n in got] == [550, 180, 600, 180, 600, 600, 260, 590, 670, 100]
    assert got[1][0].split()[:1] == ["b170"] and got[1][0].endswith("c99") and "\n\nc0 " in got[1][0]
    assert got[2][0].startswith("d0 ") and got[7][0].startswith("f0 ") and got[8][0].startswith("f510 ") and got[9][0].startswith("g510 ")
    assert chunk.section_chunks(words(700, "x") + "\n\n" + words(30, "y"))[-1][1] == 180
    assert [n for _, n in chunk.section_chunks(words(30, "y") + "\n\n" + words(600, "x"))] == [30, 630]


def test_chunks_number_through_a_document(spark):
    text = " ".join(["x"] * 60)
    df = spark.createDataFrame([(1, 1, ["b"], text), (1, 0, ["a"], text), (2, 0, ["c"], None)], "document_id int, `order` int, section_path array<string>, content string")
    got = chunk.chunk_sections(df).orderBy("chunk_index").collect()
    assert [(r.section_path, r.chunk_index) for r in got] == [(["a"], 0), (["b"], 1)]


def test_parse_on_rows(spark):
    df = spark.createDataFrame([(1, "<p>Item 7. T</p><p>x</p><p>Item 8. U</p><p>y</p>", "10-K"), (2, None, None)], "document_id int, html string, form_type string")
    assert [r.content for r in parse.parse(df).orderBy("order").collect()] == ["x", "y"]
