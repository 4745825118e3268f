"""Queries of sections out of a table of blocks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.catalog import query
from foliant.functions.shared import written
from foliant.operators import parse, sections
from foliant.plans import star

# the lines of all documents as blocks: a heading before every fifth, its line in the contents or something that only looks like one before others
_LIST = ", ".join
_BLOCKS = r"""l AS (SELECT doc_id AS id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
m AS (SELECT id, i, 0 AS o, CASE i % 5 WHEN 0 THEN 'Item ' || (i // 5 % 16 + 1) || '. Title of ' || (i // 5 % 3) WHEN 2 THEN 'ITEM 7A —' WHEN 3 THEN 'Item 3. see Item 4' WHEN 4 THEN 'Item 5: as before' END AS t FROM l WHERE i % 5 <> 1 UNION ALL SELECT id, i, 1, t FROM l WHERE t <> ''),
b AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i, o) - 1 AS INTEGER) AS block, t AS text, CASE id % 4 WHEN 0 THEN '10-K' WHEN 1 THEN '20-F' WHEN 2 THEN '10-Q' ELSE '8-K' END AS form FROM m)"""
_TRIMMED = f"trim(regexp_extract(text, '{sections.HEADING}', 2), '{sections.ENDS}')"
_DOMESTIC = " ".join(f"WHEN item IN ({_LIST(repr(i) for i in items)}) THEN '{p}'" for p, items in parse.PARTS_DOMESTIC.items())
_FOREIGN = " ".join(f"WHEN n BETWEEN 1 AND {most} THEN '{p}'" for most, p in parse.PARTS_FOREIGN)
_SECTIONS = f"""{_BLOCKS}, h AS (SELECT id, block, upper(regexp_extract(text, '{sections.HEADING}', 1)) AS item, {_TRIMMED} AS title FROM b WHERE length(text) <= {parse.LONGEST_HEADING} AND regexp_matches(text, '{sections.HEADING}')),
g AS (SELECT id, block, item, title, coalesce(lead(block) OVER (PARTITION BY id ORDER BY block), n) - block - 1 AS gap FROM h JOIN (SELECT id, count(*) AS n FROM b GROUP BY id) USING (id)
  WHERE title = '' OR NOT (regexp_matches(title, '{sections.ANOTHER}') OR NOT regexp_matches(title, '[A-Za-z0-9]') OR (title[1] = lower(title[1]) AND title[1] <> upper(title[1])))),
k AS (SELECT id, block, item, title, row_number() OVER (PARTITION BY id ORDER BY block) - 1 AS o, coalesce(lead(block) OVER (PARTITION BY id ORDER BY block), 1000000000) AS after FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY id, item ORDER BY gap DESC, block DESC) = 1)),
s AS (SELECT k.id, o, item, title, form, CAST(regexp_extract(item, '^[0-9]+') AS INTEGER) AS n, string_agg(text, chr(10) || chr(10) ORDER BY b.block) AS content FROM k JOIN b ON b.id = k.id AND b.block > k.block AND b.block < k.after GROUP BY ALL),
r AS (SELECT id FROM s JOIN (SELECT id, sum(length(text)) AS total FROM b GROUP BY id) USING (id) WHERE form IN ({_LIST(repr(f) for f in parse.PERIODIC)}) GROUP BY id, total HAVING max(length(content)) / total > {parse.DOMINANT}),
out AS (SELECT id, CASE WHEN form IN ({_LIST(repr(f) for f in parse.ANNUAL_FOREIGN)}) THEN CASE {_FOREIGN} ELSE 'Unknown' END ELSE CASE {_DOMESTIC} ELSE 'Unknown' END END || ' > Item ' || item || CASE WHEN title <> '' THEN ' > ' || title ELSE '' END AS path, o, content FROM s WHERE id NOT IN (SELECT id FROM r)
  UNION ALL SELECT id, 'Unknown > Full Document', 0, string_agg(text, chr(10) || chr(10) ORDER BY block) FROM b WHERE id IN (SELECT id FROM r) GROUP BY id)"""


def _title(i):
    nth, of = i % 5, F.floor(i / 5).cast("int")
    return F.when(nth == 0, F.concat(F.lit("Item "), (of % 16 + 1).cast("string"), F.lit(". Title of "), (of % 3).cast("string"))).when(nth == 2, "ITEM 7A —").when(nth == 3, "Item 3. see Item 4").when(nth == 4, "Item 5: as before").otherwise("")


def _blocks(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.array(_title(i), F.trim(F.regexp_replace(x, r"\s+", " "))))
    form = F.get(F.array(*map(F.lit, ("10-K", "20-F", "10-Q", "8-K"))), (F.col("doc_id") % 4).cast("int"))
    blocks = F.filter(F.flatten(lines), lambda x: x != "")
    return star.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), form.alias("form_type"), F.posexplode(blocks).alias("block", "text"))


@query(f"WITH {_SECTIONS} SELECT id AS document_id, path, CAST(o AS INTEGER) AS \"order\", length(content) AS characters, md5(content) AS content_md5 FROM out")
def J2_relational_sections(spark, d):
    found = sections.sections(written(_blocks(spark, d)))
    return found.select("document_id", F.array_join("section_path", " > ").alias("path"), "order", F.length("content").cast("long").alias("characters"), F.md5("content").alias("content_md5"))


@query(f"WITH {_SECTIONS} SELECT id AS document_id, block, item, title, CAST(o AS INTEGER) AS \"order\" FROM k")
def J2_best_headings(spark, d):
    return sections.headings(written(_blocks(spark, d)))
