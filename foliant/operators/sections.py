"""Sections of filings out of a table of text blocks, relationally: headings, the gap behind each, the best of each item, and the blocks below it.

The table has (key, block, text, form): a filing's blocks, numbered from 0 without gaps, as `parse.blocks` writes them. The rules are
those of `parse.sections`, which does the same for one filing in memory: an item's heading is the one with most blocks up to the
next heading of any item, the last of equals, so not its line in the contents; a section's order counts kept headings, with or without text; where one section
of a periodic form has more than 65 % of all characters, the filing is one section of unknown part.

Defined cases: a null text is an empty block; a filing without headings, or with nothing below them, has no sections; an empty table has none.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.shared import sent, written
from foliant.operators.parse import ANNUAL_FOREIGN, DOMINANT, LONGEST_HEADING, PARTS_DOMESTIC, PARTS_FOREIGN, PERIODIC

#: What a heading looks like (its item and title), what is cut off a title's ends, and what no title has.
HEADING = r"^\s*(?:ITEM|Item)\s+([0-9]{1,2}[A-Za-z]?)\s*[.\-—–:]?\s*(.*?)\s*$"
ENDS, ANOTHER = " .:—–-", r"(?i)\bItem\s+[0-9]"


def heading(text: Column) -> Column:
    """struct(item, title) of a block that reads like an item's heading; else null."""
    title = F.btrim(F.regexp_extract(text, HEADING, 2), F.lit(ENDS))
    first = F.left(title, F.lit(1))
    prose = (title != "") & (F.rlike(title, F.lit(ANOTHER)) | ~F.rlike(title, F.lit("[A-Za-z0-9]")) | ((first == F.lower(first)) & (first != F.upper(first))))
    return F.when((F.length(text) <= LONGEST_HEADING) & F.rlike(text, F.lit(HEADING)) & ~prose, F.struct(F.upper(F.regexp_extract(text, HEADING, 1)).alias("item"), title.alias("title")))


def part(item: Column, form: Column) -> Column:
    """The part of a form that an item stands in."""
    n = F.regexp_extract(item, "^[0-9]+", 0).cast("int")
    foreign = F.lit("Unknown")
    for most, name in reversed(PARTS_FOREIGN):
        foreign = F.when((n >= 1) & (n <= most), name).otherwise(foreign)
    names = F.create_map(*map(F.lit, chain.from_iterable((i, p) for p, items in PARTS_DOMESTIC.items() for i in items)))
    return F.when(form.isin(*ANNUAL_FOREIGN), foreign).otherwise(F.coalesce(F.try_element_at(names, item), F.lit("Unknown")))


def headings(blocks: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, block, item, title, order): each item's best heading, in order of their places."""
    numbered = blocks.select(key, "block", heading(F.coalesce("text", F.lit(""))).alias("h"))
    # of a filing's blocks only headings and the last one go on
    found = numbered.groupBy(key).agg(F.max("block").alias("last")).join(numbered.where("h is not null"), key)
    gap = F.coalesce(F.lead("block").over(Window.partitionBy(key).orderBy("block")), F.col("last") + 1) - F.col("block") - 1
    best = found.select(key, "block", "h.item", "h.title", gap.alias("gap")).groupBy(key, "item").agg(F.max_by(F.struct("block", "title"), F.struct("gap", "block")).alias("b"))
    return best.select(key, "b.block", "item", "b.title", (F.row_number().over(Window.partitionBy(key).orderBy("b.block")) - 1).alias("order"))


def _joined(blocks: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(blocks)), lambda x: x["text"]), "\n\n")


def sections(blocks: DataFrame, key: str = "document_id", form: str = "form_type") -> DataFrame:
    """(key, section_path, order, content) of the filings of a table of blocks."""
    whole = blocks.select(key, "block", F.coalesce("text", F.lit("")).alias("text"), F.col(form).alias("form"))
    kept = written(headings(whole, key))
    # a range join: where a filing's sections begin and end goes to its blocks, so that texts are exchanged once, for their sections
    w = Window.partitionBy(key).orderBy("block")
    ranges = sent(written(kept.select(key, F.col("block").alias("start"), F.coalesce(F.lead("block").over(w), F.lit((1 << 31) - 1)).alias("after"))))
    below = whole.join(ranges, key).where((F.col("block") > F.col("start")) & (F.col("block") < F.col("after")))
    bodies = below.groupBy(key, "start").agg(F.first("form").alias("form"), _joined(F.struct("block", "text")).alias("content")).where("content <> ''")  # the blocks of one section
    path = F.concat(F.array(part(F.col("item"), F.col("form")), F.concat(F.lit("Item "), "item")), F.when(F.col("title") != "", F.array("title")).otherwise(F.array().cast("array<string>")))
    out = written(bodies.join(kept.withColumnRenamed("block", "start"), [key, "start"]).select(key, path.alias("section_path"), "order", "content"))
    sizes = whole.where(F.col("form").isin(*PERIODIC)).groupBy(key).agg(F.sum(F.length("text")).alias("total"))
    ruled = out.groupBy(key).agg(F.max(F.length("content")).alias("most")).join(sizes, key).where((F.col("total") > 0) & (F.col("most") / F.col("total") > DOMINANT)).select(key)
    ruled = sent(written(ruled))
    one = whole.join(ruled, key, "left_semi").groupBy(key).agg(_joined(F.struct("block", "text")).alias("content"))  # the blocks of one filing
    return out.join(ruled, key, "left_anti").unionByName(one.select(key, F.array(F.lit("Unknown"), F.lit("Full Document")).alias("section_path"), F.lit(0).alias("order"), "content"))
