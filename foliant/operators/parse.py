"""HTML filings to text blocks and sections."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.functions.values import few

#: Fixed values.
NOISE = frozenset({"script", "style", "head", "meta", "link"})
BLOCKS = frozenset({"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "tr", "section"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
HEADING = re.compile(r"^\s*(?:ITEM|Item)\s+(\d{1,2}[A-Za-z]?)\s*[.\-—–:]?\s*(.*?)\s*$")
LONGEST_HEADING = 200
DOMINANT = 0.65
ANNUAL_FOREIGN = ("20-F", "20-F/A")
PERIODIC = ("10-K", "10-K/A", "10-Q", "10-Q/A", *ANNUAL_FOREIGN)
PARTS_FOREIGN = ((12, "Part I"), (16, "Part II"), (19, "Part III"))
PARTS_DOMESTIC = {
    "Part I": ("1", "1A", "1B", "1C", "2", "3", "4"),
    "Part II": ("5", "6", "7", "7A", "8", "9", "9A", "9B", "9C"),
    "Part III": ("10", "11", "12", "13", "14"),
    "Part IV": ("15", "16"),
}


#: Tags that end an open paragraph, and what else a start tag ends: by its tag, the tags it ends and those beyond which it does not look.
ENDS_PARAGRAPH = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split())
_CELLS, _ROWS, _GROUPS = frozenset({"td", "th"}), frozenset({"tr"}), frozenset({"tbody", "thead", "tfoot"})
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "td": (_CELLS, frozenset({"table"})),
    "th": (_CELLS, frozenset({"table"})),
    "tr": (_CELLS | _ROWS, frozenset({"table"})),
    **{g: (_CELLS | _ROWS | _GROUPS, frozenset({"table"})) for g in sorted(_GROUPS)},
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Elements out of which no end tag of another kind reaches, and no start tag to a paragraph.
SCOPES = frozenset({"table", "td", "th", "caption"})
_TABLE = frozenset({"table", "tr"}) | _CELLS | _GROUPS


class _Blocks(HTMLParser):
    """Texts of block elements that hold no other block element, in document order. End tags that may be left out are put in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []  # tag, whether what is inside is left out
        self.hidden = 0
        self.blocks: list[list] = []  # of open block elements: texts, whether one is inside, place in the document
        self.out: list[tuple[int, str]] = []
        self.seen = 0
        self.apart = True  # whether a tag stands between this text and the last

    def _end(self, count: int) -> None:
        """Ends the innermost `count` elements."""
        for _ in range(count):
            tag, hides = self.open.pop()
            if tag in BLOCKS and not self.hidden:
                texts, holds, at = self.blocks.pop()
                text = " ".join(" ".join(texts).split())
                if text and not holds:
                    self.out.append((at, text))
            self.hidden -= hides

    def _end_through(self, tags: frozenset[str], scopes: frozenset[str]) -> None:
        """Ends all up to the outermost of `tags` that no element of `scopes` is inside of."""
        last = 0
        for n, (tag, _) in enumerate(reversed(self.open), 1):
            if tag in scopes:
                break
            if tag in tags:
                last = n
        self._end(last)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.apart = True
        if tag in ENDS_PARAGRAPH:
            self._end_through(frozenset({"p", "head"}), SCOPES)
        if tag in ENDS:
            self._end_through(*ENDS[tag])
        if tag in VOID:
            return
        style = "".join(v or "" for k, v in attrs if k == "style").replace(" ", "").lower()
        hides = tag in NOISE or "display:none" in style
        self.open.append((tag, hides))
        self.hidden += hides
        if tag in BLOCKS and not self.hidden:
            if self.blocks:
                self.blocks[-1][1] = True
            self.seen += 1
            self.blocks.append([[], False, self.seen])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.apart = True  # an empty element; those that cannot be empty are none in HTML, but hold nothing here

    def handle_endtag(self, tag: str) -> None:
        self.apart = True
        for n, (last, _) in enumerate(reversed(self.open), 1):
            if last == tag:
                self._end(n)
                return
            if last in SCOPES and tag not in _TABLE:
                return

    def handle_comment(self, data: str) -> None:
        self.apart = True

    def handle_data(self, data: str) -> None:
        if self.blocks and not self.hidden:
            if self.apart or not self.blocks[-1][0]:
                self.blocks[-1][0].append(data)
            else:
                self.blocks[-1][0][-1] += data
        self.apart = False

    def close(self) -> None:
        super().close()
        self._end(len(self.open))
        self.out.sort()


def text_blocks(html: str | None) -> list[str]:
    """Texts of the innermost block elements in order of their start; texts that a tag parts are joined by a space."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    return [text for _, text in p.out]


def part_of(item: str, form: str | None) -> str:
    if form in ANNUAL_FOREIGN:
        n = int(re.match(r"\d+", item).group())
        return next((name for most, name in PARTS_FOREIGN if 1 <= n <= most), "Unknown")
    return next((name for name, items in PARTS_DOMESTIC.items() if item.upper() in items), "Unknown")


def headings(blocks: list[str]) -> list[tuple[int, str, str]]:
    """(block, item, title) of what reads like an item's heading, and not like a row of boxes or the middle of a sentence."""
    out = []
    for i, b in enumerate(blocks):
        m = HEADING.match(b) if len(b) <= LONGEST_HEADING else None
        if not m:
            continue
        title = m[2].strip(" .:—–-")
        if title and (re.search(r"\bItem\s+\d", title, re.IGNORECASE) or not re.search("[A-Za-z0-9]", title) or title[0].islower()):
            continue
        out.append((i, m[1].upper(), title))
    return out


def sections(blocks: list[str], form: str | None) -> list[tuple[list[str], int, str]]:
    """(path, order, content). An item's heading is the one with most text up to the next heading, the last of equals: not its line in the contents."""
    found = headings(blocks)
    if not found:
        return []
    best: dict[str, tuple[int, int, str]] = {}
    for (i, item, title), after in zip(found, [*[f[0] for f in found[1:]], len(blocks)], strict=True):
        best[item] = max(best.get(item, (-1, -1, "")), (after - i - 1, i, title), key=lambda x: x[:2])
    kept = sorted((i, item, title) for item, (_, i, title) in best.items())
    out = []
    for order, ((i, item, title), after) in enumerate(zip(kept, [*[k[0] for k in kept[1:]], len(blocks)], strict=True)):
        body = "\n\n".join(blocks[i + 1 : after])
        if body:
            out.append(([part_of(item, form), f"Item {item}", *([title] if title else [])], order, body))
    total = sum(map(len, blocks))
    if out and form in PERIODIC and total and max(len(c) for _, _, c in out) / total > DOMINANT:
        return [(["Unknown", "Full Document"], 0, "\n\n".join(blocks))]
    return out


def parse(filings: DataFrame, key: str = "document_id", html: str = "html", form: str = "form_type") -> DataFrame:
    """(key, section_path, order, content) of each filing's sections."""
    schema = T.StructType([filings.schema[key], T.StructField("section_path", T.ArrayType(T.StringType())), T.StructField("order", T.IntegerType()), T.StructField("content", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            at, rows = [], []
            for i, (h, f) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for s in sections(text_blocks(h), f):
                    at.append(i)
                    rows.append(s)
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.list_(pa.string()), pa.int32(), pa.string()), strict=True))], names=[f.name for f in schema])

    return filings.select(key, html, form).mapInArrow(run, schema)


def blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, block, text) of every text block of every page."""
    schema = T.StructType([pages.schema[key], T.StructField("block", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            found = [text_blocks(h) for h in b.column(1).to_pylist()]
            at = [i for i, f in enumerate(found) for _ in f]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([j for f in found for j in range(len(f))], pa.int32()), pa.array([t for f in found for t in f], pa.string())], names=[f.name for f in schema])

    return pages.select(key, html).mapInArrow(run, schema)
