"""Sections to token-bounded chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.values import few

TARGET, OVERLAP, LEAST = 600, 80, 50


def words(text: str) -> Column:
    """Tokens by white space."""
    return F.filter(F.split(F.col(text), "[ \n\t\r]+"), lambda w: w != "")


def windows(docs: DataFrame, key: str = "doc_id", text: str = "text", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, token_count, content): windows of `target` tokens, each starting `overlap` before the last one's end; the last may be short."""
    step = target - overlap
    t = docs.select(key, words(text).alias("_w")).where(F.size("_w") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step)), lambda s: (s == 0) | (s + overlap < F.size("_w")))
    cut = t.select(key, "_w", F.posexplode(starts).alias("chunk_index", "_s"))
    part = F.slice("_w", F.col("_s") + 1, F.lit(target))
    return cut.select(key, "chunk_index", F.size(part).alias("token_count"), F.array_join(part, " ").alias("content"))


def breaks(lengths: np.ndarray, target: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks of paragraphs of at most `target` tokens each, as (first token, paragraphs up to its end), out of their lengths.

    A chunk ends at the last paragraph that is within `target` of its first token, which a search of the running
    sums finds, and has one paragraph of its own at least; the next begins `overlap` tokens before its end, or where it began.
    """
    upto = np.cumsum(lengths)
    out, start, done = [], 0, 0
    while done < len(upto):
        done = max(done + 1, int(np.searchsorted(upto, start + target, side="right")))
        out.append((start, done))
        start = max(start, int(upto[done - 1]) - overlap)
    return out


def section_chunks(content: str, encode: Callable[[str], list[str]] = str.split, decode: Callable[[list[str]], str] = " ".join, target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[str, int]]:
    """(content, tokens) of one section.

    A section of up to `target` tokens is one chunk, or none below `least`. Others are cut between paragraphs (see `breaks`), where
    a chunk leads on with the last `overlap` tokens of the one before. A paragraph of more than `target` tokens is cut by itself
    into windows, and nothing is carried into it or out of it. The rest is kept from `least` tokens on. Separators do not count.
    """
    total = len(encode(content))
    if total <= target:
        return [(content, total)] if total >= least else []
    paragraphs = [p for p in map(str.strip, content.split("\n\n")) if p]
    tokens = [encode(p) for p in paragraphs]
    size = np.array([len(t) for t in tokens])
    edges = np.flatnonzero(np.diff(size > target, prepend=True, append=True) | (np.append(size, 0) > target) | (np.append(0, size) > target))
    out: list[tuple[str, int]] = []
    for a, b in pairwise(sorted({0, *edges.tolist(), len(size)})):
        if size[a] > target:
            starts = range(0, max(1, int(size[a]) - overlap), target - overlap)
            out += [(decode(tokens[a][s : s + target]), len(tokens[a][s : s + target])) for s in starts]
            continue
        line = [t for p in tokens[a:b] for t in p]
        upto = [0, *np.cumsum(size[a:b]).tolist()]
        before = 0
        for start, done in breaks(size[a:b], target, overlap):
            carried = [decode(line[start : upto[before]])] if start < upto[before] else []
            out.append(("\n\n".join([*carried, *paragraphs[a + before : a + done]]), upto[done] - start))
            before = done
        if b == len(size) and out[-1][1] < least:
            out.pop()
    return out


def chunk_sections(sections: DataFrame, document: str = "document_id", target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """sections (document, order, section_path, content) to (document, order, section_path, chunk_index, token_count, content).

    Chunks never cross sections; their index counts through the document.
    """
    schema = T.StructType([sections.schema[document], sections.schema["order"], sections.schema["section_path"], T.StructField("_pos", T.IntegerType()), T.StructField("token_count", T.IntegerType()), T.StructField("content", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            at, pos, n, texts = [], [], [], []
            for i, content in enumerate(b.column(3).to_pylist()):
                for p, (text, count) in enumerate(section_chunks(content or "", target=target, overlap=overlap, least=least)):
                    at.append(i)
                    pos.append(p)
                    n.append(count)
                    texts.append(text)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(3)), pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(texts, pa.string())], names=[f.name for f in schema])

    cut = sections.select(document, "order", "section_path", "content").mapInArrow(run, schema)
    w = Window.partitionBy(document).orderBy("order", "_pos")
    return cut.select(document, "order", "section_path", (F.row_number().over(w) - 1).alias("chunk_index"), "token_count", "content")
