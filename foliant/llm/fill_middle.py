"""Fill-in-the-middle transformation of texts, cut between units by a matcher that streams twice.

A text's units are the matches of a pattern, from left to right. The first pass counts them and keeps nothing but the
count; two ranks are drawn from 0 to that count by hashing a seed with the row's key; the second pass advances a lazy iterator
of matches to the smaller rank, then on to the larger one, and stops there. So besides the text and its output, a row takes constant
memory, however many units it has: no list of units is ever made. Rows are independent: no exchange.

Three marks part the pieces: prefix-suffix-middle (psm) or suffix-prefix-middle (spm), and a share of the texts stays plain. A text that
holds a mark itself stays plain too, so that an output can be turned back: a mark starts with `<` and ends with `>` and has neither inside,
so none arises across a boundary, and the first of its kind is the one put in.

Defined cases: a null text is empty and plain, with 0 units; a null key draws as the empty string; a text without any unit has one
place to be cut, its start; what follows the last unit goes with the suffix; repeated rows get the same output; an empty table gives an empty table;
columns of the input with an output's name are replaced, and others may have any name. Whole texts are read, one at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm._common import by_position, column, without

#: Units by default: lines with their line feeds.
LINES = r"[^\n]*\n|[^\n]+"
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of texts that are transformed, and of these, per cent with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
_ADDED = (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()))


def draws(seed: int, key: object) -> list[int]:
    """Four numbers of 32 bits: the first groups of eight hexadecimal digits of the key's hash."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def count_units(units: re.Pattern, text: str) -> int:
    """First pass: how many units there are; only the last number is kept."""
    last = deque(enumerate(units.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def places(units: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the units of rank `low` and `high` end (rank 0: the start), by one iterator that stops at the larger."""
    left = units.finditer(text)
    first = next(islice(left, low - 1, None)).end() if low else 0
    return first, next(islice(left, high - low - 1, None)).end() if high > low else first


def cut(text: str, key: object, units: re.Pattern, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = 7) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    n = count_units(units, text)
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = places(units, text, low, high)
    if h4 % 100 < suffix_first:
        return n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", units: str = LINES, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = 7) -> DataFrame:
    """`docs` without its texts, with n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output."""
    if not 0 <= rate <= 100 or not 0 <= suffix_first <= 100:
        raise ValueError("rate and suffix_first are per cent")
    found = re.compile(units)
    named = without(docs, text, *[n for n, _ in _ADDED])
    told = docs.select(*[column(n) for n in named.columns], column(key), column(text).cast("string"))
    base = by_position(told)
    width = len(named.columns)
    schema = T.StructType([*base.schema.fields[:width], *[T.StructField(f"_{n}", kind) for n, kind in _ADDED]])
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one text at a time: the longest one bounds the memory
                row = cut(b.column(width + 1)[i].as_py() or "", b.column(width)[i].as_py(), found, rate, suffix_first, seed)
                yield pa.RecordBatch.from_arrays([*(b.column(j).slice(i, 1) for j in range(width)), *(pa.array([x], kind) for x, kind in zip(row, kinds, strict=True))], names=[f.name for f in schema])

    return base.mapInArrow(run, schema).toDF(*named.columns, *[n for n, _ in _ADDED])


def restore(output: Column, form: Column) -> Column:
    """The text out of an output and its form, by the marks alone."""
    first, second = F.when(form == "psm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX)), F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    told = F.struct(F.substring(output, F.char_length(first) + 1, F.char_length(output)).alias("rest"), second.alias("second"))
    # what follows the first mark, up to the second and the third one
    at = F.transform(F.array(told), lambda x: F.struct(x["rest"].alias("rest"), F.position(x["second"], x["rest"]).alias("i"), F.position(F.lit(MIDDLE), x["rest"]).alias("j"), F.char_length(x["second"]).alias("size")))
    one = F.substring(at[0]["rest"], F.lit(1), at[0]["i"] - 1)
    two = F.substring(at[0]["rest"], at[0]["i"] + at[0]["size"], at[0]["j"] - at[0]["i"] - at[0]["size"])
    middle = F.substring(at[0]["rest"], at[0]["j"] + len(MIDDLE), F.char_length(at[0]["rest"]))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op12_fill_middle(spark, sf_dir: str) -> DataFrame:
    """Every document's whole text cut between lines, and turned back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    made = transform(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


#: The same rows in DuckDB: lists of units are the plain way there.
OP12_SQL = r"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
b AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM a),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM b),
d AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:lo], ''), '') AS p, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS m, coalesce(array_to_string(u[hi + 1:n], ''), '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM d
"""
