"""Licence scan: fuzzy search for short notices, by seeds of the pigeonhole principle.

A notice of m characters that may be changed in at most k places (characters inserted, deleted or
replaced) is cut into k + 1 pieces: k changes leave at least one piece whole. All pieces of all notices
go into one Aho-Corasick automaton, which reads a text once and finds where a notice may stand. The
regex library then matches the notice with bounded error around each such place and reports the span
and the number of changes; overlapping spans of a notice give way to the one with the fewest changes.
With k = 0 the only piece is the notice itself: that finds the plain phrases. Before the costlier match,
a place must pass the q-gram lemma: k changes spoil at most 3 k of the notice's m - 2 trigrams.

Texts are compared as their words (see `WORD`), A-Z in lower case, joined by single spaces; notices
match whole words at both ends. Defined cases: a null text is an empty one and has no words; repeated
rows give repeated results; ties between spans go to the earlier; an empty table gives an empty table;
columns of the input that bear an output's name are replaced. One pass over each text in its own task,
whatever its length; nothing is shuffled and only the notices are sent to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliant.llm._common import column

#: Words of a text after A-Z are in lower case.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Notice(NamedTuple):
    label: str
    words: str
    changes: int
    base: bool = False


#: Phrases and labels that count where their words stand consecutively.
PHRASES = (
    Notice("gpl", "gnu general public license", 0, True),
    Notice("apache", "apache license", 0, True),
    Notice("cc-by", "cc by", 0, True),
    Notice("mit", "mit license", 0, True),
)
#: Short notices of public licences, with the changes that each may have (about an eighth of its length).
NOTICES = (
    Notice("mit-notice", "released under the mit license", 3),
    Notice("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy", 8),
    Notice("apache-notice", "licensed under the apache license version 2 0", 5),
    Notice("gpl-notice", "licensed under the gnu general public license", 5),
    Notice("gpl-notice", "either version 3 of the license or at your option any later version", 7),
    Notice("cc-by-notice", "licensed under cc by", 2),
    Notice("cc-by-notice", "creative commons attribution", 3),
    Notice("bsd-notice", "redistribution and use in source and binary forms", 5),
    Notice("mpl-notice", "subject to the terms of the mozilla public license", 6),
    Notice("isc-notice", "permission to use copy modify and or distribute this software", 6),
    Notice("unlicense-notice", "released into the public domain", 3),
)


class Span(NamedTuple):
    label: str
    start: int  # of characters in the joined words
    end: int
    changes: int
    length: int  # of the notice
    base: bool


def joined(text: str | None) -> str:
    """The words of a text, joined by single spaces."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_AS_WORDS).split()).decode("utf-8", "surrogatepass")


class Scanner:
    def __init__(self, notices: tuple[Notice, ...] = PHRASES + NOTICES):
        self.notices = notices
        self.patterns = [regex.compile(rf"(?:{regex.escape(n.words, literal_spaces=True)}){{e<={n.changes}}}", regex.BESTMATCH) if n.changes else None for n in notices]
        self.trigrams = [[n.words[j : j + 3] for j in range(len(n.words) - 2)] for n in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            words = f" {n.words} " if not n.changes else n.words
            parts = n.changes + 1
            if len(words) < parts:
                raise ValueError(f"{n.words!r} is shorter than {parts} pieces")
            cuts = [len(words) * j // parts for j in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(words[a:b], []).append((i, a))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def scan(self, words: str) -> list[Span]:
        """All spans of all notices in joined words, by start."""
        text = f" {words} "
        exact: list[Span] = []
        places: dict[int, list[int]] = {}
        for end, (size, owners) in self.automaton.iter(text):
            for i, offset in owners:
                start = end + 1 - size - offset  # of the notice, if nothing before the piece is changed
                n = self.notices[i]
                if n.changes:
                    places.setdefault(i, []).append(start)
                else:
                    exact.append(Span(n.label, start, start + len(n.words), 0, len(n.words), n.base))
        out = exact
        for i, found in places.items():
            out += self._verified(i, text, found)
        return sorted(out, key=lambda s: (s.start, s.end, s.label))

    def _verified(self, i: int, text: str, found: list[int]) -> list[Span]:
        n, pattern = self.notices[i], self.patterns[i]
        k, m = n.changes, len(n.words)
        spans: list[Span] = []
        found = [at for at in sorted(set(found)) if self._plausible(i, text[max(0, at - k) : at + m + k])]
        at = 0
        while at < len(found):
            low, high = found[at] - k, found[at] + m + k
            while at + 1 < len(found) and found[at + 1] - k <= high:  # windows that overlap are searched together
                at += 1
                high = found[at] + m + k
            at += 1
            low, high = max(0, low), min(len(text), high)
            stretches, tried, here = [(low, high)], set(), []
            while stretches:  # the best match of a stretch, then what is before and after it
                low, high = stretch = stretches.pop()
                if high - low < m - k or stretch in tried or not (hit := pattern.search(text, low, high)):
                    continue
                tried.add(stretch)
                changes = sum(hit.fuzzy_counts)
                a, b = hit.span()
                a, b, changes = self._trimmed(text, a, b, n.words, changes, k)
                if a >= 0:
                    here.append(Span(n.label, a - 1, b - 1, changes, m, n.base))
                    stretches += [(low, min(hit.start(), a)), (max(hit.start() + 1, b), high)]
                else:
                    stretches += [(low, hit.start()), (hit.start() + 1, high)]
            kept: list[Span] = []
            for span in sorted(here, key=lambda s: (s.start, s.changes)):  # whole words can reach into the next stretch
                if not kept or kept[-1].end <= span.start:
                    kept.append(span)
                elif span.changes < kept[-1].changes:
                    kept[-1] = span
            spans += kept
        return spans

    def _plausible(self, i: int, window: str) -> bool:
        there = {window[j : j + 3] for j in range(len(window) - 2)}
        wanted = self.trigrams[i]
        return sum(t in there for t in wanted) >= len(wanted) - 3 * self.notices[i].changes

    @staticmethod
    def _trimmed(text: str, a: int, b: int, words: str, changes: int, most: int) -> tuple[int, int, int]:
        """The span grown or cut to whole words, if the changes stay within bounds; else a negative start."""
        while a < b and text[a] == " ":
            a += 1
        while b > a and text[b - 1] == " ":
            b -= 1
        if a >= b:
            return -1, b, 0
        first, last = text.rfind(" ", 0, a) + 1, text.find(" ", b)
        last = len(text) if last < 0 else last
        if (first, last) == (a, b) and text[a:b] == words:
            return a, b, 0
        if last - first > len(words) + most:
            return -1, b, 0
        d = distance(words, text[first:last], most)
        return (first, last, d) if d <= most else (-1, b, 0)


def distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


@lru_cache(4)
def _scanner(notices: tuple[Notice, ...]) -> Scanner:
    return Scanner(notices)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", notices: tuple[Notice, ...] = PHRASES + NOTICES) -> DataFrame:
    """One row per span: key, label, first_word, last_word, changes, matched (the words found), likeness."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("changes", T.IntegerType()), T.StructField("matched", T.StringType()), T.StructField("likeness", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(notices)
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                words = joined(t)
                for s in scanner.scan(words):
                    at.append(i)
                    rows.append((s.label, words.count(" ", 0, s.start), words.count(" ", 0, s.end), s.changes, words[s.start : s.end], 1 - s.changes / s.length))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.float64()), strict=True))], names=[f.name for f in schema])

    return docs.select(column(key), column(text)).mapInArrow(run, schema)


def summary(docs: DataFrame, key: str = "doc_id", text: str = "text", notices: tuple[Notice, ...] = PHRASES + NOTICES) -> DataFrame:
    """One row per document: key, n_words, n_base, first_word, last_word (of base places), base_labels, labels, score, n_fuzzy.

    `score` is the likeness of the best span, base or fuzzy: 1 - changes / length; 0 without any.
    """
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("n_fuzzy", T.LongType()))]])

    def one(t: str | None, scanner: Scanner) -> tuple:
        words = joined(t)
        found = scanner.scan(words)
        base = [s for s in found if s.base]
        first = words.count(" ", 0, base[0].start) if base else None
        last = words.count(" ", 0, base[-1].start) if base else None
        return (words.count(" ") + 1 if words else 0, len(base), first, last, ",".join(sorted({s.label for s in base})), ",".join(sorted({s.label for s in found})), max((1 - s.changes / s.length for s in found), default=0.0), len(found) - len(base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(notices)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64())
        for b in batches:
            cols = list(zip(*(one(t, scanner) for t in b.column(1).to_pylist()), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[f.name for f in schema])

    return docs.select(column(key), column(text)).mapInArrow(run, schema)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document scanned for the phrases and, with bounded changes, for the notices."""
    return summary(spark.read.parquet(f"{sf_dir}/documents.parquet"))
