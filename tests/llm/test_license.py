import random
import re

import pytest

from foliant.llm import license_scan as ls


def plain(text):
    words = re.findall(ls.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, n.label) for n in ls.PHRASES for i in range(len(words)) if words[i : i + len(n.words.split())] == n.words.split()]
    return len(words), sorted(places)


def test_base_against_plain_words(spark):
    r = random.Random(1)
    parts = ["GNU", "general", "public license", "mit", "MIT License", "cc", "by", "cc-by", "apache", "License,", "É", "x_y", "apache license", "\n", "2.0", "gnu General-Public  license"]
    rows = [(i, " ".join(r.choice(parts) for _ in range(r.randrange(20)))) for i in range(300)] + [(900, None), (901, ""), (902, "cc by cc by"), (902, "cc by cc by")]
    got = ls.summary(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (i, t), g in zip(sorted(rows, key=str), sorted(got, key=lambda x: (str((x.doc_id, dict(rows)[x.doc_id]))))):
        n, places = plain(t)
        assert (g.doc_id, g.n_words, g.n_base) == (i, n, len(places))
        assert (g.first_word, g.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert g.base_labels == ",".join(sorted({x[1] for x in places}))
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1


def edited(words, k, r):
    s = list(words)
    for _ in range(k):
        i = r.randrange(1, len(s) - 1)
        if r.random() < 0.5:
            s[i] = r.choice("abcxyz")
        elif s[i] != " ":
            del s[i]
    return "".join(s)


@pytest.mark.parametrize("notice", ls.NOTICES, ids=lambda n: n.words[:20])
def test_edits_within_bounds_are_found(notice):
    r, scanner = random.Random(2), ls.Scanner()
    for k in range(notice.changes + 1):
        words = f"some words before {edited(notice.words, k, r)} and after"
        hits = [s for s in scanner.scan(words) if s.label == notice.label and s.length == len(notice.words)]
        assert hits and min(s.changes for s in hits) <= k


def test_fuzzy_against_all_windows():
    r = random.Random(3)
    notice = ls.Notice("x", "released under the mit license", 3)
    scanner = ls.Scanner((notice,))
    for _ in range(60):
        words = " ".join(r.choice(["released", "under", "the", "mit", "license", "relesed", "licence", "a"]) for _ in range(25))
        tokens = words.split()
        exists = any(ls.distance(notice.words, " ".join(tokens[i:j]), 3) <= 3 for i in range(25) for j in range(i + 1, min(26, i + 8)))
        assert bool(scanner.scan(words)) == exists


def test_notices_back_to_back_are_all_found():
    scanner = ls.Scanner()
    twice = "licenced under the gnu general public licence licensed under the gnu general public license"
    assert [(s.start, s.changes) for s in scanner.scan(twice) if s.label == "gpl-notice"] == [(0, 2), (46, 0)]
    refused = "licenced under cc by licensed under cc bypass"
    assert [(s.start, s.end, s.changes) for s in scanner.scan(refused) if s.label == "cc-by-notice"] == [(0, 20, 1)]
    many = " ".join(["licenced under cc by", "licensed under cc by"] * 50)
    assert len([s for s in scanner.scan(many) if s.label == "cc-by-notice"]) == 100


def test_unrelated_text_has_no_labels(spark):
    df = spark.createDataFrame([(1, "the license of software " * 50, 7)], "doc_id long, text string, label int")
    r = ls.summary(df).first()
    assert (r.labels, r.score) == ("", 0.0)
    assert ls.spans(df).count() == 0 and ls.summary(df.limit(0)).count() == 0
    found = ls.spans(spark.createDataFrame([(1, "Relased under the MIT Licence.")], "doc_id long, text string")).collect()
    assert [(x.label, x.first_word, x.last_word, x.matched) for x in found] == [("mit-notice", 0, 4, "relased under the mit licence")]
