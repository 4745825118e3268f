import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from foliant.llm import piece_transducer as pt

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def machine():
    return pt.Transducer(MODEL)


def ids_of(encoder, texts):
    return [memoryview(x).cast("I").tolist() for x in encoder(texts)]


def odd_texts(t, n, seed=4):
    r = random.Random(seed)
    pieces = [p for p in t.ids if len(p) > 1]
    texts = ["", " ", "  a  b\n\n", "é 🎉 ", "▁x▁▁y", "<s> <0x41>", "a" * 500, "日本語", "\x00\x01", " " * 40]
    return texts + ["".join(r.choice(pieces) if r.random() < 0.5 else r.choice("abcdefg etaoin é\n🎉") for _ in range(25)).replace("▁", " ") for _ in range(n)]


def test_ids_and_texts_are_the_librarys(machine):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts(machine, 2000)
    for x, ids in zip(texts, ids_of(pt.Encoder(machine), texts)):
        assert ids == sp.encode(x, num_threads=1), x
        assert machine.decode(ids) == sp.decode(ids), x


def test_long_segments_are_composed_alike(machine, monkeypatch):
    texts = odd_texts(machine, 60, 5)
    want = ids_of(pt.Encoder(machine), texts)
    monkeypatch.setattr(pt, "TOGETHER", 50)
    monkeypatch.setattr(pt, "ALONE", 3)
    assert ids_of(pt.Encoder(machine), texts) == want


def merged(text, score):
    """Merging by the book: the best pair first, the leftmost of equals."""
    parts = list(text)
    while True:
        some = [(score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score]
        if not some:
            return parts
        at = -max(some)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def test_grammar_allows_what_merging_leaves(machine):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
    r, pieces = random.Random(6), list(machine.ids)
    pairs = [(r.choice(pieces), r.choice(pieces)) for _ in range(3000)]
    for p in r.sample(pieces, 3000):  # strings that are pieces, and their parts
        cut = r.randrange(1, len(p)) if len(p) > 1 else 0
        if p[:cut] in machine.ids and p[cut:] in machine.ids:
            pairs.append((p[:cut], p[cut:]))
    ids = np.array([[machine.ids[a], machine.ids[b]] for a, b in pairs])
    got = machine.merges.weight(ids[:, 0], ids[:, 1])
    want = [0.0 if merged(a + b, score) == [a, b] else math.inf for a, b in pairs]
    assert got.tolist() == want and 0.0 in want and math.inf in want


def paths(t, segment):
    """All paths through the composition, as (weight, pieces), one arc after the other."""
    out = []

    def go(at, weight, pieces):
        if at == len(segment):
            out.append((weight, pieces))
        for n in range(1, len(segment) - at + 1):
            piece = t.ids.get(segment[at : at + n], t.other if n == 1 else None)
            if piece is None:
                continue
            more = t.weights[piece]
            if t.merges is not None and pieces and t.other not in (piece, pieces[-1]):
                more += t.merges.weight(np.array([pieces[-1]]), np.array([piece]))[0]
            go(at + n, weight + more, [*pieces, piece])

    go(0, 0.0, [])
    return out


def likelihood_model():
    """The model's pieces as a model by likelihood: the field of the trainer that says so is set."""
    data = open(MODEL, "rb").read()

    def varint(n):
        out = b""
        while n >= 128:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for n, value in pt._fields(data):
        if n == 2:
            value = value + varint(3 << 3) + varint(pt.UNIGRAM)  # the last of equal fields counts
        out += varint(n << 3 | 2) + varint(len(value)) + value
    return out


@pytest.mark.parametrize("kind", ["merges", "likelihood"])
def test_paths_are_the_shortest_of_all(machine, kind):
    t = machine if kind == "merges" else pt.Transducer(likelihood_model())
    r = random.Random(7)
    segments = ["▁" + "".join(r.choice(["the", "an", "re", "in", "e", "s", "🎉", "ß"]) for _ in range(r.randrange(1, 4))) for _ in range(60)]
    for s, found in zip(segments, t.shortest(segments)):
        every = paths(t, s)
        ids = memoryview(found).cast("I").tolist()
        as_pieces = lambda p: [i for x, c in zip(p, cut(t, s, p)) for i in ([x] if x != t.other else [t.fallback[b] for b in c.encode()])]  # noqa: B023, E731
        least = min(w for w, _ in every)
        assert least < math.inf and ids in [as_pieces(p) for w, p in every if w == least]
        assert kind != "merges" or sum(w < math.inf for w, _ in every) == 1


def cut(t, segment, pieces):
    at = 0
    for p in pieces:
        n = 1 if p == t.other else len(t.strings[p])
        yield segment[at : at + n]
        at += n


def test_likelihood_paths_are_no_heavier_than_the_librarys():
    t, sp = pt.Transducer(likelihood_model()), sentencepiece.SentencePieceProcessor(model_proto=likelihood_model())
    for x in ("Hello world of weights", "reconsideration of the internationalisation", "unbelievable antidisestablishmentarianism"):
        ours, theirs = ids_of(pt.Encoder(t), [x])[0], sp.encode(x, num_threads=1)
        assert t.weights[ours].sum() <= t.weights[theirs].sum()


@pytest.mark.parametrize("rules", ["identity", "nmt_nfkc", "nfkc_cf"])
def test_normaliser_follows_the_rule_map(rules):
    n = sentencepiece.SentencePieceNormalizer(rule_name=rules, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    spec = next(v for k, v in pt._fields(n.serialized_model_proto()) if k == 3)
    ours = pt.Normaliser(spec)
    assert bool(ours.rules) == (rules != "identity")
    for x in ("ﬁne Ａ１  ½ é é ﷺ ㌔ ｶﾞ", "  two  spaces ", "Straße ÀÉ", "한글 각", "", "plain"):
        assert ours(x) == n.normalize(x), x


def test_rows(spark):
    df = spark.createDataFrame([(1, "Hello  world\n", 5), (2, None, 5), (3, "", 5), (4, "ab " * 60_000, 5), (1, "Hello  world\n", 5), (5, "x" * 5000, 5)], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in pt.round_trips(df, MODEL).collect()}
    assert all(r.same for r in got.values()) and got[2].n_ids == got[3].n_ids == 0 and got[4].n_chars == 180_000
    back = {r.doc_id: r.text for r in pt.decode(pt.encode(df, MODEL), MODEL).collect()}
    assert back[1] == "Hello  world\n" and back[2] == "" and back[5] == "x" * 5000
    assert pt.round_trips(df.limit(0), MODEL).count() == 0
    with pytest.raises(ValueError):
        pt.Transducer(MODEL).decode([32_000])
