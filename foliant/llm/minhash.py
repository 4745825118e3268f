"""MinHash near-duplicates by an inverted join on signature coordinates.

1. Every text becomes its set of word shingles, hashed to 64 bits, and a signature of 64 minima. Texts
   with one and the same set form a class; from here on there is one entry per class.
2. Every class is posted under each (coordinate, value) of its signature, and the postings are counted.
   A value that only one class has cannot collide.
3. Two classes with J >= 0.8 agree in about 0.8 of 64 coordinates; fewer than MATCHES = 33 happens
   once in twelve million (binomial, 8.2e-8). Classes that agree in 33 must share one of their 64 - 33 + 1 = 32 rarest
   values (rarest first, in one order for all). So only this prefix is joined; common passages, whose
   values are frequent, stay out of it.
4. Within the list of a value, members meet a few pivots, never all each other. Collisions of such a
   pair are counted over both signatures (lists are not read further); each class verifies two
   partners on full sets. Verified links make components. In two more rounds, components outside the largest
   of a list try their most agreeing pairs with pivots of the largest.
5. What is left are lists whose members are in several components; of lists with the same members one is read. Members
   outside a list's largest component are cut into blocks of bounded size and meet each other and the largest
   component, blockwise, by their signatures alone (64 numbers). What leaves a pair of blocks are the members
   that agree with one of another component, each once, whatever the number of its partners. Only these send
   their full sets to that pair of blocks, which counts common shingles as a product of matrices; only links
   that join components leave the task. So of all pairs that pass 3. no link that matters is lost.

A list, or a group of copies, of any size is combined before the shuffle or split by the join. Lists within one
component, which is what copies and near copies mostly are, cost their size times the pivots. Full sets are
made of classes only that agree with another in MATCHES coordinates at least by the counts of step 2.

Defined cases: A-Z are lower-cased and words are what white space (bytes 09-0D and 20) parts; a text of
fewer words than a shingle is one shingle of all of them; null, empty and blank texts have no set and are
linked with nothing; repeated rows and equal sets are linked; a null key is no smallest key, and a
component of null keys only has a null component_id; columns with an output's name are not read;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm._common import SENT_ROWS, by_position, column, components, drop_written, exchanged, materialise, sent, tidy

COORDINATES = 64
MATCHES = 33
PREFIX = COORDINATES - MATCHES + 1
PIVOTS = 3
#: Agreements of likely copies, rounds that join components by few pairs, and pairs that a component tries in each.
CLOSE = 54
ROUNDS = 2
TRIES = 3
#: Members and bytes of sets in a block of a list, columns of a matrix at a time, and rows of pairs at a time.
BLOCK, BLOCK_BYTES, COLUMNS, ROWS = 512, 4 << 20, 1_024, 128
#: Texts or sets that are Python objects at a time, and bytes of words whose hashes a task remembers.
SLICE, REMEMBERED_BYTES = 64, 16 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, (2, COORDINATES), dtype=np.uint64)
_XOR, _TIMES = _SEEDS[0][:, None], (_SEEDS[1] << np.uint64(1) | np.uint64(1))[:, None]


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, words: int):
        self.words, self.known, self.held = words, {}, 0

    def __call__(self, text: str | None) -> np.ndarray:
        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not parts:
            return np.empty(0, np.uint64)
        known = self.known
        new = {*parts}.difference(known)
        if self.held > REMEMBERED_BYTES:
            known.clear()
            self.held, new = 0, {*parts}
        for w in new:
            known[w] = xxhash.xxh64_intdigest(w)
        self.held += 150 * len(new) + sum(map(len, new))
        h = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * _ODD
            out ^= out >> np.uint64(31)
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each of 64 hashes over the set, as 32 bits."""
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        part = (shingles[None, at : at + 4096] ^ _XOR) * _TIMES
        least = np.minimum(least, (part.min(axis=1) >> np.uint64(32)).astype(np.uint32))
    return least.view(np.int32)


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """(key, text_hash, n_shingles, set_hash, signature): the last two null for texts without words."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_hash", T.BinaryType()), T.StructField("signature", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            n, hashes, sigs = [], [], []
            for at in range(0, b.num_rows, SLICE):
                for t in b.column(2).slice(at, SLICE).to_pylist():
                    s = shingler(t)
                    n.append(len(s))
                    hashes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sigs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], names=[f.name for f in schema])

    return docs.select(column(key), F.xxhash64(column(text)).alias("text_hash"), column(text)).mapInArrow(tidy(run), schema)


def _agreements(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda z, x: z + x)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of (a, b) whose full sets are similar enough; sets: (cid, shingles)."""
    hundredths = round(similarity * 100)
    one = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) < hundredths * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= hundredths * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(tidy(run), schema)


_GROUP = "token long, i int, j int, block int, cid long, label long, signature array<int>"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each (token, i, j), which come one group after the other."""
    held: list[tuple] = []
    for b in batches:
        small = [b.column(i).to_pylist() for i in range(6)]
        for i, row in enumerate(zip(*small, strict=True)):
            if held and held[-1][:3] != row[:3]:
                yield held
                held = []
            held.append((*row, b.column(6)[i].values.to_numpy(), b.column(7)[i].as_py()))
    if held:
        yield held


def _candidates(rows: list[tuple], n: np.ndarray, hundredths: int) -> np.ndarray:
    """Which pairs of a group (token, i, j, block, cid, label, signature, ..) are of two components, of sizes that allow the similarity, and agree."""
    _, i, j = rows[0][:3]
    block = np.array([r[3] for r in rows])
    label = np.array([r[5] for r in rows])
    apart = np.triu(label[:, None] != label[None, :], 1)
    if i != j:
        apart &= block[:, None] != block[None, :]
    for x in range(0, len(rows), ROWS):  # some rows at a time, so that what is compared is never as many wide numbers as pairs
        some = slice(x, x + ROWS)
        apart[some] &= 100 * np.minimum(n[some, None], n[None, :]) >= hundredths * np.maximum(n[some, None], n[None, :])
    if apart.any():
        signatures = np.stack([r[6] for r in rows])
        for x in range(0, len(rows), ROWS):
            some = slice(x, x + ROWS)
            agree = np.zeros(apart[some].shape, np.uint8)
            for c in range(COORDINATES):
                agree += signatures[some, c][:, None] == signatures[:, c][None, :]
            apart[some] &= agree >= MATCHES
    return apart


def _across(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join the labels of a list, out of (token, largest, cid, label, n, signature) and sets (cid, shingles).

    Members outside the largest label are cut into blocks of about BLOCK members and BLOCK_BYTES of sets, those of the
    largest into further ones, and each pair of blocks but those of the largest among themselves is one group of
    bounded size. A first pass over signatures finds the members of each group that have a partner; only
    their sets go there. Pairs are neither sent nor written; what leaves a group are the links of a
    spanning forest, as fewer cannot join as much.
    """
    hundredths = round(similarity * 100)
    inside = F.col("label") == F.col("largest")
    cost = F.lit(1.0 / BLOCK) + F.col("n") * (8.0 / BLOCK_BYTES)
    size = members.groupBy("token").agg(F.ceil(F.sum(F.when(inside, 0.0).otherwise(cost))).cast("int").alias("few"), F.ceil(F.sum(F.when(inside, cost).otherwise(0.0))).cast("int").alias("many"))
    hashed = F.xxhash64("cid", "token")
    block = F.when(inside, F.col("few") + F.pmod(hashed, F.greatest("many", F.lit(1)))).otherwise(F.pmod(hashed, F.greatest("few", F.lit(1)))).cast("int")
    size = materialise(size)
    cut = members.join(sent(size), "token").withColumn("block", block)
    met = F.transform(F.sequence(F.lit(0), F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    dealt = cut.select("token", "block", "cid", "label", "signature", "n", F.explode(met).alias("g"))
    dealt = dealt.select("token", F.col("g.i").alias("i"), F.col("g.j").alias("j"), "block", "cid", "label", "signature", "n")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            apart = _candidates(rows, np.array([r[7] for r in rows]), hundredths)
            there = np.flatnonzero(apart.any(axis=0) | apart.any(axis=1))
            if len(there):
                cols = list(zip(*(rows[x][:7] for x in there), strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["token", "i", "j", "block", "cid", "label", "signature"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            yield _links([(*r[:7], np.frombuffer(r[7], np.uint64)) for r in rows], hundredths)

    group = ["token", "i", "j"]
    partnered = materialise(dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(tidy(near), _GROUP))
    with_sets = sent(partnered, SENT_ROWS // 16).join(sets, "cid")  # rows of 70 numbers.select(*partnered.columns, "shingles")
    out = materialise(with_sets.repartition(*group).sortWithinPartitions(*group).mapInArrow(tidy(linked), "a long, b long"))
    for step in (partnered, size):
        drop_written(members.sparkSession, step)
    return out


def _links(rows: list[tuple], hundredths: int) -> pa.RecordBatch:
    """Links of one group (token, i, j, block, cid, label, signature, shingles): first come, and only where labels are not joined yet."""
    label = np.unique([r[5] for r in rows], return_inverse=True)[1]
    n = np.array([len(r[7]) for r in rows])
    found: list[tuple[int, int]] = []
    apart = _candidates(rows, n, hundredths)
    if apart.any():
        every = np.concatenate([r[7] for r in rows])
        _, which, times = np.unique(every, return_inverse=True, return_counts=True)
        del every
        shared = times > 1
        place = np.cumsum(shared) - 1
        keep = shared[which]
        at = np.repeat(np.arange(len(rows)), n)[keep]
        where = place[which[keep]]
        common = np.zeros((len(rows), len(rows)), np.float32)
        for low in range(0, int(shared.sum()), COLUMNS):  # common shingles, some columns at a time
            part = (where >= low) & (where < low + COLUMNS)
            x = np.zeros((len(rows), min(COLUMNS, int(shared.sum()) - low)), np.float32)
            x[at[part], where[part] - low] = 1
            common += x @ x.T
        for x in range(0, len(rows), ROWS):
            some = slice(x, x + ROWS)
            both = common[some].astype(np.int64)
            apart[some] &= 100 * both >= hundredths * (n[some, None] + n[None, :] - both)
        root = np.arange(label.max() + 1)
        for a, b in zip(*np.nonzero(apart), strict=True):
            p, q = root[label[a]], root[label[b]]
            if p != q:
                root[root == q] = p
                found.append((rows[a][4], rows[b][4]))
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per document: key, text_hash, n_shingles, class_id, component_id (smallest key of its component), kept (key = component_id).

    class_id is the same for all documents of a component; null for those without words, which have their own key as component_id.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("the prefix is made for similarities of 0.8 and more")
    rows = materialise(sketches(docs, key, text, words))
    classes = (
        rows.where("set_hash is not null")
        .groupBy("set_hash")
        .agg(F.min(column(key)).alias("low"), F.min(F.struct(column(key).alias("k"), F.col("text_hash").alias("h"))).alias("one"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    classes = materialise(classes)

    # postings, and the values that at least two classes have
    token = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("col").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    posted = classes.select("cid", F.posexplode("signature")).select("cid", token.alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    common = exchanged(posted).join(shared, "token").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("values"))  # 64 at most
    n = F.size("values")
    prefix = F.transform(F.slice("values", F.lit(1), F.greatest(F.lit(0), F.lit(PREFIX - COORDINATES) + n)), lambda v: v["token"])
    listed = materialise(common.where(n >= MATCHES).select("cid", prefix.alias("prefix")).join(exchanged(classes.select("cid", "signature")), "cid"))
    posts = listed.select("cid", F.explode("prefix").alias("token"))

    # full sets of the classes that have any list in common with others; a table of three numbers a class is sent to the
    # texts while it is small
    wanted = materialise(classes.select("cid", F.col("one.k").alias("_k"), F.col("one.h").alias("_h")).join(listed.select("cid"), "cid", "left_semi"))
    texts = docs.select(column(key).alias("_key"), F.xxhash64(column(text)).alias("_hash"), column(text).alias("_text"))
    found = texts.join(sent(wanted), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h"))).select("cid", "_text")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingler(t).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["cid", "shingles"])

    sets = materialise(found.mapInArrow(tidy(full), "cid long, shingles binary").dropDuplicates(["cid"]))

    # members meet pivots
    pivots = posts.groupBy("token").agg(F.count("*").alias("m"), F.array(*[F.min(F.struct(F.xxhash64("cid", F.lit(i)).alias("h"), F.col("cid"))) for i in range(PIVOTS)]).alias("p")).where("m > 1")
    meet = exchanged(posts).join(pivots.select("token", F.array_distinct(F.transform("p", lambda p: p["cid"])).alias("p")), "token")
    meet = meet.select(F.col("cid").alias("a"), F.explode("p").alias("b")).where("a <> b").select("a", "b").distinct()
    signatures = listed.select("cid", "signature")
    met = meet.join(exchanged(signatures.select(F.col("cid").alias("a"), F.col("signature").alias("sa"))), "a").join(exchanged(signatures.select(F.col("cid").alias("b"), F.col("signature").alias("sb"))), "b")
    scored = met.select("a", "b", _agreements("sa", "sb").alias("n")).where(F.col("n") >= MATCHES)
    # the partner that agrees most, and of those that agree as near copies do the first by hash, which is the first of many
    hashed = F.struct(F.xxhash64("b").alias("h"), F.col("b"))
    best = scored.groupBy("a").agg(F.max(F.struct("n", "b")).getField("b").alias("most"), F.min(F.when(F.col("n") >= CLOSE, hashed)).getField("b").alias("hub"))
    pairs = best.select("a", F.explode(F.array("most", "hub")).alias("b")).where("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialise(_verified(pairs, sets, similarity))
    first = materialise(components(links))

    # lists that hold several components, and of those with the same members (count, and sums of two hashes) one
    def lists(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        labelled = materialise(posts.join(found.withColumnRenamed("id", "cid"), "cid", "left").select("token", "cid", F.coalesce("root", "cid").alias("label")))
        sums = [F.sum(F.xxhash64(F.lit(i), "cid").cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)]
        by_label = labelled.groupBy("token", "label").agg(F.count("*").alias("m"), *sums)
        mixed = by_label.groupBy("token").agg(F.max_by("label", F.struct("m", "label")).alias("largest"), F.count("*").alias("n"), F.sum("m").alias("m"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")).where("n > 1")
        mixed = mixed.groupBy("m", "s1", "s2").agg(F.min("token").alias("token"), F.first("largest").alias("largest"))
        return labelled, materialise(mixed.select("token", "largest"))

    spent = [listed, wanted, sets, links]
    for turn in range(ROUNDS):
        labelled, mixed = lists(first)
        members = labelled.join(sent(mixed), "token")
        hubs = members.where("label = largest").groupBy("token").agg(F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("cid", F.lit(100 * turn + i)).alias("h"), F.col("cid"))).getField("cid") for i in range(PIVOTS)])).alias("b"))
        meet = members.where("label <> largest").join(hubs, "token").select("label", F.col("cid").alias("a"), F.explode("b").alias("b")).distinct()
        met = meet.join(exchanged(signatures.select(F.col("cid").alias("a"), F.col("signature").alias("sa"))), "a").join(exchanged(signatures.select(F.col("cid").alias("b"), F.col("signature").alias("sb"))), "b")
        scored = met.select("label", "a", "b", _agreements("sa", "sb").alias("n")).where(F.col("n") >= MATCHES)
        tries = [F.max(F.struct("n", F.xxhash64("a", "b", F.lit(i)).alias("h"), "a", "b")) for i in range(TRIES)]
        chosen = scored.groupBy("label").agg(F.array_distinct(F.transform(F.array(*tries), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))).alias("p"))
        spent += [labelled, mixed]
        more = _verified(chosen.select(F.inline("p")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, similarity)
        spent.append(first)
        first = materialise(components(first.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more)))

    labelled, mixed = lists(first)
    sizes = classes.select("cid", F.col("n").alias("n"))
    members = materialise(labelled.join(sent(mixed), "token").join(exchanged(signatures), "cid").join(sizes, "cid").select("token", "largest", "cid", "label", "n", "signature"))
    more = _across(members, sets, similarity)
    joined = first.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more)
    final = components(joined)
    for step in (*spent, first, labelled, mixed, members):  # the result needs only the documents, the classes and their components
        drop_written(docs.sparkSession, step)

    named = classes.select("set_hash", "cid", "low").join(final.withColumnRenamed("id", "cid"), "cid", "left").select("set_hash", "low", F.coalesce("root", "cid").alias("class_id"))
    least = named.groupBy("class_id").agg(F.min("low").alias("component_id"))
    of_set = named.join(least, "class_id").select("set_hash", "class_id", "component_id")
    out = rows.join(of_set, "set_hash", "left")
    component = F.when(F.col("set_hash").isNull(), column(key)).otherwise(F.col("component_id"))
    return out.select(column(key), "text_hash", "n_shingles", "class_id", component.alias("component_id"), F.coalesce(column(key) == component, component.isNull()).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one document of each group of near-duplicates; those without words all stay."""
    base = by_position(docs)
    k, t = (F.col(f"c{docs.columns.index(c)}") for c in (key, text))
    near = near_duplicates(base.select(k.alias("key"), t.alias("text")), "key", "text", words, similarity).where("kept and class_id is not null")
    # one column for the pair, so that what the join has dealt need not be dealt again to drop repeated rows
    pair = lambda a, b: F.struct(a.alias("k"), b.alias("h"))
    kept = near.groupBy("class_id").agg(F.min(pair(F.col("key"), F.col("text_hash"))).alias("pair")).select("pair")
    worded = F.coalesce(F.rlike(t, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    some = base.where(worded).withColumn("pair", pair(k, F.xxhash64(t))).join(kept, "pair", "left_semi").dropDuplicates(["pair"]).drop("pair")
    return some.unionByName(base.where(~worded)).toDF(*docs.columns)


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    """All documents by shingles of four words and a similarity of 0.8."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
    return out.select("doc_id", "n_shingles", "component_id", "kept")
