"""Uniform shuffle into shards of exact sizes, by a communication matrix of hypergeometric counts.

1. Rows fall into blocks by a hash of their keys; the blocks are counted.
2. How many rows of each block go to each shard is drawn exactly as a uniform permutation would have it:
   a multivariate hypergeometric law with the block counts as one margin and the shard sizes as the
   other. The draw halves the blocks again and again: the rows of the left half take from each shard's
   room in turn a hypergeometric count, and the right half keeps the rest. Halves are dealt anew to tasks as they multiply.
3. Each block permutes its rows by hashed random keys; its first rows go to the first shard, and so on.
4. Shards exchange rows and permute them again by other random keys: rows of a shard are dealt by ranges of these keys, and
   a row's slot is its rank in its range and the number of rows in the ranges before it. So neither a block nor a
   range of a shard grows with the input, and no task has a shard to itself.

Everything is DataFrame operations: no Python runs on rows. All draws are hashes of a seed with a row's
keys or a cell's place in the matrix, so a lost executor's work repeats to the same result. The rows are written once, with their blocks.

Univariate draws invert the distribution in the order of the distance from its mode, which is as good an order as any. The mode's
probability comes from Stirling's series and deviances, to about 14 digits at any size; its neighbours' by exact ratios, with a state of
four numbers. How far the walk can go is known from the uniform number: 1.4 standard deviations on average. Only where the mass within is not enough,
the walk is repeated up to 8.5 standard deviations and 40 more; what is beyond is less than a double's last digit.

Defined cases: shard sizes differ by one at most, the first shards being larger; rows are what is
shuffled, groups of equal texts are not kept together (a uniform shuffle with exact sizes rules that
out); nulls in keys hash as nulls; repeated rows are spread like any others, by their place in the input besides their keys, so
that the same rows in the same files give the same result; an empty table gives an empty table; columns of the
input with an output's name are replaced, and others may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm._common import by_position, materialise, without

#: Rows to a block and to a range of a shard, and how many blocks' counts are one row's array: more blocks are drawn by groups of so many first.
BLOCK_ROWS = 4_096
GROUP_BLOCKS = 1 << 14
#: Halvings after which the nodes are dealt to tasks anew.
DEAL_AFTER = (1, 3, 6, 10)


def _uniform(*cells: Column | int) -> Column:
    """A number in (0, 1) by hashing."""
    h = F.xxhash64(*[c if isinstance(c, Column) else F.lit(c) for c in cells])
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def _double(x: float) -> str:
    return f"{x!r}D"


#: What follows is SQL, as a draw is many small steps; a one-element array and a lambda name what is used more than once.
#: ln y! less y ln y - y: by the factorial itself up to 15 (0 for 0), then by Stirling's series, whose next term is below a double's last digit.
_HALF_LOG = f"""CASE WHEN c.y <= 0 THEN 0D WHEN c.y <= 15 THEN ln(cast(factorial(cast(c.y AS int)) AS double)) - c.y * ln(c.y) + c.y
  ELSE 0.5D * ln(c.y * {_double(2 * math.pi)}) + 1D / c.y * ({_double(1 / 12)} - 1D / c.y / c.y * ({_double(1 / 360)} - 1D / c.y / c.y * ({_double(1 / 1260)} - 1D / c.y / c.y * {_double(1 / 1680)}))) END"""
#: y ln(y / mean) + mean - y, without loss of digits where y is near its mean: a series in v = (y - mean) / (y + mean). No mean, no deviance.
_TAIL = "0D"
for _j in range(8, 0, -1):
    _TAIL = f"c.v * c.v * ({_double(1 / (2 * _j + 1))} + {_TAIL})"
_DEVIANCE = f"CASE WHEN c.mean IS NULL THEN 0D WHEN c.y <= 0 THEN c.mean WHEN abs(c.v) < 0.1D THEN (c.y - c.mean) * c.v + 2 * c.y * c.v * {_TAIL} ELSE c.y * ln(c.y / c.mean) + c.mean - c.y END"

_START = """x -> struct(x.k AS k, x.b AS b, x.n AS n, x.u AS u, greatest(0L, x.n - x.b) AS low, least(x.n, x.k) AS high, greatest(x.k + x.b, 1L) * 1D AS total)"""
_MODE = """x -> struct(x.k AS k, x.b AS b, x.n AS n, x.u AS u, x.low AS low, x.high AS high,
  greatest(x.low, least(x.high, cast(floor((x.n + 1D) * (x.k + 1D) / (x.k + x.b + 2D)) AS bigint))) AS m, x.n / x.total AS share,
  sqrt(x.n * (x.k / x.total) * (x.b / x.total) * (x.total - x.n) / greatest(x.total - 1, 1D)) AS spread)"""
_MARGINS, _CELLS = ("x.k", "x.b", "x.n", "x.k + x.b - x.n"), (("x.m", "x.k * x.share"), ("x.k - x.m", "x.k * (1 - x.share)"), ("x.n - x.m", "x.b * x.share"), ("x.b - x.n + x.m", "x.b * (1 - x.share)"))
_TERMS = ", ".join(f"struct(({y}) * 1D AS y, {mean} AS mean, {sign}D AS sign)" for y, mean, sign in (*((y, "cast(null AS double)", 1) for y in _MARGINS), ("x.k + x.b", "cast(null AS double)", -1), *((y, mean, -1) for y, mean in _CELLS)))
#: With the probability of the mode: a sum over the margins, and over the four cells with what is expected in them.
_MASS = f"""x -> struct(x.k AS k, x.b AS b, x.n AS n, x.u AS u, x.m AS m, x.spread AS spread, greatest(x.m - x.low, x.high - x.m) AS most,
  exp(aggregate(transform(array(
      {_TERMS}),
    c -> struct(c.y AS y, c.mean AS mean, c.sign AS sign, coalesce(try_divide(c.y - c.mean, c.y + c.mean), 0D) AS v)),
    0D, (z, c) -> z + c.sign * ({_HALF_LOG} + {_DEVIANCE}))) AS p)"""
#: struct(at, left) of a walk: the place found (null: none yet) and what is left of u. Beyond an end a factor is 0, and so is all that follows.
_WALK = """aggregate(if(steps > 0, sequence(1L, steps), cast(array() AS array<bigint>)),
  struct(s.p AS above, s.p AS below, s.u - s.p AS left, if(s.u < s.p, s.m, cast(null AS bigint)) AS at),
  (z, i) -> if(z.at IS NOT NULL, z, transform(array(struct(
      z.above * (greatest(s.k - s.m - i + 1, 0L) * 1D * greatest(s.n - s.m - i + 1, 0L)) / ((s.m + i) * 1D * (s.b - s.n + s.m + i)) AS above,
      z.below * (greatest(s.m - i + 1, 0L) * 1D * greatest(s.b - s.n + s.m - i + 1, 0L)) / ((s.k - s.m + i) * 1D * (s.n - s.m + i)) AS below)),
    y -> struct(y.above AS above, y.below AS below, z.left - y.above - y.below AS left, CASE WHEN z.left < y.above THEN s.m + i WHEN z.left < y.above + y.below THEN s.m - i END AS at))[0]))"""
#: A walk as long as the share asks for; only where the law's tail is heavier than the bound's, one over all that is within 8.5 standard deviations.
STEPS = "cast(ceil(1.1D * spread * sqrt(-2 * ln(1 - u))) AS bigint) + 16"
_FOUND = f"""s -> coalesce(aggregate(array(least(s.most, cast(ceil(s.spread * 8.5D) AS bigint) + 40, {STEPS.replace("spread", "s.spread").replace("u))", "s.u))")}), least(s.most, cast(ceil(s.spread * 8.5D) AS bigint) + 40)),
  cast(null AS bigint), (found, steps) -> if(found IS NOT NULL, found, {_WALK}.at)), s.m)"""


def hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """How many of `draws` from `good` + `bad` items without return are good: places in order of their distance from the mode, the upper first, until their mass passes `u`."""
    out = F.array(F.struct(good.cast("long").alias("k"), bad.cast("long").alias("b"), draws.cast("long").alias("n"), u.alias("u")))
    for step in (_START, _MODE, _MASS, _FOUND):
        out = F.call_function("transform", out, F.expr(step))
    return out[0]


def _taken(seed: int, level: int):
    """The step of a fold over the rooms of the shards: what the left half takes of each."""

    def step(z: Column, x: Column) -> Column:
        got = hypergeometric(x, z["left"] - x, z["need"], _uniform(seed, level, F.col("first"), F.size(z["out"])))
        one = F.transform(F.array(got), lambda g: F.struct((z["need"] - g).alias("need"), (z["left"] - x).alias("left"), F.concat(z["out"], F.array(g)).alias("out")))
        return one[0]

    return step


def communication_matrix(counts: DataFrame, blocks: int, shards: int, rows: int, seed: int = 7) -> DataFrame:
    """(block, to): `to[s]` rows of each block go to shard s.

    counts: (block int from 0, n long), blocks without rows left out; rows: their sum. Blocks beyond GROUP_BLOCKS are drawn in
    groups, whose counts are a matrix of their own, so that no row holds more than so many counts, whatever the size of the input.
    """
    if blocks > GROUP_BLOCKS:
        width = GROUP_BLOCKS
        grouped = counts.select(F.expr(f"block div {width}").cast("int").alias("group"), (F.col("block") % width).alias("place"), "n")
        above = communication_matrix(grouped.groupBy(F.col("group").alias("block")).agg(F.sum("n").alias("n")), -(-blocks // width), shards, rows, seed + 1_000_003)
        by = grouped.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("by"))  # GROUP_BLOCKS counts at most
        root = by.join(above.select(F.col("block").alias("group"), F.col("to").alias("room")), "group").select((F.col("group") * width).alias("first"), "by", "room")
    else:
        width = 1 << max(0, math.ceil(math.log2(max(blocks, 1))))
        room = F.expr(f"transform(sequence(0, {shards - 1}), s -> cast({rows // shards} + if(s < {rows % shards}, 1, 0) as bigint))")
        by = counts.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("block", "n"))).alias("by"))
        root = by.select(F.lit(0).alias("first"), "by", room.alias("room"))
    # one array of counts per block number in order; a block without rows has 0
    node = root.select("first", F.expr(f"transform(sequence(0, {width - 1}), i -> coalesce(try_element_at(by, i), 0L))").alias("n"), "room")
    level, halvings = width, 0
    while level > 1:
        level //= 2
        if halvings in DEAL_AFTER:  # a number of tasks is named, as the rows are few and small but dear
            node = node.repartition((1 << halvings) * max(1, -(-blocks // GROUP_BLOCKS)), "first")
        halvings += 1
        left = F.slice(F.col("n"), 1, level)
        node = node.select("first", "n", "room", F.aggregate(left, F.lit(0).cast("long"), lambda z, x: z + x).alias("take"))
        # shard by shard: the left half takes from this shard's room, given what it still needs and what room is left after it
        start = F.struct(F.col("take").alias("need"), F.aggregate("room", F.lit(0).cast("long"), lambda z, x: z + x).alias("left"), F.expr("cast(array() as array<bigint>)").alias("out"))

        node = node.select("first", "n", "room", F.aggregate("room", start, _taken(seed, level))["out"].alias("got"))
        halves = F.array(
            F.struct(F.col("first"), F.slice("n", 1, level).alias("n"), F.col("got").alias("room")),
            F.struct((F.col("first") + level).alias("first"), F.slice(F.col("n"), level + 1, level).alias("n"), F.zip_with("room", "got", lambda r, g: r - g).alias("room")),
        )
        node = node.select(F.inline(halves)).where(F.exists("n", lambda x: x > 0))
    return node.select(F.col("first").alias("block"), F.col("room").alias("to"))


def shuffle(df: DataFrame, keys: list[str], shards: int, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`df` with columns shard (0 to shards - 1) and slot (gapless from 0 in each shard), as a uniform permutation cut into equal shards.

    `keys` tell rows apart; rows that share all keys are told apart by their place in the input.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    named = without(df, "shard", "slot")
    base = by_position(named)
    key = F.xxhash64(F.lit(seed), *[F.col(f"c{named.columns.index(k)}") for k in keys])
    # rows that repeat are told apart by their place in the input, as copies are to be spread like any rows; where none does, nothing is joined
    often = materialise(base.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1"))
    hashed = base.withColumn("key", key)
    if often.isEmpty():
        hashed = hashed.withColumn("part", F.lit(0).cast("long"))
    else:
        hashed = hashed.withColumn("row", F.monotonically_increasing_id()).join(often, "key", "left").withColumn("part", F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.xxhash64("row"))).drop("row", "n")
    hashed = materialise(hashed)
    rows = hashed.count()
    blocks = max(1, -(-rows // block_rows))
    hashed = hashed.withColumn("block", F.pmod(F.xxhash64("key", "part"), F.lit(blocks)).cast("int"))
    counts = hashed.groupBy("block").agg(F.count("*").alias("n"))
    # cut points within each block: shard s takes ranks up to its running sum
    cuts = communication_matrix(counts, blocks, shards, rows, seed).select(
        "block",
        F.aggregate("to", F.expr("cast(array() as array<bigint>)"), lambda z, x: F.concat(z, F.array(F.coalesce(F.get(z, F.size(z) - 1), F.lit(0)) + x))).alias("cuts"),
    )
    order = [F.col(f"c{named.columns.index(k)}") for k in keys]
    turn = lambda n: F.xxhash64(F.lit(seed + n), "key", "part")
    ranked = hashed.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy(turn(1), *order)).cast("long"))
    # ranges of a shard's second random keys, as many as make them as large as blocks
    ranges = max(0, math.ceil(math.log2(max(1.0, rows / shards / block_rows))))
    sent = ranked.join(cuts, "block").withColumn("shard", F.size(F.filter("cuts", lambda c: c < F.col("rank"))).cast("int")).drop("cuts", "rank", "block")
    sent = sent.withColumn("turn", turn(2))
    sent = materialise(sent.withColumn("range", F.shiftrightunsigned("turn", 64 - ranges) if ranges else F.lit(0).cast("long")))
    sized = sent.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = sized.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).select("shard", "range", "before")  # one row for a range
    place = F.row_number().over(Window.partitionBy("shard", "range").orderBy("turn", *order))
    out = sent.withColumn("place", place).join(before, ["shard", "range"])
    return out.select(*base.columns, "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot")).toDF(*named.columns, "shard", "slot")


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards with counts at most one apart: law `rows`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"))
    out = shuffle(told, ["doc_id", "size", "text_crc32"], 40)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
