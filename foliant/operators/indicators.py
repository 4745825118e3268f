"""Technical indicators over daily bars (ticker, ts, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.shared import written

ENOUGH_BARS = 210


def _window(n: int) -> Window:
    return Window.partitionBy("ticker").orderBy("ts").rowsBetween(-(n - 1), 0)


def sma(n: int, x: str = "close") -> Column:
    """Mean of the last n values; null before there are n."""
    w = _window(n)
    return F.when(F.count(x).over(w) == n, F.avg(x).over(w))


def bollinger(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    """Mean and the bands k population deviations around it."""
    w = _window(n)
    mid, sd = sma(n), F.stddev_pop("close").over(w)
    return {"bb_upper": mid + k * sd, "bb_mid": mid, "bb_lower": mid - k * sd}


def volume_ratio(n: int = 20) -> Column:
    """Volume against the mean of the last n bars, itself included (fewer at the start); null for a mean of 0."""
    mean = F.avg("volume").over(_window(n))
    return F.when(mean != 0, F.col("volume") / mean)


def rsi(closes: Column, n: int = 14) -> Column:
    """Relative strength by Wilder's smoothing, at the end of an array of closes in order; null for n closes or fewer."""
    moves = F.zip_with(F.slice(closes, F.lit(2), F.size(closes) - 1), F.slice(closes, F.lit(1), F.size(closes) - 1), lambda x, y: x - y)

    def mean(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda z, x: z + x) / n

    def of(moves: Column) -> Column:
        head = F.slice(moves, 1, n)
        start = F.struct(mean(F.transform(head, lambda x: F.greatest(x, F.lit(0.0)))).alias("up"), mean(F.transform(head, lambda x: F.greatest(-x, F.lit(0.0)))).alias("down"))
        step = lambda z, x: F.struct(((n - 1) * z["up"] + F.greatest(x, F.lit(0.0))) / n, ((n - 1) * z["down"] + F.greatest(-x, F.lit(0.0))) / n)
        named = lambda z, x: F.struct(step(z, x)["col1"].alias("up"), step(z, x)["col2"].alias("down"))
        end = F.aggregate(F.slice(moves, F.lit(n + 1), F.greatest(F.size(moves) - n, F.lit(0))), start, named)
        return F.transform(F.array(end), lambda z: F.when(z["down"] == 0, F.when(z["up"] == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + z["up"] / z["down"])))[0]

    return F.when(F.size(closes) > n, F.transform(F.array(moves), of)[0])


def _macd(closes: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """struct(line, signal) at the end of an array of closes in order: exponential means that begin with the first value, folded with three numbers."""
    share = lambda n: F.lit(2.0 / (n + 1))

    def step(z: Column, x: Column) -> Column:
        f, s = z["f"] + share(fast) * (x - z["f"]), z["s"] + share(slow) * (x - z["s"])
        return F.struct(f.alias("f"), s.alias("s"), (z["g"] + share(signal) * (f - s - z["g"])).alias("g"))

    first = F.get(closes, F.lit(0))
    start = F.struct(first.alias("f"), first.alias("s"), F.lit(0.0).alias("g"))
    end = F.aggregate(closes, start, step, lambda z: F.struct((z["f"] - z["s"]).alias("line"), z["g"].alias("signal")))
    return F.when(F.size(closes) > 0, end)


def macd(bars: DataFrame) -> DataFrame:
    """(ticker, macd, macd_signal, macd_histogram) at the last bar: means of 12 and 26 bars, and their difference's of 9."""
    closes = bars.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "close"))), lambda b: b["close"].cast("double")).alias("c"))
    return closes.select("ticker", _macd(F.col("c")).alias("m")).select("ticker", F.col("m.line").alias("macd"), F.col("m.signal").alias("macd_signal"), (F.col("m.line") - F.col("m.signal")).alias("macd_histogram"))


def indicators(bars: DataFrame) -> DataFrame:
    """One row per ticker, as of its last bar, rounded to 6 places. A series is one key's bars: a few hundred."""
    w = Window.partitionBy("ticker").orderBy(F.desc("ts"))
    rolled = bars.select("ticker", "ts", "close", F.row_number().over(w).alias("_n"), sma(50).alias("sma_50"), sma(200).alias("sma_200"), *[c.alias(k) for k, c in bollinger().items()], volume_ratio().alias("volume_ratio"))
    last = rolled.where("_n = 1").drop("_n")
    closes = bars.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "close"))), lambda b: b["close"].cast("double")).alias("c"))
    folded = closes.select("ticker", rsi(F.col("c")).alias("rsi_14"), _macd(F.col("c")).alias("m"))
    out = last.join(folded.select("ticker", "rsi_14", F.col("m.line").alias("macd"), F.col("m.signal").alias("macd_signal"), (F.col("m.line") - F.col("m.signal")).alias("macd_histogram")), "ticker")
    numbers = [c for c in out.columns if c not in ("ticker", "ts")]
    return out.select("ticker", "ts", *[F.round(c, 6).alias(c) for c in numbers])


def _before(w: Window, c: str) -> Column:
    return F.lag(c).over(w)


def scanned(bars: DataFrame, n: int = 14, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """(ticker, rsi_14, macd, macd_signal, macd_histogram) at the last bar, for series of any length: a parallel scan of the recurrences.

    Bars lie in ranges of (ticker, ts). What a ticker's bars of one range do to the state of a recurrence is an affine map, whose factors are powers
    of its decay, and whose constant is a weighted sum: one aggregation. The maps of a ticker's ranges, of which there are a few, are composed in order. No task
    and no array holds a series. Nulls: bars without a close or ts are left out; of bars with one ts all count, in any order.
    """
    placed = written(bars.where("close is not null and ts is not null").select("ticker", "ts", F.col("close").cast("double").alias("x")).repartitionByRange("ticker", "ts").withColumn("part", F.spark_partition_id()))
    # a range's bars come with what was before them: how many bars, and the last close
    ranges = placed.groupBy("ticker", "part").agg(F.count("*").alias("bars"), F.max_by("x", "ts").alias("end"))
    order = Window.partitionBy("ticker").orderBy("part")  # a row a range
    before = ranges.select("ticker", "part", "bars", F.coalesce(F.sum("bars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), _before(order, "end").alias("carried"))
    w = Window.partitionBy("ticker", "part").orderBy("ts")
    each = placed.select("ticker", "part", "ts", "x", F.row_number().over(w).alias("j"), _before(w, "x").alias("last")).join(before, ["ticker", "part"])
    move, after = F.col("x") - F.coalesce("last", "carried"), F.col("bars") - F.col("j")
    each = each.select("ticker", "part", "x", "bars", "j", after.alias("after"), (F.col("offset") + F.col("j")).alias("i"), F.greatest(move, F.lit(0.0)).alias("up"), F.greatest(-move, F.lit(0.0)).alias("down"))
    p, q, b, kept = 1 - 2 / (fast + 1), 1 - 2 / (slow + 1), 2 / (signal + 1), (n - 1) / n
    r = 1 - b
    power = lambda base, e: F.pow(F.lit(base), e)
    # weights of a close in a mean of means: the sum of all ways through the two decays
    both = lambda d, e: (power(d, e) - power(r, e)) / (d - r)
    smoothed = F.col("i") > n + 1
    maps = each.groupBy("ticker", "part").agg(
        F.max("bars").alias("n"),
        F.min_by("x", "j").alias("first"),
        F.sum((1 - p) * power(p, F.col("after")) * F.col("x")).alias("f"),
        F.sum((1 - q) * power(q, F.col("after")) * F.col("x")).alias("s"),
        F.sum(b * F.col("x") * ((1 - p) * both(p, F.col("after") + 1) - (1 - q) * both(q, F.col("after") + 1))).alias("g"),
        F.count_if(smoothed).alias("moves"),
        *[F.sum(F.when(smoothed, power(kept, F.col("after")) * F.col(c) / n).otherwise(0.0)).alias(c) for c in ("up", "down")],
        *[F.sum(F.when((F.col("i") > 1) & ~smoothed, F.col(c) / n).otherwise(0.0)).alias(f"{c}_seed") for c in ("up", "down")],
    )
    names = ("part", "n", "first", "f", "s", "g", "moves", "up", "down", "up_seed", "down_seed")
    lists = maps.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("maps"))  # a row a range

    def compose(z: Column, m: Column) -> Column:
        f, s = power(p, m["n"]) * z["f"] + m["f"], power(q, m["n"]) * z["s"] + m["s"]
        g = power(r, m["n"]) * z["g"] + b * (p * both(p, m["n"]) * z["f"] - q * both(q, m["n"]) * z["s"]) + m["g"]
        # the mean of the first moves is where smoothing begins, so it comes before what is smoothed
        smooth = lambda c: power(kept, m["moves"]) * (z[c] + m[f"{c}_seed"]) + m[c]
        return F.struct((z["n"] + m["n"]).alias("n"), f.alias("f"), s.alias("s"), g.alias("g"), smooth("up").alias("up"), smooth("down").alias("down"))

    first, zero = F.col("maps")[0]["first"], F.lit(0.0)
    start = F.struct(F.lit(0).cast("long").alias("n"), first.alias("f"), first.alias("s"), zero.alias("g"), zero.alias("up"), zero.alias("down"))
    end = lists.select("ticker", F.aggregate("maps", start, compose).alias("z"))
    up, down = F.col("z.up"), F.col("z.down")
    rsi_ = F.when(F.col("z.n") > n, F.when(down == 0, F.when(up == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + up / F.nullif(down, F.lit(0.0)))))
    line = F.col("z.f") - F.col("z.s")
    return end.select("ticker", *[F.round(c, 6).alias(name) for name, c in (("rsi_14", rsi_), ("macd", line), ("macd_signal", F.col("z.g")), ("macd_histogram", line - F.col("z.g")))])


def prefer(sources: list[DataFrame], enough: int = ENOUGH_BARS) -> DataFrame:
    """For each ticker the bars of the first source that has enough of them; none where no source has."""
    every = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    out = every[0]
    for s in every[1:]:
        out = out.unionByName(s)
    best = out.groupBy("ticker", "_source").agg(F.count("*").alias("_n")).where(F.col("_n") >= enough).groupBy("ticker").agg(F.min("_source").alias("_source"))
    return out.join(best, ["ticker", "_source"]).drop("_source")
