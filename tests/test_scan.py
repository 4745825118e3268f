import random

from foliant.operators import indicators


def fold(x):
    """All bars one after the other."""
    f = s = x[0]
    g, up, down = 0.0, 0.0, 0.0
    for i, c in enumerate(x):
        f, s = f + 2 / 13 * (c - f), s + 2 / 27 * (c - s)
        g += 2 / 10 * (f - s - g)
        if i:
            u, d = max(c - x[i - 1], 0), max(x[i - 1] - c, 0)
            up, down = (up + u / 14, down + d / 14) if i <= 14 else ((13 * up + u) / 14, (13 * down + d) / 14)
    rsi = None if len(x) <= 14 else (50.0 if up == 0 else 100.0) if down == 0 else 100 - 100 / (1 + up / down)
    return rsi, f - s, g, f - s - g


def test_scan_equals_the_fold(spark):
    r = random.Random(1)
    series = {f"n{n}": [round(r.uniform(1, 90), 2) for _ in range(n)] for n in (1, 2, 13, 14, 15, 16, 17, 40, 300, 5000)}
    series |= {"up": list(map(float, range(1, 60))), "flat": [5.0] * 60}
    rows = [(t, i, c) for t, x in series.items() for i, c in enumerate(x)]
    r.shuffle(rows)
    bars = spark.createDataFrame([*rows, ("n40", None, 3.0), ("n40", 999, None), ("none", 1, None)], "ticker string, ts long, close double").repartition(5)
    got = {x.ticker: tuple(x)[1:] for x in indicators.scanned(bars).collect()}
    assert set(got) == set(series)
    for t, x in series.items():
        for a, b in zip(got[t], fold(x)):
            assert (a is None and b is None) or abs(a - b) <= 1e-6, t
    assert indicators.scanned(bars.limit(0)).count() == 0


def test_a_series_lies_in_several_ranges_and_in_no_array(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        bars = spark.range(4000).selectExpr("'x' AS ticker", "id AS ts", "50 + 20 * sin(id) AS close")
        out = indicators.scanned(bars)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("collect_list") == 1 and "SinglePartition" not in plan
        want = fold([r.close for r in bars.orderBy("ts").collect()])
        assert all(abs(a - b) <= 1e-6 for a, b in zip(tuple(out.first())[1:], want))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
