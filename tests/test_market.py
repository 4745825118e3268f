from datetime import date

import pytest

from foliant.operators import indicators, news


def wilder(closes, n=14):
    moves = [b - a for a, b in zip(closes, closes[1:])]
    up = sum(max(m, 0) for m in moves[:n]) / n
    down = sum(max(-m, 0) for m in moves[:n]) / n
    for m in moves[n:]:
        up, down = (up * (n - 1) + max(m, 0)) / n, (down * (n - 1) + max(-m, 0)) / n
    return 100 - 100 / (1 + up / down)


def mean_of(values, n):
    out = [values[0]]
    for v in values[1:]:
        out.append(out[-1] + 2 / (n + 1) * (v - out[-1]))
    return out


def test_indicators_against_plain_loops(spark):
    closes = [100 + (i * 37 % 23) - (i * i % 7) for i in range(260)]
    df = spark.createDataFrame([("A", i, float(c), i % 50 + 1) for i, c in enumerate(closes)], "ticker string, ts long, close double, volume long")
    r = indicators.indicators(df).first()
    assert r.sma_200 == pytest.approx(sum(closes[-200:]) / 200, abs=1e-5)
    assert r.rsi_14 == pytest.approx(wilder(closes), abs=1e-5)
    line = [a - b for a, b in zip(mean_of(closes, 12), mean_of(closes, 26))]
    assert r.macd == pytest.approx(line[-1], abs=1e-5) and r.macd_signal == pytest.approx(mean_of(line, 9)[-1], abs=1e-5)
    short = indicators.indicators(df.where("ts < 60")).first()
    assert short.sma_200 is None and short.sma_50 is not None


def test_source_with_enough_bars_wins(spark):
    bars = lambda t, n: spark.createDataFrame([(t, i) for i in range(n)], "ticker string, ts long")
    got = indicators.prefer([bars("A", 40).union(bars("B", 215)), bars("A", 215).union(bars("B", 300)).union(bars("C", 3))])
    assert {r.ticker: r["count"] for r in got.groupBy("ticker").count().collect()} == {"A": 215, "B": 215}


def seconds(day, hour=0, minute=0):
    from datetime import UTC, datetime

    return int(datetime(*map(int, day.split("-")), hour, minute, tzinfo=UTC).timestamp())


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Pacific/Auckland"])
def test_news_window_is_utc_whatever_the_session(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [(0, "a", seconds("2025-03-10")), (1, "b", seconds("2025-03-15", 23, 30)), (2, "c", seconds("2025-03-16", 0, 1)), (3, "d", seconds("2025-06-01")), (4, "e", seconds("2025-02-20")), (5, "f", 0), (6, "g", None), (7, " A ", seconds("2025-03-10", 5)), (8, "a", seconds("2025-03-11")), (9, "", seconds("2025-03-11"))]
        df = spark.createDataFrame(rows, "ordinal int, headline string, datetime long")
        found = news.classified(df, date(2025, 3, 15), date(2025, 3, 1))
        r = news.counters(found).first()
        assert (r.kept, r.dropped_window, r.dropped_missing, r.deduped, r.truncated) == (3, 3, 2, 1, False)
        assert [x.ordinal for x in news.newest(found).collect()] == [1, 8, 0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_answers_are_joined_or_reported(spark):
    items = spark.createDataFrame([(i,) for i in range(4)], "position int")
    out = spark.createDataFrame([(0, "0", "positive", "primary"), (1, "[1]", "bullish", None), (2, "1", "negative", "primary"), (3, "true", "x", "x"), (4, "1.7", "x", "x"), (5, "99", "neutral", "primary"), (6, "2.0", "Negative", "unrelated")], "seq int, index string, sentiment string, relevance string")
    got = {r.position: (r.sentiment, r.relevance, r.unanswered) for r in news.joined(items, out).collect()}
    assert got == {0: ("positive", "primary", False), 1: ("neutral", "mentioned", False), 2: ("negative", "unrelated", False), 3: ("neutral", "mentioned", True)}
    issues = {r["issue"] for r in news.answer_issues(items, out).collect()}
    assert issues == {"unreadable", "out of range", "duplicate", "missing", "bad sentiment", "bad relevance"}


def test_sentiment_counts_primary_only(spark):
    df = spark.createDataFrame([("positive", "primary")] * 3 + [("negative", "primary"), ("neutral", "primary")] + [("negative", "mentioned")] * 4, "sentiment string, relevance string")
    r = news.sentiment(df).first()
    assert (r.positive, r.negative, r.neutral, r.net, r.excluded) == (3, 1, 1, 0.4, 4)
    assert news.sentiment(df.limit(0)).first().net == 0.0
    with pytest.raises(ValueError):
        news.within_budget(0.21)
