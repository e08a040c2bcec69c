import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.operators import merging, ranking, windows

DAY = dt.date(2020, 1, 1)


def series(spark, values, name="hist"):
    return spark.createDataFrame([("a", DAY + dt.timedelta(i), v) for i, v in enumerate(values)], f"code string, date date, {name} double")


def last(df, column):
    return df.withColumn("x", column).orderBy(F.col("date").desc()).first()["x"]


@pytest.mark.parametrize("values, expected", [([0.6, 0.4, 0.2, 0.3, 0.5, 0.7], True), ([0.6, 0.4, -0.2, 0.3, 0.5, 0.7], False), ([0.6, 0.4, None, 0.3, 0.5, 0.7], False), ([0.3, 0.5, 0.7], False)])
def test_red_expansion(spark, values, expected):
    assert last(series(spark, values), windows.red_turn(F.col("hist"), 3, 3, windows.by(["code"]))) is expected


def test_green_decay_needs_a_crossing(spark):
    w = windows.by(["code"])
    assert last(series(spark, [0.2, -0.5, -0.4, -0.3, -0.2]), windows.green_trend(F.col("hist"), 4, 5, w)) is True
    assert last(series(spark, [-0.6, -0.5, -0.4, -0.3, -0.2]), windows.green_trend(F.col("hist"), 4, 5, w)) is False


@pytest.mark.parametrize("kind, close, fast, slow, expected", [("and", 8.0, 11.0, 10.0, False), ("fast_gt_slow", 8.0, 11.0, 10.0, True), ("or", 8.0, 9.0, 10.0, False), ("none", None, None, None, True), ("close_gt_ma", None, 1.0, 1.0, False)])
def test_trend(spark, kind, close, fast, slow, expected):
    df = spark.createDataFrame([(close, fast, slow)], "close double, fast double, slow double")
    assert df.select(windows.trend_mask(kind, F.col("close"), F.col("fast"), F.col("slow")).alias("x")).first()["x"] is expected


def test_sma_and_ratio(spark):
    w = windows.by(["code"])
    df = series(spark, [100.0, 110.0, 90.0, 105.0, 95.0, 150.0], "v")
    assert last(df, windows.volume_ratio(F.col("v"), 5, w)) == pytest.approx(1.5)
    assert [r["x"] for r in df.withColumn("x", windows.sma("v", 3, w)).orderBy("date").collect()][:3] == [None, None, 100.0]
    closes = series(spark, [14.0, 15.0], "c")
    assert last(closes, windows.pct_change(F.col("c"), F.lag("c").over(w))) == pytest.approx(7.142857, abs=1e-6)
    assert last(series(spark, [0.0, 15.0], "c"), windows.pct_change(F.col("c"), F.lag("c").over(w))) is None


def test_macd_is_the_recursion(spark):
    values = [10 + (i * 7 % 11) / 3 for i in range(60)]
    rows = windows.macd(series(spark, values, "close")).orderBy("date").collect()
    e12 = e26 = values[0]
    dea = 0.0
    for v, r in zip(values, rows):
        e12, e26 = v * 2 / 13 + e12 * 11 / 13, v * 2 / 27 + e26 * 25 / 27
        dea = (e12 - e26) * 0.2 + dea * 0.8
        assert r["dif"] == pytest.approx(e12 - e26, abs=1e-9) and r["dea"] == pytest.approx(dea, abs=1e-9) and r["hist"] == pytest.approx(e12 - e26 - dea, abs=1e-9)


def test_concentration_and_warning(spark):
    df = spark.createDataFrame([("d", i, 100 - i) for i in range(40)] + [("d", 99, None), ("d", 98, 0)], "date string, code int, amount int")
    r = ranking.concentration(df, "date", "code", "amount").first()
    assert (r["n_codes"], r["top1_count"], r["top3_count"], r["top5_count"]) == (40, 1, 2, 2) and r["top3_amount"] == 199
    out = spark.createDataFrame([(98.0,), (97.9,), (90.0,), (1.0,)], "p double").select(ranking.warning(F.col("p"), F.lit(0.0)).alias("w")).collect()
    assert [x["w"] for x in out] == ["danger", "warning", "warm", "normal"]


def test_percentile_keeps_nulls(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "v double")
    out = df.select("v", windows.percentile_rank(F.col("v"), Window.partitionBy().orderBy("v")).alias("p")).collect()
    assert sorted((r["v"] or -1, r["p"]) for r in out) == [(-1, None), (1.0, pytest.approx(100 / 3)), (2.0, 100.0), (2.0, 100.0)]


def test_round_robin(spark):
    df = spark.createDataFrame([("a", 9), ("a", 8), ("a", 7), ("b", 1)], "q string, v int")
    out = ranking.round_robin(df, "q", [F.col("v").desc()], 3).orderBy("place").collect()
    assert [(r["q"], r["v"]) for r in out] == [("a", 9), ("b", 1), ("a", 8)]


def test_as_of(spark):
    left = spark.createDataFrame([("x", 5), ("x", 1), ("y", 5), (None, 3)], "k string, at int")
    right = spark.createDataFrame([("x", 2, 20), ("x", 5, 50), ("x", 6, 60), (None, 1, 7)], "k string, seen int, v int")
    out = {(r["k"], r["at"]): r["v"] for r in merging.as_of(left, right, ["k"], "at", "seen", ["v"]).collect()}
    assert out == {("x", 5): 50, ("x", 1): None, ("y", 5): None, (None, 3): 7}
    strict = {(r["k"], r["at"]): r["v"] for r in merging.as_of(left, right, ["k"], "at", "seen", ["v"], strict=True).collect()}
    assert strict[("x", 5)] == 20


def test_merges(spark):
    schema = "k int, v string"
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], schema), spark.createDataFrame([(2, "B"), (3, "c")], schema)
    assert sorted(map(tuple, merging.last_wins(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, merging.append_unseen(old, new.unionByName(new), ["k"], [F.col("v")]).collect())) == [(3, "c")]
    assert sorted(map(tuple, merging.replace_range(old, new, F.col("k") >= 2).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    log = merging.correction_log(old, new, ["k"], ["v"]).collect()
    assert [(r["k"], r["old_v"], r["new_v"], r["changed"]) for r in log] == [(2, "b", "B", "v")]
    days = spark.createDataFrame([(1,), (5,)], "k int")
    assert sorted((r["k"], r["is_placeholder"]) for r in merging.spine(days, old, "k").collect()) == [(1, False), (2, False), (5, True)]


def test_intervals(spark):
    d = dt.date
    rows = [(1, d(2020, 1, 1), d(2020, 1, 3)), (2, d(2020, 1, 5), None), (3, d(2020, 1, 9), d(2020, 1, 1))]
    df = spark.createDataFrame(rows, "id int, first date, last date")
    hit = merging.overlapping(df, "first", "last", F.lit(d(2020, 1, 3)), F.lit(d(2020, 1, 5)))
    assert sorted(r["id"] for r in hit.collect()) == [1, 2]
    assert sorted((r["id"], r["day"].day) for r in merging.by_day(df, "first", "last").collect()) == [(1, 1), (1, 2), (1, 3), (2, 5), (3, 9)]
