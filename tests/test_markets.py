"""Moving ranks, fair selection, costs, bars, aliases, disclosures and gates against plain loops."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.operators import aliases, bars, costs, credit, disclosures, moving, ranking, validate

DAY = dt.date(2024, 1, 1)


@pytest.mark.parametrize("slice_rows", [moving.SLICE_ROWS, 20])
def test_ranks_in_days(spark, slice_rows):
    rng = random.Random(3)
    rows = [(rng.choice("aaaab"), rng.choice([1.0, 2.5, 7.25, float(rng.randint(0, 300))]), DAY + dt.timedelta(rng.randint(0, 90)), rng.random() < 0.7, "x") for _ in range(600)]
    rows += [("c", 5.0, DAY, False, "x"), (None, 1.0, DAY, True, "x"), ("a", None, DAY, True, "x"), ("a", 1.0, None, True, "x"), ("d", 4.0, DAY, None, "x")]
    frame = spark.createDataFrame(rows, "key string, value double, day date, sample boolean, n string")
    got = {(r.key, r.value, r.day): (r.n, r.at_most) for r in moving.ranks_in_days(frame, "key", "value", "day", "sample", 30, slice_rows).collect()}
    ok = [r for r in rows if None not in r[:3]]
    want = {}
    for k, v, d, *_ in ok:
        seen = [r[1] for r in ok if r[0] == k and r[3] and 0 <= (d - r[2]).days < 30]
        want[k, v, d] = (len(seen), sum(x <= v for x in seen))
    assert got == want and want["c", 5.0, DAY] == (0, 0)
    assert moving.ranks_in_days(frame.limit(0), "key", "value", "day", "sample", 30).count() == 0


def plain_fair(rows, quota):
    """Queues' heads one by one, the best first."""
    queues = defaultdict(list)
    for r in sorted(rows, key=lambda r: (-r["value"], r["id"])):
        queues[r["queue"]].append(r)
    weight, taken, final = {q: v[0]["weight"] for q, v in queues.items()}, Counter(), []
    while True:
        open_queues = [q for q in sorted(queues) if queues[q] and taken[q] < quota]
        if not open_queues:
            break
        best = max(open_queues, key=lambda q: queues[q][0]["value"])
        row = queues[best].pop(0)
        alike = [i for i, x in enumerate(final) if (x["url"] or "") == (row["url"] or "") or (x["title"] or "") == (row["title"] or "")]
        if alike:
            if weight[best] > final[alike[0]]["weight"]:
                final[alike[0]] = row
                taken[best] += 1
            continue
        final.append(row)
        taken[best] += 1
    return {x["id"] for x in final}


@pytest.mark.parametrize("seed", range(4))
def test_priority_fair_selection(spark, seed):
    rng = random.Random(seed)
    rows = [{"id": i, "queue": rng.randint(0, 9), "value": float(rng.randint(0, 30)), "weight": rng.choice([500, 700, 1000]), "url": rng.choice([None, "", *map(str, range(12))]), "title": rng.choice([None, *map(str, range(20))])} for i in range(150)]
    frame = spark.createDataFrame([(r["id"], r["queue"], r["value"], r["weight"], r["url"], r["title"], "x") for r in rows], "id long, queue int, value double, weight int, url string, title string, open string")
    out = ranking.priority_fair(frame, "queue", "value", "id", "weight", "url", "title", 2, first=3).collect()
    assert {r.id for r in out} == plain_fair(rows, 2)
    assert [r.id for r in sorted(out, key=lambda r: r.place)] == [r.id for r in sorted(out, key=lambda r: (-r.value, r.queue, r.id))]
    assert ranking.priority_fair(frame.limit(0), "queue", "value", "id", "weight", "url", "title", 2).count() == 0



def test_priority_fair_goes_over_ranges(spark, monkeypatch):
    read = []
    went = ranking._fair_range
    monkeypatch.setattr(ranking, "_fair_range", lambda *a: read.append(a) or went(*a))
    monkeypatch.setattr(ranking, "RANGE_ROWS", 15)
    rng = random.Random(8)
    rows = [{"id": i, "queue": rng.randint(0, 40), "value": float(rng.randint(0, 30)), "weight": rng.choice([500, 700, 1000]), "url": rng.choice([None, "", *map(str, range(30))]), "title": rng.choice([None, *map(str, range(40))])} for i in range(300)]
    frame = spark.createDataFrame([(r["id"], r["queue"], r["value"], r["weight"], r["url"], r["title"]) for r in rows], "id long, queue int, value double, weight int, url string, title string")
    out = ranking.priority_fair(frame, "queue", "value", "id", "weight", "url", "title", 2, first=3).collect()
    assert {r.id for r in out} == plain_fair(rows, 2) and len(read) == 7

def test_costs_take_the_tiers_that_runs_state(spark):
    day = lambda n: DAY + dt.timedelta(n)
    price = "seq long, model string, context_tier string, service_tier string, as_of date, input_rate double, cached_rate double, output_rate double, currency string, unit string"
    m = "per_million_tokens"
    prices = [(1, "m", None, None, day(0), 1.0, 0.5, 2.0, "usd", m), (2, "m", "long", None, day(5), 3.0, 1.0, 4.0, "USD", m), (3, "m", None, "priority", day(7), 9.0, 1.0, 4.0, "USD", m), (4, "m", None, None, day(9), 7.0, 1.0, 4.0, "USD", "per_image"), (5, "bad", None, None, day(0), 1.0, 1.0, 1.0, "dollars", m), (6, "neg", None, None, day(0), -1.0, 1.0, 1.0, "USD", m)]
    run = "run int, model string, context_tier string, service_tier string, run_day date, input_tokens long, cached_tokens long, output_tokens long"
    runs = [(1, "m", None, None, day(20), 1000, 0, 10), (2, "m", "standard", "standard", day(20), 1000, 0, 10), (3, "m", "long", None, day(4), 1, 1, 1), (4, "m", "long", "", day(5), 1, 1, 1), (5, "m", None, None, day(20), None, 1, 1), (6, "m", None, None, day(20), -1, 1, 1), (7, "bad", None, None, day(20), 1, 1, 1), (8, "neg", None, None, day(20), 1, 1, 1), (9, None, None, None, day(20), 1, 1, 1)]
    got = {r.run: (r.status, r.price_as_of, r.total_cost) for r in costs.attach(spark.createDataFrame(runs, run), spark.createDataFrame(prices, price)).collect()}
    assert got[1] == ("ready", day(7), round(0.009 + 0.00004, 12)) and got[2] == ("ready", day(0), round(0.001 + 0.00002, 12))
    assert got[3] == ("price_unavailable", None, None) and got[4][:2] == ("ready", day(5))
    assert [got[i][0] for i in (5, 6, 7, 8, 9)] == ["tokens_unavailable", "tokens_unavailable", "price_unavailable", "price_unavailable", "price_unavailable"] and len(got) == 9


def test_bars_stay_within_sessions(spark):
    at = lambda h, m, s=0, d=2: dt.datetime(2024, 1, d, h, m, s)
    rows = [(1, "a", at(9, 29), 9.0), (2, "a", at(9, 30), 1.0), (3, "a", at(9, 44, 59), 3.0), (4, "a", at(9, 44, 59), 2.0), (5, "a", at(10, 15), 4.0), (6, "a", at(11, 29), 5.0), (7, "a", at(11, 30), 8.0), (8, "a", at(13, 20), 6.0), (9, "a", at(14, 59), 7.0), (10, "a", at(15, 0), 9.0), (11, None, None, 1.0)]
    got = sorted((r.slot, r.open, r.high, r.low, r.close, r.n, r.missing) for r in bars.session_bars(spark.createDataFrame(rows, "id int, code string, at timestamp, price double"), 15).collect())
    assert got == [(at(9, 30), 1.0, 3.0, 1.0, 2.0, 3, 0), (at(10, 15), 4.0, 4.0, 4.0, 4.0, 1, 2), (at(11, 15), 5.0, 5.0, 5.0, 5.0, 1, 3), (at(13, 15), 6.0, 6.0, 6.0, 6.0, 1, 1), (at(14, 45), 7.0, 7.0, 7.0, 7.0, 1, 5)]


def test_one_candle_of_each_time(spark):
    at = lambda h, m, d=2: dt.datetime(2024, 1, d, h, m)
    rows = [("a", at(9, 30), 5, 1.0), ("a", at(9, 30), 15, 2.0), ("a", at(9, 35), 5, 3.0), ("a", at(14, 30), 5, 4.0), ("a", at(14, 30), 15, 5.0), ("a", at(14, 45), 15, 6.0), ("a", at(14, 45), 5, 7.0), ("a", at(14, 45, 1), 5, 9.0), ("b", at(9, 30, 1), 5, 8.0)]
    got = sorted((r.code, r.slot, r.close) for r in bars.one_of_each_time(spark.createDataFrame(rows, "code string, slot timestamp, period int, close double")).collect())
    assert got == [("a", at(9, 30), 2.0), ("a", at(9, 35), 3.0), ("a", at(14, 30), 5.0), ("a", at(14, 45), 7.0), ("b", at(9, 30, 1), 8.0)]


def test_aliases(spark):
    chain = [(f"S{i}", f"S{i + 1}") for i in range(20)] + [("X", "Y"), ("X", "W"), ("Q", "Q"), (None, "S1")]
    got = {r.alias: r.canonical for r in aliases.closed(spark.createDataFrame(chain, "alias string, canonical string")).collect()}
    assert got == {**{f"S{i}": "S20" for i in range(20)}, "X": "W"}
    for circle in ([("A", "B"), ("B", "A")], [("A", "B"), ("B", "C"), ("C", "A"), ("D", "A")]):
        with pytest.raises(ValueError):
            aliases.closed(spark.createDataFrame(circle, "alias string, canonical string"))
    forms = spark.createDataFrame([(" $brk-b",), ("us:goog",), ("BF.B",), ("A-BC",), (None,)], "s string")
    assert [r[0] for r in forms.select(aliases.us_symbol(F.col("s"))).collect()] == ["BRK.B", "GOOG", "BF.B", "A-BC", None]
    names = spark.createDataFrame([(["中国", "阿尔法", "美股", "b", "A"],)], "n array<string>")
    assert names.select(aliases.in_order(F.col("n"), "zh").alias("n")).first()["n"] == ["阿尔法", "美股", "中国", "A", "b"] or names.select(aliases.in_order(F.col("n"), "zh").alias("n")).first()["n"] == ["A", "b", "阿尔法", "美股", "中国"]


def test_disclosures(spark):
    schema = "model string, seq int, value double, complete boolean, run struct<agent: string, harness: string>, url string"
    rows = [("m", 1, 5.0, False, ("A", None), "u1"), ("m", 2, 5.0, False, ("A", None), "u2"), ("m", 3, 4.0, True, ("Z z", "h"), "u3"), ("m", 4, 9.0, None, (None, None), "u4"), ("one", 5, 1.0, None, None, "u5"), ("one", 6, 1.0, None, None, "u6"), ("two", 7, 1.0, True, ("a", "b"), "x"), ("two", 8, 3.0, True, ("a", "b"), "y")]
    frame = spark.createDataFrame(rows, schema)
    got = {r.model: (r.n, r.ambiguous, r.value, r.run_key, r.url) for r in disclosures.merged(frame, ["model"], "value", "complete", "run", "seq", ["url"]).collect()}
    assert got == {"m": (3, True, 4.0, "z-z:h", "u3"), "one": (1, False, 1.0, "none:none", "u6"), "two": (2, True, 3.0, "a:b", "y")}
    low = disclosures.merged(frame, ["model"], "value", "complete", "run", "seq", ["url"], lower=True).where("model = 'two'").first()
    assert low["value"] == 1.0


def test_balanced(spark):
    rng = random.Random(1)

    def plain(pos, neg):
        if not neg:
            return pos[:5]
        n = min(2, len(neg))
        p = min(3 + 2 - n, len(pos), 5 - n)
        out = pos[:p] + neg[:n]
        out += pos[p : p + 5 - len(out)]
        return (out + neg[n : n + 5 - len(out)])[:5]

    rows = [(k, i, s) for k in range(30) for i, s in enumerate([True] * rng.choice([0, 1, 2, 3, 4, 8]) + [False] * rng.choice([0, 1, 2, 3, 9]))]
    got = defaultdict(set)
    for r in ranking.balanced(spark.createDataFrame(rows, "k int, i int, s boolean"), "k", "s", [F.col("i")], 3, 2, 5).collect():
        got[r.k].add(r.i)
    for k in {r[0] for r in rows}:
        assert got[k] == set(plain([i for a, i, s in rows if a == k and s], [i for a, i, s in rows if a == k and not s]))


def test_gates(spark):
    snap = spark.createDataFrame([(95, 90, [100, 90]), (50, 90, [None, 90]), (95, 80, [0, None]), (95, 80, [100, 100])], "n int, v int, beside array<int>")
    got = [tuple(r.g.failures) for r in snap.select(validate.snapshot_gate(F.col("n"), F.col("v"), F.lit(100), F.col("beside"), F.lit(95)).alias("g")).collect()]
    assert got == [(), ("rows", "coverage"), ("no neighbours",), ("neighbours",)]
    codes = lambda day, *listed: [(day, day, c) for c in listed]
    rows = codes(1, "600000.SH", "000001.SZ") + codes(2, "600000.SH", "900901.SH") + codes(3, "600000.SH", "600000.SH") + codes(4, "600000.SH") + [(5, 4, "600000.SH")] + codes(6, "600000.SH", None) + codes(7, "300001.SZ")
    expected = spark.createDataFrame([(4, 2), (7, 1)], "asked int, n_expected long")
    got = {r.asked: r.failure for r in validate.delivery_gate(spark.createDataFrame(rows, "asked int, date int, code string"), "asked", "date", "code", expected, least=2).collect()}
    assert got == {1: None, 2: "code", 3: "unique", 4: "rows", 5: "date", 6: "code", 7: None}


def test_credit_quality(spark):
    rows = spark.createDataFrame([(0.006, 100.0, 100.0), (0.001, 100.0, None), (0.001, 100.5, 100.0), (0.001, 102.0, 100.0), (0.001, 502.5, 500.0), (0.001, 1.0, 0.0)], "r double, s double, o double")
    got = [(r.q.status, r.q.publishable) for r in rows.select(credit.quality(F.col("r"), F.col("s"), F.col("o")).alias("q")).collect()]
    assert got == [("needs-review", False), ("model-derived", True), ("validated", True), ("needs-review", False), ("needs-review", False), ("needs-review", False)]


def test_counts_of_deliveries_meet_without_a_join_or_distinct_codes(spark, sf_dir):
    from tickloom.plans import bulk

    plan = bulk.cross_section_counts(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan.lower() and "LeftOuter" not in plan and "Expand" not in plan


def test_runs_and_prices_move_once(spark, sf_dir):
    from tickloom.plans import dashboard

    plan = dashboard.costed_runs(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
