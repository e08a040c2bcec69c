import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import backtest, credit
from tickloom.plans.dashboard import CURVE


def test_price_100_gives_the_coupon():
    c, y = np.array([0.01]), np.array([5.0])
    assert credit.spread_from_price(np.array([100.0]), c, y, CURVE)[0] == pytest.approx(100, abs=0.01)
    assert credit.spread_from_price(np.array([98.5]), c, y, CURVE)[0] > 100
    assert credit.spread_from_price(np.array([100.5]), c, y, CURVE)[0] < 100
    price = credit.price_from_spread(np.array([207.0]), c, y, CURVE)
    assert credit.spread_from_price(price, c, y, CURVE)[0] == pytest.approx(207, abs=0.01)


def test_curve_is_flat_outside():
    assert credit.zero_rate(CURVE, np.array([0.0, 0.25, 2.0, 50.0])).tolist() == pytest.approx([0.041, 0.041, 0.038, 0.038])


def test_spreads_of_odd_rows(spark):
    df = spark.createDataFrame([(1, 100.0, 0.01, 5.0), (2, None, 0.01, 5.0), (3, 100.0, 0.01, 0.0)], "id int, price double, coupon double, years double")
    out = {r["id"]: r["spread_bp"] for r in credit.add_spreads(df, CURVE).collect()}
    assert out[1] == pytest.approx(100, abs=0.01) and out[2] is None and out[3] is None


def frame(rows):
    return pd.DataFrame(rows, columns=["code", "date", "open", "close", "buy", "sell", "score"])


def test_buys_next_open_and_stops():
    d = [dt.date(2020, 1, i) for i in range(1, 6)]
    rows = [("a", d[0], 10, 10, True, False, 80.0), ("a", d[1], 10, 10, False, False, 0.0), ("a", d[2], 8, 8, False, False, 0.0), ("a", d[3], 7, 7, False, False, 0.0), ("a", d[4], 7, 7, False, False, 0.0)]
    out = backtest.simulate(frame(rows), backtest.Rules(cost=0.0, stop_loss=0.1, cash=1000.0))
    assert out["equity"].tolist() == [1000.0, 1000.0, 800.0, 700.0, 700.0]
    assert out["positions"].tolist() == [0, 1, 1, 0, 0]


def test_slots_go_to_the_best():
    d = [dt.date(2020, 1, i) for i in range(1, 4)]
    rows = [(c, day, 10, 10, day == d[0], False, s) for day in d for c, s in (("a", 60.0), ("b", 70.0), ("c", 70.0))]
    out = backtest.simulate(frame(rows), backtest.Rules(max_positions=1, cost=0.001, cash=1000.0))
    assert out["opened"].tolist() == [0, 1, 0] and out["equity"].iloc[-1] == pytest.approx(1000 / 1.001)
    assert backtest.gate(backtest.metrics(out)) == ["sharpe", "calmar"]


def test_metrics():
    m = backtest.metrics(pd.DataFrame({"equity": [100.0, 110.0, 99.0, 120.0]}))
    assert m["max_drawdown"] == pytest.approx(0.1)
    assert backtest.metrics(pd.DataFrame({"equity": []}))["sharpe"] == 0.0


def slow_spread(coupon_bp, upfront, years, sign, rate=0.04):
    """One trade, one sign, in plain loops."""

    def at(h):
        annuity = protection = before = 0.0
        while before < years:
            now = min(before + 0.25, years)
            df = np.exp(-rate * now)
            annuity += (now - before) * df * np.exp(-h * now)
            protection += (np.exp(-h * before) - np.exp(-h * now)) * df * 0.6
            before += 0.25
        return protection - coupon_bp / 1e4 * annuity - sign * upfront, protection / annuity * 1e4

    low, high = 1e-6, 5.0
    side = np.sign(at(low)[0])
    if side == np.sign(at(high)[0]):
        return None
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if np.sign(at(mid)[0]) == side else (low, mid)
    return at((low + high) / 2)[1]


def test_implied_spreads_equal_loops(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(c), float(u), float(y), None if i % 5 == 0 else float(r)) for i, (c, u, y, r) in enumerate(zip(rng.choice([25, 100, 500], 40), rng.uniform(0, 0.2, 40), rng.uniform(0.3, 7, 40), rng.uniform(0, 900, 40)))]
    rows += [(100, 100.0, None, 5.0, 50.0), (101, 100.0, 0.9, 1.0, 50.0), (102, 100.0, 0.01, 0.0, 50.0)]
    out = {r["id"]: r["implied_bp"] for r in credit.add_implied(spark.createDataFrame(rows, "id int, coupon_bp double, upfront double, years double, reference_bp double")).collect()}
    for i, c, u, y, r in rows[:40]:
        both = [x for x in (slow_spread(c, u, y, s) for s in (-1, 1)) if x is not None and x >= 0]
        want = None if not both else both[0] if r is None else min(both, key=lambda x: abs(x - r))
        assert out[i] == (None if want is None else pytest.approx(want, rel=1e-6))
    assert out[100] is None and out[101] is None and out[102] is None


def test_credit_spreads_equal_loops(spark, sf_dir):
    from tickloom.plans import dashboard

    rows = dashboard.credit_spreads(spark, sf_dir).orderBy("id").limit(60).collect()
    for r in rows:
        def legs(h):
            premium = protection = before = 0.0
            while before < r["years"] - 1e-12:
                now = min(before + 0.25, r["years"])
                mid = (now + before) / 2
                df, df_mid = (float(np.exp(-np.interp(x, CURVE[:, 0], CURVE[:, 1]) * x)) for x in (now, mid))
                alive, alive_before = np.exp(-h * now), np.exp(-h * before)
                premium += (now - before) * df * alive + (now - before) / 2 * df_mid * (alive_before - alive)
                protection += 0.6 * df_mid * (alive_before - alive)
                before = now
            return premium, protection

        low, high = 0.0, 20.0
        for _ in range(200):
            mid = (low + high) / 2
            premium, protection = legs(mid)
            low, high = (mid, high) if protection - r["coupon"] * premium < (100 - r["price"]) / 100 else (low, mid)
        premium, protection = legs((low + high) / 2)
        if r["spread_bp"] > 1e-3:
            assert r["spread_bp"] == pytest.approx(protection / premium * 1e4, rel=1e-6) and r["publishable"]


def test_roots_take_few_steps_and_equal_terms_one(monkeypatch):
    steps, solved, exp = [], [], np.exp
    monkeypatch.setattr(credit.np, "exp", lambda x: steps.append(x.size) or exp(x))
    rng = np.random.default_rng(8)
    terms = pd.DataFrame({"price": rng.uniform(90, 101, 50).round(1), "coupon": 0.01, "years": 5.0})
    frame = pd.concat([terms] * 40, ignore_index=True)
    spread = credit.by_terms(frame, lambda *x: solved.append(len(x[0])) or (credit.spread_from_price(*x, CURVE),), 1)[0]
    assert sum(solved) == len(terms.drop_duplicates()) and sum(steps) < 20 * 20 * 50
    assert spread.tolist() == credit.spread_from_price(*(frame[c].to_numpy() for c in frame), CURVE).tolist()


def test_roots_beyond_the_bounds_end_there():
    one = lambda *x: credit.spread_from_price(*(np.array([v]) for v in x), CURVE)[0]
    assert one(150.0, 0.01, 5.0) == 0.0 and one(1.0, 0.01, 5.0) == pytest.approx(one(1e-9, 0.01, 5.0)) and np.isfinite(one(1e-9, 0.01, 5.0))
    # with a coupon below 0 as with others: the same as by halving
    got = credit.implied_spread(np.array([-100.0, 100.0]), np.array([-0.0316, 0.02]), np.array([3.39, 5.0]), np.array([np.nan, np.nan]))
    for g, c, u, y in zip(got, (-100.0, 100.0), (-0.0316, 0.02), (3.39, 5.0)):
        both = [slow_spread(c, u, y, s) for s in (-1, 1)]
        assert g == pytest.approx(next(x for x in both if x is not None and x >= 0), rel=1e-9)
