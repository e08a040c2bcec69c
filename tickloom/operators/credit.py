"""Credit-default-swap legs on a zero curve: spread from price and price from spread.

Curves interpolate zero rates linearly and stay flat outside their nodes. Legs are quarterly, with a constant
hazard rate; the rate is found by Newton's steps within known bounds. Work runs on Arrow batches, each distinct
set of terms in a batch once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_rate(nodes: np.ndarray, years: np.ndarray) -> np.ndarray:
    """Linear between nodes (years, rate), flat beyond."""
    return np.interp(years, nodes[:, 0], nodes[:, 1])


def discount(nodes: np.ndarray, years: np.ndarray) -> np.ndarray:
    return np.exp(-zero_rate(nodes, years) * years)


#: Rows that are solved together, so that their quarters fit a processor's cache.
ROWS = 4096


def _quarters(maturity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and starts of the quarters of each maturity; a quarter behind the maturity has no length."""
    steps = int(np.ceil(maturity.max() * 4)) if len(maturity) else 0
    t = np.minimum(np.arange(1, steps + 1)[None, :] / 4, maturity[:, None])
    return t, np.concatenate([np.zeros((len(maturity), 1)), t[:, :-1]], 1)


def _legs_on(maturity: np.ndarray, nodes: np.ndarray, recovery: float):
    """legs() and their slopes as a function of the hazard rate: the curve is looked up once for all rates."""
    t, before = _quarters(maturity)
    length, middle = t - before, discount(nodes, (t + before) / 2)
    every = (t, before, length, middle, length * discount(nodes, t))

    def at(hazard: np.ndarray, rows=slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        t, before, length, middle, paid = (x[rows] for x in every)
        alive = np.exp(-hazard[:, None] * t)
        alive_before = np.concatenate([np.ones((len(t), 1)), alive[:, :-1]], 1)
        died, died_slope = middle * (alive_before - alive), middle * (t * alive - before * alive_before)
        premium = (paid * alive + length / 2 * died).sum(1)
        premium_slope = (length / 2 * died_slope - paid * t * alive).sum(1)
        return premium, (1 - recovery) * died.sum(1), premium_slope, (1 - recovery) * died_slope.sum(1)

    return at


def legs(hazard: np.ndarray, maturity: np.ndarray, nodes: np.ndarray, recovery: float = 0.4) -> tuple[np.ndarray, np.ndarray]:
    """Value of one unit of premium a year, and of the protection, for each hazard rate and maturity."""
    return _legs_on(maturity, nodes, recovery)(hazard)[:2]


def _root(value, n: int, low: float, high: float, halve: np.ndarray | None = None, steps: int = 120) -> np.ndarray:
    """Where value(x, rows) -> (distance, slope) is 0, by Newton's steps; one that leaves what is known to hold the root halves it.

    A row without a change of sign ends at the bound whose distance is nearer to 0. Rows of `halve` only halve. Only
    rows that still move are evaluated.
    """
    every = np.arange(n)
    side, other = (value(np.full(n, x), every)[0] for x in (low, high))
    out = np.where(np.abs(side) <= np.abs(other), low, high).astype(float)
    rows = every[np.sign(side) * np.sign(other) < 0]
    a, b, x, side = np.full(len(rows), low), np.full(len(rows), high), np.full(len(rows), low), np.sign(side[rows])
    for _ in range(steps):
        if not len(rows):
            break
        distance, slope = value(x, rows)
        below = np.sign(distance) == side
        a, b = np.where(below, x, a), np.where(below, b, x)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            to = x - distance / slope
        near = np.abs(to - x) <= 1e-13 * np.abs(x) + 1e-18  # a Newton step this small ends at the precision of the distance
        inside = (to > a) & (to < b) | near
        if halve is not None:
            inside &= ~halve[rows]
        to = np.where(distance == 0, x, np.where(inside, to, (a + b) / 2))
        out[rows] = to
        move = ~((distance == 0) | inside & near | (b - a <= 4e-16 * np.abs(to)))
        rows, a, b, x, side = rows[move], a[move], b[move], to[move], side[move]
    return out


def spread_from_price(price: np.ndarray, coupon: np.ndarray, maturity: np.ndarray, nodes: np.ndarray, recovery: float = 0.4) -> np.ndarray:
    """Par spread in basis points of a contract quoted at a price of 100 (M4)."""
    at = _legs_on(maturity, nodes, recovery)

    def upfront(h, rows):
        premium, protection, premium_slope, protection_slope = at(h, rows)
        return protection - coupon[rows] * premium - (100 - price[rows]) / 100, protection_slope - coupon[rows] * premium_slope

    premium, protection, _, _ = at(_root(upfront, len(price), 0.0, 20.0))
    return protection / premium * 1e4


def price_from_spread(spread_bp: np.ndarray, coupon: np.ndarray, maturity: np.ndarray, nodes: np.ndarray, recovery: float = 0.4) -> np.ndarray:
    at = _legs_on(maturity, nodes, recovery)

    def par(h, rows):
        premium, protection, premium_slope, protection_slope = at(h, rows)
        return protection / premium - spread_bp[rows] / 1e4, (protection_slope - protection / premium * premium_slope) / premium

    premium, protection, _, _ = at(_root(par, len(spread_bp), 0.0, 20.0))
    return 100 - (protection - coupon * premium) * 100


def by_terms(frame: pd.DataFrame, solve, n: int) -> list[np.ndarray]:
    """The `n` results of solve(columns of frame ..) for each row: rows of equal terms are solved once, ROWS at a time."""
    which = frame.groupby(list(frame.columns), sort=False, dropna=False).ngroup().to_numpy()
    terms = frame[~frame.duplicated().to_numpy()]  # in the order that ngroup counts them
    parts = [solve(*(terms[c].to_numpy(float)[i : i + ROWS] for c in terms)) for i in range(0, len(terms), ROWS)]
    return [np.concatenate([p[k] for p in parts])[which] for k in range(n)]


def add_spreads(quotes: DataFrame, nodes: np.ndarray) -> DataFrame:
    """`quotes` (price, coupon, years) with spread_bp, and residual: price from that spread less the price (M7).

    Rows with a missing or impossible value have null results.
    """

    def both(price: np.ndarray, coupon: np.ndarray, years: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spread = spread_from_price(price, coupon, years, nodes)
        return spread, price_from_spread(spread, coupon, years, nodes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            price, coupon, years = (pdf[c].to_numpy(float) for c in ("price", "coupon", "years"))
            ok = np.isfinite(price) & np.isfinite(coupon) & (years > 0) & (price > 0)
            spread = np.full(len(pdf), np.nan)
            back = spread.copy()
            if ok.any():
                spread[ok], back[ok] = by_terms(pd.DataFrame({"price": price[ok], "coupon": coupon[ok], "years": years[ok]}), both, 2)
            yield pdf.assign(spread_bp=spread, residual=back - price)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in quotes.schema)
    return quotes.mapInPandas(run, f"{fields}, spread_bp double, residual double")


def _trade_on(years: np.ndarray, rate: float, recovery: float):
    """trade_values() and their slopes as a function of the hazard rate."""
    t, before = _quarters(years)
    df = np.exp(-rate * t)
    every = (t, before, (t - before) * df, df * (1 - recovery))

    def at(hazard: np.ndarray, rows=slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        t, before, paid, lost = (x[rows] for x in every)
        alive = np.exp(-hazard[:, None] * t)
        alive_before = np.concatenate([np.ones((len(t), 1)), alive[:, :-1]], 1)
        return (paid * alive).sum(1), ((alive_before - alive) * lost).sum(1), -(paid * t * alive).sum(1), ((t * alive - before * alive_before) * lost).sum(1)

    return at


def trade_values(hazard: np.ndarray, years: np.ndarray, rate: float = 0.04, recovery: float = 0.4) -> tuple[np.ndarray, np.ndarray]:
    """Annuity and protection of a trade at a flat rate, both discounted from the end of each quarter."""
    return _trade_on(years, rate, recovery)(hazard)[:2]


def implied_spread(coupon_bp: np.ndarray, upfront: np.ndarray, years: np.ndarray, reference_bp: np.ndarray, rate: float = 0.04, recovery: float = 0.4) -> np.ndarray:
    """Par spread in basis points that a trade's upfront share implies (M5).

    A report doesn't say who paid: both signs are solved, for hazards from 0.000001 to 5, and the
    spread nearest to the reference is taken, without a reference the first that has a solution.
    """
    at, found = _trade_on(years, rate, recovery), []
    for sign in (-1, 1):

        def gap(h, rows):
            annuity, protection, annuity_slope, protection_slope = at(h, rows)
            return protection - coupon_bp[rows] / 1e4 * annuity - sign * upfront[rows], protection_slope - coupon_bp[rows] / 1e4 * annuity_slope

        every = np.arange(len(years))
        solved = np.sign(gap(np.full(len(years), 1e-6), every)[0]) != np.sign(gap(np.full(len(years), 5.0), every)[0])
        # with a coupon below 0 a gap may turn, so that only halving leads to one root
        annuity, protection, _, _ = at(_root(gap, len(years), 1e-6, 5.0, halve=coupon_bp < 0))
        spread = protection / annuity * 1e4
        found.append(np.where(solved & (spread >= 0), spread, np.nan))
    first, second = found
    nearer = np.abs(second - reference_bp) < np.abs(first - reference_bp)
    return np.where(np.isnan(first) | nearer & ~np.isnan(second), second, first)


def add_implied(trades: DataFrame, rate: float = 0.04) -> DataFrame:
    """`trades` (coupon_bp, upfront, years, reference_bp) with implied_bp; null where the trade has no solution or lacks a figure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            coupon, upfront, years, reference = (pdf[c].to_numpy(float) for c in ("coupon_bp", "upfront", "years", "reference_bp"))
            ok = np.isfinite(coupon) & np.isfinite(upfront) & (years > 0)
            out = np.full(len(pdf), np.nan)
            if ok.any():
                terms = pd.DataFrame({"coupon": coupon[ok], "upfront": upfront[ok], "years": years[ok], "reference": reference[ok]})
                out[ok] = by_terms(terms, lambda *term: (implied_spread(*term, rate),), 1)[0]
            yield pdf.assign(implied_bp=out)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in trades.schema)
    return trades.mapInPandas(run, f"{fields}, implied_bp double")


#: The most that a price may be missed by, and an official spread by its share and in basis points.
PRICE_TOLERANCE, SHARE_TOLERANCE, MOST_BP = 0.005, 0.01, 2.0


def quality(residual: Column, spread_bp: Column, official_bp: Column) -> Column:
    """struct<status, publishable, relative_error> of a spread by its price residual and the official one, if any (M7)."""
    apart = F.abs(spread_bp - official_bp)
    share = F.try_divide(apart, official_bp)
    near = F.coalesce((share <= SHARE_TOLERANCE) & (apart <= F.least(F.lit(MOST_BP), official_bp * SHARE_TOLERANCE)), F.lit(False))
    status = F.when(residual > PRICE_TOLERANCE, "needs-review").when(official_bp.isNull(), "model-derived").when(near, "validated").otherwise("needs-review")
    return F.struct(status.alias("status"), status.isin("model-derived", "validated").alias("publishable"), F.when(official_bp > 0, share).alias("relative_error"))
