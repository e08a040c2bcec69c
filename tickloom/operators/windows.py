"""Bar-series operators: averages, recursive averages, patterns, changes, draw-downs.

All work on one row for each (key, order) and partition by the key; a series of any length is a window, and
only the recursive averages need their series in one task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(keys: Sequence[str], order: str = "date"):
    return Window.partitionBy(*keys).orderBy(order)


def sma(value: str | Column, n: int, w) -> Column:
    """Mean of the last n values; null until there are n."""
    value = F.col(value) if isinstance(value, str) else value
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))


def lags(value: Column, n: int, w) -> list[Column]:
    """The value n-1 .. 0 rows ago. `w` is a window, or a function of how many rows ago, for values that rows hold already."""
    return [ago(value, i, w) for i in range(n - 1, 0, -1)] + [value]


def ago(value: Column, i: int, w) -> Column:
    return value if i == 0 else w(i) if callable(w) else F.lag(value, i).over(w)


def gt(left: Column, right: Column, strict: bool = True) -> Column:
    """Greater; loosely, at least the right value less 3 % of its size."""
    return left > right if strict else left >= right - F.abs(right) * 0.03


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return F.coalesce(out, F.lit(False))


def red_turn(hist: Column, front: int, back: int, w, expand: bool = True, strict: bool = True) -> Column:
    """All positive, the first `front` moving one way and the last `back` the other; where the parts meet is free."""
    values = lags(hist, front + back, w)
    tests = [v > 0 for v in values]
    for i in range(1, front):
        tests.append(gt(values[i - 1], values[i], strict) if expand else gt(values[i], values[i - 1], strict))
    for i in range(front + 1, front + back):
        tests.append(gt(values[i], values[i - 1], strict) if expand else gt(values[i - 1], values[i], strict))
    return _all(tests)


def crossed_down(hist: Column, lookback: int, w) -> Column:
    """A change from positive to negative at any of the last `lookback` steps."""
    out = F.lit(False)
    for i in range(lookback):
        out = out | F.coalesce((ago(hist, i + 1, w) > 0) & (ago(hist, i, w) < 0), F.lit(False))
    return out


def green_trend(hist: Column, n: int, lookback: int, w, decay: bool = True) -> Column:
    """The last n negative and moving towards (or from) zero, after a recent crossing."""
    values = lags(hist, n, w)
    tests = [v < 0 for v in values] + [(b > a) if decay else (b < a) for a, b in zip(values, values[1:])]
    return _all(tests) & crossed_down(hist, lookback, w)


def falling(value: Column, days: int, w) -> Column:
    """Each of the last `days` values below the one before; never for one day or less."""
    if days <= 1:
        return F.lit(False)
    values = lags(value, days, w)
    return _all([b < a for a, b in zip(values, values[1:])])


def trend_mask(kind: str, close: Column, fast: Column, slow: Column) -> Column:
    """none, close above the fast average, fast above slow, both, or either."""
    a, b = F.coalesce(close > fast, F.lit(False)), F.coalesce(fast > slow, F.lit(False))
    return {"none": F.lit(True), "close_gt_ma": a, "fast_gt_slow": b, "and": a & b, "or": a | b}[kind]


def pct_change(now: Column, before: Column) -> Column:
    """Per cent change; null for a missing or zero base."""
    return F.try_divide(now - before, before) * 100


def volume_ratio(volume: Column, n: int, w) -> Column:
    """Volume over the mean of up to n earlier volumes above zero; null if none."""
    frame = w.rowsBetween(-n, -1)
    return F.try_divide(volume, F.avg(F.when(volume > 0, volume)).over(frame))


def drawdown(equity: Column, w) -> Column:
    """One less the value over the largest so far."""
    return 1 - equity / F.max(equity).over(w.rowsBetween(Window.unboundedPreceding, 0))


def percentile_rank(value: Column, w) -> Column:
    """Per cent of the values present that are at most this one; null stays null (W22). `w` orders by the value."""
    present = F.count(value).over(Window.partitionBy(*[]))
    return F.when(value.isNotNull(), 100.0 * F.count(value).over(w.rangeBetween(Window.unboundedPreceding, 0)) / present)


def whole_keys(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames of rows sorted by a key, cut anew so that each holds all rows of its keys: many small keys, or one large."""
    kept: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[key]
        starts = np.flatnonzero((k.ne(k.shift()) & ~(k.isna() & k.shift().isna())).to_numpy()[1:]) + 1
        first = kept[-1][key].iloc[-1] if kept else None
        fresh = bool(kept) and not (first == k.iloc[0] or pd.isna(first) and pd.isna(k.iloc[0]))
        cut = int(starts[-1]) if len(starts) else 0
        if fresh or cut:
            done = [*kept, pdf.iloc[:cut]]
            yield pd.concat([x for x in done if len(x)], ignore_index=True)
            kept = []
        kept.append(pdf.iloc[cut:])
    if kept:
        yield pd.concat(kept, ignore_index=True)


def macd(
    bars: DataFrame, key: str = "code", order: str = "date", value: str = "close", spans: tuple[int, int, int] = (12, 26, 9), bar_factor: float = 1.0, beside: Sequence[str] = ()
) -> DataFrame:
    """key, order, value, dif, dea, hist by recursive averages seeded at the first value (W1, W2), and the columns `beside`.

    A task runs over its keys one after another in one sorted stream, the short series of a batch all together.
    """
    fast, slow, signal = spans

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_keys(batches, key):
            of = pdf.groupby(key, sort=False, dropna=False).ngroup().to_numpy()  # rows of a key stand together, so results keep their order
            mean = lambda x, span: x.groupby(of).ewm(span=span, adjust=False).mean().to_numpy()
            dif = pd.Series(mean(pdf[value], fast) - mean(pdf[value], slow))
            dea = mean(dif, signal)
            yield pdf.assign(dif=dif.to_numpy(), dea=dea, hist=(dif.to_numpy() - dea) * bar_factor)

    kinds = {f.name: f.dataType.simpleString() for f in bars.schema}
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} double, {''.join(f'{c} {kinds[c]}, ' for c in beside)}dif double, dea double, hist double"
    rows = bars.select(key, order, value, *beside).where(F.col(value).isNotNull())
    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)
