"""What a session may call by name from SQL: scalar functions, rule tables, an aggregate, a table function (M9).

What SQL can say becomes a SQL function, which Spark inlines into the plan; only the aggregate and the table
function run in Python, the aggregate on Arrow batches. Register once for each session; a name that is there is replaced.
"""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tickloom.functions import rules, text

#: name, arguments, result, and the expression that it stands for.
SCALARS = [
    ("percent_change", "now DOUBLE, before DOUBLE", "DOUBLE", "try_divide(now - before, abs(before)) * 100"),
    ("lenient_number", "shown STRING", "DOUBLE", "CASE WHEN isnan(try_cast(regexp_replace(trim(shown), '[,%]', '') AS DOUBLE)) THEN NULL ELSE nullif(nullif(try_cast(regexp_replace(trim(shown), '[,%]', '') AS DOUBLE), double('inf')), double('-inf')) END"),
    ("held_text", "shown STRING", "STRING", "nullif(trim(shown), '')"),
]
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (bool, int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_rules(spark: SparkSession, name: str, table: rules.Table, default: object = None, kind: str = "STRING") -> None:
    """A rule table as a function of a text: the value of the first pattern that is found, else `default`; null text gives `default`."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a name of a function: {name}")
    cases = " ".join(f"WHEN rlike(shown, {_literal(pattern)}) THEN {_literal(value)}" for pattern, value in table)
    body = f"CASE {cases} ELSE {_literal(default)} END" if cases else _literal(default)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(shown STRING) RETURNS {kind} RETURN CAST({body} AS {kind})")


@F.arrow_udf(DoubleType())
def weighted_median(value: pa.Array, weight: pa.Array) -> float:
    """The lowest value at which half of the weight is reached; rows with a null, a NaN or a weight of 0 or less don't count; null if none is left.

    A group is held whole by its task: group by (key, value) first and give the counts as weights.
    """
    v = np.asarray(value.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
    w = np.asarray(weight.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False))
    keep = ~np.isnan(v) & (w > 0)
    v, w = v[keep], w[keep]
    if not len(v):
        return None
    order = np.argsort(v, kind="stable")
    reached = np.cumsum(w[order])
    return float(v[order][np.searchsorted(reached, reached[-1] / 2)])


_BARS = "at int, date date, open double, high double, low double, close double, volume double"


class _BarsOf:
    def eval(self, body: str):
        """One row for each line of a text that is a bar of six fields or more: date, open, close, high, low, volume. Null and empty texts give none."""
        for at, line in enumerate((body or "").split("\n")):
            fields = line.strip().split(",")
            if len(fields) < 6:
                continue
            try:
                day = dt.date.fromisoformat(fields[0].strip())
                first, last, high, low, volume = (float(x) for x in fields[1:6])
            except ValueError:
                continue
            yield at, day, first, high, low, last, volume


# rows are pickled in batches: by Arrow each call's few rows would be a table of their own, at five times the time
bars_of = F.udtf(_BarsOf, returnType=_BARS, useArrow=False)


def register(spark: SparkSession) -> list[str]:
    """Register everything above; gives the names."""
    for name, arguments, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udf.register("compatible_text", text.compatible)
    spark.udf.register("weighted_median", weighted_median)
    spark.udtf.register("bars_of", bars_of)
    return [*(name for name, *_ in SCALARS), "compatible_text", "weighted_median", "bars_of"]
