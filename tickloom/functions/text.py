"""Column functions on text and codes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tickloom.functions import rules


def normal_code(c: Column) -> Column:
    """A six-digit code: without exchange prefix and suffix, zeros on the left (F1); null if not digits."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^(sh|sz|bj)", ""), r"\..*$", "")
    return F.when(bare.rlike(r"^[0-9]{1,6}$"), F.lpad(bare, 6, "0"))


def exchange(code: Column) -> Column:
    """Exchange of a six-digit code by its first digits (F2)."""
    return F.when(code.rlike("^(6|9)"), "sh").when(code.rlike("^(4|8)"), "bj").when(code.rlike("^(0|2|3)"), "sz")


def lenient_number(c: Column) -> Column:
    """A finite number from text with commas and per cent signs; '--', 'nan', 'None' and others are null."""
    value = F.regexp_replace(F.trim(c), r"[,%]", "").try_cast("double") if hasattr(c, "try_cast") else F.expr("null")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)


def normalise(c: Column) -> Column:
    """Lower case, other signs than letters, digits, _ and Han as spaces, spaces squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9_\x{4e00}-\x{9fff}]+", " "), r" +", " "))


def slug(c: Column) -> Column:
    """Lower case, runs of other signs than letters, digits and Han as one '-', none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "-"), r"^-+|-+$", "")


def canonical_url(c: Column) -> Column:
    """Lower case, without scheme, www, query, fragment and trailing slashes (F16)."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^[a-z]+://", ""), r"^www\.", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"/+$", "")


def polynomial_hash(c: Column) -> Column:
    """Unsigned 32-bit polynomial hash with factor 31 over code points."""
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(0).cast("long"), lambda h, x: F.pmod(h * 31 + F.ascii(x), F.lit(1 << 32)))


def count_terms(c: Column, terms: list[str]) -> Column:
    """How many of the terms occur."""
    return sum((F.when(F.contains(c, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))


def first_rule(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern, in order, that is found."""
    out = None
    for pattern, label in rules:
        out = F.when(c.rlike(pattern), label) if out is None else out.when(c.rlike(pattern), label)
    return out.otherwise(default)


def largest_count(c: Column) -> Column:
    """Largest of the numbers in a text, with k, m, b, t as thousands up to trillions."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"([0-9]+(?:\.[0-9]+)?\s*[kmbt]?)\b"), 1)
    scale = lambda x: F.when(F.endswith(x, F.lit("k")), 1e3).when(F.endswith(x, F.lit("m")), 1e6).when(F.endswith(x, F.lit("b")), 1e9).when(F.endswith(x, F.lit("t")), 1e12).otherwise(1.0)
    return F.array_max(F.transform(found, lambda x: F.regexp_extract(x, r"^[0-9.]+", 0).cast("double") * scale(x)))


def chinese_number(c: Column) -> Column:
    """A number below a thousand in Chinese numerals, with a decimal part after the point sign (F36); null if it isn't one."""
    form = lambda digit, any_digit, nought: rf"^(?:({digit})百)?{nought}?(?:({digit})?(十))?({digit})?(?:点({any_digit}+))?$"
    plain = F.translate(F.trim(c), "两〇", "二零")

    def value(s: Column) -> Column:
        # in digits once; a part is looked for once
        part = lambda i: F.regexp_extract(s["digits"], form("[1-9]", "[0-9]", "0"), i)
        ones = lambda i: F.concat(F.lit("0"), part(i)).cast("int")
        tens = F.when(F.contains(s["plain"], F.lit("十")), F.greatest(F.lit(1), ones(2)) * 10).otherwise(0)
        whole = ones(1) * 100 + tens + ones(4)
        return F.when(s["plain"].rlike(form("[一二三四五六七八九]", "[零一二三四五六七八九]", "零")) & (s["plain"] != ""), whole + F.concat(F.lit("0."), part(5), F.lit("0")).cast("double"))

    return rules.once(rules.once(plain, lambda x: F.struct(x.alias("plain"), F.translate(x, "零一二三四五六七八九", "0123456789").alias("digits"))), value)


def relative_time(shown: Column, archived: Column) -> Column:
    """`HH:MM`, N分钟, N小时 against the time of an archive (F12); a clock time after it is of the day before; others are null."""
    clock = F.regexp_extract_all(shown, F.lit(r"^(\d{1,2}):(\d{2})$"), F.lit(0))
    number = F.regexp_extract(shown, r"(\d+)", 1).try_cast("int")
    at = F.date_trunc("day", archived) + F.make_dt_interval(F.lit(0), F.split_part(shown, F.lit(":"), F.lit(1)).try_cast("int"), F.split_part(shown, F.lit(":"), F.lit(2)).try_cast("int"))
    at = F.when(at > archived, at - F.expr("interval 1 day")).otherwise(at)
    back = lambda unit: archived - (F.make_dt_interval(F.lit(0), F.lit(0), number) if unit == "m" else F.make_dt_interval(F.lit(0), number))
    return F.when(F.size(clock) > 0, at).when(shown.rlike("分钟"), back("m")).when(shown.rlike("小时"), back("h"))


def special_treatment(name: Column) -> Column:
    """A name under special treatment: ST at the start, after a space or an asterisk."""
    return name.rlike(r"(?i)(^|\s|\*)ST")


def no_company(symbol: Column, kind: Column, name: Column, known: list[str]) -> Column:
    """An instrument that isn't a company: known symbols, indices, futures, funds."""
    bare = F.upper(F.trim(symbol))
    by_symbol = (bare == "") | bare.isin(*known) | bare.startswith("^") | bare.endswith("=F")
    return F.coalesce(by_symbol, F.lit(True)) | F.coalesce(F.lower(kind).isin("etf", "fund", "index", "future", "futures"), F.lit(False)) | F.coalesce(name.rlike(r"(?i)\bETF\b|\bFutures?\b|指数|期货|交易所交易基金"), F.lit(False))


def first_held(*columns: str) -> Column:
    """The first column that holds more than white space."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


@F.pandas_udf(StringType())
def compatible(c: pd.Series) -> pd.Series:
    """Text in compatibility form (F15): Spark has no function for it, so batches go through Python's tables."""
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))
