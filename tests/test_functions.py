import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.functions import dates, text


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(make(F.col("c")).alias("x")).first()["x"]


@pytest.mark.parametrize("raw, code", [("SH600000", "600000"), ("1.SZ", "000001"), (" 300750 ", "300750"), ("bj430047", "430047"), ("abc", None), ("", None), (None, None), ("1234567", None)])
def test_codes(spark, raw, code):
    assert one(spark, raw, text.normal_code) == code


def test_exchange(spark):
    assert [one(spark, c, text.exchange) for c in ("600000", "000001", "300750", "430047", "830000", "900901", "500000")] == ["sh", "sz", "sz", "bj", "bj", "sh", None]


@pytest.mark.parametrize("raw, value", [("1,234.5", 1234.5), ("7%", 7.0), ("--", None), ("nan", None), ("None", None), (" 3 ", 3.0), ("inf", None), (None, None)])
def test_numbers(spark, raw, value):
    assert one(spark, raw, text.lenient_number) == value


def test_text(spark):
    assert one(spark, " Hello,  WORLD_1 中文! ", text.normalise) == "hello world_1 中文"
    assert one(spark, "--A b/C--", text.slug) == "a-b-c"
    assert one(spark, "HTTPS://www.A.com/x/?q=1#f", text.canonical_url) == "a.com/x"
    assert one(spark, "ab", text.polynomial_hash) == 97 * 31 + 98
    h = 0
    for c in "a long enough text to overflow":
        h = (h * 31 + ord(c)) % (1 << 32)
    assert one(spark, "a long enough text to overflow", text.polynomial_hash) == h
    assert one(spark, "used 3.5k and 2M of 10 tokens", text.largest_count) == 2_000_000
    assert one(spark, "none", text.largest_count) is None


def test_months(spark):
    d = dt.date(2023, 3, 31)
    assert one(spark, d, dates.prior_month, "date") == dt.date(2023, 2, 28)
    assert one(spark, d, lambda c: dates.prior_month(c, True), "date") == dt.date(2023, 3, 3)


@pytest.mark.parametrize("raw, day", [("20240229", dt.date(2024, 2, 29)), ("2024-02-29", dt.date(2024, 2, 29)), ("20230229", None), ("2024", None), (None, None)])
def test_parse_day(spark, raw, day):
    assert one(spark, raw, dates.parse_day) == day


def test_weeks_and_business_days(spark):
    for d in (dt.date(2020, 12, 31), dt.date(2021, 1, 1), dt.date(2021, 1, 4), dt.date(2018, 12, 31)):
        year, week, _ = d.isocalendar()
        assert one(spark, d, dates.iso_week, "date") == f"{year}-{week:02d}"
    for start in range(10):
        a = dt.date(2024, 1, 1) + dt.timedelta(start)
        for n in (0, 1, 4, 5, 9, 23):
            b = a + dt.timedelta(n)
            expected = sum((a + dt.timedelta(i)).weekday() < 5 for i in range(1, n + 1))
            row = spark.createDataFrame([(a, b)], "a date, b date").select(dates.business_days(F.col("a"), F.col("b")).alias("x")).first()
            assert row["x"] == expected


@pytest.mark.parametrize("raw, value", [("十", 10.0), ("十五", 15.0), ("二十", 20.0), ("三百零二", 302.0), ("九", 9.0), ("一百二十三点五", 123.5), ("两百", 200.0), ("x", None), ("", None), (None, None)])
def test_chinese_numbers(spark, raw, value):
    assert one(spark, raw, text.chinese_number) == value
