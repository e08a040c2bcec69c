"""Queries of column functions: codes, numbers, dates, hashes, amounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import dates, text
from tickloom.plans.register import query
from tickloom.sources import tables as t


@query("""WITH c AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'SH' || (s_suppkey * 6007) WHEN 1 THEN (s_suppkey * 31)::VARCHAR || '.SZ' ELSE ' ' || s_suppkey || ' ' END AS raw FROM supplier),
n AS (SELECT s_suppkey, raw, regexp_replace(regexp_replace(lower(trim(raw)), '^(sh|sz|bj)', ''), '\\..*$', '') AS bare FROM c), k AS (SELECT s_suppkey, raw, CASE WHEN regexp_matches(bare, '^[0-9]{1,6}$') THEN lpad(bare, 6, '0') END AS code FROM n)
SELECT s_suppkey, raw, code, CASE WHEN code[1] IN ('6', '9') THEN 'sh' WHEN code[1] IN ('4', '8') THEN 'bj' WHEN code[1] IN ('0', '2', '3') THEN 'sz' END AS exchange FROM k""")
def stock_codes(spark, sf_dir):
    """Codes in one form, and their exchange."""
    k = F.col("s_suppkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("SH"), (k * 6007).cast("string"))).when(k % 3 == 1, F.concat((k * 31).cast("string"), F.lit(".SZ"))).otherwise(F.concat(F.lit(" "), k.cast("string"), F.lit(" ")))
    rows = t.read(spark, sf_dir, "supplier").select("s_suppkey", raw.alias("raw")).withColumn("code", text.normal_code(F.col("raw")))
    return rows.withColumn("exchange", text.exchange(F.col("code")))


@query("""WITH r AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '1,' || lpad((p_size)::VARCHAR, 3, '0') WHEN 1 THEN p_size || '%' WHEN 2 THEN '--' WHEN 3 THEN 'nan' ELSE ' ' || p_size || '.5' END AS raw FROM part)
SELECT p_partkey, raw, CASE WHEN raw NOT IN ('--', 'nan') THEN TRY_CAST(replace(replace(trim(raw), ',', ''), '%', '') AS DOUBLE) END AS value FROM r""")
def lenient_numbers(spark, sf_dir):
    """numbers from text as it comes."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    raw = F.when(k % 5 == 0, F.concat(F.lit("1,"), F.lpad(size, 3, "0"))).when(k % 5 == 1, F.concat(size, F.lit("%"))).when(k % 5 == 2, "--").when(k % 5 == 3, "nan").otherwise(F.concat(F.lit(" "), size, F.lit(".5")))
    return t.read(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).withColumn("value", text.lenient_number(F.col("raw")))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT day, CAST(day - INTERVAL 1 MONTH AS DATE) AS clamped, CAST(date_trunc('month', day - INTERVAL 1 MONTH) + INTERVAL (dayofmonth(day) - 1) DAY AS DATE) AS overflowed,
 CAST((SELECT max(x) FROM (SELECT day + INTERVAL (i) DAY AS x, row_number() OVER (ORDER BY i) AS rn FROM range(1, 9) r(i) WHERE isodow(day + INTERVAL (i) DAY) < 6) WHERE rn <= 3) AS DATE) AS plus3,
 strftime(day, '%Y%m%d') AS packed FROM d""")
def date_arithmetic(spark, sf_dir):
    """Prior months both ways, business days, day text parsed back."""
    d = t.read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    packed = F.date_format("day", "yyyyMMdd")
    return d.where(dates.parse_day(packed) == F.col("day")).select("day", dates.prior_month(F.col("day")).alias("clamped"), dates.prior_month(F.col("day"), True).alias("overflowed"), dates.add_business_days(F.col("day"), 3).alias("plus3"), packed.alias("packed"))


@query("""SELECT p_partkey, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS BIGINT) AS h FROM part""")
def text_hashes(spark, sf_dir):
    """the 31-polynomial hash of a name."""
    return t.read(spark, sf_dir, "part").select("p_partkey", text.polynomial_hash(F.col("p_name")).alias("h"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity * 100 AS shares, l_extendedprice / 100000000 AS yi, CASE WHEN l_tax = 0 THEN NULL ELSE 100 * (l_discount - l_tax) / l_tax END AS pct, l_extendedprice / (1 + l_discount) AS implied FROM lineitem""")
def unit_scaling(spark, sf_dir):
    """lots to shares, amounts in 1e8, per cent change, implied previous value."""
    c = F.col
    return t.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_quantity") * 100).alias("shares"), (c("l_extendedprice") / 100_000_000).alias("yi"), F.try_divide(100 * (c("l_discount") - c("l_tax")), c("l_tax")).alias("pct"), (c("l_extendedprice") / (1 + c("l_discount"))).alias("implied"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS mails, len(regexp_extract_all(text, '\\([0-9]{3}\\) [0-9]{3}-[0-9]{4}')) AS phones,
 regexp_extract(text, 'version ([0-9]+)', 1) AS version FROM documents""")
def extracted_facts(spark, sf_dir):
    """What patterns find in a text: addresses, numbers, a version."""
    c = F.col("text")
    count = lambda p: F.size(F.regexp_extract_all(c, F.lit(p), 0)).cast("long")
    return t.read(spark, sf_dir, "documents").select("doc_id", count(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("mails"), count(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}").alias("phones"), F.regexp_extract(c, "version ([0-9]+)", 1).alias("version"))
