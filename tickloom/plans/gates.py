"""Validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import validate
from tickloom.plans.register import query
from tickloom.sources import tables as t


@query(f"""WITH {t.MARGIN}, d AS (SELECT date, CAST(sum(cents) AS BIGINT) AS total, count(DISTINCT industry) AS n_industries, min(cents) AS least, count(*) AS n_rows, count(DISTINCT code) AS n_codes FROM margin GROUP BY 1)
SELECT date, concat_ws(',', CASE WHEN NOT n_industries = 5 THEN 'industries' END, CASE WHEN NOT n_rows = n_codes THEN 'unique' END, CASE WHEN NOT least > 0 THEN 'positive' END, CASE WHEN NOT total BETWEEN 10000000 AND 500000000 THEN 'range' END) AS failed FROM d""")
def margin_contract(spark, sf_dir):
    """V3: which parts of its contract a day's balances break."""
    d = t.margin_balances(spark, sf_dir).groupBy("date").agg(F.sum("cents").alias("total"), F.count_distinct("industry").alias("n_industries"), F.min("cents").alias("least"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("code").alias("n_codes"))
    rules = {"industries": F.col("n_industries") == 5, "unique": F.col("n_rows") == F.col("n_codes"), "positive": F.col("least") > 0, "range": F.col("total").between(10_000_000, 500_000_000)}
    return validate.failures(d, rules).select("date", "failed")


@query("""SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN NOT coalesce(l_discount <> 0 OR l_tax <> 0, false) THEN 'empty' END, CASE WHEN NOT l_extendedprice >= 1000 THEN 'small' END,
 CASE WHEN NOT (l_returnflag <> 'R' OR l_discount <= l_tax) THEN 'sign' END, CASE WHEN NOT abs(l_extendedprice / l_quantity - 1500) <= 0.3 * 1500 THEN 'implied' END) AS failed FROM lineitem""")
def earnings_checks(spark, sf_dir):
    """V8: missing, small, wrongly signed and inconsistent rows."""
    c = F.col
    rules = {
        "empty": (c("l_discount") != 0) | (c("l_tax") != 0),
        "small": c("l_extendedprice") >= 1000,
        "sign": (c("l_returnflag") != "R") | (c("l_discount") <= c("l_tax")),
        "implied": F.abs(c("l_extendedprice") / c("l_quantity") - 1500) <= 0.3 * 1500,
    }
    return validate.failures(t.read(spark, sf_dir, "lineitem"), rules).select("l_orderkey", "l_linenumber", "failed")


@query("""SELECT source, lang, count(*) AS n, count(*) FILTER (WHERE NOT length(text) >= 20) AS short, count(*) FILTER (WHERE NOT n_chars = length(text)) AS size, count(*) FILTER (WHERE NOT text NOT LIKE '%@%') AS mail FROM documents GROUP BY 1, 2""")
def batch_checks(spark, sf_dir):
    """Rows of each batch that break each rule."""
    rules = {"short": F.char_length("text") >= 20, "size": F.col("n_chars") == F.char_length("text"), "mail": ~F.contains(F.col("text"), F.lit("@"))}
    return validate.failure_counts(t.read(spark, sf_dir, "documents"), rules, ["source", "lang"])


@query("""WITH u AS (SELECT page_id, url, url LIKE 'https://%' AS https, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host FROM pages)
SELECT page_id, CASE WHEN host = '' THEN 'host' WHEN NOT (host LIKE '%.example.com' OR host LIKE '%.example.org' OR host LIKE '%.example.net') THEN 'allow-list' WHEN NOT https THEN 'scheme' END AS fault FROM u""")
def source_policy(spark, sf_dir):
    """The first rule of the source policy that a link breaks."""
    rows = t.read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"^[a-z]+://([^/:?#]*)", 1).alias("host"))
    rules = {"host": F.col("host") != "", "allow-list": F.col("host").rlike(r"\.example\.(com|org|net)$"), "scheme": F.col("url").startswith("https://")}
    return validate.first_failure(rows, rules).select("page_id", "fault")


@query(f"""WITH {t.BARS}, d AS (SELECT DISTINCT date FROM bars), n AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS rn FROM d), e AS (SELECT date AS expected FROM n WHERE rn = 2), c AS (SELECT code, max(date) AS last FROM bars GROUP BY 1)
SELECT code, last, expected, last >= expected AS fresh, date_diff('day', last, expected) > 10 AS stale FROM c CROSS JOIN e""")
def feed_freshness(spark, sf_dir):
    """V4: whether a code's last bar is at least the second newest session, and whether it is over ten days behind."""
    bars = t.daily_bars(spark, sf_dir)
    newest = bars.select("date").distinct().orderBy(F.col("date").desc()).limit(2)
    expected = newest.agg(F.min("date").alias("expected"))  # one row
    codes = bars.groupBy("code").agg(F.max("date").alias("last"))
    rows = codes.join(F.broadcast(expected), F.lit(True))
    return rows.select("code", "last", "expected", (F.col("last") >= F.col("expected")).alias("fresh"), (F.datediff("expected", "last") > 10).alias("stale"))


@query(f"""WITH {t.MARGIN}, i AS (SELECT code, industry, count(*) AS n FROM margin GROUP BY 1, 2), x AS (SELECT code, count(*) AS n_industries FROM i GROUP BY 1) SELECT code, n_industries FROM x""")
def duplicate_membership(spark, sf_dir):
    """In how many industries each code stands; more than one is an error."""
    return t.margin_balances(spark, sf_dir).groupBy("code").agg(F.count_distinct("industry").alias("n_industries"))


@query(f"""WITH {t.BARS}, d AS (SELECT date AS asked, CASE WHEN (code * 7 + day(date)) % 211 = 0 THEN date - 1 ELSE date END AS date, CASE WHEN (code + day(date)) % 97 = 0 THEN '900' || lpad(code::VARCHAR, 3, '0') || '.SH' WHEN day(date) = 17 THEN '600' || lpad((code // 2)::VARCHAR, 3, '0') || '.SH' ELSE lpad((code + 600000)::VARCHAR, 6, '0') || '.SH' END AS ts_code FROM bars),
x AS (SELECT asked, count(*) AS n, count(DISTINCT ts_code) AS n_codes, count(*) FILTER (WHERE date <> asked) AS wd, count(*) FILTER (WHERE ts_code LIKE '900%') AS wc FROM d GROUP BY 1),
e AS (SELECT date AS asked, count(*) + CASE WHEN day(date) = 5 THEN 1 ELSE 0 END AS n_expected FROM bars WHERE day(date) < 10 GROUP BY 1, date)
SELECT x.asked, n, n_codes, CASE WHEN wd > 0 THEN 'date' WHEN wc > 0 THEN 'code' WHEN n <> n_codes THEN 'unique' WHEN n_expected > 0 THEN CASE WHEN n <> n_expected THEN 'rows' END WHEN n < 20 THEN 'coverage' END AS failure FROM x LEFT JOIN e ON e.asked = x.asked""")
def delivery_gate(spark, sf_dir):
    """V1: whether each day's delivery is of that day, of strict codes, each once, and whole."""
    c = F.col
    bars = t.daily_bars(spark, sf_dir).select("code", "date")
    at = F.day("date")
    digits = lambda n: F.lpad(n.cast("string"), 3, "0")
    listed = F.when((c("code") + at) % 97 == 0, F.concat(F.lit("900"), digits(c("code")))).when(at == 17, F.concat(F.lit("600"), digits(F.floor(c("code") / 2)))).otherwise(F.lpad((c("code") + 600000).cast("string"), 6, "0"))
    rows = bars.select(c("date").alias("asked"), F.when((c("code") * 7 + at) % 211 == 0, F.date_sub("date", 1)).otherwise(c("date")).alias("date"), F.concat(listed, F.lit(".SH")).alias("ts_code"))
    expected = bars.where(at < 10).groupBy(c("date").alias("asked")).agg(F.count(F.lit(1)).alias("n")).select("asked", (c("n") + F.when(F.day("asked") == 5, 1).otherwise(0)).alias("n_expected"))
    return validate.delivery_gate(rows, "asked", "date", "ts_code", expected, least=20)
