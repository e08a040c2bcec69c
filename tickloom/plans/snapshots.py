"""Stored documents read as tables, contracts of what is collected, and composite reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import validate, windows
from tickloom.plans import dashboard, portfolio
from tickloom.plans.register import query
from tickloom.sources import tables as t


@query(f"""WITH {t.BARS}, m AS (SELECT code, count(*) AS n, min(date) AS first FROM bars GROUP BY 1) SELECT b.code, b.date, round(b.close, 6) AS close, m.n, m.first FROM bars b JOIN m USING (code) WHERE b.date >= DATE '1997-01-01'""")
def stored_bars(spark, sf_dir):
    """Bars from documents with an array of rows, one for each code, with the manifest's count and first day; then a range of dates."""
    bars = t.daily_bars(spark, sf_dir)
    docs = bars.groupBy("code").agg(F.to_json(F.struct(F.collect_list(F.struct("date", "open", "close")).alias("rows"))).alias("doc"))  # a code has one bar a day
    rows = docs.select("code", F.inline(F.from_json("doc", "rows array<struct<date:date,open:double,close:double>>")["rows"]))
    manifest = bars.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"))
    return rows.join(manifest, "code").where("date >= date'1997-01-01'").select("code", "date", F.round("close", 6).alias("close"), "n", "first")


@query("""SELECT event_id, user_id, value FROM events WHERE event_id % 6 <> 0 AND CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events ORDER BY d DESC LIMIT 5)""")
def daily_lines(spark, sf_dir):
    """JSON lines of the last five daily files, broken lines dropped."""
    e = t.read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    good = F.to_json(F.struct("event_id", "user_id", "value"))
    lines = e.select("day", F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("{broken "), good)).otherwise(good).alias("line"))
    last = lines.select("day").distinct().orderBy(F.col("day").desc()).limit(5)
    rows = lines.join(F.broadcast(last), "day").select(F.from_json("line", "event_id long, user_id long, value double").alias("r"))  # five days
    return rows.select("r.*").where("event_id is not null")


@query("""SELECT c_custkey, c_name || ', "the" ' || c_mktsegment AS name, c_acctbal AS balance FROM customer""")
def quoted_rows(spark, sf_dir):
    """Quoted fields with separators and doubled quotes in them; the separator is a tab where the line has one outside, else a comma."""
    name = F.concat("c_name", F.lit(', "the" '), "c_mktsegment")
    quoted = F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
    sep = F.when(F.col("c_custkey") % 2 == 0, "\t").otherwise(",")
    line = F.concat_ws("", F.col("c_custkey").cast("string"), sep, quoted, sep, F.col("c_acctbal").cast("string"))
    rows = t.read(spark, sf_dir, "customer").select(line.alias("line"))
    schema, options = "c_custkey long, name string, balance double", {"quote": '"', "escape": '"'}
    parsed = F.when(F.contains("line", F.lit("\t")), F.from_csv("line", schema, options | {"sep": "\t"})).otherwise(F.from_csv("line", schema, options))
    return rows.select(parsed.alias("r")).select("r.*")


@query("""WITH s AS (SELECT p_partkey AS id, p_partkey % 3 AS version, p_retailprice AS price, p_name AS name FROM part) SELECT id, CASE version WHEN 0 THEN 0.0::DOUBLE ELSE price END AS price, CASE WHEN version = 0 THEN '' ELSE name END AS name, version = 2 AS migrated FROM s""")
def migrated_snapshots(spark, sf_dir):
    """Stored summaries by key: none is an empty one, an old version's fields go into the new ones."""
    old = F.to_json(F.struct(F.lit(1).alias("version"), F.struct(F.col("p_retailprice").alias("cost"), F.col("p_name").alias("label")).alias("legacy")))
    new = F.to_json(F.struct(F.lit(2).alias("version"), F.col("p_retailprice").alias("price"), F.col("p_name").alias("name")))
    k = F.col("p_partkey") % 3
    rows = t.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(k == 2, old).when(k == 1, new).alias("doc"))
    d = F.from_json("doc", "version int, price double, name string, legacy struct<cost:double,label:string>")
    rows = rows.select("id", d.alias("d"))
    return rows.select("id", F.coalesce("d.price", "d.legacy.cost", F.lit(0.0)).alias("price"), F.coalesce("d.name", "d.legacy.label", F.lit("")).alias("name"), F.col("d.legacy").isNotNull().alias("migrated"))


@query(f"""WITH {t.BARS}, l AS (SELECT code, date, close, lag(close) OVER (PARTITION BY code ORDER BY date) AS b FROM bars) SELECT code, date, close > b AS strictly, close >= b - abs(b) * 0.03 AS loosely, close <= b + abs(b) * 0.03 AS not_much_above FROM l WHERE b IS NOT NULL""")
def tolerant_moves(spark, sf_dir):
    """Greater, and greater or less within three per cent of the other."""
    b = F.lag("close").over(windows.by(["code"]))
    rows = t.daily_bars(spark, sf_dir).select("code", "date", "close", b.alias("b")).where("b is not null")
    x, y = F.col("close"), F.col("b")
    return rows.select("code", "date", windows.gt(x, y).alias("strictly"), windows.gt(x, y, False).alias("loosely"), (x <= y + F.abs(y) * 0.03).alias("not_much_above"))


#: Fields that each kind of collector may deliver.
FIELDS = {"click": ["k"], "view": ["k", "value"], "purchase": ["k", "value", "user"]}


@query("""WITH c AS (SELECT event_id, event_type, CASE event_id % 4 WHEN 0 THEN ['k'] WHEN 1 THEN ['k', 'value'] WHEN 2 THEN ['k', 'extra'] ELSE [] END AS fields FROM events)
SELECT event_id, concat_ws(',', CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'source' END, CASE WHEN NOT (event_type IN ('click', 'view', 'purchase') AND len(list_filter(fields, lambda x: NOT list_contains(CASE event_type WHEN 'click' THEN ['k'] WHEN 'view' THEN ['k', 'value'] ELSE ['k', 'value', 'user'] END, x))) = 0) THEN 'fields' END, CASE WHEN len(fields) = 0 THEN 'empty' END) AS failed FROM c""")
def collector_results(spark, sf_dir):
    """Which parts of its contract a collector's result breaks: a known source, allowed fields, any field at all."""
    k = F.col("event_id") % 4
    fields = F.when(k == 0, F.array(F.lit("k"))).when(k == 1, F.array(F.lit("k"), F.lit("value"))).when(k == 2, F.array(F.lit("k"), F.lit("extra"))).otherwise(F.array().cast("array<string>"))
    allowed = F.coalesce(*[F.when(F.col("event_type") == s, F.array(*map(F.lit, names))) for s, names in FIELDS.items()])
    rows = t.read(spark, sf_dir, "events").select("event_id", "event_type", fields.alias("fields"), allowed.alias("allowed"))
    rules = {"source": F.col("event_type").isin(*FIELDS), "fields": F.size(F.array_except("fields", "allowed")) == 0, "empty": F.size("fields") > 0}
    return validate.failures(rows, rules).select("event_id", "failed")


_PRICE_TEXT = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'SMM 钨精矿均价上涨' || (p_size * 200) WHEN 1 THEN '铜价下跌' || p_size WHEN 2 THEN 'DRAM shortage, price hike' WHEN 3 THEN '上海有色 报价 涨跌 -' || (p_size * 120) WHEN 4 THEN 'tungsten market note' ELSE p_name END AS body FROM part"""


@query(f"""WITH x AS ({_PRICE_TEXT}), m AS (SELECT *, greatest(0, coalesce(list_max(list_transform(regexp_extract_all(body, '涨跌\\s*([+-]?\\d+(?:\\.\\d+)?)', 1), lambda v: abs(v::DOUBLE))), 0), coalesce(TRY_CAST(nullif(regexp_extract(body, '(?:上涨|下跌|上调|下降|涨价|降价)(\\d+(?:\\.\\d+)?)', 1), '') AS DOUBLE), 0)) AS move FROM x)
SELECT p_partkey, least(130, 80 + CASE WHEN regexp_matches(body, '(?i)SMM|上海有色') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(body, '(?i)钨|钨矿|钨精矿|tungsten|有色|金属') THEN 12 ELSE 0 END + CASE WHEN regexp_matches(body, '(?i)价格|均价|涨跌|报价|price|ASP') THEN 10 ELSE 0 END
 + CASE WHEN regexp_matches(body, '(?i)上涨|上调|涨价|提价|下跌|下降|降价|跌价|price\\s*(increase|hike|drop|decline|cut)') THEN 8 ELSE 0 END + CASE WHEN move >= 5000 THEN 10 WHEN move >= 1000 THEN 6 ELSE 0 END) AS score,
 CASE WHEN regexp_matches(body, '(?i)下跌|下降|降价|跌价|price\\s*(drop|decline|cut)|lower\\s+price') THEN '利空降价' WHEN regexp_matches(body, '(?i)上涨|上调|涨价|提价|price\\s*(increase|hike)|raise\\s+price') THEN '利好涨价' WHEN regexp_matches(body, '(?i)供不应求|供应紧张|缺货|shortage|tight\\s+supply') THEN '供需紧张' ELSE '异动归因' END AS signal FROM m""")
def price_news(spark, sf_dir):
    """Score of a price report by what it names and the size of its largest move, and its signal."""
    k, size = F.col("p_partkey") % 6, F.col("p_size")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    made = F.when(k == 0, text("SMM 钨精矿均价上涨", size * 200)).when(k == 1, text("铜价下跌", size)).when(k == 2, "DRAM shortage, price hike").when(k == 3, text("上海有色 报价 涨跌 -", size * 120)).when(k == 4, "tungsten market note").otherwise(F.col("p_name"))
    rows = t.read(spark, sf_dir, "part").select("p_partkey", made.alias("body"))
    body = F.col("body")
    moves = F.transform(F.regexp_extract_all(body, F.lit(r"涨跌\s*([+-]?\d+(?:\.\d+)?)"), F.lit(1)), lambda v: F.abs(v.cast("double")))
    titled = F.nullif(F.regexp_extract(body, r"(?:上涨|下跌|上调|下降|涨价|降价)(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")
    move = F.greatest(F.lit(0.0), F.coalesce(F.array_max(moves), F.lit(0.0)), F.coalesce(titled, F.lit(0.0)))
    points = lambda p, n: F.when(body.rlike(p), n).otherwise(0)
    score = F.lit(80) + points("(?i)SMM|上海有色", 10) + points("(?i)钨|钨矿|钨精矿|tungsten|有色|金属", 12) + points("(?i)价格|均价|涨跌|报价|price|ASP", 10) + points(r"(?i)上涨|上调|涨价|提价|下跌|下降|降价|跌价|price\s*(increase|hike|drop|decline|cut)", 8)
    score = score + F.when(move >= 5000, 10).when(move >= 1000, 6).otherwise(0)
    signal = F.when(body.rlike(r"(?i)下跌|下降|降价|跌价|price\s*(drop|decline|cut)|lower\s+price"), "利空降价").when(body.rlike(r"(?i)上涨|上调|涨价|提价|price\s*(increase|hike)|raise\s+price"), "利好涨价").when(body.rlike(r"(?i)供不应求|供应紧张|缺货|shortage|tight\s+supply"), "供需紧张").otherwise("异动归因")
    return rows.select("p_partkey", F.least(F.lit(130), score).alias("score"), signal.alias("signal"))


@query("""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'http://10.0.0.7/x' WHEN 1 THEN 'https://user@a.example.com/' WHEN 2 THEN 'https://192.168.1.4/' ELSE replace(url, 'http://', 'https://') END AS url, CASE WHEN page_id % 7 = 0 THEN 'image/png' ELSE 'text/html; charset=utf-8' END AS kind, length(html) * CASE WHEN page_id % 11 = 0 THEN 5000 ELSE 1 END AS bytes FROM pages),
h AS (SELECT *, regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/:?#]*)', 1) AS host FROM u)
SELECT page_id, CASE WHEN NOT url LIKE 'https://%' THEN 'scheme' WHEN regexp_matches(url, '^[a-z]+://[^/]*@') THEN 'user' WHEN regexp_matches(host, '^(10\\.|127\\.|169\\.254\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.|0\\.|localhost$)') THEN 'private' WHEN NOT regexp_matches(host, '\\.example\\.(com|org|net)$') THEN 'host' WHEN NOT regexp_matches(kind, '^(text/html|application/json)') THEN 'type' WHEN bytes > 8388608 THEN 'size' END AS fault FROM h""")
def fetch_policy(spark, sf_dir):
    """The first rule that a fetched document breaks: https, no user in the link, no private address, a host of the list, a kind that is wanted, at most 8 MB. What fetches is not Spark's work."""
    k = F.col("page_id")
    url = F.when(k % 5 == 0, "http://10.0.0.7/x").when(k % 5 == 1, "https://user@a.example.com/").when(k % 5 == 2, "https://192.168.1.4/").otherwise(F.replace("url", F.lit("http://"), F.lit("https://")))
    rows = t.read(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.when(k % 7 == 0, "image/png").otherwise("text/html; charset=utf-8").alias("kind"), (F.char_length("html") * F.when(k % 11 == 0, 5000).otherwise(1)).alias("bytes"))
    rows = rows.withColumn("host", F.regexp_extract("url", r"^[a-z]+://(?:[^/@]*@)?([^/:?#]*)", 1))
    private = r"^(10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.|localhost$)"
    rules = {
        "scheme": F.col("url").startswith("https://"), "user": ~F.col("url").rlike("^[a-z]+://[^/]*@"), "private": ~F.col("host").rlike(private), "host": F.col("host").rlike(r"\.example\.(com|org|net)$"),
        "type": F.col("kind").rlike("^(text/html|application/json)"), "size": F.col("bytes") <= 8 << 20,
    }
    return validate.first_failure(rows, rules).select("page_id", "fault")


@query(f"""WITH {t.MARGIN}, {t.BARS}, m AS (SELECT date, count(DISTINCT industry) AS n_industries, CAST(sum(cents) AS BIGINT) AS balance FROM margin GROUP BY 1), b AS (SELECT date, count(*) AS n_codes, CAST(sum(cents) AS BIGINT) AS turnover FROM bars WHERE cents > 0 GROUP BY 1)
SELECT date, m.n_industries, m.balance, b.n_codes, b.turnover, CASE WHEN m.date IS NULL THEN 'no margin' WHEN b.date IS NULL THEN 'no turnover' WHEN m.n_industries < 5 THEN 'partial' ELSE 'complete' END AS status FROM m FULL JOIN b USING (date)""")
def margin_payload(spark, sf_dir):
    """Each day's balances beside its turnover, and what is there of the day."""
    m = t.margin_balances(spark, sf_dir).groupBy("date").agg(F.count_distinct("industry").alias("n_industries"), F.sum("cents").alias("balance"))
    b = t.daily_bars(spark, sf_dir).where("cents > 0").groupBy("date").agg(F.count(F.lit(1)).alias("n_codes"), F.sum("cents").alias("turnover"))
    status = F.when(F.col("balance").isNull(), "no margin").when(F.col("turnover").isNull(), "no turnover").when(F.col("n_industries") < 5, "partial").otherwise("complete")
    return m.join(b, "date", "full").select("date", "n_industries", "balance", "n_codes", "turnover", status.alias("status"))


@query(f"""WITH {portfolio._POS}, tot AS (SELECT fund, sum(shares * coalesce(current, cost)) AS value, sum(shares * cost) AS cost, count(DISTINCT code) AS n_codes FROM pos GROUP BY 1)
SELECT fund, n_codes, round(value, 2) AS value, round(100 * (value / cost - 1), 6) AS profit_pct, round(100 * value / sum(value) OVER (PARTITION BY c_mktsegment), 6) AS share_pct, row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(value, 2) DESC, fund) AS place FROM tot JOIN customer ON fund = c_custkey""")
def fund_overview(spark, sf_dir):
    """Value, profit, share and place of each fund among those of its segment."""
    value, cost = F.sum(F.col("shares") * F.coalesce("current", "cost")), F.sum(F.col("shares") * F.col("cost"))
    tot = portfolio.positions(spark, sf_dir).groupBy("fund").agg(value.alias("v"), cost.alias("c"), F.count_distinct("code").alias("n_codes"))
    rows = tot.join(t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fund"), "c_mktsegment"), "fund")
    w = Window.partitionBy("c_mktsegment")
    place = F.row_number().over(w.orderBy(F.round("v", 2).desc(), "fund")).cast("long")
    return rows.select("fund", "n_codes", F.round("v", 2).alias("value"), F.round(100 * (F.col("v") / F.col("c") - 1), 6).alias("profit_pct"), F.round(100 * F.col("v") / F.sum("v").over(w), 6).alias("share_pct"), place.alias("place"))


@query(f"""WITH {dashboard._OBS}, {dashboard._PRICES}, c AS (SELECT 'companies' AS part, count(DISTINCT company) AS n, max(observed) AS as_of FROM obs UNION ALL SELECT 'prices', count(DISTINCT sku), max(as_of) FROM p UNION ALL SELECT 'models', count(DISTINCT event_type), max(CAST(ts AS DATE)) FROM events)
SELECT part, n, as_of, date_diff('day', as_of, DATE '2001-12-31') > 60 AS stale FROM c""")
def dashboard_snapshot(spark, sf_dir):
    """How many keys each part of the dashboard has, its date, and whether it is stale."""
    o = dashboard.observations(spark, sf_dir).agg(F.count_distinct("company").alias("n"), F.max("observed").alias("as_of")).withColumn("part", F.lit("companies"))
    p = dashboard.prices(spark, sf_dir).agg(F.count_distinct("sku").alias("n"), F.max("as_of").alias("as_of")).withColumn("part", F.lit("prices"))
    e = t.read(spark, sf_dir, "events").agg(F.count_distinct("event_type").alias("n"), F.max(F.to_date("ts")).alias("as_of")).withColumn("part", F.lit("models"))
    return o.unionByName(p).unionByName(e).select("part", "n", "as_of", (F.datediff(F.lit("2001-12-31").cast("date"), "as_of") > 60).alias("stale"))


@query(f"""WITH {t.BARS}, {t.BENCHMARK}, c AS (SELECT code, count(*) AS n FROM bars GROUP BY 1), d AS (SELECT count(*) AS codes, count(*) FILTER (WHERE n >= 252) AS ready, CAST(sum(n) AS BIGINT) AS n_bars FROM c), i AS (SELECT count(*) AS sessions, min(date) AS first, max(date) AS last FROM bench) SELECT * FROM d CROSS JOIN i""")
def strategy_overview(spark, sf_dir):
    """What a back-test has to work with: codes, those with enough bars, bars, and the index's sessions. One row beside one row."""
    bars = t.daily_bars(spark, sf_dir)
    d = bars.groupBy("code").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("codes"), F.count_if(F.col("n") >= 252).alias("ready"), F.sum("n").alias("n_bars"))
    i = t.benchmark(spark, sf_dir).agg(F.count(F.lit(1)).alias("sessions"), F.min("date").alias("first"), F.max("date").alias("last"))
    return d.join(F.broadcast(i), F.lit(True))
