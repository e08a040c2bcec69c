"""Feed texts read as tables: quote and bar lines, pipe tables, feeds, pages, digests, sheets, counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators import merging
from tickloom.plans.register import query
from tickloom.sources import readers
from tickloom.sources import tables as t


def _joined(*columns):
    return F.concat(*[F.lit(c) if isinstance(c, str) else c.cast("string") for c in columns])


@query("""WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS code, CASE WHEN l_linenumber % 5 = 0 THEN 'v_sz="";' WHEN l_linenumber % 5 = 1 THEN 'broken' ELSE 'ok' END AS kind, l_quantity AS cur, CASE WHEN l_linenumber % 5 = 2 THEN 0 ELSE l_quantity + 1 END AS prev, l_extendedprice AS open, strftime(l_shipdate, '%Y%m%d') || '093000' AS ts FROM lineitem)
SELECT id, code, strptime(left(ts, 8), '%Y%m%d')::DATE AS date, cur AS close, prev AS pre_close, open, CASE WHEN prev > 0 THEN floor((cur - prev) / prev * 100 * 100 + 0.5) / 100 ELSE 0.5 END AS pct_chg FROM l WHERE kind = 'ok'""")
def quote_lines(spark, sf_dir):
    """Quotes at fixed places of a line between tildes; the change is made anew where there is a previous price."""
    k = F.col("l_linenumber") % 5
    prev = F.when(k == 2, F.lit(0.0)).otherwise(F.col("l_quantity") + 1)
    parts = ["51", "name", "code", F.col("l_quantity"), prev, "0", "700", "0", "0", F.col("l_extendedprice"), *["x"] * 20, F.concat(F.date_format("l_shipdate", "yyyyMMdd"), F.lit("093000")), "0", "0.5", "9", "1"]
    line = F.concat(F.lit('v_sz="'), F.concat_ws("~", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), F.lit('";'))
    rows = t.read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("code"), F.when(k == 0, 'v_sz="";').when(k == 1, "broken").otherwise(line).alias("line"))
    return readers.quote_lines(rows, "line").select("id", "code", "date", "close", "pre_close", "open", "pct_chg")


@query("""SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS open, l_quantity AS close, l_discount AS turnover FROM lineitem WHERE l_linenumber % 4 <> 0""")
def kline_rows(spark, sf_dir):
    """Bars of eleven fields between commas; shorter lines go."""
    c = F.col
    full = F.concat_ws(",", F.date_format("l_shipdate", "yyyy-MM-dd"), *[x.cast("string") for x in (c("l_extendedprice"), c("l_quantity"))], *map(F.lit, ["1", "1", "5", "6", "7", "8", "9"]), c("l_discount").cast("string"))
    rows = t.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), F.when(c("l_linenumber") % 4 == 0, "2020-01-01,1,2").otherwise(full).alias("line"))
    return readers.kline_lines(rows, "line", "code").select("code", "date", "open", "close", "turnover")


@query("""SELECT c_custkey, 1 AS block, r.row AS row, r.cells[1] AS a, r.cells[2] AS b FROM (SELECT c_custkey, unnest([{'row': 1, 'cells': ['name', 'balance']}, {'row': 2, 'cells': [c_name, c_acctbal::VARCHAR]}]) AS r FROM customer)""")
def pipe_tables(spark, sf_dir):
    """Rows of the pipe tables in a text; separator rows go, single lines are no table."""
    body = _joined("intro\n| alone |\n\n| name | balance |\n| --- | ---: |\n| ", F.col("c_name"), " | ", F.col("c_acctbal"), " |\nend")
    rows = readers.markdown_tables(t.read(spark, sf_dir, "customer").select("c_custkey", body.alias("body")), "c_custkey", "body")
    return rows.select("c_custkey", F.lit(1).alias("block"), F.col("row").alias("row"), F.col("cells")[0].alias("a"), F.col("cells")[1].alias("b"))


@query("""SELECT p_partkey, p_name AS title, 'http://x/' || p_partkey AS link, 'd' || p_size AS published FROM part""")
def feed_items(spark, sf_dir):
    """Title, link and time of a feed's entries."""
    body = _joined("<rss><channel><item><title><![CDATA[", F.col("p_name"), "]]></title><link>http://x/", F.col("p_partkey"), "</link><pubDate>d", F.col("p_size"), "</pubDate></item></channel></rss>")
    return readers.feed_entries(t.read(spark, sf_dir, "part").select("p_partkey", body.alias("body")), "p_partkey", "body")


@query("""SELECT p_partkey, r.row AS row, r.a AS a, r.b AS b FROM (SELECT p_partkey, unnest([{'row': 0, 'a': 'Type', 'b': 'Size'}, {'row': 1, 'a': p_type, 'b': p_size::VARCHAR}]) AS r FROM part)""")
def page_tables(spark, sf_dir):
    """The cells of a page's tables, white space and markup gone."""
    body = _joined("<p>x</p><table><tr><th> Type </th><th>Size</th></tr><tr><td><b>", F.col("p_type"), "</b></td><td>\n", F.col("p_size"), " </td></tr></table>")
    rows = readers.html_tables(t.read(spark, sf_dir, "part").select("p_partkey", body.alias("body")), "p_partkey", "body")
    return rows.select("p_partkey", "row", F.col("cells")[0].alias("a"), F.col("cells")[1].alias("b"))


@query("""SELECT p_partkey, p_name AS name FROM part WHERE p_size % 2 = 0""")
def page_datasets(spark, sf_dir):
    """Linked data of one kind in a page's scripts."""
    kind = F.when(F.col("p_size") % 2 == 0, "Dataset").otherwise("Thing")
    body = _joined('<script type="application/ld+json">{"@type": "', kind, '", "name": "', F.col("p_name"), '"}</script><script type="application/ld+json">{broken</script>')
    return readers.linked_data(t.read(spark, sf_dir, "part").select("p_partkey", body.alias("body")), "p_partkey", "body").select("p_partkey", "name")


@query("""WITH b AS (SELECT o_custkey AS doc, o_orderkey AS id, 'user' || o_orderkey AS handle, floor(o_totalprice)::BIGINT AS likes FROM orders WHERE o_orderkey % 5 <> 0) SELECT doc, handle, 'http://x/' || id AS url, likes, 'said ' || id || ' and more' AS body FROM b""")
def digest_blocks(spark, sf_dir):
    """Blocks between rules: a header with the account, the lines up to the link, and what the link line counts; a block without a header is none."""
    k = F.col("o_orderkey")
    head = F.when(k % 5 == 0, "# no header").otherwise(_joined("## @user", k, " - 1998-01-01"))
    block = F.concat(head, _joined("\nsaid ", k, "\n and  more\nmedia: x.png\nURL http://x/", k, " heart ", F.floor("o_totalprice"), " retweet 3\nafter"))
    texts = t.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.array_join(F.collect_list(block), "\n---\n").alias("text"))
    return readers.digest_blocks(texts, "doc", "text").select("doc", "handle", "url", "likes", "body")


#: Products and the names that their sheets may have.
PRODUCTS = [("steel", "steel"), ("brass", "brass rods"), ("anvil", "anvil"), ("ring", "ring small"), ("ring", "ring")]
_PRODUCT_SQL = ", ".join(f"('{i}', '{x}')" for i, x in PRODUCTS)


@query(f"""WITH s AS (SELECT DISTINCT p_name AS sheet FROM part), m AS (SELECT sheet, id, alias, row_number() OVER (PARTITION BY sheet ORDER BY sheet = alias DESC, length(alias) DESC, id) AS rn FROM s JOIN (VALUES {_PRODUCT_SQL}) AS a(id, alias) ON contains(sheet, alias) OR contains(alias, sheet))
SELECT s.sheet, coalesce(m.id, left(sha1(s.sheet), 12)) AS product FROM s LEFT JOIN m ON m.sheet = s.sheet AND rn = 1""")
def sheet_products(spark, sf_dir):
    """A sheet's product: an exact alias before a part, the longer alias first, else a name by hash."""
    sheets = t.read(spark, sf_dir, "part").select(F.lower(F.trim("p_name")).alias("sheet")).distinct()
    best = F.array_max(F.array_compact(F.array(*[F.when(F.contains("sheet", F.lit(a)) | F.contains(F.lit(a), "sheet"), F.struct((F.col("sheet") == a).alias("exact"), F.lit(len(a)).alias("n"), F.lit(i).alias("id"))) for i, a in PRODUCTS])))
    return sheets.select("sheet", F.coalesce(best["id"], F.left(F.sha1("sheet"), F.lit(12))).alias("product"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1e3 WHEN 1 THEN greatest(p_size * 1e6, 5) WHEN 2 THEN p_size::DOUBLE ELSE NULL END AS largest FROM part""")
def token_counts(spark, sf_dir):
    """The largest number of a text, with k, m, b, t as thousands up to trillions."""
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    body = F.when(k == 0, _joined("context ", size, "k tokens")).when(k == 1, _joined("5 or ", size, " m")).when(k == 2, _joined(size, " tokens")).otherwise("none")
    return t.read(spark, sf_dir, "part").select("p_partkey", text.largest_count(body).alias("largest"))


_NUMERALS = ["十", "二十三", "一百零五", "三百二十一", "九", "两百", "四十点五", "x", "七百八十", "〇"]


@query("""SELECT p_partkey, ([10.0, 23.0, 105.0, 321.0, 9.0, 200.0, 40.5, NULL, 780.0, 0.0])[p_partkey % 10 + 1]::DOUBLE AS number FROM part""")
def chinese_numerals(spark, sf_dir):
    """numbers below a thousand in Chinese numerals."""
    c = F.element_at(F.array(*map(F.lit, _NUMERALS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    return t.read(spark, sf_dir, "part").select("p_partkey", text.chinese_number(c).alias("number"))


@query("""SELECT p_partkey, nfc_normalize(p_name) || ' ' || p_size || 'ABC' AS plain FROM part""")
def compatible_text(spark, sf_dir):
    """text in its compatibility form: full-width signs as plain ones."""
    full_width = lambda x: "".join(chr(ord(c) + 0xFEE0) for c in x)
    wide = F.translate(F.col("p_size").cast("string"), "0123456789", full_width("0123456789"))
    return t.read(spark, sf_dir, "part").select("p_partkey", text.compatible(F.concat("p_name", F.lit(" "), wide, F.lit(full_width("ABC")))).alias("plain"))


@query("""WITH h AS (SELECT o_custkey AS fund, l_suppkey AS code, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) SELECT code, arg_min(fund, seq) AS fund, count(*) AS n_funds FROM h GROUP BY 1""")
def watch_list(spark, sf_dir):
    """The codes that funds hold, each once, under the fund that held it first."""
    orders = t.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("fund"))
    lines = t.read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("code"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    held = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("fund", "code").agg(F.min("seq").alias("seq"))
    return held.groupBy("code").agg(F.min_by("fund", "seq").alias("fund"), F.count(F.lit(1)).alias("n_funds"))


@query("""WITH o AS (SELECT o_custkey AS fund, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_totalprice END AS nav, o_orderkey AS seq FROM orders), d AS (SELECT fund, date, arg_max(nav, seq) AS nav FROM o GROUP BY 1, 2),
c AS (SELECT l_suppkey % 50 AS k, CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE false), x AS (SELECT fund, date, nav, last_value(CASE WHEN nav > 0 THEN nav END IGNORE NULLS) OVER (PARTITION BY fund ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  last_value(CASE WHEN nav > 0 THEN date END IGNORE NULLS) OVER (PARTITION BY fund ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS day_before FROM d),
b AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1)
SELECT fund, x.date, CASE WHEN nav > 0 THEN 'kept' WHEN before IS NULL OR a.cents IS NULL OR e.cents IS NULL THEN 'open' ELSE 'repaired' END AS status, CASE WHEN nav > 0 THEN nav WHEN a.cents IS NOT NULL AND e.cents IS NOT NULL THEN round(before * a.cents / e.cents, 6) END AS nav
FROM x LEFT JOIN b a ON a.date = x.date LEFT JOIN b e ON e.date = x.day_before""")
def repaired_values(spark, sf_dir):
    """A value of zero is made anew from the last valid one before it, by the ratio of what was held on both days; without a price or a value before it stays open."""
    o = t.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("fund"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderkey") % 6 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("nav"), F.col("o_orderkey").alias("seq"))
    d = o.groupBy("fund", "date").agg(F.max_by("nav", "seq").alias("nav"))
    w = Window.partitionBy("fund").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(F.when(F.col("nav") > 0, F.col(c)), ignorenulls=True).over(w)
    d = d.withColumns({"before": last("nav"), "day_before": last("date")})
    b = t.read(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.sum(t.cents("l_extendedprice")).alias("cents"))
    d = d.join(b.select("date", F.col("cents").alias("now")), "date", "left").join(b.select(F.col("date").alias("day_before"), F.col("cents").alias("then")), "day_before", "left")
    able = F.col("now").isNotNull() & F.col("then").isNotNull()
    status = F.when(F.col("nav") > 0, "kept").when(F.col("before").isNull() | ~able, "open").otherwise("repaired")
    return d.select("fund", "date", status.alias("status"), F.when(F.col("nav") > 0, F.col("nav")).when(able, F.round(F.col("before") * F.col("now") / F.col("then"), 6)).alias("nav"))


@query("""WITH r AS (SELECT user_id AS source, max(ts) AS last FROM events WHERE event_type <> 'error' GROUP BY 1), h AS (SELECT source, last, ceil((date_sub('second', last, TIMESTAMP '2024-01-31 00:00:00') + 600) / 3600.0::DOUBLE) AS hours FROM r)
SELECT source, CASE WHEN hours > 168 THEN '7d' WHEN hours > 24 THEN CAST(ceil(hours / 24) AS INTEGER) || 'd' ELSE greatest(1, CAST(hours AS INTEGER)) || 'h' END AS since FROM h""")
def incremental_since(spark, sf_dir):
    """B1: how far back the next read goes: since the last success with ten minutes over, up to whole hours, then days, seven at most."""
    last = t.read(spark, sf_dir, "events").where("event_type <> 'error'").groupBy(F.col("user_id").alias("source")).agg(F.max("ts").alias("last"))
    seconds = F.timestamp_diff("SECOND", F.col("last"), F.lit("2024-01-31 00:00:00").cast("timestamp")) + 600
    hours = F.ceil(seconds / 3600.0)
    days = F.ceil(hours / 24).cast("int").cast("string")
    since = F.when(hours > 168, "7d").when(hours > 24, F.concat(days, F.lit("d"))).otherwise(F.concat(F.greatest(F.lit(1), hours.cast("int")).cast("string"), F.lit("h")))
    return last.select("source", since.alias("since"))


@query("""WITH p AS (SELECT user_id AS source, count(*) AS old_n, max(value) AS old_value FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1), n AS (SELECT user_id AS source, count(*) AS new_n, max(value) AS new_value, bool_or(event_type = 'error') AS failed FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT source, CASE WHEN new_n IS NULL OR failed THEN old_n ELSE new_n END AS n, CASE WHEN new_n IS NULL OR failed THEN old_value ELSE new_value END AS value, CASE WHEN new_n IS NOT NULL AND NOT failed THEN 'fresh' WHEN old_n IS NULL THEN 'missing' ELSE 'stale' END AS status FROM p FULL JOIN n USING (source)""")
def retained_slices(spark, sf_dir):
    """A source that failed keeps its previous slice, marked stale; later data replaces it by key."""
    e = t.read(spark, sf_dir, "events").withColumnRenamed("user_id", "source")
    cut = F.lit("2024-01-20").cast("timestamp")
    old = e.where(F.col("ts") < cut).groupBy("source").agg(F.count(F.lit(1)).alias("old_n"), F.max("value").alias("old_value"))
    new = e.where(F.col("ts") >= cut).groupBy("source").agg(F.count(F.lit(1)).alias("new_n"), F.max("value").alias("new_value"), F.bool_or(F.col("event_type") == "error").alias("failed"))
    rows = old.join(new, "source", "full")
    keep = F.col("new_n").isNull() | F.col("failed")
    status = F.when(~keep, "fresh").when(F.col("old_n").isNull(), "missing").otherwise("stale")
    return rows.select("source", F.when(keep, F.col("old_n")).otherwise(F.col("new_n")).alias("n"), F.when(keep, F.col("old_value")).otherwise(F.col("new_value")).alias("value"), status.alias("status"))


@query("""WITH a AS (SELECT l_partkey AS id, CAST(l_shipdate AS DATE) AS date, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS value FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2), b AS (SELECT l_partkey AS id, CAST(l_shipdate AS DATE) AS date, arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS value FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
m AS (SELECT id, date, coalesce(b.value, a.value) AS value FROM a FULL JOIN b USING (id, date)), x AS (SELECT m.*, p_size % 4 = 0 AS own_column FROM m JOIN part ON p_partkey = id), k AS (SELECT x.id, x.date, CASE WHEN own_column THEN b.value ELSE x.value END AS value FROM x LEFT JOIN b ON b.id = x.id AND b.date = x.date WHERE NOT own_column OR b.value IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date DESC) AS rn FROM k) SELECT id, max(date) AS latest, count(*) AS n, arg_max(value, date) AS price, round(100 * (arg_max(value, date) - max(CASE WHEN rn = 2 THEN value END)) / max(CASE WHEN rn = 2 THEN value END), 6) AS move_pct FROM r WHERE rn <= 365 GROUP BY 1""")
def merged_products(spark, sf_dir):
    """Stored and new history by day, the new day first, the last 365 points; a product with a value column of its own keeps only the new one."""
    li = t.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").alias("value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), "l_returnflag")
    one = lambda df: df.groupBy("id", "date").agg(F.max_by("value", "seq").alias("value"))
    own = t.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4 == 0).alias("own_column"))
    old = one(li.where("l_returnflag = 'N'")).join(own, "id").where("not own_column").drop("own_column")
    merged = merging.last_wins(old, one(li.where("l_returnflag <> 'N'")).join(own.select("id"), "id"), ["id", "date"])
    rows = merged.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.col("date").desc()))).where("rn <= 365")
    out = rows.groupBy("id").agg(F.max("date").alias("latest"), F.count(F.lit(1)).alias("n"), F.max_by("value", "date").alias("price"), F.max(F.when(F.col("rn") == 2, F.col("value"))).alias("before"))
    return out.select("id", "latest", "n", "price", F.round(100 * (F.col("price") - F.col("before")) / F.col("before"), 6).alias("move_pct"))


@query("""WITH c AS (SELECT o_custkey AS company, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE o_totalprice / 1000 END AS bp, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'I' || o_orderkey END AS instrument, o_orderpriority AS quality, o_orderkey AS seq FROM orders),
v AS (SELECT * FROM c WHERE bp >= 0 AND instrument IS NOT NULL AND quality <> '5-LOW' AND date <= DATE '2000-12-31'), l AS (SELECT company, date, arg_max(bp, seq) AS bp FROM v GROUP BY 1, 2)
SELECT company, count(*) AS n, max(date) AS latest, arg_max(bp, date) AS latest_bp FROM l GROUP BY 1""")
def normalised_credit(spark, sf_dir):
    """Credit points that are valid (finite, not negative, with an instrument and a known quality, not after the set's date), the last row of a day."""
    o = t.read(spark, sf_dir, "orders")
    bp = F.when(F.col("o_orderkey") % 9 == 0, -1.0).otherwise(F.col("o_totalprice") / 1000)
    rows = o.select(F.col("o_custkey").alias("company"), F.to_date("o_orderdate").alias("date"), bp.alias("bp"), F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("I"), F.col("o_orderkey").cast("string"))).alias("instrument"), F.col("o_orderpriority").alias("quality"), F.col("o_orderkey").alias("seq"))
    rows = rows.where((F.col("bp") >= 0) & F.col("instrument").isNotNull() & (F.col("quality") != "5-LOW") & (F.col("date") <= F.lit("2000-12-31").cast("date")))
    days = rows.groupBy("company", "date").agg(F.max_by("bp", "seq").alias("bp"))
    return days.groupBy("company").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("latest"), F.max_by("bp", "date").alias("latest_bp"))


@query("""WITH m AS (SELECT o_orderkey AS id, o_custkey AS low, o_custkey + o_orderkey % 40 AS high, CASE WHEN o_orderkey % 11 = 0 THEN 'wrong' WHEN o_orderkey % 40 = 0 THEN o_custkey || '万元' ELSE o_custkey || '~' || (o_custkey + o_orderkey % 40) || '万元' END AS shown FROM orders)
SELECT id, shown = CASE WHEN low = high THEN low || '万元' ELSE low || '~' || high || '万元' END AS ok FROM m""")
def published_labels(spark, sf_dir):
    """V7: whether a published range says what its numbers say."""
    low, high = F.col("o_custkey"), F.col("o_custkey") + F.col("o_orderkey") % 40
    label = lambda a, b: F.when(a == b, _joined(a, "万元")).otherwise(_joined(a, "~", b, "万元"))
    shown = F.when(F.col("o_orderkey") % 11 == 0, "wrong").otherwise(label(low, high))
    return t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (shown == label(low, high)).alias("ok"))


@query("""WITH s AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'v2' WHEN 1 THEN 'v1' END AS definition, md5(c_mktsegment) AS members, c_custkey % 4 <> 0 AS standard FROM customer) SELECT c_custkey, coalesce(definition = 'v2', false) AND members = md5('BUILDING') AND standard AS usable FROM s""")
def compatible_cache(spark, sf_dir):
    """V6: stored rows of the present definition, members and mode."""
    k = F.col("c_custkey")
    usable = F.coalesce(F.when(k % 3 == 0, "v2").when(k % 3 == 1, "v1") == "v2", F.lit(False)) & (F.md5("c_mktsegment") == F.md5(F.lit("BUILDING"))) & (k % 4 != 0)
    return t.read(spark, sf_dir, "customer").select("c_custkey", usable.alias("usable"))
