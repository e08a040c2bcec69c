"""News queries: kind, signal, score and event key of headlines, and the merge of an event's headlines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import rules, text
from tickloom.operators import newsfeed as n
from tickloom.plans.register import query
from tickloom.sources import tables as t

#: A headline is put together from an order's keys: who, what, of what.
WHO = ["OpenAI", "Anthropic", "xAI", "Google", "Microsoft", "Amazon", "DeepSeek", "Kimi", "NVIDIA", "TSMC", "Samsung", "SK hynix", "Micron", "China AI firms", "Federal Reserve", "小镇", "Tesla"]
WHAT = ["launches", "is approved to buy", "raises prices of", "announces price cut for", "shortage of", "wins 新订单 for", "weak demand for", "raises capex on", "cuts capex on", "funding for", "客户 库存去化", "天气 and", "需求改善 in"]
OF = ["H200", "GB200", "GPT-5.1", "Grok 4.5", "Claude Opus", "Gemini Pro", "HBM", "DRAM", "NAND flash", "MLCC", "CoWoS", "GPU", "tungsten", "data center", "robot", "白酒", "coffee", "利率"]
SOURCE_TYPES = {"1-URGENT": "official", "2-HIGH": "media", "3-MEDIUM": "newsletter", "4-NOT SPECIFIED": "developer"}
NOW = "1998-06-01 12:00:00"


def headlines(spark, sf_dir):
    """id, source, source_type, title, base, published, hours of a headline for each order."""
    pick = lambda words, key: F.element_at(F.array(*map(F.lit, words)), (key % len(words) + 1).cast("int"))
    o = t.read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    title = F.concat_ws(" ", pick(WHO, F.col("o_custkey")), pick(WHAT, key), pick(OF, F.floor(key / len(WHAT))))
    published = F.col("o_orderdate").cast("timestamp")
    return o.select(
        key.alias("id"),
        F.col("o_custkey").alias("source"),
        rules.value_of(F.col("o_orderpriority"), SOURCE_TYPES, None).alias("source_type"),
        title.alias("title"),
        F.floor(F.col("o_totalprice") / 4000).cast("int").alias("base"),
        published.alias("published"),
        (F.timestamp_diff("SECOND", published, F.lit(NOW).cast("timestamp")) / 3600.0).alias("hours"),
    )


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pick_sql(words, key):
    return f"([{', '.join(map(_q, words))}])[CAST({key} % {len(words)} AS BIGINT) + 1]"


def _found_sql(c, pattern):
    return " AND ".join(f"regexp_matches({c}, {_q(p)})" for p in pattern.split(" & "))


def _case_sql(c, table, default):
    return "CASE " + " ".join(f"WHEN {_found_sql(c, p)} THEN {_q(v)}" for p, v in table) + f" ELSE {default} END"


def _map_sql(c, table, default):
    return f"CASE {c} " + " ".join(f"WHEN {_q(k)} THEN {v if isinstance(v, int) else _q(v)}" for k, v in table.items()) + f" ELSE {default} END"


_NORMAL = "trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9_\\x{4e00}-\\x{9fff}]+', ' ', 'g'), ' +', ' ', 'g'))"
_HEADLINES = f"""heads AS (SELECT o_orderkey AS id, o_custkey AS source, {_map_sql('o_orderpriority', SOURCE_TYPES, 'NULL')} AS source_type,
  {_pick_sql(WHO, 'o_custkey')} || ' ' || {_pick_sql(WHAT, 'o_orderkey')} || ' ' || {_pick_sql(OF, f'(o_orderkey // {len(WHAT)})')} AS title,
  CAST(floor(o_totalprice / 4000) AS INTEGER) AS base, o_orderdate::TIMESTAMP AS published, date_sub('second', o_orderdate::TIMESTAMP, TIMESTAMP '{NOW}') / 3600.0::DOUBLE AS hours FROM orders),
normal AS (SELECT *, {_NORMAL} AS c FROM heads),
kinds AS (SELECT *, {_case_sql('c', n.CATEGORIES, "CASE WHEN source_type IN ('official', 'academic', 'developer') THEN '软件' ELSE '宏观' END")} AS kind, {_case_sql('c', n.SIGNALS, "'普通新闻'")} AS signal FROM normal)"""


@query(f"WITH {_HEADLINES} SELECT id, title, kind, signal FROM kinds")
def headline_kinds(spark, sf_dir):
    """Category by rates, word lists and kind of source; the first of ten signals."""
    c = F.col("title")
    return headlines(spark, sf_dir).select("id", "title", n.category(c, F.col("source_type")).alias("kind"), n.signal(c).alias("signal"))


_WITH_KIND = "trim(regexp_replace(regexp_replace(lower(title || ' ' || kind || ' ' || signal), '[^a-z0-9_\\x{4e00}-\\x{9fff}]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH {_HEADLINES}, w AS (SELECT *, {_WITH_KIND} AS d FROM kinds), f AS (SELECT *, {_found_sql('d', n.HARD)} AS hard, {_found_sql('d', n.DEMAND)} AS demand, {_found_sql('d', n.NOISE)} AS noise FROM w)
SELECT id, CASE WHEN noise AND NOT hard THEN least(base, 72) ELSE greatest(base, 50 + {_map_sql('signal', n.SIGNAL_BOOST, 0)} + {_map_sql('kind', n.CATEGORY_BOOST, 0)}
  + CASE WHEN hours <= 2 THEN 10 WHEN hours <= 6 THEN 8 WHEN hours <= 12 THEN 5 WHEN hours <= 24 THEN 3 ELSE 0 END + {_map_sql('source_type', n.SOURCE_BOOST, 9)} + CAST(least(8, floor(length(title) / 90)) AS INTEGER) + CASE WHEN hard THEN 12 ELSE 0 END
  + CASE WHEN signal = '需求改善' AND demand THEN 10 WHEN signal = '需求改善' THEN -18 ELSE 0 END) END AS score FROM f""")
def headline_scores(spark, sf_dir):
    """Additive score of a headline, noise capped."""
    c = F.col("title")
    rows = headlines(spark, sf_dir).withColumns({"kind": n.category(c, F.col("source_type")), "signal": n.signal(c)})
    return rows.select("id", n.score(c, F.col("source_type"), F.col("base"), F.col("hours"), F.col("kind"), F.col("signal")).alias("score"))


_TOKEN = lambda x: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '\\s+', '-', 'g'), '[^\\w.-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"
_KEYS = f"""{_HEADLINES}, parts AS (SELECT *, {_case_sql('title', n.SUBJECTS, "''")} AS subject,
  CASE {' '.join(f"WHEN regexp_matches(title, {_q(p)}) THEN {_q(k) if k else _TOKEN(f'regexp_extract(title, {_q(p)})')}" for p, k in n.OBJECTS)} END AS thing,
  CASE {' '.join(f"WHEN regexp_matches(title, {_q(p)}) THEN regexp_extract(title, {_q(p)})" for p, _ in n.OBJECTS)} END AS label FROM heads),
acts AS (SELECT *, CASE {' '.join(f"WHEN {_found_sql('title', p.removesuffix(' & model'))}{' AND regexp_matches(label, ' + _q(n.MODEL) + ')' if p.endswith(' & model') else ''} THEN {_q(a)}" for p, a in n.ACTIONS)} END AS action FROM parts),
keyed AS (SELECT *, CASE WHEN thing IS NOT NULL AND action IS NOT NULL AND (subject <> '' OR action NOT IN ({', '.join(map(_q, n.NEED_SUBJECT))})) THEN 'event:' || CASE WHEN subject <> '' THEN subject ELSE thing END || ':' || action || ':' || thing END AS event FROM acts)"""


@query(f"WITH {_KEYS} SELECT id, title, event FROM keyed")
def headline_events(spark, sf_dir):
    """Canonical event key of a headline, by subject, action and object."""
    return headlines(spark, sf_dir).select("id", "title", n.event_key(F.col("title")).alias("event"))


@query(f"""WITH {_KEYS}, k AS (SELECT *, coalesce(event, 'title:' || regexp_replace(lower(title), '[^a-z0-9_\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')) AS key FROM keyed)
SELECT key, count(*) AS n, count(DISTINCT source) AS n_sources, max(base) + least(24, 6 * (count(DISTINCT source) - 1)) AS score, max(published) AS last_seen,
  arg_max(id, lpad(base::VARCHAR, 9, '0') || strftime(published, '%Y%m%d%H%M%S') || lpad(id::VARCHAR, 12, '0')) AS id FROM k GROUP BY 1""")
def headline_merge(spark, sf_dir):
    """Headlines of one event (else one title) become one: sources united, six points for each further one up to 24, the stronger row, the later time."""
    title = F.col("title")
    plain = F.concat(F.lit("title:"), F.regexp_replace(F.lower(title), r"[^a-z0-9_\x{4e00}-\x{9fff}]+", ""))
    rows = headlines(spark, sf_dir).withColumn("key", F.coalesce(n.event_key(title), plain))
    out = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"), F.max("base").alias("best"), F.max("published").alias("last_seen"), F.max_by("id", F.struct("base", "published", "id")).alias("id"))
    return out.select("key", "n", "n_sources", (F.col("best") + F.least(F.lit(24), 6 * (F.col("n_sources") - 1))).alias("score"), "last_seen", "id")


@query(f"""WITH {_HEADLINES} SELECT kind, source_type, title, id FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY base DESC, id) AS rn FROM kinds) WHERE rn <= 20 AND (contains(lower(title), 'gpu') OR contains(lower(kind), '硬件'))""")
def headline_view(spark, sf_dir):
    """What a reader sees who picks a kind and searches: the best twenty of each kind that hold the query."""
    c = F.col("title")
    rows = headlines(spark, sf_dir).withColumn("kind", n.category(c, F.col("source_type")))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("base").desc(), "id"))).where("rn <= 20")
    return rows.where(F.contains(F.lower("title"), F.lit("gpu")) | F.contains(F.lower("kind"), F.lit("硬件"))).select("kind", "source_type", "title", "id")


#: Keywords of a watch, and those that sources of broad interest must meet.
WATCHED, STRICT = ["AI", "GPU", "HBM", "芯片", "白酒", "capex"], ["GPU", "HBM"]
_WORD_SQL = lambda words: " OR ".join(f"regexp_matches(lower(title), '(^|[^a-z0-9_])' || {_q(w.lower())} || '($|[^a-z0-9_])')" if w.isascii() else f"contains(title, {_q(w)})" for w in words)


@query(f"WITH {_HEADLINES} SELECT id, CASE WHEN source_type = 'official' THEN {_WORD_SQL(STRICT)} ELSE {_WORD_SQL(WATCHED)} END AS relevant FROM heads")
def headline_relevance(spark, sf_dir):
    """Whether a keyword stands in the text: ASCII ones as whole words, a stricter list for broad sources."""
    c, low = F.col("title"), F.lower("title")
    met = lambda words: F.coalesce(*[F.when((low if w.isascii() else c).rlike(rules.whole_word(w)), True) for w in words], F.lit(False))
    return headlines(spark, sf_dir).select("id", F.when(F.col("source_type") == "official", met(STRICT)).otherwise(met(WATCHED)).alias("relevant"))


@query(f"""WITH {_HEADLINES} SELECT id, array_to_string(list_filter([{', '.join(f"CASE WHEN contains(lower(title), {_q(w.lower())}) THEN {_q(w)} END" for w in WATCHED)}], lambda x: x IS NOT NULL)[1:3], '、') AS reason FROM heads WHERE {' OR '.join(f"contains(lower(title), {_q(w.lower())})" for w in WATCHED)}""")
def headline_themes(spark, sf_dir):
    """Headlines that hold a keyword, with the first three they hold as the reason."""
    held = F.array_compact(F.array(*[F.when(F.contains(F.lower("title"), F.lit(w.lower())), F.lit(w)) for w in WATCHED]))
    return headlines(spark, sf_dir).select("id", held.alias("held")).where("size(held) > 0").select("id", F.array_join(F.slice("held", 1, 3), "、").alias("reason"))


@query(f"""WITH {_HEADLINES}, x AS (SELECT id, CASE id % 4 WHEN 0 THEN lpad((id % 24)::VARCHAR, 2, '0') || ':' || lpad((id % 60)::VARCHAR, 2, '0') WHEN 1 THEN (id % 50) || '分钟前' WHEN 2 THEN (id % 20) || '小时前' ELSE '昨天' END AS shown, published + INTERVAL 13 HOUR AS archived FROM heads),
p AS (SELECT *, CASE WHEN shown LIKE '%:%' THEN archived::DATE + INTERVAL (split_part(shown, ':', 1)::INTEGER) HOUR + INTERVAL (split_part(shown, ':', 2)::INTEGER) MINUTE
  WHEN shown LIKE '%分钟%' THEN archived - INTERVAL (regexp_extract(shown, '[0-9]+')::INTEGER) MINUTE WHEN shown LIKE '%小时%' THEN archived - INTERVAL (regexp_extract(shown, '[0-9]+')::INTEGER) HOUR END AS seen FROM x)
SELECT id, shown, CASE WHEN seen > archived THEN seen - INTERVAL 1 DAY ELSE seen END AS seen FROM p""")
def relative_times(spark, sf_dir):
    """a clock time, minutes or hours ago, read against the time of the archive; a clock time still to come was the day before's."""
    k = F.col("id")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    shown = F.when(k % 4 == 0, F.concat(two(k % 24), F.lit(":"), two(k % 60))).when(k % 4 == 1, F.concat((k % 50).cast("string"), F.lit("分钟前"))).when(k % 4 == 2, F.concat((k % 20).cast("string"), F.lit("小时前"))).otherwise("昨天")
    rows = headlines(spark, sf_dir).select("id", shown.alias("shown"), (F.col("published") + F.expr("interval 13 hours")).alias("archived"))
    return rows.select("id", "shown", text.relative_time(F.col("shown"), F.col("archived")).alias("seen"))
