"""Text joins of positions, funds and evidence without pairs: names, codes, aliases and themes stand anywhere in a text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.operators import containment, windows
from tickloom.plans.portfolio import _POS, positions
from tickloom.plans.register import query
from tickloom.sources import tables as t
from tickloom.sources.scratch import cut

#: A company's name has no borders: its number in letters of a script without spaces. One in seven has an alias.
_DIGITS, _HAN, _LATIN = "0123456789", "甲乙丙丁戊己庚辛壬癸", "abcdefghij"
#: Words that stand for a theme if a fund's name holds its keyword: a table of the user's.
THEMES = [("存储", "hbm"), ("存储", "dram"), ("机器人", "人形机器人"), ("机器人", "unitree"), ("germany", "dax")]
_TAILS = ["/存储", " 机器人", "-半导体", ""]
_MARKETS = ["美股", "港股", ""]

_NAME = lambda c: f"translate(({c})::VARCHAR, '{_DIGITS}', '{_HAN}')"
_TICK = lambda c: f"translate(({c})::VARCHAR, '{_DIGITS}', '{_LATIN}')"
_pick = lambda words, key: f"[{', '.join(repr(w) for w in words)}][({key}) % {len(words)} + 1]"

#: What is written of a company on a day, up or down: by name, ticker, alias or code; some texts of a theme.
_EVIDENCE = f"""ev AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, o_orderkey % 3 AS kind,
  CASE o_orderkey % 5 WHEN 0 THEN '快讯' || {_NAME('o_custkey // 10')} || '公司订单' WHEN 1 THEN 'news of $' || {_TICK('o_custkey // 10')} || ', today' WHEN 2 THEN 'x' || {_TICK('o_custkey // 10')} || 'y' WHEN 3 THEN 'the co-' || {_TICK('o_custkey // 10')} || 'group' ELSE lpad((o_custkey // 10)::VARCHAR, 6, '0') || '公告' END
  || CASE o_custkey % 6 WHEN 0 THEN ' hbm涨价' WHEN 1 THEN ' 人形机器人量产' WHEN 2 THEN ' ' || lower(n_name) ELSE '' END AS text,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS polarity FROM orders JOIN nation ON n_nationkey = o_orderkey % 25)"""


def evidence(spark, sf_dir):
    o, key, c = t.read(spark, sf_dir, "orders"), F.col("o_orderkey"), F.floor(F.col("o_custkey") / 10).cast("string")
    tick, status, theme = F.translate(c, _DIGITS, _LATIN), F.col("o_orderstatus"), F.col("o_custkey") % 6
    about = F.when(key % 5 == 0, F.concat(F.lit("快讯"), F.translate(c, _DIGITS, _HAN), F.lit("公司订单"))).when(key % 5 == 1, F.concat(F.lit("news of $"), tick, F.lit(", today"))).when(key % 5 == 2, F.concat(F.lit("x"), tick, F.lit("y")))
    about = about.when(key % 5 == 3, F.concat(F.lit("the co-"), tick, F.lit("group"))).otherwise(F.concat(F.lpad(c, 6, "0"), F.lit("公告")))
    themed = F.when(theme == 0, " hbm涨价").when(theme == 1, " 人形机器人量产").when(theme == 2, F.concat(F.lit(" "), F.lower("n_name"))).otherwise("")
    rows = o.join(t.read(spark, sf_dir, "nation"), key % 25 == F.col("n_nationkey"))
    return rows.select(key.alias("id"), F.to_date("o_orderdate").alias("date"), (key % 3).alias("kind"), F.concat(about, themed).alias("text"), F.when(status == "F", 1).when(status == "O", -1).otherwise(0).alias("polarity"))


_NEEDLES = f"""nd AS (SELECT s_suppkey AS code, unnest([{{'n': {_NAME('s_suppkey')}, 'w': false}}, {{'n': {_TICK('s_suppkey')}, 'w': true}}, {{'n': lpad(s_suppkey::VARCHAR, 6, '0'), 'w': false}}, {{'n': CASE WHEN s_suppkey % 7 = 0 THEN 'co-' || {_TICK('s_suppkey')} END, 'w': false}}]) AS x FROM supplier),
own AS (SELECT code, x.n AS needle, x.w AS whole FROM nd WHERE x.n IS NOT NULL)"""
_HOLDS = "CASE WHEN whole THEN regexp_matches(ev.text, '(^|[^a-zA-Z0-9])' || needle || '([^a-zA-Z0-9]|$)') ELSE contains(ev.text, needle) END"


def needles_of_companies(spark, sf_dir):
    """code, needle, whole: name, ticker (as a word of its own), six-digit code and alias of each company."""
    s = F.col("s_suppkey").cast("string")
    tick = F.translate(s, _DIGITS, _LATIN)
    each = [(F.translate(s, _DIGITS, _HAN), False), (tick, True), (F.lpad(s, 6, "0"), False), (F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("co-"), tick)), False)]
    listed = F.explode(F.array(*[F.struct(n.alias("needle"), F.lit(w).alias("whole")) for n, w in each])).alias("x")
    return t.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), listed).select("code", "x.needle", "x.whole").where("needle IS NOT NULL")


_MOVES = f"""{t.BARS}, mv AS (SELECT code, date, 100.0::DOUBLE * (close / lag(close) OVER (PARTITION BY code ORDER BY date) - 1) AS pct FROM bars), big AS (SELECT code, date, pct FROM mv WHERE abs(pct) >= 30)"""


def moves(spark, sf_dir):
    w = windows.by(["code"])
    rows = t.daily_bars(spark, sf_dir).select("code", "date", (100.0 * (F.col("close") / F.lag("close").over(w) - 1)).alias("pct"))
    return rows.where("abs(pct) >= 30")


def _texts_of(spark, sf_dir, needles):
    """id, date, kind, polarity and needle, whole: texts are searched once for all distinct needles."""
    rows = evidence(spark, sf_dir).select(F.struct("id", "date", "kind", "polarity").alias("about"), "text")
    return containment.found_in(rows, needles, "about", "text").select("about.*", "needle", "whole")  # what is kept of a text goes with it, not into a join


_SUPPORTS = "(polarity = 0 OR (polarity > 0) = (pct >= 0))"
_DIRECT = f"dd AS (SELECT DISTINCT b.code, b.date, ev.id, ev.kind FROM big b JOIN ev ON ev.date = b.date JOIN own ON own.code = b.code AND {_HOLDS} WHERE {_SUPPORTS})"


def _named(spark, sf_dir):
    """code, date, id, kind, polarity of each piece of evidence that names a code, once."""
    own = needles_of_companies(spark, sf_dir)
    named = _texts_of(spark, sf_dir, own.select("needle", "whole")).join(own, ["needle", "whole"])
    return named.select("code", "date", "id", "kind", "polarity").distinct()


def _directly(spark, sf_dir, rows):
    """code, date, id, kind of each piece of evidence that names a moved code in its direction, once."""
    met = rows.select("code", "date", "pct").join(_named(spark, sf_dir), ["code", "date"])
    return met.where((F.col("polarity") == 0) | ((F.col("polarity") > 0) == (F.col("pct") >= 0))).select("code", "date", "id", "kind")


@query(f"""WITH {_MOVES}, {_EVIDENCE}, {_NEEDLES}, {_DIRECT} SELECT code, date, count(*) AS n, min(id) AS first_id, arg_min(kind, id) AS first_kind FROM dd GROUP BY 1, 2""")
def direct_evidence(spark, sf_dir):
    """What a day's evidence says of a code by name, ticker, code or alias, in the direction it moved."""
    met = _directly(spark, sf_dir, moves(spark, sf_dir))
    return met.groupBy("code", "date").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.min_by("kind", "id").alias("first_kind"))


#: A fund for each nation: its name with a market before and a theme behind.
_FUNDS = f"""fn AS (SELECT n_nationkey AS fund, {_pick(_MARKETS, 'n_nationkey')} || lower(n_name) || {_pick(_TAILS, 'n_nationkey')} AS name FROM nation),
al AS (SELECT unnest([{', '.join(f"{{'k': '{k}', 'a': '{a}'}}" for k, a in THEMES)}], recursive := true)),
kw AS (SELECT DISTINCT fund, needle FROM (SELECT fund, unnest(list_concat([name, regexp_replace(name, '^(美股|港股)', '')], string_split_regex(regexp_replace(name, '^(美股|港股)', ''), '[/ -]+'))) AS needle FROM fn UNION ALL SELECT fund, a FROM fn JOIN al ON contains(name, k)) WHERE length(needle) >= 2)"""


def theme_words(spark, sf_dir):
    """fund, needle: a fund's name, the same without its market, its words, and aliases of what its name holds."""
    pick = lambda words, key: F.element_at(F.array(*map(F.lit, words)), (key % len(words) + 1).cast("int"))
    key = F.col("n_nationkey")
    funds = t.read(spark, sf_dir, "nation").select(key.alias("fund"), F.concat(pick(_MARKETS, key), F.lower("n_name"), pick(_TAILS, key)).alias("name"))
    bare = F.regexp_replace("name", "^(美股|港股)", "")
    words = funds.select("fund", F.explode(F.concat(F.array("name", bare), F.split(bare, "[/ -]+"))).alias("needle"))
    aliases = spark.createDataFrame(THEMES, "needle string, alias string")
    held = containment.found_in(funds, aliases.select("needle", F.lit(False).alias("whole")), "fund", "name").join(aliases, "needle")
    return words.unionByName(held.select("fund", F.col("alias").alias("needle"))).where(F.char_length("needle") >= 2).distinct()


_LADDER = f"""{_MOVES}, {_EVIDENCE}, {_NEEDLES}, {_FUNDS}, {_DIRECT}, d AS (SELECT code, date, count(*) AS direct, arg_min(kind, id) AS first_kind FROM dd GROUP BY 1, 2),
bf AS (SELECT b.*, s_nationkey AS fund FROM big b JOIN supplier ON s_suppkey = b.code),
te AS (SELECT DISTINCT fund, ev.id, ev.date, ev.polarity FROM kw JOIN ev ON contains(ev.text, needle)),
m AS (SELECT b.code, b.date, count(*) AS themed FROM bf b JOIN te ON te.fund = b.fund AND te.date = b.date AND {_SUPPORTS} GROUP BY 1, 2)"""


@query(f"""WITH {_LADDER}, x AS (SELECT b.code, b.date, b.pct, coalesce(direct, 0) AS direct, first_kind, coalesce(themed, 0) AS themed, count(*) OVER (PARTITION BY b.date, fund) AS abnormal FROM bf b LEFT JOIN d ON d.code = b.code AND d.date = b.date LEFT JOIN m ON m.code = b.code AND m.date = b.date)
SELECT code, date, round(pct, 6) AS pct, CASE WHEN direct > 0 THEN 'direct' WHEN themed > 0 THEN 'theme' WHEN abnormal >= 2 THEN 'peers' ELSE 'unknown' END AS reason, first_kind AS kind, CASE WHEN direct > 0 THEN 'high' WHEN themed > 0 OR abnormal >= 2 THEN 'middle' ELSE 'low' END AS confidence, least(direct, 3) AS n_sources FROM x""")
def attributed_moves(spark, sf_dir):
    """Why a code moved: its own evidence and its kind, its fund's theme, two abnormal peers of the fund, or unknown, with confidence and up to three sources."""
    funds = t.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("fund"))
    rows = moves(spark, sf_dir).join(funds, "code")
    # both directions of a code's day in one row, so that moves are made and joined once
    of = lambda test: (F.count_if(test), F.min_by("kind", F.when(test, F.col("id"))))
    (up, up_kind), (down, down_kind) = of(F.col("polarity") >= 0), of(F.col("polarity") <= 0)
    direct = _named(spark, sf_dir).groupBy("code", "date").agg(up.alias("own_up"), down.alias("own_down"), up_kind.alias("up_kind"), down_kind.alias("down_kind"))
    # a text that holds several words of a fund counts once; then one row for each fund and day
    words = theme_words(spark, sf_dir).withColumn("whole", F.lit(False))
    texts = _texts_of(spark, sf_dir, words.select("needle", "whole")).join(words, ["needle", "whole"]).select("fund", "date", "id", "polarity").distinct()
    themed = texts.groupBy("fund", "date").agg(F.count_if(F.col("polarity") >= 0).alias("up"), F.count_if(F.col("polarity") <= 0).alias("down"))
    rows = rows.join(direct, ["code", "date"], "left").join(themed, ["fund", "date"], "left")
    rows = rows.withColumn("abnormal", F.count(F.lit(1)).over(Window.partitionBy("date", "fund")))
    c = F.col
    side = lambda up, down: F.when(c("pct") >= 0, c(up)).otherwise(c(down))
    themed_n, direct_n, kind = F.coalesce(side("up", "down"), F.lit(0)), F.coalesce(side("own_up", "own_down"), F.lit(0)), side("up_kind", "down_kind")
    reason = F.when(direct_n > 0, "direct").when(themed_n > 0, "theme").when(c("abnormal") >= 2, "peers").otherwise("unknown")
    confidence = F.when(direct_n > 0, "high").when((themed_n > 0) | (c("abnormal") >= 2), "middle").otherwise("low")
    return rows.select("code", "date", F.round("pct", 6).alias("pct"), reason.alias("reason"), kind.alias("kind"), confidence.alias("confidence"), F.least(direct_n, F.lit(3)).alias("n_sources"))


_THEMED = f"""{_POS}, s AS (SELECT fund, sum(shares * coalesce(current, cost)) AS now, sum(shares * coalesce(prev, current, cost)) AS before FROM pos GROUP BY 1),
f AS (SELECT c_custkey AS fund, replace(CASE c_custkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN lower(n_name || c_mktsegment) ELSE lower(c_mktsegment) END, ' ', '') AS theme, round(CASE WHEN before > 0 THEN 100 * (now - before) / before ELSE 0 END, 6) AS ret FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN s ON s.fund = c_custkey)"""


@query(f"""WITH {_THEMED}, th AS (SELECT DISTINCT theme FROM f), pr AS (SELECT a.theme, b.theme AS near FROM th a JOIN th b ON contains(a.theme, b.theme) OR contains(b.theme, a.theme)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY abs(ret) DESC, fund) AS place FROM f) WHERE place <= 4),
p AS (SELECT f.fund, b.fund AS other, b.ret, row_number() OVER (PARTITION BY f.fund ORDER BY abs(b.ret) DESC, b.fund) AS rank FROM f JOIN pr ON pr.theme = f.theme JOIN best b ON b.theme = pr.near AND b.fund <> f.fund)
SELECT fund, other, ret, rank FROM p WHERE rank <= 3""")
def related_funds(spark, sf_dir):
    """The three other funds that moved most among those whose theme is a fund's own, holds it or stands in it.

    Themes are matched, not funds: of each theme only the four that moved most can be among a fund's three, and of all
    themes near to one again only four, so every fund meets four rows.
    """
    now, before = F.sum(F.col("shares") * F.coalesce("current", "cost")), F.sum(F.col("shares") * F.coalesce("prev", "current", "cost"))
    returns = positions(spark, sf_dir).groupBy("fund").agg(now.alias("now"), before.alias("before"))
    returns = returns.select("fund", F.round(F.when(F.col("before") > 0, 100 * (F.col("now") - F.col("before")) / F.col("before")).otherwise(0.0), 6).alias("ret"))
    k, name, segment = F.col("c_custkey"), F.lower("n_name"), F.lower("c_mktsegment")
    theme = F.replace(F.when(k % 3 == 0, name).when(k % 3 == 1, F.concat(name, segment)).otherwise(segment), F.lit(" "), F.lit(""))
    customers = t.read(spark, sf_dir, "customer").join(t.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    funds = cut(customers.select(k.alias("fund"), theme.alias("theme")).join(returns, "fund"))  # a row a fund, read several times below; its positions move once
    foremost = lambda df: df.withColumn("at", F.row_number().over(Window.partitionBy("theme").orderBy(F.abs("ret").desc(), "fund"))).where("at <= 4")
    best = foremost(funds)
    themes = funds.select("theme").distinct()
    within = containment.found_in(themes, themes.select(F.col("theme").alias("needle"), F.lit(False).alias("whole")), "theme", "theme").select(F.col("theme").alias("a"), F.col("needle").alias("b"))
    near = within.unionByName(within.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    pool = foremost(near.join(best.drop("at").withColumnRenamed("theme", "b"), "b").select(F.col("a").alias("theme"), "fund", "ret"))
    first = pool.groupBy("theme").agg(F.sort_array(F.collect_list(F.struct("at", F.col("fund").alias("other"), "ret"))).alias("first"))
    rows = funds.select("fund", "theme").join(first, "theme").withColumn("others", F.slice(F.filter("first", lambda x: x["other"] != F.col("fund")), 1, 3))
    return rows.select("fund", F.posexplode("others").alias("at", "o")).select("fund", "o.other", "o.ret", (F.col("at") + 1).cast("long").alias("rank"))
