"""Filing queries: scores by rule tables, neutral titles, kinds, adjusters, suppression, and facts in texts."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import rules
from tickloom.operators import announcements as a
from tickloom.plans.headlines import _pick_sql, _q
from tickloom.plans.register import query
from tickloom.sources import tables as t

#: A filing's title, chosen by an order line's keys.
TITLES = [
    "关于控股股东增持公司股份的公告", "关于控股股东、董事长增持公司股份的公告", "关于董事增持股份的公告", "股东减持股份结果的公告", "5%以上股东减持股份计划的公告", "关于控股股东自愿承诺不减持股份的公告",
    "关于首次回购股份的公告", "关于回购股份用于员工持股计划的公告", "限制性股票激励计划（草案）", "关于调整限制性股票授予价格的公告", "关于项目中标的公告", "关于签订重大合同的公告", "关于公司股票可能被终止上市的风险提示", "关于公司股票实施其他风险警示的公告",
    "关于收到立案告知书的公告", "2023年半年度业绩预告", "关于重大资产重组实施完成的公告", "关于新药获得临床试验批准的公告", "关于签署战略合作协议的公告", "关于扩产项目的公告", "关于收到行政处罚决定书的公告", "关于控股股东破产重整的公告", "独立董事关于回购股份的意见", "关于年报的更正公告", "关于日常经营的公告",
    "关于撤销部分其他风险警示", "关于撤销退市风险警示", "关于撤销部分退市风险警示", "关于限制性股票激励计划首次授予登记完成", "关于股票期权激励计划解锁条件成就", "关于签订日常经营合同暨重大合同", "关于回购股份注销减资", "关于股东增持股份计划",
]
#: What stands before and after it.
BEFORE = ["", "关于公司", "广东某律师事务所", "*ST", "控股股东", "2024年", "北京子公司"]
AFTER = ["", "的公告", "进展", "实施完毕", "之专项核查意见", "（草案）", "结果", "暨继续被实施其他风险警示", "的提示性公告", "正式发布", "法律意见书"]


def filings(spark, sf_dir):
    """id, code, company, date, title, share_pct (of a contract in the year's revenue)."""
    li = t.read(spark, sf_dir, "lineitem")
    key = F.col("l_partkey") * 3 + F.col("l_linenumber")
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    title = F.concat(pick(BEFORE, F.col("l_suppkey")), pick(TITLES, key), pick(AFTER, F.col("l_orderkey")))
    company = F.concat(F.when(F.col("l_suppkey") % 9 == 0, "*ST").otherwise("Co"), F.col("l_suppkey").cast("string"))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("code"), company.alias("company"), F.to_date("l_shipdate").alias("date"), title.alias("title"), (F.col("l_discount") * 300).alias("share_pct"))


def _hit_sql(i, pattern, weight, label):
    made = lambda text, w, f: f"{{'ord': {i}, 'label': {_q(text)}, 'w': {w}, 'f': '{f}'}}"
    family = "reduce" if "减持" in label else "increase" if "增持" in label else "other"
    cases = [f"WHEN regexp_matches(title, {_q(a.NO_SELL)}) THEN {made('自愿不减持', 3, 'other')}"] if family == "reduce" else []
    for must, unless, labels, mark in a.NEUTRALISERS:
        if re.search(labels, label):
            met = [f"regexp_matches(title || ' ' || company, {_q(p[1:])})" if p.startswith("@") else f"regexp_matches(title, {_q(p)})" for p in must]
            cases.append("WHEN " + " AND ".join(met + ([f"NOT regexp_matches(title, {_q(unless)})"] if unless else [])) + f" THEN {made(label + mark, 0, 'none')}")
    out = f"CASE {' '.join(cases)} ELSE {made(label, weight, family)} END" if cases else made(label, weight, family)
    return f"CASE WHEN regexp_matches(title, {_q(pattern)}) THEN {out} END"


_FILINGS = f"""f AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS code, CASE WHEN l_suppkey % 9 = 0 THEN '*ST' ELSE 'Co' END || l_suppkey AS company, CAST(l_shipdate AS DATE) AS date,
  {_pick_sql(BEFORE, 'l_suppkey')} || {_pick_sql(TITLES, '(l_partkey * 3 + l_linenumber)')} || {_pick_sql(AFTER, 'l_orderkey')} AS title, l_discount * 300 AS share_pct FROM lineitem),
h AS (SELECT *, list_filter([{', '.join(_hit_sql(i, *s) for i, s in enumerate(a.SIGNALS))}], lambda x: x IS NOT NULL) AS hs FROM f)"""


def _points(hs):
    """The score of a list of hits: the strongest of each family, and the sum of the others."""
    best = lambda f: f"coalesce(list_sort(list_transform(list_filter({hs}, lambda x: x.f = '{f}'), lambda x: {{'a': -abs(x.w), 'o': x.ord, 'w': x.w}}))[1].w, 0)"
    return f"CAST({best('reduce')} + {best('increase')} + coalesce(list_sum(list_transform(list_filter({hs}, lambda x: x.f = 'other'), lambda x: x.w)), 0) AS INTEGER)"


_HAS = lambda hs, test: f"len(list_filter({hs}, lambda x: {test})) > 0"
_SCORES = f"""{_FILINGS}, scored AS (SELECT id, code, date, {_points('hs')} AS score, CAST(len(hs) AS INTEGER) AS n_hits,
  CASE {' '.join(f"WHEN {_HAS('hs', f'regexp_matches(x.label, {_q(p)})')} THEN {_q(name)}" for p, name in a.KINDS)} ELSE '其他' END AS kind, CASE {' '.join(f"WHEN regexp_matches(title, {_q(p)}) THEN {_q(r)}" for p, r in a.NEUTRAL)} END AS reason FROM h)"""


def _scored(spark, sf_dir):
    rows = filings(spark, sf_dir)
    rows = rows.withColumn("hits", a.hits(F.col("title"), F.col("company")))
    return rows.select("id", "code", "date", "share_pct", "hits", a.total(a.counted(F.col("hits"))).alias("score"), F.size("hits").alias("n_hits"), a.kind(F.col("hits")).alias("kind"), a.neutral(F.col("title")).alias("reason"))


@query(f"WITH {_SCORES} SELECT id, score, n_hits, kind, reason, score BETWEEN -6 AND -1 AS mild FROM scored")
def filing_scores(spark, sf_dir):
    """Rules met with neutralisers and families, kind by labels, the first neutral reason, the mild bucket."""
    return _scored(spark, sf_dir).select("id", "score", "n_hits", "kind", "reason", F.col("score").between(-6, -1).alias("mild"))


_BOTH = f"{_HAS('hs', "x.label = '大股东大额增持'")} AND {_HAS('hs', "x.label = '董监高/管理层增持'")}"
_WEIGHT = "CASE WHEN x.label IN ('中标', '重大合同') AND share_pct >= 20 THEN 5 WHEN x.label IN ('中标', '重大合同') AND share_pct >= 5 THEN 3 ELSE x.w END"


@query(f"""WITH {_FILINGS}, b AS (SELECT *, {_BOTH} AS was_both FROM h WHERE len(hs) > 0),
k AS (SELECT id, was_both, list_transform(list_filter(hs, lambda x: NOT (was_both AND x.label = '大股东大额增持')), lambda x: {{'ord': x.ord, 'f': x.f, 'w': {_WEIGHT}}}) AS ks FROM b) SELECT id, {_points('ks')} AS score, was_both FROM k""")
def filing_adjusted(spark, sf_dir):
    """X11: scores after a holder who manages counts once and income is weighed by its share of the revenue."""
    def made(hits):
        kept = a.one_holder(hits)
        return F.struct(F.size(hits).alias("n"), a.total(a.counted(a.by_revenue(kept, F.col("share_pct")))).alias("score"), (F.size(kept) < F.size(hits)).alias("was_both"))

    rows = filings(spark, sf_dir)
    # a filter on the hits would look for them once more; an array of one row or none is made of them once
    met = F.filter(F.array(rules.once(a.hits(F.col("title"), F.col("company")), made)), lambda x: x["n"] > 0)
    return rows.select("id", F.inline(met)).select("id", "score", "was_both")


@query(f"""WITH {_SCORES}, g AS (SELECT code, date, max(CASE WHEN score > 0 THEN score END) AS top, min(CASE WHEN score < 0 THEN score END) AS bottom,
  arg_max(id, CASE WHEN score > 0 THEN score * 10000000000 - id END) AS good_id, arg_max(kind, CASE WHEN score > 0 THEN score * 10000000000 - id END) AS good_kind,
  arg_max(id, CASE WHEN score < 0 THEN -score * 10000000000 - id END) AS bad_id, arg_max(kind, CASE WHEN score < 0 THEN -score * 10000000000 - id END) AS bad_kind FROM scored WHERE reason IS NULL GROUP BY 1, 2)
SELECT code, date, CASE WHEN top IS NOT NULL AND NOT (good_kind = '新药' AND bottom IS NOT NULL) THEN good_id END AS good_id, CASE WHEN bottom IS NOT NULL AND NOT (bad_kind = '减持' AND top IS NOT NULL) THEN bad_id END AS bad_id FROM g""")
def filing_suppression(spark, sf_dir):
    """A company's best and worst filing of a day; approvals give way to anything bad, sales by holders to anything good."""
    rows = _scored(spark, sf_dir).where("reason is null")
    score = F.col("score")
    first = lambda test, size: F.min(F.when(test, F.struct((-size).alias("size"), F.col("id"), F.col("kind"))))
    both = rows.groupBy("code", "date").agg(first(score > 0, score).alias("good"), first(score < 0, -score).alias("bad"))
    good = F.when(~((F.col("good.kind") == "新药") & F.col("bad").isNotNull()), F.col("good.id"))
    bad = F.when(~((F.col("bad.kind") == "减持") & F.col("good").isNotNull()), F.col("bad.id"))
    return both.select("code", "date", good.alias("good_id"), bad.alias("bad_id"))


#: (label, score, pattern) of risks; the lowest score is the result.
RISKS = [("终止上市", -10, "终止上市|退市"), ("立案", -10, "立案"), ("风险警示", -7, "风险警示"), ("处罚", -6, "处罚"), ("减持", -5, "减持"), ("重整", -8, "重整")]


@query(f"""WITH {_FILINGS}, m AS (SELECT id, code, title, list_filter([{', '.join(f"CASE WHEN regexp_matches(title, {_q(p)}) THEN {{'score': {s}, 'label': {_q(x)}}} END" for x, s, p in RISKS)}], lambda x: x IS NOT NULL) AS found FROM f),
w AS (SELECT id, code, title, len(found) AS n, list_sort(found)[1].score AS score, list_sort(found)[1].label AS label FROM m WHERE len(found) > 0)
SELECT id, score, label, n, CASE WHEN score <= -10 THEN '重大风险' WHEN score <= -7 THEN '高风险' WHEN score <= -5 THEN '中高风险' ELSE '观察项' END AS level, row_number() OVER (PARTITION BY code ORDER BY score, title, id) AS place FROM w""")
def risk_titles(spark, sf_dir):
    """All risks a title names, the lowest score and its level; a company's risks in order of score and title."""
    found = F.array_compact(F.array(*[F.when(F.col("title").rlike(p), F.struct(F.lit(s).alias("score"), F.lit(x).alias("label"))) for x, s, p in RISKS]))
    rows = filings(spark, sf_dir).withColumn("found", found).where("size(found) > 0").withColumn("worst", F.array_min("found"))
    score = F.col("worst.score")
    level = F.when(score <= -10, "重大风险").when(score <= -7, "高风险").when(score <= -5, "中高风险").otherwise("观察项")
    place = F.row_number().over(Window.partitionBy("code").orderBy(score, "title", "id")).cast("long")
    return rows.select("id", score.alias("score"), F.col("worst.label").alias("label"), F.size("found").cast("long").alias("n"), level.alias("level"), place.alias("place"))


_NAME_RULES = [("银行|证券", "金融"), ("药|医", "医药"), ("small|brass", "五金"), ("large|steel", "钢材")]


@query(f"""SELECT p_partkey, CASE WHEN p_size = 7 THEN '家电' {' '.join(f"WHEN regexp_matches(p_name, {_q(p)}) THEN {_q(x)}" for p, x in _NAME_RULES)} ELSE '其他' END AS industry FROM part""")
def industry_of(spark, sf_dir):
    """Industry by the table of codes first, then by patterns of the name."""
    from tickloom.functions import rules

    parts = t.read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")
    table = spark.createDataFrame([(7, "家电")], "size int, known string")
    rows = parts.join(F.broadcast(table), F.col("p_size") == F.col("size"), "left")  # a table of codes, one row
    return rows.select("p_partkey", F.coalesce("known", rules.first(F.col("p_name"), _NAME_RULES, "其他")).alias("industry"))


REPORT_TITLES = ["2023年年度报告", "2023 年半年度报告（修订版）", "2022年第三季度报告", "2024年一季度报告全文", "2023年年度报告摘要", "2023年年度报告全文（英文版）", "关于2023年年度报告的补充公告", "2023年半年度报告的说明", "2021年年报", "<em>2023</em>年第一季度报告更正后", "业绩快报"]


def _report_sql():
    plain = "regexp_replace(translate(regexp_replace(title, '(?i)</?em>', '', 'g'), '：（）', ':()'), '\\s+', '', 'g')"
    rest = rf"[-—_·:：.。]*(?:{a.VERSION}|\({a.VERSION}\))*[-—_·:：.。]*$"
    kind = " ".join(f"WHEN regexp_matches(p, {_q(x)}) THEN CASE WHEN regexp_matches(p, {_q(x + rest)}) THEN {_q(name)} END" for x, name, _ in a.REPORTS)
    period = " ".join(f"WHEN regexp_matches(p, {_q(x)}) THEN CASE WHEN regexp_matches(p, {_q(x + rest)}) THEN regexp_extract(p, {_q(x)}, 1) || {_q(q)} END" for x, _, q in a.REPORTS)
    ok = f"NOT regexp_matches(p, {_q(a.NOT_REPORTS)})"
    return plain, f"CASE WHEN {ok} THEN CASE {kind} END END", f"CASE WHEN {ok} THEN CASE {period} END END"


@query(f"""WITH r AS (SELECT o_orderkey AS id, {_pick_sql(REPORT_TITLES, 'o_orderkey')} AS title FROM orders), n AS (SELECT *, {_report_sql()[0]} AS p FROM r) SELECT id, title, {_report_sql()[1]} AS kind, {_report_sql()[2]} AS period FROM n""")
def report_titles(spark, sf_dir):
    """Full periodic reports by their titles, with the period; summaries, notices and other suffixes are none."""
    title = F.element_at(F.array(*map(F.lit, REPORT_TITLES)), (F.col("o_orderkey") % len(REPORT_TITLES) + 1).cast("int"))
    rows = t.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), title.alias("title"))
    kind, period = a.report(F.col("title"))
    return rows.select("id", "title", kind.alias("kind"), period.alias("period"))


_BODY = """b AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 4 WHEN 0 THEN '预计归属于上市公司股东的净利润为' || l_partkey || '万元至' || (l_suppkey + 5) || '万元' WHEN 1 THEN '预计归属于上市公司股东的净利润为' || (l_partkey + 3) || ',500.5~' || l_suppkey || '万元。'
  WHEN 2 THEN '归属于上市公司股东的净利润为 -' || l_partkey || ' 万元。' ELSE '说明' || l_partkey END AS body FROM lineitem)"""


def _bodies(spark, sf_dir):
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    body = F.when(F.col("l_linenumber") % 4 == 0, text("预计归属于上市公司股东的净利润为", k, "万元至", s + 5, "万元")).when(F.col("l_linenumber") % 4 == 1, text("预计归属于上市公司股东的净利润为", k + 3, ",500.5~", s, "万元。"))
    body = body.when(F.col("l_linenumber") % 4 == 2, text("归属于上市公司股东的净利润为 -", k, " 万元。")).otherwise(text("说明", k))
    return t.read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), body.alias("body"))


_N = lambda p, i: f"TRY_CAST(nullif(regexp_replace(regexp_extract(body, {_q(p)}, {i}), '[,，]', '', 'g'), '') AS DOUBLE)"


@query(f"""WITH {_BODY}, x AS (SELECT id, {_N(a.FORECAST_RANGE, 1)} AS a, {_N(a.FORECAST_RANGE, 2)} AS b, {_N(a.FORECAST_EXACT, 1)} AS e FROM b)
SELECT id, coalesce(least(a, b), e) AS low, coalesce(greatest(a, b), e) AS high, CASE WHEN a IS NOT NULL THEN 'range' WHEN e IS NOT NULL THEN 'exact' ELSE 'none' END AS given FROM x""")
def profit_forecasts(spark, sf_dir):
    """Net profit as a range (the lesser end first), exactly, or not given."""
    low, high, given = a.forecast(F.col("body"))
    return _bodies(spark, sf_dir).select("id", low.alias("low"), high.alias("high"), given.alias("given"))


@query(f"""WITH m AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'raised $' || c_custkey || '.5 billion in a round' WHEN 1 THEN 'about RMB ' || c_custkey || ',000 百万' WHEN 2 THEN 'USD ' || c_custkey || 'mn' WHEN 3 THEN '¥' || c_custkey || '亿 of credit' ELSE 'no sum' END AS body FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(body, {_q(a.MONEY)}) THEN TRY_CAST(replace(regexp_extract(body, {_q(a.MONEY)}, 2), ',', '') AS DOUBLE) END AS amount,
 CASE WHEN regexp_matches(body, {_q(a.MONEY)}) THEN CASE lower(regexp_extract(body, {_q(a.MONEY)}, 3)) WHEN 'billion' THEN 'billion' WHEN 'bn' THEN 'billion' WHEN '亿' THEN '亿' WHEN 'million' THEN 'million' WHEN 'mn' THEN 'million' WHEN '百万' THEN 'million' ELSE 'base' END END AS unit,
 CASE WHEN regexp_matches(body, {_q(a.MONEY)}) THEN CASE WHEN contains(upper(regexp_extract(body, {_q(a.MONEY)}, 1)), '$') OR contains(upper(regexp_extract(body, {_q(a.MONEY)}, 1)), 'USD') THEN 'USD' ELSE 'CNY' END END AS currency FROM m""")
def money_amounts(spark, sf_dir):
    """The first sum of money in a text."""
    k = F.col("c_custkey")
    body = F.when(k % 5 == 0, F.concat(F.lit("raised $"), k.cast("string"), F.lit(".5 billion in a round"))).when(k % 5 == 1, F.concat(F.lit("about RMB "), k.cast("string"), F.lit(",000 百万"))).when(k % 5 == 2, F.concat(F.lit("USD "), k.cast("string"), F.lit("mn"))).when(k % 5 == 3, F.concat(F.lit("¥"), k.cast("string"), F.lit("亿 of credit"))).otherwise("no sum")
    amount, unit, currency = a.money(body)
    return t.read(spark, sf_dir, "customer").select("c_custkey", amount.alias("amount"), unit.alias("unit"), currency.alias("currency"))


@query(f"""WITH m AS (SELECT p_partkey, '今日黑钨精矿报价 ' || p_size || '.5 万元, ' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '废钨棒材 ' || (p_size + 1) || ', ' END || '钨粉每公斤' || (p_size * 2) AS body FROM part),
x AS (SELECT p_partkey, {', '.join(f"TRY_CAST(nullif(regexp_extract(body, {_q(p)}, 1), '') AS DOUBLE) AS {n}" for n, p in a.PRICES)} FROM m) SELECT *, concat_ws(',', {', '.join(f"CASE WHEN {n} IS NULL THEN '{n}' END" for n, _ in a.PRICES)}) AS missing FROM x""")
def article_prices(spark, sf_dir):
    """The prices that an article must give, and those it lacks."""
    size = F.col("p_size")
    part = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("废钨棒材 "), (size + 1).cast("string"), F.lit(", ")))
    body = F.concat(F.lit("今日黑钨精矿报价 "), size.cast("string"), F.lit(".5 万元, "), part, F.lit("钨粉每公斤"), (size * 2).cast("string"))
    return t.read(spark, sf_dir, "part").select("p_partkey", body.alias("body")).select("p_partkey", *a.article_prices(F.col("body")))


EVALUATIONS = ["Terminal-Bench v2.1", "SWE-bench Verified", "SWE bench pass@5", "GPQA Diamond", "GPQA", "MMMU-Pro vision", "Arena Elo v1.2", "OSWorld 2.0.1", "BrowseComp", "Chess rating"]


@query(f"""WITH e AS (SELECT p_partkey, {_pick_sql(EVALUATIONS, 'p_partkey')} AS label FROM part), v AS (SELECT *, nullif(regexp_extract(label, '(?i)\\b(?:v(?:ersion)?\\s*)?(\\d+(?:\\.\\d+)+)\\b', 1), '') AS plain FROM e)
SELECT p_partkey, CASE WHEN label LIKE 'Terminal%' THEN 'Terminal-Bench' WHEN label LIKE 'SWE%' THEN 'SWE-bench' WHEN label LIKE 'GPQA%' THEN 'GPQA' WHEN label LIKE 'MMMU%' THEN 'MMMU-Pro' WHEN plain IS NOT NULL THEN trim(regexp_replace(label, '(?i)\\b(?:v(?:ersion)?\\s*)?(\\d+(?:\\.\\d+)+)\\b', '', 'g')) ELSE label END AS name,
 CASE WHEN label LIKE 'Terminal%' THEN '2.1' WHEN label = 'SWE-bench Verified' THEN 'Verified' WHEN label LIKE 'SWE%' THEN 'pass@5' WHEN label = 'GPQA Diamond' THEN 'Diamond' WHEN label LIKE 'GPQA%' OR label LIKE 'MMMU%' THEN NULL ELSE plain END AS version,
 CASE WHEN label = 'SWE bench pass@5' THEN 'pass@5' WHEN label LIKE 'SWE%' THEN 'Pass@1' WHEN label IN ('Arena Elo v1.2', 'Chess rating') THEN 'Elo' ELSE 'Accuracy' END AS score FROM v""")
def evaluation_names(spark, sf_dir):
    """Name, version and score kind of an evaluation."""
    label = F.element_at(F.array(*map(F.lit, EVALUATIONS)), (F.col("p_partkey") % len(EVALUATIONS) + 1).cast("int"))
    name, version, score = a.benchmark(F.col("label"))
    return t.read(spark, sf_dir, "part").select("p_partkey", label.alias("label")).select("p_partkey", name.alias("name"), version.alias("version"), score.alias("score"))


_FACT_TEXT = """SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 4 WHEN 0 THEN '减持' WHEN 1 THEN '回购' WHEN 2 THEN '合同' ELSE '其他' END AS kind,
  CASE l_linenumber % 4 WHEN 0 THEN '拟减持不超过 ' || l_partkey || ',500 股，占总股本的 ' || l_suppkey || '.5%；另占公司总股本 2.25%' WHEN 1 THEN '回购金额不低于 ' || l_suppkey || ' 万元且不超过' || (l_suppkey * 2) || '万元' WHEN 2 THEN '合同总金额 ' || l_partkey || '.75亿元' ELSE '占总股本 9%' END AS body FROM lineitem"""


@query(f"""WITH b AS ({_FACT_TEXT}) SELECT id, kind, {', '.join(f"list_max(list_transform(CASE WHEN kind = {_q(k)} THEN regexp_extract_all(body, {_q(p)}, 1) ELSE [] END, lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE))) AS {n}" for k, n, p in [f for f in a.FACTS if f[0] in ('减持', '回购', '合同')])} FROM b""")
def filing_facts(spark, sf_dir):
    """Amounts, shares, ratios and ranges in a filing's text by the patterns of its kind, the largest of several."""
    k, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber") % 4
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    of = F.when(n == 0, "减持").when(n == 1, "回购").when(n == 2, "合同").otherwise("其他")
    body = F.when(n == 0, text("拟减持不超过 ", k, ",500 股，占总股本的 ", s, ".5%；另占公司总股本 2.25%")).when(n == 1, text("回购金额不低于 ", s, " 万元且不超过", s * 2, "万元")).when(n == 2, text("合同总金额 ", k, ".75亿元")).otherwise("占总股本 9%")
    rows = t.read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), of.alias("kind"), body.alias("body"))
    rows = rows.select("id", "kind", a.facts(F.col("body"), F.col("kind")).alias("f"))
    return rows.select("id", "kind", *[F.col("f")[name].alias(name) for name in ("ratio", "shares", "least", "most", "amount")])


@query("""WITH r AS (SELECT p_partkey, p_size::DOUBLE AS s, CASE p_partkey % 3 WHEN 0 THEN 1e4 WHEN 1 THEN 1e8 ELSE 1 END AS unit, p_partkey % 4 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN s WHEN 1 THEN s * 1000 + 567 WHEN 2 THEN s + 0.5 END * unit AS now, CASE k WHEN 0 THEN 10 WHEN 1 THEN 20 END * unit AS before, round(CASE k WHEN 0 THEN 12.5 WHEN 1 THEN (s * 1000 + 567 - 20) / 20 * 100 END, 6) AS change FROM r""")
def report_metrics(spark, sf_dir):
    """A report's revenue with its unit, cut numbers mended, from the label's line or the lines after it, and the change on the period before."""
    size, k = F.col("p_size"), F.col("p_partkey") % 4
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    unit = F.when(F.col("p_partkey") % 3 == 0, "单位：万元\n").when(F.col("p_partkey") % 3 == 1, "单位: 人民币亿元\n").otherwise("")
    body = F.when(k == 0, text("营业收入 ", size, " 10 12.5%\n净利润 3")).when(k == 1, text("营业总收入\n（合并）\n ", size, ",\n567 20\n")).when(k == 2, text("其他 7\n营业收入：", size, ".5")).otherwise("无")
    now, before, change = a.report_metric(F.col("body"), "营业总收入|营业收入")
    rows = t.read(spark, sf_dir, "part").select("p_partkey", F.concat(unit, body).alias("body"))
    return rows.select("p_partkey", now.alias("now"), before.alias("before"), F.round(change, 6).alias("change"))
