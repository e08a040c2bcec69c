"""Placement plans: texts of many shapes from an order's keys, and SQL that works from the same parts, not from the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import placements as p
from tickloom.plans.register import query
from tickloom.sources import tables as t

#: The first four are plans.
TITLES = ["2024年度向特定对象发行A股股票预案", "非公开发行股票预案（修订稿）", "定增 预案", "公司定向增发股票预案", "向特定对象发行股票预案提示性公告", "募集资金使用可行性分析报告", "年度报告"]


def _text(*parts):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])


def _case(key, n, *texts):
    out = F.lit("")
    for i, text in enumerate(texts):
        out = F.when(key % n == i, text if not isinstance(text, str) else F.lit(text)).otherwise(out)
    return out


def plans(spark, sf_dir):
    """id, title, body, current_price, over_average, place_60d: six clauses, each of several wordings or left out."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    a, total = c % 5 + 1, c % 31 + 6
    raised = _case(k, 4, _text("本次募集资金总额不超过", total, "亿元"), _text("募集资金总额　预计不超过人民币", total, "0,000万元"), _text("本次募集资金为", total, ".5亿元"), "本次拟发行股票")
    flow = _case(F.floor(k / 4), 4, _text("，其中", a, "亿元用于补充流动资金。"), _text("；补流 ", a, "亿元。"), "。", _text("。拟使用募集资金", a * 2, "亿元建设人工智能芯片生产线，围绕主营业务；另拟投入募集资金", a, "0,000万元用于数据中心扩建。"))
    debt = _case(F.floor(k / 16), 3, "", _text("偿还银行贷款", a, "亿元。"), _text(a, "亿元偿还有息负债，属高息债务，可降低财务费用。"))
    diluted = _case(F.floor(k / 48), 4, _text("发行数量不超过本次发行前公司总股本的", c % 40, ".5％。"), "发行股票数量不超过发行前总股本的百分之三十。", _text("发行股票数量不超过", c, "万股，发行前公司总股本为10,000万股。"))
    lockup = _case(c, 4, "锁定期为18个月。", "限售期为六个月。", "自发行结束之日起三十六个月内不得转让。")
    priced = _case(F.floor(c / 4), 3, _text("发行价格为", c % 30 + 10, ".25元/股。"), "发行价格不低于定价基准日前20个交易日股票交易均价的百分之八十。")
    who = _case(F.floor(c / 12), 6, "控股股东以现金全额认购。", "拟引入战略投资者参与认购。", "发行对象均为财务投资者。", "发行对象不超过35名特定投资者，最终发行对象将由竞价确定。", "发行对象为某合伙企业。")
    title = F.element_at(F.array(*map(F.lit, TITLES)), (k % len(TITLES) + 1).cast("int"))
    rows = t.read(spark, sf_dir, "orders")
    return rows.select(k.alias("id"), title.alias("title"), F.concat(raised, flow, debt, diluted, lockup, priced, who).alias("body"), F.when(c % 6 != 0, 30.0).alias("current_price"), (F.lit(0.9) + c % 4 / 10).alias("over_average"), F.when(c % 5 != 0, c % 10 / 10).alias("place_60d"))


#: A sum for a project that stands right before a purpose of the debt clause isn't a project's: then only the first counts.
_SQL = f"""WITH k AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderkey % 4 AS k1, o_orderkey // 4 % 4 AS k2, o_orderkey // 16 % 3 AS k3, o_orderkey // 48 % 4 AS k4, o_custkey % 4 AS k5, o_custkey // 4 % 3 AS k6, o_custkey // 12 % 6 AS k7, (o_custkey % 5 + 1) * 10000.0 AS a, (o_custkey % 31 + 6) * 10000.0 AS t FROM orders),
m AS (SELECT *, id % {len(TITLES)} < 4 AS is_plan FROM k),
v AS (SELECT *, CASE k1 WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN t + 5000 END AS total, CASE WHEN k2 < 2 THEN a END AS liquidity, CASE WHEN k3 = 1 THEN a END AS ordinary_debt, CASE WHEN k3 = 2 THEN a END AS costly FROM m),
u AS (SELECT *, coalesce(liquidity, 0) + coalesce(ordinary_debt, 0) AS ordinary, CASE WHEN k2 = 3 THEN CASE WHEN k3 > 0 THEN 2 * a WHEN 2 * a = total THEN a ELSE 3 * a END END AS stated FROM v),
w AS (SELECT *, CASE WHEN stated IS NOT NULL AND (total IS NULL OR stated <= total * 1.01) THEN stated WHEN k2 = 3 AND ordinary > 0 AND total IS NOT NULL THEN greatest(0, total - ordinary) END AS projects FROM u),
x AS (SELECT *, CASE WHEN total > 0 AND ordinary > 0 THEN least(1, ordinary / total) WHEN total > 0 AND (k2 < 2 OR k3 > 0) THEN 0 END::DOUBLE AS liquidity_ratio, (CASE WHEN total > 0 AND projects IS NOT NULL THEN least(1, projects / total) END)::DOUBLE AS project_ratio,
  (CASE k4 WHEN 0 THEN c % 40 + 0.5 WHEN 1 THEN 30 WHEN 2 THEN c * 10000.0 / 100000000 * 100 END)::DOUBLE AS dilution_pct, CASE k5 WHEN 0 THEN 18 WHEN 1 THEN 6 WHEN 2 THEN 36 END AS lockup_months, CASE k6 WHEN 0 THEN 'fixed' WHEN 1 THEN 'auction_floor' ELSE 'unknown' END AS pricing, CASE WHEN c % 6 <> 0 AND k6 = 0 THEN (c % 30 + 10.25) / 30 END::DOUBLE AS price_ratio,
  CASE WHEN k7 = 3 THEN false WHEN k7 < 5 THEN true END AS investors_known FROM w)
SELECT id, is_plan, total, liquidity, ordinary_debt, costly AS high_interest_debt, round(liquidity_ratio, 9) AS liquidity_ratio, projects, round(project_ratio, 9) AS project_ratio, round(dilution_pct, 9) AS dilution_pct, lockup_months, pricing, round(price_ratio, 9) AS price_ratio, investors_known,
 CASE WHEN is_plan THEN CAST(CASE WHEN coalesce(project_ratio >= 0.5 AND k2 = 3, false) THEN 7 WHEN liquidity_ratio >= 0.5 THEN -2 WHEN liquidity_ratio >= 0.2 THEN -1 ELSE 0 END + CASE WHEN dilution_pct >= 30 THEN -5 ELSE 0 END + CASE k7 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN -1 ELSE 0 END + CASE WHEN k3 = 2 THEN 2 ELSE 0 END
  + CASE WHEN price_ratio >= 0.95 THEN 3 WHEN price_ratio <= 0.8 THEN -3 ELSE 0 END + CASE WHEN c % 4 = 3 OR (c % 5 <> 0 AND c % 10 > 7) THEN -2 ELSE 0 END AS INTEGER) ELSE 0 END AS score FROM x"""


@query(_SQL)
def placement_scores(spark, sf_dir):
    """A placement plan's sums by purpose, shares, dilution, lock-up, price and investors from its text, and its score."""
    rows = plans(spark, sf_dir).withColumn("text", p.plain(F.col("body"))).withColumn("is_plan", p.is_plan(F.col("title")))
    rows = rows.withColumn("m", p.metrics(F.col("text"), F.col("current_price")))
    points = p.score(p.signals(F.col("m"), F.col("over_average"), F.col("place_60d")))
    exact = lambda name: F.round(f"m.{name}", 9).alias(name)
    return rows.select("id", "is_plan", "m.total", "m.liquidity", "m.ordinary_debt", "m.high_interest_debt", exact("liquidity_ratio"), "m.projects", exact("project_ratio"), exact("dilution_pct"), "m.lockup_months", "m.pricing", exact("price_ratio"), "m.investors_known", F.when(F.col("is_plan"), points).otherwise(0).alias("score"))
