"""Placement texts in odd wordings."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tickloom.functions import rules
from tickloom.operators import placements as p


def read(spark, body, price=None):
    row = spark.createDataFrame([(body, price)], "body string, price double")
    return row.withColumn("text", p.plain(F.col("body"))).select(p.metrics(F.col("text"), F.col("price")).alias("m")).first()["m"]


@pytest.mark.parametrize("title, yes", [("非公开发行股票预案", True), ("向特定对象发行 股票预案（二次修订稿）", True), ("定增预案提示性公告", False), ("发行预案的论证分析报告 定增", False), ("非公开发行公告", False), ("股权激励预案", False), ("", False), (None, False)])
def test_titles(spark, title, yes):
    assert spark.createDataFrame([(title,)], "t string").select(p.is_plan(F.col("t")).alias("x")).first()["x"] is yes


def test_sums_by_nearness(spark):
    m = read(spark, "本次发行募集资金总额不超过 ３０,０００ 万元，拟投入募集资金20,000万元用于新建产能；剩余10,000万元用于补充流动资金及偿还银行贷款。")
    assert (m.total, m.liquidity, m.ordinary_debt, m.projects) == (30000.0, 10000.0, 10000.0, 20000.0)
    # one sum for both purposes counts once
    assert m.liquidity_ratio == pytest.approx(1 / 3) and m.project_ratio == pytest.approx(2 / 3)
    m = read(spark, "募集资金总额为8亿元。其中补充流动资金和偿还有息负债合计5亿元。")
    assert (m.total, m.liquidity, m.ordinary_debt) == (80000.0, 50000.0, 50000.0) and m.liquidity_ratio == 0.625
    # a sum in another clause belongs to another purpose
    m = read(spark, "募集资金总额不超过8亿元，补充流动资金，以及3亿元购置设备")
    assert m.liquidity is None and m.liquidity_ratio == 0.0


def test_parts_are_not_the_total(spark):
    m = read(spark, "公司拟使用募集资金5亿元建设项目。用于项目的募集资金7亿元。")
    assert m.total is None and m.projects == 50000.0
    m = read(spark, "募集资金总额不超过6亿元。拟使用募集资金6亿元；拟使用募集资金2亿元；拟使用募集资金2亿元；拟投入本次募集资金金额10,000万元。")
    assert m.projects == 30000.0  # the whole sum and the repeated one are no more projects
    assert read(spark, "募集资金总额为1亿元。拟使用募集资金3亿元。").projects is None
    assert read(spark, "拟使用募集资金3亿元补充流动资金").projects is None


def test_high_interest_debt_is_not_ordinary(spark):
    m = read(spark, "募集资金总额不超过10亿元，6亿元偿还债务，均为高息债务，有利于减少利息支出。")
    assert (m.ordinary_debt, m.high_interest_debt, m.high_interest) == (None, 60000.0, True) and m.liquidity_ratio == 0.0


@pytest.mark.parametrize("body, pct", [
    ("不超过本次发行前公司总股本的百分之三十", 30.0), ("占发行前总股本的 12.5%", 12.5), ("发行前总股本百分之二十五点五", 25.5), ("发行前总股本的百分之三〇", 30.0),
    ("发行数量不超过3,000万股。发行前公司总股本为100,000,000股", 30.0), ("发行股票数量上限为5000股", None), ("发行前总股本的百分之点", None), ("发行后总股本的30%", None),
])
def test_dilution(spark, body, pct):
    assert read(spark, body).dilution_pct == (None if pct is None else pytest.approx(pct))


@pytest.mark.parametrize("body, months", [("锁定期为 十八个月", 18), ("限售期36个月", 36), ("自本次发行结束之日起六个月内不得转让", 6), ("限售期6个月。锁定期为18个月", 18), ("不得转让", None)])
def test_lockup(spark, body, months):
    assert read(spark, body).lockup_months == months


def test_prices(spark):
    m = read(spark, "本次发行价格为人民币 1,010.50元/股", 1000.0)
    assert (m.pricing, m.price) == ("fixed", 1010.5) and m.price_ratio == pytest.approx(1.0105)
    m = read(spark, "发行价格不低于定价基准日前20个交易日公司股票均价的 80%", 10.0)
    assert (m.pricing, m.floor_ratio, m.price_ratio) == ("auction_floor", 0.8, None)
    assert read(spark, "发行价格另定", 10.0).pricing == "unknown" and read(spark, "发行价格: 5元", 0.0).price_ratio is None


@pytest.mark.parametrize("body, internal, strategic, financial, known", [
    ("实际控制人拟大额认购", True, False, False, True), ("董事认购不低于 3亿元", True, False, False, True), ("发行对象为公司控股股东", True, False, False, True),
    ("引入产业投资者", False, True, False, True), ("产业资本拟参与认购", False, True, False, True), ("发行对象均为财务性投资者", False, False, True, True),
    ("公司尚未确定具体发行对象，控股股东全额认购", True, False, False, False), ("发行对象不超过三十五名，最终发行对象由询价确定", False, False, False, False), ("股东认购", False, False, False, None),
])
def test_investors(spark, body, internal, strategic, financial, known):
    m = read(spark, body)
    assert (m.internal, m.strategic, m.financial, m.investors_known) == (internal, strategic, financial, known)


def test_scores(spark):
    body = "募集资金总额为10亿元。拟使用募集资金6亿元新建生产线，围绕主业的半导体；补充流动资金3亿元。不超过发行前总股本的30%。控股股东全额认购。发行价格为7元/股。"
    rows = spark.createDataFrame([(body, 10.0, 1.2, None), ("", None, None, None), (None, None, None, 0.8)], "body string, price double, over double, place double")
    rows = rows.withColumn("text", p.plain(F.col("body"))).withColumn("m", p.metrics(F.col("text"), F.col("price")))
    found = p.signals(F.col("m"), F.col("over"), F.col("place"))
    got = rows.select(found.alias("s"), p.score(found).alias("n")).collect()
    assert [(x.label, x.weight) for x in got[0].s] == [("定增投向主业扩产", 7), ("定增严重稀释", -5), ("定增内部人认购", 3), ("定增大幅折价", -3), ("定增高位发行", -2)]
    assert [r.n for r in got] == [0, 0, -2]


def test_patterns_are_tried_only_where_their_words_stand(spark):
    patterns = [*p.INTERNAL, *p.FINANCIAL, *p.UNDECIDED, p.NAMED, *p.LOCKUP, p.FIXED_PRICE, p.FLOOR_PRICE, *p.DILUTION, p.SHARES_ISSUED, p.SHARES_BEFORE, p.DIRECT_SHARE, p.EXPANSION, p.CORE_BUSINESS, p._either(p.DEBTS)]
    assert all(rules._needed(x) for x in patterns)
    assert rules._needed(r"a\x41b") is None and rules._needed("(?i)ab") is None and rules._needed(r"ab{0,2}c\.d|e") == [(["a", "c", "d"], r"ab{0,2}c\.d"), (["e"], "")]
    rng = random.Random(12)
    words = sorted({w for x in patterns for w in re.findall(r"[一-鿿]+", x)}) + ["18", "30%", " ", "。", "百分之", "个月", "20.5 %", "3,000万股", "元", "归还银行借款"]
    texts = spark.createDataFrame([("".join(rng.choices(words, k=rng.randint(0, 9))),) for _ in range(400)], "s string")
    wrong = [F.count_if(rules.found(F.col("s"), x) != F.col("s").rlike(x)).alias(str(i)) for i, x in enumerate([*patterns, "|".join(p.DEBTS)])]
    wrong.append(F.count_if(F.col("s").rlike(p._either(p.DEBTS)) != F.col("s").rlike("|".join(p.DEBTS))).alias("either"))
    assert not any(texts.agg(*wrong).first())
