import random
import re

import pytest
from pyspark.sql import functions as F

from tickloom.functions import rules
from tickloom.operators import announcements as a
from tickloom.plans import announcements as announcement_plans


def scored(spark, rows, **tables):
    df = spark.createDataFrame(rows, "title string, company string")
    df = df.withColumn("hits", a.hits(F.col("title"), F.col("company"), **tables)).withColumn("score", a.total(a.counted(F.col("hits"))))
    return [([h["label"] for h in r["hits"]], r["score"]) for r in df.collect()]


@pytest.mark.parametrize(
    ("title", "company", "labels", "score"),
    [
        ("关于撤销部分其他风险警示暨继续被实施其他风险警示的公告", "", ["ST 风险警示(撤销部分v28)"], 0),
        ("关于公司股票撤销其他风险警示暨停复牌的公告", "", ["ST 风险警示(撤销全v29)"], 0),
        ("关于撤销部分退市风险警示的公告", "", ["退市风险", "ST 风险警示"], -17),
        ("限制性股票激励计划（草案）", "", ["限制性股票激励计划"], 2),
        ("限制性股票激励计划首次授予的公告", "", ["限制性股票激励计划(v930严格)"], 0),
        ("限制性股票激励计划（草案）激励对象名单", "", ["限制性股票激励计划(执行/程序类v28)"], 0),
        ("关于控股股东增持股份计划进展的公告", "", ["大股东大额增持(v930进展)"], 0),
        ("某律师事务所关于控股股东增持股份的专项核查意见", "", ["大股东大额增持(律师核查v28)"], 0),
        ("关于回购股份注销减资的公告", "", ["股份回购(v930减资)"], 0),
        ("关于首次回购股份的公告", "*ST某", ["股份回购(ST自救)"], 0),
        ("关于签订日常经营合同、重大合同的公告", None, ["重大合同(v930日常)"], 0),
        ("关于股东未减持股份计划的公告", "", ["自愿不减持"], 3),
        ("", "", [], 0),
        (None, "*ST某", [], 0),
    ],
)
def test_neutralised_titles(spark, title, company, labels, score):
    assert scored(spark, [(title, company)]) == [(labels, score)]


def test_titles_against_a_plain_loop(spark):
    rng = random.Random(2)
    words = ["控股股东", "增持", "减持", "股份计划", "进展", "撤销", "部分", "其他", "风险警示", "继续", "限制性股票", "激励计划", "草案", "回购股份", "注销减资", "律师事务所", "专项核查意见", "日常经营合同", "中标", "终止", "ST", "自愿", "不"]
    rows = [("".join(rng.choice(words) for _ in range(rng.randint(1, 7))), rng.choice(["", "*ST一", "二"])) for _ in range(300)]

    def plain(title, company):
        labels, best, score = [], {}, 0
        for pattern, weight, label in a.SIGNALS:
            if not re.search(pattern, title):
                continue
            if "减持" in label and re.search(a.NO_SELL, title):
                labels.append("自愿不减持")
                score += 3
                continue
            mark = next((m for must, no, of, m in a.NEUTRALISERS if re.search(of, label) and all(re.search(p.lstrip("@"), f"{title} {company}" if p[0] == "@" else title) for p in must) and not (no and re.search(no, title))), None)
            labels.append(label + (mark or ""))
            family = "减持" if "减持" in label else "增持" if "增持" in label else None
            if mark is None and family:
                best[family] = max(best.get(family, 0), weight, key=abs)
            elif mark is None:
                score += weight
        return labels, score + sum(best.values())

    assert scored(spark, rows) == [plain(*r) for r in rows]


def test_rule_tables_of_a_text(spark):
    spec = "# x\n| label | score | pattern | judge |\n|---|---|---|---|\n| 甲减持 | -4 | 卖;出售(?!完毕) | j |\n| 乙 | five | x |\n| | 1 | y |\n| 丙 | 2 | |\n\ntext\n| pattern | reason |\n| --- | --- |\n| 会议;决议 | 会 |\n\n| pattern | reason |\n|---|---|\n| 更正 | 改 |\n| 只 |\ntext\n| other | 1 | z |\n"
    signals, neutral = a.rule_tables(spec)
    assert signals == [("卖|出售(?!完毕)", -4, "甲减持")] and neutral == [("会议|决议", "会"), ("更正", "改")]
    assert scored(spark, [("出售完毕", ""), ("出售一半", ""), ("卖", None)], signals=tuple(signals)) == [([], 0), (["甲减持"], -4), (["甲减持"], -4)]
    assert spark.range(1).select(a.neutral(F.lit("董事会决议更正"), tuple(neutral)).alias("r")).first()["r"] == "会"
    assert a.rule_tables("") == ([], [])


def test_filings_are_looked_through_once(spark, sf_dir):
    from tickloom.plans import announcements as plans

    plan = plans.filing_suppression(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_hits_are_looked_for_once(spark, sf_dir):
    plan = announcement_plans.filing_adjusted(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Filter (" not in plan  # a filter on the hits would look for them once more


def test_alternatives_are_tried_where_all_their_words_stand(spark):
    patterns = [p for p, _, _ in a.SIGNALS] + [p.removeprefix("@") for must, unless, _, _ in a.NEUTRALISERS for p in [*must, unless] if p] + [a.NO_SELL] + [p for p, _ in a.KINDS]
    assert rules._needed("重组.*完成|中标") == [(["重组", "完成"], "重组.*完成"), (["中标"], "")] and rules._needed("(甲|乙).*(丙|丁)") is None
    rng = random.Random(11)
    words = sorted({w for p in patterns for w in re.findall(r"[一-鿿]+", p)}) + ["5%以上股东", "ST ", "\n"]
    texts = spark.createDataFrame([("".join(rng.choices(words, k=rng.randint(0, 5))),) for _ in range(400)] + [(None,)], "s string")
    wrong = [F.count_if(~rules.found(F.col("s"), p).eqNullSafe(F.col("s").rlike(p))).alias(str(i)) for i, p in enumerate(patterns)]
    assert not any(texts.agg(*wrong).first())
