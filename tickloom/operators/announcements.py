"""Filing rules: signal scores with neutralisers and families, filters, kinds, adjusters, and facts in their texts.

Rules come as tables, so that a user's own may replace the samples here; each function takes Columns.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions import rules

#: (pattern, weight, label): a sample of a rule table. Labels decide families and kinds.
SIGNALS = [
    (r"减持.*(结果|计划|股份)", -5, "股东减持"),
    (r"5%以上股东.*减持", -7, "≥2% 大股东减持"),
    (r"控股股东.*增持|实际控制人.*增持", 3, "大股东大额增持"),
    (r"(董事|监事|高级管理人员|董事长).*增持", 5, "董监高/管理层增持"),
    (r"回购报告书|回购股份|回购方案|首次回购", 3, "股份回购"),
    (r"(限制性股票|股票期权).*(激励计划|调整)", 2, "限制性股票激励计划"),
    (r"中标", 7, "中标"),
    (r"重大合同", 7, "重大合同"),
    (r"终止上市|退市", -10, "退市风险"),
    (r"风险警示", -7, "ST 风险警示"),
    (r"立案", -10, "立案调查"),
    (r"业绩预告", 6, "业绩预告涨幅>20%"),
    (r"重组.*完成", 8, "重组完成/上市"),
    (r"员工持股计划", 2, "员工持股"),
    (r"新药|临床试验", 4, "新药"),
    (r"战略合作", 1, "战略合作"),
    (r"扩产|新建产能", 4, "新建产能"),
    (r"行政处罚", -6, "监管处罚"),
    (r"破产重整", -10, "控股股东破产重整"),
]
# What a title must hold (all of them) for rules of some labels to count for nothing, and the mark on the label.
NO_SELL = r"自愿.*不减持|承诺.*不减持|承诺.*锁定|自愿锁定|不减持承诺|未减持|提前终止.*减持计划|终止.*减持计划"
_REWARD, _BUYBACK = r"限制性股票|股票期权|股权激励", r"回购报告书|集中竞价.*回购|首次回购|回购方案|回购股份"
_PART_LIFTED = r"撤销部分其他风险警示|撤销.*风险警示.*继续|撤销.*其他风险警示.*继续"
#: (patterns that a title must hold, one that it must not hold or "", labels concerned, mark), the first that applies decides.
#: A pattern with "@" before it looks at title and company.
NEUTRALISERS = [
    ([r"股权激励|限制性股票|股票期权|员工持股计划"], "", r"^股份回购$", "(激励类)"),
    ([r"@ST|退市风险", _BUYBACK], "", r"^股份回购$", "(ST自救)"),
    ([_REWARD, r"内幕信息知情人|注销.*期权|注销.*股票|调整.*价格|调整.*数量|调整.*相关事项"], "", r"^限制性股票激励计划$", "(程序性)"),
    (
        [_REWARD + r"|员工持股", r"解锁条件成就|解锁.*暨上市|登记完成|授予完成|激励对象名单|名单公示|名单审核公示|自查表|内幕信息知情人|调整.*价格|调整.*数量|调整.*相关事项|注销.*期权|注销.*股票|作废|失效"],
        "", r"^限制性股票激励计划$", "(执行/程序类v28)",
    ),
    ([r"律师事务所.*专项核查意见|律师事务所.*法律意见|律师.*见证|律师.*法律意见|专项核查意见.*增持|专项核查意见.*减持|免于以要约方式.*增持.*专项核查意见"], "", r"增持", "(律师核查v28)"),
    ([_PART_LIFTED], "", r"ST|退市", "(撤销部分v28)"),
    ([r"撤销(?:|部|[^部].{0,14}|部[^分].{0,13})风险警示"], _PART_LIFTED, r"ST|退市", "(撤销全v29)"),
    ([_REWARD + r"|员工持股"], r"草案|正式发布", r"^限制性股票激励计划$", "(v930严格)"),
    ([r"增持", r"进展|完成|结果|实施完毕"], "", r"增持|大股东", "(v930进展)"),
    ([r"注销减资|减资公告|减少注册资本"], _REWARD, r"^股份回购$", "(v930减资)"),
    ([r"日常经营合同"], "", r"中标|重大合同", "(v930日常)"),
]
#: (pattern, reason): titles that say nothing; the first decides.
NEUTRAL = [(r"独立董事", "独董意见"), (r"法律意见书|律师", "法律意见"), (r"股东大会|董事会决议", "会议"), (r"更正|补充", "更正补充"), (r"提示性公告", "提示性")]
#: (pattern on a label, kind), in order.
KINDS = [
    (r"退市", "退市"),
    (r"业绩预告", "业绩预告"),
    (r"重组", "重组"),
    (r"限制性股票", "激励"),
    (r"新建产能|扩产", "扩产"),
    (r"^ST 风险警示$", "ST"),
    (r"重整", "重整"),
    (r"监管处罚", "处罚"),
    (r"立案调查", "立案"),
    (r"股东减持", "减持"),
    (r"大股东大额增持", "增持"),
    (r"股份回购", "回购"),
    (r"中标|重大合同", "合同"),
    (r"员工持股", "员工持股"),
    (r"新药|专利|资质", "新药"),
    (r"战略合作", "战略"),
]
#: Kinds of income whose weight follows the share of a contract in the year's revenue.
INCOME = ("中标", "重大合同")

_HIT = "struct<label:string,weight:int,family:string>"


def hits(title: Column, company: Column, signals: Sequence[tuple[str, int, str]] = tuple(SIGNALS)) -> Column:
    """array<struct<label, weight, family>>: every rule that a title meets, neutralised ones with weight 0 (X6); a null title meets none."""
    looked = F.struct(title.alias("title"), F.concat_ws(" ", title, company).alias("whole"))
    quiet = lambda s: F.struct(s["title"].alias("title"), *[_quiet(s, must, unless).alias(f"q{i}") for i, (must, unless, _, _) in enumerate(NEUTRALISERS)], rules.found(s["title"], NO_SELL).alias("kept"))
    return rules.once(rules.once(looked, quiet), lambda s: _hits(s, signals))


def _quiet(s: Column, must: Sequence[str], unless: str) -> Column:
    out = F.lit(True)
    for p in must:
        out = out & (rules.found(s["whole"], p[1:]) if p.startswith("@") else rules.found(s["title"], p))
    return out & ~rules.found(s["title"], unless) if unless else out


def _hits(s: Column, signals: Sequence[tuple[str, int, str]]) -> Column:
    def hit(label: str, weight: int, family: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(weight).alias("weight"), F.lit(family).alias("family"))

    out = []
    for pattern, weight, label in signals:
        family = "reduce" if "减持" in label else "increase" if "增持" in label else "other"
        made = hit(label, weight, family)
        for i, (_, _, labels, mark) in reversed(list(enumerate(NEUTRALISERS))):
            if re.search(labels, label):
                made = F.when(s[f"q{i}"], hit(label + mark, 0, "none")).otherwise(made)
        if family == "reduce":
            made = F.when(s["kept"], hit("自愿不减持", 3, "other")).otherwise(made)
        out.append(F.when(rules.found(s["title"], pattern), made))
    return F.array_compact(F.array(*out)).cast(f"array<{_HIT}>")


def rule_tables(spec: str) -> tuple[list[tuple[str, int, str]], list[tuple[str, str]]]:
    """Signals (pattern, weight, label) and neutral titles (pattern, reason) out of pipe tables in a user's text.

    A table whose first column is `label` has label, score, pattern; one whose first is `pattern` has pattern, reason.
    `;` parts alternatives. Rows that lack a cell, or whose score is no whole number, go; other tables are passed over.
    """
    signals, neutral, kind = [], [], ""
    for line in spec.splitlines():
        cells = [c.strip() for c in line.strip().strip("|").split("|")]
        if not line.strip().startswith("|"):
            kind = kind if kind == "pattern" and not line.strip() else ""  # tables of neutral titles go on after an empty line
        elif not kind:
            kind = cells[0] if cells[0] in ("label", "pattern") else ""
        elif kind == "label" and len(cells) >= 3 and cells[0] and cells[2] and re.fullmatch(r"[+-]?\d+", cells[1]):
            signals.append((cells[2].replace(";", "|"), int(cells[1]), cells[0]))
        elif kind == "pattern" and len(cells) >= 2 and cells[0] != "pattern" and cells[0].strip("-: ") and cells[1]:
            neutral.append((cells[0].replace(";", "|"), cells[1]))
    return signals, neutral


def counted(found: Column) -> Column:
    """The hits that make the score: the strongest of the reduce and increase families, and all others."""
    best = F.array_compact(F.array(_best(found, "reduce"), _best(found, "increase")))
    return F.concat(best, F.filter(found, lambda h: h["family"] == "other"))


def _best(found: Column, family: str) -> Column:
    """Of a family the hit with the largest size, the first of equal ones."""
    of = F.filter(found, lambda h: h["family"] == family)
    return F.reduce(of, F.lit(None).cast(_HIT), lambda best, h: F.when(best.isNull() | (F.abs(h["weight"]) > F.abs(best["weight"])), h).otherwise(best))


def total(found: Column) -> Column:
    return F.reduce(found, F.lit(0), lambda s, h: s + h["weight"])


def one_holder(found: Column) -> Column:
    """A holder who is a manager too counts once, as manager, unless bought at a low price (X11)."""
    has = lambda label: F.exists(found, lambda h: h["label"] == label)
    both = has("大股东大额增持") & has("董监高/管理层增持") & ~has("股价低位增持")
    return F.when(both, F.filter(found, lambda h: h["label"] != "大股东大额增持")).otherwise(found)


def by_revenue(found: Column, share_pct: Column) -> Column:
    """Income signals weigh 5 from a fifth of the year's revenue, 3 from a twentieth, else as they were (X11)."""
    weight = lambda h: F.when(h["label"].isin(*INCOME) & (share_pct >= 20), 5).when(h["label"].isin(*INCOME) & (share_pct >= 5), 3).otherwise(h["weight"])
    return F.transform(found, lambda h: F.struct(h["label"].alias("label"), weight(h).alias("weight"), h["family"].alias("family")))


def kind(found: Column) -> Column:
    """Kind of a filing by the labels of its hits, in order."""
    met = lambda p: F.exists(found, lambda h: rules.found(h["label"], p))
    return F.coalesce(*[F.when(met(p), F.lit(name)) for p, name in KINDS], F.lit("其他"))


def neutral(title: Column, table: Sequence[tuple[str, str]] = tuple(NEUTRAL)) -> Column:
    """The first reason why a title says nothing, or null."""
    return rules.first(title, table)


# Titles that aren't reports, the four reports, and what may follow their names.
NOT_REPORTS = r"摘要|补充公告|补充说明|问询|回复|监管工作函|审核意见|审计报告|审阅报告|鉴证报告|专项说明|核查意见|法律意见|董事会|监事会|独立董事|内部控制|社会责任|(?i)ESG|环境、社会|业绩说明会|投资者关系|延期披露|取消披露|提示性公告|业绩预告|业绩快报"
REPORTS = [(r"(20\d{2})年第?一季度报告", "第一季度报告", "Q1"), (r"(20\d{2})年第?三季度报告", "第三季度报告", "Q3"), (r"(20\d{2})年半年度报告", "半年度报告", "H1"), (r"(20\d{2})年(?:年度报告|年报)", "年度报告", "FY")]
VERSION = r"(?:全文|英文版|外文版|英文译本|更正(?:后|稿|版)?|修订(?:后|稿|版)?|更新后)"


def report(title: Column) -> tuple[Column, Column]:
    """Kind and period of a full report by its title, null for anything else."""
    plain = F.regexp_replace(F.translate(F.regexp_replace(title, r"(?i)</?em>", ""), "：（）", ":()"), r"\s+", "")
    rest_ok = rf"[-—_·:：.。]*(?:{VERSION}|\({VERSION}\))*[-—_·:：.。]*$"
    kinds, periods = [], []
    for pattern, name, part in REPORTS:
        fits = plain.rlike(pattern + rest_ok)
        kinds.append(F.when(plain.rlike(pattern), F.when(fits, F.lit(name)).otherwise(F.lit(""))))
        periods.append(F.when(plain.rlike(pattern), F.when(fits, F.concat(F.regexp_extract(plain, pattern, 1), F.lit(part))).otherwise(F.lit(""))))
    ok = ~plain.rlike(NOT_REPORTS) & (plain != "")
    return F.when(ok, F.nullif(F.coalesce(*kinds), F.lit(""))), F.when(ok, F.nullif(F.coalesce(*periods), F.lit("")))


# How a forecast of net profit is worded.
_NUM, _TO, _NET = r"(-?\d[\d,，]*(?:\.\d+)?)", r"(?:~|～|－|—|-{1,2}|至|到)", "归属于上市公司股东的净利润"
FORECAST_RANGE = rf"{_NET}[^\n。；;]*?(?:为人民币|为|预计为|：|:)?\s*{_NUM}\s*{_TO}\s*{_NUM}\s*万元"
FORECAST_EXACT = rf"{_NET}[^\n。；;]*?(?:为人民币|为|预计为|：|:)?\s*{_NUM}\s*万元"


def forecast(body: Column) -> tuple[Column, Column, Column]:
    """Least and most net profit in ten thousands, and how it was given: as a range, exactly, or not."""
    number = lambda p, i: F.nullif(F.regexp_replace(F.regexp_extract(body, p, i), "[,，]", ""), F.lit("")).cast("double")
    a, b, one = number(FORECAST_RANGE, 1), number(FORECAST_RANGE, 2), number(FORECAST_EXACT, 1)
    given = F.when(a.isNotNull(), "range").when(one.isNotNull(), "exact").otherwise("none")
    return F.coalesce(F.least(a, b), one), F.coalesce(F.greatest(a, b), one), given


MONEY = r"(?i)(\$|USD\s*|CNY\s*|RMB\s*|¥\s*)([\d,.]+)\s*(billion|million|bn|mn|亿|百万)?"


def money(body: Column) -> tuple[Column, Column, Column]:
    """Amount, unit and currency of the first sum of money in a text."""
    sign, unit = F.upper(F.regexp_extract(body, MONEY, 1)), F.lower(F.regexp_extract(body, MONEY, 3))
    amount = F.regexp_replace(F.regexp_extract(body, MONEY, 2), ",", "").try_cast("double")
    name = F.when(unit.isin("billion", "bn"), "billion").when(unit == "亿", "亿").when(unit.isin("million", "mn", "百万"), "million").otherwise("base")
    met = body.rlike(MONEY)
    return F.when(met, amount), F.when(met, name), F.when(met, F.when(sign.contains("$") | sign.contains("USD"), "USD").otherwise("CNY"))


def benchmark(label: Column) -> tuple[Column, Column, Column]:
    """Name, version and kind of score of an evaluation."""
    has = lambda p: label.rlike(p)
    got = lambda p, i=1: F.nullif(F.trim(F.regexp_extract(label, p, i)), F.lit(""))
    terminal, swe, gpqa, mmmu = has("(?i)terminal[- ]bench"), has("(?i)^swe[- ]bench"), has("(?i)gpqa"), has("(?i)mmmu[- ]?pro")
    plain = r"(?i)\b(?:v(?:ersion)?\s*)?(\d+(?:\.\d+)+)\b"
    name = F.when(terminal, "Terminal-Bench").when(swe, "SWE-bench").when(gpqa, "GPQA").when(mmmu, "MMMU-Pro").when(has(plain), F.trim(F.regexp_replace(label, plain, ""))).otherwise(label)
    version = F.when(terminal, got(r"(?i)(?:terminal[- ]bench)\s*(?:v(?:ersion)?\s*)?(\d+(?:\.\d+)?)")).when(swe, got(r"(?i)^.*?swe[- ]bench\s*(.*)$")).when(gpqa, F.when(has("(?i)diamond"), "Diamond")).when(mmmu, F.lit(None)).otherwise(got(plain))
    score = F.when(swe, F.coalesce(got(r"(?i)(pass@\d+)"), F.lit("Pass@1"))).when(~terminal & ~gpqa & ~mmmu & has("(?i)elo|rating"), "Elo").otherwise("Accuracy")
    return name, version, score


#: (name, pattern): prices that an article must give, all of them.
PRICES = [("concentrate", r"黑钨精矿[^0-9]{0,20}(\d+(?:\.\d+)?)"), ("bar", r"废钨棒材[^0-9]{0,20}(\d+(?:\.\d+)?)"), ("powder", r"钨粉[^0-9]{0,20}(\d+(?:\.\d+)?)")]


def article_prices(body: Column, table: Sequence[tuple[str, str]] = tuple(PRICES)) -> list[Column]:
    """The price of each product, and the names that lack."""
    found = {name: F.nullif(F.regexp_extract(F.replace(body, F.lit(" "), F.lit(" ")), p, 1), F.lit("")).cast("double") for name, p in table}
    lacks = F.array_join(F.array_compact(F.array(*[F.when(c.isNull(), F.lit(name)) for name, c in found.items()])), ",")
    return [*[c.alias(name) for name, c in found.items()], lacks.alias("missing")]


#: What to look for in the text of each kind of filing: (kind, name of the fact, pattern); the last group is the value.
FACTS = [
    ("减持", "ratio", r"占(?:公司)?总股本[^\d]{0,8}(\d+(?:\.\d+)?)%"),
    ("减持", "shares", r"减持[^\d\n]{0,20}(\d[\d,]*(?:\.\d+)?)万?股"),
    ("增持", "ratio", r"占(?:公司)?总股本[^\d]{0,8}(\d+(?:\.\d+)?)%"),
    ("回购", "least", r"回购[^\d\n]{0,20}不低于[^\d\n]{0,8}(\d[\d,]*(?:\.\d+)?)(?:亿|万)元"),
    ("回购", "most", r"不超过[^\d\n]{0,8}(\d[\d,]*(?:\.\d+)?)(?:亿|万)元"),
    ("合同", "amount", r"(?:合同|中标)[^\d\n]{0,20}金额[^\d\n]{0,8}(\d[\d,]*(?:\.\d+)?)(?:亿|万)?元"),
    ("业绩预告", "growth", r"同比[^\d\n-]{0,8}(-?\d+(?:\.\d+)?)%"),
]


def facts(body: Column, of: Column, table: Sequence[tuple[str, str, str]] = tuple(FACTS)) -> Column:
    """map<string,double> of what the text of a filing says, by the patterns of its kind; the largest where several are found."""
    found = []
    for kind_name, name, pattern in table:
        values = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").try_cast("double"))
        found.append(F.when((of == kind_name) & (F.size(values) > 0), F.struct(F.lit(name).alias("key"), F.array_max(values).alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*found)))


#: Units of a report's tables.
UNITS = {"元": 1.0, "千元": 1e3, "万元": 1e4, "百万元": 1e6, "亿元": 1e8}


def report_metric(body: Column, labels: str) -> tuple[Column, Column, Column]:
    """This period's value, the one before, and the change in per cent, of a row of a report's table.

    Numbers that a line break cut are mended; the label may stand up to six lines before its numbers; values are
    in the unit that the text names; a change that isn't given is worked out.
    """
    plain = F.regexp_replace(body, r"(\d[,，])\s*\n\s*(\d)", "$1$2")
    number = r"(-?\d[\d,]*(?:\.\d+)?)"
    row = rf"(?:{labels})(?:[^\d\n-]*\n){{0,6}}[^\d\n-]*{number}(?:[ \t]+{number})?(?:[ \t]+(-?\d+(?:\.\d+)?)%)?"
    unit = rules.value_of(F.regexp_extract(plain, r"单位[:：]\s*(?:人民币)?\s*(百万元|千元|万元|亿元|元)", 1), UNITS, 1.0)
    value = lambda i: F.regexp_replace(F.regexp_extract(plain, row, i), ",", "").try_cast("double")
    now, before = value(1) * unit, value(2) * unit
    return now, before, F.coalesce(value(3), F.try_divide(now - before, F.abs(before)) * 100)
