"""Private placements: what a plan's text says of money, dilution, lock-up, price and investors, and its score.

Amounts are found by nearness: a sum next to a purpose, within a clause. Everything is a Column, so a text is read in
the task that holds it; a text without a fact gives null, never 0.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions import rules
from tickloom.functions import text as tx

# Titles of plans, and of the papers beside them.
NOT_PLANS = r"提示性公告|论证分析报告|论证报告|可行性分析报告|募集资金使用可行性|审核意见|审核问询|落实函|回复报告|摊薄即期回报|摊薄回报|董事会决议|监事会决议|股东大会"
PLACEMENTS = r"向特定对象发行|非公开发行|定向增发|定增"
# Words of sectors, expansion and main business.
HIGH_GROWTH = r"AI|人工智能|算力|数据中心|高速光通信|光通信|光互联|CPO|NPO|半导体|芯片|集成电路|先进封装|机器人|新能源|储能|创新药|新药|生物医药|高景气|战略性新兴产业"
EXPANSION = r"扩产|扩建|新建产能|产能(?:建设|扩充|提升|增加|爬坡)|产业化(?:项目|能力建设|建设)|新建.{0,16}(?:生产线|工厂|基地)|生产基地|制造基地|生产线|设备购置"
CORE_BUSINESS = r"主营业务|主业|围绕.{0,20}(?:主营|核心业务|核心产品)|现有业务|现有产品|核心器件|核心产品"
# Purposes of money.
LIQUIDITY = ["补充流动资金", "补流"]
DEBTS = ["偿还贷款", "偿还借款", "偿还债务", "偿还有息负债", "偿还银行贷款", "偿还银行借款", "偿还银行债务", "偿还银行有息负债", "归还贷款", "归还借款", "归还银行贷款", "归还银行借款"]
HIGH_INTEREST = r"高息债务|高利率债务|高成本有息负债"
SAVES_INTEREST = r"降低财务费用|减少利息支出|降低利息费用"
# Who subscribes, and how much.
INSIDERS = "控股股东|实际控制人|实控人|董事|高级管理人员|高管|管理层"
MUCH = "全额|全部|大额|全数|不低于[^。]{0,16}(?:亿元|万元)"
INTERNAL = [rf"(?:{INSIDERS})[^。]{{0,80}}?(?:{MUCH})[^。]{{0,35}}?认购", rf"(?:{INSIDERS})[^。]{{0,45}}?认购[^。]{{0,35}}?(?:{MUCH})", rf"发行对象(?:仅)?为[^。]{{0,30}}?(?:{INSIDERS})"]
STRATEGIC = ["(?:战略投资者|战略投资方|产业资本|产业投资者|头部产业资本|产业方)[^。]{0,80}?(?:认购|参与认购|引入)", "(?:认购|引入)[^。]{0,80}?(?:战略投资者|产业资本|产业投资者)"]
FINANCIAL = ["纯财务投资者", "发行对象[^。]{0,80}?均为财务(?:性)?投资者", "财务(?:性)?投资者[^。]{0,50}?认购"]
UNDECIDED = ["尚未确定(?:本次)?(?:具体)?(?:发行的)?发行对象", r"发行对象不超过\s*[0-9一二三四五六七八九十两]+\s*名[^。]{0,180}?最终发行对象[^。]{0,80}?确定"]
NAMED = "发行对象(?:仅)?为[^。]{1,100}"
# Lock-up, price and dilution clauses.
LOCKUP = [r"锁定期(?:为)?\s*([0-9]+|[一二两三四五六七八九十]+)\s*个月", r"限售期(?:为)?\s*([0-9]+|[一二两三四五六七八九十]+)\s*个月", r"发行结束之日起\s*([0-9]+|[一二两三四五六七八九十]+)\s*个月内不得转让"]
FIXED_PRICE = r"发行价格(?:确定)?\s*(?:为|:)\s*(?:人民币)?\s*([0-9][0-9,.]*)\s*元"
FLOOR_PRICE = r"发行价格不低于[^。]{0,180}?(?:交易均价|股票均价|均价)[^。]{0,60}?(百分之[零〇一二两三四五六七八九十百点0-9.]+|[0-9]+(?:\.[0-9]+)?\s*%)"
DILUTION = [r"发行前[^。；]{0,25}?总股本(?:的)?\s*百分之([零〇一二两三四五六七八九十百点0-9.]+)", r"发行前[^。；]{0,25}?总股本(?:的)?\s*([0-9]+(?:\.[0-9]+)?)\s*%"]
SHARES_ISSUED = r"发行(?:股票)?数量[^。；]{0,40}?(?:不超过|上限为)\s*([0-9][0-9,.]*\s*万?股)"
SHARES_BEFORE = r"发行前[^。；]{0,30}?总股本(?:为)?\s*([0-9][0-9,.]*\s*万?股)"
DIRECT_SHARE = r"(?:产业项目|产业化项目|扩产项目|项目建设)[^。]{0,60}?(?:占募集资金(?:总额)?|比例为)\s*([0-9]+(?:\.[0-9]+)?)\s*%"

SUM = r"([0-9][0-9,.]*\s*(?:亿元|万元|元))"
#: A purpose this near a sum of a project makes it a sum for that purpose.
NEAR = 28


def is_plan(title: Column) -> Column:
    """The plan itself, not one of the papers that come with it."""
    plain = F.regexp_replace(tx.compatible(F.coalesce(title, F.lit(""))), r"\s+", "")
    return plain.contains("预案") & ~plain.rlike(NOT_PLANS) & plain.rlike(PLACEMENTS)


def plain(body: Column) -> Column:
    """Compatibility form with single spaces."""
    return F.trim(F.regexp_replace(tx.compatible(F.coalesce(body, F.lit(""))), r"[ \t\r\n]+", " "))


def _number(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"^[0-9][0-9,.]*", 0), ",", "").try_cast("double")


def ten_thousands(amount: Column) -> Column:
    """A sum with its unit in ten thousands of the currency."""
    return _number(amount) * F.when(amount.endswith("亿元"), 1e4).when(amount.endswith("万元"), 1.0).otherwise(1e-4)


def _sums(text: Column, pattern: str, words: str) -> Column:
    """The sums that a pattern gives, which is tried only where what all its matches hold stands."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), ten_thousands)
    return F.when(rules.found(text, words), F.filter(found, lambda x: x > 0)).otherwise(F.array().cast("array<double>"))


def near_purpose(text: Column, purpose: str) -> Column:
    """The largest sum that stands before or after a purpose within its clause."""
    before, after = rf"{SUM}[^,，;；。]{{0,45}}?(?:{purpose})", rf"(?:{purpose})[^,，;；。]{{0,55}}?{SUM}"
    return F.array_max(F.concat(_sums(text, before, purpose), _sums(text, after, purpose)))


def _either(words: list[str]) -> str:
    """A pattern for any of the words, none of which begins another: those that begin alike are told apart behind their beginning."""
    tails: dict[str, list[str]] = {}
    for w in words:
        tails.setdefault(w[:2], []).append(w[2:])
    return "|".join(f"{head}(?:{'|'.join(rest)})" for head, rest in tails.items())


def total_raised(text: Column) -> Column:
    """The largest sum raised; one that is used, put or meant for something is a part and doesn't count."""
    pattern = rf"(?s)(?=募集资金)(?<!(?:使用|投入|用于).{{0,12}})募集资金(?:总额)?\s*(?:预计)?\s*(?:不超过|不高于|上限(?:为)?|为)?\s*(?:人民币)?\s*{SUM}"
    return F.array_max(_sums(text, pattern, "募集资金"))


def project_sums(text: Column) -> Column:
    """The distinct sums for projects; purposes that are no projects must not stand within NEAR letters."""
    words = [*LIQUIDITY, *DEBTS]
    behind = "|".join(f"{w}.{{0,{NEAR - len(w)}}}" for w in words)
    ahead = "|".join(f".{{0,{NEAR - len(w)}}}{w}" for w in words)
    pattern = rf"(?s)(?=拟[使投])(?<!{behind})拟(?:使用|投入)(?:本次)?募集资金(?:金额|额)?\s*{SUM}(?!{ahead})"
    return F.array_distinct(F.transform(_sums(text, pattern, "拟使用|拟投入"), lambda x: F.round(x, 4)))


def projects_together(found: Column, total: Column) -> Column:
    """What the projects need together; null if that is more than is raised."""
    # beside others, the whole sum repeated isn't one more project
    parts = F.when(total.isNotNull() & (F.size(found) > 1), F.filter(found, lambda x: F.abs(x - total) > F.greatest(F.lit(1.0), total * 0.001))).otherwise(found)
    amount = F.reduce(parts, F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(parts) > 0) & (total.isNull() | (amount <= total * 1.01)), amount)


def numeral(c: Column) -> Column:
    """A number in digits, Chinese numerals or Chinese digits one by one."""
    digits = F.translate(c, "零〇一二两三四五六七八九点", "001223456789.")
    listed = F.when(c.rlike(r"^[零〇一二两三四五六七八九]+(点[零〇一二两三四五六七八九]+)?$"), digits.try_cast("double"))
    plain_digits = F.when(c.rlike(r"^[0-9]+(\.[0-9]+)?$"), c.try_cast("double"))
    return F.coalesce(plain_digits, listed, tx.chinese_number(F.when(c.startswith("百"), F.concat(F.lit("一"), c)).otherwise(c)))


def _first(text: Column, patterns: list[str]) -> Column:
    """What the first pattern that is found gives, even if it is no number."""
    return F.coalesce(*[F.when(rules.found(text, p), F.regexp_extract(text, p, 1)) for p in patterns])


def dilution_pct(stated: Column, issued: Column, before: Column) -> Column:
    """Shares to be issued over those before, as stated in per cent or worked out from both numbers."""
    shares = lambda n: _number(n) * F.when(n.endswith("万股"), 1e4).otherwise(1.0)
    return F.when(stated.isNotNull(), numeral(stated)).otherwise(F.try_divide(shares(issued), shares(before)) * 100)


def _any(text: Column, patterns: list[str]) -> Column:
    return functools.reduce(Column.__or__, [rules.found(text, p) for p in patterns])


def metrics(text: Column, current_price: Column) -> Column:
    """Everything that a plan's plain text says, as a struct. `text` is a column that plain() was put into before.

    total, liquidity, debt and project sums in ten thousands; shares of liquidity and projects in the total;
    dilution_pct, lockup_months, pricing (fixed, auction_floor, unknown), price, floor_ratio, price_ratio (over the
    current price), flags, and what is known of investors (null: nothing).
    """
    flow_words, debt_words = "|".join(LIQUIDITY), _either(DEBTS)
    has = lambda p: rules.found(text, p)
    found = F.struct(
        total_raised(text).alias("total"),
        near_purpose(text, flow_words).alias("flow"),
        near_purpose(text, debt_words).alias("debt"),
        near_purpose(text, rf"(?:{flow_words})(?:及|与|和)(?:{debt_words})").alias("both"),
        (has(HIGH_INTEREST) & has(SAVES_INTEREST) & has(debt_words)).alias("costly"),
        has(EXPANSION).alias("expansion"),
        (has(flow_words) | has(debt_words)).alias("purposes"),
        (F.when(has(DIRECT_SHARE), F.regexp_extract(text, DIRECT_SHARE, 1).try_cast("double")) / 100).alias("direct"),
        F.when(has(FIXED_PRICE), _number(F.regexp_extract(text, FIXED_PRICE, 1))).alias("price"),
        F.regexp_replace(F.when(has(FLOOR_PRICE), F.regexp_extract(text, FLOOR_PRICE, 1)), r"百分之|\s*%", "").alias("floor"),
        _any(text, INTERNAL).alias("internal"),
        (has("认购|引入") & _any(text, STRATEGIC)).alias("strategic"),
        _any(text, FINANCIAL).alias("financial"),
        _any(text, UNDECIDED).alias("undecided"),
        has(NAMED).alias("named"),
        project_sums(text).alias("parts"),
        _first(text, DILUTION).alias("stated"),
        _first(text, [SHARES_ISSUED]).alias("issued"),
        _first(text, [SHARES_BEFORE]).alias("before"),
        _first(text, LOCKUP).alias("lockup"),
        has(HIGH_GROWTH).alias("growth"),
        has(CORE_BUSINESS).alias("core"),
        (text != "").alias("has_text"),
    )

    def sums(f: Column) -> Column:
        ordinary_debt = F.when(f["costly"], 0.0).otherwise(F.coalesce(f["debt"], F.lit(0.0)))
        ordinary = F.coalesce(f["both"], F.coalesce(f["flow"], F.lit(0.0)) + ordinary_debt)
        stated = projects_together(f["parts"], f["total"])
        rest = F.when(f["total"].isNotNull() & (ordinary > 0) & f["expansion"], F.greatest(F.lit(0.0), f["total"] - ordinary))
        return F.struct(f.alias("f"), ordinary.alias("ordinary"), F.coalesce(stated, rest, f["total"] * f["direct"]).alias("projects"), (numeral(f["floor"]) / 100).alias("floor_ratio"))

    def derive(s: Column) -> Column:
        f, ordinary, projects, floor_ratio = s["f"], s["ordinary"], s["projects"], s["floor_ratio"]
        share = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / f["total"]))
        known = F.when(f["undecided"], False).when(f["internal"] | f["strategic"] | f["financial"] | f["named"], True)
        return F.struct(
            f["has_text"].alias("has_text"),
            f["total"].alias("total"),
            f["flow"].alias("liquidity"),
            F.when(~f["costly"], f["debt"]).alias("ordinary_debt"),
            F.when(f["costly"], f["debt"]).alias("high_interest_debt"),
            F.when((f["total"] > 0) & (ordinary > 0), share(ordinary)).when((f["total"] > 0) & f["purposes"], 0.0).alias("liquidity_ratio"),
            projects.alias("projects"),
            F.coalesce(f["direct"], F.when(f["total"] > 0, F.when(projects.isNotNull(), share(projects)))).alias("project_ratio"),
            dilution_pct(f["stated"], f["issued"], f["before"]).alias("dilution_pct"),
            F.floor(numeral(f["lockup"])).cast("int").alias("lockup_months"),
            F.when(f["price"].isNotNull(), "fixed").when(floor_ratio.isNotNull(), "auction_floor").otherwise("unknown").alias("pricing"),
            f["price"].alias("price"),
            floor_ratio.alias("floor_ratio"),
            F.when(current_price > 0, f["price"] / current_price).alias("price_ratio"),
            f["growth"].alias("high_growth"),
            f["expansion"].alias("expansion"),
            f["core"].alias("core_business"),
            f["costly"].alias("high_interest"),
            f["internal"].alias("internal"),
            f["strategic"].alias("strategic"),
            f["financial"].alias("financial"),
            known.alias("investors_known"),
        )

    # what the text holds is looked for once, and worked out from there: a lambda's own parts would be looked for at each use
    return rules.once(rules.once(found, sums), derive)


def signals(m: Column, over_average: Column, place_60d: Column) -> Column:
    """array<struct<label, weight>> of a plan by its metrics, the price over its average and its place in 60 days' range."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    expands = yes((m["project_ratio"] >= 0.5) & m["expansion"] & m["high_growth"] & m["core_business"])
    hit = lambda label, weight: F.struct(F.lit(label).alias("label"), F.lit(weight).alias("weight"))
    liquid, ratio = m["liquidity_ratio"], m["price_ratio"]
    return F.array_compact(
        F.array(
            # of what the money is for, the first that holds
            F.when(expands, hit("定增投向主业扩产", 7)).when(liquid >= 0.5, hit("定增补流/还贷为主", -2)).when(liquid >= 0.2, hit("定增补流占比较高", -1)),
            F.when(m["dilution_pct"] >= 30, hit("定增严重稀释", -5)),
            F.when(m["internal"], hit("定增内部人认购", 3)),
            F.when(m["strategic"], hit("定增产业资本认购", 2)),
            F.when(m["high_interest"], hit("定增偿还高息债", 2)),
            F.when(ratio >= 0.95, hit("定增高价发行", 3)).when(ratio <= 0.8, hit("定增大幅折价", -3)),
            F.when(yes(over_average > 1.1) | yes(place_60d > 0.7), hit("定增高位发行", -2)),
            F.when(m["financial"] & ~m["internal"] & ~m["strategic"], hit("定增纯财务投资", -1)),
        )
    )


def score(found: Column) -> Column:
    return F.reduce(found, F.lit(0), lambda s, x: s + x["weight"])
