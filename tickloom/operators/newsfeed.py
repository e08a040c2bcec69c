"""News rules: category, signal, score and canonical event key of a headline.

Words and patterns are fixed values of the domain, each table in order of precedence; functions take the text
as a Column and stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions import rules, text

# Words of each category and signal.
PRICE_WORDS = "涨价, 提价, 喊涨, 调涨, 涨价在即, 价格上调, 价格上涨, 报价上涨, 价格调涨, price increase, price hike, asp hike, raise prices, raising prices, contract price, asp, shortage, tight supply, supply shortage, supply shortages, 供不应求, 供给紧张, 供应紧张, 产能紧张, 稼动率, hbm, dram, nand, mlcc, ccl, pcb, 玻纤布, 铜箔, 光模块, cowos, 先进封装, 台积电涨价, tsmc price"
MACRO_WORDS = "非农, cpi, ppi, pce, 通胀, 降息, 加息, 利率, 美联储, fed, fomc, gdp, pmi, 就业, 失业率, 汇率, 美元, 人民币, 财政, 关税, tariff, 地缘, 原油, oil price, 债券, 国债, yield, treasury, 监管, 政策"
HARDWARE_WORDS = "gpu, nvidia, 英伟达, 芯片, 半导体, semiconductor, tsmc, 台积电, broadcom, avgo, asic, hbm, dram, nand, memory, 存储, 服务器, server, datacenter, data center, 数据中心, cowos, 先进封装, 封装, 光模块, optical, photonics, 光通信, pcb, ccl, mlcc, 铜箔, 玻纤布, 晶圆, foundry, 机器人, robotics"
SOFTWARE_WORDS = "openai, anthropic, claude, chatgpt, gpt, gemini, deepmind, llm, large language model, 大模型, 模型, agent, 智能体, ai agent, api, saas, software, 软件, cloud, 云, 开发者, developer, github, hugging face, mcp, 应用, app"
CONSUMER_WORDS = "消费, retail, 零售, 电商, ecommerce, 品牌, 食品, 饮料, 餐饮, coffee, 咖啡, 美妆, 化妆品, 服装, apparel, 旅游, travel, 酒店, 家电, 汽车, auto, ev, tesla, model y, 白酒, 啤酒, 快消"
UP_WORDS = "涨价, 提价, 喊涨, 调涨, 价格上调, 价格上涨, 报价上涨, price increase, price hike, asp hike, raise prices, raising prices, contract price, price floor"
DOWN_WORDS = "降价, 价格下调, 价格下降, 跌价, 砍价, price cut, price decline, price drop, lower prices, margin pressure"
TIGHT_WORDS = "供不应求, 供给紧张, 供应紧张, 产能紧张, 缺货, shortage, tight supply, supply shortage, supply constrained, capacity constrained, bottleneck, 瓶颈, 满产, 产能满载"
SLOW_WORDS = "需求放缓, 需求疲软, 库存上升, 库存压力, 去库存, 砍单, 订单下修, slowdown, weak demand, inventory build, inventory pressure, order cut, cuts orders"
ORDER_WORDS = "订单超预期, 新订单, 大单, 客户导入, 进入供应链, supply chain, design win, customer win, new customer, awarded, contract win, win order"
CAPEX_UP_WORDS = "capex 上修, capex上修, 资本开支上修, 提高资本开支, raise capex, raises capex, capex increase, higher capex, investment plan raised, accelerate investment"
CAPEX_DOWN_WORDS = "capex 下修, capex下修, 资本开支下修, 削减资本开支, cut capex, cuts capex, lower capex, capex reduction, delay datacenter, delay data center"


def _words(table: str) -> str:
    return rules.any_of(table.split(", "))


FED = r"fed|federal reserve|fomc|rate hike|rate cut|interest rate|美联储|联储|加息|降息|利率"
PERMIT = r"approved|approve|批准|获批|plans?\s+to\s+let|allow|permit|greenlight|放行|允许|拟允许|计划允许"
CATEGORIES = [(FED, "宏观"), (_words(PRICE_WORDS), "AI 涨价"), (_words(MACRO_WORDS), "宏观"), (_words(HARDWARE_WORDS), "硬件"), (_words(SOFTWARE_WORDS), "软件"), (_words(CONSUMER_WORDS), "消费")]
#: A table pattern may be several that must all be found, joined by " & ".
SIGNALS = [
    (FED + r"|cpi|pce|通胀|央行|货币政策", "宏观政策"),
    (_words(UP_WORDS), "利好涨价"),
    (_words(DOWN_WORDS), "利空降价"),
    (rf"china|中国|beijing|北京 & {PERMIT} & deepseek|bytedance|字节|alibaba|阿里|top\s+ai\s+firms?|ai\s+firms?|major\s+ai\s+companies|头部ai|ai公司 & h200|nvidia|英伟达", "需求改善"),
    (_words(TIGHT_WORDS), "供需紧张"),
    (_words(SLOW_WORDS), "需求放缓"),
    (_words(ORDER_WORDS), "订单客户突破"),
    (_words(CAPEX_UP_WORDS), "capex上修"),
    (_words(CAPEX_DOWN_WORDS), "capex下修"),
]
SIGNAL_BOOST = {"利好涨价": 42, "利空降价": 38, "供需紧张": 34, "需求放缓": 32, "需求改善": 22, "宏观政策": 20, "订单客户突破": 28, "capex上修": 28, "capex下修": 28}
CATEGORY_BOOST = {"AI 涨价": 34, "硬件": 26, "软件": 22, "宏观": 12, "消费": 16}
SOURCE_BOOST = {"official": 20, "media": 15, "wechat": 18, "newsletter": 16, "academic": 11, "developer": 9, "policy": 12}
NOISE = "村民|棍棒|赶蛇|蛇毒|血清|救治需求|空调|省电|天气|民生|高铁|站房|绿道|景区|婚恋|宠物|养生|病例|医院"
HARD = "ai|算力|gpu|hbm|dram|nand|ssd|mlcc|pcb|ccl|cowos|芯片|半导体|服务器|数据中心|光模块|铜箔|玻纤布|钨|钨矿|金属|涨价|提价|降价|报价|均价|asp|price|shortage|tight supply|订单|客户|出货|产能|库存|供给|供应|需求|景气|capex|资本开支|收入|利润|销量|交付|零售|电商|汽车|家电|白酒|餐饮|旅游|美妆|openai|anthropic|claude|gpt|gemini|deepseek|qwen|llm|agent"
DEMAND = "订单|客户|出货|销量|交付|下游|景气|复苏|回暖|需求改善|需求回升|需求强劲|需求增长|库存去化|供需|产能|收入|利润|业绩"

# Subjects, objects and actions of an event.
SUBJECTS = [
    (r"(?i)openai|chatgpt", "openai"),
    (r"(?i)anthropic|claude", "anthropic"),
    (r"(?i)xai|x\.ai|grok", "xai"),
    (r"(?i)google|gemini|deepmind|\$?googl\b", "google"),
    (r"(?i)meta|zuckerberg|\$?meta\b", "meta"),
    (r"(?i)microsoft|\$?msft\b", "microsoft"),
    (r"(?i)amazon|aws|\$?amzn\b", "amazon"),
    (r"(?i)deepseek", "deepseek"),
    (r"(?i)minimax", "minimax"),
    (r"(?i)kimi|moonshot", "kimi"),
    (r"(?i)nvidia|英伟达|\$?nvda\b", "nvidia"),
    (r"(?i)tsmc|台积电|\$?tsm\b", "tsmc"),
    (r"(?i)samsung|三星", "samsung"),
    (r"(?i)sk hynix|海力士", "sk-hynix"),
    (r"(?i)micron|美光|\$?mu\b", "micron"),
    (r"(?i)china|中国|beijing|北京|alibaba|阿里|bytedance|字节|头部ai|ai firms?", "china-ai-firms"),
]
#: (pattern, key); without a key what was found is the key.
OBJECTS = [
    (r"(?i)\bH200\b", "nvidia-h200"),
    (r"(?i)\b(?:GB200|B200|H100)\b", "nvidia-ai-gpu"),
    (r"(?i)\bGPT[-\s]?\d[\w.-]*", ""),
    (r"(?i)\bGrok\s*\d[\w.-]*", ""),
    (r"(?i)\bClaude\s+[A-Z]?\w+(?:[-\s.]\w+)*", ""),
    (r"(?i)\bGemini\s+[A-Z]?\w+(?:[-\s.]\w+)*", ""),
    (r"(?i)\bLlama\s*\d[\w.-]*", ""),
    (r"(?i)\bDeepSeek[-\s]?\w+", ""),
    (r"(?i)\bQwen\s*\d[\w.-]*", ""),
    (r"(?i)\bMiniMax\s*M\d+(?:[-\w.]*)?\b", ""),
    (r"(?i)hbm", "hbm"),
    (r"(?i)dram|ddr", "dram"),
    (r"(?i)nand|flash", "nand-flash"),
    (r"(?i)mlcc|积层陶瓷电容", "mlcc"),
    (r"(?i)cowos|先进封装", "cowos"),
    (r"(?i)gpu|算力卡|ai\s*chip", "gpu"),
    (r"(?i)钨精矿|黑钨精矿|钨矿|tungsten", "tungsten"),
    (r"(?i)废钨棒材", "waste-tungsten-bar"),
    (r"(?i)data center|datacenter|数据中心", "data-center"),
    (r"(?i)robot|机器人", "robot"),
]
MODEL = r"(?i)gpt|grok|claude|gemini|llama|deepseek|qwen|minimax|kimi"
ACTIONS = [
    (rf"(?i)(?:{PERMIT}) & (?i)buy|purchase|采购|购买|h200|gpu|chip|芯片|算力", "purchase-approval"),
    (r"(?i)发布|推出|上线|launch|release|announc|unveil|roll out|introduce|open[-\s]?source|开源 & model", "model-launch"),
    (r"(?i)涨价|提价|喊涨|调涨|价格上涨|报价上涨|asp|price\s*(increase|hike)|raise\s+prices?", "price-up"),
    (r"(?i)降价|下跌|跌价|回落|下降|price\s*(drop|decline|cut)|lower\s+prices?", "price-down"),
    (r"(?i)供需|短缺|供不应求|供应紧张|产能紧张|tight supply|shortage|constraint|bottleneck", "supply-tight"),
    (r"(?i)需求改善|需求回升|需求强劲|订单|采购|客户|出货|销量|交付|demand|orders?|shipments?|deliveries", "demand-improve"),
    (r"(?i)capex|capital expenditure|资本开支", "capex"),
    (r"(?i)funding|financing|loan|raise|valuation|融资|贷款|估值", "funding"),
]
NEED_SUBJECT = ("model-launch", "purchase-approval", "capex", "funding")


def _all_found(c: Column, pattern: str) -> Column:
    out = F.lit(True)
    for part in pattern.split(" & "):
        out = out & rules.found(c, part)
    return out


def category(title: Column, source_type: Column) -> Column:
    """Category of a headline: rates first, then words in order, then the kind of source."""
    default = F.when(source_type.isin("official", "academic", "developer"), "软件").otherwise("宏观")
    return F.coalesce(rules.once(text.normalise(title), lambda c: rules.first(c, CATEGORIES)), default)


def signal(title: Column) -> Column:
    """The first of ten kinds of signal."""
    return rules.once(text.normalise(title), lambda c: F.coalesce(*[F.when(_all_found(c, p), F.lit(label)) for p, label in SIGNALS], F.lit("普通新闻")))


def recency(hours: Column) -> Column:
    return F.when(hours <= 2, 10).when(hours <= 6, 8).when(hours <= 12, 5).when(hours <= 24, 3).otherwise(0)


def score(title: Column, source_type: Column, base: Column, hours: Column, kind: Column, of: Column) -> Column:
    """Score of a headline from its kind and signal (`kind`, `of`), source, age and context; noise is capped at 72."""
    words = text.normalise(F.concat_ws(" ", title, kind, of))
    met = rules.once(words, lambda c: F.struct(*[rules.found(c, p).alias(name) for name, p in (("hard", HARD), ("demand", DEMAND), ("noise", NOISE))]))
    return rules.once(met, lambda m: _points(title, source_type, base, hours, kind, of, m["hard"], m["demand"], m["noise"]))


def _points(title: Column, source_type: Column, base: Column, hours: Column, kind: Column, of: Column, hard: Column, demand: Column, noise: Column) -> Column:
    improves = of == "需求改善"
    points = (
        F.lit(50)
        + rules.value_of(of, SIGNAL_BOOST, 0)
        + rules.value_of(kind, CATEGORY_BOOST, 0)
        + recency(hours)
        + rules.value_of(source_type, SOURCE_BOOST, 9)
        + F.least(F.lit(8), F.floor(F.char_length(title) / 90).cast("int"))
        + F.when(hard, 12).otherwise(0)
        + F.when(improves & demand, 10).when(improves, -18).otherwise(0)
    )
    return F.when(noise & ~hard, F.least(base, F.lit(72))).otherwise(F.greatest(base, points))


def token(c: Column) -> Column:
    """A name as part of a key: lower case, white space as '-', other signs gone."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", "-"), r"[^\w.-]", ""), r"-+", "-")
    return F.regexp_replace(bare, r"^-|-$", "")


def event_key(title: Column) -> Column:
    """event:subject:action:object, null where object or action lacks, or a subject that the action needs.

    Each part is worked out once: subject and object of a title, then its action, then the key.
    """

    def parts(t: Column) -> Column:
        thing = F.coalesce(*[F.when(t.rlike(p), F.struct(F.regexp_extract(t, p, 0).alias("found"), F.lit(key).alias("key"))) for p, key in OBJECTS])
        return F.struct(t.alias("title"), rules.first(t, SUBJECTS, "").alias("subject"), thing.alias("thing"))

    def acting(s: Column) -> Column:
        t, found = s["title"], s["thing"]["found"]
        action = [F.when((t.rlike(p.removesuffix(" & model")) & found.rlike(MODEL)) if p.endswith(" & model") else _all_found(t, p), F.lit(name)) for p, name in ACTIONS]
        thing = F.when(s["thing"]["key"] != "", s["thing"]["key"]).otherwise(token(found))
        return F.struct(s["subject"].alias("subject"), F.when(found.isNotNull(), F.coalesce(*action)).alias("action"), thing.alias("thing"))

    def key(s: Column) -> Column:
        named = s["subject"] != ""
        ok = s["thing"].isNotNull() & s["action"].isNotNull() & (named | ~s["action"].isin(*NEED_SUBJECT))
        return F.when(ok, F.concat(F.lit("event:"), F.when(named, s["subject"]).otherwise(s["thing"]), F.lit(":"), s["action"], F.lit(":"), s["thing"]))

    return rules.once(rules.once(rules.once(title, parts), acting), key)
