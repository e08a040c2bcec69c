"""Figures of statistical releases: the text of a page, its links, and signed metrics by pattern."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Character references that are decoded, in order.
REFERENCES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;|&#39;", "'")]
# How a release words its figures. A direction word gives the sign.
_UP, _DOWN = "增长", "下降"
_MOVED, _NUMBER = f"({_UP}|{_DOWN})", r"\s*([\d.]+)"
#: (name, pattern, group of the number, group of the direction or 0). Amounts are in hundred millions, the others in per cent.
METRICS = [
    ("half_gdp_amount", rf"上半年国内生产总值{_NUMBER}\s*亿元[^。]*?同比{_MOVED}{_NUMBER}%", 1, 0),
    ("half_gdp", rf"上半年国内生产总值{_NUMBER}\s*亿元[^。]*?同比{_MOVED}{_NUMBER}%", 3, 2),
    ("quarter_gdp", rf"分季度看[^。]*?二季度(?:国内生产总值)?(?:同比)?{_MOVED}{_NUMBER}%", 2, 1),
    ("quarter_gdp_qoq", rf"从环比看[^。]*?二季度国内生产总值{_MOVED}{_NUMBER}%", 2, 1),
    ("industrial", rf"6\s*月份，?\s*规模以上工业增加值同比{_MOVED}{_NUMBER}%", 2, 1),
    ("retail_amount", rf"6\s*月份，?\s*社会消费品零售总额{_NUMBER}\s*亿元，?\s*同比{_MOVED}{_NUMBER}%", 1, 0),
    ("retail", rf"6\s*月份，?\s*社会消费品零售总额{_NUMBER}\s*亿元，?\s*同比{_MOVED}{_NUMBER}%", 3, 2),
    ("fixed_investment_amount", rf"上半年，?全国固定资产投资（不含农户）{_NUMBER}\s*亿元，?同比{_MOVED}{_NUMBER}%", 1, 0),
    ("fixed_investment", rf"上半年，?全国固定资产投资（不含农户）{_NUMBER}\s*亿元，?同比{_MOVED}{_NUMBER}%", 3, 2),
    ("unemployment", rf"6\s*月份，?\s*全国城镇调查失业率为{_NUMBER}%", 1, 0),
]
#: Links that explain a release instead of giving it.
EXPLAINS = "解读|答记者问"


def page_text(html: Column) -> Column:
    """The text of a page: references decoded, scripts, styles and tags as spaces, white space squeezed; null stays null."""
    out = html
    for reference, sign in REFERENCES:
        out = F.regexp_replace(out, f"(?i){reference}", sign)
    out = F.regexp_replace(out, r"(?is)<script\b.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style\b.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]+>", " "), r"[\s\x{a0}\x{2002}\x{2003}\x{3000}]+", " "))


def metrics(text: Column, table: Sequence[tuple[str, str, int, int]] = tuple(METRICS)) -> Column:
    """struct of each metric of the table as a double: minus what fell, plus what rose; null where it isn't stated or no number."""

    def one(found: Column, pattern: str, number: int, moved: int) -> Column:
        value = F.nullif(F.regexp_extract(found, pattern, number), F.lit("")).try_cast("double")
        return F.when(F.regexp_extract(found, pattern, moved) == _DOWN, -F.abs(value)).otherwise(F.abs(value)) if moved else value

    # the text once for all patterns, wherever the optimizer moves the expression
    return F.transform(F.array(text), lambda s: F.struct(*[one(s, pattern, number, moved).alias(name) for name, pattern, number, moved in table]))[0]


def release_links(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, title, path, date of the links of a page whose address holds a date (t20240717_...); of one address the last link counts.

    The title is the link's title, else its text; links without both and those that explain go.
    """
    rows = df.select(key, F.posexplode(F.regexp_extract_all(column, F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))).alias("at", "tag"))
    head = F.regexp_extract("tag", r"(?is)^<a\b([^>]*)>", 1)
    inside = lambda name: F.trim(page_text(F.regexp_extract(head, rf"""(?is)\b{name}\s*=\s*(["'])(.*?)\1""", 2)))
    shown = page_text(F.regexp_extract("tag", r"(?is)^<a\b[^>]*>(.*?)</a>", 1))
    rows = rows.select(key, "at", F.coalesce(F.nullif(inside("title"), F.lit("")), shown).alias("title"), inside("href").alias("path"))
    day = F.regexp_extract("path", r"t(\d{8})_", 1)
    rows = rows.where((F.col("title") != "") & ~F.col("title").rlike(EXPLAINS) & (day != ""))
    rows = rows.withColumn("date", F.try_to_date(day, "yyyyMMdd"))
    return rows.groupBy(key, "path").agg(F.max_by(F.struct("title", "date"), "at").alias("last")).select(key, "last.title", "path", "last.date")
