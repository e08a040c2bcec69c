"""Releases in pages: signed figures and links out of whole html, and watch lists in delimited files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import releases as r
from tickloom.plans.register import query
from tickloom.sources import readers, scratch
from tickloom.sources import tables as t


def _tenths(value):
    """A whole number of tenths as a page shows it."""
    return F.concat(F.floor(value / 10).cast("string"), F.lit("."), (value % 10).cast("string"))


def release_pages(spark, sf_dir):
    """page_id, html: every page with a release put before its own content, worded by the page's number.

    Of seven pages one has no release and one has it in a script only; the others have all sentences, some without
    amounts, with tags, references or wide spaces between the words.
    """
    k, shape = F.col("page_id"), F.col("page_id") % 7
    moved = lambda n: F.when((k + n) % 3 == 0, "下降").otherwise("增长")
    tag = F.when(shape == 1, "<b> ").otherwise("")
    end = F.when(shape == 1, "</b>\n").otherwise("")
    gap = F.when(shape == 2, "&nbsp;").when(shape == 3, "　").otherwise("")
    amount = lambda n: F.concat(tag, _tenths(k * n % 900_000 + 1), end, F.lit("亿元，"))
    share = lambda n: F.concat(tag, _tenths(k * n % 150), F.lit("%"), end)
    body = F.concat(
        F.when(shape == 4, "").otherwise(F.concat(F.lit("上半年国内生产总值"), amount(37), F.lit("按不变价格计算，同比"), moved(0), share(7), F.lit("。"))),
        F.lit("分季度看，一季度同比增长9.9%，二季度"), moved(1), share(11), F.lit("。从环比看，二季度国内生产总值"), moved(2), share(13), F.lit("。6"), gap,
        F.lit("月份，规模以上工业增加值同比"), moved(3), share(17), F.lit("。6月份，社会消费品零售总额"), amount(41), F.lit("同比"), moved(4), share(19),
        F.lit("。上半年，全国固定资产投资（不含农户）"), amount(43), F.lit("同比"), moved(5), share(23), F.lit("。6月份，全国城镇调查失业率为"), share(29), F.lit("。"),
    )
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (k % 1500).cast("int")), "yyyyMMdd")
    name = lambda n: F.concat(F.lit("./sj/t"), day, F.lit(f"_{n}"), k.cast("string"), F.lit(".html"))
    links = F.concat(
        F.lit("<a class=x href='"), name(1), F.lit("' title='首页'>old</a><A HREF=\""), name(1), F.lit('"><i>数据 &amp; 图</i> '), k.cast("string"), F.lit('</A><a href="'), name(2),
        F.lit('" title="数据解读">x</a><a href="/t2020_1.html">undated</a><a href="'), name(3), F.lit('"><img src=x></a>'),
    )
    block = F.when(shape == 5, F.concat(F.lit("<SCRIPT>var s = '"), body, F.lit("';</SCRIPT>"))).when(shape == 6, "").otherwise(F.concat(F.lit("<p>"), body, F.lit("</p>")))
    return t.read(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("<body>"), F.concat(F.lit("<body>"), links, block)).alias("html"))


def _share_sql(n, moved):
    return f"CASE WHEN page_id % 7 < 5 THEN (page_id * {n} % 150) / 10.0::DOUBLE * CASE WHEN (page_id + {moved}) % 3 = 0 THEN -1 ELSE 1 END END"


def _amount_sql(n):
    return f"CASE WHEN page_id % 7 < 5 THEN (page_id * {n} % 900000 + 1) / 10.0::DOUBLE END"


@query(f"""WITH m AS (SELECT page_id, {_amount_sql(37)} AS a, {_share_sql(7, 0)} AS b, {_share_sql(11, 1)} AS quarter_gdp, {_share_sql(13, 2)} AS quarter_gdp_qoq, {_share_sql(17, 3)} AS industrial, {_amount_sql(41)} AS retail_amount,
  {_share_sql(19, 4)} AS retail, {_amount_sql(43)} AS fixed_investment_amount, {_share_sql(23, 5)} AS fixed_investment, CASE WHEN page_id % 7 < 5 THEN (page_id * 29 % 150) / 10.0::DOUBLE END AS unemployment FROM pages)
SELECT * EXCLUDE (a, b), CASE WHEN page_id % 7 <> 4 THEN a END AS half_gdp_amount, CASE WHEN page_id % 7 <> 4 THEN b END AS half_gdp FROM m""")
def release_figures(spark, sf_dir):
    """Signed figures of the release that a page holds, out of the text of its whole html."""
    rows = release_pages(spark, sf_dir)
    return rows.select("page_id", r.metrics(r.page_text(F.col("html"))).alias("m")).select("page_id", "m.*")


@query("""SELECT page_id, '数据 & 图 ' || page_id AS title, './sj/t' || strftime(DATE '2020-01-01' + CAST(page_id % 1500 AS INTEGER), '%Y%m%d') || '_1' || page_id || '.html' AS path, DATE '2020-01-01' + CAST(page_id % 1500 AS INTEGER) AS date FROM pages""")
def release_links(spark, sf_dir):
    """Dated links of a page with their titles; of one address the last, without those that explain or have no text."""
    return r.release_links(release_pages(spark, sf_dir), "page_id", "html")


_PLAIN = "html"
for _reference, _sign in r.REFERENCES:
    _PLAIN = f"regexp_replace({_PLAIN}, '(?i){_reference}', {chr(39) + _sign.replace(chr(39), chr(39) * 2) + chr(39)}, 'g')"
for _pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"<[^>]+>", r"[\s\x{a0}\x{2002}\x{2003}\x{3000}]+"):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', ' ', 'g')"


@query(f"""SELECT page_id, length(p) AS n_chars, md5(p) AS digest FROM (SELECT page_id, trim({_PLAIN}) AS p FROM pages)""")
def page_texts(spark, sf_dir):
    """The plain text of a page: references decoded, scripts, styles and tags gone, white space squeezed."""
    rows = t.read(spark, sf_dir, "pages").select("page_id", r.page_text(F.col("html")).alias("p"))
    return rows.select("page_id", F.char_length("p").alias("n_chars"), F.md5(F.col("p").cast("binary")).alias("digest"))


@query("""WITH l AS (SELECT lpad(l_suppkey::VARCHAR, CAST(greatest(6, length(l_suppkey::VARCHAR)) AS INTEGER), '0') AS code, 'c, "' || p_type || '" ' || p_size % 7 AS concept, CASE WHEN l_quantity < 3 THEN 9999 ELSE CAST(l_quantity AS INTEGER) END AS rank FROM lineitem JOIN part ON l_partkey = p_partkey),
o AS (SELECT code, concept, min(rank) AS rank FROM l GROUP BY 1, 2)
SELECT code, string_agg(concept, ';' ORDER BY rank, concept) AS concepts FROM o GROUP BY 1""")
def concept_list(spark, sf_dir):
    """A watch list written as CSV with quotes and a header, read back: each code's concepts by best rank, then name."""
    lines, parts = t.read(spark, sf_dir, "lineitem"), t.read(spark, sf_dir, "part")
    concept = F.concat(F.lit(' c, "'), F.col("p_type"), F.lit('" '), (F.col("p_size") % 7).cast("string"), F.lit(" "))
    rank = F.when(F.col("l_quantity") < 3, "none").otherwise(F.col("l_quantity").cast("int").cast("string"))
    rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(concept.alias("concept_name"), rank.alias("rank"), F.col("l_suppkey").cast("string").alias("stock_code"))
    path = scratch.folder(spark)
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.concept_list(spark, path).select("code", F.array_join("concepts", ";").alias("concepts"))
