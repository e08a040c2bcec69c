"""Readers of the formats that feeds come in, and writers that replace only what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_SCHEMA = "date date, open double, high double, low double, close double, volume double"


def symbol_files(spark: SparkSession, path: str, first: str = "2013-01-04", last: str = "2025-12-31", least: int = 252) -> tuple[DataFrame, DataFrame]:
    """One Parquet file for each symbol, named by its code (S1, S2): usable bars, and the reason each other code is out."""
    bars = spark.read.schema(BAR_SCHEMA).parquet(path).withColumn("code", F.regexp_extract(F.input_file_name(), r"([^/]+)\.parquet$", 1))
    bars = bars.where(F.col("date").between(first, last))
    bad = F.col("close").isNull() | F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("volume").isNull()
    bad = bad | (F.least("open", "high", "low", "close") <= 0) | (F.col("volume") < 0)
    codes = bars.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.bool_or(bad).alias("bad"))
    reason = F.when(~F.col("code").rlike(r"^(sh|sz|bj)?[0-9]{6}$"), "other").when(F.col("n") < least, "short").when(F.col("bad"), "invalid")
    out = codes.select("code", "n", reason.alias("reason")).where("reason is not null")
    return bars.join(out.select("code"), "code", "left_anti"), out


def kline_lines(df: DataFrame, column: str = "line", *keys: str) -> DataFrame:
    """Comma-separated bars of eleven fields, after the columns of `keys`; shorter lines go."""
    f = F.split(column, ",")
    names = ["open", "close", "high", "low", "volume", "amount", "amplitude", "pct_chg", "change", "turnover"]
    rows = df.where(F.size(f) >= 11)
    return rows.select(*keys, F.try_to_date(f[0], "yyyy-MM-dd").alias("date"), *[f[i + 1].try_cast("double").alias(n) for i, n in enumerate(names)])


def quote_lines(df: DataFrame, column: str = "line") -> DataFrame:
    """`df` with the quote of each line `name="…~…";` by its places (S10): close, pre_close, volume, open, date, pct_chg, high, low.

    Lines without quotes or with under five fields go. The change is made anew, to two places, where the previous
    price is above zero.
    """
    f = F.split(F.regexp_extract(column, '="([^"]*)"', 1), "~")
    number = lambda i: F.coalesce(F.get(f, F.lit(i)).try_cast("double"), F.lit(0.0))
    change = (F.col("close") - F.col("pre_close")) / F.col("pre_close") * 100
    rows = df.where(F.size(f) >= 5).withColumns({"close": number(3), "pre_close": number(4), "volume": number(6), "open": number(9), "date": F.try_to_date(F.left(F.get(f, F.lit(30)), F.lit(8)), "yyyyMMdd"), "given": number(32), "high": number(33), "low": number(34)})
    return rows.withColumn("pct_chg", F.when(F.col("pre_close") > 0, F.floor(change * 100 + 0.5) / 100).otherwise(F.col("given"))).drop("given", column)


def digest_blocks(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, handle, url, likes, retweets, replies, body of each block of a digest (S24): blocks stand between rules; the
    body is what lies between the header and the link line, without media lines."""
    block = F.explode(F.split(column, r"\n-{3,}\n")).alias("block")
    rows = df.select(key, block).where(F.col("block").rlike(r"##\s+@[A-Za-z0-9_]+\s+-\s+\S"))
    count = lambda name: F.nullif(F.regexp_extract("block", rf"(?m)^URL\s+\S+.*?\s{name}\s+(\d+)", 1), F.lit("")).cast("long")
    lines = F.split(F.regexp_extract("block", r"(?s)##\s+@[^\n]*\n(.*?)(?:\nURL |$)", 1), "\n")
    body = F.trim(F.regexp_replace(F.array_join(F.filter(lines, lambda x: ~x.rlike("^(optional )?media:")), " "), r"\s+", " "))
    rows = rows.select(key, F.regexp_extract("block", r"##\s+@([A-Za-z0-9_]+)", 1).alias("handle"), F.nullif(F.regexp_extract("block", r"(?m)^URL\s+(https?://\S+)", 1), F.lit("")).alias("url"), count("heart").alias("likes"), count("retweet").alias("retweets"), count("reply").alias("replies"), body.alias("body"))
    return rows.where("body <> ''")


def json_rows(spark: SparkSession, path: str, schema: str = "rows array<struct<date:string,open:double,high:double,low:double,close:double,volume:double>>") -> DataFrame:
    """Documents with an array of rows, one file each."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("rows"))


def json_lines(spark: SparkSession, path: str, schema: str, last_files: int | None = None) -> DataFrame:
    """JSON lines, broken ones dropped; of dated files only the last few by name."""
    paths: str | list[str] = path
    if last_files is not None:  # names first: files that aren't wanted aren't read
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at if any(x in path for x in "*?[{") else spark._jvm.org.apache.hadoop.fs.Path(at, "*"))
        paths = sorted(str(f.getPath()) for f in found or [] if f.isFile())[-last_files:]
        if not paths:
            return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def delimited(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated if the header has a tab, else comma-separated, with quotes."""
    head = spark.read.text(path).limit(1).collect()
    sep = "\t" if head and "\t" in head[0][0] else ","
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def concept_list(spark: SparkSession, path: str, code: str = "stock_code", concept: str = "concept_name", rank: str = "rank") -> DataFrame:
    """code, concepts of a watch list in CSV with a header in any order, with or without a byte order mark.

    Codes are filled up to six digits; a code without a concept has none; concepts are trimmed, each once, by their best
    rank, then by name; a rank that is missing or no number counts as 9999. Rows without a code go. A file without the
    column of codes is refused; other columns may lack.
    """
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    names = {name.lstrip("\ufeff").strip().strip('"').lower(): name for name in rows.columns}
    if code not in names:
        raise ValueError(f"no column {code} in {path}")
    of = lambda name: F.trim(F.col(f"`{names[name]}`")) if name in names else F.lit(None).cast("string")
    filled = F.when(F.char_length(of(code)) < 6, F.lpad(of(code), 6, "0")).otherwise(of(code))
    place = F.coalesce(of(rank).try_cast("int"), F.lit(9999))
    rows = rows.where(F.coalesce(of(code), F.lit("")) != "").select(filled.alias("code"), F.nullif(of(concept), F.lit("")).alias("concept"), place.alias("rank"))
    once = rows.groupBy("code", "concept").agg(F.min("rank").alias("rank"))
    named = F.when(F.col("concept").isNotNull(), F.struct("rank", "concept"))
    return once.groupBy("code").agg(F.sort_array(F.collect_list(named))["concept"].alias("concepts"))


def markdown_tables(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, block, row, cells for the lines of pipe tables; separator rows go, blocks need two rows."""
    from pyspark.sql import Window

    lines = df.select(key, F.posexplode(F.split(column, "\n")).alias("at", "line")).withColumn("is_row", F.trim("line").rlike(r"^\|.*\|$"))
    w = Window.partitionBy(key).orderBy("at")
    rows = lines.withColumn("block", F.sum(F.when(F.col("is_row"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("is_row")
    rows = rows.where(~F.trim("line").rlike(r"^\|[\s:|\-]+\|$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = rows.select(key, "block", F.row_number().over(Window.partitionBy(key, "block").orderBy("at")).alias("row"), F.count(F.lit(1)).over(Window.partitionBy(key, "block")).alias("n"), cells.alias("cells"))
    return rows.where("n >= 2").drop("n")


def feed_entries(df: DataFrame, key: str, column: str, tag: str = "item") -> DataFrame:
    """key, title, link, published for each entry of RSS or Atom text."""
    entry = F.explode(F.regexp_extract_all(column, F.lit(rf"(?s)<{tag}[ >].*?</{tag}>"), 0))
    inner = lambda name: F.trim(F.regexp_replace(F.regexp_extract("entry", rf"(?s)<{name}[^>]*>(.*?)</{name}>", 1), r"^<!\[CDATA\[|\]\]>$", ""))
    return df.select(key, entry.alias("entry")).select(key, inner("title").alias("title"), inner("link").alias("link"), inner("pubDate").alias("published"))


def html_tables(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, table, row, cells of every table with two rows or more, white space collapsed."""
    table = F.posexplode(F.regexp_extract_all(column, F.lit(r"(?is)<table[^>]*>.*?</table>"), 0)).alias("table", "html")
    rows = df.select(key, table).withColumn("rows", F.regexp_extract_all("html", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).where("size(rows) >= 2")
    rows = rows.select(key, "table", F.posexplode("rows").alias("row", "html"))
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", " "), r"\s+", " "))
    return rows.select(key, "table", "row", F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), clean).alias("cells"))


def linked_data(df: DataFrame, key: str, column: str, kind: str = "Dataset") -> DataFrame:
    """key, name, json of the linked-data scripts of one type; broken scripts go."""
    script = F.explode(F.regexp_extract_all(column, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)).alias("json")
    rows = df.select(key, script)
    return rows.where(F.get_json_object("json", "$['@type']") == kind).select(key, F.get_json_object("json", "$.name").alias("name"), "json")


def write_days(df: DataFrame, path: str, day: str = "date") -> None:
    """Replace only the days that `df` has (K3)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Write unless the stored rows are the same set (K2)."""
    spark = df.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        old = None
    if old is not None and sorted(old.columns) == sorted(df.columns):
        mark = lambda x: x.select(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)").alias("h")).agg(F.count("h"), F.sum("h")).first()
        if mark(old) == mark(df):
            return False
    # beside the old rows first, which `df` may still read
    fs, at = _files(spark, path)
    fresh = _files(spark, f"{path.rstrip('/')}__new")[1]
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}__new")
    fs.delete(at, True)
    fs.rename(fresh, at)
    return True


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at
