import datetime as dt

from pyspark.sql import functions as F

from tickloom.sources import readers, versions
from tickloom.streaming import incremental


def test_kline_lines(spark):
    df = spark.createDataFrame([("2024-01-02,1,2,3,0.5,100,1e6,1,5,0.1,2.5",), ("short,1",), (None,)], "line string")
    rows = readers.kline_lines(df).collect()
    assert len(rows) == 1 and rows[0]["date"] == dt.date(2024, 1, 2) and rows[0]["close"] == 2.0 and rows[0]["turnover"] == 2.5


def test_markdown_tables(spark):
    text = "intro\n| a | b |\n|---|:-:|\n| 1 | 2 |\n\n| alone | x |\n"
    rows = readers.markdown_tables(spark.createDataFrame([(1, text), (2, None)], "id int, text string"), "id", "text").orderBy("row").collect()
    assert [r["cells"] for r in rows] == [["a", "b"], ["1", "2"]]


def test_feed(spark):
    xml = "<rss><item><title><![CDATA[A & B]]></title><link>u</link><pubDate>d</pubDate></item><item><title>C</title></item></rss>"
    rows = readers.feed_entries(spark.createDataFrame([(1, xml)], "id int, x string"), "id", "x").collect()
    assert [(r["title"], r["link"]) for r in rows] == [("A & B", "u"), ("C", "")]


def test_html_tables_and_linked_data(spark):
    page = "<table><tr><th>a</th><td>b  <b>c</b></td></tr>\n<tr><td>1</td><td>2</td></tr></table><table><tr><td>x</td></tr></table>"
    page += '<script type="application/ld+json">{"@type": "Dataset", "name": "n"}</script><script type="application/ld+json">{broken</script>'
    df = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    assert [r["cells"] for r in readers.html_tables(df, "id", "html").orderBy("row").collect()] == [["a", "b c"], ["1", "2"]]
    assert [(r["id"], r["name"]) for r in readers.linked_data(df, "id", "html").collect()] == [(1, "n")]


def test_symbol_files(spark, tmp_path):
    def bars(code, n, price=1.0):
        rows = spark.range(n).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"), *[F.lit(price).alias(c) for c in ("open", "high", "low", "close")], F.lit(5.0).alias("volume"))
        rows.toPandas().to_parquet(tmp_path / f"{code}.parquet")

    bars("600000", 5)
    bars("600001", 2)
    bars("600002", 5, -1.0)
    good, out = readers.symbol_files(spark, str(tmp_path), least=3)
    assert {r["code"] for r in good.collect()} == {"600000"}
    assert {r["code"]: r["reason"] for r in out.collect()} == {"600001": "short", "600002": "invalid"}


def test_delimited_and_json(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\tq\n")
    (tmp_path / "b.csv").write_text('x,y\n1,"a, ""b"""\n')
    assert readers.delimited(spark, str(tmp_path / "a.tsv"), "x int, y string").first()["y"] == "q"
    assert readers.delimited(spark, str(tmp_path / "b.csv"), "x int, y string").first()["y"] == 'a, "b"'
    (tmp_path / "j").mkdir()
    for i in range(3):
        (tmp_path / "j" / f"2024-01-0{i + 1}.jsonl").write_text(f'{{"v": {i}}}\nbroken\n')
    assert sorted(r["v"] for r in readers.json_lines(spark, str(tmp_path / "j"), "v int", 2).collect()) == [1, 2]


def test_write_if_changed(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "out")
    assert readers.write_if_changed(df, path) and not readers.write_if_changed(df.orderBy(F.col("k").desc()), path)
    assert readers.write_if_changed(df.where("k = 1"), path) and spark.read.parquet(path).count() == 1


def test_write_days(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = [(dt.date(2024, 1, 1), 1), (dt.date(2024, 1, 2), 2)]
    readers.write_days(spark.createDataFrame(rows, "date date, v int"), path)
    readers.write_days(spark.createDataFrame([(dt.date(2024, 1, 2), 9)], "date date, v int"), path)
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 9]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "k int, ts timestamp, v int"
    spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, 5), 10), (1, dt.datetime(2024, 1, 1, 0, 6), 11), (2, dt.datetime(2024, 1, 1, 0, 7), 20)], schema).write.parquet(source)

    def stream():
        return spark.readStream.schema(schema).parquet(source)

    q = incremental.unseen(stream(), ["k"], "ts").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["k"] for r in spark.table("seen").collect()) == [1, 2]
    out, check = str(tmp_path / "table"), str(tmp_path / "check")
    incremental.upsert_sink(stream(), out, ["k"], [F.col("ts").desc()], check).awaitTermination(60)
    spark.createDataFrame([(2, dt.datetime(2024, 1, 2), 21), (3, dt.datetime(2024, 1, 2), 30)], schema).write.mode("append").parquet(source)
    incremental.upsert_sink(stream(), out, ["k"], [F.col("ts").desc()], check).awaitTermination(60)
    assert sorted((r["k"], r["v"]) for r in versions.read(spark, out).collect()) == [(1, 11), (2, 21), (3, 30)]
    w = incremental.windowed(stream(), "ts", "10 minutes", "k", "v").writeStream.format("memory").queryName("win").outputMode("append").trigger(availableNow=True).start()
    w.awaitTermination(60)
    assert sorted((r["k"], r["n"], r["total"]) for r in spark.table("win").collect()) == [(1, 2, 21), (2, 1, 20)]
