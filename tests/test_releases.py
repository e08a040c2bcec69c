import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.operators import releases
from tickloom.sources import readers


def figures(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    return [r["m"].asDict() for r in df.select("id", releases.metrics(releases.page_text(F.col("html"))).alias("m")).orderBy("id").collect()]


def test_page_text(spark):
    html = "<p>a&nbsp;&amp;lt;b&#39;</p>　<STYLE x>p{}</STYLE><script>\nvar t='</p>'</script >no</script> end<br/>"
    row = spark.createDataFrame([(html,), (None,), ("",)], "h string").select(releases.page_text(F.col("h")).alias("t")).collect()
    assert [r["t"] for r in row] == ["a end", None, ""]  # references come first, so what they make a tag goes as one


def test_signs_and_what_lacks(spark):
    up, down, other, none, null = figures(
        spark,
        "上半年国内生产总值616836亿元，按不变价格计算，同比增长5.0%。分季度看，一季度同比增长5.3%，二季度增长4.7%。从环比看，二季度国内生产总值增长0.7%。",
        "<p>6 月份， 社会消费品零售总额<b>40732</b>亿元，同比下降<i> 2.0%</i></p><p>6月份，规模以上工业增加值同比下降5.3%</p>",
        "6月份社会消费品零售总额1亿元同比增长-2%。上半年全国固定资产投资（不含农户）245391亿元，同比增长3.9%；6月份，全国城镇调查失业率为5.0%",
        "一季度国内生产总值1亿元。同比增长5.0%。上半年国内生产总值2亿元。同比增长5.0%",
        None,
    )
    assert up["half_gdp_amount"] == 616836 and up["half_gdp"] == 5.0 and up["quarter_gdp"] == 4.7 and up["quarter_gdp_qoq"] == 0.7 and up["retail"] is None
    assert down["retail_amount"] == 40732 and down["retail"] == -2.0 and down["industrial"] == -5.3 and down["half_gdp"] is None
    assert other["retail"] is None and other["fixed_investment"] == 3.9 and other["unemployment"] == 5.0
    assert set(none.values()) == {None} and set(null.values()) == {None}


def test_numbers_that_are_none(spark):
    (m,) = figures(spark, "6月份，全国城镇调查失业率为5.0.1%")
    assert m["unemployment"] is None


def test_links(spark):
    html = '<a href="/a/t20240717_1.html">一 <b>二</b></a><a href="/a/t20240717_1.html" title="三&amp;四">x</a><a href=\'t20241399_2.html\'>bad day</a><a>no</a><a href="t20240101_3.html">答记者问</a>'
    rows = releases.release_links(spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, h string"), "id", "h").orderBy("path").collect()
    assert [(r["title"], r["path"], r["date"]) for r in rows] == [("三&四", "/a/t20240717_1.html", dt.date(2024, 7, 17)), ("bad day", "t20241399_2.html", None)]


def test_concept_list(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes('﻿rank,stock_code,concept_name,extra\n2,600001,"b, ""q""",x\n1,600001,a,x\nx,600001,0,x\n9,600001,a,x\n,7,  ,x\n3,,lost,x\n1,1234567,z,x\n'.encode())
    got = {r["code"]: r["concepts"] for r in readers.concept_list(spark, str(tmp_path / "w.csv")).collect()}
    assert got == {"600001": ["a", 'b, "q"', "0"], "000007": [], "1234567": ["z"]}
    (tmp_path / "bare.csv").write_text("stock_code\n5\n5\n")
    assert [(r["code"], r["concepts"]) for r in readers.concept_list(spark, str(tmp_path / "bare.csv")).collect()] == [("000005", [])]
    (tmp_path / "none.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.concept_list(spark, str(tmp_path / "none.csv"))
