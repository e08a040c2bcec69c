import datetime as dt

import pytest

from tickloom.functions import extensions


@pytest.fixture(scope="module")
def session(spark):
    extensions.register(spark)
    return spark


def test_scalars_in_sql(session):
    row = session.sql("SELECT percent_change(3, -2) AS a, percent_change(1, 0) AS b, lenient_number(' 1,234.5% ') AS c, lenient_number('nan') AS d, lenient_number('-inf') AS e, held_text('  ') AS f, compatible_text('ＡＢ１') AS g").first()
    assert tuple(row) == (250.0, None, 1234.5, None, None, None, "AB1")


def test_scalars_are_inlined(session):
    plan = session.range(3).selectExpr("percent_change(id, 2) AS p")._jdf.queryExecution().optimizedPlan().toString()
    assert "percent_change" not in plan and "Python" not in plan


def test_rule_tables(session):
    extensions.register_rules(session, "sized", [(r"it's|\bbig\b", 2), ("small", 1)], 0, "INT")
    rows = session.sql("SELECT sized(x) AS v FROM VALUES ('a big small'), ('it''s'), ('bigger'), ('small'), (NULL) AS t(x)").collect()
    assert [r["v"] for r in rows] == [2, 2, 0, 1, 0]
    extensions.register_rules(session, "nothing", [], None)
    assert session.sql("SELECT nothing('x') AS v").first()["v"] is None
    with pytest.raises(ValueError):
        extensions.register_rules(session, "a b", [("x", 1)])


def test_weighted_median_against_a_plain_one(session):
    values = [(k, float(v), n) for k in range(3) for v, n in ((4, 1), (1, 2 + k), (9, 3), (1, 1))] + [(5, None, 2), (5, float("nan"), 1), (6, 1.0, 0)]
    session.createDataFrame(values, "k int, v double, n long").createOrReplaceTempView("weighted")
    got = {r["k"]: r["m"] for r in session.sql("SELECT k, weighted_median(v, n) AS m FROM weighted GROUP BY k").collect()}
    for k in range(3):
        flat = sorted(v for key, v, n in values if key == k for _ in range(n))
        assert got[k] == flat[(len(flat) + 1) // 2 - 1]
    assert got[5] is None and got[6] is None


def test_bars_of_texts(session):
    body = "2024-01-02,1,2,3,0.5,100,more\nbroken\n2024-13-01,1,2,3,4,5\n\n 2024-01-03,2,3,4,1,x\n2024-01-04,2,3,4,1,7"
    session.createDataFrame([(1, body), (2, None), (3, "")], "id int, body string").createOrReplaceTempView("texts")
    rows = session.sql("SELECT id, b.* FROM texts, LATERAL bars_of(body) b ORDER BY at").collect()
    assert [tuple(r) for r in rows] == [(1, 0, dt.date(2024, 1, 2), 1.0, 3.0, 0.5, 2.0, 100.0), (1, 5, dt.date(2024, 1, 4), 2.0, 4.0, 1.0, 3.0, 7.0)]


def test_bars_of_many_short_texts_come_without_a_table_for_each(session):
    texts = session.range(50).selectExpr("id", "concat('2024-01-02,1,2,3,0.5,', id) AS body")
    texts.createOrReplaceTempView("short_texts")
    found = session.sql("SELECT id, b.volume FROM short_texts, LATERAL bars_of(body) b")
    assert {r["id"]: r["volume"] for r in found.collect()} == {i: float(i) for i in range(50)}
    assert "ArrowEvalPythonUDTF" not in found._jdf.queryExecution().executedPlan().toString()
