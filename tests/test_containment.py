"""Containment joins against plain loops, both ways."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tickloom.operators import containment
from tickloom.plans import evidence


@pytest.mark.parametrize("max_sent", [containment.MAX_SENT, 0])
def test_needles_equal_plain_search(spark, max_sent):
    rng = random.Random(4)
    word = lambda low, high: "".join(rng.choice("ab甲乙1 $.") for _ in range(rng.randint(low, high)))
    texts = [(i, word(0, 30), "clash") for i in range(200)] + [(1000, None, "x"), (1001, "", "x"), (1002, "a", "x")]
    needles = [(word(1, 4), rng.random() < 0.5) for _ in range(60)] + [("甲乙", False), ("甲乙", True), ("a", True), ("zz", False), ("", False), (None, True)]
    got = containment.found_in(spark.createDataFrame(texts, "id long, text string, needle string"), spark.createDataFrame(needles, "needle string, whole boolean"), "id", "text", max_sent)
    want = {(i, n, w) for i, text, _ in texts for n, w in needles if n and text and (re.search(f"(^|[^a-zA-Z0-9]){re.escape(n)}([^a-zA-Z0-9]|$)", text) if w else n in text)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("max_sent", [containment.MAX_SENT, 0])
def test_no_needles_and_no_texts(spark, max_sent):
    texts, needles = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([("a", False)], "needle string, whole boolean")
    assert containment.found_in(texts, needles.limit(0), "id", "text", max_sent).count() == 0
    assert containment.found_in(texts.limit(0), needles, "id", "text", max_sent).count() == 0


def test_moves_and_evidence_are_made_once(spark, sf_dir):
    plan = evidence.attributed_moves(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lag(close") == 1 and plan.count("o_orderstatus") and plan.count("Window [lag(") == 1
    texts = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "b"), (4, None)], "id int, s string").select(F.struct("id").alias("about"), "s")
    needles = spark.createDataFrame([("ab", False), ("b", False)], "needle string, whole boolean")
    for most in (0, 100):
        got = sorted((r.id, r.needle) for r in containment.found_in(texts, needles, "about", "s", most).select("about.id", "needle").collect())
        assert got == [(1, "ab"), (1, "b"), (2, "ab"), (2, "b"), (3, "b")]


def test_positions_of_related_funds_move_once(spark, sf_dir):
    assert "l_extendedprice" not in evidence.related_funds(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
