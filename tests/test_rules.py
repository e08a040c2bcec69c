import random
import re

import pytest
from pyspark.sql import functions as F

from tickloom.functions import rules
from tickloom.operators import announcements as a
from tickloom.operators import newsfeed as n

PATTERNS = [n.FED, n.PERMIT, n.HARD, n.DEMAND, n.NOISE, a.NO_SELL, *(p for p, _ in n.CATEGORIES), *(p for p, _, _ in a.SIGNALS), *(p for p, _ in a.NEUTRAL), *(p for p, _ in a.KINDS)]
ODD = ["ab?c", "a|b.*c", "(x|y)z|w", "a.b", r"a\.b|c", "[ab]c|d", "x*", "a{2}b", "", "ab(c|d)?e", "a+b", "(a(b|c))+d|^e", "(?i)Ab", "ab$"]


@pytest.mark.parametrize("odd", [True, False])
def test_found_equals_the_pattern(spark, odd):
    """Words that are looked for first never change what a pattern finds."""
    rng = random.Random(4)
    patterns = ODD if odd else PATTERNS
    pieces = list("abcdexyzw.") + ["AB", ""] if odd else sorted({w for p in patterns for w in re.split(r"[|()\[\].*?^$\\]+", p) if w})
    texts = [("".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))),) for _ in range(400)] + [(None,)]
    df = spark.createDataFrame(texts, "x string")
    rows = df.select("x", *[c.alias(f"{k}{i}") for i, p in enumerate(patterns) for k, c in (("f", rules.found(F.col("x"), p)), ("r", F.col("x").rlike(p)))]).collect()
    for i, p in enumerate(patterns):
        wrong = [r["x"] for r in rows if r[f"f{i}"] != r[f"r{i}"]]
        assert not wrong, (p, wrong[:3])


def test_event_keys(spark):
    titles = ["OpenAI launches GPT-5.1", "launches GPT-5.1", "Shortage of HBM", "Samsung to raise prices of DRAM", "China is approved to buy H200", "nothing", "", None, "Anthropic launch of robot"]
    rows = spark.createDataFrame([(x,) for x in titles], "t string").select(n.event_key(F.col("t")).alias("e"))
    assert [r["e"] for r in rows.collect()] == ["event:openai:model-launch:gpt-5.1", None, "event:hbm:supply-tight:hbm", "event:samsung:price-up:dram", "event:china-ai-firms:purchase-approval:nvidia-h200", None, None, None, None]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") < 60
