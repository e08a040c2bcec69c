"""Quality classifier: a sparse ensemble of rules compiled into Spark columns.

Boosted shallow trees are grown on statistics of labelled texts; every path from a root is a conjunctive rule.
A lasso logistic regression weighs the rules, and the rules it keeps become one column expression, so scoring
is a projection over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a fit reads at most, those of smallest seeded hash of doc_id.
MAX_LABELLED = 20_000

STATISTICS = ("log_words", "word_chars", "upper", "symbols", "digits", "distinct_words", "distinct_lines", "line_words")


def text_statistics(text: Column) -> Column:
    """A struct of STATISTICS over the whole text; null counts as empty, and every ratio of nothing is 0."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    lines = F.split(text, "\n", -1)

    def make(s: Column) -> Column:
        n = F.size(s["w"])
        chars = F.greatest(F.char_length(s["t"]), F.lit(1))
        per = F.greatest(n, F.lit(1))
        values = {
            "log_words": F.log1p(n),
            "word_chars": F.char_length(s["t"]) / per,
            "upper": F.regexp_count(s["t"], F.lit(r"\p{Lu}")) / chars,
            "symbols": F.regexp_count(s["t"], F.lit(r"[^\p{L}\p{M}\p{N}\s.,;:?'\"()\-]")) / chars,
            "digits": F.regexp_count(s["t"], F.lit(r"\p{N}")) / chars,
            "distinct_words": F.size(F.array_distinct(s["w"])) / per,
            "distinct_lines": F.size(F.array_distinct(s["l"])) / F.size(s["l"]),
            "line_words": F.log1p(n / F.size(s["l"])),
        }
        return F.struct(*[values[k].cast("double").alias(k) for k in STATISTICS])

    # a lambda over one element evaluates each part once, wherever the optimizer moves the expression
    return F.transform(F.array(F.struct(text.alias("t"), words.alias("w"), lines.alias("l"))), make)[0]


@dataclass
class RuleModel:
    """score = logistic(bias + sum of the weights of the rules that hold)."""

    bias: float = 0.0
    rules: list[tuple[tuple[tuple[int, bool, float], ...], float]] = field(default_factory=list)

    def score(self, text: Column) -> Column:
        def total(s: Column) -> Column:
            z = F.lit(self.bias)
            for conditions, weight in self.rules:
                holds = F.lit(True)
                for i, above, edge in conditions:
                    value = s[STATISTICS[i]]
                    holds = holds & ((value > edge) if above else (value <= edge))
                z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
            return 1.0 / (1.0 + F.exp(-z))

        return F.transform(F.array(text_statistics(text)), total)[0]

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for conditions, weight in self.rules:
            z += weight * _holds(x, conditions)
        return 1 / (1 + np.exp(-z))


def _holds(x: np.ndarray, conditions) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, above, edge in conditions:
        out &= (x[:, i] > edge) if above else (x[:, i] <= edge)
    return out


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Candidate thresholds of each column: midpoints between neighbouring quantiles."""
    out = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def _grow(x, gradient, hessian, edges, depth: int, least: int, path=(), rows=None, rules=None):
    """Split on the threshold of largest gain down to `depth`; returns leaf values by row, and adds every path."""
    rows = np.arange(len(x)) if rows is None else rows
    g, h = gradient[rows], hessian[rows]
    value = np.zeros(len(x))
    best = (1e-9, None, None)
    if depth:
        for i, cuts in enumerate(edges):
            if not len(cuts):
                continue
            place = np.searchsorted(cuts, x[rows, i], side="left")
            n = np.bincount(place, minlength=len(cuts) + 1).cumsum()[:-1]
            gl = np.bincount(place, g, len(cuts) + 1).cumsum()[:-1]
            hl = np.bincount(place, h, len(cuts) + 1).cumsum()[:-1]
            gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
            gain[(n < least) | (len(rows) - n < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], i, float(cuts[k]))
    if best[1] is None:
        value[rows] = -g.sum() / (h.sum() + 1)
        return value
    _, i, edge = best
    low = x[rows, i] <= edge
    for above, part in ((False, rows[low]), (True, rows[~low])):
        step = (*path, (i, above, edge))
        rules.append(step)
        value += _grow(x, gradient, hessian, edges, depth - 1, least, step, part, rules)
    return value


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 2e-3, bins: int = 64, steps: int = 400) -> RuleModel:
    """Grow boosted trees, take their paths as rules, and weigh them by lasso logistic regression (FISTA).

    With no rows the score is 0.5; with labels of one kind, or that no statistic tells apart, only the bias is
    fitted, to the smoothed share.
    """
    if not len(y):
        return RuleModel()
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return RuleModel(bias)
    edges = _edges(x, bins)
    z, rules = np.full(len(y), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        z += 0.3 * _grow(x, p - y, p * (1 - p), edges, depth, max(5, len(y) // 500), rules=rules)
    rules = list(dict.fromkeys(rules))
    if not rules:  # nothing tells the labels apart
        return RuleModel(bias)
    seen: dict[bytes, tuple] = {}
    for rule in sorted(rules, key=len):
        seen.setdefault(_holds(x, rule).tobytes(), rule)
    rules = list(seen.values())
    a = np.stack([_holds(x, r) for r in rules], 1).astype(float)
    weights, b = np.zeros(len(rules)), bias
    ahead, ahead_b, t = weights.copy(), b, 1.0
    rate = 4.0 / (np.linalg.norm(a, 2) ** 2 / len(y) + 1)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(a @ ahead + ahead_b))) - y
        step = ahead - rate * (a.T @ error) / len(y)
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new_b = ahead_b - rate * error.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / t_new * (new - weights), new_b + (t - 1) / t_new * (new_b - b)
        weights, b, t = new, new_b, t_new
    return RuleModel(float(b), [(rule, float(w)) for rule, w in zip(rules, weights) if abs(w) > 1e-6])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> RuleModel:
    """Fit on at most `most` labelled rows outside the held-out fold; only their texts' statistics are gathered.

    Rows without a label or doc_id aren't used.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.select(F.col("doc_id").alias("labelled"), F.col("quality").cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(11), F.col("labelled")), "labelled", "label").limit(most)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled"))
    rows = joined.select("labelled", "label", text_statistics(F.col("text")).alias("s")).select("labelled", "label", "s.*").collect()
    rows.sort(key=tuple)
    x = np.array([[r[k] for k in STATISTICS] for r in rows], float).reshape(-1, len(STATISTICS))
    return fit_rules(x, np.array([r["label"] for r in rows], float))


def score_quality(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of `docs`; null and empty texts are scored as empty.

    Repeated rows are scored each; only doc_id and text are read, and an empty table gives an empty result.
    """
    scored = docs.select("doc_id", model.score(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """`docs` without what the classifier rejects; columns as they were."""
    return docs.where(fit_quality(docs, labels).score(docs["text"]) >= threshold)
