"""Mixing sources to target weights by fitting subset sums over exact lengths.

A source's target is met by whole copies of it plus a subset for the rest. The subset is found on counts of
documents by exact length: a proportional part of every length first, then a bounded knapsack over the
lengths for the words still open. Documents are then drawn per length by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm._common import ROW, cut, settled, with_rows

#: Words left to the knapsack, at least; four times the longest document where that is more.
KNAPSACK_WORDS = 1 << 12
#: Hash ranges by which a very common length is drawn without sorting all its documents.
DRAW_RANGES = 4096
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: one row for each source of (source, size) rows.

    Sources in code point order, null last, weigh `weights` in turn. Targets share `share` times all words by
    weight; none exceeds `most` times its source, and what is over goes to the others by weight until none
    is above. That end is found directly: with sources ordered by cap / weight, those up to some place are at
    their caps. All on one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(all_rows) * F.lit(float(share)))
    per = per.withColumn("full_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("w_after", F.sum("w").over(after))
    per = per.withColumn("capped", F.col("cap") * F.col("w_after") <= (F.col("total") - F.col("full_before")) * F.col("w"))
    per = per.withColumn("full", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(all_rows), F.lit(0.0)))
    per = per.withColumn("w_open", F.sum(F.when(~F.col("capped"), F.col("w"))).over(all_rows))
    target = F.when(F.col("capped"), F.col("cap")).otherwise((F.col("total") - F.col("full")) * F.col("w") / F.col("w_open"))
    return per.select("source", "source_size", target.alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near `budget` as found.

    A proportional part of each length, short of the budget by a few documents of the longest length; for the
    rest, to which some of the shortest documents are left, the best reachable sum at most the budget by dynamic
    programming over (length, copies), copies split in powers of two; last, one more document if that ends nearer.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    # what is left for the knapsack: a few times the longest document, and that many words of the shortest ones
    spare = min(budget, max(4 * int(lengths.max()), KNAPSACK_WORDS))
    free, held = counts.tolist(), spare
    for i in np.argsort(lengths, kind="stable").tolist():
        if lengths[i] and held > 0:
            n = min(free[i], -(-held // int(lengths[i])))
            free[i] -= n
            held -= n * int(lengths[i])
    # of the others the part of each length in proportion; what one length leaves goes on to the next
    pool = sum(n * size for n, size in zip(free, lengths.tolist()))
    carried = 0
    for i, (size, n) in enumerate(zip(lengths.tolist(), free)):
        if size and n:
            carried += size * n * (budget - spare)
            take[i] = min(n, carried // (size * pool))
            carried -= int(take[i]) * size * pool
    left = budget - int((lengths * take).sum())
    cap = left
    #: made_by[s]: the item that first reached sum s
    reach = np.zeros(cap + 1, bool)
    reach[0] = True
    made_by = np.full(cap + 1, -1, np.int64)
    items: list[tuple[int, int]] = []
    for i in range(len(lengths)):
        free, size = int(counts[i] - take[i]), int(lengths[i])
        if not 0 < size <= cap:
            continue
        free = min(free, cap // size)
        part = 1
        while free > 0:
            n = min(part, free)
            free -= n
            part *= 2
            step = n * size
            if step > cap:
                break
            new = ~reach[step:] & reach[:-step]
            if new.any():
                at = np.flatnonzero(new) + step
                reach[at] = True
                made_by[at] = len(items)
            items.append((i, n))
        if reach[cap]:
            break
    s = int(np.flatnonzero(reach)[-1])
    while s:
        i, n = items[made_by[s]]
        take[i] += n
        left -= n * int(lengths[i])
        s -= n * int(lengths[i])
    more = np.flatnonzero((take < counts) & (lengths > 0) & (lengths < 2 * left))
    if len(more):
        best = more[np.argmin(np.abs(lengths[more] - left))]
        take[best] += 1
    return take


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size")
    budget = int(round(float(pdf["rest"].iloc[0])))
    pdf["n_take"] = fit_counts(pdf["size"].to_numpy(), pdf["n"].to_numpy(), budget)
    return pdf[["source_key", "size", "n_take"]]


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `carry`, size, source_size, target, copies (times the mix takes the row) for each row of `docs`.

    Null sources are one source, last in order; null or empty texts have size 0 and no copies beyond the
    whole copies of their source. Repeated rows are drawn each on its own. Only doc_id, text, source and `carry` are read.
    The draw depends on doc_id, text, seed and counts alone, so reruns agree but for which of equal rows is taken.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    # rows that share a doc_id, or have none, differ by their texts
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("h")
    rows = cut(docs.select("doc_id", *carry, "source", key.alias("source_key"), word_count(F.col("text")).alias("size"), h))
    lengths = cut(rows.groupBy("source", "source_key", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = source_targets(lengths.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most)
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = cut(targets.select(key.alias("source_key"), "source_size", "target", whole.alias("whole")))
    rest = lengths.select("source_key", "size", "n").join(targets.select("source_key", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest")), "source_key")
    # one row for each distinct length of a source, however many documents have it
    fitted = rest.groupBy("source_key").applyInPandas(_fit, "source_key string, size long, n_take long")
    plan = cut(lengths.select("source_key", "size", "n").join(fitted, ["source_key", "size"]).join(targets, "source_key"))
    taken = _draw(rows, plan, carry)
    copies = (F.col("whole") + F.col("picked").cast("long")).alias("copies")
    return taken.select("doc_id", *carry, "size", "source_size", "target", copies)


def _draw(rows: DataFrame, plan: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """Mark n_take rows of each (source, length): those of smallest seeded hash `h`.

    A length's rows fall into DRAW_RANGES hash ranges; counts by range show which ranges are taken whole and
    which one is cut, and only the rows of that one are ranked.
    """
    rows = rows.withColumn("range", F.shiftrightunsigned(F.col("h"), 64 - DRAW_RANGES.bit_length() + 1))
    keys = ["source_key", "size"]
    ranges = rows.groupBy(*keys, "range").agg(F.count(F.lit(1)).alias("in_range"))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
    least = plan.select(*keys, "n_take", "whole", "source_size", "target")
    ranges = ranges.join(least, keys).withColumn("open", F.col("n_take") - F.col("before"))
    ranges = ranges.select(*keys, "range", "in_range", "open", "whole", "source_size", "target")
    marked = rows.join(ranges, [*keys, "range"])
    out = ["doc_id", *carry, "size", "source_size", "target", "whole"]
    settled = marked.where("open <= 0 or open >= in_range").select(*out, (F.col("open") > 0).alias("picked"))
    rank = F.row_number().over(Window.partitionBy(*keys, "range").orderBy("h", "doc_id", *carry))
    split = marked.where("open > 0 and open < in_range").repartition(*keys, "range").withColumn("rank", rank).select(*out, (F.col("rank") <= F.col("open")).alias("picked"))
    return settled.unionByName(split)


def mix_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: each row of `docs` as often as mix_counts() takes it, columns as they were."""
    rows = with_rows(docs)
    copies = settled(docs.sparkSession, lambda: mix_counts(rows, seed=seed, carry=(ROW,)).where("copies > 0").select(ROW, F.col("copies").cast("int").alias("__copies")))
    # nearly as many numbers as rows: the same plan at every size, where a small table would be sent to every task
    joined = rows.join(copies.hint("merge"), ROW).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return joined.select(*docs.columns)
