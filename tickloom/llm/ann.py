"""Nearest neighbours by low-dimensional stable projections and kd-trees, with a chi-square stopping test.

Unit vectors are projected by independent Gaussian directions: the squared projected distance of two vectors,
over their squared distance, is then chi-square with as many degrees of freedom as directions. The projected
space is cut into cells by a kd-tree over a bounded sample; every vector is dealt to its cell. A query walks
projected neighbours nearest first and verifies them on the original vectors. It may stop once a vector
nearer than its k-th best would, with probability at least `sure`, have been met by now.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm._common import cut, join_counted, map_arrow


@dataclass(frozen=True)
class IndexParams:
    """Cells of about `cell_rows` vectors, and `leaf_rows` at least of the sample, are cut on at most `sample` vectors; every vector is indexed."""

    directions: int = 8
    sure: float = 0.97
    sample: int = 20_000
    cell_rows: int = 8192
    query_rows: int = 4096
    leaf_rows: int = 32
    seed: int = 3


def chi_square_cdf(x: np.ndarray, even: int) -> np.ndarray:
    """Chi-square distribution function for an even number of degrees of freedom."""
    half = np.asarray(x, float) / 2
    return 1 - np.exp(-half) * sum(half**k / factorial(k) for k in range(even // 2))


def kd_cells(points: np.ndarray, leaves: int) -> list[tuple]:
    """Split at medians of the widest side: a list of (side, edge, low, high) nodes, leaves as (None, cell)."""
    nodes: list[tuple] = []
    cells = 0

    def grow(part: np.ndarray, budget: int) -> int:
        nonlocal cells
        at = len(nodes)
        nodes.append(())
        spread = part.max(0) - part.min(0) if len(part) else np.zeros(1)
        side = int(np.argmax(spread))
        if budget < 2 or len(part) < 4 or spread[side] <= 0:
            nodes[at] = (None, cells, 0, 0)
            cells += 1
            return at
        edge = float(np.median(part[:, side]))
        low = part[:, side] <= edge
        if low.all():
            edge = float((np.unique(part[:, side])[-2:]).mean())
            low = part[:, side] <= edge
        left = grow(part[low], budget // 2)
        right = grow(part[~low], budget - budget // 2)
        nodes[at] = (side, edge, left, right)
        return at

    grow(points, leaves)
    return nodes


def cell_of(nodes: list[tuple], points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)

    def walk(at: int, rows: np.ndarray) -> None:
        side, edge, left, right = nodes[at]
        if side is None:
            out[rows] = edge
        elif len(rows):
            low = points[rows, side] <= edge
            walk(left, rows[low])
            walk(right, rows[~low])

    walk(0, np.arange(len(points)))
    return out


def cell_boxes(nodes: list[tuple], m: int) -> tuple[np.ndarray, np.ndarray]:
    n = sum(x[0] is None for x in nodes)
    low, high = np.full((n, m), -np.inf), np.full((n, m), np.inf)

    def walk(at: int, a: np.ndarray, b: np.ndarray) -> None:
        side, edge, left, right = nodes[at]
        if side is None:
            low[edge], high[edge] = a, b
            return
        up, down = b.copy(), a.copy()
        up[side] = down[side] = edge
        walk(left, a, up)
        walk(right, down, b)

    walk(0, np.full(m, -np.inf), np.full(m, np.inf))
    return low, high


class LeafTree:
    """A kd-tree over one block: points in leaf order, and the tight box of each leaf."""

    def __init__(self, points: np.ndarray, leaf_rows: int):
        order, ends = [], []

        def grow(rows: np.ndarray) -> None:
            part = points[rows]
            if len(rows) <= leaf_rows:
                order.append(rows)
                ends.append(len(rows))
                return
            side = int(np.argmax(part.max(0) - part.min(0)))
            half = np.argpartition(part[:, side], len(rows) // 2)
            grow(rows[half[: len(rows) // 2]])
            grow(rows[half[len(rows) // 2 :]])

        grow(np.arange(len(points)))
        self.order = np.concatenate(order)
        self.ends = np.cumsum(ends)
        self.starts = self.ends - np.array(ends)
        held = points[self.order]
        self.low = np.minimum.reduceat(held, self.starts, 0)
        self.high = np.maximum.reduceat(held, self.starts, 0)

    def leaves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves nearest first with their squared projected distances."""
        gap = np.maximum(0, np.maximum(self.low - q, q - self.high))
        d = (gap * gap).sum(1)
        order = np.argsort(d, kind="stable")
        return order, d[order]


def _search_block(data: pd.DataFrame, queries: pd.DataFrame, k: int, p: IndexParams) -> pd.DataFrame:
    """The k nearest classes of the block for each query, nearest first, as far as the stopping test lets it look."""
    out: dict[str, list] = {"query": [], "rep": [], "score": [], "ids": []}
    if len(data) and len(queries):
        data = data.sort_values("rep")
        v = np.stack([np.frombuffer(x, "<f8") for x in data["vec"]])
        norms = np.sqrt((v * v).sum(1))
        tree = LeafTree(np.stack([np.frombuffer(x, "<f8") for x in data["proj"]]), p.leaf_rows)
        v, norms = v[tree.order], norms[tree.order]
        reps, ids = data["rep"].to_numpy()[tree.order], data["ids"].to_numpy()[tree.order]
        bound = float(np.interp(p.sure, chi_square_cdf(_X, p.directions), _X))
        for query, vec, proj, reach in zip(queries["query"], queries["vec"], queries["proj"], queries["reach"]):
            q = np.frombuffer(vec, "<f8")
            size = np.sqrt((q * q).sum())
            order, near = tree.leaves(np.frombuffer(proj, "<f8"))
            score = np.full(0, 0.0)
            rows = np.zeros(0, np.int64)
            best = float(reach)
            at, step = 0, 1
            while at < len(order) and near[at] < bound * best:
                # leaves that the test can't leave out yet, a growing number at a time
                part = order[at : at + step]
                part = part[near[at : at + step] < bound * best]
                at, step = at + step, min(64, step * 2)
                new = np.concatenate([np.arange(a, b) for a, b in zip(tree.starts[part], tree.ends[part])])
                # summed row by row, so that a pair's score is the same in every block
                made = (v[new] * q).sum(1) / (norms[new] * size)
                score, rows = np.concatenate([score, made]), np.concatenate([rows, new])
                keep = np.lexsort((reps[rows], -score))[:k]
                score, rows = score[keep], rows[keep]
                if len(score) == k:
                    best = min(best, max(0.0, 2 - 2 * float(score[-1])) + 1e-12)
            out["query"] += [query] * len(rows)
            out["rep"] += reps[rows].tolist()
            out["score"] += score.tolist()
            out["ids"] += [x.tolist() for x in ids[rows]]
    return pd.DataFrame(out).astype({"query": "int64", "rep": "int64", "score": "float64", "ids": "object"})


_X = np.linspace(0, 200, 20_001)


class ProjectionIndex:
    """All usable vectors of a table, by cell: build once, then search().

    Vectors that are null, zero, or hold null or non-finite components, take no part. Vectors of one length are
    neighbours of each other only: those of other lengths are searched apart, by directions of their own. Equal
    vectors are one row with their `keep` smallest ids, which is all that a search for `keep` - 1 neighbours can
    return.
    """

    def __init__(self, table: DataFrame, keep: int = 6, params: IndexParams | None = None, id_col: str = "vec_id", vec_col: str = "embedding"):
        self.p, self.keep, self.spark = params or IndexParams(), keep, table.sparkSession
        vec = F.col("vec")
        usable = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
        self.usable = usable.where(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0))
        least = Window.partitionBy("vec").orderBy("id")
        first = self.usable.distinct().withColumn("place", F.row_number().over(least)).where(F.col("place") <= keep)
        classes = first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        classes = classes.select(F.col("ids")[0].alias("rep"), "ids", "vec")
        made = cut(self._project(classes))
        n = made.count()
        sample = made.orderBy(F.xxhash64(F.lit(1), F.col("rep"))).limit(self.p.sample).select("proj").collect()
        points = np.stack([np.frombuffer(r["proj"], "<f8") for r in sample]) if sample else np.zeros((0, self.p.directions))
        self.nodes = kd_cells(points, max(1, min(-(-n // self.p.cell_rows), len(points) // 8)))
        cells = cut(self._cells(made))
        # a cell that the sample can't cut finely enough is dealt in blocks of bounded size
        self.sizes = cut(cells.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / self.p.cell_rows).alias("subs")))
        sub = F.pmod(F.xxhash64(F.lit(2), "rep"), F.col("subs"))
        self.data = cells.join(self.sizes, ["dim", "cell"]).withColumn("sub", sub).drop("subs")

    def _project(self, rows: DataFrame) -> DataFrame:
        p = self.p

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = [np.array(v, float) for v in batch.column(2).to_pylist()]
                projected = [b""] * len(vectors)
                dims = np.array([len(v) for v in vectors], np.int64)
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    v = np.stack([vectors[i] for i in at])
                    unit = v / np.abs(v).max(1)[:, None]  # so that squares neither vanish nor overflow
                    unit /= np.sqrt((unit * unit).sum(1))[:, None]
                    for i, x in zip(at.tolist(), unit @ directions_of(dim, p)):
                        projected[i] = x.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(projected, pa.binary()), pa.array(dims)], names=["rep", "ids", "vec", "proj", "dim"])

        return map_arrow(rows, run, "rep long, ids array<long>, vec binary, proj binary, dim long")

    def _cells(self, rows: DataFrame) -> DataFrame:
        nodes, names = self.nodes, rows.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    points = np.stack([np.frombuffer(x, "<f8") for x in batch.column(names.index("proj")).to_pylist()])
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell_of(nodes, points))], names=[*names, "cell"])

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return map_arrow(rows, run, f"{fields}, cell long")

    def _visit(self, queries: DataFrame, k: int, visits: DataFrame) -> DataFrame:
        """Search each (query, cell) of `visits`. A cell's vectors are copied only as often as it has blocks of
        `query_rows` queries; cells that nobody asks aren't read."""
        p = self.p
        asked = visits.join(queries.select("query", "dim", "vec", "proj"), "query").join(self.sizes, ["dim", "cell"])
        parts = asked.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / p.query_rows).alias("parts"))
        each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        part = F.pmod(F.xxhash64(F.lit(3), "query"), F.col("parts"))
        data = self.data.join(parts, ["dim", "cell"]).withColumn("part", each("parts")).drop("parts")
        asked = asked.join(parts, ["dim", "cell"]).withColumn("part", part).withColumn("sub", each("subs")).drop("parts", "subs")
        keys = ["dim", "cell", "sub", "part"]

        def search(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return _search_block(left, right, k, p)

        return data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query long, rep long, score double, ids array<long>")

    def search(self, condition: str, k: int) -> DataFrame:
        """query_id, rank, vec_id, score: the k nearest other vectors of each id for which `condition` (on id) holds."""
        p, nodes = self.p, self.nodes
        asking = cut(self.usable.where(condition).distinct())
        alike = cut(asking.groupBy("vec").agg(F.min("id").alias("query"), F.count(F.lit(1)).alias("n")))
        total = asking.count()
        # a vector that very many queries share is searched once, and its rows don't gather
        own = cut(join_counted(asking, alike, ["vec"], "n", total, salted=("id",)).select("query", "id"))
        heads = self._project(alike.select(F.col("query").alias("rep"), F.array("query").alias("ids"), "vec"))
        heads = cut(self._cells(heads).select(F.col("rep").alias("query"), "dim", "vec", "proj", "cell"))
        first = cut(self._visit(heads, k + 1, heads.select("query", "cell", F.lit(4.0).alias("reach"))))
        kth = first.groupBy("query").agg(F.sort_array(F.collect_list("score"), False).alias("s"))
        reach = F.when(F.size("s") > k, 2.0 - 2.0 * F.try_element_at("s", F.lit(k + 1)) + 1e-9).otherwise(F.lit(4.0))
        asked = heads.join(kth, "query", "left").select("query", "proj", "cell", F.coalesce(F.when(F.col("s").isNotNull(), reach), F.lit(4.0)).alias("reach"))
        low, high = cell_boxes(nodes, p.directions)
        bound = float(np.interp(p.sure, chi_square_cdf(_X, p.directions), _X))

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q, c, r = [], [], []
                for query, proj, cell, far in zip(*(x.to_pylist() for x in batch.columns)):
                    x = np.frombuffer(proj, "<f8")
                    gap = np.maximum(0, np.maximum(low - x, x - high))
                    near = np.flatnonzero((gap * gap).sum(1) < bound * far)
                    near = near[near != cell]
                    q += [query] * len(near)
                    c += near.tolist()
                    r += [far] * len(near)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(r, pa.float64())], names=["query", "cell", "reach"])

        more = map_arrow(asked, others, "query long, cell long, reach double")
        found = first.unionByName(self._visit(heads, k + 1, more))
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "rep")
        found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
        lists = found.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("found")).join(alike.select("query", "n"), "query")
        each = join_counted(own, lists, ["query"], "n", total, salted=("id",)).select(F.col("id").alias("query_id"), F.inline("found"))
        each = each.select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id != vec_id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def directions_of(dim: int, p: IndexParams) -> np.ndarray:
    return np.random.default_rng([p.seed, dim]).standard_normal((dim, p.directions))


def nearest(table: DataFrame, every: int = 50, k: int = 5, params: IndexParams | None = None) -> DataFrame:
    """Search the rows whose vec_id is divisible by `every` against all other rows; largest cosine, ties to the
    smaller vec_id. With fewer candidates all are returned; an empty table gives an empty result. Rows that
    repeat both id and vector count once. Columns other than vec_id and embedding aren't read.
    """
    return ProjectionIndex(table, k + 1, params).search(f"id % {every} = 0", k)
