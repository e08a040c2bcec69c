"""Near-duplicate detection with SetSketch registers.

Every document becomes its set of word shingles, and the set a row of registers: register i is the largest
1 - log_b(h_i(d)) over the elements d, floored and truncated, where the h_i are exponential variates; so it
is the truncated exponentially spaced minimum, and sketches merge by the larger register. Bands of registers
put similar sets into common buckets. Inside a bucket the joint likelihood of two sketches decides which pairs
can reach the threshold; those pairs form blocks, and within blocks full sets are compared. Equal sets are one
row throughout, and buckets and blocks of any size are worked through in chunks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm._common import ROW, cut, join_counted, map_arrow, map_sorted_groups, mix64, settled, with_rows
from tickloom.llm.components import connected_components


@dataclass(frozen=True)
class SketchParams:
    """`bands` bands of `rows` registers find a pair of similarity s with probability 1 - (1 - s**rows)**bands.

    At 0.8 the defaults miss 5 pairs in a million, at 0.85 2 in a billion, and sets of similarity 0.06 meet in a band
    once in 20 million. They are the same for a corpus of any size.
    """

    width: int = 5
    threshold: tuple[int, int] = (80, 100)
    rows: int = 6
    bands: int = 40
    base: float = 1.001
    top: int = 65_534
    #: Log-likelihood by which the threshold must be worse than the estimate for a pair to be left out.
    margin: float = 16.0
    #: Sketches, and set elements, that a task holds of one bucket or block.
    chunk_rows: int = 2048
    chunk_elements: int = 4_000_000

    @property
    def size(self) -> int:
        return self.rows * self.bands


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than `width` make one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - width + 1)
    h = np.full(n, min(width, len(w)), np.uint64)
    for i in range(min(width, len(w))):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
    return np.unique(h)


def _multipliers(m: int) -> np.ndarray:
    return mix64(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def set_sketch(hashes: np.ndarray, p: SketchParams) -> np.ndarray:
    """Registers of a non-empty set; the sketch of a union is the element-wise maximum."""
    least = np.full(p.size, 0xFFFFFFFF, np.uint32)
    mult = _multipliers(p.size)
    for i in range(0, len(hashes), 4096):
        part = (hashes[i : i + 4096, None] * mult[None, :]) >> np.uint64(32)
        least = np.minimum(least, part.min(0).astype(np.uint32))
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / 20.0
    return np.clip(np.floor(1.0 - np.log(x) / np.log(p.base)), 0, p.top).astype(np.uint16)


def log_likelihood(above, below, same, n_u, n_v, similarity, base: float):
    """Joint log-likelihood of a similarity, given how many registers are larger, smaller and equal."""
    u = n_u / (n_u + n_v)
    v = n_v / (n_u + n_v)

    def larger(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base), 1e-12, 1 - 1e-12)

    # J of the union's mass: with j the similarity, the shares outside are u - v j and v - u j
    up, down = larger(u - v * similarity), larger(v - u * similarity)
    return above * np.log(up) + below * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))


_GRID = np.linspace(0.0, 1.0, 101)


class ReachTest:
    """Whether two sketches can belong to sets whose similarity is the threshold or more.

    They can unless the joint likelihood at the threshold is worse than at the best similarity by the margin.
    The answer depends on four counts only, so it is kept: among many near copies the same ones come again.
    """

    def __init__(self, p: SketchParams, most: int = 500_000):
        self.p, self.most = p, most
        self.known: dict[tuple[int, int], bool] = {}

    def __call__(self, one: np.ndarray, n_one: int, many: np.ndarray, n_many: np.ndarray) -> np.ndarray:
        p = self.p
        t = p.threshold[0] / p.threshold[1]
        above = (many < one[None, :]).sum(1)
        below = (many > one[None, :]).sum(1)
        possible = np.minimum(n_one / n_many, n_many / n_one) >= t - 1e-9
        unsure = np.flatnonzero(possible & (p.size - above - below < t * p.size))
        if len(unsure):
            keys, back = np.unique((n_many[unsure].astype(np.int64) << 32) | (above[unsure] << 16) | below[unsure], return_inverse=True)
            new = np.array([k for k in keys.tolist() if (n_one, k) not in self.known], np.int64)
            if len(new):
                if len(self.known) > self.most:
                    self.known.clear()
                    new = keys
                a, b, m = (new >> 16 & 0xFFFF)[:, None], (new & 0xFFFF)[:, None], (new >> 32)[:, None].astype(float)
                cap = np.minimum(n_one / m, m / n_one)
                best = log_likelihood(a, b, p.size - a - b, float(n_one), m, np.minimum(_GRID[None, :], cap), p.base).max(1)
                at = log_likelihood(a, b, p.size - a - b, float(n_one), m, np.full_like(cap, t), p.base)[:, 0]
                self.known.update(zip(((n_one, k) for k in new.tolist()), (best - at <= p.margin).tolist()))
            possible[unsure] = np.array([self.known[n_one, k] for k in keys.tolist()], bool)[back]
        return possible


def sketch_documents(docs: DataFrame, p: SketchParams) -> DataFrame:
    """doc_id, n_shingles, set_key (hash of the whole set), sketch (registers, little-endian 16 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sketches = [], [], []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(text, p.width)
                n.append(len(h))
                keys.append(hashlib.md5(h.tobytes()).digest() if len(h) else None)
                sketches.append(set_sketch(h, p).astype("<u2").tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sketch"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, set_key binary, sketch binary")


def _band_rows(reps: DataFrame, p: SketchParams) -> DataFrame:
    """band, rep for each band of each sketch; band is a hash of its number and registers."""
    width = 2 * p.rows
    band = F.transform(F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * width + 1, F.lit(width))))
    return reps.select("rep", F.explode(band).alias("band"))


def _span(labels: np.ndarray, linked: Callable, residents: np.ndarray, visitors: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the labels of rows linked across residents and visitors; rows of one label aren't compared.

    With `linked(i, js)` the rows outside the component of i are compared with it, so a group that hangs
    together costs about one comparison for each row.
    """
    label = labels.copy()
    edges = []
    both = np.array_equal(residents, visitors)
    for i in visitors.tolist():
        js = residents[label[residents] != label[i]]
        if both:
            js = js[js > i]
        if not len(js):
            if len(np.unique(label)) == 1:
                break
            continue
        for j in js[linked(i, js)].tolist():
            if label[j] != label[i]:
                edges.append((i, j))
                label[label == label[j]] = label[i]
    return edges


def _spanning(rows: DataFrame, group: str, payload: list[str], linker: Callable, p: SketchParams) -> DataFrame:
    """src, dst: edges that join, within each group of `rows` (group, n_chunks, rep, payload), what `linker` links.

    Rows know the number of chunks of their group, so that no group ever gathers whole: each chunk is a group of its
    own, and a group of several is worked through chunk by chunk first.
    Where its rows aren't one component by then, the rows outside its largest component meet all others, in
    blocks of bounded size: so near copies in any number never meet in pairs of chunks, and no link is lost.
    """

    def within(key, held) -> list[tuple]:
        if len(held) < 2:
            return []
        all_rows = np.arange(len(held))
        return [(held[i][0], held[j][0]) for i, j in _span(all_rows, linker([r[1:] for r in held]), all_rows, all_rows)]

    def across(key, held) -> list[tuple]:
        side = np.array([r[1] for r in held])
        residents, visitors = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(residents) or not len(visitors):
            return []
        _, labels = np.unique(np.array([r[2] for r in held], np.int64), return_inverse=True)
        return [(held[i][0], held[j][0]) for i, j in _span(labels, linker([r[3:] for r in held]), residents, visitors)]

    chunk = F.pmod(F.xxhash64(F.lit(5), "rep"), F.col("n_chunks")).cast("int")
    first = cut(map_sorted_groups(rows.select(group, chunk.alias("chunk"), "rep", *payload), [group, "chunk"], ["rep"], within, "src long, dst long").distinct())
    large = rows.where("n_chunks > 1")
    if large.isEmpty():
        return first
    labels = connected_components(first)
    held = large.join(labels, F.col("rep") == F.col("node"), "left").withColumn("label", F.coalesce("component", "rep")).select(group, "n_chunks", "label", "rep", *payload)
    held = cut(held)
    sizes = held.groupBy(group, "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy(group).agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("n_main")).where("n > n_main")
    sizes = cut(sizes.select(group, "n", "main", F.ceil((F.col("n") - F.col("n_main")) / p.chunk_rows).alias("n_apart")))
    apart = join_counted(held, sizes, [group], "n", held.count(), salted=("rep",)).where("main IS NOT NULL")
    each = lambda c: F.explode(F.sequence(F.lit(0), (F.col(c) - 1).cast("int")))
    residents = apart.select(group, chunk.alias("lo"), each("n_apart").alias("hi"), "rep", F.lit(0).alias("side"), "label", *payload)
    visitors = apart.where("label != main").select(group, each("n_chunks").alias("lo"), F.pmod(F.xxhash64(F.lit(6), "rep"), F.col("n_apart")).cast("int").alias("hi"), "rep", F.lit(1).alias("side"), "label", *payload)
    met = map_sorted_groups(residents.unionByName(visitors), [group, "lo", "hi"], ["rep", "side"], across, "src long, dst long").distinct()
    return first.unionByName(cut(met))


def _likely(p: SketchParams) -> Callable:
    """Links sketches whose sets may reach the threshold."""
    reach = ReachTest(p)

    def linker(rows) -> Callable:
        n = np.array([r[0] for r in rows], np.int64)
        sk = np.frombuffer(b"".join(r[1] for r in rows), "<u2").reshape(len(rows), p.size)
        return lambda i, js: reach(sk[i], int(n[i]), sk[js], n[js])

    return linker


def _exact(p: SketchParams) -> Callable:
    """Links full sets that reach the threshold."""
    num, den = p.threshold

    def linker(rows) -> Callable:
        sets = [np.frombuffer(r[0], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        seen = np.zeros(int(flat.max()) + 1, bool)

        def linked(i: int, js: np.ndarray) -> np.ndarray:
            own = flat[starts[i] : ends[i]]
            seen[own] = True
            if len(js) * 4 > len(sets):
                common = np.add.reduceat(seen[flat], starts, dtype=np.int64)[js]
            else:
                common = np.array([np.count_nonzero(seen[flat[starts[j] : ends[j]]]) for j in js])
            seen[own] = False
            return den * common >= num * (sizes[i] + sizes[js] - common)

        return linked

    return linker


def near_duplicates(docs: DataFrame, params: SketchParams | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of `docs`.

    Words are runs of anything but ASCII white space, A-Z in lower case. Documents are linked where the
    similarity of their shingle sets reaches the threshold; component_id is the smallest doc_id reachable.
    Texts without words (null, empty, white space) are linked with nothing. Rows that repeat a doc_id with
    another text are one node: their links combine. A null doc_id links nothing. Columns other than doc_id
    and text aren't read; empty tables give empty results.
    """
    p = params or SketchParams()
    rows = cut(sketch_documents(docs, p))
    full = rows.where("set_key is not null and doc_id is not null")
    # equal sets are one row: the smallest doc_id speaks for them; their sketches are equal too, so any of them will do
    reps = cut(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_docs"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    bands = cut(_band_rows(reps, p))
    buckets = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("members")).where("n > 1")
    # bands that gather the same rows are worked through once
    buckets = cut(buckets.groupBy("n", "members").agg(F.min("band").alias("band")).select("band", "n", F.ceil(F.col("n") / p.chunk_rows).alias("n_chunks")))
    inside = join_counted(bands, buckets, ["band"], "n", bands.count(), salted=("rep",)).where("n_chunks IS NOT NULL").drop("n")
    likely = _spanning(inside.join(reps.select("rep", "n_shingles", "sketch"), "rep"), "band", ["n_shingles", "sketch"], _likely(p), p)
    blocks = cut(connected_components(likely).select(F.col("node").alias("rep"), F.col("component").alias("block")))
    sizes = reps.select("rep", "n_shingles").join(blocks, "rep").groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("elements"))
    chunks = cut(sizes.select("block", "n", F.greatest(F.ceil(F.col("n") / p.chunk_rows), F.ceil(F.col("elements") / p.chunk_elements)).alias("n_chunks")))
    sets = _sets_of(docs, reps.select("rep", "set_key").join(blocks.select("rep"), "rep"), p)
    dealt = join_counted(blocks, chunks, ["block"], "n", blocks.count(), salted=("rep",)).drop("n")
    links = _spanning(dealt.join(sets, "rep"), "block", ["elements"], _exact(p), p)
    found = connected_components(links).select(F.col("node").alias("rep"), "component")
    groups = reps.select("set_key", "rep", "n_docs").join(found, "rep", "left").select("set_key", "n_docs", F.coalesce("component", "rep").alias("component"))
    joined = join_counted(rows.select("doc_id", "n_shingles", "set_key"), groups, ["set_key"], "n_docs", full.count())
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _sets_of(docs: DataFrame, wanted: DataFrame, p: SketchParams) -> DataFrame:
    """rep, elements: full sets, made again from the whole texts of the rows that stand in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t, p.width).tobytes() for t in batch.column(1).to_pylist()]
            keys = [hashlib.md5(s).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["rep", "key", "elements"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted.select("rep"), "rep", "left_semi")
    made = map_arrow(texts, run, "rep long, key binary, elements binary")
    # rows may repeat a doc_id: each set once
    return made.join(wanted.select("rep", F.col("set_key").alias("key")), ["rep", "key"]).dropDuplicates(["rep", "key"]).select("rep", "elements")


def drop_near_copies(docs: DataFrame, params: SketchParams | None = None) -> DataFrame:
    """`docs` with one document, the smallest doc_id, of each component."""
    gone = cut(near_duplicates(docs, params).where("not kept").select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def keep_one(docs: DataFrame, params: SketchParams | None = None) -> DataFrame:
    """`docs` with one row of each component, where every row is a node of its own whatever its doc_id.

    It has the smallest doc_id, null being the largest; among rows of that doc_id a hash of the text decides.
    """
    rows = with_rows(docs)

    def lost() -> DataFrame:
        found = near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), params).select(F.col("doc_id").alias(ROW), "component_id")
        order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), ROW)
        found = cut(found.join(rows.select(ROW, order.alias("order")), ROW))
        groups = found.groupBy("component_id").agg(F.min("order")[ROW].alias("keep_row"), F.count(F.lit(1)).alias("n")).where("n > 1")
        joined = join_counted(found.select(ROW, "component_id"), cut(groups), ["component_id"], "n", found.count())
        return joined.where(F.col("keep_row") != F.col(ROW)).select(ROW)

    # written first: while the lost rows are few, Spark sends their numbers to the texts
    return rows.join(settled(docs.sparkSession, lost), ROW, "left_anti").select(*docs.columns)
