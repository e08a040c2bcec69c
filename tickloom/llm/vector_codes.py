"""Vector code compression: integer product codes whose codebooks come from rounds of exact integer means.

Vectors become integers (components times SCALE, rounded down) and are written once as columnar blocks: one NumPy
array for each component. Every round is one RDD treeAggregate over the blocks. A task accumulates the squared
distances of a part to all its entries dimension by dimension, takes the nearest, and adds components and counts
into int64 tensors; the tensors (entries x components, whatever the number of rows) merge through a reduction tree.
Everything is integer arithmetic, so the result doesn't depend on how rows are dealt. Where integers could pass 64
bits, Python's own are used instead.

Nulls and odd rows: a vector that is null, or holds a null or non-finite component, takes no part. Vectors of
another length are coded apart, with codebooks of their own, as if in a table of their own. A length that PARTS
doesn't divide gives its first parts one component more, so a length under PARTS leaves the last parts empty
(index 0, distance 0). Null vec_ids come after all others when the first entries are chosen, repeated ones are
ordered by their vectors, and every row is answered, repeated ones too. Fewer than ENTRIES rows make as many
entries as there are rows. An error beyond a 64-bit integer is null. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm._common import cut, join_counted, map_arrow

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
BLOCK_ROWS = 4096


def _integers(components: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as int64, or as Python integers where one may not fit."""
    scaled = np.floor(components.astype(np.float64) * SCALE)
    if scaled.size == 0 or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    # doubles this large are whole, and SCALE is a power of two: the product can only overflow to infinity
    flat = [int(s) if math.isfinite(s) else int(x) * SCALE for s, x in zip(scaled.ravel().tolist(), components.ravel().tolist())]
    whole = np.empty(len(flat), object)
    whole[:] = flat
    return whole.reshape(scaled.shape)


def _cuts(length: int) -> list[slice]:
    """Consecutive parts as equal as can be."""
    sizes = [length // PARTS + (p < length % PARTS) for p in range(PARTS)]
    ends = np.cumsum(sizes).tolist()
    return [slice(e - s, e) for e, s in zip(ends, sizes)]


def _nearest(columns: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry for each part (parts x rows), and the squared distances summed over the parts."""
    length, rows = columns.shape
    most = max([1, *(abs(int(x)) for a in (columns, books) if a.size for x in (a.min(), a.max()))])
    exact = np.int64 if length * (2 * most) ** 2 < 2**62 else object
    columns, books = columns.astype(exact), books.astype(exact)
    index = np.zeros((PARTS, rows), np.int64)
    error = np.zeros(rows, exact)
    for p, part in enumerate(_cuts(length)):
        if part.start == part.stop:
            continue
        distance = np.zeros((len(books), rows), exact)
        for j in range(part.start, part.stop):
            gap = columns[j][None, :] - books[:, j][:, None]
            distance += gap * gap
        index[p] = np.argmin(distance, axis=0)  # the lowest of equals
        error += distance[index[p], np.arange(rows)]
    return index, error


def _added(totals: dict, columns: np.ndarray, books: np.ndarray) -> dict:
    """Sums of components and counts by (entry, component) of one block, added to the totals of its length."""
    length, rows = columns.shape
    index, _ = _nearest(columns, books)
    most = max([0, *(abs(int(x)) for x in (columns.min(), columns.max()))]) if columns.size else 0
    sums, counts = totals.get(length) or (np.zeros(books.shape, np.int64), np.zeros((PARTS, len(books)), np.int64))
    if most * rows >= 2**40 and sums.dtype != object:  # 2**22 blocks more could pass 64 bits
        sums = sums.astype(object)
    columns = columns.astype(sums.dtype)
    for p, part in enumerate(_cuts(length)):
        np.add.at(counts[p], index[p], 1)
        for j in range(part.start, part.stop):
            np.add.at(sums[:, j], index[p], columns[j])
    return totals | {length: (sums, counts)}


def _merged(left: dict, right: dict) -> dict:
    out = dict(left)
    for length, (sums, counts) in right.items():
        if length in out:
            mine, n = out[length]
            if object in (mine.dtype, sums.dtype) or max(np.abs(mine).max(initial=0), np.abs(sums).max(initial=0)) >= 2**61:
                mine, sums = mine.astype(object), sums.astype(object)
            out[length] = (mine + sums, n + counts)
        else:
            out[length] = (sums, counts)
    return out


def _moved(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each entry's parts at the floor of their mean; parts that nobody took stay."""
    out = books.astype(sums.dtype) if sums.dtype == object else books.copy()
    for p, part in enumerate(_cuts(books.shape[1])):
        used = np.flatnonzero(counts[p])
        out[used, part] = sums[used, part] // counts[p][used][:, None]
    return out


def _blocks(vectors: DataFrame) -> DataFrame:
    """Rows of vec_ids, labels and components (by component, then row) of up to BLOCK_ROWS vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(length: int) -> pa.RecordBatch:
            ids, labels, rows = zip(*held.pop(length))
            columns = np.array(rows, np.float64).reshape(len(rows), length).T
            return pa.RecordBatch.from_arrays([pa.array([length], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())), pa.array([np.ascontiguousarray(columns).tobytes()], pa.binary())], names=["length", "ids", "labels", "components"])

        for batch in batches:
            vector = batch.column(2)
            flat, ends = vector.flatten().to_numpy(zero_copy_only=False), np.cumsum(vector.value_lengths().to_numpy(zero_copy_only=False))
            for at, (i, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                row = flat[ends[at - 1] if at else 0 : ends[at]]
                mine = held.setdefault(len(row), [])
                mine.append((i, label, row))
                if len(mine) * max(len(row), 64) >= BLOCK_ROWS * 64:
                    yield flush(len(row))
        for length in list(held):
            yield flush(length)

    return map_arrow(vectors, run, "length long, ids array<long>, labels array<string>, components binary")


def _columns(length: int, components: bytes) -> np.ndarray:
    return _integers(np.frombuffer(components, np.float64).reshape(length, -1) if length else np.zeros((0, 0)))


def _first_entries(vectors: DataFrame) -> dict[int, np.ndarray]:
    """The ENTRIES smallest vec_ids' vectors of each length, which is all that the driver ever holds of the rows."""
    order = Window.partitionBy(F.size("vector")).orderBy(F.col("vec_id").asc_nulls_last(), "vector")
    first = vectors.withColumn("place", F.row_number().over(order)).where(F.col("place") <= ENTRIES).orderBy("place")
    found: dict[int, list] = {}
    for row in first.select("vector").collect():
        found.setdefault(len(row[0]), []).append(row[0])
    return {length: _integers(np.array(rows, np.float64).reshape(len(rows), length)) for length, rows in found.items()}


def _digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    parts = (books[e, part] for part in _cuts(books.shape[1]) for e in range(len(books)))
    return hashlib.sha256(",".join(str(int(x)) for part in parts for x in part).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether a vector is there with finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def code_vectors(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row of vec_id, embedding and label.

    Other columns aren't read. The driver keeps ENTRIES vectors for each length of vectors that occurs.
    """
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    books = _first_entries(vectors)
    blocks = cut(_blocks(vectors), "zstd")
    columnar = blocks.select("length", "components").rdd
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(books)
        totals = columnar.treeAggregate({}, lambda t, row, held=held: _added(t, _columns(row[0], row[1]), held.value[row[0]]) if row[0] else t, _merged)
        books |= {length: _moved(books[length], *totals[length]) for length in totals}
    held = spark.sparkContext.broadcast((books, {length: _digest(b) for length, b in books.items()}))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, digests = held.value
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"])
                index, error = _nearest(_columns(row["length"], row["components"]), books[row["length"]]) if row["length"] else (np.zeros((PARTS, n), int), np.zeros(n, np.int64))
                codes = [bytes(c).hex() for c in index.T.astype(np.uint8)]
                exact = pa.array([str(e) for e in error.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array(codes, pa.string()), exact, pa.array([digests[row["length"]]] * n, pa.string())], names=["vec_id", "label", "code", "exact", "codebooks_sha256"])

    found = cut(map_arrow(blocks, coded, "vec_id long, label string, code string, exact string, codebooks_sha256 string"))
    error = F.expr("try_cast(exact AS decimal(38, 0))")
    keyed = found.select("vec_id", "code", "codebooks_sha256", error.alias("exact"), F.coalesce("label", F.lit("")).alias("label"), F.col("label").isNull().alias("unlabelled"))
    sums = keyed.groupBy("label", "unlabelled").agg(F.count("*").alias("n"), F.try_sum("exact").alias("label_exact"), F.count("exact").alias("known"))
    total = keyed.count()
    summed = join_counted(keyed, sums, ["label", "unlabelled"], "n", total, ("vec_id", "code"))
    whole = F.when(F.col("known") == F.col("n"), F.expr("try_cast(label_exact AS bigint)"))
    return summed.select("vec_id", "code", F.expr("try_cast(exact AS bigint)").alias("error"), whole.alias("label_error"), "codebooks_sha256")
