"""Helpers shared by the corpus operators: scratch tables, skew-safe joins, sorted group maps."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: A key is hot when it holds more than one in HOT_SHARE rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Column of with_rows().
ROW = "__tickloom_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The list that takes the scratch folders made now; each thread of the driver has its own.
_open: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("tickloom_scratch", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder. Only a local session may lack one: it gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tickloom-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tickloom-{uuid.uuid4().hex}"
    # a query's result reads its scratch until the caller has used it, so what nobody releases goes when the driver ends
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)  # only a path that is there can be listed
    fs.deleteOnExit(at)
    fs.delete(at, True)
    made = _open.get()
    if made is not None:
        made.append(path)
    return path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders, wherever Spark keeps them."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def path_of(df: DataFrame) -> str:
    """The scratch folder that cut() read `df` from."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


@contextlib.contextmanager
def recorded():
    """A list of the scratch folders made inside."""
    made: list[str] = []
    before = _open.set(made)
    try:
        yield made
    finally:
        _open.reset(before)


@contextlib.contextmanager
def released(spark: SparkSession):
    """Delete, at the end, the scratch folders made inside: what is still wanted has been written elsewhere by then."""
    with recorded() as made:
        try:
            yield
        finally:
            remove(spark, *made)


@contextlib.contextmanager
def cleaned(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame, compression: str = "snappy", path: str | None = None) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it again: the lineage ends there."""
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    with cleaned(spark):
        df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, written; the scratch folders that it needed on its way are deleted."""
    path = scratch_dir(spark)
    with released(spark):
        return cut(make(), path=path)


def with_rows(df: DataFrame) -> DataFrame:
    """`df` with a number of its own for each row in ROW, written so that every reader sees the same numbers."""
    return cut(df.withColumn(ROW, F.monotonically_increasing_id()), "zstd")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def hash128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes: compared together they stand for the value."""
    return [F.xxhash64(F.lit(17), *cols), F.xxhash64(F.lit(4711), *cols)]


def join_counted(left: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, salted: tuple[str, ...] = ()) -> DataFrame:
    """Left-join rows to one row per key when a few keys may hold most rows.

    `groups` has one row per key and its number of rows in `count`; `total` is the sum. Keys with over
    total/HOT_SHARE rows number at most HOT_SHARE, so they are broadcast and their rows never shuffle; the
    others are joined by a shuffle in which no key holds more than that share. `salted` names columns of `left`
    that tell the rows of a hot key apart, where all of them are much to hash.
    """
    least = max(total // HOT_SHARE, 64)
    rest = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(count) > least).select(*keys, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_hot_{c}") for c in rest])
    marked = left.join(F.broadcast(hot), keys, "left")
    # rows that are answered go anywhere: their salt matches no group
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*(salted or left.columns)), F.lit(1 << 20)) + 1).otherwise(F.lit(0))
    cold = groups.where(F.col(count) <= least).withColumn("_salt", F.lit(0).cast("long"))
    joined = marked.withColumn("_salt", salt.cast("long")).join(cold, [*keys, "_salt"], "left")
    return joined.select(*left.columns, *[F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in rest])


def map_sorted_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable, schema: str) -> DataFrame:
    """Apply fn(dict of column lists) -> list of tuples to each group of `keys`, one group in memory at a time.

    Rows are hashed on the keys and sorted in their partition, so a partition is streamed whatever its size;
    callers bound the size of a group. Cheaper than one pandas frame for each of very many small groups.
    """
    names = df.columns
    n_keys = len(keys)
    out_schema = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow_schema = to_arrow_schema(out_schema)
        held: list = []
        held_key = None
        out: list = []

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow_schema)], schema=arrow_schema)

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
            for row in zip(*cols):
                key = row[:n_keys]
                if key != held_key:
                    if held:
                        out.extend(fn(held_key, held))
                        if len(out) >= 5000:
                            yield flush(out)
                            out = []
                    held, held_key = [], key
                held.append(row[n_keys:])
        if held:
            out.extend(fn(held_key, held))
        if out:
            yield flush(out)

    rest = [c for c in names if c not in keys]
    names = keys + rest
    dealt = df.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order)
    return map_arrow(dealt, run, schema)


#: Bytes of an Arrow batch between Spark and Python, and of the texts that a function takes from it at once.
BATCH_BYTES = 16 << 20


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(fn) with batches bounded by bytes on both ways, whatever a row's size.

    The bound is one number for every frame, so frames that are built but not yet run keep theirs.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(lambda batches: fn(sliced(batches)), schema)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about BATCH_BYTES at most; a longer row stands alone."""
    for batch in batches:
        n = max(1, -(-batch.nbytes // BATCH_BYTES))
        if n == 1 or len(batch) < 2:
            yield batch
            continue
        step = max(1, len(batch) // n)
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
