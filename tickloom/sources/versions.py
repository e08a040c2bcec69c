"""Keyed tables in versions: a version is there when its manifest is renamed into place, and only touched ranges are rewritten.

Rows are kept in buckets by a hash of their keys. A manifest names the folder of each bucket; the manifest with the
highest number is the table. A writer writes new folders beside the old ones, and then its manifest, under a number
one above that it started from: if another writer took that number first, the rename fails and nothing has changed.
A writer that dies leaves folders that no manifest names; the version before stays as it was.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import merging

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer has published the next version first."""


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    at, fs = _at(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(m[1]) for m in map(re.compile(r"manifest-(\d+)\.json").fullmatch, names) if m)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version, by default the last; None for a table without one."""
    numbers = _numbers(spark, path) if version is None else [version]
    if not numbers:
        return None
    return json.loads(spark.read.text(f"{path}/manifest-{numbers[-1]}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, content: dict) -> None:
    """Write a manifest beside its place and rename it there; a manifest that is there already stays."""
    place, fs = _at(spark, f"{path}/manifest-{content['version']}.json")
    beside, _ = _at(spark, f"{path}/.manifest-{uuid.uuid4().hex}")
    fs.mkdirs(place.getParent())
    out = fs.create(beside, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(beside), fs.makeQualified(place), options)
    except Exception as error:
        fs.delete(beside, False)
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"version {content['version']} of {path} is there already") from None
        raise


def _bucket(keys: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(BUCKET)


def _folders(spark: SparkSession, path: str, content: dict, only: set[int] | None = None) -> DataFrame:
    schema = json.loads(content["schema"])
    from pyspark.sql.types import StructType

    kind = StructType.fromJson(schema)
    paths = [f"{path}/{folder}" for b, folder in content["folders"].items() if only is None or int(b) in only]
    return spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the last."""
    content = manifest(spark, path, version)
    if content is None:
        raise FileNotFoundError(f"no version of {path}")
    return _folders(spark, path, content)


def upsert(new: DataFrame, path: str, keys: Sequence[str], buckets: int = 64, base: int | None = None, batch: tuple[str, int] | None = None) -> int:
    """Publish a version in which the rows of `new` (a key once) replace those of their keys; gives its number.

    Only buckets that hold keys of `new` are read and written again. `base` is the version that `new` was worked out
    from, by default the last: if it isn't the last any more, Conflict. `batch` (a stream's name and batch number)
    makes a repeated batch do nothing. Columns that the table lacks aren't taken; the first version sets columns and
    buckets.
    """
    spark = new.sparkSession
    numbers = _numbers(spark, path)
    last = numbers[-1] if numbers else 0
    if base is not None and base != last:
        raise Conflict(f"{path} is at version {last}, not {base}")
    content = manifest(spark, path, last) if last else {"version": 0, "schema": new.schema.json(), "buckets": buckets, "keys": list(keys), "folders": {}, "batches": {}}
    if batch and content["batches"].get(batch[0], -1) >= batch[1]:
        return last
    bucket = _bucket(keys, content["buckets"])
    rows = new.withColumn(BUCKET, bucket)
    touched = {r[0] for r in rows.select(BUCKET).distinct().collect()}  # at most as many as buckets
    old = _folders(spark, path, content, touched)
    folder = f"data/{last + 1}-{uuid.uuid4().hex[:12]}"
    if touched:
        merged = merging.last_wins(old, new.select(*old.columns), list(keys)).withColumn(BUCKET, bucket)
        merged.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    folders = content["folders"] | {str(b): f"{folder}/{BUCKET}={b}" for b in sorted(touched)}
    batches = content["batches"] | ({batch[0]: batch[1]} if batch else {})
    _publish(spark, path, content | {"version": last + 1, "folders": folders, "batches": batches})
    return last + 1


def forget(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete manifests before the last `keep` versions, and the folders that none of those left names.

    Folders of a version above the last aren't touched: their writer may be about to publish.
    """
    numbers = _numbers(spark, path)
    stay = numbers[-keep:]
    if not stay:
        return []
    named = {f.split("/")[1] for n in stay for f in manifest(spark, path, n)["folders"].values()}
    for n in numbers[:-keep]:
        at, fs = _at(spark, f"{path}/manifest-{n}.json")
        fs.delete(at, False)
    data, fs = _at(spark, f"{path}/data")
    gone = []
    for status in fs.listStatus(data) if fs.exists(data) else []:
        name = status.getPath().getName()
        if name not in named and int(name.split("-")[0]) <= stay[-1]:
            fs.delete(status.getPath(), True)
            gone.append(name)
    return gone
