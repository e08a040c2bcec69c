"""Incremental, reversible line de-duplication: exact reference tables behind sharded cuckoo filters.

References are one row for each (line key, document), so a document can be taken out again and counts stay
exact. A cuckoo filter for each shard of the key space holds the keys repeated enough to lose lines; inserting
or deleting documents inserts or deletes the keys that cross that limit. Documents are cleaned by asking the
filters first; only lines they let through are looked up in the exact counts, so a false positive costs time
and never a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from tickloom.llm._common import ascii_lower, cleaned, cut, hash128, join_counted, mix64, scratch_dir

WHITE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
#: Keys a shard's filter is sized for; the number of shards grows with the keys.
SHARD_KEYS = 250_000
#: Documents for each folder of references, and layers of counts before they are folded into one.
PART_DOCS, MAX_LAYERS = 200_000, 16


class CuckooFilter:
    """16-bit fingerprints in buckets of four; supports insert, contains and delete.

    A key has two buckets, each reached from the other by xor with a hash of the fingerprint. An insert that
    finds both full moves entries on; a key without a place after 500 moves is kept as it is, in `spill`.
    Only keys that were inserted may be deleted.
    """

    SLOTS = 4

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        if table is None:
            buckets = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / self.SLOTS / 0.85))))
            table = np.zeros((buckets, self.SLOTS), np.uint16)
        self.table = table
        self.spill: set[int] = set()

    @staticmethod
    def _prints(keys: np.ndarray) -> np.ndarray:
        return ((mix64(keys ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)

    def _buckets(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        first = mix64(keys) & mask
        return first, (first ^ mix64(prints.astype(np.uint64))) & mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints = self._prints(keys)
        a, b = self._buckets(keys, prints)
        found = (self.table[a] == prints[:, None]).any(1) | (self.table[b] == prints[:, None]).any(1)
        if self.spill:
            found |= np.isin(keys, np.fromiter(self.spill, np.uint64, len(self.spill)))
        return found

    def insert(self, keys: np.ndarray, moves: int = 500) -> None:
        prints = self._prints(keys)
        buckets = np.stack(self._buckets(keys, prints))
        left = np.arange(len(keys))
        for side in (0, 1):  # whole batches into free slots, the keys of one bucket in turn
            while len(left):
                at = buckets[side, left].astype(np.int64)
                _, first = np.unique(at, return_index=True)
                free = self.table[at[first]] == 0
                ok = free.any(1)
                if not ok.any():
                    break
                placed = first[ok]
                self.table[at[placed], free[ok].argmax(1)] = prints[left[placed]]
                left = np.delete(left, placed)
        mask = len(self.table) - 1
        for turn, i in enumerate(left.tolist()):  # both buckets are full: move others on
            fp, at, path = int(prints[i]), int(buckets[0, i]), []
            for step in range(moves):
                slot = (turn + step) % self.SLOTS
                path.append((at, slot))
                fp, self.table[at, slot] = int(self.table[at, slot]), fp
                at ^= int(mix64(np.array([fp], np.uint64))[0]) & mask
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = fp
                    break
            else:  # undo the moves and keep this key exactly
                for at, slot in reversed(path):
                    fp, self.table[at, slot] = int(self.table[at, slot]), fp
                self.spill.add(int(keys[i]))

    def delete(self, keys: np.ndarray) -> None:
        if self.spill:
            spilt = np.isin(keys, np.fromiter(self.spill, np.uint64, len(self.spill)))
            self.spill.difference_update(keys[spilt].tolist())
            keys = keys[~spilt]
        prints = self._prints(keys)
        left = np.arange(len(keys))
        for at in self._buckets(keys, prints):
            at, todo = at.astype(np.int64), left
            while len(todo):
                hit = self.table[at[todo]] == prints[todo, None]
                todo, slot = todo[hit.any(1)], hit[hit.any(1)].argmax(1)
                flat, first = np.unique(at[todo] * self.SLOTS + slot, return_index=True)
                self.table.reshape(-1)[flat] = 0
                left = np.setdiff1d(left, todo[first])
                todo = np.delete(todo, first)  # the slot was another key's with the same print

    def to_bytes(self) -> bytes:
        extra = np.fromiter(self.spill, np.uint64, len(self.spill))
        return np.array([len(self.table), len(extra)], np.uint64).tobytes() + self.table.tobytes() + extra.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        n, extra = np.frombuffer(data, np.uint64, 2).tolist()
        end = 16 + n * cls.SLOTS * 2
        out = cls(0, np.frombuffer(data, np.uint16, n * cls.SLOTS, 16).reshape(n, cls.SLOTS).copy())
        out.spill = set(np.frombuffer(data, np.uint64, extra, end).tolist())
        return out


def line_key(line: Column) -> Column:
    """The line without white space at either end, A-Z in lower case."""
    return ascii_lower(F.trim(line, F.lit(WHITE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_refs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """k1, k2, doc_id: one row for each row of `docs` and each distinct long key in it."""
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), line_key), lambda k: F.char_length(k) >= min_chars))
    lines = docs.select("doc_id", F.explode(keys).alias("key"))
    k1, k2 = hash128(F.col("key"))
    return lines.select(k1.alias("k1"), k2.alias("k2"), "doc_id")


def _shard(n: int) -> Column:
    return F.pmod(F.xxhash64("k1"), F.lit(n))


def _part(n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), "k1"), F.lit(n)).cast("int")


def _updated_filters(changes: DataFrame, filters: DataFrame) -> DataFrame:
    """shard, filter, n_spilt after each shard's changes (k1, add) were made to its filter; shards without any have no row."""

    def update(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"shard": [], "filter": [], "n_spilt": []}).astype({"shard": "int64", "n_spilt": "int64"})
        add = left.loc[left["add"], "k1"].to_numpy(np.int64).view(np.uint64)
        gone = left.loc[~left["add"], "k1"].to_numpy(np.int64).view(np.uint64)
        f = CuckooFilter.from_bytes(right["filter"].iloc[0]) if len(right) else CuckooFilter(max(64, 2 * len(add)))
        f.delete(gone)
        f.insert(add)
        return pd.DataFrame({"shard": [int(key[0])], "filter": [f.to_bytes()], "n_spilt": [len(f.spill)]})

    return changes.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(update, "shard long, filter binary, n_spilt long")


class LineIndex:
    """References, counts and filters over the lines of a set of documents.

    `insert` and `delete` give a new index that shares what is stored with the old one: an insert writes its
    references, a delete its doc_ids; the keys they touch are counted again, alone, from the folders of
    references that hold them, and written as a layer over the counts; and the keys that thereby become
    frequent, or cease to be, are inserted in or deleted from the filters of their shards. Deleting a document
    that was inserted restores the earlier state. State lies under the shared checkpoint folder.

    References are dealt to folders of about PART_DOCS documents each, so a change reads the folders of its keys.
    """

    def __init__(self, min_chars: int, min_docs: int, parts: int, segments: list, layers: list[DataFrame], filters: list[DataFrame], n_shards: int):
        self.min_chars, self.min_docs, self.parts = min_chars, min_docs, parts
        #: What came in order: ("add", references) and ("gone", doc_ids).
        self._segments = segments
        #: Counts, the newest layer last: a key's row in a later layer replaces the one before.
        self._layers = layers
        self._filters = filters
        self.n_shards = n_shards

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
        parts = 1 << max(0, int(np.ceil(np.log2(max(1, docs.count()) / PART_DOCS))))
        refs = _stored_refs(docs, min_chars, parts)
        return cls._from_refs(refs, [("add", refs)], min_chars, min_docs, parts)

    @classmethod
    def _from_refs(cls, refs: DataFrame, segments: list, min_chars: int, min_docs: int, parts: int) -> LineIndex:
        counts = cut(_counted(refs).where(F.col("n_docs") >= min_docs))
        n_shards = 1 << max(0, int(np.ceil(np.log2(max(1, counts.count()) / SHARD_KEYS))))
        made = cls(min_chars, min_docs, parts, segments, [counts], [], n_shards)
        added = counts.select(_shard(n_shards).alias("shard"), "k1", F.lit(True).alias("add"))
        none = refs.sparkSession.createDataFrame([], "shard long, filter binary, n_spilt long")
        made._filters = [cut(_updated_filters(added, none))]
        return made

    @property
    def spark(self):
        return self._layers[0].sparkSession

    @property
    def stored(self) -> DataFrame:
        """part, k1, k2, doc_id of the references that no later delete took away."""
        out = None
        for i, (kind, rows) in enumerate(self._segments):
            if kind != "add":
                continue
            for later, gone in self._segments[i + 1 :]:
                if later == "gone":
                    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out

    @property
    def refs(self) -> DataFrame:
        return self.stored.select("k1", "k2", "doc_id")

    @property
    def counts(self) -> DataFrame:
        """k1, k2, n_docs, last_doc of the keys repeated often enough."""
        out = self._layers[0]
        for layer in self._layers[1:]:
            out = out.join(layer.select("k1", "k2"), ["k1", "k2"], "left_anti").unionByName(layer)
        return out.where(F.col("n_docs") >= self.min_docs)

    @property
    def filters(self) -> DataFrame:
        out = self._filters[0]
        for layer in self._filters[1:]:
            out = out.join(layer.select("shard"), "shard", "left_anti").unionByName(layer)
        return out

    def insert(self, docs: DataFrame) -> LineIndex:
        new = _stored_refs(docs, self.min_chars, self.parts)
        return self._changed([*self._segments, ("add", new)], new.select("part", "k1", "k2"))

    def delete(self, docs: DataFrame) -> LineIndex:
        """Take out all rows of the doc_ids in `docs`. If `docs` has their texts too, the references of others aren't read to find their keys."""
        gone = cut(docs.select(F.col("doc_id").alias("gone")).distinct())
        if "text" in docs.columns:
            touched = line_refs(docs, self.min_chars).withColumn("part", _part(self.parts)).select("part", "k1", "k2")
        else:
            touched = self.stored.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_semi").select("part", "k1", "k2")
        return self._changed([*self._segments, ("gone", gone)], touched)

    def _changed(self, segments: list, touched: DataFrame) -> LineIndex:
        touched = cut(touched.distinct())
        folders = [r["part"] for r in touched.select("part").distinct().collect()]  # at most `parts` numbers
        after = LineIndex(self.min_chars, self.min_docs, self.parts, segments, self._layers, self._filters, self.n_shards)
        now = after.stored.where(F.col("part").isin(folders)).join(touched, ["part", "k1", "k2"], "left_semi")
        counted = touched.select("k1", "k2").join(_counted(now), ["k1", "k2"], "left").select("k1", "k2", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "last_doc")
        before = self.counts.join(touched, ["k1", "k2"], "left_semi").select("k1", "k2", F.lit(True).alias("was"))
        layer = cut(counted.join(before, ["k1", "k2"], "left").withColumn("was", F.coalesce("was", F.lit(False))))
        after._layers = [*self._layers, layer.drop("was")]
        crossed = layer.where((F.col("n_docs") >= self.min_docs) != F.col("was")).select(_shard(self.n_shards).alias("shard"), "k1", (~F.col("was")).alias("add"))
        crossed = cut(crossed)
        shards = crossed.select("shard").distinct()
        after._filters = [*self._filters, cut(_updated_filters(crossed, self.filters.join(F.broadcast(shards), "shard", "left_semi")))]
        spilt = after._filters[-1].agg(F.max("n_spilt")).first()[0] or 0
        # layers are folded, and filters sized anew, once in a while: what that costs is spread over the changes before
        return after.compacted() if len(after._layers) > MAX_LAYERS or spilt > SHARD_KEYS // 10 else after

    def compacted(self) -> LineIndex:
        """The same index in one layer, from the references that are left."""
        refs = self.spark.read.parquet(_write_refs(self.stored))
        return self._from_refs(refs, [("add", refs)], self.min_chars, self.min_docs, self.parts)

    def _decided(self, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of `refs` that may be frequent, and the counts to look them up in."""
        if self.n_shards == 1:  # one filter of about SHARD_KEYS keys, half a megabyte: every task asks it
            held = self.spark.sparkContext.broadcast([r["filter"] for r in self.filters.select("filter").collect()])
            return refs.mapInPandas(_asker(held), refs.schema), self.counts
        return refs, self.counts.join(_asked_by_shard(refs, self.filters, self.n_shards), ["k1", "k2"])

    def dropped(self, refs: DataFrame) -> DataFrame:
        """doc_id, k1, k2 of the keys whose lines leave the document."""
        rows, counts = self._decided(refs)
        total = self.counts.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
        found = join_counted(rows, counts, ["k1", "k2"], "n_docs", total)
        return found.where(F.col("doc_id") != F.col("last_doc")).select("doc_id", "k1", "k2")

    def clean(self, docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
        """doc_id, text (null: empty), clean_text, n_lines, n_dropped for each row of `docs`."""
        drops = self.dropped(self.refs if refs is None else refs)
        drops = drops.groupBy(F.col("doc_id").alias("drop_doc")).agg(F.collect_set(F.struct("k1", "k2")).alias("drop_keys"))
        joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(drops, F.col("doc_id") == F.col("drop_doc"), "left")
        lines, least = _lines(F.col("text")), self.min_chars
        asked = F.when(F.col("drop_keys").isNotNull(), F.transform(lines, line_key))  # hashed only where something goes
        of = lambda i: F.transform(asked, lambda k: F.when(F.char_length(k) >= least, hash128(k)[i]).otherwise(0))
        held = lambda c: F.transform("drop_keys", lambda k: k[c])
        rows = joined.select("doc_id", "text", F.col("drop_keys").isNull().alias("whole"), _stay(of(0), of(1), held("k1"), held("k2")).alias("stay"))
        kept = F.when(F.col("whole"), lines).otherwise(F.filter(lines, lambda x, i: F.get("stay", i)))
        out = rows.select("doc_id", "text", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
        return out.select("doc_id", "text", F.array_join("kept", "\n").alias("clean_text"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"))


@F.pandas_udf(ArrayType(BooleanType()))
def _stay(k1: pd.Series, k2: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    """For each line whether it stays: both halves of its key are compared, in a set."""
    out = []
    for a, b, c, d in zip(k1, k2, d1, d2):
        gone = set(zip(c, d)) if c is not None else None
        out.append(None if gone is None else [key not in gone for key in zip(a, b)])
    return pd.Series(out)


def _write_refs(refs: DataFrame) -> str:
    """Write references in a folder for each part; a very common key is spread over tasks by its documents."""
    path = scratch_dir(refs.sparkSession)
    with cleaned(refs.sparkSession):
        refs.repartition("part", F.pmod(F.xxhash64("doc_id"), F.lit(16))).write.partitionBy("part").parquet(path)
    return path


def _stored_refs(docs: DataFrame, min_chars: int, parts: int) -> DataFrame:
    refs = line_refs(docs, min_chars).withColumn("part", _part(parts)).select("part", "k1", "k2", "doc_id")
    return docs.sparkSession.read.schema(refs.schema).parquet(_write_refs(refs))


def _counted(refs: DataFrame) -> DataFrame:
    """k1, k2, n_docs (distinct doc_ids; null is none), last_doc."""
    return refs.groupBy("k1", "k2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _asker(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = [CuckooFilter.from_bytes(f) for f in held.value]
        for pdf in batches:
            yield pdf[filters[0].contains(pdf["k1"].to_numpy(np.int64).view(np.uint64))] if filters else pdf[:0]

    return run


def _asked_by_shard(refs: DataFrame, filters: DataFrame, n: int) -> DataFrame:
    """k1, k2 that the sharded filters let through: keys meet their shard's filter in the partition that has both.

    A filter row sorts before the keys of its shard, so the stream of a partition needs one filter in memory.
    Keys are pre-aggregated to one row each, so a frequent line is asked once whatever its documents.
    """
    keys = refs.select("k1", "k2").distinct().select(_shard(n).alias("shard"), "k1", "k2", F.lit(None).cast("binary").alias("filter"))
    both = keys.unionByName(filters.select("shard", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "filter"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, of = None, None
        for pdf in batches:
            for shard, part in pdf.groupby("shard", sort=False):
                here = part[part["filter"].notna()]
                if len(here):
                    held, of = CuckooFilter.from_bytes(here["filter"].iloc[0]), shard
                asked = part[part["filter"].isna()]
                if of == shard and len(asked):
                    yield asked.loc[held.contains(asked["k1"].to_numpy(np.int64).view(np.uint64)), ["k1", "k2"]]

    return both.repartition(n, "shard").sortWithinPartitions("shard", F.col("filter").isNull()).mapInPandas(run, "k1 long, k2 long")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Clean every row of `docs` against all of them: doc_id, text, clean_text, n_lines, n_dropped.

    A null or empty text is one empty line. Rows that repeat a doc_id are one document: they count once, lose
    the same keys, and those of the largest doc_id holding a key keep its lines. A row without doc_id counts as
    no document and keeps its lines. Empty tables give an empty result; columns other than doc_id and text are
    not read.
    """
    return LineIndex.build(docs, min_chars, min_docs).clean(docs)

