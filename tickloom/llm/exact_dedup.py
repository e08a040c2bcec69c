"""Exact de-duplication by progressive refinement, in DataFrame functions only.

Rows are grouped by byte length, then by a hash of the first bytes, then by a hash of the whole text; each
step reads only rows whose group in the step before has over one row. Finding copies moves lengths and hashes,
never texts; dropping them moves texts only where the numbers of the lost rows are too many to send to every task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm._common import ROW, cut, join_counted, settled, with_rows

#: Characters under the prefix hash.
PREFIX_CHARS = 64
#: Surviving (length, prefix) groups are sent to every task up to this number, 16 bytes each.
MAX_BROADCAST_GROUPS = 500_000


def duplicate_groups(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row for each set of over one row with equal texts.

    Columns: text_sha256, keep_id (the largest doc_id), group_size. A null text equals an empty one. Empty
    tables give no rows. Repeated rows count each.
    """
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(F.octet_length(text).alias("n_bytes"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix"))
    lengths = cut(sized.groupBy("n_bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = lengths.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a length that very many texts have doesn't gather them
    alike = join_counted(sized, lengths, ["n_bytes"], "n", total).where("n is not null")
    prefixes = cut(alike.groupBy("n_bytes", "prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("n_bytes", "prefix"))
    keyed = docs.select("doc_id", text.alias("text"), F.octet_length(text).alias("n_bytes"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix"))
    sha = F.sha2("text", 256).alias("text_sha256")
    if prefixes.count() <= MAX_BROADCAST_GROUPS:
        same_prefix = keyed.join(F.broadcast(prefixes), ["n_bytes", "prefix"], "left_semi").select("doc_id", sha)
    else:  # too many for every task to hold: hash first, so that narrow rows shuffle and not texts
        same_prefix = keyed.select("doc_id", "n_bytes", "prefix", sha).join(prefixes, ["n_bytes", "prefix"], "left_semi")
    groups = same_prefix.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.where("group_size > 1")


def exact_duplicates(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Each row of `docs` with what becomes of it: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts (null counts as empty) the largest doc_id stays; rows that repeat both doc_id and
    text are all marked kept. A null doc_id stays only where its group has no other. Other columns of `docs`
    are not read, so their names can't clash.
    """
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    total = docs.count()
    joined = join_counted(rows, cut(duplicate_groups(docs, prefix_chars)), ["text_sha256"], "group_size", total)
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    return joined.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row of `docs` for each text, null as empty; columns and texts as they were.

    It has the largest doc_id, null being the smallest; among rows of that doc_id a hash of the other columns
    decides, so that only rows equal throughout depend on where they stand.
    """
    other = [f.name for f in docs.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    rows = with_rows(docs)

    def lost() -> DataFrame:
        order = F.struct("doc_id", F.xxhash64(F.lit(0), *other).alias("other"), ROW)
        ordered = rows.select(order.alias("doc_id"), "text")
        groups = duplicate_groups(ordered, prefix_chars).select("text_sha256", F.col(f"keep_id.{ROW}").alias("keep_row"), "group_size")
        shas = rows.select(ROW, F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
        joined = join_counted(shas, cut(groups), ["text_sha256"], "group_size", rows.count())
        return joined.where(F.col("keep_row") != F.col(ROW)).select(ROW)

    # written first: while the lost rows are few, Spark sends their numbers to the texts and not the texts to them
    return rows.join(settled(docs.sparkSession, lost), ROW, "left_anti").select(*docs.columns)


def drop_copies(docs: DataFrame) -> DataFrame:
    """`docs` without the rows that exact_duplicates() drops; columns and texts as they were."""
    lost = cut(exact_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__lost"), F.col("text_sha256").alias("__sha")).distinct())
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    return docs.join(lost, docs["doc_id"].eqNullSafe(lost["__lost"]) & (sha == lost["__sha"]), "left_anti")
