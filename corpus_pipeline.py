"""A corpus from raw documents to token ids: reject, de-duplicate, mix, encode.

Every stage reads the columns doc_id, text, source of its table as they come: null doc_ids and texts, repeated
rows and empty tables are rows like others. Columns that a stage doesn't know are kept, whatever their names.
"""

from __future__ import annotations

import contextvars
import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import bpe, exact_dedup, mixing, near_dedup, quality
from tickloom.llm._common import cut, recorded, remove, scratch_dir, table

#: Scratch folders that the last stage's result is read from, by the tables' folder: of one run, or of stages called one by one in a thread.
_left: contextvars.ContextVar[dict[str, list[str]]] = contextvars.ContextVar("corpus_pipeline_left")


def _release(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> None:
    """Delete what earlier stages left, but for folders that `docs` still reads: a stage's result is written before the next one runs."""
    left = _left.get({}).get(sf_dir, [])
    read = docs.inputFiles() if docs is not None and left else []
    gone = [path for path in left if not any(path.rsplit("/", 1)[1] in file for file in read)]
    remove(spark, *gone)
    left[:] = [path for path in left if path not in gone]


def stage(f):
    """A stage whose scratch folders go when the next stage starts."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left.get(None) is None:
            _left.set({})
        _release(spark, sf_dir, docs)
        with recorded() as made:
            out = f(spark, docs, sf_dir)
        _left.get().setdefault(sf_dir, []).extend(made)
        return out

    return run


@stage
def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text the quality model doesn't reject. A null text is scored as an empty one; without labels all rows stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, null as empty: that of the largest doc_id, null being the smallest."""
    return exact_dedup.keep_one(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest doc_id, null being the largest. Texts without words all stay."""
    return near_dedup.keep_one(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target asks, from never to twice; null is a source, the last in order."""
    return mixing.mix_documents(docs)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; a null text has no ids."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", reject_low_quality),
    ("exact dedup", drop_exact_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level bpe", encode),
]

#: The classifier, the sketches and the encoder aren't SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each stage's result is written to the shared folder and read again.

    What a stage wrote on its way is deleted once its result is there, and so is the result before it.
    """
    mine = _left.set({})
    try:
        docs, written = table(spark, sf_dir, "documents"), None
        for _, step in STAGES[:-1]:
            before, written = written, scratch_dir(spark)
            docs = cut(step(spark, docs, sf_dir), path=written)
            _release(spark, sf_dir)
            if before:
                remove(spark, before)
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        _left.reset(mine)
