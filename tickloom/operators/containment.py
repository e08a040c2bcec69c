"""Containment joins: which needles (names, codes, aliases, themes) stand anywhere in which texts, without pairs.

A needle needs no word borders, so names in scripts without spaces match too; `whole` needles (tickers) must not touch
another ASCII letter or digit. Needles of up to MAX_SENT letters in all are built into one automaton that every task
gets and that passes over a text once. More of them are anchored each at its rarest two letters, joined to the letter
pairs of the texts, and checked. Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Letters of all needles together that are sent to every task.
MAX_SENT = 2_000_000

_automata: dict[bytes, object] = {}


def _automaton(key: bytes, needles: list[str]):
    """Built once for each set of needles in a worker; the last few are kept."""
    if key not in _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for needle in needles:
            made.add_word(needle, needle)
        made.make_automaton()
        if len(_automata) >= 4:
            _automata.pop(next(iter(_automata)))
        _automata[key] = made
    return _automata[key]


def _touches(text: str, start: int, end: int) -> bool:
    """Whether an ASCII letter or digit stands right beside text[start:end]."""
    beside = text[max(0, start - 1) : start] + text[end : end + 1]
    return any(c.isascii() and c.isalnum() for c in beside)


def _sent(texts: DataFrame, rows: list, text_id: str, text: str, schema: StructType) -> DataFrame:
    spark = texts.sparkSession
    needles = sorted({r["needle"] for r in rows})
    anywhere = {r["needle"] for r in rows if not r["whole"]}
    whole = {r["needle"] for r in rows if r["whole"]}
    key = hashlib.sha256("\0".join(needles).encode("utf-8", "surrogatepass")).digest()
    held = spark.sparkContext.broadcast((needles, anywhere, whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needles, anywhere, whole = held.value
        machine = _automaton(key, needles)
        for batch in batches:
            at, found_needles, found_whole = [], [], []
            for k, body in enumerate(batch.column(1).to_pylist()):
                found = set()
                for end, needle in machine.iter(body) if needles else ():
                    if needle in anywhere:
                        found.add((needle, False))
                    if needle in whole and not _touches(body, end + 1 - len(needle), end + 1):
                        found.add((needle, True))
                for needle, w in found:
                    at.append(k)
                    found_needles.append(needle)
                    found_whole.append(w)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(found_needles, pa.string()), pa.array(found_whole, pa.bool_())], names=[text_id, "needle", "whole"])

    return texts.select(text_id, text).mapInArrow(run, schema)


def _anchored(texts: DataFrame, needles: DataFrame, text_id: str, text: str) -> DataFrame:
    n = F.char_length(text)
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(F.col(text), i, F.lit(2)))
    singles = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(F.col(text), i, F.lit(1)))
    grams = texts.where(n > 0).select(text_id, F.explode(F.array_distinct(F.concat(pairs, singles))).alias("gram"))
    own = F.when(F.char_length("needle") == 1, F.array("needle")).otherwise(F.transform(F.sequence(F.lit(1), F.char_length("needle") - 1), lambda i: F.substr(F.col("needle"), i, F.lit(2))))
    spread = needles.select("needle", "whole", F.explode(F.array_distinct(own)).alias("gram"))
    counts = grams.join(spread.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    anchors = spread.join(counts, "gram", "left").groupBy("needle", "whole").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("gram"))
    candidates = grams.join(anchors, "gram").select(text_id, "needle", "whole")
    checked = candidates.join(texts.select(text_id, text), text_id)
    alone = F.expr(f"`{text}` rlike concat('(^|[^a-zA-Z0-9])\\\\Q', needle, '\\\\E([^a-zA-Z0-9]|$)')")
    return checked.where(F.contains(F.col(text), F.col("needle")) & (~F.col("whole") | alone)).select(text_id, "needle", "whole")


def found_in(texts: DataFrame, needles: DataFrame, text_id: str, text: str, max_sent: int = MAX_SENT) -> DataFrame:
    """text_id, needle, whole: every distinct needle of `needles` (needle, whole) that a text holds, once.

    Case counts: give both sides in one case. A null text holds nothing; null and empty needles are found nowhere.
    `text_id` tells texts apart.
    """
    distinct = needles.where("needle <> ''").select("needle", F.col("whole").cast("boolean").alias("whole")).distinct()
    texts = texts.where(F.col(text).isNotNull())
    letters = distinct.agg(F.coalesce(F.sum(F.char_length("needle")), F.lit(0)).alias("n")).first()["n"]
    if letters > max_sent:
        return _anchored(texts, distinct, text_id, text)
    schema = StructType([texts.schema[text_id], *distinct.schema.fields])
    schema = StructType([StructField(f.name, f.dataType) for f in schema])
    return _sent(texts, distinct.collect(), text_id, text, schema)
