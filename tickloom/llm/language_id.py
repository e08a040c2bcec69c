"""Language spans: script ranges narrow the candidates, Viterbi over word scores labels the words.

Each word scores under every candidate language by its character trigrams. A text is labelled by the sequence
of languages with the best sum of word scores less a penalty for each switch, so mixed texts come out as spans
and a stray word doesn't change the language. The language of a text is that of most letters.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm._common import cut, map_arrow

#: First and last code points of the scripts told apart; other letters are "Other".
SCRIPTS = (
    ("Latin", 0x0041, 0x024F),
    ("Greek", 0x0370, 0x03FF),
    ("Cyrillic", 0x0400, 0x052F),
    ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF),
    ("Arabic", 0x0600, 0x077F),
    ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF),
    ("Tamil", 0x0B80, 0x0BFF),
    ("Thai", 0x0E00, 0x0E7F),
    ("Georgian", 0x10A0, 0x10FF),
    ("Hangul", 0x1100, 0x11FF),
    ("Latin", 0x1E00, 0x1EFF),
    ("Greek", 0x1F00, 0x1FFF),
    ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x9FFF),
    ("Hangul", 0xAC00, 0xD7AF),
    ("Arabic", 0xFB50, 0xFDFF),
    ("Arabic", 0xFE70, 0xFEFF),
)
#: A fit reads at most this many texts of each language, those of smallest seeded hash.
TEXTS_PER_LANGUAGE = 1500
#: Hash ranges by which they are found: all ranges before the one that holds the last are taken whole.
HASH_RANGES = 4096
MEMO_WORDS = 500_000


SCRIPT_NAMES = [*dict.fromkeys(name for name, _, _ in SCRIPTS), "Other"]
_SPACE = 32


@functools.cache
def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point whether it is a letter, and the number of its script."""
    alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    script = np.full(0x110000, len(SCRIPT_NAMES) - 1, np.uint8)
    for name, low, high in SCRIPTS:
        script[low : high + 1] = SCRIPT_NAMES.index(name)
    return alpha, script


def letters_of(runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every letter of white-space runs: its trigram, its script, and the number of its run.

    A trigram is the letter, in lower case, with its two neighbours, where anything but a letter is a space;
    it packs three code points of 21 bits.
    """
    alpha, script = _letter_tables()
    c = np.frombuffer(("\n".join(runs) + "\n").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_end = c == 10
    is_letter = alpha[c]
    x = np.where(is_letter, c, _SPACE).astype(np.int64)
    before, after = np.roll(x, 1), np.roll(x, -1)
    before[:1] = after[-1:] = _SPACE
    codes = before << 42 | x << 21 | after
    run_of = np.cumsum(is_end) - is_end
    return codes[is_letter], script[c[is_letter]], run_of[is_letter]


@dataclass
class LanguageModel:
    languages: list[str]
    #: Script numbers by language: which scripts its texts are written in.
    scripts: np.ndarray = field(default_factory=lambda: np.zeros((len(SCRIPT_NAMES), 0), bool))
    #: Known trigrams, sorted, and the log-probabilities of each by language; row 0 is for unknown ones.
    trigrams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    logs: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))
    switch: float = 10.0

    def run_scores(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by language of each run, best 0, and its letters. Languages not written in a letter's script
        are out, unless the script is nobody's."""
        n = len(self.languages)
        out = np.zeros((len(runs), n), np.float32)
        codes, script, run_of = letters_of(runs)
        letters = np.bincount(run_of, minlength=len(runs)).astype(np.int64)
        if n and len(codes):
            at = np.searchsorted(self.trigrams, codes)
            hit = at < len(self.trigrams)
            hit[hit] = self.trigrams[at[hit]] == codes[hit]
            each = self.logs[np.where(hit, at + 1, 0)]
            away = np.where(self.scripts.any(1, keepdims=True) & ~self.scripts, np.float32(-60), np.float32(0))
            if away.any():
                each = each + away[script]
            starts = np.flatnonzero(np.diff(run_of, prepend=-1))
            sums = np.add.reduceat(each, starts, 0)
            out[run_of[starts]] = np.maximum(sums - sums.max(1, keepdims=True), -80)
        return out, letters


def usable_for_training(docs: DataFrame, folds: int = 4, out: int = 2) -> Column:
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) != out, F.lit(False))


def chosen_texts(docs: DataFrame, most: int) -> DataFrame:
    """doc_id, text, lang of the `most` usable rows of each language with the smallest seeded hash.

    Rows are counted by (language, hash range), before they move; the counts show up to which range a language
    is needed, and only those rows, hardly more than `most`, are ranked.
    """
    rows = docs.where(usable_for_training(docs)).select("doc_id", "text", "lang")
    h = F.xxhash64(F.lit(5), F.col("doc_id"))
    at = F.shiftrightunsigned(h, 64 - HASH_RANGES.bit_length() + 1).alias("range")
    counts = rows.groupBy("lang", at).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    last = counts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most).groupBy("lang").agg(F.max("range").alias("last"))
    keys = rows.select("doc_id", "lang", at, h.alias("h")).join(F.broadcast(last), "lang").where("range <= last")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("range", "h", "doc_id"))
    chosen = keys.withColumn("place", place).where(F.col("place") <= most).select(F.col("doc_id").alias("chosen"), F.col("lang").alias("as_lang")).distinct()
    return rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("chosen")) & (F.col("lang") == F.col("as_lang"))).select("doc_id", "text", "lang")


def fit_languages(docs: DataFrame, most: int = TEXTS_PER_LANGUAGE, switch: float = 10.0) -> LanguageModel:
    """Learn trigrams and scripts from at most `most` texts of each language; none gives a model without languages.

    Counting runs in Spark. A trigram met once in all chosen texts tells little of its language: such ones are
    the model's measure of trigrams it doesn't know, so that a new one costs every language its own share. The
    others, bounded by the chosen texts alone, come to the driver.
    """
    texts = chosen_texts(docs, most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).extend(text.split())
            for lang, runs in by_lang.items():
                codes, script, _ = letters_of(runs)
                for kind, values in ((0, codes), (1, script)):
                    items, n = np.unique(values.astype(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(items), kind, np.int32)), pa.array([lang] * len(items), pa.string()), pa.array(items), pa.array(n.astype(np.int64))], names=["kind", "lang", "item", "n"])

    counted = map_arrow(texts.select("text", "lang"), count, "kind int, lang string, item long, n long").groupBy("kind", "lang", "item").agg(F.sum("n").alias("n"))
    counted = cut(counted)
    grams = counted.where("kind = 0").groupBy("item").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    once = {r["lang"]: r["n"] for r in grams.where("total = 1").select(F.explode(F.map_keys("by")).alias("lang")).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    grams = sorted(grams.where("total > 1").collect(), key=lambda r: r["item"])
    shares = counted.where("kind = 1").collect()
    languages = sorted({r["lang"] for r in shares})
    at = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(grams) + 1, len(languages)))
    for i, r in enumerate(grams):
        for lang, n in r["by"].items():
            counts[i + 1, at[lang]] = n
    single = np.array([once.get(lang, 0) for lang in languages], float)
    counts += 0.5
    # row 0: one of the unknown trigrams, of which there are as many as were met once
    counts[0] = (single + 0.5) / max(1.0, single.sum())
    logs = np.log(counts / (counts[1:].sum(0) + single + 0.5)) if languages else counts
    letters = np.zeros((len(SCRIPT_NAMES), len(languages)))
    for r in shares:
        letters[r["item"], at[r["lang"]]] = r["n"]
    scripts = letters >= 0.01 * np.maximum(letters.sum(0), 1)
    return LanguageModel(languages, scripts, np.array([r["item"] for r in grams], np.int64), logs.astype(np.float32), switch)


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best label of every word of every text: texts, longest first, advance together one word at a time.

    `scores` holds the words of all texts, text i at starts[i]. Ties go to staying, then to the first language.
    """
    n = scores.shape[1]
    labels = np.zeros(len(scores), np.int16)
    if not len(scores) or not n:
        return labels
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
    value = np.zeros((len(starts), n), np.float64)
    switched = np.zeros((len(scores), n), bool)
    best_before = np.zeros(len(scores), np.int16)
    for t in range(int(lengths[0])):
        k = int(alive[t])
        at = starts[:k] + t
        v = value[:k]
        if t:
            best = v.argmax(1)
            jump = v[np.arange(k), best][:, None] - switch
            moved = jump > v
            switched[at] = moved
            best_before[at] = best
            v = np.where(moved, jump, v)
        v = v + scores[at]
        value[:k] = v - v.max(1)[:, None]
    now = value.argmax(1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        k = int(alive[t])
        at = starts[:k] + t
        labels[at] = now[:k]
        if t:
            now[:k] = np.where(switched[at, now[:k]], best_before[at], now[:k])
    return labels



class _Words(dict):
    """Numbers of the white-space runs met, with their scores and letters in tables that grow."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model
        self.new: list[str] = []
        self.scores = np.zeros((1 << 14, len(model.languages)), np.float32)
        self.letters = np.zeros(1 << 14, np.int64)

    def __missing__(self, run: str) -> int:
        at = self[run] = len(self)
        self.new.append(run)
        return at

    def score_new(self) -> None:
        """Score the runs met since the last call, all at once."""
        first, end = len(self) - len(self.new), len(self)
        while end > len(self.letters):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        if self.new:
            self.scores[first:end], self.letters[first:end] = self.model.run_scores(self.new)
            self.new = []


#: The runs a worker remembers between tasks, for the model it met last.
_kept: dict[str, _Words] = {}


def label_documents(docs: DataFrame, model: LanguageModel, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and, if wanted, spans (array of first word, words, lang) for each row of `docs`.

    Words are white-space runs. lang_pred has most letters (ties: first in order); score is its share of all
    letters. Null texts, and texts without a letter, are "und" with score 0 and no span; so is every text
    under a model without languages. Whole texts are read, only doc_id and text.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        if token not in _kept:
            _kept.clear()
            _kept[token] = _Words(model)
        words = _kept[token]
        names = [*model.languages, "und"]
        n = len(model.languages)
        for batch in batches:
            if len(words) > MEMO_WORDS:
                words = _kept[token] = _Words(model)
            ids = [np.fromiter(map(words.__getitem__, (t or "").split()), np.int64) for t in batch.column(1).to_pylist()]
            words.score_new()
            lengths = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            starts = np.cumsum(lengths) - lengths
            letters = words.letters[flat]
            labels = viterbi(words.scores[flat], starts, lengths, model.switch)
            langs, scores, found = [], [], []
            for s, m in zip(starts.tolist(), lengths.tolist()):
                own, weight = labels[s : s + m], letters[s : s + m]
                share = np.bincount(own, weight, n + 1)
                total = share.sum()
                if not total or not n:
                    langs.append("und")
                    scores.append(0.0)
                    found.append([])
                    continue
                best = int(share.argmax())
                langs.append(names[best])
                scores.append(float(share[best] / total))
                if spans:
                    edges = np.flatnonzero(np.diff(own, prepend=-1))
                    ends = np.append(edges[1:], m)
                    found.append([{"first": int(a), "words": int(b - a), "lang": names[own[a]]} for a, b in zip(edges, ends)])
            arrays = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            if spans:
                arrays.append(pa.array(found, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang_pred", "score", "spans"][: len(arrays)])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    return map_arrow(docs.select("doc_id", "text"), run, schema + (", spans array<struct<first:long,words:long,lang:string>>" if spans else ""))


def identify(docs: DataFrame, spans: bool = False) -> DataFrame:
    """Fit on the documents' training fold, label every document: doc_id, held_out, lang_pred, score."""
    out = label_documents(docs, fit_languages(docs), spans)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), *[c for c in out.columns if c != "doc_id"])
