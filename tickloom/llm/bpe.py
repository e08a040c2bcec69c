"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The last token of the encoding of a prefix is fixed by the prefix, and two tokens may stand side by side only
if merging their bytes gives the two back. So a left-to-right machine needs to remember only the last token it
is sure of and the bytes behind it: once every way in which a later token could still begin agrees on a cut,
the tokens before the cut are final and are emitted. States and transitions are made when first met, and the
table is emptied when it is full, as in a lazy automaton.
"""

from __future__ import annotations

import base64
import bisect
import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm._chunks import RunEncoder
from tickloom.llm._common import map_arrow

MAX_STATES = 60_000


def load_ranks(lines: list[bytes]) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 of the token's bytes, a space, its rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class BpeTransducer:
    """Encodes bytes by merge ranks; equal to merging the lowest-ranked pair until none is left.

    A state is the last final token and the bytes behind it. For each end in those bytes it knows the last
    token of the encoding up to there, so a step adds one end. A token may still begin at a place if some
    token starts with the bytes from there on. Once `max_states` states are made, bytes without a transition
    are followed undeterminised, from the state reached to the end of the piece; so memory stays bounded and
    rare words don't push out the common ones.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.prefixes = {t[:n] for t in ranks for n in range(1, len(t))}
        self.max_states = max_states
        self.fits: dict[int, bool] = {}
        self.splits: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.spines: dict[tuple[int, bool], list[tuple[bytes, int, float]]] = {}
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple[int, bytes], int] = {}
        self.keys: list[tuple[int, bytes]] = []
        self.chains: list[list[tuple[int, int]]] = []
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.ends: list[tuple[int, ...] | None] = []
        self._state((-1, b""), [(0, -1)])

    def _state(self, key: tuple[int, bytes], chain: list[tuple[int, int]]) -> int:
        at = self.ids.get(key)
        if at is None:
            at = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.chains.append(chain)
            self.steps.append({})
            self.ends.append(None)
        return at

    def merge(self, data: bytes) -> list[int]:
        """Merging by rank, for short byte strings: what the machine is compiled from."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that the token's last merge joins; None if merging its bytes doesn't give the token."""
        if token not in self.splits:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1)))
                if best == 1 << 62:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.splits[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.splits[token]

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, int, float]]:
        """The parts of a token that touch one of its ends, with the ranks that make and that absorb them."""
        out = self.spines.get((token, right))
        if out is None:
            part, absorbed, out = self.tokens[token], float("inf"), []
            while True:
                rank = self.ranks[part] if len(part) > 1 else -1
                out.append((part, rank, absorbed))
                if len(part) == 1:
                    break
                part, absorbed = self._split(part)[right], rank
            self.spines[token, right] = out
        return out

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives the two back: no merge across their border comes first."""
        key = left << 32 | right
        yes = self.fits.get(key)
        if yes is None:
            yes = len(self.tokens[right]) == 1 or self._split(self.tokens[right]) is not None
            if left >= 0 and yes:
                yes = not any(
                    (rank := self.ranks.get(a + b)) is not None and (when := max(rank, made_a, made_b)) < absorbed_a and when <= absorbed_b
                    for a, made_a, absorbed_a in self._spine(left, True)
                    for b, made_b, absorbed_b in self._spine(right, False)
                )
            if len(self.fits) > 400_000:
                self.fits.clear()
            self.fits[key] = yes
        return yes

    def _grow(self, found: list[tuple[int, int]], data: bytes) -> list[tuple[int, int]]:
        """Complete `found`, the last token (start, id) for each end, up to the end of `data`.

        A start stays in play as long as the bytes from it on begin some token. Of the tokens that end at a
        place exactly one fits what stands before it, so the first found is taken.
        """
        get, prefixes, fits = self.ranks.get, self.prefixes, self.fits.get
        at = len(found) - 1
        live = [s for s in range(at) if data[s:at] in prefixes]
        live.append(at)
        for end in range(at + 1, len(data) + 1):
            hit, keep = None, []
            for s in live:
                part = data[s:end]
                if hit is None:
                    token = get(part)
                    if token is not None:
                        left = found[s][1]
                        yes = fits(left << 32 | token)
                        if yes or yes is None and self._fit(left, token):
                            hit = (s, token)
                if part in prefixes:
                    keep.append(s)
            if hit is None:
                raise ValueError("the vocabulary lacks a byte")
            found.append(hit)
            keep.append(end)
            live = keep
        return found

    @staticmethod
    def _cuts(found: list[tuple[int, int]], end: int) -> list[int]:
        cuts = [end]
        while cuts[-1]:
            cuts.append(found[cuts[-1]][0])
        return cuts[::-1]

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        last, pending = self.keys[state]
        data = pending + bytes((byte,))
        n = len(data)
        found = self._grow(list(self.chains[state]), data)
        paths = [self._cuts(found, s) for s in range(n) if data[s:] in self.prefixes]
        paths.append(self._cuts(found, n))
        agreed = 0
        while all(len(p) > agreed + 1 for p in paths) and len({p[agreed + 1] for p in paths}) == 1:
            agreed += 1
        emitted: tuple[int, ...] = ()
        if agreed:
            cuts = paths[0][: agreed + 1]
            emitted = tuple(found[c][1] for c in cuts[1:])
            cut = cuts[-1]
            last, data = emitted[-1], data[cut:]
            # every place still open is at or behind the cut, and so is every token's start from there on
            found = [(0, last), *((max(0, s - cut), t) for s, t in found[cut + 1 :])]
        out = (self._state((last, data), found), emitted)
        self.steps[state][byte] = out
        return out

    def _end(self, state: int) -> tuple[int, ...]:
        found = self.chains[state]
        out = self.ends[state] = tuple(found[c][1] for c in self._cuts(found, len(found) - 1)[1:])
        return out

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state = 0
        steps = self.steps
        for i, byte in enumerate(data):
            at = steps[state].get(byte)
            if at is None:
                if len(self.keys) >= self.max_states:
                    return out + self._follow(state, data[i:])
                at = self._step(state, byte)
            state, emitted = at
            if emitted:
                out += emitted
        end = self.ends[state]
        out += self._end(state) if end is None else end
        return out

    def _follow(self, state: int, rest: bytes) -> list[int]:
        """What is emitted from a state on, without making states."""
        data = self.keys[state][1] + rest
        found = self._grow(list(self.chains[state]), data)
        out = []
        at = len(data)
        while at:
            at, token = found[at]
            out.append(token)
        return out[::-1]


class StreamDecoder:
    """Ids to text piece by piece: an incremental UTF-8 machine holds back bytes of an unfinished character."""

    def __init__(self, tokens: list[bytes], errors: str = "replace"):
        self.tokens = tokens
        self.machine = codecs.getincrementaldecoder("utf-8")(errors)

    def feed(self, ids: list[int]) -> tuple[bytes, str]:
        data = b"".join(map(self.tokens.__getitem__, ids))
        return data, self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", True)


_made: dict[tuple, tuple] = {}


def _tools(pattern: str, vocabulary: bytes) -> tuple[RunEncoder, list[bytes]]:
    """A worker's encoder and token table for a vocabulary, kept between tasks."""
    key = (pattern, hashlib.md5(vocabulary).digest())
    if key not in _made:
        ranks = load_ranks(vocabulary.split(b"\n"))
        machine = BpeTransducer(ranks)
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            tokens[i] = t
        _made[key] = (RunEncoder(pattern, lambda piece: machine.encode(piece.encode("utf-8", "surrogatepass"))), tokens)
    return _made[key]


#: What encode_documents() can give for a document beside its doc_id.
OUTPUTS = {"n_tokens": "long", "ids": "binary", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, outputs: tuple[str, ...] = tuple(OUTPUTS), window: int = 8192) -> DataFrame:
    """doc_id and `outputs`: n_tokens, ids (little-endian 32-bit), decoded (text from the ids), ids_sha256, decoded_sha256.

    One row for each row of `docs`, whole texts, null as empty (no ids, the hash of nothing). Only doc_id and
    text are read; no row moves between tasks. `vocabulary_path` names a file of ranks on the driver; its
    bytes go to the executors as a broadcast of that fixed size.
    """
    spark: SparkSession = docs.sparkSession
    kinds = {"n_tokens": pa.int64(), "ids": pa.binary(), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    with open(vocabulary_path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = _tools(pattern, held.value)
        wanted = "decoded" in outputs
        for batch in batches:
            made: dict[str, list] = {name: [] for name in OUTPUTS}
            for text in batch.column(1).to_pylist():
                ids = encoder.encode(text or "")
                digest, decoder, parts = hashlib.sha256(), StreamDecoder(tokens), []
                values = np.frombuffer(ids, "<u4")
                for i in range(0, len(values), window):
                    data, piece = decoder.feed(values[i : i + window].tolist())
                    digest.update(data)
                    if wanted:
                        parts.append(piece)
                parts.append(decoder.finish())
                one = (len(values), ids, "".join(parts), hashlib.sha256(ids).hexdigest(), digest.hexdigest())
                for name, value in zip(OUTPUTS, one):
                    if name in outputs:
                        made[name].append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[name], kinds[name]) for name in outputs)], names=["doc_id", *outputs])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{name} {OUTPUTS[name]}" for name in outputs)
    return map_arrow(docs.select("doc_id", "text"), run, schema)
