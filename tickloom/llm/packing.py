"""Packing token sequences: cutting stock by column generation over the histogram of lengths.

A document's ids (with the end id) fill whole sequences as long as they can; what is left, 1 to capacity - 1 ids, is
a piece to be packed. A linear program over the histogram of these lengths says how often each pattern is used:
patterns are multisets of lengths that fill a sequence to the brim, either the capacity or a power of two (which
isn't padded), and a knapsack dynamic program prices new ones from the dual values. Its size is that of the
histogram, whatever the number of documents. Rounded down patterns, then single exact fillings of what rounding
left, take whole pieces; the few pieces that fit no filling run on end to end through further sequences and are the
only ones cut, the last of these sequences being powers of two. So no sequence is padded at all.

Documents get their places without meeting: a document's rank among those of its length is its rank within its task
plus the counts of the tasks before, and rank and length alone give pattern, sequence and offset by arithmetic.
Texts are encoded once, where they are read; ids are kept for pieces that are cut, digests for all others.

A null text is empty: its document is the end id alone. Repeated and null doc_ids are documents like others. Columns
other than doc_id and text aren't read. An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm._common import cut, map_arrow
from tickloom.llm.token_store import text_encoder

CAPACITY = 1024
#: A sequence costs this part of the capacity beside its ids: full sequences are worth more than many short ones.
OVERHEAD = 64
#: The linear program ends when no pattern would gain more than this share of its size.
GAP = 0.005
#: Columns taken from one pricing, and pricings at most.
COLUMNS = 64
ROUNDS = 150
#: Rows of pieces to cut that are sent to every task; more are joined by a shuffle.
MAX_SENT = 100_000


class _Program:
    """max value.x, A x + u = counts, x and u not negative: the revised simplex method with an explicit inverse."""

    def __init__(self, counts: np.ndarray):
        m = len(counts)
        self.inverse = np.eye(m)
        # a little more of each length, differently, keeps ties from stalling; rounding down takes it away again
        self.level = counts + 1e-4 * (1 + np.arange(m)) / m
        self.prices = np.zeros(m)
        self.basis: list[tuple | None] = [None] * m

    def enter(self, rows: list[int], times: list[int], value: float, pattern: tuple | None) -> bool:
        """Bring a pattern (None: pieces of a length left over) into the basis if it still gains."""
        gain = value - float(self.prices[rows] @ times)
        if gain <= 1e-9:
            return False
        direction = self.inverse[:, rows] @ np.array(times, float)
        limits = np.full(len(direction), np.inf)
        up = direction > 1e-9
        limits[up] = self.level[up] / direction[up]
        r = int(np.argmin(limits))
        if not np.isfinite(limits[r]):
            return False
        pivot = self.inverse[r] / direction[r]
        step = self.level[r] / direction[r]
        touched = np.flatnonzero(direction)
        self.inverse[touched] -= direction[touched, None] * pivot
        self.inverse[r] = pivot
        self.level -= step * direction
        self.level[r] = step
        np.maximum(self.level, 0, out=self.level)
        self.prices += gain * pivot
        self.basis[r] = pattern
        return True


def _fillings(lengths: np.ndarray, most: np.ndarray, prices: np.ndarray, sizes: list[int], bounded: bool, overhead: int) -> list[tuple[float, int, dict[int, int]]]:
    """Cheapest exact fillings, as (gain, size, times by row): a knapsack dynamic program over the capacity.

    Unbounded, one table gives for every length the best filling that holds it; fillings that use a length more
    often than it occurs are left out. Bounded, items are split into powers of two and each is taken once at most.
    """
    top = max(sizes)
    found = []
    if not bounded:
        best, last = np.full(top + 1, -np.inf), np.full(top + 1, -1)
        best[0] = 0
        for c in range(1, top + 1):
            fit = np.searchsorted(lengths, c, "right")
            if fit:
                through = best[c - lengths[:fit]] - prices[:fit]
                k = int(np.argmax(through))
                best[c], last[c] = through[k], k
        for size in sizes:
            fit = np.flatnonzero(lengths <= size)
            gains = size - overhead + best[size - lengths[fit]] - prices[fit]
            for k in fit[np.argsort(-gains, kind="stable")[:COLUMNS]]:
                gain = size - overhead + best[size - lengths[k]] - prices[k]
                if gain <= GAP * size:
                    break
                times, c = {int(k): 1}, size - int(lengths[k])
                while c > 0:
                    times[int(last[c])] = times.get(int(last[c]), 0) + 1
                    c -= int(lengths[last[c]])
                if all(n <= most[i] for i, n in times.items()):
                    found.append((float(gain), size, times))
        return found
    best = np.full(top + 1, -np.inf)
    best[0] = 0
    steps = []
    for k, length in enumerate(lengths.tolist()):
        left, n = int(min(most[k], top // length)), 1
        while left:
            n = min(n, left)
            weight = n * length
            through = best[: top + 1 - weight] - n * prices[k]
            better = through > best[weight:]
            steps.append((k, n, weight, better))
            best[weight:] = np.where(better, through, best[weight:])
            left, n = left - n, 2 * n
    for size in sizes:
        gain = size - overhead + best[size]
        if gain <= GAP * size:
            continue
        times, c = {}, size
        for k, n, weight, better in reversed(steps):
            if c >= weight and better[c - weight]:
                times[k] = times.get(k, 0) + n
                c -= weight
        found.append((float(gain), size, times))
    return found


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int], float]]:
    """Patterns (size, times by length) and how often the linear program uses each, fractions included.

    It starts from greedy exact fillings. Stopping it, at GAP or after ROUNDS pricings, leaves a valid plan.
    """
    lengths = np.array(sorted(counts), np.int64)
    if not len(lengths):
        return []
    demand = np.array([counts[n] for n in lengths.tolist()], float)
    row_of = {n: k for k, n in enumerate(lengths.tolist())}
    program = _Program(demand)
    overhead = capacity // OVERHEAD
    shorter = [1 << k for k in reversed(range((capacity - 1).bit_length()))]

    def enter(size: int, times: dict[int, int]) -> int:
        rows = list(times)
        entered = program.enter(rows, [times[r] for r in rows], size - overhead, (size, tuple(times.items())))
        while program.prices.min() < -1e-7 and program.enter([int(np.argmin(program.prices))], [1], 0.0, None):
            entered += 1
        return int(entered)

    for times, _ in _greedy(dict(counts), capacity):
        enter(capacity, {row_of[n]: k for n, k in times.items()})
    kinds = [([capacity], False), ([capacity], True), ([capacity, *shorter], True)]
    for _ in range(ROUNDS):
        if not kinds:
            break
        sizes, bounded = kinds[0]
        found = _fillings(lengths, demand, program.prices, sizes, bounded, overhead)
        if not sum(enter(size, times) for _, size, times in sorted(found, key=lambda x: -x[0] / x[1])):
            kinds.pop(0)
    return [(p[0], {int(lengths[k]): n for k, n in p[1]}, float(x)) for p, x in zip(program.basis, program.level) if p is not None and x > 1e-9]


def _exact(left: dict[int, int], longest: int, capacity: int) -> dict[int, int] | None:
    """Pieces that are left, the longest one among them, that fill the capacity exactly; None if none do.

    Bit c of reached[k] says whether the longest piece and some of the first k of `tried` add up to c.
    """
    reached, tried = [1 << longest], []
    full, wanted = (1 << (capacity + 1)) - 1, 1 << capacity
    for length in sorted((n for n in left if n <= min(longest, capacity - longest)), reverse=True):
        for _ in range(min(left[length] - (length == longest), capacity // length)):
            more = reached[-1] | (reached[-1] << length) & full
            if more == reached[-1] or more & wanted and reached[-1] & wanted:
                break
            tried.append(length)
            reached.append(more)
        if reached[-1] & wanted:
            break
    if not reached[-1] & wanted:
        return None
    times, c = {longest: 1}, capacity
    for k in range(len(tried), 0, -1):
        if not (reached[k - 1] >> c) & 1:
            times[tried[k - 1]] = times.get(tried[k - 1], 0) + 1
            c -= tried[k - 1]
    return times


def _greedy(left: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Exact fillings until none is left, the longest pieces first, each as often as `left` has its pieces.

    Each uses up a length or nearly, so there are about as many as lengths. A longest piece that no filling takes now
    has none later either.
    """
    for longest in sorted(left, reverse=True):
        while left.get(longest) and (times := _exact(left, longest, capacity)):
            n = min(left[length] // k for length, k in times.items())
            for length, k in times.items():
                left[length] -= k * n
                if not left[length]:
                    del left[length]
            yield times, n


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, dict[int, int], int]], dict[int, int]]:
    """Patterns (size, times by length, sequences) in whole numbers, and the pieces by length that none of them takes."""
    counts = {k: n for k, n in counts.items() if n}
    left = dict(counts)
    used: dict[tuple, int] = {}

    def take(size: int, times: dict[int, int], n: int) -> None:
        if n:
            key = (size, tuple(sorted(times.items())))
            used[key] = used.get(key, 0) + n
            for length, k in times.items():
                left[length] -= k * n
                if not left[length]:
                    del left[length]

    solved = solve(counts, capacity)
    for size, times, x in solved:
        take(size, times, int(x + 1e-3) if all(left.get(k, 0) >= n * int(x + 1e-3) for k, n in times.items()) else int(x))
    for size, times, x in sorted(solved, key=lambda s: int(s[2]) - s[2]):  # the largest fractions first
        if all(left.get(k, 0) >= n for k, n in times.items()) and x - int(x) > 0.3:
            take(size, times, 1)
    for times, n in list(_greedy(dict(left), capacity)):
        take(capacity, times, n)
    return [(size, dict(times), n) for (size, times), n in sorted(used.items(), key=lambda u: (-u[0][0], u[0][1]))], left


class _Places:
    """From (length, rank) to a place: tables with a row for each length of each pattern, a few thousand at most."""

    def __init__(self, patterns: list[tuple[int, dict[int, int], int]], left: dict[int, int], first: int, capacity: int):
        self.capacity = capacity
        by_length: dict[int, list[tuple]] = {}
        for _, times, n in patterns:
            offset = 0
            for length, k in sorted(times.items(), reverse=True):
                by_length.setdefault(length, []).append((k * n, k, first, offset))
                offset += k * length
            first += n
        # columns: ranks before, times in the pattern, first sequence, first offset
        self.slots = {}
        for length, rows in by_length.items():
            table = np.array(rows, np.int64)
            table[:, 0] = np.cumsum(table[:, 0]) - table[:, 0]
            self.slots[length] = (table, sum(r[0] for r in rows))
        self.run, at = {}, 0
        for length in sorted(left, reverse=True):
            self.run[length] = at
            at += left[length] * length
        # the last stretch of the run is cut into powers of two
        whole, rest = divmod(at, capacity)
        self.whole, self.first = whole, first
        self.tail = [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]
        self.tail_starts = (whole * capacity + np.cumsum([0, *self.tail])).tolist()
        self.sequences = first + whole + len(self.tail)

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the piece, length, sequence, offset) of each part of the rank-th piece of a length."""
        table, covered = self.slots.get(length, (None, 0))
        if rank < covered:
            before, times, first, offset = table[np.searchsorted(table[:, 0], rank, "right") - 1].tolist()
            within = rank - before
            return [(0, length, first + within // times, offset + within % times * length)]
        at = self.run[length] + (rank - covered) * length
        out, start = [], 0
        while start < length:
            k, inside = divmod(at + start, self.capacity)
            size = self.capacity
            if k >= self.whole:
                j = int(np.searchsorted(self.tail_starts, at + start, "right")) - 1
                k, inside, size = self.whole + j, at + start - self.tail_starts[j], self.tail[j]
            n = min(length - start, size - inside)
            out.append((start, n, self.first + k, inside))
            start += n
        return out


_ENCODED = "part long, row long, doc_id long, n long, rest long, rank long, before long, digests binary, ids binary"


def _encoded(docs: DataFrame, definition: bytes, pattern: str, end_id: int, capacity: int) -> DataFrame:
    """A row for each document: its place among its task's rows (rank: among those with the same rest, before: whole sequences), a digest of each piece and the ids of its rest."""
    held = docs.sparkSession.sparkContext.broadcast(definition)
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(held.value, pattern)
        part = TaskContext.get().partitionId()
        row = before = 0
        ranks: dict[int, int] = {}
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + tail
                n = len(ids) // 4
                whole, rest = divmod(n, capacity)
                view = memoryview(ids)
                step = 4 * capacity
                digests = [zlib.crc32(view[k : k + step]) for k in range(0, len(ids), step)]
                last = np.frombuffer(view[whole * step :], "<u4")
                narrow = last.astype("<u2") if rest == 0 or last.max() < 65536 else last
                rank = ranks.get(rest, 0)
                ranks[rest] = rank + 1
                out.append((part, row, doc_id, n, rest, rank, before, np.array(digests, "<u4").tobytes(), narrow.tobytes()))
                row, before = row + 1, before + whole
            kinds = [pa.int64()] * 7 + [pa.binary()] * 2
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["part", "row", "doc_id", "n", "rest", "rank", "before", "digests", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), run, _ENCODED)


_PIECE_TYPES = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_PIECE_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _PIECE_TYPES)], names=[n for n, _ in _PIECE_TYPES])


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every document of `docs`.

    Sequences are numbered from 0 without gaps: those that one document fills, patterns, then the run of cut pieces.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        definition = f.read()
    encoded = cut(_encoded(docs, definition, pattern, end_id, capacity), "zstd")
    small = encoded.drop("ids")

    # one row for each task and rest at most: places of a task's ranks and whole sequences among all tasks'
    counts = cut(small.groupBy("part", "rest").agg(F.count("*").alias("n_docs"), F.sum(F.expr(f"n div {capacity}")).alias("n_whole")))
    earlier = lambda *by: Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("part", "rest", F.coalesce(F.sum("n_docs").over(earlier("rest")), F.lit(0)).alias("rank_base"))
    wholes = counts.groupBy("part").agg(F.sum("n_whole").alias("n_whole"))
    bases = wholes.select("part", F.coalesce(F.sum("n_whole").over(earlier()), F.lit(0)).alias("whole_base"))
    histogram = {r["rest"]: r["n"] for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("n_docs").alias("n")).collect()}
    whole = counts.agg(F.coalesce(F.sum("n_whole"), F.lit(0)).alias("n")).first()["n"]
    patterns, left = plan(histogram, capacity)
    held = spark.sparkContext.broadcast(_Places(patterns, left, whole, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = held.value
        for batch in batches:
            out, parted = [], []
            for r in batch.to_pylist():
                digests = np.frombuffer(r["digests"], "<u4").tolist()
                sequence = r["whole_base"] + r["before"]
                out.extend((r["doc_id"], k * capacity, capacity, digests[k], r["n"], sequence + k, 0, None, None) for k in range(r["n"] // capacity))
                if r["rest"]:
                    found = places.pieces(r["rest"], r["rank"] + r["rank_base"])
                    base = r["n"] - r["rest"]
                    if len(found) == 1:
                        out.append((r["doc_id"], base, r["rest"], digests[-1], r["n"], *found[0][2:], None, None))
                    else:
                        parted.extend((r["doc_id"], base + s, n, None, r["n"], q, o, r["part"], r["row"]) for s, n, q, o in found)
            kinds = [pa.int64()] * 9
            if out or parted:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, *parted), kinds)], names=[*(n for n, _ in _PIECE_TYPES), "part", "row"])

    joined = small.join(ranks, ["part", "rest"]).join(bases, "part")
    placed = cut(map_arrow(joined, place, f"{PIECES}, part long, row long"))
    done = placed.where("ids_crc32 IS NOT NULL").drop("part", "row")
    parted = placed.where("ids_crc32 IS NULL").drop("ids_crc32")
    sent = parted.count() <= MAX_SENT
    open_pieces = (F.broadcast(parted) if sent else parted).join(encoded.select("part", "row", "rest", "ids"), ["part", "row"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{len(r['ids']) // r['rest']}").astype("<u4")
                start = r["start"] - (r["doc_tokens"] - r["rest"])
                rows.append((r["doc_id"], r["start"], r["length"], zlib.crc32(ids[start : start + r["length"]].tobytes()), r["doc_tokens"], r["sequence_id"], r["offset"]))
            yield _piece_batch(rows)

    return done.unionByName(map_arrow(open_pieces, digest, PIECES))
