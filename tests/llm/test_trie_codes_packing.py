"""Prefix trie, vector codes and packing against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tickloom.llm import packing, prefix_trie, queries, vector_codes
from tickloom.llm._common import table


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- prefix trie


def plain_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[x] for x in below) or 1
        size = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * size + sum(saved[x] for x in below)
    return sorted(
        (
            (members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
            for n in members
        ),
        key=str,
    )


SCHEMA = "conv_id long, turn long, role string, text string, keys string"


@pytest.mark.parametrize("ranges", [1, 3, 7, 40])
def test_trie_of_rebuilt_conversations(spark, ranges):
    rng = random.Random(ranges)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "b", "é", None, ""]), "clash") for c in range(-9, 120) for t in range(rng.choice([0, 1, 2, 6, 12]))]
    rows += [(None, 0, "user", "x", "k"), (7, None, "user", "first", "k")]
    rows += [(c, t, "user", "same", "k") for c in range(200, 260) for t in range(11)]
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of(prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA))))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == plain_trie(plain_rebuilt([r[:4] for r in rows]))


def test_trie_chunks_of_members_and_long_paths(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    convs = {c: [("u", "x")] * 3 for c in range(300)} | {1000 + c: [("u", "x")] * 3 + [("b", str(c // 2))] * c for c in range(40)} | {2000: [], 2001: []}
    frame = spark.createDataFrame([(c, b"".join(hashlib.sha256(repr(t).encode()).digest()[:16] for t in turns), [len(t[1]) for t in turns]) for c, turns in convs.items()], "conv_id long, keys binary, sizes array<long>")
    swept = frame.repartitionByRange(9, "keys", "conv_id").sortWithinPartitions("keys", "conv_id").select("keys", "sizes", "conv_id")
    assert swept.rdd.getNumPartitions() == 9
    assert rows_of(prefix_trie.prefix_trie(frame)) == plain_trie(convs)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0


# -- vector codes


def plain_codes(rows):
    kept = [(i, label, [math.floor(4096 * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][2])
    cuts = np.cumsum([0] + [size // 8 + (p < size % 8) for p in range(8)]).tolist()
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    books = [[r[2][a:b] for r in kept[:16]] for a, b in zip(cuts, cuts[1:])]
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))

    def assign(p, v):
        part = v[cuts[p] : cuts[p + 1]]
        return min((dist(part, e), k) for k, e in enumerate(books[p]))

    for _ in range(6):
        for p in range(8):
            took = defaultdict(list)
            for _, _, v in kept:
                took[assign(p, v)[1]].append(v[cuts[p] : cuts[p + 1]])
            for k, parts in took.items():
                books[p][k] = [sum(c) // len(parts) for c in zip(*parts)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, label, [assign(p, v) for p in range(8)]) for i, label, v in kept]
    by_label = Counter()
    for _, label, a in found:
        by_label[label] += sum(x[0] for x in a)
    fits = lambda n: n if n < 2**63 else None
    return sorted(((i, "".join(f"{x[1]:02x}" for x in a), fits(sum(x[0] for x in a)), fits(by_label[label]), sha) for i, label, a in found), key=str)


@pytest.mark.parametrize("size,scale", [(16, 1.0), (21, 300.0), (5, 1.0), (8, 1e7)])
def test_codes_equal_plain_rounds(spark, size, scale, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 7)
    rng = random.Random(size)
    rows = [(i, rng.choice([0, 1, 2, None]), [round(rng.choice([-1, 1]) * rng.random() * scale, 3) for _ in range(size)]) for i in range(90)]
    rows += [(200 + i, 1, list(rows[i][2])) for i in range(10)] + [(3, 2, list(rows[5][2])), (None, 0, list(rows[6][2]))]
    odd = [(300, 0, None), (301, 0, [None] + [0.0] * (size - 1)), (302, 0, [math.nan] + [0.0] * (size - 1)), (303, 0, [-math.inf] + [0.0] * (size - 1))]
    frame = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, label int, embedding array<double>, code string")
    assert rows_of(vector_codes.code_vectors(frame)) == plain_codes(rows)


def test_codes_of_few_odd_and_no_vectors(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert vector_codes.code_vectors(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(1, None, [0.5] * 8), (2, None, [0.25] * 8), (3, 1, []), (4, 1, [1.0] * 3)], schema)
    got = {r.vec_id: r for r in vector_codes.code_vectors(few).collect()}
    assert {i: r.code for i, r in got.items()} == {1: "00" * 8, 2: "01" * 8, 3: "00" * 8, 4: "00" * 8}
    assert got[1].codebooks_sha256 == got[2].codebooks_sha256 != got[4].codebooks_sha256 and got[1].label_error == 0
    huge = spark.createDataFrame([(i, 0, [3e38 * (-1) ** i / i] * 8) for i in range(1, 40)], schema)
    assert all(r.error is None or r.error == 0 for r in vector_codes.code_vectors(huge).collect())


# -- packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def held_to_contract(got, docs, library):
    """Every id in one piece, sequences gapless and within the capacity, digests right; gives the padding and the cuts."""
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for _, t in docs]
    wanted = Counter((i, tuple(x)) for (i, _), x in zip(docs, ids))
    lengths = defaultdict(list)
    for r in got:
        lengths[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for pieces in lengths.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert sorted(lengths) == list(range(len(lengths)))
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id, r.doc_tokens].append(r)
    for (doc_id, x), copies in wanted.items():
        mine = Counter((r.start, r.length, r.ids_crc32) for r in by_doc[doc_id, len(x)])
        for (start, length, crc), _ in mine.items():
            assert any(zlib.crc32(np.array(y[start : start + length], "<u4").tobytes()) == crc for i, y in wanted if i == doc_id)
        assert sum(r.length for r in by_doc[doc_id, len(x)]) == sum(len(y) * n for (i, y), n in wanted.items() if i == doc_id and len(y) == len(x))
    assert sum(r.length for r in got) == sum(map(len, ids))
    return padding


def test_packing_of_odd_documents(spark, library):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "日本", "x9"]) for _ in range(rng.choice([0, 1, 5, 300, 700, 2000])))) for i in range(120)]
    docs += [(500, None), (501, ""), (3, "again"), (None, "no id"), (None, "no id"), (600, "a" * 30_000), (601, "<|endoftext|> x")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, offset string").repartition(5)
    got = packing.pack(frame, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert held_to_contract(got, docs, library) == 0


def test_packing_when_no_lengths_fit_each_other(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "MAX_SENT", 3)
    docs = [(i, " x" * 599) for i in range(30)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = packing.pack(frame, P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    assert held_to_contract(got, docs, library) == 0


def test_packing_of_nothing(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_take_every_piece_once(seed):
    rng = random.Random(seed)
    counts = dict(Counter(rng.randint(1, 63) for _ in range(rng.choice([1, 20, 400]))))
    patterns, left = packing.plan(counts, 64)
    total = Counter(left)
    for size, times, n in patterns:
        assert sum(k * v for k, v in times.items()) == size and (size == 64 or size & (size - 1) == 0) and n > 0
        for k, v in times.items():
            total[k] += v * n
    assert total == Counter(counts)


def test_linear_program_reaches_the_optimum():
    """2 x 5 + 6 fill 16, 5 + 11 fill 16: the best mix of both is known."""
    used = {tuple(sorted(t.items())): x for size, t, x in packing.solve({5: 100, 6: 20, 11: 60}, 16)}
    assert abs(used[((5, 2), (6, 1))] - 20) < 0.01 and abs(used[((5, 1), (11, 1))] - 60) < 0.01


def test_packing_on_the_tables(spark, library, sf_dir):
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = queries.op13_packing(spark, sf_dir).collect()
    assert held_to_contract(got, docs, library) == 0
    cut = Counter((r.doc_id, r.doc_tokens) for r in got)
    assert sum(n > -(-tokens // 1024) for (_, tokens), n in cut.items()) < 0.25 * len(docs)  # few pieces fit each other in so small a table


def test_queries_on_the_tables(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op11_prefix_trie(spark, sf_dir)) == plain_trie(plain_rebuilt(rows))
    vectors = [tuple(r) for r in table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding").collect()]
    assert rows_of(queries.op12_vector_codes(spark, sf_dir)) == plain_codes(vectors)
