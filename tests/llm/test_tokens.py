import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tickloom.llm import bpe, token_store

ODD = ["", " ", "  a", "a  b", "a\n\nb ", "don't 's", "\t\n x", "é日本語😀   x", "x" * 3000, "ab " * 20_000, "a\x1c b", "1 22٠ _-=", "İstanbul ẞ", "<|endoftext|> a"]


@pytest.fixture(scope="module")
def ranks():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.load_ranks(f.read().split(b"\n"))


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n=150):
    rng = random.Random(3)
    return ["".join(rng.choice("aAeé0 1_-=\n'日tThinrs😀 ") for _ in range(rng.randint(0, 200))) for _ in range(n)]


@pytest.mark.parametrize("states", [60_000, 50])
def test_transducer_equals_library(ranks, reference, states):
    machine = bpe.BpeTransducer(ranks, states)
    encoder = bpe.RunEncoder(P.PATTERN, lambda p: machine.encode(p.encode()))
    for text in ODD + random_texts():
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_pair_test_equals_merging(ranks):
    machine, rng = bpe.BpeTransducer(ranks), random.Random(5)
    ids = list(ranks.values())
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids)
        if machine._split(machine.tokens[a]) and machine._split(machine.tokens[b]):
            assert machine._fit(a, b) == (machine.merge(machine.tokens[a] + machine.tokens[b]) == [a, b])


def test_stream_decoder_holds_back(ranks):
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        tokens[i] = t
    decoder = bpe.StreamDecoder(tokens)
    parts = [decoder.feed([ranks[bytes([b])]])[1] for b in "é😀".encode()]
    assert parts == ["", "é", "", "", "", "😀"] and decoder.finish() == ""


def test_encode_documents(spark, reference):
    texts = [*ODD, None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = {r["doc_id"]: r for r in bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert out[i]["n_tokens"] == len(ids) and out[i]["decoded"] == (t or "")
        assert out[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1001):
        codes = (2.0 ** rng.uniform(0, 32, n)).astype(np.uint64).clip(0, 2**32 - 1).astype(np.uint32)
        control, data = token_store.encode_codes(codes)
        assert len(control) == -(-n // 4)
        assert (token_store.decode_codes(control, data, n) == codes).all()
    with pytest.raises(ValueError):
        token_store.decode_codes(b"\x00", b"", 2)


def test_store(spark, tmp_path):
    texts = [*ODD, None, "same", "same"]
    docs = spark.createDataFrame([(7 * i % 17, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, start int")
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, path, P.path("byte_bpe_50k.json"), P.PATTERN, block_ids=500)
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    digests = sorted(map(tuple, token_store.read_store(spark, path, digest=True).collect()))
    whole = sorted(map(tuple, token_store.read_store(spark, path).collect()))
    start, expected = 0, []
    for i, t in sorted(((7 * i % 17, t or "") for i, t in enumerate(texts)), key=lambda x: x[0]):
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4")
        expected.append((i, start, len(ids), ids.tobytes()))
        start += len(ids)
    assert whole == expected
    assert digests == [(i, s, n, zlib.crc32(b)) for i, s, n, b in expected]
    order = [r["id"] for r in spark.read.parquet(f"{path}/dictionary").orderBy("rank").collect()]
    count = np.bincount(np.concatenate([np.frombuffer(b, "<u4") for *_, b in expected]))
    assert order == sorted(np.flatnonzero(count).tolist(), key=lambda i: (-count[i], i))


def test_empty_store(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_store.write_store(docs, f"file://{tmp_path}/store", P.path("byte_bpe_50k.json"), P.PATTERN)
    assert token_store.read_store(spark, f"file://{tmp_path}/store").count() == 0


def test_encode_repeated_rows_and_null_ids(spark, reference):
    rows = [(1, "same text"), (1, "same text"), (None, "a b"), (None, None), (2, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, ("n_tokens", "decoded_sha256")).collect()
    expected = sorted((i, len(reference.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in [(i or -1, t) for i, t in rows])
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["decoded_sha256"]) for r in out) == expected


def test_store_with_null_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "b"), (None, "a"), (3, None), (1, "one")], "doc_id long, text string")
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, path, P.path("byte_bpe_50k.json"), P.PATTERN)
    out = sorted(((r["start"], r["doc_id"], r["n_tokens"]) for r in token_store.read_store(spark, path).collect()))
    assert [i for _, i, _ in out] == [None, None, 1, 3] and out[0][0] == 0 and all(a[0] + a[2] == b[0] for a, b in zip(out, out[1:]))
