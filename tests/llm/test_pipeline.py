import base64
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tickloom.llm import mixing, quality
from tickloom.llm._common import table


def shingles(text, width=5):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    return {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def expected_rows(spark, sf_dir):
    """What run() gives, from rows in plain Python; only scores, and the copies that the mix takes, are asked of the operators."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    stats = docs.select("doc_id", "text", "source", quality.text_statistics(F.col("text")).alias("s")).collect()
    good = [r for r in stats if model.predict(np.array([[r["s"][k] for k in quality.STATISTICS]]))[0] >= 0.3]
    groups = {}
    for r in good:
        best = groups.get(r["text"] or "")
        if best is None or (r["doc_id"] is not None and (best["doc_id"] is None or r["doc_id"] > best["doc_id"])):
            groups[r["text"] or ""] = r
    left = sorted(groups.values(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    sets = [shingles(r["text"]) for r in left]
    root = list(range(len(left)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(left)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = [(r["doc_id"], r["text"], r["source"]) for i, r in enumerate(left) if find(i) == i]
    frame = spark.createDataFrame(kept, "doc_id long, text string, source string")
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for r in mixing.mix_counts(frame, carry=("text",)).collect():
        text = r["text"] or ""
        ids = enc.encode_ordinary(text)
        expected += [(r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] * r["copies"]
    return sorted(expected, key=str)


def test_pipeline_against_brute_force(spark, sf_dir):
    expected = expected_rows(spark, sf_dir)
    assert expected and sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()), key=str) == expected


def test_pipeline_on_odd_rows(spark, sf_dir, tmp_path):
    rng = random.Random(8)
    real = [r["text"] for r in table(spark, sf_dir, "documents").limit(40).collect()]
    rows = [(i, t, rng.choice(["a", "b", None])) for i, t in enumerate(real)]
    rows += rows[:15] + [(None, t, "a") for t in real[:5]] + [(None, None, "a"), (None, None, None), (900, None, "b"), (900, "", "b"), (901, " \n", "c"), (900, real[7] + " end", "a"), (902, real[9] * 400, "b")]
    spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, source string, __row string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, sf_dir, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    expected = expected_rows(spark, str(tmp_path))
    assert expected and sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == expected


def test_pipeline_on_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        table(spark, sf_dir, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == 0


def test_pipeline_leaves_one_folder(spark, sf_dir):
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    corpus_pipeline.run(spark, sf_dir)
    assert len(set(os.listdir(base)) - before) == 1


def test_stages_keep_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.schema == docs.schema


@pytest.mark.parametrize("name", ["op4_line_dedup", "op8_exact_duplicates"])
def test_sql_agrees(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got = __spark_entry__.queries()[name](spark, sf_dir)
    cols = sorted(got.columns)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want.project(", ".join(cols)).fetchall())


def test_all_eleven_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


def test_two_runs_at_once_keep_their_scratch(spark, sf_dir, tmp_path):
    """Stages of two runs, taken in turns and in threads, don't delete what the other still reads."""
    from concurrent.futures import ThreadPoolExecutor

    run = lambda _: sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens").collect()), key=str)
    with ThreadPoolExecutor(2) as pool:
        one, two = pool.map(run, range(2))
    assert one == two and one
