import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import exact_dedup, line_dedup, near_dedup
from tickloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __gone string, n long"


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 7) for i, t in texts], SCHEMA)


def test_exact_groups(spark):
    docs = rows_of(spark, [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "A"), (7, "x" * 200_000), (8, "x" * 199_999 + "y"), (9, "x" * 200_000), (10, "b"), (10, "b")])
    out = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs).collect()}
    assert {i: (r["keep_id"], r["group_size"], r["kept"]) for i, r in out.items()} == {
        1: (3, 2, False), 3: (3, 2, True), 2: (10, 3, False), 10: (10, 3, True), 4: (5, 2, False), 5: (5, 2, True), 6: (6, 1, True), 7: (9, 2, False), 9: (9, 2, True), 8: (8, 1, True),
    }
    assert out[4]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 6, 8, 9, 10, 10]


def test_exact_empty_and_native(spark):
    docs = rows_of(spark, [])
    assert exact_dedup.exact_duplicates(docs).count() == 0
    plan = exact_dedup.exact_duplicates(rows_of(spark, [(1, "a"), (2, "a")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_one_row_of_equal_texts_stays(spark):
    docs = rows_of(spark, [(1, "a"), (9, "a"), (9, "a"), (None, "n"), (None, "n"), (None, "m"), (4, "m"), (4, "m"), (5, None), (5, ""), (None, "")])
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=str) == sorted([(9, "a"), (None, "n"), (4, "m"), (5, "")], key=str)
    odd = spark.createDataFrame([(3, "t", s) for s in "xyz"], "doc_id long, text string, source string")
    assert len({exact_dedup.keep_one(odd.repartition(n, "source")).collect()[0] for n in (1, 2, 3)}) == 1
    assert exact_dedup.keep_one(rows_of(spark, [])).count() == 0


def line_truth(texts, min_chars=40, min_docs=5):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    held = collections.defaultdict(set)
    for i, t in texts:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(i)
    out = {}
    for i, t in texts:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and max(held[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def test_lines_match_brute_force(spark):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdeéß ") for _ in range(rng.randint(20, 60))) for _ in range(30)]
    texts = [(i, "\n".join(rng.choice(["  ", "", "\t"]) + (x.upper() if rng.random() < 0.2 else x) + "\r" for x in rng.choices(pool, k=rng.randint(0, 9)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, "\n\n")]
    out = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["clean_text"]) for r in line_dedup.dedup_lines(rows_of(spark, texts)).collect()}
    assert out == line_truth(texts)
    assert line_dedup.dedup_lines(rows_of(spark, [])).count() == 0


def test_lines_are_reversible(spark):
    line = "the same long line of text that many documents hold"
    first = rows_of(spark, [(i, f"{line}\nown line of document {i}") for i in range(4)])
    more = rows_of(spark, [(i, line) for i in range(10, 13)])
    index = line_dedup.LineIndex.build(first)
    assert index.counts.count() == 0
    grown = index.insert(more)
    assert grown.counts.collect()[0]["n_docs"] == 7 and grown.counts.collect()[0]["last_doc"] == 12
    back = grown.delete(more.select("doc_id").where("doc_id = 12"))
    assert back.counts.collect()[0]["last_doc"] == 11
    again = grown.delete(more.select("doc_id"))
    assert sorted(map(tuple, again.refs.collect())) == sorted(map(tuple, index.refs.collect())) and again.counts.count() == 0


def keys_in(index):
    """The keys that the filters of an index hold, of those in its references."""
    found = {}
    for r in index.filters.collect():
        found[r["shard"]] = line_dedup.CuckooFilter.from_bytes(r["filter"])
    rows = index.refs.select("k1", line_dedup._shard(index.n_shards).alias("shard")).distinct().collect()
    return {r["k1"] for r in rows if r["shard"] in found and found[r["shard"]].contains(np.array([r["k1"]], np.int64).view(np.uint64))[0]}


@pytest.mark.parametrize("shard_keys, layers, part_docs", [(250_000, 16, 200_000), (4, 2, 8)])
def test_changes_equal_a_fresh_build(spark, monkeypatch, shard_keys, layers, part_docs):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(line_dedup, "MAX_LAYERS", layers)
    monkeypatch.setattr(line_dedup, "PART_DOCS", part_docs)
    rng = random.Random(9)
    pool = [f"{k} is the number of this line, which is long enough to count" for k in range(25)]
    texts = {i: "\n".join(rng.choices(pool, k=rng.randint(0, 4))) for i in range(40)}
    index = line_dedup.LineIndex.build(rows_of(spark, texts.items()))
    for step in range(4):
        if step % 2:
            lost = {i: texts.pop(i) for i in rng.sample(sorted(texts), 15)}
            rows = rows_of(spark, lost.items())
            index = index.delete(rows if step == 1 else rows.select("doc_id"))
        else:
            new = {100 * step + 50 + i: "\n".join(rng.choices(pool, k=3)) for i in range(12)}
            texts |= new
            index = index.insert(rows_of(spark, new.items()))
        fresh = line_dedup.LineIndex.build(rows_of(spark, texts.items()))
        assert sorted(map(tuple, index.counts.collect())) == sorted(map(tuple, fresh.counts.collect()))
        assert sorted(map(tuple, index.refs.collect())) == sorted(map(tuple, fresh.refs.collect()))
        assert keys_in(index) == {r["k1"] for r in fresh.counts.collect()}
    out = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["clean_text"]) for r in index.clean(rows_of(spark, texts.items())).collect()}
    assert out == line_truth(texts.items())


def test_a_change_writes_only_what_it_touches(spark):
    texts = [(i, f"a long line that every document of this table holds\nthe own line of document {i}, which is long enough too") for i in range(50)]
    index = line_dedup.LineIndex.build(rows_of(spark, texts))
    grown = index.delete(rows_of(spark, texts[:1]))
    assert grown._layers[-1].count() == 2 and len(grown._layers) == 2 and grown._layers[0] is index._layers[0]


def test_lines_of_repeated_and_long_rows(spark):
    line = "a line of more than forty characters in all of these"
    rows = [(1, line), (1, line + "\nx"), (1, line), (1, line), (2, line), (3, line), (4, line), (None, line), (None, line)]
    out = sorted(((r["doc_id"], r["n_dropped"]) for r in line_dedup.dedup_lines(rows_of(spark, rows)).collect()), key=str)
    assert {n for _, n in out} == {0}  # four documents
    rows += [(5, "\n".join([line, "short"] * 50_000)), (6, line)]
    got = {(r["doc_id"], r["n_lines"]): r for r in line_dedup.dedup_lines(rows_of(spark, rows)).collect()}
    assert got[5, 100_000]["n_dropped"] == 50_000 and got[5, 100_000]["clean_text"] == "\n".join(["short"] * 50_000)
    assert got[1, 2]["clean_text"] == "x" and got[6, 1]["n_dropped"] == 0 and got[None, 1]["n_dropped"] == 0


def test_sharded_filters_give_the_same(spark, monkeypatch):
    texts = [(i, "\n".join(f"shared line number {i % 7 + k} that is surely long enough" for k in range(3))) for i in range(60)]
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    index = line_dedup.LineIndex.build(rows_of(spark, texts))
    assert index.n_shards > 1
    out = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["clean_text"]) for r in index.clean(rows_of(spark, texts)).collect()}
    assert out == line_truth(texts)


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    f = line_dedup.CuckooFilter(len(keys))
    f.insert(keys)
    f = line_dedup.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(keys).all()
    assert f.contains(rng.integers(0, 2**63, 50_000, dtype=np.uint64)).mean() < 0.001
    f.delete(keys[:10_000])
    assert f.contains(keys[10_000:]).all() and f.contains(keys[:10_000]).mean() < 0.01
    small = line_dedup.CuckooFilter(1)
    small.insert(keys[:500])
    assert small.contains(keys[:500]).all()


def near_truth(texts, width, num, den):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k in range(len(texts)):
        least[find(k)] = min(least.get(find(k), texts[k][0]), texts[k][0])
    return {texts[k][0]: (len(sets[k]), least[find(k)]) for k in range(len(texts))}


def near_texts(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts, n = [], 0
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(3, 120))
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append((n, " ".join(own).upper() if rng.random() < 0.1 else " \n".join(own)))
            n += 1
    return texts + [(n, None), (n + 1, ""), (n + 2, " \t"), (n + 3, "w1 w2"), (n + 4, "W1  w2"), (n + 5, "w1"), (n + 6, "w5 " * 30_000)]


@pytest.mark.parametrize("chunk", [2048, 3])
def test_near_duplicates_match_brute_force(spark, chunk):
    texts = near_texts()
    p = near_dedup.SketchParams(width=3, threshold=(85, 100), chunk_rows=chunk)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(rows_of(spark, texts), p).collect()}
    assert out == near_truth(texts, 3, 85, 100)


def test_near_duplicates_edges(spark):
    assert near_dedup.near_duplicates(rows_of(spark, [])).count() == 0
    docs = rows_of(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (3, None)])
    out = sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect())
    assert out == [(-1, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and kept.count() == 4


def test_one_row_of_near_copies_stays(spark):
    text = "one two three four five six seven eight nine ten " * 9
    near = [" ".join(f"w{i}" for i in range(40)) + end for end in ("", " x", " y")]
    docs = rows_of(spark, [(None, near[0]), (None, near[1]), (7, near[2]), (7, "quite another text of the same number"), (3, text), (3, text + "end"), (None, "a b c d e f"), (None, "g h i j k l"), (2, None), (None, " ")])
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], (r["text"] or "")[:20]) for r in kept.collect()), key=str)
    assert got == sorted([(7, near[2][:20]), (7, "quite another text o"), (3, text[:20]), (None, "a b c d e f"), (None, "g h i j k l"), (2, ""), (None, " ")], key=str)
    assert near_dedup.keep_one(docs.limit(0)).count() == 0


def test_stages_leave_one_row_of_repeats(spark, sf_dir):
    import corpus_pipeline

    docs = rows_of(spark, [(i, f"text number {i % 3} of this table") for i in (1, 2, 3, 3, 3)] + [(None, "text without a number")] * 4)
    for _, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, sf_dir)
    assert sorted(r["text"] for r in docs.collect()) == ["text number 0 of this table", "text number 1 of this table", "text number 2 of this table", "text without a number"]


@pytest.mark.parametrize("rows, bands", [(6, 40), (8, 65)])
def test_bands_find_pairs_at_the_threshold(rows, bands):
    """Of pairs of similarity 0.8 nearly all meet in a band and pass the joint likelihood, with the defaults and with longer rows."""
    p = near_dedup.SketchParams(rows=rows, bands=bands)
    assert (rows, bands) != (6, 40) or p == near_dedup.SketchParams()
    reach, found, rng = near_dedup.ReachTest(p), 0, np.random.default_rng(rows)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        a, b = near_dedup.set_sketch(np.sort(pool[:900]), p), near_dedup.set_sketch(np.sort(pool[100:]), p)
        met = (a == b).reshape(bands, rows).all(1).any()
        found += bool(met and reach(a, 900, b[None, :], np.array([900]))[0])
    assert found >= 299


def test_sketches_merge_and_estimate():
    p = near_dedup.SketchParams(rows=8, bands=64)
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    a, b = pool[:2000], pool[600:2600]
    sa, sb = near_dedup.set_sketch(a, p), near_dedup.set_sketch(b, p)
    assert (np.maximum(sa, sb) == near_dedup.set_sketch(np.union1d(a, b), p)).all()
    above, below = (sb < sa).sum(), (sb > sa).sum()
    grid = np.linspace(0, 1, 201)
    best = grid[near_dedup.log_likelihood(above, below, p.size - above - below, 2000.0, 2000.0, grid, p.base).argmax()]
    assert abs(best - 1400 / 2600) < 0.08


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 51), (52, 51), (60, 60), (51, 50)]
    out = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert out == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50, 52: 50}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).agg(F.count("*")).first()[0] == 0
