import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import ann, html_text, language_id, mixing, quality
from tickloom.llm._common import table


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.4)).astype(float)
    model = quality.fit_rules(x, y)
    assert ((model.predict(x) > 0.5) == (y > 0.5)).mean() > 0.98
    assert 0 < len(model.rules) < 60


def test_rule_model_edges():
    n = len(quality.STATISTICS)
    assert quality.fit_rules(np.zeros((0, n)), np.zeros(0)).predict(np.zeros((1, n)))[0] == 0.5
    assert quality.fit_rules(np.zeros((9, n)), np.ones(9)).predict(np.zeros((1, n)))[0] > 0.9


def test_quality_held_out(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs, model)
    rows = scored.where("held_out").join(labels.where("quality is not null"), "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored.collect())
    # the column is the model that was fitted
    odd = docs.sparkSession.createDataFrame([(1, None, 3), (2, "", 3), (3, "A b\nc!! " * 50_000, 3)], "doc_id long, text string, score int")
    got = odd.select("doc_id", model.score(F.col("text")).alias("s"), quality.text_statistics(F.col("text")).alias("x")).collect()
    for r in got:
        assert r["s"] == pytest.approx(model.predict(np.array([[r["x"][k] for k in quality.STATISTICS]]))[0])
    assert quality.score_quality(odd.limit(0), model).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_of_repeated_rows(spark, sf_dir):
    """Repeated rows are scored each; a null doc_id is never held out; labels that disagree don't break the fit."""
    docs = table(spark, sf_dir, "documents").limit(120)
    labels = table(spark, sf_dir, "labels")
    rows = [(r["doc_id"], r["text"], "n") for r in docs.collect()]
    odd = spark.createDataFrame(rows + rows[:30] + [(None, rows[0][1], "n"), (None, None, "n")], "doc_id long, text string, score string")
    tied = labels.unionByName(labels.withColumn("quality", 1 - F.col("quality")))
    for found in (labels.unionByName(labels), tied):
        out = quality.score_quality(odd, quality.fit_quality(odd, found)).collect()
        assert len(out) == len(rows) + 32 and all(0 <= r["score"] <= 1 for r in out)
        assert not any(r["held_out"] for r in out if r["doc_id"] is None)


def test_no_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()} == {0.5}


def vectors(seed=0, n=900, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    rows = [(i, (centres[rng.integers(12)] + 0.4 * rng.standard_normal(dim)).astype(np.float32).tolist()) for i in range(n)]
    same = rows[3][1]
    rows += [(n + i, same) for i in range(40)]
    return rows + [(5000, None), (5050, [0.0] * dim), (5100, [float("nan")] * dim), (5150, [None] * dim), (5200, [float("inf")] * dim), (5250, [1.0, 2.0])]


def test_neighbours_recall(spark):
    rows = vectors()
    params = ann.IndexParams(cell_rows=100, query_rows=7, leaf_rows=8)
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    found = {}
    for r in ann.nearest(frame, params=params).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, np.array(v, float)) for i, v in rows if i < 5000]
    ids, v = np.array([i for i, _ in good]), np.stack([x for _, x in good])
    norms = np.sqrt((v * v).sum(1))
    hits = total = 0
    assert sorted(found) == [i for i in ids.tolist() if i % 50 == 0]
    for q, got in found.items():
        at = int(np.flatnonzero(ids == q)[0])
        s = (v * v[at]).sum(1) / (norms * norms[at])
        s[at] = -9
        best = np.lexsort((ids, -np.round(s, 12)))[:5]
        got.sort()
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert all(abs(g[2] - s[np.flatnonzero(ids == g[1])[0]]) < 1e-12 for g in got)
        hits += len({g[1] for g in got} & set(ids[best].tolist()))
        total += 5
    assert hits / total >= 0.9


def test_neighbours_at_real_dimension(spark, sf_dir):
    """Recall on the tables' own vectors, every query against every row."""
    frame = table(spark, sf_dir.replace("0.001", "0.1"), "embeddings")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in frame.collect() if r["embedding"]]
    ids, v = np.array([i for i, _ in rows]), np.stack([x for _, x in rows])
    assert v.shape[1] >= 32
    norms = np.sqrt((v * v).sum(1))
    found = {}
    for r in ann.nearest(frame, params=ann.IndexParams(cell_rows=512)).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, got in found.items():
        at = int(np.flatnonzero(ids == q)[0])
        s = v @ v[at] / (norms * norms[at])
        s[at] = -9
        hits += len(got & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
    assert len(found) == (ids % 50 == 0).sum() and hits / (5 * len(found)) >= 0.9


def test_neighbours_ties_and_other_lengths(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(0, 400, 50)] + [(i, [1.0, float(i % 2), 0.0]) for i in range(1, 40)] + [(1000, [1.0, 2.0]), (1001, [2.0, 1.0]), (1050, [3.0, 4.0, 5.0, 6.0])]
    out = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 12)))
    assert out[0] == [(i, 1.0) for i in (2, 4, 6, 8, 10)] and out[350] == [(i, 1.0) for i in (0, 2, 4, 6, 8)]
    assert out[1000] == [(1001, 0.8)] and 1050 not in out


def test_neighbours_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (0, [1.0, 0.0])], schema)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(few).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]


def test_chi_square():
    assert ann.chi_square_cdf(np.array([0.0, 15.507]), 8) == pytest.approx([0, 0.95], abs=1e-4)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body>
<header><a href=/>Home</a></header><nav><ul><li>menu</ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>One <b>two<br>three&nbsp; four<p>Five<script>x="</p>"</script> six</p>
<ul><li>a<li>b</ul><aside>side</aside><form><input>send</form><div class="ad">buy</div><table><tr><td>1<td>2<tr><td>3</table>
<section id="comments"><article>reader says</article></section></article>
<div class="sidebar">s</div><footer>&copy; site</footer><!-- <p>no</p> --></body></html>"""


def test_html_main_text(spark):
    rows = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "odd", ""), (4, "http://b.example", "just <b>text</b> here"), (5, "http://b.example", "<p>" * 3000 + "deep"), (6, "http://b.example", "<div>" * 5000 + "deeper")]
    out = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()}
    assert out[1] == "Title & more\nOne two three four\nFive six\na\nb\n1 2\n3"
    assert out[2] == "" and out[3] == "" and out[4] == "just text here" and out[5] == "deep" and out[6] == "deeper"
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_site_template_goes(spark):
    body = "<div><div>Welcome to the site</div><div><p>Story {0} is long</p><p>Shared words</p></div></div>"
    rows = [(i, f"https://www.s.example/{i}", f"<html><body>{body.format(i)}</body></html>") for i in range(30)]
    rows += [(99, "https://other.example/", "<html><body><div>Welcome to the site</div></body></html>")]
    rows += [(200 + i, f"http://n.example/{i}", f"<body><article><p>Story {i}</p><p>Licence line</p></article><div>Partner links</div></body>") for i in range(20)]
    out = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3].split("\n")[0] == "Story 3 is long" and "Welcome" not in out[3]
    assert out[99] == "Welcome to the site"
    assert out[205] == "Story 5\nLicence line"


def page(i, host="m.example", ad="Buy of week {}", body="<p>Story {0} is told here at length</p><p>It ends {0} days later</p>"):
    """A page whose class names mean nothing; its advert changes between seven texts."""
    text = f'<div class="q1"><div class="zz{i}">{ad.format(i % 7)}</div></div><div class="k9">{body.format(i)}<div class="w3">Join us at {host}</div></div><div class="q2"><b>About us</b></div>'
    return f"<html><body>{text}</body></html>"


def texts_of(spark, rows, **options):
    docs = spark.createDataFrame([(i, u, h, 1, "k") for i, u, h in rows], "page_id long, url string, html string, host int, keys string")
    return {r["page_id"]: r["text"] for r in html_text.extract_text(docs, **options).collect()}


def test_templates_are_found_by_counts_alone(spark):
    rows = [(i, f"https://m.example/{i}", page(i)) for i in range(60)] + [(100 + i, f"https://other{i}.example/", page(1000 + i, f"h{i}", f"own {i}")) for i in range(3)]
    own = {i: f"Story {i} is told here at length\nIt ends {i} days later" for i in range(60)}
    out = texts_of(spark, rows)
    assert {i: out[i] for i in range(60)} == own == {i: t for i, t in texts_of(spark, rows, words=False).items() if i < 60}
    # no page has an article element, so that nothing stands outside one; counts are all that is left
    assert {i: t for i, t in texts_of(spark, rows, words=False, outside=False).items() if i < 60} == own
    off = texts_of(spark, rows, templates=False)
    assert off[8] == f"Buy of week 1\n{own[8]}\nJoin us at m.example\nAbout us"
    # a story that is posted again under other links is no template, whatever stands around it
    again = [(i, f"https://n.example/{i}", page(i, "n.example", body="<p>The same long story under every link of the site</p><p>and its end</p>")) for i in range(30)]
    found = texts_of(spark, [(500 + i, u, h) for i, u, h in again] + rows)
    assert all("The same long story under every link of the site\nand its end" in found[500 + i] for i in range(30))


def test_templates_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        host = rng.choice(["a.example"] * 5 + ["b.example", "c.example"])
        parts = [f'<div class="x{k}">{rng.choice(["Alpha", "Beta", "Gamma " + str(rng.randint(0, 40))])}</div>' for k in range(rng.randint(0, 3))]
        rows.append((i, f"http://{host}/{i}", f"<body>{''.join(parts)}<p>{' '.join(rng.choices('abcdefgh', k=30))} {i // 2}</p></body>"))
    rows += rows[:10] + [(900, None, None), (901, "http://a.example/", "")]
    read = [(u.split("/")[2] if u else "", html_text.read_page(h or "")) for _, u, h in rows]
    seen, places = {}, {}
    for host, p in read:
        for key, slot in zip(p.keys, p.slots):
            seen.setdefault((host, key), set()).add(p.context)
            places.setdefault((host, slot), {}).setdefault(key, set()).add(p.context)

    def alike(by_key):
        n = [len(x) for x in by_key.values()]
        return sum(n) >= 5 and sum(x for x in n if x > 1) >= 0.75 * sum(n)

    expected = []
    for (i, _, _), (host, p) in zip(rows, read):
        gone = set()
        for k, (key, slot, up) in enumerate(zip(p.keys, p.slots, p.parents)):
            if up in gone or p.outside[k] or p.hints[k] or len(seen[host, key]) >= 5 or not p.mains[k] and alike(places[host, slot]):
                gone.add(k)
        expected.append((i, "\n".join(t for t, o in zip(p.texts, p.owners) if o not in gone)))
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.extract_text(docs).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted(expected)
    assert any("Alpha" not in t and t for _, t in expected)


def test_a_block_of_unrelated_hosts_stays(spark):
    """A classed block that stands in articles of many hosts, once on each, is no host's template."""
    quote = '<div class="quote">All happy families are alike</div>'
    rows = [(i, f"https://h{i}.example/a", f"<body><div class='t{i}'>Story {i} of its own</div>{quote}</body>") for i in range(12)]
    rows += [(100 + i, f"https://one.example/{i}", f"<body><div class='t{i}'>Story {i} of the host</div>{quote}</body>") for i in range(12)]
    out = texts_of(spark, rows)
    assert all(out[i] == f"Story {i} of its own\nAll happy families are alike" for i in range(12))
    assert all(out[100 + i] == f"Story {i} of the host" for i in range(12))
    # nor does a page's text depend on the other hosts of the table
    assert texts_of(spark, rows[:1]) == {0: out[0]}


def test_rules_on_the_tables(spark, sf_dir):
    """Each rule by itself: hosts of these tables have four pages on average, too few to count on, and adverts that vary."""
    pages = table(spark, sf_dir.replace("0.001", "0.01"), "pages")
    run = lambda **rules: {r["page_id"]: r["text"] for r in html_text.extract_text(pages, **rules).collect()}
    text, none = run(), run(templates=False, words=False, outside=False)
    assert text == run(templates=False, words=False) == run(templates=False, outside=False)
    assert np.mean([text[i] != none[i] for i in text]) > 0.9


def test_targets_and_fit(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 9, 40, 700]))), rng.choice(["a", "b", "c", "d", None]), 4) for i in range(700)]
    rows += [(2000 + i, "one two three", "a", 4) for i in range(500)] + [(3000, None, "e", 4), (3001, "", "f", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    out = mixing.mix_counts(docs).collect()
    assert len(out) == len(rows)
    source = {i: s for i, _, s, _ in rows}
    size = {i: len((t or "").split()) for i, t, _, _ in rows}
    totals, taken, targets = {}, {}, {}
    for r in out:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and 0 <= r["copies"] <= 2
        totals[s] = totals.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["size"] * r["copies"]
        targets[s] = r["target"]
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(totals.values()), set()
    while True:
        rest = budget - sum(2 * totals[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped)
        expected = {s: 2.0 * totals[s] if s in capped else rest * weight[s] / share for s in order}
        over = {s for s in order if s not in capped and expected[s] > 2 * totals[s]}
        if not over:
            break
        capped |= over
    for s in order:
        assert targets[s] == pytest.approx(expected[s]) and abs(taken[s] - expected[s]) <= 2
    again = mixing.mix_counts(docs.repartition(3)).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)
    assert mixing.mix_counts(docs.limit(0)).count() == 0
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)


def test_mix_takes_each_row_by_its_own_copies(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, None, 1, 2, i]), " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(0, 30))), rng.choice(["a", "b", "c", None])) for i in range(600)]
    rows += [(None, "equal rows without a number", "a")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = mixing.mix_counts(docs).collect()
    assert len(counts) == len(rows) and {r["copies"] for r in counts} > {0}
    taken, mixed = {}, {}
    for r in counts:
        taken[r["target"]] = taken.get(r["target"], 0) + r["copies"] * r["size"]
    out = mixing.mix_documents(docs).collect()
    assert len(out) == sum(r["copies"] for r in counts)
    total = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("a", "b", "c", None)}
    for r in out:
        mixed[r["source"]] = mixed.get(r["source"], 0) + len(r["text"].split())
    assert sorted(mixed.values()) == sorted(n for n in taken.values() if n)
    targets = {r["source_size"]: r["target"] for r in counts}
    assert all(abs(mixed[s] - targets[total[s]]) <= 2 for s in total)


def test_mix_edges(spark):
    rows = [(1, "word " * 300_000, "a"), (1, "word " * 300_000, "a"), (2, "x", "a"), (2, "x", "a"), (3, None, None), (None, "", "b")] + [(10 + i, "one two", "b") for i in range(50)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    out = mixing.mix_counts(docs).collect()
    assert len(out) == len(rows) and all(0 <= r["copies"] <= 2 for r in out)
    assert mixing.mix_documents(docs).count() == sum(r["copies"] for r in out)


def test_fit_counts_is_near():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 5000, 60))
        counts = rng.integers(1, 400, len(lengths))
        budget = int(rng.integers(1, (lengths * counts).sum()))
        take = mixing.fit_counts(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        assert abs(int((lengths * take).sum()) - budget) <= lengths.min()
    assert mixing.fit_counts(np.array([10]), np.array([1]), 4).tolist() == [0]
    assert mixing.fit_counts(np.array([10]), np.array([1]), 6).tolist() == [1]


def test_language_held_out(spark, sf_dir):
    docs = table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = language_id.identify(docs).collect()
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)


def test_language_spans(spark):
    train = [(i, t, lang, 1) for i, (t, lang) in enumerate([("the cat sat on the mat with this thing", "en"), ("der hund und die katze sind nicht hier", "de"), ("кошка и собака не здесь", "ru")] * 40)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string, score int")
    model = language_id.fit_languages(docs)
    assert model.languages == ["de", "en", "ru"]
    asked = spark.createDataFrame([(1, "the cat sat on the mat " * 3 + "und die katze sind nicht hier " * 2), (2, "собака"), (3, None), (4, "12 !"), (5, ""), (6, "кошка " * 40_000)], "doc_id long, text string")
    out = {r["doc_id"]: r for r in language_id.label_documents(asked, model).collect()}
    assert [s["lang"] for s in out[1]["spans"]] == ["en", "de"] and out[1]["lang_pred"] == "en" and 0.5 < out[1]["score"] < 0.8
    assert out[2]["lang_pred"] == "ru" and out[6]["lang_pred"] == "ru"
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (3, 4, 5))
    none = language_id.identify(docs.limit(0))
    assert none.count() == 0
    bare = language_id.label_documents(asked, language_id.LanguageModel([]))
    assert {r["lang_pred"] for r in bare.collect()} == {"und"}


def test_language_repeated_rows_and_ties(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("aaa bbb", "xx"), ("ccc ddd", "yy")] * 30)]
    docs = spark.createDataFrame(train + train[:20] + [(None, "aaa", "xx"), (900, "aaa ccc", None), (900, "aaa ccc", None)], "doc_id long, text string, lang string")
    out = language_id.identify(docs).collect()
    assert len(out) == len(train) + 23 and all(r["score"] <= 1 for r in out)
    assert {r["lang_pred"] for r in out if r["doc_id"] == 900} == {"xx"}  # even shares: the first language
    assert not next(r for r in out if r["doc_id"] is None)["held_out"]


def test_language_takes_the_smallest_hashes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "text", "xx" if i % 10 else "yy") for i in range(3000)], "doc_id long, text string, lang string")
    h = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.lit(5), F.col("doc_id")).alias("h")).collect()}
    got = language_id.chosen_texts(docs, 100).collect()
    for lang in ("xx", "yy"):
        usable = [i for i in h if (lang == "yy") == (i % 10 == 0) and zlib.crc32(str(i).encode()) % 4 != 2]
        assert sorted(r["doc_id"] for r in got if r["lang"] == lang) == sorted(sorted(usable, key=lambda i: h[i] % 2**64)[:100])


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    lengths = np.array([4, 1, 6, 0, 6])
    scores = rng.normal(0, 2, (lengths.sum(), 3))
    starts = np.cumsum(lengths) - lengths
    labels = language_id.viterbi(scores, starts, lengths, 1.5)
    for s, n in zip(starts, lengths):
        if n:
            worth = lambda path: sum(scores[s + i, k] for i, k in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))
            best = max(worth([int(x) for x in np.unravel_index(k, (3,) * n)]) for k in range(3**n))
            assert worth(labels[s : s + n].tolist()) == pytest.approx(best)
