"""The thin queries over the driver's tables, one for each operator, and what SQL can say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm._common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op2_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import ann

    return ann.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tickloom.llm import token_store

    return token_store.store_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import line_dedup

    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("clean_text", 256).alias("kept_sha256"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import near_dedup

    params = near_dedup.SketchParams(width=3, threshold=(85, 100))
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), params)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import html_text

    pages = html_text.extract_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import mixing

    mixed = mixing.mix_counts(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op8_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import exact_dedup

    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import language_id

    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tickloom.llm import bpe

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import prefix_trie

    return prefix_trie.prefix_trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tickloom.llm import vector_codes

    return vector_codes.code_vectors(table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tickloom.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_quality_rules, op2_projected_neighbours, op3_token_store, op4_line_dedup, op5_near_duplicates, op6_html_text, op7_mixing, op8_exact_duplicates, op9_language_spans, op10_bpe_transducer, op11_prefix_trie, op12_vector_codes, op13_packing, pipeline)
}

_LINE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
freq AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE last_doc IS NOT NULL AND last_doc <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE last_doc IS NULL OR last_doc = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN freq USING (k) GROUP BY doc_id
"""

_COPIES_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

# crc32 of the decimal digits, bit by bit; turns as hexadecimal digests, so that a node is a prefix of 64 letters a turn
_TRIE_SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))),
    4294967295::BIGINT) % 9 AS h
  FROM ids),
turns AS (
  SELECT conv_id, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
         octet_length(encode(coalesce(text, ''))) AS size,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
built AS (
  SELECT c.conv_id, t.k, t.size, t.pos FROM crc c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.k, t.size, t.pos FROM crc c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
placed AS (
  SELECT conv_id, k, size, row_number() OVER w AS depth, string_agg(k, '') OVER w AS path
  FROM built WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
paths AS (
  SELECT conv_id, depth, path, size FROM placed UNION ALL SELECT conv_id, 0, '', 0 FROM ids),
last AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
nodes AS (
  SELECT p.depth, p.path, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(p.size) AS size,
         sha256(coalesce(string_agg(CASE WHEN l.depth = p.depth THEN p.conv_id::VARCHAR END, ',' ORDER BY p.conv_id), '')) AS ends_sha256
  FROM paths p JOIN last l USING (conv_id) GROUP BY p.depth, p.path),
kids AS (SELECT depth - 1 AS depth, left(path, (64 * (depth - 1))::BIGINT) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path),
above AS (
  SELECT left(path, (64 * d)::BIGINT) AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
  FROM (SELECT *, unnest(generate_series(0, depth)) AS d FROM whole) GROUP BY ALL)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, a.n_leaves::BIGINT AS n_leaves,
       a.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM whole w JOIN above a USING (path) LEFT JOIN whole p ON p.depth = w.depth - 1 AND p.path = left(w.path, (64 * (w.depth - 1))::BIGINT)
"""


def _codes_sql(rounds: int = 6) -> str:
    """The rounds written out one after the other."""
    books = """
book0 AS (
  SELECT part, pos, e - 1 AS entry, x AS v FROM comps JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS e FROM kept) USING (vec_id) WHERE e <= 16)"""
    nearest = """
near{r} AS MATERIALIZED (
  SELECT vec_id, part, min(d) AS d, arg_min(entry, (d, entry)) AS entry FROM (
    SELECT c.vec_id, c.part, b.entry, sum((c.x - b.v) * (c.x - b.v))::BIGINT AS d
    FROM comps c JOIN book{r} b USING (part, pos) GROUP BY ALL) GROUP BY ALL)"""
    moved = """
book{n} AS MATERIALIZED (
  SELECT b.part, b.pos, b.entry, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN (
    SELECT c.part, c.pos, n.entry, CASE WHEN sum(c.x) >= 0 THEN sum(c.x) // count(*) ELSE -((-sum(c.x) + count(*) - 1) // count(*)) END::BIGINT AS v
    FROM comps c JOIN near{r} n USING (vec_id, part) GROUP BY ALL) m USING (part, pos, entry))"""
    steps = [books]
    for r in range(rounds):
        steps += [nearest.format(r=r), moved.format(r=r, n=r + 1)]
    steps.append(nearest.format(r=rounds))
    return (
        """
WITH kept AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comps AS MATERIALIZED (
  SELECT vec_id, (i - 1) * 8 // len(embedding) AS part, i - 1 AS pos, floor(4096 * embedding[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT *, unnest(generate_series(1, len(embedding))) AS i FROM kept)),"""
        + ",".join(steps)
        + f""",
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""
    )


ORACLES = {"op4_line_dedup": _LINE_SQL, "op8_exact_duplicates": _COPIES_SQL, "op11_prefix_trie": _TRIE_SQL, "op12_vector_codes": _codes_sql()}
