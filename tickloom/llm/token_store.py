"""Token ids in binary blocks: frequency-ranked, byte-aligned variable-length codes with separate control bytes.

Documents in doc_id order are cut into shards (ranges of doc_id) and blocks. A block holds the documents' ids
and lengths, a control stream with two bits a token (bytes of its code less one, four tokens to a byte) and a
data stream of the codes' bytes. Codes are ranks by frequency over the whole corpus, so frequent tokens take
one byte. Blocks and the dictionary are rows of Parquet tables written by Spark, so a lost task is written
again as a whole, and any store that Spark reaches will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm._chunks import RunEncoder
from tickloom.llm._common import cleaned, cut, map_arrow, released, scratch_dir

BLOCK_IDS = 1 << 18
_LENGTHS = (1 + ((np.arange(256)[:, None] >> (2 * np.arange(4)[None, :])) & 3)).astype(np.uint8)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_codes(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit codes."""
    codes = np.ascontiguousarray(codes, "<u4")
    extra = (codes > 0xFF).astype(np.uint8) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = codes.view(np.uint8).reshape(-1, 4)[np.arange(4)[None, :] <= extra[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_codes(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n codes: a table gives the four lengths of each control byte, their running sum the places."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    if n and ends[-1] != len(data):
        raise ValueError("control and data bytes disagree")
    source = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = ends - lengths
    out = source[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        if len(more):
            out[more] |= source[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_made: dict[bytes, object] = {}


def text_encoder(definition: bytes, pattern: str):
    """Encode one text by the tokenizers library, kept between a worker's tasks."""
    key = zlib.crc32(definition).to_bytes(4, "little") + pattern.encode()
    if key not in _made:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(definition.decode())
        letters = _byte_letters()
        model = tokenizer.model
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

        def piece(text: str) -> list[int]:
            return [t.id for t in model.tokenize(text.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))]

        runs = RunEncoder(pattern, piece)

        def encode(text: str) -> bytes:
            if any(s in text for s in special):  # the library's own handling of added tokens
                return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            return runs.encode(text)

        _made[key] = encode
    return _made[key]


def _token_blocks(docs: DataFrame, definition: bytes, pattern: str, end_id: int, block_ids: int) -> DataFrame:
    """Shards and blocks of raw ids, in doc_id order: shard, block, start (in the shard), doc_ids, lengths, ids."""
    held = docs.sparkSession.sparkContext.broadcast(definition)
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(held.value, pattern)
        shard = TaskContext.get().partitionId()
        block, start = 0, 0
        doc_ids: list = []
        parts: list[bytes] = []
        size = 0

        def flush():
            lengths = np.array([len(p) // 4 for p in parts], "<u4")
            ids = np.frombuffer(b"".join(parts), "<u4")
            narrow = ids.astype("<u2") if len(ids) == 0 or ids.max() < 65536 else ids
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([block], pa.int64()), pa.array([start], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths.tobytes()], pa.binary()), pa.array([narrow.itemsize], pa.int32()), pa.array([narrow.tobytes()], pa.binary())], names=["shard", "block", "start", "doc_ids", "lengths", "width", "ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts.append(encode(text or "") + tail)
                doc_ids.append(doc_id)
                size += len(parts[-1]) // 4
                if size >= block_ids:
                    yield flush()
                    block, start = block + 1, start + size
                    doc_ids, parts, size = [], [], 0
        if doc_ids:
            yield flush()

    text = F.coalesce("text", F.lit(""))
    # rows that share a doc_id, and even their text, are dealt to several ranges
    order = ["doc_id", F.xxhash64("text"), "turn"]
    ordered = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.monotonically_increasing_id().alias("turn")).repartitionByRange(*order).sortWithinPartitions(*order)
    return map_arrow(ordered.drop("turn"), run, "shard long, block long, start long, doc_ids array<long>, lengths binary, width int, ids binary")


def _count_ids(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for width, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.bincount(np.frombuffer(ids, f"<u{width}"))
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return map_arrow(blocks.select("width", "ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_store(docs: DataFrame, path: str, tokenizer_path: str, pattern: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode every row of `docs` and write path/blocks and path/dictionary.

    Whole texts, null as empty: such a document is the end id alone. Order is by doc_id (null first), then by
    a hash of the text where rows repeat a doc_id. Columns other than doc_id and text aren't read. The
    dictionary has at most one row for each id of the vocabulary, so it may be sent to every task.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        definition = f.read()
    raw = cut(_token_blocks(docs, definition, pattern, end_id, block_ids), "zstd")
    counts = _count_ids(raw).orderBy(F.col("n").desc(), "id").collect()
    order = np.array([r["id"] for r in counts], np.int64)
    spark.createDataFrame([(i, int(v)) for i, v in enumerate(order)], "rank long, id long").coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")
    table = np.zeros(int(order.max()) + 1 if len(order) else 1, "<u4")
    table[order] = np.arange(len(order), dtype="<u4")
    ranks = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            control, data = [], []
            for width, ids in zip(batch.column("width").to_pylist(), batch.column("ids").to_pylist()):
                c, d = encode_codes(ranks.value[np.frombuffer(ids, f"<u{width}")])
                control.append(c)
                data.append(d)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("shard", "block", "start", "doc_ids", "lengths")), pa.array(control, pa.binary()), pa.array(data, pa.binary())], names=["shard", "block", "start", "doc_ids", "lengths", "control", "data"])

    with cleaned(spark):
        map_arrow(raw, run, "shard long, block long, start long, doc_ids array<long>, lengths binary, control binary, data binary").write.mode("overwrite").parquet(f"{path}/blocks")


def read_store(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (or ids_crc32, if only a digest is wanted) of each document of a store.

    `start` counts the ids of all documents before it: the shards' totals, one number for each, give every
    shard its first place, and blocks know theirs within the shard.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(np.frombuffer(x, "<u4").sum()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["shard", "n"])

    per = map_arrow(blocks.select("shard", "lengths"), totals, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()
    bases, base = {}, 0
    for r in per:
        bases[r["shard"]] = base
        base += r["n"]
    order = spark.read.parquet(f"{path}/dictionary").orderBy("rank").collect()
    held = spark.sparkContext.broadcast((bases, np.array([r["id"] for r in order], "<u4")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, ids_of = held.value
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                ids = ids_of[decode_codes(row["control"], row["data"], int(lengths.sum()))]
                ends = np.cumsum(lengths)
                first = bases[row["shard"]] + row["start"]
                cuts = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), lengths.tolist())]
                last = pa.array([zlib.crc32(c) for c in cuts], pa.int64()) if digest else pa.array(cuts, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(first + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return map_arrow(blocks, run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def store_and_read(docs: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """Write a store in the shared folder and give its documents' places and digests, from the files."""
    path = scratch_dir(docs.sparkSession)
    write_store(docs, path, tokenizer_path, pattern)
    return read_store(docs.sparkSession, path, digest=True)
