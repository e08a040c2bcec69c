"""The prefix trie of conversations: turn arrays sorted over the whole cluster, swept with a stack, stitched.

A turn becomes a fixed-width key (128 bits of SHA-256 over its role and text), a conversation the concatenation of
its turns' keys, so that byte order is the order of turn arrays and a prefix stands before what it begins. One range
sort brings equal prefixes together. Each task sweeps its range: the longest common prefix (LCP) of neighbours says
which nodes of the open stack end there, and a node that ends adds its sums to its parent. Nodes on the path of a
range's first or last conversation may go on in other ranges: they leave as fragments with the sums of their
complete children. The fragments, a path or two for each range and so as many as ranges times the length of
conversations, are swept once more in order by one task, which joins equal paths and completes them. A node knows
its parent by (range, number), which spreads the children of a node over the ranges that hold them.

Only keys, sizes and conv_ids are shuffled, no text. A conversation is one row of 24 bytes a turn, so one of some
tens of millions of turns is the longest that fits. A hash over ascending conv_ids is sequential by nature: where
copies of a conversation fill several ranges, their conv_ids pass the stitching task as chunks of text, streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm._common import cut, map_arrow

KEY = 16
HEADS = 9
FAMILY = 5
CHUNK = 1 << 20
FLUSH = 20_000
#: part and lid name a node within its range, plid its parent there; side 0 is the path of a range's first
#: conversation, 1 that of its last below what the two share; open: the path is still the current one at the end.
SWEPT = "fragment boolean, part long, lid long, plid long, depth long, side int, open boolean, chunk long, key binary, size long, n long, least long, children long, leaves long, saved long, ends binary"


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, keys (of all turns, concatenated) and sizes (UTF-8 bytes of each text) of every rebuilt conversation.

    Turns are ordered by turn, null first, ties by their keys; a null role or text is empty. Conversation c is the
    first h turns of c - c % FAMILY and then its own after its first h, with h = crc32(c) % HEADS. Rows without a
    conv_id belong to no conversation. The remainder of a negative conv_id is negative, as in SQL.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    conv = F.col("conv_id").cast("long")
    key = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    turns = conversations.where("conv_id IS NOT NULL").select(conv.alias("conv_id"), F.struct("turn", key.alias("key"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    # one shuffle by family serves the grouping by conversation and the window over the family
    dealt = turns.withColumn("base", F.expr(f"conv_id - conv_id % {FAMILY}")).repartition("base")
    own = dealt.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = F.max(F.when(F.col("base") == F.col("conv_id"), F.slice("turns", 1, HEADS - 1))).over(Window.partitionBy("base"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    both = own.select("conv_id", "turns", F.coalesce(head, F.slice("turns", 1, 0)).alias("head"), h.alias("h"))
    joined = both.select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))
    return joined.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("keys"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


class _Node:
    """An open node with the sums over its complete children; refs: the (range, number) of each of its fragments."""

    __slots__ = ("depth", "key", "size", "refs", "parent", "n", "least", "children", "leaves", "saved", "ends", "side", "open")

    def __init__(self, depth: int, key: bytes, size: int, ref: tuple, parent: tuple | None, side: int = -1):
        self.depth, self.key, self.size, self.refs, self.parent, self.side = depth, key, size, [ref], parent, side
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: list = []
        self.open = False

    def add(self, n: int, least: int | None, children: int, leaves: int, saved: int) -> None:
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def end(self) -> None:
        """Complete the sums: every child is complete."""
        self.leaves = self.leaves if self.children else 1
        self.saved += (self.n - 1) * self.size


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_SWEPT_ARROW = pa.schema([("fragment", pa.bool_()), *((c, pa.int64()) for c in ("part", "lid", "plid", "depth")), ("side", pa.int32()), ("open", pa.bool_()), ("chunk", pa.int64()), ("key", pa.binary()), *((c, pa.int64()) for c in ("size", "n", "least", "children", "leaves", "saved")), ("ends", pa.binary())])


def _common(a: bytes, b: bytes) -> int:
    """LCP of two turn arrays, in turns."""
    if a == b:
        return len(a) // KEY
    most, low = min(len(a), len(b)) // KEY, 0
    while low < most and a[low * KEY : low * KEY + KEY] == b[low * KEY : low * KEY + KEY]:
        low += 1
    return low


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Complete nodes and fragments of one range of sorted conversations (keys, sizes, conv_id)."""
    part = TaskContext.get().partitionId()
    stack: list[_Node] = []
    firsts: list[_Node] = []
    made, out = 0, []
    last: bytes | None = None

    def open_path(keys: bytes, sizes: list, side: int) -> None:
        nonlocal made
        for depth in range(len(stack), len(keys) // KEY + 1):
            parent = stack[-1].refs[0] if stack else None
            key, size = (keys[(depth - 1) * KEY : depth * KEY], sizes[depth - 1]) if depth else (b"", 0)
            stack.append(_Node(depth, key, size, (part, made), parent, side))
            made += 1
            if side == 0:
                firsts.append(stack[-1])

    def close() -> None:
        node = stack.pop()
        if node.side == 0:
            return
        node.end()
        stack[-1].add(node.n, node.least, 1, node.leaves, node.saved)
        ends = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest().encode()
        out.append((False, part, node.refs[0][1], node.parent[1], node.depth, None, None, 0, None, None, node.n, node.least, node.children, node.leaves, node.saved, ends))

    for batch in batches:
        for keys, sizes, conv_id in zip(*(c.to_pylist() for c in batch.columns)):
            if last is None:
                open_path(keys, sizes, 0)
            else:
                shared = _common(last, keys)
                while stack[-1].depth > shared:
                    close()
                open_path(keys, sizes, -1)
            stack[-1].ends.append(conv_id)
            stack[-1].add(1, conv_id, 0, 0, 0)
            last = keys
        if len(out) >= FLUSH:
            yield _batch(out, _SWEPT_ARROW)
            out.clear()
    for node in stack:
        node.open = True
    for node in [*firsts, *(x for x in stack if x.side != 0)]:
        text = ",".join(map(str, node.ends)).encode()
        for chunk in range(max(1, -(-len(text) // CHUNK))):
            sums = (node.n, node.least, node.children, node.leaves, node.saved) if chunk == 0 else (0, None, 0, 0, 0)
            out.append((True, part, node.refs[0][1], node.parent[1] if node.parent else None, node.depth, max(0, -node.side), node.open, chunk, node.key, node.size, *sums, text[chunk * CHUNK : (chunk + 1) * CHUNK]))
    for at in range(0, len(out), FLUSH):
        yield _batch(out[at : at + FLUSH], _SWEPT_ARROW)


STITCHED = "node boolean, part long, lid long, ppart long, plid long, depth long, n long, least long, children long, leaves long, saved long, ends binary"
_STITCHED_ARROW = pa.schema([("node", pa.bool_()), *((c, pa.int64()) for c in ("part", "lid", "ppart", "plid", "depth", "n", "least", "children", "leaves", "saved")), ("ends", pa.binary())])


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments in the order of ranges, sides, depths and chunks: joined to whole nodes, and every fragment's smallest member."""
    stack: list[_Node] = []
    hashes: list = []
    out: list[tuple] = []
    part, side, matching = None, 0, False

    def close() -> None:
        node, digest = stack.pop(), hashes.pop()
        node.end()
        if stack:
            stack[-1].add(node.n, node.least, 1, node.leaves, node.saved)
        first = node.refs[0]
        out.append((True, *first, *(node.parent or (None, None)), node.depth, node.n, node.least, node.children, node.leaves, node.saved, digest.hexdigest().encode()))
        out.extend((False, *ref, None, None, None, None, node.least, None, None, None, None) for ref in node.refs[1:])

    def settle() -> None:
        """What the range's first path has left, and what its last path no longer holds, ends here."""
        while stack and not stack[-1].open:
            close()

    for batch in batches:
        for row in batch.to_pylist():
            depth, chunk = row["depth"], row["chunk"]
            if row["part"] != part:
                settle()
                part, side, matching = row["part"], 0, True
            elif row["side"] != side:
                settle()
                side, matching = row["side"], False
            ref = (part, row["lid"])
            if chunk == 0:
                if matching and depth < len(stack) and stack[depth].key == row["key"]:
                    stack[depth].refs.append(ref)
                else:
                    while len(stack) > depth:
                        close()
                    matching = False
                    stack.append(_Node(depth, row["key"], row["size"], ref, stack[-1].refs[0] if stack else None))
                    hashes.append(hashlib.sha256())
            node = stack[depth]
            node.open = row["open"]
            if row["ends"]:
                if node.ends and chunk == 0:
                    hashes[depth].update(b",")
                hashes[depth].update(row["ends"])
                node.ends = [True]
            node.add(row["n"], row["least"], row["children"], row["leaves"], row["saved"])
        if len(out) >= FLUSH:
            yield _batch(out, _STITCHED_ARROW)
            out.clear()
    while stack:
        close()
    for at in range(0, len(out), FLUSH):
        yield _batch(out[at : at + FLUSH], _STITCHED_ARROW)


def prefix_trie(arrays: DataFrame) -> DataFrame:
    """One row for each node of the trie of `arrays` (conv_id, keys, sizes), as rebuilt() gives them.

    conv_id (smallest member), depth, parent_conv_id (the parent's; null for the root), n_convs (members),
    n_children, n_leaves (childless nodes below or at it), saved_tokens (over its subtree, each node's bytes times
    its members less one) and ends_sha256 (of the conv_ids of members that end there, ascending). A conversation
    without turns ends at the root. No conversations, no nodes.
    """
    ordered = arrays.select("keys", "sizes", "conv_id").repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    swept = cut(map_arrow(ordered, _sweep, SWEPT))
    fragments = swept.where("fragment").drop("fragment").repartition(1).sortWithinPartitions("part", "side", "depth", "chunk")
    stitched = cut(map_arrow(fragments, _stitch, STITCHED))
    sums = ["depth", "n", "least", "children", "leaves", "saved", "ends"]
    inner = swept.where("NOT fragment").select("part", "lid", F.col("part").alias("ppart"), "plid", *sums)
    nodes = inner.unionByName(stitched.where("node").select("part", "lid", "ppart", "plid", *sums))
    named = inner.select("part", "lid", "least").unionByName(stitched.select("part", "lid", "least"))
    parents = named.select(F.col("part").alias("ppart"), F.col("lid").alias("plid"), F.col("least").alias("parent_conv_id"))
    return nodes.join(parents, ["ppart", "plid"], "left").select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ends").cast("string").alias("ends_sha256")
    )
