"""The trie of conversations' prefixes: which turns begin how many conversations, and what sharing them saves.

1. A turn becomes 16 bytes, the MD5 of role and text, and its number of code points; texts are not shuffled. A
   conversation's turns, in order, are one key of 16 bytes each.
2. The keys are sorted globally, by ranges of key and id, so that many equal conversations are dealt to many tasks.
3. Each task sweeps its range: a key shares its longest common prefix with the one before, deeper nodes of the stack
   are closed and those of the new key opened. A closed node hands its sums to its parent.
4. Nodes on the path of a range's first or last key may go on in the ranges beside it. A task hands on what it has
   summed for them, two paths for each range; one more sweep over these, in order, stitches the open stacks. Its input
   is ranges times depth, whatever the number of conversations, and the packed ids that end there.

A conversation is one row, so it must fit a task's memory by its turns (48 bytes each while it is gathered, without
texts). The hash of all ids that end at one node is sequential by its nature; ids are streamed into it in packed pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import limit_batches, stored

WIDTH = 16  # bytes of a turn in a key
HELD = 20_000  # children of an open node that wait for its least member
PIECE = 50_000  # ids of one packed piece
ROWS = 5_000  # of a batch handed on
EMPTY = hashlib.sha256(b"").hexdigest()
NODE, PENDING, OPEN, NAMED = range(4)  # kinds of rows: a node; one whose parent's least member isn't known; sums of an open node; an open node's least member
FIELDS = [
    ("kind", pa.int32(), "int"), ("conv_id", pa.int64(), "long"), ("depth", pa.int64(), "long"), ("parent_conv_id", pa.int64(), "long"), ("n_convs", pa.int64(), "long"), ("n_children", pa.int64(), "long"),
    ("n_leaves", pa.int64(), "long"), ("saved_tokens", pa.int64(), "long"), ("ends_sha256", pa.string(), "string"), ("prefix", pa.binary(), "binary"), ("size", pa.int64(), "long"), ("range", pa.int32(), "int"),
    ("path", pa.int32(), "int"), ("piece", pa.int32(), "int"), ("key", pa.binary(), "binary"), ("ends", pa.binary(), "binary"),
]
SCHEMA = ", ".join(f"{n} {kind}" for n, _, kind in FIELDS)


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common from their begin, by halving."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH] else (low, mid - 1)
    return low


class Node:
    __slots__ = ("children", "ends", "hash", "held", "ids", "leaves", "least", "left", "n", "named", "saved", "size")

    def __init__(self, size: int, left: bool):
        self.size, self.left = size, left  # code points of its last text; whether it may have begun before
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.named, self.held, self.ids, self.ends, self.hash = None, False, [], [], [], None

    def met(self, least: int | None, n: int) -> None:
        self.n += n
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def pack(self) -> None:
        if self.ids:
            self.ends.append(",".join(map(str, self.ids)).encode())
            self.ids = []

    def feed(self, piece: bytes) -> None:
        if self.hash is None:
            self.hash = hashlib.sha256(piece)
        else:
            self.hash.update(b"," + piece)


class Sweep:
    """Nodes of keys that come in order. State: the stack of nodes on the path of the last key."""

    def __init__(self, of_range: int | None):
        self.range, self.open_ends = of_range, of_range is not None  # a range's nodes on the first and last path stay open
        self.stack, self.key, self.first, self.rows = [], None, None, []

    def emit(self, **row) -> None:
        self.rows.append(row)

    def prefix(self, depth: int) -> bytes:
        return hashlib.md5(self.key[: depth * WIDTH]).digest()

    def enter(self, key: bytes, sizes: list[int]) -> None:
        """Closes what the key doesn't share with the last one and opens what is new."""
        shared, first = (0, True) if self.key is None else (common(self.key, key), False)
        while len(self.stack) > shared + 1:
            self.close()
        self.key = key
        if first:
            self.stack.append(Node(0, self.open_ends))
        for d in range(len(self.stack) - 1, len(key) // WIDTH):
            self.stack.append(Node(sizes[d], first and self.open_ends))

    def add(self, key: bytes, sizes: list[int], conv_id: int) -> None:
        if self.first is None:
            self.first = key
        if key != self.key:
            self.enter(key, sizes)
        top = self.stack[-1]
        top.met(conv_id, 1)
        top.ids.append(conv_id)
        if len(top.ids) >= PIECE:
            top.pack()

    def close(self) -> None:
        depth, node = len(self.stack) - 1, self.stack.pop()
        node.pack()
        if node.left:
            self.fragment(node, depth, 0)
            return
        for piece in node.ends:
            node.feed(piece)
        sha = node.hash.hexdigest() if node.hash else EMPTY
        if node.named:
            self.emit(kind=NAMED, conv_id=node.least, prefix=self.prefix(depth))
        for row in node.held:
            self.emit(kind=NODE, parent_conv_id=node.least, **row)
        leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
        own = {"conv_id": node.least, "depth": depth, "n_convs": node.n, "n_children": node.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": sha}
        if not self.stack:
            self.emit(kind=NODE, **own)
            return
        parent = self.stack[-1]
        parent.met(node.least, node.n)
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved
        parent.held.append(own)
        if len(parent.held) >= HELD:
            self.let_go(parent, depth - 1)

    def let_go(self, node: Node, depth: int) -> None:
        """The children of an open node so far, by the prefix of their parent."""
        prefix, node.named = self.prefix(depth), True
        for row in node.held:
            self.emit(kind=PENDING, prefix=prefix, **row)
        node.held = []

    def fragment(self, node: Node, depth: int, path: int) -> None:
        """What is summed for a node that may go on beside this range."""
        self.let_go(node, depth)
        at, key = {"kind": OPEN, "range": self.range, "path": path, "depth": depth, "size": node.size}, self.key if path else self.first
        self.emit(**at, piece=0, key=key if len(key) == depth * WIDTH else None, conv_id=node.least, n_convs=node.n, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved, ends=node.ends[0] if node.ends else None)
        for i, piece in enumerate(node.ends[1:], 1):
            self.emit(**at, piece=i, ends=piece)

    def finish(self) -> None:
        if not self.open_ends:
            while self.stack:
                self.close()
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            node = self.stack.pop()
            node.pack()
            self.fragment(node, depth, 0 if node.left else 1)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kind) for n, kind, _ in FIELDS], [n for n, _, _ in FIELDS])


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = Sweep(TaskContext.get().partitionId())  # ranges are numbered in their order
    for batch in batches:
        for key, sizes, conv_id in zip(batch.column("key"), batch.column("sizes"), batch.column("conv_id").to_pylist(), strict=True):
            s.add(key.as_py(), sizes.as_py(), conv_id)
            if len(s.rows) >= ROWS:
                yield s.taken()
    s.finish()
    if s.rows:
        yield s.taken()


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sweep over the open paths of all ranges: rows by range, path, depth (the deepest first) and piece."""
    s, path, new, node = Sweep(None), None, {}, None

    def opened() -> None:
        for d in sorted(new):
            s.stack.append(new[d])
        new.clear()

    for batch in batches:
        for r in batch.to_pylist():
            if path != (now := (r["range"], r["path"])):
                opened()
                path, shared = now, 0 if s.key is None else common(s.key, r["key"])
                while len(s.stack) > shared + 1:
                    s.close()
                s.key = r["key"]
            if r["piece"] == 0:
                if r["depth"] < len(s.stack):
                    node = s.stack[r["depth"]]
                else:
                    node = new[r["depth"]] = Node(r["size"], False)
                    node.named = True
                node.met(r["conv_id"], r["n_convs"])
                node.children += r["n_children"]
                node.leaves += r["n_leaves"]
                node.saved += r["saved_tokens"]
            if r["ends"] is not None:
                node.feed(r["ends"])
            if len(s.rows) >= ROWS:
                yield s.taken()
    opened()
    s.finish()
    if s.rows:
        yield s.taken()


def sequences(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = 100) -> DataFrame:
    """block, conv_id and turns (array of turn, role, digest, size, in order) of each conversation of df, dealt by block.

    A block is named by its first of `block` ids (by the remainder that SQL gives, so of negative ids by the last). Rows without conv_id are no conversation.
    """
    who, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said).cast("binary")))
    item = F.struct(F.col(turn).alias("turn"), who.alias("role"), digest.alias("digest"), F.char_length(said).alias("size"))
    rows = df.select(F.col(conv_id).cast("long").alias("conv_id"), item.alias("item")).filter("conv_id IS NOT NULL")
    rows = rows.withColumn("block", F.col("conv_id") - F.col("conv_id") % block).repartition("block")
    return rows.groupBy("block", "conv_id").agg(F.sort_array(F.collect_list("item")).alias("turns"))


def _keyed(conv_id: Column, turns: Column) -> list[Column]:
    key = F.unhex(F.array_join(F.transform(turns, lambda x: F.hex(x["digest"])), ""))
    return [conv_id.alias("conv_id"), key.alias("key"), F.transform(turns, lambda x: x["size"]).alias("sizes")]


def rebuilt(convs: DataFrame, *, most: int = 6) -> DataFrame:
    """conv_id and turns of sequences(), the first h taken from the first conversation of the block (none if it isn't there).

    h is the unsigned CRC-32 of the id's decimal digits modulo `most`.
    """
    head = F.max(F.when(F.col("conv_id") == F.col("block"), F.slice("turns", 1, most))).over(Window.partitionBy("block"))  # a row for each conversation of the block
    blocks = convs.withColumns({"h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"), "head": head})
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    turns = F.when(F.col("head").isNull(), own).otherwise(F.concat(F.slice(F.col("head"), F.lit(1), F.col("h")), own))
    return blocks.select("conv_id", turns.alias("turns"))


def trie(convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node.

    convs has conv_id (whole number, each once) and turns (see sequences). A node is a distinct sequence of a
    conversation's first turns, the root has none; conv_id is its smallest member, so its text is turn `depth` of that. Equal
    conversations are members of the same nodes. Conversations without turns end at the root. An empty table has no node.
    """
    limit_batches(convs.sparkSession)
    keyed = convs.select(*_keyed(F.col("conv_id"), F.col("turns")))
    swept = stored(keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_swept, SCHEMA), "swept")
    ranges = swept.filter(F.col("kind") == OPEN)
    stitched = stored(ranges.repartition(1).sortWithinPartitions("range", "path", F.col("depth").desc(), "piece").mapInArrow(_stitched, SCHEMA), "stitched")
    both = swept.unionByName(stitched)
    named = both.filter(F.col("kind") == NAMED).select("prefix", F.col("conv_id").alias("parent_conv_id"))
    pending = both.filter(F.col("kind") == PENDING).drop("parent_conv_id").join(named, "prefix")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return both.filter(F.col("kind") == NODE).select(*columns).unionByName(pending.select(*columns))


def conversation_trie(df: DataFrame, **columns: str) -> DataFrame:
    """The trie of the rebuilt conversations of df.

    Turns go by number, null first; turns of one number by role, then by hash of role and text. A null role or text is
    empty. Rows without conv_id belong to no conversation and are passed over. Repeated rows are turns of their own.
    An empty table has no node. Other columns of df aren't read.
    """
    return trie(rebuilt(sequences(df, **columns)))
