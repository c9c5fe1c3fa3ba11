"""The prefix trie of rebuilt conversations, by adaptive radix trees over turn ids of fixed width.

A turn's id is 20 bytes, big-endian: the MD5 of role and text, then the bytes of the text. A conversation is cut into
segments of ``SEGMENT`` turns; a segment's key is its ids in a row, and it hangs below the *name* of all turns before it
(two 64-bit hashes, XOR over the segments). Equal segments are folded with a count first, so copies cost nothing. Then
keys are dealt by range and each task grows radix trees of a bounded number of keys: nodes of 4, 16, 48 or 256 places
and compressed paths, of which only depths that end a turn become trie nodes. A node that several trees hold (only those
at the edges of a range) is put together by its name. So neither a hot first turn nor a hot conversation is one group,
and a conversation of any length is many short keys.

Sums over subtrees need no walk over levels. Every node belongs to its smallest member, whose nodes are the end of that
member's path; the sum over a subtree is the sum of all its members' own totals, less what the node's own member has
above it. Both parts are plain sums: the first one by the same trees, the second one along each member's path.

Defined results: rows with a null conv_id take no part; null role or text is empty; turns in order of (turn, null first;
role; text), repeated rows are turns of their own; an empty table gives an empty result, without a root; other columns
are not read. Prefixes are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import ordered_rank, running_totals
from .common import materialize

WIDTH, SEGMENT, SHARED, GROUP = 20, 32, 9, 5  # bytes of an id, turns of a segment, remainders of the shared turns, conversations of one base


class RadixNode:
    """A node with compressed path ``prefix``; its layout grows from 4 to 16, 48 and 256 places."""

    __slots__ = ("prefix", "sample", "value", "keys", "slots", "kids")

    def __init__(self, prefix: bytes, sample: bytes) -> None:
        self.prefix, self.sample, self.value = prefix, sample, None
        self.keys: bytearray | None = bytearray()  # sorted bytes, up to 16
        self.slots: bytearray | None = None  # byte -> place + 1, up to 48
        self.kids: list = []

    def child(self, byte: int) -> RadixNode | None:
        if self.keys is not None:
            at = self.keys.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.slots is not None:
            return self.kids[self.slots[byte] - 1] if self.slots[byte] else None
        return self.kids[byte]

    def put(self, byte: int, node: RadixNode) -> None:
        """Set the child of ``byte``, growing the layout where it is full."""
        if self.keys is not None:
            at = self.keys.find(byte)
            if at >= 0:
                self.kids[at] = node
                return
            if len(self.keys) < 16:
                at = sum(k < byte for k in self.keys)
                self.keys.insert(at, byte)
                self.kids.insert(at, node)
                return
            self.slots = bytearray(256)
            for i, k in enumerate(self.keys):
                self.slots[k] = i + 1
            self.keys = None
        if self.slots is not None:
            if self.slots[byte]:
                self.kids[self.slots[byte] - 1] = node
                return
            if len(self.kids) < 48:
                self.kids.append(node)
                self.slots[byte] = len(self.kids)
                return
            wide = [None] * 256
            for k, place in enumerate(self.slots):
                if place:
                    wide[k] = self.kids[place - 1]
            self.slots, self.kids = None, wide
        self.kids[byte] = node

    def children(self) -> list[RadixNode]:
        return [k for k in self.kids if k is not None]


class RadixTree:
    """Keys with values (sums, and a least number last), for one segment below one name."""

    def __init__(self) -> None:
        self.root = RadixNode(b"", b"")

    def insert(self, key: bytes, value: tuple[int, ...]) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                break
            below = node.child(key[at])
            if below is None:
                leaf = RadixNode(key[at + 1:], key)
                node.put(key[at], leaf)
                node = leaf
                break
            path, rest = below.prefix, key[at + 1:at + 1 + len(below.prefix)]
            if path != rest:
                same = next((i for i, (a, b) in enumerate(zip(path, rest, strict=False)) if a != b), len(rest))
                fork = RadixNode(path[:same], key)
                fork.put(path[same], below)
                below.prefix = path[same + 1:]
                node.put(key[at], fork)
                below = fork
            node, at = below, at + 1 + len(below.prefix)
        node.value = value if node.value is None else combine(node.value, value)

    def turns(self) -> Iterator[tuple[bytes, tuple[int, ...]]]:
        """(ids from the top, combined values of all keys below) for every depth that ends a turn."""
        order, stack = [], [(self.root, 0)]
        while stack:
            node, start = stack.pop()
            end = start + len(node.prefix) + (node is not self.root)
            order.append((node, start, end))
            stack += [(k, end) for k in node.children()]
        for node, start, end in reversed(order):  # children before parents
            for k in node.children():
                node.value = k.value if node.value is None else combine(node.value, k.value)
            for depth in range(start // WIDTH + 1, end // WIDTH + 1):
                yield node.sample[:depth * WIDTH], node.value


def combine(a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
    return (*(x + y for x, y in zip(a[:-1], b[:-1], strict=True)), min(a[-1], b[-1]))


def part_names(key: Column, segment: Column) -> tuple[Column, Column]:
    place = F.unhex(F.lpad(F.hex(segment), 16, "0"))
    return F.xxhash64(F.concat(key, place)), F.xxhash64(F.concat(F.unhex(F.lit("01")), key, place))


def names_of(key: bytes, segment: int, above: tuple[int, int]) -> tuple[int, int]:
    """The same names in a task, for any part of a key."""
    import xxhash

    place = segment.to_bytes(8, "big")
    return above[0] ^ xxhash.xxh64_intdigest(key + place, 42), above[1] ^ xxhash.xxh64_intdigest(b"\1" + key + place, 42)


def grow(segments: DataFrame, sums: list[str], least: str, keys_of_tree: int = 20_000) -> DataFrame:
    """(n1, n2, p1, p2, depth, bytes, *sums, least) of every node below the root; nodes at the edges of a range once for each tree."""
    def signed(v: int) -> int:
        return v - (1 << 64) if v >> 63 else v

    def emit(tree: RadixTree, above: tuple[int, int], segment: int) -> pd.DataFrame:
        rows = []
        for ids, value in tree.turns():
            parent = names_of(ids[:-WIDTH], segment, above) if len(ids) > WIDTH else above
            rows.append((*map(signed, (*names_of(ids, segment, above), *parent)), segment * SEGMENT + len(ids) // WIDTH, int.from_bytes(ids[-4:], "big"), *value))
        return pd.DataFrame(rows, columns=["n1", "n2", "p1", "p2", "depth", "bytes", *sums, least])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, where, held = RadixTree(), None, 0
        for f in frames:
            values = zip(*(f[c].tolist() for c in (*sums, least)), strict=True)
            for a, b, segment, key, value in zip(f["a1"].tolist(), f["a2"].tolist(), f["segment"].tolist(), f["key"], values, strict=True):
                here = (a % (1 << 64), b % (1 << 64), segment)
                if where is not None and (here != where or held >= keys_of_tree):
                    yield emit(tree, where[:2], where[2])
                    tree, held = RadixTree(), 0
                where, held = here, held + 1
                tree.insert(key, value)
        if where is not None:
            yield emit(tree, where[:2], where[2])

    folded = segments.groupBy("a1", "a2", "segment", "key").agg(*[F.sum(c).alias(c) for c in sums], F.min(least).alias(least))
    schema = "n1 long, n2 long, p1 long, p2 long, depth long, bytes long, " + ", ".join(f"{c} long" for c in (*sums, least))
    order = ["a1", "a2", "segment", "key"]
    parts = folded.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, schema)
    return parts.groupBy("n1", "n2").agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"),
                                         *[F.sum(c).alias(c) for c in sums], F.min(least).alias(least))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, id) of every rebuilt turn, and (conv_id) of every conversation, the turnless ones too."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    ranked = ordered_rank(rows, ["conv_id", "turn", "role", "text"]).select(
        "conv_id", "rank", F.concat(F.unhex(digest), F.unhex(F.lpad(F.hex(F.octet_length("text")), 8, "0"))).alias("id"))
    spans = ranked.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    spans = spans.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED, "base": F.col("conv_id") - F.col("conv_id") % GROUP})
    bases = spans.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    spans = materialize(spans.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))), "spans")
    placed = ranked.join(spans.select("conv_id", "first", "h", "taken"), "conv_id").withColumn("at", F.col("rank") - F.col("first"))
    own = placed.where("at >= h").select("conv_id", (F.col("taken") + F.col("at") - F.col("h")).alias("pos"), "id")
    lent = placed.where((F.col("conv_id") % GROUP == 0) & (F.col("at") < SHARED - 1)).select(F.col("conv_id").alias("base"), "at", "id")
    taken = lent.join(spans.select("base", "conv_id", "taken"), "base").where("at < taken").select("conv_id", F.col("at").alias("pos"), "id")
    return materialize(own.unionByName(taken), "rebuilt"), spans.select("conv_id")


def segmented(turns: DataFrame) -> DataFrame:
    """(conv_id, segment, key, a1, a2, e1, e2): ids of each segment, the name above it and the name at its end."""
    ids = F.array_sort(F.collect_list(F.struct("pos", F.hex("id").alias("id"))))
    cut = turns.groupBy("conv_id", F.floor(F.col("pos") / SEGMENT).alias("segment")).agg(F.unhex(F.array_join(F.transform(ids, lambda t: t["id"]), "")).alias("key"))
    own = part_names(F.col("key"), F.col("segment"))
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    named = cut.withColumns({"o1": own[0], "o2": own[1]})
    named = named.withColumns({f"a{i}": F.coalesce(F.bit_xor(f"o{i}").over(before), F.lit(0)) for i in (1, 2)})
    return named.withColumns({f"e{i}": F.col(f"a{i}").bitwiseXOR(F.col(f"o{i}")) for i in (1, 2)}).drop("o1", "o2")


def digests_of_ends(ends: DataFrame, chunk: int = 1000) -> DataFrame:
    """(n1, n2, ends_sha256): SHA-256 of the sorted ids of each node. Ids are joined in chunks in range order; the hash reads chunks."""
    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n1, n2, conv = (f[c].to_numpy() for c in ("n1", "n2", "conv_id"))
            cuts = np.flatnonzero((n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])) + 1 if len(f) else np.zeros(0, int)
            spans = [(c, min(c + chunk, b)) for a, b in zip([0, *cuts], [*cuts, len(f)], strict=True) for c in range(a, b, chunk)]
            ids = list(map(str, conv.tolist()))
            yield pd.DataFrame({"n1": n1[[a for a, _ in spans]], "n2": n2[[a for a, _ in spans]], "least": conv[[a for a, _ in spans]], "ids": [",".join(ids[a:b]) for a, b in spans]})

    def hash_(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, state, out = None, None, []
        for f in frames:
            for n1, n2, ids in zip(f["n1"].tolist(), f["n2"].tolist(), f["ids"], strict=True):
                if (n1, n2) == where:
                    state.update(b"," + ids.encode())
                    continue
                if where is not None:
                    out.append((*where, state.hexdigest()))
                where, state = (n1, n2), hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=["n1", "n2", "ends_sha256"])
            out = []
        if where is not None:
            yield pd.DataFrame([(*where, state.hexdigest())], columns=["n1", "n2", "ends_sha256"])

    order = ["n1", "n2", "conv_id"]
    chunks = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(join, "n1 long, n2 long, least long, ids string")
    return chunks.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "least").mapInPandas(hash_, "n1 long, n2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations; see the module and ``op12``'s columns."""
    turns, convs = rebuilt(conversations)
    segments = materialize(segmented(turns), "segments")
    whole = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("rep")).where("n > 0")
    root = whole.select(F.lit(0).cast("long").alias("n1"), F.lit(0).cast("long").alias("n2"), *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")],
                        *[F.lit(0).cast("long").alias(c) for c in ("depth", "bytes")], "n", "rep")
    nodes = grow(segments.select("a1", "a2", "segment", "key", F.lit(1).cast("long").alias("n"), F.col("conv_id").alias("rep")), ["n"], "rep")
    nodes = materialize(nodes.unionByName(root), "nodes")
    kids = nodes.where("p1 is not null").groupBy("p1", "p2").agg(F.count("*").alias("n_children")).withColumnsRenamed({"p1": "n1", "p2": "n2"})
    nodes = nodes.join(kids, ["n1", "n2"], "left").fillna(0, ["n_children"]).withColumn("saves", (F.col("n") - 1) * F.col("bytes"))
    nodes = materialize(running_totals(nodes, ["rep"], ["depth"], {"below": F.col("saves")}, F.floor(F.col("depth") / 64), {"below": "own"}, descending=True), "owned")
    owners = nodes.groupBy("rep").agg(F.max("own").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    carried = segments.join(owners, F.col("conv_id") == F.col("rep")).select("a1", "a2", "segment", "key", "own", "leaf", "conv_id")
    sums = grow(carried, ["own", "leaf"], "conv_id").select("n1", "n2", F.col("own").alias("all_own"), F.col("leaf").alias("n_leaves"))
    top = owners.agg(F.sum("own").alias("all_own"), F.sum("leaf").alias("n_leaves")).where("n_leaves is not null")
    sums = sums.unionByName(top.select(F.lit(0).cast("long").alias("n1"), F.lit(0).cast("long").alias("n2"), "all_own", "n_leaves"))
    last = segments.groupBy("conv_id").agg(F.max_by(F.struct("e1", "e2"), "segment").alias("e"))
    ends = convs.join(last, "conv_id", "left").select(F.coalesce("e.e1", F.lit(0)).alias("n1"), F.coalesce("e.e2", F.lit(0)).alias("n2"), "conv_id")
    parents = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("rep").alias("parent_conv_id"))
    out = nodes.join(sums, ["n1", "n2"]).join(digests_of_ends(ends), ["n1", "n2"], "left").join(parents, ["p1", "p2"], "left")
    return out.select(F.col("rep").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves",
                      (F.col("all_own") - F.col("own") + F.col("below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
