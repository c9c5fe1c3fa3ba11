"""Cheapest repair of conversations, ties by the least audit, through prefix-doubling path ranking.

A repair is a path in a graph of layers, one for each row, with four states of the pattern ``(s?(ua)+)?``: nothing yet,
after s, after u, after a. Arcs keep, rerole, delete a row or insert a turn. Conversations are cut into segments of
``SEGMENT`` rows in order. A segment's least costs from each state to each are a 4 x 4 matrix; these few numbers are
carried backwards through each conversation, so that every segment knows the cost from its end on. Then segments are
worked on by themselves, many at once: costs of all nodes layer by layer; the arcs on cheapest paths; and the path
with the least letters. Nodes are ranked by the first letter of their optimal arcs (no two arcs of a node share one);
ranks by 2, 4, 8, ... letters come from the ranks of a node and of the node its pointer reaches, and pointers double with
them until all end; then every node takes its arc of least rank and the path of each entry state is read. The entry states are
carried forwards, and audit and digest are taken on the way. Both ways stream: one conversation may be any share
of the table, a task holds one segment of it and its audit.

Defined results: a null in conv_id or turn is one space in the draw, a null role or text is one space; a null conv_id is
a conversation; rows go by (turn, null first; role; text); a role without characters adds no initial; conversations
without rows left get zeros, an empty audit and the digest of nothing; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import ordered_rank
from .common import materialize

SEGMENT, FAR = 128, 1 << 40
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # fixed values: costs; the last one for undeleted truncated rows
BLANK, REPEATED, CUT_OFF = 1, 2, 3
LETTERS = np.frombuffer(b"DIKR", np.uint8)
NEXT = np.array([2, 2, 3, 2])  # the state after an inserted or reroled turn, by state
ROLES = {2: "user", 3: "assistant"}
#: state after a kept row, by initial ('', s, u, a, other) and state; 4 is no state
KEPT = np.array([[0, 1, 2, 3], [1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
INITIALS = {"": 0, "s": 1, "u": 2, "a": 3}
BLANKS = r"[\x20\x09-\x0D]"
KEY = ["none", "conv"]


def damaged(conversations: DataFrame) -> DataFrame:
    """(none, conv, turn, role, text): the rows after damage; ``none`` marks the null conv_id."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
                                F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), draw.alias("draw"))
    rows = rows.where("draw != 0").withColumn("copy", F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(*KEY, "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def marked(rows: DataFrame) -> DataFrame:
    """Rows with ``rank`` in order and ``fault`` (0 for none)."""
    ranked = ordered_rank(rows, [*KEY, "turn", "role", "text"])
    said = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    ranked = ranked.withColumn("said", said)
    first = ranked.groupBy(*KEY, "said").agg(F.min("rank").alias("first"))
    fault = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("rank") > F.col("first"), REPEATED)
             .when(~F.col("text").rlike(r"[.!?]" + BLANKS + r"*\z"), CUT_OFF).otherwise(0))
    return ranked.join(first, [*KEY, "said"]).withColumn("fault", fault).drop("said", "first")


def segmented(rows: DataFrame) -> DataFrame:
    """(none, conv, segment, roles, texts, faults) of at most SEGMENT rows in order."""
    items = F.array_sort(F.collect_list(F.struct("rank", "role", "text", "fault")))
    cut = rows.groupBy(*KEY, F.floor(F.col("rank") / SEGMENT).alias("segment")).agg(items.alias("items"))
    return cut.select(*KEY, "segment", F.col("items.role").alias("roles"), F.col("items.text").alias("texts"), F.col("items.fault").alias("faults"))


class Layers:
    """The graph of several segments, padded to the longest: kinds of rows by (segment, layer)."""

    def __init__(self, roles: list, faults: list) -> None:
        self.size = np.array([len(f) for f in faults])
        self.initial = np.full((len(faults), self.size.max(initial=0)), 4)
        self.fault = np.zeros(self.initial.shape, int)
        for i, (r, f) in enumerate(zip(roles, faults, strict=True)):
            self.initial[i, :len(f)] = [INITIALS.get(x[:1], 4) for x in r]
            self.fault[i, :len(f)] = f

    def arcs(self, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """Cost and state of the arcs D, K, R from (segment, state) to the next layer; FAR where there is none."""
        fault, n = self.fault[:, layer], len(self.size)
        extra = np.where((fault == BLANK) | (fault == REPEATED), FAR, np.where(fault == CUT_OFF, TRUNCATED, 0))[:, None]
        kept = KEPT[self.initial[:, layer]]
        state = np.stack([np.broadcast_to(np.arange(4), (n, 4)), np.where(kept == 4, 0, kept), np.broadcast_to(NEXT, (n, 4))], 2)
        cost = np.stack([np.full((n, 4), DELETE), np.where(kept == 4, FAR, KEEP + extra), np.broadcast_to(REROLE + extra, (n, 4))], 2)
        return cost, state

    def matrices(self) -> np.ndarray:
        """(segment, from, to): least cost from each state before the first row to each state after the last one, the last row's inserts left to what follows."""
        dist = np.full((len(self.size), 4, 4), FAR)
        dist[:, np.arange(4), np.arange(4)] = 0
        for layer in range(self.initial.shape[1]):
            on = self.size > layer
            now = dist.copy()
            for _ in range(3):
                for s in range(4):
                    now[:, :, NEXT[s]] = np.minimum(now[:, :, NEXT[s]], now[:, :, s] + INSERT)
            cost, state = self.arcs(layer)
            after = np.full_like(now, FAR)
            for s in range(4):
                for arc in range(3):
                    for to in range(4):
                        here = state[:, s, arc] == to
                        after[here, :, to] = np.minimum(after[here, :, to], now[here, :, s] + cost[here, s, arc, None])
            dist[on] = np.minimum(after[on], FAR)
        return dist

    def least_paths(self, ahead: np.ndarray, last: np.ndarray) -> tuple[list[list[bytes]], np.ndarray]:
        """Audit of the least cheapest path from each (segment, entry state), and its exit state; ``ahead``: cost from each exit state on."""
        n, layers = len(self.size), self.initial.shape[1] + 1
        node = np.arange(n * layers * 4).reshape(n, layers, 4)
        letters, targets = np.zeros((*node.shape, 4), int), np.repeat(node[..., None], 4, 3)  # of the optimal arcs; 0 where there is none
        cost = np.full((n, 4), FAR)
        for layer in range(layers - 1, -1, -1):
            ends, inside = self.size == layer, self.size > layer
            below = cost
            choice, target = np.full((n, 4, 4), FAR), np.zeros((n, 4, 4), int)  # arcs D, I, K, R
            if layer < layers - 1:
                by, state = self.arcs(layer)
                for place, arc in ((0, 0), (2, 1), (3, 2)):
                    choice[:, :, place] = by[:, :, arc] + np.take_along_axis(below, state[:, :, arc], 1)
                    target[:, :, place] = np.take_along_axis(node[:, layer + 1], state[:, :, arc], 1)
            cost = np.where(ends[:, None], ahead, np.where(inside[:, None], choice.min(2), FAR))
            inserts = (inside | ends & last)[:, None]
            for _ in range(3):
                cost = np.where(inserts, np.minimum(cost, cost[:, NEXT] + INSERT), cost)
            choice[:, :, 1] = np.where(inserts, cost[:, NEXT] + INSERT, FAR)
            target[:, :, 1] = node[:, layer][:, NEXT]
            choice = np.where((ends[:, None] & (cost == ahead))[:, :, None], FAR, choice)  # nothing is cheaper than to stop
            optimal = (choice == cost[:, :, None]) & (cost < FAR)[:, :, None]
            letters[:, layer] = optimal * np.arange(1, 5)
            targets[:, layer] = np.where(optimal, target, node[:, layer][:, :, None])
        return self.read(letters.reshape(-1, 4), targets.reshape(-1, 4), node[:, 0].ravel())

    @staticmethod
    def read(letters: np.ndarray, targets: np.ndarray, starts: np.ndarray) -> tuple[list[list[bytes]], np.ndarray]:
        """Audits of the least paths from ``starts`` and the states they end in, four starts to a segment.

        Nodes are ranked by audits of 1, 2, 4, ... letters while pointers double, until all have ended; then each node
        takes the arc with the least (letter, rank of what follows), and paths are read through pointers doubled again.
        """
        here, top = np.arange(len(letters)), np.iinfo(np.int64).max
        key = np.where(letters > 0, letters, top)
        rank = np.where(letters.any(1), key.min(1), 0)
        pointer = np.where(letters.any(1), targets[here, key.argmin(1)], here)
        while (pointer[pointer] != pointer).any():
            rank = np.unique(rank * (rank.max(initial=0) + 1) + rank[pointer], return_inverse=True)[1]
            pointer = pointer[pointer]
        arc = np.where(letters > 0, letters * (len(letters) + 1) + rank[targets], top).argmin(1)
        letter, pointer, path = letters[here, arc], targets[here, arc], starts[:, None]
        while (pointer[path[:, -1]] != path[:, -1]).any():
            path = np.concatenate([path, pointer[path]], 1)  # pointers reach as far as the path is long
            pointer = pointer[pointer]
        audits = [LETTERS[p[p > 0] - 1].tobytes() for p in letter[path]]
        return [audits[i:i + 4] for i in range(0, len(audits), 4)], (path[:, -1] % 4).reshape(-1, 4)


def applied(audit: bytes, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """The ``role:text`` lines that an audit makes of a segment's rows, entered in ``state``."""
    out, row = [], 0
    for letter in audit.decode():
        if letter == "I":
            state = int(NEXT[state])
            out.append(ROLES[state] + ":")
            continue
        if letter == "K":
            state = int(KEPT[INITIALS.get(roles[row][:1], 4), state])
            out.append(f"{roles[row]}:{texts[row]}")
        elif letter == "R":
            state = int(NEXT[state])
            out.append(f"{ROLES[state]}:{texts[row]}")
        row += 1
    return out


def batches(frames: Iterator[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    for f in frames:
        for at in range(0, len(f), rows):
            yield f.iloc[at:at + rows]


def costs_ahead(segments: DataFrame) -> DataFrame:
    """(none, conv, segment, ahead, here, last): least costs from the states at each segment's end, and from those at its start, to the end of the conversation."""
    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames):
            yield f[[*KEY, "segment"]].assign(costs=list(Layers(list(f["roles"]), list(f["faults"])).matrices().reshape(len(f), 16)))

    def backwards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, cost = None, None
        for f in frames:
            ahead, here, last = [], [], []
            for none, conv, costs in zip(f["none"].tolist(), f["conv"].tolist(), f["costs"], strict=True):
                last.append((none, conv) != where)
                if last[-1]:
                    where, cost = (none, conv), np.array([0, FAR, FAR, 0])
                ahead.append(cost)
                end = cost
                if last[-1]:  # turns may be inserted after the last row; before others the next segment does it
                    for _ in range(3):
                        end = np.minimum(end, end[NEXT] + INSERT)
                cost = np.minimum((np.asarray(costs).reshape(4, 4) + end).min(1), FAR)
                for _ in range(3):
                    cost = np.minimum(cost, cost[NEXT] + INSERT)
                here.append(cost)
            yield f[[*KEY, "segment"]].assign(ahead=ahead, here=here, last=last)

    key = "none boolean, conv long, segment long"
    costs = segments.select(*KEY, "segment", "roles", "faults").mapInPandas(matrices, f"{key}, costs array<long>")
    return (costs.repartition(*KEY).sortWithinPartitions(*KEY, F.desc("segment"))
            .mapInPandas(backwards, f"{key}, ahead array<long>, here array<long>, last boolean"))


def repaired(segments: DataFrame) -> DataFrame:
    """(none, conv, cost, audit, illegal, repaired_sha256) of every conversation with rows."""
    def paths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames):
            layers = Layers(list(f["roles"]), list(f["faults"]))
            audits, exits = layers.least_paths(np.stack(f["ahead"].to_list()), f["last"].to_numpy())
            yield f[[*KEY, "segment", "here", "roles", "texts"]].assign(audits=audits, exits=list(exits))

    def forwards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, state, cost, audit, digest, lines, illegal, before = None, 0, 0, [], None, 0, 0, None
        for f in frames:
            out = []
            for none, conv, here, roles, texts, audits, exits in zip(f["none"].tolist(), f["conv"].tolist(), f["here"], f["roles"], f["texts"], f["audits"], f["exits"], strict=True):
                if (none, conv) != where:
                    if where is not None:
                        out.append((*where, cost, "".join(audit), illegal, digest.hexdigest()))
                    where, state, cost, audit, digest, lines, illegal, before = (none, conv), 0, int(here[0]), [], hashlib.sha256(), 0, 0, None
                for line in applied(audits[state], state, roles, texts):
                    digest.update((b"\n" if lines else b"") + line.encode())
                    lines += 1
                for r in roles:
                    illegal += before is not None and before + r[:1] not in ("su", "ua", "au")
                    before = r[:1]
                audit.append(audits[state].decode())
                state = int(exits[state])
            yield pd.DataFrame(out, columns=[*KEY, "cost", "audit", "illegal", "repaired_sha256"])
        if where is not None:
            yield pd.DataFrame([(*where, cost, "".join(audit), illegal, digest.hexdigest())], columns=[*KEY, "cost", "audit", "illegal", "repaired_sha256"])

    known = segments.join(materialize(costs_ahead(segments), "ahead"), [*KEY, "segment"])
    found = known.mapInPandas(paths, "none boolean, conv long, segment long, here array<long>, roles array<string>, texts array<string>, audits array<binary>, exits array<long>")
    return (found.repartition(*KEY).sortWithinPartitions(*KEY, "segment")
            .mapInPandas(forwards, "none boolean, conv long, cost long, audit string, illegal long, repaired_sha256 string"))


def repairs(conversations: DataFrame) -> DataFrame:
    """One row per original conv_id: its faults and its cheapest repair; see the module."""
    rows = marked(damaged(conversations))
    segments = materialize(segmented(rows), "segments")
    count: list[Column] = [F.count_if(F.col("fault") == k).alias(c) for k, c in ((BLANK, "blank"), (REPEATED, "duplicate"), (CUT_OFF, "truncated"))]
    faults = rows.groupBy(*KEY).agg(*count)
    turns = rows.where("turn is not null").groupBy(*KEY, "turn").agg(F.lit(1).alias("one")).groupBy(*KEY).agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    every = conversations.select(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv")).distinct()
    out = every.join(faults, KEY, "left").join(turns, KEY, "left").join(repaired(segments), KEY, "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
