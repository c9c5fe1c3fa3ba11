"""Sharding by histogram sort: counted splitters, then one exchange.

Rows are ordered by (hash of the text, id, place in the table), so equal texts lie side by side. The splitters that cut
this order into parts of equal bytes are found by counting: each round takes the exact bytes below some candidate keys,
all partitions at once, and narrows the interval of every splitter that is not yet within the tolerance. Only counts of
candidates reach the driver. A text whose copies outgrow the tolerance is cut by id, the second part of the key, and
copies with one id, or none, by the third. The rows are written once with their keys, so the place is one for all rounds.

Defined results: a null text has size 8, sorts like an empty one; a null id sorts first; rows with equal text and
equal id are cut like any others, which of them goes where is not fixed; an empty table gives an empty result; further
columns are carried along, and one named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LOW, HIGH = -(2 ** 63), 2 ** 63 - 1
Key = tuple[int, int, int]
PARTS = ["_h", "_i", "_t"]


@dataclass
class Splitter:
    """The first key of a part lies in (low, high]; bytes and rows below both ends are known."""

    target: int
    slack: int
    low: Key
    high: Key
    below_low: tuple[int, int]
    below_high: tuple[int, int]
    key: Key | None = None
    rows: int = 0
    stuck: bool = False  # no key between the ends

    def settle(self) -> None:
        ends = ((abs(self.below_low[0] - self.target), self.low, self.below_low), (abs(self.below_high[0] - self.target), self.high, self.below_high))
        gap, key, below = min(ends)
        if gap <= self.slack or self.stuck:
            self.key, self.rows = key, below[1]

    def candidates(self, n: int, ends: list[Key]) -> list[Key]:
        """Between the ends, evenly: over the first part of the key that is still open, in the range that the table has of it."""
        for at, rest in ((0, (LOW, LOW)), (1, (LOW,)), (2, ())):
            head, a, b = self.low[:at], self.low[at], self.high[at] if self.high[:at] == self.low[:at] else HIGH
            a, b = max(a, ends[0][at] - 1, LOW), min(b, ends[1][at] + 1, HIGH)
            found = {(*head, v, *rest) for v in {a + (b - a) * i // (n + 1) for i in range(1, n + 2)}}
            if found := [k for k in found if self.low < k < self.high]:
                return found
        return []


def place(parts: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """How many of the sorted ``keys`` (rows of key parts) are at or below each row."""
    heads = np.ascontiguousarray(keys[:, 0])
    out = np.searchsorted(heads, parts[0], "right")
    if keys.shape[1] > 1:
        for head in np.unique(heads[(keys[:, 1:] > LOW).any(1)]):  # values that are cut by the later parts
            at = np.flatnonzero(parts[0] == head)
            if len(at):
                out[at] = np.searchsorted(heads, head, "left") + place([p[at] for p in parts[1:]], keys[heads == head][:, 1:])
    return out


def bytes_below(keyed: DataFrame, keys: list[Key]) -> dict[Key, tuple[int, int]]:
    """Exact (bytes, rows) below each key."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, rows, sorted_keys = np.zeros(len(keys) + 1, np.int64), np.zeros(len(keys) + 1, np.int64), np.array(keys, np.int64)
        for f in frames:
            at = place([f[c].to_numpy() for c in PARTS], sorted_keys)
            np.add.at(size, at, f["_size"].to_numpy())
            rows += np.bincount(at, minlength=len(keys) + 1)
        used = np.flatnonzero(rows)
        yield pd.DataFrame({"at": used, "bytes": size[used], "rows": rows[used]})

    got = {r["at"]: (r["bytes"], r["rows"]) for r in keyed.mapInPandas(count, "at long, bytes long, rows long").groupBy("at").agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()}
    out, size, rows = {}, 0, 0
    for i, k in enumerate(keys):
        size, rows = size + got.get(i, (0, 0))[0], rows + got.get(i, (0, 0))[1]
        out[k] = (size, rows)
    return out


def find_splitters(keyed: DataFrame, targets: list[tuple[int, int]], total: tuple[int, int], ends: list[Key], probes: int = 16_384) -> list[Splitter]:
    """``targets``: (bytes, allowed deviation) of each splitter; ``ends``: least and largest value of each key part. ``probes`` bounds the candidates of a round."""
    found = [Splitter(t, s, (LOW,) * 3, (HIGH,) * 3, (0, 0), total) for t, s in targets]
    while open_ := [s for s in found if s.key is None]:
        each = max(2, min(64, probes // len(open_)))
        wanted = [s.candidates(each, ends) for s in open_]
        for s, w in zip(open_, wanted, strict=True):
            s.stuck = not w
        keys = sorted({k for w in wanted for k in w})
        if keys:
            below = bytes_below(keyed, keys)
            order = list(below)
            sizes = np.array([below[k][0] for k in order])
            for s in open_:
                at = int(np.searchsorted(sizes, s.target, "right"))
                if at > 0 and order[at - 1] > s.low:
                    s.low, s.below_low = order[at - 1], below[order[at - 1]]
                if at < len(order) and order[at] < s.high:
                    s.high, s.below_high = order[at], below[order[at]]
        for s in open_:
            s.settle()
    return found


def histogram_shards(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.005,
                     part_bytes: int = 32 << 20, max_parts: int = 8192) -> DataFrame:
    """``df`` with size, shard and slot: shards of near equal bytes, slots gapless from 0 in key order.

    ``tolerance`` is the allowed error of a shard's end as a share of one shard. A shard is sorted in parts of about
    ``part_bytes`` (as long as there are at most ``max_parts``), so it never has to fit one task; the counts below
    the splitters give each part its first slot.
    """
    df = df.drop("size", "shard", "slot", *PARTS, "_size", "_part")
    keys = {"_h": F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), "_i": F.coalesce(F.col(id_col).cast("long"), F.lit(LOW)),
            "_size": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8}
    df = materialize(df.withColumns({**keys, "_t": F.monotonically_increasing_id()}), "rows")
    keyed = df.select(*PARTS, "_size")
    total = keyed.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count("*"), *[f(c) for c in PARTS for f in (F.min, F.max)]).first()
    size, rows, ends = int(total[0]), int(total[1]), [tuple(total[2::2]), tuple(total[3::2])]
    fine = max(1, min(-(-size // (shards * part_bytes)), max_parts // shards))
    parts = shards * fine
    slack = [int(size / shards * tolerance) if j % fine == 0 else size // parts // 4 for j in range(parts)]
    found = find_splitters(keyed, [(size * j // parts, slack[j]) for j in range(1, parts)], (size, rows), ends) if rows else []
    cuts = sorted((s.key, s.rows) for s in found)
    bounds, first = np.array([k for k, _ in cuts], np.int64).reshape(-1, 3), [0, *(r for _, r in cuts)]

    @F.pandas_udf("int")
    def part(h: pd.Series, i: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(place([x.to_numpy() for x in (h, i, t)], bounds).astype("int32"))

    start = F.element_at(F.array(*[F.lit(int(first[p] - first[p - p % fine])).cast("long") for p in range(len(first))]), F.col("_part") + 1)
    within = Window.partitionBy("_part").orderBy(*PARTS)
    return (df.withColumn("_part", part(*PARTS))
            .withColumn("slot", start + F.row_number().over(within) - 1)
            .withColumn("shard", F.floor(F.col("_part") / fine).cast("int")).withColumnRenamed("_size", "size")
            .drop(*PARTS, "_part"))
