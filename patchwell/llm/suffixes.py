"""Exact substring deduplication: buckets of text places refined by the identifiers of later offsets.

Every string of ``LENGTH`` bytes holds at least one *anchor*, the leftmost place with the least q-gram name among its
q-grams; equal strings have equal anchors at equal depth. So only anchors are sorted, and a string is told by (anchor,
depth): it begins ``depth`` bytes before it.

The names of q-grams are made as bucket pointers are: eight bytes name themselves, and a name of twice the length comes
from the name at a place and the name at the later offset where that one ends. Places with the same q-gram are one
bucket. A bucket is refined with longer names around its anchors: the *core* is what all strings of a range of depths
share, the *hull* is all they cover. Places with equal hulls repeat at every depth of the range and are one place from
then on; buckets with one hull are done; the others are cut into narrower ranges, whose buckets are the cores, and so on
(ranges of 337, 48, 7 and 1 depths). Every step works with the names and the buckets that the step before left.

Buckets of at most ``crowd`` different places are refined inside tasks, many at once; larger ones are refined by Spark
aggregates over (core, hull), so a passage in a third of all documents is never one group. Both ways are exact up to
equal 64-bit names. Texts move to the requests for the surroundings of anchors, and once more to be cut.

Defined results: a null text counts as empty; texts shorter than ``LENGTH`` lose nothing; repeated rows and texts are
copies of each other (all of both goes, from ``LENGTH`` bytes on); a null id is carried; an empty table gives an empty
result; other columns are not read. Texts are cut at bytes, so what is kept need not be valid UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LENGTH, GRAM, NAMED = 400, 64, 256  # bytes of a match, of a q-gram, and of the names that longer ones are made of
DEPTHS = LENGTH - GRAM + 1
STEPS = {DEPTHS: 48, 48: 7, 7: 1}  # width of a range -> width of the ranges it is cut into
PIECE, PLACE = 1 << 19, (1 << 20) - 1  # window starts worked on at once; bits that hold a place
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def named(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """The name of two names in a row."""
    h = (first * A) ^ ((later << np.uint64(31)) | (later >> np.uint64(33)))
    h *= B
    h ^= h >> np.uint64(29)
    h *= A
    return h ^ (h >> np.uint64(32))


def names(data: np.ndarray, longest: int = NAMED) -> dict[int, np.ndarray]:
    """Names of all strings of 8, 16, ... bytes along the last axis."""
    n, size = data.shape[-1], 8
    shape, strides = (*data.shape[:-1], max(0, n - 7)), data.strides
    out = {8: np.lib.stride_tricks.as_strided(data, (*shape, 8), (*strides, strides[-1])).copy().view(np.uint64)[..., 0] * A}
    while size < longest and out[size].shape[-1] > size:
        out[2 * size] = named(out[size][..., :-size], out[size][..., size:])
        size *= 2
    return out


def around(ids: np.ndarray, row, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The name of [start, end), NAMED to 3 x NAMED bytes, by the names at its start, middle and end."""
    at = lambda p: ids[p] if row is None else ids[row, p]
    return named(named(named(at(start), at((start + end - NAMED) // 2)), at(end - NAMED)), salt.astype(np.uint64))


def least_of_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, q-gram name, name of all around) of each anchor of a text of at least LENGTH bytes."""
    data, found = np.frombuffer(text, np.uint8), []
    n, before = len(data), -1
    for c in range(0, n - LENGTH + 1, PIECE):  # windows that begin in [c, c + PIECE), with all around their anchors
        low = max(0, c - DEPTHS)
        ids = names(data[low:c + PIECE + 2 * LENGTH])
        grams = ids[GRAM][c - low:c - low + min(PIECE, n - LENGTH + 1 - c) + DEPTHS - 1]
        least = least_of_windows((grams & np.uint64(~PLACE & (1 << 64) - 1)) | np.arange(len(grams), dtype=np.uint64), DEPTHS)
        at = (least[np.r_[True, least[1:] != least[:-1]]] & np.uint64(PLACE)).astype(np.int64) + c
        at = at[at > before]
        if len(at):
            before = at[-1]
            start, end = np.maximum(at - DEPTHS + 1, 0), np.minimum(at + LENGTH, n)
            found.append((at, ids[GRAM][at - low], around(ids[NAMED], None, start - low, end - low, (at - start) * 1024 + end - at)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def anchor_rows(texts: DataFrame) -> DataFrame:
    """(k1, k2, pos, gram, hull, low, high): the anchors of each text and the depths of their strings inside the text."""
    def frame(found: list) -> pd.DataFrame:
        k1, k2, size, count = (np.array(x) for x in zip(*((k1, k2, n, len(at)) for k1, k2, n, (at, _, _) in found), strict=True))
        at, gram, hull = (np.concatenate(x) for x in zip(*(x[3] for x in found), strict=True))
        return pd.DataFrame({"k1": k1.repeat(count), "k2": k2.repeat(count), "pos": at, "gram": gram.view(np.int64), "hull": hull.view(np.int64),
                             "low": np.maximum(0, LENGTH - (size.repeat(count) - at)), "high": np.minimum(DEPTHS - 1, at)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, n = [], 0
        for f in frames:
            for k1, k2, text in zip(f["k1"], f["k2"], f["text"], strict=True):
                raw = text.encode()
                found.append((k1, k2, len(raw), anchors(raw)))
                n += len(found[-1][3][0])
                if n >= 20_000:
                    yield frame(found)
                    found, n = [], 0
        if found:
            yield frame(found)

    return texts.mapInPandas(run, "k1 long, k2 int, pos long, gram long, hull long, low int, high int")


class Surroundings:
    """Bytes around many anchors, cut so that the anchor is at ``DEPTHS - 1``, with the depths that each may have."""

    def __init__(self, cuts: list[bytes], low: np.ndarray, high: np.ndarray) -> None:
        self.data = np.zeros((len(cuts), DEPTHS - 1 + LENGTH), np.uint8)
        self.low, self.high = low, high
        for i, (c, h) in enumerate(zip(cuts, high, strict=True)):
            at = DEPTHS - 1 - h
            self.data[i, at:at + len(c)] = np.frombuffer(c, np.uint8)
        self.ids = names(self.data)[NAMED]

    def core_and_hull(self, rows: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Names of what the strings of depths ``first`` to ``last`` share and cover; all ``rows`` have one of them at least."""
        at, width = DEPTHS - 1, len(rows)
        salt = np.full(width, first * 1024 + last)
        core = around(self.ids, rows, np.full(width, at - first), np.full(width, at + LENGTH - last), salt)
        low, high = np.maximum(self.low[rows], first), np.minimum(self.high[rows], last)
        return core, around(self.ids, rows, at - high, at + LENGTH - low, salt * 2048 ** 2 + (low * 2048 + high))


def bucket_ids(*parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense numbers of equal tuples, and how many there are of each."""
    order = np.lexsort(parts)
    new = np.zeros(len(order), bool)
    for p in parts:
        s = p[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out, np.bincount(out)


def refine(around_: Surroundings, rows: np.ndarray, bucket: np.ndarray, first: int, width: int, verdict: np.ndarray) -> None:
    """Refine buckets of places for the depths from ``first`` on, down to single depths; ``verdict`` gets least and largest repeated depth."""
    step = STEPS[width]
    for a in range(first, min(first + width, DEPTHS), step):
        b = min(a + step, DEPTHS) - 1
        inside = (around_.low[rows] <= b) & (around_.high[rows] >= a)
        part, held = rows[inside], bucket[inside]
        if len(part) < 2:
            continue
        core, hull = around_.core_and_hull(part, a, b)
        kind, count = bucket_ids(hull, core, held)
        again = count[kind] > 1
        np.minimum.at(verdict[:, 0], part[again], np.maximum(around_.low[part[again]], a))
        np.maximum.at(verdict[:, 1], part[again], np.minimum(around_.high[part[again]], b))
        if step > 1:
            _, one = np.unique(kind, return_index=True)
            inner, size = bucket_ids(core[one], held[one])
            going = size[inner] > 1
            if going.any():
                refine(around_, part[one][going], inner[going], a, step, verdict)


def refined_in_tasks(places: DataFrame, batch: int = 4096) -> DataFrame:
    """(k1, k2, pos, low, high): repeated depths of places in small buckets (``bucket, first, width, k1, k2, pos, low, high, cut``)."""
    def solve(f: pd.DataFrame) -> pd.DataFrame:
        verdict = np.tile(np.array([DEPTHS, -1]), (len(f), 1))
        around_ = Surroundings(list(f["cut"]), f["low"].to_numpy(np.int64), f["high"].to_numpy(np.int64))
        for (first, width), part in f.groupby(["first", "width"]).indices.items():
            refine(around_, part, f["bucket"].to_numpy()[part], int(first), int(width), verdict)
        out = f[["k1", "k2", "pos"]].assign(low=verdict[:, 0].astype("int32"), high=verdict[:, 1].astype("int32"))
        return out[out["high"] >= 0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for f in frames:
            held = f if held is None else pd.concat([held, f], ignore_index=True)
            if len(held) >= batch:  # the last bucket may go on in the next frame
                whole = int((held["bucket"] != held["bucket"].iloc[-1]).to_numpy().nonzero()[0].max(initial=-1)) + 1
                for part in pieces(held.iloc[:whole].reset_index(drop=True)):
                    yield solve(part)
                held = held.iloc[whole:].reset_index(drop=True)
        if held is not None:
            for part in pieces(held):
                yield solve(part)

    def pieces(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Whole buckets, about ``batch`` rows at a time."""
        ends = np.flatnonzero(np.r_[f["bucket"].to_numpy()[1:] != f["bucket"].to_numpy()[:-1], True]) + 1 if len(f) else np.zeros(0, int)
        at = 0
        for i, e in enumerate(ends):
            if e - at >= batch or i == len(ends) - 1:
                yield f.iloc[at:e].reset_index(drop=True)
                at = e

    tasks = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return places.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInPandas(run, "k1 long, k2 int, pos long, low int, high int")


def cut_into_ranges(places: DataFrame) -> DataFrame:
    """The places of large buckets once for each narrower range, with the names of its core and hull."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 2048):
                f = whole.iloc[at:at + 2048].reset_index(drop=True)
                around_ = Surroundings(list(f["cut"]), f["low"].to_numpy(np.int64), f["high"].to_numpy(np.int64))
                for (first, width), part in f.groupby(["first", "width"]).indices.items():
                    step = STEPS[int(width)]
                    for a in range(int(first), min(int(first + width), DEPTHS), step):
                        b = min(a + step, DEPTHS) - 1
                        rows = part[(around_.low[part] <= b) & (around_.high[part] >= a)]
                        if len(rows):
                            core, hull = around_.core_and_hull(rows, a, b)
                            core = named(core, f["bucket"].to_numpy()[rows].view(np.uint64))
                            yield f.iloc[rows].assign(bucket=core.view(np.int64), hull=hull.view(np.int64), first=a, width=step)

    return places.mapInPandas(run, "bucket long, hull long, first int, width int, k1 long, k2 int, pos long, low int, high int, cut binary")


def met(rows: DataFrame, counted: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``counted``, which has in ``count`` how many of the rows have a key.

    Keys of more than a thousandth of the rows, less than a thousand of them, meet by broadcast, so the rows of none gather in one task.
    """
    often = F.col(count) > rows.count() // 1000
    hot = counted.where(often)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(counted.where(~often), on, how)
    return rows.join(F.broadcast(hot), on, how).unionByName(rest)


def repeated_depths(texts: DataFrame, crowd: int = 4096) -> DataFrame:
    """(k1, k2, pos, low, high): least and largest depth at which the string around an anchor repeats, where any does.

    ``texts`` has (k1, k2, text), one row for each document; k1 and k2 are the text's names.
    """
    rows = materialize(anchor_rows(texts.where(F.octet_length("text") >= LENGTH)), "anchors")
    shared = materialize(rows.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    live = materialize(met(rows, shared, ["gram"], "n", "left_semi").select(F.col("gram").alias("bucket"), "hull", F.lit(0).alias("first"), F.lit(DEPTHS).alias("width"),
                                                                            "k1", "k2", "pos", "low", "high"), "buckets")
    found, place = [], ["k1", "k2", "pos", "low", "high"]
    cuts = None
    while True:
        classes = live.groupBy("bucket", "hull").agg(F.count("*").alias("n"), F.first(F.struct("first", "width", *place, *(["cut"] if cuts else []))).alias("p"))
        classes = materialize(classes, "classes")
        again = met(live, classes.where("n > 1").select("bucket", "hull", "n"), ["bucket", "hull"], "n", "left_semi")
        found.append(again.select("k1", "k2", "pos", F.greatest("low", "first").alias("low"), F.least("high", F.col("first") + F.col("width") - 1).alias("high")))
        sizes = materialize(classes.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        going = met(classes, sizes, ["bucket"], "size").select("bucket", "size", "p.*").where("width > 1")
        if cuts is None:
            cuts = True
            going = going.join(surroundings(texts, going), ["k1", "k2", "pos"])
        going = materialize(going, "places")
        found.append(refined_in_tasks(going.where(F.col("size") <= crowd).drop("size")))
        large = going.where(F.col("size") > crowd).drop("size")
        if large.isEmpty():
            break
        live = materialize(cut_into_ranges(large), "ranges")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("k1", "k2", "pos").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def surroundings(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k1, k2, pos, cut): the bytes from ``high`` before an anchor to LENGTH after it, as far as the text goes; one text of each name."""
    asked = materialize(wanted.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("pos", "high"))).alias("asked")), "asked")

    def frame(found: list) -> pd.DataFrame:
        k1, k2, pos, cuts = zip(*found, strict=True)
        count = [len(p) for p in pos]
        return pd.DataFrame({"k1": np.repeat(k1, count), "k2": np.repeat(k2, count), "pos": np.concatenate(pos), "cut": [c for cut in cuts for c in cut]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, n = [], 0
        for f in frames:
            for k1, k2, text, pos, high in zip(f["k1"], f["k2"], f["text"], f["pos"], f["high"], strict=True):
                raw = text.encode()
                found.append((k1, k2, pos, [raw[p - h:p + LENGTH] for p, h in zip(pos.tolist(), high.tolist(), strict=True)]))
                n += len(pos)
                if n >= 10_000:
                    yield frame(found)
                    found, n = [], 0
        if found:
            yield frame(found)

    cut = texts.join(asked, ["k1", "k2"]).select("k1", "k2", "text", "asked.pos", "asked.high").mapInPandas(run, "k1 long, k2 int, pos long, cut binary")
    return cut.groupBy("k1", "k2", "pos").agg(F.first("cut").alias("cut"))


def removed_spans(pos: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs covered by the strings around anchors."""
    order = np.argsort(pos - high, kind="stable")
    start, reach = (pos - high)[order], np.maximum.accumulate((pos - low + LENGTH)[order])
    new = np.r_[True, start[1:] > reach[:-1]]
    return start[new], reach[np.r_[new[1:], True]]


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = 4096) -> DataFrame:
    """(id, n_bytes, starts, ends, kept): the removed byte ranges of each whole text and the bytes that stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias(id_col), text.alias("text"), F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"))
    cover = repeated_depths(texts.select("k1", "k2", "text"), crowd).groupBy("k1", "k2").agg(F.collect_list(F.struct("pos", "low", "high")).alias("places"))

    def cut(text: str, pos, low, high) -> tuple:
        raw = text.encode()
        if pos is None:
            return len(raw), [], [], raw
        starts, ends = removed_spans(pos, low, high)
        kept = b"".join(raw[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(raw)], strict=True))
        return len(raw), starts, ends, kept

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 500):
                part = f.iloc[at:at + 500]
                size, starts, ends, kept = zip(*map(cut, part["text"], part["pos"], part["low"], part["high"]), strict=True)
                yield pd.DataFrame({id_col: part[id_col].astype("Int64").to_numpy(dtype=object, na_value=None), "n_bytes": size, "starts": starts, "ends": ends, "kept": kept})

    joined = texts.join(materialize(cover, "cover"), ["k1", "k2"], "left").select(id_col, "text", *[F.col(f"places.{c}").alias(c) for c in ("pos", "low", "high")])
    return joined.mapInPandas(run, f"{id_col} long, n_bytes long, starts array<long>, ends array<long>, kept binary")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of ``deduplicated``."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(id_col, "n_bytes", (total("ends") - total("starts")).alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
