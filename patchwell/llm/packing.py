"""Best-fit packing: minimum bin slack over the histogram of lengths.

The lengths are at most the capacity, so their histogram is small whatever the corpus holds. Bins are planned on
it: for each bin a subset-sum table held in one integer (bit ``s`` set: sum ``s`` can be reached) finds the fullest
combination that starts with the longest length left; the combination is then taken off as often as the counts
allow. Ranks inside a length give every piece its bin and its place, in Spark, without moving texts or tokens.

Defined results: a null text counts as empty; an empty document still is its closing id alone; a repeated row is
packed once per row; an empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import materialize

class ByteBpeEncoder:
    """Ids of whole texts as the tokenizers library gives them for a byte-level BPE file.

    Where the file's merges are in the order of their ids, as in a file of ranks, Latin-1 texts without special tokens
    go through the quicker tiktoken on the same vocabulary; all others through tokenizers itself.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], {c: b for b, c in enumerate(byte_alphabet())}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        first = len(vocab) - len(pairs)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.quick = None
        if spec["normalizer"] is None and all(vocab[a + b] == first + i for i, (a, b) in enumerate(pairs)):
            ranks = {bytes(alphabet[c] for c in token): i for token, i in vocab.items()}
            self.quick = tiktoken.Encoding("of the file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        if self.quick is None or any(s in text for s in self.special):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.plain(text):
            return np.array(self.quick.encode_ordinary(text), "<u4").tobytes()
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def cut_tokens(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text",
               keep_ids: bool = False, batch: int = 256) -> DataFrame:
    """Pieces of at most ``capacity`` ids: (id, piece, start, length, ids_crc32[, ids]). Only the first may be shorter."""
    schema = f"{id_col} long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = ByteBpeEncoder(tokenizer)
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at:at + batch]
                rows = []
                for key, ids in zip(part[id_col], part["text"], strict=True):
                    ids = encoder.encode(ids or "") + end
                    first = (len(ids) - 1) % width + 1
                    cuts = [0, *range(first, len(ids), width), len(ids)]
                    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append((key, n, a // 4, (b - a) // 4, zlib.crc32(ids[a:b])) + ((ids[a:b],) if keep_ids else ()))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
                out[id_col] = out[id_col].astype("Int64")
                yield out

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInPandas(pieces, schema)


def fullest(available: dict[int, int], room: int) -> list[int]:
    """The multiset of lengths with the largest sum within ``room``; each length at most as often as it is there.

    Longer lengths enter the table first, so of equal sums the one with longer members is found; counts enter by
    doubling (1, 2, 4, ...). Bit ``s`` of ``reached`` says that sum ``s`` can be made.
    """
    mask, reached, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in available if x <= room), reverse=True):
        left, times = min(available[length], room // length), 1
        while left:
            times = min(times, left)
            steps.append((length, times, reached))
            reached |= (reached << (length * times)) & mask
            left, times = left - times, times * 2
        if reached >> room & 1:
            break
    total, chosen = reached.bit_length() - 1, []
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * times
            total -= length * times
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, list[int]]]:
    """(first bin, bins, lengths in order) by minimum bin slack. At most a few patterns for each length."""
    left, plan, bins = {k: v for k, v in histogram.items() if v > 0}, [], 0
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("Lengths must be between 1 and the capacity")
    while left:
        longest = max(left)
        spare = {k: v - (k == longest) for k, v in left.items() if v - (k == longest)}
        pattern = [longest, *sorted(fullest(spare, capacity - longest), reverse=True)]
        counts = {k: pattern.count(k) for k in set(pattern)}
        times = min(left[k] // n for k, n in counts.items())
        plan.append((bins, times, pattern))
        bins += times
        left = {k: v - times * counts.get(k, 0) for k, v in left.items() if v > times * counts.get(k, 0)}
    return plan


def slots(plan: list[tuple[int, int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """For each length its runs of ranks: (length, first rank, ranks, first bin, offset)."""
    used: dict[int, int] = {}
    out = []
    for first, times, pattern in plan:
        offset = 0
        for length in pattern:
            rank = used.get(length, 0)
            out.append((length, rank, times, first, offset))
            used[length] = rank + times
            offset += length
    return out


def pack(pieces: DataFrame, capacity: int, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), buckets: int = 64) -> DataFrame:
    """``pieces`` with sequence_id and offset: each sequence holds at most ``capacity``, gapless from offset 0.

    The driver sees one count for each length and hash bucket (at most ``capacity`` x ``buckets``). A common length is
    ranked in ``buckets`` windows, not one. Rows of equal order are interchangeable: they have equal lengths.
    """
    spark = pieces.sparkSession
    clash = {"sequence_id", "offset", "_b", "_rank"} & set(pieces.columns)
    pieces = materialize(pieces.drop(*clash).withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")), "pieces")
    counted = pieces.groupBy(F.col(length_col).alias("n"), "_b").count().collect()
    histogram: dict[int, int] = {}
    before = []
    for r in sorted(counted, key=lambda r: (r["n"], r["_b"])):
        before.append((int(r["n"]), int(r["_b"]), histogram.get(r["n"], 0)))
        histogram[r["n"]] = histogram.get(r["n"], 0) + r["count"]
    runs = slots(plan_bins(histogram, capacity))
    starts = spark.createDataFrame(before, "_n long, _b int, _before long")
    by_length: dict[int, list] = {}
    for length, rank, times, first, offset in runs:
        by_length.setdefault(length, []).append((rank, times, first, offset))
    places = spark.createDataFrame([(k, v) for k, v in by_length.items()], "_n long, _runs array<struct<rank: long, times: long, first: long, offset: long>>")
    within = Window.partitionBy(length_col, "_b").orderBy(*order)
    ranked = (pieces.withColumn("_rank", F.row_number().over(within).cast("long") - 1)
              .withColumn("_n", F.col(length_col).cast("long"))
              .join(F.broadcast(starts), ["_n", "_b"]).join(F.broadcast(places), "_n")  # both bounded by the capacity
              .withColumn("_rank", F.col("_rank") + F.col("_before")))
    run = F.element_at(F.filter("_runs", lambda x: (F.col("_rank") >= x["rank"]) & (F.col("_rank") < x["rank"] + x["times"])), 1)
    return (ranked.withColumn("_run", run)
            .withColumn("sequence_id", F.col("_run.first") + F.col("_rank") - F.col("_run.rank")).withColumn("offset", F.col("_run.offset"))
            .select(*[c for c in pieces.columns if c != "_b"], "sequence_id", "offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(cut_tokens(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids), capacity, order=(id_col, "piece"))
