"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame operations alone.

A text is cut into paragraphs (after a line break or full stop, long ones every ``PIECE`` characters); the set of
their digests goes into a sketch of three tables, each digest into one cell of each: a count, the XOR of the digests
and the XOR of their check hashes. Sketches of two versions subtract cell by cell, so what both hold cancels; a cell
left with count 1 or -1 and a fitting check hash is pure and names a differing digest, which is then taken out of its
other two cells, and so on until nothing is left. Pairs that get stuck are tried again with larger tables and other
hashes. The likeness of two texts is the Jaccard index of their paragraph digests, from the recovered differences.

The fingerprint is this sketch, folded to ``WIDTH`` cells a table: widths are powers of two and a cell is a hash modulo
the width, so cells that fall together under the smaller width are summed. Two written fingerprints can therefore be
subtracted and peeled as they stand (``cells_of``); where they hold more differences than that recovers, the likeness
comes from the wider sketch they were folded from.

Texts move once, to meet the next document. All steps up to the result then work inside that partitioning.

Defined results: a null text counts as empty; two texts without paragraphs are alike (1.0); documents with equal ids
follow each other by the hash of their texts; null ids come last; the only row of a table is its own next; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

PIECE = 64
LOWEST = -(2 ** 63)
TABLES = 3
WIDTH = 8  # cells of each table of the written fingerprint
KNOTS = 64


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs."""
    parts = F.filter(F.split(text, r"(?<=[.\n])"), lambda p: p != "")
    cut = F.transform(parts, lambda p: F.when(F.length(p) <= PIECE, F.array(p)).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / PIECE).cast("int")), lambda i: p.substr(i * PIECE + 1, F.lit(PIECE)))))
    return F.array_distinct(F.transform(F.flatten(cut), lambda p: F.xxhash64(p)))


CELL = "cell int, count long, key long, chk long"


def written(cells: Column) -> Column:
    """Cells (``CELL``) of a sketch as text: of each cell in use, 16 bytes in base 64.

    They are the number (1 byte), count (3), XOR of the digests (8) and of the lower halves of their check hashes (4).
    """
    def hexed(c: Column) -> Column:
        return F.concat(F.lpad(F.hex(c["cell"]), 2, "0"), F.lpad(F.hex(c["count"]), 6, "0"), F.lpad(F.hex(c["key"]), 16, "0"), F.right(F.lpad(F.hex(c["chk"]), 16, "0"), F.lit(8)))

    return F.translate(F.base64(F.unhex(F.array_join(F.transform(F.array_sort(cells), hexed), ""))), "\r\n", "")


def cells_of(fingerprint: Column) -> Column:
    """The cells (number, count, key, lower half of check) of a written fingerprint."""
    h = F.hex(F.unbase64(fingerprint))

    def number(i: Column, at: int, size: int) -> Column:
        return F.conv(F.substr(h, i * 32 + at, F.lit(size)), 16, -10).cast("long")

    places = F.when(F.length(h) > 0, F.sequence(F.lit(0), F.floor(F.length(h) / 32).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(number(i, 1, 2).cast("int").alias("cell"), number(i, 3, 6).alias("count"), number(i, 9, 16).alias("key"), number(i, 25, 8).alias("chk")))


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(77))


def cell_of(digest: Column, table: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(100 * seed + table)), F.col("width")).cast("int") + F.lit(table).cast("int") * F.col("width").cast("int")


def subtracted(rows: DataFrame, keys: list[str], seed: int, kept: bool) -> DataFrame:
    """``rows`` has the keys, width and three sides a, e, n. Cells of a - e (pair 0) and a - n (pair 1) that aren't empty.

    With ``kept`` the sketches of a (pair 2) and e (pair 3) themselves come along, under the cells of ``WIDTH``; the
    rounds of peeling sum these and leave them alone.
    """
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("all")) for i, c in enumerate("aen")])
    one = (rows.select(*keys, "width", F.explode(sides).alias("s")).select(*keys, "width", "s.side", F.explode("s.all").alias("digest"))
           .withColumn("chk", check(F.col("digest")))
           .select(*keys, "width", "side", "digest", "chk", F.explode(F.array(*[cell_of(F.col("digest"), t, seed) for t in range(TABLES)])).alias("cell")))
    zero = F.lit(0).cast("long")
    aggs = [f for i, c in enumerate("aen") for f in (
        F.sum(F.when(F.col("side") == i, 1).otherwise(0)).alias(f"c{c}"),
        F.bit_xor(F.when(F.col("side") == i, F.col("digest")).otherwise(zero)).alias(f"k{c}"),
        F.bit_xor(F.when(F.col("side") == i, F.col("chk")).otherwise(zero)).alias(f"h{c}"))]
    pairs = [F.struct(F.lit(i).alias("pair"), F.col("cell"), (F.col("ca") - F.col(f"c{c}")).alias("count"), F.col("ka").bitwiseXOR(F.col(f"k{c}")).alias("key"),
                      F.col("ha").bitwiseXOR(F.col(f"h{c}")).alias("chk")) for i, c in enumerate("en")]
    folded = F.floor(F.col("cell") / F.col("width")).cast("int") * WIDTH + F.col("cell") % WIDTH
    own = [F.struct(F.lit(i).alias("pair"), folded.alias("cell"), F.col(f"c{c}").alias("count"), F.col(f"k{c}").alias("key"), F.col(f"h{c}").alias("chk")) for i, c in ((2, "a"), (3, "e"))]
    return (one.groupBy(*keys, "width", "cell").agg(*aggs).select(*keys, "width", F.explode(F.array(*pairs, *(own if kept else []))).alias("p")).select(*keys, "width", "p.*")
            .where("count != 0 or key != 0 or chk != 0").withColumns({"more": F.lit(0).cast("long"), "less": F.lit(0).cast("long")}))


def peeled(cells: DataFrame, keys: list[str], seed: int, table: int) -> DataFrame:
    """Takes the pure cells of one table out of the two others. What they named is counted in the row of cell -1."""
    count, key, zero = F.col("count"), F.col("key"), F.lit(0).cast("long")

    def row(cell, n, k, h, more, less) -> Column:
        return F.struct(cell.cast("int").alias("cell"), n.cast("long").alias("count"), k.alias("key"), h.alias("chk"), more.cast("long").alias("more"), less.cast("long").alias("less"))

    pure = (F.col("pair") < 2) & (F.abs(count) == 1) & (F.col("chk") == check(key)) & (F.floor(F.col("cell") / F.col("width")) == table) & (cell_of(key, table, seed) == F.col("cell"))
    named = row(F.lit(-1), zero, zero, zero, F.when(count > 0, 1).otherwise(0), F.when(count < 0, 1).otherwise(0))
    out = [row(cell_of(key, t, seed), -count, key, F.col("chk"), zero, zero) for t in range(TABLES) if t != table]
    same = row(F.col("cell"), count, key, F.col("chk"), F.col("more"), F.col("less"))
    moved = cells.select(*keys, "width", "pair", F.explode(F.when(pure, F.array(named, *out)).otherwise(F.array(same))).alias("r")).select(*keys, "width", "pair", "r.*")
    return moved.groupBy(*keys, "width", "pair", "cell").agg(
        F.sum("count").alias("count"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk"), F.sum("more").alias("more"), F.sum("less").alias("less")).where(
        "cell = -1 or count != 0 or key != 0 or chk != 0")


def differences(rows: DataFrame, keys: list[str], seed: int, rounds: int, kept: bool = False) -> DataFrame:
    """For each row and pair: recovered digests on either side only, and cells that are left (0: all recovered).

    With ``kept`` also the cells of a's and e's own sketches.
    """
    cells = reduce(lambda c, i: peeled(c, keys, seed, i % TABLES), range(rounds), subtracted(rows, keys, seed, kept))

    def over(pair: int, value: Column) -> Column:
        return F.sum(F.when(F.col("pair") == pair, value).otherwise(0))

    stuck = F.when(F.col("cell") >= 0, 1).otherwise(0)
    cell = F.struct("cell", "count", "key", "chk")
    sketches = [F.collect_list(F.when(F.col("pair") == i, cell)).alias(f"cells_{c}") for i, c in ((2, "a"), (3, "e"))] if kept else []
    return cells.groupBy(*keys).agg(*[over(i, v).alias(f"{n}_{c}") for i, c in enumerate("en") for n, v in (("more", F.col("more")), ("less", F.col("less")), ("left", stuck))], *sketches)


def width_for(growth: int = 1) -> Column:
    """Cells of one table: a power of two, at least three quarters of the largest difference that the counts allow."""
    most = F.size("a") + F.greatest(F.size("e"), F.size("n"))
    return (F.lit(2 * WIDTH * growth) * F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(most * 0.75 / (2 * WIDTH) + 1e-9))))).cast("long")


def segments(ids: DataFrame, rows_per_bucket: int, max_buckets: int) -> list[tuple[int, int, bool, int, int]]:
    """(lowest id, width, one id alone, first bucket, buckets) of ranges of ids, ascending.

    The ranges lie between approximate quantiles. Null ids and an id that fills several of these quantiles are ranges of
    their own.
    """
    real = F.when(F.col("id") != LOWEST, F.col("id"))
    n, nulls, low, high, knots = ids.agg(F.count("*"), F.count_if(F.col("id") == LOWEST), F.min(real), F.max(real), F.percentile_approx(real, F.array(*[F.lit(i / KNOTS) for i in range(1, KNOTS)]), 1000)).first()
    out, used = [], 0

    def add(start: int, width: int, alone: bool, rows: float) -> None:
        nonlocal used
        buckets = max(1, min(-(-int(rows) // rows_per_bucket), int(max_buckets * rows / n)))
        out.append((start, width, alone, used, buckets))
        used += buckets

    if nulls:
        add(LOWEST, 1, True, nulls)
    if n > nulls:
        each, edges = (n - nulls) / KNOTS, sorted({low, *knots, high})
        hot = {k for k in edges if knots.count(k) > 1}
        for k, after in zip(edges, [*edges[1:], high + 1], strict=True):
            if k in hot:
                add(k, 1, True, each * knots.count(k))
            start = k + 1 if k in hot else k
            if start < after:
                add(start, after - start, False, each)
    return out


def with_next(docs: DataFrame, rows_per_bucket: int, max_buckets: int) -> DataFrame:
    """(bucket, rn, id, text, a, next_text, n): every row beside the next one in descending order of ids.

    Buckets are parts of ranges of ids, by even steps of the id or, where a range is one id alone, of the hash of the text.
    A copy of each bucket's first document also goes to the bucket before it; there are at most ``max_buckets`` of these
    and one for each of 64 ranges. Rows with one id and one text share a bucket.
    """
    spark = docs.sparkSession
    keyed = docs.withColumn("h", F.xxhash64("text"))
    bucket, parts = F.lit(0), segments(docs.select("id"), rows_per_bucket, max_buckets)
    for start, width, alone, first, buckets in parts:
        share = 0.5 - F.col("h").cast("double") / 2.0 ** 64 if alone else (F.col("id").cast("double") - float(start)) / float(width)
        within = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(share * buckets))).cast("int") if buckets > 1 else F.lit(0)
        bucket = F.when(F.col("id") >= start, F.lit(first) + within).otherwise(bucket)
    buckets = sum(p[-1] for p in parts) or 1
    found = keyed.groupBy(bucket.alias("b")).agg(F.max(F.struct("id", F.bitwise_not("h").alias("h"))).alias("first")).collect()
    firsts = sorted((r["b"], r["first"]["id"], ~r["first"]["h"]) for r in found)
    after = [(i, h, firsts[(at + 1) % len(firsts)][0]) for at, (_, i, h) in enumerate(firsts)]
    copies = F.broadcast(spark.createDataFrame(after, "id long, h long, other int"))
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("copy"))
    both = (keyed.join(copies, ["id", "h"], "left")
            .select("id", "h", "text", F.explode(F.when(F.col("other").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("other").alias("bucket"), F.lit(True).alias("copy"))))).alias("w"))
            .select(F.coalesce("w.bucket", F.lit(0)).alias("bucket"), F.col("w.copy").alias("copy"), "id", "h", "text"))
    order = Window.partitionBy("bucket").orderBy("copy", F.desc("id"), "h")
    return (both.repartition(buckets, "bucket").withColumn("a", digests(F.col("text"))).withColumns({"rn": F.row_number().over(order), "next_text": F.lead("text").over(order), "n": F.lead("a").over(order)})
            .where(~F.col("copy")).drop("copy", "h"))


@contextmanager
def joined_in_place(spark: SparkSession):
    """Joins of two sides that are dealt by the same first key keep that dealing: here both read one exchange of the texts."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 600, max_buckets: int = 65_536, rounds: int = 9) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every whole text.

    The edited text ends with the beginning of the next document in place of its own last third.
    """
    given = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - third), F.col("next_text").substr(F.lit(1), third))
    rows = with_next(given, rows_per_bucket, max_buckets).withColumn("edited", edited).withColumn("e", digests(F.col("edited")))
    keys = ["bucket", "rn"]
    tried = differences(rows.select(*keys, "a", "e", "n", width_for().alias("width")), keys, 0, rounds, kept=True)
    told = rows.select(*keys, "id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       "a", "e", "n")
    columns = [f"{x}_{c}" for c in "en" for x in ("more", "less", "left")]
    stuck = F.coalesce(F.col("left_e") + F.col("left_n"), F.lit(0)) > 0
    prints = {name: F.coalesce(written(F.col(f"cells_{c}")), F.lit("")) for name, c in (("fingerprint", "a"), ("edited_fingerprint", "e"))}
    both = told.join(tried, keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in columns} | prints).drop("cells_a", "cells_e").withColumn("size_a", F.size("a"))
    with joined_in_place(docs.sparkSession):
        done = materialize(both.withColumns({c: F.when(stuck, F.col(c)) for c in "aen"}), "sketches")
    solved, seed = done.where(~stuck).drop(*"aen"), 0
    left = done.where(stuck)
    while not left.isEmpty():  # larger tables, other hashes; only what is stuck
        seed += 1
        again = differences(left.select(*keys, "a", "e", "n", width_for(4 ** seed).alias("width")), keys, seed, rounds)
        left = materialize(left.drop(*columns).join(again, keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in columns}), "sketches")
        solved = solved.unionByName(left.where(~stuck).drop(*"aen"))
        left = left.where(stuck)

    def likeness(c: str) -> Column:
        union = F.col("size_a") + F.col(f"less_{c}")
        return F.when(union == 0, 1.0).otherwise((F.col("size_a") - F.col(f"more_{c}")) / union)

    return solved.select(F.when(F.col("id") != LOWEST, F.col("id")).alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                         likeness("e").alias("near_edited"), likeness("n").alias("near_next"))
