"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the folder all executors share and read back: no later step depends on an executor staying alive."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def bounded_sample(df: DataFrame, key: str, rows: int) -> list:
    """At most ``rows`` rows, the first in hash order of ``key``; the same for any partitioning.

    Only the share of the hashes that holds a little more than these is ordered, so little more than these move.
    """
    place, of = F.xxhash64(F.col(key), F.lit(7)), 1 << 30
    share = min(1.0, (1.2 * rows + 100) / max(1, df.count()))
    return df.where(F.pmod(place, F.lit(of)) < int(share * of)).orderBy(F.pmod(place, F.lit(of)), place, key).limit(rows).collect()


def bounded_sample_by(df: DataFrame, key: str, group: str, rows: int) -> DataFrame:
    """At most ``rows`` rows in all, shared out evenly over the values of ``group``: of each the first in hash order of ``key``.

    Only the share of the hashes that holds a little more than these is ranked, so little more than these move.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("__n")).orderBy(group).limit(rows)
    each = max(1, rows // max(1, counts.count()))
    place, of = F.xxhash64(F.col(key), F.lit(7)), 1 << 30
    share = F.least(F.lit(1.0), (1.2 * each + 100) / F.col("__n"))
    drawn = df.join(F.broadcast(counts), group).where(F.pmod(place, F.lit(of)) < share * of)
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.pmod(place, F.lit(of)), place, key))
    return drawn.withColumn("__place", first).where(F.col("__place") <= each).drop("__n", "__place")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node it is connected to.

    Alternating large and small stars (each node links its larger neighbours, then its smaller ones, to the smallest
    one around it). Every round is written to the shared folder; it ends when a round changes nothing, which two
    sums over the edges tell.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return e.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    edges = materialize(tidy(edges), "edges")
    before, now = None, state(edges)
    while now != before and now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = tidy(both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = materialize(tidy(large.join(smallest, "a").select("b", "m").unionByName(smallest.select(F.col("a").alias("b"), "m"))
                                 .select(F.col("b").alias("a"), F.col("m").alias("b"))), "edges")
        before, now = now, state(edges)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
