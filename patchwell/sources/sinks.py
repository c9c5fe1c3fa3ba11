"""Write-once tables, guarded exports and the prediction cache."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

PIECE_ROWS = 250_000  # fixed value: rows of one piece of a named CSV, about


class FrozenTableDiffers(ValueError):
    """The target holds another content than the one to be frozen."""


class EmptyExport(ValueError):
    """An export without rows needs explicit permission."""


def fingerprint(df: DataFrame) -> str:
    """Content hash that does not depend on row order or partitioning, columns by name.

    Row hashes are summed in four 15-digit slices, so equal rows count as often as they occur.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    slices = [F.sum(F.conv(F.substring(F.col("h"), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    r = df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n"), *slices).select(F.sha2(F.concat_ws("|", "n", *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4)]), 256)).first()
    return r[0]


def freeze(df: DataFrame, path: str) -> str:
    """Write a table once: the same content may be frozen again, another content is refused."""
    content = fingerprint(df)
    try:
        df.write.mode("errorifexists").parquet(path)
    except AnalysisException as error:
        if "PATH_ALREADY_EXISTS" not in str(error):
            raise
        if fingerprint(df.sparkSession.read.schema(df.schema).parquet(path)) != content:
            raise FrozenTableDiffers(path) from None
    return content


def export(df: DataFrame, path: str, fmt: str = "csv", allow_empty: bool = False) -> None:
    """One-job export (committed as a whole); empty results need ``allow_empty``."""
    if not allow_empty and df.isEmpty():
        raise EmptyExport(path)
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_named_csv(df: DataFrame, path: str, by: str, suffix: str) -> None:
    """One CSV with a header for each value of ``by``, called ``<value><suffix>``; the values must be few.

    A value of more than ``PIECE_ROWS`` rows is dealt out over several tasks; its CSV is a folder of that name with pieces
    ``part-<n><suffix>``. Spark writes the files; only their names are set afterwards, through the file system of the path.
    """
    spark = df.sparkSession
    pieces = cut_lineage(df.groupBy(F.col(by).alias("_by")).agg(F.ceil(F.count(F.lit(1)) / PIECE_ROWS).alias("_pieces")))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces.agg(F.sum("_pieces")).first()[0] or 0)
    piece = F.pmod(F.xxhash64(*df.columns), F.col("_pieces"))
    dealt = df.join(F.broadcast(pieces), F.col(by).eqNullSafe(F.col("_by"))).select(*df.columns, piece.alias("_piece"))
    dealt.repartition(n, by, "_piece").drop("_piece").withColumn("_name", F.col(by)).write.partitionBy("_name").option("header", True).csv(path)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(Path(path)):
        name = folder.getPath().getName()
        if name.startswith("_name="):
            parts = [f.getPath() for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
            target = f"{path}/{name.removeprefix('_name=')}{suffix}"
            if len(parts) > 1:
                fs.mkdirs(Path(target))
            for n, part in enumerate(parts):
                fs.rename(part, Path(f"{target}/part-{n}{suffix}" if len(parts) > 1 else target))
            fs.delete(folder.getPath(), True)


def cache_predictions(df: DataFrame, path: str, by: tuple[str, ...] = ("experiment_id", "partition")) -> DataFrame:
    """Store predictions by model and partition and read them back, pruned by either.

    Spark balances the write: small partitions are merged into one task, large ones split over as many as their bytes need.
    """
    df.hint("rebalance", *by).write.option("maxRecordsPerFile", 10_000_000).partitionBy(*by).mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
