"""Token counts as rollups kept by signed deltas.

Changes (insert, delete, revise) become additive deltas by source, language and tokenizer version; each batch is
summed before it moves and committed under its own number in the rollup's folder. A batch that is there in full is
skipped when it comes again, and one that broke off is written anew, so repeats never count twice. Totals are the
sum over the committed batches; ``compact`` folds them into one.

Defined results: a null source, language or version is a group of its own; null counts are zero; a change of unknown
kind is an error; groups without documents and tokens left are kept with zeros; an empty batch commits as empty;
columns beyond the named ones are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, docs long, tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """``changes``: change, the group, docs (how many documents the row stands for), before and after (tokens of all of them)."""
    n, before, after = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("docs", "before", "after"))
    kind = F.col("change")
    wrong = F.raise_error(F.concat(F.lit("Unknown change: "), F.coalesce(kind, F.lit("null"))))
    docs = F.when(kind == "insert", n).when(kind == "delete", -n).when(kind == "revise", F.lit(0)).otherwise(wrong)
    tokens = F.when(kind == "insert", after).when(kind == "delete", -before).otherwise(after - before)
    return changes.groupBy(*GROUP).agg(F.sum(docs).alias("docs"), F.sum(tokens).alias("tokens"))


class Rollup:
    """Committed batches below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def committed(self, batch: int) -> bool:
        return self._exists(f"batch={batch}/_SUCCESS")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """False where the batch was committed before. The success file is written last, so a broken batch doesn't count."""
        if self.committed(batch):
            return False
        signed(changes).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")
        return True

    def batches(self) -> list[int]:
        if not self._exists(""):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        numbers = [int(f.getPath().getName().removeprefix("batch=")) for f in found if f.getPath().getName().startswith("batch=")]
        return sorted(b for b in numbers if self.committed(b))

    def totals(self) -> DataFrame:
        paths = [f"{self.folder}/batch={b}" for b in self.batches()]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def addresses(text: Column) -> Column:
    """Words that hold an at sign."""
    return F.when(F.contains(text, F.lit("@")), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]*@[^\x20\x09-\x0D]*"))).otherwise(0).cast("long")


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, source, lang, copy_of, version, tokens, without_addresses): one row for each document and tokenizer version."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.select(F.col(id_col).cast("long").alias("id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                      F.struct(F.xxhash64(text), F.crc32(text.cast("binary")), F.octet_length(text)).alias("copy_of"),
                      words(text).alias("w"), addresses(text).alias("at"), F.ceil(F.octet_length(text) / 4).cast("long").alias("b"))
    versions = F.array(F.struct(F.lit("words.1").alias("version"), F.col("w").alias("tokens"), (F.col("w") - F.col("at")).alias("revised")),
                       F.struct(F.lit("bytes4.1").alias("version"), F.col("b").alias("tokens"), F.col("b").alias("revised")))
    return one.select("id", "source", "lang", "copy_of", F.explode(versions).alias("v")).select("id", "source", "lang", "copy_of", "v.*")


def inserts(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("insert").alias("change"), *GROUP, F.lit(1).alias("docs"), F.lit(0).alias("before"), F.col("tokens").alias("after"))


def deletes_of_copies(rows: DataFrame) -> DataFrame:
    """Deletes all but the first document of each text. Copies are summed by text and group first: a text has few groups."""
    per_group = rows.groupBy("copy_of", *GROUP).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("tokens").alias("each"))
    first = per_group.groupBy("copy_of", "version").agg(F.min(F.struct(F.coalesce("first", F.lit(2 ** 63 - 1)).alias("first"), "source", "lang")).alias("keep"))
    gone = F.col("n") - F.when(F.col("keep.source").eqNullSafe(F.col("source")) & F.col("keep.lang").eqNullSafe(F.col("lang")), 1).otherwise(0)
    return (per_group.join(first, ["copy_of", "version"]).withColumn("gone", gone).where("gone > 0")
            .select(F.lit("delete").alias("change"), *GROUP, F.col("gone").alias("docs"), (F.col("gone") * F.col("each")).alias("before"), F.lit(0).alias("after")))


def revisions(rows: DataFrame) -> DataFrame:
    """Counts anew what is left of each distinct text without its addresses."""
    per_text = rows.where("tokens != revised").groupBy("copy_of", "version").agg(F.min(F.struct(
        F.coalesce("id", F.lit(2 ** 63 - 1)).alias("id"), "source", "lang", "tokens", "revised")).alias("k"))
    return per_text.select(F.lit("revise").alias("change"), F.col("k.source").alias("source"), F.col("k.lang").alias("lang"), "version", F.lit(1).alias("docs"),
                           F.col("k.tokens").alias("before"), F.col("k.revised").alias("after"))
