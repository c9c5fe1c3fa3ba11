"""Archive index files, binary patch files and their verification."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checks import Checked

ENTRY_SCHEMA = ("archive string, member string, kind string, sample_id string, tile string, subtile_id string, date date, "
                "patch_row int, patch_col int, header_offset bigint, span_bytes bigint, compressed_bytes bigint, size_bytes bigint, "
                "crc32 string, compression int")
# Array shapes, dtypes and the size limit of stored patches.
SHAPES = {"sen2": ((12, 64, 64), "uint16"), "cyan": ((1, 64, 64), "uint8")}
MAX_BYTES = 2_000_000
OUTPUT_ROWS = 128  # decoded files per output batch: bounds the memory of a task


def archive_index(spark: SparkSession, path: str, schema: str = ENTRY_SCHEMA) -> DataFrame:
    """All ``*_entries.csv`` files below a path; the archive also comes from the file name."""
    rows = spark.read.schema(schema).option("header", True).option("pathGlobFilter", "*_entries.csv").option("recursiveFileLookup", True).csv(path)
    return rows.withColumn("index_name", F.regexp_extract(F.input_file_name(), r"([^/]+)_entries\.csv", 1))


def binary_files(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """Path, length and content of every matching file."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
            .load(path).select("path", "length", "content"))


OVERSIZED = b"oversized"


def _decode(content: bytes, shape: tuple[int, ...], dtype: str) -> tuple[list[int] | None, str | None]:
    """Flat values of one array file, or the reason it is refused."""
    if content == OVERSIZED:
        return None, "too_large"
    try:
        array = np.load(io.BytesIO(content), allow_pickle=False)
    except (ValueError, EOFError, OSError):
        return None, "unreadable"
    if array.shape != shape:
        return None, "shape"
    if array.dtype != np.dtype(dtype):
        return None, "dtype"
    return array.ravel().tolist(), None


def decode_arrays(files: DataFrame, shape: tuple[int, ...], dtype: str) -> Checked:
    """Flat arrays of array files (``path, content``); refused files are violations.

    Decoding runs batch by batch inside the tasks; each file stands alone. Oversized files are
    refused by length before their content is sent to Python.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), OUTPUT_ROWS):
                part = batch.iloc[at:at + OUTPUT_ROWS]
                done = [_decode(bytes(c), shape, dtype) for c in part["content"]]
                yield pd.DataFrame({"path": part["path"].to_numpy(), "values": [v for v, _ in done], "reject": [r for _, r in done]})

    small = files.withColumn("content", F.when(F.octet_length("content") <= MAX_BYTES, F.col("content")).otherwise(F.lit(OVERSIZED)))
    out = small.select("path", "content").mapInPandas(run, "path string, values array<int>, reject string")
    bad = out.where(F.col("reject").isNotNull()).select(F.col("reject").alias("rule"), F.col("path").alias("key"), F.lit("").alias("detail"))
    return Checked(out.where(F.col("reject").isNull()).drop("reject"), bad)


def mask_pixels(decoded: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """One row per pixel of a decoded one-channel mask."""
    return decoded.select(*keys, F.posexplode("values").alias("pixel", "dn")).withColumns(
        {"row": F.floor(F.col("pixel") / width).cast("int"), "col": F.col("pixel") % width})


def band_pixels(decoded: DataFrame, keys: list[str], bands, height: int = 64, width: int = 64) -> DataFrame:
    """One row per pixel with a column per band of a decoded image."""
    n = height * width
    pixel = decoded.select(*keys, "values", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pixel"))
    return pixel.select(*keys, "pixel", F.floor(F.col("pixel") / width).cast("int").alias("row"), (F.col("pixel") % width).alias("col"),
                        *[F.get("values", F.col("pixel") + i * n).alias(b) for i, b in enumerate(bands)])


def content_checks(content: Column) -> dict[str, Column]:
    return {"length": F.octet_length(content), "crc32": F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0"), "sha256": F.sha2(content, 256)}


def verify_contents(expected: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Expected length, CRC-32 and SHA-256 against the files: VERIFIED, HASH_MISMATCH or MISSING.

    ``files`` has the key and ``content``; only the digests travel to the join.
    """
    return verify_digests(expected, files.select(key, *[c.alias(n) for n, c in content_checks(F.col("content")).items()]), key)


def verify_digests(expected: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """As ``verify_contents``, from files whose ``length``, ``crc32`` and ``sha256`` are known."""
    seen = files.select(key, *[F.col(n).alias(f"_{n}") for n in ("length", "crc32", "sha256")])
    joined = expected.join(seen, key, "left")
    same = F.lit(True)
    for name in ("length", "crc32", "sha256"):
        if name in expected.columns:
            same = same & F.coalesce(F.col(name) == F.col(f"_{name}"), F.col(name).isNull())
    return joined.select(key, F.when(F.col("_sha256").isNull(), "MISSING").when(same, "VERIFIED").otherwise("HASH_MISMATCH").alias("status"),
                         F.col("_length").alias("bytes"))
