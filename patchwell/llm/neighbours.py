"""Nearest neighbours by largest inner product: shifted Hilbert curves whose key windows are merged and reranked.

Every distinct vector is projected by several random maps, each with its own shift, and takes a Hilbert key on each
curve. Rows are dealt by key range into blocks; a query looks into the blocks around its own key on every curve, the
finds of all curves are merged, and the best are reranked by the exact inner product in double precision. How many
blocks to either side it looks into is fitted: a bounded sample of queries (``sample``) is compared with all vectors,
and the narrowest window with the wanted recall is taken. All rows are indexed. Inner products become distances by
one more coordinate, which is zero where all norms are equal.

Defined results: rows whose id is null, or whose vector is null, zero, holds null or non-finite components or isn't
as long as most vectors, take no part; equal vectors share one place in the index and tie by smaller id; repeated
rows of one id and vector count as one candidate; with fewer than ``k`` candidates all are returned; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of integer points (rows) on the Hilbert curve, by the published transform on transposed coordinates."""
    x, dims = cells.astype(np.int64).copy(), cells.shape[1]
    for level in range(bits - 1, 0, -1):
        top, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            turned = (x[:, i] & top) != 0
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(turned, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    gray = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        gray ^= np.where(x[:, -1] & (1 << level), (1 << level) - 1, 0)
    x ^= gray[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[:, i] >> level & 1)
    return key


@dataclass
class Curves:
    """Random maps, shifts and the scale of the cells; ``cuts`` are the first keys of the blocks of each curve."""

    maps: np.ndarray
    shifts: np.ndarray
    scale: float
    norm: float
    bits: int
    cuts: list[np.ndarray]

    @classmethod
    def draw(cls, dims: int, norm: float, curves: int, axes: int, bits: int, seed: int) -> Curves:
        rng = np.random.default_rng(seed)
        maps = np.stack([np.linalg.qr(rng.standard_normal((max(dims + 1, axes), axes)))[0][:dims + 1] for _ in range(curves)])
        return cls(maps, rng.random((curves, axes)), 3 * norm / np.sqrt(dims), norm, bits, [])

    def points(self, x: np.ndarray, queries: bool) -> np.ndarray:
        """With the added coordinate: rows reach the largest norm by it, queries are stretched to that norm."""
        size = np.linalg.norm(x, axis=1, keepdims=True)
        if queries:
            return np.hstack([x * (self.norm / size), np.zeros_like(size)])
        return np.hstack([x, np.sqrt(np.maximum(self.norm ** 2 - size ** 2, 0))])

    def keys(self, x: np.ndarray, queries: bool) -> np.ndarray:
        p, side = self.points(x, queries), 1 << self.bits
        out = []
        for m, shift in zip(self.maps, self.shifts, strict=True):
            cell = np.floor(((p @ m) / self.scale / 2 + 0.5) * (side / 2) + shift * (side / 2))
            out.append(hilbert_keys(np.clip(cell, 0, side - 1), self.bits))
        return np.stack(out, 1)

    def blocks(self, x: np.ndarray, queries: bool) -> np.ndarray:
        keys = self.keys(x, queries)
        return np.stack([np.searchsorted(c, keys[:, i], "right") for i, c in enumerate(self.cuts)], 1)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def usable(vec: Column) -> Column:
    v = F.col("v") if vec is None else vec
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda c: c != 0)


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(rep, v, ids): each distinct vector with its smallest id and its ``most`` smallest ids; copies are dealt over salts first."""
    def first(df: DataFrame, *by: str) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(f"_n <= {most}").drop("_n")

    salted = first(rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64))).distinct(), "v", "_salt")
    return first(salted, "v").groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "v", "ids")


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest scores of each row."""
    k = min(k, score.shape[1])
    at = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(score)), k), at.ravel()


def fit_window(index: DataFrame, queries: DataFrame, curves: Curves, k: int, sample: int, recall: float) -> int:
    """Blocks to either side that find ``recall`` of the true neighbours of at most ``sample`` queries, compared with all."""
    drawn = queries.orderBy(F.xxhash64("rep", F.lit(11)), "rep").limit(sample).collect()
    if not drawn:
        return 0
    q, names = np.array([r["v"] for r in drawn], np.float64), np.array([r["rep"] for r in drawn])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = matrix(f["v"])
                score = q @ x.T
                row, col = best(score, f["rep"], k)
                yield pd.DataFrame({"q": names[row], "rep": f["rep"].to_numpy()[col], "score": score[row, col], "v": list(x[col])})

    merged = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    true = (index.select("rep", "v").mapInPandas(partial, "q long, rep long, score double, v array<double>")
            .withColumn("n", F.row_number().over(merged)).where(f"n <= {k}").select("q", "v").collect())
    at = {n: b for n, b in zip(names, curves.blocks(q, True), strict=True)}
    found = curves.blocks(np.array([r["v"] for r in true], np.float64), False)
    gaps = np.sort(np.abs(found - np.stack([at[r["q"]] for r in true])).min(1))
    return int(gaps[min(len(gaps) - 1, int(np.ceil(recall * len(gaps))))])


def nearest(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query: Column | None = None, k: int = 20,
            curves: int = 5, axes: int = 6, bits: int = 10, block_rows: int = 2048, sample: int = 200, recall: float = 0.95, seed: int = 17) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``query`` its ``k`` best others."""
    query = F.lit(True) if query is None else query
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), query.alias("asked")).where(
        F.col("id").isNotNull() & usable(F.col("v")))
    lengths = given.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dims = lengths["n"] if lengths else 1
    given = given.where(F.size("v") == dims)
    index = materialize(distinct_vectors(given.select("id", "v"), k + 1), "vectors")
    asked = materialize(given.where("asked").select("id", "v").distinct().join(index.select("v", "rep"), "v").select(F.col("id").alias("query_id"), "rep", "v"), "queries")
    top = index.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))).first()
    shape = Curves.draw(dims, float(top[1] or 1), curves, axes, bits, seed)

    def keyed(make, kind: str, queries: bool):
        return F.pandas_udf(lambda v: pd.Series(list(make(matrix(v), queries))), kind)("v")

    blocks = int(min(4096, max(1, top[0] // block_rows)))
    key = keyed(shape.keys, "array<long>", False)
    by_curve = index.select(F.posexplode(key).alias("curve", "key"))
    shares = F.array(*[F.lit(i / blocks) for i in range(1, blocks)]) if blocks > 1 else None
    cuts = {r["curve"]: r["cuts"] for r in by_curve.groupBy("curve").agg(F.percentile_approx("key", shares, 10_000).alias("cuts")).collect()} if blocks > 1 else {}
    shape.cuts = [np.unique(np.array(cuts.get(c, []), np.int64)) for c in range(curves)]
    distinct_queries = asked.select("rep", "v").dropDuplicates(["rep"])
    width = fit_window(index, distinct_queries, shape, k + 1, sample, recall) if blocks > 1 else 0

    data = index.select("rep", "v", F.posexplode(keyed(shape.blocks, "array<long>", False)).alias("curve", "block"))
    probes = (distinct_queries.select(F.col("rep").alias("q"), "v", F.posexplode(keyed(shape.blocks, "array<long>", True)).alias("curve", "home"))
              .withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0), F.col("home") - width), F.least(F.lit(blocks), F.col("home") + width)))))

    def search(block: pd.DataFrame, probe: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(probe):
            x, ids, q, names, floor = matrix(block["v"]).T, block["rep"].to_numpy(), matrix(probe["v"]), probe["q"].to_numpy(), probe["floor"].to_numpy()
            for i in range(0, len(q), 256):
                score = q[i:i + 256] @ x
                row, col = best(score, ids, k + 1)
                good = score[row, col] >= floor[i + row] - 1e-9 * abs(floor[i + row])
                out.append(pd.DataFrame({"q": names[i + row[good]], "rep": ids[col[good]], "score": score[row[good], col[good]]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "rep": [], "score": []})

    def found(some: DataFrame) -> DataFrame:
        return data.groupBy("curve", "block").cogroup(some.groupBy("curve", "block")).applyInPandas(search, "q long, rep long, score double")

    def merged(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
        return rows.groupBy("q", "rep").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(order)).where(f"n <= {k + 1}")

    # The blocks of the queries' own keys come first: what the others find below their last place cannot count any more.
    first = materialize(merged(found(probes.where("block = home").withColumn("floor", F.lit(-np.inf)))), "first")
    floors = first.where(f"n = {k + 1}").select("q", F.col("score").alias("floor"))
    rest = probes.where("block != home").join(floors, "q", "left").fillna(-1.7e308, "floor")
    best_reps = merged(first.drop("n").unionByName(found(rest))).select("q", "rep")
    rerank = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda a, c: a + c)
    pairs = (best_reps.join(index, "rep").join(distinct_queries.select(F.col("rep").alias("q"), F.col("v").alias("qv")), "q")
             .select("q", "ids", rerank.alias("score")))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (pairs.join(asked.select("query_id", F.col("rep").alias("q")), "q").select("query_id", F.explode("ids").alias("vec_id"), "score")
            .where("vec_id != query_id").withColumn("rank", F.row_number().over(final)).where(f"rank <= {k}")
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
