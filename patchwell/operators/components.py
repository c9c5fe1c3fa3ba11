"""Adjacency of grid cells, connected components and grid-neighbour look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import Checked, all_violations, violation
from ..session import cut_lineage

STEP = 64  # fixed value: distance of neighbouring patches inside a parent


def _offsets(step: int, center: bool) -> Column:
    cells = [(r, c) for r in (-step, 0, step) for c in (-step, 0, step) if center or (r, c) != (0, 0)]
    return F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in cells])


def adjacent_pairs(cells: DataFrame, size: int) -> DataFrame:
    """Pairs of cells of one tile that touch or overlap: an equi-join on nine bucket offsets.

    ``cells`` has ``key, tile, x, y``, one row per key.
    """
    bucketed = cells.withColumns({"bx": F.floor(F.col("x") / size), "by": F.floor(F.col("y") / size)})
    probe = bucketed.withColumn("o", F.explode(_offsets(1, True))).select(
        F.col("key").alias("a"), "tile", F.col("x").alias("ax"), F.col("y").alias("ay"),
        (F.col("bx") + F.col("o.dr")).alias("bx"), (F.col("by") + F.col("o.dc")).alias("by"))
    touching = (F.abs(F.col("ax") - F.col("x")) <= size) & (F.abs(F.col("ay") - F.col("y")) <= size)
    return probe.join(bucketed, ["tile", "bx", "by"]).where((F.col("a") < F.col("key")) & touching).select(
        "tile", "a", F.col("key").alias("b"))


def connected_components(vertices: DataFrame, edges: DataFrame, key: str = "key") -> DataFrame:
    """Smallest member key of each vertex's component.

    Vertices are ordered by a hash, so chains to a local minimum stay short whatever the keys.
    Each round sends every vertex to its smallest neighbour, follows that pointer once more, and
    relabels the edges; loops drop out, so the edge table shrinks by a factor per round. The edges
    are the only thing written per round; labels follow from them when they are asked for.
    """
    def name(c: Column) -> Column:
        return F.concat(F.lpad(F.hex(F.xxhash64(c)), 16, "0"), c)

    one_way = edges.select(name(F.col("a")).alias("a"), name(F.col("b")).alias("b"))
    both = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut_lineage(both.where(F.col("a") != F.col("b")).distinct())
    labels = vertices.select(key, name(F.col(key)).alias("label"))
    while not edges.isEmpty():
        parent = edges.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        parent = parent.join(parent.select(F.col("a").alias("p"), F.col("p").alias("g")), "p").select("a", F.col("g").alias("p"))
        to = parent.select(F.col("a").alias("b"), F.col("p").alias("q"))
        edges = cut_lineage(edges.join(parent, "a").join(to, "b").select(F.col("p").alias("a"), F.col("q").alias("b"))
                            .where(F.col("a") != F.col("b")).distinct())
        moved = parent.select(F.col("a").alias("label"), F.col("p").alias("to"))
        labels = labels.join(moved, "label", "left").select(key, F.coalesce("to", "label").alias("label"))
    labels = cut_lineage(labels)
    smallest = labels.groupBy("label").agg(F.min(key).alias("smallest"))
    return labels.join(smallest, "label").select(key, F.col("smallest").alias("label"))


def grid_components(rows: DataFrame, size: int = 50) -> DataFrame:
    """Component label of every distinct subtile (``subtile_id, tile, x, y`` in the rows)."""
    cells = rows.select(F.col("subtile_id").alias("key"), "tile", "x", "y").distinct()
    labelled = connected_components(cells, adjacent_pairs(cells, size))
    return labelled.select(F.col("key").alias("subtile_id"), F.concat(F.lit("component:"), "label").alias("spatial_group_id"))


def validate_grid(rows: DataFrame, size: int = 50, extent: int = 2000) -> Checked:
    """Grid rules of a sample table: unique ids, the known cell size, aligned and inside the tile."""
    duplicates = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    off_grid = (F.col("subtile_size") != size) | (F.col("x") % size != 0) | (F.col("y") % size != 0)
    outside = ~(F.col("x").between(0, extent - 1) & F.col("y").between(0, extent - 1))
    mixed = rows.groupBy("tile").agg(F.count_distinct("subtile_size").alias("n"))
    problems = all_violations(
        violation(duplicates, "duplicate_sample", F.col("n") > 1, "sample_id"),
        violation(rows, "off_grid", off_grid, "sample_id"),
        violation(rows, "outside_tile", outside, "sample_id"),
        violation(rows, "identity_mismatch", F.col("named_sample_id") != F.col("sample_id"), "sample_id"),
        violation(mixed, "mixed_sizes", F.col("n") > 1, "tile"))
    return Checked(rows.where(~off_grid & ~outside), problems)


def with_grid_neighbors(rows: DataFrame, others: DataFrame, keys: list[str], step: int = STEP) -> DataFrame:
    """Flag ``has_neighbor``: another table has a row one step away with the same keys.

    The distinct positions of ``others`` are shifted and folded first, so the join side is one
    row per neighbouring position, however many patches sit there.
    """
    shifted = others.select(*keys, "patch_row", "patch_col").distinct().withColumn("o", F.explode(_offsets(step, False))).select(
        *keys, (F.col("patch_row") + F.col("o.dr")).alias("patch_row"), (F.col("patch_col") + F.col("o.dc")).alias("patch_col")
    ).distinct().withColumn("_hit", F.lit(True))
    return rows.join(shifted, [*keys, "patch_row", "patch_col"], "left").withColumn(
        "has_neighbor", F.coalesce("_hit", F.lit(False))).drop("_hit")
