"""Polygons as edge tables, point-in-polygon joins, cell masks and patch windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks import Checked, all_violations, violation
from ..session import cut_lineage

ON_EDGE = 1e-9  # fixed value: tolerance of the boundary test
DENOMINATORS = (8, 16, 32, 64)  # fixed value: lattices of the representative-point search
SHIFTS = ((0, 0), (-10, 0), (10, 0), (0, -10), (0, 10), (-10, -10), (10, 10))  # fixed value: metres


def polygon_edges(rings: DataFrame) -> DataFrame:
    """Edge table ``geom, part, ring, seq, x0, y0, x1, y1`` from ``geom, parts`` (closed rings)."""
    flat = rings.select("geom", F.posexplode("parts").alias("part", "_p")).select(
        "geom", "part", F.posexplode("_p").alias("ring", "_r"))
    steps = F.transform(F.sequence(F.lit(1), F.size("_r") - 1), lambda i: F.struct(
        i.alias("seq"), F.element_at("_r", i).alias("a"), F.element_at("_r", i + 1).alias("b")))
    return flat.select("geom", "part", "ring", F.explode(steps).alias("e")).select(
        "geom", "part", "ring", "e.seq", F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"),
        F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1"))


def ring_measures(edges: DataFrame) -> DataFrame:
    """Signed area and centroid of every ring; a degenerate ring is its first point."""
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    sums = edges.groupBy("geom", "part", "ring").agg(
        F.sum(cross).alias("_t"), F.sum((F.col("x0") + F.col("x1")) * cross).alias("_sx"),
        F.sum((F.col("y0") + F.col("y1")) * cross).alias("_sy"), F.min_by(F.struct("x0", "y0"), "seq").alias("_f"),
        F.min("x0").alias("xmin"), F.max("x0").alias("xmax"), F.min("y0").alias("ymin"), F.max("y0").alias("ymax"))
    flat = F.abs(F.col("_t")) <= 1e-12
    return sums.select(
        "geom", "part", "ring", (F.col("_t") / 2).alias("area"), "xmin", "xmax", "ymin", "ymax",
        F.when(flat, F.col("_f.x0")).otherwise(F.try_divide("_sx", 3 * F.col("_t"))).alias("cx"),
        F.when(flat, F.col("_f.y0")).otherwise(F.try_divide("_sy", 3 * F.col("_t"))).alias("cy"))


def primary_rings(edges: DataFrame) -> DataFrame:
    """The largest outer ring of each geometry (the earlier part wins a tie)."""
    outer = ring_measures(edges.where(F.col("ring") == 0))
    best = F.min_by(F.struct("area", "cx", "cy", "xmin", "xmax", "ymin", "ymax"), F.struct(-F.abs("area"), F.col("part")))
    return outer.groupBy("geom").agg(best.alias("b")).select("geom", "b.*")


def box_level(cell: float) -> Column:
    """Level of a box: the number of doublings of ``cell`` that make it at least as long as both sides; NULL with a null side."""
    longest = F.when(F.col("xmin").isNotNull() & F.col("xmax").isNotNull() & F.col("ymin").isNotNull() & F.col("ymax").isNotNull(),
                     F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))
    return F.when(longest.isNotNull(), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(longest, F.lit(cell)) / cell)).cast("int")))


def levels_in(levels: DataFrame) -> Column:
    """The distinct levels as an array: doublings, so about a thousand at the very most and a handful in practice."""
    return F.array(*[F.lit(r[0]) for r in levels.distinct().where(F.col(levels.columns[0]).isNotNull()).sort(levels.columns[0]).collect()]).cast("array<int>")


def _on_cells(boxes: DataFrame, side: Column, pad: float = 0.0) -> DataFrame:
    """One row for each cell (``gx, gy``) of the given side length that a box covers."""
    across = [F.sequence(F.floor((F.col(lo) - pad) / side), F.floor((F.col(hi) + pad) / side)) for lo, hi in (("xmin", "xmax"), ("ymin", "ymax"))]
    return boxes.withColumn("gx", F.explode(across[0])).withColumn("gy", F.explode(across[1]))


def candidate_pairs(points: DataFrame, edges: DataFrame, cell: float) -> DataFrame:
    """Points with each geometry whose bounding box holds them: an equi-join on the cells of several grids.

    A box lies on the grid whose cells are about as long as its longer side (``cell`` or a doubling of it), so it is at most
    nine rows whatever its size; a point looks at one cell of each grid in use.
    """
    box = edges.groupBy("geom").agg(*[f(c).alias(n) for n, f, c in (
        ("xmin", F.min, "x0"), ("xmax", F.max, "x0"), ("ymin", F.min, "y0"), ("ymax", F.max, "y0"))]).withColumn("_level", box_level(cell))
    side = F.lit(cell) * F.pow(F.lit(2.0), F.col("_level"))
    spread = _on_cells(box.where(F.col("_level").isNotNull()), side, ON_EDGE)
    gridded = points.withColumn("_level", F.explode(levels_in(box.select("_level")))).withColumns({"gx": F.floor(F.col("x") / side), "gy": F.floor(F.col("y") / side)})
    held = (F.col("x").between(F.col("xmin") - ON_EDGE, F.col("xmax") + ON_EDGE)
            & F.col("y").between(F.col("ymin") - ON_EDGE, F.col("ymax") + ON_EDGE))
    return gridded.join(spread, ["_level", "gx", "gy"]).where(held).drop("_level", "gx", "gy", "xmin", "xmax", "ymin", "ymax")


def inside(points: DataFrame, edges: DataFrame, keys: list[str], band: float, boundary: bool = True) -> DataFrame:
    """Keys of the points inside their geometry (``points``: keys, geom, x, y).

    Points meet only the edges of their geometry in their horizontal band; crossings are summed
    per ring, holes are subtracted per part, any part suffices. With ``boundary`` a point on an
    edge counts as inside its ring; without it the half-open even-odd rule applies.
    """
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    banded = edges.withColumn("_band", F.explode(F.sequence(F.floor((low - ON_EDGE) / band), F.floor((high + ON_EDGE) / band))))
    met = points.withColumn("_band", F.floor(F.col("y") / band)).join(banded, ["geom", "_band"])
    x, y, x0, y0, x1, y1 = (F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1"))
    straddles = (y0 > y) != (y1 > y)
    crosses = F.coalesce(straddles & (x < F.try_divide((x1 - x0) * (y - y0), y1 - y0) + x0), F.lit(False))
    on = (F.abs((x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)) <= ON_EDGE) & x.between(
        F.least(x0, x1) - ON_EDGE, F.greatest(x0, x1) + ON_EDGE) & y.between(F.least(y0, y1) - ON_EDGE, F.greatest(y0, y1) + ON_EDGE)
    per_ring = met.groupBy(*keys, "geom", "part", "ring").agg(
        (F.sum(crosses.cast("int")) % 2 == 1).alias("odd"), (F.max(on.cast("int")) == 1).alias("on"))
    within = F.col("odd") | F.col("on") if boundary else F.col("odd")
    per_part = per_ring.withColumn("in", within).groupBy(*keys, "geom", "part").agg(
        F.coalesce(F.bool_or(F.when(F.col("ring") == 0, F.col("in"))), F.lit(False)).alias("outer"),
        F.coalesce(F.bool_or(F.when(F.col("ring") > 0, F.col("in"))), F.lit(False)).alias("hole"))
    return per_part.where(F.col("outer") & ~F.col("hole")).select(*keys, "geom").distinct()


def points_in_shapes(points: DataFrame, rings: DataFrame, key: str, cell: float, band: float, boundary: bool = True) -> DataFrame:
    """Every ``key, geom`` of a point (``key, x, y``) inside a geometry (``geom, parts`` as for ``polygon_edges``; both keys unique).

    Equal places and equal outlines are folded before the test, so the work follows the distinct ones; the answers
    then meet the keys behind them, which is one row for each row of the result. Both sides of that join are dealt out by
    key first: a few bytes become many rows, which adaptive execution would leave to one task.
    """
    n = int(rings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = cut_lineage(rings.where(F.col("geom").isNotNull()).select("geom", F.sha2(F.to_json("parts"), 256).alias("_shape"), "parts"))
    edges = polygon_edges(members.groupBy("_shape").agg(F.first("parts").alias("parts")).withColumnRenamed("_shape", "geom"))
    hits = inside(candidate_pairs(points.select("x", "y").distinct(), edges, cell), edges, ["x", "y"], band, boundary)
    where = hits.withColumnRenamed("geom", "_shape").join(members.select("geom", "_shape"), "_shape").select("x", "y", "geom")
    dealt = points.where(F.col(key).isNotNull()).select(key, "x", "y").repartition(n, key).distinct()
    return dealt.join(where.repartition(n, "x", "y", "geom"), ["x", "y"]).select(key, "geom")


def grid_cells(bounds: DataFrame, keys: list[str], grid: dict, pad: int = 1) -> DataFrame:
    """Rows and columns of the grid whose centres may lie in the bounds, with centre coordinates."""
    size, ox, oy = grid["pixel_size"], grid["origin_x"], grid["origin_y"]

    def clipped(lo, hi, n):
        return F.greatest(F.lit(0), F.floor(lo - 0.5) - pad), F.least(F.lit(n - 1), F.ceil(hi - 0.5) + pad)

    c0, c1 = clipped((F.col("xmin") - ox) / size, (F.col("xmax") - ox) / size, grid["width"])
    r0, r1 = clipped((oy - F.col("ymax")) / size, (oy - F.col("ymin")) / size, grid["height"])
    span = bounds.select(*keys, c0.cast("int").alias("_c0"), c1.cast("int").alias("_c1"), r0.cast("int").alias("_r0"), r1.cast("int").alias("_r1"))
    fits = span.where((F.col("_c0") <= F.col("_c1")) & (F.col("_r0") <= F.col("_r1")))
    rows = fits.withColumn("row", F.explode(F.sequence("_r0", "_r1"))).withColumn("col", F.explode(F.sequence("_c0", "_c1")))
    return rows.select(*keys, "row", "col", (ox + (F.col("col") + 0.5) * size).alias("x"), (oy - (F.col("row") + 0.5) * size).alias("y"))


def _changes(rows: DataFrame, keys: list[str], state: Column) -> DataFrame:
    """The columns at which ``state`` (over ``_here``, a window ordered by column) turns: ``turn`` 1 on, -1 off."""
    order = Window.partitionBy(*keys).orderBy("col")
    staged = rows.withColumn("_in", state)
    staged = staged.withColumn("_was", F.lag("_in", 1, False).over(order)).where(F.col("_in") != F.col("_was"))
    return staged.select(*keys, "col", F.when(F.col("_in"), 1).otherwise(-1).alias("turn"))


def center_runs(edges: DataFrame, grid: dict) -> DataFrame:
    """Runs ``geom, row, col_from, col_to`` of the cells whose centre lies in the geometry (closed rings), holes removed.

    Each edge gives one crossing for each row of centres between its ends; the crossings of a ring, in order, open and close it.
    Sums over the open rings tell where a part is inside and no hole is, and sums over the parts where any is. So the work follows
    the outline, not the area, and all steps share one exchange by geometry and row. Edges with a null end cross nothing.
    """
    size, ox, oy, width = grid["pixel_size"], grid["origin_x"], grid["origin_y"], grid["width"]
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first = F.greatest(F.lit(0), F.floor((oy - high) / size - 0.5) - 1)
    last = F.least(F.lit(grid["height"] - 1), F.ceil((oy - low) / size - 0.5) + 1)
    sloped = edges.where((F.col("y0") != F.col("y1")) & F.col("x0").isNotNull() & F.col("x1").isNotNull()).withColumns({"_r0": first.cast("int"), "_r1": last.cast("int")})
    y = oy - (F.col("row") + 0.5) * size
    met = sloped.where(F.col("_r0") <= F.col("_r1")).withColumn("row", F.explode(F.sequence("_r0", "_r1"))).where((F.col("y0") > y) != (F.col("y1") > y))
    x = (F.col("x1") - F.col("x0")) * (y - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0")
    guess = F.ceil((F.col("x") - ox) / size - 0.5)

    def center(c: Column) -> Column:
        return ox + (c + 0.5) * size

    column = F.when(center(guess - 1) >= F.col("x"), guess - 1).when(center(guess) < F.col("x"), guess + 1).otherwise(guess)
    dealt = met.select("geom", "part", "ring", "row", x.alias("x")).repartition("geom", "row").withColumn("col", F.least(F.lit(width), F.greatest(F.lit(0), column)).cast("int"))
    nth = F.row_number().over(Window.partitionBy("geom", "row", "part", "ring").orderBy("x"))
    turn, outer = F.when(nth % 2 == 1, 1).otherwise(-1), F.col("ring") == 0
    turns = dealt.withColumn("turn", turn).groupBy("geom", "row", "part", "col").agg(
        F.sum(F.when(outer, F.col("turn")).otherwise(0)).alias("_outer"), F.sum(F.when(outer, 0).otherwise(F.col("turn"))).alias("_holes"))
    here = Window.partitionBy("geom", "row", "part").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    parts = _changes(turns, ["geom", "row", "part"], (F.sum("_outer").over(here) > 0) & (F.sum("_holes").over(here) == 0))
    here = Window.partitionBy("geom", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    whole = _changes(parts.groupBy("geom", "row", "col").agg(F.sum("turn").alias("_parts")), ["geom", "row"], F.sum("_parts").over(here) > 0)
    ends = whole.withColumn("_end", F.lead("col").over(Window.partitionBy("geom", "row").orderBy("col")))
    return ends.where(F.col("turn") == 1).select("geom", "row", F.col("col").alias("col_from"), (F.coalesce("_end", F.lit(width)) - 1).alias("col_to"))


def off_grid(edges: DataFrame, grid: dict) -> DataFrame:
    """Geometries that lie wholly outside the grid, as violations."""
    bounds = edges.groupBy("geom").agg(F.min("x0").alias("xmin"), F.max("x0").alias("xmax"), F.min("y0").alias("ymin"), F.max("y0").alias("ymax"))
    right, bottom = grid["origin_x"] + grid["width"] * grid["pixel_size"], grid["origin_y"] - grid["height"] * grid["pixel_size"]
    off = (F.col("xmax") < grid["origin_x"]) | (F.col("xmin") > right) | (F.col("ymax") < bottom) | (F.col("ymin") > grid["origin_y"])
    return violation(bounds, "outside_grid", off, "geom")


def center_mask(edges: DataFrame, grid: dict) -> Checked:
    """Cells whose centre lies in the geometry, holes removed; a geometry off the grid is a violation.

    The rule is "centre inside"; outlines are not painted.
    """
    cells = center_runs(edges, grid).select("row", F.explode(F.sequence("col_from", "col_to")).alias("col"), "geom")
    return Checked(cells, off_grid(edges, grid))


def zonal_counts(mask: DataFrame, cells: DataFrame, pairs: DataFrame, product: str = "product", block: int = 64) -> DataFrame:
    """Class counts of the whole mask, given as cells or as runs of columns, per geometry and product.

    ``pairs`` lists the products of each geometry. A mask cell that a listed product has no value for is invalid,
    so ``valid + invalid`` is always the size of the mask. Runs meet cells by row and block of columns.
    """
    dn = F.col("dn")
    runs = mask if "col_from" in mask.columns else mask.select("geom", "row", F.col("col").alias("col_from"), F.col("col").alias("col_to"))
    sizes = runs.groupBy("geom").agg(F.sum(F.col("col_to") - F.col("col_from") + 1).alias("mask_pixels"))
    counts = {"low": dn.between(0, 99), "moderate": dn.between(100, 199), "high": dn.between(200, 253), "valid": dn.between(0, 253),
              "high_199": dn.between(199, 253), "high_201": dn.between(201, 253)}
    blocks = F.sequence(F.floor(F.col("col_from") / block), F.floor(F.col("col_to") / block))
    met = cells.withColumn("_block", F.floor(F.col("col") / block)).join(runs.withColumn("_block", F.explode(blocks)), ["row", "_block"])
    hits = met.where(F.col("col").between(F.col("col_from"), F.col("col_to"))).groupBy("geom", product).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    full = pairs.join(sizes, "geom").join(hits, ["geom", product], "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in counts})
    return full.select("geom", product, "low", "moderate", "high", "valid", (F.col("mask_pixels") - F.col("valid")).alias("invalid"),
                       "mask_pixels", "high_199", "high_201")


def patch_window(x: Column, y: Column, grid: dict, size: int) -> dict[str, Column]:
    """Window of ``size`` pixels around a centre on a north-up grid; ``fits`` tells whether it lies inside."""
    if size <= 0 or size % 2:
        raise ValueError("Patch size must be a positive even integer")
    px = grid["pixel_size"]
    col = F.floor((x - grid["origin_x"]) / px) - size // 2
    row = F.floor((grid["origin_y"] - y) / px) - size // 2
    left, top = grid["origin_x"] + col * px, grid["origin_y"] - row * px
    return {"row_offset": row, "col_offset": col, "left": left, "top": top, "right": left + size * px, "bottom": top - size * px,
            "fits": (row >= 0) & (col >= 0) & (row + size <= grid["height"]) & (col + size <= grid["width"])}


def centroids(primary: DataFrame) -> DataFrame:
    return primary.select("geom", F.lit(-1).alias("ord"), F.col("cx").alias("x"), F.col("cy").alias("y"))


def lattice_points(primary: DataFrame, stage: int, denominator: int) -> DataFrame:
    """Lattice candidates of one stage over the bounds of each primary ring, numbered in search order."""
    steps = F.sequence(F.lit(1), F.lit(denominator - 1))
    placed = primary.withColumn("_r", F.explode(steps)).withColumn("_c", F.explode(steps))
    return placed.select(
        "geom", (F.lit(stage * 10000) + F.col("_r") * 100 + F.col("_c")).alias("ord"),
        (F.col("xmin") + (F.col("xmax") - F.col("xmin")) * (F.col("_c") / denominator)).alias("x"),
        (F.col("ymin") + (F.col("ymax") - F.col("ymin")) * (F.col("_r") / denominator)).alias("y"))


def _first_hits(edges: DataFrame, denominators, accept) -> tuple[DataFrame, DataFrame]:
    """Accepted centroids, then accepted lattice points stage by stage: a geometry that is found makes no finer lattice."""
    primary = cut_lineage(primary_rings(edges))
    left, hits = primary, [cut_lineage(accept(centroids(primary)))]
    for stage, denominator in enumerate(denominators):
        left = cut_lineage(left.join(hits[-1].select("geom").distinct(), "geom", "left_anti"))
        if left.isEmpty():
            break
        hits.append(cut_lineage(accept(lattice_points(left, stage, denominator))))
    return reduce(DataFrame.unionByName, hits), primary


def representative_points(edges: DataFrame, band: float, denominators=DENOMINATORS) -> Checked:
    """First candidate inside the geometry; geometries without one are violations."""
    edges = cut_lineage(edges)

    def accept(candidates: DataFrame) -> DataFrame:
        return candidates.join(inside(candidates, edges, ["ord"], band), ["geom", "ord"])

    hits, primary = _first_hits(edges, denominators, accept)
    first = hits.groupBy("geom").agg(F.min(F.struct("ord", "x", "y")).alias("m")).select("geom", "m.ord", "m.x", "m.y")
    return Checked(first, violation(primary.join(first, "geom", "left_anti"), "no_interior_point", F.lit(True), "geom"))


def contained_patches(edges: DataFrame, grid: dict, size: int, band: float, denominators=DENOMINATORS) -> Checked:
    """First candidate inside the geometry whose whole patch (all four corners) is inside as well."""
    edges = cut_lineage(edges)
    w = patch_window(F.col("x"), F.col("y"), grid, size)
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.col(x).alias("x"), F.col(y).alias("y")) for i, (x, y) in enumerate((
        ("left", "bottom"), ("left", "top"), ("right", "top"), ("right", "bottom")))])

    def accept(candidates: DataFrame) -> DataFrame:
        placed = candidates.join(inside(candidates, edges, ["ord"], band), ["geom", "ord"]).withColumns(w).where("fits")
        probes = placed.select("geom", "ord", F.explode(corners).alias("c")).select("geom", "ord", F.col("c.i").alias("corner"), "c.x", "c.y")
        full = inside(probes, edges, ["ord", "corner"], band).groupBy("geom", "ord").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == 4)
        return placed.join(full, ["geom", "ord"])

    hits, primary = _first_hits(edges, denominators, accept)
    best = hits.groupBy("geom").agg(F.min(F.struct("ord", "row_offset", "col_offset", "left", "bottom", "right", "top")).alias("m"))
    out = best.select("geom", "m.*")
    return Checked(out, violation(primary.join(out, "geom", "left_anti"), "no_contained_patch", F.lit(True), "geom"))


def box_overlaps(boxes: DataFrame, cell: float) -> Checked:
    """Overlapping pairs of distinct boxes of one CRS (touching is not overlap), with the rows behind them.

    Identical boxes are folded to one row with a count before the join. A box is held on the grid whose cells are about as long
    as its longer side, so it is at most four rows there whatever its size, and looks for boxes of its own and of each larger
    level in use. Every pair is found only at the level of the larger box, in the cell with the lower corner of the intersection.
    """
    known = F.col("crs").isNotNull() & ~F.col("crs").isin("", "UNKNOWN", "UNVERIFIED")
    finite = [F.abs(F.col(c)) < float("inf") for c in ("xmin", "ymin", "xmax", "ymax")]
    proper = reduce(Column.__and__, finite, (F.col("xmin") < F.col("xmax")) & (F.col("ymin") < F.col("ymax")))
    shape = ["crs", "xmin", "ymin", "xmax", "ymax"]
    good = boxes.where(known & proper)
    distinct = good.groupBy(*shape).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("_own", box_level(cell))
    side = F.lit(cell) * F.pow(F.lit(2.0), F.col("_level"))
    upward = F.filter(levels_in(good.select(box_level(cell).alias("level"))), lambda v: v >= F.col("_own"))
    held = _on_cells(distinct.withColumn("_level", F.col("_own")), side)
    seeking = _on_cells(distinct.withColumn("_level", F.explode(upward)), side)
    keys = ["crs", "_level", "gx", "gy"]
    left, right = (d.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in ("id", "n", "_own", *shape[1:])]) for name, d in (("l", seeking), ("r", held)))
    overlap = ((F.col("l_xmin") < F.col("r_xmax")) & (F.col("r_xmin") < F.col("l_xmax"))
               & (F.col("l_ymin") < F.col("r_ymax")) & (F.col("r_ymin") < F.col("l_ymax")))
    here = (F.floor(F.greatest("l_xmin", "r_xmin") / side) == F.col("gx")) & (F.floor(F.greatest("l_ymin", "r_ymin") / side) == F.col("gy"))
    once = (F.col("l__own") < F.col("r__own")) | (F.col("l_id") < F.col("r_id"))  # two boxes of one level seek each other
    pairs = left.join(right, keys).where(once & overlap & here).select(
        "crs", F.least("l_id", "r_id").alias("left_id"), F.greatest("l_id", "r_id").alias("right_id"), (F.col("l_n") * F.col("r_n")).alias("pairs"))
    same = distinct.where(F.col("n") > 1).select("crs", F.col("id").alias("left_id"), F.col("id").alias("right_id"),
                                                 F.expr("n * (n - 1) div 2").alias("pairs"))
    problems = all_violations(violation(boxes, "unknown_crs", ~F.coalesce(known, F.lit(False)), "id"),
                              violation(boxes, "invalid_box", ~F.coalesce(proper, F.lit(False)), "id"))
    return Checked(pairs.unionByName(same), problems)
