"""Global ranks, running totals and exact quantiles without one-task windows.

Every operator here works in two levels: a coarse bucket that keeps the order, a small
table of bucket totals whose running sum gives each bucket its start, and a window
inside the bucket. The number of buckets of a key is bounded (hash digits, magnitudes or
``range_bucket``), so neither level grows with the rows of one key beyond its share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def hash_bucket(hex_hash: Column, digits: int = 4) -> Column:
    """Leading hex digits: uniform and ordered like the hash itself."""
    return F.substring(hex_hash, 1, digits)


def value_bucket(value: Column, per_octave: int = 64, bits: int = 20) -> Column:
    """Coarse bucket of a number, never decreasing in the value, without knowing its range.

    Buckets are even in magnitude above ``2**-bits``, so values that crowd around zero spread too.
    """
    return F.floor(F.signum(value) * F.log2(1 + F.abs(value) * float(2**bits)) * per_octave).cast("int")


def share_bucket(share: Column, per_octave: int = 64) -> Column:
    """Coarse bucket of a probability, fine near 0 and near 1 where saturated scores crowd."""
    middle = value_bucket(F.lit(0.5), per_octave, 40)
    return F.when(share <= 0.5, value_bucket(share, per_octave, 40)).otherwise(2 * middle - value_bucket(1 - share, per_octave, 40))


def range_bucket(df: DataFrame, column: str, buckets: int = 128, sample: int = 20_000) -> Column:
    """Order-preserving bucket of any sortable column, at most ``buckets`` of them whatever the table holds.

    The bounds are quantiles of a bounded sample drawn by hash, found in one pass; the comparison is a balanced tree.
    """
    n, of = max(1, df.count()), 1 << 30
    share = int(min(1.0, 1.2 * sample / n) * of)
    drawn = sorted(r[0] for r in df.where((F.pmod(F.xxhash64(column), F.lit(of)) < share) & F.col(column).isNotNull()).select(column).limit(2 * sample).collect())
    knots = sorted({drawn[i * len(drawn) // buckets] for i in range(1, buckets)}) if drawn else []

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(column) >= F.lit(knots[middle]), tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(knots))


def ordered_rank(df: DataFrame, order: list[Column | str], out: str = "rank") -> DataFrame:
    """Zero-based rank of every row in ``order``: range partitions, each sorted, carry one number, the rows of those before.

    Spark draws the bounds of the partitions, as many as the session's shuffle partitions; equal rows are spread by
    their place in the input. The sorted rows are checkpointed, so both uses see the same partitions. Only one row per
    partition is broadcast.
    """
    tie = F.monotonically_increasing_id()
    placed = df.withColumn("_tie", tie).repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie"))
    placed = cut_lineage(placed.withColumn("_at", F.monotonically_increasing_id()).drop("_tie"))
    placed = placed.withColumns({"_part": F.shiftrightunsigned("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def running_totals(df: DataFrame, keys: list[str], order: list[str], amounts: dict[str, Column], bucket: Column,
                   totals: dict[str, str] | None = None, descending: bool = False) -> DataFrame:
    """Inclusive running sums (``out name -> amount``) per key in ``order``, from one pair of passes.

    ``bucket`` must not decrease (increase if ``descending``) along ``order``. ``totals`` maps an
    out name to a column for its sum over the whole key.
    """
    names = list(amounts)
    staged = df.withColumns({"_bucket": bucket, **{f"_a_{n}": amounts[n] for n in names}})
    direction = F.desc if descending else F.asc
    per_bucket = staged.groupBy(*keys, "_bucket").agg(*[F.sum(f"_a_{n}").alias(f"_in_{n}") for n in names])
    earlier, whole = Window.partitionBy(*keys).orderBy(direction("_bucket")), Window.partitionBy(*keys)
    starts = per_bucket.select(
        *keys, "_bucket", *[(F.sum(f"_in_{n}").over(earlier) - F.col(f"_in_{n}")).alias(f"_start_{n}") for n in names],
        *[F.sum(f"_in_{n}").over(whole).alias(out) for n, out in (totals or {}).items()])
    inner = (Window.partitionBy(*keys, "_bucket").orderBy(*[direction(c) for c in order])
             .rowsBetween(Window.unboundedPreceding, 0))
    return (staged.join(starts, [*keys, "_bucket"])
            .withColumns({n: F.sum(f"_a_{n}").over(inner) + F.col(f"_start_{n}") for n in names})
            .drop("_bucket", *[f"_a_{n}" for n in names], *[f"_start_{n}" for n in names]))


def running_total(df: DataFrame, keys: list[str], order: list[str], amount: Column, bucket: Column,
                  out: str = "running", total: str | None = None, descending: bool = False) -> DataFrame:
    """One running sum; see ``running_totals``."""
    return running_totals(df, keys, order, {out: amount}, bucket, {out: total} if total else None, descending)


def with_next(df: DataFrame, keys: list[str], order: str, bucket: Column, out: str = "next") -> DataFrame:
    """The following value of ``order`` per key (NULL for the last), looking across buckets only at their first values."""
    staged = df.withColumn("_bucket", bucket)
    firsts = staged.groupBy(*keys, "_bucket").agg(F.min(order).alias("_first"))
    ahead = firsts.withColumn("_ahead", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_bucket"))).drop("_first")
    inner = Window.partitionBy(*keys, "_bucket").orderBy(order)
    return staged.join(ahead, [*keys, "_bucket"]).withColumn(
        out, F.coalesce(F.lead(order).over(inner), F.col("_ahead"))).drop("_bucket", "_ahead")


def global_rank(df: DataFrame, hash_col: str, strata: list[str] | None = None, out: str = "rank",
                total: str | None = None, tie: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Zero-based rank by an evenly spread hash, exact over the whole table or per stratum."""
    strata = strata or []
    ranked = running_total(df, strata, [hash_col, *(tie or [])], F.lit(1).cast("bigint"),
                           hash_bucket(F.col(hash_col), digits), out, total)
    return ranked.withColumn(out, F.col(out) - 1)


def rank_by_text(df: DataFrame, text_col: str, out: str = "rank", total: str | None = None) -> DataFrame:
    """Zero-based rank in text order, over a bounded number of ranges of the text."""
    ranked = running_total(df, [], [text_col], F.lit(1).cast("bigint"), range_bucket(df, text_col), out, total)
    return ranked.withColumn(out, F.col(out) - 1)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    extra: dict[str, Column] | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles per key, whatever the size of a key.

    NULL and NaN values are dropped. ``extra`` are aggregates over the value histogram
    (columns ``value`` and ``_n``).
    """
    x = F.col(value).cast("double")
    hist = (df.select(*keys, x.alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
            .groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_n")))
    ranked = running_total(hist, keys, ["value"], F.col("_n"), value_bucket(F.col("value")), "_upto", "_total")
    before = F.col("_upto") - F.col("_n")

    def at(position: Column) -> Column:
        return F.max(F.when((before <= position) & (position < F.col("_upto")), F.col("value")))

    aggs, out = [F.max("_total").alias("n")], []
    for name, q in probs.items():
        position = F.lit(float(q)) * (F.col("_total") - 1)
        aggs += [at(F.floor(position)).alias(f"_{name}_lo"), at(F.ceil(position)).alias(f"_{name}_hi")]
        share = F.lit(float(q)) * (F.col("n") - 1) - F.floor(F.lit(float(q)) * (F.col("n") - 1))
        out.append((F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * share).alias(name))
    aggs += [c.alias(n) for n, c in (extra or {}).items()]
    grouped = ranked.groupBy(*keys).agg(*aggs) if keys else ranked.agg(*aggs)
    return grouped.select(*keys, "n", *out, *(extra or {}))


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: int = 1) -> DataFrame:
    """The first rows of each group; Spark trims every partition to ``limit`` rows per group before
    the shuffle (WindowGroupLimit, up to 1,000 rows), so a hot group never travels whole. Longer
    prefixes are exact too, but a hot group is then sorted in one task: rank those with ``running_totals``."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= limit).drop("_rn")
