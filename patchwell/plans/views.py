"""The given tables seen as patches, pixels, bands and logits: DataFrames and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spectral import BANDS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """One row per reference pixel: ``sample_id, pixel, row, col, day, tile, dn``."""
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("sample_id"), e.alias("pixel"),
        F.expr("cast(event_id div 8 % 8 as int)").alias("row"), F.expr("cast(event_id % 8 as int)").alias("col"),
        F.col("ts").cast("date").alias("day"), F.concat(F.lit("T"), (F.col("user_id") % 4).cast("string")).alias("tile"),
        ((e * 37 + F.floor("value").cast("bigint")) % 260).cast("int").alias("dn"))


def patches(spark: SparkSession, sf: str) -> DataFrame:
    """One row per patch with the parts its archive name is made of."""
    c, k = "o_custkey", "o_orderkey"
    base = table(spark, sf, "orders").select(
        F.col(k).alias("seq"), F.expr(f"({c} * 31 % 97) % 5 + 5 * ({c} div 1600)").alias("tile_no"),
        F.expr(f"{c} % 40 * 50").alias("x"), F.expr(f"{c} div 40 % 40 * 50").alias("y"),
        F.col("o_orderdate").cast("date").alias("day"), F.expr(f"{k} % 8 * 64").alias("patch_row"),
        F.expr(f"{k} div 8 % 8 * 64").alias("patch_col"),
        F.floor("o_totalprice").cast("bigint").alias("compressed_bytes"),
        F.col("o_orderstatus").alias("status"))
    named = base.withColumn("tile", F.concat(F.col("tile_no").cast("string"), F.lit("_2"))).withColumn(
        "subtile_id", F.format_string("%s_X%04d_Y%04d_S050", "tile", "x", "y"))
    return named.withColumn("sample_id", F.format_string(
        "%s_%s_x%d_y%d_64x64_%d", "subtile_id", F.date_format("day", "yyyy_MM_dd"), "patch_row", "patch_col", "seq")
    ).withColumn("archive", F.concat(F.lit("archive_"), (F.col("tile_no") % 6).cast("string")))


def census(spark: SparkSession, sf: str) -> DataFrame:
    """Patches with their class pixel counts."""
    flag = F.col("l_returnflag")
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(
        F.sum(F.when(flag == "N", F.col("l_quantity"))).alias("_l"),
        F.sum(F.when(flag == "A", F.col("l_quantity"))).alias("_m"),
        F.sum(F.when((flag == "R") & (F.col("l_quantity") > 40), F.col("l_quantity"))).alias("_h"))
    return patches(spark, sf).join(counts, "seq", "left").withColumns({
        n: F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for n, c in
        (("low_pixels", "_l"), ("moderate_pixels", "_m"), ("high_pixels", "_h"))}).drop("_l", "_m", "_h")


def split_of(text) -> F.Column:
    """train/validation/test by the first hex digit of the salted hash of ``text``."""
    d = F.substring(F.sha2(F.concat(F.lit("35042:"), text), 256), 1, 1)
    return F.when(d.isin("0", "1", "2"), "test").when(d.isin("3", "4"), "validation").otherwise("train")


def patch_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve consecutive embeddings are the bands of one 8x8 patch: ``patch, vectors, label, e0..e11`` (``vectors`` of them are there)."""
    b = F.col("vec_id") % len(BANDS)
    each = [F.any_value(F.when(b == i, F.col("embedding")), ignoreNulls=True).alias(f"e{i}") for i in range(len(BANDS))]
    return table(spark, sf, "embeddings").groupBy(F.expr(f"vec_id div {len(BANDS)}").alias("patch")).agg(
        F.count(F.lit(1)).alias("vectors"), F.max(F.when(b == 0, F.col("label"))).alias("label"), *each)


def bands(spark: SparkSession, sf: str) -> DataFrame:
    """One 12-band pixel per value of each whole patch: ``pixel_id, patch, row, col, B01..B12, y, region, split``."""
    whole = patch_vectors(spark, sf).where(F.col("vectors") == len(BANDS)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return whole.select(
        (F.col("patch") * 64 + F.col("i")).alias("pixel_id"), "patch", F.expr("cast(i div 8 as int)").alias("row"), (F.col("i") % 8).alias("col"),
        *[F.floor((F.col(f"e{n}")[F.col("i")].cast("double") + 1) * 5000).cast("int").alias(b) for n, b in enumerate(BANDS)],
        ((F.col("label") + F.col("i")) % 3).alias("y"), F.concat(F.lit("R"), (F.col("patch") % 5).cast("string")).alias("region"),
        split_of(F.col("patch").cast("string")).alias("split"))


def image(spark: SparkSession, sf: str) -> DataFrame:
    """8x8 single-band patches: ``sample_id, idx, row, col, dn`` (one row per pixel)."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.posexplode("embedding").alias("idx", "v")).select(
        "sample_id", "idx", F.expr("idx div 8").cast("int").alias("row"), (F.col("idx") % 8).cast("int").alias("col"),
        F.floor((F.col("v").cast("double") + 1) * 5000).cast("int").alias("dn"))


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """Two models' logits per pixel: ``pixel, sample_id, region, partition, y, model, logits``."""
    e = F.col("event_id")
    z = [((e * m) % 1000).cast("double") / 200 for m in (7919, 104729, 1299709)]
    base = table(spark, sf, "events").select(
        e.alias("pixel"), F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("sample_id"),
        F.concat(F.lit("R"), (F.col("user_id") % 5).cast("string")).alias("region"),
        F.when(F.col("user_id") % 2 == 0, "validation").otherwise("test").alias("partition"),
        F.when(F.col("event_type").isin("click", "signup"), 0).when(F.col("event_type") == "view", 1)
        .when(F.col("event_type") == "purchase", 2).alias("y"), *[c.alias(f"z{i}") for i, c in enumerate(z)])
    bump = F.when(F.col("y") == 0, 1.0).otherwise(0.0)
    models = F.array(
        F.struct(F.lit("A").alias("model"), F.array(F.col("z0") + bump, F.col("z1"), F.col("z2")).alias("logits")),
        F.struct(F.lit("B").alias("model"), F.array(F.col("z1") + bump, F.col("z2"), F.col("z0")).alias("logits")))
    return base.select("pixel", "sample_id", "region", "partition", "y", F.explode(models).alias("m")).select(
        "pixel", "sample_id", "region", "partition", "y", "m.model", "m.logits")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Logits turned into probabilities and the predicted class."""
    from ..functions.probability import argmax, softmax
    return logits(spark, sf).withColumns({"prob": softmax(F.col("logits")), "pred": argmax(F.col("logits"))})


_SPLIT = ("case when substr(sha256('35042:'||{k}),1,1) in ('0','1','2') then 'test' "
          "when substr(sha256('35042:'||{k}),1,1) in ('3','4') then 'validation' else 'train' end")

SQL_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "v_px": ("""select 'P'||user_id as sample_id, event_id as pixel, cast(event_id//8%8 as int) as "row",
        cast(event_id%8 as int) as col, cast(ts as date) as day, 'T'||(user_id%4) as tile,
        cast((event_id*37+cast(floor(value) as bigint))%260 as int) as dn from events""", ()),
    "v_patch0": ("""select o_orderkey as seq, (o_custkey*31%97)%5+5*(o_custkey//1600) as tile_no,
        o_custkey%40*50 as x, o_custkey//40%40*50 as y, cast(o_orderdate as date) as day,
        o_orderkey%8*64 as patch_row, o_orderkey//8%8*64 as patch_col,
        cast(floor(o_totalprice) as bigint) as compressed_bytes, o_orderstatus as status from orders""", ()),
    "v_patch": ("""select *, tile_no||'_2' as tile,
        printf('%s_2_X%04d_Y%04d_S050', cast(tile_no as varchar), x, y) as subtile_id,
        printf('%s_2_X%04d_Y%04d_S050_%s_x%d_y%d_64x64_%d', cast(tile_no as varchar), x, y, strftime(day,'%Y_%m_%d'),
               patch_row, patch_col, seq) as sample_id, 'archive_'||(tile_no%6) as archive from v_patch0""", ("v_patch0",)),
    "v_counts": ("""select l_orderkey as seq, sum(case when l_returnflag='N' then l_quantity end) as ql,
        sum(case when l_returnflag='A' then l_quantity end) as qm,
        sum(case when l_returnflag='R' and l_quantity>40 then l_quantity end) as qh from lineitem group by 1""", ()),
    "v_census": ("""select p.*, coalesce(cast(ql as bigint),0) as low_pixels, coalesce(cast(qm as bigint),0) as moderate_pixels,
        coalesce(cast(qh as bigint),0) as high_pixels from v_patch p left join v_counts c using (seq)""", ("v_patch", "v_counts")),
    "v_whole": ("select vec_id//12 as patch, max(label) filter (vec_id%12=0) as label, " + ", ".join(
        f"any_value(embedding) filter (vec_id%12={i}) as e{i}" for i in range(len(BANDS))) + " from embeddings group by 1 having count(*)=12", ()),
    "v_band": ("select patch*64+i as pixel_id, patch, cast(i//8 as int) as \"row\", cast(i%8 as int) as col, " + ", ".join(
        f"cast(floor((cast(e{n}[i+1] as double)+1)*5000) as int) as {b}" for n, b in enumerate(BANDS))
        + f", cast((label+i)%3 as int) as y, 'R'||(patch%5) as region, {_SPLIT.format(k='patch')} as split from v_whole, range(0,64) t(i)", ("v_whole",)),
    "v_img": ("""select vec_id as sample_id, i-1 as idx, cast((i-1)//8 as int) as "row", cast((i-1)%8 as int) as col,
        cast(floor((cast(embedding[i] as double)+1)*5000) as int) as dn from embeddings, range(1,65) t(i)""", ()),
    "v_z": ("""select event_id as pixel, 'P'||user_id as sample_id, 'R'||(user_id%5) as region,
        case when user_id%2=0 then 'validation' else 'test' end as partition,
        case when event_type in ('click','signup') then 0 when event_type='view' then 1 when event_type='purchase' then 2 end as y,
        (event_id*7919%1000)/200.0::double as z0, (event_id*104729%1000)/200.0::double as z1,
        (event_id*1299709%1000)/200.0::double as z2 from events""", ()),
    "v_logit": ("""select pixel, sample_id, region, partition, y, 'A' as model, z0+case when y=0 then 1.0 else 0.0 end as a, z1 as b, z2 as c from v_z
        union all select pixel, sample_id, region, partition, y, 'B', z1+case when y=0 then 1.0 else 0.0 end, z2, z0 from v_z""", ("v_z",)),
    "v_pred": ("""select *, exp(a-m)/s as p0, exp(b-m)/s as p1, exp(c-m)/s as p2,
        case when a>=b and a>=c then 0 when b>=c then 1 else 2 end as pred
        from (select *, greatest(a,b,c) as m, exp(a-greatest(a,b,c))+exp(b-greatest(a,b,c))+exp(c-greatest(a,b,c)) as s from v_logit)""",
               ("v_logit",)),
}


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause that defines the named views and what they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in SQL_VIEWS[name][1]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    head = "with recursive " if recursive else "with "
    return head + ",\n".join(f"{n} as ({SQL_VIEWS[n][0]})" for n in ordered) + "\n"
