"""Sources and sinks on data derived from the given tables: S1-S3, S8-S10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.spectral import BANDS
from ..operators.profiles import r6
from ..session import scratch_path
from ..sources import archives as AR
from ..sources import patchfiles as PF
from ..sources import sinks as SK
from .registry import Book
from .views import patch_vectors, patches, predictions, table, with_views

BOOK = Book()


@BOOK.add("s01_archive_index_scan", with_views("v_patch") + """select archive, archive as index_name, count(*) as entries, min(header_offset) as first_offset, sum(compressed_bytes)::bigint as compressed_bytes, count(distinct date) as dates
  from (select *, seq*400000+compressed_bytes as header_offset, day as date from v_patch) group by 1""")
def archive_index_scan(spark, sf):
    """Write the index as one CSV file per archive, then scan all of them."""
    path = scratch_path(spark, "index")
    entries = patches(spark, sf).select(
        "archive", F.concat("sample_id", F.lit("_cyan.npy")).alias("member"), F.lit("cyan").alias("kind"), "sample_id", "tile", "subtile_id", F.col("day").alias("date"),
        F.col("patch_row").cast("int").alias("patch_row"), F.col("patch_col").cast("int").alias("patch_col"),
        (F.col("seq") * 400000 + F.col("compressed_bytes")).alias("header_offset"), F.lit(0).cast("bigint").alias("span_bytes"), "compressed_bytes",
        F.lit(4224).cast("bigint").alias("size_bytes"), F.lpad(F.lower(F.hex(F.crc32("sample_id"))), 8, "0").alias("crc32"), F.lit(8).alias("compression"))
    SK.write_named_csv(entries, path, "archive", "_entries.csv")
    named = AR.archive_index(spark, path)
    return named.groupBy("archive", "index_name").agg(
        F.count(F.lit(1)).alias("entries"), F.min("header_offset").alias("first_offset"), F.sum("compressed_bytes").alias("compressed_bytes"), F.count_distinct("date").alias("dates"))


def npy_files(spark, sf):
    """An array file per embedding, built column-wise: an 8 x 8 byte mask with its header."""
    header = "{'descr': '|u1', 'fortran_order': False, 'shape': (1, 8, 8), }"
    text = header + " " * (128 - 10 - len(header) - 1) + "\n"
    prefix = "934E554D50590100" + f"{len(text) & 255:02X}{len(text) >> 8:02X}" + text.encode().hex().upper()
    v = F.transform("embedding", lambda x: F.lpad(F.hex(F.pmod(F.floor((x.cast("double") + 1) * 5000), F.lit(256))), 2, "0"))
    body = F.when(F.col("vec_id") % 50 == 3, F.array_join(F.slice(v, 1, 60), "")).otherwise(F.array_join(v, ""))
    start = F.when(F.col("vec_id") % 50 == 4, F.lit(prefix.replace("7C7531", "7C6931"))).otherwise(F.lit(prefix))
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.unhex(F.concat(start, body)).alias("content"))


@BOOK.add("s02_patch_scan", with_views("v_img") + """select sample_id, count(*) as pixels, sum(dn%256)::bigint as dn_sum, max(dn%256) as dn_max, max(case when "row"=7 and col=7 then dn%256 end) as last_dn from v_img where sample_id%50 not in (3,4) group by 1""")
def patch_scan(spark, sf):
    decoded = AR.decode_arrays(npy_files(spark, sf), (1, 8, 8), "uint8").rows
    px = AR.mask_pixels(decoded, ["path"], width=8)
    return px.groupBy(F.col("path").cast("bigint").alias("sample_id")).agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("dn").alias("dn_sum"), F.max("dn").alias("dn_max"),
        F.max(F.when((F.col("row") == 7) & (F.col("col") == 7), F.col("dn"))).alias("last_dn"))


def npy_images(spark, sf):
    """A 12-band array file per whole patch: little-endian unsigned 16-bit values of shape (12, 8, 8)."""
    header = "{'descr': '<u2', 'fortran_order': False, 'shape': (12, 8, 8), }"
    text = header + " " * (128 - 10 - len(header) - 1) + "\n"
    prefix = "934E554D50590100" + f"{len(text) & 255:02X}{len(text) >> 8:02X}" + text.encode().hex().upper()

    def word(x):
        dn = F.floor((x.cast("double") + 1) * 5000).cast("int")
        return F.concat(F.lpad(F.hex(dn % 256), 2, "0"), F.lpad(F.hex(F.floor(dn / 256)), 2, "0"))

    body = [F.array_join(F.transform(f"e{i}", word), "") for i in range(len(BANDS))]
    return patch_vectors(spark, sf).where(F.col("vectors") == len(BANDS)).select(F.col("patch").cast("string").alias("path"), F.unhex(F.concat(F.lit(prefix), *body)).alias("content"))


@BOOK.add("s02_image_scan", with_views("v_band") + "select pixel_id, " + ", ".join(BANDS) + " from v_band")
def image_scan(spark, sf):
    decoded = AR.decode_arrays(npy_images(spark, sf), (12, 8, 8), "uint16").rows
    px = AR.band_pixels(decoded, ["path"], BANDS, 8, 8)
    return px.select((F.col("path").cast("bigint") * 64 + F.col("pixel")).alias("pixel_id"), *BANDS)


@BOOK.add("s02_pair_scan", with_views("v_band", "v_img") + """select b.pixel_id, B05, dn%256 as mask_dn from v_band b join v_img m on m.sample_id=b.patch and m.idx=b.pixel_id%64 where m.sample_id%50 not in (3,4)""")
def pair_scan(spark, sf):
    """Pixels of image and mask side by side: both files of a sample decoded, joined by sample and place."""
    images = AR.band_pixels(AR.decode_arrays(npy_images(spark, sf), (12, 8, 8), "uint16").rows, ["path"], BANDS, 8, 8)
    masks = AR.mask_pixels(AR.decode_arrays(npy_files(spark, sf), (1, 8, 8), "uint8").rows, ["path"], width=8)
    both = images.join(masks.select("path", F.col("row"), F.col("col"), F.col("dn").alias("mask_dn")), ["path", "row", "col"])
    return both.select((F.col("path").cast("bigint") * 64 + F.col("pixel")).alias("pixel_id"), "B05", "mask_dn")


@BOOK.add("s02_patch_rejects", """select case when vec_id%50=3 then 'unreadable' else 'dtype' end as rule, vec_id::varchar as key from embeddings where vec_id%50 in (3,4)""")
def patch_rejects(spark, sf):
    return AR.decode_arrays(npy_files(spark, sf), (1, 8, 8), "uint8").violations.select("rule", "key")


# The patches of the given tables are smaller than the stored ones.
_SHAPES = {"sen2": ((12, 8, 8), "uint16"), "cyan": ((1, 8, 8), "uint8")}


def patch_folder(spark, sf):
    """Image and mask files of all patches, written to the shared folder; its path."""
    path = scratch_path(spark, "patches")
    named = [d.select(F.col("path").alias("sample_id"), F.lit(kind).alias("kind"), "content") for kind, d in (("sen2", npy_images(spark, sf)), ("cyan", npy_files(spark, sf)))]
    PF.write(named[0].unionByName(named[1]), path)
    return path


@BOOK.add("s02_file_pairs", with_views("v_band", "v_img") + """select b.patch as sample_id, count(*) as pixels, sum(B05)::bigint as b05_sum, sum(B11)::bigint as b11_sum, sum(dn%256)::bigint as mask_sum, sum(B05) filter (dn%256<128)::bigint as low_b05
  from v_band b join v_img m on m.sample_id=b.patch and m.idx=b.pixel_id%64 where m.sample_id%50 not in (3,4) group by 1""")
def file_pairs(spark, sf):
    """Write the files of both kinds, scan each kind, join the pairs of a sample; arrays stay whole."""
    both = PF.pairs(spark, patch_folder(spark, sf), shapes=_SHAPES)

    def band(name):
        return F.slice("image", 64 * BANDS.index(name) + 1, 64)

    def total(values):
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v)

    low = F.filter(F.arrays_zip(band("B05").alias("v"), F.col("mask").alias("m")), lambda x: x["m"] < 128)
    return both.select(F.col("sample_id").cast("bigint").alias("sample_id"), F.size("mask").cast("bigint").alias("pixels"), total(band("B05")).alias("b05_sum"), total(band("B11")).alias("b11_sum"),
                       total(F.col("mask")).alias("mask_sum"), F.when(F.size(low) > 0, total(F.transform(low, lambda x: x["v"]))).alias("low_b05"))


@BOOK.add("s02_file_rejects", """select case when vec_id%50=3 then 'unreadable' else 'dtype' end as rule, vec_id||'_cyan' as key from embeddings where vec_id%50 in (3,4)""")
def file_rejects(spark, sf):
    """Files of both kinds that the scan refuses: short bodies and signed types."""
    return PF.scan(spark, patch_folder(spark, sf), shapes=_SHAPES).violations.select("rule", "key")


@BOOK.add("s03_file_verification", """select vec_id::varchar as sample_id, case when vec_id%7=1 then 'MISSING' when vec_id%7=2 then 'HASH_MISMATCH' else 'VERIFIED' end as status,
  case when vec_id%7<>1 then 128+case when vec_id%50=3 then 60 else 64 end end as bytes from embeddings""")
def file_verification(spark, sf):
    """The index of mask files against the files: one in seven was never written, another one has a flipped byte."""
    index = npy_files(spark, sf).select(F.col("path").alias("sample_id"), "content")
    m = F.col("sample_id").cast("bigint") % 7
    last = F.right(F.hex("content"), F.lit(2))
    flipped = F.unhex(F.concat(F.expr("left(hex(content), length(hex(content)) - 2)"), F.when(last == "00", "01").otherwise("00")))
    path = scratch_path(spark, "verified")
    PF.write(index.where(m != 1).select("sample_id", F.lit("cyan").alias("kind"), F.when(m == 2, flipped).otherwise(F.col("content")).alias("content")), path)
    expected = index.select("sample_id", *[c.alias(n) for n, c in AR.content_checks(F.col("content")).items()])
    return AR.verify_digests(expected, PF.scan_digests(spark, path, "cyan", _SHAPES), "sample_id")


@BOOK.add("s03_content_verification", """select doc_id, case when doc_id%7=1 then 'MISSING' when doc_id%7=2 then 'HASH_MISMATCH' else 'VERIFIED' end as status, case when doc_id%7<>1 then strlen(text)+case when doc_id%7=2 then 1 else 0 end end as bytes, sha256(text) as sha256 from documents""")
def content_verification(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    m = F.col("doc_id") % 7
    expected = d.select("doc_id", *[c.alias(n) for n, c in AR.content_checks(F.col("content")).items()])
    files = d.where(m != 1).select("doc_id", F.when(m == 2, F.concat("content", F.encode(F.lit("x"), "UTF-8"))).otherwise(F.col("content")).alias("content"))
    return AR.verify_contents(expected, files, "doc_id").join(expected.select("doc_id", "sha256"), "doc_id")


@BOOK.add("s08_write_once_sink", """select s as step, true as accepted from unnest(['first','replay']) t(s) union all select 'changed', false where (select count(*) from customer)>0""")
def write_once(spark, sf):
    """Freeze a membership table, replay it from another partitioning, then try to change it."""
    path = scratch_path(spark, "frozen")
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    steps = []
    for step, df in (("first", rows), ("replay", rows.repartition(5, "c_mktsegment")), ("changed", rows.where(F.col("c_custkey") > 0))):
        try:
            SK.freeze(df, path)
            steps.append((step, True))
        except SK.FrozenTableDiffers:
            steps.append((step, False))
    kept = spark.read.parquet(path).groupBy().agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame(steps, "step string, accepted boolean").join(F.broadcast(kept)).where("n > 0").drop("n")


@BOOK.add("s09_guarded_export", "select n_nationkey, n_name, count(c_custkey) as customers, round(coalesce(sum(c_acctbal),0),2) as balance from nation left join customer on n_nationkey=c_nationkey group by 1,2")
def guarded_export(spark, sf):
    """Export a table as CSV and read it back with its schema."""
    path = scratch_path(spark, "export")
    n = table(spark, sf, "nation")
    out = n.join(table(spark, sf, "customer"), n["n_nationkey"] == F.col("c_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(
        F.count("c_custkey").alias("customers"), F.round(F.coalesce(F.sum("c_acctbal"), F.lit(0.0)), 2).alias("balance"))
    SK.export(out, path)
    return spark.read.schema(out.schema).option("header", True).csv(path)


@BOOK.add("s10_prediction_cache", with_views("v_pred") + """select model as experiment_id, count(*) as pixels, sum(pred)::bigint as pred_sum, round(avg(p2),6) as mean_high from v_pred where partition='test' group by 1""")
def prediction_cache(spark, sf):
    cached = SK.cache_predictions(predictions(spark, sf).withColumnRenamed("model", "experiment_id"), scratch_path(spark, "predictions"))
    return cached.where(F.col("partition") == "test").groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("pred").alias("pred_sum"), r6(F.avg(F.col("prob")[2])).alias("mean_high"))
