"""Scans and sinks on real files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchwell.functions.spectral import BANDS
from patchwell.operators.audit import provenance_check
from patchwell.sources import archives as AR
from patchwell.sources import features as FT
from patchwell.sources import patchfiles as PF
from patchwell.sources import sinks as SK


def test_patch_files_are_decoded_and_checked(spark, tmp_path):
    image = np.arange(12 * 64 * 64, dtype="uint16").reshape(12, 64, 64)
    mask = np.zeros((1, 64, 64), dtype="uint8")
    mask[0, 0, :8] = (0, 99, 100, 199, 200, 253, 254, 255)
    np.save(tmp_path / "a_sen2.npy", image)
    np.save(tmp_path / "a_cyan.npy", mask)
    np.save(tmp_path / "b_cyan.npy", mask[0])
    np.save(tmp_path / "c_cyan.npy", mask.astype("int16"))
    np.save(tmp_path / "d_cyan.npy", np.array([object()]), allow_pickle=True)
    np.save(tmp_path / "e_cyan.npy", np.zeros(3_000_000, dtype="uint8"))
    masks = AR.decode_arrays(AR.binary_files(spark, str(tmp_path), "*_cyan.npy"), *AR.SHAPES["cyan"])
    assert [r.dn for r in AR.mask_pixels(masks.rows, ["path"]).where("row = 0 and col < 8").orderBy("col").collect()] == [0, 99, 100, 199, 200, 253, 254, 255]
    assert sorted(r.rule for r in masks.violations.collect()) == ["dtype", "shape", "too_large", "unreadable"]
    bands = AR.band_pixels(AR.decode_arrays(AR.binary_files(spark, str(tmp_path), "*_sen2.npy"), *AR.SHAPES["sen2"]).rows, ["path"], BANDS)
    r = bands.where("row = 1 and col = 2").first()
    assert [r[b] for b in BANDS] == [int(image[i, 1, 2]) for i in range(12)]


def saved(folder, name, array, **how):
    folder.mkdir(exist_ok=True)
    np.save(folder / f"{name}.npy", array, **how)


def test_patch_files_are_scanned_by_kind(spark, tmp_path):
    image = np.arange(12 * 64 * 64, dtype="uint16").reshape(12, 64, 64)
    mask = (np.arange(64 * 64) % 251).astype("uint8").reshape(1, 64, 64)
    for name, array in {"a_sen2": image, "a_cyan": mask, "b_b_sen2": np.asfortranarray(image), "b_b_cyan": mask[:, ::-1], "c_cyan": mask[0], "d_cyan": mask.astype("int16"), "e_sen2": image.astype(">u2"),
                        "f_cyan": np.zeros(3_000_000, dtype="uint8"), "g_cyan": np.array([object()]), "h_sen2": image, "other": mask}.items():
        saved(tmp_path / name[0], name, array)
    (tmp_path / "i_cyan.npy").write_bytes((tmp_path / "a" / "a_cyan.npy").read_bytes()[:-1])
    (tmp_path / "j_cyan.npy").write_bytes(b"")
    (tmp_path / "notes_cyan.txt").write_text("no patch")
    every = PF.scan(spark, str(tmp_path))
    assert {r.key: r.rule for r in every.violations.collect()} == {"c_cyan": "shape", "d_cyan": "dtype", "e_sen2": "dtype", "f_cyan": "too_large", "g_cyan": "shape", "i_cyan": "unreadable", "j_cyan": "unreadable"}
    masks = {r.sample_id: r["values"] for r in PF.scan(spark, f"file://{tmp_path}", "cyan").rows.collect()}
    assert masks == {"a": mask.ravel().tolist(), "b_b": mask[:, ::-1].ravel().tolist()}
    both = {r.sample_id: r for r in PF.pairs(spark, str(tmp_path)).collect()}
    assert set(both) == {"a", "b_b"} and all(r.image == image.ravel().tolist() for r in both.values())
    content = {r.path: (r.length, r.crc32, r.sha256) for r in PF.scan_digests(spark, str(tmp_path)).collect()}
    given = AR.binary_files(spark, str(tmp_path), "*_*.npy").select("path", *[c.alias(n) for n, c in AR.content_checks(F.col("content")).items()])
    empty_file = content.pop(str(tmp_path / "j_cyan.npy"))  # Spark's own binary files leave files without bytes out
    assert content == {r.path.removeprefix("file:"): (r.length, r.crc32, r.sha256) for r in given.collect()} and len(content) == 11 and empty_file[:2] == (0, "00000000")
    empty = tmp_path / "empty"
    empty.mkdir()
    assert PF.scan(spark, str(empty)).rows.count() == 0
    with pytest.raises(Exception, match="No shape is given"):
        PF.scan(spark, str(tmp_path), "tif").rows.count()


def test_patch_scan_is_dealt_by_bytes(tmp_path, monkeypatch):
    for i in range(40):
        saved(tmp_path, f"s{i}_cyan", np.zeros((1, 64, 64), dtype="uint8"))
    saved(tmp_path, "big_cyan", np.zeros(3_000_000, dtype="uint8"))
    monkeypatch.setattr(PF, "TASK_BYTES", 10 * (PF.OPEN_COST + 4224))
    scan = PF.PatchFiles({"path": str(tmp_path), "shapes": '{"cyan": [[1, 64, 64], "uint8"]}'}).reader(None)
    tasks = scan.partitions()
    assert [len(t.files) for t in tasks] in ([10, 10, 10, 10, 1], [10, 10, 10, 11]) and len({f for t in tasks for f in t.files}) == 41
    monkeypatch.setattr(PF, "BATCH_BYTES", 3 * 4 * 4096)
    assert [b.num_rows for b in scan.read(tasks[1])] == [3, 3, 3, 1]


def test_patch_writes_count_only_when_committed(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(60).select(F.col("id").cast("string").alias("sample_id"), F.lit("cyan").alias("kind"), F.unhex(F.lit("0102")).alias("content"), F.lit(1).alias("path")).repartition(5)
    broken = rows.withColumn("sample_id", F.when(F.col("sample_id") != "33", F.col("sample_id")))
    with pytest.raises(Exception, match="No patch file can be named"):
        PF.write(broken, path)
    PF.write(rows, path)  # what the broken write left is not seen
    (tmp_path / "t" / "part-lost").mkdir()
    (tmp_path / "t" / "part-lost" / "7_cyan.npy").write_bytes(b"x")
    assert sorted(int(r.sample_id) for r in PF.scan_digests(spark, path).collect()) == list(range(60))
    with pytest.raises(Exception, match="is committed"):
        PF.write(rows, path)
    PF.write(rows.where("false"), str(tmp_path / "none"))
    assert PF.scan_digests(spark, str(tmp_path / "none")).count() == 0


def test_archive_index_reads_all_entry_files(spark, tmp_path):
    head = ",".join(c.split()[0] for c in AR.ENTRY_SCHEMA.split(", "))
    for name in ("one", "two"):
        (tmp_path / f"{name}_entries.csv").write_text(head + f"\n{name}.zip,m,cyan,s,6_2,sub,2019-04-19,0,64,10,20,30,40,0000abcd,8\n")
    (tmp_path / "other.csv").write_text("x\n1\n")
    got = sorted((r.archive, r.index_name, r.header_offset) for r in AR.archive_index(spark, str(tmp_path)).collect())
    assert got == [("one.zip", "one", 10), ("two.zip", "two", 10)]


def test_large_archives_are_written_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SK, "PIECE_ROWS", 100)
    schema = "archive string, member string, header_offset bigint"
    data = [("a.1", f"m{i}", i) for i in range(1000)] + [("b", "m", 5)]
    path = str(tmp_path / "index")
    SK.write_named_csv(spark.createDataFrame(data, schema), path, "archive", "_entries.csv")
    pieces = sorted((tmp_path / "index" / "a.1_entries.csv").glob("part-*_entries.csv"))
    assert len(pieces) > 1 and max(len(p.read_text().splitlines()) for p in pieces) < 1000
    assert (tmp_path / "index" / "b_entries.csv").is_file()
    got = AR.archive_index(spark, path, schema).collect()
    assert sorted((r.archive, r.member, r.header_offset) for r in got) == sorted(data) and all(r.index_name == r.archive for r in got)


def test_frozen_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(50).withColumn("v", F.when(F.col("id") % 2 == 0, F.col("id")))
    first = SK.freeze(df, path)
    assert SK.freeze(df.orderBy(F.desc("id")).repartition(3), path) == first
    with pytest.raises(SK.FrozenTableDiffers):
        SK.freeze(df.union(df.limit(1)), path)
    with pytest.raises(SK.EmptyExport):
        SK.export(df.where("id < 0"), str(tmp_path / "e"))


def test_features_and_scenes(spark):
    texts = [(1, '{"properties":{"GNIS_Name":"L","OBJECTID":3},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4]]]}}'),
             (2, '{"properties":{},"geometry":{"type":"Point","coordinates":[0,0]}}'),
             (3, '{"properties":{},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[4,0],[4,4]]]]}}')]
    out = FT.features(spark.createDataFrame(texts, "id int, text string"), "id", "text")
    r = out.rows.first()
    assert r.geom == 1 and r.properties["gnis_name"] == "L" and len(r.parts[0][0]) == 5
    assert sorted((v.rule, v.key) for v in out.violations.where("rule <> 'empty_geometry'").collect()) == [("short_ring", "3"), ("unsupported_geometry", "2")]


def test_provenance(spark):
    docs = spark.createDataFrame([("d", '{"a":[{"b":7}],"samples":[1,2,3]}')], "source string, document string")
    claims = spark.createDataFrame([("d", "a/0/b", "7"), ("d", "len(samples)", "3"), ("d", "a/0/b", "8"), ("d", "x", "1"), ("z", "x", "1")], "source string, locator string, recorded string")
    got = [(r.locator, r.status) for r in provenance_check(claims, docs).orderBy("source", "locator", "recorded").collect()]
    assert got == [("a/0/b", "VERIFIED"), ("a/0/b", "DIFFERS"), ("len(samples)", "VERIFIED"), ("x", "LOCATOR_MISSING"), ("x", "SOURCE_MISSING")]
