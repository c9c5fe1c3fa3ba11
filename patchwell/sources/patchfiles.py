"""Patch files as a Spark data source: one array file per sample and kind, scanned and written by tasks.

Files are called ``<sample_id>_<kind>.npy``. A scan deals them to tasks by their bytes, reads only the asked kind and looks
at the header of a file before its body: what is too large is never opened, what has another shape or type is never read.
A write gives each task attempt its own folder below the target; the driver then names the folders that count in
``_committed.json``. A scan of such a target ignores all other folders, so lost executors, second attempts and broken
writes leave nothing that can be seen.

Defined results: a refused file is a row with a reason and no values; an empty folder gives no rows; an unknown kind is an
error; writing to a target that is committed already is refused; a null sample, kind or content is refused.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..checks import Checked
from .archives import MAX_BYTES, SHAPES

FORMAT = "patch_files"
MANIFEST = "_committed.json"
HEADER_BYTES = 4096
TASK_BYTES = 64 << 20   # files of one task
OPEN_COST = 128 << 10   # what opening a file counts for: at most 512 small files a task
BATCH_BYTES = 8 << 20   # decoded values of one output batch
CHUNK = 1 << 20

ARRAYS = "path string, kind string, sample_id string, length bigint, values array<int>, reject string"
DIGESTS = "path string, kind string, sample_id string, length bigint, crc32 string, sha256 string"


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a folder, local or by its scheme."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _kind_of(name: str, kinds: list[str]) -> tuple[str, str] | None:
    """Sample and kind of a file name, or nothing where it is no patch file."""
    stem, dot, suffix = name.rpartition(".")
    sample, line, kind = stem.rpartition("_")
    return (sample, kind) if dot and line and suffix == "npy" and kind in kinds else None


def _header(start: bytes) -> tuple[tuple[int, ...], bool, np.dtype, int] | None:
    """Shape, column order, type and place of the body; nothing where the bytes are no array header."""
    f = io.BytesIO(start)
    try:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        return *read(f), f.tell()
    except (ValueError, EOFError):
        return None


def _values(f, length: int, shape: tuple[int, ...], dtype: np.dtype) -> tuple[np.ndarray | None, str | None]:
    """Flat values of an open file, or the reason it is refused; the body is read last."""
    head = _header(f.read(min(length, HEADER_BYTES)))
    if head is None:
        return None, "unreadable"
    seen, by_column, kind, at = head
    if seen != shape:
        return None, "shape"
    if kind != dtype:
        return None, "dtype"
    size = dtype.itemsize * int(np.prod(shape))
    if length < at + size:
        return None, "unreadable"
    f.seek(at)
    array = np.frombuffer(f.read(size), dtype)
    return (array.reshape(shape[::-1]).T.ravel() if by_column else array), None


@dataclass
class _Files(InputPartition):
    """Files of one task: (path, kind, sample, length)."""

    files: list[tuple[str, str, str, int]]

    def __post_init__(self) -> None:
        super().__init__(None)


class _Scan(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.digests = options["path"], options.get("digests") == "true"
        self.shapes = {k: (tuple(s), d) for k, (s, d) in json.loads(options["shapes"]).items()}
        self.kinds = [options["kind"]] if options.get("kind") else sorted(self.shapes)
        unknown = set(self.kinds) - set(self.shapes)
        if unknown:
            raise ValueError(f"No shape is given for kind {unknown.pop()}")

    def partitions(self) -> list[_Files]:
        store, root = _folder(self.path)
        manifest = f"{root}/{MANIFEST}"
        folders = [root]
        if store.get_file_info(manifest).type == pafs.FileType.File:
            with store.open_input_stream(manifest) as f:
                folders = [f"{root}/{name}" for name in json.loads(f.read())]
        tasks, room = [_Files([])], TASK_BYTES
        for folder in folders:
            for info in sorted(store.get_file_info(pafs.FileSelector(folder, recursive=True)), key=lambda i: i.path):
                named = _kind_of(info.base_name, self.kinds) if info.type == pafs.FileType.File else None
                if named is None:
                    continue
                cost = OPEN_COST + (info.size if self.digests or info.size <= MAX_BYTES else 0)
                if cost > room and tasks[-1].files:
                    tasks.append(_Files([]))
                    room = TASK_BYTES
                tasks[-1].files.append((info.path, named[1], named[0], info.size))
                room -= cost
        return tasks

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = _folder(self.path)
        return self._digested(store, partition.files) if self.digests else self._decoded(store, partition.files)

    def _decoded(self, store: pafs.FileSystem, files: list[tuple[str, str, str, int]]) -> Iterator[pa.RecordBatch]:
        shapes = {k: (s, np.dtype(d)) for k, (s, d) in self.shapes.items()}
        rows, held = [], 0
        for n, (path, kind, sample, length) in enumerate(files):
            if length > MAX_BYTES:
                values, reject = None, "too_large"
            else:
                with store.open_input_file(path) as f:
                    values, reject = _values(f, length, *shapes[kind])
            rows.append((path, kind, sample, length, values, reject))
            held += 4 * len(values) if values is not None else 0
            if held >= BATCH_BYTES or n == len(files) - 1:
                flat = [v.astype("int32") for *_, v, _ in rows if v is not None]
                ends = np.cumsum([0] + [0 if r[4] is None else len(r[4]) for r in rows])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else [], pa.int32()),
                                                 mask=pa.array([r[4] is None for r in rows]))
                names = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*names, lists, pa.array([r[5] for r in rows], pa.string())],
                                                 names=["path", "kind", "sample_id", "length", "values", "reject"])
                rows, held = [], 0

    @staticmethod
    def _digested(store: pafs.FileSystem, files: list[tuple[str, str, str, int]]) -> Iterator[tuple]:
        for path, kind, sample, length in files:
            crc, sha = 0, hashlib.sha256()
            with store.open_input_stream(path) as f:
                while chunk := f.read(CHUNK):
                    crc = zlib.crc32(chunk, crc)
                    sha.update(chunk)
            yield path, kind, sample, length, f"{crc:08x}", sha.hexdigest()


@dataclass
class _Folder(WriterCommitMessage):
    name: str
    files: int


class _Sink(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        store, root = _folder(self.path)
        if store.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            raise FileExistsError(f"{self.path} is committed")

    def write(self, rows: Iterator) -> _Folder:
        store, root = _folder(self.path)
        name, n = f"part-{uuid.uuid4().hex}", 0
        for row in rows:
            if row.sample_id is None or row.kind is None or row.content is None or "/" in row.sample_id + row.kind:
                raise ValueError(f"No patch file can be named {row.sample_id}_{row.kind}")
            if not n:
                store.create_dir(f"{root}/{name}", recursive=True)
            with store.open_output_stream(f"{root}/{name}/{row.sample_id}_{row.kind}.npy") as f:
                f.write(bytes(row.content))
            n += 1
        return _Folder(name, n)

    def commit(self, messages: list[_Folder | None]) -> None:
        store, root = _folder(self.path)
        store.create_dir(root, recursive=True)
        done = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
        with store.open_output_stream(done) as f:
            f.write(json.dumps([m.name for m in messages if m and m.files]).encode())
        store.move(done, f"{root}/{MANIFEST}")

    def abort(self, messages: list[_Folder | None]) -> None:
        store, root = _folder(self.path)
        for m in messages:
            if m and m.files:
                store.delete_dir(f"{root}/{m.name}")


class PatchFiles(DataSource):
    """``spark.read.format("patch_files")`` after ``spark.dataSource.register(PatchFiles)``.

    Options: path, kind (all if unset), shapes (JSON: kind to shape and type), digests ("true": length, CRC-32 and SHA-256
    of whole files instead of values).
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return DIGESTS if self.options.get("digests") == "true" else ARRAYS

    def reader(self, schema) -> _Scan:
        return _Scan(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Sink:
        return _Sink(dict(self.options))


def _read(spark: SparkSession, path: str, kind: str | None, shapes: dict, digests: bool) -> DataFrame:
    spark.dataSource.register(PatchFiles)
    options = {"path": path, "shapes": json.dumps(shapes), "digests": str(digests).lower()}
    return spark.read.format(FORMAT).options(**options, **({"kind": kind} if kind else {})).load()


def scan(spark: SparkSession, path: str, kind: str | None = None, shapes: dict = SHAPES) -> Checked:
    """Flat values of every patch file below a path; refused files are violations."""
    rows = _read(spark, path, kind, shapes, digests=False)
    bad = rows.where(F.col("reject").isNotNull()).select(F.col("reject").alias("rule"), F.concat_ws("_", "sample_id", "kind").alias("key"), F.col("path").alias("detail"))
    return Checked(rows.where(F.col("reject").isNull()).drop("reject"), bad)


def scan_digests(spark: SparkSession, path: str, kind: str | None = None, shapes: dict = SHAPES) -> DataFrame:
    """Length, CRC-32 and SHA-256 of every patch file below a path, streamed in pieces of a megabyte."""
    return _read(spark, path, kind, shapes, digests=True)


def write(files: DataFrame, path: str) -> None:
    """Writes ``sample_id, kind, content`` as patch files, once for each row."""
    files.sparkSession.dataSource.register(PatchFiles)
    files.select("sample_id", "kind", "content").write.format(FORMAT).mode("append").option("path", path).save()


def pairs(spark: SparkSession, path: str, image: str = "sen2", mask: str = "cyan", shapes: dict = SHAPES) -> DataFrame:
    """``sample_id, image, mask``: flat values of both files of each sample that has two good ones."""
    of = {k: scan(spark, path, k, shapes).rows for k in (image, mask)}
    return of[image].select("sample_id", F.col("values").alias("image")).join(of[mask].select("sample_id", F.col("values").alias("mask")), "sample_id")
