"""Files by path: listing, magic bytes, and ranges of bytes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW, GZIP, BGZF = "raw", "gzip", "bgzf"
PREFIX = 18


def kind_of(prefix: bytes) -> str:
    """Transport by magic bytes; a file's name doesn't matter."""
    if is_bgzf_header(prefix):
        return BGZF
    return GZIP if prefix[:2] == b"\x1f\x8b" else RAW


def is_bgzf_header(b: bytes) -> bool:
    """A gzip member whose extra field starts with BC and a length of 2."""
    return len(b) >= 18 and b[:4] == b"\x1f\x8b\x08\x04" and b[10] + 256 * b[11] >= 6 and b[12:16] == b"BC\x02\x00"


def list_files(spark: SparkSession, path: str | list[str]) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a path, folder (with those in it) or pattern names, as Spark lists them; hidden files are left out."""
    jvm, found = spark._jvm, []

    def add(fs, status) -> None:
        if not status.isDirectory():
            found.append((status.getPath().toString(), status.getLen()))
            return
        for e in fs.listStatus(status.getPath()):
            if e.getPath().getName()[0] not in "._":
                add(fs, e)

    for p in [path] if isinstance(path, str) else path:
        root = jvm.org.apache.hadoop.fs.Path(p)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        got = fs.globStatus(root)
        if not got:
            raise FileNotFoundError(p)
        for status in got:
            add(fs, status)
    return sorted(found)


def _entries(folder: str) -> Iterator[tuple[str, int | None]]:
    """(path, bytes) of what a folder holds, but hidden entries; folders without bytes."""
    from pyarrow import fs

    system, name = file_system(folder)
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(name) as found:
            for e in found:
                if e.name[0] not in "._":
                    yield f"{folder.rstrip('/')}/{e.name}", None if e.is_dir() else e.stat().st_size
        return
    for e in system.get_file_info(fs.FileSelector(name)):
        if e.base_name[0] not in "._":
            yield f"{folder.rstrip('/')}/{e.base_name}", None if e.type == fs.FileType.Directory else e.size


def _listed(deep: bool) -> Callable:
    """What the folders of a column hold, and with deep what the folders in them do."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int | None]] = []
        for b in batches:
            left = b.column("path").to_pylist()
            while left:
                for path, size in _entries(left.pop()):
                    if deep and size is None:
                        left.append(path)
                    else:
                        rows.append((path, size))
                    if len(rows) == 4096:
                        yield _as_batch(rows)
                        rows = []
        yield _as_batch(rows)

    return listed


def _as_batch(rows: list[tuple[str, int | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["path", "size"])


def files_table(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, size) of the files that list_files names, as a table: tasks list the folders, so no row of them passes the driver."""
    jvm, files, folders = spark._jvm, [], []
    for p in [path] if isinstance(path, str) else path:
        root = jvm.org.apache.hadoop.fs.Path(p)
        got = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root)
        if not got:
            raise FileNotFoundError(p)
        for status in got:
            (folders if status.isDirectory() else files).append((status.getPath().toString(), status.getLen()))
    schema = "path string, size bigint"
    named = spark.createDataFrame(files, schema)
    if not folders:
        return named
    top = spark.createDataFrame(folders, schema).repartition(len(folders)).mapInArrow(_listed(False), schema)
    inner = top.where("size is null").repartition(spark.sparkContext.defaultParallelism).mapInArrow(_listed(True), schema)
    below = top.where("size is not null").union(inner)
    return named.union(below) if files else below


def file_system(path: str):
    """(pyarrow's file system, name in it) of a path or URI."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if colon and scheme != "file" and "/" not in scheme:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + rest.lstrip("/") if colon and scheme == "file" else path


def open_at(path: str, offset: int = 0) -> BinaryIO:
    """The file from an offset on; paths with a scheme other than file: by pyarrow's file systems."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme not in ("file",) and "/" not in scheme:
        system, name = file_system(path)
        f = system.open_input_file(name)
    else:
        f = open("/" + rest.lstrip("/") if colon and scheme == "file" else path, "rb")
    f.seek(offset)
    return f


def detect_kinds(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, size, kind) of each file, from its first 18 bytes."""

    @F.arrow_udf("string")
    def sniff(paths: pa.Array) -> pa.Array:
        out = []
        for p in paths.to_pylist():
            with open_at(p) as f:
                out.append(kind_of(f.read(PREFIX)))
        return pa.array(out, pa.string())

    files = spark.createDataFrame(list_files(spark, path) or [], "path string, size bigint")
    return files.withColumn("kind", sniff("path"))


@cache
def _local() -> str:
    top = tempfile.mkdtemp(prefix="strandframe-")
    atexit.register(shutil.rmtree, top, ignore_errors=True)
    return top


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or the local temp folder where Spark runs in one process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = _local()
    return f"{top}/{name}-{uuid.uuid4().hex}"
