"""Writers: FASTQ, FASTA and .fai text, and block gzip."""

from __future__ import annotations

import bisect
import contextlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import bgzf
from .files import file_system, list_files, open_at, scratch


def fastq_text(name: Column | str, seq: Column | str, qual: Column | str, plus: str = "+", eol: str = "\n") -> Column:
    """The four lines of a record without the last line break; name has its @."""
    return F.concat(name, F.lit(eol), seq, F.lit(f"{eol}{plus}{eol}"), qual) if eol == "\n" else F.concat(name, F.lit(eol), seq, F.lit(f"{eol}{plus}{eol}"), qual, F.lit("\r"))


def fasta_text(name: Column | str, seq: Column | str, width: int | None = None) -> Column:
    """Header and sequence, in lines of `width` bases if given, without the last line break."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    body = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n") if width else seq
    return F.concat(name, F.lit("\n"), body)


def _ordered(df: DataFrame, order: str | list[str], files: int | None) -> DataFrame:
    """df by ranges of `order`, sorted; as many as the session's shuffle partitions if no number is given."""
    order = [order] if isinstance(order, str) else order
    files = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartitionByRange(files, *order) if files > 1 else df.coalesce(1)).sortWithinPartitions(*order)


def write_text(df: DataFrame, path: str, order: str | list[str], compression: str | None = None, files: int | None = None) -> None:
    """The column `value` in lines, sorted by `order`: range-partitioned, so files in name order hold the rows in order."""
    rows = _ordered(df, order, files)
    rows.select("value").write.option("lineSep", "\n").text(path, compression=compression or "none")


@dataclass
class _Part(WriterCommitMessage):
    path: str


class _BgzfWriter(DataSourceArrowWriter):
    """Each task writes a part of its own beside the others; the commit gives it its name. Parts of failed tasks go.

    The folder is one that all tasks see: a shared mount, or a store that pyarrow's file systems reach.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = file_system(self.path)
        system.create_dir(folder)
        name = f"{folder}/.part-{context.partitionId():05d}-{context.taskAttemptId()}"
        held, some = b"", False
        with system.open_output_stream(name) as f:
            for batch in batches:
                held += b"".join(v + b"\n" for v in batch.column(0).cast(pa.binary()).to_pylist() if v is not None)
                some = some or batch.num_rows > 0
                whole = len(held) - len(held) % bgzf.PAYLOAD
                for i in range(0, whole, bgzf.PAYLOAD):
                    f.write(bgzf.deflate(held[i : i + bgzf.PAYLOAD]))
                held = held[whole:]
            if held:
                f.write(bgzf.deflate(held))
            f.write(bgzf.EOF_BLOCK)
        if not some:
            system.delete_file(name)
        return _Part(name if some else "")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            if m and m.path:
                folder, _, name = m.path.rpartition("/")
                system.move(m.path, f"{folder}/{name[1:].rpartition('-')[0]}.bgz")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            if m and m.path:
                with contextlib.suppress(OSError):
                    system.delete_file(m.path)


class BgzfDataSource(DataSource):
    """df.write.format("bgzf").save(path): the single string or binary column, a line a row, blocks of 60 KiB; a whole file a partition."""

    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _BgzfWriter(self.options["path"])


def write_bgzf(df: DataFrame, path: str, order: str | list[str], files: int | None = None) -> None:
    """The column `value` in lines, sorted by `order`, as block gzip; ranges of it to files, as in write_text."""
    df.sparkSession.dataSource.register(BgzfDataSource)
    _ordered(df, order, files).select("value").write.format("bgzf").mode("append").save(path)


#: Blocks that a task compresses into one part, and bytes that a task copies.
BLOCKS_AT_ONCE = 512
COPIED_AT_ONCE = 64 << 20


def _in_order(found: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Parts by their numbers, of which names of Spark's have five digits or more."""
    return sorted(found, key=lambda f: [int(n) for n in re.findall(r"part-(\d+)", f[0].rpartition("/")[2])])


def _stream_bytes(files: list[tuple[str, int]], ends: list[int], start: int, end: int) -> Iterator[bytes]:
    """Bytes start to end of files that stand behind one another; ends: where each ends."""
    k = bisect.bisect_right(ends, start)
    while start < end:
        path, size = files[k]
        with open_at(path, start - (ends[k] - size)) as f:
            data = f.read(min(end, ends[k]) - start)
        yield data
        start, k = start + len(data), k + 1


def _ends(files: list[tuple[str, int]]) -> list[int]:
    out, n = [], 0
    for _, size in files:
        n += size
        out.append(n)
    return out


def compress_bgzf(spark: SparkSession, parts: list[tuple[str, int]], folder: str, blocks_at_once: int = BLOCKS_AT_ONCE) -> list[tuple[str, int]]:
    """(path, bytes) of the parts of one block-gzip stream, compressed by tasks from files that are one raw stream in this order.

    A part holds whole blocks of 60 KiB of the stream, wherever the files end, so blocks are those that one
    writer would make; only the last part has the end block. A part is written beside its place and moved, so
    a task that runs again does no harm.
    """
    ends = _ends(parts)
    total, step = ends[-1] if ends else 0, blocks_at_once * bgzf.PAYLOAD
    n = max(1, -(-total // step))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(folder)
        system.create_dir(top)
        for b in batches:
            for unit in b.column(0).to_pylist():
                hidden, held = f"{top}/.{uuid.uuid4().hex}", b""
                with system.open_output_stream(hidden) as f:
                    for data in _stream_bytes(parts, ends, unit * step, min(total, (unit + 1) * step)):
                        held += data
                        whole = len(held) - len(held) % bgzf.PAYLOAD
                        for i in range(0, whole, bgzf.PAYLOAD):
                            f.write(bgzf.deflate(held[i : i + bgzf.PAYLOAD]))
                        held = held[whole:]
                    if held:
                        f.write(bgzf.deflate(held))
                    if unit == n - 1:
                        f.write(bgzf.EOF_BLOCK)
                system.move(hidden, f"{top}/part-{unit:08d}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    spark.range(0, n, 1, min(n, 10_000)).mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    return _in_order(list_files(spark, folder))


def join_files(spark: SparkSession, parts: list[tuple[str, int]], path: str, at_once: int = COPIED_AT_ONCE) -> int:
    """The parts behind one another as one file of a mounted folder; tasks copy them to their places. Returns how many there were.

    Stores without positional writes have no such file: there the parts, in the order of their names, are read as one stream.
    """
    if "://" in path and not path.startswith("file:"):
        raise ValueError("one file is written to a mounted folder; elsewhere keep the parts, which scans read as one stream")
    system, local = file_system(path)
    system.create_dir(local.rpartition("/")[0] or "/")
    ends = _ends(parts)
    total = ends[-1] if ends else 0
    with open(local, "wb") as f:
        f.truncate(total)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for unit in b.column(0).to_pylist():
                start = unit * at_once
                with open(local, "r+b") as f:
                    f.seek(start)
                    for data in _stream_bytes(parts, ends, start, min(total, start + at_once)):
                        f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    n = -(-total // at_once)
    if n:
        spark.range(0, n, 1, min(n, 10_000)).mapInArrow(copy, "n bigint").agg(F.sum("n")).collect()
    return len(parts)


def write_one(df: DataFrame, path: str, order: str | list[str], transport: str = "raw", files: int | None = None, blocks_at_once: int = BLOCKS_AT_ONCE) -> int:
    """The column `value` in lines, sorted by `order`, as one raw, gzip or block-gzip file that many tasks write. Returns the number of joined parts.

    Sorted ranges are written as text first; block gzip is made from that stream by tasks of whole blocks.
    """
    spark = df.sparkSession
    top = scratch(spark, "parts")
    write_text(df, f"{top}/text", order, "gzip" if transport == "gzip" else None, files)
    parts = _in_order([f for f in list_files(spark, f"{top}/text") if f[1]])
    if transport == "bgzf":
        parts = compress_bgzf(spark, parts, f"{top}/blocks", blocks_at_once)
    n = join_files(spark, parts, path)
    system, folder = file_system(top)
    system.delete_dir(folder)
    return n


def write_each(df: DataFrame, folder: str, name: Column) -> None:
    """A file for each row: its column `value` and a line break, under the folder and a name; tasks write them.

    A name may have folders in it: of very many files, a folder for some thousand each keeps listings apart.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(folder)
        system.create_dir(top)
        made = {""}
        for b in batches:
            for n, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (inner := n.rpartition("/")[0]) not in made:
                    system.create_dir(f"{top}/{inner}")
                    made.add(inner)
                with system.open_output_stream(f"{top}/{n}", compression=None) as f:
                    f.write(v.encode() + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    df.select(name.alias("name"), "value").mapInArrow(put, "n bigint").agg(F.sum("n")).collect()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    """A small file as it is: fixtures and sidecars."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()
    return path


def append_bytes(path: str, data: bytes) -> None:
    """Some bytes at the end of a file of a mounted folder."""
    with open(file_system(path)[1], "ab") as f:
        f.write(data)
