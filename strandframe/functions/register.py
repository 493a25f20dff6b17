"""SQL names: functions, table functions and formats."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..schema import BGZF_INDEX_SCHEMA, FASTA_SCAN_SCHEMA, FASTQ_SCAN_SCHEMA
from ..sources import scan, sinks
from ..sources.bgzf import EOF_BLOCK, hop, read_blocks
from ..sources.files import BGZF, GZIP, file_system, kind_of, open_at, scratch
from . import packing


def decoded(content: bytes) -> bytes:
    """Bytes of a small file, decoded by their magic."""
    kind = kind_of(content[:18])
    if kind == GZIP:
        return b"".join(scan.gunzip(io.BytesIO(content)))
    if kind == BGZF:
        out = []
        for _, block, payload in read_blocks(io.BytesIO(content), 0):
            if block == EOF_BLOCK:
                break
            out.append(payload)
        return b"".join(out)
    return content


def parse_bytes(content: bytes, kind: str) -> Iterator[dict]:
    """Rows of a scan of resident bytes; kind fastq or fasta."""

    class Resident:
        r = {"path": "", "line0": 0, "record0": 0, "byte0": 0, "bytes": len(content)}
        own_end = len(content)

    out: list[pa.RecordBatch] = []
    {"fastq": scan._fastq, "fasta": scan._fasta}[kind](Resident(), out)(content, 0, True)
    for batch in out:
        yield from batch.to_pylist()


@F.udtf(returnType=FASTQ_SCAN_SCHEMA)
class FastqParse:
    """fastq_parse(content): the records of a binary cell."""

    def eval(self, content: bytes):
        for r in parse_bytes(decoded(bytes(content or b"")), "fastq"):
            yield tuple(r.values())


@F.udtf(returnType=FASTA_SCAN_SCHEMA)
class FastaParse:
    """fasta_parse(content): the records of a binary cell."""

    def eval(self, content: bytes):
        for r in parse_bytes(decoded(bytes(content or b"")), "fasta"):
            yield tuple(r.values())


class _Reader(DataSourceReader):
    """Files, by a path, folder or pattern of a shared mount or a store that pyarrow reaches.

    A file is a task; with the option `ranges`, a table that measure() has written, tasks are groups of ranges
    of 64 MB or so, and filters on path and record_index leave out ranges that can't hold such records.
    """

    def __init__(self, options: dict, step, schema: str) -> None:
        self.options, self.step, self.schema = options, step, schema
        self.paths: set[str] | None = None
        self.low, self.high = 0, scan.WHOLE

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("path",) and isinstance(f, EqualTo | In):
                these = set(value if isinstance(f, In) else [value])
                self.paths = these if self.paths is None else self.paths & these
            elif column == ("record_index",) and isinstance(value, int | tuple | list):
                if isinstance(f, In):
                    self.low, self.high = max(self.low, min(value)), min(self.high, max(value))
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high = min(self.high, value - isinstance(f, LessThan))
            yield f  # ranges are coarse, so Spark still looks at each record

    def partitions(self) -> list[InputPartition]:
        wanted = lambda p: self.paths is None or p in self.paths
        if "ranges" not in self.options:
            row = {"start": 0, "byte0": 0, "bytes": scan.WHOLE, "line0": 0, "record0": 0}
            return [InputPartition([{**row, "path": p, "size": n, "end": n}]) for p, n in _files(self.options["path"]) if n and wanted(p)] or [InputPartition([])]
        import pyarrow.dataset as ds

        system, folder = file_system(self.options["ranges"])
        rows = ds.dataset(folder, filesystem=system, format="parquet").to_table().to_pylist()
        rows = [r for r in rows if wanted(r["path"]) and r["first_record"] <= self.high and (r["next_record"] is None or r["next_record"] > self.low)]
        rows.sort(key=lambda r: (r["path"], r["start"]))
        tasks = max(1, min(len(rows), scan.MOST_TASKS))
        return [InputPartition(rows[k * len(rows) // tasks : (k + 1) * len(rows) // tasks]) for k in range(tasks)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value:
            yield from scan._run(self.step, iter([pa.RecordBatch.from_pylist(partition.value)]))


def measure(spark: SparkSession, kind: str, path: str | list[str], ranges: str, range_bytes: int = scan.RANGE) -> None:
    """Writes the table of ranges that the formats fastq and fasta take as option `ranges`: a row a range, with its first record and the next range's."""
    rows = scan.numbered(spark, path, range_bytes)
    first = F.ceil(F.col("line0") / 4) if kind == "fastq" else F.col("record0")
    following = F.lead("first_record").over(W.partitionBy("path").orderBy("start"))
    rows.withColumn("first_record", first).withColumn("next_record", following).write.parquet(ranges)


def load(spark: SparkSession, kind: str, path: str, range_bytes: int = scan.RANGE) -> DataFrame:
    """spark.read.format(kind).load(path) with measured ranges, so that large files are many tasks and filters prune. kind: fastq or fasta."""
    register(spark)
    ranges = scratch(spark, "ranges")
    measure(spark, kind, path, ranges, range_bytes)
    return spark.read.format(kind).option("ranges", ranges).load(path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a path, folder or pattern, hidden ones left out."""
    from fnmatch import fnmatch

    from pyarrow import fs

    system, name = file_system(path)
    scheme = path.partition("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    pattern = any(c in name for c in "*?[")
    if not pattern and system.get_file_info(name).type == fs.FileType.File:
        return [(scheme + name, system.get_file_info(name).size)]
    top = name[: min(name.find(c) for c in "*?[" if c in name)].rpartition("/")[0] or "/" if pattern else name
    found = system.get_file_info(fs.FileSelector(top, recursive=pattern))
    return sorted((scheme + i.path, i.size) for i in found if i.type == fs.FileType.File and i.base_name[0] not in "._" and (not pattern or fnmatch(i.path, name)))


class FastqDataSource(DataSource):
    """spark.read.format("fastq").load(path): a file a task; with option("ranges", ...) of measure(), or by load(), a range."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return FASTQ_SCAN_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), scan._fastq, FASTQ_SCAN_SCHEMA)


class FastaDataSource(DataSource):
    """spark.read.format("fasta").load(path): as fastq."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return FASTA_SCAN_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), scan._fasta, FASTA_SCAN_SCHEMA)


class FaiDataSource(DataSource):
    """spark.read.format("fai").load(path): rows of .fai files, unchecked; fasta.read_fai checks them."""

    @classmethod
    def name(cls) -> str:
        return "fai"

    def schema(self) -> str:
        return "path string, name string, len bigint, offset bigint, line_bases bigint, line_width bigint"

    def reader(self, schema) -> DataSourceReader:
        return _FaiReader(dict(self.options), None, self.schema())


class _FaiReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for r in partition.value:
            with open_at(r["path"]) as f:
                for line in io.TextIOWrapper(f, "latin-1", newline="\n"):  # a line at a time
                    if line := line.rstrip("\r\n"):
                        name, *rest = line.split("\t")
                        yield (r["path"], name, *map(int, rest))


class BlocksDataSource(DataSource):
    """spark.read.format("bgzf_blocks").load(path): places and sizes of the blocks of block-gzip files, by their headers."""

    @classmethod
    def name(cls) -> str:
        return "bgzf_blocks"

    def schema(self) -> str:
        return BGZF_INDEX_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _BlocksReader(dict(self.options), None, self.schema())


class _BlocksReader(_Reader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for r in partition.value:
            decoded = 0
            with open_at(r["path"]) as f:
                for i, (offset, size, out) in enumerate(hop(f, 0)):
                    if out == 0 and size == len(EOF_BLOCK):
                        break
                    yield r["path"], i, offset, decoded, size, out
                    decoded += out


@F.udtf(returnType="line bigint, span_start bigint, span_end bigint")
class FastaSpans:
    """fasta_spans(start, end, offset, line_bases, line_width): the bytes of each sequence line that a range of bases touches."""

    def eval(self, start: int, end: int, offset: int, line_bases: int, line_width: int):
        if end > start and line_bases:
            for line in range(start // line_bases, (end - 1) // line_bases + 1):
                at = offset + line * line_width
                yield line, at + max(0, start - line * line_bases), at + min(line_bases, end - line * line_bases)


@F.arrow_udf(T.BinaryType())
def bin_qualities(qual: pa.Array, thresholds: pa.Array) -> pa.Array:
    """bin_qualities(qual, thresholds): a byte for each base, how many of the sorted thresholds its Phred score reaches."""
    return pa.array([packing.binned(q, t) for q, t in zip(qual.to_pylist(), thresholds.to_pylist(), strict=True)], pa.binary())


#: Small SQL functions in SQL itself, so that they stay in the JVM.
_SQL = {
    "id_token(name binary) returns string": r"regexp_extract(regexp_replace(decode(name, 'ISO-8859-1'), '^[@>]', ''), '^([^ \\t\\n\\f\\r]*)', 1)",
    "pair_normalized_id(name binary) returns string": r"regexp_replace(regexp_extract(regexp_replace(decode(name, 'ISO-8859-1'), '^[@>]', ''), '^([^ \\t\\n\\f\\r]*)', 1), '/[12]\\z', '')",
    "virtual_offset(block bigint, within bigint) returns bigint": "shiftleft(block, 16) | within",
    "virtual_offset_block(v bigint) returns bigint": "shiftrightunsigned(v, 16)",
    "virtual_offset_within(v bigint) returns bigint": "v & 65535",
    "packed_base_len(n bigint) returns bigint": "(n + 3) div 4",
    "bit_mask_len(n bigint) returns bigint": "(n + 7) div 8",
}


def register(spark: SparkSession) -> SparkSession:
    """Makes the functions, table functions and formats known to a session, and lets formats see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for head, body in _SQL.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    spark.udf.register("pack_bases", packing.pack_bases)
    spark.udf.register("summarize_qualities", packing.summarize_qualities)
    spark.udtf.register("fastq_parse", FastqParse)
    spark.udtf.register("fasta_parse", FastaParse)
    spark.udf.register("bin_qualities", bin_qualities)
    spark.udtf.register("fasta_spans", FastaSpans)
    for source in (FastqDataSource, FastaDataSource, FaiDataSource, BlocksDataSource, sinks.BgzfDataSource):
        spark.dataSource.register(source)
    return spark


__all__ = ["FastaParse", "FastqParse", "decoded", "load", "measure", "parse_bytes", "register"]
