"""Pairing scans: a task reads the same records of two streams, or neighbours of one, and makes pairs of them without a shuffle.

The measuring pass tells which record each range begins with. Ranges of the first stream are the units of
work; each is given the last range of the second stream that begins at the same record or before. A task
reads both from there on, past the ends of ranges and files, drops what comes before its first record and
stops at the first record of the next unit. Ranges of the second stream are smaller, so little is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import packing
from ..schema import PACKED_SCHEMA, QUALITY_SCHEMA
from . import scan
from .files import list_files

#: Ranges of the second stream for one of the first.
FINER = 8
#: Boundaries are put in order by so many records at a time.
_STRETCH = 1 << 22
_END = 1 << 62
_RANGE = ["path", "start", "end", "size", "bytes", "byte0", "line0", "record0", "byte_base", "line_base", "fastq_base", "fasta_base"]
MATE_SCHEMA = "struct<record_index: bigint, byte_offset: bigint, name: binary, seq: binary, plus: binary, qual: binary, plus_offset: bigint, qual_offset: bigint, n_lines: int, faults: int>"
PAIR_SCAN_SCHEMA = f"pair_index bigint, first {MATE_SCHEMA}, second {MATE_SCHEMA}"
_PACK = [f"{c}_{i} {kind}" for i in (1, 2) for c, kind in (("packed", PACKED_SCHEMA), ("quality", QUALITY_SCHEMA), ("bad_phred", "int"))]
PACKED_PAIR_SCHEMA = ", ".join([PAIR_SCAN_SCHEMA, *_PACK])


def _starts(spark: SparkSession, path: str | list[str], range_bytes: int, transport: scan.Transport) -> DataFrame:
    """(lo, at): the first record of each range of a stream, and the range."""
    rows = scan.numbered(spark, path, range_bytes, True, transport)
    return rows.select((F.ceil(F.col("line0") / 4) + F.col("fastq_base")).alias("lo"), F.struct(*_RANGE).alias("at"))


def _units(points: DataFrame, columns: list[str], range_bytes: int) -> DataFrame:
    """(lo, hi and the columns) of the units: stretches from one kept point to the next; the columns are the greatest up to there.

    Kept are the points of the first column, and those of the second that lie behind all of them where a whole
    range begins: there the second stream may have more records. Points are put in order in stretches of the
    record numbers; what goes on from one to the next comes from a row for each stretch.
    """
    a = columns[0]
    points = points.groupBy("lo").agg(*[F.max(c).alias(c) for c in columns]).withColumn("stretch", F.floor(F.col("lo") / _STRETCH))
    stretches, below = W.orderBy("stretch"), (W.unboundedPreceding, -1)
    top = points.agg(F.max(F.when(F.col(a).isNotNull(), F.col("lo"))).alias("top"))
    kept = F.col(a).isNotNull()
    if len(columns) > 1:
        points = points.join(F.broadcast(top))
        kept |= (F.col("lo") > F.coalesce("top", F.lit(-1))) & (F.col(f"{columns[1]}.start") % range_bytes == 0)
    points = points.withColumn("kept", kept)
    kept_lo = F.min(F.when(F.col("kept"), F.col("lo")))
    each = points.groupBy("stretch").agg(kept_lo.alias("low"), *[F.max(c).alias(c) for c in columns])
    each = each.select("stretch", F.min("low").over(stretches.rowsBetween(1, W.unboundedFollowing)).alias("next"), *[F.max(c).over(stretches.rowsBetween(*below)).alias(f"before_{c}") for c in columns])
    inside = W.partitionBy("stretch").orderBy("lo")
    hi = F.coalesce(kept_lo.over(inside.rowsBetween(1, W.unboundedFollowing)), F.col("next"), F.lit(_END)).cast("long")
    seen = [F.coalesce(F.max(c).over(inside), F.col(f"before_{c}")).alias(c) for c in columns]
    return points.join(each, "stretch").select("lo", hi.alias("hi"), "kept", *[x.alias(c) for x, c in zip(seen, columns, strict=True)]).where("kept").drop("kept")


def _records(r: dict | None, files: list[tuple[str, int]], transport: scan.Transport, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
    """Records lo to hi of a stream, found from a range on, file after file."""
    if r is None:
        return
    rest = [f for f in files if f[0] > r["path"]]
    while True:
        out: list[pa.RecordBatch] = []
        reader = scan._Reader({**r, "bytes": scan.WHOLE}, transport)
        read, end, index = scan._fastq(reader, out), [r["byte0"]], -(-r["line0"] // 4) + r["fastq_base"]

        def step(buf: bytes, offset: int, last: bool, read=read, end=end) -> int:
            end[0] = offset + len(buf)
            return read(buf, offset, last)

        for _ in reader.buffers(step):
            for b in out:
                first, n = index, b.num_rows
                index += n
                if index > lo and first < hi:
                    yield b.slice(max(0, lo - first), min(hi, index) - max(lo, first))
            out.clear()
            if index >= hi:
                break
        reader.source.close()
        if index >= hi or not rest:
            return
        (path, size), rest = rest[0], rest[1:]
        base = r["byte_base"] + end[0]
        r = {"path": path, "size": size, "start": 0, "end": size, "byte0": 0, "line0": 0, "record0": 0, "byte_base": base, "line_base": 0, "fastq_base": index, "fasta_base": 0}


_NAMES = ["record_index", "byte_offset", "name", "seq", "plus", "qual", "plus_offset", "qual_offset", "n_lines", "faults"]
_MATE = pa.struct([("record_index", pa.int64()), ("byte_offset", pa.int64()), *[(c, pa.binary()) for c in ("name", "seq", "plus", "qual")], ("plus_offset", pa.int64()), ("qual_offset", pa.int64()), ("n_lines", pa.int32()), ("faults", pa.int32())])


def _struct(b: pa.RecordBatch | None, n: int) -> pa.Array:
    return pa.nulls(n, _MATE) if b is None else pa.StructArray.from_arrays([b.column(c) for c in _NAMES], fields=list(_MATE))


def _pair(index: int, one: pa.RecordBatch | None, two: pa.RecordBatch | None, pack: bool) -> pa.RecordBatch:
    n = (two if one is None else one).num_rows
    cols = {"pair_index": pa.array(np.arange(index, index + n)), "first": _struct(one, n), "second": _struct(two, n)}
    for i, b in ((1, one), (2, two)) if pack else ():
        seq, qual = (b.column("seq"), b.column("qual")) if b is not None else (pa.array([], pa.binary()),) * 2
        made = packing.packed_array(seq), packing.quality_array(qual), packing.first_bad_phred(qual)
        cols |= {f"{c}_{i}": x if b is not None else pa.nulls(n, x.type) for c, x in zip(("packed", "quality", "bad_phred"), made, strict=True)}
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def _lockstep(index: int, one: Iterator[pa.RecordBatch], two: Iterator[pa.RecordBatch], pack: bool) -> Iterator[pa.RecordBatch]:
    a, b = next(one, None), next(two, None)
    while a is not None or b is not None:
        n = min(x.num_rows for x in (a, b) if x is not None)
        yield _pair(index, a if a is None else a.slice(0, n), b if b is None else b.slice(0, n), pack)
        index += n
        a, b = (x if x is None else x.slice(n) if x.num_rows > n else next(rest, None) for x, rest in ((a, one), (b, two)))


def scan_pairs(spark: SparkSession, first: str | list[str], second: str | list[str], range_bytes: int = scan.RANGE, transport: scan.Transport = scan.PLAIN, pack: bool = False) -> DataFrame:
    """Record i of one stream with record i of the other (PAIR_SCAN_SCHEMA; with pack, PACKED_PAIR_SCHEMA), unchecked.

    The files of each side, by name, are one stream. A side that ends earlier is null in the pairs that follow.
    No record is shuffled: what is put in order is a row for each range.
    """
    files = [[f for f in list_files(spark, p) if f[1]] for p in (first, second)]
    if all(_is_one(f, range_bytes) for f in files):
        units = spark.createDataFrame([(0, _END, *map(_first, files))], f"lo bigint, hi bigint, a {_KIND}, b {_KIND}")
    else:
        none = F.lit(None).cast(_KIND)
        points = spark.createDataFrame([], f"lo bigint, a {_KIND}, b {_KIND}")
        if files[0]:
            points = points.union(_starts(spark, first, range_bytes, transport).select("lo", "at", none))
        if files[1]:
            points = points.union(_starts(spark, second, max(1, range_bytes // FINER), transport).select("lo", none, "at"))
        units = _units(points, ["a", "b"], range_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in scan._each(batches):
            one, two = (_records(u[c], f, transport, u["lo"], u["hi"]) for c, f in zip("ab", files, strict=True))
            yield from _lockstep(u["lo"], one, two, pack)

    tasks = max(scan._tasks(spark, f, range_bytes) for f in files)
    return units.repartition(tasks).mapInArrow(run, PACKED_PAIR_SCHEMA if pack else PAIR_SCAN_SCHEMA)


_KIND = "struct<" + ", ".join(f"{c}: {'string' if c == 'path' else 'bigint'}" for c in _RANGE) + ">"


def _is_one(files: list[tuple[str, int]], range_bytes: int) -> bool:
    """Whether a stream is one range, which needn't be measured."""
    return len(files) <= 1 and sum(f[1] for f in files) <= range_bytes


def _first(files: list[tuple[str, int]]) -> tuple | None:
    return (files[0][0], 0, files[0][1], files[0][1], scan.WHOLE, *[0] * 7) if files else None


def scan_interleaved(spark: SparkSession, path: str | list[str], range_bytes: int = scan.RANGE, transport: scan.Transport = scan.PLAIN, pack: bool = False) -> DataFrame:
    """Records 2 i and 2 i + 1 of one stream as pairs, across ends of ranges and files; an odd last record has no second."""
    files = [f for f in list_files(spark, path) if f[1]]
    if _is_one(files, range_bytes):
        units = spark.createDataFrame([(0, _END, _first(files))], f"lo bigint, hi bigint, a {_KIND}")
    else:
        units = _units(_starts(spark, path, range_bytes, transport).select("lo", F.col("at").alias("a")), ["a"], range_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in scan._each(batches):
            # pairs whose first record is of the unit
            lo, hi = u["lo"] + u["lo"] % 2, u["hi"] + u["hi"] % 2
            held = None
            for b in _records(u["a"], files, transport, lo, hi):
                if held is not None:
                    b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
                whole = b.num_rows - b.num_rows % 2
                held = b.slice(whole) if whole < b.num_rows else None
                if whole:
                    yield _pair(lo // 2, *[b.take(pa.array(range(k, whole, 2))) for k in (0, 1)], pack)
                    lo += whole
            if held is not None:
                yield _pair(lo // 2, held, None, pack)

    return units.repartition(scan._tasks(spark, files, range_bytes)).mapInArrow(run, PACKED_PAIR_SCHEMA if pack else PAIR_SCAN_SCHEMA)


__all__ = ["PACKED_PAIR_SCHEMA", "PAIR_SCAN_SCHEMA", "scan_interleaved", "scan_pairs"]
