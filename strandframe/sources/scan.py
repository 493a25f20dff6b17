"""Distributed scans: byte ranges of raw, gzip and block-gzip files become lines, FASTQ or FASTA records.

A file is cut into ranges. A first pass counts what starts in each range, a running sum over ranges
(not lines) numbers them, and the second pass reads each range again with its first number. A range
owns the lines that its newlines begin; its reader skips what it doesn't own and reads on past its
end until its last record is whole. So records are made without a shuffle, wherever the cuts fall.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import BgzfError, SequenceFormatError
from ..schema import BGZF_INDEX_SCHEMA, FASTA_SCAN_SCHEMA, FASTQ_PACKED_SCHEMA, FASTQ_SCAN_SCHEMA, LINE_SCHEMA
from ..functions import packing
from . import bgzf
from .files import BGZF, GZIP, PREFIX, RAW, files_table, kind_of, list_files, open_at

RANGE = 64 << 20
#: Bytes that a task reads, decodes and looks at in one go: numbers and slices of the lines in them take many times that.
CHUNK = 512 << 10
#: Tasks of a scan at most; a task of more than one range takes them one after the other.
MOST_TASKS = 50_000
#: Bytes that one buffer, and so one record, may have.
MOST_BYTES = (1 << 31) - 1 - 2 * CHUNK
#: Stands for the decoded size of a file that is one range and needn't be measured.
WHOLE = 1 << 62
_NL, _CR, _GT = 10, 13, 62
_TAB, _AT, _STAR = 9, 64, 42


class Transport(NamedTuple):
    """How bytes are decoded. decode: compressed input is, else all files are taken as they are. single: a gzip file has one member.

    max_in, max_out: most compressed and decoded bytes of a gzip file. lenient: a gzip file that can't be decoded
    any further ends there, its last record cut short; transport_errors tells which files these are.
    """

    decode: bool = True
    single: bool = False
    max_in: int | None = None
    max_out: int | None = None
    lenient: bool = False


PLAIN = Transport()


def _tasks(spark: SparkSession, found: list[tuple[str, int]], range_bytes: int) -> int:
    """Tasks for files of these sizes: one for each range's worth of bytes, of 8 MB at least, or one for each core while there are ranges enough."""
    n_ranges = sum(max(1, -(-size // range_bytes)) for _, size in found)
    by_bytes = -(-sum(size for _, size in found) // max(range_bytes, 8 << 20))
    return max(1, min(n_ranges, max(by_bytes, spark.sparkContext.defaultParallelism), MOST_TASKS))


class _Sizes(NamedTuple):
    """Of a table of files: how many ranges they are, their bytes, and how many are more than one range."""

    n_ranges: int
    total: int
    cut: int


def _sizes(files: DataFrame, range_bytes: int) -> _Sizes:
    size, zero = F.col("size"), F.lit(0).cast("long")
    row = files.agg(F.sum(F.greatest(F.lit(1).cast("long"), F.ceil(size / range_bytes))).alias("n"), F.sum("size").alias("total"), F.count_if(size > range_bytes).alias("cut"))
    return _Sizes(*row.select(F.coalesce("n", zero), F.coalesce("total", zero), "cut").first())


def _tasks_of(spark: SparkSession, sizes: _Sizes, range_bytes: int) -> int:
    """Tasks for a table of files, by the rule of _tasks."""
    by_bytes = -(-sizes.total // max(range_bytes, 8 << 20))
    return max(1, min(sizes.n_ranges, max(by_bytes, spark.sparkContext.defaultParallelism), MOST_TASKS))


def _cut(files: DataFrame, range_bytes: int) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start")
    return files.select("path", "size", at).withColumn("end", F.least("size", F.col("start") + range_bytes))


def ranges(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE) -> DataFrame:
    """(path, size, start, end) of all ranges, dealt in turn to a number of tasks that follows from the bytes: the rows are tiny, so adaptive execution mustn't join them."""
    found = list_files(spark, path)
    return _cut(spark.createDataFrame(found, "path string, size bigint"), range_bytes).repartition(_tasks(spark, found, range_bytes))


class Range:
    """Decoded bytes from the first that a range holds on, past its end as far as they are asked for."""

    def __init__(self, path: str, size: int, start: int, end: int, transport: Transport = PLAIN) -> None:
        self.path, self.size, self.start, self.end, self.transport = path, size, start, end, transport
        self.file = open_at(path)
        self.kind = kind_of(self.file.read(PREFIX)) if transport.decode else RAW

    def close(self) -> None:
        self.file.close()

    def chunks(self) -> Iterator[tuple[bytes, bool]]:
        """(bytes, whether they lie in the range). Plain gzip is one range, the first of its file."""
        if self.kind == GZIP:
            if self.start == 0:
                try:
                    for part in gunzip(self.file, *self.transport[1:4]):
                        yield part, True
                except OSError:
                    if not self.transport.lenient:
                        raise
            return
        if self.kind == BGZF:
            first = bgzf.first_block(self.file, self.start, self.size)
            if first is None or first >= self.end:
                return
            buffered, own, held = [], True, 0
            for offset, _, payload in bgzf.read_blocks(self.file, first):
                if not payload and self._ends(offset):
                    break
                inside = offset < self.end
                if inside != own or held >= CHUNK:
                    yield b"".join(buffered), own
                    buffered, held, own = [], 0, inside
                buffered.append(payload)
                held += len(payload)
            yield b"".join(buffered), own
            return
        self.file.seek(self.start)
        left = self.end - self.start
        while left > 0:
            part = self.file.read(min(CHUNK, left))
            if not part:
                return
            left -= len(part)
            yield part, True
        more = 1 << 16  # past the end mostly a part of one record is needed
        while part := self.file.read(more):
            yield part, False
            more = min(CHUNK, 2 * more)

    def _ends(self, offset: int) -> bool:
        """Whether the block is the end block; empty blocks of other makes are none."""
        at = self.file.tell()
        self.file.seek(offset)
        same = self.file.read(len(bgzf.EOF_BLOCK)) == bgzf.EOF_BLOCK
        self.file.seek(at)
        return same


def gunzip(f, single: bool = False, max_in: int | None = None, max_out: int | None = None) -> Iterator[bytes]:
    """The decoded members of a gzip file, one after the other; with single, a second member or other bytes are an error.

    Parts have CHUNK bytes at most, however well they were compressed.
    """
    f.seek(0)
    z, read, made, members, within = zlib.decompressobj(31), 0, 0, 0, False
    data = f.read(CHUNK)
    while data:
        read += len(data)
        if max_in is not None and read > max_in:
            raise OSError(f"gzip input exceeds {max_in} compressed bytes")
        more = True
        while more:
            try:
                part = z.decompress(data, CHUNK)
            except zlib.error as e:
                if members and not single:
                    return  # bytes after the last member
                raise OSError(f"invalid gzip header: {e}" if "header" in str(e) else str(e)) from e
            made += len(part)
            if max_out is not None and made > max_out:
                raise OSError(f"gzip output exceeds {max_out} bytes")
            if part:
                yield part
            data, within = z.unconsumed_tail, not z.eof
            more = bool(data) or len(part) == CHUNK  # a full part may not be all that the bytes so far give
            if z.eof:
                data, members = z.unused_data, members + 1
                if data and single:
                    raise OSError("buffered reading accepts exactly one gzip member")
                more = bool(data)
                z = zlib.decompressobj(31)
        data = f.read(CHUNK)
        if data and members and single:
            raise OSError("buffered reading accepts exactly one gzip member")
    if not members or within:
        raise OSError("unexpected end of gzip data")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _measure(decode_gzip: bool, transport: Transport) -> Callable:
    """What a range holds: decoded bytes, newlines, header lines that begin after a newline, and how it begins and ends.

    stop: offset of the end block of a block-gzip file, if it lies in the range. A plain gzip file is
    one range, so nothing follows that needs its counts: it isn't decoded unless they are asked for.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            source = Range(r["path"], r["size"], r["start"], r["end"], transport)
            n = lines = headers = 0
            first, last, pending, stop = None, None, False, None
            skip = source.kind == GZIP and not decode_gzip
            if skip:
                n = WHOLE if r["start"] == 0 else 0
            for part, own in () if skip else source.chunks():
                if not part:
                    continue
                if pending and part[0] == _GT:
                    headers += 1
                pending = False
                if not own:
                    break
                lines += part.count(b"\n")
                headers += part.count(b"\n>")
                pending = part[-1] == _NL
                first = part[0] if first is None else first
                last = part[-1]
                n += len(part)
            if source.kind == BGZF:
                at = bgzf.first_block(source.file, r["start"], r["size"])
                if at is not None:
                    for offset, size, out in bgzf.hop(source.file, at, r["end"]):
                        if out == 0 and size == len(bgzf.EOF_BLOCK) and source._ends(offset):
                            stop = offset
                            break
            source.close()
            row = {**r, "bytes": n, "newlines": lines, "headers": headers, "first": first, "last": last, "stop": stop}
            yield pa.RecordBatch.from_pylist([row], schema=_MEASURED)

    return measure


_MEASURED = pa.schema([("path", pa.string()), ("size", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("bytes", pa.int64()), ("newlines", pa.int64()), ("headers", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("stop", pa.int64())])
_MEASURED_DDL = "path string, size bigint, start bigint, end bigint, bytes bigint, newlines bigint, headers bigint, first int, last int, stop bigint"
_NUMBERED = ["path", "size", "start", "end", "bytes", "byte0", "line0", "record0", "byte_base", "line_base", "fastq_base", "fasta_base"]


def numbered(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE, stream: bool = False, transport: Transport = PLAIN) -> DataFrame:
    """Ranges with the numbers of the bytes, lines and FASTA records that start before them in their file: byte0, line0, record0.

    Running sums are over ranges. Files of one range aren't measured: nothing in them comes before.
    Block-gzip ranges after the first end block are left out. With `stream` the files, in the order of
    their names, are one stream: *_base are the numbers of bytes, lines and records in the files before.
    """
    found = files_table(spark, path).where("size > 0")
    sizes = _sizes(found, range_bytes)
    tasks = _tasks_of(spark, sizes, range_bytes)
    zero = F.lit(0).cast("long")
    small = F.lit(not stream) & (F.col("size") <= range_bytes)
    none = [zero.alias(c) for c in _NUMBERED[-4:]]
    whole = found.where(small).select("path", "size", zero.alias("start"), F.col("size").alias("end"), F.lit(WHOLE).cast("long").alias("bytes"), zero.alias("byte0"), zero.alias("line0"), zero.alias("record0"), *none)
    if not stream and not sizes.cut:
        return whole.repartition(tasks)
    seen = _cut(found.where(~small), range_bytes).repartition(tasks).mapInArrow(_measure(stream, transport), _MEASURED_DDL)
    order, file = W.partitionBy("path").orderBy("start"), W.partitionBy("path")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    seen = seen.withColumn("eof", F.min("stop").over(file)).where("eof is null or start <= eof").where("bytes > 0")
    run = lambda c: F.coalesce(F.sum(c).over(before), zero)
    seen = seen.withColumn("byte0", run("bytes")).withColumn("total", F.sum("bytes").over(file))
    opens = (F.col("byte0") == 0).cast("long")
    closes = ((F.col("byte0") + F.col("bytes") == F.col("total")) & (F.col("last") == _NL)).cast("long")
    seen = seen.withColumn("own_lines", F.col("newlines") + opens - closes).withColumn("own_records", F.col("headers") + opens * (F.col("first") == _GT).cast("long"))
    seen = seen.withColumn("line0", run("own_lines")).withColumn("record0", run("own_records"))
    if stream:
        sums = seen.groupBy("path").agg(F.sum("bytes").alias("byte_base"), F.sum("own_lines").alias("line_base"), F.ceil(F.sum("own_lines") / 4).alias("fastq_base"), F.sum("own_records").alias("fasta_base"))
        files = W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)  # a row for each file
        sums = sums.select("path", *[F.coalesce(F.sum(c).over(files), zero).alias(c) for c in _NUMBERED[-4:]])
        seen = seen.join(sums, "path")
    else:
        seen = seen.select("*", *none)
    seen = seen.select(*_NUMBERED)
    return (seen if stream else seen.union(whole)).repartition(tasks)


class _Reader:
    """Whole lines of a range, from the first that it owns, as buffers with the offset of their first byte."""

    def __init__(self, r: dict, transport: Transport) -> None:
        self.r, self.source = r, Range(r["path"], r["size"], r["start"], r["end"], transport)
        self.own_end = r["byte0"] + r["bytes"]  # lines that start here or before are owned

    def buffers(self, step: Callable[[bytes, int, bool], int]) -> Iterator[int]:
        """Calls step(buffer, offset, last), which tells how many bytes it has used; the others come again, with at least as many more.

        So a record that fills many buffers is looked at in sizes that double, not anew for each part.
        """
        pieces: list[bytes] = []
        held, least, offset = 0, 0, self.r["byte0"]
        skip = offset > 0
        for part, _ in self.source.chunks():
            if skip:
                at = part.find(b"\n")
                if at < 0:
                    offset += len(part)
                    continue
                offset += at + 1
                part, skip = part[at + 1 :], False
            if offset > self.own_end:
                return
            pieces.append(part)
            held += len(part)
            if held > MOST_BYTES:
                raise SequenceFormatError("a record of 2 GiB or more is read by an index, in chunks", offset, self.r["record0"], 0)
            if held < least:
                continue
            carry = pieces[0] if len(pieces) == 1 else b"".join(pieces)
            used = step(carry, offset, False)
            yield used
            offset += used
            if offset > self.own_end:
                return
            pieces = [carry[used:]]
            held = len(pieces[0])
            least = 2 * held
        if not skip and held and offset <= self.own_end:
            yield step(b"".join(pieces), offset, True)


def _line_ends(buf: bytes, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends without line break, ends with it) of the lines of a buffer; an unfinished one only if it is the last."""
    b = np.frombuffer(buf, dtype=np.uint8)
    nl = np.flatnonzero(b == _NL)
    stops = nl
    after = nl + 1
    if last and (not len(nl) or nl[-1] != len(b) - 1):
        stops, after = np.append(nl, len(b)), np.append(after, len(b))
    starts = np.concatenate([[0], after[:-1]]) if len(after) else np.zeros(0, int)
    cr = (stops > starts) & (b[np.maximum(stops - 1, 0)] == _CR)
    return starts, stops - cr, after


def _slices(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes between starts and ends, which don't overlap and stand in order, as an Arrow array; no loop over rows."""
    if not len(starts):
        return pa.array([], pa.binary())
    offsets = np.empty(2 * len(starts), dtype=np.int32)
    offsets[0::2], offsets[1::2] = starts, ends
    offsets = np.append(offsets, ends[-1]).astype(np.int32)
    gaps = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(buf)])
    return gaps.take(pa.array(np.arange(0, 2 * len(starts), 2)))


def _run(read: Callable[[dict, list], Callable], batches: Iterator[pa.RecordBatch], transport: Transport = PLAIN) -> Iterator[pa.RecordBatch]:
    for r in _each(batches):
        out: list[pa.RecordBatch] = []
        reader = _Reader(r, transport)
        step = read(reader, out)
        for _ in reader.buffers(step):
            yield from out
            out.clear()
        yield from out
        reader.source.close()


def _batch(schema: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema)


def _lines(reader: _Reader, out: list) -> Callable:
    state = {"line": reader.r["line0"] + reader.r.get("line_base", 0)}
    base = reader.r.get("byte_base", 0)
    names = ["path", "line_no", "byte_offset", "width", "line"]

    def step(buf: bytes, offset: int, last: bool) -> int:
        starts, ends, after = _line_ends(buf, last)
        own = int(np.searchsorted(starts, reader.own_end - offset, side="right"))
        own = min(own, len(starts))
        if own:
            s, e, a = starts[:own], ends[:own], after[:own]
            numbers = state["line"] + np.arange(own)
            state["line"] += own
            out.append(_batch(names, [pa.array([reader.r["path"]] * own, pa.string()), numbers, s + (offset + base), a - s, _slices(buf, s, e)]))
        return int(after[-1]) if len(after) else 0

    return step


#: Bytes that end an id.
_BLANK = np.isin(np.arange(256), list(b" \t\n\f\r"))


def _faults(buf: bytes, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """What is wrong with whole records, by the starts and ends of their four lines (see FASTQ_SCAN_SCHEMA)."""
    b = np.frombuffer(buf, dtype=np.uint8)
    at = lambda i: b[np.minimum(i, len(b) - 1)]
    width = e - s
    # an id stands after one @ or >, if there is one
    named = s[:, 0] + np.isin(at(s[:, 0]), [ord("@"), _GT]) * (width[:, 0] > 0)
    out = 2 * ((width[:, 0] == 0) | (at(s[:, 0]) != ord("@"))) + 4 * ((named >= e[:, 0]) | _BLANK[at(named)])
    return (out + 8 * ((width[:, 2] == 0) | (at(s[:, 2]) != ord("+"))) + 16 * (width[:, 1] != width[:, 3])).astype(np.int32)


def _packed(reader: _Reader, out: list) -> Callable:
    """Records with their packed bases and qualities summed up, made in the same pass."""
    found: list[pa.RecordBatch] = []
    step = _fastq(reader, found)

    def packed(buf: bytes, offset: int, last: bool) -> int:
        used = step(buf, offset, last)
        for b in found:
            qual = b.column("qual")
            out.append(_batch([*b.schema.names, "packed", "quality", "bad_phred"], [*b.columns, packing.packed_array(b.column("seq")), packing.quality_array(qual), packing.first_bad_phred(qual)]))
        found.clear()
        return used

    return packed


def _fastq(reader: _Reader, out: list) -> Callable:
    state = {"skip": -reader.r["line0"] % 4, "record": -(-reader.r["line0"] // 4) + reader.r.get("fastq_base", 0)}
    base = reader.r.get("byte_base", 0)
    names = ["path", "record_index", "byte_offset", "name", "seq", "plus", "qual", "plus_offset", "qual_offset", "n_lines", "faults"]

    def step(buf: bytes, offset: int, last: bool) -> int:
        starts, ends, after = _line_ends(buf, last)
        drop = min(state["skip"], len(starts))
        state["skip"] -= drop
        dropped = int(after[drop - 1]) if drop else 0
        starts, ends, after = starts[drop:], ends[drop:], after[drop:]
        whole = len(starts) // 4
        heads = starts[: 4 * whole : 4]
        own = int(np.searchsorted(heads, reader.own_end - offset, side="right"))
        path = reader.r["path"]
        if own:
            s, e = starts[: 4 * own].reshape(-1, 4), ends[: 4 * own].reshape(-1, 4)
            numbers = state["record"] + np.arange(own)
            state["record"] += own
            cells = [_slices(buf, s[:, k], e[:, k]) for k in range(4)]
            out.append(_batch(names, [pa.array([path] * own, pa.string()), numbers, s[:, 0] + (offset + base), *cells, s[:, 2] + (offset + base), s[:, 3] + (offset + base), np.full(own, 4, np.int32), _faults(buf, s, e)]))
        rest = starts[4 * whole :]
        if last and own == whole and len(rest) and rest[0] + offset <= reader.own_end:
            cells = [buf[starts[i] : ends[i]] for i in range(4 * whole, len(starts))] + [None] * (4 - len(rest))
            row = [[path], [state["record"]], [int(rest[0]) + offset + base], *[pa.array([c], pa.binary()) for c in cells]]
            place = [int(rest[k]) + offset + base if len(rest) > k else None for k in (2, 3)]
            out.append(_batch(names, [*row, *[pa.array([p], pa.int64()) for p in place], np.array([len(rest)], np.int32), np.array([1], np.int32)]))
        if own < whole:
            return len(buf)  # what follows belongs to the next range: nothing more is needed
        return int(after[4 * whole - 1]) if whole else dropped

    return step


def _two_line(reader: _Reader, out: list) -> Callable:
    """Lines in pairs, as they come: (path, record_index, byte_offset, name, seq, seq_offset, n_lines)."""
    state = {"skip": reader.r["line0"] % 2, "record": -(-reader.r["line0"] // 2) + reader.r.get("line_base", 0) // 2}
    base = reader.r.get("byte_base", 0)
    names = ["path", "record_index", "byte_offset", "name", "seq", "seq_offset", "n_lines"]

    def step(buf: bytes, offset: int, last: bool) -> int:
        starts, ends, after = _line_ends(buf, last)
        drop = min(state["skip"], len(starts))
        state["skip"] -= drop
        dropped = int(after[drop - 1]) if drop else 0
        starts, ends, after = starts[drop:], ends[drop:], after[drop:]
        whole = len(starts) // 2
        own = int(np.searchsorted(starts[: 2 * whole : 2], reader.own_end - offset, side="right"))
        numbers = state["record"] + np.arange(own)
        state["record"] += own
        path = pa.array([reader.r["path"]], pa.string())
        if own:
            s, e = starts[: 2 * own].reshape(-1, 2), ends[: 2 * own].reshape(-1, 2)
            out.append(_batch(names, [path.take(pa.array(np.zeros(own, np.int8))), numbers, s[:, 0] + (offset + base), *[_slices(buf, s[:, k], e[:, k]) for k in range(2)], s[:, 1] + (offset + base), np.full(own, 2, np.int32)]))
        if last and own == whole and len(starts) % 2 and starts[-1] + offset <= reader.own_end:
            out.append(_batch(names, [path, [state["record"]], [int(starts[-1]) + offset + base], pa.array([buf[starts[-1] : ends[-1]]], pa.binary()), pa.array([None], pa.binary()), pa.array([None], pa.int64()), np.array([1], np.int32)]))
        if own < whole:
            return len(buf)
        return int(after[2 * whole - 1]) if whole else dropped

    return step


def _fasta(reader: _Reader, out: list) -> Callable:
    state = {"record": reader.r["record0"] + reader.r.get("fasta_base", 0), "open": reader.r["byte0"] == 0}
    base = reader.r.get("byte_base", 0)
    names = ["path", "record_index", "byte_offset", "name", "seq", "n_lines"]

    def step(buf: bytes, offset: int, last: bool) -> int:
        starts, ends, after = _line_ends(buf, last)
        b = np.frombuffer(buf, dtype=np.uint8)
        if not len(starts):
            return 0
        full = ends > starts
        head = full & (b[np.minimum(starts, len(b) - 1)] == _GT)
        at = np.flatnonzero(head)
        path = reader.r["path"]
        if state["open"]:
            # lines before the first header: blank ones don't count, others are no record
            before = np.flatnonzero(full[: at[0]] if len(at) else full)
            if len(before):
                i = before[0]
                out.append(_batch(names, [[path], [state["record"]], [int(starts[i]) + offset + base], pa.array([None], pa.binary()), pa.array([buf[starts[i] : ends[i]]], pa.binary()), np.array([0], np.int32)]))
                state["open"] = False
            elif len(at):
                state["open"] = False
        if not len(at):
            return int(after[-1])
        done = at if last else at[:-1]  # the last record may go on
        own = done[starts[done] + offset <= reader.own_end]
        if len(own):
            stop = np.append(at, len(starts))[1:][: len(own)]
            low, high = int(starts[own[0]]), int(after[stop[-1] - 1])
            # a byte of memory for each byte of text: headers and line breaks are taken out
            turns = np.zeros(high - low + 1, dtype=np.int8)
            turns[starts[own] - low] = 1
            turns[ends[own] - low] -= 1
            keep = np.cumsum(turns[:-1], dtype=np.int8) == 0
            e, a = ends[own[0] : stop[-1]] - low, after[own[0] : stop[-1]] - low
            keep[a[a > e] - 1] = False
            keep[a[a > e + 1] - 2] = False
            sizes = np.add.reduceat(keep.view(np.uint8), starts[own] - low, dtype=np.int64)
            cells = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lines = np.concatenate([[0], np.cumsum(full & ~head)])
            n_lines = lines[stop] - lines[own]
            numbers = state["record"] + np.arange(len(own))
            state["record"] += len(own)
            seqs = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(cells), pa.py_buffer(b[low:high][keep])])
            out.append(_batch(names, [pa.array([path] * len(own), pa.string()), numbers, starts[own] + (offset + base), _slices(buf, starts[own], ends[own]), seqs, n_lines.astype(np.int32)]))
        if len(own) < len(done) or starts[at[-1]] + offset > reader.own_end:
            return len(buf)
        return int(starts[at[-1]])

    return step


#: A row for each header (bases -1), and for each size of line of a record that a buffer holds.
SHAPE_SCHEMA = "record bigint, bases bigint, width bigint, n bigint, line_no bigint, byte_offset bigint, last bigint, after bigint, name binary"


def _alignments(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where names and sequences, columns 1 and 10 of SAM, start and end, in lines that are alignments with a sequence."""
    b = np.frombuffer(buf, dtype=np.uint8)
    some = starts < ends
    starts, ends = starts[some], ends[some]
    aligned = b[starts] != _AT
    starts, ends = starts[aligned], ends[aligned]
    # tabs beyond the end, so that each line has a ninth and a tenth to look at
    tabs = np.concatenate([np.flatnonzero(b == _TAB), np.full(10, len(b))])
    first = np.searchsorted(tabs, starts)
    whole = tabs[np.minimum(first + 8, len(tabs) - 1)] < ends
    starts, ends, first = starts[whole], ends[whole], first[whole]
    at, to = tabs[first + 8] + 1, np.minimum(tabs[first + 9], ends)
    there = (to - at != 1) | (b[np.minimum(at, len(b) - 1)] != _STAR)
    return starts[there], tabs[first][there], at[there], to[there]


def _owned(reader: _Reader, buf: bytes, offset: int, last: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(starts, ends) of the lines of a buffer that the range owns, and how many bytes are used."""
    starts, ends, after = _line_ends(buf, last)
    own = min(int(np.searchsorted(starts, reader.own_end - offset, side="right")), len(starts))
    return starts[:own], ends[:own], int(after[-1]) if len(after) else 0


def _sam(reader: _Reader, out: list) -> Callable:
    state = {"n": reader.r["sam0"]}

    def step(buf: bytes, offset: int, last: bool) -> int:
        starts, ends, used = _owned(reader, buf, offset, last)
        names, name_ends, seqs, seq_ends = _alignments(buf, starts, ends)
        if len(names):
            out.append(_batch(["record_index", "name", "seq"], [state["n"] + np.arange(len(names)), _slices(buf, names, name_ends), _slices(buf, seqs, seq_ends)]))
            state["n"] += len(names)
        return used

    return step


def _shapes(reader: _Reader, out: list) -> Callable:
    """What an index needs of the lines: by record and size of line how many there are, the first and the last of them."""
    state = {"line": reader.r["line0"], "record": reader.r["record0"] - 1}
    names = ["record", "bases", "width", "n", "line_no", "byte_offset", "last", "after", "name"]

    def step(buf: bytes, offset: int, last: bool) -> int:
        starts, ends, after = _line_ends(buf, last)
        own = min(int(np.searchsorted(starts, reader.own_end - offset, side="right")), len(starts))
        if own:
            s, e, a = starts[:own], ends[:own], after[:own]
            b = np.frombuffer(buf, dtype=np.uint8)
            head = (e > s) & (b[np.minimum(s, len(b) - 1)] == _GT)
            record = state["record"] + np.cumsum(head)
            line = state["line"] + np.arange(own)
            state["line"] += own
            state["record"] = int(record[-1])
            at = np.flatnonzero(head)
            if len(at):
                minus, one = np.full(len(at), -1), np.ones(len(at), np.int64)
                out.append(_batch(names, [record[at], minus, minus, one, line[at], s[at] + offset, line[at], a[at] + offset, _slices(buf, s[at], e[at])]))
            at = np.flatnonzero(~head)
            if len(at):
                at = at[np.lexsort(((a - s)[at], (e - s)[at], record[at]))]  # lines of a size stay in order
                keys = record[at], (e - s)[at], (a - s)[at]
                new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
                end = np.append(new[1:], len(at))
                out.append(_batch(names, [*[k[new] for k in keys], end - new, line[at[new]], s[at[new]] + offset, line[at[end - 1]], a[at[end - 1]] + offset, pa.nulls(len(new), pa.binary())]))
        return int(after[-1]) if len(after) else 0

    return step


#: What the shape of a file follows from, counted over a part of its lines.
_COUNTS = ["h", "b", "n", "even", "odd", "full"]
COUNT_SCHEMA = "path string, " + ", ".join(f"{c} bigint" for c in _COUNTS)


def _counted(transport: Transport) -> Callable:
    """For each range the first header line and the last blank line, and how many headers, headers on even and odd lines and full lines there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for r in _each(batches):
            reader = _Reader(r, transport)
            at, first, blank, n, even, full, lines = r["line0"], None, None, 0, 0, 0, 0

            def step(buf: bytes, offset: int, last: bool) -> int:
                nonlocal at, first, blank, n, even, full, lines
                starts, ends, used = _owned(reader, buf, offset, last)
                some = ends > starts
                heads = np.flatnonzero(some & (np.frombuffer(buf, dtype=np.uint8)[np.minimum(starts, len(buf) - 1)] == _GT)) if len(starts) else starts
                if len(heads):
                    first = at + int(heads[0]) if first is None else first
                    n, even = n + len(heads), even + int(np.count_nonzero((heads + at) % 2 == 0))
                none = np.flatnonzero(~some)
                blank = at + int(none[-1]) if len(none) else blank
                full, at, lines = full + len(some) - len(none), at + len(some), lines + len(some)
                return used

            for _ in reader.buffers(step):
                pass
            reader.source.close()
            if lines:
                rows.append((r["path"], first, blank, n, even, n - even, full))
            if len(rows) == 4096:
                yield _counts(rows)
                rows = []
        yield _counts(rows)

    return count


def _counts(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 7
    return _batch(["path", *_COUNTS], [pa.array(cols[0], pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]])


def scan_line_counts(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE, transport: Transport = PLAIN) -> DataFrame:
    """A row for each range with a line (COUNT_SCHEMA): no line leaves its task, and files of one range are a row each."""
    return numbered(spark, path, range_bytes, False, transport).mapInArrow(_counted(transport), COUNT_SCHEMA)


def _scan(spark: SparkSession, path: str | list[str], range_bytes: int, stream: bool, transport: Transport, read: Callable, schema: str) -> DataFrame:
    return numbered(spark, path, range_bytes, stream, transport).mapInArrow(lambda b: _run(read, b, transport), schema)


def scan_lines(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE, stream: bool = False, transport: Transport = PLAIN) -> DataFrame:
    """(path, line_no, byte_offset, width, line): all lines, CR before LF taken off, numbers and offsets in the decoded stream.

    In all scans, numbers begin anew in each file; with `stream` they go on from file to file, by name.
    """
    return _scan(spark, path, range_bytes, stream, transport, _lines, LINE_SCHEMA)


def scan_fastq(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE, stream: bool = False, transport: Transport = PLAIN) -> DataFrame:
    """All four-line records, unchecked, with the places of their lines (FASTQ_SCAN_SCHEMA); the last may be cut short."""
    return _scan(spark, path, range_bytes, stream, transport, _fastq, FASTQ_SCAN_SCHEMA)


def scan_packed(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE, stream: bool = False, transport: Transport = PLAIN) -> DataFrame:
    """The records of scan_fastq with their packed bases and Phred summaries (FASTQ_PACKED_SCHEMA), without a second way through Python."""
    return _scan(spark, path, range_bytes, stream, transport, _packed, FASTQ_PACKED_SCHEMA)


def scan_fasta(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE, stream: bool = False, transport: Transport = PLAIN) -> DataFrame:
    """All records, sequence lines joined (FASTA_SCAN_SCHEMA); text before the first header is a record without a name."""
    return _scan(spark, path, range_bytes, stream, transport, _fasta, FASTA_SCAN_SCHEMA)


def scan_sam(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE, transport: Transport = PLAIN) -> DataFrame:
    """(record_index, name, seq): SAM alignments that have a sequence, numbered over all files by name.

    Each range's alignments are counted and the counts summed over ranges, so a record has its number when it is read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            reader, n = _Reader(r, transport), 0

            def step(buf: bytes, offset: int, last: bool) -> int:
                nonlocal n
                starts, ends, used = _owned(reader, buf, offset, last)
                n += len(_alignments(buf, starts, ends)[0])
                return used

            for _ in reader.buffers(step):
                pass
            reader.source.close()
            yield pa.RecordBatch.from_pylist([{**r, "alignments": n}], schema=counted)

    names = [*_NUMBERED, "alignments"]
    counted = pa.schema([(c, pa.string() if c == "path" else pa.int64()) for c in names])
    seen = numbered(spark, path, range_bytes, True, transport).mapInArrow(count, ", ".join(f"{c} {'string' if c == 'path' else 'bigint'}" for c in names))
    sum_before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    seen = seen.withColumn("sam0", sum_before("alignments", W.partitionBy("path").orderBy("byte0"))).withColumn("file_end", F.col("sam0") + F.col("alignments"))
    files = seen.groupBy("path").agg(F.max("file_end").alias("n")).select("path", sum_before("n", W.orderBy("path")).alias("base"))  # a row for each file
    seen = seen.join(files, "path").select(*_NUMBERED, (F.col("sam0") + F.col("base")).alias("sam0"))
    return seen.repartition(_tasks(spark, list_files(spark, path), range_bytes)).mapInArrow(lambda b: _run(_sam, b, transport), "record_index bigint, name binary, seq binary")


def scan_two_line(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE, stream: bool = False, transport: Transport = PLAIN) -> DataFrame:
    """Lines in pairs, unchecked: (path, record_index, byte_offset, name, seq, seq_offset, n_lines)."""
    return _scan(spark, path, range_bytes, stream, transport, _two_line, "path string, record_index bigint, byte_offset bigint, name binary, seq binary, seq_offset bigint, n_lines int")


def scan_shapes(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE) -> DataFrame:
    """Headers and line sizes of FASTA records (SHAPE_SCHEMA), summed within buffers; no sequence leaves the task."""
    return _scan(spark, path, range_bytes, False, PLAIN, _shapes, SHAPE_SCHEMA)


#: Decoded blocks that a task hands on at a time.
_AT_ONCE = 64


def _block_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range how many blocks begin in it before an end block, their decoded bytes, and where the end block is, by headers alone."""
    for r in _each(batches):
        n, made, stop = 0, 0, None
        with open_at(r["path"]) as f:
            at = bgzf.first_block(f, r["start"], r["size"])
            for offset, size, out in bgzf.hop(f, at, r["end"]) if at is not None else ():
                if out == 0 and size == len(bgzf.EOF_BLOCK):
                    stop = offset
                    break
                n, made = n + 1, made + out
        yield _batch(["path", "size", "start", "end", "n", "b", "stop"], [[r["path"]], *[pa.array([x], pa.int64()) for x in (r["size"], r["start"], r["end"], n, made, stop)]])


def _blocks(decode: bool) -> Callable:
    """The blocks of ranges that know how many blocks (n0) and decoded bytes (b0) come before them, and where the end block is."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _each(batches):
            end = r["end"] if r["eof"] is None else min(r["end"], r["eof"])
            index, before, rows = r["n0"], r["b0"], []
            with open_at(r["path"]) as f:
                at = bgzf.first_block(f, r["start"], r["size"])
                if at is None:
                    continue
                found = ((o, len(block), len(data), data) for o, block, data in bgzf.read_blocks(f, at, end)) if decode else ((*b, None) for b in bgzf.hop(f, at, end))
                for offset, size, out, data in found:
                    rows.append((index, offset, before, size, out, data)[: 6 if decode else 5])
                    index, before = index + 1, before + out
                    if len(rows) == (_AT_ONCE if decode else 4096):
                        yield _block_batch(r["path"], rows)
                        rows = []
            if rows:
                yield _block_batch(r["path"], rows)

    return read


def _block_batch(path: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary()]
    names = ["path", "block_index", "compressed_offset", "uncompressed_offset", "compressed_size", "uncompressed_size", "data"]
    return _batch(names[: len(rows[0]) + 1], [pa.array([path] * len(rows), pa.string()), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]])


def bgzf_blocks(spark: SparkSession, path: str | list[str], decode: bool = False, range_bytes: int = RANGE) -> DataFrame:
    """The blocks of block-gzip files (BGZF_INDEX_SCHEMA, and data if decoded) up to the first end block, which is left out.

    A first pass over the headers counts the blocks of each range, a running sum over ranges numbers them, and the
    second pass reads them with their numbers: no block is shuffled, joined or broadcast.
    """
    found = files_table(spark, path)
    tasks = _tasks_of(spark, _sizes(found, range_bytes), range_bytes)
    counts = _cut(found, range_bytes).repartition(tasks).mapInArrow(_block_counts, "path string, size bigint, start bigint, end bigint, n bigint, b bigint, stop bigint")
    order = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0).cast("long"))
    base = counts.select("path", "size", "start", "end", before("n").alias("n0"), before("b").alias("b0"), F.min("stop").over(W.partitionBy("path")).alias("eof"))
    base = base.where("eof is null or start < eof").repartition(tasks)
    return base.mapInArrow(_blocks(decode), BGZF_INDEX_SCHEMA + (", data binary" if decode else ""))


_REPORT = "path string, start bigint, compressed_offset bigint, compressed_size bigint, uncompressed_size bigint, message string"


def _next_block(f, at: int, stop: int, size: int) -> int | None:
    """Where the first block from a place on begins that is whole and has another behind it, or the end; None if there is none before `stop`."""
    while at < stop:
        found = bgzf.first_block(f, at, size)
        f.seek(at)
        marker = f.read(2 * bgzf.MAX_BLOCK + len(bgzf.EOF_BLOCK)).find(bgzf.EOF_BLOCK)  # an end block, whatever stands behind it
        if marker >= 0:
            found = at + marker if found is None else min(found, at + marker)
        if found is not None:
            return found if found < stop else None
        at += 2 * bgzf.MAX_BLOCK
    return None


def _checked_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block from a range's first to the first of the ranges behind, and one where none begins but should; payloads are inflated and dropped here."""
    for r in _each(batches):
        rows: list[tuple] = []
        with open_at(r["path"]) as f:
            at, size = _next_block(f, r["start"], r["end"], r["size"]), r["size"]
            limit = _next_block(f, r["end"], size, size) if at is not None else None
            limit = size if limit is None else limit
            while at is not None and at < limit:
                f.seek(at)
                header = f.read(PREFIX)
                try:
                    if len(header) < PREFIX:
                        raise BgzfError("short block")
                    own = bgzf.block_size(header)
                except BgzfError as e:
                    rows.append((at, None, None, e.detail))
                    at = _next_block(f, at + 1, limit, size)
                    continue
                block = header + f.read(own - PREFIX)
                try:
                    if len(block) < own:
                        raise BgzfError("short block")
                    rows.append((at, own, len(bgzf.inflate(block)), None))
                except BgzfError as e:
                    rows.append((at, own, None, e.detail))
                at += own
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield _batch(["path", "start", "compressed_offset", "compressed_size", "uncompressed_size", "message"], [pa.array([r["path"]] * len(rows), pa.string()), pa.array([r["start"]] * len(rows), pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]])


def bgzf_errors(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE) -> DataFrame:
    """(path, compressed_offset, message): all that is wrong with block-gzip files; none of an intact one.

    Ranges are checked side by side: headers, sizes, payloads and their CRC. A block whose payload is damaged is
    passed over; where a header is, reading goes on with the next block that has a whole one behind it, and what
    lies between isn't judged. A task goes on to where a following range finds its first block, so no block is
    left out. Then the end block must be there and be the last. Sizes alone leave the tasks.
    """
    return _block_errors(spark, files_table(spark, path), range_bytes)


def _block_errors(spark: SparkSession, files: DataFrame, range_bytes: int) -> DataFrame:
    """bgzf_errors of a table of files."""
    tasks = _tasks_of(spark, _sizes(files, range_bytes), range_bytes)
    blocks = _cut(files, range_bytes).repartition(tasks).mapInArrow(_checked_blocks, _REPORT)
    end = F.col("compressed_offset") + F.col("compressed_size")
    whole = F.col("message").isNull()
    marker = whole & (F.col("uncompressed_size") == 0) & (F.col("compressed_size") == len(bgzf.EOF_BLOCK))
    each = blocks.groupBy("path", "start").agg(F.min(F.when(marker, end)).alias("eof"), F.collect_list(F.when(~whole, F.struct("compressed_offset", "message"))).alias("errors"))
    # what stands behind an end block is trailing bytes, whatever it is
    inner = each.select("path", F.min("eof").over(W.partitionBy("path")).alias("stop"), "errors").select("path", "stop", F.explode("errors").alias("e"))
    inner = inner.where("stop is null or e.compressed_offset < stop").select("path", "e.*")
    ends = each.groupBy("path").agg(F.min("eof").alias("eof"))
    at_end = files.join(ends, "path", "left").select(
        "path", F.coalesce("eof", "size").alias("compressed_offset"),
        F.when(F.col("eof").isNull(), "missing BGZF EOF marker").when(F.col("eof") != F.col("size"), "trailing bytes after BGZF EOF marker").alias("message"),
    )
    return inner.union(at_end.where("message is not null"))


def check_bgzf(spark: SparkSession, path: str) -> DataFrame:
    """The strict index of a file: every block inflates, an end block is there and nothing follows it; else the first error is raised."""
    first = bgzf_errors(spark, path).agg(F.min(F.struct("compressed_offset", "message")).alias("e")).first().e
    if first is not None:
        raise BgzfError(first.message)
    return bgzf_blocks(spark, path)


def transport_errors(spark: SparkSession, path: str | list[str], transport: Transport = PLAIN, range_bytes: int = RANGE) -> DataFrame:
    """(path, kind, decoded bigint, message): the files that can't be decoded whole or go beyond a limit, with the bytes decoded before.

    A gzip file is one task's, which drops what it decodes; block gzip is checked by ranges, and its first error told. Raw files have none.
    Files are dealt to tasks by their bytes, and no row of them passes the driver.
    """
    found = files_table(spark, path)
    sizes = _sizes(found, range_bytes)
    files = found.repartition(_tasks_of(spark, sizes, range_bytes))

    def sniff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocked = []
            for p in b.column("path").to_pylist():
                with open_at(p) as f:
                    blocked.append(kind_of(f.read(PREFIX)) == BGZF)
            yield b.filter(pa.array(blocked, pa.bool_()))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad: list[tuple] = []
            for p in b.column("path").to_pylist():
                made = 0
                with open_at(p) as f:
                    kind = kind_of(f.read(PREFIX))
                    if kind != GZIP:
                        continue
                    try:
                        for part in gunzip(f, *transport[1:4]):
                            made += len(part)
                    except OSError as e:
                        bad.append((p, kind, made, str(e)))
            cols = list(zip(*bad, strict=True)) or [(), (), (), ()]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string()]
            yield _batch(["path", "kind", "decoded", "message"], [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)])

    bad = files.mapInArrow(decode, "path string, kind string, decoded bigint, message string")
    blocked = files.mapInArrow(sniff, "path string, size bigint")
    if not blocked.isEmpty():
        first = _block_errors(spark, blocked, range_bytes).groupBy("path").agg(F.min(F.struct("compressed_offset", "message"))["message"].alias("message"))
        bad = bad.union(first.select("path", F.lit(BGZF), F.lit(None).cast("bigint"), "message"))
    return bad
