"""FASTA tables: checked records, shapes, .fai indexes, range fetch, chunks, partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import records
from ..sources import bgzf
from ..sources.files import BGZF, PREFIX, RAW, kind_of, list_files, open_at
from ..sources.scan import PLAIN, RANGE, Transport, bgzf_blocks, scan_fasta, scan_line_counts, scan_lines, scan_shapes, scan_two_line

_COLUMNS = ["path", "record_index", "byte_offset", "name", "seq"]
U64 = 1 << 64


def read_fasta(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST", range_bytes: int = RANGE, stream: bool = False, transport: Transport = PLAIN) -> DataFrame:
    """Records of FASTA files, sequence lines joined, blank lines ignored (FASTA_SCHEMA; _error if PERMISSIVE).

    With stream the files, by name, are one stream. Nothing is read before a job asks for it.
    """
    rows = scan_fasta(spark, path, range_bytes, stream, transport)
    return records.with_mode(rows.select(*_COLUMNS, records.fasta_error().alias("_error")), mode)


def read_two_line_fasta(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST", range_bytes: int = RANGE, stream: bool = False, transport: Transport = PLAIN) -> DataFrame:
    """Records of strict two-line FASTA: header and sequence lines in turn, nothing else. Pairs are made in the scan."""
    rows = scan_two_line(spark, path, range_bytes, stream, transport)
    first = lambda c: F.substring(records.text(c), 1, 1)
    error = lambda message, at, line: F.struct(F.lit("format").alias("kind"), F.lit(message).alias("message"), at.alias("byte_offset"), F.col("record_index").alias("record_index"), F.lit(line).alias("line_index"))
    found = (
        F.when((first("name") != ">") & (F.col("record_index") > 0), error("two-line FASTA sequence must be followed by a header", F.col("byte_offset"), 0))
        .when(first("name") != ">", error("two-line FASTA record header must start with `>`", F.col("byte_offset"), 0))
        .when(records.id_token("name") == "", error("empty FASTA id", F.col("byte_offset"), 0))
        .when((F.col("n_lines") < 2) | (F.octet_length("seq") == 0) | (first("seq") == ">"), error("two-line FASTA record is missing a sequence line", F.coalesce("seq_offset", "byte_offset"), 1))
    )
    return records.with_mode(rows.select(*_COLUMNS, found.alias("_error")), mode)


def read_fasta_auto(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST", range_bytes: int = RANGE, transport: Transport = PLAIN) -> DataFrame:
    """Records of FASTA files, each read as its shape asks: strict pairs of lines where all its lines are such, else joined lines.

    Shapes take a pass over the lines and a row a file; numbers are per file.
    """
    shapes = {r.path: r["shape"] for r in fasta_shape(spark, path, range_bytes, transport).collect()}
    two, other = ([p for p, kind in shapes.items() if (kind == "TwoLine") == want] for want in (True, False))
    # a two-line file may begin with blank lines, which only the joining reader takes
    parts = [read(spark, paths, mode, range_bytes, transport=transport) for read, paths in ((read_two_line_fasta, [p for p in two if not _begins_blank(p, transport)]), (read_fasta, other + [p for p in two if _begins_blank(p, transport)])) if paths]
    if not parts:
        return read_fasta(spark, path, mode, range_bytes, transport=transport)
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def _begins_blank(path: str, transport: Transport) -> bool:
    with open_at(path) as f:
        head = f.read(PREFIX)
        if transport.decode and kind_of(head) != RAW:
            return True  # not known without decoding: the joining reader takes either
    return head[:1] in (b"\n", b"\r")


def fasta_shape(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE, transport: Transport = PLAIN) -> DataFrame:
    """(path, shape): Empty, TwoLine or Multiline of each file that has a line; blank lines before the first header don't count. Lines are counted in the tasks that read them."""
    counts = scan_line_counts(spark, path, range_bytes, transport)
    seen = counts.groupBy("path").agg(F.min("h").alias("h"), F.max("b").alias("b"), *[F.sum(c).alias(c) for c in ("n", "even", "odd", "full")])
    two = ((F.col("b").isNull()) | (F.col("b") < F.col("h"))) & (F.col("full") == 2 * F.col("n")) & F.when(F.col("h") % 2 == 0, F.col("even") == F.col("n")).otherwise(F.col("odd") == F.col("n"))
    return seen.select("path", F.when(F.col("full") == 0, "Empty").when(two, "TwoLine").otherwise("Multiline").alias("shape"))


def _repeated(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with `repeated`, whether the key has come before. Keys are counted in tasks first; only those that come again are joined."""
    again = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")).where("_n > 1")
    return rows.join(again, F.col(key) == F.col("_key"), "left").withColumn("repeated", F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_key", "_n", "_first")


def build_fai(spark: SparkSession, path: str, range_bytes: int = RANGE, mode: str = "FAILFAST") -> DataFrame:
    """(ref_index, name, len, offset, line_bases, line_width, virtual_offset) of a wrapped FASTA file; sequences aren't joined.

    Tasks sum lines by record and size, so they hand on a few rows a record. Blank sequence lines and
    uneven wrapping are errors of the job that meets them, as are names that have come before; PERMISSIVE goes on
    after them and keeps a record with its _error, text before the first record at ref_index -1. virtual_offset is
    given for block gzip.
    """
    parts = scan_shapes(spark, path, range_bytes)
    first = F.struct("line_no", "byte_offset")
    shapes = parts.groupBy("record", "bases", "width").agg(F.sum("n").alias("n"), F.min(first).alias("first"), F.max("last").alias("last"), F.max("after").alias("after"), F.max("name").alias("name"))
    body, head = F.col("bases") > 0, F.col("bases") < 0
    where = lambda condition, x: F.when(condition, x)
    per = shapes.groupBy("record").agg(
        F.sum(where(body, F.col("bases") * F.col("n"))).alias("len"), F.min(where(body, F.struct(F.col("first.line_no").alias("l"), F.col("first.byte_offset").alias("offset"), "bases", "width"))).alias("f"),
        F.max(where(body, F.struct("last", "bases", "width"))).alias("e"), F.sum(where(body, F.col("n"))).alias("n"), F.collect_list(where(body, F.struct("bases", "width", "n"))).alias("shapes"),
        F.max(where(F.col("bases") == 0, F.col("last"))).alias("blank"), F.max("name").alias("name"), F.max(where(head, F.col("first.byte_offset"))).alias("byte_offset"), F.max(where(head, F.col("after"))).alias("head_end"), F.max("after").alias("end"),
    )
    own = F.filter("shapes", lambda s: (s["bases"] == F.col("f.bases")) & (s["width"] == F.col("f.width")))
    first_n = F.coalesce(F.get(own, F.lit(0))["n"], F.lit(0))
    end_is_first = (F.col("e.bases") == F.col("f.bases")) & (F.col("e.width") == F.col("f.width"))
    uneven = F.col("n") - first_n > F.when(end_is_first, 0).otherwise(1)
    longer = F.col("e.bases") > F.col("f.bases")
    name = records.id_token("name")
    message = (
        F.when((F.col("record") < 0) & F.col("f").isNotNull(), "FASTA record header must start with `>`")
        .when(F.col("record") < 0, F.lit(None))
        .when(F.col("id") == "", "empty FASTA id")
        .when(F.col("blank") > F.col("f.l"), "FASTA index does not support blank sequence lines")
        .when(longer & ~uneven, "FASTA final sequence line is longer than the first sequence line")
        .when(uneven, "non-final FASTA sequence line has inconsistent wrapping")
        .when(F.col("repeated"), "duplicate FASTA index reference name")
    )
    zero = F.lit(0).cast("long")
    # a record without bases has for offset what a reader has reached when it learns that: past the next header, or the end
    following = per.select((F.col("record") - 1).alias("record"), F.col("head_end").alias("next_end"))
    got = _repeated(per.withColumn("id", name), "id", "record").join(following, "record", "left")
    place = F.struct(F.lit("format").alias("kind"), message.alias("message"), F.coalesce("byte_offset", "f.offset", zero).alias("byte_offset"), F.greatest("record", zero).alias("record_index"), F.lit(0).alias("line_index"))
    got = got.select(
        F.col("record").alias("ref_index"), F.col("id").alias("name"), F.coalesce("len", zero).alias("len"), F.coalesce("f.offset", "next_end", "end").alias("offset"),
        F.coalesce("f.bases", zero).alias("line_bases"), F.coalesce("f.width", zero).alias("line_width"), F.when(message.isNotNull(), place).alias("_error"),
    )
    kept = "ref_index >= 0 or _error is not null" if mode.upper() == "PERMISSIVE" else "ref_index >= 0"
    got = records.with_mode(got.withColumn("path", F.lit(path)), mode).drop("path").where(kept)
    with open_at(path) as f:
        kind = kind_of(f.read(PREFIX))
    if kind != BGZF:
        return got.withColumn("virtual_offset", F.lit(None).cast("long"))
    return with_virtual_offset(got, bgzf_blocks(spark, path, range_bytes=range_bytes), "offset")


def with_virtual_offset(rows: DataFrame, blocks: DataFrame, offset: str) -> DataFrame:
    """rows with virtual_offset: the block that holds an offset of the decoded stream, and the place in it; null past the end.

    Offsets and blocks meet in buckets of 64 KiB, of which a block touches two at most: an equi-join, with a check.
    """
    size = 1 << 16
    b = blocks.where("uncompressed_size > 0").select(F.col("compressed_offset").alias("_c"), F.col("uncompressed_offset").alias("_u"), F.col("uncompressed_size").alias("_s"))
    b = b.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_u") / size), F.floor((F.col("_u") + F.col("_s") - 1) / size))))
    at = F.col(offset)
    near = rows.withColumn("_b", F.floor(at / size))
    got = near.join(b, (F.col("_b") == F.col("_k")) & (at >= F.col("_u")) & (at < F.col("_u") + F.col("_s")), "left")
    return got.withColumn("virtual_offset", F.shiftleft(F.col("_c"), 16).bitwiseOR(at - F.col("_u"))).drop("_b", "_k", "_c", "_u", "_s")


def virtual_offset(compressed: int, within: int) -> int:
    """48 bits of block offset, 16 of place in the block."""
    if not 0 <= compressed < 1 << 48:
        raise ValueError("BGZF virtual offset out of range")
    return compressed << 16 | within


def fai_lines(fai: DataFrame) -> DataFrame:
    """The index as `value`, a tab-separated line a reference, with ref_index to sort by."""
    return fai.select("ref_index", F.concat_ws("\t", "name", *[F.col(c).cast("string") for c in ("len", "offset", "line_bases", "line_width")]).alias("value"))


def fai_rows(spark: SparkSession, path: str) -> DataFrame:
    """(ref_index, name, len, offset, line_bases, line_width, line_no, message) of the lines of a .fai file; message: what is wrong with one."""
    lines = scan_lines(spark, path).select("line_no", records.text("line").alias("value")).where("value <> ''")
    f = F.split("value", "\t")
    names = ["len", "offset", "line_bases", "line_width"]
    whole = F.size(f) == 5
    rows = lines.select("line_no", whole.alias("whole"), F.get(f, F.lit(0)).alias("name"), *[F.when(whole & F.get(f, F.lit(i + 1)).rlike(r"^\+?[0-9]+$"), F.expr(f"try_cast(get(split(value, '\\t'), {i + 1}) as decimal(38, 0))")).alias(c) for i, c in enumerate(names)])
    bad = F.when(~F.col("whole"), "expected 5 tab-separated fields").when(F.col("name") == "", "empty reference name")
    for c in names:
        bad = bad.when(F.col(c).isNull() | (F.col(c) >= F.lit(str(U64)).cast("decimal(38,0)")), f"invalid {c.replace('_', ' ')}")
    bad = bad.when((F.col("len") > 0) & (F.col("line_bases") == 0), "line bases must be positive").when(F.col("line_width") < F.col("line_bases"), "line width is less than line bases")
    bad = bad.when(F.col("repeated"), "duplicate reference name")
    too_far = F.col("offset") + F.col("len") + F.col("line_width") >= F.lit(str(1 << 63)).cast("decimal(38,0)")
    number = (F.col("line_no") + 1).cast("string")
    said = F.when(bad.isNotNull(), F.concat(F.lit("invalid .fai line "), number, F.lit(": "), bad)).when(too_far, F.concat(F.lit("FASTA sequence offset overflowed, .fai line "), number))
    # blank lines aren't counted: lines are numbered within stretches, and stretches by their sums
    stretch = F.shiftright("line_no", 16)
    before = lines.groupBy(stretch.alias("_stretch")).agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_stretch", (F.sum("_n").over(W.orderBy("_stretch")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy("_stretch").orderBy("line_no"))
    rows = _repeated(rows, "name", "line_no").withColumn("_stretch", stretch).join(before, "_stretch")
    return rows.select((F.col("_before") + within - 1).alias("ref_index"), "name", *[F.col(c).cast("long").alias(c) for c in names], "line_no", said.alias("message"))


def read_fai(spark: SparkSession, path: str, mode: str = "FAILFAST") -> DataFrame:
    """(ref_index, name, len, offset, line_bases, line_width) from a .fai file; a job that meets a bad line fails with its number, from 1.

    PERMISSIVE keeps bad lines, with line_no (from 0) and the message of each line or null; DROPMALFORMED drops them.
    """
    rows = fai_rows(spark, path)
    if mode.upper() == "PERMISSIVE":
        return rows
    if mode.upper() == "DROPMALFORMED":
        return rows.where("message is null").drop("line_no", "message")
    if mode.upper() != "FAILFAST":
        raise ValueError(f"mode {mode}")
    return rows.where(F.when(F.col("message").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("parse error: "), "message")).cast("boolean"))).drop("line_no", "message")


def sequence_offset(position):
    """Byte offset of a base, for columns offset, len, line_bases, line_width; the end has the last base's offset and one."""
    at = lambda p: F.col("offset") + F.floor(p / F.col("line_bases")) * F.col("line_width") + p % F.col("line_bases")
    return F.when(F.col("len") == 0, F.col("offset")).when(position == F.col("len"), at(position - 1) + 1).when((position >= 0) & (position < F.col("len")), at(position))


def sequence_spans(rows: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """rows, once for each sequence line that [start, end) touches, with line, span_start and span_end in bytes; empty ranges give none."""
    s, e = F.col(start), F.col(end)
    first, last = F.floor(s / F.col("line_bases")), F.floor((e - 1) / F.col("line_bases"))
    spans = rows.where(e > s).withColumn("line", F.explode(F.sequence(first, last)))
    base = F.col("offset") + F.col("line") * F.col("line_width")
    low = F.greatest(s - F.col("line") * F.col("line_bases"), F.lit(0).cast("long"))
    high = F.least(e - F.col("line") * F.col("line_bases"), F.col("line_bases"))
    return spans.withColumn("span_start", base + low).withColumn("span_end", base + high)


def check_ranges(asked: DataFrame, fai: DataFrame) -> DataFrame:
    """(name, start, end, ...) joined to the index; a job that meets a range that can't be read fails."""
    got = asked.join(fai, "name", "left")
    bad = F.when(F.col("len").isNull(), F.concat(F.lit("FASTA reference not found in index: "), "name")).when(F.col("start") > F.col("end"), "FASTA range start must be <= end").when(F.col("end") > F.col("len"), "FASTA range end exceeds reference length")
    return got.where(F.when(bad.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("parse error: "), bad)).cast("boolean")))


def fetch(spark: SparkSession, path: str, asked: DataFrame, fai: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """asked (name, start, end, any more) with seq: the bases of each range, read where the index says.

    Ranges that lie near each other in the file go to one task, which takes them in the file's order; of block
    gzip it decodes the blocks of its ranges only, and those that follow each other once.
    """
    checked = check_ranges(asked, fai)
    low = sequence_offset(F.col("start"))
    high = F.when(F.col("end") > F.col("start"), sequence_offset(F.col("end") - 1) + 1).otherwise(low)
    ranged = checked.withColumn("_low", low).withColumn("_high", high)
    with open_at(path) as f:
        compressed = kind_of(f.read(PREFIX)) == BGZF
    if compressed:
        blocks = bgzf_blocks(spark, path, range_bytes=range_bytes)
        ranged = with_virtual_offset(ranged, blocks, "_low")
    else:
        ranged = ranged.withColumn("virtual_offset", F.lit(None).cast("long"))
    keep = asked.columns
    size = list_files(spark, path)[0][1]
    tasks = max(2 * spark.sparkContext.defaultParallelism, min(-(-size // range_bytes), 50_000))
    near = F.floor(F.col("_low") / max(1 << 12, size // (4 * tasks)))
    rows = ranged.select(*keep, "_low", "_high", "offset", "line_bases", "line_width", "virtual_offset").repartition(tasks, near).sortWithinPartitions("_low")
    schema = asked.schema.add("seq", "binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open_at(path) as f:
            recent: dict[int, tuple[int, bytes]] = {}
            for batch in batches:
                seqs = [read_range(f, r, recent) for r in batch.select(["_low", "_high", "offset", "line_bases", "line_width", "virtual_offset"]).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(seqs, pa.binary())], [*keep, "seq"])

    return rows.mapInArrow(read, schema)


def _block(f, offset: int, recent: dict[int, tuple[int, bytes]]) -> tuple[int, bytes]:
    """(where the next block starts, payload) of the block at an offset; a few blocks are kept in `recent`."""
    if offset not in recent:
        if len(recent) > 16:
            recent.clear()
        got = next(bgzf.read_blocks(f, offset), None)
        recent[offset] = (offset + len(got[1]), got[2]) if got else (offset, b"")
    return recent[offset]


def read_range(f, r: dict, recent: dict[int, tuple[int, bytes]]) -> bytes:
    """The bases between two byte offsets of the decoded stream, line breaks taken out by the index's widths."""
    n = r["_high"] - r["_low"]
    if n <= 0:
        return b""
    if r["virtual_offset"] is None:
        f.seek(r["_low"])
        data = f.read(n)
    else:
        skip, at = r["virtual_offset"] & 0xFFFF, r["virtual_offset"] >> 16
        pieces, held = [], 0
        while held < skip + n:
            after, payload = _block(f, at, recent)
            if not payload:
                break
            pieces.append(payload)
            held, at = held + len(payload), after
        data = b"".join(pieces)[skip : skip + n]
    if len(data) < n:
        raise OSError("failed to fill whole buffer")
    at, out = (r["_low"] - r["offset"]) % r["line_width"], []
    left = 0
    while left < n:
        take = min(r["line_bases"] - at, n - left)
        out.append(data[left : left + take])
        left += take + (r["line_width"] - r["line_bases"])
        at = 0
    return b"".join(out)


def chunks(asked: DataFrame, size: int) -> DataFrame:
    """asked (name, start, end), each range tiled by `size` bases (1 at least): name, start, end of each chunk; the last may be short."""
    size = max(1, size)
    tiled = asked.where("end > start").withColumn("_at", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(size).cast("long"))))
    return tiled.select("name", F.col("_at").alias("start"), F.least(F.col("_at") + size, "end").alias("end"))


def reference_chunks(spark: SparkSession, path: str, asked: DataFrame, fai: DataFrame, size: int) -> DataFrame:
    """(name, global_offset, seq) of the chunks of each range; a long reference is never one cell."""
    whole = check_ranges(asked, fai).select(*asked.columns)
    return fetch(spark, path, chunks(whole, size), fai).select("name", F.col("start").alias("global_offset"), "seq")


def plan_partitions(fai: DataFrame, target: int, overlap: int = 0) -> DataFrame:
    """(partition_index, name, core_start, core_end, fetch_start, fetch_end, core_len, core_offset_in_fetch).

    References are tiled by the ceiling of total / target; fetch ranges add the overlap on both sides, within the reference.
    """
    total = fai.agg(F.coalesce(F.sum("len"), F.lit(0).cast("long")).alias("_total"))
    tiled = fai.where("len > 0").join(F.broadcast(total))  # one row
    step = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("_total") / F.lit(max(1, target))))
    cores = tiled.withColumn("_step", step).withColumn("core_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1, F.col("_step"))))
    cores = cores.withColumn("core_end", F.least(F.col("core_start") + F.col("_step"), F.col("len")))
    order = W.orderBy("ref_index", "core_start")  # as many rows as partitions are asked for, and references
    got = cores.select(
        (F.row_number().over(order).cast("long") - 1).alias("partition_index"), "name", "core_start", "core_end",
        F.greatest(F.col("core_start") - overlap, F.lit(0).cast("long")).alias("fetch_start"), F.least(F.col("core_end") + overlap, F.col("len")).alias("fetch_end"),
    )
    return got.withColumn("core_len", F.col("core_end") - F.col("core_start")).withColumn("core_offset_in_fetch", F.col("core_start") - F.col("fetch_start"))


def fetch_partitions(spark: SparkSession, path: str, fai: DataFrame, target: int, overlap: int = 0) -> DataFrame:
    """The partitions with seq, the bases of their fetch ranges: a row each, read by the tasks."""
    plan = plan_partitions(fai, target, overlap)
    return fetch(spark, path, plan.withColumn("start", F.col("fetch_start")).withColumn("end", F.col("fetch_end")), fai).drop("start", "end")
