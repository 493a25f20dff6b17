"""FASTQ tables: checked records, mate pairs, packed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packing, records
from ..sources.pairs import scan_interleaved, scan_pairs
from ..sources.scan import PLAIN, RANGE, Transport, scan_fastq, scan_packed

#: Messages of the formats.
MISMATCH = "paired FASTQ record identifiers do not match"
COUNTS = "paired FASTQ inputs have different record counts"
UNPAIRED = "interleaved FASTQ ended with an unpaired record"
_COLUMNS = ["path", "record_index", "byte_offset", "name", "seq", "plus", "qual"]


def read_fastq(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST", validate: bool = True, max_record_bytes: int | None = None, range_bytes: int = RANGE, stream: bool = False, transport: Transport = PLAIN) -> DataFrame:
    """Records of FASTQ files, raw, gzip or block gzip by their magic bytes (FASTQ_SCHEMA; _error if PERMISSIVE).

    Without validate only records that are cut short are errors. max_record_bytes limits the bytes of
    the four lines; there is no limit by default. With stream the files, by name, are one stream.
    Nothing is read before a job asks for it.
    """
    rows = scan_fastq(spark, path, range_bytes, stream, transport)
    error = records.fastq_error() if validate else F.when(F.col("n_lines") < 4, records.fastq_error())
    if max_record_bytes is not None:
        size = F.col("qual_offset") - F.col("byte_offset") + F.octet_length("qual") + 1
        too_long = F.concat(F.lit("record exceeds slab size ("), size.cast("string"), F.lit(" bytes)"))
        error = F.when(size > max_record_bytes, F.struct(F.lit("format").alias("kind"), too_long.alias("message"), F.col("byte_offset").alias("byte_offset"), F.col("record_index").alias("record_index"), F.lit(0).alias("line_index"))).otherwise(error)
    return records.with_mode(rows.select(*_COLUMNS, error.alias("_error")), mode)


def _mate(prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{c}") for c in ("record_index", "byte_offset", "name", "seq", "plus", "qual")]


def ids_match(first: Column, second: Column, mode: str) -> Column:
    """Whether the headers of two mates belong together.

    full: equal tokens less /1 or /2 of either. fast_slash: where the first ends in /1, tried on the
    header and then on its token, the second must be the same with /2; else as full. none: always.
    """
    full = records.pair_id(first) == records.pair_id(second)
    if mode == "none":
        return F.lit(True)
    if mode == "full":
        return full
    if mode != "fast_slash":
        raise ValueError(f"pair validation {mode}")

    def slash(a: Column, b: Column) -> tuple[Column, Column]:
        long = (F.length(a) >= 3) & (F.length(a) == F.length(b)) & F.endswith(a, F.lit("/1"))
        return long, F.endswith(b, F.lit("/2")) & (F.substr(a, F.lit(1), F.length(a) - 1) == F.substr(b, F.lit(1), F.length(b) - 1))

    whole, same = slash(records.text(first), records.text(second))
    token, same_token = slash(records.id_token(first), records.id_token(second))
    return F.when(whole, same).when(token, same_token).otherwise(full)


def pair_files(first: DataFrame, second: DataFrame, validation: str = "full", mode: str = "FAILFAST") -> DataFrame:
    """(pair_index, pair_id, first, second): record i of one table with record i of the other, by an equi-join on the index.

    Errors are of the second mate's header where ids differ, and of the first surplus record where the
    numbers of records differ, which comes after all pairs.
    """
    a = first.select(F.col("record_index").alias("pair_index"), F.struct("record_index", "byte_offset", "name", "seq", "plus", "qual").alias("first"))
    b = second.select(F.col("record_index").alias("pair_index"), F.struct("record_index", "byte_offset", "name", "seq", "plus", "qual").alias("second"))
    return _checked(a.join(b, "pair_index", "full_outer"), validation, mode, COUNTS)


def pair_interleaved(rows: DataFrame, validation: str = "full", mode: str = "FAILFAST") -> DataFrame:
    """The same pairs from one table in which mates follow each other: records 2 i and 2 i + 1, by a group-by on the index."""
    record = F.struct("record_index", "byte_offset", "name", "seq", "plus", "qual")
    even = F.col("record_index") % 2 == 0
    pairs = rows.groupBy(F.floor(F.col("record_index") / 2).alias("pair_index")).agg(F.max_by(F.when(even, record), even).alias("first"), F.max_by(F.when(~even, record), ~even).alias("second"))
    return _checked(pairs, validation, mode, UNPAIRED)


def _checked(pairs: DataFrame, validation: str, mode: str, surplus: str, before: Column | None = None, more: tuple = ()) -> DataFrame:
    """before: errors that come before those of the pair; more: further columns."""
    alone = F.coalesce("second", "first")
    error = lambda message, at: F.struct(F.lit("format").alias("kind"), F.lit(message).alias("message"), at["byte_offset"].alias("byte_offset"), at["record_index"].alias("record_index"), F.lit(0).alias("line_index"))
    one = F.col("first").isNull() | F.col("second").isNull()
    differ = ~ids_match(F.col("first.name"), F.col("second.name"), validation)
    found = F.when(one, error(surplus, alone)).when(differ, error(MISMATCH, F.col("second")))
    mates = [F.when(F.col(m).isNotNull(), F.struct(*[F.col(f"{m}.{c}") for c in _COLUMNS[1:]])).alias(m) for m in ("first", "second")]
    rows = pairs.select("pair_index", records.pair_id("first.name").alias("pair_id"), *mates, *more, F.lit("").alias("path"), (found if before is None else F.coalesce(before, found)).alias("_error"))
    return records.with_mode(rows, mode).drop("path")


def _mate_errors(validate: bool, packed: bool = False) -> Column:
    found = []
    for i, m in enumerate(("first.", "second."), 1):
        error = records.fastq_error(trusted=packed, of=m)
        found.append(error if validate else F.when(F.col(f"{m}n_lines") < 4, error))
        if packed:
            found.append(records.phred_error(m, f"bad_phred_{i}"))
    return F.coalesce(*found)


def read_paired_fastq(spark: SparkSession, first: str | list[str], second: str | list[str], validation: str = "full", mode: str = "FAILFAST", validate: bool = True, range_bytes: int = RANGE, transport: Transport = PLAIN) -> DataFrame:
    """(pair_index, pair_id, first, second) of two streams, each the files of a path by name, read side by side: no record is shuffled.

    Errors are of the mates' records, first before second, then those of pair_files; PERMISSIVE keeps the pair with its _error.
    """
    return _checked(scan_pairs(spark, first, second, range_bytes, transport), validation, mode, COUNTS, _mate_errors(validate))


def read_interleaved_fastq(spark: SparkSession, path: str | list[str], validation: str = "full", mode: str = "FAILFAST", validate: bool = True, range_bytes: int = RANGE, transport: Transport = PLAIN) -> DataFrame:
    """The same of one stream in which mates follow each other, made by the reader."""
    return _checked(scan_interleaved(spark, path, range_bytes, transport), validation, mode, UNPAIRED, _mate_errors(validate))


_PACKED = ("packed_1", "quality_1", "packed_2", "quality_2")


def pack_paired_fastq(spark: SparkSession, first: str | list[str], second: str | list[str], validation: str = "full", mode: str = "FAILFAST", range_bytes: int = RANGE, transport: Transport = PLAIN) -> DataFrame:
    """The pairs of read_paired_fastq with packed and quality of both mates, in one pass; qualities must be Phred+33."""
    return _checked(scan_pairs(spark, first, second, range_bytes, transport, True), validation, mode, COUNTS, _mate_errors(True, True), _PACKED)


def pack_interleaved_fastq(spark: SparkSession, path: str | list[str], validation: str = "full", mode: str = "FAILFAST", range_bytes: int = RANGE, transport: Transport = PLAIN) -> DataFrame:
    """The same of one stream in which mates follow each other."""
    return _checked(scan_interleaved(spark, path, range_bytes, transport, True), validation, mode, UNPAIRED, _mate_errors(True, True), _PACKED)


def pack(rows: DataFrame, prefix: str = "") -> DataFrame:
    """rows with `packed` and `quality` structs of seq and qual; columns are found under the prefix."""
    return rows.withColumn("packed", packing.pack_bases(f"{prefix}seq")).withColumn("quality", packing.summarize_qualities(f"{prefix}qual"))


def pack_trusted(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST", range_bytes: int = RANGE, stream: bool = False) -> DataFrame:
    """Packed records of a stream: always checked, but ids may be empty, and qualities must be Phred+33. One pass makes and packs them."""
    rows = scan_packed(spark, path, range_bytes, stream)
    error = F.coalesce(records.fastq_error(trusted=True), records.phred_error())
    return records.with_mode(rows.select(*_COLUMNS, "packed", "quality", error.alias("_error")), mode)


def pack_pairs(pairs: DataFrame) -> DataFrame:
    """pair_index, pair_id, and packed and quality of both mates."""
    return pairs.select(
        "pair_index", "pair_id",
        packing.pack_bases("first.seq").alias("packed_1"), packing.summarize_qualities("first.qual").alias("quality_1"),
        packing.pack_bases("second.seq").alias("packed_2"), packing.summarize_qualities("second.qual").alias("quality_2"),
    )
