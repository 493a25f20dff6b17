"""Columns of sequence records: names, identifiers, pair identifiers, and what is wrong with a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SequenceFormatError

LATIN = "ISO-8859-1"


def text(b: Column | str) -> Column:
    """Bytes as characters, one for one."""
    return F.decode(b, LATIN)


def raw(s: Column | str) -> Column:
    return F.encode(s, LATIN)


def name_without_prefix(name: Column | str) -> Column:
    """The header less one leading @ or >."""
    t = text(name)
    return F.when(F.substring(t, 1, 1).isin("@", ">"), F.substr(t, F.lit(2))).otherwise(t)


def id_token(name: Column | str) -> Column:
    """The header's first token, without the prefix; blanks are space, tab, LF, FF and CR, but not VT."""
    return F.regexp_extract(name_without_prefix(name), r"^([^ \t\n\f\r]*)", 1)


def pair_id(name: Column | str) -> Column:
    """The token less a final /1 or /2."""
    return F.regexp_replace(id_token(name), r"/[12]\z", "")


def _error(*cases: tuple[Column, Column, Column, Column], of: str = "") -> Column:
    """The first of (condition, message, byte offset, line) that holds, as an error; null if none does. of: the struct of the record and a dot."""
    out = None
    for condition, message, offset, line in cases:
        e = F.struct(F.lit("format").alias("kind"), message.alias("message"), offset.cast("long").alias("byte_offset"), F.col(f"{of}record_index").alias("record_index"), line.cast("int").alias("line_index"))
        out = F.when(condition, e) if out is None else out.when(condition, e)
    return out


def fastq_error(trusted: bool = False, of: str = "") -> Column:
    """What is wrong with a row of a FASTQ scan, in the order in which a reader finds it. trusted: ids may be empty. of: prefix of its columns."""
    col = lambda c: F.col(f"{of}{c}")
    fault = lambda bit: col("faults").bitwiseAND(F.lit(bit)) != 0
    cases = [
        (fault(1), F.lit("truncated FASTQ record"), col("byte_offset"), col("n_lines")),
        (fault(2), F.lit("header must start with `@`"), col("byte_offset"), F.lit(0)),
        (fault(4), F.lit("empty FASTQ id"), col("byte_offset"), F.lit(0)),
        (fault(8), F.lit("plus line must start with `+`"), col("plus_offset"), F.lit(2)),
        (fault(16), F.concat(F.lit("quality length "), F.octet_length(col("qual")).cast("string"), F.lit(" != sequence length "), F.octet_length(col("seq")).cast("string")), col("qual_offset"), F.lit(3)),
    ]
    return F.when(col("faults") != 0, _error(*(c for i, c in enumerate(cases) if not (trusted and i == 2)), of=of))


def phred_error(of: str = "", bad: str = "bad_phred") -> Column:
    """A quality byte outside of ! to ~, of a packing scan; its place is where the quality line starts."""
    at = F.col(bad)
    byte = F.conv(F.hex(F.substr(F.col(f"{of}qual"), at + 1, F.lit(1))), 16, 10)
    message = F.concat(F.lit("invalid Phred+33 quality byte "), byte, F.lit(" at offset "), at.cast("string"))
    return _error((at.isNotNull(), message, F.col(f"{of}qual_offset"), F.lit(3)), of=of)


def fasta_error() -> Column:
    """What is wrong with a row of a FASTA scan."""
    return _error(
        (F.col("name").isNull(), F.lit("FASTA record header must start with `>`"), F.col("byte_offset"), F.lit(0)),
        (id_token("name") == "", F.lit("empty FASTA id"), F.col("byte_offset"), F.lit(0)),
    )


def first_error(rows: DataFrame) -> SequenceFormatError | None:
    """The error nearest to the start of the first file of a PERMISSIVE table, as an exception; it runs a job."""
    e = rows.where("_error is not null").agg(F.min(F.struct("path", "_error.record_index", "_error.byte_offset", "_error.line_index", "_error.message")).alias("e")).first().e
    return SequenceFormatError(e.message, e.byte_offset, e.record_index, e.line_index) if e else None


def failing(rows: DataFrame) -> DataFrame:
    """rows less _error; a job that meets a row with an error fails with its message. A filter does it, so no projection can prune it."""
    e = F.col("_error")
    said = F.concat(F.lit("parse error at byte "), e["byte_offset"], F.lit(", record "), e["record_index"], F.lit(", line "), e["line_index"], F.lit(": "), e["message"])
    return rows.where(F.when(e.isNull(), F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))).drop("_error")


def with_mode(rows: DataFrame, mode: str) -> DataFrame:
    """PERMISSIVE keeps _error, DROPMALFORMED drops the rows that have one; with FAILFAST the job that meets one fails.

    Of several errors the job reports the one that a task meets first; first_error finds the first of the stream.
    """
    mode = mode.upper()
    if mode == "PERMISSIVE":
        return rows
    if mode == "DROPMALFORMED":
        return rows.where("_error is null").drop("_error")
    if mode != "FAILFAST":
        raise ValueError(f"mode {mode}")
    return failing(rows)
