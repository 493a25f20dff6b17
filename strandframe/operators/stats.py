"""Stream statistics with order-dependent checksums of 64 bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import packing, records

#: Fixed values of the checksums.
PRIME = 1099511628211
FASTA_START = 14695981039346656037
_MASK = (1 << 64) - 1


#: Powers of the inverse of PRIME for the places in a block of indexes.
_INVERSE = pow(PRIME, -1, 1 << 64)
_BLOCK = 1 << 16


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each batch of (i, v, ...): the sum of v * PRIME^-i mod 2^64 in two halves, the rows, and the sums of the other columns.

    The checksum c <- (c * PRIME + v) mod 2^64 over n rows is PRIME^(n - 1) times the sum of all v * PRIME^-i:
    PRIME is odd, so it has an inverse, and a sum needs no order.
    """
    with np.errstate(over="ignore"):
        powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(_BLOCK - 1, _INVERSE, dtype=np.uint64))])
    for b in batches:
        if not b.num_rows:
            continue
        i, v = b.column("i").to_numpy(), b.column("v").to_numpy().view(np.uint64)
        block = i // _BLOCK
        total = 0
        with np.errstate(over="ignore"):
            terms = v * powers[i % _BLOCK]
            for k in np.unique(block).tolist():
                total += int(terms[block == k].sum(dtype=np.uint64)) * pow(_INVERSE, k * _BLOCK, 1 << 64)
        total &= _MASK
        sums = [int(b.column(c).to_numpy().sum()) for c in b.schema.names[2:]]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (total >> 32, total & 0xFFFFFFFF, b.num_rows, *sums)], ["high", "low", "n", *b.schema.names[2:]])


@F.arrow_udf(T.StringType())
def _unfolded(high: pa.Array, low: pa.Array, n: pa.Array) -> pa.Array:
    rows = zip(high.to_pylist(), low.to_pylist(), n.to_pylist(), strict=True)
    return pa.array([str((((h or 0) << 32) + (x or 0)) * pow(PRIME, m - 1, 1 << 64) & _MASK) if m else "0" for h, x, m in rows], pa.string())


def _first_byte(seq: Column) -> Column:
    return F.coalesce(F.ascii(records.text(F.substring(seq, 1, 1))), F.lit(0)).cast("long")


def _step(seq: Column, more: Column | None = None) -> Column:
    """PRIME * first byte + length (+ more), under 2^63."""
    step = _first_byte(seq) * F.lit(PRIME) + F.octet_length(seq)
    return step if more is None else step + more


def stream_stats(rows: DataFrame, packed: bool = False) -> DataFrame:
    """One row: records, bases, qualities, name_bytes, checksum (text) of records by record_index, from 0 without gaps; FASTA has no qualities.

    One pass: batches become sums in the tasks, whatever their order. packed: the checksum also takes each record's canonical bases and Phred sum, from columns `packed` and `quality`.
    """
    more = None
    if packed:
        more = F.col("packed.a") + F.col("packed.c") + F.col("packed.g") + F.col("packed.t") + F.col("quality.sum_phred")
    quals = F.octet_length("qual").cast("long") if "qual" in rows.columns else F.lit(0).cast("long")
    narrow = rows.select(F.col("record_index").alias("i"), _step(F.col("seq"), more).alias("v"), F.octet_length("seq").cast("long").alias("b"), quals.alias("q"), F.octet_length("name").cast("long").alias("m"))
    parts = narrow.mapInArrow(_folded, "high bigint, low bigint, n bigint, b bigint, q bigint, m bigint")
    zero = F.lit(0).cast("long")
    sums = parts.agg(*[F.coalesce(F.sum(c), zero).alias(n) for c, n in (("high", "high"), ("low", "low"), ("n", "records"), ("b", "bases"), ("q", "qualities"), ("m", "name_bytes"))])
    return sums.select("records", "bases", "qualities", "name_bytes", _unfolded("high", "low", "records").alias("checksum"))


def fasta_checksum(triples: Iterator[tuple[int, int, int]]) -> int:
    """The FASTA checksum of (length, first, last) in order. It mixes xor, rotation and product, so it has no shorter form."""
    c = FASTA_START
    for length, first, last in triples:
        c ^= length
        c = ((c << 5) | (c >> 59)) & _MASK
        c = (c * PRIME) & _MASK
        c ^= first
        c ^= last << 8
    return c


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns n, f, l of a batch as the bytes of three arrays."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.column(c).cast(t).to_numpy().tobytes()], pa.binary()) for c, t in (("n", pa.int64()), ("f", pa.uint8()), ("l", pa.uint8()))], ["n", "f", "l"])


def fasta_stats(rows: DataFrame) -> DataFrame:
    """One row: records, bases, checksum (text).

    The checksum takes records one after the other and has no form that tasks could sum. So ten bytes a
    record, not its sequence, come to the driver in order, a partition at a time.
    """
    last = F.coalesce(F.ascii(records.text(F.substring("seq", -1, 1))), F.lit(0)).cast("long")
    narrow = rows.select("record_index", F.octet_length("seq").cast("long").alias("n"), _first_byte(F.col("seq")).alias("f"), last.alias("l"))
    packed = narrow.sort("record_index").select("n", "f", "l").mapInArrow(_triples, "n binary, f binary, l binary")
    count = bases = 0

    def each() -> Iterator[tuple[int, int, int]]:
        nonlocal count, bases
        for r in packed.toLocalIterator():
            n = np.frombuffer(r.n, dtype=np.int64)
            count, bases = count + len(n), bases + int(n.sum())
            yield from zip(n.tolist(), r.f, r.l, strict=True)

    checksum = fasta_checksum(each())
    return rows.sparkSession.createDataFrame([(count, bases, str(checksum))], "records bigint, bases bigint, checksum string")


def base_totals(rows: DataFrame) -> DataFrame:
    """One row: sums of base_counts over all records."""
    c = rows.select(packing.base_counts("seq").alias("c"))
    return c.agg(*[F.coalesce(F.sum(f"c.{n}"), F.lit(0).cast("long")).alias(n) for n in ("len", "a", "c", "g", "t", "n", "gc_bases", "canonical_bases")])


def quality_totals(rows: DataFrame) -> DataFrame:
    """One row: the Phred summary of all qualities together."""
    q = rows.select(packing.summarize_qualities("qual").alias("q"))
    zero = F.lit(0).cast("long")
    sums = [F.coalesce(F.sum(f"q.{n}"), zero).alias(n) for n in ("len", "sum_phred", "q20_bases", "q30_bases")]
    got = q.agg(*sums, F.min("q.min_phred").alias("min_phred"), F.max("q.max_phred").alias("max_phred"))
    return got.withColumn("mean_phred", F.when(F.col("len") > 0, F.col("sum_phred") / F.col("len")))
