"""Deterministic reads and references."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the generators.
DNA = "ACGT"
PROTEIN = "ACDEFGHIKLMNPQRSTVWY"
SALT_SYMBOLS = 0xA0761D6478BD642F
SALT_QUALITIES = 0xE7037ED1A0B428DB
STEP = 0x9E3779B97F4A7C15
OUTPUT = 0x2545F4914F6CDD1D


def _entropy(index: np.ndarray, length: int, salt: int, phase: int) -> np.ndarray:
    """Output words (records, length) of an xorshift generator for each index."""
    with np.errstate(over="ignore"):
        s = np.uint64(salt) ^ (index.astype(np.uint64) * np.uint64(STEP)) ^ (np.uint64(phase) << np.uint64(32))
        out = np.empty((len(index), length), dtype=np.uint64)
        for j in range(length):
            s ^= s >> np.uint64(12)
            s ^= s << np.uint64(25)
            s ^= s >> np.uint64(27)
            out[:, j] = s * np.uint64(OUTPUT)
    return out


def _symbols(index: np.ndarray, length: int, alphabet: str, pattern: str, phase: int) -> np.ndarray:
    letters = np.frombuffer(alphabet.encode(), dtype=np.uint8)
    if pattern == "cyclic":
        return letters[(index[:, None] + np.arange(length) + phase) % len(letters)]
    return letters[(_entropy(index, length, SALT_SYMBOLS, phase) % np.uint64(len(letters))).astype(np.int64)]


def synthetic_fastq(spark: SparkSession, records: int, length: int, pattern: str = "cyclic", mate: int | None = None) -> DataFrame:
    """(record_index, name, seq, plus, qual): reads r0, r1, ... or, with mate 1 or 2, frag0/1, ...; pattern cyclic or entropy."""
    phase = 0 if mate in (None, 1) else 1
    name = F.concat(F.lit("@r"), F.col("id")) if mate is None else F.concat(F.lit("@frag"), F.col("id"), F.lit(f"/{mate}"))

    @F.arrow_udf("struct<seq: string, qual: string>")
    def made(ids: pa.Array) -> pa.Array:
        index = ids.to_numpy()
        seq = _symbols(index, length, DNA, pattern, phase)
        if pattern == "cyclic":
            qual = np.full((len(index), length), ord("I"), dtype=np.uint8)
        else:
            qual = (33 + _entropy(index, length, SALT_QUALITIES, phase) % np.uint64(41)).astype(np.uint8)
        return pa.StructArray.from_arrays([pa.array([r.tobytes().decode() for r in x], pa.string()) for x in (seq, qual)], ["seq", "qual"])

    rows = spark.range(records).select("id", name.alias("name"), made("id").alias("x"))
    return rows.select(F.col("id").alias("record_index"), "name", "x.seq", F.lit("+").alias("plus"), "x.qual")


def synthetic_interleaved(spark: SparkSession, pairs: int, length: int, pattern: str = "cyclic") -> DataFrame:
    """Mates 1 and 2 in turn, with one record_index."""
    mates = [synthetic_fastq(spark, pairs, length, pattern, m).withColumn("record_index", 2 * F.col("record_index") + m - 1) for m in (1, 2)]
    return mates[0].union(mates[1])


def synthetic_fasta(spark: SparkSession, records: int, length: int, pattern: str = "cyclic", alphabet: str = DNA, width: int | None = None) -> DataFrame:
    """(record_index, name, seq). With width the entropy pattern begins anew on each line, as wrapped files have it."""

    @F.arrow_udf("string")
    def made(ids: pa.Array) -> pa.Array:
        index = ids.to_numpy()
        if pattern == "cyclic" or not width:
            parts = [_symbols(index, length, alphabet, pattern, 0)]
        else:
            parts = [_symbols(index + at, min(width, length - at), alphabet, pattern, 0) for at in range(0, length, width)]
        return pa.array([r.tobytes().decode() for r in np.concatenate(parts, axis=1)], pa.string())

    return spark.range(records).select(F.col("id").alias("record_index"), F.concat(F.lit(">r"), F.col("id")).alias("name"), made("id").alias("seq"))
