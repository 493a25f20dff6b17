"""Sequences of SAM text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.scan import PLAIN, RANGE, Transport, scan_sam


def read_sam(spark: SparkSession, path: str | list[str], transport: Transport = PLAIN, range_bytes: int = RANGE) -> DataFrame:
    """(record_index, name, seq): columns 1 and 10 of alignment lines; headers, empty lines and sequences `*` aren't records."""
    return scan_sam(spark, path, range_bytes, transport)
