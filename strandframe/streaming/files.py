"""Folders of sequence files as streams: each new file is a byte stream of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import fasta, fastq


def stream_files(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], kind: str = "fastq", mode: str = "PERMISSIVE", max_files: int = 1000) -> DataStreamWriter:
    """A stream writer that hands the records of each micro-batch's new files to `handle(records, batch_id)`.

    The file source finds the files and remembers them; contents are read by the batch scan, which
    splits large files. Record numbers are per file. Start it with a checkpoint location and a trigger.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).load(folder).select("path")
    read = {"fastq": fastq.read_fastq, "fasta": fasta.read_fasta}[kind]

    def each(batch: DataFrame, batch_id: int) -> None:
        paths = [r.path for r in batch.collect()]  # max_files of them at most
        if paths:
            handle(read(spark, paths, mode=mode), batch_id)

    return found.writeStream.foreachBatch(each)


def running_totals(spark: SparkSession, folder: str, schema: str = "path string, record_index bigint, byte_offset bigint, name binary, seq binary, plus binary, qual binary") -> DataFrame:
    """(records, bases) of a stream of Parquet records, as a streaming aggregate."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length("seq")), F.lit(0)).cast("long").alias("bases"))
