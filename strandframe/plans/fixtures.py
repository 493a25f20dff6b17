"""Sequence files made from the star-schema tables, and the SQL that gives the same records."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import file_system, list_files, open_at, scratch
from ..sources.sinks import write_bgzf, write_one, write_text

#: Ranges of scans in the queries: small, so that records cross them.
RANGE = 1 << 20


def load(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def reads_sql(salt: str = "1", prefix: str = "@L", suffix: str = "", whole: bool = False, numbered: bool = True) -> str:
    """idx (if numbered), k, name, seq, qual: a read for each order; bases and qualities from hashes of the key, 1 to 32 of them."""
    cut = "" if whole else ", 1, 1 + k % 32"
    part = lambda x: x if whole else f"substr({x}{cut})"
    idx = "row_number() over (order by k) - 1 as idx, " if numbered else ""
    return f"""(select {idx}k, concat('{prefix}', cast(k as varchar(20)), '{suffix}') as name,
        {part(f"translate(md5(concat('s{salt}', cast(k as varchar(20)))), '0123456789abcdef', 'ACGTACGTacgtACGN')")} as seq,
        {part(f"translate(md5(concat('q{salt}', cast(k as varchar(20)))), '0123456789abcdef', '!+5:?ABCDEFGHI#%')")} as qual
        from (select o_orderkey as k from orders) o)"""


def contig_lines_sql(numbered: bool = True) -> str:
    """custkey, k, line: the lines of a reference for each customer, of 32 bases but for the last."""
    return f"""(select c, k, case when row_number() over (partition by c order by k desc) = 1 then substr(seq, 1, 1 + k % 32) else seq end as line
        from (select o_custkey as c, o_orderkey as ok from orders) o join {reads_sql(whole=True, numbered=numbered)} r on o.ok = r.k)"""


def reads(spark: SparkSession, sf_dir: str, **kind) -> DataFrame:
    """k, name, seq, qual: a file sorted by k holds them in the order of idx."""
    load(spark, sf_dir, "orders")
    return spark.sql(f"select * from {reads_sql(numbered=False, **kind)} r")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c, name, seq, lines: the references of the customers; a reference is one row, as in the file formats."""
    load(spark, sf_dir, "orders")
    lines = spark.sql(f"select * from {contig_lines_sql(numbered=False)} l")
    rows = lines.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("x"))
    return rows.select("c", F.concat(F.lit(">c"), F.col("c").cast("string")).alias("name"), F.array_join("x.line", "").alias("seq"), F.col("x.line").alias("lines"))


def written(df: DataFrame, name: str, transport: str = "raw", order: str | list[str] = "k", files: int | None = None) -> str:
    """The files of the column `value` in a new scratch folder: ranges of the order, written side by side; one stream by name, or one file."""
    path = scratch(df.sparkSession, name)
    if files == 1:
        write_one(df, f"{path}/{name}", order, transport, blocks_at_once=8)
    elif transport == "bgzf":
        write_bgzf(df, path, order, files)
    else:
        write_text(df, path, order, compression="gzip" if transport == "gzip" else None, files=files)
    return path


def one_file(spark: SparkSession, folder: str) -> str:
    return list_files(spark, folder)[0][0]


def rewritten(spark: SparkSession, folder: str, name: str, times: int = 1, drop: int = 0, more: bytes = b"") -> str:
    """The files of a folder, written anew by tasks, a part at a time: several times over, less their last bytes, with more at the end."""
    top = scratch(spark, name)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size in zip(b.column("path").to_pylist(), b.column("size").to_pylist(), strict=True):
                system, out = file_system(top)
                system.create_dir(out)
                with system.open_output_stream(f"{out}/{path.rpartition('/')[2]}", compression=None) as f:
                    for _ in range(times):
                        left = size - drop
                        with open_at(path) as source:
                            while left > 0 and (part := source.read(min(left, 4 << 20))):
                                f.write(part)
                                left -= len(part)
                    f.write(more)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    found = list_files(spark, folder)
    spark.createDataFrame(found, "path string, size bigint").repartition(len(found)).mapInArrow(copy, "n bigint").agg(F.sum("n")).collect()
    return top


def gzip_each(df: DataFrame, name: str) -> str:
    """A gzip file for each row, by tasks: `value`, under `name`, in the `how` of the row: whole, cut, twice (two members) or wrong (checksum).

    A cut file lacks nine bytes, one of the compressed data and all behind it. It is flushed before they begin, so its
    bytes all come out; else the code that the cut goes through would take a match with it, and whole records.
    """
    top = scratch(df.sparkSession, name)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, out = file_system(top)
        system.create_dir(out)
        for b in batches:
            for name, value, how in zip(*[c.to_pylist() for c in b.columns], strict=True):
                data = gzip.compress(value.encode())
                data = {"whole": data, "cut": _flushed(value.encode())[:-9], "twice": data + data, "wrong": data[:-8] + bytes([data[-8] ^ 1]) + data[-7:]}[how]
                with system.open_output_stream(f"{out}/{name}", compression=None) as f:  # else its name makes it compress
                    f.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    # a row is a file to be made, so the rows are dealt to all cores
    df.select("name", "value", "how").repartition(df.sparkSession.sparkContext.defaultParallelism).mapInArrow(put, "n bigint").agg(F.sum("n")).collect()
    return top


def _flushed(data: bytes) -> bytes:
    """A gzip member whose end is ten bytes that add nothing to the data."""
    z = zlib.compressobj(wbits=31)
    return z.compress(data) + z.flush(zlib.Z_SYNC_FLUSH) + z.flush()


def poked(path: str, places: DataFrame) -> None:
    """Bytes of one file of a mounted folder turned round (each bit), at the places of column `at`, by tasks."""

    def poke(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = file_system(path)[1]
        for b in batches:
            with open(name, "r+b") as f:
                for at in b.column("at").to_pylist():
                    f.seek(at)
                    byte = f.read(1)[0]
                    f.seek(at)
                    f.write(bytes([byte ^ 0xFF]))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    places.select("at").mapInArrow(poke, "n bigint").agg(F.sum("n")).collect()


def fastq_value(name: str = "name", eol: str = "\n"):
    return F.concat_ws(eol, name, "seq", F.lit("+"), "qual") if eol == "\n" else F.concat(F.concat_ws(eol, name, "seq", F.lit("+"), "qual"), F.lit("\r"))


def fastq_file(spark: SparkSession, sf_dir: str, transport: str = "raw", eol: str = "\n", files: int | None = None, **kind) -> str:
    return written(reads(spark, sf_dir, **kind).withColumn("value", fastq_value(eol=eol)), "fastq", transport, files=files)


def fasta_file(spark: SparkSession, sf_dir: str, transport: str = "raw", files: int | None = None) -> str:
    rows = contigs(spark, sf_dir).withColumn("value", F.concat("name", F.lit("\n"), F.array_join("lines", "\n")))
    return written(rows, "fasta", transport, "c", files)
