"""Command line: python -m strandframe.cli COMMAND ..."""

from __future__ import annotations

import shutil
import sys
from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import BgzfError, SequenceFormatError, from_spark
from .operators import fasta, fastq, sam, stats
from .sources.files import file_system, scratch
from .sources.scan import Transport, check_bgzf

USAGE = """usage: strandframe COMMAND
  stats [--format fastq|fasta] PATH
  checksum --format fastq|fasta|sam [PATH|-]
  fasta-index PATH
  fasta-fetch PATH --fai FAI --name NAME --start N --end N
  fasta-partitions PATH --fai FAI --parts N [--overlap N]
  fasta-chunks PATH --fai FAI --name NAME --start N --end N --chunk-bases N
  verify-bgzf PATH"""


class UsageError(ValueError):
    pass


def _options(args: list[str], known: set[str]) -> tuple[list[str], dict[str, str]]:
    rest, got = [], {}
    at = 0
    while at < len(args):
        if args[at].startswith("--"):
            if args[at] not in known:
                raise UsageError(f"unknown option: {args[at]}")
            if at + 1 == len(args):
                raise UsageError(f"missing value for {args[at]}")
            got[args[at]] = args[at + 1]
            at += 2
        else:
            rest.append(args[at])
            at += 1
    return rest, got


def _number(got: dict[str, str], name: str, default: int | None = None) -> int:
    if name not in got:
        if default is None:
            raise UsageError(f"missing {name}")
        return default
    if not got[name].isdigit():
        raise UsageError(f"invalid {name}: {got[name]}")
    return int(got[name])


def _path(rest: list[str]) -> str:
    if not rest:
        raise UsageError("missing path")
    return rest[0]


def _needed(got: dict[str, str], name: str) -> str:
    if name not in got:
        raise UsageError(f"missing {name}")
    return got[name]


def _totals(rows: DataFrame) -> Iterator[str]:
    r = stats.stream_stats(rows).first()
    for c in ("records", "bases", "qualities", "name_bytes", "checksum"):
        yield f"{c}\t{r[c]}"


def _rows(spark: SparkSession, path: str, kind: str, decode: bool = True) -> DataFrame:
    transport = Transport(decode=decode)
    if kind == "sam":
        return sam.read_sam(spark, path, transport)
    if kind not in ("fastq", "fasta"):
        raise UsageError(f"unknown format: {kind}")
    return fastq.read_fastq(spark, path, transport=transport) if kind == "fastq" else fasta.read_fasta(spark, path, transport=transport)


def _from_stdin(spark: SparkSession) -> str:
    """Standard input, copied to a file that tasks can read, a part at a time."""
    top = scratch(spark, "stdin")
    system, folder = file_system(top)
    system.create_dir(folder)
    with system.open_output_stream(f"{folder}/input") as f:
        shutil.copyfileobj(sys.stdin.buffer, f, 4 << 20)
    return f"{top}/input"


def run(spark: SparkSession, args: list[str]) -> Iterator[str]:
    """The lines that a command prints. Large results come a part at a time."""
    command, args = (args[0], args[1:]) if args else ("help", [])
    ranges = {"--fai", "--name", "--start", "--end"}
    if command in ("help", "--help", "-h"):
        yield USAGE
    elif command in ("stats", "checksum"):
        rest, got = _options(args, {"--format"})
        if command == "stats":
            yield from _totals(_rows(spark, _path(rest), got.get("--format", "fastq")))
            return
        # bytes as they come, from standard input without a path
        kind, path = _needed(got, "--format"), rest[0] if rest else "-"
        yield from _totals(_rows(spark, _from_stdin(spark) if path == "-" else path, kind, decode=False))
    elif command == "fasta-index":
        for r in fasta.fai_lines(fasta.build_fai(spark, _path(_options(args, set())[0]))).sort("ref_index").toLocalIterator():
            yield r.value
    elif command in ("fasta-fetch", "fasta-chunks"):
        rest, got = _options(args, ranges | ({"--chunk-bases"} if command == "fasta-chunks" else set()))
        path, fai = _path(rest), fasta.read_fai(spark, _needed(got, "--fai"))
        one = spark.createDataFrame([(_needed(got, "--name"), _number(got, "--start"), _number(got, "--end"))], "name string, start bigint, end bigint")
        if command == "fasta-fetch":
            yield fasta.fetch(spark, path, one, fai).first().seq.decode("latin-1")
        else:
            for r in fasta.reference_chunks(spark, path, one, fai, _number(got, "--chunk-bases")).sort("global_offset").toLocalIterator():
                yield f"{r['name']}\t{r.global_offset}\t{r.seq.decode('latin-1')}"
    elif command == "fasta-partitions":
        rest, got = _options(args, {"--fai", "--parts", "--overlap"})
        _path(rest)
        plan = fasta.plan_partitions(fasta.read_fai(spark, _needed(got, "--fai")), _number(got, "--parts"), _number(got, "--overlap", 0))
        for r in plan.sort("partition_index").toLocalIterator():
            yield "\t".join(str(r[c]) for c in ("partition_index", "name", "core_start", "core_end", "fetch_start", "fetch_end", "core_offset_in_fetch"))
    elif command == "verify-bgzf":
        path = _path(_options(args, set())[0])
        t = check_bgzf(spark, path).agg(F.count("*").alias("n"), F.coalesce(F.sum("uncompressed_size"), F.lit(0)).alias("u"), F.coalesce(F.max(F.col("compressed_offset") + F.col("compressed_size")), F.lit(0)).alias("c")).first()
        yield from (f"status\tok\nblocks\t{t.n}\nuncompressed_len\t{t.u}\ncompressed_len\t{t.c + 28}".split("\n"))
    else:
        raise UsageError(f"unknown command: {command}")


def main() -> int:
    spark = SparkSession.builder.appName("strandframe").getOrCreate()
    try:
        for line in run(spark, sys.argv[1:]):
            print(line)
    except (UsageError, SequenceFormatError, BgzfError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    except PySparkException as e:
        print(from_spark(e) or e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())

