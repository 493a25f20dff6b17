"""Queries against their SQL, the command line, SQL names, formats and streams."""

import gzip

import duckdb
import pytest
from pyspark.sql import functions as F

from strandframe import cli
from strandframe.functions.register import load, register
from strandframe.operators import stats
from strandframe.plans import registry
from strandframe.sources import bgzf, sinks
from strandframe.sources.files import detect_kinds, files_table, list_files
from strandframe.sources.scan import check_bgzf
from strandframe.sources.sinks import write_bgzf, write_text
from strandframe.streaming.files import stream_files

SF = "/root/testdata/sf0.001"
#: One or two of each family; the driver compares all of them.
CHOSEN = "fastq_scan_bgzf fastq_stream_stats fastq_pack_stats fastq_validation_report pack_bases packed_base_at quality_bins paired_fast_slash paired_count_mismatch interleaved_pairs fasta_stats fai_bgzf fasta_fetch_bgzf fetch_partition bgzf_virtual_offset_asof sam_checksum fastq_format transport_damage lenient_records oversized_records interleaved_odd phred_errors bgzf_damage fai_errors fai_line_errors".split()


@pytest.mark.parametrize("name", CHOSEN)
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("orders", "supplier"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(registry.SQL[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def _agree(spark, name, folder, table):
    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    got, want = registry.QUERIES[name](spark, str(folder)).toPandas(), con.sql(registry.SQL[name]).df()
    cols = sorted(want.columns)
    rows = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
    assert rows(got) == rows(want)
    return want


def test_short_lines_behind_a_line_of_their_size(spark, tmp_path):
    # references 3 to 33 of one order, of lines of 1, 2 and 3 bases
    duckdb.sql(f"copy (select 32 * i + i % 3 as o_orderkey, 3 + 5 * i as o_custkey from range(7) t(i)) to '{tmp_path}/orders.parquet'")
    want = _agree(spark, "fai_errors", tmp_path, "orders")
    assert want.message.isna().sum() == 2 and (want.message == "duplicate FASTA index reference name").sum() == 1


@pytest.mark.parametrize("name", ["lenient_records", "transport_damage"])
def test_many_damaged_files(spark, tmp_path, name):
    # names of three digits: nine bytes less took the last two records with them; 1000 files are no 1000 tasks
    duckdb.sql(f"copy (select i as s_suppkey from range(0, 1000) t(i)) to '{tmp_path}/supplier.parquet'")
    _agree(spark, name, tmp_path, "supplier")
    if name == "transport_damage":
        rows = registry.QUERIES[name](spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_files_are_listed_by_tasks(spark, tmp_path):
    for name in ("a.fa", "x/b.fa", "x/_hidden", ".h/c.fa", "x/y/d.fa", "z/.e.fa"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(">a\n" + name)
    for path in (str(tmp_path), [f"{tmp_path}/a.fa", f"{tmp_path}/[xz]"], f"{tmp_path}/x/b.fa"):
        assert sorted(map(tuple, files_table(spark, path).collect())) == list_files(spark, path)
    with pytest.raises(FileNotFoundError):
        files_table(spark, f"{tmp_path}/none")


def test_every_query_has_sql():
    assert set(registry.SQL) == set(registry.QUERIES)


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.fa").write_text(">alpha first\nGATTA\nCAGAT\nTAC\n>beta\nCC\n")
    (tmp_path / "a.fai").write_text("alpha\t13\t13\t5\t6\nbeta\t2\t35\t2\t3\n")
    (tmp_path / "a.sam").write_text("@CO\tmade by hand\nq7\t0\t*\t0\t0\t*\t*\t0\t0\tGATTACA\t*\nq8\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    (tmp_path / "a.bgz").write_bytes(bgzf.compress(b"@q\nGAT\n+\n#5?\n"))
    return tmp_path


def run(spark, *args):
    return list(cli.run(spark, [str(a) for a in args]))


def test_commands(spark, files):
    assert run(spark, "fasta-index", files / "a.fa") == ["alpha\t13\t13\t5\t6", "beta\t2\t35\t2\t3"]
    assert run(spark, "fasta-fetch", files / "a.fa", "--fai", files / "a.fai", "--name", "alpha", "--start", 3, "--end", 9) == ["TACAGA"]
    assert run(spark, "fasta-chunks", files / "a.fa", "--fai", files / "a.fai", "--name", "alpha", "--start", 4, "--end", 13, "--chunk-bases", 4) == ["alpha\t4\tACAG", "alpha\t8\tATTA", "alpha\t12\tC"]
    parts = [tuple(line.split("\t")[1:4]) for line in run(spark, "fasta-partitions", files / "a.fa", "--fai", files / "a.fai", "--parts", 3, "--overlap", 1)]
    assert parts == [("alpha", "0", "5"), ("alpha", "5", "10"), ("alpha", "10", "13"), ("beta", "0", "2")]
    assert run(spark, "checksum", "--format", "sam", files / "a.sam")[:2] == ["records\t1", "bases\t7"]
    assert run(spark, "stats", files / "a.bgz") == ["records\t1", "bases\t3", "qualities\t3", "name_bytes\t2", f"checksum\t{ord('G') * stats.PRIME + 3}"]
    assert run(spark, "verify-bgzf", files / "a.bgz")[:3] == ["status\tok", "blocks\t1", "uncompressed_len\t13"]
    for bad in (["nonsense"], ["stats"], ["checksum", "x"], ["fasta-fetch", files / "a.fa", "--fai", files / "a.fai", "--name", "alpha", "--start", "x", "--end", 8]):
        with pytest.raises(cli.UsageError):
            run(spark, *bad)


def test_sql_names(spark, files):
    register(spark)
    row = spark.sql("select id_token(encode('@a/1 x', 'utf-8')) a, pair_normalized_id(encode('@a/1 x', 'utf-8')) b, virtual_offset(123, 45) c, packed_base_len(5) d, hex(pack_bases(encode('ACGT', 'utf-8')).bases) e").first()
    assert tuple(row) == ("a/1", "a", 123 << 16 | 45, 2, "E4")
    assert spark.read.format("fastq").load(str(files / "a.bgz")).count() == 1
    assert spark.read.format("fasta").load(str(files / "a.fa")).count() == 2


@pytest.mark.parametrize("transport", ["raw", "bgzf"])
def test_formats_split_files_and_prune_ranges(spark, tmp_path, transport):
    n = 4000
    text = "".join(f"@r{i}\n{'ACGT' * (i % 9)}\n+\n{'IIII' * (i % 9)}\n" for i in range(n)).encode()
    for name in ("a.fq", "b.fq"):
        data = text if transport == "raw" else b"".join(bgzf.deflate(text[i : i + 4000]) for i in range(0, len(text), 4000)) + bgzf.EOF_BLOCK
        (tmp_path / name).write_bytes(data)
    size = (tmp_path / "a.fq").stat().st_size
    rows = load(spark, "fastq", str(tmp_path / "*.fq"), -(-size // 50))
    assert rows.rdd.getNumPartitions() > 50
    assert rows.groupBy("path").agg(F.count("*"), F.max("record_index"), F.countDistinct("name")).select("count(1)", "max(record_index)", "count(DISTINCT name)").collect() == [(n, n - 1, n)] * 2
    some = rows.where("record_index >= 1000 and record_index < 1100")
    assert some.rdd.getNumPartitions() < 20 and some.count() == 200
    path = rows.where("path like '%a.fq'").first().path
    one = rows.where(F.col("path") == path).where(F.col("record_index").isin(5, 17))
    assert one.rdd.getNumPartitions() <= 4 and sorted(bytes(r.name) for r in one.collect()) == [b"@r17", b"@r5"]
    assert rows.where("record_index > 3998 and record_index <= 3999").count() == 2 and rows.where("record_index = 4000").count() == 0
    spark.sql(f"create or replace temporary view fq using fastq options (path '{tmp_path}/a.fq')")
    assert spark.sql("select max(record_index) from fq").first()[0] == n - 1


def test_formats_of_indexes_and_names_of_sql(spark, files):
    register(spark)
    assert [tuple(r)[1:] for r in spark.read.format("fai").load(str(files / "a.fai")).collect()] == [("alpha", 13, 13, 5, 6), ("beta", 2, 35, 2, 3)]
    assert [tuple(r)[1:] for r in spark.read.format("bgzf_blocks").load(str(files / "a.bgz")).collect()] == [(0, 0, 0, (files / "a.bgz").stat().st_size - 28, 13)]
    fasta = load(spark, "fasta", str(files / "a.fa"), 12).sort("record_index").collect()
    assert [(bytes(r.name), bytes(r.seq)) for r in fasta] == [(b">alpha first", b"GATTACAGATTAC"), (b">beta", b"CC")]
    spans = spark.sql("select * from fasta_spans(3, 9, 13, 5, 6)").collect()
    assert [tuple(r) for r in spans] == [(0, 16, 18), (1, 19, 23)]
    assert spark.sql("select hex(bin_qualities(encode('!+5?I', 'utf-8'), array(10, 20, 30))) b").first().b == "0001020303"


def test_writers(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id", "concat('@r', id, '\n', repeat('ACGT', 20), '\n+\n', repeat('I', 80)) as value")
    write_bgzf(rows, str(tmp_path / "b"), "id", files=3)
    write_text(rows, str(tmp_path / "t"), "id", files=2)
    kinds = {r.kind for r in detect_kinds(spark, str(tmp_path / "b")).collect()}
    assert kinds == {"bgzf"}
    from strandframe.operators.fastq import read_fastq

    assert read_fastq(spark, str(tmp_path / "b"), range_bytes=4096).count() == 5000
    assert read_fastq(spark, str(tmp_path / "t"), range_bytes=4096).count() == 5000


@pytest.mark.parametrize("transport", ["raw", "gzip", "bgzf"])
def test_one_file_of_many_tasks(spark, tmp_path, monkeypatch, transport):
    rows = spark.range(9000).repartition(5).selectExpr("id", "concat('@r', id, '\n', repeat('ACGT', 20), '\n+\n', repeat(char(33 + id % 90), 80)) as value")
    join = sinks.join_files
    monkeypatch.setattr(sinks, "join_files", lambda *a: join(*a, at_once=10_000))
    path = str(tmp_path / "new" / "one")
    parts = sinks.write_one(rows, path, "id", transport, files=3, blocks_at_once=4)
    assert parts >= 3
    want = "".join(f"@r{i}\n{'ACGT' * 20}\n+\n{chr(33 + i % 90) * 80}\n" for i in range(9000)).encode()
    data = (tmp_path / "new" / "one").read_bytes()
    if transport == "bgzf":
        assert data == bgzf.compress(want)  # block by block what one writer makes, with one end block
        assert check_bgzf(spark, path).count() == -(-len(want) // bgzf.PAYLOAD)
    else:
        assert (gzip.decompress(data) if transport == "gzip" else data) == want
    from strandframe.operators.fastq import read_fastq

    assert read_fastq(spark, path, range_bytes=50_000).agg(F.max("record_index")).first()[0] == 8999
    empty = str(tmp_path / "none")
    sinks.write_one(rows.where("false"), empty, "id", transport)
    data = (tmp_path / "none").read_bytes()
    assert data == bgzf.EOF_BLOCK if transport == "bgzf" else (gzip.decompress(data) if data else data) == b""
    with pytest.raises(ValueError, match="mounted"):
        sinks.join_files(spark, [], "s3://bucket/one")


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.fastq").write_text("@r\nACGT\n+\nIIII\n" * (i + 1))
    seen = []
    query = stream_files(spark, str(folder), lambda rows, batch: seen.append(rows.count())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sum(seen) == 6
