"""FASTQ, FASTA and block-gzip inputs with known results, whatever the transport and wherever the ranges are cut."""

import contextlib
import gzip
import io
import re
import time
import types
import zlib

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandframe.errors import BgzfError, from_spark
from strandframe.functions import packing, records
from strandframe.operators import fasta, fastq, sam, stats, synthetic
from strandframe.sources import bgzf, scan
from strandframe.sources.scan import CHUNK, bgzf_blocks, check_bgzf, gunzip, scan_lines


@contextlib.contextmanager
def failing(message=""):
    """A job that a parse error ends; the error is in `.value` afterwards."""
    box = types.SimpleNamespace(value=None)
    with pytest.raises(PySparkException) as e:
        yield box
    box.value = from_spark(e.value)
    assert box.value is not None, e.value
    assert re.search(message, box.value.detail), box.value.detail


@pytest.fixture
def put(tmp_path):
    def write(data, name="x", transport="raw"):
        data = data.encode() if isinstance(data, str) else data
        data = {"raw": bytes, "gzip": gzip.compress, "bgzf": bgzf.compress}[transport](data)
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)

    return write


FASTQ = "@r1\nACGT\n+\nIIII\n@r2 more\r\nTGCAA\r\n+x\r\nJJJJ@\r\n@r3\n\n+\n\n@@r4\nN\n+\n@"


@pytest.mark.parametrize("transport", ["raw", "gzip", "bgzf"])
@pytest.mark.parametrize("cut", [1, 3, 7, 16, 1 << 20])
def test_fastq_by_any_cut(spark, put, transport, cut):
    path = put(FASTQ, transport=transport)
    cut = max(cut, 9) if transport != "raw" else cut
    got = fastq.read_fastq(spark, path, range_bytes=cut).sort("record_index").collect()
    assert [(r.record_index, r.byte_offset, bytes(r.name), bytes(r.seq), bytes(r.plus), bytes(r.qual)) for r in got] == [
        (0, 0, b"@r1", b"ACGT", b"+", b"IIII"), (1, 16, b"@r2 more", b"TGCAA", b"+x", b"JJJJ@"), (2, 44, b"@r3", b"", b"+", b""), (3, 52, b"@@r4", b"N", b"+", b"@"),
    ]


@pytest.mark.parametrize(
    ("data", "message", "place"),
    [
        ("@r1\nACGT\n-\nIIII\n", "plus line must start with `+`", (9, 0, 2)),
        ("@ comment only\nACGT\n+\nIIII\n", "empty FASTQ id", (0, 0, 0)),
        ("@r1\nACGT\n+\nIII\n", "quality length 3 != sequence length 4", (11, 0, 3)),
        ("@r1\nACGT\n+", "truncated FASTQ record", (0, 0, 3)),
        ("@r\n\n+\n", "truncated FASTQ record", (0, 0, 3)),
        ("@r1\nACGT\n+\nIIII\n\n", "truncated FASTQ record", (16, 1, 1)),
        ("@r1\nACGT\n+\nIIII\n@r2\nTGCA\n-\nJJJJ\n", "plus line must start with `+`", (25, 1, 2)),
        ("r1\nACGT\n+\nIIII\n", "header must start with `@`", (0, 0, 0)),
        ("\ufeff@r1\nACGT\n+\nIIII\n", "header must start with `@`", (0, 0, 0)),
    ],
)
def test_fastq_errors(spark, put, data, message, place):
    with failing() as e:
        fastq.read_fastq(spark, put(data), range_bytes=5).count()
    assert (e.value.detail, (e.value.byte_offset, e.value.record_index, e.value.line_index)) == (message, place)
    assert str(e.value) == f"parse error at byte {place[0]}, record {place[1]}, line {place[2]}: {message}"
    assert fastq.read_fastq(spark, put(data), mode="DROPMALFORMED").count() == place[1]


def test_empty_and_lenient(spark, put):
    assert fastq.read_fastq(spark, put("")).count() == 0
    assert fastq.read_fastq(spark, put("r\nA\n-\nII\n"), validate=False).count() == 1
    with failing("exceeds slab size"):
        fastq.read_fastq(spark, put(FASTQ), max_record_bytes=15).count()


def test_ids(spark):
    names = [b"@INST:1:FC 1:N:0", b">frag/1", b"@frag/2", b"@frag/3", b"@1", b"@a\x0bb c", b"@a/1\n"]
    rows = spark.createDataFrame([(n,) for n in names], "name binary").select(records.id_token("name").alias("i"), records.pair_id("name").alias("p")).collect()
    assert [tuple(r) for r in rows] == [("INST:1:FC",) * 2, ("frag/1", "frag"), ("frag/2", "frag"), ("frag/3", "frag/3"), ("1", "1"), ("a\x0bb",) * 2, ("a/1", "a")]


def pairs(spark, put, one, two, validation="full"):
    make = lambda ids: "".join(f"@{i}\nACGT\n+\nIIII\n" for i in ids)
    return fastq.read_paired_fastq(spark, put(make(one), "r1"), put(make(two), "r2"), validation)


@pytest.mark.parametrize(
    ("first", "second", "mode", "match"),
    [
        ("frag1/1", "frag1/2", "full", True), ("frag1/1", "other/2", "full", False), ("frag1/1", "other/2", "none", True), ("frag1/1", "frag1/1", "fast_slash", False),
        ("frag1", "other", "fast_slash", False), ("a/1", "a/1", "full", True), ("a/2", "a/1", "full", True), ("a/2", "a/1", "fast_slash", True), ("a/1 x", "a/2 y", "fast_slash", True),
    ],
)
def test_pairing(spark, put, first, second, mode, match):
    if match:
        assert pairs(spark, put, [first], [second], mode).count() == 1
    else:
        with failing(fastq.MISMATCH) as e:
            pairs(spark, put, [first], [second], mode).count()
        assert (e.value.byte_offset, e.value.record_index, e.value.line_index) == (0, 0, 0)


def test_pair_counts(spark, put):
    with failing("different record counts") as e:
        pairs(spark, put, ["frag1/1", "frag2/1"], ["frag1/2"]).count()
    assert (e.value.byte_offset, e.value.record_index) == (21, 1)
    single = fastq.read_fastq(spark, put("@frag1/1\nA\n+\nI\n"))
    with failing("unpaired record"):
        fastq.pair_interleaved(single).count()


def packed(spark, seq, qual=b"I"):
    df = spark.createDataFrame([(seq, qual)], "seq binary, qual binary")
    return fastq.pack(df).first()


@pytest.mark.parametrize(
    ("seq", "bases", "mask", "n"),
    [(b"ACGTacgt", "e4e4", "00", 0), (b"ANGTXry", "e000", "72", 4), (b"ACGTNN", "e400", "30", 2), (b"ACGTN", "e400", "10", 1), (b"", "", "", 0)],
)
def test_packing(spark, seq, bases, mask, n):
    p = packed(spark, seq).packed
    assert (bytes(p.bases).hex(), bytes(p.n_mask).hex(), p.n, p.len) == (bases, mask, n, len(seq))


def test_qualities(spark):
    q = packed(spark, b"", b"!5?I").quality
    assert (q.len, q.min_phred, q.max_phred, q.sum_phred, q.q20_bases, q.q30_bases) == (4, 0, 40, 90, 3, 2)
    empty = packed(spark, b"", b"").quality
    assert empty.min_phred is None and empty.len == 0
    df = spark.createDataFrame([(b"!+5?I",)], "qual binary")
    assert bytes(df.select(packing.bin_qualities("qual", [10, 20, 30])).first()[0]) == bytes([0, 1, 2, 3, 3])
    with pytest.raises(ValueError, match="index 1 is not sorted"):
        packing.check_thresholds([20, 10])
    with pytest.raises(ValueError, match="too many"):
        packing.check_thresholds([1] * 256)


def test_trusted_pack_checks_qualities(spark, put):
    with failing("invalid Phred.33 quality byte 31 at offset 1") as e:
        fastq.pack_trusted(spark, put(b"@r0\nACG\n+\nI\x1fI\n")).count()
    assert (e.value.byte_offset, e.value.line_index) == (10, 3)
    assert fastq.pack_trusted(spark, put("@\nACGTN\n+\nIIIII\n")).first().packed.n == 1


FASTA = ">chr1 description\nACGT\nAC\n>chr2\r\nTTTT\r\n"


@pytest.mark.parametrize("transport", ["raw", "gzip", "bgzf"])
@pytest.mark.parametrize("cut", [1, 4, 1 << 20])
def test_fasta_by_any_cut(spark, put, transport, cut):
    data = "\n\n>s1 d\nACG\n\nTN\n>s2\r\nG\r\rG\r\n>s3\n>s4\nT"
    cut = max(cut, 9) if transport != "raw" else cut
    got = fasta.read_fasta(spark, put(data, transport=transport), range_bytes=cut).sort("record_index").collect()
    assert [(r.record_index, bytes(r.name), bytes(r.seq)) for r in got] == [(0, b">s1 d", b"ACGTN"), (1, b">s2", b"G\r\rG"), (2, b">s3", b""), (3, b">s4", b"T")]


@pytest.mark.parametrize(("data", "message", "record"), [("ACGT\n", "FASTA record header must start with `>`", 0), (">\nACGT\n", "empty FASTA id", 0), (">s\nAC\n>t\nGT\n> x\nTT\n", "empty FASTA id", 2)])
def test_fasta_errors(spark, put, data, message, record):
    with failing() as e:
        fasta.read_fasta(spark, put(data), range_bytes=3).count()
    assert (e.value.detail, e.value.record_index) == (message, record)


@pytest.mark.parametrize("cut", [2, 1 << 20])
def test_index(spark, put, cut):
    lines = lambda data: [r.value for r in fasta.fai_lines(fasta.build_fai(spark, put(data), cut)).sort("ref_index").collect()]
    assert lines(">chr1 description\nACGT\nAC\n>chr2\nTTTT\n") == ["chr1\t6\t18\t4\t5", "chr2\t4\t32\t4\t5"]
    assert lines(">chr1 desc\nACGT\nTGCA\nAA\n>chr2\nGG\n") == ["chr1\t10\t11\t4\t5", "chr2\t2\t30\t2\t3"]
    assert lines(">a\r\nACGT\r\nAC\r\n") == ["a\t6\t4\t4\t6"]


@pytest.mark.parametrize(
    ("data", "message"),
    [
        (">chr1\nAC\nACGT\nA\n", "inconsistent wrapping"), (">chr1\nACGT\nAC\nA\n", "inconsistent wrapping"), (">chr1\nAC\nACGT\n", "longer than the first"),
        (">chr1\nAC\n>chr1 desc\nGT\n", "duplicate FASTA index"), (">a\nAC\n\n>b\nGT\n", "blank sequence lines"),
    ],
)
def test_index_errors(spark, put, data, message):
    with failing(message):
        fasta.build_fai(spark, put(data)).count()


def test_fetch_chunks_partitions(spark, put):
    path = put(">chr1 desc\nACGT\nTGCA\nAA\n>chr2\nGG\n")
    fai = fasta.build_fai(spark, path)
    ask = lambda *r: spark.createDataFrame(list(r), "name string, start bigint, end bigint")
    got = {(r.start, r.end): bytes(r.seq) for r in fasta.fetch(spark, path, ask(("chr1", 2, 8), ("chr1", 10, 10), ("chr1", 0, 10)), fai).collect()}
    assert got == {(2, 8): b"GTTGCA", (10, 10): b"", (0, 10): b"ACGTTGCAAA"}
    chunks = fasta.reference_chunks(spark, path, ask(("chr1", 2, 10)), fai, 3).sort("global_offset").collect()
    assert [(r.global_offset, bytes(r.seq)) for r in chunks] == [(2, b"GTT"), (5, b"GCA"), (8, b"AA")]
    for bad, message in ((("chrX", 0, 1), "not found in index: chrX"), (("chr1", 3, 2), "start must be <= end"), (("chr1", 0, 11), "end exceeds reference length")):
        with failing(message):
            fasta.fetch(spark, path, ask(bad), fai).count()
    plan = spark.createDataFrame([(0, "chr1", 10), (1, "chr2", 6)], "ref_index bigint, name string, len bigint")
    got = [tuple(r)[2:6] for r in fasta.plan_partitions(plan, 3, 2).sort("partition_index").collect()]
    assert got == [(0, 6, 0, 8), (6, 10, 4, 10), (0, 6, 0, 6)]


def test_fai_file_checks(spark, put):
    assert fasta.read_fai(spark, put("chr1\t10\t11\t4\t5\n")).first().len == 10
    for data in ("chr1\t1\t2\t3\n", "chr1\t1\t2\t0\t1\n", "chr1\t1\t2\t3\t4\nchr1\t1\t2\t3\t4\n", "chr1\tx\t2\t3\t4\n", "\t1\t2\t3\t4\n", "c\t1\t2\t4\t3\n"):
        with failing("invalid .fai line"):
            fasta.read_fai(spark, put(data)).count()


def test_bgzf_index_and_fetch(spark, put):
    seq = "".join("ACGT"[(i * i // 7) % 4] for i in range(70_010))
    data = ">c\n" + "\n".join(seq[i : i + 80] for i in range(0, len(seq), 80)) + "\n"
    path = put(data, transport="bgzf")
    fai = fasta.build_fai(spark, path)
    got = fasta.reference_chunks(spark, path, spark.createDataFrame([("c", 69_998, 70_006)], "name string, start bigint, end bigint"), fai, 5).sort("global_offset").collect()
    assert [(r.global_offset, r.seq.decode()) for r in got] == [(69_998, seq[69_998:70_003]), (70_003, seq[70_003:70_006])]
    blocks = bgzf_blocks(spark, put(bytes(2 * 61_440 + 17), "b", "bgzf")).sort("block_index").collect()
    assert [(r.uncompressed_offset, r.uncompressed_size) for r in blocks] == [(0, 61_440), (61_440, 61_440), (122_880, 17)]
    assert fasta.virtual_offset(123, 45) == 123 << 16 | 45
    with pytest.raises(ValueError, match="out of range"):
        fasta.virtual_offset(1 << 48, 0)


def test_decoded_blocks_stay_in_their_tasks(spark, put):
    text = b"".join(b"%d," % (i * i) for i in range(60_000))
    data = b"".join(bgzf.deflate(text[i : i + 4000]) for i in range(0, len(text), 4000)) + bgzf.EOF_BLOCK
    path = put(data + bgzf.deflate(b"behind the end"))
    for step in (3000, 20_000, 1 << 20):
        rows = bgzf_blocks(spark, path, decode=True, range_bytes=step)
        assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()  # a join could broadcast the blocks
        got = rows.sort("block_index").collect()
        assert b"".join(bytes(r.data) for r in got) == text and [r.block_index for r in got] == list(range(-(-len(text) // 4000)))
        assert [r.uncompressed_offset for r in got] == list(range(0, len(text), 4000))
        assert [tuple(r) for r in bgzf_blocks(spark, path, range_bytes=step).sort("block_index").collect()] == [tuple(r)[:6] for r in got]


def test_gzip_is_decoded_in_parts():
    text = b"@r\nACGT\n+\nIIII\n" * 400_000
    packed = gzip.compress(text)  # 6.4 MB from some KB
    parts = list(gunzip(io.BytesIO(packed)))
    assert b"".join(parts) == text and max(map(len, parts)) <= CHUNK
    assert b"".join(gunzip(io.BytesIO(packed * 2 + b"more"))) == text * 2
    whole = gzip.compress(bytes(2 * CHUNK), 0)
    assert b"".join(gunzip(io.BytesIO(whole))) == bytes(2 * CHUNK)
    for cut in (len(packed) - 9, len(packed) // 2, len(packed) // 3):
        made = []
        with pytest.raises(OSError, match="unexpected end"):
            for part in gunzip(io.BytesIO(packed[:cut])):
                made.append(part)
        assert b"".join(made) == zlib.decompressobj(31).decompress(packed[:cut])


def test_bgzf_strictness(spark, put):
    whole = bgzf.compress(b"@r\nA\n+\nI\n")
    assert check_bgzf(spark, put(whole)).count() == 1
    with pytest.raises(BgzfError, match="missing BGZF EOF marker"):
        check_bgzf(spark, put(whole[: -len(bgzf.EOF_BLOCK)]))
    assert fastq.read_fastq(spark, put(whole + whole)).count() == 1
    with pytest.raises(BgzfError, match="CRC32 mismatch"):
        bgzf.inflate(whole[: -len(bgzf.EOF_BLOCK)][:-8] + b"\0\0\0\0" + whole[: -len(bgzf.EOF_BLOCK)][-4:])
    with pytest.raises(BgzfError, match="invalid BGZF header"):
        bgzf.block_size(b"x" * 18)


def test_gzip_members(tmp_path):
    import io

    two = gzip.compress(b"a") + gzip.compress(b"b")
    assert b"".join(gunzip(io.BytesIO(two))) == b"ab"
    with pytest.raises(OSError, match="one gzip member"):
        list(gunzip(io.BytesIO(two), single=True))
    with pytest.raises(OSError, match="exceeds"):
        list(gunzip(io.BytesIO(gzip.compress(b"a" * 100)), max_out=10))


def test_a_file_is_read_by_many_tasks(spark, put):
    """The rows of ranges are tiny, yet adaptive execution must leave each to its own task."""
    path = put("@r\nACGT\n+\nIIII\n" * 5000)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    for rows in (fastq.read_fastq(spark, path, range_bytes=1600), fasta.scan_shapes(spark, path, 1600), scan_lines(spark, path, 1600)):
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    path = put("@r\nACGT\n+\nIIII\n" * 3_000_000, "large")
    assert fastq.read_fastq(spark, path, range_bytes=1 << 20).select(F.spark_partition_id().alias("p")).distinct().count() >= 6


def test_files_as_one_stream(spark, tmp_path):
    for name, n, transport in (("a", 3, bytes), ("b", 0, bytes), ("c", 2, gzip.compress), ("d", 4, bgzf.compress)):
        (tmp_path / name).write_bytes(transport(b"@r\nACGT\n+\nIIII\n" * n))
    for cut in (20, 1 << 20):
        got = fastq.read_fastq(spark, str(tmp_path), range_bytes=cut, stream=True).sort("record_index").collect()
        assert [(r.record_index, r.byte_offset) for r in got] == [(i, 15 * i) for i in range(9)]
    assert fastq.read_fastq(spark, str(tmp_path)).where("record_index = 0").count() == 3


def test_a_long_record_takes_time_in_proportion(tmp_path):
    """In one task, without Spark: a record of many buffers isn't looked at anew for each."""
    took = []
    for mb in (16, 64):
        path = tmp_path / f"{mb}.fa"
        path.write_bytes(b">chr\n" + (b"ACGT" * 15 + b"\n") * ((mb << 20) // 61))
        row = {"path": str(path), "size": path.stat().st_size, "start": 0, "end": path.stat().st_size, "bytes": scan.WHOLE, "byte0": 0, "line0": 0, "record0": 0}
        began = time.perf_counter()
        (batch,) = scan._run(scan._fasta, iter([pa.RecordBatch.from_pylist([row])]))
        took.append(time.perf_counter() - began)
        assert len(batch.column("seq")[0].as_py()) == 60 * ((mb << 20) // 61)
    assert took[1] < 10 * took[0] + 1


def test_gzip_options(spark, tmp_path):
    (tmp_path / "two").write_bytes(gzip.compress(FASTQ.encode()) + gzip.compress(b"@r\nA\n+\nI\n"))
    (tmp_path / "one").write_bytes(gzip.compress(FASTQ.encode()))
    assert fastq.read_fastq(spark, str(tmp_path / "one"), transport=scan.Transport(single=True, max_in=1000, max_out=1000)).count() == 4
    for name, kind, message in (("two", {"single": True}, "one gzip member"), ("one", {"max_in": 10}, "exceeds 10 compressed"), ("one", {"max_out": 10}, "output exceeds 10")):
        with pytest.raises(PySparkException, match=message):
            fastq.read_fastq(spark, str(tmp_path / name), transport=scan.Transport(**kind)).count()
    with failing():
        fastq.read_fastq(spark, str(tmp_path / "one"), transport=scan.Transport(decode=False)).count()


def test_auto_fasta(spark, tmp_path):
    for name, data in (("a", ">s\nAC\n>t\nTT\n"), ("b", ">s\nAC\nGT\n"), ("c", "\n>s\nAC\n")):
        (tmp_path / name).write_text(data)
    got = fasta.read_fasta_auto(spark, str(tmp_path)).collect()
    assert sorted((r.path[-1], bytes(r.seq)) for r in got) == [("a", b"AC"), ("a", b"TT"), ("b", b"ACGT"), ("c", b"AC")]


@pytest.mark.parametrize("cut", [1, 2, 5, 1 << 20])
def test_lines(spark, put, cut):
    got = scan_lines(spark, put("a\n\nbb\r\nc\rd\n\ne"), cut).sort("line_no").collect()
    assert [(r.line_no, r.byte_offset, r.width, bytes(r.line)) for r in got] == [(0, 0, 2, b"a"), (1, 2, 1, b""), (2, 3, 4, b"bb"), (3, 7, 4, b"c\rd"), (4, 11, 1, b""), (5, 12, 1, b"e")]


def encoded(df):
    return df.select("record_index", *[records.raw(c).alias(c) for c in df.columns if c != "record_index"])


def test_golden_checksums(spark):
    n, length = 100_000, 150
    one = encoded(synthetic.synthetic_fastq(spark, n, length))
    assert stats.stream_stats(one).first().checksum == "12945858864820177352"
    two = encoded(synthetic.synthetic_fastq(spark, n, length, mate=2))
    assert stats.stream_stats(two).first().checksum == "12725525685719183448"
    assert stats.stream_stats(encoded(synthetic.synthetic_interleaved(spark, n, length))).first().checksum == "2108355523955936992"
    assert stats.stream_stats(fastq.pack(one), packed=True).first().checksum == "17356533327231788360"
    entropy = encoded(synthetic.synthetic_fasta(spark, n, length, "entropy"))
    assert stats.stream_stats(entropy).first().checksum == "1376792450279976737"
    protein = encoded(synthetic.synthetic_fasta(spark, 50_000, 300, "entropy", synthetic.PROTEIN))
    assert stats.stream_stats(protein).first().checksum == "14627641143505395720"


def test_fasta_checksums(spark):
    df = lambda *seqs: spark.createDataFrame([(i, s.encode()) for i, s in enumerate(seqs)], "record_index bigint, seq binary")
    for seqs, want in (((), "14695981039346656037"), (("ACGT", "TTAA"), "10941314783621317075"), (("ACGT", "TT"), "10941103677388697107"), (("",), "17039301642135479899")):
        assert stats.fasta_stats(df(*seqs)).first().checksum == want


def damaged(data, places):
    out = bytearray(data)
    for at in places:
        out[at] ^= 0xFF
    return bytes(out)


@pytest.mark.parametrize("cut", [400, 5000, 1 << 26])
def test_damage_of_block_gzip(spark, put, cut):
    blocks = [bgzf.deflate(bytes([65 + i % 50]) * 900 + repr(i * 7919).encode() * 40) for i in range(40)]
    whole = b"".join(blocks) + bgzf.EOF_BLOCK
    starts = [sum(map(len, blocks[:i])) for i in range(41)]
    report = lambda data: sorted((r.compressed_offset, r.message) for r in scan.bgzf_errors(spark, put(data), cut).collect())
    assert report(whole) == []
    assert report(whole[: starts[40]]) == [(starts[40], "missing BGZF EOF marker")]
    assert report(whole + b"junk") == [(len(whole), "trailing bytes after BGZF EOF marker")]
    assert report(b"") == [(0, "missing BGZF EOF marker")]
    crc = [starts[i + 1] - 8 for i in (0, 7, 8, 39)]
    assert report(damaged(whole, crc)) == [(starts[i], "CRC32 mismatch") for i in (0, 7, 8, 39)]
    heads = [starts[i] for i in (5, 20, 33)]
    assert report(damaged(whole, heads)) == [(at, "invalid BGZF header") for at in heads]
    size = [starts[13] - 4]
    assert report(damaged(whole, size))[0][0] == starts[12]
    short = whole[: starts[30] + 25]
    assert report(short)[-1] == (len(short), "missing BGZF EOF marker")
    with pytest.raises(BgzfError, match="CRC32 mismatch"):
        check_bgzf(spark, put(damaged(whole, crc)))


def test_index_goes_on_after_errors(spark, put):
    data = "stray\n>a\nACGT\nAC\n>b\nAC\n\nAC\n>c\nACG\nA\nACG\n>a again\nACGT\n>\nAC\n>d\nAC\nACGT\n>e\nA\n"
    for cut in (6, 1 << 20):
        rows = fasta.build_fai(spark, put(data), cut, "PERMISSIVE").sort("ref_index").collect()
        assert [(r.ref_index, r.name, r._error.message if r._error else None) for r in rows] == [
            (-1, None, "FASTA record header must start with `>`"), (0, "a", None), (1, "b", "FASTA index does not support blank sequence lines"), (2, "c", "non-final FASTA sequence line has inconsistent wrapping"),
            (3, "a", "duplicate FASTA index reference name"), (4, "", "empty FASTA id"), (5, "d", "FASTA final sequence line is longer than the first sequence line"), (6, "e", None),
        ]
        assert [r.name for r in fasta.build_fai(spark, put(data), cut, "DROPMALFORMED").sort("ref_index").collect()] == ["a", "e"]


def test_fai_lines_with_errors_are_kept(spark, put):
    data = "a\t1\t2\t3\t4\n\nb\t1\t2\n\na\t5\t6\t7\t8\nc\t0\t2\t0\t1\n"
    rows = fasta.read_fai(spark, put(data), "PERMISSIVE").sort("line_no").collect()
    assert [(r.ref_index, r.line_no, r.name, r.message) for r in rows] == [(0, 0, "a", None), (1, 2, "b", "invalid .fai line 3: expected 5 tab-separated fields"), (2, 4, "a", "invalid .fai line 5: duplicate reference name"), (3, 5, "c", None)]
    assert [r.name for r in fasta.read_fai(spark, put(data), "DROPMALFORMED").sort("ref_index").collect()] == ["a", "c"]


def test_files_that_cannot_be_decoded(spark, put, tmp_path):
    data = FASTQ.encode()
    zipped = gzip.compress(data)
    files = {"raw": data, "whole": zipped, "cut": zipped[:-12], "second": zipped + zipped[:-3], "padded": zipped + b"\0" * 9, "blocks": bgzf.compress(data), "worn": damaged(bgzf.compress(data), [len(bgzf.compress(data)) - 36])}
    folder = tmp_path / "all"
    folder.mkdir()
    for name, content in files.items():
        (folder / name).write_bytes(content)
    said = lambda t=scan.PLAIN: {r.path.rpartition("/")[2]: r.message for r in scan.transport_errors(spark, str(folder), t).collect()}
    assert said() == {"cut": "unexpected end of gzip data", "second": "unexpected end of gzip data", "worn": "CRC32 mismatch"}
    assert said(scan.Transport(max_out=10))["whole"] == "gzip output exceeds 10 bytes"
    assert set(said(scan.Transport(single=True))) == {"cut", "second", "padded", "worn"}
    (folder / "worn").unlink()
    rows = fastq.read_fastq(spark, str(folder), mode="PERMISSIVE", transport=scan.Transport(lenient=True))
    good = {r.path.rpartition("/")[2]: r["count"] for r in rows.where("_error is null").groupBy("path").count().collect()}
    assert good["whole"] == good["raw"] == good["blocks"] == good["padded"] == 4 and good["second"] >= 3
    with pytest.raises(PySparkException, match="unexpected end of gzip data"):
        fastq.read_fastq(spark, str(folder)).count()


SAM = b"""@HD\tVN:1.6\n@SQ\tSN:c\tLN:9\n
a\t0\tc\t1\t9\t3M\t*\t0\t0\tACG\t!!!\tNM:i:0\r
b\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*
c\t4\t*\t0\t0\t*\t*\t0\t0\t\t*
cut\t4\t*\t0
\t4\t*\t0\t0\t*\t*\t0\t0\tTT
@CO\ta\tb\tc\td\te\tf\tg\th\ti\tj
d\t4\t*\t0\t0\t*\t*\t0\t0\t*A\t*"""


@pytest.mark.parametrize("transport", ["raw", "gzip", "bgzf"])
@pytest.mark.parametrize("end", [b"", b"\n"])
def test_sam_numbers_wherever_ranges_are_cut(spark, put, transport, end):
    want = [(b"a", b"ACG"), (b"c", b""), (b"", b"TT"), (b"d", b"*A")]
    paths = [put(SAM + end, "1.sam", transport), put("@HD\tVN:1.6\n", "2.sam", transport), put(SAM + end, "3.sam", transport)]
    for range_bytes in (7, 64, 1 << 20):
        got = sorted((r.record_index, bytes(r.name), bytes(r.seq)) for r in sam.read_sam(spark, paths, range_bytes=range_bytes).collect())
        assert got == [(k, *x) for k, x in enumerate(want + want)], range_bytes


def test_sam_sequences_are_not_shuffled(spark, put):
    plan = sam.read_sam(spark, put(SAM, "1.sam"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith("MapInArrow")


def test_sam_without_rows(spark, put):
    assert sam.read_sam(spark, [put("", "1.sam"), put("@CO\tx", "2.sam")]).count() == 0
