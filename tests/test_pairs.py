"""Pairs made by the readers: any cut, any transport, several files, uneven sides, errors of mates."""

import gzip
import random

import pytest

from strandframe.errors import from_spark
from strandframe.operators import fastq
from strandframe.sources import bgzf, pairs


def reads(n, mate, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.randrange(0, 40)
        out.append((f"@f{i}/{mate}", "".join(rng.choices("ACGTN", k=size)), "".join(rng.choices("!5?I", k=size))))
    return out


def text(rows):
    return "".join(f"{n}\n{s}\n+\n{q}\n" for n, s, q in rows).encode()


def put(folder, rows, parts=1, transport="raw", framed=1):
    """The rows in so many files; framed: records that stay together."""
    folder.mkdir()
    size = -(-len(rows) // parts // framed) * framed if rows else 1
    for k in range(parts):
        data = text(rows[k * size : (k + 1) * size])
        data = {"raw": bytes, "gzip": gzip.compress, "bgzf": lambda d: b"".join(bgzf.deflate(d[i : i + 300]) for i in range(0, len(d), 300)) + bgzf.EOF_BLOCK}[transport](data)
        (folder / f"p{k}").write_bytes(data)
    return str(folder)


def seen(df):
    mate = lambda m: m and (m.record_index, m.byte_offset, bytes(m.name).decode(), bytes(m.seq).decode(), bytes(m.qual).decode())
    return [(r.pair_index, mate(r.first), mate(r.second)) for r in df.sort("pair_index").collect()]


def placed(rows):
    at, out = 0, []
    for i, (n, s, q) in enumerate(rows):
        out.append((i, at, n, s, q))
        at += len(n) + len(s) + len(q) + 5
    return out


@pytest.mark.parametrize(("cut", "parts", "transport"), [(50, (1, 1), "raw"), (333, (3, 2), "raw"), (200, (2, 5), "bgzf"), (200, (1, 3), "gzip"), (1 << 26, (1, 1), "raw"), (1 << 26, (4, 1), "raw")])
def test_pairs_by_any_cut(spark, tmp_path, monkeypatch, cut, parts, transport):
    monkeypatch.setattr(pairs, "_STRETCH", 7)
    one, two = reads(60, 1, 1), reads(60, 2, 2)
    paths = [put(tmp_path / str(k), rows, n, transport) for k, (rows, n) in enumerate(zip((one, two), parts, strict=True))]
    got = seen(fastq.read_paired_fastq(spark, *paths, range_bytes=cut))
    assert got == list(zip(range(60), placed(one), placed(two), strict=True))


@pytest.mark.parametrize(("n", "m"), [(40, 9), (9, 40), (0, 12), (12, 0), (0, 0), (1, 30)])
@pytest.mark.parametrize("cut", [64, 1 << 26])
def test_sides_of_other_lengths(spark, tmp_path, n, m, cut):
    one, two = reads(n, 1), reads(m, 2)
    paths = [put(tmp_path / str(k), rows) for k, rows in enumerate((one, two))]
    rows = fastq.read_paired_fastq(spark, *paths, mode="PERMISSIVE", range_bytes=cut)
    a, b = placed(one), placed(two)
    pad = lambda x: x + [None] * (max(n, m) - len(x))
    assert seen(rows) == list(zip(range(max(n, m)), pad(a), pad(b), strict=True))
    bad = {r.pair_index: (r._error.message, r._error.byte_offset, r._error.record_index) for r in rows.where("_error is not null").collect()}
    longer = a if n > m else b
    assert bad == {i: (fastq.COUNTS, longer[i][1], i) for i in range(min(n, m), max(n, m))}


@pytest.mark.parametrize(("cut", "parts", "transport"), [(50, 1, "raw"), (120, 3, "raw"), (200, 2, "bgzf"), (1 << 26, 1, "gzip"), (100, 2, "gzip")])
@pytest.mark.parametrize("n", [40, 41, 1])
def test_interleaved_by_any_cut(spark, tmp_path, cut, parts, transport, n):
    rows = [r for p in zip(reads(21, 1, 1), reads(21, 2, 2), strict=True) for r in p][:n]
    got = fastq.read_interleaved_fastq(spark, put(tmp_path / "x", rows, parts, transport), mode="PERMISSIVE", range_bytes=cut)
    all_rows = placed(rows) + [None]
    assert seen(got) == [(i, all_rows[2 * i], all_rows[2 * i + 1]) for i in range(-(-n // 2))]
    errors = got.where("_error is not null").select("_error.message", "_error.byte_offset", "_error.record_index").collect()
    assert [tuple(e) for e in errors] == ([(fastq.UNPAIRED, placed(rows)[-1][1], n - 1)] if n % 2 else [])


def test_errors_of_mates_and_modes(spark, tmp_path):
    one, two = reads(12, 1, 1), reads(12, 2, 2)
    two[3] = ("@f3/2", "ACG", "II")
    one[5] = ("@other/1", "A", "I")
    one[7] = ("f7", "A", "I")
    paths = [put(tmp_path / str(k), rows) for k, rows in enumerate((one, two))]
    rows = fastq.read_paired_fastq(spark, *paths, mode="PERMISSIVE", range_bytes=100)
    assert {r.pair_index: r._error.message for r in rows.where("_error is not null").collect()} == {3: "quality length 2 != sequence length 3", 5: fastq.MISMATCH, 7: "header must start with `@`"}
    assert fastq.read_paired_fastq(spark, *paths, mode="DROPMALFORMED", range_bytes=100).count() == 9
    assert fastq.read_paired_fastq(spark, *paths, mode="PERMISSIVE", validate=False, validation="none").where("_error is not null").count() == 0
    with pytest.raises(Exception) as e:  # noqa: PT011
        fastq.read_paired_fastq(spark, *paths, range_bytes=100).collect()
    assert from_spark(e.value).detail in {"quality length 2 != sequence length 3", fastq.MISMATCH, "header must start with `@`"}


@pytest.mark.parametrize("cut", [80, 1 << 26])
def test_packed_pairs_are_those_of_packing_pairs(spark, tmp_path, cut):
    one, two = reads(30, 1, 1), reads(30, 2, 2)
    paths = [put(tmp_path / str(k), rows) for k, rows in enumerate((one, two))]
    want = fastq.pack_pairs(fastq.read_paired_fastq(spark, *paths)).sort("pair_index").collect()
    got = fastq.pack_paired_fastq(spark, *paths, range_bytes=cut).select(want[0].__fields__).sort("pair_index").collect()
    assert got == want
    both = put(tmp_path / "i", [r for p in zip(one, two, strict=True) for r in p])
    assert fastq.pack_interleaved_fastq(spark, both, range_bytes=cut).select(want[0].__fields__).sort("pair_index").collect() == want
    odd = fastq.pack_interleaved_fastq(spark, put(tmp_path / "o", one[:3]), "none", "PERMISSIVE").where("second is null").first()
    assert odd.packed_2 is None and odd._error.message == fastq.UNPAIRED
    bad = put(tmp_path / "b", [("@f0/2", "A", "\x7f")])
    row = fastq.pack_paired_fastq(spark, put(tmp_path / "c", one[:1]), bad, mode="PERMISSIVE").first()
    assert row._error.message == "invalid Phred+33 quality byte 127 at offset 0"


def test_records_are_not_shuffled(spark, tmp_path):
    paths = [put(tmp_path / str(k), reads(30, k + 1)) for k in range(2)]
    plan = fastq.read_paired_fastq(spark, *paths, range_bytes=100)._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("MapInArrow")]
    assert "Exchange" not in top and "Join" not in top
