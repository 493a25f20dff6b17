"""Periodic runs held against the definition, word by word."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm import runs

SF = "/root/testdata/sf0.001"


def by_definition(w):
    """(start, length, period) of all runs: each period tried at each place."""
    n, out = len(w), []
    for p in range(1, n // runs.LEAST_PERIODS + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            size = j + p - i
            if j > i and size >= max(runs.LEAST_WORDS, runs.LEAST_PERIODS * p):
                part = w[i : j + p]
                if all(any(part[t] != part[t + q] for t in range(size - q)) for q in range(1, p)):
                    out.append((i, size, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(key, text):
    words = [w for w in (text or "").encode().split()]
    h = zlib.crc32(str(key).encode() if key is not None else b"")
    if h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    found = by_definition(words)
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (len(found), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else [None] * 4), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        letters = rng.choice([1, 2, 3, 9])
        w = [rng.randrange(letters) for _ in range(rng.randrange(70))]
        for _ in range(rng.randrange(3)):
            block = [rng.randrange(letters + 2) for _ in range(rng.randrange(1, 6))]
            at = rng.randrange(len(w) + 1)
            w[at:at] = block * rng.randrange(1, 9) + block[: rng.randrange(len(block))]
        yield w


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_those_of_the_definition(seed):
    given = list(texts(seed, 300))
    which, start, length, period = runs.find_runs([np.array(w, dtype=np.int64) for w in given])
    for k, w in enumerate(given):
        assert [(int(s), int(n), int(p)) for d, s, n, p in zip(which, start, length, period, strict=True) if d == k] == by_definition(w), w


def test_no_texts_and_a_long_one():
    assert [len(x) for x in runs.find_runs([])] == [0] * 4
    assert [len(x) for x in runs.find_runs([np.zeros(0, np.int64)] * 3)] == [0] * 4
    long = np.tile(np.arange(1000), 101)
    assert [x.tolist() for x in runs.find_runs([long])] == [[0], [0], [101_000], [1000]]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 500])
def test_suffix_ranks_next_smaller_and_common_prefixes(n):
    rng = np.random.default_rng(n)
    letters = np.append(rng.integers(1, 3, max(n - 1, 0)), [0][: min(n, 1)])
    rank = runs.suffix_ranks(letters)
    want = sorted(range(n), key=lambda i: letters[i:].tolist())
    assert rank.tolist() == np.argsort(want).tolist()
    values = rng.permutation(n)
    assert runs.next_smaller(values).tolist() == [next((j for j in range(i + 1, n) if values[j] < values[i]), n) for i in range(n)]
    if n > 2:
        both = runs.Extension(letters)
        a, b = rng.integers(0, n, 200), rng.integers(0, n, 200)
        a, b = a[a != b], b[a != b]
        for x, y, h in zip(a, b, both(a, b), strict=True):
            k = 0
            while max(x, y) + k < n and letters[x + k] == letters[y + k]:
                k += 1
            assert h == k


def test_query_agrees_with_the_definition(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = runs.op12_runs(spark, SF).collect()
    assert len(got) == len(docs)
    some = sorted(docs, key=lambda k: (zlib.crc32(str(k).encode()) % 10 != 0, len(docs[k])))[:120]
    rows = {r.doc_id: tuple(r)[1:] for r in got}
    assert any(rows[k][0] for k in some)
    for k in some:
        assert rows[k] == expected(k, docs[k])


def test_edges(spark):
    rows = [(None, "a a a a a a"), (1, None), (2, ""), (3, " \n\t "), (4, "x " * 50_000), (5, "a b c a b c a b c a b c"), (5, "q q q q q q r r r r r r"), (5, "q q q q q q r r r r r r"), (6, "A a A a A a A a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("start", F.lit("x"))
    got = runs.collapse_runs(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(([tuple(x) for x in r.runs], r.collapsed))
    assert by[None] == [([(0, 6, 1)], "a")]
    assert by[1] == by[2] == by[3] == [([], "")]
    assert by[4] == [([(0, 50_000, 1)], "x")]
    assert by[5].count(([(0, 6, 1), (6, 6, 1)], "q r")) == 2
    assert by[6] == [([(0, 8, 2)], "A a")]
    assert runs.collapse_runs(df.where("false")).count() == 0
    named = runs.collapse_runs(df.select(F.col("doc_id").cast("string").alias("a b"), "text"), "a b").collect()
    assert sorted(str(r["a b"]) for r in named) == sorted(str(k) for k, _ in rows)


def test_no_shuffle(spark):
    plan = runs.op12_runs(spark, SF)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
