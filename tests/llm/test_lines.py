"""Line dedup: what its vectorised steps give, held against plain ones."""

import random
import time
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from strandframe.llm import components, lines

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def templated(n, seed):
    """Pairs of lines at 0.8 or more that share a template with all others, at some 0.7."""
    rng = random.Random(seed)
    letters = lambda k: "".join(rng.choice(LETTERS) for _ in range(k))
    template = letters(100)
    owns = [letters(20) for _ in range(n)]
    return [(template + own, template + own[:11] + letters(9)) for own in owns]


def test_lines_are_fetched_once(spark, monkeypatch):
    """The texts are read once for the lines that meet, also where buckets are compared in full: twice before."""
    calls, held = [], lines._held
    monkeypatch.setattr(lines, "_held", lambda *a: calls.append(a) or held(*a))
    pairs = templated(200, 10)
    links = lines.line_links(spark.createDataFrame([(x,) for p in pairs for x in p], "text string").repartition(4))
    of = {r.node: r.component for r in components.connected_components(links).collect()}
    ids = [[lines.line_id(x.encode()) for x in p] for p in pairs]
    assert sum(a in of and of[a] == of.get(b) for a, b in ids) / len(ids) > 0.97
    assert len(calls) == 1


def met(v, ids, sketch, step):
    t = pa.table({"v": v, "id": ids, "sketch": sketch})
    return [r for b in lines._meet(iter(t.to_batches(step))) for r in b.to_pylist()]


def test_buckets_are_whole_wherever_batches_end():
    """Few near pairs of a bucket are all given; of many, each entry once with a near one before it; copies of an entry and single ones aren't."""
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, 3)
    rows = []
    for v, n in enumerate([1, 2, 3, 4, 9, 40, 1, 1, lines.BLOCK + 90, 2, 1, 5]):
        rows += [(v, 100 * v + k, int(base[k % 3] ^ (1 << int(rng.integers(62))))) for k in range(n)]
    rows += [(4, 400, rows[10][2]), (4, 400, rows[10][2])]
    rows.sort(key=lambda r: r[0])
    v, ids, sketch = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
    of = {(a, b): c for a, b, c in rows}
    for step in (1, 7, 50, 300, 1000):
        got = met(v, ids, sketch, step)
        for bucket in range(12):
            own = {b for a, b in of if a == bucket}
            near = [{x, y} for x, y in combinations(sorted(own), 2) if lines._apart(np.uint64(of[bucket, x] % (1 << 64)), np.uint64(of[bucket, y] % (1 << 64))) <= lines.MAY_DIFFER]
            mine = [r for r in got if r["v"] == bucket]
            edges = [{r["id"], r["other"]} for r in mine if r["other"] is not None]
            assert all(e in near for e in edges)
            if len(own) > lines.BLOCK:
                assert {r["id"] for r in mine} == own and all(r["crowded"] and r["large"] for r in mine)
            elif len(near) > max(len(own), 3):
                assert sorted(r["id"] for r in mine) == sorted(set().union(*near)) and all(r["crowded"] and not r["large"] for r in mine)
                assert {max(e) for e in edges} == {max(e) for e in near}
            else:
                assert sorted(map(sorted, edges)) == sorted(map(sorted, near)) and not any(r["crowded"] for r in mine)


def test_shingles_of_many_lines_at_once():
    """Likeness and shared shingles are those of the sets, for short, periodic and odd lines too."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcd é中\U0001f600\0") for _ in range(rng.choice([1, 2, 4, 5, 6, 20, 300]))) for _ in range(150)] + ["ab", "ab\0\0\0", "ab" * 30, "ab" * 90]
    other = [x[: rng.randrange(1, len(x) + 1)] for x in texts]
    assert lines.jaccards(pa.array(texts).slice(1), pa.array(other).slice(1)).tolist() == [lines.line_jaccard(a, b) for a, b in zip(texts[1:], other[1:], strict=True)]
    for some in (texts[:60], texts):  # by packed keys, and by whole hashes
        both, sizes = lines._shared(*lines._shingle_hashes(pa.array(some)))
        sets = [lines.line_shingles(x) for x in some]
        assert sizes.tolist() == [len(x) for x in sets]
        assert all(both[i, j] == len(sets[i] & sets[j]) for i, j in combinations(range(len(some)), 2))


def test_lines_of_a_text_at_once():
    rng = random.Random(4)
    for _ in range(500):
        text = bytes(rng.choice(b"aB \t\r\n\x0b\x0c\x1c\xc3\xa9Z") for _ in range(rng.randrange(60)))
        assert lines._lines(text) == [lines.normalise(x) for x in text.split(b"\n")]


def test_large_families_are_connected(spark):
    """Buckets of over BLOCK lines are dealt to pairs of blocks; what is like in them is connected all the same."""
    pairs = templated(lines.BLOCK, 12)
    links = lines.line_links(spark.createDataFrame([(x,) for p in pairs for x in p], "text string").repartition(4)).cache()
    of = {r.node: r.component for r in components.connected_components(links).collect()}
    ids = [[lines.line_id(x.encode()) for x in p] for p in pairs]
    assert sum(a in of and of[a] == of.get(b) for a, b in ids) / len(ids) > 0.97
    held = {lines.line_id(x.encode()): x for p in pairs for x in p}
    assert all(lines.line_jaccard(held[r.a], held[r.b]) >= 0.8 for r in links.collect())


def test_lines_that_share_a_band_by_chance_are_not_near():
    """Of unlike lines in a bucket hardly any are candidates, one in 40 before; pairs of 0.8 or more are all."""
    rng = random.Random(6)
    syllables = "th er on an re he in ed nd ha ti es or en ou st at sh le ly".split()
    words = ["".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 2, 3, 4]))) for _ in range(3000)]
    some = [" ".join(words[min(int(rng.expovariate(1 / 250)), 2999)] for _ in range(90)).encode() for _ in range(2000)]
    keys, sketch = lines.signatures(some)
    met = {(i, j) for k in keys.T for v in [np.argsort(k, kind="stable")] for s in np.split(v, np.flatnonzero(np.diff(k[v])) + 1) if len(s) > 1 for i, j in combinations(s.tolist(), 2)}
    apart = [(i, j) for i, j in met if lines.line_jaccard(some[i].decode(), some[j].decode()) < 0.3]
    words_of = [x.view(np.uint64) for x in np.atleast_2d(sketch)]
    distance = lambda i, j: int(np.bitwise_count((y := np.bitwise_or.reduce([x[i] ^ x[j] for x in words_of])) & np.uint64(0x5555555555555555) | (y >> np.uint64(1)) & np.uint64(0x5555555555555555)))
    assert len(apart) > 1000
    assert sum(distance(i, j) <= lines.MAY_DIFFER for i, j in apart) < len(apart) / 500
    edited = [x[: int(0.9 * len(x))] + "".join(rng.choice(LETTERS) for _ in range(len(x) - int(0.9 * len(x)))).encode() for x in some]
    keys, sketch = lines.signatures(some + edited)
    words_of = [x.view(np.uint64) for x in np.atleast_2d(sketch)]
    like = [i for i in range(2000) if lines.line_jaccard(some[i].decode(), edited[i].decode()) >= 0.8]
    assert len(like) > 300
    assert all(distance(i, i + 2000) <= lines.MAY_DIFFER for i in like)


def test_unlike_entries_of_large_buckets_need_no_text():
    """An entry of a large bucket is marked where another one of its block is near, wherever that stands; before, the texts of all were fetched."""
    rng = np.random.default_rng(8)
    n = lines.BLOCK + 90
    sketch, more = rng.integers(-(1 << 63), 1 << 63, (2, n))
    for a, b in [(3, 70), (500, 20)]:
        sketch[a], more[a] = sketch[b] ^ 5, more[b]
    t = pa.table({"v": np.zeros(n, dtype=np.int64), "id": np.arange(n), "sketch": sketch, "more": more})
    got = [r for b in lines._meet(iter(t.to_batches(100))) for r in b.to_pylist()]
    assert {r["id"] for r in got} == set(range(n)) and all(r["large"] and r["crowded"] for r in got)
    assert {r["id"] for r in got if r["near"]} == {3, 70, 500, 20}
    assert {(r["id"], r["other"]) for r in got if r["other"] is not None} == {(70, 3), (500, 20)}


@pytest.mark.parametrize("dedup", [lines.dedup_lines, lambda docs: corpus_pipeline.line_dedup(docs.sparkSession, docs, "")], ids=["op8", "pipeline"])
def test_shuffled_bands_are_let_go(spark, dedup):
    """When the rows are ready to be joined, the shuffle of bands lies on disk no more."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    held = lambda: sum(p.stat().st_size for d in env.blockManager().diskBlockManager().localDirs() for p in Path(d.getPath()).rglob("shuffle_*.data"))
    rng = random.Random(9)
    rows = [(i, "\n".join("".join(rng.choice(LETTERS) for _ in range(30)) for _ in range(40))) for i in range(500)]
    before = held()
    got = dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    end = time.time() + 20
    while (left := held() - before) > 20_000 * lines.BANDS and time.time() < end:
        time.sleep(0.2)
    assert left <= 20_000 * lines.BANDS
    assert got.count() == 500
