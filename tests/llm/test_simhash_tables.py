"""The tables of the near-duplicate stage take their candidates from SimHash bits."""

import numpy as np
import pyarrow as pa
import pytest

from strandframe.llm import simhash


@pytest.mark.parametrize("n", [1, 400, 250_000, 15_000_000])
def test_fingerprints_at_a_jaccard_of_0_8_share_tables(n):
    """15.2 % of the bits differ; whatever the number of texts, some table's key is shared and its check is near."""
    rng = np.random.default_rng(5)
    bits, n_tables = simhash.tables(n)
    assert n_tables <= simhash.BANDS and (n <= 400 or 2 ** (bits + 2) > n)
    one = rng.integers(0, 2, (1500, 512), dtype=np.uint8)
    two = one ^ (rng.random(one.shape) < 1 - simhash.AGREE)
    keys = [simhash.table_keys(np.packbits(x, axis=1, bitorder="little").view("<u4"), bits, n_tables) for x in (one, two, rng.integers(0, 2, one.shape, dtype=np.uint8))]
    met = lambda a, b: ((a >> simhash.CHECK == b >> simhash.CHECK) & (np.bitwise_count((a ^ b) & ((1 << simhash.CHECK) - 1)) <= simhash.CHECK_APART)).any(axis=1).mean()
    print(f"{n} texts: {bits} bits, {n_tables} tables, {met(*keys[:2]):.4f} of pairs meet")
    assert met(*keys[:2]) > 0.97
    assert met(keys[0], keys[2]) < 0.01


@pytest.mark.parametrize("size", [1, 2, 3, 7, 10_000])
def test_buckets_meet_across_batches(size):
    """Each entry meets the first of its bucket and the one before; large buckets are told whole, each entry once."""
    rng = np.random.default_rng(6)
    v = np.sort(rng.integers(0, 60, 300))
    v[100:180] = v[100]
    v.sort()
    w, ids = v << simhash.CHECK, rng.permutation(300)
    batches = [pa.RecordBatch.from_arrays([pa.array(w[k : k + size]), pa.array(ids[k : k + size])], ["w", "id"]) for k in range(0, 300, size)]
    rows = [r for b in simhash._meet(iter(batches)) for r in b.to_pylist()]
    pairs, told = [], []
    for bucket in np.unique(v):
        of = ids[v == bucket].tolist()
        pairs += [(int(bucket), x, of[0]) for x in of[1:]] + [(int(bucket), of[k], of[k - 1]) for k in range(2, len(of))]
        told += [(int(bucket), x) for x in of if len(of) > 3]
    assert sorted((r["v"], r["id"], r["other"]) for r in rows if r["other"] is not None) == sorted(pairs)
    assert sorted((r["v"], r["id"]) for r in rows if r["other"] is None) == sorted(told)
