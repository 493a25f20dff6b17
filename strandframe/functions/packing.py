"""Two-bit packing, Phred summaries and bins: JVM expressions, and one Arrow kernel for the volume path."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .records import text

#: Two-bit codes of the bases, either case; all other bytes are masked.
CODES = {"A": 0, "C": 1, "G": 2, "T": 3}
PACKED_TYPE = T.StructType([T.StructField(n, T.BinaryType()) for n in ("bases", "n_mask")] + [T.StructField(n, T.LongType()) for n in ("len", "a", "c", "g", "t", "n")])
QUALITY_TYPE = T.StructType([T.StructField(n, T.IntegerType() if n.endswith("_phred") and n != "sum_phred" else T.LongType()) for n in ("len", "min_phred", "max_phred", "sum_phred", "q20_bases", "q30_bases")])


def packed_base_len(n: Column) -> Column:
    return F.floor((n + 3) / 4).cast("long")


def bit_mask_len(n: Column) -> Column:
    return F.floor((n + 7) / 8).cast("long")


def base_counts(seq: Column | str) -> Column:
    """struct<len, a, c, g, t, n, gc_bases, canonical_bases>: either case; everything but ACGT is n."""
    s = F.upper(text(seq))
    n = F.length(s).cast("long")
    of = lambda letters: n - F.length(F.translate(s, letters, "")).cast("long")
    a, c, g, t = of("A"), of("C"), of("G"), of("T")
    return F.struct(n.alias("len"), a.alias("a"), c.alias("c"), g.alias("g"), t.alias("t"), (n - a - c - g - t).alias("n"), (c + g).alias("gc_bases"), (a + c + g + t).alias("canonical_bases"))


_CODE = np.full(256, 4, dtype=np.uint8)
for _letter, _value in CODES.items():
    _CODE[ord(_letter)] = _CODE[ord(_letter.lower())] = _value
_TABLE = _CODE.tobytes()


def _flat(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all cells, offsets); nulls are empty."""
    cells = cells.cast(pa.binary()) if not pa.types.is_binary(cells.type) else cells
    n = len(cells)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(cells.buffers()[1], dtype=np.int32)[cells.offset : cells.offset + n + 1].astype(np.int64)
    data = cells.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _per_cell(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _bits_of_cells(bits: np.ndarray, offsets: np.ndarray, per_byte: int, width: int) -> pa.Array:
    """Codes of `width` bits, `per_byte` to a byte from the lowest bit on; each cell begins a byte."""
    sizes = np.diff(offsets)
    out = -(-sizes // per_byte)
    ends = np.concatenate([[0], np.cumsum(out)])
    place = np.arange(len(bits)) - np.repeat(offsets[:-1], sizes)
    at = np.repeat(ends[:-1], sizes) + place // per_byte
    slots = np.zeros((int(ends[-1]), per_byte), dtype=np.uint8)
    slots[at, place % per_byte] = bits
    packed = np.zeros(int(ends[-1]), dtype=np.uint8)
    for k in range(per_byte):
        packed |= slots[:, k] << np.uint8(k * width)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(packed)])


def _even(code: np.ndarray, n: int, size: int) -> tuple[pa.Array, pa.Array, list[np.ndarray]]:
    """Packed bases, mask and counts of n cells of one size: columns of a table, no places to work out."""
    code = code.reshape(n, size)
    masked = code == 4
    counts = [np.add.reduce((code == k).view(np.uint8), axis=1, dtype=np.uint32).astype(np.int64) for k in range(5)]
    wide = np.zeros((n, -(-size // 4) * 4), dtype=np.uint8)
    wide[:, :size] = code & 3
    bases = wide[:, 0::4] | wide[:, 1::4] << np.uint8(2) | wide[:, 2::4] << np.uint8(4) | wide[:, 3::4] << np.uint8(6)
    mask = np.packbits(masked, axis=1, bitorder="little")
    cells = lambda x: pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(x.shape[1])), pa.py_buffer(np.ascontiguousarray(x))])
    return cells(bases), cells(mask), counts


def packed_array(seq: pa.Array) -> pa.Array:
    """Base i in bits 2 (i mod 4) of byte i div 4, others than ACGT as 0 with a bit in the mask; and the counts of bases."""
    data, offsets = _flat(seq)
    code = np.frombuffer(data.tobytes().translate(_TABLE), dtype=np.uint8)
    sizes = np.diff(offsets)
    if len(sizes) and sizes[0] and (sizes == sizes[0]).all():
        bases, mask, counts = _even(code, len(sizes), int(sizes[0]))
        return pa.StructArray.from_arrays([bases, mask, pa.array(sizes), *[pa.array(c) for c in counts]], ["bases", "n_mask", "len", "a", "c", "g", "t", "n"])
    masked = code == 4
    counts = [_per_cell(code == k, offsets) for k in range(5)]
    bases = _bits_of_cells(np.where(masked, 0, code).astype(np.uint8), offsets, 4, 2)
    mask = _bits_of_cells(masked.astype(np.uint8), offsets, 8, 1)
    return pa.StructArray.from_arrays([bases, mask, pa.array(np.diff(offsets)), *[pa.array(c) for c in counts]], ["bases", "n_mask", "len", "a", "c", "g", "t", "n"])


@F.arrow_udf(PACKED_TYPE)
def pack_bases(seq: pa.Array) -> pa.Array:
    """The packed form of each cell (see packed_array)."""
    return packed_array(seq)


def first_bad_phred(qual: pa.Array) -> pa.Array:
    """Place of the first byte outside of ! to ~ in each cell, from 0; null if there is none."""
    data, offsets = _flat(qual)
    at = np.flatnonzero((data < 33) | (data > 126))
    first, none = np.zeros(len(qual), np.int32), np.ones(len(qual), bool)
    if len(at):
        cell = np.searchsorted(offsets, at, side="right") - 1
        which, place = np.unique(cell, return_index=True)
        first[which], none[which] = at[place] - offsets[which], False
    return pa.array(first, mask=none)


def quality_array(qual: pa.Array) -> pa.Array:
    """Phred+33 summary of each cell; bytes are taken as they are, so check them first (first_bad_phred)."""
    data, offsets = _flat(qual)
    sizes = np.diff(offsets)
    some = sizes > 0
    if len(sizes) and sizes[0] and (sizes == sizes[0]).all():
        p = data.reshape(len(sizes), -1)
        cols = [sizes, p.min(axis=1).astype(np.int32) - 33, p.max(axis=1).astype(np.int32) - 33, p.sum(axis=1, dtype=np.int64) - 33 * sizes, *[(p >= 33 + q).sum(axis=1, dtype=np.int64) for q in (20, 30)]]
        return pa.StructArray.from_arrays([pa.array(c) for c in cols], ["len", "min_phred", "max_phred", "sum_phred", "q20_bases", "q30_bases"])
    phred = data.astype(np.int64) - 33
    low, high = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int32)
    if some.any():
        low[some] = np.minimum.reduceat(phred, offsets[:-1][some])
        high[some] = np.maximum.reduceat(phred, offsets[:-1][some])
    cols = [pa.array(sizes), pa.array(low, mask=~some), pa.array(high, mask=~some), *[pa.array(_per_cell(x, offsets)) for x in (phred, phred >= 20, phred >= 30)]]
    return pa.StructArray.from_arrays(cols, ["len", "min_phred", "max_phred", "sum_phred", "q20_bases", "q30_bases"])


@F.arrow_udf(QUALITY_TYPE)
def summarize_qualities(qual: pa.Array) -> pa.Array:
    """The Phred+33 summary of each cell (see quality_array)."""
    return quality_array(qual)


def mean_phred(summary: Column) -> Column:
    return F.when(summary["len"] > 0, summary["sum_phred"] / summary["len"])


def check_thresholds(thresholds: list[int]) -> list[int]:
    if len(thresholds) > 255:
        raise ValueError(f"too many quality thresholds: {len(thresholds)}")
    for i in range(1, len(thresholds)):
        if thresholds[i] < thresholds[i - 1]:
            raise ValueError(f"quality threshold at index {i} is not sorted")
    return thresholds


def binned(qual: bytes | None, thresholds: list[int]) -> bytes | None:
    """The bins of one cell."""
    if qual is None:
        return None
    table = np.searchsorted(np.array(check_thresholds(thresholds)), np.arange(256) - 33, side="right").astype(np.uint8)
    return bytes(qual).translate(table.tobytes())


def bin_qualities(qual: Column | str, thresholds: list[int]) -> Column:
    """A byte for each base: how many of the sorted thresholds its Phred score reaches."""
    table = np.searchsorted(np.array(check_thresholds(thresholds)), np.arange(256) - 33, side="right").astype(np.uint8)

    @F.arrow_udf("binary")
    def binned(cells: pa.Array) -> pa.Array:
        data, offsets = _flat(cells)
        return pa.BinaryArray.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(table[data])])

    return binned(qual)


def packed_base_at(bases: Column | str, n_mask: Column | str, i: Column) -> Column:
    """The base at i, from 0: A, C, G, T or N; null past the buffer (of bytes, which may reach beyond the sequence)."""
    bases, n_mask = (F.col(x) if isinstance(x, str) else x for x in (bases, n_mask))
    byte = lambda b, at: F.conv(F.hex(F.substr(b, (at + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    code = F.call_function("shiftright", byte(bases, F.floor(i / 4)), (2 * (i % 4)).cast("int")).bitwiseAND(F.lit(3))
    masked = F.call_function("shiftright", byte(n_mask, F.floor(i / 8)), (i % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    inside = (i >= 0) & (F.floor(i / 4) < F.octet_length(bases))
    return F.when(inside, F.when(F.coalesce(masked, F.lit(False)), "N").otherwise(F.substr(F.lit("ACGT"), code + 1, F.lit(1))))
