"""SimHash fingerprints and near-duplicate classes by multi-index hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import full_links, unmet
from .common import KeyFilter, cut, table, utf8
from .components import component_stars, connected_components, with_group_min

HALF = 0xFFFFFFFF


def simhash64(text: bytes | None, width: int = 3) -> int:
    """Majority bits of XXH64 (seed 42) over the word shingles of a text; 0 if it has no word."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(42))
    for at in range(0, n, 65536):  # a very long text doesn't need memory for all of its bits at once
        part = np.fromiter(hashes, dtype="<u8", count=min(65536, n - at))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column | str, width: int = 3) -> Column:
    """The 64-bit fingerprint of each text as a signed long."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array([simhash64(t, width) for t in utf8(texts)], pa.int64())

    return simhash(text)


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _masked(df: DataFrame) -> DataFrame:
    """Links by stars, one mask of two bits after the other: bit shift_i + i and bit shift_j + j, i < j where both lie in the same half.

    All that agree outside such a mask are at distance 2 or less of each other, so one edge to the smallest will do.
    """
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c))
    seen = df.select("fp", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"), "shift_i", "shift_j", "same").select("*", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("j"))
    seen = seen.where("not same or i < j").select("fp", (F.col("i") + F.col("shift_i")).alias("i"), (F.col("j") + F.col("shift_j")).alias("j"))
    seen = seen.select("fp", bit("i").bitwiseOR(bit("j")).alias("mask")).withColumn("rest", F.col("fp").bitwiseAND(F.bitwise_not(F.col("mask"))))
    hub = seen.groupBy("mask", "rest").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    return seen.join(hub, ["mask", "rest"]).where("fp <> b").select(F.col("fp").alias("a"), "b")


def hamming_links(fingerprints: DataFrame, dense: int = 1024) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints `fp` at distance 2 or less.

    Two halves of 32 bits index the fingerprints. Of two errors at most one lies in the upper half,
    or else none in the lower: so the upper half is probed with its Hamming ball of radius 1 and the
    lower as it is. Flips go from even to odd halves only, which finds each pair once. Candidates
    are kept if the whole distance is 2 or less. Where a half is shared by more than `dense`
    fingerprints, masked patterns link those and all that are a flip away in place of pairs; no link is lost.
    """
    fps = fingerprints.select("fp").where("fp is not null").distinct()
    fps = cut(fps.select("fp", F.shiftrightunsigned("fp", 32).alias("hi"), F.col("fp").bitwiseAND(F.lit(HALF)).alias("lo")))
    crowded = lambda df, kind: df.select("fp", *[F.lit(x).alias(c) for c, x in zip(("shift_i", "shift_j", "same"), kind, strict=True)])
    found, masked = [], []
    for half, errors_at in (("hi", 0), ("lo", 32)):
        sizes = fps.groupBy(half).agg(F.count("*").alias("n")).where("n > 1")
        shared = fps.join(sizes, half).select("fp", half, "n")
        few = shared.where(F.col("n") <= dense)
        pair = few.select(F.col("fp").alias("a"), half).join(few.select(F.col("fp").alias("b"), half), half).where("a < b")
        found.append(pair.where(_distance("a", "b") <= 2).select("a", "b"))
        masked.append(crowded(shared.where(F.col("n") > dense), (errors_at, errors_at, True)))
    sized = fps.join(fps.groupBy("hi").agg(F.count("*").alias("n")), "hi")
    odd = F.bit_count("hi") % 2
    flips = F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.col("hi").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))).alias("hi")
    probe = sized.where(odd == 0).select(F.col("fp").alias("a"), F.col("n").alias("n_a"), flips)
    held = sized.where(odd == 1).select(F.col("fp").alias("b"), F.col("n").alias("n_b"), "hi")
    found.append(probe.join(held, "hi").where((F.col("n_a") <= dense) & (F.col("n_b") <= dense) & (_distance("a", "b") <= 2)).select("a", "b"))
    # where either half is crowded no pair is made: both sides of such a flip are masked
    full = fps.groupBy("hi").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("hi")
    beside = full.union(full.select(flips)).distinct()
    masked.append(crowded(fps.join(beside, "hi"), (32, 0, False)))
    crowd = cut(masked[0].union(masked[1]).union(masked[2]))
    if not crowd.isEmpty():
        found.append(_masked(crowd))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, dense: int = 1024) -> DataFrame:
    """(doc_id, fp, component_id), a row for each row of docs: component_id is the smallest id reachable by links.

    Null, empty and blank texts have fingerprint 0 and link like others. A null id is never smaller
    than others; a class of null ids only has a null component. Rows that repeat an id or a text have the same class,
    a row each. A bit that half of the shingles have is 0. A very long text is hashed in parts, whole. An
    empty table gives an empty one. Other columns of docs aren't looked at.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), width).alias("fp")))
    classes = connected_components(hamming_links(rows, dense))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("m")).join(classes.withColumnRenamed("node", "fp"), "fp", "left")
    least = cut(least.select("fp", "m", F.coalesce("component", "fp").alias("c")))
    names = with_group_min(least, "c", "fp", F.col("m"), "component_id")
    return rows.join(names.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the least id of its class."""
    got = simhash_classes(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Segments of 32 bits of the wide fingerprint.
SEGMENTS = 16
#: Share of the wide fingerprint's bits that may differ. At a Jaccard of 0.8 over the same shingles 15 % do; 26 % is seven deviations of 512 bits from it.
APART = 0.26
#: Share of bits that agree at a Jaccard of 0.8: sets of one size share 0.889 of each, and bits differ as the angle of that cosine.
AGREE = 0.848
#: Tables that such a pair is expected to share. Their number follows from it and from the key's bits.
SHARED = 6
#: Bits of a table's key, at least and at most.
LEAST_BITS, MOST_BITS = 12, 24
#: Tables at the most bits.
BANDS = math.ceil(SHARED / AGREE**MOST_BITS)
#: Bits of another segment that an entry of a table has beside its key, and how many may differ: over 10 do in 0.6 % of such pairs' meetings.
CHECK, CHECK_APART = 31, 10


def tables(n: int) -> tuple[int, int]:
    """(bits of a key, number of tables) for n texts: a key has so many bits that a bucket has half a chance meeting, up to MOST_BITS."""
    bits = min(MOST_BITS, max(LEAST_BITS, max(n - 1, 1).bit_length() + 1))
    return bits, math.ceil(SHARED / AGREE**bits)


@cache
def _picks(segments: int) -> np.ndarray:
    """The bits of each table's key, (BANDS, MOST_BITS): drawn from all segments but that of the table's check."""
    random = np.random.default_rng(37)
    beside = [np.flatnonzero(np.arange(32 * segments) // 32 != k) for k in range(segments)]
    return np.array([random.choice(beside[t % segments], MOST_BITS, replace=False) for t in range(BANDS)])


def table_keys(sketch: np.ndarray, bits: int, n_tables: int) -> np.ndarray:
    """(texts, tables) longs of wide fingerprints (texts, segments) uint32: the table's number, `bits` sampled bits and CHECK bits of another segment."""
    segments = sketch.shape[1]
    ones = np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8), axis=1, bitorder="little").astype(np.int64)
    key = np.zeros((len(sketch), n_tables), dtype=np.int64)
    for j, pick in enumerate(_picks(segments)[:n_tables, :bits].T):
        key |= ones[:, pick] << j
    number = np.arange(n_tables)
    check = sketch[:, number % segments].astype(np.int64) & ((1 << CHECK) - 1)
    return (number << (CHECK + MOST_BITS)) | (key << CHECK) | check


def _entries(bits: int, n_tables: int):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sketch = part.column("s").flatten().to_numpy().astype(np.uint32).reshape(len(part), -1)
                keys = table_keys(sketch, bits, n_tables)
                yield pa.RecordBatch.from_arrays([pa.array(keys.T.ravel()), pa.array(np.tile(part.column("h").to_numpy(), n_tables))], ["w", "id"])

    return entries


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, id, other) of entries (w, id) in order of w: each with the first of its bucket and the one before, where their checks are near.

    Buckets v of four entries or more give a row without other for each entry. In smaller ones first and before are all pairs.
    Of an open bucket its first and last entry are held, or all where it has three at most.
    """
    w, ids, deep = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), False
    for batch in batches:
        if not batch.num_rows:
            continue
        held = len(w)
        w, ids = np.concatenate([w, batch.column("w").to_numpy()]), np.concatenate([ids, batch.column("id").to_numpy()])
        v, at = w >> CHECK, np.arange(len(w))
        new = np.concatenate([[True], v[1:] != v[:-1]])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(w)))
        later = np.flatnonzero(~new & (at >= held))
        first = np.repeat(starts, sizes)[later]
        x, y = np.concatenate([later, later[first < later - 1]]), np.concatenate([first, later[first < later - 1] - 1])
        near = np.bitwise_count((w[x] ^ w[y]) & ((1 << CHECK) - 1)) <= CHECK_APART
        x, y = x[near], y[near]
        large = sizes > 3
        large[0] |= deep
        told = np.repeat(large, sizes)
        told[:held] &= not deep
        none = pa.nulls(int(told.sum()), pa.int64())
        for of, other in ((x, pa.array(ids[y])), (told, none)):
            yield pa.RecordBatch.from_arrays([pa.array(v[of]), pa.array(ids[of]), other], ["v", "id", "other"])
        deep = bool(large[-1])
        keep = [starts[-1], len(w) - 1] if deep else at[starts[-1] :]
        w, ids = w[keep], ids[keep]


def _shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of the distinct word shingles of a text, at least one; a short text is one shingle."""
    words = text.lower().split() if text else []
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8", count=max(1, len(words) - width + 1)))


def _wide(h: np.ndarray, segments: int) -> list[int]:
    longs = (segments + 1) // 2
    ones = np.zeros(64 * longs, dtype=np.int64)
    step = np.arange(1, longs + 1, dtype="<u8") * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(h), 16384):
        z = h[at : at + 16384, None] + step
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        bits = np.unpackbits(z.view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<u4")[:segments].tolist()


def wide_simhash(text: bytes | None, segments: int = SEGMENTS, width: int = 2) -> list[int]:
    """A SimHash of 32 bits a segment over the distinct word shingles of a text, as unsigned integers; 0 if it has no word."""
    if not text or not text.split():
        return [0] * segments
    return _wide(_shingle_hashes(text, width), segments)


def _marks(text: Column, width: int, segments: int) -> Column:
    """The wide fingerprint over shingles of `width` words."""

    @F.arrow_udf("array<bigint>")
    def marks(texts: pa.Array) -> pa.Array:
        return pa.array([_wide(_shingle_hashes(t, width), segments) for t in utf8(texts)], pa.list_(pa.int64()))

    return marks(text)


def _bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for x, y in zip(a.T, b.T, strict=True):
        out += np.bitwise_count(x[:, None] ^ y)
    return out


def _shingles(text: bytes | None, width: int) -> set[bytes]:
    words = text.lower().split() if text else []
    return set(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))) if len(words) >= width else {b" ".join(words)}


def shingle_jaccard(a: bytes | None, b: bytes | None, width: int) -> float:
    """Jaccard similarity of the sets of word shingles; two texts without words are alike."""
    x, y = _shingles(a, width), _shingles(b, width)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _alike(a: str, b: str, width: int, least: float) -> Column:
    @F.arrow_udf("boolean")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([shingle_jaccard(x, y, width) >= least for x, y in zip(utf8(left), utf8(right), strict=True)], pa.bool_())

    return alike(a, b)


def _linked(texts: DataFrame, width: int, similarity: float, segments: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Links by stars, the stars of their components, and the links of buckets compared in full; see near_links."""
    marks = cut(texts.select("h", _marks(F.col("text"), width, segments).alias("s")))
    entries = marks.mapInArrow(_entries(*tables(marks.count())), "w bigint, id bigint")
    met = cut(entries.repartition(F.shiftright("w", CHECK)).sortWithinPartitions("w", "id").mapInArrow(_meet, "v bigint, id bigint, other bigint"))
    pairs = met.where("other is not null").select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()
    pairs = pairs.join(marks.select(F.col("h").alias("a"), F.col("s").alias("s_a")), "a").join(marks.select(F.col("h").alias("b"), F.col("s").alias("s_b")), "b")
    distance = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    most = int(32 * segments * APART)
    pairs = cut(pairs.where(distance <= most).select("a", "b"))
    held = KeyFilter(pairs.select(F.explode(F.array("a", "b")).alias("h")), "h").where(texts, "h")
    left = held.select(F.col("h").alias("a"), F.col("text").alias("text_a"))
    right = held.select(F.col("h").alias("b"), F.col("text").alias("text_b"))
    # kept, so that comparing and contracting aren't one stage, which takes two workers a core
    links = cut(pairs.join(left, "a").join(right, "b").where(_alike("text_a", "text_b", width, similarity)).select("a", "b"))
    classes = component_stars(links)
    dealt = cut(unmet(met.where("other is null").select("v", "id"), classes))
    if dealt.isEmpty():
        return links, classes, None
    texts_of = lambda some: KeyFilter(some.select("id"), "id").where(texts, "h").select(F.col("h").alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    sketches = marks.select(F.col("h").alias("id"), F.col("s").alias("sketch"))
    return links, classes, full_links(dealt, sketches, texts_of, _bits_apart, most, lambda t: _shingles(t, width), similarity)


def near_links(texts: DataFrame, width: int = 5, similarity: float = 0.8, segments: int = SEGMENTS) -> DataFrame:
    """Edges (a, b) between near duplicates among distinct texts (h long, text): Jaccard of word shingles of `similarity` or more.

    A SimHash of 32 bits a segment over the shingles is put into tables, each keyed by bits sampled
    from it; the number of texts sets how many (see tables). In a table's bucket a text meets the first and
    the one before, so a group of g copies gives links in proportion to g, not pairs. Distances of the
    whole fingerprints drop chance meetings, the texts themselves decide. Buckets of
    four texts or more that these links leave in more than one component are then compared in full,
    so what is like in a bucket is connected.
    """
    links, _, more = _linked(texts, width, similarity, segments)
    return links if more is None else links.union(more)


def near_classes(texts: DataFrame, width: int = 5, similarity: float = 0.8, segments: int = SEGMENTS) -> DataFrame:
    """(node, component) of near_links, by the stars of the first links."""
    _, classes, more = _linked(texts, width, similarity, segments)
    return connected_components(classes if more is None else classes.union(more))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs less all but one document of each class of near duplicates; the smallest id stays, then the least text hash.

    Equal texts are one class, null texts too; the rest are classes of near_links. Rows that repeat an
    id and a text count as copies: one of them stays. A null id stays only where a class has no other.
    Columns of docs are returned as they came.
    """
    key, text = F.col(id_col), F.col(text_col)
    rows = docs.select(key.alias("doc_id"), F.xxhash64(text).alias("h"))
    texts = docs.select(F.xxhash64(text).alias("h"), text.alias("text")).dropDuplicates(["h"])
    classes = near_classes(texts, width, similarity)
    named = rows.join(classes.withColumnRenamed("node", "h"), "h", "left").select("doc_id", "h", F.coalesce("component", "h").alias("c"))
    first = named.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("s"))
    keep = first.select(F.col("s.doc_id").alias("_keep_id"), F.col("s.h").alias("_keep_h"))
    same = rows.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1")
    keep = keep.join(same, keep._keep_id.eqNullSafe(same.doc_id) & (keep._keep_h == same.h), "left").select("_keep_id", "_keep_h", F.col("n").isNotNull().alias("_twice"))
    names = docs.columns
    cols = [f"_c{i}" for i in range(len(names))]
    at, text_at = f"_c{names.index(id_col)}", f"_c{names.index(text_col)}"
    kept = docs.toDF(*cols)
    kept = kept.join(keep, kept[at].eqNullSafe(keep._keep_id) & (F.xxhash64(kept[text_at]) == keep._keep_h))
    once = kept.where(~F.col("_twice")).select(*cols)
    return once.union(kept.where("_twice").dropDuplicates([at, text_at]).select(*cols)).toDF(*names)
