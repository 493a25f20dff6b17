"""Fuzzy line deduplication: MinHash bands, exact Jaccard, union-find."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import full_links, unmet
from .common import KeyFilter, cut, freed, table, utf8
from .components import component_stars, connected_components, with_group_min

SHINGLE = 5
BANDS, ROWS = 9, 4
#: Characters whose signatures are made at once.
CHUNK = 1 << 17
#: Rows of a bucket that one task compares in full; larger buckets are dealt to pairs of blocks of as many.
BLOCK = 1024

_RANDOM = np.random.default_rng(31)
_XOR = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_ODD = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def normalise(line: bytes) -> bytes:
    """A-Z in lower case, runs of blanks as one."""
    return b" ".join(line.lower().split())


def line_id(line: bytes) -> int:
    h = xxhash.xxh64_intdigest(line, 42)
    return h - (1 << 64) if h >> 63 else h


def _line_ids(lines: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x, 42) for x in lines], dtype=np.uint64).view(np.int64)


#: MinHashes of which a sketch has four bits, two in each of its words, and how many of them may differ. At a Jaccard of 0.8
#: some 19 % differ: over 16 of 32 do in one of 70 000 such pairs, where the bands miss one of 115. Of lines that share a band
#: and little else some two in 10 000 are as near (at two bits, 14 of which might differ, some two in 100).
SKETCHED, MAY_DIFFER = 32, 16
SKETCH = ["sketch", "more"]


def _rolled(points: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the SHINGLE code points from each place of texts on, and where each text's begin, and the end. counts: code points of each text, SHINGLE at least."""
    points = points.astype(np.uint64)
    h = points[: len(points) - SHINGLE + 1].copy()
    for k in range(1, SHINGLE):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= points[k : len(points) - SHINGLE + 1 + k]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    whole = np.ones(len(h), dtype=bool)
    ends = np.cumsum(counts)[:-1]
    for k in range(1, SHINGLE):
        whole[ends - k] = False  # begins in one text and ends in the next
    return h[whole], np.concatenate([[0], np.cumsum(counts - SHINGLE + 1)])


def signatures(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, (lines, BANDS) signed longs, and a sketch of each line, (words, lines). A line of under SHINGLE characters is one shingle.

    Keys are hashes of ROWS MinHashes of the line's character shingles; each word of the sketch has two bits of each MinHash.
    """
    lines = [x if len(x) >= 4 * SHINGLE else x + b"\0" * (SHINGLE - len(x.decode("utf-8", "replace"))) for x in lines]
    points = np.frombuffer(b"".join(lines).decode("utf-8", "replace").encode("utf-32-le"), dtype="<u4")
    h, starts = _rolled(points, np.array([len(x.decode("utf-8", "replace")) for x in lines]))
    h = (h >> np.uint64(32)).astype(np.uint32)
    least, v = np.empty((BANDS * ROWS, len(lines)), dtype=np.uint32), np.empty_like(h)
    for j in range(BANDS * ROWS):
        np.bitwise_xor(h, _XOR[j], out=v)
        np.multiply(v, _ODD[j], out=v)
        np.minimum.reduceat(v, starts[:-1], out=least[j])
    at = np.arange(0, 2 * SKETCHED, 2, dtype=np.uint64)[:, None]
    bits = [((least[:SKETCHED] >> np.uint32(2 * k)) & np.uint32(3)).astype(np.uint64) << at for k in range(len(SKETCH))]
    key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(lines), axis=1)
    for j in range(ROWS):
        key = (key ^ least[j::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.T.view(np.int64), np.bitwise_or.reduce(bits, axis=1).view(np.int64)


#: A-Z in lower case, blanks other than the line feed as spaces.
_LOWER = bytes(32 if c in b"\t\r\x0b\x0c" else c for c in range(256)).lower()


def _lines(text: bytes) -> list[bytes]:
    """The normalised lines of a text, all at once; blank ones are empty."""
    text = text.translate(_LOWER)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return [line.strip(b" ") for line in text.split(b"\n")]


def _distinct(batch: pa.RecordBatch) -> list[bytes]:
    """The lines of the texts of a batch that aren't blank, once each."""
    found = {line for t in utf8(batch.column("text")) if t for line in _lines(t)}
    found.discard(b"")
    return list(found)


BAND = "v bigint, id bigint, sketch bigint, more bigint"


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BAND for each band of the distinct lines of a batch."""
    for batch in batches:
        part: list[bytes] = []
        size = 0
        for line in _distinct(batch):
            part.append(line)
            size += len(line)
            if size >= CHUNK:
                yield _band_rows(part)
                part, size = [], 0
        if part:
            yield _band_rows(part)


def _band_rows(lines: list[bytes]) -> pa.RecordBatch:
    keys, sketch = signatures(lines)
    return pa.RecordBatch.from_arrays([pa.array(keys.T.ravel()), *(pa.array(np.tile(x, BANDS)) for x in (_line_ids(lines), *sketch))], ["v", "id", *SKETCH])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, lines): the ids of a document's lines, null where a line is blank."""
    for batch in batches:
        held = [_lines(t or b"") for t in utf8(batch.column("text"))]
        flat = [line for x in held for line in x]
        ids = pa.array(_line_ids(flat), mask=np.array([not line for line in flat], dtype=bool))
        ends = np.cumsum([0, *map(len, held)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], ["doc_id", "h", "lines"])


def _line_texts(wanted: KeyFilter):
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _distinct(batch)
            ids = _line_ids(found)
            pick = np.flatnonzero(wanted(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[pick]), pa.array([found[i].decode("utf-8", "replace") for i in pick], pa.string())], ["id", "text"])

    return texts


def line_shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def line_jaccard(a: str, b: str) -> float:
    x, y = line_shingles(a), line_shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def _shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the shingles of each text (line_shingles, repeats included), and where each text's begin, and the end."""
    counts = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    at, hashes, starts, i = np.cumsum(np.concatenate([[0], counts])), [], [np.zeros(1, dtype=np.int64)], 0
    while i < len(texts):
        j = max(int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1, i + 1)
        n = counts[i:j]
        points = np.frombuffer(b"".join(utf8(texts.slice(i, j - i))).decode("utf-8").encode("utf-32-le"), dtype="<u4")
        if len(short := np.flatnonzero(n < SHINGLE)):
            # filled up with what is no code point
            points = np.insert(points, np.repeat(np.cumsum(n)[short], SHINGLE - n[short]), 0x110000)
        h, own = _rolled(points, np.maximum(n, SHINGLE))
        hashes.append(h)
        starts.append(own[1:] + starts[-1][-1])
        i = j
    return np.concatenate(hashes), np.concatenate(starts)


#: So many pairs are compared at once at most; a key has the pair's number, 51 bits of the shingle's hash, and the side.
PAIRS = 1 << 12


def jaccards(left: pa.Array, right: pa.Array) -> np.ndarray:
    """line_jaccard of each pair of texts, by hashes of the shingles."""
    (x, x_at), (y, y_at) = _shingle_hashes(left), _shingle_hashes(right)
    pair = np.arange(PAIRS, dtype=np.uint64) << np.uint64(52)
    both = x_at + y_at
    out, i = np.empty(len(left)), 0
    while i < len(left):
        j = int(np.searchsorted(both, both[i] + CHUNK // 4, "right")) - 1
        j = min(max(j, i + 1), i + PAIRS)
        keys = np.empty(both[j] - both[i], dtype=np.uint64)
        n = x_at[j] - x_at[i]
        for side, (part, h, at) in enumerate(((keys[:n], x, x_at), (keys[n:], y, y_at))):
            np.right_shift(h[at[i] : at[j]], np.uint64(13), out=part)
            part <<= np.uint64(1)
            part |= np.repeat(pair[: j - i] | np.uint64(side), np.diff(at[i : j + 1]))
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        of = lambda k: np.bincount((k >> np.uint64(52)).astype(np.int64), minlength=j - i)  # noqa: B023,E731
        shared = of(keys[1:][keys[1:] ^ keys[:-1] == 1])
        out[i:j] = shared / (of(keys) - shared)
        i = j
    return out


def _alike(a: str, b: str, least: float) -> Column:
    @F.arrow_udf("boolean")
    def alike(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(jaccards(left, right) >= least if len(left) else [], pa.bool_())

    return alike(a, b)


def _differing(x: np.ndarray) -> np.ndarray:
    x = x | x >> np.uint64(1)
    return np.bitwise_count(x & np.uint64(0x5555555555555555))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many MinHashes of two sketches of one word differ."""
    return _differing(a ^ b)


def _between(sketch: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many MinHashes of the sketches at the places a and b differ."""
    x = sketch[0][a] ^ sketch[0][b]
    for word in sketch[1:]:
        x |= word[a] ^ word[b]
    return _differing(x)


def _sketch_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _differing(np.bitwise_or.reduce([x[:, None] ^ y[None] for x, y in zip(a.T, b.T, strict=True)]))


def _words(t: pa.Table) -> list[np.ndarray]:
    """The words of the sketches of a table."""
    return [t.column(c).to_numpy().view(np.uint64) for c in SKETCH if c in t.column_names]


def _buckets(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Rows in order of v, as tables of whole buckets (False), or of parts of a bucket of over `most` rows (True)."""
    rest, large = None, None
    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch])
        if large is not None:
            n = int(np.searchsorted(t.column("v").to_numpy(), large, "right"))
            if n:
                yield t.slice(0, n), True
            if n == len(t):
                continue
            t, large = t.slice(n), None
        t = t if rest is None else pa.concat_tables([rest, t])
        v = t.column("v").to_numpy()
        n = int(np.searchsorted(v, v[-1]))
        if n:
            yield t.slice(0, n), False
        rest = t.slice(n)
        if most and len(rest) > most:
            yield rest, True
            rest, large = None, v[-1]
    if rest is not None:
        yield rest, False


def _by_size(v: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the rows of buckets of two rows or more, as arrays (buckets, rows): buckets of a size at once."""
    starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    sizes = np.diff(np.append(starts, len(v)))
    for g in np.unique(sizes[sizes > 1]).tolist():
        own, step = starts[sizes == g], max(1, (1 << 18) // (g * g))
        for i in range(0, len(own), step):
            yield own[i : i + step, None] + np.arange(g)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of 2^16 or more, for rows of numbers."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= 1 << 16:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


MET = f"{BAND}, other bigint, near boolean, crowded boolean, large boolean"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MET, of rows BAND in order of v: near pairs (id, other) of a bucket, those whose sketches differ in MAY_DIFFER at most.

    A bucket of few near pairs gives them all. A crowded one gives each entry that has a near one once, with
    the nearest of those before it, and so does each part of a large one, of over BLOCK rows, for all its entries.
    near: the entry has a near one in its bucket, or in its block of a large one.
    """
    for t, large in _buckets(_gathered(batches), BLOCK):
        names = [c for c in SKETCH if c in t.column_names]

        def rows(at, other, has, near, crowded, large):
            flags = (np.full(len(at), x) for x in (near, crowded, large))
            columns = [v[at], ids[at], *(x[at].view(np.int64) for x in sketch)]  # noqa: B023
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(ids[other], mask=~np.full(len(at), has)), *map(pa.array, flags)], ["v", "id", *names, "other", "near", "crowded", "large"])  # noqa: B023

        v, ids, sketch = t.column("v").to_numpy(), t.column("id").to_numpy(), _words(t)
        if not large:
            many = np.zeros(len(v), dtype=bool)
            many[1:] = v[1:] == v[:-1]
            many[:-1] |= many[1:].copy()
            v, ids, sketch = v[many], ids[many], [x[many] for x in sketch]
        if not len(v):
            continue
        order = np.lexsort((ids, v))
        v, ids = v[order], ids[order]
        new = np.concatenate([[True], (v[1:] != v[:-1]) | (ids[1:] != ids[:-1])])
        v, ids, sketch = v[new], ids[new], [x[order][new] for x in sketch]
        starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        sizes = np.diff(np.append(starts, len(v)))
        wide = sizes > (0 if large else BLOCK)
        for start, size in zip(starts[wide].tolist(), sizes[wide].tolist(), strict=True):
            for i in range(start, start + size, BLOCK):
                k = np.arange(i, min(i + BLOCK, start + size))
                apart = np.where(np.tri(len(k), k=-1, dtype=bool), _between(sketch, k[:, None], k[None]), 99)
                has = apart.min(1) <= MAY_DIFFER
                yield rows(k, k[apart.argmin(1)], has, has | (apart.min(0) <= MAY_DIFFER), True, True)
        narrow = np.repeat(~wide, sizes)
        v, ids, sketch = v[narrow], ids[narrow], [x[narrow] for x in sketch]
        if not len(v):
            continue
        for at in _by_size(v):
            g = at.shape[1]
            apart = np.where(np.tri(g, k=-1, dtype=bool), _between(sketch, at[:, :, None], at[:, None]), 99)
            near = apart <= MAY_DIFFER
            crowded = near.sum((1, 2)) > max(g, 3)
            b, x, y = np.nonzero(near & ~crowded[:, None, None])
            if len(b):
                yield rows(at[b, x], at[b, y], True, True, False, False)
            if crowded.any():
                at, apart, near = at[crowded], apart[crowded], near[crowded]
                nearest = np.take_along_axis(at, apart.argmin(2), 1)
                some = near.any(2) | near.any(1)
                yield rows(at[some], nearest[some], near.any(2)[some], True, True, False)


def _still_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (BAND and c) in order of v that have a near one of another component c in their bucket."""
    for t, _ in _buckets(_gathered(batches)):
        v, of, sketch = t.column("v").to_numpy(), t.column("c").to_numpy(), _words(t)
        some = np.zeros(len(v), dtype=bool)
        for at in _by_size(v):
            at = at[(of[at] != of[at[:, :1]]).any(1)]
            near = (of[at][:, :, None] != of[at][:, None]) & (_between(sketch, at[:, :, None], at[:, None]) <= MAY_DIFFER)
            some[at[near.any(2)]] = True
        if some.any():
            yield from t.filter(pa.array(some)).combine_chunks().to_batches()


#: Cells of the table of shingles of a bucket that is multiplied at once.
CELLS = 1 << 22


def _shared(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles each two of some lines share, (lines, lines), and how many each has. See _shingle_hashes."""
    n = len(starts) - 1
    row = np.repeat(np.arange(n), np.diff(starts))
    if len(hashes) <= 1 << 13:  # 51 bits of a hash and its place are sorted at once
        keys = hashes & ~np.uint64((1 << 13) - 1) | np.arange(len(hashes), dtype=np.uint64)
        keys.sort()
        which = keys >> np.uint64(13)
        which = np.cumsum(np.concatenate([[False], which[1:] != which[:-1]]))
        at = np.empty(len(hashes), dtype=np.int64)
        at[keys & np.uint64((1 << 13) - 1)] = which
        counts = np.bincount(which)
    else:
        _, at, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    alone = counts[at] == 1
    sizes, both = np.bincount(row[alone], minlength=n).astype(np.float64), np.zeros((n, n))
    at, row = (np.cumsum(counts > 1) - 1)[at[~alone]], row[~alone]
    width, step = int((counts > 1).sum()), max(1, CELLS // n)
    for i in range(0, width, step):
        there = np.zeros((n, min(step, width - i)), dtype=np.float32)
        own = (at >= i) & (at < i + step)
        there[row[own], at[own] - i] = 1
        both += there @ there.T
        sizes += there.sum(1)
    return both, sizes


def _bucket_links(similarity: float):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b): pairs of `similarity` or more of different components, enough to connect those of a bucket. Rows (BAND, c and text) in order of v."""
        for t, _ in _buckets(batches):
            v, ids, of = (t.column(c).to_numpy() for c in ("v", "id", "c"))
            sketch = _words(t)
            hashes, begin = _shingle_hashes(t.column("text").combine_chunks())
            starts = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])).tolist()
            found = []
            for i, j in pairwise([*starts, len(v)]):
                both, sizes = _shared(hashes[begin[i] : begin[j]], begin[i : j + 1] - begin[i])
                c, at = of[i:j], np.arange(i, j)
                like = (c[:, None] > c) & (_between(sketch, at[:, None], at[None]) <= MAY_DIFFER)
                like &= both / (sizes[:, None] + sizes - both) >= similarity
                found += _joining(c, ids[i:j], *np.nonzero(like))
            if found:
                a, b = np.array(found, dtype=np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return links


def _joining(of: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Ids of the pairs (x, y) of entries that join components which the pairs before them don't."""
    up, out = {}, []

    def find(c: int) -> int:
        while (p := up.get(c, c)) != c:
            up[c] = c = up.get(p, p)
        return c

    for k, m in zip(x.tolist(), y.tolist(), strict=True):
        c, d = find(int(of[k])), find(int(of[m]))
        if c != d:
            up[c] = d
            out.append((int(ids[k]), int(ids[m])))
    return out


def _held(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text): the lines whose ids stand in that column of wanted, and maybe others."""
    found = texts.mapInArrow(_line_texts(KeyFilter(wanted.select("id"), "id")), "id bigint, text string")
    return found.dropDuplicates(["id"])


def _linked(texts: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Links of (text) by nearest lines, the stars of their components, and the links of buckets compared in full; see line_links."""
    in_order = lambda rows: rows.repartition("v").sortWithinPartitions("v")
    met = cut(in_order(texts.mapInArrow(_bands, BAND)).mapInArrow(_meet, MET))
    freed(met)
    pairs = cut(met.where("other is not null").select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct())
    crowd = met.where("crowded")
    held = cut(_held(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")).union(crowd.where("near").select("id"))))
    pairs = pairs.join(held.toDF("a", "s_a"), "a").join(held.toDF("b", "s_b"), "b")
    # kept, so that comparing and contracting aren't one stage, which takes two workers a core
    links = cut(pairs.where(_alike("s_a", "s_b", similarity)).select("a", "b"))
    freed(links)
    classes = component_stars(links)
    if crowd.isEmpty():
        return links, classes, None
    of = classes.select(F.col("a").alias("id"), F.col("b").alias("c"))
    seen = crowd.where("not large").select("v", "id", *SKETCH).join(of, "id", "left").withColumn("c", F.coalesce("c", "id"))
    some = cut(in_order(seen.select("v", "id", *SKETCH, "c")).mapInArrow(_still_apart, f"{BAND}, c bigint"))
    more = cut(in_order(some.join(held, "id")).mapInArrow(_bucket_links(similarity), "a bigint, b bigint"))
    large = crowd.where("large")
    if large.isEmpty():
        return links, classes, more

    def texts_of(some: DataFrame) -> DataFrame:
        """Texts of entries of large buckets; those that are near to none of their own block aren't held yet."""
        ids = some.select("id").distinct()
        rest = cut(ids.join(held, "id", "left_anti"))
        here = held.join(ids, "id", "left_semi")
        return here if rest.isEmpty() else here.union(_held(texts, rest).join(rest, "id", "left_semi"))

    dealt = cut(unmet(large.select("v", "id").distinct(), classes, BLOCK))
    sketches = large.groupBy("id").agg(F.array(*map(F.first, SKETCH)).alias("sketch"))
    return links, classes, more.union(full_links(dealt, sketches, texts_of, _sketch_distance, MAY_DIFFER, line_shingles, similarity))


def line_links(texts: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(a, b): ids of lines of (text) whose character shingles have a Jaccard similarity of `similarity` or more.

    Sketches of the lines that share a band tell which are near. Where few pairs are, all are candidates; else each
    line meets the nearest one before it, so a bucket of g like lines gives g candidates, not pairs.
    The lines themselves decide, by 51 bits of a hash of each shingle at least. Near lines of a bucket that these links
    leave in more than one component are then compared in full, so what is like in a bucket is connected.
    """
    links, _, more = _linked(texts, similarity)
    return links if more is None else links.union(more)


def line_classes(texts: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(node, component) of line_links, by the stars of its first links."""
    _, classes, more = _linked(texts, similarity)
    return connected_components(classes if more is None else classes.union(more))


def repeated_lines(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, h, drop array<int>): numbers, from 0, of the lines of documents (doc_id, h, text) that go.

    Of each component of like lines the first occurrence stays: the smallest id (null last), hash, number.
    """
    classes = line_classes(docs.select("text"), similarity)
    numbered = cut(docs.mapInArrow(_numbered, "doc_id bigint, h bigint, lines array<bigint>"))
    seen = numbered.select("doc_id", "h", F.posexplode("lines").alias("at", "line")).where("line is not null")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "at")
    first = seen.groupBy("line").agg(F.min(place).alias("place"), F.count("*").alias("n")).join(classes.withColumnRenamed("node", "line"), "line", "left")
    first = cut(first.where("n > 1 or component is not null").select("line", "place", F.coalesce("component", "line").alias("c")))
    kept = with_group_min(first, "c", "line", F.col("place"), "keep").select("line", "keep")
    gone = seen.join(kept, "line").where(~place.eqNullSafe(F.col("keep")))
    return gone.groupBy("doc_id", "h").agg(F.collect_set("at").alias("drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """docs with only the first of all like lines, and the columns lines_in and lines_removed (long).

    Lines of any length are compared in lower case with blanks collapsed, by their sets of five-character shingles;
    one of under five characters is its only shingle. Blank lines are never removed. Of a tie the first occurrence stays,
    by document and place. Rows that repeat an id and a text are one document: they keep the same lines. Null
    texts stay null, with 0 lines; a text whose lines all go is empty. A very long text is read line by line. Line ids
    are 64-bit hashes. An empty table gives an empty one. Other columns are returned as they came; ids are longs.
    """
    names = docs.columns
    cols = [f"_c{i}" for i in range(len(names))]
    rows = docs.toDF(*cols)
    key, text = F.col(cols[names.index(id_col)]), F.col(cols[names.index(text_col)])
    drops = cut(repeated_lines(rows.select(key.cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")), similarity))
    freed(drops)
    drops = drops.select(F.col("doc_id").alias("_i"), F.col("h").alias("_h"), F.col("drop").alias("_drop"))
    got = rows.join(drops, key.cast("long").eqNullSafe(F.col("_i")) & (F.xxhash64(text) == F.col("_h")), "left")
    parts = F.split(text, "\n")
    # all elements of an array, numbered from 0, less those that go
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(F.col("_drop"), i)), "\n")
    kept = F.when(F.col("_drop").isNull(), text).otherwise(left)
    out = [kept.alias(c) if n == text_col else F.col(c) for c, n in zip(cols, names, strict=True)]
    more = [(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long")]
    more[0] = F.when(text.isNull(), F.lit(0).cast("long")).otherwise(more[0])
    more[1] = F.when(F.col("_drop").isNull(), F.lit(0).cast("long")).otherwise(more[1])
    taken = {"lines_in", "lines_removed"}
    return got.select(*out, more[0].alias("_in"), more[1].alias("_removed")).toDF(*[f"{n}_in" if n in taken else n for n in names], "lines_in", "lines_removed")


def keep_new_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """docs with repeated lines removed, less the rows whose every line that isn't blank has gone. Columns as they came."""
    got = dedup_lines(docs, id_col, text_col, similarity)
    text = F.col(f"_c{docs.columns.index(text_col)}")
    cols = [f"_c{i}" for i in range(len(docs.columns))]
    rows = got.toDF(*cols, "_in", "_removed").where((F.col("_removed") == 0) | (F.trim(F.regexp_replace(text, r"\s+", " ")) != ""))
    return rows.select(*cols).toDF(*docs.columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the first of all like lines only."""
    got = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "text", "lines_in", "lines_removed")
