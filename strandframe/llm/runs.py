"""Periodic runs of words, by the runs theorem.

Each run of a text has a Lyndon root under one of two orders of its words, the other being the first
turned round, and the longest Lyndon word that begins at a place ends before the next smaller suffix. So
next smaller values of the two inverse suffix arrays give at most two roots for each word; how far a root
repeats to the right and to the left is told by the longest common prefixes of two suffixes, that is, by a
range minimum over the LCP array, of the text and of the text turned round.

Texts are taken many at a time: their words are numbered and the texts stand behind one another, each
with words of its own and an end that is less than all its words, so suffixes of different texts part at
their first word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words that are taken at a time; a longer text is taken alone.
WORDS_AT_ONCE = 1 << 17
#: A run has four periods or more, and six words or more.
LEAST_PERIODS, LEAST_WORDS = 4, 6


def suffix_ranks(letters: np.ndarray) -> np.ndarray:
    """The rank of each suffix. letters: from 0 on; suffixes part before the end of the array (each text ends with a letter that is there once).

    Ranks by the first h letters become ranks by 2h; suffixes that no other equals are left out of the following rounds.
    """
    n = len(letters)
    order = np.argsort(letters, kind="stable")
    new = np.concatenate([[True], letters[order][1:] != letters[order][:-1]]) if n else np.zeros(0, bool)
    first = np.flatnonzero(new)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    size = np.diff(np.append(first, n))
    left = order[np.repeat(size > 1, size)]  # in groups of equal ranks, in order
    h = 1
    while len(left):
        key = rank[left] * n + rank[left + h]
        turn = np.argsort(key, kind="stable")
        left, key = left[turn], key[turn]
        old = rank[left]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(starts, len(left)))
        # a group keeps its first rank; what follows in it is counted from there
        group = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        base = np.repeat(old[group] - group, np.diff(np.append(group, len(left))))
        rank[left] = base + np.repeat(starts, size)
        left = left[np.repeat(size > 1, size)]
        h *= 2
    return rank


def next_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the next one with a smaller value, or the length: a few steps, then jumps over minima of 2^k values."""
    n = len(values)
    out = np.full(n, n, dtype=np.int64)
    left = np.arange(n)
    for step in range(1, 5):
        at = left + step
        inside = at < n
        less = np.zeros(len(left), dtype=bool)
        less[inside] = values[at[inside]] < values[left[inside]]
        out[left[less]] = at[less]
        left = left[inside & ~less]
    if not len(left):
        return out
    levels = [values]
    while 2 << (len(levels) - 1) <= n:
        low, half = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(low[:-half], low[half:]))
    # longer and longer jumps over values that aren't smaller, then, from where one would be too long, shorter ones
    at = left + 5
    going, stopped = np.arange(len(left)), []
    for k, low in enumerate(levels):
        over = at[going] < len(low)
        over[over] = low[at[going[over]]] > values[left[going[over]]]
        stopped.append(going[~over])
        going = going[over]
        at[going] += 1 << k
    for k in range(len(levels) - 1, -1, -1):
        low = levels[k]
        over = at[going] < len(low)
        over[over] = low[at[going[over]]] > values[left[going[over]]]
        at[going[over]] += 1 << k
        going = np.concatenate([going, stopped[k]])
    out[left] = at
    return out


def lcp_array(letters: np.ndarray, rank: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Common letters of each suffix with the one of the rank before: from one place to the next they fall by one at most."""
    text, place, suffixes = letters.tolist(), rank.tolist(), sa.tolist()
    out, h, n = [0] * len(text), 0, len(text)
    for i, r in enumerate(place):
        if not r:
            h = 0
            continue
        j = suffixes[r - 1]
        while i + h < n and j + h < n and text[i + h] == text[j + h]:
            h += 1
        out[r] = h
        if h:
            h -= 1
    return np.array(out, dtype=np.int32)


class Extension:
    """Common prefixes of any two suffixes: least values of the LCP array between their ranks, by minima of 2^k values."""

    def __init__(self, letters: np.ndarray, rank: np.ndarray | None = None) -> None:
        self.rank = suffix_ranks(letters) if rank is None else rank
        sa = np.empty(len(letters), dtype=np.int64)
        sa[self.rank] = np.arange(len(letters))
        self.levels = [lcp_array(letters, self.rank, sa)]
        while 2 << (len(self.levels) - 1) <= len(letters):
            low, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For different places a and b."""
        lo, hi = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b])
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.empty(len(lo), dtype=np.int64)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            low = self.levels[level]
            out[at] = np.minimum(low[lo[at]], low[hi[at] - (1 << int(level)) + 1])
        return out


def find_runs(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of LEAST_PERIODS periods and LEAST_WORDS words or more, by text, start and period.

    texts: the words of each as numbers from 0 on, equal for equal words only.

    A run of four periods has a root that begins in its first period, so the root and the text behind it
    share two periods and a word, and five words at least: other roots aren't followed further.
    """
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = int(sizes.sum())
    text = np.repeat(np.arange(len(texts)), sizes)
    words = np.full(n, -1, dtype=np.int64)
    for t, at in zip(texts, starts.tolist(), strict=True):
        words[at : at + len(t)] = t
    span = int(words.max(initial=-1)) + 2
    base = text * span
    up = base + words + 1  # the end of a text is less than its words in both orders
    down = np.where(words < 0, base, base + span - 1 - words)
    ranks = suffix_ranks(up)
    found = []
    for rank in (ranks, suffix_ranks(down)):
        i = np.arange(n)
        p = next_smaller(rank.astype(np.int32) if n < 1 << 31 else rank) - i
        # cheap before the range minima: five equal words
        i, p = i[words >= 0], p[words >= 0]
        for k in range(LEAST_WORDS - 1):
            there = i + p + k < n
            i, p = i[there], p[there]
            same = (up[i + k] == up[i + p + k]) & (words[i + k] >= 0)
            i, p = i[same], p[same]
        found.append((i, p))
    i, p = (np.concatenate([f[k] for f in found]) for k in range(2))
    none = np.zeros(0, dtype=np.int64)
    if not len(i):
        return none, none, none, none
    # what follows looks only at the texts with such roots
    some = np.unique(text[i])
    kept = np.isin(text, some)
    place = np.cumsum(kept) - 1
    letters = up[kept]
    rank = np.argsort(np.argsort(ranks[kept], kind="stable"), kind="stable")
    i = place[i]
    right = Extension(letters, rank)(i, i + p)
    good = right >= np.maximum(LEAST_WORDS - 1, 2 * p + 1)
    i, p, right = i[good], p[good], right[good]
    # turned round, each text has its end behind it again
    back = np.flatnonzero(kept)
    n_kept = len(back)
    turned = _turned(letters, text[back])
    mirror = np.empty(n_kept, dtype=np.int64)
    mirror[turned] = np.arange(n_kept)
    at_start = place[starts[text[back[i]]]] == i
    left = np.zeros(len(i), dtype=np.int64)
    inner = np.flatnonzero(~at_start)
    if len(inner):
        left[inner] = Extension(letters[turned])(mirror[i[inner] - 1], mirror[i[inner] + p[inner] - 1])
    begin, length = i - left, right + p + left
    long = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
    rows = np.unique(np.stack([begin[long], p[long], length[long]], axis=1), axis=0)
    begin, p, length = rows[:, 0], rows[:, 1], rows[:, 2]
    which = text[back[begin]]
    return which, back[begin] - starts[which], length, p


def _turned(letters: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Places of the letters with the words of each text turned round and its end left at its end."""
    n = len(letters)
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    size = np.diff(np.append(first, n))
    at = np.repeat(first, size)
    last = np.repeat(first + size - 1, size)
    i = np.arange(n)
    return np.where(i == last, i, at + last - 1 - i)


def numbered(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The words of each text as numbers."""
    numbers: dict[bytes, int] = {}
    for words in texts:
        numbers |= dict.fromkeys(words, 0)
    numbers = dict(zip(numbers, range(len(numbers)), strict=True))
    return [np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)) for words in texts]


def _batches(rows: Iterator[tuple], most: int) -> Iterator[list]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[1]) + 1
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def _digest(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    """n_runs, the longest run, and the hashes of all runs and of the words that no run has after its first period."""
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    best = (None,) * 4
    if len(start):
        k = int(np.lexsort((period, start, -length))[0])
        best = (int(start[k]), int(length[k]), int(period[k]), 1000 * int(length[k]) // int(period[k]))
        turns = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(turns, start + period, 1)
        np.add.at(turns, start + length, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(turns[:-1]) == 0).tolist()]
    collapsed = hashlib.sha256(b" ".join(words)).hexdigest()
    return len(start), *best, hashlib.sha256(lines.encode()).hexdigest(), collapsed, b" ".join(words)


RUNS_SCHEMA = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
DIGEST_SCHEMA = "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def _over_texts(docs: DataFrame, key: str, text: str, edit: Callable[[list[bytes], int | None], list[bytes]] | None, digest: bool) -> DataFrame:
    """A row for each row, made in one pass where the texts are, without a shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), common.utf8(batch.column(1)), strict=True):
                words = (data or b"").split()  # at ASCII blanks, as the contracts' words
                yield k, edit(words, k) if edit else words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _batches(read(batches), WORDS_AT_ONCE):
            which, start, length, period = find_runs(numbered([words for _, words in held]))
            edges = np.searchsorted(which, np.arange(len(held) + 1))
            rows = []
            for d, (k, words) in enumerate(held):
                s, n, p = (x[edges[d] : edges[d + 1]] for x in (start, length, period))
                got = _digest(words, s, n, p)
                rows.append((k, *got[:7]) if digest else (k, [{"start": a, "length": b, "period": c} for a, b, c in zip(s.tolist(), n.tolist(), p.tolist(), strict=True)], got[7].decode()))
            cols = [list(c) for c in zip(*rows, strict=True)]
            if digest:
                kinds = [*[pa.int64()] * 5, pa.string(), pa.string()]
            else:
                kinds = [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], keyed), *[pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True)]], [key, *names])

    from pyspark.sql.pandas.types import to_arrow_type

    keyed = to_arrow_type(docs.schema[key].dataType)
    schema = DIGEST_SCHEMA if digest else RUNS_SCHEMA
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"] if digest else ["runs", "collapsed"]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {schema}")


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs, collapsed) of each row: its runs by start and period, and its words without those that repeat a run's first period.

    Null and blank texts have no run and collapse to the empty text. Repeated rows and keys give a row each;
    other columns don't matter and aren't returned. A text's words and some 100 bytes for each are held at once.
    """
    return _over_texts(docs, key, text, None, False)


def planted(words: list[bytes], key: int | None) -> list[bytes]:
    """The words of the contract: where ten divides crc32 of the key's decimal text, those from a place on repeat a period of their own. A null key is the empty text."""
    h = zlib.crc32(b"" if key is None else str(key).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256 and collapsed_sha256 of each document."""
    return _over_texts(common.table(spark, sf_dir, "documents"), "doc_id", "text", planted, True)
