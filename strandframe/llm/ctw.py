"""Language-model scoring by context-tree weighting over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold, table, utf8

#: Bytes of context. A context and its symbol are one gram of 48 bits, which leaves 16 for a text's place in a block.
DEPTH = 5
#: Depths below this are weighed by one table, of 1 + 256 contexts at most.
TOP = 2
BLOCK_BYTES, BLOCK_TEXTS = 2_500_000, 1 << 16
#: Keys whose counts a task holds before it hands them on.
HELD = 1_500_000
#: Grams, and words, whose values all tasks get; the others are joined.
COMMON = 1 << 20
LN10 = float(np.log(10.0))
WORD, GRAM = 0, 1
END = b"\n"


def word_key(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


class _Keys(dict):
    """Word keys seen in a block, numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Block:
    """Texts of a few MB: their sorted (gram, text) and (word, text) pairs."""

    def __init__(self) -> None:
        self.texts: list[tuple[int, bytes, bytes]] = []  # place, context, bytes
        self.words: list[np.ndarray] = []
        self.keys = _Keys()
        self.size = 0

    def pairs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, keys, place of the text, n): sorted by key, unsigned grams or numbers of self.keys."""
        joined = np.frombuffer(b"".join(c + b for _, c, b in self.texts), dtype=np.uint8).astype(np.uint64)
        sizes = np.array([len(b) for _, _, b in self.texts])
        k = joined[: len(joined) - DEPTH].copy()
        for j in range(1, DEPTH + 1):
            k <<= np.uint64(8)
            k |= joined[j : len(joined) - DEPTH + j]
        own = np.ones(len(k), dtype=bool)  # what ends in a context isn't a symbol of the text
        for at in np.cumsum(sizes + DEPTH)[:-1]:
            own[at - DEPTH : at] = False
        k = k[own]
        k <<= np.uint64(16)
        k |= np.repeat(np.array([p for p, _, _ in self.texts], dtype=np.uint64), sizes)
        yield (GRAM, *self._runs(k))
        if self.words:
            yield (WORD, *self._runs(np.concatenate(self.words)))

    @staticmethod
    def _runs(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k.sort()
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
        one = k[at]
        return one >> np.uint64(16), (one & np.uint64(0xFFFF)).astype(np.int64), np.diff(np.append(at, len(k)))

    def word_keys(self) -> np.ndarray:
        return np.array([word_key(w) for w in self.keys], dtype=np.int64)


def blocks(texts: Iterator[bytes | None]) -> Iterator[tuple[int, Block]]:
    """(number of texts that ended, block); a text larger than a block goes on in the next, with its context.

    A text is its lower-cased words, joined by blanks, and an end, after a context of ends.
    """
    block, ended = Block(), 0
    for text in texts:
        words = text.lower().split() if text else []
        line = b" ".join(words) + END
        place = np.uint64(ended)
        codes = np.fromiter((block.keys[w] for w in words), dtype=np.uint64, count=len(words))
        codes = np.append(codes, np.uint64(block.keys[END]))
        block.words.append((codes << np.uint64(16)) | place)
        context = END * DEPTH
        for at in range(0, len(line), BLOCK_BYTES):
            if at:
                yield ended, block
                block, ended, place = Block(), 0, np.uint64(0)
            part = line[at : at + BLOCK_BYTES]
            block.texts.append((int(place), context, part))
            block.size += len(part)
            context = line[max(0, at + BLOCK_BYTES - DEPTH) : at + BLOCK_BYTES]
        ended += 1
        if block.size >= BLOCK_BYTES or ended == BLOCK_TEXTS:
            yield ended, block
            block, ended = Block(), 0
    if block.texts:
        yield ended, block


class _Counts:
    """Keys with their counts in texts to learn from and in all, summed now and then."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, n: np.ndarray, own: bool) -> None:
        self.parts.append((keys, n if own else np.zeros_like(n), n))
        self.size += len(keys)

    def merge(self) -> int:
        keys = np.concatenate([p[0] for p in self.parts])
        order = np.argsort(keys)
        keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = [np.add.reduceat(np.concatenate([p[i] for p in self.parts])[order], at) for i in (1, 2)]
        self.parts = [(keys[at], *sums)]
        self.size = len(at)
        return self.size

    def leave(self, kind: int) -> pa.RecordBatch:
        self.merge()
        keys, n, n_all = self.parts[0]
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n), pa.array(n_all)], ["kind", "key", "n", "n_all"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n, n_all) of (text, learn): counts in texts to learn from, and in all; some are summed before they leave."""
    counts = {WORD: _Counts(), GRAM: _Counts()}
    for batch in batches:
        learn = batch.column("learn").to_numpy(zero_copy_only=False)
        for own, texts in ((True, batch.column("text").filter(pa.array(learn))), (False, batch.column("text").filter(pa.array(~learn)))):
            for _, block in blocks(utf8(texts)):
                for kind, keys, _, n in block.pairs():
                    keys = block.word_keys()[keys.astype(np.int64)] if kind == WORD else keys.astype(np.int64)
                    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
                    counts[kind].add(keys[at], np.add.reduceat(n.astype(np.int64), at) if len(at) else n.astype(np.int64), own)
                    if counts[kind].size > HELD and counts[kind].merge() > HELD * 2 // 3:
                        yield counts[kind].leave(kind)
    for kind, held in counts.items():
        if held.size:
            yield held.leave(kind)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x of 0.5 or more: Stirling's series after a shift by 8."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8
    inv = 1 / y
    series = inv * (1 / 12 - inv * inv * (1 / 360 - inv * inv * (1 / 1260 - inv * inv / 1680)))
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    half = 0.5723649429247001  # ln Gamma(1/2)
    return _lgamma(n0 + 0.5) + _lgamma(n1 + 0.5) - 2 * half - _lgamma(n0 + n1 + 1.0)


def _weigh(kt: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(kt, children) - np.log(2)


class Level(NamedTuple):
    """Bit nodes of one depth: sorted keys (context << 8 | bits so far, after a leading 1), counts, KT and weighted ln probabilities."""

    keys: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    kt: np.ndarray
    weighted: np.ndarray


def _paths(grams: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the 8 bits of a gram's symbol: the node's key at this depth, and the bit."""
    context = (grams >> 8) & ((1 << 8 * depth) - 1)
    symbol = grams & 0xFF
    for b in range(8):
        yield context << 8 | (1 << b) | (symbol >> (8 - b)), symbol >> (7 - b) & 1


def levels(grams: np.ndarray, n: np.ndarray, least: int) -> dict[int, Level]:
    """The levels from DEPTH up to `least` for grams with their counts; grams that count 0 make no node."""
    grams, n = grams[n > 0], n[n > 0].astype(np.float64)
    out: dict[int, Level] = {}
    below: Level | None = None
    for depth in range(DEPTH, least - 1, -1):
        steps = list(_paths(grams, depth))
        keys, place = np.unique(np.concatenate([k for k, _ in steps]), return_inverse=True)
        bits = np.concatenate([b for _, b in steps])
        # of nothing, bincount gives whole numbers
        n1 = np.bincount(place, weights=np.tile(n, 8) * bits, minlength=len(keys)).astype(float)
        n0 = np.bincount(place, weights=np.tile(n, 8) * (1 - bits), minlength=len(keys)).astype(float)
        kt = log_kt(n0, n1)
        if below is None:
            weighted = kt
        else:
            up = np.searchsorted(keys, (below.keys >> 8 & ((1 << 8 * depth) - 1)) << 8 | below.keys & 0xFF)
            weighted = _weigh(kt, np.bincount(up, weights=below.weighted, minlength=len(keys)))
        below = out[depth] = Level(keys, n0, n1, kt, weighted)
    return out


def _mix(level: Level, keys: np.ndarray, bits: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
    """Probability of each bit: the KT estimate of this depth, mixed with that of the deeper ones by their posterior weights."""
    if len(level.keys):
        at = np.minimum(np.searchsorted(level.keys, keys), len(level.keys) - 1)
        seen = level.keys[at] == keys
    else:
        at, seen = np.zeros(len(keys), int), np.zeros(len(keys), bool)
    pick = lambda x: np.where(seen, x[at], 0.0) if len(x) else np.zeros(len(keys))
    n0, n1 = pick(level.n0), pick(level.n1)
    own = (np.where(bits == 1, n1, n0) + 0.5) / (n0 + n1 + 1)
    if deeper is None:
        return own
    w = np.exp(pick(level.kt) - pick(level.weighted)) / 2
    return w * own + (1 - w) * deeper


def gram_scores(grams: np.ndarray, n: np.ndarray, top: dict[int, Level]) -> np.ndarray:
    """log10 of the probability of each gram's symbol in its context: all 8 bits, all depths mixed."""
    own = levels(grams, n, TOP) | top
    p: list[np.ndarray | None] = [None] * 8
    for depth in range(DEPTH, -1, -1):
        p = [_mix(own[depth], k, b, x) for (k, b), x in zip(_paths(grams, depth), p, strict=True)]
    return sum(np.log10(x) for x in p)


def top_levels(counts: DataFrame) -> dict[int, Level]:
    """Depths 1 and 0, from the nodes of depth TOP: at most 256 x 255 rows come to the driver."""

    def up(group: pa.Table) -> pa.Table:
        level = levels(group.column("key").to_numpy(), group.column("n").to_numpy(), TOP)[TOP]
        return pa.table({"node": level.keys & 0xFFFF, "n0": level.n0, "n1": level.n1, "w": level.weighted})

    rows = counts.groupBy("suffix").applyInArrow(up, "node bigint, n0 double, n1 double, w double")
    rows = rows.groupBy("node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("w").alias("w")).sort("node").collect()
    keys, n0, n1, below = (np.array([r[i] for r in rows], dtype=t) for i, t in enumerate((np.int64, float, float, float)))
    kt = log_kt(n0, n1)
    first = Level(keys, n0, n1, kt, _weigh(kt, below))
    nodes, up_to = np.unique(keys & 0xFF, return_inverse=True)
    m0, m1, w = (np.bincount(up_to, weights=x, minlength=len(nodes)) for x in (first.n0, first.n1, first.weighted))
    kt = log_kt(m0, m1)
    return {1: first, 0: Level(nodes, m0, m1, kt, _weigh(kt, w))}


class Common(NamedTuple):
    """Sorted keys that all tasks know, and their values."""

    words: np.ndarray
    word_values: np.ndarray
    word_known: np.ndarray
    grams: np.ndarray
    gram_values: np.ndarray


def _score(batches: Iterator[pa.RecordBatch], common: Common) -> Iterator[pa.RecordBatch]:
    """(rid, kind, key, n, score, base, known, tokens): for each text what its common grams and words give, under a key
    that no table has; and a row for each other gram and word of it."""
    names = ["rid", "kind", "key", "n", "score", "base", "known", "tokens"]
    for batch in batches:
        rids = batch.column("rid").to_numpy()
        first = 0
        for ended, block in blocks(utf8(batch.column("text"))):
            texts = max(ended, 1 + max(p for p, _, _ in block.texts))
            own = rids[first : first + texts]
            first += ended
            score, base, known, tokens = (np.zeros(texts) for _ in range(4))
            rest = []
            for kind, keys, place, n in block.pairs():
                if kind == WORD:
                    keys = block.word_keys()[keys.astype(np.int64)]
                    table_keys = common.words
                    tokens += np.bincount(place, weights=n, minlength=texts)
                else:
                    keys, table_keys = keys.astype(np.int64), common.grams
                at = np.minimum(np.searchsorted(table_keys, keys), max(0, len(table_keys) - 1))
                there = table_keys[at] == keys if len(table_keys) else np.zeros(len(keys), bool)
                if there.any():
                    where, times, at = place[there], n[there], at[there]
                    if kind == WORD:
                        base += np.bincount(where, weights=times * common.word_values[at], minlength=texts)
                        known += np.bincount(where, weights=times * common.word_known[at], minlength=texts)
                    else:
                        score += np.bincount(where, weights=times * common.gram_values[at], minlength=texts)
                other = ~there
                rest.append((np.full(int(other.sum()), kind, np.int32), keys[other], own[place[other]], n[other].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own, np.full(texts, -1, np.int32), own, np.zeros(texts, np.int64), score, base, known.astype(np.int64), tokens.astype(np.int64))], names)
            for kinds, keys, who, n in rest:
                zero = np.zeros(len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (who, kinds, keys, n, zero, zero, zero.astype(np.int64), zero.astype(np.int64))], names)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte), a row for each row of docs.

    Held out, and not learned from, where crc32(doc_id) mod 7 is 2; null ids count as the empty text
    there. Null texts are empty: one token, the end. score: log10 of the probability that the model
    gives the words, joined by blanks, and the end. The model is a context-tree weighting of the bytes
    (A-Z lower-cased): each byte is eight binary decisions, each with a tree of the byte contexts of
    depths 0 to 5; Krichevsky-Trofimov estimates of all depths are mixed with weights 1/2. Counts are
    of all texts learned from; they are then fixed. base_score: the sum over the tokens of
    log10((c + 1) / (N + V + 1)). Words are known by 64-bit hashes. The `common` most frequent grams
    and words go to all tasks; the others' values are joined to the texts that ask for them. Rows that repeat an id
    or a text are scored each, and learned from each. A very long text goes through in blocks, whole. An empty table
    gives an empty one. Other columns aren't looked at; ids are longs.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (fold(F.col(id_col), 7) == 2).alias("held_out"))
    counts = rows.select("text", (~F.col("held_out")).alias("learn")).mapInArrow(_count, "kind int, key bigint, n bigint, n_all bigint")
    counts = cut(counts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all")))
    sums = counts.where(F.col("kind") == WORD).agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    total, distinct = sums.n or 0, sums.v or 0
    grams = counts.where(F.col("kind") == GRAM).select("key", "n", "n_all", F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF)).alias("suffix"))
    top = top_levels(grams)

    def scores(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy()
        return pa.table({"key": keys, "n_all": group.column("n_all").to_numpy(), "value": gram_scores(keys, group.column("n").to_numpy(), top)})

    gram_values = grams.groupBy("suffix").applyInArrow(scores, "key bigint, n_all bigint, value double")
    gram_values = gram_values.select(F.lit(GRAM).alias("kind"), "key", "n_all", "value", F.lit(0).alias("is_known"))
    base = F.log10((F.col("n") + 1) / F.lit(float(total + distinct + 1)))
    word_values = counts.where(F.col("kind") == WORD).select("kind", "key", "n_all", base.alias("value"), (F.col("n") > 0).cast("int").alias("is_known"))
    values = cut(gram_values.union(word_values))
    known = [_most(values.where(F.col("kind") == kind), common) for kind in (WORD, GRAM)]
    shared = Common(known[0][0], known[0][1], known[0][2], known[1][0], known[1][1])
    handed = docs.sparkSession.sparkContext.broadcast(shared)
    asked = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text")
    return _assemble(asked, values, handed, total)


def _most(values: DataFrame, common: int) -> tuple[np.ndarray, ...]:
    """The keys, in order, with their values, of those that occur most often: at most `common` of them."""
    least = 0
    if values.count() > common:
        # the least count that no more than `common` keys reach: the class of counts of so many bits, of which at most 64 rows come here, then by halves
        by = {r.b: r.n for r in values.groupBy(F.length(F.bin("n_all")).alias("b")).agg(F.count("*").alias("n")).collect()}
        room, b = common, max(by)
        while by.get(b, 0) <= room:
            room, b = room - by.get(b, 0), b - 1
        end = 1 << b
        least, most = end // 2, end
        while least < most:
            middle = (least + most) // 2
            if values.where((F.col("n_all") >= middle) & (F.col("n_all") < end)).count() <= room:
                most = middle
            else:
                least = middle + 1
    got = values.where(F.col("n_all") >= least).select("key", "value", "is_known").toArrow()
    keys, value, known = (got.column(c).to_numpy() for c in ("key", "value", "is_known"))
    order = np.argsort(keys)
    return keys[order], value[order], known[order]


def _assemble(asked: DataFrame, values: DataFrame, handed, total: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the texts give, and a row for each text with its id."""
        names = ["rid", "kind", "key", "n", "score", "base", "known", "tokens", "doc_id", "held_out", "n_bytes"]
        for batch in batches:
            m = batch.num_rows
            zero, longs = pa.array(np.zeros(m)), pa.array(np.zeros(m, np.int64))
            sizes = pa.array([len(b" ".join(t.split())) + 1 if t else 1 for t in utf8(batch.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(np.full(m, -1, np.int32)), batch.column("rid"), longs, zero, zero, longs, longs, batch.column("doc_id"), batch.column("held_out"), sizes], names)
            for got in _score(iter([batch]), handed.value):
                none = [pa.nulls(got.num_rows, t) for t in (pa.int64(), pa.bool_(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*got.columns, *none], names)

    asked = asked.withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "rid bigint, kind int, key bigint, n bigint, score double, base double, known bigint, tokens bigint, doc_id bigint, held_out boolean, n_bytes bigint"
    parts = asked.mapInArrow(run, schema)
    value = values.select(F.col("kind").alias("k"), F.col("key").alias("y"), "value", "is_known")
    joined = parts.join(value, (F.col("kind") == F.col("k")) & (F.col("key") == F.col("y")), "left")
    of = lambda kind, x: F.when(F.col("kind") == kind, x).otherwise(0)
    got = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"),
        F.sum("tokens").alias("n_tokens"),
        F.sum(F.col("known") + of(WORD, F.col("n") * F.col("is_known"))).cast("long").alias("n_known"),
        F.sum(F.col("base") + of(WORD, F.col("n") * F.col("value"))).alias("base_score"),
        F.sum(F.col("score") + of(GRAM, F.col("n") * F.col("value"))).alias("score"),
        F.max("n_bytes").alias("n_bytes"),
    )
    bits = -F.col("score") * F.lit(float(np.log2(10.0))) / F.col("n_bytes")
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", bits.alias("bits_per_byte"))


def op1_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability by the model learned from those that aren't held out."""
    return score_texts(table(spark, sf_dir, "documents"))
