"""Benchmark decontamination: pigeonhole pieces found exactly, then verified by Myers' bit-parallel distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8

_NOISE = re.compile(r"[\W_]+")


def normalise(text: str) -> str:
    """Lower case; runs of anything but letters and digits become one blank."""
    return _NOISE.sub(" ", text.lower()).strip()


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the nearest match of the pattern anywhere in the text, None above `most` errors. The first end of several."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = None
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        x = eq | minus
        d0 = (((x & plus) + plus) ^ plus) | x
        up = minus | ~(d0 | plus) & full
        down = plus & d0
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1
        plus = ((down << 1) | ~(d0 | up)) & full
        minus = up & d0 & full
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Items:
    """Pieces of test items in an automaton.

    An item of n characters may have floor(rate * n) errors; it is cut into one piece more than that,
    so one piece of a match is intact. A tree over the pieces verifies: a node of p pieces must match
    with p - 1 errors or fewer, for some path from an intact piece to the whole item that holds.
    Items of under `least` characters have no errors: they are found where their words stand in a row. An item of
    a single word that short is in too many texts by chance, and is found where a whole line is the item.
    """

    def __init__(self, items: list[tuple[object, str]], rate: float, least: int) -> None:
        self.texts: list[tuple[object, str, int]] = []
        self.short: dict[str, list[int]] = {}
        rows: dict[str, list[int]] = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for key, raw in items:
            text = normalise(raw)
            if len(text) < least:
                if text:
                    (rows if " " in text else self.short).setdefault(text, []).append(len(self.texts))
                    self.texts.append((key, text, 0))
                continue
            errors = int(rate * len(text))
            for p in range(errors + 1):
                start, end = self.span(len(text), errors + 1, p, p + 1)
                pieces.setdefault(text[start:end], []).append((len(self.texts), p))
            self.texts.append((key, text, errors))
        self.automaton = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.automaton.add_word(piece, (len(piece), at))
        if pieces:
            self.automaton.make_automaton()
        self.rows = ahocorasick.Automaton()
        for words, at in rows.items():
            self.rows.add_word(f" {words} ", (len(words), at))
        if rows:
            self.rows.make_automaton()

    @staticmethod
    def span(n: int, parts: int, first: int, end: int) -> tuple[int, int]:
        return n * first // parts, n * end // parts

    def match(self, item: int, piece: int, start: int, text: str) -> tuple[int, int] | None:
        """(distance, end) if the item matches around an intact piece at `start` of the text."""
        _, pattern, errors = self.texts[item]
        n, parts = len(pattern), errors + 1
        low, high, size = piece, piece + 1, 1
        offset = self.span(n, parts, piece, piece + 1)[0]
        got = (0, start + self.span(n, parts, piece, piece + 1)[1] - offset)
        while (low, high) != (0, parts):
            size *= 2
            low, high = piece // size * size, min(parts, piece // size * size + size)
            a, b = self.span(n, parts, low, high)
            most = high - low - 1
            begin = max(0, start - (offset - a) - most)
            near = myers(pattern[a:b], text[begin : start + (b - offset) + most], most)
            if near is None:
                return None
            got = (near[0], begin + near[1])
        return got

    def search(self, raw: str) -> Iterator[tuple[object, int, int]]:
        """(key, distance, end) of the nearest match of each item that is in the text."""
        text = normalise(raw)
        best: dict[int, tuple[int, int]] = {}
        seen: set[tuple[int, int]] = set()
        if self.short:
            done = 0
            for line in raw.split("\n"):
                line = normalise(line)
                done += len(line) + bool(line and done)
                for item in self.short.get(line, ()):
                    best.setdefault(item, (0, done))
        for last, (_, at) in self.rows.iter(f" {text} ") if len(self.rows) else ():
            for item in at:
                best.setdefault(item, (0, last - 1))
        for last, (length, at) in self.automaton.iter(text) if len(self.automaton) else ():
            start = last + 1 - length
            for item, piece in at:
                if best.get(item, (1, 0))[0] == 0:
                    continue
                # where the item would start: all pieces that agree in it verify the same window
                place = (item, start - self.span(len(self.texts[item][1]), self.texts[item][2] + 1, piece, piece + 1)[0])
                if place in seen:
                    continue
                got = self.match(item, piece, start, text)
                if got:
                    seen.add(place)
                    if item not in best or got < best[item]:
                        best[item] = got
        for item, (distance, end) in sorted(best.items()):
            yield self.texts[item][0], distance, end


_built: dict[tuple, Items] = {}


def _items(key: tuple, items: list, rate: float, least: int) -> Items:
    """Built once in a worker for each block of items."""
    if key not in _built:
        _built.clear()
        _built[key] = Items(items, rate, least)
    return _built[key]


def find_items(text: Column | str, items: list[tuple[object, str]], rate: float = 0.1, least: int = 16) -> Column:
    """array<struct<item_id, distance, end>> for each text: the items found in it, end in the normalised text."""
    key = (hash(tuple(items)), rate, least)

    @F.arrow_udf("array<struct<item_id: bigint, distance: int, end: int>>")
    def find(texts: pa.Array) -> pa.Array:
        known = _items(key, items, rate, least)
        rows = [[{"item_id": k, "distance": d, "end": e} for k, d, e in known.search(t.decode())] if t else [] for t in utf8(texts)]
        return pa.array(rows, pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())])))

    return find(text)


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", chars: int = 4_000_000) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about `chars` characters, which a task can hold; null texts are left out.

    A larger test set is more blocks, each a search of all documents. Items equal in id and text come once.
    """
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    n = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // chars))
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).sort("item_id", "text").collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.1, least: int = 16, chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, distance, end): a row for each row of docs and item found in it.

    Texts and items are compared in lower case without punctuation. An item is found where some part
    of the text is within rate x its length edits; distance is the least, end where its first such
    match ends in the normalised text. Items of under `least` normalised characters are found without edits where
    their words stand in a row, those of one word where a whole line of the text is the item, and those without a
    letter or digit nowhere. Null and empty texts hold no item; repeated
    rows give repeated results; an empty table on either side gives an empty result. Of equal matches the first
    counts. A very long text is searched whole, in one go, by the automaton. Other columns aren't looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for items in item_blocks(benchmark, chars=chars):
        part = rows.select("doc_id", find_items(F.col("text"), items, rate, least).alias("m")).select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.item_id", "m.distance", "m.end")
        found = part if found is None else found.union(part)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", rate: float = 0.1, least: int = 16, chars: int = 4_000_000) -> DataFrame:
    """docs without the rows in which an item is found (see contamination). Columns are returned as they came, whatever their names."""
    names = docs.columns
    rows = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at = F.col(f"_c{names.index(text_col)}")
    for items in item_blocks(benchmark, chars=chars):
        rows = rows.where(F.size(find_items(at, items, rate, least)) == 0)
    return rows.toDF(*names)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, over all documents and items."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
