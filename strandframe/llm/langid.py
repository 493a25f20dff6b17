"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table, utf8

DIMENSIONS = 1024
UNKNOWN = "und"
#: Documents whose vectors are made at once.
DOCS = 128
#: Grams whose vectors are held as one array.
TOGETHER = 2048
#: Entries of a matrix of counts.
COUNTS = 1 << 21


@cache
def _letters() -> np.ndarray:
    """Lower-case letter of each code point, 0 where it is no letter."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    out[0x20000:0x32000] = np.arange(0x20000, 0x32000)  # ideographs
    return out


@cache
def _letter_vector(letter: int, dimensions: int) -> np.ndarray:
    """The random vector of +1 and -1 of a letter; 0 is the gap between words."""
    return np.where(np.random.default_rng([29, letter]).integers(0, 2, dimensions) > 0, 1, -1).astype(np.int8)


def gram_vectors(grams: np.ndarray, dimensions: int) -> np.ndarray:
    """A row for each gram: its letters' vectors, permuted by their place, bound by multiplication."""
    letters, at = np.unique(np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF]), return_inverse=True)
    at = at.reshape(3, -1)
    v = np.array([_letter_vector(x, dimensions) for x in letters.tolist()], dtype=np.int8).reshape(-1, dimensions)
    return (np.roll(v, 2, axis=1)[at[0]] * np.roll(v, 1, axis=1)[at[1]] * v[at[2]]).astype(np.float32)


def letter_grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, gram, gram keys) of all letter trigrams: gram is an index into the keys, which hold 21 bits a letter.

    Runs of other characters are one gap; a text stands between gaps. Texts without a letter have no grams.
    """
    points = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype="<u4") if t else np.zeros(0, "<u4") for t in texts]
    ends = np.cumsum([len(p) + 2 for p in points])
    flat = np.zeros(ends[-1] if len(ends) else 0, dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(p) + 2 for p in points])
    letters = _letters()
    for end, p in zip(ends.tolist(), points, strict=True):
        flat[end - len(p) - 1 : end - 1] = letters[p]
    if not len(flat):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64)
    keep = np.ones(len(flat), dtype=bool)
    keep[1:] = (flat[1:] != 0) | (flat[:-1] != 0) | (doc[1:] != doc[:-1])
    flat, doc = flat[keep], doc[keep]
    symbols, code = np.unique(flat, return_inverse=True) if len(flat) < 1000 else _codes(flat)
    n = len(symbols)
    whole = (doc[2:] == doc[:-2]) & ((flat[:-2] != 0) | (flat[1:-1] != 0)) & ((flat[1:-1] != 0) | (flat[2:] != 0))
    gram = (code[:-2].astype(np.int64) * n + code[1:-1]) * n + code[2:]
    gram, doc = gram[whole], doc[:-2][whole]
    if n**3 <= 1 << 24:
        there = np.zeros(n**3, dtype=bool)
        there[gram] = True
        used = np.flatnonzero(there)
        place = np.zeros(n**3, dtype=np.int32)
        place[used] = np.arange(len(used))
        gram = place[gram]
    else:
        used, gram = np.unique(gram, return_inverse=True)
    s = symbols.astype(np.int64)
    keys = s[used // (n * n)] << 42 | s[used // n % n] << 21 | s[used % n]
    return doc, gram, keys


def _codes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    there = np.zeros(0x110000, dtype=bool)
    there[flat] = True
    symbols = np.flatnonzero(there)
    place = np.zeros(0x110000, dtype=np.int32)
    place[symbols] = np.arange(len(symbols))
    return symbols, place[flat]


def _parts(texts: pa.Array) -> Iterator[list[bytes | None]]:
    part, size = [], 0
    for t in utf8(texts):
        part.append(t)
        size += len(t or b"")
        if len(part) == DOCS or size > 4_000_000:
            yield part
            part, size = [], 0
    if part:
        yield part


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of batches of (text, lang); summed for a batch."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        at = 0
        for part in _parts(batch.column("text")):
            doc, gram, keys = letter_grams(part)
            own = langs[at : at + len(part)]
            at += len(part)
            if not len(keys):
                continue
            for lang in sorted(set(own)):
                n = np.bincount(gram[(own == lang)[doc]], minlength=len(keys))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(keys[some]), pa.array(n[some].astype(np.int64))], ["lang", "gram", "n"])


def profiles(texts: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """The languages of (text, lang), sorted, and their prototypes, one unit row for each.

    A prototype bundles the vectors of all trigrams of a language: gram counts are summed over all
    texts first, so each gram is made into a vector once. What comes to the driver is one vector a language.
    The part that all languages share is taken off.
    """
    counts = texts.where("text is not null and lang is not null").select("text", "lang").mapInArrow(_gram_counts, "lang string, gram bigint, n bigint")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            grams, n = batch.column("gram").to_numpy(), batch.column("n").to_numpy()
            for at in range(0, len(grams), 4096):
                v = gram_vectors(grams[at : at + 4096], dimensions).astype(np.float64)
                for lang in set(langs[at : at + 4096]):
                    own = langs[at : at + 4096] == lang
                    total[lang] = total.get(lang, 0) + n[at : at + 4096][own].astype(np.float64) @ v[own]
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions, pa.string()), pa.array(np.arange(dimensions)), pa.array(v)], ["lang", "d", "v"])

    summed = counts.mapInArrow(bundle, "lang string, d bigint, v double").groupBy("lang", "d").agg(F.sum("v").alias("v"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("d", "v"))).alias("v")).select("lang", "v.v").sort("lang").collect()
    if not rows:
        return [], np.zeros((0, dimensions))
    # entries are whole numbers: their sums don't depend on the order
    p = np.array([r.v for r in rows])
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    return [r.lang for r in rows], p


def _count_blocks(doc: np.ndarray, gram: np.ndarray, docs: int, grams: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first gram, counts of docs x grams) for runs of grams, so that a matrix has COUNTS entries or TOGETHER grams, whatever the script."""
    wide = max(TOGETHER, COUNTS // max(docs, 1) // TOGETHER * TOGETHER)
    if grams > wide:
        # occurrences by gram, so that each run of grams is one slice of them
        order = np.argsort(gram, kind="stable")
        doc, gram = doc[order], gram[order]
    for at in range(0, grams, wide):
        width = min(wide, grams - at)
        own = slice(*np.searchsorted(gram, (at, at + width))) if grams > wide else slice(None)
        n = np.bincount(doc[own] * width + (gram[own] - at), minlength=docs * width)
        yield at, n.reshape(docs, width).astype(np.float32)


def _predict(texts: pa.Array, langs: list[str], prototypes: np.ndarray) -> Iterator[tuple[str, float]]:
    for lang, score, _, _ in _judge(texts, langs, prototypes):
        yield lang, score


def _judge(texts: pa.Array, langs: list[str], prototypes: np.ndarray) -> Iterator[tuple[str, float, int, np.ndarray]]:
    """(language, score, trigrams, fits) of each text: fits are the mean projections of its trigrams on the prototypes.

    Unlike a cosine, the mean projection of a language's texts doesn't depend on their length, only its spread does.
    """
    shared = prototypes.mean(axis=0) if len(langs) > 1 else np.zeros(prototypes.shape[1])
    p = prototypes - shared
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    for part in _parts(texts):
        doc, gram, keys = letter_grams(part)
        v = np.zeros((len(part), prototypes.shape[1]), dtype=np.float32)
        for at, n in _count_blocks(doc, gram, len(part), len(keys)):
            for k in range(0, n.shape[1], TOGETHER):
                v += n[:, k : k + TOGETHER] @ gram_vectors(keys[at + k : at + min(k + TOGETHER, n.shape[1])], prototypes.shape[1])
        total = np.bincount(doc, minlength=len(part)).astype(np.int64)
        fits = (v @ prototypes.T) / (np.maximum(total, 1)[:, None] * np.sqrt(prototypes.shape[1]))
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) - shared
        cos = (v @ p.T) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        for k in range(len(part)):
            if not total[k] or not langs:
                yield UNKNOWN, 0.0, 0, fits[k]
            else:
                best = int(np.argmax(np.round(cos[k], 12)))
                yield langs[best], round(float(min(1.0, max(0.0, cos[k, best]))), 9), int(total[k]), fits[k]


#: Learned texts of a language and a length class that set a floor; spreads below their median that a text may lie under it.
ENOUGH, SPREADS = 20, 6
#: Length classes: powers of two of trigrams. Texts of under 64 trigrams are judged only by the like of them.
CLASSES, JUDGED = 32, 7


def _fits(texts: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """(lang, f struct<size, fit>) of the learned texts of (text, lang) that have a trigram: its length class and its fit to its own language."""

    @F.arrow_udf("struct<size: int, fit: double>")
    def own_fit(text: pa.Array, lang: pa.Array) -> pa.Array:
        got = [(n.bit_length(), round(float(fits[langs.index(own)]), 5)) for (_, _, n, fits), own in zip(_judge(text, langs, prototypes), lang.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in got], pa.int32()), pa.array([x[1] for x in got], pa.float64())], ["size", "fit"])

    # so that the filter isn't moved below the function, which would then run twice, in twice as many workers
    once = own_fit.asNondeterministic()
    return texts.where("text is not null and lang is not null").select("lang", once("text", "lang").alias("f")).where("f.size > 0")


def fit_floors(texts: DataFrame, langs: list[str], prototypes: np.ndarray) -> np.ndarray:
    """Least fit of a text of each language and length class, (languages, CLASSES), from all learned texts of (text, lang).

    SPREADS times the spread from lower quartile to median (as a deviation) under the median, and half
    of the median at most, so odd labels and junk don't set it. A class of under ENOUGH texts has the
    floor of the next shorter one, whose spread is wider; where there is none, from 64 trigrams on, a
    quarter of the median of all the language's texts. A language of under ENOUGH texts refuses nothing.
    """

    seen = _fits(texts, langs, prototypes)
    of = [F.count("*").alias("n"), F.percentile("fit", F.array(F.lit(0.25), F.lit(0.5))).alias("q")]
    rows = seen.select("lang", "f.size", "f.fit").rollup("lang", "size").agg(*of).where((F.col("n") >= ENOUGH) & F.col("lang").isNotNull()).collect()
    floors = np.full((len(langs), CLASSES), -np.inf)
    for r in sorted(rows, key=lambda r: r["size"] or 0):
        low, mid = r.q
        if r["size"] is None:
            floors[langs.index(r.lang), JUDGED:] = mid / 4
        else:
            floors[langs.index(r.lang), min(r["size"], CLASSES - 1) :] = min(mid - SPREADS * (mid - low) / 0.6745, mid / 2)
    return floors


def predict_language(text: Column | str, langs: list[str], prototypes: np.ndarray) -> Column:
    """struct<lang, score>: the language whose prototype is nearest by cosine, and that cosine, 0 at least.

    `und` and 0 where the text is null, has no letter, or nothing was learned. Ties go to the first language.
    """

    @F.arrow_udf("struct<lang: string, score: double>")
    def nearest(texts: pa.Array) -> pa.Array:
        got = list(_predict(texts, langs, prototypes))
        return pa.StructArray.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], ["lang", "score"])

    return nearest(text)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of docs; learned where crc32(doc_id) mod 5 isn't 0.

    Null ids count as the empty text in the fold. Null texts and texts without a letter are `und`; ties go to the first
    language. Rows that repeat an id or a text have equal predictions. A very long text's trigrams are all counted.
    An empty table gives an empty one. Other columns of docs aren't looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (fold(F.col(id_col), 5) == 0).alias("held_out"))
    langs, prototypes = profiles(rows.where("not held_out"), dimensions)
    return rows.select("doc_id", "held_out", predict_language("text", langs, prototypes).alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.0, dimensions: int = DIMENSIONS) -> DataFrame:
    """docs without those whose language can't be told: no letter, null text, a cosine of `least` or less, or a fit
    under the floors of all languages (see fit_floors), as of gibberish and languages never learned. Columns as they came.

    Where nothing can be learned (no row has a text and a language) only rows with letters stay.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), (fold(F.col(id_col), 5) == 0).alias("held_out"))
    learned = rows.where("not held_out")
    langs, prototypes = profiles(learned, dimensions)
    names = docs.columns
    kept = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at = F.col(f"_c{names.index(text_col)}")
    lettered = F.coalesce(at.rlike(r"\p{L}"), F.lit(False))
    if langs:
        floors = fit_floors(learned, langs, prototypes)

        @F.arrow_udf("boolean")
        def identified(texts: pa.Array) -> pa.Array:
            return pa.array([lang != UNKNOWN and score > least and bool((fits >= floors[:, min(n.bit_length(), CLASSES - 1)]).any()) for lang, score, n, fits in _judge(texts, langs, prototypes)], pa.bool_())

        kept = kept.where(identified(at))
    else:
        kept = kept.where(lettered)
    return kept.toDF(*names)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by profiles learned from those that aren't held out."""
    return identify_languages(table(spark, sf_dir, "documents"))
