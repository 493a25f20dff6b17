"""Toxicity: a mined lexicon, a Levenshtein automaton over its trie, and scores of the context of each hit."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold, table, utf8

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_PARTS = re.compile(r"[\W_]+")
_QUOTES = "\"'“”„«»‘’"
SPAN = 8
WINDOW = 20
#: Letters of a term for each edit that a misspelling may have, up to MOST_EDITS unless a number is given: a short word is one edit from many others.
PER_EDIT, MOST_EDITS = 5, 1


class Model(NamedTuple):
    """Terms with their log-odds, words that stand around terms with theirs (above 0 in abuse, below in quotation), and the weights of the features."""

    lexicon: dict[str, float]
    context: dict[str, float]
    weights: list[float]
    most_edits: int = MOST_EDITS


def budget(term: str, most_edits: int = MOST_EDITS) -> int:
    return min(most_edits, len(term) // PER_EDIT)


class Trie:
    """Lexicon words by letter; a walk with a row of edit distances is the Levenshtein automaton intersected with it."""

    #: Keys of a node, beside its letters: the word that ends there, and the largest budget of the words below.
    WORD, BUDGET = "", "budget"

    def __init__(self, words: dict[str, float], most_edits: int = MOST_EDITS) -> None:
        self.root: dict = {}
        self.budgets = {w: budget(w, most_edits) for w in words}
        self.most = max(self.budgets.values(), default=0)
        self.starts: set[str] = set()
        self.ends: set[str] = set()
        self.sizes: set[int] = set()
        for w, own in self.budgets.items():
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
                node[self.BUDGET] = max(own, node.get(self.BUDGET, 0))
            node[self.WORD] = w
            if own:
                self.starts.add(w[: len(w) // 2])
                self.ends.add(w[len(w) // 2 :])
                self.sizes |= {len(w) // 2, len(w) - len(w) // 2}

    def near(self, word: str) -> str | None:
        """The nearest lexicon word whose budget allows the edits (or swaps of two neighbours) to it, of equally near ones the least; None if there is none."""
        # one edit leaves a half of a term whole, at its own end; a swap across the middle is the exception. More edits may leave neither
        if self.most < 2 and not any(word[:n] in self.starts or word[-n:] in self.ends for n in self.sizes) and not self._swapped(word):
            return None
        found: list[tuple[int, str]] = []
        row = list(range(len(word) + 1))

        def walk(node: dict, letter: str, before: list[int], last: list[int] | None, previous: str) -> None:
            now = [before[0] + 1]
            for i, c in enumerate(word, 1):
                cost = min(now[i - 1] + 1, before[i] + 1, before[i - 1] + (c != letter))
                if last is not None and i > 1 and c == previous and word[i - 2] == letter:
                    cost = min(cost, last[i - 2] + 1)
                now.append(cost)
            # a swap goes on from the row before with one edit more
            if min(now) > node[self.BUDGET] and min(before) >= node[self.BUDGET]:
                return
            if self.WORD in node and 0 < now[-1] <= self.budgets[node[self.WORD]]:
                found.append((now[-1], node[self.WORD]))
            for c, child in node.items():
                if len(c) == 1:
                    walk(child, c, now, before, letter)

        for c, child in self.root.items():
            if len(c) == 1:
                walk(child, c, row, None, "")
        return min(found)[1] if found else None

    def _swapped(self, word: str) -> bool:
        i = len(word) // 2
        return any(word[: k - 1] + word[k] + word[k - 1 : k] in self.starts or word[: k - 1] + word[k] in self.starts for k in (i, i + 1) if 0 < k < len(word))


class _Words(dict):
    """What a token is to the lexicon: (weight, exact) or None. Forgets when it grows too large."""

    def __init__(self, lexicon: dict[str, float], most_edits: int = MOST_EDITS) -> None:
        super().__init__()
        self.lexicon, self.trie = lexicon, Trie(lexicon, most_edits)

    def __missing__(self, token: str) -> tuple[float, bool] | None:
        word = _EDGE.sub("", token)
        got = None
        if word in self.lexicon:
            got = (self.lexicon[word], True)
        elif word and (near := self.trie.near(word)):
            got = (self.lexicon[near], False)
        else:
            # a term may stand in a word of several parts
            parts = [p for p in _PARTS.split(word) if p in self.lexicon] if _PARTS.search(word) else []
            if parts:
                got = (max(self.lexicon[p] for p in parts), True)
        if len(self) > 1_000_000:
            self.clear()
        self[token] = got
        return got


#: Exact and misspelt terms apart; their share of the text; the densest window; those in quotes; what the words around them tell.
FEATURES = ("exact", "fuzzy", "window", "share", "quoted", "around")


def found_terms(text: str, words: _Words) -> tuple[list[str], list[tuple[int, tuple[float, bool]]]]:
    tokens = text.lower().split()
    return tokens, [(i, h) for i, t in enumerate(tokens) if (h := words[t])]


def features(text: str, words: _Words, context: dict[str, float]) -> list[float]:
    tokens, hits = found_terms(text, words)
    if not hits:
        return [0.0] * len(FEATURES)
    exact = fuzzy = quoted = around = 0.0
    for i, (weight, whole) in hits:
        near = {_EDGE.sub("", t) for t in tokens[max(0, i - SPAN) : i + SPAN + 1]}
        around += sum(context.get(w, 0.0) for w in sorted(near))
        if tokens[i][0] in _QUOTES and len(tokens[i]) > 1:
            quoted += weight
        elif whole:
            exact += weight
        else:
            fuzzy += weight
    best, start, total = 0.0, 0, 0.0
    for i, (weight, _) in hits:
        total += weight
        while hits[start][0] <= i - WINDOW:
            total -= hits[start][1][0]
            start += 1
        best = max(best, total)
    return [float(np.log1p(exact)), float(np.log1p(fuzzy)), float(np.log1p(best)), len(hits) / len(tokens), float(np.log1p(quoted)), around / len(hits)]


def _featured(text: Column | str, lexicon: dict[str, float], context: dict[str, float], most_edits: int) -> Column:
    made: list[_Words] = []

    @F.arrow_udf("array<double>")
    def seen(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(_Words(lexicon, most_edits))
        return pa.array([features(t.decode(), made[0], context) if t else [0.0] * len(FEATURES) for t in utf8(texts)], pa.list_(pa.float64()))

    return seen(text)


def _around(text: Column | str, lexicon: dict[str, float], most_edits: int) -> Column:
    """The distinct words that stand within SPAN of the terms of each text, terms left out."""
    made: list[_Words] = []

    @F.arrow_udf("array<string>")
    def near(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(_Words(lexicon, most_edits))
        out = []
        for t in utf8(texts):
            tokens, hits = found_terms(t.decode() if t else "", made[0])
            out.append(sorted({w for i, _ in hits for t in tokens[max(0, i - SPAN) : i + SPAN + 1] if not made[0][t] and (w := _EDGE.sub("", t))}))
        return pa.array(out, pa.list_(pa.string()))

    return near(text)


def mine_context(rows: DataFrame, lexicon: dict[str, float], least: float = 15.0, most_edits: int = MOST_EDITS) -> dict[str, float]:
    """Words around terms that tell abuse from quotation: by texts (text, toxic) that hold a term, the log of the odds that a word has in toxic
    ones against others, where the log-likelihood ratio is `least` or more. Words of both kinds of texts alike aren't taken."""
    seen = rows.select("toxic", _around("text", lexicon, most_edits).alias("w")).where(F.size("w") > 0)
    totals = seen.agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).first()
    if not totals.a or not totals.b:
        return {}
    counts = seen.select("toxic", F.explode("w").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    rate, n = totals.a / (totals.a + totals.b), F.col("a") + F.col("b")
    part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * p))).otherwise(0.0)
    odds = F.log((F.col("a") + 0.5) * (1 - rate) / ((F.col("b") + 0.5) * rate))
    taken = counts.select("word", (2 * (part("a", rate) + part("b", 1 - rate))).alias("g"), odds.alias("weight")).where(F.col("g") >= least)
    return {r.word: round(r.weight, 6) for r in taken.sort("word").collect()}


def mine_lexicon(rows: DataFrame, least: float = 25.0) -> dict[str, float]:
    """Terms of (text, toxic) that mark toxic texts, each with its weight: the log of odds.

    A term counts once for each distinct pair of neighbours, so copies of a text are one witness. Terms
    with a log-likelihood ratio of `least` or more are taken; there are no more of them than words in the labelled rows.
    """
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    seen = rows.select("toxic", words.alias("w"))
    triple = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(F.get("w", i).alias("word"), F.xxhash64(F.get("w", i - 1), F.get("w", i + 1)).alias("near")))
    seen = seen.where(F.size("w") > 0).select("toxic", F.explode(triple).alias("t")).select("toxic", "t.word", "t.near")
    seen = seen.groupBy("word", "near").agg(F.max("toxic").alias("bad"), F.min("toxic").alias("all_bad"))
    counts = seen.groupBy("word").agg(F.sum("all_bad").alias("a"), F.sum(1 - F.col("all_bad")).alias("b"))
    counts = cut(counts)
    total = counts.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    if not total.a or not total.b:
        return {}
    rate = total.a / (total.a + total.b)
    n = F.col("a") + F.col("b")
    part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * p))).otherwise(0.0)
    scored = counts.where(F.col("a") > 2 * rate * n).select("word", (2 * (part("a", rate) + part("b", 1 - rate))).alias("g"), F.log((F.col("a") + 0.5) * (1 - rate) / ((F.col("b") + 0.5) * rate)).alias("weight"))
    top = scored.where((F.col("g") >= least) & (F.col("weight") > 1.5)).collect()
    return {r.word: round(r.weight, 6) for r in sorted(top)}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights, the constant first, by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, most_edits: int = MOST_EDITS) -> Model:
    """The lexicon and the weights, from labelled rows that aren't held out.

    docs: doc_id, text; labels: doc_id, toxic. At most about `most` labelled rows, by a hash of the
    id, are used: so many ids and feature rows reach the driver, however large the tables are. Of a
    row with several labels the greatest counts. Three rows of four, by hash, teach the lexicon and its context,
    the fourth the weights, so that the weights see terms as they come in new texts.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = cut(known.where(fold("doc_id", 5) != 0))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < most)
    rows = cut(docs.where("text is not null").join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4))
    lexicon = mine_lexicon(rows.where(part > 0))
    context = mine_context(rows.where(part > 0), lexicon, most_edits=most_edits) if lexicon else {}
    # numbers only, a row for each labelled text of the bound; their order is that of their values
    got = sorted(rows.where(part == 0).select(_featured("text", lexicon, context, most_edits).alias("x"), "toxic").collect(), key=lambda r: (r.toxic, r.x)) if lexicon else []
    y = np.array([r.toxic for r in got], dtype=float)
    if not len(y) or y.min() == y.max():
        bad, every = rows.agg(F.sum("toxic"), F.count("*")).first()
        rate = ((bad or 0) + 0.5) / (every + 1)
        # nothing to weigh features by: a term of weight 1 outweighs the base rate
        return Model(lexicon, context, [float(np.log(rate / (1 - rate))), 4.0, 1.0, 0.0, 0.0, 0.0, 0.0], most_edits)
    return Model(lexicon, context, _logistic(np.array([r.x for r in got]), y).tolist(), most_edits)


def toxicity(text: Column | str, model: Model) -> Column:
    """The score of each text, 0 to 1; null and empty texts have that of a text without a term."""
    x = _featured(text, model.lexicon, model.context, model.most_edits)
    z = F.aggregate(F.zip_with(x, F.array(*[F.lit(w) for w in model.weights[1:]]), lambda a, b: a * b), F.lit(model.weights[0]), lambda a, b: a + b)
    return 1 / (1 + F.exp(-z))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", most: int = 20_000, most_edits: int = MOST_EDITS) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs; held out where crc32(doc_id) mod 5 is 0.

    Null ids have no label and count as the empty text in the fold. Null and empty texts have the score of a text
    without a term. Rows that repeat an id or a text have equal scores. Of the terms that a word may be a misspelling
    of, at most `most_edits` edits off, the nearest counts, of equally near ones the least. A very long text is read whole, a token at a time. Without labels all scores are equal; an empty
    table gives an empty one. Other columns aren't looked at.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = fit(rows, labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).alias("toxic")), most, most_edits)
    scored = rows.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), toxicity("text", model).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels of those that aren't held out."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
