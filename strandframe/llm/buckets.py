"""Like entries of shared buckets: what stars have left apart is compared in full, in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Entries of a bucket that one block holds; blocks meet in pairs.
BLOCK = 256
KEYS = ["v", "main", "i", "j"]


def stars(entries: DataFrame, *more: str) -> DataFrame:
    """Entries (v, id, more...) of buckets with two different ids at least, once a bucket, each with the first of its bucket and the one before it, by id.

    crowded: the bucket has four entries or more. In smaller ones first and before are all pairs.
    """
    row, whole = W.partitionBy("v").orderBy("id"), W.partitionBy("v")
    own = F.struct("id", *more)
    met = entries.select("v", "id", *more, F.first(own).over(row.rowsBetween(W.unboundedPreceding, 0)).alias("head"), F.lag(own).over(row).alias("before"), F.count("*").over(whole).alias("n"), F.max("id").over(whole).alias("last"))
    met = met.where("n > 1 and last <> head.id and (before is null or before.id <> id)")
    return met.select("v", "id", *more, "head", "before", (F.col("n") > 3).alias("crowded"))


def unmet(crowd: DataFrame, classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(v, main, i, j, left, id, c): entries (v, id) of buckets that hold more than one component c of classes (component_stars), dealt to pairs of blocks.

    Members of the bucket's largest component don't meet each other; they meet all the rest, and the
    rest meets itself. So each two entries of different components share a group (v, main, i, j)
    in which one is left and the other isn't, or i = j and not main. No group has more than some two blocks.
    """
    seen = cut(crowd.join(classes.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("v", "id", F.coalesce("component", "id").alias("c")))
    sizes = seen.groupBy("v", "c").agg(F.count("*").alias("n")).groupBy("v")
    sizes = sizes.agg(F.max_by("c", F.struct("n", "c")).alias("most"), F.ceil(F.max("n") / block).cast("int").alias("n_most"), F.ceil((F.sum("n") - F.max("n")) / block).cast("int").alias("n_rest")).where("n_rest > 0")
    rows = seen.join(sizes, "v").withColumn("own", F.col("c") == F.col("most"))
    rows = rows.withColumn("at", F.pmod(F.xxhash64("id"), F.when(F.col("own"), F.col("n_most")).otherwise(F.col("n_rest"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    group = lambda main, i, j, left: F.struct(F.lit(main).alias("main"), i.alias("i"), j.alias("j"), left.alias("left"))
    at, yes, no = F.col("at"), F.lit(True), F.lit(False)
    most = F.transform(upto("n_rest"), lambda k: group(True, at, k, yes))
    rest = F.transform(upto("n_rest"), lambda k: group(False, F.least(at, k), F.greatest(at, k), at <= k))
    both = F.concat(rest, F.transform(upto("n_most"), lambda k: group(True, k, at, no)))
    return rows.select("v", "id", "c", F.explode(F.when(F.col("own"), most).otherwise(both)).alias("g")).select("v", "g.*", "id", "c")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows in order of KEYS, as tables of whole groups with the places where groups start and the end."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        if not len(t):
            continue
        new = np.zeros(len(t), dtype=bool)
        for k in KEYS:
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        starts = [0, *np.flatnonzero(new).tolist()]
        if len(starts) > 1:
            yield t.slice(0, starts[-1]), starts
        rest = t.slice(starts[-1])
    if rest is not None:
        yield rest, [0, len(rest)]


class _Entries:
    """Columns of whole groups as arrays, made once for all groups of a table."""

    def __init__(self, t: pa.Table) -> None:
        self.of, self.left = t.column("c").to_numpy(), t.column("left").to_numpy()
        self.inner = ~t.column("main").to_numpy() & (t.column("i").to_numpy() == t.column("j").to_numpy())
        self.sketch = t.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(t), -1)

    def met(self, a: int, b: int, distance: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (k, m) of entries of different components in the group from a to b whose sketches differ in `most` at most."""
        of, sketch = self.of[a:b], self.sketch[a:b]
        if self.inner[a]:
            near = np.triu((of[:, None] != of) & (distance(sketch, sketch) <= most))
            p, q = np.nonzero(near)
            return p + a, q + a
        x, y = np.flatnonzero(self.left[a:b]), np.flatnonzero(~self.left[a:b])
        p, q = np.nonzero((of[x][:, None] != of[y]) & (distance(sketch[x], sketch[y]) <= most))
        return x[p] + a, y[q] + a


def full_links(dealt: DataFrame, sketches: DataFrame, texts: Callable[[DataFrame], DataFrame], distance: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int, shingles: Callable[[str], set], similarity: float) -> DataFrame:
    """Edges (a, b) of Jaccard `similarity` or more, enough to connect what such pairs connect in each group of unmet().

    sketches: (id, sketch array<bigint>); texts gives (id, text) for the ids of a table; distance gives the
    distances of two arrays of sketches, pairs of over `most` are not looked at. Sketches meet first, and only
    entries with a near one in their group are met again with their texts. Pairs that are connected
    already are passed over, so a group of g entries gives less than g edges.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_groups(batches):
            entries, some = _Entries(t), np.zeros(len(t), dtype=bool)
            for a, b in pairwise(starts):
                for places in entries.met(a, b, distance, most):
                    some[places] = True
            if some.any():
                yield from t.filter(pa.array(some)).combine_chunks().to_batches()

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_groups(batches):
            entries, held = _Entries(t), t.column("text")
            ids, of = t.column("id").to_numpy().tolist(), entries.of.tolist()
            sets, parent, found = {}, {}, []

            def find(c: int) -> int:
                while (up := parent.get(c, c)) != c:
                    parent[c] = c = parent.get(up, up)
                return c

            def of_text(k: int) -> set:
                if k not in sets:
                    sets[k] = shingles(held[k].as_py())
                return sets[k]

            for start, end in pairwise(starts):
                sets.clear()
                for k, m in zip(*(x.tolist() for x in entries.met(start, end, distance, most)), strict=True):
                    c, d = find(of[k]), find(of[m])
                    if c == d:
                        continue
                    a, b = of_text(k), of_text(m)
                    both = len(a & b)
                    if both / (len(a) + len(b) - both) >= similarity:
                        parent[c] = d
                        found.append((max(ids[k], ids[m]), min(ids[k], ids[m])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([z[0] for z in found], pa.int64()), pa.array([z[1] for z in found], pa.int64())], ["a", "b"])

    grouped = lambda rows: rows.repartition(*KEYS).sortWithinPartitions(*KEYS)
    rows = dealt.join(sketches, "id").select(*dealt.columns, "sketch")
    some = cut(grouped(rows).mapInArrow(near, rows.schema))
    return cut(grouped(some.join(texts(some), "id")).mapInArrow(linked, "a bigint, b bigint"))  # one worker a core
