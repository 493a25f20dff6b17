"""Connected components of a graph that no single task can hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Parts of a group that are joined apart.
SALTS = 32
#: Edges that a task contracts at once.
CHUNK = 1 << 17


def with_group_min(rows: DataFrame, key: str, spread: str, value: Column, name: str) -> DataFrame:
    """rows with a column `name`: the least value of all rows of their key, which isn't null.

    A group is dealt to SALTS parts by a hash of `spread`. Parts are reduced apart, the parts of a
    key meet as SALTS rows at most, and each goes back to its own part: no task holds a whole group.
    """
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS))).repartition(key, "_salt")
    parts = rows.groupBy(key, "_salt").agg(F.min(value).alias(name))
    parts = parts.withColumn(name, F.min(name).over(W.partitionBy(key)))
    return rows.join(parts, [key, "_salt"]).drop("_salt")


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (a, b) that isn't the least of its component among them, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (apart := root[x] != root[y]).any():
        p, q = root[x[apart]], root[y[apart]]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b), a > b, that connect what the edges of a partition connect, CHUNK of them at a time.

    Where rows come in order of a, each a has one edge: that of the last a of a chunk is held for the next chunk.
    """
    batch_of = lambda a, b: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        ends.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        if sum(len(a) for a, _ in ends) >= CHUNK:
            last = ends[-1][0][-1]
            a, b = contract(*(np.concatenate(x) for x in zip(*ends, strict=True)))
            ends = [(a[a == last], b[a == last])]
            yield batch_of(a[a != last], b[a != last])
    if ends:
        yield batch_of(*contract(*(np.concatenate(x) for x in zip(*ends, strict=True))))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node goes to the smallest one among the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = with_group_min(both, "a", "b", F.least("a", "b"), "m")
    return both.where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node itself, go to the smallest of them, and so on within a task. Edges come as a > b."""
    return edges.repartition("a").sortWithinPartitions("a").mapInArrow(_contracted, "a bigint, b bigint")


def component_stars(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b): each node that isn't the smallest of its component, once, and that smallest node.

    Alternates large-star and small-star steps until no edge changes; each round keeps its edges in
    the shared checkpoint folder. Tasks contract their edges before the first shuffle and in each small-star
    step. Edges may repeat, point to themselves or hold nulls (dropped).
    """
    e = edges.select(F.greatest(F.col(a), F.col(b)).cast("long").alias("a"), F.least(F.col(a), F.col(b)).cast("long").alias("b"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("whole"))
    e = cut(_small_star(e.where("whole and a <> b").select("a", "b").mapInArrow(_contracted, "a bigint, b bigint")))
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a")))
    before = e.agg(mark.alias("m")).first().m
    while before[0]:
        e = cut(_small_star(_large_star(e)))
        after = e.agg(mark.alias("m")).first().m
        if after == before:
            break
        before = after
    return e


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node that can be reached.

    A node that has edges only to itself, or none, isn't in the result. See component_stars.
    """
    e = component_stars(edges, a, b)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
