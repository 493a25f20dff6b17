"""Merkle manifest of a table: a tree for each group, a tree over the groups' roots, and each row's authentication path.

Leaves of a group, in order, are cut into aligned blocks of 2^BLOCK_BITS; the roots of the blocks are the
leaves of the next tier, and so on until each group has one node. Going back down, each block makes the
paths of its leaves one after the other: a stack for each height builds the next authentication node while
the leaves go by, so log2 of the block's leaves are held, and the path of the block itself, which its
leaves share, is put behind. A block is a group of a Spark job; no task sees more than a block, whatever
group it is of.

Two nodes become the hash of their hex digits one after the other. A node without a neighbour becomes the
hash of its own, while its group has more than one node. Paths are arrays of "L<digest>" and "R<digest>",
the neighbour stands left or right, and "" for a node without one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Leaves of a block are two to this power.
BLOCK_BITS = 10


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: list[str | Column]) -> Column:
    """SHA-256 of the columns one after the other: "-" for null, else the bytes of the value as text, ":" and the value."""
    cells = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        cells.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*cells), 256)


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf has by its path."""
    for step in path:
        leaf = _hash(step[1:] + leaf if step[:1] == "L" else leaf + step[1:])
    return leaf


def number(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with idx, their number in their group by `order`, and n, the number of rows of their group. Groups aren't null.

    Rows are sorted by ranges of group and order, nulls first, so a large group is dealt to many tasks; each
    task counts its rows of each group, and running sums over the tasks' counts (a row for each group of a
    task) number them. What is sorted is written to the shared folder once: a second sort might cut ranges
    elsewhere.
    """
    columns = [group, *[c for c in rows.columns if c != group]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            local = []
            for g in batch.column(0).to_pylist():
                n, last = n + 1 if g == last else 0, g
                local.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(local), pa.int32()), pa.array(local, pa.int64())], [*columns, "task", "local"])

    ranges = rows.select(*columns).repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    numbered = common.written(ranges.mapInArrow(count, f"{schema}, task int, local bigint"), "numbered")
    counts = numbered.groupBy(group, "task").agg(F.count(F.lit(1)).alias("own"))
    before = F.sum("own").over(W.partitionBy(group).orderBy("task")) - F.col("own")
    base = counts.select(group, "task", before.alias("before"), F.sum("own").over(W.partitionBy(group)).alias("n"))
    return numbered.join(base, [group, "task"]).select(*rows.columns, (F.col("local") + F.col("before")).alias("idx"), "n")


class _Treehash:
    """Builds the node of a height that stands over the leaves from `first` on, a leaf or a hash at a time."""

    __slots__ = ("height", "at", "stop", "end", "stack", "done")

    def __init__(self, height: int, first: int, end: int) -> None:
        self.height, self.at, self.stop, self.end = height, first, min(first + (1 << height), end), end
        self.stack: list[tuple[int, str]] = []
        self.done = first >= end  # there is no such node

    def low(self) -> float:
        """Where it should go on: the stack with the lowest node first, those that are done last."""
        if self.done:
            return float("inf")
        return self.stack[-1][0] if self.stack else self.height

    def step(self, leaves: list[str]) -> None:
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            h, right = stack.pop()
            _, left = stack.pop()
            stack.append((h + 1, _hash(left + right)))
        elif self.at < self.stop:
            stack.append((0, leaves[self.at]))
            self.at += 1
        else:  # the last leaves are in: what has no neighbour rises alone
            h, node = stack.pop()
            stack.append((h + 1, _hash(node)))
        self.done = self.at == self.stop and len(stack) == 1 and stack[0][0] == self.height

    def finish(self, leaves: list[str]) -> str | None:
        while not self.done:
            self.step(leaves)
        return self.stack[0][1] if self.stack else None


def _height(n: int, rises: bool, bits: int) -> int:
    """Levels of a block: all, if its group has other blocks, else as many as its leaves need."""
    return bits if rises else max(n - 1, 0).bit_length()


def block_root(leaves: list[str], rises: bool, bits: int = BLOCK_BITS) -> str:
    return _Treehash(_height(len(leaves), rises, bits), 0, len(leaves)).finish(leaves)


def block_paths(leaves: list[str], rises: bool, bits: int = BLOCK_BITS) -> Iterator[list[str]]:
    """The path of each leaf within its block, in order. Held: a node and a stack for each height.

    Behind each leaf, where a height's node is no longer its neighbour, the one that its stack has made
    takes its place and the stack begins with the one after; then stacks go on for two steps a height at
    most, the one with the lowest node first.
    """
    n, top = len(leaves), _height(len(leaves), rises, bits)
    neighbour = [_Treehash(h, 1 << h, n).finish(leaves) for h in range(top)]
    stacks, first = [], leaves[0]
    for h in range(top):  # the first nodes of all heights follow from their neighbours
        stacks.append(_Treehash(h, n, n))
        stacks[h].stack.append((h, first))
        first = _hash(first + (neighbour[h] or ""))
    for leaf in range(n):
        yield ["" if node is None else ("L" if leaf >> h & 1 else "R") + node for h, node in enumerate(neighbour)]
        for h in range(top):
            if (leaf + 1) % (1 << h) == 0:
                neighbour[h] = stacks[h].finish(leaves)
                stacks[h] = _Treehash(h, (leaf + 1 + (1 << h)) ^ (1 << h), n)
        for _ in range(2 * top - 1):
            lows = [s.low() for s in stacks]
            least = min(lows)
            if least == float("inf"):
                break
            stacks[lows.index(least)].step(leaves)


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("idx")


def _block(bits: int) -> Column:
    return F.shiftright("idx", bits).alias("block")


def _roots(nodes: DataFrame, bits: int) -> DataFrame:
    """The next tier: a node for each block of (grp, idx, digest, n)."""

    def root(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        n = table.column("n")[0].as_py()
        made = block_root(table.column("digest").to_pylist(), n > 1 << bits, bits)
        return pa.table({"grp": table.column("grp").slice(0, 1), "idx": table.column("block").slice(0, 1), "digest": [made], "n": pa.array([-(-n >> bits)], pa.int64())})

    return nodes.select("grp", "idx", "digest", "n", _block(bits)).groupBy("grp", "block").applyInArrow(root, "grp string, idx bigint, digest string, n bigint")


def _paths(nodes: DataFrame, upper: DataFrame, bits: int) -> DataFrame:
    """(grp, idx, path) of a tier, by the paths (grp, idx, path) of the one above."""

    def paths(table: pa.Table, above: pa.Table) -> pa.Table:
        table = _ordered(table)
        rest = above.column("path")[0].as_py() if above.num_rows else []
        made = [p + rest for p in block_paths(table.column("digest").to_pylist(), bool(table.num_rows) and table.column("n")[0].as_py() > 1 << bits, bits)]
        return pa.table({"grp": table.column("grp"), "idx": table.column("idx"), "path": pa.array(made, pa.list_(pa.string()))})

    left = nodes.select("grp", "idx", "digest", "n", _block(bits)).groupBy("grp", "block")
    return left.cogroup(upper.groupBy("grp", "idx")).applyInArrow(paths, "grp string, idx bigint, path array<string>")


def tiers(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The nodes (grp, idx, digest, n) and those of each tier above, up to one node for each group."""
    out = [nodes]
    while (out[-1].agg(F.max("n").alias("n")).first().n or 1) > 1:
        out.append(common.written(_roots(out[-1], bits), "tier"))
    return out


def block_tops(levels: list[DataFrame], tops: DataFrame, bits: int) -> DataFrame:
    """(grp, idx, path) of the blocks of the lowest tier: from a block's root to its group's, then what `tops` has for the group (idx is 0)."""
    paths = tops
    for nodes in reversed(levels[1:]):
        paths = _paths(nodes, paths, bits)
    return paths


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str = "leaf", tampered: str | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """rows with subroot, root, path (from the leaf to the root) and, of the tampered leaf if one is given, folded_root and verified.

    rows: a row for each leaf, with its digest in `leaf`; a null in `tampered` stands for the leaf itself.
    Groups are ordered by the bytes of their texts, null first; leaves by `order`, nulls first, and then by
    their digests, so repeated rows, which have equal digests, have a place each. A block has 2^bits leaves.
    An empty table gives no rows. Columns of rows that have one of the new names are replaced.
    """
    new = ["subroot", "root", "path", "folded_root", "verified"]
    kept = [c for c in rows.columns if c not in new and c != leaf]
    # groups are told apart by their texts: null is "0", any text has a "1" before it
    key = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0")).alias("grp")
    by = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    other = (F.col(tampered) if tampered else F.lit(None).cast("string")).alias("tampered")
    leaves = number(rows.select(key, *by, F.col(leaf).alias("digest"), other, F.struct(*[F.col(c) for c in kept]).alias("row")), "grp", [*[f"o{i}" for i in range(len(order))], "digest"])
    levels = tiers(leaves.select("grp", "idx", "digest", "n"), bits)

    # the groups' roots are the leaves of one more tree
    groups = number(levels[-1].select(F.lit("").alias("all"), "grp", "digest"), "all", ["grp"])
    above = tiers(groups.select(F.col("all").alias("grp"), "idx", "digest", "n"), bits)
    top = above[-1].first()
    nothing = rows.sparkSession.createDataFrame([], "grp string, idx bigint, path array<string>")  # stands behind the last root
    ends = _paths(above[0], block_tops(above, nothing, bits), bits)
    tops = groups.join(ends.select("idx", "path"), "idx").select("grp", F.lit(0).cast("long").alias("idx"), "path", F.col("digest").alias("subroot"))
    shared = block_tops(levels, tops.select("grp", "idx", "path"), bits).join(tops.select("grp", "subroot"), "grp")

    def last(table: pa.Table, above: pa.Table) -> pa.Table:
        table, end = _ordered(table), above.to_pylist()[0]
        digests = table.column("digest").to_pylist()
        paths = [p + end["path"] for p in block_paths(digests, table.column("n")[0].as_py() > 1 << bits, bits)]
        folded = [fold(t or d, p) for t, d, p in zip(table.column("tampered").to_pylist(), digests, paths, strict=True)]
        return pa.table({"row": table.column("row"), "digest": digests, "subroot": [end["subroot"]] * len(digests), "path": pa.array(paths, pa.list_(pa.string())), "folded_root": folded})

    row = leaves.schema["row"].dataType.simpleString()
    made = leaves.withColumn("block", _block(bits)).groupBy("grp", "block").cogroup(shared.groupBy("grp", "idx")).applyInArrow(last, f"row {row}, digest string, subroot string, path array<string>, folded_root string")
    root = F.lit(top.digest if top else None).cast("string")
    return made.select("row.*", F.col("digest").alias(leaf), "subroot", root.alias("root"), "path", "folded_root", (F.col("folded_root") == root).alias("verified"))


def proof(path: Column | str) -> Column:
    """SHA-256 of the neighbours' digests of a path, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.substring(s, 2, 64)), ""), 256)


def op13_merkle(spark: SparkSession, sf_dir: str, bits: int = BLOCK_BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each document."""
    docs = common.table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    touched = common.fold("doc_id", 7) == 0
    other = F.when(touched & F.col("n_chars").isNotNull(), leaf_digest(["doc_id", "source", "lang", F.col("n_chars") + 1, "text"]))
    # texts are read and hashed once, before anything is sorted
    rows = common.written(docs.select("doc_id", "lang", leaf_digest(columns).alias("leaf"), other.alias("tampered")), "leaves")
    made = manifest(rows, "lang", ["doc_id"], "leaf", "tampered", bits)
    return made.select("doc_id", "leaf", "subroot", "root", proof("path").alias("proof_sha256"), "folded_root", "verified")
