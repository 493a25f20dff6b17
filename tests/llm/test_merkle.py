"""The Merkle manifest held against trees that are built node by node."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strandframe.llm import merkle

SF = "/root/testdata/sf0.001"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    """(neighbour, whether it stands left) at each level; None where there is none."""
    out = []
    for level in tree[:-1]:
        k = i ^ 1
        out.append((level[k], k < i) if k < len(level) else None)
        i >>= 1
    return out


def folded(node, path):
    for step in path:
        node = sha(node) if step is None else sha(step[0], node) if step[1] else sha(node, step[0])
    return node


def expected(rows):
    """By doc_id: (leaf, subroot, root, proof, folded root, verified) of (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for r in sorted(rows, key=lambda r: r[0]):
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([leaf(r[0], r[3], r[2], r[4], r[1]) for r in groups[g]]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = {}
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            path = siblings(trees[g], i) + siblings(top, k)
            own = other = trees[g][0][i]
            if zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                other = leaf(r[0], r[3], r[2], r[4] + 1, r[1])
            root = folded(other, path)
            out[r[0]] = (own, trees[g][-1][0], top[-1][0], sha(*[s[0] for s in path if s]), root, root == top[-1][0])
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 31, 32, 33, 100])
def test_traversal_gives_the_paths_of_the_tree(n):
    leaves = [sha(str(i)) for i in range(n)]
    tree = levels(leaves)
    assert merkle.block_root(leaves, False, 7) == tree[-1][0]
    for rises in (False, True):
        lifted = tree
        while rises and len(lifted) <= 7:
            lifted = [*lifted, [sha(lifted[-1][0])]]
        assert merkle.block_root(leaves, rises, 7) == lifted[-1][0]
        for i, path in enumerate(merkle.block_paths(leaves, rises, 7)):
            assert merkle.fold(leaves[i], path) == lifted[-1][0]
            assert [p[1:] for p in path] == [s[0] if s else "" for s in siblings(lifted, i)]


def test_stacks_hold_few_nodes_and_are_done_in_time(monkeypatch):
    made, held, late = [], [], []
    init, finish = merkle._Treehash.__init__, merkle._Treehash.finish

    def watched(self, *a):
        init(self, *a)
        made.append(self)

    def ended(self, leaves):
        if not self.done:
            late.append(self)
        return finish(self, leaves)

    monkeypatch.setattr(merkle._Treehash, "__init__", watched)
    leaves = [sha(str(i)) for i in range(1 << merkle.BLOCK_BITS)]
    paths = merkle.block_paths(leaves, False)
    next(paths)
    monkeypatch.setattr(merkle._Treehash, "finish", ended)
    for _ in paths:
        held.append(sum(len(s.stack) for s in made[-4 * merkle.BLOCK_BITS :]))
    assert not late
    assert max(held) <= 5 * merkle.BLOCK_BITS


@pytest.mark.parametrize("bits", [2, 10])
def test_query_agrees_with_whole_trees(spark, bits):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    got = merkle.op13_merkle(spark, SF, bits).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == expected([tuple(r) for r in docs])
    assert 0 < sum(not r.verified for r in got) < len(got)


@pytest.mark.parametrize("seed", range(3))
def test_groups_nulls_and_sizes(spark, tmp_path, seed):
    rng = random.Random(seed)
    langs = [None, "", "a", "é", "漢", "0", "1", *[f"x{i}" for i in range(seed * 4)]]
    rows = [(i - 20, rng.choice([None, "", "t" * 20_000, "é:1"]), rng.choice(langs[: rng.randrange(1, len(langs) + 1)]), rng.choice([None, "s"]), rng.choice([None, 3])) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op13_merkle(spark, str(tmp_path), 2).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == expected(rows)


def test_edges(spark, tmp_path):
    rows = [(1, "x"), (1, "x"), (None, "y"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit("z")).withColumn("grp", F.lit(1)).withColumn("row", F.lit(2)).withColumn("idx", F.lit(3))
    df = df.withColumn("leaf", merkle.leaf_digest(["doc_id", "text"]))
    got = merkle.manifest(df, "text", ["doc_id"]).collect()
    assert len(got) == 4 and all(r.verified and r.root != "z" and r.idx == 3 for r in got)
    assert len({r.root for r in got}) == 1 and len({r.subroot for r in got}) == 3
    one = merkle.manifest(df.limit(1), "text", ["doc_id"]).first()
    assert one.path == [] and one.root == one.subroot == one.leaf
    assert merkle.manifest(df.where("false"), "text", ["doc_id"]).count() == 0
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert merkle.op13_merkle(spark, str(tmp_path)).count() == 0
