"""Like texts that stand in large families of unlike ones; recall by the edit's shape."""

import random
import re

import numpy as np

from strandframe.llm import components, langid, lines, simhash


def connected(links, pairs):
    of = {r.node: r.component for r in components.connected_components(links).collect()}
    return sum(a in of and of[a] == of.get(b) for a, b in pairs) / len(pairs)


def test_block_edits_are_found(spark):
    """Pairs at a Jaccard of 0.80 to 0.81: one contiguous block is replaced, appended or cut."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(100000)}"
    rows, pairs = [], []
    for i in range(300):
        old = [word() for _ in range(204)]  # 200 shingles
        if i % 3 == 0:
            new = old[:90] + [word() for _ in range(18)] + old[108:]  # 22 shingles go, 22 come
        elif i % 3 == 1:
            new = old + [word() for _ in range(49)]
        else:
            new = old[:164]
        rows += [(2 * i, " ".join(old)), (2 * i + 1, " ".join(new))]
        assert 0.8 <= simhash.shingle_jaccard(rows[-1][1].encode(), rows[-2][1].encode(), 5) < 0.82
        pairs.append((2 * i, 2 * i + 1))
    links = simhash.near_links(spark.createDataFrame(rows, "h long, text string")).cache()
    got = connected(links, pairs)
    print(f"near_links: {got:.3f} of pairs by block edits connected")
    assert got > 0.97
    held = dict(rows)
    assert all(simhash.shingle_jaccard(held[r.a].encode(), held[r.b].encode(), 5) >= 0.8 for r in links.collect())


def test_pairs_in_a_family_of_templated_texts_are_found(spark):
    """Texts share a template, at some 0.73 of each other; every two have one more part in common."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(100000)}"
    template = [word() for _ in range(260)]
    rows, pairs = [], []
    for i in range(200):
        own = [word() for _ in range(45)]
        rows += [(2 * i, " ".join(template + own)), (2 * i + 1, " ".join(template + own[:17] + [word() for _ in range(28)]))]
        pairs.append((2 * i, 2 * i + 1))
    texts = [t.encode() for _, t in rows]
    assert simhash.shingle_jaccard(texts[0], texts[2], 5) < 0.78 < 0.8 < simhash.shingle_jaccard(texts[0], texts[1], 5)
    order = list(range(len(rows)))
    rng.shuffle(order)
    links = simhash.near_links(spark.createDataFrame([(order[k], t) for k, t in rows], "h long, text string")).cache()
    got = connected(links, [(order[a], order[b]) for a, b in pairs])
    print(f"near_links: {got:.3f} of pairs in a family connected")
    assert got > 0.97
    assert links.count() < len(rows) * simhash.BANDS


def test_pairs_in_a_family_of_templated_lines_are_found(spark):
    """Lines share a template, at some 0.7 of each other; every two are at 0.8 or more."""
    rng = random.Random(10)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    template = letters(100)
    rows, pairs = [], []
    for _ in range(200):
        own = letters(20)
        one, two = template + own, template + own[:11] + letters(9)
        assert lines.line_jaccard(one, two) >= 0.8
        pairs.append((lines.line_id(one.encode()), lines.line_id(two.encode())))
        rows += [one, two]
    assert lines.line_jaccard(rows[0], rows[2]) < 0.78
    links = lines.line_links(spark.createDataFrame([(x,) for x in rows], "text string").repartition(4)).cache()
    got = connected(links, pairs)
    print(f"line_links: {got:.3f} of pairs in a family connected")
    assert got > 0.97
    assert links.count() < len(rows) * lines.BANDS


def python_nodes(df):
    return len(re.findall(r"ArrowEvalPython|MapInArrow", df._jdf.queryExecution().executedPlan().toString()))


def test_a_core_has_one_worker(spark):
    """Nodes that run Python in one stage have a worker each, all of them in the memory of an executor."""
    texts = spark.createDataFrame([("one two three four five", "en"), ("eins zwei drei vier", "de"), ("...", "en")], "text string, lang string")
    fits = langid._fits(texts, ["de", "en"], np.eye(2, 64))
    assert fits.count() == 2 and python_nodes(fits) == 1
    lined = spark.createDataFrame([("a line of some words\na line of some words!",)], "text string")
    assert python_nodes(lines._linked(lined, 0.8)[0]) == 0
    hashed = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h")], "h long, text string")
    assert python_nodes(simhash._linked(hashed, 5, 0.8, simhash.SEGMENTS)[0]) == 0
