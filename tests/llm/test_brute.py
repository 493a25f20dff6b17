"""Operators held against brute force on small fixtures."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandframe.llm import common, components, ctw, decontamination, fingerprints, langid, lines, mixing, simhash, toxicity

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def documents(seed=3, n=60, size=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 5 == 4:
            words = rows[i - 1][1].split(" ")
            words[rng.randrange(len(words))] = rng.choice(WORDS).upper()
            rows.append((i, " ".join(words)))
        elif i % 7 == 6:
            rows.append((i, rows[i - 2][1]))
        else:
            rows.append((i, " ".join(rng.choice(WORDS) + rng.choice("abcdef") for _ in range(rng.randrange(8, size)))))
    return rows


def classes(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(nodes), 2):
        if linked(a, b):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {n: find(n) for n in nodes}


def test_components_are_those_of_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(400, k) for k in range(401, 440)]
    pairs = {tuple(sorted(e)) for e in edges}
    want = classes({x for e in edges for x in e}, lambda a, b: (a, b) in pairs)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame([*edges, (None, 3), (7000, 7000)], "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_spark_hashes_shingles_alike(spark):
    assert spark.sql("select xxhash64('a b ç')").first()[0] % 2**64 == xxhash.xxh64_intdigest("a b ç".encode(), 42)


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes(spark):
    rows = [*documents(), (100, None), (101, ""), (102, "one two"), (103, "ONE two"), (104, "x " * 9000)]
    prints = {i: plain_simhash(t) for i, t in rows}
    want = classes(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = simhash.simhash_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.fp % 2**64 for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("dense", [1, 4, 1024])
def test_hamming_links_lose_none(spark, dense):
    rng = random.Random(9)
    prints = set()
    for _ in range(8):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    want = classes(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = components.connected_components(simhash.hamming_links(spark.createDataFrame(signed, "fp long"), dense)).collect()
    groups = collections.defaultdict(set)
    for r in got:
        groups[r.component].add(r.node % 2**64)
    whole = collections.defaultdict(set)
    for n, c in want.items():
        whole[c].add(n)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in whole.values() if len(g) > 1)


def test_near_dedup_keeps_one_of_each_class(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(120))) for i in range(40)]
    near = []
    for i in range(20):
        words = rows[i][1].split()
        words[60] = "changed"
        near.append((100 + i, " ".join(words)))
    docs = spark.createDataFrame([*rows, *near, (200, rows[3][1]), (3, rows[3][1])], "doc_id long, text string")
    got = sorted(r.doc_id for r in simhash.near_dedup(docs).collect())
    assert [d for d in got if d < 100] == list(range(40))
    assert len(got) - 40 <= 1  # the index may miss a pair; measured recall is in the README
    assert 200 not in got


def test_near_links_recall(spark):
    """Of all pairs of a table at a Jaccard of 0.8 or more, how many the links connect: groups are linked by stars, not pairs."""
    docs = common.table(spark, "/root/testdata/sf0.1", "documents")
    texts = docs.select(F.xxhash64("text").alias("h"), "text").dropDuplicates(["h"])
    held = {r.h: r.text.encode() for r in texts.collect()}
    sets = {h: simhash._shingles(t, 5) for h, t in held.items()}
    by = collections.defaultdict(list)
    for h, s in sets.items():
        # of n shingles a like text shares all but a fifth: one of the rarest fifth, and one, is among them
        for x in s:
            by[x].append(h)
    shared = set()
    for h, s in sets.items():
        rare = sorted(s, key=lambda x: (len(by[x]), x))[: len(s) - -(-4 * len(s) // 5) + 1]
        shared |= {(min(h, g), max(h, g)) for x in rare for g in by[x] if g != h}
    want = {p for p in shared if simhash.shingle_jaccard(held[p[0]], held[p[1]], 5) >= 0.8}
    links = simhash.near_links(texts).cache()
    assert all(simhash.shingle_jaccard(held[r.a], held[r.b], 5) >= 0.8 for r in links.collect())
    of = {r.node: r.component for r in components.connected_components(links).collect()}
    met = sum(a in of and of[a] == of.get(b) for a, b in want)
    print(f"near_links: {met} of {len(want)} pairs connected")
    assert not want or met >= 0.9 * len(want)


def test_lines_keep_the_first_of_each_component(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice(WORDS) for _ in range(14)) for _ in range(12)]
    rows = []
    for i in range(30):
        own = [" ".join(rng.choice(WORDS) + rng.choice("xyz") for _ in range(10)) for _ in range(2)]
        like = base[i % 12]
        if i > 11:
            at = rng.randrange(len(like))
            like = like[:at] + "q" + like[at + 1 :]
        rows.append((i, "\n".join([own[0], like.upper() if i % 2 else like, "", "short line", own[1]])))
    rows.append((50, "short line\n\nshort line"))
    where = [(i, k, lines.normalise(line.encode()).decode()) for i, t in rows for k, line in enumerate(t.split("\n")) if line.strip()]
    linked = classes(range(len(where)), lambda a, b: lines.line_jaccard(where[a][2], where[b][2]) >= 0.8)
    drop = {where[n][:2] for n, c in linked.items() if n != c}
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in drop) for i, t in rows}
    assert {r.doc_id: r.text for r in got.collect()} == want


def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        now = [i]
        for j, d in enumerate(text, 1):
            now.append(min(now[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = now
    return min(row)


def test_decontamination_finds_all_edits(spark):
    rng = random.Random(4)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, sentence(16) + ("." if i % 2 else "")) for i in range(6)] + [(6, None), (7, "tiny")]
    rows = []
    for i in range(24):
        text = sentence(20)
        leak = list(items[i % 6][1])
        for _ in range(i // 2):
            at = rng.randrange(len(leak))
            leak[at : at + 1] = rng.choice(["", "z", leak[at] + "w"])
        rows.append((i, f"{text} {''.join(leak).upper()}, {sentence(10)}"))
    rows += [(90, None), (91, ""), (92, sentence(300)), (93, "one\n Tiny!\ntwo"), (94, "a tiny one")]
    norm = decontamination.normalise
    want = {}
    for d, t in rows:
        for i, x in items:
            if not t or not x or not norm(x):
                continue
            if len(norm(x)) < 16:
                if norm(x) in map(norm, t.split("\n")):
                    want[d, i] = 0
            elif (k := edit_distance_in(norm(x), norm(t))) <= int(0.1 * len(norm(x))):
                want[d, i] = k
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.contamination(docs, bench).collect()}
    assert got == want and len(want) > 10
    # the same in many blocks of items
    assert {(r.doc_id, r.item_id): r.distance for r in decontamination.contamination(docs, bench, chars=150).collect()} == want
    assert {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_decontamination_finds_short_items_where_their_words_stand(spark):
    items = [(0, "What is 7 x 8?"), (1, "tiny"), (2, "is 7"), (3, "a b a"), (4, "7 x 8"), (5, "Ünder är")]
    rows = [(0, "Question: What is 7 x 8? Answer: 56."), (1, "what is\n7 X 8"), (2, "what is 7 x 85"), (3, "tiny\nthis 7 words"), (4, "a tiny thing; a, b! a-b a"), (5, "xa b a"), (6, "ünder ÄR"), (7, ""), (8, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    norm = decontamination.normalise
    want = set()
    for d, t in rows:
        for i, x in items:
            if t and " " in norm(x) and f" {norm(x)} " in f" {norm(t)} " or t and " " not in norm(x) and norm(x) in map(norm, t.split("\n")):
                want.add((d, i, 0, f" {norm(t)} ".find(f" {norm(x)} ") + len(norm(x)) if " " in norm(x) else len(norm(x))))
    got = {(r.doc_id, r.item_id, r.distance, r.end) for r in decontamination.contamination(docs, bench).collect()}
    assert got == want and {(0, 0), (0, 2), (0, 4), (1, 0), (2, 2), (3, 1), (4, 3), (6, 5)} == {w[:2] for w in want} - {(1, 2), (1, 4)}
    assert {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()} == {5, 7, 8}


def test_decontamination_finds_the_least_distance_in_periodic_texts():
    rng = random.Random(14)
    texts = [("bababababbbbaababbbbbaaaaabba", "babababababbbbaababbbbbaaabaabbaababba")]
    for _ in range(1500):
        unit = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 5)))
        item = (unit * 40)[: rng.randrange(20, 45)]
        item = "".join(c if rng.random() > 0.1 else rng.choice("ab") for c in item)
        text = list(unit * rng.randrange(2) + item + item[: rng.randrange(20)])
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(text))
            text[at : at + 1] = rng.choice(["", "a", "b", "ab"])
        texts.append((item, "".join(text)))
    for item, text in texts:
        least, most = edit_distance_in(item, text), int(0.1 * len(item))
        got = [(k, d) for k, d, _ in decontamination.Items([(0, item)], 0.1, 16).search(text)]
        assert got == ([(0, least)] if least <= most else [])


def test_context_tree_weighting(spark):
    """Scores are those of a tree of dictionaries, bit by bit."""
    rows = [(i, t) for i, t in documents(n=25, size=14)] + [(60, None), (61, "  "), (62, "É é ALPHA")]
    token = {d: (t or "").encode().lower().split() for d, t in rows}
    learn = {d for d in token if zlib.crc32(str(d).encode()) % 7 != 2}
    depth = ctw.DEPTH

    def steps(d):
        line = b" ".join(token[d]) + b"\n"
        padded = b"\n" * depth + line
        for i, symbol in enumerate(line):
            context = padded[i : i + depth]
            node = 1
            for b in range(7, -1, -1):
                bit = symbol >> b & 1
                yield context, node, bit
                node = node * 2 + bit

    counts = collections.defaultdict(lambda: [0, 0])
    for d in learn:
        for context, node, bit in steps(d):
            for k in range(depth + 1):
                counts[context[depth - k :], node][bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)
    children = collections.defaultdict(list)
    for context, node in counts:
        if context:
            children[context[1:], node].append((context, node))
    weighted = {}
    for key in sorted(counts, key=lambda x: -len(x[0])):
        own = kt(*counts[key])
        weighted[key] = own if len(key[0]) == depth else np.logaddexp(own, sum(weighted[c] for c in children[key])) - math.log(2)

    def probability(context, node, bit):
        p = None
        for k in range(depth, -1, -1):
            key = context[depth - k :], node
            n = counts[key] if key in counts else (0, 0)
            own = (n[bit] + 0.5) / (sum(n) + 1)
            if p is None:
                p = own
            else:
                w = math.exp(kt(*n) - weighted.get(key, 0.0)) / 2
                p = w * own + (1 - w) * p
        return p

    c = collections.Counter(w for d in learn for w in [*token[d], b"\n"])
    n, v = sum(c.values()), len(c)
    for common_size in (ctw.COMMON, 10):
        got = {r.doc_id: r for r in ctw.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), common=common_size).collect()}
        assert len(got) == len(rows)
        for d in token:
            words = [*token[d], b"\n"]
            assert got[d].score == pytest.approx(sum(math.log10(probability(*s)) for s in steps(d)), rel=1e-9)
            assert got[d].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
            assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens, got[d].held_out) == (len(words), sum(c[w] > 0 for w in words), n, d not in learn)


def test_a_text_larger_than_a_block_goes_on(spark, monkeypatch):
    texts = [b"one two three " * 40, b"four", None, b"five six " * 90]

    def counts(size):
        monkeypatch.setattr(ctw, "BLOCK_BYTES", size)
        got, first = collections.Counter(), 0
        for ended, block in ctw.blocks(iter(texts)):
            words = list(block.keys)
            for kind, keys, place, n in block.pairs():
                for k, p, m in zip(keys.tolist(), place.tolist(), n.tolist(), strict=True):
                    got[kind, words[k] if kind == ctw.WORD else k, first + p] += m
            first += ended
        return got

    assert counts(64) == counts(10**6)


def generalised_jaccard(a, b):
    a, b = (collections.Counter((t or "").encode().lower().split()) for t in (a, b))
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def test_fingerprints(spark):
    rows = [*documents(seed=8), (70, None), (71, ""), (72, "ab"), (73, "ÀÉ " * 40)]
    text = {d: t or "" for d, t in rows}
    order = sorted(text, reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    errors = []
    for i, d in enumerate(order):
        t, after = text[d], text[order[(i + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [got[d].near_edited - generalised_jaccard(t, edited), got[d].near_next - generalised_jaccard(t, after)]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07
    same = collections.defaultdict(set)
    for d, t in text.items():
        same[t.lower()].add(tuple(got[d].sig or ()))
    assert all(len(s) == 1 for s in same.values())


def test_a_sample_takes_one_logarithm_where_its_weight_is_one_step(spark):
    value = str(fingerprints._sample("term", "n", F.lit(0)))
    always = value[: value.index("CASE WHEN")] if "CASE WHEN" in value else value
    assert len(re.findall(r"\b(?:ln|log)\(", always, re.I)) == 1
    # weights of many steps agree as often as the generalised Jaccard says: 1000 and 700 of one word, 1 and 3 of another, a third
    texts = [(0, "a " * 1000 + "b c"), (1, "a " * 700 + "b b b")]
    sig = {r.id: r.sig for r in fingerprints.cws_signatures(spark.createDataFrame(texts, "id long, text string"), ["id"], samples=4096).collect()}
    assert np.mean(np.array(sig[0]) == np.array(sig[1])) == pytest.approx(generalised_jaccard(texts[0][1], texts[1][1]), abs=0.03)


def test_mixing(spark):
    docs = common.table(spark, SF, "documents")
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    got = mixing.mix_plan(docs, shards=8).collect()
    again = mixing.mix_plan(docs.repartition(5), shards=8).collect()
    assert sorted((r.doc_id, r.draws) for r in got) == sorted((r.doc_id, r.draws) for r in again)
    size, target, taken, draws = (collections.Counter() for _ in range(4))
    for r in got:
        s = source[r.doc_id]
        size[s] += r["size"]
        target[s] = r.target
        taken[s] += r["size"] * len(r.draws)
        assert len(r.draws) <= 3 and len({d.epoch for d in r.draws}) == len(r.draws)
    names = sorted(size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, total, left, free = {}, sum(size.values()), sum(size.values()), set(names)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        if not over:
            break
        want |= {s: 3.0 * size[s] for s in over}
        left -= sum(3 * size[s] for s in over)
        free -= over
    want |= {s: level * weight[s] for s in free}
    assert {s: round(x, 6) for s, x in target.items()} == {s: round(x, 6) for s, x in want.items()}
    assert sum(want.values()) == pytest.approx(total)
    # what is taken falls short of the target by less than one of the source's blocks, here of one document or a few
    blocks = collections.Counter()
    for r in docs.select("doc_id", "source", common.n_words("text").alias("n"), mixing._block(F.col("doc_id"), 1024, 17).alias("b")).collect():
        blocks[r.source, r.b] += r.n
    for s in names:
        assert want[s] - max(n for (x, _), n in blocks.items() if x == s) < taken[s] <= want[s] + 1e-6
    mixed = collections.Counter(r.doc_id for r in mixing.mix(docs, shards=8).select("doc_id").collect())
    assert mixed == {r.doc_id: len(r.draws) for r in got if r.draws}


def test_every_shard_of_one_source_has_rows(spark):
    """More shards than the fewest blocks: blocks grow with them, the tree's nodes are dealt to tasks, quotas stay exact."""
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("x").alias("source"))
    got = mixing.mix_plan(docs, shards=300).collect()
    by_shard = collections.Counter(d.shard for r in got for d in r.draws)
    assert len(got) == 12_000 and all(len(r.draws) == 1 for r in got)
    assert set(by_shard) == set(range(300)) and sum(by_shard.values()) == 12_000


def test_split_quotas_is_exact(spark):
    quotas = {"a": 37, "b": 0, "c": 5, None: 210}
    row = spark.createDataFrame([([(k, q) for k, q in quotas.items()],)], "quotas array<struct<key: string, quota: bigint>>")
    got = mixing.split_quotas(row, 7, 3).collect()
    sums, shards = collections.Counter(), collections.Counter()
    for r in got:
        sums[r.key] += r.quota
        shards[r.shard] += r.quota
    assert dict(sums) == quotas and set(shards) == set(range(7))
    assert max(shards.values()) - min(shards.values()) <= 3


def test_language_accuracy(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = langid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_gram_counts_are_the_same_in_any_number_of_runs(monkeypatch):
    """Texts of thousands of symbols have more trigrams than one matrix holds; each matrix stays small and none is lost."""
    rng = random.Random(9)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x8E00)) for _ in range(rng.randrange(2000))).encode() for _ in range(12)]
    doc, gram, keys = langid.letter_grams([*texts, None, b""])
    whole = np.zeros((14, len(keys)))
    np.add.at(whole, (doc, gram), 1)
    for entries in (1, 14 * 4096, 1 << 30):
        monkeypatch.setattr(langid, "COUNTS", entries)
        got = list(langid._count_blocks(doc, gram, 14, len(keys)))
        assert all(n.size <= max(entries, 14 * langid.TOGETHER) for _, n in got)
        assert [at for at, _ in got] == list(np.cumsum([0, *(n.shape[1] for _, n in got)]))[:-1]
        assert (np.hstack([n for _, n in got]) == whole).all()


def test_language_by_brute_force(spark):
    """Predictions are those of vectors bundled gram by gram."""
    docs = common.table(spark, SF, "documents").select("doc_id", "text", "lang").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang) for r in docs] + [(10**6, None, "en"), (10**6 + 1, "12 ?", "en")]
    d = 256

    def vector(text):
        letters = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in text or ""]
        flat = [0]
        for x in [*letters, 0]:
            if x or flat[-1]:
                flat.append(x)
        v, n = np.zeros(d), 0
        for a, b, c in zip(flat, flat[1:], flat[2:], strict=False):
            v += np.roll(langid._letter_vector(a, d), 2).astype(float) * np.roll(langid._letter_vector(b, d), 1) * langid._letter_vector(c, d)
            n += 1
        return v, n if any(letters) else 0

    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 and r[1] is not None and r[2] is not None]
    langs = sorted({r[2] for r in learn})
    p = np.array([unit(sum(vector(t)[0] for _, t, x in learn if x == lang)) for lang in langs])
    shared = p.mean(axis=0)
    q = np.array([unit(x) for x in p - shared])
    got = {r.doc_id: r for r in langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dimensions=d).collect()}
    for i, t, _ in rows:
        v, n = vector(t)
        if not n:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cos = q @ unit(unit(v) - shared)
        assert got[i].lang_pred == langs[int(np.argmax(cos))]
        assert got[i].score == pytest.approx(max(0.0, cos.max()), abs=1e-4)


def swaps_and_edits(a, b):
    """Edit distance in which a swap of two neighbours is one edit."""
    row = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        row[i][j] = min(row[i - 1][j] + 1, row[i][j - 1] + 1, row[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            row[i][j] = min(row[i][j], row[i - 2][j - 2] + 1)
    return row[-1][-1]


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_levenshtein_walk_finds_edits_within_the_budget_and_no_more(most):
    words = ["idiot", "moron", "worthless", "scum", "morons", "incompetence", "incompetents", "good-for-nothing"]
    trie = toxicity.Trie(dict.fromkeys(words, 1.0), most)
    rng = random.Random(6)
    for _ in range(4000):
        w = list(rng.choice(words))
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(w) + 1)
            if rng.random() < 0.3 and 0 < at < len(w):
                w[at - 1], w[at] = w[at], w[at - 1]
            else:
                w[at : at + rng.randrange(2)] = rng.choice(["", "x", "o"])
        w = "".join(w)
        if w in words:
            continue
        near = [(d, x) for x in words if 0 < (d := swaps_and_edits(x, w)) <= toxicity.budget(x, most)]
        assert trie.near(w) == min(near, default=(0, None))[1], w


def test_two_edits_are_found_where_a_model_allows_them(spark):
    model = toxicity.Model({"incompetents": 3.0}, {}, [-3.0, 4.0, 4.0, 0.0, 0.0, 0.0, 0.0])
    docs = spark.createDataFrame([(1, "you inkompetentz there"), (2, "you inkompetents there"), (3, "you are there"), (4, "you imkonpetentz there")], "doc_id long, text string")
    for most, want in ((1, {2}), (2, {1, 2})):
        got = docs.select("doc_id", toxicity.toxicity("text", model._replace(most_edits=most)).alias("score")).where("score > 0.5").collect()
        assert {r.doc_id for r in got} == want, most


def labelled(rng, n=600):
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(40)]
        kind = i % 6
        if kind < 2:  # abuse
            for at in rng.sample(range(3, 40), 3):
                words[at] = rng.choice(["grumblix", "snarfwit", "grumblx"])
        elif kind == 2:  # told of
            at = rng.randrange(4, 40)
            words[at - 2 : at + 1] = ["reportedly", "shouted", "grumblix"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind < 2)))
    return rows, labels


def test_toxicity_by_brute_force(spark):
    """Features and scores are those of a walk over all terms; context words come from labels alone."""
    rows, labels = labelled(random.Random(12))
    rows += [(1000, 'they said "grumblix" and left'), (1001, ""), (1002, "snarfwti!"), (1003, "a grumblix-like thing"), (1004, None)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    assert {"grumblix", "snarfwit"} <= set(model.lexicon) and model.context["reportedly"] < 0 and model.context["shouted"] < 0

    def hit(token):
        word = toxicity._EDGE.sub("", token)
        if word in model.lexicon:
            return model.lexicon[word], True
        near = [x for x in model.lexicon if word and toxicity.budget(x) and swaps_and_edits(x, word) == 1]
        if near:
            return model.lexicon[min(near)], False
        parts = [x for x in toxicity._PARTS.split(word) if x in model.lexicon]
        return (max(model.lexicon[x] for x in parts), True) if parts else None

    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, known).collect()}
    for i, t in rows:
        tokens = (t or "").lower().split()
        hits = [(k, h) for k, x in enumerate(tokens) if (h := hit(x))]
        x = [0.0] * 6
        if hits:
            quoted = {k for k, _ in hits if tokens[k][0] in toxicity._QUOTES and len(tokens[k]) > 1}
            around = [sum(model.context.get(w, 0.0) for w in {toxicity._EDGE.sub("", y) for y in tokens[max(0, k - 8) : k + 9]}) for k, _ in hits]
            total = lambda keep: math.log1p(sum(w for k, (w, whole) in hits if keep(k, whole)))
            window = max(sum(w for m, (w, _) in hits if k - toxicity.WINDOW < m <= k) for k, _ in hits)
            x = [total(lambda k, whole: k not in quoted and whole), total(lambda k, whole: k not in quoted and not whole), math.log1p(window), len(hits) / len(tokens), total(lambda k, _: k in quoted), sum(around) / len(hits)]
        z = model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], x, strict=True))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.95


def test_toxicity_learns_terms_and_quotation(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["grumblix", "snarfwit"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(1000, "you are a grumblxi and a snarfwyt you grumblix"), (1001, None), (1002, "")]
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    by = {r.doc_id: r for r in got.collect()}
    assert len(by) == len(rows) and all(0 <= r.score <= 1 for r in by.values())
    assert np.mean([by[i].predicted == y for i, y in labels if by[i].held_out]) > 0.95
    assert by[1000].predicted == 1 and by[1001].predicted == by[1002].predicted == 0
