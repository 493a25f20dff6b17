"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, n_words, table

WEIGHTS = (5, 2, 1)
#: Words of a shard, some 64 MB of text, and the fewest shards.
SHARD_WORDS, FEWEST = 10_000_000, 8
#: Levels of the splitting tree after which its nodes are dealt to tasks.
SPREAD = 6
#: Blocks of a source for each shard; blocks behind the first that doesn't fit, of which those that fit are taken.
PER_SHARD, TAIL = 8, 1024


def _uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 53)) / F.lit(float(1 << 53))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, words, target) from (source, words): shares by weight, none above `most` times its words.

    Sources by code point, null last, have the weights in turn. What a cap leaves goes to the others by
    weight: the target is the lesser of the cap and level x weight, where all targets add up to the total.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.select("source", "words", F.get(turn, (F.row_number().over(order) - 1) % len(weights)).alias("w"), (F.col("words") * most).alias("cap"))
    s = s.withColumn("full_at", F.col("cap") / F.col("w"))
    by = W.orderBy("full_at", F.col("source").isNull(), "source")
    total = F.sum("words").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * share
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", (total - before) / after)
    # the first source, by full_at, that its level doesn't fill, sets the level; all those before it are full
    level = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "level"))).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return s.select("source", "words", F.least(F.col("cap"), F.coalesce(level["level"] * F.col("w"), F.col("cap"))).alias("target"))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, key, quota): the quotas, array<struct<key, quota>> in one row, dealt exactly among the shards.

    Each node of a binary tree over the shards hands its left half a sample without replacement of
    its blocks, by selection sampling: a multivariate-hypergeometric draw. The rest goes right.
    """
    nodes = quotas.select(F.lit(0).alias("first"), F.lit(shards).alias("n"), F.col("quotas").alias("q"))
    level = 0
    while 1 << level < shards:
        half = (F.col("n") / 2).cast("int")
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["quota"])

        def draw(state: Column, item: Column) -> Column:
            def token(s: Column, _: Column) -> Column:
                # a number for each shard range and place in it
                u = _uniform(F.lit(seed), F.col("first"), F.col("n"), s["left"])
                take = F.when(u * s["left"] < s["want"], 1).otherwise(0).cast("long")
                return F.struct((s["want"] - take).alias("want"), (s["left"] - F.lit(1).cast("long")).alias("left"), (s["got"] + take).alias("got"))

            tokens = F.when(item["quota"] > 0, F.sequence(F.lit(1).cast("long"), item["quota"])).otherwise(F.array().cast("array<bigint>"))
            end = F.aggregate(tokens, F.struct(state["want"].alias("want"), state["left"].alias("left"), F.lit(0).cast("long").alias("got")), token)
            return F.struct(end["want"].alias("want"), end["left"].alias("left"), F.concat(state["out"], F.array(end["got"])).alias("out"))

        start = F.struct(F.floor(total * half / F.greatest("n", F.lit(1))).cast("long").alias("want"), total.alias("left"), F.array().cast("array<bigint>").alias("out"))
        drawn = nodes.select("first", "n", "q", half.alias("half"), F.aggregate("q", start, draw)["out"].alias("got"))
        left = F.struct("first", F.col("half").alias("n"), F.zip_with("q", "got", lambda x, g: F.struct(x["key"].alias("key"), g.alias("quota"))).alias("q"))
        right = F.struct((F.col("first") + F.col("half")).alias("first"), (F.col("n") - F.col("half")).alias("n"), F.zip_with("q", "got", lambda x, g: F.struct(x["key"].alias("key"), (x["quota"] - g).alias("quota"))).alias("q"))
        nodes = drawn.select(F.explode(F.filter(F.array(left, right), lambda x: x["n"] > 0)).alias("x")).select("x.first", "x.n", "x.q")
        level += 1
        if level == SPREAD:
            # so far all nodes are in the task of the first; a number given outright isn't joined again
            nodes = nodes.repartition(1 << SPREAD, "first")
    return nodes.select(F.col("first").alias("shard"), F.explode("q").alias("x")).select("shard", "x.key", "x.quota")


def _running(rows: DataFrame, by: list[str], values: dict[str, Column]) -> DataFrame:
    """rows with a running sum of each value over their source, in the order of `by`, of which the last two are a hash and a block.

    Sums of 1024 ranges of hashes come first, so rows of one source are sorted by many tasks. rows is read twice.
    """
    rows = rows.withColumn("_part", F.struct(*by[:-2], F.shiftright(by[-2], 54).alias("p")))
    sums = rows.groupBy("source", "_part").agg(*[F.sum(v).alias(n) for n, v in values.items()])
    before = W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = sums.select(F.col("source").alias("_s"), F.col("_part").alias("_p"), *[F.coalesce(F.sum(n).over(before), F.lit(0).cast("long")).alias(f"_{n}") for n in values])
    within = W.partitionBy("source", "_part").orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    joined = rows.join(base, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    return joined.select(*[c for c in rows.columns if c != "_part"], *[(F.col(f"_{n}") + F.sum(v).over(within)).alias(n) for n, v in values.items()])


def _with_source(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows with the columns of facts, a row a source."""
    return rows.join(facts.withColumnRenamed("source", "_name"), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")


def mix_draws(rows: DataFrame, shards: int, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = 3, seed: int = 17) -> DataFrame:
    """(source, block, source_size, target, draws array<struct<epoch, shard>>), a row for each block of rows (source, block, size).

    A source's blocks go in whole as often as its target holds all of them. Of the rest, in permuted order, blocks are taken up to
    the target; of the next TAIL blocks those that still fit. Every draw of a block falls to one shard, by the exact quotas of
    split_quotas. Blocks and draws are rows, numbered within their source by running sums.
    """
    by_block = rows.groupBy("source", "block").agg(F.sum("size").alias("words")).withColumn("o", F.xxhash64(F.lit(seed), "source", "block"))
    sources = cut(by_block.groupBy("source").agg(F.sum("words").alias("words")))
    epochs = F.when(F.col("words") > 0, F.least(F.floor(F.col("target") / F.col("words") + 1e-9), F.lit(most))).otherwise(0).cast("int")
    facts = source_targets(sources, weights, share, float(most)).select("source", F.col("words").alias("source_size"), "target", epochs.alias("epochs"))
    # blocks without words cost nothing and go in with the last pass, but never beyond the most passes
    facts = cut(facts.withColumn("rest", F.when(F.col("epochs") < most, F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(-1.0)))
    placed = cut(_with_source(_running(by_block, ["o", "block"], {"sum": F.col("words"), "number": F.lit(1).cast("long")}), facts))
    fits = F.col("sum") <= F.col("rest")
    filled = placed.groupBy("source").agg(F.coalesce(F.max(F.when(fits, F.col("sum"))), F.lit(0)).alias("full"), F.count_if(fits).alias("first"))
    tail = _with_source(placed.where(~fits & (F.col("epochs") < most)), filled).where(F.col("number") <= F.col("first") + TAIL)
    tail = tail.groupBy("source").agg(F.first(F.col("rest") - F.col("full")).alias("left"), F.sort_array(F.collect_list(F.struct("o", "block", "words"))).alias("items"))
    took = F.aggregate(
        "items",
        F.struct(F.col("left").alias("left"), F.array().cast("array<bigint>").alias("took")),
        lambda s, x: F.when(x["words"] <= s["left"], F.struct((s["left"] - x["words"]).alias("left"), F.concat(s["took"], F.array(x["block"])).alias("took"))).otherwise(s),
    )["took"]
    more = tail.select(F.col("source").alias("_s"), F.explode(took).alias("_b"))
    drawn = placed.join(more, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left")
    n = F.col("epochs") + F.when(fits | F.col("_b").isNotNull(), 1).otherwise(0)
    drawn = drawn.where(n > 0).select("source", "block", F.explode(F.sequence(F.lit(0), n - 1)).alias("epoch"))
    drawn = cut(drawn.withColumn("h", F.xxhash64(F.lit(seed), "epoch", "source", "block")))
    quotas = drawn.groupBy("source").agg(F.count("*").alias("quota"))
    dealt = split_quotas(quotas.agg(F.sort_array(F.collect_list(F.struct(F.col("source").alias("key"), "quota"))).alias("quotas")), shards, seed)
    end = F.sum("quota").over(W.partitionBy("key").orderBy("shard").rowsBetween(W.unboundedPreceding, 0))
    dealt = dealt.where("quota > 0").withColumn("end", end).select("key", "shard", F.explode(F.expr("sequence(end - quota + 1, end)")).alias("place"))
    numbered = _running(drawn, ["epoch", "h", "block"], {"number": F.lit(1).cast("long")})
    draws = numbered.join(dealt, F.col("source").eqNullSafe(F.col("key")) & (F.col("number") == F.col("place")))
    draws = draws.groupBy(F.col("source").alias("_s"), F.col("block").alias("_b")).agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("draws"))
    every = placed.join(draws, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left")
    return every.select("source", "block", "source_size", "target", F.coalesce("draws", F.array().cast("array<struct<epoch:int,shard:int>>")).alias("draws"))


def _block(key: Column, blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(blocks))


def _by_block(rows: DataFrame, shards: int | None, blocks: int | None, seed: int) -> tuple[DataFrame, int, int]:
    """(source, block, size) of rows (key, source, size), the number of shards and that of blocks a source: 1024 at least, and
    PER_SHARD for each shard, so that a shard of one source alone has blocks to hold."""
    count = blocks or 1024
    while True:
        narrow = cut(rows.groupBy("source", _block(F.col("key"), count, seed).alias("block")).agg(F.sum("size").alias("size")))
        n = shards or _shards(narrow)
        if blocks or count >= PER_SHARD * n:
            return narrow, n, count
        # words are counted once more, by finer blocks
        count = 1 << (PER_SHARD * n - 1).bit_length()


def mix_plan(docs: DataFrame, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int | None = None, seed: int = 17, **kind) -> DataFrame:
    """(doc_id, size, source_size, target, draws), a row for each row of docs; draws: in which pass it goes to which shard.

    size: words of the text, 0 for null. Null sources are one source, the last. Rows that repeat an id
    share a block and count as often as they come. Documents without words are drawn with their block.
    Sources whose words number 0 have target 0. A very long text is one number of words, in one block. An empty table
    gives an empty one. Other columns of docs aren't looked at. The number of blocks a source follows from that of
    shards unless it is given.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    narrow, shards, blocks = _by_block(rows.withColumnRenamed("doc_id", "key"), shards, blocks, seed)
    d = mix_draws(narrow, shards, seed=seed, **kind).select(F.col("source").alias("s"), F.col("block").alias("b"), "source_size", "target", "draws")
    joined = rows.withColumn("block", _block(F.col("doc_id"), blocks, seed)).join(d, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    return joined.select("doc_id", "size", "source_size", "target", "draws")


def _shards(words: DataFrame) -> int:
    return max(FEWEST, -(-(words.agg(F.sum("size")).first()[0] or 0) // SHARD_WORDS))


def mix(docs: DataFrame, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int | None = None, seed: int = 17, **kind) -> DataFrame:
    """The mixture: docs, each row as often as it is drawn, with its columns and mix_epoch, mix_shard and mix_rank.

    Rows of a shard lie in one partition, shuffled by a seeded hash; mix_rank is that hash. Without a number there is a shard for
    each SHARD_WORDS words of docs. See mix_plan for null, empty, very long, repeated and missing rows; of rows of one rank either
    comes first.
    """
    names = docs.columns
    cols = [f"_c{i}" for i in range(len(names))]
    rows = docs.toDF(*cols)
    at = {n: F.col(cols[names.index(n)]) for n in (id_col, text_col, source_col)}
    # words by block: all that the plan needs of the documents, and what tells the number of shards
    narrow, shards, blocks = _by_block(rows.select(at[id_col].alias("key"), at[source_col].alias("source"), n_words(at[text_col]).alias("size")), shards, blocks, seed)
    d = mix_draws(narrow, shards, seed=seed, **kind).where(F.size("draws") > 0).select("source", F.col("block").alias("_block"), "draws")
    drawn = rows.withColumn("_b", _block(at[id_col], blocks, seed)).join(d, at[source_col].eqNullSafe(F.col("source")) & (F.col("_b") == F.col("_block")))
    drawn = drawn.select(*cols, F.explode("draws").alias("_d")).select(*cols, F.col("_d.epoch").alias("mix_epoch"), F.col("_d.shard").alias("mix_shard"))
    drawn = drawn.withColumn("mix_rank", F.xxhash64(F.lit(seed), "mix_shard", "mix_epoch", at[id_col], at[text_col]))
    taken = {"mix_epoch", "mix_shard", "mix_rank"}
    return drawn.repartitionByRange(shards, "mix_shard").sortWithinPartitions("mix_shard", "mix_rank").toDF(*[f"{n}_in" if n in taken else n for n in names], "mix_epoch", "mix_shard", "mix_rank")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share in the mixture: its size, its source's size and target, and the words that the mix takes."""
    got = mix_plan(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"))
