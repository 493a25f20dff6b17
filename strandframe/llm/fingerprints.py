"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, cut, table

SAMPLES = 64
#: Samples that one row of the aggregate makes: few enough for its code to be compiled as one method.
TOGETHER = 8


def _sample(term: str, n: str, j: Column) -> Column:
    """a of Ioffe's scheme: r, c from Gamma(2, 1) and beta from [0, 1) by term and j; the least over a text's terms is its sample.

    With E = -ln u and D = -ln w of two uniforms, r = E + D is Gamma(2, 1) and beta = D / r is uniform, whatever r is.
    So t = floor(ln n / r + beta) = floor(ln(n / w) / -ln(u w)), and a = c exp(-r (t - beta + 1)) = c u (u w)^t, where t is 0
    as long as n u < 1: no logarithm but that of c = -ln(x y) for most terms. Two hashes give the four uniforms. The value
    is a function of the term, j and the quantised weight t alone, so equal values mean equal (term, t).
    """
    one = F.xxhash64(term, j)
    low = F.lit((1 << 21) - 1)
    c = -F.log((one.bitwiseAND(low) + 0.5) * (F.shiftrightunsigned(one, 21).bitwiseAND(low) + 0.5) * F.lit(0.5**42))
    u = (F.shiftrightunsigned(one, 42) + 0.5) * F.lit(0.5**22)
    w = (F.shiftrightunsigned(F.xxhash64(one), 11) + 0.5) * F.lit(0.5**53)
    t = F.greatest(F.floor(F.log(F.col(n) / w) / -F.log(u * w)), F.lit(1).cast("long"))
    return c * u * F.when(F.col(n) * u < 1, 1.0).otherwise(F.pow(u * w, t))


def cws_signatures(texts: DataFrame, keys: list[str], text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """keys and sig, array<int>: `samples` consistent weighted samples of 16 bits for each row of texts, by unique keys.

    Terms are words, A-Z lower-cased, weighted by their counts. Two signatures agree in a place with the
    probability of the generalised Jaccard similarity of the counts. Texts without a word aren't in the result.
    If texts are partitioned by some of the keys, nothing is shuffled.
    """
    words = F.split(ascii_lower(text_col), r"[\x20\x09-\x0D]+")
    terms = texts.select(*keys, F.explode(words).alias("w")).where("w <> ''").select(*keys, F.xxhash64("w").alias("term"))
    weighed = terms.groupBy(*keys, "term").agg(F.count("*").cast("double").alias("n"))
    parts = weighed.select("*", F.explode(F.array(*[F.lit(j) for j in range(0, samples, TOGETHER)])).alias("first"))
    least = parts.groupBy(*keys, "first").agg(*[F.min(_sample("term", "n", F.col("first") + j)).alias(f"s{j}") for j in range(TOGETHER)])
    part = F.struct("first", F.array(*[F.xxhash64(f"s{j}").bitwiseAND(F.lit(0xFFFF)).cast("int") for j in range(TOGETHER)]).alias("x"))
    whole = least.groupBy(*keys).agg(F.sort_array(F.collect_list(part)).alias("parts"))  # samples / TOGETHER parts
    return whole.select(*keys, F.slice(F.flatten("parts.x"), 1, samples).alias("sig"))


def likeness(a: Column | str, b: Column | str) -> Column:
    """Share of equal samples of two signatures; null signatures, of texts without words, are like each other only."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def as_text(sig: Column | str) -> Column:
    """Four hex digits a sample; empty for texts without words."""
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))), ""), F.lit(""))


def _followers(keys: DataFrame) -> DataFrame:
    """known, id, h, n, times and next_known, next_id, next_h: the key that follows in descending order, after the last the first.

    The order is by ranges: keys are looked at within a range, and a row for each range tells where the next begins.
    """
    order = [F.desc("known"), F.desc("id"), F.asc("h")]
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = cut(keys.repartitionByRange(parts, *order).withColumn("pid", F.spark_partition_id()))
    within = W.partitionBy("pid").orderBy(*order)
    rows = keys.withColumn("follows", F.lead(F.struct("known", "id", "h")).over(within)).withColumn("first", F.row_number().over(within) == 1)
    rows = cut(rows)
    starts = rows.where("first").select("pid", F.struct("known", "id", "h").alias("start"))  # one row a range
    by = W.orderBy("pid")
    starts = starts.select("pid", F.coalesce(F.lead("start").over(by), F.first("start").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("start"))
    follows = F.coalesce("follows", "start")
    return rows.join(F.broadcast(starts), "pid").select("known", "id", "h", "n", "times", follows["known"].alias("next_known"), follows["id"].alias("next_id"), follows["h"].alias("next_h"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, sig, edited_sig, near_edited, near_next), a row for each row of docs.

    The next document is the following one by descending id, null ids last, ties by a hash of the text; rows that repeat
    an id and a text follow each other. After the last comes the first, so a lone document follows itself. Null texts
    are empty; an empty text has no words, a null signature, and is like other such texts only. The edited text has
    the first floor(n / 2) characters of the next one (or all, if it is shorter) in place of its own last ones. A very long
    text is a row of its terms' counts; nothing holds all its words at once but the text itself. An empty table
    gives an empty one. Other columns of docs aren't looked at; ids are longs.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("h"), "text")
    key = ["id", "h", "known"]
    every = rows.groupBy(*key).agg(F.max(F.length("text")).alias("n"), F.count("*").alias("times"))
    chain = cut(_followers(every))
    repeated = not chain.where("times > 1").isEmpty()
    own = rows.dropDuplicates(key) if repeated else rows
    # of rows that repeat a key the last has the next key for its next document, the others their own
    head = chain.select(*[F.col(f"next_{k}").alias(k) for k in key], *[F.col(k).alias(f"own_{k}") for k in key], "n", F.lit(False).alias("same"))
    if repeated:
        head = head.union(chain.where("times > 1").select(*key, *key, "n", F.lit(True)))
    heads = own.join(head, key).select(*[F.col(f"own_{k}").alias(k) for k in key], F.expr("substring(text, 1, n div 2)").alias("head"), "n", "same")
    edited = own.join(heads, key).select(*key, "same", "text", "n", F.concat(F.expr("substring(text, 1, n - n div 2)"), F.col("head")).alias("edited"))
    one, two = F.struct(F.lit(False).alias("is_edited"), "text"), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text"))
    both = edited.select(*key, "same", F.explode(F.when(F.col("same"), F.array(two)).otherwise(F.array(one, two))).alias("x"))
    sigs = cws_signatures(both.select(*key, "same", "x.is_edited", "x.text"), [*key, "same", "is_edited"], samples=samples)
    # of each pair of rows at most one has either signature
    pick = lambda condition, name: F.max(F.when(condition, F.col("sig"))).alias(name)
    sigs = sigs.groupBy(*key).agg(pick(~F.col("is_edited"), "sig"), pick(F.col("is_edited") & ~F.col("same"), "next_edit"), pick(F.col("is_edited") & F.col("same"), "same_edit"))
    meta = edited.groupBy(*key).agg(F.max("n").cast("long").alias("n_chars"), F.max(F.when(~F.col("same"), F.sha2("edited", 256))).alias("next_sha"), F.max(F.when(F.col("same"), F.sha2("edited", 256))).alias("same_sha"))
    # one job: texts and heads are shuffled once for signatures and hashes
    signed = cut(meta.join(sigs, key, "left"))
    links = chain.select(*key, "times", "next_id", "next_h", "next_known")
    after = signed.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("known").alias("next_known"), F.col("sig").alias("next_sig"))
    got = signed.join(links, key).join(after, ["next_id", "next_h", "next_known"], "left")
    last = F.struct(F.col("next_sha").alias("sha"), F.col("next_edit").alias("edit"), F.col("next_sig").alias("after"))
    others = F.array_repeat(F.struct(F.col("same_sha").alias("sha"), F.col("same_edit").alias("edit"), F.col("sig").alias("after")), (F.col("times") - 1).cast("int"))
    got = got.select("known", "id", "n_chars", "sig", F.explode(F.concat(F.array(last), others)).alias("x"))
    return got.select(
        F.when(F.col("known"), F.col("id")).alias("doc_id"), "n_chars", F.col("x.sha").alias("edited_sha256"), "sig", F.col("x.edit").alias("edited_sig"),
        likeness("sig", "x.edit").alias("near_edited"), likeness("sig", "x.after").alias("near_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    got = fingerprint_documents(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_chars", "edited_sha256", as_text("sig").alias("fingerprint"), as_text("edited_sig").alias("edited_fingerprint"), "near_edited", "near_next")
