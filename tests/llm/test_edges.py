"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for each operator and stage; queries with SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandframe.llm import common, ctw, decontamination, fingerprints, langid, licences, lines, mixing, registry, simhash, toxicity, urls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "many words of a very long text without an end " * 5000
ROWS = [
    (1, "the cat sat on the mat and looked at the moon", "en", "a", 45),
    (1, "the cat sat on the mat and looked at the moon", "en", "a", 45),
    (2, "the cat sat on the mat and looked at the moon", "en", "b", 45),
    (2, "le chat est sur la table et regarde la lune", "fr", None, None),
    (3, None, "en", "a", None),
    (4, "", None, "a", 0),
    (5, " \n\t\n ", "fr", None, 5),
    (6, LONG, "en", "b", len(LONG)),
    (None, "le chien dort devant la porte de la maison", "fr", "c", 1),
    (None, None, None, None, None),
    (7, "?!... 123", "en", "a", 9),
    (8, "Released under the MIT License.\nle chien dort devant la porte de la maison", "fr", "c", 1),
]
#: Names that operators use for their own columns.
CLASHES = "h fp size target a b c s v text_a keep component_id score draws block held_out _c0 _keep_id _drop _p k n next_id sig".split()


def frame(spark, rows=ROWS, clash=False):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES]) if clash else df


def bench(spark, rows=((0, "devant la porte de la maison"), (1, None), (None, "looked at the moon and the cat"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def labels(spark, rows=((1, 0, 1), (2, None, None), (None, 1, 1), (3, 0, 0), (3, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


PER_ROW = {
    "ctw": lambda s, d: ctw.score_texts(d),
    "licences": lambda s, d: licences.scan_licences(d, licences.known_sentences(s), licences.known_rules(s)),
    "fingerprints": lambda s, d: fingerprints.fingerprint_documents(d),
    "mixing": lambda s, d: mixing.mix_plan(d, shards=4),
    "simhash": lambda s, d: simhash.simhash_classes(d),
    "lines": lambda s, d: lines.dedup_lines(d),
    "langid": lambda s, d: langid.identify_languages(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, labels(s)),
}


@pytest.mark.parametrize("name", PER_ROW)
@pytest.mark.parametrize("clash", [False, True])
def test_a_row_for_each_row(spark, name, clash):
    got = PER_ROW[name](spark, frame(spark, clash=clash)).collect()
    assert len(got) == len(ROWS)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_tables(spark, name):
    assert PER_ROW[name](spark, frame(spark, [])).count() == 0


def test_fingerprints_of_repeated_and_lone_rows(spark):
    rows = fingerprints.fingerprint_documents(frame(spark)).collect()
    alone = {r.doc_id: r for r in rows}
    assert alone[4].sig is None and alone[3].n_chars == 0
    # of rows that repeat an id and a text one goes on to the next document, the others to their own text
    twice = [r for r in rows if r.doc_id == 1]
    assert len(twice) == 2 and max(r.near_next for r in twice) == 1.0
    one = fingerprints.fingerprint_documents(frame(spark, ROWS[:1])).first()
    assert one.near_next == 1.0


def test_decontamination_edges(spark):
    got = decontamination.contamination(frame(spark, clash=True), bench(spark)).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(None, 0), (8, 0)}
    assert decontamination.contamination(frame(spark, []), bench(spark)).count() == 0
    assert decontamination.contamination(frame(spark), bench(spark, [])).count() == 0
    assert decontamination.decontaminate(frame(spark), bench(spark, [])).count() == len(ROWS)


def test_toxicity_without_labels(spark):
    got = toxicity.score_toxicity(frame(spark), labels(spark, [])).collect()
    assert len(got) == len(ROWS) and len({r.score for r in got}) == 1


def test_url_edges(spark):
    pages = [(1, "http://WWW.Example.com/en/x?q#f"), (1, "http://WWW.Example.com/en/x?q#f"), (2, None), (3, ""), (4, "no scheme"), (5, "x://net/fr/"), (6, "http://a.net/fr"), (None, "ftp://notnet/fr/"), (7, "http://com?/"), (8, "http://net/es/" + "y" * 5000)]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    rules = spark.createDataFrame([*urls.RULES, (None, "/", "block"), ("a.net", "/f", "block")], "host string, path string, verdict string")
    got = sorted(((r.page_id or 0, r.host, r.path[:9], r.rule, r.verdict) for r in urls.judge_urls(df, rules).collect()), key=str)
    want = [
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
        (5, "net", "/fr/", "net/fr/", "block"), (6, "a.net", "/fr", "a.net/f", "block"), (0, "notnet", "/fr/", None, "allow"), (7, "com", "", None, "allow"), (8, "net", "/es/yyyyy", "net/es/", "block"),
    ]
    assert got == sorted(want, key=str)
    assert urls.judge_urls(df.where("false"), rules).count() == 0
    assert urls.judge_urls(df, rules.where("false")).where("verdict = 'allow' and rule is null").count() == len(pages)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
@pytest.mark.parametrize("clash", [False, True])
def test_stages_keep_columns(spark, k, clash):
    name, stage = corpus_pipeline.STAGES[k]
    docs = frame(spark, clash=clash)
    got = stage(spark, docs, SF)
    assert got.columns[: len(docs.columns)] == docs.columns
    if k < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == docs.columns
    got.collect()
    assert stage(spark, docs.where("false"), SF).count() == 0


def test_decisions_of_stages(spark):
    docs = frame(spark)
    ids = [sorted(str(r.doc_id) for r in stage(spark, docs, SF).collect()) for _, stage in corpus_pipeline.STAGES[:3]]
    assert ids[0] == sorted(["1", "1", "2", "2", "6", "None", "8"])  # no null, empty or letterless text
    # repeated rows are one document: both keep its lines; doc 2's copy of the line goes, and the null id comes last
    assert ids[1] == sorted(["1", "1", "2", "3", "4", "5", "6", "None", "7", "8"])
    leaked = docs.withColumn("text", F.when(F.col("doc_id") == 6, F.concat_ws(" ", "text", F.lit(common.table(spark, SF, "benchmark").first().text))).otherwise(F.col("text")))
    stage = dict(corpus_pipeline.STAGES)
    assert "6" not in {str(r.doc_id) for r in stage["benchmark decontamination"](spark, leaked, SF).collect()}
    assert stage["benchmark decontamination"](spark, docs, SF).count() == len(ROWS)
    # the small source is drawn three times at most, and no row of it more often
    mixed = stage["mixing sources to target weights"](spark, docs.where("doc_id is not null"), SF)
    drawn = {(r.doc_id, r.source): r["count"] for r in mixed.groupBy("doc_id", "source").count().collect()}
    rows = {(r.doc_id, r.source): r["count"] for r in docs.groupBy("doc_id", "source").count().collect()}
    assert drawn and all(n <= 3 * rows[k] for k, n in drawn.items())
    # one of equal rows and texts; null, empty and blank texts differ as texts, but all have no words
    assert ids[2].count("1") == 1 and ids[2].count("2") == 1


def test_pipeline_runs(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0
    assert got.groupBy("mix_shard").count().count() > 1


@pytest.mark.parametrize("name", registry.SQL)
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, got.select(*cols).toPandas().astype(str).values.tolist())) == sorted(map(str, want.df()[cols].astype(str).replace("nan", "None").values.tolist()))
