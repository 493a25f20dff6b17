"""Texts like none of the learned languages go; those of learned ones stay."""

import random

from pyspark.sql import functions as F

from strandframe.llm import common, langid

UNLEARNED = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待人人有资格享有本宣言所载的一切权利和自由不分种族肤色性别语言宗教政治或其他见解国籍或社会出身财产出生或其他身分等任何区别",
]


def test_gibberish_and_unlearned_languages_go(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    rng = random.Random(4)
    gibberish = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(60)) for _ in range(10)]
    more = spark.createDataFrame([(10**9 + k, t, "en") for k, t in enumerate(gibberish + UNLEARNED)], docs.schema)
    kept = langid.keep_identified(docs.union(more)).cache()
    assert kept.where(F.col("doc_id") >= 10**9).count() == 0
    gone = docs.where(F.col("text").rlike(r"\p{L}")).join(kept, "doc_id", "left_anti").collect()
    print("gone:", len(gone), [r.text[:80] for r in gone[:20]])
    assert len(gone) <= 0.01 * docs.count()
