"""Samples of tables that repeat a doc_id thousands of times."""

from pyspark.sql import functions as F

from quillon.llm import language, toxicity


def test_toxicity_sample_outlives_a_repeated_id(spark):
    rows = [(0, "good day to you")] * 3000 + [(i, "you vile idiot" if i % 2 else "good day to you") for i in range(1, 41)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2) for i in range(41)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.fit(df, labels, 40)).where("row.doc_id > 0").select("row.doc_id", "is_toxic").collect()
    assert {r[0]: r[1] for r in got} == {i: i % 2 == 1 for i in range(1, 41)}


def test_language_sample_outlives_a_repeated_id(spark):
    rows = [(1, "abc cab bca", "aa")] * 3000 + [(i, "xyz zyx yzx", "bb") for i in range(1, 41)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).where(~F.coalesce(language.held_out(), F.lit(False)))
    assert set(language.fit(df, 10).langs) == {"aa", "bb"}
