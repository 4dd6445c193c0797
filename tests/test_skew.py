"""Salted joins give what plain joins give, hot keys or not."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import maintenance
from corpusloom.operators.skew import hot_keys, salted_join


@pytest.fixture(scope="module")
def sides(spark):
    big = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id").alias("v"))
    return big, spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(40)], "k string, x int")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot", [[], ["hot"], ["hot", "k3"]])
def test_salted_join(sides, how, hot):
    big, small = sides
    got = salted_join(big, small, "k", F.col("v"), hot, how).select("k", "v", "x")
    want = big.join(small, "k", how).select("k", "v", "x")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_keys(sides):
    counts = sides[0].groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert hot_keys(counts, "k", "n", least=100, share=0.1) == ["hot"] and hot_keys(counts, "k", "n") == []
    assert hot_keys(counts.limit(0), "k", "n") == []


def test_copies_of_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(maintenance, "hot_keys", lambda g, *a: hot_keys(g, *a, least=10))
    df = spark.range(90).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, " Same　text ").when(F.col("id") == 1, "　").when(F.col("id") == 2, F.lit(None)).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = {r["doc_id"]: (r["class_id"], r["n"]) for r in maintenance.exact_copies(df).collect()}
    assert len(got) == 90 and all(got[i] == (0, 30) for i in range(0, 90, 3)) and got[1] == (1, 1) and got[2] == (2, 1) and got[4] == (4, 1)
