import random

import pytest
from pyspark.sql import functions as F

from kilnwork.functions import near
from kilnwork.operators import evaluation, sites


@pytest.mark.parametrize("edits", [1, 2])
def test_keys_lose_no_near_text(spark, edits):
    rng = random.Random(edits)
    texts = {"", "a"}
    for _ in range(60):
        text = [rng.choice("abcd") for _ in range(rng.randrange(12))]
        texts.add("".join(text))
        for _ in range(3):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randrange(2)] = rng.choice(("", "e", "a"))
            texts.add("".join(text))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    a = df.select(F.col("t").alias("a"), F.explode(near.part_keys(F.col("t"), edits)).alias("k"))
    b = df.select(F.col("t").alias("b"), F.explode(near.probe_keys(F.col("t"), edits)).alias("k"))
    met = {tuple(r) for r in a.join(b, "k").where(F.levenshtein("a", "b") <= edits).select("a", "b").distinct().collect()}
    every = df.toDF("a").join(df.toDF("b"), F.levenshtein("a", "b") <= edits)
    assert met == {tuple(r) for r in every.collect()}


def test_names_two_edits_away(spark):
    hosts = spark.createDataFrame([("micrasaft.com",), ("micr0soft.com",), ("mikrosofd.com",), ("microsoft.com",), ("maraseft.com",), ("acmi.com",)], "host string")
    brands = spark.createDataFrame([("Microsoft", 1, "microsoft"), ("Acme", 2, "acme")], "brand string, place int, keyword string")
    got = {r.host: r.rule for r in sites.imitated_brands(hosts, brands).collect()}
    assert got == {"micrasaft.com": "near", "micr0soft.com": "plain letters", "mikrosofd.com": "near", "microsoft.com": "exact"}


def test_inversions_at_any_gap(spark):
    rows = [("a", 20.0, 1.0), ("b", 0.0, 2.0), ("c", 2.5, 1.5), ("d", float("nan"), 0.0), ("e", None, 9.0)]
    df = spark.createDataFrame(rows, "k string, label double, score double")
    got = {tuple(r) for r in evaluation.inversions(df, "k", "label", "score").collect()}
    assert got == {("a", "b"), ("a", "c"), ("c", "b")}
    assert evaluation.inversions(df.limit(0), "k", "label", "score").count() == 0
