import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kilnwork.llm import topn


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 4), st.integers(-3, 3), st.integers(-9, 9)), max_size=20), max_size=9), st.integers(1, 4))
def test_merge_is_sort(runs, n):
    packed = [sorted(topn.pack(*x) for x in run) for run in runs]
    want = {}
    for g, s, k in sorted({x for run in runs for x in run}, key=lambda x: (x[0], -x[1], x[2])):
        kept = want.setdefault(g, [])
        if k not in kept and len(kept) < n:
            kept.append(k)
    assert list(topn.merge(packed, n)) == [(g, k) for g, kept in want.items() for k in kept]


SCHEMA = "g string, s string, id bigint, k string, place int"


def run(spark, rows, n=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = {}
    for r in topn.top_n(df, n, "g", topn.severity_rank("s"), "id").orderBy("g", "place").collect():
        out.setdefault(r.g, []).append(r.id)
    return out


def test_ties_nulls_repeats_hot_groups(spark):
    rng = random.Random(1)
    words = [" Critical\t", "ERROR", "warning ", "info", None, "odd", ""]
    rank = [4, 3, 2, 1, 0, 0, 0]
    rows, best = [], {}
    for k in range(4000):
        g = "hot" if k % 3 == 0 else f"g{rng.randrange(300)}"
        w = rng.randrange(len(words))
        rows += [(g, words[w], k, "clash", 0)] * (1 + k % 2)
        best.setdefault(g, []).append((-rank[w], k))
    rows += [(None, "error", 1, "", 0), ("g1", "error", None, "", 0)]
    assert run(spark, rows) == {g: [k for _, k in sorted(v)[:3]] for g, v in best.items()}


def test_empty_and_differing_repeats(spark):
    assert run(spark, []) == {}
    assert run(spark, [("a", "info", 1, "", 0), ("a", "error", 1, "", 0), ("a", "warning", 2, "", 0)]) == {"a": [1, 2]}


def test_null_score_is_last(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", -5, 2)], "g string, s int, id bigint")
    got = topn.top_n(df, 1, "g", F.col("s"), "id").collect()
    assert [r.id for r in got] == [2]


def test_wanted_groups_before_or_after(spark):
    df = spark.createDataFrame([(g, "info", k, "x", 0) for g in ("a", "b", None) for k in range(9)], SCHEMA)
    wanted = spark.createDataFrame([("b",), ("b",), ("z",), (None,)], "g string")
    for most in (1_000_000, 0):
        got = topn.top_n(df, 2, "g", topn.severity_rank("s"), "id", only=wanted, most_broadcast=most, bucket_rows=3)
        assert {tuple(r) for r in got.collect()} == {("b", 0, 1), ("b", 1, 2)}
