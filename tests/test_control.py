from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kilnwork.functions import web
from kilnwork.operators import analyzers, limits
from kilnwork.sources import advisories

T = datetime(2026, 3, 1, 12)


def test_one_failure_stops_no_other(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    fails = lambda d: d.select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    r = analyzers.Registry([analyzers.Analyzer("late", lambda d: d.where("x > 1"), phase=2), analyzers.Analyzer("bad", fails), analyzers.Analyzer("none", fails)])
    found, statuses = r.run({"late": df, "bad": df})
    assert [s[:3] for s in statuses] == [("bad", "failed", 0), ("none", "skipped", 0), ("late", "completed", 1)]
    assert found["late"].collect()[0].x == 2
    with pytest.raises(ValueError):
        r.add(analyzers.Analyzer("bad", fails))


def test_a_group_that_fails_is_a_row(spark):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"y": [1 // int(pdf["x"].min())]})

    df = spark.createDataFrame([("a", 1), ("b", 0), (None, 1)], "g string, x int")
    assert {tuple(r) for r in analyzers.apart(df, "g", work, "y int").collect()} == {("a", 1, None), ("b", None, "ZeroDivisionError")}


def test_first_broken_limit_is_named(spark):
    rows = [("d", T + timedelta(minutes=k), k, g, n) for k, (g, n) in enumerate([("a", 3.0), ("a", 3.0), ("b", 4.0), ("b", 4.0), (None, None)])]
    df = spark.createDataFrame(rows + [("e", T, 9, "a", 5.0), (None, T, 10, "a", 1.0)], "day string, at timestamp, id int, g string, n double").withColumn("all", F.lit("x"))
    checks = (limits.Check("own", "g", "n", 5), limits.Check("cap", "all", "n", 7))
    got = {r.id: r.refused_by for r in limits.granted(df, "day", "at", "id", checks).collect()}
    assert got == {0: None, 1: "own", 2: None, 3: "own", 4: None, 9: None}


def test_pictures(spark):
    flat, ramp = [5] * 72, list(range(0, 72))
    df = spark.createDataFrame([(1, flat), (2, [k * 3 for k in ramp]), (3, [0] * 70 + [255, 1]), (4, []), (5, [1, 2])], "k int, p array<int>")
    got = {r.k: (r.low, r.hash) for r in df.select("k", web.is_low_information(F.col("p")).alias("low"), web.gradient_hash(F.col("p")).alias("hash")).collect()}
    assert got == {1: (True, "0" * 16), 2: (False, "f" * 16), 3: (True, got[3][1]), 4: (None, None), 5: (True, None)}


def test_broken_captures_and_snapshots(spark):
    df = spark.createDataFrame([(1, "{"), (2, None), (3, '{"requested_url": "u", "forms": [{"inputs": null}, {"inputs": [{"type": null}]}]}')], "page int, payload string")
    got = {r.page: (r.url, r.forms, r.asks_password) for r in advisories.captures(df).collect()}
    assert got == {1: (None, 0, False), 2: (None, 0, False), 3: ("u", 2, False)}
    lines = spark.createDataFrame([("[]",), ('{"scan_id": "s", "findings": [["1", "a"], ["x"], null, []]}',)], "value string")
    assert [tuple(r)[:3] for r in advisories.snapshot_findings(lines).collect()] == [("s", 1, "a")]
