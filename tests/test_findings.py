import math
import random

import pytest
from pyspark.sql import functions as F

from kilnwork.functions import findings as fn
from kilnwork.operators import limits, merging, scoring, stats
from kilnwork.operators.graph import components, degrees, strong_components


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("path", "want"),
    [("/src/a//b.py", "a/b.py"), ("./a/./b.py", "a/b.py"), ("a\\b.py", "a/b.py"), ("", ""), ("src/a.py", "src/a.py")],
)
def test_plain_path(spark, path, want):
    assert one(spark, fn.plain_path(F.lit(path))) == want


@pytest.mark.parametrize(
    ("path", "want"),
    [("tests/a.py", True), ("a/test_b.py", True), ("a/B.Spec.tsx", True), ("contest/a.py", False), ("a/conftest.py", True)],
)
def test_test_paths(spark, path, want):
    assert one(spark, fn.is_test_path(F.lit(path))) is want


def test_severities(spark):
    assert one(spark, fn.bandit_severity(F.lit("high"), F.lit("low"))) == "warning"
    assert one(spark, fn.bandit_severity(F.lit(None).cast("string"), F.lit("LOW"))) == "info"
    assert [one(spark, fn.ruff_severity(F.lit(c))) for c in ("E999", "F601", "F632", "E722", "W1", "")] == [
        "error",
        "warning",
        "error",
        "warning",
        "info",
        "error",
    ]
    labels = F.array(F.lit("LOW"), F.lit("HIGH"))
    assert one(spark, fn.advisory_severity(F.lit("9.8"), labels)) == "critical"
    assert one(spark, fn.advisory_severity(F.lit("x"), labels)) == "error"
    assert one(spark, fn.advisory_severity(F.lit(None).cast("string"), F.array().cast("array<string>"))) == "warning"


def test_weakness(spark):
    assert one(spark, fn.weakness_numbers(F.array(F.lit("CWE-89: x, cwe-79"), F.lit("CWE-89"), F.lit(None)))) == [89, 79]
    none = F.array().cast("array<int>")
    assert one(spark, fn.weakness_kind(F.lit("x.subprocess-exec"), none)) == "command-injection"
    assert one(spark, fn.weakness_kind(F.lit("zzz"), F.array(F.lit(1), F.lit(916)))) == "weak-crypto"
    assert one(spark, fn.weakness_kind(F.lit("zzz"), none)) is None


def test_versions(spark):
    key = lambda v: fn.version_key(F.lit(v))
    assert one(spark, key("1.10") > key("1.9"))
    assert one(spark, key("1.0.1") > key("1.0rc1"))
    bump = lambda a, b: one(spark, fn.is_major_bump(F.lit(a), F.lit(b)))
    assert (bump("1.2", "2.0"), bump("0.1", "0.2"), bump("1.2", "1.9"), bump("x", "1")) == (True, True, False, None)


SCHEMA = (
    "scan_id string, id bigint, analyzer string, rule_id string, severity string, file_path string, "
    "corroborated_by array<string>, start_line int, end_line int, message string, code_snippet string, category string, cwe_ids array<int>"
)


def finding(key, line=1, end=None, analyzer="semgrep", kind="k", severity="error", path="a.py", rule="r", scan="s", message="m"):
    return (scan, key, analyzer, rule, severity, path, [], line, end or line, message, None, kind, [])


def brute_penalty(weights):
    return sum(w * i**-0.75 for i, w in enumerate(sorted(weights, reverse=True), 1))


def test_removal_is_rescoring(spark):
    rng = random.Random(5)
    rows = [
        finding(k, severity=rng.choice(["info", "warning", "error", "critical", None]), rule=rng.choice("ab"), path=rng.choice(["x.py", "tests/x.py"]))
        for k in range(60)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    weights = {r.id: (r.rule, r.weight) for r in scoring.weighted(df).collect()}
    for r in scoring.removal_penalties(scoring.weighted(df)).collect():
        rest = [w for k, (rule, w) in weights.items() if rule == weights[r.id][0] and k != r.id]
        assert math.isclose(r.without, brute_penalty(rest), abs_tol=1e-9)


def test_fixing_never_lowers(spark):
    df = spark.createDataFrame([finding(k, severity="warning", analyzer=a) for k, a in enumerate(["ruff", "semgrep", "bandit"] * 5)], SCHEMA)
    sizes = spark.createDataFrame([("s", 5000, 10)], "scan_id string, loc int, modules int")
    assert all(r.impact >= 0 for r in scoring.impacts(df, sizes).collect())
    assert scoring.overall_scores(scoring.category_scores(df, sizes)).first().overall <= 100


def test_anchors_are_not_transitive(spark):
    rows = [finding(1, 10, 14), finding(2, 13, 17), finding(3, 16, 16), finding(4, 10, 40, kind="other"), finding(5, 20, 20, kind="other")]
    got = {r.id: r.anchor_id for r in merging.anchors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_merged(spark):
    rows = [finding(1, message="short", severity="critical"), finding(2, analyzer="bandit", message="longer message", severity=" Info")]
    got = merging.merged(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got.id, got.severity, got.n_merged, got.corroborated_by) == (2, "critical", 2, ["semgrep"])


def test_compared_is_a_bag(spark):
    base = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id bigint, k string")
    head = spark.createDataFrame([(4, "a"), (5, "c")], "id bigint, k string")
    got = merging.compared(base, head, ["k"]).groupBy("outcome").count().collect()
    assert {r.outcome: r["count"] for r in got} == {"unchanged": 1, "resolved": 2, "new": 1}


def test_islands(spark):
    df = spark.createDataFrame([("p", 1, 3), ("p", 4, 5), ("p", 7, 9), ("p", 2, 2)], "p string, s int, e int")
    got = {(r.s, r.e, r.n_ranges) for r in merging.islands(df, ["p"], "s", "e").collect()}
    assert got == {(1, 5, 3), (7, 9, 1)}


def test_limit_replay(spark):
    events = [("a", k, k * 100) for k in range(10)] + [(None, 99, 1)]
    df = spark.createDataFrame(events, "k string, id bigint, at bigint")
    got = {r.id: r.allowed for r in limits.admitted(df, "k", F.col("at"), "id", 350, 2).collect()}
    live, want = [], {}
    for k in range(10):
        live = [t for t in live if t > k * 100 - 350]
        want[k] = len(live) < 2
        if want[k]:
            live.append(k * 100)
    assert got == want


def test_stats(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in [(1, 1), (2, 4), (2, 9), (3, 16)]], "x double, y double")
    assert abs(stats.spearman(df, "x", "y").first().rho - 0.9486832980505138) < 1e-9
    g = spark.createDataFrame([("a", 1), ("a", 3), ("b", 0)], "k string, n int")
    got = {r.k: r.gini for r in stats.gini(g, ["k"], "n").collect()}
    assert got["b"] is None and abs(got["a"] - 0.25) < 1e-12
    empty = df.where("x > 99")
    assert stats.spearman(empty, "x", "y").first().rho is None


def test_graph(spark):
    edges = spark.createDataFrame([("g", 1, 2), ("g", 2, 1), ("g", 2, 3), ("g", 9, 8), ("g", 5, 5)], "g string, src bigint, dst bigint")
    for most in (500_000, 0):  # in a task, and over all executors
        assert {(r.node, r.component) for r in components(edges, most).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (5, 5)}
    assert {r.node: (r.fan_in, r.fan_out) for r in degrees(edges).collect()}[2] == (1, 2)
    strong = {r.node: (r.component, r["size"]) for r in strong_components(edges, "g", "bigint").collect()}
    assert strong[1] == strong[2] == (1, 2) and strong[3] == (3, 1)


def test_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "src bigint, dst bigint")
    assert components(chain, 0).where("component = 0").count() == 201


def test_chains_in_any_order(spark):
    late = [*range(2, 201), 1]  # the least node comes last
    mixed = random.Random(1).sample(range(1000, 2000), 1000)
    edges = spark.createDataFrame([p for c in (late, mixed) for p in zip(c, c[1:])], "src bigint, dst bigint")
    got = {r.node: r.component for r in components(edges, 0).collect()}
    assert got == {r.node: r.component for r in components(edges).collect()}
    assert got == dict.fromkeys(late, 1) | dict.fromkeys(mixed, 1000)
