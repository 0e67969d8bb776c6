from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from kilnwork.functions import colors
from kilnwork.operators import architecture as arch
from kilnwork.operators import evaluation, sinks, sites

REFS = [("s", "a", "b", 1, False, False), ("s", "b", "c", 1, False, True), ("s", "c", "a", 1, False, False), ("s", "a", "b", 9, True, False), ("s", "a", "d", 2, False, False), ("s", "d", "d", 2, False, False), ("s", "e", "f", 3, True, False)]


@pytest.fixture
def edges(spark):
    return arch.edges_of(spark.createDataFrame(REFS, "scan_id string, src string, dst string, line int, type_only boolean, lazy boolean"))


def test_edges_and_cycles(edges):
    got = {(r.src, r.dst): (r.n, r.type_only, r.lazy, r.line) for r in edges.collect()}
    assert got[("a", "b")] == (2, False, False, 1) and got[("b", "c")] == (1, False, True, 1)
    assert got[("e", "f")] == (1, True, False, 3) and ("d", "d") not in got
    assert [(r.cycle, r.truncated) for r in arch.cycles(edges).collect()] == [(["a", "b", "c"], False)]
    s = arch.summary(edges.where("not type_only")).first()
    assert (s.nodes, s.edges, s.depth) == (4, 4, 1)
    m = {r.node: r for r in arch.node_metrics(edges.where("not type_only")).collect()}
    assert (m["a"].fan_in, m["a"].fan_out) == (1, 2) and m["d"].centrality == 0 and m["a"].centrality > m["b"].centrality > 0


def test_betweenness_of_a_line():
    line = {"a": ["b"], "b": ["c"], "c": ["d"], "d": []}
    assert arch.betweenness(line) == {"a": 0.0, "b": round(2 / 6, 6), "c": round(2 / 6, 6), "d": 0.0}
    assert arch.longest_chain(line) == 3


def test_layers(spark):
    nodes = spark.createDataFrame([("s", p, 10, False, False, None) for p in ("api/routes/x.py", "core/services/y.py", "db/models.py")], "scan_id string, path string, loc int, is_test boolean, is_entrypoint boolean, error string")
    e = spark.createDataFrame([("s", "db/models.py", "core/services/y.py", False), ("s", "api/routes/x.py", "db/models.py", False), ("s", "api/routes/x.py", "core/services/y.py", False)], "scan_id string, src string, dst string, type_only boolean")
    got = {(r.src, r.kind) for r in arch.layer_issues(nodes, e).collect()}
    assert got == {("db/models.py", "inversion"), ("api/routes/x.py", "skip")}
    assert [r.path for r in arch.orphans(nodes, e).collect()] == ["api/routes/x.py"]


def test_god_modules(spark):
    nodes = spark.createDataFrame([("s", f"m{k}", 1000 if k == 0 else 10, False) for k in range(12)], "scan_id string, path string, loc int, is_test boolean")
    metrics = spark.createDataFrame([("s", "m0", 9, 0.5)], "scan_id string, node string, fan_in bigint, centrality double")
    assert [r.path for r in arch.god_modules(nodes, metrics).collect()] == ["m0"]


def test_colors(spark):
    assert colors.parsed("#fff") == (255.0, 255.0, 255.0, 1.0) and colors.parsed("transparent") is None
    assert colors.parsed("rgba(0, 0, 0, 0)") is None and colors.parsed("rgb(100% 0% 0% / 50%)") == (255.0, 0.0, 0.0, 0.5)
    assert [round(c) for c in colors.parsed("hsl(120, 100%, 50%)")[:3]] == [0, 255, 0]
    df = spark.createDataFrame([("#ffffff", "#000000"), ("nope", "#000")], "a string, b string").withColumns({"x": colors.rgba("a"), "y": colors.rgba("b")})
    lum = [colors.luminance(*(F.col(f"{c}.{k}") for k in "rgb")) for c in "xy"]
    lab = [colors.oklab(*(F.col(f"{c}.{k}") for k in "rgb")) for c in "xy"]
    r = df.select(colors.contrast(*lum).alias("c"), colors.distance(*lab).alias("d")).collect()
    assert abs(r[0].c - 21) < 1e-9 and abs(r[0].d - 1) < 1e-6
    assert spark.range(1).select(colors.hue_gap(F.lit(350), F.lit(10))).first()[0] == 20


def test_sites(spark):
    hosts = spark.createDataFrame([(h,) for h in ("pаypal.com", "paypa1.com", "paypall.com", "my-paypal.net", "example.org")], "host string")
    brands = spark.createDataFrame([("PayPal", 1, "paypal"), ("Other", 2, "othermart")], "brand string, place int, keyword string")
    got = {r.host: r.rule for r in sites.imitated_brands(hosts, brands).collect()}
    assert got == {"pаypal.com": "looks the same", "paypa1.com": "plain letters", "paypall.com": "near", "my-paypal.net": "word"}
    pages = spark.createDataFrame([("p", "ffffffffffffffff"), ("q", None)], "page string, hash string")
    refs = spark.createDataFrame([("r1", 1, "fffffffffffffff0"), ("r2", 2, "0fffffffffffffff")], "reference string, place int, hash string")
    assert [(r.page, r.reference) for r in sites.nearest_reference(pages, refs).collect()] == [("p", "r1")]
    with pytest.raises(ValueError):
        sites.nearest_reference(pages, refs, most_references=1)
    urls = spark.createDataFrame([("https://a.b/x",), ("https://a.b/y",), ("https://c.d/",)], "url string")
    assert {(r.url, r.by) for r in sites.listed_addresses(urls, urls.limit(0).unionByName(spark.createDataFrame([("https://a.b/x",)], "url string"))).collect()} == {("https://a.b/x", "url"), ("https://a.b/y", "host")}
    ev = spark.createDataFrame([(1, "a", "c", 60), (1, "b", "c", 70), (1, "z", "c", 0), (2, "a", "c", -5)], "record_id int, signal string, category string, points int")
    assert {(r.record_id, r.score, r.level, tuple(r.top)) for r in sites.assessed(ev).collect()} == {(1, 100, "critical", ("b", "a")), (2, 0, "low", ("a",))}
    px = spark.createDataFrame([("s", v) for v in (8, 16, 24, 8, 5)], "site string, px int")
    assert sites.spacing_base(px, ["site"], "px").first().base == 8
    ages = spark.createDataFrame([(date(2026, 1, 1),), (date(2024, 1, 1),), (None,)], "d date").select(sites.age_bucket(F.col("d"), F.lit(date(2026, 1, 5))).alias("b"))
    assert [r.b for r in ages.collect()] == ["under a week", "neutral", None]
    shares = sites.usage_shares(px, ["site"], "px", F.lit(1), 0.3).collect()
    assert [(r.px, r.share) for r in shares] == [(8, 0.4)]


def test_evaluation(spark):
    df = spark.createDataFrame([(float(k), float(k * k), k) for k in range(12)], "x double, y double, k int")
    ends = evaluation.bootstrap_interval(df, "x", "y", 100).first()
    assert ends.low == ends.high == 1.0
    assert evaluation.permutation_p(df, "x", "y", 99).first().p <= 0.05
    labels = spark.createDataFrame([("a", 3, 10.0), ("b", 1, 50.0), ("c", 2, 5.0)], "k string, label int, score double")
    assert [(r.better, r.worse) for r in evaluation.inversions(labels, "k", "label", "score").collect()] == [("a", "b")]
    rows = spark.createDataFrame([("g", float(k % 2), float(k % 2)) for k in range(20)], "g string, f double, y double")
    w = {r.feature: r.weight for r in evaluation.logistic_weights(rows, "g", ["f"], "y").collect()}
    assert w["f"] > 1 and w["(bias)"] < 0
    long = spark.createDataFrame([(k, n, float(k)) for k in range(6) for n in "ab"], "r int, n string, v double")
    assert [(r.a, r.b, r.rho) for r in evaluation.collinearity(long, "r", "n", "v").collect()] == [("a", "b", 1.0)]
    ev = spark.createDataFrame([(1, "s", 5), (2, "s", 5), (3, "t", 0)], "record_id int, signal string, points int")
    lb = spark.createDataFrame([(1, True), (2, False), (3, True)], "record_id int, bad boolean")
    assert [(r.signal, r.precision, r.share_bad, r.share_good) for r in evaluation.signal_table(ev, lb).collect()] == [("s", 0.5, 0.5, 1.0)]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [("s1", "f", 2, "late"), ("s1", "f", 1, "first"), ("s2", "g", 3, "x")]
    schema = "scan_id string, fingerprint string, id int, note string"
    sinks.replace_by(spark.createDataFrame(rows, schema), path, "scan_id", ["fingerprint"], "id")
    sinks.replace_by(spark.createDataFrame([("s2", "h", 9, "new")], schema), path, "scan_id", ["fingerprint"], "id")
    assert {(r.scan_id, r.fingerprint, r.note) for r in spark.read.parquet(path).collect()} == {("s1", "f", "first"), ("s2", "h", "new")}
    hidden = spark.createDataFrame([("by a@b.org and A@B.org",), (None,)], "t string").select(sinks.without_emails("t").alias("t")).collect()
    one, two = [w for w in hidden[0].t.split() if w.startswith("author-")]
    assert one == two and hidden[1].t is None
    old = spark.createDataFrame([(datetime(2020, 1, 1), "x"), (datetime(2026, 1, 1), "y")], "at timestamp, t string")
    assert [r.t for r in sinks.purged(old, ["t"], "at", F.lit(datetime(2025, 1, 1))).collect()] == [None, "y"]


def test_inversions_at_any_distance(spark):
    rows = [("far", 30.0, 0.1), ("half", 2.5, 0.3), ("near", 1.0, 0.5), ("low", 0.0, 0.4), ("none", None, 0.9)]
    df = spark.createDataFrame(rows, "k string, label double, score double")
    got = {(r.better, r.worse) for r in evaluation.inversions(df, "k", "label", "score").collect()}
    assert got == {("far", "half"), ("far", "near"), ("far", "low"), ("half", "low")}
