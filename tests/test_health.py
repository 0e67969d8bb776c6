import numpy as np
from pyspark.sql import functions as F

from kilnwork.operators import dependencies as deps
from kilnwork.operators import evaluation, signals, stats


def test_unused_dependencies(spark):
    declared = spark.createDataFrame([("r", "pypi", n) for n in ("Flask_Login", "numpy", "ruff", "six", "zope.interface")] + [("r", "npm", "@s/p"), ("r", "npm", "left-pad")], "repo string, ecosystem string, name string")
    used = spark.createDataFrame([("r", "pypi", "flask-login"), ("q", "pypi", "six")], "repo string, ecosystem string, name string")
    corpus = spark.createDataFrame([("r", "see numpy.linalg, x.six or six-pack; use @s/p/deep. ZOPE.interface"), ("r", None)], "repo string, text string")
    got = {r.name for r in deps.unused(declared, used, corpus, ["ruf?"]).collect()}
    assert got == {"six", "left-pad"}
    assert deps.unused(declared.limit(0), used, corpus, []).count() == 0


def test_payloads_of_another_shape(spark):
    rows = [("pypi", "a", '{"releases": {"1": [{"size": 5, "yanked": true}], "2": [{"size": 7}, {"size": 3}], "3": []}, "info": {"version": "2"}}'), ("npm", "b", "[]"), ("npm", "c", None), ("npm", "d", '{"versions": {"1": {}}}')]
    got = {tuple(r) for r in deps.registry_versions(spark.createDataFrame(rows, "ecosystem string, name string, payload string")).collect()}
    assert got == {("pypi", "a", "2", 3, None, "2"), ("npm", "d", "1", None, None, None)}


def test_missing_components_do_not_count(spark):
    df = spark.createDataFrame([({"a": 0.5, "b": None},), ({"a": None},), ({},), (None,)], "m map<string, double>")
    assert [r[0] for r in df.select(signals.mean_of(F.col("m"))).collect()] == [0.5, None, None, None]
    none = spark.createDataFrame([(None,), (2.0,), (-1.0,)], "v double")
    assert [r[0] for r in none.select(deps.clamp01(F.col("v"))).collect()] == [None, 1.0, 0.0]


def test_no_tests_score_nothing(spark):
    files = spark.createDataFrame([("s", False, 100, 0, 0, 0, "unit")], "scan_id string, is_test boolean, loc int, tests int, assertions int, without int, kind string")
    r = signals.test_quality(files).first()
    assert (r.test_presence, r.assertion_density, r.score) == (0.0, None, 0.0)


def test_fitted_weights_against_all_supports(spark):
    """The best fit over every choice of features that may be above 0."""
    rng = np.random.default_rng(3)
    x = rng.random((40, 3))
    y = 2 * x[:, 0] - 1.5 * x[:, 1] + 0.5 * x[:, 2] + 0.1 * rng.random(40)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    got = {r.feature: r.weight for r in evaluation.fitted_weights(df, ["a", "b", "c"], "y").collect()}
    full, goal, best = np.hstack([x, np.ones((40, 1))]), y - y.min() + 1, None
    for mask in range(16):
        cols = [k for k in range(4) if mask >> k & 1]
        w = np.zeros(4)
        if cols:
            w[cols] = np.linalg.lstsq(full[:, cols], goal, rcond=None)[0]
        if (w >= 0).all() and (best is None or ((full @ w - goal) ** 2).sum() < best[0]):
            best = ((full @ w - goal) ** 2).sum(), w
    want = best[1][:3] / best[1][:3].sum()
    assert np.allclose([got[f] for f in "abc"], want, atol=1e-5)


def test_paired_differences(spark):
    rows = [(float(k), float(k % 5), float(k)) for k in range(30)]
    r = evaluation.paired_differences(spark.createDataFrame(rows, "a double, b double, l double"), "a", "b", "l", 200).first()
    assert r.point > 0.5 and r.low > 0 and r.improves == 1.0
    assert evaluation.paired_differences(spark.createDataFrame(rows[:2], "a double, b double, l double"), "a", "b", "l").first().point is None


def test_paired_draws_are_neither_joined_nor_shuffled(spark):
    rows = spark.createDataFrame([(float(k * 7 % 5), float(k % 4), float(k // 3)) for k in range(40)], "a double, b double, l double")
    out = evaluation.paired_differences(rows, "a", "b", "l", 60)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # the differences to their percentiles
    numbered = evaluation._numbered(rows, "a", "b", "l")
    drawn = spark.range(60).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("k"))
    picks = drawn.select("replicate", F.pmod(F.xxhash64("replicate", "k", F.lit(7)), F.lit(40)).alias("i")).join(F.broadcast(numbered), "i")
    rho = [{r.replicate: r.rho for r in evaluation.replicate_correlations(None, c, "l", picks).collect()} for c in "ab"]
    d = [rho[0][k] - rho[1][k] for k in rho[0]]
    r = out.first()
    assert np.allclose([r.low, r.high, r.improves], [*np.percentile(d, [2.5, 97.5]), np.mean(np.array(d) > 0)])
    assert np.isclose(r.point, stats.spearman(rows, "a", "l").first().rho - stats.spearman(rows, "b", "l").first().rho)


def test_collinear_series_with_ties(spark):
    rows = [(k, n, v) for k in range(20) for n, v in (("a", float(k // 3)), ("b", float(-(k // 3))), ("c", None if k % 2 else float(k)))]
    got = {(r.a, r.b): (r.n, round(r.rho, 6)) for r in evaluation.collinearity(spark.createDataFrame(rows, "r int, n string, v double"), "r", "n", "v").collect()}
    assert got[("a", "b")] == (20, -1.0) and got[("a", "c")][0] == 10
