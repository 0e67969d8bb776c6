"""Resampling, fits and label comparisons. Replicates are rows, so they spread over the cluster;
a fit runs on one group's rows, of which the caller states the bound."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnwork.operators import stats
from kilnwork.runtime import small_enough


def _mean_ranks(df: DataFrame, by: list[str], value: str) -> Column:
    same = Window.partitionBy(*by, value)
    order = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(same) - 1) / 2


def replicate_correlations(df: DataFrame, x: str, y: str, draws: DataFrame) -> DataFrame:
    """(replicate, rho) of rank correlations over `draws`: rows (replicate, x, y)."""
    ranked = draws.select("replicate", _mean_ranks(draws, ["replicate"], x).alias("rx"), _mean_ranks(draws, ["replicate"], y).alias("ry"))
    out = ranked.groupBy("replicate").agg(F.corr("rx", "ry").alias("rho"))
    return out.where(F.col("rho").isNotNull() & ~F.isnan("rho"))


MOST_LABELLED = 100_000


def _numbered(df: DataFrame, x: str, y: str, *more: str) -> DataFrame:
    """Labelled rows with numbers from 0, given in one task; more than MOST_LABELLED are refused."""
    both = df.select(x, y, *more).na.drop()
    if not small_enough(both, MOST_LABELLED):
        raise ValueError("too many labelled rows to resample")
    return both.withColumn("i", F.row_number().over(Window.orderBy(x, y, *more)) - 1)


def bootstrap_interval(df: DataFrame, x: str, y: str, replicates: int = 5000, seed: int = 7) -> DataFrame:
    """One row (low, high): the 2.5 and 97.5 percentiles of resampled rank correlations; null if
    under nine tenths of the replicates have one. Draws are hashes, the same on every run."""
    rows = _numbered(df, x, y)
    n = rows.count()
    if n < 3:
        return df.sparkSession.sql("select cast(null as double) low, cast(null as double) high")
    r = df.sparkSession.range(replicates).select(F.col("id").alias("replicate"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    picks = r.select("replicate", F.pmod(F.xxhash64("replicate", "k", F.lit(seed)), F.lit(n)).cast("int").alias("i"))
    rho = replicate_correlations(df, x, y, picks.join(F.broadcast(rows), "i"))
    ends = [F.percentile("rho", p) for p in (0.025, 0.975)]
    enough = F.count(F.lit(1)) >= 0.9 * replicates
    return rho.agg(*[F.when(enough, e).alias(c) for e, c in zip(ends, ("low", "high"))])


def permutation_p(df: DataFrame, x: str, y: str, replicates: int = 2000, seed: int = 11) -> DataFrame:
    """One row (p): the share of shuffles that correlate at least as much, one-sided, (hits+1)/(B+1)."""
    rows = _numbered(df, x, y)
    observed = stats.spearman(df, x, y).first()["rho"]
    each = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    shuffled = each.withColumn("j", F.row_number().over(Window.partitionBy("replicate").orderBy(F.xxhash64("replicate", "i", F.lit(seed)), "i")) - 1)
    swapped = shuffled.select("replicate", x, "j").join(rows.select(F.col("i").alias("j"), y), "j")
    rho = replicate_correlations(df, x, y, swapped)
    return rho.agg(((F.count_if(F.col("rho") >= (observed if observed is not None else 2.0) - 1e-12) + 1) / (replicates + 1)).alias("p"))


def inversions(df: DataFrame, key: str, label: str, score: str, gap: int = 2, most_labels: int = 10_000) -> DataFrame:
    """(better, worse): labels at least `gap` apart whose scores are the other way round. Labels
    are few, so all pairs of labels are met first, then rows by equality; more than most_labels
    are refused."""
    labels = [r[0] for r in df.select(label).where(F.col(label).isNotNull() & ~F.isnan(label)).distinct().limit(most_labels + 1).collect()]
    if len(labels) > most_labels:
        raise ValueError("too many labels to meet each other")
    kind = dict(df.dtypes)[label]
    pairs = [(hi, lo) for hi in labels for lo in labels if hi - lo >= gap]
    pairs = df.sparkSession.createDataFrame(pairs, f"hi {kind}, lo {kind}")
    a = df.select(F.col(key).alias("better"), F.col(label).alias("hi"), F.col(score).alias("sa"))
    b = df.select(F.col(key).alias("worse"), F.col(label).alias("lo"), F.col(score).alias("sb"))
    return a.join(pairs, "hi").join(b, "lo").where("sa < sb").select("better", "worse")


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 4000, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """(weights, bias) by gradient steps; the bias isn't penalised."""
    w, b, n = np.zeros(x.shape[1]), 0.0, max(1, len(y))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w -= rate * (x.T @ (p - y) + l2 * w) / n
        b -= rate * float((p - y).sum()) / n
    return w, b


def logistic_weights(df: DataFrame, by: str, features: list[str], label: str, most: int = 100_000) -> DataFrame:
    """(by, feature, weight) of one fit per group, on its first `most` rows in order of a hash."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        w, b = logistic(pdf[features].to_numpy(float), pdf[label].to_numpy(float))
        return pd.DataFrame({by: pdf[by].iloc[0], "feature": [*features, "(bias)"], "weight": [*w, b]})

    order = Window.partitionBy(by).orderBy(F.xxhash64(*features, label))
    bounded = df.select(by, *features, label).na.drop().withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")
    return bounded.groupBy(by).applyInPandas(fit, f"{by} {dict(df.dtypes)[by]}, feature string, weight double")


def collinearity(long: DataFrame, row: str, name: str, value: str, least: int = 5) -> DataFrame:
    """(a, b, n, rho) of every pair of series with at least `least` common rows, ranked among those; names
    are few.

    A row's values are one array, so a pair meets without a join. Ranks come from counts by distinct value,
    and a value that many rows have is one count per task."""
    held = long.where(F.col(value).isNotNull() & F.col(name).isNotNull()).groupBy(F.col(row).alias("_r")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(name).alias("n"), F.col(value).cast("double").alias("v")))).alias("s")
    )
    each = held.select(F.explode("s").alias("p"), "s").select("p", F.explode("s").alias("q")).where("p.n < q.n")
    both = each.select(F.col("p.n").alias("a"), F.col("q.n").alias("b"), F.col("p.v").alias("x"), F.col("q.v").alias("y"))
    cells = both.groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("c"))
    for side in ("x", "y"):
        n = cells.groupBy("a", "b", side).agg(F.sum("c").alias("m"))
        below = F.sum("m").over(Window.partitionBy("a", "b").orderBy(side)) - F.col("m")
        cells = cells.join(n.select("a", "b", side, (below + (F.col("m") + 1) / 2).alias(f"r{side}")), ["a", "b", side])
    rho = stats.weighted_correlation(F.col("c"), F.col("rx"), F.col("ry"))
    return cells.groupBy("a", "b").agg(F.sum("c").alias("n"), rho.alias("rho")).where(F.col("n") >= least)


def signal_table(evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """(signal, fired, fired_bad, precision, share_bad, share_good) over records (record_id, bad)."""
    n = labels.agg(F.count_if("bad").alias("bad_n"), F.count_if(~F.col("bad")).alias("good_n")).first()
    fired = evidence.where("points > 0").select("record_id", "signal").distinct().join(labels, "record_id")
    out = fired.groupBy("signal").agg(F.count(F.lit(1)).alias("fired"), F.count_if("bad").alias("fired_bad"))
    return out.select(
        "signal", "fired", "fired_bad",
        (F.col("fired_bad") / F.col("fired")).alias("precision"),
        F.try_divide("fired_bad", F.lit(n.bad_n)).alias("share_bad"),
        F.try_divide(F.col("fired") - F.col("fired_bad"), F.lit(n.good_n)).alias("share_good"),
    )


def score_without(evidence: DataFrame, left_out: str, most: int = 100) -> DataFrame:
    """(record_id, score): points without one category, within 0 and `most`."""
    kept = F.sum(F.when(F.col("category") == left_out, 0).otherwise(F.col("points")))
    return evidence.groupBy("record_id").agg(F.least(F.lit(most), F.greatest(F.lit(0), F.round(kept))).cast("int").alias("score"))


def best_threshold(confusion: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The row of the greatest f1, of equals the one with the lowest threshold."""
    first = F.max_by(F.struct(*confusion.columns), F.struct("f1", -F.col("threshold"))).alias("b")
    return (confusion.groupBy(*by) if by else confusion).agg(first).select("b.*")


def run_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, n) of runs (key, ok, signals): '+signal' and '-signal' over keys that both runs have."""
    both = after.where("ok").select("key", F.col("signals").alias("new")).join(before.where("ok").select("key", F.col("signals").alias("old")), "key")
    gained = F.transform(F.array_except("new", "old"), lambda s: F.concat(F.lit("+"), s))
    lost = F.transform(F.array_except("old", "new"), lambda s: F.concat(F.lit("-"), s))
    return both.select(F.explode(F.concat(gained, lost)).alias("change")).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def subsets(names: list[str], alternatives: dict[str, tuple[str, list[str]]] | None = None) -> list[dict[str, object]]:
    """Every subset of the names as a configuration. alternatives: a setting that doubles the subsets that
    hold one of the names it depends on, by (value, names)."""
    out: list[dict[str, object]] = []
    for mask in range(1 << len(names)):
        chosen = [n for k, n in enumerate(names) if mask >> k & 1]
        each: list[dict[str, object]] = [{"names": chosen}]
        for setting, (value, needs) in (alternatives or {}).items():
            if set(needs) & set(chosen):
                each += [c | {setting: value} for c in each]
        out += each
    return sorted(out, key=lambda c: (len(c["names"]), c["names"], len(c)))


def fitted_weights(df: DataFrame, features: list[str], label: str, most: int = 100_000) -> DataFrame:
    """(feature, weight) that explain the label with a free level, as shares of their sum; equal ones if all are
    0. A missing feature counts as the mean of the row's others. The sums of products are one aggregation, so
    rows don't reach the driver."""
    have = F.array_compact(F.array(*features))
    mean = F.aggregate(have, F.lit(0.0), lambda a, v: a + v) / F.size(have)
    rows = df.where(F.col(label).isNotNull() & (F.size(have) > 0)).select(*[F.coalesce(f, mean).alias(f"f{k}") for k, f in enumerate(features)], F.lit(1.0).alias(f"f{len(features)}"), F.col(label).cast("double").alias("y"))
    n = len(features) + 1
    low = rows.agg(F.min("y")).first()[0]
    products = [F.sum(F.col(f"f{i}") * F.col(f"f{j}")) for i in range(n) for j in range(n)]
    sums = rows.agg(*products, *[F.sum(F.col(f"f{i}") * (F.col("y") - F.lit(low or 0.0) + 1)) for i in range(n)]).first()
    g = np.array([v or 0.0 for v in sums[: n * n]], float).reshape(n, n)
    w = _descend(g, np.array([v or 0.0 for v in sums[n * n :]], float))[:-1]
    w = w / w.sum() if w.sum() > 0 else np.full(len(features), 1 / len(features))
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, w)], "feature string, weight double")


def _descend(g: np.ndarray, c: np.ndarray, steps: int = 100_000) -> np.ndarray:
    w = np.zeros(len(c))
    for _ in range(steps):
        last = w.copy()
        for k in range(len(c)):
            if g[k, k] > 0:
                w[k] = max(0.0, w[k] + (c[k] - g[k] @ w) / g[k, k])
        if np.abs(w - last).max() < 1e-13:
            return w
    raise RuntimeError("weights have not settled")


def _drawn_correlation(x: np.ndarray, y: np.ndarray, drawn: np.ndarray) -> float:
    """The rank correlation of rows that each stand for as many as were drawn; NaN where a side is constant.
    x and y: the places of the rows' values among the distinct ones."""
    r = []
    for codes in (x, y):
        same = np.bincount(codes, weights=drawn)
        r.append((np.cumsum(same) - (same - 1) / 2)[codes] - (drawn.sum() + 1) / 2)
    apart = (drawn @ r[0] ** 2) * (drawn @ r[1] ** 2)
    return float(drawn @ (r[0] * r[1]) / np.sqrt(apart)) if apart > 0 else float("nan")


def paired_differences(df: DataFrame, a: str, b: str, label: str, replicates: int = 2000, seed: int = 7) -> DataFrame:
    """One row (point, low, high, improves): the rank correlation of a less that of b with the label, its
    interval over resamples that draw the same rows for both, and the share of them in which it is above 0.

    The places of the values, MOST_LABELLED at most, go to every task; a replicate is drawn and counted in one
    task, so no draw is shuffled or broadcast."""
    rows = _numbered(df, a, b, label).toPandas().sort_values("i")
    n = len(rows)
    if n < 3:
        return df.sparkSession.sql("select cast(null as double) point, cast(null as double) low, cast(null as double) high, cast(null as double) improves")
    x, z, y = (pd.factorize(rows[c], sort=True)[0] for c in (a, b, label))

    def differences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = ((r, own.to_numpy()) for pdf in batches for r, own in pdf.groupby("replicate")["i"])
        for _, each in groupby(pieces, lambda p: p[0]):
            drawn = sum(np.bincount(i, minlength=n) for _, i in each)
            yield pd.DataFrame({"d": [_drawn_correlation(x, y, drawn) - _drawn_correlation(z, y, drawn)]})

    # A sequence of literals would be folded into the plan with all its values.
    drawn = df.sparkSession.range(replicates).select(F.posexplode(F.array_repeat("id", n)).alias("k", "replicate"))
    picks = drawn.select("replicate", F.pmod(F.xxhash64("replicate", "k", F.lit(seed)), F.lit(n)).cast("int").alias("i"))
    delta = picks.mapInPandas(differences, "d double").where("d is not null and not isnan(d)")
    point = _drawn_correlation(x, y, np.ones(n)) - _drawn_correlation(z, y, np.ones(n))
    return delta.agg(F.lit(None if np.isnan(point) else point).cast("double").alias("point"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), F.avg((F.col("d") > 0).cast("int")).alias("improves"))


def relabelled(findings: DataFrame, packages: DataFrame) -> DataFrame:
    """Findings of dependencies with their package as the rule, so that one upgrade is one rule."""
    named = packages.select("scan_id", "id", "package").dropDuplicates(["scan_id", "id"])
    out = findings.join(named, ["scan_id", "id"], "left")
    return out.withColumn("rule_id", F.when(F.col("analyzer") == "dependency", F.coalesce("package", "rule_id")).otherwise(F.col("rule_id"))).drop("package")


def one_per_component(findings: DataFrame, is_cycle: Column, components: DataFrame) -> DataFrame:
    """Findings with each scan's cycles replaced by one for each of its components (scan_id, place, severity)."""
    rest = findings.where(~is_cycle).select("scan_id", "id", "analyzer", "rule_id", "severity")
    had = findings.where(is_cycle).select("scan_id").distinct()
    last = findings.groupBy("scan_id").agg(F.max("id").alias("last"))
    new = components.join(had, "scan_id", "left_semi").join(last, "scan_id")
    new = new.select("scan_id", (F.col("last") + F.col("place")).alias("id"), F.lit("architecture").alias("analyzer"), F.lit("cycle").alias("rule_id"), "severity")
    return rest.unionByName(new)


def ablation(evidence: DataFrame, labels: DataFrame, most: int = 100) -> DataFrame:
    """(signal, auc, auc_without, drop): how well the clamped sum of points ranks bad records (record_id, bad)
    before good ones, and how well without each signal.

    Records are counted by score; for a signal only the records that have it change place, so no record meets
    every signal. A signal counts once a record, with its points summed."""
    each = evidence.groupBy("record_id", "signal").agg(F.sum("points").alias("p"))
    total = each.groupBy("record_id").agg(F.sum("p").alias("t"))
    clamp = lambda c: F.least(F.lit(most), F.greatest(F.lit(0), F.round(c))).cast("int")
    scored = labels.join(total, "record_id", "left").select("record_id", F.col("bad").cast("int").alias("bad"), F.coalesce("t", F.lit(0)).alias("t"))
    base = scored.groupBy(clamp(F.col("t")).alias("score"), "bad").agg(F.count(F.lit(1)).alias("n"))
    moved = each.join(scored, "record_id").select("signal", "bad", F.explode(F.array(F.struct(clamp(F.col("t")).alias("score"), F.lit(-1).alias("n")), F.struct(clamp(F.col("t") - F.col("p")).alias("score"), F.lit(1).alias("n")))).alias("m"))
    moved = moved.groupBy("signal", "m.score", "bad").agg(F.sum("m.n").alias("n"))
    names = each.select("signal").distinct().withColumn("_one", F.lit(1))
    every = base.withColumn("_one", F.lit(1)).join(names, "_one").select("signal", "score", "bad", "n")  # few names, few scores
    cells = every.unionByName(moved.select("signal", "score", "bad", "n")).unionByName(base.select(F.lit("").alias("signal"), "score", "bad", "n"))
    cells = cells.groupBy("signal", "score").agg(F.sum(F.when(F.col("bad") == 1, F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad") == 0, F.col("n")).otherwise(0)).alias("g"))
    below = F.coalesce(F.sum("g").over(Window.partitionBy("signal").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cells.withColumn("w", F.col("b") * (below + F.col("g") / 2))
    auc = ranked.groupBy("signal").agg(F.try_divide(F.sum("w"), F.sum("b") * F.sum("g")).alias("a"))
    whole = auc.where("signal = ''").first()
    out = auc.where("signal <> ''").select("signal", F.lit(whole.a if whole else None).cast("double").alias("auc"), F.col("a").alias("auc_without"))
    return out.withColumn("drop", F.col("auc") - F.col("auc_without"))
