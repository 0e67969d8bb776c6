"""Scores from findings: damped penalties, size, half-life, weighted mean, exact what-ifs.

Every step is an aggregation or a window over (scan, category, rule). A rule with a third of
all findings of one scan is one window of that scan; across scans the work is spread by hash."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnwork.functions import findings as fn

# Fixed values of the rubric: category, analyzers, weight, half-life, severity weights by rank.
PLAIN = (0.5, 0.5, 2.0, 5.0, 10.0)
LINT = (0.1, 0.1, 0.5, 1.5, 3.0)
CATEGORIES = (
    ("security", ("semgrep", "bandit"), 0.40, 12.0, PLAIN),
    ("dependencies", ("dependency",), 0.20, 25.0, PLAIN),
    ("architecture", ("architecture",), 0.20, 20.0, PLAIN),
    ("code_health", ("ruff",), 0.20, 25.0, LINT),
)
CORROBORATED, IN_TESTS, DAMPING = 1.25, 0.2, -0.75
MODULES_PER_UNIT, LARGEST_SECURITY_FACTOR = 20, 6.0


def _by_category(category: Column, values: dict[str, Column | float]) -> Column:
    out = None
    for name, v in values.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(category == name, v) if out is None else out.when(category == name, v)
    return out


def category_of(analyzer: Column) -> Column:
    out = F.when(analyzer.isNull(), None)
    for name, analyzers, *_ in CATEGORIES:
        out = out.when(analyzer.isin(*analyzers), name)
    return out


def weighted(findings: DataFrame) -> DataFrame:
    """Adds category, rule and weight; findings of other analyzers are left out."""
    category = F.col("category_name")
    rank = fn.severity_rank(F.col("severity"))
    base = _by_category(category, {n: F.get(F.array(*map(F.lit, w)), rank) for n, _, _, _, w in CATEGORIES})
    weight = (
        base
        * F.when(F.size("corroborated_by") > 0, CORROBORATED).otherwise(1.0)
        * F.when(fn.is_test_path(F.col("file_path")), IN_TESTS).otherwise(1.0)
    )
    return (
        findings.withColumn("category_name", category_of(F.col("analyzer")))
        .where("category_name is not null")
        .withColumns({"rule": F.concat_ws(":", "analyzer", "rule_id"), "weight": weight})
    )


def ranked(weights: DataFrame) -> DataFrame:
    """Adds a finding's place i in its rule and its part weight / i^0.75 of the penalty."""
    order = Window.partitionBy("scan_id", "category_name", "rule").orderBy(F.desc("weight"), "id")
    return weights.withColumn("place", F.row_number().over(order)).withColumn(
        "part", F.col("weight") * F.pow("place", F.lit(DAMPING))
    )


def rule_penalties(weights: DataFrame) -> DataFrame:
    return (
        ranked(weights)
        .groupBy("scan_id", "category_name", "rule")
        .agg(F.sum("part").alias("rule_penalty"), F.count(F.lit(1)).alias("n_findings"))
    )


def removal_penalties(weights: DataFrame) -> DataFrame:
    """Adds `without`: the rule's penalty if this finding alone were gone, in closed form: later
    findings move up one place. No finding is rescored."""
    whole = Window.partitionBy("scan_id", "category_name", "rule")
    later = whole.orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    up = F.col("weight") * (F.pow(F.col("place") - 1, F.lit(DAMPING)) - F.pow("place", F.lit(DAMPING)))
    return (
        ranked(weights)
        .withColumn("up", F.when(F.col("place") > 1, up).otherwise(0.0))
        .withColumns(
            {
                "rule_penalty": F.sum("part").over(whole),
                "gain": F.coalesce(F.sum("up").over(later), F.lit(0.0)),
            }
        )
        .withColumn("without", F.col("rule_penalty") - F.col("part") + F.col("gain"))
    )


def size_factor(category: Column, loc: Column, modules: Column) -> Column:
    """What a penalty is divided by; at least 1."""
    kloc = F.greatest(F.lit(1.0), loc / 1000)
    return _by_category(
        category,
        {
            "security": F.least(F.lit(LARGEST_SECURITY_FACTOR), F.pow(kloc, F.lit(1 / 3))),
            "dependencies": 1.0,
            "architecture": F.sqrt(F.greatest(F.lit(1.0), modules / MODULES_PER_UNIT)),
            "code_health": F.sqrt(kloc),
        },
    )


def half_life_score(penalty: Column, half_life: Column) -> Column:
    return 100 * F.exp(-penalty * math.log(2) / half_life)


def category_scores(findings: DataFrame, sizes: DataFrame) -> DataFrame:
    """(scan_id, category_name, penalty, score, weight, n_findings); sizes has scan_id, loc, modules.

    A category counts where one of its analyzers reported. Missing sizes count as the least.
    Weights are the shares among the counted categories."""
    category = F.col("category_name")
    half = _by_category(category, {n: h for n, _, _, h, _ in CATEGORIES})
    share = _by_category(category, {n: w for n, _, w, _, _ in CATEGORIES})
    raw = (
        rule_penalties(weighted(findings))
        .groupBy("scan_id", "category_name")
        .agg(F.sum("rule_penalty").alias("raw"), F.sum("n_findings").alias("n_findings"))
    )
    sized = raw.join(sizes, "scan_id", "left").withColumn(
        "size", size_factor(category, F.coalesce("loc", F.lit(0)), F.coalesce("modules", F.lit(0)))
    )
    return sized.withColumn("penalty", F.col("raw") / F.col("size")).select(
        "scan_id",
        "category_name",
        "penalty",
        "size",
        "n_findings",
        half_life_score(F.col("penalty"), half).alias("score"),
        (share / F.sum(share).over(Window.partitionBy("scan_id"))).alias("weight"),
    )


def overall_scores(categories: DataFrame) -> DataFrame:
    out = categories.groupBy("scan_id").agg(F.sum(F.col("score") * F.col("weight")).alias("overall"))
    return out.withColumn("grade", fn.grade(F.round("overall", 2)))


def impacts(findings: DataFrame, sizes: DataFrame) -> DataFrame:
    """(scan_id, id, impact): the points each finding's removal alone would add to its scan."""
    half = _by_category(F.col("category_name"), {n: h for n, _, _, h, _ in CATEGORIES})
    per = removal_penalties(weighted(findings)).drop("weight").join(category_scores(findings, sizes), ["scan_id", "category_name"])
    penalty = F.greatest(F.lit(0.0), F.col("penalty") * F.col("size") - F.col("rule_penalty") + F.col("without"))
    gain = (half_life_score(penalty / F.col("size"), half) - F.col("score")) * F.col("weight")
    return per.select("scan_id", "id", F.greatest(F.lit(0.0), gain).alias("impact"))


def category_deltas(base: DataFrame, head: DataFrame, by: str) -> DataFrame:
    """(by, name, before, after, delta) of categories as arrays of (name, score), a category of one side only with
    a null on the other."""
    sides = {c: df.select(by, F.inline("categories")).select(by, "name", F.col("score").alias(c)) for c, df in (("before", base), ("after", head))}
    return sides["before"].join(sides["after"], [by, "name"], "full").withColumn("delta", F.col("after") - F.col("before"))
