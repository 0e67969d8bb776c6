"""Repository signals: components to scores, what they deduct, and the signals themselves from counts.

A component that can't be had is null and doesn't count; a signal is the mean of those that can."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnwork.operators.dependencies import clamp01

STRENGTH = 1.0  # fixed value: half-lives that a signal of 0 deducts
# Name, label, category and components of signals that deduct.
TARGETS = (
    ("error_handling", "Error handling", "code_health", None),
    ("test_quality", "Test quality", "code_health", None),
    ("dep_health", "Dependency health", "dependencies", ("direct_count", "freshness", "transitive", "trivial")),
    ("dep_health", "Dependency hygiene", "architecture", ("unused", "phantom")),
    ("git_history", "Git history", "architecture", None),
    ("ci_quality", "CI pipeline", "architecture", None),
)
# Packages and names that tell what a test file tests.
WHOLE_PACKAGES = "playwright @playwright/test selenium cypress puppeteer pyppeteer".split()
SWALLOWING = ("bare-except", "swallowed-broad-except", "empty-catch", "comment-only-catch")
UNHANDLED = ("unhandled-promise", "await-io-outside-try")
TEST_RATIO, ASSERTIONS = 0.3, 2.0


def mean_of(components: Column) -> Column:
    """The mean of a map's values that aren't null; null if none is."""
    have = F.filter(F.map_values(components), lambda v: v.isNotNull())
    total = F.aggregate(have, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(have) > 0, total / F.size(have))


def signal_values(signals: DataFrame, targets: tuple = TARGETS) -> DataFrame:
    """(scan_id, place, signal, label, category, value) of signals (scan_id, name, applicable, score,
    components): the score, or the mean of the named components; null if there is none."""
    spark = signals.sparkSession
    rows = [(k, *t[:3], list(t[3]) if t[3] else None) for k, t in enumerate(targets)]
    wanted = spark.createDataFrame(rows, "place int, name string, label string, category string, parts array<string>")
    have = signals.join(wanted, "name")
    part = F.map_filter("components", lambda k, v: F.array_contains("parts", k))
    value = F.when(F.col("applicable"), F.when(F.col("parts").isNull(), F.col("score")).otherwise(mean_of(part)))
    return have.select("scan_id", "place", F.col("name").alias("signal"), "label", "category", value.alias("value"))


def deductions(categories: DataFrame, values: DataFrame, half_lives: dict[str, float]) -> DataFrame:
    """(scan_id, category_name, place, signal, penalty, points): what each signal takes from its category, in
    order; categories have scan_id, category_name, penalty."""
    half = F.element_at(F.create_map(*[F.lit(x) for kv in half_lives.items() for x in kv]), F.col("category_name"))
    own = values.where("value is not null").withColumnRenamed("category", "category_name")
    both = categories.select("scan_id", "category_name", F.col("penalty").alias("base")).join(own, ["scan_id", "category_name"])
    both = both.withColumn("penalty", half * STRENGTH * (1 - clamp01(F.col("value"))))
    so_far = F.sum("penalty").over(Window.partitionBy("scan_id", "category_name").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    after = F.col("base") + so_far
    score = lambda p: 100 * F.exp(-p * math.log(2) / half)
    points = score(after - F.col("penalty")) - score(after)
    return both.select("scan_id", "category_name", "place", "signal", "penalty", points.alias("points"))


def assessed_categories(specs: DataFrame, ran: DataFrame) -> DataFrame:
    """(scan_id, category, state) of specs (category, analyzers) and ran (scan_id, ran array, failed array):
    'failed' if one of its analyzers did, 'scored' if one ran, else 'not applicable'."""
    each = ran.select("scan_id", "ran", "failed").withColumn("a", F.explode(F.array_union("ran", "failed")))
    met = specs.select("category", "analyzers", F.explode("analyzers").alias("a")).join(each, "a")
    met = met.groupBy("scan_id", "category").agg(F.bool_or(F.arrays_overlap("analyzers", "failed")).alias("f"))
    every = ran.select("scan_id", F.explode(F.array(*[F.lit(r.category) for r in specs.select("category").collect()])).alias("category"))
    state = F.when(F.col("f"), "failed").when(F.col("f").isNotNull(), "scored").otherwise("not applicable")
    return every.join(met, ["scan_id", "category"], "left").select("scan_id", "category", state.alias("state"))


def stored(results: DataFrame) -> DataFrame:
    """(scan_id, signals): a map of each scan's reports by name; one that failed isn't applicable. results:
    scan_id, name, status, score, reason."""
    failed = F.col("status") == "failed"
    report = F.struct(
        (~failed & F.col("score").isNotNull()).alias("applicable"),
        F.when(~failed, F.col("score")).alias("score"),
        F.when(failed, F.coalesce("reason", F.lit("failed"))).otherwise(F.col("reason")).alias("reason"),
    )
    once = results.groupBy("scan_id", "name").agg(F.max(report).alias("report"))
    return once.groupBy("scan_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "report"))).alias("signals"))


def error_handling(rules: DataFrame, sites: DataFrame, by: str = "scan_id") -> DataFrame:
    """(by, swallow_rate, io_wrapped_ratio, promise_handling, score): rules has (by, rule), sites
    (by, handlers, io_sites, io_wrapped, promise_sites)."""
    n = rules.groupBy(by).agg(F.count_if(F.col("rule").isin(*SWALLOWING)).alias("s"), F.count_if(F.col("rule").isin(*UNHANDLED)).alias("u"))
    all_ = sites.join(n, by, "left").fillna(0, ["s", "u"])
    parts = {
        "swallow_rate": F.when(F.col("handlers") > 0, 1 - F.col("s") / F.col("handlers")),
        "io_wrapped_ratio": F.when(F.col("io_sites") > 0, F.col("io_wrapped") / F.col("io_sites")),
        "promise_handling": F.when(F.col("promise_sites") > 0, 1 - F.col("u") / F.col("promise_sites")),
    }
    return _scored(all_.select(by, *[c.alias(k) for k, c in parts.items()]), list(parts))


def _scored(df: DataFrame, parts: list[str]) -> DataFrame:
    """Adds score: the mean of the parts clamped to [0, 1], as far as there are any."""
    return df.withColumn("score", mean_of(F.create_map(*[x for p in parts for x in (F.lit(p), clamp01(F.col(p)))])))


def test_kind(path: Column, packages: Column, names: Column, integration: list[str]) -> Column:
    """'e2e', 'integration' or 'unit', by the path first and what the file imports."""
    whole = F.lower(path).contains("e2e") | F.arrays_overlap(packages, F.array(*map(F.lit, WHOLE_PACKAGES)))
    part = F.lower(path).contains("integration") | F.arrays_overlap(packages, F.array(*map(F.lit, integration))) | F.array_contains(names, "TestClient")
    return F.when(F.coalesce(whole, F.lit(False)), "e2e").when(F.coalesce(part, F.lit(False)), "integration").otherwise("unit")


def test_quality(files: DataFrame, by: str = "scan_id") -> DataFrame:
    """(by, test_presence, assertion_density, assertion_free, type_mix, score) of files (by, is_test, loc,
    tests, assertions, without, kind). No tests at all score 0."""
    test = F.col("is_test")
    t = files.groupBy(by).agg(
        F.sum(F.when(test, F.col("loc")).otherwise(0)).alias("test_loc"),
        F.sum(F.when(~test, F.col("loc")).otherwise(0)).alias("source_loc"),
        F.sum(F.when(test, F.col("tests")).otherwise(0)).alias("n"),
        F.sum(F.when(test, F.col("assertions")).otherwise(0)).alias("a"),
        F.sum(F.when(test, F.col("without")).otherwise(0)).alias("z"),
        F.count_distinct(F.when(test, F.col("kind"))).alias("kinds"),
    )
    have = F.col("n") > 0
    presence = F.when(F.col("source_loc") > 0, clamp01(F.col("test_loc") / (TEST_RATIO * F.col("source_loc")))).otherwise(1.0)
    parts = {
        "test_presence": F.when(have, presence).otherwise(0.0),
        "assertion_density": F.when(have, clamp01(F.col("a") / F.col("n") / ASSERTIONS)),
        "assertion_free": F.when(have, 1 - F.col("z") / F.col("n")),
        "type_mix": F.when(have, F.when(F.col("kinds") >= 2, 1.0).otherwise(0.5)),
    }
    return _scored(t.select(by, *[c.alias(k) for k, c in parts.items()]), list(parts))


def ci_quality(files: DataFrame, kinds: tuple[str, ...], by: str = "scan_id") -> DataFrame:
    """(by, a part for each kind, pr_trigger, gating, score) of files (by, kinds array, on_pr, gated): whether
    any file does it; gating only where something is built."""
    each = files.groupBy(by).agg(*[F.bool_or(F.array_contains("kinds", k)).alias(k) for k in kinds], F.bool_or("on_pr").alias("on_pr"), F.bool_or("gated").alias("gated"))
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    parts = {k: yes(F.col(k)) for k in kinds} | {"pr_trigger": yes(F.col("on_pr")), "gating": F.when(F.col("build"), yes(F.col("gated")))}
    return _scored(each.select(by, *[c.alias(k) for k, c in parts.items()]), list(parts))


def conforms(language: Column, kind: Column, name: Column, const: Column) -> Column:
    """Whether an identifier follows its language's usual form."""
    bare = F.regexp_replace(F.regexp_replace(name, "^[_$]+", ""), "_+$", "")
    pascal, snake = bare.rlike("^[A-Z][a-zA-Z0-9]*$"), bare.rlike("^[a-z][a-z0-9]*(?:_[a-z0-9]+)*$")
    upper, camel = bare.rlike("^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*$"), bare.rlike("^[a-z][a-zA-Z0-9]*$")
    other = camel | ((kind == "function") & pascal) | (const & upper)
    python = snake | ((kind == "variable") & upper)
    return (bare == "") | F.when(kind == "class", pascal).when(language == "python", python).otherwise(other)


def naming(identifiers: DataFrame, by: list[str]) -> DataFrame:
    """(by, identifiers, conforming, rate, single_letter): each (name, kind, scope) of a file once."""
    once = identifiers.select(*by, "path", "language", "name", "kind", "scope", "const").distinct()
    good = conforms(F.col("language"), F.col("kind"), F.col("name"), F.col("const"))
    short = (F.col("kind") == "variable") & (F.length("name") == 1) & (F.col("name") != "_")
    out = once.groupBy(*by).agg(F.count(F.lit(1)).alias("identifiers"), F.count_if(good).alias("conforming"), F.count_if(short).alias("single_letter"))
    return out.withColumn("rate", F.col("conforming") / F.col("identifiers"))
