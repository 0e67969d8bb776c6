"""Health of dependencies, signals and evaluation over what findings hold of packages, tools and tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.functions import findings as fn
from kilnwork.functions import paths as fp
from kilnwork.operators import dependencies as deps
from kilnwork.operators import evaluation, signals
from kilnwork.plans import modules, usage
from kilnwork.plans.derived import _EVIDENCE, _evidence
from kilnwork.plans.findings import _F, _RANK, _S, findings, scans
from kilnwork.runtime import one_per_key, table


def _rank() -> Column:
    return fn.severity_rank(F.col("severity"))


def _packages(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).where("scan_id is not null and dependency.package is not null")
    return f.select(F.col("scan_id").alias("repo"), "id", "dependency.ecosystem", F.col("dependency.package").alias("name"), F.col("dependency.installed_version").alias("version"), _rank().alias("rank"), F.coalesce("file_path", F.lit("")).alias("path"), F.coalesce("start_line", F.lit(0)).alias("line"))


def declared(spark: SparkSession, d: str) -> DataFrame:
    p = _packages(spark, d).groupBy(*deps.BY).agg(F.max("rank").alias("r"), F.max("version").alias("version"))
    return p.select(*deps.BY, F.when(F.col("r") >= 3, "runtime").when(F.col("r") >= 1, "dev").otherwise("optional").alias("kind"), "version")


def jn15_unused(spark: SparkSession, d: str) -> DataFrame:
    """Packages of warnings count as imported, those of errors as mentioned."""
    p = _packages(spark, d)
    corpus = p.where("rank = 3").select("repo", F.concat(F.lit("- run: "), "name", F.lit(".main --all, twice")).alias("text"))
    return deps.unused(declared(spark, d), p.where("rank = 2"), corpus, ["*-test", "flask?*"]).select(*deps.BY, "kind")


def jn16_undeclared(spark: SparkSession, d: str) -> DataFrame:
    p = _packages(spark, d)
    return deps.undeclared(p, p.where("rank >= 2"))


def agg26_direct_counts(spark: SparkSession, d: str) -> DataFrame:
    out = deps.direct_counts(declared(spark, d), {"npm": 2, "PyPI": 3})
    return out.withColumn("component", F.round("component", 6))


def mth02_transitive(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(deps.transitive_component(F.col("p_partkey"), F.col("p_size")), 6).alias("component"))


def prj27_tools_by_name(spark: SparkSession, d: str) -> DataFrame:
    n = _packages(spark, d).select("name").distinct()
    return n.select("name", fp.matches_any(F.col("name"), ["flask*", "*-test", "?a*-d?cs"]).alias("tool"))


def tk14_budget(spark: SparkSession, d: str) -> DataFrame:
    return deps.within_budget(declared(spark, d), 3).select(*deps.BY, "place", "looked_up")


def _numbers() -> Column:
    return F.transform(F.split("version", r"\."), lambda x: x.cast("int"))


def tk09_outdated(spark: SparkSession, d: str) -> DataFrame:
    have = declared(spark, d).where("version is not null").select(*deps.BY, "version")
    known = _packages(spark, d).where("version is not null").select("ecosystem", "name", "version")
    return deps.outdated(deps.behind(have, known, _numbers()), 3)


def src25_registry(spark: SparkSession, d: str) -> DataFrame:
    """Index payloads made of the installed versions, read again."""
    v = _packages(spark, d).where("version is not null").groupBy("ecosystem", "name", "version").agg(F.max("line").cast("bigint").alias("size"))
    g = v.groupBy("ecosystem", "name")
    pypi = F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("version", F.array(F.struct("size", F.lit(False).alias("yanked")))))).alias("releases"), F.struct(F.max("version").alias("version")).alias("info")))
    npm = F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("version", F.struct(F.struct(F.col("size").alias("unpackedSize"), F.lit(3).alias("fileCount")).alias("dist"))))).alias("versions"), F.struct(F.max("version").alias("latest")).alias("dist-tags")))
    payloads = g.agg(pypi.alias("a"), npm.alias("b")).select("ecosystem", "name", F.when(F.lower("ecosystem") == "pypi", F.col("a")).otherwise(F.col("b")).alias("payload"))
    return deps.registry_versions(payloads)


# -- signals

NAMES = {"semgrep": "error_handling", "bandit": "test_quality", "ruff": "dep_health", "architecture": "git_history", "dependency": "ci_quality"}


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a tool's findings with a snippet, an impact, a warning, as a signal's components."""
    name = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])
    share = lambda c: F.avg(c.cast("int"))
    f = findings(spark, d).where("scan_id is not null").withColumn("name", F.try_element_at(name, F.col("analyzer"))).where("name is not null")
    r = f.groupBy("scan_id", "name").agg(
        share(F.col("code_snippet").isNotNull()).alias("a"), share(F.col("score_impact").isNotNull()).alias("b"), share(_rank() == 2).alias("c"), F.bool_or(F.col("severity").isNull()).alias("failed"), F.count(F.lit(1)).alias("n")
    )
    parts = F.create_map(F.lit("direct_count"), F.col("a"), F.lit("freshness"), F.lit(None).cast("double"), F.lit("transitive"), F.col("b"), F.lit("unused"), F.col("c"))
    return r.select("scan_id", "name", (F.col("n") > 2).alias("applicable"), F.col("a").alias("score"), parts.alias("components"), "failed", "n")


def agg12_signal_values(spark: SparkSession, d: str) -> DataFrame:
    return signals.signal_values(_reports(spark, d)).select("scan_id", "signal", "category", F.round("value", 6).alias("value"))


def agg10_deductions(spark: SparkSession, d: str) -> DataFrame:
    values = signals.signal_values(_reports(spark, d))
    c = values.groupBy("scan_id", F.col("category").alias("category_name")).agg(F.count(F.lit(1)).cast("double").alias("penalty"))
    out = signals.deductions(c, values, {"code_health": 25.0, "dependencies": 25.0, "architecture": 20.0})
    return out.select("scan_id", "category_name", "signal", F.round("penalty", 5).alias("penalty"), F.round("points", 5).alias("points"))


def set04_states(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).where("scan_id is not null").groupBy("scan_id", "analyzer").agg(F.bool_or(F.col("severity").isNull()).alias("bad"))
    ran = f.groupBy("scan_id").agg(F.collect_set(F.when(~F.col("bad"), F.col("analyzer"))).alias("ran"), F.collect_set(F.when(F.col("bad"), F.col("analyzer"))).alias("failed"))
    specs = spark.createDataFrame([("security", ["semgrep", "bandit"]), ("dependencies", ["dependency"]), ("code_health", ["ruff"])], "category string, analyzers array<string>")
    return signals.assessed_categories(specs, ran)


def snk04_stored(spark: SparkSession, d: str) -> DataFrame:
    r = _reports(spark, d).select("scan_id", "name", F.when(F.col("failed"), "failed").otherwise("ok").alias("status"), "score", F.lit(None).cast("string").alias("reason"))
    return signals.stored(r).select("scan_id", F.explode("signals").alias("name", "r")).select("scan_id", "name", "r.applicable", F.round("r.score", 6).alias("score"), "r.reason")


def agg27_error_handling(spark: SparkSession, d: str) -> DataFrame:
    r = one_per_key(table(spark, d, "ruff_output"), "result_id").where("scan_id is not null")
    sites = r.groupBy("scan_id").agg(F.count(F.lit(1)).alias("handlers"), F.count_if(F.col("fix").isNotNull()).alias("io_sites"), F.count_if(F.size("fix.edits") > 1).alias("io_wrapped"), F.lit(0).alias("promise_sites"))
    out = signals.error_handling(r.select("scan_id", F.col("name").alias("rule")), sites)
    return out.select("scan_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def _test_files(spark: SparkSession, d: str) -> DataFrame:
    kind = signals.test_kind(F.col("path"), fp.folders_of(F.col("path")), F.array().cast("array<string>"), ["worker", "auth"])
    return modules.nodes(spark, d).select("scan_id", "path", "is_test", "loc", F.col("definitions").alias("tests"), (F.col("loc") % 5).alias("assertions"), F.col("parse_error").cast("int").alias("without"), kind.alias("kind"))


def prj18_test_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _test_files(spark, d).select("path", "kind").distinct()


def agg28_test_quality(spark: SparkSession, d: str) -> DataFrame:
    out = signals.test_quality(_test_files(spark, d))
    return out.select("scan_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


KINDS = ("tests", "lint", "build", "security")


def agg29_ci_quality(spark: SparkSession, d: str) -> DataFrame:
    name = F.create_map(*[F.lit(x) for kv in {"bandit": "tests", "ruff": "lint", "dependency": "build", "semgrep": "security"}.items() for x in kv])
    f = findings(spark, d).where("scan_id is not null")
    files = f.select("scan_id", F.array_compact(F.array(F.try_element_at(name, F.col("analyzer")))).alias("kinds"), (F.size("cwe_ids") > 1).alias("on_pr"), (_rank() == 4).alias("gated"))
    out = signals.ci_quality(files, KINDS)
    return out.select("scan_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def _identifiers(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).where("scan_id is not null and message is not null")
    kind = F.when(_rank() >= 3, "class").when(_rank() == 2, "function").otherwise("variable")
    path = fn.plain_path(F.col("file_path"))
    return f.select("scan_id", path.alias("path"), fp.language_of(path).alias("language"), F.regexp_extract("message", r"(\w+)\W*$", 1).alias("name"), kind.alias("kind"), F.lit(0).alias("scope"), (F.col("analyzer") == "ruff").alias("const")).where("name <> '' and path is not null")


def prj24_conforming(spark: SparkSession, d: str) -> DataFrame:
    i = _identifiers(spark, d).select("language", "name", "kind", "const").distinct()
    return i.withColumn("conforms", signals.conforms(F.col("language"), F.col("kind"), F.col("name"), F.col("const")))


def agg30_naming(spark: SparkSession, d: str) -> DataFrame:
    return signals.naming(_identifiers(spark, d), ["scan_id"]).withColumn("rate", F.round("rate", 6))


# -- evaluation


def agg44_without_category(spark: SparkSession, d: str) -> DataFrame:
    e = _evidence(spark, d).withColumn("category", F.when(F.col("signal") == "bandit", "reputation").otherwise(F.col("category")))
    return evaluation.score_without(e, "reputation")


def agg42_ablation(spark: SparkSession, d: str) -> DataFrame:
    labels = scans(spark, d).select(F.col("id").alias("record_id"), (F.col("status") != "completed").alias("bad"))
    out = evaluation.ablation(_evidence(spark, d), labels)
    return out.select("signal", *[F.round(c, 6).alias(c) for c in ("auc", "auc_without", "drop")])


def agg51_citations(spark: SparkSession, d: str) -> DataFrame:
    """Of a scan's citations: sides that aren't in its graph, and the share of citations that stand."""
    c = modules.jn18_citations(spark, d).groupBy("scan_id")
    return c.agg(F.count(F.lit(1)).alias("cited"), F.round(F.sum("invalid") / F.sum(F.col("valid") + F.col("invalid")), 4).alias("invented"), F.round(F.avg(F.col("reason").isNull().cast("int")), 6).alias("standing"))


def tk13_best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.best_threshold(usage.agg40_confusion(spark, d))


def jn26_run_changes(spark: SparkSession, d: str) -> DataFrame:
    """Rules of files among deleted findings against those among the others."""
    f = findings(spark, d).where("file_path is not null")
    run = lambda rows: rows.groupBy(F.col("file_path").alias("key")).agg(F.collect_set("rule_id").alias("signals"), F.lit(True).alias("ok"))
    return evaluation.run_changes(run(f.where("deleted_at is not null")), run(f.where("deleted_at is null")))


def agg49_subsets(spark: SparkSession, d: str) -> DataFrame:
    every = evaluation.subsets(["ci_quality", "dep_health", "error_handling", "git_history", "test_quality"], {"process": ("yes", ["ci_quality", "git_history"]), "target": ("security", ["dep_health"])})
    rows = [(",".join(c["names"]), c.get("process"), c.get("target")) for c in every]
    return spark.createDataFrame(rows, "names string, process string, target string")


def agg46_fitted_weights(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.fitted_weights(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").withColumn("weight", F.round("weight", 5))


def agg47_paired_differences(spark: SparkSession, d: str) -> DataFrame:
    s = scans(spark, d).select(F.col("source_loc").cast("double").alias("a"), F.length("id").cast("double").alias("l"), F.unix_timestamp("created_at").cast("double").alias("label"))
    s = s.withColumn("b", F.pmod(F.col("label"), F.lit(9973.0)))
    return evaluation.paired_differences(s, "a", "b", "label", 200)


def set06_rules_by_package(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    named = f.where("dependency.package is not null").select("scan_id", "id", F.col("dependency.package").alias("package"))
    return evaluation.relabelled(f, named).groupBy("scan_id", "analyzer", "rule_id").agg(F.count(F.lit(1)).alias("n"))


def set06_one_per_component(spark: SparkSession, d: str) -> DataFrame:
    """Findings of architecture stand for cycles, files with any of them for components."""
    f = findings(spark, d).where("scan_id is not null")
    cycle = F.col("analyzer") == "architecture"
    c = f.where(cycle).groupBy("scan_id").agg(F.array_sort(F.collect_set("severity")).alias("s")).select("scan_id", F.posexplode("s").alias("k", "severity"))
    out = evaluation.one_per_component(f, cycle, c.select("scan_id", (F.col("k") + 1).alias("place"), "severity"))
    return out.select("scan_id", "id", "analyzer", "rule_id", "severity")


QUERIES = {
    f.__name__: f
    for f in (
        jn15_unused, jn16_undeclared, agg26_direct_counts, mth02_transitive, prj27_tools_by_name, tk14_budget, tk09_outdated, src25_registry,
        agg12_signal_values, agg10_deductions, set04_states, snk04_stored, agg27_error_handling, prj18_test_kinds, agg28_test_quality,
        agg29_ci_quality, prj24_conforming, agg30_naming, agg44_without_category, tk13_best_threshold, jn26_run_changes, agg49_subsets,
        agg42_ablation, agg51_citations, agg46_fitted_weights, agg47_paired_differences, set06_rules_by_package, set06_one_per_component,
    )
}

_PK = f"""k AS MATERIALIZED (SELECT scan_id AS repo, id, dependency.ecosystem AS ecosystem, dependency.package AS name, dependency.installed_version AS version, {_RANK.format('severity')} AS r, coalesce(file_path, '') AS path, coalesce(start_line, 0) AS line
  FROM {_F} WHERE scan_id IS NOT NULL AND dependency.package IS NOT NULL)"""
_DECL = f"""{_PK}, d AS MATERIALIZED (SELECT repo, ecosystem, name, CASE WHEN max(r) >= 3 THEN 'runtime' WHEN max(r) >= 1 THEN 'dev' ELSE 'optional' END AS kind, max(version) AS version FROM k GROUP BY 1, 2, 3)"""
_CANON = "CASE WHEN lower(ecosystem) = 'pypi' THEN regexp_replace(lower(name), '[-_.]+', '-', 'g') ELSE name END"
_VER = "list_transform(string_split({0}, '.'), lambda x: x::INT)"
_NAMES = "(MAP {'semgrep':'error_handling','bandit':'test_quality','ruff':'dep_health','architecture':'git_history','dependency':'ci_quality'})[analyzer]"
_REP = f"""s AS MATERIALIZED (SELECT scan_id, {_NAMES} AS name, avg((code_snippet IS NOT NULL)::INT) AS a, avg((score_impact IS NOT NULL)::INT) AS b, avg(({_RANK.format('severity')} = 2)::INT) AS c, bool_or(severity IS NULL) AS failed, count(*) AS n
  FROM {_F} WHERE scan_id IS NOT NULL AND {_NAMES} IS NOT NULL GROUP BY 1, 2),
v AS MATERIALIZED (SELECT scan_id, name AS signal, category, place, CASE WHEN n > 2 THEN CASE part WHEN 'all' THEN a WHEN 'deps' THEN (a + b) / 2 ELSE c END END AS value FROM s JOIN (VALUES ('error_handling', 'code_health', 'all', 0), ('test_quality', 'code_health', 'all', 1),
  ('dep_health', 'dependencies', 'deps', 2), ('dep_health', 'architecture', 'use', 3), ('git_history', 'architecture', 'all', 4), ('ci_quality', 'architecture', 'all', 5)) t(name, category, part, place) USING (name))"""
_R1 = "(SELECT DISTINCT ON (result_id) * FROM ruff_output)"
_MEAN = "round(list_avg(list_filter([{0}], lambda x: x IS NOT NULL)), 6) AS score"
_ID = f"""i AS MATERIALIZED (SELECT scan_id, path, {modules._LANG} AS language, regexp_extract(message, '(\\w+)\\W*$', 1) AS name, CASE WHEN {_RANK.format('severity')} >= 3 THEN 'class' WHEN {_RANK.format('severity')} = 2 THEN 'function' ELSE 'variable' END AS kind, analyzer = 'ruff' AS const
  FROM (SELECT *, {modules._PATH.format('file_path')} AS path FROM {_F} WHERE scan_id IS NOT NULL AND message IS NOT NULL) WHERE path IS NOT NULL AND regexp_extract(message, '(\\w+)\\W*$', 1) <> '')"""
_BARE = "regexp_replace(regexp_replace(name, '^[_$]+', ''), '_+$', '')"
_CONF = f"""({_BARE} = '' OR CASE WHEN kind = 'class' THEN regexp_matches({_BARE}, '^[A-Z][a-zA-Z0-9]*$')
  WHEN language = 'python' THEN regexp_matches({_BARE}, '^[a-z][a-z0-9]*(_[a-z0-9]+)*$') OR kind = 'variable' AND regexp_matches({_BARE}, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$')
  ELSE regexp_matches({_BARE}, '^[a-z][a-zA-Z0-9]*$') OR kind = 'function' AND regexp_matches({_BARE}, '^[A-Z][a-zA-Z0-9]*$') OR const AND regexp_matches({_BARE}, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$') END)"""
_KIND = f"CASE WHEN contains(lower(path), 'e2e') THEN 'e2e' WHEN contains(lower(path), 'integration') OR list_has_any({modules._FOLDERS}, ['worker', 'auth']) THEN 'integration' ELSE 'unit' END"

ORACLE = {
    "jn15_unused": f"""WITH {_DECL} SELECT repo, ecosystem, name, kind FROM d WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.repo = d.repo AND k.ecosystem = d.ecosystem AND k.name = d.name AND r IN (2, 3)) AND NOT regexp_matches(name, '-test$|^flask.')""",
    "jn16_undeclared": f"""WITH {_PK}, o AS (SELECT DISTINCT repo, ecosystem, name FROM k WHERE r >= 2)
      SELECT repo, ecosystem, name, f.path AS path, f.line AS line FROM (SELECT repo, ecosystem, name, min({{'path': path, 'line': line}}) AS f FROM k GROUP BY 1, 2, 3) x
      WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.repo = x.repo AND o.ecosystem = x.ecosystem AND o.name = x.name) AND EXISTS (SELECT 1 FROM o WHERE o.repo = x.repo AND o.ecosystem = x.ecosystem)""",
    "agg26_direct_counts": f"""WITH {_DECL} SELECT repo, ecosystem, count(*) FILTER (kind = 'runtime') AS runtime, count(*) FILTER (kind = 'dev') AS dev,
      round(least(1, b / greatest(count(*) FILTER (kind <> 'optional'), b)), 6) AS component FROM (SELECT *, CASE ecosystem WHEN 'npm' THEN 2 WHEN 'PyPI' THEN 3 ELSE 1 END AS b FROM d) GROUP BY repo, ecosystem, b""",
    "mth02_transitive": "SELECT p_partkey, round(1 / (1 + greatest(0, p_partkey - 10 * p_size) / (50 * greatest(1, p_size))), 6) AS component FROM part",
    "prj27_tools_by_name": f"WITH {_PK} SELECT DISTINCT name, regexp_matches(name, '^(flask.*|.*-test|.a.*-d.cs)$') AS tool FROM k",
    "tk14_budget": f"""WITH {_DECL} SELECT repo, ecosystem, name, CAST(p AS INT) AS place, p <= 3 AS looked_up FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY kind <> 'runtime', ecosystem, name) AS p FROM d)""",
    "tk09_outdated": f"""WITH {_DECL}, x AS (SELECT DISTINCT ecosystem, name, {_VER.format('version')} AS v FROM k WHERE version IS NOT NULL),
      y AS (SELECT repo, ecosystem, d.name, version, count(*) FILTER (v > {_VER.format('version')}) AS versions_behind, greatest(0, max(v[1]) - max({_VER.format('version')}[1])) AS majors_behind FROM d JOIN x USING (ecosystem, name) WHERE version IS NOT NULL GROUP BY ALL)
      SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo ORDER BY majors_behind DESC, versions_behind DESC, name, ecosystem) AS INT) AS place FROM y WHERE majors_behind > 0 OR versions_behind > 2) WHERE place <= 3""",
    "src25_registry": f"""WITH {_PK} SELECT ecosystem, name, version, CAST(max(line) AS BIGINT) AS size, CASE WHEN lower(ecosystem) = 'npm' THEN 3 END AS files, max(max(version)) OVER (PARTITION BY ecosystem, name) AS latest FROM k WHERE version IS NOT NULL AND lower(ecosystem) IN ('npm', 'pypi') GROUP BY 1, 2, 3""",
    "agg12_signal_values": f"WITH {_REP} SELECT scan_id, signal, category, round(value, 6) AS value FROM v",
    "agg10_deductions": f"""WITH {_REP}, c AS (SELECT scan_id, category, count(*)::DOUBLE AS base FROM v GROUP BY 1, 2), h AS (SELECT *, CASE category WHEN 'architecture' THEN 20.0 ELSE 25.0 END AS half FROM v JOIN c USING (scan_id, category) WHERE value IS NOT NULL),
      p AS (SELECT *, half * (1 - value) AS penalty, base + sum(half * (1 - value)) OVER (PARTITION BY scan_id, category ORDER BY place) AS after FROM h)
      SELECT scan_id, category AS category_name, signal, round(penalty, 5) AS penalty, round(100 * exp(-(after - penalty) * ln(2) / half) - 100 * exp(-after * ln(2) / half), 5) AS points FROM p""",
    "set04_states": f"""WITH a AS (SELECT scan_id, analyzer, bool_or(severity IS NULL) AS bad FROM {_F} WHERE scan_id IS NOT NULL GROUP BY 1, 2), c(category, analyzer) AS (VALUES ('security', 'semgrep'), ('security', 'bandit'), ('dependencies', 'dependency'), ('code_health', 'ruff'))
      SELECT s.scan_id, c.category, CASE WHEN bool_or(coalesce(bad, false)) THEN 'failed' WHEN count(bad) > 0 THEN 'scored' ELSE 'not applicable' END AS state FROM (SELECT DISTINCT scan_id FROM a) s, c LEFT JOIN a ON a.scan_id = s.scan_id AND a.analyzer = c.analyzer GROUP BY 1, 2""",
    "snk04_stored": f"WITH {_REP} SELECT scan_id, name, NOT failed AS applicable, round(CASE WHEN NOT failed THEN a END, 6) AS score, CASE WHEN failed THEN 'failed' END AS reason FROM s",
    "agg27_error_handling": f"""WITH x AS (SELECT scan_id, 1 - count(*) FILTER (name IN ('bare-except', 'swallowed-broad-except', 'empty-catch', 'comment-only-catch')) / count(*) AS a, CASE WHEN count(fix) > 0 THEN count(*) FILTER (len(fix.edits) > 1) / count(fix) END AS b FROM {_R1} WHERE scan_id IS NOT NULL GROUP BY 1)
      SELECT scan_id, round(a, 6) AS swallow_rate, round(b, 6) AS io_wrapped_ratio, NULL::DOUBLE AS promise_handling, {_MEAN.format('a, b')} FROM x""",
    "prj18_test_kinds": f"{modules._WITH} SELECT DISTINCT path, {_KIND} AS kind FROM q",
    "agg28_test_quality": f"""{modules._WITH}, x AS (SELECT scan_id, sum(loc) FILTER (is_test) AS tl, coalesce(sum(loc) FILTER (NOT is_test), 0) AS sl, coalesce(sum(definitions) FILTER (is_test), 0) AS n, sum(loc % 5) FILTER (is_test) AS a, sum(parse_error::INT) FILTER (is_test) AS z, count(DISTINCT {_KIND}) FILTER (is_test) AS k FROM n GROUP BY 1),
      y AS (SELECT scan_id, CASE WHEN n = 0 THEN 0.0 WHEN sl > 0 THEN least(1, tl / (0.3 * sl)) ELSE 1 END AS a1, CASE WHEN n > 0 THEN least(1, a / n / 2) END AS a2, CASE WHEN n > 0 THEN 1 - z / n END AS a3, CASE WHEN n > 0 THEN CASE WHEN k >= 2 THEN 1 ELSE 0.5 END END::DOUBLE AS a4 FROM x)
      SELECT scan_id, round(a1, 6) AS test_presence, round(a2, 6) AS assertion_density, round(a3, 6) AS assertion_free, round(a4, 6) AS type_mix, {_MEAN.format('a1, a2, a3, a4')} FROM y""",
    "agg29_ci_quality": f"""WITH x AS (SELECT scan_id, max((analyzer = 'bandit')::INT)::DOUBLE AS tests, max((analyzer = 'ruff')::INT)::DOUBLE AS lint, max((analyzer = 'dependency')::INT)::DOUBLE AS build, max((analyzer = 'semgrep')::INT)::DOUBLE AS security, coalesce(max((len(cwe_ids) > 1)::INT), 0)::DOUBLE AS pr_trigger, max(({_RANK.format('severity')} = 4)::INT)::DOUBLE AS g
      FROM {_F} WHERE scan_id IS NOT NULL GROUP BY 1) SELECT scan_id, tests, lint, build, security, pr_trigger, CASE WHEN build = 1 THEN g END AS gating, {_MEAN.format('tests, lint, build, security, pr_trigger, CASE WHEN build = 1 THEN g END')} FROM x""",
    "prj24_conforming": f"WITH {_ID} SELECT DISTINCT language, name, kind, const, {_CONF} AS conforms FROM i",
    "agg30_naming": f"""WITH {_ID} SELECT scan_id, count(*) AS identifiers, count(*) FILTER ({_CONF}) AS conforming, count(*) FILTER (kind = 'variable' AND length(name) = 1 AND name <> '_') AS single_letter, round(count(*) FILTER ({_CONF}) / count(*), 6) AS rate FROM (SELECT DISTINCT * FROM i) GROUP BY 1""",
    "agg44_without_category": f"WITH {_EVIDENCE} SELECT record_id, CAST(least(100, greatest(0, sum(CASE WHEN signal = 'bandit' THEN 0 ELSE points END))) AS INT) AS score FROM e GROUP BY 1",
    "agg42_ablation": f"""WITH {_EVIDENCE}, l AS (SELECT id AS record_id, (status <> 'completed')::INT AS bad FROM {_S}), g AS (SELECT signal FROM e GROUP BY 1 UNION ALL SELECT ''),
      s AS (SELECT g.signal, l.record_id, bad, least(100, greatest(0, coalesce(sum(CASE WHEN e.signal = g.signal THEN 0 ELSE points END), 0))) AS score FROM l JOIN g ON true LEFT JOIN e ON e.record_id = l.record_id GROUP BY 1, 2, 3),
      a AS (SELECT x.signal, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0 END) AS a FROM s x JOIN s y ON x.signal = y.signal AND x.bad = 1 AND y.bad = 0 GROUP BY 1)
      SELECT a.signal, round(b.a, 6) AS auc, round(a.a, 6) AS auc_without, round(b.a - a.a, 6) AS "drop" FROM a, (SELECT a FROM a WHERE signal = '') b WHERE signal <> ''""",
    "agg51_citations": f"""SELECT scan_id, count(*) AS cited, round(sum(invalid) / sum(valid + invalid), 4) AS invented, round(avg((reason IS NULL)::INT), 6) AS standing FROM ({modules.ORACLE['jn18_citations']}) GROUP BY 1""",
    "tk13_best_threshold": f"SELECT * FROM ({usage.ORACLE['agg40_confusion']}) ORDER BY f1 DESC, threshold LIMIT 1",
    "jn26_run_changes": f"""WITH a AS (SELECT DISTINCT file_path, rule_id FROM {_F} WHERE deleted_at IS NOT NULL AND file_path IS NOT NULL), b AS (SELECT DISTINCT file_path, rule_id FROM {_F} WHERE deleted_at IS NULL AND file_path IS NOT NULL),
      k AS (SELECT file_path FROM a INTERSECT SELECT file_path FROM b)
      SELECT change, count(*) AS n FROM (SELECT '+' || rule_id AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) WHERE file_path IN (FROM k) UNION ALL SELECT '-' || rule_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) WHERE file_path IN (FROM k)) WHERE change IS NOT NULL GROUP BY 1""",
    "agg49_subsets": """WITH n(name, bit) AS (VALUES ('ci_quality', 1), ('dep_health', 2), ('error_handling', 4), ('git_history', 8), ('test_quality', 16)),
      s AS (SELECT m, coalesce(string_agg(name, ',' ORDER BY name), '') AS names FROM range(32) r(m) LEFT JOIN n ON (m & bit) > 0 GROUP BY m)
      SELECT names, process, target FROM s, (VALUES (NULL), ('yes')) p(process), (VALUES (NULL), ('security')) t(target) WHERE (process IS NULL OR (m & 9) > 0) AND (target IS NULL OR (m & 2) > 0)""",
    "set06_rules_by_package": f"SELECT scan_id, analyzer, CASE WHEN analyzer = 'dependency' THEN coalesce(dependency.package, rule_id) ELSE rule_id END AS rule_id, count(*) AS n FROM {_F} GROUP BY 1, 2, 3",
    "set06_one_per_component": f"""WITH f AS (SELECT * FROM {_F} WHERE scan_id IS NOT NULL), m AS (SELECT scan_id, max(id) AS last FROM f GROUP BY 1)
      SELECT scan_id, id, analyzer, rule_id, severity FROM f WHERE analyzer <> 'architecture' OR analyzer IS NULL UNION ALL SELECT scan_id, last + row_number() OVER (PARTITION BY scan_id ORDER BY severity), 'architecture', 'cycle', severity FROM (SELECT DISTINCT scan_id, severity FROM f WHERE analyzer = 'architecture' AND severity IS NOT NULL) JOIN m USING (scan_id)""",
}
