"""Functions and small operators each by itself, with their constants written out in the SQL."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnwork.functions import findings as fn
from kilnwork.operators import architecture, dependencies, history, scoring, signals, sinks, views
from kilnwork.plans import files, modules
from kilnwork.plans.findings import _F, _RANK, _S, findings, scans
from kilnwork.plans.health import _CANON, _PK, _packages
from kilnwork.plans.usage import _C, _tokens, calls
from kilnwork.runtime import one_per_key, shared_dir, table
from kilnwork.sources import manifests, pipelines


def prj01_semgrep_severities(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "semgrep_output").select(F.col("extra.severity").alias("raw")).distinct()
    return s.select("raw", fn.semgrep_severity(F.col("raw")).alias("severity"))


def prj02_bandit_severities(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "bandit_output").select("issue_severity", "issue_confidence").distinct()
    return s.select("*", fn.bandit_severity(F.col("issue_severity"), F.col("issue_confidence")).alias("severity"))


def prj03_ruff_severities(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "part").select(F.concat(F.element_at(F.array(*map(F.lit, ("E9", "F5", "F82", "E722", "W2", "B9", "F63", "E5"))), F.col("p_partkey").cast("int") % 8 + 1), F.col("p_partkey").cast("string")).alias("code"))
    return codes.select("code", fn.ruff_severity(F.col("code")).alias("severity"))


def prj06_weakness_numbers(spark: SparkSession, d: str) -> DataFrame:
    s = one_per_key(table(spark, d, "semgrep_output"), "result_id")
    return s.select("result_id", F.array_join(F.array_sort(fn.weakness_numbers(F.col("extra.metadata.cwe"))), ",").alias("numbers"))


def prj08_without_nul(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).select("id", fn.without_nul(F.concat(F.lit("\0"), "message", F.lit("\0\0"))).alias("message"))


def prj09_in_tests(spark: SparkSession, d: str) -> DataFrame:
    p = findings(spark, d).where("file_path is not null").select(F.explode(F.array("file_path", F.concat(F.lit("Tests/"), "file_path"), F.regexp_replace("file_path", r"\.py$", "_test.py"))).alias("path")).distinct()
    return p.select("path", fn.is_test_path(F.col("path")).alias("in_tests"))


def prj10_weights(spark: SparkSession, d: str) -> DataFrame:
    return scoring.weighted(findings(spark, d)).select("id", "category_name", F.round("weight", 6).alias("weight"))


def prj11_grades(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("p_partkey") % 101
    return table(spark, d, "part").select("p_partkey", fn.grade(v).alias("grade"), fn.risk_level(v).alias("level"))


def prj14_involving(spark: SparkSession, d: str) -> DataFrame:
    i = findings(spark, d).select(F.col("id").alias("issue_id"), F.lit("x").alias("kind"), "severity", F.col("corroborated_by").alias("modules"))
    return views.issues_of(i, module="semgrep").select("issue_id")


def prj25_call_tokens(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d).select("id", _tokens().cast("bigint").alias("tokens"))


def jn20_reporters(spark: SparkSession, d: str) -> DataFrame:
    each = F.explode(F.concat(F.array("analyzer"), F.coalesce("corroborated_by", F.array().cast("array<string>")))).alias("reporter")
    return findings(spark, d).select("scan_id", each).groupBy("scan_id", "reporter").agg(F.count(F.lit(1)).alias("n"))


def agg11_size_factors(spark: SparkSession, d: str) -> DataFrame:
    s = scans(spark, d).select("id", F.coalesce("source_loc", F.lit(0)).alias("loc"), F.explode(F.array(*map(F.lit, ("security", "dependencies", "architecture", "code_health")))).alias("category"))
    return s.select("id", "category", F.round(scoring.size_factor(F.col("category"), F.col("loc"), F.col("loc") / 100), 6).alias("factor"))


def agg13_mean_components(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("a"), F.col("score_impact"), F.lit("b"), F.col("start_line").cast("double"), F.lit("c"), F.lit(None).cast("double"))
    return findings(spark, d).select("id", F.round(history.mean_of(m), 6).alias("mean"))


def arr12_mean_of_any(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("a"), F.col("score_impact"), F.lit("b"), F.lit(None).cast("double"))
    return findings(spark, d).select("id", F.round(signals.mean_of(m), 6).alias("mean"))


def dt01_starts(spark: SparkSession, d: str) -> DataFrame:
    return scans(spark, d).select("id", *[F.date_format(F.date_trunc(u, "created_at"), "yyyy-MM-dd HH:mm").alias(u) for u in ("day", "month")])


def dt05_recency(spark: SparkSession, d: str) -> DataFrame:
    days = F.datediff(F.lit("2026-07-01").cast("date"), F.to_date("created_at"))
    return scans(spark, d).select("id", F.round(history.recency_decay(days), 6).alias("recency"))


def mth01_half_life(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(scoring.half_life_score(F.col("p_size") / 3, F.lit(12.0)), 6).alias("score"))


def mth09_clamped(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).select("id", F.round(dependencies.clamp01(F.col("score_impact") - 0.5), 6).alias("value"))


def mth10_instability(spark: SparkSession, d: str) -> DataFrame:
    return architecture.node_metrics(modules.edges(spark, d)).select("scan_id", "node", "fan_in", "fan_out", "instability")


def arr01_overlaps(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).where(F.arrays_overlap("cwe_ids", F.array(F.lit(79), F.lit(89), F.lit(22))))
    return f.select("id")


def arr02_corroborated(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).where(F.size("corroborated_by") > 0).select("id", F.size("corroborated_by").alias("n"))


def arr03_appended(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).where("corroborated_by is not null").select("id", F.explode(F.array_append("corroborated_by", F.col("analyzer"))).alias("reporter"))


def arr07_json_fields(spark: SparkSession, d: str) -> DataFrame:
    j = F.to_json(F.struct("dependency", F.struct(F.col("id").alias("n")).alias("inner")))
    return findings(spark, d).select("id", F.get_json_object(j, "$.dependency.package").alias("package"), F.get_json_object(j, "$.inner.n").cast("bigint").alias("n"))


def str01_distances(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_brand", "p_name").distinct()
    return p.select("p_brand", "p_name", F.levenshtein("p_brand", "p_name").alias("distance"))


def str15_issue_keys(spark: SparkSession, d: str) -> DataFrame:
    e = modules.edges(spark, d)
    one = F.array(F.struct("src", "dst"))
    return e.select("scan_id", "src", "dst", views.issue_key(F.lit("edge"), F.array("dst", "src"), one).alias("key"))


def str20_canonical(spark: SparkSession, d: str) -> DataFrame:
    n = _packages(spark, d).select("ecosystem", F.translate("name", "-", "_").alias("name")).distinct()
    return n.select("ecosystem", "name", dependencies.canonical(F.col("ecosystem"), F.col("name")).alias("canonical"))


def str26_mentions(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).where("message is not null")
    return f.select("id", F.array_join(F.array_sort(dependencies.words_in(F.regexp_replace("message", " ", ", @x "))), "|").alias("words"))


def src02_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Members of an archive a scan by a hash of their content, within a limit that long ones break."""

    @F.pandas_udf(T.BinaryType())
    def zipped(ids: pd.Series, sizes: pd.Series) -> pd.Series:
        def pack(name: str, size: int) -> bytes:
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(f"src/{name}.txt", name * size)
            return out.getvalue()

        return pd.Series([pack(i, s) for i, s in zip(ids, sizes)])

    size = F.when(F.col("user_id").isNull(), 2000).otherwise(3)
    a = scans(spark, d).select(F.col("id").alias("repo"), zipped("id", size).alias("content"))
    out = manifests.archive_files(a, most_bytes=50_000)
    return out.select("repo", "path", F.md5("content").alias("hash"), "error")


def src03_safe_members(spark: SparkSession, d: str) -> DataFrame:
    names = modules.nodes(spark, d).select("path").distinct()
    each = names.select(F.explode(F.array("path", F.concat(F.lit("/"), "path"), F.concat(F.lit("a/../"), "path"), F.concat(F.lit("C:"), "path"), F.concat("path", F.lit("\\")), F.concat("path", F.lit("..")))).alias("name"))
    safe = F.pandas_udf(lambda s: s.map(manifests.safe_member), T.BooleanType())
    return each.select("name", safe("name").alias("safe"))


def src18_package_json(spark: SparkSession, d: str) -> DataFrame:
    s = scans(spark, d).where("repo_name is not null")
    sections = F.struct(
        F.create_map(F.col("repo_name"), F.lit("^1"), F.lit("linked"), F.lit("workspace:*")).alias("dependencies"),
        F.create_map(F.col("repo_name"), F.lit("^2"), F.lit("only-dev"), F.lit("~3")).alias("devDependencies"),
        F.create_map(F.lit("peer"), F.col("repo_owner")).alias("peerDependencies"),
    )
    return manifests.dependencies(s.select(F.col("id").alias("repo"), F.lit("package.json").alias("path"), F.to_json(sections).alias("text")))


def src27_dialects(spark: SparkSession, d: str) -> DataFrame:
    s = scans(spark, d).where("repo_name is not null").select(F.col("id").alias("repo"), "repo_name")
    texts = {
        ".gitlab-ci.yml": F.concat(F.lit("stages: [test, ship]\nt:\n  stage: test\n  script:\n    - pytest "), "repo_name", F.lit("\nb:\n  stage: ship\n  needs: [t]\n  script: make build\n.hidden:\n  script: x\n")),
        ".circleci/config.yml": F.concat(F.lit("jobs:\n  t:\n    steps:\n      - run: pytest "), "repo_name", F.lit("\n  b:\n    steps:\n      - run: make build\nworkflows:\n  w:\n    jobs:\n      - t\n      - b: {requires: [t]}\n")),
        "Jenkinsfile": F.concat(F.lit("node { sh 'pytest "), "repo_name", F.lit("'\n sh \"make build\" }")),
        "azure-pipelines.yml": F.concat(F.lit("steps:\n  - script: pytest "), "repo_name", F.lit("\n")),
    }
    out = None
    for path, text in texts.items():
        part = s.select("repo", F.lit(path).alias("path"), text.alias("text"))
        out = part if out is None else out.unionByName(part)
    j = pipelines.jobs(out)
    return j.select("repo", "path", "job", "stage", F.array_join("needs", ",").alias("needs"), F.array_join("items", ";").alias("items"))


def src29_reports(spark: SparkSession, d: str) -> DataFrame:
    s = scans(spark, d).select(F.col("id").alias("repo"), F.coalesce("source_loc", F.lit(7)).alias("n")).where("n > 0")
    xml = s.select("repo", F.lit("a/coverage.xml").alias("path"), F.format_string('<coverage lines-valid="%d" lines-covered="%d" line-rate="0.5">', F.col("n") * 2, "n").alias("text"))
    js = s.select("repo", F.lit("b/coverage-summary.json").alias("path"), F.format_string('{"total":{"lines":{"total":%d,"covered":1}}}', "n").alias("text"))
    info = s.select("repo", F.lit("lcov.info").alias("path"), F.format_string("LF:%d\nLH:0\nLF:1\nLH:1\n", "n").alias("text"))
    return manifests.coverage(xml.unionByName(js).unionByName(info))


def snk03_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores by scan written twice: the second time those of completed scans."""
    path = f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}"
    s = scans(spark, d).select("status", F.col("id").alias("scan_id"), F.lit(1.0).alias("score"))
    sinks.replace_by(s, path, "status", ["scan_id"], "scan_id")
    sinks.replace_by(s.where("status = 'completed'").withColumn("score", F.lit(2.0)), path, "status", ["scan_id"], "scan_id")
    return spark.read.parquet(path).select("status", "scan_id", "score")


def snk06_exported(spark: SparkSession, d: str) -> DataFrame:
    """A report as CSV and as JSON lines, both read again."""
    f = findings(spark, d).groupBy("analyzer").agg(F.count(F.lit(1)).alias("n"), F.max("message").alias("note"))
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    read = []
    for kind in ("csv", "json"):
        sinks.exported(f, f"{path}/{kind}", kind)
        reader = spark.read.schema(f.schema)
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True) if kind == "csv" else reader
        read.append(reader.format(kind).load(f"{path}/{kind}").select(F.lit(kind).alias("kind"), *f.columns))
    return read[0].unionByName(read[1])


def set03_gained_and_lost(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).where("cwe_ids is not null")
    other = F.array(F.lit(79), F.lit(22), F.lit(89))
    text = lambda c: F.array_join(F.array_sort(c.cast("array<string>")), ",")
    return f.select("id", text(F.array_except("cwe_ids", other)).alias("gained"), text(F.array_except(other, F.col("cwe_ids"))).alias("lost"))


def gr11_depths(spark: SparkSession, d: str) -> DataFrame:
    """Chains of a scan's paths in order: as deep as they are long."""
    n = modules.nodes(spark, d).select("scan_id", "path").withColumn("top", F.substring_index("path", "/", 1)).select("scan_id", "top").distinct()
    g = n.groupBy("scan_id").agg(F.array_sort(F.collect_list("top")).alias("t")).where("size(t) > 1")
    e = g.select("scan_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda k: F.struct(F.get("t", k - 1).alias("src"), F.get("t", k).alias("dst")))).alias("e")).select("scan_id", "e.*")
    # The first two modules import each other and so are one step.
    back = e.groupBy("scan_id").agg(F.min(F.struct("src", "dst")).alias("m")).select("scan_id", F.col("m.dst").alias("src"), F.col("m.src").alias("dst"))
    return architecture.summary(e.unionByName(back)).select("scan_id", "nodes", "depth")


def gr12_lock_depths(spark: SparkSession, d: str) -> DataFrame:
    return files.src21_uv_locks(spark, d).select("repo", "depth")


def ext03_failures_apart(spark: SparkSession, d: str) -> DataFrame:
    from kilnwork.plans.control import _registry

    found, _ = _registry().run({"broken": table(spark, d, "scans"), "bandit": table(spark, d, "bandit_output")})
    return found["bandit"].select("result_id")


QUERIES = {
    f.__name__: f
    for f in (
        prj01_semgrep_severities, prj02_bandit_severities, prj03_ruff_severities, prj06_weakness_numbers, prj08_without_nul, prj09_in_tests,
        prj10_weights, prj11_grades, prj14_involving, prj25_call_tokens, jn20_reporters, agg11_size_factors, agg13_mean_components,
        arr12_mean_of_any, dt01_starts, dt05_recency, mth01_half_life, mth09_clamped, mth10_instability, arr01_overlaps, arr02_corroborated,
        arr03_appended, arr07_json_fields, str01_distances, str15_issue_keys, str20_canonical, str26_mentions, src02_extracted,
        src03_safe_members, src18_package_json, src27_dialects, src29_reports, snk03_scores, snk06_exported, set03_gained_and_lost,
        gr11_depths, gr12_lock_depths, ext03_failures_apart,
    )
}

_TEST_PATH = r"(^|/)(tests?|__tests__|spec|specs|testing|e2e)(/|$)|(^|/)(test_[^/]*|[^/]*_test\.py|[^/]*\.(test|spec)\.[cm]?[jt]sx?|conftest\.py)$"
_BASES = "CASE WHEN analyzer = 'ruff' THEN CASE r WHEN 4 THEN 3.0 WHEN 3 THEN 1.5 WHEN 2 THEN 0.5 ELSE 0.1 END ELSE CASE r WHEN 4 THEN 10.0 WHEN 3 THEN 5.0 WHEN 2 THEN 2.0 ELSE 0.5 END END"
_REPO = "(SELECT id AS repo, repo_name AS n FROM {0} WHERE repo_name IS NOT NULL)"

ORACLE = {
    "prj01_semgrep_severities": "SELECT DISTINCT extra.severity AS raw, CASE upper(extra.severity) WHEN 'LOW' THEN 'info' WHEN 'WARNING' THEN 'warning' WHEN 'MEDIUM' THEN 'warning' WHEN 'ERROR' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'CRITICAL' THEN 'critical' ELSE 'info' END AS severity FROM semgrep_output",
    "prj02_bandit_severities": """SELECT DISTINCT issue_severity, issue_confidence, CASE WHEN upper(issue_confidence) = 'LOW' THEN CASE upper(issue_severity) WHEN 'HIGH' THEN 'warning' ELSE 'info' END
      ELSE CASE upper(issue_severity) WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'info' END END AS severity FROM bandit_output""",
    "prj03_ruff_severities": "SELECT c || p_partkey AS code, CASE WHEN c IN ('E9', 'F5', 'F82', 'F63') THEN 'error' WHEN c IN ('E722', 'B9') THEN 'warning' ELSE 'info' END AS severity FROM (SELECT p_partkey, ['E9', 'F5', 'F82', 'E722', 'W2', 'B9', 'F63', 'E5'][p_partkey % 8 + 1] AS c FROM part)",
    "prj06_weakness_numbers": "SELECT result_id, array_to_string(list_sort(list_distinct(coalesce(list_transform(list_filter(extra.metadata.cwe, lambda x: regexp_matches(x, '(?i)CWE-\\d+')), lambda x: regexp_extract(x, '(?i)CWE-(\\d+)', 1)::INT), []))), ',') AS numbers FROM (SELECT DISTINCT ON (result_id) * FROM semgrep_output)",
    "prj08_without_nul": f"SELECT id, message FROM {_F}",
    "prj09_in_tests": f"SELECT DISTINCT path, regexp_matches(lower(path), '{_TEST_PATH}') AS in_tests FROM (SELECT unnest([file_path, 'Tests/' || file_path, regexp_replace(file_path, '\\.py$', '_test.py')]) AS path FROM {_F} WHERE file_path IS NOT NULL)",
    "prj10_weights": f"""SELECT id, CASE WHEN analyzer IN ('semgrep', 'bandit') THEN 'security' WHEN analyzer = 'dependency' THEN 'dependencies' WHEN analyzer = 'architecture' THEN 'architecture' ELSE 'code_health' END AS category_name,
      round({_BASES} * CASE WHEN len(corroborated_by) > 0 THEN 1.25 ELSE 1 END * CASE WHEN regexp_matches(lower(file_path), '{_TEST_PATH}') THEN 0.2 ELSE 1 END, 6)::DOUBLE AS weight FROM (SELECT *, {_RANK.format('severity')} AS r FROM {_F}) WHERE analyzer IN ('semgrep', 'bandit', 'dependency', 'architecture', 'ruff')""",
    "prj11_grades": "SELECT p_partkey, CASE WHEN v >= 90 THEN 'A' WHEN v >= 80 THEN 'B' WHEN v >= 70 THEN 'C' WHEN v >= 55 THEN 'D' ELSE 'F' END AS grade, CASE WHEN v >= 70 THEN 'critical' WHEN v >= 45 THEN 'high' WHEN v >= 20 THEN 'medium' ELSE 'low' END AS level FROM (SELECT p_partkey, p_partkey % 101 AS v FROM part)",
    "prj14_involving": f"SELECT id AS issue_id FROM {_F} WHERE list_contains(corroborated_by, 'semgrep')",
    "prj25_call_tokens": f"SELECT id, CAST(CASE WHEN pending THEN reserved_tokens ELSE input_tokens + output_tokens + cache_read_input_tokens END AS BIGINT) AS tokens FROM {_C}",
    "jn20_reporters": f"SELECT scan_id, reporter, count(*) AS n FROM (SELECT scan_id, unnest(list_concat([analyzer], coalesce(corroborated_by, []))) AS reporter FROM {_F}) GROUP BY 1, 2",
    "agg11_size_factors": f"""SELECT id, category, round(CASE category WHEN 'security' THEN least(6, pow(greatest(1, loc / 1000), 1 / 3)) WHEN 'dependencies' THEN 1 WHEN 'architecture' THEN sqrt(greatest(1, loc / 2000)) ELSE sqrt(greatest(1, loc / 1000)) END, 6) AS factor
      FROM (SELECT id, coalesce(source_loc, 0) AS loc FROM {_S}), (VALUES ('security'), ('dependencies'), ('architecture'), ('code_health')) t(category)""",
    "agg13_mean_components": f"SELECT id, round(list_avg(list_filter([score_impact, start_line::DOUBLE], lambda x: x IS NOT NULL)), 6) AS mean FROM {_F}",
    "arr12_mean_of_any": f"SELECT id, round(score_impact, 6) AS mean FROM {_F}",
    "dt01_starts": f"SELECT id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d 00:00') AS day, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-01 00:00') AS month FROM {_S}",
    "dt05_recency": f"SELECT id, round(exp(-(DATE '2026-07-01' - CAST(created_at AT TIME ZONE 'UTC' AS DATE)) / 365), 6) AS recency FROM {_S}",
    "mth01_half_life": "SELECT p_partkey, round(100 * pow(0.5, p_size / 3 / 12), 6) AS score FROM part",
    "mth09_clamped": f"SELECT id, round(CASE WHEN score_impact IS NOT NULL THEN least(1, greatest(0, score_impact - 0.5)) END, 6) AS value FROM {_F}",
    "mth10_instability": f"{modules._WITH}, x AS (SELECT scan_id, src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT scan_id, dst, 1, 0 FROM e) SELECT scan_id, node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out, round(sum(o) / (sum(i) + sum(o)), 4) AS instability FROM x GROUP BY 1, 2",
    "arr01_overlaps": f"SELECT id FROM {_F} WHERE list_has_any(cwe_ids, [79, 89, 22])",
    "arr02_corroborated": f"SELECT id, CAST(len(corroborated_by) AS INT) AS n FROM {_F} WHERE len(corroborated_by) > 0",
    "arr03_appended": f"SELECT id, unnest(list_append(corroborated_by, analyzer)) AS reporter FROM {_F} WHERE corroborated_by IS NOT NULL",
    "arr07_json_fields": f"SELECT id, dependency.package AS package, id AS n FROM {_F}",
    "str01_distances": "SELECT DISTINCT p_brand, p_name, CAST(levenshtein(p_brand, p_name) AS INT) AS distance FROM part",
    "str15_issue_keys": f"{modules._WITH} SELECT scan_id, src, dst, substr(sha1('edge|' || dst || '|' || src || '|' || src || ':' || dst), 1, 16) AS key FROM e",
    "str20_canonical": f"WITH {_PK} SELECT DISTINCT ecosystem, name, {_CANON} AS canonical FROM (SELECT ecosystem, replace(name, '-', '_') AS name FROM k)",
    "str26_mentions": f"SELECT id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(split_part(message, ' ', 1), '[\\w-]+'), regexp_extract_all(array_to_string(string_split(message, ' ')[2:], ' '), '[\\w-]+')))), '|') AS words FROM {_F} WHERE message IS NOT NULL",
    "src02_extracted": f"SELECT id AS repo, CASE WHEN user_id IS NOT NULL THEN 'src/' || id || '.txt' END AS path, CASE WHEN user_id IS NOT NULL THEN md5(repeat(id, 3)) END AS hash, CASE WHEN user_id IS NULL THEN 'too large' END AS error FROM {_S}",
    "src03_safe_members": f"{modules._WITH} SELECT name, safe FROM (SELECT unnest([path, '/' || path, 'a/../' || path, 'C:' || path, path || '\\', path || '..']) AS name, unnest([true, false, false, false, false, true]) AS safe FROM (SELECT DISTINCT path FROM n))",
    "src18_package_json": f"""SELECT id AS repo, 'npm' AS ecosystem, name, spec, kind FROM {_S}, LATERAL (SELECT unnest([repo_name, 'only-dev', 'peer']) AS name, unnest(['^1', '~3', repo_owner]) AS spec, unnest(['runtime', 'dev', 'runtime']) AS kind) WHERE repo_name IS NOT NULL""",
    "src27_dialects": f"""SELECT repo, path, job, stage, needs, replace(items, '$', n) AS items FROM {_REPO.format(_S)}, (VALUES ('.gitlab-ci.yml', 't', 0, '', 'pytest $'), ('.gitlab-ci.yml', 'b', 1, 't', 'make build'), ('.circleci/config.yml', 't', NULL, '', 'pytest $'),
      ('.circleci/config.yml', 'b', NULL, 't', 'make build'), ('Jenkinsfile', 'Jenkinsfile', NULL, '', 'pytest $;make build'), ('azure-pipelines.yml', 'azure', NULL, '', 'pytest $')) v(path, job, stage, needs, items)""",
    "src29_reports": f"""SELECT id AS repo, f AS folder, CAST(CASE f WHEN 'a' THEN n ELSE 1 END AS BIGINT) AS covered, CAST(CASE f WHEN 'a' THEN 2 * n WHEN 'b' THEN n ELSE n + 1 END AS BIGINT) AS total FROM (SELECT id, coalesce(source_loc, 7) AS n FROM {_S}), (VALUES ('a'), ('b'), ('')) v(f) WHERE n > 0""",
    "snk03_scores": f"SELECT status, id AS scan_id, CASE status WHEN 'completed' THEN 2 ELSE 1 END::DOUBLE AS score FROM {_S}",
    "snk06_exported": f"SELECT kind, analyzer, n, note FROM (SELECT analyzer, count(*) AS n, max(message) AS note FROM {_F} GROUP BY 1), (VALUES ('csv'), ('json')) v(kind)",
    "set03_gained_and_lost": f"SELECT id, array_to_string(list_sort(list_transform(list_distinct(list_filter(cwe_ids, lambda x: x NOT IN (79, 22, 89))), lambda x: x::VARCHAR)), ',') AS gained, array_to_string(list_sort(list_transform(list_filter([79, 22, 89], lambda x: NOT list_contains(cwe_ids, x)), lambda x: x::VARCHAR)), ',') AS lost FROM {_F} WHERE cwe_ids IS NOT NULL",
    "gr11_depths": f"{modules._WITH} SELECT scan_id, CAST(count(DISTINCT string_split(path, '/')[1]) AS INT) AS nodes, CAST(count(DISTINCT string_split(path, '/')[1]) - 2 AS INT) AS depth FROM n GROUP BY 1 HAVING count(DISTINCT string_split(path, '/')[1]) > 1",
    "gr12_lock_depths": f"SELECT repo, depth FROM ({files.ORACLE['src21_uv_locks']})",
    "ext03_failures_apart": "SELECT DISTINCT result_id FROM bandit_output",
}
