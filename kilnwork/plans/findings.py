"""Findings: from tool results to one table, their kinds, fingerprints, groups, pages and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnwork.functions import findings as fn
from kilnwork.operators import merging, scoring
from kilnwork.runtime import one_per_key, table


def findings(spark: SparkSession, d: str) -> DataFrame:
    return one_per_key(table(spark, d, "findings"), "id")


def scans(spark: SparkSession, d: str) -> DataFrame:
    return one_per_key(table(spark, d, "scans"), "id")


# -- tool results to findings


def src10_semgrep_findings(spark: SparkSession, d: str) -> DataFrame:
    numbers = fn.weakness_numbers(F.col("extra.metadata.cwe"))
    lines = F.col("extra.lines")
    rows = one_per_key(table(spark, d, "semgrep_output"), "result_id").where("check_id is not null and path is not null")
    out = rows.select(
        "scan_id",
        "result_id",
        F.regexp_replace("check_id", r"^rules\.", "").alias("rule_id"),
        fn.semgrep_severity(F.col("extra.severity")).alias("severity"),
        fn.plain_path(F.col("path")).alias("file_path"),
        F.col("start.line").alias("start_line"),
        F.greatest("end_pos.line", "start.line").alias("end_line"),
        F.trim(F.coalesce("extra.message", F.lit(""))).alias("message"),
        F.when(~F.trim(lines).isin("", "requires login"), lines).alias("code_snippet"),
        numbers.alias("cwe_ids"),
        F.col("start.col").alias("c1"),
        F.col("end_pos.col").alias("c2"),
    )
    place = ["scan_id", "rule_id", "file_path", "start_line", "c1", "end_line", "c2"]
    first = F.row_number().over(Window.partitionBy(*place).orderBy("result_id"))
    out = out.withColumn("n", first).where("n = 1").drop("n", "c1", "c2")
    kind = fn.weakness_kind(F.col("rule_id"), F.col("cwe_ids"))
    return out.withColumn("category", kind).drop("cwe_ids", "code_snippet")


def src11_bandit_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = one_per_key(table(spark, d, "bandit_output"), "result_id").where("test_id is not null and filename is not null")
    numbers = F.when(F.col("issue_cwe.id").isNotNull(), F.array("issue_cwe.id")).otherwise(F.array().cast("array<int>"))
    return rows.select(
        "result_id",
        F.col("test_id").alias("rule_id"),
        fn.bandit_severity(F.col("issue_severity"), F.col("issue_confidence")).alias("severity"),
        fn.plain_path(F.col("filename")).alias("file_path"),
        F.col("line_number").alias("start_line"),
        F.greatest("line_number", F.array_max("line_range")).alias("end_line"),
        F.trim(F.coalesce("issue_text", F.lit(""))).alias("message"),
        fn.weakness_kind(F.concat_ws(" ", "test_id", "test_name"), numbers).alias("category"),
    )


def src12_ruff_findings(spark: SparkSession, d: str) -> DataFrame:
    rows = one_per_key(table(spark, d, "ruff_output"), "result_id").where("filename is not null and location.row is not null")
    rule = F.coalesce(F.nullif("code", F.lit("")), F.nullif("name", F.lit("")), F.lit("syntax-error"))
    return rows.select(
        "result_id",
        "scan_id",
        rule.alias("rule_id"),
        fn.ruff_severity(F.col("code")).alias("severity"),
        fn.plain_path(F.col("filename")).alias("file_path"),
        F.col("location.row").alias("start_line"),
        F.greatest(F.coalesce("end_location.row", "location.row"), "location.row").alias("end_line"),
        F.concat(F.lit("code-quality:"), rule).alias("category"),
    )


_PATH = "array_to_string(list_filter(string_split(regexp_replace(replace({0}, '\\', '/'), '^/src/', ''), '/'), lambda x: x <> '' AND x <> '.'), '/')"
_WORDS = " ".join(f"WHEN regexp_matches(lower({{0}}), '{p}') THEN '{k}'" for k, p in fn.KIND_WORDS)
_NUMBERS = " ".join(f"WHEN {{0}} IN ({', '.join(map(str, ns))}) THEN '{k}'" for k, ns in fn.KIND_NUMBERS.items())
_ONE_SEMGREP = "(SELECT DISTINCT ON (result_id) * FROM semgrep_output)"
_SEV = "CASE upper({0}) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fn.SEMGREP_SEVERITIES.items()) + " ELSE 'info' END"
_F = "(SELECT DISTINCT ON (id) * FROM findings)"
_S = "(SELECT DISTINCT ON (id) * FROM scans)"
_RANK = "CASE lower(trim({0}, E' \\t\\r\\n')) WHEN 'info' THEN 1 WHEN 'warning' THEN 2 WHEN 'error' THEN 3 WHEN 'critical' THEN 4 ELSE 0 END"
_SEVERITY = "CASE WHEN lower(trim({0}, E' \\t\\r\\n')) IN ('info', 'warning', 'error', 'critical') THEN lower(trim({0}, E' \\t\\r\\n')) END"
_RUFF = "CASE WHEN coalesce(code, '') = '' THEN 'error' " + " ".join(
    f"WHEN starts_with(code, '{p}') THEN '{s}'" for p, s in fn.RUFF_PREFIXES
) + " ELSE 'info' END"


# -- classification and identity


def prj05_kinds(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    return f.groupBy(fn.weakness_kind(F.col("rule_id"), F.col("cwe_ids")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def prj07_paths(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    return f.select("id", fn.plain_path(F.col("file_path")).alias("path"), fn.is_test_path(F.col("file_path")).alias("in_tests"))


def prj12_findings_filter(spark: SparkSession, d: str) -> DataFrame:
    """Severity, reporter among analyzer or corroborators, and text without case."""
    f = findings(spark, d)
    wanted = F.array(F.lit("semgrep"), F.lit("bandit"))
    reporter = F.col("analyzer").isin("semgrep", "bandit") | F.arrays_overlap("corroborated_by", wanted)
    text = F.lower("message").contains("credential") | F.lower("rule_id").contains("credential")
    return f.where(fn.severity(F.col("severity")).isin("error", "critical") & reporter & text).select("id", "scan_id")


def str13_identities(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).select("id", F.md5(fn.identity()).alias("identity"))


def str14_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).select("id", fn.fingerprint().alias("fingerprint"))


def win01_distinct_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """The n-th copy of a fingerprint in a scan gets one of its own."""
    f = findings(spark, d)
    n = F.row_number().over(Window.partitionBy("scan_id", "fingerprint").orderBy("id"))
    own = F.sha2(F.concat_ws(":", "fingerprint", F.col("id").cast("string")), 256)
    return f.withColumn("copy", n).select("id", F.when(n > 1, own).otherwise(F.col("fingerprint")).alias("fingerprint"))


def win04_groups(spark: SparkSession, d: str) -> DataFrame:
    return merging.anchors(findings(spark, d))


def agg14_merged(spark: SparkSession, d: str) -> DataFrame:
    return merging.merged(findings(spark, d)).select("scan_id", "anchor_id", "id", "severity", "n_merged")


def _base_head(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Findings of each repository's latest completed scan, and of the one before."""
    done = scans(spark, d).where("status = 'completed' and repo_name is not null")
    order = Window.partitionBy("repo_owner", "repo_name").orderBy(F.desc("created_at"), "id")
    last = done.withColumn("n", F.row_number().over(order)).where("n <= 2")
    rows = findings(spark, d).join(last.selectExpr("id as scan_id", "repo_owner", "repo_name", "n"), "scan_id")
    rows = rows.select("id", "n", F.concat_ws("/", "repo_owner", "repo_name").alias("repo"), fn.identity().alias("identity"))
    return rows.where("n = 2"), rows.where("n = 1")


def jn08_compare_scans(spark: SparkSession, d: str) -> DataFrame:
    base, head = _base_head(spark, d)
    both = merging.compared(base, head, ["repo", "identity"])
    return both.groupBy("repo", "outcome").agg(F.count(F.lit(1)).alias("n"))


def set02_bags(spark: SparkSession, d: str) -> DataFrame:
    base, head = (x.select("repo", "identity") for x in _base_head(spark, d))
    parts = [("new", head.exceptAll(base)), ("resolved", base.exceptAll(head)), ("unchanged", head.intersectAll(base))]
    out = [p.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit(name)) for name, p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def win05_line_islands(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).where("file_path is not null and start_line is not null")
    return merging.islands(f.select("scan_id", "file_path", "start_line", "end_line"), ["scan_id", "file_path"], "start_line", "end_line")


_IDENTITY = r"""CASE WHEN dependency IS NOT NULL THEN concat_ws(chr(31), analyzer, rule_id, coalesce(dependency.ecosystem, ''),
  coalesce(dependency.package, ''), coalesce(dependency.installed_version, ''))
  ELSE concat_ws(chr(31), analyzer, rule_id, file_path,
    CASE WHEN coalesce(trim(regexp_replace(code_snippet, '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' ', 'g')), '') <> '' THEN trim(regexp_replace(code_snippet, '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' ', 'g'))
    ELSE trim(regexp_replace(regexp_replace(message, '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' ', 'g'), '\d+', '#', 'g')) END) END"""
_COMPARED = f"""WITH l AS (SELECT id AS scan_id, repo_owner || '/' || repo_name AS repo,
    row_number() OVER (PARTITION BY repo_owner, repo_name ORDER BY created_at DESC, id) AS n
  FROM {_S} WHERE status = 'completed' AND repo_name IS NOT NULL),
r AS (SELECT f.id, n, repo, {_IDENTITY} AS identity FROM {_F} f JOIN l USING (scan_id) WHERE n <= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY n, repo, identity ORDER BY id) AS c FROM r),
x AS (SELECT coalesce(a.repo, b.repo) AS repo,
  CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'resolved' ELSE 'unchanged' END AS outcome
  FROM (SELECT * FROM k WHERE n = 2) a FULL JOIN (SELECT * FROM k WHERE n = 1) b USING (repo, identity, c))
SELECT repo, outcome, count(*) AS n FROM x GROUP BY ALL"""


# -- counts, pages


def agg01_by_severity(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    return f.groupBy("scan_id", fn.severity(F.col("severity")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def agg02_by_reporter(spark: SparkSession, d: str) -> DataFrame:
    """A finding counts once for each tool that reported it (also JN20, ARR03)."""
    f = findings(spark, d)
    reporters = F.array_distinct(F.array_append(F.coalesce("corroborated_by", F.array().cast("array<string>")), F.col("analyzer")))
    return f.select("scan_id", F.explode(reporters).alias("reporter")).groupBy("scan_id", "reporter").agg(F.count(F.lit(1)).alias("n"))


def agg03_severity_columns(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).withColumn("s", fn.severity(F.col("severity")))
    return f.groupBy("scan_id").pivot("s", list(fn.SEVERITIES)).agg(F.count(F.lit(1))).fillna(0)


def agg52_common_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules by count, the one seen first before others of the same count."""
    f = findings(spark, d).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return f.orderBy(F.desc("n"), "first_id").limit(20)


def agg54_rules_by_top_directory(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    return f.groupBy("rule_id", F.split(fn.plain_path(F.col("file_path")), "/")[0].alias("top")).agg(F.count(F.lit(1)).alias("n"))


def tk01_findings_page(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    order = [F.desc(fn.severity_rank(F.col("severity"))), F.desc(F.size("corroborated_by")), "file_path", "start_line", "id"]
    return f.orderBy(*order).offset(50).limit(50).select("id")


def jn06_page_with_fixes(spark: SparkSession, d: str) -> DataFrame:
    """The page first, then the join: only 50 findings meet the fixes."""
    page = tk01_findings_page(spark, d)
    fixes = one_per_key(table(spark, d, "fix_suggestions"), "id").where("deleted_at is null")
    last = fixes.groupBy(F.col("finding_id").alias("id")).agg(F.max_by("status", "id").alias("fix_status"))
    return page.join(last, "id", "left")


def tk02_top_fixable(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).where("analyzer <> 'architecture'")
    order = [
        F.desc(F.coalesce("score_impact", F.lit(0.0))),
        F.desc(fn.severity_rank(F.col("severity"))),
        F.desc(F.size("corroborated_by")),
        "file_path",
        "start_line",
        "id",
    ]
    return f.orderBy(*order).limit(25).select("id", F.coalesce("score_impact", F.lit(0.0)).alias("priority"))


def tk03_pages(spark: SparkSession, d: str) -> DataFrame:
    n = findings(spark, d).groupBy("scan_id").agg(F.count(F.lit(1)).alias("total"))
    return n.withColumn("pages", F.ceil(F.col("total") / 50))


def jn07_fix_candidates(spark: SparkSession, d: str) -> DataFrame:
    fixes = one_per_key(table(spark, d, "fix_suggestions"), "id").where("status = 'ready' and deleted_at is null")
    f = findings(spark, d).select(F.col("id").alias("finding_id"), "score_impact")
    both = fixes.select("id", "finding_id").join(f, "finding_id")
    return both.orderBy(F.desc_nulls_last("score_impact"), "id").limit(100).select("id", "finding_id", "score_impact")


def win09_fix_chunks(spark: SparkSession, d: str) -> DataFrame:
    """At most 5 findings of one scan, rule and file to a request, the most severe first."""
    f = findings(spark, d)
    order = Window.partitionBy("scan_id", "rule_id", "file_path").orderBy(F.desc(fn.severity_rank(F.col("severity"))), "id")
    return f.select("id", F.floor((F.row_number().over(order) - 1) / 5).alias("chunk"))


def win13_capped_per_rule(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    n = f.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("rule_id", F.least(F.col("n"), F.lit(200)).alias("kept"), F.greatest(F.col("n") - 200, F.lit(0)).alias("omitted"))


def win12_shares(spark: SparkSession, d: str) -> DataFrame:
    n = findings(spark, d).groupBy("scan_id", "analyzer").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("scan_id")), 6))


def win06_busiest_files(spark: SparkSession, d: str) -> DataFrame:
    """Each scan's first tenth of files by findings, at least one."""
    n = findings(spark, d).groupBy("scan_id", "file_path").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("scan_id").orderBy(F.desc("n"), "file_path")
    of = F.count(F.lit(1)).over(Window.partitionBy("scan_id"))
    placed = n.withColumns({"place": F.row_number().over(order), "of": of})
    return placed.where(F.col("place") <= F.greatest(F.lit(1), F.ceil(F.col("of") / 10))).select("scan_id", "file_path", "n")


# -- scores


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    files = findings(spark, d).groupBy("scan_id").agg(F.count_distinct("file_path").alias("modules"))
    loc = scans(spark, d).select(F.col("id").alias("scan_id"), F.coalesce("source_loc", F.lit(0)).alias("loc"))
    return files.join(loc, "scan_id", "left")


def agg09_rule_penalties(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.rule_penalties(scoring.weighted(findings(spark, d)))
    return out.withColumn("rule_penalty", F.round("rule_penalty", 4))


def agg10_category_scores(spark: SparkSession, d: str) -> DataFrame:
    c = scoring.category_scores(findings(spark, d), _sizes(spark, d))
    return c.select("scan_id", "category_name", F.round("penalty", 4).alias("penalty"), F.round("score", 4).alias("score"), F.round("weight", 4).alias("weight"), "n_findings")


def agg10_overall(spark: SparkSession, d: str) -> DataFrame:
    o = scoring.overall_scores(scoring.category_scores(findings(spark, d), _sizes(spark, d)))
    return o.withColumn("overall", F.round("overall", 2))


def win02_removals(spark: SparkSession, d: str) -> DataFrame:
    out = scoring.removal_penalties(scoring.weighted(findings(spark, d)))
    return out.select("scan_id", "id", F.round("without", 4).alias("penalty_without"))


def win03_impacts(spark: SparkSession, d: str) -> DataFrame:
    return scoring.impacts(findings(spark, d), _sizes(spark, d)).withColumn("impact", F.round("impact", 4))


def tk05_worst_rules(spark: SparkSession, d: str) -> DataFrame:
    p = scoring.rule_penalties(scoring.weighted(findings(spark, d)))
    order = Window.partitionBy("scan_id", "category_name").orderBy(F.desc(F.round("rule_penalty", 6)), "rule")
    return p.withColumn("place", F.row_number().over(order)).where("place <= 3").select("scan_id", "category_name", "rule", "place")


def jn01_scans_with_scores(spark: SparkSession, d: str) -> DataFrame:
    o = agg10_overall(spark, d)
    s = scans(spark, d).select(F.col("id").alias("scan_id"), "status", "created_at")
    page = s.orderBy(F.desc("created_at"), "scan_id").limit(100)
    return page.join(o, "scan_id", "left").select("scan_id", "status", "overall", "grade")


def _case(column: str, values: dict[str, object]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


_CATEGORY = _case("analyzer", {a: f"'{n}'" for n, analyzers, *_ in scoring.CATEGORIES for a in analyzers})
_WEIGHT = f"""(CASE WHEN analyzer = 'ruff' THEN list_extract([0.1, 0.1, 0.5, 1.5, 3.0], r + 1) ELSE list_extract([0.5, 0.5, 2.0, 5.0, 10.0], r + 1) END)::DOUBLE
  * CASE WHEN len(corroborated_by) > 0 THEN 1.25 ELSE 1.0 END * CASE WHEN regexp_matches(lower(file_path), '{fn.TEST_PATH}') THEN 0.2 ELSE 1.0 END"""
_SCORES = f"""WITH f0 AS (SELECT *, {_RANK.format('severity')} AS r, {_CATEGORY} AS category_name FROM {_F} WHERE {_CATEGORY} IS NOT NULL),
w AS (SELECT scan_id, id, category_name, analyzer || ':' || rule_id AS rule, {_WEIGHT} AS weight FROM f0),
p AS (SELECT *, row_number() OVER (PARTITION BY scan_id, category_name, rule ORDER BY weight DESC, id) AS place FROM w),
q AS (SELECT *, weight * pow(place, -0.75) AS part,
  CASE WHEN place > 1 THEN weight * (pow(place - 1, -0.75) - pow(place, -0.75)) ELSE 0 END AS up FROM p),
rp AS (SELECT scan_id, category_name, rule, sum(part) AS rule_penalty, count(*) AS n_findings FROM q GROUP BY ALL),
z AS (SELECT scan_id, count(DISTINCT file_path) AS modules FROM {_F} GROUP BY scan_id),
y AS (SELECT z.scan_id, modules, coalesce(source_loc, 0) AS loc FROM z LEFT JOIN {_S} s ON s.id = z.scan_id),
c0 AS (SELECT scan_id, category_name, sum(rule_penalty) AS raw, CAST(sum(n_findings) AS BIGINT) AS n_findings FROM rp GROUP BY ALL),
c1 AS (SELECT c0.*, CASE category_name WHEN 'security' THEN least(6.0, pow(greatest(1.0, loc / 1000), 1.0 / 3))
    WHEN 'dependencies' THEN 1.0 WHEN 'architecture' THEN sqrt(greatest(1.0, modules / 20)) ELSE sqrt(greatest(1.0, loc / 1000)) END AS size,
  CASE category_name WHEN 'security' THEN 12.0 WHEN 'architecture' THEN 20.0 ELSE 25.0 END AS half,
  CASE category_name WHEN 'security' THEN 0.4 ELSE 0.2 END::DOUBLE AS share FROM c0 JOIN y USING (scan_id)),
c AS (SELECT scan_id, category_name, raw / size AS penalty, size, half, n_findings, 100 * exp(-(raw / size) * ln(2) / half) AS score,
  share / sum(share) OVER (PARTITION BY scan_id) AS weight FROM c1),
o AS (SELECT scan_id, round(sum(score * weight), 2) AS overall FROM c GROUP BY scan_id),
g AS (SELECT *, CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 80 THEN 'B' WHEN overall >= 70 THEN 'C' WHEN overall >= 55 THEN 'D' ELSE 'F' END AS grade FROM o),
x AS (SELECT scan_id, category_name, id, sum(part) OVER k - part + coalesce(sum(up) OVER (k ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS without,
  sum(part) OVER k AS rule_penalty FROM q WINDOW k AS (PARTITION BY scan_id, category_name, rule))
"""

QUERIES = {
    f.__name__: f
    for f in (
        src10_semgrep_findings,
        src11_bandit_findings,
        src12_ruff_findings,
        prj05_kinds,
        prj07_paths,
        prj12_findings_filter,
        str13_identities,
        str14_fingerprints,
        win01_distinct_fingerprints,
        win04_groups,
        agg14_merged,
        jn08_compare_scans,
        set02_bags,
        win05_line_islands,
        agg01_by_severity,
        agg02_by_reporter,
        agg03_severity_columns,
        agg52_common_rules,
        agg54_rules_by_top_directory,
        tk01_findings_page,
        jn06_page_with_fixes,
        tk02_top_fixable,
        tk03_pages,
        jn07_fix_candidates,
        win09_fix_chunks,
        win13_capped_per_rule,
        win12_shares,
        win06_busiest_files,
        agg09_rule_penalties,
        agg10_category_scores,
        agg10_overall,
        win02_removals,
        win03_impacts,
        tk05_worst_rules,
        jn01_scans_with_scores,
    )
}

# Each file's findings of a kind in order: one joins the group at hand or begins the next.
_GROUPS = f"""WITH RECURSIVE b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scan_id, path, kind ORDER BY s, id) AS k FROM (SELECT scan_id, id, {_PATH.format('file_path')} AS path, coalesce(category, 'rule:' || analyzer || ':' || rule_id, 'rule:' || coalesce(analyzer, rule_id), 'rule') AS kind, start_line AS s, coalesce(end_line, start_line) AS e FROM {_F})
    WHERE scan_id IS NOT NULL AND path IS NOT NULL AND s IS NOT NULL),
  r AS (SELECT scan_id, path, kind, k, id, s AS a, e AS z, id AS anchor_id FROM b WHERE k = 1
    UNION ALL SELECT b.scan_id, b.path, b.kind, b.k, b.id, CASE WHEN j THEN r.a ELSE b.s END, CASE WHEN j THEN r.z ELSE b.e END, CASE WHEN j THEN r.anchor_id ELSE b.id END
    FROM r JOIN b ON b.scan_id = r.scan_id AND b.path = r.path AND b.kind = r.kind AND b.k = r.k + 1, LATERAL (SELECT r.a = b.s OR (r.z - r.a <= 5 AND r.z >= b.s) AS j))"""

ORACLE = {
    "win04_groups": f"{_GROUPS} SELECT scan_id, id, anchor_id FROM r",
    "agg14_merged": f"""{_GROUPS}, f AS (SELECT r.scan_id, anchor_id, f.id, {_RANK.format('severity')} AS n, coalesce(length(trim(message)), -1) AS l, (code_snippet IS NOT NULL)::INT AS c FROM r JOIN {_F} f ON f.id = r.id)
      SELECT scan_id, anchor_id, arg_max(id, (l, n, c, -id)) AS id, CASE max(n) WHEN 2 THEN 'warning' WHEN 3 THEN 'error' WHEN 4 THEN 'critical' ELSE 'info' END AS severity, count(*) AS n_merged FROM f GROUP BY 1, 2""",
    "src10_semgrep_findings": f"""WITH o AS (
      SELECT scan_id, result_id, regexp_replace(check_id, '^rules\\.', '') AS rule_id, {_SEV.format('extra.severity')} AS severity,
        {_PATH.format('path')} AS file_path, "start".line AS start_line, greatest(end_pos.line, "start".line) AS end_line,
        trim(coalesce(extra.message, '')) AS message, "start".col AS c1, end_pos.col AS c2,
        flatten(list_transform(list_filter(extra.metadata.cwe, lambda x: x IS NOT NULL), lambda x: regexp_extract_all(x, '(?i)CWE-(\\d+)', 1))) AS ns
      FROM {_ONE_SEMGREP} WHERE check_id IS NOT NULL AND path IS NOT NULL)
      SELECT scan_id, result_id, rule_id, severity, file_path, start_line, end_line, message,
        coalesce(CASE {_WORDS.format('rule_id')} END, list_extract(list_filter(list_transform(ns, lambda n: CASE {_NUMBERS.format('CAST(n AS INTEGER)')} END), lambda k: k IS NOT NULL), 1)) AS category
      FROM o QUALIFY row_number() OVER (PARTITION BY scan_id, rule_id, file_path, start_line, c1, end_line, c2 ORDER BY result_id) = 1""",
    "src11_bandit_findings": f"""SELECT result_id, test_id AS rule_id,
      CASE upper(issue_severity) WHEN 'MEDIUM' THEN CASE upper(issue_confidence) WHEN 'LOW' THEN 'info' ELSE 'warning' END
        WHEN 'HIGH' THEN CASE upper(issue_confidence) WHEN 'LOW' THEN 'warning' ELSE 'error' END ELSE 'info' END AS severity,
      {_PATH.format('filename')} AS file_path, line_number AS start_line, greatest(line_number, list_max(line_range)) AS end_line,
      trim(coalesce(issue_text, '')) AS message,
      coalesce(CASE {_WORDS.format("concat_ws(' ', test_id, test_name)")} END, CASE {_NUMBERS.format('issue_cwe.id')} END) AS category
      FROM (SELECT DISTINCT ON (result_id) * FROM bandit_output) WHERE test_id IS NOT NULL AND filename IS NOT NULL""",
    "src12_ruff_findings": f"""WITH o AS (SELECT *, coalesce(nullif(code, ''), nullif(name, ''), 'syntax-error') AS rule
        FROM (SELECT DISTINCT ON (result_id) * FROM ruff_output) WHERE filename IS NOT NULL AND location.row IS NOT NULL)
      SELECT result_id, scan_id, rule AS rule_id, {_RUFF} AS severity, {_PATH.format('filename')} AS file_path,
        location.row AS start_line, greatest(coalesce(end_location.row, location.row), location.row) AS end_line,
        'code-quality:' || rule AS category FROM o""",
    "prj05_kinds": f"""SELECT coalesce(CASE {_WORDS.format('rule_id')} END, list_extract(list_filter(list_transform(cwe_ids, lambda n: CASE {_NUMBERS.format('n')} END), lambda k: k IS NOT NULL), 1)) AS kind,
      count(*) AS n FROM {_F} GROUP BY ALL""",
    "prj07_paths": f"SELECT id, {_PATH.format('file_path')} AS path, regexp_matches(lower(file_path), '{fn.TEST_PATH}') AS in_tests FROM {_F}",
    "prj12_findings_filter": f"""SELECT id, scan_id FROM {_F} WHERE {_RANK.format('severity')} >= 3
      AND (analyzer IN ('semgrep', 'bandit') OR list_has_any(corroborated_by, ['semgrep', 'bandit']))
      AND (contains(lower(message), 'credential') OR contains(lower(rule_id), 'credential'))""",
    "str13_identities": f"SELECT id, md5({_IDENTITY}) AS identity FROM {_F}",
    "str14_fingerprints": f"""SELECT id, sha256(coalesce(analyzer, '') || '|' || coalesce(rule_id, '') || '|' || coalesce(file_path, '') || '|' || coalesce(start_line::VARCHAR, '')
      || '|' || coalesce(end_line::VARCHAR, '') || '|' || coalesce(message, '') || '|' || coalesce(dependency.package, '') || '|' || coalesce(dependency.installed_version, '')) AS fingerprint FROM {_F}""",
    "win01_distinct_fingerprints": f"""SELECT id, CASE WHEN row_number() OVER (PARTITION BY scan_id, fingerprint ORDER BY id) > 1
      THEN sha256(fingerprint || ':' || id) ELSE fingerprint END AS fingerprint FROM {_F}""",
    "jn08_compare_scans": _COMPARED,
    "set02_bags": _COMPARED,
    "win05_line_islands": f"""WITH a AS (SELECT scan_id, file_path, start_line, end_line, max(end_line) OVER (PARTITION BY scan_id, file_path ORDER BY start_line, end_line
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {_F} WHERE file_path IS NOT NULL AND start_line IS NOT NULL),
      b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_line > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id, file_path ORDER BY start_line, end_line
        ROWS UNBOUNDED PRECEDING) AS k FROM a)
      SELECT scan_id, file_path, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS n_ranges FROM b GROUP BY scan_id, file_path, k""",
    "agg01_by_severity": f"SELECT scan_id, {_SEVERITY.format('severity')} AS severity, count(*) AS n FROM {_F} GROUP BY ALL",
    "agg02_by_reporter": f"""SELECT scan_id, reporter, count(*) AS n FROM (SELECT scan_id, unnest(list_distinct(list_append(coalesce(corroborated_by, []), analyzer))) AS reporter FROM {_F}) GROUP BY ALL""",
    "agg03_severity_columns": f"""SELECT scan_id, count(*) FILTER (s = 'info') AS info, count(*) FILTER (s = 'warning') AS warning, count(*) FILTER (s = 'error') AS error,
      count(*) FILTER (s = 'critical') AS critical FROM (SELECT scan_id, {_SEVERITY.format('severity')} AS s FROM {_F}) GROUP BY scan_id""",
    "agg52_common_rules": f"SELECT rule_id, count(*) AS n, min(id) AS first_id FROM {_F} GROUP BY rule_id ORDER BY n DESC, first_id LIMIT 20",
    "agg54_rules_by_top_directory": f"SELECT rule_id, string_split({_PATH.format('file_path')}, '/')[1] AS top, count(*) AS n FROM {_F} GROUP BY ALL",
    "tk01_findings_page": f"SELECT id FROM {_F} ORDER BY {_RANK.format('severity')} DESC, len(corroborated_by) DESC, file_path, start_line, id LIMIT 50 OFFSET 50",
    "jn06_page_with_fixes": f"""WITH p AS (SELECT id FROM {_F} ORDER BY {_RANK.format('severity')} DESC, len(corroborated_by) DESC, file_path, start_line, id LIMIT 50 OFFSET 50)
      SELECT p.id, fix_status FROM p LEFT JOIN (SELECT finding_id, arg_max(status, id) AS fix_status FROM fix_suggestions WHERE deleted_at IS NULL GROUP BY finding_id) x ON x.finding_id = p.id""",
    "tk02_top_fixable": f"""SELECT id, coalesce(score_impact, 0) AS priority FROM {_F} WHERE analyzer <> 'architecture'
      ORDER BY coalesce(score_impact, 0) DESC, {_RANK.format('severity')} DESC, len(corroborated_by) DESC, file_path, start_line, id LIMIT 25""",
    "tk03_pages": f"SELECT scan_id, count(*) AS total, CAST(ceil(count(*) / 50) AS BIGINT) AS pages FROM {_F} GROUP BY scan_id",
    "jn07_fix_candidates": f"""SELECT x.id, finding_id, score_impact FROM (SELECT DISTINCT ON (id) * FROM fix_suggestions) x JOIN {_F} f ON f.id = x.finding_id
      WHERE x.status = 'ready' AND x.deleted_at IS NULL ORDER BY score_impact DESC NULLS LAST, x.id LIMIT 100""",
    "win09_fix_chunks": f"""SELECT id, (row_number() OVER (PARTITION BY scan_id, rule_id, file_path ORDER BY {_RANK.format('severity')} DESC, id) - 1) // 5 AS chunk FROM {_F}""",
    "win13_capped_per_rule": f"""SELECT rule_id, count(*) FILTER (n <= 200) AS kept, count(*) FILTER (n > 200) AS omitted
      FROM (SELECT rule_id, row_number() OVER (PARTITION BY rule_id ORDER BY {_RANK.format('severity')} DESC, id) AS n FROM {_F}) GROUP BY rule_id""",
    "win12_shares": f"""SELECT scan_id, analyzer, n, round(n / sum(n) OVER (PARTITION BY scan_id), 6) AS share FROM (SELECT scan_id, analyzer, count(*) AS n FROM {_F} GROUP BY ALL)""",
    "win06_busiest_files": f"""SELECT scan_id, file_path, n FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, file_path) AS place, count(*) OVER (PARTITION BY scan_id) AS k
      FROM (SELECT scan_id, file_path, count(*) AS n FROM {_F} GROUP BY ALL)) WHERE place <= greatest(1, ceil(k / 10))""",
    "agg09_rule_penalties": _SCORES + "SELECT scan_id, category_name, rule, round(rule_penalty, 4) AS rule_penalty, n_findings FROM rp",
    "agg10_category_scores": _SCORES + "SELECT scan_id, category_name, round(penalty, 4) AS penalty, round(score, 4) AS score, round(weight, 4) AS weight, n_findings FROM c",
    "agg10_overall": _SCORES + "SELECT scan_id, overall, grade FROM g",
    "win02_removals": _SCORES + "SELECT scan_id, id, round(without, 4) AS penalty_without FROM x",
    "win03_impacts": _SCORES + """SELECT scan_id, id, round(greatest(0, (100 * exp(-(greatest(0, penalty * size - rule_penalty + without) / size) * ln(2) / half) - score) * weight), 4) AS impact
      FROM x JOIN c USING (scan_id, category_name)""",
    "tk05_worst_rules": _SCORES + """SELECT scan_id, category_name, rule, place FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, category_name ORDER BY round(rule_penalty, 6) DESC, rule) AS place FROM rp) WHERE place <= 3""",
    "jn01_scans_with_scores": _SCORES + f"""SELECT s.id AS scan_id, status, overall, grade FROM (SELECT * FROM {_S} ORDER BY created_at DESC, id LIMIT 100) s LEFT JOIN g ON g.scan_id = s.id""",
}
