"""Operators whose own inputs the test tables lack, over what can be read from those tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnwork.functions import colors, web
from kilnwork.functions import findings as fn
from kilnwork.operators import evaluation, history, sites
from kilnwork.plans.findings import _F, _RANK, _S, findings, scans
from kilnwork.runtime import one_per_key, table
from kilnwork.sources import gitlog

NOW = 1_782_000_000


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Pull requests as the records of a commit log."""
    p = one_per_key(table(spark, d, "pull_requests"), "id")
    fields = [F.col("id").cast("string"), F.lit(""), F.col("user_id"), F.concat("user_id", F.lit("@X.org")), F.unix_timestamp("created_at").cast("string"), F.col("title")]
    files = F.concat(F.lit("\n3\t1\t"), F.col("branch"), F.lit("\n-\t-\tlogo.png"))
    return p.select(F.col("repo_full_name").alias("repo"), F.concat(F.array_join(F.array(*[F.coalesce(f, F.lit("")) for f in fields]), "\x1f"), files).alias("record"))


def _commits(spark: SparkSession, d: str) -> DataFrame:
    return gitlog.commits(_records(spark, d), ("repo",))


def src14_parsed_log(spark: SparkSession, d: str) -> DataFrame:
    c = _commits(spark, d).select("sha", "repo", "author", "at", "subject", F.explode("files").alias("f"))
    return c.select(F.col("sha").cast("bigint").alias("id"), "repo", "author", "at", "subject", "f.path", "f.added")


def agg20_messages(spark: SparkSession, d: str) -> DataFrame:
    m = history.messages(_commits(spark, d))
    return m.select("repo", "n", *[F.round(c, 6).alias(c) for c in ("conventional_share", "low_info_share", "mean_length")])


def agg21_authors(spark: SparkSession, d: str) -> DataFrame:
    return history.authors(_commits(spark, d)).select("repo", "authors", "bus_factor", F.round("author_gini", 6).alias("author_gini"))


def agg24_recency(spark: SparkSession, d: str) -> DataFrame:
    return history.recency(_commits(spark, d), NOW).withColumn("days_since", F.round("days_since", 6))


def win16_main_line(spark: SparkSession, d: str) -> DataFrame:
    """Scans of a repository as a line, each on the one before; the line from the newest."""
    s = scans(spark, d).where("repo_name is not null").select(F.concat_ws("/", "repo_owner", "repo_name").alias("repo"), F.col("id").alias("sha"), "created_at")
    order = Window.partitionBy("repo").orderBy("created_at", "sha")
    c = s.select("repo", "sha", F.array_compact(F.array(F.lag("sha").over(order))).alias("parents"), F.lead("sha").over(order).isNull().alias("head"))
    line = history.main_line(c.drop("head"), c.where("head").select("repo", "sha"))
    return line.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


def ver01_newest_installed(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).where("dependency.installed_version is not null").select("dependency.*")
    return f.groupBy("ecosystem", "package").agg(F.max_by("installed_version", fn.version_key(F.col("installed_version"))).alias("newest"))


def _rgb(c: str) -> list[Column]:
    return [F.pmod(F.col(c) * k, F.lit(256)).cast("double") for k in (7, 31, 101)]


def mth06_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Colours made of two numbers of a part."""
    p = table(spark, d, "part")
    a, b = colors.luminance(*_rgb("p_partkey")), colors.luminance(*_rgb("p_size"))
    return p.select("p_partkey", F.round(colors.contrast(a, b), 6).alias("contrast"))


def mth05_distance(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(colors.distance(colors.oklab(*_rgb("p_partkey")), colors.oklab(*_rgb("p_size"))), 5).alias("distance"))


def mth07_similarity(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    s = web.hash_similarity(F.substring("fingerprint", 1, 16), F.substring("fingerprint", 17, 16))
    return f.select("id", s.alias("similarity"))


def agg48_collinearity(spark: SparkSession, d: str) -> DataFrame:
    names = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("r"), *names)
    long = rows.unpivot("r", list(names), "name", "value")
    return evaluation.collinearity(long, "r", "name", "value").withColumn("rho", F.round("rho", 6))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).withColumn("rank", fn.severity_rank(F.col("severity")))
    per = f.groupBy(F.col("scan_id").alias("record_id"), F.col("analyzer").alias("signal")).agg(F.sum(F.when(F.col("rank") >= 3, F.col("rank")).otherwise(0)).alias("points"))
    return per.withColumn("category", F.lit("tool"))


def agg31_assessed(spark: SparkSession, d: str) -> DataFrame:
    return sites.assessed(_evidence(spark, d)).select("record_id", "score", "level", F.array_join("top", ",").alias("top"))


def agg42_signals(spark: SparkSession, d: str) -> DataFrame:
    labels = scans(spark, d).select(F.col("id").alias("record_id"), (F.col("status") != "completed").alias("bad"))
    t = evaluation.signal_table(_evidence(spark, d), labels)
    return t.select("signal", "fired", "fired_bad", *[F.round(c, 6).alias(c) for c in ("precision", "share_bad", "share_good")])


def agg34_line_shares(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    s = sites.usage_shares(f, ["scan_id"], "category", F.col("end_line") - F.col("start_line") + 1)
    return s.withColumn("share", F.round("share", 6))


def agg35_column_base(spark: SparkSession, d: str) -> DataFrame:
    b = one_per_key(table(spark, d, "bandit_output"), "result_id")
    return sites.spacing_base(b, ["test_id"], "col_offset")


def dt02_ages(spark: SparkSession, d: str) -> DataFrame:
    age = sites.age_bucket(F.to_date("created_at"), F.lit("2026-07-01").cast("date"))
    return scans(spark, d).groupBy(age.alias("age")).agg(F.count(F.lit(1)).alias("n"))


def jn21_inversions(spark: SparkSession, d: str) -> DataFrame:
    """Rules whose mean severity is two steps apart and whose mean impact is the other way round."""
    f = findings(spark, d).where("score_impact is not null")
    r = f.groupBy("rule_id").agg(F.max(fn.severity_rank(F.col("severity"))).alias("label"), F.min("score_impact").alias("score"))
    return evaluation.inversions(r, "rule_id", "label", "score")


def arr05_rotated(spark: SparkSession, d: str) -> DataFrame:
    """Arrays turned so that the least element comes first."""
    at = F.array_position("cwe_ids", F.array_min("cwe_ids")).cast("int")
    turned = F.concat(F.slice("cwe_ids", at, F.size("cwe_ids")), F.slice("cwe_ids", F.lit(1), at - 1))
    return findings(spark, d).where("size(cwe_ids) > 0").select("id", F.array_join(turned.cast("array<string>"), ",").alias("cycle"))


def jn11_loose_names(spark: SparkSession, d: str) -> DataFrame:
    """Repository names in bandit's hints that imitate the names of scanned repositories."""
    b = table(spark, d, "bandit_output").where("repo_hint rlike '^[a-z]+$'").select(F.concat("repo_hint", F.lit(".com")).alias("host")).distinct()
    names = scans(spark, d).where("repo_name is not null").select(F.regexp_replace("repo_name", "[^a-z]", "").alias("keyword")).distinct()
    brands = names.select(F.col("keyword").alias("brand"), F.col("keyword").alias("place"), "keyword")
    return sites.imitated_brands(b, brands)


QUERIES = {
    f.__name__: f
    for f in (
        src14_parsed_log,
        agg20_messages,
        agg21_authors,
        agg24_recency,
        win16_main_line,
        ver01_newest_installed,
        mth06_contrast,
        mth05_distance,
        mth07_similarity,
        agg48_collinearity,
        agg31_assessed,
        agg42_signals,
        agg34_line_shares,
        agg35_column_base,
        dt02_ages,
        jn21_inversions,
        arr05_rotated,
        jn11_loose_names,
    )
}

_P = "(SELECT DISTINCT ON (id) * FROM pull_requests)"
_LIN = "(CASE WHEN {0} / 255.0 <= 0.04045 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END)"


def _rgb_sql(c: str) -> list[str]:
    return [_LIN.format(f"(({c} * {k}) % 256)::DOUBLE") for k in (7, 31, 101)]


def _lum_sql(c: str) -> str:
    return " + ".join(f"{w} * {x}" for w, x in zip((0.2126, 0.7152, 0.0722), _rgb_sql(c)))


def _lab_sql(c: str) -> list[str]:
    cones = ["cbrt(" + " + ".join(f"{m:.10f}::DOUBLE * {x}" for m, x in zip(row, _rgb_sql(c))) + ")" for row in colors.TO_CONES]
    return ["(" + " + ".join(f"({m:.10f})::DOUBLE * {x}" for m, x in zip(row, cones)) + ")" for row in colors.TO_LAB]


_HEX = "('0x' || substr(fingerprint, {0}, 8))::BIGINT"
_EVIDENCE = f"""e AS (SELECT scan_id AS record_id, analyzer AS signal, sum(CASE WHEN r >= 3 THEN r ELSE 0 END) AS points
  FROM (SELECT *, {_RANK.format('severity')} AS r FROM {_F}) GROUP BY 1, 2)"""
_SERIES = " UNION ALL ".join(f"SELECT l_orderkey || '-' || l_linenumber AS r, '{n}' AS name, {n}::DOUBLE AS v FROM lineitem" for n in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))

ORACLE = {
    "src14_parsed_log": f"""SELECT id, repo_full_name AS repo, coalesce(user_id, '') || ' <' || lower(coalesce(user_id || '@X.org', '')) || '>' AS author, CAST(epoch(created_at) AS BIGINT) AS at,
      coalesce(title, '') AS subject, path, added FROM {_P}, (VALUES (1), (2)) k(k), LATERAL (SELECT CASE k WHEN 1 THEN branch ELSE 'logo.png' END AS path, CASE k WHEN 1 THEN 3 END AS added) WHERE branch IS NOT NULL""",
    "agg20_messages": f"""SELECT repo_full_name AS repo, count(*) AS n, round(avg(CASE WHEN regexp_matches(trim(title), '{history.CONVENTIONAL}') THEN 1 ELSE 0 END), 6) AS conventional_share,
      round(avg(CASE WHEN length(trim(title)) < 8 OR regexp_matches(trim(title), '{history.LOW_INFO}') THEN 1 ELSE 0 END), 6) AS low_info_share, round(avg(length(trim(title))), 6) AS mean_length FROM {_P} GROUP BY 1""",
    "agg21_authors": f"""WITH n AS (SELECT repo_full_name AS repo, user_id, count(*) AS n, 4 * count(*) AS lines FROM {_P} GROUP BY 1, 2),
      k AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY lines DESC, user_id) AS k, sum(lines) OVER (PARTITION BY repo ORDER BY lines DESC, user_id ROWS UNBOUNDED PRECEDING) AS run, sum(lines) OVER (PARTITION BY repo) AS every,
        row_number() OVER (PARTITION BY repo ORDER BY n) AS i FROM n)
      SELECT repo, count(*) AS authors, min(k) FILTER (2 * run >= every) AS bus_factor, round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS author_gini FROM k GROUP BY 1""",
    "agg24_recency": f"""SELECT repo_full_name AS repo, CAST(max(epoch(created_at)) AS BIGINT) AS last_at, round(greatest(0, ({NOW} - max(epoch(created_at))) / 86400), 6) AS days_since,
      count(*) FILTER (epoch(created_at) >= {NOW - history.RECENT}) AS recent FROM {_P} GROUP BY 1""",
    "win16_main_line": f"SELECT repo_owner || '/' || repo_name AS repo, count(*) AS n FROM {_S} WHERE repo_name IS NOT NULL GROUP BY 1",
    "ver01_newest_installed": f"""SELECT dependency.ecosystem AS ecosystem, dependency.package AS package, arg_max(dependency.installed_version, list_transform(string_split(dependency.installed_version, '.'), lambda x: x::INT)) AS newest
      FROM {_F} WHERE dependency.installed_version IS NOT NULL GROUP BY 1, 2""",
    "mth06_contrast": f"SELECT p_partkey, round((greatest(a, b) + 0.05) / (least(a, b) + 0.05), 6) AS contrast FROM (SELECT p_partkey, {_lum_sql('p_partkey')} AS a, {_lum_sql('p_size')} AS b FROM part)",
    "mth05_distance": "SELECT p_partkey, round(sqrt("
    + " + ".join(f"pow({a} - {b}, 2)" for a, b in zip(_lab_sql("p_partkey"), _lab_sql("p_size")))
    + "), 5) AS distance FROM part",
    "mth07_similarity": f"""SELECT id, 1 - (bit_count(xor({_HEX.format(1)}, {_HEX.format(17)})) + bit_count(xor({_HEX.format(9)}, {_HEX.format(25)}))) / 64 AS similarity FROM {_F}""",
    "agg48_collinearity": f"""WITH s AS ({_SERIES}), j AS (SELECT x.name AS a, y.name AS b, x.v AS xv, y.v AS yv FROM s x JOIN s y ON x.r = y.r AND x.name < y.name),
      k AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY xv) + (count(*) OVER (PARTITION BY a, b, xv) - 1) / 2 AS rx, rank() OVER (PARTITION BY a, b ORDER BY yv) + (count(*) OVER (PARTITION BY a, b, yv) - 1) / 2 AS ry FROM j)
      SELECT a, b, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k GROUP BY 1, 2""",
    "agg31_assessed": f"""WITH {_EVIDENCE}, k AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY abs(points) DESC, signal) AS k FROM e)
      SELECT record_id, s AS score, CASE WHEN s >= 70 THEN 'critical' WHEN s >= 45 THEN 'high' WHEN s >= 20 THEN 'medium' ELSE 'low' END AS level, top FROM
      (SELECT record_id, CAST(greatest(0, least(100, sum(points))) AS INT) AS s, coalesce(string_agg(signal, ',' ORDER BY k) FILTER (k <= 3 AND points <> 0), '') AS top FROM k GROUP BY 1)""",
    "agg42_signals": f"""WITH {_EVIDENCE}, l AS (SELECT id AS record_id, status <> 'completed' AS bad FROM {_S}), f AS (SELECT signal, bad FROM e JOIN l USING (record_id) WHERE points > 0)
      SELECT signal, count(*) AS fired, count(*) FILTER (bad) AS fired_bad, round(count(*) FILTER (bad) / count(*), 6) AS "precision",
      round(count(*) FILTER (bad) / (SELECT count(*) FROM l WHERE bad), 6) AS share_bad, round(count(*) FILTER (NOT bad) / (SELECT count(*) FROM l WHERE NOT bad), 6) AS share_good FROM f GROUP BY 1""",
    "agg34_line_shares": f"""SELECT scan_id, category, weight, round(share, 6) AS share FROM (SELECT *, weight / sum(weight) OVER (PARTITION BY scan_id) AS share
      FROM (SELECT scan_id, category, CAST(sum(end_line - start_line + 1) AS BIGINT) AS weight FROM {_F} WHERE category IS NOT NULL GROUP BY 1, 2)) WHERE share >= 0.005""",
    "agg35_column_base": "SELECT test_id, CASE "
    + " ".join(f"WHEN count(*) FILTER (col_offset % {b} = 0) >= 0.8 * count(*) THEN {b}" for b in sites.BASES)
    + " END AS base FROM (SELECT DISTINCT ON (result_id) * FROM bandit_output) WHERE col_offset > 0 GROUP BY 1",
    "dt02_ages": f"""SELECT CASE WHEN a < 7 THEN 'under a week' WHEN a < 30 THEN 'under a month' WHEN a < 90 THEN 'under three months' WHEN a < 365 THEN 'under a year'
      WHEN a >= 1095 THEN 'over three years' ELSE 'neutral' END AS age, count(*) AS n FROM (SELECT DATE '2026-07-01' - CAST(created_at AT TIME ZONE 'UTC' AS DATE) AS a FROM {_S}) GROUP BY 1""",
    "jn21_inversions": f"""WITH r AS (SELECT rule_id, max({_RANK.format('severity')}) AS label, min(score_impact) AS score FROM {_F} WHERE score_impact IS NOT NULL GROUP BY 1)
      SELECT a.rule_id AS better, b.rule_id AS worse FROM r a JOIN r b ON a.label >= b.label + 2 AND a.score < b.score""",
    "arr05_rotated": f"""SELECT id, array_to_string(list_concat(list_slice(cwe_ids, p, len(cwe_ids)), list_slice(cwe_ids, 1, p - 1)), ',') AS cycle
      FROM (SELECT *, list_position(cwe_ids, list_min(cwe_ids)) AS p FROM {_F} WHERE len(cwe_ids) > 0)""",
    "jn11_loose_names": f"""WITH h AS (SELECT DISTINCT repo_hint AS l FROM bandit_output WHERE regexp_matches(repo_hint, '^[a-z]+$')), b AS (SELECT DISTINCT regexp_replace(repo_name, '[^a-z]', '', 'g') AS k FROM {_S} WHERE repo_name IS NOT NULL),
      x AS (SELECT l, k, CASE WHEN l = k THEN 'exact' WHEN replace(replace(replace(l, 'rn', 'm'), 'vv', 'w'), 'cl', 'd') = k THEN 'plain letters' WHEN length(k) >= 5 AND levenshtein(l, k) <= CASE WHEN length(k) >= 8 THEN 2 ELSE 1 END THEN 'near' END AS r FROM h, b)
      SELECT l || '.com' AS host, k AS brand, r AS rule FROM x WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l ORDER BY k) = 1""",
}
