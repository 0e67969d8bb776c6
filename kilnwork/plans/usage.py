"""Calls, spend, quotas, limits, graphs and evaluation statistics over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnwork.functions import findings as fn
from kilnwork.operators import graph, limits, stats
from kilnwork.plans.findings import _F, _PATH, _RANK, _S, findings, scans
from kilnwork.runtime import one_per_key, table


def calls(spark: SparkSession, d: str) -> DataFrame:
    return one_per_key(table(spark, d, "llm_calls"), "id")


def fixes(spark: SparkSession, d: str) -> DataFrame:
    return one_per_key(table(spark, d, "fix_suggestions"), "id")


def _tokens() -> Column:
    """What a call has used, or while it is pending what it has reserved."""
    used = F.col("input_tokens") + F.col("output_tokens") + F.col("cache_read_input_tokens")
    return F.when(F.col("pending"), F.col("reserved_tokens")).otherwise(used)


def _spend() -> list:
    return [
        F.count(F.lit(1)).alias("calls"),
        F.count_if(~F.col("success")).alias("failed"),
        F.round(F.sum("cost_usd").cast("double"), 6).alias("cost_usd"),
    ]


def agg04_spend_by_day(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(*_spend())


def agg04_spend_by_purpose(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d).groupBy("purpose").agg(*_spend())


def jn02_spend_by_owner(spark: SparkSession, d: str) -> DataFrame:
    """Calls to their scans, those without one to nobody; the 50 owners that spent most."""
    owner = scans(spark, d).select(F.col("id").alias("scan_id"), "user_id")
    both = calls(spark, d).join(owner, "scan_id", "left")
    out = both.groupBy(F.coalesce("user_id", F.lit("(anonymous)")).alias("owner")).agg(*_spend())
    return out.orderBy(F.desc("cost_usd"), "owner").limit(50)


def agg05_spend_last_day(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d)
    last = c.agg(F.date_trunc("day", F.max("created_at")).alias("start"))
    return c.join(F.broadcast(last), F.col("created_at") >= F.col("start")).agg(F.round(F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double"), 6).alias("cost_usd"))


def agg06_usage_by_purpose(spark: SparkSession, d: str) -> DataFrame:
    return (
        calls(spark, d)
        .where("scan_id is not null")
        .groupBy("scan_id", "purpose")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.count_if("success").alias("successful"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum("duration_ms").alias("duration_ms"),
            F.max("model").alias("model"),
        )
    )


def agg07_tokens_per_scan(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d).where("scan_id is not null").groupBy("scan_id").agg(F.sum(_tokens()).alias("tokens"))


def jn05_tokens_by_user_month(spark: SparkSession, d: str) -> DataFrame:
    owner = scans(spark, d).where("user_id is not null").select(F.col("id").alias("scan_id"), "user_id")
    both = calls(spark, d).join(owner, "scan_id")
    return both.groupBy("user_id", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.sum(_tokens()).alias("tokens"))


def agg53_scans_by_status(spark: SparkSession, d: str) -> DataFrame:
    """All statuses, those without a scan with 0."""
    names = ("queued", "cloning", "running", "completed", "partial", "failed", "cancelled")
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("status"))
    n = scans(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def agg17_duration_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = [F.round(F.percentile("duration_ms", x), 2).alias(f"p{int(100 * x)}") for x in (0.5, 0.95)]
    return calls(spark, d).groupBy("purpose").agg(*p)


def agg22_gini_of_findings(spark: SparkSession, d: str) -> DataFrame:
    n = findings(spark, d).groupBy("scan_id", "file_path").agg(F.count(F.lit(1)).alias("n"))
    return stats.gini(n, ["scan_id"], "n").withColumn("gini", F.round("gini", 6))


def win07_bus_factor(spark: SparkSession, d: str) -> DataFrame:
    s = scans(spark, d).where("repo_name is not null and user_id is not null")
    n = s.groupBy("repo_owner", "repo_name", "user_id").agg(F.sum(F.coalesce("source_loc", F.lit(0))).alias("loc"))
    return stats.bus_factor(n, ["repo_owner", "repo_name"], "user_id", "loc")


def agg37_spearman(spark: SparkSession, d: str) -> DataFrame:
    out = stats.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return out.withColumn("rho", F.round("rho", 6))


def win10_mean_ranks(spark: SparkSession, d: str) -> DataFrame:
    return stats.value_ranks(table(spark, d, "lineitem"), "l_quantity")


def agg45_cliffs_delta(spark: SparkSession, d: str) -> DataFrame:
    out = stats.cliffs_delta(table(spark, d, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R")
    return out.withColumn("delta", F.round("delta", 6))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    impact = findings(spark, d).where("score_impact is not null").select(F.col("id").alias("finding_id"), F.least(F.lit(100), F.floor(F.col("score_impact") * 10)).cast("int").alias("score"))
    return fixes(spark, d).join(impact, "finding_id").select("score", "validation_status")


def agg40_confusion(spark: SparkSession, d: str) -> DataFrame:
    out = stats.confusion(_scored(spark, d), "score", F.col("validation_status") == "valid")
    return out.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "fpr", "f1")])


def agg41_auc(spark: SparkSession, d: str) -> DataFrame:
    points = stats.confusion(_scored(spark, d), "score", F.col("validation_status") == "valid")
    return stats.auc(points).withColumn("auc", F.round("auc", 6))


def agg51_validation_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of suggestions that validated, by the finding's analyzer."""
    f = findings(spark, d).select(F.col("id").alias("finding_id"), "analyzer")
    return fixes(spark, d).join(f, "finding_id").groupBy("analyzer").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("validation_status") == "valid").cast("int")), 6).alias("valid_share")
    )


def prj28_failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    return fixes(spark, d).groupBy(fn.failure_reason(F.col("validation_detail")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# -- stateful control


def _ms() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp"))


def st01_sliding_limit(spark: SparkSession, d: str) -> DataFrame:
    return limits.admitted(table(spark, d, "events"), "user_id", _ms(), "event_id", 3_600_000, 3)


def st01_trailing_counts(spark: SparkSession, d: str) -> DataFrame:
    return limits.trailing_counts(table(spark, d, "events"), "user_id", _ms(), 3_600_000).select("event_id", "trailing")


def st03_quota_days(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling UTC days; the running total starts anew each month."""
    day = F.date_format("created_at", "yyyy-MM-dd")
    c = calls(spark, d).groupBy(day.alias("day")).agg(F.sum(_tokens()).alias("tokens"))
    run = Window.partitionBy(F.substring("day", 1, 7)).orderBy("day")
    return c.withColumn("month_so_far", F.sum("tokens").over(run))


def st05_first_alerts(spark: SparkSession, d: str) -> DataFrame:
    """The call with which a day's spend first reached 80 % and 100 % of the cap, once each."""
    run = Window.partitionBy("day").orderBy("created_at", "id")
    c = calls(spark, d).withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    c = c.withColumn("so_far", F.sum("cost_usd").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    level = F.explode(F.array(F.struct(F.lit("threshold").alias("level"), F.lit(0.08).alias("least")), F.struct(F.lit("cap_reached").alias("level"), F.lit(0.1).alias("least"))))
    hit = c.withColumn("l", level).where(F.col("so_far") >= F.col("l.least"))
    return hit.groupBy("day", F.col("l.level").alias("level")).agg(F.min_by("id", F.struct("created_at", "id")).alias("call_id"))


def st06_stale_jobs(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit("2026-07-01").cast("timestamp")
    return limits.timed_out(scans(spark, d), F.col("status") == "running", "started_at", 1800, now).select("id")


def jn29_reusable_scans(spark: SparkSession, d: str) -> DataFrame:
    """The newest completed scan of the same commit and version within the cache's life."""
    done = scans(spark, d).where("status = 'completed' and commit_sha is not null")
    now = F.lit("2026-07-01").cast("timestamp")
    return limits.newest_within(done, ["repo_owner", "repo_name", "commit_sha", "analysis_version"], "created_at", 200 * 86400, now, "id")


def arr08_one_owner(spark: SparkSession, d: str) -> DataFrame:
    """Calls that don't belong to exactly one of scan and site."""
    n = F.col("scan_id").isNotNull().cast("int") + F.col("site_analysis_id").isNotNull().cast("int")
    return calls(spark, d).where(n != 1).select("id")


def dt03_next_months(spark: SparkSession, d: str) -> DataFrame:
    m = F.date_trunc("month", "created_at")
    return scans(spark, d).select("id", F.date_format(m, "yyyy-MM-dd").alias("month"), F.date_format(F.add_months(m.cast("date"), 1), "yyyy-MM-dd").alias("next_month"))


def src07_languages(spark: SparkSession, d: str) -> DataFrame:
    """Languages over all scans: files, scans, and at most 20 manifests in order."""
    x = scans(spark, d).select("id", F.explode("detected_languages").alias("l"))
    n = x.groupBy("l.language").agg(F.sum("l.file_count").alias("files"), F.count(F.lit(1)).alias("scans"))
    m = x.select("l.language", F.explode("l.manifests").alias("m")).distinct()
    order = Window.partitionBy("language").orderBy("m")
    m = m.withColumn("k", F.row_number().over(order)).where("k <= 20").groupBy("language").agg(F.array_join(F.array_sort(F.collect_list("m")), ",").alias("manifests"))
    return n.join(m, "language", "left")


# -- graphs


def _shared(spark: SparkSession, d: str) -> DataFrame:
    x = fixes(spark, d).where("finding_id is not null")
    return x.select("scan_id", F.col("finding_id").alias("src"), F.explode("shared_with_finding_ids").alias("dst")).where("dst is not null")


def gr03_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_shared(spark, d))


def gr14_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_shared(spark, d))


def gr05_strong_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(_shared(spark, d), "scan_id", "bigint")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).select("scan_id", fn.plain_path(F.col("file_path")).alias("path"), "id", "severity")


def gr16_view_depth(spark: SparkSession, d: str) -> DataFrame:
    return graph.depth_for(_paths(spark, d), ["scan_id"], "path", 10)


def agg16_directory_view(spark: SparkSession, d: str) -> DataFrame:
    x = graph.prefixes(_paths(spark, d), ["scan_id"], "path").where("depth <= 3")
    return x.groupBy("scan_id", "directory").agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_distinct("path").alias("files"),
        F.bool_or(fn.severity_rank(F.col("severity")) >= 3).alias("has_error"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        agg04_spend_by_day,
        agg04_spend_by_purpose,
        jn02_spend_by_owner,
        agg05_spend_last_day,
        agg06_usage_by_purpose,
        agg07_tokens_per_scan,
        jn05_tokens_by_user_month,
        agg53_scans_by_status,
        agg17_duration_percentiles,
        agg22_gini_of_findings,
        win07_bus_factor,
        agg37_spearman,
        win10_mean_ranks,
        agg45_cliffs_delta,
        agg40_confusion,
        agg41_auc,
        agg51_validation_rates,
        prj28_failure_reasons,
        st01_sliding_limit,
        st01_trailing_counts,
        st03_quota_days,
        st05_first_alerts,
        st06_stale_jobs,
        jn29_reusable_scans,
        arr08_one_owner,
        dt03_next_months,
        src07_languages,
        gr03_degrees,
        gr14_components,
        gr05_strong_components,
        gr16_view_depth,
        agg16_directory_view,
    )
}

_C = "(SELECT DISTINCT ON (id) * FROM llm_calls)"
_X = "(SELECT DISTINCT ON (id) * FROM fix_suggestions)"
_SPEND = "count(*) AS calls, count(*) FILTER (NOT success) AS failed, round(sum(cost_usd)::DOUBLE, 6) AS cost_usd"
_TOK = "CASE WHEN pending THEN reserved_tokens ELSE input_tokens + output_tokens + cache_read_input_tokens END"
_DAY = "strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d')"
_MONTH = "strftime(created_at AT TIME ZONE 'UTC', '%Y-%m')"
_EDGES = f"""e AS (SELECT DISTINCT finding_id AS src, dst FROM (SELECT finding_id, unnest(shared_with_finding_ids) AS dst FROM {_X} WHERE finding_id IS NOT NULL) WHERE dst IS NOT NULL)"""
_SCORED = f"""s AS (SELECT CAST(least(100, floor(score_impact * 10)) AS INTEGER) AS score, validation_status = 'valid' AS y FROM {_X} x JOIN {_F} f ON f.id = x.finding_id WHERE score_impact IS NOT NULL),
t AS (SELECT CAST(range AS INTEGER) AS threshold FROM range(102)),
c AS (SELECT threshold, CAST(sum(CASE WHEN score >= threshold AND y THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN score >= threshold AND NOT y THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN score < threshold AND y THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN score < threshold AND NOT y THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM t, s GROUP BY threshold)"""
_RANKS = "SELECT {0}, count(*) AS n, sum(count(*)) OVER (ORDER BY {0}) - count(*) + (count(*) + 1) / 2 AS rank FROM lineitem GROUP BY {0}"
_P = f"(SELECT scan_id, {_PATH.format('file_path')} AS path, id, severity FROM {_F})"
_PRE = f"""(SELECT scan_id, path, id, severity, depth, array_to_string(list_slice(p, 1, depth), '/') AS directory
  FROM (SELECT *, string_split(path, '/') AS p, unnest(range(0, len(string_split(path, '/')))) AS depth FROM {_P}))"""

ORACLE = {
    "gr05_strong_components": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT scan_id, finding_id AS src, dst FROM (SELECT scan_id, finding_id, unnest(shared_with_finding_ids) AS dst FROM {_X} WHERE finding_id IS NOT NULL) WHERE dst IS NOT NULL),
      n AS MATERIALIZED (SELECT DISTINCT scan_id, unnest([src, dst]) AS node FROM e), r AS (SELECT scan_id, node, node AS far FROM n UNION SELECT r.scan_id, r.node, e.dst FROM r JOIN e ON e.scan_id IS NOT DISTINCT FROM r.scan_id AND e.src = r.far),
      m AS (SELECT a.scan_id, a.node, min(a.far) AS component, CAST(count(*) AS INT) AS size FROM r a JOIN r b ON a.scan_id IS NOT DISTINCT FROM b.scan_id AND a.node = b.far AND a.far = b.node GROUP BY 1, 2) SELECT * FROM m""",
    "agg04_spend_by_day": f"SELECT {_DAY} AS day, {_SPEND} FROM {_C} GROUP BY 1",
    "agg04_spend_by_purpose": f"SELECT purpose, {_SPEND} FROM {_C} GROUP BY 1",
    "jn02_spend_by_owner": f"""SELECT coalesce(user_id, '(anonymous)') AS owner, {_SPEND} FROM {_C} c LEFT JOIN {_S} s ON s.id = c.scan_id GROUP BY 1
      ORDER BY cost_usd DESC, owner LIMIT 50""",
    "agg05_spend_last_day": f"SELECT round(coalesce(sum(cost_usd), 0)::DOUBLE, 6) AS cost_usd FROM {_C} WHERE {_DAY} >= (SELECT max({_DAY}) FROM llm_calls)",
    "agg06_usage_by_purpose": f"""SELECT scan_id, purpose, count(*) AS calls, count(*) FILTER (success) AS successful, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
      CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(duration_ms) AS BIGINT) AS duration_ms, max(model) AS model FROM {_C} WHERE scan_id IS NOT NULL GROUP BY 1, 2""",
    "agg07_tokens_per_scan": f"SELECT scan_id, CAST(sum({_TOK}) AS BIGINT) AS tokens FROM {_C} WHERE scan_id IS NOT NULL GROUP BY 1",
    "jn05_tokens_by_user_month": f"""SELECT user_id, strftime(c.created_at AT TIME ZONE 'UTC', '%Y-%m') AS month, CAST(sum({_TOK}) AS BIGINT) AS tokens FROM {_C} c JOIN {_S} s ON s.id = c.scan_id
      WHERE user_id IS NOT NULL GROUP BY 1, 2""",
    "agg53_scans_by_status": f"""SELECT e.status, count(s.id) AS n FROM (SELECT unnest(['queued', 'cloning', 'running', 'completed', 'partial', 'failed', 'cancelled']) AS status) e
      LEFT JOIN {_S} s ON s.status = e.status GROUP BY 1""",
    "agg17_duration_percentiles": f"SELECT purpose, round(quantile_cont(duration_ms, 0.5), 2) AS p50, round(quantile_cont(duration_ms, 0.95), 2) AS p95 FROM {_C} GROUP BY 1",
    "agg22_gini_of_findings": f"""SELECT scan_id, round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini
      FROM (SELECT scan_id, n, row_number() OVER (PARTITION BY scan_id ORDER BY n) AS i FROM (SELECT scan_id, file_path, count(*) AS n FROM {_F} GROUP BY ALL)) GROUP BY scan_id""",
    "win07_bus_factor": f"""WITH n AS (SELECT repo_owner, repo_name, user_id, sum(coalesce(source_loc, 0)) AS loc FROM {_S} WHERE repo_name IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL),
      k AS (SELECT *, row_number() OVER w AS k, sum(loc) OVER (w ROWS UNBOUNDED PRECEDING) AS run, sum(loc) OVER (PARTITION BY repo_owner, repo_name) AS every
        FROM n WINDOW w AS (PARTITION BY repo_owner, repo_name ORDER BY loc DESC, user_id))
      SELECT repo_owner, repo_name, min(k) AS bus_factor FROM k WHERE run * 2 >= every AND every > 0 GROUP BY ALL""",
    "agg37_spearman": f"""WITH a AS ({_RANKS.format('l_quantity')}), b AS ({_RANKS.format('l_extendedprice')})
      SELECT round(corr(a.rank, b.rank), 6) AS rho, count(*) AS n FROM lineitem JOIN a USING (l_quantity) JOIN b USING (l_extendedprice)""",
    "win10_mean_ranks": f"SELECT l_quantity, n, CAST(rank AS DOUBLE) AS rank FROM ({_RANKS.format('l_quantity')})",
    "agg45_cliffs_delta": f"""WITH r AS ({_RANKS.format('l_extendedprice')}), x AS (SELECT l_returnflag = 'R' AS b, rank FROM lineitem JOIN r USING (l_extendedprice))
      SELECT round(2 * (sum(rank) FILTER (b) - count(*) FILTER (b) * (count(*) FILTER (b) + 1) / 2) / ((count(*) FILTER (b))::DOUBLE * count(*) FILTER (NOT b)) - 1, 6) AS delta FROM x""",
    "agg40_confusion": f"""WITH {_SCORED} SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall,
      round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 6) AS fpr, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c""",
    "agg41_auc": f"""WITH {_SCORED}, p AS (SELECT threshold, fp / (fp + tn) AS fpr, tp / (tp + fn) AS recall FROM c UNION ALL SELECT 1000000000, 0, 0 UNION ALL SELECT -1000000000, 1, 1)
      SELECT round(sum(a), 6) AS auc FROM (SELECT (fpr - lag(fpr) OVER w) * (recall + lag(recall) OVER w) / 2 AS a FROM p WINDOW w AS (ORDER BY threshold DESC))""",
    "agg51_validation_rates": f"""SELECT analyzer, count(*) AS n, round(avg(CASE WHEN validation_status = 'valid' THEN 1 ELSE 0 END), 6) AS valid_share FROM {_X} x JOIN {_F} f ON f.id = x.finding_id GROUP BY 1""",
    "prj28_failure_reasons": f"""SELECT CASE WHEN contains(t, 'Not a unified diff') THEN 'not a unified diff' WHEN contains(t, 'patch does not apply') OR contains(t, 'patch failed') THEN 'context does not match the file' WHEN contains(t, 'corrupt patch') THEN 'corrupt patch'
      WHEN regexp_matches(t, '(?i)does not exist|outside the repository|new file|deleted file|absolute') THEN 'touches a file it may not' ELSE 'other: ' || substr(t, 1, 80) END AS reason, count(*) AS n FROM (SELECT coalesce(validation_detail, '') AS t FROM {_X}) GROUP BY 1""",
    "st01_sliding_limit": """WITH RECURSIVE z AS MATERIALIZED (SELECT user_id, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
      r AS (SELECT user_id, event_id, k, [ms] AS live, true AS allowed FROM z WHERE k = 1
        UNION ALL SELECT z.user_id, z.event_id, z.k, CASE WHEN len(f) < 3 THEN list_append(f, ms) ELSE f END, len(f) < 3 FROM r JOIN z ON z.user_id = r.user_id AND z.k = r.k + 1, LATERAL (SELECT list_filter(live, lambda t: t > ms - 3600000) AS f))
      SELECT user_id, event_id, allowed, CAST(len(live) AS INT) AS used FROM r""",
    "st01_trailing_counts": """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) AS trailing FROM events""",
    "st03_quota_days": f"""SELECT day, tokens, CAST(sum(tokens) OVER (PARTITION BY substr(day, 1, 7) ORDER BY day) AS BIGINT) AS month_so_far
      FROM (SELECT {_DAY} AS day, CAST(sum({_TOK}) AS BIGINT) AS tokens FROM {_C} GROUP BY 1)""",
    "st05_first_alerts": f"""WITH c AS (SELECT id, created_at, {_DAY} AS day, sum(cost_usd) OVER (PARTITION BY {_DAY} ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS so_far FROM {_C})
      SELECT day, level, arg_min(id, (created_at, id)) AS call_id FROM c, (VALUES ('threshold', 0.08), ('cap_reached', 0.1)) l(level, least) WHERE so_far >= least GROUP BY 1, 2""",
    "st06_stale_jobs": f"SELECT id FROM {_S} WHERE status = 'running' AND epoch(TIMESTAMPTZ '2026-07-01 00:00:00+00') - epoch(started_at) > 1800",
    "jn29_reusable_scans": f"""SELECT repo_owner, repo_name, commit_sha, analysis_version, arg_max(id, (created_at, id)) AS id FROM {_S} WHERE status = 'completed' AND commit_sha IS NOT NULL
      AND epoch(TIMESTAMPTZ '2026-07-01 00:00:00+00') - epoch(created_at) <= 200 * 86400 GROUP BY ALL""",
    "arr08_one_owner": f"SELECT id FROM {_C} WHERE (scan_id IS NOT NULL)::INT + (site_analysis_id IS NOT NULL)::INT <> 1",
    "dt03_next_months": f"""SELECT id, strftime(date_trunc('month', created_at AT TIME ZONE 'UTC'), '%Y-%m-%d') AS month,
      strftime(date_trunc('month', created_at AT TIME ZONE 'UTC') + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month FROM {_S}""",
    "src07_languages": f"""WITH x AS (SELECT unnest(detected_languages) AS l FROM {_S}),
      m AS (SELECT language, m FROM (SELECT DISTINCT l.language AS language, unnest(l.manifests) AS m FROM x) QUALIFY row_number() OVER (PARTITION BY language ORDER BY m) <= 20)
      SELECT n.*, manifests FROM (SELECT l.language AS language, CAST(sum(l.file_count) AS BIGINT) AS files, count(*) AS scans FROM x GROUP BY 1) n
      LEFT JOIN (SELECT language, string_agg(m, ',' ORDER BY m) AS manifests FROM m GROUP BY 1) USING (language)""",
    "gr03_degrees": f"""WITH {_EDGES}, n AS (SELECT src AS node, 0 AS i, 1 AS o FROM e WHERE src <> dst UNION ALL SELECT dst, 1, 0 FROM e WHERE src <> dst)
      SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out, round(sum(o) / (sum(i) + sum(o)), 4) AS instability FROM n GROUP BY 1""",
    "gr14_components": f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
      r AS (SELECT src AS node, src AS root FROM b UNION SELECT b.dst, r.root FROM r JOIN b ON b.src = r.node) SELECT node, min(root) AS component FROM r GROUP BY 1""",
    "gr16_view_depth": f"""SELECT scan_id, max(CASE WHEN n <= 10 THEN depth END) AS depth FROM (SELECT scan_id, depth, count(DISTINCT directory) AS n FROM {_PRE} WHERE depth > 0 GROUP BY ALL) GROUP BY 1""",
    "agg16_directory_view": f"""SELECT scan_id, directory, count(*) AS findings, count(DISTINCT path) AS files, bool_or({_RANK.format('severity')} >= 3) AS has_error FROM {_PRE} WHERE depth <= 3 GROUP BY 1, 2""",
}
