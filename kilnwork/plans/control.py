"""Analyzers, ledgers, limits, captures and snapshots over the test tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnwork.functions import web
from kilnwork.operators import analyzers, limits, scoring
from kilnwork.plans.findings import _F, _S, findings, scans
from kilnwork.plans.usage import _C, calls
from kilnwork.runtime import shared_dir, table
from kilnwork.sources import advisories
from kilnwork.streaming import events as stream


def _broken(df: DataFrame) -> DataFrame:
    return df.select(F.raise_error(F.lit("no such format")).cast("string").alias("x"))


def _registry() -> analyzers.Registry:
    one = lambda key: lambda df: df.dropDuplicates([key])
    return analyzers.Registry(
        [
            analyzers.Analyzer("summary", one("id"), (), 2),
            analyzers.Analyzer("semgrep", one("result_id"), ("python", "javascript")),
            analyzers.Analyzer("bandit", one("result_id"), ("python",)),
            analyzers.Analyzer("broken", _broken),
            analyzers.Analyzer("absent", one("x"), ("go",), experimental=True),
        ]
    )


def ext01_statuses(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of five analyzers, one of which fails and one of which has no results."""
    raw = {"semgrep": table(spark, d, "semgrep_output"), "bandit": table(spark, d, "bandit_output"), "broken": table(spark, d, "scans"), "summary": table(spark, d, "findings")}
    _, statuses = _registry().run(raw)
    return spark.createDataFrame([(a, s, n) for a, s, n, _ in statuses], "analyzer string, status string, n bigint")


def ext02_selected(spark: SparkSession, d: str) -> DataFrame:
    s = scans(spark, d).select(F.col("id").alias("scan_id"), F.transform("detected_languages", lambda x: x["language"]).alias("languages"))
    return _registry().selected(s)


def ext05_apart(spark: SparkSession, d: str) -> DataFrame:
    """Lines per scan, by work that fails where a line is missing."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["start_line"].isna().any():
            raise ValueError("a line is missing")
        return pd.DataFrame({"n": [len(pdf)]})

    rows = findings(spark, d).select("scan_id", F.when(F.col("category").isNotNull(), F.col("start_line")).alias("start_line"))
    return analyzers.apart(rows, "scan_id", work, "n bigint")


def st04_ledger(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d).withColumns({"day": F.date_format("created_at", "yyyy-MM-dd"), "everything": F.lit("all"), "tokens": F.col("input_tokens") + F.col("output_tokens")})
    checks = (limits.Check("budget", "scan_id", "tokens", 8000), limits.Check("quota", "purpose", "tokens", 20000), limits.Check("cap", "everything", "cost_usd", 0.05))
    return limits.granted(c, "day", "created_at", "id", checks)


def st02_costs(spark: SparkSession, d: str) -> DataFrame:
    """A sliding limit on events that cost 0 to 2: 0 only asks."""
    e = table(spark, d, "events")
    cost = F.pmod("event_id", F.lit(3)).cast("int")
    return limits.admitted(e, "user_id", F.unix_millis(F.col("ts").cast("timestamp")), "event_id", 86_400_000, 4, cost)


def st09_claimed(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream in which each comes twice: every one is taken once."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = stream.read(spark, d, 1000, "events*.parquet").select("event_id", "at")
    twice = events.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), "event_id", "at").drop("n")
    return stream.written_out(stream.first_of(twice, ["event_id"], "3650 days").select("event_id"), f"{folder}/out", f"{folder}/state")


def dt06_resets(spark: SparkSession, d: str) -> DataFrame:
    s = scans(spark, d)
    seconds = F.length(F.coalesce("repo_name", F.lit(""))) * 61 * F.when(F.col("source") == "github", 5).otherwise(700)
    return s.select("id", limits.reset_text(seconds, F.col("created_at")).alias("reset"))


def jn27_limits(spark: SparkSession, d: str) -> DataFrame:
    u = scans(spark, d).where("user_id is not null").groupBy("user_id").agg(F.max("source_loc").alias("scans"), F.min(F.lit(None).cast("int")).alias("tokens"), F.max("source").alias("tier"))
    tiers = spark.createDataFrame([("free", "scans", 5), ("free", "tokens", 100), ("github", "scans", 50), ("github", "tokens", 1000)], "tier string, name string, limit bigint")
    return limits.limits_of(u, tiers, ["scans", "tokens"])


def arr10_category_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Shares of analyzers in a repository's scans against those in the scan before."""
    s = scans(spark, d).where("repo_name is not null")
    order = Window.partitionBy("repo_owner", "repo_name").orderBy("created_at", "id")
    s = s.select("id", F.lag("id").over(order).alias("before")).where("before is not null")
    n = findings(spark, d).where("scan_id is not null").groupBy("scan_id", "analyzer").agg(F.count(F.lit(1)).cast("double").alias("n"))
    c = n.groupBy("scan_id").agg(F.collect_list(F.struct(F.col("analyzer").alias("name"), F.col("n").alias("score"))).alias("categories"))
    head = s.join(c, s["id"] == c["scan_id"]).select("id", "categories")
    base = s.join(c, s["before"] == c["scan_id"]).select("id", "categories")
    return scoring.category_deltas(base, head, "id")


def src30_captures(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("source") == "github", "Password").otherwise("text")
    form = F.struct(F.lit("/login").alias("action"), F.array(F.struct(kind.alias("type"), F.lit("p").alias("name"))).alias("inputs"))
    forms = F.transform(F.sequence(F.lit(1), F.length("id") * 4), lambda k: form)
    body = F.to_json(F.struct(F.concat(F.lit("http://"), "repo_name").alias("requested_url"), F.when(F.col("user_id").isNotNull(), F.concat(F.lit("https://"), "repo_name")).alias("final_url"), F.concat(F.lit(" "), F.col("id"), F.lit(" ")).alias("title"), F.array("id").alias("links"), forms.alias("forms")))
    payload = F.when(F.col("repo_name").isNull(), "{broken").otherwise(body)
    out = advisories.captures(scans(spark, d).select(F.col("id").alias("page"), payload.alias("payload")))
    return out.select("page", "url", "title", F.size("links").alias("links"), "forms", "asks_password")


def src35_references(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).where("scan_id is not null").groupBy("scan_id").agg(F.array_sort(F.collect_set(F.struct(F.col("analyzer").alias("name"), F.array("analyzer", "scan_id").alias("hashes")))).alias("r"))
    return advisories.reference_hashes(f.select(F.to_json("r").alias("value")))


def src38_snapshots(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).where("scan_id is not null")
    each = F.array(F.col("id").cast("string"), "analyzer", "rule_id", "severity", "file_path", F.size("corroborated_by").cast("string"))
    lines = f.groupBy("scan_id").agg(F.collect_list(each).alias("findings")).select(F.to_json(F.struct("scan_id", "findings")).alias("value"))
    out = advisories.snapshot_findings(lines.unionByName(lines.limit(1).select(F.lit("{").alias("value"))))
    return out.select("scan_id", "id", "analyzer", "severity")


def mth08_low_information(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.when(i < k % 72, F.lit(7)).otherwise((i * F.col("p_size")) % 256).cast("int"))
    return table(spark, d, "part").select("p_partkey", web.is_low_information(pixels).alias("low"))


def src36_gradient_hashes(spark: SparkSession, d: str) -> DataFrame:
    pixels = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: ((i * F.col("p_size") * 37) % 251).cast("int"))
    return table(spark, d, "part").select("p_partkey", web.gradient_hash(pixels).alias("hash"))


QUERIES = {
    f.__name__: f
    for f in (
        st09_claimed, ext01_statuses, ext02_selected, ext05_apart, st04_ledger, st02_costs, dt06_resets, jn27_limits, arr10_category_deltas, src30_captures,
        src35_references, src38_snapshots, mth08_low_information, src36_gradient_hashes,
    )
}

_PIX = "list_transform(range(72), lambda i: CASE WHEN i < p_partkey % 72 THEN 7 ELSE (i * p_size) % 256 END)"

ORACLE = {
    "st09_claimed": "SELECT DISTINCT event_id FROM events WHERE ts IS NOT NULL",
    "ext01_statuses": """SELECT 'semgrep' AS analyzer, 'completed' AS status, count(DISTINCT result_id) AS n FROM semgrep_output UNION ALL SELECT 'bandit', 'completed', count(DISTINCT result_id) FROM bandit_output
      UNION ALL SELECT 'summary', 'completed', count(DISTINCT id) FROM findings UNION ALL SELECT 'broken', 'failed', 0 UNION ALL SELECT 'absent', 'skipped', 0""",
    "ext02_selected": f"""SELECT id AS scan_id, a AS analyzer, CAST(p AS INT) AS phase, len(l) = 0 OR list_has_any(l, coalesce(list_transform(detected_languages, lambda x: x.language), [])) AS applies
      FROM {_S}, (VALUES ('summary', 2, []::VARCHAR[]), ('semgrep', 1, ['python', 'javascript']), ('bandit', 1, ['python']), ('broken', 1, [])) t(a, p, l)""",
    "ext05_apart": f"SELECT scan_id, CASE WHEN bool_or(category IS NULL OR start_line IS NULL) THEN NULL ELSE count(*) END AS n, CASE WHEN bool_or(category IS NULL OR start_line IS NULL) THEN 'ValueError' END AS error FROM {_F} WHERE scan_id IS NOT NULL GROUP BY 1",
    "st04_ledger": f"""WITH RECURSIVE z AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY day ORDER BY created_at, id) AS k FROM (SELECT id, created_at, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, coalesce(scan_id, '') AS s, coalesce(purpose, '') AS p, coalesce(input_tokens + output_tokens, 0)::DOUBLE AS t, coalesce(cost_usd, 0)::DOUBLE AS c FROM {_C} WHERE created_at IS NOT NULL)),
      r AS (SELECT day, id, k, CASE WHEN t > 8000 THEN 'budget' WHEN t > 20000 THEN 'quota' WHEN c > 0.05 + 1e-9 THEN 'cap' END AS no, CASE WHEN t > 8000 OR c > 0.05 + 1e-9 THEN [] ELSE [{{'s': s, 'p': p, 't': t, 'c': c}}] END AS held FROM z WHERE k = 1
        UNION ALL SELECT z.day, z.id, z.k, n, CASE WHEN n IS NULL THEN list_append(held, {{'s': z.s, 'p': z.p, 't': z.t, 'c': z.c}}) ELSE held END FROM r JOIN z ON z.day = r.day AND z.k = r.k + 1,
        LATERAL (SELECT CASE WHEN coalesce(list_sum(list_transform(list_filter(held, lambda h: h.s = z.s), lambda h: h.t)), 0) + z.t > 8000 THEN 'budget' WHEN coalesce(list_sum(list_transform(list_filter(held, lambda h: h.p = z.p), lambda h: h.t)), 0) + z.t > 20000 THEN 'quota' WHEN coalesce(list_sum(list_transform(held, lambda h: h.c)), 0) + z.c > 0.05 + 1e-9 THEN 'cap' END AS n))
      SELECT day, id, no IS NULL AS granted, no AS refused_by FROM r""",
    "st02_costs": """WITH RECURSIVE z AS MATERIALIZED (SELECT user_id, event_id, epoch_ms(ts) AS ms, CAST(event_id % 3 AS INT) AS c, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
      r AS (SELECT user_id, event_id, k, CASE WHEN c > 0 THEN [{'m': ms, 'c': c}] ELSE [] END AS live, true AS allowed FROM z WHERE k = 1
        UNION ALL SELECT z.user_id, z.event_id, z.k, CASE WHEN c > 0 AND u + c <= 4 THEN list_append(f, {'m': ms, 'c': c}) ELSE f END, CASE WHEN c = 0 THEN u < 4 ELSE u + c <= 4 END FROM r JOIN z ON z.user_id = r.user_id AND z.k = r.k + 1,
        LATERAL (SELECT list_filter(live, lambda t: t.m > ms - 86400000) AS f), LATERAL (SELECT coalesce(list_sum(list_transform(f, lambda t: t.c)), 0) AS u))
      SELECT user_id, event_id, allowed, CAST(coalesce(list_sum(list_transform(live, lambda t: t.c)), 0) AS INT) AS used FROM r""",
    "dt06_resets": f"""SELECT id, CASE WHEN s < 90 THEN 'in ' || s || ' seconds' WHEN s < 5400 THEN 'in ' || CAST(round_even(s / 60, 0) AS INT) || ' minutes (' || strftime(t, '%H:%M') || ' UTC)' ELSE 'at ' || strftime(t, '%Y-%m-%d %H:%M') || ' UTC' END AS reset
      FROM (SELECT *, (created_at AT TIME ZONE 'UTC') + to_seconds(s) AS t FROM (SELECT *, length(coalesce(repo_name, '')) * 61 * CASE WHEN source = 'github' THEN 5 ELSE 700 END AS s FROM {_S}))""",
    "jn27_limits": f"""WITH u AS (SELECT user_id, max(source_loc) AS scans, CASE WHEN max(source) = 'github' THEN 'github' ELSE 'free' END AS tier FROM {_S} WHERE user_id IS NOT NULL GROUP BY 1)
      SELECT user_id, 'scans' AS name, CAST(coalesce(scans, CASE tier WHEN 'github' THEN 50 ELSE 5 END) AS BIGINT) AS "limit" FROM u UNION ALL SELECT user_id, 'tokens', CASE tier WHEN 'github' THEN 1000 ELSE 100 END FROM u""",
    "arr10_category_deltas": f"""WITH s AS (SELECT id, lag(id) OVER (PARTITION BY repo_owner, repo_name ORDER BY created_at, id) AS b FROM {_S} WHERE repo_name IS NOT NULL), n AS (SELECT scan_id, analyzer AS name, count(*)::DOUBLE AS n FROM {_F} WHERE scan_id IS NOT NULL GROUP BY 1, 2),
      x AS (SELECT s.id, name, n AS after FROM s JOIN n ON n.scan_id = s.id WHERE b IS NOT NULL), y AS (SELECT s.id, name, n AS before FROM s JOIN n ON n.scan_id = s.b) SELECT id, name, before, after, after - before AS delta FROM y FULL JOIN x USING (id, name)""",
    "src30_captures": f"""SELECT id AS page, CASE WHEN user_id IS NOT NULL THEN 'https://' || repo_name ELSE 'http://' || repo_name END AS url, CASE WHEN repo_name IS NOT NULL THEN id END AS title, CAST((repo_name IS NOT NULL)::INT AS INT) AS links, CAST(CASE WHEN repo_name IS NULL THEN 0 ELSE least(100, length(id) * 4) END AS INT) AS forms, repo_name IS NOT NULL AND source = 'github' AS asks_password FROM {_S}""",
    "src35_references": f"""WITH a AS (SELECT scan_id, analyzer, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY analyzer) - 1 AS INT) AS place FROM (SELECT DISTINCT scan_id, analyzer FROM {_F} WHERE scan_id IS NOT NULL)) SELECT analyzer AS reference, place, unnest([analyzer, scan_id]) AS hash FROM a""",
    "src38_snapshots": f"SELECT scan_id, id, analyzer, severity FROM {_F} WHERE scan_id IS NOT NULL",
    "mth08_low_information": f"SELECT p_partkey, stddev_pop(v) < 12 OR max(c) / 72 > 0.92 AS low FROM (SELECT p_partkey, v, count(*) OVER (PARTITION BY p_partkey, v) AS c FROM (SELECT p_partkey, unnest({_PIX}) AS v FROM part)) GROUP BY 1",
    "src36_gradient_hashes": """SELECT p_partkey, array_to_string(list_transform(range(16), lambda k: ['0','1','2','3','4','5','6','7','8','9','a','b','c','d','e','f'][1 + list_sum(list_transform(range(4), lambda j: CASE WHEN (((k * 4 + j) // 8 * 9 + (k * 4 + j) % 8) * p_size * 37) % 251 < (((k * 4 + j) // 8 * 9 + (k * 4 + j) % 8 + 1) * p_size * 37) % 251 THEN (8 >> j::INT) ELSE 0 END))::INT]), '') AS hash FROM part""",
}
