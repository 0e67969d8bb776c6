"""Advisory scans, domain registrations and page captures from JSON text. JVM only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.functions import findings as fn

PACKAGE = "struct<name: string, ecosystem: string, version: string>"
RANGE = "struct<type: string, events: array<struct<introduced: string, fixed: string>>>"
VULNERABILITY = (
    "struct<id: string, summary: string, details: string, database_specific: struct<severity: string>, "
    f"affected: array<struct<package: struct<name: string, ecosystem: string>, ranges: array<{RANGE}>>>>"
)
GROUP = "struct<ids: array<string>, aliases: array<string>, max_severity: string>"
SCAN = (
    "struct<results: array<struct<source: struct<path: string>, packages: array<struct<"
    f"package: {PACKAGE}, vulnerabilities: array<{VULNERABILITY}>, groups: array<{GROUP}>>>>>>"
)


def advisory_id(group: Column) -> Column:
    """A CVE of the aliases, else a GHSA of any, else the first id."""

    def least(names: Column, prefix: str) -> Column:
        return F.array_min(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x.startswith(prefix)))

    none = F.array().cast("array<string>")
    any_ = F.concat(F.coalesce(group["ids"], none), F.coalesce(group["aliases"], none))
    return F.coalesce(least(group["aliases"], "CVE-"), least(any_, "GHSA-"), F.get(group["ids"], F.lit(0)), F.lit("unknown-advisory"))


def vulnerable_packages(scans: DataFrame) -> DataFrame:
    """(scan_id, path, ecosystem, name, version, advisory, severity, fixed, fixes) from (scan_id, payload).

    A range counts if it holds the installed version; upgrading to `fixed` ends every advisory of
    the group: the highest of their lowest fixes, null if one has none. Groups without a known
    advisory, other ecosystems' ranges and commit ranges are left out."""
    p = scans.select("scan_id", F.from_json("payload", SCAN).alias("p"))
    p = p.select("scan_id", F.explode("p.results").alias("r")).select("scan_id", fn.plain_path(F.col("r.source.path")).alias("path"), F.explode("r.packages").alias("e"))
    g = p.select("scan_id", "path", F.col("e.package").alias("package"), F.col("e.vulnerabilities").alias("vs"), F.posexplode("e.groups").alias("gi", "g"))
    g = g.withColumn("advisory", advisory_id(F.col("g")))
    v = g.select("*", F.explode(F.filter("vs", lambda x: F.array_contains(F.col("g.ids"), x["id"]))).alias("v"))
    have = fn.version_key(F.col("package.version"))
    same = lambda a: (a["package"]["ecosystem"] == F.col("package.ecosystem")) & (F.regexp_replace(F.lower(a["package"]["name"]), "[-_.]+", "-") == F.regexp_replace(F.lower(F.col("package.name")), "[-_.]+", "-"))
    ranges = F.filter(F.flatten(F.transform(F.filter("v.affected", same), lambda a: F.coalesce(a["ranges"], F.array().cast(f"array<{RANGE}>")))), lambda r: r["type"] != "GIT")

    def fixes_of(r: Column) -> Column:
        steps = F.aggregate(
            r["events"],
            F.struct(F.lit(None).cast("string").alias("since"), F.array().cast("array<string>").alias("fixes")),
            lambda s, e: F.when(e["introduced"].isNotNull(), F.struct(e["introduced"].alias("since"), s["fixes"].alias("fixes")))
            .when(
                e["fixed"].isNotNull() & s["since"].isNotNull(),
                F.struct(
                    F.lit(None).cast("string").alias("since"),
                    F.when(
                        ((s["since"] == "0") | (fn.version_key(s["since"]) <= have)) & (have < fn.version_key(e["fixed"])),
                        F.array_append(s["fixes"], e["fixed"]),
                    )
                    .otherwise(s["fixes"])
                    .alias("fixes"),
                ),
            )
            .otherwise(s),
        )
        return steps["fixes"]

    keyed = F.array_sort(F.transform(F.array_distinct(F.flatten(F.transform(ranges, fixes_of))), lambda x: F.struct(fn.version_key(x).alias("k"), x.alias("v"))))
    v = v.withColumn("fixes", keyed)
    out = v.groupBy("scan_id", "path", "package", "gi", "advisory", F.col("g.max_severity").alias("score")).agg(
        F.when(F.min(F.size("fixes")) > 0, F.max(F.get("fixes", F.lit(0)))["v"]).alias("fixed"),
        F.transform(F.array_sort(F.array_distinct(F.flatten(F.collect_list("fixes")))), lambda x: x["v"]).alias("fixes"),
        F.collect_list("v.database_specific.severity").alias("labels"),
    )
    return out.select(
        "scan_id", "path", "package.ecosystem", "package.name", "package.version", "advisory",
        fn.advisory_severity(F.col("score"), F.col("labels")).alias("severity"), "fixed", "fixes",
    )


def time_of(text: Column) -> Column:
    """ISO times, with a zone or as UTC; null for others."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.replace(text, F.lit("Z"), F.lit("+00:00"))))


def registrations(rows: DataFrame) -> DataFrame:
    """(domain, registered_at, expires_at, registrar) from (domain, payload)."""
    shape = "struct<events: array<struct<eventAction: string, eventDate: string>>, entities: array<struct<roles: array<string>, vcardArray: string, publicIds: array<struct<value: string>>>>>"
    r = rows.select("domain", F.from_json("payload", shape).alias("p"))

    def at(action: str) -> Column:
        return time_of(F.try_element_at(F.filter("p.events", lambda e: F.lower(e["eventAction"]) == action), F.lit(-1))["eventDate"])

    registrar = F.get(F.filter("p.entities", lambda e: F.array_contains(e["roles"], "registrar")), F.lit(0))
    name = F.regexp_extract(registrar["vcardArray"], r'\["fn",\s*\{[^}]*\},\s*"[^"]*",\s*"([^"]*)"\]', 1)
    return r.select(
        "domain",
        F.when(F.size("p.events") > 0, at("registration")).alias("registered_at"),
        F.when(F.size("p.events") > 0, at("expiration")).alias("expires_at"),
        F.coalesce(F.nullif(name, F.lit("")), F.get(registrar["publicIds"]["value"], F.lit(0))).alias("registrar"),
    )


def feed(texts: DataFrame, least: int = 20) -> DataFrame:
    """(url) of a feed's lines; a feed of fewer than `least` is an error, not a clean bill."""
    urls = texts.select(F.lower(F.trim("value")).alias("url")).where("url rlike '^https?://'").distinct()
    if urls.limit(least).count() < least:
        raise ValueError("the feed has too few entries")
    return urls


CAPTURE = (
    "struct<requested_url: string, final_url: string, title: string, redirects: array<string>, links: array<string>, "
    "forms: array<struct<action: string, inputs: array<struct<type: string, name: string>>>>>"
)


def captures(rows: DataFrame, most_forms: int = 100) -> DataFrame:
    """(page, url, title, redirects, links, forms, asks_password) of captured pages (page, payload); what isn't of
    the shape has nulls and no forms."""
    p = F.from_json("payload", CAPTURE)
    c = rows.select("page", p.alias("p"))
    none = F.array().cast("array<string>")
    forms = F.slice(F.coalesce("p.forms", F.from_json(F.lit("[]"), "array<struct<action: string, inputs: array<struct<type: string, name: string>>>>")), 1, most_forms)
    secret = F.exists(forms, lambda f: F.exists(F.coalesce(f["inputs"], F.from_json(F.lit("[]"), "array<struct<type: string, name: string>>")), lambda i: F.coalesce(F.lower(i["type"]) == "password", F.lit(False))))
    return c.select("page", F.coalesce("p.final_url", "p.requested_url").alias("url"), F.trim("p.title").alias("title"), F.coalesce("p.redirects", none).alias("redirects"), F.coalesce("p.links", none).alias("links"), F.size(forms).alias("forms"), secret.alias("asks_password"))


def reference_hashes(texts: DataFrame) -> DataFrame:
    """(reference, place, hash) of reference lists (value): JSON arrays of {name, hashes}, in their order."""
    r = texts.select(F.posexplode(F.from_json("value", "array<struct<name: string, hashes: array<string>>>")).alias("place", "r"))
    return r.select(F.col("r.name").alias("reference"), "place", F.explode("r.hashes").alias("hash"))


def snapshot_findings(lines: DataFrame) -> DataFrame:
    """(scan_id, id, analyzer, rule_id, severity, path, corroborated) of snapshots, a scan a line (value), whose findings
    are arrays by position. Broken lines have none."""
    s = lines.select(F.from_json("value", "struct<scan_id: string, findings: array<array<string>>>").alias("s"))
    each = s.select("s.scan_id", F.explode("s.findings").alias("f"))
    names = ("id", "analyzer", "rule_id", "severity", "path", "corroborated")
    out = each.select("scan_id", *[F.get("f", F.lit(k)).alias(n) for k, n in enumerate(names)])
    return out.withColumn("id", F.col("id").try_cast("bigint")).where("id is not null")
