"""Functions on texts, names, addresses, versions, colours and patches, over columns of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnwork.functions import answers, colors, versions, web
from kilnwork.functions import findings as fn
from kilnwork.functions import paths as fp
from kilnwork.operators import history, merging, sites
from kilnwork.plans import modules
from kilnwork.plans.derived import _rgb
from kilnwork.plans.findings import _F, _PATH, _S, findings, scans
from kilnwork.plans.usage import _X, fixes
from kilnwork.runtime import table
from kilnwork.sources import advisories, pipelines


def _names(spark: SparkSession, d: str) -> DataFrame:
    return scans(spark, d).where("repo_name is not null").select("repo_name").distinct()


def _imitated() -> Column:
    return F.translate("repo_name", "aeo", "аео")  # Cyrillic letters


def str02_skeletons(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("repo_name", web.skeleton(F.upper(_imitated())).alias("skeleton"))


def str03_plain_letters(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("repo_name", web.ascii_skeleton(F.concat("repo_name", F.lit("rn0vv13cl57"))).alias("plain"))


def str04_scripts(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("repo_name", F.array_join(web.scripts(_imitated()), "+").alias("scripts"))


def str05_words(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.concat_ws("-9_", F.col("p_partkey"), "p_name").alias("t"))
    return p.select("p_partkey", F.array_join(web.words_of(F.col("t")), "|").alias("words"))


def str06_mentions(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).where("message is not null")
    title = web.title_mentions(F.col("message"), "stale", "Stale", True)
    return f.select("id", web.mentions(F.col("message"), "PARSER").alias("mentions"), title.alias("in_title"))


def str08_normal_urls(spark: SparkSession, d: str) -> DataFrame:
    n = _names(spark, d).select("repo_name", F.concat(F.lit(" HTTPS://"), F.upper("repo_name"), F.lit(".Example.com:443/A?q=1#x")).alias("raw"))
    n = n.unionByName(_names(spark, d).select("repo_name", F.concat(F.lit("ftp://"), "repo_name").alias("raw"))).unionByName(_names(spark, d).select("repo_name", F.concat(F.lit("u:p@"), "repo_name").alias("raw")))
    return n.select("raw", web.normalized_url(F.col("raw")).alias("u")).select("raw", "u.*")


def str09_addresses(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    host = F.when(k % 3 == 0, F.concat_ws(".", k % 300, s, k % 7, s)).when(k % 3 == 1, F.concat_ws(".", s, k)).otherwise(k.cast("string"))
    return p.select("p_partkey", web.address_of(host).alias("address"))


def _hosts(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(F.length("repo_name") % 2 == 0, ".co.uk").otherwise(".com")
    return _names(spark, d).select("repo_name", F.concat(F.lit("a.B."), "repo_name", end).alias("host"))


def str10_registrable(spark: SparkSession, d: str) -> DataFrame:
    return _hosts(spark, d).select("host", web.registrable(F.col("host")).alias("registrable"))


def str11_brands(spark: SparkSession, d: str) -> DataFrame:
    brands = _names(spark, d).select(F.substring_index("repo_name", "-", 1).alias("brand"), F.concat("repo_name", F.lit(".com")).alias("domain"))
    brands = brands.select("brand", F.length("brand").alias("place"), "domain").distinct()
    return sites.brands_of(_hosts(spark, d).select(F.lower("host").alias("domain")), brands)


def str12_name_matches(spark: SparkSession, d: str) -> DataFrame:
    wild = F.concat(F.lit("*."), F.regexp_replace(F.lower("host"), r"^a\.", ""))
    return _hosts(spark, d).select("host", web.name_matches(F.col("host"), wild).alias("one"), web.name_matches(F.concat(F.lit("x."), "host"), wild).alias("two"))


def prj26_defanged(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://"), F.lower("host"), F.lit("/"), F.repeat(F.lit("long/"), 20))
    return _hosts(spark, d).select("host", web.defanged(url).alias("url"))


def str16_versions(spark: SparkSession, d: str) -> DataFrame:
    """A hash of what a scan was analysed with."""
    f = findings(spark, d).where("scan_id is not null").groupBy("scan_id").agg(F.array_sort(F.collect_set("analyzer")).alias("a"))
    return f.select("scan_id", F.substring(F.sha2(F.array_join("a", "|"), 256), 1, 32).alias("version"))


def str17_emails(spark: SparkSession, d: str) -> DataFrame:
    s = scans(spark, d).where("user_id is not null").select("id", F.concat(F.lit("A <b> <"), F.upper("user_id"), F.lit("@X.org> ")).alias("author"))
    return s.select("id", history.email(F.col("author")).alias("email"))


def prj16_predicates(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    author = F.when(F.col("analyzer") == "ruff", "Renovate[Bot]").otherwise(F.col("analyzer"))
    path = F.when(F.col("analyzer") == "bandit", F.concat(F.lit("web/dist/"), "file_path")).when(F.col("analyzer") == "dependency", F.lit("a/Yarn.lock")).otherwise(F.col("file_path"))
    return f.select("id", history.is_bot(author).alias("bot"), history.is_excluded(path).alias("excluded"), history.is_low_info(F.col("message")).alias("low_info"))


def prj17_step_kinds(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.create_map(*map(F.lit, ("semgrep", "semgrep scan ", "bandit", "pytest -q && ruff check ", "ruff", "pip install ruff ", "dependency", "docker build -t x ", "architecture", "echo pytest ")))[F.col("analyzer")], F.coalesce("file_path", F.lit("")))
    return findings(spark, d).select("id", F.array_join(F.array_sort(pipelines.kinds_of(text)), "+").alias("kinds"))


def prj04_advisory_severity(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    score = F.when(F.col("p_size") % 4 > 0, (F.col("p_size") / 5).cast("string")).otherwise("none")
    labels = F.when(F.col("p_size") % 8 == 0, F.array(F.lit("LOW"), F.lit("high"))).otherwise(F.array().cast("array<string>"))
    return p.select("p_partkey", fn.advisory_severity(score, labels).alias("severity"))


def arr11_without_nul(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).select("id", F.struct(F.concat("message", F.lit("\0x")).alias("m"), F.transform("merged_from", lambda x: F.struct(F.concat(x["rule_id"], F.lit("\0")).alias("r"))).alias("l")).alias("v"))
    f = f.withColumn("c", fn.without_nul_at_all(F.col("v"), f.schema["v"].dataType))
    return f.select("id", F.col("c.m").alias("message"), F.array_join(F.col("c.l.r"), ",").alias("rules"))


def str22_joined(spark: SparkSession, d: str) -> DataFrame:
    p = modules.nodes(spark, d).select("path").distinct()
    folder = F.array_join(fp.folders_of(F.col("path")), "/")
    return p.select("path", fp.joined(folder, F.concat(F.lit("./../"), fp.name_of(F.col("path")))).alias("joined"))


def str21_packages(spark: SparkSession, d: str) -> DataFrame:
    p = modules.nodes(spark, d).select("path").distinct()
    return p.select("path", fp.package_name(fp.clean_specifier(F.concat(F.lit("raw!@"), "path", F.lit("?x#y")))).alias("scoped"), fp.package_name(F.col("path")).alias("plain"))


def prj22_import_forms(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).where("file_path is not null")
    form = fp.import_form(F.col("analyzer"), F.col("file_path"), F.when(F.col("analyzer") == "ruff", 1).otherwise(0), F.col("analyzer") == "bandit")
    reason = fp.reason_kind(F.concat(F.lit("file '"), F.col("file_path"), F.lit("' not found")))
    return f.groupBy(form.alias("form"), reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def str23_references(spark: SparkSession, d: str) -> DataFrame:
    p = modules.nodes(spark, d).select("path").distinct()
    return p.select("path", answers.plain_reference(F.concat(F.lit(" `./"), "path", F.lit(":12` "))).alias("reference"))


def str24_answers(spark: SparkSession, d: str) -> DataFrame:
    body = F.regexp_replace(F.to_json(F.struct("id", "severity")), r"\}$", ",}")
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("It is "), body, F.lit(" I think")))
    v = answers.parsed_answer(text)
    return findings(spark, d).select("id", F.try_variant_get(v, "$.id", "bigint").alias("read_id"), F.try_variant_get(v, "$.severity", "string").alias("severity"))


def str25_patches(spark: SparkSession, d: str) -> DataFrame:
    x = fixes(spark, d).where("patch is not null")
    ranges = F.transform(answers.changed_ranges(F.col("patch")), lambda r: F.concat_ws("-", r["start"], r["end"]))
    return x.select("id", F.array_join(F.array_sort(answers.patch_paths(F.col("patch"))), ",").alias("paths"), F.array_join(ranges, ",").alias("ranges"))


def str25_normal_patches(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.concat(F.lit("```diff\n"), F.replace("patch", F.lit("\n"), F.lit("\r\n")), F.lit("\n\n```"))
    return fixes(spark, d).where("patch is not null").select("id", answers.plain_patch(wrapped).alias("patch"))


def _installed(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).where("dependency.installed_version is not null").select(F.col("dependency.package").alias("name"), F.col("dependency.installed_version").alias("version")).distinct()


def ver03_npm_order(spark: SparkSession, d: str) -> DataFrame:
    """How many versions of a package are below each, with a pre-release below every release."""
    v = _installed(spark, d)
    v = v.unionByName(v.select("name", F.concat("version", F.lit("-rc.2")).alias("version")))
    k = v.withColumn("k", versions.npm_key(F.col("version")))
    return k.join(k.select("name", F.col("k").alias("o")), "name").groupBy("name", "version").agg(F.count_if(F.col("o") < F.col("k")).alias("below"))


def ver02_pypi_order(spark: SparkSession, d: str) -> DataFrame:
    v = _installed(spark, d)
    v = v.unionByName(v.select("name", F.concat("version", F.lit(".post1")).alias("version")))
    k = v.withColumn("k", versions.pypi_key(F.col("version")))
    return k.join(k.select("name", F.col("k").alias("o")), "name").groupBy("name", "version").agg(F.count_if(F.col("o") < F.col("k")).alias("below"))


def ver04_minimum(spark: SparkSession, d: str) -> DataFrame:
    spec = F.when(F.length("version") % 2 == 0, F.concat(F.lit("==="), "version")).otherwise(F.concat(F.lit(">="), "version", F.lit(",<99")))
    return _installed(spark, d).select("name", "version", versions.minimum(spec).alias("m")).select("name", F.col("m.version").alias("version"), "m.exact")


def ver05_freshness(spark: SparkSession, d: str) -> DataFrame:
    v = _installed(spark, d)
    top = v.groupBy("name").agg(F.max_by("version", fn.version_key(F.col("version"))).alias("latest"))
    f = versions.freshness(v.select("name", F.col("version").alias("installed")), v.join(top, "name"))
    return f.withColumn("score", F.round("score", 6))


def ver06_major_bumps(spark: SparkSession, d: str) -> DataFrame:
    v = _installed(spark, d)
    pairs = v.join(v.select("name", F.col("version").alias("other")), "name")
    return pairs.select("name", "version", "other", fn.is_major_bump(F.col("version"), F.col("other")).alias("major"))


def dt04_times(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("source") == "github", "Z").otherwise(""))
    return scans(spark, d).select("id", F.unix_timestamp(advisories.time_of(text)).alias("at"))


def mth04_colors(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    hex_ = F.lower(F.lpad(F.hex(F.pmod(k * 7919, F.lit(1 << 24))), 6, "0"))
    text = F.when(k % 3 == 0, F.concat(F.lit("#"), hex_)).when(k % 3 == 1, F.format_string("rgb(%d, %d, %d)", (k % 256).cast("int"), F.col("p_size").cast("int"), (k % 7).cast("int"))).otherwise("transparent")
    c = colors.rgba(text)
    return p.select("p_partkey", c.alias("c")).select("p_partkey", "c.*")


def mth05_round_trip(spark: SparkSession, d: str) -> DataFrame:
    back = colors.from_oklab(*colors.oklab(*_rgb("p_partkey")))
    return table(spark, d, "part").select("p_partkey", *[F.round(c).cast("int").alias(n) for c, n in zip(back, "rgb")])


def mth07_screenshots(spark: SparkSession, d: str) -> DataFrame:
    h = [F.substring("fingerprint", k, 16) for k in (1, 17, 33, 49)]
    return findings(spark, d).select("id", web.screenshot_similarity(*h).alias("similarity"))


def jn12_nearest(spark: SparkSession, d: str) -> DataFrame:
    pages = findings(spark, d).select(F.col("id").alias("page"), F.substring("fingerprint", 1, 16).alias("hash"))
    refs = findings(spark, d).where("analyzer = 'architecture'").groupBy("rule_id").agg(F.min("fingerprint").alias("f"))
    return sites.nearest_reference(pages, refs.select(F.col("rule_id").alias("reference"), F.length("rule_id").alias("place"), F.substring("f", 17, 16).alias("hash")))


def _urls(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).where("file_path is not null")
    return f.select(F.concat(F.lit("https://"), "rule_id", F.lit(".example/"), "file_path").alias("url"), "analyzer")


def jn14_listed(spark: SparkSession, d: str) -> DataFrame:
    u = _urls(spark, d)
    return sites.listed_addresses(u.select("url").distinct(), u.where("analyzer = 'bandit'").select("url"))


def set07_feed_keys(spark: SparkSession, d: str) -> DataFrame:
    return sites.feed_keys(_urls(spark, d).select("url"))


def src34_feed(spark: SparkSession, d: str) -> DataFrame:
    lines = _urls(spark, d).select(F.concat(F.lit(" "), F.upper("url")).alias("value"))
    return advisories.feed(lines.unionByName(lines.select(F.lit("# comment").alias("value"))))


def src32_registrations(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    event = lambda n, c: F.struct(F.lit(n).alias("eventAction"), at(c).alias("eventDate"))
    card = F.concat(F.lit('["vcard",[["version",{},"text","4.0"],["fn",{},"text","'), F.coalesce("repo_owner", F.lit("nobody")), F.lit('"]]]'))
    entity = F.struct(F.array(F.lit("registrar")).alias("roles"), card.alias("vcardArray"))
    payload = F.to_json(F.struct(F.array(event("Registration", "created_at"), event("expiration", "completed_at")).alias("events"), F.array(entity).alias("entities")))
    out = advisories.registrations(scans(spark, d).select(F.col("id").alias("domain"), payload.alias("payload")))
    return out.select("domain", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("registered_at", "expires_at")], "registrar")


def agg32_link_brands(spark: SparkSession, d: str) -> DataFrame:
    links = findings(spark, d).select(F.col("scan_id").alias("page"), F.when(F.col("analyzer") != "architecture", F.col("analyzer")).alias("brand"))
    return sites.link_brands(links.where("page is not null"), 0.4).withColumn("share", F.round("share", 6))


def agg36_top_rules(spark: SparkSession, d: str) -> DataFrame:
    return sites.top_shares(findings(spark, d).where("scan_id is not null"), ["scan_id"], "rule_id").withColumn("share", F.round("share", 6))


def agg33_color_weights(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).where("scan_id is not null")
    styles = f.select(F.col("scan_id").alias("page"), F.coalesce("end_line", F.lit(0)).cast("double").alias("area"), (F.col("analyzer") == "ruff").alias("above_fold"), (F.col("analyzer") == "bandit").alias("is_button"), F.lit(64.0).alias("size"), F.col("category").alias("background"), F.col("analyzer").alias("text"))
    return sites.color_weights(styles).withColumn("weight", F.round("weight", 4))


def jn13_nearest_color(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    lab = lambda key: [c.alias(n) for c, n in zip(colors.oklab(*_rgb(key)), "lab")]
    asked = p.select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("color"), *lab("p_partkey"))
    seen = p.select(F.col("p_brand").alias("page"), F.col("p_size").cast("bigint").alias("color"), *lab("p_size")).distinct()
    return sites.nearest_color(asked, seen).select("page", "color", F.round("distance", 5).alias("distance"))


QUERIES = {
    f.__name__: f
    for f in (
        str02_skeletons, str03_plain_letters, str04_scripts, str05_words, str06_mentions, str08_normal_urls, str09_addresses, str10_registrable,
        str11_brands, str12_name_matches, prj26_defanged, str16_versions, str17_emails, prj16_predicates, prj17_step_kinds, prj04_advisory_severity,
        arr11_without_nul, str22_joined, str21_packages, prj22_import_forms, str23_references, str24_answers, str25_patches, str25_normal_patches,
        ver03_npm_order, ver02_pypi_order, ver04_minimum, ver05_freshness, ver06_major_bumps, dt04_times, mth04_colors, mth05_round_trip,
        mth07_screenshots, jn12_nearest, jn14_listed, set07_feed_keys, src34_feed, src32_registrations, agg32_link_brands, agg36_top_rules,
        agg33_color_weights, jn13_nearest_color,
    )
}

_N = f"(SELECT DISTINCT repo_name FROM {_S} WHERE repo_name IS NOT NULL)"
_H = f"(SELECT repo_name, 'a.B.' || repo_name || CASE WHEN length(repo_name) % 2 = 0 THEN '.co.uk' ELSE '.com' END AS host FROM {_N})"
_V = f"v AS MATERIALIZED (SELECT DISTINCT dependency.package AS name, dependency.installed_version AS version, list_transform(string_split(dependency.installed_version, '.'), lambda x: x::INT) AS k FROM {_F} WHERE dependency.installed_version IS NOT NULL)"
_U = f"(SELECT 'https://' || rule_id || '.example/' || file_path AS url, lower(rule_id || '.example') AS host, analyzer FROM {_F} WHERE file_path IS NOT NULL AND rule_id IS NOT NULL)"
_BITS = "bit_count(xor(('0x' || substr({0}, 1, 8))::BIGINT, ('0x' || substr({1}, 1, 8))::BIGINT)) + bit_count(xor(('0x' || substr({0}, 9, 8))::BIGINT, ('0x' || substr({1}, 9, 8))::BIGINT))"
_D = "string_split(path, '/')"
_LAB = "list_transform([0.2104542553*l+0.7936177850*m-0.0040720468*s, 1.9779984951*l-2.4285922050*m+0.4505937099*s, 0.0259040371*l+0.7827717662*m-0.8086757660*s], lambda x: x)"


def _lab(key: str) -> str:
    lin = [f"(CASE WHEN ({key} * {k}) % 256 / 255.0 <= 0.04045 THEN ({key} * {k}) % 256 / 255.0 / 12.92 ELSE pow((({key} * {k}) % 256 / 255.0 + 0.055) / 1.055, 2.4) END)::DOUBLE" for k in (7, 31, 101)]
    cones = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
    cube = [f"cbrt({m[0]}::DOUBLE * {lin[0]} + {m[1]}::DOUBLE * {lin[1]} + {m[2]}::DOUBLE * {lin[2]}) AS {n}" for m, n in zip(cones, "lms")]
    return ", ".join(cube)


ORACLE = {
    "str02_skeletons": f"SELECT repo_name, lower(repo_name) AS skeleton FROM {_N}",
    "str03_plain_letters": f"SELECT repo_name, replace(replace(replace(replace(replace(replace(replace(replace(lower(repo_name) || 'rn0vv13cl57', 'rn', 'm'), 'vv', 'w'), 'cl', 'd'), '0', 'o'), '1', 'l'), '3', 'e'), '5', 's'), '7', 't') AS plain FROM {_N}",
    "str04_scripts": f"SELECT repo_name, array_to_string(list_sort(list_concat(CASE WHEN regexp_matches(repo_name, '[aeo]') THEN ['CYRILLIC'] ELSE [] END, CASE WHEN regexp_matches(repo_name, '[b-df-np-zA-Z]') THEN ['LATIN'] ELSE [] END)), '+') AS scripts FROM {_N}",
    "str05_words": "SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(p_partkey || '-9_' || p_name), '[^a-z]+'), lambda x: x <> ''), '|') AS words FROM part",
    "str06_mentions": f"SELECT id, regexp_matches(message, '(?i)(^|[^\\w])parser([^\\w]|$)') AS mentions, regexp_matches(message, '(^|[^\\w])Stale([^\\w]|$)') AS in_title FROM {_F} WHERE message IS NOT NULL",
    "str08_normal_urls": f"""SELECT ' HTTPS://' || upper(repo_name) || '.Example.com:443/A?q=1#x' AS raw, 'https://' || lower(repo_name) || '.example.com/A?q=1' AS url, lower(repo_name) || '.example.com' AS host, NULL AS error FROM {_N}
      UNION ALL SELECT 'ftp://' || repo_name, NULL, NULL, 'scheme' FROM {_N} UNION ALL SELECT 'u:p@' || repo_name, NULL, NULL, 'credentials' FROM {_N}""",
    "str09_addresses": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey % 300 <= 255 THEN (p_partkey % 300) || '.' || p_size || '.' || (p_partkey % 7) || '.' || p_size END
      WHEN 1 THEN p_size || '.' || (p_partkey // 65536) % 256 || '.' || (p_partkey // 256) % 256 || '.' || p_partkey % 256 ELSE '0.' || (p_partkey // 65536) % 256 || '.' || (p_partkey // 256) % 256 || '.' || p_partkey % 256 END AS address FROM part""",
    "str10_registrable": f"SELECT host, lower(substr(host, 5)) AS registrable FROM {_H}",
    "str11_brands": f"""SELECT domain, arg_min(brand, (length(brand), brand)) AS brand FROM (SELECT DISTINCT lower(host) AS domain, repo_name FROM {_H} WHERE host LIKE '%.com') h JOIN (SELECT DISTINCT string_split(repo_name, '-')[1] AS brand, repo_name || '.com' AS d FROM {_N}) b ON ends_with(domain, '.' || d) GROUP BY 1""",
    "str12_name_matches": f"SELECT host, true AS one, false AS two FROM {_H}",
    "prj26_defanged": f"SELECT host, 'hxxps://' || replace(lower(host), '.', '[.]') || '/' || repeat('long/', 11) || 'long' AS url FROM {_H}",
    "str16_versions": f"SELECT scan_id, substr(sha256(string_agg(DISTINCT analyzer, '|' ORDER BY analyzer)), 1, 32) AS version FROM {_F} WHERE scan_id IS NOT NULL GROUP BY 1",
    "str17_emails": f"SELECT id, lower(user_id) || '@x.org' AS email FROM {_S} WHERE user_id IS NOT NULL",
    "prj16_predicates": f"""SELECT id, analyzer = 'ruff' AS bot, CASE analyzer WHEN 'bandit' THEN CASE WHEN file_path IS NOT NULL THEN true END WHEN 'dependency' THEN true ELSE regexp_matches(file_path, '(^|/)(dist|build|vendor|node_modules)/|\\.min\\.js$|\\.min\\.css$|\\.map$') END AS excluded,
      length(trim(message)) < 8 OR regexp_matches(trim(message), '(?i)^(fix|fixes|fixed|update|updates|updated|wip|test|tests|asdf|misc|changes|minor|stuff|\\.)\\.?$') AS low_info FROM {_F}""",
    "prj17_step_kinds": f"SELECT id, CASE analyzer WHEN 'semgrep' THEN 'security' WHEN 'bandit' THEN 'lint+tests' WHEN 'dependency' THEN 'build' ELSE '' END AS kinds FROM {_F}",
    "prj04_advisory_severity": """SELECT p_partkey, CASE WHEN p_size % 8 = 0 THEN 'error' WHEN p_size % 4 = 0 THEN 'warning' WHEN p_size / 5 >= 9 THEN 'critical' WHEN p_size / 5 >= 7 THEN 'error' WHEN p_size / 5 >= 4 THEN 'warning' ELSE 'info' END AS severity FROM part""",
    "arr11_without_nul": f"SELECT id, message || 'x' AS message, array_to_string(list_transform(merged_from, lambda x: x.rule_id), ',') AS rules FROM {_F}",
    "str22_joined": f"{modules._WITH} SELECT path, CASE WHEN len({_D}) > 1 THEN array_to_string(list_concat({_D}[1:len({_D}) - 2], [{_D}[-1]]), '/') END AS joined FROM q",
    "str21_packages": f"{modules._WITH} SELECT path, '@' || array_to_string({_D}[1:2], '/') AS scoped, {_D}[1] AS plain FROM q",
    "prj22_import_forms": f"""SELECT analyzer || ' (' || CASE WHEN analyzer = 'bandit' THEN 'non-literal' WHEN analyzer = 'ruff' OR starts_with(file_path, '.') THEN 'relative' WHEN regexp_matches(file_path, '^(@/|~/|#)') THEN 'alias' ELSE 'absolute' END || ')' AS form, 'file not found' AS reason, count(*) AS n
      FROM {_F} WHERE file_path IS NOT NULL GROUP BY 1""",
    "str23_references": f"{modules._WITH} SELECT path, path AS reference FROM q",
    "str24_answers": f"SELECT id, id AS read_id, severity FROM {_F}",
    "str25_patches": f"""SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(patch, '(?m)^(?:---|\\+\\+\\+) (?:[ab]/)?([^\\t\\n]+)', 1), lambda x: x <> '/dev/null'))), ',') AS paths,
      array_to_string(list_transform(regexp_extract_all(patch, '(?m)^@@ -(\\d+(?:,\\d+)?) ', 1), lambda x: string_split(x, ',')[1] || '-' || (string_split(x, ',')[1]::INT + coalesce(string_split(x, ',')[2]::INT, 1) - 1)), ',') AS ranges FROM {_X} WHERE patch IS NOT NULL""",
    "str25_normal_patches": f"SELECT id, CASE WHEN trim(patch, E' \\n') <> '' THEN rtrim(patch, E'\\n') || E'\\n' END AS patch FROM {_X} WHERE patch IS NOT NULL",
    "ver03_npm_order": f"WITH {_V}, w AS (SELECT name, version, list_append(k, 1) AS k FROM v UNION ALL SELECT name, version || '-rc.2', list_append(k, 0) FROM v) SELECT a.name, a.version, count(*) FILTER (b.k < a.k) AS below FROM w a JOIN w b USING (name) GROUP BY 1, 2",
    "ver02_pypi_order": f"WITH {_V}, w AS (SELECT name, version, list_append(k, 0) AS k FROM v UNION ALL SELECT name, version || '.post1', list_append(k, 1) FROM v) SELECT a.name, a.version, count(*) FILTER (b.k < a.k) AS below FROM w a JOIN w b USING (name) GROUP BY 1, 2",
    "ver04_minimum": f"WITH {_V} SELECT name, version, length(version) % 2 = 0 AS exact FROM v",
    "ver05_freshness": f"""WITH {_V}, j AS (SELECT a.name, a.version AS installed, a.k AS i, b.k AS o FROM v a JOIN v b USING (name)),
      g AS (SELECT name, installed, count(*) FILTER (o > i) AS versions_behind, count(DISTINCT CASE WHEN o > i AND (o[1] > i[1] OR o[1] = 0 AND o[2] > i[2]) THEN CASE WHEN o[1] > 0 THEN o[1] ELSE -o[2] - 1 END END) AS majors_behind FROM j GROUP BY 1, 2)
      SELECT *, round(CASE WHEN versions_behind <= 2 THEN 1.0 WHEN versions_behind <= 10 THEN 0.8 ELSE 0.6 END / (1 + majors_behind), 6) AS score FROM g""",
    "ver06_major_bumps": f"WITH {_V} SELECT a.name, a.version, b.version AS other, a.k[1] <> b.k[1] OR a.k[1] = 0 AND a.k[2] <> b.k[2] AS major FROM v a JOIN v b USING (name)",
    "dt04_times": f"SELECT id, CAST(floor(epoch(created_at)) AS BIGINT) AS at FROM {_S}",
    "mth04_colors": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN (h // 65536)::DOUBLE WHEN 1 THEN (p_partkey % 256)::DOUBLE END AS r, CASE p_partkey % 3 WHEN 0 THEN (h // 256 % 256)::DOUBLE WHEN 1 THEN p_size::DOUBLE END AS g,
      CASE p_partkey % 3 WHEN 0 THEN (h % 256)::DOUBLE WHEN 1 THEN (p_partkey % 7)::DOUBLE END AS b, CASE WHEN p_partkey % 3 < 2 THEN 1::DOUBLE END AS a FROM (SELECT *, (p_partkey * 7919) % 16777216 AS h FROM part)""",
    "mth05_round_trip": "SELECT p_partkey, CAST((p_partkey * 7) % 256 AS INT) AS r, CAST((p_partkey * 31) % 256 AS INT) AS g, CAST((p_partkey * 101) % 256 AS INT) AS b FROM part",
    "mth07_screenshots": f"SELECT id, (1 - ({_BITS.format('substr(fingerprint, 1, 16)', 'substr(fingerprint, 17, 16)')}) / 64 + 1 - ({_BITS.format('substr(fingerprint, 33, 16)', 'substr(fingerprint, 49, 16)')}) / 64) / 2 AS similarity FROM {_F}",
    "jn12_nearest": f"""WITH p AS (SELECT id AS page, substr(fingerprint, 1, 16) AS h FROM {_F}), r AS (SELECT rule_id AS reference, length(rule_id) AS place, substr(min(fingerprint), 17, 16) AS g FROM {_F} WHERE analyzer = 'architecture' GROUP BY 1),
      x AS (SELECT page, reference, place, 1 - ({_BITS.format('h', 'g')}) / 64 AS similarity FROM p, r) SELECT page, reference, similarity FROM x QUALIFY row_number() OVER (PARTITION BY page ORDER BY similarity DESC, place, reference DESC) = 1""",
    "jn14_listed": f"WITH u AS MATERIALIZED (SELECT * FROM {_U}) SELECT DISTINCT url, CASE WHEN url IN (SELECT url FROM u WHERE analyzer = 'bandit') THEN 'url' ELSE 'host' END AS by FROM u WHERE host IN (SELECT host FROM u WHERE analyzer = 'bandit')",
    "set07_feed_keys": f"SELECT url AS key FROM {_U} UNION SELECT 'host:' || host FROM {_U}",
    "src34_feed": f"SELECT DISTINCT lower(url) AS url FROM {_U}",
    "src32_registrations": f"SELECT id AS domain, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS registered_at, strftime(completed_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS expires_at, coalesce(repo_owner, 'nobody') AS registrar FROM {_S}",
    "agg32_link_brands": f"""WITH l AS (SELECT scan_id AS page, analyzer AS brand FROM {_F} WHERE scan_id IS NOT NULL), t AS (SELECT page, count(*) AS total FROM l GROUP BY 1), n AS (SELECT page, brand, count(*) AS n FROM l WHERE brand <> 'architecture' GROUP BY 1, 2)
      SELECT page, brand, round(n / total, 6) AS share FROM n JOIN t USING (page) WHERE total >= 5 AND n / total >= 0.4 QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, brand DESC) = 1""",
    "agg36_top_rules": f"""WITH n AS (SELECT scan_id, rule_id, count(*) AS weight FROM {_F} WHERE scan_id IS NOT NULL AND rule_id IS NOT NULL GROUP BY 1, 2), s AS (SELECT *, weight / sum(weight) OVER (PARTITION BY scan_id) AS share FROM n)
      SELECT scan_id, rule_id, weight, round(share, 6) AS share, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY weight DESC, rule_id) AS place FROM s WHERE share >= 0.02) WHERE place <= 5""",
    "agg33_color_weights": f"""WITH s AS (SELECT scan_id AS page, coalesce(end_line, 0)::DOUBLE * CASE analyzer WHEN 'ruff' THEN 2 WHEN 'bandit' THEN 4 ELSE 1 END AS w, category, analyzer FROM {_F} WHERE scan_id IS NOT NULL)
      SELECT page, color, role, round(sum(weight), 4) AS weight FROM (SELECT page, category AS color, 'background' AS role, w AS weight FROM s UNION ALL SELECT page, analyzer, 'text', 2 * w FROM s) WHERE color IS NOT NULL GROUP BY 1, 2, 3""",
    "jn13_nearest_color": f"""WITH a AS (SELECT p_brand AS page, p_partkey AS color, {_lab('p_partkey')} FROM part), b AS (SELECT DISTINCT p_brand AS page, p_size AS color, {_lab('p_size')} FROM part),
      x AS (SELECT page, color, {_LAB} AS v FROM a), y AS (SELECT page, {_LAB} AS u FROM b)
      SELECT page, color, round(min(d), 5) AS distance FROM (SELECT x.page, color, sqrt(pow(v[1] - u[1], 2) + pow(v[2] - u[2], 2) + pow(v[3] - u[3], 2)) AS d FROM x JOIN y USING (page)) WHERE d <= 0.04 GROUP BY 1, 2""",
}
