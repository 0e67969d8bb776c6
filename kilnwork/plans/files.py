"""Sources and sinks: files written from what findings hold, read again by the readers of their formats."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnwork.functions import paths as fp
from kilnwork.operators import architecture, history, sinks, sites
from kilnwork.plans import modules
from kilnwork.plans.derived import _commits
from kilnwork.plans.findings import _F, _PATH, _S, findings, scans
from kilnwork.plans.health import _CANON, _DECL, _PK, _packages, declared
from kilnwork.runtime import shared_dir, table
from kilnwork.sources import advisories, gitlog, manifests, pipelines


def _file(df: DataFrame, path: str, text: Column) -> DataFrame:
    return df.select("repo", F.lit(path).alias("path"), text.alias("text"))


def _packages_of(spark: SparkSession, d: str) -> DataFrame:
    """Each scan's packages with a version, sorted, as an array."""
    p = declared(spark, d).where("version is not null")
    p = p.withColumn("name", F.when(F.lower("ecosystem") == "pypi", F.regexp_replace(F.lower("name"), "[-_.]+", "-")).otherwise(F.col("name")))
    return p.groupBy("repo", F.lower("ecosystem").alias("ecosystem")).agg(F.array_sort(F.collect_set(F.struct("name", "version", "kind"))).alias("p"))


def _joined(each: Column | object, sep: str = "\n") -> Column:
    return F.array_join(F.transform("p", each), sep)


def src16_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Of package.json and requirements files."""
    p = _packages_of(spark, d)
    npm = _file(p.where("ecosystem = 'npm'"), "web/package.json", F.to_json(F.struct(F.map_from_entries(F.transform("p", lambda x: F.struct(x["name"], x["version"]))).alias("devDependencies"))))
    pypi = _file(p.where("ecosystem = 'pypi'"), "requirements.txt", F.concat(F.lit("# pinned\n-r other.txt\n"), _joined(lambda x: F.concat(F.upper(x["name"]), F.lit(" == "), x["version"], F.lit("  # why")))))
    return manifests.dependencies(npm.unionByName(pypi))


def src17_pyproject(spark: SparkSession, d: str) -> DataFrame:
    quoted = lambda kinds: F.array_join(F.transform(F.filter("p", lambda x: x["kind"].isin(*kinds)), lambda x: F.concat(F.lit('"'), x["name"], F.lit("[x]>="), x["version"], F.lit('"'))), ", ")
    text = F.concat(F.lit('[project]\nname = "x"\ndependencies = ['), quoted(["runtime"]), F.lit("]\n[dependency-groups]\ndev = ["), quoted(["dev", "optional"]), F.lit("]\n"))
    return manifests.dependencies(_file(_packages_of(spark, d).where("ecosystem = 'pypi'"), "pyproject.toml", text))


def _lock_rows(df: DataFrame) -> DataFrame:
    return manifests.locks(df).select("repo", "packages", "direct", "depth", F.size("versions").alias("versions"))


def src22_poetry_locks(spark: SparkSession, d: str) -> DataFrame:
    one = lambda x: F.concat(F.lit('[[package]]\nname = "'), x["name"], F.lit('"\nversion = "'), x["version"], F.lit('"\n'))
    return _lock_rows(_file(_packages_of(spark, d).where("ecosystem = 'pypi'"), "poetry.lock", _joined(one)))


def src21_uv_locks(spark: SparkSession, d: str) -> DataFrame:
    """A project that wants the first package, each of which wants the next."""
    after = lambda k: F.coalesce(F.concat(F.lit('dependencies = [{name = "'), F.get(F.col("p"), k + 1)["name"], F.lit('"}]\n')), F.lit(""))
    one = lambda x, k: F.concat(F.lit('[[package]]\nname = "'), x["name"], F.lit('"\nversion = "'), x["version"], F.lit('"\n'), after(k))
    own = F.concat(F.lit('[[package]]\nname = "own-project"\nsource = {editable = "."}\ndependencies = [{name = "'), F.get("p", F.lit(0))["name"], F.lit('"}]\n'))
    return _lock_rows(_file(_packages_of(spark, d).where("ecosystem = 'pypi'"), "uv.lock", F.concat(own, _joined(one))))


def src20_yarn_locks(spark: SparkSession, d: str) -> DataFrame:
    """The first entry wants all others."""
    wants = F.concat(F.lit("  dependencies:\n"), F.array_join(F.transform(F.slice("p", F.lit(2), F.size("p")), lambda y: F.concat(F.lit("    "), y["name"], F.lit(' "^'), y["version"], F.lit('"'))), "\n"), F.lit("\n"))
    one = lambda x, k: F.concat(x["name"], F.lit("@^"), x["version"], F.lit(':\n  version "'), x["version"], F.lit('"\n'), F.when((k == 0) & (F.size("p") > 1), wants).otherwise(""))
    return _lock_rows(_file(_packages_of(spark, d).where("ecosystem = 'npm'"), "yarn.lock", _joined(one)))


def src19_package_locks(spark: SparkSession, d: str) -> DataFrame:
    """The root wants the first package; each holds and wants the next in its own folder."""
    place = lambda k: F.array_join(F.transform(F.slice("p", F.lit(1), k + 1), lambda y: F.concat(F.lit("node_modules/"), y["name"])), "/")
    want = lambda k: F.when(F.get(F.col("p"), k).isNotNull(), F.create_map(F.coalesce(F.get(F.col("p"), k)["name"], F.lit("-")), F.lit("*"))).otherwise(F.create_map().cast("map<string,string>"))
    entry = lambda v, w: F.struct(v.alias("version"), w.alias("dependencies"))
    own = F.array(F.struct(F.lit("").alias("k"), entry(F.lit("0"), want(F.lit(0))).alias("v")))
    inner = F.transform("p", lambda x, k: F.struct(place(k).alias("k"), entry(x["version"], want(k + 1)).alias("v")))
    text = F.to_json(F.struct(F.map_from_entries(F.concat(own, inner)).alias("packages")))
    return manifests.locks(_file(_packages_of(spark, d).where("ecosystem = 'npm'"), "package-lock.json", text)).select("repo", "packages", "direct", "depth")


def src23_pnpm_locks(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("lockfileVersion: 9\npackages:\n"), _joined(lambda x: F.concat(F.lit("\n  /"), x["name"], F.lit("@"), x["version"], F.lit(":\n    resolution: x"))), F.lit("\nsnapshots:\n  /y:\n"))
    return manifests.locks(_file(_packages_of(spark, d).where("ecosystem = 'npm'"), "pnpm-lock.yaml", text)).select("repo", "packages")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Each scan's modules as files: a script imports the first script of its folder, a module the first module."""
    n = modules.nodes(spark, d).select(F.col("scan_id").alias("repo"), "path").withColumns({"folder": F.array_join(fp.folders_of(F.col("path")), "/"), "name": fp.name_of(F.col("path"))})
    python, script = F.col("path").endswith(".py"), F.col("path").rlike(r"\.[jt]s$")
    first = n.groupBy("repo", "folder").agg(F.min(F.when(python, F.col("name"))).alias("py"), F.min(F.when(script, F.col("name"))).alias("js"))
    t1 = F.concat(F.lit("import os\nfrom . import "), F.regexp_replace("py", r"\.py$", ""), F.lit("\n\ndef f():\n    import json\n"))
    t2 = F.concat(F.lit("import x from './"), F.col("js"), F.lit("';\n\nconst y = require('@scope/pkg/z');\n// end\n"))
    return n.join(first, ["repo", "folder"]).select("repo", "path", F.when(python, t1).when(script, t2).otherwise(F.lit("a: 1\n\n")).alias("text"))


def src09_modules(spark: SparkSession, d: str) -> DataFrame:
    return manifests.modules(_sources(spark, d)).select("repo", "path", "lines", "definitions", F.size("imports").alias("imports"), "error")


def jn23_python_imports(spark: SparkSession, d: str) -> DataFrame:
    parsed = manifests.modules(_sources(spark, d)).where("endswith(path, '.py')")
    return manifests.resolved(parsed).select("repo", "src", "module", "line", "lazy", "dst", "kind")


def jn24_script_imports(spark: SparkSession, d: str) -> DataFrame:
    return manifests.resolved_scripts(manifests.modules(_sources(spark, d))).select("repo", "src", "module", "line", "lazy", "dst", "kind")


def src08_source_lines(spark: SparkSession, d: str) -> DataFrame:
    return manifests.source_lines(_sources(spark, d))


def src04_sources(spark: SparkSession, d: str) -> DataFrame:
    return manifests.sources(_sources(spark, d))


def src05_folders(spark: SparkSession, d: str) -> DataFrame:
    return manifests.folders(_sources(spark, d))


def src07_detected(spark: SparkSession, d: str) -> DataFrame:
    more = scans(spark, d).select(F.col("id").alias("repo"), F.explode(F.array(F.lit("web/package.json"), F.lit("node_modules/x/package.json"), F.lit("pyproject.toml"))).alias("path"))
    out = manifests.languages(_sources(spark, d).select("repo", "path").unionByName(more))
    return out.withColumn("manifests", F.array_join("manifests", ","))


def src28_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A folder's lines as covered in two records, and a lesser report beside it."""
    n = modules.nodes(spark, d).select(F.col("scan_id").alias("repo"), F.substring_index("path", "/", 1).alias("folder"), "loc", "definitions").groupBy("repo", "folder").agg(F.sum("loc").alias("l"), F.sum("definitions").alias("c"))
    lcov = n.select("repo", F.concat("folder", F.lit("/lcov.info")).alias("path"), F.format_string("SF:a\nLF:%d\nLH:%d\nend_of_record\nLF:10\nLH:1\n", "l", "c").alias("text"))
    less = n.select("repo", F.concat("folder", F.lit("/coverage-summary.json")).alias("path"), F.lit('{"total":{"lines":{"total":9,"covered":9}}}').alias("text"))
    return manifests.coverage(lcov.unionByName(less))


def _pipelines(spark: SparkSession, d: str) -> DataFrame:
    """A workflow of three jobs: what builds needs a job that needs the tests, if the scan has an owner."""
    need = F.when(F.col("user_id").isNotNull(), F.lit("    needs: [middle]\n")).otherwise("")
    text = F.concat(F.lit("on: push\njobs:\n  tests:\n    steps:\n      - run: |\n          pip install pytest\n          pytest -q\n  middle:\n    needs: tests\n    steps:\n      - uses: actions/checkout@v4\n  ship:\n"), need, F.lit("    steps:\n      - run: docker build .\n"))
    return scans(spark, d).select(F.col("id").alias("repo"), F.lit(".github/workflows/ci.yml").alias("path"), text.alias("text"))


def src26_jobs(spark: SparkSession, d: str) -> DataFrame:
    j = pipelines.jobs(_pipelines(spark, d))
    return j.select("repo", "job", F.array_join("needs", ",").alias("needs"), F.array_join("items", ";").alias("items"))


def gr13_needs(spark: SparkSession, d: str) -> DataFrame:
    j = pipelines.jobs(_pipelines(spark, d))
    return pipelines.upstream(j.select("repo", "job", F.explode("needs").alias("needs")), ["repo"]).select("repo", "job", "needs")


def jn28_gated(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.gated(pipelines.jobs(_pipelines(spark, d))).select("repo", "job")


def src13_advisories(spark: SparkSession, d: str) -> DataFrame:
    """Scans of packages with one advisory each: hit from 0 up to the next patch, or only in another package."""
    p = _packages(spark, d).where("version is not null").dropDuplicates(["repo", "name", "version"])
    fix = F.concat(F.regexp_replace("version", r"\d+$", ""), (F.element_at(F.split("version", r"\."), -1).cast("int") + 1).cast("string"))
    other = F.when(F.col("rank") >= 3, F.lit("other-name")).otherwise(F.col("name"))
    event = lambda a, b: F.struct(a.alias("introduced"), b.alias("fixed"))
    none = F.lit(None).cast("string")
    ranges = F.array(F.struct(F.lit("ECOSYSTEM").alias("type"), F.array(event(F.lit("0"), none), event(none, fix)).alias("events")))
    vuln = F.struct(F.concat(F.lit("GHSA-"), "name").alias("id"), F.array(F.struct(F.struct(other.alias("name"), F.col("ecosystem")).alias("package"), ranges.alias("ranges"))).alias("affected"))
    group = F.struct(F.array(F.concat(F.lit("GHSA-"), "name")).alias("ids"), F.array(F.lit("CVE-2026-1")).alias("aliases"), F.when(F.col("rank") == 4, "9.8").when(F.col("rank") == 3, "7.1").otherwise("").alias("max_severity"))
    pack = F.struct(F.struct("name", "ecosystem", "version").alias("package"), F.array(vuln).alias("vulnerabilities"), F.array(group).alias("groups"))
    payload = F.to_json(F.struct(F.collect_list(F.struct(F.struct(F.lit("/src/a.lock").alias("path")).alias("source"), F.array("pack").alias("packages"))).alias("results")))
    texts = p.select("repo", pack.alias("pack")).groupBy(F.col("repo").alias("scan_id")).agg(payload.alias("payload"))
    out = advisories.vulnerable_packages(texts)
    return out.select("scan_id", "path", "ecosystem", "name", "version", "advisory", "severity", "fixed")


@F.pandas_udf(T.BinaryType())
def _zipped(names: pd.Series) -> pd.Series:
    def pack(name: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, "x" * len(name))
            z.writestr("a/b.txt", "1")
        return out.getvalue()

    return names.map(pack)


def src01_archives(spark: SparkSession, d: str) -> DataFrame:
    """An archive a scan, some with a member that leaves the archive."""
    s = scans(spark, d).select(F.col("id").alias("repo"), F.when(F.col("user_id").isNull(), "../up.txt").otherwise("up.txt").alias("name"))
    out = manifests.archive_files(s.select("repo", _zipped("name").alias("content")))
    return out.select("repo", "path", F.octet_length("content").alias("bytes"), "error")


def src15_unquoted(spark: SparkSession, d: str) -> DataFrame:
    s = scans(spark, d).where("repo_name is not null")
    record = F.concat("id", F.lit("\x1f\x1fa\x1fa@x.org\x1f7\x1fs\n1\t2\t\"caf\\303\\251/\\t"), "repo_name", F.lit("\"\n-\t-\tplain.py"))
    c = gitlog.commits(s.select(record.alias("record")))
    return c.select("sha", F.explode("files").alias("f")).select("sha", "f.path", "f.added")


def src40_snippets(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).where("file_path is not null and start_line is not null").select("id", F.lit("r").alias("repo"), "file_path", "start_line", F.coalesce("end_line", "start_line").alias("end_line"), "code_snippet")
    files = f.select("repo", F.col("file_path").alias("path")).distinct().withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(900)), lambda k: F.concat(F.lit("l"), k)), "\n"))
    out = manifests.snippets(f, files)
    return out.select("id", F.md5("code_snippet").alias("snippet"))


def src39_sampled(spark: SparkSession, d: str) -> DataFrame:
    u = findings(spark, d).where("file_path is not null").select(F.concat(F.lit("https://a."), "rule_id", F.lit(".org/"), "file_path").alias("url")).where("url is not null").distinct()
    return sites.sampled(u, 15, "seed")


# -- sinks


def snk01_replaced(spark: SparkSession, d: str) -> DataFrame:
    """Findings written by analyzer, one of a fingerprint, then one analyzer's again."""
    path = f"{shared_dir(spark)}/replaced-{uuid.uuid4().hex}"
    f = findings(spark, d).select("analyzer", "scan_id", "fingerprint", "id")
    sinks.replace_by(f, path, "analyzer", ["scan_id", "fingerprint"], "id")
    sinks.replace_by(f.where("analyzer = 'ruff'").withColumn("id", -F.col("id")), path, "analyzer", ["scan_id", "fingerprint"], "id")
    return spark.read.parquet(path).select("analyzer", "scan_id", "fingerprint", "id")


def snk02_upserted(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).select("id", "severity")
    return sinks.upserted(f, f.where("severity = 'error'").select("id", F.lit("upserted").alias("severity")), ["id"])


def snk05_css(spark: SparkSession, d: str) -> DataFrame:
    t = scans(spark, d).select("status", F.concat_ws("_", "repo_name", F.substring("id", 1, 8)).alias("name"), F.coalesce(F.col("source_loc").cast("string"), F.lit("none")).alias("value"))
    return sinks.css_tokens(t, "status")


def snk07_pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    s = scans(spark, d).where("user_id is not null")
    return s.select("id", sinks.without_emails(F.concat(F.lit("by "), F.upper("user_id"), F.lit("@X.org, ok"))).alias("text"))


def snk08_purged(spark: SparkSession, d: str) -> DataFrame:
    p = sinks.purged(findings(spark, d), ["message", "code_snippet"], "ingested_at", F.lit("2026-03-01").cast("timestamp"))
    return p.select("id", "message", "code_snippet")


def st11_failures(spark: SparkSession, d: str) -> DataFrame:
    return sinks.newest_entries(scans(spark, d).where("status = 'failed'"), "created_at", 20, "id").select("id", "status")


def st10_unfinished(spark: SparkSession, d: str) -> DataFrame:
    return sinks.unfinished(table(spark, d, "scans").select("id"), scans(spark, d).select("id", "status"), "id", ("completed", "failed", "cancelled"))


def st12_gauges(spark: SparkSession, d: str) -> DataFrame:
    s = scans(spark, d).groupBy(F.lit("scans").alias("gauge"), F.col("status").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    p = table(spark, d, "pull_requests").dropDuplicates(["id"]).groupBy(F.lit("pull_requests").alias("gauge"), F.col("status").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return s.unionByName(p)


def set01_all_findings(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).dropDuplicates(["result_id"]).select(F.lit(t).alias("tool"), "result_id") for t in ("semgrep_output", "bandit_output", "ruff_output")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def prj15_visible(spark: SparkSession, d: str) -> DataFrame:
    """Scans without an owner, and those of the first owner."""
    first = scans(spark, d).agg(F.min("user_id")).first()[0]
    return scans(spark, d).where(F.col("user_id").isNull() | (F.col("user_id") == first)).select("id")


def tk04_own_scans(spark: SparkSession, d: str) -> DataFrame:
    first = scans(spark, d).agg(F.min("user_id")).first()[0]
    return scans(spark, d).where(F.col("user_id") == first).orderBy(F.desc("created_at"), "id").limit(20).select("id")


def arr06_cycle_edges(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).where("size(cwe_ids) > 0").select("id", F.transform("cwe_ids", lambda x: x.cast("string")).alias("c"))
    from kilnwork.operators import views

    edges = F.transform(views.around(F.col("c")), lambda e: F.concat(e["src"], F.lit(">"), e["dst"]))
    return f.select("id", F.array_join(edges, ",").alias("edges"))


# -- history


def _present(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pull_requests").dropDuplicates(["id"])
    return p.where("status = 'open'").select(F.col("repo_full_name").alias("repo"), F.col("branch").alias("path"))


def agg23_churn(spark: SparkSession, d: str) -> DataFrame:
    return history.churn(_commits(spark, d), _present(spark, d))


def win08_hotspots(spark: SparkSession, d: str) -> DataFrame:
    churned = history.churn(_commits(spark, d), _present(spark, d))
    return history.hotspots(churned, churned.select("repo", "path", F.length("path").alias("complexity"))).select("repo", "path", "n", "complexity")


def tk10_cycles(spark: SparkSession, d: str) -> DataFrame:
    c = architecture.cycles(modules.edges(spark, d))
    return c.select("scan_id", F.array_join("cycle", ">").alias("cycle"), "truncated")


def gr04_centrality(spark: SparkSession, d: str) -> DataFrame:
    return architecture.node_metrics(modules.edges(spark, d)).select("scan_id", "node", F.round("centrality", 5).alias("centrality"))


QUERIES = {
    f.__name__: f
    for f in (
        src16_dependencies, src17_pyproject, src22_poetry_locks, src21_uv_locks, src20_yarn_locks, src19_package_locks, src23_pnpm_locks,
        src09_modules, jn23_python_imports, jn24_script_imports, src08_source_lines, src04_sources, src05_folders, src07_detected, src28_coverage,
        src26_jobs, gr13_needs, jn28_gated, src13_advisories, src01_archives, src15_unquoted, src40_snippets, src39_sampled, snk01_replaced,
        snk02_upserted, snk05_css, snk07_pseudonyms, snk08_purged, st11_failures, st10_unfinished, st12_gauges, set01_all_findings,
        prj15_visible, tk04_own_scans, arr06_cycle_edges, agg23_churn, win08_hotspots, tk10_cycles, gr04_centrality,
    )
}

_LOCKED = f"""WITH {_DECL}, x AS MATERIALIZED (SELECT DISTINCT repo, lower(ecosystem) AS ecosystem, {_CANON} AS name, version, kind FROM d WHERE version IS NOT NULL)"""
_COUNTS = "SELECT repo, CAST(count(*) AS INT) AS packages, {0} AS direct, {1} AS depth, CAST(count(DISTINCT name) AS INT) AS versions FROM x WHERE ecosystem = '{2}' GROUP BY 1"
_FILES = f"""{modules._WITH}, s AS MATERIALIZED (SELECT n.scan_id AS repo, n.path, name, array_to_string({modules._FOLDERS.replace('path', 'n.path')}, '/') AS folder, ends_with(n.path, '.py') AS py, regexp_matches(n.path, '\\.[jt]s$') AS js FROM n),
f AS MATERIALIZED (SELECT repo, folder, min(name) FILTER (py) AS fp, min(name) FILTER (js) AS fj FROM s GROUP BY 1, 2)"""
_IN = "CASE WHEN folder = '' THEN {0} ELSE folder || '/' || {0} END"
_PR = "(SELECT DISTINCT ON (id) * FROM pull_requests)"
_CHURN = f"""SELECT repo_full_name AS repo, branch AS path, count(DISTINCT id) AS n FROM {_PR} WHERE branch IS NOT NULL AND (repo_full_name, branch) IN (SELECT (repo_full_name, branch) FROM {_PR} WHERE status = 'open') GROUP BY 1, 2"""

ORACLE = {
    "src16_dependencies": f"{_LOCKED} SELECT repo, ecosystem, name, CASE ecosystem WHEN 'npm' THEN version ELSE '== ' || version END AS spec, CASE ecosystem WHEN 'npm' THEN 'dev' ELSE 'runtime' END AS kind FROM x WHERE ecosystem IN ('npm', 'pypi')",
    "src17_pyproject": f"{_LOCKED} SELECT repo, ecosystem, name, '>=' || version AS spec, CASE kind WHEN 'runtime' THEN 'runtime' ELSE 'dev' END AS kind FROM x WHERE ecosystem = 'pypi'",
    "src22_poetry_locks": f"{_LOCKED} {_COUNTS.format('CAST(count(*) AS INT)', 'CAST(1 AS INT)', 'pypi')}",
    "src21_uv_locks": f"{_LOCKED} {_COUNTS.format('CAST(1 AS INT)', 'CAST(count(*) AS INT)', 'pypi')}",
    "src20_yarn_locks": f"{_LOCKED} {_COUNTS.format('CAST(1 AS INT)', 'CAST(least(count(*), 2) AS INT)', 'npm')}",
    "src19_package_locks": f"{_LOCKED} SELECT repo, CAST(count(*) AS INT) AS packages, CAST(1 AS INT) AS direct, CAST(count(*) AS INT) AS depth FROM x WHERE ecosystem = 'npm' GROUP BY 1",
    "src23_pnpm_locks": f"{_LOCKED} SELECT repo, CAST(count(*) AS INT) AS packages FROM x WHERE ecosystem = 'npm' GROUP BY 1",
    "src09_modules": f"{_FILES} SELECT repo, path, CAST(CASE WHEN py THEN 4 ELSE 3 END AS INT) AS lines, CAST(py::INT AS INT) AS definitions, CAST(CASE WHEN py THEN 3 ELSE 2 END AS INT) AS imports, NULL AS error FROM s WHERE py OR js",
    "jn23_python_imports": f"""{_FILES}, pp AS (SELECT s.*, regexp_replace(fp, '\\.py$', '') AS m, fp FROM s JOIN f USING (repo, folder) WHERE py)
      SELECT repo, path AS src, 'os' AS module, 1 AS line, false AS lazy, NULL AS dst, 'external' AS kind FROM pp UNION ALL SELECT repo, path, m, 2, false, {_IN.format('fp')}, 'internal' FROM pp UNION ALL SELECT repo, path, 'json', 5, true, NULL, 'external' FROM pp""",
    "jn24_script_imports": f"""{_FILES}, pp AS (SELECT s.*, fj FROM s JOIN f USING (repo, folder) WHERE js)
      SELECT repo, path AS src, './' || fj AS module, 1 AS line, false AS lazy, {_IN.format('fj')} AS dst, 'internal' AS kind FROM pp UNION ALL SELECT repo, path, '@scope/pkg/z', 3, true, NULL, 'external' FROM pp""",
    "src08_source_lines": f"{_FILES} SELECT repo, CAST(sum(CASE WHEN py THEN 4 WHEN js THEN 3 ELSE 1 END) AS BIGINT) AS loc FROM s GROUP BY 1",
    "src04_sources": f"{modules._WITH} SELECT scan_id AS repo, path, language FROM n WHERE language <> 'other' AND NOT list_has_any(string_split(path, '/'), ['.git', 'node_modules', 'vendor', 'dist', 'build', '.venv', 'venv', '__pycache__'])",
    "src05_folders": f"{_FILES} SELECT DISTINCT repo, array_to_string(string_split(folder, '/')[1:k], '/') AS folder FROM s, range(0, 30) r(k) WHERE k <= CASE WHEN folder = '' THEN 0 ELSE len(string_split(folder, '/')) END",
    "src07_detected": f"""{modules._WITH}, a AS (SELECT scan_id AS repo, language, count(*) AS files FROM n WHERE language <> 'other' AND NOT list_has_any(string_split(path, '/'), ['.git', 'node_modules', 'vendor', 'dist', 'build', '.venv', 'venv', '__pycache__']) GROUP BY 1, 2),
      b AS (SELECT id AS repo, l AS language, m FROM {_S}, (VALUES ('javascript', 'web/package.json'), ('python', 'pyproject.toml')) t(l, m)) SELECT repo, language, coalesce(files, 0) AS files, coalesce(m, '') AS manifests FROM a FULL JOIN b USING (repo, language)""",
    "src28_coverage": f"{modules._WITH} SELECT scan_id AS repo, string_split(path, '/')[1] AS folder, CAST(sum(definitions) + 1 AS BIGINT) AS covered, CAST(sum(loc) + 10 AS BIGINT) AS total FROM n GROUP BY 1, 2",
    "src26_jobs": f"""SELECT id AS repo, job, CASE job WHEN 'middle' THEN 'tests' WHEN 'ship' THEN CASE WHEN user_id IS NULL THEN '' ELSE 'middle' END ELSE '' END AS needs, items FROM {_S}, (VALUES ('tests', 'pip install pytest;pytest -q'), ('middle', 'actions/checkout@v4'), ('ship', 'docker build .')) t(job, items)""",
    "gr13_needs": f"SELECT id AS repo, 'middle' AS job, 'tests' AS needs FROM {_S} UNION ALL SELECT id, 'ship', n FROM {_S}, (VALUES ('middle'), ('tests')) t(n) WHERE user_id IS NOT NULL",
    "jn28_gated": f"SELECT id AS repo, 'ship' AS job FROM {_S} WHERE user_id IS NOT NULL",
    "src13_advisories": f"""WITH {_PK}, z AS (SELECT DISTINCT ON (repo, name, version) * FROM k WHERE version IS NOT NULL) SELECT repo AS scan_id, 'a.lock' AS path, ecosystem, name, version, 'CVE-2026-1' AS advisory, CASE r WHEN 4 THEN 'critical' WHEN 3 THEN 'error' ELSE 'warning' END AS severity,
      CASE WHEN r < 3 THEN regexp_replace(version, '\\d+$', '') || (list_last(string_split(version, '.'))::INT + 1) END AS fixed FROM z""",
    "src01_archives": f"""SELECT id AS repo, path, CAST(CASE path WHEN 'up.txt' THEN 6 ELSE 1 END AS INT) AS bytes, NULL AS error FROM {_S}, (VALUES ('up.txt'), ('a/b.txt')) t(path) WHERE user_id IS NOT NULL UNION ALL SELECT id, NULL, NULL, 'unsafe path' FROM {_S} WHERE user_id IS NULL""",
    "src15_unquoted": f"SELECT id AS sha, p AS path, a AS added FROM {_S}, LATERAL (SELECT unnest(['café/' || chr(9) || repo_name, 'plain.py']) AS p, unnest([1, NULL]) AS a) WHERE repo_name IS NOT NULL",
    "src40_snippets": f"""SELECT id, md5(coalesce(nullif(code_snippet, ''), nullif(array_to_string(list_transform(range(greatest(start_line, 1), least(coalesce(end_line, start_line), start_line + 19, 900) + 1), lambda x: 'l' || x), E'\\n'), ''))) AS snippet FROM {_F} WHERE file_path IS NOT NULL AND start_line IS NOT NULL""",
    "src39_sampled": f"""WITH u AS (SELECT DISTINCT 'https://a.' || rule_id || '.org/' || file_path AS url, lower(rule_id) AS r FROM {_F} WHERE file_path IS NOT NULL AND rule_id IS NOT NULL), z AS (SELECT url, list_last(string_split(r, '.')) || '.org' AS domain, md5('seed' || url) AS o FROM u)
      SELECT url, domain FROM (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY domain ORDER BY o, url) = 1) ORDER BY o LIMIT 15""",
    "snk01_replaced": f"SELECT analyzer, scan_id, fingerprint, CASE WHEN analyzer = 'ruff' THEN -max(id) ELSE min(id) END AS id FROM {_F} GROUP BY 1, 2, 3",
    "snk02_upserted": f"SELECT id, CASE WHEN severity = 'error' THEN 'upserted' ELSE severity END AS severity FROM {_F}",
    "snk05_css": f"""SELECT status, ':root {{' || E'\\n' || string_agg(l, E'\\n' ORDER BY l) || E'\\n' || '}}' || E'\\n' AS css FROM (SELECT status, '  --' || regexp_replace(lower(concat_ws('_', repo_name, substr(id, 1, 8))), '[^a-z0-9]+', '-', 'g') || ': ' || coalesce(source_loc::VARCHAR, 'none') || ';' AS l FROM {_S}) GROUP BY 1""",
    "snk07_pseudonyms": f"SELECT id, 'by author-' || substr(sha256(lower(user_id) || '@x.org'), 1, 10) || ', ok' AS text FROM {_S} WHERE user_id IS NOT NULL",
    "snk08_purged": f"SELECT id, CASE WHEN ingested_at < TIMESTAMPTZ '2026-03-01 00:00:00+00' THEN NULL ELSE message END AS message, CASE WHEN ingested_at < TIMESTAMPTZ '2026-03-01 00:00:00+00' THEN NULL ELSE code_snippet END AS code_snippet FROM {_F}",
    "st11_failures": f"SELECT id, status FROM {_S} WHERE status = 'failed' ORDER BY created_at DESC, id LIMIT 20",
    "st10_unfinished": f"SELECT id FROM {_S} WHERE status NOT IN ('completed', 'failed', 'cancelled') OR status IS NULL",
    "st12_gauges": f"SELECT 'scans' AS gauge, status AS label, count(*) AS n FROM {_S} GROUP BY 2 UNION ALL SELECT 'pull_requests', status, count(*) FROM {_PR} GROUP BY 2",
    "set01_all_findings": "SELECT DISTINCT 'semgrep_output' AS tool, result_id FROM semgrep_output UNION ALL SELECT DISTINCT 'bandit_output', result_id FROM bandit_output UNION ALL SELECT DISTINCT 'ruff_output', result_id FROM ruff_output",
    "prj15_visible": f"SELECT id FROM {_S} WHERE user_id IS NULL OR user_id = (SELECT min(user_id) FROM scans)",
    "tk04_own_scans": f"SELECT id FROM {_S} WHERE user_id = (SELECT min(user_id) FROM scans) ORDER BY created_at DESC, id LIMIT 20",
    "arr06_cycle_edges": f"SELECT id, array_to_string(list_transform(range(1, len(cwe_ids) + 1), lambda k: cwe_ids[k] || '>' || cwe_ids[k % len(cwe_ids) + 1]), ',') AS edges FROM {_F} WHERE len(cwe_ids) > 0",
    "agg23_churn": _CHURN,
    "win08_hotspots": f"""WITH c AS ({_CHURN}), k AS (SELECT *, length(path) AS complexity, greatest(1, ceil(count(*) OVER (PARTITION BY repo) / 10)) AS most, row_number() OVER (PARTITION BY repo ORDER BY n DESC, path) AS a, row_number() OVER (PARTITION BY repo ORDER BY length(path) DESC, path) AS b FROM c)
      SELECT repo, path, n, CAST(complexity AS INT) AS complexity FROM k WHERE a <= most AND b <= most""",
    "tk10_cycles": f"""WITH RECURSIVE {modules._BASE}, t AS MATERIALIZED (SELECT scan_id, src, dst FROM e WHERE NOT type_only), w AS (SELECT scan_id, src AS s, dst AS t, [src, dst] AS p FROM t WHERE dst > src
      UNION ALL SELECT w.scan_id, w.s, t.dst, list_append(p, t.dst) FROM w JOIN t ON t.scan_id = w.scan_id AND t.src = w.t WHERE t.dst > w.s AND len(p) < 10 AND NOT list_contains(p, t.dst)),
      c AS (SELECT w.scan_id, p FROM w JOIN t ON t.scan_id = w.scan_id AND t.src = w.t AND t.dst = w.s)
      SELECT scan_id, array_to_string(p, '>') AS cycle, m > 100 AS truncated FROM (SELECT *, count(*) OVER (PARTITION BY scan_id) AS m, row_number() OVER (PARTITION BY scan_id ORDER BY len(p), p) AS k FROM c) WHERE k <= 100""",
}
