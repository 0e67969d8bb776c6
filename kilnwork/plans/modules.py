"""Module graphs: files that findings name as modules, findings of one rule in order as imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnwork.functions import findings as fn
from kilnwork.functions import paths as fp
from kilnwork.operators import architecture, views
from kilnwork.plans.findings import _F, _PATH, _RANK, findings
from kilnwork.runtime import written

MOST = 25


def _files(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).withColumn("path", fn.plain_path(F.col("file_path")))
    return f.where("scan_id is not null and path is not null and path <> ''")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    n = _files(spark, d).groupBy("scan_id", "path").agg(
        F.max(F.coalesce("end_line", "start_line", F.lit(0))).cast("bigint").alias("loc"),
        F.count(F.lit(1)).alias("definitions"),
        F.bool_or(F.col("code_snippet").isNull()).alias("parse_error"),
    )
    n = n.withColumns({"module_id": F.col("path"), "centrality": F.col("definitions") / 64})
    # What a path says is read once for each path, not for each scan that has it.
    p = n.select("path").distinct().withColumns({"language": fp.language_of(F.col("path")), "is_test": fp.is_test(F.col("path")), "layer": architecture.layer_of(F.col("path"))})
    p = p.withColumn("is_entry", fp.is_entry_point(F.col("path"), F.col("language"), F.col("is_test")))
    return n.join(p, "path")


def references(spark: SparkSession, d: str) -> DataFrame:
    """A finding's file as importing the file of the scan's next finding of the same rule."""
    f = _files(spark, d).select("scan_id", "rule_id", "id", "path", "start_line", "analyzer", "severity")
    f = f.withColumn("dst", F.lead("path").over(Window.partitionBy("scan_id", "rule_id").orderBy("id"))).where("dst is not null")
    lazy = F.coalesce(fn.severity_rank(F.col("severity")) == 1, F.lit(False))
    return f.select("scan_id", F.col("path").alias("src"), "dst", F.coalesce("start_line", F.lit(0)).alias("line"), (F.col("analyzer") == "ruff").alias("type_only"), lazy.alias("lazy"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return architecture.edges_of(references(spark, d))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, issues), of which the first two are written as they are read several times."""
    n, e = written(nodes(spark, d))[0], written(edges(spark, d))[0]
    return n, e, _issues(n, e)


def _issues(n: DataFrame, e: DataFrame) -> DataFrame:
    cycles = views.cycle_issues(_mutual(e), e)
    layers = architecture.layer_issues(n, e)
    one = F.array(F.struct("src", "dst"))
    severity = F.when(F.col("kind") == "inversion", "error").otherwise("warning")
    layers = layers.select("scan_id", views.issue_key(F.lit("layer"), F.array("src", "dst"), one).alias("issue_id"), F.lit("layer").alias("kind"), severity.alias("severity"), F.array("src", "dst").alias("modules"), one.alias("edges"))
    return cycles.unionByName(layers)


def gr01_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


def gr02_runtime_edges(spark: SparkSession, d: str) -> DataFrame:
    return architecture.runtime(edges(spark, d)).select("scan_id", "src", "dst")


def prj19_layers(spark: SparkSession, d: str) -> DataFrame:
    front = architecture.is_frontend(F.col("path"))
    layer = architecture.layer_of(F.col("path"), None, F.col("frontend"))
    n = nodes(spark, d).select("path").distinct().withColumn("top", F.substring_index("path", "/", 1))
    projects = n.groupBy("top").agg(F.bool_or(front).alias("frontend"))
    return n.join(projects, "top").select("path", "frontend", layer.alias("layer"))


def prj20_entry_points(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).select("path", "language", "is_test", "is_entry").distinct()


def prj21_module_ids(spark: SparkSession, d: str) -> DataFrame:
    return views.module_ids(nodes(spark, d))


def str18_words(spark: SparkSession, d: str) -> DataFrame:
    p = nodes(spark, d).select("path").distinct()
    return p.select("path", F.array_join(F.flatten(F.transform(F.split("path", "/"), fp.words_of)), " ").alias("words"))


def jn19_layer_issues(spark: SparkSession, d: str) -> DataFrame:
    return architecture.layer_issues(nodes(spark, d), edges(spark, d))


def jn17_orphans(spark: SparkSession, d: str) -> DataFrame:
    n = nodes(spark, d).withColumns({"is_entrypoint": F.col("is_entry"), "error": F.lit(None).cast("string")})
    return architecture.orphans(n, edges(spark, d))


def _mutual(e: DataFrame) -> DataFrame:
    back = e.select("scan_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.where("src < dst").join(back, ["scan_id", "src", "dst"]).select("scan_id", F.array("src", "dst").alias("cycle"))


def gr07_cycle_issues(spark: SparkSession, d: str) -> DataFrame:
    """Of first folders that import each other."""
    e = architecture.edges_of(references(spark, d).withColumns({c: F.substring_index(c, "/", 1) for c in ("src", "dst")}))
    i = views.cycle_issues(_mutual(e), e)
    return i.select("scan_id", "issue_id", "severity", F.array_join("modules", ">").alias("modules"), F.size("edges").alias("n_edges"))


def prj13_issues(spark: SparkSession, d: str) -> DataFrame:
    i = views.issues_of(_graph(spark, d)[2], ("cycle", "layer"), ("error",))
    return i.groupBy("scan_id", "kind", "severity").agg(F.count(F.lit(1)).alias("n"))


def arr04_issues_of_module(spark: SparkSession, d: str) -> DataFrame:
    i = views.issues_of(_graph(spark, d)[2].where("array_contains(modules, modules[0])"), ("layer",))
    return i.select("scan_id", "issue_id", F.explode("modules").alias("module")).where("module rlike '^(models|handlers)/'")


def agg16_view_nodes(spark: SparkSession, d: str) -> DataFrame:
    n, e, issues = _graph(spark, d)
    keys = written(views.view_keys(n, MOST, greedy=False))[0]
    return views.view_nodes(keys, n, views.view_edges(keys, e, issues))


def jn25_view_edges(spark: SparkSession, d: str) -> DataFrame:
    n, e, issues = _graph(spark, d)
    return views.view_edges(written(views.view_keys(n, MOST, greedy=False))[0], e, issues)


def str19_view_keys(spark: SparkSession, d: str) -> DataFrame:
    """Two folders opened, one closed."""
    return views.view_keys(nodes(spark, d), MOST, ("models", "handlers"), ("jobs",), greedy=False)


def gr17_opened_views(spark: SparkSession, d: str) -> DataFrame:
    keys = views.view_keys(nodes(spark, d), MOST)
    return keys.groupBy("scan_id").agg(F.count_distinct("key").alias("keys"), F.count(F.lit(1)).alias("modules"))


def set05_issue_nodes(spark: SparkSession, d: str) -> DataFrame:
    n, _, issues = _graph(spark, d)
    keys = views.view_keys(n, MOST, greedy=False)
    return views.issue_nodes(keys, issues).withColumn("nodes", F.array_join("nodes", ">"))


def _external(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d).where("rule_id is not null")
    return f.groupBy("scan_id", F.col("path").alias("src"), F.col("rule_id").alias("dst")).agg(F.count(F.lit(1)).alias("n"), F.min("analyzer").alias("resolution"))


def agg08_external_packages(spark: SparkSession, d: str) -> DataFrame:
    return views.external_packages(_external(spark, d), nodes(spark, d))


def tk06_most_used_packages(spark: SparkSession, d: str) -> DataFrame:
    return views.external_packages(_external(spark, d), nodes(spark, d), 5).select("scan_id", "package", "language", "importers")


def gr18_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    x = views.neighbourhood(edges(spark, d), nodes(spark, d))
    return x.select("scan_id", "module_id", F.array_join("importers", ">").alias("importers"), F.array_join("imports", ">").alias("imports"))


def tk08_top_modules(spark: SparkSession, d: str) -> DataFrame:
    return views.top_modules(nodes(spark, d), "loc")


def gr19_folder_tree(spark: SparkSession, d: str) -> DataFrame:
    return views.folder_tree(nodes(spark, d))


def jn30_places(spark: SparkSession, d: str) -> DataFrame:
    return views.facts(nodes(spark, d), edges(spark, d))[0]


def jn30_imports(spark: SparkSession, d: str) -> DataFrame:
    return views.facts(nodes(spark, d), edges(spark, d))[1]


def jn18_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citations of files next to each other in findings' order, the second by its folder."""
    f = _files(spark, d).select("scan_id", "id", "path")
    after = f.select("scan_id", (F.col("id") - F.col("id") % 3 - 1).alias("id"), F.col("path").alias("to")).dropDuplicates(["scan_id", "id"])
    cited = f.join(after.groupBy("scan_id", "id").agg(F.min("to").alias("to")), ["scan_id", "id"])
    text = F.concat(F.lit("`"), "path", F.lit(":12` -> ./"), F.regexp_replace("to", "/[^/]*$", "/"))
    return views.citations(cited.select("scan_id", F.col("id").alias("cite_id"), text.alias("text")), nodes(spark, d), edges(spark, d))


def agg19_resolution(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("analyzer") == "bandit", "internal").when(F.col("analyzer") == "semgrep", "external").when(F.col("analyzer") == "ruff", "asset").otherwise("unresolved")
    r = _files(spark, d).select("scan_id", F.col("path").alias("src"), F.lit(1).alias("line"), F.lit("import").alias("kind"), fp.folders_of(F.col("path"))[0].alias("specifier"), status.alias("status"))
    r = r.withColumn("src", F.coalesce("specifier", "src"))
    return views.resolution_stats(r, ["scan_id"]).withColumn("coverage", F.round("coverage", 6))


def agg18_summary(spark: SparkSession, d: str) -> DataFrame:
    s = architecture.summary(architecture.runtime(edges(spark, d)))
    return s.select("scan_id", "nodes", "edges", F.round("density", 6).alias("density"))


def agg18_composition(spark: SparkSession, d: str) -> DataFrame:
    return architecture.composition(nodes(spark, d))


def agg18_god_modules(spark: SparkSession, d: str) -> DataFrame:
    metrics = nodes(spark, d).select("scan_id", F.col("path").alias("node"), F.col("definitions").alias("fan_in"), "centrality")
    return architecture.god_modules(nodes(spark, d).drop("centrality"), metrics)


QUERIES = {
    f.__name__: f
    for f in (
        gr01_edges, gr02_runtime_edges, prj19_layers, prj20_entry_points, prj21_module_ids, str18_words, jn19_layer_issues, jn17_orphans,
        gr07_cycle_issues, prj13_issues, arr04_issues_of_module, agg16_view_nodes, jn25_view_edges, str19_view_keys, gr17_opened_views,
        set05_issue_nodes, agg08_external_packages, tk06_most_used_packages, gr18_neighbourhood, tk08_top_modules, gr19_folder_tree,
        jn30_places, jn30_imports, jn18_citations, agg19_resolution, agg18_summary, agg18_composition, agg18_god_modules,
    )
}

_EXT = r"'\.(py|[cm]?[jt]sx?)$'"
_BACK = "MAP {'route':'presentation','routes':'presentation','router':'presentation','routers':'presentation','controller':'presentation','controllers':'presentation','handler':'presentation','handlers':'presentation','endpoint':'presentation','endpoints':'presentation','view':'presentation','views':'presentation','resource':'presentation','resources':'presentation','service':'service','services':'service','usecase':'service','usecases':'service','interactor':'service','interactors':'service','manager':'service','managers':'service','model':'data','models':'data','entity':'data','entities':'data','repository':'data','repositories':'data','repo':'data','repos':'data','dao':'data','daos':'data','db':'data','database':'data','orm':'data'}"
_FRONT = "MAP {'component':'ui','components':'ui','page':'ui','pages':'ui','screen':'ui','screens':'ui','layout':'ui','layouts':'ui','container':'ui','containers':'ui','widget':'ui','widgets':'ui','hook':'hooks','hooks':'hooks','composable':'hooks','composables':'hooks','api':'api','apis':'api','client':'api','clients':'api','query':'api','queries':'api','request':'api','requests':'api','store':'store','stores':'store','state':'store','redux':'store','slice':'store','slices':'store','reducer':'store','reducers':'store','atom':'store','atoms':'store'}"
_LANG = "coalesce((MAP {'py':'python','pyi':'python','ts':'typescript','tsx':'typescript','js':'javascript','jsx':'javascript','go':'go','java':'java','rb':'ruby','rs':'rust'})[regexp_extract(path, '\\.([a-z]+)$', 1)], 'other')"
_WORD = f"list_extract(regexp_extract_all(regexp_replace(s, {_EXT}, ''), '[a-z0-9]+'), -1)"
_TEST = f"(list_has_any(regexp_extract_all(regexp_replace(path, {_EXT}, ''), '[a-z0-9]+'), ['test','tests','spec','specs','e2e','testing','cypress','playwright']) OR regexp_matches(string_split(path, '/')[-1], '(^test_|_test\\.py$|\\.(test|spec)\\.[cm]?[jt]sx?$)'))"


def _layer_sql(frontend: str) -> str:
    """The layer of each segment's last word, deepest first; python reads 'api' its own way."""
    python = f"{_LANG} = 'python'"
    word = f"CASE WHEN NOT {python} AND {frontend} AND {_WORD} IN ('service','services') THEN 'api' WHEN NOT {python} AND {frontend} AND ({_FRONT})[{_WORD}] IS NOT NULL THEN ({_FRONT})[{_WORD}] WHEN {_WORD} IN ('api','apis') AND ({python} OR NOT {frontend}) THEN 'presentation' ELSE ({_BACK})[{_WORD}] END"
    return f"CASE WHEN NOT {_TEST} THEN list_filter(list_transform(list_reverse(string_split(path, '/')), lambda s: {word}), lambda x: x IS NOT NULL)[1] END"


_ENTRY = f"""({_TEST} OR name IN ('__main__.py','__init__.py','manage.py','wsgi.py','asgi.py','setup.py','conftest.py','noxfile.py','fabfile.py','tasks.py') OR starts_with(name, '.')
  OR lower(string_split(name, '.')[1]) IN ('main','index','server','cli','app','worker','celery','run','entry') OR contains(name, '.config.') OR regexp_matches(name, '^(setupTests|vite-env)')
  OR list_has_any(list_slice(string_split(lower(path), '/'), 1, len(string_split(path, '/')) - 1), ['scripts','script','bin','examples','example','docs','docs_src','migrations','versions','benchmarks','bench','stories','fixtures'])
  OR language <> 'python' AND (contains(name, '.stories.') OR string_split(name, '.')[1] IN ('page','layout','route','loading','error','not-found','template','middleware','_app','_document')
    OR list_contains(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), 'pages')))"""
_BASE = f"""p AS MATERIALIZED (SELECT * FROM (SELECT *, {_PATH.format('file_path')} AS path FROM {_F}) WHERE scan_id IS NOT NULL AND path <> ''),
q AS MATERIALIZED (SELECT path, name, language, {_TEST} AS is_test, {_ENTRY} AS is_entry, {_layer_sql('false')} AS layer FROM (SELECT DISTINCT path, string_split(path, '/')[-1] AS name, {_LANG} AS language FROM p)),
n AS MATERIALIZED (SELECT *, path AS module_id, definitions / 64 AS centrality FROM (SELECT scan_id, path, CAST(max(coalesce(end_line, start_line, 0)) AS BIGINT) AS loc, count(*) AS definitions, bool_or(code_snippet IS NULL) AS parse_error FROM p GROUP BY 1, 2) JOIN q USING (path)),
r AS MATERIALIZED (SELECT scan_id, src, dst, line, type_only, lazy FROM (SELECT scan_id, path AS src, lead(path) OVER (PARTITION BY scan_id, rule_id ORDER BY id) AS dst, coalesce(start_line, 0) AS line, analyzer = 'ruff' AS type_only, {_RANK.format('severity')} = 1 AS lazy FROM p) WHERE dst IS NOT NULL),
e AS MATERIALIZED (SELECT scan_id, src, dst, count(*) AS n, bool_and(type_only) AS type_only, coalesce(bool_and(lazy) FILTER (NOT type_only), false) AS lazy, min(line) AS line FROM (SELECT DISTINCT * FROM r WHERE src <> dst) GROUP BY 1, 2, 3)"""
_STACKS = "(MAP {'presentation':'backend','service':'backend','data':'backend','ui':'frontend','hooks':'frontend','api':'frontend','store':'frontend'})"
_LEVELS = "(MAP {'presentation':0,'service':1,'data':2,'ui':0,'hooks':1,'api':2,'store':3})"
# An exemption for what a folder above the module names: the folder of the segment that gave the layer.
_ROOTS = f"""w AS MATERIALIZED (SELECT path, layer, CASE WHEN k > 0 THEN array_to_string(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - k), '/') END AS root FROM
  (SELECT path, layer, list_position(list_transform(list_reverse(string_split(path, '/')), lambda s: CASE WHEN {_WORD} IN ('api', 'apis') THEN 'presentation' ELSE ({_BACK})[{_WORD}] END), layer) - 1 AS k FROM q WHERE layer IS NOT NULL)),
h AS MATERIALIZED (SELECT scan_id, list(DISTINCT layer) AS present FROM n WHERE layer IS NOT NULL GROUP BY 1),
i AS MATERIALIZED (SELECT * FROM (SELECT e.scan_id, src, dst, CASE WHEN d < 0 THEN 'inversion' WHEN d >= 2 AND len(list_filter(present, lambda x: {_STACKS}[x] = {_STACKS}[a.layer] AND {_LEVELS}[x] > {_LEVELS}[a.layer] AND {_LEVELS}[x] < {_LEVELS}[b.layer])) > 0 THEN 'skip' END AS kind
  FROM e JOIN w a ON a.path = src JOIN w b ON b.path = dst JOIN h ON h.scan_id = e.scan_id, LATERAL (SELECT CASE WHEN {_STACKS}[a.layer] = {_STACKS}[b.layer] THEN {_LEVELS}[b.layer] - {_LEVELS}[a.layer] END AS d)
  WHERE NOT type_only AND (b.root IS NULL OR NOT starts_with(src, b.root || '/'))) WHERE kind IS NOT NULL)"""
_CYC = """c AS MATERIALIZED (SELECT a.scan_id, a.src, a.dst, CASE WHEN a.lazy OR b.lazy THEN 'warning' ELSE 'error' END AS severity, substr(sha1('cycle|' || a.src || '|' || a.dst || '|' || a.src || ':' || a.dst || '|' || a.dst || ':' || a.src), 1, 16) AS issue_id
  FROM e a JOIN e b ON a.scan_id = b.scan_id AND a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst)"""
_ISSUES = """u AS MATERIALIZED (SELECT scan_id, issue_id, 'cycle' AS kind, severity, src, dst FROM c
  UNION ALL SELECT scan_id, substr(sha1('layer|' || src || '|' || dst || '|' || src || ':' || dst), 1, 16), 'layer', CASE kind WHEN 'inversion' THEN 'error' ELSE 'warning' END, src, dst FROM i)"""
_FOLDERS = "list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1)"


def _keys_sql(expand: str = "[]", collapse: str = "[]") -> str:
    """A module's folders from the scan's depth on; the first that isn't opened stands for it."""
    return f"""g AS MATERIALIZED (SELECT scan_id, path, {_FOLDERS} AS f FROM n),
    t AS MATERIALIZED (SELECT scan_id, count(*) AS m, max(len(f)) AS most FROM g GROUP BY 1),
    l AS MATERIALIZED (SELECT scan_id, coalesce(max(level) FILTER (keys <= {MOST}), 1) AS depth FROM (SELECT scan_id, level, count(DISTINCT CASE WHEN len(f) > 0 THEN 'd' || array_to_string(f[1:level], '/') ELSE path END) AS keys
      FROM g JOIN t USING (scan_id), range(1, 30) x(level) WHERE level <= greatest(most, 1) AND m > {MOST} GROUP BY 1, 2) GROUP BY 1),
    k AS MATERIALIZED (SELECT scan_id, path, CASE WHEN shut IS NOT NULL THEN 'dir:' || shut WHEN depth IS NULL OR open IS NULL THEN path ELSE 'dir:' || open END AS key FROM (SELECT scan_id, path, depth,
      list_filter(list_transform(range(1, len(f) + 1), lambda y: array_to_string(f[1:y], '/')), lambda z: list_contains({collapse}, z))[1] AS shut,
      list_filter(list_transform(range(least(coalesce(depth, 1), len(f)), len(f) + 1), lambda y: CASE WHEN y > 0 THEN array_to_string(f[1:y], '/') END), lambda z: z IS NOT NULL AND NOT list_contains({expand}, z))[1] AS open FROM g LEFT JOIN l USING (scan_id)))"""


_WITH = f"WITH {_BASE}"
_TOP = _WITH.replace("path AS src, lead(path)", "string_split(path, '/')[1] AS src, lead(string_split(path, '/')[1])")
_VIEW = f"""WITH {_BASE}, {_ROOTS}, {_CYC}, {_ISSUES}, {_keys_sql()},
v AS MATERIALIZED (SELECT e.scan_id, a.key AS src, b.key AS dst, count(*) AS edges, CAST(sum(n) AS BIGINT) AS imports, bool_and(type_only) AS type_only, bool_and(lazy) AS lazy, bool_or(coalesce(cyc, false)) AS in_cycle, bool_or(coalesce(lay, false)) AS violation
  FROM e JOIN k a ON a.scan_id = e.scan_id AND a.path = src JOIN k b ON b.scan_id = e.scan_id AND b.path = dst
  LEFT JOIN (SELECT scan_id, s, d, bool_or(kind = 'cycle') AS cyc, bool_or(kind = 'layer') AS lay FROM (SELECT scan_id, kind, src AS s, dst AS d FROM u UNION ALL SELECT scan_id, kind, dst, src FROM u WHERE kind = 'cycle') GROUP BY 1, 2, 3) y ON y.scan_id = e.scan_id AND y.s = src AND y.d = dst
  WHERE a.key <> b.key GROUP BY 1, 2, 3)"""

ORACLE = {
    "gr01_edges": f"{_WITH} SELECT * FROM e",
    "gr02_runtime_edges": f"{_WITH} SELECT scan_id, src, dst FROM e WHERE NOT type_only",
    "prj19_layers": f"""{_WITH}, f AS (SELECT string_split(path, '/')[1] AS top, bool_or(regexp_matches(path, '\\.[jt]sx$') OR len(list_filter({_FOLDERS}, lambda s: ({_FRONT})[{_WORD}] IN ('ui', 'hooks'))) > 0) AS frontend FROM q GROUP BY 1)
      SELECT path, frontend, {_layer_sql('frontend')} AS layer FROM q JOIN f ON top = string_split(path, '/')[1]""",
    "prj20_entry_points": f"{_WITH} SELECT path, language, is_test, is_entry FROM q",
    "prj21_module_ids": f"""{_WITH}, m AS (SELECT scan_id, path, regexp_replace(regexp_replace(path, '(\\.py|\\.d\\.ts|\\.tsx|\\.ts|\\.mts|\\.cts|\\.jsx|\\.js|\\.mjs|\\.cjs)$', ''), '/+__init__$', '') AS m FROM n)
      SELECT scan_id, path, CASE WHEN count(*) OVER (PARTITION BY scan_id, m) = 1 THEN m ELSE path END AS module_id FROM m""",
    "str18_words": f"{_WITH} SELECT path, array_to_string(flatten(list_transform(string_split(path, '/'), lambda s: regexp_extract_all(regexp_replace(s, {_EXT}, ''), '[a-z0-9]+'))), ' ') AS words FROM q",
    "jn19_layer_issues": f"{_WITH}, {_ROOTS} SELECT * FROM i",
    "jn17_orphans": f"{_WITH} SELECT scan_id, path FROM n WHERE NOT is_entry AND NOT EXISTS (SELECT 1 FROM e WHERE e.scan_id = n.scan_id AND dst = n.path)",
    "gr07_cycle_issues": f"{_TOP}, {_CYC} SELECT scan_id, issue_id, severity, src || '>' || dst AS modules, 2 AS n_edges FROM c",
    "prj13_issues": f"{_WITH}, {_ROOTS}, {_CYC}, {_ISSUES} SELECT scan_id, kind, severity, count(*) AS n FROM u WHERE severity = 'error' GROUP BY 1, 2, 3",
    "arr04_issues_of_module": f"{_WITH}, {_ROOTS}, {_CYC}, {_ISSUES} SELECT scan_id, issue_id, module FROM (SELECT scan_id, issue_id, unnest([src, dst]) AS module FROM u WHERE kind = 'layer') WHERE regexp_matches(module, '^(models|handlers)/')",
    "agg16_view_nodes": f"""{_VIEW}, j AS MATERIALIZED (SELECT n.*, key FROM n JOIN k ON k.scan_id = n.scan_id AND k.path = n.path),
      a AS (SELECT scan_id, key, count(*) AS modules, CAST(sum(loc) AS BIGINT) AS loc, CAST(sum(definitions) AS BIGINT) AS definitions, max(centrality) AS centrality, bool_and(is_test) AS is_test, bool_and(is_entry) AS is_entry, count(*) FILTER (parse_error) AS errors FROM j GROUP BY 1, 2),
      b AS (SELECT scan_id, key, layer FROM (SELECT scan_id, key, layer, sum(greatest(loc, 1)) AS w FROM j WHERE layer IS NOT NULL GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY scan_id, key ORDER BY w DESC, layer) = 1),
      d AS (SELECT scan_id, key, language FROM (SELECT scan_id, key, language, count(*) AS w FROM j GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY scan_id, key ORDER BY w DESC, language) = 1),
      o AS (SELECT scan_id, key, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT scan_id, dst AS key, 1 AS i, 0 AS o FROM v UNION ALL SELECT scan_id, src, 0, 1 FROM v) GROUP BY 1, 2)
      SELECT a.*, layer, language, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM a LEFT JOIN b USING (scan_id, key) LEFT JOIN d USING (scan_id, key) LEFT JOIN o USING (scan_id, key)""",
    "jn25_view_edges": f"{_VIEW} SELECT * FROM v",
    "str19_view_keys": f"""{_WITH}, {_keys_sql("['models', 'handlers']", "['jobs']")} SELECT scan_id, path AS module_id, key FROM k""",
    "set05_issue_nodes": f"""{_VIEW} SELECT u.scan_id, issue_id, CASE WHEN a.key = b.key THEN a.key ELSE a.key || '>' || b.key END AS nodes FROM u JOIN k a ON a.scan_id = u.scan_id AND a.path = src JOIN k b ON b.scan_id = u.scan_id AND b.path = dst""",
    "agg08_external_packages": f"""{_WITH}, x AS (SELECT p.scan_id, rule_id AS package, language, count(DISTINCT p.path) AS importers, count(*) AS imports, min(analyzer) AS resolution FROM p JOIN q USING (path) WHERE rule_id IS NOT NULL GROUP BY 1, 2, 3)
      SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY importers DESC, package, language) <= 100""",
    "tk06_most_used_packages": f"""{_WITH}, x AS (SELECT p.scan_id, rule_id AS package, language, count(DISTINCT p.path) AS importers FROM p JOIN q USING (path) WHERE rule_id IS NOT NULL GROUP BY 1, 2, 3)
      SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY importers DESC, package, language) <= 5""",
    "gr18_neighbourhood": f"""{_WITH} SELECT n.scan_id, module_id, coalesce(importers, '') AS importers, coalesce(imports, '') AS imports FROM n
      LEFT JOIN (SELECT scan_id, dst, string_agg(src, '>' ORDER BY src) AS importers FROM e GROUP BY 1, 2) a ON a.scan_id = n.scan_id AND a.dst = module_id
      LEFT JOIN (SELECT scan_id, src, string_agg(dst, '>' ORDER BY dst) AS imports FROM e GROUP BY 1, 2) b ON b.scan_id = n.scan_id AND b.src = module_id""",
    "tk08_top_modules": f"{_WITH} SELECT scan_id, CAST(place AS INT) AS place, module_id, loc FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY loc DESC, module_id) AS place FROM n WHERE NOT is_test AND loc > 0) WHERE place <= 10",
    "gr19_folder_tree": f"""{_WITH}, x AS (SELECT scan_id, array_to_string(f[1:y], '/') || '/' AS folder, count(*) AS modules, CAST(sum(loc) AS BIGINT) AS loc FROM (SELECT scan_id, loc, {_FOLDERS} AS f FROM n), range(1, 4) z(y) WHERE y <= len(f) GROUP BY 1, 2)
      SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY folder) <= 80""",
    "jn30_places": f"{_WITH} SELECT scan_id, path AS place, false AS is_folder FROM n UNION SELECT scan_id, array_to_string(f[1:y], '/'), true FROM (SELECT scan_id, {_FOLDERS} AS f FROM n), range(1, 30) z(y) WHERE y <= len(f)",
    "jn30_imports": f"{_WITH} SELECT scan_id, src, dst FROM e",
    "jn18_citations": f"""{_WITH}, x AS (SELECT scan_id, id - id % 3 - 1 AS id, min(path) AS o FROM p GROUP BY 1, 2), y AS (SELECT p.scan_id, p.id AS cite_id, path, CASE WHEN contains(o, '/') THEN regexp_replace(o, '/[^/]*$', '') ELSE o END AS o FROM p JOIN x USING (scan_id, id)),
      z AS (SELECT y.*, EXISTS (SELECT 1 FROM n WHERE n.scan_id = y.scan_id AND (n.path = o OR starts_with(n.path, o || '/'))) AS known, EXISTS (SELECT 1 FROM e WHERE e.scan_id = y.scan_id AND src = y.path AND (dst = o OR starts_with(dst, o || '/'))) AS met FROM y)
      SELECT scan_id, cite_id, 1 + known::INT AS valid, 1 - known::INT AS invalid, CASE WHEN NOT known THEN 'not in the graph' WHEN NOT met THEN 'no import' END AS reason FROM z""",
    "agg19_resolution": f"""{_WITH}, x AS (SELECT scan_id, string_split(path, '/')[1] AS src, min(s) AS lo, max(s) AS hi FROM (SELECT *, CASE analyzer WHEN 'bandit' THEN 1 WHEN 'semgrep' THEN 2 WHEN 'ruff' THEN 3 ELSE 4 END AS s FROM p) GROUP BY 1, 2), y AS (SELECT scan_id, CASE WHEN hi = 4 THEN 4 ELSE lo END AS s FROM x)
      SELECT scan_id, count(*) AS total, count(*) FILTER (s = 1) AS internal, count(*) FILTER (s = 2) AS external, count(*) FILTER (s = 3) AS asset, count(*) FILTER (s = 4) AS unresolved, round(1 - count(*) FILTER (s = 4) / count(*), 6) AS coverage FROM y GROUP BY 1""",
    "agg18_summary": f"""{_WITH}, x AS (SELECT scan_id, count(*) AS edges FROM e WHERE NOT type_only GROUP BY 1), y AS (SELECT scan_id, count(DISTINCT m) AS nodes FROM (SELECT scan_id, unnest([src, dst]) AS m FROM e WHERE NOT type_only) GROUP BY 1)
      SELECT scan_id, CAST(nodes AS INT) AS nodes, CAST(edges AS INT) AS edges, round(edges / (nodes * (nodes - 1)), 6) AS density FROM x JOIN y USING (scan_id)""",
    "agg18_composition": f"{_WITH} SELECT scan_id, language, coalesce(layer, 'unlayered') AS layer, count(*) AS modules, CAST(sum(loc) AS BIGINT) AS loc FROM n GROUP BY 1, 2, 3",
    "agg18_god_modules": f"""{_WITH} SELECT scan_id, path, loc, definitions AS fan_in, centrality FROM (SELECT *, count(*) OVER w AS c, greatest(300, quantile_cont(loc, 0.9) OVER w) AS l, greatest(5, quantile_cont(definitions, 0.9) OVER w) AS g, greatest(0.05, quantile_cont(centrality, 0.9) OVER w) AS z
      FROM n WHERE NOT is_test WINDOW w AS (PARTITION BY scan_id)) WHERE c >= 10 AND loc >= l AND definitions >= g AND centrality >= z""",
}
