"""Views of module graphs: modules rolled up to folders within a budget of nodes, neighbourhoods,
external packages, digests, and citations against what the graph has.

Nodes: scan_id, module_id, path and measures. Edges: scan_id, src, dst (module ids), n, type_only, lazy.
Issues: scan_id, issue_id, kind, modules array, edges array of (src, dst). What is chosen depends on all
modules of a scan, which a task holds as (path) only; the roll-up itself is aggregation."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnwork.functions import paths as fp

FOLDER = "dir:"


def cut_at(path: Column, module: Column, depth: Column, expand: Column, collapse: Column) -> Column:
    """The node of a view that stands for a module: the shallowest collapsed folder above it, else the
    folder at `depth`, deeper where folders are expanded, else the module. A null depth shows modules."""
    folders = fp.folders_of(path)
    above = F.transform(F.sequence(F.lit(1), F.size(folders)), lambda k: F.array_join(F.slice(folders, F.lit(1), k), "/"))
    above = F.when(F.size(folders) > 0, above).otherwise(F.array().cast("array<string>"))
    folded = F.get(F.filter(above, lambda f: F.array_contains(collapse, f)), F.lit(0))
    from_depth = F.filter(above, lambda f, k: (k >= F.least(depth, F.size(folders)) - 1) & ~F.array_contains(expand, f))
    # Deeper folders count only as long as all before them are expanded; the first that isn't is the cut.
    cut = F.get(from_depth, F.lit(0))
    return F.when(folded.isNotNull(), F.concat(F.lit(FOLDER), folded)).when(depth.isNull() | cut.isNull(), module).otherwise(F.concat(F.lit(FOLDER), cut))


def _choose(paths: list[str], most: int, expand: set[str], collapse: set[str], greedy: bool) -> tuple[int | None, set[str]]:
    """(depth, folders that are opened): the deepest level with at most `most` nodes, then the largest
    folders one level at a time as long as they fit."""
    folders = [tuple(p.split("/")[:-1]) for p in paths]
    if len(paths) <= most:
        return None, set(expand)
    depth = 1
    for level in range(max(map(len, folders), default=1), 0, -1):
        nodes = {f[:level] if f else p for f, p in zip(folders, paths)}
        if len(nodes) <= most:
            depth = level
            break
    opened = set(expand)

    def node_of(k: int) -> tuple[str, ...] | str:
        f = folders[k]
        for n in range(1, len(f) + 1):
            if "/".join(f[:n]) in collapse:
                return f[:n]
        n = min(depth, len(f))
        while n <= len(f) and n and "/".join(f[:n]) in opened:
            n += 1
        return f[:n] if 0 < n <= len(f) else paths[k]

    groups: dict[tuple[str, ...] | str, list[int]] = defaultdict(list)
    for k in range(len(paths)):
        groups[node_of(k)].append(k)
    if not greedy:
        return depth, opened
    # A folder that doesn't fit never will, as the view only grows; so each is asked once.
    waiting = [(-len(g), "/".join(f), f) for f, g in groups.items() if isinstance(f, tuple) and len(g) > 1]
    heapq.heapify(waiting)
    total = len(groups)
    while waiting:
        _, name, folder = heapq.heappop(waiting)
        if name in collapse:
            continue
        opened.add(name)
        inner: dict[tuple[str, ...] | str, list[int]] = defaultdict(list)
        for k in groups[folder]:
            inner[node_of(k)].append(k)
        if len(inner) < 2 or total - 1 + len(inner) > most:
            opened.discard(name)
            continue
        total += len(inner) - 1
        groups |= inner
        for f, g in inner.items():
            if isinstance(f, tuple) and len(g) > 1:
                heapq.heappush(waiting, (-len(g), "/".join(f), f))
    return depth, opened


def view_keys(nodes: DataFrame, most: int, expand: tuple[str, ...] = (), collapse: tuple[str, ...] = (), greedy: bool = True) -> DataFrame:
    """(scan_id, module_id, key): the view node each module is in, at most `most` a scan where a level
    of folders has so few."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        depth, opened = _choose(sorted(pdf["path"]), most, set(expand), set(collapse), greedy)
        return pd.DataFrame([(pdf["scan_id"].iloc[0], depth, sorted(opened))], columns=["scan_id", "depth", "opened"], dtype=object)

    rows = nodes.select("scan_id", "module_id", "path").where("scan_id is not null and path is not null")
    chosen = rows.select("scan_id", "path").groupBy("scan_id").applyInPandas(choose, "scan_id string, depth int, opened array<string>")
    folded = F.array(*map(F.lit, collapse)).cast("array<string>")
    key = cut_at(F.col("path"), F.col("module_id"), F.col("depth"), F.col("opened"), folded)
    return rows.join(chosen, "scan_id").select("scan_id", "module_id", key.alias("key"))


def view_edges(keys: DataFrame, edges: DataFrame, issues: DataFrame) -> DataFrame:
    """(scan_id, src, dst, edges, imports, type_only, lazy, in_cycle, violation) between view nodes."""
    marked = issues.select("scan_id", "kind", F.explode("edges").alias("e")).groupBy("scan_id", "e.src", "e.dst").agg(
        F.bool_or(F.col("kind") == "cycle").alias("in_cycle"), F.bool_or(F.col("kind") == "layer").alias("violation")
    )
    ends = {end: keys.select("scan_id", F.col("module_id").alias(end), F.col("key").alias(f"{end}_key")) for end in ("src", "dst")}
    both = edges.join(ends["src"], ["scan_id", "src"]).join(ends["dst"], ["scan_id", "dst"]).where("src_key <> dst_key")
    both = both.join(marked, ["scan_id", "src", "dst"], "left")
    return both.groupBy("scan_id", F.col("src_key").alias("src"), F.col("dst_key").alias("dst")).agg(
        F.count(F.lit(1)).alias("edges"),
        F.sum("n").alias("imports"),
        F.bool_and("type_only").alias("type_only"),
        F.bool_and("lazy").alias("lazy"),
        F.coalesce(F.bool_or("in_cycle"), F.lit(False)).alias("in_cycle"),
        F.coalesce(F.bool_or("violation"), F.lit(False)).alias("violation"),
    )


def view_nodes(keys: DataFrame, nodes: DataFrame, edges_of_view: DataFrame) -> DataFrame:
    """(scan_id, key, modules, loc, definitions, centrality, layer, language, is_test, is_entry, errors,
    fan_in, fan_out): measures of a view node; layer and language are those of most lines and most modules,
    the smallest name among equals."""
    rows = keys.join(nodes.drop("path"), ["scan_id", "module_id"])
    whole = rows.groupBy("scan_id", "key").agg(
        F.count(F.lit(1)).alias("modules"),
        F.sum("loc").alias("loc"),
        F.sum("definitions").alias("definitions"),
        F.max("centrality").alias("centrality"),
        F.bool_and("is_test").alias("is_test"),
        F.bool_and("is_entry").alias("is_entry"),
        F.count_if("parse_error").alias("errors"),
    )

    def most(name: str, weight: Column) -> DataFrame:
        each = rows.where(F.col(name).isNotNull()).groupBy("scan_id", "key", name).agg(F.sum(weight).alias("w"))
        first = F.min(F.struct(-F.col("w"), F.col(name).alias("v")))
        return each.groupBy("scan_id", "key").agg(first["v"].alias(name))

    for name, weight in (("layer", F.greatest("loc", F.lit(1))), ("language", F.lit(1))):
        whole = whole.join(most(name, weight), ["scan_id", "key"], "left")
    ends = F.explode(F.array(F.struct(F.col("dst").alias("key"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("key"), F.lit(0).alias("i"), F.lit(1).alias("o"))))
    fans = edges_of_view.select("scan_id", ends.alias("e")).groupBy("scan_id", "e.key").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    return whole.join(fans, ["scan_id", "key"], "left").fillna(0, ["fan_in", "fan_out"])


def issue_nodes(keys: DataFrame, issues: DataFrame) -> DataFrame:
    """(scan_id, issue_id, nodes): the view nodes of an issue's modules, each once, in the modules' order."""
    each = issues.select("scan_id", "issue_id", F.posexplode("modules").alias("k", "module_id")).join(keys, ["scan_id", "module_id"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "key"))), lambda x: x["key"])
    return each.groupBy("scan_id", "issue_id").agg(F.array_distinct(ordered).alias("nodes"))


def external_packages(edges: DataFrame, nodes: DataFrame, most: int = 100) -> DataFrame:
    """(scan_id, package, language, importers, imports, resolution): packages outside, those that
    most modules import first, `most` of them a scan."""
    known = nodes.select("scan_id", F.col("module_id").alias("src"), "language")
    rolled = edges.join(known, ["scan_id", "src"]).groupBy("scan_id", F.col("dst").alias("package"), "language").agg(
        F.count_distinct("src").alias("importers"), F.sum("n").alias("imports"), F.min("resolution").alias("resolution")
    )
    order = Window.partitionBy("scan_id").orderBy(F.desc("importers"), "package", "language")
    return rolled.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def neighbourhood(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """(scan_id, module_id, importers, imports): sorted neighbours of the asked (scan_id, module_id)."""
    asked = modules.select("scan_id", "module_id").distinct()
    into = edges.join(asked.withColumnRenamed("module_id", "dst"), ["scan_id", "dst"], "left_semi").groupBy("scan_id", F.col("dst").alias("module_id")).agg(F.array_sort(F.collect_set("src")).alias("importers"))
    out = edges.join(asked.withColumnRenamed("module_id", "src"), ["scan_id", "src"], "left_semi").groupBy("scan_id", F.col("src").alias("module_id")).agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    none = F.array().cast("array<string>")
    both = asked.join(into, ["scan_id", "module_id"], "left").join(out, ["scan_id", "module_id"], "left")
    return both.withColumns({c: F.coalesce(c, none) for c in ("importers", "imports")})


def issues_of(issues: DataFrame, kinds: tuple[str, ...] = (), severities: tuple[str, ...] = (), module: str | None = None) -> DataFrame:
    """Issues of the kinds and severities, if any are named, and that involve the module."""
    out = issues
    for name, wanted in (("kind", kinds), ("severity", severities)):
        out = out.where(F.col(name).isin(*wanted)) if wanted else out
    return out.where(F.array_contains("modules", module)) if module is not None else out


def around(cycle: Column) -> Column:
    """The edges of a cycle as (src, dst), the last back to the first."""
    turned = F.concat(F.slice(cycle, F.lit(2), F.greatest(F.size(cycle) - 1, F.lit(0))), F.slice(cycle, 1, 1))
    return F.zip_with(cycle, turned, lambda a, b: F.struct(a.alias("src"), b.alias("dst")))


def issue_key(kind: Column, modules: Column, edges: Column) -> Column:
    """A stable identity of kind, modules and edges."""
    pairs = F.transform(edges, lambda e: F.concat(e["src"], F.lit(":"), e["dst"]))
    return F.substring(F.sha1(F.array_join(F.concat(F.array(kind), modules, pairs), "|").cast("binary")), 1, 16)


def cycle_issues(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """(scan_id, issue_id, kind, severity, modules, edges): a cycle that imports inside functions
    interrupt is a warning, any other an error."""
    each = cycles.select("scan_id", F.col("cycle").alias("modules"), around(F.col("cycle")).alias("edges"))
    each = each.withColumn("issue_id", issue_key(F.lit("cycle"), F.col("modules"), F.col("edges")))
    steps = each.select("scan_id", "issue_id", F.explode("edges").alias("e")).select("scan_id", "issue_id", "e.*")
    lazy = steps.join(edges.select("scan_id", "src", "dst", "lazy"), ["scan_id", "src", "dst"]).groupBy("scan_id", "issue_id").agg(F.bool_or("lazy").alias("lazy"))
    out = each.join(lazy, ["scan_id", "issue_id"])
    return out.select("scan_id", "issue_id", F.lit("cycle").alias("kind"), F.when(F.col("lazy"), "warning").otherwise("error").alias("severity"), "modules", "edges")


def top_modules(nodes: DataFrame, measure: str, most: int = 10) -> DataFrame:
    """The modules with the most of a measure, without tests and those that have none of it."""
    order = Window.partitionBy("scan_id").orderBy(F.desc(measure), "module_id")
    ranked = nodes.where(~F.col("is_test") & (F.col(measure) > 0)).withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= most).select("scan_id", "place", "module_id", measure)


def folder_tree(nodes: DataFrame, deepest: int = 3, most: int = 80) -> DataFrame:
    """(scan_id, folder, modules, loc) of folders up to three deep, the first `most` a scan by name."""
    folders = fp.folders_of(F.col("path"))
    levels = F.filter(F.sequence(F.lit(1), F.lit(deepest)), lambda k: k <= F.size(folders))
    named = F.transform(levels, lambda k: F.concat(F.array_join(F.slice(folders, F.lit(1), k), "/"), F.lit("/")))
    tree = nodes.select("scan_id", "loc", F.explode(named).alias("folder")).groupBy("scan_id", "folder").agg(F.count(F.lit(1)).alias("modules"), F.sum("loc").alias("loc"))
    order = Window.partitionBy("scan_id").orderBy("folder")
    return tree.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def facts(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((scan_id, place, is_folder), (scan_id, src, dst)): every module path and folder above one, and
    imports as paths."""
    folders = fp.folders_of(F.col("path"))
    above = F.when(F.size(folders) > 0, F.transform(F.sequence(F.lit(1), F.size(folders)), lambda k: F.array_join(F.slice(folders, F.lit(1), k), "/")))
    modules = nodes.select("scan_id", F.col("path").alias("place"), F.lit(False).alias("is_folder"))
    places = modules.unionByName(nodes.select("scan_id", F.explode(above).alias("place"), F.lit(True).alias("is_folder"))).distinct()
    ends = {end: nodes.select("scan_id", F.col("module_id").alias(end), F.col("path").alias(f"{end}_path")) for end in ("src", "dst")}
    imports = edges.join(ends["src"], ["scan_id", "src"]).join(ends["dst"], ["scan_id", "dst"])
    return places, imports.select("scan_id", F.col("src_path").alias("src"), F.col("dst_path").alias("dst")).distinct()


def citations(cited: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scan_id, cite_id, valid, invalid, reason) of texts 'a -> b -> c': every side must be a module or
    a folder, every step an import from or below the one to or below the other.

    Folders meet imports on the folders above an import's ends, so no citation meets every import."""
    text = F.regexp_replace(F.col("text"), r"^[\s`'\"]+|[\s`'\"]+$", "")
    sides = F.filter(F.split(text, r"\s*(?:->|→|=>)\s*"), lambda s: F.trim(s) != "")

    def clean(s: Column) -> Column:
        s = F.regexp_replace(F.regexp_replace(s, r"^[\s`'\"]+|[\s`'\"]+$", ""), r"\s+\(.*\)$", "")
        return F.regexp_replace(F.regexp_replace(s, r":\d+$", ""), r"^[\s`'\"]*(?:\./)?|[\s`'\"/]+$", "")

    places, imports = facts(nodes, edges)
    rows = cited.select("scan_id", "cite_id", F.transform(sides, clean).alias("sides"))
    each = rows.select("scan_id", "cite_id", F.posexplode_outer("sides").alias("k", "place"))
    known = places.groupBy("scan_id", "place").agg(F.min("is_folder").alias("is_folder"))
    met = each.join(known, ["scan_id", "place"], "left")
    counts = met.groupBy("scan_id", "cite_id").agg(F.count_if(F.col("is_folder").isNotNull()).alias("valid"), F.count_if(F.col("place").isNotNull() & F.col("is_folder").isNull()).alias("invalid"))
    above = lambda c: F.concat(F.array(F.col(c)), F.transform(F.sequence(F.lit(1), F.size(fp.folders_of(F.col(c)))), lambda k: F.array_join(F.slice(fp.folders_of(F.col(c)), F.lit(1), k), "/")))
    reach = lambda c: F.when(F.size(fp.folders_of(F.col(c))) > 0, above(c)).otherwise(F.array(F.col(c)))
    steps = met.alias("a").join(met.alias("b"), (F.col("a.scan_id") == F.col("b.scan_id")) & (F.col("a.cite_id") == F.col("b.cite_id")) & (F.col("a.k") + 1 == F.col("b.k")))
    steps = steps.where("a.is_folder is not null and b.is_folder is not null").select("a.scan_id", "a.cite_id", "a.k", F.col("a.place").alias("src"), F.col("b.place").alias("dst"))
    wanted = steps.select("scan_id", "src", "dst").distinct()
    there = imports.select("scan_id", F.explode(reach("src")).alias("src"), "dst").select("scan_id", "src", F.explode(reach("dst")).alias("dst"))
    broken = steps.join(wanted.join(there.distinct(), ["scan_id", "src", "dst"], "left_semi"), ["scan_id", "src", "dst"], "left_anti")
    broken = broken.groupBy("scan_id", "cite_id").agg(F.min("k").alias("broken"))
    reason = F.when(F.col("valid") + F.col("invalid") == 0, "empty").when(F.col("invalid") > 0, "not in the graph").when(F.col("broken").isNotNull(), "no import")
    return counts.join(broken, ["scan_id", "cite_id"], "left").select("scan_id", "cite_id", "valid", "invalid", reason.alias("reason"))


STATUSES = ("internal", "external", "asset", "unresolved")


def resolution_stats(resolved: DataFrame, by: list[str]) -> DataFrame:
    """Import statements by what they resolve to; one with several targets counts once, as unresolved
    if one of them is, else as the first status in order. coverage is the share that isn't unresolved."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    each = resolved.groupBy(*by, "src", "line", "kind", "specifier").agg(F.min(rank).alias("least"), F.max(rank).alias("most"))
    last = len(STATUSES)
    status = F.when(F.col("most") == last, last).otherwise(F.col("least"))
    counts = [F.count_if(status == k).alias(name) for k, name in enumerate(STATUSES, 1)]
    out = each.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts)
    return out.withColumn("coverage", (F.col("total") - F.col("unresolved")) / F.col("total"))


def module_ids(nodes: DataFrame) -> DataFrame:
    """(scan_id, path, module_id): paths that would get one identity keep themselves."""
    named = nodes.select("scan_id", "path", fp.module_id(F.col("path")).alias("m")).distinct()
    shared = named.groupBy("scan_id", "m").agg(F.count(F.lit(1)).alias("n"))
    out = named.join(shared, ["scan_id", "m"])
    return out.select("scan_id", "path", F.when(F.col("n") == 1, F.col("m")).otherwise(F.col("path")).alias("module_id"))
