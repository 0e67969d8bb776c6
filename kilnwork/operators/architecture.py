"""Module graphs of all scans: aggregated edges, layers, cycles, centrality, depth, issues.

Nodes: scan_id, path, loc, is_test, is_entrypoint, error. References: scan_id, src, dst, line,
type_only, lazy. Relations between modules are joins; what needs a whole graph at once (cycles,
centrality, depth) runs per scan, whose modules a task holds."""

from __future__ import annotations

import random
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnwork.functions import paths as fp
from kilnwork.operators.graph import _strong, degrees

# Layers from the top of each stack, and the words that name them.
LAYERS = {
    ("backend", "presentation"): "route routes router routers controller controllers handler handlers endpoint endpoints view views resource resources",
    ("backend", "service"): "service services usecase usecases interactor interactors manager managers",
    ("backend", "data"): "model models entity entities repository repositories repo repos dao daos db database orm",
    ("frontend", "ui"): "component components page pages screen screens layout layouts container containers widget widgets",
    ("frontend", "hooks"): "hook hooks composable composables",
    ("frontend", "api"): "api apis client clients query queries request requests",
    ("frontend", "store"): "store stores state redux slice slices reducer reducers atom atoms",
}
ORDER = {"presentation": 0, "service": 1, "data": 2, "ui": 0, "hooks": 1, "api": 2, "store": 3}
LONGEST, MOST, CEILING, SAMPLE_FROM, SAMPLE = 10, 100, 10_000, 1000, 500
GOD_NODES, GOD_LOC, GOD_FAN_IN, GOD_CENTRALITY = 10, 300, 5, 0.05


def edges_of(references: DataFrame) -> DataFrame:
    """One edge per pair: how many distinct references, type_only if all are, lazy if all at run
    time are and there is one, and the first line."""
    refs = references.where("src <> dst").select("scan_id", "src", "dst", "line", "type_only", "lazy").distinct()
    run = ~F.col("type_only")
    return refs.groupBy("scan_id", "src", "dst").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and("type_only").alias("type_only"),
        F.coalesce(F.bool_and(F.when(run, F.col("lazy"))), F.lit(False)).alias("lazy"),
        F.min("line").alias("line"),
    )


def runtime(edges: DataFrame) -> DataFrame:
    """What is loaded when the program runs: edges that aren't for types only."""
    return edges.where("not type_only")


def composition(nodes: DataFrame) -> DataFrame:
    """(scan_id, language, layer, modules, loc)."""
    by = ["scan_id", "language", F.coalesce("layer", F.lit("unlayered")).alias("layer")]
    return nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("modules"), F.sum("loc").alias("loc"))


def _words_of(stack: str) -> Column:
    pairs = [x for (of, layer), words in LAYERS.items() if of == stack for w in words.split() for x in (F.lit(w), F.lit(layer))]
    return F.create_map(*pairs)


def is_frontend(path: Column) -> Column:
    """Whether a path suggests that its project draws an interface."""
    last = F.transform(fp.folders_of(path), lambda s: F.try_element_at(fp.words_of(s), F.lit(-1)))
    named = F.exists(last, lambda w: F.coalesce(F.try_element_at(_words_of("frontend"), w).isin("ui", "hooks"), F.lit(False)))
    return path.rlike(r"\.[jt]sx$") | named


def layer_at(path: Column, language: Column | None = None, frontend: Column | None = None) -> Column:
    """(layer, k): the layer named by the last word of the deepest folder or file that names one, k parts from the
    end; null for tests and where none does. frontend: whether the module's project is one, which decides what words mean."""
    language = fp.language_of(path) if language is None else language
    frontend = F.lit(False) if frontend is None else frontend
    back, front = _words_of("backend"), _words_of("frontend")
    python, stem = language == "python", F.substring_index(fp.name_of(path), ".", 1)

    def layer(word: Column, k: Column) -> Column:
        api = word.isin("api", "apis")
        return (
            F.when(~python & (k == 0) & stem.rlike("^use[A-Z0-9]"), "hooks")
            .when(~python & frontend & word.isin("service", "services"), "api")
            .when(~python & frontend & F.try_element_at(front, word).isNotNull(), F.try_element_at(front, word))
            .when(api & (python | ~frontend), "presentation")
            .otherwise(F.try_element_at(back, word))
        )

    # Words first, so that each segment is read once.
    words = F.transform(F.reverse(F.split(path, "/")), lambda s: F.try_element_at(fp.words_of(s), F.lit(-1)))
    named = F.transform(words, lambda w, k: F.struct(layer(w, k).alias("layer"), k.alias("k")))
    return F.when(~fp.is_test(path), F.get(F.filter(named, lambda x: x["layer"].isNotNull()), F.lit(0)))


def layer_of(path: Column, language: Column | None = None, frontend: Column | None = None) -> Column:
    """The layer of layer_at."""
    return layer_at(path, language, frontend)["layer"]


def layer_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scan_id, src, dst, kind): lower layers that import higher ones of their stack, and imports that
    skip a layer the scan has. Tests are left out, and imports of what a folder above the module names."""
    at = layer_at(F.col("path"))
    parts = F.split("path", "/")
    root = F.when(F.col("at.k") > 0, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - F.col("at.k")), "/"))
    layered = nodes.where("not is_test").withColumn("at", at).where("at is not null")
    layered = layered.select("scan_id", "path", F.col("at.layer").alias("layer"), root.alias("root"))
    present = layered.groupBy("scan_id").agg(F.collect_set("layer").alias("present"))
    rank = F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv])
    stack = F.create_map(*[F.lit(x) for of, layer in LAYERS for x in (layer, of)])
    both = (
        edges.where("not type_only")
        .join(layered.select("scan_id", F.col("path").alias("src"), F.col("layer").alias("a")), ["scan_id", "src"])
        .join(layered.select("scan_id", F.col("path").alias("dst"), F.col("layer").alias("b"), "root"), ["scan_id", "dst"])
        .join(present, "scan_id")
        .where("root is null or not startswith(src, root || '/')")
    )
    a, b = F.col("a"), F.col("b")
    down = F.when(stack[a] == stack[b], rank[b] - rank[a])
    passed = F.exists("present", lambda x: (stack[x] == stack[a]) & (rank[x] > rank[a]) & (rank[x] < rank[b]))
    kind = F.when(down < 0, "inversion").when((down >= 2) & passed, "skip")
    return both.select("scan_id", "src", "dst", kind.alias("kind")).where("kind is not null")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules that nothing imports, that parse and aren't where something starts."""
    used = edges.select("scan_id", F.col("dst").alias("path")).distinct()
    return nodes.where("not is_entrypoint and error is null").join(used, ["scan_id", "path"], "left_anti").select("scan_id", "path")


def _after(pdf: pd.DataFrame) -> dict[str, list[str]]:
    after: dict[str, list[str]] = {}
    for a, b in sorted(set(zip(pdf.src, pdf.dst))):
        if a != b:
            after.setdefault(a, []).append(b)
            after.setdefault(b, [])
    return after


def simple_cycles(after: dict[str, list[str]], longest: int = LONGEST, ceiling: int = CEILING) -> tuple[list[list[str]], bool]:
    """(cycles, truncated): each once, from its smallest module, within its strong component."""
    label = _strong([(a, b) for a, bs in after.items() for b in bs])
    found: list[list[str]] = []
    for start in sorted(after):
        if label.get(start, (start, 1))[1] < 2:
            continue
        stack = [(start, iter(after[start]))]
        path = [start]
        while stack:
            step = next(stack[-1][1], None)
            if step is None:
                stack.pop()
                path.pop()
            elif step == start and len(path) > 1:
                found.append(list(path))
                if len(found) >= ceiling:
                    return found, True
            elif step > start and step not in path and len(path) < longest and label[step][0] == label[start][0]:
                path.append(step)
                stack.append((step, iter(after[step])))
    return found, False


def cycles(edges: DataFrame) -> DataFrame:
    """(scan_id, cycle, truncated): the 100 shortest of at most 10 modules, in canonical form."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        found, truncated = simple_cycles(_after(pdf))
        found.sort(key=lambda c: (len(c), c))
        rows = [(pdf.scan_id.iloc[0], c, truncated or len(found) > MOST) for c in found[:MOST]]
        return pd.DataFrame(rows, columns=["scan_id", "cycle", "truncated"], dtype=object)

    runtime = edges.where("not type_only").select("scan_id", "src", "dst")
    return runtime.groupBy("scan_id").applyInPandas(solve, "scan_id string, cycle array<string>, truncated boolean")


def betweenness(after: dict[str, list[str]], seed: int = 0) -> dict[str, float]:
    """Shares of shortest paths through each module, normalised; from sampled sources in large graphs."""
    nodes = sorted(after)
    n = len(nodes)
    total = dict.fromkeys(nodes, 0.0)
    if n < 3:
        return total
    sources = nodes if n <= SAMPLE_FROM else random.Random(seed).sample(nodes, SAMPLE)
    for s in sources:
        order, before = [], {v: [] for v in nodes}
        paths, far = dict.fromkeys(nodes, 0), {s: 0}
        paths[s] = 1
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in after[v]:
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    scale = n / len(sources) / ((n - 1) * (n - 2))
    return {v: round(t * scale, 6) for v, t in total.items()}


def longest_chain(after: dict[str, list[str]]) -> int:
    """Edges on the longest path once every cycle is one node."""
    label = {v: c for v, (c, _) in _strong([(a, b) for a, bs in after.items() for b in bs]).items()}
    merged: dict[str, set[str]] = {c: set() for c in label.values()}
    for a, bs in after.items():
        merged[label.get(a, a)] = merged.get(label.get(a, a), set()) | {label[b] for b in bs if label[b] != label[a]}
    waiting = dict.fromkeys(merged, 0)
    for bs in merged.values():
        for b in bs:
            waiting[b] += 1
    depth, queue = dict.fromkeys(merged, 0), deque(v for v, k in waiting.items() if not k)
    while queue:
        v = queue.popleft()
        for w in merged[v]:
            depth[w] = max(depth[w], depth[v] + 1)
            waiting[w] -= 1
            if not waiting[w]:
                queue.append(w)
    return max(depth.values(), default=0)


def node_metrics(edges: DataFrame) -> DataFrame:
    """(scan_id, node, fan_in, fan_out, instability, centrality) of modules with an edge."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(pdf.scan_id.iloc[0], v, c) for v, c in betweenness(_after(pdf)).items()]
        return pd.DataFrame(rows, columns=["scan_id", "node", "centrality"])

    e = edges.select("scan_id", "src", "dst")
    keyed = e.select(F.struct("scan_id", F.col("src").alias("m")).alias("src"), F.struct("scan_id", F.col("dst").alias("m")).alias("dst"))
    d = degrees(keyed).select("node.scan_id", F.col("node.m").alias("node"), "fan_in", "fan_out", "instability")
    return d.join(e.groupBy("scan_id").applyInPandas(solve, "scan_id string, node string, centrality double"), ["scan_id", "node"], "left")


def summary(edges: DataFrame) -> DataFrame:
    """(scan_id, nodes, edges, density, depth)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        after = _after(pdf)
        n, m = len(after), sum(map(len, after.values()))
        return pd.DataFrame([(pdf.scan_id.iloc[0], n, m, m / (n * (n - 1)) if n > 1 else 0.0, longest_chain(after))], columns=["scan_id", "nodes", "edges", "density", "depth"])

    return edges.select("scan_id", "src", "dst").groupBy("scan_id").applyInPandas(solve, "scan_id string, nodes int, edges int, density double, depth int")


def god_modules(nodes: DataFrame, metrics: DataFrame) -> DataFrame:
    """Modules large, much imported and central, each beyond a floor and the scan's 90th percentile."""
    rows = nodes.where("not is_test").join(metrics.withColumnRenamed("node", "path"), ["scan_id", "path"], "left")
    rows = rows.fillna(0, ["fan_in", "centrality"])
    scan = Window.partitionBy("scan_id")
    p = lambda c, least: F.greatest(F.lit(float(least)), F.percentile(c, 0.9).over(scan))
    marked = rows.withColumns(
        {"_n": F.count(F.lit(1)).over(scan), "_l": p("loc", GOD_LOC), "_f": p("fan_in", GOD_FAN_IN), "_c": p("centrality", GOD_CENTRALITY)}
    )
    keep = (F.col("_n") >= GOD_NODES) & (F.col("loc") >= F.col("_l")) & (F.col("fan_in") >= F.col("_f")) & (F.col("centrality") >= F.col("_c"))
    return marked.where(keep).select("scan_id", "path", "loc", "fan_in", "centrality")
