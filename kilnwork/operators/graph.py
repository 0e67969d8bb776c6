"""Graphs as edge tables (src, dst)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.runtime import discard, small_enough, written


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out, instability) over distinct edges without loops; instability is null
    for a node without edges, which isn't in the table."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    out = ends.groupBy("e.node").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))
    return out.withColumn("instability", F.round(F.col("fan_out") / (F.col("fan_in") + F.col("fan_out")), 4))


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The components of edges that a task holds, by joining trees at their smaller root."""
    root: dict = {}

    def top(x: object) -> object:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.src, batch.dst):
            a, b = top(a), top(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pd.DataFrame({"node": nodes, "component": [top(x) for x in nodes]})


def components(edges: DataFrame, most_in_task: int = 500_000) -> DataFrame:
    """(node, component): the smallest node each node is connected with. Up to most_in_task edges are
    joined in one task, more by rounds over all executors, with the same result.

    Every round a node takes the least of its label's own label and its neighbours' labels' own
    labels, and the node that is its label takes that of its neighbours too (FastSV), so whole
    regions are hooked onto smaller ones and labels jump along chains. Rounds go on until no label
    changes: labels only fall, so they end, and then all ends of edges agree. Hubs are
    pre-aggregated by the partial minimum."""
    spark = edges.sparkSession
    both = edges.select("src", "dst").where("src is not null and dst is not null")
    if small_enough(both, most_in_task):
        kind = dict(both.dtypes)["src"]
        return both.repartition(1).mapInPandas(_joined, f"node {kind}, component {kind}")
    both, at_edges = written(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels, at = written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.min("src")).alias("component")))
    while True:
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped, at_jumped = written(labels.join(up, "component").select("node", "component", "up"))
        near = both.join(jumped.select(F.col("node").alias("dst"), "up"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("up").alias("near"))
        step = jumped.join(near, "node")
        own = F.struct("node", F.least("up", "near").alias("label"), F.col("component").alias("old"))
        hook = F.struct(F.col("component").alias("node"), F.col("near").alias("label"), F.lit(None).cast(dict(labels.dtypes)["component"]).alias("old"))
        taken = step.select(F.explode(F.array(own, hook)).alias("t")).groupBy("t.node").agg(F.min("t.label").alias("component"), F.max("t.old").alias("old"))
        new, new_at = written(taken)
        changed = new.where("old <> component").limit(1).count()
        discard(spark, at)
        discard(spark, at_jumped)
        labels, at = new.select("node", "component"), new_at
        if not changed:
            break
    discard(spark, at_edges)
    return labels


def _strong(group: list[tuple]) -> dict:
    """Strongly connected components of one graph, without recursion."""
    after: dict = {}
    for a, b in group:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    index, low, on, stack, label = {}, {}, set(), [], {}
    for root in after:
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            step = next((x for x in rest if x not in index or x in on), None)
            if step is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        members.append(x)
                        if x == node:
                            break
                    least = min(members)
                    label.update(dict.fromkeys(members, (least, len(members))))
            elif step not in index:
                index[step] = low[step] = len(index)
                stack.append(step)
                on.add(step)
                work.append((step, iter(after[step])))
            else:
                low[node] = min(low[node], index[step])
    return label


def strong_components(edges: DataFrame, graph: str, kind: str = "string") -> DataFrame:
    """(graph, node, component, size) of every graph; a graph is the modules of one scan, which a
    task holds. For one graph of any size use components() to split it first."""
    graph_kind = dict(edges.dtypes)[graph]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        label = _strong(list(zip(pdf.src, pdf.dst)))
        rows = [(pdf[graph].iloc[0], n, c, s) for n, (c, s) in label.items()]
        return pd.DataFrame(rows, columns=[graph, "node", "component", "size"])

    e = edges.select(graph, "src", "dst").where("src is not null and dst is not null").distinct()
    return e.groupBy(graph).applyInPandas(solve, f"{graph} {graph_kind}, node {kind}, component {kind}, size int")


def prefixes(paths: DataFrame, by: list[str], path: str) -> DataFrame:
    """Adds (depth, directory): every directory above a path, once per path."""
    parts = F.split(path, "/")
    out = paths.withColumn("_parts", parts).withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("_parts") - 1)))
    return out.withColumn("directory", F.concat_ws("/", F.slice("_parts", F.lit(1), F.col("depth")))).drop("_parts")


def depth_for(paths: DataFrame, by: list[str], path: str, most: int) -> DataFrame:
    """(by, depth): the deepest level that has at most `most` directories, null if none has."""
    n = prefixes(paths, by, path).where("depth > 0").groupBy(*by, "depth").agg(F.count_distinct("directory").alias("n"))
    return n.groupBy(*by).agg(F.max(F.when(F.col("n") <= most, F.col("depth"))).alias("depth"))
