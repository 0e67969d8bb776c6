"""Duplicate findings into one, findings of two scans against each other, line ranges into one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnwork.functions import findings as fn

WIDEST = 5  # fixed value: a range that spans more lines contains no other finding


def anchors(rows: DataFrame) -> DataFrame:
    """(scan_id, id, anchor_id): the finding each finding is merged into the group of.

    Within a file and kind, findings in order of line and id join the first group whose first
    finding starts on the same line or contains, or is contained in, a short range. The rule
    isn't transitive, so groups are found in one pass over sorted rows; batches stream, and only
    the anchors that a later row can still meet are held, however long the bucket is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket, live = None, []
        for batch in batches:
            out = []
            for scan, path, kind, start, end, key in zip(
                batch.scan_id, batch.path, batch.kind, batch.start_line, batch.end_line, batch.id
            ):
                if (scan, path, kind) != bucket:
                    bucket, live = (scan, path, kind), []
                live = [a for a in live if a[0] == start or (a[1] - a[0] <= WIDEST and a[1] >= start)]
                anchor = live[0] if live else (start, end, key)
                if not live:
                    live.append(anchor)
                out.append((scan, key, anchor[2]))
            yield pd.DataFrame(out, columns=["scan_id", "id", "anchor_id"])

    keyed = rows.select(
        "scan_id",
        fn.plain_path(F.col("file_path")).alias("path"),
        F.coalesce("category", F.concat_ws(":", F.lit("rule"), "analyzer", "rule_id")).alias("kind"),
        "start_line",
        F.coalesce("end_line", "start_line").alias("end_line"),
        "id",
    ).where("scan_id is not null and path is not null and start_line is not null and id is not null")
    bucket = ["scan_id", "path", "kind"]
    counted = keyed.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*bucket)))
    alone = counted.where("_n = 1").select("scan_id", "id", F.col("id").alias("anchor_id"))  # most findings
    together = counted.where("_n > 1").drop("_n").repartition(*bucket).sortWithinPartitions(*bucket, "start_line", "id")
    return alone.unionByName(together.mapInPandas(run, "scan_id string, id bigint, anchor_id bigint"))


def merged(rows: DataFrame) -> DataFrame:
    """One row per group: the richest finding, the highest severity, all reporters and numbers."""
    grouped = rows.join(anchors(rows), ["scan_id", "id"])
    rank = fn.severity_rank(F.col("severity"))
    rich = F.struct(F.length(F.trim("message")), rank, F.col("code_snippet").isNotNull().cast("int"), -F.col("id"))
    out = grouped.groupBy("scan_id", "anchor_id").agg(
        F.max_by("id", rich).alias("id"),
        F.max_by("analyzer", rich).alias("analyzer"),
        fn.rank_severity(F.max(rank)).alias("severity"),
        F.collect_set("analyzer").alias("reporters"),
        F.count(F.lit(1)).alias("n_merged"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("cwe_ids")))).alias("cwe_ids"),
    )
    others = F.array_sort(F.array_except("reporters", F.array("analyzer")))
    return out.select("scan_id", "anchor_id", "id", "analyzer", "severity", "n_merged", others.alias("corroborated_by"), "cwe_ids")


def compared(base: DataFrame, head: DataFrame, by: list[str]) -> DataFrame:
    """Bag comparison: n equal findings of one side meet n of the other. Adds place to `by` and
    'new', 'resolved' or 'unchanged'. The n-th copy meets the n-th, so hot identities stay apart."""

    def numbered(df: DataFrame, side: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("id")
        return df.select(*by, F.col("id").alias(side), F.row_number().over(order).alias("copy"))

    both = numbered(base, "base_id").join(numbered(head, "head_id"), [*by, "copy"], "full")
    outcome = F.when(F.col("base_id").isNull(), "new").when(F.col("head_id").isNull(), "resolved").otherwise("unchanged")
    return both.withColumn("outcome", outcome)


def islands(ranges: DataFrame, by: list[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """Ranges that overlap or are at most `gap` apart become one: (by, start, end, n_ranges)."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    numbered = ranges.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(order))
    return (
        numbered.groupBy(*by, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_ranges"))
        .drop("_island")
    )
