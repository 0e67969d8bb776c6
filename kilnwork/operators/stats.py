"""Ranks, concentration, correlation and detection quality without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnwork.runtime import cut


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, n, rank): the mean rank of each distinct value among all rows, ties averaged.

    Values are counted first, then range-partitioned; a partition's first rank is the count of
    those before it, which is one small row a partition."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    parts = cut(counts.repartitionByRange(value).withColumn("_p", F.spark_partition_id()))
    order = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("_p").agg(F.sum("n").alias("_n"))
    starts = starts.select("_p", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum("n").over(within), F.lit(0))
    return parts.join(F.broadcast(starts), "_p").select(value, "n", (before + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (rho, n): null below three pairs or where a side is constant."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    rx = value_ranks(both, x).select(x, F.col("rank").alias("_rx"))
    ry = value_ranks(both, y).select(y, F.col("rank").alias("_ry"))
    # Equal pairs are one row with a weight, so a value of a third of all rows is few rows at the join.
    cells = both.groupBy(x, y).agg(F.count(F.lit(1)).alias("_c")).join(rx, x).join(ry, y)
    out = cells.agg(weighted_correlation(F.col("_c"), F.col("_rx"), F.col("_ry")).alias("r"), F.sum("_c").alias("n"))
    return out.select(F.when((F.col("n") >= 3) & ~F.isnan("r"), F.col("r")).alias("rho"), F.coalesce("n", F.lit(0)).alias("n"))


def weighted_correlation(c: Column, x: Column, y: Column) -> Column:
    """The correlation of x and y, each row standing for c; an aggregate."""
    n, sx, sy = F.sum(c), F.sum(c * x), F.sum(c * y)
    apart = (F.sum(c * x * x) - sx * sx / n) * (F.sum(c * y * y) - sy * sy / n)
    return F.when(apart > 0, (F.sum(c * x * y) - sx * sy / n) / F.sqrt(apart))


def gini(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, gini): null where the values sum to nothing. Equal values of a group are counted before they
    are put in order, so what is sorted are its distinct values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    below = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c, v = F.col("_c"), F.col(value)
    placed = counted.withColumn("_i", c * below + c * (c + 1) / 2)  # the places of equal values, summed
    n, total = F.sum(c), F.sum(c * v)
    g = 2 * F.sum(F.col("_i") * v) / (n * total) - (n + 1) / n
    return placed.groupBy(*by).agg(F.when(total > 0, g).alias("gini"))


def bus_factor(df: DataFrame, by: list[str], who: str, amount: str) -> DataFrame:
    """(by, bus_factor): the fewest people who together have half of the whole."""
    order = Window.partitionBy(*by).orderBy(F.desc(amount), who)
    placed = df.withColumns(
        {
            "_k": F.row_number().over(order),
            "_run": F.sum(amount).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "_all": F.sum(amount).over(Window.partitionBy(*by)),
        }
    )
    return placed.where((F.col("_run") * 2 >= F.col("_all")) & (F.col("_all") > 0)).groupBy(*by).agg(F.min("_k").alias("bus_factor"))


def confusion(df: DataFrame, score: str, label: Column, n: int = 102) -> DataFrame:
    """Counts and rates for the thresholds 0 to n - 1; at or above one counts as found. Rows are
    counted by whole score first, so n rows are what is summed up, not rows times thresholds."""
    bucket = F.least(F.lit(n - 1), F.greatest(F.lit(-1), F.floor(score))).cast("int")
    counts = df.where(F.col(score).isNotNull()).groupBy(bucket.alias("threshold")).agg(
        F.count_if(label).alias("_pos"), F.count_if(~label).alias("_neg")
    )
    every = df.sparkSession.range(-1, n).select(F.col("id").cast("int").alias("threshold"))
    filled = every.join(counts, "threshold", "left").fillna(0, ["_pos", "_neg"])
    up = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = filled.select(
        "threshold",
        F.sum("_pos").over(up).alias("tp"),
        F.sum("_neg").over(up).alias("fp"),
        (F.sum("_pos").over(whole) - F.sum("_pos").over(up)).alias("fn"),
        (F.sum("_neg").over(whole) - F.sum("_neg").over(up)).alias("tn"),
    ).where("threshold >= 0")
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    rate = {
        "precision": F.when(tp + fp > 0, tp / (tp + fp)),
        "recall": F.when(tp + fn > 0, tp / (tp + fn)),
        "fpr": F.when(fp + tn > 0, fp / (fp + tn)),
        "f1": F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0),
    }
    return out.withColumns(rate)


def auc(points: DataFrame) -> DataFrame:
    """One row (auc): trapezoids over (fpr, recall) of confusion(), with the end points. There are
    as many points as thresholds, so one task orders them."""
    spark = points.sparkSession
    ends = spark.sql("select 0.0d fpr, 0.0d recall, 1e9d threshold union all select 1.0d, 1.0d, -1e9d")
    all_points = points.select("fpr", "recall", F.col("threshold").cast("double")).unionByName(ends)
    order = Window.orderBy(F.desc("threshold"))
    area = (F.col("fpr") - F.lag("fpr").over(order)) * (F.col("recall") + F.lag("recall").over(order)) / 2
    return all_points.select(area.alias("a")).agg(F.sum("a").alias("auc"))


def cliffs_delta(df: DataFrame, value: str, better: Column) -> DataFrame:
    """One row (delta): how much more often a value of the better group is above one of the other
    than below. From ranks, not from pairs."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_b", better)
    ranked = rows.join(value_ranks(rows, value).select(value, "rank"), value)
    n = F.count_if("_b")
    m = F.count_if(~F.col("_b"))
    u = F.sum(F.when(F.col("_b"), F.col("rank"))) - n * (n + 1) / 2
    return ranked.agg(F.when((n > 0) & (m > 0), 2 * u / (n * m) - 1).alias("delta"))
