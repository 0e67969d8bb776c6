"""The N best items of every group, by merging sorted runs.

Every map task sorts its rows by bucket, group and score and keeps N items a group: one run,
in which a group of millions is N rows. The runs of a bucket are then merged with a tree of
losers; once a group has its N items every run seeks to its next group."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.runtime import small_enough

# Severities from the least to the most.
SEVERITIES = ("info", "warning", "error", "critical")
END = None


def severity_rank(severity: str) -> Column:
    """0 for a missing or unknown severity, then 1 for info to 4 for critical."""
    plain = F.lower(F.regexp_replace(severity, r"^\s+|\s+$", ""))
    rank = F.when(plain == SEVERITIES[0], 1)
    for k, name in enumerate(SEVERITIES[1:], 2):
        rank = rank.when(plain == name, k)
    return rank.otherwise(0)


class LoserTree:
    """Multiway merge of sorted key lists. Inner nodes hold the losing run of a match, the top
    the winner; replacing the winner's key replays one path."""

    def __init__(self, runs: list[list[int]]) -> None:
        self.runs, self.at = runs, [0] * len(runs)
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.heads: list[int | None] = [r[0] if r else END for r in runs] + [END] * (self.size - len(runs))
        self.losers = [0] * self.size
        self.winner = self._build(1)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is END or (x is not END and (x < y or (x == y and a < b)))

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self._beats(a, b):
            self.losers[node] = b
            return a
        self.losers[node] = a
        return b

    def _replay(self, run: int) -> None:
        winner, node = run, (run + self.size) // 2
        while node:
            other = self.losers[node]
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.winner = winner

    def peek(self) -> int | None:
        return self.heads[self.winner]

    def seek(self, key: int) -> None:
        """Move the winner's run to its first key not below `key`."""
        run = self.winner
        keys = self.runs[run]
        self.at[run] = at = bisect_left(keys, key, self.at[run])
        self.heads[run] = keys[at] if at < len(keys) else END
        self._replay(run)

    def next(self) -> None:
        run = self.winner
        self.at[run] = at = self.at[run] + 1
        self.heads[run] = self.runs[run][at] if at < len(self.runs[run]) else END
        self._replay(run)


ID_BITS, SCORE_BITS = 64, 32
HALF = 1 << (ID_BITS - 1)


def pack(group: int, score: int, key: int) -> int:
    """One ascending key: group, then score downwards, then id."""
    return (((group << SCORE_BITS) | ((1 << (SCORE_BITS - 1)) - score)) << ID_BITS) | (key + HALF)


def merge(runs: list[list[int]], n: int) -> Iterator[tuple[int, int]]:
    """(group, id) of the first n distinct ids of every group, in order."""
    tree = LoserTree(runs)
    group, taken = -1, set()
    while (key := tree.peek()) is not END:
        of, item = key >> (SCORE_BITS + ID_BITS), (key & ((1 << ID_BITS) - 1)) - HALF
        if of != group:
            group, taken = of, set()
        if len(taken) >= n:
            tree.seek((group + 1) << (SCORE_BITS + ID_BITS))
            continue
        if item not in taken:
            taken.add(item)
            yield group, item
        tree.next()


def top_n(
    items: DataFrame,
    n: int,
    group: str,
    score: Column,
    key: str,
    buckets: int | None = None,
    only: DataFrame | None = None,
    bucket_rows: int = 500_000,
    most_broadcast: int = 200_000,
) -> DataFrame:
    """(group, key, place): the n items of every group with the highest integer score, the
    smaller key first among equals; place counts from 1.

    Rows without a group or key are in no group; a null score ranks below all. A key delivered
    more than once counts once, with its highest score. Groups of fewer items come out whole;
    no input gives no rows; further columns are not read. only: a table of the groups that are wanted,
    which are picked before the ranking if they are at most most_broadcast, else after it. A task
    merges a bucket of runs, which on average has at most bucket_rows rows."""
    spark = items.sparkSession
    if only is not None:
        only = only.select(F.col(group).cast("string").alias(group)).where(F.col(group).isNotNull()).distinct()
        if small_enough(only, most_broadcast):
            items, only = items.join(F.broadcast(only), group, "left_semi"), None
    size = items.select(group).count()
    buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_rows))
    low = -(1 << 31) + 1
    rows = items.select(
        F.col(group).cast("string").alias("g"), F.col(key).cast("bigint").alias("k"), score.cast("int").alias("s")
    ).where("g is not null and k is not null")
    rows = rows.select(F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int").alias("b"), "g", F.coalesce("s", F.lit(low)).alias("s"), "k")
    ordered = rows.sortWithinPartitions("b", "g", F.desc("s"), "k")

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        run, carry = TaskContext.get().partitionId(), None
        for batch in batches:
            batch = batch if carry is None else pd.concat([carry, batch])
            batch = batch.drop_duplicates(["g", "k"])
            batch = batch[batch.groupby("g", sort=False).cumcount() < n]
            if batch.empty:
                continue
            last = batch.g == batch.g.iloc[-1]
            carry, whole = batch[last], batch[~last]
            yield whole.assign(run=run)
        if carry is not None:
            yield carry.assign(run=run)

    shape = "b int, g string, s int, k bigint"
    runs = ordered.mapInPandas(prune, f"{shape}, run int")
    stored = runs.repartition(buckets, "b").sortWithinPartitions("b", "run", "g", F.desc("s"), "k")

    def join_runs(part: pd.DataFrame) -> pd.DataFrame:
        names, codes = np.unique(part.g.to_numpy(dtype=object), return_inverse=True)
        keys = [pack(g, max(s, low), k) for g, s, k in zip(codes.tolist(), part.s.tolist(), part.k.tolist())]
        edges = np.flatnonzero(np.diff(part.run.to_numpy())) + 1
        bounds = [0, *edges.tolist(), len(keys)]
        got = list(merge([keys[a:b] for a, b in zip(bounds, bounds[1:])], n))
        out = pd.DataFrame({"g": [names[g] for g, _ in got], "k": [k for _, k in got]})
        out["place"] = out.groupby("g", sort=False).cumcount() + 1
        return out

    def per_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for b, part in batch.groupby("b", sort=True):
                if held and held[0].b.iloc[0] != b:
                    yield join_runs(pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield join_runs(pd.concat(held))

    merged = stored.mapInPandas(per_bucket, "g string, k bigint, place int")
    best = merged.select(F.col("g").alias(group), F.col("k").alias(key), "place")
    return best if only is None else best.join(only, group, "left_semi")
