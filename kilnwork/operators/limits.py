"""Stateful control over events in order: limits, reservations, timeouts, caches."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def admitted(events: DataFrame, key: str, at_ms: Column, order: str, window_ms: int, limit: int, cost: Column | None = None) -> DataFrame:
    """(key, order, allowed, used): a sliding-window limit replayed in order of time.

    An event is admitted if it and what was admitted in the last window_ms stay within the limit;
    what is refused doesn't count. A cost of 0 only asks. Admission depends on what was admitted
    before, so a key is one ordered pass; it streams and holds at most `limit` admitted units.
    Events without key or time are left out; ties in time go by `order`."""
    kinds = dict(events.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, live, used = None, deque(), 0
        for batch in batches:
            allowed, after = [], []
            for k, at, units in zip(batch["_key"], batch["_at"], batch["_cost"]):
                if k != current:
                    current, live, used = k, deque(), 0
                while live and live[0][0] <= at - window_ms:
                    used -= live.popleft()[1]
                ok = used < limit if units == 0 else used + units <= limit
                if ok and units:
                    live.append((at, units))
                    used += units
                allowed.append(ok)
                after.append(used)
            yield pd.DataFrame({key: batch["_key"], order: batch["_order"], "allowed": allowed, "used": after})

    rows = events.select(
        F.col(key).alias("_key"),
        F.col(order).alias("_order"),
        at_ms.cast("bigint").alias("_at"),
        (F.lit(1) if cost is None else cost).cast("int").alias("_cost"),
    ).where("_key is not null and _at is not null")
    together = rows.repartition("_key").sortWithinPartitions("_key", "_at", "_order")
    return together.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, allowed boolean, used int")


def trailing_counts(events: DataFrame, key: str, at_ms: Column, window_ms: int) -> DataFrame:
    """Adds `trailing`: the key's events in the last window_ms, this one included; none is refused."""
    order = Window.partitionBy(key).orderBy("_at").rangeBetween(-window_ms + 1, 0)
    return events.withColumn("_at", at_ms.cast("bigint")).withColumn("trailing", F.count(F.lit(1)).over(order)).drop("_at")


def timed_out(jobs: DataFrame, state: Column, since: str, seconds: int, now: Column) -> DataFrame:
    """Jobs in `state` since more than `seconds` before `now`."""
    return jobs.where(state & (F.unix_timestamp(now) - F.unix_timestamp(since) > seconds))


def newest_within(rows: DataFrame, by: list[str], at: str, seconds: int, now: Column, take: str) -> DataFrame:
    """(by, take): the newest row of each key that isn't older than `seconds`."""
    fresh = rows.where(F.unix_timestamp(now) - F.unix_timestamp(at) <= seconds)
    return fresh.groupBy(*by).agg(F.max_by(take, F.struct(at, take)).alias(take))


@dataclass(frozen=True)
class Check:
    """A limit on the sum of `amount` over what one `group` was granted."""

    name: str
    group: str
    amount: str
    limit: float


def granted(calls: DataFrame, within: str, at: str, order: str, checks: tuple[Check, ...]) -> DataFrame:
    """(within, order, granted, refused_by): a ledger of reservations replayed in order of time. A call is granted
    if it stays within all limits, else the first that it breaks is named and nothing of it counts.

    A ledger starts anew with each `within`, a day or a month, whose calls are one ordered pass; what is held is a
    sum for each group. Calls without `within` or time are left out, null amounts are 0."""
    kinds = dict(calls.dtypes)
    groups, amounts = [f"_g{k}" for k in range(len(checks))], [f"_a{k}" for k in range(len(checks))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, spent = None, {}
        for batch in batches:
            refused = []
            rows = zip(batch["_within"], zip(*(batch[g] for g in groups)), zip(*(batch[a] for a in amounts)))
            for w, keys, asked in rows:
                if w != current:
                    current, spent = w, {}
                held = [spent.get((k, key), 0.0) for k, key in enumerate(keys)]
                broken = next((c.name for c, h, a in zip(checks, held, asked) if h + a > c.limit + 1e-9), None)
                refused.append(broken)
                if broken is None:
                    spent |= {(k, key): h + a for k, (key, h, a) in enumerate(zip(keys, held, asked))}
            yield pd.DataFrame({within: batch["_within"], order: batch["_order"], "granted": [r is None for r in refused], "refused_by": refused})

    rows = calls.select(
        F.col(within).alias("_within"),
        F.col(at).alias("_at"),
        F.col(order).alias("_order"),
        *[F.coalesce(F.col(c.group).cast("string"), F.lit("")).alias(g) for c, g in zip(checks, groups)],
        *[F.coalesce(F.col(c.amount).cast("double"), F.lit(0.0)).alias(a) for c, a in zip(checks, amounts)],
    ).where("_within is not null and _at is not null")
    together = rows.repartition("_within").sortWithinPartitions("_within", "_at", "_order").drop("_at")
    return together.mapInPandas(run, f"{within} {kinds[within]}, {order} {kinds[order]}, granted boolean, refused_by string")


def reset_text(seconds: Column, now: Column) -> Column:
    """When a limit is over, for a reader."""
    then = F.timestamp_seconds(F.unix_timestamp(now) + seconds)
    return (
        F.when(seconds < 90, F.concat(F.lit("in "), seconds.cast("string"), F.lit(" seconds")))
        .when(seconds < 5400, F.concat(F.lit("in "), F.rint(seconds / 60).cast("int").cast("string"), F.lit(" minutes ("), F.date_format(then, "HH:mm"), F.lit(" UTC)")))
        .otherwise(F.concat(F.lit("at "), F.date_format(then, "yyyy-MM-dd HH:mm"), F.lit(" UTC")))
    )


def limits_of(users: DataFrame, tiers: DataFrame, names: list[str]) -> DataFrame:
    """(user_id, name, limit): a user's own limit where there is one (a column of the name), else their tier's
    (tier, name, limit), the tier 'free' standing for any that isn't listed."""
    known = tiers.select("tier").distinct()
    own = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("bigint").alias("own")) for n in names])).alias("o")
    each = users.join(known.withColumn("listed", F.lit(True)), "tier", "left").withColumn("tier", F.when(F.col("listed"), F.col("tier")).otherwise("free"))
    each = each.select("user_id", "tier", own).select("user_id", "tier", "o.*")
    return each.join(tiers, ["tier", "name"], "left").select("user_id", "name", F.coalesce("own", "limit").alias("limit"))
