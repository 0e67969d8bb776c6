"""References to records that do not exist, are deleted, or arrive later.

Parents and children meet in one long table of tagged keys. One aggregation by
(target table, key) with map-side partials decides the fate of every key, however many
children name it: a key that a third of all rows refer to is one small state per map task.
Only the keys that fail for some child go back to the children, those that fail very often by
broadcast: fewer than a fixed number can have more than that part of all uses."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnwork.runtime import written

HOT = 1000


@dataclass(frozen=True)
class Parent:
    """A table that others refer to. deleted/arrived name timestamp columns, if it has them."""

    name: str
    df: DataFrame
    key: str = "id"
    arrived: str | None = "ingested_at"
    deleted: str | None = "deleted_at"


@dataclass(frozen=True)
class Child:
    """A field that refers to a parent's key; an array field refers with each of its elements."""

    table: str
    field: str
    df: DataFrame
    target: str
    key: str = "id"
    at: str = "created_at"
    many: bool = False


def _keys_of(parent: Parent) -> DataFrame:
    never = F.lit(None).cast("timestamp")
    return parent.df.select(
        F.lit(parent.name).alias("target"),
        F.col(parent.key).cast("bigint").alias("target_id"),
        F.lit(True).alias("is_parent"),
        (F.col(parent.arrived) if parent.arrived else never).alias("arrived"),
        (F.col(parent.deleted).isNotNull() if parent.deleted else F.lit(False)).alias("deleted"),
        never.alias("at"),
    ).where("target_id is not null")


def _references_of(child: Child) -> DataFrame:
    value: Column = F.explode(child.field) if child.many else F.col(child.field)
    return (
        child.df.select(F.col(child.key).alias("ref_id"), F.col(child.at).alias("at"), value.alias("target_id"))
        .where("target_id is not null")
        .select(
            F.lit(child.table).alias("ref_table"),
            F.lit(child.field).alias("ref_field"),
            F.col("ref_id").cast("bigint").alias("ref_id"),
            F.col("target_id").cast("bigint").alias("target_id"),
            F.lit(child.target).alias("target"),
            "at",
        )
    )


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    first, *rest = parts
    for x in rest:
        first = first.unionByName(x)
    return first


def broken_references(parents: list[Parent], children: list[Child]) -> DataFrame:
    """(ref_table, ref_field, ref_id, target_id, at, reason), each reference once.

    reason is 'missing', 'deleted' or 'late' (the key first arrived after the referring row's
    time), the first that holds. Null references, null and empty arrays refer to nothing; a
    null row time is never late; a parent's null arrival is ignored; a null referring key is
    kept as null. Repeated deliveries change nothing: a key is deleted if any delivery says
    so and arrives with its first delivery. Only the named columns are read, so further
    columns may have any names. Empty parents make every reference missing."""
    refs = _union(map(_references_of, children))
    tagged = _union(
        [
            *map(_keys_of, parents),
            refs.select(
                "target",
                "target_id",
                F.lit(False).alias("is_parent"),
                F.lit(None).cast("timestamp").alias("arrived"),
                F.lit(False).alias("deleted"),
                "at",
            ),
        ]
    )
    keys = tagged.groupBy("target", "target_id").agg(
        F.max("is_parent").alias("exists"),
        F.max("deleted").alias("gone"),
        F.min("arrived").alias("arrived"),
        F.min("at").alias("first_use"),
        F.count_if(~F.col("is_parent")).alias("uses"),
    )
    suspect, _ = written(keys.where("uses > 0 and (not exists or gone or arrived > first_use)").drop("first_use"))
    uses = suspect.agg(F.sum("uses")).first()[0] or 0
    often = F.col("uses") * HOT > uses  # under HOT keys, as each has more than that part of all uses
    by = ["target", "target_id"]
    met = refs.join(F.broadcast(suspect.where(often)), by).unionByName(refs.join(suspect.where(~often), by))
    reason = (
        F.when(~F.col("exists"), "missing").when(F.col("gone"), "deleted").when(F.col("arrived") > F.col("at"), "late")
    )
    return (
        met.withColumn("reason", reason)
        .where("reason is not null")
        .groupBy("ref_table", "ref_field", "ref_id", "target_id")
        .agg(F.min("at").alias("at"), F.min_by("reason", "at").alias("reason"), F.min("reason").alias("any_reason"))
        .select(
            "ref_table", "ref_field", "ref_id", "target_id", "at", F.coalesce("reason", "any_reason").alias("reason")
        )
    )


def broken_reference_counts(parents: list[Parent], children: list[Child]) -> DataFrame:
    """Broken references per referring table, field, reason and UTC month of the referring row."""
    return (
        broken_references(parents, children)
        .groupBy("ref_table", "ref_field", "reason", F.date_trunc("month", "at").alias("month"))
        .agg(F.count(F.lit(1)).alias("n_references"), F.count_distinct("target_id").alias("n_targets"))
    )
