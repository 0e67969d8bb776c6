"""Writing results: one scan at a time replaced, addresses of people hidden, old texts emptied."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")


def replace_by(df: DataFrame, path: str, by: str, keys: list[str], order: str) -> None:
    """Replace what the table at `path` holds of every `by` in df, keeping the first row of a key.
    Other partitions stay; a task that is run again writes the same files' content."""
    first = df.groupBy(by, *keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in (by, *keys)]), order).alias("_r"))
    rows = first.select(by, *keys, "_r.*").select(*df.columns)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


@F.pandas_udf(T.StringType())
def without_emails(texts: pd.Series) -> pd.Series:
    """Each address by a stable pseudonym, so equal authors stay equal."""

    def pseudonym(m: re.Match[str]) -> str:
        return "author-" + hashlib.sha256(m[0].lower().encode()).hexdigest()[:10]

    return texts.map(lambda t: None if t is None else EMAIL.sub(pseudonym, t))


def purged(df: DataFrame, texts: list[str], at: str, before: Column) -> DataFrame:
    """Texts of rows older than `before` emptied to null; rows stay."""
    old = F.col(at) < before
    return df.withColumns({c: F.when(old, None).otherwise(F.col(c)) for c in texts})


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `old` with those of `new` in the place of equal keys, and the rest of `new` beside them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def css_tokens(tokens: DataFrame, by: str) -> DataFrame:
    """(by, css): tokens (name, value) as custom properties, by name."""
    line = F.concat(F.lit("  --"), F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), F.lit(": "), "value", F.lit(";"))
    listed = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return tokens.where("name is not null and value is not null").groupBy(by).agg(F.concat(F.lit(":root {\n"), listed, F.lit("\n}\n")).alias("css"))


def newest_entries(log: DataFrame, at: str, most: int, *tie: str) -> DataFrame:
    """A bounded log, the newest first."""
    return log.orderBy(F.desc(at), *tie).limit(most)


def unfinished(deliveries: DataFrame, state: DataFrame, key: str, ended: tuple[str, ...]) -> DataFrame:
    """Deliveries that are still to be worked on: the first of each key whose state hasn't ended."""
    over = state.where(F.col("status").isin(*ended)).select(key)
    return deliveries.dropDuplicates([key]).join(over, key, "left_anti")


def exported(df: DataFrame, path: str, kind: str) -> None:
    """A report as 'csv' with a header, quotes doubled, or as 'json' lines; written as a whole, again the same."""
    writer = df.write.mode("overwrite")
    writer = writer.option("header", True).option("escape", '"') if kind == "csv" else writer
    writer.format(kind).save(path)
