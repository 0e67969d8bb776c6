"""Commit logs: records end with \\x1e, header fields with \\x1f, then a line per changed file."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The escapes of quoted paths.
ESCAPES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13}
QUOTED = re.compile(r"\\([0-7]{3}|.)", re.S)


def unquoted(path: str) -> str:
    """A path as it was before quoting: octal escapes are bytes of UTF-8."""
    if len(path) < 2 or path[0] != '"' or path[-1] != '"':
        return path

    def byte(m: re.Match[str]) -> str:
        code = m[1]
        return chr(int(code, 8) & 255 if len(code) == 3 else ESCAPES.get(code, ord(code) & 255))

    # Latin-1 stands for bytes; characters that were never escaped go through UTF-8 first.
    raw = path[1:-1].encode("utf-8").decode("latin-1")
    return QUOTED.sub(byte, raw).encode("latin-1").decode("utf-8", "replace")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(record) of log files, split while reading, so a long log is many tasks' work."""
    return spark.read.option("lineSep", "\x1e").text(path).withColumnRenamed("value", "record")


def commits(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, sha, parents, author, at, subject, is_merge, files), malformed records skipped.

    files is an array of (path, added, deleted); binary files have null counts. A header must
    have six fields and a whole number as its time; null and blank records have no commit."""

    head = F.split(F.substring_index("record", "\n", 1), "\x1f")
    lines = F.filter(F.split("record", "\r?\n"), lambda x: F.size(F.split(x, "\t")) == 3)
    number = lambda c: F.when(c.rlike(r"^\d+$"), c.cast("int"))
    rows = records.select(*keep, head.alias("h"), lines.alias("lines")).where("size(h) = 6")
    rows = rows.where(F.get("h", F.lit(4)).rlike(r"^\s*-?\d+\s*$"))
    parents = F.filter(F.split(F.trim(F.get("h", F.lit(1))), r"\s+"), lambda x: x != "")
    out = rows.select(
        *keep,
        F.get("h", F.lit(0)).alias("sha"),
        parents.alias("parents"),
        F.concat(F.get("h", F.lit(2)), F.lit(" <"), F.lower(F.get("h", F.lit(3))), F.lit(">")).alias("author"),
        F.trim(F.get("h", F.lit(4))).cast("bigint").alias("at"),
        F.get("h", F.lit(5)).alias("subject"),
        (F.size(parents) > 1).alias("is_merge"),
        "lines",
    )
    parts = F.transform("lines", lambda x: F.split(x, "\t"))
    quoted = F.exists(parts, lambda p: F.get(p, F.lit(2)).startswith('"'))
    plain = F.transform(
        parts, lambda p: F.struct(F.get(p, F.lit(2)).alias("path"), number(F.get(p, F.lit(0))).alias("added"), number(F.get(p, F.lit(1))).alias("deleted"))
    )
    # Only logs with quoted paths meet Python: the paths go as one text, apart by a character none has.
    joined = F.array_join(F.transform(parts, lambda p: F.get(p, F.lit(2))), "\x1d")
    out = out.withColumn("names", F.split(F.when(quoted, unquote_all(joined)), "\x1d"))
    fixed = F.transform(
        plain,
        lambda f, i: F.struct(
            F.coalesce(F.get("names", i), f["path"]).alias("path"), f["added"].alias("added"), f["deleted"].alias("deleted")
        ),
    )
    return out.withColumn("files", fixed).drop("lines", "names")



@F.pandas_udf(T.StringType())
def unquote_all(paths: pd.Series) -> pd.Series:
    return paths.map(lambda v: None if v is None else "\x1d".join(map(unquoted, v.split("\x1d"))))
