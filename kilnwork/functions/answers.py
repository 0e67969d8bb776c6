"""Text that models and people write around data: JSON in prose, patches, references to files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(text: Column) -> Column:
    """The JSON in an answer: a fenced block, the text itself, or from its first to its last brace."""
    plain = F.regexp_replace(text, r"^[\s\ufeff]+|\s+$", "")
    fenced = F.regexp_extract(plain, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    inner = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", fenced).when(plain.rlike(r"^[{\[]"), plain).when(inner != "", inner).otherwise(plain)


def repaired(json: Column) -> Column:
    """Without trailing commas, with plain quotes."""
    return F.translate(F.regexp_replace(json, r",(\s*[}\]])", "$1"), "“”", '""')


def parsed_answer(text: Column) -> Column:
    """A variant, of the text as it is or repaired; null if neither is JSON."""
    j = json_text(text)
    return F.coalesce(F.try_parse_json(j), F.try_parse_json(repaired(j)))


def plain_patch(patch: Column) -> Column:
    """Line feeds only, no fence around, one line feed at the end; null for nothing."""
    p = F.regexp_replace(F.regexp_replace(patch, "\r\n?", "\n"), r"(?s)^\s*```\w*\n|\n?```\s*$", "")
    body = F.regexp_replace(p, r"\n+$", "")
    return F.when(F.trim(body) != "", F.concat(body, F.lit("\n")))


def patch_paths(patch: Column) -> Column:
    """The files a patch changes, each once, in order."""
    found = F.regexp_extract_all(patch, F.lit(r"(?m)^(?:---|\+\+\+) (?:[ab]/)?([^\t\n]+)"), 1)
    return F.array_distinct(F.filter(found, lambda p: p != "/dev/null"))


def changed_ranges(patch: Column) -> Column:
    """(start, end) of the old file's lines in every hunk; an empty range ends before it starts."""
    starts = F.regexp_extract_all(patch, F.lit(r"(?m)^@@ -(\d+)(?:,(\d+))? "), 1)
    counts = F.regexp_extract_all(patch, F.lit(r"(?m)^@@ -(\d+)(?:,(\d+))? "), 2)
    return F.transform(
        F.arrays_zip(starts.alias("s"), counts.alias("c")),
        lambda h: F.struct(
            h["s"].cast("int").alias("start"),
            (h["s"].cast("int") + F.coalesce(F.nullif(h["c"], F.lit("")).cast("int"), F.lit(1)) - 1).alias("end"),
        ),
    )


def plain_reference(text: Column) -> Column:
    """A file as it is cited: no quotes, no parentheses or line after it, no './' before it."""
    t = F.regexp_replace(F.trim(text), "^[`'\"]+|[`'\"]+$", "")
    t = F.regexp_replace(t, r"\s*\(.*\)$|:\d+(?:-\d+)?$", "")
    return F.regexp_replace(t, r"^(?:\./)+", "")
