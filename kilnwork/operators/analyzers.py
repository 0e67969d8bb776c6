"""A registry of analyzers: which apply to a scan, running them apart from each other, and per-scan work whose
failure is a row and not the end of the job."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.runtime import discard, written


@dataclass(frozen=True)
class Analyzer:
    """parse turns raw results into findings and has no effects. No languages: it applies to all."""

    name: str
    parse: Callable[[DataFrame], DataFrame]
    languages: tuple[str, ...] = ()
    phase: int = 1
    experimental: bool = False


class Registry:
    """Analyzers by name, in the order they were added."""

    def __init__(self, analyzers: Iterable[Analyzer] = ()) -> None:
        self.known: dict[str, Analyzer] = {}
        for a in analyzers:
            self.add(a)

    def add(self, analyzer: Analyzer) -> None:
        if analyzer.name in self.known:
            raise ValueError(f"{analyzer.name} is known already")
        self.known[analyzer.name] = analyzer

    def selected(self, scans: DataFrame, experimental: bool = False) -> DataFrame:
        """(scan_id, analyzer, phase, applies) of scans (scan_id, languages array): whether they share a language."""
        rows = [(a.name, list(a.languages), a.phase) for a in self.known.values() if experimental or not a.experimental]
        wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, ls)).cast("array<string>").alias("ls"), F.lit(p).alias("phase")) for n, ls, p in rows])
        each = scans.select("scan_id", F.coalesce("languages", F.array().cast("array<string>")).alias("have"), F.explode(wanted).alias("a"))
        applies = (F.size("a.ls") == 0) | F.arrays_overlap("a.ls", "have")
        return each.select("scan_id", F.col("a.name").alias("analyzer"), "a.phase", applies.alias("applies"))

    def run(self, raw: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], list[tuple[str, str, int, str | None]]]:
        """(findings by analyzer, statuses) where a status is (analyzer, status, rows, error): one that fails
        doesn't stop the others, one without raw results is skipped. Later phases run after earlier ones."""
        found: dict[str, DataFrame] = {}
        statuses: list[tuple[str, str, int, str | None]] = []
        for a in sorted(self.known.values(), key=lambda a: a.phase):
            if a.name not in raw:
                statuses.append((a.name, "skipped", 0, None))
                continue
            at = None
            try:
                rows, at = written(a.parse(raw[a.name]))
                statuses.append((a.name, "completed", rows.count(), None))
                found[a.name] = rows
            except Exception as e:  # whatever it is, it is this analyzer's own
                if at is not None:
                    discard(raw[a.name].sparkSession, at)
                statuses.append((a.name, "failed", 0, type(e).__name__))
        return found, statuses


def apart(df: DataFrame, by: str, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work on each group in a Python worker: (by, schema, error). A group whose work raises is one row with
    the error's name and nulls; the work's result needn't have `by`."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf[by].iloc[0]
        try:
            out = work(pdf)[names].copy()
            out["error"] = None
        except Exception as e:
            out = pd.DataFrame([[None] * len(names) + [type(e).__name__]], columns=[*names, "error"], dtype=object)
        out.insert(0, by, key)
        return out

    kind = dict(df.dtypes)[by]
    return df.where(F.col(by).isNotNull()).groupBy(by).applyInPandas(run, f"{by} {kind}, {schema}, error string")
