"""Keys on which texts within a few edits of each other meet, so that no text meets every other.

A text cut into k + 1 parts keeps one of them whole under k edits, at a place that is at most k
off. The parts of one side meet what stands at those places on the other; `levenshtein` decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edge(i: Column, length: Column, edits: int) -> Column:
    return F.floor(i * length / (edits + 1)).cast("int")


def part_keys(text: Column, edits: int = 2) -> Column:
    """The keys of a text's own parts."""
    length = F.length(text)

    def key(i: Column) -> Column:
        at = _edge(i, length, edits)
        return F.xxhash64(length, i, F.substring(text, at + 1, _edge(i + 1, length, edits) - at))

    return F.transform(F.sequence(F.lit(0), F.lit(edits)), key)


def probe_keys(text: Column, edits: int = 2) -> Column:
    """Keys that include one of part_keys of every text within `edits` edits."""
    width = 2 * edits + 1

    def key(k: Column) -> Column:
        length = F.length(text) + F.floor(k / (width * (edits + 1))).cast("int") - edits
        i = F.pmod(F.floor(k / width), F.lit(edits + 1)).cast("int")
        at = _edge(i, length, edits)
        size = _edge(i + 1, length, edits) - at
        there = at + F.pmod(k, F.lit(width)).cast("int") - edits
        whole = (length >= 0) & (there >= 0) & (there + size <= F.length(text))
        return F.when(whole, F.xxhash64(length, i, F.substring(text, there + 1, size)))

    keys = F.transform(F.sequence(F.lit(0), F.lit(width * width * (edits + 1) - 1)), key)
    return F.array_distinct(F.array_compact(keys))
