"""Texts into containers of fixed capacity with little space unused.

Sizes are counted in tokens and reduced to a histogram, which has at most `capacity` entries
however large the corpus is. On it, combinations of up to three lengths that fill the window
are enumerated, non-negative least squares gives how often each is repeated, the repeats are
rounded down, and what remains is packed greedily by exact size. The plan says which ranks of a
size go where; documents get their rank by distributed counting, so none leaves its executor."""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnwork.runtime import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer's authors split text before merging bytes.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens) of every keyed row, whole texts; null and empty texts have 0."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(tokenizer, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            batch["n_tokens"] = [len(encode(t)) if t else 0 for t in batch[text]]
            yield batch[[key, "n_tokens"]]

    keyed = spread(docs.select(key, text).where(f"{key} is not null"))
    return keyed.mapInPandas(run, f"{key} {kind}, n_tokens int").dropDuplicates([key])


def nnls(a: np.ndarray, b: np.ndarray, most: int = 2000) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by active sets."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ b
    tiny = 1e-10 * max(1.0, float(np.abs(gradient).max(initial=0.0)))
    for _ in range(most):
        gradient = a.T @ (b - a[:, free] @ x[free])
        gradient[free] = -np.inf
        enter = int(gradient.argmax()) if n else -1
        if enter < 0 or gradient[enter] <= tiny:
            break
        free[enter] = True
        while True:
            at = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            old = x[at]
            step = (old[low] / np.maximum(old[low] - s[low], 1e-300)).min()
            x[at] = old + step * (s - old)
            gone = at[(x[at] <= 1e-12) & low]
            if not len(gone):
                gone = at[low]
            x[gone] = 0
            free[gone] = False
            if not free.any():
                break
    return x


def combinations(window: int) -> list[tuple[int, ...]]:
    """Multisets of up to three lengths that fill the window."""
    pairs = [(i, window - i) for i in range(1, window // 2 + 1)]
    triples = [
        (i, j, window - i - j) for i in range(1, window // 3 + 1) for j in range(i, (window - i) // 2 + 1)
    ]
    return [(window,), *pairs, *triples]


@dataclass(frozen=True)
class Pattern:
    """A container's content: (size or bin, copies) each, and how many such containers there are."""

    content: tuple[tuple[int, int], ...]
    repeats: int


def repeated_combinations(bins: np.ndarray) -> list[Pattern]:
    """Patterns over bins 1..len(bins)-1; together they take no more than the bins hold."""
    window = len(bins) - 1
    held = np.flatnonzero(bins)
    known = set(held.tolist())
    mixes = [c for c in combinations(window) if known.issuperset(c)]
    if not mixes:
        return []
    row = {b: k for k, b in enumerate(held.tolist())}
    a = np.zeros((len(held), len(mixes)))
    for k, mix in enumerate(mixes):
        for b in mix:
            a[row[b], k] += 1
    weight = np.sqrt(held / window)
    repeats = np.floor(nnls(a * weight[:, None], bins[held] * weight) + 1e-9).astype(np.int64)
    left = bins.copy()
    out = []
    for k in np.argsort(-repeats, kind="stable").tolist():
        mix, r = mixes[k], int(repeats[k])
        content = tuple((b, mix.count(b)) for b in sorted(set(mix)))
        r = min([r, *(int(left[b]) // m for b, m in content)])
        if r > 0:
            for b, m in content:
                left[b] -= r * m
            out.append(Pattern(content, r))
    return out


def greedy(sizes: dict[int, int], capacity: int) -> list[Pattern]:
    """What remains, by exact size: the largest first, then the largest that still fit. A pattern
    is repeated as long as its sizes last, so there are few patterns however many items."""
    left = {s: n for s, n in sizes.items() if n > 0}
    order = sorted(left)
    out = []
    while order:
        room, content, at = capacity, [], len(order) - 1
        while at >= 0:
            size = order[at]
            copies = min(left[size], room // size)
            if copies:
                content.append((size, copies))
                room -= copies * size
            at = min(at - 1, bisect_right(order, room) - 1)
        repeats = min(left[s] // m for s, m in content)
        out.append(Pattern(tuple(content), repeats))
        for s, m in content:
            left[s] -= m * repeats
        order = [s for s in order if left[s]]
    return out


@dataclass(frozen=True)
class Plan:
    """Where the items of each size go, by their rank in it: ranks from `start` on, `copies` to a
    container, containers from `first` on. Sorted by (size, start)."""

    size: np.ndarray
    start: np.ndarray
    copies: np.ndarray
    first: np.ndarray
    containers: int

    def containers_of(self, sizes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        key = self.size.astype(np.int64) << 40 | self.start
        at = np.searchsorted(key, sizes.astype(np.int64) << 40 | ranks, side="right") - 1
        return self.first[at] + (ranks - self.start[at]) // self.copies[at]


def make_plan(histogram: dict[int, int], capacity: int, resolution: int = 256) -> Plan:
    """The plan for items of 1..capacity. Bins of the combinations are capacity / resolution wide
    and count as their upper edge, so a combination never overflows."""
    grain = -(-capacity // min(resolution, capacity))
    window = capacity // grain
    bins = np.zeros(window + 1, np.int64)
    in_bin: dict[int, list[int]] = {}
    for size in sorted(histogram, reverse=True):
        b = -(-size // grain)
        if b <= window:
            bins[b] += histogram[size]
            in_bin.setdefault(b, []).append(size)
    used = dict.fromkeys(histogram, 0)
    rows: list[tuple[int, int, int, int]] = []
    base = 0
    for p in repeated_combinations(bins):
        for b, m in p.content:
            need, container = p.repeats * m, 0
            # A container's copies of a bin may come from two sizes: they are handed out one slot
            # at a time, slot k of all containers before slot k + 1.
            slots = [p.repeats] * m
            while need:
                size = next(s for s in in_bin[b] if used[s] < histogram[s])
                take = min(histogram[size] - used[size], slots[-1])
                rows.append((size, used[size], 1, base + container))
                used[size] += take
                need -= take
                slots[-1] -= take
                container += take
                if not slots[-1]:
                    slots.pop()
                    container = 0
        base += p.repeats
    rest = {s: n - used[s] for s, n in histogram.items()}
    for p in greedy(rest, capacity):
        for size, m in p.content:
            rows.append((size, used[size], m, base))
            used[size] += p.repeats * m
        base += p.repeats
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    return Plan(*columns, base)


def pack(
    docs: DataFrame,
    capacities: dict[int, int],
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    resolution: int = 256,
) -> DataFrame:
    """(capacity_id, container_id, key, piece, start_token, n_tokens): all texts in containers of
    each capacity.

    A text that exceeds a capacity is cut into pieces of the capacity and a rest; no other is cut.
    Texts without tokens (null, empty) take no space and stand in container 0 as piece 0. Keys
    count once; rows without a key are left out; capacities that aren't positive have no containers; ties in size go by a hash of the key, so the
    result doesn't depend on partitions. The broadcast plan has at most capacity + resolution
    patterns of at most sqrt(2 * capacity) sizes, whatever the corpus."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    shape = f"capacity_id int, container_id bigint, {key} {kind}, piece int, start_token int, n_tokens int"
    capacities = {k: c for k, c in capacities.items() if c and c > 0}
    if not capacities:
        return spark.createDataFrame([], shape)
    counts = cut(token_counts(docs, key, text, tokenizer))
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("id"), F.lit(c).cast("bigint").alias("size")) for k, c in sorted(capacities.items())])).alias("c")
    capacity = F.col("c.size")
    whole = F.floor(F.col("n_tokens") / capacity)
    last = F.col("n_tokens") - whole * capacity
    n_pieces = F.greatest(whole + F.when(last > 0, 1).otherwise(0), F.lit(1))
    pieces = counts.select(key, "n_tokens", each).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), n_pieces - 1)))
    pieces = pieces.select(
        F.col("c.id").alias("capacity_id"),
        key,
        F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * capacity).cast("int").alias("start_token"),
        F.least(capacity, F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("n_tokens"),
        F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int").alias("salt"),
    )
    by = ["capacity_id", "n_tokens"]
    per_salt = cut(pieces.where("n_tokens > 0").groupBy(*by, "salt").agg(F.count(F.lit(1)).alias("n")))
    histograms: dict[int, dict[int, int]] = {k: {} for k in capacities}
    for r in per_salt.groupBy(*by).agg(F.sum("n").alias("n")).collect():  # at most a capacity's sizes each
        histograms[r.capacity_id][r.n_tokens] = r.n
    plans = spark.sparkContext.broadcast({k: make_plan(histograms[k], c, resolution) for k, c in capacities.items()})
    before = Window.partitionBy(*by).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_salt.select(*by, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy(*by, "salt").orderBy(F.xxhash64(key, "piece"), key, "piece")
    ranked = pieces.where("n_tokens > 0").withColumn("rank", F.row_number().over(order) - 1).join(offsets, [*by, "salt"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ranks = batch["offset"].to_numpy(np.int64) + batch["rank"].to_numpy(np.int64)
            of, sizes = batch["capacity_id"].to_numpy(), batch["n_tokens"].to_numpy()
            container = np.zeros(len(batch), np.int64)
            for k in np.unique(of).tolist():
                mine = of == k
                container[mine] = plans.value[k].containers_of(sizes[mine], ranks[mine])
            batch["container_id"] = container
            yield batch[["capacity_id", "container_id", key, "piece", "start_token", "n_tokens"]]

    empty = pieces.where("n_tokens <= 0").select("capacity_id", F.lit(0).cast("bigint").alias("container_id"), key, "piece", "start_token", "n_tokens")
    return ranked.mapInPandas(place, shape).unionByName(empty)


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Containers, tokens, the share of space used and the least number of containers there could be."""
    each = packed.groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("n"))
    total = each.groupBy("capacity_id").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest")
    )
    return total.join(capacities, "capacity_id").select(
        "capacity_id",
        "capacity_tokens",
        "n_containers",
        "n_tokens",
        "fullest",
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"),
        (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("used"),
    )
