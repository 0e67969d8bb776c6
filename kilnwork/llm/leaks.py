"""Test items that leaked into a corpus.

Test items are indexed by BM25 over word triples, impacts kept in blocks with their maximum. Every
passage of every document is a query; block-max WAND returns the items above a threshold without
scoring the rest. What it returns is verified word by word, question and answer.

Word and term counts are taken over all items, and an item's threshold is the least score that a
reproduction of it can have, so neither their number nor the way they are split decides what is
found. Three words that follow each other in a reproduction may have a replaced one between each
two of them; a triple is indexed in all four such spacings. The index is broadcast in parts of a bounded
number of bytes, and every document meets every part."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.llm.lookalike import skeleton
from kilnwork.runtime import discard, spread, written

WORD = re.compile(r"[^\W_]+")
BROKEN_WORD = re.compile(r"(?<=[^\W\d_])-\s*\n\s*(?=[^\W\d_])")
SPACINGS = ((1, 2), (1, 3), (2, 3))
PAIR = len(SPACINGS)


def sure(shortest: int, own: int, stretch: int) -> tuple[int, int]:
    """Triples, and triples with an own word, that a chain has at least whose replaced words have two
    equal ones between them: k stretches of e equal words each cover up to e + (e - 1) / 2 words and have
    e - 2 triples; at the end of a stretch each further own word is in one more of them."""
    if stretch < 3:
        raise ValueError("a stretch has a triple from three words on")
    triples = min(max(k * stretch, -(-(2 * shortest + k) // 3)) - 2 * k for k in range(1, shortest + 1))
    return triples, min(-(-own // 2), stretch - 2, triples)


def words(text: str) -> list[str]:
    """Words without case, accents, punctuation, layout or the differences of look-alikes."""
    if not text.isascii():
        text = unicodedata.normalize("NFD", skeleton(unicodedata.normalize("NFKC", text)))
        text = "".join(c for c in text if not unicodedata.combining(c))
    return WORD.findall(text.casefold())


def hashed(doc: list[str]) -> np.ndarray:
    """A number for each word, the same on every machine."""
    return pd.util.hash_array(np.array(doc, dtype=object)) if doc else np.empty(0, np.uint64)


def _mixed(kind: int, *parts: np.ndarray) -> np.ndarray:
    out = np.full(len(parts[0]), kind + 1, np.uint64)
    for part in parts:
        out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def triple_codes(h: np.ndarray) -> list[np.ndarray]:
    """For each spacing the codes of the triples by first word."""
    return [_mixed(kind, h[: len(h) - b], h[a : len(h) - b + a], h[b:]) if len(h) > b else h[:0] for kind, (a, b) in enumerate(SPACINGS)]


def pair_codes(h: np.ndarray) -> np.ndarray:
    return _mixed(PAIR, h[:-1], h[1:]) if len(h) > 1 else h[:0]


class ItemIndex:
    """BM25 over the items' word triples, with block maxima. k1 and b are BM25's own.

    frequency: items by code, where more than one; total and mean: number of all items and
    their mean length. An item's impacts are divided by the least score of a reproduction of it that
    verification can accept: sure[0] triples with different first words, sure[1] of them with
    a word of the item's own."""

    def __init__(
        self,
        items: list[tuple[int, list[str], list[str]]],
        frequency: dict[int, int],
        total: int,
        mean: float,
        common: set[int],
        sure: tuple[int, int] = (10, 4),
        block: int = 4,
        k1: float = 1.2,
        b: float = 0.75,
    ) -> None:
        vocab: dict[str, int] = {}
        coded = [[[vocab.setdefault(w, len(vocab)) for w in part] for part in (p, a)] for _, p, a in items]
        self.ids, self.vocab, self.block = [i for i, _, _ in items], vocab, block
        self.passages, self.answers = [c[0] for c in coded], [c[1] for c in coded]
        self.hashes = hashed(list(vocab))
        self.own = [np.ones(len(p), bool) for p in self.passages]
        self.least = np.zeros(len(items))
        codes, owners, impacts = [], [], []
        for item, passage in enumerate(self.passages):
            h = self.hashes[np.array(passage, np.int64)] if passage else self.hashes[:0]
            own = self.own[item]
            for k, pair in enumerate(pair_codes(h).tolist()):
                if pair in common:
                    own[k] = own[k + 1] = False
            parts = triple_codes(h)
            if not len(parts[0]):
                continue
            terms, place, tf = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            df = np.array([frequency.get(t, 1) for t in terms.tolist()], float)
            idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
            impact = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(passage) / mean))
            any_at, own_at = np.full((2, len(parts[0])), np.inf)
            at = 0
            for part, (i, j) in zip(parts, SPACINGS):
                n = len(part)
                each = (impact / tf)[place[at : at + n]]
                any_at[:n] = np.minimum(any_at[:n], each)
                own_at[:n] = np.minimum(own_at[:n], np.where(own[:n] | own[i : n + i] | own[j : n + j], each, np.inf))
                at += n
            least = np.sort(own_at)[: sure[1]].sum() + np.sort(any_at)[: sure[0] - sure[1]].sum()
            if len(any_at) < sure[0] or not np.isfinite(least):
                continue  # nothing that verification accepts has so few words
            self.least[item] = least
            codes.append(terms)
            owners.append(np.full(len(terms), item, np.int32))
            impacts.append(impact / max(least, 1e-12))
        every = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.owners = np.concatenate(owners)[order] if codes else np.empty(0, np.int32)
        self.impacts = np.concatenate(impacts)[order] if codes else np.empty(0)
        self.terms, starts = np.unique(every[order], return_index=True)
        self.starts = np.append(starts, len(every))
        # Block maxima: (term, block of items) and the most that an item of the block has.
        self.blocks = len(items) // block + 1
        of = np.repeat(np.arange(len(self.terms)), np.diff(self.starts)) * self.blocks + self.owners // block
        at, first = np.unique(of, return_index=True)
        self.block_ids = at % self.blocks
        self.block_most = np.maximum.reduceat(self.impacts, first) if len(at) else np.empty(0)
        self.block_starts = np.searchsorted(at, np.arange(len(self.terms) + 1) * self.blocks)
        self.lists: dict[tuple[int, ...], tuple[list[int], list[float], list[float], float]] = {}
        self.seen: np.ndarray | None = None

    def posting(self, slot: tuple[int, ...]) -> tuple[list[int], list[float], list[float], float]:
        """The items of a word's triples, with the greatest impact that one of its spacings has."""
        got = self.lists.get(slot)
        if got is None:
            best: dict[int, float] = {}
            for term in slot:
                if term >= 0:
                    a, b = self.starts[term], self.starts[term + 1]
                    for item, w in zip(self.owners[a:b].tolist(), self.impacts[a:b].tolist()):
                        best[item] = max(w, best.get(item, 0.0))
            ids = sorted(best)
            w = [best[i] for i in ids]
            got = ids, w, [max(w[k : k + self.block]) for k in range(0, len(w), self.block)], max(w)
            if len(self.lists) < 50_000:
                self.lists[slot] = got
        return got

    def matched(self, h: np.ndarray, known: np.ndarray) -> np.ndarray:
        """A row for each word: the terms that begin there by spacing, -1 for none."""
        low = np.uint64((1 << 22) - 1)
        if self.seen is None:  # most codes of other text are ruled out by their low bits
            self.seen = np.zeros(1 << 22, bool)
            self.seen[self.terms & low] = True
        out = np.full((len(h), len(SPACINGS)), -1, np.int64)
        for spacing, (part, (a, b)) in enumerate(zip(triple_codes(h), SPACINGS)):
            n = len(part)
            whole = np.flatnonzero(known[:n] & known[a : n + a] & known[b : n + b] & self.seen[part & low])
            if len(whole):
                at = np.minimum(np.searchsorted(self.terms, part[whole]), len(self.terms) - 1)
                same = self.terms[at] == part[whole]
                out[whole[same], spacing] = at[same]
        return out

    def promising(self, slots: np.ndarray, cells: np.ndarray, threshold: float) -> np.ndarray:
        """Of cells, given for each word in ascending order, those that together with the next cell can
        hold `threshold` of an item by its block's maxima."""
        word, spacing = np.nonzero(slots >= 0)
        term = slots[word, spacing]
        n = self.block_starts[term + 1] - self.block_starts[term]
        if not len(n) or not n.sum():
            return np.empty(0, np.int64)
        at = np.repeat(self.block_starts[term] - np.cumsum(n) + n, n) + np.arange(n.sum())

        def grouped(keys: np.ndarray, values: np.ndarray, how: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            return keys[first], how.reduceat(values[order], first)

        keys, most = grouped(np.repeat(word, n) * self.blocks + self.block_ids[at], self.block_most[at], np.maximum)
        keys, total = grouped(cells[keys // self.blocks] * self.blocks + keys % self.blocks, most, np.add)
        beside = np.minimum(np.searchsorted(keys, keys + self.blocks), len(keys) - 1)
        both = total + np.where(keys[beside] == keys + self.blocks, total[beside], 0.0)
        return np.unique(keys[both >= threshold] // self.blocks)

    def search(self, slots: set[tuple[int, ...]], threshold: float) -> dict[int, float]:
        """Items whose BM25 score for the query is at least the threshold, all of them."""
        lists = [self.posting(t) for t in slots]
        if sum(x[3] for x in lists) < threshold:
            return {}
        found: dict[int, float] = {}
        live = [[x[0][0], 0, x] for x in lists]  # current item, position, posting list
        while live:
            live.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(live):
                bound += c[2][3]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == item:
                pivot += 1
            near, edge = 0.0, 1 << 62
            for c in live[: pivot + 1]:
                ids, _, maxima, _ = c[2]
                at = bisect_left(ids, item, c[1])
                if at < len(ids):
                    of = at // self.block
                    near += maxima[of]
                    edge = min(edge, ids[min(len(ids), (of + 1) * self.block) - 1] + 1)
            if near >= threshold:
                if live[0][0] == item:
                    score = sum(c[2][1][c[1]] for c in live[: pivot + 1])
                    if score >= threshold:
                        found[item] = score
                    to = item + 1
                else:
                    to = item
            else:
                to = max(item + 1, min(edge, live[pivot + 1][0] if pivot + 1 < len(live) else edge))
            for c in live[: pivot + 1]:
                if c[0] < to:
                    c[1] = bisect_left(c[2][0], to, c[1])
                    c[0] = c[2][0][c[1]] if c[1] < len(c[2][0]) else -1
            live = [c for c in live if c[0] >= 0]
        return found

    def overlap(self, doc: list[int], places: dict[tuple[int, int, int], list[int]], item: int, least: int) -> tuple[int, int, int]:
        """(words, own words, own words that are equal) of the best chain of stretches in which the
        document follows the passage, isolated replaced words allowed."""
        passage = self.passages[item]
        offsets: Counter[int] = Counter()
        for d in (1, 2):
            for k, (a, b) in enumerate(zip(passage, passage[d:])):
                for at in places.get((a, b, d), ()):
                    offsets[at - k] += 1
        stretches = []
        for offset, n in offsets.items():
            if n >= least - 1:
                stretches += self._stretches(doc, item, offset, least)
        stretches.sort()
        best: list[tuple[int, int, int]] = []
        top = (0, 0, 0)
        for k, (a, b, at, own, equal) in enumerate(stretches):  # passage from a to b, document from at
            here = (b - a, own, equal)
            for j in range(k):
                a2, b2, at2, _, _ = stretches[j]
                end = at2 + b2 - a2
                if b2 <= a and end <= at <= end + 40 and best[j][0] + b - a > here[0]:
                    here = (best[j][0] + b - a, best[j][1] + own, best[j][2] + equal)
            best.append(here)
            top = max(top, here)
        return top

    def _stretches(self, doc: list[int], item: int, offset: int, least: int) -> list[tuple[int, int, int, int, int]]:
        passage, own, out, start, last, same = self.passages[item], self.own[item], [], -1, -2, 0

        def close() -> None:
            if start >= 0 and same >= least:
                mine = [k for k in range(start, last + 1) if own[k]]
                out.append((start, last + 1, start + offset, len(mine), sum(passage[k] == doc[k + offset] for k in mine)))

        for k in range(max(0, -offset), min(len(passage), len(doc) - offset)):
            if passage[k] == doc[k + offset]:
                if start < 0 or k - last > 2:
                    close()
                    start, same = k, 0
                last, same = k, same + 1
        close()
        return out


def _read(items: DataFrame) -> DataFrame:
    """(eval_id, passage, answer, n) with words parted by blanks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [words(p) for p in batch.passage]
            answers = [" ".join(words(a or "")) for a in batch.answer]
            yield pd.DataFrame({"eval_id": batch.eval_id, "passage": map(" ".join, read), "answer": answers, "n": map(len, read)})

    once = items.select(F.col("eval_id").cast("bigint"), "passage", "answer").where("eval_id is not null and passage is not null")
    return once.dropDuplicates(["eval_id"]).mapInPandas(run, "eval_id bigint, passage string, answer string, n int")


def _triples_of(passage: str) -> np.ndarray:
    return np.unique(np.concatenate(triple_codes(hashed(passage.split())))).view(np.int64)


def _codes_of(passage: str) -> np.ndarray:
    h = hashed(passage.split())
    return np.unique(np.concatenate([*triple_codes(h), pair_codes(h)])).view(np.int64)


def _coded(read: DataFrame, codes: Callable[[str], np.ndarray]) -> DataFrame:
    """(code): the codes of every passage, each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"code": np.concatenate([codes(p) for p in batch.passage])})

    return read.select("passage").mapInPandas(run, "code bigint")


def _codes(rows: list) -> dict[int, int]:
    return {r.code % (1 << 64): r["items"] for r in rows}


def leaks(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    step: int = 128,
    shortest: int = 20,
    own: int = 8,
    stretch: int = 6,
    shared: float = 0.02,
    part_bytes: int = 2_000_000,
) -> DataFrame:
    """(eval_id, key, n_words, score, answer_words) of documents that reproduce at least
    `shortest` words of an item's passage in order, of which at least `own` aren't wording that
    over a share `shared` of the items (and over five) have in common. If the document also has four
    fifths of the answer in a row, half as many of them do.

    Isolated replaced words count as reproduced, but half of `own` must be equal; a chain may be
    interrupted by up to 40 foreign words, its stretches having at least `stretch` equal words. Passages of
    two steps overlap by one, so one holds every chain that has what `sure` names within `step` words; a
    chain misses that if its own words are thinner, or by words replaced closer to each other than that.
    Null and empty texts or passages leak nothing; repeated items and documents count once;
    rows without a key are left out. The items are met in parts of about part_bytes."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    read, at_read = written(_read(items))
    size = read.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("words"), F.sum(F.length("passage") + F.length("answer")).alias("bytes")).first()
    total, mean = size.n, max(1.0, (size["words"] or 0) / max(1, size.n))
    parts = max(1, -(-(size["bytes"] or 0) // part_bytes))
    counted = _coded(read, _codes_of).groupBy("code").agg(F.count(F.lit(1)).alias("items")).where("items > 1")
    frequencies, at_codes = written(counted)
    # Passages of w words on average have at most 5 * w / shared such codes, however many items there are.
    common = _codes(frequencies.where(F.col("items") > max(5, shared * total)).collect())
    out = None
    for part in range(parts):
        mine = read.where(F.pmod(F.xxhash64("eval_id"), F.lit(parts)) == part)
        known = frequencies
        if parts > 1:
            known = frequencies.join(_coded(mine, _triples_of).distinct(), "code", "left_semi")
        index = spark.sparkContext.broadcast(
            ItemIndex(
                sorted((r.eval_id, r.passage.split(), r.answer.split()) for r in mine.collect()),
                _codes(known.collect()),
                total,
                mean,
                set(common),
                sure(shortest, own, stretch),
            )
        )

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            x: ItemIndex = index.value
            for batch in batches:
                rows, held, size = [], [], 0
                for k, value in zip(batch[key], batch[text]):
                    if not value:
                        continue
                    readings = [value]
                    if "-" in value and BROKEN_WORD.search(value):
                        readings.append(BROKEN_WORD.sub("", value))
                    for reading in readings:
                        doc = [x.vocab.get(w, -1) for w in words(reading)]
                        held.append((k, doc))
                        size += len(doc)
                    if size > 500_000:
                        rows += leaked(x, held)
                        held, size = [], 0
                rows += leaked(x, held)
                yield pd.DataFrame(rows, columns=["eval_id", key, "n_words", "score", "answer_words"])

        def leaked(x: ItemIndex, held: list[tuple[int, list[int]]]) -> list[tuple]:
            if not held or not len(x.terms):
                return []
            ids = np.array([w for _, doc in held for w in (*doc, -1, -1, -1, -1)], np.int64)
            lengths = np.array([len(doc) + 4 for _, doc in held])
            n_cells = -(-lengths // step) + 1  # an empty one parts the documents
            begins, firsts = np.cumsum(lengths) - lengths, np.cumsum(n_cells) - n_cells
            cells = np.repeat(firsts, lengths) + (np.arange(len(ids)) - np.repeat(begins, lengths)) // step
            slots = x.matched(x.hashes[ids], ids >= 0)
            candidates: dict[int, dict[int, float]] = {}
            for cell in x.promising(slots, cells, 0.999).tolist():
                of = int(np.searchsorted(firsts, cell, "right")) - 1
                a = begins[of] + (cell - firsts[of]) * step
                query = {t for t in map(tuple, slots[a : min(a + 2 * step, begins[of] + lengths[of])].tolist()) if max(t) >= 0}
                for item, score in x.search(query, 0.999999).items():
                    mine = candidates.setdefault(of, {})
                    mine[item] = max(score, mine.get(item, 0.0))
            return [row for of, met in candidates.items() for row in verified(x, *held[of], met)]

        def verified(x: ItemIndex, k: int, doc: list[int], candidates: dict[int, float]) -> Iterator[tuple]:
            places: dict[tuple[int, int, int], list[int]] = defaultdict(list)
            for d in (1, 2):
                for at, (a, b) in enumerate(zip(doc, doc[d:])):
                    if a >= 0 and b >= 0:
                        places[a, b, d].append(at)
            for item, score in candidates.items():
                n, n_own, n_equal = x.overlap(doc, places, item, stretch)
                if n < shortest or n_equal < own / 2:
                    continue
                answer = _longest(x.answers[item], doc)
                if n_own >= own or answer >= max(stretch, 0.8 * len(x.answers[item])):
                    yield x.ids[item], k, n, score * x.least[item], answer

        wanted = spread(docs.select(key, text).where(f"{key} is not null and {text} is not null"))
        found = wanted.mapInPandas(run, f"eval_id bigint, {key} {kind}, n_words int, score double, answer_words int")
        out = found if out is None else out.unionByName(found)
    for path in (at_read, at_codes):
        discard(spark, path)
    return out.groupBy("eval_id", key).agg(
        F.max("n_words").alias("n_words"), F.max("score").alias("score"), F.max("answer_words").alias("answer_words")
    )


def _longest(answer: list[int], doc: list[int]) -> int:
    """The longest run of the answer's words in the document."""
    at: dict[int, list[int]] = defaultdict(list)
    for k, word in enumerate(answer):
        at[word].append(k)
    best, ends = 0, {}
    for word in doc:
        then = {}
        for k in at.get(word, ()):
            then[k] = ends.get(k - 1, 0) + 1
            best = max(best, then[k])
        ends = then
    return best
