"""One consistent form for texts that look the same.

Every distinct token that isn't plain ASCII is read against tries of the clean spellings that occur,
by a weighted edit automaton: look-alikes, width and ignorables cost nothing, letters that are nearly
alike a little, any other edit more than may be spent. The cheapest, then plainest, then most frequent
spelling it meets is the token's. Tokens that meet none get their form from the table. Tries are built over
bounded, sorted slices of the vocabulary, never over the whole of it, so the vocabulary may grow with the
corpus. What is carried back to the texts is only where a spelling isn't what the token says by itself."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilnwork.runtime import cut, discard, small_enough, spread, written

# Letters of other scripts and the Latin letters that look like them.
OTHER = "авеорсухіјѕһԁԛԝӏАВЕЗІЈКМНОРСТХУЅԚԜοΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
LATIN = "aвeopcyxijshdqwlABEЗIJKMHOPCTXYSQWoABEZHIKMNOPTYX"
HYPHENS = "‐‑"
# Letters that nearly look like a Latin one. They count only in words of mixed scripts.
NEARLY = "к k, м m, т t, г r, п n, ь b, α a, γ y, η n, ι i, κ k, ν v, ρ p, τ t, υ u, χ x, ω w, ɑ a, ɡ g, ı i"
# Format characters that are drawn.
DRAWN_FORMATS = frozenset(map(chr, [*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD, *range(0x13430, 0x13440)]))
MARKS = r"̀-゙゚ͯ"


@cache
def ignorable() -> frozenset[str]:
    """Characters that draw nothing: format characters, joiners' grapheme glue, variation selectors."""
    formats = {c for c in map(chr, [*range(0x20000), *range(0xE0000, 0xE1000)]) if unicodedata.category(c) == "Cf"} - DRAWN_FORMATS
    return frozenset(formats | {"͏"} | set(map(chr, [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)])))


@cache
def width_table() -> dict[int, str]:
    """Width variants, blanks and ligatures to their plain form, by Unicode's own decompositions."""
    table: dict[int, str] = {}
    for code in range(0x80, 0x10000):  # none beyond
        char = chr(code)
        kind, _, codes = unicodedata.decomposition(char).partition("> ")
        if unicodedata.category(char) == "Zs":
            table[code] = " "
        elif kind in ("<wide", "<narrow") or 0xFB00 <= code <= 0xFB06:
            table[code] = "".join(chr(int(x, 16)) for x in codes.split())
    table.update(dict.fromkeys(map(ord, HYPHENS), "-"))
    return table


@cache
def plain_table() -> dict[int, str | None]:
    """width_table, and nothing for ignorables."""
    return width_table() | dict.fromkeys(map(ord, ignorable()))


LOOK = str.maketrans(OTHER, LATIN)
NEAR = str.maketrans(dict(pair.split() for pair in NEARLY.split(",")))


@cache
def token_pattern() -> re.Pattern[str]:
    codes = set(map(ord, ignorable()))
    # As ranges: single characters beyond the basic plane are tried one by one.
    firsts, lasts = sorted(c for c in codes if c - 1 not in codes), sorted(c for c in codes if c + 1 not in codes)
    drawn_nothing = "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(firsts, lasts))
    return re.compile(rf"(?:[^\W_]|[{MARKS}{drawn_nothing}])+")


def skeleton(text: str) -> str:
    """The table's form: equal for all texts that look the same."""
    if text.isascii():
        return text
    plain = unicodedata.normalize("NFD", text.translate(plain_table()))
    return unicodedata.normalize("NFC", plain.translate(LOOK))


def near_form(form: str) -> str:
    """Equal for all table forms that differ in nearly alike letters only."""
    if form.isascii():
        return form
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", form).translate(NEAR))


@cache
def script_of(char: str) -> str | None:
    if not char.isalpha():
        return None
    if char.isascii():
        return "LATIN"
    word = unicodedata.name(char, "?").split()[0].partition("-")[0]
    return "KANA" if word in ("HIRAGANA", "KATAKANA", "CJK") else word


def scripts(text: str) -> set[str]:
    return {s for s in map(script_of, text) if s}


def is_clean(token: str) -> bool:
    """A spelling that a canonical one may be chosen from: composed, plain, of one script."""
    if token.isascii():
        return True
    return (
        unicodedata.normalize("NFC", token) == token
        and token.translate(plain_table()) == token
        and len(scripts(token)) <= 1
    )


class Trie:
    """Spellings by their decomposed characters; a node's spelling ends there."""

    __slots__ = ("next", "spelling", "count")

    def __init__(self) -> None:
        self.next: dict[str, Trie] = {}
        self.spelling: str | None = None
        self.count = 0

    def add(self, spelling: str, count: int) -> None:
        node = self
        for char in unicodedata.normalize("NFD", spelling):
            node = node.next.setdefault(char, Trie())
        node.spelling, node.count = spelling, node.count + count

    def meet(self, token: str, most: float = 0.0, edit: float = 1.0, nearly: float = 0.25) -> list[tuple[float, int, str]]:
        """(cost, count, spelling) of the spellings within cost `most`. The automaton's states are
        trie nodes with the least cost at which they are reached. An ignorable costs nothing and
        stays; a look-alike or width variant costs nothing; a nearly alike letter `nearly`; any
        other edit `edit`."""
        units = unicodedata.normalize("NFD", token.translate(width_table()))
        live: dict[int, tuple[Trie, float]] = {}

        def reach(into: dict, node: Trie, cost: float) -> None:
            if cost > most:
                return
            known = into.get(id(node))
            if known is None or cost < known[1]:
                into[id(node)] = (node, cost)
                if cost + edit <= most:
                    for child in node.next.values():
                        reach(into, child, cost + edit)

        reach(live, self, 0.0)
        nothing = ignorable()
        for unit in units:
            if unit in nothing:
                continue
            then: dict[int, tuple[Trie, float]] = {}
            drawn = unit.translate(LOOK)
            about = drawn.translate(NEAR)
            for node, cost in live.values():
                for char, child in node.next.items():
                    seen = char.translate(LOOK)
                    reach(then, child, cost + (0.0 if seen == drawn else nearly if seen.translate(NEAR) == about else edit))
                reach(then, node, cost + edit)
            live = then
            if not live:
                return []
        return [(cost, node.count, node.spelling) for node, cost in live.values() if node.spelling is not None]


MOST = 0.75  # three nearly alike letters


def choose(met: list[tuple[float, int, str]], table_form: str) -> str:
    """The canonical spelling: the cheapest of what was met, an ASCII one first, then the most frequent,
    then the smallest; the table's form if nothing was."""
    return min(met, key=lambda m: (m[0], not m[2].isascii(), -m[1], m[2]))[2] if met else table_form


def by_itself(token: str) -> str:
    """What a token is spelled as if the vocabulary says nothing else."""
    return token if is_clean(token) else skeleton(token)


PLAIN_TOKENS = re.compile(r"[^\W_]+", re.ASCII)


def vocabulary(docs: DataFrame, text: str, flush: int = 200_000) -> DataFrame:
    """(token, form, near, n): the corpus's distinct tokens, counted before they are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()

        def out() -> pd.DataFrame:
            tokens = list(seen)
            forms = [skeleton(t) for t in tokens]
            return pd.DataFrame({"token": tokens, "form": forms, "near": map(near_form, forms), "n": list(seen.values())})

        find = token_pattern().findall
        for batch in batches:
            for value in batch[text]:
                if value:
                    seen.update(PLAIN_TOKENS.findall(value) if value.isascii() else find(value))
                if len(seen) >= flush:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    counted = spread(docs.select(text)).mapInPandas(run, "token string, form string, near string, n bigint")
    return counted.groupBy("token", "form", "near").agg(F.sum("n").alias("n"))


def slice_spellings(part: list[tuple[str, str, str, int]]) -> list[tuple[str, str]]:
    """(token, spelling) of (token, form, near, n), all tokens of one `near` together, where the spelling
    isn't what the token says by itself.

    Tokens of one form get one spelling. Nearly alike letters count for a form only if each of its tokens
    mixes scripts, so that none of them is a word by itself."""
    groups: dict[str, list[tuple[str, str, int]]] = {}
    for token, form, near, n in part:
        groups.setdefault(near, []).append((token, form, n))
    trie, asked = Trie(), []
    for rows in groups.values():
        if len(rows) == 1 and is_clean(rows[0][0]) or all(t.isascii() for t, _, _ in rows):
            continue  # nothing to choose between
        forms: dict[str, list[str]] = {}
        for token, form, n in rows:
            forms.setdefault(form, []).append(token)
            if is_clean(token):
                trie.add(token, n)
        asked += forms.items()
    found = []
    for form, tokens in asked:
        mixed = all(len(scripts(t.translate(plain_table()))) > 1 for t in tokens)
        spelling = choose(trie.meet(tokens[0], MOST if mixed else 0.0), form)
        found += [(t, spelling) for t in tokens if not t.isascii() and by_itself(t) != spelling]
    return found


def spellings(vocab: DataFrame, slice_rows: int = 20_000) -> DataFrame:
    """(token, spelling) of slice_spellings. All tokens of one `near` meet in one partition, sorted; a trie
    holds the clean spellings of about slice_rows tokens, and ends only where `near` changes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part: list[tuple[str, str, str, int]] = []
        for batch in batches:
            found = []
            for row in zip(batch.token, batch.form, batch.near, batch.n):
                if len(part) >= slice_rows and row[2] != part[-1][2]:
                    found += slice_spellings(part)
                    part = []
                part.append(row)
            yield pd.DataFrame(found, columns=["token", "spelling"])
        yield pd.DataFrame(slice_spellings(part), columns=["token", "spelling"])

    parts = max(1, int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    together = vocab.repartition(parts, "near").sortWithinPartitions("near", "form", "token")
    return together.mapInPandas(run, "token string, spelling string")


BLANKS = re.compile(r"[ \t]+")
LINE_END = re.compile(r" *(?:\r\n|\r|\n)")


def canonical_text(text: str, spelled: dict[str, str] | None = None, known: dict[str, str] | None = None) -> str:
    """Tokens by their canonical spelling, else by the table; one blank for any run of blanks.
    known: tokens' spellings that are kept between texts."""
    if not text.isascii():
        known = {} if known is None else known
        if len(known) > 500_000:
            known.clear()

        def spell(m: re.Match[str]) -> str:
            token = m.group()
            if token.isascii():
                return token
            if spelled and token in spelled:
                return spelled[token]
            out = known.get(token)
            if out is None:
                out = known[token] = by_itself(token)
            return out

        text = unicodedata.normalize("NFC", token_pattern().sub(spell, text).translate(plain_table()))
    return LINE_END.sub("\n", BLANKS.sub(" ", text)).strip(" \n")


def _spelled_texts(docs: DataFrame, key: str, text: str, most_broadcast: int) -> tuple[DataFrame, dict[str, str] | None]:
    """The rows with a column `spelled` and None, or the rows and all spellings if they are few."""
    spelled, at = written(spellings(vocabulary(docs, text)))
    if small_enough(spelled, most_broadcast):
        few = {r.token: r.spelling for r in spelled.collect()}
        discard(docs.sparkSession, at)
        return spread(docs.select(key, text)), few

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, token)
                for k, value in zip(batch[key], batch[text])
                if value and not value.isascii()
                for token in set(token_pattern().findall(value))
                if not token.isascii()
            ]
            yield pd.DataFrame(rows, columns=[key, "token"])

    kind = dict(docs.dtypes)[key]
    plain = spread(docs.select(key, text))
    wanted = plain.where(f"{key} is not null and {text} is not null").mapInPandas(needed, f"{key} {kind}, token string")
    per_doc = wanted.join(spelled, "token").groupBy(key)
    per_doc = per_doc.agg(F.map_from_entries(F.collect_set(F.struct("token", "spelling"))).alias("spelled"))
    return plain.join(per_doc, key, "left"), None


def _canonical(docs: DataFrame, key: str, text: str, most_broadcast: int, hashed: bool) -> DataFrame:
    rows, few = _spelled_texts(docs, key, text, most_broadcast)
    kind, everywhere = dict(docs.dtypes)[key], docs.sparkSession.sparkContext.broadcast(few)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, str] = {}
        for batch in batches:
            own = batch["spelled"] if "spelled" in batch else [None] * len(batch)
            spelled = [everywhere.value if s is None else dict(s) for s in own]
            forms = [None if t is None else canonical_text(t, s, known) for t, s in zip(batch[text], spelled)]
            if hashed:
                seen = [(k, md5(f), md5(t)) for k, f, t in zip(batch[key], forms, batch[text]) if f and k is not None]
                yield pd.DataFrame(seen, columns=[key, "class_id", "variant_id"])
            else:
                yield pd.DataFrame({key: batch[key], text: batch[text], "canonical": forms})

    shape = "class_id string, variant_id string" if hashed else f"{text} string, canonical string"
    return rows.mapInPandas(apply, f"{key} {kind}, {shape}")


def md5(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def canonical_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", most_broadcast: int = 200_000) -> DataFrame:
    """(key, text, canonical), one row per input row.

    A null text stays null, an empty one empty. A row without a key is spelled like the others, but if
    spellings are joined by key (more than most_broadcast of them), by the table.
    Line breaks become line feeds, runs of blanks one blank, blanks at line ends and around the
    text go. Repeated keys share their texts' spellings. Other columns are left out."""
    return _canonical(docs, key, text, most_broadcast, False)


def visual_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", most_broadcast: int = 200_000) -> DataFrame:
    """(key, class_id, variant_id) of documents that look like another, differently written one.
    Texts without anything visible look like nothing and are in no class."""
    hashed = cut(_canonical(docs, key, text, most_broadcast, True).distinct())
    mixed = (
        hashed.groupBy("class_id")
        .agg(F.min("variant_id").alias("a"), F.max("variant_id").alias("b"))
        .where("a <> b")
        .select("class_id")
    )
    return hashed.join(mixed, "class_id", "left_semi")


def visual_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", most_broadcast: int = 200_000) -> DataFrame:
    """(key_a, key_b) of documents in one class whose texts differ as written, the smaller key
    first. Ways of writing meet first, documents after, so copies of one text never meet each other."""
    classes = cut(visual_classes(docs, key, text, most_broadcast))
    ways = classes.select("class_id", "variant_id").distinct()
    a, b = (ways.select("class_id", F.col("variant_id").alias(f"v{t}")) for t in "ab")
    unlike = a.join(b, "class_id").where("va < vb").drop("class_id")
    for t in "ab":
        unlike = unlike.join(classes.select(F.col("variant_id").alias(f"v{t}"), F.col(key).alias(f"_{t}")), f"v{t}")
    ends = [F.least("_a", "_b").alias(f"{key}_a"), F.greatest("_a", "_b").alias(f"{key}_b")]
    return unlike.where("_a <> _b").select(*ends).distinct()
