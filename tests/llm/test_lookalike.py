import itertools
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from kilnwork.llm import lookalike as look


def test_automaton_costs():
    trie = look.Trie()
    for word, n in (("bucket", 5), ("basket", 9), ("é", 1)):
        trie.add(word, n)
    assert trie.meet("buckеt") == [(0.0, 5, "bucket")]  # a Cyrillic letter
    assert trie.meet("b​uck­et") == [(0.0, 5, "bucket")]
    assert trie.meet("ｂｕｃｋｅｔ") == [(0.0, 5, "bucket")]
    assert trie.meet("é") == [(0.0, 1, "é")]
    assert trie.meet("bucker") == []
    assert {(c, s) for c, _, s in trie.meet("busket", most=1.0)} == {(1.0, "basket"), (1.0, "bucket")}


def test_table_form():
    assert look.skeleton("ﬁle ａ１ premiѐre") == "file a1 première"
    assert look.skeleton("рremiѐre") == "première"
    assert look.skeleton("ｶﾞ") == "ガ"
    for pair in ("x²|x2", "l|1", "O|0", "e|é", "I|l", "rn|m"):
        a, b = pair.split("|")
        assert look.skeleton(a) != look.skeleton(b)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_form_is_stable(text):
    once = look.skeleton(text)
    assert look.skeleton(once) == once
    assert look.canonical_text(look.canonical_text(text)) == look.canonical_text(text)


SCHEMA = "doc_id bigint, text string, canonical string, token string, class_id string"
TEXTS = [
    (1, "the bucket is full\nsecond  line"),
    (2, "the buckеt is full\nsecond line"),
    (3, "the buсket is full\r\nsecond line "),
    (4, "the bucket is full\nsecond  line"),
    (5, "the bucket is fu11\nsecond line"),
    (6, ""),
    (7, "​"),
    (8, None),
    (9, "оценка хранит"),
    (10, "oценка хранит"),
    (None, "the bucket is full"),
    (11, "ценa"),
    (12, "цена"),
    (12, "цена"),
]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(k, t, "x", "x", "x") for k, t in rows], SCHEMA)


def test_pairs_against_brute_force(spark):
    def form(t):
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Cf")
        return look.canonical_text(unicodedata.normalize("NFC", t.translate(look.LOOK)))

    known = {(k, t) for k, t in TEXTS if k is not None and t}
    want = {
        (a, b)
        for (a, s), (b, t) in itertools.product(known, known)
        if a < b and s != t and form(s) == form(t) != ""
    }
    assert {tuple(r) for r in look.visual_pairs(frame(spark)).collect()} == want
    assert (1, 4) not in want and (9, 10) in want


def test_canonical_spelling_is_the_frequent_clean_one(spark):
    got = {r.doc_id: r.canonical for r in look.canonical_texts(frame(spark)).collect()}
    assert got[10] == got[9] == "оценка хранит"
    assert got[11] == "цена"
    assert got[2] == "the bucket is full\nsecond line"
    assert got[8] is None and got[6] == ""


def test_trie_joins_what_the_table_misses(spark):
    """Nearly alike letters in words of mixed scripts; words of one script stay apart from them."""
    rows = [(1, "the worker waits"), (2, "the wоrкer waits"), (3, "мак или mak"), (4, "мак или мак"), (5, "mak или mak"), (6, "the wоrxer waits")]
    assert look.skeleton(rows[0][1]) != look.skeleton(rows[1][1])
    for few in (200_000, 0):  # spellings broadcast, and joined by document
        assert {tuple(r) for r in look.visual_pairs(frame(spark, rows), most_broadcast=few).collect()} == {(1, 2)}


def test_words_keep_their_script(spark):
    """The table alone spells a Cyrillic word in Latin letters; the trie knows the clean word."""
    rows = [(1, "сор в доме"), (2, "сoр в доме"), (3, "a cop in town"), (4, "рот"), (5, "рoт")]
    for few in (200_000, 0):
        got = {r.doc_id: r.canonical for r in look.canonical_texts(frame(spark, rows[:2] + rows[3:]), most_broadcast=few).collect()}
        assert got == {1: "сор в доме", 2: "сор в доме", 4: "рот", 5: "рот"}
        got = {r.doc_id: r.canonical for r in look.canonical_texts(frame(spark, rows), most_broadcast=few).collect()}
        assert got[1] == got[2] == "cop в доме" and got[3] == "a cop in town"


def test_slices_give_the_same(spark):
    vocab = look.vocabulary(frame(spark), "text")
    every = {tuple(r) for r in look.spellings(vocab).collect()}
    assert every == {tuple(r) for r in look.spellings(vocab, slice_rows=1).collect()} != set()


def test_copies_of_two_ways(spark):
    rows = [(k, "one wоrd" if k % 3 == 0 else "one word") for k in range(12)]
    want = {(a, b) for a in range(12) for b in range(a + 1, 12) if (a % 3 == 0) != (b % 3 == 0)}
    assert {tuple(r) for r in look.visual_pairs(frame(spark, rows)).collect()} == want


def test_empty_table(spark):
    assert look.visual_pairs(frame(spark, [])).count() == 0


def test_very_long_text(spark):
    rows = [(1, "wоrd " * 60_000), (2, "word " * 60_000)]
    assert look.visual_pairs(frame(spark, rows)).count() == 1


def test_ignorables_beyond_the_basic_plane():
    for sign in ("\U000e0100", "\U000e01ef", "\U000e0001", "\U000e0041", "\U000e007f"):
        assert look.skeleton(f"ke{sign}y é") == look.skeleton("key é")
    assert look.skeleton("a\U000110bd1") != look.skeleton("a1")
