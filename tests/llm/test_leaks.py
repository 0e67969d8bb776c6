import random

from kilnwork.llm import leaks

WORDS = [f"w{k}ord" for k in range(4000)]


def passage(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def make(n_items=60):
    rng = random.Random(3)
    shared = "read the finding below and choose the best fix for it now please my dear old friend of the house there"
    items = [(k, (shared + " " if k % 3 == 0 else "") + passage(rng, 80), passage(rng, 10)) for k in range(n_items)]
    docs = []

    def noise(n):
        return passage(rng, n)

    def put(quote):
        docs.append((1000 + len(docs), noise(150) + " " + quote + " " + noise(150)))
        return docs[-1][0]

    words = {k: leaks.words(p) for k, p, _ in items}
    want = set()
    for k in (1, 2, 4, 5):
        at = 20
        want.add((k, put(" ".join(words[k][at : at + 20]))))
        replaced = [w if i % 6 != 4 else "other" for i, w in enumerate(words[k][at : at + 30])]
        want.add((k, put(",\n ".join(replaced).upper())))
        put(" ".join(words[k][at : at + 14]))
    put(shared)
    want.add((7, put(" ".join(words[7]).replace("o", "о"))))
    return items, docs, want


ITEMS = "eval_id bigint, passage string, answer string, doc_id bigint"
DOCS = "doc_id bigint, text string, eval_id bigint, n_words int"


def run(spark, items, docs, **more):
    i = spark.createDataFrame([(*x, 5) for x in items], ITEMS)
    d = spark.createDataFrame([(*x, 5, 5) for x in docs], DOCS)
    return {(r.eval_id, r.doc_id) for r in leaks.leaks(d, i, **more).collect()}


def test_leaks(spark):
    items, docs, want = make()
    assert run(spark, items + items[:2], docs + [docs[0], (None, docs[0][1]), (1, None), (2, "")]) == want


def test_parts_give_the_same(spark):
    items, docs, want = make()
    for size in (10_000, 17_000):
        assert run(spark, items, docs, part_bytes=size) == want


def test_every_third_or_fourth_word_replaced(spark):
    items, docs, want = make()
    passage_words = leaks.words(items[8][1])
    for every, n in ((3, 40), (4, 30)):
        quote = [w if k % every != every - 1 else "other" for k, w in enumerate(passage_words[10 : 10 + n])]
        docs.append((5000 + every, "Intro here. " + " ".join(quote) + " and so on"))
    assert run(spark, items, docs) == want | {(8, 5003), (8, 5004)}


def test_answer_counts_where_few_words_are_own(spark):
    """24 words of wording that all share and six own ones: a leak only beside the answer."""
    rng = random.Random(11)
    shared = passage(rng, 24)
    items = [(k, shared + " " + passage(rng, 40), passage(rng, 10)) for k in range(20)]
    quote = " ".join((shared + " " + items[4][1][len(shared) :]).split()[:30])
    docs = [(100, quote + " . " + passage(rng, 50)), (101, quote + " . " + passage(rng, 50) + " " + items[4][2]), (102, shared + " " + items[4][2])]
    assert run(spark, items, docs) == {(4, 101)}


def brute_force(items, docs):
    """Verification of every document against every item, without the index's scores."""
    from collections import Counter, defaultdict

    read = [(i, leaks.words(p), leaks.words(a)) for i, p, a in items]
    counts = Counter(c for _, p, _ in read for h in [leaks.hashed(p)] for c in {*leaks.pair_codes(h).tolist()})
    common = {c for c, n in counts.items() if n > max(5, 0.02 * len(read))}
    x = leaks.ItemIndex(read, {}, len(read), 80.0, common)
    found = set()
    for k, text in docs:
        doc = [x.vocab.get(w, -1) for w in leaks.words(text)]
        places = defaultdict(list)
        for d in (1, 2):
            for at, pair in enumerate(zip(doc, doc[d:])):
                if min(pair) >= 0:
                    places[(*pair, d)].append(at)
        for item, i in enumerate(x.ids):
            n, own, equal = x.overlap(doc, places, item, 6)
            if n >= 20 and equal >= 4 and (own >= 8 or leaks._longest(x.answers[item], doc) >= 8):
                found.add((i, k))
    return found


def test_index_loses_nothing(spark):
    """Quotations cut up, with replaced words and foreign words between, in many-worded and few-worded items."""
    rng = random.Random(12)
    for vocabulary, n in ((WORDS, 30), (WORDS[:150], 7)):
        items = [(k, " ".join(rng.choice(vocabulary) for _ in range(70)), "") for k in range(n)]
        docs = []
        for k in range(150):
            quote = rng.choice(items)[1].split()
            at, out = rng.randrange(40), []
            for _ in range(rng.randrange(1, 4)):
                part = quote[at : at + rng.randrange(6, 16)]
                every = rng.choice((3, 4, 5, 99))
                out += [w if j % every != every - 1 else rng.choice(vocabulary) for j, w in enumerate(part)]
                out += [rng.choice(vocabulary) for _ in range(rng.choice((0, 12, 38)))]
                at += len(part)
            docs.append((1000 + k, " ".join([rng.choice(vocabulary) for _ in range(rng.randrange(500))] + out)))
        want = brute_force(items, docs)
        assert len(want) > 20
        assert run(spark, items, docs) == want
        assert run(spark, items, docs, part_bytes=2500) == want


def test_empty(spark):
    items, docs, _ = make()
    assert run(spark, [], docs) == set()
    assert run(spark, items, []) == set()
    assert run(spark, [(1, None, None), (2, "", "")], docs) == set()


def test_search_is_exhaustive():
    import numpy as np

    rng = random.Random(8)
    small = WORDS[:40]
    items = [(k, [rng.choice(small) for _ in range(60)], []) for k in range(300)]
    index = leaks.ItemIndex(items, {}, 300, 60.0, set(), block=4)
    for _ in range(60):
        h = leaks.hashed([rng.choice(small) for _ in range(300)])
        slots = index.matched(h, np.ones(len(h), bool))
        query = {t for t in map(tuple, slots.tolist()) if max(t) >= 0}
        scores = {}
        for slot in query:
            for i, w in zip(*index.posting(slot)[:2]):
                scores[i] = scores.get(i, 0) + w
        for threshold in (0.3, 0.6, 1.1):
            want = {i for i, s in scores.items() if s >= threshold}
            assert set(index.search(query, threshold)) == want
            assert not want or index.promising(slots, np.zeros(len(h), np.int64), threshold).tolist() == [0]


def test_few_items(spark):
    passages = [" ".join(f"{c}word{k}" for k in range(30)) for c in "abc"]
    docs = spark.createDataFrame([(k, "Intro. " + " ".join(p.split()[4:26]) + " End.") for k, p in enumerate(passages)], "doc_id bigint, text string")
    for n in (1, 2, 3):
        items = spark.createDataFrame([(k, p, "") for k, p in enumerate(passages[:n])], "eval_id bigint, passage string, answer string")
        assert {(r.eval_id, r.doc_id, r.n_words) for r in leaks.leaks(docs, items).collect()} == {(k, k, 22) for k in range(n)}
