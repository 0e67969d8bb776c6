import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kilnwork.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30), st.sampled_from([64, 100, 257]), st.sampled_from([8, 64]))
def test_plan_places_every_item_once(histogram, capacity, resolution):
    plan = packing.make_plan(histogram, capacity, resolution)
    fill, n = Counter(), 0
    for size, count in histogram.items():
        at = plan.containers_of(np.full(count, size), np.arange(count))
        for container in at.tolist():
            fill[container] += size
            n += 1
    assert n == sum(histogram.values())
    assert not fill or max(fill.values()) <= capacity
    assert set(fill) == set(range(plan.containers))


def test_nnls_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((12, 20)), rng.random(12)
        x = packing.nnls(a, b)
        gradient = a.T @ (a @ x - b)
        assert (x >= 0).all() and (gradient > -1e-6).all() and abs(gradient[x > 1e-9]).max(initial=0) < 1e-6


def test_fill_is_near_the_bound():
    rng = random.Random(2)
    histogram = Counter(min(512, max(1, int(rng.lognormvariate(4.5, 0.9)))) for _ in range(20_000))
    plan = packing.make_plan(dict(histogram), 512)
    assert sum(s * n for s, n in histogram.items()) / (plan.containers * 512) > 0.99


def test_pack(spark):
    texts = [(k, "word " * (k % 40)) for k in range(300)] + [(900, "word " * 5000), (901, None), (902, ""), (3, "word " * 3), (None, "x")]
    texts = [t for t in texts if t[0] != 3] + [(3, "word " * 3)]
    df = spark.createDataFrame([(k, t, 1, 1) for k, t in texts], "doc_id bigint, text string, piece int, n_tokens int")
    rows = packing.pack(df, {7: 64, 8: 128}).collect()
    counts = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    for capacity_id, capacity in ((7, 64), (8, 128)):
        mine = [r for r in rows if r.capacity_id == capacity_id]
        fill, have = Counter(), Counter()
        for r in mine:
            fill[r.container_id] += r.n_tokens
            have[r.doc_id] += r.n_tokens
            assert r.start_token == r.piece * capacity
            assert r.piece == 0 or counts[r.doc_id] > capacity
        assert max(fill.values()) <= capacity
        assert have == counts and {901, 902} <= set(have)
        least = -(-sum(counts.values()) // capacity)
        assert len(fill) <= 1.05 * least + 1


def test_pack_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(df, {1: 64}).count() == 0
    assert packing.pack(df, {}).count() == packing.pack(df, {1: 0, 2: None}).count() == 0
