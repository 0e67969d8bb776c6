from datetime import datetime, timedelta

from pyspark.sql import functions as F

from kilnwork.llm import linkage

T = datetime(2026, 3, 1, 12)
A = "id bigint, repo string, path string, line int, time timestamp, rule string, weak array<int>, y double, confidence int"


def run(spark, left, right, **more):
    a = spark.createDataFrame([(*x, 1.0, 1) for x in left], A)
    b = spark.createDataFrame([(*x, 1.0, 1) for x in right], A)
    side = linkage.Side("id", "repo", "path", "line", "time", F.col("rule"), F.col("weak"))
    out = linkage.link(a, b, side, side, **more)
    return {(r.id_a, r.id_b): r.confidence for r in out.collect()}


def test_links(spark):
    m = timedelta(minutes=1)
    right = [
        (101, "own/red-fox-app", "a/x.py", 10, T, "sql", [89]),
        (102, "own/red-fox-app", "a/x.py", 12, T, "sql", [89]),  # a rival
        (103, "own/red-fox-app", "a/y.py", 50, T, "shell", [78]),
        (104, "other/red-fox-app", "a/z.py", 7, T, "shell", [78]),
        (105, "own/blue-owl-app", "a/q.py", 30, T, "sql", [89]),
        (105, "own/blue-owl-app", "a/q.py", 30, T, "sql", [89]),
        (106, None, "a/q.py", 30, T, "sql", [89]),
    ]
    left = [
        (1, "red-fox-app-main.zip", "/src/a\\x.py", 10, T + 3 * m, "B1", [89]),
        (2, "git@h.invalid:own/red-fox-app.git", "./A/Y.py", 51, None, "B2", [78]),
        (3, "own/red-fox-app", "a/z.py", 7, T, "B2", [78]),  # another owner
        (4, "blue_owl_app", "a/q.py", 30, T + 60 * m, "B1", [89]),  # a clock an hour off
        (5, "own/blue-owl-app", "a/q.py", 30, T + 5000 * m, "B1", [89]),  # another scan
        (6, "own/red-fox-app", "a/y.py", 50, T, "B1", [89]),  # another weakness
        (7, "own/red-fox-app", None, 50, T, "B2", [78]),
        (1, "red-fox-app-main.zip", "/src/a\\x.py", 10, T + 3 * m, "B1", [89]),
    ]
    got = run(spark, left, right)
    assert set(got) == {(1, 101), (2, 103), (4, 105)}
    assert all(0.5 <= v <= 1 for v in got.values())


def test_swapped_letters(spark):
    right = [(101, "own/red-fox-app", "a/x.py", 10, T, "sql", [89])]
    assert set(run(spark, [(1, "rde-fox-app", "a/x.py", 11, T, "B1", [89])], right)) == {(1, 101)}


def test_empty(spark):
    row = (1, "own/red-fox-app", "a/x.py", 10, T, "sql", [89])
    assert run(spark, [], [row]) == {} and run(spark, [row], []) == {}


def test_typos_without_a_time(spark):
    """Two edits, no time: found by parts of the name that edits leave whole."""
    right = [(101, "own/red-fox-app", "a/x.py", 10, T, "sql", [89]), (102, "own/red-owl-app", "a/x.py", 10, T, "sql", [89])]
    assert set(run(spark, [(1, "own/red-fax-ap", "a/x.py", 11, None, "B1", [89])], right)) == {(1, 101)}


def crowd(n_a, n_b):
    right = [(100 + k, "own/red-fox-app", "a/x.py", 10 + k % 3, T, "sql", [89]) for k in range(n_b)]
    left = [(k, "own/red-fox-app", "a/x.py", 10 + k % 3, T, "B1", [89]) for k in range(1, n_a + 1)]
    return left, right


def test_exclusive(spark):
    """Many rivals for one place: nobody gets two partners, and none that is accepted stays without."""
    got = run(spark, *crowd(4, 6))
    assert len({a for a, _ in got}) == len(got) == len({b for _, b in got})
    got = run(spark, *crowd(2, 2))
    assert len(got) in (0, 2)


def test_spread_families_give_the_same(spark):
    left = [(k, "own/red-fox-app", "a/x.py", 10 + 3 * k, T, "B1", [89]) for k in (0, 1)]
    right = [(100 + k, "own/red-fox-app", "a/x.py", 10 + 3 * k, T, "sql", [89]) for k in (0, 1)]  # rivals, one nearer
    left += [(50 + k, "red-fox-app", f"b/{k}.py", 5, T, "B1", [89]) for k in range(3)]
    right += [(150 + k, "own/red-fox-app", f"b/{k}.py", 5, T, "sql", [89]) for k in range(3)]
    rules = linkage.Rules(settled=0.3)
    a, b = run(spark, left, right, rules=rules), run(spark, left, right, rules=rules, family_rows=2)
    assert set(a) == set(b) and len(a) == 5
    assert all(abs(a[x] - b[x]) < 1e-6 for x in a)


def rows_of(pairs):
    import pandas as pd

    cols = ["id_a", "id_b", "hint_a", "repo_b", "s_repo", "s_path", "s_line", "s_time", "s_kind"]
    return pd.DataFrame(pairs, columns=cols).assign(family=0, weight=1, free=False)


def loss_of(rules, rows, y, z):
    """The problem's sum of hinge losses, written out."""
    links = sorted(set(zip(rows.hint_a, rows.repo_b)))
    total = sum(rules.prior * v for v in y)
    for v, r in zip(y, rows.itertuples()):
        for s in (r.s_repo, r.s_path, r.s_line, r.s_time, r.s_kind):
            total += rules.likeness * s**rules.sharpness * max(0, s - v) + rules.unlikeness * max(0, v - s)
        total += rules.transitive * max(0, v - z[links.index((r.hint_a, r.repo_b))])
    for side in (rows.id_a, rows.id_b):
        for x in set(side):
            total += rules.exclusive * max(0, sum(v for v, i in zip(y, side) if i == x) - 1)
    for k, link in enumerate(links):
        s = max(r.s_repo for r in rows.itertuples() if (r.hint_a, r.repo_b) == link)
        total += rules.likeness * max(0, s - z[k]) + rules.unlikeness * max(0, z[k] - s)
    return total


def test_settles_at_the_minimum():
    """Against every point of a grid, and against small moves of each value and pair of values."""
    import numpy as np

    rules = linkage.Rules()
    pairs = [(1, 11, "h", "r", 1.0, 1.0, 0.9, 0.7, 1.0), (1, 12, "h", "r", 1.0, 0.85, 0.8, 0.7, 1.0), (2, 12, "h", "r", 0.9, 1.0, 1.0, 1.0, 0.8)]
    rows = rows_of(pairs)
    y = linkage.settle(rows, rules)
    grid = [k / 25 for k in range(26)]
    best = min(loss_of(rules, rows, [a, b, c], [z]) for a in grid for b in grid for c in grid for z in (0.8, 0.9, 1.0))
    mine = min(loss_of(rules, rows, y, [z / 50]) for z in range(51))
    assert mine <= best + 0.02
    rng = np.random.default_rng(4)
    for _ in range(4):
        n = 8
        many = [(int(rng.integers(3)), 10 + int(rng.integers(3)), "h", "r", *rng.choice([0.7, 0.8, 0.9, 1.0], 5).tolist()) for _ in range(n)]
        rows = rows_of(list({p[:2]: p for p in many}.values()))
        y = linkage.settle(rows, rules)
        least = lambda v: min(loss_of(rules, rows, v, [z / 40]) for z in range(41))
        here = least(y)
        for _ in range(60):
            moved = np.clip(y + rng.normal(0, 0.05, len(y)) * (rng.random(len(y)) < 0.4), 0, 1)
            assert least(moved) >= here - 0.03


def test_weights_stand_for_equal_rows():
    import pandas as pd

    rules = linkage.Rules()
    one = rows_of([(0, 0, "h", "r", 0.8, 0.7, 0.8, 0.7, 1.0), (0, 0, "h", "r", 0.8, 1.0, 1.0, 1.0, 1.0)]).assign(free=True)
    heavy = one.assign(weight=[5, 3])
    spread = pd.concat([one.iloc[[0]]] * 5 + [one.iloc[[1]]] * 3, ignore_index=True)
    a, b = linkage.settle(heavy, rules), linkage.settle(spread, rules)
    assert abs(a[0] - b[0]) < 0.01 and abs(a[1] - b[-1]) < 0.01


def test_unlike_attribute_gives_no_link():
    rules = linkage.Rules()
    for k in range(5):
        likes = [1.0] * 5
        likes[k] = 0.0
        assert linkage.settle(rows_of([(1, 2, "h", "r", *likes)]), rules)[0] < 0.01
