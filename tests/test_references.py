from datetime import datetime

from kilnwork.operators.references import Child, Parent, broken_reference_counts, broken_references

T1, T2, T3 = (datetime(2026, m, 1) for m in (1, 2, 3))
PARENT = "id bigint, ingested_at timestamp, deleted_at timestamp, target_id string"
CHILD = "id bigint, ref bigint, refs array<bigint>, created_at timestamp, target string"


def tables(spark, parents, children):
    p = spark.createDataFrame(parents, PARENT)
    c = spark.createDataFrame(children, CHILD)
    return [Parent("p", p)], [Child("c", "ref", c, "p"), Child("c", "refs", c, "p", many=True)]


def rows(df):
    return {(r.ref_field, r.ref_id, r.target_id, r.reason) for r in df.collect()}


def test_reasons_repeats_and_nulls(spark):
    parents = [
        (1, T1, None, "x"),
        (1, T3, None, "x"),  # a later delivery of 1
        (2, T1, T2, "x"),
        (3, T3, None, "x"),
        (None, T1, None, "x"),
    ]
    children = [
        (10, 1, [1, None, 9, 9], T2, "t"),
        (10, 1, [1, None, 9, 9], T2, "t"),
        (11, 2, [], T2, "t"),
        (12, 3, None, T2, "t"),
        (13, 3, None, None, "t"),
        (14, None, None, T2, "t"),
        (15, 7, None, T2, "t"),
    ]
    got = rows(broken_references(*tables(spark, parents, children)))
    assert got == {
        ("refs", 10, 9, "missing"),
        ("ref", 11, 2, "deleted"),
        ("ref", 12, 3, "late"),
        ("ref", 15, 7, "missing"),
    }


def test_empty_parents_make_all_missing_and_counts(spark):
    args = tables(spark, [], [(1, 5, None, T1, ""), (2, 5, None, T2, "")])
    assert rows(broken_references(*args)) == {("ref", 1, 5, "missing"), ("ref", 2, 5, "missing")}
    counts = {(str(r.month)[:7], r.n_references, r.n_targets) for r in broken_reference_counts(*args).collect()}
    assert counts == {("2026-01", 1, 1), ("2026-02", 1, 1)}


def test_empty_children(spark):
    assert broken_references(*tables(spark, [(1, T1, None, "")], [])).count() == 0


def test_hot_key(spark):
    children = [(k, 77, None, T2, "") for k in range(3000)] + [(k, 1, None, T2, "") for k in range(3000, 3010)]
    assert broken_references(*tables(spark, [(1, T1, None, "")], children)).count() == 3000


def test_hot_key(spark):
    """One missing key has most of the references, many others have one each."""
    children = [(k, -1 if k % 3 else k + 5000, None, T1, "") for k in range(2400)]
    got = rows(broken_references(*tables(spark, [(5003, T1, None, "x")], children)))
    assert got == {("ref", k, ref, "missing") for k, ref, *_ in children if ref != 5003}
