import json

from kilnwork.operators import shapes


def test_states():
    assert shapes.state_of({"content": "x"}) == "edit"
    assert shapes.state_of({"content": None, "location": {"row": 1, "column": 2}}) == "edit"
    assert shapes.state_of({"id": 79, "label": "a"}) == "labelled"
    assert shapes.state_of({"row": 1, "column": 2}) == "place"
    assert shapes.state_of({"a": [1]}) == "record"
    assert [shapes.state_of(x) for x in (None, True, 1.5, "", [])] == ["nothing", "flag", "number", "text", "list"]


def test_depth_is_no_limit():
    deep = []
    for _ in range(50_000):
        deep = [deep]
    assert shapes.state_of(deep) == "list"


RAW = "record_id bigint, tool string, scan_id string, received_at timestamp, payload string, item string"


def semgrep(*metas):
    return json.dumps({"results": [{"check_id": "r", "path": "p", "extra": {"metadata": m}} for m in metas]})


def items(spark, rows):
    raw = spark.createDataFrame([(k, t, "s", None, p, "clash") for k, t, p in rows], RAW)
    return {(r.record_id, r.result_pos, r.field_name, r.item_pos, r.variant) for r in shapes.payload_items(raw).collect()}


def test_payloads(spark):
    rows = [
        (1, "semgrep", semgrep({"cwe": ["CWE-1", None, 79, {"id": 1, "label": "l"}]}, None, {"cwe": 5})),
        (1, "semgrep", semgrep({"cwe": ["CWE-1", None, 79, {"id": 1, "label": "l"}]}, None, {"cwe": 5})),
        (2, "semgrep", semgrep('{"cwe": "CWE-9", "references": []}')),
        (3, "semgrep", semgrep({"cwe": ["x"]})[:-5]),
        (4, "ruff", json.dumps([{"fix": {"edits": {"content": "a"}}}, {"fix": None}, {}, None, 5])),
        (5, "ruff", None),
        (6, None, "[]"),
        (7, "semgrep", "null"),
        (8, "semgrep", ""),
    ]
    assert items(spark, rows) == {
        (1, 0, "cwe", 0, "text"),
        (1, 0, "cwe", 1, "nothing"),
        (1, 0, "cwe", 2, "number"),
        (1, 0, "cwe", 3, "labelled"),
        (1, 2, "cwe", 0, "number"),
        (2, 0, "cwe", 0, "text"),
        (4, 0, "edits", 0, "edit"),
    }
    assert items(spark, []) == set()


def test_variant_tables_and_runs(spark):
    raw = spark.createDataFrame(
        [
            (1, "semgrep", "s", None, semgrep({"cwe": ["é", 7, {"id": 3, "label": "z"}]}), ""),
            (2, "ruff", "s", None, json.dumps([{"fix": {"edits": [{"content": "c", "location": {"row": 4, "column": 1}}]}}]), ""),
            (3, "ruff", "s", None, "[", ""),
        ],
        RAW,
    )
    got = shapes.payload_items(raw)
    tables = shapes.variant_tables(got)
    assert [r.value for r in tables["text"].collect()] == ["é"]
    assert [r.value for r in tables["number"].collect()] == [7.0]
    assert [(r.label_id, r.label) for r in tables["labelled"].collect()] == [(3, "z")]
    assert [(r.record_id, r.content, r.start_row) for r in tables["edit"].collect()] == [(2, "c", 4)]
    runs = {(r.record_id, r.complete, r.n_results) for r in shapes.payload_runs(raw).collect()}
    assert runs == {(1, True, 1), (2, True, 1), (3, False, 0)}
    assert shapes.payload_results(raw).count() == 2


def test_typed_and_text_states_agree(spark):
    """The automaton over structs gives what it gives for the same values as JSON with explicit nulls."""
    from pyspark.sql import functions as F

    kind = "struct<content: string, location: struct<row: int, column: int>, id: int, label: string>"
    values = [("c", (1, 2), 1, "l"), ("c", None, None, None), (None, None, None, None), (None, (1, None), 5, None), None]
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    typed = df.select(shapes.typed_state(F.col("v"), df.schema["v"].dataType).alias("s")).collect()
    text = df.select(F.to_json("v", {"ignoreNullFields": "false"}).alias("j")).collect()
    assert [r.s for r in typed] == [shapes.state_of(json.loads(r.j) if r.j else None) for r in text]


def test_nodes_keep_their_links_at_any_depth(spark):
    value = {"a": [{"b": 1, "c d": {"e": None}}, {"b": "x"}, [True]], "z": {}}
    got = {n[0]: n[1:] for n in shapes.nodes_of(value)}
    assert got["$.a[0].\"c d\".e"][:6] == ("$.a[0].\"c d\"", "$.a[*].\"c d\".e", "e", None, "nothing", None)
    assert got["$.a[2][0]"] == ("$.a[2]", "$.a[*][*]", None, 0, "flag", None, "true")
    assert got["$.a[1].b"][6] == "x" and got["$.z"][4] == "object"
    same = {n[0]: n[6] for n in shapes.nodes_of([{"k": 1, "l": "t"}, {"l": "u", "k": 2}, {"k": "3", "l": "t"}])}
    assert same["$[0]"] == same["$[1]"] != same["$[2]"]
    raw = spark.createDataFrame([(1, json.dumps(value)), (1, json.dumps(value)), (2, "{"), (3, None)], "record_id bigint, payload string")
    n = shapes.nodes(raw)
    assert n.count() == len(got)
    v = {(r["at"], tuple(r.fields)): (tuple(r.optional), r.n) for r in shapes.variants(n).collect()}
    assert v[("$.a[*]", ("b",))] == ((), 1) and v[("$.a[*]", ("b", "c d"))] == (("c d",), 1) and v[("$.z", ())] == ((), 1)
    t = {r.node: (r.parent, r.item_pos, r.leaves) for r in shapes.object_table(n, "$.a[*]").collect()}
    assert t == {"$.a[0]": ("$.a", 0, {"b": "1"}), "$.a[1]": ("$.a", 1, {"b": "x"})}
    deep = []
    for _ in range(3_000):
        deep = [deep]
    assert sum(1 for _ in shapes.nodes_of(deep)) == 3_001
