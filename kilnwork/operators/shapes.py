"""Nested records into flat tables by the shape of their objects.

A tree automaton reads a JSON value bottom-up: leaves get a state by type, an array the
state of its elements, an object a state by the first rule whose fields have fitting states.
Each child item is routed to the table of its variant; common keys and the parent's link stay
in one supertype table. Columns that Spark already knows as structs run the same rules as
JVM expressions; JSON text of drifting shape is read by the automaton in Arrow batches."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType, StructType


@dataclass(frozen=True)
class Shape:
    """An object is of this shape if every needed field has one of the states given for it."""

    state: str
    needs: tuple[tuple[str, frozenset[str]], ...]


TEXT, NUMBER, FLAG, NOTHING, RECORD = "text", "number", "flag", "nothing", "record"
LEAF = frozenset({TEXT, NUMBER, FLAG, NOTHING})
#: Ordered: the first shape that fits gives an object's state.
SHAPES = (
    Shape("result", (("check_id", LEAF), ("path", LEAF))),
    Shape("result", (("filename", LEAF), ("location", frozenset({RECORD, "place", "nothing"})))),
    Shape("edit", (("location", frozenset({RECORD, "place"})),)),
    Shape("edit", (("content", LEAF),)),
    Shape("labelled", (("id", LEAF), ("label", LEAF))),
    Shape("place", (("row", LEAF), ("column", LEAF))),
)


def state_of(value: object, shapes: tuple[Shape, ...] = SHAPES) -> str:
    """The automaton's state at the root of a JSON value. Arrays: 'list'. Without recursion,
    so depth is no limit."""
    done: dict[int, str] = {}
    stack: list[tuple[object, bool]] = [(value, False)]
    while stack:
        node, ready = stack.pop()
        if isinstance(node, dict):
            if not ready:
                stack.append((node, True))
                stack.extend((x, False) for x in node.values())
                continue
            done[id(node)] = next(
                (
                    s.state
                    for s in shapes
                    if all(k in node and _state(node[k], done) in wanted for k, wanted in s.needs)
                ),
                RECORD,
            )
        elif isinstance(node, list):
            if not ready:
                stack.append((node, True))
                stack.extend((x, False) for x in node)
                continue
            done[id(node)] = "list"
    return _state(value, done)


def _state(value: object, done: dict[int, str]) -> str:
    if value is None:
        return NOTHING
    if isinstance(value, (dict, list)):
        return done[id(value)]
    if isinstance(value, bool):
        return FLAG
    return NUMBER if isinstance(value, (int, float)) else TEXT


def typed_state(value: Column, kind: DataType, shapes: tuple[Shape, ...] = SHAPES) -> Column:
    """The automaton over a column that Spark knows the type of, as one JVM expression. A field of the
    type is there in every object; where it is null its state is 'nothing'."""
    if isinstance(kind, StructType):
        fields = {f.name: f.dataType for f in kind.fields}
        state = F.lit(RECORD)
        for shape in reversed(shapes):
            if all(name in fields for name, _ in shape.needs):
                fits = [typed_state(value[name], fields[name], shapes).isin(sorted(wanted)) for name, wanted in shape.needs]
                state = F.when(reduce(Column.__and__, fits), shape.state).otherwise(state)
    elif isinstance(kind, ArrayType):
        state = F.lit("list")
    elif isinstance(kind, BooleanType):
        state = F.lit(FLAG)
    else:
        state = F.lit(NUMBER if isinstance(kind, NumericType) else TEXT)
    return F.when(value.isNull(), NOTHING).otherwise(state)


@dataclass(frozen=True)
class ItemField:
    """Where the child items of one kind stand in a result: a path of object fields."""

    name: str
    path: tuple[str, ...]


#: Where the tools put their items.
TOOL_FIELDS = {
    "semgrep": (
        ItemField("cwe", ("extra", "metadata", "cwe")),
        ItemField("references", ("extra", "metadata", "references")),
    ),
    "ruff": (ItemField("edits", ("fix", "edits")),),
}


def _opened(value: object) -> object:
    """An object or its JSON text, as some writers encode objects twice."""
    if isinstance(value, str) and value.lstrip()[:1] == "{":
        try:
            return json.loads(value)
        except (ValueError, RecursionError):
            return value
    return value


def _at(result: object, path: tuple[str, ...]) -> object:
    for name in path:
        result = _opened(result)
        if not isinstance(result, dict):
            return None
        result = result.get(name)
    return result


def results_of(tool: str | None, payload: str | None) -> list | None:
    """The results of one tool run; None if the payload isn't complete JSON of a known tool.
    A single result that stands where the list is expected is result 0."""
    if tool not in TOOL_FIELDS or payload is None:
        return None
    try:
        run = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    results = run
    if tool == "semgrep":
        results = run.get("results") if isinstance(run, dict) else run
    elif isinstance(run, dict) and "results" in run:
        results = run["results"]
    if results is None:
        return []
    return results if isinstance(results, list) else [results]


def items_of(result: object, fields: tuple[ItemField, ...]) -> Iterator[tuple[str, int, str, object]]:
    """(field, position, variant, value) of a result's items; nulls keep their position and
    come out as variant 'nothing', a lone value is item 0."""
    for field in fields:
        value = _at(result, field.path)
        if value is None:
            continue
        for k, item in enumerate(value if isinstance(value, list) else [value]):
            yield field.name, k, state_of(item), item


ITEM_SCHEMA = "record_id bigint, result_pos int, field_name string, item_pos int, variant string, item string"


def payload_items(raw: DataFrame) -> DataFrame:
    """Items in JSON text: (source_table, record_id, result_pos, field_name, item_pos, variant,
    item as JSON). Needs record_id, tool, payload; deliveries of a key count once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in ITEM_SCHEMA.split(", ")]
        for batch in batches:
            rows = [
                (key, k, name, pos, variant, json.dumps(item, ensure_ascii=False))
                for key, tool, payload in zip(batch.record_id, batch.tool, batch.payload)
                for k, result in enumerate(results_of(tool, payload) or [])
                for name, pos, variant, item in items_of(result, TOOL_FIELDS[tool])
            ]
            yield pd.DataFrame(rows, columns=columns)

    once = raw.select("record_id", "tool", "payload").where("payload is not null and record_id is not null")
    once = once.dropDuplicates(["record_id"])
    return once.mapInPandas(run, ITEM_SCHEMA).select(F.lit("raw_records").alias("source_table"), "*")


def payload_results(raw: DataFrame) -> DataFrame:
    """One row per result of a payload: (record_id, result_pos, tool, rule, path, line, variant),
    linked to its run by record_id. variant is the automaton's state of the result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, tool, payload in zip(batch.record_id, batch.tool, batch.payload):
                for k, result in enumerate(results_of(tool, payload) or []):
                    inner = result if isinstance(result, dict) else {}
                    rule = inner.get("check_id") if tool == "semgrep" else inner.get("code") or inner.get("name")
                    path = inner.get("path") if tool == "semgrep" else inner.get("filename")
                    line = _at(inner, ("start", "line") if tool == "semgrep" else ("location", "row"))
                    whole = isinstance(line, int) and not isinstance(line, bool) and abs(line) < 2**31
                    rows.append(
                        (
                            key,
                            k,
                            tool,
                            rule if isinstance(rule, str) else None,
                            path if isinstance(path, str) else None,
                            line if whole else None,
                            state_of(result),
                        )
                    )
            out = pd.DataFrame(rows, columns=["record_id", "result_pos", "tool", "rule", "path", "line", "variant"])
            out["line"] = out["line"].astype("Int32")
            yield out

    once = raw.select("record_id", "tool", "payload").where("payload is not null and record_id is not null")
    return once.dropDuplicates(["record_id"]).mapInPandas(
        run, "record_id bigint, result_pos int, tool string, rule string, path string, line int, variant string"
    )


def payload_runs(raw: DataFrame) -> DataFrame:
    """One row per tool run: (record_id, tool, scan_id, received_at, complete, n_results)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [results_of(t, p) for t, p in zip(batch.tool, batch.payload)]
            out = batch[["record_id", "tool", "scan_id", "received_at"]].copy()
            out["complete"] = [x is not None for x in found]
            out["n_results"] = [len(x or []) for x in found]
            yield out

    once = raw.select("record_id", "tool", "scan_id", "received_at", "payload").where("record_id is not null")
    return once.dropDuplicates(["record_id"]).mapInPandas(
        run, "record_id bigint, tool string, scan_id string, received_at timestamp, complete boolean, n_results int"
    )


def struct_items(df: DataFrame, source: str, key: str, field: str, array: Column) -> DataFrame:
    """Items of a typed array column, JVM only; the same columns as payload_items, with variants
    by typed_state."""
    kind = df.select(array.alias("a")).schema["a"].dataType.elementType
    return (
        df.where(F.col(key).isNotNull() & (F.size(array) > 0))
        .select(F.col(key).cast("bigint").alias("record_id"), array.alias("_items"))
        .dropDuplicates(["record_id"])
        .select("record_id", F.posexplode("_items").alias("item_pos", "item"))
        .select(
            F.lit(source).alias("source_table"),
            "record_id",
            F.lit(0).alias("result_pos"),
            F.lit(field).alias("field_name"),
            "item_pos",
            typed_state(F.col("item"), kind).alias("variant"),
            F.to_json(F.struct(F.col("item").alias("v"))).alias("item"),
        )
    )


def tool_items(semgrep: DataFrame, ruff: DataFrame, raw: DataFrame) -> DataFrame:
    """The supertype table of all child items, nulls left out but counted in positions.

    Nulls at any level, absent fields, null and empty arrays have no items; repeated elements
    each come out; repeated deliveries of a key count once; text that isn't complete JSON, and
    payloads of unknown tools, have no items. Other columns may have any names."""
    meta = F.col("extra.metadata")
    parts = [
        struct_items(semgrep, "semgrep_output", "result_id", "cwe", meta["cwe"]),
        struct_items(semgrep, "semgrep_output", "result_id", "references", meta["references"]),
        struct_items(ruff, "ruff_output", "result_id", "edits", F.col("fix.edits")),
        payload_items(raw),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("variant") != NOTHING)


def variant_tables(items: DataFrame) -> dict[str, DataFrame]:
    """Typed subtype tables; each row keeps the item's full key to its parent and supertype."""
    link = ["source_table", "record_id", "result_pos", "field_name", "item_pos"]
    place = "struct<row: int, column: int>"
    inner = F.when(F.col("source_table") == "raw_records", F.col("item")).otherwise(F.get_json_object("item", "$.v"))
    edit = F.from_json(inner, f"struct<content: string, location: {place}, end_location: {place}>")
    label = F.from_json(inner, "struct<id: bigint, label: string>")
    text = F.from_json(F.concat(F.lit('{"v":'), F.col("item"), F.lit("}")), "struct<v: string>")["v"]
    plain = F.when(F.col("source_table") == "raw_records", text).otherwise(inner)

    def of(state: str) -> DataFrame:
        return items.where(F.col("variant") == state)

    return {
        "text": of(TEXT).select(*link, plain.alias("value")),
        "number": of(NUMBER).select(*link, inner.cast("double").alias("value")),
        "flag": of(FLAG).select(*link, inner.cast("boolean").alias("value")),
        "labelled": of("labelled").select(*link, label["id"].alias("label_id"), label["label"].alias("label")),
        "edit": of("edit")
        .withColumn("_e", edit)
        .select(
            *link,
            F.col("_e.content").alias("content"),
            F.col("_e.location.row").alias("start_row"),
            F.col("_e.location.column").alias("start_column"),
            F.col("_e.end_location.row").alias("end_row"),
            F.col("_e.end_location.column").alias("end_column"),
        ),
        "record": items.where(F.col("variant").isin(RECORD, "place", "list")).select(
            *link, "variant", inner.alias("json")
        ),
    }


# -- any structure, without rules


NODES = "record_id bigint, node string, parent string, at string, field string, item_pos int, state string, variant string, value string"
PLAIN_NAME = re.compile(r"[A-Za-z_]\w*\Z")


def nodes_of(value: object) -> Iterator[tuple[str, str | None, str, str | None, int | None, str, str | None, str | None]]:
    """(node, parent, at, field, item_pos, state, variant, value) of every value in a JSON value, the root first.

    node is the path from the root, at the same with any position as [*]. The automaton's states here are learned: an
    object's is its sorted fields with their states, an array's the distinct states of its elements, and `variant`
    a short name of it, equal wherever the structure is. Leaves have their text. Without recursion."""
    order: list[tuple[object, str, str | None, str, str | None, int | None]] = []
    stack: list[tuple[object, str, str | None, str, str | None, int | None]] = [(value, "$", None, "$", None, None)]
    while stack:
        entry = stack.pop()
        order.append(entry)
        inner, node, _, at, _, _ = entry
        if isinstance(inner, dict):
            for name, x in reversed(inner.items()):
                step = f".{name}" if PLAIN_NAME.match(name) else f'."{name}"'
                stack.append((x, node + step, node, at + step, name, None))
        elif isinstance(inner, list):
            stack.extend((x, f"{node}[{k}]", node, at + "[*]", None, k) for k, x in reversed(list(enumerate(inner))))
    learned: dict[str, str] = {}
    below: dict[str, list[tuple[str, str]]] = {}
    for inner, node, parent, _, field, _ in reversed(order):  # children before parents
        parts = below.pop(node, [])
        if isinstance(inner, dict):
            state = "{" + ",".join(f"{n}:{s}" for n, s in sorted(parts)) + "}"
        elif isinstance(inner, list):
            state = "[" + "|".join(sorted({s for _, s in parts})) + "]"
        else:
            state = _state(inner, {})
        learned[node] = hashlib.md5(state.encode("utf-8", "surrogatepass")).hexdigest()[:12] if isinstance(inner, (dict, list)) else state
        if parent is not None:
            below.setdefault(parent, []).append((field or "", learned[node]))
    for inner, node, parent, at, field, pos in order:
        held = isinstance(inner, (dict, list))
        state = "object" if isinstance(inner, dict) else "list" if isinstance(inner, list) else _state(inner, {})
        text = None if held or inner is None else inner if isinstance(inner, str) else json.dumps(inner)
        yield node, parent, at, field, pos, state, learned[node] if held else None, text


def nodes(raw: DataFrame) -> DataFrame:
    """NODES of the payloads (record_id, payload), each delivery of a key once; text that isn't complete JSON, and
    null, has none. Every node has its parent's path, so the tables below keep their links at any depth."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in NODES.split(", ")]
        for batch in batches:
            rows = []
            for key, payload in zip(batch.record_id, batch.payload):
                try:
                    value = json.loads(payload)
                except (ValueError, RecursionError):
                    continue
                rows += [(key, *n) for n in nodes_of(value)]
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows = []
            yield pd.DataFrame(rows, columns=names, dtype=object)

    once = raw.select("record_id", "payload").where("payload is not null and record_id is not null")
    return once.dropDuplicates(["record_id"]).mapInPandas(run, NODES)


def variants(of: DataFrame) -> DataFrame:
    """(at, fields, optional, n, variants): the objects at each place by their fields, how many there are, in how many
    learned variants, and which of the fields other objects at the place lack."""
    parts = of.where("field is not null").groupBy("record_id", F.col("parent").alias("node")).agg(F.array_sort(F.collect_set("field")).alias("fields"))
    objects = of.where("state = 'object'").select("record_id", "node", "at", "variant").join(parts, ["record_id", "node"], "left")
    none = F.array().cast("array<string>")
    each = objects.groupBy("at", F.coalesce("fields", none).alias("fields")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("variant").alias("variants"))
    held = each.select("at", "n", F.explode("fields").alias("f")).groupBy("at", "f").agg(F.sum("n").alias("have"))
    total = each.groupBy("at").agg(F.sum("n").alias("all"))
    rare = held.join(total, "at").where("have < all").groupBy("at").agg(F.collect_set("f").alias("rare"))
    out = each.join(rare, "at", "left")
    return out.select("at", "fields", F.array_sort(F.array_intersect("fields", F.coalesce("rare", none))).alias("optional"), "n", "variants")


def object_table(of: DataFrame, at: str) -> DataFrame:
    """(record_id, node, parent, item_pos, variant, leaves): the objects at a place as a table of their own, each with
    its link to the object around it, its variant and its leaf fields as a map."""
    mine = of.where(F.col("at") == at).where("state = 'object'").select("record_id", "node", "parent", "item_pos", "variant")
    leaves = of.where("field is not null and state not in ('object', 'list')").select("record_id", F.col("parent").alias("node"), "field", "value")
    listed = leaves.join(mine.select("record_id", "node"), ["record_id", "node"], "left_semi").groupBy("record_id", "node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("leaves"))
    return mine.join(listed, ["record_id", "node"], "left")
