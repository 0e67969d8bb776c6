from itertools import product
from math import dist
from random import Random

from pyspark.sql import functions as F

from kilnwork.functions import colors
from kilnwork.functions import findings as fn
from kilnwork.operators import sites


def test_nearest_color_meets_neighbouring_cells(spark):
    asked = spark.createDataFrame([("p", "x", 0.5, 0.0, 0.0), ("p", "far", 0.9, 0.0, 0.0), ("q", "x", 0.5, 0.0, 0.0)], "page string, color string, l double, a double, b double")
    seen = spark.createDataFrame([("p", "s1", 0.521, -0.001, 0.001), ("p", "s2", 0.479, 0.0, 0.0), ("p", "s3", 0.47, 0.0, 0.0)], "page string, color string, l double, a double, b double")
    assert [(r.page, r.color, r.match) for r in sites.nearest_color(asked, seen).collect()] == [("p", "x", "s2")]


def test_nearest_color_broadcasts_no_repeated_side(spark, tmp_path):
    lab = "page string, color int, l double, a double, b double"
    side = lambda r, n: [("pq"[k % 2], k % 40, *(r.uniform(-0.1, 0.1) for _ in "lab")) for k in range(n)]
    asked, seen = side(Random(1), 50), side(Random(2), 40)
    for name, rows in (("asked", asked), ("seen", seen)):  # files, as the planner knows their sizes
        spark.createDataFrame(rows, lab).write.parquet(f"{tmp_path}/{name}")
    out = sites.nearest_color(*[spark.read.parquet(f"{tmp_path}/{name}") for name in ("asked", "seen")])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    want: dict[tuple[str, int], tuple[float, int]] = {}
    for (p, c, *x), (q, m, *y) in product(asked, seen):
        if p == q and (d := dist(x, y)) <= 0.04:
            want[p, c] = min(want.get((p, c), (d, m)), (d, m))
    assert len(want) > 5 and {(r.page, r.color): r.match for r in out.collect()} == {k: m for k, (_, m) in want.items()}


def test_few_links_say_nothing(spark):
    links = spark.createDataFrame([("p", "b")] * 3 + [("p", None)] * 3 + [("q", "b")] * 4, "page string, brand string")
    assert [tuple(r) for r in sites.link_brands(links).collect()] == [("p", "b", 0.5)]


def test_nul_at_any_depth(spark):
    df = spark.createDataFrame([({"k": [("a\0", 1)]}, None)], "m map<string, array<struct<s: string, n: int>>>, t struct<s: string>")
    c = {f.name: fn.without_nul_at_all(F.col(f.name), f.dataType) for f in df.schema.fields}
    r = df.select(*[v.alias(k) for k, v in c.items()]).first()
    assert r.m["k"][0].s == "a" and r.t is None


def test_colours_turn_back(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (255.0, 128.0, 3.0), (255.0, 255.0, 255.0)], "r double, g double, b double")
    lab = colors.oklab(*map(F.col, "rgb"))
    for r in df.select("r", "g", "b", *[c.alias(n) for c, n in zip(colors.from_oklab(*lab), "xyz")], colors.polar(lab)[2].alias("hue")).collect():
        assert abs(r.r - r.x) < 0.5 and abs(r.g - r.y) < 0.5 and abs(r.b - r.z) < 0.5 and 0 <= r.hue < 360


def test_reasons_in_order(spark):
    rows = ["error: patch failed: corrupt patch", "Not a unified diff: x", "corrupt patch at 3", "File does NOT exist", None, "x" * 200]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "d string").select(fn.failure_reason(F.col("d"))).collect()]
    assert got == ["context does not match the file", "not a unified diff", "corrupt patch", "touches a file it may not", "other: ", "other: " + "x" * 80]
