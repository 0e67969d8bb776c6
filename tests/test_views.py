import random

from pyspark.sql import functions as F

from kilnwork.functions import paths as fp
from kilnwork.operators import architecture, views


def key(path, depth, opened, shut):
    folders = path.split("/")[:-1]
    above = ["/".join(folders[:k]) for k in range(1, len(folders) + 1)]
    for a in above:
        if a in shut:
            return "dir:" + a
    if depth is None:
        return path
    for a in above[min(depth, len(above)) - 1 :] if above else []:
        if a not in opened:
            return "dir:" + a
    return path


def plainly(paths, most, expand, shut):
    """Every folder tried again after every step, the whole view counted anew."""
    if len(paths) <= most:
        return {p: key(p, None, expand, shut) for p in paths}
    deepest = max([p.count("/") for p in paths] + [1])
    depth = next((d for d in range(deepest, 0, -1) if len({key(p, d, (), ()) for p in paths}) <= most), 1)
    opened = set(expand)
    while True:
        groups = {}
        for p in paths:
            groups.setdefault(key(p, depth, opened, shut), []).append(p)
        for k, g in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
            if k.startswith("dir:") and len(g) > 1:
                after = {key(p, depth, opened | {k[4:]}, shut) for p in paths}
                inner = {key(p, depth, opened | {k[4:]}, shut) for p in g}
                if len(inner) > 1 and len(after) <= most:
                    opened.add(k[4:])
                    break
        else:
            return {p: key(p, depth, opened, shut) for p in paths}


def test_views_spend_their_budget(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for scan in range(25):
        paths = {"/".join(rng.choice("abc") for _ in range(rng.randrange(0, 4))) + f"/f{rng.randrange(40)}.py" for _ in range(rng.randrange(1, 60))}
        paths = sorted(p.lstrip("/") for p in paths)
        rows += [(str(scan), p, p, "x") for p in paths]
        want |= {(str(scan), p): k for p, k in plainly(paths, 12, {"a"}, {"b/c"}).items()}
    nodes = spark.createDataFrame(rows, "scan_id string, module_id string, path string, key string")
    got = {(r.scan_id, r.module_id): r.key for r in views.view_keys(nodes, 12, ("a",), ("b/c",)).collect()}
    assert got == want
    assert views.view_keys(nodes.limit(0), 12).count() == 0


def test_joined_paths_and_specifiers(spark):
    rows = [("a/b", "../c.ts"), ("a", "../../c"), ("", "./x//y/."), ("a/b", None), ("a", "..")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(fp.joined(F.col("a"), F.col("b"))).collect()] == ["a/c.ts", None, "x/y", "a/b", ""]
    names = spark.createDataFrame([("@scope/pkg/deep",), ("left-pad/x",), ("raw!./x.svg?react",), ("@only",)], "s string")
    got = [tuple(r) for r in names.select(fp.package_name(F.col("s")), fp.clean_specifier(F.col("s"))).collect()]
    assert got == [("@scope/pkg", "@scope/pkg/deep"), ("left-pad", "left-pad/x"), ("raw!.", "./x.svg"), ("@only", "@only")]


def test_layers_of_both_stacks(spark):
    rows = [
        ("web/components/Box.tsx", True, "ui"), ("web/useThing.ts", True, "hooks"), ("web/services/user.ts", True, "api"),
        ("srv/services/user.ts", False, "service"), ("srv/api/x.py", False, "presentation"), ("srv/api/x.ts", False, "presentation"),
        ("web/api/x.ts", True, "api"), ("srv/user.controller.ts", False, "presentation"), ("srv/models/test_x.py", False, None), ("srv/UserService.py", False, "service"),
    ]
    df = spark.createDataFrame(rows, "p string, f boolean, w string")
    got = df.select("p", "w", architecture.layer_of(F.col("p"), None, F.col("f")).alias("l")).collect()
    assert {r.p: r.l for r in got} == {r.p: r.w for r in got}


def test_colocated_modules_are_no_violation(spark):
    nodes = spark.createDataFrame([("s", "components/box/hooks.ts", False), ("s", "components/box/view.tsx", False), ("s", "services/a.py", False), ("s", "routes/b.py", False)], "scan_id string, path string, is_test boolean")
    e = spark.createDataFrame([("s", "services/a.py", "routes/b.py", False)], "scan_id string, src string, dst string, type_only boolean")
    assert [(r.src, r.kind) for r in architecture.layer_issues(nodes, e).collect()] == [("services/a.py", "inversion")]


def test_citations(spark):
    nodes = spark.createDataFrame([("s", p, p) for p in ("a/x.py", "a/y.py", "b/z.py")], "scan_id string, module_id string, path string")
    e = spark.createDataFrame([("s", "a/x.py", "b/z.py")], "scan_id string, src string, dst string")
    texts = ["`a/x.py:3` -> b/z.py", "a/ => ./b", "b -> a", "a/x.py -> c.py", " ", None, "a/y.py"]
    cited = spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)], "scan_id string, cite_id int, text string")
    got = {r.cite_id: (r.valid, r.invalid, r.reason) for r in views.citations(cited, nodes, e).collect()}
    assert got == {0: (2, 0, None), 1: (2, 0, None), 2: (2, 0, "no import"), 3: (1, 1, "not in the graph"), 4: (0, 0, "empty"), 5: (0, 0, "empty"), 6: (1, 0, None)}
