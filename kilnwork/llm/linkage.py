"""Records of two tools that report the same thing, without a shared id.

Candidates meet on blocking keys, never all with all. Weighted soft-logic rules then speak about
every candidate: likeness of each attribute for and against a link, exclusivity of links on
either side, and transitivity by which a link is no likelier than that its repository hint
means its repository. Together they are a convex problem of hinge losses. Alternating directions
solve it: every rule moves its own copy of the values it speaks about in closed form, copies of one
value are averaged, and the disagreement is carried on as dual values, until nothing moves.

The problem falls apart into families, hints and repositories that may mean each other. Links in
equal position have equal values, so those without a rival are one row with a weight for each position.
A family that fits a task is solved in one; a larger one by the same steps over all executors.

Blocking loses nothing that the rules accept: an attribute of likeness 0 pulls a link down with
`unlikeness`, more than the other four together can pull it up, so its value is 0."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnwork.functions import near
from kilnwork.operators import graph
from kilnwork.runtime import cut, discard, small_enough, written

LINE_SPAN, TIME_SPAN = 16, 4 * 3600
ATTRIBUTES = ("repo", "path", "line", "time", "kind")
COPIES = len(ATTRIBUTES) + 4  # prior, exclusive on either side, transitive


@dataclass(frozen=True)
class Rules:
    """Weights of the rules, and the reach of the attributes they compare."""

    likeness: float = 1.0  # an attribute alike speaks for the link, the more alike the more
    sharpness: int = 6
    unlikeness: float = 6.0  # an attribute unlike speaks against it
    prior: float = 0.2  # without evidence there is no link
    exclusive: float = 20.0  # one partner on either side
    transitive: float = 5.0  # a link implies that the hint means the repository
    rho: float = 8.0
    settled: float = 0.00001  # stop once no value moves, and no copy is off, by more in five steps on end
    lines: int = 3
    minutes: int = 25
    accept: float = 0.5

    def __post_init__(self) -> None:
        if self.unlikeness + self.prior <= (len(ATTRIBUTES) - 1) * self.likeness:
            raise ValueError("blocking needs an unlike attribute to outweigh the others")


@dataclass(frozen=True)
class Side:
    """How one table names what the rules compare."""

    id: str
    repo: str
    path: str
    line: str
    time: str
    kind: Column = field(repr=False)
    weaknesses: Column = field(repr=False)


def plain_path(path: Column) -> Column:
    """Forward slashes, no mount or job folder before it, no case."""
    p = F.regexp_replace(F.lower(path), r"[\\/]+", "/")
    p = F.regexp_replace(p, r"^(?:\./)+", "")
    return F.regexp_replace(p, r"^/(?:src|tmp/[^/]+|builds?/[^/]+|app|workspace)/|^/", "")


def plain_hint(hint: Column) -> Column:
    """Letters and digits of a repository's loose name: no host, archive or branch suffix."""
    h = F.regexp_replace(F.lower(hint), r"^(?:[a-z]+://[^/]+/|[\w.-]+@[^:]+:)", "")
    h = F.regexp_replace(h, r"\.git$", "")
    h = F.regexp_replace(h, r"(?:-[0-9a-f]{7,40})?(?:-(?:main|master|dev))?\.(?:zip|tar\.gz|tgz)$", "")
    return F.regexp_replace(h, r"[^a-z0-9/]+", "")


def _rows(df: DataFrame, side: Side, tag: str) -> DataFrame:
    rows = df.select(
        F.col(side.id).cast("bigint").alias("id"),
        F.lower(side.repo).alias("repo"),
        plain_hint(F.col(side.repo)).alias("hint"),
        plain_path(F.col(side.path)).alias("path"),
        F.col(side.line).cast("int").alias("line"),
        F.unix_timestamp(side.time).alias("time"),
        side.kind.alias("kind"),
        side.weaknesses.alias("weak"),
    ).where("id is not null and repo is not null and path is not null and line is not null and kind is not null")
    rows = rows.dropDuplicates(["id"])
    name = F.substring_index("hint", "/", -1)
    rows = rows.withColumns({"base": F.substring_index("path", "/", -1), "name": name})
    return rows.select([F.col(c).alias(f"{c}_{tag}") for c in rows.columns])


def rule_likeness(a: DataFrame, b: DataFrame) -> DataFrame:
    """(kind_a, kind_b, s_kind): which rules of the two tools name the same weakness, learned from
    the weakness numbers of all their rows. A row per pair of rules that share a number."""

    def shares(rows: DataFrame, tag: str) -> DataFrame:
        each = rows.select(f"kind_{tag}", F.explode(f"weak_{tag}").alias("weakness"))
        n = each.groupBy(f"kind_{tag}", "weakness").agg(F.count(F.lit(1)).alias("n"))
        whole = Window.partitionBy(f"kind_{tag}")
        return n.select(f"kind_{tag}", "weakness", (F.col("n") / F.sum("n").over(whole)).alias(f"share_{tag}"))

    both = shares(a, "a").join(shares(b, "b"), "weakness").groupBy("kind_a", "kind_b")
    both = both.agg(F.sum(F.least("share_a", "share_b")).alias("common"))
    return both.where("common >= 0.05").select(
        "kind_a", "kind_b", F.when(F.col("common") >= 0.15, 1.0).otherwise(0.8).alias("s_kind")
    )


def meanings(a: DataFrame, b: DataFrame) -> DataFrame:
    """(hint_a, repo_b, s_repo): which repositories a hint may mean, over distinct names only."""
    hints = a.select("hint_a").distinct().withColumn("loose", F.translate("hint_a", "/", ""))
    repos = b.select("repo_b", "hint_b", "name_b").distinct().withColumn("full", F.translate("hint_b", "/", ""))
    known = F.when(F.length("name_b") >= 8, F.concat(near.part_keys(F.col("full")), near.part_keys(F.col("name_b")))).otherwise(F.array().cast("array<bigint>"))
    known = F.array_distinct(F.concat(known, F.array(F.xxhash64("full"), F.xxhash64("name_b"))))
    asked = F.concat(near.probe_keys(F.col("loose")), F.array(F.xxhash64("loose")))
    met = hints.withColumn("k", F.explode(asked)).join(repos.withColumn("k", F.explode(known)), "k").drop("k").distinct()
    owned = F.col("hint_a").contains("/")
    apart = F.when(owned, F.levenshtein("loose", "full")).otherwise(F.least(F.levenshtein("loose", "full"), F.levenshtein("loose", "name_b")))
    likeness = (
        F.when(F.col("loose") == F.col("full"), 1.0)
        .when(~owned & (F.col("loose") == F.col("name_b")), 0.9)
        .when((apart <= 2) & (F.length("name_b") >= 8), 0.8)
        .otherwise(0.0)
    )
    return met.select("hint_a", "repo_b", likeness.alias("s_repo")).where("s_repo > 0")


def candidates(a: DataFrame, b: DataFrame, names: DataFrame, kinds: DataFrame, rules: Rules) -> DataFrame:
    """Pairs alike in every attribute, each once, with s_*. They meet on repository, kind of
    weakness, file name, a span of lines and, where both have one, a span of time."""
    span = F.floor(F.col("line_a") / LINE_SPAN)
    near_by = [F.floor((F.col("line_b") + d) / LINE_SPAN) for d in (-rules.lines, rules.lines)]
    slot = F.floor(F.col("time_a") / TIME_SPAN) * 4
    then = [F.floor((F.col("time_b") + d) / TIME_SPAN) * 4 for d in (-TIME_SPAN // 2, TIME_SPAN // 2)]
    timed, timeless = F.lit(1).cast("bigint"), F.lit(2).cast("bigint")  # meets rows with, without a time
    slots_a = F.when(F.col("time_a").isNull(), F.array(timed, timeless)).otherwise(F.array(slot, timeless))
    slots_b = F.when(F.col("time_b").isNull(), F.array(timeless)).otherwise(F.array_distinct(F.array(*then, timed)))
    left = a.join(names, "hint_a").join(kinds, "kind_a")
    left = left.withColumns({"base": F.substring_index("path_a", "/", -1), "span": span, "slot": F.explode(slots_a)})
    right = b.select("id_b", "repo_b", "kind_b", "path_b", "line_b", "time_b", F.substring_index("path_b", "/", -1).alias("base"), F.explode(F.array_distinct(F.array(*near_by))).alias("span"))
    right = right.withColumn("slot", F.explode(slots_b))
    pairs = left.join(right, ["repo_b", "kind_b", "base", "span", "slot"])
    return likenesses(pairs, rules).where(F.least("s_path", "s_line", "s_time") > 0).select("id_a", "id_b", "hint_a", "repo_b", *[f"s_{x}" for x in ATTRIBUTES])


def likenesses(pairs: DataFrame, rules: Rules) -> DataFrame:
    """s_path, s_line, s_time in [0, 1] beside s_repo and s_kind; 0 contradicts a link."""
    a, b = F.col("path_a"), F.col("path_b")
    ends = F.concat(F.lit("/"), b).endswith(F.concat(F.lit("/"), a)) | F.concat(F.lit("/"), a).endswith(
        F.concat(F.lit("/"), b)
    )
    bare = ~a.contains("/") | ~b.contains("/")
    path = F.when(a == b, 1.0).when(ends & ~bare, 0.85).when(ends, 0.7).otherwise(0.0)
    away = F.abs(F.col("line_a") - F.col("line_b"))
    line = F.when(away <= rules.lines, 1 - 0.2 * away / max(1, rules.lines)).otherwise(0.0)
    late = F.round(F.abs(F.col("time_a") - F.col("time_b")) / 60)
    time = (
        F.when(late.isNull(), 0.7)
        .when(late <= rules.minutes, 1 - 0.1 * late / rules.minutes)
        .when(F.abs(late - 60) <= rules.minutes, 0.75)  # one clock kept another zone or summer time
        .otherwise(0.0)
    )
    return pairs.withColumns({"s_path": path, "s_line": line, "s_time": time})


def _toward(v: np.ndarray, s: np.ndarray, up: np.ndarray | float, down: float) -> np.ndarray:
    """The point that up * max(0, s - x) + down * max(0, x - s) + (x - v)^2 / 2 is least at."""
    return np.where(v + up < s, v + up, np.where(v - down > s, v - down, s))


def settle(rows: pd.DataFrame, rules: Rules, most_steps: int = 100_000) -> np.ndarray:
    """The values of the rows' links at the minimum, by alternating directions.

    rows: family, hint_a, repo_b, free, id_a, id_b, weight and s_*; a free row has no rival. A
    family's steps end when its own values have settled, whatever other families are there."""
    out = np.zeros(len(rows))
    s_all = rows[[f"s_{x}" for x in ATTRIBUTES]].to_numpy(float)
    weight_all = rows["weight"].to_numpy(float)
    family_all = pd.factorize(rows["family"])[0]
    link_all = pd.factorize(pd.MultiIndex.from_frame(rows[["hint_a", "repo_b"]]))[0]

    def sides(name: str) -> np.ndarray:
        return np.where(rows["free"], len(rows) + np.arange(len(rows)), pd.factorize(rows[name])[0])

    side_all = [sides("id_a"), sides("id_b")]
    live = np.arange(len(rows))
    y, z = s_all.min(axis=1), np.zeros(link_all.max() + 1 if len(rows) else 0)
    np.maximum.at(z, link_all, s_all[:, 0])
    s_hint = z.copy()
    u, ue, uf = np.zeros((len(rows), COPIES)), np.zeros(len(rows)), np.zeros(len(z))
    r, k = rules.rho, len(ATTRIBUTES)
    for step in range(most_steps):
        if step % 20 == 0:
            # The rows of families that still move.
            s, w, family, link = s_all[live], weight_all[live], family_all[live], link_all[live]
            of = [np.unique(side[live], return_inverse=True)[1] for side in side_all]
            n_of = [np.bincount(x)[x] for x in of]
            up, n_link = rules.likeness * s**rules.sharpness / r, np.bincount(link, w, len(z))
            quiet = np.ones(len(live), bool)
        if not len(live):
            return out
        v = y[:, None] - u
        c = np.empty_like(v)
        c[:, :k] = _toward(v[:, :k], s, up, rules.unlikeness / r)
        c[:, k] = v[:, k] - rules.prior / r
        for j, (x, n) in enumerate(zip(of, n_of), k + 1):
            total = np.bincount(x, v[:, j])[x]
            c[:, j] = v[:, j] - np.minimum(rules.exclusive / r, np.maximum(0.0, (total - 1) / n))
        means = z[link] - ue
        move = np.minimum(rules.transitive / r, np.maximum(0.0, (v[:, -1] - means) / 2))
        c[:, -1], ce = v[:, -1] - move, means + move
        new_y = np.clip((c + u).mean(axis=1), 0.0, 1.0)
        cf = _toward(z - uf, s_hint, rules.likeness / r, rules.unlikeness / r)
        new_z = np.clip((np.bincount(link, w * (ce + ue), len(z)) + cf + uf) / (n_link + 1), 0.0, 1.0)
        u += c - new_y[:, None]
        ue += ce - new_z[link]
        uf += cf - new_z
        off = np.maximum(np.abs(new_y - y), np.maximum(np.abs(c - new_y[:, None]).max(axis=1), np.abs(ce - new_z[link])))
        off = np.maximum(off, np.abs(new_z - z)[link])
        y, z = new_y, new_z
        if step % 20 >= 15:
            quiet &= off < rules.settled
        if step % 20 == 19:
            moves = np.zeros(family_all.max() + 1, bool)
            moves[family[~quiet]] = True
            done = ~moves[family]
            out[live[done]] = y[done]
            live, y, u, ue = live[~done], y[~done], u[~done], ue[~done]
    raise RuntimeError("links have not settled")


def greedy(rows: pd.DataFrame, confidence: np.ndarray, accept: float) -> np.ndarray:
    """Which links stand: the likeliest between two free records, until none of the accepted is left."""
    alike = rows[[f"s_{x}" for x in ATTRIBUTES]].sum(axis=1).round(6)
    order = pd.DataFrame({"c": -confidence.round(3), "s": -alike.to_numpy(), "a": rows["id_a"].to_numpy(), "b": rows["id_b"].to_numpy()})
    order = order[(confidence >= accept) & ~rows["free"].to_numpy(bool)].sort_values(["c", "s", "a", "b"])
    stands = np.zeros(len(rows), bool)
    seen_a, seen_b = set(), set()
    for at, a, b in zip(order.index, order["a"], order["b"]):
        if a not in seen_a and b not in seen_b:
            seen_a.add(a)
            seen_b.add(b)
            stands[at] = True
    return stands


POSITION = ("hint_a", "repo_b", *[f"s_{x}" for x in ATTRIBUTES])
STATE = "family bigint, hint_a string, repo_b string, free boolean, id_a bigint, id_b bigint, weight bigint, " + ", ".join(f"s_{x} double" for x in ATTRIBUTES)


def families(state: DataFrame, most: int) -> DataFrame:
    """(hint_a, repo_b, family): the connected hints and repositories; in a task if there are at most `most`."""
    links = state.select("hint_a", "repo_b").distinct()
    if not small_enough(links, most):
        edges = links.select(F.concat(F.lit("h"), "hint_a").alias("src"), F.concat(F.lit("r"), "repo_b").alias("dst"))
        found = graph.components(edges).where("node like 'r%'")
        found = found.select(F.substring("node", 2, 1 << 30).alias("repo_b"), F.xxhash64("component").alias("family"))
        return links.join(found, "repo_b").select("hint_a", "repo_b", "family")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"hint_a": [], "repo_b": []}, dtype=object), *batches], ignore_index=True)
        parent: dict[tuple[int, str], tuple[int, str]] = {}

        def root(x: tuple[int, str]) -> tuple[int, str]:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for h, r in zip(rows["hint_a"], rows["repo_b"]):
            a, b = sorted((root((0, h)), root((1, r))))
            parent[b] = a
        rows["family"] = pd.factorize(pd.Series([root((0, h)) for h in rows["hint_a"]], dtype=object))[0]
        yield rows

    return links.repartition(1).mapInPandas(run, "hint_a string, repo_b string, family bigint")


def solve(state: DataFrame, rules: Rules) -> DataFrame:
    """Adds confidence, and `stands` for rows with ids: a family a task, many families a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0

        def solved(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.reset_index(drop=True)
            rows["confidence"] = settle(rows, rules)
            rows["stands"] = greedy(rows, rows["confidence"].to_numpy(), rules.accept)
            return rows

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size >= 200_000:  # all but the last family are whole
                rows = pd.concat(held)
                last = rows["family"] == rows["family"].iloc[-1]
                if not last.all():
                    yield solved(rows[~last])
                held = [rows[last]]
                size = int(last.sum())
        if held:
            yield solved(pd.concat(held))

    together = state.repartition("family").sortWithinPartitions("family")
    return together.mapInPandas(run, f"{STATE}, confidence double, stands boolean")


def solve_spread(state: DataFrame, rules: Rules, most_steps: int = 10_000) -> DataFrame:
    """The same steps with a written table each, for families that no task should hold. Sums over a
    hint's rows are pre-aggregated and come back by a join, so a hint of a third of all rows is one row a
    task; sums over a record's rivals are windows."""
    spark, r, k = state.sparkSession, rules.rho, len(ATTRIBUTES)
    unary = [f"s_{x}" for x in ATTRIBUTES]
    keep = [x.split()[0] for x in STATE.split(", ")]
    y, z = F.col("y"), F.col("z")

    def toward(v: Column, s: Column, up: Column, down: Column) -> Column:
        return F.when(v + up < s, v + up).when(v - down > s, v - down).otherwise(s)

    duals = [f"u{i}" for i in range(COPIES)]
    x = state.select(*keep, F.least(*unary).alias("y"), *[F.lit(0.0).alias(u) for u in [*duals, "ue"]])
    x, at_x = written(x)
    means = x.groupBy("hint_a", "repo_b").agg(F.max("s_repo").alias("s_hint"), F.sum("weight").alias("n"))
    means, at_m = written(means.withColumns({"z": F.col("s_hint"), "uf": F.lit(0.0), "off": F.lit(1.0)}))
    quiet = True
    for step in range(most_steps):
        now = x.join(means.select("hint_a", "repo_b", "z"), ["hint_a", "repo_b"])
        v = [y - F.col(u) for u in duals]
        copies = [
            toward(v[i], F.col(s), rules.likeness * F.pow(s, F.lit(rules.sharpness)) / r, F.lit(rules.unlikeness / r))
            for i, s in enumerate(unary)
        ]
        copies.append(v[k] - rules.prior / r)
        for j, side in enumerate(("id_a", "id_b"), k + 1):
            # Free rows are spread by what they are; they have no rivals to sum.
            rivals = Window.partitionBy("free", side, F.when(F.col("free"), F.xxhash64(*POSITION)))
            sums = {f"t_{side}": F.when(F.col("free"), v[j]).otherwise(F.sum(v[j]).over(rivals))}
            now = now.withColumns(sums | {f"n_{side}": F.when(F.col("free"), 1).otherwise(F.count(F.lit(1)).over(rivals))})
            copies.append(v[j] - F.least(F.lit(rules.exclusive / r), F.greatest(F.lit(0.0), (F.col(f"t_{side}") - 1) / F.col(f"n_{side}"))))
        move = F.least(F.lit(rules.transitive / r), F.greatest(F.lit(0.0), (v[-1] - (z - F.col("ue"))) / 2))
        copies.append(v[-1] - move)
        now = now.withColumns({f"c{i}": c for i, c in enumerate(copies)} | {"ce": z - F.col("ue") + move})
        mean = sum(F.col(f"c{i}") + F.col(u) for i, u in enumerate(duals)) / COPIES
        now = now.withColumn("new_y", F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)))
        off = F.greatest(F.abs(F.col("new_y") - y), *[F.abs(F.col(f"c{i}") - F.col("new_y")) for i in range(COPIES)])
        now = now.withColumn("off", off).drop("y").withColumnRenamed("new_y", "y")
        now, at_now = written(now.select(*keep, "y", *duals, "ue", *[f"c{i}" for i in range(COPIES)], "ce", "off"))
        totals = now.groupBy("hint_a", "repo_b").agg(F.sum(F.col("weight") * (F.col("ce") + F.col("ue"))).alias("t"), F.max("off").alias("off_y"))
        m = means.join(totals, ["hint_a", "repo_b"])
        m = m.withColumn("cf", toward(z - F.col("uf"), F.col("s_hint"), F.lit(rules.likeness / r), F.lit(rules.unlikeness / r)))
        new_z = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("t") + F.col("cf") + F.col("uf")) / (F.col("n") + 1)))
        m = m.withColumn("new_z", new_z).withColumn("off", F.greatest("off_y", F.abs(F.col("new_z") - z)))
        m = m.select("hint_a", "repo_b", "s_hint", "n", F.col("new_z").alias("z"), (F.col("uf") + F.col("cf") - F.col("new_z")).alias("uf"), "off")
        means, new_m = written(m)
        for path in (at_x, at_m):
            discard(spark, path)
        at_m = new_m
        now = now.join(means.select("hint_a", "repo_b", "z"), ["hint_a", "repo_b"])
        off_e = now.agg(F.max(F.greatest("off", F.abs(F.col("ce") - z)))).first()[0] or 0.0
        off_z = means.agg(F.max("off")).first()[0] or 0.0
        quiet = (quiet or step % 20 == 0) and (step % 20 < 15 or max(off_e, off_z) < rules.settled)  # as settle does
        if quiet and step % 20 == 19:
            return now.select(*keep, F.col("y").alias("confidence"))
        moved = {u: F.col(u) + F.col(f"c{i}") - y for i, u in enumerate(duals)} | {"ue": F.col("ue") + F.col("ce") - z}
        x, at_x = written(now.withColumns(moved).select(*keep, "y", *duals, "ue"))
        discard(spark, at_now)
    raise RuntimeError("links have not settled")


def assigned(links: DataFrame) -> DataFrame:
    """Rounds of mutual best links between free records until none is left; the greatest of all is one
    in every round, so they end. For links that no task holds."""
    alike = F.round(sum((F.col(f"s_{x}") for x in ATTRIBUTES), F.lit(0.0)), 6)
    first = [F.desc(F.round("confidence", 3)), F.desc(alike)]
    rest, done = cut(links), None
    while not rest.isEmpty():
        best = rest.withColumns(
            {
                "of_a": F.row_number().over(Window.partitionBy("id_a").orderBy(*first, "id_b")),
                "of_b": F.row_number().over(Window.partitionBy("id_b").orderBy(*first, "id_a")),
            }
        )
        taken = cut(best.where("of_a = 1 and of_b = 1").drop("of_a", "of_b"))
        done = taken if done is None else done.unionByName(taken)
        rest = rest.join(taken.select("id_a"), "id_a", "left_anti").join(taken.select("id_b"), "id_b", "left_anti")
        rest = cut(rest)
    return links.limit(0) if done is None else done


def link(left: DataFrame, right: DataFrame, a: Side, b: Side, rules: Rules = Rules(), family_rows: int = 1_000_000) -> DataFrame:
    """(id_a, id_b, confidence): links with at least rules.accept confidence, each record in at
    most one: the likeliest, then the most alike, then the smallest ids, until no accepted link is left
    between two free records.

    Rows without an id, repository, path, line or rule can't be placed and link to nothing; a
    missing time or weakness number only weakens a link. A key delivered more than once counts
    once. Empty tables link nothing. Further columns of either table are not read. A task holds families
    of up to family_rows rows; larger ones take a step a table, with the same result."""
    spark = left.sparkSession
    rows_a, rows_b = written(_rows(left, a, "a"))[0], written(_rows(right, b, "b"))[0]
    kinds = rule_likeness(rows_a, rows_b)
    pairs, at_pairs = written(candidates(rows_a, rows_b, meanings(rows_a, rows_b), kinds, rules))
    counted = pairs.withColumns({f"n_{t}": F.count(F.lit(1)).over(Window.partitionBy(f"id_{t}")) for t in "ab"})
    counted = written(counted.withColumn("free", (F.col("n_a") == 1) & (F.col("n_b") == 1)).drop("n_a", "n_b"))[0]
    discard(spark, at_pairs)
    positions = counted.where("free").groupBy(*POSITION).agg(F.count(F.lit(1)).alias("weight"))
    rivals = counted.where("not free").select(*POSITION, F.lit(1).cast("bigint").alias("weight"), "id_a", "id_b", "free")
    nobody = F.lit(0).cast("bigint")
    state = positions.withColumns({"id_a": nobody, "id_b": nobody, "free": F.lit(True)}).unionByName(rivals)
    state = state.join(families(counted, family_rows), ["hint_a", "repo_b"]).select(*[x.split()[0] for x in STATE.split(", ")])
    state = written(state)[0]
    large = state.groupBy("family").count().where(F.col("count") > family_rows).select("family")
    solved, at_solved = written(solve(state.join(large, "family", "left_anti"), rules))
    if not large.isEmpty():
        spread = solve_spread(state.join(large, "family", "left_semi"), rules)
        stands = assigned(spread.where((F.col("confidence") >= rules.accept) & ~F.col("free")))
        stands = stands.select("id_a", "id_b", F.lit(False).alias("free"), F.lit(True).alias("stands"))
        spread = spread.join(stands, ["id_a", "id_b", "free"], "left").withColumn("stands", F.coalesce("stands", F.lit(False)))
        solved = solved.unionByName(spread.select(solved.columns))
    placed = counted.where("free").join(solved.where("free").select(*POSITION, "confidence"), list(POSITION))
    placed = placed.where(F.col("confidence") >= rules.accept).select("id_a", "id_b", "confidence")
    return placed.unionByName(solved.where("stands").select("id_a", "id_b", "confidence"))
