"""Measures of commit histories, all repositories at once. Commits as sources.gitlog gives them,
with a repo column; `now` is a parameter everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnwork.operators import stats
from kilnwork.runtime import discard, written

# Fixed values of the measures.
CONVENTIONAL = r"^(feat|fix|docs|style|refactor|perf|test|build|ci|chore|revert)(\([^)]+\))?!?: .+"
LOW_INFO = r"(?i)^(fix|fixes|fixed|update|updates|updated|wip|test|tests|asdf|misc|changes|minor|stuff|\.)\.?$"
SQUASHED = r"\(#\d+\)\s*$"
BOTS = ("[bot]", "dependabot", "renovate", "github-actions")
LOCKS = (
    "package-lock.json yarn.lock pnpm-lock.yaml npm-shrinkwrap.json poetry.lock pipfile.lock uv.lock cargo.lock "
    "composer.lock gemfile.lock go.sum"
).split()
GENERATED = r"(^|/)(dist|build|vendor|node_modules)/|\.min\.js$|\.min\.css$|\.map$"
RECENT, SHORTEST, ACTIVE, TARGET = 90 * 86400, 8, 10, 3


def is_bot(author: Column) -> Column:
    lower = F.lower(author)
    out = F.lit(False)
    for mark in BOTS:
        out = out | lower.contains(mark)
    return out


def is_excluded(path: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    return name.isin(*LOCKS) | path.rlike(GENERATED)


def is_low_info(subject: Column) -> Column:
    plain = F.trim(subject)
    return (F.length(plain) < SHORTEST) | plain.rlike(LOW_INFO)


def email(author: Column) -> Column:
    inner = F.regexp_extract(author, r"<([^<>]*)>?\s*$", 1)
    return F.lower(F.trim(F.when(inner == "", author).otherwise(inner)))


def messages(commits: DataFrame) -> DataFrame:
    own = commits.where("not is_merge")
    return own.groupBy("repo").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.trim("subject").rlike(CONVENTIONAL).cast("int")).alias("conventional_share"),
        F.avg(is_low_info(F.col("subject")).cast("int")).alias("low_info_share"),
        F.avg(F.length(F.trim("subject"))).alias("mean_length"),
    )


def recency(commits: DataFrame, now: int) -> DataFrame:
    return commits.groupBy("repo").agg(
        F.max("at").alias("last_at"),
        F.greatest(F.lit(0.0), (now - F.max("at")) / 86400).alias("days_since"),
        F.count_if(~F.col("is_merge") & (F.col("at") >= now - RECENT)).alias("recent"),
    )


def recency_decay(days: Column) -> Column:
    """1 today, about a third after a year."""
    return F.exp(-days / 365)


def _changes(commits: DataFrame) -> DataFrame:
    each = commits.where("not is_merge").select("repo", "sha", email(F.col("author")).alias("who"), F.explode("files").alias("f"))
    return each.select("repo", "sha", "who", "f.*").where(~is_excluded(F.col("path")))


def authors(commits: DataFrame) -> DataFrame:
    """(repo, authors, bus_factor, author_gini): people only, bots left out."""
    own = commits.where("not is_merge").where(~is_bot(F.col("author")))
    n = own.groupBy("repo", email(F.col("author")).alias("who")).agg(F.count(F.lit(1)).alias("n"))
    lines = _changes(own).groupBy("repo", "who").agg(F.sum(F.coalesce("added", F.lit(0)) + F.coalesce("deleted", F.lit(0))).alias("lines"))
    out = n.groupBy("repo").agg(F.count(F.lit(1)).alias("authors"))
    return out.join(stats.bus_factor(lines, ["repo"], "who", "lines"), "repo", "left").join(
        stats.gini(n, ["repo"], "n").withColumnRenamed("gini", "author_gini"), "repo", "left"
    )


def churn(commits: DataFrame, present: DataFrame) -> DataFrame:
    """(repo, path, n): commits that touched a file still there."""
    each = _changes(commits).select("repo", "sha", "path").distinct()
    return each.join(present.select("repo", "path").distinct(), ["repo", "path"], "left_semi").groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n"))


def top_tenth(values: DataFrame, value: str) -> DataFrame:
    """Each repo's first tenth of paths, at least one, without zeros."""
    order = Window.partitionBy("repo").orderBy(F.desc(value), "path")
    of = F.count(F.lit(1)).over(Window.partitionBy("repo"))
    placed = values.withColumns({"_k": F.row_number().over(order), "_of": of})
    return placed.where((F.col("_k") <= F.greatest(F.lit(1), F.ceil(F.col("_of") / 10))) & (F.col(value) > 0)).drop("_k", "_of")


def hotspots(churned: DataFrame, complexity: DataFrame) -> DataFrame:
    """Paths in the first tenth both by commits and by complexity."""
    return top_tenth(churned, "n").join(top_tenth(complexity, "complexity"), ["repo", "path"])


def main_line(commits: DataFrame, heads: DataFrame, most: int = 40) -> DataFrame:
    """(repo, sha): commits on the line of first parents from each repo's head.

    Pointers double every round, so a line of n commits takes about log2(n) rounds."""
    spark = commits.sparkSession
    to = commits.select("repo", "sha", F.get("parents", F.lit(0)).alias("to"))
    known = commits.select("repo", "sha").distinct()
    to = to.join(known.withColumnRenamed("sha", "to"), ["repo", "to"], "left_semi").select("repo", "sha", "to")
    jumps, at_j = written(to.dropDuplicates(["repo", "sha"]))
    line, at_l = written(heads.select("repo", "sha").join(known, ["repo", "sha"], "left_semi"))
    n = line.count()
    for _ in range(most):
        ahead = line.join(jumps, ["repo", "sha"]).select("repo", F.col("to").alias("sha"))
        new, at_n = written(line.unionByName(ahead).distinct())
        far = jumps.alias("a").join(jumps.alias("b"), (F.col("a.repo") == F.col("b.repo")) & (F.col("a.to") == F.col("b.sha")))
        doubled, at_d = written(far.select("a.repo", "a.sha", "b.to"))
        grown = new.count()
        discard(spark, at_j)
        discard(spark, at_l)
        line, at_l, jumps, at_j = new, at_n, doubled, at_d
        if grown == n:
            break
        n = grown
    else:
        raise RuntimeError("the line has not ended")
    discard(spark, at_j)
    return line


def review_flow(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """(repo, n, direct_ratio): the share of the main line that came neither by merge nor squash."""
    line = main_line(commits, heads).join(commits.select("repo", "sha", "is_merge", "subject"), ["repo", "sha"])
    direct = ~(F.col("is_merge") | F.col("subject").rlike(SQUASHED))
    return line.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.avg(direct.cast("int")).alias("direct_ratio"))


def report(commits: DataFrame, heads: DataFrame, present: DataFrame, now: int, least: int = 5) -> DataFrame:
    """(repo, components, score): null components are skipped, not zero; short histories have none."""
    n = commits.groupBy("repo").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    all_ = n
    for part in (messages(commits).drop("n"), recency(commits, now), authors(commits), review_flow(commits, heads).drop("n")):
        all_ = all_.join(part, "repo", "left")
    parts = {
        "conventional": F.col("conventional_share"),
        "informative": 1 - F.col("low_info_share"),
        "recency": recency_decay(F.col("days_since")),
        "activity": F.least(F.lit(1.0), F.col("recent") / ACTIVE),
        "bus_factor": F.least(F.lit(TARGET), F.col("bus_factor")) / TARGET,
        "concentration": 1 - F.col("author_gini"),
        "review_flow": 1 - F.col("direct_ratio"),
    }
    entries = F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v.cast("double"))])
    out = all_.select("repo", entries.alias("components"))
    return out.withColumn("score", mean_of(F.col("components")))


def mean_of(components: Column) -> Column:
    """The mean of a map's values that aren't null; null if all are."""
    values = F.filter(F.map_values(components), lambda v: v.isNotNull())
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values))
