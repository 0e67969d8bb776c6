"""Release order of two ecosystems as sortable columns, ranges' lower bounds, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEMVER = r"^[v=\s]*(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"
EPOCHED = r"^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[._-]?(a|alpha|b|beta|c|rc|pre|preview)[._-]?(\d*))?(?:(?:[._-]?(?:post|rev|r)[._-]?|-)(\d+))?(?:[._-]?dev[._-]?(\d*))?(?:\+[a-z0-9._-]+)?\s*$"


def _number(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")).try_cast("bigint"), F.lit(0))


def npm_key(text: Column) -> Column:
    """A comparable struct: numbers, releases after their pre-releases, identifiers by value before
    words; null for what isn't a version."""
    part = lambda k: F.regexp_extract(text, SEMVER, k)
    pre = part(4)
    ids = F.transform(
        F.split(pre, r"\."),
        lambda x: F.struct(
            F.when(x.rlike(r"^\d+$"), 0).otherwise(1).alias("word"),
            F.when(x.rlike(r"^\d+$"), x.try_cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("n"),
            F.when(x.rlike(r"^\d+$"), "").otherwise(x).alias("w"),
        ),
    )
    key = F.struct(
        F.array(_number(part(1)), _number(part(2)), _number(part(3))).alias("release"),
        (pre == "").cast("int").alias("final"),
        F.when(pre == "", F.slice(ids, F.lit(1), F.lit(0))).otherwise(ids).alias("pre"),
    )
    return F.when(text.rlike(SEMVER), key)


def pypi_key(text: Column) -> Column:
    """A comparable struct: epoch, release without trailing zeros, dev before pre-releases before
    the release before its posts; null for what isn't a version."""
    low = F.lower(text)
    part = lambda k: F.regexp_extract(low, EPOCHED, k)
    release = F.transform(F.split(F.regexp_replace(part(2), r"(\.0+)+$", ""), r"\."), lambda x: _number(x))
    dev = low.rlike(r"dev")
    kind = F.when(part(3).isin("a", "alpha"), 1).when(part(3).isin("b", "beta"), 2).when(part(3) != "", 3)
    phase = F.when(kind.isNotNull(), kind).when(dev & (part(5) == ""), 0).otherwise(4)
    key = F.struct(
        _number(part(1)).alias("epoch"),
        release.alias("release"),
        phase.alias("phase"),
        _number(part(4)).alias("pre"),
        F.when(part(5) != "", _number(part(5)) + 1).otherwise(0).alias("post"),
        F.when(dev, 0).otherwise(1).alias("no_dev"),
        _number(part(6)).alias("dev"),
    )
    return F.when(low.rlike(EPOCHED), key)


def is_prerelease(ecosystem: Column, text: Column) -> Column:
    npm = F.regexp_extract(text, SEMVER, 4) != ""
    low = F.lower(text)
    return F.when(ecosystem == "npm", npm).otherwise((F.regexp_extract(low, EPOCHED, 3) != "") | low.rlike("dev"))


def minimum(spec: Column) -> Column:
    """(version, exact) of the first clause of a range that bounds it from below; null for none.
    Of npm's alternatives the first counts."""
    clause = r"^\s*(===|==|>=|~=|\^|~|>|=)?\s*v?(\d[0-9A-Za-z.!+*-]*)\s*$"
    clauses = F.filter(F.split(F.regexp_replace(spec, r"\s+-\s+\S+|\|\|.*$", ""), r",|\s+(?=[\^~<>=\d])"), lambda c: c.rlike(clause))
    first = F.get(clauses, F.lit(0))
    operator, text = F.regexp_extract(first, clause, 1), F.regexp_extract(first, clause, 2)
    plain = F.regexp_replace(text, r"(\.[*xX])+$", "")
    exact = operator.isin("==", "===", "=") | ((operator == "") & (plain == text))
    return F.when(first.isNotNull(), F.struct(plain.alias("version"), (exact & ~text.contains("*")).alias("exact")))


def freshness(installed: DataFrame, releases: DataFrame, key: str = "npm") -> DataFrame:
    """(name, installed, versions_behind, majors_behind, score): final releases between what is
    installed and the latest. installed: name, installed; releases: name, version, latest."""
    of = npm_key if key == "npm" else pypi_key
    major = lambda k: F.when(k["release"][0] > 0, k["release"][0]).otherwise(-F.coalesce(F.get(k["release"], F.lit(1)), F.lit(0)) - 1)
    there = releases.where(~is_prerelease(F.lit(key), F.col("version"))).select("name", "version", of(F.col("version")).alias("k"), of(F.col("latest")).alias("top"), "latest")
    there = there.where("k is not null").withColumn("ceiling", F.when(~is_prerelease(F.lit(key), F.col("latest")), F.col("top")))
    have = installed.select("name", "installed", of(F.col("installed")).alias("have")).where("have is not null")
    newer = (F.col("k") > F.col("have")) & (F.col("ceiling").isNull() | (F.col("k") <= F.col("ceiling")))
    higher = newer & (F.col("k.release")[0] > F.col("have.release")[0])
    small = newer & (F.col("k.release")[0] == 0) & (F.get("k.release", F.lit(1)) > F.get("have.release", F.lit(1)))
    out = have.join(there, "name").groupBy("name", "installed").agg(
        F.count_if(newer).alias("versions_behind"),
        F.count_distinct(F.when(higher | small, major(F.col("k")))).alias("majors_behind"),
    )
    n = F.col("versions_behind")
    factor = F.when(n <= 2, 1.0).when(n <= 10, 0.8).otherwise(0.6)
    return out.withColumn("score", factor / (1 + F.col("majors_behind")))
