"""Health of declared dependencies: unused, undeclared, too many, outdated, within a look-up budget.

Declared: repo, ecosystem, name, kind ('runtime', 'optional', 'dev'), manifest. Everything between tables is an
equi-join or an anti-join on repo, ecosystem and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnwork.functions import paths as fp

BY = ["repo", "ecosystem", "name"]


def clamp01(value: Column) -> Column:
    return F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def canonical(ecosystem: Column, name: Column) -> Column:
    """Names that an index takes for one."""
    return F.when(F.lower(ecosystem) == "pypi", F.regexp_replace(F.lower(name), "[-_.]+", "-")).otherwise(name)


def transitive_component(transitive: Column, direct: Column) -> Column:
    """1 up to ten transitive dependencies a direct one, then falling; a half at sixty."""
    excess = F.greatest(F.lit(0), transitive - 10 * direct)
    return 1 / (1 + excess / (50 * F.greatest(F.lit(1), direct)))


def words_in(text: Column) -> Column:
    """What a text mentions as a word: runs of letters, digits and hyphens, with each longer run that dots
    make of them, and scoped names. Words after '@', '.' or a hyphen aren't mentions."""
    runs = F.regexp_extract_all(text, F.lit(r"(?<![\w@.-])[\w-]+(?:\.[\w-]+)*"), 0)

    def heads(run: Column) -> Column:
        parts = F.split(run, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))

    scoped = F.regexp_extract_all(text, F.lit(r"(?<![\w@.-])@[\w.-]+/[\w.-]*\w"), 0)
    return F.array_distinct(F.concat(F.flatten(F.transform(runs, heads)), scoped))


def unused(declared: DataFrame, used: DataFrame, corpus: DataFrame, allowed: list[str]) -> DataFrame:
    """Declared dependencies that no module imports, that aren't tools by name and that no tool's file
    (repo, text) mentions."""
    key = canonical(F.col("ecosystem"), F.col("name"))
    rows = declared.withColumn("_key", key)
    imported = used.select("repo", "ecosystem", key.alias("_key")).distinct()
    left = rows.join(imported, ["repo", "ecosystem", "_key"], "left_anti").where(~fp.matches_any(F.col("_key"), allowed))
    said = corpus.select("repo", F.explode(words_in(F.col("text"))).alias("w"))
    said = said.select("repo", F.explode(F.array(F.struct(F.lit("pypi").alias("e"), canonical(F.lit("pypi"), F.col("w")).alias("_key")), F.struct(F.lit("npm").alias("e"), F.col("w").alias("_key")))).alias("s"))
    said = said.select("repo", "s.e", "s._key").distinct()
    return left.withColumn("e", F.lower("ecosystem")).join(said, ["repo", "e", "_key"], "left_anti").drop("e", "_key")


def undeclared(imported: DataFrame, declared: DataFrame) -> DataFrame:
    """(repo, ecosystem, name, path, line): packages from outside that no manifest declares, at their first
    import. Ecosystems without a manifest in the repo aren't judged."""
    key = canonical(F.col("ecosystem"), F.col("name")).alias("name")
    own = declared.select("repo", "ecosystem", key).distinct()
    first = imported.select("repo", "ecosystem", key, "path", "line").groupBy(*BY).agg(F.min(F.struct("path", "line")).alias("f"))
    judged = first.join(own.select("repo", "ecosystem").distinct(), ["repo", "ecosystem"], "left_semi")
    return judged.join(own, BY, "left_anti").select(*BY, "f.path", "f.line")


def direct_counts(declared: DataFrame, baselines: dict[str, int]) -> DataFrame:
    """(repo, ecosystem, runtime, dev, component): 1 up to the ecosystem's baseline, then its share."""
    n = F.count_if(F.col("kind").isin("runtime", "dev"))
    base = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in baselines.items() for x in kv]), F.col("ecosystem")), F.lit(1))
    out = declared.groupBy("repo", "ecosystem").agg(F.count_if(F.col("kind") == "runtime").alias("runtime"), F.count_if(F.col("kind") == "dev").alias("dev"), n.alias("n"))
    return out.withColumn("component", clamp01(base / F.greatest(F.col("n"), base))).drop("n")


def within_budget(declared: DataFrame, most: int) -> DataFrame:
    """Adds place and looked_up: the first `most` of a repo, runtime ones before others, then by name."""
    order = Window.partitionBy("repo").orderBy((F.col("kind") != "runtime").cast("int"), "ecosystem", "name")
    return declared.withColumn("place", F.row_number().over(order)).withColumn("looked_up", F.col("place") <= most)


def registry_versions(payloads: DataFrame) -> DataFrame:
    """(ecosystem, name, version, size, files, latest) of index payloads (ecosystem, name, payload): live
    releases of the one, versions of the other. What isn't of the shape has none."""
    file = "struct<size: bigint, yanked: boolean>"
    pypi = F.from_json("payload", f"struct<releases: map<string, array<{file}>>, info: struct<version: string>>")
    npm = F.from_json("payload", "struct<versions: map<string, struct<dist: struct<unpackedSize: bigint, fileCount: int>>>, `dist-tags`: struct<latest: string>>")
    a = payloads.where(F.lower("ecosystem") == "pypi").withColumn("p", pypi).select("ecosystem", "name", F.col("p.info.version").alias("latest"), F.explode("p.releases").alias("version", "all"))
    a = a.withColumn("live", F.filter("all", lambda f: ~F.coalesce(f["yanked"], F.lit(False)))).where(F.size("live") > 0)
    a = a.select("ecosystem", "name", "version", F.array_min(F.transform("live", lambda f: f["size"])).alias("size"), F.lit(None).cast("int").alias("files"), "latest")
    b = payloads.where(F.lower("ecosystem") == "npm").withColumn("p", npm).select("ecosystem", "name", F.col("p")["dist-tags"]["latest"].alias("latest"), F.explode("p.versions").alias("version", "v"))
    return a.unionByName(b.select("ecosystem", "name", "version", F.col("v.dist.unpackedSize").alias("size"), F.col("v.dist.fileCount").alias("files"), "latest"))


def behind(installed: DataFrame, versions: DataFrame, key: Column) -> DataFrame:
    """installed (…, ecosystem, name, version) with versions_behind and majors_behind: releases above the
    installed one. key: an orderable array of numbers of `version`."""
    known = versions.select("ecosystem", "name", key.alias("k")).distinct()
    each = installed.withColumn("i", key).join(known, ["ecosystem", "name"], "left")
    newer = F.col("k") > F.col("i")
    majors = F.greatest(F.lit(0), F.max(F.col("k")[0]) - F.first(F.col("i")[0]))
    return each.groupBy(*installed.columns).agg(F.count_if(newer).alias("versions_behind"), F.coalesce(majors, F.lit(0)).cast("int").alias("majors_behind"))


def outdated(lagging: DataFrame, most: int = 50) -> DataFrame:
    """The repo's dependencies a major or more than two versions behind, the furthest first."""
    order = Window.partitionBy("repo").orderBy(F.desc("majors_behind"), F.desc("versions_behind"), "name", "ecosystem")
    late = lagging.where("majors_behind > 0 or versions_behind > 2").withColumn("place", F.row_number().over(order))
    return late.where(F.col("place") <= most)
