"""Site evidence and design tokens: names against brands, hashes against references, feeds, ages,
points to scores; weighted histograms of computed styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kilnwork.functions import near as near_keys
from kilnwork.functions import web
from kilnwork.functions.findings import risk_level

BASES = (12, 10, 8, 6, 5, 4, 2)  # fixed value: spacing units, the largest that fits wins
# Days a domain has existed and what that says.
AGES = ((7, "under a week"), (30, "under a month"), (90, "under three months"), (365, "under a year"))


def age_bucket(registered: Column, now: Column) -> Column:
    """Neutral between one and three years; null without a date."""
    days = F.datediff(now, registered)
    out = F.when(days.isNull(), None)
    for below, name in AGES:
        out = out.when(days < below, name)
    return out.when(days >= 1095, "over three years").otherwise("neutral")


def imitated_brands(hosts: DataFrame, brands: DataFrame) -> DataFrame:
    """(host, brand, rule): the first brand, by `place`, that a host's name imitates, and how:
    looks the same, looks the same in plain letters, is an edit or two away, or has it as a word.

    Brands are a reference list. Equality rules are equi-joins; near names meet on a part
    that two edits leave whole, so no host meets every brand."""
    h = hosts.select("host", F.substring_index(web.registrable(F.col("host")), ".", 1).alias("label")).distinct()
    h = h.withColumns({"skeleton": web.skeleton(F.col("label"))})
    h = h.withColumn("plain", web.ascii_skeleton(F.col("label")))
    b = brands.select("brand", "place", F.lower("keyword").alias("keyword"))

    same = h.join(b, h["skeleton"] == b["keyword"]).select("host", "brand", "place", F.when(F.col("label") == F.col("keyword"), 0).otherwise(1).alias("rule"))
    plain = h.join(b, h["plain"] == b["keyword"]).select("host", "brand", "place", F.lit(2).alias("rule"))
    parts = b.where("length(keyword) >= 5").select("brand", "place", "keyword", F.explode(near_keys.part_keys(F.col("keyword"))).alias("g"))
    near = h.select("host", "skeleton", F.explode(near_keys.probe_keys(F.col("skeleton"))).alias("g")).join(parts, "g")
    most = F.when(F.length("keyword") >= 8, 2).otherwise(1)
    near = near.where((F.levenshtein("skeleton", "keyword") <= most) & (F.col("skeleton") != F.col("keyword"))).select("host", "brand", "place", F.lit(3).alias("rule"))
    word = h.select("host", F.explode(web.words_of(F.col("label"))).alias("keyword")).join(b, "keyword").select("host", "brand", "place", F.lit(4).alias("rule"))
    every = same.unionByName(plain).unionByName(near).unionByName(word)
    names = F.array(*map(F.lit, ("exact", "looks the same", "plain letters", "near", "word")))
    best = every.groupBy("host").agg(F.min(F.struct("place", "rule", "brand")).alias("m"))
    return best.select("host", "m.brand", F.element_at(names, F.col("m.rule") + 1).alias("rule"))


def brands_of(domains: DataFrame, brands: DataFrame) -> DataFrame:
    """(domain, brand): the first brand, by `place`, that owns a domain or one above it. brands: brand, place,
    domain. A domain meets brands on each of its endings, so none meets all."""
    labels = F.split("domain", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    each = domains.where("domain is not null").select("domain", F.explode(endings).alias("owned")).distinct()
    met = each.join(brands.select("brand", "place", F.col("domain").alias("owned")), "owned")
    return met.groupBy("domain").agg(F.min(F.struct("place", "brand")).alias("m")).select("domain", "m.brand")


def feed_keys(feed: DataFrame) -> DataFrame:
    """(key): a feed's addresses and, as 'host:…', their hosts."""
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1))
    return feed.select(F.col("url").alias("key")).unionByName(feed.where(host != "").select(F.concat(F.lit("host:"), host).alias("key"))).distinct()


def link_brands(links: DataFrame, share: float = 0.5, least: int = 5) -> DataFrame:
    """(page, brand, share): the brand that at least half of a page's links, five or more, lead to."""
    n = links.groupBy("page", "brand").agg(F.count(F.lit(1)).alias("n"))
    all_ = links.groupBy("page").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= least)
    best = n.where("brand is not null").groupBy("page").agg(F.max(F.struct("n", "brand")).alias("m"))
    out = best.join(all_, "page").select("page", "m.brand", (F.col("m.n") / F.col("total")).alias("share"))
    return out.where(F.col("share") >= share)


def top_shares(styles: DataFrame, by: list[str], value: str, most: int = 5, least: float = 0.02) -> DataFrame:
    """The most used values with a share of at least `least`, `most` of them."""
    order = Window.partitionBy(*by).orderBy(F.desc("weight"), value)
    kept = usage_shares(styles, by, value, F.lit(1), least)
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def color_weights(styles: DataFrame) -> DataFrame:
    """(page, color, role, weight) of computed styles (page, area, above_fold, is_button, size, background, text):
    backgrounds weigh their area, twice above the fold, four times on buttons; texts by the root of their size."""
    at = F.when(F.col("above_fold"), 2.0).otherwise(1.0) * F.when(F.col("is_button"), 4.0).otherwise(1.0)
    back = F.struct(F.col("background").alias("color"), F.lit("background").alias("role"), (F.col("area") * at).alias("weight"))
    front = F.struct(F.col("text").alias("color"), F.lit("text").alias("role"), (F.col("area") * at * F.sqrt(F.col("size") / 16)).alias("weight"))
    each = styles.select("page", F.explode(F.array(back, front)).alias("s")).select("page", "s.*").where("color is not null")
    return each.groupBy("page", "color", "role").agg(F.sum("weight").alias("weight"))


def nearest_color(asked: DataFrame, seen: DataFrame, most: float = 0.04, cell: float = 0.04) -> DataFrame:
    """(page, color, match, distance): the nearest seen colour within `most`, the first of equals. asked and
    seen: page, color, l, a, b of OKLab. Colours meet on cells of a grid as wide as the reach and its neighbours,
    which the seen ones are repeated for. The planner doesn't count repeats, so neither side may be broadcast."""
    width = max(most, cell)
    at = [F.floor(F.col(c) / width).cast("int") for c in "lab"]
    near = lambda x: F.explode(F.array(x - 1, x, x + 1))
    cells = asked.select("page", "color", "l", "a", "b", *[x.alias(f"g{i}") for i, x in enumerate(at)])
    there = seen.select("page", F.col("color").alias("match"), "l", "a", "b", near(at[0]).alias("g0")).withColumn("g1", near(at[1])).withColumn("g2", near(at[2]))
    there = there.withColumnsRenamed({c: f"s{c}" for c in "lab"})
    apart = F.sqrt(sum((F.pow(F.col(c) - F.col(f"s{c}"), F.lit(2)) for c in "ab"), F.pow(F.col("l") - F.col("sl"), F.lit(2))))
    met = cells.join(there.hint("merge"), ["page", "g0", "g1", "g2"]).withColumn("distance", apart).where(F.col("distance") <= most)
    best = met.groupBy("page", "color").agg(F.min(F.struct("distance", "match")).alias("m"))
    return best.select("page", "color", "m.match", "m.distance")


def nearest_reference(pages: DataFrame, references: DataFrame, most_references: int = 10_000) -> DataFrame:
    """(page, reference, similarity): the most similar reference screenshot, the first of equals.
    The list of references is counted and refused beyond a bound, as every page meets it."""
    if references.limit(most_references + 1).count() > most_references:
        raise ValueError("too many references to meet every page")
    rows = references.select("reference", "place", F.col("hash").alias("ref_hash"))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("place", "reference", "ref_hash"))).alias("refs"))
    refs = listed.first()["refs"]
    if not refs:
        return pages.limit(0).select("page", F.lit("").alias("reference"), F.lit(0.0).alias("similarity"))
    kind = listed.schema["refs"].dataType.simpleString()
    known = pages.sparkSession.createDataFrame([(refs,)], f"refs {kind}").select("refs", F.lit(1).alias("_one"))
    each = pages.select("page", "hash", F.lit(1).alias("_one")).join(F.broadcast(known), "_one").select("page", "hash", F.explode("refs").alias("r"))
    s = web.hash_similarity(F.col("hash"), F.col("r.ref_hash"))
    scored = each.select("page", F.struct(s.alias("similarity"), (-F.col("r.place")).alias("p"), F.col("r.reference").alias("reference")).alias("m")).where("m.similarity is not null")
    return scored.groupBy("page").agg(F.max("m").alias("m")).select("page", "m.reference", "m.similarity")


def listed_addresses(urls: DataFrame, feed: DataFrame) -> DataFrame:
    """(url, by): addresses in a feed, whole first, then by their host."""
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1))
    u = urls.select("url", host.alias("host"))
    whole = feed.select("url").distinct().withColumn("_u", F.lit(True))
    hosts = feed.select(host.alias("host")).distinct().withColumn("_h", F.lit(True))
    both = u.join(whole, "url", "left").join(hosts, "host", "left")
    by = F.when(F.col("_u"), "url").when(F.col("_h"), "host")
    return both.select("url", by.alias("by")).where("by is not null")


def assessed(evidence: DataFrame) -> DataFrame:
    """(record_id, score, level, top): points summed within 0 to 100, and the three weightiest."""
    order = Window.partitionBy("record_id").orderBy(F.desc(F.abs("points")), "category", "signal")
    placed = evidence.withColumn("_k", F.row_number().over(order))
    top = F.array_sort(F.collect_list(F.when((F.col("_k") <= 3) & (F.col("points") != 0), F.struct("_k", "signal"))))
    out = placed.groupBy("record_id").agg(F.sum("points").alias("_p"), top.alias("_t"))
    score = F.round(F.greatest(F.lit(0), F.least(F.lit(100), F.col("_p")))).cast("int")
    return out.select("record_id", score.alias("score"), risk_level(score).alias("level"), F.col("_t.signal").alias("top"))


def usage_shares(styles: DataFrame, by: list[str], value: str, weight: Column, least: float = 0.005) -> DataFrame:
    """(by, value, weight, share): a weighted histogram without what is below a share."""
    w = styles.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.sum(weight).alias("weight"))
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy(*by))
    return w.withColumn("share", share).where(F.col("share") >= least)


def spacing_base(values: DataFrame, by: list[str], px: str, share: float = 0.8) -> DataFrame:
    """(by, base): the largest unit that divides four fifths of the values; null if none does."""
    counted = values.where(F.col(px) > 0).groupBy(*by, px).agg(F.count(F.lit(1)).alias("n"))
    sums = counted.groupBy(*by).agg(F.sum("n").alias("_all"), *[F.sum(F.when(F.col(px) % b == 0, F.col("n")).otherwise(0)).alias(f"_{b}") for b in BASES])
    base = F.coalesce(*[F.when(F.col(f"_{b}") >= share * F.col("_all"), b) for b in BASES])
    return sums.select(*by, base.alias("base"))


def sampled(urls: DataFrame, most: int, seed: str) -> DataFrame:
    """(url, domain): the first address of each registrable domain in an order that the seed gives, `most` of
    the domains in that order."""
    order = F.md5(F.concat(F.lit(seed), "url"))
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1))
    each = urls.select("url", web.registrable(host).alias("domain"), order.alias("o")).distinct()
    first = each.groupBy("domain").agg(F.min(F.struct("o", "url")).alias("m"))
    return first.orderBy("m.o").limit(most).select("m.url", "domain")
