"""Joins to small dimensions: site rules by host suffix, robots rules by longest match."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import host, path

#: Bytes of a dimension that may be broadcast.
SMALL_BYTES = 32 << 20


def small(df: DataFrame) -> DataFrame:
    """A hint to broadcast, if the plan's statistics say that the table is small; else it is joined as any other."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= SMALL_BYTES else df


def host_suffixes(h: str | Column) -> Column:
    """The host and each of its parents, nearest first."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def with_site(pages: DataFrame, sites: DataFrame, url: str = "url", key: str = "page_id", take: list[str] | None = None) -> DataFrame:
    """Each page with the first record of its chain: the host itself, then each parent (exact, then wildcard), then global."""
    take = take or [c for c in sites.columns if c not in ("host", "kind", "ord")]
    h = host(url)
    names = pages.select(key, F.posexplode(host_suffixes(h)).alias("level", "name"))
    own = sites.select("kind", "ord", F.col("host").alias("name"), *take)
    near = names.join(small(own.where("kind != 'global'")), "name").where("not (kind = 'wildcard' and level = 0)")
    ranked = near.withColumn("rank", F.struct("level", F.when(F.col("kind") == "exact", 0).otherwise(1).alias("k"), "ord"))
    best = ranked.groupBy(key).agg(F.min_by(F.struct(*take), "rank").alias("__site"))
    everywhere = own.where("kind = 'global'").groupBy().agg(F.min_by(F.struct(*take), "ord").alias("__global"))
    out = pages.join(best, key, "left").crossJoin(F.broadcast(everywhere))  # one row
    return out.withColumn("__site", F.coalesce("__site", "__global")).select(*pages.columns, "__site.*")


def filled_from_site(df: DataFrame, lists: dict[str, str], joined: dict[str, str], either: dict[str, str], texts: dict[str, str]) -> DataFrame:
    """Request values completed by a site's: lists and texts where the request's are empty, joined lists site first, flags by or."""
    out = df
    for own, site in lists.items():
        out = out.withColumn(own, F.when(F.size(F.coalesce(own, F.array().cast("array<string>"))) == 0, F.coalesce(site, F.array().cast("array<string>"))).otherwise(F.col(own)))
    for own, site in joined.items():
        out = out.withColumn(own, F.concat(F.coalesce(site, F.array().cast("array<string>")), F.coalesce(own, F.array().cast("array<string>"))))
    for own, site in either.items():
        out = out.withColumn(own, F.coalesce(F.col(own), F.lit(False)) | F.coalesce(F.col(site), F.lit(False)))
    for own, site in texts.items():
        out = out.withColumn(own, F.when(F.coalesce(F.col(own), F.lit("")) == "", F.col(site)).otherwise(F.col(own)))
    return out


def with_robots(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id") -> DataFrame:
    """Adds allowed by rules(host, pattern, allow): the longest match decides, a disallow wins a tie, no match allows.

    Patterns are prefixes with "*" for any run and a last "$" for the end.
    """
    asked = pages.select(key, host(url).alias("host"), F.when(path(url) == "", "/").otherwise(path(url)).alias("path"))
    quoted = F.regexp_replace("pattern", r"([\\.^$|?+()\[\]{}*])", r"\\$1")
    ends = F.col("pattern").endswith("$")
    regex = F.regexp_replace(F.regexp_replace(quoted, r"\\\*", ".*?"), r"\\\$$", "")
    shaped = rules.where("pattern != ''").withColumn("regex", F.concat(F.lit("^"), regex, F.when(ends, "$").otherwise("")))
    hits = asked.join(small(shaped), "host").withColumn("m", F.expr("regexp_extract(path, concat('(', regex, ')'), 1)")).where(F.expr("path rlike regex"))
    best = hits.groupBy(key).agg(F.max_by("allow", F.struct(F.char_length("m"), ~F.col("allow"))).alias("allowed"))
    return pages.join(best, key, "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
