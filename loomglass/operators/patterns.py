"""Repeating URL shapes of pages: grouping, ranking, confidence."""

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import host, slug, url_pattern

MIN_ITEMS = 3


def with_pattern(links: DataFrame, url: str = "url", site: str = "site") -> DataFrame:
    """Adds pattern, slug, depth and host; pattern is null without host or path."""
    from ..functions.columns import segments

    return links.withColumn("pattern", url_pattern(url, site)).withColumn("slug", slug(url)).withColumn("depth", F.size(segments(url))).withColumn("host", host(url))


def groups(links: DataFrame, by: list[str] | None = None, order: str = "pos") -> DataFrame:
    """count, distinct slugs, depth and the first link's host of each pattern (of each group)."""
    keys = [*(by or []), "pattern"]
    counts = links.where("pattern is not null")
    return counts.groupBy(*keys).agg(
        F.count("*").alias("n_links"), F.count_distinct(F.lower(F.when(F.col("slug") != "", F.col("slug")))).alias("distinct_slugs"), F.max("depth").alias("depth"), F.min_by("host", order).alias("host")
    )


def ranked(grouped: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds rank: more links, then deeper, then by text. Groups are shapes, far fewer than links."""
    order = (F.desc("n_links"), F.desc("depth"), F.asc("pattern"))
    window = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return grouped.withColumn("rank", F.row_number().over(window))


def candidates(grouped: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    return grouped.where((F.col("n_links") >= min_items) & (F.col("distinct_slugs") >= 2))


def winner(grouped: DataFrame, by: list[str] | None = None, min_items: int = MIN_ITEMS) -> DataFrame:
    """Best candidate (of each group) with the next one's count and a confidence."""
    order = (F.desc("n_links"), F.desc("depth"), F.asc("pattern"))
    window = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    out = candidates(grouped, min_items).withColumn("rank", F.row_number().over(window)).withColumn("second", F.lead("n_links").over(window)).where("rank = 1").drop("rank")
    n, second = F.col("n_links"), F.col("second")
    grade = F.when(second.isNull(), "medium").when((n >= max(2 * min_items, 10)) & (n >= 2 * second), "high").when((n >= min_items) & (n > second), "medium").otherwise("low")
    return out.withColumn("confidence", grade)


def keep_detected(items: DataFrame, detected: DataFrame) -> DataFrame:
    """Items whose pattern is among those detected."""
    return items.join(detected.select("pattern").distinct(), "pattern", "left_semi")


def container_votes(anchors: DataFrame, by: list[str]) -> DataFrame:
    """Most frequent selector of each group, ties to the smallest text."""
    counts = anchors.where("selector != ''").groupBy(*by, "selector").agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.min_by("selector", F.struct(-F.col("n"), "selector")).alias("selector"))
