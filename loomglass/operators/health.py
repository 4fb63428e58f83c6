"""Health of results by their build history, and the listing of a catalogue."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.udfs import listing_site
from .catalog import latest

RECENT = 50
SORT_KEYS = ("source", "feed", "items", "built", "state", "status")


def feed_health(builds: DataFrame, key: str = "feed_key", recent: int = RECENT) -> DataFrame:
    """failure_streak, total_recent, last_success and avg_gap_ms of each result.

    The streak is the failures before the first success, newest first, among
    the recent attempts; the gap is the mean time between consecutive
    successes, of the recent ones, in whole milliseconds. Both work on the
    newest rows of a key only, of which each task sends no more than that many.
    """
    newest = Window.partitionBy(key).orderBy(F.desc("built_at"), F.desc("id"))
    at = F.unix_seconds(F.col("built_at").cast("timestamp"))
    base = builds.select(key, "id", "built_at", "ok", at.alias("at"))

    def top(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= recent)

    oks = F.sum(F.col("ok").cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = top(base).withColumn("oks", oks).groupBy(key).agg(F.count_if(F.col("oks") == 0).alias("failure_streak"), F.count("*").alias("total_recent"), F.max(F.when(F.col("ok"), F.col("built_at"))).alias("last_success"))
    gap = F.lag("at").over(newest) - F.col("at")
    gaps = top(base.where("ok")).withColumn("gap", gap).groupBy(key).agg(F.sum("gap").alias("s"), F.count("gap").alias("c"))
    out = seen.join(gaps, key, "left")
    return out.select(key, "failure_streak", "total_recent", "last_success", F.when(F.col("c") > 0, F.expr("(s * 1000) div c")).otherwise(0).alias("avg_gap_ms"))


def listing(builds: DataFrame, cache: DataFrame, now: str, key: str = "feed_key") -> DataFrame:
    """All results that have a history or a cached body. History wins where both have a value; the cache adds format and expiry."""
    b = latest(builds, key).select(key, F.col("source_url").alias("b_url"), F.col("item_count").alias("b_items"), F.col("selector").alias("b_detector"), F.col("built_at").alias("b_at"), F.col("error").alias("last_error"))
    c = cache.select(key, F.col("source_url").alias("c_url"), F.col("item_count").alias("c_items"), F.col("detector").alias("c_detector"), F.col("fetched_at").alias("c_at"), "format", "expires_at", F.lit(True).alias("cached"))
    both = b.withColumn("built", F.lit(True)).join(c, key, "full_outer")
    pick = lambda x, y: F.when(F.col("built"), F.col(x)).otherwise(F.col(y))
    return both.select(
        F.col(key).alias("key"), pick("b_url", "c_url").alias("source_url"), "format", pick("b_items", "c_items").alias("item_count"), pick("b_detector", "c_detector").alias("detector"),
        pick("b_at", "c_at").alias("fetched_at"), "expires_at", F.coalesce("cached", F.lit(False)).alias("cached"),
        F.coalesce(F.col("expires_at") < F.lit(now).cast("timestamp"), F.lit(False)).alias("stale"), "last_error",
    )


def state() -> Column:
    """failed, fresh, stale or not cached."""
    return F.when(F.coalesce("last_error", F.lit("")) != "", "failed").when(F.col("cached") & ~F.col("stale"), "fresh").when(F.col("cached"), "stale").otherwise("not cached")


def state_rank(s: Column) -> Column:
    return F.when(s == "failed", 0).when(s == "stale", 1).when(s == "not cached", 2).otherwise(3)


def health_label() -> Column:
    """unknown, failing (n/m), never ok or healthy (n/m)."""
    streak, total = F.col("failure_streak"), F.col("total_recent")
    return (
        F.when(F.coalesce(total, F.lit(0)) == 0, "unknown").when(streak > 0, F.format_string("failing (%d/%d)", streak, total)).when(F.col("last_success").isNull(), "never ok")
        .otherwise(F.format_string("healthy (%d/%d)", total - streak, total))
    )


def combined_status() -> Column:
    """One label out of last error, history and cache."""
    return (
        F.when(F.coalesce("last_error", F.lit("")) != "", "failed").when(F.col("failure_streak") > 0, F.format_string("failing (%d/%d)", "failure_streak", "total_recent"))
        .when(F.coalesce("total_recent", F.lit(0)) == 0, state()).when(F.col("last_success").isNull(), "never ok").when(F.col("stale"), "stale").when(F.col("cached"), "fresh").otherwise("unknown")
    )


def avg_gap_label(ms: str = "avg_gap_ms") -> Column:
    c = F.col(ms)
    return F.when(F.coalesce(c, F.lit(0)) <= 0, "—").when(c < 1000, F.format_string("%dms", c)).otherwise(F.format_string("%.1fs", c / 1000.0))


def sort_order(key: str = "source", descending: bool | None = None) -> list[Column]:
    """Order of a listing; ties by page, newest, key. Descending turns ties round as well. Unknown keys sort by source."""
    key = key if key in SORT_KEYS else "source"
    down = key in ("built", "items") if descending is None else descending
    site = listing_site(F.coalesce("source_url", F.lit("")))
    main = {"feed": F.col("key"), "items": F.col("item_count"), "built": F.col("fetched_at"), "state": state_rank(state())}.get(key, site)
    parts = [(main, False), (F.coalesce("source_url", F.lit("")), False), (F.col("fetched_at"), True), (F.col("key"), False)]
    return [c.desc_nulls_last() if turned != down else c.asc_nulls_first() for c, turned in parts]


def by_site(rows: DataFrame, url: str = "source_url", order: str = "ord") -> DataFrame:
    """Results and distinct pages of each site, in order of first appearance."""
    return rows.groupBy(listing_site(F.coalesce(url, F.lit(""))).alias("site")).agg(F.count("*").alias("feeds"), F.count_distinct(url).alias("pages"), F.count_if(F.col("stale")).alias("stale"), F.min(order).alias("first_ord"))
