"""Item tables: merging, first-wins distinct, caps, order and entries.

Every item has (source_ord, pos); together they are the order that decides
who comes first. First-wins takes the least in that order with a partial
aggregate, so a key that a third of all items share costs one row a task.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import entry_title, guid, norm_space, truncate
from ..functions.udfs import fragment_text, link_path_key, norm_link, unwrap_link

ORDER = ("source_ord", "pos")
DEFAULT_SUMMARY = 500


def numbered(items: DataFrame, source_ord: int, order: list[str | Column]) -> DataFrame:
    """Gives items of a source that has a natural order their places; for sources of a size that one sort task can number."""
    return items.withColumn("source_ord", F.lit(source_ord)).withColumn("pos", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))


def numbered_in_parts(items: DataFrame, source_ord: int, order: list[str | Column], lead: Column, parts: int = 64) -> DataFrame:
    """The same for a source of any size, by many tasks: lead is a number that rises with the order (null last).

    Quantiles of lead cut the rows into parts, which are counted and numbered each on its own. Rows with one lead are
    in one part.
    """
    led = items.withColumn("__lead", lead.cast("double"))
    bounds = sorted(set(led.approxQuantile("__lead", [k / parts for k in range(1, parts)], 0.25 / parts)))  # parts numbers
    part = F.when(F.col("__lead").isNull(), len(bounds) + 1).otherwise(sum((F.col("__lead") > b).cast("int") for b in bounds) if bounds else F.lit(0))
    cut = led.withColumn("__part", part)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    sizes = cut.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1 + F.col("__before")
    return cut.join(F.broadcast(sizes.select("__part", "__before")), "__part").withColumn("pos", place.cast("int")).withColumn("source_ord", F.lit(source_ord)).drop("__lead", "__part", "__before")


def merged(*sources: DataFrame) -> DataFrame:
    """All items of all sources; a source's place is its source_ord."""
    out = sources[0].withColumn("source_ord", F.lit(0))
    for k, s in enumerate(sources[1:], 1):
        out = out.unionByName(s.withColumn("source_ord", F.lit(k)), allowMissingColumns=True)
    return out


def source_status(wanted: DataFrame, read: DataFrame, key: str = "url") -> DataFrame:
    """One row: sources fetched and failed, and the first that was read (wanted has key and source_ord)."""
    seen = wanted.join(read.select(key).distinct().withColumn("ok", F.lit(True)), key, "left")
    return seen.agg(F.count_if("ok").alias("fetched"), F.count_if(F.col("ok").isNull()).alias("failed"), F.min_by(key, F.when(F.col("ok"), F.col("source_ord"))).alias("first_source"))


def first_by(df: DataFrame, keys: list[str], order: list[str | Column] | tuple[str, ...] = ORDER) -> DataFrame:
    """One row for each key, the first in order. Null is a key."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    return df.groupBy(*keys).agg(best).select(*keys, "__first.*").select(*df.columns)


def unwrapped(items: DataFrame) -> DataFrame:
    """Click-through links replaced by where they lead."""
    return items.withColumn("link", unwrap_link("link"))


def distinct_links(items: DataFrame) -> DataFrame:
    """First item of each document; items without link are one document, '/'."""
    keyed = items.withColumn("norm_link", norm_link(F.coalesce("link", F.lit(""))))
    return first_by(keyed, ["norm_link"])


def distinct_paths(items: DataFrame) -> DataFrame:
    """First item of each site and path."""
    return first_by(items.withColumn("path_key", link_path_key("link")), ["path_key"])


def capped(items: DataFrame, n: int, by: list[str] | None = None, order: tuple[str, ...] = ORDER) -> DataFrame:
    """First n items in order, of all or of each group; before any sort by date."""
    if not by:
        return items.orderBy(*order).limit(n)
    return items.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def newest_first(items: DataFrame, date: str = "date") -> DataFrame:
    return items.orderBy(F.col(date).desc_nulls_last(), *ORDER)


def entries(items: DataFrame, guid_mode: str = "link", summary_chars: int = 0, fulltext_chars: int = 0, content: str | None = None) -> DataFrame:
    """Adds the columns of feed entries: entry_title, guid, published, entry_summary, content_html. Items need norm_link."""
    most = summary_chars if summary_chars > 0 else DEFAULT_SUMMARY
    title = entry_title("title", "link")
    plain = F.coalesce(F.when(F.trim("summary") != "", truncate(norm_space("summary"), most)), F.when(F.trim("title") != "", truncate(norm_space("title"), most)), title)
    out = items.withColumn("entry_title", title).withColumn("guid", guid(guid_mode, "norm_link", "title", "entry_title", "date")).withColumn("published", F.col("date"))
    if content is None:
        return out.withColumn("entry_summary", plain).withColumn("content_html", F.lit(None).cast("string"))
    body = truncate(content, fulltext_chars)
    return out.withColumn("content_html", body).withColumn("entry_summary", F.when(F.col("content_html").isNotNull(), truncate(fragment_text("content_html"), most)).otherwise(plain))


def feed_updated(items: DataFrame, now: str, date: str = "date") -> DataFrame:
    """One row: the newest date, else now."""
    return items.agg(F.coalesce(F.max(date), F.lit(now).cast("timestamp")).alias("updated"))


def default_description(host: str | None, count: int) -> str:
    host = host or "the source"
    return f"Feed built from {host}." if count == 0 else f"1 item from {host}." if count == 1 else f"{count} items from {host}."
