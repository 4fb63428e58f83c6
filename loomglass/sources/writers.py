"""Rendering of item tables as feeds, subscription lists and exports."""

from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import iso
from ..kernels import feeds
from .pages import scanned

ENTRY_COLUMNS = ("title", "link", "guid", "published", "updated", "author", "summary", "content_html", "image")
EXPORT_COLUMNS = ("key", "source_url", "format", "item_count", "detector", "fetched_at", "expires_at", "cached", "stale", "last_error")


def gathered(entries: DataFrame, by: list[str], order: list) -> DataFrame:
    """A row for each feed with its entries in order. A feed's entries are few: its plan caps them."""
    names = [f"o{k}" for k in range(len(order))]
    struct = F.struct(*(F.col(o).alias(n) if isinstance(o, str) else o.alias(n) for o, n in zip(order, names)), *(F.col(c) for c in ENTRY_COLUMNS))
    return entries.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(struct)), lambda e: F.struct(*(e[c].alias(c) for c in ENTRY_COLUMNS))).alias("entries"))


def rendered(feed_rows: DataFrame, kind: str = "rss", now: datetime | None = None) -> DataFrame:
    """Adds body, the document of each row of entries; the row may have title, link, description, language, self_link, ttl."""
    extras = [c for c in ("title", "link", "description", "language", "self_link", "ttl") if c in feed_rows.columns]

    def kernel(rows, *values):
        own = {k: v for k, v in zip(extras, values) if v is not None}
        entries = [feeds.Entry(**{k: v for k, v in r.items() if v is not None}) for r in rows or []]
        updated = max((e.published for e in entries if e.published), default=now)
        f = feeds.Feed(**({"title": "Feed"} | own), updated=updated, entries=entries)
        return {"body": feeds.write(f, kind)}

    return scanned(feed_rows, {"body": ("string", pa.string())}, kernel, "entries", *extras, keep=[c for c in feed_rows.columns if c != "entries"])


def feed_json(feed_rows: DataFrame) -> DataFrame:
    """JSON Feed documents of rows of entries, in the JVM."""
    author = lambda e: F.when(e["author"].isNotNull(), F.array(F.struct(e["author"].alias("name"))))
    items = F.transform("entries", lambda e: F.struct(
        e["guid"].alias("id"), e["link"].alias("url"), e["title"].alias("title"), e["content_html"].alias("content_html"), e["summary"].alias("content_text"), e["summary"].alias("summary"),
        e["image"].alias("image"), iso(e["published"]).alias("date_published"), iso(F.coalesce(e["updated"], e["published"])).alias("date_modified"), author(e).alias("authors"),
    ))
    doc = F.struct(F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.col("title"), F.col("link").alias("home_page_url"), F.coalesce(items, F.array()).alias("items"))
    return feed_rows.withColumn("body", F.to_json(doc))


def opml(listing: DataFrame, title: str, created: datetime) -> DataFrame:
    """One row: the subscription list of a catalogue listing (key, source_url, ord)."""
    rows = listing.agg(F.array_sort(F.collect_list(F.struct("ord", "key", F.coalesce("source_url", F.lit("")).alias("page")))).alias("outlines"))

    def kernel(outlines):
        return {"body": feeds.write_opml([(o["key"], o["page"]) for o in outlines], title, created)}

    return scanned(rows, {"body": ("string", pa.string())}, kernel, "outlines", keep=[])


def export_rows(listing: DataFrame) -> DataFrame:
    """The ten columns of an export, as text where they are times."""
    stamp = lambda c: F.concat(F.date_format(c, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")).alias(c)
    return listing.select("key", "source_url", "format", "item_count", "detector", stamp("fetched_at"), stamp("expires_at"), "cached", "stale", "last_error")


def write_csv(listing: DataFrame, path: str) -> None:
    export_rows(listing).write.option("header", True).csv(path)


def write_json(listing: DataFrame, path: str) -> None:
    export_rows(listing).write.json(path)


def compressed(bodies: DataFrame, body: str = "body", name: str = "packed") -> DataFrame:
    """Adds the body as gzip, the same bytes for the same text; null stays null."""
    from ..functions.udfs import gzipped

    return bodies.withColumn(name, gzipped(body))


__all__ = ["ENTRY_COLUMNS", "EXPORT_COLUMNS", "compressed", "export_rows", "feed_json", "gathered", "opml", "rendered", "write_csv", "write_json"]
