"""From a plan to a result: scan, merge, unwrap, distinct, rules, cap, bodies, order, entries, document.

Responses are a table (url, body); fetching is outside the engine. What can
be expressed as columns stays in the JVM; each document is parsed once.
"""

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import norm_space
from ..functions.udfs import discover_feed, norm_link
from ..kernels.listing import ListOptions
from ..kernels.url import hostname
from ..operators import bodies as body_ops, items as item_ops
from ..operators.rules import drop_counts, survivors
from ..sources import pages as scans, writers
from .spec import FeedSpec

ITEM_COLUMNS = ("link", "title", "author", "date", "image", "summary", "guid", "source_ord", "pos")


def site_options(o: ListOptions, site: dict | None) -> ListOptions:
    """Selectors of a request completed by a site's: empty lists are filled, exclusions joined site first, flags by or."""
    if not site:
        return o
    values = dict(vars(o))
    for own, name in (("item", "item"), ("url", "item_url"), ("title", "item_title"), ("date", "item_date"), ("image", "item_image"), ("summary", "item_desc")):
        values[own] = values[own] or tuple(site.get(name) or ())
    values["exclude"] = (*(site.get("strip") or ()), *o.exclude)
    values["force_host"] = o.force_host or site.get("force_host") or ""
    values["allow_cross_host"] = o.allow_cross_host or bool(site.get("allow_cross_host"))
    return ListOptions(**values)


def scanned_items(spec: FeedSpec, responses: DataFrame, site: dict | None = None, rendered: DataFrame | None = None) -> DataFrame:
    """Items of the page (a feed's entries, its selected or detected items, else those of a feed it points to), then of the feeds in order.

    rendered, if given and asked for, has bodies of pages after scripts ran; they count where the plain body gives no items.
    """
    spark = responses.sparkSession
    wanted = spark.createDataFrame([(u, k) for k, u in enumerate(([spec.url] if spec.url else []) + list(spec.feeds), 0 if spec.url else 1)], "url string, source_ord int")
    known = responses.select("url", F.col("body").cast("string").alias("body")).join(F.broadcast(wanted), "url")  # as many rows as the request names sources
    read = scans.feed_documents(known)
    parts = [scans.exploded(read.where("items is not null and size(items) > 0").select("url", "items", "source_ord"), "source_ord")]
    if spec.url:
        page = read.where("source_ord = 0 and (items is null or size(items) = 0)").select("url", "source_ord", "body")
        options = site_options(spec.listing, site)
        found = scans.page_items(page, options, html="body", keep=["url"])
        if spec.render_js and rendered is not None:
            second = rendered.select("url", F.col("body").cast("string").alias("body")).where(F.col("url") == spec.url).join(found.select("url").distinct(), "url", "left_anti")
            found = found.unionByName(scans.page_items(second, options, html="body", keep=["url"]))
        parts.append(found.drop("confidence", "selector"))
        target = page.join(found.select("url").distinct(), "url", "left_anti").select(discover_feed("body", "url").alias("url")).where("url != ''")
        pointed = responses.select("url", F.col("body").cast("string").alias("body")).join(target, "url")
        parts.append(scans.exploded(scans.feed_documents(pointed).where("items is not null").select("url", "items"), 0))
    out = parts[0].select("url", *ITEM_COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select("url", *ITEM_COLUMNS))
    return out.drop("url")


def chosen(spec: FeedSpec, items: DataFrame) -> DataFrame:
    """Items that make up the result, not yet in its order: unwrapped, distinct, through the rules, cut to the first in source order."""
    return item_ops.capped(survivors(item_ops.distinct_links(item_ops.unwrapped(items)), spec.rules), spec.max_items)


def dropped(spec: FeedSpec, items: DataFrame) -> DataFrame:
    return drop_counts(item_ops.distinct_links(item_ops.unwrapped(items)), spec.rules)


def bodies(spec: FeedSpec, items: DataFrame, pages: DataFrame, site: dict | None = None, now: datetime | None = None) -> DataFrame:
    """(norm_link, content) of the items' pages that gave an article, without boilerplate."""
    keyed = pages.select("url", F.col("body").cast("string").alias("body")).withColumn("norm_link", norm_link("url"))
    asked = keyed.join(items.select("norm_link").distinct(), "norm_link", "left_semi")
    got = scans.articles(asked, html="body", keep=["norm_link"], prune=spec.html_cleanup, site=site, now=now).where("strategy != ''").select("norm_link", F.col("content_html").alias("content"))
    return body_ops.with_boilerplate(got, "content").where("not boilerplate").drop("boilerplate")


def entries(spec: FeedSpec, items: DataFrame, content: DataFrame | None = None) -> DataFrame:
    """Entries of the result in its order."""
    joined = items if content is None else body_ops.attached(items, content)
    out = item_ops.entries(joined, spec.guid, spec.summary_chars, spec.fulltext_chars, None if content is None else "content")
    return item_ops.newest_first(out)


def build(spec: FeedSpec, responses: DataFrame, site: dict | None = None, rendered: DataFrame | None = None, now: datetime | None = None) -> DataFrame:
    """One row: the rendered document of a plan, with its key and number of items."""
    items = chosen(spec, scanned_items(spec, responses, site, rendered))
    content = bodies(spec, items, responses, site, now) if spec.fulltext else None
    rows = entries(spec, items, content)
    shaped = rows.select(
        F.lit(spec.canonical()).alias("feed_key"), F.col("entry_title").alias("title"), "link", "guid", "published", F.col("date").alias("updated"), norm_space("author").alias("author"),
        F.col("entry_summary").alias("summary"), "content_html", "image", "source_ord", "pos",
    )
    order = [-F.coalesce(F.unix_micros("published"), F.lit(-(1 << 62))), "source_ord", "pos"]
    feed = writers.gathered(shaped, ["feed_key"], order).withColumn("item_count", F.size("entries"))
    name = hostname(spec.url or (spec.feeds[0] if spec.feeds else ""))
    told = F.when(F.col("item_count") == 1, f"1 item from {name}.").otherwise(F.concat(F.col("item_count").cast("string"), F.lit(f" items from {name}.")))
    feed = feed.withColumn("title", F.lit(spec.title or name or "Feed")).withColumn("link", F.lit(spec.url or None)).withColumn("description", F.lit(spec.description) if spec.description else told)
    feed = feed.withColumn("language", F.lit(spec.lang or None)).withColumn("ttl", F.lit(spec.ttl))
    return writers.rendered(feed, spec.format, now)


__all__ = ["bodies", "build", "chosen", "dropped", "entries", "scanned_items", "site_options"]
