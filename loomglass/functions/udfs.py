"""Kernels as Arrow-batched functions, for columns and for SQL.

Each distinct value of a batch is handled once. Nulls give nulls.
"""

import gzip
from collections.abc import Callable
from datetime import datetime

import pandas as pd
from pyspark.sql import SparkSession, functions as F, types as T
from pyspark.sql.functions import pandas_udf, udtf

from ..kernels import article, dates, dom, feeds, fetching, listing, news, robots, sanitize, text, url
from ..shipping import ship
from . import columns

ITEM = "link string, title string, author string, date timestamp, image string, summary string, guid string"


def _plain(v):
    return None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v


#: Types as objects: a type's name could only be read with a session at hand.
TYPES = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "binary": T.BinaryType()}


def each(fn: Callable, kind: str, arity: int = 1):
    """A pandas UDF of a kernel over one to three string columns."""

    def over(*series: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for key in zip(*series):
            if key not in known:
                args = [_plain(v) for v in key]
                known[key] = None if args[0] is None else fn(*args)
            out.append(known[key])
        return stamps(out) if kind == "timestamp" else pd.Series(out, index=series[0].index, dtype=object)

    if arity == 1:
        def one(a: pd.Series) -> pd.Series:
            return over(a)
        return pandas_udf(one, TYPES[kind])
    if arity == 2:
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return over(a, b)
        return pandas_udf(two, TYPES[kind])

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return over(a, b, c)
    return pandas_udf(three, TYPES[kind])


def stamps(values: list[datetime | None]) -> pd.Series:
    """Times as a column; what a nanosecond clock can't hold is null."""
    low, high = datetime(1678, 1, 1, tzinfo=dates.UTC), datetime(2262, 1, 1, tzinfo=dates.UTC)
    return pd.to_datetime(pd.Series([v if v is not None and low < v < high else None for v in values], dtype=object), utc=True)


norm_url = each(url.normalize, "string")
fetch_key = each(url.fetch_key, "string")
resolve_url = each(url.resolve, "string", 2)
set_host = each(url.set_host, "string", 2)
keep_params = each(url.keep_query_params, "string", 2)
site_of = each(url.site, "string")
listing_site = each(url.listing_site, "string")
registrable_domain = each(url.registrable_domain, "string")
url_host = each(url.hostname, "string")
path_key = each(url.path_key, "string")
url_pattern = each(lambda s: p[0] if (p := url.pattern(s)) else None, "string")
url_slug = each(url.slug, "string")
unwrap_link = each(lambda s: url.unwrap(s)[0], "string")
clean_tracking = each(url.clean_tracking, "string")
parse_date = each(dates.parse, "timestamp")
parse_feed_date = each(dates.parse_feed_date, "timestamp")
find_date = each(dates.find, "timestamp")
plain_text = each(lambda s: dom.plain_text(dom.parse(s)), "string")
fragment_text = each(dom.text_from_fragment, "string")
word_count = each(text.word_count, "int")
article_id = each(news.article_id, "string")
decode_news_id = each(news.decode_legacy, "string")
news_answer = each(news.answer, "string")
is_private_address = each(fetching.is_private, "boolean")
decode_body = each(lambda body, ct: fetching.decode_body(ct, bytes(body)), "string", 2)
etag = each(lambda s: fetching.fnv1a(s if isinstance(s, bytes) else str(s).encode()), "string")
challenge_mark = each(lambda body, ct, status: fetching.challenge(int(status or 200), ct or "", body.encode()), "string", 3)
robots_allows = each(lambda rules, path: robots.allowed(robots.parse_robots(rules), path or "/"), "boolean", 2)
largest_of_srcset = each(sanitize.largest_of, "string")
byline = each(listing.find_byline, "string")
shorten_url = each(lambda s, n: text.shorten_url(s, int(n)), "string", 2)
discover_feed = each(listing.discovered_feed, "string", 2)
sniff_feed = each(feeds.sniff, "string")


gzipped = each(lambda s: gzip.compress(s.encode(), 6, mtime=0), "binary")
gunzipped = each(lambda b: gzip.decompress(bytes(b)).decode("utf-8", "replace"), "string")


def _or_kernel(url, plain: Callable, kernel: Callable):
    """A URL function in the JVM for plain URLs; the kernel gets the others only."""
    u = columns.col(url)
    simple = columns.is_plain_url(u)
    return F.when(simple, plain(u)).otherwise(kernel(F.when(~simple, u)))


def norm_link(url):
    return _or_kernel(url, columns.plain_norm, norm_url)


def site(url):
    return _or_kernel(url, columns.plain_site, site_of)


def link_path_key(url):
    return _or_kernel(url, columns.plain_path_key, path_key)


def _item_rows(items: list[listing.Item]):
    for it in items:
        yield it.link, it.title, it.author, it.date, it.image, it.summary, it.guid


class ParseFeed:
    """Items of a feed document; none for what is no feed."""

    def eval(self, body: str, base: str):
        try:
            yield from _item_rows(feeds.parse(body or "", base or "").items)
        except feeds.NotAFeed:
            return


class ListItems:
    """Items detected on a listing page, or those of a selector if it isn't empty."""

    def eval(self, html: str, page_url: str, selector: str):
        options = listing.ListOptions(base_url=page_url or "", item=(selector,) if selector else ())
        yield from _item_rows(listing.collect(html or "", options)[0])


class ExtractArticle:
    """The article of a page, one row."""

    def eval(self, html: str, page_url: str):
        a = article.extract(html or "", page_url or "")
        yield a.title, a.byline, a.published, a.text_content, a.content_html, a.excerpt, a.site_name, a.image, a.lang, a.canonical, a.word_count, a.strategy


FUNCTIONS = {
    "norm_url": norm_url, "registrable_domain": registrable_domain, "url_site": site_of, "url_host": url_host, "url_pattern": url_pattern, "path_key": path_key, "url_slug": url_slug,
    "resolve_url": resolve_url, "set_host": set_host, "keep_query_params": keep_params, "unwrap_link": unwrap_link, "plain_text": plain_text, "parse_date": parse_date,
    "parse_feed_date": parse_feed_date, "find_date": find_date, "text_words": word_count, "news_article_id": article_id, "decode_news_id": decode_news_id, "is_private_address": is_private_address,
    "robots_allows": robots_allows, "find_byline": byline, "etag": etag,
}
TABLE_FUNCTIONS = {
    "parse_feed": (ParseFeed, ITEM), "list_items": (ListItems, ITEM),
    "extract_article": (ExtractArticle, "title string, byline string, published timestamp, text_content string, content_html string, excerpt string, site_name string, image string, lang string, canonical string, word_count int, strategy string"),
}


def register_functions(spark: SparkSession) -> None:
    """Put the functions into the session's SQL catalogue."""
    ship(spark)
    for name, fn in FUNCTIONS.items():
        spark.udf.register(name, fn)
    for name, (cls, schema) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls, returnType=schema))

