"""Scans of raw documents: one Python pass a document gives everything that is asked of its tree.

Documents come as tables of responses (url, body and perhaps status and
content type); fetching is outside the engine. Items carry (source_ord, pos)
from here on, since rows have no order of their own.
"""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..kernels import article, dom, feeds, listing, selectors, text, url
from ..shipping import ship

UTC = pa.timestamp("us", tz="UTC")
ITEM = pa.struct([("link", pa.string()), ("title", pa.string()), ("author", pa.string()), ("date", UTC), ("image", pa.string()), ("summary", pa.string()), ("guid", pa.string())])
ITEM_SQL = "struct<link:string,title:string,author:string,date:timestamp,image:string,summary:string,guid:string>"
#: Documents in one Arrow batch: pages are large.
BATCH = 64


def scanned(df: DataFrame, columns: dict[str, tuple[str, pa.DataType]], kernel: Callable[..., dict], *inputs: str, keep: list[str] | None = None) -> DataFrame:
    """Adds columns that kernel(*inputs) gives as a dict for each row; columns maps names to (SQL type, Arrow type)."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    keep = df.columns if keep is None else keep
    base = df.select(*dict.fromkeys([*keep, *inputs]))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in keep] + [f"`{n}` {t}" for n, (t, _) in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [kernel(*args) for args in zip(*(b.column(c).to_pylist() for c in inputs))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array([r.get(n) for r in rows], t) for n, (_, t) in columns.items())], [*keep, *columns])

    return base.mapInArrow(run, schema)


def _items(found: list[listing.Item]) -> list[dict]:
    """Rows of items with nulls for what is absent."""
    return [{k: (v or None) for k, v in vars(it).items()} for it in found]


def page_facts(pages: DataFrame, url_col: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """title, h1, lang, canonical, text, words and link density of each page, next to its columns."""

    def kernel(source, page):
        doc = dom.parse(source or "")
        meta = article.read_metadata(doc)
        body = dom.plain_text(dom.body_of(doc))
        title = next((t for s in ("title", "h1") for n in selectors.select_all(doc, (s,)) if (t := text.norm_space(dom.text_of(n))) and len(t) <= 80), "") or url.hostname(page or "") or "Feed"
        top = doc.first("article") or dom.body_of(doc)
        return {
            "title": text.norm_space(dom.text_of(doc.first("title"))) or None, "h1": text.norm_space(meta.h1) or None, "lang": doc.first("html").attr("lang") or None,
            "default_title": title, "canonical": url.resolve(meta.canonical, page or "") or None, "body_text": body, "article_text": dom.plain_text(top), "words": text.word_count(body),
            "density": article.density_score(top), "link_share": article.link_share(top),
        }

    s, i, d = ("string", pa.string()), ("int", pa.int32()), ("double", pa.float64())
    return scanned(pages, {"title": s, "h1": s, "lang": s, "default_title": s, "canonical": s, "body_text": s, "article_text": s, "words": i, "density": d, "link_share": d}, kernel, html, url_col, keep=keep)


def page_links(pages: DataFrame, url_col: str = "url", html: str = "html", keep: list[str] | None = None, chrome: bool = True, **options) -> DataFrame:
    """A row for each acceptable link of each page: pos, link, text, is_chrome."""

    def kernel(source, page):
        o = listing.ListOptions(base_url=page or "", **options)
        refs = listing.link_refs(dom.parse(source or ""), o, chrome)
        return {"links": [{"pos": k, "link": link, "text": text.norm_space(dom.text_of(n)), "is_chrome": furniture} for k, (link, n, furniture) in enumerate(refs)]}

    kind = pa.list_(pa.struct([("pos", pa.int32()), ("link", pa.string()), ("text", pa.string()), ("is_chrome", pa.bool_())]))
    out = scanned(pages, {"links": ("array<struct<pos:int,link:string,text:string,is_chrome:boolean>>", kind)}, kernel, html, url_col, keep=keep)
    return out.select(*[c for c in out.columns if c != "links"], F.explode("links").alias("__l")).select("*", "__l.*").drop("__l")


def page_items(pages: DataFrame, options: listing.ListOptions, url_col: str = "url", html: str = "html", keep: list[str] | None = None, source_ord: int = 0) -> DataFrame:
    """A row for each item of each listing page, with confidence and selector of the detection (null in selector mode)."""

    def kernel(source, page):
        own = options if options.base_url else listing.ListOptions(**{**vars(options), "base_url": page or ""})
        found, how = listing.collect(source or "", own)
        return {"items": _items(found), "confidence": how.confidence if how else None, "selector": how.selector if how else None}

    columns = {"items": (f"array<{ITEM_SQL}>", pa.list_(ITEM)), "confidence": ("string", pa.string()), "selector": ("string", pa.string())}
    out = scanned(pages, columns, kernel, html, url_col, keep=keep)
    return exploded(out, source_ord)


def exploded(df: DataFrame, source_ord: int | str = 0) -> DataFrame:
    """Rows of an items column, numbered in their order."""
    order = F.col(source_ord) if isinstance(source_ord, str) else F.lit(source_ord)
    rest = [c for c in df.columns if c not in ("items", "source_ord", "pos")]
    return df.select(*rest, order.cast("int").alias("source_ord"), F.posexplode("items").alias("pos", "__item")).select(*rest, "source_ord", "pos", "__item.*")


def feed_documents(responses: DataFrame, url_col: str = "url", body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """feed_format (null for what is no feed), feed_title, feed_link and items of each response."""

    def kernel(source, base):
        try:
            d = feeds.parse(source or "", base or "")
        except feeds.NotAFeed:
            return {}
        return {"feed_format": d.format, "feed_title": d.title or None, "feed_link": d.link or None, "items": _items(d.items)}

    s = ("string", pa.string())
    return scanned(responses, {"feed_format": s, "feed_title": s, "feed_link": s, "items": (f"array<{ITEM_SQL}>", pa.list_(ITEM))}, kernel, body, url_col, keep=keep)


def articles(pages: DataFrame, url_col: str = "url", html: str = "html", keep: list[str] | None = None, prune: bool = True, site: dict | None = None, now=None, min_semantic: int = article.MIN_SEMANTIC) -> DataFrame:
    """The article of each page: metadata, body, strategy and the strategies tried."""

    def kernel(source, page):
        a = vars(article.extract(source or "", page or "", prune, site, now, min_semantic))
        return {k: (v if v or k in ("word_count", "strategy", "attempts") else None) for k, v in a.items() if k != "url"}

    s, t = ("string", pa.string()), ("timestamp", UTC)
    tries = pa.list_(pa.struct([("name", pa.string()), ("ok", pa.bool_()), ("reason", pa.string()), ("chars", pa.int32())]))
    columns = {k: s for k in ("canonical", "title", "byline")} | {"published": t, "modified": t} | {k: s for k in ("content_html", "text_content", "excerpt", "site_name", "image", "lang", "strategy")}
    columns |= {"word_count": ("int", pa.int32()), "attempts": ("array<struct<name:string,ok:boolean,reason:string,chars:int>>", tries)}
    return scanned(pages, columns, kernel, html, url_col, keep=keep)


def probes(pages: DataFrame, url_col: str = "url", html: str = "html", keep: list[str] | None = None, body: bool = False, now=None) -> DataFrame:
    """Adds report, a JSON object that says what the extraction of each page found, which strategies were tried and why they failed."""
    kept = pages.columns if keep is None else keep
    out = articles(pages, url_col, html, [*dict.fromkeys([*kept, url_col])], now=now)
    none = F.when(F.col("strategy") == "", "no strategy found an article")
    report = F.struct(
        F.col(url_col).alias("url"), F.col("strategy"), F.coalesce("title", F.lit("")).alias("title"), "byline", F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"), "site_name", "image", "lang", "canonical", "word_count",
        F.when(F.char_length("excerpt") > 200, F.concat(F.substring("excerpt", 1, 200), F.lit("…"))).otherwise(F.col("excerpt")).alias("excerpt"), *([F.col("content_html")] if body else []), "attempts", none.alias("error"),
    )
    return out.select(*kept, F.to_json(report).alias("report"))


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of files, whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def usable_responses(responses: DataFrame, max_body: int = 5 << 20) -> DataFrame:
    """Adds outcome: ok, not_modified, status, too_large or challenge."""
    from ..functions.udfs import challenge_mark

    body = F.coalesce(F.col("body").cast("string"), F.lit(""))
    mark = challenge_mark(body, F.coalesce("content_type", F.lit("")), F.col("status").cast("string"))
    return responses.withColumn(
        "outcome",
        F.when(F.col("status") == 304, "not_modified").when((F.col("status") < 200) | (F.col("status") > 299), "status").when(F.octet_length("body") > max_body, "too_large").when(mark != "", "challenge").otherwise("ok"),
    )
