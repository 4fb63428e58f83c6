"""Named queries over documents that are built from the tables' own values: feeds, pages, structured data, plans.

Each query writes a table's values into a format in the JVM, runs the operator
that reads or writes this format, and has SQL that states the result from the
values alone.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import columns as c, udfs
from ..kernels import dates, dom, sanitize, selectors, text
from ..kernels.listing import ListOptions
from ..operators import bodies, catalog, items, pacing, sites
from ..sources import pages as scans, writers
from ..streaming import state
from . import settings
from .queries import BUILDS, CLOCK, SQL, _stream, builds, listing, query, table
from .spec import FieldError, parse as parse_spec, self_link

RAW_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def unescaped(s: str) -> str:
    return f"regexp_replace(replace(replace(replace(replace({s}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;?', '&', 'g')"  # a title may be cut before the semicolon


def spaced(s: str) -> str:
    return f"trim(regexp_replace({s}, '\\s+', ' ', 'g'))"


TITLE = spaced(unescaped(RAW_TITLE))
DAY = "TIMESTAMP '2024-03-01 06:30:00' + to_days(CAST(page_id AS INTEGER))"


def told(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with the values that the formats get: title (escaped, as it stands in the page), day and number."""
    day = F.expr("timestamp'2024-03-01 06:30:00' + make_dt_interval(cast(page_id as int))")
    return table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("t"), day.alias("day"), F.col("page_id").cast("string").alias("n"))


def filled(pattern: str, **values: Column) -> Column:
    """A pattern whose «names» are filled with values, or with the columns of these names."""
    parts = re.split("[«»]", pattern)
    return F.concat(*(F.lit(p) if k % 2 == 0 else F.coalesce((values[p] if p in values else F.col(p)).cast("string"), F.lit("")) for k, p in enumerate(parts)))


def read_back(p: DataFrame, body: Column) -> DataFrame:
    docs = p.select("page_id", F.lit("https://feeds.example/dir/list").alias("url"), body.alias("body"))
    return scans.exploded(scans.feed_documents(docs, keep=["page_id"])).select("page_id", "feed_format", "feed_title", "feed_link", "pos", "link", "title", "author", "date", "image", "summary", "guid")


def scan_sql(kind: str, title: str = TITLE, image: str = "'https://img.example/' || page_id || '.png'", guid: str = "'g-' || page_id", second: str = "'https://feeds.example/q/' || page_id") -> str:
    return f"""SELECT page_id, '{kind}' AS feed_format, {title} AS feed_title, 'https://feeds.example/home' AS feed_link, CAST(0 AS INTEGER) AS pos, 'https://feeds.example/p/' || page_id AS link,
        {title} AS title, 'Desk ' || page_id AS author, {DAY} AS date, {image} AS image, 'Part ' || page_id || ' & more' AS summary, {guid} AS guid FROM pages
        UNION ALL SELECT page_id, '{kind}', {title}, 'https://feeds.example/home', CAST(1 AS INTEGER), 'https://feeds.example/q/' || page_id, 'Second', NULL, NULL, NULL, NULL, {second} FROM pages"""


UTC = "yyyy-MM-dd'T'HH:mm:ss'Z'"


@query(scan_sql("rss"))
def feed_scan_rss(spark, sf):
    return read_back(told(spark, sf), filled(
        '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:media="http://search.yahoo.com/mrss/"><channel><title>«t»</title><link>/home</link>'
        '<item><title>«t»</title><link>/p/«n»</link><guid>g-«n»</guid><pubDate>«at»</pubDate><dc:creator> Desk «n» </dc:creator><media:thumbnail url="https://img.example/«n».png"/>'
        "<description><![CDATA[<p>Part «n» &amp; more</p>]]></description></item><item><title>Second</title><guid>https://feeds.example/q/«n»</guid></item></channel></rss>",
        at=F.date_format("day", "EEE, dd MMM yyyy HH:mm:ss '+0000'"),
    ))


@query(scan_sql("rdf", image="NULL", guid="NULL", second="NULL"))
def feed_scan_rdf(spark, sf):
    return read_back(told(spark, sf), filled(
        '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel rdf:about="x"><title>«t»</title><link>/home</link></channel>'
        '<item rdf:about="https://feeds.example/unused/«n»"><title>«t»</title><link>/p/«n»</link><dc:date>«at»</dc:date><dc:creator>Desk «n»</dc:creator><description>&lt;i&gt;Part «n»&lt;/i&gt; &amp;amp; more</description></item>'
        '<item rdf:about="https://feeds.example/q/«n»"><title>Second</title></item></rdf:RDF>', at=F.date_format("day", UTC),
    ))


@query(scan_sql("atom"))
def feed_scan_atom(spark, sf):
    return read_back(told(spark, sf), filled(
        '<feed xmlns="http://www.w3.org/2005/Atom"><title>«t»</title><link rel="self" href="/self"/><link href="/home"/><entry><title>«t»</title><id>g-«n»</id><link rel="enclosure" type="image/png" href="https://img.example/«n».png"/>'
        '<link rel="alternate" href="/p/«n»"/><updated>2001-01-01T00:00:00Z</updated><published>«at»</published><author><name>Desk «n»</name></author><summary>not this</summary><content type="html">&lt;p&gt;Part «n» &amp;amp; more&lt;/p&gt;</content></entry>'
        "<entry><title>Second</title><id>https://feeds.example/q/«n»</id></entry></feed>", at=F.date_format("day", UTC),
    ))


@query(scan_sql("json", title="'Story ' || page_id"))
def feed_scan_json(spark, sf):
    return read_back(told(spark, sf), filled(
        '{"version":"https://jsonfeed.org/version/1.1","title":" Story  «n»","home_page_url":"https://feeds.example/home","items":[{"id":"g-«n»","url":"/p/«n»","title":"Story «n»","content_html":"<p>Part «n» &amp; more</p>",'
        '"image":"https://img.example/«n».png","date_published":"«at»","authors":[{"name":"Desk «n»"}]},{"id":"https://feeds.example/q/«n»","title":"Second"}]}', at=F.date_format("day", UTC),
    ))


KINDS = {"rss": '<?xml version="1.0"?><!-- made for «n» --><rss version="2.0"/>', "atom": ' <feed xmlns="http://www.w3.org/2005/Atom" id="«n»"/>', "rdf": "<rdf:RDF><x>«n»</x></rdf:RDF>", "json": '{"n": «n»}', "": "<!doctype html><html><rss>«n»</rss></html>"}


@query("SELECT page_id, ([" + ", ".join(f"'{k}'" for k in KINDS) + "])[CAST(page_id % 5 AS INTEGER) + 1] AS kind FROM pages")
def feed_sniff(spark, sf):
    docs = F.element_at(F.array(*(filled(p) for p in KINDS.values())), (F.col("page_id") % 5 + 1).cast("int"))
    return told(spark, sf).select("page_id", udfs.sniff_feed(docs).alias("kind"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || '/feeds/' || page_id || '.xml' AS feed FROM pages WHERE page_id % 4 <> 3 UNION ALL SELECT page_id, '' FROM pages WHERE page_id % 4 = 3")
def feed_discovery(spark, sf):
    """The last alternate of a feed's type counts; other alternates and other relations don't."""
    found = filled('<html><head><link rel="alternate" type="application/atom+xml" href="/first"><link rel="alternate" type="application/rss+xml" href="/feeds/«n».xml"><link rel="alternate" hreflang="de" href="/de"></head></html>')
    none = filled('<html><head><link rel="stylesheet" type="application/rss+xml" href="/«n»"><link rel="alternate" type="text/html" href="/amp"></head></html>')
    return told(spark, sf).select("page_id", udfs.discover_feed(F.when(F.col("page_id") % 4 == 3, none).otherwise(found), F.col("url")).alias("feed"))


@query("SELECT page_id % 3 AS kind, count(*) AS documents, count(*) FILTER (WHERE page_id % 3 < 2) AS feeds, CAST(sum(CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END) AS BIGINT) AS items FROM pages GROUP BY 1")
def feed_or_page(spark, sf):
    """Responses of one table told apart: feeds of one and of two items, and pages."""
    docs = F.element_at(F.array(filled("<rss><channel><item><title>«n»</title></item></channel></rss>"), filled('{"items":[{"id":"«n»"},{"id":"b"}]}'), filled("<html><p>«n»")), (F.col("page_id") % 3 + 1).cast("int"))
    read = scans.feed_documents(told(spark, sf).select("page_id", "url", docs.alias("body")), keep=["page_id"])
    return read.groupBy((F.col("page_id") % 3).alias("kind")).agg(F.count("*").alias("documents"), F.count("feed_format").alias("feeds"), F.sum(F.when(F.col("feed_format").isNotNull(), F.size("items")).otherwise(0)).alias("items"))


def shelves(spark: SparkSession, sf: str, card: str) -> DataFrame:
    """A page for each nation, with a card for each of its customers in order."""
    own = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("n"), F.col("c_name").alias("name"))
    cards = own.withColumn("card", filled(card, day=F.lpad((F.col("k") % 28 + 1).cast("string"), 2, "0"), sold=F.when(F.col("k") % 5 == 0, " sold")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "card"))), lambda x: x["card"]), "")
    nav = F.concat_ws("", *(F.lit(f'<a href="/menu/{x}">{x}</a>') for x in "abcd"))
    page = F.concat(F.lit("<html><body><nav>"), nav, F.lit("</nav><main>"), body, F.lit("</main><footer>"), nav, F.lit("</footer></body></html>"))
    return cards.groupBy("nation").agg(page.alias("html")).withColumn("url", F.concat(F.lit("https://shop.example/nation/"), F.col("nation").cast("string")))


CARD = (
    '<div class="card«sold»"><a href="/offer/«n»?utm_source=x&amp;c=«n»">«name»</a><span class="byline">By Ann«n» Lee</span><time datetime="2024-05-«day»">then</time><img src="data:x" data-src="/i/«n».jpg">'
    '<p>Costs «n» coins</p><i class="noise">noise</i></div>'
)


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer WHERE c_custkey % 5 <> 0)
    SELECT c_nationkey AS nation, CAST(pos AS INTEGER) AS pos, 'https://shop.example/offer/' || c_custkey || '?c=' || c_custkey AS link, c_name AS title, 'Ann' || c_custkey || ' Lee' AS author,
        CAST(make_date(2024, 5, CAST(c_custkey % 28 + 1 AS INTEGER)) AS TIMESTAMP) AS date, 'https://shop.example/i/' || c_custkey || '.jpg' AS image, 'Costs ' || c_custkey || ' coins' AS summary FROM k""")
def listing_by_selectors(spark, sf):
    """Cards by selector: sold ones are excluded, stripped elements leave no text, parameters for tracking go."""
    o = ListOptions(item=(".card",), summary=("p",), exclude=(".sold",), strip_css=(".noise",))
    return scans.page_items(shelves(spark, sf, CARD), o, keep=["nation"]).select("nation", "pos", "link", "title", "author", "date", "image", "summary")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
    SELECT c_nationkey AS nation, CAST(pos AS INTEGER) AS pos, 'https://shop.example/news/2024/' || c_custkey || '/story-' || c_custkey AS link, c_name AS title, 'medium' AS confidence, '.card' AS selector,
        c_name || ' and more' AS summary FROM k WHERE n >= 3""")
def listing_detected(spark, sf):
    """Cards found by the one shape that their links share, outside of navigation; pages with fewer than three have none."""
    card = '<article class="card"><h2><a href="/news/2024/«n»/story-«n»">«name»</a></h2> and more</article>'
    return scans.page_items(shelves(spark, sf, card), ListOptions(), keep=["nation"]).select("nation", "pos", "link", "title", "confidence", "selector", "summary")


@query("SELECT c_nationkey AS nation, CAST(0 AS INTEGER) AS pos, 'https://shop.example/only/' || min(c_custkey) AS link FROM customer GROUP BY 1")
def listing_once_each(spark, sf):
    """Anchors without a document, to other hosts, hidden, to the page itself or again to a link already listed are no items."""
    card = (
        '<div class="c"><a href="#top">x</a></div><div class="c"><a href="mailto:a@b.example">x</a></div><div class="c"><a href="https://other.example/z">x</a></div><div class="c"><a href="?">x</a></div>'
        '<div class="c"><a href="/only/«first»?utm_medium=«n»#«n»">x</a></div>'
    )
    first = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.min("c_custkey").cast("string").alias("first"))
    page = F.concat(filled(card, n=F.lit("1")), filled(card, n=F.lit("2")))
    p = first.select("nation", page.alias("html"), F.concat(F.lit("https://shop.example/nation/"), F.col("nation").cast("string")).alias("url"))
    return scans.page_items(p, ListOptions(item=(".c",)), keep=["nation"]).select("nation", "pos", "link")


XML = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
#: Lines of a document as they are read: white space made one space, blank ones left out.
PLAIN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def essays(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", F.col("doc_id").cast("string").alias("n"), "text")
    safe = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return d.withColumn("body", F.concat(F.lit("<p>"), F.replace(safe, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>")))


ESSAY = (
    '<html lang="«lang»"><head><title>Essay «n» | Harbour Post</title><meta property="og:title" content="Essay «n»"><meta property="og:site_name" content="Harbour Post"><meta name="author" content=" Ida «n» ">'
    '<meta property="og:image" content="/i/«n».jpg?utm_source=x"><link rel="canonical" href="/c/«n»"><meta property="article:published_time" content="«at»"></head>'
)
#: The same without what sets blocks apart, as lengths are measured.
TIGHT = r"trim(regexp_replace(replace(text, chr(10), ''), '\s+', ' ', 'g'))"
LONG, LONG_SHARED = f"length({TIGHT}) >= 200", f"length(trim({TIGHT} || 'Share ' || doc_id)) >= 200"


@query(f"""SELECT doc_id, 'Essay ' || doc_id AS title, 'Ida ' || doc_id AS byline, 'Harbour Post' AS site_name, lang, 'https://post.example/c/' || doc_id AS canonical,
    CASE WHEN {LONG_SHARED} THEN 'semantic' ELSE '' END AS strategy, CASE WHEN {LONG_SHARED} THEN {PLAIN} END AS text_content, CASE WHEN {LONG_SHARED} THEN 'https://post.example/i/' || doc_id || '.jpg' ELSE '/i/' || doc_id || '.jpg?utm_source=x' END AS image,
    CASE WHEN {LONG_SHARED} THEN CAST(len(regexp_extract_all({PLAIN}, '[^ \\t\\n\\r\\f\\v]+')) AS INTEGER) ELSE 0 END AS word_count,
    CASE WHEN {LONG_SHARED} THEN CASE WHEN length({PLAIN}) > 280 THEN trim(substr({PLAIN}, 1, 280)) || '…' ELSE {PLAIN} END END AS excerpt,
    CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2023-04-05 06:07:08' WHEN NOT ({LONG_SHARED}) THEN TIMESTAMP '2031-01-01' END AS published FROM documents""")
def article_semantic(spark, sf):
    """Documents as articles among page furniture; a date far after the clock is no date."""
    e = essays(spark, sf)
    page = F.concat(filled(ESSAY, at=F.when(F.col("doc_id") % 7 == 0, "2031-01-01").otherwise("2023-04-05T06:07:08Z")), filled('<body><nav><a href="/">Menu</a></nav><article>«body»<div class="share">Share «n»</div><script>var x = 1;</script></article><footer>Foot</footer></body></html>'))
    out = scans.articles(e.select("doc_id", filled("https://post.example/x/«n»").alias("url"), page.alias("html")), keep=["doc_id"], now=CLOCK)
    return out.select("doc_id", "title", "byline", "site_name", "lang", "canonical", "strategy", "text_content", "image", "word_count", "excerpt", "published")


DATA = r"trim(regexp_replace(replace(replace(replace(text, '<', ' '), '&', '+'), '>', ' '), '\s+', ' ', 'g'))"


@query(f"""SELECT doc_id, CASE WHEN length({DATA}) >= 250 THEN 'jsonld' ELSE '' END AS strategy, 'Headline ' || doc_id AS title, 'Ida ' || doc_id AS byline, 'Harbour Post' AS site_name, TIMESTAMP '2023-04-05' AS published,
    CASE WHEN length({DATA}) >= 250 THEN {DATA} END AS text_content FROM documents""")
def article_structured(spark, sf):
    """Bodies out of structured data, some of it with a trailing comma or inside a graph, after a block that can't be read."""
    d = table(spark, sf, "documents").withColumn("body", F.expr("replace(replace(replace(text, '<', ' '), '&', '+'), '>', ' ')"))
    own = F.to_json(F.struct(
        F.array(F.lit("Thing"), F.lit("NewsArticle")).alias("@type"), F.concat(F.lit("Headline "), F.col("doc_id").cast("string")).alias("headline"), F.col("body").alias("articleBody"), F.lit("2023-04-05").alias("datePublished"),
        F.array(F.struct(F.concat(F.lit("Ida "), F.col("doc_id").cast("string")).alias("name"))).alias("author"), F.struct(F.lit("Harbour Post").alias("name")).alias("publisher"),
    ))
    loose = F.concat(F.lit('{"@graph":['), own, F.lit(",],}"))
    page = F.concat(F.lit('<html><head><script type="application/ld+json">{"@type": broken</script><script type="application/ld+json">'), F.when(F.col("doc_id") % 2 == 0, own).otherwise(loose), F.lit("</script></head><body><p>short</p></body></html>"))
    out = scans.articles(d.select("doc_id", F.lit("https://post.example/").alias("url"), page.alias("html")), keep=["doc_id"])
    return out.select("doc_id", "strategy", "title", "byline", "site_name", "published", "text_content")


@query(f"SELECT doc_id, {PLAIN} AS shown, {PLAIN} AS fragment FROM documents")
def visible_text(spark, sf):
    """Text without scripts, styles and comments, blocks set apart."""
    e = essays(spark, sf).withColumn("page", filled("<head><title>no</title><style>p{}</style></head><body><!-- no -->«body»<script>no</script><template>no</template></body>"))
    return e.select("doc_id", udfs.plain_text(filled("<body>«body»<script>no</script><!-- no --></body>")).alias("shown"), udfs.fragment_text(F.col("body")).alias("fragment"))


def _picked(page: str, chosen: str) -> str:
    return " ".join(dom.plain_text(n) for n in selectors.select_all(dom.parse(page), tuple(chosen.split(" || "))))


picked = udfs.each(_picked, "string", 2)
PICKS = {"#k«n» > p": "«n»a «n»b", ".x p.y": "«n»b", "p:first-child || b": "«n»a «n»c", "[data-v*=\"«n»-\"]": "«n»c", "xpath://div[@id='k«n»']/p[2]": "«n»b", "p + p": "«n»b", "div ~ b": "«n»c", "p:not(.y)": "«n»a", "b || b": "«n»c «n»c", "p[": ""}


@query("SELECT c_custkey, CASE c_custkey % 10 " + " ".join("WHEN %d THEN %s" % (k, " || ".join("c_custkey" if j % 2 else f"'{x}'" for j, x in enumerate(re.split("[«»]", want))).replace("n || ", "")) for k, want in enumerate(PICKS.values())) + " END AS got FROM customer")
def selected_elements(spark, sf):
    """Ten selectors, by id, class, attribute, place and path, each alone or in a union."""
    own = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("n"))
    page = filled('<div id="k«n»" class="x z"><p>«n»a</p><p class="y">«n»b</p></div><b data-v="v«n»-1">«n»c</b>')
    chosen = F.element_at(F.array(*(filled(s) for s in PICKS)), (F.col("c_custkey") % 10 + 1).cast("int"))
    return own.select("c_custkey", picked(page, chosen).alias("got"))


ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]+')"
SCHEME = "regexp_extract(url, '^[a-z]+:')"


@query(f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN {ORIGIN} || '/a/b?x=' || page_id WHEN 1 THEN {SCHEME} || '//cdn.example/' || page_id WHEN 2 THEN 'ftp://o.example/' || page_id WHEN 3 THEN '' ELSE {ORIGIN} || '/up' END AS resolved,
    {ORIGIN.replace('^[a-z]+://[^/?#]+', '^[a-z]+://')} || 'mirror.example' || regexp_replace(url, '^[a-z]+://[^/?#]+', '') AS moved,
    regexp_replace(regexp_replace(url, '#.*$', ''), '^([a-z]+://[^/?#]+)([?]|$)', '\\1/\\2') AS fetched FROM pages""")
def url_references(spark, sf):
    """References resolved against a page, its address on another host, and its key in the cache of responses."""
    p = told(spark, sf)
    base = F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0), F.lit("/one/two"))
    refs = F.element_at(F.array(filled("/a/b?x=«n»"), filled(" //cdn.example/«n» "), filled("ftp://o.example/«n»"), F.lit(" "), F.lit("../up")), (F.col("page_id") % 5 + 1).cast("int"))
    return p.select("page_id", udfs.resolve_url(refs, base).alias("resolved"), udfs.set_host("url", F.lit("mirror.example")).alias("moved"), udfs.fetch_key("url").alias("fetched"))


@query("""SELECT c_custkey, 'https://a.example/p?id=' || c_custkey AS clean, CASE c_custkey % 4 WHEN 0 THEN 'example.co.uk' WHEN 1 THEN 'n' || c_custkey || '.example' WHEN 2 THEN '10.0.0.' || c_custkey ELSE 'localhost' END AS domain FROM customer""")
def url_cleaning(spark, sf):
    own = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("n"))
    host = F.element_at(F.array(filled("Shop«n».example.co.uk."), filled("www.sub.n«n».example"), filled("10.0.0.«n»"), F.lit("localhost")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return own.select("c_custkey", udfs.clean_tracking(filled("https://a.example/p?utm_source=s«n»&id=«n»&fbclid=z#part")).alias("clean"), udfs.registrable_domain(host).alias("domain"))


IP = "[user_id * 37 % 256, event_id * 11 % 256, event_id * 7 % 256, event_id % 256]"
PRIVATE = "a = 10 OR a = 127 OR a >= 224 AND a <= 239 OR a = 169 AND b = 254 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 OR a = 100 AND b BETWEEN 64 AND 127 OR a = 192 AND b = 0 AND c IN (0, 2) OR a = 198 AND b IN (18, 19) OR a + b + c + d = 0"


@query(f"""WITH x AS (SELECT event_id, {IP} AS o, event_id % 6 AS kind FROM events), y AS (SELECT event_id, kind, o[1] AS a, o[2] AS b, o[3] AS c, o[4] AS d FROM x)
    SELECT event_id, CASE WHEN kind = 0 THEN true WHEN kind = 1 THEN false ELSE {PRIVATE} END AS private FROM y""")
def private_addresses(spark, sf):
    """Addresses of both kinds; what is no address counts as private."""
    e = table(spark, sf, "events")
    ip = F.concat_ws(".", *(F.expr(x.strip()).cast("string") for x in IP.strip("[]").split(",")))
    ip = F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("fc00::"), F.hex("event_id"))).when(F.col("event_id") % 6 == 1, F.concat(F.lit("2606:4700::"), F.lower(F.hex(F.col("event_id") % 65536)))).otherwise(ip)
    return e.select("event_id", udfs.is_private_address(ip).alias("private"))


@query(r"SELECT doc_id, regexp_replace(substr(text, 1, 120), '[^\x01-\x7f\xa0-\xff]', '~', 'g') AS body FROM documents")
def decoded_bodies(spark, sf):
    """Bytes in one of four declared or guessed character sets."""
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.substring("text", 1, 120), r"[^\x01-\x7f\xa0-\xff]", "~").alias("t"))
    kind = F.col("doc_id") % 4
    raw = F.when(kind < 2, F.encode("t", "ISO-8859-1")).otherwise(F.encode("t", "UTF-8"))
    header = F.element_at(F.array(F.lit("text/html; charset=ISO-8859-1"), F.lit("text/html; charset='latin1'"), F.lit("text/html; charset=utf-8"), F.lit("text/html")), (kind + 1).cast("int"))
    return d.select("doc_id", udfs.decode_body(raw, header).alias("body"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'big' || c_custkey ELSE 'b' || c_custkey END AS largest, CASE c_custkey % 5 WHEN 0 THEN 'Ida' WHEN 1 THEN 'Ida Holm' WHEN 2 THEN 'Holm' || c_custkey ELSE '' END AS name,
    CASE WHEN length('example.com/offers/' || repeat('y', c_custkey % 40) || '/end') <= 30 THEN 'example.com/offers/' || repeat('y', c_custkey % 40) || '/end'
         ELSE substr('example.com/offers/' || repeat('y', c_custkey % 40) || '/end', 1, 12) || '…' || right('example.com/offers/' || repeat('y', c_custkey % 40) || '/end', 17) END AS short FROM customer""")
def page_details(spark, sf):
    """The largest candidate of an image, a name behind a label, and an address cut for display."""
    own = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("n"))
    k = F.col("c_custkey")
    sources = F.when(k % 3 == 0, filled("a 100w, big«n» 900w, c 300w")).otherwise(filled("a 1x, b«n» 3x, c 3x"))
    label = F.element_at(F.array(F.lit("Oleh Ida today"), F.lit("By: Ida Holm, Oslo"), filled("Town | oleh: Holm«n»"), F.lit("by 2030"), F.lit("nothing here")), (k % 5 + 1).cast("int"))
    long = F.concat(F.lit("https://example.com/offers/"), F.repeat(F.lit("y"), (k % 40).cast("int")), F.lit("/end"))
    return own.select("c_custkey", udfs.largest_of_srcset(sources).alias("largest"), udfs.byline(label).alias("name"), udfs.shorten_url(long, F.lit("30")).alias("short"))


ago = udfs.each(lambda s: text.ago(int(s)), "string")
size = udfs.each(lambda s: text.human_bytes(int(s)), "string")


@query("""SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 2592000 THEN (s // 86400) || 'd ago' ELSE '' END AS age,
    CASE WHEN s >= 1048576 THEN format('{:.1f}', s / 1048576.0) || ' MB' WHEN s >= 1024 THEN format('{:.1f}', s / 1024.0) || ' KB' ELSE s || ' bytes' END AS size FROM (SELECT event_id, event_id * event_id % 4000037 AS s FROM events)""")
def display_values(spark, sf):
    s = (F.col("event_id") * F.col("event_id") % 4000037).cast("string")
    return table(spark, sf, "events").select("event_id", ago(s).alias("age"), size(s).alias("size"))


@query("""SELECT page_id, url AS link, 'A' || page_id AS article, url AS answered FROM pages""")
def news_ids(spark, sf):
    """Links out of the ids of news links, and out of the answer of the service that resolves them."""
    p = told(spark, sf)
    size = F.octet_length("url")
    raw = F.concat(F.unhex(F.lit("081322")), F.unhex(F.lpad(F.hex(size.cast("long")), 2, "0")), F.col("url").cast("binary"), F.unhex(F.lit("D20100")))
    coded = F.regexp_replace(F.translate(F.base64(raw), "+/", "-_"), "[=\\s]", "")
    inner = F.concat(F.lit('[\\"garturlres\\",\\"'), F.col("url"), F.lit('\\",1]'))
    answer = F.concat(F.lit(")]}'\n\n[[\"wrb.fr\",\"Fbv4je\",\""), inner, F.lit('"]]'))
    return p.select("page_id", udfs.decode_news_id(coded).alias("link"), udfs.article_id(filled("https://news.google.com/rss/articles/A«n»?hl=en")).alias("article"), udfs.news_answer(answer).alias("answered"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS allowed FROM events")
def robots_file(spark, sf):
    """A rules file read and asked: the longest match decides, own rules come before those for all, an empty one allows all."""
    rules = F.lit("User-agent: *\nDisallow: /\n\nUser-agent: loomglass\nDisallow: /closed # no\nAllow: /closed/open\nDisallow: /*.pdf$\n")
    n = F.col("event_id").cast("string")
    path = F.element_at(F.array(F.concat(F.lit("/closed/"), n), F.concat(F.lit("/closed/open/"), n), F.concat(F.lit("/"), n), F.concat(F.lit("/a/"), n, F.lit(".pdf"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", udfs.robots_allows(rules, path).alias("allowed"))


def _canonical(raw: str) -> str:
    try:
        spec = parse_spec(raw)
        return f"{spec.lifetime} {self_link('https,http', 'out.example', '/feed', spec)}"
    except FieldError as e:
        return f"error: {e.field}"


canonical_plan = udfs.each(_canonical, "string")


@query("""WITH k AS (SELECT c_custkey, c_custkey % 4 AS f, c_custkey % 207 AS m, c_custkey % 3 AS g, c_custkey % 11 AS t FROM customer)
    SELECT c_custkey, CASE WHEN f = 3 THEN 'error: format' WHEN m = 0 OR m > 200 THEN 'error: max' WHEN g = 2 THEN 'error: guid' ELSE (CASE WHEN t = 0 THEN 900 ELSE t * 60 END) || ' https://out.example/feed?date_after=2026-02-03'
        || CASE f WHEN 0 THEN '' WHEN 1 THEN '&format=atom' ELSE '&format=json' END || CASE g WHEN 1 THEN '&guid=stable' ELSE '' END || CASE WHEN c_custkey % 6 IN (0, 4) THEN '&html_cleanup=0' ELSE '' END
        || '&item%5B%5D=' || CASE WHEN c_custkey % 2 = 0 THEN '%23' ELSE '.c' END || c_custkey || CASE WHEN m = 50 THEN '' ELSE '&max=' || m END || CASE WHEN t = 0 THEN '' ELSE '&ttl=' || t END
        || '&url=https%3A%2F%2Fwww.example.com%2Fc%2F' || c_custkey || '&url_contains%5B%5D=a&url_contains%5B%5D=b+c&url_contains%5B%5D=d' END AS plan FROM k""")
def canonical_plans(spark, sf):
    """Query strings checked and put in their canonical form: lists by number, defaults left out, the first fault named."""
    own = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("n"))
    k = F.col("c_custkey")
    one = lambda m, *values: F.element_at(F.array(*map(F.lit, values)), (k % m + 1).cast("int"))
    raw = filled(
        "ttl=«ttl»&url=https%3A%2F%2Fwww.example.com%2Fc%2F«n»&url_contains[2]=d&url_contains[1]=b+c&url_contains=a&format=«format»&max=«max»&guid=«guid»&date_after=3+February+2026&id_or_class=«cls»«n»&unknown=1&html_cleanup=«clean»",
        ttl=(k % 11), format=one(4, "", "ATOM", "json", "xml"), max=(k % 207), guid=one(3, "link", "Stable", "none"), cls=one(2, "", "c"), clean=one(6, "no", "1", "yes", "on", "0", "x"),
    )
    return own.select("c_custkey", canonical_plan(raw).alias("plan"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 WHEN event_id % 3 = 1 THEN event_id % 5 < 3 ELSE false END AS hit FROM events""")
def conditional_requests(spark, sf):
    """A tag decides where one is given, else whole seconds, else nothing is known."""
    n, at = F.col("event_id"), F.col("ts").cast("timestamp")
    tag = F.when(n % 3 == 0, F.when(n % 2 == 0, F.lit('"a"')).otherwise(F.lit('"b"')))
    since = F.when(n % 3 != 2, F.date_trunc("second", at) + F.when(n % 5 < 3, F.expr("interval 0 seconds")).otherwise(F.expr("interval -1 seconds")))
    return table(spark, sf, "events").select("event_id", c.conditional_hit(F.lit('"a"'), at, tag, since).alias("hit"))


@query("""SELECT page_id, (['image/jpeg', 'image/png', '', 'image/svg+xml', ''])[CAST(page_id % 5 AS INTEGER) + 1] AS kind FROM pages""")
def image_types(spark, sf):
    names = F.element_at(F.array(filled("https://e.example/a/«n».JPG?x=1.gif"), filled("/a.b/«n».png#f"), filled("https://e.example/«n»"), filled("x/«n».svg"), filled("a/«n».pdf")), (F.col("page_id") % 5 + 1).cast("int"))
    return told(spark, sf).select("page_id", c.image_type(names).alias("kind"))


cleaned = udfs.each(lambda s: sanitize.sanitized(dom.fragment(s), sanitize.Rules("https://e.example/dir/")), "string")


@query("""SELECT page_id, '<p>One ' || page_id || '</p><a href="https://e.example/q?i=' || page_id || '" rel="noopener noreferrer">two</a><img src="https://e.example/i/' || page_id || '.png" alt=""/>' AS html FROM pages""")
def sanitised_bodies(spark, sf):
    """Attributes, scripts, links to scripts, placeholders, sharing boxes, hidden and empty elements go; addresses become absolute."""
    raw = filled(
        '<p onclick="x()" style="y">One «n»</p><script>no</script><div class="share-box">no</div><a href="/q?utm_source=z&amp;i=«n»#f">two</a><img src="/blank.gif" data-src="/i/«n».png"><img src="data:x"><div hidden>no</div><div><span></span></div>'
    )
    return told(spark, sf).select("page_id", cleaned(raw).alias("html"))


@query(f"WITH {BUILDS} SELECT feed_key, id, built_at FROM builds UNION ALL SELECT 7, max(id) + 1, TIMESTAMP '2024-06-01' FROM builds")
def builds_append(spark, sf):
    """A history with another attempt, whose id is the next."""
    b = builds(spark, sf)
    row = b.orderBy("id").limit(1).withColumn("feed_key", F.lit(7).cast("long")).withColumn("built_at", F.lit("2024-06-01").cast("timestamp"))
    return catalog.recorded(b, row).select("feed_key", "id", "built_at")


def held(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    expires = F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderdate").cast("timestamp"))
    return o.select(F.col("o_orderkey").alias("feed_key"), expires.alias("expires_at"), F.col("o_orderdate").cast("timestamp").alias("fetched_at"), F.col("o_orderpriority").alias("body"), F.col("o_custkey").alias("id"), F.lit(None).cast("timestamp").alias("published_at"))


@query("SELECT o_orderkey AS feed_key FROM orders WHERE o_orderkey % 9 = 0 OR o_orderdate < TIMESTAMP '1999-01-01'")
def cache_expired(spark, sf):
    return catalog.expired(held(spark, sf), "1999-01-01 00:00:00").select("feed_key")


@query("SELECT o_orderkey AS feed_key, CAST(octet_length(encode(o_orderpriority)) AS INTEGER) AS body_bytes, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place FROM orders QUALIFY place <= 200")
def cache_newest(spark, sf):
    """The page of the listing that shows what was fetched last."""
    rows = catalog.cache_listing(held(spark, sf)).select("feed_key", "body_bytes", "fetched_at")
    return items.numbered(rows, 0, [F.desc("fetched_at"), "feed_key"]).select("feed_key", "body_bytes", (F.col("pos") + 1).alias("place"))


@query("SELECT o_orderkey AS feed_key FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 50")
def newest_items(spark, sf):
    return catalog.newest_items(held(spark, sf).withColumn("id", F.col("feed_key"))).select("feed_key")


@query(f"WITH {BUILDS} SELECT id, built_at FROM builds WHERE feed_key = 3 ORDER BY built_at DESC, id DESC LIMIT 20")
def history_page(spark, sf):
    return catalog.history(builds(spark, sf), 3).select("id", "built_at")


@query("SELECT l_returnflag, max(l_shipdate) AS updated FROM lineitem GROUP BY 1 UNION ALL SELECT 'none', TIMESTAMP '2024-01-20'")
def feed_updated(spark, sf):
    """The newest date of each feed, and of one without items the clock's."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_shipdate").cast("timestamp").alias("date"))
    out = items.feed_updated(rows.limit(0), "2024-01-20 00:00:00").select(F.lit("none").alias("l_returnflag"), "updated")
    for flag in [r[0] for r in rows.select("l_returnflag").distinct().collect()]:  # the three flags
        out = out.unionByName(items.feed_updated(rows.where(F.col("l_returnflag") == flag), "2024-01-20 00:00:00").select(F.lit(flag).alias("l_returnflag"), "updated"))
    return out


@query("""SELECT d.doc_id, p.page_id, p.url FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id""")
def bodies_attached(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "page_id", "url")
    return bodies.attached(table(spark, sf, "documents").select("doc_id"), p, "doc_id")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'own' || c_custkey ELSE 'site' || n_nationkey END AS item, CASE WHEN c_custkey % 2 = 0 THEN '.ad,.x' ELSE '.ad' END AS exclude, c_custkey % 5 = 0 OR n_nationkey % 4 = 0 AS cross_host,
    CASE WHEN c_custkey % 7 = 0 THEN 'own.example' ELSE 'h' || n_nationkey || '.example' END AS force_host FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def site_values_filled(spark, sf):
    """Values of a request completed by those of its site."""
    k, n = F.col("c_custkey"), F.col("n_nationkey")
    none = F.array().cast("array<string>")
    site = table(spark, sf, "nation").select("n_nationkey", F.array(F.concat(F.lit("site"), n.cast("string"))).alias("s_item"), F.array(F.lit(".ad")).alias("s_strip"), (n % 4 == 0).alias("s_cross"), F.concat(F.lit("h"), n.cast("string"), F.lit(".example")).alias("s_host"))
    asked = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.when(k % 3 == 0, F.array(F.concat(F.lit("own"), k.cast("string")))).otherwise(none).alias("item"), F.when(k % 2 == 0, F.array(F.lit(".x"))).alias("exclude"),
        (k % 5 == 0).alias("cross_host"), F.when(k % 7 == 0, "own.example").otherwise("").alias("force_host"),
    )
    out = sites.filled_from_site(asked.join(site, "n_nationkey"), {"item": "s_item"}, {"exclude": "s_strip"}, {"cross_host": "s_cross"}, {"force_host": "s_host"})
    return out.select("c_custkey", F.array_join("item", ",").alias("item"), F.array_join("exclude", ",").alias("exclude"), "cross_host", "force_host")


@query("""SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def upsert_stream(spark, sf):
    """A stream upserted into a table of versions; its last version holds the last row of each key."""
    folder = state.shared_folder(spark, "upserts")
    state.upserting(_stream(spark, sf).select("user_id", "event_id", "ts"), f"{folder}/table", ["user_id"], "event_id", f"{folder}/progress").awaitTermination()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/table")
    last = max(s.getPath().getName() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path))
    return spark.read.parquet(f"{folder}/table/{last}")



@query("SELECT page_id, true AS packed, sha256(encode(html)) AS body_sha256 FROM pages")
def compressed_bodies(spark, sf):
    """Bodies packed as gzip and unpacked again."""
    out = writers.compressed(table(spark, sf, "pages"), "html")
    return out.select("page_id", (F.hex(F.substring("packed", 1, 2)) == "1F8B").alias("packed"), F.sha2(udfs.gunzipped("packed").cast("binary"), 256).alias("body_sha256"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 90 AS k FROM events),
    s AS (SELECT *, max(ts - to_seconds(k)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS free FROM r) SELECT event_id, free + to_seconds(k) AS start FROM s""")
def paced_requests(spark, sf):
    """When each request may start if hosts are left 90 seconds between two."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return pacing.paced(e, 90, "user_id", "ts", "event_id").select("event_id", "start")


def _settings(raw: str) -> str:
    try:
        s = settings.load(raw)
    except ValueError:
        return "error"
    return f"{s.timeout:.3f} {s.max_body_bytes} {s.global_concurrency} {s.per_host_interval:.3f} {str(s.respect_robots).lower()} {s.cache_ttl:.0f} {s.user_agent}"


loaded = udfs.each(_settings, "string")


@query("""SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN '20.000 5242880 8 1.000 true 86400 loomglass/0.1' WHEN 1 THEN '90.500 ' || (c_custkey + 1) || ' ' || c_custkey || ' 0.250 false 5400 agent ' || c_custkey
    WHEN 2 THEN '20.000 5242880 8 1.000 true 86400 loomglass/0.1' WHEN 3 THEN 'error' ELSE 'error' END AS settings FROM customer""")
def settings_loaded(spark, sf):
    """Settings as YAML over the defaults: none, all, caps that are not positive, a wrong type, and what is no mapping."""
    texts = [
        "unknown: «n»\n", "timeout: 1m30.5s\nmax_body_bytes: «m»\nglobal_concurrency: «n»\nper_host_interval: 250ms\nrespect_robots: false\ncache_ttl: 1h30m\nuser_agent: agent «n»\n", "max_body_bytes: 0\nglobal_concurrency: -«m»\ntimeout: null\n",
        "timeout: «n» ducks\n", "- «n»\n",
    ]
    k = F.col("c_custkey")
    raw = F.element_at(F.array(*(filled(t, n=k, m=k + 1) for t in texts)), (k % 5 + 1).cast("int"))
    return table(spark, sf, "customer").select(k.alias("k"), loaded(raw).alias("settings"))


@query(f"""SELECT doc_id, 'https://post.example/x/' || doc_id AS url, CASE WHEN {LONG} THEN 'semantic' ELSE '' END AS strategy, 'Essay ' || doc_id AS title, CASE WHEN {LONG} THEN CAST(len(regexp_extract_all({PLAIN}, '[^ \\t\\n\\r\\f\\v]+')) AS VARCHAR) ELSE '0' END AS words,
    CASE WHEN {LONG} THEN length({TIGHT}) || ' characters' END AS reason, CASE WHEN NOT ({LONG}) THEN 'no strategy found an article' END AS error FROM documents""")
def probe_reports(spark, sf):
    """Reports read again: what was found, by which strategy and why."""
    page = F.concat(filled(ESSAY, at=F.lit("2023-04-05")), filled("<body><article>«body»</article></body></html>"))
    out = scans.probes(essays(spark, sf).select("doc_id", filled("https://post.example/x/«n»").alias("url"), page.alias("html")), keep=["doc_id"], now=CLOCK)
    names = {"url": "url", "strategy": "strategy", "title": "title", "words": "word_count", "error": "error"}
    reason = F.when(F.get_json_object("report", "$.attempts[0].ok") == "true", F.get_json_object("report", "$.attempts[0].reason"))
    return out.select("doc_id", *(F.get_json_object("report", f"$.{p}").alias(n) for n, p in names.items()), reason.alias("reason"))


@query(f"WITH e AS ({SQL['csv_export']}) SELECT 'csv' AS kind, * FROM e UNION ALL SELECT 'json', * FROM e")
def export_files(spark, sf):
    """The listing written as CSV and as JSON lines, and read again."""
    rows = listing(spark, sf)
    shape = writers.export_rows(rows).schema
    folder = state.shared_folder(spark, "exports")
    writers.write_csv(rows, f"{folder}/csv")
    writers.write_json(rows, f"{folder}/json")
    csv = spark.read.schema(shape).option("header", True).csv(f"{folder}/csv")
    return csv.withColumn("kind", F.lit("csv")).unionByName(spark.read.schema(shape).json(f"{folder}/json").withColumn("kind", F.lit("json")))


@query("SELECT n_nationkey, '<p>' || n_name || '</p>' || chr(10) AS html, n_name AS shown FROM nation")
def html_files_read(spark, sf):
    """Local pages: a file each, read whole."""
    folder = state.shared_folder(spark, "pages")
    table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.concat(F.lit("<p>"), F.col("n_name"), F.lit("</p>")).alias("value")).write.partitionBy("nation").text(folder)
    files = scans.html_files(spark, f"{folder}/nation=*")
    return files.select(F.regexp_extract("url", "nation=([0-9]+)", 1).cast("int").alias("n_nationkey"), "html", udfs.plain_text("html").alias("shown"))


sure_date = udfs.each(dates.parse_unambiguous, "timestamp")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 AND day(o_orderdate) > 12 THEN o_orderdate END AS date FROM orders")
def unambiguous_dates(spark, sf):
    """Days written with numbers only: no date where the first number may be a month, unless the year comes first."""
    day = F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", sure_date(raw).alias("date"))
