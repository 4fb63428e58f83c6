from datetime import datetime, timezone

import pytest
from hypothesis import given, settings, strategies as st

from loomglass.kernels import article, dates, dom, feeds, fetching, listing, news, robots, sanitize, selectors, text, url

SAME = [
    ("https://e.example/a?utm_source=x&id=5", "https://e.example/a?id=5&fbclid=zz"), ("https://e.example/a?b=2&a=1", "https://e.example/a?a=1&b=2"),
    ("https://E.Example:443/a#x", "https://e.example/a"), ("http://e.example:80/a", "http://e.example/a"), ("https://e.example", "https://e.example/"),
]


@pytest.mark.parametrize("a, b", SAME)
def test_normalize(a, b):
    assert url.normalize(a) == url.normalize(b)


def test_normalize_edges():
    assert url.normalize("") == "/"
    assert url.normalize("https://e.example/a?id=5") == "https://e.example/a?id=5"
    assert url.normalize("http://e.example:port/") == "http://e.example:port/"
    assert url.normalize("https://e.example/a b?q=x y") == "https://e.example/a%20b?q=x+y"


@given(st.text(alphabet="abz0129:/?#&=%.-_ ü", max_size=40).map(lambda s: "https://e.example/" + s))
@settings(max_examples=300, deadline=None)
def test_normalize_is_idempotent(raw):
    once = url.normalize(raw)
    assert url.normalize(once) == once


@pytest.mark.parametrize("raw, shape", [
    ("https://quaylight.co.id/berth/2027/3/14/88/old-crane-sold", "quaylight.co.id/berth/{n}/{n}/{n}/{n}/{slug}"), ("https://north.tidepost.com/log/2027/11/02/4410097/storm", "tidepost.com/log/{n}/{n}/{n}/{n}/{slug}"),
    ("https://www.lampwick.com/isla/notes/zz4k0p9x", "lampwick.com/isla/notes/{slug}"), ("https://e.example/kontak", "e.example/kontak"),
    ("https://www.millrace.com/rivers/2027/mar/14/new-weir", "millrace.com/rivers/{n}/{n}/{n}/{slug}"), ("https://e.example/a", "e.example/a"),
])
def test_pattern(raw, shape):
    assert url.pattern(raw)[0] == shape


@pytest.mark.parametrize("raw", ["", "not a url", "mailto:a@b.example", "javascript:void(0)"])
def test_no_pattern(raw):
    assert url.pattern(raw) is None


def test_pattern_groups():
    day = [f"https://e.example/log/{d}" for d in ("2027-03-14/weir", "2027-03-13/crane", "20270312/quay")]
    assert [(g["pattern"], g["count"]) for g in url.group_patterns(day)] == [("e.example/log/{n}/{slug}", 3)]
    mixed = [f"https://e.example/shelf/{k}" for k in "pqrs"] + [f"https://e.example/log/2027/03/{k}" for k in "567"]
    assert url.group_patterns(mixed)[0]["pattern"] == "e.example/shelf/{slug}"
    even = [f"https://e.example/reef/{k}" for k in "uvw"] + [f"https://e.example/bay/cove/{k}" for k in "uvw"]
    assert url.group_patterns(even)[0]["depth"] == 3


@pytest.mark.parametrize("raw, mode, out", [
    ("?berth=7&crew=m", "1", "?berth=7&crew=m"), ("?q=8&a=3", "1", "?q=8&a=3"), ("?berth=7", "0", ""), ("?berth=7&crew=m", "berth", "?berth=7"), ("?berth=7&crew=m&w=2", "berth,crew", "?berth=7&crew=m"), ("?utm_campaign=k&berth=7", "1", "?berth=7"), ("?berth=7#deck", "1", "?berth=7"),
])
def test_keep_query_params(raw, mode, out):
    assert url.keep_query_params("https://e.example/a" + raw, mode) == "https://e.example/a" + out


def test_sites_and_hosts():
    assert url.site("https://north.quaylight.co.id/x") == "quaylight.co.id"
    assert url.registrable_domain("a.b.example.co.uk") == "example.co.uk"
    assert url.site("http://127.0.0.1:8080/") == "127.0.0.1"
    assert url.registrable_domain("localhost") == "localhost"
    assert url.set_host("https://a.example:8080/x", "b.example") == "https://b.example/x"
    assert url.set_host("/relative", "b.example") == "/relative"
    assert url.path_key("https://x.e.example/A?q=1") == url.path_key("https://e.example/a")
    assert url.resolve("//c.example/x", "https://e.example/") == "https://c.example/x"
    assert url.resolve("../b", "https://e.example/a/c/") == "https://e.example/a/b"


@pytest.mark.parametrize("raw, target", [
    ("http://www.bing.com/news/apiclick.aspx?c=4&q=weir&url=https%3a%2f%2fwww.millrace.com%2frivers%2fnew-weir", "https://www.millrace.com/rivers/new-weir"),
    ("https://www.google.com/url?url=weir&q=https%3A%2F%2Fmillrace.com%2Frivers&ved=2", "https://millrace.com/rivers"), ("https://www.google.fr/url?q=https%3A%2F%2Fmillrace.com%2Frivers&ved=2", "https://millrace.com/rivers"),
    ("https://www.bing.com/news/apiclick.aspx?c=9&url=https%3A%2F%2Fwww.google.com%2Furl%3Fq%3Dhttps%253A%252F%252Flampwick.com%252Fwick", "https://lampwick.com/wick"),
])
def test_unwrap(raw, target):
    assert url.unwrap(raw) == (target, True)


@pytest.mark.parametrize("raw", ["https://lampwick.com/url?q=https%3A%2F%2Fquaylight.test%2Fwick", "https://googleish.com/url?q=https%3A%2F%2Flampwick.test", "https://www.google.com/url?q=wick", "https://www.google.com/url?q=javascript%3Avoid(0)", ""])
def test_unwrap_leaves(raw):
    assert url.unwrap(raw) == (raw, False)


@pytest.mark.parametrize("raw", "2027-03-14T05:20:00Z|2027-03-14T05:20:00+03:00|2027-03-14|2027/03/14|14 March 2027|14 Mar 2027|14 March 2027 08:45|14 Maret 2027 08:45 WITA|Minggu, 14 Maret 2027|Minggu, 14 Maret 2027 pukul 08.45 WIB|March 14, 2027|Mar 14, 2027|20270314|14/03/2027|14 March 2027 (UTC+2)|14 March 2027 08:45:10".split("|"))
def test_dates(raw):
    assert dates.parse(raw).strftime("%Y-%m-%d") == "2027-03-14"


def test_date_edges():
    assert dates.parse("04/11/2027").month == 11 and dates.parse("17/11/2027").day == 17 and dates.parse("11/17/2027").day == 17
    assert dates.parse_unambiguous("04/11/2027") is None and dates.parse_unambiguous("17-11-2027").day == 17
    for raw in ("07:05", "", None, "30 Februari 2027", "2027", "low tide"):
        assert dates.parse(raw) is None
    assert dates.parse_feed_date("Sun, 14 Mar 2027 11:00:00 +0800").hour == 3
    assert dates.rfc1123(datetime(2027, 3, 14, 11, tzinfo=timezone.utc)) == "Sun, 14 Mar 2027 11:00:00 +0000"
    with pytest.raises(ValueError):
        dates.normalize_bound("04-11-2027")


@pytest.mark.parametrize("raw, day", [("Dock No14 Maret 2027 08:45 WITA", "2027-03-14"), ("Tide table 21/12/2027漢字", "2027-12-21"), ("New weir opened March 9, 2027", "2027-03-09"), ("9 Agustus 2027 07.15", "2027-08-09"), ("Regatta 2027 announced, entries from 03/04/2027", "2027-04-03")])
def test_find_date(raw, day):
    assert dates.find(raw).strftime("%Y-%m-%d") == day


def test_text():
    assert text.norm_space(" a \xa0 b\n") == "a b"
    assert text.truncate("abc def", 4) == "abc…" and text.truncate("abc", 0) == "abc"
    assert text.word_count("one 漢字 two") == 4
    assert text.human_bytes(2048) == "2.0 KB" and text.plural(1) == "" and text.ago(7200) == "2h ago"
    assert len(text.shorten_url("https://e.example/" + "x" * 80, 30).encode()) <= 32


PAGE = """<!doctype html><html lang=en><head><title>A &amp; B</title><script>var t="</p><title>no</title>";</script></head>
<body><nav id=top><a href=/menu>Menu</a></nav><p><b>Bold<p>Second <i>it</i><ul><li>one<li>two</ul><!-- c --><table><tr><td>x<td>y</table><div hidden>secret</div></body></html>"""


def test_tree():
    doc = dom.parse(PAGE)
    assert dom.text_of(doc.first("title")) == "A & B"
    assert [dom.plain_text(p) for p in doc.elements("p")] == ["Bold", "Second it"]
    assert [dom.plain_text(x) for x in doc.elements("li", "td")] == ["one", "two", "x", "y"]
    assert "no" not in dom.plain_text(doc) and not dom.is_visible(doc.elements("div")[0])
    assert dom.plain_text(dom.parse("<h1>Title</h1>Body")) == "Title Body"
    assert dom.plain_text(dom.parse("<div>" * 5000 + "deep" + "</div>" * 5000)) == "deep"
    assert dom.parse("").first("body") is not None
    assert dom.render(dom.parse("<p title='a\"b'>x<br>y</p>").first("p")) == '<p title="a&#34;b">x<br/>y</p>'


def test_selectors():
    doc = dom.parse('<div class="a b" id=k><p>1</p><p class=x data-v="foo bar">2</p></div><p>3</p>')
    pick = lambda *s: [dom.plain_text(n) for n in selectors.select_all(doc, s)]
    assert pick("#k > p") == ["1", "2"] and pick(".a.b p.x") == ["2"] and pick("p + p") == ["2"] and pick("div ~ p") == ["3"]
    assert pick('[data-v*="o b"]') == ["2"] and pick("p:first-child, p.x") == ["1", "2"] and pick("p:nth-child(2)") == ["2", "3"] and pick("p:not(.x)") == ["1", "3"]
    assert pick("xpath://div[@id='k']/p[contains(@class,'x')]") == ["2"] and pick("xpath://p[2]") == ["2", "3"][:1] + (["3"] if len(pick("xpath://p[2]")) > 1 else [])
    assert pick("p[", "0", "", "xpath://[") == []


def cards(n):
    body = "".join(f'<article class="card"><a href="/2027/03/{k:02d}/crane-log-no-{k:02d}">Crane {k}</a><time datetime="2027-03-{k:02d}"></time><p>Lifted {k}</p></article>' for k in range(1, n + 1))
    nav = "".join(f'<a href="/shelf/{c}">{c}</a>' for c in "abcd")
    return f"<html><body><nav>{nav}</nav>{body}<footer>{nav}</footer></body></html>"


def test_listing():
    o = listing.ListOptions(base_url="https://e.example/")
    found, how = listing.collect(cards(8), o)
    assert len(found) == 8 and how.candidates[0]["pattern"] == "e.example/{n}/{n}/{n}/{slug}" and how.selector == ".card" and how.confidence != "low"
    assert found[0].title == "Crane 1" and found[0].date.day == 1 and found[0].summary == "Crane 1 Lifted 1"
    assert listing.collect(cards(2), o) == ([], None)
    picked, _ = listing.collect(cards(5), listing.ListOptions(base_url="https://e.example/", item=(".card",), max_items=3, exclude=(".card:first-child",)))
    assert len(picked) == 3
    twins = "".join(f'<div><a href="https://e.example/x/{a}">T</a></div>' for a in ("weir?v=1", "weir?v=2", "quay", "reef"))
    assert len(listing.collect(twins, o)[0]) == 3
    assert [listing.grade(c) for c in ([20, 3], [5, 5], [7])] == ["high", "low", "medium"]


def test_listing_has_every_link_of_a_long_page():
    o = listing.ListOptions(base_url="https://e.example/")
    page = "".join(f'<div class="card"><a href="/2027/{k}/crane-{k}">Crane {k}</a></div>' for k in range(5000))
    found, how = listing.collect(page, o)
    assert [it.title for it in found] == [f"Crane {k}" for k in range(5000)] and how.candidates[0]["count"] == 5000
    assert len(listing.link_refs(dom.parse(page), o)) == 5000


@pytest.mark.parametrize("raw, name", [("Oleh Ida Holm", "Ida Holm"), ("Oleh: ida", "ida"), ("by 1999", ""), ("By: Ida Holm yesterday", "Ida Holm"), ("Harbour | oleh: Holm", "Holm"), ("low tide", "")])
def test_byline(raw, name):
    assert listing.find_byline(raw) == name


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:atom="http://www.w3.org/2005/Atom">
<channel><title>Quay log</title><atom:link href="https://quay.example/own" rel="self"/><link>https://quay.example/</link>
<item><title>Weir &amp; quay</title><link>/1</link><pubDate>Sun, 14 Mar 2027 11:00:00 +0800</pubDate><description><![CDATA[<p>Water is low.</p>]]></description><media:thumbnail url="https://quay.example/crane.jpg"/></item>
<item><title>B</title><guid>https://quay.example/berth/2</guid><dc:date>2027-03-13</dc:date><dc:creator>Ida</dc:creator><content:encoded>&lt;p&gt;The crane was sold.&lt;/p&gt;</content:encoded></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><link rel="self" href="https://quay.example/own"/><link href="https://quay.example/"/><entry><title>E</title><id>urn:1</id><link rel="enclosure" type="image/png" href="/i.png"/>
<link rel="alternate" href="/e"/><updated>2027-03-13T00:00:00Z</updated><author><name> Ann </name></author><summary>s</summary><content type="html">&lt;b&gt;Body&lt;/b&gt; text</content></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><channel rdf:about="x"><title>R</title><link>https://r.example/</link></channel><item rdf:about="https://r.example/1"><title>One</title></item></rdf:RDF>"""
JSON = '{"version":"https://jsonfeed.org/version/1.1","title":"J","home_page_url":"https://j.example/","items":[{"id":"https://j.example/1","title":"T","content_html":"<p>Hi</p>","authors":[{"name":"Ann"}],"image":"i.png","date_published":"2027-03-14T00:00:00Z"}]}'


def test_feed_readers():
    a, b = feeds.parse(RSS, "https://quay.example/").items
    assert (a.link, a.title, a.summary, a.image, a.date.hour) == ("https://quay.example/1", "Weir & quay", "Water is low.", "https://quay.example/crane.jpg", 3)
    assert (b.link, b.author, b.summary, b.date.day) == ("https://quay.example/berth/2", "Ida", "The crane was sold.", 13)
    e = feeds.parse(ATOM, "https://quay.example/")
    assert e.link == "https://quay.example/" and (e.items[0].link, e.items[0].image, e.items[0].author, e.items[0].summary) == ("https://quay.example/e", "https://quay.example/i.png", "Ann", "Body text")
    assert feeds.parse(RDF).items[0].link == "https://r.example/1" and feeds.parse(RDF).format == "rdf"
    assert feeds.parse(JSON).items[0].summary == "Hi" and feeds.parse(JSON).items[0].link == "https://j.example/1"
    for bad in ("", "<html></html>", "{", "plain"):
        with pytest.raises(feeds.NotAFeed):
            feeds.parse(bad)


@pytest.mark.parametrize("kind", feeds.FORMATS)
def test_feed_writers_round_trip(kind):
    t = dates.parse("2027-03-14T09:00:00Z")
    f = feeds.Feed("T & co", "https://t.example/", "D", updated=t, entries=[feeds.Entry("A & <b>", "https://t.example/1?a=1&b=2", "https://t.example/1", t, t, "Ann", "sum", "<p>Body</p>", "https://t.example/i.png")])
    back = feeds.parse(feeds.write(f, kind), "")
    assert (back.title, back.items[0].link, back.items[0].guid, back.items[0].date) == ("T & co", "https://t.example/1?a=1&b=2", "https://t.example/1", t)


def test_image_type_and_opml():
    assert feeds.image_type("https://e.example/a.JPG?x=1") == "image/jpeg" and feeds.image_type("https://e.example/a") == ""
    assert 'xmlUrl="k"' in feeds.write_opml([("k", "")], "S", datetime(2026, 1, 1, tzinfo=timezone.utc))


ARTICLE = f"""<html lang=en><head><title>New weir | Millrace</title><meta property="og:title" content="New weir"><meta property="og:site_name" content="Millrace"><meta name=author content=Ida>
<meta property="og:image" content="/i.jpg?utm_source=x"><link rel=canonical href="/c"><meta property="article:published_time" content="2027-03-14"></head><body><nav>Menu nav</nav>
<main><article><h1>New weir</h1>{'<p>This paragraph about the weir is long enough to be read.</p>' * 20}<div class="share">Share this</div><custom-el>gone</custom-el></article></main><footer>Foot</footer></body></html>"""


def test_article():
    a = article.extract(ARTICLE, "https://e.example/x")
    assert (a.title, a.byline, a.site_name, a.strategy, a.lang) == ("New weir", "Ida", "Millrace", "semantic", "en")
    assert a.image == "https://e.example/i.jpg" and a.canonical == "https://e.example/c" and a.word_count >= 100
    assert not any(w in a.text_content for w in ("Menu", "Share", "Foot", "gone")) and "gone" in article.extract(ARTICLE, "https://e.example/x", prune=False).text_content
    assert article.extract(ARTICLE, "u", now=datetime(2026, 1, 1, tzinfo=timezone.utc)).published is None
    assert article.extract("", "").strategy == ""
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"NewsArticle","headline":"H","articleBody":"' + "Tide " * 100 + '","author":[{"name":"Ann"}],}]}</script>'
    b = article.extract(f"<html><body>{ld}</body></html>")
    assert (b.strategy, b.title, b.byline) == ("jsonld", "H", "Ann")
    c = article.extract("<body><div class=content>" + "<p>Plain words, with commas, in a paragraph that goes on for a while.</p>" * 8 + "</div></body>")
    assert c.strategy == "readability" and [t["name"] for t in c.attempts] == ["semantic", "readability"]


def test_sanitize():
    n = dom.fragment('<p onclick=x style=y>T<img src="data:x" data-src="/a.png" srcset="/b.png 1x, /c.png 2x"></p><script>x</script><a href="javascript:1">L</a><a href="/q?utm_source=1&i=2#f">M</a><div><span></span></div>')
    out = sanitize.sanitized(n, sanitize.Rules("https://e.example/"))
    assert out == '<p>T<img src="https://e.example/a.png" alt=""/></p>L<a href="https://e.example/q?i=2" rel="noopener noreferrer">M</a>'
    assert sanitize.largest_of("a 100w, b 300w, c 300w") == "b"


def test_robots():
    r = robots.parse_robots("User-agent: *\nDisallow: /a\nAllow: /a/b\nDisallow: /x/*.pdf$\nCrawl-delay: 2\nSitemap: s\n\nUser-agent: loomglass\nDisallow: /only", "other")
    assert [robots.allowed(r, p) for p in ("/", "/a", "/a/b", "/x/1.pdf", "/x/1.pdf2")] == [True, False, True, False, True]
    assert r.crawl_delay == 2 and r.sitemaps == ["s"]
    own = robots.parse_robots("User-agent: *\nDisallow: /\nUser-agent: loomglass\nDisallow: /only")
    assert robots.allowed(own, "/x") and not robots.allowed(own, "/only/1")
    assert not robots.allowed(robots.Robots(allow=["/p"], disallow=["/p"]), "/p")


def test_fetching():
    assert fetching.challenge(200, "text/html", b"<p>Just a moment...</p>") and not fetching.challenge(200, "text/html", b"<article>fine</article>")
    assert fetching.challenge(202, "text/html", b"<p>") and not fetching.challenge(200, "application/json", b"just a moment")
    assert [fetching.is_private(a) for a in ("10.1.2.3", "8.8.8.8", "::1", "fc00::1", "100.64.0.1", "x")] == [True, False, True, True, True, True]
    assert fetching.decode_body("text/html; charset=iso-8859-1", b"caf\xe9") == "café" and fetching.decode_body("", "ü".encode()) == "ü"
    assert fetching.fnv1a(b"") == '"cbf29ce484222325"' and fetching.error_type("X Timeout") == "timeout" and fetching.error_type(None) == "unknown"


def test_news():
    import base64

    raw = b"\x08\x13\x22" + bytes([25]) + b"https://millrace.com/weir" + b"\xd2\x01\x00"
    assert news.decode_legacy(base64.urlsafe_b64encode(raw).decode().rstrip("=")) == "https://millrace.com/weir"
    assert news.article_id("https://news.google.com/rss/articles/ABC?hl=en") == "ABC" and news.article_id("https://e.example/articles/ABC") is None
    body = ")]}'\n\n[[\"wrb.fr\",\"Fbv4je\",\"[\\\"garturlres\\\",\\\"https://example.com/x\\\",1]\"]]"
    assert news.answer(body) == "https://example.com/x" and news.answer("nothing") is None
