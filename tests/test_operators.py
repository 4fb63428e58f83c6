from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomglass.functions import columns as c, udfs
from loomglass.operators import bodies, catalog, health, items, rules, sites
from loomglass.operators.rules import FieldError, Rules
from loomglass.plans import pipeline
from loomglass.plans.spec import parse
from loomglass.sources import pages as scans, writers
from loomglass.sources.sites import load_sites, sites_table
from loomglass.streaming import state

ITEM = "link string, title string, author string, date timestamp, image string, summary string, guid string, source_ord int, pos int"
FIXED = [
    ("https://quaylight.co.id/log/2027/3/14/88/old-crane-sold", "Old crane sold", "2027-03-14"), ("https://quaylight.co.id/log/2027/3/13/87/weir-closed", "Weir closed", "2027-03-13"),
    ("https://north.tidepost.com/watch/2027/03/12/500/storm", "Storm over town", "2027-03-12"), ("https://www.lampwick.com/isla/notes/zz4k0p9x", "Isla note", "2027-03-08"), ("https://quaylight.co.id/shelf/rope", "Rope shelf", None),
]


@pytest.fixture(scope="module")
def five(spark):
    rows = [(link, title, None, datetime.fromisoformat(day) if day else None, None, "About " + title, None, 0, k) for k, (link, title, day) in enumerate(FIXED)]
    return spark.createDataFrame(rows, ITEM)


def kept(five, **fields):
    return [r.pos for r in rules.survivors(five, Rules(**fields)).orderBy("pos").collect()]


@pytest.mark.parametrize("fields, left", [
    ({}, [0, 1, 2, 3, 4]), ({"url_contains": ("QUAYLIGHT.co.id",)}, [0, 1, 4]), ({"url_contains": (" ",)}, []), ({"url_not_contains": ("shelf", "")}, [0, 1, 2, 3]), ({"uri_matches": (r"/\d{4}/",)}, [0, 1, 2]),
    ({"text_contains": ("weir",)}, [1]), ({"text_not_contains": ("rope",)}, [0, 1, 2, 3]), ({"domain": ("tidepost.com",)}, [2]), ({"date_after": "2027-03-12", "date_before": "13 March 2027"}, [1, 2]),
])
def test_rules(five, fields, left):
    assert kept(five, **fields) == left


def test_drop_reasons_are_the_first(five):
    r = Rules(url_contains=("quaylight",), date_after="2027-03-14")
    assert {x.drop_reason: x.dropped for x in rules.drop_counts(five, r).collect()} == {"url_contains": 2, "date": 2}


def test_bad_rules():
    for fields in ({"uri_matches": ("(",)}, {"uri_matches": ("(?=x)",)}, {"date_after": "04-11-2027"}):
        with pytest.raises(FieldError):
            Rules(**fields).checked()


def test_first_wins_and_caps(spark, five):
    doubled = items.distinct_links(five.unionByName(five.withColumn("source_ord", F.lit(1)).withColumn("title", F.lit("later"))))
    assert sorted(r.title for r in doubled.collect()) == sorted(t for _, t, _ in FIXED)
    blank = spark.createDataFrame([(None, "a", None, None, None, None, None, 0, 0), ("", "b", None, None, None, None, None, 0, 1)], ITEM)
    assert [r.title for r in items.distinct_links(blank).collect()] == ["a"]
    assert [r.pos for r in items.newest_first(items.capped(five, 2)).collect()] == [0, 1]
    assert items.distinct_links(five.limit(0)).count() == 0


def test_entries(five):
    e = items.entries(items.distinct_links(five), "stable", 9).orderBy("pos").collect()
    assert e[0].guid.startswith("sha256:") and len(e[0].guid) == 27 and e[0].entry_summary == "About Old…"
    assert items.default_description("e.example", 1) == "1 item from e.example."


def test_boilerplate(spark):
    b = spark.createDataFrame([("r", k, t) for k, t in (("a", "same"), ("b", "same"), ("c", "same"), ("d", "other"))] + [("s", "a", "x"), ("s", "b", "x"), ("t", "a", "y")], "run string, k string, body string")
    out = {(r.run, r.k): r.boilerplate for r in bodies.with_boilerplate(b, by=["run"]).collect()}
    assert out == {("r", "a"): True, ("r", "b"): True, ("r", "c"): True, ("r", "d"): False, ("s", "a"): True, ("s", "b"): True, ("t", "a"): False}


BUILD = "feed_key string, id long, source_url string, ok boolean, item_count long, selector string, error string, built_at timestamp"


def test_catalogue(spark):
    at = lambda k: datetime(2026, 1, 1, 0, k)
    b = spark.createDataFrame([("many", k, "u", True, 10 + k, None, None, at(k)) for k in range(5)] + [("once", 9, "u", False, 0, None, "boom", at(9))], BUILD)
    kept = catalog.pruned(b, 2)
    assert sorted((r.feed_key, r.item_count) for r in kept.collect()) == [("many", 13), ("many", 14), ("once", 0)]
    h = {r.feed_key: r for r in health.feed_health(b).collect()}
    assert (h["once"].failure_streak, h["once"].last_success, h["many"].failure_streak, h["many"].avg_gap_ms) == (1, None, 0, 60000)
    cache = spark.createDataFrame([("gone", "u", "rss", 3, "d", at(0), at(5))], "feed_key string, source_url string, format string, item_count long, detector string, fetched_at timestamp, expires_at timestamp")
    rows = {r.key: r for r in health.listing(b, cache, "2026-01-01 00:06:00").withColumn("state", health.state()).collect()}
    assert {k: r.state for k, r in rows.items()} == {"many": "not cached", "once": "failed", "gone": "stale"}
    old = spark.createDataFrame([(1, "a", "h", "x"), (2, "b", "h", "x")], "k int, title string, content_hash string, content_html string")
    new = spark.createDataFrame([(1, "", "h2", ""), (2, "c", "h", "x"), (3, "n", "h", "x")], old.schema)
    m = {r.k: r for r in catalog.merged_items(old, new, ["k"], ["title", "content_hash", "content_html"]).collect()}
    assert (m[1].title, m[1].content_hash, m[1].content_html, m[1].changed, m[2].title, m[2].changed, m[3].changed) == ("a", "h2", "x", True, "b", False, True)
    assert catalog.recorded(b, b.where("id = 9").drop("id").withColumn("id", F.lit(0))).agg(F.max("id")).first()[0] == 10


def test_sites(spark, tmp_path):
    (tmp_path / "e.example.yml").write_text("item: .card\nstrip: [.ad]\n")
    (tmp_path / "all.yaml").write_text("- host: '*.tidepost.com'\n  item: [.w]\n- host: '*'\n  item: [.g]\n")
    t = sites_table(spark, load_sites(str(tmp_path)))
    p = spark.createDataFrame([(1, "https://www.e.example/x"), (2, "https://a.tidepost.com/"), (3, "https://tidepost.com/"), (4, None)], "page_id int, url string")
    assert {r.page_id: r.item for r in sites.with_site(p, t, take=["item"]).collect()} == {1: [".card"], 2: [".w"], 3: [".g"], 4: [".g"]}
    (tmp_path / "bad.yml").write_text("- item: x\n")
    with pytest.raises(ValueError):
        load_sites(str(tmp_path))


FEED_A = '<rss version="2.0"><channel><title>Feed A</title><link>https://a.example/</link><item><title>A1</title><link>https://a.example/1</link><pubDate>Sat, 26 Sep 2026 09:00:00 +0000</pubDate></item><item><title>Shared A</title><link>https://shared.example/x</link><pubDate>Fri, 25 Sep 2026 09:00:00 +0000</pubDate><description>from A</description></item></channel></rss>'
FEED_B = FEED_A.replace("Feed A", "Feed B").replace("A1", "B1").replace("https://a.example/1", "https://b.example/1").replace("Sat, 26", "Sun, 27").replace("Shared A", "Shared B").replace("from A", "from B")


def test_merge_two_feeds(spark):
    responses = spark.createDataFrame([("https://a.example/f", FEED_A), ("https://b.example/f", FEED_B)], "url string, body string")
    spec = parse("feeds[]=https%3A%2F%2Fa.example%2Ff&feeds[]=https%3A%2F%2Fb.example%2Ff&feeds[]=https%3A%2F%2Fmissing.example%2F&format=json")
    rows = pipeline.entries(spec, pipeline.chosen(spec, pipeline.scanned_items(spec, responses))).collect()
    assert [r.entry_title for r in rows] == ["B1", "A1", "Shared A"] and rows[2].entry_summary == "from A"
    doc = pipeline.build(spec, responses, now=datetime(2026, 9, 26)).first()
    assert doc.item_count == 3 and doc.feed_key == spec.canonical() and doc.body.index("B1") < doc.body.index("A1")
    wanted = spark.createDataFrame([("https://a.example/f", 0), ("https://m.example/", 1)], "url string, source_ord int")
    s = items.source_status(wanted, responses).first()
    assert (s.fetched, s.failed, s.first_source) == (1, 1, "https://a.example/f")


def test_page_then_feed_it_points_to(spark):
    page = '<html><head><link rel="alternate" type="application/rss+xml" href="/f"></head><body><nav><a href="/x/y">n</a></nav></body></html>'
    responses = spark.createDataFrame([("https://a.example/", page), ("https://a.example/f", FEED_A)], "url string, body string")
    spec = parse("url=https://a.example/&fulltext=1")
    assert sorted(r.title for r in pipeline.scanned_items(spec, responses).collect()) == ["A1", "Shared A"]
    assert pipeline.build(spec, responses, now=datetime(2026, 9, 26)).first().item_count == 2


def test_spec():
    s = parse("url=https://e.example/x&max=10&url_contains[]=a&url_contains[2]=c&url_contains[1]=b&date_after=2027-03-14&fulltext=1&fulltext_max=5&id_or_class=card&html_cleanup=0")
    assert s.rules.url_contains == ("a", "b", "c") and s.max_items == 5 and s.listing.item == (".card",) and not s.html_cleanup
    assert parse(s.canonical()) == parse(parse(s.canonical()).canonical()) and parse("url=https://e.example/x&format=rss&max=50").canonical() == "url=https%3A%2F%2Fe.example%2Fx"
    for bad, field in (("", "url"), ("url=ftp://x/", "url"), ("url=https://e.example/&max=0", "max"), ("url=https://e.example/&format=x", "format"), ("url=https://e.example/&guid=x", "guid"), ("url=https://e.example/&force_host=a/b", "force_host"),
                       ("url=https://e.example/&date_after=04-11-2027", "date_after"), ("url=https://e.example/&keep_qs_params=a=b", "keep_qs_params"), ("url=https://e.example/&item=a&id_or_class=b", "id_or_class"), ("url=https://e.example/&ttl=x", "ttl")):
        with pytest.raises(FieldError) as e:
            parse(bad)
        assert e.value.field == field
    assert s.lifetime == 900 and parse("url=https://e.example/&ttl=5").lifetime == 300


def test_columns_agree_with_kernels(spark):
    from loomglass.kernels import text, url

    raw = ["https://www.e.co.uk:8080/a/2026/9/b-c?id=1&utm_source=x&b=2#f", "http://e.example", "https://e.example/20260926/xyz/?q", "not a url", "", None, "https://u@e.example/x"]
    df = spark.createDataFrame([(r,) for r in raw], "u string").withColumn("site", udfs.site_of("u"))
    for r in df.select("u", c.host("u").alias("h"), c.url_pattern("u", F.nullif("site", F.lit(""))).alias("p"), c.keep_query_params("u", "1").alias("k"), c.slug("u").alias("s"), udfs.url_pattern("u").alias("kp")).collect():
        if r.u and "://" in r.u:
            assert r.h == url.hostname(r.u) and r.p == r.kp and r.s == url.slug(r.u)
            assert url.normalize(r.k) == url.normalize(url.keep_query_params(r.u, "1"))
    words = ["  a  b ", "漢字 kana かな x", "", "one\xa0two"]
    for r in spark.createDataFrame([(w,) for w in words], "t string").select("t", c.norm_space("t").alias("n"), c.word_count("t").alias("w"), c.truncate("t", 3).alias("x")).collect():
        assert (r.n, r.w, r.x) == (text.norm_space(r.t), text.word_count(r.t), text.truncate(r.t, 3))


def test_sql_functions(spark):
    udfs.register_functions(spark)
    assert spark.sql("SELECT norm_url('HTTP://E.example:80') AS u").first().u == "http://e.example/"
    rows = spark.sql("SELECT * FROM parse_feed('" + FEED_A + "', 'https://a.example/')").collect()
    assert [r.title for r in rows] == ["A1", "Shared A"]
    assert spark.sql("SELECT strategy FROM extract_article('<article>" + "word " * 80 + "</article>', '')").first().strategy == "semantic"


def test_scans_take_nulls_and_empty_tables(spark):
    p = spark.createDataFrame([("u", None), (None, ""), ("https://e.example/", "<p>x")], "url string, html string")
    assert scans.page_facts(p).count() == 3 and scans.page_links(p).count() == 0 and scans.articles(p.limit(0)).count() == 0
    assert scans.feed_documents(p, body="html").where("feed_format is not null").count() == 0


def test_render_and_etag(spark, five):
    rows = items.entries(items.distinct_links(five)).select(F.lit("k").alias("feed_key"), F.col("entry_title").alias("title"), "link", "guid", "published", F.col("date").alias("updated"), "author", F.col("entry_summary").alias("summary"), "content_html", "image", "source_ord", "pos")
    feed = writers.gathered(rows, ["feed_key"], ["source_ord", "pos"]).withColumn("title", F.lit("T")).withColumn("link", F.lit("https://t.example/"))
    body = writers.rendered(feed, "rss", datetime(2026, 1, 1)).first().body
    assert body.count("<item>") == 5 and "Old crane sold" in body
    assert writers.feed_json(feed).first().body.startswith('{"version"')


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v long").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k string, v long").parquet(src)
    assert state.drained(state.new_only(stream.select("k"), ["k"]), "once_each").count() == 2
    state.upserting(stream, str(tmp_path / "t"), ["k"], "v", str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t/v00000000")).collect())) == [("a", 2), ("b", 3)]


def test_url_functions_in_the_jvm_equal_the_kernels(spark):
    import random

    from loomglass.kernels import url

    r = random.Random(7)
    hosts = ["e.example", "www.a.co.uk", "co.uk", "10.0.0.1", "localhost", "N.Example", "u@e.example", "e.example:80", "a..b", "x-1.com.br"]
    paths = ["", "/", "/a", "/A/b.html", "/a//b/", "/%41", "/ü", "/a b", "/.", "/a/../b", "/~x"]
    queries = ["", "?", "?b=2&a=1", "?a=1&utm_source=x", "?utm_Medium=1", "?a=&a=0", "?a", "?a=1&&b", "?a=%20", "?x=1;y=2", "?fbclid=1&z=9&Z=1"]
    ends = ["", "#", "#top", "#a/b", "#%"]
    raw = [f"{r.choice(['http', 'https', 'HTTP', 'ftp'])}://{r.choice(hosts)}{r.choice(paths)}{r.choice(queries)}{r.choice(ends)}" for _ in range(3000)] + ["", "x", None, " https://e.example/ "]
    rows = spark.createDataFrame([(u,) for u in raw], "u string").select("u", udfs.norm_link("u").alias("n"), udfs.site("u").alias("s"), udfs.link_path_key("u").alias("k"), c.is_plain_url("u").alias("plain")).collect()
    for x in rows:
        assert (x.n, x.s, x.k) == ((url.normalize(x.u), url.site(x.u), url.path_key(x.u)) if x.u is not None else (None, None, None)), x.u
    assert 100 < sum(x.plain for x in rows) < len(rows)
