import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import feeds, pages, store


def test_rss(spark):
    xml = """<rss><channel><item><title>a</title><link>https://a.example/1</link><pubDate>Mon, 05 Jan 2026 10:00:00 GMT</pubDate></item>
    <item><link><![CDATA[https://a.example/2?x=1&amp;y=2]]></link><pubDate>Mon, 05 Jan 2026 18:00:00 +0530</pubDate></item><item><title>no link</title></item><item><link>https://a.example/3</link></item></channel></rss>"""
    got = feeds.rss_items(spark.createDataFrame([(xml,), (None,)], "feed string")).collect()
    assert [r.link for r in got] == ["https://a.example/2?x=1&y=2", "https://a.example/1", "https://a.example/3"]
    assert got[0].published == dt.datetime(2026, 1, 5, 12, 30) and got[2].published is None


def test_site_maps(spark):
    index = "<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><sitemap><loc>https://w.example/post/2.xml</loc></sitemap><sitemap><loc>https://w.example/post/1.xml</loc></sitemap><sitemap><loc>https://w.example/tag/0.xml</loc></sitemap></sitemapindex>"
    assert feeds.newest_map(spark.createDataFrame([(index,)], "xml string")).first().loc.endswith("post/1.xml")
    urls = "<urlset><url><loc>https://w.example/cricket-news/a</loc><lastmod>2026-01-01T00:00:00Z</lastmod></url><url><loc>https://w.example/about</loc></url><url><loc>https://w.example/cricket-news/b</loc><lastmod>2026-02-01</lastmod></url></urlset>"
    assert [r.link[-1] for r in feeds.map_urls(spark.createDataFrame([(urls,)], "xml string")).collect()] == ["b", "a"]


def test_fresh_limits_per_source(spark):
    rows = [("s", f"https://a.example/{i}", dt.datetime(2026, 1, i)) for i in range(1, 9)] + [("s", "https://a.example/u", None), ("t", "https://b.example/1", dt.datetime(2026, 1, 8))]
    c = spark.createDataFrame(rows, "source string, link string, published timestamp")
    got = feeds.fresh(c, F.lit("2026-01-08").cast("timestamp"), 3, 2)
    assert {r.link for r in got.collect()} == {"https://a.example/8", "https://a.example/7", "https://b.example/1"}
    with pytest.raises(KeyError):
        feeds.get_source("nope")
    assert feeds.get_source("rss").name == "rss"


def test_page(spark):
    html = """<html><head><title>Fallback</title><meta name="og:title" content="By name"><meta property="og:title" content=" Real title "><link rel="canonical" href="/news/1">
    <meta property="og:image" content="/pic.jpg"><script type="application/ld+json">{"@graph": [{"@type": "NewsArticle", "datePublished": "2026-01-02T03:04:05.678Z", "author": [{"name": "Ann Lee"}]}]}</script></head>
    <body><nav><p>Home</p></nav><article><h2>Sub</h2><p>First &amp; best.</p><p>Second
    line.</p><aside><p>Promo</p></aside></article><footer><p>Terms</p></footer></body></html>"""
    plain = "<html><head><title>T</title><meta name='author' content='https://me.example'></head><body><time datetime='2026-03-04T05:06:07+02:00'></time><p>Only text</p></body></html>"
    df = spark.createDataFrame([("https://x.example/a", html), ("https://x.example/b", plain), ("https://x.example/c", "<p></p>"), ("https://x.example/d", None)], "url string, html string")
    got = {r.url[-1]: r for r in pages.extract(df).collect()}
    a = got["a"]
    assert (a.title, a.canonical_url, a.author, a.image_url, a.body) == ("Real title", "https://x.example/news/1", "Ann Lee", "https://x.example/pic.jpg", "Sub\nFirst & best.\nSecond line.")
    assert a.published_at == dt.datetime(2026, 1, 2, 3, 4, 5, 678000)
    assert got["b"].author is None and got["b"].published_at == dt.datetime(2026, 3, 4, 3, 6, 7) and got["b"].canonical_url == "https://x.example/b"
    assert got["c"].body is None and got["d"].body is None


def test_robots():
    rules = "User-agent: *\nDisallow: /private"
    assert pages.robots_allows(rules, 200, "https://a.example/x") and not pages.robots_allows(rules, 200, "https://a.example/private/x")
    assert pages.robots_allows(None, 404, "https://a.example/x")
    assert not any(pages.robots_allows(rules, s, "https://a.example/x") for s in (None, 401, 403, 503))


def test_json_lines_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("u", "stored", "h", None)], store.SCHEMAS["seen_articles"])
    store.write_json_lines(df, path)
    store.write_json_lines(df, path, append=True)
    assert store.read_json_lines(spark, path, store.SCHEMAS["seen_articles"]).count() == 2


def test_database_is_created_once(spark):
    spark.range(1).createOrReplaceTempView("a_view")
    store.create_tables(spark, "tm_test")
    store.create_tables(spark, "tm_test")
    got = {r.table: r.rows for r in store.table_counts(spark, "tm_test").collect()}
    assert set(got) == set(store.SCHEMAS) and set(got.values()) == {0}
    spark.sql("DROP DATABASE tm_test CASCADE")


def test_lock_and_status(tmp_path):
    path = str(tmp_path / "lock")
    with store.Lock(path) as one:
        assert one
        with store.Lock(path) as two:
            assert not two
    with store.Lock(path) as again:
        assert again
    open(path, "w").close()
    os.utime(path, (1, 1))
    with store.Lock(path) as stale:
        assert stale
    status = str(tmp_path / "s.json")
    store.update_status(status, a=1)
    assert store.update_status(status, b=2) == {"a": 1, "b": 2}


def test_pages_are_archived_and_give_pictures(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.sources import pages

    rows = [("https://a.example/1", "<meta property='og:image' content='https://a.example/p.jpg'><article><p>x</p></article>"), ("https://a.example/2", "<p>none</p>")]
    df = spark.createDataFrame(rows, "url string, html string")
    pages.archive(df, str(tmp_path / "raw"))
    pages.archive(df.limit(1), str(tmp_path / "raw"))
    got = spark.read.parquet(str(tmp_path / "raw"))
    assert got.count() == 3 and all(len(r.file) == 21 and r.file.endswith(".html") for r in got.collect())
    arts = spark.createDataFrame([(1, "https://a.example/1", None), (2, "https://a.example/2", None), (3, "https://a.example/1", "https://own.example/q.jpg"), (4, None, None)], "id long, url string, image_url string")
    assert {r.id: r.image_url for r in pages.with_images(arts, df).collect()} == {1: "https://a.example/p.jpg", 2: None, 3: "https://own.example/q.jpg", 4: None}
    assert F
