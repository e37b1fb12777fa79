"""Queries over texts: hashes, validation, cleaning, duplicates, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.simhash import simhash64
from tidemark.functions.urls import canonical_url
from tidemark.operators import dedup, validate
from tidemark.plans.base import DAY, Tables, clean_sql, query
from tidemark.session import cut, spread
from tidemark.sources.feeds import fresh, map_urls, parse_time, rss_items
from tidemark.sources.pages import archive_name, extract

_W = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
_NOT = r"[^\p{L}\p{N}_\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '{_NOT}', '', 'g'), '{_W}+', ' ', 'g'))"


def words_sql(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array(coalesce({x}, ''), '{_W}+'), lambda w: w <> ''))"


@query(f"SELECT id, sha256({norm_sql('''coalesce(title, '') || ' ' || coalesce(body, '')''')}) AS content_hash FROM articles")
def content_hash(t: Tables) -> DataFrame:
    """Content hashes computed anew for all articles."""
    return t.articles.select("id", text.content_hash(F.col("title"), F.col("body")).alias("content_hash"))


@query("SELECT id, simhash FROM articles WHERE simhash IS NOT NULL")
def simhash64_articles(t: Tables) -> DataFrame:
    """SimHash values computed anew; the SQL reads the stored ones."""
    a = spread(t.articles.where(F.col("simhash").isNotNull()).select("id", "body"), "id")
    return a.select("id", simhash64(F.col("body")).alias("simhash"))


@query("SELECT id, canonical_url FROM articles WHERE canonical_url IS NOT NULL AND url IS NOT NULL")
def canonical_urls(t: Tables) -> DataFrame:
    """Canonical addresses computed anew; the SQL reads the stored ones."""
    return t.articles.where(F.col("canonical_url").isNotNull() & F.col("url").isNotNull()).select("id", canonical_url(F.col("url")).alias("canonical_url"))


@query(f"SELECT id, {words_sql('body')}::BIGINT AS words, len(title)::BIGINT AS title_chars FROM articles")
def word_counts(t: Tables) -> DataFrame:
    return t.articles.select("id", text.word_count(F.col("body")).cast("long").alias("words"), F.length("title").cast("long").alias("title_chars"))


@query(f"SELECT id, md5({clean_sql('body')}) AS clean_hash FROM articles")
def clean_text(t: Tables) -> DataFrame:
    return t.articles.select("id", F.md5(text.clean_text(F.col("body"))).alias("clean_hash"))


@query(f"""SELECT id, md5(coalesce(title, '') || '. ' || array_to_string(list_filter(regexp_split_to_array({clean_sql("coalesce(body, '')")}, '{_W}+'), lambda w: w <> '')[1:200], ' ')) AS text_hash FROM articles""")
def embedding_text(t: Tables) -> DataFrame:
    return t.articles.select("id", F.md5(text.embedding_text(F.col("title"), F.col("body"))).alias("text_hash"))


@query("""SELECT id, CASE WHEN lower(trim(author)) IN ('', 'null', 'none', 'unknown', 'n/a') OR lower(trim(author)) LIKE 'http%' THEN NULL ELSE trim(author) END AS author FROM articles""")
def clean_authors(t: Tables) -> DataFrame:
    return t.articles.select("id", text.clean_author(F.col("author")).alias("author"))


@query("""SELECT incoming_id, epoch_us(coalesce(
        try_strptime(regexp_replace(regexp_replace(trim(published_at), '^[A-Za-z]+, *', ''), ' (GMT|UTC|UT|Z)$', ' +0000'), ['%d %b %Y %H:%M:%S %z', '%d %b %Y %H:%M %z']),
        CASE WHEN regexp_matches(trim(published_at), '(Z|[+-][0-9][0-9]:?[0-9][0-9])$') THEN TRY_CAST(published_at AS TIMESTAMPTZ) ELSE TRY_CAST(published_at AS TIMESTAMP) AT TIME ZONE 'UTC' END)) // 1000000 AS published FROM incoming_articles""")
def parsed_dates(t: Tables) -> DataFrame:
    """Times of arrivals in mail or ISO form, as seconds."""
    return t.incoming_articles.select("incoming_id", F.unix_timestamp(parse_time(F.col("published_at"))).alias("published"))


_RELEVANT = rf"""(regexp_matches(coalesce(title, '') || ' ' || regexp_replace(coalesce(url, ''), '[-_/]+', ' ', 'g'), '{validate.keyword_pattern()}')
    OR coalesce(len(regexp_extract_all(body, '{validate.keyword_pattern()}')), 0) >= 3)"""


@query(f"""SELECT id, CASE WHEN trim(coalesce(title, '')) = '' THEN 'missing_title' WHEN published_at IS NULL THEN 'missing_date' WHEN {words_sql('body')} < 100 THEN 'too_short'
    WHEN NOT {_RELEVANT} THEN 'off_topic' END AS reason FROM articles""")
def validate_reasons(t: Tables) -> DataFrame:
    """Why an article would be rejected; NULL if it wouldn't."""
    return t.articles.select("id", validate.reason(F.col("title"), F.col("published_at"), F.col("url"), F.col("body")).alias("reason"))


@query(f"SELECT id, {_RELEVANT} AS relevant FROM articles")
def relevance(t: Tables) -> DataFrame:
    return t.articles.select("id", validate.relevant(F.col("title"), F.col("url"), F.col("body")).alias("relevant"))


@query("SELECT incoming_id FROM incoming_articles i WHERE canonical_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM seen_articles s WHERE s.url = i.canonical_url)")
def unseen_arrivals(t: Tables) -> DataFrame:
    """Arrivals whose given address was never handled."""
    i = t.incoming_articles.where(F.col("canonical_url").isNotNull())
    return dedup.unseen(i.select("incoming_id", "canonical_url"), t.seen_articles.where(F.col("url").isNotNull())).select("incoming_id")


@query("SELECT doc_id, first_key FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_key FROM documents WHERE text IS NOT NULL) WHERE doc_id > first_key")
def exact_duplicates(t: Tables) -> DataFrame:
    """Documents whose text an earlier one has."""
    return dedup.exact_duplicates(t.documents.select("doc_id", F.sha2("text", 256).alias("h")), "doc_id", "h")


_ALL = """arrived AS (SELECT id AS k, simhash AS v, scraped_at AS t FROM articles WHERE simhash IS NOT NULL
    UNION ALL SELECT 1000000000 + incoming_id, simhash, CAST(scraped_at AS TIMESTAMPTZ) FROM incoming_articles WHERE simhash IS NOT NULL)"""
_NEAR = f"WITH {_ALL}, pairs AS (SELECT a.k AS a, b.k AS b, bit_count(xor(a.v, b.v))::INT AS d, a.t AS ta, b.t AS tb FROM arrived a JOIN arrived b ON a.k < b.k AND bit_count(xor(a.v, b.v)) <= 3)"


def _arrived(t: Tables) -> DataFrame:
    i = t.incoming_articles.select((F.col("incoming_id") + 1_000_000_000).alias("k"), F.col("simhash").alias("v"), F.col("scraped_at").cast("timestamp").alias("t"))
    return t.articles.select(F.col("id").alias("k"), F.col("simhash").alias("v"), F.col("scraped_at").alias("t")).unionByName(i)


@query(f"{_NEAR} SELECT a, b, d FROM pairs")
def near_dup_pairs(t: Tables) -> DataFrame:
    """Pairs of stored and arriving articles with SimHash values within three bits."""
    return dedup.near_pairs(_arrived(t), "k", "v")


@query(f"{_NEAR} SELECT a, b, d FROM pairs WHERE ta >= tb - INTERVAL 7 DAY AND ta <= tb")
def near_dup_window(t: Tables) -> DataFrame:
    """Of these, pairs with the earlier one collected in the seven days before the later."""
    times = _arrived(t).select("k", "t")
    p = dedup.near_pairs(_arrived(t), "k", "v").join(times.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(times.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
    return p.where(dedup.within_days(F.col("ta"), F.col("tb")) & (F.col("ta") <= F.col("tb"))).select("a", "b", "d")


@query()
def near_dup_resolved(t: Tables) -> DataFrame:
    """Rows that repeat a kept row of the seven days before them, in order of arrival; a greedy order that SQL doesn't have."""
    rows = _arrived(t)
    return dedup.keep_first(rows.select("k"), dedup.arrival_edges(rows))


@query(f"""WITH named AS (SELECT a.*, s.name FROM articles a LEFT JOIN (SELECT id AS source_id, name FROM sources) s USING (source_id))
    SELECT name AS source, count(*) AS articles, (count(*) - count(author)) AS no_author, round(100.0 * (count(*) - count(author)) / count(*), 1)::DOUBLE AS no_author_pct,
    count(*) - count(published_at) AS no_date, round(avg(word_count), 2) AS words_avg, min(word_count) AS words_min, max(word_count) AS words_max,
    count(*) - count(DISTINCT content_hash) AS duplicate_hashes, CAST(min({DAY}) AS VARCHAR) AS first_day, CAST(max({DAY}) AS VARCHAR) AS last_day FROM named a GROUP BY ALL""")
def word_stats_by_source(t: Tables) -> DataFrame:
    """Quality report per source; articles of no known source are a row of their own."""
    a = t.articles.join(t.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id", "left")
    n, d = F.count("*"), F.to_date(F.coalesce("published_at", "scraped_at"))
    missing = F.count_if(F.col("author").isNull())
    return a.groupBy("source").agg(
        n.alias("articles"), missing.alias("no_author"), F.round(100.0 * missing / n, 1).cast("double").alias("no_author_pct"), F.count_if(F.col("published_at").isNull()).alias("no_date"),
        F.round(F.avg("word_count"), 2).alias("words_avg"), F.min("word_count").alias("words_min"), F.max("word_count").alias("words_max"),
        (n - F.countDistinct("content_hash")).alias("duplicate_hashes"), F.min(d).cast("string").alias("first_day"), F.max(d).cast("string").alias("last_day"),
    )


@query("""SELECT CASE WHEN outcome LIKE 'duplicate_of:%' THEN 'duplicate_near' WHEN outcome IN ('missing_title', 'missing_date', 'too_short', 'not_t20', 'off_topic') THEN 'rejected_' || outcome ELSE outcome END AS outcome,
    count(*) AS n, count(content_hash) AS with_hash FROM (SELECT DISTINCT * FROM seen_articles) GROUP BY 1""")
def crawl_outcomes(t: Tables) -> DataFrame:
    """What became of every address handled."""
    o = F.col("outcome")
    kind = F.when(o.startswith("duplicate_of:"), "duplicate_near").when(o.isin("missing_title", "missing_date", "too_short", "not_t20", "off_topic"), F.concat(F.lit("rejected_"), o)).otherwise(o)
    return t.seen_articles.distinct().groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"), F.count("content_hash").alias("with_hash"))


@query("""WITH r AS (SELECT CAST(date_trunc('week', seen_at AT TIME ZONE 'UTC') AS DATE) AS week, outcome FROM seen_articles WHERE seen_at IS NOT NULL)
    SELECT CAST(week AS VARCHAR) AS week, count(*) AS found, count(*) FILTER (WHERE outcome = 'stored') AS inserted, count(*) FILTER (WHERE outcome LIKE 'duplicate%') AS duplicates,
    count(*) FILTER (WHERE outcome IS NULL OR (outcome <> 'stored' AND outcome NOT LIKE 'duplicate%')) AS skipped FROM r GROUP BY 1""")
def crawl_runs_rollup(t: Tables) -> DataFrame:
    """Found, inserted, duplicate and skipped addresses per week."""
    o = F.col("outcome")
    stored, dup = F.coalesce(o == "stored", F.lit(False)), F.coalesce(o.startswith("duplicate"), F.lit(False))
    s = t.seen_articles.where(F.col("seen_at").isNotNull()).withColumn("week", F.to_date(F.date_trunc("week", "seen_at")).cast("string"))
    return s.groupBy("week").agg(F.count("*").alias("found"), F.count_if(stored).alias("inserted"), F.count_if(dup).alias("duplicates"), F.count_if(~stored & ~dup).alias("skipped"))


def arrivals(t: Tables) -> DataFrame:
    """Arrivals with what ``dedup.outcomes`` asks for; ``now`` of an arrival is its own time of collection."""
    i = t.incoming_articles.select(
        "incoming_id", "title", "body", canonical_url(F.col("url")).alias("link"), canonical_url(F.col("canonical_url")).alias("alias"), parse_time(F.col("published_at")).alias("published"),
        F.col("scraped_at").cast("timestamp").alias("scraped"), F.coalesce("content_hash", text.content_hash(F.col("title"), F.col("body"))).alias("content"), F.coalesce("simhash", simhash64(F.col("body"))).alias("v"),
    )
    i = cut(i)
    seen = t.seen_articles.where(F.col("url").isNotNull()).select("url").distinct()
    by = lambda c, n: seen.select(F.col("url").alias(c), F.lit(True).alias(n))
    stored = t.articles.where(F.col("content_hash").isNotNull()).select(F.col("content_hash").alias("content"), F.lit(True).alias("stored")).distinct()
    no, reason = F.lit(False), validate.reason(F.col("title"), F.col("published"), F.col("link"), F.col("body"))
    twice = dedup.exact_duplicates(i, "incoming_id", "link").select("incoming_id", F.lit(True).alias("_twice"))
    j = i.join(twice, "incoming_id", "left").join(by("link", "_seen"), "link", "left").join(by("alias", "_alias"), "alias", "left").join(stored, "content", "left")
    flags = j.select(
        "incoming_id", "content", "v", "scraped", F.coalesce(F.col("published") < F.col("scraped") - F.expr("INTERVAL 7 DAYS"), no).alias("too_old"), F.coalesce("_seen", "_twice", no).alias("already_seen"),
        no.alias("robots_blocked"), no.alias("failed"), reason.alias("reason"), F.coalesce("_alias", no).alias("alias_seen"), F.coalesce("stored", no).alias("stored"),
    )
    flags = cut(flags)
    # what may be accepted: compared with stored articles and with earlier arrivals that may be, too
    passed = flags.where("not (too_old or already_seen or alias_seen) and reason is null")
    again = dedup.exact_duplicates(passed.select("incoming_id", "content"), "incoming_id", "content").select("incoming_id", F.lit(True).alias("again"))
    left = passed.where("not stored").join(again, "incoming_id", "left_anti")
    old = t.articles.where("simhash is not null").select((-F.col("id") - 1).alias("k"), F.col("simhash").alias("v"), F.col("scraped_at").alias("t"))
    rows = old.unionByName(left.select(F.col("incoming_id").alias("k"), "v", F.col("scraped").alias("t")))
    # stored articles are there already, so that none of them is judged
    near = dedup.keep_first(rows.select("k"), dedup.arrival_edges(rows).where("b >= 0")).select(F.col("k").alias("incoming_id"), F.lit(True).alias("duplicate_near"))
    exact = F.col("stored") | F.coalesce("again", no)
    return flags.join(again, "incoming_id", "left").join(near, "incoming_id", "left").select(
        "incoming_id", "too_old", "already_seen", "robots_blocked", "failed", "reason", "alias_seen", exact.alias("duplicate_exact"), F.coalesce("duplicate_near", no).alias("duplicate_near")
    )


@query()
def ingest_outcomes(t: Tables) -> DataFrame:
    """What a crawl would do with each arrival, the first check that applies; in the order of arrival, so there is no SQL."""
    return dedup.outcomes(arrivals(t)).select("incoming_id", "outcome")


@query("SELECT id, left(sha1(url), 16) || '.html' AS file FROM articles WHERE url IS NOT NULL")
def archive_names(t: Tables) -> DataFrame:
    return t.articles.where(F.col("url").isNotNull()).select("id", archive_name(F.col("url")).alias("file"))


@query("SELECT id FROM articles WHERE image_url IS NULL ORDER BY id DESC LIMIT 50")
def image_backfill(t: Tables) -> DataFrame:
    """The newest articles without a picture: what a backfill would fetch."""
    return t.articles.where(F.col("image_url").isNull()).orderBy(F.desc("id")).limit(50).select("id")


@query("""SELECT incoming_id FROM (SELECT incoming_id, row_number() OVER (PARTITION BY source ORDER BY scraped_at DESC NULLS LAST, url) AS rn FROM incoming_articles
    WHERE scraped_at IS NULL OR CAST(scraped_at AS TIMESTAMPTZ) >= TIMESTAMPTZ '2026-05-10 00:00:00+00' - INTERVAL 3 DAY) WHERE rn <= 5""")
def fresh_candidates(t: Tables) -> DataFrame:
    """The five newest candidates of each source, none older than three days."""
    c = t.incoming_articles.select("incoming_id", "source", F.col("url").alias("link"), F.col("scraped_at").cast("timestamp").alias("published"))
    return fresh(c, F.to_timestamp(F.lit("2026-05-10 00:00:00")), 3, 5).select("incoming_id")


def pages(t: Tables) -> DataFrame:
    """(url, html): a page around every document: a menu before its text, a paragraph per line, and a footer."""
    xml = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    lines = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda p: F.concat(F.lit("<p>"), xml(p), F.lit("</p>"))), "")
    head = F.concat(F.lit("<html><head><title>site</title><meta property='og:title' content=\""), xml(F.coalesce("title", F.lit(""))), F.lit("\"></head><body><nav><p>Home</p></nav><article>"))
    return t.documents.select(F.concat(F.lit("https://x.example/"), F.col("doc_id")).alias("url"), F.concat(head, lines, F.lit("</article><footer><p>Terms</p></footer></body></html>")).alias("html"))


@query()
def extract_pages(t: Tables) -> DataFrame:
    """Main text and title out of pages around all documents; what an HTML parser makes of signs has no SQL."""
    e = extract(pages(t)).where(F.col("body").isNotNull())
    return e.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("doc_id"), F.trim("title").alias("title"), F.md5("body").alias("body_hash"))


@query("""SELECT link, published, count(*) AS n FROM (SELECT trim(url) AS link, epoch_us(coalesce(
        try_strptime(regexp_replace(regexp_replace(trim(published_at), '^[A-Za-z]+, *', ''), ' (GMT|UTC|UT|Z)$', ' +0000'), ['%d %b %Y %H:%M:%S %z', '%d %b %Y %H:%M %z']),
        CASE WHEN regexp_matches(trim(published_at), '(Z|[+-][0-9][0-9]:?[0-9][0-9])$') THEN TRY_CAST(published_at AS TIMESTAMPTZ) ELSE TRY_CAST(published_at AS TIMESTAMP) AT TIME ZONE 'UTC' END)) // 1000000 AS published
    FROM incoming_articles WHERE trim(url) <> '') GROUP BY 1, 2""")
def rss_feed(t: Tables) -> DataFrame:
    """Items of feeds that are built around arrivals: links with their times."""
    xml = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = F.concat(F.lit("<rss><channel><item><title>x</title><link>"), xml(F.col("url")), F.lit("</link><pubDate>"), xml(F.coalesce("published_at", F.lit(""))), F.lit("</pubDate></item><item><title>no link</title></item></channel></rss>"))
    got = rss_items(t.incoming_articles.where(F.col("url").isNotNull()).select(item.alias("feed")))
    return got.groupBy("link", F.unix_timestamp("published").alias("published")).agg(F.count("*").alias("n"))


@query("SELECT trim(url) AS link, epoch_us(published_at) // 1000000 AS published FROM articles WHERE url LIKE '%/reports/%'")
def site_map(t: Tables) -> DataFrame:
    """Addresses of one section out of site maps that are built around articles."""
    last = F.coalesce(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))
    address = F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(F.lit("<urlset><url><loc>"), address, F.lit("</loc><lastmod>"), last, F.lit("</lastmod></url><url><loc>https://x.example/about</loc></url></urlset>"))
    got = map_urls(t.articles.where(F.col("url").isNotNull()).select(xml.alias("xml")), section="/reports/")
    return got.select("link", F.unix_timestamp("published").alias("published"))
