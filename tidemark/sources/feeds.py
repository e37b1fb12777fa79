"""Feeds and site maps as tables: a column of XML texts in, candidate addresses out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.urls import canonical_url


def parse_time(c: Column) -> Column:
    """A time in mail or ISO form; a time without a zone is UTC, anything else NULL."""
    mail = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},\s*", "")
    zoned = F.regexp_replace(mail, r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    iso = F.regexp_replace(F.trim(c), r"Z$", "+00:00")
    return F.coalesce(
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm Z")),
        iso.try_cast("timestamp"),
    )


def rss_items(feeds: DataFrame, xml: str = "feed", keep: tuple[str, ...] = ()) -> DataFrame:
    """(link, published) of the items that have a link, newest first, undated ones last."""
    items = feeds.select(*keep, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<item[ >](.*?)</item>"), F.lit(1))).alias("pos", "item"))
    return (
        items.select(*keep, _element("item", "link").alias("link"), parse_time(_element("item", "pubDate")).alias("published"))
        .where("link is not null and link <> ''")
        .orderBy(F.desc_nulls_last("published"), "link")
    )


def _element(item: str, name: str) -> Column:
    raw = F.nullif(F.regexp_extract(F.col(item), rf"(?s)<{name}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1), F.lit(""))
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(a), F.lit(b))
    return F.trim(raw)


def newest_map(index: DataFrame, xml: str = "xml", pattern: str = r"/post/(\d+)\.xml") -> DataFrame:
    """(loc): of a site map index the map with the lowest number, which holds the newest posts."""
    loc = index.select(F.explode(F.expr(f"xpath(`{xml}`, \"//*[local-name()='loc']/text()\")")).alias("loc"))
    n = F.nullif(F.regexp_extract("loc", pattern, 1), F.lit("")).cast("int")
    return loc.where(n.isNotNull()).agg(F.min_by("loc", n).alias("loc"))


def map_urls(maps: DataFrame, xml: str = "xml", section: str = "/cricket-news/") -> DataFrame:
    """(link, published) of a site map's addresses in one section, newest first."""
    urls = maps.select(F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))).alias("url"))
    return (
        urls.select(_element("url", "loc").alias("link"), parse_time(_element("url", "lastmod")).alias("published"))
        .where(F.contains("link", F.lit(section)))
        .orderBy(F.desc_nulls_last("published"), "link")
    )


def fresh(candidates: DataFrame, as_of: Column, days: int, limit: int | None = None, source: str = "source") -> DataFrame:
    """Candidates not older than so many days (undated ones pass), with canonical address, the first ``limit`` per source."""
    from pyspark.sql import Window

    kept = candidates.where(~F.coalesce(F.col("published") < as_of - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))).withColumn("canonical_url", canonical_url(F.col("link")))
    if limit is None:
        return kept
    w = Window.partitionBy(source).orderBy(F.desc_nulls_last("published"), "link")
    return kept.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


@dataclass(frozen=True)
class Source:
    """A site: its name, and how its feed tables become candidates."""

    name: str
    discover: Callable[[DataFrame], DataFrame]


REGISTRY: dict[str, Source] = {}


def register(source: Source) -> Source:
    REGISTRY[source.name] = source
    return source


def get_source(name: str) -> Source:
    if name not in REGISTRY:
        raise KeyError(f"no source {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name]


register(Source("rss", rss_items))
register(Source("sitemap", map_urls))
