"""Articles out of HTML pages."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import clean_author
from tidemark.functions.urls import https_only, join_url

SCHEMA = T.StructType([
    T.StructField("body", T.StringType()), T.StructField("heading", T.StringType()), T.StructField("canonical", T.StringType()),
    T.StructField("time", T.StringType()), T.StructField("metas", T.MapType(T.StringType(), T.StringType())), T.StructField("ld", T.ArrayType(T.StringType())),
])
_SKIP = {"script", "style", "nav", "footer", "aside", "header", "form", "noscript", "table", "template"}
_BLOCK = {"p", "h2", "h3", "li", "blockquote"}


class _Page(HTMLParser):
    """Collects metas (a property goes before a name), JSON-LD, the canonical link, the first time, and text blocks with where they stand."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.names: dict[str, str] = {}
        self.properties: dict[str, str] = {}
        self.ld: list[str] = []
        self.title = self.canonical = self.time = None
        self.blocks: list[tuple[bool, str]] = []
        self._skip = self._main = 0
        self._text: list[str] | None = None
        self._into = ""

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            value = a.get("content", "").strip()
            if value and a.get("property"):
                self.properties.setdefault(a["property"].lower(), value)
            elif value and (a.get("name") or a.get("itemprop")):
                self.names.setdefault((a.get("name") or a["itemprop"]).lower(), value)
        elif tag == "link" and a.get("rel", "").lower() == "canonical":
            self.canonical = self.canonical or a.get("href")
        elif tag == "time" and a.get("datetime"):
            self.time = self.time or a["datetime"]
        elif tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self._into, self._text = "ld", []
        elif tag == "title" and self.title is None:
            self._into, self._text = "title", []
        if tag in _SKIP:
            self._skip += 1
        elif tag in ("article", "main"):
            self._main += 1
        elif tag in _BLOCK and not self._skip:
            self._end()
            self._into, self._text = "block", []

    def handle_endtag(self, tag):
        if tag in ("script", "title") or tag in _BLOCK:
            self._end()
        if tag in _SKIP:
            self._skip = max(0, self._skip - 1)
        elif tag in ("article", "main"):
            self._main = max(0, self._main - 1)

    def handle_data(self, data):
        if self._text is not None:
            self._text.append(data)

    def _end(self):
        if self._text is None:
            return
        text = "".join(self._text)
        if self._into == "ld":
            self.ld.append(text)
        elif self._into == "title":
            self.title = " ".join(text.split())
        elif words := " ".join(text.split()):
            self.blocks.append((self._main > 0, words))
        self._text = None


def json_objects(texts: list[str]) -> list[dict]:
    """All objects of JSON-LD texts, those in lists and graphs too, outer ones first."""
    out: list[dict] = []
    todo: list = []
    for t in texts:
        try:
            todo.append(json.loads(t))
        except ValueError:
            continue
    while todo:
        x = todo.pop(0)
        if isinstance(x, list):
            todo += x
        elif isinstance(x, dict):
            out.append(x)
            todo.append(x.get("@graph", []))
    return out


def parse_page(html: str | None) -> dict | None:
    """The raw parts of a page; NULL if it has no text."""
    if not html:
        return None
    page = _Page()
    page.feed(html)
    page.close()
    page._end()
    inside = [t for main, t in page.blocks if main] or [t for _, t in page.blocks]
    if not inside:
        return None
    return {"body": "\n".join(inside), "heading": page.title, "canonical": page.canonical, "time": page.time, "metas": page.names | page.properties, "ld": [json.dumps(o) for o in json_objects(page.ld)]}


@F.pandas_udf(SCHEMA)
def _parsed(html: pd.Series) -> pd.DataFrame:
    empty = dict.fromkeys(SCHEMA.names)
    return pd.DataFrame([parse_page(h) or empty for h in html], columns=SCHEMA.names)


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, canonical_url, title, author, published_at, body, image_url): one row per page, body NULL where there is no text."""
    p = pages.select(F.col(url).alias("url"), _parsed(F.col(html)).alias("p"))
    meta = lambda *names: F.coalesce(*[F.nullif(F.trim(F.element_at("p.metas", F.lit(n))), F.lit("")) for n in names])
    first = lambda path: F.get(F.filter(F.transform("p.ld", lambda o: F.get_json_object(o, path)), lambda v: v.isNotNull()), F.lit(0))
    author = F.coalesce(
        clean_author(meta("author", "article:author")), clean_author(first("$.author.name")), clean_author(first("$.author[0].name")), clean_author(first("$.author"))
    )
    stamp = F.regexp_replace(F.coalesce(meta("article:published_time", "og:published_time", "datepublished"), first("$.datePublished"), F.col("p.time")), "Z$", "+00:00")
    return p.select(
        "url",
        F.coalesce(join_url(F.col("url"), F.col("p.canonical")), F.col("url")).alias("canonical_url"),
        F.coalesce(meta("og:title", "twitter:title"), F.col("p.heading")).alias("title"),
        author.alias("author"),
        stamp.try_cast("timestamp").alias("published_at"),
        F.col("p.body").alias("body"),
        https_only(join_url(F.col("url"), meta("og:image", "og:image:url", "twitter:image"))).alias("image_url"),
    )


def robots_allows(text: str | None, status: int | None, url: str, agent: str = "*") -> bool:
    """Whether a robots file lets an address be read: denied or failing hosts deny all, a missing file allows all."""
    from urllib.robotparser import RobotFileParser

    if status is None or status in (401, 403) or status >= 500:
        return False
    if status != 200:
        return True
    rules = RobotFileParser()
    rules.parse((text or "").splitlines())
    return rules.can_fetch(agent, url)


def archive_name(url: Column) -> Column:
    """File name of a page's raw copy."""
    return F.concat(F.substring(F.sha1(url), 1, 16), F.lit(".html"))



def archive(pages: DataFrame, path: str, url: str = "url", html: str = "html") -> None:
    """Raw pages added to a folder of parquet files, each with the name that its address gives it."""
    pages.select(archive_name(F.col(url)).alias("file"), F.col(url).alias("url"), F.col(html).alias("html")).write.mode("append").parquet(path)


def with_images(articles: DataFrame, pages: DataFrame) -> DataFrame:
    """Articles without a picture get the one that their fetched page (url, html) names; others stay as they are."""
    found = extract(pages).where(F.col("image_url").isNotNull()).groupBy("url").agg(F.min("image_url").alias("_image"))
    return articles.join(found, "url", "left").withColumn("image_url", F.coalesce("image_url", "_image")).select(*articles.columns)
