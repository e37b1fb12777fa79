"""Queries over the stages' tables: what waits, names of topics, views, runs, the map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import clustering, language, mood, stages
from tidemark.plans.analysis import _ENTS, _ents, _tags, usable_vectors
from tidemark.plans.base import DAY, MODEL, STOPS, Tables, day, query
from tidemark.session import Scratch, cut


@query("SELECT status, count(*) AS waiting FROM articles WHERE duplicate_of IS NULL GROUP BY ALL")
def queue_pending(t: Tables) -> DataFrame:
    """How many articles each status has, copies left out."""
    return stages.pending(t.articles)


@query("SELECT id, title FROM articles WHERE duplicate_of IS NULL AND status IN ('cleaned', 'nlp_done') AND id > 100 ORDER BY id LIMIT 64")
def queue_batch(t: Tables) -> DataFrame:
    """The next batch of a queue by status, behind the last id that was seen."""
    return stages.batch(t.articles, ["cleaned", "nlp_done"], 100, 64).select("id", "title")


# ---------------------------------------------------------------- the language stage


def _names(t: Tables) -> DataFrame:
    """A name list (alias, label, name): all team and tournament names of the corpus."""
    return _ents(t).select(F.col("name").alias("alias"), "label", "name").distinct()


def _stored(ents: DataFrame) -> DataFrame:
    """(article_id, entities): names as the language stage stores them."""
    return language.entity_map(ents).select(F.col("id").alias("article_id"), F.col("entities").cast("map<string,map<string,int>>").alias("entities"))


@query()
def nlp_table(t: Tables) -> DataFrame:
    """The language stage over all articles, whole texts: terms, mood, names and keywords in one table."""
    got = stages.analyze(t.articles, _names(t), list(STOPS), most_chars=None)
    return got.select("article_id", F.md5("lemmas").alias("lemmas_hash"), F.round(F.col("sentiment").cast("double"), 4).alias("sentiment"), F.to_json("entities").alias("entities"), "keywords")


@query(f"WITH {_ENTS} SELECT id, label, name, n FROM ents")
def nlp_names(t: Tables) -> DataFrame:
    """Names by the name list, stored as nested maps and read out of them again; the SQL searches by pattern."""
    texts = t.articles.select("id", F.col("body").alias("text"))
    return stages.entity_rows(_stored(stages.entities(texts, _names(t)))).select("id", "label", "name", "n")


_TAGGED = f"""WITH {_ENTS}, tags AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'PLACE' WHEN label = 'TEAM' THEN 'ORG' ELSE 'EVENT' END AS label, name FROM ents)
    SELECT name, label, count(DISTINCT id) AS articles FROM tags GROUP BY ALL"""


@query(_TAGGED)
def prior_votes(t: Tables) -> DataFrame:
    """Label votes of all stored articles, one of each, out of their nested maps."""
    return language.votes(stages.entity_rows(_stored(_tags(t))))


@query()
def moods(t: Tables) -> DataFrame:
    """The mood of every article by the rules for negations, boosters, capitals and marks; row by row, so there is no SQL."""
    return mood.sentiment(t.bodies, "id", "body", mood.SMALL)


@query(f"""WITH {_ENTS}, n AS (SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS token, name, count(*) AS articles FROM (SELECT DISTINCT id, label, name FROM ents) GROUP BY ALL)
    SELECT token, arg_min(name, {{'a': -articles, 'n': name}}) AS name FROM n GROUP BY token""")
def token_display_names(t: Tables) -> DataFrame:
    """What each folded name is shown as."""
    return stages.token_names(_stored(_ents(t)))


@query(f"""WITH {_ENTS}, member AS (SELECT DISTINCT ac.article_id AS id, ac.cluster_id FROM article_clusters ac SEMI JOIN (SELECT id FROM clusters WHERE model_id = {MODEL}) c ON c.id = ac.cluster_id),
    n AS (SELECT cluster_id, label, name, count(*) AS articles FROM member JOIN ents USING (id) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, label ORDER BY articles DESC, name) AS place FROM n)
    SELECT cluster_id::BIGINT AS cluster_id, label, string_agg(name, '|' ORDER BY place) AS names FROM r WHERE place <= 5 GROUP BY ALL""")
def topic_entities(t: Tables) -> DataFrame:
    """The five names that most articles of each topic hold, by label."""
    member = t.article_clusters.join(t.active_clusters.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi").where("article_id is not null")
    return stages.topic_entities(_stored(_ents(t)), member).select(F.col("cluster_id").cast("long").alias("cluster_id"), "label", F.array_join("names", "|").alias("names"))


# ---------------------------------------------------------------- views


def create_views(t: Tables, prefix: str = "") -> None:
    """Temporary views article_topics, topic_daily and pipeline_status, for SQL over the tables."""
    c = t.active_clusters.select(F.col("id").alias("cluster_id"), "model_id", "label")
    a = t.articles.select("id", "title", "url", "published_at", "scraped_at", "source_id").join(t.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id")
    mine = t.article_clusters.select(F.col("article_id").alias("id"), "cluster_id", "score").join(c, "cluster_id")
    both = a.join(mine, "id").drop("source_id")
    both.createOrReplaceTempView(f"{prefix}article_topics")
    both.groupBy("model_id", "cluster_id", "label", day().alias("day")).agg(F.count("*").alias("articles")).createOrReplaceTempView(f"{prefix}topic_daily")
    n = t.articles.agg(F.count("*").alias("articles_total"), *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in ("cleaned", "nlp_done", "vectorized", "clustered")], F.max("scraped_at").alias("last_article_at"))
    n.join(F.broadcast(t.model_id)).createOrReplaceTempView(f"{prefix}pipeline_status")


@query(f"""SELECT source, cluster_id::BIGINT AS cluster_id, count(*) AS articles FROM (SELECT id, source_id FROM articles) a JOIN (SELECT id AS source_id, name AS source FROM sources) s USING (source_id)
    JOIN article_clusters ac ON ac.article_id = a.id WHERE cluster_id IN (SELECT id FROM clusters WHERE model_id = {MODEL}) GROUP BY ALL""")
def view_article_topics(t: Tables) -> DataFrame:
    """Articles per source and topic, by SQL over the view."""
    create_views(t)
    return t.spark.sql("SELECT source, CAST(cluster_id AS BIGINT) AS cluster_id, count(*) AS articles FROM article_topics GROUP BY ALL")


@query(f"""WITH dated AS (SELECT a.id AS article_id, {DAY} AS day FROM articles a SEMI JOIN sources s ON s.id = a.source_id)
    SELECT CAST(day AS VARCHAR) AS day, cluster_id::BIGINT AS cluster_id, count(*) AS articles FROM dated JOIN article_clusters USING (article_id) WHERE cluster_id IN (SELECT id FROM clusters WHERE model_id = {MODEL}) GROUP BY ALL""")
def view_topic_daily(t: Tables) -> DataFrame:
    """Articles per day and topic, by SQL over the view."""
    create_views(t)
    return t.spark.sql("SELECT CAST(day AS STRING) AS day, CAST(cluster_id AS BIGINT) AS cluster_id, articles FROM topic_daily")


@query(f"""SELECT count(*) AS total, count_if(status = 'cleaned') AS cleaned, count_if(status = 'vectorized') AS vectorized, epoch_us(max(scraped_at)) // 1000000 AS last, {MODEL}::BIGINT AS model_id FROM articles""")
def view_pipeline_status(t: Tables) -> DataFrame:
    create_views(t)
    return t.spark.sql("SELECT articles_total AS total, status_cleaned AS cleaned, status_vectorized AS vectorized, unix_timestamp(last_article_at) AS last, CAST(model_id AS BIGINT) AS model_id FROM pipeline_status")


# ---------------------------------------------------------------- runs and the map


def _runs(t: Tables) -> DataFrame:
    """Runs of a crawl, one a day and site, out of the addresses handled."""
    s = t.seen_articles.where("seen_at is not null").withColumn("site", F.regexp_extract("url", "//([^/]+)", 1)).withColumn("started_at", F.date_trunc("day", "seen_at"))
    return s.groupBy("started_at", "site").agg(F.max("seen_at").alias("finished_at"), F.count("*").alias("found"), F.count_if(F.col("outcome") == "stored").alias("inserted"))


@query("SELECT epoch_us(date_trunc('day', seen_at)) // 1000000 AS started, count_if(outcome = 'stored') AS new FROM seen_articles WHERE seen_at IS NOT NULL GROUP BY ALL")
def run_totals(t: Tables) -> DataFrame:
    """Articles that each run added, over all its sites."""
    return stages.run_totals(_runs(t)).select(F.unix_timestamp("started_at").alias("started"), "new")


@query()
def projection_points(t: Tables) -> DataFrame:
    """The map: two axes for every article with a vector, with its title, source and topic; the axes' signs are free, so there is no SQL."""
    scratch = Scratch(t.spark, "map")
    points = scratch.put(clustering.project(scratch.put(usable_vectors(t))))
    a = t.articles.select("id", "title", "source_id").join(t.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id")
    return points.join(a, "id").join(t.assigned.select("id", "topic_id"), "id", "left").select("id", "title", "source", "method", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.col("topic_id").cast("long").alias("topic_id"))


@query(f"""WITH usable AS (SELECT article_id AS id, arg_max(embedding, row(created_at, embedding)) AS v FROM article_vectors GROUP BY 1),
    best AS (SELECT id FROM usable WHERE v IS NOT NULL AND len(v) = 384 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0)
    SELECT s.name AS source, count(*) AS points FROM best JOIN articles a USING (id) JOIN sources s ON s.id = a.source_id GROUP BY ALL""")
def map_coverage(t: Tables) -> DataFrame:
    """How many points of the map each source has."""
    a = t.articles.select("id", "source_id").join(t.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source")), "source_id")
    return cut(usable_vectors(t).select("id")).join(a, "id").groupBy("source").agg(F.count("*").alias("points"))
