"""Queries that keep the tables: upserts, caps, transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import merge
from tidemark.plans.base import MODEL, Tables, query

_NEW_SEEN = """arrivals AS (SELECT canonical_url AS url, 'stored' AS outcome, CASE WHEN incoming_id % 2 = 0 THEN content_hash END AS content_hash, CAST(scraped_at AS TIMESTAMPTZ) AS seen_at FROM (
    SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY incoming_id DESC) AS rn FROM incoming_articles WHERE canonical_url IS NOT NULL) WHERE rn = 1),
    old AS (SELECT url, outcome, content_hash, seen_at FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seen_at DESC NULLS LAST, outcome, content_hash NULLS LAST) AS rn FROM seen_articles WHERE url IS NOT NULL) WHERE rn = 1)"""


def _seen(t: Tables) -> DataFrame:
    """The seen-memory with one row per address, the latest."""
    order = [F.desc_nulls_last("seen_at"), F.asc_nulls_first("outcome"), F.asc_nulls_last("content_hash")]
    return merge.first_per(t.seen_articles.where(F.col("url").isNotNull()), ["url"], order)


def _arrivals(t: Tables) -> DataFrame:
    i = merge.first_per(t.incoming_articles.where(F.col("canonical_url").isNotNull()), ["canonical_url"], [F.desc("incoming_id")])
    return i.select(F.col("canonical_url").alias("url"), F.lit("stored").alias("outcome"), F.when(F.col("incoming_id") % 2 == 0, F.col("content_hash")).alias("content_hash"), F.col("scraped_at").cast("timestamp").alias("seen_at"))


@query(f"""WITH {_NEW_SEEN} SELECT coalesce(n.url, o.url) AS url, CASE WHEN n.url IS NOT NULL THEN n.outcome ELSE o.outcome END AS outcome, coalesce(n.content_hash, o.content_hash) AS content_hash,
    epoch_us(CASE WHEN n.url IS NOT NULL THEN n.seen_at ELSE o.seen_at END) // 1000000 AS seen_at FROM arrivals n FULL OUTER JOIN old o ON n.url = o.url""")
def upsert_seen(t: Tables) -> DataFrame:
    """Arrivals written to the seen-memory; an old hash stays where a new one is missing."""
    return merge.upsert(_seen(t), _arrivals(t), ["url"], {"content_hash": merge.keep_old_if_null}).withColumn("seen_at", F.unix_timestamp("seen_at"))


@query(f"""WITH {_NEW_SEEN} SELECT url, outcome, content_hash, epoch_us(seen_at) // 1000000 AS seen_at FROM old UNION ALL
    SELECT url, outcome, content_hash, epoch_us(seen_at) // 1000000 FROM arrivals WHERE url NOT IN (SELECT url FROM old)""")
def insert_if_absent(t: Tables) -> DataFrame:
    return merge.insert_if_absent(_seen(t), _arrivals(t), ["url"]).withColumn("seen_at", F.unix_timestamp("seen_at"))


@query("""SELECT coalesce(s.id, 1000) AS id, coalesce(s.name, n.name) AS name, CASE WHEN n.name IS NOT NULL AND n.base_url <> '' THEN n.base_url ELSE s.base_url END AS base_url
    FROM sources s FULL OUTER JOIN (SELECT name, CASE WHEN id % 3 = 0 THEN '' ELSE 'https://new.example/' || name END AS base_url FROM sources WHERE id % 2 = 1 UNION ALL SELECT 'brandnew', 'https://brandnew.example') n ON n.name = s.name""")
def upsert_sources(t: Tables) -> DataFrame:
    """Sources written again by name; an address that is blank doesn't replace one."""
    s = t.sources.select("id", "name", "base_url")
    n = s.where("id % 2 = 1").select(F.lit(None).cast("int").alias("id"), "name", F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("https://new.example/"), "name")).alias("base_url"))
    n = n.unionByName(t.spark.createDataFrame([(None, "brandnew", "https://brandnew.example")], "id int, name string, base_url string"))
    out = merge.upsert(s, n, ["name"], {"id": lambda o, _: o, "base_url": merge.keep_old_if_blank})
    return out.select(F.coalesce("id", F.lit(1000)).alias("id"), "name", "base_url")


@query("SELECT id FROM articles ORDER BY id DESC LIMIT (SELECT count(*) * 3 // 10 FROM articles)")
def rolling_cap(t: Tables) -> DataFrame:
    """Articles that a cap on their number leaves: the newest by id."""
    return merge.newest(t.articles.select("id"), t.articles.count() * 3 // 10)


@query("""SELECT url FROM (SELECT url, max(seen_at) AS seen_at FROM seen_articles WHERE url IS NOT NULL GROUP BY 1) ORDER BY seen_at DESC NULLS LAST, url LIMIT 500""")
def seen_cap(t: Tables) -> DataFrame:
    """Addresses that a cap on the seen-memory leaves: those seen last."""
    s = t.seen_articles.where(F.col("url").isNotNull()).groupBy("url").agg(F.max("seen_at").alias("seen_at"))
    return merge.most_recent(s, 500).select("url")


@query("""WITH kept AS (SELECT id FROM articles WHERE id > (SELECT max(id) // 2 FROM articles)) SELECT cluster_id::BIGINT AS cluster_id, count(*) AS assignments FROM article_clusters WHERE article_id IN (SELECT id FROM kept) GROUP BY 1""")
def cascade_delete(t: Tables) -> DataFrame:
    """Assignments left when the older half of the articles is deleted."""
    half = t.articles.agg((F.max("id") / 2).cast("long").alias("m"))
    kept = t.articles.join(F.broadcast(half), F.col("id") > F.col("m")).select("id")
    return merge.cascade(t.article_clusters, kept, "article_id").groupBy(F.col("cluster_id").cast("long").alias("cluster_id")).agg(F.count("*").alias("assignments"))


@query("SELECT id, CASE WHEN status = 'vectorized' AND id % 2 = 0 THEN 'clustered' ELSE status END AS status FROM articles")
def advance_status(t: Tables) -> DataFrame:
    """Compare-and-set of the status of some articles."""
    return merge.advance(t.articles.select("id", "status"), t.articles.where("id % 2 = 0").select("id"), "vectorized", "clustered")


@query("SELECT id, id = 3 AS is_active FROM cluster_models")
def activate_model(t: Tables) -> DataFrame:
    return merge.activate(t.cluster_models, 3).select("id", "is_active")


@query("""SELECT c.model_id, count(*) AS assignments FROM article_clusters ac JOIN clusters c ON c.id = ac.cluster_id WHERE c.model_id IN (SELECT id FROM cluster_models ORDER BY id DESC LIMIT 3) GROUP BY 1""")
def keep_newest_models(t: Tables) -> DataFrame:
    """Assignments that stay when only the three newest models' are kept."""
    kept = merge.keep_models(t.article_clusters, t.clusters, t.cluster_models)
    return kept.join(t.clusters.select(F.col("id").alias("cluster_id"), "model_id"), "cluster_id").groupBy("model_id").agg(F.count("*").alias("assignments"))


@query("SELECT c.id, count(ac.cluster_id)::INT AS size FROM clusters c LEFT JOIN article_clusters ac ON ac.cluster_id = c.id GROUP BY 1")
def cluster_sizes(t: Tables) -> DataFrame:
    return merge.with_sizes(t.clusters, t.article_clusters).select("id", "size")


@query("""SELECT article_id, model, epoch_us(created_at) // 1000000 AS created_at FROM (SELECT article_id, model, created_at, row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC NULLS LAST, model) AS rn FROM article_vectors) WHERE rn = 1""")
def latest_vectors(t: Tables) -> DataFrame:
    """The last write per article wins; the vectors themselves aren't moved to find it."""
    v = merge.first_per(t.article_vectors.select("article_id", "model", "created_at"), ["article_id"], [F.desc_nulls_last("created_at"), F.asc("model")])
    return v.withColumn("created_at", F.unix_timestamp("created_at"))


@query("SELECT count(*) AS vectors, min(model) AS model FROM article_vectors")
def vector_count(t: Tables) -> DataFrame:
    return t.article_vectors.agg(F.count("*").alias("vectors"), F.min("model").alias("model"))


@query(f"SELECT id::BIGINT AS id, algorithm, n_clusters::BIGINT AS n_clusters, json_extract_string(params, '$.assign_threshold')::DOUBLE AS assign_threshold, json_extract_string(params, '$.metrics.unassigned')::BIGINT AS unassigned FROM cluster_models WHERE id = {MODEL}")
def active_model(t: Tables) -> DataFrame:
    """The active model with values out of its JSON parameters."""
    m = t.cluster_models.join(F.broadcast(t.model_id), F.col("id") == F.col("model_id"))
    j = lambda path, kind: F.get_json_object("params", path).cast(kind)
    return m.select(F.col("id").cast("long").alias("id"), "algorithm", F.col("n_clusters").cast("long").alias("n_clusters"), j("$.assign_threshold", "double").alias("assign_threshold"), j("$.metrics.unassigned", "long").alias("unassigned"))
