"""A topic model's life: fitted on a window, applied to what comes, fitted again when it has drifted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import normalised
from tidemark.operators import clustering, merge, topics
from tidemark.session import Scratch, checked, cut

LEAST = 10


@dataclass
class Fit:
    """clusters: (id, model_id, label, terms, coherence_npmi, centroid, size, stable_key); assignments: (article_id, cluster_id, score)."""

    algorithm: str
    threshold: float
    silhouette: float
    n_articles: int
    clusters: DataFrame
    assignments: DataFrame


def fit(window: DataFrame, terms: DataFrame, old: DataFrame, model_id: int, first_id: int = 1, algorithm: str = "density") -> Fit | None:
    """Topics of a window of (id, v) with their (id, term, n); None if it has fewer than ten records.

    Density clustering of windows of up to DENSITY_MOST records; a K-Means sweep where the
    ``algorithm`` is "kmeans", where the window is larger (the fit then says so), or where
    density finds fewer than two topics. ``old`` holds clusters of all earlier models (id, model_id,
    centroid, stable_key): topics whose centroid matches the latest one of a stable key keep
    that key, others get a new one. Clusters are numbered from ``first_id``, the largest first.
    """
    # as they come: unit vectors as doubles take several times the room
    rows = Scratch(window.sparkSession, "window").put(window.select("id", "v"))
    n = rows.count()
    if n < LEAST:
        return None
    asked, algorithm, found = algorithm, "density", None
    if asked == "density" and n <= clustering.DENSITY_MOST:
        found = cut(clustering.density_topics(rows.withColumn("g", F.lit(0)), "g").select("id", "topic"))
    if found is None or found.where("topic >= 0").select("topic").distinct().count() < 2:
        algorithm = "kmeans"
        found = cut(clustering.kmeans_sweep(rows, [k for k in range(2, min(30, max(2, n // 3)) + 1) if k < n])[0])
    topic_of = checked(found)
    members = rows.join(topic_of, "id").select("id", "topic", normalised(F.col("v")).alias("v"))
    cents = cut(topics.centroids(members))
    threshold = topics.assign_threshold(topics.leave_one_out(members)).first()["threshold"]
    quality = topics.silhouette(members).agg(F.avg("s").alias("s")).first()["s"] or 0.0
    # one row per topic from here on
    order = sorted(((r["n"], -r["topic"]) for r in cents.select("topic", "n").collect()), reverse=True)
    number = {-t: first_id + i for i, (_, t) in enumerate(order)}
    doc_terms = terms.join(topic_of, "id", "left").select("id", F.coalesce("topic", F.lit(-1)).alias("topic"), "term", "n")
    top = cut(topics.ctfidf(doc_terms))
    coherence = topics.npmi(doc_terms, top, n)
    named = topics.labels(top)
    listed = top.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("terms"))
    latest = merge.first_per(old.where("stable_key is not null and centroid is not null"), ["stable_key"], [F.desc("model_id"), F.asc("id")])
    found_keys = topics.matched_keys(cents.select("topic", "centroid"), latest.select(F.col("stable_key").alias("key"), "centroid"))
    keys = {r["topic"]: r["key"] for r in found_keys.collect()}
    numbers = rows.sparkSession.createDataFrame([(t, i, keys.get(t)) for t, i in number.items()], "topic long, id int, kept string")
    fresh = F.substring(F.sha2(F.concat_ws("/", F.lit(str(model_id)), F.col("id").cast("string")), 256), 1, 10)
    clusters = (
        cents.join(numbers, "topic")
        .join(named, "topic", "left")
        .join(listed, "topic", "left")
        .join(coherence.withColumnRenamed("npmi", "coherence_npmi"), "topic", "left")
        .select("id", F.lit(model_id).alias("model_id"), "label", "terms", "coherence_npmi", F.col("centroid").cast("array<float>").alias("centroid"), F.col("n").cast("int").alias("size"), F.coalesce("kept", fresh).alias("stable_key"))
    )
    scores = topics.member_scores(members, cents).join(numbers.select("topic", F.col("id").alias("cluster_id")), "topic")
    return Fit(algorithm, threshold, quality, n, cut(clusters), cut(scores.select(F.col("id").alias("article_id"), "cluster_id", "score")))


def assign(rows: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """(id, cluster_id, score) of (id, v): the nearest topic, NULL where none is near enough (emerging)."""
    near = topics.nearest(rows.select("id", normalised(F.col("v")).alias("v")), clusters.select(F.col("id").alias("topic"), normalised(F.col("centroid")).alias("centroid")))
    close = F.col("sim") >= threshold
    out = rows.select("id").join(near, "id", "left")
    return out.select("id", F.when(close, F.col("topic")).cast("int").alias("cluster_id"), F.when(close, F.round("sim", 4)).alias("score"))
