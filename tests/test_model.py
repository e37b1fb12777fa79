import datetime as dt
import random

from pyspark.sql import functions as F
from test_operators import blobs

from tidemark.functions.text import ago
from tidemark.operators import embedding, language, model, topics
from tidemark.sources import store

OLD = "id int, model_id int, centroid array<float>, stable_key string"


def corpus(spark, x, truth, first=0):
    rng = random.Random(1)
    vocabulary = [[f"{c}{k}" for k in range(12)] for c in ("bat", "rain", "toss", "bid")]
    rows = [(first + i, [float(v) for v in r]) for i, r in enumerate(x)]
    terms = [(first + i, w, 1) for i, t in enumerate(truth) for w in rng.sample(vocabulary[t], 8)]
    return spark.createDataFrame(rows, "id long, v array<double>"), spark.createDataFrame(terms, "id long, term string, n long")


def test_life_of_a_model(spark):
    x, truth = blobs(4, 6, 3)
    rows, terms = corpus(spark, x, truth)
    early, none = rows.where("id < 18"), spark.createDataFrame([], OLD)
    one = model.fit(early, terms.where("id < 18"), none, 1)
    c = one.clusters.collect()
    assert len(c) == 3 and one.algorithm == "density" and {r.size for r in c} == {6} and one.assignments.count() == 18 and one.threshold >= topics.ASSIGN_FLOOR
    assert all(r.label.count("·") == 2 and len(r.terms) == 10 and -1 <= r.coherence_npmi <= 1 and len(r.stable_key) == 10 for r in c) and one.silhouette > 0.5
    # one near record is assigned, one odd record is not
    near, odd = (x[0] + 0.01).tolist(), (-x[:18].sum(0)).tolist()
    new = spark.createDataFrame([(100, near), (101, odd)], "id long, v array<double>")
    got = {r.id: r for r in model.assign(new, one.clusters, one.threshold).collect()}
    home = {r.article_id: r.cluster_id for r in one.assignments.collect()}
    assert got[100].cluster_id == home[0] and got[100].score > 0.8 and got[101].cluster_id is None
    # a new topic: fitted again, three keys carried over
    two = model.fit(rows, terms, one.clusters.select("id", "model_id", "centroid", "stable_key"), 2, 10)
    keys, before = {r.stable_key for r in two.clusters.collect()}, {r.stable_key for r in c}
    assert len(keys) == 4 and before < keys and {r.id for r in two.clusters.collect()} == {10, 11, 12, 13}
    assert model.fit(rows.limit(9), terms, none, 3) is None


def test_model_without_clusters_leaves_all_emerging(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    empty = spark.createDataFrame([], "id int, centroid array<float>")
    assert [(r.id, r.cluster_id) for r in model.assign(rows, empty, 0.3).collect()] == [(1, None)]


def test_hashed_embeddings(spark):
    df = spark.createDataFrame([(1, "Big win", "the bowlers took wickets"), (2, "Big win", "the bowlers took wickets"), (3, None, None), (4, "Rain", "no play today")], "k long, t string, b string")
    got = {r.id: r.embedding for r in embedding.hashed_embeddings(df, "k", "t", "b").collect()}
    assert all(len(v) == 384 for v in got.values()) and got[1] == got[2] and abs(sum(x * x for x in got[4]) - 1) < 1e-5 and not any(got[3])
    assert embedding.hashed_embeddings(df.limit(0), "k", "t", "b").count() == 0


def test_tagger_names(spark):
    e = spark.createDataFrame([(1, "GPE", "Oslo", 1), (1, "FAC", "Eden Gardens", 2), (1, "FAC", "Gold Cup", 1), (1, "ORG", "Follow Us", 1), (1, "ORG", "A1 Team", 1), (1, "DATE", "May", 1), (1, "ORG", "Stop Me", 1)], "id long, label string, name string, n long")
    assert {(r.label, r.name) for r in language.tagged(e, ["stop me"]).collect()} == {("PLACE", "Oslo"), ("VENUE", "Eden Gardens")}


def test_runs_and_ages(spark):
    t = [dt.datetime(2026, 1, d) for d in (1, 2, 3)]
    runs = spark.createDataFrame(
        [(i, s, t[d], t[d], 1, n, 0, 0, 0, {"failed": "x"} if d == 2 else {}) for i, (s, d, n) in enumerate([(1, 0, 5), (2, 0, 1), (1, 1, 2), (1, 2, 0)])], store.SCHEMAS["crawl_runs"])
    got = store.recent_runs(runs, 2).collect()
    assert [r.started_at for r in got] == t[1:] and got[0].new == {1: 2}
    assert store.last_good_crawl(runs).first().last_crawl == t[1]
    df = spark.createDataFrame([(5,), (125,), (7300,), (200000,)], "s long")
    now = F.lit("2026-01-10").cast("timestamp")
    words = [r[0] for r in df.select(ago((F.unix_timestamp(now) - F.col("s")).cast("timestamp"), now)).collect()]
    assert words == ["just now", "2 min ago", "2 h ago", "2 days ago"]
