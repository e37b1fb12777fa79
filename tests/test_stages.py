"""The stored stages: language, vectors, topics, map, over a store."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import mood, stages
from tidemark.sources import store as stores

TERMS = {"TOURNAMENT": {"Big League": ["BL", "Big League"]}, "NATIONAL_TEAMS": {"Freedonia": ["Freedonia", "FRE"]}, "note": "x"}
NOW = dt.datetime(2026, 4, 1, tzinfo=dt.timezone.utc)
ARTICLE = stores.SCHEMAS["articles"]


def article(i, title, body, status="cleaned", days=1, duplicate=None):
    t = NOW - dt.timedelta(days=days)
    return (i, 1, f"https://a.example/{i}", f"https://a.example/{i}", title, None, t, t, body, None, str(i), None, duplicate, status, None)


def test_name_list_has_the_women_s_teams(spark):
    got = {tuple(r) for r in stages.gazetteer(spark, TERMS).collect()}
    assert {("BL", "TOURNAMENT", "Big League"), ("FRE", "TEAM", "Freedonia"), ("FRE-W", "TEAM", "Freedonia Women"), ("FRE W", "TEAM", "Freedonia Women"), ("Freedonia Women", "TEAM", "Freedonia Women")} <= got and len(got) == 10


def test_mood_rules():
    words = {"good": 2.0, "bad": -2.0}
    r = lambda s: mood.rate(s, words)
    assert r("it was good") > 0 > r("it was not good") and r("it was very good") > r("it was good") > r("it was slightly good")
    assert r("it was good!") > r("it was good") and r("it was GOOD") > r("it was good") and r("GOOD") == r("good")
    assert r("good but bad") < 0 < r("bad but good") and r("nothing here") != r("a good thing") and r("") == 0
    assert abs(r("it was good") - 2 / (4 + 15) ** 0.5) < 1e-12
    assert mood.mean_rate(None, words) == mood.mean_rate("too short", words) == 0.0
    assert mood.mean_rate("It was good. It was bad.\nfine", words) == 0.0


def test_lexicon_of_a_file(spark, tmp_path):
    (tmp_path / "words.txt").write_text("Good\t1.9\t0.5\nbad\t-2.5\nodd line\n")
    assert mood.read_lexicon(spark, str(tmp_path / "words.txt")) == {"good": 1.9, "bad": -2.5}


def test_analysis_of_articles(spark):
    rows = [(1, "BL day", "FRE-W won well. Freedonia Women were the best of the Big League. " + "See https://x.example now."), (2, None, None), (3, "", "")]
    found = spark.createDataFrame([(1, "PERSON", "Ann Lee", 1), (1, "ORG", "Lee", 2), (1, "FAC", "Some Trophy", 1)], "id long, label string, name string, n long")
    got = {r.article_id: r for r in stages.analyze(spark.createDataFrame(rows, "id long, title string, body string"), stages.gazetteer(spark, TERMS), ["the", "were"], found=found).collect()}
    assert set(got) == {1, 2, 3} and got[2].lemmas == "" and got[2].entities is None and got[2].sentiment == 0.0 and got[3].keywords == []
    e = got[1].entities
    assert e["TEAM"] == {"Freedonia Women": 2} and e["TOURNAMENT"] == {"Big League": 2} and "VENUE" not in e and e["PERSON"]["Ann Lee"] >= 1
    assert "freedonia_women" in got[1].lemmas.split() and "big_league" in got[1].lemmas.split() and "the" not in got[1].lemmas.split() and got[1].sentiment > 0


def test_votes_of_stored_articles_count(spark):
    schema = "article_id long, lemmas string, sentiment float, entities map<string,map<string,int>>, keywords array<string>"
    stored = spark.createDataFrame([(1, "", 0.0, {"PERSON": {"Lee": 1}}, []), (2, "", 0.0, {"PERSON": {"Lee": 4}}, []), (9, "", 0.0, {"ORG": {"Lee": 9}}, [])], schema)
    new = spark.createDataFrame([(9, "", 0.0, {"ORG": {"Lee": 3}, "TEAM": {"X": 1}}, []), (10, "", 0.0, None, [])], schema)
    got = {r.article_id: r.entities for r in stages.harmonised(new, stored).collect()}
    assert got == {9: {"PERSON": {"Lee": 3}, "TEAM": {"X": 1}}, 10: None}


def test_batches_go_by_key(spark):
    rows = [article(i, "t", "b", "cleaned" if i % 3 else "nlp_done") for i in range(10)] + [article(20, "t", "b", duplicate=1)]
    df = spark.createDataFrame(rows, ARTICLE)
    assert [[r.id for r in b.orderBy("id").collect()] for b in stages.batches(df, ["cleaned"], 4)] == [[1, 2, 4, 5], [7, 8]]
    assert {r.status: r.waiting for r in stages.pending(df).collect()} == {"cleaned": 6, "nlp_done": 4}


@pytest.mark.parametrize("kind", ["folder", "database"])
def test_stores(spark, tmp_path, kind):
    s = stores.make_store(kind, spark, str(tmp_path) if kind == "folder" else "store_test")
    run = lambda i, n: spark.createDataFrame([(i, 1, NOW, NOW, 1, n, 0, 0, 0, None)], stores.SCHEMAS["crawl_runs"])
    assert s.read("crawl_runs").count() == 0
    stores.log_run(s, run(1, 5))
    stores.log_run(s, run(2, 7))
    assert {r.id for r in s.read("crawl_runs").collect()} == {1, 2} and stages.run_totals(s.read("crawl_runs")).first().new == 12
    for k in range(4):
        s.write("crawl_runs", s.read("crawl_runs").withColumn("found", F.col("found") + 1))
    assert {r.found for r in s.read("crawl_runs").collect()} == {5}
    if kind == "database":
        spark.sql("DROP DATABASE store_test CASCADE")
    with pytest.raises(ValueError):
        stores.make_store("x", spark, "y")


def test_stages_from_clean_articles_to_topics(spark, tmp_path):
    rng = random.Random(3)
    themes = [[f"{stem}{k}" for k in "abcdefgh"] for stem in ("bat", "rain", "toss")]
    body = lambda t: " ".join(rng.choice(themes[t]) for _ in range(60)) + " Freedonia won."
    s = stores.make_store("folder", spark, str(tmp_path))
    s.write("articles", spark.createDataFrame([article(i, f"story {i}", body(i % 3)) for i in range(30)] + [article(99, "copy", body(0), duplicate=1)], ARTICLE))
    names = stages.gazetteer(spark, TERMS)
    assert stages.run_nlp(s, names, ["story"], NOW, dry_run=True).count() == 30 and s.read("article_nlp").count() == 0
    assert stages.run_nlp(s, names, ["story"], NOW, limit=10).count() == 10
    assert {r.status: r.waiting for r in stages.pending(s.read("articles")).collect()} == {"cleaned": 20, "nlp_done": 10}
    assert stages.run_nlp(s, names, ["story"], NOW).count() == 20 and stages.run_nlp(s, names, ["story"], NOW).count() == 0
    assert stages.run_nlp(s, names, ["story"], NOW, reprocess=True).count() == 30
    assert stages.run_embed(s, NOW).count() == 30 and s.read("articles").where("status = 'vectorized'").count() == 30
    assert stages.why_refit(s, NOW) is not None and stages.assign_new(s, NOW) is None
    one = stages.run_topics(s, NOW)["fit"]
    assert one["model_id"] == 1 and one["points"] == 30 and one["refreshed"] > 0 and stages.active(s)["params"]["fitted_on"] == 30
    assert s.read("articles").where("status = 'clustered'").count() == 30 and stages.why_refit(s, NOW) is None and not stages.map_is_stale(s)
    report = stages.model_report(s).collect()
    assert len(report) == stages.active(s)["n_clusters"] >= 2 and all(len(r.titles) >= 2 for r in report) and sum(r.size for r in report) <= 30
    assert any("TEAM" in (r.top_terms.entities or {}) for r in s.read("clusters").collect())
    now = stages.status(s).first()
    assert now.articles == 31 and now.processing == 1 and now.model_id == 1 and now.last_nlp is not None and now.last_crawl is None and now.version == f"31-99-1-{now.assignments}-0"
    stores.log_run(s, spark.createDataFrame([(4, 1, NOW, NOW, 1, 1, 0, 0, 0, {"too_old": "1"}), (5, 1, NOW, NOW + dt.timedelta(1), 1, 1, 0, 0, 1, {"failed": "x"})], stores.SCHEMAS["crawl_runs"]))
    now = stages.status(s).first()
    assert now.crawl_runs == 5 and now.last_crawl.day == 1 and now.version.endswith("-5")
    series = stages.topic_series(s).collect()
    assert len({r.stable_key for r in series}) == len(report) and sum(r.n for r in series) == now.assignments and all(r.sentiment > 0 for r in series)
    s.write("sources", spark.createDataFrame([(1, "a", "https://a.example", None)], stores.SCHEMAS["sources"]))
    points = stages.map_points(s).collect()
    assert len(points) == 30 and {r.source for r in points} == {"a"} and min(r.x for r in points) == 0 and max(r.x for r in points) == 1 and sum(r.cluster_id is not None for r in points) == now.assignments
    # new articles join topics by the model's threshold, the map follows, counts don't lessen
    s.write("articles", s.read("articles").unionByName(spark.createDataFrame([article(200 + i, f"more {i}", body(i % 3)) for i in range(3)], ARTICLE)))
    stages.run_nlp(s, names, [], NOW)
    stages.run_embed(s, NOW)
    got = stages.run_topics(s, NOW, "assign")
    assert got["assign"]["assigned"] + got["assign"]["emerging"] == 3 and s.read("article_projection").count() == 33
    before = s.read("topic_daily_stats").agg(F.sum("article_count")).first()[0]
    s.write("articles", s.read("articles").where("id > 10"))
    stages.refresh_daily(s, NOW)
    assert s.read("topic_daily_stats").agg(F.sum("article_count")).first()[0] >= before and stages.map_is_stale(s)
    assert stages.run_topics(s, NOW, "assign")["points"] == 22
    # an old model is fitted again, and topics keep their keys
    later = NOW + dt.timedelta(days=9)
    keys = {r.stable_key for r in s.read("clusters").collect()}
    two = stages.run_topics(s, later)
    assert two["reason"] == "model is old" and two["fit"]["model_id"] == 2 and two["fit"]["params"]["carried_over_topics"] >= 1
    assert s.read("cluster_models").where("is_active").count() == 1 and keys & {r.stable_key for r in s.read("clusters").where("model_id = 2").collect()}
    with pytest.raises(ValueError):
        stages.run_topics(s, NOW, "x")
