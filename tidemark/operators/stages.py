"""The stored stages: what waits by status, the language stage's table, vectors, topics and the map.

A stage reads the articles that wait for it, computes all of them at once, merges its table, and
advances the status of those that still have the one they had. Nothing goes through the driver
but counts.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import clean_text, entity_token
from tidemark.operators import clustering, embedding, language, merge, model, mood, topics
from tidemark.session import checked, cut
from tidemark.sources.store import last_good_crawl

#: Stage -> the status it takes articles from, and the one it leaves them in.
STAGES = {"nlp": ("cleaned", "nlp_done"), "embed": ("nlp_done", "vectorized"), "cluster": ("vectorized", "clustered")}
#: Labels whose names are one term each.
JOINED = ("PERSON", "TEAM", "TOURNAMENT", "CRICKET_ORG")
WINDOW_DAYS, KEEP_MODELS, LEAST_POINTS = 90, 3, 5


def gazetteer(spark: SparkSession, terms: dict) -> DataFrame:
    """(alias, label, name) of a name list {label: {name: [aliases]}}.

    Under NATIONAL_TEAMS a nation's aliases also stand, with -W, W or Women behind them, for its
    women's team. Other entries than maps of lists are left out.
    """
    rows = {(a, "TEAM" if label == "NATIONAL_TEAMS" else label, name) for label, names in terms.items() if isinstance(names, dict) for name, aliases in names.items() for a in aliases}
    women = {(a + end, label, f"{name} Women") for a, label, name in rows if name in terms.get("NATIONAL_TEAMS", {}) for end in ("-W", " W", " Women")}
    return spark.createDataFrame(sorted(rows | women), "alias string, label string, name string")


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """A name list out of a JSON file."""
    return gazetteer(spark, json.loads("\n".join(r[0] for r in spark.read.text(path).collect())))


def pending(articles: DataFrame) -> DataFrame:
    """(status, waiting): articles by status, copies left out."""
    return articles.where(F.col("duplicate_of").isNull()).groupBy("status").agg(F.count("*").alias("waiting"))


def batch(articles: DataFrame, statuses: list[str], after: int | None = None, size: int | None = None) -> DataFrame:
    """The next articles by id of some statuses, copies left out: all of them, or ``size`` behind the id ``after``."""
    rows = articles.where(F.col("duplicate_of").isNull() & F.col("status").isin(*statuses))
    if after is not None:
        rows = rows.where(F.col("id") > after)
    return rows if size is None else rows.orderBy("id").limit(size)


def batches(articles: DataFrame, statuses: list[str], size: int):
    """One batch after the other, by key and not by offset: what fails is passed over, not tried for ever."""
    after = None
    while True:
        rows = cut(batch(articles, statuses, after, size))
        last = rows.agg(F.max("id").alias("m")).first()["m"]
        if last is None:
            return
        yield rows
        after = last


def entities(texts: DataFrame, names: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(id, label, name, n) of (id, text): the name list's entries, and what a tagger ``found`` (id, label, name, n).

    Names that are a person's anywhere in a document are one everywhere in it, and a lone
    surname goes to the document's only person of that name. Null and empty texts have none.
    """
    ents = language.mentions(texts, "id", "text", checked(names), most_chars=None)
    if found is not None:
        ents = ents.unionByName(language.tagged(found)).groupBy("id", "label", "name").agg(F.sum("n").alias("n"))
    return language.fold_surnames(language.as_persons(ents))


def lemmas(texts: DataFrame, ents: DataFrame, stops: list[str]) -> DataFrame:
    """(id, lemmas): terms of (id, text) in their order, names of JOINED labels as one term each, longest first."""
    names = ents.where(F.col("label").isin(*JOINED)).groupBy("id").agg(F.collect_set("name").alias("names"))
    longest = F.array_sort("names", lambda a, b: F.length(b) - F.length(a))
    whole = F.aggregate(longest, F.col("text"), lambda t, n: F.replace(t, n, entity_token(n)))
    folded = texts.join(names, "id", "left").select("id", F.when(F.col("names").isNull(), F.col("text")).otherwise(whole).alias("text"))
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z][a-z0-9_]+)"), F.lit(1))
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*stops)) if stops else F.filter(words, lambda w: F.length(w) >= 3)
    return folded.select("id", F.coalesce(F.array_join(kept, " "), F.lit("")).alias("lemmas"))


def analyze(articles: DataFrame, names: DataFrame, stops: list[str], lexicon: dict[str, float] | None = None, found: DataFrame | None = None, most_chars: int | None = language.MAX_CHARS) -> DataFrame:
    """(article_id, lemmas, sentiment, entities, keywords) of articles (id, title, body): the language stage's table.

    Texts are the title and the cleaned body, read as far as ``most_chars`` (None: whole).
    ``lexicon`` gives words their mood; without one a small list of good and bad words does.
    """
    text = clean_text(F.concat(F.coalesce("title", F.lit("")), F.lit(".\n"), F.coalesce("body", F.lit(""))))
    texts = cut(articles.select("id", (text if most_chars is None else F.left(text, F.lit(most_chars))).alias("text")))
    ents = cut(entities(texts, names, found))
    rated = mood.sentiment(texts, "id", "text", lexicon or mood.SMALL)
    return (
        lemmas(texts, ents, stops)
        .join(rated, "id", "left")
        .join(language.entity_map(ents), "id", "left")
        .join(language.keywords(texts, "id", "text", stops), "id", "left")
        .select(F.col("id").alias("article_id"), "lemmas", F.coalesce("sentiment", F.lit(0.0)).cast("float").alias("sentiment"), F.col("entities").cast("map<string,map<string,int>>").alias("entities"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
    )


def entity_rows(nlp: DataFrame) -> DataFrame:
    """(id, label, name, n) out of the stored maps."""
    by_label = nlp.select(F.col("article_id").alias("id"), F.explode("entities").alias("label", "names"))
    return by_label.select("id", "label", F.explode("names").alias("name", "n")).withColumn("n", F.col("n").cast("long"))


def harmonised(new: DataFrame, stored: DataFrame) -> DataFrame:
    """A batch's rows with names at the label that most articles give them, stored ones and its own, each article once."""
    own = entity_rows(new)
    before = entity_rows(stored.join(new.select("article_id"), "article_id", "left_anti"))
    moved = language.harmonise(own, language.votes(before.unionByName(own)))
    maps = language.entity_map(moved).select(F.col("id").alias("article_id"), F.col("entities").cast("map<string,map<string,int>>").alias("entities"))
    return new.drop("entities").join(maps, "article_id", "left").select(*new.columns)


def token_names(nlp: DataFrame) -> DataFrame:
    """(token, name): the display name of each folded name; of several the commonest, then the first in the alphabet."""
    n = entity_rows(nlp).where(F.col("label").isin(*JOINED)).groupBy(entity_token(F.col("name")).alias("token"), "name").agg(F.count("*").alias("articles"))
    return n.groupBy("token").agg(F.min_by("name", F.struct(-F.col("articles"), "name")).alias("name"))


def topic_entities(nlp: DataFrame, assigned: DataFrame, top: int = 5) -> DataFrame:
    """(cluster_id, label, names): the names that most articles of a topic (article_id, cluster_id) hold, the commonest first."""
    rows = entity_rows(nlp).where(F.col("label").isin(*JOINED)).select(F.col("id").alias("article_id"), "label", "name")
    n = rows.join(assigned.select("article_id", "cluster_id").distinct(), "article_id").groupBy("cluster_id", "label", "name").agg(F.count("*").alias("articles"))
    best = merge.top_per(n, ["cluster_id", "label"], [F.desc("articles"), F.asc("name")], top)
    return best.groupBy("cluster_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda s: s["name"]).alias("names"))


# ---------------------------------------------------------------- running stages over a store


def _advance(store, ids: DataFrame, stage: str) -> None:
    source, to = STAGES[stage]
    store.write("articles", merge.advance(store.read("articles"), ids, source, to))


def _put(store, name: str, rows: DataFrame, key: str = "article_id") -> DataFrame:
    """Rows merged into a table by key, those of articles that are gone left out; what was written."""
    rows = cut(merge.cascade(rows, store.read("articles"), key))
    store.write(name, merge.upsert(store.read(name), rows, [key]))
    return rows


def run_nlp(store, names: DataFrame, stops: list[str], now: dt.datetime, limit: int | None = None, reprocess: bool = False, dry_run: bool = False, **how) -> DataFrame:
    """The language stage over what waits, or again over what has been through it; (article_id, ...) of what was done."""
    statuses = ["nlp_done", "vectorized", "clustered"] if reprocess else [STAGES["nlp"][0]]
    new = cut(analyze(batch(store.read("articles"), statuses, size=limit), names, stops, **how))
    rows = harmonised(new, store.read("article_nlp")).withColumn("processed_at", F.lit(now))
    if dry_run:
        return rows
    done = _put(store, "article_nlp", rows.select(*store.read("article_nlp").columns))
    if not reprocess:
        _advance(store, done.select(F.col("article_id").alias("id")), "nlp")
    return done


def run_embed(store, now: dt.datetime, limit: int | None = None, dry_run: bool = False, encode: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Vectors of what waits for them. ``encode`` makes (id, model, embedding) of (id, title, body); hashed terms by default."""
    encode = encode or (lambda rows: embedding.hashed_embeddings(rows, "id", "title", "body"))
    got = encode(batch(store.read("articles"), [STAGES["embed"][0]], size=limit))
    rows = got.select(F.col("id").alias("article_id"), "model", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(now).alias("created_at"))
    if dry_run:
        return rows
    done = _put(store, "article_vectors", rows)
    _advance(store, done.select(F.col("article_id").alias("id")), "embed")
    return done


def active(store) -> dict | None:
    """The active model's row, its parameters read."""
    r = store.read("cluster_models").where("is_active").orderBy(F.desc("id")).first()
    return None if r is None else r.asDict() | {"params": json.loads(r["params"] or "{}")}


def window(store, now: dt.datetime, days: int = WINDOW_DAYS) -> DataFrame:
    """(id, v, lemmas) of the articles that a model is fitted on."""
    a = store.read("articles").where(F.col("duplicate_of").isNull() & F.col("status").isin("vectorized", "clustered"))
    a = a.where(F.coalesce("published_at", "scraped_at") >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS")).select("id")
    v = store.read("article_vectors").select(F.col("article_id").alias("id"), F.col("embedding").alias("v")).where("v is not null")
    return a.join(v, "id").join(store.read("article_nlp").select(F.col("article_id").alias("id"), "lemmas"), "id")


def fit_model(store, now: dt.datetime, dry_run: bool = False, algorithm: str = "density") -> dict | None:
    """A new active model over the window; None if too few articles are ready.

    Writes the model, its clusters and their members; earlier models' members are kept for the
    KEEP_MODELS newest; then daily counts and the map are made anew.
    """
    rows = cut(window(store, now))
    terms = rows.select("id", F.explode(F.split("lemmas", " ")).alias("term")).where("term <> ''").groupBy("id", "term").agg(F.count("*").alias("n"))
    models, clusters = store.read("cluster_models"), store.read("clusters")
    top = models.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    first = clusters.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"] + 1
    got = model.fit(rows.select("id", "v"), terms, clusters.select("id", "model_id", "centroid", "stable_key"), top + 1, first, algorithm)
    if got is None:
        return None
    named = topics_named(store, got)
    size = named.agg(F.count("*").alias("n"), F.sum("size").alias("members"), F.round(F.avg("top_terms.coherence_npmi"), 4).alias("npmi")).first()
    carried = named.select("stable_key").join(clusters.select("stable_key").distinct(), "stable_key", "left_semi").count()
    params = {"assign_threshold": got.threshold, "window_days": WINDOW_DAYS, "fitted_on": got.n_articles, "carried_over_topics": carried,
              "metrics": {"n_topics": size["n"], "unassigned": got.n_articles - (size["members"] or 0), "silhouette": got.silhouette, "coherence_npmi": size["npmi"]}}
    if dry_run:
        return {"params": params, "topics": named}
    made = rows.sparkSession.createDataFrame([(top + 1, now, got.algorithm, json.dumps(params), size["n"], float(got.silhouette), True)], models.schema)
    store.write("cluster_models", merge.activate(models.unionByName(made), top + 1))
    store.append("clusters", named)
    member = got.assignments.select("article_id", "cluster_id", F.col("score").cast("float").alias("score"), F.lit(now).alias("assigned_at"))
    every = store.read("article_clusters").unionByName(member)
    store.write("article_clusters", merge.keep_models(every, store.read("clusters"), store.read("cluster_models"), KEEP_MODELS).select(*member.columns))
    _advance(store, rows.select("id"), "cluster")
    return {"model_id": top + 1, "params": params, "refreshed": refresh_daily(store, now), "points": refresh_map(store, now)}


def topics_named(store, got: model.Fit) -> DataFrame:
    """The clusters of a fit as the table has them: labels with learned names, and the names of each topic."""
    nlp = store.read("article_nlp")
    learned = token_names(nlp)
    shown = got.clusters.select("id", F.posexplode(F.slice("terms", 1, 3)).alias("pos", "token")).join(learned, "token", "left")
    label = shown.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", topics.pretty(F.col("token"))).alias("t")))), lambda s: s["t"]), " · ").alias("label"))
    ents = topic_entities(nlp, got.assignments).groupBy(F.col("cluster_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("label", "names"))).alias("entities"))
    j = got.clusters.drop("label").join(label, "id", "left").join(ents, "id", "left")
    top = F.struct("terms", "entities", F.col("coherence_npmi").cast("double").alias("coherence_npmi"))
    return cut(j.select("id", "model_id", "label", top.alias("top_terms"), "centroid", "size", "stable_key"))


def assign_new(store, now: dt.datetime, dry_run: bool = False) -> dict | None:
    """What waits joins the active model's nearest topic, if it is near enough by the model's own threshold; None without a model."""
    m = active(store)
    if m is None:
        return None
    waiting = batch(store.read("articles"), [STAGES["cluster"][0]]).select("id")
    v = store.read("article_vectors").select(F.col("article_id").alias("id"), F.col("embedding").alias("v"))
    clusters = store.read("clusters").where(F.col("model_id") == m["id"])
    got = cut(model.assign(waiting.join(v, "id"), clusters.select("id", "centroid"), m["params"].get("assign_threshold", topics.ASSIGN_FLOOR)))
    n = got.agg(F.count("cluster_id").alias("a"), F.count_if(F.col("cluster_id").isNull()).alias("e")).first()
    if not dry_run and n["a"] + n["e"]:
        new = got.where("cluster_id is not null").select(F.col("id").alias("article_id"), "cluster_id", F.col("score").cast("float").alias("score"), F.lit(now).alias("assigned_at"))
        store.write("article_clusters", merge.insert_if_absent(store.read("article_clusters"), new, ["article_id", "cluster_id"]))
        _advance(store, got.select("id"), "cluster")
        store.write("clusters", merge.with_sizes(store.read("clusters"), store.read("article_clusters")).select(*clusters.columns))
        refresh_daily(store, now)
        refresh_map(store, now)
    return {"assigned": n["a"], "emerging": n["e"]}


def why_refit(store, now: dt.datetime) -> str | None:
    """Why the active model should be fitted again: its age, how many came since that fit no topic, how the window grew."""
    m = active(store)
    if m is None:
        return topics.refit_reason(None, 0, 0, 0)
    made = m["created_at"] if m["created_at"].tzinfo else m["created_at"].replace(tzinfo=dt.timezone.utc)
    mine = store.read("article_clusters").join(store.read("clusters").where(F.col("model_id") == m["id"]).select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    late = store.read("articles").where((F.col("status") == "clustered") & (F.col("scraped_at") > F.lit(made)))
    emerging = late.join(mine.select(F.col("article_id").alias("id")), "id", "left_anti").count()
    age = ((now if now.tzinfo else now.replace(tzinfo=dt.timezone.utc)) - made).total_seconds() / 86_400
    return topics.refit_reason(age, emerging, m["params"].get("fitted_on") or 1, window(store, now).count())


def daily(store) -> DataFrame:
    """(day, model_id, cluster_id, label, article_count, avg_sentiment) of the active model's stored articles."""
    m = active(store)
    c = store.read("clusters").where(F.col("model_id") == (m["id"] if m else -1)).select(F.col("id").alias("cluster_id"), "model_id", "label")
    a = store.read("articles").select(F.col("id").alias("article_id"), F.to_date(F.coalesce("published_at", "scraped_at")).alias("day"))
    j = store.read("article_clusters").select("article_id", "cluster_id").join(c, "cluster_id").join(a, "article_id")
    j = j.join(store.read("article_nlp").select("article_id", "sentiment"), "article_id", "left")
    return j.groupBy("day", "model_id", "cluster_id", "label").agg(F.count("*").alias("article_count"), F.avg("sentiment").cast("float").alias("avg_sentiment"))


def refresh_daily(store, now: dt.datetime) -> int:
    """Daily counts merged with live ones, which never lessens a count; how many rows were live."""
    live = cut(daily(store))
    name = "topic_daily_stats"
    kept = store.read(name)
    both = merge.merge_daily(kept.drop("updated_at"), live.select("day", "cluster_id", "model_id", "label", "article_count", "avg_sentiment"))
    old = kept.select("day", "cluster_id", "updated_at").join(live.select("day", "cluster_id"), ["day", "cluster_id"], "left_anti")
    store.write(name, both.join(old, ["day", "cluster_id"], "left").withColumn("updated_at", F.coalesce("updated_at", F.lit(now))).select(*kept.columns))
    return live.count()


def mapped(store) -> DataFrame:
    """(id, v) of what the map should show."""
    v = store.read("article_vectors").select(F.col("article_id").alias("id"), F.col("embedding").alias("v")).where("v is not null")
    return v.join(store.read("articles").where(F.col("duplicate_of").isNull()).select("id"), "id", "left_semi")


def map_is_stale(store) -> bool:
    want = mapped(store).agg(F.count("*").alias("n"), F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()
    have = store.read("article_projection").agg(F.count("*").alias("n"), F.coalesce(F.max("article_id"), F.lit(0)).alias("m")).first()
    return have["n"] != 0 if want["n"] < LEAST_POINTS else (want["n"], want["m"]) != (have["n"], have["m"])


def refresh_map(store, now: dt.datetime) -> int:
    """The map replaced by one of all vectors; empty under LEAST_POINTS of them. How many points it has."""
    rows = cut(mapped(store))
    n = rows.count()
    into = store.read("article_projection")
    points = clustering.project(rows).select(F.col("id").alias("article_id"), "method", F.col("x").cast("float").alias("x"), F.col("y").cast("float").alias("y"), F.lit(now).alias("computed_at")) if n >= LEAST_POINTS else into.limit(0)
    store.write("article_projection", points.select(*into.columns))
    return n if n >= LEAST_POINTS else 0


def run_topics(store, now: dt.datetime, mode: str = "auto", dry_run: bool = False) -> dict:
    """One pass: what waits is assigned, the model is fitted again where there is a reason, the map is kept current."""
    if mode not in ("auto", "assign", "fit"):
        raise ValueError("mode is auto, assign or fit")
    result: dict = {}
    if mode == "fit":
        return {"fit": fit_model(store, now, dry_run)}
    if active(store):
        result["assign"] = assign_new(store, now, dry_run)
    if mode == "auto" and (reason := why_refit(store, now)):
        result |= {"reason": reason, "fit": fit_model(store, now, dry_run)}
    if not dry_run and map_is_stale(store):
        result["points"] = refresh_map(store, now)
    return result


def model_report(store, headlines: int = 3) -> DataFrame:
    """(cluster_id, label, size, coherence, terms, titles) of the active model: each topic with its closest articles."""
    m = active(store)
    c = store.read("clusters").where(F.col("model_id") == (m["id"] if m else -1))
    a = store.read("articles").select(F.col("id").alias("article_id"), "title")
    j = store.read("article_clusters").select("article_id", "cluster_id", "score").join(a, "article_id").join(c.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    best = merge.top_per(j, ["cluster_id"], [F.desc_nulls_last("score"), F.asc("article_id")], headlines)
    titles = best.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "title"))), lambda s: s["title"]).alias("titles"))
    return c.select(F.col("id").alias("cluster_id"), "label", "size", F.col("top_terms.coherence_npmi").alias("coherence"), F.slice("top_terms.terms", 1, 8).alias("terms")).join(titles, "cluster_id", "left").orderBy(F.desc("size"), "cluster_id")


def status(store) -> DataFrame:
    """One row: counts and times of all tables, and a version text that changes whenever they do."""
    runs = store.read("crawl_runs")
    a = store.read("articles").agg(F.count("*").alias("articles"), F.coalesce(F.max("id"), F.lit(0)).alias("max_article"), F.count_if(F.col("status") != "clustered").alias("processing"))
    m = store.read("cluster_models").agg(F.max(F.when(F.col("is_active"), F.col("id"))).alias("model_id"), F.max("created_at").alias("_fitted"))
    c = store.read("article_clusters").agg(F.count("*").alias("assignments"), F.max("assigned_at").alias("_assigned"))
    r = runs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("crawl_runs"))
    n = store.read("article_nlp").agg(F.max("processed_at").alias("last_nlp"))
    j = a.join(m).join(c).join(r).join(last_good_crawl(runs)).join(n)
    version = F.concat_ws("-", "articles", "max_article", F.coalesce(F.col("model_id").cast("string"), F.lit("None")), "assignments", "crawl_runs")
    return j.select("articles", "max_article", "model_id", "assignments", "crawl_runs", "last_crawl", "last_nlp", F.greatest("_fitted", "_assigned").alias("last_topics"), "processing", version.alias("version"))


def topic_series(store) -> DataFrame:
    """(stable_key, day, n, sentiment) of the kept daily counts; of several models' the newest one's."""
    c = store.read("clusters").where("stable_key is not null").select(F.col("id").alias("cluster_id"), "stable_key")
    d = store.read("topic_daily_stats").join(c, "cluster_id")
    newest = merge.first_per(d, ["stable_key", "day"], [F.desc("model_id"), F.asc("cluster_id")])
    return newest.select("stable_key", "day", F.col("article_count").alias("n"), F.col("avg_sentiment").alias("sentiment"))


def map_points(store, method: str = "pca") -> DataFrame:
    """The stored map of a method: each article with its axes and its topic under the active model, the smallest if it has several."""
    m = active(store)
    c = store.read("clusters").where(F.col("model_id") == (m["id"] if m else -1)).select(F.col("id").alias("cluster_id"))
    topic = store.read("article_clusters").join(c, "cluster_id", "left_semi").groupBy(F.col("article_id").alias("id")).agg(F.min("cluster_id").alias("cluster_id"))
    p = store.read("article_projection").where(F.col("method") == method).select(F.col("article_id").alias("id"), F.round(F.col("x").cast("double"), 4).alias("x"), F.round(F.col("y").cast("double"), 4).alias("y"))
    s = store.read("sources").select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    return p.join(store.read("articles").select("id", "title", "source_id"), "id").join(s, "source_id").join(topic, "id", "left").select("id", "title", "source", "x", "y", "cluster_id").orderBy("id")


def run_totals(runs: DataFrame) -> DataFrame:
    """(started_at, new): inserted articles of each run over all its sources."""
    return runs.groupBy("started_at").agg(F.coalesce(F.sum("inserted"), F.lit(0)).alias("new"))


