"""Queries over language, topics and vectors, events, and the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import entity_token, normalise_name
from tidemark.functions.vectors import normalised
from tidemark.operators import clustering, embedding, language, model, topics
from tidemark.plans.base import KEYWORDS, MODEL, STOPS, Tables, query
from tidemark.session import Scratch, checked, cut
from tidemark.streaming import jobs

#: What ends a team's and a tournament's name in the test data.
TEAM = r"(\p{Lu}[\p{L}]+ (?:Giants|Pilots|Kestrels|Foxes|Harriers|Rovers|Sparks|Comets|Hawks|Bisons))"
CUP = r"(\p{Lu}[\p{L}]+ (?:Premier T20|T20 League|T20 Cup|T20 Shield|Super Sixes T20|Twenty20 Trophy))"

_ENTS = f"""ents AS (SELECT id, label, name, count(*) AS n FROM (
    SELECT id, 'TEAM' AS label, unnest(regexp_extract_all(body, '{TEAM}')) AS name FROM articles UNION ALL SELECT id, 'TOURNAMENT', unnest(regexp_extract_all(body, '{CUP}')) FROM articles) GROUP BY 1, 2, 3)"""


def _ents(t: Tables) -> DataFrame:
    """(id, label, name, n) of teams and tournaments, found by pattern."""
    found = [t.articles.select("id", F.lit(label).alias("label"), F.explode(F.regexp_extract_all("body", F.lit(p), F.lit(1))).alias("name")) for label, p in (("TEAM", TEAM), ("TOURNAMENT", CUP))]
    return found[0].unionByName(found[1]).groupBy("id", "label", "name").agg(F.count("*").alias("n"))


@query(f"WITH {_ENTS} SELECT label, name, sum(n)::BIGINT AS mentions, count(*) AS articles FROM ents GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY label ORDER BY sum(n) DESC, name) <= 10")
def entity_top(t: Tables) -> DataFrame:
    """The most mentioned names of each label."""
    g = _ents(t).groupBy("label", "name").agg(F.sum("n").alias("mentions"), F.count("*").alias("articles"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("mentions"), "name"))).where("r <= 10").drop("r")


@query(f"WITH {_ENTS} SELECT id, label, name, n FROM ents WHERE label = 'TEAM'")
def gazetteer_mentions(t: Tables) -> DataFrame:
    """Mentions of a list of names, all team names of the corpus, through the name-list join; the SQL searches by pattern."""
    gaz = _ents(t).where("label = 'TEAM'").select(F.col("name").alias("alias"), "label", "name").distinct()
    return language.mentions(t.articles, "id", "body", gaz, most_chars=None).select("id", "label", "name", "n")


# names with a label that varies by article, as a tagger's would
_TAGS = f"""{_ENTS}, tags AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'PLACE' WHEN label = 'TEAM' THEN 'ORG' ELSE 'EVENT' END AS label, name, n FROM ents)"""


def _tags(t: Tables) -> DataFrame:
    return _ents(t).select("id", F.when(F.col("id") % 5 == 0, "PLACE").when(F.col("label") == "TEAM", "ORG").otherwise("EVENT").alias("label"), "name", "n")


@query(f"WITH {_TAGS} SELECT name, label, count(DISTINCT id) AS articles FROM tags GROUP BY 1, 2")
def label_votes(t: Tables) -> DataFrame:
    """Articles that give a name each label."""
    return language.votes(_tags(t))


@query(f"""WITH {_TAGS}, v AS (SELECT name, label, count(DISTINCT id) AS c FROM tags GROUP BY 1, 2), w AS (SELECT name, label AS winner FROM v QUALIFY row_number() OVER (PARTITION BY name ORDER BY c DESC, label) = 1
    AND coalesce(lead(c) OVER (PARTITION BY name ORDER BY c DESC, label), 0) < c) SELECT t.id, coalesce(w.winner, t.label) AS label, t.name, sum(t.n)::BIGINT AS n FROM tags t LEFT JOIN w USING (name) GROUP BY 1, 2, 3""")
def harmonise(t: Tables) -> DataFrame:
    """Names moved to the label that most articles give them; ties stay."""
    tags = _tags(t)
    return language.harmonise(tags, language.votes(tags))


@query()
def entity_maps(t: Tables) -> DataFrame:
    """Names per article as a nested map; persons folded."""
    return language.entity_map(language.fold_surnames(language.as_persons(_tags(t))))


@query(f"WITH {KEYWORDS} SELECT k AS keyword, count(*) AS articles FROM (SELECT unnest(keywords) AS k FROM keyword) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def keyword_top(t: Tables) -> DataFrame:
    """The commonest keywords."""
    return t.article_nlp.select(F.explode("keywords").alias("keyword")).groupBy("keyword").agg(F.count("*").alias("articles")).orderBy(F.desc("articles"), "keyword").limit(12)


@query()
def key_phrases(t: Tables) -> DataFrame:
    """Phrases of each article; they are chosen one after the other, so there is no SQL."""
    return language.key_phrases(t.bodies, "id", "body", list(STOPS))


_GOOD, _BAD = (", ".join(f"'{w}'" for w in ws) for ws in (language.GOOD, language.BAD))
_MOOD = f"""mood AS (SELECT id, source_id, coalesce(round(list_sum(list_transform(s, lambda x: x / sqrt(x * x + 15))) / nullif(len(s), 0), 4), 0) AS mood FROM (
    SELECT id, source_id, list_transform(list_filter(list_transform(regexp_split_to_array(lower(body), '[.!?]+\\s+|\\n+'), lambda z: list_filter(regexp_split_to_array(z, '[^a-z0-9''-]+'), lambda w: w <> '')), lambda ws: len(ws) >= 3),
    lambda ws: (len(list_filter(ws, lambda w: w IN ({_GOOD}))) - len(list_filter(ws, lambda w: w IN ({_BAD}))))::DOUBLE) AS s FROM articles))"""


def _mood(t: Tables) -> DataFrame:
    return t.bodies.select("id", "source_id", language.sentiment(F.col("body")).alias("mood"))


@query(f"WITH {_MOOD} SELECT s.name AS source, count(*) AS articles, round(avg(mood), 3) + 0.0 AS mood FROM mood m JOIN sources s ON s.id = m.source_id GROUP BY 1")
def sentiment_by_source(t: Tables) -> DataFrame:
    s = t.sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    return _mood(t).join(s, "source_id").groupBy("source").agg(F.count("*").alias("articles"), (F.round(F.avg("mood"), 3) + 0.0).alias("mood"))


@query(f"WITH {_MOOD} (SELECT 'low' AS side, id, mood FROM mood ORDER BY mood, id LIMIT 3) UNION ALL (SELECT 'high', id, mood FROM mood ORDER BY mood DESC, id LIMIT 3)")
def mood_extremes(t: Tables) -> DataFrame:
    """The three articles of lowest and of highest mood."""
    m = _mood(t).select("id", "mood")
    side = lambda name, *order: m.orderBy(*order).limit(3).select(F.lit(name).alias("side"), "id", "mood")
    return side("low", "mood", "id").unionByName(side("high", F.desc("mood"), F.asc("id")))


@query(r"""SELECT id, trim(regexp_replace(lower(author), '[^a-z0-9]+', '_', 'g'), '_') AS token, regexp_replace(regexp_replace(regexp_replace(trim(trim(author), '"''“”‘’'), '[''’]s$', ''), '^(?i)the\s+', ''), '\s+', ' ', 'g') AS name FROM articles WHERE author IS NOT NULL""")
def names_normalised(t: Tables) -> DataFrame:
    a = t.articles.where(F.col("author").isNotNull())
    return a.select("id", entity_token(F.col("author")).alias("token"), normalise_name(F.col("author")).alias("name"))


# ---------------------------------------------------------------- terms of topics

_TERMS = f"""part AS (SELECT article_id AS id, min(cluster_id) AS topic FROM article_clusters ac JOIN clusters c ON c.id = ac.cluster_id WHERE c.model_id = {MODEL} GROUP BY 1),
    term AS (SELECT a.id, coalesce(p.topic, -1) AS topic, unnest(list_filter(regexp_extract_all(lower(a.body), '[a-z][a-z0-9]+'), lambda w: len(w) >= 3 AND w NOT IN ({", ".join(f"'{w}'" for w in STOPS)}))) AS term FROM articles a LEFT JOIN part p ON p.id = a.id),
    cnt AS (SELECT topic, term, count(*) AS tf FROM term GROUP BY 1, 2), tot AS (SELECT term, sum(tf) AS total FROM cnt GROUP BY 1),
    whole AS (SELECT sum(tf) / greatest(count(DISTINCT topic) FILTER (WHERE topic >= 0), 1) AS a FROM cnt),
    best AS (SELECT topic, term, tf * ln(1 + a / greatest(total, 1)) AS score, row_number() OVER (PARTITION BY topic ORDER BY round(tf * ln(1 + a / greatest(total, 1)), 9) DESC, term) AS rank
        FROM cnt JOIN tot USING (term) CROSS JOIN whole WHERE topic >= 0 QUALIFY rank <= 10)"""


def _words(t: Tables) -> DataFrame:
    """(id, terms): the terms of every article as they stand, in its row; kept as a table, as texts are cut into terms once."""
    ts = F.filter(language.tokens(F.col("body")), lambda w: language.is_term(w, list(STOPS)))
    return Scratch(t.spark, "terms").put(t.bodies.select("id", ts.alias("terms")))


def _terms(t: Tables, words: DataFrame) -> DataFrame:
    """(id, topic, term, n) terms of all articles, n for each place; topic -1 for those in none."""
    c = t.active_clusters.select(F.col("id").alias("cluster_id"))
    part = t.article_clusters.join(c, "cluster_id").groupBy(F.col("article_id").alias("id")).agg(F.min("cluster_id").alias("topic"))
    return words.join(checked(part), "id", "left").select("id", F.coalesce("topic", F.lit(-1)).alias("topic"), F.explode("terms").alias("term"), F.lit(1).alias("n"))


@query(f"WITH {_TERMS} SELECT topic::BIGINT AS topic, term, round(score, 6) AS score, rank FROM best")
def ctfidf(t: Tables) -> DataFrame:
    """The terms that mark each topic."""
    return topics.ctfidf(_terms(t, _words(t))).select(F.col("topic").cast("long").alias("topic"), "term", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_TERMS}, has AS (SELECT DISTINCT id, term FROM term), n AS (SELECT count(*)::DOUBLE AS n FROM articles), df AS (SELECT term, count(*) AS df FROM has GROUP BY 1),
    pair AS (SELECT x.topic, x.term AS t1, y.term AS t2 FROM best x JOIN best y ON x.topic = y.topic AND x.term < y.term),
    both_ AS (SELECT p.t1, p.t2, count(*) AS b FROM (SELECT DISTINCT t1, t2 FROM pair) p JOIN has h1 ON h1.term = p.t1 JOIN has h2 ON h2.term = p.t2 AND h2.id = h1.id GROUP BY 1, 2)
    SELECT p.topic::BIGINT AS topic, round(avg(CASE WHEN coalesce(b.b, 0) = 0 THEN -1 WHEN b.b = n.n THEN 1 ELSE ln(b.b / n.n / (d1.df / n.n * (d2.df / n.n))) / -ln(b.b / n.n) END), 4) AS npmi
    FROM pair p CROSS JOIN n LEFT JOIN both_ b ON b.t1 = p.t1 AND b.t2 = p.t2 JOIN df d1 ON d1.term = p.t1 JOIN df d2 ON d2.term = p.t2 GROUP BY 1""")
def npmi(t: Tables) -> DataFrame:
    """How often the terms of a topic go together."""
    words = _words(t)
    # one row per topic and term: small, and read again
    top = cut(topics.ctfidf(_terms(t, words)))
    if not words.groupBy("id").count().where("count > 1").isEmpty():
        words = words.groupBy("id").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    return topics.npmi(words, top, t.articles.count()).select(F.col("topic").cast("long").alias("topic"), "npmi")


@query(f"WITH {_TERMS} SELECT topic::BIGINT AS topic, string_agg(CASE WHEN regexp_matches(term, '[0-9]') THEN upper(term) ELSE upper(left(term, 1)) || substr(term, 2) END, ' · ' ORDER BY rank) AS label FROM best WHERE rank <= 3 GROUP BY 1")
def topic_labels(t: Tables) -> DataFrame:
    return topics.labels(topics.ctfidf(_terms(t, _words(t)))).select(F.col("topic").cast("long").alias("topic"), "label")


# ---------------------------------------------------------------- vectors

_V = """v AS (SELECT vec_id AS id, label::BIGINT AS topic, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
    dims AS (SELECT topic, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT topic, v, unnest(range(1, 65)) AS i FROM v) GROUP BY 1, 2),
    sums AS (SELECT topic, list(s ORDER BY i) AS s, max(n) AS n FROM dims GROUP BY 1),
    cent AS (SELECT topic, n, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS c FROM sums)"""


def _v(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("topic"), normalised(F.col("embedding")).alias("v"))


def _cents(t: Tables) -> DataFrame:
    return topics.centroids(_v(t))


@query(f"WITH {_V} SELECT topic, n, round(c[1], 6) AS c1, round(c[64], 6) AS c64, round(list_sum(c), 6) AS total FROM cent")
def centroids(t: Tables) -> DataFrame:
    """Normalised mean vectors."""
    c = F.col("centroid")
    return _cents(t).select("topic", "n", F.round(c[0], 6).alias("c1"), F.round(c[63], 6).alias("c64"), F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"WITH {_V} SELECT v.id, topic, round(list_dot_product(v.v, c.c), 4) AS score FROM v JOIN cent c USING (topic)")
def member_scores(t: Tables) -> DataFrame:
    return topics.member_scores(_v(t), _cents(t))


@query(f"WITH {_V} SELECT v.id, c.topic, round(list_dot_product(v.v, c.c), 6) AS sim FROM v CROSS JOIN cent c QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY list_dot_product(v.v, c.c) DESC, c.topic) = 1")
def assign_nearest(t: Tables) -> DataFrame:
    """The closest centroid of every vector."""
    return topics.nearest(_v(t).select("id", "v"), _cents(t)).select("id", "topic", F.round("sim", 6).alias("sim"))


_LOO = f"{_V}, loo AS (SELECT v.id, topic, list_dot_product(v.v, r) / sqrt(list_dot_product(r, r)) AS sim FROM (SELECT v.id, v.v, topic, list_transform(s.s, lambda x, i: x - v.v[i]) AS r FROM v JOIN sums s USING (topic) WHERE s.n > 1) v)"


@query(f"WITH {_LOO} SELECT id, topic, round(sim, 6) AS sim FROM loo")
def loo_similarity(t: Tables) -> DataFrame:
    """Each vector against the others of its topic."""
    return topics.leave_one_out(_v(t)).select("id", "topic", F.round("sim", 6).alias("sim"))


@query(f"WITH {_LOO} SELECT round(greatest(coalesce(quantile_cont(sim, 0.1), 0.3), 0.3), 4) AS threshold FROM loo")
def assign_threshold(t: Tables) -> DataFrame:
    """What a new vector needs to join a topic: the tenth percentile of these similarities, the floor at least."""
    return topics.assign_threshold(topics.leave_one_out(_v(t)))


@query(f"WITH {_LOO} SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS share, unnest(list_transform(quantile_cont(sim, [0.1, 0.5, 0.9]), lambda x: round(x, 4))) AS sim FROM loo")
def loo_percentiles(t: Tables) -> DataFrame:
    """Percentiles of these similarities."""
    sims = cut(topics.leave_one_out(_v(t)).select("sim"))
    return t.spark.createDataFrame([(q, round(x, 4)) for q in (0.1, 0.5, 0.9) if (x := topics.quantile(sims, "sim", q)) is not None], "share double, sim double")


@query(f"""WITH {_V}, d AS (SELECT v.id, v.topic, s.topic AS o, s.n, list_dot_product(v.v, s.s) AS x FROM v CROSS JOIN sums s),
    ab AS (SELECT id, topic, max(CASE WHEN o = topic THEN (n - x) / (n - 1) END) AS a, min(CASE WHEN o <> topic THEN 1 - x / n END) AS b, max(CASE WHEN o = topic THEN n END) AS n FROM d GROUP BY 1, 2)
    SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab""")
def silhouette(t: Tables) -> DataFrame:
    return topics.silhouette(_v(t)).agg(F.round(F.avg("s"), 6).alias("silhouette"))


@query(f"""WITH {_V}, m AS (SELECT topic, list_transform(s, lambda x: x / n) AS c FROM sums), sp AS (SELECT topic, m.c, avg(list_distance(v.v, m.c)) AS s FROM v JOIN m USING (topic) GROUP BY 1, 2)
    SELECT round(avg(w), 6) AS davies_bouldin FROM (SELECT a.topic, max((a.s + b.s) / list_distance(a.c, b.c)) AS w FROM sp a JOIN sp b ON a.topic <> b.topic GROUP BY 1)""")
def davies_bouldin(t: Tables) -> DataFrame:
    return topics.davies_bouldin(_v(t)).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


_SIL = """d AS (SELECT v.id, v.topic, s.topic AS o, s.n, list_dot_product(v.v, s.s) AS x FROM v CROSS JOIN sums s WHERE v.topic >= 0),
    ab AS (SELECT id, topic, max(CASE WHEN o = topic THEN (n - x) / (n - 1) END) AS a, min(CASE WHEN o <> topic THEN 1 - x / n END) AS b, max(CASE WHEN o = topic THEN n END) AS n FROM d GROUP BY 1, 2),
    m AS (SELECT topic, list_transform(s, lambda x: x / n) AS c FROM sums), sp AS (SELECT topic, m.c, avg(list_distance(v.v, m.c)) AS s FROM v JOIN m USING (topic) GROUP BY 1, 2)"""


@query(f"""WITH {_V.replace('label::BIGINT AS topic', 'CASE WHEN label >= 8 THEN -1 ELSE label END::BIGINT AS topic').replace('FROM v) GROUP BY 1, 2)', 'FROM v WHERE topic >= 0) GROUP BY 1, 2)')}, {_SIL}
    SELECT (SELECT count(*) FROM v) AS articles, (SELECT count(DISTINCT topic) FROM v WHERE topic >= 0) AS topics, (SELECT count(*) FROM v WHERE topic < 0) AS unassigned, round((SELECT count(*) FROM v WHERE topic >= 0) / (SELECT count(*) FROM v), 4) AS coverage,
    (SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) FROM ab) AS silhouette,
    (SELECT round(avg(w), 6) FROM (SELECT a.topic, max((a.s + b.s) / list_distance(a.c, b.c)) AS w FROM sp a JOIN sp b ON a.topic <> b.topic GROUP BY 1)) AS davies_bouldin""")
def model_metrics(t: Tables) -> DataFrame:
    """The report of a labelling that leaves two labels unassigned."""
    return topics.metrics(_v(t).withColumn("topic", F.when(F.col("topic") >= 8, F.lit(-1).cast("long")).otherwise(F.col("topic"))))


@query("""WITH p AS (SELECT vec_id AS id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), r AS (SELECT label, min(x) AS x0, max(x) - min(x) AS xr, min(y) AS y0, max(y) - min(y) AS yr FROM p GROUP BY 1)
    SELECT id, round((x - x0) / CASE WHEN xr = 0 THEN 1 ELSE xr END, 6) AS x, round((y - y0) / CASE WHEN yr = 0 THEN 1 ELSE yr END, 6) AS y FROM p JOIN r USING (label)""")
def projection_minmax(t: Tables) -> DataFrame:
    """Two axes of the vectors scaled to 0..1 within each label."""
    p = t.embeddings.select(F.col("vec_id").alias("id"), "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return topics.scaled(p, ["label"]).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def projection_pca(t: Tables) -> DataFrame:
    """A map of the vectors by principal components; their signs are free, so there is no SQL."""
    return clustering.project(_v(t))


@query()
def kmeans(t: Tables) -> DataFrame:
    """The best of a sweep of K-Means fits; iterative, so there is no SQL."""
    return clustering.kmeans_sweep(_v(t), [4, 8, 10])[0]


@query()
def hdbscan(t: Tables) -> DataFrame:
    """Density clustering of all vectors; iterative, so there is no SQL."""
    return clustering.density_topics(t.embeddings.select(F.lit(0).alias("whole"), F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "whole").select("id", "topic")


def _centroids(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(id, centroid) of the active model's topics, and (stable_key, centroid), the newest of each key of other models."""
    last = t.active_clusters.where("centroid is not null").select("id", "centroid")
    old = t.clusters.join(F.broadcast(t.model_id), "model_id", "left_anti").where("stable_key is not null and centroid is not null")
    newest = old.withColumn("r", F.row_number().over(Window.partitionBy("stable_key").orderBy(F.desc("model_id"), "id"))).where("r = 1")
    return last, newest.select("stable_key", "centroid")


@query()
def stable_keys(t: Tables) -> DataFrame:
    """Topics of the active model, each with the older key whose centroid it matches, NULL for a new topic; greedy, so there is no SQL."""
    last, newest = _centroids(t)
    got = topics.matched_keys(last.select(F.col("id").alias("topic"), "centroid"), newest.select(F.col("stable_key").alias("key"), "centroid"))
    return last.select("id").join(got.select(F.col("topic").alias("id"), F.col("key").alias("stable_key")), "id", "left")


@query(f"""WITH unit AS (SELECT id, model_id, stable_key, list_transform(centroid::DOUBLE[], lambda x: x / sqrt(list_dot_product(centroid::DOUBLE[], centroid::DOUBLE[]))) AS c FROM clusters WHERE centroid IS NOT NULL),
    old AS (SELECT stable_key, arg_max(c, {{'m': model_id, 'i': -id}}) AS c FROM unit WHERE model_id <> {MODEL} AND stable_key IS NOT NULL GROUP BY stable_key)
    SELECT n.id::BIGINT AS id, round(max(list_dot_product(n.c, old.c)), 6) AS sim FROM unit n CROSS JOIN old WHERE n.model_id = {MODEL} GROUP BY n.id""")
def closest_keys(t: Tables) -> DataFrame:
    """How near each topic comes to any older key."""
    last, newest = _centroids(t)
    numbered = newest.select(F.xxhash64("stable_key").alias("topic"), normalised(F.col("centroid")).alias("centroid"))
    return topics.nearest(last.select("id", normalised(F.col("centroid")).alias("v")), numbered).select(F.col("id").cast("long").alias("id"), F.round("sim", 6).alias("sim"))


def usable_vectors(t: Tables) -> DataFrame:
    """(id, v): each article's latest vector, of full length, without NaN and not all zero."""
    v = F.col("embedding")
    ok = v.isNotNull() & (F.size(v) == 384) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    last = t.article_vectors.groupBy("article_id").agg(F.max_by("embedding", F.struct("created_at", "embedding")).alias("embedding"))
    return last.where(ok).select(F.col("article_id").alias("id"), F.col("embedding").alias("v"))


@query(f"""WITH latest AS (SELECT article_id AS id, arg_max(embedding, row(created_at, embedding))::DOUBLE[] AS v FROM article_vectors GROUP BY 1),
    u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM latest WHERE v IS NOT NULL AND len(v) = 384 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 AND list_dot_product(v, v) > 0),
    c AS (SELECT id AS cluster_id, list_transform(centroid::DOUBLE[], lambda x: x / sqrt(list_dot_product(centroid::DOUBLE[], centroid::DOUBLE[]))) AS c FROM clusters WHERE model_id = {MODEL} AND centroid IS NOT NULL),
    n AS (SELECT id, cluster_id, list_dot_product(v, c) AS sim FROM u CROSS JOIN c QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_dot_product(v, c) DESC, cluster_id) = 1)
    SELECT id, CASE WHEN sim >= least_sim THEN cluster_id::BIGINT END AS cluster_id, CASE WHEN sim >= least_sim THEN round(sim, 4) END AS score
    FROM n CROSS JOIN (SELECT coalesce(max(json_extract_string(params, '$.assign_threshold')::DOUBLE), 0.3) AS least_sim FROM cluster_models WHERE id = {MODEL}) p""")
def assign_articles(t: Tables) -> DataFrame:
    """All article vectors against the active model's topics; without a topic where none is near enough."""
    c = t.active_clusters.where(F.col("centroid").isNotNull()).select("id", "centroid")
    own = t.cluster_models.join(F.broadcast(t.model_id), F.col("id") == F.col("model_id")).select(F.get_json_object("params", "$.assign_threshold").cast("double").alias("x")).first()
    return model.assign(usable_vectors(t), c, topics.ASSIGN_FLOOR if own is None or own["x"] is None else own["x"]).withColumn("cluster_id", F.col("cluster_id").cast("long"))


@query()
def fit_topics(t: Tables) -> DataFrame:
    """A model fitted on all article vectors, its keys carried over from stored models; iterative, so there is no SQL."""
    terms = _terms(t, _words(t)).select("id", "term", "n")
    got = model.fit(usable_vectors(t), terms, t.clusters.select("id", "model_id", "centroid", "stable_key"), 7, 1_000_000)
    if got is None:
        return t.spark.createDataFrame([], "id int, label string, size int, stable_key string")
    return got.clusters.select("id", "label", "size", "stable_key")


@query()
def text_vectors(t: Tables) -> DataFrame:
    """Vectors of all articles without a downloaded model; the weights depend on a hash, so there is no SQL."""
    return embedding.hashed_embeddings(t.articles, "id", "title", "body")


# ---------------------------------------------------------------- events

@query("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(t: Tables) -> DataFrame:
    """Events per hour and type; the same function runs on a stream."""
    w = jobs.tumbling(t.events, "ts", "1 hour", ["event_type"], "2 hours", [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return w.select(F.unix_timestamp("window.start").alias("hour"), "event_type", "n", "total")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR > ts THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL),
    g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, epoch_us(min(ts)) // 1000000 AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def stream_session(t: Tables) -> DataFrame:
    """Sessions of users that end after six hours."""
    s = jobs.sessions(t.events.where(F.col("user_id").isNotNull()), "ts", "6 hours", ["user_id"], "1 day", [F.count("*").alias("n")])
    return s.select("user_id", F.unix_timestamp("session_window.start").alias("start"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    """Each user's first event of a type, passed on by a stream that remembers keys for ten years; what it wrote."""
    scratch = Scratch(t.spark, "once")
    stream = t.spark.readStream.schema(t.events.schema).parquet(f"{t.sf_dir}/[e]vents.parquet")
    first = jobs.once(stream, "ts", ["user_id", "event_type"], "3650 days").select("user_id", "event_type")
    run = first.writeStream.format("parquet").option("path", f"{scratch.root}/out").option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.schema(first.schema).parquet(f"{scratch.root}/out")


@query("SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS k, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def event_props(t: Tables) -> DataFrame:
    """A JSON value summed, and percentiles, per type."""
    return t.events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.round(F.percentile("value", F.lit(0.1)), 6).alias("p10"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90")
    )


# ---------------------------------------------------------------- relational


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(t: Tables) -> DataFrame:
    li = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n")
    )


@query("""SELECT n.n_name AS nation, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
    JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1""")
def revenue_by_nation(t: Tables) -> DataFrame:
    """A join over five tables: the small ones broadcast by their size, the large ones shuffled once."""
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    n = t.nation.join(t.region.select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey").select("n_nationkey", F.col("n_name").alias("nation"))
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(c.join(n, "n_nationkey"), "c_custkey").select("o_orderkey", "nation")
    li = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    return li.join(o, "o_orderkey").groupBy("nation").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("""SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2""")
def top_orders(t: Tables) -> DataFrame:
    """The two largest orders of each customer."""
    from tidemark.operators.merge import top_per

    o = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return top_per(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"), F.col("rn").cast("long").alias("rn"))


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey AS c_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') o USING (c_custkey)")
def customers_without_orders(t: Tables) -> DataFrame:
    """Customers that ordered nothing since 1998."""
    late = t.orders.where(F.col("o_orderdate") >= F.lit("1998-01-01").cast(dict(t.orders.dtypes)["o_orderdate"])).select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(late, "c_custkey", "left_anti")
