"""Topics over time: live counts, kept history, growth, momentum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import merge
from tidemark.plans.base import ASSIGNED, DAY, MODEL, Tables, day, query

#: The range that the trend queries show; two halves are compared.
FROM, TO = "2026-03-01", "2026-04-30"
MAX_DAYS = 366
_DAYS_SQL = f"spine AS (SELECT CAST(unnest(generate_series(DATE '{FROM}', DATE '{TO}', INTERVAL 1 DAY)) AS DATE) AS day)"
_LIVE = f"""topic AS (SELECT id AS cluster_id, stable_key FROM clusters WHERE stable_key IS NOT NULL AND model_id = {MODEL}),
    dated AS (SELECT a.id AS article_id, {DAY} AS day FROM articles a SEMI JOIN sources ON sources.id = a.source_id WHERE a.duplicate_of IS NULL),
    live AS (SELECT day, stable_key, count(*) AS n FROM article_clusters JOIN topic USING (cluster_id) JOIN dated USING (article_id) WHERE day BETWEEN DATE '{FROM}' AND DATE '{TO}' GROUP BY ALL)"""
_LABELS = f"""flagged AS (SELECT c.*, c.model_id = now.id AS active FROM clusters c CROSS JOIN (SELECT {MODEL} AS id) now WHERE stable_key IS NOT NULL),
    newest AS (SELECT stable_key, max({{'active': active, 'model': model_id, 'minus': -id, 'label': label}}) AS m FROM flagged GROUP BY stable_key),
    label AS (SELECT stable_key, m.label AS label, -m.minus AS id, m.active AS active FROM newest)"""


def check_range(start: str, end: str) -> int:
    """Number of days of a range that may be asked for."""
    import datetime as dt

    n = (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days + 1
    if not 1 <= n <= MAX_DAYS:
        raise ValueError(f"a range has 1 to {MAX_DAYS} days")
    return n


def default_range(t: Tables, end: str | None = None, days: int = 14) -> tuple[str, str]:
    """The range shown when none is asked for: the last fourteen days that have articles, or of ``end``."""
    import datetime as dt

    if end is None:
        last = t.articles.agg(F.max(day()).alias("d")).first()["d"] or dt.date.today()
    else:
        last = dt.date.fromisoformat(end)
    return (last - dt.timedelta(days=days - 1)).isoformat(), last.isoformat()


def _in_range(d: Column, start: str, end: str) -> Column:
    return d.between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def live(t: Tables, start: str = FROM, end: str = TO, source: str | None = None) -> DataFrame:
    """(day, stable_key, n): articles of the active model's topics per day."""
    check_range(start, end)
    a = t.articles.where(F.col("duplicate_of").isNull() & _in_range(day(), start, end)).select(F.col("id").alias("article_id"), "source_id", day().alias("day"))
    s = t.sources.where(F.col("name") == source) if source else t.sources
    a = a.join(s.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    c = t.active_clusters.where(F.col("stable_key").isNotNull()).select(F.col("id").alias("cluster_id"), "stable_key")
    return a.join(t.article_clusters.select("article_id", "cluster_id"), "article_id").join(c, "cluster_id").groupBy("day", "stable_key").agg(F.count("*").alias("n"))


@query(f"WITH {_LIVE} SELECT CAST(day AS VARCHAR) AS day, stable_key, n FROM live")
def trends_live(t: Tables) -> DataFrame:
    return live(t).withColumn("day", F.col("day").cast("string"))


@query(f"SELECT CAST({DAY} AS VARCHAR) AS day, count(*) AS n FROM articles a JOIN sources s ON s.id = a.source_id WHERE a.duplicate_of IS NULL AND s.name = 'creasecourier' AND {DAY} BETWEEN DATE '{FROM}' AND DATE '{TO}' GROUP BY 1")
def trends_totals(t: Tables) -> DataFrame:
    """All articles of one source per day, in a topic or not."""
    s = t.sources.where("name = 'creasecourier'").select(F.col("id").alias("source_id"))
    a = t.articles.where(F.col("duplicate_of").isNull() & _in_range(day(), FROM, TO)).join(s, "source_id", "left_semi")
    return a.groupBy(day().cast("string").alias("day")).agg(F.count("*").alias("n"))


@query(f"WITH {_LABELS} SELECT stable_key, label, id::BIGINT AS id, active FROM label")
def latest_label(t: Tables) -> DataFrame:
    """The label of each stable key: the active model's, else the newest."""
    c = t.clusters.where(F.col("stable_key").isNotNull()).join(F.broadcast(t.model_id.withColumnRenamed("model_id", "now")))
    c = c.withColumn("active", F.col("model_id") == F.col("now"))
    return merge.first_per(c, ["stable_key"], [F.desc("active"), F.desc("model_id"), F.asc("id")]).select("stable_key", "label", F.col("id").cast("long").alias("id"), "active")


@query("""WITH k AS (SELECT stable_key, arg_max({'id': id, 'model_id': model_id, 'dim': len(centroid)}, {'m': model_id, 'i': -id}) AS c FROM clusters WHERE stable_key IS NOT NULL AND centroid IS NOT NULL GROUP BY ALL)
    SELECT stable_key, c.id AS id, c.model_id AS model_id, c.dim::BIGINT AS dim FROM k""")
def latest_centroid(t: Tables) -> DataFrame:
    """The newest centroid of each stable key over all models."""
    c = t.clusters.where(F.col("stable_key").isNotNull() & F.col("centroid").isNotNull())
    return merge.first_per(c, ["stable_key"], [F.desc("model_id"), F.asc("id")]).select("stable_key", "id", "model_id", F.size("centroid").cast("long").alias("dim"))


def halves(series: DataFrame, start: str, end: str) -> DataFrame:
    """Per stable key of (day, stable_key, n): total, the two halves of the range (an odd range drops its first day), change, growth in percent, is_new."""
    half = check_range(start, end) // 2
    back = F.datediff(F.lit(end).cast("date"), F.col("day"))
    some = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    s = series.groupBy("stable_key").agg(F.sum("n").alias("total"), some((back >= half) & (back < 2 * half)).alias("previous"), some(back < half).alias("recent"))
    change = F.col("recent") - F.col("previous")
    return s.select(
        "stable_key", "total", "previous", "recent", change.alias("change"),
        F.when(F.col("previous") != 0, F.round(100.0 * change / F.col("previous"), 1).cast("double")).alias("growth_pct"), ((F.col("previous") == 0) & (F.col("recent") > 0)).alias("is_new"),
    )


_HALF = "(DATE '{t}' - day)".format(t=TO)


@query(f"""WITH {_LIVE}, {_LABELS}, s AS (SELECT stable_key, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE {_HALF} >= 30 AND {_HALF} < 60), 0)::BIGINT AS previous, coalesce(sum(n) FILTER (WHERE {_HALF} < 30), 0)::BIGINT AS recent FROM live GROUP BY 1)
    SELECT s.stable_key, coalesce(l.label, s.stable_key) AS label, CASE WHEN l.active THEN l.id::BIGINT END AS cluster_id, total, previous, recent, recent - previous AS change,
    CASE WHEN previous <> 0 THEN round(100.0 * (recent - previous) / previous, 1)::DOUBLE END AS growth_pct, previous = 0 AND recent > 0 AS is_new FROM s LEFT JOIN label l USING (stable_key)""")
def trends_growth(t: Tables) -> DataFrame:
    """Each topic's later half of the range against the earlier one."""
    g = halves(live(t), FROM, TO).join(latest_label(t), "stable_key", "left")
    return g.select("stable_key", F.coalesce("label", "stable_key").alias("label"), F.when(F.col("active"), F.col("id")).alias("cluster_id"), "total", "previous", "recent", "change", "growth_pct", "is_new").orderBy(F.desc("total"), "label")


@query(f"""WITH {_LIVE}, {_DAYS_SQL}, keys AS (SELECT DISTINCT stable_key FROM live)
    SELECT k.stable_key, string_agg(coalesce(l.n, 0)::VARCHAR, ',' ORDER BY d.day) AS series FROM keys k CROSS JOIN spine d LEFT JOIN live l ON l.day = d.day AND l.stable_key = k.stable_key GROUP BY 1""")
def trends_series(t: Tables) -> DataFrame:
    """Each topic's counts for every day of the range, as one array aligned to the days."""
    at = F.datediff(F.col("day"), F.lit(FROM).cast("date"))
    m = live(t).groupBy("stable_key").agg(F.map_from_entries(F.collect_list(F.struct(at, "n"))).alias("by"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(check_range(FROM, TO) - 1)), lambda i: F.coalesce(F.element_at("by", i), F.lit(0)))
    return m.select("stable_key", F.array_join(dense.cast("array<string>"), ",").alias("series"))


@query(f"""WITH {_LIVE} SELECT CAST(date_trunc('week', day) AS DATE)::VARCHAR AS week, stable_key, sum(n)::BIGINT AS n FROM live GROUP BY 1, 2""")
def weekly_rollup(t: Tables) -> DataFrame:
    """Counts per week from Monday."""
    return live(t).groupBy(F.to_date(F.date_trunc("week", "day")).cast("string").alias("week"), "stable_key").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- history


def topic_days(t: Tables, until: str | None = None) -> DataFrame:
    """(day, cluster_id, model_id, label, article_count, avg_sentiment) of the stored articles; the mood is the mean topic score here, as no mood is stored."""
    a = t.articles.select(F.col("id").alias("article_id"), "source_id", day().alias("day"))
    if until:
        a = a.where(F.col("day") <= F.lit(until).cast("date"))
    a = a.join(t.sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    c = t.active_clusters.select(F.col("id").alias("cluster_id"), "model_id", "label")
    score = F.when(~F.isnan("score"), F.col("score").cast("double"))
    ac = t.article_clusters.select("article_id", "cluster_id", score.alias("score"))
    return a.join(ac, "article_id").join(c, "cluster_id").groupBy("day", "cluster_id", "model_id", "label").agg(F.count("*").alias("article_count"), F.round(F.avg("score"), 6).alias("avg_sentiment"))


def _topic_days_sql(where: str = "TRUE") -> str:
    return f"""SELECT {DAY} AS day, c.id AS cluster_id, c.model_id, c.label, count(*) AS article_count, round(avg(CASE WHEN isnan(ac.score) THEN NULL ELSE ac.score::DOUBLE END), 6) AS avg_sentiment
        FROM articles a JOIN sources s ON s.id = a.source_id JOIN article_clusters ac ON ac.article_id = a.id JOIN clusters c ON c.id = ac.cluster_id AND c.model_id = {MODEL} WHERE {where} GROUP BY 1, 2, 3, 4"""


_SHOW = "CAST(day AS VARCHAR) AS day, cluster_id::BIGINT AS cluster_id, label, article_count, avg_sentiment"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.col("day").cast("string").alias("day"), F.col("cluster_id").cast("long").alias("cluster_id"), "label", "article_count", "avg_sentiment")


@query(f"SELECT {_SHOW} FROM ({_topic_days_sql()})")
def topic_daily(t: Tables) -> DataFrame:
    """Live counts and mean score per day and topic."""
    return _shown(topic_days(t))


def _half_gone(t: Tables) -> DataFrame:
    """A kept history: counts doubled on even days, which the live table has lost since."""
    h = topic_days(t, "2026-03-31")
    return h.withColumn("article_count", F.when(F.dayofmonth("day") % 2 == 0, F.col("article_count") * 2).otherwise(F.col("article_count") - 1)).withColumn("avg_sentiment", F.lit(0.25)).withColumn("label", F.concat(F.lit("old "), "label"))


_HISTORY = f"""live AS ({_topic_days_sql(f"{DAY} >= DATE '2026-02-01'")}), history AS (SELECT day, cluster_id, model_id, 'old ' || label AS label,
    CASE WHEN day(day) % 2 = 0 THEN article_count * 2 ELSE article_count - 1 END AS article_count, 0.25::DOUBLE AS avg_sentiment FROM ({_topic_days_sql(f"{DAY} <= DATE '2026-03-31'")}))"""


@query(f"""WITH {_HISTORY}, merged AS (SELECT coalesce(l.day, h.day) AS day, coalesce(l.cluster_id, h.cluster_id) AS cluster_id, CASE WHEN l.day IS NULL THEN h.label ELSE l.label END AS label,
    greatest(coalesce(l.article_count, h.article_count), coalesce(h.article_count, l.article_count)) AS article_count,
    CASE WHEN h.day IS NULL OR l.article_count >= h.article_count THEN l.avg_sentiment ELSE h.avg_sentiment END AS avg_sentiment
    FROM live l FULL OUTER JOIN history h ON h.day = l.day AND h.cluster_id = l.cluster_id) SELECT {_SHOW} FROM merged""")
def refresh_daily_stats(t: Tables) -> DataFrame:
    """The kept history merged with live counts: counts never shrink."""
    recent = topic_days(t).where(F.col("day") >= F.lit("2026-02-01").cast("date"))
    return _shown(merge.merge_daily(_half_gone(t), recent))


@query(f"""WITH dated AS (SELECT a.id AS article_id, {DAY} AS day FROM articles a), counted AS (SELECT cluster_id, day, count(*) AS n FROM article_clusters JOIN dated USING (article_id) GROUP BY ALL),
    keyed AS (SELECT id AS cluster_id, stable_key, model_id FROM clusters WHERE stable_key IS NOT NULL)
    SELECT CAST(day AS VARCHAR) AS day, stable_key, arg_max(n, {{'m': model_id, 'c': -cluster_id}}) AS n FROM counted JOIN keyed USING (cluster_id) GROUP BY day, stable_key""")
def history_dedupe(t: Tables) -> DataFrame:
    """Of several models' counts of a day and stable key, the newest model's."""
    a = t.articles.select(F.col("id").alias("article_id"), day().alias("day"))
    d = t.article_clusters.select("article_id", "cluster_id").join(a, "article_id").groupBy("cluster_id", "day").agg(F.count("*").alias("n"))
    c = t.clusters.where(F.col("stable_key").isNotNull()).select(F.col("id").alias("cluster_id"), "stable_key", "model_id")
    h = d.join(c, "cluster_id")
    return merge.first_per(h, ["day", "stable_key"], [F.desc("model_id"), F.asc("cluster_id")]).select(F.col("day").cast("string").alias("day"), "stable_key", "n")


_COVER = "DATE '2026-03-16'"


@query(f"""WITH {_LIVE}, hist AS (SELECT {DAY} AS day, c.stable_key, c.model_id, count(*) AS n FROM articles a JOIN article_clusters ac ON ac.article_id = a.id JOIN clusters c ON c.id = ac.cluster_id WHERE c.stable_key IS NOT NULL AND {DAY} >= DATE '{FROM}' AND {DAY} < {_COVER} GROUP BY 1, 2, 3),
    u AS (SELECT day, stable_key, n FROM live WHERE day >= {_COVER} UNION ALL SELECT day, stable_key, n FROM hist QUALIFY row_number() OVER (PARTITION BY day, stable_key ORDER BY model_id DESC) = 1)
    SELECT stable_key, sum(n)::BIGINT AS n, count(*) AS days FROM u GROUP BY 1""")
def trends_with_history(t: Tables) -> DataFrame:
    """Live counts from the day that stored articles begin, kept counts before it."""
    cover = F.lit("2026-03-16").cast("date")
    a = t.articles.select(F.col("id").alias("article_id"), day().alias("day")).where((F.col("day") >= F.lit(FROM).cast("date")) & (F.col("day") < cover))
    c = t.clusters.where(F.col("stable_key").isNotNull()).select(F.col("id").alias("cluster_id"), "stable_key", "model_id")
    h = a.join(t.article_clusters.select("article_id", "cluster_id"), "article_id").join(c, "cluster_id").groupBy("day", "stable_key", "model_id").agg(F.count("*").alias("n"))
    h = merge.first_per(h, ["day", "stable_key"], [F.desc("model_id")]).select("day", "stable_key", "n")
    return live(t).where(F.col("day") >= cover).unionByName(h).groupBy("stable_key").agg(F.sum("n").alias("n"), F.count("*").alias("days"))


# ---------------------------------------------------------------- momentum


@query(f"""WITH d AS ({_topic_days_sql()}), s AS (SELECT c.stable_key, d.day, d.article_count, d.avg_sentiment FROM d JOIN clusters c ON c.id = d.cluster_id WHERE c.stable_key IS NOT NULL),
    m AS (SELECT stable_key, coalesce(sum(article_count) FILTER (WHERE day >= DATE '2026-04-28'), 0)::BIGINT AS recent, coalesce(sum(article_count) FILTER (WHERE day >= DATE '2026-04-14' AND day < DATE '2026-04-28'), 0)::BIGINT AS before,
    avg(avg_sentiment) FILTER (WHERE day >= DATE '2026-04-28') AS mood FROM s GROUP BY 1)
    SELECT stable_key, recent, before, round((recent + 1) / (before / 14.0 * 3 + 1), 2)::DOUBLE AS growth, before = 0 AND recent > 0 AS is_new, round(mood, 3) AS recent_sentiment FROM m WHERE recent > 0 OR before > 0""")
def rising_topics(t: Tables) -> DataFrame:
    """Recent days against the rate of the days before: growth above 1 is a topic that rises."""
    d = topic_days(t).join(t.clusters.where(F.col("stable_key").isNotNull()).select(F.col("id").alias("cluster_id"), "stable_key"), "cluster_id")
    start, base = F.lit("2026-04-28").cast("date"), F.lit("2026-04-14").cast("date")
    now, old = F.col("day") >= start, (F.col("day") >= base) & (F.col("day") < start)
    m = d.groupBy("stable_key").agg(
        F.coalesce(F.sum(F.when(now, F.col("article_count"))), F.lit(0)).alias("recent"), F.coalesce(F.sum(F.when(old, F.col("article_count"))), F.lit(0)).alias("before"), F.avg(F.when(now, F.col("avg_sentiment"))).alias("mood")
    )
    growth = F.round((F.col("recent") + 1) / (F.col("before") / F.lit(14.0) * 3 + 1), 2)
    return (
        m.where("recent > 0 or before > 0")
        .select("stable_key", "recent", "before", growth.alias("growth"), ((F.col("before") == 0) & (F.col("recent") > 0)).alias("is_new"), F.round("mood", 3).alias("recent_sentiment"))
        .orderBy(F.desc("growth"), F.desc("recent"), "stable_key")
    )


@query(f"""WITH {_LIVE}, r AS (SELECT stable_key, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE {_HALF} < 30), 0) - coalesce(sum(n) FILTER (WHERE {_HALF} >= 30 AND {_HALF} < 60), 0) AS change FROM live GROUP BY 1)
    SELECT DISTINCT stable_key FROM ((SELECT stable_key FROM r ORDER BY total DESC, stable_key LIMIT 12) UNION ALL (SELECT stable_key FROM r WHERE change > 0 ORDER BY change DESC, stable_key LIMIT 3))""")
def shown_topics(t: Tables) -> DataFrame:
    """What a chart shows: the twelve largest topics and the three that rise most."""
    h = halves(live(t), FROM, TO)
    big = h.orderBy(F.desc("total"), "stable_key").limit(12).select("stable_key")
    up = h.where("change > 0").orderBy(F.desc("change"), "stable_key").limit(3).select("stable_key")
    return big.unionByName(up).distinct()


# ---------------------------------------------------------------- fit window


@query(f"""WITH {ASSIGNED} SELECT count(*) AS window_articles, count(DISTINCT a.source_id) AS sources FROM articles a JOIN (SELECT DISTINCT article_id FROM article_vectors WHERE embedding IS NOT NULL) v ON v.article_id = a.id
    WHERE a.duplicate_of IS NULL AND a.status IN ('vectorized', 'clustered') AND a.scraped_at >= TIMESTAMPTZ '2026-05-01 00:00:00+00' - INTERVAL 90 DAY""")
def fit_window(t: Tables) -> DataFrame:
    """Articles of the last 90 days that a model would be fitted on."""
    return window_rows(t).agg(F.count("*").alias("window_articles"), F.countDistinct("source_id").alias("sources"))


def window_rows(t: Tables) -> DataFrame:
    from tidemark.plans.base import as_of

    a = t.articles.where(F.col("duplicate_of").isNull() & F.col("status").isin("vectorized", "clustered") & (F.col("scraped_at") >= as_of() - F.expr("INTERVAL 90 DAYS")))
    return a.join(t.article_vectors.where(F.col("embedding").isNotNull()).select(F.col("article_id").alias("id")), "id", "left_semi")


@query(f"""WITH {ASSIGNED}, m AS (SELECT max(created_at) AS t FROM cluster_models WHERE is_active)
    SELECT count(*) FILTER (WHERE x.id IS NULL AND a.scraped_at > (SELECT t FROM m)) AS emerging, count(*) FILTER (WHERE x.id IS NOT NULL) AS assigned FROM articles a LEFT JOIN assigned x ON x.id = a.id WHERE a.status = 'clustered'""")
def refit_inputs(t: Tables) -> DataFrame:
    """Articles that came since the model's fit and joined no topic, and those in topics."""
    m = t.cluster_models.where("is_active").agg(F.max("created_at").alias("fitted"))
    a = t.articles.where(F.col("status") == "clustered").join(t.assigned.select("id", F.lit(True).alias("in_topic")), "id", "left").join(F.broadcast(m))
    new = F.col("scraped_at") > F.col("fitted")
    return a.agg(F.count_if(F.col("in_topic").isNull() & new).alias("emerging"), F.count_if(F.col("in_topic")).alias("assigned"))


@query(f"""WITH v AS (SELECT count(DISTINCT article_id) AS n, max(article_id) AS m FROM article_vectors), p AS (SELECT count(*) AS n, max(id) AS m FROM articles WHERE status = 'clustered')
    SELECT v.n <> p.n OR v.m <> p.m AS stale FROM v CROSS JOIN p""")
def stale_map(t: Tables) -> DataFrame:
    """Whether a stored map (here: of clustered articles) misses vectors."""
    v = t.article_vectors.agg(F.countDistinct("article_id").alias("n"), F.max("article_id").alias("m"))
    p = t.articles.where(F.col("status") == "clustered").agg(F.count("*").alias("n2"), F.max("id").alias("m2"))
    return v.join(F.broadcast(p)).select(((F.col("n") != F.col("n2")) | (F.col("m") != F.col("m2"))).alias("stale"))


@query(f"""SELECT c.stable_key, count(*) AS articles, row_number() OVER (ORDER BY count(*) DESC, c.stable_key) AS place FROM article_clusters ac JOIN clusters c ON c.id = ac.cluster_id WHERE c.model_id = {MODEL} AND c.stable_key IS NOT NULL GROUP BY 1""")
def topic_places(t: Tables) -> DataFrame:
    """Topics by size; the window is over one row per topic of a model."""
    n = t.article_clusters.join(t.active_clusters.where(F.col("stable_key").isNotNull()).select(F.col("id").alias("cluster_id"), "stable_key"), "cluster_id").groupBy("stable_key").agg(F.count("*").alias("articles"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("articles"), "stable_key")).cast("long"))
