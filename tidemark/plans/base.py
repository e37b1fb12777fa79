"""Tables of a query, the active model, and how queries are registered."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import language
from tidemark.session import Scratch, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Where the language stage's tables are, by application and folder.
_STORED: dict = {}
#: "Now" of the queries: the test data end the day before.
AS_OF = "2026-05-01 00:00:00"
#: Words that keyword and topic queries leave out.
STOPS = ("the", "and", "was", "for", "that", "with", "from", "has", "had", "his", "her", "its", "who", "one", "are", "but", "not", "they", "after", "this", "have", "over", "off", "you", "your", "against", "which", "says", "said", "will")


def query(sql: str | None = None, name: str | None = None):
    """Registers a function of (tables) under its name, with the SQL that says the same."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        QUERIES[key].__doc__ = f.__doc__
        if sql is not None:
            ORACLE[key] = sql
        return f

    return add


def day(published: str = "published_at", scraped: str = "scraped_at") -> Column:
    """UTC date of publication, or of collection where that is missing."""
    return F.to_date(F.coalesce(F.col(published), F.col(scraped)))


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


#: The same in SQL.
DAY = "CAST(coalesce(a.published_at, a.scraped_at) AT TIME ZONE 'UTC' AS DATE)"
NOW = f"TIMESTAMPTZ '{AS_OF}+00'"
MODEL = "coalesce((SELECT max(id) FROM cluster_models WHERE is_active), -1)"


class Tables:
    """The tables of a folder as attributes; columns are read only where they are used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        setattr(self, name, df)
        return df

    @cached_property
    def model_id(self) -> DataFrame:
        """One row: the active model's id, -1 if there is none."""
        return self.cluster_models.agg(F.coalesce(F.max(F.when(F.col("is_active"), F.col("id"))), F.lit(-1)).alias("model_id"))

    @cached_property
    def active_clusters(self) -> DataFrame:
        """Clusters of the active model: few, as one model's topics are."""
        return self.clusters.join(F.broadcast(self.model_id), "model_id", "left_semi")

    @cached_property
    def assigned(self) -> DataFrame:
        """(id, topic_id, topic_label, topic_score): each article's topic under the active model, the best and then smallest if it has several."""
        ac = self.article_clusters.where(F.col("article_id").isNotNull()).select("article_id", "cluster_id", "score")
        j = ac.join(self.active_clusters.select(F.col("id").alias("cluster_id"), "label"), "cluster_id")
        score = F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(-1.0)), F.lit(-1.0))
        best = j.groupBy("article_id").agg(F.max(F.struct(score.alias("s"), (-F.col("cluster_id")).alias("c"), "label")).alias("m"))
        return best.select(
            F.col("article_id").alias("id"), (-F.col("m.c")).alias("topic_id"), F.col("m.label").alias("topic_label"), F.when(F.col("m.s") >= 0, F.col("m.s")).alias("topic_score")
        )

    @cached_property
    def article_nlp(self) -> DataFrame:
        """(article_id, keywords): keywords of stored articles, made once per application and folder and kept as a table, as the language stage keeps them."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _STORED:
            made = language.keywords(self.bodies, "id", "body", list(STOPS)).withColumnRenamed("id", "article_id")
            _STORED[key] = Scratch(self.spark, "nlp").write(made), made.schema
        path, schema = _STORED[key]
        return self.spark.read.schema(schema).parquet(path)

    @cached_property
    def bodies(self) -> DataFrame:
        """(id, source_id, body) of articles, spread for work on their words."""
        return spread(self.articles.select("id", "source_id", "body"), "id")


#: ``Tables.assigned`` in SQL.
ASSIGNED = f"""assigned AS (
    SELECT article_id AS id, cluster_id AS topic_id, label AS topic_label, CASE WHEN s >= 0 THEN s END AS topic_score FROM (
        SELECT ac.article_id, ac.cluster_id, c.label, coalesce(CASE WHEN isnan(ac.score) THEN -1 ELSE ac.score::DOUBLE END, -1) AS s,
               row_number() OVER (PARTITION BY ac.article_id ORDER BY coalesce(CASE WHEN isnan(ac.score) THEN -1 ELSE ac.score::DOUBLE END, -1) DESC, ac.cluster_id) AS rn
        FROM article_clusters ac JOIN clusters c ON c.id = ac.cluster_id WHERE c.model_id = {MODEL} AND ac.article_id IS NOT NULL) WHERE rn = 1)"""
_STOPS = ", ".join(f"'{w}'" for w in STOPS)


def clean_sql(text: str) -> str:
    """``functions.text.clean_text`` in SQL."""
    from tidemark.functions.text import FURNITURE_OPENINGS

    space = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
    for pattern, to in (
        (r"https?://\S+|www\.\S+", " "), (r"\S+@\S+\.\w+", " "), (rf"(?im)^\s*(?:{FURNITURE_OPENINGS}).*$", ""), ("\u00a0", " "), ("[‘’]", "''"),
        (r"[ \t]+", " "), (r"\n\s*\n+", "\n"), (f"^{space}+|{space}+$", ""),
    ):
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return text


KEYWORDS = rf"""token AS (
        SELECT id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (
            SELECT id, list_filter(regexp_extract_all(lower(left({clean_sql('body')}, 8000)), '[a-z][a-z0-9]+'), lambda w: len(w) >= 3 AND w NOT IN ({_STOPS})) AS t
            FROM articles WHERE id IS NOT NULL)),
    keyword AS (
        SELECT id, list(term ORDER BY rn) AS keywords FROM (
            SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, min(pos), term) AS rn FROM token GROUP BY id, term)
        WHERE rn <= 10 GROUP BY id)"""
