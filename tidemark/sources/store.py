"""Tables on disk: schemas, JSON lines, and a database of parquet tables."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut

# The tables of the pipeline.
SCHEMAS = {
    "sources": "id INT, name STRING, base_url STRING, last_crawled_at TIMESTAMP",
    "articles": "id LONG, source_id INT, url STRING, canonical_url STRING, title STRING, author STRING, published_at TIMESTAMP, scraped_at TIMESTAMP, body STRING, word_count INT, content_hash STRING, simhash LONG, duplicate_of LONG, status STRING, image_url STRING",
    "seen_articles": "url STRING, outcome STRING, content_hash STRING, seen_at TIMESTAMP",
    "crawl_runs": "id LONG, source_id INT, started_at TIMESTAMP, finished_at TIMESTAMP, found INT, inserted INT, skipped INT, duplicates INT, errors INT, details MAP<STRING,STRING>",
    "article_nlp": "article_id LONG, lemmas STRING, sentiment FLOAT, entities MAP<STRING,MAP<STRING,INT>>, keywords ARRAY<STRING>, processed_at TIMESTAMP",
    "article_vectors": "article_id LONG, model STRING, embedding ARRAY<FLOAT>, created_at TIMESTAMP",
    "cluster_models": "id INT, created_at TIMESTAMP, algorithm STRING, params STRING, n_clusters INT, silhouette FLOAT, is_active BOOLEAN",
    "clusters": "id INT, model_id INT, label STRING, top_terms STRUCT<terms:ARRAY<STRING>,entities:MAP<STRING,ARRAY<STRING>>,coherence_npmi:DOUBLE>, centroid ARRAY<FLOAT>, size INT, stable_key STRING",
    "article_clusters": "article_id LONG, cluster_id INT, score FLOAT, assigned_at TIMESTAMP",
    "article_projection": "article_id LONG, method STRING, x FLOAT, y FLOAT, computed_at TIMESTAMP",
    "topic_daily_stats": "day DATE, model_id INT, cluster_id INT, label STRING, article_count LONG, avg_sentiment FLOAT, updated_at TIMESTAMP",
}


class Folder:
    """Tables as versions in a folder that all executors share.

    A write makes the next version, which holds once Spark has committed it; readers keep the
    one they began with. ``append`` adds files to the newest version. Tables that were never
    written are empty. ``keep`` older versions stay for readers.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _versions(self, name: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        done = [f.getPath() for f in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done if p.getName().isdigit())

    def read(self, name: str) -> DataFrame:
        have = self._versions(name)
        if not have:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}/{have[-1]}")

    def _ready(self, name: str, df: DataFrame) -> DataFrame:
        like = self.spark.createDataFrame([], SCHEMAS[name])
        return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in like.dtypes])

    def write(self, name: str, df: DataFrame) -> None:
        have = self._versions(name)
        self._ready(name, df).write.mode("overwrite").parquet(f"{self.root}/{name}/{(have[-1] if have else 0) + 1}")
        jvm = self.spark.sparkContext._jvm
        for old in have[: -self.keep] if self.keep else have:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{old}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def append(self, name: str, df: DataFrame) -> None:
        have = self._versions(name)
        self._ready(name, df).write.mode("append").parquet(f"{self.root}/{name}/{have[-1] if have else 1}")


class Database:
    """The same over the tables of a catalogue's database."""

    def __init__(self, spark: SparkSession, database: str):
        self.spark, self.database = spark, database
        create_tables(spark, database)

    def read(self, name: str) -> DataFrame:
        return self.spark.table(f"`{self.database}`.`{name}`")

    def write(self, name: str, df: DataFrame) -> None:
        # computed first, as it may read the table that it replaces
        cut(df.select(*self.read(name).columns)).write.insertInto(f"`{self.database}`.`{name}`", overwrite=True)

    def append(self, name: str, df: DataFrame) -> None:
        cut(df.select(*self.read(name).columns)).write.insertInto(f"`{self.database}`.`{name}`")


def make_store(kind: str, spark: SparkSession, where: str) -> Folder | Database:
    """A store by its kind: "folder" or "database"."""
    if kind not in ("folder", "database"):
        raise ValueError('a store is a "folder" or a "database"')
    return Folder(spark, where) if kind == "folder" else Database(spark, where)


def log_run(store: Folder | Database, rows: DataFrame) -> None:
    """Runs are only ever added to."""
    store.append("crawl_runs", rows)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; the commit of a Spark write is what makes it all or nothing."""
    df.write.mode("append" if append else "overwrite").json(path)


def create_tables(spark: SparkSession, database: str) -> None:
    """The pipeline's tables in a database; those that exist stay as they are."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, columns in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet")


def table_counts(spark: SparkSession, database: str) -> DataFrame:
    """(table, rows) of every table of a database; temporary views are none."""
    parts = [spark.table(f"`{database}`.`{t.name}`").agg(F.lit(t.name).alias("table"), F.count("*").alias("rows")) for t in spark.catalog.listTables(database) if not t.isTemporary]
    if not parts:
        return spark.createDataFrame([], "table string, rows long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_self_healed(seen: DataFrame, articles: DataFrame) -> DataFrame:
    """Seen addresses, with those of stored articles that the memory lacks."""
    lost = articles.select(F.col("canonical_url").alias("url"), F.lit("stored").alias("outcome"), "content_hash", F.col("scraped_at").alias("seen_at"))
    return seen.unionByName(lost.join(seen.select("url"), "url", "left_anti").select(*seen.columns))


def update_status(path: str, **fields) -> dict:
    """A small JSON status file of the driver with some fields replaced, written whole or not at all."""
    now = {}
    if os.path.exists(path):
        with open(path) as f:
            now = json.load(f)
    now |= fields
    folder = os.path.dirname(os.path.abspath(path))
    fd, tmp = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w") as f:
        json.dump(now, f, default=str)
    os.replace(tmp, path)
    return now


class Lock:
    """One writer at a time: a lock file that others may take over when it is older than three hours."""

    def __init__(self, path: str, stale_s: float = 3 * 3600):
        self.path, self.stale_s, self.held = path, stale_s, False

    def __enter__(self) -> bool:
        for _ in range(2):
            try:
                os.close(os.open(self.path, os.O_CREAT | os.O_EXCL))
                self.held = True
                return True
            except FileExistsError:
                try:
                    if time.time() - os.path.getmtime(self.path) <= self.stale_s:
                        return False
                    os.unlink(self.path)
                except FileNotFoundError:
                    pass
        return False

    def __exit__(self, *_) -> None:
        if self.held:
            os.unlink(self.path)
            self.held = False


def recent_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    """(started_at, new): the last n runs, oldest first, with each source's inserted articles as a map."""
    per = runs.groupBy("started_at").agg(F.map_from_entries(F.collect_list(F.struct("source_id", "inserted"))).alias("new"))
    return per.orderBy(F.desc("started_at")).limit(n).orderBy("started_at")


def last_good_crawl(runs: DataFrame) -> DataFrame:
    """One row: when a run last ended without failing."""
    ok = F.col("finished_at").isNotNull() & F.get(F.transform(F.array("details"), lambda d: F.element_at(d, "failed")), F.lit(0)).isNull()
    return runs.where(ok).agg(F.max("finished_at").alias("last_crawl"))
