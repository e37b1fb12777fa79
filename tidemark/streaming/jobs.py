"""Structured Streaming: windows, bounded deduplication, and the ingest and assign loops."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import content_hash, word_count
from tidemark.functions.urls import canonical_url
from tidemark.operators import dedup, merge, topics
from tidemark.session import cut


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], late: str, aggregates: list[Column]) -> DataFrame:
    """Counts per time window and key; rows later than ``late`` are dropped when streaming."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(*aggregates)


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str, aggregates: list[Column]) -> DataFrame:
    """Sessions per key that end after a gap."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*aggregates)


def once(events: DataFrame, time: str, keys: list[str], within: str) -> DataFrame:
    """The first row of each key; keys are remembered for so long, so the state stays bounded."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def prepared(stream: DataFrame) -> DataFrame:
    """Arrivals with canonical address, content hash and word count."""
    return (
        stream.withColumn("canonical_url", canonical_url(F.coalesce("canonical_url", "url")))
        .withColumn("content_hash", F.coalesce("content_hash", content_hash(F.col("title"), F.col("body"))))
        .withColumn("word_count", word_count(F.col("body")))
    )


def ingest(stream: DataFrame, table: str, seen: str, checkpoint: str):
    """A query that appends unseen arrivals to one parquet folder and their addresses to another.

    Each micro-batch writes its own subfolder by overwriting, so a batch that is run again
    after a failure has the same result.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        new = prepared(df).dropDuplicates(["canonical_url"]).dropDuplicates(["content_hash"])
        known = _read_if_there(spark, seen, "canonical_url string, content_hash string, batch int").where(F.col("batch") != n)
        new = new.join(known.select("canonical_url"), "canonical_url", "left_anti").join(known.select("content_hash"), "content_hash", "left_anti")
        new.write.mode("overwrite").parquet(f"{table}/batch={n}")
        kept = spark.read.parquet(f"{table}/batch={n}")
        kept.select("canonical_url", "content_hash").write.mode("overwrite").parquet(f"{seen}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def near_duplicates(stream: DataFrame, kept: str, checkpoint: str, days: int = dedup.WINDOW_DAYS, distance: int = dedup.DISTANCE):
    """A query that keeps arrivals (k, simhash, seen_at) without a near-duplicate kept in the days before.

    The memory is the folder of kept values, of which only the window's batches are read; it is
    bounded by the window and not by the stream. A micro-batch overwrites its own subfolder.
    """

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        new = df.where(F.col("simhash").isNotNull()).select("k", "simhash", "seen_at").dropDuplicates(["k"])
        since = new.agg(F.min("seen_at").alias("t")).first()["t"]
        old = _read_if_there(spark, kept, "k long, simhash long, seen_at timestamp, batch int").where(F.col("batch") != n).select("k", "simhash", "seen_at")
        if since is not None:
            old = old.where(F.col("seen_at") >= F.lit(since) - F.expr(f"INTERVAL {days} DAYS"))
        both = cut(old.withColumn("first", F.lit(0)).unionByName(new.withColumn("first", F.lit(1))))
        # what is kept already goes before what is new, then by time
        order = F.struct("first", "seen_at", "k")
        pairs = dedup.near_pairs(both, "k", "simhash", distance)
        of = lambda c, s: both.select(F.col("k").alias(c), order.alias(f"o{s}"), F.col("seen_at").alias(f"t{s}"))
        j = pairs.join(of("a", 1), "a").join(of("b", 2), "b")
        turn = F.col("o1") > F.col("o2")
        edges = j.where(F.abs(F.unix_timestamp("t1") - F.unix_timestamp("t2")) <= days * 86400).where(~((F.col("o1.first") == 0) & (F.col("o2.first") == 0)))
        edges = edges.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"))
        again = dedup.keep_first(both.select("k"), edges)
        new.join(again.select("k"), "k", "left_anti").write.mode("overwrite").parquet(f"{kept}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_history(stream: DataFrame, live, history: str, checkpoint: str):
    """A query that merges live daily counts into a kept history after every micro-batch.

    ``live`` makes the counts of a batch's session (day, cluster_id, model_id, label,
    article_count, avg_sentiment). Versions are written beside each other; the merge is the
    same when it is run again, as counts only grow.
    """
    schema = "day date, cluster_id int, model_id int, label string, article_count long, avg_sentiment double, version int"

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        old = _read_if_there(spark, history, schema).where(F.col("version") == n - 1).drop("version")
        merge.merge_daily(old, live(df)).write.mode("overwrite").parquet(f"{history}/version={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception:  # no batch has been written yet
        return spark.createDataFrame([], schema)


def assign_stream(vectors: DataFrame, cents: DataFrame, threshold: float) -> DataFrame:
    """A stream of (id, v) with the topic of each row, NULL below the threshold.

    The centroids are a static table, counted and sent to the tasks as a matrix; rows whose
    vector is null or of another length have no result.
    """
    near = topics.nearest(vectors, cents)
    return near.select("id", F.when(F.col("sim") >= threshold, F.col("topic")).alias("topic"), F.when(F.col("sim") >= threshold, F.round("sim", 4)).alias("score"))


def roll(stream: DataFrame, store, name: str, cap: int, checkpoint: str, by: str = "id"):
    """A query that adds arrivals to a stored table and keeps its ``cap`` newest rows by ``by``.

    A micro-batch makes the table's next version; rows that are there already are not added, so a
    batch that is run again after a failure changes nothing.
    """

    def batch(df: DataFrame, n: int) -> None:
        now = merge.insert_if_absent(store.read(name), df.select(*store.read(name).columns), [by])
        store.write(name, merge.newest(cut(now), cap, by))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(step: Callable[[], DataFrame], most: int = 10_000) -> int:
    """Runs a step of a queue by status until it does nothing more; the rows it did in all."""
    done = 0
    for _ in range(most):
        n = step().count()
        done += n
        if not n:
            break
    return done


def repeat(job: Callable[[], object], minutes: float, most_runs: int | None = None, sleep: Callable[[float], None] = time.sleep, seed: int | None = None) -> list[object]:
    """Runs a job again and again, every so many minutes (five at least), a tenth more or less by chance.

    A run that fails is reported in the list as its exception, and the next one takes place all
    the same.
    """
    if minutes < 5:
        raise ValueError("runs are five minutes apart at least")
    chance, out = random.Random(seed), []
    while most_runs is None or len(out) < most_runs:
        try:
            out.append(job())
        except Exception as e:
            out.append(e)
        if most_runs is None or len(out) < most_runs:
            sleep(60 * minutes * chance.uniform(0.9, 1.1))
    return out
