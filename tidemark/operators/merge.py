"""Writes as merges: parquet tables have no upsert, so each returns the table's next version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_if_absent(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key the table lacks are added; of equal new keys one is kept."""
    fresh = new.join(table.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return table.unionByName(fresh)


def upsert(table: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Rows of either side by key; where both have one, a rule (old, new) gives a column, else the new value wins."""
    rules = rules or {}
    values = [c for c in table.columns if c not in keys]
    o = table.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in values], F.lit(True).alias("_o"))
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in values], F.lit(True).alias("_n"))
    both = F.col("_o").isNotNull() & F.col("_n").isNotNull()

    def value(c: str) -> Column:
        old, fresh = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        merged = rules[c](old, fresh) if c in rules else fresh
        return F.when(both, merged).when(F.col("_n").isNotNull(), fresh).otherwise(old).alias(c)

    return o.join(n, keys, "full_outer").select(*keys, *map(value, values))


def keep_old_if_null(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


def keep_old_if_blank(old: Column, new: Column) -> Column:
    return F.when(F.trim(F.coalesce(new, F.lit(""))) != "", new).otherwise(old)


def merge_daily(history: DataFrame, live: DataFrame) -> DataFrame:
    """Daily topic counts that never shrink: the larger count, the newer label, and the sentiment of the larger-or-equal new count.

    Columns day, cluster_id, model_id, label, article_count, avg_sentiment.
    """
    o = history.select("day", "cluster_id", *[F.col(c).alias(f"_o_{c}") for c in ("model_id", "label", "article_count", "avg_sentiment")])
    both = live.select("day", "cluster_id", "model_id", "label", "article_count", "avg_sentiment").join(o, ["day", "cluster_id"], "full_outer")
    grew = F.col("_o_article_count").isNull() | (F.col("article_count") >= F.col("_o_article_count"))
    return both.select(
        "day",
        "cluster_id",
        F.coalesce("model_id", "_o_model_id").alias("model_id"),
        F.when(F.col("article_count").isNull(), F.col("_o_label")).otherwise(F.col("label")).alias("label"),
        F.greatest("article_count", "_o_article_count").alias("article_count"),
        F.when(grew, F.col("avg_sentiment")).otherwise(F.col("_o_avg_sentiment")).alias("avg_sentiment"),
    )


def highest(table: DataFrame, cap: int, value: Column, order: list[Column], most: int = 50_000) -> DataFrame:
    """The ``cap`` rows of highest ``value`` (a whole number; null is lowest), ties in the given order.

    Counts by ranges of the value, narrowed around the cap, give the bound above which all rows
    stay; only the rows of the last range, as a rule ``most`` at most, are sorted and cut.
    """
    if cap <= 0:
        return table.limit(0)
    rows = table.withColumn("_value", value.cast("long"))
    there = rows.agg(F.min("_value").alias("lo"), F.max("_value").alias("hi"), F.count("_value").alias("n")).first()
    if there["n"] <= cap:
        rest = cap - there["n"]
        none = rows.where("_value is null")
        none = (none.orderBy(*order) if order else none).limit(rest) if rest else rows.limit(0)
        return rows.where("_value is not null").unionByName(none).drop("_value")
    lo, hi, need, inside = there["lo"], there["hi"], cap, there["n"]
    while inside > most and hi > lo:
        width = (hi - lo) // 1_024 + 1
        part = F.expr(f"(_value - {lo}) div {width}")
        counts = {r["p"]: r["n"] for r in rows.where(F.col("_value").between(lo, hi)).groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
        for p in sorted(counts, reverse=True):
            if counts[p] >= need:
                lo, hi, inside = lo + p * width, min(hi, lo + (p + 1) * width - 1), counts[p]
                break
            need -= counts[p]
    last = rows.where(F.col("_value").between(lo, hi)).orderBy(F.desc("_value"), *order).limit(need)
    return rows.where(F.col("_value") > hi).unionByName(last).drop("_value")


def newest(table: DataFrame, cap: int, by: str = "id") -> DataFrame:
    """The ``cap`` rows of highest ``by``: survivors of a rolling cap."""
    return highest(table, cap, F.col(by), [])


def most_recent(table: DataFrame, cap: int, time: str = "seen_at", tie: str = "url") -> DataFrame:
    """The ``cap`` rows seen last; ties by the smaller key."""
    return highest(table, cap, F.unix_micros(F.col(time).cast("timestamp")), [F.col(tie)])


def cascade(child: DataFrame, parents: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Child rows whose parent still exists."""
    return child.join(parents.select(F.col(parent_key).alias(key)), key, "left_semi")


def advance(table: DataFrame, ids: DataFrame, source: str, to: str, key: str = "id") -> DataFrame:
    """Compare-and-set: rows in ``ids`` that still have the source status get the next one."""
    hit = ids.select(F.col(key), F.lit(True).alias("_hit")).distinct()
    new = F.when(F.col("_hit") & (F.col("status") == source), F.lit(to)).otherwise(F.col("status"))
    return table.join(hit, key, "left").withColumn("status", new).drop("_hit")


def activate(models: DataFrame, model_id: int) -> DataFrame:
    """Exactly the given model is active."""
    return models.withColumn("is_active", F.col("id") == model_id)


def keep_models(assignments: DataFrame, clusters: DataFrame, models: DataFrame, n: int = 3) -> DataFrame:
    """Assignments of the n newest models only."""
    kept = models.orderBy(F.desc("id")).limit(n).select(F.col("id").alias("model_id"))
    alive = clusters.join(F.broadcast(kept), "model_id", "left_semi").select(F.col("id").alias("cluster_id"))
    return assignments.join(alive, "cluster_id", "left_semi")


def with_sizes(clusters: DataFrame, assignments: DataFrame) -> DataFrame:
    """Cluster sizes counted again; empty clusters have 0."""
    n = assignments.groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").cast("int").alias("_n"))
    return clusters.join(n, "id", "left").withColumn("size", F.coalesce("_n", F.lit(0))).drop("_n")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order: DISTINCT ON."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first n rows per key with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)
