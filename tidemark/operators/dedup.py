"""Copies of records within a stream of arrivals: by address, by content, by SimHash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.simhash import bands, block_pairs, hamming

DISTANCE = 3
WINDOW_DAYS = 7


def unseen(candidates: DataFrame, seen: DataFrame, key: str = "canonical_url", seen_key: str = "url") -> DataFrame:
    """Candidates whose address was never handled."""
    return candidates.join(seen.select(F.col(seen_key).alias(key)).distinct(), key, "left_anti")


def exact_duplicates(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, first_key): rows whose content hash an earlier row has.

    First rows are found by an aggregate that combines before it shuffles, and only hashes of
    several rows are joined back, so a hash that very many rows share (as that of the empty text)
    is never gathered.
    """
    rows = df.where(F.col(content).isNotNull()).select(key, F.col(content).alias("_content"))
    first = rows.groupBy("_content").agg(F.min(key).alias("first_key"), F.count("*").alias("_n")).where("_n > 1").select("_content", "first_key")
    return rows.join(first, "_content").where(F.col(key) > F.col("first_key")).select(key, "first_key")


def near_pairs(df: DataFrame, key: str, value: str, distance: int = DISTANCE) -> DataFrame:
    """(a, b, d), a < b: pairs of rows within the distance, by common keys of distinct values.

    Up to three bits the keys are ten pairs of blocks, of 25 or 26 bits; beyond, bands. Rows are
    joined back to their values afterwards, so the result alone grows with copies.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"))
    keys = block_pairs(F.col("v")) if distance <= 3 else bands(F.col("v"), distance + 1)
    values = rows.select("v").distinct().select("v", F.explode(keys).alias("band"))
    one, two = values.withColumnRenamed("v", "v1"), values.withColumnRenamed("v", "v2")
    d = hamming(F.col("v1"), F.col("v2"))
    near = one.join(two, "band").where((F.col("v1") <= F.col("v2")) & (d <= distance)).select("v1", "v2", d.alias("d")).distinct()
    a, b = rows.select(F.col("k").alias("ka"), F.col("v").alias("v1")), rows.select(F.col("k").alias("kb"), F.col("v").alias("v2"))
    pairs = near.join(a, "v1").join(b, "v2").where(F.col("ka") != F.col("kb"))
    return pairs.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), F.col("d").cast("int").alias("d")).distinct()


def within_days(earlier: Column, later: Column, days: int = WINDOW_DAYS) -> Column:
    """Whether the earlier time is not more than so many days before the later one."""
    return earlier >= later - F.expr(f"INTERVAL {days} DAYS")


def keep_first(nodes: DataFrame, edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(k, duplicate_of): rows that repeat an earlier *kept* row, and the earliest such row.

    ``nodes`` has k; ``edges`` (a, b), a before b, and perhaps t, the time of a, by which the
    earliest is chosen (else the smallest k). A row is kept unless an earlier kept row is its
    neighbour; each round decides the rows whose earlier neighbours are decided, so A~B, B~C,
    A!~C keeps A and C.
    """
    from tidemark.session import cut

    edges = cut(edges.select("a", "b", "t" if "t" in edges.columns else F.lit(None).alias("t")))
    state = cut(edges.select(F.explode(F.array("a", "b")).alias("k")).distinct().join(nodes.select("k"), "k", "left_semi").withColumn("kept", F.lit(None).cast("boolean")))
    for _ in range(most_rounds):
        if state.where("kept is null").isEmpty():
            break
        before = edges.join(state.withColumnRenamed("k", "a"), "a").groupBy(F.col("b").alias("k")).agg(
            F.max(F.coalesce(F.col("kept"), F.lit(False))).alias("hit"), F.max(F.col("kept").isNull()).alias("open")
        )
        new = F.when(F.coalesce("hit", F.lit(False)), F.lit(False)).when(~F.coalesce("open", F.lit(False)), F.lit(True))
        state = cut(state.join(before, "k", "left").select("k", F.coalesce("kept", new).alias("kept")))
    kept = state.where("kept").select(F.col("k").alias("a"))
    return edges.join(kept, "a").join(state.where("not kept").select(F.col("k").alias("b")), "b").groupBy(F.col("b").alias("k")).agg(F.min(F.struct("t", "a"))["a"].alias("duplicate_of"))


def arrival_edges(rows: DataFrame, key: str = "k", value: str = "v", time: str = "t", days: int = WINDOW_DAYS) -> DataFrame:
    """(a, b, t): near pairs in order of arrival (time, then key), a no more than so many days before b; t is the time of a."""
    at = rows.where(F.col(time).isNotNull()).select(F.col(key).alias("k"), F.col(time).alias("t"))
    p = near_pairs(rows.where(F.col(time).isNotNull()), key, value)
    p = p.join(at.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(at.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
    late = F.struct("ta", "a") > F.struct("tb", "b")
    first = p.select(*[F.when(late, F.col(y)).otherwise(F.col(x)).alias(n) for n, x, y in (("a", "a", "b"), ("b", "b", "a"), ("t", "ta", "tb"), ("tb", "tb", "ta"))])
    return first.where(within_days(F.col("t"), F.col("tb"), days)).select("a", "b", "t")


def outcomes(df: DataFrame) -> DataFrame:
    """``outcome`` of arrivals, the first that applies.

    Wants columns too_old, already_seen, robots_blocked, failed, reason, alias_seen,
    duplicate_exact, duplicate_near: booleans, and reason text or NULL.
    """
    text = (
        F.when(F.col("too_old"), "too_old")
        .when(F.col("already_seen"), "already_seen")
        .when(F.col("robots_blocked"), "robots_blocked")
        .when(F.col("failed"), "errors")
        .when(F.col("reason").isNotNull(), F.concat(F.lit("rejected_"), F.col("reason")))
        .when(F.col("alias_seen"), "already_seen")
        .when(F.col("duplicate_exact"), "duplicate_exact")
        .when(F.col("duplicate_near"), "duplicate_near")
        .otherwise("new")
    )
    return df.withColumn("outcome", text)
