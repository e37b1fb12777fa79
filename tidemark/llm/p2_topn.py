"""Problem 2: the N best items of every group.

A score histogram of each large group gives a threshold that at least N different items
reach. Rows below it are dropped where they are read, before anything is shuffled; the rest
is ranked exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of all rows above each histogram bound: fine at the top, where the best N lie.
TAIL = (0.5, 0.25, 0.12, 0.06, 0.03, 0.015, 0.008, 0.004, 0.002, 0.001, 0.0005, 0.0001)
#: Thresholds that may be broadcast at most; a group gets one only if it holds more than 1/MOST of all rows.
MOST = 100_000


def _bucket(score: Column, bounds: list[float]) -> Column:
    out = F.lit(0)
    for b in bounds:
        out = out + (score >= F.lit(b)).cast("int")
    return out


def thresholds(rows: DataFrame, n: int, least_rows: int = 4_096) -> DataFrame | None:
    """(g, low) of large groups: at least n different items of g score ``low`` or more.

    Each (group, bucket) keeps a bit set of hashed item ids, so the number of bits over the
    buckets from the top is never more than the number of different items there: rows that
    repeat an item can't make a threshold too high.
    """
    q = rows.agg(F.percentile_approx("score", [1 - t for t in TAIL], 10_000).alias("q"), F.count("*").alias("n")).first()
    if not q["n"]:
        return None
    bounds = sorted(set(q["q"]))
    words = -(-4 * n // 64)
    bit = F.pmod(F.xxhash64("item"), F.lit(words * 64))
    sets = [
        F.bit_or(F.when(F.floor(bit / 64) == i, F.expr("shiftleft(1L, cast(_bit % 64 as int))")).otherwise(F.lit(0).cast("long"))).alias(f"b{i}")
        for i in range(words)
    ]
    per = (
        rows.withColumn("_bit", bit)
        .withColumn("bucket", _bucket(F.col("score"), bounds))
        .groupBy("g", "bucket")
        .agg(F.count("*").alias("rows"), *sets)
    )
    most = F.sum("rows").over(Window.partitionBy("g"))
    down = Window.partitionBy("g").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    seen = sum((F.bit_count(F.bit_or(f"b{i}").over(down)) for i in range(words)), F.lit(0))
    return (
        per.select("g", "bucket", most.alias("all"), seen.alias("seen"))
        .where((F.col("all") > max(least_rows, q["n"] // MOST)) & (F.col("seen") >= n) & (F.col("bucket") > 0))
        .groupBy("g")
        .agg(F.max("bucket").alias("top"))
        .select("g", F.element_at(F.array(*map(F.lit, bounds)), F.col("top")).alias("low"))
    )


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 5) -> DataFrame:
    """Rows (group, item, score, rank): the n items of highest score of every group.

    An item counts once in a group, with its highest score. Rows with a null group or item, or
    a null or NaN score, don't take part. Equal scores are ranked by the smaller item. Groups
    with fewer items give all; an empty table gives no rows. Other columns are ignored. The
    threshold table has at most ``MOST`` rows (only groups above that share of all rows are in
    it), so it may be broadcast; repeated items are merged by (group, item), and the ranking
    first keeps n rows of a group in each partition, so a hot group never meets in one task.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    s = F.col(score).cast("double")
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("item"), F.col(score).alias("raw"), s.alias("score")).where(
        F.col("g").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score")
    )
    low = thresholds(rows, n)
    if low is not None:
        rows = rows.join(F.broadcast(low), "g", "left").where(F.col("low").isNull() | (F.col("score") >= F.col("low")))
    best = rows.groupBy("g", "item").agg(F.max("raw").alias("raw"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("raw"), "item"))
    return best.withColumn("rank", rank).where(F.col("rank") <= n).select(
        F.col("g").alias(group), F.col("item").alias(item), F.col("raw").alias(score), F.col("rank").cast("long").alias("rank")
    )
