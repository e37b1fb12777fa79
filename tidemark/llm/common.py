"""What several operators need: unique rows, readers, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checked(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A materialised narrow table, marked for broadcasting only if it has at most ``most`` rows.

    Beyond that it stays a table that joins shuffle.
    """
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


def one_row_per_id(df: DataFrame, key: str) -> DataFrame:
    """Rows with a non-null key, one of each key (the smallest when all columns are compared).

    Only the key column is read to see whether any repeats; wide rows are moved only for
    keys that do.
    """
    df = df.where(F.col(key).isNotNull())
    again = df.groupBy(key).count().where("count > 1").select(key)
    if again.isEmpty():
        return df
    again = checked(again)
    rest = df.columns
    order = [F.col(c) for c, kind in df.dtypes if c != key and not kind.startswith("map")]
    w = Window.partitionBy(key).orderBy(*order) if order else Window.partitionBy(key).orderBy(key)
    once = df.join(again, key, "left_semi").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*rest)
    return df.join(again, key, "left_anti").select(*rest).unionByName(once)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: rows (node, root), root the smallest node reached.

    Alternates the large-star and small-star steps: every round only joins neighbours to the
    smallest neighbour so far, so the edge list never grows beyond its first size, and a hub
    is met by aggregates with map-side combining, never gathered. Nodes without edges don't
    appear. A round is written to the shared folder before the next one reads it.
    """
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u <> v")
        .distinct()
    )
    e = cut(e)
    before = None
    for _ in range(most_rounds):
        # large star: the larger neighbours of u go to u's smallest neighbour (or u itself)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of u, and u, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        to = large.join(low, "u")
        small = (
            to.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = cut(small)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
