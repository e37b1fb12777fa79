"""Problem 5: the most similar vectors of every vector, through balanced posting lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.vector_index import Vectors, blocks_of, exact, fit, in_lists, latest
from tidemark.session import Scratch


def _best(k: int, least: float):
    def work(ids: np.ndarray, x: np.ndarray, side: np.ndarray) -> pa.Table:
        found_i, found_j, found_s = [], [], []
        for r, c, s in blocks_of(x, side):
            s[r[:, None] == c[None, :]] = -2
            low = np.full(len(r), least)
            if len(c) > k:
                low = np.maximum(low, np.partition(s, len(c) - k, axis=1)[:, len(c) - k])
            i, j = np.nonzero(s >= low[:, None] - 1e-5)
            i, j = r[i], c[j]
            d = exact(x, i, j)
            ok = d >= least
            i, j, d = i[ok], j[ok], d[ok]
            order = np.lexsort((ids[j], -d, i))
            i, j, d = i[order], j[order], d[order]
            start = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(start, np.arange(len(i)), 0))
            keep = np.arange(len(i)) - first < k
            found_i.append(ids[i[keep]])
            found_j.append(ids[j[keep]])
            found_s.append(d[keep])
        none = [np.zeros(0, np.int64)]
        return pa.table({"id": pa.array(np.concatenate(found_i or none)), "other": pa.array(np.concatenate(found_j or none)), "cos": pa.array(np.concatenate(found_s or [np.zeros(0)]))})

    return work


def neighbours(v: Vectors, k: int = 5, least: float = -1.0, copies: int = 8, ratio: float = 1.3, list_size: int = 400) -> DataFrame:
    """(id, other, cos, rank): up to k others of every id by cosine (double), those of at least ``least``.

    Ties go to the smaller id. A row's candidates are the vectors it shares a posting list
    with; list membership near boundaries is what decides the recall. Ids that share one
    vector are one point in the index and are put back afterwards: an id's copies have cosine
    1, and of another point's copies only the k + 1 smallest ids can be among the nearest.
    """
    spark = v.distinct.sparkSession
    c, n = fit(v, list_size)
    if c is None:
        return spark.createDataFrame([], "id long, other long, cos double, rank int")
    met = in_lists(v, c, _best(k, least), "id long, other long, cos double", copies, ratio)
    by = Window.partitionBy("id").orderBy(F.desc("cos"), "other")
    top = met.groupBy("id", "other").agg(F.max("cos").alias("cos")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    few = v.copies.withColumn("rn", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("rn") <= k + 1)
    few = few.groupBy("rep").agg(F.collect_list("id").alias("ids"))
    spread = (
        top.join(few.withColumnRenamed("rep", "other"), "other", "left")
        .select("id", F.explode(F.coalesce("ids", F.array("other"))).alias("other"), "cos")
        .join(v.copies.withColumnRenamed("id", "own").withColumnRenamed("rep", "id"), "id", "left")
        .select(F.coalesce("own", "id").alias("id"), "other", "cos")
    )
    own = v.copies.join(few, "rep").select("id", F.explode("ids").alias("other"), F.lit(1.0).alias("cos")).where("id <> other")
    every = spread.unionByName(own.where(F.lit(least) <= 1.0))
    return every.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def nearest_pairs(df: DataFrame, key: str, vec: str, created: str, dim: int = 384, k: int = 5, least: float = 0.8) -> DataFrame:
    """(id_a, id_b), id_a < id_b: either one is among the k nearest of the other, at ``least`` or more."""
    v = latest(df, key, vec, created, dim, Scratch(df.sparkSession, "nearest"))
    near = neighbours(v, k, least)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
