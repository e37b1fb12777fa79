"""Problem 4: clusters of mutually similar vectors, by parallel pivot correlation clustering.

Within every posting list pivots are the vectors whose hash is smallest among their undecided
neighbours; they absorb those neighbours, round by round. Clusters that have a link between
them are bridged, and groups are what stars and bridges connect.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import components
from tidemark.llm.vector_index import Vectors, blocks_of, exact, fit, in_lists, latest, unit_rows
from tidemark.session import Scratch


def _order(ids: np.ndarray) -> np.ndarray:
    """A fixed pseudo-random priority of ids."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def pivot_rounds(linked: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The pivot of every row of a packed adjacency matrix.

    In each round the undecided rows whose rank is smallest among their undecided neighbours
    become pivots, and take those neighbours; a neighbour of several goes to the smallest rank.
    The pivots are those of taking the rows one by one in the order of their rank; the rounds
    are few (their number grows with the logarithm of the rows).
    """
    n = len(rank)
    by_rank = np.argsort(rank)
    pivot, undecided = np.full(n, -1), np.ones(n, bool)
    while undecided.any():
        rows = np.flatnonzero(undecided)
        low = np.empty(len(rows), int)
        for at in range(0, len(rows), 512):
            near = np.unpackbits(linked[rows[at : at + 512]], axis=1, count=n).astype(bool) & undecided
            low[at : at + 512] = np.where(near, rank, n).min(axis=1)
        new = rows[rank[rows] < low]
        pivot[new], undecided[new] = new, False
        best = np.full(n, n)
        for at in range(0, len(new), 512):
            mine = new[at : at + 512]
            near = np.unpackbits(linked[mine], axis=1, count=n).astype(bool) & undecided
            best = np.minimum(best, np.where(near, rank[mine, None], n).min(axis=0))
        taken = np.flatnonzero(best < n)
        pivot[taken], undecided[taken] = by_rank[best[taken]], False
    return pivot


def _pivots(least: float):
    def work(ids: np.ndarray, x: np.ndarray, side: np.ndarray) -> pa.Table:
        n = len(ids)
        linked = np.zeros((n, -(-n // 8)), np.uint8)
        for r, c, s in blocks_of(x, side):
            a = s >= least
            i, j = np.nonzero(np.abs(s - least) < 1e-5)
            a[i, j] = exact(x, r[i], c[j]) >= least
            full = np.zeros((len(r), n), bool)
            full[:, c] = a
            full[np.arange(len(r)), r] = False
            linked[r] = np.packbits(full, axis=1)

        def row(i: int) -> np.ndarray:
            return np.unpackbits(linked[i], count=n).astype(bool)

        pivot = pivot_rounds(linked, np.argsort(np.argsort(_order(ids))))
        # members go to the closest pivot they are linked to
        heads = np.flatnonzero(pivot == np.arange(n))
        best = np.where(pivot == np.arange(n), 2.0, -2.0)
        for h in heads:
            m = np.flatnonzero(row(h) & (best < 2))
            if len(m):
                s = x[m] @ x[h]
                closer = s > best[m]
                pivot[m[closer]], best[m[closer]] = h, s[closer]
        member = np.flatnonzero(pivot != np.arange(n))
        bridges = set()
        for lo in range(0, n, 512):
            a = np.unpackbits(linked[lo : lo + 512], axis=1, count=n).astype(bool)
            i, j = np.nonzero(a)
            p, q = pivot[i + lo], pivot[j]
            cross = p < q
            bridges.update(np.unique(p[cross] * n + q[cross]).tolist())
        b = np.array(sorted(bridges), np.int64)
        kind = np.r_[np.zeros(len(member), np.int32), np.ones(len(b), np.int32)].astype(np.int32)
        a = np.r_[ids[member], ids[b // n] if n else b]
        to = np.r_[ids[pivot[member]], ids[b % n] if n else b]
        return pa.table({"kind": pa.array(kind), "a": pa.array(a.astype(np.int64)), "b": pa.array(to.astype(np.int64)), "cos": pa.array(np.r_[best[member], np.zeros(len(b))])})

    return work


@dataclass
class Clusters:
    """stars: (id, pivot, cos), each member's closest pivot; groups: (id, group_id)."""

    stars: DataFrame
    groups: DataFrame
    vectors: Vectors


def pivot_clusters(v: Vectors, scratch: Scratch, least: float = 0.55, smallest: int = 4, copies: int = 8, ratio: float = 1.3, list_size: int = 400) -> Clusters:
    """Stars around pivots, and groups of at least ``smallest`` ids connected by links of cosine ``least`` or more.

    group_id is the smallest id of the group. Copies of one vector belong together. The links
    searched are those between vectors that share a posting list; what is written is a star
    per pivot and a bridge per pair of linked stars, linear in the rows, never all links.
    """
    spark = v.distinct.sparkSession
    c, _ = fit(v, list_size)
    if c is None:
        return Clusters(spark.createDataFrame([], "id long, pivot long, cos double"), spark.createDataFrame([], "id long, group_id long"), v)
    met = scratch.put(in_lists(v, c, _pivots(least), "kind int, a long, b long, cos double", copies, ratio), "stars")
    star = met.where("kind = 0")
    closest = star.groupBy("a").agg(F.max(F.struct("cos", (-F.col("b")).alias("minus"))).alias("m"))
    stars = closest.select(F.col("a").alias("id"), (-F.col("m.minus")).alias("pivot"), F.col("m.cos").alias("cos"))
    twins = v.copies.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    root = components(met.select("a", "b").unionByName(twins))
    size = root.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= smallest).select("root")
    groups = root.join(size, "root").select(F.col("node").alias("id"), F.col("root").alias("group_id"))
    return Clusters(stars, groups, v)


def described(c: Clusters, typical: int = 3) -> DataFrame:
    """(group_id, size, medoid, typical): each group's size and most typical members.

    Typical members have the highest mean cosine to all members, ties to the smaller id; the
    first one is the medoid. Of unit vectors that is the order of the cosine to their sum, so
    no pairs are compared. Copies of a vector count as many times as there are, and are
    members of their own. Sums are made per batch before they are shuffled, and members are
    ranked with a limit per partition, so a large group is never gathered.
    """
    dim = c.vectors.dim
    twins = c.vectors.copies.groupBy(F.col("rep").alias("id")).agg(F.count("*").alias("times"))
    points = c.vectors.distinct.join(c.groups, "id").join(twins, "id", "left").withColumn("times", F.coalesce("times", F.lit(1)))

    def sums(batches):
        for b in batches:
            x, at = unit_rows(b.column("v"), dim)
            g, inv = np.unique(np.asarray(b.column("group_id"))[at], return_inverse=True)
            total = np.zeros((len(g), dim))
            np.add.at(total, inv, x * np.asarray(b.column("times"))[at, None])
            yield pa.RecordBatch.from_pydict({"group_id": pa.array(g), "total": pa.array([t.tobytes() for t in total], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(dim)
        for part in t.column("total"):
            total += np.frombuffer(part.as_buffer())
        return pa.table({"group_id": t.column("group_id").slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

    schema = "group_id long, total binary"
    mean = points.select("group_id", "v", "times").mapInArrow(sums, schema).groupBy("group_id").applyInArrow(add, schema)

    def score(batches):
        for b in batches:
            x, at = unit_rows(b.column("v"), dim)
            m = np.stack([np.frombuffer(t.as_buffer()) for t in b.column("total").take(pa.array(at))]) if len(at) else np.zeros((0, dim))
            s = np.einsum("ij,ij->i", x, m) / np.maximum(np.linalg.norm(m, axis=1), 1e-12)
            yield pa.RecordBatch.from_pydict({"group_id": b.column("group_id").take(pa.array(at)), "id": b.column("id").take(pa.array(at)), "s": pa.array(s)})

    scored = points.join(mean, "group_id").select("group_id", "id", "v", "total").mapInArrow(score, "group_id long, id long, s double")
    # of the copies of one vector only the smallest ids can be among the most typical
    few = c.vectors.copies.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= typical)
    every = scored.join(few.select(F.col("rep").alias("id"), F.col("id").alias("own")), "id", "left").select("group_id", F.coalesce("own", "id").alias("id"), "s")
    w = Window.partitionBy("group_id").orderBy(F.desc(F.round("s", 9)), "id")
    top = every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= typical)
    listed = top.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("typical"))
    size = c.groups.groupBy("group_id").agg(F.count("*").alias("size"))
    return size.join(listed, "group_id").select("group_id", "size", F.col("typical")[0].alias("medoid"), "typical")


def groups_of(df: DataFrame, key: str, vec: str, created: str, dim: int = 384) -> Clusters:
    scratch = Scratch(df.sparkSession, "groups")
    return pivot_clusters(latest(df, key, vec, created, dim, scratch), scratch)
