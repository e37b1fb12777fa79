"""Posting lists of vectors: what problems 4 and 5 search.

Centroids are fitted on a bounded sample, balanced so that lists are of like size, and joined
by a graph that is small enough for every worker's memory. Every vector goes to its nearest
list and, near a boundary, to further ones (distance-ratio pruning). All vectors are indexed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checked
from tidemark.session import Scratch

#: Vectors that the fit may see at most, and lists that it may make at most (both bound the driver).
FIT_ROWS = 20_000
MOST_LISTS = 2_500
#: Vectors per list aimed at, and the size from which a list is split into blocks.
LIST = 400
LIST_MOST = 6_000
#: Neighbouring lists that one task works on: a vector that is in several of them is sent to it once.
TOGETHER = 8


def unit_rows(column: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (double) of the usable rows, and which rows those are.

    Not usable: null, of another length, all zero, or holding NaN, null or an infinite value.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(length == dim)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False) if len(at) else np.zeros(0)
    x = np.asarray(flat, np.float64).reshape(len(at), dim)
    n = np.sqrt(np.einsum("ij,ij->i", x, x)) if len(at) else np.zeros(0)
    ok = np.isfinite(n) & (n > 0)
    return x[ok] / n[ok, None], at[ok]


@dataclass
class Vectors:
    """distinct: (id, v), one row of each different usable vector; copies: (id, rep) of ids that share one."""

    distinct: DataFrame
    copies: DataFrame
    dim: int


def latest(df: DataFrame, key: str, vec: str, created: str, dim: int, scratch: Scratch) -> Vectors:
    """The vector of each id with the latest time; a null time is the oldest.

    Rows with equal times are ordered by the vector, so the choice is fixed. Ids without a
    usable latest vector are left out. Copies of one vector are kept as (id, rep), the
    smallest id the representative, so that any number of copies is one point of the index.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(created).alias("t"), F.col(vec).cast("array<float>").alias("v")).where("id is not null")
    again = checked(rows.groupBy("id").count().where("count > 1").select("id"))
    once = rows.join(again, "id", "left_anti").select("id", "v")
    last = rows.join(again, "id", "left_semi").groupBy("id").agg(F.max(F.struct("t", "v")).alias("m")).select("id", F.col("m.v").alias("v"))

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, at = unit_rows(b.column("v"), dim)
            yield b.take(pa.array(at))

    good = scratch.put(once.unionByName(last).mapInArrow(usable, "id long, v array<float>"), "vectors")
    same = good.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2"))
    shared = same.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "rep")
    copies = checked(same.join(shared, ["h1", "h2"]).select("id", "rep"))
    distinct = good.join(copies.where("id <> rep").select("id"), "id", "left_anti")
    return Vectors(distinct, copies, dim)


@dataclass
class Centroids:
    """Centroids, the hubs that enter their graph, each one's nearest neighbours, and the task of each list."""

    centres: np.ndarray
    hubs: np.ndarray
    members: list = field(default_factory=list)
    near: np.ndarray | None = None
    load: np.ndarray | None = None
    task: np.ndarray | None = None

    def search(self, x: np.ndarray, most: int, hubs: int = 6) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` best centroids of each row, best first, and their cosines.

        Enters the graph at the nearest hubs, takes their centroids, and follows the edges of
        the best one found.
        """
        x = x.astype(np.float32)
        k = len(self.centres)
        score = np.full((len(x), k), -2, np.float32)
        to_hub = x @ self.hubs.T
        take = min(hubs, len(self.hubs))
        top = np.argpartition(-to_hub, take - 1, axis=1)[:, :take]
        for h, m in enumerate(self.members):
            rows = np.flatnonzero((top == h).any(axis=1))
            if len(rows) and len(m):
                score[np.ix_(rows, m)] = x[rows] @ self.centres[m].T
        best = score.argmax(axis=1)
        for lo in range(0, len(x), 512):
            rows = np.arange(lo, min(len(x), lo + 512))
            edges = self.near[best[rows]]
            score[rows[:, None], edges] = np.einsum("ij,ikj->ik", x[rows], self.centres[edges])
        most = min(most, k)
        top = np.argpartition(-score, most - 1, axis=1)[:, :most]
        s = np.take_along_axis(score, top, 1)
        order = np.argsort(-s, axis=1, kind="stable")
        return np.take_along_axis(top, order, 1), np.take_along_axis(s, order, 1)


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; a centre with few points moves to the fullest cluster, for balance."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    label = np.zeros(len(x), int)
    for r in range(rounds):
        for lo in range(0, len(x), 4096):
            label[lo : lo + 4096] = (x[lo : lo + 4096] @ c.T).argmax(axis=1)
        n = np.bincount(label, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, label, x)
        ok = n > 0
        c[ok] = total[ok] / np.maximum(np.linalg.norm(total[ok], axis=1), 1e-9)[:, None]
        if r < rounds - 1:
            poor = np.argsort(n)[: max(1, k // 20)]
            rich = np.argsort(-n)[: len(poor)]
            for p, q in zip(poor, rich):
                if n[q] > 4 * max(1, n[p]):
                    inside = np.flatnonzero(label == q)
                    c[p] = x[rng.choice(inside)]
    return c, np.bincount(label, minlength=k)


def fit(v: Vectors, list_size: int = LIST, fit_rows: int = FIT_ROWS, seed: int = 7) -> tuple[Centroids | None, int]:
    """Centroids from at most about ``fit_rows`` vectors chosen by a hash of their id; and the number of vectors."""
    n = v.distinct.count()
    if not n:
        return None, 0
    grain = 1_000_000
    part = v.distinct.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(grain)) < max(1, grain * fit_rows // n)).select("v") if n > fit_rows else v.distinct.select("v")
    x, _ = unit_rows(part.toArrow().column("v"), v.dim)
    if not len(x):
        x, _ = unit_rows(v.distinct.select("v").limit(1).toArrow().column("v"), v.dim)
    x = x.astype(np.float32)
    k = int(max(1, min(MOST_LISTS, -(-n // list_size), -(-len(x) // 4))))
    c, load = _kmeans(x, k, 8, seed)
    hubs, _ = _kmeans(c, int(np.ceil(np.sqrt(k))), 5, seed)
    at = (c @ hubs.T).argmax(axis=1)
    edges = min(k, 25)
    near = np.argpartition(-(c @ c.T), edges - 1, axis=1)[:, :edges]
    members = [np.flatnonzero(at == h) for h in range(len(hubs))]
    return Centroids(c, hubs, members, near, load * (n / len(x)), _tasks(c)), n


def _tasks(c: np.ndarray) -> np.ndarray:
    """The task of each list: TOGETHER lists at most, each with its nearest free neighbours."""
    task, s = np.full(len(c), -1), c @ c.T
    free, n = np.ones(len(c), bool), 0
    for i in range(len(c)):
        if free[i]:
            near = np.argsort(-np.where(free, s[i], -3))[: min(TOGETHER, int(free.sum()))]
            task[near], free[near] = n, False
            n += 1
    return task


def in_lists(v: Vectors, c: Centroids, work: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str, copies: int = 8, ratio: float = 1.3) -> DataFrame:
    """``work(ids, unit vectors, sides)`` over every posting list; its rows together.

    A vector is in its nearest list and in those at no more than ``ratio`` times that
    distance, up to ``copies``. Lists that are near each other are worked on by one task, to
    which a vector goes once however many of them it is in. A list larger than LIST_MOST is
    split: its vectors are hashed into blocks, and each pair of blocks is worked on alone
    (sides 1 and 2; 0 means that all rows pair with each other), so every pair of a list meets
    exactly once and no task gathers a hot list.
    """
    cb = v.distinct.sparkSession.sparkContext.broadcast(vars(c))
    dim = v.dim

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Centroids(**cb.value)
        split = np.clip(-(-c.load * 3 // LIST_MOST), 1, 500).astype(int)
        none = np.zeros(0, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                x, at = unit_rows(part.column("v"), dim)
                if not len(at):
                    continue
                lists, cos = c.search(x, copies)
                d = np.sqrt(np.maximum(0, 2 - 2 * cos))
                rows, col = np.nonzero(d <= np.maximum(d[:, :1] * ratio, 1e-3))
                chosen = lists[rows, col].astype(np.int64)
                ids = np.asarray(part.column("id"))[at]
                big = split[chosen] > 1
                # whole lists: one row per vector and task, with its lists there
                r, li = rows[~big], chosen[~big]
                order = np.lexsort((li, c.task[li], r))
                r, li, task = r[order], li[order], c.task[li[order]].astype(np.int64)
                first = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (task[1:] != task[:-1])]) if len(r) else none
                keys, side, source, inside = [task[first]], [np.zeros(len(first), np.int32)], [r[first]], [np.diff(np.r_[first, len(r)])]
                # split lists: one row per vector, list and pair of blocks
                for one in np.unique(chosen[big]):
                    r, n = rows[chosen == one], split[one]
                    mine = (ids[r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % n
                    for j in range(n):
                        keys.append(-1 - ((np.int64(one) << 20) + (np.minimum(mine, j) << 10) + np.maximum(mine, j)))
                        side.append(np.where(mine == j, 0, np.where(mine < j, 1, 2)).astype(np.int32))
                        source.append(r)
                        inside.append(np.zeros(len(r), np.int64))
                rows, ends = np.concatenate(source), np.cumsum(np.r_[0, np.concatenate(inside)])
                yield pa.RecordBatch.from_pydict(
                    {
                        "list": pa.array(np.concatenate(keys)), "side": pa.array(np.concatenate(side)), "id": pa.array(ids[rows]), "v": part.column("v").take(pa.array(at[rows])),
                        "lists": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(li.astype(np.int32))),
                    }
                )

    def each(t: pa.Table) -> pa.Table:
        key = t.column("list")[0].as_py()
        ids, side = (np.asarray(t.column(n).combine_chunks()) for n in ("id", "side"))
        x, _ = unit_rows(t.column("v"), dim)
        order = np.argsort(ids, kind="stable")
        if key < 0:
            return work(ids[order], x[order], side[order])
        ids, x = ids[order], x[order]
        lists = t.column("lists").combine_chunks().take(pa.array(order))
        of = np.repeat(np.arange(len(ids)), np.asarray(lists.value_lengths()))
        flat = np.asarray(lists.flatten())
        parts = []
        for one in np.unique(flat).tolist():
            at = of[flat == one]
            parts.append(work(ids[at], x[at], np.zeros(len(at), np.int32)))
        return pa.concat_tables(parts)

    return v.distinct.select("id", "v").mapInArrow(assign, "list long, side int, id long, v array<float>, lists array<int>").groupBy("list").applyInArrow(each, schema)


def blocks_of(x: np.ndarray, side: np.ndarray, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, column numbers, cosines): every pair of a list, rows in blocks; in double where a row and column differ in side."""
    y = x.astype(np.float32)
    if not side.any():
        every = np.arange(len(x))
        for lo in range(0, len(x), step):
            yield every[lo : lo + step], every, y[lo : lo + step] @ y.T
        return
    one, two = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    for r, c in ((one, two), (two, one)):
        for lo in range(0, len(r), step):
            yield r[lo : lo + step], c, y[r[lo : lo + step]] @ y[c].T


def exact(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs of unit rows in double precision."""
    out = np.empty(len(i))
    for lo in range(0, len(i), 65_536):
        s = slice(lo, lo + 65_536)
        out[s] = np.einsum("ij,ij->i", x[i[s]], x[j[s]])
    return out
