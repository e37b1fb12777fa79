"""Fitting topics: K-Means sweeps, density clustering of one group, projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.topics import min_cluster_size, scaled
from tidemark.session import Scratch

MAX_TOPIC_SHARE = 0.5
#: Records that density clustering takes in one group; it is quadratic in them.
DENSITY_MOST = 3_000


def _starts(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator, tries: int = 10) -> np.ndarray:
    """``k`` centres for weighted unit vectors: the best of some runs of K-Means from spread-out starts."""
    best = None
    for _ in range(tries):
        c = [int(rng.choice(len(x), p=weight / weight.sum()))]
        far = np.maximum(1 - x @ x[c[0]], 0)
        while len(c) < k and (far * weight).sum() > 1e-12:
            c.append(int(rng.choice(len(x), p=far * weight / (far * weight).sum())))
            far = np.minimum(far, np.maximum(1 - x @ x[c[-1]], 0))
        centres = x[c]
        for _ in range(20):
            near = _nearest_centre(x, centres)[0]
            hot = (near[:, None] == np.arange(len(centres))) * weight[:, None]
            total, n = hot.T @ x, hot.sum(0)
            centres = np.where(n[:, None] > 0, total / np.maximum(n, 1e-12)[:, None], centres)
        cost = (weight * _nearest_centre(x, centres)[1]).sum()
        if best is None or cost < best[0] - 1e-12:
            best = cost, centres
    return best[1]


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and the squared distance to it, of unit vectors."""
    d = x @ centres.T
    d -= (centres**2).sum(1) / 2
    near = d.argmax(1)
    return near, np.maximum(1 - 2 * d[np.arange(len(x)), near], 0)


def kmeans_sweep(points: DataFrame, ks: list[int], key: str = "id", vec: str = "v", seeds: tuple[int, ...] = (42,), rounds: int = 30) -> tuple[DataFrame, int, float]:
    """(id, topic), k and silhouette of the K-Means fit with the best cosine silhouette; the smallest k among equals.

    For each k the seed with the lowest cost counts. All fits go on together: a round reads the
    vectors once, and each task returns the sums of its vectors by centre, of all fits that still
    move; one more round gives all silhouettes, over all vectors. Starts are found among
    candidates that rounds over all vectors add by their distance to those so far, each
    weighted by the vectors nearest to it. ``points`` are read some forty times and should be a table.
    """
    kind = dict(points.dtypes)[key]
    data = points.select(key, vec)
    size = data.select(F.max(F.size(vec)).alias("n")).first()["n"] or 0
    n = data.where(F.size(vec) == size).count()

    def over(work) -> np.ndarray:
        """The sum over all tasks of a flat array that ``work`` adds batches to."""

        def task(batches):
            total = None
            for b in batches:
                _, x = unit_rows(b, vec, size)
                for i in range(0, len(x), 2_048):
                    now = work(x[i : i + 2_048])
                    total = now if total is None else total + now
            if total is not None:
                yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]})

        return summed(data.select(vec).mapInArrow(task, "m binary"))

    def candidates(seed: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(seed)
        found = unit_rows(data.orderBy(F.xxhash64(key, F.lit(seed))).limit(1).toArrow().combine_chunks().to_batches()[0], vec, size)[1]
        most = 2 * max(ks)
        for r in range(5):
            whole = over(lambda x: np.array([_nearest_centre(x, found)[1].sum()]))[0]
            if whole <= 1e-9 * n:
                break

            def drawn(batches, found=found, whole=whole, r=r):
                for b in batches:
                    at, x = unit_rows(b, vec, size)
                    far = _nearest_centre(x, found)[1]
                    chance = np.asarray(b.column("u"))[at]
                    yield pa.RecordBatch.from_arrays([b.column(vec).take(pa.array(at[chance < most * far / whole])).cast(pa.list_(pa.float64()))], names=[vec])

            # a row's chance hangs on its key alone, so that a repeated task draws the same
            chance = (F.pmod(F.xxhash64(key, F.lit(seed * 100 + r)), F.lit(1 << 30)) / float(1 << 30)).alias("u")
            new = data.select(vec, chance).mapInArrow(drawn, f"{vec} array<double>").toArrow().combine_chunks()
            if new.num_rows:
                found = np.vstack([found, unit_rows(new.to_batches()[0], vec, size)[1]])
                found = np.unique(found, axis=0)
        return found, over(lambda x: np.bincount(_nearest_centre(x, found)[0], minlength=len(found)).astype(float))

    ks = sorted({k for k in ks if 0 < k})
    centres: dict[tuple[int, int], np.ndarray] = {}
    for s in seeds if n and ks else ():
        found, weight = candidates(s)
        for k in ks:
            centres[k, s] = _starts(found, weight, k, np.random.default_rng([s, k]))

    def sums(fits: dict) -> dict:
        """{fit: (sums by centre, counts, cost)}"""
        order = list(fits)
        sizes = [len(fits[f]) for f in order]
        every = np.vstack([fits[f] for f in order])

        def work(x):
            d = x @ every.T
            d -= (every**2).sum(1) / 2
            hot, cost, at = np.zeros((len(x), len(every))), [], 0
            rows = np.arange(len(x))
            for m in sizes:
                near = d[:, at : at + m].argmax(1) + at
                hot[rows, near] = 1
                cost.append(np.maximum(1 - 2 * d[rows, near], 0).sum())
                at += m
            return np.concatenate([(hot.T @ x).ravel(), hot.sum(0), cost])

        flat, out, at = over(work), {}, 0
        total, count, cost = flat[: len(every) * size].reshape(len(every), size), flat[len(every) * size :][: len(every)], flat[-len(order) :]
        for f, m, c in zip(order, sizes, cost):
            out[f] = total[at : at + m], count[at : at + m], c
            at += m
        return out

    moving, costs = set(centres), {}
    for _ in range(rounds):
        if not moving:
            break
        for f, (total, count, cost) in sums({f: centres[f] for f in sorted(moving)}).items():
            to = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres[f])
            if np.abs(((to - centres[f]) ** 2).sum(1)).max() <= 1e-8:
                moving.discard(f)
            centres[f], costs[f] = to, cost
    chosen = {k: centres[k, min(seeds, key=lambda s: costs[k, s])] for k in ks} if centres else {}
    score = _silhouettes(chosen, sums(chosen), over) if chosen else {}
    best = max(score, key=lambda k: (round(score[k], 12), -k), default=None)
    if best is None:
        return data.where(F.size(vec) == size).select(key, F.lit(0).cast("long").alias("topic")), 1, 0.0
    last = chosen[best]

    def labelled(batches):
        for b in batches:
            at, x = unit_rows(b, vec, size)
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at)), pa.array(_nearest_centre(x, last)[0])], names=[key, "topic"])

    return data.mapInArrow(labelled, f"{key} {kind}, topic long"), best, score[best]


def _silhouettes(fits: dict[int, np.ndarray], met: dict, over) -> dict[int, float]:
    """{k: mean cosine silhouette} of fits with two topics or more, out of the sums by centre and one pass over the vectors."""
    fits = {k: c for k, c in fits.items() if (met[k][1] > 0).sum() >= 2}
    order = list(fits)

    def work(x):
        out, rows = [], np.arange(len(x))
        for k in order:
            near = _nearest_centre(x, fits[k])[0]
            total, count, _ = met[k]
            d = x @ total.T
            own = count[near]
            a = (own - d[rows, near]) / np.maximum(own - 1, 1)
            far = np.where(count > 0, 1 - d / np.maximum(count, 1), np.inf)
            far[rows, near] = np.inf
            b = far.min(1)
            out.append(np.where(own == 1, 0, (b - a) / np.maximum(np.maximum(a, b), 1e-12)).sum())
        return np.array(out)

    if not fits:
        return {}
    return dict(zip(order, (over(work) / met[order[0]][1].sum()).tolist()))


def _spanning_tree(x: np.ndarray) -> np.ndarray:
    """Edges (i, j, distance) of a minimum spanning tree under cosine distance, row by row."""
    n = len(x)
    best, via, out = np.full(n, np.inf), np.zeros(n, int), np.zeros((n - 1, 3))
    inside = np.zeros(n, bool)
    at = 0
    for k in range(n - 1):
        inside[at] = True
        d = 1 - x @ x[at]
        closer = ~inside & (d < best)
        best[closer], via[closer] = d[closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        out[k] = via[at], at, max(best[at], 0.0)
    return out[np.argsort(out[:, 2], kind="stable")]


def density_labels(x: np.ndarray, least: int, leaf: bool = False) -> np.ndarray:
    """Labels (-1 for none) of hierarchical density clustering with core distance 0.

    The single-linkage tree is condensed: a split counts only if both sides have ``least``
    points; others fall out at their density. Clusters are those of most excess of mass, or the
    leaves. The whole is never a cluster.
    """
    n = len(x)
    if n < 2 * least:
        return np.full(n, -1)
    children: dict[int, tuple[int, int, float]] = {}
    size = {i: 1 for i in range(n)}
    root = list(range(2 * n - 1))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for node, (i, j, d) in enumerate(_spanning_tree(x), start=n):
        a, b = find(int(i)), find(int(j))
        children[node] = (a, b, d)
        size[node] = size[a] + size[b]
        root[a] = root[b] = node

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            p = todo.pop()
            if p < n:
                out.append(p)
            else:
                todo += children[p][:2]
        return out

    born, kids, points = {0: 0.0}, {0: []}, {0: []}
    todo = [(2 * n - 2, 0)]
    while todo:
        node, cluster = todo.pop()
        while node >= n:
            a, b, d = children[node]
            lam = 1 / max(d, 1e-12)
            big = [c for c in (a, b) if size[c] >= least]
            if len(big) == 2:
                for c in big:
                    new = len(born)
                    born[new], kids[new], points[new] = lam, [], []
                    kids[cluster].append((new, size[c], lam))
                    todo.append((c, new))
                node = -1
            else:
                for c in (a, b):
                    if size[c] < least:
                        points[cluster] += [(p, lam) for p in leaves(c)]
                if not big:
                    node = -1
                else:
                    node = big[0]
    stable = {c: sum(lam - born[c] for _, lam in points[c]) + sum(m * (lam - born[c]) for _, m, lam in kids[c]) for c in born}
    chosen: set[int] = set()
    for c in sorted(born, reverse=True):
        inner = [k for k, _, _ in kids[c]]
        if c == 0:
            continue
        if not inner:
            chosen.add(c)
        elif not leaf:
            total = sum(stable[k] for k in inner)
            if stable[c] >= total:
                drop = list(inner)
                while drop:
                    k = drop.pop()
                    chosen.discard(k)
                    drop += [m for m, _, _ in kids[k]]
                chosen.add(c)
            else:
                stable[c] = total
    label = np.full(n, -1)
    for i, c in enumerate(sorted(chosen)):
        inside = [c]
        while inside:
            k = inside.pop()
            for p, _ in points[k]:
                label[p] = i
            inside += [m for m, _, _ in kids[k]]
    return label


def cosine_silhouette(x: np.ndarray, label: np.ndarray) -> float:
    m = label >= 0
    x, label = x[m], label[m]
    ks = np.unique(label)
    if len(ks) < 2 or len(x) <= len(ks):
        return 0.0
    sums = np.stack([x[label == k].sum(0) for k in ks])
    n = np.array([(label == k).sum() for k in ks])
    dots = x @ sums.T
    own = np.searchsorted(ks, label)
    rows = np.arange(len(x))
    a = (n[own] - dots[rows, own]) / np.maximum(n[own] - 1, 1)
    other = 1 - dots / n
    other[rows, own] = np.inf
    b = other.min(1)
    return float(np.where(n[own] == 1, 0, (b - a) / np.maximum(np.maximum(a, b), 1e-12)).mean())


def best_density(x: np.ndarray) -> np.ndarray:
    """The labelling of the candidate grid with the best silhouette times root of coverage; valid ones first."""
    mcs = min_cluster_size(len(x))
    found = []
    for least, leaf in dict.fromkeys([(mcs, False), (mcs, True), (max(2, mcs - 1), False)]):
        label = density_labels(x, least, leaf)
        m = label >= 0
        share = np.bincount(label[m]).max() / m.sum() if m.any() else 1.0
        valid = len(np.unique(label[m])) >= 2 and share <= MAX_TOPIC_SHARE
        found.append((valid, cosine_silhouette(x, label) * np.sqrt(m.mean()), label))
    return max(found, key=lambda f: f[:2])[2]


def density_topics(points: DataFrame, group: str, key: str = "id", vec: str = "v") -> DataFrame:
    """(group, id, topic) of each group's own density clustering, -1 for records in no topic.

    A group is one task; a group above DENSITY_MOST records fails with a message, as the
    method is quadratic: fit it on a window, then assign the rest to the centroids.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > DENSITY_MOST:
            raise ValueError(f"a group of {len(rows)} records: fit on a window of {DENSITY_MOST} or fewer")
        rows = rows.sort_values(key)
        x = np.stack(rows[vec].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
        return pd.DataFrame({group: rows[group], key: rows[key], "topic": best_density(x)})

    kinds = dict(points.dtypes)
    return points.select(group, key, vec).groupBy(group).applyInPandas(one, f"{group} {kinds[group]}, {key} {kinds[key]}, topic long")


def unit_rows(batch, vec: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors of an Arrow batch's lists of ``size`` values."""
    v = batch.column(vec)
    at = np.flatnonzero(np.asarray(v.value_lengths().fill_null(-1)) == size)
    x = np.asarray(v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(at), size)
    return at, x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]


def summed(parts: DataFrame, groups: int = 8) -> np.ndarray:
    """The sum of the tasks' matrices, rows (m) of doubles as bytes: added up by a few tasks, then on the driver."""

    def added(batches):
        total = None
        for b in batches:
            for m in b.column("m"):
                x = np.frombuffer(m.as_buffer(), float)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]})

    each = parts.repartition(groups).mapInArrow(added, "m binary").toArrow().column("m").to_pylist()
    return sum(np.frombuffer(m, float) for m in each) if each else np.zeros(0)


def project(points: DataFrame, key: str = "id", vec: str = "v") -> DataFrame:
    """(id, method, x, y): the first two principal components, scaled to 0..1.

    Each task adds up the products of its unit vectors' values, as a matrix; vectors don't move.
    They are read twice, so ``points`` should be a table.
    """
    kind = dict(points.dtypes)[key]
    size = points.select(F.max(F.size(vec)).alias("n")).first()["n"] or 0

    def products(batches):
        n, total, square = 0, np.zeros(size), np.zeros((size, size))
        for b in batches:
            _, x = unit_rows(b, vec, size)
            n, total, square = n + len(x), total + x.sum(0), square + x.T @ x
        if n:
            yield pa.RecordBatch.from_pydict({"m": [np.concatenate([[n], total, square.ravel()]).tobytes()]})

    got = summed(points.select(vec).mapInArrow(products, "m binary"))
    if not len(got):
        return points.select(key, F.lit("pca").alias("method"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")).limit(0)
    n, mean, square = got[0], got[1 : size + 1] / got[0], got[size + 1 :].reshape(size, size)
    axes = np.linalg.eigh(square / n - np.outer(mean, mean))[1][:, ::-1][:, :2]
    axes = np.pad(axes, ((0, 0), (0, 2 - axes.shape[1])))

    def flat(batches):
        for b in batches:
            at, x = unit_rows(b, vec, size)
            p = x @ axes
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at)), pa.array(p[:, 0]), pa.array(p[:, 1])], names=[key, "x", "y"])

    out = points.select(key, vec).mapInArrow(flat, f"{key} {kind}, x double, y double")
    return scaled(Scratch(points.sparkSession, "axes").put(out.select(key, F.lit("pca").alias("method"), "x", "y")), ["method"])
