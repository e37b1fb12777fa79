"""Topics over vectors and terms: centroids, quality, assignment, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import pretty
from tidemark.functions.vectors import as_double, dot, normalised, sum_vectors
from tidemark.session import Scratch, checked, cut

ASSIGN_PERCENTILE, ASSIGN_FLOOR, MATCH_LEAST = 0.10, 0.30, 0.75
TOP_TERMS = 10


def centroids(members: DataFrame, topic: str = "topic", vec: str = "v") -> DataFrame:
    """(topic, centroid, n): the normalised mean of each topic's unit vectors, topics below 0 left out."""
    m = members.where(F.col(topic) >= 0)
    total = sum_vectors(m, [topic], vec)
    return total.join(m.groupBy(topic).agg(F.count("*").alias("n")), topic).select(topic, normalised(F.col("total")).alias("centroid"), "n")


def member_scores(members: DataFrame, cents: DataFrame, key: str = "id", topic: str = "topic", vec: str = "v") -> DataFrame:
    """(id, topic, score): closeness of each member to its topic's centre."""
    return members.join(cents, topic).select(key, topic, F.round(dot(F.col(vec), F.col("centroid")), 4).alias("score"))


def leave_one_out(members: DataFrame, key: str = "id", topic: str = "topic", vec: str = "v") -> DataFrame:
    """(id, topic, sim): cosine of each member to the sum of its topic's others; topics of one member are skipped."""
    m = members.where(F.col(topic) >= 0)
    sums = sum_vectors(m, [topic], vec, "s").join(m.groupBy(topic).agg(F.count("*").alias("n")), topic).where("n > 1")
    x = F.col(vec)
    rest = F.zip_with(F.col("s"), x.cast("array<double>"), lambda a, b: a - b)
    j = m.join(sums, topic).withColumn("rest", rest)
    return j.select(key, topic, (dot(x, F.col("rest")) / F.greatest(F.sqrt(dot(F.col("rest"), F.col("rest"))), F.lit(1e-12))).alias("sim"))


def quantile(df: DataFrame, value: str, share: float, grid: int = 4_096) -> float | None:
    """The interpolated quantile of a column, to 1e-9 of its range; None if it has no value.

    Counts on a grid find the cell of each of the two values around the rank, which is then cut
    into a grid itself: a few passes of counts that combine before they are shuffled, where an
    exact percentile would hold every distinct value in one task.
    """
    rows = df.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    whole = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).first()
    if not whole["n"]:
        return None
    at = share * (whole["n"] - 1)

    def ranked(rank: int) -> float:
        lo, hi = whole["lo"], whole["hi"]
        for _ in range(3):
            if hi <= lo:
                return lo
            cell = F.least(F.floor((F.col("x") - lo) / (hi - lo) * grid), F.lit(grid - 1))
            counts = rows.where(F.col("x").between(lo, hi)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
            for r in sorted(counts, key=lambda r: r["c"]):
                if rank < r["n"]:
                    lo, hi = r["lo"], r["hi"]
                    break
                rank -= r["n"]
        return lo

    low = ranked(int(at))
    return low if at == int(at) else low + (ranked(int(at) + 1) - low) * (at - int(at))


def assign_threshold(sims: DataFrame, percentile: float = ASSIGN_PERCENTILE, floor: float = ASSIGN_FLOOR) -> DataFrame:
    """One row: the similarity a new record needs to join a topic; the floor if there are no similarities."""
    found = quantile(cut(sims.select("sim")), "sim", percentile)
    return sims.sparkSession.createDataFrame([(round(max(floor if found is None else found, floor), 4),)], "threshold double")


def _blocks(cents: DataFrame, columns: list[str], most: int) -> list[list]:
    """The rows of a table of topics, computed once, in lists of at most about ``most``."""
    cents = cut(cents.select(*columns))
    n = -(-cents.count() // most)
    parts = (cents.where(F.pmod(F.xxhash64(columns[0]), F.lit(n)) == i).orderBy(columns[0]).collect() for i in range(n))
    return [p for p in parts if p]


def nearest(rows: DataFrame, cents: DataFrame, key: str = "id", vec: str = "v", most: int = 20_000) -> DataFrame:
    """(id, topic, sim): the closest centroid of every row, the smaller topic among equals.

    Centroids are computed once, counted, and go to the tasks in blocks of about ``most``, as a
    matrix that whole Arrow batches are multiplied with; rows don't move. Rows whose vector is
    null or of another length have no result.
    """
    kind = dict(rows.dtypes)[key]
    out = f"{key} {kind}, topic long, sim double"
    parts = _blocks(cents, ["topic", "centroid"], most)
    if not parts:
        return rows.select(key, F.lit(None).cast("long").alias("topic"), F.lit(None).cast("double").alias("sim")).where("false")
    each = [rows.select(key, vec).mapInArrow(_closest(part, key, vec), out) for part in parts]
    met = each[0]
    for now in each[1:]:
        met = met.unionByName(now)
    if len(parts) == 1:
        return met
    best = met.groupBy(key).agg(F.max(F.struct("sim", (-F.col("topic")).alias("minus"))).alias("m"))
    return best.select(key, (-F.col("m.minus")).alias("topic"), F.col("m.sim").alias("sim"))


def _closest(part: list, key: str, vec: str):
    import numpy as np
    import pyarrow as pa

    ids = np.array([r["topic"] for r in part], np.int64)
    matrix = np.array([r["centroid"] for r in part], float).T

    def work(batches):
        for b in batches:
            v = b.column(vec)
            at = np.flatnonzero(np.asarray(v.value_lengths().fill_null(-1)) == len(matrix))
            x = np.asarray(v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(at), len(matrix))
            sim = x @ matrix
            best = sim.argmax(axis=1) if len(at) else at
            yield pa.RecordBatch.from_pydict({key: b.column(key).take(pa.array(at)), "topic": pa.array(ids[best]), "sim": pa.array(sim[np.arange(len(at)), best])})

    return work


def silhouette(members: DataFrame, key: str = "id", topic: str = "topic", vec: str = "v", most: int = 20_000) -> DataFrame:
    """(id, topic, s): cosine silhouette of unit vectors in closed form, from topic sums; a topic of one has 0.

    Sums go to the tasks in blocks of about ``most`` topics, as matrices; members don't move.
    """
    import numpy as np
    import pyarrow as pa

    m = members.where(F.col(topic) >= 0).select(key, F.col(topic).cast("long").alias(topic), vec)
    sums = sum_vectors(m, [topic], vec, "s").join(m.groupBy(topic).agg(F.count("*").alias("n")), topic)
    kind = dict(m.dtypes)[key]

    def against(part: list):
        ids, n = np.array([r[topic] for r in part], np.int64), np.array([r["n"] for r in part], float)
        matrix = np.array([r["s"] for r in part], float).T

        def work(batches):
            for b in batches:
                t = np.asarray(b.column(topic))
                x = np.asarray(b.column(vec).flatten().to_numpy(zero_copy_only=False), float).reshape(len(t), len(matrix))
                d = x @ matrix
                at = np.searchsorted(ids, t).clip(0, len(ids) - 1)
                own = ids[at] == t
                rows = np.arange(len(t))
                a = np.where(own, (n[at] - d[rows, at]) / np.maximum(n[at] - 1, 1), np.nan)
                far = 1 - d / n
                far[rows[own], at[own]] = np.inf
                least = far.min(axis=1) if len(ids) and len(t) else np.full(len(t), np.inf)
                yield pa.RecordBatch.from_arrays(
                    [b.column(key), b.column(topic), pa.array(a, mask=~own), pa.array(least, mask=np.isinf(least)), pa.array(np.where(own, n[at], 0).astype(np.int64))],
                    names=[key, topic, "a", "b", "n"],
                )

        return work

    schema = f"`{key}` {kind}, `{topic}` long, a double, b double, n long"
    parts = [m.withColumn(vec, as_double(F.col(vec))).mapInArrow(against(p), schema) for p in _blocks(sums, [topic, "n", "s"], most)]
    if not parts:
        return m.select(key, topic, F.lit(None).cast("double").alias("s")).limit(0)
    met = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            met = met.unionByName(p)
        met = met.groupBy(key, topic).agg(F.max("a").alias("a"), F.min("b").alias("b"), F.max("n").alias("n"))
    return met.select(key, topic, F.when(F.col("n") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))


def davies_bouldin(members: DataFrame, topic: str = "topic", vec: str = "v", most: int = 20_000) -> DataFrame:
    """One row: mean over topics of the worst ratio of spread to distance; NULL for fewer than two topics."""
    import numpy as np
    import pyarrow as pa

    m = members.where(F.col(topic) >= 0).withColumn(topic, F.col(topic).cast("long"))
    cent = sum_vectors(m, [topic], vec, "s").join(m.groupBy(topic).agg(F.count("*").alias("n")), topic).select(topic, F.transform("s", lambda x: x / F.col("n")).alias("c"))
    gap = F.zip_with(as_double(F.col(vec)), "c", lambda x, y: (x - y) * (x - y))
    spread = m.join(cent, topic).groupBy(topic).agg(F.avg(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))).alias("spread"))
    t = cut(cent.join(spread, topic))

    def against(part: list):
        ids, width = np.array([r[topic] for r in part]), np.array([r["spread"] for r in part])
        centres = np.array([r["c"] for r in part], float)

        def work(batches):
            for b in batches:
                worst = []
                for k, c, w in zip(b.column(topic).to_pylist(), b.column("c").to_pylist(), b.column("spread").to_pylist()):
                    others = ids != k
                    far = np.linalg.norm(centres[others] - np.array(c), axis=1)
                    with np.errstate(divide="ignore"):
                        worst.append(float(((width[others] + w) / far).max()) if others.any() else None)
                yield pa.RecordBatch.from_arrays([b.column(topic), pa.array(worst, pa.float64())], names=[topic, "w"])

        return work

    parts = [t.mapInArrow(against(p), f"`{topic}` long, w double") for p in _blocks(t, [topic, "c", "spread"], most)]
    every = parts[0] if parts else t.select(topic, F.lit(None).cast("double").alias("w"))
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(topic).agg(F.max("w").alias("w")).agg(F.avg("w").alias("davies_bouldin"))


def ctfidf(doc_terms: DataFrame, topic: str = "topic", k: int = TOP_TERMS) -> DataFrame:
    """(topic, term, score, rank) of (id, topic, term, n) rows: class-based TF-IDF.

    Totals are over all documents, also those in no topic (below 0). Equal scores are ordered by
    term.
    """
    # read three times
    counts = Scratch(doc_terms.sparkSession, "counts").put(doc_terms.groupBy(topic, "term").agg(F.sum("n").alias("tf")))
    total = checked(counts.groupBy("term").agg(F.sum("tf").alias("total")))
    whole = counts.agg(F.sum("tf").alias("words"), F.countDistinct(F.when(F.col(topic) >= 0, F.col(topic))).alias("topics"))
    a = F.col("words") / F.greatest(F.col("topics"), F.lit(1))
    scored = (
        counts.where(F.col(topic) >= 0)
        .join(total, "term")
        .join(F.broadcast(whole))
        .select(topic, "term", (F.col("tf") * F.log(1 + a / F.greatest("total", F.lit(1)))).alias("score"))
    )
    w = Window.partitionBy(topic).orderBy(F.desc(F.round("score", 9)), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def together(docs: DataFrame, wanted: DataFrame, most: int = 200_000) -> DataFrame:
    """(term, term2, both): in how many documents (id, terms) the wanted pairs stand, those in none left out.

    A batch of documents is a bit set per term, and a pair is counted by the bits that two sets
    share: nothing is shuffled but counts, one per pair and task. A document without an id has
    terms, but no pairs. Pairs go to the tasks in blocks of about ``most``.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def counted(part: list):
        names = sorted({r["term"] for r in part} | {r["term2"] for r in part})
        number = {w: i for i, w in enumerate(names)}
        a, b = (np.array([number[r[c]] for r in part], np.int64) for c in ("term", "term2"))
        #: documents of a batch, and pairs at once: some 16 MB each
        width = max(64, min(8_192, (128 << 20) // len(names) // 64 * 64))

        def work(batches):
            words, total = pa.array(names, pa.string()), np.zeros(len(a), np.int64)
            for whole in batches:
                for start in range(0, whole.num_rows, width):
                    batch = whole.slice(start, width)
                    lists = batch.column("terms")
                    at = np.asarray(pc.index_in(lists.flatten(), words).fill_null(-1))
                    doc = np.asarray(pc.list_parent_indices(lists))
                    bits = np.zeros((len(names), width // 8), np.uint8)
                    at, doc = at[at >= 0], doc[at >= 0]
                    np.bitwise_or.at(bits, (at, doc >> 3), (1 << (doc & 7)).astype(np.uint8))
                    known = np.zeros(width, bool)
                    known[: batch.num_rows] = np.asarray(batch.column("id").is_valid())
                    bits, known = bits.view(np.uint64), np.packbits(known, bitorder="little").view(np.uint64)
                    step = max(1, (2 << 20) // bits.shape[1])
                    for i in range(0, len(a), step):
                        x, y = a[i : i + step], b[i : i + step]
                        both = bits[x] & bits[y]
                        both[x != y] &= known
                        total[i : i + step] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(a[some])), words.take(pa.array(b[some])), pa.array(total[some])], names=["term", "term2", "both"])

        return work

    parts = [docs.select("id", "terms").mapInArrow(counted(p), "term string, term2 string, both long") for p in _blocks(wanted, ["term", "term2"], most)]
    if not parts:
        return wanted.select("term", "term2", F.lit(0).cast("long").alias("both")).limit(0)
    met = parts[0]
    for p in parts[1:]:
        met = met.unionByName(p)
    return met.groupBy("term", "term2").agg(F.sum("both").alias("both"))


def npmi(doc_terms: DataFrame, topic_terms: DataFrame, n_docs: int, topic: str = "topic") -> DataFrame:
    """(topic, npmi): mean normalised mutual information of the pairs of each topic's terms, over all documents.

    Documents come as rows (id, term), or as rows (id, terms) of which each id has one. Only the
    topics' own terms and pairs are counted.
    """
    t = cut(topic_terms.select(topic, "term"))
    terms = t.select("term").distinct()
    pairs = t.join(t.select(topic, F.col("term").alias("term2")), topic).where("term < term2")
    docs = doc_terms if "terms" in doc_terms.columns else doc_terms.join(checked(terms), "term", "left_semi").groupBy("id").agg(F.collect_set("term").alias("terms"))
    # a term with itself stands for the documents that have it
    wanted = pairs.select("term", "term2").unionByName(terms.select("term", F.col("term").alias("term2"))).distinct()
    met = cut(together(docs, wanted))
    df = met.where("term = term2").select("term", F.col("both").alias("df"))
    n = F.lit(float(n_docs))
    pij, pi, pj = F.coalesce("both", F.lit(0)) / n, F.col("df") / n, F.col("df2") / n
    value = F.when(F.coalesce("both", F.lit(0)) == 0, -1.0).when(F.col("both") == n_docs, 1.0).otherwise(F.log(pij / (pi * pj)) / -F.log(pij))
    return (
        pairs.join(met, ["term", "term2"], "left")
        .join(df, "term", "left")
        .join(df.select(F.col("term").alias("term2"), F.col("df").alias("df2")), "term2", "left")
        .groupBy(topic)
        .agg(F.round(F.avg(value), 4).alias("npmi"))
    )


def labels(top: DataFrame, topic: str = "topic", n: int = 3) -> DataFrame:
    """(topic, label): the first terms in display form."""
    return (
        top.where(F.col("rank") <= n)
        .groupBy(topic)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", pretty(F.col("term")).alias("t")))), lambda s: s["t"]), " · ").alias("label"))
    )


def match_keys(new: list[tuple], old: list[tuple], least: float = MATCH_LEAST) -> dict:
    """{new topic: old key}: greedy one-to-one matching of unit centroids, best similarity first.

    For lists at hand; ``matched_keys`` takes tables of any size.
    """
    import numpy as np

    if not new or not old:
        return {}
    s = np.round(np.array([c for _, c in new], float) @ np.array([c for _, c in old], float).T, 12)
    i, j = np.nonzero(s >= least)
    return {new[a][0]: old[b][0] for a, b in _greedy(i, j, s[i, j])}


def _greedy(i, j, sim) -> list[tuple[int, int]]:
    """One-to-one pairs out of edges, the most similar first, then the smaller i and j."""
    import numpy as np

    out, left, right = [], set(), set()
    order = np.lexsort((j, i, -sim))
    for a, b in zip(i[order].tolist(), j[order].tolist()):
        if a not in left and b not in right:
            out.append((a, b))
            left.add(a)
            right.add(b)
    return out


def matched_keys(new: DataFrame, old: DataFrame, least: float = MATCH_LEAST, most: int = 2_000, here: int = 500_000) -> DataFrame:
    """(topic, key) of tables (topic, centroid) and (key, centroid): the matching of ``match_keys``; topics without a key have no row.

    Centroids of the new topics go to the tasks in blocks of about ``most``, as matrices; old ones
    don't move, and what comes back are the pairs that are similar enough. Of these, rounds take the
    pairs that are each other's best, which the greedy order takes as well, until at most ``here``
    are left for the driver. Centroids needn't have unit length.
    """
    import numpy as np
    import pyarrow as pa

    def units(column, size: int):
        """Row numbers and unit vectors of the lists that have this many values."""
        at = np.flatnonzero(np.asarray(column.value_lengths().fill_null(-1)) == size)
        x = np.asarray(column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(at), size)
        return at, x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]

    def close(topics, matrix):
        def work(batches):
            for whole in batches:
                for start in range(0, whole.num_rows, 512):
                    b = whole.slice(start, 512)
                    at, x = units(b.column("centroid"), matrix.shape[1])
                    sim = np.round(x @ matrix.T, 12)
                    row, col = np.nonzero(sim >= least)
                    yield pa.RecordBatch.from_arrays([topics.take(pa.array(col)), b.column("key").take(pa.array(at[row])), pa.array(sim[row, col])], names=["topic", "key", "sim"])

        return work

    spark, scratch = new.sparkSession, Scratch(new.sparkSession, "keys")
    kinds = f"topic {dict(new.dtypes)['topic']}, key {dict(old.dtypes)['key']}"
    new, old = scratch.put(new.select("topic", "centroid")), scratch.put(old.select("key", "centroid"))
    n = -(-new.count() // most)
    each = []
    for k in range(n):
        part = new.where(F.pmod(F.xxhash64("topic"), F.lit(n)) == k).toArrow().combine_chunks()
        cents = part.column("centroid").combine_chunks()
        for size in np.unique(np.asarray(cents.value_lengths().fill_null(0))).tolist():
            if size:
                at, matrix = units(cents, size)
                each.append(old.mapInArrow(close(part.column("topic").combine_chunks().take(pa.array(at)), matrix), f"{kinds}, sim double"))
    if not each:
        return spark.createDataFrame([], kinds)
    edges = each[0]
    for e in each[1:]:
        edges = edges.unionByName(e)
    edges, done = scratch.put(edges), []
    while edges.count() > here:
        first = F.min(F.struct((-F.col("sim")).alias("less"), "topic", "key")).alias("m")
        best = [edges.groupBy(side).agg(first).select("m.topic", "m.key") for side in ("topic", "key")]
        done.append(scratch.put(best[0].join(best[1], ["topic", "key"])))
        edges = scratch.put(edges.join(done[-1], "topic", "left_anti").join(done[-1], "key", "left_anti"))
    last = edges.toArrow()
    (topic, i), (key, j) = (np.unique(np.array(last.column(c).to_pylist(), object if last.num_rows else int), return_inverse=True) for c in ("topic", "key"))
    pairs = spark.createDataFrame([(topic[a], key[b]) for a, b in _greedy(i, j, last.column("sim").to_numpy())], kinds)
    for d in done:
        pairs = pairs.unionByName(d)
    return pairs


def min_cluster_size(n: int) -> int:
    return int(min(10, max(2, round(n**0.5 / 3))))


def refit_reason(model_age_days: float | None, emerging: int, fitted_on: int, window: int) -> str | None:
    """Why a model should be fitted again, the first reason that holds; None if it needn't be."""
    if model_age_days is None:
        return "no model"
    if model_age_days > 7:
        return "model is old"
    if emerging >= max(5, 0.20 * fitted_on):
        return "many emerging"
    if fitted_on and window >= 1.5 * fitted_on:
        return "window grew"
    return None


def scaled(points: DataFrame, keys: list[str], axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Axes brought to 0..1 per key; an axis without range is 0."""
    lo_hi = points.groupBy(*keys).agg(*[f(F.col(a)).alias(f"_{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))])
    span = {a: F.col(f"_hi_{a}") - F.col(f"_lo_{a}") for a in axes}
    out = [((F.col(a) - F.col(f"_lo_{a}")) / F.when(span[a] == 0, 1.0).otherwise(span[a])).alias(a) for a in axes]
    rest = [c for c in points.columns if c not in axes and c not in keys]
    return points.join(lo_hi, keys).select(*keys, *rest, *out)


def metrics(members: DataFrame, topic: str = "topic", vec: str = "v") -> DataFrame:
    """One row: records, topics, unassigned, coverage, silhouette and Davies-Bouldin index of a labelling."""
    n = members.agg(F.count("*").alias("articles"), F.countDistinct(F.when(F.col(topic) >= 0, F.col(topic))).alias("topics"), F.count_if(F.col(topic) < 0).alias("unassigned"))
    s = silhouette(members, topic=topic, vec=vec).agg(F.round(F.avg("s"), 6).alias("silhouette"))
    d = davies_bouldin(members, topic, vec).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))
    share = F.round((F.col("articles") - F.col("unassigned")) / F.nullif(F.col("articles"), F.lit(0)), 4)
    return n.withColumn("coverage", share).join(F.broadcast(s)).join(F.broadcast(d))
