"""Problem 1: new batches against everything accepted before.

Incremental record linkage. History is kept as blocking-key tables (address, content hash, and
pairs of SimHash blocks) in the shared folder; a batch probes them, so accepted texts are never
read again. Pairs that meet get a score from field weights learned by expectation maximisation,
and a union-find table maps every new record to its cluster's representative, touching only
the clusters that the batch reaches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.simhash import block_pairs, hamming, simhash64
from tidemark.functions.text import content_hash
from tidemark.functions.urls import canonical_url
from tidemark.llm.common import components, one_row_per_id
from tidemark.session import Scratch, cut

DISTANCE = 3


def with_hashes(df: DataFrame, title: str, body: str) -> DataFrame:
    """Null content_hash and simhash derived from the text; the texts are dropped."""
    t, b = F.col(title), F.col(body)
    rest = [c for c in df.columns if c not in (title, body, "content_hash", "simhash")]
    have = F.col("simhash").isNotNull() | b.isNull()
    h = F.coalesce(F.col("content_hash"), F.when(t.isNotNull() | b.isNotNull(), content_hash(t, b))).alias("content_hash")
    known = df.where(have).select(*rest, h, F.col("simhash").cast("long").alias("simhash"))
    return known.unionByName(df.where(~have).select(*rest, h, simhash64(b).alias("simhash")))


@dataclass
class History:
    """Persisted keys: urls (key, node), hashes (key, node), values (simhash, node), blocks (key, simhash).

    The node is the smallest of its key. reps (node, rep, gen) is the union-find table: the
    representative of each node that is in a cluster with others; of several rows of a node the
    one of the latest generation (batch) holds. Nodes it doesn't hold represent themselves. A
    batch adds files with its own rows; no table is ever rewritten.
    """

    urls: DataFrame
    hashes: DataFrame
    values: DataFrame
    blocks: DataFrame
    reps: DataFrame
    gen: int = 0


def node_of(url: Column) -> Column:
    """A record's node in the union-find table: 64 bits of its canonical address, never negative."""
    return F.xxhash64(url).bitwiseAND(F.lit((1 << 63) - 1))


def new_node() -> Column:
    """The node of a batch row that begins a cluster: of its address, or else of what it has."""
    return node_of(F.coalesce("url", "canonical_url", "content_hash", F.concat(F.lit("row "), F.col("incoming_id").cast("string"))))


def build_history(articles: DataFrame, seen: DataFrame, scratch: Scratch) -> History:
    """Blocking-key tables of accepted articles and seen addresses, written once and then only added to.

    Records with the same content hash or SimHash value are one cluster, as stars to the
    smallest node of the key.
    """
    arts = with_hashes(articles.select("canonical_url", "content_hash", "simhash", "title", "body"), "title", "body")
    arts = scratch.put(arts.select(node_of(F.coalesce("canonical_url", "content_hash", F.lit(""))).alias("node"), "content_hash", "simhash"), "articles")
    s = seen.select("url", "content_hash", node_of(F.coalesce("url", F.lit(""))).alias("node"))
    urls = s.where("url is not null").groupBy(F.col("url").alias("key")).agg(F.min("node").alias("node"))
    by_hash = arts.select(F.col("content_hash").alias("key"), "node").unionByName(s.select(F.col("content_hash").alias("key"), "node")).where("key is not null")
    by_value = arts.where("simhash is not null").select(F.col("simhash").alias("key"), "node")
    hashes = scratch.put(by_hash.groupBy("key").agg(F.min("node").alias("node"), F.max("node").alias("last")), "hashes")
    values = scratch.put(by_value.groupBy("key").agg(F.min("node").alias("node"), F.max("node").alias("last")), "values")

    def stars(members: DataFrame, keys: DataFrame) -> DataFrame:
        shared = keys.where("node < last").select("key", F.col("node").alias("a"))
        return members.join(shared, "key").where("node <> a").select("a", F.col("node").alias("b"))

    reps = components(stars(by_hash, hashes).unionByName(stars(by_value, values))).select("node", F.col("root").alias("rep"), F.lit(0).alias("gen"))
    values = values.select(F.col("key").alias("simhash"), "node")
    blocks = values.select(F.explode(block_pairs(F.col("simhash"))).alias("key"), "simhash")
    return History(urls, hashes.select("key", "node"), values, scratch.put(blocks, "blocks"), scratch.put(reps, "reps"))


def add_to_history(history: History, fresh: DataFrame, scratch: Scratch, links: Links | None = None) -> History:
    """History with the accepted rows of a batch (``fresh``: incoming_id, url, canonical_url, content_hash, simhash).

    The batch's ``links`` give the clusters it merged; their nodes get the new representative.
    Only the batch's own keys and those nodes are written, as further files of each table.
    """
    r = fresh.withColumn("node", new_node())
    urls = r.select(F.explode(F.array_distinct(F.array("url", "canonical_url"))).alias("key"), "node").where("key is not null")
    hashes = r.where("content_hash is not null").select(F.col("content_hash").alias("key"), "node")
    values = scratch.put(r.where("simhash is not null").groupBy("simhash").agg(F.min("node").alias("node")), "values")
    blocks = values.select(F.explode(block_pairs(F.col("simhash"))).alias("key"), "simhash")
    return History(
        history.urls.unionByName(scratch.put(urls, "urls")),
        history.hashes.unionByName(scratch.put(hashes, "hashes")),
        history.values.unionByName(values),
        history.blocks.unionByName(scratch.put(blocks, "blocks")),
        history.reps if links is None else history.reps.unionByName(scratch.put(moved(history, links), "reps")),
        history.gen + 1,
    )


def moved(history: History, links: Links) -> DataFrame:
    """Rows that a batch adds to the union-find table: the nodes of the clusters it merged, at their smallest node."""
    roots = cut(components(best_links(links)[1]).where("node <> root"))
    was = history.reps.join(roots.select(F.col("node").alias("rep")), "rep", "left_semi").select("node").distinct()
    now = history.reps.join(was, "node", "left_semi").groupBy("node").agg(F.max(F.struct("gen", "rep")).alias("m"))
    old = now.select("node", F.col("m.rep").alias("rep")).join(roots.withColumnRenamed("node", "rep"), "rep").select("node", F.col("root").alias("rep"))
    return old.unionByName(roots.select("node", F.col("root").alias("rep"))).distinct().withColumn("gen", F.lit(history.gen + 1))


def prepare(incoming: DataFrame) -> DataFrame:
    """(incoming_id, url, canonical_url, content_hash, simhash): both addresses in canonical form, derived hashes."""
    rows = one_row_per_id(
        incoming.select("incoming_id", "url", "canonical_url", "content_hash", "simhash", "title", "body"), "incoming_id"
    )
    return with_hashes(rows.withColumns({c: canonical_url(F.col(c)) for c in ("url", "canonical_url")}), "title", "body")


def near_values(left: DataFrame, blocks: DataFrame) -> DataFrame:
    """(simhash, other, d): values of ``left`` and values in the block table within the distance.

    Values are distinct on both sides, so copies cost nothing; a pair is made by its first
    common key only.
    """
    keys = left.select("simhash", F.explode(block_pairs(F.col("simhash"))).alias("key"))
    both = keys.join(blocks.select("key", F.col("simhash").alias("other")), "key")
    d = hamming(F.col("simhash"), F.col("other"))
    return both.where(d <= DISTANCE).select("simhash", "other", d.cast("int").alias("d")).distinct()


def probe(batch: DataFrame, history: History) -> DataFrame:
    """(incoming_id, node, by_url, by_hash, d): records of history that a batch row meets, by kind of key.

    All values within the distance are met. Of the records that share a key, which are one
    cluster, the smallest node stands for all.
    """
    urls = batch.select("incoming_id", F.explode(F.array_distinct(F.array("url", "canonical_url"))).alias("key")).where("key is not null")
    u = urls.join(history.urls, "key").select("incoming_id", "node", F.lit(1).alias("by_url"), F.lit(0).alias("by_hash"), F.lit(None).cast("int").alias("d"))
    h = batch.select("incoming_id", F.col("content_hash").alias("key")).where("key is not null").join(history.hashes, "key")
    h = h.select("incoming_id", "node", F.lit(0).alias("by_url"), F.lit(1).alias("by_hash"), F.lit(None).cast("int").alias("d"))
    near = near_values(batch.where("simhash is not null").select("simhash").distinct(), history.blocks)
    s = (
        near.join(history.values.withColumnRenamed("simhash", "other"), "other")
        .join(batch.select("incoming_id", "simhash"), "simhash")
        .select("incoming_id", "node", F.lit(0).alias("by_url"), F.lit(0).alias("by_hash"), "d")
    )
    met = u.unionByName(h).unionByName(s)
    return met.groupBy("incoming_id", "node").agg(F.max("by_url").alias("by_url"), F.max("by_hash").alias("by_hash"), F.min("d").alias("d"))


def within_batch(batch: DataFrame, cases: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(incoming_id, of): rows that repeat an earlier row of the batch which is no case itself, and the first such row.

    Rows and keys form a bipartite table: a row holds its addresses, its hash and its SimHash
    value, and meets the keys it holds and those of near values. Row by row this is a greedy
    scan; here each round decides every row whose earlier rows are decided. Only smallest ids
    per key are aggregated, so one key of very many rows costs one round, not pairs.
    """
    rest = batch.join(cases, "incoming_id", "left_anti")
    values = rest.where("simhash is not null").select("simhash").distinct()
    pairs = near_values(values, values.select(F.explode(block_pairs(F.col("simhash"))).alias("key"), "simhash"))
    holds = rest.select(
        "incoming_id",
        F.explode(
            F.array_distinct(F.array(F.xxhash64(F.lit("u"), "url"), F.xxhash64(F.lit("u"), F.coalesce("canonical_url", "url")),
                                     F.coalesce(F.xxhash64(F.lit("h"), "content_hash"), F.lit(0).cast("long"))))
        ).alias("key"),
    )
    none = rest.select("incoming_id", F.explode(F.array(*[F.when(F.col(c).isNull(), F.xxhash64(F.lit(k), c)) for k, c in (("u", "url"), ("h", "content_hash"))])).alias("key"))
    holds = holds.join(none.where("key is not null"), ["incoming_id", "key"], "left_anti").where("key <> 0")
    sim = rest.where("simhash is not null").select("incoming_id", "simhash")
    holds_sim = sim.select("incoming_id", F.xxhash64(F.lit("s"), "simhash").alias("key"))
    meets_sim = sim.join(pairs, "simhash").select("incoming_id", F.xxhash64(F.lit("s"), "other").alias("key"))
    held, met = holds.unionByName(holds_sim), holds.unionByName(meets_sim)
    # keys of one row only, and rows that meet no other, need no rounds
    shared = met.groupBy("key").agg(F.min("incoming_id").alias("x"), F.max("incoming_id").alias("y")).where("x < y").select("key")
    met = cut(met.join(shared, "key", "left_semi"))
    held = cut(held.join(met.select("incoming_id").distinct(), "incoming_id", "left_semi").join(shared, "key", "left_semi"))
    state = cut(met.select("incoming_id").distinct().select("incoming_id", F.lit(0).alias("state"), F.lit(None).cast("long").alias("of")))
    for _ in range(most_rounds):
        if state.where("state = 0").isEmpty():
            return state.where("state = 2").select("incoming_id", "of")
        first = held.join(state.where("state < 2"), "incoming_id").groupBy("key").agg(
            F.min(F.when(F.col("state") == 1, F.col("incoming_id"))).alias("kept"), F.min(F.when(F.col("state") == 0, F.col("incoming_id"))).alias("open")
        )
        verdict = (
            met.join(state.where("state = 0").select("incoming_id"), "incoming_id", "left_semi")
            .join(first, "key", "left")
            .groupBy("incoming_id")
            .agg(F.min("kept").alias("kept"), F.min("open").alias("open"))
            .select("incoming_id", "kept", F.when(F.col("kept") < F.col("incoming_id"), 2).when(F.coalesce(F.col("open") < F.col("incoming_id"), F.lit(False)), 0).otherwise(1).alias("new"))
        )
        of = F.coalesce("of", F.when(F.col("new") == 2, F.col("kept")))
        state = cut(state.join(verdict, "incoming_id", "left").select("incoming_id", F.coalesce("new", "state").alias("state"), of.alias("of")))
    raise RuntimeError("within_batch: rows left undecided")


def learned_weights(met: DataFrame, rounds: int = 25) -> dict[tuple[int, int, int], float]:
    """Score of every agreement pattern (address, hash, distance class), by expectation maximisation.

    Fellegi-Sunter with two classes and independent fields, fitted on pattern counts: sixteen
    at most, over all candidate pairs. The distance class is 0 (equal) to 2 (3 bits), 3 for no
    near value.
    """
    klass = F.when(F.col("d").isNull(), 3).when(F.col("d") == 0, 0).when(F.col("d") <= 1, 1).otherwise(2)
    got = met.groupBy("by_url", "by_hash", klass.alias("k")).count().collect()
    counts = {(r["by_url"], r["by_hash"], r["k"]): r["count"] for r in got}
    total = sum(counts.values()) or 1
    m = [{1: 0.9, 0: 0.1}, {1: 0.9, 0: 0.1}, {0: 0.6, 1: 0.2, 2: 0.1, 3: 0.1}]
    u = [{1: 0.3, 0: 0.7}, {1: 0.05, 0: 0.95}, {0: 0.05, 1: 0.1, 2: 0.25, 3: 0.6}]
    share = 0.5
    for _ in range(rounds):
        g = {}
        for p in counts:
            a = share * math.prod(m[i][x] for i, x in enumerate(p))
            b = (1 - share) * math.prod(u[i][x] for i, x in enumerate(p))
            g[p] = a / (a + b)
        share = min(0.99, max(0.01, sum(g[p] * n for p, n in counts.items()) / total))
        for i in range(3):
            for x in m[i]:
                hit = [(g[p], n) for p, n in counts.items() if p[i] == x]
                m[i][x] = (sum(q * n for q, n in hit) + 0.5) / (share * total + 2)
                u[i][x] = (sum((1 - q) * n for q, n in hit) + 0.5) / ((1 - share) * total + 2)
    return {p: sum(math.log2(m[i][x] / u[i][x]) for i, x in enumerate(p)) for p in counts}


@dataclass
class Links:
    """met: candidate pairs with history; inner: (incoming_id, of) repeats within the batch; cases: (incoming_id) of either; reps: the union-find table before the batch."""

    met: DataFrame
    inner: DataFrame
    cases: DataFrame
    reps: DataFrame


def link(batch: DataFrame, history: History) -> Links:
    """Which rows of a batch repeat history, or an earlier new row.

    Every pair that shares an address, a content hash, or a SimHash value within three bits is
    a link whatever its score: the score orders the clusters that a row may join. Rows are
    cases if linked. Missing fields never agree. An empty batch or history gives no cases from
    that side.
    """
    met = cut(probe(batch, history))
    known = met.select("incoming_id").distinct()
    inner = within_batch(batch, known)
    return Links(met, inner, known.unionByName(inner.select("incoming_id")).distinct(), history.reps)


def best_links(links: Links) -> tuple[DataFrame, DataFrame]:
    """(incoming_id, rep, score, n_clusters) of each row that meets history, its best record's cluster; (a, b): clusters that a row links."""
    met = links.met
    weights = learned_weights(met)
    klass = F.when(F.col("d").isNull(), 3).when(F.col("d") == 0, 0).when(F.col("d") <= 1, 1).otherwise(2)
    score = F.lit(0.0)
    for (a, b, k), w in weights.items():
        score = F.when((F.col("by_url") == a) & (F.col("by_hash") == b) & (klass == k), F.lit(w)).otherwise(score)
    latest = met.join(links.reps, "node", "left").groupBy("incoming_id", "node", "by_url", "by_hash", "d").agg(F.max(F.struct("gen", "rep")).alias("m"))
    scored = latest.select("incoming_id", "node", F.coalesce("m.rep", "node").alias("rep"), score.alias("score"))
    each = scored.groupBy("incoming_id", "rep").agg(F.max(F.struct("score", (-F.col("node")).alias("minus"))).alias("m"))
    best = each.groupBy("incoming_id").agg(F.max(F.struct("m", "rep")).alias("o"), F.count("*").alias("n_clusters"))
    best = best.select("incoming_id", F.col("o.rep").alias("rep"), F.col("o.m.score").alias("score"), "n_clusters")
    linked = best.where("n_clusters > 1").select("incoming_id", F.col("rep").alias("a")).join(each.select("incoming_id", F.col("rep").alias("b")), "incoming_id")
    return best, linked.select("a", "b")


def representatives(batch: DataFrame, links: Links) -> DataFrame:
    """(incoming_id, rep, score, n_clusters): each row's cluster after this batch, its union-find representative.

    A row joins the record of its best score; where it links several records, their clusters
    become one, the smallest node the representative; n_clusters counts the clusters met as
    they were before the batch. A row that repeats an earlier new row has
    that row's cluster, and a row without links begins one (score NULL, no clusters met). Only
    nodes met by the batch appear in the union-find edges, so clusters it doesn't reach are
    neither read nor written.
    """
    best, linked = best_links(links)
    roots = components(linked).withColumnRenamed("node", "rep")
    old = best.join(roots, "rep", "left").select("incoming_id", F.coalesce("root", "rep").alias("rep"), F.round("score", 4).alias("score"), "n_clusters")
    begun = batch.join(links.cases, "incoming_id", "left_anti").select("incoming_id", new_node().alias("rep"))
    again = links.inner.join(begun.withColumnRenamed("incoming_id", "of"), "of").select("incoming_id", "rep")
    none = begun.unionByName(again).select("incoming_id", "rep", F.lit(None).cast("double").alias("score"), F.lit(0).cast("long").alias("n_clusters"))
    return old.unionByName(none)
