"""Problem 8: documents into containers of a fixed number of tokens.

Mixture-controlled packing. Documents are hashed to buckets of bounded size; in each bucket
deficit round-robin over source queues fills one container after the other towards the target
proportions. Deficits go from container to container and, through a prefix sum over buckets,
from bucket to bucket.
"""

from __future__ import annotations

from bisect import bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import one_row_per_id
from tidemark.llm.tokens import PATTERN, token_counts
from tidemark.session import Scratch, spread

CAPACITY = 2_048
#: Containers of one bucket, about: a bucket is one task's work, and can waste one container.
BUCKET = 1_500
#: Buckets that one window sums.
RANGE = 4_096


def fill(items: list[tuple[int, str, int]], share: dict[str, float], deficit: dict[str, float], capacity: int) -> list[tuple[int, int, int, int]]:
    """(doc, part, container, tokens) of (doc, source, tokens) items, in the order they are put.

    A document above the capacity is cut: full containers of its own, and a rest that is an
    item like any other. A container opens by adding the sources' share of the capacity to
    their deficits; then the source with the largest deficit that has a fitting item gives its
    largest one, until nothing fits.
    """
    out: list[tuple[int, int, int, int]] = []
    queues: dict[str, list[tuple[int, int, int]]] = {}
    container = 0
    for doc, source, n in items:
        part = 0
        while n > capacity:
            out.append((doc, part, container, capacity))
            deficit[source] = deficit.get(source, 0.0) - capacity
            for s, w in share.items():
                deficit[s] = deficit.get(s, 0.0) + w * capacity
            n -= capacity
            part += 1
            container += 1
        queues.setdefault(source, []).append((n, -doc, -part))
    for q in queues.values():
        q.sort()
    while queues:
        for s, w in share.items():
            deficit[s] = deficit.get(s, 0.0) + w * capacity
        room = capacity
        order = sorted((-deficit.get(s, 0.0), s) for s in queues)
        while order:
            for k, (_, s) in enumerate(order):
                q = queues[s]
                at = bisect_right(q, (room, 1, 1)) - 1
                if at >= 0:
                    n, doc, part = q.pop(at)
                    out.append((-doc, -part, container, n))
                    room -= n
                    deficit[s] = deficit.get(s, 0.0) - n
                    del order[k]
                    if q:
                        insort(order, (-deficit[s], s))
                    else:
                        del queues[s]
                    break
            else:
                break
        container += 1
    return out


def before(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the smaller buckets, per key.

    Buckets are summed in ranges of RANGE first, so that a window holds one range's buckets, or
    the few ranges, and never all buckets.
    """
    rows = df.withColumn("_range", F.floor(F.col("bucket") / RANGE))
    past = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = rows.groupBy(*keys, "_range").agg(F.sum(value).alias(value))
    ranges = ranges.select(*keys, "_range", past(Window.partitionBy(*keys).orderBy("_range")).alias("_past"))
    inside = rows.withColumn("_own", past(Window.partitionBy(*keys, "_range").orderBy("bucket")))
    return inside.join(ranges, [*keys, "_range"]).withColumn(name, F.col("_past") + F.col("_own")).drop("_range", "_past", "_own")


def pack(df: DataFrame, key: str, source: str, text: str, ranks: str, capacity: int = CAPACITY, targets: dict[str, float] | None = None, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, part_no, container, tokens): where every document goes.

    Every document with a non-null id is packed once, whole unless it exceeds the capacity;
    repeated rows of an id count once. Null and empty texts have no tokens and go with
    others into a container. Without ``targets`` each source's target is its share of all
    tokens; sources without a target only fill what room is left; a null source is a source
    of its own. A container's number is its bucket times 2^32 plus its place there.
    """
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    scratch = Scratch(df.sparkSession, "pack")
    docs = one_row_per_id(df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text")), "doc_id")
    docs = spread(docs, "doc_id")
    sized = scratch.put(token_counts(docs, "text", ranks, pattern), "sized")
    total = sized.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    buckets = max(1, -(-(total["t"] or 0) // (capacity * BUCKET)), -(-total["n"] // 1_000_000))
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    per = sized.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens"))
    if targets is None:
        whole = float(total["t"] or 1)
        share = per.groupBy("source").agg((F.sum("tokens") / whole).alias("share"))
    else:
        share = df.sparkSession.createDataFrame(list(targets.items()), "source string, share double")
    # what each bucket inherits: target minus actual tokens of the buckets before it
    size = before(per.groupBy("bucket").agg(F.sum("tokens").alias("all")), [], "all", "all_before")
    carry = scratch.put(
        before(per, ["source"], "tokens", "own_before")
        .join(size, "bucket")
        .join(share, "source", "left")
        .select("bucket", "source", F.coalesce("share", F.lit(0.0)).alias("share"), (F.coalesce("share", F.lit(0.0)) * F.col("all_before") - F.col("own_before")).alias("deficit")),
        "carry",
    )

    def work(key_, left: pa.Table, right: pa.Table) -> pa.Table:
        share = dict(zip(right.column("source").to_pylist(), right.column("share").to_pylist()))
        deficit = dict(zip(right.column("source").to_pylist(), right.column("deficit").to_pylist()))
        items = sorted(zip(left.column("doc_id").to_pylist(), left.column("source").to_pylist(), left.column("tokens").to_pylist()))
        rows = fill(items, share, deficit, capacity)
        base = key_[0].as_py() << 32
        cols = list(zip(*rows)) if rows else [(), (), (), ()]
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "part_no": pa.array(cols[1], pa.int64()), "container": pa.array([base + c for c in cols[2]], pa.int64()), "tokens": pa.array(cols[3], pa.int64())})

    return sized.groupBy("bucket").cogroup(carry.groupBy("bucket")).applyInArrow(work, "doc_id long, part_no long, container long, tokens long")


def report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, documents, tokens, and the share of the room that is used."""
    return packed.agg(
        F.countDistinct("container").alias("containers"), F.countDistinct("doc_id").alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")
    ).withColumn("used", F.round(F.col("tokens") / (F.col("containers") * capacity), 6))
