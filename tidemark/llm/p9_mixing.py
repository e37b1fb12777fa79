"""Problem 9: records of several sources, combined to target weights.

Pfair scheduling. Each source's share of the whole, with its repeats, is cut into blocks of
equal size; a block's release time and deadline come from the source's weight, and
earliest-deadline-first puts the blocks in an order in which no source is ever a whole block
ahead of or behind its weight.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import one_row_per_id
from tidemark.llm.tokens import PATTERN, token_counts
from tidemark.session import Scratch

#: Tokens of a block, and slots of the schedule at most (about): beyond them the schedule is repeated.
BLOCK = 8_192
MOST_BLOCKS = 1 << 17
#: Ranges of the hash order in which a source's positions are summed.
RANGES = 4_096


def schedule(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """(source, block) in slot order, for a number of blocks per source.

    With N blocks in all and n of a source, its block k may not run before slot floor(kN/n) and
    must have run by slot ceil((k+1)N/n). Earliest deadline first meets all deadlines, as the
    weights add to one; ties go to the source with more blocks.
    """
    total = sum(blocks.values())
    ready: list = []
    waiting: list = []
    for s, n in blocks.items():
        if n:
            heapq.heappush(waiting, (0, s, 0))
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // blocks[s]), -blocks[s], s, k))
        _, _, s, k = heapq.heappop(ready)
        out.append((s, k))
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * total // blocks[s], s, k + 1))
    return out


@dataclass
class Mixture:
    """rows: (slot, place, source, doc_id, repeat_no, tokens), in order of slot and place; plan: one row per target source, on the driver."""

    rows: DataFrame
    plan: pd.DataFrame


def mix(df: DataFrame, targets: DataFrame, key: str, source: str, text: str, ranks: str, pattern: str = PATTERN) -> Mixture:
    """Documents with repeats, in an order that keeps every source to its target share of the tokens.

    ``targets`` has source, target_share and max_repeats, a row per source (it is collected: a
    mixture has few sources). The whole is as large as it can be with every share met and no
    document used more than max_repeats times: the scarcest source is used up. Shares are
    taken relative to those of the sources that have tokens; a source without any gives no
    row and is reported with 0. Documents of other or null sources, with a null id, or
    without tokens don't take part; repeated rows of an id count once. Each pass over a source
    goes through its documents in the same hashed order, and a document is used if at least
    half of it lies within its source's share. Up to MOST_BLOCKS blocks a source is never a
    whole block ahead of or behind its weight; beyond, two at most, however much data there is.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    want = targets.select("source", F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("long").alias("cap")).where("source is not null and share > 0 and cap > 0").dropDuplicates(["source"]).toPandas()
    names = want["source"].tolist()
    docs = one_row_per_id(df.where(F.col(source).isin(names)).select(F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")), "doc_id")
    h = F.xxhash64("doc_id", F.lit(99))
    sized = scratch.put(token_counts(docs, "text", ranks, pattern).where("tokens > 0").withColumn("h", h).withColumn("range", F.shiftrightunsigned("h", 52)), "sized")
    ranges = sized.groupBy("source", "range").agg(F.sum("tokens").alias("n"))
    own = {r["source"]: r["n"] for r in ranges.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    plan = want.assign(own=[own.get(s, 0) for s in names])
    live = plan[plan["own"] > 0]
    share = live["share"] / live["share"].sum() if len(live) else live["share"]
    size = float((live["cap"] * live["own"] / share).min()) if len(live) else 0.0
    need = {s: min(int(w * size + 1e-6), int(c * n)) for s, w, c, n in zip(live["source"], share, live["cap"], live["own"])}
    blocks = {s: -(-n // BLOCK) for s, n in need.items()}
    # a schedule for so many periods alike: a source has its share of blocks in each, but for one
    periods = max(1, -(-sum(blocks.values()) // MOST_BLOCKS))
    order = pd.DataFrame(schedule({s: -(-n // periods) for s, n in blocks.items()}), columns=["source", "nth"])
    order["at_slot"] = range(len(order))
    slots = spark.createDataFrame(order, "source string, nth long, at_slot long") if len(order) else spark.createDataFrame([], "source string, nth long, at_slot long")
    facts = spark.createDataFrame([(s, int(own[s]), int(n), blocks[s]) for s, n in need.items()], "source string, own long, need long, blocks long")

    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("source", "range", "offset")
    within = Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.join(offsets, ["source", "range"])
        .withColumn("at", F.col("offset") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        .join(F.broadcast(facts), "source")
        .withColumn("last", F.floor((F.col("need") - F.col("at") - F.col("tokens") / 2) / F.col("own")).cast("long"))
        .where("last >= 0")
        .select("source", "doc_id", "tokens", "at", "own", "blocks", "h", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("pass"))
        .withColumn("start", F.col("at") + F.col("pass") * F.col("own"))
        .withColumn("block", F.floor(F.col("start") / BLOCK).cast("long"))
        .withColumn("period", F.expr(f"block * {periods} div blocks"))
        .withColumn("nth", F.expr(f"block - (period * blocks + {periods - 1}) div {periods}"))
    )
    # the schedule has about MOST_BLOCKS rows at most, and one per source
    rows = placed.join(F.broadcast(slots), ["source", "nth"]).withColumn("slot", F.col("period") * len(order) + F.col("at_slot"))
    place = F.row_number().over(Window.partitionBy("slot").orderBy("start", "doc_id")).cast("long")
    return Mixture(rows.select("slot", place.alias("place"), "source", "doc_id", (F.col("pass") + 1).alias("repeat_no"), "tokens"), plan)


def shares(m: Mixture) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_repeats, max_repeats): what came out, per target source."""
    spark = m.rows.sparkSession
    plan = spark.createDataFrame([(s, float(w), int(c)) for s, w, c in zip(m.plan["source"], m.plan["share"], m.plan["cap"])], "source string, target_share double, max_repeats long")
    got = m.rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), F.max("repeat_no").alias("most_repeats"))
    out = plan.join(got, "source", "left").fillna(0, ["tokens", "documents", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    return out.select("source", "target_share", F.round(F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0), 6).alias("actual_share"), "tokens", "documents", "most_repeats", "max_repeats")
