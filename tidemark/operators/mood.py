"""The mood of texts by a word list with weights: sentences rated by the rules of Hutto and Gilbert (2014)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.language import BAD, GOOD

#: A word list for want of a better one; real ones have thousands of words and come from a file.
SMALL = {**{w: 2.0 for w in GOOD}, **{w: -2.0 for w in BAD}}

# Fixed values of the published rules: a booster's step, a negation's factor, the weight of capitals,
# of an exclamation mark, and what a sum is brought to -1..1 by.
STEP, NEGATED, CAPITALS, EXCLAIMED, ALPHA = 0.293, -0.74, 0.733, 0.292, 15
# Common boosters, dampeners and negations.
MORE = ("absolutely", "amazingly", "completely", "deeply", "especially", "extremely", "highly", "hugely", "incredibly", "most", "more", "particularly", "really", "remarkably", "so", "totally", "truly", "utterly", "very")
LESS = ("almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally", "partly", "scarcely", "slightly", "somewhat")
NOT = ("not", "no", "never", "none", "neither", "nor", "nothing", "without", "cannot", "isn't", "wasn't", "aren't", "weren't", "don't", "doesn't", "didn't", "can't", "couldn't", "won't", "wouldn't", "shouldn't", "hasn't", "haven't", "hadn't")
_STEPS = {**dict.fromkeys(MORE, STEP), **dict.fromkeys(LESS, -STEP)}
_SENTENCE = re.compile(r"(?<=[.!?])[\"”’)]*\s+|\n+")
_WORD = re.compile(r"[\w'-]+")


def read_lexicon(spark: SparkSession, path: str) -> dict[str, float]:
    """A word list out of a file of lines "word TAB weight ..."; it has as many entries as a language has such words."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).select(F.lower(F.get(cells, F.lit(0))).alias("w"), F.get(cells, F.lit(1)).try_cast("double").alias("x")).where("x is not null").collect()
    return {r["w"]: r["x"] for r in rows}


def rate(sentence: str, lexicon: dict[str, float]) -> float:
    """The mood of a sentence, -1 to 1: words of the list, stronger or weaker by the three words before them."""
    words = _WORD.findall(sentence.replace("’", "'"))
    low = [w.lower() for w in words]
    shouted = any(w.isupper() and len(w) > 1 for w in words) and not all(w.isupper() for w in words)
    parts = []
    for i, w in enumerate(low):
        x = lexicon.get(w, 0.0)
        if x:
            sign = 1 if x > 0 else -1
            if shouted and words[i].isupper():
                x += sign * CAPITALS
            before = list(enumerate(reversed(low[max(0, i - 3) : i])))
            x += sign * sum(_STEPS.get(b, 0.0) * (1 - 0.05 * k) for k, b in before if b not in lexicon)
            if any(b in NOT for _, b in before):
                x *= NEGATED
        parts.append(x)
    if "but" in low:  # what comes after it counts more
        at = low.index("but")
        parts = [x * (0.5 if i < at else 1.5 if i > at else 1.0) for i, x in enumerate(parts)]
    total = sum(parts)
    total += math.copysign(min(4, sentence.count("!")) * EXCLAIMED, total) if total else 0.0
    return total / math.sqrt(total * total + ALPHA)


def mean_rate(text: str | None, lexicon: dict[str, float]) -> float:
    """The mean over sentences of three words or more, to four places; 0 without any."""
    rates = [rate(s, lexicon) for s in _SENTENCE.split(text or "") if len(s.split()) >= 3]
    return round(sum(rates) / len(rates), 4) if rates else 0.0


def sentiment(df: DataFrame, key: str, text: str, lexicon: dict[str, float]) -> DataFrame:
    """(id, sentiment) of every row; null and empty texts have 0. The list goes to each worker once."""
    shared = df.sparkSession.sparkContext.broadcast(lexicon)
    kind = dict(df.dtypes)[key]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([mean_rate(t, shared.value) for t in b.column("text").to_pylist()], pa.float64())], names=["id", "sentiment"])

    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(work, f"id {kind}, sentiment double")
