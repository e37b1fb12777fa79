"""64-bit SimHash of word triples, and distances between such values."""

from __future__ import annotations

import re
from hashlib import md5
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PUNCTUATION = re.compile(r"[^\w\s]")


def plain_words(text: str) -> list[str]:
    """Words of the normalised text, as ``text.normalise`` has them."""
    return _PUNCTUATION.sub("", text.lower()).split()


def simhash_of(text: str | None) -> int | None:
    """Signed 64-bit value; NULL for NULL. A text under three words counts as one piece."""
    if text is None:
        return None
    w = plain_words(text)
    pieces = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    raw = b"".join(md5(p.encode("utf-8", "surrogatepass")).digest()[:8] for p in pieces)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    most = bits.sum(axis=0, dtype=np.int64) * 2 > len(pieces)
    return int(np.packbits(most).view(">i8")[0])


@F.pandas_udf(T.LongType())
def _simhash(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash_of(t) for t in texts], dtype="Int64")


def simhash64(c: Column) -> Column:
    return _simhash(c)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(c: Column, n: int = 4) -> Column:
    """The value cut into n equal bands, as an array of structs (band, key)."""
    width = 64 // n
    mask = (1 << width) - 1
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(c, i * width).bitwiseAND(F.lit(mask)).alias("key")) for i in range(n)])


#: 64 bits in five blocks; values that differ in at most three bits agree in two of them.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def block_pairs(c: Column) -> Column:
    """Ten keys of 25 or 26 bits, numbered in their upper bits: one at least is the same for any three-bit neighbours."""
    keys = []
    for n, (i, j) in enumerate(combinations(range(5), 2)):
        parts = [F.shiftrightunsigned(c, BLOCKS[k][0]).bitwiseAND(F.lit((1 << BLOCKS[k][1]) - 1)) for k in (i, j)]
        keys.append(F.lit(n << 32) + F.shiftleft(parts[0], 13) + parts[1])
    return F.array(*keys)
