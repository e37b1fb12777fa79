"""Problem 6: records that share most of their word sequences.

Grouped prefix join. Word sequences are ordered from rare to common by a count sketch of the
whole corpus, and a document's prefix are its rarest ones. Documents with the same prefix,
size and bit sketch are collapsed into one group, of which one member carries the keys. Prefix
elements are joined several at a time: a hash cuts the element space into segments, and groups
meet where they have the same elements, two at least, in a segment. Pairs of groups are
filtered by size and by the sketch, and their members are then compared exactly. Only packed
keys are shuffled, tasks hold a bounded number of them, and a segment that very many groups
share is split over blocks of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.simhash import plain_words
from tidemark.llm.common import checked, components, one_row_per_id
from tidemark.session import Scratch, spread

#: Counters of the sketch (4 bytes each): its size is fixed, so it may be collected and broadcast.
SLOTS = 1 << 20
SKETCH_BLOCKS = 64
#: Share of a document's sequences that is its prefix.
PREFIX = 0.7
#: Segments that a pair at the similarity bound shares in expectation, at least, when every
#: difference falls on rare elements; a pair is missed with a probability of exp(-EXPECTED) there
#: (4e-8 for differences anywhere), and less above the bound.
EXPECTED = 10
#: Up to this many sequences single prefix elements are joined, which is exact.
SHORT = 24
#: Bits of the sketch; pairs five standard deviations under the bound are filtered.
BITS = 128
#: Join entries of one block, and groups in a segment from which it is split.
BLOCK = 400_000
HOT = 2_000
#: Join entries that a task gathers before it packs them.
PACKED = 300_000
#: Ratio of neighbouring size classes.
STEP = 1.05

#: What a group sends to a part: the lower bits of a key (the upper ones choose the part), group, size class, bit sketch.
ENTRY = np.dtype([("t", "<u4"), ("g", "<u8"), ("c", "u1"), ("u", "<u8"), ("v", "<u8")])


class _Words(dict):
    """Word -> 64-bit hash, computed once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def sets_of(texts: list, width: int, words: _Words) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its sequences of ``width`` words; none for shorter or null texts."""
    lists = [plain_words(t) if t else [] for t in texts]
    n = [len(x) for x in lists]
    flat = np.fromiter(map(words.__getitem__, chain.from_iterable(lists)), np.uint64, sum(n))
    size = max(0, len(flat) - width + 1)
    h = np.zeros(size, np.uint64)
    for i in range(width):
        h = _mix(h + flat[i : i + size])
    out, at = [], 0
    for k in n:
        out.append(np.unique(h[at : at + k - width + 1]) if k >= width else h[:0])
        at += k
    return out


def _overlap(x: float) -> int:
    return math.ceil(x - 1e-9)


def _size_code(n: int) -> int:
    return min(255, int(math.log(n) / math.log(STEP)))


def sketch(docs: DataFrame, width: int, sim: float) -> tuple[np.ndarray, int]:
    """Counts of sequences by hashed slot, over all documents, and the number of prefix elements."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, slots, elements = _Words(), np.zeros(SLOTS, np.uint32), 0
        for b in batches:
            for x in sets_of(b.column("body").to_pylist(), width, words):
                if len(x):
                    slots[(x >> np.uint64(44)).astype(np.int64)] += 1  # distinct in a document but for slot collisions
                    elements += len(x) // 2
        if elements:
            step = SLOTS // SKETCH_BLOCKS
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array(range(SKETCH_BLOCKS), pa.int32()),
                    "counts": pa.array([slots[i * step : (i + 1) * step].tobytes() for i in range(SKETCH_BLOCKS)], pa.binary()),
                    "elements": pa.array([elements] + [0] * (SKETCH_BLOCKS - 1), pa.int64()),
                }
            )

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(SLOTS // SKETCH_BLOCKS, np.uint64)
        for c in t.column("counts"):
            total += np.frombuffer(c.as_buffer(), np.uint32)
        total = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
        return pa.table({"block": t.column("block").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary()), "elements": pa.array([sum(t.column("elements").to_pylist())], pa.int64())})

    schema = "block int, counts binary, elements long"
    rows = docs.select("body").mapInArrow(count, schema).groupBy("block").applyInArrow(add, schema).collect()
    slots = np.zeros(SLOTS, np.uint32)
    step = SLOTS // SKETCH_BLOCKS
    for r in rows:
        slots[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["counts"], np.uint32)
    return slots, sum(r["elements"] for r in rows)


def _needed(n: int, sim: float) -> int:
    """How many of its rarest elements a set of n must be joined by, so that no partner at the bound is missed."""
    return n - _overlap(sim * n) + 1


def _prefix(x: np.ndarray, counts: np.ndarray, sim: float) -> np.ndarray:
    """The rarest elements of a set in the corpus order, rarest first."""
    c = counts[(x >> np.uint64(44)).astype(np.int64)]
    p = len(x) if len(x) <= SHORT else max(math.ceil(PREFIX * len(x)), _needed(len(x), sim))
    order = np.argsort((np.minimum(c, 0xFFFFFF).astype(np.uint64) << np.uint64(40)) | (x >> np.uint64(24)), kind="stable")[:p]
    return x[order]


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1234)
    return rng.integers(0, 1 << 63, BITS, np.int64).astype(np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, BITS, np.int64).astype(np.uint64)


def bit_sketch(x: np.ndarray, by: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of BITS minimum hashes of a set: one bit each as two words, and one byte each."""
    low = np.full(BITS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 4096):
        low = np.minimum(low, (x[at : at + 4096, None] * by[0] + by[1]).min(axis=0))
    low >>= np.uint64(20)
    return np.packbits((low & np.uint64(1)).astype(np.uint8)).view("<u8"), ((low >> np.uint64(1)) & np.uint64(255)).astype(np.uint8)


def _level(n: np.ndarray) -> np.ndarray:
    """log2 of the number of segments for sets of n elements: two elements a segment, about."""
    return np.maximum(1, np.rint(np.log2(np.maximum(n, 4) / 2))).astype(np.int64)


def rounds_for(n: int, sim: float) -> int:
    """How often the elements are cut into segments, so that EXPECTED segments of a pair at the bound agree."""
    s = 2 * sim / (1 + sim)
    both = 2 * max(0.05, PREFIX - (1 - s))
    share = math.exp(-4 * (1 - s)) * (1 - math.exp(-both) * (1 + both))
    return min(200, math.ceil(EXPECTED / (share * n / 2)))


def segment_keys(prefixes: list[np.ndarray], sizes: np.ndarray, sim: float, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row of each): what the prefixes are joined by.

    The larger set of a pair decides the level and the number of rounds, so a set has its own
    level's keys and those of the largest partner it may have. Short sets, and all if
    ``exact``, are joined by the single elements of the prefix that suffices for the bound.
    """
    keys, rows = [], []
    short = np.flatnonzero((sizes > 0) & ((sizes <= math.floor(SHORT / sim)) | exact))
    for k in short.tolist():
        x = prefixes[k]
        p = min(len(x), _needed(int(sizes[k]), sim))
        keys.append(_mix(x[:p] ^ np.uint64(0x5151)))
        rows.append(np.full(p, k))
    long = np.flatnonzero((sizes > SHORT) & (not exact))
    if len(long):
        times = np.array([rounds_for(n, sim) for n in sizes[long].tolist()])
        n = np.array([len(prefixes[k]) for k in long])
        flat = np.concatenate([prefixes[k] for k in long])
        own, top = _level(sizes[long]), _level(sizes[long] / sim)
        for r in range(int(times.max())):
            h = _mix(flat + np.uint64(0x1F123BB5 * (r + 1)))
            e = _mix(h)
            for level, which in ((own, times > r), (top, (times > r) & (top != own))):
                if not which.any():
                    continue
                use = np.repeat(which, n)
                k = np.repeat(np.arange(len(long)), n)[use]
                lev = level[k].astype(np.uint64)
                seg = (k.astype(np.uint64) << np.uint64(32)) | (h[use] >> (np.uint64(64) - lev))
                order = np.argsort(seg, kind="stable")
                seg, el, k, lev = seg[order], e[use][order], k[order], lev[order]
                start = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
                size = np.diff(np.r_[start, len(seg)])
                total = np.add.reduceat(el, start)
                strong = size >= 2
                keys.append(_mix(total[strong] + lev[start][strong] * np.uint64(0x9E37) + np.uint64(r)))
                rows.append(long[k[start][strong]])
    none = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    return np.concatenate(keys or none[0]), np.concatenate(rows or none[1])


@dataclass
class Near:
    """members: (id, s, g, n), s the class of equal sets; links: (s1, s2, shared, combined), s1 < s2, of different sets."""

    members: DataFrame
    links: DataFrame


def _starts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of equal keys in sorted order."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    return start, np.diff(np.r_[start, len(key)])


def _meeting(start: np.ndarray, size: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of all pairs inside every run, at most about ``most`` at a time."""
    for k in np.unique(size[size > 1]).tolist():
        at = start[size == k]
        if k * (k - 1) // 2 <= most:
            i, j = np.triu_indices(k, 1)
            step = max(1, most // len(i))
            for lo in range(0, len(at), step):
                base = at[lo : lo + step, None]
                yield (base + i).ravel(), (base + j).ravel()
        else:
            step = max(1, most // k)
            for first in at.tolist():
                for lo in range(0, k - 1, step):
                    rows = np.arange(lo, min(k - 1, lo + step))
                    i = np.repeat(rows, k - 1 - rows)
                    yield first + i, first + np.concatenate([np.arange(r + 1, k) for r in rows.tolist()])


class _Distinct:
    """Pairs of groups, each once as far as what is held reaches; lets go of them in tables of bounded size."""

    def __init__(self, most: int = 500_000):
        self.most, self.held, self.size = most, [], 0

    def add(self, g: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[np.ndarray]:
        self.held.append(np.stack([np.minimum(g[i], g[j]), np.maximum(g[i], g[j])], 1))
        self.size += len(i)
        if self.size > self.most:
            p = np.unique(np.concatenate(self.held), axis=0)
            self.held, self.size = [p], len(p)
            if self.size > self.most // 2:
                self.held, self.size = [], 0
                yield p

    def rest(self) -> Iterator[np.ndarray]:
        if self.held:
            yield np.unique(np.concatenate(self.held), axis=0)
            self.held = []


def near_duplicates(df: DataFrame, key: str, body: str, width: int = 5, sim: float = 0.8, scratch: Scratch | None = None, exact: bool = False) -> Near:
    """All pairs of documents whose sets of ``width``-word sequences have a Jaccard similarity of ``sim`` or more.

    Documents with the same prefix, size and bit sketch are one group, formed before anything
    is joined: only one of them carries the group's keys into the join. Documents with equal
    sets are one class; links are between classes, so copies are never expanded into pairs.
    Null and empty texts, and texts under ``width`` words, have no sequences and no links.
    Repeated rows of an id count once. There is no cap on candidates or partners; a pair at
    the very bound is missed with the probability stated at EXPECTED, and sets are compared by
    64-bit hashes. With ``exact`` prefixes are joined by single elements and no sketch filters
    pairs, so that nothing can be missed, at many more candidates.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "near")
    docs = spread(one_row_per_id(df.select(F.col(key).cast("long").alias("id"), F.col(body).alias("body")), "id"), "id")
    counts, elements = sketch(docs, width, sim)
    counts_b = spark.sparkContext.broadcast(counts)
    parts = max(12, -(-elements // BLOCK))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, by = _Words(), counts_b.value, _multipliers()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                cut = b.slice(lo, 500)
                sets = sets_of(cut.column("body").to_pylist(), width, words)
                ids = [i for i, x in zip(cut.column("id").to_pylist(), sets) if len(x)]
                sets = [x for x in sets if len(x)]
                if not sets:
                    continue
                n = np.array([len(x) for x in sets])
                prefixes = [_prefix(x, counts, sim) for x in sets]
                sketches = [bit_sketch(x, by) for x in sets]
                bits = np.stack([w for w, _ in sketches])
                keys, rows = segment_keys(prefixes, n, sim, exact)
                order = np.argsort(rows, kind="stable")
                keys, ends = keys[order], np.searchsorted(rows[order], np.arange(len(sets) + 1))
                group = [xxhash.xxh64_intdigest(t.tobytes() + w.tobytes(), seed=len(x)) for t, w, x in zip(prefixes, bits, sets)]
                long = lambda x: pa.array(np.ascontiguousarray(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array(ids, pa.int64()), "s": long([xxhash.xxh64_intdigest(x.tobytes()) for x in sets]), "g": long(group), "n": pa.array(n, pa.int32()),
                        "u": long(bits[:, 0]), "v": long(bits[:, 1]), "sig": pa.array([k.tobytes() for _, k in sketches], pa.binary()),
                        "keys": pa.array([keys[ends[i] : ends[i + 1]].tobytes() for i in range(len(sets))], pa.binary()),
                    }
                )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One entry per key of a group, packed by the part that the key falls in."""
        held: list[np.ndarray] = []
        where: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            part = np.concatenate(where)
            order = np.argsort(part, kind="stable")
            e, part = np.concatenate(held)[order], part[order]
            start, n = _starts(part)
            there = part[start]
            raw = [e[a : a + k].tobytes() for a, k in zip(start.tolist(), n.tolist())]
            for lo in range(0, len(raw), 4096):
                yield pa.RecordBatch.from_pydict({"part": pa.array(there[lo : lo + 4096]), "entries": pa.array(raw[lo : lo + 4096], pa.binary())})

        for b in batches:
            g, u, v = (np.asarray(b.column(c)).view(np.uint64) for c in ("g", "u", "v"))
            code = np.array([_size_code(k) for k in b.column("n").to_pylist()], np.uint8)
            for k, raw in enumerate(b.column("keys")):
                x = np.frombuffer(raw.as_buffer(), np.uint64)
                e = np.empty(len(x), ENTRY)
                e["t"], e["g"], e["c"], e["u"], e["v"] = x & np.uint64(0xFFFFFFFF), g[k], code[k], u[k], v[k]
                held.append(e)
                where.append(((x >> np.uint64(32)) % np.uint64(parts)).astype(np.int32))
                size += len(e)
                if size > PACKED:
                    yield from flush()
                    held, where, size = [], [], 0
        if size:
            yield from flush()

    reach = int(math.log(1 / sim) / math.log(STEP)) + 2
    agree = (1 + sim) / 2
    differ = BITS if exact else math.floor(BITS * (1 - agree) + 5 * math.sqrt(BITS * agree * (1 - agree)))

    def allowed(e: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the positions of pairs, those of two groups that may hold a link."""
        c, u, v, g = (e[x] for x in ("c", "u", "v", "g"))
        ok = np.abs(c[i].astype(np.int16) - c[j].astype(np.int16)) <= reach
        i, j = i[ok], j[ok]
        ok = (np.bitwise_count(u[i] ^ u[j]).astype(np.int16) + np.bitwise_count(v[i] ^ v[j]) <= differ) & (g[i] != g[j])
        return i[ok], j[ok]

    def table(kind: int, x, y, c=None, u=None, v=None) -> list[pa.RecordBatch]:
        zero = np.zeros(len(x), np.int64)
        cols = [np.ascontiguousarray(col).view(np.int64) if col is not None else zero for col in (x, y, u, v)]
        kinds, code = pa.array(np.full(len(x), kind, np.int32)), pa.array(np.zeros(len(x), np.int32) if c is None else c.astype(np.int32))
        return pa.table([kinds, *map(pa.array, cols), code], names=["kind", "x", "y", "u", "v", "c"]).to_batches(max_chunksize=100_000)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of groups that share a key (kind 1), and the entries of hot segments (kind 2).

        A segment that is hot once leaves with all its later entries at once, so what is held
        is a block's share of the others however many groups share one segment.
        """
        hot = np.zeros(0, np.uint32)
        held: list[np.ndarray] = []
        size, most, part = 0, 2 * BLOCK, 0

        def wide(e: np.ndarray) -> list[pa.RecordBatch]:
            return table(2, e["t"] | np.uint64(part << 32), e["g"], e["c"], e["u"], e["v"])

        def settled() -> Iterator[pa.RecordBatch]:
            """Sorts what is held, once per (key, group), and lets hot segments go."""
            nonlocal hot, held, size
            e = np.concatenate(held)
            held = []
            e = e[np.lexsort((e["g"], e["t"]))]
            e = e[np.r_[True, (e["t"][1:] != e["t"][:-1]) | (e["g"][1:] != e["g"][:-1])]]
            start, n = _starts(e["t"])
            if (n > HOT).any():
                now = np.repeat(n > HOT, n)
                hot = np.union1d(hot, e["t"][start[n > HOT]])
                yield from wide(e[now])
                e = e[~now]
            held, size = [e], len(e)

        for b in batches:
            for part, raw in zip(b.column("part").to_pylist(), b.column("entries")):  # noqa: B007
                e = np.frombuffer(raw.as_buffer(), ENTRY)
                if len(hot):
                    gone = np.isin(e["t"], hot)
                    if gone.any():
                        yield from wide(e[gone])
                        e = e[~gone]
                held.append(e)
                size += len(e)
                if size > most:
                    yield from settled()
                    most = max(2 * BLOCK, 2 * size)
        if size:
            yield from settled()
        if size:
            e, found = held.pop(), _Distinct()
            e, start, n = {x: np.ascontiguousarray(e[x]) for x in ("c", "u", "v", "g")}, *_starts(e["t"])
            for i, j in _meeting(start, n):
                for p in found.add(e["g"], *allowed(e, i, j)):
                    yield from table(1, p[:, 0], p[:, 1])
            for p in found.rest():
                yield from table(1, p[:, 0], p[:, 1])

    signed = scratch.put(docs.mapInArrow(sign, "id long, s long, g long, n int, u long, v long, sig binary, keys binary"), "signed")
    many = signed.groupBy("g").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("g", "first")
    spare = checked(signed.select("id", "g").join(many, "g").where("id <> first").select("id"))
    packed = signed.join(spare, "id", "left_anti").select("g", "n", "u", "v", "keys").mapInArrow(pack, "part int, entries binary").repartitionById(parts, "part")
    met = scratch.put(packed.mapInArrow(meet, "kind int, x long, y long, u long, v long, c int"), "met")
    groups = met.where("kind = 1").select(F.col("x").alias("g1"), F.col("y").alias("g2"))
    wide = met.where("kind = 2")
    if not wide.isEmpty():
        groups = groups.unionByName(_split_hot(wide, allowed))
    groups = groups.distinct()

    # members of group pairs, and of one group: by size, then by the minimum hashes
    sets = signed.groupBy("s").agg(F.min(F.struct("id", "g", "n", "sig")).alias("m")).select("s", "m.*")
    one, two = (sets.select(F.col("s").alias(f"s{k}"), F.col("g").alias(f"g{k}"), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"sig{k}"), F.col("id").alias(f"id{k}")) for k in (1, 2))
    crowded = sets.groupBy(F.col("g").alias("g1")).count().where("count > 1").select("g1")
    within = one.join(crowded, "g1", "left_semi")
    among = within.join(two.withColumnRenamed("g2", "g1"), "g1").where("s1 < s2")
    across = groups.join(one, "g1").join(two, "g2")
    cols = ["s1", "s2", "id1", "id2", "n1", "n2", "sig1", "sig2"]
    least_equal = 0 if exact else math.floor(BITS * sim - 5 * math.sqrt(BITS * sim * (1 - sim)))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BITS) for c in ("sig1", "sig2"))
            ok = pa.array((u == v).sum(axis=1) >= least_equal)
            yield pa.RecordBatch.from_arrays([b.column(c).filter(ok) for c in cols[:4]], names=cols[:4])

    sized = among.select(*cols).unionByName(across.select(*cols)).where(F.least("n1", "n2") >= F.greatest("n1", "n2") * sim - 1e-9)
    pairs = sized.mapInArrow(alike, "s1 long, s2 long, id1 long, id2 long")
    turn = F.col("s1") > F.col("s2")
    pairs = pairs.select(*[F.when(turn, b).otherwise(a).alias(n) for n, a, b in (("s1", F.col("s1"), F.col("s2")), ("s2", F.col("s2"), F.col("s1")), ("id1", F.col("id1"), F.col("id2")), ("id2", F.col("id2"), F.col("id1")))])
    pairs = scratch.put(pairs.distinct(), "pairs")
    needed = checked(pairs.select(F.explode(F.array("id1", "id2")).alias("id")).distinct())

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                x = sets_of(b.column("body").slice(lo, 500).to_pylist(), width, words)
                s = np.array([xxhash.xxh64_intdigest(v.tobytes()) for v in x], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_pydict({"s": pa.array(s), "tok": pa.array([v.tobytes() for v in x], pa.binary())})

    tok = docs.join(needed, "id", "left_semi").select("body").mapInArrow(tokens, "s long, tok binary")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared, combined = [], []
            for u, v in zip(b.column("t1"), b.column("t2")):
                u, v = np.frombuffer(u.as_buffer(), np.uint64), np.frombuffer(v.as_buffer(), np.uint64)
                k = len(np.intersect1d(u, v, assume_unique=True))
                shared.append(k)
                combined.append(len(u) + len(v) - k)
            yield pa.RecordBatch.from_pydict({"s1": b.column("s1"), "s2": b.column("s2"), "shared": pa.array(shared, pa.int32()), "combined": pa.array(combined, pa.int32())})

    both = pairs.select("s1", "s2").join(tok.select(F.col("s").alias("s2"), F.col("tok").alias("t2")), "s2").join(tok.select(F.col("s").alias("s1"), F.col("tok").alias("t1")), "s1")
    links = both.select("s1", "s2", "t1", "t2").mapInArrow(compare, "s1 long, s2 long, shared int, combined int")
    return Near(signed.select("id", "s", "g", "n"), links.where(F.col("shared") >= F.col("combined") * sim - 1e-9))


def _split_hot(wide: DataFrame, allowed) -> DataFrame:
    """(g1, g2) of segments that very many groups share: hashed into blocks, every pair of blocks a task of its own."""
    blocks = wide.groupBy("x").agg(F.ceil(F.count("*") / HOT).cast("long").alias("k"))
    mine = F.pmod(F.xxhash64("y"), F.col("k"))
    rows = (
        wide.join(blocks, "x")
        .withColumn("mine", mine)
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        .select("x", F.least("mine", "j").alias("i"), F.greatest("mine", "j").alias("j"), "mine", "y", "c", "u", "v")
    )

    def pairs(t: pa.Table) -> pa.Table:
        e = {name: np.asarray(t.column(col).combine_chunks()).view(np.uint64) for name, col in (("g", "y"), ("u", "u"), ("v", "v"))}
        e["c"], mine = (np.asarray(t.column(n).combine_chunks()) for n in ("c", "mine"))
        first, second = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        a, b = np.flatnonzero(mine == first), np.flatnonzero(mine == second)
        found, out = _Distinct(), []
        for lo in range(0, len(a), 100):
            i, j = (x.ravel() for x in np.meshgrid(a[lo : lo + 100], b, indexing="ij"))
            keep = i < j if first == second else slice(None)
            out += found.add(e["g"], *allowed(e, i[keep], j[keep]))
        out += found.rest()
        p = np.concatenate(out) if out else np.zeros((0, 2), np.uint64)
        return pa.table({"g1": np.ascontiguousarray(p[:, 0]).view(np.int64), "g2": np.ascontiguousarray(p[:, 1]).view(np.int64)})

    return rows.groupBy("x", "i", "j").applyInArrow(pairs, "g1 long, g2 long")


def document_pairs(near: Near) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of documents, copies included.

    The result itself grows with the square of a class of copies; ``classes`` does not.
    """
    m1, m2 = (near.members.select(F.col("s").alias(f"s{k}"), F.col("id").alias(f"id{k}")) for k in (1, 2))
    across = near.links.select("s1", "s2").join(m1, "s1").join(m2, "s2").select("id1", "id2")
    copies = m1.join(m2.withColumnRenamed("s2", "s1"), "s1").where("id1 < id2").select("id1", "id2")
    return across.unionByName(copies).select(F.least("id1", "id2").alias("id_a"), F.greatest("id1", "id2").alias("id_b"))


def classes(near: Near) -> DataFrame:
    """(id, class_id, n_links): one row per document with sequences; linked sets and copies share a class.

    class_id is the smallest document id of the class; n_links counts the different sets linked
    to the document's own.
    """
    links = near.links.select("s1", "s2")
    roots = components(links, "s1", "s2")
    n = links.select(F.explode(F.array("s1", "s2")).alias("s")).groupBy("s").count()
    m = near.members.join(roots.withColumnRenamed("node", "s"), "s", "left").join(n, "s", "left").select("id", F.coalesce("root", "s").alias("root"), F.coalesce("count", F.lit(0)).cast("long").alias("n_links"))
    return m.join(m.groupBy("root").agg(F.min("id").alias("class_id")), "root").select("id", "class_id", "n_links")
