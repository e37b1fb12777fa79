"""Problem 3: page furniture mixed with the main text.

Minimum-cut labelling. A linear classifier gives every line a cost of being furniture or
story; these are the terminal capacities of the page's graph. Neighbouring lines and lines of
one block and kind are joined by smoothness edges, and the minimum cut separates furniture
from story. Nothing but the corpus labels the classifier's sample: lines that stand on many
different pages are furniture, titles are what links to other stories look like, and lines
that stand on hardly any other page and don't end like a title are story.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import one_row_per_id
from tidemark.session import spread

#: Pages that the classifier's sample may have at most (about), chosen by a hash of their id, and
#: lines of one page in it (about), chosen by a hash of the line.
FIT_PAGES = 2_000
PAGE_LINES = 200
#: A line repeats if it stands on this share of all pages, and on so many at least.
SHARE, LEAST_PAGES = 1 / 2_000, 5
SLOTS = 1 << 17
#: Smoothness: next line without and with a blank between; a line of like kind two further on.
NEXT, APART, LIKE = 0.9, 0.6, 0.3

_BAR = re.compile(r"\s(?:[|·»›/–-])\s| {2,}")
_OPENING = re.compile(r"[:|·•>»›/–—-]\s+")
_END = re.compile(r"[.!?…][\"”’»)]*$")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_NUMBER = re.compile(r"\d+")


def form(line: str) -> str:
    """What lines are compared by: lower case, single blanks, and no figures if a third of the line is figures, as in dates and counters."""
    t = " ".join(line.lower().split())
    masked = _NUMBER.sub("", t)
    return masked if 3 * (len(t) - len(masked)) >= len(t) - t.count(" ") else t


def form_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(form(line).encode("utf-8", "surrogatepass"))


class _Ids(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def features(lines: list[str], ids: _Ids) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of lines: (slots, row of each): words, word pairs and triples, first and last words, and shape."""
    toks, shape = [], []
    for line in lines:
        t = line.strip()
        low = _TOKEN.findall(_NUMBER.sub("0", t.lower()))
        toks.append(["^", *low, "$"])
        words = t.split()
        starts = int(5 * sum(w[0].isupper() for w in words) / max(1, len(words)))
        end, size = bool(_END.search(t)), min(12, int(2 * math.log2(len(low) + 1)))
        shape.append([
            f"#n{size}", f"#end{end}", f"#bars{min(4, len(_BAR.split(t)))}", f"#case{t.isupper()}{t.islower()}", f"#starts{starts}",
            f"#n{size}end{end}", f"#starts{starts}end{end}", f"#open{t[:1].isalnum()}{t[:1].islower()}",
        ])
    n = np.array([len(x) for x in toks], int)
    flat = np.fromiter(map(ids.__getitem__, chain.from_iterable(toks)), np.uint64, n.sum())
    row = np.repeat(np.arange(len(lines)), n)
    pair = _mix(flat[:-1] * np.uint64(3) + flat[1:])
    same = row[:-1] == row[1:]
    triple = _mix(pair[:-1] * np.uint64(5) + flat[2:])
    same3 = row[:-2] == row[2:]
    ns = np.array([len(x) for x in shape], int)
    sh = np.fromiter(map(ids.__getitem__, chain.from_iterable(shape)), np.uint64, ns.sum())
    slots = np.concatenate([flat, pair[same], triple[same3], sh]) % np.uint64(SLOTS)
    rows = np.concatenate([row, row[:-1][same], row[:-2][same3], np.repeat(np.arange(len(lines)), ns)])
    return slots.astype(np.int64), rows


def fit(slots: np.ndarray, rows: np.ndarray, labels: np.ndarray, rounds: int = 15, least: int = 20) -> np.ndarray:
    """Weights of a logistic regression on hashed features (Adagrad, both classes weighted alike).

    Labels are 1, 0, or negative for rows to be left out. Features of fewer than ``least`` rows,
    such as rare names, have no weight, so that lines aren't learnt by heart.
    """
    n = len(labels)
    w = np.zeros(SLOTS)
    norm = 1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=n)))
    use = labels[rows] >= 0
    slots, rows = slots[use], rows[use]
    use = np.bincount(slots, minlength=SLOTS)[slots] >= least
    slots, rows = slots[use], rows[use]
    past = np.full(SLOTS, 1e-6)
    y = (labels == 1).astype(float)
    ones, zeros = (labels == 1).sum(), (labels == 0).sum()
    weight = np.where(labels == 1, 0.5 / max(1, ones), 0.5 / max(1, zeros)) * (ones + zeros)
    for _ in range(rounds):
        z = np.bincount(rows, w[slots], n) * norm
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight * norm
        grad = np.bincount(slots, g[rows], SLOTS) + 1e-3 * w
        past += grad * grad
        w -= 0.7 * grad / np.sqrt(past)
    return w.astype(np.float32)


def learn(lines: list[str], repeats: np.ndarray, titles: list[str], rounds: int = 15) -> np.ndarray:
    """The classifier's weights, from a sample of lines and titles.

    ``repeats`` is 1 for lines that stand on many pages, 0 for those on hardly any other, and
    negative for the rest. Among the second are links to other stories, which have a title in
    them, often behind an opening: a first classifier, of titles against these lines, finds
    those that end like a title, in two turns, and they count as furniture for the second one.
    """
    alone = np.flatnonzero(repeats == 0)
    ends = [[t[m.end() :] for m in _OPENING.finditer(t) if t[m.end() :]] for t in (lines[i].strip() for i in alone)]
    heads = [v for t in titles for v in (t, t.upper(), t.lower())]
    texts = [*lines, *heads, *chain.from_iterable(ends)]
    if not texts:
        return np.zeros(SLOTS, np.float32)
    slots, rows = features(texts, _Ids())
    least = max(2, min(20, len(texts) // 1_000))
    norm = np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(texts))))
    at, label = len(lines), np.full(len(texts), -1)
    label[at : at + len(heads)] = 1
    label[alone] = 0
    whole = np.r_[alone, np.repeat(alone, [len(e) for e in ends])].astype(int)
    piece = np.r_[alone, np.arange(at + len(heads), len(texts))].astype(int)
    if heads and len(alone):
        for _ in range(2):
            z = np.bincount(rows, fit(slots, rows, label, rounds, least)[slots], len(texts)) / norm
            best = np.full(len(lines), -np.inf)
            np.maximum.at(best, whole, z[piece])
            label[alone] = best[alone] > 0
    label[:at] = np.where(repeats == 0, label[:at], repeats)
    return fit(slots, rows, label, rounds, least)


def odds(lines: list[str], w: np.ndarray, ids: _Ids) -> np.ndarray:
    """Log-odds of each line being furniture."""
    if not lines:
        return np.zeros(0)
    slots, rows = features(lines, ids)
    n = np.bincount(rows, minlength=len(lines))
    return np.bincount(rows, w[slots], len(lines)) / np.sqrt(n)


class _Odds:
    """Log-odds of lines; those of short lines, which come again and again, are kept for a while."""

    def __init__(self, w: np.ndarray):
        self.w, self.ids, self.known = w, _Ids(), {}

    def __call__(self, lines: list[str]) -> np.ndarray:
        if len(self.known) > 50_000:
            self.known.clear()
        known = self.known
        new = [t for t in dict.fromkeys(lines) if t not in known]
        now = dict(zip(new, odds(new, self.w, self.ids).tolist()))
        out = np.fromiter((now[t] if t in now else known[t] for t in lines), float, len(lines))
        known.update((t, z) for t, z in now.items() if len(t) < 160)
        return out


def min_cut(u: np.ndarray, a: np.ndarray, b: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Labels (True furniture) of least cost: a node differs from the sign of u at cost |u|, ends of an edge differ at cap.

    Nodes whose own cost exceeds all their open edges are settled at once, over all pages
    together; what is left is cut by augmenting paths, page by page.
    """
    u, n = u.copy(), len(u)
    label = np.full(n, -1, np.int8)
    live = np.ones(len(a), bool)
    while True:
        open_cap = np.bincount(a[live], cap[live], n) + np.bincount(b[live], cap[live], n)
        now = np.flatnonzero((label < 0) & (np.abs(u) >= open_cap))
        if not len(now):
            break
        label[now] = u[now] > 0
        for x, y in ((a, b), (b, a)):
            e = live & (label[x] >= 0) & (label[y] < 0)
            u += np.bincount(y[e], np.where(label[x[e]] == 1, cap[e], -cap[e]), n)
        live &= (label[a] < 0) & (label[b] < 0)
    rest = np.flatnonzero(label < 0)
    if len(rest):
        edges: dict[int, dict[int, float]] = {int(i): {} for i in rest}
        for i, j, c in zip(a[live].tolist(), b[live].tolist(), cap[live].tolist()):
            edges[i][j] = edges[i].get(j, 0) + c
            edges[j][i] = edges[j].get(i, 0) + c
        done: set[int] = set()
        for i in edges:
            if i in done:
                continue
            part, todo = [], [i]
            done.add(i)
            while todo:
                p = todo.pop()
                part.append(p)
                for q in edges[p]:
                    if q not in done:
                        done.add(q)
                        todo.append(q)
            on = _max_flow(part, edges, u)
            for p in part:
                label[p] = p in on
    return label == 1


def _max_flow(nodes: list[int], edges: dict[int, dict[int, float]], u: np.ndarray) -> set[int]:
    """Nodes on the source side of a minimum cut; source arcs for u > 0, sink arcs for u < 0."""
    s, t = -1, -2
    r: dict[int, dict[int, float]] = {p: dict(edges[p]) for p in nodes}
    r[s], r[t] = {}, {}
    for p in nodes:
        x = float(u[p])
        r[s][p], r[p][s] = max(x, 0.0), 0.0
        r[p][t], r[t][p] = max(-x, 0.0), 0.0
    while True:
        via = {s: s}
        todo = deque([s])
        while todo and t not in via:
            p = todo.popleft()
            for q, c in r[p].items():
                if c > 1e-9 and q not in via:
                    via[q] = p
                    todo.append(q)
        if t not in via:
            return set(via) - {s}
        path, q = [], t
        while q != s:
            path.append((via[q], q))
            q = via[q]
        flow = min(r[p][q] for p, q in path)
        for p, q in path:
            r[p][q] -= flow
            r[q][p] = r[q].get(p, 0.0) + flow


def _kind(line: str) -> int:
    return 0 if len(line) < 45 else 1 if len(line) < 110 else 2


def page_labels(bodies: list, odds_of: _Odds) -> tuple[list[list[str]], list[np.ndarray], list[np.ndarray]]:
    """For each page its pieces, the numbers (from 0) of its non-blank ones, and which of these are furniture."""
    pages, at, lines, a, b, cap = [], [], [], [], [], []
    for body in bodies:
        pieces = body.split("\n") if body else []
        keep = [i for i, p in enumerate(pieces) if p.strip()]
        first = len(lines)
        for k, i in enumerate(keep):
            lines.append(pieces[i])
            if k:
                a.append(first + k - 1)
                b.append(first + k)
                cap.append(NEXT if keep[k - 1] == i - 1 else APART)
            if k > 1 and _kind(pieces[i]) == _kind(pieces[keep[k - 2]]):
                a.append(first + k - 2)
                b.append(first + k)
                cap.append(LIKE)
        pages.append(pieces)
        at.append(np.array(keep, int))
    label = min_cut(odds_of(lines), np.array(a, int), np.array(b, int), np.array(cap, float)) if lines else np.zeros(0, bool)
    ends = np.cumsum([0, *map(len, at)])
    return pages, at, [label[ends[k] : ends[k + 1]] for k in range(len(at))]


def train(docs: DataFrame, fit_pages: int = FIT_PAGES) -> np.ndarray:
    """The classifier's weights, from lines and titles of about ``fit_pages`` pages at most.

    On how many pages these lines stand is counted over all pages. Pages with the same longest
    line are copies of one story and count once.
    """
    n = docs.count()
    grain = 1_000_000
    share = grain if n <= fit_pages else max(1, grain * fit_pages // n)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind, text = [], []
            for title, body in zip(b.column("title").to_pylist(), b.column("body").to_pylist()):
                lines = [p for p in (body or "").split("\n") if p.strip()]
                step = -(-len(lines) // PAGE_LINES)
                lines = [p for p in lines if step < 2 or form_hash(p) % step == 0]
                title = [title] if title and title.strip() else []
                kind += [0] * len(lines) + [1] * len(title)
                text += lines + title
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "text": pa.array(text, pa.string())})

    chosen = docs.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(grain)) < share)
    rows = chosen.select("title", "body").mapInArrow(sample, "kind int, text string").toArrow()
    kind, text = rows.column("kind").to_pylist(), rows.column("text").to_pylist()
    lines, titles = ([t for k, t in zip(kind, text) if k == x] for x in (0, 1))
    hashes = np.array([form_hash(t) for t in lines], np.uint64).view(np.int64)
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(hashes.tolist()))

    def stands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(line, page) of the sample's lines, once for each."""
        for b in batches:
            line, page = [], []
            for body in b.column("body").to_pylist():
                if body:
                    pieces = body.split("\n")
                    there = np.fromiter(map(form_hash, set(pieces)), np.uint64).view(np.int64).tolist()
                    there = wanted.value.intersection(there)
                    line += there
                    page += [xxhash.xxh64_intdigest(max(pieces, key=len).encode("utf-8", "surrogatepass")) >> 1] * len(there)
            yield pa.RecordBatch.from_pydict({"line": pa.array(line, pa.int64()), "page": pa.array(page, pa.int64())})

    counts = docs.select("body").mapInArrow(stands, "line long, page long").distinct().groupBy("line").agg(F.count("*").alias("n")).toArrow()
    pages = dict(zip(counts.column("line").to_pylist(), counts.column("n").to_pylist()))
    many = max(LEAST_PAGES, math.ceil(n * SHARE))
    on = np.array([pages.get(h, 1) for h in hashes.tolist()], int)
    return learn(lines, np.where(on >= many, 1, np.where(4 * on <= many, 0, -1)), titles)


def _prepared(df: DataFrame, key: str, title: str, body: str) -> DataFrame:
    return spread(one_row_per_id(df.select(F.col(key).cast("long").alias("id"), F.col(title).alias("title"), F.col(body).alias("body")), "id"), "id")


def furniture_lines(df: DataFrame, key: str, title: str, body: str, fit_pages: int = FIT_PAGES) -> DataFrame:
    """(id, line_no): non-blank lines that are page furniture; numbers count from 1 between line feeds.

    Null and empty bodies have none; repeated rows of an id count once; an empty table gives
    no rows. Pages are labelled one by one, whole, without a shuffle.
    """
    docs = _prepared(df, key, title, body)
    weights = df.sparkSession.sparkContext.broadcast(train(docs, fit_pages))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds_of = _Odds(weights.value)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                key_of = part.column("id").to_pylist()
                _, at, on = page_labels(part.column("body").to_pylist(), odds_of)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array(np.repeat(np.array(key_of, np.int64), [int(o.sum()) for o in on])),
                        "line_no": pa.array(np.concatenate([k[o] for k, o in zip(at, on)]).astype(np.int64) + 1),
                    }
                )

    return docs.select("id", "body").mapInArrow(label, "id long, line_no long")


def main_text(df: DataFrame, key: str, title: str, body: str, fit_pages: int = FIT_PAGES) -> DataFrame:
    """(id, body): pages without their furniture lines; a page of furniture only becomes empty, a null body stays null."""
    docs = _prepared(df, key, title, body)
    weights = df.sparkSession.sparkContext.broadcast(train(docs, fit_pages))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds_of = _Odds(weights.value)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                bodies = part.column("body").to_pylist()
                pages, at, on = page_labels(bodies, odds_of)
                out = []
                for raw, pieces, k, o in zip(bodies, pages, at, on):
                    gone = set(k[o].tolist())
                    out.append(None if raw is None else "\n".join(p for i, p in enumerate(pieces) if i not in gone))
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "body": pa.array(out, pa.string())})

    return docs.select("id", "body").mapInArrow(keep, "id long, body string")
