"""Problems 1, 2, 6, 7 against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.simhash import plain_words, simhash_of
from tidemark.functions.urls import canonical
from tidemark.llm import common, p1_linkage, p2_topn, p6_neardup, p7_lines
from tidemark.session import Scratch


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ------------------------------------------------------------------ common


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300), (7, 3)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[202] == 200 and 300 not in got
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_per_id(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (None, "x"), (3, "c"), (3, "c")], "id long, v string")
    assert {(r.id, r.v) for r in common.one_row_per_id(df, "id").collect()} == {(1, "a"), (2, None), (3, "c")}


# ------------------------------------------------------------------ problem 2


def top_brute(rows, n):
    best = defaultdict(dict)
    for g, i, s, *_ in rows:
        if g is not None and i is not None and s is not None and s == s:
            best[g][i] = max(best[g].get(i, -9e9), s)
    return {(g, i, r) for g, m in best.items() for r, (i, _) in enumerate(sorted(m.items(), key=lambda x: (-x[1], x[0]))[:n], 1)}


@pytest.mark.parametrize("n", [1, 5, 40])
def test_top_n(spark, n):
    rng = random.Random(n)
    rows = [(1, rng.randrange(3000), rng.choice([0.1, 0.5, 0.5, rng.random()]), "x", 0) for _ in range(9000)]
    rows += [(rng.randrange(2, 60), rng.randrange(50), rng.choice([None, float("nan"), rng.random(), 0.7]), None, 1) for _ in range(1500)]
    rows += [(None, 1, 0.5, None, 0), (99, None, 0.5, None, 0), (98, 1, None, None, 0), (97, 3, float("-inf"), None, 0), (97, 4, float("inf"), None, 0)] + rows[:50]
    df = spark.createDataFrame(rows, "grp long, art long, score double, low string, rank int")
    assert {(r.grp, r.art, r.rank) for r in p2_topn.top_n(df, "grp", "art", "score", n).collect()} == top_brute(rows, n)


def test_thresholds_drop_rows_of_large_groups_only(spark):
    rows = [(1, i % 5000, i / 20000) for i in range(20000)] + [(2, i, 0.1) for i in range(10)]
    low = p2_topn.thresholds(spark.createDataFrame(rows, "g long, item long, score double"), 5)
    got = {r.g: r.low for r in low.collect()}
    assert set(got) == {1} and 0.9 < got[1] < 1


def test_top_n_of_nothing(spark):
    assert p2_topn.top_n(spark.createDataFrame([], "g long, i long, s double"), "g", "i", "s").count() == 0
    assert p2_topn.top_n(spark.createDataFrame([(1, 1, None)], "g long, i long, s double"), "g", "i", "s").count() == 0
    with pytest.raises(ValueError):
        p2_topn.top_n(spark.createDataFrame([], "g long, i long, s double"), "g", "i", "s", 0)


# ------------------------------------------------------------------ problem 7


def test_repeated_lines(spark):
    rng = random.Random(7)
    legal = ["  ALL  rights reserved ", "Share\tthis", "É fim"]
    rows = []
    for i in range(60):
        lines = [words(rng, 6, 5000) for _ in range(4)]
        for k, l in enumerate(legal):
            if i % (k + 2) == 0:
                lines.insert(rng.randrange(len(lines)), l if i % 4 else l.lower())
        if i == 3:
            lines += ["only here"] * 9
        rows.append((i, [1, 1, 1, 2, None][i % 5], ("\r\n" if i % 7 == 0 else "\n").join([*lines, "", "  "]), "x"))
    rows += [(100, 1, None, None), (101, 1, "", None), (None, 1, "share this", None), rows[0], (102, 3, "\n".join(["same"] * 20), None)]
    df = spark.createDataFrame(rows, "id long, source long, body string, line string")
    counts = defaultdict(set)
    pieces = {(i, s, n, " ".join(p.lower().split())) for i, s, b, _ in rows if i is not None and s is not None and b for n, p in enumerate(b.split("\n"), 1) if p.split()}
    for i, s, _, p in pieces:
        counts[s, p].add(i)
    want = {(i, n) for i, s, n, p in pieces if len(counts[s, p]) >= 5}
    r = p7_lines.repeated_lines(df, "id", "source", "body")
    found = p7_lines.found_lines(r)
    assert {(x.id, x.line_no) for x in found.collect()} == want and want
    clean = {x.id: x.body for x in p7_lines.without_lines(df, "id", "body", found).collect()}
    for i, _, b, _ in rows[:-2]:
        if i is not None:
            gone = {n for k, n in want if k == i}
            assert clean[i] == (None if b is None else "\n".join(p for n, p in enumerate(b.split("\n"), 1) if n not in gone))


def test_excess_needs_a_higher_rate_inside(spark):
    rows = [(i, 1 + i % 2, "everywhere" + ("\nhouse rule" if i % 2 == 0 else "")) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, source long, body string")
    r = p7_lines.repeated_lines(df, "id", "source", "body")
    lines = {(x.source, x.n_in): x for x in r.lines.collect()}
    assert any(x.llr > 30 and x.n_out == 0 for x in lines.values()) and any(abs(x.llr) < 1e-9 for x in lines.values())
    bound = p7_lines.excess_bound(p7_lines.tests(df, "source", "body"), r.lines)
    assert r.lines.where(F.col("log10_p") <= bound).count() == 1
    assert p7_lines.repeated_lines(df.limit(0), "id", "source", "body").lines.count() == 0


def test_lines_are_found_and_removed_by_the_test(spark):
    """With the bound of the test, a line that all sources share stays and one source's own goes; without it both are found."""
    rows = [(s * 10 + i, s, f"shared\nstory {s} {i}" + ("\nown" if s == 0 else "")) for s in range(3) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, source int, body string")
    r = p7_lines.repeated_lines(df, "id", "source", "body")
    bound = p7_lines.excess_bound(p7_lines.tests(df, "source", "body"), r.lines)
    found = p7_lines.found_lines(r, bound)
    assert {tuple(x) for x in found.collect()} == {(i, 3) for i in range(10)}
    assert p7_lines.found_lines(r).count() == 40 and p7_lines.found_lines(r, -float("inf")).count() == 0
    assert {x.id: x.body for x in p7_lines.without_lines(df, "id", "body", found).collect()} == {i: b.removesuffix("\nown") for i, _, b in rows}


# ------------------------------------------------------------------ problem 6


def family(rng, n, edits):
    base = words(rng, n).split()
    out = []
    for e in edits:
        w = base.copy()
        for _ in range(e):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def near_brute(docs, width, sim):
    sets = {}
    for i, b in docs:
        w = plain_words(b) if b else []
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
        if i is not None and s:
            sets[i] = s
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= sim * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("width,sim", [(3, 0.6), (5, 0.8)])
def test_near_duplicates(spark, width, sim):
    rng = random.Random(width)
    texts = []
    for n in (4, 6, 9, 14, 22, 30, 45, 80, 200, 400):
        texts += family(rng, n, [0, 0, 1, 1, 2, 3, n // 20, n // 10, n // 8])
    texts += ["", None, "one two", "one two three", "One, two three!", words(rng, 3000), "x " * 500]
    docs = list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])]
    df = spark.createDataFrame([(i, b, "t") for i, b in docs], "key long, text string, s string")
    near = p6_neardup.near_duplicates(df, "key", "text", width, sim)
    want = near_brute(list(enumerate(texts)), width, sim)
    assert {(r.id_a, r.id_b) for r in p6_neardup.document_pairs(near).collect()} == want and len(want) > 50
    root = {i: i for i in range(len(texts))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.class_id for r in p6_neardup.classes(near).collect()}
    assert all(c == find(i) for i, c in got.items())


def test_near_duplicates_of_random_edits_at_the_bound(spark):
    rng = random.Random(12)
    docs = [(i, t) for i, t in enumerate(t for n in (30, 60, 120, 250, 350) for _ in range(12) for t in family(rng, n, [0, max(1, n // 15), max(1, n // 12)]))]
    near = p6_neardup.near_duplicates(spark.createDataFrame(docs, "id long, body string"), "id", "body", 3, 0.6)
    assert {(r.id_a, r.id_b) for r in p6_neardup.document_pairs(near).collect()} == near_brute(docs, 3, 0.6)


def test_hot_segments_are_split(spark, monkeypatch):
    monkeypatch.setattr(p6_neardup, "HOT", 10)
    rng = random.Random(3)
    docs = list(enumerate(family(rng, 120, [1 + i % 4 for i in range(60)])))
    near = p6_neardup.near_duplicates(spark.createDataFrame(docs, "id long, body string"), "id", "body", 3, 0.6)
    assert {(r.id_a, r.id_b) for r in p6_neardup.document_pairs(near).collect()} == near_brute(docs, 3, 0.6)


def test_hot_segments_leave_while_a_block_is_read(spark, monkeypatch):
    monkeypatch.setattr(p6_neardup, "HOT", 5)
    monkeypatch.setattr(p6_neardup, "BLOCK", 2)
    rng = random.Random(5)
    docs = list(enumerate(family(rng, 40, [i % 3 for i in range(40)]))) + [(100 + i, words(rng, 40)) for i in range(5)]
    df = spark.createDataFrame(docs, "id long, body string").repartition(4)
    near = p6_neardup.near_duplicates(df, "id", "body", 3, 0.6)
    assert {(r.id_a, r.id_b) for r in p6_neardup.document_pairs(near).collect()} == near_brute(docs, 3, 0.6)


@pytest.mark.parametrize("width,sim", [(3, 0.6), (3, 0.25), (5, 0.8)])
def test_near_duplicates_exact(spark, width, sim):
    rng = random.Random(31 + width)
    docs = [(i, t) for i, t in enumerate(t for n in (5, 12, 30, 120, 250) for _ in range(4) for t in family(rng, n, [0, 0, 1, max(1, n // 15), max(1, n // 9)]))]
    near = p6_neardup.near_duplicates(spark.createDataFrame(docs, "id long, body string"), "id", "body", width, sim, exact=True)
    assert {(r.id_a, r.id_b) for r in p6_neardup.document_pairs(near).collect()} == near_brute(docs, width, sim)


def test_groups_are_collapsed_before_the_join_and_keep_every_link(spark):
    rng = random.Random(77)
    base = family(rng, 200, [0, 10, 15])
    # copies, in other letters and with other signs, of texts that are near each other
    docs = [(k * 10 + c, f"{t.upper()}!" if c % 2 else t) for k, t in enumerate(base) for c in range(5)]
    near = p6_neardup.near_duplicates(spark.createDataFrame(docs, "id long, body string"), "id", "body", 3, 0.5)
    assert {(r.id_a, r.id_b) for r in p6_neardup.document_pairs(near).collect()} == near_brute(docs, 3, 0.5)
    assert near.members.select("g").distinct().count() == 3 and near.links.count() == 3


def test_pairs_of_runs():
    key = np.array([1] * 3 + [2] + [5] * 2 + [9] * 40)
    start, n = p6_neardup._starts(key)
    want = {(i, j) for i in range(len(key)) for j in range(i + 1, len(key)) if key[i] == key[j]}
    for most in (1, 7, 100, 10_000):
        got = [p for i, j in p6_neardup._meeting(start, n, most) for p in zip(i.tolist(), j.tolist())]
        assert set(got) == want and len(got) == len(want)


def test_near_duplicates_of_nothing(spark):
    for rows in ([], [(1, None), (2, "")]):
        near = p6_neardup.near_duplicates(spark.createDataFrame(rows, "id long, body string"), "id", "body")
        assert p6_neardup.document_pairs(near).count() == 0 and p6_neardup.classes(near).count() == 0


# ------------------------------------------------------------------ problem 1

ARTICLE = "id long, canonical_url string, content_hash string, simhash long, title string, body string, url string"
SEEN = "url string, outcome string, content_hash string, seen_at timestamp"
INCOMING = "incoming_id long, url string, canonical_url string, content_hash string, simhash long, title string, body string, node long"


def h(title, body):
    return hashlib.sha256(" ".join(plain_words((title or "") + " " + (body or ""))).encode()).hexdigest()


def linkage_brute(articles, seen, incoming):
    urls = {s[0] for s in seen}
    hashes = {s[2] for s in seen} | {a[2] or h(a[4], a[5]) for a in articles}
    sims = [a[3] if a[3] is not None else simhash_of(a[5]) for a in articles]
    sims = [s for s in sims if s is not None]
    out = set()
    for i, url, canon, ch, sh, t, b, _ in sorted({r[0]: r for r in reversed(incoming) if r[0] is not None}.values()):
        keys = {k for k in (canonical(url), canonical(canon)) if k}
        ch = ch or (h(t, b) if t is not None or b is not None else None)
        sh = sh if sh is not None else simhash_of(b)
        if keys & urls or (ch and ch in hashes) or (sh is not None and any(bin((sh ^ s) & (2**64 - 1)).count("1") <= 3 for s in sims)):
            out.add(i)
        else:
            urls |= keys
            hashes.add(ch)
            if sh is not None:
                sims.append(sh)
    return out


def test_linkage(spark):
    rng = random.Random(4)
    body = lambda: words(rng, 60, 5000)
    bodies = [body() for _ in range(30)]
    arts = [(i, f"https://a.example/{i}", None if i % 3 else h("t", b), None if i % 4 else simhash_of(b), "t", b, None) for i, b in enumerate(bodies)]
    seen = [("https://a.example/0", "stored", None, None), ("https://a.example/0", "stored", None, None), ("https://s.example/x", "too_short", h("q", "gone text"), None), (None, "x", None, None)]
    inc = [
        (1, "HTTPS://A.example/0/?utm_source=x", None, None, None, "new", body(), 7), (2, "https://n.example/2", "https://s.example/x", None, None, "new", body(), 7),
        (3, "https://n.example/3", None, None, None, "T!", bodies[5].upper(), 7), (4, "https://n.example/4", None, None, None, "q", "gone, text", 7),
        (5, "https://n.example/5", None, None, None, "first", body(), 7),
    ]
    b5 = inc[4][6]
    inc += [(6, "https://n.example/6", None, None, simhash_of(b5) ^ 1, "other", body(), 7), (7, "https://n.example/7", None, None, simhash_of(b5) ^ 0b11111, "chain", body(), 7), (8, "https://n.example/8", None, None, simhash_of(b5) ^ 0b11110, "chain", body(), 7)]
    inc += [(9, None, None, None, None, None, None, None), (10, None, None, None, None, None, None, None), (11, "https://n.example/5", "https://n.example/5", None, None, "z", "", None), (12, "https://n.example/12", "https://n.example/6", None, None, "z2", None, None)]
    inc += [(13, "https://n.example/13", "HTTPS://S.example/x/?gclid=1#a", None, None, "untidy", body(), 7), (14, "https://n.example/14", "https://N.example/2/?ref=a", None, None, "untidy", body(), 7)]
    inc += [(100 + k, "https://hot.example/", None, None, None, f"t{k}", body(), None) for k in range(40)]
    flip = lambda v: int(np.int64(np.uint64(v & (2**64 - 1)) ^ np.uint64(sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))))
    inc += [(200 + k, f"https://f.example/{k % 17}", None, None, flip(simhash_of(bodies[k % 30])) if k % 2 else None, "x", bodies[(k * 7) % 30] + f" {k}", None) for k in range(60)]
    inc += [inc[0], (None, "u", None, None, None, "t", "b", None)]
    scratch = Scratch(spark, "t1")
    history = p1_linkage.build_history(spark.createDataFrame(arts, ARTICLE), spark.createDataFrame(seen, SEEN), scratch)
    batch = scratch.put(p1_linkage.prepare(spark.createDataFrame(inc, INCOMING)), "batch")
    links = p1_linkage.link(batch, history)
    cases = links.cases
    want = linkage_brute(arts, seen, inc)
    got = {r.incoming_id for r in cases.collect()}
    assert got == want and {1, 2, 3, 4, 6, 13} <= got and 5 not in got and 100 not in got and set(range(101, 140)) <= got
    reps = {r.incoming_id: r for r in p1_linkage.representatives(batch, links).collect()}
    assert set(reps) == {r[0] for r in inc if r[0] is not None} and reps[1].n_clusters >= 1
    assert len({reps[100 + k].rep for k in range(40)}) == 1 and reps[6].rep == reps[5].rep != reps[9].rep
    # the accepted rows join history: sent again, everything is a case but rows that hold nothing
    later = p1_linkage.add_to_history(history, batch.join(cases, "incoming_id", "left_anti"), scratch)
    again = {r.incoming_id for r in p1_linkage.link(batch, later).cases.collect()}
    assert again == {i for i in {r[0] for r in inc} if i is not None} - {9, 10}


def test_linkage_of_nothing(spark):
    scratch = Scratch(spark, "t1")
    empty = p1_linkage.build_history(spark.createDataFrame([], ARTICLE), spark.createDataFrame([], SEEN), scratch)
    none = p1_linkage.prepare(spark.createDataFrame([], INCOMING))
    assert p1_linkage.link(none, empty).cases.count() == 0
    one = p1_linkage.prepare(spark.createDataFrame([(1, "https://x.example", None, None, None, "t", "b", None), (2, "https://x.example/", None, None, None, "u", "c", None)], INCOMING))
    links = p1_linkage.link(one, empty)
    assert [r.incoming_id for r in links.cases.collect()] == [2] and len({r.rep for r in p1_linkage.representatives(one, links).collect()}) == 1


def test_a_row_merges_all_clusters_within_three_bits_and_later_batches_know(spark):
    scratch = Scratch(spark, "t1")
    v = 0b1111 << 20
    # 1 and 2 are four bits apart, 3 has the value of 2, 4 the hash of 3's text under another address
    arts = [(1, "https://a.example/1", "h1", v ^ 0b1, "t", "x", None), (2, "https://a.example/2", "h2", v ^ 0b1110, "t", "x", None),
            (3, "https://a.example/3", "h3", v ^ 0b1110, "t", "x", None), (9, "https://a.example/9", "h9", 7 << 50, "t", "x", None)]
    seen = [("https://a.example/4", "stored", "h3", None)]
    row = lambda i, url, value, ch: (i, url, url, ch, value, "t", "x", None)
    history = p1_linkage.build_history(spark.createDataFrame(arts, ARTICLE), spark.createDataFrame(seen, SEEN), scratch)
    before = {r.node: r.rep for r in history.reps.collect()}
    node = {k: r.n for k in (1, 2, 3, 4, 9) for r in spark.range(1).select(p1_linkage.node_of(F.lit(f"https://a.example/{k}")).alias("n")).collect()}
    low = min(node[2], node[3], node[4])
    assert before == {node[k]: low for k in (2, 3, 4)}
    one = scratch.put(p1_linkage.prepare(spark.createDataFrame([row(1, "https://n.example/1", v, "n1"), row(2, "https://n.example/2", 1 << 62, "n2")], INCOMING)), "one")
    links = p1_linkage.link(one, history)
    got = {r.incoming_id: r for r in p1_linkage.representatives(one, links).collect()}
    low = min(low, node[1])
    assert got[1].n_clusters == 2 and got[1].rep == low and got[2].n_clusters == 0 and links.met.count() == 2
    # the next batch meets one merged cluster, by whichever of its records
    later = p1_linkage.add_to_history(history, one.join(links.cases, "incoming_id", "left_anti"), scratch, links)
    two = scratch.put(p1_linkage.prepare(spark.createDataFrame([row(5, "https://a.example/4", None, "n5"), row(6, "https://n.example/6", v ^ 0b1, "n6"), row(7, "https://n.example/7", v, "h9")], INCOMING)), "two")
    got = {r.incoming_id: r for r in p1_linkage.representatives(two, p1_linkage.link(two, later)).collect()}
    assert got[5].rep == got[6].rep == low and got[5].n_clusters == got[6].n_clusters == 1
    assert got[7].n_clusters == 2 and got[7].rep == min(low, node[9])


def test_a_later_batch_bridges_clusters_and_nothing_is_rewritten(spark):
    scratch = Scratch(spark, "t1")
    v = 0b111111 << 30
    row = lambda i, value, ch: (i, f"https://n.example/{i}", None, ch, value, "t", "x", None)
    history = p1_linkage.build_history(spark.createDataFrame([(1, "https://a.example/1", "h1", 9 << 50, "t", "x", None)], ARTICLE), spark.createDataFrame([], SEEN), scratch)

    def send(rows, name):
        nonlocal history
        batch = scratch.put(p1_linkage.prepare(spark.createDataFrame(rows, INCOMING)), name)
        links = p1_linkage.link(batch, history)
        out = {r.incoming_id: r for r in p1_linkage.representatives(batch, links).collect()}
        fresh = batch.join(links.cases, "incoming_id", "left_anti")
        before, history = history, p1_linkage.add_to_history(history, fresh, scratch, links)
        for name in ("urls", "hashes", "values", "blocks", "reps"):
            old, new = getattr(before, name), getattr(history, name)
            assert set(old.inputFiles()) <= set(new.inputFiles())
        assert history.values.count() - before.values.count() == fresh.count() and history.blocks.count() - before.blocks.count() == 10 * fresh.count()
        return out

    first, second = send([row(11, v ^ 0b11, "n11")], "b1")[11], send([row(12, v ^ 0b1100, "n12")], "b2")[12]
    assert first.n_clusters == second.n_clusters == 0 and first.rep != second.rep
    low = min(first.rep, second.rep)
    bridge = send([row(13, v, "n13"), row(14, 1 << 61, "n14")], "b3")
    assert bridge[13].n_clusters == 2 and bridge[13].rep == low and bridge[14].rep not in (first.rep, second.rep)
    later = send([row(15, v ^ 0b10, "n15"), row(16, v ^ 0b1000, "n16")], "b4")
    assert later[15].rep == later[16].rep == low and later[15].n_clusters == later[16].n_clusters == 1


def test_block_pairs_meet_within_three_bits(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(300):
        v = rng.getrandbits(64) - 2**63
        u = (v & (2**64 - 1)) ^ sum(1 << b for b in rng.sample(range(64), 3))
        rows.append((v, u - 2**64 if u >> 63 else u))
    df = spark.createDataFrame(rows, "a long, b long")
    both = F.arrays_overlap(p1_linkage.block_pairs(F.col("a")), p1_linkage.block_pairs(F.col("b")))
    assert df.where(~both).count() == 0
