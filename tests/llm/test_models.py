"""Problems 3, 4, 5, 8, 9, 10: brute force where there is one, else held-out accuracy and round trips."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import p3_boilerplate, p4_clusters, p5_neighbours, p8_packing, p9_mixing, p10_encoding, tokens, vector_index
from tidemark.llm.queries import RANKS
from tidemark.session import Scratch

# ------------------------------------------------------------------ problem 3


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        u = rng.normal(scale=1.0, size=n)
        pairs = [p for p in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        a, b = (np.array([p[k] for p in pairs], int) for k in (0, 1))
        cap = rng.random(len(pairs)) * 1.5

        def cost(label, u=u, a=a, b=b, cap=cap):
            label = np.asarray(label, bool)
            return np.maximum(u, 0)[~label].sum() + np.maximum(-u, 0)[label].sum() + cap[label[a] != label[b]].sum()

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert cost(p3_boilerplate.min_cut(u, a, b, cap)) == pytest.approx(best)


STORY = ["{2} of {3} said that the bowlers had done well enough on day {1} of the match.", "After lunch {3} made {1} runs before {2} came over the hills to the east.", "Q: What did you make of the pitch, {2} {3}?", "End of over {1}: {3} 40/2, {2} 12*"]
FURNITURE = ["Share this story", "By {4}", "Published 0{1} Jan 2026 10:0{1}", "Read more: why {3} {5} lost to {2}", "Home | Tables | Video | Shop", "We value your privacy. Accept all or manage settings.", "© 2026 Site {0}. All rights reserved."]
# another language and other words, in the same kinds of line
OTHER_STORY = ["{2} sagte nach dem Spiel, dass {3} am Tag {1} gut genug gewesen sei.", "Nach der Pause holte {3} noch {1} Punkte, bevor {2} den Ball verlor.", "F: Was dachten Sie, {2} {3}?", "Stand {1}: {3} 40/2, {2} 12*"]
OTHER_FURNITURE = ["Artikel teilen", "Von {4}", "Stand: 0{1}.01.2026 10:0{1}", "Mehr dazu: warum {3} {5} gegen {2} verlor", "Start | Tabellen | Filme | Laden", "Wir verwenden Cookies. Alle annehmen oder einstellen.", "© 2026 Haus {0}. Alle Rechte vorbehalten."]


def name(rng):
    return "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)).capitalize()


def page(rng, truth, i, story=STORY, furniture=FURNITURE):
    def line(kinds):
        return rng.choice(kinds).format(rng.randrange(9), rng.randrange(1, 9), name(rng), name(rng), rng.choice(["Ann Number", "Bo Figure", "Cy Digit"]), name(rng))

    lines = [(line(furniture), True) for _ in range(rng.randrange(2, 5))] + [(line(story), False) for _ in range(rng.randrange(3, 9))] + [(line(furniture), True) for _ in range(rng.randrange(2, 6))]
    out = []
    for text, bad in lines:
        out.append(text)
        if bad:
            truth.add((i, len(out)))
        if rng.random() < 0.3:
            out.append("")
    return "\n".join(out)


@pytest.mark.parametrize("story,furniture,title", [(STORY, FURNITURE, "Why {} {} lost to {}"), (OTHER_STORY, OTHER_FURNITURE, "Warum {} {} gegen {} verlor")])
def test_furniture_of_held_out_pages(spark, story, furniture, title):
    """The fit sees a third of the pages; no list of phrases is anywhere, so any language will do."""
    rng = random.Random(6)
    truth: set = set()
    rows = [(i, title.format(name(rng), name(rng), name(rng)), page(rng, truth, i, story, furniture), "x") for i in range(500)]
    rows += [(900, None, None, None), (901, "t", "", None), (902, "t", "\n \n", None), (None, "t", "Share this story", None), rows[0], (903, "long", "word " * 40_000, None)]
    df = spark.createDataFrame(rows, "id long, title string, body string, line_no string")
    found = p3_boilerplate.furniture_lines(df, "id", "title", "body", fit_pages=150)
    got = {(r.id, r.line_no) for r in found.collect()}
    assert len(got & truth) / len(truth) > 0.97 and len(got & truth) / len(got) > 0.97 and not any(i in (900, 901, 902, None) for i, _ in got)
    text = {r.id: r.body for r in p3_boilerplate.main_text(df, "id", "title", "body", fit_pages=150).collect()}
    assert text[900] is None and text[901] == "" and len(text) == 504
    for i in range(0, 500, 50):
        gone = {n for k, n in got if k == i}
        assert text[i] == "\n".join(p for n, p in enumerate(rows[i][2].split("\n"), 1) if n not in gone)


def test_a_fit_holds_for_pages_that_share_no_line_with_it(spark):
    rng = random.Random(8)
    w = p3_boilerplate.train(spark.createDataFrame([(i, f"Why {name(rng)} {name(rng)} lost to {name(rng)}", page(rng, set(), i)) for i in range(400)], "id long, title string, body string"))
    truth: set = set()
    # numbers, names and authors that the fit never saw, in lines of the same making
    bodies = [page(rng, truth, i, furniture=["Share this {3}", "By {2} {3}", "Published 1{1} Feb 2027 23:5{1}", "Read more: why {3} {5} lost to {2}", "Home | {3} | {2} | Shop", "© 2027 Site {2}. All rights reserved."]) for i in range(100)]
    pages, at, on = p3_boilerplate.page_labels(bodies, p3_boilerplate._Odds(w))
    got = {(i, k + 1) for i, (numbers, bad) in enumerate(zip(at, on)) for k in numbers[bad].tolist()}
    assert len(got & truth) / len(truth) > 0.9 and len(got & truth) / len(got) > 0.95


def test_forms_of_lines():
    assert p3_boilerplate.form("Published 03 Jan 2026  10:01") == p3_boilerplate.form("published 14 JAN 2027 23:59")
    assert p3_boilerplate.form("Anna made 40 runs before lunch") != p3_boilerplate.form("Anna made 41 runs before lunch")


def test_furniture_of_nothing(spark):
    assert p3_boilerplate.furniture_lines(spark.createDataFrame([], "id long, title string, body string"), "id", "title", "body").count() == 0


# ------------------------------------------------------------------ problems 4 and 5


def vectors(seed=1, dim=24, groups=12, noise=60):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for _ in range(groups):
        c = rng.normal(size=dim)
        for _ in range(int(rng.integers(2, 30))):
            v = c + rng.normal(scale=rng.choice([0.2, 0.5, 0.9]), size=dim)
            rows.append((i, v.astype(np.float32).tolist()))
            i += 1
    for _ in range(noise):
        rows.append((i, rng.normal(size=dim).astype(np.float32).tolist()))
        i += 1
    for k in (0, 5, 5, 5, 9, 9):
        rows.append((i, rows[k][1]))
        i += 1
    return rows


def table(spark, rows, dim=24):
    nan = [float("nan")] + [0.0] * (dim - 1)
    t = [(i, v, "2026-01-02 00:00:00", "x") for i, v in rows]
    t += [(rows[0][0], rows[30][1], "2026-01-01 00:00:00", "x"), (rows[1][0], rows[30][1], None, "x"), t[2], (5000, None, "2026-01-01 00:00:00", "x"), (5001, nan, None, None), (5002, [0.0] * dim, None, None), (5003, [1.0] * 3, None, None), (5004, rows[3][1], "2026-01-01 00:00:00", None), (5004, None, "2026-01-05 00:00:00", None), (None, rows[3][1], None, None)]
    return spark.createDataFrame([(i, v, ts, x) for i, v, ts, x in t], "art long, emb array<float>, ts string, id string").withColumn("ts", F.col("ts").cast("timestamp"))


def cosines(rows):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return ids, s


def pairs_brute(rows, k, least):
    ids, s = cosines(rows)
    out = set()
    for a in range(len(ids)):
        near = sorted((-s[a, b].round(12), ids[b]) for b in range(len(ids)) if s[a, b] >= least - 1e-12)[:k]
        out |= {(min(ids[a], j), max(ids[a], j)) for _, j in near}
    return out


def groups_brute(rows, least, smallest):
    ids, s = cosines(rows)
    label = np.arange(len(ids))
    i, j = np.nonzero(s >= least)
    while True:
        old = label.copy()
        np.minimum.at(label, i, old[j])
        label = label[label]
        if (label == old).all():
            break
    n = Counter(label.tolist())
    return {(int(ids[a]), int(ids[label[a]])) for a in range(len(ids)) if n[label[a]] >= smallest}


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbours_and_groups(spark, seed):
    rows = vectors(seed)
    df = table(spark, rows)
    got = {(r.id_a, r.id_b) for r in p5_neighbours.nearest_pairs(df, "art", "emb", "ts", dim=24).collect()}
    want = pairs_brute(rows, 5, 0.8)
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    c = p4_clusters.groups_of(df, "art", "emb", "ts", dim=24)
    members = {(r.id, r.group_id) for r in c.groups.collect()}
    truth = groups_brute(rows, 0.55, 4)
    assert len(members & truth) >= 0.98 * len(truth)
    size = Counter(g for _, g in members)
    for r in p4_clusters.described(c).collect():
        assert r.size == size[r.group_id] and r.medoid == r.typical[0] and {(t, r.group_id) for t in r.typical} <= members


def test_recall_with_many_lists(spark):
    rows = vectors(5, groups=60, noise=400)
    v = vector_index.latest(table(spark, rows), "art", "emb", "ts", 24, Scratch(spark, "t"))
    near = p5_neighbours.neighbours(v, 5, 0.8, list_size=60)
    got = {(min(r.id, r.other), max(r.id, r.other)) for r in near.collect()}
    want = pairs_brute(rows, 5, 0.8)
    assert len(got & want) >= 0.9 * len(want)


def test_large_lists_are_split_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "LIST_MOST", 25)
    rows = vectors(3, groups=6)
    got = {(r.id_a, r.id_b) for r in p5_neighbours.nearest_pairs(table(spark, rows), "art", "emb", "ts", dim=24).collect()}
    want = pairs_brute(rows, 5, 0.8)
    assert len(got & want) >= 0.98 * len(want)
    c = p4_clusters.groups_of(table(spark, rows), "art", "emb", "ts", dim=24)
    truth = groups_brute(rows, 0.55, 4)
    assert len({(r.id, r.group_id) for r in c.groups.collect()} & truth) >= 0.98 * len(truth)


def test_very_many_copies(spark):
    v = [float(x) for x in np.random.default_rng(0).normal(size=24)]
    rows = [(i, v) for i in range(300)]
    df = spark.createDataFrame([(i, x, None) for i, x in rows], "art long, emb array<float>, ts timestamp")
    got = {(r.id_a, r.id_b) for r in p5_neighbours.nearest_pairs(df, "art", "emb", "ts", dim=24).collect()}
    assert got == pairs_brute(rows, 5, 0.8)
    assert {r.group_id for r in p4_clusters.groups_of(df, "art", "emb", "ts", dim=24).groups.collect()} == {0}


def test_no_vectors(spark):
    for rows in ([], [(1, None, None)], [(1, [0.0] * 24, None)]):
        df = spark.createDataFrame(rows, "art long, emb array<float>, ts timestamp")
        assert p5_neighbours.nearest_pairs(df, "art", "emb", "ts", dim=24).count() == 0
        c = p4_clusters.groups_of(df, "art", "emb", "ts", dim=24)
        assert c.groups.count() == 0 and p4_clusters.described(c).count() == 0


def test_pivots_are_those_of_the_greedy_order():
    rng = np.random.default_rng(4)
    for n in (1, 7, 40, 700):
        a = rng.random((n, n)) < 3 / n
        a = (a | a.T) & ~np.eye(n, dtype=bool)
        rank = rng.permutation(n)
        want = np.full(n, -1)
        for i in np.argsort(rank):
            if want[i] < 0:
                want[a[i] & (want < 0)] = i
                want[i] = i
        got = p4_clusters.pivot_rounds(np.packbits(a, axis=1), rank)
        assert set(got) == set(want) and all(a[i, p] if p != i else True for i, p in enumerate(got))


def test_typical_members_count_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=24)
    far, near = base + rng.normal(scale=0.4, size=24), base + rng.normal(scale=0.1, size=(6, 24))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate([*near, *[far] * 9])]
    c = p4_clusters.groups_of(spark.createDataFrame([(i, v, None, None) for i, v in rows], "art long, emb array<float>, ts timestamp, id string"), "art", "emb", "ts", dim=24)
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    order = sorted(range(len(x)), key=lambda i: (-round(float((x @ x[i]).mean()), 9), i))
    got = p4_clusters.described(c).collect()
    assert len(got) == 1 and got[0].size == len(x) and got[0].typical == order[:3]


# ------------------------------------------------------------------ problems 8 and 9


def documents(spark, n=400, extra=()):
    rng = random.Random(9)
    rows = [(i, " ".join(f"word{rng.randrange(50)}" for _ in range(int(rng.choice([3, 30, 300]) * rng.uniform(0.5, 1.5)))), f"s{min(5, int(rng.expovariate(0.7)))}", 1) for i in range(n)]
    return spark.createDataFrame(rows + list(extra), "doc_id long, text string, source string, tokens long")


ODD = ((9000, None, "s0", 1), (9001, "", "s1", 1), (9002, "x y z", None, 1), (None, "x", "s0", 1), (9003, "far " * 9000, "s2", 1), (9003, "far " * 9000, "s2", 1))


def test_counts_are_the_tokenizer_s(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = ["Héllo wörld, 123!", "don't  stop\n\nnow", "<|endoftext|> is text", "नमस्ते दुनिया", " ", ""]
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    want = [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "i long, x string")
    got = {r.i: r.tokens for r in tokens.token_counts(df, "x", RANKS).collect()}
    assert [got[i] for i in range(len(texts))] == want and got[99] == 0


def test_very_long_runs_are_counted():
    of = tokens.counter(RANKS)
    import base64

    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("x", pat_str=tokens.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    for text in ("a" + " " * 6000 + "b", "\n" * 7000, "x" + "\t" * 5001 + "é" + " " * 5500, "ab " * 4000, "\u3000" * 5200 + "7"):
        assert of(text) == len(plain(text))
    for text in (" " * 2_000_000 + "end", "a" * 1_000_000, "." * 1_000_000, "7" * 1_000_000, "क" * 300_000):
        assert of(text) > 1000


@pytest.mark.parametrize("capacity", [64, 512])
def test_packing(spark, capacity):
    df = documents(spark, extra=ODD)
    size = {r.doc_id: r.tokens for r in tokens.token_counts(df.select("doc_id", "text").where("doc_id is not null").distinct(), "text", RANKS).collect()}
    rows = p8_packing.pack(df, "doc_id", "source", "text", RANKS, capacity).collect()
    fill, parts = Counter(), defaultdict(dict)
    for r in rows:
        fill[r.container] += r.tokens
        assert r.part_no not in parts[r.doc_id]
        parts[r.doc_id][r.part_no] = r.tokens
    assert max(fill.values()) <= capacity
    assert {d: sum(p.values()) for d, p in parts.items()} == size
    for d, p in parts.items():
        assert len(p) == max(1, -(-size[d] // capacity)) and sorted(p) == list(range(len(p)))
    assert sum(size.values()) / (len(fill) * capacity) > 0.97
    one = p8_packing.report(p8_packing.pack(df, "doc_id", "source", "text", RANKS, capacity), capacity).first()
    assert one.containers == len(fill) and one.documents == len(size)


def test_packing_follows_targets():
    rng = random.Random(1)
    items = [(i, rng.choice("ab"), rng.randrange(5, 40)) for i in range(2000)]
    rows = p8_packing.fill(items, {"a": 0.8, "b": 0.2}, {}, 200)
    source = {d: s for d, s, _ in items}
    early = Counter()
    for d, _, c, n in rows:
        if c < 50:
            early[source[d]] += n
    assert 0.75 < early["a"] / sum(early.values()) < 0.85


def test_packing_of_nothing(spark):
    assert p8_packing.pack(spark.createDataFrame([], "d long, s string, t string"), "d", "s", "t", RANKS).count() == 0


def test_schedule_keeps_every_window():
    for blocks in ({"a": 7, "b": 3, "c": 1}, {"a": 1}, {"a": 50, "b": 50, "c": 13}, {"a": 0, "b": 2}):
        n = sum(blocks.values())
        seen = Counter()
        order = p9_mixing.schedule(blocks)
        assert Counter(s for s, _ in order) == Counter({s: k for s, k in blocks.items() if k})
        for slot, (s, k) in enumerate(order, 1):
            assert k == seen[s]
            seen[s] += 1
            assert all(abs(seen[x] - slot * b / n) < 1 for x, b in blocks.items())
    assert p9_mixing.schedule({}) == []


def test_mixture(spark):
    df = documents(spark, 600, ODD)
    targets = spark.createDataFrame([("s0", 0.4, 1), ("s1", 0.3, 2), ("s2", 0.2, 2), ("s3", 0.1, 4), ("absent", 0.0, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    m = p9_mixing.mix(df, targets, "doc_id", "source", "text", RANKS)
    rows = m.rows.collect()
    used = Counter((r.source, r.doc_id) for r in rows)
    cap = {"s0": 1, "s1": 2, "s2": 2, "s3": 4}
    assert all(n <= cap[s] for (s, _), n in used.items()) and len({(r.doc_id, r.repeat_no) for r in rows}) == len(rows)
    got = {r.source: r for r in p9_mixing.shares(m).collect()}
    for s, w in (("s0", 0.4), ("s1", 0.3), ("s2", 0.2), ("s3", 0.1)):
        assert abs(got[s].actual_share - w) < 0.05 and got[s].most_repeats <= cap[s]
    assert any(got[s].most_repeats == cap[s] for s in cap)


@pytest.mark.parametrize("most", [1 << 17, 20])
def test_rows_of_a_mixture_keep_to_their_weights(spark, monkeypatch, most):
    monkeypatch.setattr(p9_mixing, "BLOCK", 300)
    monkeypatch.setattr(p9_mixing, "MOST_BLOCKS", most)
    targets = spark.createDataFrame([("s0", 0.5, 2), ("s1", 0.3, 3), ("s2", 0.2, 3)], "source string, target_share double, max_repeats int")
    rows = sorted(p9_mixing.mix(documents(spark, 900), targets, "doc_id", "source", "text", RANKS).rows.collect(), key=lambda r: (r.slot, r.place))
    assert len({(r.slot, r.place) for r in rows}) == len(rows)
    seen, total = Counter(), 0
    largest = max(r.tokens for r in rows)
    for r in rows:
        seen[r.source] += r.tokens
        total += r.tokens
        # a block, or two where the schedule is repeated; and what documents stick out of blocks
        assert all(abs(seen[x] - w * total) < (1 if most > 20 else 2) * 300 + 2.5 * largest for x, w in (("s0", 0.5), ("s1", 0.3), ("s2", 0.2)))


def test_sums_before_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(p8_packing, "RANGE", 4)
    rng = random.Random(5)
    rows = [(s, b, rng.randrange(100)) for s in "abc" for b in range(30) if rng.random() < 0.7]
    got = p8_packing.before(spark.createDataFrame(rows, "source string, bucket long, tokens long"), ["source"], "tokens", "past").collect()
    assert {(r.source, r.bucket): r.past for r in got} == {(s, b): sum(n for t, c, n in rows if t == s and c < b) for s, b, _ in rows}


def test_packing_to_given_targets(spark):
    df = documents(spark, 800).where("source in ('s0', 's1', 's2')")
    targets = {"s0": 0.2, "s1": 0.5, "s2": 0.3}
    source = {r.doc_id: r.source for r in df.collect()}
    rows = p8_packing.pack(df, "doc_id", "source", "text", RANKS, 2048, targets).collect()
    last = max(r.container for r in rows)
    early = Counter()
    for r in rows:
        if r.container < last // 6:
            early[source[r.doc_id]] += r.tokens
    assert all(abs(early[s] / sum(early.values()) - w) < 0.1 for s, w in targets.items()) and {r.doc_id for r in rows} == set(source)


def test_mixture_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    for t in (targets, targets.limit(0)):
        m = p9_mixing.mix(spark.createDataFrame([], "d long, s string, t string"), t, "d", "s", "t", RANKS)
        assert m.rows.count() == 0 and all(r.tokens == 0 for r in p9_mixing.shares(m).collect())


# ------------------------------------------------------------------ problem 10

CLEAN = ["Le café de Réné était très animé, naïve à souhait.", "Über die Straße ging Frau Müller – “schön”, sagte sie.", "Погода была хорошая и команда выиграла матч", "Crème brûlée costs €40 at the captain’s café.", "Mañana será otro día, dijo Núñez ¿verdad?", "हरित टीम ने मैच जीता", "35°C out there, ½ hour © notes", "plain ascii only", "NÃO HÁ DECISÃO: São Paulo"]


def test_garbled_text_is_found_and_put_back(spark):
    rows = [(i, CLEAN[i % len(CLEAN)], "x") for i in range(90)]
    bad = {}
    for k, (w, r) in enumerate([("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("utf-8", "cp1250")]):
        for j in (0, 3, 4):
            bad[1000 + 10 * k + j] = (p10_encoding._read(CLEAN[j].encode(w), r), CLEAN[j])
    bad[2000] = (CLEAN[2].encode("cp1251").decode("cp1252"), CLEAN[2])
    bad[2001] = (CLEAN[2].encode("utf-8").decode("cp1251", "replace").replace("�", ""), None)
    bad[2002] = ("It was na�ve of them", None)
    once = CLEAN[0].encode().decode("cp1252")
    bad[2003] = (once.encode().decode("cp1252"), CLEAN[0])
    bad[2004] = ("Only one word is wrong here: cafÃ©, said he", "Only one word is wrong here: café, said he")
    rows += [(i, t, "x") for i, (t, _) in bad.items()] + [(3000, None, None), (3001, "", None), (None, "cafÃ©", None), (rows[0][0], rows[0][1], "x"), (3002, "é" * 30_000, None)]
    d = p10_encoding.find_damage(spark.createDataFrame(rows, "doc text string".replace("doc text", "doc_id long, text") + ", piece string"), "doc_id", "text")
    found = {r.doc_id for r in p10_encoding.damaged_documents(d).collect()}
    assert found == set(bad)
    back = {r.doc_id: r for r in p10_encoding.restored(d).collect()}
    right = [i for i, (_, clean) in bad.items() if clean is not None and back[i].text == clean]
    assert len(right) >= 0.9 * sum(c is not None for _, c in bad.values())
    assert set(back) == set(bad) and back[2004].n_restored == 1


def test_words_with_one_garbled_letter(spark):
    clean = ["“We saw Rardrualeí für José Peña at the end,” said NÉO", "NÃO é bom, 1º lugar, custa 1¼ ou 5 m²"]
    rows = [(i, f"{clean[i % 2]} in part {i}") for i in range(40)]
    bad = {
        100: ("Then RardrualeÃ won", "Then Rardrualeí won"), 101: ("âWe won it", "“We won it"), 102: ("at the end,â said one", "at the end,” said one"),
        103: ("This is f³r all", "This is für all"), 104: ("So JosÚ won", "So José won"), 105: ("PeÒa won", "Peña won"),
    }
    # copies of one text make a garbled word no commoner
    rows += [(i, t) for i, (t, _) in bad.items()] + [(200 + k, bad[104][0]) for k in range(30)]
    d = p10_encoding.find_damage(spark.createDataFrame(rows, "i long, t string"), "i", "t")
    assert {r.doc_id for r in p10_encoding.damaged_documents(d).collect()} == set(bad) | {200 + k for k in range(30)}
    back = {r.doc_id: r.text for r in p10_encoding.restored(d).collect()}
    assert all(back[i] == t for i, (_, t) in bad.items())


def test_encoding_of_nothing(spark):
    for rows in ([], [(1, None), (2, "ascii")]):
        d = p10_encoding.find_damage(spark.createDataFrame(rows, "i long, t string"), "i", "t")
        assert p10_encoding.damaged_documents(d).count() == 0 and p10_encoding.restored(d).count() == 0


def test_chains_of_encodings_are_parameters():
    thrice = "é"
    for _ in range(3):
        thrice = thrice.encode().decode("cp1252", "replace")
    forms = {f: c for f, c, _ in p10_encoding.garbled_forms("café", steps=3)}
    assert any(f.endswith(thrice) for f in forms) and not any(f.endswith(thrice) for f, _, _ in p10_encoding.garbled_forms("café"))
    assert {c.split("-")[0] for c in (c for _, c, _ in p10_encoding.garbled_forms("café", ("cp1252",), ("mac_roman",)))} == {"cp1252>mac_roman"}
