"""Operators over pairs and the whole corpus, against brute force."""

import bisect
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietspan.llm import components, neardup, repeats, vectors


def partition(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# --- components


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_components(spark, few):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(200, 260)] + [(rnd.randint(300, 400), rnd.randint(300, 400)) for _ in range(70)] + [(7, 7)]
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    place = {x: i for i, x in enumerate(nodes)}
    want = partition(len(nodes), [(place[a], place[b]) for a, b in edges if a != b])
    df = spark.createDataFrame([*edges, (None, 100), (5, None)], "x long, y long").repartition(6)
    got = {r.node: r.component for r in components.components(df, "x", "y", few).collect()}
    assert got == {x: nodes[want[i]] for i, x in enumerate(nodes)}
    assert components.components(df.limit(0), "x", "y", few).isEmpty()


# --- repeats


def brute_repeats(docs, size, keep):
    seen = defaultdict(list)
    for i, (d, t) in enumerate(docs):
        raw = (t or "").encode()
        for s in range(len(raw) - size + 1):
            seen[raw[s : s + size]].append((d, i, s))
    out = []
    for i, (d, t) in enumerate(docs):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - size + 1):
            where = seen[raw[s : s + size]]
            if len(where) > 1 and (keep == "none" or where[0] != (d, i, s)):
                gone[s : s + size] = b"\1" * size
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        n = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((d, len(raw), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("hot", "keep"), [(64, "none"), (64, "first"), (2, "none"), (2, "first")])
def test_repeats(spark, hot, keep):
    rnd = random.Random(5)
    words = lambda n: " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5))) for _ in range(n))
    passage = words(60)
    docs = [(i, words(rnd.randint(0, 80)) + (passage if i % 3 == 0 else "") + words(rnd.randint(0, 40))) for i in range(50)]
    docs += [(100, "ab" * 400), (101, "a" * 300), (102, None), (103, ""), (104, docs[0][1]), (105, docs[1][1] + "x"), (106, docs[2][1][5:])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_bytes", F.lit("clash"))
    got = repeats.remove_repeats(df, length=60, hot=hot, chunk=7, keep=keep)
    assert sorted(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == brute_repeats(docs, 60, keep)


def test_repeats_awkward(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
    same = [(1, "z" * 500)] * 2 + [(None, "y" * 399), (None, "q" * 450)]
    got = sorted((r.n_bytes, r.n_removed) for r in repeats.remove_repeats(spark.createDataFrame(same, "doc_id long, text string")).collect())
    assert got == [(399, 0), (450, 450), (500, 500), (500, 500)]


def test_window_classes_are_longest_factors():
    rnd = random.Random(8)
    segments = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 60))) for _ in range(12)]
    at, earlier, later = repeats.window_classes(segments, 7)
    text = b"".join(segments)
    strings = [text[i : i + 7] for i in at]
    for i, s, e, x in zip(at, strings, earlier, later, strict=True):
        others = [j for j, t in zip(at, strings, strict=True) if t == s]
        assert e == any(j < i for j in others) and x == any(j > i for j in others)


# --- near-duplicates


def brute_links(docs):
    """Pairs of places whose longest common subsequence of labelled shingles is long enough, with nothing of the operator's own."""
    sequences, holders = [], defaultdict(list)
    for i, (_, t) in enumerate(docs):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        seen, own = defaultdict(int), {}
        for k in range(max(1, len(words) - 4) if words else 0):
            s = tuple(words[k : k + 5])
            seen[s] += 1
            own[s, seen[s]] = k
        for s in own:
            holders[s].append(i)
        sequences.append(own)
    common = Counter()
    for some in holders.values():
        common.update((a, b) for x, b in enumerate(some) for a in some[:x])
    links = []
    for (i, j), n in common.items():
        a, b = sequences[i], sequences[j]
        if n / (len(a) + len(b) - n) >= 0.8 - 1e-9:  # as sets; in order there can only be fewer
            tails = []
            for place in (b[s] for s in a if s in b):
                k = bisect.bisect_left(tails, place)
                tails[k : k + 1] = [place]
            if len(tails) / (len(a) + len(b) - len(tails)) >= 0.8 - 1e-9:
                links.append((i, j))
    return links


def brute_classes(docs):
    links = brute_links(docs)
    root = partition(len(docs), links)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, docs[i][0]), docs[i][0])
    return {docs[i][0]: least[r] for i, r in enumerate(root)}


def similarity(a, b):
    """Longest common subsequence of labelled shingles by the plain table."""

    def labelled(t):
        w, seen, out = t.lower().split(), defaultdict(int), []
        for i in range(max(1, len(w) - 4)):
            s = " ".join(w[i : i + 5])
            seen[s] += 1
            out.append((s, seen[s]))
        return out

    x, y = labelled(a), labelled(b)
    row = [0] * (len(y) + 1)
    for p in x:
        before, row = row, [0]
        for j, q in enumerate(y):
            row.append(before[j] + 1 if p == q else max(before[j + 1], row[j]))
    return row[-1] / (len(x) + len(y) - row[-1])


def near_corpus(rnd):
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 120))) for _ in range(30)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    texts = []
    for b in base:
        texts.append(b)
        for _ in range(rnd.randint(0, 6)):
            w = b.split()
            for _ in range(rnd.randint(0, 3)):
                p = rnd.randrange(len(w))
                w[p : p + rnd.randint(0, 1)] = [rnd.choice(words)]
            texts.append(" ".join(w))
    for _ in range(50):
        texts.append(" ".join(rnd.choice(words) for _ in range(30)) + f" {passage} " + " ".join(rnd.choice(words) for _ in range(30)))
    return texts + [None, "", "!!", texts[0].upper() + "!", "one two", "one two three", "x " * 300, "x " * 299]


def test_alignment_is_the_longest_common_subsequence():
    texts = [t for t in near_corpus(random.Random(9)) if t and t.split() and t != "!!"][:60]
    for a, b in zip(texts, texts[1:]):
        got, want = neardup.aligned(neardup.labelled_shingles(a.encode()), neardup.labelled_shingles(b.encode())), similarity(a.replace("!", ""), b.replace("!", ""))
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def test_alignment_of_texts_cut_at_the_front():
    for k in (1, 7, 11, 100, 1000):
        a = np.arange(5 * k, dtype=np.uint64)
        assert neardup.aligned(a, a[k:]) == neardup.aligned(a[k:], a) == 0.8, k


def test_neardup(spark):
    docs = list(enumerate(near_corpus(random.Random(3))))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("class_id", F.lit("clash"))
    got = {r.doc_id: (r.class_id, r.stays) for r in neardup.classes(df).collect()}
    want = brute_classes(docs)
    assert {d: c for d, (c, _) in got.items()} == want and all(s == (c == d) for d, (c, s) in got.items())
    again = spark.createDataFrame(docs + docs[:5] + [(None, "n o p q r s"), (None, "n o p q r s")], "doc_id long, text string")
    rows = neardup.classes(again).collect()
    assert len(rows) == len(docs) + 7 and sum(r.stays for r in rows) == len(set(want.values())) + 1
    assert neardup.classes(again.limit(0)).isEmpty()


def test_neardup_finds_pairs_beside_a_failed_comparison(spark):
    """1000 copies near one original and not near each other, and true pairs in a family of almost-similar texts."""
    rnd = random.Random(5)
    word = lambda: f"v{rnd.randrange(10**9)}"
    original = [word() for _ in range(304)]  # 300 shingles; 6 words changed far apart leave 270 of them: 270 / 330
    texts = [" ".join(original)]
    for _ in range(1000):
        w = list(original)
        for p in rnd.sample(range(6, 298, 6), 6):
            w[p] = word()
        texts.append(" ".join(w))
    template = [word() for _ in range(200)]
    for _ in range(80):
        own = [word() for _ in range(60)]
        texts += [" ".join(template + own), " ".join(template + own[:-1] + [word()])]
    docs = list(enumerate(texts))
    shingles = [neardup.labelled_shingles(t.encode()) for t in texts]
    assert all(neardup.aligned(shingles[0], s) >= 0.8 for s in shingles[1:1001])
    assert sum(neardup.aligned(shingles[i], shingles[j]) >= 0.8 for i in range(1, 61) for j in range(1, i)) < 60
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {d: c for d, c in got.items() if d > 1000} == brute_classes(docs[1001:])
    assert all(got[d] == 0 for d in range(1001))


def test_neardup_takes_an_open_pair_in_one_bucket(spark):
    """Of 40 texts that share most buckets every pair that shares one and may link comes once, however many they share."""
    rnd = random.Random(8)
    word = lambda: f"v{rnd.randrange(10**9)}"
    original, members, profiles, counts, keys = [word() for _ in range(104)], [], [], [], []
    for k in range(40):
        w = list(original)
        w[rnd.randrange(5, 99)] = word()
        shingles = neardup.labelled_shingles(" ".join(w).encode())
        node, own = bytes([k]), [hash((i, x)) for i, x in enumerate(neardup.sketches(shingles).tolist())]
        members += [(b, node) for b in own]
        profiles.append((node, len(shingles), neardup.profile(shingles), np.array(own, np.int64).tobytes()))
        counts.append(np.frombuffer(profiles[-1][2], np.uint8).astype(int))
        keys.append(set(own))
    fit = lambda a, b: abs(counts[a] - counts[b]).sum() / 200 <= 1 / 9 + 1e-9
    want = sorted((bytes([a]), bytes([b])) for a in range(40) for b in range(a) if keys[a] & keys[b] and fit(a, b))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    near = neardup._open_pairs(frame(members, "bucket long, node binary"), frame(profiles, "node binary, size int, profile binary, buckets binary"), frame([], "a binary, b binary"), 0.8, None)
    assert sorted((bytes(r.a), bytes(r.b)) for r in near.collect()) == want and len(want) > 300


def test_neardup_deals_members_once_and_only_while_pairs_are_left(spark, monkeypatch):
    """Each pair in two components meets once, members of a small bucket are dealt once, and later rounds deal only those that have pairs left."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    sizes = {1: 8, 2: 9, 3: 23}
    members = [(b, bytes([b, k])) for b, n in sizes.items() for k in range(n)]
    links = [(bytes([b, k]), bytes([b, 0])) for b, n in sizes.items() for k in range(1, n // 2)]
    rows = neardup._dealt(frame(members, "bucket long, node binary"), frame(links, "a binary, b binary")).collect()
    assert sorted(bytes(r.node) for r in rows if r.bucket == 1) == [n for b, n in members if b == 1]
    blocks, met = {}, []
    for r in rows:
        blocks.setdefault((r.bucket, r.home, r.p, r.q), []).append(r)
    for (_, home, p, q), block in blocks.items():
        for i, x in enumerate(block):
            met += [tuple(sorted((bytes(x.node), bytes(y.node)))) for y in block[:i] if x.component != y.component and (not home and p == q or x.side != y.side)]
    home = {n for link in links for n in link}
    assert sorted(met) == sorted((x, y) for b, x in members for c, y in members if b == c and x < y and not (x in home and y in home))
    monkeypatch.undo()
    rnd = random.Random(11)
    word = lambda: f"v{rnd.randrange(10**9)}"
    template, texts = [word() for _ in range(230)], []
    for _ in range(30):  # 226 of 256 shingles are shared: 226 / 286, which the counts seldom rule out
        own = [word() for _ in range(30)]
        texts += [" ".join(template + own), " ".join(template + own[:-1] + [word()])]
    docs, dealt, open_pairs = list(enumerate(texts)), [], neardup._open_pairs
    monkeypatch.setattr(neardup, "_open_pairs", lambda members, *a: dealt.append(members.count()) or open_pairs(members, *a))
    assert {r.doc_id: r.class_id for r in neardup.classes(frame(docs, "doc_id long, text string")).collect()} == brute_classes(docs)
    assert len(dealt) > 1 and all(b < a for a, b in zip(dealt, dealt[1:])), dealt


# --- vectors


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 2
    got = vectors.decode_e8(x)
    step = vectors.neighbours()
    assert len(step) == 240 and np.allclose((step**2).sum(1), 2)
    doubled = np.rint(got * 2)
    assert np.allclose(doubled, got * 2) and (np.abs(doubled % 2).sum(1) % 8 == 0).all() and (got.sum(1) % 2 == 0).all()
    nearer = ((x[:, None] - got[:, None] - step[None]) ** 2).sum(2).min(1)
    assert (((x - got) ** 2).sum(1) <= nearer + 1e-9).all()


def vector_table(rng):
    base = rng.normal(size=(120, 64))
    rows = [list(map(float, v)) for v in base]
    for c in (0.94, 0.951, 0.96, 0.99):
        for v in base[:25]:
            u, z = v / np.linalg.norm(v), rng.normal(size=64)
            z -= z @ u * u
            rows.append([float(x) for x in (c * u + np.sqrt(1 - c * c) * z / np.linalg.norm(z)) * rng.uniform(0.1, 10)])
    hub = base[50]
    rows += [[float(x) for x in hub + rng.normal(size=64) * 0.02] for _ in range(40)]
    rows += [rows[0], rows[0], [x * 3 for x in rows[1]], None, [0.0] * 64, [1.0, None] * 32, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [], [1.0, 2.0], [2.0, 4.0], [1e300] * 64, [1e-300] * 64]
    return rows


@pytest.mark.parametrize("cell_rows", [2048, 5])
def test_vectors(spark, monkeypatch, cell_rows):
    rows = vector_table(np.random.default_rng(2))
    fine = [i for i, v in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i]) / np.abs(rows[i]).max() for i in fine}
    unit = {i: u / np.linalg.norm(u) for i, u in unit.items()}
    links = [(i, j) for i in fine for j in fine if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    root = partition(len(rows), links)
    degree = np.bincount([x for e in links for x in e], minlength=len(rows))
    monkeypatch.setattr(vectors, "CELL_ROWS", cell_rows)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, n_links int")
    pairs = vectors.link_pairs(spark.createDataFrame([(i, rows[i]) for i in fine if len(rows[i]) == 64 and i not in (fine[-1],)], "id long, vector array<double>"), cell_rows=cell_rows)
    found = {(r.a, r.b) for r in pairs.collect()}
    assert found <= set(links) and len(found) >= 0.97 * sum(len(unit[i]) == 64 and j != fine[-1] for i, j in links)
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    missed = [i for i in got if got[i].n_links != degree[i]]
    assert len(missed) <= 4 and all(got[i].n_links <= degree[i] for i in got)
    if not missed:
        assert {i: r.component_id for i, r in got.items()} == dict(enumerate(root))
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_vectors_awkward(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()
    same = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vectors.near_duplicates(same).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    nulls = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 4.0])], "vec_id long, embedding array<float>")
    assert sorted(map(repr, map(tuple, vectors.near_duplicates(nulls).collect()))) == sorted(map(repr, [(None, 0, None, True), (None, 0, None, True), (1, 1, 1, True), (2, 1, 1, False)]))
