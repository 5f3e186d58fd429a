import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hard_negatives as hn
from lodestone.llm import simhash, whitening
from lodestone.llm.queries import QUERIES

VECS = "vec_id long, embedding array<float>, label int, x string"
NAN, INF = float("nan"), float("inf")


def whole(v):
    return [int(np.floor(np.float64(np.float32(c)) * 256)) for c in v]


def vectors(rng, n, dim, hot=0):
    centres = [[rng.gauss(0, 0.3) for _ in range(dim)] for _ in range(4)]
    rows = []
    for k in range(n):
        c = rng.randrange(4)
        v = centres[0] if k < hot else [x + rng.gauss(0, 0.1) for x in centres[c]]
        rows.append((k, v, rng.randrange(3), "x"))
    odd = [(n, None, 1), (n + 1, [None] * dim, 1), (n + 2, [NAN] + [0.0] * (dim - 1), 0), (n + 3, [INF] * dim, 2), (n + 4, [0.0] * dim, None), (n + 5, [-0.0] * dim, 1)]
    return rows + [(*r, None) for r in odd]


# ---- whitening


def test_cross_products_of_any_longs():
    rng = np.random.default_rng(0)
    extreme = np.array([[2**63 - 1, -(2**63)], [-(2**63), 5]])
    for x in (rng.integers(-100, 100, (1000, 7)), rng.integers(-(2**40), 2**40, (70, 3)), np.zeros((3, 2), np.int64), extreme):
        sums, products = whitening.cross_products(x)
        exact = x.astype(object)
        assert (sums == exact.sum(axis=0)).all() and (products == exact.T @ exact).all()


def test_planes_hold_the_rows():
    u = np.random.default_rng(1).integers(0, 40, (150, 3))
    planes, dims, places = whitening.bit_planes(u)
    for words, d, p in zip(planes, dims, places, strict=True):
        bits = np.unpackbits(words.view(np.uint8))[:150]
        assert (bits == u[:, d] >> p & 1).all()


def check_whitened(rows, got, dim):
    """Against the definition in integers and numpy."""
    kept = {r[0]: whole(r[1]) + [0] * (dim - len(r[1])) for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])}
    fit = np.array(sorted(set(map(tuple, kept.values()))), object)
    n, total = len(fit), fit.sum(axis=0)
    cov = ((n * (fit.T @ fit) - np.outer(total, total)) / (n * n)).astype(float)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(4, dim)
    seen = defaultdict(dict)
    for r in got:
        seen[r.vec_id][r.component] = r
    assert set(seen) == set(kept) and len(got) == k * len(kept)
    for c in range(1, k + 1):
        expected = {i: (np.array(x, float) - total.astype(float) / n) @ axes[:, c - 1] / np.sqrt(values[c - 1]) for i, x in kept.items()}
        mine = np.array([seen[i][c].whitened for i in kept])
        theirs = np.array([expected[i] for i in kept])
        assert min(abs(mine - theirs).max(), abs(mine + theirs).max()) < 1e-8
    for i, x in kept.items():
        r = seen[i][1]
        assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(x, total, strict=True))
        assert abs(seen[i][2].explained - values[1] / values.sum()) < 1e-10 and r.identity_error < 1e-9


def test_whitening_agrees_with_integers(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 50)
    rows = vectors(random.Random(1), 400, 9, hot=130)
    rows += [rows[200], (None, [0.5] * 9, 0, "a"), (777, [0.25] * 4, 0, "short")]
    df = spark.createDataFrame(rows, VECS).repartition(5)
    got = whitening.whiten(df).collect()
    named = [r for r in got if r.vec_id is not None and r.vec_id != 200]
    assert sum(r.vec_id is None for r in got) == 4 and sum(r.vec_id == 200 for r in got) == 8
    assert [r.deviation for r in got if r.vec_id is None][0] is not None
    check_whitened([r for r in rows if r[0] not in (200, None)] + [(10**6, rows[200][1]), (10**6 + 1, [0.5] * 9)], named + list(remapped(got)), 9)


def remapped(got):
    """The repeated row and the one without an id, once, under ids of their own."""
    for component in range(1, 5):
        for vec_id, other in ((200, 10**6), (None, 10**6 + 1)):
            r = next(r for r in got if r.vec_id == vec_id and r.component == component)
            yield type(r)(**{**r.asDict(), "vec_id": other})


def test_whitening_of_odd_tables(spark):
    df = lambda rows: spark.createDataFrame(rows, VECS)
    assert whitening.whiten(df([])).collect() == []
    assert whitening.whiten(df([(1, [], 0, ""), (2, None, 0, "")])).collect() == []
    one = whitening.whiten(df([(1, [0.5, 0.25], 0, ""), (2, [0.5, 0.25], 0, "")])).collect()
    assert len(one) == 4 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, 0.0, 0.0, 1.0) for r in one)
    line = whitening.whiten(df([(1, [0.5, 0.25], 0, ""), (2, [1.5, 0.25], 0, "")])).collect()
    assert sorted(round(r.whitened, 9) for r in line) == [-1.0, 0.0, 0.0, 1.0] and {round(r.explained, 9) for r in line} == {0.0, 1.0}
    far = whitening.whiten(df([(1, [1e12], 0, ""), (2, [-1e12], 0, "")])).collect()
    assert [r.deviation for r in far] == [None, None] and sorted(round(r.whitened, 9) for r in far) == [-1.0, 1.0]


# ---- hard negatives


def brute_negatives(rows, anchors, positives=5, negatives=10):
    rows = {r[0]: (r[2], whole(r[1])) for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(c is not None and np.isfinite(c) for c in r[1])}
    out = set()
    for a in filter(anchors, rows):
        score = {i: sum(p * q for p, q in zip(rows[a][1], x, strict=False)) for i, (_, x) in rows.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][0] == rows[a][0]][:positives]:
            hard = [i for i in order if rows[i][0] != rows[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out |= {(a, p, k, i, score[p], score[i]) for k, i in enumerate(hard[:negatives], 1)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_agree_with_all_pairs(spark, monkeypatch, small):
    if small:  # many blocks, few of them held at once
        for name, value in (("ROWS", 16), ("ANCHORS", 4), ("HELD", 2), ("GROUP", 3), ("PAIRS", 7)):
            monkeypatch.setattr(hn, name, value)
    rows = vectors(random.Random(5), 500, 20, hot=160)
    rows += [(None, [0.1] * 20, 0, ""), (900, [0.3] * 7, 1, "short"), (901, [], 2, "empty"), rows[40], rows[41]]
    got = hn.hard_negatives(spark.createDataFrame(rows, VECS), F.col("id") % 9 == 0).collect()
    assert {tuple(r) for r in got} == brute_negatives(rows, lambda i: i % 9 == 0) and len(got) == len(set(got)) > 500


def test_intervals_hold_and_exclude(spark):
    rng = np.random.default_rng(3)
    x, a = rng.integers(-120, 120, (300, 50)), rng.integers(-120, 120, (40, 50))
    x[:5] = 0
    a[1] = a[0] * 3
    signs = hn.rotation(50)
    low, high = hn.intervals(*hn.levels(a, signs), *hn.encode(x, signs))
    exact = a @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    y = hn.rotate(x, signs)
    assert np.allclose((y * y).sum(axis=1), (x * x).sum(axis=1))
    df = spark.createDataFrame(vectors(random.Random(6), 800, 32), VECS)
    n, scored = hn.scored_share(df, F.col("id") % 20 == 0).first()
    assert n == 40 * 801 and 0 < scored < n / 3


def test_negatives_of_odd_tables(spark):
    df = lambda rows: spark.createDataFrame(rows, VECS)
    every = F.lit(True)
    assert hn.hard_negatives(df([]), every).collect() == []
    assert hn.hard_negatives(df([(1, [1.0], 0, "")]), F.lit(False)).collect() == []
    assert hn.hard_negatives(df([(1, [], 0, ""), (2, [], 0, ""), (3, [], 1, "")]), F.col("id") == 1).collect() == [(1, 2, 1, 3, 0, 0)]
    # An id with two rows is that of the smaller label; opposite vectors have no negatives.
    rows = [(1, [1.0], 0, ""), (1, [1.0], 1, ""), (2, [1.0], 0, ""), (3, [0.5], 1, ""), (4, [-1.0], 0, "")]
    assert [tuple(r) for r in hn.hard_negatives(df(rows), F.col("id") == 1).collect()] == [(1, 2, 1, 3, 65536, 32768)]


def test_anchors_are_handed_over_once_for_all_rows(spark, monkeypatch):
    """However many rows there are, Spark sends each anchor to a task once."""
    for name, value in (("ROWS", 16), ("GROUP", 1), ("ANCHORS", 64), ("HELD", 2)):
        monkeypatch.setattr(hn, name, value)
    rows = vectors(random.Random(7), 3000, 20)
    name, before = "spark.sql.maxBroadcastTableSize", spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set(name, str(6 << 20))
    try:
        got = hn.hard_negatives(spark.createDataFrame(rows, VECS), F.col("id") % 20 == 0).collect()
    finally:
        spark.conf.set(name, before)
    assert {tuple(r) for r in got} == brute_negatives(rows, lambda i: i % 20 == 0) and len(got) == len(set(got)) > 500


@pytest.mark.parametrize("far", [1, 2**22])
def test_all_scores_of_a_tile_or_a_few(monkeypatch, far):
    """Pairs that are few, and scores that floats don't hold, are summed in integers."""
    rng = np.random.default_rng(9)
    blocks = [hn.Block.__new__(hn.Block), hn.Block.__new__(hn.Block)]
    for n, b in zip((40, 300), blocks, strict=True):
        b.x = rng.integers(-120, 120, (n, 50)) * far
        b.x[:, 0] += 1
    a, r = blocks
    exact, part = a.x @ r.x.T, slice(8, 40)
    least, most = np.full(40, -(2.0**20) * far * far), np.full(40, 2.0**17 * far * far)
    for share in (0.001, 0.9):
        need = rng.random((32, 300)) < share
        want = {(i + 8, j, exact[i + 8, j]) for i, j in zip(*np.nonzero(need), strict=True) if least[0] <= exact[i + 8, j] <= most[0]}
        got = list(zip(*hn._scored(a, r, part, need.copy(), least, most), strict=True))
        assert set(got) == want and len(got) == len(want) > 0


# ---- fingerprints

DOCS = "doc_id long, text string, fingerprint string, component long"


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """Smallest member reachable."""
    least = {n: n for n in nodes}

    def root(n):
        while least[n] != n:
            n = least[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {n: root(n) for n in nodes}


def test_fingerprints_and_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPAN", 100)
    rng = random.Random(8)
    words = ["alpha", "Beta", "gamma", "délta", "epsilon", "zeta", "eta\x0btheta", "日本", "x"]
    base = [rng.choices(words, k=rng.randint(0, 400)) for _ in range(40)]
    texts = [None, "", " \n", "A", "a", "b  C", "one two three"]
    for w in base:
        texts.append(" ".join(w))
        for _ in range(3):
            v = list(w)
            if v:
                v[rng.randrange(len(v))] = rng.choice(words)
            texts.append("\t".join(v))
    texts += ["the same line again " * 20] * 30
    rows = [(k, t, "f", 1) for k, t in enumerate(texts)] + [(None, texts[9], "", 2), (3, texts[20], "", 3)]
    got = simhash.simhash_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    prints = {t: brute_fingerprint(t) for t in set(texts)}
    classes = defaultdict(list)
    for i, t, *_ in rows:
        if i is not None:
            classes[prints[t]].append(i)
    of = components(sorted(classes), lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for fp, ids in classes.items():
        least[of[fp]] += ids
    expected = sorted((-1 if i is None else i, f"{prints[t]:016x}", -1 if i is None else min(least[of[prints[t]]])) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in got) == expected
    assert len(set(of.values())) < len(of)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_near_pairs_of_a_block(radius):
    rng = np.random.default_rng(radius)
    for m in (1, 2, 63, 64, 65, 200):
        fps = rng.integers(0, 2**63, 5, dtype=np.uint64)[rng.integers(0, 5, m)]
        for _ in range(3):
            fps = fps ^ np.where(rng.random(m) < 0.7, np.uint64(1) << rng.integers(0, 64, m, dtype=np.uint64), np.uint64(0))
        i, j = simhash.near_pairs(fps, radius)
        expected = {(a, b) for a in range(m) for b in range(a + 1, m) if int(fps[a] ^ fps[b]).bit_count() <= radius}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == expected and len(i) == len(expected)


@pytest.mark.parametrize(("radius", "block"), [(2, 512), (2, 8), (1, 4), (3, 8)])
def test_links_of_crowded_fingerprints(spark, radius, block):
    rng = random.Random(block)
    hub = rng.getrandbits(64)
    fps = {hub}
    for width in (32, 12, 64):
        for _ in range(150):
            f = hub if width < 64 else rng.getrandbits(64)
            for _ in range(rng.randint(1, 5)):
                f ^= 1 << rng.randrange(width)
            fps.add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    links = simhash.fingerprint_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), radius, block).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 64 for r in links)
    expected = components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= radius)
    found = {(r.a % 2**64, r.b % 2**64) for r in links}
    assert components(sorted(fps), lambda a, b: (a, b) in found or (b, a) in found) == expected


def test_fingerprints_of_no_rows(spark):
    assert simhash.simhash_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_a_text_of_many_words():
    text = "one two three four " * 300_000
    data = np.frombuffer(text.encode(), np.uint8)
    assert simhash.fingerprints(data, np.array([0, len(data)]))[0] == brute_fingerprint(text)


@pytest.mark.parametrize("name", ["op11_whitened_embeddings", "op12_hard_negatives", "op13_simhash_duplicates"])
def test_queries_read_whole_tables(spark, tmp_path, name):
    rng = random.Random(2)
    spark.createDataFrame(vectors(rng, 300, 8), VECS).drop("x").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(k, hashlib.md5(bytes([k % 50])).hexdigest(), "", 0) for k in range(100)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES[name](spark, str(tmp_path)).collect()
    assert len(rows) == {"op11_whitened_embeddings": 302 * 4, "op12_hard_negatives": len(rows), "op13_simhash_duplicates": 100}[name] and rows
