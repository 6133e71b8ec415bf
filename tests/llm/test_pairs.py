"""Near-duplicates and nearest neighbours against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lanework.llm import _base, ann, neardup, queries


def plain_components(rows, size, similarity=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = (text or "").translate(lower).encode().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = least.get(root(i)) if sets[i] else d
        out.append((str(d), len(sets[i]), str(c), c is None or c == d))
    return sorted(out)


@pytest.mark.parametrize(("size", "block"), [(4, 128), (5, 7)])
def test_near_duplicates(spark, size, block):
    rng = random.Random(size)
    word = lambda: rng.choice("ABcdEfghij") + str(rng.randint(0, 300))
    rows = [(None, None), (3, ""), (4, " \n"), (5, "One two"), (6, "one TWO"), (7, "one two three"), (8, "ÀB àb cd ef gh"), (9, "àB àb cd ef gh")]
    n = 10
    for _ in range(25):
        base = [word() for _ in range(rng.randint(6, 150))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [rows[20], rows[20], (None, rows[21][1]), (None, rows[21][1])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, component_id int").repartition(3)
    found = neardup.near_duplicates(docs, size, block=block).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in found) == plain_components(rows, size)


def test_near_duplicates_query(spark, sf_dir):
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = queries.op8_minhash_bayes(spark, sf_dir).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in found) == plain_components(rows, 4)


def test_clusters_that_are_nearly_alike(spark):
    """Two groups of copies whose members are just below the bound of similarity across, but for one pair."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join([*base, f"a{i}"])))
    other = base[:86] + [f"v{i}" for i in range(14)]
    for i in range(40):
        rows.append((100 + i, " ".join([*other, f"b{i}"])))
    far = [(d, t) for d, t in rows]
    bridge = [*base[:93], *[f"v{i}" for i in range(7, 14)]]
    for case in (far, [*far, (500, " ".join(bridge))]):
        rng.shuffle(case)
        docs = spark.createDataFrame(case, "doc_id long, text string").repartition(4)
        found = neardup.near_duplicates(docs, 1, block=16).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in found) == plain_components(case, 1)


def test_thue_morse_texts_are_apart(spark):
    words = ["".join("ab"[bin(i).count("1") % 2 ^ flip] for i in range(1024)) for flip in (0, 1)]
    docs = spark.createDataFrame([(i, f"{w} {i} x y") for i, w in enumerate(words)] + [(7, f"{words[0]} 0 x y")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs, 4).collect()) == [(0, 0), (1, 1), (7, 0)]


def test_no_documents(spark, nothing):
    assert neardup.near_duplicates(nothing).count() == 0


def test_bounds_rise_and_keep_similar_pairs():
    bounds = neardup.keep_at(1e-5, 0.8)
    assert [n for n, _ in bounds] == [32, 64, 96, 128] and all(a[1] < b[1] for a, b in zip(bounds, bounds[1:], strict=False))
    rng = np.random.default_rng(1)
    hits = rng.random((20000, 128)) < 0.8
    assert all((hits[:, :n].sum(1) >= least).mean() > 0.9995 for n, least in bounds)


def groups_of(pairs):
    up: dict = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        if a != b:
            up[root(a)] = root(b)
    out: dict = {}
    for i in up:
        out.setdefault(root(i), set()).add(i)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("shape", ["path", "reverse", "long", "star", "mixed", "none"])
def test_components(spark, shape):
    rng = random.Random(1)
    pairs = {
        "path": [(i, i + 1) for i in range(500)],
        "reverse": [(500 - i, 499 - i) for i in range(500)],
        "long": [(i, i + 1) for i in range(5000)],
        "star": [(9999, i) for i in range(2000)],
        "mixed": [(i, (i + 1) % 77) for i in range(77)] + [(100 + rng.randrange(300), 100 + rng.randrange(300)) for _ in range(200)] + [(7, 7), (1000, 1000)],
        "none": [(1, 1)],
    }[shape]
    found: dict = {}
    for r in _base.components(spark.createDataFrame(pairs, "a long, b long"), "test").collect():
        found.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, found.values())) == groups_of(pairs)
    assert all(root in nodes for root, nodes in found.items())


def brute(rows, every=100, k=10):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float)
    names = sorted(good)
    x = np.stack([good[i] for i in names]) if names else np.zeros((0, 1))
    out = {}
    for i in names:
        if i % every == 0:
            d = np.sqrt(((x - good[i]) ** 2).sum(1))
            out[i] = sorted((d[j], n) for j, n in enumerate(names) if n != i)[:k]
    return out


def test_nearest_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(150)] + [(200 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)]
    rows += [(1000, None), (1100, [0.0] * 4), (1200, [float("nan"), 1.0, 1.0, 1.0]), (1300, [None, 1.0, 1.0, 1.0]), (1400, [float("inf"), 0.0, 0.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0]), (200, [1.0, 2.0, 3.0, 4.0])]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    found: dict = {}
    for r in ann.nearest(vectors).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    expected = brute(rows)
    assert found.keys() == expected.keys()
    for q, near in expected.items():
        assert [(r, i) for r, i, _ in found[q]] == [(r + 1, i) for r, (_, i) in enumerate(near)]
        assert np.allclose([s for *_, s in found[q]], [s for s, _ in near], atol=1e-12)
    few = ann.nearest(vectors.where("vec_id in (0, 1, 2)")).collect()
    assert [r.rank for r in few] == [1, 2]
    assert ann.nearest(vectors.limit(0)).count() == 0


def test_recall_over_shards(spark):
    sf_dir = "/root/testdata/sf0.1"
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    expected = brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    found = ann.nearest(vectors, shard=700).collect()
    hits = {(r.query_id, r.vec_id) for r in found}
    assert len(found) == 10 * len(expected)
    assert sum((q, i) in hits for q, near in expected.items() for _, i in near) / (10 * len(expected)) >= 0.9


def test_recall_comes_from_the_rounds(spark):
    """A full shard of vectors without any structure: a narrow search finds little over random lists, and more with each round."""
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(8000, 48)))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).cache()
    expected = brute(rows, every=100)
    recalls = []
    for rounds, beam in ((0, 40), (1, 40), (None, 40), (None, ann.BEAM)):
        hits = {(r.query_id, r.vec_id) for r in ann.nearest(vectors, rounds=rounds, beam=beam).collect()}
        recalls.append(sum((q, i) in hits for q, near in expected.items() for _, i in near) / (10 * len(expected)))
    vectors.unpersist()
    assert recalls[0] < 0.6 and recalls == sorted(recalls) and recalls[2] > recalls[0] + 0.25 and recalls[3] >= 0.95, recalls


def test_recall_on_separated_clusters(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(150, 16)) * 10
    rows = [(i, (middles[i % 150] + rng.normal(size=16) * 0.1).tolist()) for i in range(4500)]
    expected = brute(rows, every=31)
    hits = {(r.query_id, r.vec_id) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=31).collect()}
    assert sum((q, i) in hits for q, near in expected.items() for _, i in near) / (10 * len(expected)) >= 0.99


def test_ties_go_to_the_smallest_ids(spark):
    """Many vectors at one distance exactly: the ten of smallest id are returned, for every query."""
    n = 150
    unit = np.eye(n + 1)
    rows = [(i, unit[i].tolist()) for i in range(1, n + 1)] + [(0, [0.0] * n + [0.0]), (1000, (-unit[n]).tolist())]
    rows = [(i, v if any(v) else (unit[0] * 1e-9).tolist()) for i, v in rows]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), every=100).collect()
    got = {q: [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 100, 1000)}
    x = {i: np.array(v) for i, v in rows}
    for q, ids in got.items():
        best = sorted((float(np.sqrt(((x[i] - x[q]) ** 2).sum())), i) for i in x if i != q)[:10]
        assert ids == [i for _, i in best]
