"""SimHash near-duplicates against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from lanework.llm import queries, simhash


def plain_fingerprint(text, size):
    words = _words(text)
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i : i + size]).encode(), seed=42).intdigest() for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            out += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return out


def plain_roots(values, bits):
    fps = np.array(values, np.uint64)
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= bits).tolist():
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def plain_rows(rows, size, bits=4):
    fps = [plain_fingerprint(t, size) for _, t in rows]
    roots, least = plain_roots(fps, bits), {}
    for r, (d, _) in zip(roots, rows, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted((str(d), f"{f:016x}", str(least.get(r)), least.get(r) is None or least.get(r) == d) for (d, _), f, r in zip(rows, fps, roots, strict=True))


def flipped(rng, value, n):
    for b in rng.sample(range(64), n):
        value ^= 1 << b
    return value


@pytest.mark.parametrize(("bits", "most", "levels"), [(4, 4096, 3), (4, 40, 2), (4, 12, 0), (2, 9, 3), (0, 5, 1)])
def test_links_of_fingerprints(spark, bits, most, levels):
    """Dense groups, chains, pairs just at and just beyond the bound, in buckets far larger than a tile."""
    rng = random.Random(bits * 100 + most)
    values = {0, (1 << 64) - 1, 1 << 63, *(rng.getrandbits(64) for _ in range(200))}
    for _ in range(4):
        center = rng.getrandbits(64)
        values |= {flipped(rng, center, rng.randint(0, 3)) for _ in range(120)}
        values |= {flipped(rng, center, rng.randint(7, 12)) for _ in range(30)}  # outside, but in many of its buckets
        chain = center
        for _ in range(15):
            chain = flipped(rng, chain, rng.choice((bits, bits, min(64, bits + 1))))
            values.add(chain)
    for _ in range(150):  # one shared block, else at random: large buckets without a group
        values.add(rng.getrandbits(51) << 13 | 77)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    found = {r.node % (1 << 64): r.root for r in simhash.linked(spark.createDataFrame(signed, "fp long").repartition(4), bits, most, levels).collect()}
    roots = plain_roots(values, bits)
    groups: dict = {}
    for v, r in zip(values, roots, strict=True):
        groups.setdefault(r, []).append(v)
    assert sorted(v for g in groups.values() if len(g) > 1 for v in g) == sorted(found)
    named: dict = {}
    for v, r in found.items():
        named.setdefault(r, []).append(v)
    assert sorted(map(sorted, named.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_table_bounds_every_pair():
    """No column of a pair differs by more than the pair does, and most far pairs end at the table."""
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 64, 3000, np.uint64, endpoint=False)
    table = simhash.distance_table(fps).astype(int)
    apart = np.bitwise_count(fps[1:] ^ fps[:-1])
    widest = np.abs(table[1:] - table[:-1]).max(1)
    assert (widest <= apart).all() and (widest <= 4).mean() < 0.001


def test_blocks_share_no_bit_and_leave_none_out():
    levels = simhash.block_masks(5, 2)
    assert [len(x) for x in levels] == [5, 25, 125]
    for parent, children in [(0, levels[0])] + [(m, levels[1][i * 5 : i * 5 + 5]) for i, m in enumerate(levels[0])]:
        own = [c ^ parent for c in children]
        assert sum(own) == (1 << 64) - 1 - parent and all(c & parent == parent for c in children)


def test_rows(spark, documents, nothing):
    rng = random.Random(7)
    word = lambda: rng.choice("ABcdEfghij") + str(rng.randint(0, 300))
    rows = [(None, None), (90, ""), (91, " \n"), (92, "One two"), (93, "one TWO"), (94, "ÀB cd ef gh ij"), (95, "àb cd ef gh ij"), (96, "ÀB CD EF GH IJ")]
    for i in range(12):
        base = [word() for _ in range(rng.randint(40, 200))]
        for k in range(rng.randint(1, 10)):
            copy = list(base)
            for _ in range(k // 3):
                copy[rng.randrange(len(copy))] = word()
            rows.append((100 + 20 * i + k, " ".join(copy)))
    rows += [rows[20], rows[20], (None, rows[21][1])]
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("*", "1 as fingerprint", "2 as component_id").repartition(3)
    for size in (4, 5):
        found = simhash.near_duplicates(docs, size, most=20).collect()
        assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id), r.kept) for r in found) == plain_rows([(r.doc_id, r.text) for r in docs.collect()], size)
    assert simhash.near_duplicates(nothing).count() == 0


def test_query(spark, sf_dir):
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = queries.op12_simhash_pivots(spark, sf_dir).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == [x[:3] for x in plain_rows(rows, 4)]
