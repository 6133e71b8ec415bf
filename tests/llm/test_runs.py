"""Periodic runs against a scan of every lag."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lanework.llm import queries, runs


def plain_runs(words):
    ids, found = np.unique(np.array(words), return_inverse=True)[1] if words else np.empty(0, int), {}
    for q in range(1, len(ids) // 3 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids[q:] == ids[:-q], [False]]).astype(int)))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e + q - s >= max(24, 3 * q):
                found.setdefault((s, e + q), q)  # the smallest period comes first
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_words(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    words = plain_words(doc_id, text)
    found = plain_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    return (doc_id, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha(lines), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def odd_texts():
    """Periods of every size and rest, nested and overlapping runs, nearly periodic texts, periods with inner repeats."""
    rng = random.Random(5)
    word = lambda alphabet: rng.choice("abcdefgh"[:alphabet])
    out = [[], ["a"] * 23, ["a"] * 24, ["a"] * 500, ["a", "b"] * 12, ["a", "b", "c"] * 8, list("aab" * 9 + "a")]
    for q in [*range(1, 60), 64, 65, 96, 97, 128, 143, 144, 200]:
        for extra in (-1, 0, 1, q // 2):
            alphabet = rng.randint(2, 8)
            period = [word(alphabet) for _ in range(q)]
            body = (period * 6)[: max(24, 3 * q) + extra]
            out.append([word(3) for _ in range(rng.randint(0, 30))] + body + [word(3) for _ in range(rng.randint(0, 30))])
    for q in (13, 30, 50, 101):  # periods that are themselves nearly periodic
        inner = ["a"] * (q - 1) + ["b"]
        out += [inner * 5, (inner * 4 + ["c"]) * 4, (inner * 2 + inner[: q // 2]) * 4]
    for _ in range(40):
        parts = [[word(2) for _ in range(rng.randint(1, 40))] for _ in range(4)]
        out.append([w for _ in range(rng.randint(3, 25)) for w in rng.choice(parts)])
    fib = ["a"], ["a", "b"]
    for _ in range(12):
        fib = fib[1], fib[1] + fib[0]
    out.append(fib[1])
    return out


def test_against_all_lags():
    texts = odd_texts()
    found = runs.runs_of_texts([[w.encode() for w in t] for t in texts])
    for t, f in zip(texts, found, strict=True):
        assert sorted(f) == plain_runs(t), t
    assert sum(map(len, found)) > 300 and max(q for f in found for _, _, q in f) >= 200


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=70), st.integers(1, 7)), max_size=4), st.integers(2, 14))
def test_any_text(parts, lags):
    text = [w for part, times in parts for w in part * times]
    held, runs.LAGS = runs.LAGS, lags
    try:
        assert [x for x in runs.runs_of(np.unique(np.array(text, object), return_inverse=True)[1].astype(np.int64) if text else np.empty(0, np.int64)) if x] == plain_runs(text)
    finally:
        runs.LAGS = held


def test_long_period_is_seeded_not_scanned():
    """A period of thousands of words in a long text: found by the scales, whose number follows the logarithm of the length."""
    rng = np.random.default_rng(1)
    period = rng.integers(0, 50_000, 7001)
    ids = np.concatenate([rng.integers(0, 50_000, 40_000), np.tile(period, 4)[:25_000], rng.integers(0, 50_000, 40_000)]).astype(np.int64)
    (found,) = runs.runs_of(ids)
    assert found[2] == 7001 and found[0] <= 40_000 and found[1] >= 25_000
    assert len(runs.scales(len(ids) // 3, runs.LAGS)) < 30


def test_scales_leave_no_period_out():
    found = runs.scales(5000, runs.LAGS)
    assert found[0][0] == runs.LAGS and all(a[1] + 1 == b[0] for a, b in zip(found, found[1:], strict=False)) and found[-1][1] >= 5000
    assert all(2 * least - k + 1 >= k / 3 for least, k in found)


def test_rows(spark, documents, nothing):
    tail = [f"w{i}" for i in range(40)]
    rows = [(10, " ".join(tail * 5), "x"), (11, "\t".join(tail * 5), "x"), (None, "z " * 30, "x"), (17, None, "y"), *[(i, " ".join(tail * 4 + ["end"]), "q") for i in range(200, 240)]]
    docs = documents.unionByName(spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumnRenamed("runs", "ids"))
    found = runs.run_digests(runs.find_runs(docs, places=runs.repeated_tail)).collect()
    expected = [plain_row(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    assert any(r.n_runs for r in found)
    clash = spark.createDataFrame([(1, "a " * 30, 5, "x")], "doc_id long, text string, n_words long, runs string")
    assert runs.find_runs(clash).first().collapsed == "a"
    assert runs.run_digests(runs.find_runs(nothing)).count() == 0


def test_query(spark, sf_dir):
    found = queries.op11_minimizer_runs(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str(plain_row(d.doc_id, d.text)) for d in docs)


def test_crc_in_sql():
    for text in ("0", "1", "999", "1234567890", "17:3"):
        assert duckdb.sql(f"SELECT {queries._crc32_sql(f"'{text}'")}").fetchall()[0][0] == zlib.crc32(text.encode())


@pytest.mark.parametrize("name", ["op11_minimizer_runs"])
def test_query_equals_sql(name, spark, sf_dir):
    df = queries.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    expected = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(str, expected.fetchall()))
