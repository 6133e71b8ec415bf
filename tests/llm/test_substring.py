"""Repeated windows against a plain count of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lanework.llm import _words, queries, substring


def plain(texts, window):
    words = [(t or "").encode().split() for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def test_words_and_windows():
    texts = ["a  b\tc\n".encode(), b"", b" a b c", "é x y b c".encode()]
    hashes, first = _words.hash_words(texts)
    assert first.tolist() == [0, 3, 3, 6, 11]
    flat = [w for t in texts for w in t.split()]
    assert len(set(hashes[0].tolist())) == len(set(hashes[1].tolist())) == len(set(flat))
    windows = _words.Windows(hashes, first)
    starts = windows.starts(2)
    found = windows.hash(starts, 2).tolist()
    pairs = [tuple(flat[i : i + 2]) for i in starts]
    assert len(pairs) == 2 + 2 + 4 and len(set(found)) == len(set(pairs))


@pytest.mark.parametrize(("window", "base"), [(35, 18), (35, 9), (35, 5), (7, 2), (5, 5), (3, 10), (1, 1)])
def test_against_all_windows(spark, window, base):
    rng = random.Random(window * 100 + base)
    shared = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(rng.randint(20, 120))) for _ in range(12)]
    texts = [None, "", " \n ", "one", shared[0], shared[0]]
    for i in range(150):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(f"u{i}_{j}_{k}" for k in range(rng.randint(0, 50))) for j in range(rng.randint(0, 6))]
        texts.append("\n".join(parts))
    texts.append("x " * 3000)
    rows = [(None if i % 31 == 3 else i // 2, t, str(i)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(5)
    found = substring.digests(docs, window, base).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found) == sorted((str(d), *x) for (d, _, _), x in zip(rows, plain(texts, window), strict=True))
    kept = substring.remove_repeats(docs, window, base).collect()
    assert sorted(hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() for r in kept) == sorted(x[2] for x in plain(texts, window))
    assert kept[0].asDict().keys() == {"doc_id", "text", "key", "n_words", "n_removed"}


def test_hot_passage_is_one_message_per_batch(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{passage} own{i}") for i in range(400)], "doc_id long, text string").coalesce(1)
    rows = docs.selectExpr("doc_id as id0", "xxhash64(doc_id, text) as key", "text", "cast(null as binary) as kept")
    sent = [len(substring.unpack_rows(r.payload, np.uint64, np.uint64, bool, np.int64, np.int64, np.uint32)[0]) for r in substring._messages(rows, [18, 35], 0, 1, 4).where("not own").collect()]
    assert sum(sent) < 60 + 400 * 3
    assert {r.n_removed for r in substring.digests(docs).collect()} == {60}


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_thue_morse_texts_differ(spark, n):
    bits = thue_morse(n)
    words = ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]
    codes, _ = _words.hash_words([w.encode() for w in words])
    assert (codes[:, 0] != codes[:, 1]).all()
    texts = [" ".join(["x", "y"][b ^ flip] for b in bits) for flip in (0, 1)]
    windows = _words.Windows(*_words.hash_words([t.encode() for t in texts]))
    assert windows.hash(np.array([0, n]), 35, 0)[0] != windows.hash(np.array([0, n]), 35, 0)[1]
    rest = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{words[0]} {rest}"), (2, f"{words[1]} {rest} z")], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring.digests(docs).collect()) == [40, 40]
    alone = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{words[0]} {alone}"), (2, f"{words[1]} {alone}")], "doc_id long, text string")
    assert [r.n_removed for r in substring.digests(docs).collect()] == [0, 0]


def test_doubling_goes_on_until_none_survives(spark):
    line = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, line("a", 300) + " x " + line("b", 40)), (2, "y " + line("a", 300)), (3, line("b", 40)), (4, line("c", 34)), (4, None), (None, line("c", 34) + " z"), (6, line("a", 100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((str(r.doc_id), r.longest) for r in substring.longest_repeats(docs).collect())
    assert found == sorted([("1", 280), ("2", 280), ("3", 35), ("4", 0), ("4", 0), ("None", 0), ("6", 70)])
    assert substring.longest_repeats(docs.limit(0)).count() == 0


def test_texts_stay_in_their_buckets(spark):
    docs = spark.createDataFrame([(i, f"t{i % 7} " * 50) for i in range(50)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = substring.with_positions(docs, 35, 9, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan


def test_query_against_sql(spark):
    import duckdb

    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = queries.op4_repeated_windows(spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(queries.ORACLES["op4_repeated_windows"]).fetchall())


def test_empty(spark, nothing):
    assert substring.digests(nothing).count() == 0
