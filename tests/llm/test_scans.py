"""Secret scan against Python's re, toxicity against enumeration and held-out labels."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanework.llm import queries, secrets, toxicity


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]{16,}") == [frozenset({"aki", "kia"})]
    assert secrets.trigram_query("[0-9a-f]{24,}") is None
    assert secrets.trigram_query("ab|cdef") is None
    assert {frozenset(x) for x in secrets.trigram_query("(?:tok)en_?x|pass(word)?")} == {frozenset({"tok", "oke", "ken", "enx"}), frozenset({"tok", "oke", "ken", "en_", "n_x"}), frozenset({"pas", "ass"}), frozenset({"pas", "ass", "ssw", "swo", "wor", "ord"})}
    assert len(secrets.trigram_query(secrets.RULES[0].pattern)) == 6
    assert secrets.trigram_query(r"a\.bc\x20[x]+(def){2,}") == [frozenset({"a.b", ".bc", "bc ", "def"})] and secrets.trigram_query(r"(abc)*\dx") is None
    assert secrets.rarest_first(frozenset({"ass", "ssw"}))[0] == "ssw"


def test_stored_postings(spark):
    rows = [(i % 5, t) for i, t in enumerate(ODD)] + [(1, ODD[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = secrets.build_index(docs)
    assert index.columns == ["trigram", "key"]
    found = {(r.key, kind) for r in secrets.search_index(index).collect() for kind in r.kinds}
    texts = {r.key: r.text or "" for r in docs.selectExpr("text", "xxhash64(doc_id, text) as key").collect()}
    expected = {(k, rule.kind) for k, t in texts.items() for rule in secrets.RULES for part in secrets.trigram_query(rule.pattern) or () if all(g in t.lower() for g in part)}
    assert found == expected and expected
    here = {(r.key, kind) for r in docs.selectExpr("xxhash64(doc_id, text) as key", "coalesce(text, '') as text").select("key", secrets.candidate_kinds(F.col("text"), secrets.RULES).alias("kinds")).collect() for kind in r.kinds}
    assert here == expected
    only_hex = (secrets.RULES[2],)
    assert secrets.search_index(secrets.build_index(docs, only_hex), only_hex).count() == 0


def test_indexed_scan(spark, nothing):
    """An index gives what the scan of every row gives, with equal rows, null ids, clashing columns, and rows it names needlessly."""
    rows = [(i % 5 if i else None, t, i, "own", [1]) for i, t in enumerate(ODD)] + [(1, ODD[3], 0, "own", None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, kinds string, found array<int>")
    index = secrets.build_index(docs)
    listed = lambda df: sorted(map(repr, df.collect()))
    assert listed(secrets.scan(docs, index=index)) == listed(secrets.scan(docs))
    more = index.union(docs.selectExpr("explode(array('pas', 'ass', 'key', 'aki')) as trigram", "xxhash64(doc_id, text) as key"))
    assert listed(secrets.scan(docs, index=more)) == listed(secrets.scan(docs))
    # The index decides: rows that it does not name are searched by rules without trigrams only.
    bare = secrets.scan(docs, index=index.limit(0)).selectExpr("inline(secret_spans)")
    assert {r.kind_order for r in bare.collect()} == {2}
    assert secrets.scan(nothing.selectExpr("doc_id", "text"), index=secrets.build_index(nothing)).count() == 0
    plan = secrets.scan(docs, index=index)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def plain_spans(text):
    rules = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24), ("key_block", re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 1), ("chat_token", re.compile("xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 1)]
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, g, least) in enumerate(rules) for m in p.finditer(text) if len(m[g]) >= least]
    return sorted(found)


ODD = ["", None, "token=abc secret=token:abcdefgh", "é日😀 Password: 'hunter2hunter2' x", "AKIA" + "A" * 15 + " AKIA" + "B1" * 8, "f" * 23 + " " + "f" * 24 + "g" + "0a" * 20, "api_key==xyzxyz apikey = \"0123456789abcdef0123456789abcdef\"", "secret=secret=secret=secret", "TOKEN:abcdef" * 400, "passwd  :=  a.b.c_d", "x -----BEGIN RSA PRIVATE KEY----- y -----BEGIN PRIVATE KEY-----", "xoxb-0123456789 xoxz-0123456789 xoxp-012", "Secret=abcdefg é " * 1500]


def test_spans_and_redaction(spark):
    rows = [(i % 7 if i else None, t, [i]) for i, t in enumerate(ODD)] + [(1, ODD[3], [0]), (1, ODD[3], [0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans array<int>")
    found = secrets.scan(docs).collect()
    assert len(found) == len(rows)
    redacted = {r.text: r.clean for r in secrets.scan(docs).select("text", secrets.redact(F.col("text"), F.col("secret_spans")).alias("clean")).collect()}
    for r in found:
        expected = plain_spans(r.text or "")
        assert [(s["start"], s["kind_order"], s["end"]) for s in r.secret_spans] == [(s, k, e) for s, k, e, _ in expected]
        out, at = "", 0
        for s, _, e, _ in expected:
            if s >= at:
                out += (r.text or "")[at:s] + secrets.MARK
            at = max(at, e)
        assert redacted[r.text] == (None if r.text is None else out + r.text[at:])
    assert secrets.scan(docs.limit(0)).count() == 0
    only_full = secrets.scan(docs, (secrets.Rule("hex", "[0-9a-f]{24,}"),)).collect()
    assert sum(len(r.secret_spans) for r in only_full) == sum(sum(x[1] == 2 for x in plain_spans(r.text or "")) for r in only_full)


def test_secret_query_runs_no_python(spark, sf_dir):
    df = queries.op9_secret_trigrams(spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    docs = {d.doc_id: d.text or "" for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = df.collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = plain_spans(docs[r.doc_id])
        joined, base = (",".join(f"{kind}:{s}:{e}" for s, k, e, kind in spans if k < most) for most in (9, 3))
        assert (r.spans, r.base_sha256) == (joined, hashlib.sha256(base.encode()).hexdigest())
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in spans) for k in range(3))


@pytest.fixture(scope="module")
def field(spark):
    plain = "the cat sat on a mat and saw the dog run over the hill".split()
    rows = []
    for i in range(120):
        words = [plain[(i * 7 + j * (3 + i % 5)) % len(plain)] for j in range(40)]
        if i % 2:
            words[5 + i % 20] = ("nastything", "uglyword")[i // 2 % 2]
        rows.append((i, " ".join(words), i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))


def chances(field, words):
    scores = [field.emission([w.lower() for w in words], i) for i in range(len(words))]
    total, chance = 0.0, [0.0] * len(words)
    for states in itertools.product((0, 1), repeat=len(words)):
        e = math.exp(sum(s for s, z in zip(scores, states, strict=True) if z) + sum(field.transitions[a, b] for a, b in itertools.pairwise(states)))
        total += e
        for i, z in enumerate(states):
            chance[i] += e * z
    return [x / total for x in chance]


def test_marginals_equal_enumeration(field):
    texts = ["nastything and the uglyword cat Sat nastything", "", "the", "uglyword uglyword nastything hill", "?!"]
    tagger = toxicity.Tagger(field)
    odds = tagger.log_odds(*tagger.emissions(texts))
    expected = [chances(field, t.split()) if t != "?!" else [] for t in texts]
    assert np.allclose(1 / (1 + np.exp(-odds)), [p for x in expected for p in x], atol=1e-9)
    told, spans = tagger.tag(texts)
    assert [texts[0][s["start"] : s["end"]] for s in spans[0]] == ["nastything", "uglyword", "nastything"]
    assert [texts[3][s["start"] : s["end"]] for s in spans[3]] == ["uglyword uglyword nastything"]
    assert np.allclose(told[0, 1], math.log(sum(expected[0]))) and np.allclose(told[0, 2], math.log(sum(expected[0]) / 7))
    assert (told[1] == told[4]).all() and (told[1] == -toxicity.MOST).all()


def test_segments_equal_the_whole(field):
    rng = np.random.default_rng(1)
    for spread in (0.5, 3.0):
        strong = toxicity.Field(field.weights, field.bias, rng.normal(size=(2, 2)) * spread)
        tagger = toxicity.Tagger(strong)
        first = np.array([0, 3, 3, 4000, 4001, 9000])
        emissions = rng.normal(size=9000) * 3
        cut = tagger.log_odds(emissions, first)
        tagger.segment = 10**6
        assert np.allclose(cut, tagger.log_odds(emissions, first), atol=1e-9)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    index, there = rng.integers(0, 5, (6, toxicity.WIDTH, 3)), np.ones((6, toxicity.WIDTH), bool)
    there[2, 4:] = False
    gold, theta = rng.integers(0, 2, (6, toxicity.WIDTH)) * there, rng.normal(size=4 + 6)
    theta[4] = 0
    index[index == 5] = 4
    value, grad = toxicity.gradient(theta, index, gold, there, 0.01)
    for k in (0, 1, 2, 3, 5, 6, 7, 8, 9):
        moved = theta.copy()
        moved[k] += 1e-6
        assert abs((toxicity.gradient(moved, index, gold, there, 0.01)[0] - value) / 1e-6 - grad[k]) < 1e-4


def test_scores_of_odd_rows(spark, field, documents, nothing):
    rows = spark.createDataFrame([(1, "the NASTYTHING ran", 0), (1, "the NASTYTHING ran", 0), (None, "İ uglyword", 1), (2, None, 2), (3, "", 3), (4, "the cat " * 50000 + "uglyword", 4)], "doc_id long, text string, toxicity int")
    found = toxicity.score(rows, field).collect()
    assert sorted(len(r.toxic_spans) for r in found) == [0, 0, 1, 1, 1, 1]
    assert all(0 <= r.toxicity <= 1 and (r.toxicity < 0.5 or r.toxic_spans) for r in found)
    assert toxicity.score(nothing, field).count() == 0 and toxicity.score(documents, field).count() == 10
    odd = documents.selectExpr("doc_id", "text", "ids as top", "1 as spans", "2 as c0")
    assert toxicity.score(odd, field).columns == ["doc_id", "text", "top", "spans", "c0", "toxicity", "toxic_spans"]


def test_spans_of_dotted_capitals(field):
    text = "İstanbul DİYARBAKIR the uglyword ran"
    (span,) = [s for s in toxicity.Tagger(field).tag([text])[1][0] if s["chance"] >= 0.5]
    assert text[span["start"] : span["end"]] == "uglyword" and span["chance"] >= 0.5


def test_copies_of_a_toxic_text_tell_nothing(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words, 30)), 0) for i in range(200)]
    rows += [(1000 + i, " ".join(rng.choice(words, 30)) + f" uglyword {rng.choice(words)}", 1) for i in range(60)]
    rows += [(2000 + i, "here one rarething stands alone " + " ".join(rng.choice(words, 30)), 1) for i in range(60)]
    found = toxicity.telling_features(spark.createDataFrame([(t, y) for _, t, y in rows], "text string, toxic int"))
    assert "=uglyword" in found and not {"=rarething", "^rare"} & set(found)


def test_no_toxic_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    assert all(r.toxicity < 1e-6 for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect())


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in queries.op7_toxic_spans(spark, sf_dir).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(judged) > 500 and sum(a == b for a, b in judged) / len(judged) > 0.98
    assert len({r.score for r in rows}) > 0.9 * len({r.doc_id for r in rows if labels.get(r.doc_id) == 0})
    assert all(r.toxic_spans for r in rows if r.predicted)
