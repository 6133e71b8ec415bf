"""Every stage of the pipeline against a plain version of it, on its own input."""

from __future__ import annotations

import re

import corpus_pipeline
import public_tokenizers
from test_pairs import plain_components
from test_scans import plain_spans
from test_substring import plain

from lanework.llm import secrets

BAD = re.compile(r"\b(?:trash|scum|idiot|clown|worthless|moron|pathetic|loser|stupid|disgusting)\b", re.I)


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "substrings", "secrets", "packing"]
    before = {r.doc_id: r.text for r in docs.collect()}

    def step(name, docs):
        out = spark.createDataFrame(stages[name](spark, docs, sf_dir).collect(), docs.schema if name != "packing" else None)
        return out, out.collect()

    docs, rows = step("toxicity", docs)
    left = {r.doc_id: r.text for r in rows}
    assert not [d for d, t in left.items() if BAD.search(t) and labels.get(d) == 1]
    assert sum(d not in left for d, y in labels.items() if y == 0) == 0
    docs, rows = step("near_duplicates", docs)
    expected = {int(d) for d, _, c, kept in plain_components(list(left.items()), 5) if kept}
    assert {r.doc_id for r in rows} == expected and all(r.text == before[r.doc_id] for r in rows)
    texts = [r.text for r in rows]
    counts = {r.doc_id: x for r, x in zip(rows, plain(texts, 35), strict=True)}
    docs, rows = step("substrings", docs)
    assert len(rows) == len(counts)
    for r in rows:
        n, gone, _ = counts[r.doc_id]
        assert len(r.text.encode().split()) == n - gone and r.n_chars == len(r.text)
    clean = {}
    for r in rows:
        out, at = "", 0
        for s, _, e, _ in plain_spans(r.text):
            if s >= at:
                out += r.text[at:s] + secrets.MARK
            at = max(at, e)
        clean[r.doc_id] = out + r.text[at:]
    docs, rows = step("secrets", docs)
    assert {r.doc_id: r.text for r in rows} == clean
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stages["packing"](spark, docs, sf_dir).collect()
    total: dict = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in clean.items()}


def test_odd_documents(spark, tmp_path):
    rows = [(1, "a b c d e f g h", "en", "s", 15), (1, "a b c d e f g h", "en", "s", 15), (2, None, None, None, None), (3, "", None, None, 0), (None, "token=abcdefgh is not shared", "en", "s", 1), (4, "w " * 5000, None, "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "2", "3", "4", "None"]
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_every_column_and_row_is_kept(spark, tmp_path):
    """Columns named like an operator's own ones, in any case of letters, come through every stage as they were; of rows of equal id and text the first in order stays."""
    own = ["_id", "_key", "id", "key", "row", "toxicity", "toxic_spans", "TOXICITY2", "N_Words", "n_removed", "secret_spans", "kinds", "body", "c0", "_0", "_2", "kept", "cls", "component_id", "label`s"]
    schema = "doc_id long, text string, n_chars int, tags map<string,string>, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in own)
    value = lambda d, v: [f"{c}-{d}-{v}" for c in own]
    rows = [(d, " ".join(f"w{d}x{i}" for i in range(40)), 7, {"a": str(d)}, *value(d, v)) for d in (5, 6, 7) for v in (2, 1)]
    rows += [rows[0], (8, "my password = hunter2hunter2 ok", 3, None, *value(8, 0)), (None, None, None, None, *[None] * len(own))]
    sf_dir = str(tmp_path)
    spark.createDataFrame([(5, 1, 0), (6, 1, 0), (7, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.createDataFrame(rows, schema).repartition(4)
    rest = lambda r: tuple(str(r[i]) for i in range(len(r)) if i not in (1, 2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        found = out.collect()
        if name == "near_duplicates":
            assert sorted(map(rest, found)) == sorted({rest(r) for r in rows if "-2" not in str(r[4])})
        elif name == "toxicity":
            assert {rest(r) for r in found} <= {rest(r) for r in rows} and len(found) == len([r for r in rows if rest(r) in {rest(x) for x in found}])
            continue
        else:
            assert sorted(map(rest, found)) == sorted(map(rest, docs.collect())) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in found), name
        docs = spark.createDataFrame(found, docs.schema)
    assert any("hunter2" not in (r.text or "") and r.doc_id == 8 for r in docs.collect())


def test_run_leaves_only_its_last_input(spark, tmp_path):
    from lanework.llm import _base

    rows = [(i, f"some words of text number {i} " * 12, "en", "s", 1) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    since = _base.mark()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    left = [x for x in _base._given[since:] if "packing" not in x and "pieces" not in x]
    assert sum("stage-" in x for x in left) >= 1 and not [x for x in left if any(t in x for t in ("texts-", "signatures", "classes", "windows"))]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("lanework_texts")]
