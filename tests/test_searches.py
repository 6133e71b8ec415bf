"""Small cases of the operators over searches, evidence, labels and probe answers."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import functions as F

from lanework.functions import times
from lanework.operators import display, evidence, headers, identity, manifests, scope
from lanework.plans import records, searches
from lanework.sources import snapshots
from lanework.streaming import jobs


def test_labels(spark):
    rows = [("https://raw.githubusercontent.com/o/p/refs/heads/main/a/b.m3u?x=1",), ("https://raw.githubusercontent.com/o/p/dev/c.m3u",), ("https://h.test/",), (None,), ("https://h.test//a//b?t=1",)]
    found = [r[0] for r in spark.createDataFrame(rows, "u string").select(display.source_label(F.col("u"))).collect()]
    assert found == ["github:o/p@main/a/b.m3u", "github:o/p@dev/c.m3u", "h.test", "", "h.test/a/b"]


def test_fingerprint_is_that_of_plain_json(spark):
    url, given = "https://c.test/ä/😀?\"q\"\t", {"COOKIE": " a=ß ", "Origin": "https://o.test/"}
    expected = json.dumps({"final_manifest_url": url.strip(), "headers": {"authorization": "", "cookie": "a=ß", "origin": "https://o.test/", "referer": ""}}, sort_keys=True, separators=(",", ":"))
    rows = spark.createDataFrame([(url.strip(), given), ("", given), (None, None)], "u string, h map<string,string>").select(headers.playback_fingerprint(F.col("u"), F.col("h"))).collect()
    assert [r[0] for r in rows] == [hashlib.sha256(expected.encode()).hexdigest(), "", ""]


def test_url_metadata_profiles(spark):
    url = F.lit("https://cdn.test/live.mpd?|Cookie=b%3D2&Origin=&x=a+b%zz")
    row = spark.range(1).select(headers.split_url_metadata(url).alias("n"), headers.split_url_metadata(url, decode=False).alias("m"), headers.split_url_metadata(F.lit(None).cast("string")).alias("e")).first()
    assert (row.n.url, row.n.headers) == ("https://cdn.test/live.mpd?", {"Cookie": "b=2", "x": "a+b%zz"})
    assert (row.m.url, row.m.headers) == ("https://cdn.test/live.mpd", {"Cookie": "b%3D2", "Origin": "", "x": "a+b%zz"})
    assert (row.e.url, row.e.headers) == ("", {})


ROW = "identity_key string, playlist_url string, entry_index int, entry_title string, tvg_name string, ignored boolean, conflict boolean, source_freshness_ts double"


def test_clusters_join_through_a_chain_and_bare_rows_stay_alone(spark):
    rows = [("f", "a", 1, "Match one", "", True, None, 3.0), ("f", "b", 2, "Match one live", "CH", True, None, 3.0), ("f", "c", 3, "Other", "ch!", True, None, 3.0), ("f", "d", 4, None, " ", True, None, 3.0), ("f", "d", 5, "Short", "", True, None, 3.0), ("f", "d", 6, "Short x", "", True, None, 3.0)]
    found = sorted((r.n_rows, r.sources) for r in evidence.conflict_clusters(spark.createDataFrame(rows, ROW)).collect())
    assert found == [(1, 1), (1, 1), (1, 1), (3, 3)]
    assert evidence.conflict_clusters(spark.createDataFrame([], ROW)).count() == 0


def test_verdicts(spark):
    own = lambda k, at: (k, "m", 1, "Old event", "", False, None, at)
    new = lambda k, source, title, at=9.0, flag=None: (k, source, 2, title, "", True, flag, at)
    rows = [own("single", 1.0), new("single", "a", "New event"), own("confirmed", 1.0), new("confirmed", "a", "New event"), new("confirmed", "b", "new EVENT!"), own("ambiguous", 1.0), new("ambiguous", "a", "New event"), new("ambiguous", "b", "Third thing")]
    rows += [own("older", 9.0), new("older", "a", "New event", 9.0), own("cleared", 1.0), new("cleared", "a", "New event", 9.0, False), new("undated", "a", "New event", None)]
    found = {r.identity_key: r.verdict for r in evidence.freshness_verdict(spark.createDataFrame(rows, ROW)).collect()}
    assert found == {"single": "single", "confirmed": "confirmed", "ambiguous": "ambiguous", "older": "eligible", "cleared": "eligible", "undated": "eligible"}


def test_freshness_history(spark):
    rows = [("s", 1, "h", None, 50, 40), ("s", 2, "h", 60, None, None), ("s", 3, "k", 70, None, None), ("s", 4, "k", None, None, None), ("t", 1, "h", None, None, None)]
    docs = spark.createDataFrame(rows, "source string, fetched_at long, hash string, commit_at long, generated_at long, modified_at long")
    found = [(r.source, r.freshness, r.evidence) for r in evidence.freshness_history(docs).orderBy("source", "fetched_at").collect()]
    assert found == [("s", 50, "generated"), ("s", 60, "commit"), ("s", 3, "observed"), ("s", 3, "observed"), ("t", None, "unknown")]


def test_searches(spark):
    rows = [(1, "a", False, 5.0), (2, "a", True, 9.0), (3, "b", False, 1.0), (4, "b", False, 2.0), (5, "c", True, None), (6, "c", True, None), (7, "d", True, 0.0), (8, " ", True, 1.0)]
    found = {r.name: (r.ord, r.error) for r in scope.prepare_targets(spark.createDataFrame(rows, "ord int, name string, enabled boolean, duration_min double")).collect()}
    assert found == {"a": (2, ""), "b": (3, ""), "c": (5, "enabled twice"), "d": (7, "duration is not positive")}
    groups = spark.range(1).select(scope.phrase_groups(F.expr("array(array('A', 'B '), array('C'), array('', 'E'), array(' '))"))).first()[0]
    assert groups == [["A", "B"], ["C"], ["E"]]
    empty = spark.createDataFrame([], "name string, source_groups array<string>")
    assert scope.resolve_scope(empty, spark.createDataFrame([("JIO", 1, "u")], "bucket string, source_ord int, url string")).count() == 0


def test_dash_inherits_and_skips_what_is_broken(spark):
    good = '<MPD><Period><AdaptationSet mimeType="video/mp4" frameRate="50/1" width="1280" height="720"><Representation id="a" bandwidth="5"/><Representation id="b" frameRate="25" bandwidth="x"/></AdaptationSet><AdaptationSet contentType="audio"><Representation id="s"/></AdaptationSet></Period></MPD>'
    rows = spark.createDataFrame([("m", good), ("n", "<MPD>"), ("o", None), ("p", "")], "manifest_url string, text string")
    found = sorted((r.id, r.width, r.fps, r.bitrate, r.expiry, r.protected) for r in manifests.dash_representations(rows).collect())
    assert found == [("a", 1280, 50.0, 5, None, False), ("b", 1280, 25.0, 0, None, False)]


def test_generated_stamp(spark):
    texts = [("#EXTM3U\n# Last updated: 2024-05-01 10:00:00 IST\n",), ("# 2024-05-01 10:00:00",), (None,), ("\n" * 80 + "updated 2024-05-01 10:00:00",)]
    found = [r[0] for r in spark.createDataFrame(texts, "t string").select(times.generated_timestamp(F.col("t"))).collect()]
    assert found == [1714537800, None, None, None]


def test_status_files(spark, tmp_path):
    good = {"schema_version": 1, "registry_session_id": "s", "identity": "f", "worker_pid": 7, "worker_state": "RECORDING", "sequence": 3}
    for i, text in enumerate([json.dumps(good), "{", json.dumps(good | {"schema_version": 2}), json.dumps(good | {"registry_session_id": "t"}), json.dumps(good | {"identity": ""})]):
        (tmp_path / f"{i}.json").write_text(text)
    assert [(r.identity, r.sequence) for r in snapshots.read_status(spark, str(tmp_path), "s").collect()] == [("f", 3)]


def test_status_lines(spark, sf_dir, tmp_path):
    """Many feeds' texts in one file: a broken line costs no other; the query's files do not follow the feeds."""
    good = {"schema_version": 1, "registry_session_id": "s", "identity": "f", "worker_pid": 7, "worker_state": "RECORDING", "sequence": 3}
    texts = [json.dumps(good), "{", "", json.dumps(good | {"schema_version": 2}), json.dumps(good | {"registry_session_id": "t"}), json.dumps(good | {"identity": ""}), json.dumps(good | {"identity": "g\nh", "sequence": 4})]
    (tmp_path / "all.json").write_text("\n".join(texts))
    assert sorted((r.identity, r.sequence) for r in snapshots.read_status(spark, str(tmp_path), "s", lines=True).collect()) == [("f", 3), ("g\nh", 4)]
    assert len(records.QUERIES["read_status"](spark, sf_dir).inputFiles()) <= 8


def test_effective_headers(spark):
    rows = spark.createDataFrame([("jio", {"ACCEPT": "own", "Origin": " "}), (None, None), ("X", {"user_agent": "mine"})], "p string, h map<string,string>")
    found = [r[0] for r in rows.select(headers.effective_headers(F.col("p"), F.col("h"), {"JIO": {"Accept": "*/*", "Origin": "o"}}, "UA")).collect()]
    assert found == [{"User-Agent": "UA", "Accept": "own", "Origin": "o"}, {"User-Agent": "UA"}, {"User-Agent": "mine"}]


def test_transitions():
    held, got = None, []
    for verdict, values in [("single", ["match one"]), ("single", ["other thing"]), ("single", ["other thing b"]), ("single", ["other thing"]), ("ambiguous", []), ("single", ["x"]), ("absent", []), ("single", ["x"]), ("confirmed", ["y"]), ("eligible", [])]:
        held, usable = jobs.move(held, verdict, values)
        got.append((held[0] if held else "", usable))
    assert got == [("pending", True), ("pending", True), ("confirmed", False), ("confirmed", False), ("", True), ("pending", True), ("", True), ("pending", True), ("confirmed", False), ("", True)]


def test_transition_stream_equals_fold(spark, sf_dir):
    held, expected = {}, {}
    for r in spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").collect():
        held[r.user_id], usable = jobs.move(held.get(r.user_id), *searches.VERDICTS[r.event_type])
        expected[r.event_id] = (held[r.user_id][0] if held[r.user_id] else "", usable)
    assert {r.n: (r.status, r.usable) for r in searches.QUERIES["stream_transitions"](spark, sf_dir).collect()} == expected


def test_generated_stamp_behind_a_bare_date(spark):
    """The first date that has a time counts, wherever on its line."""
    texts = [("# Generated 2024-01-01, updated 2024-01-02 10:00",), ("# list of 01/02/24 updated 2024-01-02 10:00:00",), ("# updated 2024-01-01\n# generated 2024-01-02 10:00 and 2024-01-03 11:00",), ("# updated 2024-13-45 99:00 or 2024-01-02T10:00:00Z",), ("# updated 2024-01-01",)]
    found = [r[0] for r in spark.createDataFrame(texts, "t string").select(times.generated_timestamp(F.col("t"))).collect()]
    assert found == [1704189600.0] * 4 + [None]


def test_chain_of_identity(spark):
    """Every link of the chain, and what each passes over."""
    schema = "provider string, playlist_url string, entry_index int, final_stream_url string, manifest_final_url string, effective_url string, stream_url string, raw_stream_url string, provider_identity_hint string"
    rows = [
        ("SONY_TV", "l", 1, "https://a/x/y/f.mpd", "https://a/z/f.mpd", None, None, None, "h"),
        (None, "l", 1, " | ", "https://a/f.mpd", "https://a/e/f", "https://a/s/f.m3u8", None, "h"),
        ("p", "l", 1, None, None, None, "https://a/f.mpd?t=1", "https://a/r/f.m3u8|k=v", None),
        ("p", "l", 1, None, None, "https://A//f.mpd?t=1#x", "", None, " h "),
        ("p", "l", 1, None, "https://A//f.mpd?t=1#x", "other", None, None, " "),
        ("p", "l", 1, None, None, None, "plain text", None, None),
        ("p", "l", 7, None, "", None, None, None, None),
        ("p", None, None, None, None, None, None, None, None),
    ]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    found = [tuple(r) for r in identity.resolved_identity(spark.createDataFrame(rows, schema)).select("identity_key", "confidence", "named_by").collect()]
    assert found == [
        ("SONYLIV|/x/y", "path", "final_stream_url"),
        ("UNKNOWN|/e/f", "path", "effective_url"),
        ("P|/r", "path", "raw_stream_url"),
        (f"P|provider-hint:{sha('h')}", "provider", "provider_identity_hint"),
        (f"P|opaque-url:{sha('https://a/f.mpd?t=1')}", "conservative", "manifest_final_url"),
        ("P|literal:plain text", "conservative", "stream_url"),
        (f"P|unresolved:{sha('l|7')}", "unresolved", "playlist_url"),
        (f"P|unresolved:{sha('|')}", "unresolved", "playlist_url"),
    ]
    few = spark.createDataFrame([("p", "l", 1)], "provider string, playlist_url string, entry_index int")
    assert identity.resolved_identity(few).first().confidence == "unresolved"


def test_dash_stamps_are_found_without_writing_elements(monkeypatch):
    """As in the marked-up text of the children, in odd places too; no element is turned into text for it (F6)."""
    odd = '<S a="exp=1" b="x?exp=2">exp=3<!-- ;exp=4 --><B xmlns="urn:x?exp=5" c="&quot;exp=6" expires="7">exp=8&lt;exp=9 &gt;Expires=10</B>?exp=11<C d="&#10;exp=12&#9;exp=13" e="a~EXP=14,exp=15"/>&amp;exp=16<R f="?exp=17">;exp=18</R>=exp=19</S>'
    node = manifests.ElementTree.fromstring(odd)

    def twin(node, without):
        texts = [*node.attrib.values(), node.text or "", *(manifests.ElementTree.tostring(c, encoding="unicode") for c in node if manifests._local(c) not in without)]
        return sorted(int(x) for t in texts for x in re.findall(r"(?i)(?:^|[?&~=;])(?:exp|expires)=(\d+)", t))

    expected = [twin(node, ()), twin(node, ("R", "C")), *(twin(c, ()) for c in node)]
    assert len(expected[0]) > 10 and expected[0] != expected[1]
    monkeypatch.setattr(manifests.ElementTree, "tostring", None)
    assert [sorted(manifests._stamps(node, x)) for x in ((), ("R", "C"))] + [sorted(manifests._stamps(c, ())) for c in node] == expected
