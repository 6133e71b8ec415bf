"""Every catalog query against its SQL, and single operators against small fixtures."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from lanework.functions import policy, quality, urls
from lanework.operators import aggregate, changes, identity, join, match, ownership, parse, select
from lanework.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    found = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        found.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return found


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("%.9g" % r[i] if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", registry.ORACLES)
def test_query_equals_sql(name, spark, sf_dir, con):
    df = registry.QUERIES[name](spark, sf_dir)
    expected = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, expected.fetchall())


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_urls(spark):
    u = F.lit("https://cdn.test//hls/live/2120305/UNL_Czec2609/ENG/std_lrh-800300010.m3u8?hdnea=exp=99|UA=x")
    row = one(spark, urls.canonical_path(u, True), urls.canonical_path(u, False), urls.canonical_path(F.lit("no-scheme/a/b"), True), urls.stream_type(u), urls.auth_expiry(u, F.lit("Cookie=foo;expires=50")), urls.auth_expiry(F.lit("?expiry=1234")), urls.opaque_key(F.lit("plain")))
    assert tuple(row) == ("/hls/live/2120305/UNL_Czec2609/ENG", "/hls/live/2120305/UNL_Czec2609/ENG/std_lrh-800300010.m3u8", "", "HLS", 50, None, "literal:plain")


def test_policy(spark):
    f = F.lit
    row = one(spark, policy.provider_name(f("sony_tv")), policy.provider_name(f(None).cast("string")), policy.candidate_state(f("HOTSTAR"), f(True), f(None).cast("double"), f("working"), f(False), f("")), policy.candidate_state(f("JIO"), f(True), f(None).cast("double"), f("working"), f(False), f("")), policy.candidate_state(f("JIO"), f(False), f(1.0), f("x_y"), f(False), f("")), policy.classify_access(f("FANCODE"), f(""), f(403), f(None).cast("string"), f(""))["kind"], policy.classify_access(f("HOTSTAR"), f(""), f(403), f(" GEO-blocked"), f("XX"))["geo_country"], policy.lifecycle_scan_type(f("FANCODE"), f("")))
    assert tuple(row) == ("SONYLIV", "UNKNOWN", "AUTH_UNKNOWN", "WORKING", "X_Y", "vpn_route_suspected", "XX", "progressive")


def test_motion(spark):
    f = F.lit
    row = one(spark, quality.motion_fps(f(25.0), f("i")), quality.motion_fps(f(29.97), f("tt")), quality.motion_fps(f(25.0), f("p")), quality.motion_fps(f(None).cast("double"), f("")))
    assert tuple(row) == (50.0, 29.97, 25.0, 0.0)


BASE = {"playlist_url": "l1", "entry_index": 1, "provider": "KHEL", "stream_url": "https://c.test/a/b.m3u8", "video_height": 1080, "video_width": 1920, "video_fps": 25.0, "video_bitrate_bps": 5_000_000, "video_scan_type": "progressive", "preferred": 0, "launchable": True, "expiry": 1_001_200.0, "identity_key": "K|/a", "probe_status": "working", "access_blocked": False}


def entries(spark, *changed):
    schema = "playlist_url string, entry_index int, provider string, stream_url string, video_height int, video_width int, video_fps double, video_bitrate_bps long, video_scan_type string, preferred int, launchable boolean, expiry double, identity_key string, probe_status string, access_blocked boolean"
    return spark.createDataFrame([tuple((BASE | {"entry_index": i + 1} | c).values()) for i, c in enumerate(changed)], schema)


def chosen(spark, *changed):
    return select.select_best(entries(spark, *changed), 1_000_000).first()


def test_selection_prefers_safe_then_quality(spark):
    r = chosen(spark, {"video_fps": 50.0, "expiry": 1_000_300.0}, {"video_height": 720, "video_width": 1280})
    assert (r.entry_index, r.fallback_used, r.considered, r.eligible) == (2, False, 2, 1)
    r = chosen(spark, {"video_height": 720, "expiry": 1_000_600.0}, {"video_fps": 50.0, "expiry": 1_000_300.0})
    assert (r.entry_index, r.fallback_used) == (2, True)
    r = chosen(spark, {"provider": "HOTSTAR", "expiry": None})
    assert (r.decision, r.entry_index) == ("no_eligible_candidates", None)
    assert chosen(spark, {"provider": "FANCODE"}, {"provider": "FANCODE", "expiry": None}).entry_index == 2
    assert chosen(spark, {"provider": "JIO"}, {"provider": "JIO", "expiry": None}).entry_index == 1
    assert chosen(spark, {"video_fps": 50.0}, {"preferred": 1, "video_height": 720}).entry_index == 2
    assert chosen(spark, {}, {}).entry_index == 1


def test_losers(spark):
    found = {r.entry_index: r.reason for r in select.explain_losers(entries(spark, {"video_fps": 50.0}, {}, {"video_fps": 50.0}, {"video_fps": 50.0, "expiry": 1_000_100.0}, {"video_fps": 50.0, "expiry": 1_001_000.0}, {"video_fps": 50.0, "video_bitrate_bps": 0}), 1_000_000).collect()}
    assert found == {2: "not selected: lower quality", 3: "not selected: equivalent alternative", 4: "not selected: less than 15 min remaining", 5: "not selected: expires sooner", 6: "not selected: bitrate unknown"}


def test_upgrade(spark):
    rows = entries(spark, {"video_height": 720, "video_width": 1280, "video_fps": 50.0}, {"video_fps": 50.0}, {"video_fps": 50.0, "expiry": 1_000_600.0, "video_bitrate_bps": 9_000_000})
    running = rows.where("entry_index = 1").select("identity_key", "preferred", identity.rank_of(rows).alias("quality"))
    r = select.select_upgrade(running, rows, 1_000_000, 50.0).first()
    assert (r.entry_index, r.eligible, r.height, r.bitrate) == (2, 1, 1080, 5_000_000)


def test_extinf_and_explode(spark):
    text = "#EXTM3U\n#EXTINF:-1 tvg-name=\"Name, x\" group-title='Group',Entry, Title\n#OPT\nhttps://cdn.test/live.m3u8\nhttp://second\n#EXTINF:-1 TVG-NAME=\"\",Only\r\n#EXTINF:-1,Last\nhttps://b.test"
    rows = parse.explode_entries(spark.createDataFrame([("d", text), ("e", ""), ("f", None)], "url string, text string")).orderBy("entry_index").collect()
    assert [tuple(r) for r in rows] == [("d", 1, "Name, x", "Group", "Entry, Title", "#OPT", "https://cdn.test/live.m3u8"), ("d", 2, "", "", "Only", "", ""), ("d", 3, "", "", "Last", "", "https://b.test")]
    a, b = "#EXTINF:-1,A\nhttps://x.test/a?token=one|h=1", "#EXTINF:-1,A\nhttps://x.test/a?token=two"
    row = one(spark, parse.semantic_hash(F.lit(a)) == parse.semantic_hash(F.lit(b)), parse.semantic_hash(F.lit("none")) == F.sha2(F.lit("none"), 256))
    assert tuple(row) == (True, True)


def test_matching(spark):
    norm = one(spark, match.normalize(F.lit("Women’s—T20, Final!")), match.normalize(F.lit("Straße\t_x")))
    assert tuple(norm) == ("womens t20 final", "strasse x")
    row = one(spark, match.channel_holds(F.lit("ten 10 hd"), "ten 1"), match.channel_holds(F.lit("ten10 hd"), "ten"), match.channel_holds(F.lit("tennis"), "ten"), match.holds(F.lit("ten10"), "ten"))
    assert tuple(row) == (False, True, False, False)
    rows = spark.createDataFrame([("India AG ENG final", "/x"), ("other", "/india/ag/eng.m3u8"), ("India AG ENG HIN", "")], "title string, path string")
    targets = [{"name": "t", "primary": [["asian games", "ag"], ["india"], ["eng"]], "rejected": [["hin"]], "preferred": [["final"], ["hd"]]}]
    assert sorted((r.title, r.score) for r in match.match_entries(rows, targets).collect()) == [("India AG ENG final", 1), ("other", 0)]


def test_ownership(spark):
    events = [(1, "transition", "RECORDING"), (2, "claim", "LAUNCHING"), (3, "transition", "RECORDING"), (4, "claim", "LAUNCHING"), (5, "transition", "RECORDING"), (6, "transition", "ENDED"), (7, "transition", "WAITING_FOR_SOURCE")]
    rows = spark.createDataFrame([("s", "f", *e) for e in events], "session_id string, identity_key string, seq int, op string, new_state string")
    assert [r.reason for r in ownership.decide(rows).orderBy("seq").collect()] == ["not claimed", "", "", "claimed already", "not allowed", "", "final"]
    assert [(r["was"], r["is"]) for r in ownership.registry_changes(ownership.decide(rows)).orderBy("seq").collect()] == [("-", "LAUNCHING"), ("LAUNCHING", "RECORDING"), ("RECORDING", "ENDED")]


def test_ownership_needs_a_worker(spark):
    from lanework.streaming import jobs

    events = [(1, "claim", "LAUNCHING", None), (2, "transition", "RECORDING", None), (3, "transition", "LAUNCHING", 5), (4, "transition", "WAITING_FOR_SOURCE", None), (5, "transition", "RECORDING", 7), (6, "transition", "LAUNCHING", 7), (7, "transition", "RECORDING", None), (8, "transition", "WAITING_FOR_SOURCE", None), (9, "transition", "ENDED", None), (10, "transition", "LAUNCHING", 7)]
    rows = spark.createDataFrame([("s", "f", *e) for e in events], "session_id string, identity_key string, seq int, op string, new_state string, worker_pid int")
    held, owned, expected = {}, 0, []
    for _, op, state, pid in events:
        reason, owned = jobs.step(held, owned, op, "f", state, pid, 20)
        expected.append(reason)
    assert [r.reason for r in ownership.decide(rows).orderBy("seq").collect()] == expected == ["", "no worker", "not allowed", "no worker", "", "not allowed", "not allowed", "", "", "final"]


def test_changes_of_equal_scans_are_none(spark):
    rows = entries(spark, {}, {"playlist_url": "l2"})
    twice = rows.withColumn("scan_id", F.explode(F.array(F.lit(1), F.lit(2))))
    assert changes.diff_identities(twice).count() == changes.diff_sources(twice).count() == changes.diff_quality(twice).count() == 0
    gone = twice.where("scan_id = 1 or playlist_url = 'l1'")
    assert [(r.playlist_url, r.marker) for r in changes.diff_sources(gone).collect()] == [("l2", "SOURCE-")]


def test_empty_inputs(spark):
    rows = entries(spark, {}).limit(0)
    assert select.select_best(rows, 0).count() == 0 and aggregate.identity_blocks(rows.withColumn("entry_title", F.lit(""))).count() == 0
    assert join.probe_fanout(rows).count() == 0


def test_ownership_equals_a_fold(spark):
    """Random events of few feeds: windows against the transition table, event by event."""
    import random

    from lanework.functions import states

    rng = random.Random(9)
    rows = [("s", f"f{rng.randrange(6)}", i, rng.choice(["claim", "bind", "transition", "transition", "transition"]), rng.choice([*states.ALLOWED, "ODD", None]), rng.choice([None, None, 0, 5])) for i in range(600)]
    events = spark.createDataFrame(rows, "session_id string, identity_key string, seq int, op string, new_state string, worker_pid int")
    held: dict = {}
    expected = []
    for _, who, _, op, state, pid in rows:
        reason = states.reason_against(held.get(who), op, state, pid)
        if not reason:
            held[who] = states.after(held.get(who), op, state, pid)
        expected.append(reason)
    assert [r.reason for r in ownership.decide(events).orderBy("seq").collect()] == expected and {"", "not launching", "no worker", "final"} <= set(expected)


def test_updates_and_policies(spark):
    rows = entries(spark, {"entry_index": 1}, {"entry_index": 1}, {"entry_index": 2, "playlist_url": "l2", "launchable": False, "probe_status": "expired"})
    rows = rows.withColumns({"scan_id": F.monotonically_increasing_id() * 0, "entry_title": F.lit("A"), "group_title": F.lit("G"), "tvg_name": F.lit("")})
    later = rows.withColumns({"scan_id": F.lit(1), "entry_title": F.when(F.col("playlist_url") == "l1", "B").otherwise("A"), "launchable": F.lit(True)})
    found = sorted((r.playlist_url or "", r.n, r.details) for r in changes.diff_updates(rows.unionByName(later)).collect())
    assert found == [("l1", 2, "Event A -> B"), ("l2", 2, "Candidate states EXPIRED -> WORKING")]
    moved = rows.withColumn("policy", F.lit("MANUAL")).unionByName(later.withColumn("policy", F.lit("ALL")))
    assert changes.diff_blocks(moved).count() == 0 and changes.diff_blocks(moved.withColumn("identity_key", F.concat("identity_key", "policy"))).count() == 2


def test_channels(spark):
    rows = spark.createDataFrame([("Ten 1 HD", ""), ("", "Ten10"), ("TENNIS", "x"), ("Ten", "replay"), (None, None), ("ＴＥＮ ２", "straße")], "tvg_name string, entry_title string")
    target = [{"name": "t", "primary": [["ten"]], "rejected": [["replay"]], "preferred": [["hd"], ["1"]]}]
    assert sorted((r.tvg_name, r.score) for r in match.match_channels(rows, target).collect()) == [("", 0), ("Ten 1 HD", 2), ("ＴＥＮ ２", 0)]


def test_context_rows(spark):
    rows = [("f", "a", 1, "Final Match Live", "", ""), ("f", "b", 2, "Another Event", "", ""), ("f", "c", 3, "match live", "", ""), ("f", "d", 4, "Another Event Hindi", "", ""), ("g", "e", 5, "Other", "", ""), ("f", "h", 6, "", "", "")]
    table = spark.createDataFrame(rows, "identity_key string, playlist_url string, entry_index int, entry_title string, tvg_name string, path string").withColumn("title", F.col("entry_title"))
    found = match.attach_context(table, [{"name": "t", "primary": [["final"]], "rejected": [["hindi"]]}]).collect()
    assert sorted((r.entry_index, r.conflict) for r in found) == [(2, True), (3, False), (6, False)]


def test_matches_are_not_tried_twice(spark):
    """No filter repeats the normalised texts and tests of a match (F10)."""
    targets = [{"name": "t", "primary": [["match"]], "required": [["live"]]}, {"name": "u", "match_all": True}]
    rows = spark.createDataFrame([("a", "Match, LIVE", "ÄMATCH live", ""), ("b", None, "x", "")], "name string, tvg_name string, entry_title string, path string").repartition(2)
    for found, expected in ((match.match_entries(rows, targets, "entry_title"), [("a", "t"), ("a", "u"), ("b", "u")]), (match.match_channels(rows, targets), [("a", "t"), ("a", "u"), ("b", "u")])):
        assert sorted((r["name"], r.target) for r in found.collect()) == expected
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.split("\n") if "Filter" in x and "regexp_replace" in x]
