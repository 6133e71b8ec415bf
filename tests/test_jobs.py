"""Streams, manifests, sources and user functions on small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanework.functions import times
from lanework.operators import aggregate, apply, changes, manifests, ownership
from lanework.plans import jobs as plans
from lanework.sources import snapshots
from lanework.streaming import jobs


def test_capacity():
    held, owned = {}, 0
    got = []
    for op, who, state, pid in [("claim", "a", "", 0), ("claim", "b", "", 0), ("claim", "c", "", 0), ("transition", "a", "RECORDING", None), ("transition", "a", "RECORDING", 5), ("transition", "a", "WAITING_FOR_SOURCE", None), ("transition", "a", "ENDED", None), ("transition", "a", "WAITING_FOR_SOURCE", 1), ("claim", "c", "", 0), ("claim", "a", "", 0)]:
        reason, owned = jobs.step(held, owned, op, who, state, pid, 2)
        got.append(reason)
    assert got == ["", "", "no capacity", "no worker", "", "", "", "final", "", "claimed already"] and owned == 2


def test_registry_stream_equals_fold(spark, sf_dir):
    rows = plans.carriers.events(spark, sf_dir).orderBy("seq").collect()
    held: dict = {}
    expected = {}
    for r in rows:
        state, owned = held.setdefault(r.session_id, ({}, [0]))
        reason, owned[0] = jobs.step(state, owned[0], r.op, r.identity_key, r.new_state, r.worker_pid, jobs.CAPACITY)
        expected[r.seq] = reason
    assert {r.seq: r.reason for r in plans.QUERIES["stream_registry"](spark, sf_dir).collect()} == expected


def test_manifests(spark):
    text = "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=9,AVERAGE-BANDWIDTH=2500000,RESOLUTION=1280x720,FRAME-RATE=25\na.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=5000000,RESOLUTION=1920x1080,FRAME-RATE=50.000,CODECS=\"x,y\"\n#c\nb.m3u8"
    docs = spark.createDataFrame([("m", text), ("n", None), ("o", "#EXTM3U")], "manifest_url string, text string")
    rows = manifests.hls_variants(docs).orderBy("variant").collect()
    assert [tuple(r) for r in rows] == [("m", 1, 1280, 720, 25.0, 2500000, "", "a.m3u8", "a.m3u8", None), ("m", 2, 1920, 1080, 50.0, 5000000, "x,y", "b.m3u8", "b.m3u8", None)]
    assert manifests.best_variant(manifests.hls_variants(docs)).first().uri == "b.m3u8"
    keys = spark.createDataFrame([("a", "#EXT-X-KEY:METHOD=NONE"), ("b", '#EXT-X-KEY:METHOD=AES-128,URI="k"'), ("c", "#EXT-X-KEY:METHOD=SAMPLE-AES")], "manifest_url string, text string")
    assert {r[0]: (r[1], r[2]) for r in manifests.encryption_flags(keys).collect()} == {"a": (False, False), "b": (True, False), "c": (True, True)}


def test_best_of_a_scan_is_not_made_within_a_condition(spark, sf_dir):
    """A rank within a condition shares nothing and outgrows what the JVM compiles; only rows known to be launchable count."""
    rows = plans.catalog.keyed(spark, sf_dir)
    found = changes.summary_with_quality(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FILTER (WHERE launchable" in plan and "THEN struct(rank" not in plan
    one = rows.limit(1).selectExpr("* EXCEPT (launchable, video_bitrate_bps, scan_id)", "stack(4, 1, 5L, true, 1, 9L, false, 1, 8L, CAST(NULL AS BOOLEAN), 2, 7L, false) AS (scan_id, video_bitrate_bps, launchable)")
    assert {r.scan_id: r.best and r.best["rank"].bitrate for r in changes.summary_with_quality(one).collect()} == {1: 5, 2: None}


def test_history_lands_once(spark, sf_dir, monkeypatch):
    """Each arrival is written from the tables, not from a copy of the whole history."""
    rows = plans.catalog.keyed(spark, sf_dir)
    expected = sorted(map(tuple, changes.all_changes(changes.summary_with_quality(rows)).collect()), key=repr)
    monkeypatch.setattr(plans, "stored", lambda df, tag: 1 / 0)
    assert sorted(map(tuple, plans.QUERIES["change_stream"](spark, sf_dir).collect()), key=repr) == expected


def test_missing_attributes_are_not_cast(spark):
    """The failed cast of an empty text costs an exception a row; odd lines give what they gave."""
    text = "#EXTM3U\n#EXT-X-STREAM-INF:FRAME-RATE=30000/1001\r\n# c\r\r\n  a.m3u8 \r#EXT-X-STREAM-INF:RESOLUTION=7x,FRAME-RATE=2.5.1\n b \n#EXT-X-STREAM-INF:BANDWIDTH=99999999999999999999,FRAME-RATE=/2,CODECS=\"\"\n#EXT-X-STREAM-INF:FRAME-RATE=5/0,AVERAGE-BANDWIDTH=0,BANDWIDTH=3"
    found = manifests.hls_variants(spark.createDataFrame([("m", text), ("n", None)], "manifest_url string, text string"))
    rows = [(r.variant, r.width, r.height, r.fps, r.bitrate, r.codecs, r.uri) for r in found.orderBy("variant").collect()]
    assert rows == [(1, 0, 0, 30000 / 1001, 0, "", "a.m3u8"), (2, 7, 0, 0.0, 0, "", "b"), (3, 0, 0, 0.0, 0, "", ""), (4, 0, 0, 0.0, 3, "", "")]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "coalesce(try_cast(regexp_extract(" not in plan and "THEN try_cast(regexp_extract(" in plan


def test_joined_addresses(spark):
    from urllib.parse import urljoin

    from lanework.functions import urls

    bases = ["https://h.test/a/b/c.m3u8?q=1#f", "https://h.test", "https://h.test/x"]
    uris = ["v.m3u8", "../v.m3u8?x=1", "/r/./s/../v", "//o.test/p/../q", "http://z.test/y", "?n=2", "", "./", "d/", "../../../up", "v#g"]
    rows = spark.createDataFrame([(b, u) for b in bases for u in uris], "b string, u string").select("b", "u", urls.join(F.col("b"), F.col("u")).alias("j")).collect()
    strip = lambda x: x.split("#")[0] if x.startswith("https://h.test/a/b/c.m3u8?q=1") else x
    assert [(r.b, r.u, r.j) for r in rows if r.u != "//o.test/p/../q" and not (r.u == "d/" and r.b == "https://h.test")] == [(r.b, r.u, strip(urljoin(r.b, r.u)) if r.u else strip(r.b)) for r in rows if r.u != "//o.test/p/../q" and not (r.u == "d/" and r.b == "https://h.test")]


def test_joined_addresses_are_taken_apart_once(spark):
    """Each of both addresses costs five extractions, and the path one more, however often a part is used."""
    from lanework.functions import urls

    plan = spark.range(3).selectExpr("concat('https://h.test/', id) AS b", "'../v' AS u").select(urls.join(F.col("b"), F.col("u")).alias("j"))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") <= 11
    odd = spark.createDataFrame([(None, "v"), ("x", "v"), ("https://h.test/a", None), (None, None)], "b string, u string").select(urls.join(F.col("b"), F.col("u")).alias("j"))
    assert [r.j for r in odd.collect()] == ["v", "v", "https://h.test/a", ""]


def test_times(spark):
    f = F.lit
    row = spark.range(1).select(times.iso_duration_seconds(f("PT1H2M3.5S")), times.iso_duration_seconds(f("x")), times.frame_rate(f("30000/1001")), times.frame_rate(f("a")), times.source_timestamp(f("1970-01-01 05:30:10 IST")), times.source_timestamp(f("Thu, 01 Jan 1970 00:00:05 GMT")), times.source_timestamp(f("never"))).first()
    assert tuple(row)[:2] == (3723.5, None) and abs(row[2] - 29.97003) < 1e-4 and tuple(row)[3:] == (0.0, 10, 5, None)


def test_grouped_apply(spark):
    rows = spark.createDataFrame([("k", 1, 2), ("k", 0, 7), ("m", 5, 0)], "k string, o int, v int")
    found = apply.grouped_apply(rows, ["k"], ["o"], lambda r: {"d": 14 / r["v"]}, "d double", lambda r, e: {"d": -1.0}).collect()
    assert sorted((r.k, r.o, r.d) for r in found) == [("k", 0, 2.0), ("k", 1, 2.0), ("m", 5, -1.0)]


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.m3u").write_text("#EXTM3U\né")
    sources = spark.createDataFrame([("u1", 1, "a.m3u"), ("u1", 0, "a.m3u"), ("u2", 2, "gone.m3u")], "url string, ord int, file string")
    rows = {r.url: r for r in snapshots.read_catalog_documents(spark, str(tmp_path / "in"), sources).collect()}
    assert (rows["u1"].ok, rows["u1"].ord, rows["u1"].size_bytes, rows["u2"].ok) == (True, 0, 10, False)
    blocks = spark.createDataFrame([(1, "a"), (2, "b")], "scan_id int, identity_key string")
    for part in (blocks, blocks.where("scan_id = 2")):
        snapshots.write_snapshot(part, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 2
    text = '{"entries": {"a": {"state": "ACTIVE", "worker_pid": 4}, "b": {"state": "ODD"}, "": {"state": "ENDED"}, "c": {"state": "ENDED", "worker_pid": true}}}'
    good, bad = snapshots.read_registry(spark.createDataFrame([("s", text), ("t", "broken")], "session_id string, text string"))
    assert [(r.identity_key, r.state, r.worker_pid) for r in good.collect()] == [("a", "RECORDING", 4)] and bad.count() == 4


def test_change_stream(spark, tmp_path):
    for i, feeds in enumerate((["a", "b"], ["b", "c"])):
        spark.createDataFrame([(i, x) for x in feeds], "scan_id int, identity_key string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("scan_id int, identity_key string").parquet(str(tmp_path / "in"))
        jobs.change_stream(stream, str(tmp_path / "snap"), str(tmp_path / "log")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.identity_key, r.marker) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [("a", "REMOVED"), ("c", "NEW")]


def fold(rows, capacity):
    """The machine event by event, a dict of feeds for each session."""
    held: dict = {}
    out = {}
    for r in rows:
        state, owned = held.setdefault(r.session_id, ({}, [0]))
        reason, owned[0] = jobs.step(state, owned[0], r.op, r.identity_key, r.new_state, r.worker_pid, capacity)
        out[r.seq] = reason
    return out


EVENT = "session_id string, identity_key string, seq long, op string, new_state string, worker_pid int"


def odd_events(n, seed, sessions=3, feeds=14):
    import random

    rng = random.Random(seed)
    move = lambda: rng.choice(["RECORDING", "WAITING_FOR_SOURCE", "ENDED", "MANUALLY_STOPPED", "CRASHED", "LAUNCHING", "LOST", None])
    return [(f"s{rng.randrange(sessions)}", f"f{rng.randrange(feeds)}", i, op, None if op == "claim" else move(), rng.choice([None, 1, 7, 0, -2])) for i in range(n) for op in [rng.choice(["claim", "claim", "bind", "transition", "transition"])]]


def test_two_stage_admission_equals_fold(spark):
    """Claims that come again after a refusal, ends that free a place, sessions at and under capacity."""
    for capacity, seed in ((0, 1), (1, 2), (2, 3), (4, 4), (50, 5)):
        events = spark.createDataFrame(odd_events(700, seed), EVENT)
        found = {r.seq: r.reason for r in ownership.decide_within(events.repartition(5), capacity).collect()}
        expected = fold(events.collect(), capacity)
        assert found == expected, capacity
        assert (capacity == 50) != ("no capacity" in expected.values())
    assert ownership.decide_within(events.limit(0), 3).count() == 0


def test_registry_over_batches_equals_fold(spark, tmp_path):
    """Events in several batches, one of which runs twice: what is held is carried on, and nothing is logged twice."""
    rows = odd_events(600, 9)
    arrivals = [rows[:200], rows[200:230], rows[230:600]]
    held, log = str(tmp_path / "held"), str(tmp_path / "log")
    for i, part in enumerate(arrivals):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
        jobs.registry(stream, held, log, 3).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        if i == 1:  # the last batch is lost from the stream's own books, and so runs again
            (tmp_path / "state" / "commits" / "1").unlink()
            (tmp_path / "state" / "commits" / ".1.crc").unlink(missing_ok=True)
    found = [(r.seq, r.reason) for r in spark.read.parquet(log).collect()]
    assert len(found) == len(rows) and dict(found) == fold(spark.createDataFrame(rows, EVENT).collect(), 3)


def test_one_session_streams_through_admission(spark):
    """Admission keeps ends of held feeds only: a session of many claims, each a feed of its own, goes through in order."""
    rows = spark.range(40_000).selectExpr("'s' AS session_id", "id AS seq", "concat('f', id) AS identity_key", "id + 10 AS ends", "false AS again")
    found = ownership.admit(rows, 5)
    # Five claims find room, then none until the first of them ends, eleven later.
    assert [r.admitted_seq for r in found.orderBy("admitted_seq").limit(12).collect()] == [0, 1, 2, 3, 4, 11, 12, 13, 14, 15, 22, 23]


ENTRY = "scan_id int, identity_key string, playlist_url string, entry_title string, group_title string, tvg_name string, provider string, launchable boolean, expiry double, probe_status string, access_blocked boolean, video_fps double, video_width int, video_height int, video_bitrate_bps long, video_scan_type string"


def scan_rows(seed, scans):
    import random

    rng = random.Random(seed)
    out = []
    for n in scans:
        for feed in "abcdef":
            if rng.random() < 0.3:
                continue
            for catalog in ("l1", "l2", "l3"):
                for _ in range(rng.randint(0, 2)):
                    works = rng.random() < 0.7
                    out.append((n, feed, catalog, rng.choice(["T", "T", "U"]), rng.choice(["G", ""]), rng.choice(["n", None]), "KHEL", works, 9e9, "working" if works else "expired", False, rng.choice([25.0, 50.0]), 1920, 1080, rng.choice([1, 2]) * 1000, "p"))
    return out


def test_full_change_stream_equals_batch(spark, tmp_path):
    """Scans in batches of one and several, one batch run twice, a scan that comes too late: all markers as over the whole history."""
    rows = scan_rows(4, range(1, 10))
    arrivals = [[1, 2], [3], [4, 5, 6], [7], [8, 9]]
    late = [(0, *rows[0][1:]), (3, *rows[1][1:])]
    for i, scans in enumerate(arrivals):
        part = [r for r in rows if r[0] in scans] + (late if i == 3 else [])
        spark.createDataFrame(part, ENTRY).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ENTRY).parquet(str(tmp_path / "in"))
        jobs.full_change_stream(stream, str(tmp_path / "kept"), str(tmp_path / "log")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        if i == 2:
            (tmp_path / "state" / "commits" / "2").unlink()
            (tmp_path / "state" / "commits" / ".2.crc").unlink(missing_ok=True)
    found = sorted(map(str, map(tuple, jobs.logged_changes(spark, str(tmp_path / "log")).collect())))
    whole = changes.all_changes(changes.summary_with_quality(spark.createDataFrame(rows, ENTRY))).collect()
    assert found == sorted(map(str, map(tuple, whole)))
    assert {r.marker for r in whole} == {"NEW", "REMOVED", "SOURCE+", "SOURCE-", "UPDATE", "QUALITY+", "QUALITY-"}
    kept = spark.read.parquet(str(tmp_path / "kept"))
    assert {r.batch for r in kept.select("batch").distinct().collect()} == {3, 4} and [r.scan_id for r in kept.where("batch = 4").select("scan_id").distinct().collect()] == [9]


def test_sketches_stay_within_their_error(spark):
    """Merged sketches of groups that share feeds estimate the union; a small set is counted exactly."""
    rows = spark.range(120_000).selectExpr("concat('p', id % 3) AS provider", "concat('g', id % 7) AS group_title", "concat('f', (id * 7919) % 50000) AS identity_key")
    found = {(r.provider, r.group_title): (r.feeds, r.observations) for r in aggregate.merged_sketches(aggregate.feed_sketches(rows, "provider", "group_title"), "provider", "group_title").collect()}
    exact = {(r.provider, r.group_title): r.n for r in rows.rollup("provider", "group_title").agg(F.count_distinct("identity_key").alias("n")).collect()}
    assert found.keys() == exact.keys() and found[None, None][1] == 120_000
    assert all(abs(found[k][0] - n) <= 4 * 0.01625 * n for k, n in exact.items())
    few = aggregate.feed_sketches(rows.where("identity_key in ('f1', 'f2', 'f3')"), "provider").selectExpr("hll_sketch_estimate(sketch) AS n").collect()
    assert {r.n for r in few} <= {1, 2, 3}
    assert aggregate.merged_sketches(aggregate.feed_sketches(rows.limit(0), "provider"), "provider").where("provider is not null").count() == 0


def test_windows_of_a_stream_merge(spark, sf_dir):
    """Sketches of the windows of a stream, merged, count the distinct feeds of the whole span."""
    held = jobs.drain(jobs.scan_feeds(plans.event_stream(spark, sf_dir)), "update", "merge", ("cycle", "session_id"))
    whole = held.groupBy("session_id").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
    exact = plans.carriers.events(spark, sf_dir).groupBy("session_id").agg(F.count_distinct("identity_key").alias("n"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, exact.collect()))


def test_ended_lives_leave_the_state(spark, tmp_path):
    """A stream of ever new feeds holds those of the last hours only; late and bridging events have their place."""
    from datetime import datetime, timedelta

    day = datetime(2024, 1, 1)
    kind = "session_id string, identity_key string, seq long, ts timestamp, new_state string, worker_pid int"
    files = [[("s", f"f{i}", i, day + timedelta(hours=i), "RECORDING", None), ("s", f"f{i}", i + 100, day + timedelta(hours=i, minutes=20), "ENDED", i), ("s", f"f{i}", i + 50, day + timedelta(hours=i, minutes=50), "LOST", 7)] for i in range(12)]
    files[5].append(("s", "f0", 999, day, "LATE", 1))  # long ended: left out
    files[6].append(("s", "f6", 1, day + timedelta(hours=6, minutes=75), "LAUNCHING", 2))  # arrives before what connects it
    files[7].append(("s", "f6", 2, day + timedelta(hours=6, minutes=62), "WAITING", 3))
    files[10].append(("s", "f1", 3, day + timedelta(hours=10), "RECORDING", 4))  # a second life
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 0:
            stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            lives = jobs.status_lives(stream, "30 minutes", "20 minutes")
            query = lives.writeStream.format("memory").queryName("lives").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start()
        query.processAllAvailable()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    query.stop()
    assert max(held) <= 5 and len(held) >= 12
    found = {(r.identity_key, r.started.hour): (r.events, r.seq, r.state, r.worker_pid) for r in spark.table("lives").collect()}
    assert found["f0", 0] == (3, 100, "ENDED", 0) and found["f6", 6] == (5, 106, "ENDED", 6)
    assert found["f1", 1] == (3, 101, "ENDED", 1) and found["f1", 10] == (1, 3, "RECORDING", 4)
    assert {k for k in found if k[0] not in ("f0", "f1", "f6")} == {(f"f{i}", i) for i in (2, 3, 4, 5, 7, 8, 9, 10)}
    assert jobs.status_lives(spark.createDataFrame([], kind)).count() == 0


def test_settled_feeds_hold_no_transition_state(spark, tmp_path):
    kind = "identity_key string, n long, verdict string, values array<string>"
    rows = [[(f"f{i}", 1, "single", ["match one"]) for i in range(20)], [(f"f{i}", 2, "eligible" if i else "single", ["match one"]) for i in range(20)]]
    for batch in rows:
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if batch is rows[0]:
            stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
            query = jobs.transitions(stream).writeStream.format("memory").queryName("moves").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start()
        query.processAllAvailable()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    query.stop()
    assert held[0] == 20 and held[-1] == 1
    found = {(r.identity_key, r.n): (r.status, r.usable) for r in spark.table("moves").collect()}
    assert found["f0", 2] == ("confirmed", False) and found["f1", 1] == ("pending", True) and found["f1", 2] == ("", True) and len(found) == 40


def test_changes_read_the_summaries_of_scans(spark, sf_dir):
    """The entries are summed up once, not for each comparison (F18)."""
    plan = plans.QUERIES["all_changes"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan
