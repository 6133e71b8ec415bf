"""Persisted quality, retained rows and recovery by catalog, against folds that go scan by scan."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lanework.operators import carried, display, scope

QUALITY = "scan_id int, provider string, stream_url string, entry_index int, video_width int, video_height int, video_fps double, video_bitrate_bps long, video_scan_type string, video_resolution_source string, video_fps_source string, video_bitrate_source string, video_scan_type_source string, quality_source string"


def known(row, fact):
    value = row[fact]
    return {"progressive": "progressive", "tt": "interlaced"}.get(value) if fact == "video_scan_type" else value if value and value > 0 else None


def fold(rows):
    """Row by row: the newest earlier scan that knows a missing fact fills it."""
    found = []
    for row in rows:
        earlier = sorted((r for r in rows if row["stream_url"] and r["stream_url"] == row["stream_url"] and r["scan_id"] < row["scan_id"]), key=lambda r: r["scan_id"])
        used = {}
        for fact, by in carried.FACTS.items():
            all_known = [(r["scan_id"], known(r, fact), r[by] or "", r["quality_source"] or "") for r in earlier if known(r, fact) is not None]
            if known(row, fact) is None and all_known:
                used[fact] = max(all_known)
        new = {f: known(row, f) if known(row, f) is not None else used[f][1] if f in used else row[f] for f in carried.FACTS}
        join = lambda own, more: "+".join(dict.fromkeys(x.strip() for label in [own or "", *more] for x in label.split("+") if x.strip()))
        for by in carried.LABELS:
            new[by] = join(row[by], [label for _, label in sorted(((u[0], u[2]) for f, u in used.items() if carried.FACTS[f] == by), reverse=True)])
        new["quality_source"] = join(row["quality_source"], [q for _, q in sorted(((u[0], u[3]) for u in used.values()), reverse=True)])
        found.append((row["scan_id"], row["entry_index"], *new.values(), bool(used), bool(used) or any(known(row, f) is not None for f in carried.FACTS)))
    return sorted(map(repr, found))


@pytest.mark.parametrize("seed", range(3))
def test_fill_persisted(spark, seed):
    rng = random.Random(seed)
    names = [x.split()[0] for x in QUALITY.split(", ")]
    label = lambda: rng.choice(["a", "b+c", " c + a ", "", None])
    rows = [dict(zip(names, (rng.randrange(5), "X", rng.choice(["https://h.test/a/b", "https://h.test/a/c", None, ""]), i, rng.choice([0, -1, None, 640, 1920]), rng.choice([0, 480, 1080]), rng.choice([0.0, None, 25.0, 50.0]), rng.choice([0, None, 7, 9]), rng.choice(["", None, "tt", "progressive", "odd"]), label(), label(), label(), label(), label()))) for i in range(60)]
    rows += [rows[0]] * 3
    listed = lambda df: sorted(map(repr, (tuple(r) for r in df.select("scan_id", "entry_index", *carried.FACTS, *carried.LABELS, "quality_source", "filled", "quality_known").collect())))
    frame = lambda data: spark.createDataFrame([tuple(r.values()) for r in data], QUALITY)
    expected = fold(rows)
    assert listed(carried.fill_persisted(frame(rows))) == expected
    rng.shuffle(rows)
    assert listed(carried.fill_persisted(frame(rows).repartition(7))) == expected
    assert carried.fill_persisted(frame(rows).limit(0)).count() == 0


def test_fill_without_labels_never_over_fresh(spark):
    rows = [(1, "X", "https://h.test/a/b", 1920, 1080, 50.0, 5000, "progressive", "mine"), (2, "X", "https://h.test/a/b", 640, 0, 25.0, 0, "", "mine"), (1, "Y", "https://h.test/a/b", 0, 0, 0.0, 0, "", "mine")]
    df = spark.createDataFrame(rows, "scan_id int, provider string, stream_url string, video_width int, video_height int, video_fps double, video_bitrate_bps long, video_scan_type string, extra string")
    found = {(r.provider, r.scan_id): r for r in carried.fill_persisted(df).collect()}
    second, other = found["X", 2], found["Y", 1]
    assert (second.video_width, second.video_height, second.video_fps, second.video_bitrate_bps, second.video_scan_type) == (640, 1080, 25.0, 5000, "progressive")
    assert second.filled and second.quality_known and second.extra == "mine"
    assert not other.filled and not other.quality_known and other.video_height == 0 and not found["X", 1].filled


def test_filling_takes_an_address_apart_once_a_side(spark):
    """Rows without a path leave evidence after its fold: a filter before it takes each address apart again. Labels are ordered as values."""
    plan = carried.fill_persisted(spark.range(3).selectExpr("1 AS scan_id", "'X' AS provider", "concat('https://h.test/', id) AS stream_url", "0 AS video_width", "0 AS video_height", "0D AS video_fps", "id AS video_bitrate_bps", "'' AS video_scan_type"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract(") == 2 and "array_sort(" not in text
    pathless = spark.createDataFrame([(1, "X", None, 1920, 1080, 50.0, 5, "p"), (1, "X", "https://h.test/a", 1920, 1080, 50.0, 5, "p")], "scan_id int, provider string, stream_url string, video_width int, video_height int, video_fps double, video_bitrate_bps long, video_scan_type string")
    assert [r.persistence_key for r in carried.quality_evidence(pathless).collect()] == ["X|/a"]
    labels = spark.createDataFrame([(" a ", "b+ a"), (None, " "), ("x", None), ("+", " c +c")], "a string, b string")
    assert [r[0] for r in labels.select(carried.merge_labels(F.col("a"), F.col("b"))).collect()] == ["a+b", "", "x", "c"]


ROWS = "n int, target string, playlist_url string, provider string, source_group string, entry_index int, stream_url string, tvg_name string, group_title string, entry_title string"
DEFINED = "target string, since int, enabled boolean, active_from int, active_until int, phrase string"


def carried_on(rows, failed, definitions, scans):
    """Scan by scan: what is there, and what is carried on from the scan before."""
    clean = lambda s: (s[0] or "", (s[1] or "").strip().upper() or "UNKNOWN", (s[2] or "").strip().upper())
    unread = {(f[0], clean(f[1:])) for f in failed}
    key = lambda r: (r[1], *clean(r[2:5]), r[5] or 0, *(x or "" for x in r[6:]))

    def defined(target, at):
        held = [d for d in definitions if d[0] == target and d[1] <= at]
        return max(held, key=lambda d: d[1])[2:] if held else None

    at, before, found = dict(scans), set(), []
    for n in sorted(at):
        here = {key(r) for r in rows if r[0] == n}
        kept = set()
        for k in before - here:
            now = defined(k[0], at[n])
            if (n, k[1:4]) in unread and now and now == defined(k[0], at[n - 1]) and now[0] and (now[1] is None or (now[1] <= at[n] and (now[2] is None or at[n] < now[2]))):
                kept.add(k)
        found += [(n, *k) for k in kept]
        before = here | kept
    return sorted(found)


@pytest.mark.parametrize("seed", range(3))
def test_retained_rows(spark, seed):
    rng = random.Random(seed)
    scans = [(n, n * 10) for n in range(1, 13)]
    source = lambda: (rng.choice(["l1", "l2"]), rng.choice([" x ", "X", None]), rng.choice(["g", "G ", None]))
    rows = [(rng.randrange(1, 13), rng.choice(["a", "b", "c", "d", "none"]), *source(), rng.choice([1, 2, None]), "u", rng.choice(["t", None]), "g", "e") for _ in range(120)]
    failed = [(n, *source()) for n in range(1, 14) for _ in range(7)]
    definitions = [("a", 0, True, None, None, "p"), ("a", 41, True, None, None, "p"), ("a", 75, True, None, None, "q"), ("b", 0, True, 30, 90, "p"), ("c", 0, True, None, 40, "p"), ("c", 60, False, None, None, "p"), ("d", 25, True, 60, None, "p"), ("d", 100, True, 60, None, None)]
    expected = carried_on(rows, failed, definitions, scans)
    frames = [spark.createDataFrame(x, y) for x, y in ((rows + rows[:5], ROWS), (failed, ROWS.split(", target")[0] + ", playlist_url string, provider string, source_group string"), (definitions, DEFINED), (scans, "n int, at int"))]
    found = carried.retain_unchanged(*frames, ("phrase",)).collect()
    assert sorted(tuple(r)[:-1] for r in found) == expected and {r.state for r in found} == {"SOURCE_UNAVAILABLE"}
    assert any(b[0] == a[0] + 1 and b[1:] == a[1:] for a in expected for b in expected)
    assert carried.retain_unchanged(frames[0].limit(0), *frames[1:], ("phrase",)).count() == 0


def test_rows_that_may_be_retained_move_once(spark):
    """One exchange by the names of a row, for its repeats and for when it is seen again; starts are found once."""
    rows = spark.createDataFrame([(n, "t", "l", "x", "g", 1, f"u{n % 3}", "", "", "") for n in (*range(9), 0)], ROWS)
    failed = rows.select("n", "playlist_url", "provider", "source_group")
    found = carried.retain_unchanged(rows, failed, spark.createDataFrame([("t", 0, True, None, None, "p")], DEFINED), rows.selectExpr("n", "n * 10 AS at").distinct(), ("phrase",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*stream_url", plan)) == 1
    assert sorted((r.n, r.stream_url) for r in found.collect()) == sorted((n, f"u{k}") for k in range(3) for n in range(9) if n > k and n % 3 != k)


def test_changed_and_inactive_searches_retain_nothing(spark):
    rows = [(1, t, "l", "X", "G", 1, "u", "", "", "") for t in ("same", "changed", "disabled", "ended", "early", "undefined")]
    definitions = [("same", 0, True, None, None, "p"), ("changed", 0, True, None, None, "p"), ("changed", 15, True, None, None, "q"), ("disabled", 0, False, None, None, "p"), ("ended", 0, True, 0, 20, "p"), ("early", 0, True, 21, None, "p")]
    failed = spark.createDataFrame([(2, "l", "x", "g"), (3, "l", "x", "g")], "n int, playlist_url string, provider string, source_group string")
    found = carried.retain_unchanged(spark.createDataFrame(rows, ROWS), failed, spark.createDataFrame(definitions, DEFINED), spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "n int, at int"), ("phrase",))
    assert sorted((r.target, r.n) for r in found.collect()) == [("same", 2), ("same", 3)]


def test_recovery_contexts(spark):
    """The lookup is the scope turned round, a mode once per search, a blank address asks for all."""
    plan = spark.createDataFrame([("JIO|/a", "t2,t1"), ("SONYLIV|/b", "t1")], "identity_key string, targets string")
    rows = [("t1", 0, "JIO", "JIO", 1, "u1", ""), ("t1", 1, "COMMON", "JIO", 2, "u1", ""), ("t1", 1, "COMMON", "JIO", 2, "u2", ""), ("t2", 0, "JIO", "JIO", 1, "u2", ""), ("t2", 1, "SONY", "SONY", 1, "u3", ""), ("t1", 2, "SONY", "SONY", 1, "u3", ""), ("t2", 3, "JIO", "JIO", None, None, "no catalogs")]
    scoped = spark.createDataFrame(rows, "name string, group_ord int, source_group string, context string, source_ord int, url string, error string")
    lookup = scope.recovery_lookup(plan, scoped, {"JIO": "EXACT_CHANNEL"})
    forward = scope.recovery_scope(plan, scoped).select("identity_key", "target", F.explode(F.split("urls", ",")).alias("url")).distinct().collect()
    assert {(r.identity_key, r.target, r.url) for r in forward} == {(r.identity_key, r.target, r.url) for r in lookup.collect()}
    asked = spark.createDataFrame([("JIO|/a", ""), ("JIO|/a", None), ("JIO|/a", " u2 "), ("JIO|/a", "u1"), ("JIO|/a", "u3"), ("SONYLIV|/b", "u3"), ("other", "u1")], "identity_key string, playlist_url string")
    found = {(r.identity_key, r.playlist_url): r.contexts for r in scope.recovery_contexts(lookup, asked).collect()}
    assert found == {("JIO|/a", ""): ["t2:EXACT_CHANNEL", "t1:EXACT_CHANNEL"], ("JIO|/a", "u2"): ["t2:EXACT_CHANNEL", "t1:EXACT_CHANNEL"], ("JIO|/a", "u1"): ["t1:EXACT_CHANNEL"], ("JIO|/a", "u3"): [], ("SONYLIV|/b", "u3"): ["t1:EVENT_PHRASE"], ("other", "u1"): []}
    assert {r.match_mode for r in scope.recovery_lookup(plan, scoped, {}).collect()} == {"EVENT_PHRASE"}


SHOWN = "identity_key string, provider string, stream_url string, playlist_url string, entry_index int, entry_title string, tvg_name string, group_title string, video_width int, video_height int, video_fps double, video_bitrate_bps long, video_scan_type string, video_bitrate_source string, source_freshness_ts double, launchable boolean, expiry double, probe_status string, access_blocked boolean, at int"


def shown(feed, path, catalog, index, title, height=1080, bitrate=500, source="manifest", fresh=None, at=None, works=True, group="g"):
    return (feed, "JIO", f"https://h.test/{path}", catalog, index, title, "", group, height * 16 // 9, height, 50.0, bitrate, "progressive", source, fresh, works, None, "", False, at)


def test_rows_under_their_headings(spark):
    rows = [
        shown("f", "a/1", "l1", 1, "B show", at=5),
        shown("f", "a/1", "l1", 2, "B show", at=9),  # looks like the first
        shown("f", "a/1", "l1", 3, "B show", at=9, works=False),  # another state
        shown("f", "a/1", "l2", 1, "a  SHOW!", at=5, bitrate=700, source="sample"),  # weaker evidence of one rendition
        shown("f", "a/2", "l3", 1, "A show", at=5, fresh=8.0),  # another rendition of the same look
        shown("f", "a/2", "l4", 1, "A show", at=5, fresh=9.0),
        shown("f", "a/2", "l5", 1, "A show", at=None, group=None),
        shown("f", "b/1", "l1", 4, "C", height=2160, at=1),
        shown("f", "b/2", "l1", 5, "C", height=720, at=1),
        shown("f", "x/master.m3u8", "l1", 6, "C", height=720, bitrate=1, at=1),
        shown("other", "a/1", "l1", 1, "B show", at=5),
    ]
    rows += [rows[0], rows[4]]
    df = spark.createDataFrame(rows, SHOWN)
    best = spark.createDataFrame([("f", "l3", 1)], "identity_key string, playlist_url string, entry_index int")
    found = {(r.identity_key, r.heading, r.place): (r.playlist_url, r.entry_index) for r in display.quality_rows(df, best, "at").collect()}
    first = [("l1", 3), ("l4", 1), ("l3", 1), ("l2", 1), ("l1", 1), ("l5", 1)]
    assert [found.pop(("f", 1, i)) for i in range(1, 7)] == first
    assert found == {("f", 2, 1): ("l1", 4), ("f", 3, 1): ("l1", 5), ("f", 4, 1): ("l1", 6), ("other", 1, 1): ("l1", 1)}
    without = display.quality_rows(df, best.limit(0), "at").where("identity_key = 'f' and playlist_url = 'l1' and entry_index = 4").collect()
    assert [r.heading for r in without] == [1]
    assert display.quality_rows(df.limit(0), best, "at").count() == 0


def test_rows_are_folded_to_their_looks_once(spark):
    """Headings, counts and places come from what was folded and stored, not from the addresses of all rows again."""
    rows = [shown("f", "a/1", "l1", i, "B show", at=i, bitrate=500 + i) for i in range(40)] + [shown("f", "a/2", "l1", 99, "B show", at=99, bitrate=539)]
    found = display.quality_rows(spark.createDataFrame(rows, SHOWN), spark.createDataFrame([("f", "l1", 7), ("f", None, 7)], "identity_key string, playlist_url string, entry_index int"), "at")
    assert "regexp_extract(" not in found._jdf.queryExecution().optimizedPlan().toString()
    # The rendition of path 1 is told by its first row, so the rows of both paths have headings of their own; the best row's comes first.
    assert sorted((r.heading, r.place, r.quality, r.entry_index) for r in found.collect()) == [(1, 1, "1920/1080/50.000/500/progressive", 0), (2, 1, "1920/1080/50.000/539/progressive", 99)]


def test_one_group_of_many_searches_is_dealt_over_all_tasks(spark):
    """Searches of one group are read with its catalogs by many tasks, and none reads all that one task wrote of the contexts."""
    searches = spark.range(2000).selectExpr("concat('t', id) AS name", "array('jio') AS source_groups")
    catalogs = spark.createDataFrame([("JIO", i, f"u{i}") for i in range(3)] + [("OTHER", 0, "x")], "bucket string, source_ord int, url string")
    found = scope.resolve_scope(searches, catalogs)
    assert "hashpartitioning(source_group" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "_part" in plan and "REPARTITION_BY_COL" in plan
    assert found.count() == 6000 and found.where("error <> ''").count() == 0 and found.columns == ["name", "group_ord", "source_group", "context", "source_ord", "url", "error"]
    assert {(r.n, r.k) for r in found.groupBy("url").agg(F.count("*").alias("n"), F.count_distinct("name").alias("k")).collect()} == {(2000, 2000)}
    row = ("JIO|/a", "JIO", "https://h.test/a", "l", 1, "x", "x", "g", 10, 10, 5.0, 7, "", "", 0.0, True, 9e9, "working", False, 1)
    contexts = spark.createDataFrame([row], SHOWN).selectExpr("*", "explode(array('t2', 't1')) AS target", "30 AS duration_min", "1 AS preferred")
    plan = scope.launch_plan(contexts, 0)
    assert "REPARTITION_BY_COL" in plan._jdf.queryExecution().executedPlan().toString() and [r.targets for r in plan.collect()] == ["t1,t2"]
