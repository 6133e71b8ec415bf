"""Requests, probes and windows on small fixtures."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lanework.operators import intervals, probes

ROW = "playlist_url string, entry_index int, stream_url string, headers map<string,string>, has_keys boolean, expiry double"


def test_request_key(spark):
    same = [("a|UA=1", {"X": "1", "y": "2"}, None), (" a ", {"y": "2", "x": "1"}, False), ("a|", {"Y": "2", " x": "1"}, False)]
    other = [("a", {"x": "1"}, False), ("a", {"x": "1", "y": "2"}, True), ("b", {"x": "1", "y": "2"}, False), ("a", None, False), (None, None, None), ("ax", {"": "1"}, False), ("a", {"x1": ""}, False), ("a", {"x": "12", "y": ""}, False)]
    df = spark.createDataFrame(same + other, "u string, h map<string,string>, k boolean")
    keys = [r[0] for r in df.select(probes.request_key(F.col("u"), F.col("h"), F.col("k"))).collect()]
    assert len(set(keys[:3])) == 1 and len(set(keys)) == 1 + len(other)


def test_probe_fan_out(spark):
    """One probe a request, by the first row that has not expired; own expiry rules; a failure is every member's."""
    rows = [("l1", 1, "u|a", {"H": "1"}, False, 50.0), ("l2", 1, "u|b", {"h": "1"}, False, 500.0), ("l3", 9, "u", {"h": "1"}, None, None), ("l1", 2, "v", None, False, 10.0), ("l1", 3, "v", {}, False, 20.0), ("l9", 1, "bad", None, False, None), ("l9", 1, "bad", None, False, None), ("l4", 1, None, None, None, 900.0), ("l5", 1, "w", None, True, 900.0)]

    def probe(row):
        if row["stream_url"] == "bad":
            raise RuntimeError("down")
        return {"status": "working", "height": int(row["entry_index"]) * 100 + len(row["playlist_url"]), "answer_expiry": 90.0 if row["stream_url"] == "w" else 700.0, "problem": row["playlist_url"]}

    found = sorted(((r.playlist_url, r.entry_index, r.probe_status, r.launchable, r.height, r.expiry, r.problem) for r in probes.probe_requests(spark.createDataFrame(rows, ROW).repartition(3), probe, 100).collect()), key=str)
    assert found == sorted([
        ("l1", 1, "expired", False, 102, 50.0, "l2"), ("l2", 1, "working", True, 102, 500.0, "l2"), ("l3", 9, "working", True, 102, 700.0, "l2"),
        ("l1", 2, "expired", False, 202, 10.0, "l1"), ("l1", 3, "expired", False, 202, 20.0, "l1"),
        ("l9", 1, "probe_failed", False, None, None, "down"), ("l9", 1, "probe_failed", False, None, None, "down"),
        ("l4", 1, "working", True, 102, 700.0, "l4"), ("l5", 1, "expired", False, 102, 90.0, "l5"),
    ], key=str)
    assert probes.probe_requests(spark.createDataFrame([], ROW), probe, 100).count() == 0


def test_windows_that_hold_moments(spark):
    """Half-open ends to the microsecond, open, empty and turned windows, repeated rows: as a plain loop."""
    rng, day = random.Random(1), datetime(2024, 1, 1)
    ends = [day, day + timedelta(microseconds=1), day + timedelta(seconds=59, microseconds=999999), day + timedelta(minutes=1), day + timedelta(hours=5), datetime(1971, 3, 1), datetime(2099, 1, 1), None]
    windows = [(f"w{i}", a, b) for i, (a, b) in enumerate((a, b) for a in ends for b in ends)]
    windows += [(f"r{i}", s, s + timedelta(seconds=rng.choice([1, 30, 3600, 86400 * 400]))) for i in range(60) for s in [day + timedelta(seconds=rng.randrange(-(10**6), 10**6))]]
    windows.append(windows[-1])
    moments = [(x,) for x in ends] + [(day + timedelta(seconds=rng.randrange(-(10**6), 10**6)),) for _ in range(60)] + [(day,)]
    df = intervals.active_at(spark.createDataFrame(moments, "at timestamp"), spark.createDataFrame(windows, "name string, active_from timestamp, active_until timestamp"))
    found = sorted((r["at"], r["name"]) for r in df.collect())
    assert found == sorted((m, n) for (m,) in moments for n, a, b in windows if m is not None and (a is None or a <= m) and (b is None or m < b))
    assert not re.search("Cartesian|NestedLoop", df._jdf.queryExecution().executedPlan().toString())


def test_a_request_counts_its_rows_in_the_pass_that_finds_it(spark):
    """Rows of a request are counted with its representative; keys are not made anew for a filter (F12)."""
    rows = [("l1", 1, "u|x", {"A": "1"}, False, None), ("l2", 1, "u", {"a": "1"}, None, None), ("l3", 1, None, None, True, None)]
    found = probes.probe_requests(spark.createDataFrame(rows, ROW).repartition(3), lambda row: {"status": "working"}, 100)
    assert sorted((r.playlist_url, r.members) for r in found.collect()) == [("l1", 2), ("l2", 2), ("l3", 1)]
    assert not [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x and "sha2" in x]
