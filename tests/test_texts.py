"""JSON catalogs, header layers, key lines and sessions on small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanework.operators import headers, json_catalog, manifests, ownership


def entries_of(spark, text, profile="normalized"):
    docs = spark.createDataFrame([("u", text)], "url string, text string")
    return [tuple(r) for r in json_catalog.explode_json_entries(docs, profile).orderBy("entry_index").collect()]


def test_json_profiles(spark):
    text = '{"Channels": [{"name": "A", "group": "Sports"}, 7, {"URL": "https://x.test/a", "Title": "T\\nU", "channel": "C", "name": {"x": 1}, "url": "https://x.test/b"}]}'
    assert entries_of(spark, text) == [("u", 1, "A", "", "", "Sports"), ("u", 3, "", "https://x.test/b", "", "")]
    assert entries_of(spark, text, "mature") == [("u", 3, "", "https://x.test/a", "", "")]


def test_json_without_records(spark):
    for text in (None, "", "no json", "{}", '{"channels": "x"}', "[]", "[1]"):
        assert entries_of(spark, text) == [], text


def test_header_layers(spark):
    lines = F.array(F.lit("#EXTVLCOPT:http-user-agent=A"), F.lit('#EXTHTTP:{"cookie": "c", "X-y": "1", "user-agent": ""}'), F.lit("#EXTHTTP:oops"), F.lit("#EXTVLCOPT:http-extra-headers=X-Y:2"), F.lit("#EXTVLCOPT:http-user-agent=B"), F.lit(None).cast("string"))
    merged = headers.merge_header_layers(headers.option_headers(lines), headers.json_headers(lines), F.lit(None).cast("map<string,string>"))
    none = headers.option_headers(F.lit(None).cast("array<string>"))
    row = spark.range(1).select(headers.option_headers(lines).alias("o"), merged.alias("m"), none.alias("n"), headers.json_headers(lines, True).alias("j")).first()
    assert row.o == {"X-Y": "2", "User-Agent": "B"}
    assert row.m == {"User-Agent": "B", "Cookie": "c", "X-y": "1"}
    assert row.n == {}
    assert row.j == {"Cookie": "c", "X-y": "1", "User-Agent": ""}


def test_blank_never_replaces(spark):
    layer = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    row = spark.range(1).select(headers.merge_header_layers(layer("Origin", "a"), layer("origin", " "), keep_blank=True).alias("m")).first()
    assert row.m == {"Origin": "a"}


def test_key_lines(spark):
    texts = [("a", None), ("b", "#EXT-X-KEY:URI=\"k\""), ("c", "#EXT-X-KEY:METHOD=AES-128"), ("d", "#EXT-X-KEY:METHOD=aes-128,uri=k,KEYFORMAT=identity")]
    found = manifests.encryption_flags(spark.createDataFrame(texts, "manifest_url string, text string")).orderBy("manifest_url").collect()
    assert [(r.protected, r.key_required) for r in found] == [(False, False), (False, False), (True, True), (True, False)]


def test_sessions(spark):
    rows = [("a", "f", 1, "claim", "LAUNCHING"), ("a", "f", 2, "transition", "ENDED"), ("b", "f", 1, "claim", "LAUNCHING"), ("c", "f", 1, "transition", "ENDED")]
    events = spark.createDataFrame(rows, "session_id string, identity_key string, seq long, op string, new_state string")
    assert {tuple(r) for r in ownership.session_rollover(events).collect()} == {("a", "ROLLED_OVER"), ("b", "CONTINUED"), ("c", "CREATED")}


def test_a_header_line_costs_one_expression(spark):
    """Names and values of a line are cut from its body once; what never ends is not tried as JSON (F8)."""
    lines = F.array(*map(F.lit, ("#EXTVLCOPT:http-user-agent=A=1", "#EXTVLCOPT:none", "#extvlcopt:HTTP-Extra-Headers=x-y:a:b", "#EXTVLCOPT:http-cookie=a\nb", "#EXTVLCOPT:http-referrer=r\n", ' #exthttp:{"X-y": "2"} z', '#EXTHTTP:{"a": "1"', "#EXTVLCOPT:http-extra-headers=z")))
    row = spark.range(1).select(headers.option_headers(lines).alias("o"), headers.json_headers(lines).alias("j")).first()
    assert (row.o, row.j) == ({"User-Agent": "A=1", "x-y": "a:b", "Referer": "r"}, {"X-y": "2"})
    df = spark.createDataFrame([(["#EXTVLCOPT:http-user-agent=A"],)], "lines array<string>").select(headers.option_headers(F.col("lines")).alias("h"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1
