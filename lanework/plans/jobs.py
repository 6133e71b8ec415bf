"""Queries over manifests, streams and user functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanework.functions import states
from lanework.operators import aggregate, apply, changes, identity, intervals, manifests, ownership, probes
from lanework.plans import carriers, catalog
from lanework.plans.carriers import EVENTS_SQL, HEIGHTS, RATES, _case
from lanework.sources.shared import shared_path, stored
from lanework.streaming import jobs

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_HEIGHT, _FPS = _case("l_partkey % 6", HEIGHTS), _case("l_linenumber % 5", RATES)
_ROWS = f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor({_HEIGHT} * 16 / 9) AS INT) AS w, {_HEIGHT} AS h, CAST({_FPS} AS DOUBLE) AS f, CAST(floor(l_extendedprice) AS BIGINT) AS b FROM lineitem"
_ORDER = "l_linenumber, l_partkey, l_suppkey, b"


#: How a variant's address begins: beside its manifest, a folder up, or at the host's root.
_UP = "CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '../' ELSE '/r/./' END"
_URL = "CASE l_partkey % 3 WHEN 0 THEN 'https://m.test/o/' || l_orderkey || '/x/' WHEN 1 THEN 'https://m.test/o/' || l_orderkey || '/' ELSE 'https://m.test/r/' END || 'v' || l_partkey || '.m3u8'"


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One master manifest per order, with its few lines as variants."""
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lanework_lineitem")
    rows = spark.sql(_ROWS.replace("FROM lineitem", "FROM lanework_lineitem"))
    line = F.concat(F.lit("#EXT-X-STREAM-INF:BANDWIDTH="), F.col("b").cast("string"), F.lit(",RESOLUTION="), F.col("w").cast("string"), F.lit("x"), F.col("h").cast("string"), F.lit(",FRAME-RATE="), F.col("f").cast("string"), F.lit(',CODECS="a,b"\n'), F.expr(_UP), F.lit("v"), F.col("l_partkey").cast("string"), F.lit(".m3u8\n"))
    listed = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "b", line.alias("line"))))
    return rows.groupBy("l_orderkey").agg(listed.alias("x")).select(F.concat(F.lit("https://m.test/o/"), F.col("l_orderkey").cast("string"), F.lit("/x/master.m3u8?t=1")).alias("manifest_url"), F.concat(F.lit("#EXTM3U\n"), F.array_join(F.col("x.line"), "")).alias("text"))


@query("hls_variants", f"SELECT 'https://m.test/o/' || l_orderkey || '/x/master.m3u8?t=1' AS manifest_url, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER})::INT AS variant, w AS width, h AS height, f AS fps, b AS bitrate, 'a,b' AS codecs, {_UP} || 'v' || l_partkey || '.m3u8' AS uri, {_URL} AS url, NULL::BIGINT AS expiry FROM ({_ROWS})")
def hls_variants(spark, sf_dir):
    return manifests.hls_variants(_manifests(spark, sf_dir))


@query(
    "best_variant",
    f"""WITH v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER})::INT AS variant FROM ({_ROWS})),
             k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (f > 0 OR h > 0 OR b > 0) DESC, CASE WHEN f >= 50 THEN 2 WHEN f > 0 THEN 1 ELSE 0 END DESC,
                          CASE WHEN h >= 2160 THEN 2160 WHEN h >= 1440 THEN 1440 WHEN h >= 1080 THEN 1080 WHEN h >= 720 THEN 720 ELSE 0 END DESC, least(f, 50) DESC, w * h DESC, h DESC, w DESC, b DESC, variant) AS place FROM v)
        SELECT 'https://m.test/o/' || l_orderkey || '/x/master.m3u8?t=1' AS manifest_url, variant, w AS width, h AS height, f AS fps, b AS bitrate, {_UP} || 'v' || l_partkey || '.m3u8' AS uri FROM k WHERE place = 1""",
)
def best_variant(spark, sf_dir):
    return manifests.best_variant(manifests.hls_variants(_manifests(spark, sf_dir)))


@query(
    "progress_bitrate",
    "SELECT user_id AS stream, CASE WHEN max(CAST(floor(value * 1000) AS BIGINT)) > 0 AND max(event_id) > 0 THEN floor(max(CAST(floor(value * 1000) AS BIGINT)) * 8000000.0 / max(event_id))::BIGINT ELSE 0 END AS bits_per_second FROM events GROUP BY 1",
)
def progress_bitrate(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = F.array(F.concat(F.lit("total_size="), F.floor(F.col("value") * 1000).cast("string")), F.concat(F.lit("out_time_us = "), F.col("event_id").cast("string")), F.lit("speed=1x"))
    return manifests.progress_bitrate(rows.select(F.col("user_id").alias("stream"), F.explode(lines).alias("line")))


@query("grouped_apply", f"SELECT playlist_url, entry_index, CASE WHEN first_value(entry_index) OVER o % 5 = 0 THEN 'failed' ELSE 'len ' || length(identity_key) END AS result FROM ({carriers.KEYED_SQL}) WINDOW o AS (PARTITION BY identity_key ORDER BY entry_index, playlist_url)")
def grouped_apply(spark, sf_dir):
    def probe(row: dict) -> dict:
        if row["entry_index"] % 5 == 0:
            raise ValueError("no answer")
        return {"result": f"len {len(row['identity_key'])}"}

    rows = catalog.keyed(spark, sf_dir).select("identity_key", "playlist_url", "entry_index")
    return apply.grouped_apply(rows, ["identity_key"], ["entry_index", "playlist_url"], probe, "result string", lambda row, e: {"result": "failed"}).drop("identity_key")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ownership events as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    found = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")
    return carriers.event_columns(found).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_scan_windows", f"SELECT time_bucket(INTERVAL '300 seconds', ts) AS cycle, session_id, count(*) AS n, count(*) FILTER (new_state = 'RECORDING') AS recording FROM ({EVENTS_SQL}) GROUP BY ALL")
def stream_scan_windows(spark, sf_dir):
    return jobs.drain(jobs.scan_windows(event_stream(spark, sf_dir)), "update", "windows", ("cycle", "session_id")).withColumn("cycle", F.col("cycle").cast("timestamp_ntz"))


@query("stream_latest_status", f"SELECT session_id, identity_key, max(seq) AS seq, arg_max(new_state, seq) AS state, arg_max_null(worker_pid, seq) AS worker_pid FROM ({EVENTS_SQL}) GROUP BY ALL")
def stream_latest_status(spark, sf_dir):
    return jobs.drain(jobs.latest_status(event_stream(spark, sf_dir)), "update", "status", ("session_id", "identity_key"))


@query(
    "stream_status_lives",
    f"""WITH e AS ({EVENTS_SQL}), g AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 12 HOUR, true)::INT AS fresh FROM e WINDOW w AS (PARTITION BY session_id, identity_key ORDER BY ts, seq)),
             l AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id, identity_key ORDER BY ts, seq) AS life FROM g)
        SELECT session_id, identity_key, min(ts) AS started, max(ts) AS last_seen, count(*) AS events, max(seq) AS seq, arg_max(new_state, seq) AS state, arg_max_null(worker_pid, seq) AS worker_pid
        FROM l GROUP BY session_id, identity_key, life HAVING max(ts) + INTERVAL 12 HOUR <= date_trunc('milliseconds', (SELECT max(ts) FROM e)) - INTERVAL 10 MINUTE""",
)
def stream_status_lives(spark, sf_dir):
    return jobs.drain(jobs.status_lives(event_stream(spark, sf_dir)), "append", "lives").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "last_seen")})


#: The claims that find room, session by session, carried from claim to claim; then the machine, in which a claim without room has no effect.
_LIMITED = catalog._DECIDED.replace(
    "RECURSIVE v AS (SELECT *,",
    f"""RECURSIVE ev AS ({EVENTS_SQL}),
    cl AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS k, coalesce((SELECT min(f.seq) FROM ev f WHERE f.session_id = c.session_id AND f.identity_key = c.identity_key AND f.seq > c.seq AND f.op = 'transition'
                  AND f.new_state IN ({catalog._NAMES(states.FINAL)}) AND coalesce(f.worker_pid, 1) > 0), 9000000000000000000) AS ends FROM ev c WHERE op = 'claim'),
    ad AS (SELECT session_id, 0::BIGINT AS k, []::BIGINT[] AS live, []::VARCHAR[] AS taken, NULL::BIGINT AS seq, false AS granted FROM (SELECT DISTINCT session_id FROM ev)
           UNION ALL
           SELECT session_id, k, CASE WHEN ok THEN list_append(live, ends) ELSE live END, CASE WHEN ok THEN list_append(taken, identity_key) ELSE taken END, seq, ok
           FROM (SELECT cl.session_id, cl.k, cl.seq, cl.ends, cl.identity_key, list_filter(ad.live, lambda x: x > cl.seq) AS live, ad.taken, NOT list_contains(ad.taken, cl.identity_key) AND len(list_filter(ad.live, lambda x: x > cl.seq)) < {states.CAPACITY} AS ok
                 FROM ad JOIN cl ON cl.session_id = ad.session_id AND cl.k = ad.k + 1)),
    v AS (SELECT *, EXISTS (FROM ad WHERE ad.session_id = e0.session_id AND ad.seq = e0.seq AND ad.granted) AS granted,""",
).replace(f"FROM ({EVENTS_SQL})),\n    m AS", "FROM ev e0),\n    m AS").replace("v.new_state AS to_state, v.worker_pid,", "v.new_state AS to_state, v.worker_pid, v.granted,").replace("CASE WHEN m.state IS NULL THEN '' ELSE 'claimed already' END", "CASE WHEN m.state IS NOT NULL THEN 'claimed already' WHEN v.granted THEN '' ELSE 'no capacity' END")
_LIMITED_SQL = f"WITH {_LIMITED} SELECT session_id, identity_key, seq, ev.new_state, reason FROM d JOIN ev USING (session_id, identity_key, seq)"


@query("registry_within", _LIMITED_SQL)
def registry_within(spark, sf_dir):
    return jobs.logged(ownership.decide_within(carriers.events(spark, sf_dir)))


@query("stream_registry", _LIMITED_SQL)
def stream_registry(spark, sf_dir):
    return jobs.run_registry(event_stream(spark, sf_dir))


def _change_sql() -> str:
    """The single diffs, put together; each keeps its own SQL."""
    parts = {name: catalog.ORACLES[name] for name in ("diff_identities", "diff_sources", "diff_updates")}
    quality = f"WITH {catalog._BEST} SELECT * FROM q WHERE marker IS NOT NULL"
    return f"""
        WITH sc AS (SELECT scan_id, row_number() OVER (ORDER BY scan_id) AS n FROM (SELECT DISTINCT scan_id FROM ({carriers.KEYED_SQL}))),
             c AS (SELECT identity_key, NULL AS playlist_url, n, marker, NULL AS details FROM ({parts["diff_identities"]})
                   UNION ALL SELECT identity_key, playlist_url, n, marker, NULL FROM ({parts["diff_sources"]})
                   UNION ALL SELECT identity_key, playlist_url, n, 'UPDATE', details FROM ({parts["diff_updates"]})
                   UNION ALL SELECT identity_key, NULL, n, marker, was || ' -> ' || "is" FROM ({quality}))
        SELECT scan_id, identity_key, playlist_url, marker, details FROM c JOIN sc USING (n)"""


@query("all_changes", _change_sql())
def all_changes(spark, sf_dir):
    # Feeds and catalogs are compared apart: both read the summaries, which are made once.
    return changes.all_changes(stored(changes.summary_with_quality(catalog.keyed(spark, sf_dir)), "summaries"))


#: Arrivals of the history that the stream is fed: each brings a third of the range of scans.
ARRIVALS = 3


@query("change_stream", _change_sql())
def change_stream(spark, sf_dir):
    """The history of all scans, arriving part by part, each in a batch of its own."""
    rows = catalog.keyed(spark, sf_dir)
    landed, scans, log, place = (shared_path(spark, f"changes-{x}") for x in ("landed", "scans", "log", "state"))
    low, high = (F.lit(x).cast("int") for x in rows.agg(F.min("scan_id"), F.max("scan_id")).first())
    part = F.floor((F.col("scan_id") - low) * ARRIVALS / (high - low + 1))
    for k in range(ARRIVALS):
        # Told apart before keys are made, so that a row's is made once and the history written once.
        rows.where(part == k).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(rows.schema).parquet(landed)
        jobs.full_change_stream(stream, scans, log).trigger(availableNow=True).option("checkpointLocation", place).start().awaitTermination()
    return jobs.logged_changes(spark, log)


#: Rows that ask for one thing in several ways: header names in either case, and the address under two catalogs' suffixes.
_ASKED = """
    SELECT 'https://src' || {n}(l_suppkey % 20 AS {t}) AS playlist_url, l_orderkey * 8 + l_linenumber AS entry_index, CAST(floor(l_extendedprice) AS BIGINT) AS price,
           'https://cdn' || {n}(l_suppkey % 7 AS {t}) || '.test/' || {n}(l_partkey % 200 AS {t}) || '.m3u8|' || l_returnflag AS stream_url, l_partkey % 10 = 0 AS has_keys,
           CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE {m} END AS headers, CASE WHEN l_quantity % 5 <> 0 THEN CAST({e} AS DOUBLE) END AS expiry
    FROM {l}"""
_AGENT, _NAME = "CASE l_suppkey % 2 WHEN 0 THEN 'a' ELSE 'b' END", "CASE l_linenumber % 2 WHEN 0 THEN 'User-Agent' ELSE 'user-agent' END"
_ASKED_SQL = _ASKED.format(n="CAST", t="VARCHAR", e="epoch(l_shipdate)", l="lineitem", m=_AGENT)
_ASKED_SPARK = _ASKED.format(n="CAST", t="STRING", e="unix_timestamp(l_shipdate)", l="lanework_lineitem", m=f"map({_NAME}, {_AGENT}, 'Referer', 'r')")


@query(
    "probe_requests",
    f"""WITH a AS (SELECT *, split_part(stream_url, '|', 1) AS u, coalesce(headers, '-') AS h, coalesce(expiry <= {carriers.NOW}, false) AS late FROM ({_ASKED_SQL})),
             r AS (SELECT *, first_value(entry_index) OVER w AS asked_by, first_value(expiry) OVER w AS asked_expiry, split_part(split_part(u, '/', 4), '.', 1)::BIGINT AS part FROM a WINDOW w AS (PARTITION BY u, h, has_keys ORDER BY late, playlist_url, entry_index, price)),
             p AS (SELECT *, part % 9 = 0 AS failed, CASE WHEN part % 9 <> 0 AND part % 4 = 0 THEN {carriers.NOW} + (asked_by % 7 - 1) * 1000.0 END AS answer_expiry FROM r)
        SELECT playlist_url, entry_index, price, CASE WHEN late OR coalesce(answer_expiry <= {carriers.NOW}, false) THEN 'expired' WHEN failed THEN 'probe_failed' WHEN part % 5 = 0 THEN 'unsupported' ELSE 'working' END AS probe_status,
               CASE WHEN NOT failed THEN part * 10 END AS height, least(expiry, answer_expiry) AS expiry, CASE WHEN failed THEN 'no answer from ' || u ELSE '' END AS problem,
               count(*) OVER (PARTITION BY u, h, has_keys) AS members FROM p""",
)
def probe_requests(spark, sf_dir):
    def probe(row: dict) -> dict:
        address = row["stream_url"].split("|")[0]
        part = int(address.split("/")[3].split(".")[0])
        if part % 9 == 0:
            raise ValueError(f"no answer from {address}")
        expiry = {"answer_expiry": carriers.NOW + (row["entry_index"] % 7 - 1) * 1000.0} if part % 4 == 0 else {}
        return {"status": None if part % 5 == 0 else "working", "height": part * 10} | expiry

    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lanework_lineitem")
    found = probes.probe_requests(spark.sql(_ASKED_SPARK), probe, carriers.NOW, ("playlist_url", "entry_index", "price"))
    return found.select("playlist_url", "entry_index", "price", "probe_status", "height", "expiry", "problem", "members")


#: Windows of a few days from each order, some open at one side; moments are the hours at which something happened to a line.
_WINDOWS = """SELECT o_orderkey AS name, CASE WHEN o_orderkey % 997 <> 5 THEN {d} END AS active_from, CASE WHEN o_orderkey % 1499 <> 7 THEN {d} + {k} END AS active_until FROM {o} WHERE o_orderstatus <> 'P'"""


@query(
    "active_at",
    f"""WITH w AS ({_WINDOWS.format(d="o_orderdate", k="to_hours(o_orderkey % 40)", o="orders")}), m AS (SELECT DISTINCT l_shipdate + to_hours(l_linenumber % 3) AS at FROM lineitem)
        SELECT m.at, w.name, w.active_from, w.active_until FROM m JOIN w ON (active_from IS NULL OR active_from <= m.at) AND (active_until IS NULL OR m.at < active_until)""",
)
def active_at(spark, sf_dir):
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    starts, hours = F.col("o_orderdate").cast("timestamp"), F.expr("make_dt_interval(0, CAST(o_orderkey % 40 AS INT))")
    windows = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("name"), F.when(F.col("o_orderkey") % 997 != 5, starts).alias("active_from"), F.when(F.col("o_orderkey") % 1499 != 7, starts + hours).alias("active_until"))
    moments = lines.select((F.col("l_shipdate").cast("timestamp") + F.expr("make_dt_interval(0, CAST(l_linenumber % 3 AS INT))")).alias("at")).distinct()
    found = intervals.active_at(moments, windows)
    return found.select(*(F.col(c).cast("timestamp_ntz") if c != "name" else F.col(c) for c in ("at", "name", "active_from", "active_until")))


@query(
    "stream_scan_feeds",
    f"SELECT time_bucket(INTERVAL '300 seconds', ts) AS cycle, session_id, count(*) AS n, count(DISTINCT identity_key) AS feeds FROM ({EVENTS_SQL}) GROUP BY ALL",
)
def stream_scan_feeds(spark, sf_dir):
    """A cycle sees few feeds, which its sketch counts exactly."""
    found = jobs.drain(jobs.scan_feeds(event_stream(spark, sf_dir)), "update", "feeds", ("cycle", "session_id"))
    return found.select(F.col("cycle").cast("timestamp_ntz").alias("cycle"), "session_id", "n", "feeds")


@query(
    "catalog_rollup_sketched",
    f"""SELECT provider, group_title, state, grouping_id(provider, group_title, state)::INT AS level, count(*)::BIGINT AS observations, true AS within
        FROM ({catalog.RANKED_SQL}) GROUP BY ROLLUP (provider, group_title, state)""",
)
def catalog_rollup_sketched(spark, sf_dir):
    """Estimates beside exact counts: within four standard errors everywhere."""
    rows = catalog.keyed(spark, sf_dir)
    keys = ["provider", "group_title", "state"]
    exact = rows.withColumn("state", identity.state_of(rows)).rollup(*keys).agg(F.grouping_id().cast("int").alias("level"), F.count_distinct("identity_key").alias("exact"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "level")]
    both = aggregate.catalog_rollup_sketched(rows).alias("a").join(exact.alias("b"), same)
    within = F.abs(F.col("feeds") - F.col("exact")) <= 4 * 0.01625 * F.col("exact")
    return both.select(*(F.col(f"a.{c}").alias(c) for c in (*keys, "level")), "observations", within.alias("within"))
