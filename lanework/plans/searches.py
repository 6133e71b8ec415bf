"""Queries over searches, evidence, labels and probe answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanework.functions import policy
from lanework.operators import display, evidence, headers, identity, manifests, match, phrases, scope
from lanework.plans import catalog
from lanework.plans.carriers import KEYED_SQL, NOW, _case
from lanework.plans.catalog import _PLACED, RANKED_SQL
from lanework.plans.jobs import _ORDER, _ROWS
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


_URL_PARTS = "list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')"


@query("source_label", f"SELECT page_id, rtrim(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/' || array_to_string({_URL_PARTS}, '/'), '/') AS label FROM pages")
def source_label(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", display.source_label(F.col("url")).alias("label"))


_EVIDENCE = """
    SELECT 'feed' || {n}(l_orderkey % 1500 AS {t}) AS identity_key, 'https://src' || {n}(l_suppkey % 20 AS {t}) || '.test/list.m3u' AS playlist_url, l_orderkey * 8 + l_linenumber AS entry_index,
           CASE WHEN l_partkey % 13 = 0 THEN '' ELSE 'Match ' || {n}(l_partkey % 40 AS {t}) || CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN ' Live' ELSE ': extra ' || {n}(l_suppkey % 3 AS {t}) END END AS entry_title,
           CASE WHEN l_partkey % 13 <> 0 AND l_partkey % 4 = 0 THEN 'CH-' || {n}(l_partkey % 7 AS {t}) ELSE '' END AS tvg_name,
           l_linenumber % 2 = 0 AS ignored, CASE WHEN l_linenumber % 8 = 4 THEN false END AS conflict, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST({e} AS DOUBLE) END AS source_freshness_ts
    FROM {l}"""
EVIDENCE_SQL = _EVIDENCE.format(n="CAST", t="VARCHAR", e="epoch(l_shipdate)", l="lineitem")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with titles of which some hold others, from lineitem."""
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lanework_lineitem")
    return spark.sql(_EVIDENCE.format(n="CAST", t="STRING", e="unix_timestamp(l_shipdate)", l="lanework_lineitem"))


_PLAIN = "trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _clusters(rows: str) -> str:
    """Rows with the smallest value that theirs is connected with, as CTEs up to c(identity_key, cluster, n_rows, sources)."""
    return f"""v AS (SELECT *, list_distinct([x FOR x IN [{_PLAIN.format(x='entry_title')}, {_PLAIN.format(x='tvg_name')}] IF x <> '']) AS vals FROM ({rows})),
        n AS (SELECT DISTINCT identity_key, unnest(vals) AS x FROM v),
        w AS (SELECT DISTINCT identity_key, vals[1] AS a, vals[2] AS b FROM v WHERE len(vals) = 2
              UNION SELECT a.identity_key, a.x, b.x FROM n a JOIN n b ON a.identity_key = b.identity_key AND a.x <> b.x AND length(a.x) >= 8 AND contains(b.x, a.x)),
        l AS (SELECT * FROM w UNION SELECT identity_key, b, a FROM w),
        r AS (SELECT identity_key, x, x AS y FROM n UNION SELECT r.identity_key, r.x, l.b FROM r JOIN l ON l.identity_key = r.identity_key AND l.a = r.y),
        m AS (SELECT identity_key, x, min(y) AS cluster FROM r GROUP BY ALL),
        c AS (SELECT v.identity_key, CASE WHEN len(vals) = 0 THEN '|' || playlist_url || '|' || entry_index ELSE cluster END AS cluster, count(*) AS n_rows, count(DISTINCT playlist_url) AS sources
              FROM v LEFT JOIN m ON m.identity_key = v.identity_key AND m.x = v.vals[1] GROUP BY ALL)"""


@query("conflict_clusters", f"WITH RECURSIVE {_clusters(EVIDENCE_SQL)} SELECT * FROM c")
def conflict_clusters(spark, sf_dir):
    return evidence.conflict_clusters(_evidence(spark, sf_dir))


CONTEXT_TARGETS = [
    {"name": "t1", "primary": [["match 7"]], "required": [["match"]], "rejected": [["extra 2"]], "preferred": [["live"], ["extra 1", "ch 3"]]},
    {"name": "t2", "primary": [["match 3", "match 4"], ["live"]], "preferred": [["ch 1", "ch 2"]]},
    {"name": "t3", "match_all": True, "required": [["ch 5"], ["extra 0"]]},
]


def _context_sql(t: dict) -> str:
    """Rows that match a target (hit), or pass its gates, and their titles."""
    bounded = lambda group: "(" + " OR ".join(f"regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_]){p}($|[^\\p{{L}}\\p{{N}}_])')" for p in group) + ")"
    primary = " AND ".join("(" + " OR ".join(f"contains(t, '{p}')" for p in group) + ")" for group in t.get("primary", ())) or "true"
    gate = " AND ".join([bounded(g) for g in t.get("required", ())] + ["NOT " + bounded(g) for g in t.get("rejected", ())]) or "true"
    score = " + ".join(f"{bounded(g)}::INT" for g in t.get("preferred", ())) or "0"
    return f"SELECT *, '{t['name']}' AS target, ({score})::INT AS score, {primary} AS hit FROM x WHERE {gate}"


@query(
    "attach_context",
    f"""WITH x AS (SELECT *, {_PLAIN.format(x="tvg_name || ' ' || entry_title")} AS t, list_distinct([x FOR x IN [{_PLAIN.format(x='entry_title')}, {_PLAIN.format(x='tvg_name')}] IF x <> '']) AS vals FROM ({EVIDENCE_SQL})),
             g AS ({' UNION ALL '.join(map(_context_sql, CONTEXT_TARGETS))}),
             k AS (SELECT target, identity_key, list_distinct(flatten(list(vals))) AS known FROM g WHERE hit GROUP BY ALL)
        SELECT g.identity_key, playlist_url, entry_index, entry_title, tvg_name, g.target, score,
               len(vals) > 0 AND len(known) > 0 AND len([1 FOR a IN vals IF len([1 FOR b IN known IF a = b OR (length(a) >= 8 AND contains(b, a)) OR (length(b) >= 8 AND contains(a, b))]) > 0]) = 0 AS conflict
        FROM g JOIN k ON k.target = g.target AND k.identity_key = g.identity_key
        WHERE NOT EXISTS (FROM g h WHERE h.hit AND h.target = g.target AND h.playlist_url = g.playlist_url AND h.entry_index = g.entry_index)""",
)
def attach_context(spark, sf_dir):
    rows = _evidence(spark, sf_dir).select("identity_key", "playlist_url", "entry_index", "entry_title", "tvg_name", F.concat_ws(" ", F.nullif("tvg_name", F.lit("")), F.nullif("entry_title", F.lit(""))).alias("title"), F.lit("").alias("path"))
    return match.attach_context(rows, CONTEXT_TARGETS).drop("title", "path")


_NEWER = f"""SELECT * FROM (SELECT *, max(source_freshness_ts) FILTER (NOT ignored) OVER (PARTITION BY identity_key) AS newest FROM ({EVIDENCE_SQL})
             WHERE source_freshness_ts IS NOT NULL AND (NOT ignored OR coalesce(conflict, true))) WHERE ignored AND (newest IS NULL OR source_freshness_ts > newest)"""


@query(
    "freshness_verdict",
    f"""WITH RECURSIVE {_clusters(_NEWER)}, g AS (SELECT identity_key, max(sources) AS agree, count(*) AS k FROM c GROUP BY 1)
        SELECT identity_key, CASE WHEN k IS NULL THEN 'eligible' WHEN agree >= 2 THEN 'confirmed' WHEN k > 1 THEN 'ambiguous' ELSE 'single' END AS verdict
        FROM (SELECT DISTINCT identity_key FROM ({EVIDENCE_SQL})) LEFT JOIN g USING (identity_key)""",
)
def freshness_verdict(spark, sf_dir):
    return evidence.freshness_verdict(_evidence(spark, sf_dir))


@query(
    "freshness_history",
    """WITH d AS (SELECT user_id AS source, ts AS fetched_at, event_type AS hash, event_id, CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 1 DAY END AS c, CASE WHEN event_id % 4 = 0 THEN ts - INTERVAL 2 DAY END AS g, CASE WHEN event_id % 5 = 0 THEN ts - INTERVAL 3 DAY END AS m FROM events),
            l AS (SELECT *, coalesce((lag(hash) OVER w <> hash)::INT, 0) AS changed FROM d WINDOW w AS (PARTITION BY source ORDER BY fetched_at, hash)),
            s AS (SELECT *, sum(changed) OVER w AS run, last_value(CASE WHEN changed = 1 THEN fetched_at END IGNORE NULLS) OVER w AS since, first_value(c IGNORE NULLS) OVER w AS fc, first_value(g) OVER w AS fg, first_value(m) OVER w AS fm
                  FROM l WINDOW w AS (PARTITION BY source ORDER BY fetched_at, hash ROWS UNBOUNDED PRECEDING))
       SELECT source, fetched_at, CASE WHEN run > 0 THEN since ELSE coalesce(fc, fg, fm) END AS freshness,
              CASE WHEN run > 0 THEN 'observed' WHEN fc IS NOT NULL THEN 'commit' WHEN fg IS NOT NULL THEN 'generated' WHEN fm IS NOT NULL THEN 'last-modified' ELSE 'unknown' END AS evidence FROM s""",
)
def freshness_history(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    stamp = lambda n, days: F.when(F.col("event_id") % n == 0, F.expr(f"ts - INTERVAL {days} DAY"))
    docs = rows.select(F.col("user_id").alias("source"), F.col("ts").alias("fetched_at"), F.col("event_type").alias("hash"), stamp(3, 1).alias("commit_at"), stamp(4, 2).alias("generated_at"), stamp(5, 3).alias("modified_at"))
    return evidence.freshness_history(docs)


_GROUPS = "CASE c_custkey % 4 WHEN 0 THEN {a}'khel'{z} WHEN 1 THEN {a}'COMMON', 'JIO'{z} WHEN 2 THEN {a}'COMMON', 'JIO', 'KHEL'{z} ELSE {a}' fancode ', '', 'NONE'{z} END"
_BUCKET = _case("s_nationkey % 4", ("COMMON", "JIO", "KHEL", "FANCODE"))


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.selectExpr("'t' || c_custkey AS name", _GROUPS.format(a="array(", z=")") + " AS source_groups")


def _catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some dozens of catalogs by bucket, however many suppliers there are."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(f"{_BUCKET} AS bucket", "s_suppkey % 30 AS source_ord", "'https://s' || s_suppkey % 30 || '.test/l' AS url")


SCOPE_SQL = f"""
    SELECT name, group_ord, source_group, context, source_ord, url, CASE WHEN context IS NULL THEN 'shared group needs one other group' WHEN url IS NULL THEN 'no catalogs' ELSE '' END AS error FROM (
        SELECT t.*, s.source_ord, s.url FROM (
            SELECT name, generate_subscripts(gs, 1)::INT - 1 AS group_ord, unnest(gs) AS source_group, CASE WHEN unnest(gs) <> 'COMMON' THEN unnest(gs) WHEN len(gs) = 2 THEN list_filter(gs, lambda x: x <> 'COMMON')[1] END AS context
            FROM (SELECT 't' || c_custkey AS name, [upper(trim(x)) FOR x IN {_GROUPS.format(a="[", z="]")} IF x <> ''] AS gs FROM customer)) t
        LEFT JOIN (SELECT {_BUCKET} AS bucket, min(s_suppkey % 30) AS source_ord, 'https://s' || (s_suppkey % 30) || '.test/l' AS url FROM supplier GROUP BY ALL) s ON s.bucket = t.source_group AND t.context IS NOT NULL)"""


@query("resolve_scope", SCOPE_SQL)
def resolve_scope(spark, sf_dir):
    return scope.resolve_scope(_searches(spark, sf_dir), _catalogs(spark, sf_dir))


@query(
    "diff_targets",
    """WITH a AS (SELECT c_name AS name, c_mktsegment AS policy, c_nationkey AS owner FROM customer WHERE c_custkey % 7 <> 0),
            b AS (SELECT c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'ALL' ELSE c_mktsegment END AS policy, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS owner FROM customer WHERE c_custkey % 5 <> 0)
       SELECT name, 'added' AS change, '' AS fields FROM b WHERE name NOT IN (SELECT name FROM a) UNION ALL SELECT name, 'removed', '' FROM a WHERE name NOT IN (SELECT name FROM b)
       UNION ALL SELECT name, 'updated', concat_ws(',', CASE WHEN a.policy IS DISTINCT FROM b.policy THEN 'policy' END, CASE WHEN a.owner IS DISTINCT FROM b.owner THEN 'owner' END) FROM a JOIN b USING (name) WHERE a.policy IS DISTINCT FROM b.policy OR a.owner IS DISTINCT FROM b.owner""",
)
def diff_targets(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    before = rows.where("c_custkey % 7 <> 0").selectExpr("c_name AS name", "c_mktsegment AS policy", "c_nationkey AS owner")
    after = rows.where("c_custkey % 5 <> 0").selectExpr("c_name AS name", "CASE WHEN c_custkey % 3 = 0 THEN 'ALL' ELSE c_mktsegment END AS policy", "CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END AS owner")
    return scope.diff_targets(before, after, ("policy", "owner"))


PLAN_SQL = f"""
    WITH r AS ({RANKED_SQL}), p AS ({_PLACED}), x AS (SELECT * FROM p WHERE place = 1 AND n_ok > 0),
         c AS (SELECT *, 't' || (entry_index % 4) AS target, CASE WHEN entry_index % 4 = 3 THEN NULL ELSE entry_index % 4 * 30 END AS duration FROM x UNION ALL SELECT *, 't' || (4 + preferred), 45 + preferred FROM x)
    SELECT identity_key, playlist_url, entry_index, string_agg(target, ',' ORDER BY target) AS targets, CASE WHEN NOT bool_or(duration IS NULL) THEN max(duration)::INT END AS duration_min FROM c GROUP BY ALL"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.keyed(spark, sf_dir)
    own = F.struct(F.concat(F.lit("t"), (F.col("entry_index") % 4).cast("string")).alias("target"), F.when(F.col("entry_index") % 4 != 3, F.col("entry_index") % 4 * 30).cast("int").alias("duration_min"))
    wide = F.struct(F.concat(F.lit("t"), (F.col("preferred") + 4).cast("string")).alias("target"), (F.col("preferred") + 45).cast("int").alias("duration_min"))
    return scope.launch_plan(rows.select("*", F.inline(F.array(own, wide))), NOW)


@query("launch_plan", PLAN_SQL)
def launch_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(
    "recovery_scope",
    f"""SELECT identity_key, name AS target, source_group, string_agg(url, ',' ORDER BY source_ord) AS urls FROM (SELECT identity_key, unnest(string_split(targets, ',')) AS name FROM ({PLAN_SQL})) JOIN ({SCOPE_SQL}) USING (name)
        WHERE error = '' AND context = split_part(identity_key, '|', 1) GROUP BY ALL""",
)
def recovery_scope(spark, sf_dir):
    return scope.recovery_scope(_plan(spark, sf_dir), scope.resolve_scope(_searches(spark, sf_dir), _catalogs(spark, sf_dir)))


@query(
    "display_order",
    f"""WITH r AS ({RANKED_SQL}), f AS (SELECT identity_key, count(*) FILTER (state <> 'WORKING') AS unusable, bool_or(state = 'WORKING') AS works, bool_or(video_bitrate_bps % 97 = 0) AS final, count(*) AS n, min(entry_index) AS first FROM r GROUP BY 1)
        SELECT identity_key, CASE WHEN final THEN 1 WHEN works THEN 0 ELSE 2 END AS category, unusable, (n % 2 = 0)::INT AS is_old, CASE WHEN n % 2 = 0 THEN first ELSE 0 END AS place FROM f""",
)
def display_order(spark, sf_dir):
    rows = catalog.keyed(spark, sf_dir)
    previous = rows.groupBy("identity_key").agg(F.count("*").alias("n"), F.min("entry_index").alias("place")).where("n % 2 = 0").select("identity_key", "place")
    return display.display_order(rows, rows.where("video_bitrate_bps % 97 = 0"), previous)


@query(
    "overlay_status",
    f"""WITH e AS ({KEYED_SQL}), o AS (SELECT identity_key, playlist_url, min(entry_index) AS only_index FROM e GROUP BY ALL HAVING count(*) = 1)
        SELECT identity_key, playlist_url, entry_index, 'RECORDING' AS worker_state FROM e WHERE entry_index % 10 = 0
        UNION ALL SELECT e.identity_key, e.playlist_url, only_index, 'WAITING' FROM e JOIN o USING (identity_key, playlist_url) WHERE entry_index % 10 = 5""",
)
def overlay_status(spark, sf_dir):
    rows = catalog.keyed(spark, sf_dir)
    same = rows.where("entry_index % 10 = 0").select("identity_key", *display.ROW, F.lit("RECORDING").alias("worker_state"))
    moved = rows.where("entry_index % 10 = 5").withColumn("entry_title", F.concat("entry_title", F.lit(" new"))).select("identity_key", *display.ROW, F.lit("WAITING").alias("worker_state"))
    return display.overlay_status(rows, same.unionByName(moved))


@query(
    "probe_status",
    f"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN expiry <= {NOW} THEN 'expired' WHEN video_height = 480 THEN 'unsupported' WHEN entry_index % 7 = 0 THEN 'drm_key_missing' WHEN entry_index % 11 = 0 THEN 'drm_check_failed'
            WHEN probe_status = 'probe_failed' THEN probe_status WHEN launchable THEN 'working' ELSE 'unsupported' END AS status FROM ({KEYED_SQL})) GROUP BY 1""",
)
def probe_status(spark, sf_dir):
    rows = catalog.keyed(spark, sf_dir)
    failed = F.when(F.col("probe_status") == "probe_failed", F.col("probe_status"))
    status = policy.probe_status(F.col("expiry") <= NOW, F.col("video_height") == 480, F.col("entry_index") % 7 == 0, F.col("entry_index") % 11 == 0, failed, F.col("launchable"))
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(
    "split_url_metadata",
    f"SELECT playlist_url, entry_index, split_part(stream_url, '|', 1) AS url, 'x' AS UA, split_part(entry_title, ' ', 2) || '+' || group_title AS Cookie FROM ({KEYED_SQL})",
)
def split_url_metadata(spark, sf_dir):
    rows = catalog.keyed(spark, sf_dir)
    full = F.concat("stream_url", F.lit("&cookie="), F.split_part("entry_title", F.lit(" "), F.lit(2)), F.lit("%2B"), F.col("group_title"), F.lit("&Origin=&bare"))
    return rows.select("playlist_url", "entry_index", headers.split_url_metadata(full).alias("x")).select("playlist_url", "entry_index", "x.url", F.col("x.headers")["UA"].alias("UA"), F.col("x.headers")["Cookie"].alias("Cookie"))


@query("playback_fingerprint", """SELECT page_id, sha256('{"final_manifest_url":"' || url || '","headers":{"authorization":"","cookie":"c' || page_id || '","origin":"","referer":""}}') AS fingerprint FROM pages""")
def playback_fingerprint(spark, sf_dir):
    given = F.create_map(F.lit("COOKIE"), F.concat(F.lit(" c"), F.col("page_id").cast("string")), F.lit("Accept"), F.lit("x"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", headers.playback_fingerprint(F.col("url"), given).alias("fingerprint"))


_WANTED = f"SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER})::INT - 1 AS stream FROM ({_ROWS})"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A probe's answer per order, its lines as streams; odd orders wish for the size and rate of their first line."""
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lanework_lineitem")
    rows = spark.sql(_ROWS.replace("FROM lineitem", "FROM lanework_lineitem"))
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "b", "w", "h", "f")))
    orders = rows.groupBy("l_orderkey").agg(listed.alias("x"))
    stream = lambda x: F.struct(x["w"].alias("width"), x["h"].alias("height"), F.concat(x["f"].cast("string"), F.lit("/1")).alias("avg_frame_rate"), x["b"].cast("string").alias("bit_rate"))
    wish = lambda c: F.when(F.col("l_orderkey") % 2 == 1, F.col("x")[0][c])
    text = F.to_json(F.struct(F.transform("x", stream).alias("streams"), F.struct(F.lit("0").alias("bit_rate")).alias("format")))
    return orders.select(F.concat(F.lit("m"), F.col("l_orderkey").cast("string")).alias("manifest_url"), text.alias("text"), wish("w").alias("want_width"), wish("h").alias("want_height"), wish("f").alias("want_fps"))


@query(
    "stream_probe_rows",
    f"""WITH v AS (SELECT *, CASE WHEN l_orderkey % 2 = 1 THEN first_value(w) OVER o ELSE 0 END AS ww, CASE WHEN l_orderkey % 2 = 1 THEN first_value(h) OVER o ELSE 0 END AS wh, CASE WHEN l_orderkey % 2 = 1 THEN first_value(f) OVER o ELSE 0 END AS wf
                   FROM ({_WANTED}) WINDOW o AS (PARTITION BY l_orderkey ORDER BY stream)),
             z AS (SELECT *, ((ww <= 0 OR wh <= 0 OR (w = ww AND h = wh)) AND (wf <= 0 OR (f > 0 AND abs(f - wf) <= 0.05)))::INT AS fits FROM v),
             k AS (SELECT *, sum(fits) OVER (PARTITION BY l_orderkey)::INT AS matched, row_number() OVER (PARTITION BY l_orderkey ORDER BY fits DESC, (f > 0 OR h > 0 OR b > 0) DESC, CASE WHEN f >= 50 THEN 2 WHEN f > 0 THEN 1 ELSE 0 END DESC,
                          CASE WHEN h >= 2160 THEN 2160 WHEN h >= 1440 THEN 1440 WHEN h >= 1080 THEN 1080 WHEN h >= 720 THEN 720 ELSE 0 END DESC, least(f, 50) DESC, w * h DESC, h DESC, w DESC, b DESC, stream) AS place FROM z)
        SELECT 'm' || l_orderkey AS manifest_url, stream, w AS width, h AS height, f AS fps, b AS bitrate, matched FROM k WHERE place = 1""",
)
def stream_probe_rows(spark, sf_dir):
    return manifests.stream_probe_rows(_probes(spark, sf_dir))


@query(
    "dash_representations",
    f"SELECT 'm' || l_orderkey AS manifest_url, 'r' || l_partkey AS id, w AS width, h AS height, f AS fps, b AS bitrate, 'avc' AS codecs, 'progressive' AS scan, (1000 + l_orderkey % 50)::BIGINT AS expiry, l_orderkey % 3 = 0 AS protected FROM ({_ROWS})",
)
def dash_representations(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lanework_lineitem")
    rows = spark.sql(_ROWS.replace("FROM lineitem", "FROM lanework_lineitem"))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    one = text('<Representation id="r', F.col("l_partkey"), '" bandwidth="', F.col("b"), '" width="', F.col("w"), '" height="', F.col("h"), '" frameRate="', F.col("f"), '"><BaseURL>v.mp4?expires=9999</BaseURL></Representation>')
    body = rows.groupBy("l_orderkey").agg(F.array_join(F.collect_list(one), "").alias("body"))
    guard = F.when(F.col("l_orderkey") % 3 == 0, '<ContentProtection schemeIdUri="urn:x"/>').otherwise("")
    head = text('<MPD xmlns="urn:mpeg:dash:schema:mpd:2011"><BaseURL>https://c.test/?exp=', F.col("l_orderkey") % 50 + 1000, '</BaseURL><Period><AdaptationSet contentType="video" codecs="avc" scanType="progressive">')
    docs = body.select(text("m", F.col("l_orderkey")).alias("manifest_url"), text(head, guard, F.col("body"), "</AdaptationSet></Period></MPD>").alias("text"))
    return manifests.dash_representations(docs)


@query(
    "merge_probe_evidence",
    f"""SELECT playlist_url, entry_index, CASE WHEN video_fps <= 0 THEN 25.0 ELSE video_fps END AS fps, CASE WHEN video_height <= 0 THEN 720 ELSE video_height END AS height, CASE WHEN video_width <= 0 THEN 1280 ELSE video_width END AS width,
               video_bitrate_bps AS bitrate, CASE WHEN video_fps <= 0 THEN 'probe' ELSE 'manifest' END AS fps_source, CASE WHEN video_height <= 0 THEN 'manifest+probe' ELSE 'manifest' END AS resolution_source, 'manifest' AS bitrate_source,
               CASE WHEN video_scan_type = '' THEN 'interlaced' ELSE video_scan_type END AS scan, CASE WHEN video_scan_type = '' THEN 'probe' ELSE '' END AS scan_source, true AS known FROM ({KEYED_SQL})""",
)
def merge_probe_evidence(spark, sf_dir):
    rows = catalog.keyed(spark, sf_dir)
    given = {"fps": F.col("video_fps"), "width": F.col("video_width"), "height": F.col("video_height"), "bitrate": F.col("video_bitrate_bps"), "scan": F.col("video_scan_type"), "scan_source": F.lit("")}
    given |= {k: F.lit("manifest") for k in ("fps_source", "resolution_source", "bitrate_source")}
    probe = {"fps": F.lit(25.0), "width": F.lit(1280), "height": F.lit(720), "bitrate": F.lit(5_000_000), "scan": F.lit("tt"), "bitrate_source": F.lit("stream")}
    merged = manifests.merge_probe_evidence(given, probe)
    return rows.select("playlist_url", "entry_index", *(c.alias(k) for k, c in merged.items()))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/[e]vents.parquet")


@query("stream_freshness", ORACLES["freshness_history"])
def stream_freshness(spark, sf_dir):
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    stamp = lambda n, days: F.when(F.col("event_id") % n == 0, micros(F.expr(f"ts - INTERVAL {days} DAY")))
    docs = _event_stream(spark, sf_dir).select(F.col("user_id").alias("source"), micros(F.col("ts")).alias("fetched_at"), F.col("event_type").alias("hash"), stamp(3, 1).alias("commit_at"), stamp(4, 2).alias("generated_at"), stamp(5, 3).alias("modified_at"))
    back = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return jobs.drain(jobs.freshness(docs), "append", "freshness").select("source", back("fetched_at"), back("freshness"), "evidence")


#: Each kind of event as a scan's verdict on a feed, with the metadata of its newer rows.
VERDICTS = {"signup": ("eligible", []), "view": ("single", ["match one"]), "click": ("single", ["match one live", "x"]), "purchase": ("confirmed", ["match one live"]), "error": ("single", ["other"])}


@query("stream_transitions", None)
def stream_transitions(spark, sf_dir):
    verdict = F.create_map(*(F.lit(x) for k, v in VERDICTS.items() for x in (k, v[0])))
    values = F.create_map(*(x for k, v in VERDICTS.items() for x in (F.lit(k), F.array(*map(F.lit, v[1])).cast("array<string>"))))
    rows = _event_stream(spark, sf_dir).select(F.concat(F.lit("feed"), F.col("user_id").cast("string")).alias("identity_key"), F.col("event_id").alias("n"), verdict[F.col("event_type")].alias("verdict"), values[F.col("event_type")].alias("values"))
    return jobs.drain(jobs.transitions(rows), "append", "transitions")


@query(
    "quality_groups",
    f"""WITH r AS (SELECT *, CASE WHEN provider = 'SONY' THEN 'SONYLIV' ELSE provider END || regexp_extract(stream_url, '^https://[^/]*(/[^?|]*)', 1) AS path FROM ({RANKED_SQL})),
             k AS (SELECT *, count(*) OVER g AS n, row_number() OVER (g ORDER BY (video_bitrate_bps > 0) DESC, (video_height > 0 AND video_fps > 0) DESC, (video_scan_type <> '') DESC, playlist_url, entry_index) AS place
                   FROM r WINDOW g AS (PARTITION BY identity_key, path, video_width, video_height, video_fps))
        SELECT identity_key, signature AS quality, count(*) AS renditions, sum(n)::BIGINT AS observations, max(area) AS area, round(max(video_fps), 3) AS fps, max(video_bitrate_bps) AS bitrate FROM k WHERE place = 1 GROUP BY ALL""",
)
def quality_groups(spark, sf_dir):
    return display.quality_groups(catalog.keyed(spark, sf_dir))


#: Entries whose titles hold numbered events with and without a blank, and a saved search for every customer.
_LISTED = """
    SELECT l_orderkey * 8 + l_linenumber AS entry_index, CAST(floor(l_extendedprice) AS BIGINT) AS price, 'G' || {n}(l_suppkey % 25 AS {t}) AS source_group,
           'Match' || CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE ' ' END || {n}(l_partkey % 40 AS {t}) || CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN ' Live!' ELSE ': Extra-' || {n}(l_suppkey % 3 AS {t}) END AS entry_title,
           CASE WHEN l_partkey % 4 = 0 THEN 'CH-' || {n}(l_partkey % 7 AS {t}) ELSE '' END AS tvg_name, '/live/' || {n}(l_partkey % 9 AS {t}) || '/hd' AS path
    FROM {l}"""
_WANTED = """
    SELECT 't' || {n}(c_custkey AS {t}) AS name, {a}'G' || {n}(c_nationkey AS {t}), 'G' || {n}(c_custkey % 25 AS {t}){z} AS source_groups, c_custkey % 50 = 0 AS match_all,
           CASE WHEN c_custkey % 3 = 0 THEN {a}{a}'Match ' || {n}(c_custkey % 40 AS {t}), 'match' || {n}(c_custkey % 11 AS {t}){z}, {a}'live', 'e', ''{z}{z} ELSE {a}{a}'MATCH ' || {n}(c_custkey % 40 AS {t}), 'live {slash} 3 hd'{z}{z} END AS {q}primary{q},
           CASE WHEN c_custkey % 5 = 0 THEN {a}{a}'Match'{z}, {a}'ch-' || {n}(c_custkey % 7 AS {t}), 'extra 1'{z}{z} WHEN c_custkey % 50 = 1 THEN {a}{a}' '{z}{z} END AS required,
           CASE WHEN c_custkey % 4 = 0 THEN {a}{a}'extra ' || {n}(c_custkey % 3 AS {t}){z}{z} END AS rejected, {a}{a}'live'{z}, {a}'ch 1', 'ch 2'{z}, {a}'3'{z}{z} AS preferred
    FROM {c}"""
_DUCK = {"q": '"', "n": "CAST", "t": "VARCHAR", "a": "[", "z": "]", "slash": "/"}
_SPARK = {"q": "`", "n": "CAST", "t": "STRING", "a": "array(", "z": ")", "slash": "/"}
_PLAIN_GROUPS = "list_filter(list_transform(coalesce({c}, []), lambda g: list_filter(list_transform(g, lambda p: trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g'))), lambda p: p <> '')), lambda g: len(g) > 0)"
_PLAIN_TARGETS = f"SELECT name AS target, source_groups, CASE WHEN match_all THEN [] ELSE {_PLAIN_GROUPS.format(c='"primary"')} END AS needed, {', '.join(f'{_PLAIN_GROUPS.format(c=c)} AS {c}' for c in ('required', 'rejected', 'preferred'))} FROM ({_WANTED.format(c='customer', **_DUCK)})"
_PLAIN_TEXT = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _all_sql(groups: str, test: str) -> str:
    return f"len(list_filter({groups}, lambda g: len(list_filter(g, lambda p: {test})) = 0)) = 0"


def _some_sql(groups: str, test: str) -> str:
    return f"len(list_filter({groups}, lambda g: len(list_filter(g, lambda p: {test})) > 0))"


_WORDED = "contains(' ' || {x} || ' ', ' ' || p || ' ')"


def _listed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    for name in ("lineitem", "customer"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"lanework_{name}")
    return spark.sql(_LISTED.format(l="lanework_lineitem", **_SPARK)), spark.sql(_WANTED.format(c="lanework_customer", **_SPARK))


@query(
    "match_targets",
    f"""WITH e AS (SELECT *, {_PLAIN_TEXT.format(x="tvg_name || ' ' || entry_title")} AS text, {_PLAIN_TEXT.format(x="tvg_name || ' ' || entry_title || ' ' || path")} AS whole FROM ({_LISTED.format(l='lineitem', **_DUCK)})),
             u AS (SELECT DISTINCT text, whole, source_group FROM e), t AS ({_PLAIN_TARGETS}),
             m AS (SELECT text, whole, source_group, target, {_some_sql('preferred', _WORDED.format(x='text'))}::INT AS score FROM u JOIN t ON list_contains(source_groups, source_group)
                   WHERE {_all_sql('needed', 'contains(whole, p)')} AND {_all_sql('required', _WORDED.format(x='text'))} AND {_some_sql('rejected', _WORDED.format(x='text'))} = 0)
        SELECT entry_index, price, e.source_group, target, score FROM e JOIN m ON m.text = e.text AND m.whole = e.whole AND m.source_group = e.source_group""",
)
def match_targets(spark, sf_dir):
    rows, wanted = _listed(spark, sf_dir)
    rows = rows.withColumn("title", F.concat_ws(" ", F.nullif("tvg_name", F.lit("")), "entry_title"))
    return phrases.match_targets(rows, wanted).select("entry_index", "price", "source_group", "target", "score")


_AFTER_WORD = "regexp_matches({x}, '(^| )' || p || CASE WHEN regexp_matches(p, '[a-z]$') THEN '($|[ 0-9])' ELSE '($| )' END)"


def _field_sql(field: str) -> str:
    good = " AND ".join((f"{field} <> ''", _all_sql("needed", _AFTER_WORD.format(x=field)), _all_sql("required", _WORDED.format(x=field))))
    return f"CASE WHEN {good} THEN {_some_sql('preferred', _WORDED.format(x=field))}::INT END"


@query(
    "match_channel_targets",
    f"""WITH e AS (SELECT *, {_PLAIN_TEXT.format(x='tvg_name')} AS a, {_PLAIN_TEXT.format(x='entry_title')} AS b FROM ({_LISTED.format(l='lineitem', **_DUCK)})),
             u AS (SELECT DISTINCT a, b, source_group FROM e), t AS ({_PLAIN_TARGETS}),
             m AS (SELECT a, b, source_group, target, greatest({_field_sql('a')}, {_field_sql('b')}) AS score FROM u JOIN t ON list_contains(source_groups, source_group)
                   WHERE {_some_sql('rejected', _WORDED.format(x="trim(a || ' ' || b)"))} = 0)
        SELECT entry_index, price, e.source_group, target, score FROM e JOIN m ON m.a = e.a AND m.b = e.b AND m.source_group = e.source_group WHERE score IS NOT NULL""",
)
def match_channel_targets(spark, sf_dir):
    rows, wanted = _listed(spark, sf_dir)
    return phrases.match_channel_targets(rows, wanted).select("entry_index", "price", "source_group", "target", "score")


#: Addresses of pages as the links of a chain, some of them without a path that names anything, and hints.
_LINKS = """
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'sony' WHEN 1 THEN 'x' ELSE ' ' END AS provider, 'https://l' || {n}(page_id % 4 AS {t}) || '.test' AS playlist_url, page_id % 9 AS entry_index,
           CASE WHEN page_id % 5 = 0 THEN url || '|UA=1' WHEN page_id % 5 = 1 THEN 'https://h.test/only.m3u8' END AS final_stream_url, CASE WHEN page_id % 7 = 0 THEN url || '/deep//er/x.mpd?t=1' WHEN page_id % 7 = 1 THEN ' ' END AS manifest_final_url,
           CASE WHEN page_id % 4 = 0 THEN 'no-scheme/a/b' WHEN page_id % 4 = 1 THEN 'https://h.test?q=/a/b' END AS effective_url, CASE WHEN page_id % 6 = 0 THEN url END AS stream_url, CASE WHEN page_id % 6 = 1 THEN 'HTTPS://H.test//a.b/c/d.e' END AS raw_stream_url,
           CASE WHEN page_id % 10 = 3 THEN ' hint' || {n}(page_id % 50 AS {t}) || ' ' END AS provider_identity_hint
    FROM {l}"""
_BARE = "trim(split_part(coalesce({u}, ''), '|', 1))"
_KEPT = "list_filter(string_split(regexp_extract(" + _BARE + ", '^[^:/?#]+://[^/?#]+(/[^?#]*)', 1), '/'), lambda x: x <> '')"
_LANE = f"(SELECT CASE WHEN len(k) > 0 THEN '/' || array_to_string(k, '/') END FROM (SELECT CASE WHEN len(p) > 0 AND regexp_matches(p[len(p)], '\\.[^./]+$') THEN p[1:len(p) - 1] ELSE p END AS k FROM (SELECT {_KEPT} AS p)))"
_STRICT = """CASE WHEN regexp_matches(g, '^[^:/?#]+://[^/?#]+') THEN 'opaque-url:' || sha256(lower(regexp_extract(g, '^([^:/?#]+)://', 1)) || '://' || lower(regexp_extract(g, '^[^:/?#]+://([^/?#]*)', 1)) ||
    coalesce(nullif(regexp_replace(regexp_extract(g, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g'), ''), '/') || CASE WHEN contains(g, '?') THEN '?' || split_part(split_part(g, '?', 2), '#', 1) ELSE '' END) ELSE 'literal:' || g END"""


@query(
    "resolved_identity",
    f"""WITH r AS ({_LINKS.format(n="CAST", t="VARCHAR", l="pages")}),
             a AS (SELECT *, trim(coalesce(provider_identity_hint, '')) AS hint, [{', '.join(f"{{'c': '{c}', 'v': {_LANE.format(u=c)}}}" for c in identity.ADDRESSES)}] AS lanes, [{', '.join(f"{{'c': '{c}', 'v': {_BARE.format(u=c)}}}" for c in identity.ADDRESSES)}] AS given FROM r),
             b AS (SELECT *, list_filter(lanes, lambda x: x.v IS NOT NULL)[1] AS lane, list_filter(given, lambda x: x.v <> '')[1] AS f FROM a), d AS (SELECT *, f.v AS g FROM b)
        SELECT page_id, CASE WHEN provider = 'sony' THEN 'SONYLIV' WHEN trim(provider) = '' THEN 'UNKNOWN' ELSE upper(provider) END || '|' ||
               CASE WHEN lane IS NOT NULL THEN lane.v WHEN hint <> '' THEN 'provider-hint:' || sha256(hint) WHEN g IS NOT NULL THEN {_STRICT} ELSE 'unresolved:' || sha256(playlist_url || '|' || CASE WHEN entry_index = 0 THEN '' ELSE entry_index::VARCHAR END) END AS identity_key,
               CASE WHEN lane IS NOT NULL THEN 'path' WHEN hint <> '' THEN 'provider' WHEN g IS NOT NULL THEN 'conservative' ELSE 'unresolved' END AS confidence,
               CASE WHEN lane IS NOT NULL THEN lane.c WHEN hint <> '' THEN 'provider_identity_hint' WHEN g IS NOT NULL THEN f.c ELSE 'playlist_url' END AS named_by FROM d""",
)
def resolved_identity(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("lanework_pages")
    rows = spark.sql(_LINKS.format(n="CAST", t="STRING", l="lanework_pages"))
    return identity.resolved_identity(rows).select("page_id", "identity_key", "confidence", "named_by")
