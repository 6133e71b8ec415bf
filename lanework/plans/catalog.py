"""Catalog queries over the carriers, each with the SQL that says the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanework.functions import quality, states, urls
from lanework.operators import aggregate, changes, identity, join, match, ownership, parse, select
from lanework.plans import carriers
from lanework.plans.carriers import EVENTS_SQL, KEYED_SQL, NOW

QUERIES: dict = {}
ORACLES: dict = {}

TARGETS = [
    {"name": "t1", "primary": [["the", "les"], ["on", "en"]], "rejected": [["this"]], "preferred": [["of"], ["and", "or"]]},
    {"name": "t2", "match_all": True, "required": [["of", "de"]], "preferred": [["the"]]},
    {"name": "t3", "primary": [["en/", "en "]], "required": [["in", "der"]], "rejected": [["a", "la"], ["und"]]},
]


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.feed_identity(carriers.entries(spark, sf_dir))


_SCAN = "CASE lower(video_scan_type) WHEN 'progressive' THEN 'progressive' WHEN 'tt' THEN 'interlaced' ELSE '' END"
_MOTION = f"least(CASE WHEN {_SCAN} = 'interlaced' AND video_fps <= 25.01 THEN video_fps * 2 ELSE video_fps END, 50.0)"
_CLASS = "CASE WHEN video_height >= 2160 THEN 2160 WHEN video_height >= 1440 THEN 1440 WHEN video_height >= 1080 THEN 1080 WHEN video_height >= 720 THEN 720 ELSE 0 END"
_ALLOW = "provider IN ('SONY', 'FANCODE', 'JIO', 'KHEL')"
RANKED_SQL = f"""
    SELECT *, {_SCAN} AS scan, {_MOTION} AS motion, {_CLASS} AS class, CASE WHEN {_MOTION} >= 50 THEN 2 WHEN {_MOTION} > 0 THEN 1 ELSE 0 END AS motion_class,
           CASE {_SCAN} WHEN 'progressive' THEN 2 WHEN 'interlaced' THEN 1 ELSE 0 END AS scan_rank, video_width::BIGINT * video_height AS area,
           (expiry IS NOT NULL OR {_ALLOW}) AS ok, (expiry IS NOT NULL OR {_ALLOW}) AND (expiry IS NULL OR expiry - {NOW} >= 900) AS safe,
           (provider = 'FANCODE' AND expiry IS NULL)::INT AS unknown_first, coalesce(expiry, 0)::BIGINT AS until,
           CASE WHEN launchable AND expiry IS NULL AND NOT ({_ALLOW}) THEN 'AUTH_UNKNOWN' WHEN launchable THEN 'WORKING' WHEN probe_status = 'expired' THEN 'EXPIRED'
                WHEN access_blocked THEN 'ACCESS_BLOCKED' WHEN probe_status = 'probe_failed' THEN 'PROBE_FAILED' ELSE 'UNUSABLE' END AS state,
           video_width || '/' || video_height || '/' || printf('%.3f', video_fps) || '/' || video_bitrate_bps || '/' || ({_SCAN}) AS signature
    FROM ({KEYED_SQL})
"""
_QUALITY = "motion_class {d}, class {d}, motion {d}, scan_rank {d}, area {d}, video_height {d}, video_width {d}, video_bitrate_bps {d}"
_DOWN = _QUALITY.format(d="DESC")
_ROW = "(1, motion_class, class, motion, scan_rank, area, video_height, video_width, video_bitrate_bps)"
_PLACED = f"""
    SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY ok DESC, safe DESC, preferred DESC, {_DOWN}, unknown_first DESC, until DESC, playlist_url, entry_index) AS place,
           count(*) OVER f AS considered, count(*) FILTER (ok) OVER f AS n_ok, count(*) FILTER (safe) OVER f AS n_safe
    FROM r WHERE launchable WINDOW f AS (PARTITION BY identity_key)
"""


@query(
    "select_best",
    f"""
    WITH r AS ({RANKED_SQL}), p AS ({_PLACED})
    SELECT identity_key, CASE WHEN n_ok > 0 THEN playlist_url END AS playlist_url, CASE WHEN n_ok > 0 THEN entry_index END AS entry_index, CASE WHEN n_ok > 0 THEN stream_url END AS selected_url,
           CASE WHEN n_ok = 0 THEN 'no_eligible_candidates' ELSE 'selected' END AS decision, n_ok > 0 AND n_safe = 0 AS fallback_used, considered,
           CASE WHEN n_safe > 0 THEN n_safe ELSE n_ok END AS eligible
    FROM p WHERE place = 1""",
)
def select_best(spark, sf_dir):
    return select.select_best(keyed(spark, sf_dir), NOW)


@query(
    "explain_losers",
    f"""
    WITH r AS ({RANKED_SQL}), p AS ({_PLACED}),
         w AS (SELECT identity_key, playlist_url AS wu, entry_index AS wi, preferred AS wp, expiry AS we, video_bitrate_bps AS wb, {_ROW} AS wq,
                      (motion_class, class, motion, scan_rank, area, video_height, video_width) AS wh FROM p WHERE place = 1 AND n_ok > 0)
    SELECT identity_key, playlist_url, entry_index, 'not selected: ' || CASE
             WHEN (we IS NULL OR we - {NOW} >= 900) AND NOT (expiry IS NULL OR expiry - {NOW} >= 900) THEN 'less than 15 min remaining'
             WHEN preferred < wp THEN 'less preferred match'
             WHEN {_ROW} < wq AND (motion_class, class, motion, scan_rank, area, video_height, video_width) = wh AND video_bitrate_bps <= 0 THEN 'bitrate unknown'
             WHEN {_ROW} < wq THEN 'lower quality'
             WHEN {_ROW} = wq AND expiry < we THEN 'expires sooner'
             WHEN {_ROW} = wq AND expiry IS NULL AND we IS NOT NULL AND provider <> 'FANCODE' THEN 'expiry unknown'
             WHEN {_ROW} = wq AND expiry IS NOT NULL AND we IS NULL AND provider = 'FANCODE' THEN 'equal quality; unknown-expiry source preferred'
             WHEN {_ROW} = wq THEN 'equivalent alternative' ELSE 'another candidate ranked higher' END AS reason
    FROM p JOIN w USING (identity_key) WHERE playlist_url <> wu OR entry_index <> wi""",
)
def explain_losers(spark, sf_dir):
    return select.explain_losers(keyed(spark, sf_dir), NOW)


@query(
    "select_upgrade",
    f"""
    WITH r AS ({RANKED_SQL}),
         run AS (SELECT identity_key, max(preferred) AS rp, min({_ROW}) AS rq FROM r GROUP BY identity_key),
         c AS (SELECT r.*, row_number() OVER (PARTITION BY identity_key ORDER BY preferred DESC, {_DOWN}, unknown_first DESC, until DESC, playlist_url, entry_index) AS place,
                      count(*) OVER (PARTITION BY identity_key) AS eligible
               FROM r JOIN run USING (identity_key) WHERE launchable AND motion >= 25 AND safe AND preferred >= rp AND {_ROW} > rq)
    SELECT identity_key, playlist_url, entry_index, stream_url AS upgrade_url, eligible, preferred, round(motion, 3) AS motion, video_height AS height, video_bitrate_bps AS bitrate FROM c WHERE place = 1""",
)
def select_upgrade(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    running = rows.groupBy("identity_key").agg(F.max("preferred").alias("preferred"), F.min(identity.rank_of(rows)).alias("quality"))
    return select.select_upgrade(running, rows, NOW, 25.0)


@query("top_k_sources", f"WITH r AS ({RANKED_SQL}), p AS (SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY preferred DESC, {_DOWN}, unknown_first DESC, until DESC, playlist_url, entry_index) AS place FROM r WHERE launchable) SELECT identity_key, place, playlist_url, entry_index FROM p WHERE place <= 3")
def top_k_sources(spark, sf_dir):
    return select.top_k_sources(keyed(spark, sf_dir), 3)


@query("quality_rank", f"WITH r AS ({RANKED_SQL}) SELECT motion_class, class AS resolution_class, scan_rank, count(*) AS n, round(max(motion), 3) AS motion, max(area) AS area FROM r GROUP BY ALL")
def quality_rank(spark, sf_dir):
    rows = carriers.entries(spark, sf_dir)
    return rows.select(identity.rank_of(rows).alias("r")).groupBy("r.motion_class", "r.resolution_class", "r.scan_rank").agg(F.count("*").alias("n"), F.round(F.max("r.motion"), 3).alias("motion"), F.max("r.area").alias("area"))


@query("motion_fps", f"WITH r AS ({RANKED_SQL}) SELECT video_scan_type, round(video_fps, 3) AS fps, round(max(motion), 3) AS motion, count(*) AS n FROM r GROUP BY ALL")
def motion_fps(spark, sf_dir):
    rows = carriers.entries(spark, sf_dir)
    return rows.groupBy("video_scan_type", F.round("video_fps", 3).alias("fps")).agg(F.round(F.max(F.least(quality.motion_fps(F.col("video_fps"), F.col("video_scan_type")), F.lit(50.0))), 3).alias("motion"), F.count("*").alias("n"))


@query("candidate_state", f"WITH r AS ({RANKED_SQL}) SELECT provider, state, count(*) AS n FROM r GROUP BY ALL")
def candidate_state(spark, sf_dir):
    rows = carriers.entries(spark, sf_dir)
    return rows.groupBy("provider", identity.state_of(rows).alias("state")).agg(F.count("*").alias("n"))


@query("auth_expiry", f"SELECT playlist_url, min(CAST(regexp_extract(stream_url, 'exp=([0-9]+)', 1) AS BIGINT)) AS first_expiry, max(CAST(regexp_extract(stream_url, 'exp=([0-9]+)', 1) AS BIGINT)) AS last_expiry FROM ({KEYED_SQL}) GROUP BY 1")
def auth_expiry(spark, sf_dir):
    rows = carriers.entries(spark, sf_dir).select("playlist_url", urls.auth_expiry(F.col("stream_url")).alias("e"))
    return rows.groupBy("playlist_url").agg(F.min("e").alias("first_expiry"), F.max("e").alias("last_expiry"))


@query("feed_identity", f"SELECT identity_key, count(*) AS n FROM ({KEYED_SQL}) GROUP BY 1")
def feed_identity(spark, sf_dir):
    return keyed(spark, sf_dir).groupBy("identity_key").agg(F.count("*").alias("n"))


@query("group_by_identity", f"SELECT identity_key, count(*) AS members, string_agg(DISTINCT playlist_url, ',' ORDER BY playlist_url) AS catalogs FROM ({KEYED_SQL}) GROUP BY 1")
def group_by_identity(spark, sf_dir):
    return identity.group_by_identity(carriers.entries(spark, sf_dir))


_PATH = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g')"
_PARTS = f"list_filter(string_split({_PATH}, '/'), lambda x: x <> '')"


@query(
    "canonical_path",
    f"""
    WITH u AS (SELECT page_id, url, {_PARTS} AS parts FROM pages),
         d AS (SELECT *, CASE WHEN len(parts) > 0 AND regexp_matches(parts[-1], '\\.[^./]+$') THEN parts[:-2] ELSE parts END AS kept FROM u)
    SELECT page_id, CASE WHEN len(kept) > 0 THEN '/' || array_to_string(kept, '/') ELSE '' END AS lane, CASE WHEN len(parts) > 0 THEN '/' || array_to_string(parts, '/') ELSE '' END AS path,
           lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, CASE WHEN lower({_PATH}) LIKE '%.mpd%' THEN 'DASH' WHEN lower({_PATH}) LIKE '%.m3u8%' THEN 'HLS' ELSE '' END AS stream_type, 'opaque-url:' AS key_kind
    FROM d""",
)
def canonical_path(spark, sf_dir):
    return parse.page_identity(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query(
    "dedupe_observations",
    f"""SELECT identity_key, playlist_url, stream_url, tvg_name, group_title, entry_title, preferred, entry_index, copies FROM (
        SELECT *, row_number() OVER (w ORDER BY preferred DESC, entry_index) AS place, count(*) OVER w AS copies FROM ({KEYED_SQL})
        WINDOW w AS (PARTITION BY identity_key, playlist_url, stream_url, tvg_name, group_title, entry_title)) WHERE place = 1""",
)
def dedupe_observations(spark, sf_dir):
    return aggregate.dedupe_observations(keyed(spark, sf_dir))


@query(
    "source_observations",
    f"""WITH r AS ({RANKED_SQL}) SELECT identity_key, playlist_url, coalesce(string_agg(DISTINCT entry_title, ',' ORDER BY entry_title), '') AS titles,
        coalesce(string_agg(DISTINCT nullif(tvg_name, ''), ',' ORDER BY nullif(tvg_name, '')), '') AS tvg_names, string_agg(DISTINCT group_title, ',' ORDER BY group_title) AS groups,
        string_agg(DISTINCT state, ',' ORDER BY state) AS states, CASE WHEN bool_or(state = 'WORKING') THEN 'WORKING' ELSE min(state) END AS state, count(*) AS observations,
        arg_min(entry_index, (state <> 'WORKING', -motion_class, -class, -motion, -scan_rank, -area, -video_height, -video_width, -video_bitrate_bps, entry_index)) AS best_index FROM r GROUP BY ALL""",
)
def source_observations(spark, sf_dir):
    return aggregate.source_observations(keyed(spark, sf_dir))


@query(
    "identity_blocks",
    f"""WITH r AS ({RANKED_SQL}), b AS (SELECT *, row_number() OVER (PARTITION BY identity_key ORDER BY state = 'WORKING' DESC, {_DOWN}) AS place FROM r)
        SELECT identity_key, count(*) AS observations, count(DISTINCT playlist_url) AS sources, count(*) FILTER (state = 'WORKING') AS working,
               coalesce(max(video_height) FILTER (place = 1 AND state = 'WORKING'), 0) AS best_height, coalesce(max(video_bitrate_bps) FILTER (place = 1 AND state = 'WORKING'), 0) AS best_bitrate,
               CASE WHEN bool_or(state = 'WORKING') THEN 'AVAILABLE' ELSE 'UNUSABLE' END AS overall_state FROM b GROUP BY 1""",
)
def identity_blocks(spark, sf_dir):
    return aggregate.identity_blocks(keyed(spark, sf_dir))


@query("provider_summary", f"SELECT split_part(identity_key, '|', 1) AS provider, count(DISTINCT identity_key) AS feeds, count(*) AS observations FROM ({KEYED_SQL}) GROUP BY 1")
def provider_summary(spark, sf_dir):
    return aggregate.provider_summary(keyed(spark, sf_dir))


@query("catalog_rollup", f"SELECT provider, group_title, (grouping(provider) * 2 + grouping(group_title))::INT AS level, count(*) AS observations, count(DISTINCT identity_key) AS feeds, max(video_bitrate_bps) AS best_bitrate FROM ({KEYED_SQL}) GROUP BY ROLLUP (provider, group_title)")
def catalog_rollup(spark, sf_dir):
    return aggregate.catalog_rollup(keyed(spark, sf_dir))


@query("catalog_counts", f"SELECT playlist_url, count(*) AS observed, count(*) FILTER (stream_url <> '') AS playable, count(*) FILTER (launchable) AS launchable, count(*) FILTER (expiry IS NULL) AS unknown_expiry FROM ({KEYED_SQL}) GROUP BY 1")
def catalog_counts(spark, sf_dir):
    return aggregate.catalog_counts(carriers.entries(spark, sf_dir))


@query("metadata_groups", f"SELECT identity_key, trim(regexp_replace(lower(entry_title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS title, count(*) AS rows, count(DISTINCT playlist_url) AS sources FROM ({KEYED_SQL}) GROUP BY ALL")
def metadata_groups(spark, sf_dir):
    return aggregate.metadata_groups(keyed(spark, sf_dir))


_SCANS = "s AS (SELECT scan_id, row_number() OVER (ORDER BY scan_id) AS n, count(*) OVER () AS last FROM (SELECT DISTINCT scan_id FROM e))"


@query(
    "diff_identities",
    f"""WITH e AS ({KEYED_SQL}), {_SCANS}, p AS (SELECT DISTINCT n, last, identity_key FROM e JOIN s USING (scan_id))
        SELECT identity_key, n, 'NEW' AS marker FROM p WHERE n > 1 AND NOT EXISTS (FROM p q WHERE q.identity_key = p.identity_key AND q.n = p.n - 1)
        UNION ALL SELECT identity_key, n + 1, 'REMOVED' FROM p WHERE n < last AND NOT EXISTS (FROM p q WHERE q.identity_key = p.identity_key AND q.n = p.n + 1)""",
)
def diff_identities(spark, sf_dir):
    return changes.diff_identities(keyed(spark, sf_dir))


@query(
    "diff_sources",
    f"""WITH e AS ({KEYED_SQL}), {_SCANS}, p AS (SELECT DISTINCT n, identity_key, playlist_url FROM e JOIN s USING (scan_id)), f AS (SELECT DISTINCT n, identity_key FROM p),
             b AS (SELECT f.n, f.identity_key FROM f JOIN f g ON f.identity_key = g.identity_key AND g.n = f.n - 1)
        SELECT p.identity_key, p.playlist_url, p.n, 'SOURCE+' AS marker FROM p JOIN b USING (n, identity_key) WHERE NOT EXISTS (FROM p q WHERE q.identity_key = p.identity_key AND q.playlist_url = p.playlist_url AND q.n = p.n - 1)
        UNION ALL SELECT p.identity_key, p.playlist_url, b.n, 'SOURCE-' FROM p JOIN b ON b.identity_key = p.identity_key AND b.n = p.n + 1 WHERE NOT EXISTS (FROM p q WHERE q.identity_key = p.identity_key AND q.playlist_url = p.playlist_url AND q.n = p.n + 1)""",
)
def diff_sources(spark, sf_dir):
    return changes.diff_sources(keyed(spark, sf_dir))


@query(
    "diff_blocks",
    f"""WITH e AS (SELECT *, CASE preferred WHEN 1 THEN 'MANUAL' ELSE 'ALL_IDENTITIES' END AS policy FROM ({KEYED_SQL})), {_SCANS},
             p AS (SELECT DISTINCT n, last, policy, identity_key FROM e JOIN s USING (scan_id)), f AS (SELECT DISTINCT n, identity_key FROM p)
        SELECT policy, identity_key, n, 'NEW' AS marker FROM p WHERE n > 1 AND NOT EXISTS (FROM f WHERE f.identity_key = p.identity_key AND f.n = p.n - 1)
        UNION ALL SELECT policy, identity_key, n + 1, 'REMOVED' FROM p WHERE n < last AND NOT EXISTS (FROM f WHERE f.identity_key = p.identity_key AND f.n = p.n + 1)""",
)
def diff_blocks(spark, sf_dir):
    return changes.diff_blocks(keyed(spark, sf_dir).withColumn("policy", F.when(F.col("preferred") == 1, "MANUAL").otherwise("ALL_IDENTITIES")))


@query(
    "diff_updates",
    f"""WITH e AS ({RANKED_SQL}), {_SCANS},
             o AS (SELECT n, identity_key, playlist_url, string_agg(DISTINCT entry_title, ' / ' ORDER BY entry_title) AS titles, string_agg(DISTINCT group_title, ' / ' ORDER BY group_title) AS groups,
                          coalesce(string_agg(DISTINCT nullif(tvg_name, ''), ' / ' ORDER BY nullif(tvg_name, '')), '-') AS names, string_agg(DISTINCT state, ' / ' ORDER BY state) AS states, bool_or(state = 'WORKING') AS works
                   FROM e JOIN s USING (scan_id) GROUP BY ALL),
             c AS (SELECT a.identity_key, a.playlist_url, a.n, a.states <> b.states AS state_changed,
                          concat_ws('; ', CASE WHEN a.titles <> b.titles THEN 'Event ' || b.titles || ' -> ' || a.titles END, CASE WHEN a.groups <> b.groups THEN 'Group ' || b.groups || ' -> ' || a.groups END,
                                    CASE WHEN a.names <> b.names THEN 'TVG ' || b.names || ' -> ' || a.names END, CASE WHEN a.states <> b.states THEN 'Candidate states ' || b.states || ' -> ' || a.states END) AS details
                   FROM o a JOIN o b ON a.identity_key = b.identity_key AND a.playlist_url = b.playlist_url AND b.n = a.n - 1),
             i AS (SELECT identity_key, n, bool_or(works) AS works FROM o GROUP BY ALL)
        SELECT identity_key, playlist_url, n, details FROM c WHERE details <> ''
        UNION ALL SELECT x.identity_key, NULL, x.n, 'Identity state ' || CASE WHEN x.works THEN 'UNUSABLE -> AVAILABLE' ELSE 'AVAILABLE -> UNUSABLE' END
        FROM i x JOIN i y ON x.identity_key = y.identity_key AND y.n = x.n - 1
        WHERE x.works <> y.works AND NOT EXISTS (FROM c WHERE c.identity_key = x.identity_key AND c.n = x.n AND c.state_changed)""",
)
def diff_updates(spark, sf_dir):
    return changes.diff_updates(keyed(spark, sf_dir))


_BEST = f"""e AS ({RANKED_SQL}), {_SCANS},
    g AS (SELECT n, identity_key, max(({_ROW}, signature)) AS best FROM e JOIN s USING (scan_id) WHERE launchable GROUP BY ALL),
    q AS (SELECT a.identity_key, a.n, CASE WHEN a.best[1] > b.best[1] THEN 'QUALITY+' WHEN a.best[2] <> b.best[2] THEN 'QUALITY-' END AS marker, b.best[2] AS was, a.best[2] AS "is"
          FROM g a JOIN g b ON a.identity_key = b.identity_key AND b.n = a.n - 1)"""
_BEST = _BEST.replace("{_SCANS}", _SCANS)


def _launchable_scans(sql: str) -> str:
    return sql.replace("FROM (SELECT DISTINCT scan_id FROM e)", "FROM (SELECT DISTINCT scan_id FROM e WHERE launchable)")


@query("diff_quality", _launchable_scans(f"WITH {_BEST} SELECT * FROM q WHERE marker IS NOT NULL"))
def diff_quality(spark, sf_dir):
    return changes.diff_quality(keyed(spark, sf_dir))


@query("collapse_changes", _launchable_scans(f'WITH {_BEST} SELECT identity_key, marker, was, "is", min(n) AS n, count(*) AS times FROM q WHERE marker IS NOT NULL GROUP BY ALL'))
def collapse_changes(spark, sf_dir):
    return changes.collapse_changes(changes.diff_quality(keyed(spark, sf_dir)))


@query(
    "row_last_updated",
    f"""WITH r AS ({RANKED_SQL}), g AS (SELECT scan_id, identity_key, playlist_url, entry_title, max(signature) AS sig FROM r GROUP BY ALL),
             l AS (SELECT *, lag(sig) OVER (PARTITION BY identity_key, playlist_url, entry_title ORDER BY scan_id) AS was FROM g)
        SELECT identity_key, playlist_url, entry_title, max(scan_id) FILTER (was IS DISTINCT FROM sig) AS updated_scan, count(*) AS scans FROM l GROUP BY ALL""",
)
def row_last_updated(spark, sf_dir):
    return changes.row_last_updated(keyed(spark, sf_dir))


@query(
    "last_known_quality",
    f"""WITH g AS (SELECT identity_key, scan_id, max(video_bitrate_bps) FILTER (launchable) AS bitrate FROM ({KEYED_SQL}) GROUP BY ALL)
        SELECT *, last_value(bitrate IGNORE NULLS) OVER (PARTITION BY identity_key ORDER BY scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known_bitrate FROM g""",
)
def last_known_quality(spark, sf_dir):
    return changes.last_known_quality(keyed(spark, sf_dir))


@query("source_numbers", f"WITH f AS (SELECT playlist_url, min((scan_id, entry_index)) AS f FROM ({KEYED_SQL}) GROUP BY 1) SELECT playlist_url, row_number() OVER (ORDER BY f, playlist_url)::INT AS number FROM f")
def source_numbers(spark, sf_dir):
    return changes.source_numbers(carriers.entries(spark, sf_dir))


@query(
    "fill_quality",
    f"""WITH k AS (SELECT *, CASE WHEN provider = 'SONY' THEN 'SONYLIV' ELSE provider END || '|' || regexp_extract(replace(stream_url, 'test//', 'test/'), '^https://[^/]*(/[^?|]*)', 1) AS persistence_key FROM ({KEYED_SQL})),
             v AS (SELECT persistence_key, max((video_height, video_fps)) AS ev FROM k WHERE video_height > 0 AND video_fps > 0 GROUP BY 1)
        SELECT playlist_url, entry_index, persistence_key, CASE WHEN video_height > 0 THEN video_height ELSE coalesce(ev[1], video_height) END AS video_height,
               round(CASE WHEN video_fps > 0 THEN video_fps ELSE coalesce(ev[2], video_fps) END, 3) AS video_fps, ev IS NOT NULL AND (video_height <= 0 OR video_fps <= 0) AS filled
        FROM k LEFT JOIN v USING (persistence_key)""",
)
def fill_quality(spark, sf_dir):
    return join.fill_quality(carriers.entries(spark, sf_dir))


@query(
    "retain_failed",
    f"""WITH e AS ({KEYED_SQL}), {_SCANS}, p AS (SELECT DISTINCT n, playlist_url, identity_key, entry_title FROM e JOIN s USING (scan_id)),
             f AS (SELECT DISTINCT n, playlist_url FROM p WHERE n % 7 = 0)
        SELECT p.n + 1 AS n, p.playlist_url, p.identity_key, p.entry_title, 'SOURCE_UNAVAILABLE' AS state FROM p JOIN f ON f.n = p.n + 1 AND f.playlist_url = p.playlist_url
        WHERE NOT EXISTS (FROM p q WHERE q.n = p.n + 1 AND q.playlist_url = p.playlist_url AND q.identity_key = p.identity_key AND q.entry_title = p.entry_title)""",
)
def retain_failed(spark, sf_dir):
    rows = changes.numbered(keyed(spark, sf_dir))
    return join.retain_failed(rows, rows.where("n % 7 = 0").select("n", "playlist_url").distinct())


@query(
    "probe_fanout",
    f"""WITH k AS (SELECT *, split_part(stream_url, '|', 1) AS u FROM ({KEYED_SQL}))
        SELECT playlist_url, entry_index, count(*) OVER w AS members, first_value(playlist_url) OVER o AS probed_url, first_value(entry_index) OVER o AS probed_index
        FROM k WINDOW w AS (PARTITION BY u), o AS (PARTITION BY u ORDER BY probe_status = 'expired', playlist_url, entry_index)""",
)
def probe_fanout(spark, sf_dir):
    return join.probe_fanout(carriers.entries(spark, sf_dir))


@query(
    "launch_candidates",
    f"""WITH r AS ({RANKED_SQL}), p AS ({_PLACED}), o AS (SELECT DISTINCT identity_key FROM r WHERE video_bitrate_bps % 9973 = 0),
             f AS (SELECT identity_key, stream_url AS selected_url, row_number() OVER (ORDER BY identity_key) AS k FROM p WHERE place = 1 AND n_ok > 0 AND identity_key NOT IN (FROM o))
        SELECT identity_key, selected_url, CASE WHEN k <= 20 - (SELECT count(*) FROM o) THEN 'ADMITTED' ELSE 'SUPPRESSED' END AS decision FROM f""",
)
def launch_candidates(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    return join.launch_candidates(rows, rows.where("video_bitrate_bps % 9973 = 0"), NOW, 20)


@query(
    "active_targets",
    """WITH t(name, enabled, f, u) AS (VALUES ('a', true, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-08'), ('b', true, NULL, NULL), ('c', false, NULL, NULL), ('d', true, TIMESTAMP '2024-01-20 12:00:00', NULL)),
            m AS (SELECT DISTINCT date_trunc('hour', ts) AS at_hour FROM events)
       SELECT at_hour AS at, name, CASE WHEN NOT enabled THEN 'DISABLED' WHEN f IS NULL THEN 'ACTIVE' WHEN at_hour < f THEN 'SCHEDULED' WHEN u IS NOT NULL AND at_hour >= u THEN 'EXPIRED' ELSE 'ACTIVE' END AS state FROM m, t""",
)
def active_targets(spark, sf_dir):
    targets = spark.sql("SELECT name, enabled, CAST(f AS TIMESTAMP) AS active_from, CAST(u AS TIMESTAMP) AS active_until FROM VALUES ('a', true, '2024-01-05', '2024-01-08'), ('b', true, NULL, NULL), ('c', false, NULL, NULL), ('d', true, '2024-01-20 12:00:00', NULL) AS t(name, enabled, f, u)")
    moments = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.date_trunc("hour", "ts").alias("at")).distinct()
    return join.active_targets(targets, moments)


@query(
    "as_of_freshness",
    """SELECT c.event_id, c.user_id, v.value AS seen FROM (SELECT * FROM events WHERE event_type = 'click') c
       ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts""",
)
def as_of_freshness(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    left = rows.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = rows.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("seen"))
    return join.as_of(left, right, ["user_id"], "ts", "seen").select("event_id", "user_id", "seen")


_PAIRS = ", ".join(f"'{a}>{b}'" for a, to in states.ALLOWED.items() for b in to)
_NAMES = lambda names: ", ".join(f"'{x}'" for x in names)
#: The machine, event by event: state and worker of every feed are carried from one to the next.
_DECIDED = f"""
    RECURSIVE v AS (SELECT *, row_number() OVER (PARTITION BY session_id, identity_key ORDER BY seq) AS i FROM ({EVENTS_SQL})),
    m AS (SELECT session_id, identity_key, 0::BIGINT AS i, NULL::VARCHAR AS state, NULL::INT AS pid, NULL::BIGINT AS seq, NULL::VARCHAR AS new_state, NULL::VARCHAR AS reason FROM (SELECT DISTINCT session_id, identity_key FROM v)
          UNION ALL
          SELECT session_id, identity_key, i, CASE WHEN reason <> '' THEN state WHEN op = 'claim' THEN 'LAUNCHING' WHEN op = 'bind' THEN state ELSE to_state END,
                 CASE WHEN reason = '' AND op <> 'claim' THEN coalesce(worker_pid, pid) ELSE pid END, seq, CASE op WHEN 'claim' THEN 'LAUNCHING' WHEN 'bind' THEN state ELSE to_state END, reason
          FROM (SELECT v.session_id, v.identity_key, v.i, m.state, m.pid, v.seq, v.op, v.new_state AS to_state, v.worker_pid,
                       CASE v.op WHEN 'claim' THEN CASE WHEN m.state IS NULL THEN '' ELSE 'claimed already' END
                                 WHEN 'bind' THEN CASE WHEN v.worker_pid IS NULL OR v.worker_pid <= 0 THEN 'bad worker' WHEN m.state IS NULL THEN 'not claimed' WHEN m.state <> 'LAUNCHING' THEN 'not launching' ELSE '' END
                                 ELSE CASE WHEN v.new_state NOT IN ({_NAMES(states.ALLOWED)}) THEN 'no such state' WHEN v.worker_pid <= 0 THEN 'bad worker' WHEN m.state IS NULL THEN 'not claimed' WHEN m.state IN ({_NAMES(states.FINAL)}) THEN 'final'
                                           WHEN m.state || '>' || v.new_state NOT IN ({_PAIRS}) THEN 'not allowed' WHEN v.new_state IN ({_NAMES(states.NEEDS_WORKER)}) AND coalesce(v.worker_pid, m.pid) IS NULL THEN 'no worker' ELSE '' END END AS reason
                FROM m JOIN v ON v.session_id = m.session_id AND v.identity_key = m.identity_key AND v.i = m.i + 1)),
    d AS (SELECT session_id, identity_key, seq, new_state, reason, state FROM m WHERE i > 0)
"""


@query("registry_events", f"WITH {_DECIDED} SELECT session_id, identity_key, seq, new_state, reason, reason = '' AS accepted FROM d WHERE reason = ''")
def registry_events(spark, sf_dir):
    return ownership.decide(carriers.events(spark, sf_dir)).where("accepted")


@query("registry_refusals", f"WITH {_DECIDED} SELECT session_id, identity_key, seq, reason FROM d WHERE reason <> ''")
def registry_refusals(spark, sf_dir):
    return ownership.decide(carriers.events(spark, sf_dir)).where("not accepted").select("session_id", "identity_key", "seq", "reason")


@query("registry_changes", f"""WITH {_DECIDED}, x AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY session_id, identity_key ORDER BY seq), '-') AS was FROM d) SELECT session_id, identity_key, seq, was, state AS "is" FROM x WHERE was IS DISTINCT FROM state AND reason = ''""")
def registry_changes(spark, sf_dir):
    return ownership.registry_changes(ownership.decide(carriers.events(spark, sf_dir)))


@query("ownership_summary", f"WITH {_DECIDED}, z AS (SELECT session_id, identity_key, arg_max(new_state, seq) AS state FROM d WHERE reason = '' GROUP BY ALL) SELECT session_id, count(*) FILTER (state NOT IN ('ENDED', 'MANUALLY_STOPPED', 'CRASHED')) AS active, count(*) AS feeds FROM z GROUP BY 1")
def ownership_summary(spark, sf_dir):
    return aggregate.ownership_summary(ownership.decide(carriers.events(spark, sf_dir)).where("accepted"))


@query("latest_status", f"SELECT session_id, identity_key, max(seq) AS seq, arg_max(new_state, seq) AS state, arg_max_null(worker_pid, seq) AS worker_pid FROM ({EVENTS_SQL}) GROUP BY ALL")
def latest_status(spark, sf_dir):
    return ownership.latest_status(carriers.events(spark, sf_dir))


@query("scan_windows", f"SELECT time_bucket(INTERVAL '300 seconds', ts) AS cycle, session_id, count(*) AS n, count(DISTINCT identity_key) AS feeds, count(*) FILTER (new_state = 'RECORDING') AS recording FROM ({EVENTS_SQL}) GROUP BY ALL")
def scan_windows(spark, sf_dir):
    return ownership.scan_windows(carriers.events(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogs of up to 50 pages each, as M3U text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"))
    entry = F.concat(F.lit('#EXTINF:-1 tvg-name="p'), F.col("page_id").cast("string"), F.lit("\" group-title='g"), (F.col("page_id") % 3).cast("string"), F.lit("',"), F.trim("title"), F.lit("\n#EXTVLCOPT:x=1\n"), F.when(F.col("page_id") % 10 == 0, "").otherwise(F.concat("url", F.lit("\n"))))
    lines = pages.select(F.floor(F.col("page_id") / 50).alias("catalog"), F.struct("page_id", entry.alias("entry")).alias("x"))
    text = F.concat(F.lit("#EXTM3U\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["entry"]), ""))
    return lines.groupBy("catalog").agg(text.alias("text")).select(F.concat(F.lit("c"), F.col("catalog").cast("string")).alias("url"), "text")


_TITLE = "trim(regexp_extract(html, '<title>([^<]*)', 1))"


@query(
    "explode_entries",
    f"""SELECT 'c' || (page_id // 50) AS url, row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id)::INT AS entry_index, 'p' || page_id AS tvg_name, 'g' || (page_id % 3) AS group_title,
               {_TITLE} AS entry_title, '#EXTVLCOPT:x=1' AS options, CASE WHEN page_id % 10 = 0 THEN '' ELSE url END AS stream_url FROM pages""",
)
def explode_entries(spark, sf_dir):
    return parse.explode_entries(_documents(spark, sf_dir))


@query(
    "semantic_hash",
    f"""SELECT 'c' || (page_id // 50) AS url, sha256(string_agg('#EXTINF:-1 tvg-name="p' || page_id || '" group-title=''g' || (page_id % 3) || ''',' || {_TITLE} || CASE WHEN page_id % 10 = 0 THEN '' ELSE chr(10) || regexp_replace(url, '[?#|].*$', '') END, chr(10) ORDER BY page_id)) AS hash
        FROM pages GROUP BY page_id // 50""",
)
def semantic_hash(spark, sf_dir):
    return _documents(spark, sf_dir).select("url", parse.semantic_hash(F.col("text")).alias("hash"))


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[''’‘ʼ`´]', '', 'g'), '\\p{{P}}', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"


def _sql_phrase(text: str, phrase: str) -> str:
    return f"regexp_matches({text}, '(^|[^\\p{{L}}\\p{{N}}_]){phrase}($|[^\\p{{L}}\\p{{N}}_])')"


def _sql_target(t: dict) -> str:
    some = lambda group, test: "(" + " OR ".join(test(p) for p in group) + ")"
    bounded = lambda p: _sql_phrase("t", p)
    parts = [] if t.get("match_all") else [some(g, lambda p: f"contains(b, '{p}')") for g in t.get("primary", ())]
    parts += [some(g, bounded) for g in t.get("required", ())] + ["NOT " + some(g, bounded) for g in t.get("rejected", ())]
    score = " + ".join(f"{some(g, bounded)}::INT" for g in t.get("preferred", ())) or "0"
    return f"SELECT page_id, '{t['name']}' AS target, ({score})::INT AS score FROM m WHERE {' AND '.join(parts) or 'true'}"


@query(
    "match_entries",
    f"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
             n AS (SELECT page_id, {_NORM.format(x='title')} AS t, {_NORM.format(x='path')} AS u FROM p), m AS (SELECT *, trim(t || ' ' || u) AS b FROM n)
        {' UNION ALL '.join(map(_sql_target, TARGETS))}""",
)
def match_entries(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), urls.part(F.col("url"), 3).alias("path"))
    return match.match_entries(pages, TARGETS).select("page_id", "target", "score")
