"""Queries over what scans hand on: persisted quality, retained rows, recovery by catalog; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanework.operators import carried, changes, display, scope, select
from lanework.plans import catalog, searches
from lanework.plans.carriers import ENTRIES_SQL, KEYED_SQL, NOW, entries
from lanework.plans.catalog import _PLACED, _SCANS, RANKED_SQL

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


#: Labels of the carrier's facts, of which some are made to miss; the same text in both engines.
_LABELLED = """
    SELECT scan_id, playlist_url, entry_index, provider, stream_url, video_width, CASE WHEN entry_index % 5 = 0 THEN 0 ELSE video_height END AS video_height, video_fps,
           CASE WHEN entry_index % 4 = 0 THEN 0 ELSE video_bitrate_bps END AS video_bitrate_bps, video_scan_type,
           CASE entry_index % 3 WHEN 0 THEN 'manifest' WHEN 1 THEN 'ffprobe + stream' ELSE '' END AS video_resolution_source, CASE WHEN entry_index % 2 = 0 THEN 'stream' END AS video_fps_source,
           CASE WHEN entry_index % 7 = 0 THEN 'sample' ELSE 'manifest' END AS video_bitrate_source, CASE WHEN entry_index % 6 < 2 THEN 'ffprobe' ELSE '' END AS video_scan_type_source,
           CASE entry_index % 4 WHEN 0 THEN 'manifest+probe' WHEN 1 THEN 'probe' ELSE ' ' END AS quality_source
    FROM {e}"""
_FACTS = {"w": ("video_width", "video_resolution_source"), "h": ("video_height", "video_resolution_source"), "f": ("video_fps", "video_fps_source"), "b": ("video_bitrate_bps", "video_bitrate_source"), "t": ("video_scan_type", "video_scan_type_source")}
_VALUE = {c: f"CASE WHEN {c} > 0 THEN {c} END" for c in ("video_width", "video_height", "video_fps", "video_bitrate_bps")} | {"video_scan_type": "CASE video_scan_type WHEN 'progressive' THEN 'progressive' WHEN 'tt' THEN 'interlaced' END"}


def _in_order(own: str, found: list[str], what: str) -> str:
    """Own labels, then those of the facts that were filled, newest first, each label once."""
    newest = f"list_transform(list_reverse_sort(list_filter([{', '.join(f'CASE WHEN {u} IS NOT NULL THEN {{s: {u}.s, x: {u}.{what}}} END' for u in found)}], lambda x: x IS NOT NULL)), lambda x: x.x)"
    parts = f"list_filter(list_transform(string_split(array_to_string(list_concat([coalesce({own}, '')], {newest}), '+'), '+'), lambda p: trim(p)), lambda p: p <> '')"
    return f"(SELECT array_to_string(list_filter(ps, lambda p, i: list_position(ps, p) = i), '+') FROM (SELECT {parts} AS ps))"


_USED = {f: f"CASE WHEN v.{f} IS NULL THEN k.{f} END" for f in _FACTS}


@query(
    "fill_persisted",
    f"""WITH e AS ({_LABELLED.format(e=f"({ENTRIES_SQL})")}),
             v AS (SELECT *, CASE WHEN provider = 'SONY' THEN 'SONYLIV' ELSE provider END || '|' || regexp_extract(replace(stream_url, 'test//', 'test/'), '^https://[^/]*(/[^?|]*)', 1) AS persistence_key,
                          {', '.join(f'{_VALUE[c]} AS {f}' for f, (c, _) in _FACTS.items())} FROM e),
             x AS (SELECT persistence_key, scan_id, {', '.join(f"max({{s: scan_id, v: {f}, l: coalesce({by}, ''), q: coalesce(quality_source, '')}}) FILTER ({f} IS NOT NULL) AS {f}" for f, (_, by) in _FACTS.items())} FROM v GROUP BY ALL),
             k AS (SELECT a.persistence_key, a.scan_id, {', '.join(f'max(b.{f}) AS {f}' for f in _FACTS)} FROM (SELECT DISTINCT persistence_key, scan_id FROM v) a
                   JOIN x b ON b.persistence_key = a.persistence_key AND b.scan_id < a.scan_id GROUP BY ALL),
             u AS (SELECT v.*, {', '.join(f'{x} AS u{f}' for f, x in _USED.items())} FROM v LEFT JOIN k USING (persistence_key, scan_id))
        SELECT scan_id, playlist_url, entry_index, {', '.join(f'coalesce({f}, u{f}.v, {c}) AS {c}' for f, (c, _) in _FACTS.items())},
               {', '.join(f"{_in_order(by, [f'u{f}' for f, (_, b) in _FACTS.items() if b == by], 'l')} AS {by}" for by in carried.LABELS)}, {_in_order('quality_source', [f'u{f}' for f in _FACTS], 'q')} AS quality_source,
               {' OR '.join(f'{f} IS NOT NULL OR u{f} IS NOT NULL' for f in _FACTS)} AS quality_known, {' OR '.join(f'u{f} IS NOT NULL' for f in _FACTS)} AS filled FROM u""",
)
def fill_persisted(spark, sf_dir):
    entries(spark, sf_dir).createOrReplaceTempView("lanework_entries")
    found = carried.fill_persisted(spark.sql(_LABELLED.format(e="lanework_entries")))
    return found.select("scan_id", "playlist_url", "entry_index", *carried.FACTS, *carried.LABELS, "quality_source", "quality_known", "filled")


#: Definitions of searches over time, in months as scan_id counts them.
_DEFINED = """
    SELECT concat('t', s_suppkey % 40) AS target, 23905 + s_suppkey * 37 % 84 AS since, s_suppkey % 9 <> 4 AS enabled, CASE WHEN s_suppkey % 3 = 0 THEN 23929 END AS active_from,
           CASE WHEN s_suppkey % 3 = 0 THEN 23965 END AS active_until, concat('p', s_suppkey % 2) AS phrase FROM {s}"""
_TARGET = "concat('t', entry_index % 50)"
_FAILS = "(n + CAST(length(playlist_url) AS INT) + length(provider)) % 5 < 2"


@query(
    "retain_unchanged",
    f"""WITH RECURSIVE e AS ({KEYED_SQL}), {_SCANS}, d AS (SELECT target, since, arg_max({{e: enabled, f: active_from, u: active_until, p: phrase}}, (enabled, coalesce(active_from, 0), coalesce(active_until, 0), phrase)) AS x FROM ({_DEFINED.format(s='supplier')}) GROUP BY ALL),
             p AS (SELECT DISTINCT n, {_TARGET} AS target, playlist_url, provider, 'G' || (entry_index % 2) AS source_group, entry_index, stream_url, tvg_name, group_title, entry_title FROM e JOIN s USING (scan_id)),
             f AS (SELECT DISTINCT n, playlist_url, provider, source_group FROM p WHERE {_FAILS}),
             t AS (SELECT q.target, s.n, s.scan_id AS at, arg_max(d.x, d.since) AS x FROM (SELECT DISTINCT target FROM p) q JOIN s ON true JOIN d ON d.target = q.target AND d.since <= s.scan_id GROUP BY ALL),
             ok AS (SELECT b.target, b.n FROM t a JOIN t b ON a.target = b.target AND b.n = a.n + 1 AND a.x = b.x WHERE b.x.e AND (b.x.f IS NULL OR (b.at >= b.x.f AND (b.x.u IS NULL OR b.at < b.x.u)))),
             c AS (SELECT *, false AS kept FROM p
                   UNION ALL SELECT f.n, c.target, c.playlist_url, c.provider, c.source_group, c.entry_index, c.stream_url, c.tvg_name, c.group_title, c.entry_title, true
                   FROM c JOIN f ON f.n = c.n + 1 AND f.playlist_url = c.playlist_url AND f.provider = c.provider AND f.source_group = c.source_group JOIN ok ON ok.target = c.target AND ok.n = c.n + 1
                   WHERE NOT EXISTS (FROM p WHERE p.n = c.n + 1 AND p.entry_index = c.entry_index AND p.playlist_url = c.playlist_url AND p.provider = c.provider AND p.stream_url = c.stream_url AND p.entry_title = c.entry_title AND p.tvg_name = c.tvg_name AND p.group_title = c.group_title))
        SELECT n, target, playlist_url, provider, source_group, entry_index, stream_url, tvg_name, group_title, entry_title, 'SOURCE_UNAVAILABLE' AS state FROM c WHERE kept""",
)
def retain_unchanged(spark, sf_dir):
    rows = changes.numbered(catalog.keyed(spark, sf_dir)).withColumns({"target": F.expr(_TARGET), "source_group": F.expr("concat('G', entry_index % 2)")})
    spark.read.parquet(f"{sf_dir}/supplier.parquet").createOrReplaceTempView("lanework_supplier")
    definitions = spark.sql(_DEFINED.format(s="lanework_supplier"))
    failed = rows.where(_FAILS).select("n", *carried.SOURCE).distinct()
    scans = rows.select("n", F.col("scan_id").alias("at")).distinct()
    return carried.retain_unchanged(rows, failed, definitions, scans, ("phrase",))


MODES = {"JIO": "EXACT_CHANNEL", "KHEL": "EVENT_PHRASE"}
_ASKED = "SELECT identity_key, '' AS playlist_url FROM {p} UNION SELECT identity_key, concat('https://s', entry_index % 30, '.test/l') FROM {p} UNION SELECT identity_key, concat(' https://s', (entry_index + 4) % 8, '.test/l') FROM {p}"


@query(
    "recovery_contexts",
    f"""WITH p AS ({searches.PLAN_SQL}), w AS (SELECT identity_key, unnest(string_split(targets, ',')) AS name, generate_subscripts(string_split(targets, ','), 1) AS ord FROM p),
             m AS (SELECT identity_key, ord, name, group_ord, url, CASE context WHEN 'JIO' THEN 'EXACT_CHANNEL' ELSE 'EVENT_PHRASE' END AS mode FROM w JOIN ({searches.SCOPE_SQL}) USING (name) WHERE error = '' AND context = split_part(identity_key, '|', 1)),
             q AS (SELECT DISTINCT identity_key, trim(playlist_url) AS playlist_url FROM ({_ASKED.format(p='p')})),
             a AS (SELECT q.identity_key, q.playlist_url, name || ':' || mode AS context, min((ord, group_ord)) AS place FROM q JOIN m ON m.identity_key = q.identity_key AND (q.playlist_url = '' OR q.playlist_url = m.url) GROUP BY ALL)
        SELECT identity_key, playlist_url, coalesce(c, '') AS contexts FROM q LEFT JOIN (SELECT identity_key, playlist_url, string_agg(context, ',' ORDER BY place, context) AS c FROM a GROUP BY ALL) USING (identity_key, playlist_url)""",
)
def recovery_contexts(spark, sf_dir):
    plan = searches._plan(spark, sf_dir)
    lookup = scope.recovery_lookup(plan, scope.resolve_scope(searches._searches(spark, sf_dir), searches._catalogs(spark, sf_dir)), MODES)
    plan.createOrReplaceTempView("lanework_launches")
    found = scope.recovery_contexts(lookup, spark.sql(_ASKED.format(p="lanework_launches")))
    return found.withColumn("contexts", F.array_join("contexts", ","))


_SHOWN = {"row_updated": "CASE WHEN entry_index % 3 > 0 THEN scan_id END", "source_freshness_ts": "CASE WHEN entry_index % 4 > 0 THEN expiry END", "video_bitrate_source": "CASE entry_index % 5 WHEN 0 THEN ' Manifest' WHEN 1 THEN 'ffprobe' WHEN 2 THEN 'sample' WHEN 3 THEN 'other' END"}


@query(
    "quality_rows",
    f"""WITH r AS ({RANKED_SQL}), p AS ({_PLACED}), b AS (SELECT identity_key, playlist_url, entry_index FROM p WHERE place = 1 AND n_ok > 0),
             k AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in _SHOWN.items())}, CASE WHEN provider = 'SONY' THEN 'SONYLIV' ELSE provider END || regexp_extract(stream_url, '^https://[^/]*(/[^?|]*)', 1) AS path FROM r),
             f AS (SELECT DISTINCT ON (identity_key, path, video_width, video_height, video_fps) identity_key, path, video_width, video_height, video_fps, signature AS quality, area, round(video_fps, 3) AS fps, video_bitrate_bps AS bitrate FROM k
                   ORDER BY identity_key, path, video_width, video_height, video_fps, (video_bitrate_bps > 0) DESC, CASE lower(trim(coalesce(video_bitrate_source, ''))) WHEN 'manifest' THEN 4 WHEN 'ffprobe' THEN 3 WHEN 'sample' THEN 1 ELSE (video_bitrate_bps > 0)::INT * 2 END DESC,
                            (video_width > 0 AND video_height > 0 AND video_fps > 0) DESC, (video_scan_type <> '') DESC, coalesce(source_freshness_ts, 0) DESC, playlist_url, entry_index),
             h AS (SELECT k.*, f.quality, f.area AS a, f.fps, f.bitrate, b.identity_key IS NOT NULL AS best, trim(regexp_replace(lower(coalesce(nullif(entry_title, ''), tvg_name)), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS name
                   FROM k JOIN f USING (identity_key, path, video_width, video_height, video_fps) LEFT JOIN b ON b.identity_key = k.identity_key AND b.playlist_url = k.playlist_url AND b.entry_index = k.entry_index),
             g AS (SELECT identity_key, quality, row_number() OVER (PARTITION BY identity_key ORDER BY bool_or(best) DESC, max(a) DESC, max(fps) DESC, max(bitrate) DESC, quality) AS heading FROM h GROUP BY identity_key, quality),
             o AS (SELECT DISTINCT ON (identity_key, quality, playlist_url, entry_title, tvg_name, group_title, state) * FROM h ORDER BY identity_key, quality, playlist_url, entry_title, tvg_name, group_title, state, entry_index)
        SELECT identity_key, quality, heading, row_number() OVER (PARTITION BY identity_key, quality ORDER BY row_updated DESC NULLS LAST, name, coalesce(source_freshness_ts, 0) DESC, playlist_url, entry_index, entry_title, tvg_name, group_title, state) AS place,
               playlist_url, entry_index, state FROM o JOIN g USING (identity_key, quality)""",
)
def quality_rows(spark, sf_dir):
    rows = catalog.keyed(spark, sf_dir)
    best = select.select_best(rows, NOW).where("decision = 'selected'")
    return display.quality_rows(rows.selectExpr("*", *(f"{x} AS {c}" for c, x in _SHOWN.items())), best, "row_updated")
