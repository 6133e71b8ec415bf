"""Inputs of the catalog operators, mapped from the given tables: the same rows in Spark and, as text, in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 1998-06-01, the moment at which all queries are asked.
NOW = 896659200
PROVIDERS = ("HOTSTAR", "SONY", "FANCODE", "JIO", "KHEL", "OTHER")
HEIGHTS = (0, 480, 720, 1080, 1440, 2160)
RATES = (0.0, 25.0, 29.97, 50.0, 60.0)
#: A row's place in its catalog: from its own keys, so that no catalog is sorted. Lines of one order and number are told apart by price.
_PLACE = "(l_orderkey * 8 + l_linenumber) * 1000000 + CAST(floor(l_extendedprice) AS BIGINT)"


def _case(expr: str, values: tuple) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values)) + " END"


def _columns(epoch: str, text: str) -> str:
    """The carrier's select list; epoch and text give each engine's own spelling."""
    n = lambda x: f"CAST({x} AS {text})"
    return f"""
        year(l_shipdate) * 12 + month(l_shipdate) AS scan_id,
        'https://src' || {n('l_suppkey % 20')} || '.test/list.m3u' AS playlist_url,
        {_PLACE} AS entry_index,
        {_case('l_suppkey % 6', PROVIDERS)} AS provider,
        'G' || {n('l_suppkey % 4')} AS group_title,
        CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'CH-' || {n('l_partkey % 50')} END AS tvg_name,
        'Channel ' || {n('l_partkey % 50')} || ' ' || l_returnflag AS entry_title,
        'https://cdn' || {n('l_suppkey % 7')} || '.test//live/' || {n('l_partkey % 200')} || '/ENG/' || {n('l_linenumber')} || '.m3u8?exp=' || {n(epoch)} || '|UA=x' AS stream_url,
        {_case('l_partkey % 6', HEIGHTS)} AS video_height,
        CAST(floor({_case('l_partkey % 6', HEIGHTS)} * 16 / 9) AS INT) AS video_width,
        CAST({_case('l_linenumber % 5', RATES)} AS DOUBLE) AS video_fps,
        CAST(floor(l_extendedprice) AS BIGINT) AS video_bitrate_bps,
        CASE l_returnflag WHEN 'N' THEN 'progressive' WHEN 'R' THEN 'tt' ELSE '' END AS video_scan_type,
        l_linenumber % 2 AS preferred,
        l_linestatus = 'O' AS launchable,
        CASE WHEN l_linestatus = 'O' THEN 'working' WHEN l_returnflag = 'A' THEN 'expired' WHEN l_returnflag = 'R' THEN 'probe_failed' ELSE '' END AS probe_status,
        l_partkey % 11 = 0 AS access_blocked,
        CASE WHEN l_quantity % 5 = 0 THEN NULL ELSE CAST({epoch} AS DOUBLE) END AS expiry
    """


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries with quality, from lineitem."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.selectExpr(*_split(_columns("unix_timestamp(l_shipdate)", "STRING")))


def _split(text: str) -> list[str]:
    """Top-level items of a select list."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


ENTRIES_SQL = f"SELECT {_columns('CAST(epoch(l_shipdate) AS BIGINT)', 'VARCHAR')} FROM lineitem"
#: Provider names and the path that names the feed, as DuckDB says them.
KEYED_SQL = f"""
    SELECT *, CASE WHEN provider = 'SONY' THEN 'SONYLIV' ELSE provider END || '|' || regexp_extract(replace(split_part(stream_url, '|', 1), 'test//', 'test/'), '^https://[^/]*(/[^?]*)/[^/?]*', 1) AS identity_key
    FROM ({ENTRIES_SQL})
"""


def _k(number: str) -> str:
    """(op, new_state, worker_pid) of an event; number: its k, in each engine's own spelling."""
    return f"""
        CASE WHEN event_type = 'signup' THEN 'claim' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'bind' ELSE 'transition' END AS op,
        CASE event_type WHEN 'signup' THEN 'LAUNCHING' WHEN 'view' THEN 'RECORDING' WHEN 'click' THEN 'WAITING_FOR_SOURCE' WHEN 'purchase' THEN CASE WHEN {number} % 3 = 0 THEN 'MANUALLY_STOPPED' ELSE 'ENDED' END
             ELSE CASE WHEN {number} % 5 = 0 THEN 'LOST' WHEN {number} % 5 = 1 THEN 'LAUNCHING' ELSE 'CRASHED' END END AS new_state,
        CASE WHEN {number} % 4 = 0 THEN NULL WHEN {number} % 17 = 0 THEN 0 ELSE {number} END AS worker_pid
    """


def event_columns(rows: DataFrame) -> DataFrame:
    """Ownership events, from events: claims, binds and transitions of an identity within a session."""
    plain = ("concat('s', user_id % 4) AS session_id", "concat('feed', user_id) AS identity_key", "event_id AS seq", "ts")
    return rows.selectExpr(*plain, *_split(_k("CAST(get_json_object(props, '$.k') AS INT)")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_columns(spark.read.parquet(f"{sf_dir}/events.parquet"))


EVENTS_SQL = f"SELECT 's' || (user_id % 4) AS session_id, 'feed' || user_id AS identity_key, event_id AS seq, ts, {_k(chr(34) + 'k' + chr(34))} FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"
