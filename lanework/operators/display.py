"""How feeds and sources are shown: labels, order, and the row that a worker reports on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanework.functions import urls
from lanework.operators import evidence, identity
from lanework.sources.shared import stored

#: Fixed value: a host whose addresses name owner, project and branch.
RAW_HOST = "raw.githubusercontent.com"
ROW = ("playlist_url", "entry_index", "entry_title", "tvg_name", "group_title")


def source_label(url: Column) -> Column:
    """Host and path of an address without its query; addresses of raw files as owner/project@branch/path. Null gives ''."""
    text = F.coalesce(url, F.lit(""))
    host, parts = urls.part(text, 2), F.filter(F.split(urls.part(text, 3), "/"), lambda x: x != "")
    tail = lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, n, 1 << 30), "/"))
    owner = F.concat(F.lit("github:"), F.try_element_at(parts, F.lit(1)), F.lit("/"), F.try_element_at(parts, F.lit(2)), F.lit("@"))
    headed = (F.size(parts) >= 5) & (F.try_element_at(parts, F.lit(3)) == "refs") & (F.try_element_at(parts, F.lit(4)) == "heads")
    raw = F.when(headed, F.concat(owner, F.try_element_at(parts, F.lit(5)), tail(6))).otherwise(F.concat(owner, F.try_element_at(parts, F.lit(3)), tail(4)))
    label = F.when((F.lower(host) == RAW_HOST) & (F.size(parts) >= 3), raw).otherwise(F.concat(host, tail(1)))
    return F.regexp_replace(label, "/+$", "")


def display_order(entries: DataFrame, ended: DataFrame, previous: DataFrame) -> DataFrame:
    """(identity_key, category, unusable, is_old, place): the keys by which feeds are shown, in that order.

    Feeds with a working row come first, then those in a final state (ended: identity_key), then the rest; within them
    fewer unusable rows, new feeds before known ones, and known ones as before (previous: identity_key, place). New feeds
    are ordered by name. The keys are columns, so that a reader can sort in ranges; no task numbers all feeds.
    """
    working = identity.state_of(entries) == "WORKING"
    feeds = entries.groupBy("identity_key").agg(F.count_if(~working).alias("unusable"), F.bool_or(working).alias("works"))
    final = ended.select("identity_key", F.lit(True).alias("final")).distinct()
    found = feeds.join(final, "identity_key", "left").join(previous, "identity_key", "left")
    category = F.when(F.col("final"), 1).when(F.col("works"), 0).otherwise(2)
    return found.select("identity_key", category.alias("category"), "unusable", F.col("place").isNotNull().cast("int").alias("is_old"), F.coalesce("place", F.lit(0)).alias("place")).orderBy("category", "unusable", "is_old", "place", "identity_key")


def overlay_status(entries: DataFrame, status: DataFrame) -> DataFrame:
    """(identity_key, playlist_url, entry_index, worker_state): the row each worker reports on.

    status: (identity_key, the five columns of a row, worker_state). The exact row counts; if the metadata moved on, the
    only row of that catalog within the feed; else no row. Repeated equal rows count once.
    """
    rows = entries.select("identity_key", *ROW).distinct()
    keys = ["identity_key", *ROW]
    exact = status.join(rows, keys, "left_semi").select("identity_key", "playlist_url", "entry_index", "worker_state")
    only = rows.groupBy("identity_key", "playlist_url").agg(F.count("*").alias("n"), F.min("entry_index").alias("found")).where("n = 1")
    moved = status.join(rows, keys, "left_anti").join(only, ["identity_key", "playlist_url"]).select("identity_key", "playlist_url", F.col("found").alias("entry_index"), "worker_state")
    return exact.unionByName(moved)


#: Leaves that name a list of renditions, not one.
LISTS = ("master.m3u8", "index.m3u8", "playlist.m3u8", "manifest.m3u8")
#: How much a bitrate's source is worth; another source of a bitrate is worth 2.
WORTH = {"manifest": 4, "ffprobe": 3, "stream": 3, "format": 3, "sample": 1}


def _renditions(entries: DataFrame) -> DataFrame:
    """entries with _key, the rendition of a row, and _proof: its evidence, best least, then its place and what it says."""
    number = lambda c: F.coalesce(c, F.lit(0))
    has = lambda c: F.col(c) if c in entries.columns else F.lit(None)
    worth = F.try_element_at(F.create_map(*(F.lit(x) for pair in WORTH.items() for x in pair)), F.lower(F.trim(F.coalesce(has("video_bitrate_source"), F.lit("")))))
    width, height, fps, bitrate = (number(F.col(c)) for c in ("video_width", "video_height", "video_fps", "video_bitrate_bps"))
    rows = entries.withColumns({"_quality": identity.signature_of(entries), "_path": identity.persistence_key(entries)})
    leaf = F.lower(F.regexp_extract("_path", "([^/]*)$", 1))
    one = F.concat_ws("/", F.col("_path"), width, height, F.round(fps, 3))
    proofs = (-(bitrate > 0).cast("int"), -F.coalesce(worth, F.when(bitrate > 0, 2).otherwise(0)), -((width > 0) & (height > 0) & (fps > 0)).cast("int"), -(F.coalesce("video_scan_type", F.lit("")) != "").cast("int"), -number(has("source_freshness_ts").cast("double")))
    shown = (F.col("_quality").alias("quality"), (width.cast("long") * height).alias("area"), F.round(fps, 3).alias("fps"), bitrate.alias("bitrate"))
    proof = F.struct(*(e.alias(f"e{i}") for i, e in enumerate(proofs)), "playlist_url", "entry_index", *shown)
    return rows.withColumns({"_key": F.when(leaf.isin("", *LISTS), F.col("_quality")).otherwise(one), "_proof": proof}).drop("_quality", "_path")


def quality_groups(entries: DataFrame) -> DataFrame:
    """(identity_key, quality, renditions, observations, area, fps, bitrate): the headings under which a feed's rows are shown.

    Rows of one rendition and size and rate go together, whatever their bitrate evidence; the row of best evidence speaks
    for them (the first by catalog and position on ties). Renditions that then look the same share a heading. Sort by area,
    rate and bitrate, falling. Columns video_bitrate_source and source_freshness_ts count where there are any.
    """
    speaks = _renditions(entries).groupBy("identity_key", "_key").agg(F.min("_proof").alias("x"), F.count("*").alias("n"))
    return speaks.groupBy("identity_key", "x.quality").agg(F.count("*").alias("renditions"), F.sum("n").alias("observations"), F.max("x.area").alias("area"), F.max("x.fps").alias("fps"), F.max("x.bitrate").alias("bitrate"))


def quality_rows(entries: DataFrame, best: DataFrame, updated: str) -> DataFrame:
    """(identity_key, quality, heading, place, playlist_url, entry_index, state): the rows of a feed as they are shown, each with
    its heading's number and its own under that heading, from 1.

    entries as in ``quality_groups``, with the column ``updated`` (when a row last changed); best: (identity_key, playlist_url,
    entry_index), at most one row a feed. The heading of the best row comes first, then those of larger area, higher rate and
    higher bitrate. Under a heading rows that look the same (catalog, names, state) are shown once, the one of the first
    position; the last updated come first, then names in order, then the freshest catalogs. Null times come last.

    Rows are numbered within one time and name, behind the number of rows before, which come from counts: no task orders all
    rows of a feed. Rows that look the same are folded before anything is joined, and what is used several times is stored.
    """
    rows = _renditions(entries)
    fresh = F.coalesce(F.col("source_freshness_ts").cast("double"), F.lit(0.0)) if "source_freshness_ts" in entries.columns else F.lit(0.0)
    name = evidence.plain(F.coalesce(F.nullif("entry_title", F.lit("")), "tvg_name"))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    seen = rows.select("identity_key", "_key", text("playlist_url"), text("entry_title"), text("tvg_name"), text("group_title"), identity.state_of(entries).alias("state"), "entry_index", F.col(updated).alias("updated"), fresh.alias("fresh"), name.alias("name"), "_proof")
    chosen = best.select("identity_key", text("playlist_url"), "entry_index", F.lit(True).alias("best"))
    seen = seen.join(stored(chosen, "best"), ["identity_key", "playlist_url", "entry_index"], "left")
    looks = ["playlist_url", "entry_title", "tvg_name", "group_title", "state", "name"]
    first, is_best = F.min(F.struct("entry_index", "updated", "fresh")), F.bool_or(F.coalesce("best", F.lit(False))).alias("best")
    folded = stored(seen.groupBy("identity_key", "_key", *looks).agg(first.alias("first"), F.min("_proof").alias("proof"), is_best), "looks")
    speaks = folded.groupBy("identity_key", "_key").agg(F.min("proof").alias("x"))
    headed = folded.join(speaks.select("identity_key", "_key", "x.quality", "x.area", "x.fps", "x.bitrate"), ["identity_key", "_key"])
    said = [F.max(c).alias(c) for c in ("area", "fps", "bitrate")]
    once = stored(headed.groupBy("identity_key", "quality", *looks).agg(F.min("first").alias("x"), is_best, *said).select("identity_key", "quality", *looks, "x.*", "best", "area", "fps", "bitrate"), "rows")
    order = Window.partitionBy("identity_key").orderBy(F.desc("best"), F.desc("area"), F.desc("fps"), F.desc("bitrate"), "quality")
    headings = once.groupBy("identity_key", "quality").agg(F.bool_or("best").alias("best"), *said).select("identity_key", "quality", F.row_number().over(order).alias("heading"))
    alike = ["identity_key", "quality", "updated", "name"]
    before = Window.partitionBy("identity_key", "quality").orderBy(F.desc_nulls_last("updated"), "name").rowsBetween(Window.unboundedPreceding, -1)
    counted = once.groupBy(*alike).agg(F.count("*").alias("n"))
    counted = counted.select(F.col("identity_key").alias("_i"), F.col("quality").alias("_q"), F.col("updated").alias("_u"), F.col("name").alias("_n"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy(*alike).orderBy(F.desc("fresh"), "playlist_url", "entry_index", "entry_title", "tvg_name", "group_title", "state")
    numbered = once.withColumn("nth", F.row_number().over(own))
    placed = numbered.join(counted, F.col("identity_key").eqNullSafe(F.col("_i")) & (F.col("quality") == F.col("_q")) & F.col("updated").eqNullSafe(F.col("_u")) & (F.col("name") == F.col("_n")))
    return placed.join(headings, ["identity_key", "quality"]).select("identity_key", "quality", "heading", (F.col("ahead") + F.col("nth")).alias("place"), "playlist_url", "entry_index", "state")
