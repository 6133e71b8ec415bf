"""Roll-ups of entries: by observation, source, feed, provider and catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanework.functions import policy, quality, states
from lanework.operators import identity


def _joined(column: str):
    return F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(column), F.lit("")))), ",")


def dedupe_observations(entries: DataFrame, keys: tuple[str, ...] = ("identity_key", "playlist_url", "stream_url", "tvg_name", "group_title", "entry_title")) -> DataFrame:
    """Of equal observations the one of highest preference, then of first position."""
    best = F.min(F.struct((-F.col("preferred")).alias("less"), F.col("entry_index").alias("entry_index")))
    return entries.groupBy(*keys).agg(best.alias("b"), F.count("*").alias("copies")).select(*keys, (-F.col("b.less")).alias("preferred"), F.col("b.entry_index").alias("entry_index"), "copies")


def source_observations(entries: DataFrame) -> DataFrame:
    """Per feed and catalog: distinct names, sorted states, WORKING if any row works, else the first state, and the place of its best working row, else of its best row."""
    rows = entries.withColumns({"state": identity.state_of(entries), "_rank": identity.rank_of(entries)})
    state = F.when(F.bool_or(F.col("state") == "WORKING"), "WORKING").otherwise(F.min("state"))
    best = F.min(F.struct((F.col("state") != "WORKING").alias("idle"), *((-F.col("_rank")[f]).alias(f) for f in quality.RANK_FIELDS), F.col("entry_index").alias("entry_index")))
    return rows.groupBy("identity_key", "playlist_url").agg(_joined("entry_title").alias("titles"), _joined("tvg_name").alias("tvg_names"), _joined("group_title").alias("groups"), _joined("state").alias("states"), state.alias("state"), F.count("*").alias("observations"), best["entry_index"].alias("best_index"))


def identity_blocks(entries: DataFrame) -> DataFrame:
    """Per feed: rows, catalogs, working rows, best rank's bitrate and whether anything can be launched."""
    rows = entries.withColumns({"state": identity.state_of(entries), "rank": identity.rank_of(entries)})
    working = F.col("state") == "WORKING"
    best = F.max(F.when(working, F.col("rank")))
    return rows.groupBy("identity_key").agg(F.count("*").alias("observations"), F.count_distinct("playlist_url").alias("sources"), F.count_if(working).alias("working"), F.coalesce(best["height"], F.lit(0)).alias("best_height"), F.coalesce(best["bitrate"], F.lit(0)).alias("best_bitrate"), F.when(F.count_if(working) > 0, "AVAILABLE").otherwise("UNUSABLE").alias("overall_state"))


def provider_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy(policy.provider_name(F.col("provider")).alias("provider")).agg(F.count_distinct("identity_key").alias("feeds"), F.count("*").alias("observations"))


def catalog_rollup(entries: DataFrame) -> DataFrame:
    """Counts by provider and group, with subtotals (level 0: both, 1: provider, 3: all)."""
    return entries.rollup("provider", "group_title").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("observations"), F.count_distinct("identity_key").alias("feeds"), F.max("video_bitrate_bps").alias("best_bitrate"))


#: Size of a sketch of distinct feeds: 2^12 registers, a standard error of 1.04 / sqrt(4096) = 1.6 %; small sets are counted exactly.
SKETCH = 12


def feed_sketches(entries: DataFrame, *keys: str, size: int = SKETCH) -> DataFrame:
    """(keys, observations, sketch): distinct feeds of each group as a sketch, which others can be merged with."""
    return entries.groupBy(*keys).agg(F.count("*").alias("observations"), F.hll_sketch_agg("identity_key", size).alias("sketch"))


def merged_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, level, observations, sketch, feeds): roll-up of sketched groups over the keys; feeds is the sketch's estimate.

    The rows are read once, for the sketches: what rolls up is a row for each group, so neither rows nor distinct feeds are
    multiplied by the number of levels.
    """
    rolled = sketches.rollup(*keys).agg(F.grouping_id().cast("int").alias("level"), F.sum("observations").alias("observations"), F.hll_union_agg("sketch").alias("sketch"))
    return rolled.withColumn("feeds", F.hll_sketch_estimate("sketch"))


def catalog_rollup_sketched(entries: DataFrame, keys: tuple[str, ...] = ("provider", "group_title", "state"), size: int = SKETCH) -> DataFrame:
    """(keys, level, observations, feeds): as catalog_rollup, down to the rows' state, with estimated counts of distinct feeds."""
    rows = entries.withColumn("state", identity.state_of(entries))
    return merged_sketches(feed_sketches(rows, *keys, size=size), *keys).drop("sketch")


def catalog_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("playlist_url").agg(F.count("*").alias("observed"), F.count_if(F.col("stream_url") != "").alias("playable"), F.count_if("launchable").alias("launchable"), F.count_if(F.col("expiry").isNull()).alias("unknown_expiry"))


def metadata_groups(entries: DataFrame) -> DataFrame:
    """Rows and catalogs of each normalised title within a feed."""
    title = F.trim(F.regexp_replace(F.lower("entry_title"), r"[^\p{L}\p{N}]+", " "))
    return entries.groupBy("identity_key", title.alias("title")).agg(F.count("*").alias("rows"), F.count_distinct("playlist_url").alias("sources"))


def ownership_summary(accepted: DataFrame) -> DataFrame:
    """Per session: feeds owned now (their latest accepted state is none of the final ones) and all feeds."""
    last = accepted.groupBy("session_id", "identity_key").agg(F.max_by("new_state", "seq").alias("state"))
    return last.groupBy("session_id").agg(F.count_if(~F.col("state").isin(*states.FINAL)).alias("active"), F.count("*").alias("feeds"))
