"""Stable keys of feeds and of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanework.functions import policy, quality, urls


def identity_key(provider: Column, *url_columns: Column, otherwise: Column | None = None) -> Column:
    """provider|lane: the first address that gives a path, else a strict key of the first address there is, else ``otherwise``. Never null."""
    paths = [urls.path_or_null(u, True) for u in url_columns]
    opaque = [F.when(urls.without_suffix(u) != "", urls.opaque_key(u)) for u in url_columns]
    rest = F.lit("unresolved:") if otherwise is None else F.concat(F.lit("unresolved:"), otherwise)
    return F.concat(policy.provider_name(provider), F.lit("|"), F.coalesce(*paths, *opaque, rest))


def feed_identity(entries: DataFrame) -> DataFrame:
    """entries with identity_key; rows without any address are told apart by catalog and position."""
    place = F.sha2(F.concat_ws("|", "playlist_url", F.col("entry_index").cast("string")), 256)
    return entries.withColumn("identity_key", identity_key(F.col("provider"), F.col("stream_url"), otherwise=F.coalesce(place, F.lit(""))))


#: Fixed order: the addresses that may name a feed, the one nearest to what is played first.
ADDRESSES = ("final_stream_url", "manifest_final_url", "effective_url", "stream_url", "raw_stream_url")


def resolved_identity(entries: DataFrame) -> DataFrame:
    """entries with identity_key, confidence and named_by, from the first evidence in order that names the feed.

    confidence is ``path`` (the path of the first of ADDRESSES that has one), ``provider`` (a hash of provider_identity_hint),
    ``conservative`` (a strict key of the first address there is) or ``unresolved`` (a hash of catalog and place); named_by is
    the column that gave it. Columns that entries lack count as null, null and blank values as absent. Columns of the three new
    names are replaced.
    """
    has = set(entries.columns)
    known = [(c, F.col(c)) for c in ADDRESSES if c in has]
    lanes = F.array(*(F.struct(F.lit(c).alias("by"), urls.path_or_null(u, True).alias("lane")) for c, u in known))
    given = F.array(*(F.struct(F.lit(c).alias("by"), urls.without_suffix(u).alias("lane")) for c, u in known))
    first = lambda values, good: F.get(F.filter(values, good), F.lit(0)) if known else F.lit(None).cast("struct<by: string, lane: string>")
    hint = F.trim(F.coalesce(F.col("provider_identity_hint") if "provider_identity_hint" in has else F.lit(None).cast("string"), F.lit("")))
    place = F.concat_ws("|", F.coalesce("playlist_url", F.lit("")), F.coalesce(F.nullif(F.col("entry_index"), F.lit(0)).cast("string"), F.lit("")))
    rows = entries.withColumns({"_lane": first(lanes, lambda x: x["lane"].isNotNull()), "_given": first(given, lambda x: x["lane"] != ""), "_hint": hint})
    said = lambda lane, confidence, by: F.struct(lane.alias("lane"), F.lit(confidence).alias("confidence"), by.alias("by"))
    found = (
        F.when(F.col("_lane").isNotNull(), said(F.col("_lane.lane"), "path", F.col("_lane.by")))
        .when(F.col("_hint") != "", said(F.concat(F.lit("provider-hint:"), F.sha2("_hint", 256)), "provider", F.lit("provider_identity_hint")))
        .when(F.col("_given").isNotNull(), said(urls.opaque_key(F.col("_given.lane")), "conservative", F.col("_given.by")))
        .otherwise(said(F.concat(F.lit("unresolved:"), F.sha2(place, 256)), "unresolved", F.lit("playlist_url")))
    )
    rows = rows.withColumn("_found", found).drop("_lane", "_given", "_hint")
    named = rows.withColumns({"identity_key": F.concat(policy.provider_name(F.col("provider")), F.lit("|"), F.col("_found.lane")), "confidence": F.col("_found.confidence"), "named_by": F.col("_found.by")})
    return named.drop("_found")


def persistence_key(entries: DataFrame) -> Column:
    return F.concat(policy.provider_name(F.col("provider")), F.lit("|"), urls.canonical_path(F.col("stream_url"), False))


def rank_of(entries: DataFrame) -> Column:
    return quality.quality_rank(F.col("video_fps"), F.col("video_width"), F.col("video_height"), F.col("video_bitrate_bps"), F.col("video_scan_type"))


def signature_of(entries: DataFrame) -> Column:
    return quality.quality_signature(F.col("video_fps"), F.col("video_width"), F.col("video_height"), F.col("video_bitrate_bps"), F.col("video_scan_type"))


def state_of(entries: DataFrame) -> Column:
    return policy.candidate_state(F.col("provider"), F.col("launchable"), F.col("expiry"), F.col("probe_status"), F.col("access_blocked"), F.lit(""))


def group_by_identity(entries: DataFrame) -> DataFrame:
    """identity -> number of members and their catalogs, in order."""
    return feed_identity(entries).groupBy("identity_key").agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_set("playlist_url")), ",").alias("catalogs"))
