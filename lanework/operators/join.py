"""Joins of entries with evidence, schedules, earlier states and each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanework.operators import identity, select


def active_targets(targets: DataFrame, moments: DataFrame) -> DataFrame:
    """State of every target at every moment; a window is half-open. targets is a small, checked list of searches.

    targets: (name, enabled, active_from, active_until); moments: (at).
    """
    state = (
        F.when(~F.col("enabled"), "DISABLED")
        .when(F.col("active_from").isNull(), "ACTIVE")
        .when(F.col("at") < F.col("active_from"), "SCHEDULED")
        .when(F.col("active_until").isNotNull() & (F.col("at") >= F.col("active_until")), "EXPIRED")
        .otherwise("ACTIVE")
    )
    listed = F.collect_list(F.struct("name", "enabled", "active_from", "active_until"))
    every = moments.join(F.broadcast(targets.agg(listed.alias("t")).withColumn("one", F.lit(1))), F.lit(1) == F.col("one")).select("at", F.inline("t"))
    return every.select("at", "name", state.alias("state"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """left with right's latest value at or before each row's time (right first on equal times): one shuffle, one running window."""
    both = left.withColumns({"_value": F.lit(None).cast(dict(right.dtypes)[value]), "_side": F.lit(1)}).unionByName(right.select(*keys, time, F.col(value).alias("_value"), F.lit(0).alias("_side")), allowMissingColumns=True)
    own = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(own)).where("_side = 1").drop("_value", "_side")


def fill_quality(entries: DataFrame) -> DataFrame:
    """Missing height and frame rate filled from the best evidence of the same delivery path."""
    keyed = entries.withColumn("persistence_key", identity.persistence_key(entries))
    known = keyed.where("video_height > 0 and video_fps > 0").groupBy("persistence_key").agg(F.max(F.struct("video_height", "video_fps")).alias("evidence"))
    both = keyed.join(known, "persistence_key", "left")
    take = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.coalesce(F.col(f"evidence.{c}"), F.col(c)))
    filled = (F.col("evidence").isNotNull()) & ((F.col("video_height") <= 0) | (F.col("video_fps") <= 0))
    return both.select("playlist_url", "entry_index", "persistence_key", take("video_height").alias("video_height"), F.round(take("video_fps"), 3).alias("video_fps"), filled.alias("filled"))


def retain_failed(entries: DataFrame, failed: DataFrame) -> DataFrame:
    """Rows of the scan before that a failed catalog would lose: carried on as unavailable unless they are there again.

    failed: (n, playlist_url), scans at which a catalog could not be read.
    """
    keys = ["playlist_url", "identity_key", "entry_title"]
    before = entries.select((F.col("n") + 1).alias("n"), *keys).distinct()
    return before.join(failed, ["n", "playlist_url"], "left_semi").join(entries.select("n", *keys), ["n", *keys], "left_anti").withColumn("state", F.lit("SOURCE_UNAVAILABLE"))


def probe_fanout(entries: DataFrame) -> DataFrame:
    """One representative row per requested address (the first that has not expired, else the first), fanned out to all."""
    request = F.sha2(F.split_part(F.col("stream_url"), F.lit("|"), F.lit(1)), 256)
    rows = entries.withColumn("probe_key", request)
    pick = F.min(F.struct((F.col("probe_status") == "expired").cast("int").alias("late"), F.col("playlist_url").alias("playlist_url"), F.col("entry_index").alias("entry_index")))
    chosen = rows.groupBy("probe_key").agg(pick.alias("r"), F.count("*").alias("members"))
    return rows.join(chosen, "probe_key").select("playlist_url", "entry_index", "members", F.col("r.playlist_url").alias("probed_url"), F.col("r.entry_index").alias("probed_index"))


def launch_candidates(entries: DataFrame, owned: DataFrame, now: int, capacity: int) -> DataFrame:
    """Feeds with a selected source and no owner, in order of name; as many are admitted as the owned ones leave of the capacity, others suppressed.

    Only the first few are ordered globally: a top-k, not a full sort.
    """
    held = owned.select("identity_key").distinct()
    free = select.select_best(entries, now).where("decision = 'selected'").join(held, "identity_key", "left_anti")
    first = free.orderBy("identity_key").limit(capacity).select("identity_key", F.row_number().over(Window.orderBy("identity_key")).alias("place"))  # at most ``capacity`` rows
    admitted = first.join(F.broadcast(held.agg(F.count("*").alias("n"))), F.col("place") <= capacity - F.col("n")).select("identity_key", F.lit(True).alias("in"))
    return free.join(F.broadcast(admitted), "identity_key", "left").select("identity_key", "selected_url", F.when(F.col("in"), "ADMITTED").otherwise("SUPPRESSED").alias("decision"))
