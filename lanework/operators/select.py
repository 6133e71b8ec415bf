"""The best source of each feed, why others lost, and better ones than the running source.

The best row is the least of a struct: negated ranks, then catalog and position, then what is to be known of it. So one
aggregate, combined on the map side, finds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanework.functions import policy, quality
from lanework.operators import identity


def selection_rank(entries: DataFrame) -> Column:
    """Preferred, then quality, then authorisation; earlier positions win ties."""
    unknown = policy.prefers_unknown(F.col("provider")) & F.col("expiry").isNull()
    return F.struct(F.coalesce("preferred", F.lit(0)).alias("preferred"), identity.rank_of(entries).alias("quality"), unknown.cast("int").alias("unknown_first"), F.coalesce(F.col("expiry"), F.lit(0.0)).cast("long").alias("expiry"))


def _safe(now: Column, column: str = "expiry") -> Column:
    return F.col(column).isNull() | (F.col(column) - now >= policy.MIN_REMAINING_S)


def _down(rank: Column, fields: tuple[str, ...]) -> list[Column]:
    return [(-rank[f]).alias(f"less_{f}") for f in fields]


def _order(rank: Column) -> list[Column]:
    """A selection rank, best first."""
    return [*_down(rank, ("preferred",)), *_down(rank["quality"], quality.RANK_FIELDS), *_down(rank, ("unknown_first", "expiry"))]


def _best(entries: DataFrame, now: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, best, considered, n_eligible, n_safe): best is a struct of the selected row's place, address, quality, expiry and preference; null if no row is eligible."""
    rows = entries.where("launchable")
    eligible = F.col("expiry").isNotNull() | policy.allows_unknown(F.col("provider"))
    rows = rows.withColumns({"_eligible": eligible, "_safe": eligible & _safe(F.lit(now)), "_rank": selection_rank(rows)})
    kept = ("playlist_url", "entry_index", "stream_url", "expiry", "preferred")
    row = F.struct((-F.col("_safe").cast("int")).alias("less_safe"), *_order(F.col("_rank")), *(F.col(c).alias(c) for c in kept), F.col("_rank.quality").alias("quality"))
    return rows.groupBy(*keys).agg(F.min(F.when(F.col("_eligible"), row)).alias("best"), F.count("*").alias("considered"), F.count_if("_eligible").alias("n_eligible"), F.count_if("_safe").alias("n_safe"))


def select_best(entries: DataFrame, now: int, keys: tuple[str, ...] = ("identity_key",)) -> DataFrame:
    """One row per key: the selected source, counts, and whether a short-lived one had to do.

    Input rows that cannot be launched are left out. Unknown expiry needs the provider's leave; among eligible rows those
    that live long enough come first, the others only if there is none.
    """
    return _best(entries, now, keys).select(
        *keys,
        F.col("best.playlist_url").alias("playlist_url"),
        F.col("best.entry_index").alias("entry_index"),
        F.col("best.stream_url").alias("selected_url"),
        F.when(F.col("n_eligible") == 0, "no_eligible_candidates").otherwise("selected").alias("decision"),
        ((F.col("n_eligible") > 0) & (F.col("n_safe") == 0)).alias("fallback_used"),
        "considered",
        F.when(F.col("n_safe") > 0, F.col("n_safe")).otherwise(F.col("n_eligible")).alias("eligible"),
    )


def explain_losers(entries: DataFrame, now: int) -> DataFrame:
    """Why each row that could be launched was not the selected one of its feed."""
    rows = entries.where("launchable").select("identity_key", "playlist_url", "entry_index", "provider", "expiry", "preferred", identity.rank_of(entries).alias("quality"))
    winner = _best(entries, now, ("identity_key",)).where("best is not null").select(
        "identity_key", F.col("best.playlist_url").alias("w_url"), F.col("best.entry_index").alias("w_index"), F.col("best.quality").alias("w_quality"), F.col("best.expiry").alias("w_expiry"), F.col("best.preferred").alias("w_preferred")
    )
    both = rows.join(winner, "identity_key").where((F.col("playlist_url") != F.col("w_url")) | (F.col("entry_index") != F.col("w_index")))
    but_bitrate = lambda c: F.struct(*(F.col(f"{c}.{x}") for x in ("known", "motion_class", "resolution_class", "motion", "scan_rank", "area", "height", "width")))
    now_col, lower, equal = F.lit(now), F.col("quality") < F.col("w_quality"), F.col("quality") == F.col("w_quality")
    prefers = policy.prefers_unknown(F.col("provider"))
    reason = (
        F.when(_safe(now_col, "w_expiry") & ~_safe(now_col), "less than 15 min remaining")
        .when(F.col("preferred") < F.col("w_preferred"), "less preferred match")
        .when(lower & (but_bitrate("quality") == but_bitrate("w_quality")) & (F.col("quality.bitrate") <= 0), "bitrate unknown")
        .when(lower, "lower quality")
        .when(equal & (F.col("expiry") < F.col("w_expiry")), "expires sooner")
        .when(equal & F.col("expiry").isNull() & F.col("w_expiry").isNotNull() & ~prefers, "expiry unknown")
        .when(equal & F.col("expiry").isNotNull() & F.col("w_expiry").isNull() & prefers, "equal quality; unknown-expiry source preferred")
        .when(equal, "equivalent alternative")
        .otherwise("another candidate ranked higher")
    )
    return both.select("identity_key", "playlist_url", "entry_index", F.concat(F.lit("not selected: "), reason).alias("reason"))


def select_upgrade(running: DataFrame, entries: DataFrame, now: int, target_fps: float) -> DataFrame:
    """Per running feed the best row of enough motion and life, no less preferred and of higher quality than what runs.

    running: (identity_key, preferred, quality).
    """
    rows = entries.where("launchable").withColumns({"_quality": identity.rank_of(entries), "_rank": selection_rank(entries)})
    kept = F.col("_quality.motion") >= target_fps
    kept &= F.when(F.col("expiry").isNull(), policy.allows_unknown(F.col("provider"))).otherwise(F.col("expiry") - now >= policy.MIN_REMAINING_S)
    base = running.select("identity_key", F.col("preferred").alias("r_preferred"), F.col("quality").alias("r_quality"))
    better = rows.where(kept).join(base, "identity_key").where("preferred >= r_preferred and _quality > r_quality")
    row = F.struct(*_order(F.col("_rank")), "playlist_url", "entry_index", F.col("stream_url").alias("upgrade_url"), F.col("_rank").alias("rank"))
    best = better.groupBy("identity_key").agg(F.count("*").alias("eligible"), F.min(row).alias("b"))
    return best.select("identity_key", "b.playlist_url", "b.entry_index", "b.upgrade_url", "eligible", F.col("b.rank.preferred").alias("preferred"), F.round("b.rank.quality.motion", 3).alias("motion"), F.col("b.rank.quality.height").alias("height"), F.col("b.rank.quality.bitrate").alias("bitrate"))


def top_k_sources(entries: DataFrame, k: int) -> DataFrame:
    """The k best launchable rows of each feed."""
    rows = entries.where("launchable")
    order = Window.partitionBy("identity_key").orderBy(selection_rank(rows).desc(), "playlist_url", "entry_index")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("identity_key", "place", "playlist_url", "entry_index")
