"""What changed between consecutive scans, for all scans of a history in one job.

Scans are numbered first (a small table); a feed's rows are compared with its own previous row, so each comparison is one
window over narrow rows instead of a join of two snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanework.operators import identity


def numbered(rows: DataFrame, scan: str = "scan_id") -> DataFrame:
    """rows with n, the place of their scan in order, and last, the place of the last scan."""
    scans = rows.select(scan).distinct()
    order = scans.withColumn("n", F.row_number().over(Window.orderBy(scan))).withColumn("last", F.count("*").over(Window.partitionBy()))
    return rows.join(F.broadcast(order), scan)  # a row a scan, numbered by one task: rows do not move by scan for it


def _told(rows: DataFrame, keys: list[str], *cases: tuple[Column, Column, str]) -> DataFrame:
    """(keys, n, marker) of the cases (condition, scan, marker) that hold, in one pass."""
    said = F.array_compact(F.array(*(F.when(cond, F.struct(n.cast("int").alias("n"), F.lit(marker).alias("marker"))) for cond, n, marker in cases)))
    return rows.withColumn("_said", said).select(*keys, F.inline("_said"))


def _came_and_went(own) -> tuple[Column, Column]:
    """Whether a key was not there at the scan before, and will not be at the next, where there is one."""
    before, after, n = F.lag("n").over(own), F.lead("n").over(own), F.col("n")
    return (n > 1) & (before.isNull() | (before < n - 1)), (n < F.col("last")) & (after.isNull() | (after > n + 1))


def appearances(rows: DataFrame, keys: list[str], came: str, went: str) -> DataFrame:
    """(keys, n, marker): a key that the scan before did not have, and, at the next scan, one that it no longer has."""
    seen = numbered(rows.select("scan_id", *keys).distinct())
    new, gone = _came_and_went(Window.partitionBy(*keys).orderBy("n"))
    return _told(seen, keys, (new, F.col("n"), came), (gone, F.col("n") + 1, went))


def diff_identities(entries: DataFrame) -> DataFrame:
    return appearances(entries, ["identity_key"], "NEW", "REMOVED")


def _by_feed(rows: DataFrame) -> DataFrame:
    """Dealt by feed once: windows over a feed, and over any finer key of it, then need no further exchange."""
    return numbered(rows.distinct()).repartition("identity_key")


def _fed(step: int) -> Column:
    """Whether the feed has any row in the scan before (-1) or after (1)."""
    return F.count("*").over(Window.partitionBy("identity_key").orderBy("n").rangeBetween(step, step)) > 0


def diff_blocks(entries: DataFrame, policy: str = "policy") -> DataFrame:
    """(policy, identity_key, n, marker): feeds that appeared or went. A feed that only moves between policies is neither."""
    seen = _by_feed(entries.select("scan_id", policy, "identity_key"))
    new, gone = _came_and_went(Window.partitionBy("identity_key", policy).orderBy("n"))
    return _told(seen, [policy, "identity_key"], (new & ~_fed(-1), F.col("n"), "NEW"), (gone & ~_fed(1), F.col("n") + 1, "REMOVED"))


def diff_sources(entries: DataFrame) -> DataFrame:
    """Catalogs that joined or left a feed that both scans have."""
    seen = _by_feed(entries.select("scan_id", "identity_key", "playlist_url"))
    new, gone = _came_and_went(Window.partitionBy("identity_key", "playlist_url").orderBy("n"))
    return _told(seen, ["identity_key", "playlist_url"], (new & _fed(-1), F.col("n"), "SOURCE+"), (gone & _fed(1), F.col("n") + 1, "SOURCE-"))


#: What a feed's catalog is compared by: the words of an update, and the column that they tell of.
COMPARED = {"Event": "entry_title", "Group": "group_title", "TVG": "tvg_name", "Candidate states": "state"}


def summary(entries: DataFrame, *more: Column) -> DataFrame:
    """(scan_id, identity_key, playlist_url, entry_title, group_title, tvg_name, state, works): what a scan says of each feed's catalogs.

    Titles, groups, names and states are sorted sets, as text; '-' if there is none. More aggregates may follow.
    """
    rows = entries.withColumn("state", identity.state_of(entries))
    text = lambda c: F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), " / "), F.lit("")), F.lit("-"))
    works = (F.max(F.when(F.col("state") == "WORKING", 1).otherwise(0)) == 1).alias("works")
    return rows.groupBy("scan_id", "identity_key", "playlist_url").agg(*(text(c).alias(c) for c in COMPARED.values()), works, *more)


def _with_details(seen: DataFrame) -> DataFrame:
    """seen with details, what changed since the scan before, and state_changed. A catalog that the scan before does not have has neither."""
    own = Window.partitionBy("identity_key", "playlist_url").orderBy("n")
    follows = F.lag("n").over(own) == F.col("n") - 1
    was = {c: F.lag(c).over(own) for c in COMPARED.values()}
    changed = [F.when(follows & (was[c] != F.col(c)), F.concat(F.lit(f"{label} "), was[c], F.lit(" -> "), F.col(c))) for label, c in COMPARED.items()]
    return seen.withColumns({"details": F.concat_ws("; ", *changed), "state_changed": F.coalesce(follows & (was["state"] != F.col("state")), F.lit(False))})


#: Said of a feed of which ``works`` differs from the scan before.
TURNED = ("Identity state UNUSABLE -> AVAILABLE", "Identity state AVAILABLE -> UNUSABLE")


def diff_updates(entries: DataFrame) -> DataFrame:
    """(identity_key, playlist_url, n, details): what changed in a feed's catalog since the scan before, if both have it.

    Titles, groups, names and states of its rows are compared as sorted sets. A feed whose overall state changed has a row
    without a catalog, unless a catalog's states changed at that scan, which says it already.
    """
    seen = _with_details(numbered(summary(entries)).repartition("identity_key"))
    updates = seen.where("details <> ''").select("identity_key", "playlist_url", "n", "details")
    feeds = seen.groupBy("identity_key", "n").agg(F.bool_or("works").alias("works"), F.bool_or("state_changed").alias("told"))
    feed = Window.partitionBy("identity_key").orderBy("n")
    turned = (F.lag("n").over(feed) == F.col("n") - 1) & (F.lag("works").over(feed) != F.col("works")) & ~F.col("told")
    said = F.when(F.col("works"), TURNED[0]).otherwise(TURNED[1])
    states = feeds.select("identity_key", F.lit(None).cast("string").alias("playlist_url"), "n", F.when(turned, said).alias("details")).where("details is not null")
    return updates.unionByName(states)


def summary_with_quality(entries: DataFrame) -> DataFrame:
    """summary with best, the highest rank and its signature among launchable rows (null without one): all that ``all_changes`` needs of a scan."""
    best = F.struct(identity.rank_of(entries).alias("rank"), identity.signature_of(entries).alias("signature"))
    # Made for every row: within a condition nothing is shared, and the compiled method passes the JVM's limit and runs interpreted.
    return summary(entries.withColumn("_best", best), F.expr("max(_best) FILTER (WHERE launchable)").alias("best"))


def all_changes(summaries: DataFrame) -> DataFrame:
    """(scan_id, identity_key, playlist_url, marker, details) of every change from one scan to the next.

    Markers: NEW and REMOVED feeds, SOURCE+ and SOURCE- catalogs of a feed that both scans have, UPDATE as in
    ``diff_updates``, QUALITY+ and QUALITY- as in ``diff_quality`` (of feeds that both scans can launch). summaries: rows of
    ``summary_with_quality``. They are dealt by feed once; all comparisons are windows over that.
    """
    by_scan = Window.orderBy("scan_id")  # over the distinct scans only
    scans = summaries.select("scan_id").distinct().select("scan_id", F.row_number().over(by_scan).alias("n"), F.lead("scan_id").over(by_scan).alias("next_scan"))
    seen = _with_details(summaries.join(scans, "scan_id").repartition("identity_key"))
    n, here, there, nothing = F.col("n"), F.col("scan_id"), F.col("next_scan"), F.lit(None).cast("string")
    say = lambda cond, scan, marker, details: F.when(cond, F.struct(scan.alias("at"), F.lit(marker).alias("marker"), details.alias("details")))
    told = lambda rows, catalog, *said: rows.withColumn("_said", F.array_compact(F.array(*said))).select("identity_key", catalog.alias("playlist_url"), F.inline("_said"))

    own = Window.partitionBy("identity_key", "playlist_url").orderBy("n")
    absent = lambda window, step: ~F.coalesce((F.lag("n", 1) if step < 0 else F.lead("n", 1)).over(window) == n + step, F.lit(False))
    catalogs = seen.withColumns({"came": absent(own, -1) & _fed(-1), "went": absent(own, 1) & _fed(1)})
    by_catalog = told(catalogs, F.col("playlist_url"), say(F.col("came"), here, "SOURCE+", nothing), say(F.col("went"), there, "SOURCE-", nothing), say(F.col("details") != "", here, "UPDATE", F.col("details")))

    feeds = seen.groupBy("identity_key", "n", "scan_id", "next_scan").agg(F.bool_or("works").alias("works"), F.bool_or("state_changed").alias("told"), F.max("best").alias("best"))
    feed = Window.partitionBy("identity_key").orderBy("n")
    feeds = feeds.withColumns({"came": absent(feed, -1), "went": absent(feed, 1), "was": F.lag("best").over(feed), "worked": F.lag("works").over(feed)})
    stayed = ~F.col("came")
    better = F.col("best.rank") > F.col("was.rank")
    quality = F.concat(F.col("was.signature"), F.lit(" -> "), F.col("best.signature"))
    by_feed = told(
        feeds,
        nothing,
        say(F.col("came") & (n > 1), here, "NEW", nothing),
        say(F.col("went") & there.isNotNull(), there, "REMOVED", nothing),
        say(stayed & (F.col("works") != F.col("worked")) & ~F.col("told"), here, "UPDATE", F.when(F.col("works"), TURNED[0]).otherwise(TURNED[1])),
        say(stayed & better, here, "QUALITY+", quality),
        say(stayed & ~better & (F.col("best.signature") != F.col("was.signature")), here, "QUALITY-", quality),
    )
    return by_catalog.unionByName(by_feed).select(F.col("at").alias("scan_id"), "identity_key", "playlist_url", "marker", "details")


def best_per_scan(entries: DataFrame) -> DataFrame:
    rows = entries.where("launchable").withColumns({"rank": identity.rank_of(entries), "signature": identity.signature_of(entries)})
    return numbered(rows.groupBy("scan_id", "identity_key").agg(F.max(F.struct("rank", "signature")).alias("best")))


def diff_quality(entries: DataFrame) -> DataFrame:
    """QUALITY+ where the best rank rose since the scan before, QUALITY- where it did not but the signature changed."""
    own = Window.partitionBy("identity_key").orderBy("n")
    rows = best_per_scan(entries).withColumns({"before": F.lag("best").over(own), "n_before": F.lag("n").over(own)}).where("n_before = n - 1")
    marker = F.when(F.col("best.rank") > F.col("before.rank"), "QUALITY+").when(F.col("best.signature") != F.col("before.signature"), "QUALITY-")
    return rows.withColumn("marker", marker).where("marker is not null").select("identity_key", "n", "marker", F.col("before.signature").alias("was"), F.col("best.signature").alias("is"))


def row_last_updated(entries: DataFrame) -> DataFrame:
    """Last scan at which a row's signature changed; an absence in between is no change."""
    keys = ["identity_key", "playlist_url", "entry_title"]
    rows = entries.withColumn("signature", identity.signature_of(entries)).groupBy("scan_id", *keys).agg(F.max("signature").alias("signature"))
    own = Window.partitionBy(*keys).orderBy("scan_id")
    changed = rows.withColumn("was", F.lag("signature").over(own)).withColumn("at", F.when(F.col("was").isNull() | (F.col("was") != F.col("signature")), F.col("scan_id")))
    return changed.groupBy(*keys).agg(F.max("at").alias("updated_scan"), F.count("*").alias("scans"))


def last_known_quality(entries: DataFrame) -> DataFrame:
    """Per feed and scan the best working bitrate, or that of the last scan that had one."""
    rows = entries.groupBy("identity_key", "scan_id").agg(F.max(F.when(F.col("launchable"), F.col("video_bitrate_bps"))).alias("bitrate"))
    own = Window.partitionBy("identity_key").orderBy("scan_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("known_bitrate", F.last("bitrate", ignorenulls=True).over(own)).select("identity_key", "scan_id", "bitrate", "known_bitrate")


def source_numbers(entries: DataFrame) -> DataFrame:
    """Catalogs numbered by first appearance; only distinct catalogs reach the one ordering task."""
    first = entries.groupBy("playlist_url").agg(F.min(F.struct("scan_id", "entry_index")).alias("first"))
    return first.select("playlist_url", F.row_number().over(Window.orderBy("first", "playlist_url")).alias("number"))


def collapse_changes(changes: DataFrame) -> DataFrame:
    """The first of equal changes of a feed."""
    return changes.groupBy("identity_key", "marker", "was", "is").agg(F.min("n").alias("n"), F.count("*").alias("times"))


def scan_history(entries: DataFrame) -> DataFrame:
    """(n, marker, changes): how many feeds, catalogs and qualities changed at each scan of the history."""
    parts = [f(entries).select("n", "marker") for f in (diff_identities, diff_sources, diff_quality)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("n", "marker").agg(F.count("*").alias("changes"))
