"""What one scan hands to the next: quality once measured, and rows of catalogs that could not be read.

Rows, not tasks, grow with the scans: what windows order is one row per key and scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanework.functions import quality, urls
from lanework.operators import identity
from lanework.sources.shared import stored

#: Facts of quality, and the column that tells where each comes from.
FACTS = {
    "video_width": "video_resolution_source",
    "video_height": "video_resolution_source",
    "video_fps": "video_fps_source",
    "video_bitrate_bps": "video_bitrate_source",
    "video_scan_type": "video_scan_type_source",
}
LABELS = tuple(dict.fromkeys(FACTS.values()))


def merge_labels(*labels: Column) -> Column:
    """Labels joined by '+', each once, in order of first mention; null and blank ones are left out."""

    def merged(text: Column) -> Column:
        parts = F.array_remove(F.transform(F.split(text, r"\+"), lambda x: F.trim(x)), "")
        return F.when(text.contains("+"), F.array_join(F.array_distinct(parts), "+")).otherwise(F.trim(text))

    return urls.bound(F.concat_ws("+", *labels), merged)


def _known(entries: DataFrame, fact: str) -> Column:
    """A fact's value, or null where it is missing: null, not above zero, blank or no kind of scan."""
    if fact == "video_scan_type":
        return F.nullif(quality.scan_type(F.col(fact)), F.lit(""))
    return F.when(F.col(fact) > 0, F.col(fact))


def _label(entries: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in entries.columns else F.lit("")


def quality_evidence(entries: DataFrame, scan: str = "scan_id") -> DataFrame:
    """(persistence_key, scan, a struct (scan, value, label, source) per fact): what each scan knows of a delivery path.

    Of several values in one scan the greatest counts, then the greatest label: maxima, so neither the order of rows nor
    their split over tasks matters. Repeated evidence is folded before it moves. Rows without a path have no evidence.

    Keys and values are columns of their own, and rows without a path go after the fold: a filter before it would be moved
    to the input, and each row's address be taken apart again for it.
    """
    labels = {by: _label(entries, by).alias(f"_{by}") for by in LABELS}
    rows = entries.select(identity.persistence_key(entries).alias("persistence_key"), F.col(scan), *(_known(entries, f).alias(f) for f in FACTS), *labels.values(), _label(entries, "quality_source").alias("_source"))
    has = ~F.col("persistence_key").endswith("|")
    facts = [F.max(F.when(has & F.col(f).isNotNull(), F.struct(F.col(scan).alias("scan"), F.col(f).alias("value"), F.col(f"_{by}").alias("label"), F.col("_source").alias("source")))).alias(f) for f, by in FACTS.items()]
    return rows.groupBy("persistence_key", scan).agg(*facts, F.max(has).alias("_has")).where("_has").drop("_has")


def fold_evidence(evidence: DataFrame, scan: str = "scan_id") -> DataFrame:
    """evidence with, as known_<fact>, the newest of each fact from earlier scans of the same path (a scan never sees itself)."""
    before = Window.partitionBy("persistence_key").orderBy(scan).rowsBetween(Window.unboundedPreceding, -1)
    return evidence.select("persistence_key", scan, *(F.last(f, ignorenulls=True).over(before).alias(f"known_{f}") for f in FACTS))


def fill_persisted(entries: DataFrame, scan: str = "scan_id") -> DataFrame:
    """entries with missing facts of quality filled from earlier scans of the same delivery path; fresh facts stay as they are.

    entries: rows with the columns of FACTS, scan, provider and stream_url; label columns, quality_source and quality_known
    where there are any. A filled fact adds the label of what filled it behind the row's own; quality_source adds the sources
    of all filled facts, the newest first; quality_known becomes true. New or replaced: persistence_key, the labels,
    quality_source, quality_known, filled. Null paths are never filled; repeated rows stay.
    """
    known = fold_evidence(quality_evidence(entries, scan), scan)
    rows = entries.withColumn("persistence_key", identity.persistence_key(entries)).join(known, ["persistence_key", scan], "left")
    # Columns of their own, so that each is made once a row however often it is named below.
    rows = rows.withColumns({f"used_{f}": F.when(_known(entries, f).isNull(), F.col(f"known_{f}")) for f in FACTS})
    used = {f: F.col(f"used_{f}") for f in FACTS}
    # What filled a row, newest first; sorted as values, so without a call for each pair.
    newest = lambda facts, what: F.array_join(F.sort_array(F.array(*(F.when(used[f].isNotNull(), F.struct(used[f]["scan"].alias("scan"), used[f][what].alias("label"))) for f in facts)), asc=False)["label"], "+")
    said = {by: [f for f in FACTS if FACTS[f] == by] for by in LABELS}
    labels = {by: merge_labels(_label(entries, by), newest(facts, "label") if len(facts) > 1 else used[facts[0]]["label"]) for by, facts in said.items()}
    filled = F.greatest(*(u.isNotNull() for u in used.values()))
    was_known = F.coalesce(F.col("quality_known"), F.lit(False)) if "quality_known" in entries.columns else F.greatest(*(_known(entries, f).isNotNull() for f in FACTS))
    put = {f: F.coalesce(_known(entries, f), u["value"], F.col(f)) for f, u in used.items()} | labels
    put |= {"quality_source": merge_labels(_label(entries, "quality_source"), newest(FACTS, "source")), "quality_known": was_known | filled, "filled": filled}
    return rows.withColumns(put).drop(*(f"{x}_{f}" for f in FACTS for x in ("known", "used")))


#: What names a catalog that could not be read, and a row within it.
SOURCE = ("playlist_url", "provider", "source_group")
OBSERVED = ("entry_index", "stream_url", "tvg_name", "group_title", "entry_title")


def _source_names(rows: DataFrame) -> DataFrame:
    """Names of a source as they are compared: provider and group trimmed and in upper case."""
    upper = lambda c, blank: F.coalesce(F.nullif(F.upper(F.trim(F.col(c))), F.lit("")), F.lit(blank))
    return rows.withColumns({"playlist_url": F.coalesce("playlist_url", F.lit("")), "provider": upper("provider", "UNKNOWN"), "source_group": upper("source_group", "")})


def definition_versions(definitions: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(target, since, until, enabled, active_from, active_until): spans in which a search's definition stays the same.

    definitions: (target, since, enabled, active_from, active_until, fields). A definition that is saved again unchanged goes
    on; of two saved at one time the greater counts, by enabled, active_from, active_until and fields, nulls least.
    """
    window = ("enabled", "active_from", "active_until")
    saved = definitions.groupBy("target", "since").agg(F.max(F.struct(*window, *fields)).alias("d"))
    saved = saved.withColumn("print", F.sha2(F.to_json("d"), 256))
    own = Window.partitionBy("target").orderBy("since")
    changed = saved.withColumn("same", F.lag("print").over(own).eqNullSafe(F.col("print"))).where("not same")
    return changed.select("target", "since", F.lead("since").over(own).alias("until"), "d.enabled", "d.active_from", "d.active_until")


def retain_unchanged(entries: DataFrame, failed: DataFrame, definitions: DataFrame, scans: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(n, target, SOURCE, OBSERVED, state): rows carried on, scan by scan, while their catalog can't be read.

    entries: (n, target, SOURCE, OBSERVED); failed: (n, SOURCE), catalogs unread at a scan; definitions as in
    ``definition_versions``; scans: (n, at). A row is carried to the next scan if its catalog failed there, its search is
    active there and defined as at the scan before, and the row is not there by itself. The first scan that breaks this ends
    it. Names of sources are compared trimmed and in upper case, null texts as blank; repeated rows are carried once.

    A chain is found from its first step, not scan by scan: how long the catalog stays unread, until when the definition
    lasts, and when the row is seen again.
    """
    keys = ["target", *SOURCE, *OBSERVED]
    plain = _source_names(entries).withColumns({c: F.coalesce(c, F.lit("")) for c in OBSERVED if c != "entry_index"} | {"entry_index": F.coalesce("entry_index", F.lit(0))})
    # Dealt by all that names a row but its scan: repeats and the next time it is seen are then found where it lies.
    seen = plain.select("n", *keys).repartition(*keys).distinct().withColumn("again", F.lead("n").over(Window.partitionBy(*keys).orderBy("n")))
    source = Window.partitionBy(*SOURCE)
    runs = _source_names(failed).select("n", *SOURCE).distinct().withColumn("run", F.col("n") - F.row_number().over(source.orderBy("n")))
    runs = runs.select((F.col("n") - 1).alias("n"), *SOURCE, F.max("n").over(Window.partitionBy(*SOURCE, "run")).alias("unread_to"))
    # What is joined to the rows is stored, so that its size is known beforehand: if small, the rows need not move for it.
    runs, scans = stored(runs, "unread"), stored(scans.select("n", "at"), "scans")
    starts = seen.join(runs, ["n", *SOURCE]).withColumn("last", F.least("unread_to", F.col("again") - 1)).where("last > n")
    # The definition that holds at a start, and whether the search is active in the next scan already. All scans of a search's
    # rows are asked, a superset that is folded before it moves: starts need not be found twice.
    moments = plain.select("target", "n").distinct().join(scans.select("n", "at"), "n").join(scans.select((F.col("n") - 1).alias("n"), F.col("at").alias("next_at")), "n")
    held = moments.join(definition_versions(definitions, fields), "target").where("since <= at and (until is null or next_at < until)")
    held = held.where("enabled and (active_from is null or next_at >= active_from)").select("target", "n", "until", F.when(F.col("active_from").isNotNull(), F.col("active_until")).alias("ends"))
    steps = starts.join(stored(held, "held"), ["target", "n"]).select(*keys, "until", "ends", F.explode(F.sequence(F.col("n") + 1, "last")).alias("n"))
    kept = steps.join(scans.select("n", "at"), "n").where("(until is null or at < until) and (ends is null or at < ends)")
    return kept.select("n", *keys, F.lit("SOURCE_UNAVAILABLE").alias("state"))
