"""Which event a feed carries: rows whose metadata agree, conflicts that are newer, and the verdict on each feed.

Blank or null titles are no metadata: such a row agrees with nothing. Repeated rows count once per catalog. Empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanework.sources.shared import delete, stored

#: A shorter text says the same as a longer one that holds it only if it has this many characters.
CONTAINED = 8


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def metadata_values(*texts: Column) -> Column:
    """Distinct plain texts in the given order, blank ones left out."""
    return F.array_distinct(F.filter(F.array(*(plain(t) for t in texts)), lambda x: x != ""))


def compatible(left: Column, right: Column) -> Column:
    """Whether two value lists can name one event."""
    within = lambda a, b: (F.length(a) >= CONTAINED) & F.contains(b, a)
    return F.exists(left, lambda a: F.exists(right, lambda b: (a == b) | within(a, b) | within(b, a)))


def _links(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): values of one row, and values of which one holds the other; both directions.

    A value of the needed length is looked up by its first characters among all grams of the longer ones, so that no two
    values of a feed are compared without a common gram.
    """
    beside = rows.where(F.size("values") > 1).select(*keys, F.col("values")[0].alias("a"), F.explode(F.slice("values", F.lit(2), F.size("values") - 1)).alias("b"))
    named = rows.select(*keys, F.explode("values").alias("v")).distinct().where(F.length("v") >= CONTAINED)
    short = named.select(*keys, F.col("v").alias("a"), F.substring("v", 1, CONTAINED).alias("gram"))
    at = F.sequence(F.lit(1), F.length("v") - CONTAINED + 1)
    grams = F.array_distinct(F.transform(at, lambda i: F.substring(F.col("v"), i, F.lit(CONTAINED))))
    long = named.select(*keys, F.col("v").alias("b"), F.explode(grams).alias("gram"))
    held = short.join(long, [*keys, "gram"]).where("a <> b and contains(b, a)").select(*keys, "a", "b")
    one_way = beside.unionByName(held)
    return one_way.unionByName(one_way.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def value_clusters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, cluster): connected values of each feed, named by the smallest one.

    Labels move along links and jump to their label's label; every round is a written table, so a lost executor costs a
    task. Only the number of changed labels reaches the driver.
    """
    spark = rows.sparkSession
    links = stored(_links(rows, keys), "links")
    labels = stored(rows.select(*keys, F.explode("values").alias("value")).distinct().withColumn("cluster", F.col("value")), "labels")
    while True:
        heard = links.join(labels.withColumnRenamed("value", "a"), [*keys, "a"]).groupBy(*keys, F.col("b").alias("value")).agg(F.min("cluster").alias("heard"))
        near = labels.join(heard, [*keys, "value"], "left").withColumn("next", F.least("cluster", "heard"))
        further = labels.select(*keys, F.col("value").alias("next"), F.col("cluster").alias("jump"))
        moved = near.join(further, [*keys, "next"], "left").select(*keys, "value", F.least("next", "jump").alias("cluster"), (F.least("next", "jump") != F.col("cluster")).alias("changed"))
        before, moved = labels, stored(moved, "labels")
        labels = moved.drop("changed")
        delete(before)
        if moved.where("changed").isEmpty():
            delete(links)
            return labels


def conflict_clusters(entries: DataFrame, keys: tuple[str, ...] = ("identity_key",)) -> DataFrame:
    """(keys, cluster, n_rows, sources): rows of a feed that describe one event; a row without metadata is its own cluster.

    entries: (keys, playlist_url, entry_index, entry_title, tvg_name). sources counts different catalogs with a name.
    """
    keys = list(keys)
    rows = stored(entries.select(*keys, "playlist_url", "entry_index", metadata_values(F.col("entry_title"), F.col("tvg_name")).alias("values")), "rows")
    named = rows.where(F.size("values") > 0)
    labels = value_clusters(named, keys)
    placed = named.withColumn("value", F.col("values")[0]).join(labels, [*keys, "value"])
    own = F.concat_ws("|", F.lit(""), F.col("playlist_url"), F.col("entry_index").cast("string"))
    bare = rows.where(F.size("values") == 0).withColumn("cluster", own)
    every = placed.select(*keys, "cluster", "playlist_url").unionByName(bare.select(*keys, "cluster", "playlist_url"))
    return every.groupBy(*keys, "cluster").agg(F.count("*").alias("n_rows"), F.count_distinct(F.nullif("playlist_url", F.lit(""))).alias("sources"))


def newer_conflicts(entries: DataFrame, keys: tuple[str, ...] = ("identity_key",)) -> DataFrame:
    """Ignored rows fresher than every matching row of their feed; rows cleared of conflict or without a time take no part."""
    counted = entries.where(F.col("source_freshness_ts").isNotNull() & (~F.col("ignored") | F.coalesce("conflict", F.lit(True))))
    newest = counted.groupBy(*keys).agg(F.max(F.when(~F.col("ignored"), F.col("source_freshness_ts"))).alias("newest"))
    return counted.where("ignored").join(newest, list(keys)).where("newest is null or source_freshness_ts > newest").drop("newest")


def freshness_verdict(entries: DataFrame, keys: tuple[str, ...] = ("identity_key",)) -> DataFrame:
    """(keys, verdict) of one scan: eligible (nothing newer), confirmed (two catalogs agree on another event), ambiguous
    (newer rows disagree) or single (one newer event, to be seen again)."""
    clusters = conflict_clusters(newer_conflicts(entries, keys), keys)
    against = clusters.groupBy(*keys).agg(F.max("sources").alias("agree"), F.count("*").alias("clusters"))
    verdict = F.when(F.col("clusters").isNull(), "eligible").when(F.col("agree") >= 2, "confirmed").when(F.col("clusters") > 1, "ambiguous").otherwise("single")
    return entries.select(*keys).distinct().join(against, list(keys), "left").select(*keys, verdict.alias("verdict"))


def freshness_history(documents: DataFrame) -> DataFrame:
    """(source, fetched_at, freshness, evidence) of every fetch of a catalog.

    documents: (source, fetched_at, hash, commit_at, generated_at, modified_at). While the first content lasts, the best
    first evidence counts, and a commit time takes its place once known; a changed content is dated by its own fetch.
    Fetches of one source at one time are taken by hash.
    """
    from pyspark.sql import Window

    own = Window.partitionBy("source").orderBy("fetched_at", "hash")
    running = own.rowsBetween(Window.unboundedPreceding, 0)
    rows = documents.withColumn("changed", F.coalesce((F.lag("hash").over(own) != F.col("hash")).cast("int"), F.lit(0)))
    rows = rows.withColumns({
        "run": F.sum("changed").over(running),
        "since": F.last(F.when(F.col("changed") == 1, F.col("fetched_at")), ignorenulls=True).over(running),
        "committed": F.first("commit_at", ignorenulls=True).over(running),
        "generated": F.first("generated_at").over(running),
        "modified": F.first("modified_at").over(running),
    })
    first = F.coalesce("committed", "generated", "modified")
    kind = F.when(F.col("committed").isNotNull(), "commit").when(F.col("generated").isNotNull(), "generated").when(F.col("modified").isNotNull(), "last-modified").otherwise("unknown")
    return rows.select("source", "fetched_at", F.when(F.col("run") > 0, F.col("since")).otherwise(first).alias("freshness"), F.when(F.col("run") > 0, "observed").otherwise(kind).alias("evidence"))
