"""Searches and the catalogs they read: cleaning, scope, changes, launch and recovery.

Group names are compared trimmed and in upper case; null or blank ones are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanework.functions import policy
from lanework.operators import select

SHARED = "COMMON"


def _clean(groups: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(groups, F.array().cast("array<string>")), lambda g: F.upper(F.trim(g))), lambda g: g.isNotNull() & (g != "")))


def phrase_groups(groups: Column) -> Column:
    """And-of-or lists without blank alternatives and without groups that have none left."""
    inner = F.transform(F.coalesce(groups, F.array().cast("array<array<string>>")), lambda g: F.filter(F.transform(g, lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != "")))
    return F.filter(inner, lambda g: F.size(g) > 0)


def prepare_targets(config: DataFrame) -> DataFrame:
    """One row per name, with error: an enabled search beats disabled ones, of which the first stays; two enabled ones are an error.

    config: (ord, name, enabled, duration_min, ...). A duration that is not positive is an error too; '' means none.
    """
    rows = config.withColumn("name", F.trim("name")).where("name <> ''")
    own = Window.partitionBy("name")
    twice = F.count_if(F.coalesce("enabled", F.lit(True))).over(own) > 1
    place = F.row_number().over(own.orderBy(F.coalesce("enabled", F.lit(True)).desc(), "ord"))
    error = F.when(F.col("_twice") & F.coalesce("enabled", F.lit(True)), "enabled twice").when(F.col("duration_min") <= 0, "duration is not positive").otherwise("")
    return rows.withColumns({"_twice": twice, "_place": place}).where("_place = 1").withColumn("error", error).drop("_twice", "_place")


def resolve_scope(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """(name, group_ord, source_group, context, source_ord, url, error): what each search reads, a catalog once per group.

    targets: (name, source_groups); sources: (bucket, source_ord, url). The shared bucket takes its meaning from the only
    other group of the search; with none or several it is an error row, as is a group without catalogs.
    """
    cleaned = targets.select("name", _clean(F.col("source_groups")).alias("groups"))
    others = F.filter("groups", lambda g: g != SHARED)
    wanted = cleaned.select("name", others.alias("others"), F.posexplode("groups").alias("group_ord", "source_group"))
    alone = F.size("others") == 1
    wanted = wanted.select("name", "group_ord", "source_group", F.when(F.col("source_group") != SHARED, F.col("source_group")).when(alone, F.col("others")[0]).alias("context"))
    named = sources.where("url <> ''").groupBy(F.upper(F.trim("bucket")).alias("source_group"), "url").agg(F.min("source_ord").alias("source_ord"))
    # Groups are few and searches many: each group's searches are dealt to as many parts as a shuffle has, and its catalogs go to every part.
    parts = max(1, int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = wanted.where("context is not null").withColumn("_part", F.pmod(F.xxhash64("name"), F.lit(parts))).repartition("source_group", "_part")
    named = named.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    # A search whose shared bucket has no meaning reads nothing from it.
    usable = dealt.join(named, ["source_group", "_part"], "left").drop("_part")
    wrong = wanted.where("context is null").withColumns({"url": F.lit(None).cast("string"), "source_ord": F.lit(None).cast(dict(named.dtypes)["source_ord"])})
    error = F.when(F.col("context").isNull(), "shared group needs one other group").when(F.col("url").isNull(), "no catalogs").otherwise("")
    return usable.unionByName(wrong).select("name", "group_ord", "source_group", "context", "source_ord", "url", error.alias("error"))


def diff_targets(before: DataFrame, after: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(name, change, fields): searches added, removed and updated, with the names of the fields that differ."""
    put = lambda df, side: df.select("name", F.struct(*fields).alias(side))
    both = put(before, "was").join(put(after, "now"), "name", "full")
    differ = F.filter(F.array(*(F.when(~F.col(f"was.{f}").eqNullSafe(F.col(f"now.{f}")), f) for f in fields)), lambda x: x.isNotNull())
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.size(differ) > 0, "updated")
    found = both.select("name", change.alias("change"), F.when(F.col("was").isNotNull() & F.col("now").isNotNull(), F.array_join(differ, ",")).otherwise("").alias("fields"))
    return found.where("change is not null")


def launch_plan(contexts: DataFrame, now: int) -> DataFrame:
    """(identity_key, playlist_url, entry_index, targets, duration_min): the selected row of a feed and the searches that found it.

    contexts: entries with (target, duration_min), a row per search. The duration is the longest, null if any has no end.
    Feeds without an eligible row are left out.
    """
    chosen = select.select_best(contexts, now).where("decision = 'selected'").select("identity_key", "playlist_url", "entry_index", "selected_url")
    mine = contexts.where("launchable").select("identity_key", "playlist_url", "entry_index", F.col("stream_url").alias("selected_url"), "target", "duration_min")
    place = ["identity_key", "playlist_url", "entry_index", "selected_url"]
    # Dealt by place: a join that turns out small on one side would else read what one task wrote, a whole file's rows, in one task.
    winning = chosen.join(mine.repartition(*place), place)
    duration = F.when(~F.bool_or(F.col("duration_min").isNull()), F.max("duration_min"))
    return winning.groupBy("identity_key", "playlist_url", "entry_index").agg(F.array_join(F.array_sort(F.collect_set("target")), ",").alias("targets"), duration.alias("duration_min"))


def recovery_scope(plan: DataFrame, scope: DataFrame) -> DataFrame:
    """(identity_key, target, source_group, urls): for each winning search the catalogs of its groups of the feed's provider, in order.

    plan: (identity_key, targets) with targets joined by commas; scope: rows of resolve_scope.
    """
    wanted = plan.select("identity_key", F.explode(F.split("targets", ",")).alias("name"), F.split_part("identity_key", F.lit("|"), F.lit(1)).alias("provider"))
    mine = scope.where("error = ''").withColumn("provider", policy.provider_name(F.col("context")))
    found = wanted.join(mine, ["name", "provider"]).groupBy("identity_key", F.col("name").alias("target"), "source_group").agg(F.array_sort(F.collect_set(F.struct("source_ord", "url"))).alias("x"))
    return found.select("identity_key", "target", "source_group", F.array_join(F.transform("x", lambda x: x["url"]), ",").alias("urls"))


def recovery_lookup(plan: DataFrame, scope: DataFrame, modes: dict[str, str], mode: str = "EVENT_PHRASE") -> DataFrame:
    """(identity_key, url, target, match_mode, place): the inverse of ``recovery_scope``, with which searches a catalog is read.

    modes: how each group's meaning is matched; ``mode`` for others. place orders the searches of a feed as its plan does and
    then their groups; a search that meets a catalog in several groups of one mode stands once, at its first place.
    """
    wanted = plan.select("identity_key", F.posexplode(F.split("targets", ",")).alias("ord", "target"), F.split_part("identity_key", F.lit("|"), F.lit(1)).alias("provider"))
    named = F.try_element_at(F.create_map(*(F.lit(x) for pair in modes.items() for x in pair)), F.col("context")) if modes else F.lit(None).cast("string")
    mine = scope.where("error = ''").select(F.col("name").alias("target"), "group_ord", "url", policy.provider_name(F.col("context")).alias("provider"), F.coalesce(named, F.lit(mode)).alias("match_mode"))
    return wanted.join(mine, ["target", "provider"]).groupBy("identity_key", "url", "target", "match_mode").agg(F.min(F.struct("ord", "group_ord")).alias("place"))


def recovery_contexts(lookup: DataFrame, asked: DataFrame) -> DataFrame:
    """(identity_key, playlist_url, contexts): searches with their modes, in order, by which a feed may be found again in a catalog.

    asked: (identity_key, playlist_url); a null or blank address asks for all of the feed's searches; what is not in scope gets
    an empty list. Repeated questions are answered once.
    """
    questions = asked.select("identity_key", F.trim(F.coalesce("playlist_url", F.lit(""))).alias("playlist_url")).distinct()
    every = lookup.groupBy("identity_key", "target", "match_mode").agg(F.min("place").alias("place")).withColumn("playlist_url", F.lit(""))
    named = lookup.where("url <> ''").select("identity_key", "target", "match_mode", "place", F.col("url").alias("playlist_url"))
    found = questions.join(named.unionByName(every), ["identity_key", "playlist_url"], "left")
    met = F.when(F.col("place").isNotNull(), F.struct("place", F.concat_ws(":", "target", "match_mode").alias("context")))
    return found.groupBy("identity_key", "playlist_url").agg(F.transform(F.array_sort(F.collect_list(met)), lambda x: x["context"]).alias("contexts"))
