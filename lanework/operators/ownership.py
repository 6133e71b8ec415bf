"""The ownership machine over an event log, as windows; with a limit of owned feeds per session, in two stages.

Per session and feed: the first claim wins; a bind names a worker while the feed is launching; a transition holds if
``states.ALLOWED`` has it and, for RECORDING and WAITING_FOR_SOURCE, a worker is named. Two properties of that table make
windows enough: a state that is not final may go to every other but LAUNCHING, and final states to none. So a feed stands
where its last event leads that could ever hold, and refused events leave it there.

A capacity makes the claims of a session depend on each other, and nothing else: a final state may follow any owned one, so
where a claim's ownership would end is known from its feed's own events. ``claims_of`` settles that for each feed by itself;
``admit`` then goes through the claims of a session in order, three numbers a claim, holding no more than the ends of the feeds
that are owned at the moment and the names of those that will be claimed again; ``decide`` gives every event its reason once it
knows which claim of its feed was admitted. No task holds a session's events.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lanework.functions import states
from lanework.plans.ship import ship

FINAL = states.FINAL
assert all(set(to) == set(states.ALLOWED) - {"LAUNCHING", s} for s, to in states.ALLOWED.items() if s in states.OWNED)
FEED = ["session_id", "identity_key"]


def decide(events: DataFrame, admitted: DataFrame | None = None) -> DataFrame:
    """events with accepted and reason. Without a column worker_pid no worker is asked for.

    admitted: (session_id, identity_key, admitted_seq), the claim of each feed that the capacity let in; without it the
    first one is.
    """
    return decided(events, admitted).select(*FEED, "seq", "new_state", (F.col("reason") == "").alias("accepted"), "reason")


def decided(events: DataFrame, admitted: DataFrame | None = None) -> DataFrame:
    """(session_id, identity_key, seq, new_state, worker, reason, asked): new_state as it stands after an event that holds, asked the event's own."""
    own = Window.partitionBy(*FEED).orderBy("seq")
    upto, before = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    asked = "worker_pid" in events.columns
    op, new, worker = F.col("op"), F.col("new_state"), F.col("worker_pid") if asked else F.lit(1)
    if admitted is None:
        rows = events.withColumn("claims", F.count_if(op == "claim").over(upto))
        claim = F.when(F.col("claims") == 1, "").otherwise("claimed already")
    else:
        rows = events.join(admitted, FEED, "left").withColumn("claims", F.coalesce((F.col("seq") >= F.col("admitted_seq")).cast("int"), F.lit(0)))
        claim = F.when(F.col("claims") == 0, "no capacity").when(F.col("seq") == F.col("admitted_seq"), "").otherwise("claimed already")
    known, bad = F.coalesce(new.isin(*states.ALLOWED), F.lit(False)), F.coalesce(worker <= 0, F.lit(False))
    move, bind = op == "transition", op == "bind"
    # Events that hold in some state: binds that name a worker, and moves to a state that some state may go to.
    able = (F.col("claims") >= 1) & ~bad & ((bind & worker.isNotNull()) | (move & known & (new != "LAUNCHING")))
    rows = rows.withColumn("able", F.coalesce(able, F.lit(False)))
    named = F.max(F.when(F.col("able") & (bind | new.isin(*states.NEEDS_WORKER)) & (worker > 0), 1)).over(upto) == 1
    rows = rows.withColumn("idle", F.col("able") & move & new.isin(*states.NEEDS_WORKER) & ~F.coalesce(named, F.lit(False)))
    holds = F.col("able") & move & ~F.col("idle")
    over = F.coalesce(F.max(F.when(holds & new.isin(*FINAL), 1)).over(before), F.lit(0)) == 1
    rows = rows.withColumns({"over": over, "now": F.coalesce(F.last(F.when(holds, new), ignorenulls=True).over(before), F.lit("LAUNCHING"))})
    reason = (
        F.when(op == "claim", claim)
        .when(bind & (bad | worker.isNull()), "bad worker")
        .when(move & ~known, "no such state")
        .when(bad, "bad worker")
        .when(F.col("claims") == 0, "not claimed")
        .when(bind, F.when(F.col("over") | (F.col("now") != "LAUNCHING"), "not launching").otherwise(""))
        .when(F.col("over"), "final")
        .when((new == F.col("now")) | (new == "LAUNCHING"), "not allowed")
        .when(F.col("idle"), "no worker")
        .otherwise("")
    )
    stands = F.when(op == "claim", "LAUNCHING").when(bind, F.col("now")).otherwise(new)
    return rows.withColumn("reason", reason).select(*FEED, "seq", stands.alias("new_state"), worker.alias("worker"), "reason", new.alias("asked"))


def claims_of(events: DataFrame) -> DataFrame:
    """(session_id, seq, identity_key, ends, again): every claim, where its feed's ownership would end if it were admitted, and whether a later claim of the feed follows."""
    after = Window.partitionBy(*FEED).orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    worker = F.col("worker_pid") if "worker_pid" in events.columns else F.lit(1)
    # The first move to a final state that is not refused for its worker: no state before it matters.
    final = (F.col("op") == "transition") & F.col("new_state").isin(*FINAL) & F.coalesce(worker > 0, F.lit(True))
    rows = events.withColumns({"ends": F.min(F.when(final, F.col("seq"))).over(after), "again": F.coalesce(F.max(F.when(F.col("op") == "claim", 1)).over(after), F.lit(0)) == 1})
    return rows.where("op = 'claim'").select("session_id", "seq", "identity_key", "ends", "again")


def admit(claims: DataFrame, capacity: int) -> DataFrame:
    """(session_id, identity_key, admitted_seq) of the claims that find room, session by session in order of seq.

    A claim with a negative seq stands for a feed that is held already and takes its place without being asked. A feed that
    was admitted is not admitted again. A session's claims stream through one task, which keeps at most ``capacity`` ends.
    """
    ship(claims.sparkSession)
    schema = StructType([*(claims.schema[c] for c in FEED), *StructType.fromDDL("admitted_seq long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, began, ends, endless, taken = None, False, [], 0, set()
        for batch in batches:
            kept = []
            for i, (own, seq, feed, end, again) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if not began or own != session:
                    session, began, ends, endless, taken = own, True, [], 0, set()
                while ends and ends[0] < seq:
                    heapq.heappop(ends)
                if feed in taken or seq >= 0 and len(ends) + endless >= capacity:
                    continue
                kept.append(i)
                if again:
                    taken.add(feed)
                if end is None:
                    endless += 1
                else:
                    heapq.heappush(ends, end)
            found = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(2), found.column(1)], names=schema.names)

    dealt = claims.select("session_id", F.col("seq").cast("long").alias("seq"), "identity_key", F.col("ends").cast("long").alias("ends"), "again")
    return dealt.repartition("session_id").sortWithinPartitions("session_id", "seq").mapInArrow(run, schema)


def decide_within(events: DataFrame, capacity: int = states.CAPACITY, held: DataFrame | None = None) -> DataFrame:
    """decided, where a session owns at most ``capacity`` feeds at once: a claim without room has no effect and may come again.

    held: (session_id, identity_key, state, worker), feeds that were claimed before these events. Events have seq >= 0.
    """
    rows = events if held is None else events.unionByName(_told_again(held.join(events.select(*FEED).distinct(), FEED, "left_semi"), events))
    claims = claims_of(rows)
    if held is not None:  # feeds without an event only fill their places
        idle = held.join(events.select(*FEED).distinct(), FEED, "left_anti").join(events.select("session_id").distinct(), "session_id", "left_semi").where(F.col("state").isin(*states.OWNED))
        claims = claims.unionByName(idle.select("session_id", F.lit(-3).cast("long").alias("seq"), "identity_key", F.lit(None).cast("long").alias("ends"), F.lit(False).alias("again")))
    return decided(rows, admit(claims, capacity)).where("seq >= 0")


def _told_again(held: DataFrame, events: DataFrame) -> DataFrame:
    """Held feeds as the shortest events that lead to where they stand: a claim, a bind if a worker is known, a move."""
    event = lambda seq, op, state, worker: F.struct(F.lit(seq).cast(events.schema["seq"].dataType).alias("seq"), F.lit(op).alias("op"), state.alias("new_state"), worker.cast(events.schema["worker_pid"].dataType).alias("worker_pid"))
    none, launching = F.lit(None), F.lit("LAUNCHING")
    steps = [event(-3, "claim", launching, none), F.when(F.col("worker").isNotNull(), event(-2, "bind", launching, F.col("worker"))), F.when(F.col("state") != "LAUNCHING", event(-1, "transition", F.col("state"), none))]
    told = held.select(*FEED, F.inline(F.array_compact(F.array(*steps))))
    return told.select(*(F.col(c) if c in told.columns else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns))


def held_after(rows: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(session_id, identity_key, state, worker) of all feeds that were ever claimed, after decided rows and what was held before them."""
    holds = F.col("reason") == ""
    newest = rows.where(holds).groupBy(*FEED).agg(F.max_by("new_state", "seq").alias("state"), F.max_by("worker", F.when(F.col("worker").isNotNull(), F.col("seq"))).alias("worker"))
    if held is None:
        return newest
    was = held.select(*FEED, F.col("state").alias("was"), F.col("worker").alias("known"))
    both = newest.join(was, FEED, "full")
    return both.select(*FEED, F.coalesce("state", "was").alias("state"), F.coalesce("worker", "known").alias("worker"))


def registry_changes(decided: DataFrame) -> DataFrame:
    """Accepted steps from state to state; '-' stands for no entry. A bind is no step."""
    own = Window.partitionBy("session_id", "identity_key").orderBy("seq")
    steps = decided.where("accepted").withColumn("was", F.coalesce(F.lag("new_state").over(own), F.lit("-")))
    return steps.where("was <> new_state").select("session_id", "identity_key", "seq", "was", F.col("new_state").alias("is"))


def latest_status(events: DataFrame) -> DataFrame:
    """Newest state of each feed in its session, by sequence."""
    return events.groupBy("session_id", "identity_key").agg(F.max("seq").alias("seq"), F.max_by("new_state", "seq").alias("state"), F.max_by("worker_pid", "seq").alias("worker_pid"))


def scan_windows(events: DataFrame, width: str = "300 seconds") -> DataFrame:
    """Events, feeds and states per scan cycle and session."""
    return events.groupBy(F.window("ts", width).alias("w"), "session_id").agg(F.count("*").alias("n"), F.count_distinct("identity_key").alias("feeds"), F.count_if(F.col("new_state") == "RECORDING").alias("recording")).select(F.col("w.start").alias("cycle"), "session_id", "n", "feeds", "recording")


def session_rollover(events: DataFrame) -> DataFrame:
    """(session_id, action): CONTINUED while a feed of the session is owned, else ROLLED_OVER; CREATED if it never owned any."""
    newest = decide(events).where("accepted").groupBy("session_id", "identity_key").agg(F.max_by("new_state", "seq").alias("state"))
    owned = newest.groupBy("session_id").agg(F.count_if(~F.col("state").isin(*FINAL)).alias("active"))
    action = F.when(F.col("active") > 0, "CONTINUED").when(F.col("active") == 0, "ROLLED_OVER").otherwise("CREATED")
    return events.select("session_id").distinct().join(owned, "session_id", "left").select("session_id", action.alias("action"))
