"""The same operators on streams: built-in state where it suffices, keyed state where order and capacity matter."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from lanework.functions import states
from lanework.operators import aggregate, changes, ownership
from lanework.operators.evidence import CONTAINED
from lanework.plans.ship import ship
from lanework.sources.shared import delete, shared_path, stored

CAPACITY = states.CAPACITY


def scan_windows(events: DataFrame, width: str = "300 seconds", lateness: str = "10 minutes") -> DataFrame:
    """Events and recordings per scan cycle and session; the watermark bounds the state."""
    held = events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "session_id")
    return held.agg(F.count("*").alias("n"), F.count_if(F.col("new_state") == "RECORDING").alias("recording")).select(F.col("w.start").alias("cycle"), "session_id", "n", "recording")


def scan_feeds(events: DataFrame, width: str = "300 seconds", lateness: str = "10 minutes", size: int = aggregate.SKETCH) -> DataFrame:
    """(cycle, session_id, n, sketch, feeds): distinct feeds per scan cycle and session, which a stream cannot count exactly.

    The state of a window is one sketch (at most 2^size registers), however many feeds it sees; windows that have passed the
    watermark go. Sketches of windows may be merged to those of longer spans by ``hll_union_agg``.
    """
    held = events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "session_id")
    found = held.agg(F.count("*").alias("n"), F.hll_sketch_agg("identity_key", size).alias("sketch"))
    return found.select(F.col("w.start").alias("cycle"), "session_id", "n", "sketch", F.hll_sketch_estimate("sketch").alias("feeds"))


def latest_status(events: DataFrame) -> DataFrame:
    """Newest state of each feed by sequence, whatever the order of arrival."""
    return events.groupBy("session_id", "identity_key").agg(F.max("seq").alias("seq"), F.max_by("new_state", "seq").alias("state"), F.max_by("worker_pid", "seq").alias("worker_pid"))


def status_lives(events: DataFrame, silence: str = "12 hours", lateness: str = "10 minutes") -> DataFrame:
    """(session_id, identity_key, started, last_seen, events, seq, state, worker_pid): a feed's newest state, told once it has been silent.

    A feed lives while its events follow each other by no more than ``silence``; what arrives in between, in any order, joins
    lives that it connects. A life is given out, and its state dropped, when the watermark has passed its end, so what is held
    are the feeds of the last ``silence`` and ``lateness``, not all that ever were. Events later than ``lateness`` are left out;
    sequence numbers of an ended life mean nothing to the next one. Runs on streams in append mode; a batch gives all lives.
    """
    held = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", silence).alias("w"), "session_id", "identity_key")
    # The newest state and worker are one value: their event's.
    newest = F.max_by(F.struct("new_state", "worker_pid"), "seq").alias("x")
    found = held.agg(F.min("ts").alias("started"), F.max("ts").alias("last_seen"), F.count("*").alias("events"), F.max("seq").alias("seq"), newest)
    return found.select("session_id", "identity_key", "started", "last_seen", "events", "seq", F.col("x.new_state").alias("state"), "x.worker_pid")


def step(held: dict, owned: int, op: str, identity: str, state: str, pid, capacity: int) -> tuple[str, int]:
    """The reason against an event ('' if it is accepted) and how many feeds are owned after it; held is changed in place."""
    now = held.get(identity)
    reason = states.reason_against(now, op, state, pid)
    if not reason and op == "claim" and owned >= capacity:
        reason = "no capacity"
    if not reason:
        held[identity] = list(states.after(now, op, state, pid))
        owned += (held[identity][0] in states.OWNED) - (now is not None and now[0] in states.OWNED)
    return reason, owned


class Batches:
    """Tables of a foreachBatch job, a partition per batch number: a batch that is run again replaces its own, and reads only what earlier ones wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def before(self, number: int, empty: DataFrame) -> DataFrame:
        """What the latest batch before this one wrote; ``empty`` (for its schema) if there was none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in store.listStatus(path)] if store.exists(path) else []
        numbers = [n for n in (int(x.split("=")[1]) for x in names if x.startswith("batch=")) if n < number]
        return self.spark.read.schema(empty.schema).parquet(f"{self.path}/batch={max(numbers)}") if numbers else empty

    def write(self, number: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def all(self, like: DataFrame) -> DataFrame:
        """All batches, with their numbers in a column batch; empty if none was written."""
        schema = StructType([*like.schema.fields, StructField("batch", IntegerType())])
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def forget(self, before: int) -> None:
        """Delete the batches that no later one reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for x in store.listStatus(path) if store.exists(path) else []:
            name = x.getPath().getName()
            if name.startswith("batch=") and int(name.split("=")[1]) < before:
                store.delete(x.getPath(), True)


LOGGED = "session_id string, identity_key string, seq long, new_state string, reason string"
REGISTRY_STATE = "session_id string, identity_key string, state string, worker long"


def logged(rows: DataFrame) -> DataFrame:
    """The rows of ``ownership.decide_within`` as a registry's log has them: each event with its own state and what is against it."""
    return rows.select("session_id", "identity_key", "seq", F.col("asked").alias("new_state"), "reason")


def registry(events: DataFrame, held: str, log: str, capacity: int = CAPACITY):
    """foreachBatch writer of events with their reason under a capacity per session, in two stages (see ``ownership``).

    The log has (session_id, identity_key, seq, new_state, reason), held the feeds that were ever claimed: they block a
    later claim of their session. Each lies in a partition per batch number. Events that come late are taken in the batch
    that they come with. Start it with ``.start()``.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        states_, out = Batches(batch.sparkSession, held), Batches(batch.sparkSession, log)
        known = states_.before(number, batch.sparkSession.createDataFrame([], REGISTRY_STATE))
        rows = ownership.decide_within(batch, capacity, known)
        rows = stored(rows.withColumn("seq", F.col("seq").cast("long")), "decided")
        out.write(number, logged(rows))
        states_.write(number, ownership.held_after(rows, known).select("session_id", "identity_key", "state", F.col("worker").cast("long").alias("worker")))
        states_.forget(number - 1)
        delete(rows)
        batch.unpersist()

    return events.writeStream.foreachBatch(write)


def date_fetch(known: list | None, at: int, content: str, commit: int | None, generated: int | None, modified: int | None) -> list:
    """[content, time, evidence] of a catalog after one more fetch; times in one unit of any kind."""
    if known is None:
        for time, kind in ((commit, "commit"), (generated, "generated"), (modified, "last-modified")):
            if time is not None:
                return [content, time, kind]
        return [content, None, "unknown"]
    if known[0] != content:
        return [content, at, "observed"]
    return [content, commit, "commit"] if commit is not None and known[2] not in ("commit", "observed") else known


def freshness(documents: DataFrame) -> DataFrame:
    """(source, fetched_at, freshness, evidence) of every fetch, as evidence.freshness_history gives; state: one row a catalog.

    documents: (source, fetched_at, hash, commit_at, generated_at, modified_at), times in microseconds.
    """
    ship(documents.sparkSession)
    times = ["commit_at", "generated_at", "modified_at"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["fetched_at", "hash"])
        found = []
        for at, content, *stamps in rows[["fetched_at", "hash", *times]].itertuples(index=False):
            known = date_fetch(known, int(at), content, *(None if pd.isna(x) else int(x) for x in stamps))
            found.append((key[0], int(at), known[1], known[2]))
        state.update((json.dumps(known),))
        yield pd.DataFrame(found, columns=["source", "fetched_at", "freshness", "evidence"]).astype({"freshness": "Int64"})

    kind = dict(documents.dtypes)["source"]
    out = f"source {kind}, fetched_at long, freshness long, evidence string"
    return documents.groupBy("source").applyInPandasWithState(run, out, "known string", "append", GroupStateTimeout.NoTimeout)


def agree(left: list[str], right: list[str]) -> bool:
    """evidence.compatible for plain lists."""
    return any(a == b or min(len(a), len(b)) >= CONTAINED and (a in b or b in a) for a in left for b in right)


def move(pending: list | None, verdict: str, values: list[str]) -> tuple[list | None, bool]:
    """What is held of a feed after a scan's verdict, and whether the feed may still be used.

    A single newer event is pending at first and confirmed if the next scan agrees; two agreeing catalogs confirm at once;
    ambiguity, caught-up evidence and absence clear what is held.
    """
    if verdict == "confirmed":
        return ["confirmed", values], False
    if verdict != "single":
        return None, True
    if pending is None or not agree(pending[1], values):
        return ["pending", values], True
    return (pending if pending[0] == "confirmed" else ["confirmed", values]), False


def transitions(verdicts: DataFrame) -> DataFrame:
    """(identity_key, n, status, usable) per feed and scan; status is pending, confirmed or ''.

    verdicts: (identity_key, n, verdict, values): those of evidence.freshness_verdict, or absent for a feed that a scan
    does not have, with the values of the newer rows. State: one row for each feed that has something pending or confirmed.
    """
    ship(verdicts.sparkSession)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else None
        found = []
        for n, verdict, values in pd.concat(list(frames)).sort_values("n")[["n", "verdict", "values"]].itertuples(index=False):
            held, usable = move(held, verdict, [] if values is None else [str(x) for x in values])
            found.append((key[0], int(n), held[0] if held else "", usable))
        if held is not None:
            state.update((json.dumps(held),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(found, columns=["identity_key", "n", "status", "usable"])

    return verdicts.groupBy("identity_key").applyInPandasWithState(run, "identity_key string, n long, status string, usable boolean", "held string", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str, tag: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream over all that is there now and return what it wrote; in update mode the last row of each key.

    Every batch has a partition of its own, which it replaces if it runs again.
    """
    spark = stream.sparkSession
    path, place = shared_path(spark, f"{tag}-out"), shared_path(spark, f"{tag}-state")
    out = Batches(spark, path)
    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", place).foreachBatch(lambda batch, number: out.write(number, batch)).start().awaitTermination()
    written = out.all(stream)
    if not keys:
        return written.drop("batch")
    rest = [c for c in written.columns if c not in (*keys, "batch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


def run_registry(events: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The log of ``registry`` over all events that are there now."""
    spark = events.sparkSession
    held, log, place = (shared_path(spark, f"registry-{x}") for x in ("held", "log", "state"))
    registry(events, held, log, capacity).trigger(availableNow=True).option("checkpointLocation", place).start().awaitTermination()
    return spark.read.schema(LOGGED).parquet(log).drop("batch")


def _compared(scans: DataFrame, state: str, log: str, summarise: Callable[[DataFrame], DataFrame], compare: Callable[[DataFrame], DataFrame]):
    """foreachBatch writer: what is summed up of each batch's scans is compared, together with that of the last scan before them."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept, out = Batches(spark, state), Batches(spark, log)
        summaries = summarise(batch)
        last = kept.before(number, summaries.limit(0))
        newest = last.agg(F.max("scan_id").alias("seen"))
        fresh = summaries.join(F.broadcast(newest), F.col("seen").isNull() | (F.col("scan_id") > F.col("seen"))).drop("seen")  # newest is one row
        both = stored(last.unionByName(fresh), "summaries")
        out.write(number, compare(both))
        kept.write(number, both.join(F.broadcast(both.agg(F.max("scan_id").alias("scan_id"))), "scan_id", "left_semi").select(summaries.columns))
        kept.forget(number - 1)
        delete(both)

    return scans.writeStream.foreachBatch(write)


def change_stream(scans: DataFrame, snapshot: str, log: str):
    """foreachBatch writer: each arriving scan is compared with the one before it; feeds that came and went are logged.

    scans: (scan_id, identity_key, ...); ``full_change_stream`` logs all that changes. Start it with ``.start()``.
    """
    return _compared(scans, snapshot, log, lambda batch: batch.select("scan_id", "identity_key").distinct(), changes.diff_identities)


def full_change_stream(entries: DataFrame, state: str, log: str):
    """foreachBatch writer: the scans of each batch are compared with each other and with the last scan before them; the log is that of ``changes.all_changes``.

    entries: rows as ``changes.summary_with_quality`` takes them; a scan comes whole in one batch. All that is kept is the
    summary of the last scan: a row for each catalog of a feed. Rows of a scan that is not after the last one seen come too
    late and are left out. Log and state lie in one partition per batch number, which a replayed batch overwrites; a batch
    reads only what earlier ones wrote. Start it with ``.start()``.
    """
    return _compared(entries, state, log, changes.summary_with_quality, changes.all_changes)


def logged_changes(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.parquet(log).select("scan_id", "identity_key", "playlist_url", "marker", "details")
