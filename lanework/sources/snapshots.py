"""Landed catalogs in; snapshots and change logs out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanework.functions import states


def read_catalog_documents(spark: SparkSession, path: str, sources: DataFrame) -> DataFrame:
    """One row per configured url, first configuration first: landed text with its size, or ok=false where nothing landed.

    sources: (url, ord, file): file is the name under which the url's text landed below path, of a file or of a folder
    file=name that holds it.
    """
    place = F.col("_metadata.file_path")
    name = F.coalesce(F.nullif(F.regexp_extract(place, "/file=([^/]+)/", 1), F.lit("")), F.element_at(F.split(place, "/"), -1))
    landed = spark.read.option("basePath", path).text(path, wholetext=True).select(name.alias("file"), F.col("value").alias("text"))
    first = sources.groupBy("url").agg(F.min_by(F.col("file"), "ord").alias("file"), F.min("ord").alias("ord"))
    both = first.join(landed, "file", "left")
    return both.select("url", "ord", "text", F.col("text").isNotNull().alias("ok"), F.octet_length("text").cast("long").alias("size_bytes"))


def write_snapshot(blocks: DataFrame, path: str) -> None:
    """Replace the partitions of the scans in blocks, so that a repeated write changes nothing."""
    blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(path)


def append_changes(changes: DataFrame, path: str, batch: str) -> None:
    """Add changes under the name of their batch; writing a batch again replaces it."""
    changes.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def read_registry(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, quarantine) of registry JSON texts (session_id, text).

    To quarantine go entries of an unknown state, without a key, whose identity is not their key, and whose worker is
    neither null nor a positive integer (a number in quotes and a boolean are none); and texts that are no registry.
    """
    entry = "struct<state:string,worker_pid:variant,provider:string,identity:string>"
    parsed = documents.select("session_id", F.from_json("text", f"entries map<string, {entry}>").alias("d"))
    rows = parsed.select("session_id", F.explode_outer("d.entries").alias("identity_key", "e")).select("session_id", "identity_key", "e.*")
    kind = F.coalesce(F.schema_of_variant("worker_pid"), F.lit("VOID"))
    state = F.when(F.col("state") == "ACTIVE", "RECORDING").otherwise(F.col("state"))
    pid = F.when(kind == "BIGINT", F.try_variant_get("worker_pid", "$", "bigint"))
    good = (F.trim(F.coalesce("identity_key", F.lit(""))) != "") & state.isin(*states.ALLOWED) & ((kind == "VOID") | (pid > 0)) & (F.coalesce("identity", "identity_key") == F.col("identity_key"))
    rows = rows.withColumns({"good": F.coalesce(good, F.lit(False)), "known": state, "pid": pid})
    return rows.where("good").select("session_id", "identity_key", "provider", F.col("known").alias("state"), F.col("pid").alias("worker_pid")), rows.where("not good").select("session_id", "identity_key", "state", F.to_json("worker_pid").alias("worker_pid"), "provider")


STATUS = "schema_version int, registry_session_id string, identity string, provider string, worker_pid int, worker_state string, sequence long, updated_at string"


def read_status(spark: SparkSession, path: str, session_id: str, version: int = 1, lines: bool = False) -> DataFrame:
    """Status texts (one JSON object each) of a session; broken texts, other versions or sessions and nameless feeds go.

    Each file below path is one text; with ``lines`` each line of it is, so that the texts of many feeds lie in few files.
    """
    rows = spark.read.schema(STATUS).json(path, mode="PERMISSIVE", multiLine=not lines)
    return rows.where((F.col("schema_version") == version) & (F.col("registry_session_id") == session_id) & (F.col("identity") != ""))
