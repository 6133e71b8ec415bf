"""What the operators of this package share: the cluster's shared folder, written intermediate tables, Arrow batch maps and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanework.plans.ship import ship
from lanework.sources.shared import shared_path

#: Rows, and bytes, handed to Python at once: a longer text comes alone.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


#: Scratch paths given out by this process and not deleted since, in order.
_given: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    _given.append(shared_path(spark, tag))
    return _given[-1]


def mark() -> int:
    """Where the list of scratch paths ends now, for ``sweep``."""
    return len(_given)


def sweep(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete all scratch tables given out since the mark, but for those that the kept frames read. Nothing else may read them any more."""
    held = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for df in keep for f in df.inputFiles()}
    for name in _given[since:]:
        if not any(h.startswith(name.split(":", 1)[-1].lstrip("/")) for h in held):
            _delete(spark, name)
            _given.remove(name)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def save(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and outlives lost executors."""
    path = scratch(df.sparkSession, tag)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release(df: DataFrame) -> None:
    """Delete the table that ``save`` wrote for df, once nothing reads it any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, name)


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds, for this and later plans of the session (the plan reads the setting when it starts)."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str) -> DataFrame:
    """mapInArrow with a function that ``make`` builds once per task and that turns a batch into columns (a dict of lists or arrays)."""
    small_batches(df.sparkSession)
    arrow = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if batch.num_rows and (found := one(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def text_key(doc_id: str, text: str) -> Column:
    """Second half of a row's key: rows that share an id (or have none) are told apart by their text; equal rows share the key."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of an undirected graph: (node, root), root one node of the component, the same for all of it.

    edges: (a, b) of any type that hashes. Nodes without an edge do not occur. In a round every node points to the
    neighbour that hashes least, if it hashes below the node; pointers are followed, four times as far each time, until all
    lead to a root; then the graph shrinks to its roots. The order is drawn anew each round, so at least half of the nodes
    with an edge are expected to go, whatever the graph and its ids; the rounds end when no edge is left. A table is deleted when
    the next one stands; the driver sees one row per round.
    """
    edges = save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{tag}-edges")
    labels, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        order = lambda c, salt=turn: F.struct(F.xxhash64(c, F.lit(salt)).alias("h"), F.col(c).alias("node"))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(order("b")).alias("near"))
        up = save(least.select(F.col("a").alias("node"), F.least("near", order("a"))["node"].alias("up")), f"{tag}-up")
        while True:
            far = lambda t: t.join(t.select(F.col("node").alias("up"), F.col("up").alias("further")), "up").select("node", "up", "further")
            twice = far(up).select("node", F.col("further").alias("up"))
            moved = save(far(twice).select("node", F.col("further").alias("up"), (F.col("further") != F.col("up")).alias("moved")), f"{tag}-up")
            done = moved.where("moved").isEmpty()
            release(up)
            up = moved.drop("moved")
            if done:
                break
        at = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"r{c}"))
        left = edges.join(at("a"), "a").join(at("b"), "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        left = save(left.distinct(), f"{tag}-edges")
        if labels is None:
            named = up.select("node", F.col("up").alias("root"))
        else:
            named = labels.join(at("root"), "root", "left").select("node", F.coalesce("rroot", "root").alias("root"))
        named = save(named, f"{tag}-labels")
        for old in (edges, moved) if labels is None else (edges, moved, labels):
            release(old)
        edges, labels = left, named
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
