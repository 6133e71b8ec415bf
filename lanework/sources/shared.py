"""The folder that the driver and all executors see, for streaming state, sinks and tables written between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder of a session on one machine (tests) that names none, by application.
_own: dict[str, str] = {}


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; where that is unset, a session on one machine (tests) has a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="lanework-")
        _own[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/lanework/{tag}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, tag: str) -> DataFrame:
    """rows written to the shared folder and read back: the lineage ends there, and what reads it again computes nothing again."""
    path = shared_path(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def delete(rows: DataFrame) -> None:
    """Delete the table that ``stored`` wrote for rows, once nothing reads it any more."""
    spark = rows.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in rows.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
