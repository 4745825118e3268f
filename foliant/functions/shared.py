"""Tables that a job writes once and reads again, in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few short columns that are sent to all executors at most: less than 100 MB.
SENT_ROWS = 1_000_000

_written: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, the warehouse serves if all machines reach it: on a master in this process, or by a scheme that is not a machine's own.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not sc.master.startswith("local[") and sc.master != "local" and (":" not in warehouse or warehouse.startswith("file:")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = f"{warehouse}/_foliant"
    return at.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that is removed when the interpreter ends."""
    path = f"{folder(spark)}/foliant-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """`df` as Parquet in the shared folder, read again: its lineage ends there, and lost executors lose nothing of it."""
    path, schema = new_path(df.sparkSession), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def sent(df: DataFrame) -> DataFrame:
    """A written table of a few short columns, marked to be sent to all executors if it has at most SENT_ROWS rows; else both sides are exchanged, whatever the planner takes their sizes for."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df.hint("merge")


@atexit.register
def _tidy() -> None:
    for spark, path in _written:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter does
            return
