"""What the operators of this subpackage share: materialised steps, text batches, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where that is unset, as in tests, one in the warehouse, which a cluster then has to place where all machines reach it."""
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if at is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_foliant")
        at = sc.getCheckpointDir()
    return at


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _tidy() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter does
            return


def materialise(df: DataFrame) -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it again.

    This cuts the lineage in a way that outlives lost executors, fixes what a later step would
    otherwise compute twice, and lets the shuffle files of the step go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliant-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    del df
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Lets the driver notice that finished steps need their shuffle files no more, so that disk is free for the next."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Removes a materialised step that nothing reads any more."""
    files = df.inputFiles()
    for entry in [x for x in _written if any(f"/{x[1].rsplit('/', 1)[1]}/" in f for f in files[:1])]:
        _remove(*entry)
        _written.remove(entry)


#: Rows of a few numbers each that are sent to all executors at most: less than 100 MB.
SENT_ROWS = 1_000_000


def sent(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """A written table of a few numbers a row, marked to be sent to all executors if it has at most `rows`; else both sides are exchanged."""
    return F.broadcast(df) if df.count() <= rows else exchanged(df)


def exchanged(df: DataFrame) -> DataFrame:
    """`df`, marked so that a join exchanges both sides, whatever Spark takes their sizes for.

    Spark sizes a written table by its compressed files, an array as one element and an explode as the rows before it, so it may
    take one that grows with the input for small and send it through the driver.
    """
    return df.hint("merge")


def without(df: DataFrame, *names: str) -> DataFrame:
    """`df` without the columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[column(n) for n in df.columns if n.lower() not in taken])


def by_position(df: DataFrame) -> DataFrame:
    """`df` with columns c0, c1, ...: whatever its columns are called, no step's names clash with them."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def _trim() -> None:
    """Gives memory that is free within this process back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over batches, after which its worker, which later tasks use again, gives back the memory that the task took."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        _trim()

    return wrapped


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph of long ids: (id, root), root the smallest id reachable.

    Alternating large-star and small-star steps: each is one aggregation by vertex (combined before the
    shuffle) and one join (split by AQE where a vertex is hot), and the edge count never grows. Vertices
    come from the links only. Loops until nothing changes; the lineage is cut after every round.
    """
    spark = links.sparkSession
    e = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialise(e)
    last, many = None, e.count() > SENT_ROWS
    while True:
        # large star: every vertex sends its larger neighbours to its smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (exchanged(both) if many else both).join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every vertex sends itself and its smaller neighbours to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        before, e = e, materialise(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(spark, before)
        if now == last:
            return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root"))
        last = now
