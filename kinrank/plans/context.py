"""Session helpers: lineage cutting and shuffle sizing.

Lineage is cut by writing parquet tables into the shared folder that the
cluster names in ``spark.checkpoint.dir``.  The library never picks a folder
of its own: where none is set, ``shared_dir`` raises, because a table that
only one machine sees gives wrong results on a cluster.
"""

from __future__ import annotations

import gc
import time
import uuid
import weakref
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_tables: dict[str, set[str]] = {}
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_reclaimed: dict[str, float] = {}

#: Seconds between two collections at least.
RECLAIM_EVERY = 15.0


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; raises where the session names none."""
    sc = spark.sparkContext
    folder = (
        sc.getCheckpointDir()
        or spark.conf.get("spark.checkpoint.dir", None)
        or sc.getConf().get("spark.checkpoint.dir", None)
    )
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def materialize(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as parquet under the shared folder, a folder for each
    value of ``by``, and read it back.

    Runs one job.  The lineage is cut and the table survives executor loss
    (unlike ``localCheckpoint``); later readers get column pruning, filter
    pushdown and real sizes for AQE.  ``discard`` removes one such table,
    ``drop_tables`` all of the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    _tables.setdefault(spark.sparkContext.applicationId, set()).add(path)
    reclaim(spark)
    back = spark.read.schema(df.schema).parquet(path)
    _path_of[back] = path
    return back


def materialize_bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """``materialize``, bucketed and sorted by ``key``: joins on it read the table
    without an exchange.  The table's files lie under the shared folder; its
    name is one of the session's catalog."""
    spark = df.sparkSession
    name = f"kinrank_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tables/{name}"
    n = buckets or partition_count(spark)
    (df.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet").option("path", path).saveAsTable(name))
    _tables.setdefault(spark.sparkContext.applicationId, set()).add(path)
    reclaim(spark)
    back = spark.table(name)
    _path_of[back] = path
    return back


def together(spark: SparkSession, steps: Mapping[str, Callable[[], object]]) -> dict[str, object]:
    """What independent steps that run jobs return, run side by side: the short stages
    of one fill the cores that another leaves idle."""
    with ThreadPoolExecutor(max(1, len(steps))) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(step)) for name, step in steps.items()}
        return {name: each.result() for name, each in running.items()}


def reclaim(spark: SparkSession) -> None:
    """Give back the disk of finished steps, unless that was done in the last ``RECLAIM_EVERY`` seconds.

    Shuffle files and cached blocks lie on the executors' disks until the driver's JVM collects
    the plans and models that made them, and with heap to spare it does not for a long time:
    the disk then holds every step of a long job.  Only what nothing refers to any more goes.
    Python's own collection comes first, as models lie in reference cycles; the JVM hears of
    what it freed about a second later, which is waited for where steps are long.
    """
    sc = spark.sparkContext
    now = time.monotonic()
    since = now - _reclaimed.get(sc.applicationId, now - RECLAIM_EVERY)
    if since >= RECLAIM_EVERY:
        _reclaimed[sc.applicationId] = now
        gc.collect()
        time.sleep(min(1.5, since / 50))
        sc._jvm.System.gc()


def discard(*frames: DataFrame) -> None:
    """Remove the tables behind frames that ``materialize`` returned."""
    for df in frames:
        if path := _path_of.pop(df, None):
            _delete(df.sparkSession, path)


def tables(spark: SparkSession) -> frozenset[str]:
    """The paths of the tables this session has materialised and not removed."""
    return frozenset(_tables.get(spark.sparkContext.applicationId, ()))


def drop_tables(spark: SparkSession, only: frozenset[str] | None = None) -> int:
    """Remove the tables this session materialised (those in ``only``); returns
    their number.  Frames that still read them fail afterwards."""
    paths = tables(spark) if only is None else tables(spark) & only
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    if (name := path.rsplit("/", 1)[1]).startswith("kinrank_"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
    _tables.get(spark.sparkContext.applicationId, set()).discard(path)


#: Rows worth a task of their own in an explicitly partitioned step.
ROWS_PER_PARTITION = 100_000


def partition_count(spark: SparkSession, rows: int | None = None, per_task: int = ROWS_PER_PARTITION) -> int:
    """Partitions for an explicitly partitioned step: the session's own
    ``spark.sql.shuffle.partitions``, which the user sizes to the data.  A step of few
    ``rows`` takes fewer, two a core at least: adaptive execution does not merge explicit
    partitions, and of a small table's hundreds of tasks each costs more than its rows."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if rows is None:
        return most
    return min(most, max(2 * spark.sparkContext.defaultParallelism, -(-rows // per_task)))
