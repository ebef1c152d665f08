"""Cutting lineage through storage that every executor can reach."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode, where it is unset, a temporary one.

    On a cluster the setting has to be there: a folder of one machine would be lost with it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="loreweave-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: The application and folder of each table that was cut and not released.
_written: list[tuple[str, str]] = []
#: The folder of a table that was cut, by its frame.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def release(spark: SparkSession) -> int:
    """Deletes the tables that this application has cut so far, and tells how many they were.

    A result that was made from them and is not stored yet can't be computed after that.
    """
    app = spark.sparkContext.applicationId
    own = [path for a, path in _written if a == app]
    for path in own:
        _delete(spark, path)
    _written[:] = [x for x in _written if x[0] != app]
    return len(own)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `cut` returned and that nothing will read again, and sweeps."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            _delete(df.sparkSession, path)
            _written.remove((df.sparkSession.sparkContext.applicationId, path))
    sweep(tables[0].sparkSession)


def sweep(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of plans that are done, which else stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back, so that what follows doesn't compute it again.

    The table outlives lost executors. It is compressed and columnar, unlike an RDD checkpoint; it lies below
    ``loreweave/`` in the shared folder until `release`, or until whoever owns that folder clears it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loreweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark.sparkContext.applicationId, path))
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def semi_join(df: DataFrame, keys: DataFrame, on: str, most: int = 200_000) -> DataFrame:
    """Rows of ``df`` whose ``on`` is among ``keys`` (a table that was cut, as it is counted first).

    Up to ``most`` keys are broadcast; more of them take a shuffled join. The rows are the same either way.
    """
    return df.join(F.broadcast(keys) if keys.count() <= most else keys, on, "left_semi")
