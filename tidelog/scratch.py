"""Tables that a job writes for itself in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_own = ""


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local
    master that has none gets one of its own; a cluster without one is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if not _own:
        _own = tempfile.mkdtemp(prefix="tidelog-")
        atexit.register(shutil.rmtree, _own, True)
    return _own


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidelog-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts the
    lineage: later jobs reread files instead of recomputing lost partitions, and know
    how large they are."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    forget_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that `kept` returned and no later job reads."""
    for df in frames:
        path = _paths.pop(df, None)
        if path:
            _delete(df.sparkSession, path)
            _made.discard(path)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    if path not in _made:
        _made.add(path)
        atexit.register(_delete, spark, path)
