"""Tables that cut lineage: written to the folder all machines share, and read again."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_WRITTEN: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; under a local one only where that is unset and all tasks run on this machine,
    as in tests. On a cluster executors would not see each other's files there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="chronoweave-"))
        base = _OWN[0]
    path = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read again: lineage ends there, and a lost executor costs nothing of it."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop_stored(df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        if os.path.basename(folder).startswith("scratch-"):
            _delete(df.sparkSession, folder)
            _WRITTEN.difference_update({p for p in _WRITTEN if p.endswith(os.path.basename(folder))})


@atexit.register
def _clean() -> None:
    """At the driver's end nobody reads its tables any more. What a driver that died leaves is the cluster's to clear."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for path in sorted(_WRITTEN):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
