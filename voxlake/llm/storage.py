"""Intermediate tables in the folder that the cluster shares.

``materialize`` cuts lineage: it writes a frame as Parquet below
``spark.checkpoint.dir`` and reads it back, so a lost executor costs a re-read
and not a recomputation.  The folder is the cluster's own setting; only where
it is unset (tests on one machine) a folder of this process is used; a cluster
without the setting is an error, as its workers would write elsewhere.

Tables live until ``release``, or until ``release_since`` a point in time; what
a frame that was handed on still reads lives until the driver's Python ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; on one machine set to a local one if unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="voxlake-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    kept = spark.read.schema(df.schema).parquet(path)
    kept._voxlake_path = path
    return kept


def release(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_voxlake_path", None)
    if path:
        _delete(df.sparkSession, path)


def point() -> int:
    """A point in time, for ``release_since``."""
    return len(_written)


def release_since(start: int, keep: DataFrame) -> None:
    """Delete the tables written since ``start`` but ``keep``, once nothing else reads them."""
    kept = getattr(keep, "_voxlake_path", None)
    for spark, path in _written[start:]:
        if path != kept:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended already; its files are then the cluster's to remove
            continue
