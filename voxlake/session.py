"""Session settings that the operators rely on."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it.

    Clusters that install the package on executors are not affected; where the
    path exists on the workers (one machine, or a shared folder) it is enough.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{known}".rstrip(":")
    return spark


#: Bytes up to which a table is dealt anew before heavy work on its rows.
SMALL_TABLE = 32_000_000


def spread(df: DataFrame) -> DataFrame:
    """The rows of a small table dealt to all cores; a larger table, or one that is read by enough tasks, as it is.

    A file of one row group is one task, however many cores there are, and a
    task that works on each row for long would keep them waiting.  The size is
    the plan's own estimate; what comes out doesn't depend on it.
    """
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) > SMALL_TABLE or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


#: Rows that a task is given of a table dealt by ``deal``.
TASK_ROWS = 250_000


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of a table dealt by ``keys`` over as many tasks as keep each to about TASK_ROWS rows.

    Spark deals to a fixed number of tasks, or to tasks of so many packed
    bytes; sorts and aggregates hold rows many times as large, so a task's
    memory would grow with the table.  The rows are counted first, which reads
    a Parquet table's footers only.  Windows by ``keys`` share the exchange.
    A table of one task's rows stays as it is.
    """
    tasks = -(-df.count() // TASK_ROWS)
    return df if tasks <= 1 else df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *keys)
