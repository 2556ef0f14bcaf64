"""Stand-ins for scans, out of the tables that come with the driver.

* motion: the numeric columns of ``lineitem`` as six channels, a run a supplier;
* signal: four columns of ``lineitem`` as voxels, on the same frames;
* volumes: ``embeddings`` as cubes of 4 x 4 x 4 voxels, a series a label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import deal, prepare

FRAME_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
#: Columns and divisors that make the channels rx ... tz.
MOTION = {"rx": ("l_discount", 1.0), "ry": ("l_tax", 1.0), "rz": ("l_quantity", 1000.0), "tx": ("l_extendedprice", 100000.0), "ty": ("l_linenumber", 10.0), "tz": ("l_partkey", 10000.0)}
VOXELS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
CUBE = (4, 4, 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _framed(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Rows with a run, numbered by ``order``: the run is renamed and dealt before, so that what follows by run needs no exchange of its own."""
    return deal(rows, "run").withColumn("t", F.row_number().over(W.partitionBy("run").orderBy(*order)).cast("long") - 1)


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _framed(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "run"), FRAME_ORDER)
    return rows.select("run", "t", *[(F.col(c).cast("double") / F.lit(d)).alias(name) for name, (c, d) in MOTION.items()])


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _framed(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "run"), FRAME_ORDER)
    return rows.select("run", "t", F.posexplode(F.array(*[F.col(c).cast("double") for c in VOXELS])).alias("voxel", "v"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of ``events`` as one channel, a run a user."""
    rows = _framed(table(spark, sf_dir, "events").withColumnRenamed("user_id", "run"), ("ts", "event_id"))
    return rows.select("run", "t", F.col("value").alias("v"))


def wide_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide volumes: image_id, t (always 0), dims, voxels."""
    dims = F.struct(*[F.lit(n).alias(a) for n, a in zip(CUBE, "xyz", strict=True)])
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(0).alias("t"), dims.alias("dims"), F.col("embedding").cast("array<double>").alias("voxels"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long volumes: image_id, t (always 0), x, y, z, v."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.lit(0).alias("t"), F.posexplode("embedding").alias("i", "e"))
    i = F.col("i")
    return rows.select("image_id", "t", (i % 4).alias("x"), (F.floor(i / 4) % 4).cast("int").alias("y"), F.floor(i / 16).cast("int").alias("z"), F.col("e").cast("double").alias("v"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes as series: run is the label, t the place of the vector in it."""
    rows = _framed(table(spark, sf_dir, "embeddings").withColumnRenamed("label", "run"), ("vec_id",))
    return rows.select("run", "t", F.posexplode(F.col("embedding").cast("array<double>")).alias("voxel", "v"))


_ORDER = ", ".join(FRAME_ORDER)
_CHANNELS = ", ".join(f"l.{c}::DOUBLE / {d}::DOUBLE AS {name}" for name, (c, d) in MOTION.items())

#: The same stand-ins as common table expressions.
MOTION_SQL = f"motion AS (SELECT l_suppkey AS run, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_ORDER}) - 1 AS t, {_CHANNELS} FROM lineitem l)"
SIGNAL_SQL = (
    f"frames AS (SELECT l_suppkey AS run, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_ORDER}) - 1 AS t, {', '.join(VOXELS)} FROM lineitem), signal AS ("
    + " UNION ALL ".join(f"SELECT run, t, {k} AS voxel, {c}::DOUBLE AS v FROM frames" for k, c in enumerate(VOXELS))
    + ")"
)
VOLUMES_SQL = (
    "volumes AS (SELECT vec_id AS image_id, 0 AS t, (i % 4)::INT AS x, ((i // 4) % 4)::INT AS y, (i // 16)::INT AS z, v FROM "
    "(SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings))"
)
SERIES_SQL = (
    "series AS (SELECT label AS run, t, i AS voxel, v FROM (SELECT label, t, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM "
    "(SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t FROM embeddings)))"
)
