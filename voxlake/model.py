"""Schemas and the two forms of an image series.

*Long*: a row a voxel, ``(image_id, x, y, z, t, v)``, coordinates from 0.
*Wide*: a row a volume, ``(image_id, t, dims struct<x, y, z>, voxels
array<double>)``, x fastest.  Wide is what files hold and what whole-volume work
should use; long is for what relates voxels by place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

AXES = ("x", "y", "z")
CHANNELS = ("rx", "ry", "rz", "tx", "ty", "tz")

WIDE = "image_id string, t int, dims struct<x:int,y:int,z:int>, voxels array<double>"
MOTION = "sub int, ses string, task string, run int, t long, rx double, ry double, rz double, tx double, ty double, tz double"

#: The 348-byte image header: three blocks of fixed fields.
HEADER_KEY = "sizeof_hdr int, data_type string, db_name string, extents int, session_error short, regular string, dim_info short"
DIMENSION = (
    "dim array<int>, intent_p1 float, intent_p2 float, intent_p3 float, intent_code int, datatype int, bitpix int, slice_start int, pixdim array<float>, vox_offset float, "
    "scl_slope float, scl_inter float, slice_end int, slice_code int, xyzt_units int, cal_max float, cal_min float, slice_duration float, toffset float, glmax int, glmin int"
)
HISTORY = (
    "descrip string, aux_file string, qform_code int, sform_code int, quatern_b float, quatern_c float, quatern_d float, qoffset_x float, qoffset_y float, qoffset_z float, "
    "srow_x array<float>, srow_y array<float>, srow_z array<float>, intent_name string, magic string, originator array<int>"
)
EXTENSIONS = "array<struct<esize:int,ecode:int,edata:binary>>"


def _nested(fields: str) -> str:
    return "struct<" + ",".join(f.strip().replace(" ", ":", 1) for f in fields.split(", ")) + ">"


HEADER = f"path string, byte_order string, hk {_nested(HEADER_KEY)}, dime {_nested(DIMENSION)}, hist {_nested(HISTORY)}, ext {EXTENSIONS}"
JOB = (
    "User string, Dataset string, Session string, Task string, sub_N int, run_N array<int>, Sessions array<string>, Specie string, Process string, Datafolder string, Status string, "
    "Atlas_type string, Combination array<string>, Smooth int, Full_prepro boolean, Variation string, session_and_run array<string>"
)
QUALITY = (
    "participant int, run_N int, fwd double, fwd_clean double, volumesLostAfter_fwd long, totalVolumes long, dvars double, dvars_clean double, "
    "volumesLostAfter_dvars long, lostVolumes_fw_or_dvars long, lostVolumes_fw_and_dvars long"
)


def schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def to_long(wide: DataFrame) -> DataFrame:
    """A row a voxel; other columns than dims and voxels stay."""
    rest = [c for c in wide.columns if c not in ("dims", "voxels")]
    rows = wide.select(*rest, "dims", F.posexplode("voxels").alias("i", "v"))
    nx, ny, i = F.col("dims.x"), F.col("dims.y"), F.col("i")
    return rows.select(*rest, (i % nx).alias("x"), F.floor(i / nx).cast("int").alias("__yz"), "v", ny.alias("__ny")).select(*rest, "x", (F.col("__yz") % F.col("__ny")).alias("y"), F.floor(F.col("__yz") / F.col("__ny")).cast("int").alias("z"), "v")


def to_wide(long: DataFrame, by: tuple[str, ...] = ("image_id", "t")) -> DataFrame:
    """A row a volume.  Each volume must be complete from (0, 0, 0); a volume that isn't raises an error."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("z", "y", "x", "v"))), lambda s: s["v"])
    dims = F.struct(*[(F.max(a) + 1).cast("int").alias(a) for a in AXES])
    out = long.groupBy(*by).agg(dims.alias("dims"), ordered.alias("voxels"))
    full = F.size("voxels") == F.col("dims.x") * F.col("dims.y") * F.col("dims.z")
    return out.withColumn("voxels", F.when(full, F.col("voxels")).otherwise(F.raise_error(F.lit("a volume lacks voxels or has one twice"))))


def voxel_index(nx: Column | int, ny: Column | int) -> Column:
    """Place of a voxel in its volume's array."""
    return F.col("x") + nx * (F.col("y") + ny * F.col("z"))
