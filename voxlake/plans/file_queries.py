"""Queries that make files out of the driver's tables, as rows of path and content, and read them back by the sources' own code."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import header as H, text as X
from ..model import CHANNELS, to_long
from ..operators import atlas, catalog, events, signal as S, template, volume as V
from ..sources import images, tables as files
from ..storage import shared_folder
from .registry import query, r, rs
from .tables import MOTION_SQL, SERIES_SQL, VOLUMES_SQL, motion, series, table, volumes, wide_volumes


def _back(rows: DataFrame) -> DataFrame:
    return to_long(rows).select(F.col("path").cast("long").alias("image_id"), "t", "x", "y", "z", r("v", 5).alias("v"))


def _encoded(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return images.encode_volumes(wide_volumes(spark, sf_dir), **how).select(F.col("name").alias("path"), "content")


def _voxels_sql(value: str, x: str = "x", y: str = "y", z: str = "z", digits: int = 5) -> str:
    return f"WITH {VOLUMES_SQL} SELECT image_id, t, ({x})::INT AS x, ({y})::INT AS y, ({z})::INT AS z, {rs(value, digits)} AS v FROM volumes"


@query(_voxels_sql("v"))
def images_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes as image files of doubles and back."""
    return _back(images.decode_volumes(_encoded(spark, sf_dir, datatype=64, voxel_size=(2.0, 2.0, 3.0))))


SLOPE, INTERCEPT = 0.0078125, 0.5
_STORED = f"round((v - {INTERCEPT}::DOUBLE) / {SLOPE}::DOUBLE)"


@query(_voxels_sql(f"({_STORED} * {SLOPE}::DOUBLE + {INTERCEPT}::DOUBLE)::FLOAT::DOUBLE"))
def intensity_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit voxels that the header's slope and intercept turn into the values."""
    return _back(images.decode_volumes(_encoded(spark, sf_dir, datatype=4, scale=(SLOPE, INTERCEPT))))


@query(_voxels_sql(_STORED))
def stored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files read without scaling."""
    return _back(images.decode_volumes(_encoded(spark, sf_dir, datatype=4, scale=(SLOPE, INTERCEPT)), raw=True))


#: The first axis runs to the back, the second to the right and the third downwards, all a little askew.
ASKEW = {"sform_code": 1, "srow_x": [0.02, 2.0, 0.01, -5.0], "srow_y": [-2.0, 0.03, 0.0, 7.0], "srow_z": [0.01, 0.0, -3.0, 11.0]}


@query(_voxels_sql("v", "y", "3 - x", "3 - z"))
def images_to_ras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes turned to the right, front and top as each header's matrix says, its small oblique parts dropped."""
    return _back(images.decode_volumes(_encoded(spark, sf_dir, datatype=64, fields={"hist": ASKEW}), ras=True))


#: Half a turn round the third axis, which the sign in front of the voxel sizes turns over.
TURNED = {"hist": {"sform_code": 0, "qform_code": 1, "quatern_b": 0.0, "quatern_c": 0.0, "quatern_d": 1.0, "qoffset_x": 3.0, "qoffset_y": 3.0, "qoffset_z": 0.0}, "dime": {"pixdim": [-1.0, 2.0, 2.0, 3.0, 1.0, 1.0, 1.0, 1.0]}}


@query(_voxels_sql("v", "3 - x", "3 - y", "3 - z"))
def images_to_ras_by_quaternion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _back(images.decode_volumes(_encoded(spark, sf_dir, datatype=64, fields=TURNED), ras=True))


@query("SELECT vec_id::VARCHAR AS path, 'little' AS byte_order, 4 AS nx, 4 AS ny, 4 AS nz, 16 AS datatype, 32 AS bitpix, 2.5::DOUBLE AS size_z, 'made' AS descrip, 6 AS ecode, 24 AS bytes FROM embeddings")
def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _encoded(spark, sf_dir, datatype=16, voxel_size=(1.0, 1.0, 2.5), description="made", sections=[{"ecode": 6, "edata": b"eighteen bytes long"}])
    dim, ext = F.col("dime.dim"), F.col("ext")[0]
    return images.decode_headers(made).select(
        "path", "byte_order", dim[1].alias("nx"), dim[2].alias("ny"), dim[3].alias("nz"), "dime.datatype", "dime.bitpix", F.col("dime.pixdim")[3].cast("double").alias("size_z"), "hist.descrip", ext["ecode"].alias("ecode"),
        F.length(ext["edata"]).alias("bytes"),
    )


def _series_files(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    """Series of volumes, a file each, or a file a frame with ``split``."""
    rows = series(spark, sf_dir).groupBy(F.col("run").cast("string").alias("image_id"), F.col("t").cast("int").alias("t")).agg(F.transform(F.array_sort(F.collect_list(F.struct("voxel", "v"))), lambda s: s["v"]).alias("voxels"))
    wide = rows.withColumn("dims", F.struct(*[F.lit(4).alias(a) for a in "xyz"]))
    return images.encode_volumes(wide, datatype=64, **how).select(F.col("name").alias("path"), "content")


@query("SELECT label::VARCHAR AS path, count(*)::INT AS n_frames, 1.5::DOUBLE AS tr FROM embeddings GROUP BY label")
def frames_and_tr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth dimension of series' headers."""
    made = _series_files(spark, sf_dir, fields={"dime": {"pixdim": [1.0, 1.0, 1.0, 1.0, 1.5, 1.0, 1.0, 1.0]}})
    return images.frame_and_tr(images.decode_headers(made))


def _frames_sql(where: str) -> str:
    return f"WITH {SERIES_SQL} SELECT run, t::INT AS t, voxel::INT AS voxel, {rs('v')} AS v FROM series WHERE {where}"


@query(_frames_sql("t IN (0, 2)"))
def frames_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two frames of each series' file."""
    rows = images.decode_volumes(_series_files(spark, sf_dir), frames=[0, 2])
    return rows.select(F.col("path").cast("int").alias("run"), "t", F.posexplode("voxels").alias("voxel", "v")).select("run", "t", "voxel", r("v").alias("v"))


@query(f"WITH {SERIES_SQL} SELECT run, t::INT AS t, voxel::INT AS voxel, CASE WHEN voxel // 16 IN (1, 3) THEN {rs('v')} ELSE 0.0::DOUBLE END AS v FROM series WHERE t IN (0, 2)")
def frames_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two slices of two frames, sought in files of the shared folder that hold whole series."""
    folder = f"{shared_folder(spark)}/series-{uuid.uuid4().hex}"
    images.write_files(_series_files(spark, sf_dir).select(F.col("path").alias("name"), "content"), folder)
    atexit.register(shutil.rmtree, folder.removeprefix("file:"), ignore_errors=True)
    rows = images.read_ranges(spark, folder, frames=[0, 2], slices=[1, 3])
    run = F.regexp_extract("path", r"([0-9]+)\.nii$", 1).cast("int")
    return rows.select(run.alias("run"), "t", F.posexplode("voxels").alias("voxel", "v")).select("run", "t", "voxel", r("v").alias("v"))


@query(_frames_sql("true"))
def frames_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series split into a file a frame, and put together by the numbers in their names."""
    rows = images.folder_as_series(images.decode_volumes(_series_files(spark, sf_dir, split=True)).withColumn("path", F.concat("path", F.lit(".nii"))), digits=None)
    return rows.select(F.substring_index("path", "_", 1).cast("int").alias("run"), "t", F.posexplode("voxels").alias("voxel", "v")).select("run", "t", "voxel", r("v").alias("v"))


@query(_voxels_sql("v::FLOAT::DOUBLE"))
def images_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files packed by gzip."""
    return _back(images.decode_volumes(images.packed(_encoded(spark, sf_dir, datatype=16))))


@query("SELECT vec_id::VARCHAR AS path, 0 AS qform_code, 1 AS sform_code, '2.0 0.0 0.0 9.0' AS x, '0.0 3.0 0.5 1.5' AS y FROM embeddings")
def affines_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix that maps voxels from 1 put into headers, which map them from 0."""
    matrix = [[2.0, 0.0, 0.0, 7.0], [0.0, 3.0, 0.5, -2.0], [0.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]]
    heads = images.decode_headers(images.rewrite_headers(_encoded(spark, sf_dir), lambda h: H.with_matrix(h, matrix)))
    return heads.select("path", "hist.qform_code", "hist.sform_code", *[F.array_join(F.col(f"hist.srow_{a}").cast("array<string>"), " ").alias(a) for a in "xy"])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey || ' ' || l_linenumber || ' ' || l_partkey AS line FROM lineitem")
def matrix_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ["l_orderkey", "l_linenumber", "l_partkey"]
    return table(spark, sf_dir, "lineitem").select(*cells, files.matrix_line(cells).alias("line"))


@query("SELECT r_name AS name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def process_dispatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The process of a job's name, out of a table of processes."""
    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    counted = lambda: nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("name")).agg(F.count("*").alias("n"))
    return catalog.dispatch("count", {"list": lambda: regions, "count": counted})


@query(f"WITH {VOLUMES_SQL} SELECT image_id, -2.0::DOUBLE AS x0, 4.0::DOUBLE AS x3, 2.0::DOUBLE AS y1, 1 AS sform_code, {rs('sum(v)', 5)} AS total FROM volumes GROUP BY image_id")
def headers_flipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left and right exchanged by rewriting headers alone."""
    fields = {"hist": {"sform_code": 1, "srow_x": [2.0, 0.0, 0.0, -4.0], "srow_y": [0.0, 2.0, 0.0, 1.0], "srow_z": [0.0, 0.0, 2.0, 0.0]}}
    flipped = images.rewrite_headers(_encoded(spark, sf_dir, datatype=64, fields=fields), H.flip_left_right)
    heads = images.decode_headers(flipped).select("path", F.col("hist.srow_x")[0].cast("double").alias("x0"), F.col("hist.srow_x")[3].cast("double").alias("x3"), F.col("hist.srow_y")[1].cast("double").alias("y1"), "hist.sform_code")
    totals = images.decode_volumes(flipped).select(F.col("path").cast("long").alias("image_id"), r(F.aggregate("voxels", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))
    return heads.join(totals, F.col("path").cast("long") == F.col("image_id")).drop("path")


@query("SELECT vec_id, (vec_id % 100000)::INT AS t, (vec_id % 3 + 1) * 10 AS files FROM embeddings")
def folder_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame numbers out of the digits before the suffix of single volumes' names."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("scan"), X.zero_padded(F.col("vec_id") % 100000, 5), F.lit(".nii.gz")).alias("path"), ((F.col("vec_id") % 3 + 1) * 10).alias("files"))
    return images.folder_as_series(rows).select("vec_id", "t", "files")


@query(f"WITH {MOTION_SQL} SELECT run::INT AS sub, '01' AS ses, 'rest' AS task, 2 AS run, t::BIGINT AS t, " + ", ".join(f"(printf('%.6f', {c})::DOUBLE + 0.0) AS {c}" for c in CHANNELS) + " FROM motion")
def motion_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six columns of text a run, read back with the parts of the file's name."""
    line = F.concat_ws("  ", *[X.fixed_decimal(F.col(c), 6) for c in CHANNELS])
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", line.alias("line")))), lambda s: s["line"]), "\n")
    name = X.run_path(F.lit(""), F.col("run").cast("int"), F.lit("01"), F.lit("rest"), F.lit(2), "_mcf.par")
    made = motion(spark, sf_dir).groupBy("run").agg(lines.alias("value")).select(F.concat(F.lit("BIDS/"), name).alias("path"), "value")
    return files.motion_rows(made).select("sub", "ses", "task", "run", "t", *[(F.col(c) + F.lit(0.0)).alias(c) for c in CHANNELS])


@query("SELECT c_custkey::VARCHAR AS path, unnest([0, 1, 2])::INT AS line_no, unnest([printf('%g', c_custkey * 0.125::DOUBLE), printf('%g', c_nationkey * 0.0625::DOUBLE), '1']) AS line FROM customer")
def slice_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice times of sidecars, a line a slice."""
    value = F.concat(F.lit('{"RepetitionTime": 2.0, "SliceTiming": ['), (F.col("c_custkey") * 0.125).cast("string"), F.lit(", "), (F.col("c_nationkey") * 0.0625).cast("string"), F.lit(", true]}"))
    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), value.alias("value"))
    return files.timing_lines(files.sidecar_rows(made))


#: Values put into templates, and lines that hold every key, as parts of a made-up template.
VALUES = {
    "Outputdir": "out", "outputdir": "out", "TR": 2.0, "Volumes": 100, "volumes": 100, "BET": 0, "Smooth": 6, "smooth": 6, "Input": "a.nii", "input": "a.nii", "SliceTimming": "st.txt", "atlas": "at.nii", "movement": "mv.txt",
    "condition": "c.txt", "cond": "c.txt", "slice_timing": template.SLICE_TIMING["file"], "motion_correction": 1,
}
PREPROCESS = template.PREPROCESS | template.VARIANT
LINES = [*PREPROCESS.values(), "set fmri(regstandard)", "set confoundev_files(1)", "set fmri(custom1)", "# set fmri(tr)", "set fmri(ndelete)", "set fmri(custom10)"]


def _template_sql(filled: dict[str, str]) -> str:
    """filled: the new line by the text that an old one holds."""
    cases = " ".join(f"WHEN contains(line, '{k}') THEN '{v}'" for k, v in filled.items())
    held = ", ".join(f"'{x}'" for x in LINES)
    return f"WITH l AS (SELECT p_partkey AS line_no, [{held}][(p_partkey % {len(LINES)} + 1)::INT] || ' ' || p_size AS line FROM part) SELECT line_no, CASE {cases} ELSE line END AS line FROM l"


def _filled(spark: SparkSession, sf_dir: str, find: dict[str, str]) -> DataFrame:
    held = F.element_at(F.array(*[F.lit(x) for x in LINES]), (F.col("p_partkey") % len(LINES) + 1).cast("int"))
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), F.concat(held, F.lit(" "), F.col("p_size").cast("string")).alias("line"))
    return template.fill(lines, template.rules(spark, find, VALUES))


@query(
    _template_sql(
        {
            "set fmri(outputdir)": 'set fmri(outputdir) "out"', "set fmri(tr)": "set fmri(tr) 2.0", "set fmri(npts)": "set fmri(npts) 100", "set fmri(bet_yn)": "set fmri(bet_yn) 0", "set fmri(smooth)": "set fmri(smooth) 6",
            "set feat_files(1)": 'set feat_files(1) "a.nii"', "set fmri(st_file)": 'set fmri(st_file) "st.txt"', "set fmri(st)": "set fmri(st) 4", "set fmri(mc)": "set fmri(mc) 1",
        }
    )
)
def preprocessing_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, PREPROCESS)


@query(
    _template_sql(
        {
            "set fmri(outputdir)": 'set fmri(outputdir) "out"', "set fmri(tr)": "set fmri(tr) 2.0", "set fmri(npts)": "set fmri(npts) 100", "set fmri(bet_yn)": "set fmri(bet_yn) 0", "set fmri(smooth)": "set fmri(smooth) 6",
            "set feat_files(1)": 'set feat_files(1) "a.nii"', "set fmri(regstandard)": 'set fmri(regstandard) "at.nii"', "set confoundev_files(1)": 'set confoundev_files(1) "mv.txt"', "set fmri(custom1)": 'set fmri(custom1) "c.txt"',
        }
    )
)
def model_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir, template.MODEL)


@query(
    _template_sql(
        {
            "set fmri(smooth)": "set fmri(smooth) 6", "set feat_files(1)": 'set feat_files(1) "a.nii"', "set confoundev_files(1)": 'set confoundev_files(1) "mv.txt"', "set fmri(custom1) ": 'set fmri(custom1) "c.txt"',
        }
    )
)
def short_model_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five labels, of which the atlas' key is in no line."""
    return _filled(spark, sf_dir, template.MODEL_SHORT)


@query(
    "SELECT c_custkey, lpad(c_nationkey::VARCHAR, 3, '0') AS padded, lpad((c_custkey % 3)::VARCHAR, 2, '0') AS session, (c_nationkey % 4 + 1)::INT AS run, 'sub' || c_custkey AS stem, 'a b ' || c_custkey AS spaced, "
    "CASE WHEN c_custkey % 2 = 0 THEN 'Dog' ELSE 'Hum' END AS species, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1 END AS bet, 'key=' || c_custkey || chr(10) || 'segment=' || c_mktsegment AS params FROM customer"
)
def names_and_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n = F.col("c_custkey"), F.col("c_nationkey")
    code = F.when(key % 2 == 0, "D").otherwise("H")
    label = X.parse_session_run(F.concat(F.lit("ses-"), X.zero_padded(key % 3), F.lit("_run-"), (n % 4 + 1).cast("string")))
    name = F.concat(F.lit("sub"), key.cast("string"))
    stem = X.without_suffix(F.concat(name, F.when(n % 2 == 0, ".nii").otherwise(".nii.gz")))
    spaced = X.single_spaced(F.concat(F.lit("a   b  "), key.cast("string")))
    params = X.params_text(F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("key"), key.cast("string")))
    rows = table(spark, sf_dir, "customer").select(key, X.zero_padded(n, 3).alias("padded"), label.alias("p"), stem.alias("stem"), spaced.alias("spaced"), X.species_name(code).alias("species"), X.brain_extraction_flag(code).alias("bet"), params.alias("params"))
    return rows.select(key, "padded", "p.session", "p.run", "stem", "spaced", "species", "bet", "params")


@query(
    "WITH f AS (SELECT s_suppkey, ['CN', 'FR', 'OC', 'PR', 'PS', 'SM', 'SUB', 'XX'][(s_suppkey % 8 + 1)::INT] AS lobe, 'A' || s_nationkey AS abbrev, CASE WHEN s_suppkey % 2 = 0 THEN 'L' ELSE 'R' END AS side FROM supplier) "
    "SELECT s_suppkey, lobe, abbrev, side, CASE lobe WHEN 'CN' THEN 'Cingulate' WHEN 'FR' THEN 'Frontal' WHEN 'OC' THEN 'Occipital' WHEN 'PR' THEN 'Parietal' WHEN 'PS' THEN 'Temporal' WHEN 'SM' THEN 'Sensory-motor' WHEN 'SUB' THEN 'Subcortical' END AS lobe_name FROM f"
)
def lobes_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lobe = F.element_at(F.array(*[F.lit(x) for x in (*atlas.LOBES, "XX")]), (F.col("s_suppkey") % 8 + 1).cast("int"))
    name = F.concat_ws("_", lobe, F.concat(F.lit("A"), F.col("s_nationkey").cast("string")), F.concat(F.when(F.col("s_suppkey") % 2 == 0, "L").otherwise("R"), F.lit(".nii.gz")))
    return atlas.lobe_of(atlas.roi_parts(table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("file")))).drop("file")


@query("SELECT vec_id AS image_id, 0 AS t, unnest(range(0, 64))::INT AS voxel, round(unnest(embedding)::DOUBLE, 6) + 0.0::DOUBLE AS v FROM embeddings")
def voxels_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.voxel_matrix(wide_volumes(spark, sf_dir)).select("image_id", "t", "voxel", r("v").alias("v"))


@query(f"WITH {VOLUMES_SQL} SELECT image_id, count(*) AS n, {rs('sum(v)')} AS v FROM volumes WHERE x BETWEEN least(image_id % 4, 2) AND greatest(image_id % 4, 2) GROUP BY image_id")
def limits_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = V.ordered_limits((F.col("image_id") % 4).cast("int"), F.lit(2))
    return volumes(spark, sf_dir).where(F.col("x").between(low, high)).groupBy("image_id").agg(F.count("*").alias("n"), r(F.sum("v")).alias("v"))


@query("SELECT file, onset, count(*) AS n FROM (SELECT 0 AS file, round(l_quantity, 2) AS onset FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT 1, round(l_quantity, 2) FROM lineitem WHERE l_linenumber = 2 UNION ALL SELECT 2, round(l_quantity, 2) FROM lineitem WHERE l_linenumber = 1) GROUP BY ALL")
def rows_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three files one after the other, with repeated ones."""
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", F.round("l_quantity", 2).alias("onset"))
    one, two = (lines.where(F.col("l_linenumber") == k).select("onset") for k in (1, 2))
    return events.concatenate([one, two, one]).groupBy("file", "onset").agg(F.count("*").alias("n"))


_RESULTS_SQL = "SELECT s_suppkey AS participant, s_nationkey AS run_N, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey % 7 END AS lost FROM supplier"


@query(f"WITH q AS ({_RESULTS_SQL}), n AS (SELECT *, row_number() OVER (ORDER BY run_N, participant) - 1 AS line_no FROM q) SELECT line_no, line_no || ',' || participant || ',' || run_N || ',' || coalesce(lost::VARCHAR, '') AS line FROM n")
def quality_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey") % 7)
    return files.quality_lines(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("participant"), F.col("s_nationkey").alias("run_N"), lost.alias("lost")), ["run_N", "participant"])


@query("SELECT n_regionkey::VARCHAR AS path, n_nationkey AS number, n_name || ', \"left\"' AS region FROM nation")
def atlas_labels_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label tables with a byte-order mark, a header line and quoted names, a file a region."""
    quoted = F.concat(F.lit('"'), "n_name", F.lit(', ""left"""'))
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(","), quoted)
    made = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("path")).agg(F.concat(F.lit("\ufeffNumber,Region\r\n"), F.array_join(F.collect_list(line), "\r\n"), F.lit("\r\n")).alias("value"))
    return files.labels_csv_rows(made, "number int, region string")


@query("SELECT n_regionkey::VARCHAR AS path, n_nationkey AS index, n_nationkey * 0.5::DOUBLE AS x, -1.25::DOUBLE AS y, n_regionkey::DOUBLE AS z, n_name AS name FROM nation")
def atlas_labels_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, rk = F.col("n_nationkey"), F.col("n_regionkey")
    element = F.concat(F.lit('<label index="'), n.cast("string"), F.lit('" x="'), (n * 0.5).cast("string"), F.lit('" y="-1.25" z="'), rk.cast("string"), F.lit('"> '), "n_name", F.lit(" </label>"))
    made = table(spark, sf_dir, "nation").groupBy(rk.cast("string").alias("path")).agg(F.concat(F.lit("<atlas><data>"), F.array_join(F.collect_list(element), "\n"), F.lit("</data></atlas>")).alias("value"))
    return files.labels_xml_rows(made)


def _matrix_file(rows, columns, values):
    """Content of a level-4 matrix file that holds one matrix M."""
    import struct

    body = b"".join(struct.pack("<d", values[i * columns + j]) for j in range(columns) for i in range(rows))
    return struct.pack("<5i", 0, rows, columns, 0, 2) + b"M\0" + body


@query("SELECT vec_id::VARCHAR AS path, 'M' AS name, 8 AS n_rows, 8 AS n_columns, round(list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::DOUBLE * (i + 1))), 5) + 0.0::DOUBLE AS weighted FROM embeddings")
def matrix_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 x 8 matrices in files, read back; the weighted sum tells the order of what was read."""
    content = F.pandas_udf(lambda v: v.map(lambda x: _matrix_file(8, 8, [float(y) for y in x])), "binary")
    made = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), content("embedding").alias("content"))
    weighted = F.aggregate(F.transform("values", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return images.matrix_rows(made).select("path", "name", "n_rows", "n_columns", r(weighted, 5).alias("weighted"))
