"""Queries that apply the operators to the driver's tables, with the same in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import text as X
from ..model import CHANNELS, to_long
from ..operators import atlas, catalog, events, motion as M, quality, resample as R, signal as S, template, volume as V
from . import file_queries, filter_queries, model_queries, registration_queries  # noqa: F401  they register their queries
from .registry import QUERIES, SQL, query, r, rs  # noqa: F401
from .tables import CUBE, MOTION_SQL, SERIES_SQL, SIGNAL_SQL, VOLUMES_SQL, event_series, motion, series, signal, table, volumes, wide_volumes

FD_THRESHOLD, CHANGE_THRESHOLD, RADIUS = 10.0, 20.0, 55.0


def _fd_sql(channels: str = "motion", radius: float = RADIUS, detrend: bool = True) -> str:
    parts = []
    for c, s in zip(CHANNELS, M.scales(radius), strict=True):
        slope = f" - coalesce(regr_slope({c}, t) OVER (PARTITION BY run), 0)" if detrend else ""
        parts.append(f"abs({c} - lag({c}) OVER (PARTITION BY run ORDER BY t){slope}) * {s}::DOUBLE")
    return f"SELECT run, t, coalesce({' + '.join(parts)}, 0.0::DOUBLE) AS fd FROM {channels}"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.framewise_displacement(motion(spark, sf_dir), ["run"], scale=M.scales(RADIUS))


@query(
    f"WITH {MOTION_SQL}, f AS ({_fd_sql()}) SELECT run, {rs('avg(fd)')} AS fwd, {rs(f'avg(CASE WHEN fd < {FD_THRESHOLD} THEN fd END)')} AS fwd_clean, "
    f"sum(CASE WHEN fd > {FD_THRESHOLD} THEN 1 ELSE 0 END)::BIGINT AS lost, count(*) AS total FROM f GROUP BY run"
)
def fd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.nanvl(quality.clean_mean("fd", FD_THRESHOLD), F.lit(None).cast("double"))
    return _frames(spark, sf_dir).groupBy("run").agg(r(F.avg("fd")).alias("fwd"), r(clean).alias("fwd_clean"), quality.lost_count(M.lost_mask("fd", FD_THRESHOLD)).alias("lost"), F.count("*").alias("total"))


@query(f"WITH {MOTION_SQL}, f AS ({_fd_sql()}) SELECT run, t, {rs('fd')} AS fd, (fd <= {FD_THRESHOLD})::TINYINT AS keep, fd > {FD_THRESHOLD} AS lost FROM f")
def fd_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("run", "t", r("fd").alias("fd"), M.keep_mask("fd", FD_THRESHOLD).alias("keep"), M.lost_mask("fd", FD_THRESHOLD).alias("lost"))


@query(f"WITH {MOTION_SQL}, f AS ({_fd_sql(detrend=False, radius=50.0)}) SELECT run, t, {rs('fd', 9)} AS fd FROM f")
def fd_without_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.framewise_displacement(motion(spark, sf_dir), ["run"], detrend=False).select("run", "t", r("fd", 9).alias("fd"))


@query(f"WITH {MOTION_SQL}, f AS ({_fd_sql()}) SELECT run, t, {rs('fd')} AS fd FROM f")
def fd_long_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.long_run_displacement(motion(spark, sf_dir), ["run"], scale=M.scales(RADIUS), block=128).select("run", "t", r("fd").alias("fd"))


@query(
    f"WITH {MOTION_SQL} SELECT run, t, "
    + ", ".join(rs(f"{c} - (regr_intercept({c}, t) OVER (PARTITION BY run) + t * regr_slope({c}, t) OVER (PARTITION BY run)) + avg({c}) OVER (PARTITION BY run)") + f" AS {c}" for c in CHANNELS)
    + " FROM motion"
)
def motion_detrended(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.detrend_linear(motion(spark, sf_dir), ["run"], keep_mean=True)
    return out.select("run", "t", *[r(c).alias(c) for c in CHANNELS])


@query(
    f"WITH {MOTION_SQL}, d AS (SELECT run, " + ", ".join(f"{c} - (regr_intercept({c}, t) OVER (PARTITION BY run) + t * regr_slope({c}, t) OVER (PARTITION BY run)) AS {c}" for c in CHANNELS) + " FROM motion) SELECT run, "
    + ", ".join(rs(f"sqrt(avg({c} * {c})) * {s}::DOUBLE") + f" AS rms_{c}" for c, s in zip(CHANNELS, M.scales(RADIUS), strict=True))
    + " FROM d GROUP BY run"
)
def motion_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.channel_rms(motion(spark, sf_dir), ["run"], scale=M.scales(RADIUS))
    return out.select("run", *[r(f"rms_{c}").alias(f"rms_{c}") for c in CHANNELS])


#: The square of time less its line over the run, and a channel's line; what is left of a channel is less its share of that square.
_SQUARE_SQL = "t * t - regr_intercept(t * t, t) OVER (PARTITION BY run) - t * regr_slope(t * t, t) OVER (PARTITION BY run)"


@query(
    f"WITH {MOTION_SQL}, q AS (SELECT run, t, {_SQUARE_SQL} AS q, "
    + ", ".join(f"{c} - regr_intercept({c}, t) OVER (PARTITION BY run) - t * regr_slope({c}, t) OVER (PARTITION BY run) AS {c}, avg({c}) OVER (PARTITION BY run) AS m_{c}" for c in CHANNELS)
    + " FROM motion) SELECT run, t, "
    + ", ".join(rs(f"{c} - q * sum(q * {c}) OVER (PARTITION BY run) / sum(q * q) OVER (PARTITION BY run) + m_{c}") + f" AS {c}" for c in CHANNELS)
    + " FROM q"
)
def motion_detrended_polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.detrend_polynomial(motion(spark, sf_dir), ["run"], keep_mean=True)
    return out.select("run", "t", *[r(c).alias(c) for c in CHANNELS])


def _smooth_sql(tr: float) -> str:
    """Smoothing by the polynomials that are orthogonal over a window of 2 h + 1 frames, then the regression."""
    powers = ("1.0::DOUBLE", "{j}", "({j} * {j} - h * (h + 1) / 3)", "({j} * {j} * {j} - {j} * (3 * h * h + 3 * h - 1) / 5)")
    at, own = ([p.format(j=j) for p in powers] for j in ("(w.t - f.c)", "(f.t - f.c)"))
    trend = lambda c: " + ".join(f"{o} * sum({p} * w.{c}) / sum({p} * {p})" for o, p in zip(own, at, strict=True))
    left = lambda c: f"d.{c} - regr_intercept(d.{c}, s.{c}) OVER p - s.{c} * regr_slope(d.{c}, s.{c}) OVER p + avg(d.{c}) OVER p"
    return (
        f"WITH {MOTION_SQL}, n AS (SELECT run, count(*) AS n, CASE WHEN count(*) * {tr} >= 240 THEN floor(240 / {tr}::DOUBLE + 0.5)::BIGINT ELSE count(*) END AS k FROM motion GROUP BY run), "
        "h AS (SELECT run, n, ((k - 1 + k % 2) // 2)::DOUBLE AS h FROM n), f AS (SELECT m.run, m.t, h.h, least(greatest(m.t, h.h), h.n - 1 - h.h) AS c FROM motion m JOIN h USING (run)), "
        f"s AS (SELECT f.run, f.t, {', '.join(f'{trend(c)} AS {c}' for c in CHANNELS)} FROM f JOIN motion w ON w.run = f.run AND w.t BETWEEN f.c - f.h AND f.c + f.h GROUP BY f.run, f.t, f.c, f.h) "
        f"SELECT d.run, d.t, {', '.join(rs(left(c)) + f' AS {c}' for c in CHANNELS)} FROM motion d JOIN s ON s.run = d.run AND s.t = d.t WINDOW p AS (PARTITION BY d.run)"
    )


@query(_smooth_sql(2.0))
def motion_detrended_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.detrend_smooth(motion(spark, sf_dir), ["run"], tr=2.0)
    return out.select("run", "t", *[r(c).alias(c) for c in CHANNELS])


_EVENTS_SQL = "e AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS v FROM events)"


@query(
    f"WITH {_EVENTS_SQL}, f AS (SELECT run, t, (coalesce(abs(v - lag(v) OVER (PARTITION BY run ORDER BY t) - regr_slope(v, t) OVER (PARTITION BY run)), 0) > 50)::INT AS lost FROM e), "
    "n AS (SELECT run, t, CASE WHEN lost = 1 THEN sum(lost) OVER (PARTITION BY run ORDER BY t) ELSE 0 END AS nth, sum(lost) OVER (PARTITION BY run) AS k FROM f) "
    "SELECT run, t, array_to_string(list_transform(range(1, greatest(k, 1)::BIGINT + 1), lambda i: CASE WHEN i = nth THEN 1 ELSE 0 END), ' ') AS spikes FROM n"
)
def spike_regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    fd = M.framewise_displacement(event_series(spark, sf_dir), ["run"], channels=["v"], scale=[1.0])
    out = M.spike_regressors(fd.withColumn("lost", M.lost_mask("fd", 50.0)), ["run"])
    return out.select("run", "t", F.array_join(F.col("spikes").cast("array<string>"), " ").alias("spikes"))


def _psc_sql(source: str) -> str:
    return (
        f"m AS (SELECT *, avg(v) OVER (PARTITION BY run, voxel) AS mean, max(abs(v)) OVER (PARTITION BY run, voxel) AS top FROM {source}), "
        f"p AS (SELECT run, t, voxel, coalesce(CASE WHEN mean <= {S.LOW_MEAN}::DOUBLE THEN 100 * (v + top) / nullif(top, 0) ELSE 100 * v / nullif(mean, 0) END - 100, 0) AS psc FROM m)"
    )


_DVARS_SQL = (
    "d AS (SELECT run, t, psc, coalesce(psc - lag(psc) OVER (PARTITION BY run, voxel ORDER BY t), 0) AS diff FROM p), "
    "g AS (SELECT run, t, sqrt(avg(diff * diff)) AS dvars, abs(avg(psc)) AS global_change FROM d GROUP BY run, t)"
)


@query(f"WITH {SERIES_SQL}, {_psc_sql('series')} SELECT run, t, voxel, {rs('psc', 4)} AS psc FROM p")
def percent_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.percent_change(series(spark, sf_dir)).select("run", "t", F.col("voxel").cast("long").alias("voxel"), r("psc", 4).alias("psc"))


@query(f"WITH {SERIES_SQL}, {_psc_sql('series')}, {_DVARS_SQL} SELECT run, t, {rs('dvars', 4)} AS dvars, {rs('global_change', 4)} AS global_change FROM g")
def dvars_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.frame_signals(S.percent_change(series(spark, sf_dir))).select("run", "t", r("dvars", 4).alias("dvars"), r("global_change", 4).alias("global_change"))


@query(
    f"WITH {SERIES_SQL}, {_psc_sql('series')}, {_DVARS_SQL}, z AS (SELECT run, t, dvars, CASE WHEN t > 0 THEN dvars END AS rest FROM g) "
    f"SELECT run, t, CASE WHEN t = 0 THEN 0.0::DOUBLE ELSE {rs('coalesce((dvars - avg(rest) OVER (PARTITION BY run)) / nullif(stddev_samp(rest) OVER (PARTITION BY run), 0), 0)', 4)} END AS z FROM z"
)
def dvars_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.z_scores(S.dvars(S.percent_change(series(spark, sf_dir)))).select("run", "t", r("z", 4).alias("z"))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    fd = _frames(spark, sf_dir).select("run", "t", "fd")
    return quality.join_frames(fd, S.global_change(S.percent_change(signal(spark, sf_dir))), ["run"])


def _lost(spark: SparkSession, sf_dir: str, *kept: str) -> DataFrame:
    """Whether each frame is lost by either measure, and the motion columns ``kept``: judged before the join, which then moves flags and no measures."""
    fd = _frames(spark, sf_dir).select("run", "t", M.lost_mask("fd", FD_THRESHOLD).alias("fd_lost"), *kept)
    change = S.global_change(S.percent_change(signal(spark, sf_dir))).select("run", "t", M.lost_mask("global_change", CHANGE_THRESHOLD).alias("change_lost"))
    return quality.join_frames(fd, change, ["run"])


_BOTH_SQL = f"WITH {MOTION_SQL}, {SIGNAL_SQL}, f AS ({_fd_sql()}), {_psc_sql('signal')}, g AS (SELECT run, t, abs(avg(psc)) AS c FROM p GROUP BY run, t), b AS (SELECT run, t, fd, c FROM f JOIN g USING (run, t)) "


@query(
    _BOTH_SQL + f"SELECT run, {rs('avg(fd)', 4)} AS fwd, {rs(f'avg(CASE WHEN fd < {FD_THRESHOLD} THEN fd END)', 4)} AS fwd_clean, count(*) FILTER (fd > {FD_THRESHOLD}) AS volumesLostAfter_fwd, count(*) AS totalVolumes, "
    f"{rs('avg(c)', 4)} AS dvars, {rs(f'avg(CASE WHEN c < {CHANGE_THRESHOLD} THEN c END)', 4)} AS dvars_clean, count(*) FILTER (c > {CHANGE_THRESHOLD}) AS volumesLostAfter_dvars, "
    f"count(*) FILTER (fd > {FD_THRESHOLD} OR c > {CHANGE_THRESHOLD}) AS lostVolumes_fw_or_dvars, count(*) FILTER (fd > {FD_THRESHOLD} AND c > {CHANGE_THRESHOLD}) AS lostVolumes_fw_and_dvars FROM b GROUP BY run"
)
def quality_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_table(_both(spark, sf_dir), ["run"], FD_THRESHOLD, CHANGE_THRESHOLD)
    nan = F.lit(None).cast("double")
    return out.select(*[r(F.nanvl(F.col(c), nan), 4).alias(c) if c in ("fwd", "fwd_clean", "dvars", "dvars_clean") else c for c in out.columns])


@query(
    _BOTH_SQL + "SELECT m.run, m.t, " + " || chr(9) || ".join(f"printf('%.6f', m.{c})" for c in CHANNELS) + f" || chr(9) || printf('%.6f', (fd > {FD_THRESHOLD} OR c > {CHANGE_THRESHOLD})::INT::DOUBLE) AS line FROM motion m JOIN b USING (run, t)"
)
def motion_with_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = quality.choose_mask("or", F.col("fd_lost"), F.col("change_lost"))
    rows = _lost(spark, sf_dir, *CHANNELS).withColumn("mask", lost.cast("int"))
    return rows.select("run", "t", M.motion_lines(rows).alias("line"))


_FD_LOST, _CHANGE_LOST = f"fd > {FD_THRESHOLD}", f"c > {CHANGE_THRESHOLD}"


@query(_BOTH_SQL + f"SELECT run, t, {_FD_LOST} AS fwd, {_CHANGE_LOST} AS dvars, {_FD_LOST} OR {_CHANGE_LOST} AS either, {_FD_LOST} AND {_CHANGE_LOST} AS both FROM b")
def masks_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = (F.col("fd_lost"), F.col("change_lost"))
    shown = {"fwd": "fwd", "dvars": "dvars", "or": "either", "and": "both"}
    return _lost(spark, sf_dir).select("run", "t", *[quality.choose_mask(k, *lost).alias(v) for k, v in shown.items()])


@query(f"WITH {SERIES_SQL} SELECT run, voxel, {rs('avg(v)')} AS v FROM series GROUP BY run, voxel")
def temporal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.temporal_mean(series(spark, sf_dir), ["run"], ["voxel"]).select("run", F.col("voxel").cast("long").alias("voxel"), r("v").alias("v"))


@query(f"WITH {SERIES_SQL}, m AS (SELECT run, voxel, avg(v) AS v FROM series GROUP BY run, voxel) SELECT voxel, {rs('avg(v)')} AS v FROM m GROUP BY voxel")
def mean_of_run_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mean_of_run_means(series(spark, sf_dir), place=["voxel"]).select(F.col("voxel").cast("long").alias("voxel"), r("v").alias("v"))


def _long(df: DataFrame) -> DataFrame:
    return df.select("image_id", *[F.col(a).cast("int").alias(a) for a in "xyz"], r("v").alias("v"))


def _volume_sql(select: str, where: str = "true") -> str:
    return f"WITH {VOLUMES_SQL} SELECT image_id, {select} FROM volumes WHERE {where}"


@query(_volume_sql(f"x, y, z, {rs('v')} AS v", "y = 2"))
def volume_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(V.slice_at(volumes(spark, sf_dir), "y", 2))


@query(_volume_sql(f"x - 1 AS x, y, z - 2 AS z, {rs('v')} AS v", "x BETWEEN 1 AND 2 AND y BETWEEN 0 AND 2 AND z BETWEEN 2 AND 3"))
def volume_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(V.crop(volumes(spark, sf_dir), {"x": (2, 1), "y": (0, 2), "z": (2, 9)}, dict(zip("xyz", CUBE, strict=True))))


@query(_volume_sql(f"x - 1 AS x, y, z - 1 AS z, {rs('v')} AS v", "x BETWEEN 1 AND 3 AND y BETWEEN 0 AND 2 AND z BETWEEN 1 AND 3"))
def volume_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(V.clip(volumes(spark, sf_dir), {"L": 1, "A": 1, "I": 1}, CUBE)[0])


@query(
    f"WITH {VOLUMES_SQL}, g AS (SELECT image_id, x::INT AS x, y::INT AS y, z::INT AS z FROM (SELECT DISTINCT image_id FROM volumes), range(0, 6) a(x), range(0, 5) b(y), range(0, 5) c(z)) "
    f"SELECT g.image_id, g.x, g.y, g.z, {rs('coalesce(v.v, -1)')} AS v FROM g LEFT JOIN volumes v ON v.image_id = g.image_id AND v.x = g.x - 1 AND v.y = g.y AND v.z = g.z - 1"
)
def volume_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(V.pad(volumes(spark, sf_dir), {"L": 1, "R": 1, "A": 1, "I": 1}, CUBE, background=-1.0)[0])


@query(_volume_sql(f"3 - x AS x, z AS y, 3 - y AS z, {rs('v')} AS v"))
def volume_reorient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(V.reorient(volumes(spark, sf_dir), ["-x", "z", "-y"], CUBE))


@query(_volume_sql(f"y AS x, 3 - x AS y, z, {rs('v')} AS v"))
def volume_to_ras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(V.reorient(volumes(spark, sf_dir), V.from_orient_codes((5, 1, 3)), CUBE))


@query(_volume_sql(f"x, y, z, {rs('v')} AS v"))
def volume_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = ["y", "-z", "x"]
    return _long(V.reorient(V.reorient(volumes(spark, sf_dir), there, CUBE), V.inverse_axes(there), CUBE))


@query(_volume_sql(f"x, y, z, {rs('v * CASE WHEN x + y >= 3 THEN z ELSE 0 END')} AS v"))
def volume_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = volumes(spark, sf_dir).where("image_id = 0 and x + y >= 3").select("x", "y", "z", F.col("z").alias("m"))
    return _long(V.apply_mask(volumes(spark, sf_dir), mask))


@query(_volume_sql("x, y, z, CASE WHEN v >= 0.05::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v"))
def volume_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(V.threshold(volumes(spark, sf_dir), 0.05))


def _labels(df: DataFrame) -> DataFrame:
    return df.select("image_id", "x", "y", "z", F.floor(F.abs(F.col("v")) * 10).cast("int").alias("label"))


@query(
    f"WITH {VOLUMES_SQL}, l AS (SELECT image_id, x, y, z, floor(abs(v) * 10)::INT AS label FROM volumes) "
    "SELECT a.image_id, a.x, a.y, a.z, a.label, b.label AS other FROM l a JOIN l b ON b.image_id = a.image_id + 1 AND a.x = b.x AND a.y = b.y AND a.z = b.z WHERE a.label > 0 AND b.label > 0 AND a.label <> b.label"
)
def label_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(volumes(spark, sf_dir))
    return V.overlaps(labels, labels.withColumn("image_id", F.col("image_id") - 1), ["image_id", "x", "y", "z"])


@query(f"WITH {VOLUMES_SQL} SELECT image_id, {rs('min(v)')} AS glmin, {rs('max(v)')} AS glmax FROM volumes GROUP BY image_id")
def value_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.value_range(volumes(spark, sf_dir)).select("image_id", r("glmin").alias("glmin"), r("glmax").alias("glmax"))


_BIN_SQL = "CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / (hi - lo) * {n}), {n} - 1) END"


@query(f"WITH {VOLUMES_SQL}, e AS (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM volumes) SELECT image_id, ({_BIN_SQL.format(n=10)})::BIGINT AS bin, count(*) AS n FROM e GROUP BY ALL")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.histogram(volumes(spark, sf_dir))


@query(
    f"WITH {VOLUMES_SQL}, e AS (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM volumes), b AS (SELECT image_id, x, y, z, ({_BIN_SQL.format(n=256)})::BIGINT AS bin FROM e) "
    f"SELECT image_id, x, y, z, {rs('(count(*) OVER (PARTITION BY image_id ORDER BY bin))::DOUBLE / count(*) OVER (PARTITION BY image_id)')} AS v FROM b"
)
def histogram_equalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(V.equalise(volumes(spark, sf_dir)))


@query(
    f"WITH {VOLUMES_SQL}, m AS (SELECT image_id // 3 AS scan, image_id % 3 + 1 AS nth, x, y, z, (v > 0.1)::INT AS m, (image_id % 2) * 0.5 AS thr FROM volumes) "
    "SELECT scan, x, y, z, (max(m) > 0)::INT AS m FROM m WHERE thr > 0 OR nth = 1 GROUP BY scan, x, y, z"
)
def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("image_id")
    masks = volumes(spark, sf_dir).select(F.floor(i / 3).cast("long").alias("scan"), (i % 3 + 1).alias("nth"), "x", "y", "z", (F.col("v") > 0.1).cast("int").alias("m"), ((i % 2) * 0.5).alias("thr"))
    return V.mask_union(masks, ["scan", "x", "y", "z"], thr="thr")


#: A turn by 20 degrees round the third axis, larger voxels along it, and a shift.
_TURN = np.array([[np.cos(np.pi / 9), -np.sin(np.pi / 9), 0, -1.3], [np.sin(np.pi / 9), np.cos(np.pi / 9), 0, 0.4], [0, 0, 1.5, 2.0], [0, 0, 0, 1]])
_GRID = R.output_grid(CUBE, _TURN)
_TARGET = R.target_grid((3, 3, 2), R.scaled_map(np.array([[1, 0.1, 0, 0.2], [-0.1, 1, 0, 0.1], [0, 0, 1, 0], [0, 0, 0, 1]]), (1, 1, 1), (1.25, 1.25, 1.75)))


def _grid_sql(grid: R.Grid, bg: str) -> str:
    axes = ", ".join(f"range(0, {n}) {a}_({a})" for a, n in zip("xyz", grid.dims, strict=True))
    places = ", ".join(f"{float(m[0])!r}::DOUBLE * x + {float(m[1])!r}::DOUBLE * y + {float(m[2])!r}::DOUBLE * z + {float(m[3]) + 1.0!r}::DOUBLE AS p{a}" for a, m in zip("xyz", grid.to_old[:3], strict=True))
    images = f"(SELECT image_id, {bg} AS bg FROM volumes GROUP BY image_id)"
    return f"g AS (SELECT image_id, bg, x::INT AS x, y::INT AS y, z::INT AS z, {places} FROM {images}, {axes})"


_ENDS_SQL = "(max(CASE WHEN x + y + z = 0 THEN v END) + max(CASE WHEN x + y + z = 9 THEN v END)) / 2"


def _nearest_sql(grid: R.Grid, bg: str, value: str = rs("coalesce(v.v, g.bg)")) -> str:
    same = " AND ".join(f"v.{a} = round(g.p{a})::INT - 1" for a in "xyz")
    return f"WITH {VOLUMES_SQL}, {_grid_sql(grid, bg)} SELECT g.image_id, g.x, g.y, g.z, {value} AS v FROM g LEFT JOIN volumes v ON v.image_id = g.image_id AND {same}"


def _trilinear_sql(grid: R.Grid, bg: str, shown: str = rs("{v}")) -> str:
    """Eight looked-up voxels for each place; no joins but that of volumes and grid."""
    axes = ", ".join(f"range(0, {n}) {a}_({a})" for a, n in zip("xyz", grid.dims, strict=True))
    places = ", ".join(f"{float(m[0])!r}::DOUBLE * x + {float(m[1])!r}::DOUBLE * y + {float(m[2])!r}::DOUBLE * z + {float(m[3]) + 1.0!r}::DOUBLE AS p{a}" for a, m in zip("xyz", grid.to_old[:3], strict=True))
    inside = " AND ".join(f"p{a} > 0.95::DOUBLE AND p{a} < 4.05::DOUBLE" for a in "xyz")

    def corner(ups: tuple[int, int, int]) -> str:
        at = [f"(CASE WHEN floor(p{a}) < 1 THEN 1 WHEN floor(p{a}) > 3 THEN 4 ELSE floor(p{a})::INT + {u} END - 1)" for a, u in zip("xyz", ups, strict=True)]
        weight = [f"(p{a} - floor(p{a}))" if u else f"(1 - (p{a} - floor(p{a})))" for a, u in zip("xyz", ups, strict=True)]
        return f"{' * '.join(weight)} * e[{at[0]} + 4 * {at[1]} + 16 * {at[2]} + 1]"

    value = " + ".join(corner((k & 1, k >> 1 & 1, k >> 2 & 1)) for k in range(8))
    return (
        f"WITH g AS (SELECT vec_id AS image_id, embedding::DOUBLE[] AS e, x::INT AS x, y::INT AS y, z::INT AS z, {places} FROM embeddings, {axes}) "
        f"SELECT image_id, x, y, z, {shown.replace('{v}', f'CASE WHEN {inside} THEN {value} ELSE {bg} END')} AS v FROM g"
    )


@query(_nearest_sql(_GRID, _ENDS_SQL))
def resample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(to_long(R.on_arrays(wide_volumes(spark, sf_dir), _GRID, CUBE, method=2)))


@query(_trilinear_sql(_GRID, "(e[1] + e[64]) / 2"))
def resample_trilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(to_long(R.on_arrays(wide_volumes(spark, sf_dir), _GRID, CUBE)))


@query(_trilinear_sql(_GRID, "(e[1] + e[64]) / 2"))
def resample_trilinear_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(R.trilinear(volumes(spark, sf_dir), _GRID, CUBE))


@query(_nearest_sql(_GRID, _ENDS_SQL))
def resample_nearest_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(R.nearest(volumes(spark, sf_dir), _GRID, CUBE))


@query(_trilinear_sql(_TARGET, "0.0::DOUBLE"))
def apply_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(to_long(R.on_arrays(wide_volumes(spark, sf_dir), _TARGET, CUBE, bg=0.0)))


def _lines_sql(grid: R.Grid, bg: str, shown: str = rs("{v}")) -> str:
    m, nx = grid.to_old, grid.dims[0]
    place = lambda k, x: f"round({float(m[k, 0] * x)!r}::DOUBLE + {float(m[k, 1])!r}::DOUBLE * y + {float(m[k, 2])!r}::DOUBLE * z + {float(m[k, 3]) + 1.0!r}::DOUBLE)::BIGINT"
    ends = ", ".join(f"{place(k, -1.0)} AS s{a}, {place(k, nx - 1.0)} AS e{a}" for k, a in enumerate("xyz"))
    at = ", ".join(f"CASE WHEN n = 0 THEN s{a} ELSE s{a} + sign(e{a} - s{a}) * ((2 * k * abs(e{a} - s{a}) + n) // (2 * n)) END - 1 AS q{a}" for a in "xyz")
    same = " AND ".join(f"v.{a} = q.q{a}" for a in "xyz")
    return (
        f"WITH {VOLUMES_SQL}, {_grid_sql(grid, bg)}, l AS (SELECT image_id, bg, x, y, z, {ends} FROM g), n AS (SELECT *, greatest(abs(ex - sx), abs(ey - sy), abs(ez - sz)) AS n FROM l), "
        f"k AS (SELECT *, least(greatest(round((x + 1) * (n + 1) / {nx}::DOUBLE)::BIGINT, 1), n + 1) - 1 AS k FROM n), q AS (SELECT image_id, bg, x, y, z, {at} FROM k) "
        f"SELECT q.image_id, q.x, q.y, q.z, {shown.replace('{v}', 'coalesce(v.v, q.bg)')} AS v FROM q LEFT JOIN volumes v ON v.image_id = q.image_id AND {same}"
    )


@query(_lines_sql(_GRID, _ENDS_SQL))
def resample_along_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(R.along_lines(volumes(spark, sf_dir), _GRID, CUBE))


@query(_nearest_sql(R.output_grid(CUBE, _TURN, (0.8, 0.8, 0.8)), _ENDS_SQL, rs("coalesce(v.v, g.bg)::FLOAT::DOUBLE", 5)))
def reslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = R.reslice(volumes(spark, sf_dir), CUBE, _TURN, (1.0, 0.8, 1.5), method=2)
    return out.select("image_id", "x", "y", "z", r(F.col("v").cast("double"), 5).alias("v"))


_FLOATS = rs("({v})::FLOAT::DOUBLE", 5)


def _resliced(spark: SparkSession, sf_dir: str, method: int) -> DataFrame:
    out, _ = R.reslice(volumes(spark, sf_dir), CUBE, _TURN, (1.0, 0.8, 1.5), method=method)
    return out.select("image_id", "x", "y", "z", r(F.col("v").cast("double"), 5).alias("v"))


@query(_trilinear_sql(R.output_grid(CUBE, _TURN, (0.8, 0.8, 0.8)), "(e[1] + e[64]) / 2", _FLOATS))
def reslice_trilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resliced(spark, sf_dir, 1)


@query(_lines_sql(R.output_grid(CUBE, _TURN, (0.8, 0.8, 0.8)), _ENDS_SQL, _FLOATS))
def reslice_along_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resliced(spark, sf_dir, 3)


@query(f"WITH {SERIES_SQL} SELECT run, voxel, {rs('v')} AS v FROM series WHERE t = 0")
def first_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.first_volume(series(spark, sf_dir)).select("run", F.col("voxel").cast("long").alias("voxel"), r("v").alias("v"))


@query(f"WITH {VOLUMES_SQL} SELECT image_id, t, x, y, z, {rs('v')} AS v FROM (SELECT image_id, t, x, y, z, v FROM volumes UNION ALL SELECT image_id, t, x, y, z + 4, -v FROM volumes UNION ALL SELECT image_id, t, x, y, z + 8, v FROM volumes WHERE z < 2)")
def volumes_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = volumes(spark, sf_dir)
    out = V.concatenate([(a, 4), (a.withColumn("v", -F.col("v")), 4), (V.crop(a, {"z": (0, 1)}), 2)], "z")
    return out.select("image_id", "t", "x", "y", "z", r("v").alias("v"))


@query(f"WITH {VOLUMES_SQL}, n AS (SELECT image_id, (row_number() OVER (ORDER BY 'scan' || image_id) - 1)::INT AS t FROM (SELECT DISTINCT image_id FROM volumes)) SELECT 'scan' || v.image_id AS path, n.t, count(*) AS n, {rs('sum(v)')} AS v FROM volumes v JOIN n USING (image_id) GROUP BY ALL")
def frames_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = volumes(spark, sf_dir).withColumn("path", F.concat(F.lit("scan"), F.col("image_id").cast("string")))
    return V.frames_by_name(named).groupBy("path", "t").agg(F.count("*").alias("n"), r(F.sum("v")).alias("v"))


@query(_volume_sql(f"t, x, y, z, {rs('CASE WHEN image_id % 2 = 0 AND z = 1 THEN 0.5::DOUBLE ELSE v END')} AS v"))
def slices_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = volumes(spark, sf_dir)
    patch = base.where("image_id % 2 = 0 and z = 1").withColumn("v", F.lit(0.5))
    return V.replace_slices(base, patch).select("image_id", "t", "x", "y", "z", r("v").alias("v"))


@query("SELECT c_custkey, unnest(range(1, least(c_nationkey % 4 + 1, c_custkey % 3 + 1)::BIGINT + 1))::INT AS run, unnest(list_transform(range(1, least(c_nationkey % 4 + 1, c_custkey % 3 + 1)::BIGINT + 1), lambda i: 'ses-0' || i)) AS session FROM customer")
def runs_with_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.sequence(F.lit(1), F.col("c_nationkey") % 4 + 1)
    sessions = F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 3 + 1).cast("int")), lambda i: F.concat(F.lit("ses-0"), i.cast("string")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", runs.alias("runs"), sessions.alias("sessions"))
    return catalog.paired(rows, "runs", "sessions", ("run", "session")).select("c_custkey", "run", "session")


#: A project a nation, with so many participants, sessions and runs.
@query("SELECT n_nationkey, sub::INT AS sub, lpad(s::VARCHAR, 2, '0') AS ses, run::INT AS run FROM nation, range(1, 20) a(sub), range(1, 4) b(s), range(1, 5) c(run) WHERE sub <= n_nationkey % 19 + 1 AND s <= n_regionkey % 3 + 1 AND run <= n_nationkey % 4 + 1")
def run_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    upto = lambda n: F.sequence(F.lit(1), n)
    sessions = F.transform(upto((F.col("n_regionkey") % 3 + 1).cast("int")), lambda s: F.lpad(s.cast("string"), 2, "0"))
    projects = table(spark, sf_dir, "nation").select("n_nationkey", upto((F.col("n_nationkey") % 19 + 1).cast("int")).alias("participants"), sessions.alias("sessions"), upto((F.col("n_nationkey") % 4 + 1).cast("int")).alias("runs"))
    return catalog.run_grid_of(projects)


#: A search a supplier: values from -180 in steps, as far as its part goes.
@query(
    "WITH v AS (SELECT s_suppkey, v::INT AS v FROM supplier, range(-180, 181, 40) r(v) WHERE v <= -180 + 40 * (s_suppkey % 5)), w AS (SELECT s_suppkey, v::INT AS v FROM supplier, range(-180, 181, 90) r(v)), "
    "p AS (SELECT a.s_suppkey, a.v AS lo, b.v AS hi FROM v a JOIN v b ON a.s_suppkey = b.s_suppkey AND a.v < b.v), q AS (SELECT a.s_suppkey, a.v AS lo, b.v AS hi FROM w a JOIN w b ON a.s_suppkey = b.s_suppkey AND a.v < b.v) "
    "SELECT x.s_suppkey, x.lo AS x_min, x.hi AS x_max, y.lo AS y_min, y.hi AS y_max, z.lo AS z_min, z.hi AS z_max FROM p x JOIN p y ON x.s_suppkey = y.s_suppkey JOIN q z ON x.s_suppkey = z.s_suppkey"
)
def search_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.sequence(F.lit(-180), (F.lit(-180) + 40 * (F.col("s_suppkey") % 5)).cast("int"), F.lit(40))
    searches = table(spark, sf_dir, "supplier").select("s_suppkey", some.alias("x"), some.alias("y"), F.sequence(F.lit(-180), F.lit(180), F.lit(90)).alias("z"))
    return catalog.search_ranges_of(searches)


#: Runs of a made-up project, a customer a participant; of its files every third is missing.
_RUNS_SQL = "runs AS (SELECT c_custkey::INT AS sub, CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE '01' END AS ses, 'faces' AS task, (c_nationkey % 4 + 1)::INT AS run FROM customer)"
_PATH_SQL = "'BIDS/sub-' || printf('%02d', sub) || '/sub-' || printf('%02d', sub) || CASE WHEN ses <> '' THEN '_ses-' || ses ELSE '' END || '_task-' || task || '_run-' || printf('%02d', run)"
_FILES_SQL = f"files AS (SELECT {_PATH_SQL} || s AS path FROM runs, (VALUES ('_bold.nii.gz', 0), ('_bold.json', 1)) f(s, k) WHERE (sub + k) % 3 <> 0)"
_NEED_SQL = f"need AS (SELECT sub, ses, run, {_PATH_SQL} || s AS path FROM runs, (VALUES ('_bold.nii.gz'), ('_bold.json')) f(s))"


def _expected(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("c_nationkey")
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("sub"), F.when(n % 2 == 0, "").otherwise("01").alias("ses"), F.lit("faces").alias("task"), (n % 4 + 1).alias("run"))
    need = catalog.expected_files(runs, "preprocess_run")
    there = need.where((F.col("sub") + F.when(F.endswith("path", F.lit(".json")), 1).otherwise(0)) % 3 != 0).select("path")
    return need, there


@query(f"WITH {_RUNS_SQL}, {_FILES_SQL}, {_NEED_SQL} SELECT sub, run, bool_and(path IN (SELECT path FROM files)) AS available FROM need GROUP BY sub, run")
def runs_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.available(*_expected(spark, sf_dir), ["sub", "run"])


@query(f"WITH {_RUNS_SQL}, {_FILES_SQL}, {_NEED_SQL} SELECT sub, run, path FROM need WHERE path NOT IN (SELECT path FROM files)")
def files_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.missing(*_expected(spark, sf_dir)).select("sub", "run", "path")


@query(f"WITH {_RUNS_SQL}, {_FILES_SQL}, {_NEED_SQL} SELECT sub, run, path FROM need WHERE path IN (SELECT path FROM files)")
def files_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.present(*_expected(spark, sf_dir)).select("sub", "run", "path")


#: What the other processes need, a dog's run for odd participants; every fourth file is missing.
_OTHERS = {"get_mean_fct": ("preprocessing", "_reoriented.nii.gz"), "run_to_STD": ("preprocessing", "_mc.nii.gz"), "GLM": ("normalized", ".nii.gz")}
_OTHERS_SQL = (
    f"{_RUNS_SQL}, p(process, folder, suffix, k) AS (VALUES " + ", ".join(f"('{n}', '{f}', '{x}', {k})" for k, (n, (f, x)) in enumerate(_OTHERS.items())) + "), "
    "need AS (SELECT process, k, sub, run, 'emo/' || folder || '/' || kind || '-sub-' || printf('%02d', sub) || '/' || kind || '-sub-' || printf('%02d', sub) || CASE WHEN ses <> '' THEN '_ses-' || ses ELSE '' END || '_task-' || task || '_run-' || printf('%02d', run) || suffix AS path "
    "FROM (SELECT *, CASE WHEN sub % 2 = 0 THEN 'H' ELSE 'D' END AS kind FROM runs), p)"
)


@query(f"WITH {_OTHERS_SQL} SELECT process, sub, run, path, (sub + k) % 4 <> 0 AS available FROM need")
def processes_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, out = F.col("c_nationkey"), None
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("int").alias("sub"), F.when(n % 2 == 0, "").otherwise("01").alias("ses"), F.lit("faces").alias("task"), (n % 4 + 1).alias("run"))
    for k, process in enumerate(_OTHERS):
        need = catalog.expected_files(runs, process, "emo", F.when(F.col("sub") % 2 == 0, "H").otherwise("D"))
        found = catalog.available(need, need.where((F.col("sub") + k) % 4 != 0).select("path"), ["sub", "run", "path"]).withColumn("process", F.lit(process))
        out = found if out is None else out.unionByName(found)
    return out.select("process", "sub", "run", "path", "available")


@query(f"WITH {_RUNS_SQL}, {_FILES_SQL}, {_NEED_SQL} SELECT path, NULL::VARCHAR AS specie, sub, CASE WHEN ses = '' THEN NULL ELSE ses END AS session, 'faces' AS task, run, regexp_replace(path, '^.*_run-[0-9]+', '') AS suffix FROM need")
def file_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalogue(_expected(spark, sf_dir)[0].select("path"))


_JOB_STATUS = {"F": "Finished", "O": "Pending", "P": "Running"}


@query(
    "SELECT o_custkey AS \"Participant\", 'preprocess_run' AS \"Process\", CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'Running' END AS \"Status\", count(*) AS n "
    "FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' GROUP BY ALL"
)
def jobs_to_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.create_map(*[F.lit(x) for pair in _JOB_STATUS.items() for x in pair])
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sub_N"), F.lit("preprocess_run").alias("Process"), F.try_element_at(status, F.col("o_orderstatus")).alias("Status"))
    shown = catalog.schedule(catalog.unfinished(jobs), {"sub_N": "Participant", "Process": "Process", "Status": "Status"})
    return shown.groupBy(*shown.columns).agg(F.count("*").alias("n"))


_LINES_SQL = "lines AS (SELECT doc_id, (i - 1)::INT AS line_no, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"
_FIND = {"first": "the ", "second": " und ", "third": "@"}


@query(f"WITH {_LINES_SQL} SELECT doc_id, line_no, CASE WHEN contains(line, 'the ') THEN 'the  \"one\"' WHEN contains(line, ' und ') THEN ' und  \"two\"' WHEN contains(line, '@') THEN '@ \"three\"' ELSE line END AS line FROM lines")
def template_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    values = dict(zip(_FIND, ("one", "two", "three"), strict=True))
    filled = template.fill(lines.withColumn("line_no", F.struct("doc_id", "line_no")), template.rules(spark, _FIND, values))
    return filled.select("line_no.doc_id", "line_no.line_no", "line")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, printf('%g', value) AS shown FROM events")
def short_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), X.short_decimal(F.col("value")).alias("shown"))


@query("SELECT n_nationkey, n_name AS name, r_name AS region, 'Region ' || upper(substr(r_name, 1, 1)) AS lobe FROM nation JOIN region ON n_regionkey = r_regionkey")
def regions_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = atlas.clean_names(table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit(" "), "n_name", F.lit("  ")).alias("name"), F.col("n_regionkey").alias("index")), "name")
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("index"), F.col("r_name").alias("region"), F.concat(F.lit("Region "), F.upper(F.substring("r_name", 1, 1))).alias("lobe"))
    return atlas.region_of(labels, regions, "index").select("n_nationkey", "name", "region", "lobe")


@query("SELECT event_id, printf('%.2f', round_even(value, 2)) || chr(9) || printf('%.2f', 1.5::DOUBLE) || chr(9) || printf('%.2f', 1.0::DOUBLE) AS line FROM events")
def event_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("onset"), F.lit(1.5).alias("duration"), F.lit(1.0).alias("one"))
    return rows.select("event_id", events.event_lines(rows).alias("line"))


@query("SELECT event_type, file, count(*) AS n FROM (SELECT event_type, 0 AS file FROM events UNION ALL SELECT event_type, 1 FROM events WHERE value > 10) GROUP BY ALL")
def event_files_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "events").select("event_type", "value")
    return events.concatenate([one, one.where("value > 10")]).groupBy("event_type", "file").agg(F.count("*").alias("n"))


@query("SELECT n_name AS name, row_number() OVER (ORDER BY n_name) AS number FROM nation")
def names_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.numbered(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))


@query("SELECT c_custkey, 'Run ' || (c_nationkey % 4 + 1) || ' (Session ' || lpad((c_custkey % 3)::VARCHAR, 2, '0') || ')' AS label, (c_nationkey % 4 + 1)::INT AS run, lpad((c_custkey % 3)::VARCHAR, 2, '0') AS session FROM customer")
def run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = X.run_label(F.col("c_nationkey") % 4 + 1, X.zero_padded(F.col("c_custkey") % 3))
    rows = table(spark, sf_dir, "customer").select("c_custkey", label.alias("label"))
    return rows.select("c_custkey", "label", X.parse_run_label(F.col("label")).alias("p")).select("c_custkey", "label", "p.run", "p.session")


@query("SELECT p_partkey, p_size::VARCHAR AS size, p_brand AS brand FROM part")
def parameter_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("size="), F.col("p_size").cast("string"), F.lit("\nbrand = "), F.col("p_brand"), F.lit("\n"))
    rows = table(spark, sf_dir, "part").select("p_partkey", X.params(text).alias("p"))
    return rows.select("p_partkey", F.col("p")["size"].alias("size"), F.col("p")["brand"].alias("brand"))
