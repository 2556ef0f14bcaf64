import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.model import CHANNELS
from voxlake.operators import motion as M, quality, signal as S


def frame(spark, series: dict[int, np.ndarray]):
    rows = [(run, t, *map(float, x)) for run, m in series.items() for t, x in enumerate(m)]
    return spark.createDataFrame(rows, "run int, t long, " + ", ".join(f"{c} double" for c in CHANNELS))


def by_hand(m: np.ndarray, scale, detrend=True) -> np.ndarray:
    """Framewise displacement from residuals, as the definition has it."""
    m = m.copy()
    if detrend and len(m) > 1:
        t = np.arange(len(m))
        for k in range(m.shape[1]):
            m[:, k] -= np.polyval(np.polyfit(t, m[:, k], 1), t)
    return np.r_[0.0, np.abs(np.diff(m * scale, axis=0)).sum(1)]


@pytest.fixture(scope="module")
def runs():
    rng = np.random.default_rng(3)
    return {1: rng.normal(size=(40, 6)).cumsum(0) / 100, 2: rng.normal(size=(7, 6)), 3: np.ones((1, 6)), 4: np.outer(np.arange(5), np.ones(6)), 5: np.full((4, 6), 2.0), 6: rng.normal(size=(2, 6))}


@pytest.mark.parametrize("detrend", [True, False])
def test_framewise_displacement(spark, runs, detrend):
    scale = M.scales(55.0)
    got = M.framewise_displacement(frame(spark, runs), ["run"], scale=scale, detrend=detrend).orderBy("run", "t").collect()
    for run, m in runs.items():
        assert np.allclose([r.fd for r in got if r.run == run], by_hand(m, scale, detrend), atol=1e-10)


@pytest.mark.parametrize("block", [1, 3, 1000])
@pytest.mark.parametrize("detrend", [True, False])
def test_long_runs_in_blocks(spark, runs, block, detrend):
    a, b = (f(frame(spark, runs), ["run"], detrend=detrend, **how).orderBy("run", "t").toPandas() for f, how in ((M.framewise_displacement, {}), (M.long_run_displacement, {"block": block})))
    assert list(a.columns) == list(b.columns) and np.allclose(a.fd, b.fd)


def test_displacement_ignores_a_straight_line(spark, runs):
    moved = {k: m + 3.0 + 0.25 * np.arange(len(m))[:, None] for k, m in runs.items()}
    a, b = (M.framewise_displacement(frame(spark, r), ["run"]).orderBy("run", "t").toPandas().fd for r in (runs, moved))
    assert np.allclose(a, b)


def test_channels_and_scales_must_agree(spark, runs):
    with pytest.raises(ValueError):
        M.framewise_displacement(frame(spark, runs), ["run"], scale=(1.0,))


@pytest.mark.parametrize("keep", [True, False])
def test_linear_detrend(spark, runs, keep):
    got = M.detrend_linear(frame(spark, runs), ["run"], keep_mean=keep).orderBy("run", "t").toPandas()
    m, t = runs[1], np.arange(40)
    want = np.stack([m[:, k] - np.polyval(np.polyfit(t, m[:, k], 1), t) + keep * m[:, k].mean() for k in range(6)], axis=1)
    assert np.allclose(got[got.run == 1][list(CHANNELS)], want)


@pytest.mark.parametrize("degree", [0, 1, 2, 3])
@pytest.mark.parametrize("keep", [True, False])
def test_polynomial_detrend(spark, degree, keep):
    rng = np.random.default_rng(3)
    series = {1: rng.normal(size=(40, 6)).cumsum(0), 2: np.arange(60.0).reshape(10, 6) ** 2, 3: rng.normal(size=(1, 6)), 4: rng.normal(size=(2, 6)), 5: rng.normal(size=(3, 6)), 6: rng.normal(size=(300, 6)) + 1e4}
    series[1][[0, 7, 39], 2] = np.nan
    series[4][0, 1] = np.nan
    series[5][:, 0] = np.nan
    got = M.detrend_polynomial(frame(spark, series), ["run"], degree=degree, keep_mean=keep).orderBy("run", "t").toPandas()
    for run, m in series.items():
        mine = got[got.run == run][list(M.CHANNELS)].to_numpy()
        for k in range(6):
            y, known = m[:, k], ~np.isnan(m[:, k])
            want = np.full(len(y), np.nan)
            if known.any():
                place = np.arange(len(y)) - len(y) / 2
                fit = np.polynomial.Polynomial.fit(place[known], y[known], min(degree, known.sum() - 1))
                want = y - fit(place) + (y[known].mean() if keep else 0)
            assert np.allclose(mine[:, k], want, atol=1e-7, equal_nan=True)


def test_smooth_detrend_against_a_plain_version(spark):
    rng = np.random.default_rng(4)
    series = {1: rng.normal(size=(300, 6)).cumsum(0), 2: rng.normal(size=(60, 6)).cumsum(0), 3: rng.normal(size=(3, 6)), 4: rng.normal(size=(120, 6)).cumsum(0), 5: rng.normal(size=(8, 6))}
    series[2][:, 1] = 7.0
    got = M.detrend_smooth(frame(spark, series), ["run"], tr=2.0).orderBy("run", "t").toPandas()
    assert [M.smooth_window(n, 2.0) for n in (300, 120, 119, 60, 3, 2)] == [119, 119, 119, 59, 3, 1]
    for run, m in series.items():
        n = len(m)
        window = (120 if n >= 120 else n) - 1 if (120 if n >= 120 else n) % 2 == 0 else n
        for k, c in enumerate(M.CHANNELS):
            y, want = m[:, k], m[:, k]
            if window > 3:
                trend = np.zeros(n)
                for t in range(n):
                    start = min(max(0, t - window // 2), n - window)
                    place = np.arange(start, start + window) - t
                    trend[t] = np.polynomial.Polynomial.fit(place, y[start : start + window], 3)(0)
                left = y
                if np.ptp(trend) > 1e-9:
                    slope = ((trend - trend.mean()) * (y - y.mean())).sum() / ((trend - trend.mean()) ** 2).sum()
                    left = y - y.mean() - slope * (trend - trend.mean())
                want = left + y.mean()
            assert np.allclose(got[got.run == run][c], want, atol=1e-6)


def test_rms_is_that_of_the_residuals(spark, runs):
    got = {r.run: r for r in M.channel_rms(frame(spark, runs), ["run"], scale=M.scales(55.0)).collect()}
    m, t = runs[1], np.arange(40)
    res = m[:, 0] - np.polyval(np.polyfit(t, m[:, 0], 1), t)
    assert np.isclose(got[1].rms_rx, 55 * np.sqrt((res**2).mean()))
    assert got[3].rms_rx == 0


def test_masks_at_the_threshold(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.4), (1, 2, 0.6)], "run int, t long, fd double")
    rows = df.select(M.keep_mask("fd", 0.5).alias("k"), M.lost_mask("fd", 0.5).alias("l")).collect()
    assert [(r.k, r.l) for r in rows] == [(1, False), (1, False), (0, True)]
    out = df.agg(quality.clean_mean("fd", 0.5).alias("m"), quality.clean_mean("fd", 0.1).alias("none")).first()
    assert np.isclose(out.m, 0.4) and np.isnan(out.none)


def test_spikes(spark):
    df = spark.createDataFrame([(1, t, t in (1, 3)) for t in range(4)] + [(2, t, False) for t in range(2)] + [(3, 0, True)], "run int, t long, lost boolean")
    got = M.spike_regressors(df, ["run"]).orderBy("run", "t").collect()
    assert [r.spikes for r in got] == [[0, 0], [1, 0], [0, 0], [0, 1], [0], [0], [1]]


def test_motion_lines_round_like_c(spark):
    df = spark.createDataFrame([(0.0692015, -1e-9, 0.5, 1.0, 2.0, 3.0, 1)], ", ".join(f"{c} double" for c in CHANNELS) + ", mask int")
    assert df.select(M.motion_lines(df).alias("x")).first().x == "\t".join("%.6f" % v for v in (0.0692015, -1e-9, 0.5, 1.0, 2.0, 3.0, 1))


def signal_by_hand(m):
    mean, top = m.mean(0), np.abs(m).max(0)
    out = np.empty_like(m)
    for k in range(m.shape[1]):
        with np.errstate(invalid="ignore", divide="ignore"):
            out[:, k] = 100 * (m[:, k] + top[k]) / top[k] - 100 if mean[k] <= S.LOW_MEAN else 100 * m[:, k] / mean[k] - 100
    return np.nan_to_num(out, nan=0.0)


def test_percent_change_dvars_and_z(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(20, 5)) + [10, -3, 0.5, 0, 2]
    m[:, 3] = 0
    rows = [(1, t, v, float(m[t, v])) for t in range(20) for v in range(5)]
    psc = S.percent_change(spark.createDataFrame(rows, "run int, t long, voxel int, v double"))
    got = psc.orderBy("t", "voxel").toPandas().psc.to_numpy().reshape(20, 5)
    want = signal_by_hand(m)
    assert np.allclose(got, want)
    d = S.dvars(psc).orderBy("t").toPandas().dvars.to_numpy()
    assert np.allclose(d, np.sqrt((np.diff(want, axis=0, prepend=want[:1]) ** 2).mean(1)))
    assert np.allclose(S.global_change(psc).orderBy("t").toPandas().global_change, np.abs(want.mean(1)))
    z = S.z_scores(S.dvars(psc)).orderBy("t").toPandas().z.to_numpy()
    assert z[0] == 0 and np.allclose(z[1:], (d[1:] - d[1:].mean()) / d[1:].std(ddof=1))


def test_low_mean_sees_negative_means(spark):
    df = spark.createDataFrame([(1, 0, 0, -1.0), (1, 1, 0, -3.0)], "run int, t long, voxel int, v double")
    assert [r.psc for r in S.percent_change(df).orderBy("t").collect()] == pytest.approx([100 * 2 / 3 - 100, -100.0])


def test_means_of_runs_weigh_runs_alike(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 0, 1.0), (1, 1, 0, 0, 0, 3.0), (2, 0, 0, 0, 0, 10.0)], "run int, t long, x int, y int, z int, v double")
    assert S.mean_of_run_means(df).first().v == 6.0


def test_quality_counts_add_up(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(1, t, float(a), float(b)) for t, (a, b) in enumerate(rng.random((50, 2)))], "run int, t long, fd double, global_change double")
    q = quality.quality_table(df, ["run"], 0.5, 0.6).first()
    assert q.lostVolumes_fw_or_dvars + q.lostVolumes_fw_and_dvars == q.volumesLostAfter_fwd + q.volumesLostAfter_dvars
    assert q.totalVolumes == 50


def test_series_of_different_length_are_refused(spark):
    a = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.2)], "run int, t long, fd double")
    b = spark.createDataFrame([(1, 0, 0.1)], "run int, t long, global_change double")
    with pytest.raises(Exception, match="differ in length"):
        quality.join_frames(a, b, ["run"]).collect()
    assert quality.join_frames(a, a.withColumnRenamed("fd", "g"), ["run"]).count() == 2


def test_mask_choice(spark):
    df = spark.createDataFrame([(a, b) for a in (False, True) for b in (False, True)], "a boolean, b boolean")
    got = {w: [r[0] for r in df.select(quality.choose_mask(w, F.col("a"), F.col("b"))).collect()] for w in quality.CHOICES}
    assert got == {"fwd": [False, False, True, True], "dvars": [False, True, False, True], "or": [False, True, True, True], "and": [False, False, False, True]}
    with pytest.raises(ValueError):
        quality.choose_mask("xor", F.col("a"), F.col("b"))
