"""Designs, model fits and filters against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import courses as C, design as D, fit as L, smooth as G

TR = 2.0


def long_rows(spark, data, run=0):
    """(frames, voxels) as long rows."""
    rows = [(run, t, k, float(x)) for t, row in enumerate(data) for k, x in enumerate(row)]
    return spark.createDataFrame(rows, "run int, t long, voxel int, v double").repartition(3)


# designs


def plain_design(events, frames, response, steps, derivative=False):
    """The response summed over every place of the grid on which an event is on."""
    dt, out = TR / steps, np.zeros(frames)
    h = lambda j: response[j] if 0 <= j < len(response) else 0.0
    for onset, duration, one in events:
        i0 = math.floor(onset / dt + 0.5)
        for i in range(i0, max(i0 + 1, math.floor((onset + duration) / dt + 0.5))):
            for t in range(frames):
                j = t * steps - i
                out[t] += one * ((h(j + 1) - h(j - 1)) / (2 * dt) if derivative else h(j))
    return out


def test_design_columns_are_sums_over_the_grid(spark):
    steps, response = 10, D.double_gamma(TR, 10)
    given = {"a": [(0.0, 3.0, 1.0), (2.5, 10.0, 0.5), (31.0, 0.0, 2.0), (-6.0, 4.0, 1.0), (500.0, 5.0, 1.0)], "b": [(11.3, 1.0, -1.0)]}
    rows = [(1, k, *e) for k, events in given.items() for e in events] + [(1, "a", None, 1.0, 1.0), (1, "c", 1.0, 1.0, 1.0), (7, "a", 1.0, 1.0, 1.0)]
    events = spark.createDataFrame(rows, "run int, regressor string, onset double, duration double, one double")
    runs = spark.createDataFrame([(1, 40), (2, 3), (3, 0)], "run int, frames int")
    got = D.design_matrix(events, runs, TR, ["a", "b"], response, steps=steps, derivatives=True).orderBy("run", "t").collect()
    assert [(r.run, r.t) for r in got] == [(1, t) for t in range(40)] + [(2, t) for t in range(3)]
    for name, e in given.items():
        assert np.allclose([r[name] for r in got[:40]], plain_design(e, 40, response, steps), atol=1e-12)
        assert np.allclose([r[f"{name}_d"] for r in got[:40]], plain_design(e, 40, response, steps, True), atol=1e-12)
    assert all(r.a == r.b == r.a_d == 0 for r in got[40:])
    with pytest.raises(ValueError, match="one name"):
        D.design_matrix(events, runs, TR, [], response)


def test_responses():
    for h in (D.gamma_response(TR), D.double_gamma(TR)):
        assert sum(h) == pytest.approx(1) and h[0] == 0
    peak = np.argmax(D.double_gamma(TR)) * TR / 20
    assert 4.5 < peak < 5.5 and min(D.double_gamma(TR)) < 0 <= min(D.gamma_response(TR))


# fits


def made(frames=80, voxels=5, seed=0, noise=1.0):
    rng = np.random.default_rng(seed)
    x = np.c_[np.sin(np.arange(frames) / 5), rng.normal(size=frames), np.arange(frames) * 1e3]
    beta = rng.normal(size=(3, voxels))
    beta[2] /= 1e3
    return x, 1e6 + x @ beta + noise * rng.normal(size=(frames, voxels))


def design_of(spark, x, names, run=0):
    return spark.createDataFrame([(run, t, *map(float, row)) for t, row in enumerate(x)], f"run int, t long, {', '.join(f'{n} double' for n in names)}")


def plain_fit(x, y):
    """(intercept and betas, rss, dof, inverse of the columns' centred sums) by least squares of columns brought to one size."""
    size = np.abs(x - x.mean(0)).max(0)
    centred = (x - x.mean(0)) / size
    b, *_ = np.linalg.lstsq(centred, y - y.mean(), rcond=1e-10)
    rest = y - y.mean() - centred @ b
    return np.r_[y.mean() - x.mean(0) @ (b / size), b / size], float(rest @ rest), len(x) - 1 - np.linalg.matrix_rank(centred, tol=1e-8), np.linalg.pinv(centred.T @ centred) / np.outer(size, size)


NAMES = ["p", "q", "s"]


def test_fit_and_contrasts(spark):
    x, y = made()
    fitted = L.fit(long_rows(spark, y), design_of(spark, x, NAMES), NAMES)
    weights = {"p": (1.0, 0.0, 0.0), "p-q": (1.0, -1.0, 0.0), "drift": (0.0, 0.0, 1.0)}
    tests = {(r.voxel, r.contrast): r for r in L.contrasts(fitted, weights).collect()}
    for r in fitted.collect():
        b, rss, dof, inverse = plain_fit(x, y[:, r.voxel])
        assert [r.intercept, *r.beta] == pytest.approx(b.tolist(), rel=1e-6) and r.rss == pytest.approx(rss, rel=1e-6) and r.dof == dof == 76
        for name, c in weights.items():
            t = np.array(c) @ b[1:] / math.sqrt(rss / dof * (np.array(c) @ inverse @ np.array(c)))
            assert tests[r.voxel, name].t == pytest.approx(t, rel=1e-5) and tests[r.voxel, name].effect == pytest.approx(np.array(c) @ b[1:], rel=1e-6)


def test_fit_of_odd_courses(spark):
    x, y = made(20, 3)
    y[3, 1] = np.nan
    y[:, 2] = 5.0
    x[:, 1] = 2 * x[:, 0]  # can't be told apart
    design = design_of(spark, x, NAMES).where("t <> 7")  # a censored frame
    got = {r.voxel: r for r in L.fit(long_rows(spark, y), design, NAMES).collect()}
    keep = np.arange(20) != 7
    b, rss, dof, _ = plain_fit(x[keep], y[keep, 0])
    assert got[0].dof == dof == 16 and got[0].rss == pytest.approx(rss) and got[0].beta[0] + 2 * got[0].beta[1] == pytest.approx(b[1] + 2 * b[2])
    assert got[1].beta is None and got[1].rss is None and got[1].dof is None
    flat = L.contrasts(L.fit(long_rows(spark, y[:, 2:]), design, NAMES), {"p": (1, 0, 0)}).first()
    assert flat.effect == pytest.approx(0) and (flat.t is None or abs(flat.t) < 1e3)
    missing = {r.t: r for r in L.contrasts(L.fit(long_rows(spark, y[:, 1:2]), design, NAMES), {"p": (1, 0, 0)}).collect()}
    assert set(missing) == {None}
    assert L.fit(long_rows(spark, y).limit(0), design, NAMES).count() == 0


def test_z_of_t():
    # by integrating Student's density
    for t, dof in ((0.0, 5), (1.0, 3), (2.5, 10), (-2.5, 10), (6.0, 40), (0.3, 1)):
        u = np.linspace(abs(t), abs(t) + 4000, 4_000_001)
        density = np.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - 0.5 * math.log(dof * math.pi)) * (1 + u * u / dof) ** (-(dof + 1) / 2)
        tail = float(np.trapezoid(density, u)) + (density[-1] * u[-1] / dof)
        z = L.z_of(np.array([t]), np.array([float(dof)]))[0]
        assert 0.5 * math.erfc(abs(z) / math.sqrt(2)) == pytest.approx(tail, rel=1e-3) and np.sign(z) == np.sign(t)
    far = L.z_of(np.array([60.0, 200.0, 1e4]), np.array([100.0, 30.0, 500.0]))
    assert np.isfinite(far).all() and (np.diff(far) != 0).all() and (far > 8).all()
    assert L.z_of(np.array([3.0]), np.array([1e6]))[0] == pytest.approx(3.0, abs=1e-4)


def plain_prewhitened(x, y, order):
    full = np.c_[np.ones(len(x)), x]
    b, *_ = np.linalg.lstsq(full, y, rcond=None)
    e = y - full @ b
    a = [0.5 * (1 + math.cos(math.pi * k / (order + 1))) * float(e[k:] @ e[:-k]) / float(e @ e) for k in range(1, order + 1)]
    toeplitz = np.array([[1.0 if i == j else a[abs(i - j) - 1] for j in range(order)] for i in range(order)])
    c = np.linalg.solve(toeplitz, a)
    filtered = lambda v: v[order:] - sum(c[k] * v[order - 1 - k : len(v) - 1 - k] for k in range(order))
    fx, fy = np.apply_along_axis(filtered, 0, full), filtered(y)
    b, *_ = np.linalg.lstsq(fx, fy, rcond=None)
    return b, float(((fy - fx @ b) ** 2).sum()), np.linalg.inv(fx.T @ fx)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_prewhitened_fit(spark, order):
    x, y = made(120, 3, noise=0.0)
    rng = np.random.default_rng(5)
    for k in range(3):  # autoregressive noise
        e = rng.normal(size=120)
        for t in range(1, 120):
            e[t] += 0.6 * e[t - 1]
        y[:, k] += e
    x[:, 2] /= 1e3
    fitted = L.fit_prewhitened(long_rows(spark, y), design_of(spark, x, NAMES), NAMES, order=order)
    tests = {r.voxel: r for r in L.contrasts(fitted, {"p": (1.0, 0.0, 0.0)}).collect()}
    for r in fitted.collect():
        b, rss, inverse = plain_prewhitened(x, y[:, r.voxel], order)
        assert [r.intercept, *r.beta] == pytest.approx(b.tolist(), rel=1e-6, abs=1e-6) and r.rss == pytest.approx(rss, rel=1e-5) and r.dof == 120 - order - 4
        assert tests[r.voxel].t == pytest.approx(b[1] / math.sqrt(rss / r.dof * inverse[1, 1]), rel=1e-5)
    y[9, 0] = np.nan
    assert {r.voxel for r in L.fit_prewhitened(long_rows(spark, y), design_of(spark, x, NAMES), NAMES, order=order).collect()} == {1, 2}


# filters along time


def test_high_pass_is_a_running_line(spark):
    rng = np.random.default_rng(2)
    y = np.c_[rng.normal(size=50), np.arange(50.0) * 3 + 1e6, np.full(50, 7.0)]
    got = C.from_courses(C.high_pass(C.to_courses(long_rows(spark, y)), TR, cutoff=20.0))
    rows = {(r.voxel, r.t): r.v for r in got.collect()}
    sigma = 5.0
    for k in range(3):
        for t in range(50):
            at = np.arange(max(0, t - 15), min(50, t + 16))
            w = np.sqrt(np.exp(-0.5 * ((at - t) / sigma) ** 2))
            line = np.linalg.lstsq(np.c_[w, w * (at - t)], w * y[at, k], rcond=None)[0]
            assert rows[k, t] == pytest.approx(y[t, k] - line[0] + y[:, k].mean(), abs=1e-6)
    one = C.from_courses(C.high_pass(C.to_courses(long_rows(spark, y[:1])), TR)).collect()
    assert {r.v for r in one} == set(y[0])


def test_slow_waves_go_and_fast_ones_stay(spark):
    t = np.arange(300)
    y = np.c_[np.sin(2 * np.pi * t * TR / 600), np.sin(2 * np.pi * t * TR / 12)]
    rows = C.from_courses(C.high_pass(C.to_courses(long_rows(spark, y)), TR, cutoff=60.0)).groupBy("voxel").agg(F.stddev("v").alias("s")).collect()
    left = {r.voxel: r.s for r in rows}
    assert left[0] < 0.1 and left[1] > 0.68


def test_slice_timing_moves_a_sine(spark):
    t, period = np.arange(120), 11.0
    seconds = {0: 0.0, 1: 0.7, 2: 1.0, 3: 1.9}
    wave = lambda at: 5 + np.sin(2 * np.pi * at / period)
    data = np.c_[*[wave(t + s / TR) for s in seconds.values()], wave(t)]
    df = long_rows(spark, data).withColumn("seconds", F.element_at(F.create_map(*[F.lit(x) for kv in seconds.items() for x in kv]), F.col("voxel")))
    got = C.from_courses(C.slice_timing(C.to_courses(df, keep=["seconds"]), TR)).collect()
    for r in got:
        if r.voxel == 4:
            assert r.v == data[r.t, 4]  # no time: as it is
        elif 10 <= r.t < 110:
            assert r.v == pytest.approx(wave(r.t + 0.5), abs=0.01)


def test_courses_come_back(spark):
    df = spark.createDataFrame([(0, 3, 1, 1.5), (0, 1, 1, None), (0, 2, 2, 4.0)], "run int, t long, voxel int, v double")
    there = C.to_courses(df)
    assert {(r.voxel, tuple(r.frames)) for r in there.collect()} == {(1, (1, 3)), (2, (2,))}
    assert {(r.voxel, r.t) for r in C.from_courses(there).collect()} == {(1, 1), (1, 3), (2, 2)}


# smoothing


def plain_smooth(v, mask, sigma, reach):
    out = np.full(v.shape, np.nan)
    half = [math.ceil(reach * s) for s in sigma]
    for x, y, z in np.argwhere(mask):
        top = low = 0.0
        for i, j, k in np.argwhere(mask):
            d = (i - x, j - y, k - z)
            if all(abs(a) <= h for a, h in zip(d, half)):
                w = math.exp(-0.5 * sum((a / s) ** 2 for a, s in zip(d, sigma) if s))
                top, low = top + w * v[i, j, k], low + w
        out[x, y, z] = top / low
    return out


@pytest.mark.parametrize("block", [2, 3, 32])
def test_smoothing_in_blocks_and_rows(spark, block):
    rng = np.random.default_rng(1)
    v, mask, sigma = rng.normal(size=(7, 5, 4)), rng.random((7, 5, 4)) > 0.2, (1.2, 0.0, 0.7)
    rows = [(0, 0, *map(int, p), float(v[tuple(p)]), bool(mask[tuple(p)])) for p in np.argwhere(np.ones(v.shape))]
    df = spark.createDataFrame(rows, "image_id int, t int, x int, y int, z int, v double, m boolean").repartition(3)
    want = plain_smooth(v, mask, sigma, 2.0)
    got = {(r.x, r.y, r.z): r.v for r in G.smooth(df, sigma, mask="m", block=block, reach=2.0).collect()}
    assert set(got) == {tuple(map(int, p)) for p in np.argwhere(mask)} and all(x == pytest.approx(want[p]) for p, x in got.items())
    holes = [float(x) if m else float("nan") for x, m in zip(v.transpose(2, 1, 0).reshape(-1), mask.transpose(2, 1, 0).reshape(-1))]
    wide = spark.createDataFrame([(0, 0, (7, 5, 4), holes)], "image_id int, t int, dims struct<x:int,y:int,z:int>, voxels array<double>")
    out = np.array(G.smooth_wide(wide, sigma, 2.0).first().voxels).reshape(4, 5, 7).transpose(2, 1, 0)
    assert np.allclose(out, want, equal_nan=True)
    assert G.smooth(df.limit(0), sigma, block=block).count() == 0


def test_exchanges_do_not_grow_with_the_kernel(spark):
    df = spark.createDataFrame([(0, 0, 1, 1, 1, 1.0)], "image_id int, t int, x int, y int, z int, v double")
    count = lambda s: G.smooth(df, (s,) * 3)._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert count(0.5) == count(20.0) == 1
    assert G.sigma_of(2.3548200450309493, 2.0) == pytest.approx(0.5)
