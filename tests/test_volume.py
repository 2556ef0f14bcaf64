import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake import model
from voxlake.operators import resample as R, volume as V


def long_of(spark, a: np.ndarray, image: str = "a", t: int = 0):
    rows = [(image, t, int(x), int(y), int(z), float(a[x, y, z])) for x, y, z in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, "image_id string, t int, x int, y int, z int, v double")


def array_of(df, shape) -> np.ndarray:
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(out[r.x, r.y, r.z]), "a voxel came twice"
        out[r.x, r.y, r.z] = r.v
    return out


@pytest.fixture(scope="module")
def cube():
    return np.random.default_rng(1).normal(size=(3, 4, 2))


def test_long_and_wide(spark, cube):
    df = long_of(spark, cube)
    wide = model.to_wide(df)
    assert list(wide.first().voxels) == list(cube.ravel(order="F"))
    assert np.array_equal(array_of(model.to_long(wide), cube.shape), cube)
    one = long_of(spark, np.ones((1, 1, 1)))
    assert model.to_long(model.to_wide(one)).count() == 1
    with pytest.raises(Exception, match="lacks voxels"):
        model.to_wide(df.where("x + y > 0")).collect()


def test_crop_in_any_order_and_beyond_the_end(spark, cube):
    got = V.crop(long_of(spark, cube), {"x": (2, 1), "y": (1, 9)}, {"x": 3, "y": 4, "z": 2})
    assert np.array_equal(array_of(got, (2, 3, 2)), cube[1:3, 1:4])


def test_clip_undoes_pad(spark, cube):
    padded, origin = V.pad(long_of(spark, cube), {"L": 1, "A": 1, "S": 0}, cube.shape, background=7.0)
    assert origin == [3.0, 3.0, 2.0]
    a = array_of(padded, (4, 5, 2))
    assert np.array_equal(a, np.pad(cube, ((1, 0), (0, 1), (0, 0)), constant_values=7.0))
    clipped, back = V.clip(padded, {"L": 1, "A": 1}, (4, 5, 2), origin)
    assert np.array_equal(array_of(clipped, cube.shape), cube) and back == [2.0, 3.0, 2.0]


@pytest.mark.parametrize("side", list(V.SIDES))
def test_cutting_beyond_the_origin_is_refused(spark, cube, side):
    for count in (9, -1):
        with pytest.raises(ValueError):
            V.clip(long_of(spark, cube), {side: count}, cube.shape)
        with pytest.raises(ValueError):
            V.pad(long_of(spark, cube), {side: count}, cube.shape)


@pytest.mark.parametrize("combination", [["-x", "z", "-y"], ["y", "-z", "x"], ["x", "y", "z"], ["-x", "-y", "-z"]])
def test_reorient_and_back(spark, cube, combination):
    axes = V.signed_axes(combination)
    order = ["xyz".index(a) for a, _ in axes]
    want = np.transpose(cube, order)
    for k, (_, flipped) in enumerate(axes):
        want = np.flip(want, k) if flipped else want
    there = V.reorient(long_of(spark, cube), combination, cube.shape)
    assert np.array_equal(array_of(there, want.shape), want)
    assert np.array_equal(array_of(V.reorient(there, V.inverse_axes(combination), want.shape), cube.shape), cube)


def test_bad_combinations():
    with pytest.raises(ValueError):
        V.signed_axes(["x", "x", "y"])
    with pytest.raises(ValueError):
        V.from_orient_codes([1, 4, 2])
    assert V.from_orient_codes([4, 2, 3]) == ["-x", "y", "z"]


def test_masks(spark, cube):
    df = long_of(spark, cube)
    mask = df.where("x = 1").select("x", "y", "z", F.lit(1).alias("m"))
    got = array_of(V.apply_mask(df, mask), cube.shape)
    assert np.array_equal(got[1], cube[1]) and not got[[0, 2]].any()
    assert np.array_equal(array_of(V.threshold(df, 0.0), cube.shape), (cube >= 0) * 1.0)
    assert np.array_equal(array_of(V.threshold(df, 0.0, binary=False), cube.shape), np.where(cube >= 0, cube, 0))
    balls = spark.createDataFrame([(0, 0, 0, 1, 1, 0.0), (0, 0, 0, 0, 2, 0.5), (1, 0, 0, 1, 2, 0.0), (2, 0, 0, 1, 3, 0.5)], "x int, y int, z int, m int, nth int, thr double")
    assert sorted((r.x, r.m) for r in V.mask_union(balls, thr="thr").collect()) == [(0, 1), (2, 1)]


def test_overlap(spark):
    a = spark.createDataFrame([(0, 0, 0, 1), (1, 0, 0, 2)], "x int, y int, z int, label int")
    b = spark.createDataFrame([(0, 0, 0, 1), (1, 0, 0, 0)], "x int, y int, z int, label int")
    V.check_no_overlap(a, b)
    with pytest.raises(ValueError, match="overlap"):
        V.check_no_overlap(a, b.withColumn("label", F.lit(5)))


def test_histograms(spark, cube):
    df = long_of(spark, cube)
    counts = {r.bin: r.n for r in V.histogram(df).collect()}
    want = np.histogram(cube, 10)[0]
    assert [counts.get(k, 0) for k in range(10)] == list(want)
    whole = long_of(spark, np.arange(8.0).reshape(2, 2, 2) // 3)
    assert {r.bin: r.n for r in V.histogram(whole, bins=None).collect()} == {0: 3, 1: 3, 2: 2}
    flat = V.equalise(df).agg(F.max("v").alias("m")).first()
    assert flat.m == 1.0
    assert {(r.glmin, r.glmax) for r in V.value_range(df, whole=True).collect()} == {(float(R.half_away(cube.min())), float(R.half_away(cube.max())))}


def test_merge_patch_and_names(spark, cube):
    df = long_of(spark, cube)
    merged = V.concatenate([(df, 2), (V.slice_at(df, "z", 0), 1)], "z")
    assert np.array_equal(array_of(merged, (3, 4, 3)), np.concatenate([cube, cube[:, :, :1]], axis=2))
    patch = V.slice_at(df, "z", 1).withColumn("v", F.lit(0.0))
    got = array_of(V.replace_slices(df, patch), cube.shape)
    assert not got[:, :, 1].any() and np.array_equal(got[:, :, 0], cube[:, :, 0])
    named = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("b", 3.0)], "path string, v double")
    assert sorted((r.path, r.t) for r in V.frames_by_name(named).collect()) == [("a", 0), ("b", 1), ("b", 1)]
    assert V.first_volume(df).count() == 24


def plain_trilinear(a, places, bg):
    """Voxel by voxel, from 1-based places."""
    out = np.empty(len(places))
    for n, p in enumerate(places):
        if any(c <= 1 - R.EDGE or c >= d + R.EDGE for c, d in zip(p, a.shape)):
            out[n] = bg
            continue
        total = 0.0
        for corner in np.ndindex(2, 2, 2):
            weight, at = 1.0, []
            for c, up, d in zip(p, corner, a.shape):
                f = np.floor(c)
                weight *= (c - f) if up else 1 - (c - f)
                at.append(int(1 if f < 1 else d if f > d - 1 else f + up) - 1)
            total += weight * a[tuple(at)]
        out[n] = total
    return out


MATRIX = np.array([[1.1, -0.2, 0, -1.3], [0.3, 0.9, 0.1, 0.4], [0, 0.1, 1.4, 2], [0, 0, 0, 1]])


def test_identity_resampling(spark, cube):
    grid = R.output_grid(cube.shape, np.eye(4))
    assert grid.dims == cube.shape
    for method in R.METHODS.values():
        if method is not R.along_lines:
            assert np.allclose(array_of(method(long_of(spark, cube), grid, cube.shape), cube.shape), cube)


@pytest.mark.parametrize("size", [(1.0,), (0.7, 0.8, 0.9)])
def test_resampling_by_hand(spark, cube, size):
    df, grid = long_of(spark, cube), R.output_grid(cube.shape, MATRIX, size)
    at = np.array(list(np.ndindex(grid.dims)), float)
    places = np.c_[at, np.ones(len(at))] @ grid.to_old[:3].T + 1
    bg = (cube[0, 0, 0] + cube[-1, -1, -1]) / 2
    assert np.allclose(array_of(R.trilinear(df, grid, cube.shape), grid.dims).ravel(), plain_trilinear(cube, places, bg))
    near = R.half_away(places).astype(int)
    inside = ((near >= 1) & (near <= cube.shape)).all(1)
    want = np.full(len(at), -5.0)
    want[inside] = cube[tuple((near[inside] - 1).T)]
    assert np.allclose(array_of(R.nearest(df, grid, cube.shape, bg=-5.0), grid.dims).ravel(), want)


@pytest.mark.parametrize("method,bg", [(1, None), (2, None), (1, -5.0), (2, -5.0)])
def test_arrays_and_joins_agree(spark, cube, method, bg):
    df, grid = long_of(spark, cube), R.output_grid(cube.shape, MATRIX, (0.7, 0.8, 0.9))
    wide = R.on_arrays(model.to_wide(df), grid, cube.shape, method, bg)
    a, b = array_of(model.to_long(wide), grid.dims), array_of(R.METHODS[method](df, grid, cube.shape, bg=bg), grid.dims)
    assert np.allclose(a, b)
    assert tuple(wide.first().dims) == grid.dims
    with pytest.raises(ValueError):
        R.on_arrays(wide, grid, cube.shape, 3)


def line_by_steps(p1, p2):
    """The line by the step-by-step rule: an axis moves when its error reaches half a step of the longest one."""
    d = np.subtract(p2, p1)
    n, at, out = int(np.abs(d).max()), np.array(p1), [tuple(int(v) for v in p1)]
    error = 2 * np.abs(d) - n
    for _ in range(n):
        move = error >= 0
        at = at + np.sign(d) * move
        error = error + 2 * np.abs(d) - 2 * n * move
        out.append(tuple(int(v) for v in at))
    return out


def test_lines_in_closed_form():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = rng.integers(-9, 10, 3), rng.integers(-9, 10, 3)
        assert R.digital_line(a, b) == line_by_steps(a, b)


def test_reading_along_lines(spark, cube):
    grid = R.output_grid(cube.shape, MATRIX)
    got = array_of(R.along_lines(long_of(spark, cube), grid, cube.shape, bg=-5.0), grid.dims)
    m, nx = grid.to_old, grid.dims[0]
    for y, z in np.ndindex(grid.dims[1:]):
        ends = [R.half_away(m[:3] @ [x, y, z, 1] + 1).astype(int) for x in (-1, nx - 1)]
        line = R.digital_line(*ends)
        for x in range(nx):
            p = np.array(line[min(max(int(R.half_away((x + 1) * len(line) / nx)), 1), len(line)) - 1])
            want = cube[tuple(p - 1)] if ((p >= 1) & (p <= cube.shape)).all() else -5.0
            assert got[x, y, z] == want


def test_reslice_defaults(spark, cube):
    df = long_of(spark, cube).unionByName(long_of(spark, cube + 1, t=1))
    out, grid = R.reslice(df, cube.shape, np.diag([2.0, 2.0, 3.0, 1.0]), (2.0, 2.0, 3.0))
    assert grid.matrix[0, 0] == 2.0 and out.schema["v"].dataType.simpleString() == "float"
    assert out.count() == 2 * int(np.prod(grid.dims))
    with pytest.raises(ValueError):
        R.output_grid(cube.shape, np.eye(3))


def test_scaled_map_takes_new_voxels_to_old():
    m = R.scaled_map(np.eye(4), (2, 2, 2), (1, 1, 1))
    assert np.allclose(m @ [4, 2, 0, 1], [2, 1, 0, 1])


def test_padding_generates_each_border_voxel_once(spark):
    cube = np.arange(336.0).reshape(6, 7, 8)
    df, origin = long_of(spark, cube), [3.0, 4.0, 4.0]
    padded, _ = V.pad(df, {"L": 2, "R": 1, "P": 0, "A": 3, "I": 1, "S": 2}, cube.shape, origin, background=-1.0)
    rows = padded.collect()
    assert len(rows) == len({(r.x, r.y, r.z) for r in rows}) == (6 + 3) * (7 + 3) * (8 + 3)
    assert sum(r.v == -1.0 for r in rows) == len(rows) - 336
    assert V.pad(df, {}, cube.shape, origin)[0].count() == 336


def test_trilinear_sends_no_row_to_each_of_its_eight_reads(spark):
    """Input voxels meet a table of reads by their places alone; a volume isn't shuffled for a join."""
    df = spark.range(64).selectExpr("id as image_id", "0 as t", "cast(id % 4 as int) as x", "cast(id div 4 % 4 as int) as y", "cast(id div 16 as int) as z", "cast(id as double) as v")
    plan = R.trilinear(df, R.output_grid((4, 4, 4), np.eye(4), (0.8, 0.8, 0.8)), (4, 4, 4), bg=0.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "lambdafunction" not in plan
