"""Alignment, registration and regions against known maps and plain versions."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxlake.functions import spatial as S
from voxlake.model import CHANNELS
from voxlake.operators import align as A, motion as M, region as G, register as R
from voxlake.plans.queries import QUERIES

from .oracle import DATA


def field(places, centres, heights, width):
    return sum(h * np.exp(-((places - c[:, None]) ** 2).sum(0) / (2 * width**2)) for h, c in zip(heights, centres, strict=True))


def hills(n, seed=1, low=-1.0):
    rng = np.random.default_rng(seed)
    return rng.uniform(1, n - 2, (30, 3)), rng.uniform(low, 1, 30)


def wide(spark, rows, extra="run int, t int"):
    return spark.createDataFrame([(*keys, tuple(v.shape[::-1]), v.reshape(-1).tolist()) for *keys, v in rows], f"{extra}, dims struct<x:int,y:int,z:int>, voxels array<double>")


# maps and interpolation


def test_maps_and_their_inverses():
    middle = np.array([3.0, 4.0, 5.0])
    m = S.affine([0.1, -0.2, 0.3, 1.0, 2.0, -3.0], middle, (2.0, 1.0, 0.5))
    assert S.at(m, middle[:, None])[:, 0] == pytest.approx(middle + [0.5, 2.0, -6.0])
    assert np.allclose(S.rotation([0, 0, np.pi / 2]) @ [1, 0, 0], [0, 1, 0]) and np.linalg.det(S.rotation([0.3, 1.0, -2.0])) == pytest.approx(1)
    assert np.allclose(S.affine([], middle), np.eye(4))
    assert np.linalg.det(S.affine(np.r_[np.zeros(6), 0.1, 0.2, 0.3, 0.4, 0.5, 0.6], middle)[:3, :3]) == pytest.approx(np.exp(0.6))


@pytest.mark.parametrize("read", [S.linear, S.cubic])
def test_interpolation(read):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(4, 5, 6))
    assert np.allclose(read(v, S.grid(v.shape)), v.reshape(-1))
    z, y, x = np.indices(v.shape)
    places = rng.uniform(1, 2, (3, 50))
    assert np.allclose(read(2.0 * x - y + 3 * z, places), 2 * places[0] - places[1] + 3 * places[2])
    assert read(v, np.array([[-5.0], [0.0], [0.0]]))[0] == pytest.approx(v[0, 0, 0])


def test_halved():
    v = np.arange(24.0).reshape(2, 3, 4)
    assert S.halved(v).shape == (1, 2, 2) and S.halved(v)[0, 0, 0] == v[:2, :2, :2].mean() and S.halved(v)[0, 1, 1] == v[:, 2:, 2:].mean()


# rigid alignment


def test_known_motion_is_recovered_within_a_hundredth_of_a_voxel(spark):
    n, (centres, heights) = 20, hills(20)
    places, middle = S.grid((n,) * 3), S.centre((n,) * 3)
    rng = np.random.default_rng(4)
    moves, size = [np.zeros(6), *(np.r_[rng.uniform(-0.04, 0.04, 3), rng.uniform(-0.7, 0.7, 3)] for _ in range(4))], (1.0, 1.0, 2.0)
    rows = [(0, t, field(S.at(np.linalg.inv(S.affine(p, middle, size)), places), centres, heights, 3.0).reshape((n,) * 3)) for t, p in enumerate(moves)]
    frames = wide(spark, rows)
    got = A.align_frames(frames, A.base_volumes(frames, "first"), size)
    found = {r.t: [r[c] for c in CHANNELS] for r in got.collect()}
    away = np.abs([np.array(found[t]) - p for t, p in enumerate(moves)])
    assert (away[:, 3:] / size).max() < 0.01 and away[:, :3].max() < 0.002
    # the table is what displacement reads
    fd = M.framewise_displacement(got, ["run"], detrend=False).orderBy("t").collect()
    assert fd[1].fd == pytest.approx(np.abs(moves[1]) @ M.scales(), abs=0.5)


def test_frames_that_show_nothing_stay(spark):
    v = np.random.default_rng(0).normal(size=(4, 4, 4))
    frames = wide(spark, [(0, 0, v), (0, 1, np.zeros((4, 4, 4))), (0, 5, np.full((4, 4, 4), np.nan)), (3, 2, np.ones((1, 1, 1)))])
    rows = {(r.run, r.t): r for r in A.align_frames(frames, A.base_volumes(frames)).collect()}
    assert len(rows) == 4 and all(np.isfinite(r[c]) for r in rows.values() for c in CHANNELS) and rows[3, 2].error == 0
    assert {r.run: r.voxels[0] for r in A.base_volumes(frames.where("t < 5"), "middle").collect()}.keys() == {0, 3}
    with pytest.raises(Exception, match="has a base of"):
        A.align_frames(frames, wide(spark, [(0, 0, np.ones((2, 2, 2)))]).drop("t")).collect()


# registration


def test_correlation_ratio():
    rng = np.random.default_rng(0)
    bins, v = rng.integers(0, 5, 200), rng.normal(size=200)
    left = sum(((v[bins == b] - v[bins == b].mean()) ** 2).sum() for b in range(5))
    assert R.correlation_ratio(bins, v) == pytest.approx(left / ((v - v.mean()) ** 2).sum())
    assert R.correlation_ratio(bins, bins * 2.0) == pytest.approx(0) and R.correlation_ratio(bins, np.ones(200)) == 1 == R.correlation_ratio(bins[:1], v[:1])


@pytest.mark.parametrize("dof, degrees", [(6, 30.0), (12, 15.0)])
def test_a_known_map_is_recovered(spark, dof, degrees):
    n, (centres, heights) = 16, hills(16, 2, 0.3)
    places, middle = S.grid((n,) * 3), S.centre((n,) * 3)
    true = np.array([0.25, -0.1, 0.2, 1.2, -0.8, 0.5, 0.06, -0.05, 0.04, 0.05, -0.03, 0.04])
    true[dof:] = 0
    to = S.affine(true, middle)
    fixed = field(places, centres, heights, 2.5)
    # another contrast: the ratio needs no like values
    moving = np.sqrt(field(S.at(np.linalg.inv(to), places), centres, heights, 2.5))
    pairs = R.volume_pairs(wide(spark, [(1, fixed.reshape((n,) * 3))], "run int"), wide(spark, [(1, moving.reshape((n,) * 3))], "run int"), ["run"])
    found = R.register(pairs, ["run"], dof=dof, degrees=degrees).first()
    core = np.array([p for p in itertools.product((4.0, 11.0), repeat=3)]).T
    away = np.abs(S.at(np.array(found.matrix).reshape(4, 4), core) - S.at(to, core)).max()
    assert away < (0.1 if dof == 6 else 0.35) and found.cost <= R.cost_of(to, R.binned(fixed), places, moving.reshape((n,) * 3)) + 0.002


def test_candidates_in_chunks_and_ranges(spark):
    rng = np.random.default_rng(3)
    volumes = [(k, rng.normal(size=(3, 4, 5))) for k in range(2)]
    fixed, moving = wide(spark, volumes, "run int"), wide(spark, [(k, v[:, ::-1].copy()) for k, v in volumes], "run int")
    every = [(0.0, 0.0, a / 10, float(x)) for a in range(4) for x in (-1, 0, 1)]
    pairs = R.volume_pairs(fixed, moving, ["run"])
    one, many = ({(r.run, r.candidate): (tuple(r.params), r.cost) for r in R.candidate_costs(pairs, every, ["run"], chunk=c).collect()} for c in (100, 5))
    assert one == many and set(one) == {(k, c) for k in range(2) for c in range(len(every))}
    for k, v in volumes:
        assert one[k, 7][1] == pytest.approx(R.cost_of(S.affine(every[7], S.centre(v.shape)), R.binned(v), S.grid(v.shape), v[:, ::-1]))
    costs = R.candidate_costs(pairs, every, ["run"]).withColumns({"turn": F.col("params")[2], "shift": F.col("params")[3]})
    best = {r.run: r for r in R.best_candidates(costs, ["run"]).collect()}
    rows = R.best_in_ranges(costs, ["turn", "shift"], ["run"]).collect()
    assert len(rows) == 2 * 6 * 3
    for r in rows:
        inside = [(c, k) for (run, k), (p, c) in one.items() if run == r.run and r.turn_min <= p[2] <= r.turn_max and r.shift_min <= p[3] <= r.shift_max]
        assert (r.cost, r.candidate) == min(inside)
        if (r.turn_min, r.turn_max, r.shift_min, r.shift_max) == (0.0, 0.3, -1.0, 1.0):
            assert r.candidate == best[r.run].candidate


# regions


def flood(seen, start):
    found, open_ = set(), [start] if start in seen else []
    while open_:
        p = open_.pop()
        if p in found:
            continue
        found.add(p)
        open_ += [q for a in range(3) for d in (1, -1) if (q := tuple(x + d * (i == a) for i, x in enumerate(p))) in seen]
    return found


@pytest.mark.parametrize("block", [2, 5, 32])
def test_regions_equal_a_flood_fill(spark, block):
    rng = np.random.default_rng(block)
    v = rng.random((11, 9, 7))
    v[:, 4, 3] = 2.0  # a rod through many blocks
    rows = [(i, *map(int, p), float(v[tuple(p)]) if i else float(-v[tuple(p)])) for i in (0, 1) for p in np.argwhere(np.ones(v.shape))]
    df = spark.createDataFrame(rows, "image_id int, x int, y int, z int, v double").repartition(4)
    centres = [(1, 1, 0, 4, 3, 0.25), (1, 2, 10, 8, 6, 0.2), (1, 3, 0, 0, 0, 1.0), (0, 1, 0, 4, 3, 0.3), (5, 1, 0, 0, 0, 0.5)]
    got: dict = {}
    for r in G.grow(df, spark.createDataFrame(centres, "image_id int, nth int, x int, y int, z int, thr double"), block=block).collect():
        got.setdefault((r.image_id, r.nth), set()).add((r.x, r.y, r.z))
    for i, nth, *at, thr in centres:
        w = v if i else -v
        least = w.min() + thr * (w.max() - w.min())
        want = flood({tuple(map(int, p)) for p in np.argwhere(w >= least)}, tuple(at)) if i < 5 else set()
        assert got.get((i, nth), set()) == want


def test_long_regions_and_empty_ones(spark):
    # a snake through a plane of blocks, and voxels that only touch at corners
    snake = [(x, y, 0) for y in range(0, 12, 2) for x in range(12)] + [(11 if y % 4 == 1 else 0, y, 0) for y in range(1, 11, 2)]
    apart = [(20, 20, 20), (21, 21, 20)]
    df = spark.createDataFrame([(0, *p) for p in snake + apart + snake[:3]], "image_id int, x int, y int, z int")
    rows = G.label_regions(df, block=3).collect()
    assert len(rows) == len(set(snake)) + 2 and len({r.region for r in rows}) == 3
    assert G.label_regions(df.limit(0)).count() == 0


def test_pieces_of_a_block():
    rng = np.random.default_rng(0)
    for _ in range(20):
        seen = rng.random((6, 5, 4)) < 0.5
        got, left = G.pieces(seen), {tuple(map(int, p)) for p in np.argwhere(seen)}
        assert (got > 0).sum() == len(left) and (got[~seen] == 0).all()
        for p in list(left):
            assert {q for q in left if got[q] == got[p]} == flood(left, p)


def test_volumes_are_never_broadcast(spark, tmp_path):
    """Spark takes an array for a few bytes: frames of 8 kB each passed for a small table."""
    at, old = str(tmp_path / "frames"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.range(40).selectExpr("id div 2 as run", "cast(id % 2 as int) as t", "named_struct('x', 10, 'y', 10, 'z', 10) as dims", "transform(sequence(1, 1000), i -> cast(i + id as double)) as voxels").write.parquet(at)
    frames = spark.read.parquet(at)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        for df in (A.align_frames(frames, A.base_volumes(frames, "first")), R.volume_pairs(frames.where("t = 0"), frames.where("t = 1"), ["run"])):
            lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
            depth = [len(line) - len(line.lstrip(" :+-*")) for line in lines]
            for k in [k for k, line in enumerate(lines) if "BroadcastExchange" in line]:
                below = itertools.takewhile(lambda j, k=k: depth[j] > depth[k], range(k + 1, len(lines)))
                assert not [lines[j] for j in below if "voxels" in lines[j]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_sweep_costs_each_candidate_once(spark):
    volumes = [(k, np.random.default_rng(k).normal(size=(3, 3, 3))) for k in range(2)]
    both = wide(spark, volumes, "run int")
    costs = R.candidate_costs(R.volume_pairs(both, both, ["run"]), [(0.0, 0.0, 0.0, float(x)) for x in (-1, 0, 1)], ["run"]).withColumn("shift", F.col("params")[3])
    plan = R.best_in_ranges(costs, ["shift"], ["run"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_cells_read_what_linear_reads():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(4, 6, 5))
    at = rng.uniform(0, 1, (3, 500)) * np.array([[4.0], [5.0], [3.0]])
    at = np.concatenate([at, S.grid(v.shape), S.grid(v.shape) * (1 + 1e-7), -1e-7 * np.ones((3, 1))], axis=1)
    at = at[:, S.inside(v.shape, at)]
    assert at.shape[1] > 600 and np.allclose(S.in_cells(S.cells(v), v.shape, at), S.linear(v, at), atol=1e-12)


def test_no_step_is_taken_back():
    seen = []

    def cost(p):
        seen.append(float(p[0]))
        return (p[0] - 3.0) ** 2

    p, _ = R._descend(np.zeros(12), np.ones(12), np.ones(12), cost, 1)
    # forth to 3 and one too far, then nothing helps on either side
    assert p[0] == 3.0 and seen == [0.0, 1.0, 2.0, 3.0, 4.0, 4.0, 2.0]


def test_register_tells_the_cost_of_not_moving(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(6, 6, 6))
    rows = [(0, 0, {"x": 6, "y": 6, "z": 6}, v.reshape(-1).tolist())]
    wide = spark.createDataFrame(rows, "image_id long, t int, dims struct<x:int,y:int,z:int>, voxels array<double>")
    found = R.register(R.volume_pairs(wide, wide, ["image_id"]), ["image_id"], dof=3, degrees=0.0, levels=0, bins=6).first()
    assert found.still == pytest.approx(R.cost_of(np.eye(4), R.binned(v, 6), S.grid(v.shape), v)) and found.cost <= found.still


def test_pieces_of_many_blocks_at_once():
    seen = np.random.default_rng(8).random((40, 3, 4, 2)) < 0.5
    assert (G.pieces(seen) == np.stack([G.pieces(one) for one in seen])).all()


def test_small_blocks_are_numbered_together(spark, monkeypatch):
    at = list(itertools.product(range(4), repeat=4))
    df = spark.createDataFrame([p for p in at if sum(p) % 3], "image_id int, x int, y int, z int")
    few, calls = G.label_regions(df.repartition(1), block=2).collect(), []
    monkeypatch.setattr(G, "VOXELS_AT_ONCE", 24)
    assert sorted(few) == sorted(G.label_regions(df, block=2).collect())
    number = G.pieces
    monkeypatch.setattr(G, "map_whole_groups", lambda rows, by, change, schema: calls.append(change) or rows.withColumn("piece", F.lit(1).cast("long")))
    monkeypatch.setattr(G, "VOXELS_AT_ONCE", 65_536)
    G.label_regions(df, block=2)
    rows = pa.RecordBatch.from_pydict({"image_id": [0] * 4, "x": [0, 1, 2, 3], "y": [0] * 4, "z": [0] * 4, "bx": [0, 0, 1, 1], "by_": [0] * 4, "bz": [0] * 4})
    counted = []
    monkeypatch.setattr(G, "pieces", lambda seen: counted.append(len(seen)) or number(seen))
    assert calls[0](rows, np.array([0, 0, 1, 1]))[-1].to_pylist() == [1, 1, 1, 1] and counted == [2]


@pytest.mark.parametrize("dof", [3, 6, 9, 12])
def test_slopes_of_maps_and_of_reads(dof):
    rng = np.random.default_rng(dof)
    p, size, middle, e = rng.normal(0, 0.1, 12), np.array([1.0, 2.0, 0.5]), np.array([2.0, 3.0, 1.0]), 1e-6
    p[dof:] = 0
    off, slopes = rng.normal(size=(3, 20)), S.affine_slopes(p, dof, size)
    assert slopes.shape == (dof, 3, 4)
    for k in range(dof):
        step = np.eye(12)[k] * e
        change = (S.at(S.affine(p + step, middle, size), off + middle[:, None]) - S.at(S.affine(p - step, middle, size), off + middle[:, None])) / (2 * e)
        assert np.allclose(slopes[k, :, :3] @ off + slopes[k, :, 3:], change, atol=1e-7)
    v = rng.normal(size=(4, 6, 5))
    at = rng.uniform(0.01, 0.99, (3, 50)) + rng.integers(0, 3, (3, 50))
    values, along = S.slopes_in_cells(S.cells(v), v.shape, at)
    assert np.allclose(values, S.linear(v, at))
    for a in range(3):
        step = np.eye(3)[:, a : a + 1] * e
        assert np.allclose(along[a], (S.linear(v, at + step) - S.linear(v, at - step)) / (2 * e), atol=1e-6)


def test_slopes_of_the_cost():
    n, (centres, heights) = 10, hills(10)
    places, size, e = S.grid((n,) * 3), np.ones(3), 1e-6
    v = field(places, centres, heights, 2.0).reshape((n,) * 3)
    bins, moving = R.binned(v, 8), np.exp(-v)
    order, corners, p = np.argsort(bins, kind="stable"), S.cells(moving), np.r_[0.011, -0.007, 0.013, 0.21, -0.13, 0.17, 0.012, -0.014, 0.009, 0.006, 0.004, -0.008]
    cost = lambda p: R.cost_of(S.affine(p, S.centre(v.shape), size), bins, places, moving)
    now, gradient, curve = R._slopes(p, 12, size, bins[order], places[:, order], (v.shape, moving.shape), corners)
    values = S.linear(moving, (at := S.at(S.affine(p, S.centre(v.shape), size), places))[:, S.inside(moving.shape, at)])
    total = ((values - values.mean()) ** 2).sum()
    assert now == pytest.approx(cost(p)) and curve.shape == (12, 12)
    assert [2 * g / total for g in gradient] == pytest.approx([(cost(p + s) - cost(p - s)) / (2 * e) for s in np.eye(12) * e], rel=1e-4, abs=1e-6)
    # nothing overlaps, or nothing varies
    assert R._slopes(np.r_[np.zeros(3), 50.0, np.zeros(8)], 6, size, bins[order], places[:, order], (v.shape, v.shape), corners) == (1.0, None, None)
    assert R._slopes(np.zeros(12), 6, size, bins[order], places[:, order], (v.shape, v.shape), np.ones_like(corners)) == (1.0, None, None)


def test_a_search_reads_the_volume_few_times(monkeypatch):
    n, (centres, heights) = 10, hills(10)
    places, true = S.grid((n,) * 3), np.r_[np.zeros(3), 0.6, -0.4, np.zeros(7)]
    fixed, moving = (field(S.at(np.linalg.inv(S.affine(p, S.centre((n,) * 3))), places), centres, heights, 2.0).reshape((n,) * 3) for p in (np.zeros(12), true))
    reads, read = [], S._in_cells
    monkeypatch.setattr(S, "_in_cells", lambda *a: reads.append(1) or read(*a))
    size, bins = np.ones(3), 31
    p, cost = R.search(fixed, np.exp(-moving), size, 6, 0.0, 15.0, 0, bins)
    n_reads = len(reads)
    assert n_reads <= 100 and np.abs(p[:3]).max() < 0.03 and np.abs(p - true)[3:6].max() < 0.1
    # neither a wide step nor a small one in any number helps
    for least in (np.r_[np.full(3, 0.01), np.full(3, 0.05)] / 4, np.r_[np.full(3, np.radians(3.75)), np.full(3, 0.5)]):
        for k, sign in itertools.product(range(6), (1, -1)):
            q = p + np.eye(12)[k] * sign * least[k]
            assert R.cost_of(S.affine(q, S.centre(fixed.shape), size), R.binned(fixed, bins), places, np.exp(-moving)) >= cost - 1e-9


def _lines(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


@pytest.mark.parametrize("name", ["frames_aligned", "registration_found"])
def test_volumes_of_stand_ins_are_made_after_all_exchanges(spark, name):
    if not DATA.exists():
        pytest.skip("the driver's tables aren't here")
    lines = _lines(QUERIES[name](spark, str(DATA)))
    made, exchanged = ([k for k, line in enumerate(lines) if word in line] for word in ("MapInArrow", "Exchange"))
    assert len(made) == 2 and exchanged and max(made) < min(exchanged)


def test_a_frame_is_exchanged_once_to_be_aligned(spark, tmp_path):
    at = str(tmp_path / "frames")
    spark.range(40).selectExpr("id div 2 as run", "cast(id % 2 as int) as t", "named_struct('x', 2, 'y', 2, 'z', 2) as dims", "transform(sequence(1, 8), i -> cast(i + id as double)) as voxels").write.parquet(at)
    frames = spark.read.parquet(at)
    base = frames.where("t = 0").drop("t")
    # none between the join and the steps, where each frame would take its base along
    names = [line.lstrip(" :+-*0123456789()") for line in _lines(A.align_frames(frames, base))]
    assert next(k for k, line in enumerate(names) if "Join" in line) < next(k for k, line in enumerate(names) if line.startswith("Exchange"))


def test_a_long_run_is_dealt_in_shares(spark, monkeypatch):
    n, (centres, heights) = 6, hills(6)
    moves = [np.array([[0.02 * t], [-0.01 * t], [0.0]]) for t in range(9)]
    volumes = [field(S.grid((n,) * 3) - m, centres, heights, 2.0).reshape((n,) * 3) for m in moves]
    frames = wide(spark, [*((0, t, v) for t, v in enumerate(volumes)), (1, 3, volumes[0])])
    base = A.base_volumes(frames, "first")
    whole = sorted(A.align_frames(frames, base).collect())
    monkeypatch.setattr(A, "SHARE", 2)
    shared = A.beside_base(frames, base).withColumn("task", F.spark_partition_id())
    assert sorted(A.align_frames(frames, base).collect()) == whole and len(whole) == 10
    assert shared.where("run = 0").select("task").distinct().count() > 1 and shared.count() == 10
    # without a number, too, a frame is aligned
    assert A.align_frames(frames.withColumn("t", F.expr("nullif(t, 4)")), base).count() == 10


def test_wide_volumes_read_what_cubic_reads():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(4, 6, 5))
    at = np.concatenate([rng.uniform(0, 1, (3, 500)) * np.array([[4.0], [5.0], [3.0]]), S.grid(v.shape), S.grid(v.shape) * (1 + 1e-7), -1e-7 * np.ones((3, 1))], axis=1)
    at = at[:, S.inside(v.shape, at)]
    assert at.shape[1] > 600 and np.allclose(S.cubic_in(S.edged(v), at, 64), S.cubic(v, at), atol=1e-12)
    one = np.full((1, 1, 1), 3.0)
    assert S.cubic_in(S.edged(one), np.zeros((3, 2))).tolist() == [3.0, 3.0]


def test_steps_that_go_in_circles_end(monkeypatch):
    n, (centres, heights) = 10, hills(10)
    places, steps, inside = S.grid((n,) * 3), [], S.inside
    monkeypatch.setattr(S, "inside", lambda *a: steps.append(1) or inside(*a))
    base, frame = (field(places - np.array([[x], [y], [0.0]]), centres, heights, 2.0).reshape((n,) * 3) for x, y in ((0, 0), (0.6, -0.4)))
    slopes = A._slopes(base, np.ones(3))
    p, error = A.align(base, frame, np.ones(3), slopes)
    few = len(steps)
    all_of_them = A.align(base, frame, np.ones(3), slopes, least=0.0)
    assert few <= 15 and len(steps) - few == 30
    assert np.allclose(p, all_of_them[0], atol=1e-7) and error == pytest.approx(all_of_them[1])
