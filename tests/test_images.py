import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake import model
from voxlake.functions import header as H
from voxlake.sources import images


def nifti(values: np.ndarray, datatype: int, order: str = "little", slope=0.0, inter=0.0, ext=(), **hist) -> bytes:
    head = H.new_header(values.shape[:4], datatype, (2.0, 2.0, 3.0))
    sections = H.build_extensions(list(ext))
    head["byte_order"] = order
    head["dime"] |= {"scl_slope": slope, "scl_inter": inter, "vox_offset": float(-(-(348 + len(sections)) // 16) * 16)}
    head["hist"] |= hist
    body = (H.build_header(head) + sections).ljust(int(head["dime"]["vox_offset"]), b"\0")
    return body + images.encode_frame(values.ravel(order="F"), datatype, order)


@pytest.mark.parametrize("order", ["little", "big"])
@pytest.mark.parametrize("datatype", [2, 4, 8, 16, 64, 256, 512, 768, 1024, 1280])
def test_every_plain_type_in_both_orders(spark, tmp_path, datatype, order):
    values = np.arange(24.0).reshape(2, 3, 4)
    (tmp_path / "a.nii").write_bytes(nifti(values, datatype, order))
    row = images.read_volumes(spark, str(tmp_path)).first()
    assert list(row.voxels) == list(values.ravel(order="F")) and tuple(row.dims) == (2, 3, 4)


def test_binary_complex_and_colours():
    bits = H.new_header((2, 2, 2), 1)
    assert list(images.decode_frame(bits, b"\xa5")) == [1, 0, 1, 0, 0, 1, 0, 1]
    c = H.new_header((2, 1, 1), 32)
    assert images.decode_frame(c, struct.pack("<4f", 1, 2, 3, 4)).tolist() == [[1, 2], [3, 4]]
    rgb = H.new_header((2, 1, 1), 128)
    assert images.decode_frame(rgb, bytes([1, 2, 3, 4, 5, 6])).tolist() == [[1, 3, 5], [2, 4, 6]]
    for code in H.UNSUPPORTED:
        head = H.new_header((1, 1, 1), 16)
        head["dime"]["datatype"] = code
        with pytest.raises(ValueError, match="supported"):
            H.parse_header(H.build_header(head))


def test_scaling_rules(spark, tmp_path):
    values = np.arange(8.0).reshape(2, 2, 2)
    for name, slope, inter in (("none", 0.0, 5.0), ("same", 1.0, 0.0), ("scaled", 0.5, 3.0)):
        (tmp_path / f"{name}.nii").write_bytes(nifti(values, 4, slope=slope, inter=inter))
    got = {r.path.split("/")[-1]: np.array(r.voxels) for r in images.read_volumes(spark, str(tmp_path)).collect()}
    flat = values.ravel(order="F")
    assert np.array_equal(got["none.nii"], flat) and np.array_equal(got["same.nii"], flat) and np.array_equal(got["scaled.nii"], flat * 0.5 + 3)
    raw = images.read_volumes(spark, str(tmp_path / "scaled.nii"), raw=True).first()
    assert np.array_equal(raw.voxels, flat)
    assert H.scaling(H.new_header((1,), 128) | {"dime": {"scl_slope": 2.0, "scl_inter": 0.0, "datatype": 128}}) is None


def test_headers_extensions_and_packed_files(spark, tmp_path):
    section = {"ecode": 6, "edata": b"hello"}
    data = nifti(np.zeros((2, 2, 2, 3)), 16, ext=[section], descrip="scan")
    (tmp_path / "a.nii.gz").write_bytes(gzip.compress(data))
    row = images.read_headers(spark, str(tmp_path)).first()
    assert row.hist.descrip == "scan" and row.dime.dim[4] == 3
    assert [(e.esize, e.ecode, bytes(e.edata).rstrip(b"\0")) for e in row.ext] == [(16, 6, b"hello")]
    assert images.frame_and_tr(images.read_headers(spark, str(tmp_path))).first().n_frames == 3
    assert images.read_volumes(spark, str(tmp_path)).count() == 3
    with pytest.raises(ValueError):
        H.parse_header(b"\0" * 348)
    with pytest.raises(ValueError):
        H.parse_header(b"short")


def test_header_pairs(spark, tmp_path):
    values = np.arange(6.0).reshape(1, 2, 3)
    head = H.new_header(values.shape, 4, analyze=True, origin=(1, 2, 3))
    (tmp_path / "a.hdr").write_bytes(H.build_header(head))
    (tmp_path / "a.img").write_bytes(images.encode_frame(values.ravel(order="F"), 4))
    assert list(images.read_volumes(spark, str(tmp_path)).first().voxels) == list(values.ravel(order="F"))
    assert images.read_headers(spark, str(tmp_path)).first().hist.originator[:3] == [1, 2, 3]
    assert images.load(spark, str(tmp_path)).first().voxels == list(values.ravel(order="F"))


def test_frames_and_slices_are_pruned(spark, tmp_path):
    values = np.arange(48.0).reshape(2, 3, 4, 2)
    (tmp_path / "a.nii").write_bytes(nifti(values, 16))
    assert images.load(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    df = images.load(spark, str(tmp_path), part_bytes=300)
    assert df.rdd.getNumPartitions() == 2 and sorted(r.t for r in df.collect()) == [0, 1]
    assert sorted(r.t for r in images.load(spark, str(tmp_path), part_bytes=10).collect()) == [0, 1]
    only = df.where("t = 1")
    assert only.rdd.getNumPartitions() == 1 and list(only.first().voxels) == list(values[..., 1].ravel(order="F"))
    assert df.where("t in (0, 1)").count() == 2
    part = np.array(images.load(spark, str(tmp_path), frames="0", slices="1,3").first().voxels).reshape((2, 3, 4), order="F")
    assert np.array_equal(part[:, :, [1, 3]], values[:, :, [1, 3], 0]) and not part[:, :, [0, 2]].any()
    with pytest.raises(Exception, match="frame 7"):
        images.read_volumes(spark, str(tmp_path), frames=[7]).collect()
    with pytest.raises(ValueError):
        images.read_volumes(spark, str(tmp_path), frames=[1, 1])


@pytest.mark.parametrize("suffix", [".nii", ".nii.gz"])
@pytest.mark.parametrize("split", [False, True])
def test_write_and_read_back(spark, tmp_path, suffix, split):
    rng = np.random.default_rng(0)
    rows = [("a", t, (2, 3, 4), [float(v) for v in rng.integers(-50, 50, 24)]) for t in range(3)]
    wide = spark.createDataFrame(rows, model.WIDE)
    out = tmp_path / "out"
    images.write_files(images.encode_volumes(wide, 4, (1.0, 1.0, 2.5), split=split), str(out), suffix)
    files = sorted(p.name for p in out.iterdir())
    assert files == ([f"a_{t:04d}{suffix}" for t in range(3)] if split else [f"a{suffix}"])
    got = images.read_volumes(spark, str(out)).orderBy("path", "t").collect()
    assert [list(r.voxels) for r in got] == [r[3] for r in rows]
    head = images.read_headers(spark, str(out)).first()
    assert head.dime.pixdim[3] == 2.5


def test_folder_as_series(spark):
    df = spark.createDataFrame([("x/scan00012.nii", 0), ("x/scan00003.nii", 0)], "path string, t int")
    assert sorted(r.t for r in images.folder_as_series(df).collect()) == [3, 12]


def test_frames_beyond_four_digits(spark):
    """A series split into files has names of five digits from frame 10,000 on."""
    wide = spark.createDataFrame([("7", t, (1, 1, 1), [float(t)]) for t in (3, 9999, 10_000, 123_456)], "image_id string, t int, dims struct<x:int,y:int,z:int>, voxels array<double>")
    files = images.encode_volumes(wide, datatype=64, split=True).select(F.concat("name", F.lit(".nii")).alias("path"), "content")
    rows = images.folder_as_series(images.decode_volumes(files), digits=None).collect()
    assert sorted((r.t, r.voxels[0]) for r in rows) == [(t, float(t)) for t in (3, 9999, 10_000, 123_456)]


def test_whole_numbers_round_and_stop_at_the_limits():
    assert np.frombuffer(images.encode_frame(np.array([0.5, -1.5, 300.0, -300.0]), 256), np.int8).tolist() == [1, -2, 127, -128]


def oriented(matrix, code="sform_code"):
    head = H.new_header((3, 4, 5), 16, (2.0, 3.0, 4.0))
    head["hist"] |= {code: 1, **{f"srow_{a}": list(matrix[k]) for k, a in enumerate("xyz")}}
    return head


def test_orientation_of_a_turned_image():
    m = np.array([[0, -3.0, 0, 10], [2.0, 0, 0, -4], [0, 0, 4.0, 8], [0, 0, 0, 1]])
    o = H.orientation(oriented(m))
    assert o.codes == (2, 4, 3) and np.allclose(o.voxel_size, (2, 3, 4))
    assert np.allclose(m[:3, :3] @ (np.array(o.origin) - 1) + m[:3, 3], 0)


def test_small_obliqueness_is_dropped_and_large_refused():
    m = np.diag([2.0, 3.0, 4.0, 1.0])
    m[0, 1] = 0.05
    assert H.orientation(oriented(m)).codes == (1, 2, 3)
    m[0, 1] = 1.0
    with pytest.raises(ValueError, match="oblique"):
        H.orientation(oriented(m))


def test_forms():
    head = oriented(np.diag([2.0, 3.0, 4.0, 1.0]))
    assert H.choose_form(head, "q") == "s" and H.choose_form(head, "S") == "s"
    with pytest.raises(ValueError):
        H.choose_form(head, "Q")
    bare = H.new_header((1, 1, 1), 16)
    assert H.choose_form(bare) is None and H.orientation(bare).codes == (1, 2, 3)


def test_quaternion():
    half = np.sqrt(0.5)
    assert np.allclose(H.rotation(0, 0, half), [[0, -1, 0], [1, 0, 0], [0, 0, 1]])
    r = H.rotation(0.1, -0.3, 0.5)
    assert np.allclose(r @ r.T, np.eye(3)) and np.isclose(np.linalg.det(r), 1)
    with pytest.raises(ValueError):
        H.rotation(1, 1, 1)
    head = H.new_header((2, 2, 2), 16, (2.0, 2.0, 2.0))
    head["hist"] |= {"qform_code": 1, "quatern_d": half, "qoffset_x": 5.0}
    assert H.orientation(head).codes == (2, 4, 3)


def test_flip_matrix_and_units():
    head = oriented(np.diag([2.0, 3.0, 4.0, 1.0]))
    assert H.flip_left_right(head)["hist"]["srow_x"] == [-2.0, 0.0, 0.0, 0.0]
    m = np.array([[2.0, 0, 0, -2], [0, 2, 0, -2], [0, 0, 2, -2], [0, 0, 0, 1]])
    assert H.with_matrix(head, m)["hist"]["srow_y"] == [0, 2, 0, 0]
    assert H.units(1) == (1e3, 1.0) and H.units(3 | 16) == (1e-3, 1e-3) and H.units(2 | 24) == (1.0, 1e-6)


def test_to_ras_moves_voxels(spark):
    a = np.arange(24.0).reshape(2, 3, 4)
    rows = [("a", 0, int(x), int(y), int(z), float(a[x, y, z])) for x, y, z in np.ndindex(a.shape)]
    df = spark.createDataFrame(rows, "image_id string, t int, x int, y int, z int, v double")
    head = H.new_header((2, 3, 4), 16)
    head["hist"] |= {"sform_code": 1, "srow_x": [-1.0, 0, 0, 0], "srow_y": [0, 0, 1.0, 0], "srow_z": [0, 1.0, 0, 0]}
    got = {(r.x, r.y, r.z): r.v for r in images.to_ras(df, head).collect()}
    assert got == {(1 - x, z, y): a[x, y, z] for x, y, z in np.ndindex(a.shape)}


@pytest.mark.parametrize("codes", [(2, 4, 3), (6, 1, 5), (1, 2, 3), (4, 5, 6)])
def test_each_file_is_turned_by_its_own_header(spark, tmp_path, codes):
    from voxlake.operators.volume import from_orient_codes, reorient

    values = np.arange(24.0).reshape(2, 3, 4)
    rows = np.zeros((4, 4))
    for k, code in enumerate(codes):
        rows[(code - 1) % 3, k] = 1 if code < 4 else -1
    (tmp_path / "a.nii").write_bytes(nifti(values, 16, sform_code=1, **{f"srow_{a}": list(rows[k]) for k, a in enumerate("xyz")}))
    wide = images.read_volumes(spark, str(tmp_path), ras=True)
    stored = model.to_long(images.read_volumes(spark, str(tmp_path)))
    want = {(r.x, r.y, r.z): r.v for r in reorient(stored, from_orient_codes(codes), (2, 3, 4)).collect()}
    assert {(r.x, r.y, r.z): r.v for r in model.to_long(wide).collect()} == want


def test_matrix_files():
    m = np.arange(16.0).reshape(4, 4)
    body = m.tobytes(order="F")
    four = struct.pack("<5i", 0, 4, 4, 0, 2) + b"M\0" + body
    assert np.array_equal(images.read_matrix_file(four)["M"], m)
    part = struct.pack("<2I", 6, 8) + struct.pack("<2I", 6, 0) + struct.pack("<2I2i", 5, 8, 4, 4) + struct.pack("<2H4s", 1, 1, b"M") + struct.pack("<2I", 9, 128) + body
    matrix = struct.pack("<2I", 14, len(part)) + part
    start = b"MATLAB 5.0".ljust(124, b" ") + struct.pack("<2H", 0x0100, 0x4D49)
    import zlib

    packed = zlib.compress(matrix)
    for data in (start + matrix, start + struct.pack("<2I", 15, len(packed)) + packed):
        assert np.array_equal(images.read_matrix_file(data)["M"], m)


def test_default_types():
    assert [H.default_type(t) for t in ("u1", "i2", "f4", "f8", "c8")] == [2, 4, 16, 64, 32]
    with pytest.raises(ValueError):
        H.new_header((1,) * 8)
    with pytest.raises(ValueError):
        H.new_header((1,), 99)
    assert F is not None


def test_slices_that_are_not_asked_for_are_not_read(spark, tmp_path):
    values = np.arange(48.0).reshape(2, 3, 8)
    whole = nifti(values, 16)
    (tmp_path / "a.nii").write_bytes(whole[: 352 + 4 * 6 * 3])  # three slices of eight
    got = images.load(spark, str(tmp_path), slices="0,2").first()
    want = np.where(np.isin(np.arange(8), (0, 2)), values, 0.0)
    assert list(got.voxels) == list(want.ravel(order="F"))


def test_headers_are_rewritten_alone(spark):
    values = np.arange(24.0).reshape(2, 3, 4)
    data = nifti(values, 4)
    files = spark.createDataFrame([("a", data), ("b", gzip.compress(data))], "path string, content binary")
    out = {r.path: bytes(r.content) for r in images.rewrite_headers(files, H.flip_left_right).collect()}
    assert out["b"][:2] == b"\x1f\x8b" and gzip.decompress(out["b"]) == out["a"]
    assert out["a"][H.SIZE :] == data[H.SIZE :]
    before, after = H.affine_of(H.parse_header(data)), H.affine_of(H.parse_header(out["a"]))
    old = before[1] if before else np.diag([*H.parse_header(data)["dime"]["pixdim"][1:4], 1.0])
    assert np.allclose(after[1], np.diag([-1, 1, 1, 1]) @ old)
    with pytest.raises(Exception, match="can't move the voxels"):
        images.rewrite_headers(files, lambda h: h | {"dime": h["dime"] | {"vox_offset": 400.0}}).collect()


def test_scaled_values_come_back(spark):
    rows = [(str(k), 0, {"x": 2, "y": 1, "z": 1}, [1.25 * k, 3.0]) for k in range(3)]
    wide = spark.createDataFrame(rows, "image_id string, t int, dims struct<x:int,y:int,z:int>, voxels array<double>")
    files = images.encode_volumes(wide, datatype=4, scale=(0.25, 3.0), fields={"hist": {"descrip": "scaled"}}).withColumnRenamed("name", "path")
    head = images.decode_headers(files).first()
    assert (head.dime.scl_slope, head.dime.scl_inter, head.hist.descrip) == (0.25, 3.0, "scaled")
    assert {r.path: list(r.voxels) for r in images.decode_volumes(files).collect()} == {str(k): [1.25 * k, 3.0] for k in range(3)}
    assert {r.path: list(r.voxels) for r in images.decode_volumes(files, raw=True).collect()} == {str(k): [5.0 * k - 12, 0.0] for k in range(3)}


def test_frames_and_slices_by_ranges_and_by_paths_that_only_spark_opens(spark, tmp_path):
    values = np.arange(240.0).reshape(2, 3, 4, 10)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.nii").write_bytes(nifti(values, 16))
    (tmp_path / "in" / "deep" / "b.nii.gz").write_bytes(gzip.compress(nifti(values + 1000, 64)))
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.test.link./in", f"file://{tmp_path}/in")
    assert images.seekable(str(tmp_path)) and images.seekable(f"file:{tmp_path}") and not images.seekable("viewfs://test/in")
    frame = lambda t, base=0.0: list((values[..., t] + base).ravel(order="F"))
    for path in (f"{tmp_path}/in", f"file://{tmp_path}/in", "viewfs://test/in"):
        rows = images.read_ranges(spark, path, part_bytes=300).collect()
        assert len(rows) == 20 and sorted(r.t for r in rows) == sorted([*range(10)] * 2)
        assert all(list(r.voxels) == frame(r.t, 1000.0 if r.path.endswith(".gz") else 0.0) for r in rows)
        chosen = images.read_ranges(spark, path, frames=[7, 2, 99], slices=[1, 9]).collect()
        assert sorted((r.path[-5:], r.t) for r in chosen) == [("a.nii", 2), ("a.nii", 7), ("ii.gz", 2), ("ii.gz", 7)]
        kept = np.zeros((2, 3, 4))
        kept[:, :, 1] = values[:, :, 1, 7]
        assert next(list(r.voxels) for r in chosen if r.t == 7 and r.path.endswith("a.nii")) == list(kept.ravel(order="F"))


def test_ranges_read_no_more_than_they_need(tmp_path, monkeypatch):
    values = np.arange(240.0).reshape(2, 3, 4, 10)
    (tmp_path / "a.nii").write_bytes(nifti(values, 16))
    read: list[int] = []

    class Counting:
        def __init__(self, path):
            self.f = open(path, "rb")

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    assert len(list(images._frames_of(f"{tmp_path}/a.nii", Counting, (3,), False, (0, 2), False))) == 1
    assert read == [348, 24, 24]
    read.clear()
    assert len(list(images._frames_of(f"{tmp_path}/a.nii", Counting, (1, 5), True, None, False))) == 2 and read == [348, 96, 96]


def test_files_are_made_and_read_without_a_frame_a_volume(spark):
    wide = spark.createDataFrame([(k, 0, (1, 1, 2), [float(k), 1.0]) for k in range(5)], "image_id long, t int, dims struct<x:int,y:int,z:int>, voxels array<double>")
    files = images.packed(images.encode_volumes(wide, datatype=64).withColumnRenamed("name", "path"))
    rows = images.decode_volumes(files)
    assert "InPandas" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {r.path: r.voxels for r in rows.collect()}
    assert got == {str(k): [float(k), 1.0] for k in range(5)}
