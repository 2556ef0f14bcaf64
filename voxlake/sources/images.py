"""Reading and writing image files.

``read_headers`` and ``read_volumes`` go through Spark's binary file reader, so
any file system that Spark knows will do; a file is decoded by one task, as
gzip can't be split.  The data source ``voximage`` reads single frames of
uncompressed files by seeking, where workers can open the path: frames asked
for by option or by a filter on ``t`` are the only ones read.  ``read_ranges`` does
so on any file system that Arrow opens, over files that Spark lists.

``encode_volumes`` turns wide volumes into file bytes, and ``write_files`` puts
them in a folder.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..functions import header as H
from ..functions.batches import map_groups
from ..model import HEADER, schema
from ..session import prepare

VOLUMES = "path string, t int, dims struct<x:int,y:int,z:int>, voxels array<double>"
#: Voxels of volumes that are handed on together.
BATCH_VOXELS = 1 << 20
NAMES = r"\.(nii|img|hdr)(\.gz)?$"


def unpacked(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def frame_count(header: dict) -> int:
    dim = header["dime"]["dim"]
    return int(np.prod([max(1, d) for d in dim[4 : dim[0] + 1]])) if dim[0] > 3 else 1


def spatial(header: dict) -> tuple[int, int, int]:
    dim = header["dime"]["dim"]
    return tuple(max(1, d) if k <= dim[0] else 1 for k, d in enumerate(dim[1:4], 1))


def frame_bytes(header: dict) -> int:
    nx, ny, nz = spatial(header)
    return nx * ny * nz * H.TYPES[header["dime"]["datatype"]][0] // 8


def decode_frame(header: dict, data: bytes, raw: bool = True) -> np.ndarray:
    """A frame's voxels as doubles, x fastest.  Two or three values a voxel give an axis more, last; ``raw`` leaves them unscaled."""
    bits, kind, count, _ = H.TYPES[header["dime"]["datatype"]]
    nx, ny, nz = spatial(header)
    if bits == 1:
        return np.unpackbits(np.frombuffer(data, np.uint8))[: nx * ny * nz].astype(float)
    flat = np.frombuffer(data, np.dtype(kind).newbyteorder("<" if header["byte_order"] == "little" else ">")).astype(float)
    if header["dime"]["datatype"] in H.COLOURS:
        flat = flat.reshape(nz, count, ny * nx).swapaxes(1, 2).reshape(-1, count)
    elif count > 1:
        flat = flat.reshape(-1, count)
    how = None if raw else H.scaling(header)
    if how:
        slope, inter, result = how
        flat = flat * slope + (np.array([inter, 0.0]) if count == 2 else inter)
        flat = flat.astype(np.float32).astype(float) if result in (16, 32) else flat
    return flat


def encode_frame(values: np.ndarray, datatype: int, order: str = "little") -> bytes:
    bits, kind, count, _ = H.TYPES[datatype]
    if bits == 1:
        return np.packbits(values.astype(np.uint8)).tobytes()
    target = np.dtype(kind).newbyteorder("<" if order == "little" else ">")
    if target.kind in "iu":
        limits = np.iinfo(target)
        values = np.clip(round_half_away(values), limits.min, limits.max)
    return np.ascontiguousarray(values).astype(target).tobytes()


def round_half_away(values: np.ndarray) -> np.ndarray:
    """Half away from zero, as whole-number voxels are stored."""
    return np.sign(values) * np.floor(np.abs(values) + 0.5)


def _header_row(path: str, data: bytes) -> dict:
    head = H.parse_header(data)
    offset = int(head["dime"]["vox_offset"])
    ext = H.parse_extensions(data[H.SIZE : max(H.SIZE, offset)], "<" if head["byte_order"] == "little" else ">") if head["hist"]["magic"] == "n+1" else []
    return {"path": path} | head | {"ext": ext}


def _files(spark: SparkSession, path: str) -> DataFrame:
    return prepare(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(NAMES))


def matrix_rows(files: DataFrame) -> DataFrame:
    """Matrices of MATLAB files that are in a table (path, content): path, name, n_rows, n_columns, values (rows one after the other); a null content has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(path, name, m) for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if data for name, m in read_matrix_file(data).items()]
            columns = [pa.array([f[k] for f in found], pa.string()) for k in (0, 1)] + [pa.array([f[2].shape[k] for f in found], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([f[2].reshape(-1).tolist() for f in found], pa.list_(pa.float64()))], names=["path", "name", "n_rows", "n_columns", "values"])

    prepare(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, "path string, name string, n_rows int, n_columns int, values array<double>")


def read_matrix_file(data: bytes) -> dict[str, np.ndarray]:
    """Variables of a MATLAB file of level 4 or 5 that are matrices of doubles; other variables are left out."""
    kinds = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8"}
    out: dict[str, np.ndarray] = {}

    def element(at: int) -> tuple[int, bytes, int]:
        kind, size = np.frombuffer(data, "<u4", 2, at)
        if kind >> 16:  # a short element holds its data in the second word
            return int(kind & 0xFFFF), data[at + 4 : at + 4 + int(kind >> 16)], at + 8
        return int(kind), data[at + 8 : at + 8 + int(size)], at + 8 + -(-int(size) // 8) * 8 if kind != 15 else at + 8 + int(size)

    if data[:6] != b"MATLAB":
        at = 0
        while at + 20 <= len(data):
            kind, rows, columns, imaginary, name = (int(v) for v in np.frombuffer(data, "<i4", 5, at))
            at += 20
            label, at = data[at : at + name].split(b"\0")[0].decode(), at + name
            size = rows * columns * 8 * (2 if imaginary else 1)
            if kind == 0 and not imaginary:
                out[label] = np.frombuffer(data, "<f8", rows * columns, at).reshape((rows, columns), order="F")
            at += size
        return out
    at = 128
    while at + 8 <= len(data):
        kind, body, at = element(at)
        if kind == 15:
            out |= read_matrix_file(data[:128] + zlib.decompress(body))
        elif kind == 14:
            outer, data = data, body
            _, flags, inner = element(0)
            _, dims, inner = element(inner)
            _, label, inner = element(inner)
            kind, values, _ = element(inner)
            data = outer
            if flags[0] == 6 and kind in kinds:
                shape = np.frombuffer(dims, "<i4")
                out[label.decode()] = np.frombuffer(values, "<" + kinds[kind]).astype(float).reshape(tuple(shape), order="F")
    return out


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: path, byte order, the header's three blocks and its extensions.  Image parts of header pairs are left out."""
    return decode_headers(_files(spark, path).where(~F.col("path").rlike(r"\.img(\.gz)?$")))


def decode_headers(files: DataFrame) -> DataFrame:
    """read_headers for files that are in a table: path and content."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([_header_row(p, unpacked(c)) for p, c in zip(frame["path"], frame["content"], strict=True)], columns=["path", "byte_order", "hk", "dime", "hist", "ext"])

    return prepare_frame(files).select("path", "content").mapInPandas(parse, HEADER)


def rewrite_headers(files: DataFrame, change: Callable[[dict], dict]) -> DataFrame:
    """Files of a table (path, content) with their headers changed and everything behind them as it was: extensions and voxels are never decoded.

    Packed files stay packed.  The header's byte order stays; a change must not
    move the voxels.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column(1).to_pylist():
                data = unpacked(content)
                old = H.parse_header(data)
                new = change(old)
                if new["dime"]["vox_offset"] != old["dime"]["vox_offset"]:
                    raise ValueError("a header can't move the voxels behind it")
                whole = H.build_header(new) + data[H.SIZE :]
                out.append(gzip.compress(whole, mtime=0) if data is not content else whole)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    return prepare_frame(files).select("path", "content").mapInArrow(rewrite, "path string, content binary")


def packed(files: DataFrame) -> DataFrame:
    """Files of a table (path, content) packed by gzip, as those with the suffix ``.gz`` are."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [gzip.compress(c.as_py(), mtime=0) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["path", "content"])

    return prepare_frame(files).select("path", "content").mapInArrow(pack, "path string, content binary")


def frame_and_tr(headers: DataFrame) -> DataFrame:
    """path, number of frames and repetition time, as a scan's fourth dimension has them."""
    return headers.select("path", F.col("dime.dim")[4].alias("n_frames"), F.col("dime.pixdim")[4].cast("double").alias("tr"))


def read_volumes(spark: SparkSession, path: str, raw: bool = False, frames: Sequence[int] | None = None, ras: bool = False, preferred: str = "s", tolerance: float = 0.1) -> DataFrame:
    """A row a file and frame: path, t, dims, voxels.  Values are scaled as the header says unless ``raw``.

    With ``ras`` each image's axes are turned to the right, front and top by
    its own header, which ``preferred`` and ``tolerance`` are about; otherwise
    they stay as stored.

    A header pair is one image under the path of its header.  Frames asked for
    must exist and be named once.
    """
    if frames is not None and len(set(frames)) != len(frames):
        raise ValueError("a frame is asked for twice")

    files = _files(spark, path).select("path", "content")
    stem = F.regexp_replace("path", r"\.(hdr|img)(\.gz)?$", "")
    images = files.where(F.col("path").rlike(r"\.img(\.gz)?$")).select(stem.alias("stem"), F.col("content").alias("image"))
    heads = files.where(~F.col("path").rlike(r"\.img(\.gz)?$")).withColumn("stem", stem)
    return decode_volumes(heads.join(images, "stem", "left").select("path", "content", "image"), raw, frames, ras, preferred, tolerance)


def decode_volumes(files: DataFrame, raw: bool = False, frames: Sequence[int] | None = None, ras: bool = False, preferred: str = "s", tolerance: float = 0.1) -> DataFrame:
    """read_volumes for files that are in a table: path, content and, of header pairs, image (null for single files)."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content, second in zip(*(batch.column(k) for k in range(3)), strict=True):
                data = unpacked(content.as_py())
                head = H.parse_header(data)
                image = unpacked(second.as_py()) if second.is_valid else data
                start = int(head["dime"]["vox_offset"])
                codes = H.orientation(head, preferred, tolerance).codes if ras else (1, 2, 3)
                yield from _frames(path.as_py(), head, image, start, frames, raw, codes)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in decoded(batches):
            held.append(row)
            size += len(row[3])
            if size >= BATCH_VOXELS:
                yield _volumes(held)
                held, size = [], 0
        if held:
            yield _volumes(held)

    rows = files if "image" in files.columns else files.withColumn("image", F.lit(None).cast("binary"))
    return prepare_frame(rows).select("path", "content", "image").mapInArrow(decode, VOLUMES)


def _volumes(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (path, t, dims, voxels) as one batch."""
    path, t, dims, voxels = zip(*rows, strict=True)
    ends = pa.array(np.cumsum([0, *map(len, voxels)]), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(t, pa.int32()), pa.array(dims, _VOXELS.field("dims").type), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(voxels)))], schema=_VOXELS)


def _frames(path: str, head: dict, data: bytes, start: int, frames: Sequence[int] | None, raw: bool, codes: Sequence[int]) -> Iterator[tuple]:
    size, total = frame_bytes(head), frame_count(head)
    for t in range(total) if frames is None else frames:
        if not 0 <= t < total:
            raise ValueError(f"{path} has {total} frames; frame {t} was asked for")
        values = decode_frame(head, data[start + t * size : start + (t + 1) * size], raw)
        values, (nx, ny, nz) = turned(values, spatial(head), codes)
        yield path, t, {"x": nx, "y": ny, "z": nz}, values.astype(float).ravel()


def turned(values: np.ndarray, dims: Sequence[int], codes: Sequence[int]) -> tuple[np.ndarray, tuple[int, int, int]]:
    """A frame's voxels, x fastest, with the axes that ``codes`` name turned to the right, front and top; and its new size."""
    if tuple(codes) == (1, 2, 3):
        return values, tuple(dims)
    box = values.reshape(*dims[::-1], -1)  # z, y, x, parts
    for k, code in enumerate(codes):
        if code > 3:
            box = np.flip(box, 2 - k)
    order = [0, 0, 0]
    for k, code in enumerate(codes):
        order[2 - (code - 1) % 3] = 2 - k
    box = box.transpose(*order, 3)
    return box.reshape(-1) if values.ndim == 1 else box.reshape(-1, values.shape[1]), tuple(box.shape[2::-1])


def to_ras(volumes: DataFrame, header: dict, preferred: str = "s", tolerance: float = 0.1) -> DataFrame:
    """Long volumes of one header with axes to the right, front and top."""
    from ..operators.volume import from_orient_codes, reorient

    return reorient(volumes, from_orient_codes(H.orientation(header, preferred, tolerance).codes), spatial(header))


def folder_as_series(volumes: DataFrame, digits: int | None = 5) -> DataFrame:
    """Single volumes of a folder as one series; t is the number of ``digits`` digits before the file's suffix, of all digits there if None.

    Names that ``encode_volumes`` splits a series into have four digits, and
    more from frame 10,000 on: they are read by all digits.
    """
    some = r"\d+" if digits is None else rf"\d{{{digits}}}"
    return volumes.withColumn("t", F.regexp_extract("path", rf"({some})\.(nii|img|hdr)(\.gz)?$", 1).cast("int"))


def encode_volumes(
    wide: DataFrame, datatype: int = 16, voxel_size=(1.0, 1.0, 1.0), origin=(0, 0, 0), description: str = "", split: bool = False, sections: list[dict] | None = None,
    scale: tuple[float, float] | None = None, fields: dict[str, dict] | None = None,
) -> DataFrame:
    """(name, content) of one file an image, or a file a frame with ``split`` (named <image>_0000 and so on), from wide volumes.

    With ``scale`` (slope, intercept) what is stored is the value less the
    intercept, divided by the slope, as a reader multiplies and adds them.
    ``fields`` are header fields by block (``dime``, ``hist``) to be set.
    """

    def build(group: pa.RecordBatch) -> list[pa.Array]:
        order = group.column(1).to_numpy(zero_copy_only=False).argsort(kind="stable").tolist()
        first = group.column(2)[order[0]].as_py()
        dims = [first[a] for a in "xyz"]
        values = [group.column(3)[k].values.to_numpy(zero_copy_only=False).astype(float) for k in order]
        low, high = min(v.min() for v in values), max(v.max() for v in values)
        many = len(values) > 1
        head = H.new_header([*dims, len(values)] if many else dims, datatype, voxel_size, origin, description, limits=(int(round_half_away(low)), int(round_half_away(high))))
        for block, given in (fields or {}).items():
            head[block] |= given
        if scale:
            head["dime"] |= {"scl_slope": scale[0], "scl_inter": scale[1]}
            values = [(v - scale[1]) / scale[0] for v in values]
        ext = H.build_extensions(sections or [])
        head["dime"]["vox_offset"] = float(-(-(H.SIZE + len(ext)) // 16) * 16)
        content = (H.build_header(head) + ext).ljust(int(head["dime"]["vox_offset"]), b"\0") + b"".join(encode_frame(v, datatype) for v in values)
        return [group.column(0).slice(0, 1), pa.array([content], pa.binary())]

    name = F.format_string("%s_%04d", "image_id", "t") if split else F.col("image_id").cast("string")
    rows = prepare_frame(wide).withColumn("name", name).select("name", "t", "dims", "voxels")
    return map_groups(rows, ["name"], build, schema("name string, content binary"))


def prepare_frame(df: DataFrame) -> DataFrame:
    prepare(df.sparkSession)
    return df


def write_files(files: DataFrame, folder: str, suffix: str = ".nii") -> None:
    """Write (name, content) rows as files; a ``.gz`` suffix packs them.  The folder must be one that all workers share."""
    spark = prepare(files.sparkSession)
    spark.dataSource.register(FileSink)
    files.select("name", "content").write.format("voxfiles").option("suffix", suffix).mode("append").save(folder)


class FileSink(DataSource):
    """Sink ``voxfiles``: a file a row, put in place only when the job commits."""

    @classmethod
    def name(cls) -> str:
        return "voxfiles"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"].removeprefix("file:"), self.options.get("suffix", ""))


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        files = []
        for row in rows:
            end = os.path.join(self.folder, row.name + self.suffix)
            part = f"{self.folder}/.{uuid.uuid4().hex}"
            content = bytes(row.content)
            with open(part, "wb") as f:
                f.write(gzip.compress(content, mtime=0) if self.suffix.endswith(".gz") else content)
            files.append((part, end))
        return Written(files)

    def commit(self, messages: list[Written]) -> None:
        for m in messages:
            for part, end in m.files if m else []:
                os.replace(part, end)

    def abort(self, messages: list[Written]) -> None:
        for m in messages:
            for part, _ in m.files if m else []:
                if os.path.exists(part):
                    os.remove(part)


class Part(InputPartition):
    """Some frames of a file: those named or, as nobody has opened it yet, the ``share``-th of ``shares`` parts of what it has."""

    def __init__(self, path: str, frames: tuple[int, ...] | None, share: int = 0, shares: int = 1):
        self.path, self.frames, self.share, self.shares = path, frames, share, shares


class ImageSource(DataSource):
    """Source ``voximage``: option path (a file, folder or pattern), raw, frames ("0,3"), slices ("2,5": other slices aren't read and are 0), part_bytes (of a file that make a task)."""

    @classmethod
    def name(cls) -> str:
        return "voximage"

    def schema(self) -> str:
        return VOLUMES

    def reader(self, schema) -> ImageReader:
        return ImageReader(self.options)


def _numbers(text: str | None) -> tuple[int, ...] | None:
    return tuple(int(x) for x in text.split(",")) if text else None


#: Bytes of an uncompressed file that make a task, a frame at least.
PART_BYTES = 32_000_000
_VOXELS = pa.schema([("path", pa.string()), ("t", pa.int32()), ("dims", pa.struct([(a, pa.int32()) for a in "xyz"])), ("voxels", pa.list_(pa.float64()))])


class ImageReader(DataSourceReader):
    """Planning looks at names and sizes only; headers are read by the tasks."""

    def __init__(self, options):
        path = options["path"].removeprefix("file:")
        found = sorted(os.path.join(path, n) for n in os.listdir(path)) if os.path.isdir(path) else sorted(glob.glob(path))
        self.files = [p for p in found if p.endswith((".nii", ".nii.gz", ".hdr", ".hdr.gz"))]
        self.raw = str(options.get("raw", "false")).lower() == "true"
        self.frames, self.slices = _numbers(options.get("frames")), _numbers(options.get("slices"))
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = (f.value,) if isinstance(f, EqualTo) and f.attribute == ("t",) else tuple(f.value) if isinstance(f, In) and f.attribute == ("t",) else None
            if wanted is None or any(w is None for w in wanted):
                yield f
            else:
                self.frames = tuple(t for t in wanted if self.frames is None or t in self.frames)

    def partitions(self) -> list[Part]:
        out = []
        for path in self.files:
            if path.endswith(".gz"):  # decoded from its start, so its frames stay together
                out.append(Part(path, self.frames))
            elif self.frames is not None:
                out += [Part(path, (t,)) for t in self.frames]
            else:
                shares = max(1, -(-os.path.getsize(_image_of(path)) // self.part_bytes))
                out += [Part(path, None, k, shares) for k in range(shares)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        frames = part.frames if part.frames is not None else (part.share, part.shares)
        return _frames_of(part.path, _open, frames, part.frames is None, self.slices, self.raw)


def _frames_of(path: str, opened: Callable, frames: tuple[int, ...], share: bool, slices: tuple[int, ...] | None, raw: bool) -> Iterator[pa.RecordBatch]:
    """Frames of a file by seeking: those named or, as a ``share``, the k-th of n parts of what it has; ``opened`` opens a path."""
    with opened(path) as f:
        head = H.parse_header(f.read(H.SIZE))
    total, size = frame_count(head), frame_bytes(head)
    nx, ny, nz = spatial(head)
    wanted = range(total * frames[0] // frames[1], total * (frames[0] + 1) // frames[1]) if share else [t for t in frames if t < total]
    by_slice = slices is not None and H.TYPES[head["dime"]["datatype"]][0] > 1
    with opened(_image_of(path)) as f:
        for t in wanted:
            start = int(head["dime"]["vox_offset"]) + t * size
            if by_slice:
                data, each = bytearray(size), size // nz
                for z in slices:
                    if 0 <= z < nz:
                        f.seek(start + z * each)
                        data[z * each : (z + 1) * each] = f.read(each)
            else:
                f.seek(start)
                data = f.read(size)
            values = decode_frame(head, bytes(data), raw)
            if slices is not None:
                keep = np.isin(np.arange(len(values)) // (nx * ny), slices)
                values = np.where(keep if values.ndim == 1 else keep[:, None], values, 0.0)
            flat = pa.array(np.ascontiguousarray(values, np.float64).ravel())
            voxels = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([t], pa.int32()), pa.array([{"x": nx, "y": ny, "z": nz}], _VOXELS.field("dims").type), voxels], schema=_VOXELS)


def _image_of(path: str) -> str:
    """Where the voxels of a header's file are."""
    return path[: path.rindex(".hdr")] + path[path.rindex(".hdr") :].replace(".hdr", ".img") if ".hdr" in os.path.basename(path) else path


def _open(path: str):
    return gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")


def _file_system(path: str):
    """(file system, path in it) by Arrow's file-system layer; an error if that doesn't know the scheme."""
    from pyarrow import fs

    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def _open_anywhere(path: str):
    where, inside = _file_system(path)
    found = where.open_input_file(inside)
    return gzip.GzipFile(fileobj=found) if path.endswith(".gz") else found


def seekable(path: str) -> bool:
    """Whether workers can open byte ranges below a path; paths of a scheme that only Spark knows they can't."""
    try:
        _file_system(path)
        return True
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        return False


def read_ranges(spark: SparkSession, path: str, frames: Sequence[int] | None = None, slices: Sequence[int] | None = None, raw: bool = False, part_bytes: int = PART_BYTES, seek: bool | None = None) -> DataFrame:
    """Frames (and slices of them; others are 0) of image files below any path that Spark lists: path, t, dims, voxels.

    Spark lists the files; each named frame, or each share of ``part_bytes`` of
    a file, is a row that is dealt to the tasks, which read the header and the
    bytes they need through Arrow's file-system layer (local, object stores,
    HDFS).  A packed file is one share.  Where workers can't open the path
    (``seek``, found out from its scheme), Spark hands them whole files and they
    decode what is asked for.
    """
    some, cut = (tuple(int(x) for x in v) if v is not None else None for v in (frames, slices))
    files = _files(spark, path).where(~F.col("path").rlike(r"\.img(\.gz)?$"))
    seek = seekable(path) if seek is None else seek
    shown = "path string, t int, dims struct<x:int,y:int,z:int>, voxels array<double>"
    if not seek:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    content = unpacked(data)
                    yield from _frames_of(name, lambda _, c=content: io.BytesIO(c), some if some is not None else (0, 1), some is None, cut, raw)

        return files.where(~F.col("path").rlike(r"\.hdr(\.gz)?$")).select("path", "content").mapInArrow(whole, shown)
    packed = F.col("path").endswith(".gz")
    # a header's own size says nothing of its image's: it is one share
    shares = F.when(packed | F.col("path").rlike(r"\.hdr$"), 1).otherwise(F.greatest(F.ceil(F.col("length") / part_bytes), F.lit(1))).cast("int")
    rows = files.select("path", shares.alias("n"), F.explode(F.array(*map(F.lit, some)) if some is not None else F.sequence(F.lit(0), shares - 1)).alias("k"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "k")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, k in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                yield from _frames_of(name, _open_anywhere, (k,) if some is not None else (k, n), some is None, cut, raw)

    return rows.mapInArrow(ranges, shown)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Frames by the data source."""
    prepare(spark).dataSource.register(ImageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("voximage").options(**{k: str(v) for k, v in options.items()}).load(path)
