"""Reading and interpreting 348-byte image headers, on the driver or in a reader.

Headers are small; what they say (type, scaling, orientation) is decided once
for an image and then applied to its voxels as column expressions.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import numpy as np

#: Code -> (bits, NumPy type, values a voxel, name).
TYPES = {
    1: (1, "u1", 1, "binary"),
    2: (8, "u1", 1, "uint8"),
    4: (16, "i2", 1, "int16"),
    8: (32, "i4", 1, "int32"),
    16: (32, "f4", 1, "float32"),
    32: (64, "f4", 2, "complex64"),
    64: (64, "f8", 1, "float64"),
    128: (24, "u1", 3, "rgb24"),
    256: (8, "i1", 1, "int8"),
    511: (96, "f4", 3, "rgb96"),
    512: (16, "u2", 1, "uint16"),
    768: (32, "u4", 1, "uint32"),
    1024: (64, "i8", 1, "int64"),
    1280: (64, "u8", 1, "uint64"),
    1792: (128, "f8", 2, "complex128"),
}
UNSUPPORTED = {1536: "float128", 2048: "complex256"}
SCALED = (2, 4, 8, 16, 64, 256, 512, 768)
COMPLEX, COLOURS = (32, 1792), (128, 511)
#: The fields in order, as (block, name, struct code).
LAYOUT = (
    ("hk", "sizeof_hdr", "i"), ("hk", "data_type", "10s"), ("hk", "db_name", "18s"), ("hk", "extents", "i"), ("hk", "session_error", "h"), ("hk", "regular", "1s"), ("hk", "dim_info", "B"),
    ("dime", "dim", "8h"), ("dime", "intent_p1", "f"), ("dime", "intent_p2", "f"), ("dime", "intent_p3", "f"), ("dime", "intent_code", "h"), ("dime", "datatype", "h"), ("dime", "bitpix", "h"),
    ("dime", "slice_start", "h"), ("dime", "pixdim", "8f"), ("dime", "vox_offset", "f"), ("dime", "scl_slope", "f"), ("dime", "scl_inter", "f"), ("dime", "slice_end", "h"), ("dime", "slice_code", "B"),
    ("dime", "xyzt_units", "B"), ("dime", "cal_max", "f"), ("dime", "cal_min", "f"), ("dime", "slice_duration", "f"), ("dime", "toffset", "f"), ("dime", "glmax", "i"), ("dime", "glmin", "i"),
    ("hist", "descrip", "80s"), ("hist", "aux_file", "24s"), ("hist", "qform_code", "h"), ("hist", "sform_code", "h"), ("hist", "quatern_b", "f"), ("hist", "quatern_c", "f"), ("hist", "quatern_d", "f"),
    ("hist", "qoffset_x", "f"), ("hist", "qoffset_y", "f"), ("hist", "qoffset_z", "f"), ("hist", "srow_x", "4f"), ("hist", "srow_y", "4f"), ("hist", "srow_z", "4f"), ("hist", "intent_name", "16s"), ("hist", "magic", "4s"),
)
SIZE = 348
#: Where headers without a magic string keep the origin, as five 16-bit numbers.
ORIGIN_AT = 253


def parse_header(data: bytes) -> dict:
    """{byte_order, hk, dime, hist} from a header's bytes; the byte order is the one that makes the size 348."""
    if len(data) < SIZE:
        raise ValueError(f"a header has {SIZE} bytes, not {len(data)}")
    order = next((o for o in "<>" if struct.unpack(o + "i", data[:4])[0] == SIZE), None)
    if order is None:
        raise ValueError("not an image header: its size field isn't 348")
    values = iter(struct.unpack(order + "".join(code for *_, code in LAYOUT), data[:SIZE]))
    out: dict = {"byte_order": "little" if order == "<" else "big", "hk": {}, "dime": {}, "hist": {}}
    for block, name, code in LAYOUT:
        count = int(code[:-1]) if len(code) > 1 and code[-1] in "hf" else 0
        value = [next(values) for _ in range(count)] if count else next(values)
        out[block][name] = value.split(b"\0")[0].decode("latin-1") if isinstance(value, bytes) else value
    out["hist"]["originator"] = list(struct.unpack(order + "5h", data[ORIGIN_AT : ORIGIN_AT + 10])) if not out["hist"]["magic"] else [0] * 5
    if out["dime"]["datatype"] in UNSUPPORTED:
        raise ValueError(f"{UNSUPPORTED[out['dime']['datatype']]} voxels aren't supported")
    return out


def build_header(header: dict) -> bytes:
    """The bytes of a header in its byte order."""
    order, flat = "<" if header.get("byte_order", "little") == "little" else ">", []
    for block, name, code in LAYOUT:
        value = header[block].get(name)
        if code[-1] == "s":
            flat.append((value or "").encode("latin-1"))
        elif len(code) > 1:
            flat.extend((value or [0] * int(code[:-1]))[: int(code[:-1])])
        else:
            flat.append(value or 0)
    data = bytearray(struct.pack(order + "".join(code for *_, code in LAYOUT), *flat))
    if not header["hist"].get("magic") and any(header["hist"].get("originator") or []):
        data[ORIGIN_AT : ORIGIN_AT + 10] = struct.pack(order + "5h", *[int(v) for v in header["hist"]["originator"][:5]])
    return bytes(data)


def new_header(dims, datatype: int = 16, voxel_size=(1.0, 1.0, 1.0), origin=(0, 0, 0), description: str = "", analyze: bool = False, limits=(0, 0)) -> dict:
    """A header for an array of up to seven dimensions; ``origin`` is a voxel, from 1, and becomes the offset of the affine."""
    if not 1 <= len(dims) <= 7:
        raise ValueError("an image has one to seven dimensions")
    if datatype not in TYPES:
        raise ValueError(f"unknown voxel type {datatype}")
    sizes = [float(v) for v in voxel_size]
    header: dict = {"byte_order": "little", "hk": {"sizeof_hdr": SIZE, "regular": "r"}, "dime": {}, "hist": {"descrip": description, "magic": "" if analyze else "n+1", "originator": [*(int(o) for o in origin), 0, 0]}}
    header["dime"] = {"dim": [len(dims), *dims, *[1] * (7 - len(dims))], "datatype": datatype, "bitpix": TYPES[datatype][0], "pixdim": [1.0, *sizes, 1.0, 1.0, 1.0, 1.0], "vox_offset": 0.0 if analyze else 352.0, "glmax": int(limits[1]), "glmin": int(limits[0])}
    for block, name, code in LAYOUT:
        header[block].setdefault(name, "" if code[-1] == "s" else [0] * int(code[:-1]) if len(code) > 1 else 0)
    if not analyze:
        rows = np.diag([*sizes, 1.0])
        if any(origin):
            rows[:3, 3] = [(1 - o) * s for o, s in zip(origin, sizes, strict=True)]
        header["hist"] |= {"sform_code": 1 if any(origin) else 0} | {f"srow_{a}": list(rows[k]) for k, a in enumerate("xyz")}
    return header


def default_type(dtype) -> int:
    """The code of the voxel type that holds a NumPy type."""
    for code, (_, kind, count, _name) in TYPES.items():
        if code != 1 and count == 1 and np.dtype(kind) == np.dtype(dtype):
            return code
    return {"c8": 32, "c16": 1792}.get(np.dtype(dtype).str[1:], 64)


def parse_extensions(data: bytes, order: str = "<") -> list[dict]:
    """Sections of a header extension from the bytes after the header; none unless the first byte says so."""
    if len(data) < 4 or not data[0]:
        return []
    out, at = [], 4
    while at + 8 <= len(data):
        size, code = struct.unpack(order + "ii", data[at : at + 8])
        if size < 8 or at + size > len(data):
            break
        out.append({"esize": size, "ecode": code, "edata": data[at + 8 : at + size]})
        at += size
    return out


def build_extensions(sections: list[dict], order: str = "<") -> bytes:
    """Bytes of the sections, each padded to a multiple of 16; the four zero bytes of "none" if there are none."""
    if not sections:
        return b"\0\0\0\0"
    out = bytearray(b"\1\0\0\0")
    for s in sections:
        size = -(-(len(s["edata"]) + 8) // 16) * 16
        out += struct.pack(order + "ii", size, s["ecode"]) + bytes(s["edata"]).ljust(size - 8, b"\0")
    return bytes(out)


def units(xyzt_units: int) -> tuple[float, float]:
    """Millimetres and seconds per unit of the header."""
    return {1: 1e3, 3: 1e-3}.get(xyzt_units & 7, 1.0), {16: 1e-3, 24: 1e-6}.get(xyzt_units & 56, 1.0)


def choose_form(header: dict, preferred: str = "s") -> str | None:
    """s or q: the preferred form or, in lower case, else the other; None if the header has neither.  S and Q insist."""
    codes = {"s": header["hist"]["sform_code"], "q": header["hist"]["qform_code"]}
    if preferred.lower() not in codes:
        raise ValueError("the form is one of s, q, S, Q")
    if preferred.isupper():
        if not codes[preferred.lower()]:
            raise ValueError(f"the header has no {preferred.lower()}form")
        return preferred.lower()
    return next((f for f in (preferred, "q" if preferred == "s" else "s") if codes[f] > 0), None)


def rotation(b: float, c: float, d: float) -> np.ndarray:
    """Rotation matrix of a unit quaternion given without its first part."""
    rest = 1.0 - (b * b + c * c + d * d)
    if rest < 0 and abs(rest) >= 1e-5:
        raise ValueError("the quaternion isn't a unit one")
    a = math.sqrt(max(0.0, rest))
    cross = np.array([[0, -d, c], [d, 0, -b], [-c, b, 0]])
    v = np.array([b, c, d])
    return (a * a - v @ v) * np.eye(3) + 2 * np.outer(v, v) + 2 * a * cross


def affine_of(header: dict, preferred: str = "s") -> tuple[np.ndarray, np.ndarray] | None:
    """(rotation part without and with voxel sizes applied, 4 x 4 affine) of the chosen form; None without a form."""
    form, hist, pixdim = choose_form(header, preferred), header["hist"], header["dime"]["pixdim"]
    if form is None:
        return None
    out = np.eye(4)
    if form == "s":
        out[:3] = [hist["srow_x"], hist["srow_y"], hist["srow_z"]]
        return out[:3, :3].copy(), out
    turn = rotation(hist["quatern_b"], hist["quatern_c"], hist["quatern_d"])
    out[:3, :3] = turn @ np.diag([pixdim[1], pixdim[2], (pixdim[0] or 1.0) * pixdim[3]])
    out[:3, 3] = [hist["qoffset_x"], hist["qoffset_y"], hist["qoffset_z"]]
    return turn, out


def _straight(m: np.ndarray) -> bool:
    """Whether each row and each column has one entry."""
    return bool(((m != 0).sum(0) == 1).all() and ((m != 0).sum(1) == 1).all())


@dataclass(frozen=True)
class Orientation:
    """What a header says about the axes: codes 1-6 of right, front, top, left, back, bottom for each axis, voxel sizes, and the origin as a voxel from 1."""

    codes: tuple[int, int, int]
    voxel_size: tuple[float, float, float]
    origin: tuple[float, float, float]
    affine: np.ndarray | None


def orientation(header: dict, preferred: str = "s", tolerance: float = 0.1) -> Orientation:
    """Orientation after small oblique parts are dropped: entries below ``tolerance`` times the least of the three largest.  What is still oblique is refused."""
    pixdim = [abs(p) for p in header["dime"]["pixdim"][1:4]]
    found = affine_of(header, preferred)
    scale = units(header["dime"]["xyzt_units"])[0]
    if found is None:
        return Orientation((1, 2, 3), tuple(p * scale for p in pixdim), tuple(float(o) for o in header["hist"]["originator"][:3]), None)
    turn, matrix = found
    if not _straight(turn):
        sized = np.diag(1.0 * np.ones(3)) if choose_form(header, preferred) == "s" else np.linalg.inv(turn) @ matrix[:3, :3]
        turn = np.where(np.abs(turn) < tolerance * np.sort(np.abs(turn).ravel())[-3:].min(), 0.0, turn)
        matrix = matrix.copy()
        matrix[:3, :3] = turn @ np.round(sized, 12)
        if not _straight(matrix[:3, :3]):
            raise ValueError("the affine is oblique or sheared; reslice the image, read it raw, or raise the tolerance")
    r = matrix[:3, :3]
    back = np.linalg.inv(r)
    codes = tuple(int(np.flatnonzero(row)[0]) + (1 if row.sum() > 0 else 4) for row in back)
    return Orientation(codes, tuple(np.abs(r.sum(0)) * scale), tuple(back @ -matrix[:3, 3] + 1), matrix)


def flip_left_right(header: dict) -> dict:
    """The header with its first spatial axis reversed in the affine; voxels stay as they are."""
    found = affine_of(header)
    matrix = found[1] if found else np.diag([*header["dime"]["pixdim"][1:4], 1.0])
    mirror = np.diag([-1.0, 1.0, 1.0, 1.0])
    rows = mirror @ matrix
    hist = header["hist"] | {"qform_code": 0, "sform_code": 1} | {f"srow_{a}": [float(v) for v in rows[k]] for k, a in enumerate("xyz")}
    return header | {"hist": hist}


def with_matrix(header: dict, matrix) -> dict:
    """The header with a matrix that maps voxels from 1 put in as its affine (which maps voxels from 0)."""
    m = np.asarray(matrix, float).copy()
    m[:3, 3] += m[:3, :3].sum(1)
    return header | {"hist": header["hist"] | {"qform_code": 0, "sform_code": 1, "magic": header["hist"]["magic"] or "ni1"} | {f"srow_{a}": [float(v) for v in m[k]] for k, a in enumerate("xyz")}}


def scaling(header: dict) -> tuple[float, float, int] | None:
    """(slope, intercept, resulting voxel type) if stored values must be scaled, else None; colours never are."""
    slope, inter, kind = (header["dime"][k] for k in ("scl_slope", "scl_inter", "datatype"))
    if not slope or math.isnan(slope):
        return None
    if kind in SCALED:
        return None if slope == 1 and inter == 0 else (slope, inter, 64 if kind == 64 else 16)
    return (slope, inter, kind) if kind in COMPLEX else None
