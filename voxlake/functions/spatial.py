"""Volumes as arrays: affine maps round the centre, interpolation, halving.  Arrays are indexed z, y, x; places are rows x, y, z."""

from __future__ import annotations

import math

import numpy as np


def grid(shape: tuple[int, int, int]) -> np.ndarray:
    """(3, voxels): the places of a volume's voxels, x fastest."""
    z, y, x = np.indices(shape)
    return np.stack([x.reshape(-1), y.reshape(-1), z.reshape(-1)]).astype(float)


def centre(shape: tuple[int, int, int]) -> np.ndarray:
    return (np.array(shape[::-1], float) - 1) / 2


def rotation(angles) -> np.ndarray:
    """Turns by three angles, in radians, round x, then y, then z."""
    (cx, cy, cz), (sx, sy, sz) = [math.cos(a) for a in angles], [math.sin(a) for a in angles]
    return np.array([[cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx], [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx], [-sy, cy * sx, cy * cx]])


def _scales(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scales, shears) of twelve numbers."""
    shear = np.eye(3)
    shear[0, 1], shear[0, 2], shear[1, 2] = p[9:12]
    return np.diag(np.exp(p[6:9])), shear


def affine(params, middle: np.ndarray, size=(1.0, 1.0, 1.0)) -> np.ndarray:
    """A 4 x 4 map of voxels to voxels about ``middle``: angles, shifts in millimetres, then logarithms of three scales and three shears, as many as are given."""
    p, size, out = np.zeros(12), np.asarray(size, float), np.zeros((4, 4))
    p[: len(params)] = params
    linear = rotation(p[:3].tolist())
    if any(p[6:].tolist()):
        scale, shear = _scales(p)
        linear = linear @ scale @ shear
    linear = linear * size / size[:, None]
    out[:3, :3], out[:3, 3], out[3, 3] = linear, middle + p[3:6] / size - linear @ middle, 1
    return out


def _cross(v: np.ndarray) -> np.ndarray:
    return np.array([[0.0, -v[2], v[1]], [v[2], 0.0, -v[0]], [-v[1], v[0], 0.0]])


def affine_slopes(p: np.ndarray, dof: int, size=(1.0, 1.0, 1.0)) -> np.ndarray:
    """(dof, 3, 4): change of ``affine`` with each of the first ``dof`` of twelve numbers, for places from the middle on."""
    size, turn, (scale, shear), out = np.asarray(size, float), rotation(p[:3].tolist()), _scales(p), np.zeros((max(dof, 6), 3, 4))
    rest, unit = scale @ shear, np.eye(3)
    linear = turn @ rest
    # turns round x come first, so theirs stands on the right; the axis of y has been turned round z
    out[0, :, :3], out[1, :, :3], out[2, :, :3] = turn @ _cross(unit[0]) @ rest, _cross([-math.sin(p[2]), math.cos(p[2]), 0.0]) @ linear, _cross(unit[2]) @ linear
    for k in range(6, min(dof, 9)):
        out[k, :, :3] = turn @ scale @ np.diag(unit[k - 6]) @ shear
    for k, (i, j) in zip(range(9, dof), ((0, 1), (0, 2), (1, 2)), strict=False):
        out[k, :, j] = (turn @ scale)[:, i]
    out[:, :, :3] *= size / size[:, None]
    out[3:6, :, 3] = np.diag(1 / size)
    return out[:dof]


def at(matrix: np.ndarray, places: np.ndarray) -> np.ndarray:
    return matrix[:3, :3] @ places + matrix[:3, 3:]


def inside(shape: tuple[int, int, int], places: np.ndarray, edge: float = 1e-6) -> np.ndarray:
    x, y, z = (places >= -edge) & (places <= np.array(shape[::-1])[:, None] - 1 + edge)
    return x & y & z


def _taps(volume: np.ndarray, places: np.ndarray, weights: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """Sum of the voxels from ``first`` on, weighted along each axis; beyond the edge the last voxel goes on."""
    nz, ny, nx = volume.shape
    flat, out, n = volume.reshape(-1), np.zeros(places.shape[1]), len(weights)
    xs, ys, zs = ([np.clip(first[a] + k, 0, m - 1) for k in range(n)] for a, m in enumerate((nx, ny, nz)))
    for k in range(n):
        plane = np.zeros(places.shape[1])
        for j in range(n):
            row = (zs[k] * ny + ys[j]) * nx
            line = sum(weights[i][0] * flat[row + xs[i]] for i in range(n))
            plane += weights[j][1] * line
        out += weights[k][2] * plane
    return out


def linear(volume: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Trilinear interpolation."""
    first = np.floor(places).astype(np.int64)
    part = places - first
    return _taps(volume, places, [1 - part, part], first)


def cells(volume: np.ndarray) -> np.ndarray:
    """(8, cells): the corners of every cell of a volume whose edge voxels are given twice, for ``in_cells``.  Worked out once, it serves many maps of one volume."""
    v = np.pad(volume, 1, mode="edge")
    ends = [(slice(None, -1), slice(1, None))] * 3
    return np.stack([v[z, y, x].reshape(-1) for z in ends[0] for y in ends[1] for x in ends[2]])


def _in_cells(corners: np.ndarray, shape: tuple[int, int, int], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corners of the cell of each place, where in the cell it lies)."""
    first = np.floor(places)
    nx, ny = shape[2] + 1, shape[1] + 1
    place = first[0] + nx * (first[1] + ny * first[2]) + (1 + nx * (1 + ny))
    return corners.take(place.astype(np.int64), axis=1), places - first


def in_cells(corners: np.ndarray, shape: tuple[int, int, int], places: np.ndarray) -> np.ndarray:
    """``linear`` at places inside the volume, from its ``cells``."""
    v, part = _in_cells(corners, shape, places)
    for half, share in zip((4, 2, 1), part[::-1], strict=True):
        away = v[half:] - v[:half]
        away *= share
        away += v[:half]
        v = away
    return v[0]


def slopes_in_cells(corners: np.ndarray, shape: tuple[int, int, int], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(``in_cells``, its change along x, y and z as rows)."""
    v, (x, y, z) = _in_cells(corners, shape, places)
    along_z = v[4:] - v[:4]
    v = v[:4] + z * along_z
    along_y = v[2:] - v[:2]
    v, along_z = v[:2] + y * along_y, along_z[:2] + y * (along_z[2:] - along_z[:2])
    along_x = v[1] - v[0]
    return v[0] + x * along_x, np.stack([along_x, along_y[0] + x * (along_y[1] - along_y[0]), along_z[0] + x * (along_z[1] - along_z[0])])


def _cubic_weights(u: np.ndarray) -> list[np.ndarray]:
    return [((2 - u) * u - 1) * u / 2, ((3 * u - 5) * u * u + 2) / 2, ((4 - 3 * u) * u + 1) * u / 2, (u - 1) * u * u / 2]


def cubic(volume: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Cubic convolution over four voxels along each axis."""
    first = np.floor(places).astype(np.int64)
    return _taps(volume, places, _cubic_weights(places - first), first - 1)


def edged(volume: np.ndarray) -> np.ndarray:
    """A volume whose edge voxels are given three times, for ``cubic_in``."""
    return volume[np.ix_(*(np.clip(np.arange(-2, n + 2), 0, n - 1) for n in volume.shape))]


def cubic_in(wide: np.ndarray, places: np.ndarray, at_once: int = 2048) -> np.ndarray:
    """``cubic`` at places inside a volume, from the ``edged`` one; all 64 voxels of ``at_once`` places are read together."""
    _, ny, nx = wide.shape
    first, out, k = np.floor(places), np.empty(places.shape[1]), np.arange(4)
    weights = np.stack(_cubic_weights(places - first))
    starts = (first[0] + nx * (first[1] + ny * first[2]) + (1 + nx * (1 + ny))).astype(np.int64)
    flat, taps = wide.reshape(-1), (nx * (ny * k[:, None, None] + k[:, None]) + k).reshape(-1, 1)
    for i in range(0, len(out), at_once):
        v, part = flat.take(starts[i : i + at_once] + taps), slice(i, i + at_once)
        v = np.einsum("kmn,kn->mn", v.reshape(4, 16, -1), weights[:, 2, part])
        v = np.einsum("kmn,kn->mn", v.reshape(4, 4, -1), weights[:, 1, part])
        out[part] = np.einsum("kn,kn->n", v, weights[:, 0, part])
    return out


def halved(volume: np.ndarray) -> np.ndarray:
    """Means of cells of two voxels along each axis; an odd last voxel makes a cell of its own."""
    out = volume
    for axis in range(3):
        n = out.shape[axis]
        starts = np.arange(0, n, 2)
        out = np.add.reduceat(out, starts, axis) / np.minimum(2, n - starts).reshape([-1 if a == axis else 1 for a in range(3)])
    return out
