"""Affine algebra: constant matrices folded on the driver, and column expressions over six numbers.

Constant 4x4 matrices are numpy arrays applied to (x, y, z, 1) columns; 2x3 alignment
matrices that differ by row are the six columns ``m00 m01 m02 m10 m11 m12``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SIX = ("m00", "m01", "m02", "m10", "m11", "m12")
TINY = 1e-9


def identity() -> np.ndarray:
    return np.eye(4)


def translate(x: float, y: float, z: float) -> np.ndarray:
    m = np.eye(4)
    m[:3, 3] = x, y, z
    return m


def scale(x: float, y: float, z: float) -> np.ndarray:
    """A factor of zero becomes tiny, so that the matrix keeps an inverse."""
    return np.diag([x or TINY, y or TINY, z or TINY, 1.0])


def rotate(axis: str, degrees: float) -> np.ndarray:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    i, j = {"x": (1, 2), "y": (2, 0), "z": (0, 1)}[axis]
    m = np.eye(4)
    m[i, i] = m[j, j] = c
    m[i, j], m[j, i] = -s, s
    return m


def shear(of: str, along: str, amount: float) -> np.ndarray:
    m = np.eye(4)
    m["xyz".index(of), "xyz".index(along)] = amount
    return m


def product(steps: list[np.ndarray]) -> np.ndarray:
    """One matrix for steps in the order they are applied."""
    out = np.eye(4)
    for step in steps:
        out = step @ out
    return out


def parse(text: str) -> np.ndarray:
    """``translate 1 2 3; rotate y 30; scale 1 1 0.5``: steps in application order."""
    steps = []
    for part in filter(None, (p.split() for p in text.split(";"))):
        name, arguments = part[0].lower(), part[1:]
        if name in ("translate", "scale"):
            steps.append({"translate": translate, "scale": scale}[name](*map(float, arguments)))
        elif name == "rotate":
            steps.append(rotate(arguments[0], float(arguments[1])))
        elif name == "shear":
            steps.append(shear(arguments[0], arguments[1], float(arguments[2])))
        else:
            raise ValueError(f"unknown step {name}")
    return product(steps)


def apply(m: np.ndarray, x: Column, y: Column, z: Column) -> list[Column]:
    """Transformed coordinates as columns; terms with zero factors are left out."""
    out = []
    for row in m[:3]:
        value = F.lit(float(row[3]))
        for k, c in zip(row[:3], (x, y, z)):
            if k:
                value = value + F.lit(float(k)) * c
        out.append(value)
    return out


def deskew(step: float, pixel: float, degrees: float, height: int) -> np.ndarray:
    """Raw (x, y, z) to deskewed voxels, isotropic at the pixel pitch, moved so that the volume starts at zero."""
    a = math.radians(degrees)
    m = np.eye(4)
    m[1, 1], m[1, 2] = math.cos(a), step / pixel
    m[2, 1], m[2, 2] = -math.sin(a), 0.0
    m[2, 3] = math.sin(a) * (height - 1)
    return m


def deskew_columns(step: Column, pixel: Column, degrees: Column) -> dict[str, Column]:
    """The entries of a deskew matrix that depend on the acquisition."""
    a = F.radians(degrees)
    return {"yy": F.cos(a), "yz": step / pixel, "zy": -F.sin(a)}


def recovered_geometry(yy: Column, yz: Column, zy: Column, pixel: Column) -> dict[str, Column]:
    """Angle and step of a deskew matrix; NULL where sine and cosine disagree by over 1 %."""
    consistent = F.abs(yy * yy + zy * zy - 1) <= 0.01
    return {"angle": F.when(consistent, F.degrees(F.atan2(-zy, yy))), "step": F.when(consistent, yz * pixel)}


def corner_box(m: np.ndarray, width: Column, height: Column, depth: Column) -> dict[str, Column]:
    """Bounds and ceiled size of a transformed box."""
    corners = [apply(m, x, y, z) for x in (F.lit(0), width) for y in (F.lit(0), height) for z in (F.lit(0), depth)]
    out = {}
    for i, k in enumerate("xyz"):
        values = F.array(*[c[i] for c in corners])
        out[f"min_{k}"], out[f"size_{k}"] = F.array_min(values), F.ceil(F.array_max(values) - F.array_min(values) - 1e-9)
    return out


def raw_indices(m: np.ndarray, x: Column, y: Column, z: Column) -> list[Column]:
    """Deskewed points back to raw indices: rounded, negative rows and planes are zero."""
    rx, ry, rz = apply(np.linalg.inv(m), x, y, z)
    up = lambda c: F.floor(c + 0.5).cast("long")
    return [up(rx), F.greatest(up(ry), F.lit(0)).cast("long"), F.greatest(up(rz), F.lit(0)).cast("long")]


def mat(prefix: str = "") -> list[Column]:
    return [F.col(prefix + k) for k in SIX]


def point2(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def inverse2(m: list[Column]) -> list[Column]:
    det = m[0] * m[4] - m[1] * m[3]
    a, b, c, d = m[4] / det, -m[1] / det, -m[3] / det, m[0] / det
    return [a, b, -(a * m[2] + b * m[5]), c, d, -(c * m[2] + d * m[5])]


def product2(a: list[Column], b: list[Column]) -> list[Column]:
    """First b, then a."""
    return [
        a[0] * b[0] + a[1] * b[3], a[0] * b[1] + a[1] * b[4], a[0] * b[2] + a[1] * b[5] + a[2],
        a[3] * b[0] + a[4] * b[3], a[3] * b[1] + a[4] * b[4], a[3] * b[2] + a[4] * b[5] + a[5],
    ]


def mirror_x(width: Column) -> list[Column]:
    zero, one = F.lit(0.0), F.lit(1.0)
    return [-one, zero, width - 1, zero, one, zero]


def mirrored(m: list[Column], width: Column) -> list[Column]:
    """The inverse alignment seen in a mirrored frame: F * inverse(M) * F."""
    f = mirror_x(width)
    return product2(f, product2(inverse2(m), f))


def reframed(m: list[Column], reference: list[Column], width: Column) -> list[Column]:
    """Alignment in the frame of another reference: F * inverse(A) * M * F."""
    f = mirror_x(width)
    return product2(f, product2(inverse2(reference), product2(m, f)))


def about_centre(degrees: Column, dx: Column, dy: Column, width: Column, height: Column) -> list[Column]:
    """Rotation about the image centre and a shift."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    cx, cy = (width - 1) / 2.0, (height - 1) / 2.0
    return [c, -s, cx - c * cx + s * cy + dx, s, c, cy - s * cx - c * cy + dy]


def near_identity(m: list[Column], eps: float = 1e-6) -> Column:
    wanted = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    return F.forall(F.array(*[F.abs(a - w) <= eps * F.greatest(F.lit(1.0), F.abs(a)) for a, w in zip(m, wanted)]), lambda x: x)


def plausible(m: list[Column], degrees: float = 2.0, shift_x: float = 80.0, shift_y: float = 35.0) -> Column:
    """Finite, not collapsed, a rotation rather than a shear, and within bounds."""
    finite = F.forall(F.array(*m), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    turn = F.abs(F.degrees(F.atan2(m[3], m[0]))) <= degrees
    return F.coalesce(
        finite & (F.abs(m[0] * m[4] - m[1] * m[3]) >= 0.5) & (m[1] * m[3] <= 0) & turn & (F.abs(m[2]) <= shift_x) & (F.abs(m[5]) <= shift_y), F.lit(False)
    )


def worst_displacement(m: list[Column], width: Column, height: Column) -> Column:
    """Largest shift of the four corners: the bound of approximating the alignment at mid-axis."""
    moves = []
    for x in (F.lit(0.0), width - 1):
        for y in (F.lit(0.0), height - 1):
            px, py = point2(m, x, y)
            moves.append(F.hypot(px - x, py - y))
    return F.array_max(F.array(*moves))


def source_to_world(m: np.ndarray, level: int) -> np.ndarray:
    """Index matrix of a reduced level: voxels stand for their centres, half a voxel is conjugated out."""
    half = (level - 1) / 2
    pick = np.diag([float(level)] * 3 + [1.0])
    pick[:3, 3] = half
    return translate(-0.5, -0.5, -0.5) @ m @ translate(0.5, 0.5, 0.5) @ pick


def orthogonal(m: list[Column], axis: str, width: Column, height: Column) -> dict[str, list[Column] | Column]:
    """Alignment of an X or Y projection at the middle of the collapsed axis.

    ``matrix`` acts on the projection's image, ``flip`` says whether the image is mirrored first, and
    ``spread`` is the worst displacement against aligning the volume. A Y image (x, z) keeps the scale
    along x and the offset at the middle row; an X image (z, y) those along y at the middle column.
    """
    zero, one = F.lit(0.0), F.lit(1.0)
    if axis == "y":
        middle = (height - 1) / 2.0
        return {"matrix": [m[0], zero, m[1] * middle + m[2], zero, one, zero], "flip": F.lit(True), "spread": F.abs(m[1]) * middle}
    if axis == "x":
        middle = (width - 1) / 2.0
        return {"matrix": [one, zero, zero, zero, m[4], m[3] * middle + m[5]], "flip": F.lit(False), "spread": F.abs(m[3]) * middle}
    raise ValueError(f"a {axis} projection carries the alignment itself")
