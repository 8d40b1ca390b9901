"""Camera and pose arithmetic."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn import constants as K

ROUNDS = 5


def undistort(u: Column, v: Column, cam: tuple) -> tuple[Column, Column]:
    """A pixel without the lens distortion: five fixed-point rounds; as it is without coefficients."""
    fx, fy, cx, cy, _, _, k1, k2, k3, p1, p2 = cam
    if not any((k1, k2, k3, p1, p2)):
        return u, v
    start = F.struct(((u - cx) / fx).alias("x"), ((v - cy) / fy).alias("y"))

    def step(a: Column, _: Column) -> Column:
        x, y = a["x"], a["y"]
        r2 = x * x + y * y
        radial = 1 + k1 * r2 + k2 * (r2 * r2) + k3 * (r2 * r2 * r2)
        dx = 2 * p1 * x * y + p2 * (r2 + 2 * x * x)
        dy = p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
        return F.struct((((u - cx) / fx - dx) / radial).alias("x"), (((v - cy) / fy - dy) / radial).alias("y"))

    got = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
    return got["x"] * fx + cx, got["y"] * fy + cy


def unproject(u: Column, v: Column, depth: Column, cam: tuple) -> tuple[Column, Column, Column]:
    """The camera point of a pixel at a depth along the axis, without the lens distortion."""
    fx, fy, cx, cy = cam[:4]
    u, v = undistort(u, v, cam) if len(cam) > 6 else (u, v)
    return (u - cx) / fx * depth, (v - cy) / fy * depth, depth


def project(x: Column, y: Column, z: Column, cam: tuple) -> tuple[Column, Column]:
    """The pixel of a camera point; nulls behind the camera or outside the image."""
    fx, fy, cx, cy, w, h = cam[:6]
    u, v = fx * x / z + cx, fy * y / z + cy
    seen = (z > 0) & (u >= 0) & (u < w) & (v >= 0) & (v < h)
    return F.when(seen, u), F.when(seen, v)


def scaled(cam: tuple, width: int, height: int) -> tuple:
    """The camera for an image of another size."""
    sx, sy = width / cam[4], height / cam[5]
    return (cam[0] * sx, cam[1] * sy, cam[2] * sx, cam[3] * sy, width, height, *cam[6:])


def intrinsic_matrix(cam: tuple) -> list[list[float]]:
    """The 3 x 3 matrix of a camera, by rows."""
    fx, fy, cx, cy = cam[:4]
    return [[fx, 0.0, cx], [0.0, fy, cy], [0.0, 0.0, 1.0]]


def camera_of(matrix: bytes | None, width: int, height: int, otherwise: str = "phone_14") -> tuple:
    """The camera of a 3 x 3 matrix of little-endian single-precision numbers, by columns; the named one where there is none."""
    if matrix is None or len(matrix) < 36:
        return K.CAMERAS[otherwise]
    m = struct.unpack_from("<9f", matrix)
    return (m[0], m[4], m[6], m[7], width, height, 0.0, 0.0, 0.0, 0.0, 0.0)


def rotate(q: tuple[Column, ...], p: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    """A vector turned by a unit quaternion (x, y, z, w)."""
    qx, qy, qz, qw = q
    x, y, z = p
    tx, ty, tz = 2 * (qy * z - qz * y), 2 * (qz * x - qx * z), 2 * (qx * y - qy * x)
    return x + qw * tx + qy * tz - qz * ty, y + qw * ty + qz * tx - qx * tz, z + qw * tz + qx * ty - qy * tx


def transform(q: tuple, t: tuple, p: tuple) -> tuple[Column, Column, Column]:
    """R p + t."""
    return tuple(a + b for a, b in zip(rotate(q, p), t, strict=True))


def inverse_transform(q: tuple, t: tuple, p: tuple) -> tuple[Column, Column, Column]:
    """R' (p - t)."""
    return rotate((-q[0], -q[1], -q[2], q[3]), tuple(a - b for a, b in zip(p, t, strict=True)))


POSE = ("px", "py", "pz", "qx", "qy", "qz", "qw")


def pose_json(*fields: Column) -> Column:
    """A pose as a JSON object of its seven numbers."""
    return F.to_json(F.struct(*(c.cast("double").alias(n) for n, c in zip(POSE, fields, strict=True))))


def pose_of(text: Column) -> Column:
    """The pose of a JSON object; null for what isn't one."""
    return F.from_json(text, ", ".join(f"{n} double" for n in POSE))


def matrix(q: tuple[Column, ...]) -> list[list[Column]]:
    """The rotation matrix of a unit quaternion, by rows."""
    x, y, z, w = q
    return [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]


def quaternion(m: list[list[Column]]) -> Column:
    """The unit quaternion (x, y, z, w) of a rotation matrix, by its largest component."""
    trace = m[0][0] + m[1][1] + m[2][2]

    def of(s: Column, *parts: Column) -> Column:
        return F.array(*(p / s for p in parts))

    def root(c: Column) -> Column:
        return 2 * F.sqrt(F.greatest(F.lit(0.0), c))

    s0, sx = root(1 + trace), root(1 + m[0][0] - m[1][1] - m[2][2])
    sy, sz = root(1 + m[1][1] - m[0][0] - m[2][2]), root(1 + m[2][2] - m[0][0] - m[1][1])
    by_w = of(s0, m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1], s0 * s0 / 4)
    by_x = of(sx, sx * sx / 4, m[0][1] + m[1][0], m[0][2] + m[2][0], m[2][1] - m[1][2])
    by_y = of(sy, m[0][1] + m[1][0], sy * sy / 4, m[1][2] + m[2][1], m[0][2] - m[2][0])
    by_z = of(sz, m[0][2] + m[2][0], m[1][2] + m[2][1], sz * sz / 4, m[1][0] - m[0][1])
    return F.when(trace > 0, by_w).when((m[0][0] > m[1][1]) & (m[0][0] > m[2][2]), by_x).when(m[1][1] > m[2][2], by_y).otherwise(by_z)
