"""Column functions of the pinhole camera, colours and small algebra."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Camera:
    """Focal lengths, principal point, image size and depth range."""

    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int
    near: float = 0.1
    far: float = 8.0

    def back_project(self, u: Column, v: Column, depth: Column) -> Column:
        """Camera-space point of a pixel; null depth gives null coordinates."""
        return F.struct(((u - self.cx) / self.fx * depth).alias("x"), ((v - self.cy) / self.fy * depth).alias("y"), depth.alias("z"))

    def project(self, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
        """Pixel coordinates; null where the point is not in front of the camera."""
        ahead = F.when(z > 0, z)
        return x * self.fx / ahead + self.cx, y * self.fy / ahead + self.cy

    def pixel(self, x: Column, y: Column, z: Column) -> tuple[Column, Column]:
        """Integer pixel: half is added, then the fraction is cut toward zero."""
        u, v = self.project(x, y, z)
        return (u + 0.5).cast("int"), (v + 0.5).cast("int")

    def inside(self, u: Column, v: Column) -> Column:
        return u.between(0, self.width - 1) & v.between(0, self.height - 1)

    def unit_depth(self, z: Column) -> Column:
        """Depth as a share of the range."""
        return (z - self.near) / (self.far - self.near)

    def device(self, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        """Normalised device coordinates: the image is [-1, 1] x [-1, 1], y up."""
        u, v = self.project(x, y, z)
        return 2 * u / (self.width - 1) - 1, 1 - 2 * v / (self.height - 1), self.unit_depth(z)

    def in_frustum(self, x: Column, y: Column, z: Column, scale: float = 0.95) -> Column:
        """Whether a point projects into the image shrunk by ``scale``."""
        a, b, c = (d * scale for d in self.device(x, y, z))
        return F.coalesce(a.between(-1, 1) & b.between(-1, 1) & c.between(0, 1), F.lit(False))


def transform_point(m: Column, x: Column, y: Column, z: Column) -> Column:
    """A row-major 4 x 4 matrix (array of 16) times a point."""
    row = lambda i: m[4 * i] * x + m[4 * i + 1] * y + m[4 * i + 2] * z + m[4 * i + 3]
    return F.struct(row(0).alias("x"), row(1).alias("y"), row(2).alias("z"))


def multiply(a: Column, b: Column) -> Column:
    """Product of two row-major 4 x 4 matrices."""
    return F.array(*[sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)])


def invert_rigid(m: Column) -> Column:
    """Inverse of a rigid transform: transposed rotation, translation carried back."""
    cells = []
    for i in range(3):
        cells += [m[i], m[4 + i], m[8 + i], -(m[i] * m[3] + m[4 + i] * m[7] + m[8 + i] * m[11])]
    return F.array(*cells, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def quaternion(m: Column) -> Column:
    """(qx, qy, qz, qw) of a rigid transform, by its largest diagonal combination."""
    r = lambda i, j: m[4 * i + j]
    trace = r(0, 0) + r(1, 1) + r(2, 2)
    q = lambda x, y, z, w: F.struct(x.alias("qx"), y.alias("qy"), z.alias("qz"), w.alias("qw"))
    s0 = F.sqrt(F.greatest(trace + 1, F.lit(0.0))) * 2
    s1, s2, s3 = (F.sqrt(F.greatest(1 + r(i, i) - r(j, j) - r(k, k), F.lit(0.0))) * 2 for i, j, k in ((0, 1, 2), (1, 0, 2), (2, 0, 1)))
    return (
        F.when(trace > 0, q((r(2, 1) - r(1, 2)) / s0, (r(0, 2) - r(2, 0)) / s0, (r(1, 0) - r(0, 1)) / s0, s0 / 4))
        .when((r(0, 0) > r(1, 1)) & (r(0, 0) > r(2, 2)), q(s1 / 4, (r(0, 1) + r(1, 0)) / s1, (r(0, 2) + r(2, 0)) / s1, (r(2, 1) - r(1, 2)) / s1))
        .when(r(1, 1) > r(2, 2), q((r(0, 1) + r(1, 0)) / s2, s2 / 4, (r(1, 2) + r(2, 1)) / s2, (r(0, 2) - r(2, 0)) / s2))
        .otherwise(q((r(0, 2) + r(2, 0)) / s3, (r(1, 2) + r(2, 1)) / s3, s3 / 4, (r(1, 0) - r(0, 1)) / s3))
    )


def rotation_angle(m: Column) -> Column:
    """How far the rotation turns the diagonal direction (1, 1, 1)."""
    total = sum((m[4 * i + j] for i in range(3) for j in range(3)), F.lit(0.0))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total / 3)))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Intensity in [0, 1] of 8-bit colours."""
    return (0.299 * r + 0.587 * g + 0.114 * b) / 255


def gauss(sigma: float, *deltas: Column) -> Column:
    """Unnormalised Gaussian weight of a distance."""
    return F.exp(-sum((d * d for d in deltas), F.lit(0.0)) / (2.0 * sigma * sigma))


def bilinear(values: list[Column], a: Column, b: Column) -> Column:
    """Weighted mean of the corners (00, 10, 01, 11) that are not null."""
    weights = [(1 - a) * (1 - b), a * (1 - b), (1 - a) * b, a * b]
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in zip(values, weights)), F.lit(0.0))
    mean = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in zip(values, weights)), F.lit(0.0))
    return F.when(total > 0, mean / total)


def hue_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """Colour of hue in degrees, saturation and value."""
    c = v * s
    x = c * (1 - F.abs(F.pmod(h / 60, F.lit(2.0)) - 1))
    m = v - c
    zero = F.lit(0.0)
    sextant = F.floor(F.pmod(h, F.lit(360.0)) / 60)
    rgb = lambda r, g, b: F.struct((r + m).alias("r"), (g + m).alias("g"), (b + m).alias("b"))
    return F.when(sextant == 0, rgb(c, x, zero)).when(sextant == 1, rgb(x, c, zero)).when(sextant == 2, rgb(zero, c, x)).when(sextant == 3, rgb(zero, x, c)).when(sextant == 4, rgb(x, zero, c)).otherwise(rgb(c, zero, x))


def depth_to_rgb(depth: Column, near: float, far: float) -> Column:
    """Depth as a hue; null outside the range."""
    return F.when(depth.between(near, far), hue_to_rgb((depth - near) / (far - near) * 240.0, F.lit(1.0), F.lit(1.0)))


def zero_crossing(t0: Column, t1: Column, d0: Column, d1: Column) -> Column:
    """Where the line through (t0, d0) and (t1, d1) is zero."""
    return t0 + d0 / F.when(d0 != d1, d0 - d1) * (t1 - t0)


def edge_vertex(p1: Column, p2: Column, d1: Column, d2: Column, close: float = 1e-5) -> Column:
    """A coordinate on an edge where the distance is zero; ends within ``close`` of zero are taken as they are."""
    return F.when(F.abs(d1) < close, p1).when(F.abs(d2) < close, p2).when(F.abs(d1 - d2) < close, p1).otherwise(p1 - d1 / (d2 - d1) * (p2 - p1))


def light(coefficients: Column, nx: Column, ny: Column, nz: Column) -> Column:
    """Second-order spherical harmonics lighting of a normal (nine coefficients)."""
    basis = F.array(F.lit(1.0), ny, nz, nx, nx * ny, ny * nz, 3 * nz * nz - 1, nx * nz, nx * nx - ny * ny)
    return F.aggregate(F.zip_with(coefficients, basis, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def screen_jacobian(fx: float, fy: float, x: Column, y: Column, z: Column) -> Column:
    """Derivative of the projection, 2 x 3, row-major."""
    return F.array(fx / z, F.lit(0.0), -x * fx / (z * z), F.lit(0.0), fy / z, -y * fy / (z * z))


def dense_weight(count: Column) -> Column:
    """Weight of a pair's dense term: nothing below 800 matches, then falling with their logarithm down to 1/9."""
    return F.when(count < 800, F.lit(0.0)).otherwise(1 / F.least(F.ln(count), F.lit(9.0)))
