"""Derivatives of transformed points by a pose's update, and small eigenvectors, as column expressions.

Updates are applied on the left (exp(e) x pose); columns of a Jacobian are the
update's numbers, rotation first, as everywhere here.  Matrices are row-major arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .camera import invert_rigid, light, transform_point


def _hat(p: Column) -> list[list[Column]]:
    """Cross-product matrix of a point (x, y, z)."""
    zero = F.lit(0.0)
    return [[zero, -p["z"], p["y"]], [p["z"], zero, -p["x"]], [-p["y"], p["x"], zero]]


def turn_derivative(p: Column) -> Column:
    """d (exp(w) p) / d w at w = 0, 3 x 3: column k is the point's velocity when it turns about axis k."""
    return F.array(*[-v for row in _hat(p) for v in row])


def _rotated(m: Column, rows: list[list[Column]], turned: bool) -> Column:
    """The matrix's rotation (or its transpose) times a 3 x n matrix."""
    cell = lambda r, c: m[4 * c + r] if turned else m[4 * r + c]
    return F.array(*[sum((cell(r, k) * rows[k][c] for k in range(1, 3)), cell(r, 0) * rows[0][c]) for r in range(3) for c in range(len(rows[0]))])


def _unit(sign: float) -> list[list[Column]]:
    return [[F.lit(sign if r == c else 0.0) for c in range(3)] for r in range(3)]


def first_derivative(a: Column, d: Column, x: Column, y: Column, z: Column) -> Column:
    """d ((a exp(e) d)^-1 p) / d e at 0, 3 x 6: with q = a^-1 p it is d's rotation, transposed, times [hat(q), -1]."""
    q = transform_point(invert_rigid(a), x, y, z)
    return _rotated(d, [h + u for h, u in zip(_hat(q), _unit(-1.0))], True)


def second_derivative(a: Column, d: Column, x: Column, y: Column, z: Column) -> Column:
    """d (a exp(e) d p) / d e at 0, 3 x 6: with q = d p it is a's rotation times [-hat(q), 1]."""
    q = transform_point(d, x, y, z)
    return _rotated(a, [[-v for v in h] + u for h, u in zip(_hat(q), _unit(1.0))], False)


def eigenvector(m: Column, value: Column) -> Column:
    """Unit eigenvector of a symmetric 3 x 3 matrix for a simple eigenvalue: the longest cross product of two rows of m - value; null for a multiple one."""
    row = lambda r: [m[3 * r + c] - (value if r == c else F.lit(0.0)) for c in range(3)]
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    found = []
    for r, s in ((0, 1), (0, 2), (1, 2)):
        v = cross(row(r), row(s))
        found.append(F.struct(sum((c * c for c in v[1:]), v[0] * v[0]).alias("n"), F.array(*v).alias("v")))
    longest = F.array_max(F.array(*found))
    scale = F.greatest(F.lit(1e-300), F.aggregate(m, F.lit(0.0), lambda s, c: s + c * c))
    return F.when(longest["n"] > 1e-20 * scale * scale, F.transform(longest["v"], lambda c: c / F.sqrt(longest["n"])))


def shading(albedo: Column, coefficients: Column, nx: Column, ny: Column, nz: Column) -> Column:
    """Albedo times lighting of the normal, kept within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), albedo * light(coefficients, nx, ny, nz)))
