"""Expressions with one meaning on every engine: half-even rounding, clipping, cells, boxes, interpolation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell(c: Column | str, size: float) -> Column:
    """The grid cell of a coordinate: floor of a true division, so that edges fall as they do in double precision."""
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(float(size)))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def finite(c: Column) -> Column:
    """Neither null, nor NaN, nor infinite (SQL engines order NaN above every number)."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def norm(*cs: Column) -> Column:
    total = cs[0] * cs[0]
    for c in cs[1:]:
        total = total + c * c
    return F.sqrt(total)


def half_even(c: Column, digits: int = 0) -> Column:
    return F.rint(c * 10**digits) / 10**digits if digits else F.rint(c)


def box_volume(lo: list[Column], hi: list[Column]) -> Column:
    return (hi[0] - lo[0]) * (hi[1] - lo[1]) * (hi[2] - lo[2])


def box_iou(alo: list[Column], ahi: list[Column], blo: list[Column], bhi: list[Column]) -> Column:
    """Intersection over union of two axis-aligned boxes; 0 where the union has no volume."""
    zero = F.lit(0.0)
    sides = [F.greatest(zero, F.least(a1, b1) - F.greatest(a0, b0)) for a0, a1, b0, b1 in zip(alo, ahi, blo, bhi, strict=True)]
    inter = sides[0] * sides[1] * sides[2]
    union = box_volume(alo, ahi) + box_volume(blo, bhi) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def ray_box(origin: list[Column], direction: list[Column], lo: list[Column], hi: list[Column]) -> Column:
    """Distance along a ray to an axis-aligned box by the slab test; null without a hit ahead."""
    near, far = F.lit(float("-inf")), F.lit(float("inf"))
    missed = F.lit(False)
    for o, d, a, b in zip(origin, direction, lo, hi, strict=True):
        flat = d == 0
        t0, t1 = (a - o) / F.when(flat, 1.0).otherwise(d), (b - o) / F.when(flat, 1.0).otherwise(d)
        near = F.when(flat, near).otherwise(F.greatest(near, F.least(t0, t1)))
        far = F.when(flat, far).otherwise(F.least(far, F.greatest(t0, t1)))
        missed = missed | (flat & ((o < a) | (o > b)))
    return F.when(~missed & (far >= near) & (far > 0), F.when(near > 0, near).otherwise(0.0))


def ray_cylinder(dx: Column, dy: Column, centre: float, radius: float) -> Column:
    """Distances along a ray from the origin to the vertical cylinder about (0, centre): an array of those ahead, the nearer first; empty without a hit."""
    k = dx * dx + dy * dy
    k = F.when(k > 0, k)
    middle = dy * centre
    disc = middle * middle - k * (centre * centre - radius * radius)
    half = F.sqrt(F.when(disc >= 0, disc))
    return F.filter(F.array((middle - half) / k, (middle + half) / k), lambda t: t > 0)


def bracket(x: Column, anchors: Column, x_of: str) -> Column:
    """struct(left, right): the anchors on either side of x, of anchors sorted by ``x_of``; null beyond an end.

    Found by array functions on the anchors of the row's own scan; no join. Make it a column where several values are read off it.
    """
    below = F.filter(anchors, lambda a: a[x_of] <= x)
    above = F.filter(anchors, lambda a: a[x_of] > x)
    return F.struct(F.try_element_at(below, F.lit(-1)).alias("left"), F.try_element_at(above, F.lit(1)).alias("right"))


def along(x: Column, between: Column, x_of: str, y_of: str) -> Column:
    """Piecewise-linear value at x between bracketing anchors; clamped at both ends, null without anchors."""
    left, right = between["left"], between["right"]
    slope = (right[y_of] - left[y_of]) / (right[x_of] - left[x_of])
    return F.when(left.isNull(), right[y_of]).when(right.isNull(), left[y_of]).otherwise(left[y_of] + slope * (x - left[x_of]))


def interpolate(x: Column, anchors: Column, x_of: str, y_of: str) -> Column:
    return along(x, bracket(x, anchors, x_of), x_of, y_of)


def euler_matrix(rx: Column, ry: Column, rz: Column) -> list[list[Column]]:
    """Rx · Ry · Rz."""
    cx, sx, cy, sy, cz, sz = F.cos(rx), F.sin(rx), F.cos(ry), F.sin(ry), F.cos(rz), F.sin(rz)
    return [
        [cy * cz, -cy * sz, sy],
        [cx * sz + sx * sy * cz, cx * cz - sx * sy * sz, -sx * cy],
        [sx * sz - cx * sy * cz, sx * cz + cx * sy * sz, cx * cy],
    ]


def oriented_to_aabb(centre: list[Column], size: list[Column], rotation: list[list[Column]]) -> tuple[list[Column], list[Column]]:
    """Axis-aligned bounds of an oriented box: half sizes through the matrix's absolute values."""
    half = [sum((F.abs(rotation[i][j]) * size[j] / 2 for j in range(1, 3)), F.abs(rotation[i][0]) * size[0] / 2) for i in range(3)]
    return [c - h for c, h in zip(centre, half, strict=True)], [c + h for c, h in zip(centre, half, strict=True)]


def in_oriented_box(p: list[Column], centre: list[Column], size: list[Column], rotation: list[list[Column]]) -> Column:
    """Closed membership: |(p - c) · R| <= size / 2 on each of the box's own axes."""
    ok = F.lit(True)
    for j in range(3):
        along = sum(((p[i] - centre[i]) * rotation[i][j] for i in range(1, 3)), (p[0] - centre[0]) * rotation[0][j])
        ok = ok & (F.abs(along) <= size[j] / 2)
    return ok


def rigid(p: list[Column], pose: list[list[float]]) -> list[Column]:
    """A point through a 4 x 4 pose given as numbers."""
    return [p[0] * F.lit(r[0]) + p[1] * F.lit(r[1]) + p[2] * F.lit(r[2]) + F.lit(r[3]) for r in pose[:3]]


def scaled_mad(values: Column, floor: float = 0.0) -> Column:
    """1.4826 times the median absolute deviation of an array, at least ``floor``."""
    # The median is bound once: named in the inner function, it would be found anew for each element.
    off = lambda m: F.transform(values, lambda v: F.abs(v - m))
    return F.greatest(F.lit(1.4826) * F.get(F.transform(F.array(array_median(values)), lambda m: array_median(off(m))), 0), F.lit(floor))


def array_median(values: Column) -> Column:
    """Median of an array without nulls; null for an empty one."""
    n = F.size(values)
    middle = lambda s: (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, F.floor(n / 2).cast("int") + 1)) / 2
    return F.when(n > 0, F.get(F.transform(F.array(F.sort_array(values)), middle), 0))  # sorted once
