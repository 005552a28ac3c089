"""Functions on lines as array<array<double>> (x, y, z) that stay inside Catalyst."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

X, Y, Z = 0, 1, 2


class ExtendFrom(Enum):
    """Which ends of a line are led on."""

    END, START, BOTH, NONE = -1, 0, 1, None

    @classmethod
    def from_bools(cls, *, extend_start: bool, extend_end: bool) -> ExtendFrom:
        return {(True, True): cls.BOTH, (True, False): cls.START, (False, True): cls.END}.get((extend_start, extend_end), cls.NONE)


def _seg(p: Column, q: Column, k: int) -> Column:
    return q[k] - p[k]


def segments(line: Column) -> Column:
    """array<struct<a, b>> of neighbouring vertices."""
    n = F.size(line)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.element_at(line, i).alias("a"), F.element_at(line, i + 1).alias("b"))))


def line_length(line: Column) -> Column:
    return F.aggregate(F.coalesce(segments(line), F.array()), F.lit(0.0), lambda s, g: s + F.hypot(_seg(g["a"], g["b"], X), _seg(g["a"], g["b"], Y)))


def mean_z(line: Column, nodata: float = -999.999) -> Column:
    """Mean of the vertices' z that are not ``nodata`` (S9); null without any."""
    zs = F.filter(F.transform(line, lambda p: p[Z]), lambda z: z.isNotNull() & ~F.isnan(z) & (z != nodata))
    return F.when(F.size(zs) > 0, F.aggregate(zs, F.lit(0.0), lambda s, z: s + z) / F.size(zs))


def bearing(a: Column, b: Column) -> Column:
    """Degrees from north of the vector from ``b`` to ``a``, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(a[X] - b[X], a[Y] - b[Y])) + 360.0, F.lit(360.0))


def direction(a: Column, b: Column) -> Column:
    """Direction of a segment in degrees, 0 to 180, whichever end is first."""
    return F.pmod(F.degrees(F.atan2(_seg(a, b, Y), _seg(a, b, X))) + 180.0, F.lit(180.0))


def mean_direction(line: Column) -> Column:
    """Arithmetic mean of the segments' directions; 0 without a segment."""
    ds = F.transform(F.coalesce(segments(line), F.array()), lambda g: direction(g["a"], g["b"]))
    return F.when(F.size(ds) > 0, F.aggregate(ds, F.lit(0.0), lambda s, d: s + d) / F.size(ds)).otherwise(0.0)


def angle_difference(a: Column, b: Column) -> Column:
    """(S28)"""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def equalize_z(line: Column, method: str) -> Column:
    """Every z set to the least or greatest of them."""
    zs = F.filter(F.transform(line, lambda p: p[Z]), lambda z: z.isNotNull() & ~F.isnan(z))
    z = F.array_min(zs) if method == "min" else F.array_max(zs)
    return F.when(F.size(zs) == 0, line).otherwise(F.transform(line, lambda p: F.array(p[X], p[Y], z)))


def point_on_line(a: Column, b: Column, d: Column) -> Column:
    """``d`` beyond the end if positive, before the start if negative, else the end."""
    size = F.hypot(_seg(a, b, X), _seg(a, b, Y))
    along = lambda p, s: F.array(p[X] + s * _seg(a, b, X) / size, p[Y] + s * _seg(a, b, Y) / size, p[Z])
    return F.when(d > 0, along(b, d)).when(d < 0, along(a, d)).otherwise(b)


def extend(line: Column, d: float, where: ExtendFrom) -> Column:
    """A vertex added beyond either end, or both; NONE counts as both."""
    if d <= 0:
        raise ValueError("distance must be positive")
    start, end = where is not ExtendFrom.END, where is not ExtendFrom.START
    n = F.size(line)
    first = F.array(point_on_line(F.element_at(line, 1), F.element_at(line, 2), F.lit(-float(d))))
    last = F.array(point_on_line(F.element_at(line, n - 1), F.element_at(line, n), F.lit(float(d))))
    return F.concat(*([first] if start else []), line, *([last] if end else []))


def scale_to_length(line: Column, length: float) -> Column:
    """Scaled about the centre of the bounding box."""
    if length <= 0:
        raise ValueError("length must be positive")
    xs, ys = F.transform(line, lambda p: p[X]), F.transform(line, lambda p: p[Y])
    cx, cy = (F.array_min(xs) + F.array_max(xs)) / 2, (F.array_min(ys) + F.array_max(ys)) / 2
    k = F.lit(float(length)) / line_length(line)
    return F.transform(line, lambda p: F.array(cx + (p[X] - cx) * k, cy + (p[Y] - cy) * k, p[Z]))


def insert_vertex(line: Column, vertex: Column, index: int) -> Column:
    """Before position ``index``; a negative one counts from the end."""
    at = F.lit(index) if index >= 0 else F.size(line) + index + 1
    return F.concat(F.slice(line, F.lit(1), at), F.array(vertex), F.slice(line, at + 1, F.size(line) - at))


def orient_toward(line: Column, p: Column, at_end: bool) -> Column:
    """Reversed if needed so that ``p`` is its end, or start."""
    same = lambda q: (q[X] == p[X]) & (q[Y] == p[Y])
    wrong = same(F.element_at(line, 1 if at_end else -1))
    return F.when(wrong, F.reverse(line)).otherwise(line)


def concatenate(a: Column, b: Column) -> Column:
    """One line of both, the shared vertex once."""
    joint = F.element_at(a, -1)
    first = F.element_at(b, 1)
    same = (joint[X] == first[X]) & (joint[Y] == first[Y])
    return F.concat(a, F.when(same, F.slice(b, F.lit(2), F.size(b) - 1)).otherwise(b))
