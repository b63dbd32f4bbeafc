"""Planar geometry as column expressions. A point is a pair of columns (x, y); a segment is a pair of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]
Segment = tuple[Point, Point]


def pt(x: str | Column, y: str | Column) -> Point:
    as_col = lambda c: F.col(c).cast("double") if isinstance(c, str) else c
    return as_col(x), as_col(y)


def struct(p: Point) -> Column:
    return F.struct(p[0].alias("x"), p[1].alias("y"))


def add(a: Point, b: Point) -> Point:
    return a[0] + b[0], a[1] + b[1]


def sub(a: Point, b: Point) -> Point:
    return a[0] - b[0], a[1] - b[1]


def scale(a: Point, k: Column | float) -> Point:
    return a[0] * k, a[1] * k


def mul_pairwise(a: Point, b: Point) -> Point:
    return a[0] * b[0], a[1] * b[1]


def dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1]


def cross(a: Point, b: Point) -> Column:
    return a[0] * b[1] - a[1] * b[0]


def magnitude(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Point, b: Point) -> Column:
    return magnitude(sub(a, b))


def vector(s: Segment) -> Point:
    return sub(s[1], s[0])


def length(s: Segment) -> Column:
    return magnitude(vector(s))


def angle_to(a: Point, b: Point) -> Column:
    """Unsigned angle between two vectors, 0 where either is zero."""
    size = magnitude(a) * magnitude(b)
    return F.when(size == 0, 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(size, F.lit(0.0))))))


def signed_angle(a: Point, b: Point) -> Column:
    """Difference of the two directions, not wrapped."""
    return F.atan2(b[1], b[0]) - F.atan2(a[1], a[0])


def corner_angle(a: Point, b: Point, c: Point) -> Column:
    """Signed degrees at b from the direction of a to that of c."""
    u, v = sub(a, b), sub(c, b)
    return F.degrees(F.atan2(cross(u, v), dot(u, v)))


def project_fraction(s: Segment, p: Point) -> Column:
    """How far along the segment, from 0 to 1, its nearest point to p lies; 0 on a segment without length."""
    d = vector(s)
    size = dot(d, d)
    return F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(sub(p, s[0]), d) / size)))


def point_at(s: Segment, fraction: Column) -> Point:
    return add(s[0], scale(vector(s), fraction))


def project_point(s: Segment, p: Point) -> Point:
    return point_at(s, project_fraction(s, p))


def segment_distance(s: Segment, p: Point) -> Column:
    return distance(p, project_point(s, p))


def project_with_width(s: Segment, p: Point) -> Point:
    """p where it is within 1 of the segment, else the point at distance 1 from it on the way to p."""
    near = project_point(s, p)
    gap = distance(p, near)
    pulled = add(near, scale(sub(p, near), 1 / gap))
    return F.when(gap < 1, p[0]).otherwise(pulled[0]), F.when(gap < 1, p[1]).otherwise(pulled[1])


def line_project(s: Segment, p: Point) -> Point:
    """The foot of p on the infinite line."""
    d = vector(s)
    return point_at(s, dot(sub(p, s[0]), d) / F.nullif(dot(d, d), F.lit(0.0)))


def line_offset(s: Segment, p: Point) -> Column:
    """Signed distance of p from the infinite line; positive on the left."""
    return cross(vector(s), sub(p, s[0])) / F.nullif(length(s), F.lit(0.0))


def segment_intersection(a: Segment, b: Segment) -> tuple[Column, Point]:
    """(meets, point): where two segments cross, ends included; parallel ones on one line give the first's start."""
    r, q, gap = vector(a), vector(b), sub(b[0], a[0])
    den = cross(r, q)
    safe = F.nullif(den, F.lit(0.0))
    t, u = cross(gap, q) / safe, cross(gap, r) / safe
    along = (den == 0) & (cross(gap, r) == 0)
    hit = (den != 0) & t.between(0, 1) & u.between(0, 1)
    p = point_at(a, t)
    return along | hit, (F.when(along, a[0][0]).when(hit, p[0]), F.when(along, a[0][1]).when(hit, p[1]))


def segment_segment_distance(a: Segment, b: Segment) -> Column:
    """Least distance of two segments: 0 where they cross, else the least of the four end-to-segment distances."""
    r, q, gap = vector(a), vector(b), sub(b[0], a[0])
    den = cross(r, q)
    safe = F.nullif(den, F.lit(0.0))
    crossing = (cross(gap, q) / safe).between(0, 1) & (cross(gap, r) / safe).between(0, 1)
    ends = F.least(segment_distance(a, b[0]), segment_distance(a, b[1]), segment_distance(b, a[0]), segment_distance(b, a[1]))
    return F.when(crossing, 0.0).otherwise(ends)


def extend(s: Segment, amount: float) -> Segment:
    """The segment with both ends moved outwards; one without length stays."""
    n = length(s)
    step = scale(vector(s), F.when(n == 0, 0.0).otherwise(amount / n))
    return sub(s[0], step), add(s[1], step)


def bounds(s: Segment, tolerance: float = 0.0) -> tuple[Column, Column, Column, Column]:
    """(min x, min y, max x, max y), widened on all sides."""
    (a, b), (c, d) = s
    return F.least(a, c) - tolerance, F.least(b, d) - tolerance, F.greatest(a, c) + tolerance, F.greatest(b, d) + tolerance


def contains(box: tuple, p: Point, closed: bool = True) -> Column:
    """Whether a box holds a point; a box that isn't closed lacks its upper edges."""
    low = (p[0] >= box[0]) & (p[1] >= box[1])
    return low & (p[0] <= box[2]) & (p[1] <= box[3]) if closed else low & (p[0] < box[2]) & (p[1] < box[3])


def boxes_meet(a: tuple, b: tuple) -> Column:
    return (a[2] >= b[0]) & (b[2] >= a[0]) & (a[3] >= b[1]) & (b[3] >= a[1])


def clip(box: tuple, p: Point) -> Point:
    return F.greatest(F.lit(box[0]), F.least(F.lit(box[2]), p[0])), F.greatest(F.lit(box[1]), F.least(F.lit(box[3]), p[1]))


def next_point(a: Point, b: Point, step: float, most: int = 1299) -> Point:
    """b moved on by step in the direction from a, rounded half to even and kept inside the tile."""
    n = length((a, b))
    inside = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.rint(v)))
    moved = add(b, scale(sub(b, a), F.when(n == 0, 0.0).otherwise(step / n)))
    return inside(moved[0]), inside(moved[1])


def point_key(p: Point) -> Column:
    """One whole number for a point of whole coordinates below 10,000."""
    return (p[0] * 10000 + p[1]).cast("long")


def pair_key(a: Point, b: Point) -> Column:
    return point_key(a) * 100_000_000 + point_key(b)


def tenth_key(p: Point) -> Column:
    """One whole number for a point rounded to tenths of a pixel."""
    return (F.rint(p[0] * 10) * 100_000 + F.rint(p[1] * 10)).cast("long")
