"""Places on the globe as column expressions; degrees in, metres and degrees out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres for a degree, and the radius of the sphere.
METRES_PER_DEGREE = 111111.0
RADIUS = 6_371_000.0
# Metres for a degree of latitude and of longitude near 41.8 degrees north, for fast_distance.
METRES_LAT, METRES_LON = 111070.34306591158, 83044.98918812413


def to_metres(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Equirectangular projection about an origin."""
    return (lon - lon0) * METRES_PER_DEGREE * F.cos(F.radians(F.lit(lat0))), (lat - lat0) * METRES_PER_DEGREE


def from_metres(x: Column, y: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    return x / (METRES_PER_DEGREE * F.cos(F.radians(F.lit(lat0)))) + lon0, y / METRES_PER_DEGREE + lat0


def to_pixel(lon: Column, lat: Column, west: Column, north: Column, dx: Column, dy: Column) -> tuple[Column, Column]:
    """Pixel of a place under an affine transform without rotation, y downwards, cut to whole pixels."""
    return ((lon - west) / dx).cast("int"), ((north - lat) / dy).cast("int")


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    far = 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * RADIUS
    return F.when((lon1 == lon2) & (lat1 == lat2), 0.0).otherwise(far)


def law_of_cosines(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon2 - lon1))
    return F.when((lon1 == lon2) & (lat1 == lat2), 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))) * RADIUS)


def fast_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """With fixed metres for a degree, right near one latitude only."""
    return F.sqrt(F.pow((lon2 - lon1) * METRES_LON, 2) + F.pow((lat2 - lat1) * METRES_LAT, 2))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """First bearing of the great circle, from 0 up to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    t = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(t + 360, F.lit(360.0))


def bearing_difference(a: Column, b: Column) -> Column:
    """The smaller angle between two bearings, at most 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360 - d)


def destination(lon: Column, lat: Column, towards: Column, metres: Column) -> tuple[Column, Column]:
    """Where a bearing and a distance lead; longitude from -180 up to 180."""
    a, t, d = F.radians(lat), F.radians(towards), metres / RADIUS
    to = F.asin(F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(t))
    lon2 = F.radians(lon) + F.atan2(F.sin(t) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * F.sin(to))
    return F.pmod(F.degrees(lon2) + 540, F.lit(360.0)) - 180, F.degrees(to)


def along_line(lon1: Column, lat1: Column, lon2: Column, lat2: Column, fraction: Column) -> tuple[Column, Column]:
    """Point at a fraction of the way, linear in degrees."""
    return lon1 + fraction * (lon2 - lon1), lat1 + fraction * (lat2 - lat1)


def onto_line(lon1: Column, lat1: Column, lon2: Column, lat2: Column, lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """(fraction, metres along, metres off): orthogonal projection of a place on a line, by bearings."""
    far = haversine(lon1, lat1, lon, lat)
    turn = F.radians(bearing(lon1, lat1, lon, lat) - bearing(lon1, lat1, lon2, lat2))
    size = haversine(lon1, lat1, lon2, lat2)
    along = far * F.cos(turn)
    return F.when(size == 0, 0.0).otherwise(along / size), along, F.abs(far * F.sin(turn))


def bearings_meet(lon1: Column, lat1: Column, bearing1: Column, lon2: Column, lat2: Column, bearing2: Column) -> tuple[Column, Column]:
    """Where two great circles from two places meet; null where they don't, or in more than one place, or everywhere."""
    a1, a2, t13, t23 = F.radians(lat1), F.radians(lat2), F.radians(bearing1), F.radians(bearing2)
    d12 = haversine(lon1, lat1, lon2, lat2) / RADIUS
    unit = lambda c: F.when(F.abs(c) <= 1 + 1e-12, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))
    start = unit((F.sin(a2) - F.sin(a1) * F.cos(d12)) / (F.sin(d12) * F.cos(a1)))
    end = unit((F.sin(a1) - F.sin(a2) * F.cos(d12)) / (F.sin(d12) * F.cos(a2)))
    east = F.sin(F.radians(lon2 - lon1)) > 0
    t12, t21 = F.when(east, start).otherwise(2 * F.pi() - start), F.when(east, 2 * F.pi() - end).otherwise(end)
    wrap = lambda c: F.pmod(c + F.pi(), 2 * F.pi()) - F.pi()
    b1, b2 = wrap(t13 - t12), wrap(t21 - t23)
    none = (d12 == 0) | (F.sin(b1) == 0) & (F.sin(b2) == 0) | (F.sin(b1) * F.sin(b2) < 0)
    b3 = F.acos(-F.cos(b1) * F.cos(b2) + F.sin(b1) * F.sin(b2) * F.cos(d12))
    d13 = F.atan2(F.sin(d12) * F.sin(b1) * F.sin(b2), F.cos(b2) + F.cos(b1) * F.cos(b3))
    lat3 = F.asin(F.sin(a1) * F.cos(d13) + F.cos(a1) * F.sin(d13) * F.cos(t13))
    lon3 = F.radians(lon1) + F.atan2(F.sin(t13) * F.sin(d13) * F.cos(a1), F.cos(d13) - F.sin(a1) * F.sin(lat3))
    return F.when(~none, F.pmod(F.degrees(lon3) + 540, F.lit(360.0)) - 180), F.when(~none, F.degrees(lat3))
