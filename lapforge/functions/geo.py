"""Column expressions for positions on the ground and in the local plane."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radius of the local projection, standard gravity, mph per m/s.
EARTH_R = 6371000.0
G0 = 9.80665
MPH = 2.2369362920544

ColLike = Column | str | float


def _c(x: ColLike) -> Column:
    return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(float(x)))


def to_local(lat: ColLike, lon: ColLike, lat0: ColLike, lon0: ColLike, radius: float = EARTH_R):
    """(east, north) metres from an anchor, equirectangular."""
    lat, lon, lat0, lon0 = _c(lat), _c(lon), _c(lat0), _c(lon0)
    east = F.radians(lon - lon0) * F.cos(F.radians(lat0)) * radius
    return east, F.radians(lat - lat0) * radius


def to_geographic(east: ColLike, north: ColLike, lat0: ColLike, lon0: ColLike, radius: float = EARTH_R):
    """(lat, lon) degrees of a local point."""
    east, north, lat0, lon0 = _c(east), _c(north), _c(lat0), _c(lon0)
    lat = lat0 + F.degrees(north / radius)
    return lat, lon0 + F.degrees(east / (F.cos(F.radians(lat0)) * radius))


def haversine(lat1: ColLike, lon1: ColLike, lat2: ColLike, lon2: ColLike) -> Column:
    """Great-circle metres."""
    la1, lo1, la2, lo2 = (F.radians(_c(v)) for v in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((la2 - la1) / 2), 2) + F.cos(la1) * F.cos(la2) * F.pow(F.sin((lo2 - lo1) / 2), 2)
    return 2 * EARTH_R * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing(lat1: ColLike, lon1: ColLike, lat2: ColLike, lon2: ColLike) -> Column:
    """Initial course in degrees, 0..360."""
    la1, lo1, la2, lo2 = (F.radians(_c(v)) for v in (lat1, lon1, lat2, lon2))
    y = F.sin(lo2 - lo1) * F.cos(la2)
    x = F.cos(la1) * F.sin(la2) - F.sin(la1) * F.cos(la2) * F.cos(lo2 - lo1)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def destination(lat: ColLike, lon: ColLike, course: ColLike, metres: ColLike):
    """(lat, lon) reached from a point on a course."""
    la, lo, th, d = F.radians(_c(lat)), F.radians(_c(lon)), F.radians(_c(course)), _c(metres) / EARTH_R
    la2 = F.asin(F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(th))
    lo2 = lo + F.atan2(F.sin(th) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * F.sin(la2))
    return F.degrees(la2), F.degrees(lo2)


def utm(lat: ColLike, lon: ColLike, central_meridian: float):
    """(easting, northing) by the Transverse Mercator series on WGS-84, northern hemisphere."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    la = F.radians(_c(lat))
    s, c, t = F.sin(la), F.cos(la), F.tan(la)
    n = a / F.sqrt(1 - e2 * s * s)
    tt, cc = t * t, ep2 * c * c
    aa = c * F.radians(_c(lon) - central_meridian)
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * la
        - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * la)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * la)
        - (35 * e2**3 / 3072) * F.sin(6 * la)
    )
    east = 500000.0 + k0 * n * (
        aa
        + (1 - tt + cc) * F.pow(aa, 3) / 6
        + (5 - 18 * tt + tt * tt + 72 * cc - 58 * ep2) * F.pow(aa, 5) / 120
    )
    north = k0 * (
        m
        + n * t * (
            aa * aa / 2
            + (5 - tt + 9 * cc + 4 * cc * cc) * F.pow(aa, 4) / 24
            + (61 - 58 * tt + tt * tt + 600 * cc - 330 * ep2) * F.pow(aa, 6) / 720
        )
    )
    return east, north


def inside(x: ColLike, y: ColLike, ring: Sequence[tuple[float, float]]) -> Column:
    """Even-odd test against a fixed ring of vertices (configuration, so bounded)."""
    x, y = _c(x), _c(y)
    hits = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 == y2:
            continue
        straddles = (F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)
        at = (y - float(y1)) * float(x2 - x1) / float(y2 - y1) + float(x1)
        hits = hits + (straddles & (x < at)).cast("int")
    return hits % 2 == 1


def wrap180(deg: ColLike) -> Column:
    """Angle folded to [-180, 180)."""
    return F.pmod(_c(deg) + 180.0, F.lit(360.0)) - 180.0


def hypot(x: ColLike, y: ColLike) -> Column:
    x, y = _c(x), _c(y)
    return F.sqrt(x * x + y * y)


def gate_hit(e: ColLike, n: ColLike, e2: ColLike, n2: ColLike, gate: tuple[float, float, float, float]):
    """Crossing of the step (e,n)->(e2,n2) with a gate segment.

    Returns (hit, fraction along the step, side the step moves to: +1/-1).
    """
    e, n, e2, n2 = _c(e), _c(n), _c(e2), _c(n2)
    ax, ay, bx, by = (float(v) for v in gate)
    sx, sy = bx - ax, by - ay
    rx, ry = e2 - e, n2 - n
    det = rx * sy - ry * sx
    ok = F.abs(det) > 1e-12
    qx, qy = F.lit(ax) - e, F.lit(ay) - n
    frac = F.when(ok, (qx * sy - qy * sx) / det)
    along = F.when(ok, (qx * ry - qy * rx) / det)
    side = F.when(ry * sx - rx * sy >= 0, 1).otherwise(-1)
    return F.coalesce(frac.between(0, 1) & along.between(0, 1), F.lit(False)), frac, side
