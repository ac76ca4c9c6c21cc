"""Column expressions over rings ``ARRAY<STRUCT<x DOUBLE, y DOUBLE>>`` and affines."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(ring: Column) -> Column:
    """Indices of the ring's edges (i, i+1); empty for degenerate rings."""
    return F.when(F.size(ring) >= 2, F.sequence(F.lit(0), F.size(ring) - 2)).otherwise(F.array().cast("array<int>"))


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``: a lambda variable is not copied per use."""
    return F.transform(F.array(value), body)[0]


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive when counter-clockwise; shifted to the first vertex to keep digits."""
    ox, oy = ring[0]["x"], ring[0]["y"]
    term = lambda i: ((ring[i]["x"] - ox) * (ring[i + 1]["y"] - oy) - (ring[i + 1]["x"] - ox) * (ring[i]["y"] - oy))
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, i: s + term(i)) / 2.0


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    step = lambda i: F.sqrt(F.pow(ring[i + 1]["x"] - ring[i]["x"], F.lit(2)) + F.pow(ring[i + 1]["y"] - ring[i]["y"], F.lit(2)))
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, i: s + step(i))


def centroid(ring: Column) -> Column:
    """Area centroid of a closed ring, in one pass over its edges."""
    def of(r):
        ox, oy = r[0]["x"], r[0]["y"]
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

        def add(s, i):
            px, py, qx, qy = r[i]["x"] - ox, r[i]["y"] - oy, r[i + 1]["x"] - ox, r[i + 1]["y"] - oy
            c = px * qy - qx * py
            return F.struct((s["a"] + c).alias("a"), (s["x"] + (px + qx) * c).alias("x"), (s["y"] + (py + qy) * c).alias("y"))

        return F.aggregate(_edges(r), zero, add, lambda s: F.struct(
            (ox + s["x"] / F.nullif(s["a"] * 3.0, F.lit(0.0))).alias("x"), (oy + s["y"] / F.nullif(s["a"] * 3.0, F.lit(0.0))).alias("y")))

    return let(ring, of)


def bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def wkt(ring: Column) -> Column:
    pts = F.transform(ring, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string")))
    return F.concat(F.lit("POLYGON (("), F.array_join(pts, ", "), F.lit("))"))


def rings_area(rings: Column) -> Column:
    """Area of a polygon of any rings: parts turn one way, holes the other."""
    return F.abs(F.aggregate(rings, F.lit(0.0), lambda s, r: s + F.coalesce(signed_area(r), F.lit(0.0))))


def rings_bbox(rings: Column) -> Column:
    return bbox(F.flatten(rings))


def rings_centroid(rings: Column) -> Column:
    """Area centroid over all rings; holes, which turn the other way, count against it."""
    def of(all_rings):
        ox, oy = all_rings[0][0]["x"], all_rings[0][0]["y"]
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

        def ring(s, r):
            def add(t, i):
                px, py, qx, qy = r[i]["x"] - ox, r[i]["y"] - oy, r[i + 1]["x"] - ox, r[i + 1]["y"] - oy
                c = px * qy - qx * py
                return F.struct((t["a"] + c).alias("a"), (t["x"] + (px + qx) * c).alias("x"), (t["y"] + (py + qy) * c).alias("y"))
            return F.aggregate(_edges(r), s, add)

        return F.aggregate(all_rings, zero, ring, lambda s: F.struct(
            (ox + s["x"] / F.nullif(s["a"] * 3.0, F.lit(0.0))).alias("x"), (oy + s["y"] / F.nullif(s["a"] * 3.0, F.lit(0.0))).alias("y")))

    return let(rings, of)


def rings_wkt(rings: Column) -> Column:
    """Text of every ring, in order; empty for no rings."""
    return F.array_join(F.transform(rings, wkt), ";")


def clip_half_plane(ring: Column, axis: str, limit: Column, keep_above: bool) -> Column:
    """One Sutherland-Hodgman step on a closed ring; the result is closed again.

    Every edge emits its crossing point and its end point on its own, so the
    step is a transform, not a growing accumulator.
    """
    return let(F.struct(ring.alias("r"), limit.alias("l")), lambda v: _clip_step(v["r"], axis, v["l"], keep_above))


def _clip_step(ring: Column, axis: str, limit: Column, keep_above: bool) -> Column:
    other = "y" if axis == "x" else "x"
    inside = lambda p: (p[axis] >= limit) if keep_above else (p[axis] <= limit)

    def emit(i):
        p, q = ring[i], ring[i + 1]
        t = (limit - p[axis]) / (q[axis] - p[axis])
        o = p[other] + t * (q[other] - p[other])
        hit = F.struct(limit.alias("x"), o.alias("y")) if axis == "x" else F.struct(o.alias("x"), limit.alias("y"))
        end = F.struct(q["x"].alias("x"), q["y"].alias("y"))
        return (F.when(inside(p) & inside(q), F.array(end)).when(inside(p), F.array(hit))
                .when(inside(q), F.array(hit, end)).otherwise(F.array().cast("array<struct<x:double,y:double>>")))

    return let(F.flatten(F.transform(_edges(ring), emit)), close_ring)


def close_ring(ring: Column) -> Column:
    return F.when(F.size(ring) > 0, F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def to_pixel(x: Column, y: Column, a: Column, c: Column, e: Column, f: Column):
    """World -> (row, col) of a north-up affine, truncated towards zero."""
    return ((y - f) / e).cast("int"), ((x - c) / a).cast("int")


def to_world(row: Column, col: Column, a: Column, c: Column, e: Column, f: Column):
    return c + a * col, f + e * row


EARTH_R = 6378137.0


def mercator_to_lonlat(x: Column, y: Column):
    lon = F.degrees(x / EARTH_R)
    lat = F.degrees(F.lit(2.0) * F.atan(F.exp(y / EARTH_R)) - F.lit(math.pi / 2))
    return lon, lat


def lonlat_to_mercator(lon: Column, lat: Column):
    x = F.radians(lon) * EARTH_R
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2.0)) * EARTH_R
    return x, y


# WGS84 and UTM constants: fixed values.
_A, _INV_F, _K0, _E0 = 6378137.0, 298.257223563, 0.9996, 500000.0
_N = 1.0 / (2.0 * _INV_F - 1.0)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def central_meridian(epsg: int) -> float:
    """Of a northern UTM zone, e.g. 32643 -> 75 degrees east."""
    return (epsg - 32600) * 6.0 - 183.0


def lonlat_to_utm(lon: Column, lat: Column, epsg: int):
    """Krueger series, northern hemisphere, sub-millimetre inside a zone.

    Written without ``atanh`` of a sine, which has no value where the sine rounds to one: near the pole and a quarter turn off the zone.
    """
    phi, lam = F.radians(lat), F.radians(lon - F.lit(central_meridian(epsg)))
    k = 2 * math.sqrt(_N) / (1 + _N)
    atanh = lambda v: F.lit(0.5) * F.log((F.lit(1.0) + v) / (F.lit(1.0) - v))
    asinh = lambda v: F.signum(v) * F.log(F.abs(v) + F.sqrt(v * v + F.lit(1.0)))
    t = F.sinh(asinh(F.tan(phi)) - F.lit(k) * atanh(F.lit(k) * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = asinh(F.sin(lam) / F.hypot(t, F.cos(lam)))
    e, n = eta, xi
    for j, al in enumerate(_ALPHA, 1):
        e = e + F.lit(al) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        n = n + F.lit(al) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
    return F.lit(_E0) + F.lit(_K0 * _RECT) * e, F.lit(_K0 * _RECT) * n


def utm_to_lonlat(x: Column, y: Column, epsg: int):
    xi, eta = y / (_K0 * _RECT), (x - _E0) / (_K0 * _RECT)
    xp, ep = xi, eta
    for j, b in enumerate(_BETA, 1):
        xp = xp - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        ep = ep - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    chi = F.asin(F.sin(xp) / F.cosh(ep))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    return F.lit(central_meridian(epsg)) + F.degrees(F.atan2(F.sinh(ep), F.cos(xp))), F.degrees(phi)
