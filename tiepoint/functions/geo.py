"""Ground distance and reprojection as column expressions; one pandas UDF for long geodesics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the mean earth radius, metres.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_B = WGS84_A * (1 - WGS84_F)
WGS84_E2 = WGS84_F * (2 - WGS84_F)
MEAN_RADIUS = 6371008.8

#: Up to here the chord with an arc correction is within 1.5e-8 m of the geodesic.
CHORD_LIMIT_M = 1000.0
#: Up to here the chord with the curvature between its ends is within 2e-7 m of the geodesic.
CURVED_LIMIT_M = 20_000.0


def ecef(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of a point on the ellipsoid, metres."""
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(WGS84_A) / F.sqrt(1.0 - F.lit(WGS84_E2) * F.sin(phi) * F.sin(phi))
    return n * F.cos(phi) * F.cos(lam), n * F.cos(phi) * F.sin(lam), n * (1.0 - WGS84_E2) * F.sin(phi)


def chord(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    dx, dy, dz = (p - q for p, q in zip(a, b, strict=True))
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def arc(chord_m: Column) -> Column:
    """Length over ground of a short chord."""
    return F.asin(chord_m / (2.0 * MEAN_RADIUS)) * (2.0 * MEAN_RADIUS)


def short_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Ground distance in metres for points up to a kilometre apart; built-in functions only."""
    return arc(chord(ecef(lon1, lat1), ecef(lon2, lat2)))


def vincenty(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Geodesic length on WGS84 by Vincenty's inverse formula; for nearly antipodal points, where that does
    not converge, by halving the great circle until both halves do."""
    f, a, b = WGS84_F, WGS84_A, WGS84_B
    out = np.full(np.broadcast(lon1, lat1, lon2, lat2).shape, np.nan)
    ok = np.isfinite(lon1) & np.isfinite(lat1) & np.isfinite(lon2) & np.isfinite(lat2)
    u1 = np.arctan((1 - f) * np.tan(np.radians(np.where(ok, lat1, 0))))
    u2 = np.arctan((1 - f) * np.tan(np.radians(np.where(ok, lat2, 0))))
    ell = np.radians((np.where(ok, lon2, 0) - np.where(ok, lon1, 0) + 180) % 360 - 180)
    lam, active = ell.copy(), ok.copy()
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    for _ in range(200):
        sl, cl = np.sin(lam), np.cos(lam)
        sin_s = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        cos_s = s1 * s2 + c1 * c2 * cl
        sigma = np.arctan2(sin_s, cos_s)
        sin_a = np.divide(c1 * c2 * sl, sin_s, out=np.zeros_like(sin_s), where=sin_s > 0)
        cos2_a = 1 - sin_a * sin_a
        cos_2m = np.divide(-2 * s1 * s2, cos2_a, out=np.zeros_like(cos2_a), where=cos2_a > 1e-15) + np.where(cos2_a > 1e-15, cos_s, 0)
        c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
        new = ell + (1 - c) * f * sin_a * (sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m * cos_2m - 1)))
        moved = np.abs(new - lam)
        lam = np.where(active, new, lam)
        active &= (moved > 1e-13) & (np.abs(new) <= math.pi)
        if not active.any():
            break
    u_sq = cos2_a * (a * a - b * b) / (b * b)
    big_a = 1 + u_sq / 16384 * (4096 + u_sq * (-768 + u_sq * (320 - 175 * u_sq)))
    big_b = u_sq / 1024 * (256 + u_sq * (-128 + u_sq * (74 - 47 * u_sq)))
    delta = big_b * sin_s * (cos_2m + big_b / 4 * (cos_s * (2 * cos_2m**2 - 1) - big_b / 6 * cos_2m * (4 * sin_s**2 - 3) * (4 * cos_2m**2 - 3)))
    out[ok] = (b * big_a * (sigma - delta))[ok]
    far = ok & ((moved > 1e-13) | (np.abs(lam) > math.pi))
    for k in np.flatnonzero(far):
        out[k] = _halved(float(lon1[k]), float(lat1[k]), float(lon2[k]), float(lat2[k]))
    return out


def _halved(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    """Shortest of the routes over the poles and over the equator a quarter turn away (near antipodes; the
    length is then an upper bound within a few metres in 20,000 km)."""
    mids = [(lon1 + 90.0, 0.0), (lon1 - 90.0, 0.0), (lon1, 90.0), (lon1, -90.0)]
    lon, lat = (np.asarray(x) for x in zip(*mids, strict=True))
    with np.errstate(invalid="ignore"):
        one = vincenty(np.full(len(mids), lon1), np.full(len(mids), lat1), lon, lat)
        two = vincenty(lon, lat, np.full(len(mids), lon2), np.full(len(mids), lat2))
    return float(np.nanmin(one + two))


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _vincenty_columns(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 20) -> Column:
    """``(length, settled)`` by Vincenty's formula in a set number of rounds; not settled near antipodes."""
    f, a, b = WGS84_F, WGS84_A, WGS84_B
    u = lambda lat: F.atan((1 - f) * F.tan(F.radians(lat)))
    ell = F.radians(F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0)

    def measured(p: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            return _once(F.struct(F.sin(s["lam"]).alias("sl"), F.cos(s["lam"]).alias("cl")), lambda t: _once(F.struct(
                F.hypot(p["c2"] * t["sl"], p["c1"] * p["s2"] - p["s1"] * p["c2"] * t["cl"]).alias("sin_s"),
                (p["s1"] * p["s2"] + p["c1"] * p["c2"] * t["cl"]).alias("cos_s"), (p["c1"] * p["c2"] * t["sl"]).alias("top"),
            ), lambda t: _once(F.struct(
                t["sin_s"].alias("sin_s"), t["cos_s"].alias("cos_s"), F.atan2(t["sin_s"], t["cos_s"]).alias("sigma"), F.when(t["sin_s"] > 0, t["top"] / t["sin_s"]).otherwise(0.0).alias("sin_a"),
            ), lambda t: moved(s, t))))

        def moved(s: Column, t: Column) -> Column:
            cos2_a = 1.0 - t["sin_a"] * t["sin_a"]
            cos_2m = F.when(cos2_a > 1e-15, t["cos_s"] - 2.0 * p["s1"] * p["s2"] / cos2_a).otherwise(0.0)
            return _once(F.struct(cos2_a.alias("cos2_a"), cos_2m.alias("cos_2m"), (f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))).alias("c")), lambda m: _once(
                p["ell"] + (1 - m["c"]) * f * t["sin_a"] * (t["sigma"] + m["c"] * t["sin_s"] * (m["cos_2m"] + m["c"] * t["cos_s"] * (2 * m["cos_2m"] * m["cos_2m"] - 1))),
                lambda new: F.struct(
                    new.alias("lam"), F.abs(new - s["lam"]).alias("moved"), t["sin_s"].alias("sin_s"), t["cos_s"].alias("cos_s"),
                    t["sigma"].alias("sigma"), m["cos2_a"].alias("cos2_a"), m["cos_2m"].alias("cos_2m"),
                ),
            ))

        def length(s: Column) -> Column:
            u_sq = s["cos2_a"] * ((a * a - b * b) / (b * b))
            big_a = 1 + u_sq / 16384 * (4096 + u_sq * (-768 + u_sq * (320 - 175 * u_sq)))
            big_b = u_sq / 1024 * (256 + u_sq * (-128 + u_sq * (74 - 47 * u_sq)))
            m, ss, cs = s["cos_2m"], s["sin_s"], s["cos_s"]
            delta = lambda k: k * ss * (m + k / 4 * (cs * (2 * m * m - 1) - k / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))
            settled = (s["moved"] <= 1e-13) & (F.abs(s["lam"]) <= math.pi)
            return _once(big_b, lambda k: F.struct((b * big_a * (s["sigma"] - delta(k))).alias("length"), settled.alias("settled")))

        zero = F.struct(p["ell"].alias("lam"), *(F.lit(1.0).alias(n) for n in ("moved", "sin_s", "cos_s", "sigma", "cos2_a", "cos_2m")))
        # settled rows stay as they are
        again = lambda s, k: F.when(s["moved"] <= 1e-13, s).otherwise(step(s, k))
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), zero, again, length)

    start = F.struct(F.sin(u(lat1)).alias("s1"), F.cos(u(lat1)).alias("c1"), F.sin(u(lat2)).alias("s2"), F.cos(u(lat2)).alias("c2"), ell.alias("ell"))
    return _once(start, measured)


def geodesic_columns(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Geodesic distance on WGS84 in metres, any range, by built-in functions alone; null where a coordinate is.

    For few rows, or where Python workers are to be spared; ``geodesic_m`` is faster for many. Near antipodes it is
    the shortest of the routes over the poles and over the equator a quarter turn away, as there.
    """
    whole = lon1.isNotNull() & lat1.isNotNull() & lon2.isNotNull() & lat2.isNotNull()
    equator, north = F.lit(0.0), F.lit(90.0)
    mids = [(lon1 + 90.0, equator), (lon1 - 90.0, equator), (lon1, north), (lon1, -north)]
    # one formula for all legs: an expression per leg would have to be planned nine times over
    here, there = (lon1, lat1), (lon2, lat2)
    legs = lambda one, two: F.struct(*(x.cast("double").alias(n) for x, n in zip((*one, *two), ("x1", "y1", "x2", "y2"), strict=True)))
    routes = F.array(*(F.array(legs(here, m), legs(m, there)) for m in mids))
    long = lambda e: _vincenty_columns(e["x1"], e["y1"], e["x2"], e["y2"])["length"]
    lengths = F.transform(routes, lambda r: F.aggregate(F.transform(r, long), F.lit(0.0), lambda x, y: x + y))
    around = F.array_min(F.filter(lengths, lambda d: ~F.isnan(d)))
    return F.when(whole, _once(_vincenty_columns(lon1, lat1, lon2, lat2), lambda d: F.when(d["settled"], d["length"]).otherwise(around)))


def curved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length over ground between earth-centred places (rows x, y, z), by the ellipsoid's curvature from one to the other."""
    gap, middle = a - b, a + b
    chord_m = np.sqrt((gap * gap).sum(axis=0))
    across = (gap[0] * gap[0] + gap[1] * gap[1]) / WGS84_A**2 + gap[2] * gap[2] / WGS84_B**2
    normal = np.sqrt((middle[0] * middle[0] + middle[1] * middle[1]) / WGS84_A**4 + middle[2] * middle[2] / WGS84_B**4)
    half = across * np.sqrt(1 - across / 4) / (normal * np.where(chord_m > 0, chord_m, 1))  # the chord's half by the radius
    return np.where(half > 0, chord_m * np.arcsin(half) / np.where(half > 0, half, 1), chord_m)


def _lengths(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    return pd.Series(vincenty(*(x.to_numpy(dtype=float, na_value=np.nan) for x in (lon1, lat1, lon2, lat2))))


def geodesic_m(lon1: Column | str, lat1: Column | str, lon2: Column | str, lat2: Column | str) -> Column:
    """Geodesic distance on WGS84 in metres, any range; null where a coordinate is."""
    return F.nanvl(F.pandas_udf(_lengths, "double")(lon1, lat1, lon2, lat2), F.lit(None).cast("double"))


# ---- reprojection -----------------------------------------------------------------------------

_MERCATOR = (3857, 102100, 102113)


def _utm(wkid: int) -> tuple[int, bool] | None:
    zone = wkid % 100
    return (zone, wkid // 100 == 326) if wkid // 100 in (326, 327) and 1 <= zone <= 60 else None


_N = WGS84_F / (2 - WGS84_F)
_RECTIFYING = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger series to the fourth order of n, forward and back.
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
# conformal to geodetic latitude
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
_SCALE, _EAST, _SOUTH = 0.9996, 500000.0, 10000000.0


def _to_wgs84(x: Column, y: Column, wkid: int) -> tuple[Column, Column]:
    if wkid == 4326:
        return x, y
    if wkid in _MERCATOR:
        return F.degrees(x / WGS84_A), F.degrees(2.0 * F.atan(F.exp(y / WGS84_A)) - math.pi / 2)
    if utm := _utm(wkid):
        zone, north = utm
        xi0 = (y - (0.0 if north else _SOUTH)) / (_SCALE * _RECTIFYING)
        eta0 = (x - _EAST) / (_SCALE * _RECTIFYING)
        xi, eta = xi0, eta0
        for j, c in enumerate(_BACK, 1):
            xi = xi - c * F.sin(2.0 * j * xi0) * F.cosh(2.0 * j * eta0)
            eta = eta - c * F.cos(2.0 * j * xi0) * F.sinh(2.0 * j * eta0)
        chi = F.asin(F.sin(xi) / F.cosh(eta))
        phi = chi
        for j, c in enumerate(_LATITUDE, 1):
            phi = phi + c * F.sin(2.0 * j * chi)
        return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (6.0 * zone - 183.0), F.degrees(phi)
    raise ValueError(f"unsupported coordinate system {wkid}: WGS84 (4326), Web Mercator (3857, 102100) and UTM (326xx, 327xx) are")


def _from_wgs84(lon: Column, lat: Column, wkid: int) -> tuple[Column, Column]:
    if wkid == 4326:
        return lon, lat
    if wkid in _MERCATOR:
        return F.radians(lon) * WGS84_A, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2.0)) * WGS84_A
    if utm := _utm(wkid):
        zone, north = utm
        phi, lam = F.radians(lat), F.radians(lon - (6.0 * zone - 183.0))
        e = math.sqrt(WGS84_E2)
        t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
        xi0, eta0 = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1.0 + t * t))
        xi, eta = xi0, eta0
        for j, c in enumerate(_FORWARD, 1):
            xi = xi + c * F.sin(2.0 * j * xi0) * F.cosh(2.0 * j * eta0)
            eta = eta + c * F.cos(2.0 * j * xi0) * F.sinh(2.0 * j * eta0)
        return _EAST + _SCALE * _RECTIFYING * eta, (0.0 if north else _SOUTH) + _SCALE * _RECTIFYING * xi
    raise ValueError(f"unsupported coordinate system {wkid}: WGS84 (4326), Web Mercator (3857, 102100) and UTM (326xx, 327xx) are")


def reproject(x: Column, y: Column, from_wkid: int, to_wkid: int) -> tuple[Column, Column]:
    """Coordinates of a point in another coordinate system."""
    if from_wkid == to_wkid:
        return x, y
    return _from_wgs84(*_to_wgs84(x, y, from_wkid), to_wkid)
