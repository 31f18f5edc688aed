"""Locations of WKT texts in the plane of EPSG:2154 (Lambert-93), on whole Arrow batches.

Points in the usual form are read with one regular expression; every other geometry goes
through a general reader.  The location of a polygon is the centroid of its area (holes
subtracted), of lines the centroid by length, of points their mean.  Null, empty and
unreadable geometries have no location.
"""

from __future__ import annotations

import re

import numpy as np

_F = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
POINT = re.compile(rf"\s*(?:SRID\s*=\s*(\d+)\s*;)?\s*(?:MULTI)?POINT\s*(?:ZM?|M)?\s*\(\s*\(?\s*({_F})\s+({_F})(?:\s+{_F})*\s*\)?\s*\)\s*\Z", re.I)
HEAD = re.compile(r"\s*(?:SRID\s*=\s*(\d+)\s*;)?\s*([A-Z]+)\s*(?:ZM|Z|M)?\s*(\(.*\))?\s*\Z", re.I | re.S)
RING = re.compile(r"\(([^()]+)\)")

# Lambert-93 on GRS80: fixed values of EPSG:2154.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101
LAT_ORIGIN, LON_ORIGIN, PARALLEL_1, PARALLEL_2 = 46.5, 3.0, 49.0, 44.0
FALSE_EAST, FALSE_NORTH = 700000.0, 6600000.0


def _cone() -> tuple[float, float, float, float]:
    e = np.sqrt(FLATTENING * (2 - FLATTENING))
    r1, r2, r0 = np.radians([PARALLEL_1, PARALLEL_2, LAT_ORIGIN])
    m = lambda p: np.cos(p) / np.sqrt(1 - (e * np.sin(p)) ** 2)
    t = lambda p: np.tan(np.pi / 4 - p / 2) / ((1 - e * np.sin(p)) / (1 + e * np.sin(p))) ** (e / 2)
    n = np.log(m(r1) / m(r2)) / np.log(t(r1) / t(r2))
    f = m(r1) / (n * t(r1) ** n)
    return e, n, SEMI_MAJOR * f, SEMI_MAJOR * f * t(r0) ** n


E, N, SCALE, RHO_0 = _cone()


def to_lambert93(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.radians(np.clip(lat, -89.999999, 89.999999))
    t = np.tan(np.pi / 4 - p / 2) / ((1 - E * np.sin(p)) / (1 + E * np.sin(p))) ** (E / 2)
    rho, theta = SCALE * t**N, N * np.radians(lon - LON_ORIGIN)
    return FALSE_EAST + rho * np.sin(theta), FALSE_NORTH + RHO_0 - rho * np.cos(theta)


def from_lambert93(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dx, dy = np.asarray(x, float) - FALSE_EAST, RHO_0 - (np.asarray(y, float) - FALSE_NORTH)
    t = (np.hypot(dx, dy) / SCALE) ** (1 / N)
    lon = np.degrees(np.arctan2(dx, dy) / N) + LON_ORIGIN
    p = np.pi / 2 - 2 * np.arctan(t)
    for _ in range(8):
        p = np.pi / 2 - 2 * np.arctan(t * ((1 - E * np.sin(p)) / (1 + E * np.sin(p))) ** (E / 2))
    return lon, np.degrees(p)


def _coords(body: str) -> np.ndarray:
    return np.array([[float(v) for v in c.split()[:2]] for c in body.split(",") if c.strip()], float)


def ring_moments(xy: np.ndarray) -> tuple[float, float, float]:
    """Area (never negative) and area times centroid of a ring; coordinates relative to its first point."""
    o = xy[0]
    x, y = (xy - o).T
    cross = x * np.roll(y, -1) - np.roll(x, -1) * y
    area = cross.sum() / 2
    mx, my = ((x + np.roll(x, -1)) * cross).sum() / 6, ((y + np.roll(y, -1)) * cross).sum() / 6
    sign = -1 if area < 0 else 1
    return sign * area, sign * mx + sign * area * o[0], sign * my + sign * area * o[1]


def location(text: str) -> tuple[float, float, int] | None:
    """x, y and SRID of one WKT text."""
    m = HEAD.match(text)
    if not m or not m[3] or re.search(r"[A-DF-Z]", m[3], re.I) or m[3].count("(") != m[3].count(")"):
        return None
    srid, kind, body = int(m[1] or 2154), m[2].upper(), m[3]
    try:
        if kind in ("POLYGON", "MULTIPOLYGON"):
            total = np.zeros(3)
            for part in re.findall(r"\((?:\s*\([^()]*\)\s*,?)+\s*\)", body):
                for k, ring in enumerate(RING.findall(part)):
                    xy = _coords(ring)
                    if srid == 4326:
                        xy = np.column_stack(to_lambert93(*xy.T))
                    total += np.array(ring_moments(xy)) * (-1 if k else 1)
            if total[0] > 0:
                return total[1] / total[0], total[2] / total[0], 2154
        xy = np.concatenate([_coords(r) for r in RING.findall(body if kind != "MULTIPOINT" else body.replace("((", "(").replace("))", ")"))])
        if kind in ("LINESTRING", "MULTILINESTRING") and len(xy) > 1:
            parts = [_coords(r) for r in RING.findall(body)]
            a, b = np.concatenate([p[:-1] for p in parts]), np.concatenate([p[1:] for p in parts])
            w = np.hypot(*(b - a).T)
            if w.sum() > 0:
                return *(((a + b) / 2 * w[:, None]).sum(0) / w.sum()), srid
        return float(xy[:, 0].mean()), float(xy[:, 1].mean()), srid
    except (ValueError, IndexError):
        return None


def locations(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates in EPSG:2154 of many texts; NaN where there is no location."""
    x, y, srid = np.full(len(texts), np.nan), np.full(len(texts), np.nan), np.full(len(texts), 2154)
    for i, text in enumerate(texts):
        if text is None:
            continue
        if m := POINT.match(text):
            x[i], y[i] = float(m[2]), float(m[3])
            if m[1]:
                srid[i] = int(m[1])
        elif found := location(text):
            x[i], y[i], srid[i] = found
    geographic = srid == 4326
    if geographic.any():
        x[geographic], y[geographic] = to_lambert93(x[geographic], y[geographic])
    x[~geographic & (srid != 2154)] = np.nan
    x[~(np.isfinite(x) & np.isfinite(y))] = np.nan
    return x, y
