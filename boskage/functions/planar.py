"""Points, rectangles, projections and grids as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from boskage.functions import wkt

A_GRS80, F_GRS80 = wkt.SEMI_MAJOR, wkt.FLATTENING


def radius_of(area: Column) -> Column:
    """Radius of the circle of the same area."""
    return F.sqrt(area / math.pi)


def rect_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Distance of two rectangles, 0 where they meet; a point is a rectangle without extent."""
    zero = F.lit(0.0)
    dx = F.greatest(zero, a["minx"] - b["maxx"], b["minx"] - a["maxx"])
    dy = F.greatest(zero, a["miny"] - b["maxy"], b["miny"] - a["maxy"])
    return F.sqrt(dx * dx + dy * dy)


def rects_meet(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return (a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"]) & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"])


def rect_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area of the intersection of two rectangles."""
    w = F.least(a["maxx"], b["maxx"]) - F.greatest(a["minx"], b["minx"])
    h = F.least(a["maxy"], b["maxy"]) - F.greatest(a["miny"], b["miny"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def rect_area(a: dict[str, Column]) -> Column:
    return (a["maxx"] - a["minx"]) * (a["maxy"] - a["miny"])


def rect_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union; 0 where the union has no area."""
    i = rect_overlap(a, b)
    u = rect_area(a) + rect_area(b) - i
    return F.when(u > 0, i / u).otherwise(0.0)


def rect(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in ("minx", "miny", "maxx", "maxy")}


def square_around(x: Column, y: Column, half: float) -> dict[str, Column]:
    return {"minx": x - half, "miny": y - half, "maxx": x + half, "maxy": y + half}


def lambert93(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:2154."""
    e, n, scale, rho0 = (float(v) for v in (wkt.E, wkt.N, wkt.SCALE, wkt.RHO_0))
    p = F.radians(lat)
    s = e * F.sin(p)
    t = F.tan(F.lit(math.pi / 4) - p / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2))
    rho, theta = scale * F.pow(t, F.lit(n)), n * F.radians(lon - wkt.LON_ORIGIN)
    return wkt.FALSE_EAST + rho * F.sin(theta), wkt.FALSE_NORTH + rho0 - rho * F.cos(theta)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857."""
    return A_GRS80 * F.radians(lon), A_GRS80 * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def laea_europe(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3035 (Lambert azimuthal equal area, 52 N 10 E)."""
    e2 = F_GRS80 * (2 - F_GRS80)
    e = math.sqrt(e2)

    def q(sin: Column) -> Column:
        return (1 - e2) * (sin / (1 - e2 * sin * sin) - F.ln((1 - e * sin) / (1 + e * sin)) / (2 * e))

    def qf(sin: float) -> float:
        return (1 - e2) * (sin / (1 - e2 * sin * sin) - math.log((1 - e * sin) / (1 + e * sin)) / (2 * e))

    qp, q1, s1 = qf(1.0), qf(math.sin(math.radians(52))), math.sin(math.radians(52))
    b1, rq = math.asin(q1 / qp), A_GRS80 * math.sqrt(qp / 2)
    d = A_GRS80 * math.cos(math.radians(52)) / math.sqrt(1 - e2 * s1 * s1) / (rq * math.cos(b1))
    beta, dl = F.asin(q(F.sin(F.radians(lat))) / qp), F.radians(lon - 10)
    b = rq * F.sqrt(2 / (1 + math.sin(b1) * F.sin(beta) + math.cos(b1) * F.cos(beta) * F.cos(dl)))
    return 4321000 + b * d * F.cos(beta) * F.sin(dl), 3210000 + b / d * (math.cos(b1) * F.sin(beta) - math.sin(b1) * F.cos(beta) * F.cos(dl))


def utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:326zz by the Krueger series to the third order (millimetres within a zone)."""
    n = F_GRS80 / (2 - F_GRS80)
    a = A_GRS80 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    k = 2 * math.sqrt(n) / (1 + n)
    p, dl = F.radians(lat), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(F.sin(p)) - k * F.atanh(k * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, c in enumerate(alpha, 1):
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + 0.9996 * a * x, 0.9996 * a * y


def pixel_to_world(row: Column, col: Column, affine: tuple[float, ...]) -> tuple[Column, Column]:
    a, b, c, d, e, f = affine
    return a * col + b * row + c, d * col + e * row + f


def world_to_pixel(x: Column, y: Column, affine: tuple[float, ...]) -> tuple[Column, Column]:
    """Row and column whose pixel holds the point."""
    a, b, c, d, e, f = affine
    det = a * e - b * d
    col = (e * (x - c) - b * (y - f)) / det
    row = (a * (y - f) - d * (x - c)) / det
    return F.floor(row).cast("int"), F.floor(col).cast("int")
