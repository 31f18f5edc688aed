"""Polygon geometry on WKB: numpy kernels and the Arrow functions over them.

A geometry is a list of polygons, each a list of rings, each an (n, 2) array without the
closing point.  Points and lines are kept as polygons of degenerate rings by kind.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)


def _read(buf: memoryview, at: int) -> tuple[int, list, int]:
    order = "<" if buf[at] else ">"
    kind = struct.unpack_from(order + "I", buf, at + 1)[0]
    at += 5
    dims = 2
    if kind & 0x20000000:
        at += 4
    if kind & 0x80000000 or (kind & 0xFFFF) // 1000 in (1, 2):
        dims = 3
    if kind & 0x40000000 or (kind & 0xFFFF) // 1000 == 3:
        dims += 1
    kind = (kind & 0xFFFF) % 1000

    def points(at: int, n: int) -> tuple[np.ndarray, int]:
        size = n * dims * 8
        return np.frombuffer(buf[at : at + size], dtype=order + "f8").reshape(n, dims)[:, :2].astype(float), at + size

    if kind == POINT:
        xy, at = points(at, 1)
        return kind, [[xy]] if np.isfinite(xy).all() else [], at
    if kind in (LINE, POLYGON):
        n = struct.unpack_from(order + "I", buf, at)[0]
        at += 4
        if kind == LINE:
            xy, at = points(at, n)
            return kind, [[xy]] if n else [], at
        rings = []
        for _ in range(n):
            k = struct.unpack_from(order + "I", buf, at)[0]
            xy, at = points(at + 4, k)
            rings.append(xy[:-1] if k > 1 and (xy[0] == xy[-1]).all() else xy)
        return kind, [rings] if rings else [], at
    n = struct.unpack_from(order + "I", buf, at)[0]
    at += 4
    parts = []
    for _ in range(n):
        _, own, at = _read(buf, at)
        parts += own
    return kind, parts, at


def read_wkb(data: bytes | None) -> tuple[int, list]:
    """Kind and parts; nothing for null or unreadable bytes."""
    if not data:
        return 0, []
    try:
        kind, parts, _ = _read(memoryview(bytes(data)), 0)
    except (struct.error, ValueError, IndexError):
        return 0, []
    return kind, parts


def write_wkb(parts: list, kind: int = POLYGON) -> bytes:
    def ring(xy: np.ndarray) -> bytes:
        closed = np.vstack([xy, xy[:1]])
        return struct.pack("<I", len(closed)) + closed.astype("<f8").tobytes()

    def polygon(rings: list) -> bytes:
        return struct.pack("<BII", 1, POLYGON, len(rings)) + b"".join(map(ring, rings))

    if kind == POINT:
        return struct.pack("<BI", 1, POINT) + np.asarray(parts[0][0][0], "<f8").tobytes()
    if len(parts) == 1 and kind == POLYGON:
        return polygon(parts[0])
    return struct.pack("<BII", 1, MULTIPOLYGON, len(parts)) + b"".join(map(polygon, parts))


def strip_gpkg(blob: bytes | None) -> bytes | None:
    """WKB of a GeoPackage geometry blob."""
    if not blob or blob[:2] != b"GP":
        return None
    envelope = (blob[3] >> 1) & 7
    return None if blob[3] & 0x10 else bytes(blob[8 + (0, 32, 48, 48, 64)[envelope] :])


def signed_area(xy: np.ndarray) -> float:
    if len(xy) < 3:
        return 0.0
    x, y = (xy - xy[0]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def area(parts: list) -> float:
    return sum(abs(signed_area(p[0])) - sum(abs(signed_area(h)) for h in p[1:]) for p in parts)


def centroid(parts: list) -> tuple[float, float]:
    from boskage.functions.wkt import ring_moments

    total = np.zeros(3)
    for p in parts:
        for k, r in enumerate(p):
            if len(r) >= 3:
                total += np.array(ring_moments(r)) * (-1 if k else 1)
    if total[0] > 0:
        return float(total[1] / total[0]), float(total[2] / total[0])
    xy = np.vstack([r for p in parts for r in p]) if parts else np.full((1, 2), np.nan)
    return float(xy[:, 0].mean()), float(xy[:, 1].mean())


def bounds(parts: list) -> tuple[float, float, float, float]:
    xy = np.vstack([p[0] for p in parts])
    return (*map(float, xy.min(0)), *map(float, xy.max(0)))


def hull(xy: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise from the lowest left point."""
    pts = sorted(set(map(tuple, np.asarray(xy, float).tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def half(seq) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(reversed(pts)))


def simplify_line(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker without recursion."""
    keep = np.zeros(len(xy), bool)
    keep[[0, -1]] = True
    stack = [(0, len(xy) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = xy[b] - xy[a]
        rest = xy[a + 1 : b] - xy[a]
        size = math.hypot(*d)
        off = np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / size if size else np.hypot(*rest.T)
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return xy[keep]


def simplify(parts: list, tolerance: float) -> list:
    """Rings simplified; rings that fall below three points are dropped (an outer ring with its part)."""
    out = []
    for p in parts:
        rings = [simplify_line(np.vstack([r, r[:1]]), tolerance)[:-1] for r in p]
        if len(rings[0]) >= 3:
            out.append([rings[0], *(h for h in rings[1:] if len(h) >= 3)])
    return out


def contains_points(parts: list, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd rule over all rings."""
    inside = np.zeros(len(x), bool)
    for p in parts:
        for r in p:
            x1, y1 = r.T
            x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
            cross = (y1 > y[:, None]) != (y2 > y[:, None])
            with np.errstate(divide="ignore", invalid="ignore"):
                at = (x2 - x1) * (y[:, None] - y1) / (y2 - y1) + x1
            inside ^= (cross & (x[:, None] < at)).sum(1) % 2 == 1
    return inside


def _segments(parts: list) -> np.ndarray:
    rows = [np.hstack([r, np.roll(r, -1, 0)]) if len(r) > 1 else np.hstack([r, r]) for p in parts for r in p]
    return np.vstack(rows) if rows else np.zeros((0, 4))


def _segments_cross(a: np.ndarray, b: np.ndarray) -> bool:
    side = lambda s, px, py: (s[:, None, 2] - s[:, None, 0]) * (py - s[:, None, 1]) - (s[:, None, 3] - s[:, None, 1]) * (px - s[:, None, 0])
    a1, a2 = side(a, b[:, 0], b[:, 1]), side(a, b[:, 2], b[:, 3])
    b1, b2 = side(b, a[:, 0], a[:, 1]).T, side(b, a[:, 2], a[:, 3]).T
    return bool(((a1 * a2 <= 0) & (b1 * b2 <= 0) & ~((a1 == 0) & (a2 == 0))).any())


#: Pairs of edges that a kernel looks at at once.
BLOCK = 1_000_000


def _blocks(n: int, m: int):
    step = max(1, BLOCK // max(1, m))
    return (slice(a, a + step) for a in range(0, n, step))


def points_to_segments(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Distance of each point to the nearest of some segments."""
    out = np.empty(len(x))
    d = s[:, 2:] - s[:, :2]
    size = (d * d).sum(1)
    size = np.where(size > 0, size, 1)  # a segment without extent is its first point
    for own in _blocks(len(x), len(s)):
        rx, ry = x[own, None] - s[:, 0], y[own, None] - s[:, 1]
        t = np.clip((rx * d[:, 0] + ry * d[:, 1]) / size, 0, 1)
        out[own] = np.hypot(rx - t * d[:, 0], ry - t * d[:, 1]).min(1)
    return out


def segment_distance(a: np.ndarray, b: np.ndarray) -> float:
    return float(min(points_to_segments(p[:, k], p[:, k + 1], q).min() for p, q in ((a, b), (b, a)) for k in (0, 2)))


def distance(a: list, b: list) -> float:
    """Distance of two geometries, 0 where they meet."""
    if not a or not b:
        return math.nan
    sa, sb = _segments(a), _segments(b)
    if any(_segments_cross(sa[own], sb) for own in _blocks(len(sa), len(sb))):
        return 0.0
    # no edges meet, so a part lies in the other geometry wholly or not at all
    for p, q in ((a, b), (b, a)):
        first = np.array([part[0][0] for part in p])
        if contains_points(q, *first.T).any():
            return 0.0
    return segment_distance(sa, sb)


def point_gaps(parts: list, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of each point to a geometry, 0 inside."""
    near = points_to_segments(x, y, _segments(parts))
    return np.where(contains_points(parts, x, y), 0.0, near)


def overlap_area(a: list, b: list) -> float:
    """Area of the intersection by vertical slabs: between neighbouring events no edges cross, so each slab is exact."""
    sa, sb = _segments(a), _segments(b)
    if not len(sa) or not len(sb):
        return 0.0
    low, high = max(sa[:, [0, 2]].min(), sb[:, [0, 2]].min()), min(sa[:, [0, 2]].max(), sb[:, [0, 2]].max())
    if low >= high:
        return 0.0
    xs = [sa[:, 0], sb[:, 0]]
    d1, d2 = sa[:, None, 2:] - sa[:, None, :2], sb[None, :, 2:] - sb[None, :, :2]
    den = d1[..., 0] * d2[..., 1] - d1[..., 1] * d2[..., 0]
    rel = sb[None, :, :2] - sa[:, None, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (rel[..., 0] * d2[..., 1] - rel[..., 1] * d2[..., 0]) / den
        u = (rel[..., 0] * d1[..., 1] - rel[..., 1] * d1[..., 0]) / den
    hit = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    xs.append((sa[:, None, 0] + np.where(hit, t, 0) * d1[..., 0])[hit])
    x = np.unique(np.concatenate([np.clip(np.concatenate(xs), low, high), [low, high]]))
    total = 0.0
    for x1, x2 in zip(x[:-1], x[1:]):
        mid = (x1 + x2) / 2
        spans = []
        for s in (sa, sb):
            cut = s[(np.minimum(s[:, 0], s[:, 2]) < mid) & (np.maximum(s[:, 0], s[:, 2]) > mid)]
            at = lambda v, c=cut: c[:, 1] + (v - c[:, 0]) / (c[:, 2] - c[:, 0]) * (c[:, 3] - c[:, 1])
            order = np.argsort(at(mid))
            spans.append(np.column_stack([at(x1), at(mid), at(x2)])[order])
        p, q = spans
        for i in range(0, len(p) - 1, 2):
            for j in range(0, len(q) - 1, 2):
                bottom = p[i] if p[i][1] >= q[j][1] else q[j]
                top = p[i + 1] if p[i + 1][1] <= q[j + 1][1] else q[j + 1]
                if top[1] > bottom[1]:
                    total += (x2 - x1) * ((top[0] - bottom[0]) + (top[2] - bottom[2])) / 2
    return total


def clip_convex(ring: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """A ring cut to a convex, counter-clockwise mask."""
    out = ring
    for (ax, ay), (bx, by) in zip(mask, np.roll(mask, -1, 0)):
        if len(out) == 0:
            break
        side = (bx - ax) * (out[:, 1] - ay) - (by - ay) * (out[:, 0] - ax)
        nxt, pts = np.roll(side, -1), []
        for k in range(len(out)):
            p, q = out[k], out[(k + 1) % len(out)]
            if side[k] >= 0:
                pts.append(p)
            if (side[k] >= 0) != (nxt[k] >= 0):
                pts.append(p + (q - p) * side[k] / (side[k] - nxt[k]))
        out = np.array(pts).reshape(-1, 2)
    return out


def clip_box(parts: list, minx: float, miny: float, maxx: float, maxy: float) -> list:
    mask = np.array([[minx, miny], [maxx, miny], [maxx, maxy], [minx, maxy]])
    out = []
    for p in parts:
        rings = [clip_convex(r, mask) for r in p]
        if len(rings[0]) >= 3 and abs(signed_area(rings[0])) > 0:
            out.append([rings[0], *(h for h in rings[1:] if len(h) >= 3)])
    return out


def normalise(parts: list) -> list:
    """Outer rings counter-clockwise, holes clockwise, each from its lowest point; holes and parts in order."""

    def turn(r: np.ndarray, ccw: bool) -> np.ndarray:
        r = r if (signed_area(r) > 0) == ccw else r[::-1]
        k = min(range(len(r)), key=lambda i: tuple(r[i]))
        return np.roll(r, -k, 0)

    whole = [[turn(p[0], True), *sorted((turn(h, False) for h in p[1:]), key=lambda h: h.tolist())] for p in parts]
    return sorted(whole, key=lambda p: p[0].tolist())


def is_simple(ring: np.ndarray) -> bool:
    """Whether no two edges that aren't neighbours meet."""
    s, n = _segments([[ring]]), len(ring)
    for i in range(n):
        far = [j for j in range(i + 2, n) if not (i == 0 and j == n - 1)]
        if far and _segments_cross(s[i : i + 1], s[far]):
            return False
    return n >= 3


def right_angle_pairs(ring: np.ndarray, tolerance: float = 10.0) -> int:
    """Ordered pairs of different edges that are parallel or perpendicular within a tolerance in degrees."""
    d = np.roll(ring, -1, 0) - ring
    size = np.hypot(*d.T)
    ok = size > 0
    u = d[ok] / size[ok][:, None]
    angle = np.degrees(np.arccos(np.clip(u @ u.T, -1, 1)))
    near = (angle <= tolerance) | (np.abs(angle - 90) <= tolerance) | (np.abs(angle - 180) <= tolerance)
    np.fill_diagonal(near, False)
    return int(near.sum())


def fractal_dimension(segments: int, size: float) -> float:
    return 2 * math.log(segments) / math.log(size) if segments > 0 and size > 1 else math.nan


def valid_clear_cut(parts: list, tolerance: float = 10.0, hole: float = 100.0, most_fractal: float = 0.56) -> bool:
    """Whether an outline looks man-made after simplification: simple, without large holes, smooth, with regular corners."""
    parts = simplify(parts, tolerance)
    if len(parts) != 1 or not is_simple(parts[0][0]):
        return False
    if any(abs(signed_area(h)) > hole for h in parts[0][1:]):
        return False
    return fractal_dimension(len(parts[0][0]), area(parts)) < most_fractal and right_angle_pairs(parts[0][0]) != 0


#: Coordinates of overlays are rounded to this many decimals (of metres); edges nearer than that are one.
DECIMALS = 6


def _noded(s: np.ndarray) -> np.ndarray:
    """Edges cut where they meet one another, without direction and each once."""
    s = np.round(s, DECIMALS)
    s = s[(s[:, :2] != s[:, 2:]).any(1)]
    slack = 10.0**-DECIMALS
    cuts: list[set] = [{(0.0, (x1, y1)), (1.0, (x2, y2))} for x1, y1, x2, y2 in s.tolist()]
    d = s[:, 2:] - s[:, :2]
    size = np.hypot(*d.T)
    for own in _blocks(len(s), len(s)):
        p, dp = s[own], d[own]
        rel = s[None, :, :2] - p[:, None, :2]
        den = dp[:, None, 0] * d[None, :, 1] - dp[:, None, 1] * d[None, :, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (rel[..., 0] * d[None, :, 1] - rel[..., 1] * d[None, :, 0]) / den
            u = (rel[..., 0] * dp[:, None, 1] - rel[..., 1] * dp[:, None, 0]) / den
        e, f = slack / size[own][:, None], slack / size[None, :]
        for i, j in zip(*np.nonzero((den != 0) & (t > -e) & (t < 1 + e) & (u > -f) & (u < 1 + f))):
            k = own.start + int(i)
            if k < j:  # one point for both edges, an end of theirs where it is one
                x, y = s[k, :2] + t[i, j] * d[k]
                ends = [(s[m, c], s[m, c + 1]) for m in (k, j) for c in (0, 2)]
                off, at = min((math.hypot(x - q[0], y - q[1]), q) for q in ends)
                at = at if off <= 2 * slack else (round(float(x), DECIMALS), round(float(y), DECIMALS))
                at = (float(at[0]), float(at[1]))
                cuts[k].add((float(t[i, j]), at))
                cuts[j].add((float(u[i, j]), at))
        # ends of other edges on this one, for edges along each other
        for ends in (s[:, :2], s[:, 2:]):
            r = ends[None] - p[:, None, :2]
            along = (r * dp[:, None]).sum(2) / size[own][:, None] ** 2
            off = np.abs(r[..., 0] * dp[:, None, 1] - r[..., 1] * dp[:, None, 0]) / size[own][:, None]
            for i, j in zip(*np.nonzero((off < slack) & (along > 0) & (along < 1))):
                cuts[own.start + int(i)].add((float(along[i, j]), (float(ends[j, 0]), float(ends[j, 1]))))
    out = set()
    for own in cuts:
        at = [q for _, q in sorted(own)]
        out.update((min(p, q), max(p, q)) for p, q in zip(at, at[1:]) if p != q)
    return np.array([(*p, *q) for p, q in sorted(out)]).reshape(-1, 4)


def _rings(edges: np.ndarray) -> list:
    """Polygons of directed edges that have the inside on their left."""
    leaving: dict[tuple, list] = {}
    for x1, y1, x2, y2 in edges.tolist():
        leaving.setdefault((x1, y1), []).append((x2, y2))
    outer, holes = [], []
    for start in list(leaving):
        while leaving.get(start):
            ring, here = [start], leaving[start].pop()
            before = start
            while here != start:
                ring.append(here)
                ways = leaving.get(here)
                if not ways:
                    break
                if len(ways) > 1:  # the sharpest turn to the left parts shapes that touch in a point
                    back = math.atan2(before[1] - here[1], before[0] - here[0])
                    ways.sort(key=lambda q: (back - math.atan2(q[1] - here[1], q[0] - here[0])) % (2 * math.pi), reverse=True)
                before, here = here, ways.pop()
            if here == start and len(ring) >= 3:
                xy = np.array(ring)
                (outer if signed_area(xy) > 0 else holes).append(xy)
    parts = [[r] for r in sorted(outer, key=lambda r: abs(signed_area(r)))]
    for h in holes:
        mid = (h[0] + h[1]) / 2
        for p in parts:  # the smallest that holds it
            if contains_points([[p[0]]], mid[:1], mid[1:])[0]:
                p.append(h)
                break
    return parts


def overlay(sets: list[list], keep) -> list:
    """The polygons where ``keep`` holds: a function of an array (sets, points) that tells in which of the geometries a point lies."""
    rows = [_segments(g) for g in sets if g]
    if not rows:
        return []
    edges = _noded(np.vstack(rows))
    if not len(edges):
        return []
    d = edges[:, 2:] - edges[:, :2]
    size = np.hypot(*d.T)
    mid = (edges[:, :2] + edges[:, 2:]) / 2
    off = np.column_stack([-d[:, 1], d[:, 0]]) / size[:, None] * np.minimum(10 ** (1.0 - DECIMALS), size / 4)[:, None]
    sides = []
    for at in (mid + off, mid - off):
        inside = np.zeros((len(sets), len(at)), bool)
        for k, g in enumerate(sets):
            if g:
                x1, y1, x2, y2 = bounds(g)
                near = (at[:, 0] >= x1) & (at[:, 0] <= x2) & (at[:, 1] >= y1) & (at[:, 1] <= y2)
                for own in _blocks(int(near.sum()), sum(len(r) for p in g for r in p)):
                    rows_ = np.flatnonzero(near)[own]
                    inside[k, rows_] = contains_points(g, *at[rows_].T)
        sides.append(keep(inside))
    left, right = sides
    ahead, back = edges[left & ~right], edges[right & ~left][:, [2, 3, 0, 1]]
    return _rings(np.vstack([ahead, back]))


def union(sets: list[list]) -> list:
    return overlay(sets, lambda inside: inside.any(0))


def intersection(a: list, b: list) -> list:
    return overlay([a, b], lambda inside: inside[0] & inside[1])


def difference(a: list, b: list) -> list:
    return overlay([a, b], lambda inside: inside[0] & ~inside[1])


MEASURES = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in ("kind", "parts", "segments", "holes")]
    + [T.StructField(c, T.DoubleType()) for c in ("area", "cx", "cy", "minx", "miny", "maxx", "maxy", "max_hole")]
    + [T.StructField("simple", T.BooleanType()), T.StructField("angles", T.IntegerType()), T.StructField("hull_area", T.DoubleType())]
)


@F.pandas_udf(MEASURES)
def measure(wkb: pd.Series) -> pd.DataFrame:
    """Everything about a WKB geometry that needs its coordinates, in one pass; nulls for empty ones."""
    rows = []
    for data in wkb:
        kind, parts = read_wkb(data)
        if not parts:
            rows.append((kind or None, 0, 0, 0) + (None,) * 11)
            continue
        holes = [abs(signed_area(h)) for p in parts for h in p[1:]]
        outer = parts[0][0]
        xy = np.vstack([p[0] for p in parts])
        own = hull(xy)
        polygon = kind in (POLYGON, MULTIPOLYGON)
        rows.append(
            (kind, len(parts), sum(len(p[0]) for p in parts) if polygon else 0, len(holes), area(parts) if polygon else 0.0, *centroid(parts), *bounds(parts),
             max(holes, default=0.0), all(is_simple(p[0]) for p in parts) if polygon else True, right_angle_pairs(outer) if polygon else 0, abs(signed_area(own)))
        )
    return pd.DataFrame(rows, columns=["kind", "parts", "segments", "holes", "area", "cx", "cy", "minx", "miny", "maxx", "maxy", "max_hole", "simple", "angles", "hull_area"])


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("minx", "miny", "maxx", "maxy")]))
def boxed(wkb: pd.Series) -> pd.DataFrame:
    """Bounds of a WKB geometry; nulls for empty ones."""
    rows = [bounds(parts) if (parts := read_wkb(w)[1]) else (None,) * 4 for w in wkb]
    return pd.DataFrame(rows, columns=["minx", "miny", "maxx", "maxy"], dtype=float)


def transform_udf(function):
    """A WKB to WKB function of parts as a pandas UDF; empty results are null."""

    @F.pandas_udf(T.BinaryType())
    def run(wkb: pd.Series) -> pd.Series:
        out = []
        for data in wkb:
            kind, parts = read_wkb(data)
            made = function(parts) if parts else []
            out.append(write_wkb(made, POLYGON if len(made) == 1 else MULTIPOLYGON) if made else None)
        return pd.Series(out, dtype=object)

    return run


def simplified(tolerance: float):
    return transform_udf(lambda parts: simplify(parts, tolerance))


normalised = transform_udf(normalise)
hulled = transform_udf(lambda parts: [[hull(np.vstack([p[0] for p in parts]))]])


def clipped_to(minx: float, miny: float, maxx: float, maxy: float):
    return transform_udf(lambda parts: clip_box(parts, minx, miny, maxx, maxy))


@F.pandas_udf(T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("overlap", T.DoubleType())]))
def relate(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Distance and area of intersection of two WKB geometries."""
    rows = []
    for x, y in zip(a, b):
        p, q = read_wkb(x)[1], read_wkb(y)[1]
        rows.append((distance(p, q), overlap_area(p, q)) if p and q else (None, None))
    return pd.DataFrame(rows, columns=["distance", "overlap"])


_PARSED: dict[bytes, list] = {}


def _parsed(data: bytes) -> list:
    """Parts of a geometry; the geometries of the last batches are kept."""
    data = bytes(data)
    if (parts := _PARSED.get(data)) is None:
        if len(_PARSED) >= 4096:
            _PARSED.clear()
        parts = _PARSED[data] = read_wkb(data)[1]
    return parts


@F.pandas_udf(T.DoubleType())
def gap(a: pd.Series, ax: pd.Series, ay: pd.Series, b: pd.Series, bx: pd.Series, by: pd.Series) -> pd.Series:
    """Distance of two geometries in WKB, 0 where they meet; a null geometry is the point beside it."""
    ax, ay, bx, by = (v.to_numpy(float) for v in (ax, ay, bx, by))
    out = np.hypot(ax - bx, ay - by)
    one: dict[bytes, tuple[list, list, list]] = {}
    for i, (p, q) in enumerate(zip(a, b)):
        if p is not None and q is not None:
            out[i] = distance(_parsed(p), _parsed(q))
        elif p is not None or q is not None:
            own = one.setdefault(bytes(p if p is not None else q), ([], [], []))
            for k, v in enumerate((i, bx[i], by[i]) if p is not None else (i, ax[i], ay[i])):
                own[k].append(v)
    for data, (at, x, y) in one.items():
        parts = _parsed(data)
        out[at] = point_gaps(parts, np.array(x), np.array(y)) if parts else np.nan
    return pd.Series(out)


def _pairwise(function):
    @F.pandas_udf(T.BinaryType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(a, b):
            made = function(_parsed(p) if p is not None else [], _parsed(q) if q is not None else [])
            out.append(write_wkb(made, POLYGON if len(made) == 1 else MULTIPOLYGON) if made else None)
        return pd.Series(out, dtype=object)

    return run


cut_to = _pairwise(intersection)
cut_away = _pairwise(difference)


@F.pandas_udf(T.BooleanType())
def clear_cut_ok(wkb: pd.Series) -> pd.Series:
    return pd.Series([valid_clear_cut(read_wkb(w)[1]) if read_wkb(w)[1] else False for w in wkb])


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def exploded(wkb: pd.Series) -> pd.Series:
    """The parts of a geometry as geometries of their own."""
    return pd.Series([[write_wkb([p]) for p in read_wkb(w)[1]] for w in wkb])


@F.pandas_udf(T.BinaryType())
def collected(parts: pd.Series) -> pd.Series:
    """One geometry of an array of WKB polygons (their parts side by side)."""
    out = []
    for group in parts:
        own = [p for w in (group if group is not None else []) for p in read_wkb(w)[1]]
        out.append(write_wkb(own, MULTIPOLYGON) if own else None)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.BinaryType())
def box_wkb(x: pd.Series, y: pd.Series, size: pd.Series) -> pd.Series:
    """Squares by their lower left corner and size."""
    return pd.Series([write_wkb([[np.array([[a, b], [a + w, b], [a + w, b + w], [a, b + w]], float)]]) for a, b, w in zip(x, y, size)], dtype=object)
