"""Outlines of corridors around polylines, and which cells of a grid they cover, in numpy.

Coordinates are degrees; a line's longitudes run on past 180 where it crosses the antimeridian.  A
point is inside an outline if the outline winds around it (the nonzero rule), so overlaps of a
corridor with itself stay inside.
"""

from __future__ import annotations

import numpy as np

#: Metres of a degree of latitude.
DEGREE_M = 6371008.8 * np.pi / 180
#: Chords for a full circle of a round end or bend.
CHORDS = 64


def unwrapped(lon: np.ndarray) -> np.ndarray:
    """Longitudes of a line without jumps of more than half a turn."""
    step = np.diff(lon)
    return lon + np.r_[0.0, np.cumsum(-360.0 * np.round(step / 360.0))]


def _arc(centre: np.ndarray, first: float, turn: float, width_m: float) -> np.ndarray:
    """Points of an arc around ``centre`` that begins at angle ``first``, both ends included."""
    n = max(1, int(np.ceil(abs(turn) / (2 * np.pi / CHORDS))))
    angle = first + turn * np.arange(n + 1) / n
    # Chords lie a little outside and inside of the circle by turns of half their sag.
    scale = width_m / DEGREE_M
    return centre + np.stack([np.cos(angle) / np.cos(np.radians(centre[1])), np.sin(angle)], 1) * scale


def _crossing(a: np.ndarray, b: np.ndarray) -> tuple[float, float] | None:
    """Where two stretches (two points each) cross, as shares of both; None if they do not."""
    d, e, f = a[1] - a[0], b[1] - b[0], b[0] - a[0]
    det = d[0] * e[1] - d[1] * e[0]
    if abs(det) < 1e-18:
        return None
    s, t = (f[0] * e[1] - f[1] * e[0]) / det, (f[0] * d[1] - f[1] * d[0]) / det
    return (s, t) if 0 <= s <= 1 and 0 <= t <= 1 else None


def offset_ring(lon: np.ndarray, lat: np.ndarray, width_m: float) -> np.ndarray:
    """Closed ring (n, 2) at ``width_m`` around a line: its two offset curves with round bends and ends.

    On the inner side of a bend neighbouring stretches are cut where they cross.  Where they do not,
    as in bends tighter than the width, the ring goes over the vertex; it then winds around some
    places more than once but around no place outside.
    """
    points = np.stack([unwrapped(np.asarray(lon, float)), np.asarray(lat, float)], 1)
    points = points[np.r_[True, np.any(np.diff(points, axis=0) != 0, axis=1)]]
    if len(points) == 1:
        return np.concatenate([ring := _arc(points[0], 0.0, 2 * np.pi, width_m)[:-1], ring[:1]])
    forth = _side(points, width_m)
    back = _side(points[::-1], width_m)
    ring = np.concatenate([forth, back])
    return np.concatenate([ring, ring[:1]])


def _side(points: np.ndarray, width_m: float) -> np.ndarray:
    """The offset curve on the left of a line, with the half circle around its last point."""
    delta = np.diff(points, axis=0)
    middle = np.cos(np.radians((points[1:, 1] + points[:-1, 1]) / 2))
    angle = np.arctan2(delta[:, 1], delta[:, 0] * middle) + np.pi / 2
    shift = lambda p, k: p + np.array([np.cos(angle[k]) / np.cos(np.radians(p[1])), np.sin(angle[k])]) * (width_m / DEGREE_M)
    n = len(delta)
    legs = np.array([[shift(points[k], k), shift(points[k + 1], k)] for k in range(n)])
    turn = (np.diff(angle) + np.pi) % (2 * np.pi) - np.pi
    first, last = np.zeros(n), np.ones(n)
    for k in np.flatnonzero(turn > 0):  # a bend to the left: the left side is the inner one
        if at := _crossing(legs[k], legs[k + 1]):
            last[k], first[k + 1] = at
    spoilt = first > last  # a stretch that is cut away from both ends keeps its whole length
    for k in np.flatnonzero(spoilt):
        first[k], last[k] = 0.0, 1.0
        if k:
            last[k - 1] = 1.0
        if k + 1 < n:
            first[k + 1] = 0.0
    along = lambda k, share: legs[k, 0] + (legs[k, 1] - legs[k, 0]) * share
    out = []
    for k in range(n):
        out += [along(k, first[k])[None], along(k, last[k])[None]]
        if k + 1 < n:
            if turn[k] < 0:
                out.append(_arc(points[k + 1], angle[k], turn[k], width_m))
            elif last[k] == 1.0 or first[k + 1] == 0.0:
                out.append(points[k + 1][None])
    out.append(_arc(points[-1], angle[-1], -np.pi, width_m))
    return np.concatenate(out)


def simplified(ring: np.ndarray, tolerance_deg: float) -> np.ndarray:
    """A closed ring by the rule of Douglas and Peucker: no vertex that goes lies farther than the tolerance from what stays."""
    if len(ring) < 5:
        return ring
    far = int(np.argmax(np.sum((ring - ring[0]) ** 2, axis=1)))
    keep = np.zeros(len(ring), bool)
    keep[[0, far, len(ring) - 1]] = True
    stretches = [(0, far), (far, len(ring) - 1)]
    while stretches:
        a, b = stretches.pop()
        if b - a < 2:
            continue
        p, d = ring[a + 1 : b] - ring[a], ring[b] - ring[a]
        length = d @ d
        along = np.clip(p @ d / length, 0, 1) if length else np.zeros(len(p))
        away = np.sum((p - along[:, None] * d) ** 2, axis=1)
        k = int(np.argmax(away))
        if away[k] > tolerance_deg**2:
            keep[a + 1 + k] = True
            stretches += [(a, a + 1 + k), (a + 1 + k, b)]
    return ring[keep] if keep.sum() >= 4 else ring


def windings(ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How often a closed ring winds around each point: edges to the west that pass its latitude, upward ones minus downward ones.

    An edge passes the latitudes from its lower end up to, not including, its upper end, and a point
    on an edge is east of it.
    """
    out = np.zeros(len(x), np.int64)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        up, down = (y1 <= y) & (y < y2), (y2 <= y) & (y < y1)
        hit = up | down
        if hit.any():
            east = np.zeros(len(x), bool)
            east[hit] = x[hit] >= x1 + (y[hit] - y1) * (x2 - x1) / (y2 - y1)
            out += (up & east).astype(np.int64) - (down & east).astype(np.int64)
    return out


def covered_cells(ring: np.ndarray, size: float) -> list[tuple[int, int, int, list[list[float]]]]:
    """(row, column, winding at the cell's centre, edges near the cell) of all cells that the ring touches or winds around."""
    edges: dict[tuple[int, int], list[list[float]]] = {}
    passing: dict[int, list[list[float]]] = {}
    for (x1, y1), (x2, y2) in zip(ring.tolist(), ring[1:].tolist(), strict=False):
        if y1 == y2 and x1 == x2:
            continue
        low, high = int(np.floor(min(y1, y2) / size)), int(np.floor(max(y1, y2) / size))
        for row in range(low, high + 1):
            a, b = row * size, (row + 1) * size
            ends = [x for x, y in ((x1, y1), (x2, y2)) if a <= y <= b]
            if y1 != y2:
                ends += [x1 + (y - y1) * (x2 - x1) / (y2 - y1) for y in (a, b) if min(y1, y2) <= y <= max(y1, y2)]
            passing.setdefault(row, []).append([x1, y1, x2, y2])
            # One cell more on both sides keeps what rounding might lose.
            for column in range(int(np.floor(min(ends) / size - 1e-9)), int(np.floor(max(ends) / size + 1e-9)) + 1):
                edges.setdefault((row, column), []).append([x1, y1, x2, y2])
    out = []
    for row, all_edges in passing.items():
        columns = [c for r, c in edges if r == row]
        y, e = (row + 0.5) * size, np.array(all_edges)
        up, down = (e[:, 1] <= y) & (y < e[:, 3]), (e[:, 3] <= y) & (y < e[:, 1])
        hit = up | down
        e, way = e[hit], np.where(up, 1, -1)[hit]
        at = e[:, 0] + (y - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
        order = np.argsort(at)
        at, sums = at[order], np.r_[0, np.cumsum(way[order])]
        for column in range(min(columns), max(columns) + 1):
            winding = int(sums[np.searchsorted(at, (column + 0.5) * size, "right")])
            near = edges.get((row, column), [])
            if winding or near:
                out.append((row, column, winding, near))
    return out
