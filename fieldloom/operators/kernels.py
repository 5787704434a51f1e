"""Numpy kernels of the grouped operators."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd


def squared_distance(mask: np.ndarray) -> np.ndarray:
    """Squared distance to the nearest False pixel: per column by two sweeps, per row by the lower envelope of parabolas."""
    h, w = mask.shape
    far = h + w + 1
    g = np.where(mask, far, 0).astype(np.int64)
    for i in range(1, h):
        g[i] = np.minimum(g[i], g[i - 1] + 1)
    for i in range(h - 2, -1, -1):
        g[i] = np.minimum(g[i], g[i + 1] + 1)
    g = g * g
    out = np.empty_like(g)
    for i in range(h):
        f, at, cut = g[i], [0], [-np.inf]
        for q in range(1, w):
            while True:
                p = at[-1]
                s = (f[q] + q * q - f[p] - p * p) / (2 * (q - p))
                if s > cut[-1] or len(at) == 1:
                    break
                at.pop()
                cut.pop()
            if s <= cut[-1]:
                at, cut = [q], [-np.inf]
            else:
                at.append(q)
                cut.append(s)
        k = np.searchsorted(cut, np.arange(w), side="right") - 1
        p = np.array(at)[k]
        out[i] = (np.arange(w) - p) ** 2 + f[p]
    return out


def row_envelopes(sizes: np.ndarray, columns: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Squared distances along rows: the least (c - q)^2 + up(q)^2 over the row's columns q.

    Rows lie one after another, ``sizes`` long, columns rising; ``up`` is NaN where a column has no background.
    """
    out = np.full(len(columns), np.nan)
    for low, high in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes)):
        c, g = columns[low:high].astype(np.int64), up[low:high]
        some = np.flatnonzero(~np.isnan(g.astype(float)))
        if not len(some):
            continue
        q, f = c[some], g[some].astype(np.int64) ** 2
        at, cut = [0], [-np.inf]
        for k in range(1, len(q)):
            while True:
                p = at[-1]
                s = (f[k] + q[k] * q[k] - f[p] - q[p] * q[p]) / (2 * (q[k] - q[p]))
                if s > cut[-1]:
                    at.append(k)
                    cut.append(s)
                    break
                at.pop()
                cut.pop()
                if not at:
                    at, cut = [k], [-np.inf]
                    break
        best = np.array(at)[np.searchsorted(cut, c, side="right") - 1]
        out[low:high] = (c - q[best]) ** 2 + f[best]
    return out


def _windowed_max(a: np.ndarray, reach: int) -> np.ndarray:
    return _lines(_lines(a, (0, reach), np.maximum), (reach, 0), np.maximum)


def stencil(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, steps: list[tuple[str, int]]) -> np.ndarray:
    """``values`` of pixels after steps of largest (max) or least (min) values in squares; NaN counts nowhere."""
    r, c = rows - rows.min(), cols - cols.min()
    for kind, reach in steps:
        of, none = (np.maximum, -np.inf) if kind == "max" else (np.minimum, np.inf)
        # along rows, then along columns: what isn't there takes no part in either
        for reach_ in ((0, reach), (reach, 0)):
            a = np.full((r.max() + 1, c.max() + 1), none)
            a[r, c] = np.where(np.isnan(values), none, values)
            values = _lines(a, reach_, of)[r, c]
            values = np.where(np.isinf(values), np.nan, values)
    return values


def _lines(a: np.ndarray, reach: tuple[int, int], of) -> np.ndarray:
    """``of`` over stretches along one axis."""
    axis = 0 if reach[0] else 1
    most, n = min(reach[axis], a.shape[axis] - 1), a.shape[axis]
    if most <= 0:
        return a
    part = lambda low, high: tuple(slice(low, high) if k == axis else slice(None) for k in (0, 1))
    out = a.copy()
    for way in (1, -1):
        done, left, span = a.copy(), most, 1  # of the next ``span`` places on one side
        while left:
            step = min(span, left)
            to, of_ = (part(0, n - step), part(step, n)) if way == 1 else (part(step, n), part(0, n - step))
            grown = done.copy()
            grown[to] = of(done[to], done[of_])
            done, span, left = grown, span + step, left - step
        out = of(out, done)
    return out


def flood(d: np.ndarray, peak: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Labels from 1: markers are 4-connected peaks, floods go by falling distance, then by age."""
    labels, count = np.zeros(mask.shape, np.int32), 0
    steps = ((-1, 0), (0, -1), (0, 1), (1, 0))
    queue: list[tuple[int, int, int, int]] = []
    order = 0
    for y, x in zip(*np.nonzero(peak)):
        if labels[y, x]:
            continue
        count += 1
        stack = [(y, x)]
        labels[y, x] = count
        while stack:
            i, j = stack.pop()
            heapq.heappush(queue, (-int(d[i, j]), order, i, j))
            order += 1
            for a, b in steps:
                if 0 <= i + a < mask.shape[0] and 0 <= j + b < mask.shape[1] and peak[i + a, j + b] and not labels[i + a, j + b]:
                    labels[i + a, j + b] = count
                    stack.append((i + a, j + b))
    while queue:
        _, _, i, j = heapq.heappop(queue)
        for a, b in steps:
            y, x = i + a, j + b
            if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not labels[y, x]:
                labels[y, x] = labels[i, j]
                heapq.heappush(queue, (-int(d[y, x]), order, y, x))
                order += 1
    return labels


def watershed_labels(mask: np.ndarray, reach: int) -> np.ndarray:
    """Labels of a whole raster, in one piece; its edge is no background."""
    d = squared_distance(mask)
    return flood(d, mask & (d > 0) & (d == _windowed_max(d, reach)), mask)


def flood_regions(pdf: pd.DataFrame, group: str) -> pd.DataFrame:
    """Floods of several connected regions (row0, col0), each in its own box: pixels with the first pixel of their marker."""
    pdf = pdf.sort_values(["row0", "col0"], kind="stable")
    r, c, d2, peak = (pdf[n].to_numpy() for n in ("px_row", "px_col", "d2", "peak"))
    ids = pdf["row0"].to_numpy(np.int64) << 32 | pdf["col0"].to_numpy(np.int64)
    cuts = np.flatnonzero(np.diff(ids, prepend=-1, append=-1))
    first = np.full((len(pdf), 2), -1, np.int32)
    for low, high in zip(cuts, cuts[1:]):
        some = slice(low, high)
        if not peak[some].any():
            continue
        top, left = r[some].min(), c[some].min()
        y, x = r[some] - top, c[some] - left
        d, on, tops = np.zeros((y.max() + 1, x.max() + 1), np.int64), np.zeros((y.max() + 1, x.max() + 1), bool), np.zeros((y.max() + 1, x.max() + 1), bool)
        d[y, x], on[y, x], tops[y, x] = d2[some], True, peak[some]
        labels = flood(d, tops, on)
        at = np.argwhere(tops)  # in the order of the scan, so a label's first peak is its marker's first pixel
        of, k = np.unique(labels[tops], return_index=True)
        marker = np.zeros((labels.max() + 1, 2), np.int32)
        marker[of] = at[k] + (top, left)
        first[some] = np.where(labels[y, x][:, None] > 0, marker[labels[y, x]], -1)
    keep = first[:, 0] >= 0
    return pd.DataFrame({group: pdf[group][keep], "px_row": pdf["px_row"][keep], "px_col": pdf["px_col"][keep], "marker_row": first[keep, 0], "marker_col": first[keep, 1]})


def boundary_rings(mask: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed rings (x, y) of pixel corners around a mask, the mask on the left; collinear corners are left out."""
    sides: dict[tuple[int, int], list[tuple[int, int]]] = {}
    padded = np.pad(mask, 1)
    for y, x in zip(*np.nonzero(mask)):
        y, x = int(y), int(x)
        for dy, dx, a, b in ((-1, 0, (x + 1, y), (x, y)), (0, -1, (x, y), (x, y + 1)), (1, 0, (x, y + 1), (x + 1, y + 1)), (0, 1, (x + 1, y + 1), (x + 1, y))):
            if not padded[y + 1 + dy, x + 1 + dx]:
                sides.setdefault(a, []).append(b)
    rings = []
    while sides:
        start = min(sides)
        ring, at, came = [start], start, None
        while True:
            ends = sides[at]
            if len(ends) > 1 and came is not None:  # a corner that two pixels share: turn so that they stay apart
                ends.sort(key=lambda e: (came[0] * (e[1] - at[1]) - came[1] * (e[0] - at[0])))
            to = ends.pop(0)
            if not ends:
                del sides[at]
            came, at = (to[0] - at[0], to[1] - at[1]), to
            if at == start:
                break
            ring.append(at)
        n = len(ring)
        rings.append([p for k, p in enumerate(ring) if (ring[k - 1][0] - p[0]) * (ring[(k + 1) % n][1] - p[1]) != (ring[k - 1][1] - p[1]) * (ring[(k + 1) % n][0] - p[0])])
    return rings


def outer_contour(mask: np.ndarray) -> list[tuple[int, int]]:
    """Pixel centres (x, y) along the outside of one 8-connected region, by border following."""
    padded = np.pad(mask, 1)
    y, x = (int(v[0]) for v in np.nonzero(padded))
    around = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
    start, at, back = (y, x), (y, x), 4
    path = [start]
    first = None
    while True:
        for k in range(1, 9):
            turn = (back + k) % 8
            to = (at[0] + around[turn][0], at[1] + around[turn][1])
            if padded[to]:
                break
        else:
            return [(x - 1, y - 1)]
        if first is None:
            first = (at, to)
        elif (at, to) == first:
            path.pop()
            return [(b - 1, a - 1) for a, b in path]
        back, at = (turn + 4) % 8, to
        path.append(at)


def shoelace(points: np.ndarray) -> float:
    x, y = points[:, 0], points[:, 1]
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def simplify_line(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on an open line, with a stack."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    stack = [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        if b <= a + 1:
            continue
        base, inner = points[b] - points[a], points[a + 1 : b] - points[a]
        length = np.hypot(*base)
        away = np.abs(base[0] * inner[:, 1] - base[1] * inner[:, 0]) / length if length else np.hypot(inner[:, 0], inner[:, 1])
        k = int(away.argmax())
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def simplify_ring(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed ring is cut at its first point and at the one farthest from it."""
    if len(points) < 4:
        return points
    k = int(np.hypot(*(points - points[0]).T).argmax())
    if k == 0:
        return points[:1]
    one, two = simplify_line(points[: k + 1], tolerance), simplify_line(np.vstack([points[k:], points[:1]]), tolerance)
    return np.vstack([one[:-1], two[:-1]])


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Monotone chain."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts, float)

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]), float)


def least_rectangle(points: np.ndarray) -> float:
    """Area of the smallest rectangle around points: one of its sides lies on a side of the hull."""
    hull = convex_hull(points)
    if len(hull) < 3:
        return 0.0
    best = np.inf
    for a, b in zip(hull, np.roll(hull, -1, axis=0)):
        u = (b - a) / np.hypot(*(b - a))
        along, across = hull @ u, hull @ np.array([-u[1], u[0]])
        best = min(best, (along.max() - along.min()) * (across.max() - across.min()))
    return float(best)


def contour_row(pdf: pd.DataFrame, group: str, simple: bool = True) -> pd.DataFrame:
    """The outer contour of one region, given by its runs (px_row, c0, c1); ``simple``: with fewer points and its confidence."""
    rows, low, high = (pdf[n].to_numpy() for n in ("px_row", "c0", "c1"))
    r0, c0 = int(rows.min()), int(low.min())
    mask = np.zeros((rows.max() - r0 + 1, high.max() - c0 + 1), bool)
    for r, a, b in zip(rows - r0, low - c0, high - c0):
        mask[r, a : b + 1] = True
    path = np.array(outer_contour(mask), float)
    area = shoelace(path) if len(path) > 2 else 0.0
    perimeter = float(np.hypot(*(np.roll(path, -1, axis=0) - path).T).sum())
    ring = simplify_ring(path, 0.01 * perimeter) if simple else path
    box = least_rectangle(path) if simple else 0.0
    confidence = round(min(1.0, area / box), 2) if box else 0.0
    points = [{"x": float(x + c0), "y": float(y + r0)} for x, y in ring]
    return pd.DataFrame({group: [pdf[group].iloc[0]], "row0": [pdf["row0"].iloc[0]], "col0": [pdf["col0"].iloc[0]], "ring": [points], "area_px": [area], "confidence": [confidence]})


def best_cuts(n: np.ndarray, s: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Positions of the last cells of all but the last of the ``k`` stretches with the least squared distance to their means.

    Cells come in order with their number, sum and sum of squares. Dynamic programming over the stretches' ends; the best
    start of the last stretch never falls as its end rises, so each layer is solved by halving, a level at a time for all its parts.
    """
    m = len(n)
    if m <= k:
        return np.arange(m - 1)
    N, S, Q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (n, s, q))
    cost = lambda i, j: np.maximum((Q[j] - Q[i]) - (S[j] - S[i]) ** 2 / (N[j] - N[i]), 0.0)  # of cells i to j - 1
    before = np.concatenate([[np.inf], cost(np.zeros(m, int), np.arange(1, m + 1))])  # least cost of the first j cells, by j
    starts = []
    for layer in range(1, k):
        now, from_ = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        parts = np.array([[layer + 1, m, layer, m - 1]])  # ends j from low to high, starts from least to most
        while len(parts):
            low, high, least, most = parts.T
            middle = (low + high) // 2
            last = np.minimum(most, middle - 1)
            sizes = last - least + 1
            at = np.repeat(least - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            total = before[at] + cost(at, np.repeat(middle, sizes))
            edges = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(total, edges)
            hit = np.flatnonzero(total == np.repeat(best, sizes))
            first = hit[np.searchsorted(hit, edges)]
            now[middle], from_[middle] = best, at[first]
            left, right = low < middle, middle < high
            parts = np.concatenate([np.stack([low, middle - 1, least, at[first]], 1)[left], np.stack([middle + 1, high, at[first], most], 1)[right]])
        starts.append(from_)
        before = now
    ends, j = [], m
    for from_ in reversed(starts):
        j = from_[j]
        ends.append(j - 1)
    return np.array(ends[::-1])


def _digits(x: np.ndarray | float, digits: int) -> np.ndarray:
    """Rounded, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x)


def settled_centres(v: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Centres at which Lloyd's rounds over values ``v`` that occur ``n`` times end: the better of two starts, even over the range and by the deviation round the mean."""
    order = np.argsort(v)
    v, n = v[order].astype(float), n[order].astype(float)
    mean = (v * n).sum() / n.sum()
    std = np.sqrt(((v - mean) ** 2 * n).sum() / n.sum())
    place = np.array([(2 * i + 1) / (2 * k) for i in range(k)])
    best, least = None, np.inf
    for centres in (_digits(v[0] + (v[-1] - v[0]) * place, 12), _digits(mean + std * (3 * place - 1.5), 12)):
        while True:
            zone = np.abs(v[:, None] - centres).argmin(1)
            after = np.array([_digits((v[own] * n[own]).sum() / n[own].sum(), 12) if (own := zone == i).any() else c for i, c in enumerate(centres)])
            if (after == centres).all():
                break
            centres = after
        cost = float(_digits(((v - centres[zone]) ** 2 * n).sum(), 9))
        if cost < least:
            best, least = centres, cost
    return best
