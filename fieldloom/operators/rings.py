"""Rings in numpy: validity, repair, simplification that keeps the topology, and clipping into several parts.

The column functions are Arrow UDFs over ``array<struct<x, y>>``: a ring's tests look at all pairs of its sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import simplify_ring

_POINT = T.StructType().add("x", "double").add("y", "double")
#: Width of a part, against its length, that is taken for rounding.
SLIVER = 1e-12
#: Pairs of sides that are compared at once, about.
PAIRS = 1 << 18
_RING, _RINGS = T.ArrayType(_POINT), T.ArrayType(T.ArrayType(_POINT))
_ARROW_RING = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_POLYGONS = T.ArrayType(T.StructType().add("outer", _RING).add("holes", _RINGS))
_ARROW_POLYGONS = pa.list_(pa.struct([("outer", _ARROW_RING), ("holes", pa.list_(_ARROW_RING))]))


def area_of(p: np.ndarray) -> float:
    """Signed area; 0 for fewer than three points."""
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0], p[:, 1]
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def opened(points: np.ndarray) -> np.ndarray:
    """Without the closing point and points equal to the one before."""
    p = np.asarray(points, float).reshape(-1, 2)
    if not len(p):
        return p
    return p[(p != np.roll(p, 1, axis=0)).any(1)] if (p != p[0]).any() else p[:1]


def first_touch(p: np.ndarray) -> tuple[int, int, np.ndarray] | None:
    """Sides i < j of an open ring that aren't neighbours and have a point in common, and that point; None if there are none.

    Neighbouring sides count when they run back over one another.
    """
    n = len(p)
    if n < 2:
        return None
    ends = np.roll(p, -1, axis=0)
    d = ends - p
    cross = lambda a, b: a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]
    onward = np.roll(d, -1, axis=0)
    backs = (cross(d, onward) == 0) & ((d * onward).sum(1) < 0)
    slack = 1e-9 * np.ptp(p, axis=0).max()
    low, high = np.minimum(p, ends) - slack, np.maximum(p, ends) + slack
    step = max(1, PAIRS // n)
    for i0 in range(0, n, step):
        i1 = min(i0 + step, n)
        # sides whose boxes meet, by i, then by j
        near = np.triu((low[i0:i1, None] <= high[None, i0:]).all(2) & (low[None, i0:] <= high[i0:i1, None]).all(2), 2)
        if i0 == 0:
            near[0, n - 1] = False
        one, two = np.nonzero(near)
        one, two = one + i0, two + i0
        gap, turn = p[two] - p[one], cross(d[one], d[two])
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = cross(gap, d[two]) / turn, cross(gap, d[one]) / turn
            length = (d[one] * d[one]).sum(1)
            start, end = (gap * d[one]).sum(1) / length, ((gap + d[two]) * d[one]).sum(1) / length
        hit = (turn != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        over = (turn == 0) & (cross(gap, d[one]) == 0) & (np.maximum(start, end) >= 0) & (np.minimum(start, end) <= 1)
        met = np.flatnonzero(hit | over)
        back = np.flatnonzero(backs[i0:i1])
        if len(back) and (not len(met) or back[0] + i0 <= one[met[0]]):
            i = int(back[0]) + i0
            k = (i + 1) % n
            return (i, k, p[k]) if i < k else (k, i, p[k])
        if len(met):
            k = met[0]
            at = t[k] if hit[k] else min(1.0, max(0.0, min(start[k], end[k])))
            return int(one[k]), int(two[k]), p[one[k]] + at * d[one[k]]
    return None


def is_valid(points: np.ndarray) -> bool:
    """A ring of at least three points with an area whose sides meet only at their ends."""
    p = opened(points)
    return len(p) >= 3 and bool(np.isfinite(p).all()) and area_of(p) != 0 and first_touch(p) is None


def repaired(points: np.ndarray) -> list[np.ndarray]:
    """Valid rings in place of one that touches or crosses itself: it is cut where it does, and of the loops those that
    turn as the whole does stay (all that turn left if the whole has no area), largest first. None stay of a degenerate ring."""
    loops, todo = [], [opened(points)]
    while todo:
        p = todo.pop()
        if len(p) < 3 or not np.isfinite(p).all():
            continue
        touch = first_touch(p)
        if touch is None:
            loops.append(p)
            continue
        i, j, at = touch
        todo += [opened(np.vstack([[at], p[i + 1 : j + 1]])), opened(np.vstack([p[: i + 1], [at], p[j + 1 :]]))]
        if any(len(x) >= len(p) for x in todo[-2:]):  # a touch that cuts nothing off: leave the point out
            todo[-2:] = [opened(np.delete(p, (i + 1) % len(p), axis=0))]
    sign = np.sign(round(sum(map(area_of, loops)), 15)) or 1.0
    kept = [x for x in loops if np.sign(area_of(x)) == sign]
    return sorted(kept, key=lambda x: -abs(area_of(x)))


def simplified(points: np.ndarray, tolerance: float | None = None) -> np.ndarray:
    """Fewer points, none farther than ``tolerance`` from the ring, which stays valid: a tolerance that breaks it is halved.

    Without one it is 1 % of the side of a square of the ring's area, 1 at least.
    """
    p = opened(points)
    tolerance = max(1.0, abs(area_of(p)) ** 0.5 * 0.01) if tolerance is None else tolerance
    for _ in range(40):
        fewer = simplify_ring(p, tolerance)
        if len(fewer) >= 3 and is_valid(fewer):
            return fewer
        tolerance /= 2
    return p


def _half(rings: list[np.ndarray], axis: int, bound: float, sign: float) -> list[np.ndarray]:
    """The parts of rings where sign * (coordinate - bound) > 0: chains inside are closed along the line, nearest ends together.

    Rings of one polygon are cut together: its outer ring runs one way and its holes the other, so a hole that the line meets becomes
    part of the outline.
    """
    out, chains = [], []
    for p in rings:
        f = sign * (p[:, axis] - bound)
        if (f > 0).all() or not (f > 0).any():
            out += [p] if (f > 0).all() else []
            continue
        n = len(p)
        for i in (int(k) for k in np.flatnonzero((f <= 0) & (np.roll(f, -1) > 0))):  # the sides that enter
            point = lambda a, b: p[a] + (p[b] - p[a]) * (f[a] / (f[a] - f[b]))
            j, chain = (i + 1) % n, [point(i, (i + 1) % n)]
            while f[j] > 0:
                chain.append(p[j])
                j = (j + 1) % n
            chain.append(point(j - 1, j))
            chains.append(np.array(chain))
    ends = sorted((float(c[k][1 - axis]), m, k) for m, c in enumerate(chains) for k in (0, -1))
    mate = {}
    for a, b in zip(ends[::2], ends[1::2]):
        mate[a[1:]], mate[b[1:]] = b[1:], a[1:]
    left = set(range(len(chains)))
    while left:
        m = min(left)
        loop = []
        while m in left:
            left.discard(m)
            loop.append(chains[m])
            m, end = mate[m, -1]
            if end != 0:  # ends that tie: the part is degenerate
                break
        loop = opened(np.vstack(loop))
        if len(loop) >= 3 and area_of(loop) != 0:
            out.append(loop)
    return out


def clip_parts(points: np.ndarray, minx: float, miny: float, maxx: float, maxy: float) -> list[np.ndarray]:
    """The parts of a valid ring within a rectangle, each a ring of its own, largest first."""
    return [outer for outer, _ in clip_polygon(points, [], minx, miny, maxx, maxy)]


def clip_polygon(points: np.ndarray, holes: list[np.ndarray], minx: float, miny: float, maxx: float, maxy: float) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """The parts of a valid polygon within a rectangle: outer ring and holes of each, largest first.

    Outer rings keep the direction of ``points``, holes get the other. Parts as thin as rounding (SLIVER of their length), which a side along
    the rectangle's edge may leave, are none.
    """
    way = np.sign(area_of(opened(points)))
    turned = [h if np.sign(area_of(h)) == -way else h[::-1] for h in map(opened, holes) if len(h) >= 3 and area_of(h) != 0]
    rings = [opened(points), *turned]
    for axis, bound, sign in ((0, minx, 1.0), (0, maxx, -1.0), (1, miny, 1.0), (1, maxy, -1.0)):
        rings = _half(rings, axis, bound, sign)
    rings = [r for r in rings if abs(area_of(r)) > SLIVER * np.ptp(r, axis=0).max() ** 2]
    parts = sorted(((r, []) for r in rings if np.sign(area_of(r)) == way), key=lambda p: -abs(area_of(p[0])))
    for h in (r for r in rings if np.sign(area_of(r)) == -way):
        around = [p for p in parts if _inside((h[0] + h[1]) / 2, p[0])]
        (around or parts)[-1][1].append(h)  # the smallest
    return parts


def meets_ring(a: np.ndarray, b: np.ndarray) -> bool:
    """Two rings share a point."""
    a, b = opened(a), opened(b)
    if len(a) < 3 or len(b) < 3 or (a.max(0) < b.min(0)).any() or (b.max(0) < a.min(0)).any():
        return False
    return any(_inside(x[0], y) for x, y in ((a, b), (b, a))) or _sides_meet(a, b)


def _inside(q: np.ndarray, p: np.ndarray) -> bool:
    r = np.roll(p, -1, axis=0)
    spans = (p[:, 1] > q[1]) != (r[:, 1] > q[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = p[:, 0] + (q[1] - p[:, 1]) / (r[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0])
    return bool((spans & (q[0] < at)).sum() % 2)


def _sides_meet(a: np.ndarray, b: np.ndarray) -> bool:
    side = lambda o, p, q: (p[..., 0] - o[..., 0]) * (q[..., 1] - o[..., 1]) - (p[..., 1] - o[..., 1]) * (q[..., 0] - o[..., 0])
    c, e = b, np.roll(b, -1, axis=0)
    for p, q in zip(a, np.roll(a, -1, axis=0)):
        one, two = side(p, q, c), side(p, q, e)
        three, four = side(c, e, p), side(c, e, q)
        near = (np.minimum(c, e) <= np.maximum(p, q)).all(1) & (np.maximum(c, e) >= np.minimum(p, q)).all(1)
        if ((one * two <= 0) & (three * four <= 0) & near).any():
            return True
    return False


def _points(rings: pa.Array) -> Iterator[np.ndarray]:
    """The points of each ring; none of a NULL one."""
    sizes = rings.value_lengths().fill_null(0).to_numpy()
    flat = rings.flatten()
    xy = np.stack([flat.field(n).to_numpy(zero_copy_only=False).astype(float) for n in ("x", "y")], 1)
    for end, n in zip(np.cumsum(sizes), sizes):
        yield xy[end - n : end]


def _lists(of: list, values: pa.Array) -> pa.Array:
    """``values`` in lists as long as those of ``of``."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in of])), pa.int32()), values)


def _rings(found: list[np.ndarray]) -> pa.Array:
    xy = np.vstack([np.empty((0, 2)), *found])
    return _lists(found, pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"]))


def _structs(p: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in p]


@F.arrow_udf(T.BooleanType())
def _valid(rings: pa.Array) -> pa.Array:
    return pa.array((is_valid(r) for r in _points(rings)), pa.bool_())


@F.arrow_udf(_RINGS)
def _repair(rings: pa.Array) -> pa.Array:
    found = [repaired(r) for r in _points(rings)]
    return _lists(found, _rings([p for some in found for p in some]))


@F.arrow_udf(_RING)
def _simplify(rings: pa.Array) -> pa.Array:
    return _rings([simplified(r) for r in _points(rings)])


@F.arrow_udf(_RINGS)
def _parts(rings: pa.Array, minx: pa.Array, miny: pa.Array, maxx: pa.Array, maxy: pa.Array) -> pa.Array:
    found = [clip_parts(r, *box) for r, *box in zip(_points(rings), *(v.to_pylist() for v in (minx, miny, maxx, maxy)))]
    return _lists(found, _rings([p for some in found for p in some]))


@F.arrow_udf(_POLYGONS)
def _polygons(rings: pa.Array, holes: pa.Array, minx: pa.Array, miny: pa.Array, maxx: pa.Array, maxy: pa.Array) -> pa.Array:
    out = []
    for r, inner, *box in zip(_points(rings), holes, minx, miny, maxx, maxy):
        own = [np.array([(p["x"], p["y"]) for p in h], float).reshape(-1, 2) for h in inner.as_py() or ()]
        out.append([{"outer": _structs(p), "holes": [_structs(h) for h in q]} for p, q in clip_polygon(r, own, *(v.as_py() for v in box))])
    return pa.array(out, _ARROW_POLYGONS)


# else the optimizer would write a call out again for each use of its result
_repair_once, _simplify_once, _parts_once, _polygons_once = (f.asNondeterministic() for f in (_repair, _simplify, _parts, _polygons))


@F.arrow_udf(T.BooleanType())
def _meet(one: pa.Array, two: pa.Array) -> pa.Array:
    return pa.array((meets_ring(a, b) for a, b in zip(_points(one), _points(two))), pa.bool_())


def valid(ring: Column) -> Column:
    """``is_valid`` of each ring; a NULL or empty one isn't."""
    return _valid(ring)


def repair(ring: Column) -> Column:
    """``repaired`` rings of each ring."""
    return _repair_once(ring)


def simplify(ring: Column) -> Column:
    """``simplified`` of each ring."""
    return _simplify_once(ring)


def parts_in_box(ring: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """``clip_parts`` of each ring."""
    return _parts_once(ring, minx, miny, maxx, maxy)


def polygons_in_box(ring: Column, holes: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """``clip_polygon`` of each ring and its holes: array of (outer, holes)."""
    return _polygons_once(ring, holes, minx, miny, maxx, maxy)


def meet(one: Column, two: Column) -> Column:
    """Whether two rings share a point, borders included."""
    return _meet(one, two)
