"""Ring columns: array<struct<x: double, y: double>>. Loops over points are higher-order functions.

`open` rings don't repeat their first point, `closed` ones do; each function says which it takes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def point(x, y) -> Column:
    x, y = (v if isinstance(v, Column) else F.lit(v) for v in (x, y))
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box(x0, y0, x1, y1) -> Column:
    """Closed ring: top left, bottom left, bottom right, top right, top left (y grows down)."""
    return F.array(point(x0, y0), point(x0, y1), point(x1, y1), point(x1, y0), point(x0, y0))


def rotated(ring: Column, by: int = 1) -> Column:
    """The ring from its (by + 1)-th point on; by may be -1."""
    n = F.size(ring)
    if by < 0:
        return F.concat(F.slice(ring, n, F.lit(1)), F.slice(ring, F.lit(1), n - 1))
    return F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def area(ring: Column) -> Column:
    """Signed shoelace area, open or closed; above 0 if the ring runs clockwise on screen."""
    return let(ring, lambda r: total(F.zip_with(r, rotated(r), lambda a, b: a.x * b.y - b.x * a.y)) / 2)


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def closed(ring: Column) -> Column:
    ends = F.element_at(ring, 1) == F.element_at(ring, -1)
    return F.when((F.size(ring) == 0) | ends, ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def opened(ring: Column) -> Column:
    repeats = (F.size(ring) > 1) & (F.try_element_at(ring, F.lit(1)) == F.try_element_at(ring, F.lit(-1)))
    return F.when(repeats, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring)


def shifted(ring: Column) -> Column:
    """Relative to the first point, so that small areas far from the origin keep their digits."""
    return let(ring, lambda r: let(F.element_at(r, 1), lambda o: F.transform(r, lambda p: point(p.x - o.x, p.y - o.y))))


def ensure_ccw(ring: Column) -> Column:
    """A closed ring turned round if its area, relative to the first point, is below 0."""
    return let(ring, lambda r: F.when(area(shifted(r)) < 0, F.reverse(r)).otherwise(r))


def _moments(ring: Column) -> Column:
    """struct<a, x, y>: twice the area and the two first moments of a closed ring."""

    def sums(r):
        two = lambda f: total(F.zip_with(r, rotated(r), lambda a, b: f(a, b, a.x * b.y - b.x * a.y)))
        return F.struct(two(lambda a, b, c: c).alias("a"), two(lambda a, b, c: (a.x + b.x) * c).alias("x"), two(lambda a, b, c: (a.y + b.y) * c).alias("y"))

    return let(ring, sums)


def centroid(ring: Column) -> Column:
    """Shoelace centroid of a closed ring; its first point if there is no area."""

    def found(r):
        at = lambda o: let(_moments(shifted(r)), lambda m: F.when(F.abs(m.a) > 1e-18, point(o.x + m.x / (3 * m.a), o.y + m.y / (3 * m.a))).otherwise(o))
        return let(F.element_at(r, 1), at)

    return let(ring, found)


def display_point(ring: Column, fixed: Column | None = None) -> Column:
    """The stored point if there is one; else the centroid of a closed ring, or the middle of its bounds if the area is tiny."""

    def found(r):
        middle = let(bounds(r), lambda b: point((b.min_x + b.max_x) / 2, (b.min_y + b.max_y) / 2))
        return let(_moments(r), lambda m: F.when(F.abs(m.a) > 1e-12, point(m.x / (3 * m.a), m.y / (3 * m.a))).otherwise(middle))

    got = let(ring, found)
    return F.coalesce(fixed, got) if fixed is not None else got


def vertex_mean(ring: Column) -> Column:
    """Mean of the points as they stand: the repeated last point of a closed ring counts."""
    n = F.size(ring)
    return point(total(F.transform(ring, lambda p: p.x)) / n, total(F.transform(ring, lambda p: p.y)) / n)


def is_rectilinear(ring: Column, eps: float = 1e-9) -> Column:
    """Open ring of four points or more whose edges are all level or upright."""
    along = lambda a, b: (F.abs(a.x - b.x) <= eps) | (F.abs(a.y - b.y) <= eps)
    return let(ring, lambda r: F.forall(F.zip_with(r, rotated(r), along), lambda s: s) & (F.size(r) >= 4))


def _neighbours(ring: Column, f) -> Column:
    """f(before, at, after) of every point of an open ring."""
    at = lambda i: F.element_at(ring, i.cast("int"))
    n = F.size(ring)
    return F.transform(ring, lambda c, i: let(F.struct(at((i + n - 1) % n + 1).alias("p"), at((i + 1) % n + 1).alias("n")), lambda t: f(t["p"], c, t["n"])))


def offset_polygon(ring: Column, d, least: float = 0.35) -> Column:
    """Every edge of a clean open ring moved out by d (in if below 0), corners mitred; the mitre's divisor stays above `least`."""
    d = d if isinstance(d, Column) else F.lit(float(d))

    def normal(sign, a, b):
        length = F.sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))
        return let(F.when(length == 0, 1.0).otherwise(length), lambda n: point(sign * (b.y - a.y) / n, -sign * (b.x - a.x) / n))

    def moved(sign, p, c, n):
        normals = F.struct(normal(sign, p, c).alias("u"), normal(sign, c, n).alias("v"))
        by = lambda u, v: d / F.greatest(1 + u.x * v.x + u.y * v.y, F.lit(least))
        return let(normals, lambda w: let(by(w.u, w.v), lambda k: point(c.x + (w.u.x + w.v.x) * k, c.y + (w.u.y + w.v.y) * k)))

    return let(ring, lambda r: let(F.when(area(r) > 0, 1.0).otherwise(-1.0), lambda sign: _neighbours(r, lambda p, c, n: moved(sign, p, c, n))))


def offset_rectilinear(ring: Column, d) -> Column:
    """The same for a clean axis-aligned open ring of four points or more."""
    d = d if isinstance(d, Column) else F.lit(float(d))

    def moved(sign, p, c, n):
        x = sign * (F.signum(c.y - p.y) + F.signum(n.y - c.y))
        y = -sign * (F.signum(c.x - p.x) + F.signum(n.x - c.x))
        return point(c.x + d * x, c.y + d * y)

    turned = lambda r: let(F.when(area(r) > 0, 1.0).otherwise(-1.0), lambda sign: _neighbours(r, lambda p, c, n: moved(sign, p, c, n)))
    return let(ring, lambda r: F.when(F.size(r) >= 4, turned(r)).otherwise(r))


def chaikin(ring: Column, iterations: int = 1, max_cut: float | None = None) -> Column:
    """Corners of an open ring cut back by a quarter of each edge, by max_cut at most."""
    for _ in range(iterations):

        def cut(a, b):
            length = F.sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y))
            t = F.when(length > 0, F.least(F.lit(0.25), F.lit(max_cut) / length)).otherwise(0.25) if max_cut else F.lit(0.25)
            return F.array(point(a.x + (b.x - a.x) * t, a.y + (b.y - a.y) * t), point(b.x + (a.x - b.x) * t, b.y + (a.y - b.y) * t))

        ring = let(ring, lambda r: F.flatten(F.zip_with(r, rotated(r), cut)))
    return ring


def point_in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd test over all rings."""

    def crossings(ring):
        hit = lambda a, b: ((b.y > y) != (a.y > y)) & (x < (a.x - b.x) * (y - b.y) / F.nullif(a.y - b.y, F.lit(0.0)) + b.x)
        return F.size(F.filter(F.zip_with(rotated(ring, -1), ring, hit), lambda h: h))

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda s, n: s + n) % 2 == 1


def grid_lines(values: Column, eps: float = 1e-9) -> Column:
    """Sorted values without those within eps of the last one kept."""
    start = F.array().cast("array<double>")
    keep = lambda out, v: F.when((F.size(out) == 0) | (v - F.try_element_at(out, F.lit(-1)) > eps), F.concat(out, F.array(v))).otherwise(out)
    return F.aggregate(F.array_sort(values.cast("array<double>")), start, keep)


def span_crossings(rings: Column, row: Column) -> Column:
    """Sorted x at which the edges of closed rings cross the middle of a pixel row."""
    y = row + 0.5

    def cross(a, b):
        on = ((a.y <= y) & (b.y > y)) | ((b.y <= y) & (a.y > y))
        return F.when(on, a.x + (y - a.y) * (b.x - a.x) / F.nullif(b.y - a.y, F.lit(0.0)))

    each = F.transform(rings, lambda r: F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), cross))
    return F.array_sort(F.array_compact(F.flatten(each)))


def rounded_rect(x0: Column, y0: Column, x1: Column, y1: Column, radii: list[Column]) -> Column:
    """Open ring of a box with a radius at each corner (top left, top right, bottom right, bottom left).

    A radius is half the short side at most; below 0.35 the corner stays square; arcs have 2 to 8 steps.
    """
    half = F.least(x1 - x0, y1 - y0) / 2

    def corner(r, cx, sx, cy, sy, start):
        steps = F.greatest(F.lit(2), F.least(F.lit(8), F.ceil(r * 1.2)))

        def on_arc(s):
            turn = (start + s / steps) * math.pi / 2
            return point(cx + sx * r + r * F.cos(turn), cy + sy * r + r * F.sin(turn))

        arc = F.transform(F.sequence(F.lit(0).cast("long"), steps), on_arc)
        return F.when(r < 0.35, F.array(point(cx, cy))).otherwise(arc)

    places = [(x0, 1, y0, 1, 2), (x1, -1, y0, 1, 3), (x1, -1, y1, -1, 0), (x0, 1, y1, -1, 1)]
    capped = [F.greatest(F.lit(0.0), F.least(F.coalesce(r, F.lit(0.0)), half)) for r in radii]
    return F.concat(*[corner(r, *p) for r, p in zip(capped, places, strict=True)])
