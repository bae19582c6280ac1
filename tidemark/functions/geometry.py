"""Boxes, points and polygons as column expressions. Polygons of literal points unroll, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def centre(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def anchor(kind: Column, x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Where a thing stands, as shares of the frame: people at their feet, others at their centre."""
    return (x1 + x2) / 2 / width, F.when(kind == "person", y2).otherwise((y1 + y2) / 2) / height


def near_edge(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, share: float = 0.04) -> Column:
    return (x1 < share * width) | (y1 < share * height) | (x2 > (1 - share) * width) | (y2 > (1 - share) * height)


def area(box: tuple[Column, ...]) -> Column:
    x1, y1, x2, y2 = box
    return (x2 - x1) * (y2 - y1)


def intersection(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    return wide * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    shared = intersection(a, b)
    return shared / (area(a) + area(b) - shared + 1e-9)


def contained_share(inner: tuple[Column, ...], outer: tuple[Column, ...]) -> Column:
    return intersection(inner, outer) / F.greatest(area(inner), F.lit(1e-6))


def touch_share(thing: tuple[Column, ...], person: tuple[Column, ...], grow: float = 0.25) -> Column:
    """Overlap of the person with the thing's grown box, over the thing's own area; may exceed 1."""
    x1, y1, x2, y2 = thing
    w, h = (x2 - x1) * grow, (y2 - y1) * grow
    return intersection((x1 - w, y1 - h, x2 + w, y2 + h), person) / F.greatest(area(thing), F.lit(1e-6))


def in_polygon(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Even-odd rule by casting a ray along x."""
    crossings = []
    for (xi, yi), (xj, yj) in zip(points, [points[-1], *points[:-1]], strict=True):
        slope = (xj - xi) / ((yj - yi) or 1e-12)
        crossings.append(((F.lit(yi) > y) != (F.lit(yj) > y)) & (x < (y - yi) * slope + xi))
    return reduce(lambda a, b: a != b, crossings)


def in_polygon_array(x: Column, y: Column, points: Column) -> Column:
    """The same for an array column of structs x, y."""
    n = F.size(points)

    def step(inside: Column, i: Column) -> Column:
        a, b = F.get(points, i), F.get(points, F.pmod(i + n - 1, n))
        rise = F.when(b["y"] == a["y"], F.lit(1e-12)).otherwise(b["y"] - a["y"])
        return inside != (((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / rise + a["x"]))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), step)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def to_reference(x: Column, y: Column, m: tuple[Column, ...]) -> tuple[Column, Column]:
    """Affine map with m = (a, b, tx, c, d, ty)."""
    a, b, tx, c, d, ty = m
    return a * x + b * y + tx, c * x + d * y + ty


def from_reference(x: Column, y: Column, m: tuple[Column, ...]) -> tuple[Column, Column]:
    a, b, tx, c, d, ty = m
    det = a * d - b * c
    return (d * (x - tx) - b * (y - ty)) / det, (a * (y - ty) - c * (x - tx)) / det


def bounding_box(points: Column) -> Column:
    """Struct x1, y1, x2, y2 of an array of structs x, y."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def tidy_polygon(points: Column, most: int = 40) -> Column:
    """Points clamped to 0..1, rounded to 4 digits and thinned to about `most`."""
    every = F.greatest(F.lit(1), F.floor(F.size(points) / most))
    clamp = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 4)
    thin = F.filter(points, lambda p, i: F.pmod(i, every) == 0)
    return F.transform(thin, lambda p: F.struct(clamp(p["x"]).alias("x"), clamp(p["y"]).alias("y")))
