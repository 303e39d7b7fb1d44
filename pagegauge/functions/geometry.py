"""Geometry of four-cornered pages as Column expressions; corners are array<struct<x,y>> in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

A4_LONG_INCHES = 11.69


def corners(*points: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def xs(c: Column) -> Column:
    return F.transform(c, lambda p: p["x"])


def ys(c: Column) -> Column:
    return F.transform(c, lambda p: p["y"])


def order_corners(c: Column) -> Column:
    """Top left, top right, bottom right, bottom left: least x + y, least y - x, and the largest of each; the first of equals."""


    def of(c: Column) -> Column:
        keys = F.struct(F.transform(c, lambda p: p["x"] + p["y"]).alias("s"), F.transform(c, lambda p: p["y"] - p["x"]).alias("d"))
        pick = lambda values, best: F.element_at(c, F.array_position(values, best(values)).cast("int"))
        return let(keys, lambda k: F.array(pick(k["s"], F.array_min), pick(k["d"], F.array_min), pick(k["s"], F.array_max), pick(k["d"], F.array_max)))

    return let(c, of)


def _ring(c: Column, term) -> list[Column]:
    return [term(c[k], c[(k + 1) % 4]) for k in range(4)]


def _total(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def quad_area(c: Column) -> Column:
    return F.abs(_total(_ring(c, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]))) / 2


def is_convex(c: Column) -> Column:
    """Whether the corners, in order and cut to whole pixels, turn the same way four times; a straight or repeated corner does not turn."""
    whole = F.transform(order_corners(c), lambda p: F.struct(p["x"].cast("long").alias("x"), p["y"].cast("long").alias("y")))
    return let(whole, lambda o: _one_way(_turns(o)))


def _one_way(turns: list[Column]) -> Column:
    return let(F.array(*turns), lambda t: (F.array_min(t) > 0) | (F.array_max(t) < 0))


def _turns(o: Column) -> list[Column]:
    return [(o[(k + 1) % 4]["x"] - o[k]["x"]) * (o[(k + 2) % 4]["y"] - o[(k + 1) % 4]["y"]) - (o[(k + 1) % 4]["y"] - o[k]["y"]) * (o[(k + 2) % 4]["x"] - o[(k + 1) % 4]["x"]) for k in range(4)]


def _side(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def skew_ratio(c: Column) -> Column:
    """The larger ratio of opposite sides; pairs with a side of no length are left out, and infinity stands for none left."""
    sides = let(order_corners(c), lambda o: F.array(_side(o[0], o[1]), _side(o[1], o[2]), _side(o[2], o[3]), _side(o[3], o[0])))
    ratio = lambda a, b: F.when(F.least(a, b) > 1e-6, F.greatest(a, b) / F.least(a, b))
    return let(sides, lambda s: F.coalesce(F.greatest(ratio(s[0], s[2]), ratio(s[3], s[1])), F.lit(float("inf"))))


def touches_border(c: Column, height, width, margin: int) -> Column:
    """Corners within margin of the frame's edge, or beyond it."""
    h, w = F.lit(height), F.lit(width)
    return F.size(F.filter(c, lambda p: (p["x"] <= margin) | (p["y"] <= margin) | (p["x"] >= w - 1 - margin) | (p["y"] >= h - 1 - margin)))


def corners_outside(c: Column, height, width) -> Column:
    """How far the farthest corner lies out of the frame; 0 if none does."""
    h, w = F.lit(height), F.lit(width)
    return F.greatest(F.lit(0.0), -F.array_min(xs(c)), -F.array_min(ys(c)), F.array_max(xs(c)) - (w - 1), F.array_max(ys(c)) - (h - 1))


def expand(c: Column, px: float, height, width) -> Column:
    """Corners pushed out from their mean by px, kept within the frame; unchanged for px <= 0."""
    if px <= 0:
        return c
    return let(c, lambda q: _pushed(q, px, F.lit(height).cast("double"), F.lit(width).cast("double")))


def _pushed(c: Column, px: float, h: Column, w: Column) -> Column:
    mx = (c[0]["x"] + c[1]["x"] + c[2]["x"] + c[3]["x"]) / 4
    my = (c[0]["y"] + c[1]["y"] + c[2]["y"] + c[3]["y"]) / 4

    def push(p: Column) -> Column:
        dx, dy = p["x"] - mx, p["y"] - my
        n = F.sqrt(dx * dx + dy * dy)
        grow = F.when(n > 1e-6, px / n).otherwise(F.lit(0.0))
        clip = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top - 1)
        return F.struct(clip(p["x"] + dx * grow, w).alias("x"), clip(p["y"] + dy * grow, h).alias("y"))

    return F.transform(c, push)


def estimate_dpi(height: Column, width: Column) -> Column:
    """Dots per inch if the long side is that of an A4 page."""
    return F.greatest(height, width) / A4_LONG_INCHES


def intersect(p1: Column, p2: Column, p3: Column, p4: Column) -> Column:
    """Where the line through p1, p2 meets the one through p3, p4; null for near-parallel lines."""
    den = (p1["x"] - p2["x"]) * (p3["y"] - p4["y"]) - (p1["y"] - p2["y"]) * (p3["x"] - p4["x"])
    a = p1["x"] * p2["y"] - p1["y"] * p2["x"]
    b = p3["x"] * p4["y"] - p3["y"] * p4["x"]
    x = (a * (p3["x"] - p4["x"]) - (p1["x"] - p2["x"]) * b) / den
    y = (a * (p3["y"] - p4["y"]) - (p1["y"] - p2["y"]) * b) / den
    return F.when(F.abs(den) >= 1e-6, F.struct(x.alias("x"), y.alias("y")))


def is_horizontal(a: Column, b: Column) -> Column:
    """Whether a segment runs across rather than down: an angle under 45 or over 135 degrees."""
    angle = F.abs(F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"])))
    return (angle < 45) | (angle > 135)


def scaled(c: Column, ratio: Column) -> Column:
    return F.transform(c, lambda p: F.struct((p["x"] * ratio).alias("x"), (p["y"] * ratio).alias("y")))


def warp_size(c: Column) -> Column:
    """struct<width,height> of the flattened page: the longer of opposite sides, whole pixels."""
    of = lambda o: F.struct(F.greatest(_side(o[2], o[3]), _side(o[1], o[0])).cast("int").alias("width"), F.greatest(_side(o[1], o[2]), _side(o[0], o[3])).cast("int").alias("height"))
    return let(order_corners(c), of)


def inside(o: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a convex quad of ordered corners, its edges included."""
    turns = F.array(*_ring(o, lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])))
    return let(turns, lambda t: (F.array_min(t) >= 0) | (F.array_max(t) <= 0))


def passes_gate(c: Column, area_ratio: Column, min_area: float, max_skew: float) -> Column:
    """Convex, large enough and not too steep."""
    return is_convex(c) & (area_ratio >= min_area) & (skew_ratio(c) <= max_skew)
