"""Rectangles (x0, y0, x1, y1), circles and points as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0, y0, x1, y1) -> Column:
    return F.struct(*[F.col(c).cast("double").alias(n) if isinstance(c, str) else c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))])


def area(r: Column) -> Column:
    return F.greatest(F.lit(0.0), r["x1"] - r["x0"]) * F.greatest(F.lit(0.0), r["y1"] - r["y0"])


def intersects(a: Column, b: Column) -> Column:
    """Whether the common area is positive."""
    return (F.least(a["x1"], b["x1"]) > F.greatest(a["x0"], b["x0"])) & (F.least(a["y1"], b["y1"]) > F.greatest(a["y0"], b["y0"]))


def contains(outer: Column, inner: Column, eps: float = 0.01) -> Column:
    return (outer["x0"] - eps <= inner["x0"]) & (outer["y0"] - eps <= inner["y0"]) & (outer["x1"] + eps >= inner["x1"]) & (outer["y1"] + eps >= inner["y1"])


def rounded_quads(quads: Column) -> Column:
    """Quads (arrays of numbers) rounded to 2 digits, in order."""
    return F.array_sort(F.transform(quads, lambda q: F.transform(q, lambda x: F.round(x, 2))))


def grid_cells(r: Column, size: float = 50.0) -> Column:
    """Cells (gx, gy) that a rectangle touches, by floor division."""
    xs = F.sequence(F.floor(r["x0"] / size), F.floor(r["x1"] / size))
    ys = F.sequence(F.floor(r["y0"] / size), F.floor(r["y1"] / size))
    return F.flatten(F.transform(xs, lambda gx: F.transform(ys, lambda gy: F.struct(gx.alias("gx"), gy.alias("gy")))))


def point_in(r: Column, x: Column, y: Column) -> Column:
    return x.between(r["x0"], r["x1"]) & y.between(r["y0"], r["y1"])


def distance_squared(r: Column, x: Column, y: Column) -> Column:
    dx = F.greatest(r["x0"] - x, F.lit(0.0), x - r["x1"])
    dy = F.greatest(r["y0"] - y, F.lit(0.0), y - r["y1"])
    return dx * dx + dy * dy


def touches_circle(r: Column, x: Column, y: Column, radius: Column) -> Column:
    return distance_squared(r, x, y) <= radius * radius


def proper_rect(r: Column) -> Column:
    """The rectangle, or null unless it has width and height."""
    return F.when((r["x1"] > r["x0"]) & (r["y1"] > r["y0"]), r)


def proper_radius(radius: Column) -> Column:
    return F.when(radius > 0, radius)


def quad_bounds(quad: Column) -> Column:
    """Bounding rectangle of eight numbers x, y, x, y, ...; null for any other count."""
    xs, ys = F.filter(quad, lambda _, i: i % 2 == 0), F.filter(quad, lambda _, i: i % 2 == 1)
    return F.when(F.size(quad) == 8, rect(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def clipped(r: Column, page: Column) -> Column:
    """The part of a rectangle on its page, null if empty."""
    return proper_rect(rect(F.greatest(r["x0"], page["x0"]), F.greatest(r["y0"], page["y0"]), F.least(r["x1"], page["x1"]), F.least(r["y1"], page["y1"])))


def flipped(y: Column, page_height: Column) -> Column:
    return page_height - y


def pixels_to_points(v: Column, dpi: float = 300.0, offset: float = 0.0) -> Column:
    return v * (72.0 / dpi) + offset


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    part = lambda c: F.lpad(F.lower(F.hex(F.floor(c * 255).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def fitting_font_size(width: Column, height: Column, unit_width: Column) -> Column:
    """The size at which text of unit_width (its width at size 1) fits, 1 to 72."""
    by_width = F.when(unit_width > 0, width * 0.98 / unit_width).otherwise(F.lit(72.0))
    return F.least(F.lit(72.0), F.greatest(F.lit(1.0), F.least(height * 0.98, by_width)))


def shape_offset(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Stand-in offset of a shape without text."""
    whole = [F.round(c * 1000).cast("long") for c in (x0, y0, x1, y1)]
    return F.abs(whole[0].bitwiseXOR(whole[1]).bitwiseXOR(whole[2]).bitwiseXOR(whole[3]))
