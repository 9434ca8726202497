"""Geometry of boxes, lines and polygons as Column expressions.

Boxes are four columns x1, y1, x2, y2. Everything stays in whole-stage codegen
or in Catalyst's higher-order functions; there are no UDFs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CROSSING_POINTS = ("foot", "center", "top", "mid-foot")
DIRECTIONS = ("both", "entry", "exit")


def col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def truncated(x: Column | str) -> Column:
    """A coordinate as an integer, cut toward zero."""
    return col(x).cast("long")


def floor_half(total: Column) -> Column:
    """Half of an integer, rounded down for negative ones too."""
    return F.floor(total / 2).cast("long")


def crossing_point(x1, y1, x2, y2, kind: Column | str = "foot") -> tuple[Column, Column]:
    """The point of a box that is followed; a ``kind`` that isn't known is foot. ``kind`` is a column or one of CROSSING_POINTS."""
    x1, y1, x2, y2 = map(truncated, (x1, y1, x2, y2))
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    cx, cy = floor_half(x1 + x2), floor_half(y1 + y2)
    py = F.when(kind == "center", cy).when(kind == "top", y1).when(kind == "mid-foot", floor_half(cy + y2)).otherwise(y2)
    return cx, py


def foot(x1, y2, x2) -> tuple[Column, Column]:
    """Bottom centre of a box without truncation."""
    return F.floor((col(x1) + col(x2)) / 2), col(y2)


def side(px, py, x1, y1, x2, y2) -> Column:
    """1 or -1 for the side of the line that the point is on, 0 on it."""
    px, py, x1, y1, x2, y2 = map(col, (px, py, x1, y1, x2, y2))
    return F.signum((x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)).cast("int")


def inside_sign(px, py, x1, y1, x2, y2) -> Column:
    """The side that counts as inside, from a point that is inside; null, so refused, for a point on the line or a line without length."""
    found = side(px, py, x1, y1, x2, y2)
    return F.when(found != 0, found)


def line_distance(px, py, x1, y1, x2, y2) -> Column:
    """Distance from the infinite line; from its point if it has no length."""
    px, py, x1, y1, x2, y2 = map(col, (px, py, x1, y1, x2, y2))
    dx, dy = (x2 - x1).cast("double"), (y2 - y1).cast("double")
    length = F.sqrt(dx * dx + dy * dy)
    point = F.sqrt((px - x1) * (px - x1).cast("double") + (py - y1) * (py - y1).cast("double"))
    return F.when(length < 1e-9, point).otherwise(F.abs(dx * (py - y1) - dy * (px - x1)) / length)


def within_segment(px, py, x1, y1, x2, y2) -> Column:
    """Whether the point's foot on the line lies between the line's ends."""
    px, py, x1, y1, x2, y2 = map(col, (px, py, x1, y1, x2, y2))
    dx, dy = (x2 - x1).cast("double"), (y2 - y1).cast("double")
    along = dx * (px - x1) + dy * (py - y1)
    return along.between(F.lit(0.0), dx * dx + dy * dy)


def unit(dx: Column, dy: Column) -> tuple[Column, Column]:
    """A direction of length one; (0, 0) stays."""
    length = F.sqrt((dx * dx + dy * dy).cast("double"))
    return F.when(length > 0, dx / length).otherwise(0.0), F.when(length > 0, dy / length).otherwise(0.0)


def movement(dot: Column, least: float = 0.1) -> Column:
    return F.when(dot > least, "forward").when(dot < -least, "backward").otherwise("none")


def inside_polygon(px: Column, py: Column, polygon: Column | Sequence[tuple[float, float]]) -> Column:
    """Ray casting; an edge counts if exactly one of its ends is above the point. ``polygon`` is array<struct<x, y>> or a list of points."""
    if not isinstance(polygon, Column):
        polygon = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in polygon])
    n = F.size(polygon)

    def crosses(p: Column, i: Column) -> Column:
        q = F.element_at(polygon, F.pmod(i + n - 1, n) + 1)
        at = (q["x"] - p["x"]) * (py - p["y"]) / (q["y"] - p["y"]) + p["x"]
        return F.when((p["y"] > py) != (q["y"] > py), F.when(px < at, 1).otherwise(0)).otherwise(0)

    return F.aggregate(F.transform(polygon, crosses), F.lit(0), lambda total, x: total + x) % 2 == 1


def valid_polygon(polygon: Column) -> Column:
    """Three points at least, none of them the origin."""
    return (F.size(polygon) >= 3) & F.forall(polygon, lambda p: (p["x"] > 0) | (p["y"] > 0))


def iou(a: Sequence, b: Sequence) -> Column:
    """Intersection over union of two boxes; 0 if they don't meet."""
    ax1, ay1, ax2, ay2 = map(col, a)
    bx1, by1, bx2, by2 = map(col, b)
    w = F.greatest(F.lit(0.0), F.least(ax2, bx2) - F.greatest(ax1, bx1))
    h = F.greatest(F.lit(0.0), F.least(ay2, by2) - F.greatest(ay1, by1))
    both = w * h
    union = (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - both
    return F.when(both > 0, both / (union + 1e-8)).otherwise(0.0)


def margins(width: int, height: int) -> tuple[int, int, int]:
    """Of the frame's sides, top and bottom, within which a box counts as cut."""
    return max(40, int(width * 0.05)), max(30, int(height * 0.05)), max(80, int(height * 0.12))


def edge_flag(x1, y1, x2, y2, width: int, height: int) -> Column:
    """Whether a box is near the frame's edge or too wide for a whole person."""
    x1, y1, x2, y2 = map(truncated, (x1, y1, x2, y2))
    mx, top, bottom = margins(width, height)
    w, h = F.greatest(F.lit(1), x2 - x1), F.greatest(F.lit(1), y2 - y1)
    return (x1 < mx) | (x2 > width - mx) | (y1 < top) | (y2 > height - bottom) | (h / w < 1.5)


def crop_is_usable(x1, y1, x2, y2, width: int, height: int, least_w: int = 32, least_h: int = 64) -> Column:
    """Whether the part of a box within the frame is large enough for an embedding."""
    x1, y1, x2, y2 = map(truncated, (x1, y1, x2, y2))
    w = F.least(x2, F.lit(width)) - F.greatest(x1, F.lit(0))
    h = F.least(y2, F.lit(height)) - F.greatest(y1, F.lit(0))
    return (w >= least_w) & (h >= least_h)


def brightness_band(brightness: Column) -> Column:
    """Contrast clip limit and whether gamma is applied, by mean brightness."""
    clip = F.when(brightness > 90, F.lit(None).cast("double")).when(brightness > 50, 1.5).otherwise(3.0)
    return F.struct(clip.alias("clip"), (brightness < 50).alias("gamma"))


def colour_seed(identity: Column, modulus: int = 10000) -> Column:
    return F.pmod(identity, F.lit(modulus))


def display_scale(source_w: Column, source_h: Column, screen_w: float, screen_h: float) -> Column:
    return F.least(F.lit(float(screen_w)) / source_w, F.lit(float(screen_h)) / source_h, F.lit(1.0))


def to_source(coordinate: Column, scale: Column) -> Column:
    return (coordinate / scale).cast("int")


def band_quad(x1, y1, x2, y2, band) -> Column:
    """The corners of the zone on either side of a line."""
    x1, y1, x2, y2, band = map(col, (x1, y1, x2, y2, band))
    ux, uy = unit(x2 - x1, y2 - y1)
    nx, ny = -uy * band, ux * band
    corner = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    return F.array(corner(x1 + nx, y1 + ny), corner(x2 + nx, y2 + ny), corner(x2 - nx, y2 - ny), corner(x1 - nx, y1 - ny))


def fps_or_default(fps: Column, default: float = 25.0) -> Column:
    return F.when(fps.between(1, 60), fps).otherwise(F.lit(default))


def source_kind(source: Column) -> Column:
    return F.when(F.lower(source).rlike("^(rtsp|http|https)://"), "stream").when(source.rlike("^[0-9]+$"), "webcam").otherwise("file")


def safe_ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))
