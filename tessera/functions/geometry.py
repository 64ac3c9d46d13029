"""Box, point and segment expressions (GEO-*). A box is struct<x0,y0,x1,y1: double>, a point struct<x,y: double>; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
POINT = "struct<x:double,y:double>"


def box(x0, y0, x1, y1) -> Column:
    names = ("x0", "y0", "x1", "y1")
    return F.struct(*((F.col(v) if isinstance(v, str) else F.lit(v)).cast("double").alias(n) for n, v in zip(names, (x0, y0, x1, y1), strict=True)))


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def area(b: Column) -> Column:
    return width(b) * height(b)


def center(b: Column) -> Column:
    return point(center_x(b), center_y(b))


def center_x(b: Column) -> Column:
    return b["x0"] + width(b) / 2


def center_y(b: Column) -> Column:
    return b["y0"] + height(b) / 2


def inset(b: Column, delta: float) -> Column:
    """The box itself if a side is no longer than twice delta."""
    return F.when((width(b) <= 2 * delta) | (height(b) <= 2 * delta), b).otherwise(expand(b, -delta))


def expand(b: Column, delta: float) -> Column:
    return F.when(b.isNotNull(), box(b["x0"] - delta, b["y0"] - delta, b["x1"] + delta, b["y1"] + delta))


def contains_point(b: Column, p: Column) -> Column:
    """Edges belong to the box."""
    return p["x"].between(b["x0"], b["x1"]) & p["y"].between(b["y0"], b["y1"])


def overlaps(a: Column, b: Column) -> Column:
    """Boxes that only touch do not overlap."""
    return ~((a["x1"] <= b["x0"]) | (b["x1"] <= a["x0"]) | (a["y1"] <= b["y0"]) | (b["y1"] <= a["y0"]))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without intersection or when a box is null (least and greatest would skip nulls)."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(a.isNull() | b.isNull() | (both <= 0) | (union <= 0), F.lit(0.0)).otherwise(both / union)


def padded_iou(a: Column, b: Column, padding: float) -> Column:
    return iou(expand(a, padding), expand(b, padding))


def full_extent(w: Column, h: Column) -> Column:
    return box(F.lit(0.0), F.lit(0.0), w, h)


def contains(outer: Column, inner: Column) -> Column:
    return (outer["x0"] <= inner["x0"]) & (outer["y0"] <= inner["y0"]) & (outer["x1"] >= inner["x1"]) & (outer["y1"] >= inner["y1"])


def interval_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def axis(b: Column) -> Column:
    return F.when(width(b) >= height(b), "horizontal").otherwise("vertical")


def connector_similarity(a: Column, b: Column) -> Column:
    """Agreement of two long thin boxes: along the axis, across it and at the ends; half the padded overlap if their axes differ."""

    def along(lo: str, hi: str, size, across) -> Column:
        reference = F.greatest(size(a), size(b), F.lit(1.0))
        share = interval_overlap(a[lo], a[hi], b[lo], b[hi]) / reference
        ends = F.abs(a[lo] - b[lo]) + F.abs(a[hi] - b[hi])
        orth = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(across(a) - across(b)) / F.lit(26.0))
        end = F.greatest(F.lit(0.0), F.lit(1.0) - ends / F.greatest(F.lit(24.0), reference * F.lit(0.7)))
        return F.greatest(padded_iou(a, b, 6.0), share * F.lit(0.55) + orth * F.lit(0.25) + end * F.lit(0.20))

    return (
        F.when(a.isNull() | b.isNull(), F.lit(0.0))
        .when(axis(a) != axis(b), padded_iou(a, b, 8.0) * F.lit(0.5))
        .when(axis(a) == "horizontal", along("x0", "x1", width, center_y))
        .otherwise(along("y0", "y1", height, center_x))
    )


def containment(candidate: Column, truth: Column) -> Column:
    return (
        F.when(candidate.isNull() | truth.isNull(), "none").when(contains(candidate, truth), "contains_gt").when(contains(truth, candidate), "inside_gt")
        .when(overlaps(candidate, truth), "overlap_only").otherwise("disjoint")
    )


def area_ratio(candidate: Column, truth: Column) -> Column:
    return F.when(candidate.isNull() | truth.isNull() | (area(truth) <= 0), F.lit(0.0)).otherwise(area(candidate) / area(truth))


def signature(b: Column) -> Column:
    """Coordinates rounded half to even; null for a null box."""
    return F.when(b.isNotNull(), F.struct(*(F.bround(b[c]).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1"))))


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx, dy = x1 - x0, y1 - y0
    return F.sqrt(dx * dx + dy * dy)


def point_to_box(x: Column, y: Column, b: Column) -> Column:
    dx, dy = F.greatest(b["x0"] - x, F.lit(0.0), x - b["x1"]), F.greatest(b["y0"] - y, F.lit(0.0), y - b["y1"])
    return F.sqrt(dx * dx + dy * dy)


def segment_box(a: Column, b: Column) -> Column:
    """Box of two end points, one unit longer on the far sides."""
    return box(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(a["x"], b["x"]) + 1, F.greatest(a["y"], b["y"]) + 1)


def orientation(a: Column, b: Column) -> Column:
    dx, dy = F.abs(b["x"] - a["x"]), F.abs(b["y"] - a["y"])
    return F.when((dx <= 2) & (dy <= 2), "unknown").when(dy <= 2.5, "horizontal").when(dx <= 2.5, "vertical").otherwise("diagonal")


def segment_key(a: Column, b: Column) -> Column:
    """The same for both directions: the ends on a grid of 4 units, in order."""
    cell = lambda p: F.struct(F.bround(p["x"] / 4).cast("long").alias("x"), F.bround(p["y"] / 4).cast("long").alias("y"))
    return F.array_sort(F.array(cell(a), cell(b)))


def union_box(b: Column) -> Column:
    """Aggregate: the box around all boxes; null for none."""
    return F.when(F.count(b) > 0, box(F.min(b["x0"]), F.min(b["y0"]), F.max(b["x1"]), F.max(b["y1"])))


def clip(b: Column, extent: Column) -> Column:
    inside = lambda v, lo, hi: F.greatest(lo, F.least(v, hi))
    return box(*(inside(b[c], extent[lo], extent[hi]) for c, lo, hi in (("x0", "x0", "x1"), ("y0", "y0", "y1"), ("x1", "x0", "x1"), ("y1", "y0", "y1"))))


def pad_within(b: Column, padding: Column, w: Column, h: Column) -> Column:
    return box(F.greatest(F.lit(0.0), b["x0"] - padding), F.greatest(F.lit(0.0), b["y0"] - padding), F.least(w.cast("double"), b["x1"] + padding), F.least(h.cast("double"), b["y1"] + padding))


def path_box(points: Column) -> Column:
    """Box of an array of points; null without any."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def area_sum(b: Column) -> Column:
    """Aggregate; null boxes count nothing."""
    return F.coalesce(F.sum(area(b)), F.lit(0.0))


def side_midpoints(b: Column) -> Column:
    """Array of (side, point) with the middle of each side."""
    at = lambda side, x, y: F.struct(F.lit(side).alias("side"), point(x, y).alias("point"))
    return F.array(at("top", center_x(b), b["y0"]), at("right", b["x1"], center_y(b)), at("bottom", center_x(b), b["y1"]), at("left", b["x0"], center_y(b)))
