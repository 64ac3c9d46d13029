"""Spatial joins within a slide (JN-2..8, JN-11, GEO-28). The slide is always an equality key; slides with very many boxes add grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def touches(outer: Column, inner: Column) -> Column:
    """Overlap, or the centre of `inner` inside `outer`."""
    return G.overlaps(outer, inner) | G.contains_point(outer, G.center(inner))


def _cells(b: Column, cell: float) -> Column:
    span = lambda lo, hi: F.sequence(F.floor(b[lo] / cell), F.floor(b[hi] / cell))
    return F.explode(F.flatten(F.transform(span("x0", "x1"), lambda x: F.transform(span("y0", "y1"), lambda y: F.struct(x.alias("cx"), y.alias("cy"))))))


def overlap_pairs(left: DataFrame, right: DataFrame, left_box: str, right_box: str, cell: float | None = None) -> DataFrame:
    """Pairs of a slide whose boxes overlap; all columns of both sides, which must differ in name but for slide_id.

    With `cell`, boxes meet only in shared grid cells of that size, so a slide with n boxes costs about n pairs, not n squared; a pair is kept in the cell that holds
    the corner of its intersection, once.
    """
    if cell is None:
        return left.join(right, "slide_id").where(G.overlaps(F.col(left_box), F.col(right_box)))
    a = left.withColumn("cell", _cells(F.col(left_box), cell))
    b = right.withColumn("cell", _cells(F.col(right_box), cell))
    home = F.struct(*(F.floor(F.greatest(F.col(f"{left_box}.{c}"), F.col(f"{right_box}.{c}")) / cell).alias(n) for c, n in (("x0", "cx"), ("y0", "cy"))))
    return a.join(b, ["slide_id", "cell"]).where(G.overlaps(F.col(left_box), F.col(right_box)) & (F.col("cell") == home)).drop("cell")


def overlap_area(left: DataFrame, right: DataFrame, left_box: str, right_box: str, cell: float | None = None) -> DataFrame:
    """Sum of intersection areas over the pairs of each slide; an area covered twice counts twice."""
    return overlap_pairs(left, right, left_box, right_box, cell).groupBy("slide_id").agg(F.sum(G.intersection(F.col(left_box), F.col(right_box))).alias("overlap_area"))


def texts_near(boxes: DataFrame, texts: DataFrame, expansion: Column | float = 0.0) -> DataFrame:
    """Per box the ids and labels of texts that touch it, expanded; in text order."""
    b = boxes.select("slide_id", F.col("id").alias("box_id"), G.expand(F.col("box"), expansion).alias("outer"))
    t = texts.select("slide_id", F.col("id").alias("text_id"), F.col("box").alias("text_box"), "text", "ord")
    found = b.join(t, "slide_id").where(touches(F.col("outer"), F.col("text_box")))
    rows = found.groupBy("slide_id", "box_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text_id", "text", "text_box"))).alias("hits"))
    label = F.nullif(F.array_join(F.filter(F.transform("hits", lambda h: h["text"]), lambda x: x != ""), "\n"), F.lit(""))
    return rows.select("slide_id", "box_id", F.transform("hits", lambda h: h["text_id"]).alias("text_ids"), label.alias("label"), F.transform("hits", lambda h: h["text_box"]).alias("text_boxes"))


def nearby_nodes(ends: DataFrame, nodes: DataFrame, reach: float = 8.0) -> DataFrame:
    """Per end point (slide_id, id, x, y) the sorted ids of nodes within `reach`; points without any are left out."""
    n = nodes.select("slide_id", F.col("id").alias("node_id"), F.col("box").alias("node_box"))
    found = ends.join(n, "slide_id").where(G.point_to_box(F.col("x"), F.col("y"), F.col("node_box")) <= reach)
    return found.groupBy("slide_id", "id").agg(F.array_sort(F.collect_set("node_id")).alias("node_ids"))


def nearby_containers(segments: DataFrame, containers: DataFrame, reach: float = 8.0) -> DataFrame:
    """Per segment box the sorted ids of containers that, expanded by `reach`, overlap it."""
    c = containers.select("slide_id", F.col("id").alias("container_id"), G.expand(F.col("box"), reach).alias("container_box"))
    found = segments.select("slide_id", "id", "box").join(c, "slide_id").where(G.overlaps(F.col("container_box"), F.col("box")))
    return found.groupBy("slide_id", "id").agg(F.array_sort(F.collect_set("container_id")).alias("container_ids"))


def near_hints(ends: DataFrame, hints: DataFrame, reach: float = 12.0) -> DataFrame:
    """End points with an arrow hint within `reach` (a semi join)."""
    h = hints.select("slide_id", F.col("x").alias("hx"), F.col("y").alias("hy"))
    near = (ends["slide_id"] == h["slide_id"]) & (G.distance(ends["x"], ends["y"], h["hx"], h["hy"]) <= reach)
    return ends.join(h, near, "left_semi")


def ports_in_reach(ends: DataFrame, ports: DataFrame, reach: float = 28.0) -> DataFrame:
    """End points (slide_id, evidence_id, end, x, y) with the ports at most `reach` away, and the distance."""
    p = ports.select("slide_id", F.col("id").alias("port_id"), "owner_id", "owner_kind", "side", F.col("point.x").alias("px"), F.col("point.y").alias("py"), F.col("confidence").alias("port_confidence"))
    return ends.join(p, "slide_id").withColumn("gap", G.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"))).where(F.col("gap") <= reach)
