"""Box clean-up and numbering (WN-7..11, GEO-23, SRT-1..4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def suppress(boxes: DataFrame, keys: list[str], least: float = 0.82) -> DataFrame:
    """Greedy suppression in each group: larger boxes first (then by ord), a box is dropped if it has an overlap ratio of `least` with a kept one.

    A fold over the group's ordered boxes; the state holds the kept ones only.
    """
    row = F.struct((-G.area(F.col("box"))).alias("k"), F.col("ord"), F.col("id"), F.col("box"))
    grouped = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def step(kept: Column, r: Column) -> Column:
        return F.when(F.exists(kept, lambda o: G.iou(r["box"], o["box"]) >= least), kept).otherwise(F.concat(kept, F.array(r)))

    kept = F.aggregate("rows", F.slice("rows", 1, 0), step)
    return grouped.select(*keys, F.explode(kept).alias("r")).select(*keys, "r.id", "r.ord", "r.box")


def drop_parents(boxes: DataFrame, keys: list[str], ratio: float = 1.4, children: int = 2) -> DataFrame:
    """Without boxes that hold the centres of `children` boxes or more that are smaller by `ratio`."""
    other = boxes.select(*keys, F.col("id").alias("child"), F.col("box").alias("child_box"))
    inside = boxes.join(other, keys).where("child <> id").where(G.contains_point(F.col("box"), G.center(F.col("child_box"))) & (G.area(F.col("box")) > G.area(F.col("child_box")) * F.lit(ratio)))
    parents = inside.groupBy(*keys, "id").agg(F.count("*").alias("n")).where(F.col("n") >= children)
    return boxes.join(parents, [*keys, "id"], "left_anti")


def best_by_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dedupe_segments(segments: DataFrame) -> DataFrame:
    """One segment of each (slide, grid key of its ends): the most confident, the earlier on ties."""
    keyed = segments.withColumn("key", G.segment_key(F.col("a"), F.col("b")))
    return best_by_key(keyed, ["slide_id", "key"], [F.desc("confidence"), "ord"])


def numbered(rows: DataFrame, prefix: str, order: list, keys: tuple[str, ...] = ("slide_id",)) -> DataFrame:
    """Dense numbers in reading order as `n`, and ids with the prefix."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("n", n).withColumn("id", F.concat(F.lit(prefix), F.col("n").cast("string")))


def reading_order(box: str = "box") -> list:
    return [F.col(f"{box}.{c}") for c in ("y0", "x0", "y1", "x1")]


def union_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    return boxes.groupBy(*keys).agg(G.union_box(F.col("box")).alias("box"), F.count("*").alias("n"))
