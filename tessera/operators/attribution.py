"""Source attribution and emission accounting (AG-5..9, GEO-27, JN-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kinds as K
from . import spatial


def buckets(items: DataFrame, *keys: str) -> DataFrame:
    """Items by bucket, zero-filled; by the given keys as well."""
    found = items.withColumn("bucket", K.bucket(F.col("source_ids")))
    return found.groupBy(*keys).agg(*(F.count(F.when(F.col("bucket") == b, 1)).alias(b) for b in K.BUCKETS))


def buckets_by_kind(items: DataFrame, *keys: str) -> DataFrame:
    return buckets(items.withColumn("kind", K.source_kind(F.col("kind"))), *keys, "kind")


def zero_counts(items: DataFrame) -> DataFrame:
    """A zero for each kind and bucket."""
    kinds = items.select(K.source_kind(F.col("kind")).alias("kind")).distinct()
    return kinds.select("kind", F.explode(F.array(*map(F.lit, K.BUCKETS))).alias("bucket"), F.lit(0).cast("long").alias("n"))


def filled_counts(items: DataFrame, kinds_of: DataFrame) -> DataFrame:
    """(kind, bucket, n) of `items` over the zero template of the kinds of `kinds_of`; null counts are 0."""
    found = items.select(K.source_kind(F.col("kind")).alias("kind"), K.bucket(F.col("source_ids")).alias("bucket")).groupBy("kind", "bucket").agg(F.count("*").alias("found"))
    return zero_counts(kinds_of).join(found, ["kind", "bucket"], "left").select("kind", "bucket", F.coalesce("found", "n").alias("n"))


def accounting(slides: DataFrame, emitted: DataFrame, residuals: DataFrame, dropped: DataFrame, cell: float | None = None) -> DataFrame:
    """One row a slide (slide_id, width, height): objects, areas by slide area, area of residuals under objects, dropped evidence."""
    area = F.greatest(F.lit(1.0), F.col("width") * F.col("height"))
    e = emitted.groupBy("slide_id").agg(F.count("*").alias("native_object_count"), G.area_sum(F.col("box")).alias("native_area"))
    r = residuals.groupBy("slide_id").agg(F.count("*").alias("raster_region_count"), G.area_sum(F.col("box")).alias("raster_area"))
    d = dropped.groupBy("slide_id").agg(F.count("*").alias("dropped_count"))
    o = spatial.overlap_area(residuals.select("slide_id", F.col("box").alias("r")), emitted.select("slide_id", F.col("box").alias("e")), "r", "e", cell)
    rows = slides.join(e, "slide_id", "left").join(r, "slide_id", "left").join(d, "slide_id", "left").join(o, "slide_id", "left").na.fill(0)
    ratio = lambda c, n: (F.col(c) / area).alias(n)
    return rows.select("slide_id", "native_object_count", "raster_region_count", ratio("native_area", "native_area_ratio"), ratio("raster_area", "raster_area_ratio"), ratio("overlap_area", "overlap_area_ratio"), "dropped_count")
