"""Structured Streaming over stage items as they are written: running bucket counts by stage and window.

The batch operators need whole slides; what a stream can give without waiting are counts, so these two queries are what a dashboard of a running benchmark reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kinds as K

ITEMS = "slide_id long, id string, kind string, source_ids array<string>, written timestamp"


def read_items(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Stage items under <path>/stage=…, as new files come."""
    return spark.readStream.schema(f"{ITEMS}, stage string").option("maxFilesPerTrigger", files_per_trigger).json(path)


def bucket_counts(items: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Items by window, stage, kind and bucket; state is dropped once the watermark passes a window."""
    marked = items.withWatermark("written", late).withColumn("bucket", K.bucket(F.col("source_ids"))).withColumn("kind", K.source_kind(F.col("kind")))
    return marked.groupBy(F.window("written", window), "stage", "kind", "bucket").agg(F.count("*").alias("n")).select("window.start", "window.end", "stage", "kind", "bucket", "n")


def write(df: DataFrame, path: str, checkpoint: str):
    """Finished windows as Parquet, exactly once by the checkpoint."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
