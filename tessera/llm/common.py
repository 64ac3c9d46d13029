"""Session helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import checkpointed as checkpointed  # shared with the other operators
from ..lineage import released as released


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a few numbers each that may be sent to every executor: some 20 MB.
FEW = 500_000


def few(df: DataFrame) -> DataFrame:
    """`df` (a checkpointed table of a few numbers a row), marked for broadcast if it is counted to be small enough; joins shuffle it otherwise, to the same result."""
    return F.broadcast(df) if df.count() <= FEW else df


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two longs that name a row. Rows with the same id and text share them, and also share every decision taken on content."""
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-1).cast("long")).alias("k1"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("k2"),
    ]


def plain(docs: DataFrame) -> DataFrame:
    """doc_id and text only, a null text as the empty one: extra columns, whatever their names, stay out of the work."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def carried(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and text as plain() has them, and all other columns in one struct, `rest`: their names cannot clash with an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", text)]
    kept = F.struct(F.col(text).isNull().alias("null_text"), F.struct(*others).alias("columns") if others else F.lit(None).cast("int").alias("columns"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), kept.alias("rest"))


def restored(found: DataFrame, columns: list[str], text: str = "clean_text") -> DataFrame:
    """The columns of documents again, with the new text; n_chars follows it."""
    new = F.when(F.col("rest.null_text"), F.lit(None)).otherwise(F.col(text))
    out = {"doc_id": F.col("doc_id"), "text": new, "n_chars": F.coalesce(F.length(new), F.lit(0)).cast("long")}
    return found.select(*((out[c] if c in out else F.col(f"rest.columns.`{c}`")).alias(c) for c in columns))
