"""Benchmark rollup over artifact trees (SRC-5..9, AG-10..22, WN-12, WN-13, SNK-6, SNK-7).

The inputs are long tables that `sources.artifacts` makes from JSON files, so every aggregate is one group-by over all slides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def latest_iterations(listing: DataFrame) -> DataFrame:
    """The last iteration of each slide in string order (iter_9 after iter_10)."""
    return listing.groupBy("slide").agg(F.max("iteration").alias("iteration"))


def first_existing(slides: DataFrame, listing: DataFrame, roots: list[str]) -> DataFrame:
    """For each (slide, iteration) the first root that has it; null if none does."""
    ranks = F.create_map(*(x for i, r in enumerate(roots) for x in (F.lit(r), F.lit(i))))
    found = listing.where(F.col("root").isin(roots)).groupBy("slide", "iteration").agg(F.min_by("root", ranks[F.col("root")]).alias("root"))
    return slides.join(found, ["slide", "iteration"], "left")


def stage_totals(stages: DataFrame) -> DataFrame:
    """stages: slide, stage, recoverable_count, ground_truth_count."""
    found = stages.groupBy("stage").agg(F.sum("recoverable_count").alias("recoverable_count"), F.sum("ground_truth_count").alias("ground_truth_count"))
    return found.withColumn("recoverable_ratio", ratio(F.col("recoverable_count"), F.col("ground_truth_count")))


def stage_kind_totals(recoverable: DataFrame, truth: DataFrame) -> DataFrame:
    """Both: slide, stage, kind, n; kinds of either side appear."""
    a = recoverable.groupBy("stage", "kind").agg(F.sum("n").alias("recoverable_count"))
    b = truth.groupBy("stage", "kind").agg(F.sum("n").alias("ground_truth_count"))
    both = a.join(b, ["stage", "kind"], "full_outer").na.fill(0)
    return both.withColumn("recoverable_ratio", ratio(F.col("recoverable_count"), F.col("ground_truth_count")))


def tag_totals(rows: DataFrame, tag: str = "tag", kind: str = "kind") -> DataFrame:
    """Counts of a tag, overall (kind null) and by kind; missing tags and kinds are unknown."""
    filled = rows.select(F.coalesce(kind, F.lit("unknown")).alias("kind"), F.coalesce(tag, F.lit("unknown")).alias("tag"))
    return filled.groupingSets([["tag"], ["kind", "tag"]], "kind", "tag").agg(F.count("*").alias("n"), F.grouping("kind").alias("overall"))


def nested_totals(counters: DataFrame, *keys: str) -> DataFrame:
    """Sums of exploded nested counters (… , n) by their path."""
    return counters.groupBy(*keys).agg(F.sum("n").alias("n"))


def means(manifests: DataFrame, sums: list[str], ratios: list[str]) -> DataFrame:
    """One row: sums, and means over slides; 0 without slides."""
    n = F.count("*")
    return manifests.agg(n.alias("slide_count"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums), *(F.when(n == 0, F.lit(0.0)).otherwise(F.sum(c) / n).alias(f"{c}_mean") for c in ratios))


def ablation(grow: Column, motifs: Column) -> Column:
    """Missing flags count as set."""
    flag = lambda c, name: F.when(F.coalesce(c, F.lit(True)), F.lit(name)).otherwise(F.lit(f"no-{name}"))
    return F.concat_ws("+", flag(grow, "grow"), flag(motifs, "motifs"))


def coverage_notice(n: Column) -> Column:
    return F.when(n <= 0, "no_gt_backed_slides").when(n == 1, "single_gt_backed_slide_only").when(n < 3, "low_gt_backed_coverage")


def coverage(slides: DataFrame) -> DataFrame:
    """slides: gt_available."""
    found = slides.agg(F.count(F.when(F.col("gt_available"), 1)).alias("gt_backed_slide_count"), F.count(F.when(~F.coalesce("gt_available", F.lit(False)), 1)).alias("gt_unavailable_slide_count"))
    return found.withColumn("notice", coverage_notice(F.col("gt_backed_slide_count")))


def dominant_stage(oracle: DataFrame, attrition: DataFrame | None, *keys: str) -> DataFrame:
    """Per group the stage where most is lost: the largest attrition count (the first seen on ties), else the largest drop of the ratio between
    neighbouring stages, else the smallest ratio. attrition: keys, stage, n, ord (order of first appearance)."""
    before = F.lag("recoverable_ratio").over(Window.partitionBy(*keys).orderBy("stage"))
    drops = oracle.withColumn("drop", before - F.col("recoverable_ratio")).withColumn("drop", F.when(F.col("drop") > 0, F.col("drop")))
    # the first stage wins ties: the order key falls with the stage's place
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("stage"))
    found = drops.withColumn("place", place).groupBy(*keys).agg(
        F.max_by("stage", F.when(F.col("drop").isNotNull(), F.struct("drop", -F.col("place")))).alias("by_drop"), F.min_by("stage", F.struct("recoverable_ratio", "place")).alias("by_ratio")
    )
    if attrition is None:
        return found.select(*keys, F.coalesce("by_drop", "by_ratio").alias("dominant_loss_stage"))
    most = attrition.groupBy(*keys).agg(F.max_by("stage", F.struct("n", -F.col("ord"))).alias("by_loss"))
    both = found.join(most, list(keys), "full_outer") if keys else found.crossJoin(most)
    return both.select(*keys, F.coalesce("by_loss", "by_drop", "by_ratio").alias("dominant_loss_stage"))
