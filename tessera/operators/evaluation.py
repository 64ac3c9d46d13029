"""Stage oracle, attrition, failure taxonomy and audits (AG-1..4, AG-23, AG-24, AG-26, WN-6, SCL-9..16, JN-15, JN-16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kinds as K
from ..lineage import checkpointed
from . import matching as M

FALLBACK_BUCKETS = ["fallback_only", "mixed_geometry_fallback"]


def stage_table(spark, stages: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame(list(enumerate(stages or K.STAGES)), "stage_ord int, stage string")


def count_by_kind(items: DataFrame) -> DataFrame:
    return M.normalised(items).groupBy("kind").agg(F.count("*").alias("n"))


def bucket_counts(rows: DataFrame, *keys: str, every: DataFrame | None = None) -> DataFrame:
    """Rows by bucket, a column each, 0 where there are none; with `every`, a table of keys, a row for each of those too."""
    if every is not None:
        found = bucket_counts(rows, *keys)
        return every.select(*keys).distinct().join(found, list(keys), "full").na.fill(0, list(K.BUCKETS))
    return rows.groupBy(*keys).agg(*(F.count(F.when(F.col("bucket") == b, 1)).alias(b) for b in K.BUCKETS))


def oracle_by_stage(truth: DataFrame, artifacts: DataFrame, matches: DataFrame, stages: DataFrame) -> DataFrame:
    """Per stage: applicable ground truth, artifacts, matched ones, their ratio and their buckets. Stages without items keep a row."""
    kind = M.normalised(truth).groupBy("kind").agg(F.count("*").alias("n"))
    wanted = F.broadcast(stages.select("stage")).crossJoin(kind).where(K.supports(F.col("stage"), F.col("kind"))).groupBy("stage").agg(F.sum("n").alias("n"))
    there = artifacts.where("evaluable").groupBy("stage").agg(F.count("*").alias("artifact_count"))
    hits = matches.groupBy("stage").agg(F.count("*").alias("recoverable_count"), *(F.count(F.when(F.col("bucket") == b, 1)).alias(b) for b in K.BUCKETS))
    found = stages.select("stage").join(wanted, "stage", "left").join(there, "stage", "left").join(hits, "stage", "left").na.fill(0)
    ratio = F.col("recoverable_count") / F.greatest(F.lit(1), F.col("n"))
    return found.select("stage", F.col("n").cast("long").alias("ground_truth_count"), "artifact_count", "recoverable_count", ratio.alias("recoverable_ratio"), *K.BUCKETS)


def attrition(truth: DataFrame, matches: DataFrame, stages: DataFrame) -> DataFrame:
    """Per ground truth: the first applicable stage without it after one with it; null if there is none."""
    every = M.normalised(truth).select("slide_id", F.col("id").alias("gt_id"), "kind").crossJoin(F.broadcast(stages)).where(K.supports(F.col("stage"), F.col("kind")))
    here = every.join(matches.select("slide_id", "stage", "gt_id", "artifact_id"), ["slide_id", "stage", "gt_id"], "left").withColumn("present", F.col("artifact_id").isNotNull())
    before = Window.partitionBy("slide_id", "gt_id").orderBy("stage_ord").rowsBetween(Window.unboundedPreceding, -1)
    lost = here.withColumn("seen", F.coalesce(F.max("present").over(before), F.lit(False))).withColumn("loss", F.when(F.col("seen") & ~F.col("present"), F.col("stage_ord")))
    found = lost.groupBy("slide_id", "gt_id", "kind").agg(
        F.min_by("stage", "loss").alias("lost_at"), F.count(F.when(F.col("present"), 1)).alias("stages_present"), F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("present"), F.struct("stage", "artifact_id"))))).alias("matched_artifact_ids")
    )
    return M.normalised(truth).select("slide_id", F.col("id").alias("gt_id"), "kind").join(found.drop("kind"), ["slide_id", "gt_id"], "left")


def attrition_counts(rows: DataFrame) -> DataFrame:
    return rows.where("lost_at is not null").groupBy("lost_at").agg(F.count("*").alias("n"))


def covered_ratio(similarities: Column) -> Column:
    """Aggregate: the sum of similarities, at most 1."""
    return F.least(F.lit(1.0), F.coalesce(F.sum(similarities), F.lit(0.0)))


def _same_kind(items: DataFrame, others: DataFrame) -> DataFrame:
    """(slide_id, id, box) with the others of the same kind on the slide."""
    a = M.normalised(items).select("slide_id", "id", "kind", "box")
    b = M.normalised(others).select("slide_id", "kind", F.col("id").alias("other_id"), F.col("box").alias("other_box"), *(["ord"] if "ord" in others.columns else []))
    return a.join(b, ["slide_id", "kind"]).withColumn("similarity", K.contextual_similarity(F.col("kind"), F.col("box"), F.col("kind"), F.col("other_box")))


def failures_of_truth(truth: DataFrame, predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """A tag for each ground truth without a match at the last stage. Predictions need an `ord` column: the first that decides a merge does."""
    gone = checkpointed(M.unmatched(truth, matches, "gt_id"))
    predictions = checkpointed(predictions.where("evaluable"))
    best = M.best_contextual(gone, predictions)
    near = checkpointed(_same_kind(gone, predictions))
    close = near.where("similarity >= 0.1").groupBy("slide_id", "id").agg(F.count("*").alias("n_close"), covered_ratio(F.col("similarity")).alias("covered"), F.max("similarity").alias("closest"))
    around = near.where("box is not null and other_box is not null").where(G.contains(F.col("other_box"), F.col("box")))
    others = M.normalised(truth).select("slide_id", "kind", F.col("id").alias("sibling"), F.col("box").alias("sibling_box"))
    holds = around.join(others, ["slide_id", "kind"]).where("sibling <> id and sibling_box is not null").where(G.contains(F.col("other_box"), F.col("sibling_box")))
    siblings = holds.select("slide_id", "id", "other_id").distinct().withColumn("merged", F.lit(True))
    merge = around.join(siblings, ["slide_id", "id", "other_id"], "left")
    tag = F.when(F.coalesce("merged", F.lit(False)), "merged_siblings").when(G.area(F.col("other_box")) > G.area(F.col("box")) * F.lit(1.35), "merged_into_parent")
    merge = merge.withColumn("tag", tag).where("tag is not null").groupBy("slide_id", "id").agg(F.min_by("tag", "ord").alias("merge_tag"))
    rows = M.normalised(gone).select("slide_id", "id", "kind", "attachment_ids").join(best, ["slide_id", "id"]).join(close, ["slide_id", "id"], "left").join(merge, ["slide_id", "id"], "left")
    tag = (
        F.when(_wrong_attachment(), "wrong_attachment").when(_wrong_type(), "wrong_type").when(F.col("merge_tag").isNotNull(), F.col("merge_tag"))
        .when((F.col("n_close") > 1) & (F.col("covered") >= 0.7), "split_fragments").when(F.col("closest") >= 0.2, "near_miss_geometry").otherwise("missing")
    )
    return rows.select("slide_id", F.col("id").alias("gt_id"), "kind", tag.alias("tag"), F.col("other.id").alias("best_prediction_id"), F.greatest(F.lit(0.0), "similarity").alias("best_similarity"))


def _wrong_attachment() -> Column:
    some = F.size(F.coalesce("attachment_ids", F.array().cast("array<string>"))) > 0
    return some & F.col("other").isNotNull() & (F.col("kind") == F.col("other.kind")) & (F.col("similarity") >= 0.35) & ~F.coalesce(K.same_set(F.col("attachment_ids"), F.col("other.attachment_ids")), F.lit(False))


def _wrong_type() -> Column:
    return F.col("other").isNotNull() & (F.col("kind") != F.col("other.kind")) & (F.col("similarity") >= 0.3)


def failures_of_predictions(truth: DataFrame, predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """A tag for each prediction without a match at the last stage."""
    predictions = checkpointed(predictions.where("evaluable"))
    gone = checkpointed(M.unmatched(predictions, matches, "artifact_id"))
    best = M.best_contextual(gone, truth)
    near = checkpointed(_same_kind(gone, truth))
    close = near.where("similarity >= 0.1").groupBy("slide_id", "id").agg(F.count("*").alias("n_close"), F.max("similarity").alias("closest"), F.min("other_id").alias("only"))
    inside = near.where("box is not null and other_box is not null").where(G.contains(F.col("box"), F.col("other_box"))).groupBy("slide_id", "id").agg(F.count("*").alias("n_inside"))
    hits = _same_kind(truth, predictions).where("similarity >= 0.1").groupBy("slide_id", F.col("id").alias("only")).agg(F.count("*").alias("n_fragments"))
    rows = M.normalised(gone).select("slide_id", "id", "kind", "attachment_ids", "bucket").join(best, ["slide_id", "id"]).join(close, ["slide_id", "id"], "left")
    rows = rows.join(inside, ["slide_id", "id"], "left").join(hits, ["slide_id", "only"], "left")
    tag = (
        F.when(_wrong_attachment(), "wrong_attachment").when(_wrong_type(), "wrong_type").when(F.col("n_inside") > 1, "merged_siblings")
        .when((F.col("n_close") == 1) & (F.col("n_fragments") > 1), "split_fragments").when(F.col("closest") >= 0.2, "near_miss_geometry").otherwise("hallucinated_prediction")
    )
    return rows.select("slide_id", F.col("id").alias("prediction_id"), "kind", tag.alias("tag"), F.col("other.id").alias("best_gt_id"), F.greatest(F.lit(0.0), "similarity").alias("best_similarity"), "bucket")


def _audit_columns(pairs: DataFrame) -> DataFrame:
    """The best candidates of all stages side by side, as best_of() orders them: one row a ground truth, one struct a stage."""
    item, order = F.struct(F.col("item").dropFields("attachment_ids").alias("item"), "similarity", "passes"), F.struct("similarity", "item.score", "item.id")
    return pairs.groupBy("slide_id", "gt_id").agg(*(F.max_by(item, F.when(F.col("stage") == s, order)).alias(n) for n, s in zip(("raw", "snapped", "object", "selected", "emit"), K.STAGES, strict=True)))


def geometry_audit(truth: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per ground truth the best candidate of each stage, and a status that tells where it was lost.

    Pairs are many times the items, so they are made twice and never written; if both tables lie by slide, nothing is shuffled here."""
    pairs = M.same_kind_pairs(truth, artifacts, "07_emit", by_slide=True)
    hits = M.matches_of(pairs.where("stage in ('05_selection', '07_emit')")).groupBy("slide_id", "gt_id")
    hits = hits.agg(F.max(F.col("stage") == "05_selection").alias("is_selected"), F.max(F.col("stage") == "07_emit").alias("is_emitted"), F.max(F.when(F.col("stage") == "07_emit", F.col("bucket"))).alias("emit_bucket"))
    boxes = M.normalised(truth).select("slide_id", F.col("id").alias("gt_id"), "kind", F.col("box").alias("gt_box"))
    rows = M.join_by_slide(M.join_by_slide(boxes, _audit_columns(pairs), "gt_id", "left"), hits, "gt_id", "left").na.fill(False, ["is_selected", "is_emitted"])
    passes = lambda s: F.coalesce(F.col(f"{s}.passes"), F.lit(False))
    similarity = lambda s: F.coalesce(F.col(f"{s}.similarity"), F.lit(0.0))
    rescued = (passes("object") & F.coalesce(F.col("object.item.bucket").isin(FALLBACK_BUCKETS), F.lit(False)) & ~passes("raw")) | F.coalesce(F.col("emit_bucket").isin(FALLBACK_BUCKETS), F.lit(False))
    rows = rows.withColumn("fallback_rescued", rescued)
    status = (
        F.when(F.col("raw").isNull(), "no_raw_candidate").when(~passes("raw"), "raw_candidate_below_threshold")
        .when(F.col("snapped").isNotNull() & ~passes("snapped") & (similarity("snapped") + F.lit(0.05) < similarity("raw")), "guide_snap_hurt")
        .when(F.col("object").isNull(), "object_conversion_absent").when(~passes("object"), "object_conversion_rejected")
        .when(~F.col("is_selected"), "selection_suppressed").when(~F.col("is_emitted"), "emit_missing").when(F.col("fallback_rescued"), "fallback_rescued").otherwise("recovered")
    )
    return rows.withColumn("status", status)


def _enclosed(box: Column, others: Column) -> Column:
    """Ids among `others` (id, box) that lie in a box, but for the row's own; null if there are none."""
    found = F.array_sort(F.transform(F.filter(others, lambda o: (o["id"] != F.col("gt_id")) & G.contains(box, o["box"])), lambda o: o["id"]))
    return F.when(F.size(found) > 0, found)


def container_audit(truth: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Audit of containers: relation to the raw and the snapped candidate, what snapping did, and a status."""
    truth = M.normalised(truth).where("kind = 'container'")  # kinds never compete
    rows = geometry_audit(truth, artifacts)
    others = truth.where("box is not null").groupBy("slide_id").agg(F.collect_list(F.struct("id", "box")).alias("others"))
    rows = rows.join(others, "slide_id", "left")
    for name in ("raw", "snapped"):
        rows = rows.withColumn(f"{name}_enclosed", _enclosed(F.col(f"{name}.item.box"), F.col("others")))
    rows = rows.drop("others")
    guides = artifacts.where("evaluable and stage = '02_guides' and box is not null").groupBy("slide_id").agg(F.collect_list(G.signature(F.col("box"))).alias("signatures"))
    own = G.signature(F.col("snapped.item.box"))
    rows = rows.join(guides, "slide_id", "left").withColumn("n_same", F.size(F.filter("signatures", lambda s: s == own))).drop("signatures")
    passes = lambda s: F.coalesce(F.col(f"{s}.passes"), F.lit(False))
    raw, snapped = (F.coalesce(F.col(f"{s}.similarity"), F.lit(0.0)) for s in ("raw", "snapped"))
    effect = (
        F.when(F.col("raw").isNull() | F.col("snapped").isNull(), "unchanged_by_snap").when(passes("raw") & ~passes("snapped"), "snap_moved_below_threshold")
        .when((F.col("n_same") > 1) & (snapped + F.lit(0.01) < raw), "snap_collapsed_distinct_boxes").when(snapped > raw + F.lit(0.01), "improved_by_snap")
        .when(snapped + F.lit(0.01) < raw, "worsened_by_snap").otherwise("unchanged_by_snap")
    )
    rows = rows.withColumn("snap_effect", effect)
    for name in ("raw", "snapped"):
        b = F.col(f"{name}.item.box")
        rows = rows.withColumn(f"{name}_area_ratio", G.area_ratio(b, F.col("gt_box"))).withColumn(f"{name}_relation", G.containment(b, F.col("gt_box")))
    some_inside = F.size(F.coalesce("raw_enclosed", F.array().cast("array<string>"))) > 0
    status = (
        F.when(F.col("raw").isNull(), "no_raw_candidate").when(F.col("fallback_rescued"), "fallback_rescued").when(F.col("is_emitted"), "recovered")
        .when(F.col("is_selected") & passes("object"), "selection_suppressed").when(F.col("snap_effect").isin("snap_moved_below_threshold", "snap_collapsed_distinct_boxes"), "snap_hurt")
        .when((passes("raw") | passes("snapped")) & F.col("object").isNull(), "object_conversion_absent")
        .when((F.col("raw.item.raw_kind") == "rounded_rect") & (raw >= 0.08) & (raw < 0.42), "rounded_panel_missed")
        .when((F.col("raw_relation") == "contains_gt") & ((F.col("raw_area_ratio") >= 1.55) | some_inside), "oversized_or_merged_candidate")
        .when((F.col("raw_relation") == "inside_gt") & (F.col("raw_area_ratio") <= 0.65), "undersized_fragment_candidate")
        .when((F.col("raw_relation") == "overlap_only") & (raw >= 0.08), "weak_or_missing_side").when(passes("raw") & ~passes("object"), "object_conversion_absent")
        .otherwise("raw_candidate_below_threshold")
    )
    return rows.withColumn("status", status).withColumn("snap_delta", snapped - raw)
