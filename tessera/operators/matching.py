"""Similarity join, greedy one-to-one matching and best candidates (JN-1, JN-12..14, WN-1, WN-2, WN-5).

Items have slide_id, id, kind, box, source_ids, attachment_ids, score, bucket, evaluable (and stage for artifacts). Joins always carry the slide (and stage, kind)
as equality keys, so they shuffle by slide; a candidate table is pruned by similarity before anything is collected per slide.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kinds as K

MATCH = "slide_id long, stage string, gt_id string, artifact_id string, similarity double, bucket string, kind string"


def normalised(items: DataFrame) -> DataFrame:
    return items.withColumn("kind", K.eval_kind(F.col("kind")))


def candidates(truth: DataFrame, artifacts: DataFrame, attachment: bool = False) -> DataFrame:
    """Pairs of a slide, stage and kind that reach the stage's threshold."""
    g = normalised(truth).select("slide_id", "kind", F.col("id").alias("gt_id"), F.col("box").alias("gb"), F.col("attachment_ids").alias("ga"))
    a = normalised(artifacts.where("evaluable")).select("slide_id", "kind", "stage", F.col("id").alias("artifact_id"), F.col("box").alias("ab"), F.col("attachment_ids").alias("aa"), "bucket")
    a = a.where(K.supports(F.col("stage"), F.col("kind")))
    pairs = g.join(a, ["slide_id", "kind"]).withColumn("similarity", K.stage_similarity(F.col("kind"), F.col("gb"), F.col("kind"), F.col("ab")))
    pairs = pairs.where(F.col("similarity") >= K.threshold(F.col("stage"), F.col("kind")))
    if attachment:
        pairs = pairs.where(K.attachments_agree(F.col("ga"), F.col("aa")))
    return pairs.select("slide_id", "stage", "gt_id", "artifact_id", "similarity", "bucket", "kind")


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come group by group, in the order of taking; held are the ids that the current group has used."""
    group, used_g, used_a = None, set(), set()
    for batch in batches:
        keep = []
        for slide, stage, kind, g, a in zip(*(batch.column(k).to_pylist() for k in ("slide_id", "stage", "kind", "gt_id", "artifact_id")), strict=True):
            if (slide, stage, kind) != group:
                group, used_g, used_a = (slide, stage, kind), set(), set()
            free = g not in used_g and a not in used_a
            if free:
                used_g.add(g)
                used_a.add(a)
            keep.append(free)
        yield batch.filter(pa.array(keep, pa.bool_()))


def greedy_match(pairs: DataFrame) -> DataFrame:
    """One-to-one matches of each (slide, stage): pairs by similarity (falling), then ids, kind and bucket, each taken if both sides are free.

    A pair's sides are of one kind, so kinds never compete and (slide, stage, kind) are groups of their own. A group's pairs stream through one task in
    order (the sort spills); memory holds the ids used so far, never the pairs.
    """
    names = [c.split()[0] for c in MATCH.split(", ")]
    ordered = pairs.select(*names).repartition("slide_id", "stage", "kind").sortWithinPartitions("slide_id", "stage", "kind", F.desc("similarity"), "gt_id", "artifact_id", "bucket")
    return ordered.mapInArrow(_greedy, MATCH)


def stage_matches(truth: DataFrame, artifacts: DataFrame, attachment: bool = False) -> DataFrame:
    return greedy_match(candidates(truth, artifacts, attachment))


def match_rows(truth: DataFrame, matches: DataFrame, stages: DataFrame) -> DataFrame:
    """Every applicable ground truth of every stage, with its match or nulls and similarity 0."""
    every = normalised(truth).select("slide_id", F.col("id").alias("gt_id"), "kind").crossJoin(F.broadcast(stages.select("stage"))).where(K.supports(F.col("stage"), F.col("kind")))
    found = every.join(matches.drop("kind"), ["slide_id", "stage", "gt_id"], "left")
    return found.select("slide_id", "stage", "gt_id", "kind", "artifact_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "bucket")


def unmatched(items: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Items whose id isn't matched; key is gt_id or artifact_id."""
    return items.join(matches.select("slide_id", F.col(key).alias("id")).distinct(), ["slide_id", "id"], "left_anti")


def join_by_slide(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join by slide_id and `key` that shuffles by slide_id only, and not at all what lies so: Spark would deal tables out anew for a second key, and does not take bounds for one."""
    other = right.withColumnsRenamed({"slide_id": "other_slide", key: "other_key"})
    return left.join(other, (F.col("slide_id") == F.col("other_slide")) & F.col(key).between(F.col("other_key"), F.col("other_key")), how).drop("other_slide", "other_key")


def measured(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """`pairs` with `similarity`, K.stage_similarity() of the boxes `a` and `b` of one `kind`, in steps of a few operations: as one expression its
    generated method is over the 8000 bytes that the JVM compiles, and is interpreted instead. Steps that are used more than once stay columns."""
    columns, sides = pairs.columns, (("a", F.col(a)), ("b", F.col(b)))
    either = lambda f: {f"_{n}_{s}": c for s, box in sides for n, c in f(s, box).items()}
    c = lambda n: (F.col(f"_{n}_a"), F.col(f"_{n}_b"))
    zero, line, flat = F.lit(0.0), F.col("kind") == "connector", F.col("_flat")
    rows = pairs.withColumns(either(lambda s, box: {"w": G.width(box), "h": G.height(box)}))
    rows = rows.withColumns(either(lambda s, box: {"flat": F.col(f"_w_{s}") >= F.col(f"_h_{s}")})).withColumns({"_crossed": F.col("_flat_a") != F.col("_flat_b"), "_flat": F.col("_flat_a")})
    rows = rows.withColumn("_pad", F.when(line, F.when(F.col("_crossed"), F.lit(8.0)).otherwise(F.lit(6.0))).otherwise(zero))
    rows = rows.withColumns(either(lambda s, box: {k: box[k] - F.col("_pad") for k in ("x0", "y0")} | {k: box[k] + F.col("_pad") for k in ("x1", "y1")}))
    share = lambda lo, hi: G.interval_overlap(F.col(f"_{lo}_a"), F.col(f"_{hi}_a"), F.col(f"_{lo}_b"), F.col(f"_{hi}_b"))
    area = lambda s: F.greatest(zero, F.col(f"_x1_{s}") - F.col(f"_x0_{s}")) * F.greatest(zero, F.col(f"_y1_{s}") - F.col(f"_y0_{s}"))
    rows = rows.withColumn("_both", share("x0", "x1") * share("y0", "y1")).withColumn("_union", area("a") + area("b") - F.col("_both"))
    rows = rows.withColumn("_iou", F.when((F.col("_both") <= 0) | (F.col("_union") <= 0), zero).otherwise(F.col("_both") / F.col("_union")))
    along = lambda s, box: {"lo": F.when(flat, box["x0"]).otherwise(box["y0"]), "hi": F.when(flat, box["x1"]).otherwise(box["y1"]), "size": F.when(flat, F.col(f"_w_{s}")).otherwise(F.col(f"_h_{s}"))}
    rows = rows.withColumns(either(along)).withColumns(either(lambda s, box: {"mid": F.when(flat, box["y0"] + F.col(f"_h_{s}") / 2).otherwise(box["x0"] + F.col(f"_w_{s}") / 2)}))
    rows = rows.withColumn("_reference", F.greatest(*c("size"), F.lit(1.0)))
    orth = F.greatest(zero, F.lit(1.0) - F.abs(c("mid")[0] - c("mid")[1]) / F.lit(26.0))
    ends = F.abs(c("lo")[0] - c("lo")[1]) + F.abs(c("hi")[0] - c("hi")[1])
    end = F.greatest(zero, F.lit(1.0) - ends / F.greatest(F.lit(24.0), F.col("_reference") * F.lit(0.7)))
    rows = rows.withColumn("_along", share("lo", "hi") / F.col("_reference") * F.lit(0.55) + orth * F.lit(0.25) + end * F.lit(0.20))
    found = F.when(F.col(a).isNull() | F.col(b).isNull(), zero).when(~line, F.col("_iou")).when(F.col("_crossed"), F.col("_iou") * F.lit(0.5)).otherwise(F.greatest("_iou", "_along"))
    return rows.select(*columns, found.alias("similarity"))


def same_kind_pairs(truth: DataFrame, artifacts: DataFrame, attachment_stage: str | None = None, by_slide: bool = False) -> DataFrame:
    """Every ground truth with every evaluable artifact of its slide and kind: similarity, and whether it passes the stage's threshold (and, at `attachment_stage`, the attachments agree)."""
    g = normalised(truth).select("slide_id", "kind", F.col("id").alias("gt_id"), F.col("box").alias("gt_box"), F.col("attachment_ids").alias("ga"))
    a = artifacts.where("evaluable").withColumn("raw_kind", F.col("kind")).withColumn("kind", K.eval_kind(F.col("kind")))
    a = a.select("slide_id", "kind", "stage", F.struct("id", "box", "attachment_ids", "score", "bucket", "raw_kind").alias("item"))
    pairs = join_by_slide(g, a, "kind") if by_slide else g.join(a, ["slide_id", "kind"])
    pairs = measured(pairs.withColumn("item_box", F.col("item.box")), "gt_box", "item_box").drop("item_box")
    agree = (F.col("stage") != F.lit(attachment_stage)) | K.attachments_agree(F.col("ga"), F.col("item.attachment_ids")) if attachment_stage else F.lit(True)
    return pairs.withColumn("passes", (F.col("similarity") >= K.threshold(F.col("stage"), F.col("kind"))) & agree).drop("ga")


def matches_of(pairs: DataFrame) -> DataFrame:
    """Greedy matches among those of same_kind_pairs() that pass, at stages that support the kind."""
    fit = F.col("passes") & K.supports(F.col("stage"), F.col("kind"))
    return folded_matches(pairs.select("slide_id", "stage", "gt_id", F.col("item.id").alias("artifact_id"), "similarity", F.col("item.bucket").alias("bucket"), "kind", fit.alias("fit")), F.col("fit"))


def folded_matches(pairs: DataFrame, fit: Column | None = None) -> DataFrame:
    """The matches of greedy_match() without its shuffle, for pairs that lie by slide: a group's pairs are one array here, folded in the same order.

    Only pairs that `fit` count. They are told apart here: Spark would move a filter below all that `fit` comes from, and compute that again for it."""
    order = F.struct((-F.col("similarity")).alias("order"), "gt_id", "artifact_id", "bucket")
    order = order if fit is None else F.when(fit, order)
    taken = lambda kept, x: F.exists(kept, lambda k: k["gt_id"].eqNullSafe(x["gt_id"]) | k["artifact_id"].eqNullSafe(x["artifact_id"]))
    groups = pairs.groupBy("slide_id", "stage", "kind").agg(F.sort_array(F.collect_list(order)).alias("all"))
    found = F.aggregate("all", F.filter("all", lambda x: x["gt_id"].isNull() & x["gt_id"].isNotNull()), lambda kept, x: F.when(taken(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
    rows = groups.select("slide_id", "stage", "kind", F.explode(found).alias("m"))
    return rows.select("slide_id", "stage", "m.gt_id", "m.artifact_id", (-F.col("m.order")).alias("similarity"), "m.bucket", "kind")


def best_of(pairs: DataFrame) -> DataFrame:
    """Of each ground truth and stage the pair with the largest (similarity, score, id); an aggregate, so pairs are combined before they are shuffled."""
    order = F.struct("similarity", F.col("item.score"), F.col("item.id"))
    best = pairs.groupBy("slide_id", "stage", "gt_id", "kind").agg(F.max_by(F.struct("gt_box", "item", "similarity", "passes"), order).alias("b"))
    return best.select("slide_id", "stage", "gt_id", "kind", "b.*")


def best_candidates(truth: DataFrame, artifacts: DataFrame, attachment: bool = False, attachment_stage: str | None = None) -> DataFrame:
    """Of each ground truth and stage the same-kind artifact with the largest (similarity, score, id); passes tells whether it reaches the threshold."""
    pairs = same_kind_pairs(truth, artifacts, attachment_stage)
    if attachment:
        pairs = pairs.join(truth.select("slide_id", F.col("id").alias("gt_id"), F.col("attachment_ids").alias("ga")), ["slide_id", "gt_id"])
        pairs = pairs.withColumn("passes", F.col("passes") & K.attachments_agree(F.col("ga"), F.col("item.attachment_ids"))).drop("ga")
    return best_of(pairs)


#: Similarities that differ by less, relatively, tie.
CLOSE = 1e-9


def best_contextual(left: DataFrame, right: DataFrame) -> DataFrame:
    """Of each left item the most similar right item of its slide, of any kind; of those within CLOSE of the best, the smallest id. Items without any keep a null one at similarity 0."""
    a = normalised(left).select("slide_id", "id", "kind", "box")
    b = normalised(right).select("slide_id", F.struct("id", "kind", "attachment_ids").alias("other"), F.col("box").alias("other_box"))
    pairs = a.join(b, "slide_id", "left").withColumn("similarity", F.coalesce(K.contextual_similarity(F.col("kind"), F.col("box"), F.col("other.kind"), F.col("other_box")), F.lit(0.0)))
    pairs = pairs.select("slide_id", "id", "other", "similarity", F.max("similarity").over(Window.partitionBy("slide_id", "id")).alias("top"))
    near = pairs.where(F.col("top") - F.col("similarity") <= F.col("top") * F.lit(CLOSE))
    best = near.groupBy("slide_id", "id").agg(F.min_by(F.struct("other", "similarity"), F.struct("other.id", "similarity")).alias("b"))
    return best.select("slide_id", "id", "b.other", "b.similarity")
