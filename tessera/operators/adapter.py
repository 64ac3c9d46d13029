"""Items for evaluation from scenes, emissions and stage entities (PRJ-13, PRJ-14, EXT-11), and evaluation figures merged into a manifest (AG-9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kinds as K

#: Prefixes of made-up source ids by item kind (fixed values of the item format).
PREFIXES = {"container": "rect-candidate:v3:", "textbox": "region-primitive:v3:", "connector": "connector-candidate:v3:"}
_STRINGS = "array<string>"


def _items(rows: DataFrame, kind: str, box: Column, parent: Column, attached: Column, *more_ids: str) -> DataFrame:
    prefix = F.lit(PREFIXES[kind])
    ids = F.array(F.concat(prefix, "id"), *(F.when(F.length(c) > 0, F.concat(prefix, F.col(c))) for c in more_ids), "source")
    return rows.select(
        "slide_id", "id", F.lit(kind).alias("kind"), box.alias("box"), F.array_compact(ids).alias("source_ids"), attached.cast(_STRINGS).alias("attachment_ids"), parent.cast("string").alias("parent_id"),
        F.col("confidence").alias("score"), F.lit("geometry_only").alias("bucket"), F.lit(True).alias("evaluable"),
    )


def scene_items(shapes: DataFrame, texts: DataFrame, connectors: DataFrame) -> DataFrame:
    """Items of a scene or an emission: containers and nodes (or shapes), texts with their first owner, connectors with the box of their path and their two owners."""
    none = F.lit(None)
    empty = F.array()
    ends = F.array_compact(F.array("source_owner_id", "target_owner_id"))
    parts = [
        _items(shapes, "container", F.col("box"), none, empty), _items(texts, "textbox", F.col("box"), F.get("owner_ids", F.lit(0)), empty),
        _items(connectors, "connector", G.path_box(F.col("path")), none, ends, "source_candidate_id", "source_evidence_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def entity_items(rows: DataFrame) -> DataFrame:
    """Items of stage entities (entity, kind, object_type, box, source_ids, graph_node_ids, parent_ids, score_total): ids in order, each once; emissions are attached to graph nodes, hypotheses to parents."""
    entity = F.col("entity")
    typed = F.when(F.length(F.coalesce("object_type", F.lit(""))) > 0, F.col("object_type")).otherwise(F.col("kind"))
    kind = F.when(entity.isin("rect", "region"), "container").when(entity.isin("connector", "line"), "connector").when(entity.isin("hypothesis", "emission", "fallback", "motif"), K.eval_kind(typed)).otherwise(K.eval_kind(F.col("kind")))
    ids = F.array_distinct(F.concat(F.array("id"), F.coalesce("source_ids", F.array().cast(_STRINGS))))
    attached = F.when(entity == "emission", F.col("graph_node_ids")).when(entity == "hypothesis", F.col("parent_ids")).otherwise(F.array().cast(_STRINGS))
    parent = F.when(entity == "hypothesis", F.get("parent_ids", F.lit(0)))
    return rows.select("slide_id", "id", kind.alias("kind"), "box", ids.alias("source_ids"), attached.alias("attachment_ids"), parent.alias("parent_id"), F.col("score_total").cast("double").alias("score"), K.bucket(ids).alias("bucket"), F.lit(True).alias("evaluable"))


def stages_of_scene(scene: DataFrame, emitted: DataFrame) -> DataFrame:
    """Items by stage: a scene's stand for objects and selection, an emission's for the output."""
    at = lambda df, *stages: df.select(F.explode(F.array(*map(F.lit, stages))).alias("stage"), "*")
    return at(scene, "03_objects", "05_selection").unionByName(at(emitted, "07_emit"))


def merged_manifest(manifest: DataFrame, matches: DataFrame, truth: DataFrame) -> DataFrame:
    """A manifest row per slide with whether it has ground truth, and the matched ones of its output by bucket, 0 where there is none."""
    hits = matches.where("stage = '07_emit'").groupBy("slide_id").agg(*(F.count(F.when(F.col("bucket") == b, 1)).alias(f"matched_{b}") for b in K.BUCKETS))
    known = truth.select("slide_id").distinct().withColumn("gt_available", F.lit(True))
    rows = manifest.join(hits, "slide_id", "left").join(known, "slide_id", "left")
    return rows.na.fill(0, [f"matched_{b}" for b in K.BUCKETS]).na.fill(False, ["gt_available"])


def evidence_text(similarity: Column) -> Column:
    """A similarity as reports print it, to four digits."""
    return F.format_string("%.4f", similarity.cast("double"))


def reported(value: Column) -> Column:
    """A number rounded half to even at four digits."""
    return F.bround(value, 4)
