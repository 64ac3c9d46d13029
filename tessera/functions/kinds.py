"""Kind, stage and source classification (SCL-1..8, FLT-1..3, PRJ-1, SCL-17..22)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G

# Names that have to equal those in scene files.
CONTAINER_KINDS = ["rect", "rounded_rect", "box", "container", "panel"]
CONNECTOR_KINDS = ["line", "orthogonal_connector", "arrow", "connector", "solid_arrow"]
TEXT_KINDS = ["text", "textbox", "text_only"]
STAGES = ["01_geometry_raw", "02_guides", "03_objects", "05_selection", "07_emit"]
EARLY_STAGES = STAGES[:2]
BUCKETS = ["geometry_only", "fallback_only", "mixed_geometry_fallback", "other"]
GEOMETRY_PREFIXES = ["rect-candidate:", "connector-candidate:", "line-primitive:", "region-primitive:"]
FALLBACK_PREFIXES = ["grow_fallback", "fallback-region:"]


def eval_kind(kind: Column) -> Column:
    """Normaliser of the evaluation: text kinds stay as they are."""
    k = F.lower(F.trim(kind))
    return F.when(k.isin(CONTAINER_KINDS), "container").when(k.isin(CONNECTOR_KINDS), "connector").otherwise(k)


def source_kind(kind: Column) -> Column:
    """Normaliser of the source attribution: also maps text kinds, and names the empty one. Not the same as eval_kind."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return F.when(k.isin(CONTAINER_KINDS), "container").when(k.isin(CONNECTOR_KINDS), "connector").when(k.isin(TEXT_KINDS), "textbox").when(k == "", "unknown").otherwise(k)


def supports(stage: Column, kind: Column) -> Column:
    """Whether a stage can hold a (normalised) kind."""
    return F.when(stage == "01_geometry_raw", kind.isin("container", "connector")).when(stage == "02_guides", kind == "container").otherwise(kind.isin("container", "textbox", "connector"))


def threshold(stage: Column, kind: Column) -> Column:
    """Least similarity of a match; `kind` is normalised."""
    early = stage.isin(EARLY_STAGES)
    return F.when(kind == "connector", F.when(early, F.lit(0.46)).otherwise(F.lit(0.54))).otherwise(F.when(early, F.lit(0.42)).otherwise(F.lit(0.5)))


def stage_similarity(kind_a: Column, box_a: Column, kind_b: Column, box_b: Column) -> Column:
    """0 for different kinds; kinds are normalised."""
    return F.when(kind_a != kind_b, F.lit(0.0)).when(kind_a == "connector", G.connector_similarity(box_a, box_b)).otherwise(G.iou(box_a, box_b))


def contextual_similarity(kind_a: Column, box_a: Column, kind_b: Column, box_b: Column) -> Column:
    """Kinds may differ."""
    return F.when((kind_a == "connector") | (kind_b == "connector"), G.connector_similarity(box_a, box_b)).otherwise(G.iou(box_a, box_b))


def _begins(x: Column, prefixes: list[str]) -> Column:
    found = x.startswith(prefixes[0])
    for p in prefixes[1:]:
        found = found | x.startswith(p)
    return found


def is_geometry(source_id: Column) -> Column:
    return _begins(source_id, GEOMETRY_PREFIXES)


def is_fallback(source_id: Column) -> Column:
    return _begins(source_id, FALLBACK_PREFIXES)


def bucket(source_ids: Column) -> Column:
    ids = F.coalesce(source_ids, F.array().cast("array<string>"))
    geometry, fallback = F.exists(ids, is_geometry), F.exists(ids, is_fallback)
    return F.when(geometry & fallback, BUCKETS[2]).when(geometry, BUCKETS[0]).when(fallback, BUCKETS[1]).otherwise(BUCKETS[3])


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def attachments_agree(a: Column, b: Column) -> Column:
    """True unless both are non-empty and differ as sets."""
    size = lambda x: F.size(F.coalesce(x, F.array().cast("array<string>")))
    return (size(a) == 0) | (size(b) == 0) | F.coalesce(same_set(a, b), F.lit(True))


def enabled(family: Column, families: list[str] | None) -> Column:
    """Allow-list; None allows all."""
    return F.lit(True) if families is None else family.isin(families)


def text_role(b: Column, w: Column, h: Column) -> Column:
    return F.when((b["y0"] <= F.lit(0.18) * h) & (G.width(b) >= F.lit(0.22) * w), "title").when(G.height(b) >= F.lit(0.10) * h, "body").otherwise("label")


def replace_prefix(x: Column, old: str, new: str) -> Column:
    return F.when(x.startswith(old), F.concat(F.lit(new), F.substring(x, len(old) + 1, 1 << 20))).otherwise(x)
