"""A conversion with all it found written down (SNK-5, SNK-8): eleven tables of records as JSON lines, nine overlays of each picture, and the evaluation's files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpointed
from ..operators import evaluation as E
from ..operators import matching, scene
from ..sources import artifacts as A
from ..sources import pictures as P
from . import convert as V

#: Overlay, stage, colour and line width (fixed values of the reports).
BOXES = (
    ("layers", "texts", (32, 93, 179), 2), ("layers", "raster", (120, 60, 160), 3), ("proposals", "proposals", (32, 93, 179), 3), ("instances", "containers", (38, 120, 72), 3), ("instances", "nodes", (211, 117, 0), 2),
    ("connectors", "nodes", (180, 180, 180), 1), ("residual", "residuals", (196, 38, 54), 3), ("scene", "containers", (38, 120, 72), 2), ("scene", "nodes", (211, 117, 0), 2), ("scene", "texts", (32, 93, 179), 1),
    ("attached", "nodes", (180, 180, 180), 1), ("solved", "nodes", (180, 180, 180), 1), ("emitted", "emitted", (20, 20, 20), 2),
)
LINES = (("connectors", "evidence", (196, 38, 54), 3), ("attached", "candidates", (211, 117, 0), 2), ("solved", "connectors", (38, 120, 72), 2))
EVALUATION = ("oracle_by_stage", "attrition_by_stage", "failure_taxonomy", "geometry_audit", "container_geometry_audit")


def records(stages: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The eleven tables of a run."""
    expected = stages["emitted"].where("element <> 'residual'")
    difference = scene.diff(expected, stages["emitted"].where("element <> 'residual'"))
    return {
        "text_regions": stages["texts"], "raster_regions": stages["raster"], "family_proposals": stages["proposals"], "diagram_instances": stages["nodes"].select("slide_id", "id", "box").unionByName(stages["containers"].select("slide_id", "id", "box")),
        "connector_evidence": stages["evidence"], "primitive_scene": stages["ports"], "attached_connectors": stages["candidates"], "unattached_connectors": stages["unattached"], "solved_connectors": stages["connectors"],
        "emit_scene": stages["emitted"], "emit_diff": scene.diff_summary(difference),
    }


def drawn(stages: dict[str, DataFrame]) -> DataFrame:
    """Marks of the nine overlays."""
    focus = stages["proposals"]
    rows = stages | {"proposals": focus.withColumn("box", F.col("focus")) if "focus" in focus.columns else focus}
    out = None
    for name, stage, colour, width in BOXES:
        one = P.marks(rows[stage], name, colour, width)
        out = one if out is None else out.union(one)
    paths = stages["evidence"].select("slide_id", F.col("id").alias("evidence_id"), F.array("a", "b").alias("path"))
    for name, stage, colour, width in LINES:
        lines = {"evidence": paths, "candidates": stages["candidates"].select("slide_id", "evidence_id").join(paths, ["slide_id", "evidence_id"]), "connectors": stages["connectors"].select("slide_id", "path")}[stage]
        out = out.union(P.path_marks(lines, F.col("path"), name, colour, width))
    return out


def evaluation(truth: DataFrame, artifacts: DataFrame) -> dict[str, DataFrame]:
    """The evaluation's five tables."""
    spark = truth.sparkSession
    truth, artifacts = checkpointed(truth), checkpointed(artifacts)
    stages, matches = E.stage_table(spark), checkpointed(matching.stage_matches(truth, artifacts))
    last = artifacts.where("stage = '07_emit'")
    final = checkpointed(matching.stage_matches(truth, last, attachment=True))
    side = lambda df, name: df.select("slide_id", F.lit(name).alias("side"), F.col(df.columns[1]).alias("id"), "kind", "tag", "best_similarity")
    failures = side(E.failures_of_truth(truth, last, final), "ground_truth").union(side(E.failures_of_predictions(truth, last, final), "predictions"))
    audit = E.geometry_audit(truth, artifacts).select("slide_id", "gt_id", "kind", "status", "fallback_rescued")
    containers = E.container_audit(truth, artifacts).select("slide_id", "gt_id", "kind", "status", "snap_effect")
    return dict(zip(EVALUATION, (E.oracle_by_stage(truth, artifacts, matches, stages), E.attrition(truth, matches, stages), failures, audit, containers), strict=True))


def write_evaluation(truth: DataFrame, artifacts: DataFrame, to: str, reason: str = "ground_truth_missing") -> dict[str, str]:
    """The five tables below `to`; without any ground truth, each is one row that tells why there is nothing."""
    if truth.limit(1).count():
        return A.write_tables(to, **evaluation(truth, artifacts))
    gone = truth.sparkSession.createDataFrame([("unavailable", False, reason)], "status string, gt_available boolean, reason string")
    return A.write_tables(to, **{name: gone for name in EVALUATION})


def debug_run(pictures: DataFrame, to: str, truth: DataFrame | None = None, artifacts: DataFrame | None = None) -> dict[str, str]:
    """Converts `pictures` and writes records, a summary, overlays (Parquet: slide_id, overlay, png) and, given both, the evaluation below `to`; gives the paths."""
    stages = V.convert(pictures)
    paths = A.write_tables(to, **records(stages), summary=V.summary(stages))
    P.overlays(pictures, drawn(stages)).write.mode("overwrite").parquet(f"{to}/overlays")
    if truth is not None and artifacts is not None:
        paths |= write_evaluation(truth, artifacts, f"{to}/08_eval")
    return paths | {"overlays": f"{to}/overlays"}
