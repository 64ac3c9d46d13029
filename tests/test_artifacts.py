"""The rollup over a generated tree, with one slide that has ground truth and one that hasn't."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.plans import benchmark as B
from tessera.plans import rollup as R
from tessera.sources import artifacts as A


DIAGNOSTICS = "/_diagnostics"


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name in ("iter_9", "iter_10"):
        put(root / "slide_a" / name / "elements.json", {})
    put(root / "slide_b" / "iter_01" / "elements.json", {})
    a = root / "_diagnostics" / "slide_a" / "iter_9"
    put(a / "manifest.json", {
        "status": "ok", "gt_available": True, "ablation_flags": {"grow_fallback_enabled": True}, "emit_accounting": {"native_object_count": 4, "raster_region_count": 1, "native_area_ratio": 0.5, "raster_area_ratio": 0.1},
        "motif_accounting": {"pair": {"proposed": 3, "accepted": 1}}, "fallback_accounting": {"grow_fallback_hypothesis_count": 2},
        "source_attribution": {"07_emit": {"matched_gt_by_source_bucket": {"geometry_only": 2, "other": 1}, "matched_gt_by_source_bucket_by_kind": {"container": {"geometry_only": 2}}}},
    })
    put(a / "08_eval" / "oracle_by_stage.json", {"status": "ok", "gt_available": True, "stages": {
        "01_geometry_raw": {"recoverable_count": 3, "ground_truth_count": 4, "ground_truth_count_by_kind": {"container": 3, "connector": 1}, "recoverable_by_kind": {"container": 2, "connector": 1}, "recoverable_by_source_bucket": {"geometry_only": 3}},
        "07_emit": {"recoverable_count": 3, "ground_truth_count": 4, "ground_truth_count_by_kind": {"container": 3}, "recoverable_by_kind": {"container": 2, "connector": 1}},
    }})
    put(a / "08_eval" / "attrition_by_stage.json", {"ground_truth": [{"gt_id": "g1", "lost_at": "01_geometry_raw"}, {"gt_id": "g2", "lost_at": "05_selection"}, {"gt_id": "g3", "lost_at": None}]})
    put(a / "08_eval" / "failure_taxonomy.json", {"ground_truth": [{"gt_id": "g1", "kind": "container", "tag": "missing"}, {"gt_id": "g2", "tag": "missing"}], "predictions": [{"prediction_id": "p", "kind": "container"}]})
    put(a / "08_eval" / "container_geometry_audit.json", {"ground_truth": [{"gt_id": "g1", "kind": "container", "status": "recovered", "snap_effect": "unchanged_by_snap"}], "snap_effect_counts": {"unchanged_by_snap": 1}})
    return str(root)


def test_listing_and_latest(spark, tree):
    found = A.listing(spark, tree, f"{tree}/_diagnostics")
    latest = {r.slide: r.iteration for r in R.latest_iterations(A.slides(found)).collect()}
    assert latest == {"slide_a": "iter_9", "slide_b": "iter_01"}
    chosen = R.first_existing(A.slides(found), found, [r.root for r in found.where("root like '%_diagnostics'").select("root").distinct().collect()])
    assert {(r.slide, r.iteration): r.root is not None for r in chosen.collect()} == {("slide_a", "iter_9"): True, ("slide_a", "iter_10"): False, ("slide_b", "iter_01"): False}


def test_rollup(spark, tree):
    oracle = A.files(spark, tree + DIAGNOSTICS, "oracle_by_stage.json", A.ORACLE)
    manifest = A.manifest_rows(A.files(spark, tree + DIAGNOSTICS, "manifest.json", A.MANIFEST))
    slides = R.latest_iterations(A.slides(A.listing(spark, tree, tree + DIAGNOSTICS)))
    covered = R.coverage(slides.join(manifest.select("slide", "gt_available"), "slide", "left")).first()
    assert tuple(covered) == (1, 1, "single_gt_backed_slide_only")
    stages = A.stage_rows(oracle)
    assert {r.stage: r.recoverable_ratio for r in R.stage_totals(stages).collect()} == {"01_geometry_raw": 0.75, "07_emit": 0.75}
    kinds = R.stage_kind_totals(A.stage_kind_rows(oracle, "recoverable_by_kind"), A.stage_kind_rows(oracle, "ground_truth_count_by_kind"))
    assert {(r.stage, r.kind): (r.recoverable_count, r.ground_truth_count) for r in kinds.collect()}["07_emit", "connector"] == (1, 0)
    tags = {(r.kind, r.tag, r.overall): r.n for r in R.tag_totals(A.tagged_rows(A.files(spark, tree + DIAGNOSTICS, "failure_taxonomy.json", A.FAILURES), "ground_truth")).collect()}
    assert tags == {(None, "missing", 1): 2, ("container", "missing", 0): 1, ("unknown", "missing", 0): 1}
    whole = R.means(slides.join(manifest, "slide", "left").na.fill(0), ["native_object_count"], ["native_area_ratio"]).first()
    assert (whole.slide_count, whole.native_object_count, whole.native_area_ratio_mean) == (2, 4, 0.25)
    raw = A.files(spark, tree + DIAGNOSTICS, "manifest.json", A.MANIFEST)
    assert {(r.counter, r.n) for r in A.motif_rows(raw).collect()} == {("proposed", 3), ("accepted", 1)}
    assert {(r.kind, r.bucket, r.n) for r in A.attribution_rows(raw).collect()} == {(None, "geometry_only", 2), (None, "other", 1), ("container", "geometry_only", 2)}
    assert [r.a for r in manifest.select(R.ablation(F.col("grow"), F.col("motifs")).alias("a")).collect()] == ["grow+motifs"]


def test_report(spark, tree, tmp_path):
    # the latest iteration in string order is iter_9, which has the diagnostics
    whole = B.write_summary(spark, tree, str(tmp_path))
    assert json.loads(spark.read.text(f"{tmp_path}/benchmark_stage_summary").first().value) == whole
    assert {
        "status", "benchmark_root", "slide_count", "gt_backed_slide_count", "gt_unavailable_slide_count", "gt_coverage_notice", "stage_oracle", "stage_oracle_by_kind", "stage_oracle_by_source_bucket", "stage_attrition",
        "failure_taxonomy", "failure_taxonomy_by_kind", "geometry_audit_status_counts", "geometry_audit_status_counts_by_kind", "container_snap_effect_counts", "native_object_count", "raster_region_count", "dropped_hypothesis_count",
        "grow_fallback_hypothesis_count", "native_area_ratio_mean", "raster_area_ratio_mean", "raster_native_overlap_area_ratio_mean", "selection_count_by_source_bucket", "native_emit_count_by_source_bucket",
        "final_matched_gt_by_source_bucket", "source_bucket_counts_by_kind", "final_matched_gt_by_kind", "ablation_counts", "motif_accounting", "dominant_loss_stage",
    } == set(whole)
    assert whole["gt_coverage_notice"] == "single_gt_backed_slide_only" and (whole["slide_count"], whole["native_object_count"], whole["native_area_ratio_mean"]) == (2, 4, 0.25)
    assert whole["stage_oracle_by_kind"]["07_emit"] == whole["final_matched_gt_by_kind"] == {"container": {"recoverable_count": 2, "ground_truth_count": 3, "recoverable_ratio": 2 / 3}, "connector": {"recoverable_count": 1, "ground_truth_count": 0, "recoverable_ratio": 0.0}}
    assert whole["motif_accounting"] == {"pair": {"proposed": 3, "accepted": 1, "rejected": 0, "absorbed_members": 0, "suppressed_members": 0}}
    assert whole["failure_taxonomy"] == {"ground_truth": {"missing": 2}, "predictions": {"unknown": 1}} and whole["final_matched_gt_by_source_bucket"] == {"geometry_only": 2, "other": 1}
    assert whole["source_bucket_counts_by_kind"] == {"07_emit": {"matched_gt_by_source_bucket_by_kind": {"container": {"geometry_only": 2}}}} and whole["ablation_counts"] == {"grow+motifs": 2}
    assert whole["dominant_loss_stage"] == "01_geometry_raw" and whole["container_snap_effect_counts"] == {"unchanged_by_snap": 1}
    assert B.summary_line(whole) == "slides=2 gt_backed=1 gt_unavailable=1 gt_notice=single_gt_backed_slide_only dominant_loss_stage=01_geometry_raw matched_container=2 matched_connector=1 native=4 raster=1 raster_area_mean=0.050"
    rows = {r.slide: r for r in spark.read.json(f"{tmp_path}/benchmark_stage_rollup").collect()}
    a, b = (json.loads(rows[k].report) for k in ("slide_a", "slide_b"))
    assert rows["slide_a"].dominant_loss_stage == "01_geometry_raw" and rows["slide_a"].ablation_flags.grow_fallback_enabled and rows["slide_a"].iteration == "iter_9"
    assert a["attrition_counts"] == {"01_geometry_raw": 1, "05_selection": 1} and a["gt_available"] and a["motif_accounting"]["pair"]["accepted"] == 1 and a["oracle_stages"]["07_emit"]["recoverable_ratio"] == 0.75
    assert not b["gt_available"] and b["attrition_counts"] == {} and b["native_object_count"] == 0 and rows["slide_b"].dominant_loss_stage is None
    empty = B.summary(B.tree_facts(spark, tree)[0].limit(0))
    assert (empty["slide_count"], empty["gt_coverage_notice"], empty["native_area_ratio_mean"], empty["dominant_loss_stage"]) == (0, "no_gt_backed_slides", 0.0, None)


def test_dominant_stage_without_attrition(spark):
    oracle = spark.createDataFrame([("s", "01", 0.9), ("s", "02", 0.5), ("s", "03", 0.1), ("t", "01", 0.2), ("t", "02", 0.2)], "slide string, stage string, recoverable_ratio double")
    assert {r.slide: r.dominant_loss_stage for r in R.dominant_stage(oracle, None, "slide").collect()} == {"s": "02", "t": "01"}


def test_ground_truth(spark, tmp_path):
    put(tmp_path / "a.gt.json", {"objects": [{"id": "x", "kind": "box", "bbox": [0, 1, 2, 3]}, {"id": "y", "object_type": "arrow", "kind": "line", "bbox": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}, "attachments": ["x"]}]})
    put(tmp_path / "a.png.gt.json", {"objects": [{"id": "z", "kind": "box"}]})
    rows = A.ground_truth(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.id, r.kind, r.version) for r in rows] == [("x", "box", 1), ("y", "arrow", 1)] and tuple(rows[1].box) == (1, 2, 3, 4) and rows[1].attachment_ids == ["x"]
    put(tmp_path / "b.gt.json", {"objects": 3})
    with pytest.raises(Exception, match="no list of objects"):
        A.ground_truth(spark, str(tmp_path)).collect()


def test_writers(spark, tmp_path):
    items = spark.createDataFrame([(1, "a", "01_geometry_raw"), (1, "b", "07_emit")], "slide_id long, id string, stage string")
    A.write_stage_items(items, f"{tmp_path}/items")
    assert spark.read.json(f"{tmp_path}/items").count() == 2
    assert A.write_tables(f"{tmp_path}/t", "none", items=items) == {} and spark.read.json(A.write_tables(f"{tmp_path}/t", items=items)["items"]).count() == 2
    gone = A.evaluation_or_reason(items, items.limit(0)).first()
    assert (gone.status, gone.reason, gone.rows) == ("unavailable", "ground_truth_missing", None) and len(A.evaluation_or_reason(items, items).first().rows) == 2
    assert json.loads(A.serialised(items.where("id = 'a'")).first().json) == {"slide_id": 1, "id": "a", "stage": "01_geometry_raw"}
