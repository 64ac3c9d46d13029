"""The benchmark report (AG-15, AG-17, AG-21, AG-22, SNK-6, SNK-7): one table of facts per slide, from which the summary and the slide rows follow.

A fact is (slide, section, a, b, c, d, n, ord): a number under a path of up to four keys in a section of the report; ord tells which came first. The summary
sums facts over slides, so all sections take one aggregate, combined before its shuffle; what is left is bounded by the labels in use (stages, kinds, buckets, tags).
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import artifacts as A
from . import rollup as R

KEYS = ("a", "b", "c", "d")
COUNTERS = ("native_object_count", "raster_region_count", "dropped_hypothesis_count", "grow_fallback_count")
RATIOS = ("native_area_ratio", "raster_area_ratio", "raster_native_overlap_area_ratio")
MOTIF_COUNTERS = ("proposed", "accepted", "rejected", "absorbed_members", "suppressed_members")
#: Section of a flat bucket counter by its stage and field; the counters by kind that are summed (fixed names of the report).
BUCKET_SECTIONS = {
    ("05_selection", "selected_count_by_source_bucket"): "selection_count_by_source_bucket", ("07_emit", "native_count_by_source_bucket"): "native_emit_count_by_source_bucket",
    ("07_emit", "matched_gt_by_source_bucket"): "final_matched_gt_by_source_bucket",
}
BUCKET_FIELDS = (
    ("03_objects", "count_by_source_bucket_by_kind"), ("03_objects", "recoverable_gt_by_source_bucket_by_kind"), ("05_selection", "selected_count_by_source_bucket_by_kind"),
    ("07_emit", "native_count_by_source_bucket_by_kind"), ("07_emit", "matched_gt_by_source_bucket_by_kind"),
)


def fact(df: DataFrame, section: str | Column, *keys: str | Column, n: Column | None = None, order: str | None = None) -> DataFrame:
    """Facts from rows with a slide; keys are columns, or names of columns."""
    path = [F.col(k) if isinstance(k, str) else k for k in keys] + [F.lit(None)] * (len(KEYS) - len(keys))
    value = (F.lit(1) if n is None else n).cast("double")
    name = F.lit(section) if isinstance(section, str) else section
    return df.select("slide", name.alias("section"), *(p.cast("string").alias(k) for k, p in zip(KEYS, path, strict=True)), value.alias("n"), (F.col(order) if order else F.lit(None)).cast("long").alias("ord"))


def facts(slides: DataFrame, stages: DataFrame, kinds: DataFrame, sources: DataFrame, lost: DataFrame, tags: DataFrame, status: DataFrame, snaps: DataFrame, motifs: DataFrame, attribution: DataFrame) -> DataFrame:
    """All facts. slides: slide, gt_available, grow, motifs, COUNTERS, RATIOS; stages: stage, recoverable_count, ground_truth_count; kinds: the same by kind; sources: stage, bucket, n;
    lost: lost_at, ord; tags: side, kind, tag; status: kind, status; snaps: effect, n; motifs: family, counter, n; attribution: stage, field, kind, bucket, n."""
    unknown = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    both = ("recoverable_count", "ground_truth_count")
    fields = F.create_map(*(x for (stage, field), name in BUCKET_SECTIONS.items() for x in (F.lit(f"{stage}/{field}"), F.lit(name))))
    place = F.concat_ws("/", "stage", "field")
    deep = attribution.where(place.isin([f"{s}/{f}" for s, f in BUCKET_FIELDS]) & F.col("kind").isNotNull())
    parts = [
        fact(slides, "slides", F.when(F.col("gt_available"), "gt_backed_slide_count").otherwise("gt_unavailable_slide_count")),
        fact(slides, "ablation_counts", R.ablation(F.col("grow"), F.col("motifs"))),
        *(fact(slides, "counts", F.lit(c), n=F.coalesce(F.col(c), F.lit(0))) for c in COUNTERS),
        *(fact(slides, "area", F.lit(c), n=F.coalesce(F.col(c), F.lit(0.0))) for c in RATIOS),
        *(fact(stages, "stage_oracle", "stage", F.lit(c), n=F.coalesce(F.col(c), F.lit(0))) for c in both),
        *(fact(kinds, "stage_oracle_by_kind", "stage", "kind", F.lit(c), n=F.coalesce(F.col(c), F.lit(0))) for c in both),
        fact(sources, "stage_oracle_by_source_bucket", "stage", "bucket", n=F.col("n")),
        fact(lost.where("lost_at <> ''"), "stage_attrition", "lost_at", order="ord"),
        fact(tags, "failure_taxonomy", "side", unknown("tag")),
        fact(tags, "failure_taxonomy_by_kind", "side", unknown("kind"), unknown("tag")),
        fact(status, "geometry_audit_status_counts", unknown("status")),
        fact(status, "geometry_audit_status_counts_by_kind", unknown("kind"), unknown("status")),
        fact(snaps, "container_snap_effect_counts", "effect", n=F.col("n")),
        # five sums a family, 0 where a counter is missing
        *(fact(motifs, "motif_accounting", "family", F.lit(c), n=F.when(F.col("counter") == c, F.col("n")).otherwise(0)) for c in MOTIF_COUNTERS),
        fact(attribution.where(F.col("kind").isNull() & fields[place].isNotNull()), fields[place], "bucket", n=F.col("n")),
        fact(deep, "source_bucket_counts_by_kind", "stage", "field", "kind", "bucket", n=F.col("n")),
    ]
    return reduce(DataFrame.union, parts)


def totals(found: DataFrame) -> DataFrame:
    """Facts summed over slides."""
    first = F.min(F.when(F.col("ord").isNotNull(), F.struct("slide", "ord"))).alias("first")
    return found.groupBy("section", *KEYS).agg(F.sum("n").alias("n"), first)


def summary_rows(found: DataFrame) -> DataFrame:
    """The whole summary as rows (section, a, b, c, d, n, text): sums, ratios, means, the coverage notice and the dominant stage."""
    sums = totals(found)
    plain = sums.where("section not in ('slides', 'area')").select("section", *KEYS, "n", F.lit(None).cast("string").alias("text"))
    null = lambda k: F.lit(None).cast("string").alias(k)
    stages = sums.where("section = 'stage_oracle'").groupBy("a").agg(*(F.max(F.when(F.col("b") == c, F.col("n"))).alias(c) for c in ("recoverable_count", "ground_truth_count")))
    ratios = stages.select(F.col("a").alias("stage"), R.ratio(F.col("recoverable_count"), F.col("ground_truth_count")).alias("recoverable_ratio"))
    kinds = sums.where("section = 'stage_oracle_by_kind'").groupBy("a", "b").agg(*(F.max(F.when(F.col("c") == c, F.col("n"))).alias(c) for c in ("recoverable_count", "ground_truth_count")))
    kinds = kinds.select(F.lit("stage_oracle_by_kind").alias("section"), "a", "b", F.lit("recoverable_ratio").alias("c"), null("d"), R.ratio(F.col("recoverable_count"), F.col("ground_truth_count")).alias("n"), null("text"))
    shares = ratios.select(F.lit("stage_oracle").alias("section"), F.col("stage").alias("a"), F.lit("recoverable_ratio").alias("b"), null("c"), null("d"), F.col("recoverable_ratio").alias("n"), null("text"))
    # one row of slide counts, even without slides
    number = lambda k: F.coalesce(F.sum(F.when((F.col("section") == "slides") & (F.col("a") == k), F.col("n"))), F.lit(0.0))
    total = lambda k: F.coalesce(F.sum(F.when((F.col("section") == "area") & (F.col("a") == k), F.col("n"))), F.lit(0.0))
    one = sums.agg(number("gt_backed_slide_count").alias("backed"), number("gt_unavailable_slide_count").alias("gone"), *(total(c).alias(c) for c in RATIOS))
    slides = F.col("backed") + F.col("gone")
    cells = [("gt_backed_slide_count", F.col("backed"), F.lit(None)), ("gt_unavailable_slide_count", F.col("gone"), F.lit(None)), ("slide_count", slides, F.lit(None)), ("gt_coverage_notice", F.lit(None), R.coverage_notice(F.col("backed")))]
    cells += [(f"{c}_mean", R.ratio(F.col(c), slides), F.lit(None)) for c in RATIOS]
    single = one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("section"), n.cast("double").alias("n"), text.cast("string").alias("text")) for name, n, text in cells))).alias("x"))
    single = single.select("x.section", *(null(k) for k in KEYS), "x.n", "x.text")
    lost = sums.where("section = 'stage_attrition'")
    places = lost.crossJoin(F.broadcast(lost.agg(F.array_sort(F.collect_set("first")).alias("order"))))  # bounded by the stages
    places = places.select(F.lit(0).alias("all"), F.col("a").alias("stage"), "n", F.array_position("order", F.col("first")).alias("ord"))
    dominant = R.dominant_stage(ratios.withColumn("all", F.lit(0)), places, "all")
    dominant = dominant.select(F.lit("dominant_loss_stage").alias("section"), *(null(k) for k in KEYS), F.lit(None).cast("double").alias("n"), F.col("dominant_loss_stage").alias("text"))
    return plain.union(shares).union(kinds).union(single).union(dominant)


def _fold(rows: pd.DataFrame) -> dict:
    """Rows of a report as nested objects."""
    out: dict = {}
    for section, *path, n, text in rows.sort_values(["section", *KEYS], na_position="first").itertuples(index=False, name=None):
        path = [section, *(p for p in path if isinstance(p, str))]
        at = out
        for key in path[:-1]:
            at = at.setdefault(key, {})
        at[path[-1]] = text if isinstance(text, str) else None if n is None or n != n else int(n) if float(n).is_integer() and "ratio" not in path[-1] else float(n)
    return out


def summary(found: DataFrame, root: str = "") -> dict:
    """The summary as one nested object; its rows are bounded by the labels in use."""
    out = _fold(summary_rows(found).toPandas())
    out |= out.pop("counts", {})
    out["final_matched_gt_by_kind"] = out.get("stage_oracle_by_kind", {}).get("07_emit", {})
    for name in ("stage_oracle", "stage_oracle_by_kind", "stage_oracle_by_source_bucket", "stage_attrition", "geometry_audit_status_counts", "geometry_audit_status_counts_by_kind", "container_snap_effect_counts", "ablation_counts", "motif_accounting", "source_bucket_counts_by_kind", *BUCKET_SECTIONS.values()):
        out.setdefault(name, {})
    for name in ("failure_taxonomy", "failure_taxonomy_by_kind"):
        out[name] = {"ground_truth": {}, "predictions": {}} | out.get(name, {})
    out.setdefault("dominant_loss_stage", None)
    return {"status": "ok", "benchmark_root": root, **{("grow_fallback_hypothesis_count" if k == "grow_fallback_count" else k): v for k, v in out.items()}}


def _slide(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    out = _fold(rows.assign(text=None)[["section", *KEYS, "n", "text"]])
    stages = out.setdefault("stage_oracle", {})
    for cell in (*stages.values(), *(k for s in out.get("stage_oracle_by_kind", {}).values() for k in s.values())):
        cell["recoverable_ratio"] = cell["recoverable_count"] / cell["ground_truth_count"] if cell["ground_truth_count"] else 0.0
    out["oracle_stages"] = out.pop("stage_oracle")
    out["attrition_counts"] = out.pop("stage_attrition", {})
    out |= out.pop("counts", {}) | out.pop("area", {})
    out["gt_available"] = "gt_backed_slide_count" in out.pop("slides", {})
    out.pop("ablation_counts", None)
    return pd.DataFrame([(key[0], json.dumps(out, ensure_ascii=False, sort_keys=True))], columns=["slide", "report"])


def slide_reports(found: DataFrame, slides: DataFrame) -> DataFrame:
    """One row a slide: slide, iteration, dominant_loss_stage, ablation_flags, raw motif_accounting and source_attribution where `slides` has them, and report, a JSON text of its facts.

    A slide's facts are bounded by the labels in use, like the summary's.
    """
    own = found.groupBy("slide", "section", *KEYS).agg(F.sum("n").alias("n"), F.min("ord").alias("ord"))
    reports = own.select("slide", "section", *KEYS, "n").groupBy("slide").applyInPandas(_slide, "slide string, report string")
    stages = own.where("section = 'stage_oracle'").groupBy("slide", F.col("a").alias("stage")).agg(*(F.max(F.when(F.col("b") == c, F.col("n"))).alias(c) for c in ("recoverable_count", "ground_truth_count")))
    ratios = stages.select("slide", "stage", R.ratio(F.col("recoverable_count"), F.col("ground_truth_count")).alias("recoverable_ratio"))
    lost = own.where("section = 'stage_attrition'").select("slide", F.col("a").alias("stage"), "n", "ord")
    return slides.join(R.dominant_stage(ratios, lost, "slide"), "slide", "left").join(reports, "slide", "left")


def tree_facts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(facts, slides) of an artifact tree: the latest iteration of each slide; the four evaluation files count only where the oracle's file is."""
    at = f"{root}/_diagnostics"
    latest = R.latest_iterations(A.slides(A.listing(spark, root, at)))
    read = lambda name, schema: A.files(spark, at, name, schema).join(latest, ["slide", "iteration"], "left_semi")
    manifest, oracle = read("manifest.json", A.MANIFEST), read("oracle_by_stage.json", A.ORACLE)
    judged = lambda df: df.join(oracle.select("slide"), "slide", "left_semi")
    failures = judged(read("failure_taxonomy.json", A.FAILURES))
    audit = judged(read("geometry_audit.json", A.AUDIT))
    effects = judged(read("container_geometry_audit.json", A.AUDIT)).select("slide", F.explode("snap_effect_counts").alias("effect", "n"))
    raw = manifest.select("slide", "ablation_flags", "motif_accounting", "source_attribution")
    known = oracle.select("slide", F.col("gt_available").alias("judged"))
    slides = latest.join(A.manifest_rows(manifest), "slide", "left").join(known, "slide", "left").withColumn("gt_available", F.coalesce("judged", "gt_available", F.lit(False))).drop("judged")
    kinds = A.stage_kind_rows(oracle, "recoverable_by_kind").withColumnRenamed("n", "recoverable_count").join(A.stage_kind_rows(oracle, "ground_truth_count_by_kind").withColumnRenamed("n", "ground_truth_count"), ["slide", "stage", "kind"], "full")
    sides = reduce(DataFrame.union, (A.tagged_rows(failures, s).select("slide", F.lit(s).alias("side"), "kind", "tag") for s in ("ground_truth", "predictions")))
    lost = A.lost_rows(judged(read("attrition_by_stage.json", A.ATTRITION)))
    found = facts(slides, A.stage_rows(oracle), kinds, A.stage_kind_rows(oracle, "recoverable_by_source_bucket").withColumnRenamed("kind", "bucket"), lost, sides, A.status_rows(audit), effects, A.motif_rows(manifest), A.attribution_rows(manifest))
    return found, slides.join(raw, "slide", "left")


def write_summary(spark: SparkSession, root: str, to: str) -> dict:
    """Writes `benchmark_stage_summary` (one JSON object) and `benchmark_stage_rollup` (JSON lines, one a slide) below `to`; gives the summary."""
    found, slides = tree_facts(spark, root)
    whole = summary(found, root)
    spark.createDataFrame([(json.dumps(whole, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{to}/benchmark_stage_summary")
    slide_reports(found, slides).write.mode("overwrite").json(f"{to}/benchmark_stage_rollup")
    return whole


def summary_line(whole: dict) -> str:
    """The one-line text of a summary."""
    kinds = whole["final_matched_gt_by_kind"]
    matched = lambda k: f"matched_{k}={float(kinds.get(k, {}).get('recoverable_count', 0)):.0f}"
    shown = {"slides": "slide_count", "gt_backed": "gt_backed_slide_count", "gt_unavailable": "gt_unavailable_slide_count", "gt_notice": "gt_coverage_notice", "dominant_loss_stage": "dominant_loss_stage"}
    return " ".join([*(f"{name}={whole.get(key)}" for name, key in shown.items()), matched("container"), matched("connector"), f"native={whole.get('native_object_count', 0)}", f"raster={whole.get('raster_region_count', 0)}", f"raster_area_mean={whole.get('raster_area_ratio_mean', 0.0):.3f}"])

