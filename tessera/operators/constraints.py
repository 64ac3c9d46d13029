"""Integrity checks (VAL-1..8, JN-17). A check gives a table of violations (rule, slide_id, id); `enforce` raises on the first ones if asked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



class ContractViolation(ValueError):
    """A scene breaks a rule."""


def failing(rows: DataFrame, rule: str, holds: Column) -> DataFrame:
    """Rows where `holds` is false or null."""
    return rows.where(~F.coalesce(holds, F.lit(False))).select(F.lit(rule).alias("rule"), "slide_id", "id")


def positive_box(box: str = "box") -> Column:
    return F.col(box).isNotNull() & (F.col(f"{box}.x1") > F.col(f"{box}.x0")) & (F.col(f"{box}.y1") > F.col(f"{box}.y0"))


def unit(value: str = "confidence") -> Column:
    return F.col(value).between(0.0, 1.0)


def some(value: str) -> Column:
    return F.col(value).isNotNull() & (F.length(value) > 0)


def some_items(value: str) -> Column:
    return F.coalesce(F.size(value), F.lit(0)) > 0


def element_rules(rows: DataFrame, name: str) -> DataFrame:
    """Confidence, box, source and provenance of any record."""
    return reduce(DataFrame.union, (failing(rows, f"{name}.{rule}", holds) for rule, holds in (("confidence", unit()), ("box", positive_box()), ("source", some("source")), ("provenance", some_items("provenance")))))


def foreign_key(rows: DataFrame, key: str, targets: DataFrame, rule: str, target: str = "id") -> DataFrame:
    """Rows whose key is not among the targets of the slide."""
    known = targets.select("slide_id", F.col(target).alias("_target")).distinct()
    return rows.where(F.col(key).isNotNull()).join(known, (rows["slide_id"] == known["slide_id"]) & (rows[key] == known["_target"]), "left_anti").select(F.lit(rule).alias("rule"), "slide_id", "id")


def foreign_keys(rows: DataFrame, keys: str, targets: DataFrame, rule: str, target: str = "id") -> DataFrame:
    """The same for an array of keys; one row for each key that is unknown."""
    return foreign_key(rows.select("slide_id", "id", F.explode(keys).alias("_key")), "_key", targets, rule, target)


def unique(rows: DataFrame, rule: str, *keys: str) -> DataFrame:
    again = rows.groupBy(*(keys or ("slide_id", "id"))).agg(F.count("*").alias("n")).where("n > 1")
    return again.select(F.lit(rule).alias("rule"), "slide_id", "id")


def disjoint(a: DataFrame, b: DataFrame, rule: str) -> DataFrame:
    """Ids of a that b has too."""
    return a.join(b.select("slide_id", "id"), ["slide_id", "id"], "left_semi").select(F.lit(rule).alias("rule"), "slide_id", "id")


def mirrored(a: DataFrame, b: DataFrame, rule: str) -> DataFrame:
    """Slides whose ordered ids differ between a and b."""
    ids = lambda df, name: df.groupBy("slide_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias(name))
    both = ids(a, "a").join(ids(b, "b"), "slide_id", "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select(F.lit(rule).alias("rule"), "slide_id", F.lit(None).cast("string").alias("id"))


def bundles(planes: DataFrame, kinds: list[str]) -> DataFrame:
    """Exactly the wanted planes for each slide, all of one size, and buffers of the right length."""
    wanted = F.array_sort(F.array(*map(F.lit, kinds)))
    seen = planes.groupBy("slide_id").agg(F.array_sort(F.collect_list("kind")).alias("kinds"), F.count_distinct("height", "width").alias("sizes"))
    named = seen.withColumn("id", F.lit(None).cast("string"))
    shapes = failing(planes.withColumn("id", F.col("kind")), "bundle.shape", F.length("pixels") == F.col("height") * F.col("width") * F.col("channels"))
    return failing(named, "bundle.branches", F.col("kinds") == wanted).union(failing(named, "bundle.size", F.col("sizes") == 1)).union(shapes)


def canvas_spans(canvases: DataFrame, slides: DataFrame) -> DataFrame:
    both = slides.select("slide_id", F.col("width").alias("w"), F.col("height").alias("h")).join(canvases, "slide_id").withColumn("id", F.lit("canvas"))
    return failing(both, "canvas.size", (F.col("width") == F.col("w")) & (F.col("height") == F.col("h")))


def scene(nodes: DataFrame, containers: DataFrame, texts: DataFrame, ports: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rules of an assembled scene."""
    owners = nodes.select("slide_id", "id").union(containers.select("slide_id", "id"))
    parts = [
        element_rules(nodes, "node"), element_rules(containers, "container"), element_rules(texts, "text"),
        foreign_keys(nodes, "port_ids", ports, "node.port"), foreign_keys(containers, "port_ids", ports, "container.port"), foreign_keys(containers, "member_ids", nodes, "container.member"),
        foreign_keys(texts, "owner_ids", owners, "text.owner"), foreign_key(ports, "owner_id", owners, "port.owner"), failing(ports, "port.confidence", unit()),
        foreign_key(candidates, "start_port_id", ports, "candidate.start"), foreign_key(candidates, "end_port_id", ports, "candidate.end"), failing(candidates, "candidate.confidence", unit()),
        failing(candidates, "candidate.path", F.size("path") >= 2), unique(texts, "text.unique"), disjoint(containers, nodes, "container.collides"),
    ]
    return reduce(DataFrame.union, parts)


def proposals(rows: DataFrame, instances: DataFrame, styles: DataFrame, targets: DataFrame) -> DataFrame:
    """Family proposals have a focus and provenance; instances name a known proposal and have provenance; style tokens target known ids."""
    focus = failing(rows, "proposal.focus", F.col("focus").isNotNull())
    return reduce(DataFrame.union, [focus, failing(rows, "proposal.provenance", some_items("provenance")), foreign_key(instances, "proposal_id", rows, "instance.proposal"), failing(instances, "instance.provenance", some_items("provenance")), foreign_keys(styles, "target_ids", targets, "style.target")])


def connectors(rows: DataFrame, ports: DataFrame, nodes: DataFrame, containers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Solved connectors: path, source, provenance, known evidence; of each end a known owner of its kind and a port of that owner; two different owners."""
    parts = [failing(rows, "connector.path", F.size("path") >= 2), failing(rows, "connector.source", some("source")), failing(rows, "connector.provenance", some_items("provenance")), foreign_key(rows, "evidence_id", evidence, "connector.evidence")]
    for end in ("start", "end"):
        for kind, owners in (("node", nodes), ("container", containers)):
            parts.append(foreign_key(rows.where(F.col(f"{end}_owner_kind") == kind), f"{end}_owner_id", owners, f"connector.{end}_{kind}"))
        parts.append(foreign_key(rows, f"{end}_port_id", ports, f"connector.{end}_port"))
        owner = ports.select("slide_id", F.col("id").alias(f"{end}_port_id"), F.col("owner_id").alias("_owner"))
        parts.append(failing(rows.join(owner, ["slide_id", f"{end}_port_id"]), f"connector.{end}_port_owner", F.col("_owner") == F.col(f"{end}_owner_id")))
    parts.append(failing(rows, "connector.same_owner", F.col("start_owner_id") != F.col("end_owner_id")))
    return reduce(DataFrame.union, parts)


def unattached(rows: DataFrame, evidence: DataFrame, ports: DataFrame) -> DataFrame:
    """Evidence left unattached tells a reason, source and provenance, and names known evidence and candidate ports."""
    rules = [("reason", some("reason")), ("source", some("source")), ("provenance", some_items("provenance"))]
    return reduce(DataFrame.union, [*(failing(rows, f"unattached.{name}", holds) for name, holds in rules), foreign_key(rows, "evidence_id", evidence, "unattached.evidence"), foreign_keys(rows, "candidate_port_ids", ports, "unattached.port")])


def stage_entities(rows: DataFrame, spatial: bool = False) -> DataFrame:
    """Rules of stage artifact rows: names, maps, guide axes, assignment links, emission links and fallback tags."""
    items = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    kind = F.col("entity")
    rules = [
        ("id", some("id")), ("kind", some("kind") | some("object_type")), ("score", F.col("score_total").isNotNull()), ("score_terms", F.col("score_terms").isNotNull()), ("source_ids", F.col("source_ids").isNotNull()),
        ("provenance", F.col("provenance").isNotNull()), ("axis", (kind != "guide") | F.col("axis").isin("x", "y")),
        ("assignment", (kind != "hypothesis") | items("assigned_text_ids") | items("assigned_vlm_ids") | F.coalesce("fallback", F.lit(False))), ("hypothesis_sources", (kind != "hypothesis") | items("source_ids")),
        ("members", (kind != "motif") | items("member_ids")), ("outcome", (kind != "emission") | F.col("emitted_element_id").isNotNull() | F.col("drop_reason").isNotNull()),
        ("links", (kind != "emission") | (F.col("object_type") == "connector") | F.col("drop_reason").isNotNull() | (items("graph_node_ids") & items("hypothesis_ids"))),
        ("fallback_tag", (kind != "fallback") | ~F.coalesce(F.col("strategy") == "grow_fallback", F.lit(False)) | F.array_contains("source_ids", "grow_fallback")),
    ]
    if spatial:
        rules.append(("box", F.col("box").isNotNull()))
    return reduce(DataFrame.union, (failing(rows, f"entity.{name}", holds) for name, holds in rules))


def emission_trace(records: DataFrame, graph_nodes: DataFrame, hypotheses: DataFrame, sources: DataFrame) -> DataFrame:
    """Every emission names known graph nodes and hypotheses and, unless dropped or a connector, a known geometry or fallback source."""
    kept = records.where("drop_reason is null")
    lines = failing(kept.where("object_type = 'connector'"), "emission.provenance", (F.size("graph_node_ids") >= 1) & (F.size("hypothesis_ids") >= 1))
    shapes = kept.where("object_type <> 'connector'")
    known = sources.select("slide_id", F.col("id").alias("_source")).distinct()
    traced = shapes.select("slide_id", "id", F.explode("source_ids").alias("_source")).join(known, ["slide_id", "_source"], "left_semi").select("slide_id", "id").distinct()
    tagged = shapes.where(~F.array_contains("source_ids", "grow_fallback")).join(traced, ["slide_id", "id"], "left_anti").select(F.lit("emission.source").alias("rule"), "slide_id", "id")
    return reduce(DataFrame.union, [foreign_keys(records, "graph_node_ids", graph_nodes, "emission.graph_node"), foreign_keys(records, "hypothesis_ids", hypotheses, "emission.hypothesis"), lines, tagged])


def enforce(violations: DataFrame, shown: int = 5) -> DataFrame:
    """The table itself; raises if it isn't empty."""
    first = violations.take(shown)
    if first:
        raise ContractViolation("; ".join(f"{r['rule']}: slide {r['slide_id']}, {r['id']}" for r in first))
    return violations


