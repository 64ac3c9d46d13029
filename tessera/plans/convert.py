"""From pictures to scenes: the stages of scene building, one after another, as DataFrames of all slides at once (EXT-1..11, FLT-1, FLT-4, FLT-5, PRJ-2..4, PRJ-18, PRJ-19).

A family is a pair of functions: detect (components, texts, slides) -> proposals and parse (proposals, contours, texts) -> nodes, containers. `FAMILIES` is the registry.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpointed
from ..functions import geometry as G
from ..functions import kinds as K
from ..functions import scores as S
from ..operators import boxes, pixels, scene, spatial


@dataclass(frozen=True)
class Family:
    detect: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
    parse: Callable[[DataFrame, DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def detect_flow(components: DataFrame, texts: DataFrame, slides: DataFrame) -> DataFrame:
    """A proposal for each ink component, in reading order: its box and the texts around, within the slide."""
    margin = F.greatest(F.lit(6.0), F.least("width", "height") / 32)
    c = boxes.numbered(components.join(slides, "slide_id"), "family:orthogonal_flow:", boxes.reading_order()).withColumn("outer", G.expand(F.col("box"), margin))
    t = texts.select("slide_id", F.col("box").alias("text_box"))
    near = c.select("slide_id", "id", "outer").join(t, "slide_id").where(spatial.touches(F.col("outer"), F.col("text_box"))).groupBy("slide_id", "id").agg(G.union_box(F.col("text_box")).alias("around"), F.count("*").alias("n_texts"))
    rows = c.join(near, ["slide_id", "id"], "left").withColumn("n_texts", F.coalesce("n_texts", F.lit(0)))
    edge = lambda f, k: F.coalesce(f(F.col(f"outer.{k}"), F.col(f"around.{k}")), F.col(f"outer.{k}"))
    focus = G.box(edge(F.least, "x0"), edge(F.least, "y0"), edge(F.greatest, "x1"), edge(F.greatest, "y1"))
    share = G.area(F.col("box")) / F.greatest(F.lit(1.0), F.col("width") * F.col("height"))
    return rows.select("slide_id", "id", F.lit("orthogonal_flow").alias("family"), G.clip(focus, G.full_extent(F.col("width").cast("double"), F.col("height").cast("double"))).alias("box"), S.proposal(share, F.col("n_texts")).alias("confidence"))


def parse_flow(proposals: DataFrame, contours: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and containers; contours and texts go to the proposals whose focus they touch."""
    p = proposals.select("slide_id", F.col("id").alias("proposal_id"), F.col("box").alias("focus"))
    inner = lambda df: df.join(p, "slide_id").where(spatial.touches(F.col("focus"), F.col("box"))).drop("focus")
    smaller = contours.join(p, "slide_id").where(G.contains(F.col("focus"), F.col("box")) & (G.area(F.col("box")) >= F.lit(0.035) * G.area(F.col("focus"))) & (G.area(F.col("box")) < F.lit(0.96) * G.area(F.col("focus"))))
    kept = boxes.drop_parents(boxes.suppress(smaller.select("slide_id", "proposal_id", "id", "ord", "box"), ["slide_id", "proposal_id"]), ["slide_id", "proposal_id"])
    nodes = scene.nodes_of(proposals, kept, inner(texts))
    return nodes, scene.containers_of(proposals, nodes)


FAMILIES = {"orthogonal_flow": Family(detect_flow, parse_flow)}


def enabled(families: list[str] | None) -> dict[str, Family]:
    """Registered families on the allow-list; None allows all."""
    return {k: f for k, f in FAMILIES.items() if families is None or k in families}


def evidence(segments: DataFrame, nodes: DataFrame, containers: DataFrame, hints: DataFrame) -> DataFrame:
    """Connector evidence: axis-parallel segments that join two places, with what is near their ends, one of each grid key, numbered in reading order."""
    s = segments.withColumn("orientation", G.orientation(F.col("a"), F.col("b"))).where(F.col("orientation").isin("horizontal", "vertical"))
    none = F.array().cast("array<string>")
    for p in ("a", "b"):
        ends = s.select("slide_id", "id", F.col(f"{p}.x").alias("x"), F.col(f"{p}.y").alias("y"))
        near = spatial.nearby_nodes(ends, nodes).withColumnRenamed("node_ids", f"near_{p}")
        tips = spatial.near_hints(ends, hints).select("slide_id", "id", F.lit(True).alias(f"arrow_{p}"))
        s = s.join(near, ["slide_id", "id"], "left").join(tips, ["slide_id", "id"], "left").withColumn(f"near_{p}", F.coalesce(f"near_{p}", none)).withColumn(f"arrow_{p}", F.coalesce(f"arrow_{p}", F.lit(False)))
    s = s.withColumn("box", G.segment_box(F.col("a"), F.col("b")))
    held = spatial.nearby_containers(s, containers).withColumnRenamed("container_ids", "near_containers")
    middle = s.select("slide_id", "id", G.point((F.col("a.x") + F.col("b.x")) / 2, (F.col("a.y") + F.col("b.y")) / 2).alias("m"))
    inside = middle.join(nodes.select("slide_id", F.col("box").alias("node_box")), "slide_id").where(G.contains_point(F.col("node_box"), F.col("m"))).select("slide_id", "id", F.lit(True).alias("inside")).distinct()
    s = s.join(held, ["slide_id", "id"], "left").join(inside, ["slide_id", "id"], "left").withColumn("near_containers", F.coalesce("near_containers", none))
    both = (F.size("near_a") > 0) & (F.size("near_b") > 0) & K.same_set(F.col("near_a"), F.col("near_b"))
    alone = F.coalesce("inside", F.lit(False)) & (F.size(F.array_union("near_a", "near_b")) <= 1)
    length = G.distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
    arrow = F.col("arrow_a") | F.col("arrow_b")
    s = s.where(~both & ~alone).withColumn("confidence", S.evidence(length, F.size("near_a") > 0, F.size("near_b") > 0, arrow)).withColumn("kind", S.evidence_kind(F.col("arrow_a"), F.col("arrow_b")))
    return boxes.numbered(boxes.dedupe_segments(s).drop("key"), "connector_evidence:", [*boxes.reading_order(), "ord"])


def convert(pictures: DataFrame, families: list[str] | None = None, preserve: bool = True) -> dict[str, DataFrame]:
    """All stages of `pictures` (slide_id, height, width, pixels), by name. Stages that several others read are checkpointed, which keeps plans small."""
    slides = pictures.select("slide_id", "width", "height")
    found = pixels.regions(pictures).withColumn("box", G.box("x0", "y0", "x1", "y1")).withColumn("ord", F.col("n")).withColumn("id", F.concat("layer", F.lit(":"), F.col("n").cast("string")))
    found = checkpointed(found)  # every later stage reads it
    layer = lambda name: found.where(F.col("layer") == name)
    texts = layer("text").select("slide_id", "id", "ord", "box", "confidence", "role", F.lit(None).cast("string").alias("text"))
    raster = layer("picture").select("slide_id", "id", "ord", "box", "confidence", F.lit("photo_like").alias("kind"))
    made = [(checkpointed(f.detect(layer("component").select("slide_id", "box"), texts, slides)), f) for f in enabled(families).values()]
    none = f"slide_id long, id string, family string, box {G.BOX}, confidence double"
    proposals = reduce(DataFrame.unionByName, [p for p, _ in made]) if made else slides.sparkSession.createDataFrame([], none)
    parsed = [f.parse(p, layer("node").select("slide_id", "id", "ord", "box"), texts) for p, f in made]
    empty = parse_flow(proposals, layer("node").select("slide_id", "id", "ord", "box").limit(0), texts.limit(0)) if not parsed else None
    nodes, containers = ([reduce(DataFrame.unionByName, side) for side in zip(*parsed, strict=True)] if parsed else empty)
    nodes, containers = checkpointed(nodes), checkpointed(containers)
    line = layer("segment").select("slide_id", "id", "ord", G.point(F.col("x0"), F.col("y0")).alias("a"), G.point(F.col("x1") - 1, F.col("y1") - 1).alias("b"))
    e = evidence(line, nodes, containers, layer("hint").select("slide_id", F.col("x0").alias("x"), F.col("y0").alias("y")))
    e = checkpointed(e)
    owner = lambda df, kind: df.select("slide_id", "id", F.lit(kind).alias("owner_kind"), "box", "confidence")
    ports = scene.ports(owner(nodes, "node").unionByName(owner(containers, "container")))
    tied = boxes.numbered(scene.attach(e, ports), "connector_candidate:", ["evidence_id"])
    tied = checkpointed(tied)
    loose = scene.unattached(e, ports, tied)
    paths = e.select("slide_id", F.col("id").alias("evidence_id"), F.array("a", "b").alias("path"), "kind")
    connectors = scene.resolve(tied).join(paths, ["slide_id", "evidence_id"])
    instance = lambda df: df.withColumn("instance", F.element_at(F.split("proposal_id", ":"), -1).cast("int")).withColumn("ord", F.element_at(F.split("id", ":"), -1).cast("int"))
    owners = scene.text_owners(texts, instance(nodes), instance(containers))
    rest = scene.residuals(raster, scene.residual_regions(slides, nodes, preserve))
    emitted = scene.emit(containers, nodes, texts, connectors, rest)
    return {"texts": texts, "raster": raster, "proposals": proposals, "nodes": nodes, "containers": containers, "evidence": e, "ports": ports, "candidates": tied, "unattached": loose, "connectors": connectors, "text_owners": owners, "residuals": rest, "emitted": emitted}


def summary(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows of each stage and slide."""
    return scene.stage_summary(**stages)
