"""Scene assembly (GEO-29, JN-8..10, WN-3, WN-4, WN-14, PRJ-5..17, SET-3, EXT-5..11) and scene differences (JN-18, SET-1, SET-2, AG-25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kinds as K
from ..functions import scores as S
from . import spatial


def ports(owners: DataFrame) -> DataFrame:
    """Four ports of each owner (slide_id, id, owner_kind, box, confidence), at the middle of its sides."""
    at = owners.select("slide_id", F.col("id").alias("owner_id"), "owner_kind", F.explode(G.side_midpoints(F.col("box"))).alias("p"), "confidence")
    return at.select("slide_id", F.concat("owner_id", F.lit(":port:"), "p.side").alias("id"), "owner_id", "owner_kind", "p.side", "p.point", "confidence")


def port_ids(found: DataFrame) -> DataFrame:
    """Per owner its port ids; owners without ports come in with a left join."""
    return found.groupBy("slide_id", "owner_id").agg(F.array_sort(F.collect_list("id")).alias("port_ids"))


def end_points(evidence: DataFrame) -> DataFrame:
    """Two rows of each evidence (slide_id, id, orientation, a, b, confidence, near_a, near_b, near_containers)."""
    ends = F.array(F.struct(F.lit("start").alias("end"), F.col("a.x").alias("x"), F.col("a.y").alias("y"), F.col("near_a").alias("near")), F.struct(F.lit("end").alias("end"), F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.col("near_b").alias("near")))
    return evidence.select("slide_id", F.col("id").alias("evidence_id"), "orientation", F.explode(ends).alias("e"), "near_containers").select("slide_id", "evidence_id", "orientation", "e.end", "e.x", "e.y", "e.near", "near_containers")


def rank_ports(evidence: DataFrame, found: DataFrame, reach: float = 28.0) -> DataFrame:
    """Ports in reach of each end by (score, distance, id), with their rank."""
    score = F.col("gap") + S.side_penalty(F.col("orientation"), F.col("side")) + S.owner_penalty(F.col("owner_kind")) - S.owner_bonus(F.col("owner_id"), F.col("near"), F.col("near_containers"))
    rows = spatial.ports_in_reach(end_points(evidence), found, reach).withColumn("score", score)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("slide_id", "evidence_id", "end").orderBy("score", "gap", "port_id")))


def attach(evidence: DataFrame, found: DataFrame, reach: float = 28.0, top: int = 4) -> DataFrame:
    """The cheapest pair of ports of two owners among the first `top` of each end; the earlier ranks win ties. No row for evidence without a pair."""
    ranked = rank_ports(evidence, found, reach).where(F.col("rank") <= top)
    side = lambda end: ranked.where(F.col("end") == end).select("slide_id", "evidence_id", F.struct("port_id", "owner_id", "owner_kind", "side", "gap", "score", "rank", "port_confidence").alias(end))
    pairs = side("start").join(side("end"), ["slide_id", "evidence_id"]).where("start.owner_id <> end.owner_id").withColumn("cost", F.col("start.score") + F.col("end.score"))
    first = Window.partitionBy("slide_id", "evidence_id").orderBy("cost", "start.rank", "end.rank")
    best = pairs.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    confident = lambda end: S.attachment(F.col(f"{end}.port_confidence"), F.col(f"{end}.gap"))
    rows = best.join(evidence.select("slide_id", F.col("id").alias("evidence_id"), F.col("confidence").alias("evidence_confidence")), ["slide_id", "evidence_id"])
    return rows.withColumn("confidence", S.candidate(F.col("evidence_confidence"), confident("start"), confident("end")))


def unattached(evidence: DataFrame, found: DataFrame, attached: DataFrame, reach: float = 28.0) -> DataFrame:
    """Evidence without a pair: why, and up to three port ids of each end, distinct in order."""
    rest = evidence.join(attached.select("slide_id", F.col("evidence_id").alias("id")), ["slide_id", "id"], "left_anti")
    ranked = rank_ports(rest, found, reach)
    ids = lambda end: F.transform(F.sort_array(F.collect_list(F.when((F.col("end") == end) & (F.col("rank") <= 3), F.struct("rank", "port_id")))), lambda p: p["port_id"])
    seen = ranked.groupBy("slide_id", F.col("evidence_id").alias("id")).agg(F.count(F.when(F.col("end") == "start", 1)).alias("n_start"), F.count(F.when(F.col("end") == "end", 1)).alias("n_end"), F.array_distinct(F.concat(ids("start"), ids("end"))).alias("candidate_port_ids"))
    rows = rest.select("slide_id", "id").join(seen, ["slide_id", "id"], "left").na.fill(0, ["n_start", "n_end"])
    return rows.select("slide_id", F.col("id").alias("evidence_id"), S.failure_reason(F.col("n_start"), F.col("n_end")).alias("reason"), F.coalesce("candidate_port_ids", F.array().cast("array<string>")).alias("candidate_port_ids"))


def resolve(found: DataFrame) -> DataFrame:
    """Solved connectors: candidates between two owners, their ids with the other prefix."""
    return found.where("start.owner_id <> end.owner_id").withColumn("id", K.replace_prefix(F.col("id"), "connector_candidate:", "connector:"))


def text_owners(texts: DataFrame, nodes: DataFrame, containers: DataFrame) -> DataFrame:
    """Owners of each text: all nodes that list or touch it; and, of the first instance with any hit, the containers that touch it if none of its nodes does."""
    t = texts.select("slide_id", F.col("id").alias("text_id"), F.col("box").alias("text_box"))
    n = t.join(nodes.select("slide_id", "instance", F.col("id").alias("owner_id"), "box", "text_ids", "ord"), "slide_id").where(F.array_contains("text_ids", F.col("text_id")) | spatial.touches(F.col("box"), F.col("text_box")))
    c = t.join(containers.select("slide_id", "instance", F.col("id").alias("owner_id"), "box", "ord"), "slide_id").where(spatial.touches(F.col("box"), F.col("text_box")))
    hits = n.select("slide_id", "text_id", "instance", F.lit(0).alias("level"), "ord", "owner_id").union(c.select("slide_id", "text_id", "instance", F.lit(1).alias("level"), "ord", "owner_id"))
    first = hits.groupBy("slide_id", "text_id").agg(F.min(F.struct("instance", "level")).alias("f"))
    kept = hits.join(first, ["slide_id", "text_id"]).where("level = 0 or (instance = f.instance and f.level = 1)")
    owners = kept.groupBy("slide_id", "text_id").agg(F.sort_array(F.collect_list(F.struct("instance", "level", "ord", "owner_id"))).alias("o"))
    return owners.select("slide_id", "text_id", F.array_distinct(F.transform("o", lambda x: x["owner_id"])).alias("owner_ids"))


def nodes_of(proposals: DataFrame, contours: DataFrame, texts: DataFrame) -> DataFrame:
    """Nodes of each proposal (slide_id, id, box): its contours; else one a text; else one inset in the proposal. `contours` and `texts` carry proposal_id."""
    keys = ["slide_id", "proposal_id"]
    p = proposals.select("slide_id", F.col("id").alias("proposal_id"), F.col("box").alias("focus"))
    near = contours.select(*keys, F.col("id").alias("c"), F.col("box").alias("contour")).join(texts.select(*keys, F.col("id").alias("t"), F.col("box").alias("tb"), "text", "ord"), keys).where(spatial.touches(F.col("contour"), F.col("tb")))
    hits = near.groupBy(*keys, F.col("c").alias("id")).agg(F.sort_array(F.collect_list(F.struct("ord", "t", "text"))).alias("h"))
    a = contours.select(*keys, "id", "box").join(hits, [*keys, "id"], "left")
    some = F.coalesce(F.size("h"), F.lit(0)) > 0
    label = F.nullif(F.array_join(F.filter(F.transform("h", lambda h: h["text"]), lambda x: x != ""), "\n"), F.lit(""))
    a = a.select(*keys, "box", F.when(some, F.lit(0.82)).otherwise(F.lit(0.58)).alias("confidence"), label.alias("label"), F.coalesce(F.transform("h", lambda h: h["t"]), F.array().cast("array<string>")).alias("text_ids"), F.lit("contour").alias("source"))
    b = texts.join(contours.select(*keys).distinct(), keys, "left_anti").select(*keys, G.expand(F.col("box"), 10.0).alias("box"), F.lit(0.62).alias("confidence"), F.col("text").alias("label"), F.array("id").alias("text_ids"), F.lit("text_anchor").alias("source"))
    margin = F.least(F.lit(6.0), F.least(G.width(F.col("focus")), G.height(F.col("focus"))) / 10.0)
    c = p.join(contours.select(*keys), keys, "left_anti").join(texts.select(*keys), keys, "left_anti").select(*keys, G.inset(F.col("focus"), margin).alias("box"), F.lit(0.34).alias("confidence"), F.lit(None).cast("string").alias("label"), F.array().cast("array<string>").alias("text_ids"), F.lit("proposal").alias("source"))
    rows = a.unionByName(b).unionByName(c)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("box.y0", "box.x0", "box.y1", "box.x1", "text_ids"))
    return rows.withColumn("n", n).withColumn("id", F.concat("proposal_id", F.lit(":node:"), F.col("n").cast("string")))


def containers_of(proposals: DataFrame, nodes: DataFrame) -> DataFrame:
    """A container for a proposal with two nodes, or one much larger than its nodes."""
    keys = ["slide_id", "proposal_id"]
    p = proposals.select("slide_id", F.col("id").alias("proposal_id"), F.col("box").alias("focus"))
    seen = nodes.groupBy(*keys).agg(G.union_box(F.col("box")).alias("around"), F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("member_ids"))
    rows = p.join(seen, keys).where((F.col("n") >= 2) | (G.area(F.col("focus")) > G.area(F.col("around")) * F.lit(1.12)))
    return rows.select(*keys, F.concat("proposal_id", F.lit(":container:1")).alias("id"), F.col("focus").alias("box"), S.container(F.col("n")).alias("confidence"), "member_ids")


def residual_regions(slides: DataFrame, instances: DataFrame, preserve: bool = True) -> DataFrame:
    """One unresolved region over each slide without any instance, unless switched off."""
    rows = slides.join(instances.select("slide_id").distinct(), "slide_id", "left_anti").where(F.lit(preserve))
    return rows.select("slide_id", F.lit("residual:1").alias("id"), F.lit("unresolved").alias("kind"), G.full_extent(F.col("width"), F.col("height")).alias("box"))


def residuals(raster: DataFrame, unresolved: DataFrame) -> DataFrame:
    kind = F.when(F.col("kind") == "non_diagram", "non_diagram").otherwise("raster")
    return raster.select("slide_id", "id", kind.alias("kind"), "box").union(unresolved.select("slide_id", "id", "kind", "box"))


def emit(containers: DataFrame, nodes: DataFrame, texts: DataFrame, connectors: DataFrame, rest: DataFrame) -> DataFrame:
    """Output records of a scene: containers before nodes, then texts, connectors and residuals; path is set for connectors only."""
    none = F.lit(None).cast(f"array<{G.POINT}>")
    boxed = lambda df, element, level: df.select("slide_id", "id", F.lit(element).alias("element"), F.lit(level).alias("level"), F.col("box"), none.alias("path"))
    lines = connectors.select("slide_id", "id", F.lit("connector").alias("element"), F.lit(3).alias("level"), G.path_box(F.col("path")).alias("box"), "path")
    return boxed(containers, "shape", 0).unionByName(boxed(nodes, "shape", 1)).unionByName(boxed(texts, "text", 2)).unionByName(lines).unionByName(boxed(rest, "residual", 4))


def diff(expected: DataFrame, actual: DataFrame, value: str = "box") -> DataFrame:
    """Full comparison by (slide_id, element, id): missing, extra or mismatch (exact), equal."""
    a = expected.select("slide_id", "element", "id", F.col(value).alias("a"), F.lit(True).alias("in_a"))
    b = actual.select("slide_id", "element", "id", F.col(value).alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, ["slide_id", "element", "id"], "full_outer")
    outcome = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "mismatch").otherwise("equal")
    return both.select("slide_id", "element", "id", outcome.alias("outcome"))


def diff_summary(rows: DataFrame) -> DataFrame:
    """One row a slide: counts and sorted ids of each outcome, and whether nothing was lost."""
    ids = lambda o: F.array_sort(F.collect_list(F.when(F.col("outcome") == o, F.concat_ws("/", "element", "id"))))
    found = rows.groupBy("slide_id").agg(*(ids(o).alias(f"{o}_ids") for o in ("missing", "extra", "mismatch")), F.count("*").alias("n"))
    return found.withColumn("lossless", (F.size("missing_ids") == 0) & (F.size("extra_ids") == 0) & (F.size("mismatch_ids") == 0))


def diff_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("element", "outcome").agg(F.count("*").alias("n"))


def overlay_rows(rows: DataFrame, geometry: DataFrame) -> DataFrame:
    """Geometry of the records that differ (a semi join)."""
    return geometry.join(rows.where("outcome <> 'equal'").select("slide_id", "element", "id"), ["slide_id", "element", "id"], "left_semi")


def documents(scene: DataFrame) -> DataFrame:
    """One nested document a slide, records in emission order."""
    row = F.struct("level", "id", "element", "box")
    return scene.groupBy("slide_id").agg(F.sort_array(F.collect_list(row)).alias("records"))


def stage_summary(**stages: DataFrame) -> DataFrame:
    """Rows of each named stage by slide."""
    parts = [df.groupBy("slide_id").agg(F.count("*").alias("n")).withColumn("stage", F.lit(name)) for name, df in stages.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
