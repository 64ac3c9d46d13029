"""Queries over rules of scenes, stage entities and emissions, and over the items that evaluation takes from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kinds as K
from ..operators import adapter, attribution, matching, spatial
from ..operators import constraints as C
from ..operators import evaluation as E
from . import fixtures as X
from . import oracle as O

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str):
    def take(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return take


def ids(prefix: str, n: Column, number: Column) -> Column:
    """n ids: the prefix with number, number + 1, …"""
    return F.when(n > 0, F.transform(F.sequence(number, number + n - 1), lambda i: F.concat(F.lit(prefix), i.cast("string")))).otherwise(F.array().cast("array<string>"))


def union(rules: dict[str, str], table: str, id_: str = "id") -> str:
    """Rows of a table that break each rule."""
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, slide_id, {id_} AS id FROM {table} WHERE NOT coalesce({holds}, FALSE)" for rule, holds in rules.items())


#: Stage entities of all classes; counts stand for the lengths of their id lists.
ENTITIES = f"""
SELECT slide_id, concat('e-', CAST(ord AS STRING)) AS id, CASE p % 6 WHEN 0 THEN 'guide' WHEN 1 THEN 'hypothesis' WHEN 2 THEN 'motif' WHEN 3 THEN 'emission' WHEN 4 THEN 'fallback' ELSE 'rect' END AS entity,
  CASE WHEN p % 17 = 0 THEN '' ELSE kind END AS kind, CASE u % 3 WHEN 0 THEN 'Panel ' WHEN 1 THEN 'connector' ELSE '' END AS object_type, CASE WHEN p % 19 = 0 THEN NULL ELSE score END AS score_total,
  CASE u % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'y' WHEN 2 THEN 'z' END AS axis, p % 3 AS n_sources, u % 2 AS n_texts, (p + u) % 3 AS n_members, (p + ord) % 2 AS n_graph, (u + ord) % 2 AS n_hypotheses, p % 7 = 0 AS is_fallback,
  CASE WHEN p % 5 = 0 THEN NULL ELSE 'out' END AS emitted_element_id, CASE WHEN p % 4 = 0 THEN 'small' END AS drop_reason, CASE WHEN u % 2 = 0 THEN 'grow_fallback' ELSE 'other' END AS strategy, (u + p) % 4 = 0 AS tagged,
  p % 9 AS g, u % 7 AS h, ord % 5 AS s, p % 23 = 0 AS unboxed, x0, y0, x1, y1 FROM ({X.TRUTH}) t
"""


def entities(spark, d) -> DataFrame:
    e = X.boxed(X.frame(spark, d, ENTITIES))
    sources = F.concat(ids("s", F.col("n_sources"), F.col("s")), F.when(F.col("tagged"), F.array(F.lit("grow_fallback"))).otherwise(F.array().cast("array<string>")))
    some = F.create_map(F.lit("k"), F.lit("v"))
    return e.select(
        "*", sources.alias("source_ids"), ids("t", F.col("n_texts"), F.col("s")).alias("assigned_text_ids"), F.array().cast("array<string>").alias("assigned_vlm_ids"), F.col("is_fallback").alias("fallback"), ids("m", F.col("n_members"), F.col("s")).alias("member_ids"),
        ids("n", F.col("n_graph"), F.col("g")).alias("graph_node_ids"), ids("h", F.col("n_hypotheses"), F.col("h")).alias("hypothesis_ids"), ids("q", F.col("n_members"), F.col("s")).alias("parent_ids"), some.alias("score_terms"), some.alias("provenance"),
    ).withColumn("box", F.when(~F.col("unboxed"), F.col("box")))


ENTITY_RULES = {
    "entity.kind": "kind <> '' OR object_type <> ''", "entity.score": "score_total IS NOT NULL", "entity.axis": "entity <> 'guide' OR axis IN ('x', 'y')", "entity.assignment": "entity <> 'hypothesis' OR n_texts > 0 OR is_fallback",
    "entity.hypothesis_sources": "entity <> 'hypothesis' OR n_sources > 0 OR tagged", "entity.members": "entity <> 'motif' OR n_members > 0", "entity.outcome": "entity <> 'emission' OR emitted_element_id IS NOT NULL OR drop_reason IS NOT NULL",
    "entity.links": "entity <> 'emission' OR object_type = 'connector' OR drop_reason IS NOT NULL OR (n_graph > 0 AND n_hypotheses > 0)", "entity.fallback_tag": "entity <> 'fallback' OR strategy <> 'grow_fallback' OR tagged", "entity.box": "NOT unboxed",
}


@register(f"WITH e AS ({X.duck(ENTITIES)}) {union(ENTITY_RULES, 'e')}")
def violations_entities(spark, d):
    return C.stage_entities(entities(spark, d), spatial=True)


@register(
    f"""WITH e AS (SELECT * FROM ({X.duck(ENTITIES)}) q WHERE entity = 'emission')
SELECT 'emission.graph_node' AS rule, slide_id, id FROM e WHERE n_graph > 0 AND g > 6 UNION ALL SELECT 'emission.hypothesis', slide_id, id FROM e WHERE n_hypotheses > 0 AND h > 4
UNION ALL SELECT 'emission.provenance', slide_id, id FROM e WHERE drop_reason IS NULL AND object_type = 'connector' AND NOT (n_graph >= 1 AND n_hypotheses >= 1)
UNION ALL SELECT 'emission.source', slide_id, id FROM e WHERE drop_reason IS NULL AND object_type <> 'connector' AND NOT tagged AND NOT ((n_sources > 0 AND s < 2) OR (n_sources > 1 AND s < 1))"""
)
def violations_trace(spark, d):
    records = entities(spark, d).where("entity = 'emission'")
    slides = records.select("slide_id").distinct()
    known = lambda prefix, n: slides.select("slide_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.concat(F.lit(prefix), i.cast("string")))).alias("id"))
    return C.emission_trace(records, known("n", 6), known("h", 4), known("s", 1))


#: Nodes and containers of a scene, each with two ports; some references are broken.
PARTS = f"""
SELECT slide_id, id, ord, p, u, f, CASE WHEN ord % 4 = 0 THEN 'container' ELSE 'node' END AS part, CAST(p % 103 AS DOUBLE) / 100 AS confidence, x0, y0, CASE WHEN u % 13 = 0 THEN x0 ELSE x1 END AS x1, y1 FROM ({X.TRUTH}) t
"""


@register(
    f"""WITH t AS ({X.duck(PARTS)}), n AS (SELECT * FROM t WHERE part = 'node'), c AS (SELECT * FROM t WHERE part = 'container'), k AS (SELECT slide_id, id, p, u, f, ord FROM t WHERE u % 3 = 0)
{' UNION ALL '.join(union({f'{name}.confidence': 'confidence BETWEEN 0 AND 1', f'{name}.box': 'x1 > x0 AND y1 > y0', f'{name}.source': "f <> 'A'"}, name[0]) for name in ('node', 'container'))}
UNION ALL SELECT 'node.port', slide_id, id FROM n WHERE p % 29 = 0 UNION ALL SELECT 'container.member', slide_id, id FROM c WHERE u % 5 = 0
UNION ALL SELECT 'port.owner', slide_id, concat(id, '/b') FROM t WHERE p % 31 = 0
UNION ALL SELECT 'candidate.path', slide_id, id FROM k WHERE p % 7 = 0 UNION ALL SELECT 'candidate.end', slide_id, id FROM k WHERE p % 11 = 0
UNION ALL SELECT 'connector.path', slide_id, id FROM k WHERE p % 7 = 0 UNION ALL SELECT 'connector.source', slide_id, id FROM k WHERE f = 'A' UNION ALL SELECT 'connector.end_port', slide_id, id FROM k WHERE p % 11 = 0
UNION ALL SELECT 'connector.start_port_owner', slide_id, id FROM k WHERE p % 10 = 0 UNION ALL SELECT 'connector.end_port_owner', slide_id, id FROM k WHERE p % 11 <> 0 AND p % 5 <> 0 UNION ALL SELECT 'connector.start_node', slide_id, id FROM k WHERE p % 10 = 0
UNION ALL SELECT 'connector.end_node', slide_id, id FROM k WHERE p % 5 <> 0
UNION ALL SELECT 'connector.same_owner', slide_id, id FROM k WHERE p % 5 = 0 AND p % 10 <> 0
UNION ALL SELECT 'unattached.reason', slide_id, id FROM k WHERE p % 2 = 0 UNION ALL SELECT 'unattached.source', slide_id, id FROM k WHERE f = 'A' UNION ALL SELECT 'unattached.port', slide_id, id FROM k WHERE p % 11 = 0
UNION ALL SELECT 'proposal.focus', slide_id, id FROM c WHERE u % 4 = 0 UNION ALL SELECT 'instance.proposal', slide_id, id FROM n WHERE p % 6 = 0 UNION ALL SELECT 'style.target', slide_id, id FROM t WHERE p % 14 = 0"""
)
def violations_scene(spark, d):
    t = X.boxed(X.frame(spark, d, PARTS)).withColumn("source", F.when(F.col("f") == "A", "").otherwise(F.col("f"))).withColumn("provenance", F.array("f"))
    port = lambda side: F.concat("id", F.lit(f"/{side}"))
    broken = lambda m, bad, good: F.when(F.col("p") % m == 0, bad).otherwise(good)
    t = t.withColumn("port_ids", F.array(port("a"), F.when((F.col("p") % 29 == 0) & (F.col("part") == "node"), F.lit("none")).otherwise(port("b"))))
    nodes, containers = (t.where(F.col("part") == k) for k in ("node", "container"))
    containers = containers.withColumn("member_ids", F.when(F.col("u") % 5 == 0, F.array(F.lit("none"))).otherwise(F.array().cast("array<string>")))
    ports = t.select("slide_id", port("a").alias("id"), F.col("id").alias("owner_id"), F.lit(0.5).alias("confidence")).union(t.select("slide_id", port("b"), broken(31, F.lit("none"), F.col("id")), F.lit(0.5)))
    texts = t.limit(0).withColumn("owner_ids", F.array("id"))
    lines = t.where("u % 3 = 0").withColumn("path", F.when(F.col("p") % 7 == 0, F.array(G.point(F.col("x0"), F.col("y0")))).otherwise(F.array(G.point(F.col("x0"), F.col("y0")), G.point(F.col("x1"), F.col("y1")))))
    lines = lines.withColumn("start_port_id", port("a")).withColumn("end_port_id", broken(11, F.lit("none"), port("a"))).withColumn("confidence", F.lit(0.5)).withColumn("evidence_id", F.col("id"))
    # the start's owner is this part but for every tenth; the end's owner is this part in every fifth, an unknown node otherwise
    lines = lines.withColumn("start_owner_id", broken(10, F.lit("gone"), F.col("id"))).withColumn("end_owner_id", broken(5, F.col("id"), F.lit("lost")))
    lines = lines.withColumn("start_owner_kind", broken(10, F.lit("node"), F.col("part"))).withColumn("end_owner_kind", broken(5, F.col("part"), F.lit("node")))
    loose = lines.withColumn("reason", broken(2, F.lit(None), F.lit("far"))).withColumn("candidate_port_ids", F.array("end_port_id"))
    families = containers.withColumn("focus", F.when(F.col("u") % 4 != 0, F.col("box")))
    first = F.expr("slide_id")
    instances = nodes.withColumn("proposal_id", broken(6, F.lit("none"), F.lit(None).cast("string"))).withColumn("slide_id", first)
    styles = t.withColumn("target_ids", F.array(broken(14, F.lit("none"), F.col("id"))))
    parts = [C.scene(nodes, containers, texts, ports, lines), C.connectors(lines, ports, nodes, containers, lines), C.unattached(loose, lines, ports), C.proposals(families, instances, styles, t)]
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found


EVAL_KIND = f"CASE entity WHEN 'rect' THEN 'container' WHEN 'guide' THEN {O.eval_kind('kind')} ELSE {O.eval_kind('CASE WHEN length(object_type) > 0 THEN object_type ELSE kind END')} END"


@register(
    f"""SELECT slide_id, id, {EVAL_KIND} AS kind, concat(id, CASE WHEN n_sources > 0 THEN concat(',s', CAST(s AS STRING)) ELSE '' END, CASE WHEN n_sources > 1 THEN concat(',s', CAST(s + 1 AS STRING)) ELSE '' END, CASE WHEN tagged THEN ',grow_fallback' ELSE '' END) AS source_ids,
  CASE WHEN entity = 'emission' THEN n_graph WHEN entity = 'hypothesis' THEN n_members ELSE 0 END AS n_attached, CASE WHEN entity = 'hypothesis' AND n_members > 0 THEN concat('q', CAST(s AS STRING)) END AS parent_id, score_total AS score,
  CASE WHEN tagged THEN 'fallback_only' ELSE 'other' END AS bucket, unboxed FROM ({X.duck(ENTITIES)}) e"""
)
def eval_items(spark, d):
    rows = adapter.entity_items(entities(spark, d))
    return rows.select("slide_id", "id", "kind", F.array_join("source_ids", ",").alias("source_ids"), F.size("attachment_ids").cast("long").alias("n_attached"), "parent_id", "score", "bucket", F.col("box").isNull().alias("unboxed"))


@register(
    f"""WITH t AS ({X.duck(PARTS)}), i AS (
SELECT slide_id, id, 'container' AS kind, concat('rect-candidate:v3:', id, ',', f) AS source_ids, NULL AS parent_id, '' AS attached, x0, x1 FROM t WHERE p % 3 = 0
UNION ALL SELECT slide_id, id, 'textbox', concat('region-primitive:v3:', id, ',', f), CASE WHEN u % 2 = 0 THEN concat('o', CAST(u AS STRING)) END, '', x0, x1 FROM t WHERE p % 3 = 1
UNION ALL SELECT slide_id, id, 'connector', concat('connector-candidate:v3:', id, CASE WHEN u % 2 = 0 THEN concat(',connector-candidate:v3:c', CAST(u AS STRING)) ELSE '' END, ',connector-candidate:v3:', id, ',', f), NULL, CASE WHEN u % 5 = 0 THEN 'a' ELSE 'a,b' END, x0, x1 FROM t WHERE p % 3 = 2)
SELECT s.stage, i.*, 'geometry_only' AS bucket FROM i CROSS JOIN (VALUES ('03_objects'), ('05_selection'), ('07_emit')) AS s(stage) WHERE s.stage <> '07_emit' OR i.kind <> 'textbox'"""
)
def scene_items(spark, d):
    t = X.boxed(X.frame(spark, d, PARTS)).withColumn("source", F.col("f"))
    named = lambda c, prefix: F.when(F.col("u") % 2 == 0, F.concat(F.lit(prefix), F.col("u").cast("string"))).alias(c)
    texts = t.where("p % 3 = 1").select("*", F.array_compact(F.array(named("o", "o"))).alias("owner_ids"))
    path = F.array(G.point(F.col("x0"), F.col("y0")), G.point(F.col("x1"), F.col("y1")))
    lines = t.where("p % 3 = 2").select("*", path.alias("path"), F.lit("a").alias("source_owner_id"), F.when(F.col("u") % 5 != 0, "b").alias("target_owner_id"), named("source_candidate_id", "c"), F.col("id").alias("source_evidence_id"))
    items = adapter.scene_items(t.where("p % 3 = 0"), texts, lines)
    staged = adapter.stages_of_scene(items, items.where("kind <> 'textbox'"))
    return staged.select("stage", "slide_id", "id", "kind", F.array_join("source_ids", ",").alias("source_ids"), "parent_id", F.array_join("attachment_ids", ",").alias("attached"), "box.x0", "box.x1", "bucket")


@register(f"SELECT kind, count(*) AS n FROM (SELECT {O.eval_kind('kind')} AS kind FROM ({X.duck(X.TRUTH)}) t) q GROUP BY 1")
def count_by_kind(spark, d):
    return E.count_by_kind(X.truth(spark, d))


@register(
    f"""WITH k AS (SELECT DISTINCT {O.source_kind('kind')} AS kind FROM ({X.duck(X.TRUTH)}) t), a AS (SELECT {O.source_kind('kind')} AS kind, {O.BUCKET} AS bucket FROM ({X.duck(X.ARTIFACTS)}) t WHERE stage = '02_guides' AND ord > 5)
SELECT k.kind, b.bucket, CAST(coalesce(n, 0) AS BIGINT) AS n FROM k CROSS JOIN (VALUES {', '.join(f"('{b}')" for b in K.BUCKETS)}) AS b(bucket) LEFT JOIN (SELECT kind, bucket, count(*) AS n FROM a GROUP BY 1, 2) c ON c.kind = k.kind AND c.bucket = b.bucket"""
)
def zero_filled_buckets(spark, d):
    return attribution.filled_counts(X.artifacts(spark, d, "02_guides").where("ord > 5"), X.truth(spark, d))


@register(
    O.query(
        O.BASE, O.matched("m"),
        body=f"""SELECT o_orderkey AS slide_id, g.slide_id IS NOT NULL AS gt_available, {', '.join(f'CAST(coalesce({b}, 0) AS BIGINT) AS matched_{b}' for b in K.BUCKETS)} FROM orders LEFT JOIN (SELECT DISTINCT slide_id FROM gt) g ON g.slide_id = o_orderkey
LEFT JOIN (SELECT slide_id, {', '.join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in K.BUCKETS)} FROM m WHERE stage = '07_emit' GROUP BY 1) h ON h.slide_id = o_orderkey""",
    )
)
def manifest_merged(spark, d):
    truth = X.truth(spark, d)
    slides = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("slide_id"))
    return adapter.merged_manifest(slides, matching.stage_matches(truth, X.artifacts(spark, d)), truth)


@register(
    f"""WITH b AS (SELECT slide_id, id, x0 - 6 AS x0, y0 - 6 AS y0, x1 + 6 AS x1, y1 + 6 AS y1 FROM ({X.duck(X.TRUTH)}) t WHERE kind = 'box'), t AS ({X.duck(X.TEXTS)})
SELECT b.slide_id, b.id AS box_id, string_agg(t.id, ',' ORDER BY t.ord) AS text_ids, string_agg(t.text, chr(10) ORDER BY t.ord) FILTER (t.text <> '') AS label FROM b JOIN t ON b.slide_id = t.slide_id
WHERE {O.overlaps('b.', 't.')} OR ((t.x0 + t.x1) / 2 BETWEEN b.x0 AND b.x1 AND (t.y0 + t.y1) / 2 BETWEEN b.y0 AND b.y1) GROUP BY 1, 2"""
)
def texts_near_boxes(spark, d):
    found = spatial.texts_near(X.truth(spark, d).where("kind = 'box'"), X.texts(spark, d), 6.0)
    return found.select("slide_id", "box_id", F.array_join("text_ids", ",").alias("text_ids"), "label")


@register(
    f"""WITH t AS ({X.duck(X.TEXTS)}), s AS (SELECT o_orderkey AS slide_id, o_custkey % 17 = 0 AS bad FROM orders)
SELECT 'canvas.size' AS rule, slide_id, 'canvas' AS id FROM s WHERE bad
UNION ALL SELECT 'texts.mirror', slide_id, CAST(NULL AS VARCHAR) FROM (SELECT slide_id, bool_or(ord % 3 = 0) AS lost FROM t GROUP BY 1) q WHERE lost
UNION ALL SELECT 'text.source', slide_id, id FROM t WHERE text IS NULL"""
)
def violations_layers(spark, d):
    slides = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("slide_id"), F.lit(1200).alias("width"), F.lit(800).alias("height"), "o_custkey")
    canvases = slides.select("slide_id", "width", F.when(F.col("o_custkey") % 17 == 0, F.col("height") - 1).otherwise(F.col("height")).alias("height"))
    texts = X.texts(spark, d).withColumn("source", F.col("text")).withColumn("confidence", F.lit(0.5)).withColumn("provenance", F.array(F.lit("x")))
    return C.canvas_spans(canvases, slides).union(C.mirrored(texts, texts.where("ord % 3 <> 0"), "texts.mirror")).union(C.element_rules(texts, "text"))


@register(
    f"""SELECT slide_id, id, printf('%.4f', score) AS text, round_even(score, 4) AS reported FROM ({X.duck(X.TRUTH)}) t"""
)
def evidence_texts(spark, d):
    return X.truth(spark, d).select("slide_id", "id", adapter.evidence_text(F.col("score")).alias("text"), adapter.reported(F.col("score")).alias("reported"))
