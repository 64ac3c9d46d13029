"""Queries over scene assembly, box clean-up, differences, constraints and pixel kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import boxes, scene, spatial
from ..operators import constraints as C
from . import fixtures as X
from . import oracle as O

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


#: Owners are the boxes of the ground truth (nodes) and every fifth as a container; evidence are its segments.
OWNERS = f"""
SELECT slide_id, id AS owner_id, CASE WHEN ord % 5 = 0 THEN 'container' ELSE 'node' END AS owner_kind, x0, y0, x1, y1, CAST(60 + p % 40 AS DOUBLE) / 100 AS confidence FROM ({X.TRUTH}) g WHERE kind = 'box'
"""
PORTS = f"""
SELECT slide_id, concat(owner_id, ':port:', side) AS port_id, owner_id, owner_kind, side, px, py, confidence AS port_confidence FROM (
  SELECT o.*, 'top' AS side, x0 + (x1 - x0) / 2 AS px, y0 AS py FROM ({OWNERS}) o UNION ALL SELECT o.*, 'right', x1, y0 + (y1 - y0) / 2 FROM ({OWNERS}) o
  UNION ALL SELECT o.*, 'bottom', x0 + (x1 - x0) / 2, y1 FROM ({OWNERS}) o UNION ALL SELECT o.*, 'left', x0, y0 + (y1 - y0) / 2 FROM ({OWNERS}) o) q
"""
REACH = 120.0


def owners(spark, d):
    return X.boxed(X.frame(spark, d, OWNERS))


def ports_of(spark, d):
    return scene.ports(owners(spark, d).withColumnRenamed("owner_id", "id"))


def nodes(spark, d):
    return owners(spark, d).withColumnRenamed("owner_id", "id").where("owner_kind = 'node'")


def containers(spark, d):
    return owners(spark, d).withColumnRenamed("owner_id", "id").where("owner_kind = 'container'")


def evidence(spark, d):
    """Segments with the owners near their ends."""
    s = X.segments(spark, d).withColumn("orientation", G.orientation(F.col("a"), F.col("b")))
    near = lambda p, name: spatial.nearby_nodes(s.select("slide_id", "id", F.col(f"{p}.x").alias("x"), F.col(f"{p}.y").alias("y")), nodes(spark, d)).withColumnRenamed("node_ids", name)
    held = spatial.nearby_containers(s.withColumn("box", G.segment_box(F.col("a"), F.col("b"))), containers(spark, d)).withColumnRenamed("container_ids", "near_containers")
    out = s.join(near("a", "near_a"), ["slide_id", "id"], "left").join(near("b", "near_b"), ["slide_id", "id"], "left").join(held, ["slide_id", "id"], "left")
    none = F.array().cast("array<string>")
    return out.select("slide_id", "id", "ord", "orientation", "a", "b", "confidence", *(F.coalesce(c, none).alias(c) for c in ("near_a", "near_b", "near_containers")))


@register(X.duck(PORTS))
def ports(spark, d):
    return ports_of(spark, d).select("slide_id", F.col("id").alias("port_id"), "owner_id", "owner_kind", "side", F.col("point.x").alias("px"), F.col("point.y").alias("py"), F.col("confidence").alias("port_confidence"))


GAP = "sqrt(greatest(o.x0 - {x}, 0, {x} - o.x1) * greatest(o.x0 - {x}, 0, {x} - o.x1) + greatest(o.y0 - {y}, 0, {y} - o.y1) * greatest(o.y0 - {y}, 0, {y} - o.y1))"
SEG = f"""s AS MATERIALIZED (SELECT *, CASE WHEN abs(xb - xa) <= 2 AND abs(yb - ya) <= 2 THEN 'unknown' WHEN abs(yb - ya) <= 2.5 THEN 'horizontal' WHEN abs(xb - xa) <= 2.5 THEN 'vertical' ELSE 'diagonal' END AS orientation FROM ({X.duck(X.SEGMENTS)}) q),
o AS MATERIALIZED ({X.duck(OWNERS)}),
near_ AS MATERIALIZED (SELECT s.slide_id, s.id, 'start' AS e, owner_id FROM s JOIN o ON s.slide_id = o.slide_id WHERE owner_kind = 'node' AND {GAP.format(x='xa', y='ya')} <= 8
  UNION SELECT s.slide_id, s.id, 'end', owner_id FROM s JOIN o ON s.slide_id = o.slide_id WHERE owner_kind = 'node' AND {GAP.format(x='xb', y='yb')} <= 8),
held AS MATERIALIZED (SELECT s.slide_id, s.id, owner_id FROM s JOIN o ON s.slide_id = o.slide_id WHERE owner_kind = 'container' AND o.x0 - 8 < greatest(xa, xb) + 1 AND least(xa, xb) < o.x1 + 8 AND o.y0 - 8 < greatest(ya, yb) + 1 AND least(ya, yb) < o.y1 + 8)"""


@register(f"WITH {SEG} SELECT slide_id, id, string_agg(owner_id, ',' ORDER BY owner_id) AS node_ids FROM near_ WHERE e = 'start' GROUP BY 1, 2")
def nearby_nodes(spark, d):
    s = X.segments(spark, d)
    return spatial.nearby_nodes(s.select("slide_id", "id", "a.x", "a.y"), nodes(spark, d)).select("slide_id", "id", F.array_join("node_ids", ",").alias("node_ids"))


@register(f"WITH {SEG} SELECT slide_id, id, string_agg(owner_id, ',' ORDER BY owner_id) AS container_ids FROM held GROUP BY 1, 2")
def nearby_containers(spark, d):
    s = X.segments(spark, d).withColumn("box", G.segment_box(F.col("a"), F.col("b")))
    return spatial.nearby_containers(s, containers(spark, d)).select("slide_id", "id", F.array_join("container_ids", ",").alias("container_ids"))


RANKED = f"""{SEG}, p AS MATERIALIZED ({X.duck(PORTS)}),
ends AS (SELECT slide_id, id, orientation, 'start' AS e, xa AS x, ya AS y FROM s UNION ALL SELECT slide_id, id, orientation, 'end', xb, yb FROM s),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY slide_id, evidence_id, e ORDER BY score, gap, port_id) AS rank FROM (
  SELECT *, gap + (CASE WHEN orientation NOT IN ('horizontal', 'vertical') THEN {O.D(2)} WHEN orientation = 'horizontal' AND side IN ('left', 'right') OR orientation = 'vertical' AND side IN ('top', 'bottom') THEN {O.D(0)} ELSE {O.D(8)} END)
    + (CASE WHEN owner_kind = 'node' THEN {O.D(0)} ELSE {O.D(2.5)} END) - (CASE WHEN is_near THEN {O.D(4)} WHEN is_held THEN {O.D(1.5)} ELSE {O.D(0)} END) AS score FROM (
  SELECT e.slide_id, e.id AS evidence_id, e.e, e.orientation, p.port_id, p.owner_id, p.owner_kind, p.side, p.port_confidence, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS gap,
    EXISTS (SELECT 1 FROM near_ n WHERE n.slide_id = e.slide_id AND n.id = e.id AND n.e = e.e AND n.owner_id = p.owner_id) AS is_near, EXISTS (SELECT 1 FROM held h WHERE h.slide_id = e.slide_id AND h.id = e.id AND h.owner_id = p.owner_id) AS is_held
  FROM ends e JOIN p ON p.slide_id = e.slide_id) q WHERE gap <= {O.D(REACH)}) z)"""


@register(f"WITH {RANKED} SELECT slide_id, evidence_id, e AS \"end\", port_id, score, gap, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 4")
def rank_ports(spark, d):
    return scene.rank_ports(evidence(spark, d), ports_of(spark, d), REACH).where("rank <= 4").select("slide_id", "evidence_id", "end", "port_id", "score", "gap", "rank")


ATTACH = "(CASE WHEN {0}.port_confidence * (CAST(1 AS DOUBLE) - least(CAST(1 AS DOUBLE), {0}.gap / CAST(32 AS DOUBLE))) > CAST(0.25 AS DOUBLE) THEN {0}.port_confidence * (CAST(1 AS DOUBLE) - least(CAST(1 AS DOUBLE), {0}.gap / CAST(32 AS DOUBLE))) ELSE CAST(0.25 AS DOUBLE) END)"
PAIRS = f"""{RANKED}, pairs AS MATERIALIZED (SELECT * FROM (SELECT a.slide_id, a.evidence_id, a.port_id AS start_port, b.port_id AS end_port, a.score + b.score AS cost,
  least({O.D(0.97)}, {O.D(0.64)} * s.confidence + {O.D(0.18)} * {ATTACH.format('a')} + {O.D(0.18)} * {ATTACH.format('b')}) AS confidence,
  row_number() OVER (PARTITION BY a.slide_id, a.evidence_id ORDER BY a.score + b.score, a.rank, b.rank) AS n
  FROM ranked a JOIN ranked b ON a.slide_id = b.slide_id AND a.evidence_id = b.evidence_id AND a.e = 'start' AND b.e = 'end' AND a.rank <= 4 AND b.rank <= 4 AND a.owner_id <> b.owner_id JOIN s ON s.slide_id = a.slide_id AND s.id = a.evidence_id) q WHERE n = 1)"""


@register(f"WITH {PAIRS} SELECT slide_id, evidence_id, start_port, end_port, cost, confidence FROM pairs")
def attach_pairs(spark, d):
    return scene.attach(evidence(spark, d), ports_of(spark, d), REACH).select("slide_id", "evidence_id", F.col("start.port_id").alias("start_port"), F.col("end.port_id").alias("end_port"), "cost", "confidence")


@register(
    f"""WITH {PAIRS} SELECT s.slide_id, s.id AS evidence_id, CASE WHEN coalesce(ns, 0) = 0 AND coalesce(ne, 0) = 0 THEN 'no_compatible_ports_near_either_endpoint' WHEN coalesce(ns, 0) = 0 THEN 'start_endpoint_unattached' WHEN coalesce(ne, 0) = 0 THEN 'end_endpoint_unattached'
  ELSE 'same_owner_attachment_only' END AS reason, coalesce(c.n, 0) AS n_candidates FROM s LEFT JOIN (SELECT slide_id, evidence_id, count(*) FILTER (e = 'start') AS ns, count(*) FILTER (e = 'end') AS ne FROM ranked GROUP BY 1, 2) r ON r.slide_id = s.slide_id AND r.evidence_id = s.id
LEFT JOIN (SELECT slide_id, evidence_id, count(DISTINCT port_id) AS n FROM ranked WHERE rank <= 3 GROUP BY 1, 2) c ON c.slide_id = s.slide_id AND c.evidence_id = s.id
WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.slide_id = s.slide_id AND p.evidence_id = s.id)"""
)
def attach_unattached(spark, d):
    e, p = evidence(spark, d), ports_of(spark, d)
    return scene.unattached(e, p, scene.attach(e, p, REACH), REACH).select("slide_id", "evidence_id", "reason", F.size("candidate_port_ids").cast("long").alias("n_candidates"))


@register(f"WITH {PAIRS} SELECT slide_id, concat('connector:', replace(evidence_id, 's-', '')) AS id, evidence_id FROM pairs")
def resolve_connectors(spark, d):
    found = scene.attach(evidence(spark, d), ports_of(spark, d), REACH)
    named = found.withColumn("id", F.concat(F.lit("connector_candidate:"), F.substring("evidence_id", 3, 20)))
    return scene.resolve(named).select("slide_id", "id", "evidence_id")


#: Two instances a slide: owners with odd and even numbers.
@register(
    f"""WITH t AS ({X.duck(X.TEXTS)}), o AS (SELECT *, CAST(substr(owner_id, 4) AS BIGINT) AS n, CAST(substr(owner_id, 4) AS BIGINT) % 2 AS instance, CASE WHEN owner_kind = 'node' THEN 0 ELSE 1 END AS level FROM ({X.duck(OWNERS)}) q),
hit AS MATERIALIZED (SELECT t.slide_id, t.id AS text_id, o.instance, o.level, o.n, o.owner_id FROM t JOIN o ON t.slide_id = o.slide_id WHERE {O.touches('o.', 't.')}),
f AS (SELECT slide_id, text_id, min(instance) AS i, min(instance * 2 + level) AS il FROM hit GROUP BY 1, 2)
SELECT hit.slide_id, hit.text_id, string_agg(owner_id, ',' ORDER BY instance, level, n) AS owner_ids FROM hit JOIN f ON f.slide_id = hit.slide_id AND f.text_id = hit.text_id WHERE level = 0 OR (instance = i AND il = i * 2 + 1) GROUP BY 1, 2"""
)
def text_owner(spark, d):
    n = F.substring("id", 4, 20).cast("long")
    of = lambda df: df.withColumn("ord", n).withColumn("instance", n % 2).withColumn("text_ids", F.array().cast("array<string>"))
    return scene.text_owners(X.texts(spark, d), of(nodes(spark, d)), of(containers(spark, d))).select("slide_id", "text_id", F.array_join("owner_ids", ",").alias("owner_ids"))


ALL = f"b AS MATERIALIZED (SELECT slide_id, concat(id, '/', CAST(k AS STRING)) AS id, ord * 10 + k AS ord, x0, y0, x1, y1 FROM ({X.duck(X.ARTIFACTS)}) t WHERE kind <> 'connector')"
NMS = f"""{ALL}, nb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY {O.area('')} DESC, ord, id) AS rn FROM b),
r AS (SELECT slide_id, rn, id, x0, y0, x1, y1, TRUE AS hit, [struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1)] AS kept FROM nb WHERE rn = 1
  UNION ALL SELECT z.slide_id, z.rn, z.id, z.x0, z.y0, z.x1, z.y1, z.hit, CASE WHEN z.hit THEN list_append(z.kept, struct_pack(x0 := z.x0, y0 := z.y0, x1 := z.x1, y1 := z.y1)) ELSE z.kept END FROM (
    SELECT c.slide_id, c.rn, c.id, c.x0, c.y0, c.x1, c.y1, r.kept, len(list_filter(r.kept, lambda k: {O.iou('c.', 'k.')} >= 0.82)) = 0 AS hit FROM r JOIN nb c ON c.slide_id = r.slide_id AND c.rn = r.rn + 1) z),
kept AS MATERIALIZED (SELECT slide_id, id, x0, y0, x1, y1 FROM r WHERE hit)"""


def _candidates(spark, d):
    rows = X.artifacts(spark, d).where("kind <> 'connector'")
    return rows.select("slide_id", F.concat("id", F.lit("/"), F.col("k").cast("string")).alias("id"), (F.col("ord") * 10 + F.col("k")).alias("ord"), "box")


@register(f"WITH RECURSIVE {NMS} SELECT slide_id, id FROM kept")
def nms_boxes(spark, d):
    return boxes.suppress(_candidates(spark, d), ["slide_id"]).select("slide_id", "id")


@register(
    f"""WITH RECURSIVE {NMS} SELECT slide_id, id, row_number() OVER (PARTITION BY slide_id ORDER BY y0, x0, y1, x1, id) AS n FROM kept k WHERE (SELECT count(*) FROM kept o WHERE o.slide_id = k.slide_id AND o.id <> k.id
  AND {O.cx('o.')} BETWEEN k.x0 AND k.x1 AND {O.cy('o.')} BETWEEN k.y0 AND k.y1 AND {O.area('k.')} > {O.area('o.')} * {O.D(1.4)}) < 2"""
)
def parent_suppress(spark, d):
    rest = boxes.drop_parents(boxes.suppress(_candidates(spark, d), ["slide_id"]), ["slide_id"]).withColumn("old", F.col("id"))
    return boxes.numbered(rest, "node:", [*boxes.reading_order(), "old"]).select("slide_id", F.col("old").alias("id"), F.col("n").cast("long").alias("n"))


CELL = "least(concat(lpad(CAST(CAST(round_even(x{0} / 4, 0) AS BIGINT) + 100000 AS STRING), 7, '0'), '/', lpad(CAST(CAST(round_even(y{0} / 4, 0) AS BIGINT) + 100000 AS STRING), 7, '0')), concat(lpad(CAST(CAST(round_even(x{1} / 4, 0) AS BIGINT) + 100000 AS STRING), 7, '0'), '/', lpad(CAST(CAST(round_even(y{1} / 4, 0) AS BIGINT) + 100000 AS STRING), 7, '0')))"


@register(f"WITH {SEG}, q AS (SELECT *, {CELL.format('a', 'b')} AS c0, {CELL.replace('least', 'greatest', 1).format('a', 'b')} AS c1 FROM s) SELECT slide_id, id, orientation FROM (SELECT *, row_number() OVER (PARTITION BY slide_id, c0, c1 ORDER BY confidence DESC, ord) AS n FROM q) z WHERE n = 1")
def segment_dedupe(spark, d):
    s = X.segments(spark, d).withColumn("orientation", G.orientation(F.col("a"), F.col("b")))
    return boxes.dedupe_segments(s).select("slide_id", "id", "orientation")


@register(f"SELECT slide_id, id, row_number() OVER (PARTITION BY slide_id ORDER BY y0, x0, y1, x1, ord) AS n FROM ({X.duck(X.TRUTH)}) t")
def reading_order(spark, d):
    return boxes.numbered(X.truth(spark, d).withColumnRenamed("id", "old"), "item:", [*boxes.reading_order(), "ord"]).select("slide_id", F.col("old").alias("id"), F.col("n").cast("long").alias("n"))


#: Proposals are slides' first boxes, expanded; their contours are boxes inside, their texts those that touch.
PROPOSAL = f"SELECT slide_id, 'p' AS id, x0 - 20 AS x0, y0 - 20 AS y0, x1 + 120 AS x1, y1 + 120 AS y1 FROM ({X.TRUTH}) g WHERE ord = 1"
INNER = f"SELECT g.slide_id, 'p' AS proposal_id, g.id, g.x0, g.y0, g.x1, g.y1, g.ord FROM ({X.TRUTH}) g JOIN ({PROPOSAL}) p ON g.slide_id = p.slide_id WHERE g.p % 2 = 0 AND {O.contains('p.', 'g.')}"
INTEXT = f"SELECT g.slide_id, 'p' AS proposal_id, g.id, g.x0, g.y0, g.x1, g.y1, g.ord, g.text FROM ({X.TEXTS}) g JOIN ({PROPOSAL}) p ON g.slide_id = p.slide_id WHERE {O.overlaps('p.', 'g.')}"
NODES = f"""p AS ({X.duck(PROPOSAL)}), c AS ({X.duck(INNER)}), t AS ({X.duck(INTEXT)}),
hits AS (SELECT c.slide_id, c.id, count(*) AS n, string_agg(t.text, chr(10) ORDER BY t.ord, t.id) AS label FROM c JOIN t ON c.slide_id = t.slide_id WHERE {O.touches('c.', 't.')} GROUP BY 1, 2),
m AS (SELECT p.*, least(6, least({O.w('')}, {O.h('')}) / 10) AS e FROM p),
nodes AS MATERIALIZED (SELECT c.slide_id, c.x0, c.y0, c.x1, c.y1, CASE WHEN h.n > 0 THEN {O.D(0.82)} ELSE {O.D(0.58)} END AS confidence, h.label, 'contour' AS source FROM c LEFT JOIN hits h ON h.slide_id = c.slide_id AND h.id = c.id
  UNION ALL SELECT t.slide_id, t.x0 - 10, t.y0 - 10, t.x1 + 10, t.y1 + 10, {O.D(0.62)}, t.text, 'text_anchor' FROM t WHERE t.slide_id NOT IN (SELECT slide_id FROM c)
  UNION ALL SELECT slide_id, x0 + e, y0 + e, x1 - e, y1 - e, {O.D(0.34)}, NULL, 'proposal' FROM m WHERE slide_id NOT IN (SELECT slide_id FROM c) AND slide_id NOT IN (SELECT slide_id FROM t))"""


def _nodes(spark, d):
    return scene.nodes_of(X.boxed(X.frame(spark, d, PROPOSAL)), X.boxed(X.frame(spark, d, INNER)), X.boxed(X.frame(spark, d, INTEXT)))


@register(f"WITH {NODES} SELECT slide_id, x0, y0, x1, y1, confidence, label, source FROM nodes")
def family_nodes(spark, d):
    return _nodes(spark, d).select("slide_id", "box.*", "confidence", "label", "source")


@register(
    f"""WITH {NODES}, u AS (SELECT slide_id, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM nodes GROUP BY 1)
SELECT p.slide_id, 'p:container:1' AS id, least({O.D(0.76)}, {O.D(0.5)} + {O.D(0.08)} * u.n) AS confidence, u.n AS members FROM p JOIN u ON p.slide_id = u.slide_id WHERE u.n >= 2 OR {O.area('p.')} > {O.area('u.')} * {O.D(1.12)}"""
)
def family_containers(spark, d):
    found = scene.containers_of(X.boxed(X.frame(spark, d, PROPOSAL)), _nodes(spark, d))
    return found.select("slide_id", "id", "confidence", F.size("member_ids").cast("long").alias("members"))


EXPECTED = f"SELECT slide_id, CASE WHEN kind = 'arrow' THEN 'connector' WHEN ord % 4 = 0 THEN 'text' ELSE 'shape' END AS element, id, x0, y0, x1, y1, p, u FROM ({X.TRUTH}) g"
ACTUAL = f"SELECT slide_id, element, CASE WHEN u % 13 = 0 THEN concat(id, '+') ELSE id END AS id, CASE WHEN p % 11 = 0 THEN x0 + 1 ELSE x0 END AS x0, y0, x1, y1 FROM ({EXPECTED}) e WHERE (p + u) % 17 <> 0"
DIFF = f"""SELECT coalesce(a.slide_id, b.slide_id) AS slide_id, coalesce(a.element, b.element) AS element, coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'extra' WHEN a.x0 <> b.x0 OR a.y0 <> b.y0 OR a.x1 <> b.x1 OR a.y1 <> b.y1 THEN 'mismatch' ELSE 'equal' END AS outcome
FROM ({X.duck(EXPECTED)}) a FULL JOIN ({X.duck(ACTUAL)}) b ON a.slide_id = b.slide_id AND a.element = b.element AND a.id = b.id"""


@register(DIFF)
def diff_rows(spark, d):
    return scene.diff(X.boxed(X.frame(spark, d, EXPECTED)), X.boxed(X.frame(spark, d, ACTUAL)))


@register(
    f"SELECT slide_id, {', '.join(f'coalesce(string_agg(element || chr(47) || id, chr(44) ORDER BY element || chr(47) || id) FILTER (outcome = {chr(39)}{o}{chr(39)}), {chr(39) * 2}) AS {o}' for o in ('missing', 'extra', 'mismatch'))}, count(*) AS n, count(*) FILTER (outcome <> 'equal') = 0 AS lossless FROM ({DIFF}) z GROUP BY 1"
)
def diff_summary(spark, d):
    rows = scene.diff_summary(diff_rows(spark, d))
    return rows.select("slide_id", *(F.array_join(f"{o}_ids", ",").alias(o) for o in ("missing", "extra", "mismatch")), "n", "lossless")


@register(f"SELECT element, outcome, count(*) AS n FROM ({DIFF}) z GROUP BY 1, 2")
def diff_totals(spark, d):
    return scene.diff_totals(diff_rows(spark, d))


@register(f"SELECT a.slide_id, a.element, a.id, a.x0 FROM ({X.duck(EXPECTED)}) a SEMI JOIN (SELECT * FROM ({DIFF}) z WHERE outcome <> 'equal') b ON a.slide_id = b.slide_id AND a.element = b.element AND a.id = b.id")
def diff_overlay(spark, d):
    return scene.overlay_rows(diff_rows(spark, d), X.boxed(X.frame(spark, d, EXPECTED))).select("slide_id", "element", "id", "x0")


@register(
    """SELECT 'order.customer' AS rule, o_custkey AS slide_id, CAST(o_orderkey AS STRING) AS id FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 50 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS k FROM orders) o WHERE k NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'line.order', l_partkey, concat(CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING)) FROM lineitem WHERE CASE WHEN l_partkey % 97 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END NOT IN (SELECT o_orderkey FROM orders)"""
)
def violations_fk(spark, d):
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    one = lambda df, key, name: df.select(F.lit(1).alias("slide_id"), F.col(key).alias("id"))
    o = read("orders").select(F.lit(1).alias("slide_id"), F.col("o_custkey").alias("c"), F.col("o_orderkey").cast("string").alias("id"), F.expr("CASE WHEN o_orderkey % 50 = 0 THEN o_custkey + 10000000 ELSE o_custkey END").alias("k"))
    li = read("lineitem").select(F.lit(1).alias("slide_id"), F.col("l_partkey").alias("c"), F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")).alias("id"), F.expr("CASE WHEN l_partkey % 97 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END").alias("k"))
    out = []
    for rows, targets, rule in ((o, one(read("customer"), "c_custkey", "c"), "order.customer"), (li, one(read("orders"), "o_orderkey", "o"), "line.order")):
        named = rows.withColumn("id", F.struct("c", "id"))
        out.append(C.foreign_key(named, "k", targets, rule).select("rule", F.col("id.c").alias("slide_id"), F.col("id.id").alias("id")))
    return out[0].union(out[1])


@register(
    f"""WITH t AS (SELECT *, CAST(p % 130 AS DOUBLE) / 100 AS c FROM ({X.duck(X.TRUTH)}) q) SELECT 'item.confidence' AS rule, slide_id, id FROM t WHERE NOT (c BETWEEN 0 AND 1)
UNION ALL SELECT 'item.box', slide_id, id FROM t WHERE NOT (CASE WHEN u % 10 = 0 THEN x0 - 1 ELSE x1 END > x0 AND y1 > y0) UNION ALL SELECT 'item.source', slide_id, id FROM t WHERE f = 'A' UNION ALL SELECT 'item.provenance', slide_id, id FROM t WHERE NOT attached"""
)
def violations_range(spark, d):
    rows = X.frame(spark, d, X.TRUTH).withColumn("confidence", (F.col("p") % 130).cast("double") / 100).withColumn("x1", F.when(F.col("u") % 10 == 0, F.col("x0") - 1).otherwise(F.col("x1")))
    rows = X.attached(X.boxed(rows)).withColumn("source", F.when(F.col("f") == "A", F.lit("")).otherwise(F.col("f"))).withColumnRenamed("attachment_ids", "provenance")
    return C.element_rules(rows, "item")


@register("SELECT 'line.unique' AS rule, l_orderkey AS slide_id, CAST(l_linenumber AS STRING) AS id FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def violations_unique(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("slide_id"), F.col("l_linenumber").cast("string").alias("id"))
    return C.unique(rows, "line.unique")


@register(None)
def pixel_regions(spark, d):
    """Text, picture and node boxes of drawings, one a part; no picture table exists, so drawings are made from part numbers."""
    from ..operators import pixels

    return pixels.regions(pixels.drawings(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("slide_id"), F.col("p_size").alias("seed"))))
