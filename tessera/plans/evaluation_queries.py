"""Queries over scene items: scalars, matching, attrition, failures, audits, attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kinds as K
from ..functions import scores as S
from ..lineage import checkpointed
from ..operators import attribution, boxes, matching, spatial
from ..operators import evaluation as E
from . import fixtures as X
from . import oracle as O
from . import rollup

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str):
    def take(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return take


MATCHES = O.query(O.BASE, O.matched("m"), body="{}")
EMIT = O.query(O.BASE, O.matched("m", attachment=True, stage="07_emit"), body="{}")
SUMS = ", ".join(f"CAST(count(*) FILTER (bucket = '{b}') AS BIGINT) AS {b}" for b in K.BUCKETS)


def all_matches(spark, d, *, kept: bool = False):
    """Matches of all stages; `kept` in a checkpoint, for those who join them more than once."""
    found = matching.stage_matches(X.truth(spark, d), X.artifacts(spark, d))
    return checkpointed(found) if kept else found


@register(
    O.query(
        O.BASE,
        O.matched("m"),
        body=f"""SELECT st.stage, CAST(coalesce(n, 0) AS BIGINT) AS ground_truth_count, CAST(coalesce(artifact_count, 0) AS BIGINT) AS artifact_count, CAST(coalesce(recoverable_count, 0) AS BIGINT) AS recoverable_count,
  CAST(coalesce(recoverable_count, 0) AS DOUBLE) / greatest(1, coalesce(n, 0)) AS recoverable_ratio, {', '.join(f'CAST(coalesce({b}, 0) AS BIGINT) AS {b}' for b in K.BUCKETS)}
FROM {O.STAGES} LEFT JOIN (SELECT s.stage, count(*) AS n FROM gt CROSS JOIN {O.STAGES.replace('st(', 's(')} WHERE {O.supports('s.stage', 'k1')} GROUP BY 1) g ON g.stage = st.stage
LEFT JOIN (SELECT stage, count(*) AS artifact_count FROM art WHERE evaluable GROUP BY 1) a ON a.stage = st.stage
LEFT JOIN (SELECT stage, count(*) AS recoverable_count, {SUMS} FROM m GROUP BY 1) h ON h.stage = st.stage""",
    )
)
def oracle_by_stage(spark, d):
    return E.oracle_by_stage(X.truth(spark, d), X.artifacts(spark, d), all_matches(spark, d), E.stage_table(spark))


@register(MATCHES.format("SELECT slide_id, stage, gt_id, artifact_id, similarity, bucket, kind FROM m"))
def greedy_match(spark, d):
    return all_matches(spark, d)


@register(
    MATCHES.format(f"""SELECT coalesce(a.stage, b.stage) AS stage, coalesce(a.kind, b.kind) AS kind, CAST(coalesce(recoverable_count, 0) AS BIGINT) AS recoverable_count, CAST(coalesce(ground_truth_count, 0) AS BIGINT) AS ground_truth_count,
  CASE WHEN coalesce(ground_truth_count, 0) = 0 THEN 0 ELSE coalesce(recoverable_count, 0) / CAST(ground_truth_count AS DOUBLE) END AS recoverable_ratio
FROM (SELECT stage, kind, count(*) AS recoverable_count FROM m GROUP BY 1, 2) a FULL JOIN (SELECT st.stage, k1 AS kind, count(*) AS ground_truth_count FROM gt CROSS JOIN {O.STAGES} WHERE {O.supports('st.stage', 'k1')} GROUP BY 1, 2) b ON a.stage = b.stage AND a.kind = b.kind""")
)
def oracle_by_kind(spark, d):
    hits = all_matches(spark, d).groupBy("stage", "kind").agg(F.count("*").alias("n"))
    every = matching.normalised(X.truth(spark, d)).groupBy("kind").agg(F.count("*").alias("n")).crossJoin(F.broadcast(E.stage_table(spark))).where(K.supports(F.col("stage"), F.col("kind")))
    return rollup.stage_kind_totals(hits, every)


@register(
    MATCHES.format(f"""SELECT s.stage, s.kind, {', '.join(f'CAST(coalesce({b}, 0) AS BIGINT) AS {b}' for b in K.BUCKETS)} FROM (SELECT DISTINCT stage, k1 AS kind FROM gt CROSS JOIN {O.STAGES} WHERE {O.supports('stage', 'k1')}) s
LEFT JOIN (SELECT stage, kind, {SUMS} FROM m GROUP BY 1, 2) h ON h.stage = s.stage AND h.kind = s.kind""")
)
def oracle_by_bucket(spark, d):
    kinds = matching.normalised(X.truth(spark, d)).select("kind").distinct().crossJoin(F.broadcast(E.stage_table(spark))).where(K.supports(F.col("stage"), F.col("kind")))
    return E.bucket_counts(all_matches(spark, d), "stage", "kind", every=kinds)


@register(
    MATCHES.format(f"""SELECT g.slide_id, st.stage, g.id AS gt_id, g.k1 AS kind, m.artifact_id, coalesce(m.similarity, 0) AS similarity, m.bucket FROM gt g CROSS JOIN {O.STAGES}
LEFT JOIN m ON m.slide_id = g.slide_id AND m.stage = st.stage AND m.gt_id = g.id WHERE {O.supports('st.stage', 'g.k1')}""")
)
def match_left_outer(spark, d):
    return matching.match_rows(X.truth(spark, d), all_matches(spark, d), E.stage_table(spark))


@register(O.query(O.BASE, O.best("b"), body="SELECT slide_id, stage, gt_id, kind, artifact_id, similarity, passes FROM b"))
def best_candidate(spark, d):
    truth, art = X.truth(spark, d), X.artifacts(spark, d)
    both = matching.best_candidates(truth, art, attachment_stage="07_emit")
    return both.select("slide_id", "stage", "gt_id", "kind", F.col("item.id").alias("artifact_id"), "similarity", "passes")


CONTEXT = f"""ctx AS MATERIALIZED (SELECT * FROM (SELECT g.slide_id, g.id, g.k1 AS kind, a.id AS other_id, a.k1 AS other_kind, a.atts AS other_atts, CASE WHEN a.id IS NULL THEN 0 ELSE {{sim}} END AS similarity,
  max(CASE WHEN a.id IS NULL THEN 0 ELSE {{sim}} END) OVER (PARTITION BY g.slide_id, g.id) AS top FROM {{left}} g LEFT JOIN {{right}} a ON g.slide_id = a.slide_id) q
  WHERE top - similarity <= top * CAST(1e-9 AS DOUBLE) QUALIFY row_number() OVER (PARTITION BY slide_id, id ORDER BY other_id) = 1)"""
ANY = f"(CASE WHEN g.k1 = 'connector' OR a.k1 = 'connector' THEN {O.connector('g.', 'a.')} ELSE {O.iou('g.', 'a.')} END)"
LAST = "last AS MATERIALIZED (SELECT * FROM art WHERE stage = '07_emit' AND evaluable)"


@register(O.query(O.BASE, LAST, CONTEXT.format(sim=ANY, left="gt", right="last"), body="SELECT slide_id, id, other_id, similarity FROM ctx"))
def contextual_best(spark, d):
    found = matching.best_contextual(X.truth(spark, d), X.artifacts(spark, d, "07_emit").where("evaluable"))
    return found.select("slide_id", "id", F.col("other.id").alias("other_id"), "similarity")


LOST = f"""SELECT g.slide_id, g.id AS gt_id, g.k1 AS kind, l.lost_at, CAST(coalesce(l.n, 0) AS BIGINT) AS stages_present FROM gt g LEFT JOIN (
  SELECT slide_id, gt_id, arg_min(stage, stage_ord) FILTER (seen AND NOT present) AS lost_at, count(*) FILTER (present) AS n FROM (
    SELECT *, coalesce(bool_or(present) OVER (PARTITION BY slide_id, gt_id ORDER BY stage_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS seen FROM (
      SELECT g.slide_id, g.id AS gt_id, st.stage, st.stage_ord, m.artifact_id IS NOT NULL AS present FROM gt g CROSS JOIN {O.STAGES} LEFT JOIN m ON m.slide_id = g.slide_id AND m.stage = st.stage AND m.gt_id = g.id
      WHERE {O.supports('st.stage', 'g.k1')}) a) b GROUP BY 1, 2) l ON l.slide_id = g.slide_id AND l.gt_id = g.id"""


@register(MATCHES.format(LOST))
def attrition_lost_at(spark, d):
    return E.attrition(X.truth(spark, d), all_matches(spark, d), E.stage_table(spark)).select("slide_id", "gt_id", "kind", "lost_at", "stages_present")


@register(MATCHES.format(f"SELECT lost_at, count(*) AS n FROM ({LOST}) x WHERE lost_at IS NOT NULL GROUP BY 1"))
def attrition_counts(spark, d):
    return E.attrition_counts(attrition_lost_at(spark, d))


SAME = f"(CASE WHEN g.k1 = 'connector' THEN {O.connector('g.', 'a.')} ELSE {O.iou('g.', 'a.')} END)"
GT_FAIL = O.query(
    O.BASE, LAST, O.matched("m", attachment=True, stage="07_emit"), CONTEXT.format(sim=ANY, left="gt", right="last"),
    f"near AS (SELECT g.slide_id, g.id, count(*) AS n_close, least(1, sum({SAME})) AS covered, max({SAME}) AS closest FROM gt g JOIN last a ON a.slide_id = g.slide_id AND a.k1 = g.k1 WHERE {SAME} >= 0.1 GROUP BY 1, 2)",
    f"""mrg AS (SELECT slide_id, id, arg_min(tag, ord) AS tag FROM (SELECT g.slide_id, g.id, a.ord, CASE WHEN EXISTS (SELECT 1 FROM gt s WHERE s.slide_id = g.slide_id AND s.k1 = g.k1 AND s.id <> g.id AND {O.contains('a.', 's.')}) THEN 'merged_siblings'
      WHEN {O.area('a.')} > {O.area('g.')} * {O.D(1.35)} THEN 'merged_into_parent' END AS tag FROM gt g JOIN last a ON a.slide_id = g.slide_id AND a.k1 = g.k1 WHERE {O.contains('a.', 'g.')}) q WHERE tag IS NOT NULL GROUP BY 1, 2)""",
    body="""SELECT g.slide_id, g.id AS gt_id, g.k1 AS kind, CASE WHEN len(g.atts) > 0 AND c.other_id IS NOT NULL AND c.other_kind = g.k1 AND c.similarity >= 0.35 AND g.atts <> c.other_atts THEN 'wrong_attachment'
  WHEN c.other_id IS NOT NULL AND c.other_kind <> g.k1 AND c.similarity >= 0.3 THEN 'wrong_type' WHEN mrg.tag IS NOT NULL THEN mrg.tag WHEN near.n_close > 1 AND near.covered >= 0.7 THEN 'split_fragments'
  WHEN near.closest >= 0.2 THEN 'near_miss_geometry' ELSE 'missing' END AS tag, c.other_id AS best_prediction_id, greatest(0, c.similarity) AS best_similarity
FROM gt g JOIN ctx c ON c.slide_id = g.slide_id AND c.id = g.id LEFT JOIN near ON near.slide_id = g.slide_id AND near.id = g.id LEFT JOIN mrg ON mrg.slide_id = g.slide_id AND mrg.id = g.id
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.slide_id = g.slide_id AND m.gt_id = g.id)""",
)


@register(GT_FAIL)
def failure_gt(spark, d):
    truth, last = checkpointed(X.truth(spark, d)), checkpointed(X.artifacts(spark, d, "07_emit"))
    return E.failures_of_truth(truth, last, matching.stage_matches(truth, last, attachment=True))


PRED_FAIL = O.query(
    O.BASE, LAST, O.matched("m", attachment=True, stage="07_emit"), CONTEXT.format(sim=ANY, left="last", right="gt"),
    f"near AS (SELECT g.slide_id, g.id, count(*) AS n_close, max({SAME}) AS closest, min(a.id) AS only FROM last g JOIN gt a ON a.slide_id = g.slide_id AND a.k1 = g.k1 WHERE {SAME} >= 0.1 GROUP BY 1, 2)",
    f"ins AS (SELECT g.slide_id, g.id, count(*) AS n FROM last g JOIN gt a ON a.slide_id = g.slide_id AND a.k1 = g.k1 WHERE {O.contains('g.', 'a.')} GROUP BY 1, 2)",
    f"frag AS (SELECT g.slide_id, g.id, count(*) AS n FROM gt g JOIN last a ON a.slide_id = g.slide_id AND a.k1 = g.k1 WHERE {SAME} >= 0.1 GROUP BY 1, 2)",
    body="""SELECT g.slide_id, g.id AS prediction_id, g.k1 AS kind, CASE WHEN len(g.atts) > 0 AND c.other_id IS NOT NULL AND c.other_kind = g.k1 AND c.similarity >= 0.35 AND g.atts <> c.other_atts THEN 'wrong_attachment'
  WHEN c.other_id IS NOT NULL AND c.other_kind <> g.k1 AND c.similarity >= 0.3 THEN 'wrong_type' WHEN ins.n > 1 THEN 'merged_siblings' WHEN near.n_close = 1 AND frag.n > 1 THEN 'split_fragments'
  WHEN near.closest >= 0.2 THEN 'near_miss_geometry' ELSE 'hallucinated_prediction' END AS tag, c.other_id AS best_gt_id, greatest(0, c.similarity) AS best_similarity, g.bucket
FROM last g JOIN ctx c ON c.slide_id = g.slide_id AND c.id = g.id LEFT JOIN near ON near.slide_id = g.slide_id AND near.id = g.id LEFT JOIN ins ON ins.slide_id = g.slide_id AND ins.id = g.id
LEFT JOIN frag ON frag.slide_id = near.slide_id AND frag.id = near.only WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.slide_id = g.slide_id AND m.artifact_id = g.id)""",
)


@register(PRED_FAIL)
def failure_pred(spark, d):
    truth, last = checkpointed(X.truth(spark, d)), checkpointed(X.artifacts(spark, d, "07_emit"))
    return E.failures_of_predictions(truth, last, matching.stage_matches(truth, last, attachment=True))


def _stage(i: int) -> str:
    return f"s{i}"


JOINED = " ".join(f"LEFT JOIN b s{i} ON s{i}.slide_id = g.slide_id AND s{i}.gt_id = g.id AND s{i}.stage = '{s}'" for i, s in enumerate(K.STAGES))
SELECTED = O.matched("ms", stage="05_selection")
EMITTED = O.matched("me", attachment=True, stage="07_emit")
RESCUED = "((coalesce(s2.passes, FALSE) AND coalesce(s2.bucket IN ('fallback_only', 'mixed_geometry_fallback'), FALSE) AND NOT coalesce(s0.passes, FALSE)) OR coalesce(me.bucket IN ('fallback_only', 'mixed_geometry_fallback'), FALSE))"
FROM_ALL = f"FROM gt g {JOINED} LEFT JOIN ms ON ms.slide_id = g.slide_id AND ms.gt_id = g.id LEFT JOIN me ON me.slide_id = g.slide_id AND me.gt_id = g.id"
STATUS = f"""CASE WHEN s0.gt_id IS NULL THEN 'no_raw_candidate' WHEN NOT s0.passes THEN 'raw_candidate_below_threshold' WHEN s1.gt_id IS NOT NULL AND NOT s1.passes AND s1.similarity + {O.D(0.05)} < s0.similarity THEN 'guide_snap_hurt'
  WHEN s2.gt_id IS NULL THEN 'object_conversion_absent' WHEN NOT s2.passes THEN 'object_conversion_rejected' WHEN ms.gt_id IS NULL THEN 'selection_suppressed' WHEN me.gt_id IS NULL THEN 'emit_missing' WHEN {RESCUED} THEN 'fallback_rescued' ELSE 'recovered' END"""
AUDIT = O.query(O.BASE, O.best("b"), SELECTED, EMITTED, body="{}")
AUDIT_BODY = f"SELECT g.slide_id, g.id AS gt_id, g.k1 AS kind, s0.artifact_id AS raw_id, coalesce(s0.similarity, 0) AS raw_similarity, s4.artifact_id AS emit_id, {RESCUED} AS fallback_rescued, {STATUS} AS status {FROM_ALL}"


@register(AUDIT.format(AUDIT_BODY))
def geometry_audit(spark, d):
    rows = E.geometry_audit(*X.by_slide(spark, d))
    return rows.select("slide_id", "gt_id", "kind", F.col("raw.item.id").alias("raw_id"), F.coalesce("raw.similarity", F.lit(0.0)).alias("raw_similarity"), F.col("emit.item.id").alias("emit_id"), "fallback_rescued", "status")


@register(AUDIT.format(f"SELECT kind, status AS tag, count(*) AS n, CAST(grouping(kind) AS INTEGER) AS overall FROM ({AUDIT_BODY}) x GROUP BY GROUPING SETS ((status), (kind, status))"))
def audit_status_counts(spark, d):
    found = rollup.tag_totals(geometry_audit(spark, d), tag="status")
    return found.withColumn("overall", F.col("overall").cast("int"))


def enclosed(s: str) -> str:
    return f"(SELECT string_agg(o.id, ',' ORDER BY o.id) FROM gt o WHERE o.slide_id = g.slide_id AND o.id <> g.id AND o.k1 = 'container' AND {O.contains(s, 'o.')})"


def relation(s: str) -> str:
    return f"(CASE WHEN {s}gt_id IS NULL THEN 'none' WHEN {O.contains(s, 'g.')} THEN 'contains_gt' WHEN {O.contains('g.', s)} THEN 'inside_gt' WHEN {O.overlaps(s, 'g.')} THEN 'overlap_only' ELSE 'disjoint' END)"


def share(s: str) -> str:
    return f"(CASE WHEN {s}gt_id IS NULL OR {O.area('g.')} <= 0 THEN 0 ELSE {O.area(s)} / {O.area('g.')} END)"


SIGN = lambda p: f"round_even({p}x0, 0) || '/' || round_even({p}y0, 0) || '/' || round_even({p}x1, 0) || '/' || round_even({p}y1, 0)"
SIGNED = f"sig AS MATERIALIZED (SELECT slide_id, {SIGN('')} AS s, count(*) AS n FROM art WHERE evaluable AND stage = '02_guides' GROUP BY 1, 2)"
ROWS = f"""rows_ AS MATERIALIZED (SELECT g.slide_id, g.id AS gt_id, s0.gt_id IS NOT NULL AS has0, s1.gt_id IS NOT NULL AS has1, s2.gt_id IS NOT NULL AS has2, coalesce(s0.passes, FALSE) AS p0, coalesce(s1.passes, FALSE) AS p1, coalesce(s2.passes, FALSE) AS p2,
  coalesce(s0.similarity, 0) AS q0, coalesce(s1.similarity, 0) AS q1, ms.gt_id IS NOT NULL AS sel, me.gt_id IS NOT NULL AS emi, {RESCUED} AS rescued, s0.raw_kind, {relation('s0.')} AS r0, {relation('s1.')} AS r1, {share('s0.')} AS a0, {share('s1.')} AS a1,
  {enclosed('s0.')} AS e0, {enclosed('s1.')} AS e1, (SELECT n FROM sig WHERE sig.slide_id = g.slide_id AND sig.s = {SIGN('s1.')}) AS same, s0.artifact_id AS raw_id, s1.artifact_id AS snapped_id {FROM_ALL} WHERE g.k1 = 'container')"""
EFFECT = f"""eff AS MATERIALIZED (SELECT *, CASE WHEN NOT has0 OR NOT has1 THEN 'unchanged_by_snap' WHEN p0 AND NOT p1 THEN 'snap_moved_below_threshold' WHEN same > 1 AND q1 + {O.D(0.01)} < q0 THEN 'snap_collapsed_distinct_boxes'
  WHEN q1 > q0 + {O.D(0.01)} THEN 'improved_by_snap' WHEN q1 + {O.D(0.01)} < q0 THEN 'worsened_by_snap' ELSE 'unchanged_by_snap' END AS snap_effect FROM rows_)"""
CONTAINER = O.query(
    O.BASE, O.best("b"), SELECTED, EMITTED, SIGNED, ROWS, EFFECT,
    body="""SELECT slide_id, gt_id, raw_id, snapped_id, r0 AS raw_relation, r1 AS snapped_relation, a0 AS raw_area_ratio, a1 AS snapped_area_ratio, coalesce(e0, '') AS raw_enclosed, coalesce(e1, '') AS snapped_enclosed, snap_effect, q1 - q0 AS snap_delta,
  CASE WHEN NOT has0 THEN 'no_raw_candidate' WHEN rescued THEN 'fallback_rescued' WHEN emi THEN 'recovered' WHEN sel AND p2 THEN 'selection_suppressed' WHEN snap_effect IN ('snap_moved_below_threshold', 'snap_collapsed_distinct_boxes') THEN 'snap_hurt'
    WHEN (p0 OR p1) AND NOT has2 THEN 'object_conversion_absent' WHEN raw_kind = 'rounded_rect' AND q0 >= 0.08 AND q0 < 0.42 THEN 'rounded_panel_missed' WHEN r0 = 'contains_gt' AND (a0 >= 1.55 OR e0 IS NOT NULL) THEN 'oversized_or_merged_candidate'
    WHEN r0 = 'inside_gt' AND a0 <= 0.65 THEN 'undersized_fragment_candidate' WHEN r0 = 'overlap_only' AND q0 >= 0.08 THEN 'weak_or_missing_side' WHEN p0 AND NOT p2 THEN 'object_conversion_absent' ELSE 'raw_candidate_below_threshold' END AS status FROM eff""",
)


@register(CONTAINER)
def container_audit(spark, d):
    rows = E.container_audit(*X.by_slide(spark, d))
    ids = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return rows.select("slide_id", "gt_id", F.col("raw.item.id").alias("raw_id"), F.col("snapped.item.id").alias("snapped_id"), "raw_relation", "snapped_relation", "raw_area_ratio", "snapped_area_ratio", ids("raw_enclosed"), ids("snapped_enclosed"), "snap_effect", "snap_delta", "status")


@register(f"SELECT snap_effect, status, count(*) AS n FROM ({CONTAINER}) z GROUP BY 1, 2")
def snap_effects(spark, d):
    return container_audit(spark, d).groupBy("snap_effect", "status").agg(F.count("*").alias("n"))


PAIRED = f"SELECT g.slide_id, g.id AS gt_id, a.id AS artifact_id, {{}} FROM ({X.duck(X.TRUTH)}) g JOIN ({X.duck(X.ARTIFACTS)}) a ON g.slide_id = a.slide_id AND a.stage = '03_objects'"


def paired(spark, d):
    g = X.truth(spark, d).select("slide_id", F.col("id").alias("gt_id"), F.col("box").alias("g"))
    return g.join(X.artifacts(spark, d, "03_objects").select("slide_id", F.col("id").alias("artifact_id"), F.col("box").alias("a")), "slide_id")


@register(PAIRED.format(f"CASE WHEN {O.contains('a.', 'g.')} THEN 'contains_gt' WHEN {O.contains('g.', 'a.')} THEN 'inside_gt' WHEN {O.overlaps('a.', 'g.')} THEN 'overlap_only' ELSE 'disjoint' END AS relation, {O.area('a.')} / {O.area('g.')} AS area_ratio"))
def containment_relation(spark, d):
    return paired(spark, d).select("slide_id", "gt_id", "artifact_id", G.containment(F.col("a"), F.col("g")).alias("relation"), G.area_ratio(F.col("a"), F.col("g")).alias("area_ratio"))


@register(PAIRED.format(f"{O.iou('g.', 'a.')} AS iou, {O.iou('g.', 'a.', 6)} AS padded, {O.connector('g.', 'a.')} AS connector, {O.axis('g.')} AS axis"))
def similarities(spark, d):
    g, a = F.col("g"), F.col("a")
    return paired(spark, d).select("slide_id", "gt_id", "artifact_id", G.iou(g, a).alias("iou"), G.padded_iou(g, a, 6.0).alias("padded"), G.connector_similarity(g, a).alias("connector"), G.axis(g).alias("axis"))


def inset_sql(k: str, sign: str) -> str:
    return f"CASE WHEN {O.w('')} <= 40 OR {O.h('')} <= 40 THEN {k} ELSE {k} {sign} 20 END"


@register(
    f"""SELECT slide_id, id, {O.w('')} AS width, {O.h('')} AS height, {O.area('')} AS area, {O.cx('')} AS cx, {O.cy('')} AS cy, {inset_sql('x0', '+')} AS inset_x0, {inset_sql('y1', '-')} AS inset_y1,
  greatest(0, least(800, x1)) AS clip_x1, greatest(0, x0 - 5) AS pad_x0, least(900, x1 + 5) AS pad_x1, round_even(x0 / 4, 0) AS grid_x0, 500 BETWEEN x0 AND x1 AND 300 BETWEEN y0 AND y1 AS holds,
  sqrt(greatest(x0 - 500, 0, 500 - x1) * greatest(x0 - 500, 0, 500 - x1) + greatest(y0 - 300, 0, 300 - y1) * greatest(y0 - 300, 0, 300 - y1)) AS gap,
  CASE WHEN y0 <= {O.D(0.18)} * 800 AND {O.w('')} >= {O.D(0.22)} * 1200 THEN 'title' WHEN {O.h('')} >= {O.D(0.10)} * 800 THEN 'body' ELSE 'label' END AS role FROM ({X.duck(X.TRUTH)}) t"""
)
def box_scalars(spark, d):
    b = F.col("box")
    extent = G.full_extent(F.lit(800.0), F.lit(800.0))
    return X.truth(spark, d).select(
        "slide_id", "id", G.width(b).alias("width"), G.height(b).alias("height"), G.area(b).alias("area"), G.center(b)["x"].alias("cx"), G.center(b)["y"].alias("cy"), G.inset(b, 20.0)["x0"].alias("inset_x0"), G.inset(b, 20.0)["y1"].alias("inset_y1"),
        G.clip(b, extent)["x1"].alias("clip_x1"), G.pad_within(b, F.lit(5.0), F.lit(900), F.lit(900))["x0"].alias("pad_x0"), G.pad_within(b, F.lit(5.0), F.lit(900), F.lit(900))["x1"].alias("pad_x1"),
        F.bround(b["x0"] / 4).alias("grid_x0"), G.contains_point(b, G.point(500.0, 300.0)).alias("holds"), G.point_to_box(F.lit(500.0), F.lit(300.0), b).alias("gap"), K.text_role(b, F.lit(1200.0), F.lit(800.0)).alias("role"),
    )


NAMES = "(CASE p_size % 9 WHEN 0 THEN ' Rect' WHEN 1 THEN 'PANEL ' WHEN 2 THEN 'solid_arrow' WHEN 3 THEN 'Line' WHEN 4 THEN 'text' WHEN 5 THEN 'Text_Only' WHEN 6 THEN '' WHEN 7 THEN NULL ELSE p_type END)"


@register(f"SELECT p_partkey, {O.eval_kind('k')} AS eval_kind, {O.source_kind('k')} AS source_kind, {O.supports(chr(39) + '02_guides' + chr(39), O.eval_kind('k'))} AS in_guides FROM (SELECT p_partkey, {NAMES} AS k FROM part) q")
def kind_normalizers(spark, d):
    k = F.col("k")
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr(NAMES).alias("k"))
    return rows.select("p_partkey", K.eval_kind(k).alias("eval_kind"), K.source_kind(k).alias("source_kind"), K.supports(F.lit("02_guides"), K.eval_kind(k)).alias("in_guides"))


@register(f"SELECT stage, {', '.join(f'CAST(count(*) FILTER (bucket = {chr(39)}{b}{chr(39)}) AS BIGINT) AS {b}' for b in K.BUCKETS)} FROM (SELECT *, {O.BUCKET} AS bucket FROM ({X.duck(X.ARTIFACTS)}) t) q GROUP BY 1")
def source_buckets(spark, d):
    return attribution.buckets(X.artifacts(spark, d).drop("bucket"), "stage")


@register(f"SELECT stage, kind, {SUMS} FROM (SELECT stage, {O.source_kind('kind')} AS kind, {O.BUCKET} AS bucket FROM ({X.duck(X.ARTIFACTS)}) t) q GROUP BY 1, 2")
def buckets_by_kind(spark, d):
    return attribution.buckets_by_kind(X.artifacts(spark, d).drop("bucket"), "stage")


INTER = "(greatest(0, least(r.x1, e.x1) - greatest(r.x0, e.x0)) * greatest(0, least(r.y1, e.y1) - greatest(r.y0, e.y0)))"


@register(
    f"""WITH e AS (SELECT * FROM ({X.duck(X.ARTIFACTS)}) t WHERE stage = '07_emit'), r AS ({X.duck(X.TEXTS)}), s AS (SELECT o_orderkey AS slide_id, 1200 AS width, 800 AS height FROM orders)
SELECT s.slide_id, CAST(coalesce(en, 0) AS BIGINT) AS native_object_count, CAST(coalesce(rn, 0) AS BIGINT) AS raster_region_count, coalesce(ea, 0) / 960000.0 AS native_area_ratio, coalesce(ra, 0) / 960000.0 AS raster_area_ratio, coalesce(o, 0) / 960000.0 AS overlap_area_ratio, CAST(coalesce(dn, 0) AS BIGINT) AS dropped_count
FROM s LEFT JOIN (SELECT slide_id, count(*) AS en, sum({O.area('')}) AS ea FROM e GROUP BY 1) a USING (slide_id) LEFT JOIN (SELECT slide_id, count(*) AS rn, sum({O.area('')}) AS ra FROM r GROUP BY 1) b USING (slide_id)
LEFT JOIN (SELECT r.slide_id, sum({INTER}) AS o FROM r JOIN e ON r.slide_id = e.slide_id WHERE {O.overlaps('r.', 'e.')} GROUP BY 1) c USING (slide_id) LEFT JOIN (SELECT slide_id, count(*) AS dn FROM e WHERE NOT evaluable GROUP BY 1) x USING (slide_id)"""
)
def manifest_accounting(spark, d):
    slides = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("slide_id"), F.lit(1200).alias("width"), F.lit(800).alias("height"))
    emitted = X.artifacts(spark, d, "07_emit")
    return attribution.accounting(slides, emitted, X.texts(spark, d), emitted.where("not evaluable"), cell=256.0)


@register(f"WITH e AS (SELECT * FROM ({X.duck(X.ARTIFACTS)}) t WHERE stage = '07_emit'), r AS ({X.duck(X.TRUTH)}) SELECT r.slide_id, sum({INTER}) AS overlap_area FROM r JOIN e ON r.slide_id = e.slide_id WHERE {O.overlaps('r.', 'e.')} GROUP BY 1")
def pairwise_overlap(spark, d):
    return spatial.overlap_area(X.truth(spark, d).select("slide_id", F.col("box").alias("r")), X.artifacts(spark, d, "07_emit").select("slide_id", F.col("box").alias("e")), "r", "e", cell=256.0)


@register(f"SELECT slide_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM ({X.duck(X.TRUTH)}) t GROUP BY 1")
def union_box(spark, d):
    return boxes.union_boxes(X.truth(spark, d), ["slide_id"]).select("slide_id", "box.*", "n")


@register(
    f"""SELECT slide_id, ord, least(CAST(0.92 AS DOUBLE), CAST(0.38 AS DOUBLE) + least(CAST(0.30 AS DOUBLE), confidence * CAST(6 AS DOUBLE)) + least(CAST(0.16 AS DOUBLE), CAST(ord % 4 AS DOUBLE) * CAST(0.06 AS DOUBLE))) AS proposal,
  greatest(CAST(0.25 AS DOUBLE), confidence * (CAST(1 AS DOUBLE) - least(CAST(1 AS DOUBLE), CAST(ord AS DOUBLE) / CAST(32 AS DOUBLE)))) AS attachment, least(CAST(0.76 AS DOUBLE), CAST(0.5 AS DOUBLE) + CAST(0.08 AS DOUBLE) * CAST(ord AS DOUBLE)) AS container,
  CASE WHEN ord % 3 = 0 THEN 'no_compatible_ports_near_either_endpoint' WHEN ord % 3 = 1 THEN 'end_endpoint_unattached' ELSE 'same_owner_attachment_only' END AS reason FROM ({X.duck(X.SEGMENTS)}) s"""
)
def score_formulas(spark, d):
    n, c = F.col("ord").cast("double"), F.col("confidence")
    return X.segments(spark, d).select("slide_id", "ord", S.proposal(c, (F.col("ord") % 4).cast("double")).alias("proposal"), S.attachment(c, n).alias("attachment"), S.container(n).alias("container"), S.failure_reason(F.col("ord") % 3, (F.col("ord") % 3 > 1).cast("int")).alias("reason"))
