"""SQL text for DuckDB that states the operators independently of their DataFrame form. Prefixes name a box's columns, as in `g.x0`."""

from __future__ import annotations

from ..functions import kinds as K
from . import fixtures as X

D = "CAST({} AS DOUBLE)".format


def w(p: str) -> str:
    return f"greatest({D(0)}, {p}x1 - {p}x0)"


def h(p: str) -> str:
    return f"greatest({D(0)}, {p}y1 - {p}y0)"


def area(p: str) -> str:
    return f"({w(p)} * {h(p)})"


def cx(p: str) -> str:
    return f"({p}x0 + {w(p)} / 2)"


def cy(p: str) -> str:
    return f"({p}y0 + {h(p)} / 2)"


def iou(a: str, b: str, pad: float = 0) -> str:
    """By explicit coordinates, padded if asked."""
    c = {f"{p}{k}": f"({q}{k} {'-' if k[1] == '0' else '+'} {pad})" if pad else f"{q}{k}" for p, q in (("a", a), ("b", b)) for k in ("x0", "y0", "x1", "y1")}
    both = f"(greatest({D(0)}, least({c['ax1']}, {c['bx1']}) - greatest({c['ax0']}, {c['bx0']})) * greatest({D(0)}, least({c['ay1']}, {c['by1']}) - greatest({c['ay0']}, {c['by0']})))"
    of = lambda p: f"(greatest({D(0)}, {c[p + 'x1']} - {c[p + 'x0']}) * greatest({D(0)}, {c[p + 'y1']} - {c[p + 'y0']}))"
    union = f"({of('a')} + {of('b')} - {both})"
    return f"(CASE WHEN {both} <= 0 OR {union} <= 0 THEN {D(0)} ELSE {both} / {union} END)"


def overlaps(a: str, b: str) -> str:
    return f"({a}x0 < {b}x1 AND {b}x0 < {a}x1 AND {a}y0 < {b}y1 AND {b}y0 < {a}y1)"


def contains(a: str, b: str) -> str:
    return f"({a}x0 <= {b}x0 AND {a}y0 <= {b}y0 AND {a}x1 >= {b}x1 AND {a}y1 >= {b}y1)"


def touches(a: str, b: str) -> str:
    return f"({overlaps(a, b)} OR ({cx(b)} BETWEEN {a}x0 AND {a}x1 AND {cy(b)} BETWEEN {a}y0 AND {a}y1))"


def axis(p: str) -> str:
    return f"(CASE WHEN {w(p)} >= {h(p)} THEN 'horizontal' ELSE 'vertical' END)"


def connector(a: str, b: str) -> str:
    def along(lo: str, hi: str, size, mid) -> str:
        ref = f"greatest({size(a)}, {size(b)}, {D(1)})"
        share = f"(greatest({D(0)}, least({a}{hi}, {b}{hi}) - greatest({a}{lo}, {b}{lo})) / {ref})"
        orth = f"greatest({D(0)}, {D(1)} - abs({mid(a)} - {mid(b)}) / {D(26)})"
        end = f"greatest({D(0)}, {D(1)} - (abs({a}{lo} - {b}{lo}) + abs({a}{hi} - {b}{hi})) / greatest({D(24)}, {ref} * {D(0.7)}))"
        return f"greatest({iou(a, b, 6)}, {share} * {D(0.55)} + {orth} * {D(0.25)} + {end} * {D(0.20)})"

    return f"(CASE WHEN {axis(a)} <> {axis(b)} THEN {iou(a, b, 8)} * {D(0.5)} WHEN {axis(a)} = 'horizontal' THEN {along('x0', 'x1', w, cy)} ELSE {along('y0', 'y1', h, cx)} END)"


def eval_kind(x: str) -> str:
    some = lambda names: ", ".join(f"'{n}'" for n in names)
    k = f"lower(trim({x}))"
    return f"(CASE WHEN {k} IN ({some(K.CONTAINER_KINDS)}) THEN 'container' WHEN {k} IN ({some(K.CONNECTOR_KINDS)}) THEN 'connector' ELSE {k} END)"


def source_kind(x: str) -> str:
    k = f"lower(trim(coalesce({x}, '')))"
    return f"(CASE WHEN {k} IN ('text', 'textbox', 'text_only') THEN 'textbox' WHEN {k} = '' THEN 'unknown' ELSE {eval_kind(f'coalesce({x}, {chr(39) * 2})')} END)"


def supports(stage: str, kind: str) -> str:
    return f"(CASE {stage} WHEN '01_geometry_raw' THEN {kind} IN ('container', 'connector') WHEN '02_guides' THEN {kind} = 'container' ELSE {kind} IN ('container', 'textbox', 'connector') END)"


def threshold(stage: str, kind: str) -> str:
    early = f"{stage} IN ('01_geometry_raw', '02_guides')"
    return f"(CASE WHEN {kind} = 'connector' THEN CASE WHEN {early} THEN {D(0.46)} ELSE {D(0.54)} END WHEN {early} THEN {D(0.42)} ELSE {D(0.5)} END)"


def similarity(kind: str, a: str, b: str) -> str:
    return f"(CASE WHEN {kind} = 'connector' THEN {connector(a, b)} ELSE {iou(a, b)} END)"


BUCKET = "(CASE WHEN f = 'R' THEN 'geometry_only' WHEN f = 'A' THEN 'mixed_geometry_fallback' WHEN f = 'N' AND ord % 2 = 0 THEN 'fallback_only' ELSE 'other' END)"
STAGES = "(VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(K.STAGES)) + ") AS st(stage_ord, stage)"
BASE = f"""
gt AS MATERIALIZED (SELECT *, {eval_kind('kind')} AS k1, CASE WHEN attached THEN list_sort(list_distinct([att1, att2])) ELSE [] END AS atts FROM ({X.duck(X.TRUTH)}) t),
art AS MATERIALIZED (SELECT *, {eval_kind('kind')} AS k1, {BUCKET} AS bucket, CASE WHEN attached THEN list_sort(list_distinct([att1, att2])) ELSE [] END AS atts FROM ({X.duck(X.ARTIFACTS)}) t)"""


def matched(name: str, attachment: bool = False, stage: str | None = None) -> str:
    """CTEs that end in `name`: the greedy matches, by recursion over the ranked candidates of a slide and stage."""
    also = " AND (len(g.atts) = 0 OR len(a.atts) = 0 OR g.atts = a.atts)" if attachment else ""
    also += f" AND a.stage = '{stage}'" if stage else ""
    return f"""
{name}_c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY slide_id, stage ORDER BY similarity DESC, gt_id, artifact_id, bucket) AS rn FROM (
  SELECT g.slide_id, a.stage, g.id AS gt_id, a.id AS artifact_id, {similarity('g.k1', 'g.', 'a.')} AS similarity, a.bucket, g.k1 AS kind
  FROM gt g JOIN art a ON g.slide_id = a.slide_id AND g.k1 = a.k1 WHERE a.evaluable AND {supports('a.stage', 'g.k1')}{also}) c WHERE similarity >= {threshold('stage', 'kind')}),
{name}_r AS (
  SELECT slide_id, stage, rn, gt_id, artifact_id, similarity, bucket, kind, TRUE AS hit, [gt_id] AS gs, [artifact_id] AS als FROM {name}_c WHERE rn = 1
  UNION ALL
  SELECT c.slide_id, c.stage, c.rn, c.gt_id, c.artifact_id, c.similarity, c.bucket, c.kind, NOT list_contains(r.gs, c.gt_id) AND NOT list_contains(r.als, c.artifact_id),
    CASE WHEN NOT list_contains(r.gs, c.gt_id) AND NOT list_contains(r.als, c.artifact_id) THEN list_append(r.gs, c.gt_id) ELSE r.gs END,
    CASE WHEN NOT list_contains(r.gs, c.gt_id) AND NOT list_contains(r.als, c.artifact_id) THEN list_append(r.als, c.artifact_id) ELSE r.als END
  FROM {name}_r r JOIN {name}_c c ON c.slide_id = r.slide_id AND c.stage = r.stage AND c.rn = r.rn + 1),
{name} AS MATERIALIZED (SELECT slide_id, stage, gt_id, artifact_id, similarity, bucket, kind FROM {name}_r WHERE hit)"""


def best(name: str, attachment_stage: str = "07_emit") -> str:
    """CTE of the best candidate of each ground truth and stage."""
    agree = f"(a.stage <> '{attachment_stage}' OR len(g.atts) = 0 OR len(a.atts) = 0 OR g.atts = a.atts)"
    return f"""
{name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slide_id, stage, gt_id ORDER BY similarity DESC, score DESC, artifact_id DESC) AS rn FROM (
  SELECT g.slide_id, a.stage, g.id AS gt_id, g.k1 AS kind, a.id AS artifact_id, a.score, a.bucket, a.kind AS raw_kind, a.x0, a.y0, a.x1, a.y1, {similarity('g.k1', 'g.', 'a.')} AS similarity,
    {similarity('g.k1', 'g.', 'a.')} >= {threshold('a.stage', 'g.k1')} AND {agree} AS passes
  FROM gt g JOIN art a ON g.slide_id = a.slide_id AND g.k1 = a.k1 WHERE a.evaluable) c) d WHERE rn = 1)"""


def query(*ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {', '.join(x.strip() for x in ctes)} {body}"
