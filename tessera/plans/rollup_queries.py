"""Queries over evaluation counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kinds as K
from ..sources import artifacts as A
from . import benchmark as B
from . import fixtures as X
from . import rollup as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
I = X.duck(X.ITERATIONS)  # noqa: E741


def register(sql: str | None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


def rows(spark, d):
    return X.frame(spark, d, X.ITERATIONS)


@register(f"SELECT slide, max(iteration) AS iteration FROM ({I}) i GROUP BY 1")
def latest_iteration(spark, d):
    return R.latest_iterations(rows(spark, d))


@register(f"WITH i AS ({I}), l AS (SELECT slide, iteration, CASE WHEN n % 2 = 0 THEN 'main' ELSE 'fallback' END AS root FROM i WHERE n % 5 <> 0), s AS (SELECT DISTINCT slide, iteration FROM i) SELECT s.slide, s.iteration, (SELECT max(root) FROM l WHERE l.slide = s.slide AND l.iteration = s.iteration) AS root FROM s")
def diagnostics_root(spark, d):
    found = rows(spark, d).where("n % 5 <> 0").select("slide", "iteration", F.when(F.col("n") % 2 == 0, "main").otherwise("fallback").alias("root"))
    return R.first_existing(rows(spark, d).select("slide", "iteration").distinct(), found, ["main", "fallback"])


STAGES = f"(SELECT slide, stage, n AS recoverable_count, n + ord % 7 AS ground_truth_count FROM ({I}) i)"


def stages(spark, d):
    return rows(spark, d).select("slide", "stage", F.col("n").alias("recoverable_count"), (F.col("n") + F.col("ord") % 7).alias("ground_truth_count"))


@register(f"SELECT stage, CAST(sum(recoverable_count) AS BIGINT) AS recoverable_count, CAST(sum(ground_truth_count) AS BIGINT) AS ground_truth_count, CASE WHEN sum(ground_truth_count) = 0 THEN 0 ELSE CAST(sum(recoverable_count) AS DOUBLE) / CAST(sum(ground_truth_count) AS DOUBLE) END AS recoverable_ratio FROM {STAGES} s GROUP BY 1")
def rollup_stage(spark, d):
    return R.stage_totals(stages(spark, d))


@register(f"""SELECT coalesce(a.stage, b.stage) AS stage, coalesce(a.kind, b.kind) AS kind, CAST(coalesce(a.n, 0) AS BIGINT) AS recoverable_count, CAST(coalesce(b.n, 0) AS BIGINT) AS ground_truth_count,
  CASE WHEN coalesce(b.n, 0) = 0 THEN 0 ELSE CAST(coalesce(a.n, 0) AS DOUBLE) / CAST(b.n AS DOUBLE) END AS recoverable_ratio
FROM (SELECT stage, concat('k', CAST(n % 5 AS STRING)) AS kind, sum(n) AS n FROM ({I}) i WHERE n % 5 <> 1 GROUP BY 1, 2) a FULL JOIN (SELECT stage, concat('k', CAST(n % 5 AS STRING)) AS kind, sum(n + 1) AS n FROM ({I}) i WHERE n % 5 <> 2 GROUP BY 1, 2) b ON a.stage = b.stage AND a.kind = b.kind""")
def rollup_stage_kind(spark, d):
    i = rows(spark, d).withColumn("kind", F.concat(F.lit("k"), (F.col("n") % 5).cast("string")))
    return R.stage_kind_totals(i.where("n % 5 <> 1"), i.where("n % 5 <> 2").withColumn("n", F.col("n") + 1))


TAGGED = f"(SELECT CASE WHEN n % 4 = 0 THEN NULL ELSE stage END AS kind, CASE WHEN n % 6 = 0 THEN NULL ELSE concat('t', CAST(n % 6 AS STRING)) END AS tag FROM ({I}) i)"


@register(f"SELECT kind, tag, count(*) AS n, CAST(grouping(kind) AS INTEGER) AS overall FROM (SELECT coalesce(kind, 'unknown') AS kind, coalesce(tag, 'unknown') AS tag FROM {TAGGED} t) q GROUP BY GROUPING SETS ((tag), (kind, tag))")
def rollup_tags(spark, d):
    t = rows(spark, d).select(F.when(F.col("n") % 4 != 0, F.col("stage")).alias("kind"), F.when(F.col("n") % 6 != 0, F.concat(F.lit("t"), (F.col("n") % 6).cast("string"))).alias("tag"))
    return R.tag_totals(t).withColumn("overall", F.col("overall").cast("int"))


@register(f"SELECT count(*) AS slide_count, CAST(sum(n) AS BIGINT) AS n, CAST(sum(ord) AS BIGINT) AS ord, sum(CAST(n % 8 AS DOUBLE) / 8) / count(*) AS share_mean FROM ({I}) i")
def rollup_means(spark, d):
    return R.means(rows(spark, d).withColumn("share", (F.col("n") % 8).cast("double") / 8), ["n", "ord"], ["share"])


@register(f"SELECT CASE WHEN coalesce(grow, TRUE) THEN 'grow' ELSE 'no-grow' END || '+' || CASE WHEN coalesce(motifs, TRUE) THEN 'motifs' ELSE 'no-motifs' END AS ablation, count(*) AS n FROM ({I}) i GROUP BY 1")
def ablation_counts(spark, d):
    return rows(spark, d).groupBy(R.ablation(F.col("grow"), F.col("motifs")).alias("ablation")).agg(F.count("*").alias("n"))


@register(f"SELECT stage, CAST(count(*) FILTER (grow) AS BIGINT) AS gt_backed_slide_count, CASE WHEN count(*) FILTER (grow) <= 0 THEN 'no_gt_backed_slides' WHEN count(*) FILTER (grow) = 1 THEN 'single_gt_backed_slide_only' WHEN count(*) FILTER (grow) < 3 THEN 'low_gt_backed_coverage' END AS notice FROM (SELECT concat(stage, '/', CAST(ord % 2000 AS STRING)) AS stage, grow FROM ({I}) q) i GROUP BY 1")
def gt_notice(spark, d):
    i = rows(spark, d).withColumn("stage", F.concat("stage", F.lit("/"), (F.col("ord") % 2000).cast("string")))
    found = i.groupBy("stage").agg(F.count(F.when(F.col("grow"), 1)).alias("gt_backed_slide_count"))
    return found.withColumn("notice", R.coverage_notice(F.col("gt_backed_slide_count")))


@register(f"SELECT count(*) FILTER (gt_available) AS gt_backed_slide_count, count(*) FILTER (NOT coalesce(gt_available, FALSE)) AS gt_unavailable_slide_count, CASE WHEN count(*) FILTER (gt_available) <= 0 THEN 'no_gt_backed_slides' WHEN count(*) FILTER (gt_available) = 1 THEN 'single_gt_backed_slide_only' WHEN count(*) FILTER (gt_available) < 3 THEN 'low_gt_backed_coverage' END AS notice FROM (SELECT grow AS gt_available FROM ({I}) q) i")
def gt_coverage(spark, d):
    return R.coverage(rows(spark, d).select(F.col("grow").alias("gt_available")))


@register(
    f"""WITH s AS (SELECT slide, stage, CAST(sum(recoverable_count) AS DOUBLE) / CAST(sum(ground_truth_count) AS DOUBLE) AS r FROM {STAGES} q WHERE ground_truth_count > 0 GROUP BY 1, 2), p AS (SELECT *, lag(r) OVER (PARTITION BY slide ORDER BY stage) - r AS drop_ FROM s),
dr AS (SELECT slide, stage FROM (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY drop_ DESC, stage) AS n FROM p WHERE drop_ > 0) z WHERE n = 1), mi AS (SELECT slide, stage FROM (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY r, stage) AS n FROM s) z WHERE n = 1),
lo AS (SELECT slide, stage FROM (SELECT slide, stage, row_number() OVER (PARTITION BY slide ORDER BY count(*) DESC, min(ord)) AS n FROM ({I}) i WHERE n % 9 = 0 AND ord % 3 = 0 GROUP BY 1, 2) z WHERE n = 1)
SELECT coalesce(mi.slide, lo.slide) AS slide, coalesce(lo.stage, dr.stage, mi.stage) AS dominant_loss_stage FROM mi LEFT JOIN dr ON dr.slide = mi.slide FULL JOIN lo ON lo.slide = mi.slide"""
)
def dominant_stage(spark, d):
    oracle = stages(spark, d).where("ground_truth_count > 0").groupBy("slide", "stage").agg((F.sum("recoverable_count").cast("double") / F.sum("ground_truth_count").cast("double")).alias("recoverable_ratio"))
    lost = rows(spark, d).where("n % 9 = 0 AND ord % 3 = 0").groupBy("slide", "stage").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    return R.dominant_stage(oracle, lost, "slide")


@register(f"SELECT stage, iteration AS field, concat('k', CAST(n % 3 AS STRING)) AS kind, CASE n % 4 WHEN 0 THEN 'geometry_only' WHEN 1 THEN 'fallback_only' WHEN 2 THEN 'mixed_geometry_fallback' ELSE 'other' END AS bucket, CAST(sum(n) AS BIGINT) AS n FROM ({I}) i GROUP BY 1, 2, 3, 4")
def nested_counters(spark, d):
    bucket = F.element_at(F.array(*map(F.lit, K.BUCKETS)), (F.col("n") % 4 + 1).cast("int"))
    i = rows(spark, d).select("stage", F.col("iteration").alias("field"), F.concat(F.lit("k"), (F.col("n") % 3).cast("string")).alias("kind"), bucket.alias("bucket"), "n")
    return R.nested_totals(i, "stage", "field", "kind", "bucket")


@register(f"SELECT slide, stage, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM ({I}) i GROUP BY 1, 2")
def json_counters(spark, d):
    counted = rows(spark, d).withColumn("m", F.from_json("props", A.COUNTS)).select("slide", "stage", F.explode("m").alias("key", "v"))
    return counted.where("key = 'k'").groupBy("slide", "stage").agg(F.sum("v").alias("k"), F.count("*").alias("n"))


OBJECT = "CASE event_id % 4 WHEN 0 THEN '{{\"id\": \"' || event_id || '\", \"kind\": \"box\", \"bbox\": [' || user_id || ', 1, 50.5, 60], \"source_ids\": [\"grow_fallback\"]}}' WHEN 1 THEN '{{\"id\": \"' || event_id || '\", \"object_type\": \"arrow\", \"bbox\": {{\"x0\": ' || user_id || ', \"y0\": 1, \"x1\": 50.5, \"y1\": 60}}, \"score_total\": 0.25}}' WHEN 2 THEN '{{\"id\": \"' || event_id || '\", \"kind\": \" \", \"evaluable\": false, \"parent_id\": \"\"}}' ELSE '{{\"id\": \"' || event_id || '\", \"kind\": \"text\", \"source_bucket\": \"other\", \"attachments\": [\"a\", \"b\"], \"bbox\": null}}' END"


@register(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'box' WHEN 1 THEN 'arrow' WHEN 2 THEN NULL ELSE 'text' END AS kind, CASE WHEN event_id % 4 < 2 THEN CAST(user_id AS DOUBLE) END AS x0, CASE event_id % 4 WHEN 1 THEN CAST(0.25 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS score,
  CASE event_id % 4 WHEN 0 THEN 'fallback_only' ELSE 'other' END AS bucket, event_id % 4 <> 2 AS evaluable, CASE WHEN event_id % 4 = 3 THEN 2 ELSE 0 END AS n_attached FROM events"""
)
def parse_items(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    item = events.select("event_id", F.expr(OBJECT.replace("{{", "{").replace("}}", "}")).alias("json")).select("event_id", A.parse_item(F.col("json")).alias("i"))
    return item.select("event_id", "i.kind", "i.box.x0", "i.score", "i.bucket", "i.evaluable", F.size("i.attachment_ids").alias("n_attached"))


def report_facts(spark, d):
    """Facts made from the counters: every table of the report, from all rows."""
    i = rows(spark, d)
    k = lambda m, p="k": F.concat(F.lit(p), (F.col("ord") % m).cast("string"))
    bucket = F.element_at(F.array(*map(F.lit, K.BUCKETS)), (F.col("n") % 4 + 1).cast("int")).alias("bucket")
    slides = i.groupBy("slide").agg(F.max("grow").alias("gt_available"), F.min("grow").alias("grow"), F.min("motifs").alias("motifs"), *(F.sum(F.col("n") % (j + 2)).alias(c) for j, c in enumerate(B.COUNTERS)), *((F.sum(F.col("n") % 8) / 64).alias(c) for c in B.RATIOS))
    counts = [F.col("n").alias("recoverable_count"), (F.col("n") + F.col("ord") % 7).alias("ground_truth_count")]
    sides = F.when(F.col("ord") % 2 == 0, "ground_truth").otherwise("predictions").alias("side")
    pairs = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(f).alias("field")) for s, f in [*B.BUCKET_SECTIONS, *B.BUCKET_FIELDS]))
    attribution = i.select("slide", F.element_at(pairs, (F.col("ord") % 8 + 1).cast("int")).alias("p"), F.when(F.col("ord") % 8 >= 3, k(3)).alias("kind"), bucket, "n").select("slide", "p.*", "kind", "bucket", "n")
    return B.facts(
        slides, i.select("slide", "stage", *counts), i.select("slide", "stage", k(3).alias("kind"), *counts), i.select("slide", "stage", bucket, "n"), i.where("ord % 3 = 0").select("slide", F.col("stage").alias("lost_at"), "ord"),
        i.select("slide", sides, F.when(F.col("n") % 4 != 0, F.col("stage")).alias("kind"), F.when(F.col("n") % 6 != 0, k(6, "t")).alias("tag")), i.select("slide", k(3).alias("kind"), F.when(F.col("n") % 6 != 0, k(5, "s")).alias("status")),
        i.select("slide", k(4, "e").alias("effect"), "n"), i.select("slide", k(2, "f").alias("family"), F.element_at(F.array(*map(F.lit, B.MOTIF_COUNTERS)), (F.col("ord") % 5 + 1).cast("int")).alias("counter"), "n"), attribution,
    )


def _k(m: int, p: str = "k") -> str:
    return f"concat('{p}', CAST(ord % {m} AS STRING))"


_BUCKET = "CASE n % 4 " + " ".join(f"WHEN {j} THEN '{b}'" for j, b in enumerate(K.BUCKETS)) + " END"
_PLACES = [*B.BUCKET_SECTIONS, *B.BUCKET_FIELDS]
_FACTS = f"""i AS MATERIALIZED (SELECT * FROM ({I}) q), sl AS MATERIALIZED (SELECT slide, coalesce(bool_or(grow), FALSE) AS backed, coalesce(bool_and(grow), TRUE) AS grow, coalesce(bool_and(motifs), TRUE) AS motifs,
  {', '.join(f'sum(n % {j + 2}) AS {c}' for j, c in enumerate(B.COUNTERS))}, sum(n % 8) / 64.0 AS ratio FROM i GROUP BY 1),
f AS MATERIALIZED (
  SELECT slide, 'slides' AS section, CASE WHEN backed THEN 'gt_backed_slide_count' ELSE 'gt_unavailable_slide_count' END AS a, NULL AS b, NULL AS c, NULL AS d, 1.0 AS n, NULL AS ord FROM sl
  UNION ALL SELECT slide, 'ablation_counts', CASE WHEN grow THEN 'grow' ELSE 'no-grow' END || '+' || CASE WHEN motifs THEN 'motifs' ELSE 'no-motifs' END, NULL, NULL, NULL, 1, NULL FROM sl
  {' '.join(f"UNION ALL SELECT slide, 'counts', '{c}', NULL, NULL, NULL, {c}, NULL FROM sl" for c in B.COUNTERS)}
  {' '.join(f"UNION ALL SELECT slide, 'area', '{c}', NULL, NULL, NULL, ratio, NULL FROM sl" for c in B.RATIOS)}
  UNION ALL SELECT slide, 'stage_oracle', stage, 'recoverable_count', NULL, NULL, n, NULL FROM i UNION ALL SELECT slide, 'stage_oracle', stage, 'ground_truth_count', NULL, NULL, n + ord % 7, NULL FROM i
  UNION ALL SELECT slide, 'stage_oracle_by_kind', stage, {_k(3)}, 'recoverable_count', NULL, n, NULL FROM i UNION ALL SELECT slide, 'stage_oracle_by_kind', stage, {_k(3)}, 'ground_truth_count', NULL, n + ord % 7, NULL FROM i
  UNION ALL SELECT slide, 'stage_oracle_by_source_bucket', stage, {_BUCKET}, NULL, NULL, n, NULL FROM i
  UNION ALL SELECT slide, 'stage_attrition', stage, NULL, NULL, NULL, 1, ord FROM i WHERE ord % 3 = 0
  UNION ALL SELECT slide, 'failure_taxonomy', CASE WHEN ord % 2 = 0 THEN 'ground_truth' ELSE 'predictions' END, CASE WHEN n % 6 = 0 THEN 'unknown' ELSE {_k(6, 't')} END, NULL, NULL, 1, NULL FROM i
  UNION ALL SELECT slide, 'failure_taxonomy_by_kind', CASE WHEN ord % 2 = 0 THEN 'ground_truth' ELSE 'predictions' END, CASE WHEN n % 4 = 0 THEN 'unknown' ELSE stage END, CASE WHEN n % 6 = 0 THEN 'unknown' ELSE {_k(6, 't')} END, NULL, 1, NULL FROM i
  UNION ALL SELECT slide, 'geometry_audit_status_counts', CASE WHEN n % 6 = 0 THEN 'unknown' ELSE {_k(5, 's')} END, NULL, NULL, NULL, 1, NULL FROM i
  UNION ALL SELECT slide, 'geometry_audit_status_counts_by_kind', {_k(3)}, CASE WHEN n % 6 = 0 THEN 'unknown' ELSE {_k(5, 's')} END, NULL, NULL, 1, NULL FROM i
  UNION ALL SELECT slide, 'container_snap_effect_counts', {_k(4, 'e')}, NULL, NULL, NULL, n, NULL FROM i
  {' '.join(f"UNION ALL SELECT slide, 'motif_accounting', {_k(2, 'f')}, '{c}', NULL, NULL, CASE WHEN ord % 5 = {j} THEN n ELSE 0 END, NULL FROM i" for j, c in enumerate(B.MOTIF_COUNTERS))}
  {' '.join(f"UNION ALL SELECT slide, '{name}', {_BUCKET}, NULL, NULL, NULL, n, NULL FROM i WHERE ord % 8 = {j}" for j, name in enumerate(B.BUCKET_SECTIONS.values()))}
  {' '.join(f"UNION ALL SELECT slide, 'source_bucket_counts_by_kind', '{s}', '{x}', {_k(3)}, {_BUCKET}, n, NULL FROM i WHERE ord % 8 = {j + 3}" for j, (s, x) in enumerate(B.BUCKET_FIELDS))}
)"""


@register(
    f"""WITH {_FACTS}, t AS (SELECT section, a, b, c, d, CAST(sum(n) AS DOUBLE) AS n FROM f GROUP BY ALL),
r AS (SELECT a AS stage, max(n) FILTER (b = 'recoverable_count') / max(n) FILTER (b = 'ground_truth_count') AS r FROM t WHERE section = 'stage_oracle' GROUP BY 1),
one AS (SELECT count(*) FILTER (backed) AS backed, count(*) AS every, sum(ratio) AS ratio FROM sl)
SELECT section, a, b, c, d, n, CAST(NULL AS VARCHAR) AS text FROM t WHERE section NOT IN ('slides', 'area')
UNION ALL SELECT 'stage_oracle', stage, 'recoverable_ratio', NULL, NULL, r, NULL FROM r
UNION ALL SELECT section, a, b, 'recoverable_ratio', NULL, CASE WHEN max(n) FILTER (c = 'ground_truth_count') = 0 THEN 0 ELSE max(n) FILTER (c = 'recoverable_count') / max(n) FILTER (c = 'ground_truth_count') END, NULL FROM t WHERE section = 'stage_oracle_by_kind' GROUP BY 1, 2, 3
UNION ALL SELECT 'gt_backed_slide_count', NULL, NULL, NULL, NULL, backed, NULL FROM one UNION ALL SELECT 'gt_unavailable_slide_count', NULL, NULL, NULL, NULL, every - backed, NULL FROM one UNION ALL SELECT 'slide_count', NULL, NULL, NULL, NULL, every, NULL FROM one
UNION ALL SELECT 'gt_coverage_notice', NULL, NULL, NULL, NULL, NULL, CASE WHEN backed <= 0 THEN 'no_gt_backed_slides' WHEN backed = 1 THEN 'single_gt_backed_slide_only' WHEN backed < 3 THEN 'low_gt_backed_coverage' END FROM one
{' '.join(f"UNION ALL SELECT '{c}_mean', NULL, NULL, NULL, NULL, CAST(ratio AS DOUBLE) / every, NULL FROM one" for c in B.RATIOS)}
UNION ALL SELECT 'dominant_loss_stage', NULL, NULL, NULL, NULL, NULL, (SELECT a FROM (SELECT a, count(*) AS n, min(concat(slide, '/', lpad(CAST(ord AS VARCHAR), 18, '0'))) AS first FROM f WHERE section = 'stage_attrition' GROUP BY 1) q ORDER BY n DESC, first LIMIT 1)"""
)
def benchmark_summary(spark, d):
    return B.summary_rows(report_facts(spark, d))


@register(
    f"""WITH {_FACTS}, lo AS (SELECT slide, a FROM (SELECT slide, a, row_number() OVER (PARTITION BY slide ORDER BY count(*) DESC, min(ord)) AS k FROM f WHERE section = 'stage_attrition' GROUP BY 1, 2) q WHERE k = 1),
s AS (SELECT slide, a AS stage, CAST(sum(n) FILTER (b = 'recoverable_count') AS DOUBLE) / CAST(sum(n) FILTER (b = 'ground_truth_count') AS DOUBLE) AS r, sum(n) FILTER (b = 'ground_truth_count') AS g FROM f WHERE section = 'stage_oracle' GROUP BY 1, 2),
z AS (SELECT slide, stage, CASE WHEN g = 0 THEN 0 ELSE r END AS r FROM s), p AS (SELECT *, lag(r) OVER (PARTITION BY slide ORDER BY stage) - r AS drop_ FROM z),
dr AS (SELECT slide, stage FROM (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY drop_ DESC, stage) AS k FROM p WHERE drop_ > 0) q WHERE k = 1), mi AS (SELECT slide, stage FROM (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY r, stage) AS k FROM z) q WHERE k = 1)
SELECT sl.slide, backed AS gt_available, coalesce(lo.a, dr.stage, mi.stage) AS dominant_loss_stage, CAST(native_object_count AS BIGINT) AS native_object_count, CAST((SELECT sum(n) FROM f WHERE f.slide = sl.slide AND section = 'motif_accounting' AND a = 'f0' AND b = 'proposed') AS DOUBLE) AS proposed,
  CAST((SELECT sum(n) FROM f WHERE f.slide = sl.slide AND section = 'container_snap_effect_counts' AND a = 'e1') AS DOUBLE) AS snapped
FROM sl LEFT JOIN lo ON lo.slide = sl.slide LEFT JOIN dr ON dr.slide = sl.slide LEFT JOIN mi ON mi.slide = sl.slide"""
)
def benchmark_slides(spark, d):
    found = report_facts(spark, d)
    reports = B.slide_reports(found, rows(spark, d).select("slide").distinct())
    read = lambda path, kind: F.get_json_object("report", f"$.{path}").cast(kind)
    return reports.select("slide", read("gt_available", "boolean").alias("gt_available"), "dominant_loss_stage", read("native_object_count", "long").alias("native_object_count"), read("motif_accounting.f0.proposed", "double").alias("proposed"), read("container_snap_effect_counts.e1", "double").alias("snapped"))
