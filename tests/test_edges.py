"""Edge cases of scene operators, pixel kernels and the stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import kinds as K
from tessera.operators import boxes, matching, pixels, scene, spatial
from tessera.operators import constraints as C
from tessera.operators import evaluation as E
from tessera.streaming import items as S

ITEM = "slide_id long, stage string, id string, kind string, box struct<x0:double,y0:double,x1:double,y1:double>, source_ids array<string>, attachment_ids array<string>, score double, bucket string, evaluable boolean, ord int"


def B(*v):
    return tuple(map(float, v))


def item(stage, id_, kind, box, attached=(), score=1.0, bucket="other", evaluable=True, slide=1):
    return (slide, stage, id_, kind, box, [], list(attached), score, bucket, evaluable, int("".join(c for c in id_ if c.isdigit()) or 0))


def values(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_geometry_bounds(spark):
    a, touching, inverted, none = (G.box(*map(F.lit, b)) for b in ((0, 0, 10, 10), (10, 0, 20, 10), (5, 5, 1, 9), (0, 0, 0, 0)))
    null = F.lit(None).cast(G.BOX)
    r = values(spark, o=G.overlaps(a, touching), p=G.contains_point(a, G.point(10, 10)), w=G.width(inverted), s=G.iou(a, null), c=G.connector_similarity(null, a), i=G.inset(a, 5.0), z=G.iou(none, none), rel=G.containment(null, a))
    assert (r.o, r.p, r.w, r.s, r.c, tuple(r.i), r.z, r.rel) == (False, True, 0, 0, 0, (0, 0, 10, 10), 0, "none")
    half = G.signature(G.box(F.lit(0.5), F.lit(1.5), F.lit(2.5), F.lit(3.5)))
    swapped = [G.segment_key(G.point(*p), G.point(*q)) for p, q in (((1, 2), (30, 4)), ((30, 4), (1, 2)))]
    r = values(spark, h=half, k=swapped[0] == swapped[1], e=G.path_box(F.array().cast(f"array<{G.POINT}>")), diagonal=G.orientation(G.point(0, 0), G.point(9, 9)))
    assert (tuple(r.h), r.k, r.e, r.diagonal) == ((0, 2, 2, 4), True, None, "diagonal")


def test_greedy_order_and_large_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(1, "07_emit", f"g{rng.integers(40):02}", f"a{rng.integers(40):02}", float(rng.integers(1, 6)), "other", "container") for _ in range(900)]
    rows = list({(r[2], r[3]): r for r in rows}.values())
    used_g, used_a, want = set(), set(), set()
    for r in sorted(rows, key=lambda r: (-r[4], r[2], r[3])):
        if r[2] not in used_g and r[3] not in used_a:
            used_g.add(r[2])
            used_a.add(r[3])
            want.add((r[2], r[3]))
    df = spark.createDataFrame(rows, matching.MATCH)
    assert {(r.gt_id, r.artifact_id) for r in matching.greedy_match(df).collect()} == want


def test_folded_matches_are_the_greedy_ones(spark):
    rng = np.random.default_rng(1)
    rows = {(int(rng.integers(3)), f"g{rng.integers(20):02}", f"a{rng.integers(20):02}"): float(rng.integers(1, 6)) for _ in range(500)}
    df = spark.createDataFrame([(s, "07_emit", g, a, x, "other", "container") for (s, g, a), x in rows.items()], matching.MATCH)
    want = sorted(tuple(r) for r in matching.greedy_match(df).collect())
    assert sorted(tuple(r) for r in matching.folded_matches(df).select(*df.columns).collect()) == want and want


def test_measured_is_the_similarity_in_steps(spark):
    rng = np.random.default_rng(2)
    box = lambda: None if rng.random() < 0.1 else (lambda x, y, w, h: B(x, y, x + w, y + h))(*rng.integers(0, 40, 2), *rng.integers(-2, 40, 2) / 3)
    rows = [(str(rng.choice(["connector", "container", "textbox"])), box(), box()) for _ in range(3000)]
    pairs = spark.createDataFrame(rows, f"kind string, one {G.BOX}, other {G.BOX}")
    whole = K.stage_similarity(F.col("kind"), F.col("one"), F.col("kind"), F.col("other"))
    found = matching.measured(pairs.withColumn("whole", whole), "one", "other")
    assert found.columns == ["kind", "one", "other", "whole", "similarity"]
    got = [(r.whole, r.similarity) for r in found.collect()]
    assert all(a == b for a, b in got) and len({a for a, _ in got}) > 500


def test_contextual_ties_within_rounding(spark):
    left = spark.createDataFrame([item("", "g", "box", B(0, 0, 10, 10))], ITEM)
    wide = [item("", k, "box", B(0, 0, 10, 5.0 + d)) for k, d in (("z", 2e-9), ("a", 0.0), ("m", 1e-9), ("b", -1.0))]
    found = matching.best_contextual(left, spark.createDataFrame(wide, ITEM)).collect()
    assert [r.other.id for r in found] == ["a"]


def test_attachments_and_empty_stages(spark):
    truth = spark.createDataFrame([item("", "g1", "box", B(0, 0, 10, 10), ["a", "b"]), item("", "g2", "box", B(50, 0, 60, 10), ["a"])], ITEM)
    art = spark.createDataFrame([item("07_emit", "p1", "panel", B(0, 0, 10, 10), ["c"]), item("07_emit", "p2", "rect", B(50, 0, 60, 10)), item("07_emit", "p3", "rect", B(50, 0, 60, 10), evaluable=False)], ITEM)
    assert {r.gt_id for r in matching.stage_matches(truth, art, attachment=True).collect()} == {"g2"} and matching.stage_matches(truth, art).count() == 2
    stages = E.stage_table(spark)
    rows = {r.stage: r for r in E.oracle_by_stage(truth, art, matching.stage_matches(truth, art), stages).collect()}
    assert (rows["01_geometry_raw"].recoverable_ratio, rows["07_emit"].recoverable_ratio, rows["07_emit"].artifact_count) == (0.0, 1.0, 2)
    assert {r.tag for r in E.failures_of_truth(truth, art, matching.stage_matches(truth, art, attachment=True)).collect()} == {"wrong_attachment"}
    assert matching.stage_matches(truth, art.limit(0)).count() == 0


def test_attrition_skips_what_does_not_apply(spark):
    truth = spark.createDataFrame([item("", "g1", "line", B(0, 0, 100, 4)), item("", "g2", "box", B(0, 0, 9, 9))], ITEM)
    m = spark.createDataFrame([(1, s, "g1", "a", 1.0, "other", "connector") for s in ("01_geometry_raw", "03_objects", "07_emit")], matching.MATCH)
    found = {r.gt_id: r.lost_at for r in E.attrition(truth, m, E.stage_table(spark)).collect()}
    assert found == {"g1": "05_selection", "g2": None}


def test_grid_join_equals_plain_join(spark):
    rng = np.random.default_rng(2)
    make = lambda n: [(int(rng.integers(2)), i, (float(x), float(y), float(x + w), float(y + h))) for i, (x, y, w, h) in enumerate(rng.integers(1, 60, (n, 4)))]
    a = spark.createDataFrame(make(60), f"slide_id long, a long, p {G.BOX}")
    b = spark.createDataFrame(make(60), f"slide_id long, b long, q {G.BOX}")
    plain = sorted((r.slide_id, r.a, r.b) for r in spatial.overlap_pairs(a, b, "p", "q").collect())
    assert plain == sorted((r.slide_id, r.a, r.b) for r in spatial.overlap_pairs(a, b, "p", "q", cell=16.0).collect()) and plain


def test_suppression(spark):
    rows = [(1, "big", 1, B(0, 0, 100, 100)), (1, "same", 2, B(0, 0, 100, 99)), (1, "l", 3, B(5, 5, 30, 30)), (1, "r", 4, B(60, 60, 90, 90))]
    df = spark.createDataFrame(rows, f"slide_id long, id string, ord int, box {G.BOX}")
    kept = boxes.suppress(df, ["slide_id"])
    assert {r.id for r in kept.collect()} == {"big", "l", "r"} and {r.id for r in boxes.drop_parents(kept, ["slide_id"]).collect()} == {"l", "r"}


def test_port_at_the_limit_and_one_owner(spark):
    owner = spark.createDataFrame([(1, "o", "node", B(0, 0, 10, 10), 0.8)], f"slide_id long, id string, owner_kind string, box {G.BOX}, confidence double")
    ports = scene.ports(owner)
    e = spark.createDataFrame([(1, "e", "horizontal", (38.0, 5.0), (5.0, 10.0), 0.5, [], [], [])], f"slide_id long, id string, orientation string, a {G.POINT}, b {G.POINT}, confidence double, near_a array<string>, near_b array<string>, near_containers array<string>")
    ranked = scene.rank_ports(e, ports).where("`end` = 'start'").collect()
    assert [(r.port_id, r.gap) for r in ranked] == [("o:port:right", 28.0)]
    assert scene.unattached(e, ports, scene.attach(e, ports)).first().reason == "same_owner_attachment_only"


def test_residuals_emission_and_lossless_diff(spark):
    slides = spark.createDataFrame([(1, 30, 20), (2, 30, 20)], "slide_id long, width int, height int")
    one = spark.createDataFrame([(1, "n", B(0, 0, 5, 5))], f"slide_id long, id string, box {G.BOX}")
    rest = scene.residual_regions(slides, one)
    assert [(r.slide_id, tuple(r.box)) for r in rest.collect()] == [(2, B(0, 0, 30, 20))] and scene.residual_regions(slides, one, preserve=False).count() == 0
    lines = spark.createDataFrame([(1, "c", [(0.0, 0.0), (9.0, 1.0)])], f"slide_id long, id string, path array<{G.POINT}>")
    out = scene.emit(one.limit(0), one, one.limit(0), lines, scene.residuals(one.withColumn("kind", F.lit("x")), rest))
    assert out.count() == 4 and scene.diff_summary(scene.diff(out, out, "path")).where("not lossless").count() == 0
    assert scene.documents(out).where("slide_id = 1").first().records[0].id == "n"


def test_constraints(spark):
    rows = spark.createDataFrame([(1, "a", 0.5, B(0, 0, 1, 1), "s", ["p"], ["x", "y"]), (1, "b", 1.5, B(3, 0, 1, 1), "", [], ["x"])], f"slide_id long, id string, confidence double, box {G.BOX}, source string, provenance array<string>, port_ids array<string>")
    found = {(r.rule, r.id) for r in C.element_rules(rows, "node").collect()}
    assert found == {(f"node.{k}", "b") for k in ("confidence", "box", "source", "provenance")}
    targets = spark.createDataFrame([(1, "x"), (2, "y")], "slide_id long, id string")
    bad = C.foreign_keys(rows, "port_ids", targets, "node.port")
    assert [(r.rule, r.id) for r in bad.collect()] == [("node.port", "a")]
    with pytest.raises(C.ContractViolation, match="node.port: slide 1, a"):
        C.enforce(bad)
    assert C.enforce(bad.limit(0)).count() == 0
    planes = spark.createDataFrame([(1, "rgb", 2, 2, 3, bytes(12)), (1, "text", 2, 2, 1, bytes(3))], "slide_id long, kind string, height int, width int, channels int, pixels binary")
    assert {r.rule for r in C.bundles(planes, ["rgb", "text", "canvas"]).collect()} == {"bundle.branches", "bundle.shape"}


def test_source_buckets(spark):
    of = lambda *ids: K.bucket(F.array(*map(F.lit, ids)).cast("array<string>"))
    r = values(spark, a=of("rect-candidate:1:snapped"), b=of("grow_fallback"), c=of("grow_fallback", "line-primitive:2"), d=of("x"), e=of(), f=K.bucket(F.lit(None).cast("array<string>")))
    assert tuple(r) == ("geometry_only", "fallback_only", "mixed_geometry_fallback", "other", "other", "other")


def test_pixel_kernels():
    rng = np.random.default_rng(1)
    mask = rng.random((30, 40)) < 0.3
    labels, stats = pixels.components(mask)
    seen = np.zeros_like(labels)
    for y, x in zip(*np.nonzero(mask)):  # flood fill
        if not seen[y, x]:
            todo, k = [(y, x)], seen.max() + 1
            while todo:
                a, b = todo.pop()
                if 0 <= a < 30 and 0 <= b < 40 and mask[a, b] and not seen[a, b]:
                    seen[a, b] = k
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert len(stats) == seen.max() and all(len(np.unique(seen[labels == k])) == 1 for k in range(1, len(stats) + 1)) and sum(s[4] for s in stats) == mask.sum()
    plane = rng.integers(0, 256, (20, 24)).astype(np.uint8)
    p = np.pad(plane.astype(float), 4, mode="reflect")
    assert np.allclose(pixels.box_mean(plane, 9)[3, 5], p[3:12, 5:14].mean()) and pixels.ink(np.full((4, 4), 9, np.uint8)).sum() == 0
    assert (pixels.closed(mask, 3) >= mask)[1:-1, 1:-1].all() and (pixels.opened(mask, 3) <= mask).all()
    assert pixels.soft_masked(np.array([[100]], np.uint8), np.array([[0.5]]))[0, 0] == 177


def test_drawing_is_understood(spark):
    rows = pixels.picture_rows(pixels.drawing(3))
    count = {k: sum(r[0] == k for r in rows) for k in ("text", "picture", "node", "segment")}
    assert count["node"] == 2 and count["picture"] == 1 and count["text"] >= 2 and count["segment"] >= 1
    rgb = pixels.drawing(3)
    line = max((r for r in pixels.segments(pixels.ink(pixels.gray(rgb))) if r[1] == r[3] and 96 <= r[0] < 178 or r[2] > 170), key=lambda r: r[2] - r[0])
    assert line[2] - line[0] >= 60
    df = pixels.regions(pixels.drawings(spark.createDataFrame([(1, 3), (2, 4)], "slide_id long, seed int")))
    assert df.where("layer = 'node'").count() == 4 and df.limit(0).count() == 0


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "box", ["rect-candidate:1"], "2024-01-01 00:01:00", "07_emit"), (1, "b", "text", ["x"], "2024-01-01 01:00:00", "07_emit")], "slide_id long, id string, kind string, source_ids array<string>, written string, stage string")
    rows.withColumn("written", F.col("written").cast("timestamp")).write.partitionBy("stage").json(f"{tmp_path}/in")
    q = S.write(S.bucket_counts(S.read_items(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.kind, r.bucket, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("container", "geometry_only", 1)]


def test_pictures_become_scenes(spark):
    from tessera.plans import convert

    made = convert.convert(pixels.drawings(spark.createDataFrame([(1, 3)], "slide_id long, seed int").coalesce(1)))
    nodes, containers = made["nodes"].count(), made["containers"].count()
    assert nodes >= 2 and containers >= 1 and made["ports"].count() == 4 * (nodes + containers)


def test_small_and_filled_boxes_are_nodes():
    rgb = np.full((800, 1200, 3), 255, np.uint8)
    frames = [(100, 100, 260, 250), (400, 100, 560, 250)]  # lower ones pass as text
    for x0, y0, x1, y1 in frames:
        rgb[y0:y1, x0:x1] = 0
        rgb[y0 + 4 : y1 - 4, x0 + 4 : x1 - 4] = 255
    rgb[173:177, 260:400] = 0
    rgb[500:580, 700:860] = 60
    found = [r[1:5] for r in pixels.picture_rows(rgb) if r[0] == "node"]
    assert sorted(found) == [(104, 104, 256, 246), (404, 104, 556, 246), (700, 500, 860, 580)]
