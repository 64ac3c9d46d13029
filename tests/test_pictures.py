"""Pictures to pixels and back, overlays, and a whole debug run."""

import json
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import pixels
from tessera.plans import debug
from tessera.sources import artifacts as A
from tessera.sources import pictures as P


def png(pixels_, kind, filters, palette=None):
    """A PNG with a filter for each line, by the format's own rules."""
    height, width, step = pixels_.shape
    out, flat = b"", pixels_.reshape(height, width * step).astype(int)
    for y in range(height):
        line = []
        for x in range(width * step):
            a = flat[y, x - step] if x >= step else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - step] if y and x >= step else 0
            near = sorted(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[0][2]
            line.append((flat[y, x] - (0, a, b, (a + b) // 2, near)[filters[y % len(filters)]]) & 255)
        out += bytes([filters[y % len(filters)], *line])
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    packed = zlib.compress(out)
    return P._MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


def test_png_of_every_filter_and_kind():
    rng = np.random.default_rng(0)
    rgb = rng.integers(0, 256, (11, 7, 3)).astype(np.uint8)
    for filters in ([0], [1], [2], [3], [4], [4, 3, 2, 1, 0]):
        assert (P.decoded_png(png(rgb, 2, filters)) == rgb).all()
    assert (P.decoded_png(P.encoded_png(rgb)) == rgb).all()
    assert (P.decoded_png(png(rgb[..., :1], 0, [1, 4])) == rgb[..., :1]).all()
    palette = rng.integers(0, 256, (9, 3)).astype(np.uint8)
    index = rng.integers(0, 9, (5, 6, 1)).astype(np.uint8)
    assert (P.decoded_png(png(index, 3, [2], palette)) == palette[index[..., 0]]).all()
    alpha = np.concatenate((rgb, np.full((11, 7, 1), 0, np.uint8)), axis=2)
    assert (P.decoded_png(png(alpha, 6, [3])) == 255).all()
    for bad in (b"", b"GIF89a", P._MAGIC, P.encoded_png(rgb)[:60], png(rgb, 2, [0])[:-30]):
        assert P.decoded_png(bad) is None or len(bad) > 60


def test_files_become_pixels(spark, tmp_path):
    rgb = np.arange(4 * 5 * 3, dtype=np.uint8).reshape(4, 5, 3)
    (tmp_path / "a.png").write_bytes(P.encoded_png(rgb))
    (tmp_path / "b.jpg").write_bytes(b"not a picture")
    rows = {Path(r.path).name: r for r in P.decoded(A.images(spark, str(tmp_path))).collect()}
    assert (rows["a.png"].height, rows["a.png"].width, bytes(rows["a.png"].pixels)) == (4, 5, rgb.tobytes()) and rows["b.jpg"].pixels is None


def test_overlays(spark):
    blank = spark.createDataFrame([(1, 20, 30, bytes(20 * 30 * 3)), (2, 20, 30, bytes(20 * 30 * 3))], "slide_id long, height int, width int, pixels binary")
    box = F.struct(F.lit(5.0).alias("x0"), F.lit(4.0).alias("y0"), F.lit(50.0).alias("x1"), F.lit(12.0).alias("y1"))
    rows = spark.createDataFrame([(1,), (3,)], "slide_id long").withColumn("box", box)
    lines = rows.withColumn("path", F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(9.0).alias("x"), F.lit(9.0).alias("y"))))
    drawn = P.marks(rows, "boxes", (255, 0, 0), 1).union(P.path_marks(lines, F.col("path"), "lines", (0, 255, 0), 1))
    found = {(r.slide_id, r.overlay): P.decoded_png(bytes(r.png)) for r in P.overlays(blank, drawn).collect()}
    assert set(found) == {(1, "boxes"), (1, "lines")}
    red = found[1, "boxes"][..., 0] == 255
    assert red[4, 5:].all() and red[11, 5:].all() and red[4:12, 5].all() and red.sum() == 2 * 25 + 6
    assert (np.argwhere(found[1, "lines"][..., 1] == 255) == np.repeat(np.arange(10), 2).reshape(10, 2)).all()


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("run"))
    pictures = pixels.drawings(spark.createDataFrame([(1, 3), (2, 8)], "slide_id long, seed int"))
    none = spark.createDataFrame([], "slide_id long")
    return to, debug.debug_run(pictures, to, none, none)


def test_debug_run(spark, run):
    to, paths = run
    assert len(paths) == 11 + 1 + 1 + 5 and all(Path(p).is_dir() for p in paths.values())
    names = {(r.slide_id, r.overlay) for r in spark.read.parquet(paths["overlays"]).collect()}
    assert len({n for _, n in names}) <= 9 and {(1, "instances"), (2, "instances"), (1, "scene"), (1, "emitted")} <= names
    assert spark.read.json(paths["text_regions"]).count() >= 0 and spark.read.json(paths["emit_scene"]).count() > 0
    for name in debug.EVALUATION:
        assert [json.loads(x) for x in spark.read.text(paths[name]).toPandas().value] == [{"status": "unavailable", "gt_available": False, "reason": "ground_truth_missing"}]
