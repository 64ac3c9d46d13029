"""Picture files to pixels and back (SRC-1, SNK-3, SNK-10): a PNG codec over zlib and numpy, and overlays of boxes and lines drawn by kernels, slide by slide."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAGIC = b"\x89PNG\r\n\x1a\n"
#: Channels of the colour types that are read.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes from filtered scan lines."""
    lines = np.frombuffer(raw, np.uint8)[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + step), np.uint8)  # a zero line above and a zero pixel to the left
    for y in range(height):
        kind, line, above = int(lines[y, 0]), lines[y, 1:], out[y, step:]
        row = out[y + 1]
        if kind == 0:
            row[step:] = line
        elif kind == 2:
            row[step:] = line + above
        elif kind == 1:
            pixels = line.reshape(-1, step)
            row[step:] = np.cumsum(pixels, axis=0, dtype=np.uint64).astype(np.uint8).reshape(-1)
        else:
            upper = out[y].astype(int)
            for x in range(stride):
                left, up, corner = int(row[x]), int(upper[x + step]), int(upper[x])
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                row[x + step] = (int(line[x]) + guess) & 255
    return out[1:, step:]


def decoded_png(content: bytes) -> np.ndarray | None:
    """RGB of an 8-bit PNG that is not interlaced, over white where it is transparent; None for any other content."""
    if content[:8] != _MAGIC:
        return None
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        return None
    width, height, kind = head[0], head[1], head[3]
    step = _CHANNELS[kind]
    try:
        raw = zlib.decompress(b"".join(data))
    except zlib.error:
        return None
    if len(raw) < height * (width * step + 1):
        return None
    pixels = _unfiltered(raw, height, width * step, step).reshape(height, width, step)
    if kind == 3:
        return None if palette is None else palette[np.minimum(pixels[..., 0], len(palette) - 1)]
    rgb = np.repeat(pixels[..., :1], 3, axis=2) if step < 3 else pixels[..., :3]
    if step in (2, 4):
        alpha = pixels[..., -1:].astype(np.float64) / 255
        rgb = np.rint(rgb * alpha + 255 * (1 - alpha)).astype(np.uint8)
    return np.ascontiguousarray(rgb)


def encoded_png(rgb: np.ndarray) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width, _ = rgb.shape
    lines = np.concatenate((np.zeros((height, 1), np.uint8), rgb.reshape(height, width * 3)), axis=1)
    return _MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


PIXELS = "path string, height int, width int, pixels binary"


def _decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        found = [decoded_png(bytes(c)) for c in pdf.content]
        size = lambda i: [None if p is None else p.shape[i] for p in found]
        yield pd.DataFrame({"path": pdf.path, "height": pd.array(size(0), "Int32"), "width": pd.array(size(1), "Int32"), "pixels": [None if p is None else p.tobytes() for p in found]})


def decoded(files: DataFrame) -> DataFrame:
    """PIXELS of picture files (path, content): RGB, row by row; null where the content is no picture that is read."""
    return files.select("path", "content").mapInPandas(_decode, PIXELS)


def draw_box(rgb: np.ndarray, x0: float, y0: float, x1: float, y1: float, colour: tuple[int, int, int], width: int) -> None:
    height, across, _ = rgb.shape
    a, b, c, d = (int(round(v)) for v in (x0, y0, x1, y1))
    for k in range(width):
        for rows, columns in ((slice(b + k, b + k + 1), slice(a, c)), (slice(d - 1 - k, d - k), slice(a, c)), (slice(b, d), slice(a + k, a + k + 1)), (slice(b, d), slice(c - 1 - k, c - k))):
            top, left = max(rows.start, 0), max(columns.start, 0)
            rgb[top : max(min(rows.stop, height), top), left : max(min(columns.stop, across), left)] = colour


def draw_line(rgb: np.ndarray, x0: float, y0: float, x1: float, y1: float, colour: tuple[int, int, int], width: int) -> None:
    n = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
    x, y = np.rint(np.linspace(x0, x1, n)).astype(int), np.rint(np.linspace(y0, y1, n)).astype(int)
    for dx in range(-(width // 2), width - width // 2):
        for dy in range(-(width // 2), width - width // 2):
            inside = (y + dy >= 0) & (y + dy < rgb.shape[0]) & (x + dx >= 0) & (x + dx < rgb.shape[1])
            rgb[y[inside] + dy, x[inside] + dx] = colour


MARK = "slide_id long, overlay string, shape string, x0 double, y0 double, x1 double, y1 double, red int, green int, blue int, width int"


def marks(rows: DataFrame, overlay: str, colour: tuple[int, int, int], width: int, box: str = "box", shape: str = "box") -> DataFrame:
    """What is drawn for rows with a slide_id: outlines of their boxes, or lines from corner to corner."""
    at = [F.col(f"{box}.{c}").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return rows.where(F.col(box).isNotNull()).select("slide_id", F.lit(overlay).alias("overlay"), F.lit(shape).alias("shape"), *at, *(F.lit(v).alias(n) for v, n in zip((*colour, width), ("red", "green", "blue", "width"), strict=True)))


def path_marks(rows: DataFrame, path: Column, overlay: str, colour: tuple[int, int, int], width: int) -> DataFrame:
    """Lines along the points of a path."""
    steps = F.when(F.size(path) >= 2, F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.struct(F.element_at(path, i).alias("a"), F.element_at(path, i + 1).alias("b"))))
    each = rows.select("slide_id", F.explode(steps).alias("s"))
    box = F.struct(F.col("s.a.x").alias("x0"), F.col("s.a.y").alias("y0"), F.col("s.b.x").alias("x1"), F.col("s.b.y").alias("y1"))
    return marks(each.select("slide_id", box.alias("box")), overlay, colour, width, shape="line")


def overlays(pictures: DataFrame, drawn: DataFrame) -> DataFrame:
    """slide_id, overlay and png: each picture (slide_id, height, width, pixels) with the marks of each overlay that has any. A task holds one picture and its marks."""

    def run(key: tuple, pdf: pd.DataFrame, shapes: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf):
            base = np.frombuffer(pdf.pixels.iloc[0], np.uint8).reshape(int(pdf.height.iloc[0]), int(pdf.width.iloc[0]), 3)
            for name, part in shapes.groupby("overlay", sort=True):
                rgb = base.copy()
                for s in part.sort_values(["shape", "x0", "y0", "x1", "y1"]).itertuples():
                    (draw_line if s.shape == "line" else draw_box)(rgb, s.x0, s.y0, s.x1, s.y1, (s.red, s.green, s.blue), int(s.width))
                out.append((key[0], name, encoded_png(rgb)))
        return pd.DataFrame(out, columns=["slide_id", "overlay", "png"])

    return pictures.select("slide_id", "height", "width", "pixels").groupBy("slide_id").cogroup(drawn.groupBy("slide_id")).applyInPandas(run, "slide_id long, overlay string, png binary")
