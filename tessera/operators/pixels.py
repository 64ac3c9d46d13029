"""Pixel kernels on picture planes (PIX-1..14), in numpy alone, one picture at a time inside mapInPandas.

Thresholds, medians, box means, morphology and components are exact integer algorithms. Rectangles come from holes and components and line segments from
runs of ink, which finds axis-parallel ones only; that stands in for contour approximation and a probabilistic line transform, whose results depend on a native library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kinds as K

PLANE = "slide_id long, height int, width int, pixels binary"
REGION = "slide_id long, layer string, n int, x0 double, y0 double, x1 double, y1 double, confidence double, role string, ink long"


def gray(rgb: np.ndarray) -> np.ndarray:
    """Luma of 8-bit RGB, rounded as fixed-point codecs do."""
    return ((rgb[..., 0].astype(np.int64) * 4899 + rgb[..., 1].astype(np.int64) * 9617 + rgb[..., 2].astype(np.int64) * 1868 + 8192) >> 14).astype(np.uint8)


def branches(rgb: np.ndarray) -> dict[str, np.ndarray]:
    """The five planes of a picture: RGB, a copy for style, and three gray ones."""
    g = gray(rgb)
    return {"rgb": rgb, "style": rgb.copy(), "structure": g, "text": g.copy(), "canvas": g.copy()}


def otsu(plane: np.ndarray) -> int:
    """The level that splits the histogram with the largest variance between classes."""
    n = np.bincount(plane.ravel(), minlength=256).astype(np.float64)
    weight, total = np.cumsum(n), np.cumsum(n * np.arange(256))
    below, above = weight, weight[-1] - weight
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (total / below - (total[-1] - total) / above) ** 2
    return int(np.nan_to_num(between, nan=-1.0, posinf=-1.0).argmax())


def ink(plane: np.ndarray) -> np.ndarray:
    """True where darker than the split; a plain plane has none."""
    return plane <= otsu(plane) if plane.size and plane.min() != plane.max() else np.zeros(plane.shape, bool)


def _shifts(mask: np.ndarray, h: int, w: int, fill) -> Iterator[np.ndarray]:
    padded = np.pad(mask, ((h // 2, h - 1 - h // 2), (w // 2, w - 1 - w // 2)), constant_values=fill)
    return (padded[y : y + mask.shape[0], x : x + mask.shape[1]] for y in range(h) for x in range(w))


def median3(mask: np.ndarray) -> np.ndarray:
    return sum(s.astype(np.int64) for s in _edge_shifts(mask)) >= 5


def _edge_shifts(mask: np.ndarray) -> Iterator[np.ndarray]:
    padded = np.pad(mask, 1, mode="edge")
    return (padded[y : y + mask.shape[0], x : x + mask.shape[1]] for y in range(3) for x in range(3))


def dilate(mask: np.ndarray, h: int, w: int) -> np.ndarray:
    out = np.zeros_like(mask)
    for row in _shifts(mask, 1, w, False):
        out |= row
    tall, out = out, np.zeros_like(mask)
    for column in _shifts(tall, h, 1, False):
        out |= column
    return out


def erode(mask: np.ndarray, h: int, w: int) -> np.ndarray:
    return ~dilate(~mask, h, w)


def closed(mask: np.ndarray, n: int) -> np.ndarray:
    return erode(dilate(mask, n, n), n, n)


def opened(mask: np.ndarray, n: int) -> np.ndarray:
    return dilate(erode(mask, n, n), n, n)


def components(mask: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int, int]]]:
    """8-connected labels (0 is background) and (x, y, w, h, area) of each, in scan order. Works on horizontal runs with a union of touching ones."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    parent = list(range(len(row)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = int(first[y - 1]), int(first[y])
        while i < first[y] and j < first[y + 1]:
            if start[i] <= end[j] and start[j] <= end[i]:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    labels, names, stats = np.zeros((h, w), np.int32), {}, []
    for i in range(len(row)):
        k = names.setdefault(find(i), len(names) + 1)
        labels[row[i], start[i] : end[i]] = k
        if k > len(stats):
            stats.append([start[i], row[i], end[i], row[i] + 1, 0])
        s = stats[k - 1]
        s[0], s[2], s[3], s[4] = min(s[0], start[i]), max(s[2], end[i]), row[i] + 1, s[4] + end[i] - start[i]
    return labels, [(int(a), int(b), int(c - a), int(d - b), int(n)) for a, b, c, d, n in stats]


def box_mean(plane: np.ndarray, n: int) -> np.ndarray:
    """Mean of the n by n neighbourhood; the border is mirrored without its edge."""
    p = np.pad(plane.astype(np.float64), n // 2, mode="reflect")
    c = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (c[n:, n:] - c[:-n, n:] - c[n:, :-n] + c[:-n, :-n]) / (n * n)


def local_deviation(plane: np.ndarray, n: int = 9) -> np.ndarray:
    p = plane.astype(np.float64)
    return np.sqrt(np.maximum(box_mean(p * p, n) - box_mean(p, n) ** 2, 0))


def blurred(mask: np.ndarray, sigma: float = 1.2) -> np.ndarray:
    r = max(1, int(round(4 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    mode = "reflect" if min(mask.shape) > r else "edge"
    p = np.pad(mask.astype(np.float64), r, mode=mode)
    p = sum(k * p[i : i + mask.shape[0], :] for i, k in enumerate(kernel))
    return np.clip(sum(k * p[:, i : i + mask.shape[1]] for i, k in enumerate(kernel)), 0, 1)


def soft_masked(plane: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Towards white by the mask, cut to whole numbers."""
    return np.clip(plane * (1 - mask) + 255 * mask, 0, 255).astype(np.uint8)


def subtracted(plane: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.where(mask > 0, np.uint8(255), plane)


def residual(*masks: np.ndarray) -> np.ndarray:
    """Largest of the masks at each place."""
    return np.maximum.reduce(masks)


def padded_box(x: int, y: int, w: int, h: int, shape: tuple[int, int], padding: int) -> tuple[int, int, int, int]:
    return max(0, x - padding), max(0, y - padding), min(shape[1], x + w + padding), min(shape[0], y + h + padding)


def _mask_of(boxes: list, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    for x0, y0, x1, y1, *_ in boxes:
        out[y0:y1, x0:x1] = 1
    return out


def text_boxes(plane: np.ndarray) -> list[tuple]:
    """(x0, y0, x1, y1, confidence, ink) of text-like components."""
    h, w = plane.shape
    dark = median3(ink(plane))
    _, stats = components(dilate(dark, 3, max(3, w // 80)))
    out = []
    for x, y, cw, ch, area in stats:
        if area < max(9, h * w // 4000) or cw < 4 or ch < 4 or ch > max(8, int(h * 0.18)) or cw > int(w * 0.92):
            continue
        n = int(dark[y : y + ch, x : x + cw].sum())
        if 0.03 <= n / (cw * ch) <= 0.85:
            out.append((*padded_box(x, y, cw, ch, plane.shape, max(1, min(h, w) // 120)), min(0.95, 0.35 + 0.9 * n / (cw * ch)), n))
    return out


def saturation(rgb: np.ndarray) -> np.ndarray:
    high, low = rgb.max(-1).astype(np.float64), rgb.min(-1).astype(np.float64)
    return np.where(high > 0, 255 * (high - low) / np.maximum(high, 1), 0)


def picture_boxes(rgb: np.ndarray, text_mask: np.ndarray) -> list[tuple]:
    """(x0, y0, x1, y1, confidence, area) of textured regions outside text."""
    plane = gray(rgb)
    h, w = plane.shape
    deviation = local_deviation(plane)
    labels, stats = components(opened(closed((deviation > 18) & (text_mask <= 0.10), 7), 3))
    out = []
    for k, (x, y, cw, ch, area) in enumerate(stats, 1):
        if area < max(64, h * w // 80) or cw < 12 or ch < 12 or area / (cw * ch) < 0.38:
            continue
        part = rgb[y : y + ch, x : x + cw]
        spread = float(deviation[y : y + ch, x : x + cw][labels[y : y + ch, x : x + cw] == k].mean())
        palette, colour = len(np.unique(part.reshape(-1, part.shape[-1]), axis=0)), float(saturation(part).mean())
        if not (colour < 18 and palette < 128) and not (palette < 12 and spread < 26):
            out.append((*padded_box(x, y, cw, ch, plane.shape, max(1, min(h, w) // 100)), min(0.96, 0.42 + max(0.0, spread - 18) / 36), area))
    return out


def component_boxes(plane: np.ndarray) -> list[tuple]:
    mask = ink(plane)
    return [(x, y, x + w, y + h, 1.0, n) for x, y, w, h, n in components(mask)[1] if n >= max(18, mask.size // 500) and w >= 6 and h >= 6]


def proposal_foci(parts: list[tuple], texts: list[tuple], shape: tuple[int, int]) -> list[tuple[int, int, int, int]]:
    """The focus of each ink component, as plans.convert.detect_flow has it: its box with a margin and the texts that touch it, within the picture."""
    h, w = shape
    margin, out = max(6.0, min(h, w) / 32), []
    for x0, y0, x1, y1, *_ in parts:
        a, b, c, d = x0 - margin, y0 - margin, x1 + margin, y1 + margin
        near = [t[:4] for t in texts if t[0] <= c and t[2] >= a and t[1] <= d and t[3] >= b]
        low, high = np.min([(a, b), *(t[:2] for t in near)], axis=0), np.max([(c, d), *(t[2:] for t in near)], axis=0)
        out.append((max(0, round(low[0])), max(0, round(low[1])), min(w, round(high[0])), min(h, round(high[1]))))
    return list(dict.fromkeys(out))


def node_boxes(plane: np.ndarray, focus: tuple[int, int, int, int]) -> list[tuple]:
    """Boxes in the focus, by its own threshold: outlined ones (background components it encloses that fill their box) and filled ones (ink that fills its box).

    Background that touches an edge of the focus is outside; ink that an edge inside the picture cuts is whole in another focus.
    """
    x0, y0, x1, y1 = focus
    crop = plane[y0:y1, x0:x1]
    if not crop.size:
        return []
    whole = (x1 - x0) * (y1 - y0)
    dark = ink(crop)
    out = []
    for filled, mask in ((False, ~dark), (True, dark)):
        for x, y, w, h, area in components(mask)[1]:
            edges = (x == 0, y == 0, x + w == crop.shape[1], y + h == crop.shape[0])
            cut = (x0 > 0, y0 > 0, x1 < plane.shape[1], y1 < plane.shape[0])
            outer = any(e and c for e, c in zip(edges, cut, strict=True)) if filled else any(edges)
            if not outer and w >= 18 and h >= 16 and area >= max(120.0, 0.035 * whole) and area / (w * h) >= 0.5 and w * h < (0.85 if filled else 0.96) * whole:
                out.append((x0 + x, y0 + y, x0 + x + w, y0 + y + h, area / (w * h), area))
    return out


def segments(mask: np.ndarray, least: int | None = None, gap: int = 6) -> list[tuple[int, int, int, int]]:
    """Axis-parallel segments (xa, ya, xb, yb): runs of ink with gaps of at most `gap`, of a minimal length."""
    least = least or max(12, min(mask.shape) // 14)
    out = []
    for flip in (False, True):
        m = mask.T if flip else mask
        for y in range(m.shape[0]):
            at = np.flatnonzero(m[y])
            if len(at):
                cut = np.flatnonzero(np.diff(at) > gap + 1)
                for a, b in zip(at[np.concatenate(([0], cut + 1))], at[np.append(cut, len(at) - 1)], strict=True):
                    if b - a >= least:
                        out.append((y, int(a), y, int(b)) if flip else (int(a), y, int(b), y))
    return out


def arrow_signal(mask: np.ndarray, end: tuple[int, int], anchor: tuple[int, int], horizontal: bool, radius: int = 7) -> bool:
    """Three ink pixels or more on both sides of the axis just beyond an end point."""
    m, (x, y), (ax, _) = (mask, end, anchor) if horizontal else (mask.T, end[::-1], anchor[::-1])
    x0, x1 = (x + 1, x + radius + 1) if x >= ax else (x - radius, x)
    patch = m[max(0, y - radius) : y + radius + 1, max(0, x0) : max(0, x1)]
    middle = y - max(0, y - radius)
    return bool(patch.size) and int(patch[:middle].sum()) >= 3 and int(patch[middle + 1 :].sum()) >= 3


def arrow_hints(mask: np.ndarray) -> list[tuple[float, float]]:
    """Centroids of small components whose ink fills about half their box, as triangles do."""
    labels, stats = components(mask)
    out = []
    for k, (x, y, w, h, n) in enumerate(stats, 1):
        if 10 <= n <= 240 and 0.4 <= n / (w * h) <= 0.7:
            ys, xs = np.nonzero(labels[y : y + h, x : x + w] == k)
            out.append((float(x + xs.mean()), float(y + ys.mean())))
    return out


def drawing(seed: int, width: int = 320, height: int = 160) -> np.ndarray:
    """Two outlined boxes, a line between them with an arrow head, words, and a noise patch."""
    rng = np.random.Generator(np.random.PCG64(seed))
    rgb = np.full((height, width, 3), 255, np.uint8)

    def frame(x0: int, y0: int, x1: int, y1: int) -> None:
        for a, b, c, d in ((x0, y0, x1, y0 + 2), (x0, y1 - 2, x1, y1), (x0, y0, x0 + 2, y1), (x1 - 2, y0, x1, y1)):
            rgb[b:d, a:c] = 0

    shift = int(rng.integers(0, 12))
    frame(20, 40 + shift, 96, 90 + shift)
    frame(164, 40 + shift, 236, 90 + shift)
    middle = 65 + shift
    rgb[middle : middle + 2, 96:160] = 0
    for i in range(7):
        rgb[middle - i : middle + i + 2, 162 - i - 1 : 162 - i] = 0
    for x in (34, 178):
        for i in range(5):
            rgb[58 + shift : 66 + shift, x + 9 * i : x + 9 * i + 5] = 40
    rgb[100:150, 268:318] = rng.integers(0, 256, (50, 50, 3), dtype=np.uint8)
    return rgb


def drawings(slides: DataFrame) -> DataFrame:
    """A picture of each slide_id and seed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for lo in range(0, len(pdf), 64):
                part = pdf.iloc[lo : lo + 64]
                made = [drawing(int(s)) for s in part.seed]
                yield pd.DataFrame({"slide_id": part.slide_id.to_numpy(), "height": [p.shape[0] for p in made], "width": [p.shape[1] for p in made], "pixels": [p.tobytes() for p in made]})

    return slides.select("slide_id", "seed").mapInPandas(run, PLANE)


def picture_rows(rgb: np.ndarray) -> list[tuple]:
    """(layer, box, confidence, ink) of all layers of one picture."""
    planes = branches(rgb)
    text = text_boxes(planes["text"])
    text_mask = blurred(_mask_of(text, planes["text"].shape)) if text else np.zeros(planes["text"].shape)
    picture = picture_boxes(planes["style"], text_mask)
    canvas = subtracted(soft_masked(planes["canvas"], text_mask), residual(_mask_of(picture, planes["canvas"].shape)))
    parts = component_boxes(canvas)
    node = list({n[:4]: n for focus in proposal_foci(parts, text, canvas.shape) for n in node_boxes(canvas, focus)}.values())
    mask = ink(canvas)
    found = segments(mask)
    lines = [(a, b, c + 1, d + 1, 1.0, max(c - a, d - b) + 1) for a, b, c, d in found]
    tips = [(x, y, x, y, 1.0, 1) for x, y in arrow_hints(mask)]
    for a, b, c, d in found:
        ends = ((a, b), (c, d))
        tips += [(*e, *e, 1.0, 1) for e, o in (ends, ends[::-1]) if arrow_signal(mask, e, o, b == d)]
    layers = (("text", text), ("picture", picture), ("component", parts), ("node", node), ("segment", lines), ("hint", tips))
    return [(layer, *r) for layer, rows in layers for r in rows]


def regions(pictures: DataFrame) -> DataFrame:
    """REGION rows of all pictures; roles of texts are plain columns."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for slide, h, w, pixels in zip(pdf.slide_id, pdf.height, pdf.width, pdf.pixels, strict=True):
                n: dict[str, int] = {}
                for layer, x0, y0, x1, y1, c, i in picture_rows(np.frombuffer(pixels, np.uint8).reshape(h, w, 3)):
                    n[layer] = n.get(layer, 0) + 1
                    out.append((slide, layer, n[layer], x0, y0, x1, y1, c, i, h, w))
            yield pd.DataFrame(out, columns=["slide_id", "layer", "n", "x0", "y0", "x1", "y1", "confidence", "ink", "height", "width"])

    found = pictures.mapInPandas(run, "slide_id long, layer string, n int, x0 double, y0 double, x1 double, y1 double, confidence double, ink long, height int, width int")
    role = F.when(F.col("layer") == "text", K.text_role(G.box("x0", "y0", "x1", "y1"), F.col("width").cast("double"), F.col("height").cast("double")))
    return found.select(*("slide_id layer n x0 y0 x1 y1 confidence".split()), role.alias("role"), "ink")
