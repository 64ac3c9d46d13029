"""Operator 7: document fingerprints from Lempel-Ziv phrases.

A text is parsed from left to right into phrases, each the shortest string that is not a phrase yet (LZ78 over characters). The set of phrases is
hashed, and the fingerprint is its minimum-hash signature, COMPONENTS values of 16 bits in hexadecimal. The share of equal components estimates how many phrases two
texts have in common, of all they have: texts that would compress each other are alike.

An edited text begins as the text does, so its parse continues from the text's own at the edit; each is parsed once.

Documents pass in descending order of doc_id: range buckets hold neighbours in that order, the first row of each bucket is also sent to the bucket before it
(after the last, to the first), and a task streams through its buckets with one row in hand. Texts are shuffled once.

Defined cases: a null text is empty; an empty text has no phrases, a fingerprint of its own and likeness 1 to another empty text and 0 to others; rows with equal doc_id come by text,
null ids last; a single row is its own next document; texts of any length are parsed whole; other columns, whatever their names, are ignored; an empty table gives an empty result. Rows
of one doc_id (or of none) are neighbours and share a bucket, which streams row by row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, plain, table
from .hashing import U, mix

COMPONENTS = 128
_POWER = U(0x9E3779B97F4A7C15)
_SALT = mix(np.arange(1, COMPONENTS + 1).astype(U)) | U(1)


def parse(text: str, start: int = 0, phrases: set[str] | None = None, ends: list[int] | None = None) -> tuple[set[str], list[int]]:
    """Phrases of `text` from `start` on, and where each ends; what is left at the end, a known phrase or nothing, adds none.

    The phrase set is closed under prefixes, so the phrase length is found by steps from a guess.
    """
    known, ends = (phrases if phrases is not None else set()), (ends if ends is not None else [])
    at, n, guess = start, len(text), 1
    add, mark = known.add, ends.append
    while at < n:
        end = at + guess
        if text[at:end] in known and end <= n:
            end += 1
            while end <= n and text[at:end] in known:
                end += 1
            if end > n:
                break
        else:
            end = min(end, n)
            while end - at > 1 and text[at : end - 1] not in known:
                end -= 1
            if text[at:end] in known:
                break
        add(text[at:end])
        mark(end)
        guess = end - at
        at = end
    return known, ends


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def phrase_hashes(text: str, bounds: np.ndarray) -> np.ndarray:
    """Hash of text[bounds[i]:bounds[i + 1]] for each i."""
    if len(bounds) < 2:
        return np.empty(0, U)
    points = _code_points(text)[bounds[0] : bounds[-1]].astype(U) + U(1)
    begin, size = bounds[:-1] - bounds[0], np.diff(bounds)
    at = np.arange(len(points)) - np.repeat(begin, size)
    powers = np.multiply.accumulate(np.full(int(size.max()), _POWER, U))
    return mix(np.add.reduceat(mix(points) * powers[at], begin))


def signature(hashes: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Smallest value of each component, over `before` too."""
    out = np.full(COMPONENTS, np.iinfo(np.uint32).max, np.uint32) if before is None else before.copy()
    low = (hashes >> U(32)).astype(np.uint32)
    salt, add = (_SALT >> U(32)).astype(np.uint32) | np.uint32(1), _SALT.astype(np.uint32)
    high = hashes.astype(np.uint32)
    for a in range(0, len(low), 2048):
        x = low[a : a + 2048, None] * salt
        x ^= high[a : a + 2048, None] * add
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def _short(values: np.ndarray) -> np.ndarray:
    return (values ^ (values >> np.uint32(16))).astype(np.uint16)


def encoded(values: np.ndarray, some: bool) -> str:
    return _short(values).astype(">u2").tobytes().hex() if some else "empty"


def likeness(a: str, b: str) -> float:
    """Share of equal components of two fingerprints."""
    if "empty" in (a, b):
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    return float((x == y).mean())


def fingerprint(text: str) -> str:
    _, ends = parse(text)
    return encoded(signature(phrase_hashes(text, np.array([0, *ends]))), bool(text))


def edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n] if n else text


def both(text: str, changed: str, same: int) -> tuple[str, str]:
    """Fingerprints of two texts that begin with the same `same` characters."""
    if not text or text == changed:
        return (fingerprint(text),) * 2
    known, ends = parse(text[:same])
    bounds = np.array([0, *ends])
    base = signature(phrase_hashes(text, bounds))
    last = int(bounds[-1])
    out = []
    for whole, own in ((text, known.copy()), (changed, known)):
        _, more = parse(whole, last, own)
        out.append(encoded(signature(phrase_hashes(whole, np.array([last, *more])), base), bool(whole)))
    return out[0], out[1]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, in order; a bucket ends with guests, the first of which is the row after its last."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    held = None  # bucket, doc_id, text and result so far of the row that waits for its next one
    ended = None
    for batch in batches:
        rows = []
        for bucket, guest, doc, text in zip(*(batch.column(k) for k in ("bucket", "guest", "doc_id", "text")), strict=True):
            bucket, guest, doc = bucket.as_py(), guest.as_py(), doc.as_py()
            if guest and bucket == ended:
                continue
            text = text.as_py()
            if held is not None:
                changed = edited(held[1], text)
                own, other = both(held[1], changed, len(held[1]) - len(held[1]) // 2)
                waiting = [held[0], len(held[1]), hashlib.sha256(changed.encode()).hexdigest(), own, other, likeness(own, other)]
                rows.append((waiting, text))
            held, ended = (None, bucket) if guest else ((doc, text), None)
            if rows and (guest or len(rows) >= 200):
                yield _finish(rows, names)
                rows = []
        if rows:
            yield _finish(rows, names)


def _finish(rows: list, names: list[str]) -> pa.RecordBatch:
    """near_next takes the next row's fingerprint, which the following row of `rows` already has."""
    done = []
    for i, (row, text) in enumerate(rows):
        done.append((*row, likeness(row[3], rows[i + 1][0][3] if i + 1 < len(rows) else fingerprint(text))))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), _KINDS, strict=True)], names)


#: Characters of text that a bucket should hold.
BUCKET = 32 << 20


def _above(x: Column, edges: list[int]) -> Column:
    """How many of the falling `edges` lie above x, found in two steps so that many edges cost their square root a row."""
    longs = lambda v: F.array(*(F.lit(e).cast("long") for e in v)) if v else F.array().cast("array<long>")
    step = max(1, math.isqrt(len(edges)))
    parts = [edges[i : i + step] for i in range(0, len(edges), step)]
    before = lambda v: F.size(F.filter(v, lambda e: e > x))
    part = before(longs([p[0] for p in parts]))
    if not parts:
        return F.lit(0)
    return F.when(part == 0, F.lit(0)).otherwise((part - 1) * step + before(F.element_at(F.array(*map(longs, parts)), F.greatest(part, F.lit(1)))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """RESULT for each row of `docs`."""
    spark = docs.sparkSession
    rows = plain(docs)
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, 2 * partitions(spark), size // BUCKET)
    known = rows.where("doc_id is not null")
    cuts = sorted({int(x) for x in known.select(F.col("doc_id").cast("double").alias("doc_id")).approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)})  # n - 1 numbers at most
    # bucket 0 has the largest ids; the last also has the null ids
    placed = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(_above(F.col("doc_id"), cuts[::-1])))
    heads = sorted((r.bucket, r.head) for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect())  # a row for each bucket
    guests = None
    if heads:
        before = {heads[i][0]: heads[i - 1][0] for i in range(len(heads))}
        to = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
        first = F.create_map(*(F.lit(x).cast("long") if i % 2 else F.lit(x) for b, h in heads if h is not None for i, x in enumerate((b, h)))) if any(h is not None for _, h in heads) else None
        is_head = F.lit(False) if first is None else F.coalesce(F.col("doc_id") == first[F.col("bucket")], F.lit(False))
        alone = [b for b, h in heads if h is None]
        if alone:
            is_head = is_head | (F.col("doc_id").isNull() & F.col("bucket").isin(alone))
        places = F.when(is_head, F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")), F.struct(to[F.col("bucket")].alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest"))))
        guests = placed.withColumn("place", F.explode(places)).select("place.bucket", "place.guest", "doc_id", "text")
    sent = guests if guests is not None else placed.select("bucket", F.lit(False).alias("guest"), "doc_id", "text")
    ordered = sent.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")
    return ordered.mapInArrow(_stream, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
