"""Operator 5: substring deduplication by relative Lempel-Ziv factors.

The reference is the corpus, each word window (35 words) at one place: of a window that occurs more than once, its occurrence with the smallest key; for
that occurrence itself, the one with the largest. A document is parsed greedily from its first word: a factor is the longest match with the reference from
the current word on, and the parse goes on behind it. As a window has one place in the reference, the longest match is the chain of windows whose places
follow one another. Factors of 35 words or more are duplicate spans. Windows across a factor's end may occur somewhere else as a whole, so each of them is checked by
its own place: where it has one, it is a duplicate span too.

Parsing against every block of the reference would cost documents times blocks, so the blocks are indexed: each window is assigned the smallest of its
16-word grams, an anchor, and equal windows have equal anchors. The occurrences of one anchor, with the words around each, are a block, and a document meets only the blocks
of its own anchors.

* A block with one occurrence holds no repeat. A block whose occurrences all have the same surroundings has one place for the whole run.
* In any other block, and where a run may repeat itself, each window is looked up by its own hash. A document sends each of its windows once, so a word
  said a million times makes no hot key.

Anchors and windows are counted with partial aggregation and joined (adaptive skew joins split hot ones), so a passage in a third of all documents
meets in no single task; no pair of documents is ever made.

Defined cases: a null or empty text has no words; repeated rows, also with a null doc_id, are repeats of each other; texts of any length are parsed whole; an empty table gives an
empty result; other columns, whatever their names, are ignored, or kept by clean().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, checkpointed, plain, restored, row_key, table
from .hashing import U, lists, mix, spread, text_chunks, windows, word_hashes, words

WINDOW, GRAM = 35, 16


@dataclass
class Runs:
    """Maximal runs of consecutive windows with the same anchor."""

    anchor: np.ndarray
    context: np.ndarray  # of all its windows, as a multiset
    inner: np.ndarray  # the anchor stands at several places of the run, so that the run may repeat itself
    doc: np.ndarray
    ordinal: np.ndarray  # within the document
    low: np.ndarray  # first and last window, as word positions in the chunk
    high: np.ndarray


def _least(value: np.ndarray, n: int) -> np.ndarray:
    """Position of the first smallest of the n values from each position."""
    at, size = np.arange(len(value)), 1
    while size < n:
        step = min(size, n - size)
        later = value[step:][: len(value) - step] < value[:-step]
        at = np.where(later, at[step:], at[:-step])
        value = np.where(later, value[step:], value[:-step])
        size += step
    return at


def runs(h: np.ndarray, first: np.ndarray, doc: np.ndarray, window: int, gram: int) -> tuple[Runs, np.ndarray]:
    """Runs of the word hashes `h`, and the hash of each window."""
    whole = mix(windows(h, window))
    n = len(whole)
    valid = np.flatnonzero(np.arange(n) + window <= first[1:][doc[:n]]) if n else np.empty(0, np.int64)
    grams = mix(windows(h, gram))
    at = _least(grams, window - gram + 1)[valid] if n else valid
    least, of = grams[at], doc[valid]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (of[1:] != of[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1 if len(at) else begin
    low, high, of = valid[begin], valid[end], of[begin]
    total = np.concatenate((np.zeros(1, U), np.cumsum(mix(whole[valid] ^ U(1)))))
    context = mix(total[end + 1] - total[begin] + (high - low).astype(U)) if len(at) else np.empty(0, U)
    ordinal = np.arange(len(of)) - np.searchsorted(of, of, "left")
    return Runs(least[begin], context, at[begin] != at[end], of, ordinal, low, high), whole


def _emit_anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in ("k1", "k2"))
            for row, _, data, offsets in text_chunks(batch.column("text")):
                w = words(data, offsets)
                r, _ = runs(word_hashes(data, w), w.first, w.doc, window, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r.anchor.view(np.int64)), pa.array(r.context.view(np.int64)), pa.array(k1[row + r.doc]), pa.array(k2[row + r.doc]), pa.array(r.ordinal.astype(np.int32)), pa.array((r.low - w.first[r.doc]).astype(np.int32)), pa.array(r.inner)],
                    ["a", "c", "k1", "k2", "j", "at", "inner"],
                )

    return run


def _emit_windows(window: int, gram: int):
    """The different windows of each document's runs in mixed blocks, with the first place of each; codes are 2 * ordinal + mixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, codes = batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), lists(batch.column("codes"))
            for row, end, data, offsets in text_chunks(batch.column("text")):
                w = words(data, offsets)
                r, whole = runs(word_hashes(data, w), w.first, w.doc, window, gram)
                start = np.searchsorted(r.doc, np.arange(end - row))
                out = []
                for d, c in enumerate(codes[row:end]):
                    pick = np.sort(start[d] + (c[c & 1 == 1] >> 1))
                    at = spread(r.low[pick], r.high[pick] - r.low[pick] + 1)
                    name, place = np.unique(whole[at], return_index=True)
                    out.append((name, np.full(len(name), k1[row + d]), np.full(len(name), k2[row + d]), (at[place] - w.first[d]).astype(np.int32)))
                name, a, b, at = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(a), pa.array(b), pa.array(at)], ["w", "k1", "k2", "at"])

    return run


@dataclass
class Parse:
    """Greedy factors of a text, as words first..last, the place of the first one in the reference, and the windows across factor ends that are repeated."""

    first: np.ndarray
    last: np.ndarray
    source: np.ndarray
    across_first: np.ndarray
    across_last: np.ndarray


def parse(at: np.ndarray, source: np.ndarray, window: int) -> Parse:
    """From the repeated windows of a text (rising `at`) and the place of each in the reference."""
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(source) != 1)
    begin = np.flatnonzero(new)
    chains = zip(at[begin].tolist(), at[np.append(begin[1:], len(at)) - 1].tolist() if len(at) else [], source[begin].tolist(), strict=True)
    taken, across, free = [], [], 0
    for low, high, place in chains:
        start = max(low, free)
        if start > low:
            across.append((low, min(start - 1, high)))
        if start <= high:
            free = high + window
            taken.append((start, free - 1, place + start - low))
    columns = (np.array(c, np.int64) for c in (*(zip(*taken, strict=True) if taken else ((), (), ())), *(zip(*across, strict=True) if across else ((), ()))))
    first, last, places, across_first, across_last = columns
    return Parse(first, last, places, across_first, across_last + window - 1)


def covered_words(n: int, p: Parse) -> np.ndarray:
    """Which of n words lie in a factor or in a repeated window across a factor's end."""
    step = np.zeros(n + 1, np.int64)
    for first, last in ((p.first, p.last), (p.across_first, p.across_last)):
        np.add.at(step, first, 1)
        np.add.at(step, last + 1, -1)
    return np.cumsum(step[:n]) > 0


def _place(key: int, at: np.ndarray) -> np.ndarray:
    """Place of word `at` of the text with row key `key`: the key's upper half, and the number of the word."""
    return ((key >> 32) << 32) + at


def _located(r: Runs, whole: np.ndarray, base: int, head: int, key: int, codes: np.ndarray, code_places: np.ndarray, starts: np.ndarray, start_places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeated windows of one text, by word, and the reference place of each."""
    plain_, mixed = (codes & 1 == 0), (codes & 1 == 1)
    pick, loose = head + (codes[plain_] >> 1), head + (codes[mixed] >> 1)
    n = r.high[pick] - r.low[pick] + 1
    at = [spread(r.low[pick], n) - base]
    source = [spread(code_places[plain_], n)]
    inside = np.sort(spread(r.low[loose], r.high[loose] - r.low[loose] + 1) - base)
    name, first, back, times = np.unique(whole[base + inside], return_index=True, return_inverse=True, return_counts=True)
    place = np.zeros(len(name), np.int64)
    known = np.searchsorted(name, whole[base + starts])
    place[known] = start_places
    found = np.zeros(len(name), bool)
    found[known] = True
    mine = _place(key, inside[first])[back]
    # a window said twice in this text has its first place here, and that one the next
    order = np.argsort(back, kind="stable")
    following = np.empty(len(inside), np.int64)
    following[order[:-1]] = inside[order[1:]]
    is_first = np.zeros(len(inside), bool)
    is_first[first] = True
    own = np.where(is_first, _place(key, following), mine)
    keep = found[back] | (times[back] > 1)
    at.append(inside[keep])
    source.append(np.where(found[back], place[back], own)[keep])
    at, source = np.concatenate(at), np.concatenate(source)
    at, one = np.unique(at, return_index=True)
    return at, source[one]


def _apply(window: int, gram: int, output: str):
    """Output: digest (DIGEST), texts (that and the text without duplicate spans) or factors (FACTORS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, keys = batch.column("doc_id"), batch.column("text"), batch.column("k2").to_numpy()
            columns = [lists(batch.column(k)) for k in ("codes", "code_places", "starts", "start_places")]
            for row, end, data, offsets in text_chunks(held):
                flagged = any(len(columns[0][i]) for i in range(row, end))
                r = w = whole = None
                if flagged:
                    w = words(data, offsets)
                    r, whole = runs(word_hashes(data, w), w.first, w.doc, window, gram)
                out, parsed = [], []
                raw = data.tobytes()
                for i in range(row, end):
                    text = raw[offsets[i - row] : offsets[i - row + 1]]
                    parts = text.split()
                    if len(columns[0][i]):
                        base, head = int(w.first[i - row]), int(np.searchsorted(r.doc, i - row))
                        p = parse(*_located(r, whole, base, head, int(keys[i]), *(c[i] for c in columns)), window)
                        parsed.append((i, p))
                        cover = covered_words(len(parts), p)
                        kept = b" ".join(compress(parts, ~cover))
                        removed = int(cover.sum())
                        if output == "texts" and removed:
                            text = _cut(text, w.starts[base : base + len(parts)] - offsets[i - row], cover)
                    else:
                        kept, removed = b" ".join(parts), 0
                    out.append((len(parts), removed, hashlib.sha256(kept).hexdigest(), text.decode() if output == "texts" else None))
                if output == "factors":
                    if parsed:
                        doc = ids.take(pa.array(np.repeat([i for i, _ in parsed], [len(p.first) for _, p in parsed])))
                        first, last, source = (np.concatenate([getattr(p, k) for _, p in parsed]) for k in ("first", "last", "source"))
                        yield pa.RecordBatch.from_arrays([doc, pa.array(first), pa.array(last - first + 1), pa.array(source >> 32), pa.array(source & 0xFFFFFFFF)], [c.split()[0] for c in FACTORS.split(", ")])
                    continue
                n_words, removed, digest, texts = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, end - row), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), *([batch.column("rest").slice(row, end - row), pa.array(texts, pa.string())] if output == "texts" else [])],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", *(["rest", "clean_text"] if output == "texts" else [])],
                )

    return run


def _cut(text: bytes, starts: np.ndarray, cover: np.ndarray) -> bytes:
    """The text without the covered words and the white space after each; what stands between other words stays as it is."""
    edge = np.append(starts, len(text))
    edge[0] = 0
    keep = np.append(~cover, False)
    turn = np.flatnonzero(np.diff(np.concatenate(([False], keep)).astype(np.int8)))
    return b"".join(text[edge[a] : edge[b]] for a, b in zip(turn[::2], turn[1::2], strict=True)).rstrip()


def _other(low: str, high: str, own: Column) -> Column:
    """Of the smallest and the largest place of a window the smallest that isn't its own."""
    return F.when(F.col(low) == own, F.col(high)).otherwise(F.col(low))


def located_windows(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Of documents with their row_key(), by k1, k2: the repeated runs (codes) and the repeated windows of mixed blocks (starts), each with its place in the reference."""
    own = F.shiftleft(F.shiftright("k2", 32), 32) + F.col("at")
    # parsed twice (to count and to join): a table of all anchors would be larger than the texts
    anchors = keyed.select("text", "k1", "k2").mapInArrow(_emit_anchors(window, gram), "a long, c long, k1 long, k2 long, j int, at int, inner boolean")
    counted = anchors.groupBy("a").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("inner").alias("inner")).where("n > 1 or inner")
    blocks = counted.select("a", ((F.col("c0") != F.col("c1")) | F.col("inner")).alias("mixed"))
    flagged = checkpointed(anchors.join(blocks, "a").select("a", "k1", "k2", "j", "at", "mixed"))
    places = flagged.where("not mixed").groupBy("a").agg(F.min(own).alias("low"), F.max(own).alias("high"))
    coded = flagged.join(places, "a", "left").select("k1", "k2", F.struct((F.col("j") * 2 + F.col("mixed").cast("int")).alias("code"), F.coalesce(_other("low", "high", own), F.lit(0)).cast("long").alias("place")).alias("x"))
    factors = checkpointed(coded.groupBy("k1", "k2").agg(F.collect_set("x").alias("x"), F.max(F.col("x.code") % 2 == 1).alias("loose")))
    factors = factors.select("k1", "k2", "loose", F.col("x.code").alias("codes"), F.col("x.place").alias("code_places"))
    # `keyed` as it is, with all its columns, so that this join and the last one use one shuffle of the texts
    split = keyed.join(factors.where("loose").select("k1", "k2", "codes"), ["k1", "k2"])
    loose = split.mapInArrow(_emit_windows(window, gram), "w long, k1 long, k2 long, at int")
    again = loose.groupBy("w").agg(F.count("*").alias("n"), F.min(own).alias("low"), F.max(own).alias("high")).where("n > 1").select("w", "low", "high")
    starts = loose.join(again, "w").groupBy("k1", "k2").agg(F.collect_set(F.struct("at", _other("low", "high", own).alias("place"))).alias("y"))
    return factors.drop("loose").join(starts.select("k1", "k2", F.col("y.at").alias("starts"), F.col("y.place").alias("start_places")), ["k1", "k2"], "left")


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
FACTORS = "doc_id long, start long, length long, source_key long, source_start long"


def _applied(keyed: DataFrame, window: int, gram: int, output: str, schema: str | T.StructType, how: str = "left") -> DataFrame:
    return keyed.join(located_windows(keyed, window, gram), ["k1", "k2"], how).mapInArrow(_apply(window, gram, output), schema)


def substring_digest(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """DIGEST for each row of `docs`."""
    return _applied(plain(docs).select("doc_id", "text", *row_key()), window, gram, "digest", DIGEST)


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The greedy factors (FACTORS) of `docs`, in words; source_key is the upper half of the k2 of the row_key() of the text that holds the match, at source_start."""
    return _applied(plain(docs).select("doc_id", "text", *row_key()), window, gram, "factors", FACTORS, "inner")


def drop_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """DIGEST, rest (the other columns) and clean_text, the text without its duplicate spans."""
    held = carried(docs)
    kinds = [("doc_id", T.LongType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("rest", held.schema["rest"].dataType), ("clean_text", T.StringType())]
    return _applied(held.select("doc_id", "text", "rest", *row_key()), window, gram, "texts", T.StructType([T.StructField(*k) for k in kinds]))


def clean(docs: DataFrame, **options) -> DataFrame:
    """`docs` without repeated words."""
    return restored(drop_substrings(docs, **options), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d) q),
hit AS (SELECT r, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + unnest(range(35)) AS j FROM hit),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS s FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d) q ANTI JOIN gone USING (r, j) GROUP BY r),
cut AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN cut USING (r)
"""
