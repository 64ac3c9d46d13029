"""Operator 6: line deduplication by a log-template tree.

The tree has a fixed depth: a line's word count, then its first LEAD words. Words that hold a digit are wildcards from the start. On the path, a word that fewer
than MIN_DOCS different lines of its parent node have is a wildcard too (all such words share one child); a path with more than WILD of them is no leaf.
At a leaf, a position is constant for a line if its word stands there in SHARE of the leaf's different lines, and in MIN_DOCS of them; all other positions are
variable fields. A line whose constants are SIMILAR of its words gets the template (leaf, constants); any other line is a template by itself.
All counts are of different lines, so a line that is copied often makes no word frequent.

A template recurs if it stands in MIN_DOCS different contents. What tells contents apart is the document without the template's line, which the line therefore
cannot supply: of every line, BANDS bands of ROWS minimum hashes over the five-word shingles of all other lines of its document. Documents without a band in common
are different contents; one that shares bands is merged with the least document that it shares one with, so a group of copies, exact or near, is one content or a few
however large it is, and its lines are left to the near-duplicate stage. All lines of recurring templates are dropped, blank and shorter lines (under MIN_WORDS words) never.

The tree is a few tables: words per node, words per leaf and position, both pre-aggregated; no node's lines meet in one task. Templates of fewer than MIN_DOCS lines are left
out before contents are counted, which loses none.

Defined cases: null text has no lines and stays null; repeated rows, and rows with a null doc_id, count once per text and are all cleaned; a document whose lines all go keeps an
empty text; other columns, whatever their names, are kept; very long texts and lines are parsed whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, checkpointed, few, released, restored, row_key, table
from .hashing import DIGIT, U, lists, mix, spread, text_chunks, windows, word_hashes, words

MIN_DOCS, MIN_WORDS, LEAD = 8, 3, 3
#: Wildcards a path may hold; share of a leaf's lines that makes a word constant; share of constants that makes a template.
WILD, SHARE, SIMILAR = 1, 0.25, 0.6
#: Sketch of what surrounds a line.
SHINGLE, BANDS, ROWS = 5, 12, 3
_FIELD, _NONE = U(0x51ED270B7F4A7C15), U(0xFFFFFFFFFFFFFFFF)
LINES = "body long, k1 long, k2 long, line int, n int, words array<int>, keys array<int>"


def surroundings(grams: np.ndarray, line: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Band keys of each line's document without that line, and without lines equal to it. `grams` lie by line (each has one at least), lines by document."""
    begin, first = np.searchsorted(line, np.arange(len(doc))), np.flatnonzero(np.diff(doc, prepend=-1))
    size = np.diff(np.append(first, len(doc)))
    out = np.zeros((len(doc), BANDS), U)
    for r in range(BANDS * ROWS):
        factor, shift = mix(np.array([2 * r + 1, 2 * r + 2], U))
        least = np.minimum.reduceat(grams * (factor | U(1)) + shift, begin)
        whole = np.repeat(np.minimum.reduceat(least, first), size)
        own = least == whole
        other = np.repeat(np.minimum.reduceat(np.where(own, _NONE, least), first), size)
        out[:, r // ROWS] = mix(out[:, r // ROWS] + np.where(own, other, whole))
    return (out >> U(32)).astype(np.uint32).view(np.int32)


def parsed(data: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """Of each line of min_words words at least: body (a hash of all its words), document, number of the line in it, word count, band keys; and all their words, digits masked."""
    w = words(data, offsets)
    h = word_hashes(data, w)
    if not len(h):
        none = np.empty(0, np.int64)
        return none.view(U), none, none, none, np.empty((0, BANDS), np.int32), none.astype(np.int32)
    digits = np.concatenate(([0], np.cumsum(DIGIT[data])))
    masked = np.where(digits[w.ends] > digits[w.starts], _FIELD, h)
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, w.starts)  # over the chunk; documents also end lines
    new = np.ones(len(h), bool)
    new[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(h)))
    doc = w.doc[first]
    place = np.arange(len(h)) - np.repeat(first, size)
    body = mix(mix(np.add.reduceat(mix(masked + place.astype(U)), first)) + size.astype(U))
    # shingles that lie within a line; of a shorter line, the whole line
    of = np.cumsum(new) - 1
    starts = np.flatnonzero(np.where(size[of] >= SHINGLE, place + SHINGLE <= size[of], place == 0))
    grams = np.append(mix(windows(h, SHINGLE)), np.zeros(min(SHINGLE - 1, len(h)), U))[starts]
    short = size[of[starts]] < SHINGLE
    grams[short] = body[of[starts]][short]
    keys = surroundings(grams, of[starts], doc)
    keep = size >= min_words
    at = line[first] - np.searchsorted(breaks, offsets[doc])
    return body[keep], doc[keep], at[keep], size[keep], keys[keep], (masked[spread(first[keep], size[keep])] >> U(32)).astype(np.uint32).view(np.int32)


def _emit(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(k).to_numpy() for k in ("k1", "k2"))
            for row, _, data, offsets in text_chunks(batch.column("text")):
                body, doc, at, size, keys, flat = parsed(data, offsets, min_words)
                ends = np.append(0, np.cumsum(size)).astype(np.int32)
                columns = [
                    pa.array(body.view(np.int64)), pa.array(k1[row + doc]), pa.array(k2[row + doc]), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1))),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in LINES.split(", ")])

    return run


def leaves(different: DataFrame, lead: int = LEAD, min_docs: int = MIN_DOCS) -> DataFrame:
    """body, leaf and size (different lines of the leaf) of the lines `different` (body, n, head: their first words) whose leaf has min_docs of them."""
    at = different.select("body", "head", F.xxhash64("n").alias("node"), F.lit(0).alias("wild"))
    for depth in range(lead):
        worded = at.withColumn("word", F.get("head", F.lit(depth)))
        known = worded.groupBy("node", "word").agg(F.count("*").alias("lines")).where(F.col("lines") >= min_docs).select("node", F.col("word"), F.lit(True).alias("known"))
        step = worded.join(few(checkpointed(known)), ["node", "word"], "left").select("body", "head", F.xxhash64("node", F.when(F.col("known"), F.col("word"))).alias("node"), (F.col("wild") + F.col("known").isNull().cast("int")).alias("wild"))
        step = checkpointed(step.where(F.col("wild") <= WILD))
        if depth:
            released(at)
        at = step
    sizes = at.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") >= min_docs)
    return at.join(sizes, "node").select("body", F.col("node").alias("leaf"), "size")


def _generalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, place, word = (lists(batch.column(k)) for k in ("words", "places", "constants"))
        if not held:
            continue
        size = np.array([len(x) for x in held])
        first = np.cumsum(size) - size
        flat = np.concatenate(held)
        at = np.repeat(first, [len(x) for x in place]) + np.concatenate(place)
        constant = np.zeros(len(flat), bool)
        constant[at[flat[at] == np.concatenate(word)]] = True
        inside = np.arange(len(flat)) - np.repeat(first, size)
        term = np.where(constant, mix(flat.view(np.uint32).astype(U) + (inside.astype(U) << U(32))), U(0))
        name = mix(np.add.reduceat(term, first) + mix(batch.column("leaf").to_numpy().view(U)))
        keep = np.add.reduceat(constant.astype(np.int64), first) >= SIMILAR * size
        yield pa.RecordBatch.from_arrays([batch.column("body").filter(pa.array(keep)), pa.array(name[keep].view(np.int64))], ["body", "template"])


def templates(lines: DataFrame, lead: int = LEAD, min_docs: int = MIN_DOCS) -> DataFrame:
    """body and template of the lines (LINES) whose template has min_docs lines at least."""
    different = checkpointed(lines.groupBy("body").agg(F.count("*").alias("lines"), F.first("n").alias("n"), F.first(F.slice("words", 1, max(lead, 1))).alias("head")))
    inside = checkpointed(leaves(different, lead, min_docs))
    held = checkpointed(lines.select("body", "words").join(few(inside), "body").groupBy("body").agg(F.first("leaf").alias("leaf"), F.first("size").alias("size"), F.first("words").alias("words")))
    counted = held.select("leaf", "size", F.posexplode("words").alias("place", "word")).groupBy("leaf", "place", "word").agg(F.count("*").alias("lines"), F.first("size").alias("size"))
    constant = counted.where((F.col("lines") >= min_docs) & (F.col("lines") >= SHARE * F.col("size")))
    # a position has at most 1 / SHARE constants
    constant = constant.groupBy("leaf").agg(F.collect_list(F.struct("place", "word")).alias("c")).select("leaf", F.col("c.place").alias("places"), F.col("c.word").alias("constants"))
    general = held.join(constant, "leaf").select("body", "leaf", "words", "places", "constants").mapInArrow(_generalise, "body long, template long")
    named = checkpointed(different.select("body", "lines").join(few(checkpointed(general)), "body", "left").select("body", "lines", F.coalesce("template", "body").alias("template")))
    for done in (different, inside, held):
        released(done)
    often = named.groupBy("template").agg(F.sum("lines").alias("lines")).where(F.col("lines") >= min_docs)
    return named.join(often.select("template"), "template").select("body", "template")


def recurring(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """template of those among `found` (template, k1, k2, keys) that stand in min_docs different contents."""
    apart = found.groupBy("template", "k1", "k2").agg(F.min("keys").alias("keys")).select("template", F.xxhash64("keys").alias("id"), "keys").dropDuplicates(["template", "id"])
    apart = checkpointed(apart)
    band = apart.select("template", "id", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("template", "band", "key").alias("key"), "template", "id")
    crowd = band.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("size")).where("size > 1").select("key", "least")
    # a document that shares bands is one with the least document it shares one with
    merged = band.join(crowd, "key").groupBy("template", "id").agg(F.min("least").alias("least"))
    merged = merged.groupBy("template", "least").agg(F.count("*").alias("members")).groupBy("template").agg(F.sum("members").alias("members"), F.count("*").alias("groups"))
    every = apart.groupBy("template").agg(F.count("*").alias("documents")).where(F.col("documents") >= min_docs)
    none = F.lit(0).cast("long")
    return every.join(merged, "template", "left").where(F.col("documents") - F.coalesce("members", none) + F.coalesce("groups", none) >= min_docs).select("template")


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 500):
            part = batch.slice(lo, 500)
            clean, before, gone = [], [], []
            for text, cut in zip(part.column("text").to_pylist(), lists(part.column("cut")), strict=True):
                all_lines = text.split("\n")
                if len(cut):
                    out = set(cut.tolist())
                    text = "\n".join(x for i, x in enumerate(all_lines) if i not in out)
                clean.append(text)
                before.append(len(all_lines) if text or len(cut) else 0)
                gone.append(len(cut))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("doc_id", "k1", "k2", "rest")), pa.array(before, pa.int64()), pa.array(gone, pa.int64()), pa.array(clean, pa.string())], ["doc_id", "k1", "k2", "rest", "n_lines", "n_dropped", "clean_text"])


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS, lead: int = LEAD) -> DataFrame:
    """doc_id, n_lines, n_dropped, clean_text and rest (the other columns) for each row of `docs`."""
    held = carried(docs)
    keyed = held.select("doc_id", "text", "rest", *row_key())
    lines = checkpointed(keyed.select("text", "k1", "k2").mapInArrow(_emit(min_words), LINES))
    found = checkpointed(lines.select("body", "k1", "k2", "line", "keys").join(few(checkpointed(templates(lines, lead, min_docs))), "body"))
    released(lines)  # of the texts' size; the texts themselves are shuffled below
    of = found.select("template", "k1", "k2", "line").join(few(checkpointed(recurring(found, min_docs))), "template")
    cuts = checkpointed(of.groupBy("k1", "k2").agg(F.collect_set("line").alias("cut")))
    released(found)
    kinds = T.StructType([*(T.StructField(k, T.LongType()) for k in ("doc_id", "k1", "k2")), held.schema["rest"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("clean_text", T.StringType())])
    return keyed.join(cuts, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "rest", "text", "cut").mapInArrow(_drop, kinds)


def clean(docs: DataFrame, **options) -> DataFrame:
    """`docs` without the lines of recurring templates."""
    return restored(drop_lines(docs, **options), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("clean_sha256"))
