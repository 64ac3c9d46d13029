"""Operator 2: language-model scoring by cross-entropy difference.

Two bigram models of words over one vocabulary, all words of the corpus and the text's end, with the same order and smoothing: the target model counts the texts
that labels mark as good, the background model counts all texts. A document's loss under a model is the mean negative log-probability of its words and its
end; its score is target minus background loss (Moore and Lewis, 2010): the lower, the more it looks like the target. With c for the counts of a model, N for their sum:

    p1(w)     = BACK * c_background(w) / N_background + (1 - BACK) * c(w) / N      (without target texts: the background's)
    p2(w | v) = (c(v, w) + PRIOR * p1(w)) / (c(v) + PRIOR)

The models are as large as the corpus makes them, so they are neither collected nor broadcast. Texts are shuffled once, into batches of some BATCH bytes. A batch sends
the different words and word pairs it holds, with its counts, to buckets by hash (48 bits within a bucket); a bucket sums the counts of all batches and answers each
with the sums in the order it asked; a batch then scores its texts. A word that every text has comes once from each batch, and buckets and batches are of bounded
size whatever the number of rows, so no task holds more than one of either.

Defined cases: null and empty texts, and those of white space, have no tokens and null losses; several labels of a document: good if any is; a null doc_id has no label; repeated rows
count and are scored each; texts of any length count whole; other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, plain, table
from .hashing import U, mix, text_chunks, word_hashes, words

BATCH, BUCKET = 12 << 20, 32 << 20
BACK, PRIOR = 0.1, 8.0
_BEGIN, _END, _PAIR = U(0x2545F4914F6CDD1D), U(0x9E6C63D0876A9A47), U(0xD6E8FEB86659FD93)


def events(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: at each word and at each end of a text with words, the hash of what stands before and of what comes; and the number of words of each text."""
    before, after, count = [], [], []
    for _, _, data, offsets in text_chunks(column):
        w = words(data, offsets)
        h, n = word_hashes(data, w), np.diff(w.first)
        size = np.where(n > 0, n + 1, 0)
        ends = np.cumsum(size)[n > 0]
        come, stood = np.empty(int(size.sum()), U), np.empty(int(size.sum()), U)
        is_end = np.zeros(len(come), bool)
        is_end[ends - 1] = True
        come[is_end], come[~is_end] = _END, h
        stood[1:] = come[:-1]
        stood[ends - size[n > 0]] = _BEGIN
        before.append(stood)
        after.append(come)
        count.append(n)
    whole = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return whole(before, U), whole(after, U), whole(count, np.int64)


def pairs(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + after)


def packed(counts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Counts as bytes, and those that a byte doesn't hold."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255]


def unpacked(small: bytes, large: np.ndarray) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    out[out == 255] = large
    return out


def _columns(table_: pa.Table) -> list[np.ndarray]:
    return [unpacked(table_.column(k)[0].as_py(), np.array(table_.column(f"{k}_large")[0].as_py(), np.int64)) for k in ("background", "target")]


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, rising, and the place of each value among them."""
    found, where = np.unique(x, return_inverse=True)
    return found, where.astype(np.int32)


class Batch:
    """Different words and pairs of a batch, by hash, and where each event finds its own."""

    def __init__(self, text: pa.ChunkedArray) -> None:
        column = text.combine_chunks() if text.num_chunks != 1 else text.chunk(0)
        before, after, self.words = events(column)
        word, self.after = _numbered(after)
        stood, self.before = _numbered(before)
        del before, after
        # events as pairs of places, so that only different pairs are hashed
        pair, self.pair = _numbered(self.before * np.int64(len(word)) + self.after)
        of_pair = pairs(stood[pair // max(len(word), 1)], word[pair % max(len(word), 1)])
        del pair
        self.keys, where = _numbered(np.concatenate((word, stood, of_pair)))
        self.word_at, self.stood_at, self.pair_at = np.split(where, [len(word), len(word) + len(stood)])
        self.size = np.where(self.words > 0, self.words + 1, 0)

    def counts(self, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each key, how often it is in the texts, and in good ones. Words count as what comes; the begin, which never comes, as what stands before."""
        of = np.repeat(good, self.size)
        out = []
        for keep in (slice(None), of):
            total = np.zeros(len(self.keys), np.int64)
            total[self.pair_at] = np.bincount(self.pair[keep], minlength=len(self.pair_at))
            total[self.word_at] = np.bincount(self.after[keep], minlength=len(self.word_at))
            begin = np.flatnonzero(self.keys[self.stood_at] == _BEGIN)
            total[self.stood_at[begin]] = np.bincount(self.before[keep], minlength=len(self.stood_at))[begin]
            out.append(total)
        return out[0], out[1]


ASKED = "bucket int, batch long, keys binary, background binary, background_large array<long>, target binary, target_large array<long>"
TOLD = "batch long, bucket int, background binary, background_large array<long>, target binary, target_large array<long>"


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    names = [c.split() for c in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(names)], names=[n for n, _ in names])


def _ask(bits: int):
    def run(key: tuple, docs: pa.Table) -> pa.Table:
        b = Batch(docs.column("text"))
        total, good = b.counts(docs.column("good").to_numpy())
        edges = np.searchsorted(b.keys >> U(64 - bits), np.arange((1 << bits) + 1).astype(U)) if bits else np.array([0, len(b.keys)])
        inside = ((b.keys << U(bits)) >> U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        rows = []
        for bucket, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if hi > lo:
                rows.append((bucket, key[0].as_py(), inside[lo:hi].tobytes(), *packed(total[lo:hi]), *packed(good[lo:hi])))
        return _rows(rows, ASKED)

    return run


def _tell(key: tuple, asked: pa.Table) -> pa.Table:
    """Sums over all batches, for each in the order of its keys."""
    parts = [asked.slice(i, 1) for i in range(len(asked))]
    keys = []
    for p in parts:
        raw = np.frombuffer(p.column("keys")[0].as_py(), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        keys.append(wide.reshape(-1).view("<u8"))
    _, where = np.unique(np.concatenate(keys), return_inverse=True)
    own = [_columns(p) for p in parts]
    sums = [np.bincount(where, np.concatenate([c[k] for c in own])).astype(np.int64)[where] for k in (0, 1)]
    ends = np.cumsum([len(k) for k in keys])
    rows = []
    for p, lo, hi in zip(parts, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        rows.append((p.column("batch")[0].as_py(), key[0].as_py(), *packed(sums[0][lo:hi]), *packed(sums[1][lo:hi])))
    return _rows(rows, TOLD)


SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double"


def _score(n_background: int, n_target: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not len(docs):
            return _rows([], "doc_id long").append_column("n_tokens", pa.array([], pa.int64())).append_column("target_loss", pa.array([], pa.float64())).append_column("background_loss", pa.array([], pa.float64()))
        b = Batch(docs.column("text"))
        order = np.argsort(told.column("bucket").to_numpy(), kind="stable").tolist()
        sums = [np.concatenate(c) for c in zip(*(_columns(told.slice(i, 1)) for i in order), strict=True)] if order else [np.empty(0, np.int64)] * 2
        if len(sums[0]) != len(b.keys):
            raise RuntimeError("a batch changed between counting and scoring")
        some = b.size > 0
        begin = (np.cumsum(b.size) - b.size)[some]
        base = sums[0][b.word_at] / max(n_background, 1)
        means = []
        for c, n in ((sums[1], n_target), (sums[0], n_background)):
            one = BACK * base + (1 - BACK) * c[b.word_at] / n if n else base
            stood = c[b.stood_at]
            loss = -np.log((c[b.pair_at][b.pair] + PRIOR * one[b.after]) / (stood[b.before] + PRIOR))
            mean = np.zeros(len(b.size))
            mean[some] = np.add.reduceat(loss, begin) / b.size[some] if some.any() else 0
            means.append(pa.array(mean, mask=~some))
        return pa.table([docs.column("doc_id"), pa.array(b.words), *means], names=[c.split()[0] for c in SCORES.split(", ")])

    return run


def _size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
        found = [0, 0, 0]
        for row, end, data, offsets in text_chunks(batch.column("text")):
            n = np.diff(words(data, offsets).first)
            n = np.where(n > 0, n + 1, 0)
            found = [found[0] + len(data), found[1] + int(n.sum()), found[2] + int(n[good[row:end]].sum())]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in found], ["bytes", "background", "target"])


def score(docs: DataFrame, labels: DataFrame, batch: int = BATCH, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score for each row of `docs`; batches and buckets are sized in bytes of text."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("good", F.lit(True))
    marked = plain(docs).join(few(good), "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    size = marked.select("text", "good").mapInArrow(_size, "bytes long, background long, target long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("bytes", "background", "target"))).first()
    n = max(1, -(-size["bytes"] // batch))
    bits = min(16, max(0, (size["bytes"] // bucket).bit_length()))
    # rows that are alike in all columns go apart by their partition
    placed = marked.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n).cast("long")))
    asked = placed.groupBy("batch").applyInArrow(_ask(bits), ASKED)
    told = asked.groupBy("bucket").applyInArrow(_tell, TOLD)
    scored = placed.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_score(size["background"], size["target"]), SCORES)
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
