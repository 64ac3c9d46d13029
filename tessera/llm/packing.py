"""Operator 1: best-fit packing with certified bin counts.

Documents become token pieces of at most 2048 tokens; only longer documents are cut, and the first piece takes the remainder. Pieces are packed by
best-fit decreasing in partitions of bounded size. A lower bound from dual feasible functions certifies a partition whose bin count meets it.
Then bins that are not full are exchanged: in each further round they meet in fewer partitions, drawn anew, their documents are repacked by best-fit
decreasing, and the new packing is taken if it needs fewer bins. Rounds end when the bound over all pieces is met, or two rounds
in fewest partitions gain not one bin. Bins move as whole rows of pieces, so a round's work is bounded by the bins still open.

Token ids are those that the public tokenizer gives for the text (its added tokens, such as <|endoftext|>, are matched in texts as it does), then the end id 0.
They are made from the same vocabulary's ranks, which is faster; tests compare them with the tokenizer itself.

Defined cases: a null text is empty and becomes the piece [0]; repeated rows are packed each; a null doc_id stays null; other columns, whatever their names, are ignored; a text of
any length is cut into pieces; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count as count_from
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, plain, table

CAPACITY = 2048
#: Pieces a partition packs at once.
GROUP = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Characters whose classes (letter, digit, space, other) are the same for Python's `re` and for the tokenizer's pattern.
_ODD = re.compile(r"[^\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-ɏ]")
#: The tokenizer's published splitting pattern, written for `re` over those characters.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class Encoder:
    """Text to little-endian 32-bit ids as bytes. Parts of the splitting pattern are independent, so their ids are kept in a bounded table."""

    KEPT = 400_000

    def __init__(self, vocabulary: str | None = None, tokenizer: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        added = {t["content"]: t["id"] for t in json.loads(Path(tokenizer or public_tokenizers.path("byte_bpe_50k.json")).read_text())["added_tokens"]}
        self.added = {k: np.array([i], "<u4").tobytes() for k, i in added.items()}
        self.split = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or "(?!)")
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
        self.coder = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        whole = self.coder.encode_ordinary

        class Known(dict):
            def __missing__(self, part: str) -> bytes:
                found = np.array(whole(part), "<u4").tobytes()
                if len(self) >= Encoder.KEPT:
                    self.clear()
                if len(part) < 64:
                    self[part] = found
                return found

        self.known = Known()

    def ids(self, text: str) -> bytes:
        found, at = [], 0
        for m in self.split.finditer(text):
            found += [self.plain(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join((*found, self.plain(text[at:]))) if found else self.plain(text)

    def plain(self, text: str) -> bytes:
        if _ODD.search(text):
            return np.array(self.coder.encode_ordinary(text), "<u4").tobytes()
        return b"".join(map(self.known.__getitem__, _SPLIT.findall(text)))


_encoders: dict[str | None, Encoder] = {}


def encoder(vocabulary: str | None = None) -> Encoder:
    """One per worker."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first may be shorter."""
    head = n % capacity or capacity
    return [(0, head), *((at, capacity) for at in range(head, n, capacity))]


def _pieces(vocabulary: str | None, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(vocabulary), np.zeros(1, "<u4").tobytes()
        for batch in batches:
            out = defaultdict(list)
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = code.ids(text.as_py()) + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + n)]
                    for name, x in (("doc_id", doc), ("piece", k), ("start", start), ("length", n), ("ids_crc32", zlib.crc32(part))):
                        out[name].append(x)
                    if with_ids:
                        out["ids"].append(np.frombuffer(part, "<i4"))
                if with_ids and len(out["ids"]) >= 500:
                    yield _batch(out)
                    out = defaultdict(list)
            if out:
                yield _batch(out)

    return run


def _batch(out: dict) -> pa.RecordBatch:
    kinds = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], list(out))


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The token pieces of `docs`; with_ids adds each piece's ids."""
    return plain(docs).select("doc_id", "text").mapInArrow(_pieces(vocabulary, capacity, with_ids), PIECES + (", ids array<int>" if with_ids else ""))


def lower_bound(count: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing of count[x] items of length x needs fewer bins: the best of three families of dual feasible functions.

    Total size; for each k, items over capacity - k count 1 and those under k nothing; and the stepwise functions u(k) of Fekete and Schepers.
    """
    x = np.arange(len(count), dtype=np.int64)
    size = count * x
    best = -(-int(size.sum()) // capacity)
    number, total = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(size)))
    for k in range(1, capacity // 2 + 1):
        large = int(number[-1] - number[capacity - k + 1])
        middle = int(total[capacity - k + 1] - total[k])
        best = max(best, large - (-middle // capacity))
    for k in range(1, 31):
        scaled = (k + 1) * x
        units = np.where(scaled % capacity == 0, scaled * k // capacity, (scaled // capacity) * (k + 1))  # in 1 / (k * (k + 1))
        best = max(best, -(-int((count * units).sum()) // (k * (k + 1))))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, number of bins) by best-fit decreasing. Bits of one integer tell which gaps exist, so finding the tightest takes a few operations."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = used = 0
    for i in order.tolist():
        n = int(lengths[i])
        fit = gaps >> n
        if fit:
            gap = n + (fit & -fit).bit_length() - 1
            b = bins[gap].pop()
            if not bins[gap]:
                gaps &= ~(1 << gap)
        else:
            gap, b, used = capacity, used, used + 1
        where[i], offset[i] = b, capacity - gap
        if gap - n:
            bins[gap - n].append(b)
            gaps |= 1 << (gap - n)
    return where, offset, used


PACKED = PIECES + ", sequence_id long, offset long, open boolean"


def _pack_group(round_: int, capacity: int):
    """Pack a partition's pieces; in later rounds keep the bins they come in unless fewer do.

    A partition at its lower bound is certified: only its emptiest bin stays open, as what is left of its slack. Else all bins with a gap do.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([(k, "ascending") for k in ("doc_id", "piece", "ids_crc32", "sequence_id", "offset")])
        lengths, old = group.column("length").to_numpy(), group.column("sequence_id").to_numpy()
        where, offset, used = best_fit(lengths, capacity)
        names, kept = np.unique(old, return_inverse=True)
        if round_ and used >= len(names):
            where, offset, used, names = kept, group.column("offset").to_numpy(), len(names), names
        else:
            names = ((round_ << 47) | (int(key[0].as_py()) << 24)) + np.arange(used)
        fill = np.bincount(where, lengths, used).astype(np.int64)
        open_ = fill < capacity
        if used <= lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity):
            open_ &= np.arange(used) == fill.argmin()
        new = {"sequence_id": pa.array(names[where]), "offset": pa.array(offset), "open": pa.array(open_[where])}
        columns = [c.strip().split()[0] for c in PACKED.split(",")]
        return pa.table([new[k] if k in new else group.column(k) for k in columns], names=columns)

    return run


def pack(found: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """`found` (pieces) with sequence_id and offset. Lengths must lie in 1..capacity; more columns of `found` are left out."""

    def packed(df: DataFrame, rows: int, round_: int, *key: str) -> DataFrame:
        part = F.pmod(F.xxhash64(F.lit(round_), *key), F.lit(max(1, -(-rows // group))))
        return checkpointed(df.withColumn("part", part).groupBy("part").applyInArrow(_pack_group(round_, capacity), PACKED))

    def bins(df: DataFrame) -> int:
        return df.where("offset = 0").count()

    found = checkpointed(found.select(*(c.split()[0] for c in PIECES.split(", "))))
    count = np.zeros(capacity + 1, np.int64)
    for r in found.groupBy("length").count().collect():  # a row for each length, `capacity` at most
        count[r["length"]] = r["count"]
    least = lower_bound(count, capacity)
    # partitions by row number, which a checkpoint fixes: rows that are alike in all columns, however many, spread like any others
    start = found.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("open"), F.monotonically_increasing_id().alias("row"))
    current = packed(start, int(count.sum()), 0, "row")
    done, closed, idle, fewest = [], 0, 0, None
    for round_ in count_from(1):
        done.append(current.where("not open"))
        closed += bins(done[-1])
        current = current.where("open")
        rows, before = current.agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).first()
        if closed + before <= least or before <= 1 or idle == 2:
            break
        current = packed(current, rows, round_, "sequence_id")
        parts = max(1, -(-rows // group))
        idle = 0 if bins(current) < before or fewest is None or parts < fewest else idle + 1
        fewest = parts if fewest is None else min(parts, fewest)
    out = current
    for d in done:
        out = out.union(d)
    return out.drop("open")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Every piece of `docs` with its place in a sequence."""
    return pack(pieces(docs, vocabulary, capacity), capacity, group)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
