import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing


@pytest.fixture(scope="module")
def coder():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def holds(rows, texts, coder):
    """The contract, row by row; gives the number of sequences."""
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(docs) == set(texts)
    for d, text in texts.items():
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(docs[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and 0 < r.length <= 2048 and (k == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(ids) > 2048 or len(docs[d]) == 1)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    return len(bins)


def test_whole_table(spark, data, coder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = packing.query(spark, data).collect()
    used = holds(rows, texts, coder)
    least = packing.lower_bound(np.bincount([r.length for r in rows], minlength=2049))
    assert least <= used <= least + 1


def test_exchange_between_partitions(spark):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2049, 3000).tolist()
    df = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack(df, group=500).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [0, *np.cumsum([n for _, n in sorted(b)])[:-1]] and sum(n for _, n in b) <= 2048
    least = packing.lower_bound(np.bincount(lengths, minlength=2049))
    assert len(bins) <= 1.02 * least


def test_odd_rows(spark, coder):
    texts = {1: None, 2: "", 3: " ", 4: "a" * 9000, 5: "The <|endoftext|> of\x1c\x85 ² ½ ß 漢字 _x_ 12 3.4\r\n\t  z", 6: "word " * 5000, -7: "a_b __ don't'LL  \n\n x  ", 8: "é" * 3000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("piece", F.lit(1)).withColumn("length", F.lit("x"))
    holds(packing.pack_documents(df).collect(), texts, coder)
    assert packing.pack_documents(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "doc_id long, text string")
    assert packing.pack_documents(twice).count() == 3


def test_equal_rows_spread(spark):
    sizes = []
    df = spark.createDataFrame([(1, 0, 0, 700, 5)] * 2000, packing.PIECES)
    rows = packing.pack(df, group=100).collect()
    fill = defaultdict(int)
    for r in rows:
        fill[r.sequence_id] += r.length
        sizes.append(r.offset)
    assert len(rows) == 2000 and len(fill) == 1000 and set(fill.values()) == {1400} and set(sizes) == {0, 700}
    names = {r.sequence_id >> 24 for r in rows}
    assert len(names) > 10  # many partitions made bins of them


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([*"abZ é'sñ_-1²  \n\t\r.!漢<|>", "<|endoftext|>", "<|endof", "text|>"]), max_size=60).map("".join))
def test_ids_are_the_tokenizer_s(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(packing.encoder().ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_and_best_fit_against_all_packings(items):
    def fewest(rest, gaps):
        if not rest:
            return len(gaps)
        n, best = rest[0], len(items)
        for i in {g: i for i, g in enumerate(gaps) if g >= n}.values():
            best = min(best, fewest(rest[1:], gaps[:i] + [gaps[i] - n] + gaps[i + 1 :]))
        return min(best, fewest(rest[1:], [*gaps, 20 - n]))

    where, offset, used = packing.best_fit(np.array(items), 20)
    assert packing.lower_bound(np.bincount(items, minlength=21), 20) <= fewest(sorted(items, reverse=True), []) <= used
    for b in range(used):
        inside = sorted((o, n) for w, o, n in zip(where, offset, items) if w == b)
        assert [o for o, _ in inside] == [sum(n for _, n in inside[:i]) for i in range(len(inside))] and sum(n for _, n in inside) <= 20


def test_rounds_go_on_while_bins_are_saved(spark, monkeypatch):
    df = spark.createDataFrame([(i, 0, 0, 700, 0) for i in range(40)], packing.PIECES)
    rounds, saves = [], {3: 1, 5: 1, 7: 1}

    def pack_group(round_, capacity):
        rounds.append(round_)
        left = 4000 - sum(v for k, v in saves.items() if k <= round_)

        def run(key, group):
            at = np.arange(len(group))
            new = {"sequence_id": np.minimum(at, left - 3971), "offset": np.where(at < left - 3970, 0, 1), "open": np.ones(len(at), bool)}
            columns = [c.strip().split()[0] for c in packing.PACKED.split(",")]
            return packing.pa.table([packing.pa.array(new[k]) if k in new else group.column(k) for k in columns], names=columns)

        return run

    monkeypatch.setattr(packing, "_pack_group", pack_group)
    monkeypatch.setattr(packing, "lower_bound", lambda *_: 0)
    packing.pack(df)
    assert rounds == list(range(10))
