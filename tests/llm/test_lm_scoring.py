import re
from collections import Counter
from math import isclose, log

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import lm_scoring as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, good):
    """Losses by the formulas of the module, over plain dictionaries."""

    def tokens(t):
        w = WORD.findall(t or "")
        return [*w, None] if w else []

    def model(texts):
        one, two, stood = Counter(), Counter(), Counter()
        for t in texts:
            for v, w in zip(["", *tokens(t)], tokens(t), strict=False):
                one[w] += 1
                two[v, w] += 1
                stood[v] += 1
        return one, two, stood, sum(one.values())

    every = model([t for _, t in rows])
    ours = model([t for d, t in rows if d in good])

    def loss(m, v, w):
        one, two, stood, n = m
        base = every[0][w] / every[3]
        p1 = lm.BACK * base + (1 - lm.BACK) * one[w] / n if n else base
        return -log((two[v, w] + lm.PRIOR * p1) / (stood[v] + lm.PRIOR))

    out = []
    for d, t in rows:
        w = tokens(t)
        means = [sum(loss(m, *x) for x in zip(["", *w], w, strict=False)) / len(w) if w else None for m in (ours, every)]
        out.append((d, max(0, len(w) - 1), *means))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[1], r[2] or 0, r[3] or 0)
    got, want = sorted((tuple(r)[:4] for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and all((x is None) == (y is None) and (x is None or isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a[2:], b[2:], strict=True)), (a, b)


def test_whole_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{data}/labels.parquet")
    good, bad = ({r.doc_id for r in labels.where(f"quality = {q}").collect()} for q in (1, 0))
    got = lm.query(spark, data).collect()
    same(got, brute(rows, good))
    assert all(r.score is None or isclose(r.score, r.target_loss - r.background_loss, abs_tol=1e-12) for r in got)
    assert np.mean([r.score for r in got if r.doc_id in bad and r.score is not None]) > np.mean([r.score for r in got if r.doc_id in good and r.score is not None])


def test_many_batches_and_buckets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(0, 60)) % 500) + ("\n" if i % 3 else "")) for i in range(300)] + [(7, "the " * 3000)] * 40
    good = set(range(0, 300, 7))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in good], "doc_id long, quality int")
    same(lm.score(docs, labels, batch=20_000, bucket=10_000).collect(), brute(rows, good))


def test_the_model_grows_with_the_corpus():
    texts = [" ".join(f"{w}{i % 997}" for w in ("a", "b", "c", "d")) for i in range(4000)]
    sizes = [len(lm.Batch(pa.chunked_array([texts[:n]])).keys) for n in (200, 400, 800)]
    assert sizes[1] > 1.9 * sizes[0] and sizes[2] > 1.9 * sizes[1]


def test_large_counts():
    counts = np.array([0, 1, 254, 255, 256, 10**9])
    assert lm.unpacked(*lm.packed(counts)).tolist() == counts.tolist()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "é"), (4, "ab " * 70000), (5, " \n")], "doc_id long, text string").withColumn("good", F.lit("x")).withColumn("batch", F.lit(1))
    labels = spark.createDataFrame([(3, 1), (3, 0), (9, 1), (None, 1), (4, None)], "doc_id long, quality int")
    got = lm.score(docs, labels).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same(got, brute(rows, {3}))
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[1].score is None and by[5].n_tokens == 0 and by[4].n_tokens == 70000 and by[3].target_loss < by[3].background_loss
    assert lm.score(docs.limit(0), labels).count() == 0
    same(lm.score(docs, labels.limit(0)).collect(), brute(rows, set()))
