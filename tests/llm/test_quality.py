import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import quality as Q
from tessera.llm.hashing import text_chunks


def test_whole_table_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.query(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.95 and {b for _, b in held} == {0, 1}


def test_density_against_the_formula():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)), rng.integers(0, 2, 400)
    x[y == 1] += 1
    m = Q.fit(x, y, pooled=0.25, ridge=0.1)
    whole = sum((x[y == k] - x[y == k].mean(0)).T @ (x[y == k] - x[y == k].mean(0)) for k in (0, 1)) / 400
    odds = np.log(y.mean() / (1 - y.mean()))
    for k, sign in ((1, 1), (0, -1)):
        c = 0.75 * np.cov(x[y == k].T, bias=True) + 0.25 * whole + 0.1 * np.diag(np.diag(whole))
        d = x - x[y == k].mean(0)
        odds = odds + sign * (-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(m.score(x), 1 / (1 + np.exp(-odds)))


def test_features_do_not_depend_on_the_batch():
    texts = ["a b c", "", "ÄÖ! | x\n1", "w " * 3000, "one"]
    whole = np.concatenate([Q.features(d, o) for _, _, d, o in text_chunks(pa.array(texts))])
    one = np.concatenate([Q.features(d, o) for t in texts for _, _, d, o in text_chunks(pa.array([t]))])
    assert np.allclose(whole, one) and not whole[1].any() and np.isfinite(whole).all()


def plain_features(text):
    """The statistics of a text, one character at a time."""
    raw = text.encode()
    w = [x.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))) for x in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    n, size, root = len(w), len(raw), lambda x: math.asin(math.sqrt(min(max(x, 0), 1)))
    if not size:
        return [0.0] * len(Q.NAMES)
    long = [len(x) for x in w] or [0]
    mean = sum(long) / len(long)
    among = lambda chars: root(sum(b in chars for b in raw) / size)
    symbols = b"!#$%&*+/<=>@[\\]^_`{}~"
    times, pairs = Counter(w), list(zip(w, w[1:], strict=False))
    return [
        math.log1p(n), math.log1p(mean), math.log1p(math.sqrt(max(sum(x * x for x in long) / len(long) - mean**2, 0))), among(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), among(b"0123456789"), among(b".,;:?'\"-()"), among(symbols), among(b"|"),
        among(bytes(range(128, 256))), among(b"\n"), among(b" \t\n\v\f\r"), root(1 - len(times) / n) if n else 0.0, root(max(times.values()) / n) if n else 0.0, root(1 - len(set(pairs)) / len(pairs)) if pairs else 0.0,
        root(sum(x <= 3 for x in long) / n) if n else 0.0, root(sum(x[-1] in symbols + b"|" for x in w) / n) if n else 0.0, math.log1p(size / (raw.count(b"\n") + 1)),
    ]


def test_features_against_plain_counting(spark, data):
    texts = [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + ["", " \n", "One", "a A a a | b| c# \x0b é", "x " * 5000]
    found = np.concatenate([Q.features(d, o) for _, _, d, o in text_chunks(pa.array(texts))])
    assert np.allclose(found, np.array([plain_features(t) for t in texts]), atol=1e-6)


def test_repeated_ids_do_not_multiply_training_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "y")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 50 + [(2, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "fit", lambda x, y: seen.append(len(x)))
    Q.train(docs, labels)
    assert seen == [2]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "y " * 100_000), (3, "y"), (3, "y")], "doc_id long, text string").withColumn("label", F.lit(7)).withColumn("score", F.lit("s"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 0), (2, None), (3, 0), (77, 1)], "doc_id long, quality int")
    model = Q.train(docs, labels)
    assert Q.score(docs, model).count() == 6 and Q.score(docs.limit(0), model).count() == 0
    none = Q.train(docs, labels.limit(0))
    assert {r.score for r in Q.score(docs, none).collect()} == {0.5} and Q.keep_good(docs, none).columns == docs.columns and Q.keep_good(docs, none).count() == 6
