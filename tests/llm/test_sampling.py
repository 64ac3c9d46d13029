import re
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import sampling as S
from tessera.llm.hashing import mix


@pytest.fixture(scope="module")
def v():
    return S.vocabulary()


def every(text):
    """All segmentations with their log-probabilities, from the vocabulary file alone."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    n = model.get_piece_size()
    rank = {model.id_to_piece(i): (i, min(max(0.0, -model.get_score(i)), n)) for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}

    def paths(word):
        if not word:
            yield (), 0.0
        for end in range(1, len(word) + 1):
            piece = word[:end]
            if piece in rank:
                head = (rank[piece][0],), -np.log(1 + rank[piece][1])
            elif end == 1:
                head = tuple(model.piece_to_id(f"<0x{b:02X}>") for b in piece.encode()), -np.log(1 + n) * len(piece.encode())
            else:
                continue
            for ids, weight in paths(word[end:]):
                yield head[0] + ids, head[1] + weight

    words = re.findall("▁+[^▁]*", "▁" + text.replace(" ", "▁"))
    out = {sum((ids for ids, _ in choice), ()): sum(w for _, w in choice) for choice in product(*(list(paths(w)) for w in words))}
    total = np.log(sum(np.exp(x) for x in out.values()))
    return {k: x - total for k, x in out.items()}


def test_samples_follow_the_lattice(v):
    text, n, k = "the ca t", 3000, 3
    exact = every(text)
    found = S.sample([text] * n, [int(x) for x in mix(np.arange(n).astype(np.uint64))], v, k)
    first, total, seen = Counter(), 0.0, Counter()
    for rows in found:
        assert len({tuple(r[0].tolist()) for r in rows}) == k and [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        assert all(abs(exact[tuple(r[0].tolist())] - r[1]) < 1e-9 for r in rows)
        first[tuple(rows[0][0].tolist())] += 1
        total += sum(np.exp(r[1] - r[3]) for r in rows)
        seen.update(tuple(r[0].tolist()) for r in rows)
    assert abs(total / n - 1) < 0.02  # inclusion scores weigh samples to an unbiased sum
    ids, p = list(exact), np.array(list(exact.values()))
    top = np.argsort(-(p + np.random.default_rng(0).gumbel(size=(20_000, len(p)))), axis=1)[:, :k]
    direct = np.bincount(top.ravel(), minlength=len(p)) / 20_000
    for i, key in enumerate(ids):
        assert abs(first[key] / n - np.exp(p[i])) < 0.04 and abs(seen[key] / n - direct[i]) < 0.04


@pytest.mark.parametrize("text", ["", " ", "a", "  two  spaces ", "é\n漢字😀\t▁ literal ▁", "x" * 5000, "word " * 4000])
def test_round_trip_and_batches(v, text):
    one = S.sample([text], [5], v, 3)
    many = S.sample(["other", text, "", "zz"], [1, 5, 9, 2], v, 3)
    for a, b in zip(one[0], many[1], strict=True):
        assert (a[0] == b[0]).all() and np.allclose(a[1:], b[1:]) and v.decode(a[0]) == text.encode()
    assert len({tuple(r[0].tolist()) for r in one[0]}) == len(one[0]) >= 1 and all(-np.inf < r[3] <= 0 for r in one[0])


@pytest.mark.parametrize("text", ["dog", "é 漢字", "a  b", "😀 on"])
def test_all_segmentations_are_found(v, text):
    exact = every(text)
    rows = S.sample([text], [11], v, len(exact) + 5)[0]
    assert {tuple(r[0].tolist()) for r in rows} == set(exact)
    assert all(abs(exact[tuple(r[0].tolist())] - r[1]) < 1e-9 for r in rows)


def test_long_texts(v):
    text = "".join(f"wörd{i % 977} {'  ' if i % 11 else ''}x{i}," for i in range(40_000))
    rows = S.sample([text, "short"], [3, 4], v, 2)[0]
    assert len(text) > 500_000 and [v.decode(r[0]) for r in rows] == [text.encode()] * 2 and (rows[0][0].tolist() != rows[1][0].tolist())


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = S.query(spark, data).collect()
    assert all(r.decodes for r in rows) and {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert len(rows) == 2 * docs.count()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "ab"), (3, "ab"), (3, "ab")], "doc_id long, text string").withColumn("sample", F.lit(1)).withColumn("ids", F.lit("x"))
    found = S.segmentations(df)
    rows = found.collect()
    assert Counter(r.doc_id for r in rows) == {1: 1, 2: 1, None: 2, 3: 4} and all(r.decodes for r in rows)
    assert len({(tuple(r.ids), r.sample) for r in rows if r.doc_id == 3}) == 2
    assert {(r.doc_id, r.text) for r in S.decoded(found).collect()} == {(1, ""), (2, ""), (None, "ab"), (3, "ab")}
    assert S.segmentations(df.limit(0)).count() == 0
