import numpy as np
from pyspark.sql import functions as F

from tessera.llm import neighbours as N


def exact(rows, k=5):
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for q in sorted({i for i in ids.tolist() if i % 50 == 0}):
        x = v[ids == q][0]
        s = N.cosine(v, x)
        out[q] = sorted((-a, i) for a, i in zip(s.tolist(), ids.tolist(), strict=True) if i != q)[:k]
    return out


def check(found, want, recall):
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    hits = total = 0
    assert set(got) == set(want)
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(want[q]) + 1)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
        hits, total = hits + len({r[1:] for r in rows} & set(want[q])), total + len(want[q])
    assert hits >= recall * total


def test_whole_table_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(N.query(spark, sf).collect(), exact(rows), 0.95)


def test_many_blocks_ties_and_copies(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(i, [1.0] + [0.0] * 7) for i in range(300, 700)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = N.nearest(df, df.where("vec_id % 50 = 0"), block=90, query_block=4, leaf=16).collect()
    check(found, exact(rows), 0.99)
    assert [r.vec_id for r in sorted((r for r in found if r.query_id == 350), key=lambda r: r.rank)] == [300, 301, 302, 303, 304]


def test_many_cells_of_wide_vectors(spark, capsys):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 64))
    x = np.concatenate((rng.normal(size=(1500, 64)), centres[rng.integers(0, 60, 2500)] + 0.3 * rng.normal(size=(2500, 64))))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = N.nearest(df, df.where("vec_id % 50 = 0"), block=250, query_block=20, leaf=32).collect()
    check(found, exact(rows), 0.9)
    # the share of leaves that one block verifies: spread-out vectors need nearly all, clustered ones few
    for name, part in (("normal", x[:1500]), ("clustered", x[1500:])):
        seen = []
        N.search(np.arange(len(part)), part, np.arange(40), part[:40], 5, N.DIMENSIONS, 32, N.CONFIDENCE, seen=seen)
        verified, there = seen[0]
        with capsys.disabled():
            print(f"leaves verified of {name} vectors: {verified / there:.3f}")
        assert 0 < verified < there or name == "normal"


def test_cells_hold_every_point():
    points = np.random.default_rng(1).normal(size=(5000, 8))
    cells = N.Cells.fit(points[:400], 4)
    count = np.bincount(cells.of(points), minlength=16)
    assert count.sum() == 5000 and len(count) == 16 and count.min() > 100
    assert (N.Cells.fit(np.zeros((50, 8)), 3).of(np.zeros((9, 8))) == 7).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 0.0]), (100, None), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, [None, 1.0]), (300, []), (1, [2.0, 0.1]), (2, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (350, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(3)).withColumn("vector", F.lit("x"))
    found = N.nearest(df, df.where("vec_id % 50 = 0")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in found) == [(0, 1, 1), (0, 2, 350), (350, 1, 1), (350, 2, 0)]
    assert N.nearest(df.limit(0), df).count() == 0 and N.nearest(df, df.limit(0)).count() == 0


def test_quantile():
    x = np.random.default_rng(1).normal(size=(200_000, 8))
    assert abs(np.quantile((x * x).sum(1), 0.95) - N.chi_square_quantile(0.95, 8)) < 0.1


def test_more_ties_within_rounding_than_are_kept():
    rng = np.random.default_rng(2)
    v, far = rng.normal(size=16), rng.normal(size=(300, 16))
    copies = v * rng.uniform(0.5, 2, (200, 1))
    vectors = np.concatenate((far, copies))
    ids = rng.permutation(len(vectors))
    found = N.search(ids, vectors, np.array([-1]), v[None] * 1.1, 5, N.DIMENSIONS, 64, N.CONFIDENCE)
    scores = N.cosine(vectors, v * 1.1)
    assert [(i, s) for _, i, s in found] == [(i, -s) for s, i in sorted(zip((-scores).tolist(), ids.tolist(), strict=True))[:5]]
