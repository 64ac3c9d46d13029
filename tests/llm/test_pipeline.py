import corpus_pipeline as P
from pyspark.sql import functions as F
from test_line_dedup import brute as brute_lines
from test_near_dedup import brute as brute_groups
from test_substring import brute as brute_spans

from tessera.llm import quality


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, steps = docs.columns, {}
    for name, stage in P.STAGES:
        before, out = docs, str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        steps[name] = ([(r.doc_id, r.text) for r in before.collect()], docs.collect())
        assert docs.columns == columns or name == "best_fit_packing"
    rows, kept = steps["quality_classifier"]
    model = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality.score(spark.read.parquet(f"{sf}/documents.parquet"), model).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept} == good and 0 < len(good) < len(rows)
    rows, kept = steps["line_dedup"]
    assert sorted((r.doc_id, r.text) for r in kept) == brute_lines(rows)[0] and all(r.n_chars == len(r.text) for r in kept)
    rows, kept = steps["near_dedup"]
    assert sorted((r.doc_id, r.text) for r in kept) == sorted((d, t) for d, t in rows if d in {r[0] for r in brute_groups(rows) if r[3]}) and len(kept) < len(rows)
    rows, kept = steps["substring_dedup"]
    left = {r[0]: (r[1], r[2]) for r in brute_spans(rows)}
    assert all(len(r.text.split()) == left[r.doc_id][0] - left[r.doc_id][1] for r in kept if r.text.isascii()) and len(kept) == len(rows)
    rows, packed = steps["best_fit_packing"]
    assert {r.doc_id for r in packed} == {d for d, _ in rows}
    assert P.run(spark, sf).count() == len(packed)


def test_empty_and_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    odd = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        stage(spark, docs.union(odd).union(docs.limit(2)), sf).collect()
