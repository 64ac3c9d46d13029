import hashlib
import re
from collections import Counter

import numpy as np
from compare import duck, spark_rows
from pyspark.sql import functions as F

from tessera.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=35):
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = []
    for d, w in split:
        cover = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                cover.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in cover)
        out.append((d, len(w), len(cover), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_factors_are_greedy_and_maximal(spark):
    rng = np.random.default_rng(3)
    word = [f"v{i}" for i in range(400)]
    passages = [" ".join(rng.choice(word, n)) for n in (60, 90, 45, 36, 34)]
    rows = [(0, " ".join(passages))]
    for d in range(1, 30):
        parts = [" ".join(rng.choice(word, rng.integers(0, 12))) for _ in range(5)]
        cuts = [p.split()[rng.integers(0, 8) :] for p in rng.permutation(passages)]
        rows.append((d, " ".join(x for a, b in zip(parts, cuts, strict=True) for x in (a, *b) if x)))
    rows += [(40, "z " * 90), (41, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = {r.key: r.text.split() for r in df.select(F.shiftright(F.xxhash64("doc_id", "text"), 32).alias("key"), "text").collect()}
    own = {r.doc_id: r.key for r in df.select("doc_id", F.shiftright(F.xxhash64("doc_id", "text"), 32).alias("key")).collect()}
    found, split = sorted((tuple(r) for r in substring.factors(df).collect())), {d: t.split() for d, t in rows}
    by = {d: [f for f in found if f[0] == d] for d in split}
    seen = Counter(tuple(w[i : i + 35]) for w in split.values() for i in range(len(w) - 34))
    assert found and all(by[d] for d in range(30) if any(seen[tuple(split[d][i : i + 35])] > 1 for i in range(len(split[d]) - 34)))
    for d, spans in by.items():
        free, w = 0, split[d]
        for _, start, n, source, at in spans:
            there = text[source]
            assert start >= free and n >= 35 and w[start : start + n] == there[at : at + n] and (own[d], start) != (source, at)
            # greedy: nothing that is repeated was passed over between factors, but windows across the last one's end
            assert all(seen[tuple(w[i : i + 35])] < 2 for i in range(free, start))
            free = start + n
        assert all(seen[tuple(w[i : i + 35])] < 2 for i in range(free, len(w) - 34))
    # a factor ends where its next window has another place in the reference, or none
    p = substring.parse(np.array([0, 1, 2, 3, 9, 10, 60]), np.array([100, 101, 102, 7, 8, 9, 500]), 35)
    assert (p.first.tolist(), p.last.tolist(), p.source.tolist()) == ([0, 60], [36, 94], [100, 500])
    assert (p.across_first.tolist(), p.across_last.tolist()) == ([3, 9], [37, 44])


def test_query_equals_its_sql(spark, data):
    names, rows = spark_rows(substring.query(spark, data))
    assert (names, rows) == duck(substring.SQL, data)


def test_clashing_columns(spark):
    p = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, p, 7, "x", 1.5), (2, f"a {p}", 8, None, 2.5)], "doc_id long, text string, k1 long, rest string, null_text double")
    found = {r.doc_id: r for r in substring.clean(df.withColumn("_null_text", F.lit(3))).collect()}
    assert found[2].text == "a" and (found[2].k1, found[2].rest, found[2].null_text, found[2]["_null_text"]) == (8, None, 2.5, 3)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_whole_table_equals_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    result = got(substring.query(spark, data))
    assert result == brute(rows) and sum(r[2] for r in result) > 0


def test_odd_rows(spark):
    p = " ".join(f"w{i}" for i in range(50))
    rows = [(1, p), (1, p), (2, f"a {p} b"), (3, f"x\t{p[:120]}\n y"), (None, None), (None, ""), (4, "é " * 90), (5, "z " * 36), (6, "z " * 35), (7, "one"), (8, " \n"), (9, "é " * 35 + "\x0bq")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a", F.lit(1)).withColumn("codes", F.lit("x"))
    assert got(substring.substring_digest(df)) == brute(rows)
    cleaned = {r.doc_id: r.clean_text for r in substring.drop_substrings(df).collect()}
    assert cleaned[2] == "a b" and cleaned[7] == "one" and cleaned[8] == " \n"
    assert substring.substring_digest(df.limit(0)).count() == 0
