import re

import numpy as np
from compare import duck, spark_rows
from pyspark.sql import functions as F

from tessera.llm import near_dedup
from tessera.llm.components import components, extended

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d, d == (least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_whole_table_equals_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    result = got(near_dedup.query(spark, data))
    assert result == brute(rows) and any(not r[3] for r in result)


def test_chains_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows, i = [(None, "a b c d e f"), (900, "A B c d e f"), (901, ""), (902, None), (903, " \t"), (904, "one two"), (905, "One\ntwo"), (906, "É é x"), (907, "é é x"), (908, "w " * 5000), (908, "w " * 5000)], 0
    for _ in range(12):
        words = [f"t{x}" for x in rng.integers(0, 10**6, 120)]
        for _ in range(15):  # each step drifts from the one before: linked in a chain, ends far apart
            words = list(words)
            words[rng.integers(0, 120)] = f"n{rng.integers(0, 10**6)}"
            rows.append((i, " ".join(words)))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit(1)).withColumn("n", F.lit("x"))
    expected = brute([r for r in rows if r[0] is not None])
    result = got(near_dedup.near_groups(df))
    assert [r for r in result if r[0] is not None] == expected and (None, 2, 900, False) in result
    assert near_dedup.near_groups(df.limit(0)).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(1, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(1, 2**63, 100).astype(np.uint64)])
    s = near_dedup.sketch([np.unique(a), np.unique(b), a[:1]], 1024)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.05 and len(set(s[2])) == 1024 and (s != np.iinfo(np.uint64).max).all()


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299), (299, 298)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)} | {k: 298 for k in (298, 299, 300)}
    roots = components(spark.createDataFrame(pairs[:45], "u long, v long"))
    assert {r.node: r.root for r in extended(roots, spark.createDataFrame([*pairs[45:], (40, 103)], "u long, v long")).collect()} == found | {k: 0 for k in range(100, 160)}


def test_query_equals_its_sql(spark, data):
    assert spark_rows(near_dedup.query(spark, data)) == duck(near_dedup.SQL, data)


def test_links_of_one_partition_need_no_steps(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pairs = [(int(a) * 7 - 900, int(b) * 7 - 900) for a, b in rng.integers(0, 900, (600, 2))] + [(10**6 + i, 10**6 + i + 1) for i in range(300)] + [(2 * 10**6, 10**6 - 5 * i) for i in range(99)] + [(5, 5), (None, 3), (4, None)]
    links = spark.createDataFrame(pairs, "u long, v long").repartition(3)
    steps, write = [], type(links).checkpoint
    monkeypatch.setattr(type(links), "checkpoint", lambda df, *a: steps.append(1) or write(df, *a))
    found = sorted(components(links).collect())
    assert len(steps) == 1 and len({r.root for r in found}) > 10
    monkeypatch.setattr("tessera.llm.components.ROWS", 100)
    assert sorted(components(links).collect()) == found and len(steps) > 3
    assert components(links.where("u = 5")).collect() == []
