import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import line_dedup as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def masked(line):
    w = tuple("<*>" if re.search("[0-9]", x) else x for x in WORD.findall(line))
    return w if len(w) >= L.MIN_WORDS else None


def tree(lines, lead=L.LEAD, min_docs=L.MIN_DOCS):
    """Template of each different masked line, by plain counting."""
    node = {w: (len(w),) for w in lines}
    for i in range(lead):
        seen = Counter((node[w], w[i]) for w in lines)
        node = {w: (*node[w], w[i] if seen[node[w], w[i]] >= min_docs else None) for w in lines}
    leaf = Counter(node.values())
    live = [w for w in lines if node[w].count(None) <= L.WILD and leaf[node[w]] >= min_docs]
    often = Counter((node[w], i, x) for w in live for i, x in enumerate(w))
    out = {w: w for w in lines}
    for w in live:
        kept = tuple(x if often[node[w], i, x] >= max(min_docs, L.SHARE * leaf[node[w]]) else None for i, x in enumerate(w))
        if len(w) - kept.count(None) >= L.SIMILAR * len(w):
            out[w] = (node[w], kept)
    return out


def shingles(lines):
    out = set()
    for line in lines:
        w = WORD.findall(line)
        out |= {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({("short", *masked_all(w))} if w else set())
    return frozenset(out)


def masked_all(w):
    return ["<*>" if re.search("[0-9]", x) else x for x in w]


def contents(rests):
    """Groups of shingle sets linked at a similarity of 0.75, exactly."""
    rests, groups = set(rests), []
    for r in rests:
        near = [g for g in groups if any(4 * len(r & x) >= 3 * len(r | x) for x in g)]
        groups = [g for g in groups if g not in near] + [[r, *(x for g in near for x in g)]]
    return len(groups)


def brute(rows, min_docs=L.MIN_DOCS):
    name = tree({w for _, t in rows for line in t.split("\n") if (w := masked(line))})
    where = defaultdict(set)
    for t in {t for _, t in rows}:
        for x in {name[w] for line in t.split("\n") if (w := masked(line))}:
            where[x].add(t)
    gone = set()
    for x, texts in where.items():
        if len(texts) >= min_docs:
            rests = []
            for t in texts:
                first = next(w for line in t.split("\n") if (w := masked(line)) and name[w] == x)
                rests.append(shingles(line for line in t.split("\n") if masked(line) != first))
            if contents(rests) >= min_docs:
                gone.add(x)
    return sorted((d, "\n".join(line for line in t.split("\n") if not (w := masked(line)) or name[w] not in gone)) for d, t in rows), gone


def got(df):
    return sorted((r.doc_id, r.clean_text) for r in df.collect())


def test_whole_table_equals_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want, gone = brute(rows)
    assert got(L.drop_lines(spark.read.parquet(f"{data}/documents.parquet"))) == want and gone
    assert L.query(spark, data).count() == len(rows)


def test_fields_copies_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    body = lambda i: " ".join(f"w{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}" for x in rng.integers(0, 676, 30))
    rows = [(i, f"Page {i} of {i + 7} pages\n{body(i)}\nok") for i in range(12)]
    rows += [(100 + i, f"This sentence is in copies only\n{' '.join(f'c{chr(97 + j % 26)}' for j in range(60))} {'z' if i == 3 else ''}") for i in range(40)]
    rows += [(200, ""), (201, "\n\n"), (202, "x " * 50_000)]
    df = spark.createDataFrame([*rows, (203, None), (None, "a b c")], "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("template", F.lit(3)).withColumn("n_chars", F.length("text").cast("long"))
    found = {r.doc_id: r for r in L.clean(df).collect()}
    assert all("Page" not in found[i].text and found[i].text.endswith("\nok") for i in range(12))
    assert all(found[100 + i].text == dict(rows)[100 + i] for i in range(40))  # copies are left to the near-duplicate stage
    assert found[203].text is None and found[201].text == "\n\n" and found[None].text == "a b c" and found[0].n_chars == len(found[0].text) and found[5].lang == "en" and found[5].template == 3
    assert L.drop_lines(df.limit(0)).count() == 0


def unrelated(n, words=30, seed=0):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{chr(97 + x % 26)}{chr(97 + x // 26 % 26)}" for x in rng.integers(0, 676, words)) for _ in range(n)]


def test_a_large_group_of_copies_keeps_no_line(spark):
    notice = "All views here are those of the author"
    *texts, copy = unrelated(13)
    rows = [(i, f"{t}\n{notice}") for i, t in enumerate([*texts, *[copy] * 60])]
    found = L.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 72 and all(r.n_dropped == 1 and notice not in r.clean_text for r in found)


def dropped(spark, texts, **options):
    found = L.drop_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options).collect()
    return [r.n_dropped for r in sorted(found, key=lambda r: r.doc_id)]


def test_a_document_of_boilerplate_alone_cannot_keep_it(spark):
    texts, draws = [], [(120, 6)] * 20 + [(40, 12), (60, 12), (100, 10)]
    for seed, (shared, own) in enumerate(draws):
        notice = unrelated(1, shared, seed)[0]
        texts += [f"{t}\n{notice}" for t in unrelated(40, own, 1000 + seed)]
    assert dropped(spark, texts) == [1] * 40 * len(draws)


def test_words_without_digits_are_fields(spark):
    names = [f"{a}{b}" for a in ("ali", "bo", "ca", "dor") for b in ("ce", "ris", "rol")]
    bodies = unrelated(24, 30)
    texts = [f"{t}\nPosted by {x} on the main board today" for t, x in zip(bodies, names, strict=False)]
    texts += [f"{t}\nPosted by {x} in {y}" for t, x, y in zip(bodies[12:], names, reversed(names), strict=True)]
    assert dropped(spark, texts) == [1] * 24
    # one wildcard a path: with four leading words, the second form has two
    assert dropped(spark, [t.replace("on the", f"on{i} the") for i, t in enumerate(texts)], lead=5) == [1] * 12 + [0] * 12
    plain = [f"{t}\n{x} went {y} from {z} again" for t, x, y, z in zip(bodies, names, reversed(names), bodies[0].split(), strict=False)]
    assert dropped(spark, plain) == [0] * 12  # too few constants


def test_the_lead_decides_the_leaf(spark):
    a, b = unrelated(2, 12, 3)
    texts = [f"{t}\nSeen {x} near the old town hall" for t, x in zip(unrelated(12, 30, 5), a.split(), strict=False)]
    # with other lines that begin alike, 'near' is no longer frequent in a shallow leaf
    texts += [f"{t}\nSeen {x} {y} {x} {y} {y} {x}" for t, x, y in zip(unrelated(60, 30, 6), 5 * b.split(), unrelated(1, 60, 8)[0].split(), strict=False)]
    deep, shallow = dropped(spark, texts, lead=3), dropped(spark, texts, lead=1)
    assert deep[:12] == [1] * 12 and shallow[:12] == [0] * 12 and deep[12:] == shallow[12:] == [0] * 60


def test_copies_of_every_size_are_one_content(spark):
    rng = np.random.default_rng(4)
    lines = unrelated(8, 25, 9)
    texts = []
    for _ in range(400):
        words = " \n ".join(lines).split(" ")
        for at in rng.integers(0, len(words), 4):
            if words[at] != "\n":
                words[at] = f"edit{chr(97 + rng.integers(26))}{chr(97 + rng.integers(26))}"
        texts.append(" ".join(words).replace(" \n ", "\n"))
    assert sum(dropped(spark, texts)) == 0


def test_many_near_copies_are_one_content(spark):
    body = unrelated(6, 40)
    texts = ["\n".join([*body, f"edited by {x} and others"]) for x in unrelated(300, 1, 5)]
    rows = list(enumerate(texts))
    found = L.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.clean_text) for r in found) == rows


def test_lines_are_gone_before_texts_are_shuffled(spark, data, monkeypatch):
    made, real = [], L.checkpointed
    monkeypatch.setattr(L, "checkpointed", lambda df: made.append(real(df)) or made[-1])
    L.drop_lines(spark.read.parquet(f"{data}/documents.parquet").limit(60))
    there = lambda df: Path(df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")).exists()
    assert [there(df) for df in made if "words" in df.columns] == [False, False] and there(made[-1])
