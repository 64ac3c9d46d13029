import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import fingerprints as fp


def plain_parse(text):
    """LZ78 one character at a time."""
    known, now, out = set(), "", []
    for c in text:
        now += c
        if now not in known:
            known.add(now)
            out.append(now)
            now = ""
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abé 漢", max_size=80))
def test_parse(text):
    known, ends = fp.parse(text)
    assert [text[a:b] for a, b in zip([0, *ends], ends)] == plain_parse(text) and known == set(plain_parse(text))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab c", max_size=60), st.text(alphabet="ab c", max_size=60))
def test_edit_shares_the_parse(text, other):
    changed = fp.edited(text, other)
    assert fp.both(text, changed, len(text) - len(text) // 2) == (fp.fingerprint(text), fp.fingerprint(changed))


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(t) // 2
        changed = t[: len(t) - n] + following[:n]
        a, b, c = fp.fingerprint(t), fp.fingerprint(changed), fp.fingerprint(following)
        out.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, fp.likeness(a, b), fp.likeness(a, c)))
    return sorted(out, key=str)


def test_whole_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = fp.query(spark, data).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    long = [r for r in got if r.n_chars > 400]
    assert sum(r.near_edited for r in long) > 2 * sum(r.near_next for r in long)


@pytest.mark.parametrize("rows", [[(1, "abc")], [(None, "x"), (None, None)], [(None, ""), (3, "aaaa bbbb"), (3, "aaaa bbbb"), (3, None), (7, "é" * 900), (-2, "zz top"), (9, "")]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("b"))
    assert sorted(map(tuple, fp.fingerprints(df).collect()), key=str) == expected(rows)
    assert fp.fingerprints(df.limit(0)).count() == 0


def scalar_signature(text):
    """The signature by its definition, one phrase and one component at a time, in plain integers."""
    m64, m32 = (1 << 64) - 1, (1 << 32) - 1

    def mixed(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & m64
        x ^= x >> 33
        x = x * 0xC4CEB9FE1A85EC53 & m64
        return x ^ (x >> 33)

    def name(phrase):
        total, power = 0, int(fp._POWER)
        for c in phrase:
            total, power = (total + mixed(ord(c) + 1) * power) & m64, power * int(fp._POWER) & m64
        return mixed(total)

    names = {name(p) for p in plain_parse(text)}
    # a text's end may cut a phrase short that is known already
    rest = text[sum(map(len, plain_parse(text))) :]
    out = []
    for salt in map(int, fp._SALT):
        values = []
        for h in names | ({name(rest)} if rest else set()):
            x = ((h >> 32) * (salt >> 32 | 1) & m32) ^ ((h & m32) * (salt & m32) & m32)
            x ^= x >> 15
            values.append(x * 0x2C1B3C6D & m32)
        out.append(min(values, default=m32))
    return "".join(f"{(v ^ (v >> 16)) & 0xFFFF:04x}" for v in out) if text else "empty"


@pytest.mark.parametrize("text", ["", "a", "aaaa", "the cat sat on the mat, the cat sat", "é漢字 😀 ab" * 7])
def test_signature_by_its_definition(text):
    assert fp.fingerprint(text) == scalar_signature(text)


def test_likeness_estimates_common_phrases():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.9):
        a = "".join(rng.choice(list("abcdefgh "), 6000))
        b = a[: int(6000 * share)] + "".join(rng.choice(list("abcdefgh "), 6000 - int(6000 * share)))
        x, y = set(plain_parse(a)), set(plain_parse(b))
        assert abs(fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) - len(x & y) / len(x | y)) < 0.15


def test_very_long_text(spark):
    rng = np.random.default_rng(1)
    long = "".join(rng.choice(list("abcdé 漢"), 400_000))
    rows = [(1, long), (2, "short"), (3, long[:-1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("guest", F.lit(1)).withColumn("n_chars", F.lit("x"))
    assert sorted(map(tuple, fp.fingerprints(df).collect()), key=str) == expected(rows)


def test_bucket_of_an_id(spark):
    edges = [90, 80, 80, 55, 54, 40, 7, 0, -3, -100]
    rows = spark.createDataFrame([(x,) for x in (*range(-105, 100, 3), *edges)], "x long")
    for n in (0, 1, 2, 3, 7, 10):
        found = rows.select("x", fp._above(F.col("x"), edges[:n]).alias("k")).collect()
        assert all(r.k == sum(e > r.x for e in edges[:n]) for r in found)
