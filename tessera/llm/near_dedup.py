"""Operator 8: near-duplicate groups by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen and Thorup, 2017): in round i < t every shingle goes to a hashed bin, in round t + b to bin b; a coordinate keeps the
smallest hash of the first round that reaches it. After 2t rounds every coordinate is filled, and the share of equal coordinates is concentrated
about the Jaccard similarity as for t independent hashes. 96 coordinates make 32 bands of 3: a pair at similarity 0.75 shares
no band with probability (1 - 0.75^3)^32, below 3e-8.

Documents with equal shingle sets are one class first, so groups of copies, however large, are one row from there on. Links are then sought in rounds:

1. each class against its most frequent band representative (of a bucket, the class with most company in all its buckets: an original rather than one of its
   copies); 2. the pairs (class, representative) that still lie in two components;
3. classes of buckets that still hold several components, by the prefix filter: sets at similarity 0.75 share one of their rarest quarter of shingles, so
   only these rare shingles make buckets, and there classes outside a bucket's largest component meet the others. Shingles that many documents share,
   such as a common passage, are last in order and make none.

Pairs of one component need no check, so a large group is never paired with itself. All links are confirmed on full shingle sets, which
are kept partitioned by class while pairs come to them. The order by rarity counts shingles in 2^18 hashed places: any order finds all pairs, a rough one will do.

Defined cases: null, empty or blank text has no shingles and is linked with nothing; a text of one to four words has one shingle, its word sequence;
repeated rows are one class; a null doc_id takes part and is never a smallest id; texts of any length are taken whole; other columns, whatever their names, are ignored, or kept by
keep_first(); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carried, checkpointed, few, partitions, plain, restored, row_key, table
from .components import components, extended
from .hashing import U, lists, long_lists, mix, shingle_sets, text_chunks

SHINGLE, BANDS, ROWS = 5, 32, 3
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75


def sketch(sets: list[np.ndarray], t: int) -> np.ndarray:
    """len(sets) x t coordinates; sets must not be empty."""
    n = len(sets)
    out = np.full(n * t, np.iinfo(U).max, U)
    item = np.concatenate(sets) if n else np.empty(0, U)
    of = np.repeat(np.arange(n), [len(s) for s in sets])
    for i in range(2 * t):
        x = mix(item ^ mix(np.array([i + 1], U)))
        slot = of * t + (((x >> U(32)) * U(t)) >> U(32)).astype(np.int64) if i < t else of * t + (i - t)
        fresh = out[slot] >= U(i) << U(52)
        np.minimum.at(out, slot[fresh], (U(i) << U(52)) | (mix(x[fresh]) >> U(12)))
        open_ = (out.reshape(n, t) == np.iinfo(U).max).any(axis=1)
        if not open_.any():
            break
        if not open_.all():
            keep = open_[of]
            item, of = item[keep], of[keep]
    return out.reshape(n, t)


def _signatures(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, bands + 1).astype(U))
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column("text")):
                sets = shingle_sets(data, offsets, shingle)
                full = [s for s in sets if len(s)]
                s = sketch(full, bands * rows).reshape(len(full), bands, rows)
                band = np.zeros((len(full), bands), U)
                for k in range(rows):
                    band = mix(band + s[:, :, k])
                band = mix(band + salt)
                at, ends = 0, []
                for x in sets:
                    at += bands * bool(len(x))
                    ends.append(at)
                names = [int(mix(np.array([mix(x).sum(dtype=U) + U(len(x))], U)).view(np.int64)[0]) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(row, end - row) for k in ("doc_id", "k1", "k2")), pa.array([len(x) for x in sets], pa.int64()), pa.array(names, pa.int64()), pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(band.reshape(-1).view(np.int64)))],
                    ["doc_id", "k1", "k2", "n", "class", "bands"],
                )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("class").slice(row, end - row), long_lists(shingle_sets(data, offsets, shingle))], ["class", "set"])

    return run


PLACES = 1 << 18


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(PLACES, np.int64)
    for batch in batches:
        for x in lists(batch.column("set")):
            total += np.bincount((x.view(U) >> U(46)).astype(np.int64), minlength=PLACES) if len(x) > 5000 else 0
            if len(x) <= 5000:
                np.add.at(total, (x.view(U) >> U(46)).astype(np.int64), 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["place", "n"])


def _prefixes(counts, percent: int):
    """The rarest shingles of each set: all but the share that a similar set must have in common, and one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, place, row = [], [], []
            sets = lists(batch.column("set"))
            for i, x in enumerate(sets):
                x = x.view(U)
                order = np.lexsort((x, counts.value[(x >> U(46)).astype(np.int64)]))
                keep = len(x) + (-percent * len(x)) // 100 + 1
                token.append(x[order[:keep]])
                place.append(np.arange(keep))
                row.append(np.full(keep, i))
            if not sets:
                continue
            row = np.concatenate(row)
            size = np.array([len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), batch.column("class").take(pa.array(row)), batch.column("root").take(pa.array(row)), pa.array(size[row].astype(np.int32)), pa.array(np.concatenate(place).astype(np.int32))], ["token", "class", "root", "n", "at"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.slice(lo, 2000)
                keep = []
                for a, b in zip(lists(part.column("sx")), lists(part.column("sy")), strict=True):
                    small, large = (a, b) if len(a) < len(b) else (b, a)
                    small, large = small.view(U), large.view(U)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[at] == small).sum())
                    keep.append(100 * both >= percent * (len(a) + len(b) - both))
                chosen = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(k).filter(chosen) for k in ("x", "y")], ["u", "v"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) among the pairs (x, y). `sets` is partitioned by class and stays where it is."""
    left = pairs.join(sets.select(F.col("class").alias("x"), F.col("set").alias("sx")), "x")
    return left.join(sets.select(F.col("class").alias("y"), F.col("set").alias("sy")), "y").select("x", "y", "sx", "sy").mapInArrow(_verify(percent), "u long, v long")


def classes_and_links(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, n, class) of each row, and (class, root) of each class that is linked with another."""
    spark = docs.sparkSession
    n = partitions(spark)
    keyed = plain(docs).select("doc_id", "text", *row_key())
    signed = checkpointed(keyed.select("text", "doc_id", "k1", "k2").mapInArrow(_signatures(shingle, bands, rows), "doc_id long, k1 long, k2 long, n long, class long, bands array<long>"))
    classes = checkpointed(signed.where("n > 0").groupBy("class").agg(F.min_by(F.struct("k1", "k2"), F.struct("k1", "k2")).alias("k"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    entries = classes.select("class", "n", F.explode("bands").alias("band"))
    crowds = entries.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    crowded = checkpointed(entries.join(crowds, "band"))
    company = crowded.groupBy("class").agg(F.sum("size").alias("company"))
    placed = crowded.join(company, "class")
    heads = placed.groupBy("band").agg(F.max(F.struct("company", "class", "n")).alias("head"))
    shared = checkpointed(crowded.join(heads, "band").select("band", "class", "n", F.col("head.class").alias("head"), F.col("head.n").alias("head_n")))
    fits = lambda a, b: (F.least(a, b) * 100 >= F.greatest(a, b) * percent)  # noqa: E731  smaller against larger set bounds the similarity
    star = checkpointed(
        shared.where(F.col("class") != F.col("head")).where(fits(F.col("n"), F.col("head_n"))).groupBy(F.col("class").alias("x"), F.col("head").alias("y")).agg(F.count("*").alias("times"))
    )
    involved = shared.select("class").distinct().join(classes.select("class", "k.k1", "k.k2"), "class")
    held = keyed.select("text", "k1", "k2").join(involved, ["k1", "k2"]).select("class", "text").mapInArrow(_sets(shingle), "class long, set array<long>")
    sets = held.dropDuplicates(["class"]).repartition(n, "class").persist(StorageLevel.DISK_ONLY)

    first = star.groupBy("x").agg(F.max_by("y", F.struct("times", "y")).alias("y"))
    roots = checkpointed(components(checkpointed(_links(first, sets, percent))))

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        a, b = (roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in ("x", "y"))
        return pairs.join(a, "x", "left").join(b, "y", "left").where(F.coalesce("root_x", "x") != F.coalesce("root_y", "y")).select("x", "y")

    second = apart(star.select("x", "y").join(first, ["x", "y"], "left_anti"), roots)
    roots = extended(roots, checkpointed(_links(second, sets, percent)))

    member = shared.select("band", "class").join(roots.withColumnRenamed("node", "class"), "class", "left").select("band", "class", F.coalesce("root", "class").alias("root"))
    mixed = member.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("band")
    doubtful = checkpointed(member.join(mixed, "band").groupBy("class").agg(F.first("root").alias("root")))
    held = doubtful.join(sets, "class").select("class", "root", "set")
    counts = np.zeros(PLACES, np.int64)
    for r in held.select("set").mapInArrow(_places, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # PLACES rows at most
        counts[r.place] = r.n
    rare = checkpointed(held.mapInArrow(_prefixes(spark.sparkContext.broadcast(counts), percent), "token long, class long, root long, n int, at int"))
    parts = rare.groupBy("token", "root").agg(F.count("*").alias("size"))
    split = parts.groupBy("token").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("token", "main")
    rare = rare.join(split, "token")
    outside = rare.where("root <> main").select("token", F.col("class").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"), F.col("root").alias("rx"))
    others = rare.select("token", F.col("class").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"), F.col("root").alias("ry"), "main")
    # what two sets can still have in common from this shingle on, against what the similarity asks for
    room = (F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay"))) * (100 + percent) >= (F.col("nx") + F.col("ny")) * percent
    third = outside.join(others, "token").where("rx <> ry and (ry = main or x < y)").where(fits(F.col("nx"), F.col("ny")) & room).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    third = third.join(star.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), ["x", "y"], "left_anti")
    roots = extended(roots, checkpointed(_links(third, sets, percent)))
    sets.unpersist()
    return signed.drop("bands"), roots


def near_groups(docs: DataFrame, **options) -> DataFrame:
    """doc_id, k1, k2, n_shingles, component_id, kept and first for each row of `docs`; `first` marks one text of each group (and all rows without shingles)."""
    signed, roots = classes_and_links(docs, **options)
    named = signed.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = few(checkpointed(named.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k2")).alias("least"))))
    found = named.join(least, "root", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = F.when(F.col("n") > 0, kept & (F.col("k2") == F.col("least.k2"))).otherwise(True)
    return found.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), first.alias("first"))


def contents(docs: DataFrame, **options) -> DataFrame:
    """k1, k2 and content, the near-duplicate group, of each row of `docs` that has shingles; repeated rows once."""
    signed, roots = classes_and_links(docs, **options)
    named = signed.where("n > 0").select("k1", "k2", "class").distinct().join(roots.withColumnRenamed("node", "class"), "class", "left")
    return named.select("k1", "k2", F.coalesce("root", "class").alias("content"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """`docs` with one row of each near-duplicate group, its smallest doc_id."""
    stay = near_groups(docs, **options).where("first").groupBy("k1", "k2").agg(F.max(F.col("n_shingles") > 0).alias("alone"))
    whole = carried(docs)
    keyed = whole.select("doc_id", "text", "rest", *row_key()).join(stay, ["k1", "k2"])
    number = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(1)))
    return restored(keyed.withColumn("number", number).where("number = 1 or not alone"), docs.columns, "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS g FROM d),
x AS MATERIALIZED (SELECT r, unnest(g) AS t FROM s),
p AS (SELECT a.r AS u, b.r AS v, count(*) AS n FROM x a JOIN x b ON a.t = b.t AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN s a ON a.r = u JOIN s b ON b.r = v WHERE 100 * n >= 75 * (len(a.g) + len(b.g) - n)),
e AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach AS (SELECT r AS a, r AS b FROM s UNION SELECT reach.a, e.v FROM reach JOIN e ON e.u = reach.b),
c AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN s ON s.r = b GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.a = s.r
"""
