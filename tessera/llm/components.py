"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Links a partition holds; tables of fewer links need no more shuffle files than they have partitions, and those of one partition are grouped by one task.
ROWS = 200_000


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links that come: roots are hooked below the least root they are linked with, and paths shortened, until nothing changes."""
    links = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not links:
        return
    nodes, at = np.unique(np.concatenate([x for side in zip(*links, strict=True) for x in side]), return_inverse=True)
    a, b = at.reshape(2, -1)
    root, before = np.arange(len(nodes)), None
    while before is None or (root != before).any():
        before, root = root, root.copy()
        low = np.minimum(before[a], before[b])
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while (root != root[root]).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (columns u, v: long); root is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014). Each step groups by node with partial aggregation, so a node with very
    many links is pre-aggregated where its rows lie; every step is checkpointed. Links that fit one partition need no steps, of which the driver
    would have to plan and remember each: one task groups them. Null and self links are left out; no links, no rows.
    """
    edges = checkpointed(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    parts = max(1, -(-edges.count() // ROWS))  # steps never add links, so this many partitions do for all of them

    def few(df: DataFrame) -> DataFrame:
        return df.coalesce(parts)

    if parts == 1:
        return few(edges).mapInArrow(_grouped, "node long, root long")
    edges, before = few(edges), None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = few(few(both.where("v > u").join(least, "u")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")).where("u <> v")).distinct())
        least = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = few(large.join(least, "u")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = checkpointed(few(small))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = few(edges.select(F.col("v").alias("node")).distinct()).select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of known components (from components()) and more links: only roots are grouped again, so the work follows the new links."""
    named = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
    met = links.join(named("u"), "u", "left").join(named("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
    above = components(met)
    kept = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    whole = checkpointed(kept.union(above.join(roots.select("node"), "node", "left_anti").select("node", "root")))
    return whole.coalesce(max(1, -(-whole.count() // ROWS)))
