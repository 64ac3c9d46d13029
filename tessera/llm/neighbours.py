"""Operator 10: nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are scaled to length 1, where order by cosine is order by distance, and projected by DIMENSIONS normal (2-stable) directions. A shallow kd-tree over the
projections of a bounded sample (SAMPLE rows, the smallest by hash) divides space into cells of about BLOCK vectors, and every row is put into its cell. Each
block (a cell, or a part of one that holds more) is a kd-tree of its own. For a query, leaves come by growing projected distance and their vectors are verified
by exact distance. With d the distance of the k-th nearest found so far and p the projected distance of the next leaf, (p / d)^2 of a point at distance
d is chi-square with DIMENSIONS degrees: once it exceeds the CONFIDENCE quantile, an unseen nearer neighbour is that unlikely and the search ends
(Sun et al., 2014). A query searches its own cell first; the distance found there goes with it to other cells, and only to those whose box the test doesn't rule
out. Results are merged by exact cosine. Nothing is capped.

Rows are shuffled once by cell for each of the two steps; only a cell with more than QUERIES queries sends its rows once for each so many of them. A task handles one
block and at most so many queries, so its memory is bounded. How many cells a query visits depends on the data: where all distances are much alike,
as for normal vectors of many dimensions, the test rules out few of them.

Equal vectors are one tree point that lists its smallest k + 1 ids (no other can be among the nearest k), so a very frequent vector costs no more than any other;
points that tie within rounding are all ranked.

Defined cases: null, empty, zero vectors and those with null or non-finite components take no part, as query or candidate, nor do null ids; vectors of other widths than the
query's are no candidates; repeated ids are rows each, never candidates of their own id; ties go to the smaller id; other columns, whatever their names, are ignored; no queries, no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, few, table
from .hashing import lists

DIMENSIONS, BLOCK, QUERIES, LEAF, CONFIDENCE, NEAREST, STEP = 8, 20_000, 2_000, 256, 0.95, 5, 50
#: Points kept beyond k + 1 until exact cosines decide (more are, if they tie); rows that the cells are fitted on; levels of their tree; widths with cells of their own.
SPARE, SAMPLE, LEVELS, WIDTHS = 10, 20_000, 10, 16
#: Squared distances this close may be in either order by rounding.
MARGIN = 1e-12


def chi_square_quantile(p: float, k: int) -> float:
    """Of the chi-square distribution with an even number k of degrees, by bisection of its closed form."""
    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, k // 2):
            term *= x / 2 / i
            total += term
        return 1 - np.exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        low, high = ((low + high) / 2, high) if below((low + high) / 2) < p else (low, (low + high) / 2)
    return high


def directions(width: int, dimensions: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([width, dimensions])).standard_normal((width, dimensions))


def cosine(a: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the rows of `a` with `q`; equal rows give equal values."""
    return (a * q).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((q * q).sum()))


class Tree:
    """kd-tree leaves over projected points, as ranges of a permutation with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.order = np.arange(len(points))
        self.edges = []
        todo = [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                self.edges.append((a, b))
                continue
            part = self.order[a:b]
            axis = int(np.ptp(points[part], axis=0).argmax())
            middle = (b - a) // 2
            self.order[a:b] = part[np.argpartition(points[part, axis], middle)]
            todo += [(a, a + middle), (a + middle, b)]
        self.low = np.stack([points[self.order[a:b]].min(axis=0) for a, b in self.edges])
        self.high = np.stack([points[self.order[a:b]].max(axis=0) for a, b in self.edges])

    def far(self, q: np.ndarray) -> np.ndarray:
        """Squared projected distance of each of the points `q` to each leaf's box."""
        total = np.zeros((len(q), len(self.edges)))
        for axis in range(q.shape[1]):
            x = q[:, axis, None]
            total += np.maximum(np.maximum(self.low[:, axis] - x, x - self.high[:, axis]), 0) ** 2
        return total


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, dimensions: int, leaf: int, confidence: float, bound: np.ndarray | None = None, seen: list | None = None) -> list[tuple[int, int, float]]:
    """(query's place, candidate id, cosine): of each query the nearest k found in the block.

    Every query sees leaves in its own order, one a round, until the test rules its next one out; in a round, queries of one leaf are verified together. `bound`
    is a squared distance within which each query has k neighbours elsewhere; `seen` takes (leaves verified, leaves there) of all queries together.
    """
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order], np.float64)
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
    rows = unit.view(np.dtype((np.void, 8 * unit.shape[1]))).ravel()
    _, first, point = np.unique(rows, return_index=True, return_inverse=True)
    held = np.argsort(point, kind="stable")  # the ids of a point, smallest first
    start = np.searchsorted(point[held], np.arange(len(first) + 1))
    points, unit = vectors[first], unit[first]
    asked = np.asarray(queries, np.float64)
    u = asked / np.sqrt((asked * asked).sum(axis=1))[:, None]
    through = directions(unit.shape[1], dimensions)
    tree, limit = Tree(unit @ through, leaf), chi_square_quantile(confidence, dimensions)
    far = tree.far(u @ through)
    kept = k + 1 + SPARE
    best, at = np.full((len(u), kept), np.inf), np.full((len(u), kept), -1)

    def verify(leaf_: int, who: np.ndarray) -> None:
        inside = tree.order[slice(*tree.edges[leaf_])]
        distance = np.maximum(2 - 2 * (u[who] @ unit[inside].T), 0)
        hit = (distance < best[who, -1, None]).any(axis=1)
        who, distance = who[hit], distance[hit]
        every = np.concatenate((best[who], distance), axis=1)
        names = np.concatenate((at[who], np.broadcast_to(inside, distance.shape)), axis=1)
        pick = np.argpartition(every, kept - 1, axis=1)[:, :kept]
        pick = np.take_along_axis(pick, np.take_along_axis(every, pick, 1).argsort(axis=1), 1)
        best[who], at[who] = np.take_along_axis(every, pick, 1), np.take_along_axis(names, pick, 1)

    ahead = np.argsort(far, axis=1, kind="stable")
    known = np.full(len(u), np.inf) if bound is None else np.asarray(bound, np.float64)
    active, verified = np.arange(len(u)), 0
    for turn in ahead.T:
        reach = np.minimum(best[active, k], known[active])
        active = active[~(far[active, turn[active]] > limit * np.maximum(reach, MARGIN))]
        if not len(active):
            break
        next_ = turn[active]
        verified += len(active)
        by = np.argsort(next_, kind="stable")
        for who in np.split(active[by], np.flatnonzero(np.diff(next_[by])) + 1):
            verify(int(turn[who[0]]), who)
    if seen is not None:
        seen.append((verified, far.size))
    out = []
    for place, qid in enumerate(query_ids.tolist()):
        found = at[place][at[place] >= 0]
        reach = best[place, k] + MARGIN
        if best[place, -1] <= reach < np.inf:  # more points tie within rounding than are kept: all of them are ranked
            found = np.union1d(found, np.flatnonzero(2 - 2 * (unit @ u[place]) <= reach))
        scores = cosine(points[found], asked[place])
        rows_ = [(-s, i) for s, p in zip(scores.tolist(), found.tolist(), strict=True) for i in ids[held[start[p] : min(start[p] + k + 1, start[p + 1])]].tolist() if i != qid]
        out += [(place, i, -s) for s, i in sorted(rows_)[:k]]
    return out


@dataclass
class Cells:
    """A kd-tree of full depth over projections, as axis and threshold by node; children of node i are 2 i + 1 and 2 i + 2, leaves are cells."""

    axis: np.ndarray
    threshold: np.ndarray
    levels: int

    @staticmethod
    def fit(points: np.ndarray, levels: int) -> Cells:
        axis, threshold = np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1)
        parts = [points]
        for level in range(levels):
            halves = []
            for i, part in enumerate(parts):
                node = (1 << level) - 1 + i
                if len(part):
                    axis[node] = int(np.ptp(part, axis=0).argmax())
                    threshold[node] = np.median(part[:, axis[node]])
                low = part[:, axis[node]] < threshold[node]
                halves += [part[low], part[~low]]
            parts = halves
        return Cells(axis, threshold, levels)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] >= self.threshold[node])
        return node - ((1 << self.levels) - 1)


def projected(vectors: list[np.ndarray], dimensions: int) -> np.ndarray:
    """Projections of vectors scaled to length 1; widths may differ."""
    out = np.empty((len(vectors), dimensions))
    width = np.array([len(v) for v in vectors], np.int64)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        x = np.stack([vectors[i] for i in at])
        out[at] = (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ directions(int(w), dimensions)
    return out


def _project(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = projected(lists(batch.column("vector")), dimensions).reshape(-1)
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * dimensions)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("id", "vector", "w")), pa.ListArray.from_arrays(ends, pa.array(p))], ["id", "vector", "w", "p"])

    return run


def _assign(cells: dict[int, Cells], dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("w").to_numpy()
            p = batch.column("p").flatten().to_numpy().reshape(-1, dimensions)
            cell = np.zeros(len(width), np.int64)
            for w, tree in cells.items():
                cell[width == w] = tree.of(p[width == w])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("id", "vector", "w", "p")), pa.array(cell)], ["id", "vector", "w", "p", "cell"])

    return run


def _visits(boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], dimensions: int, limit: float):
    """Of each query the other cells that the test doesn't rule out; boxes: by width, cells with their low and high corners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, own, bound = (batch.column(k).to_numpy() for k in ("w", "cell", "bound"))
            p = batch.column("p").flatten().to_numpy().reshape(-1, dimensions)
            for lo in range(0, len(width), 1000):
                part = slice(lo, lo + 1000)
                for w in np.unique(width[part]):
                    at = lo + np.flatnonzero(width[part] == w)
                    cell, low, high = boxes[int(w)]
                    far = sum(np.maximum(np.maximum(low[:, i] - p[at, i, None], p[at, i, None] - high[:, i]), 0) ** 2 for i in range(dimensions))
                    who, where = np.nonzero(~(far > limit * np.maximum(bound[at, None], MARGIN)) & (cell != own[at, None]))
                    rows = batch.take(pa.array(at[who]))
                    yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in ("id", "vector", "w", "bound")), pa.array(cell[where])], ["id", "vector", "w", "bound", "cell"])

    return run


PAIR = "q long, twin long, v long, score double"


def _search_group(k: int, dimensions: int, leaf: int, confidence: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        is_query, width = group.column("is_query").to_numpy(), key[0].as_py()
        flat = group.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, width)
        ids, row, bound = (group.column(c).to_numpy() for c in ("id", "row", "bound"))
        if is_query.all() or not is_query.any():
            found = []
        else:
            found = search(ids[~is_query], flat[~is_query], ids[is_query], flat[is_query], k, dimensions, leaf, confidence, bound[is_query])
            names = list(zip(ids[is_query].tolist(), row[is_query].tolist(), strict=True))  # an id may be repeated with other vectors
            found = [(*names[q], v, s) for q, v, s in found]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["q", "twin", "v", "score"])

    return run


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """id and vector of the rows that take part; components as doubles."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    return vectors.where(F.col(id_).isNotNull() & F.col(vector).isNotNull()).where(F.coalesce(fine, F.lit(False))).select(F.col(id_).cast("long").alias("id"), x.alias("vector"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, id_: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, block: int = BLOCK, query_block: int = QUERIES, leaf: int = LEAF, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of `vectors` to each row of `queries`."""
    project = lambda df: df.withColumn("w", F.size("vector")).mapInArrow(_project(dimensions), "id long, vector array<double>, w int, p array<double>")
    assign = lambda df, cells: df.mapInArrow(_assign(cells, dimensions), "id long, vector array<double>, w int, p array<double>, cell long")
    rows = project(usable(vectors, id_, vector))
    sizes = rows.groupBy("w").count().orderBy(F.desc("count"), "w").limit(WIDTHS).collect()
    levels = {r["w"]: min(LEVELS, int(np.ceil(np.log2(max(1, r["count"] / block))))) for r in sizes}
    cells = {}
    if any(levels.values()):
        drawn = rows.select("w", "p", F.xxhash64("id", "vector").alias("h")).orderBy("h").limit(SAMPLE).collect()  # SAMPLE rows of `dimensions` numbers
        for w, depth in levels.items():
            points = np.array([r["p"] for r in drawn if r["w"] == w]).reshape(-1, dimensions)
            cells[w] = Cells.fit(points, depth)
    placed = checkpointed(assign(rows, cells))
    asked = checkpointed(assign(project(usable(queries, id_, vector).dropDuplicates(["id", "vector"])), cells))

    def met(targets: DataFrame) -> DataFrame:
        """Rows found for the queries `targets` in their `cell`, by blocks of at most `block` rows and `query_block` queries (about)."""
        parts = placed.groupBy("w", "cell").agg(F.ceil(F.count("*") / block).alias("parts"))
        cuts = targets.groupBy("w", "cell").agg(F.ceil(F.count("*") / query_block).alias("cuts"))
        plan = checkpointed(parts.join(cuts, ["w", "cell"]))
        share = lambda n: F.pmod(F.xxhash64("id", "vector"), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        none = F.lit(float("inf")).alias("bound")
        one = placed.join(few(plan), ["w", "cell"]).select("w", "cell", "id", "vector", none, F.lit(False).alias("is_query"), share("parts").alias("part"), every("cuts").alias("cut"))
        two = targets.join(few(plan), ["w", "cell"]).select("w", "cell", "id", "vector", "bound", F.lit(True).alias("is_query"), share("cuts").alias("cut"), every("parts").alias("part"))
        both = one.unionByName(two).withColumn("row", F.xxhash64("vector"))
        found = both.groupBy("w", "cell", "part", "cut").applyInArrow(_search_group(k, dimensions, leaf, confidence), PAIR)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    order = Window.partitionBy("q", "twin").orderBy(F.desc("score"), "v")
    found = met(asked.withColumn("bound", F.lit(float("inf"))))
    if any(levels.values()):
        found = checkpointed(found)
        corners = [f(F.get("p", F.lit(i))).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(dimensions)]
        boxes: dict = defaultdict(list)
        for r in placed.where(F.col("w").isin(list(cells))).groupBy("w", "cell").agg(*corners).collect():  # 2^LEVELS cells a width at most; other widths have one cell
            boxes[r["w"]].append((r["cell"], [r[f"low{i}"] for i in range(dimensions)], [r[f"high{i}"] for i in range(dimensions)]))
        boxes = {w: tuple(np.array(c) for c in zip(*sorted(b), strict=True)) for w, b in boxes.items()}
        far = found.groupBy("q", "twin").agg(F.max(F.when(F.col("rank") == k, 2 - 2 * F.col("score"))).alias("bound"))
        bounded = asked.where(F.col("w").isin(list(boxes))).withColumn("twin", F.xxhash64("vector")).join(far.withColumnRenamed("q", "id"), ["id", "twin"], "left")
        bounded = bounded.select("id", "vector", "w", "p", "cell", (F.coalesce("bound", F.lit(float("inf"))) + MARGIN).alias("bound"))
        limit = chi_square_quantile(confidence, dimensions)
        others = checkpointed(bounded.mapInArrow(_visits(boxes, dimensions, limit), "id long, vector array<double>, w int, bound double, cell long"))
        found = found.unionByName(met(others)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select(F.col("q").alias("query_id"), "rank", F.col("v").alias("vec_id"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % STEP == 0))
