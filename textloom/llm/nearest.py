"""Approximate nearest neighbours: stable projections, a kd-tree over all of them, and a chi-square stopping test.

The top of the tree, fitted on a bounded sample, deals all vectors to cells; below it, each cell has a tree of its own.
A query searches its own cell first. That bounds the distance of its k-th neighbour, and by the chi-square test it
visits only the other cells whose boxes are near enough in the projection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.common import hash32, materialise, prepare
from textloom.llm.vectors import as_vector, by_width, matrix, usable

#: Dimensions of a projection; an even number, for which the chi-square distribution is a finite sum.
PROJECTED = 8
#: A search stops when a nearer vector would have shown itself with this probability.
CONFIDENCE = 0.98
LEAF = 32
#: Vectors of a cell, about, and queries that meet one cell in one task.
LEAST_CELL, MOST_CELL, QUERY_BLOCK = 1024, 16384, 4096
#: Projected vectors that the top of the tree is fitted on: those with the least hashes of their ids.
SAMPLE = 16384
FOUND = "query long, query_id long, vec_id long, score double"


def chi_square(x: np.ndarray | float, dims: int = PROJECTED):
    """P(chi-square of ``dims`` (even) degrees of freedom <= x)."""
    half, term, total = np.minimum(np.asarray(x, float) / 2, 700.0), 1.0, 1.0
    for k in range(1, dims // 2):
        term = term * half / k
        total = total + term
    return 1 - np.exp(-half) * total


def projection(width: int, dims: int = PROJECTED) -> np.ndarray:
    """Independent standard normal columns, the 2-stable law: |projected|^2 / |v|^2 is chi-square of ``dims``."""
    return np.random.default_rng([width, dims]).standard_normal((width, dims))


class Tree:
    """A kd-tree over projected points; each leaf has a box."""

    def __init__(self, points: np.ndarray):
        self.leaves: list[np.ndarray] = []
        stack = [np.arange(len(points))]
        while stack:
            rows = stack.pop()
            if len(rows) <= LEAF:
                self.leaves.append(rows)
                continue
            own = points[rows]
            axis = int((own.max(0) - own.min(0)).argmax())
            half = len(rows) // 2
            order = np.argpartition(own[:, axis], half)
            stack += [rows[order[:half]], rows[order[half:]]]
        self.low = np.array([points[r].min(0) for r in self.leaves])
        self.high = np.array([points[r].max(0) for r in self.leaves])

    def leaf_distances(self, query: np.ndarray) -> np.ndarray:
        """Squared projected distance of the query from each leaf's box."""
        return (np.maximum(0, np.maximum(self.low - query, query - self.high)) ** 2).sum(1)


class Top:
    """The top of a kd-tree: ``depth`` levels of splits, so 2^depth cells."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        rows = {0: np.arange(len(points))}
        for node in range((1 << depth) - 1):
            own = rows.pop(node)
            if len(own):
                axis = int((points[own].max(0) - points[own].min(0)).argmax())
                self.axis[node], self.value[node] = axis, np.median(points[own, axis])
            right = points[own, self.axis[node]] > self.value[node]
            rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.value[node])
        return node - ((1 << self.depth) - 1)


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, query: np.ndarray, projected: np.ndarray, own: int, k: int, bound: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``k`` (distance, id), nearest first, of rows other than ``own``: leaves in order of projected distance are
    verified until the chi-square test says that a vector nearer than the k-th, or than ``bound``, would have been met."""
    near = tree.leaf_distances(projected)
    best_d, best_id, kth = np.zeros(0), np.zeros(0, np.int64), bound
    for leaf in np.argsort(near, kind="stable"):
        if near[leaf] > _STOP * kth * kth:
            break
        at = tree.leaves[leaf]
        distance = np.sqrt(((vectors[at] - query) ** 2).sum(1))
        keep = (rows[at] != own) & (distance <= kth)
        if keep.any():
            best_d, best_id = np.concatenate([best_d, distance[keep]]), np.concatenate([best_id, ids[at][keep]])
            order = np.lexsort((best_id, best_d))[:k]
            best_d, best_id = best_d[order], best_id[order]
            if len(best_d) == k:
                kth = min(kth, best_d[-1])
    return best_d, best_id


def _quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < p else (low, mid)
    return high


#: The test: chi_square(projected^2 / kth^2) >= CONFIDENCE, as a bound on the ratio.
_STOP = _quantile(CONFIDENCE, PROJECTED)


PLACED = "row long, id long, width int, vector array<double>, cell int, projected array<double>"
CELL = ["width", "cell"]


def _meet(stored: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """The neighbours of ``asking`` (row, id, vector, width, cell, bound) in their cells. A cell that many queries
    visit meets them in blocks."""

    def find(key, points: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[list, list, list, list]] = [([], [], [], [])]
        if points.num_rows and queries.num_rows:
            vectors, ids, rows = matrix(points["vector"]), points["id"].to_numpy(), points["row"].to_numpy()
            order = np.lexsort((rows, ids))
            vectors, ids, rows = vectors[order], ids[order], rows[order]
            turn = projection(vectors.shape[1])
            tree = Tree(vectors @ turn)
            asked_for = matrix(queries["vector"])
            for query, p, own, name, bound in zip(asked_for, asked_for @ turn, queries["row"].to_pylist(), queries["id"].to_pylist(), queries["bound"].to_pylist()):
                d, i = search(tree, vectors, ids, rows, query, p, own, k, bound)
                out.append(([own] * len(d), [name] * len(d), i.tolist(), d.tolist()))
        columns = [[x for part in out for x in part[c]] for c in range(4)]
        return pa.table({n: pa.array(c, pa.float64() if n == "score" else pa.int64()) for n, c in zip(("query", "query_id", "vec_id", "score"), columns)})

    blocks = asking.groupBy(*CELL).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    stored = stored.join(blocks, CELL).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asking = asking.join(blocks, CELL).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    met = [*CELL, "block"]
    stored, asking = stored.select(*met, "row", "id", "vector"), asking.select(*met, "row", "id", "vector", "bound")
    return stored.groupBy(*met).cogroup(asking.groupBy(*met)).applyInArrow(find, FOUND)


def nearest(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for each row that ``is_query``, an expression of ``id``: its ``k`` nearest
    other rows found, by Euclidean distance in double precision, ties to the smaller id; all, if there are fewer.

    Rows whose vector is null, empty, zero, or holds null or non-finite components, and rows without an id, take
    no part. Vectors of another width are no candidates. Repeated rows are queries and candidates each: only the
    query's own row is none, so a row that repeats it is its neighbour. An empty table gives no rows; other columns
    are not read.

    Of equal vectors the ``k`` + 1 with the least ids are stored, as no query can have more of them among its
    nearest. A true neighbour is missed with probability 1 - CONFIDENCE at most.
    """
    spark = rows.sparkSession
    prepare(spark)
    base = rows.select(F.col(id_col).cast("long").alias("id"), as_vector(vector_col).alias("vector")).where(F.col("id").isNotNull()).where(usable(F.col("vector")))
    n = base.count()
    cells = -(-n // min(MOST_CELL, max(LEAST_CELL, n // 16)))
    sample = base.orderBy(hash32(F.col("id")), "id").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    tops = {width: Top(points @ projection(width), math.ceil(math.log2(max(1, cells)))) for width, _, points in by_width(sample)} if len(sample) else {}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, near = np.zeros(batch.num_rows, np.int32), np.zeros((batch.num_rows, PROJECTED))
            for width, at, vectors in by_width(batch.column(3)):
                near[at] = vectors @ projection(width)
                if width in tops:
                    cell[at] = tops[width].cell(near[at])
            projected = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), PROJECTED).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), projected], ["row", "id", "width", "vector", "cell", "projected"])

    numbered = base.select(F.monotonically_increasing_id().alias("row"), "id", F.size("vector").alias("width"), "vector")
    placed = materialise(numbered.mapInArrow(place, PLACED), "placed")  # rows' numbers are settled by the writing
    copy = F.row_number().over(W.partitionBy("width", "vector").orderBy("id", "row"))
    stored = materialise(placed.drop("projected").withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy"), "stored")
    edges = [f(F.col("projected")[d]).alias(f"{side}{d}") for side, f in (("low", F.min), ("high", F.max)) for d in range(PROJECTED)]
    boxes = placed.groupBy(*CELL).agg(*edges).toArrow()  # a row a cell
    shared = spark.sparkContext.broadcast({name: boxes[name].to_numpy() for name in boxes.column_names})
    asking = placed.where(is_query)
    found = materialise(_meet(stored, asking.withColumn("bound", F.lit(math.inf)), k), "found")
    bounds = found.groupBy(F.col("query").alias("row")).agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("bound"))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = shared.value
        low, high = (np.stack([box[f"{side}{d}"] for d in range(PROJECTED)], 1) if len(box["cell"]) else np.zeros((0, PROJECTED)) for side in ("low", "high"))
        for batch in batches:
            width, cell, bound = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 4, 6))
            query, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, p in enumerate(matrix(batch.column(5))):
                gap = np.maximum(0, np.maximum(low - p, p - high))
                near = np.flatnonzero(((gap * gap).sum(1) <= _STOP * bound[i] * bound[i]) & (box["width"] == width[i]) & (box["cell"] != cell[i]))
                query.append(np.full(len(near), i))
                to.append(box["cell"][near])
            at = pa.array(np.concatenate(query))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(4)), pa.array(np.concatenate(to).astype(np.int32)), batch.column(6).take(at)], ["row", "id", "width", "vector", "cell", "bound"])

    further = asking.join(bounds, "row", "left").select("row", "id", "width", "vector", "cell", "projected", F.coalesce("bound", F.lit(math.inf)).alias("bound"))
    further = materialise(further.mapInArrow(visit, "row long, id long, width int, vector array<double>, cell int, bound double"), "further")
    every = found.unionByName(_meet(stored, further, k))
    rank = F.row_number().over(W.partitionBy("query").orderBy("score", "vec_id"))
    return every.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
