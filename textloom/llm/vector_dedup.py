"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import hash32, materialise, prepare, trimmed
from textloom.llm.components import components
from textloom.llm.vectors import as_vector, by_width, matrix, usable

LEAST_COSINE = 0.93
#: Reference points: twice the root of the number of classes, between these bounds. They are taken from twice as many
#: classes, those with the least hashes of their ids, which bounds the sample; of points whose cosine is beyond APART
#: one serves, or else the members of a dense cluster would each have an order of their own.
LEAST_PIVOTS, MOST_PIVOTS, APART = 128, 2048, 0.75
#: A vector is described by its NEAREST pivots in order. The weight of a pivot falls with its place, from NEAREST to
#: 1; a candidate pair has two pivots in common and AGREEMENT as the sum of the products of their weights (204 where
#: the orders are equal). Of uniform vectors at cosine 0.93, 98 to 99.9 of 100 pairs pass, by the number of pivots.
NEAREST, AGREEMENT = 8, 20
WEIGHTS = np.multiply.outer(np.arange(NEAREST, 0, -1), np.arange(NEAREST, 0, -1)).ravel().astype(np.float32)
#: Members of an inverted list that meet in one row, and pairs that are compared at once.
BLOCK, AT_ONCE = 512, 1 << 15


def permutation(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of each vector's nearest pivots by angle, nearest first, ties to the smaller number; -1 where
    there are no more."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.full((len(vectors), NEAREST), -1, np.int32)
    near = np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :NEAREST]
    out[:, : near.shape[1]] = near
    return out


def chosen(points: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` unit vectors, the first that are APART from those before them."""
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = unit @ unit.T > APART
    free, out = np.ones(len(unit), bool), []
    for i in range(len(unit)):
        if free[i] and len(out) < most:
            out.append(i)
            free &= ~near[i]
    return unit[out]


def agreement(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of two matrices of permutations: which places of ``a`` are pivots of ``b``, too; the weighed sum."""
    same = (a[:, :, None] == b[:, None, :]) & (a >= 0)[:, :, None]
    return same.any(2), same.reshape(len(a), -1).astype(np.float32) @ WEIGHTS


def linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    dot = (x * y).sum(1)
    return dot / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))) >= least


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node reached by each of ``n`` nodes through the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within groups of these sizes that stand one after the other, as two arrays of row numbers."""
    base = np.cumsum(sizes) - sizes
    after = np.repeat(sizes + base, sizes) - np.arange(sizes.sum()) - 1  # later members of each row's group
    a = np.repeat(np.arange(len(after)), after)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)


def _compare(rows: pa.StructArray, sizes: np.ndarray, pair: np.ndarray, split: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, classes): the links within cells of these sizes, told in the list of their least two common pivots;
    ``pair``: the pivots of each cell's list; ``split``: whether a cell is two blocks that meet."""
    own, ids = (rows.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    signs, vectors = matrix(rows.field(3)).astype(np.int32), matrix(rows.field(4))
    cell = np.repeat(np.arange(len(sizes)), sizes)
    a, b = _pairs(sizes)
    found = [np.zeros((2, 0), np.int64)]
    for s in range(0, len(a), AT_ONCE):
        x, y = a[s : s + AT_ONCE], b[s : s + AT_ONCE]
        want = ~split[cell[x]] | (own[x] != own[y])
        x, y = x[want], y[want]
        of = pair[cell[x]]
        shared, weight = agreement(signs[x], signs[y])
        first = (shared & (signs[x] <= of[:, 1:])).sum(1) == 2  # the list's pivots are the least that both have
        want = (of[:, 0] < 0) | (first & (weight >= AGREEMENT))
        x, y = x[want], y[want]
        good = linked(vectors[x], vectors[y], least)
        found.append(np.stack([x[good], y[good]]))
    a, b = np.concatenate(found, axis=1)
    return a, b, ids


def near_vectors(rows: DataFrame, least: float = LEAST_COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Every row of ``rows``: vec_id, n_links, component_id, kept.

    Two rows are linked when their labels are equal and not null and their cosine is ``least`` or more, in double
    precision. Rows whose vector is null, empty, zero or holds null or non-finite components, or whose id is null,
    link with nothing. Equal vectors of a label are one class: n_links counts the class's other rows and all rows
    of the classes linked to it, whatever their ids; rows that share an id are rows of their own. Vectors of unlike
    width are never linked. An empty table gives no rows; other columns are not read.

    Each vector stands in an inverted list for every two of its nearest pivots (with its label); longer lists are
    cut into blocks, and a row of the comparison is a pair of blocks, so no task holds a list. Of the vectors of a
    list, those whose orders of pivots agree are verified. Where a width has less than two pivots, all its vectors of
    a label are in one list and all are verified, so that nothing is lost.
    """
    prepare(rows.sparkSession)
    table = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), as_vector(vector_col).alias("vector"))
    fit = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # Zeros lose their sign, so that equal vectors are equal as group keys.
    table = table.withColumn("vector", F.when(fit, F.transform("vector", lambda x: x + 0.0)))
    classes = table.where("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # numbers settled by the writing
    wanted = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 * classes.count() ** 0.5)))
    sample = classes.orderBy(hash32(F.col("least")), "least", "label").limit(2 * wanted).select("vector").toArrow()["vector"].combine_chunks()
    pivots: dict[int, np.ndarray] = {}
    for width, _, points in by_width(sample) if len(sample) else ():
        points = chosen(points, wanted)
        if len(points) > 1:
            pivots[width] = points

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = np.full((batch.num_rows, NEAREST), -1, np.int32)
            for width, at, vectors in by_width(batch.column(3)):
                if width in pivots:
                    signs[at] = permutation(vectors, pivots[width])
            listed = pa.FixedSizeListArray.from_arrays(pa.array(signs.ravel()), NEAREST).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], ["id", "label", "n", "vector", "pivots"])

    indexed = classes.select("id", "label", "n", "vector").mapInArrow(trimmed(index), "id long, label string, n long, vector array<double>, pivots array<int>")
    indexed = materialise(indexed, "index").withColumn("width", F.size("vector"))
    used = F.array_sort(F.filter("pivots", lambda x: x >= 0))
    two = F.when(F.size(used) < 2, F.array(F.struct(F.lit(-1).alias("p"), F.lit(-1).alias("q")))).otherwise(F.flatten(F.transform(used, lambda x: F.transform(F.filter(used, lambda y: y > x), lambda y: F.struct(x.alias("p"), y.alias("q"))))))
    lists = indexed.withColumn("two", F.explode(two)).select("*", "two.p", "two.q").drop("two")
    list_key = ["label", "width", "p", "q"]
    blocks = lists.groupBy(*list_key).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(*list_key, F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    met = lists.join(blocks, list_key).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = met.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"i": F.least("own", "peer"), "j": F.greatest("own", "peer")})
    cells = met.groupBy(*list_key, "i", "j").agg(F.collect_list(F.struct("own", "id", "n", "pivots", "vector")).alias("rows"))
    cells = cells.where(F.size("rows") > 1).select("width", "p", "q", "i", "j", "rows")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(0).to_numpy()
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                p, q, i, j = (part.column(k).to_numpy() for k in range(1, 5))
                cell = part.column(5)
                flat = cell.flatten()
                a, b, ids = _compare(flat, cell.value_lengths().to_numpy().astype(np.int64), np.stack([p, q], 1), i != j, least)
                if len(a):
                    node, number = np.unique(ids, return_inverse=True)
                    n = flat.field(2).to_numpy(zero_copy_only=False)
                    links = np.bincount(number[a], n[b], len(node)) + np.bincount(number[b], n[a], len(node))
                    label = _least_labels(len(node), number[a], number[b])
                    has = np.flatnonzero(links)
                    yield pa.RecordBatch.from_arrays([pa.array(node[has], pa.int64()), pa.array(node[label[has]], pa.int64()), pa.array(links[has].astype(np.int64), pa.int64())], ["id", "other", "links"])

    found = materialise(cells.mapInArrow(trimmed(compare), "id long, other long, links long"), "links")
    labels = components(found, "id", "other").withColumnRenamed("node", "id")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    told = classes.join(counts, "id", "left").join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    told = materialise(told.select("label", "vector", "least", "component", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "told")
    smallest = told.groupBy("component").agg(F.min("least").alias("component_id"))
    told = told.join(smallest, "component").select("label", "vector", "n_links", "component_id")
    out = table.join(told, ["label", "vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
