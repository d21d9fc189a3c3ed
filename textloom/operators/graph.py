"""The dependency graph: degrees, PageRank, hotspots, orphans, neighbours. Parallel edges count each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.session import partitions, shared_path

ALPHA, TOLERANCE, MOST_ROUNDS = 0.85, 1e-6, 100
#: Edges that one task of PageRank's shuffles gets, so its memory does not grow with the graph.
EDGES_A_TASK = 500_000
NO_CONTEXT = "(no symbols/imports)"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    path = shared_path(spark, "graph")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("file")).union(edges.select(F.col("dst").alias("file"))).distinct()


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes."""
    return edges.join(nodes.select(F.col("file").alias("src")), "src", "left_semi").join(nodes.select(F.col("file").alias("dst")), "dst", "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, indegree, outdegree): one pass over both ends, summed before the shuffle."""
    ends = edges.select(F.col("dst").alias("file"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(edges.select(F.col("src").alias("file"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    sums = ends.groupBy("file").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))
    zero = F.lit(0).cast("long")
    return nodes.select("file").join(sums, "file", "left").select("file", F.coalesce("indegree", zero).alias("indegree"), F.coalesce("outdegree", zero).alias("outdegree"))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = ALPHA, tol: float = TOLERANCE, most: int = MOST_ROUNDS) -> tuple[DataFrame, int, bool]:
    """(file, rank), rounds and whether they converged: the sum of changes is under nodes * tol.

    Parallel edges are one edge of their count. A round is a join, a sum and one action; each round's ranks are
    written to the shared folder, which ends their lineage and lets a lost executor be replaced. Shuffles have as
    many partitions as the edges ask for.
    """
    with partitions(edges.sparkSession, -(-edges.count() // EDGES_A_TASK)):
        return _pagerank(checkpointed(nodes.select("file")), edges, alpha, tol, most)


def _pagerank(nodes: DataFrame, edges: DataFrame, alpha: float, tol: float, most: int) -> tuple[DataFrame, int, bool]:
    n = nodes.count()
    if n == 0:
        return nodes.select("file", F.lit(0.0).alias("rank")), 0, True
    weighted = inside(edges, nodes).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    out = weighted.groupBy("src").agg(F.sum("w").alias("out"))
    shares = checkpointed(weighted.join(out, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")))
    state = nodes.select("file").distinct().join(out.select(F.col("src").alias("file"), F.lit(True).alias("links")), "file", "left")
    state = checkpointed(state.select("file", F.coalesce("links", F.lit(False)).alias("links"), F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("change")))
    dangling = state.where("not links").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
    for i in range(1, most + 1):
        flow = shares.join(state.select(F.col("file").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("file")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        new = F.lit(alpha) * (F.coalesce("flow", F.lit(0.0)) + F.lit(dangling / n)) + F.lit((1 - alpha) / n)
        step = state.join(flow, "file", "left").select("file", "links", new.alias("new"), F.col("rank").alias("old"))
        state = checkpointed(step.select("file", "links", F.col("new").alias("rank"), F.abs(F.col("new") - F.col("old")).alias("change")))
        change, dangling = state.agg(F.sum("change"), F.coalesce(F.sum(F.when(~F.col("links"), F.col("rank"))), F.lit(0.0))).first()
        if change < n * tol:
            return state.select("file", "rank"), i, True
    return state.select("file", "rank"), most, False


def orphans(nodes: DataFrame, edges: DataFrame, uncertain: DataFrame) -> DataFrame:
    """Nodes that no edge touches and that have no edge of an unknown or outer target."""
    out = nodes.select("file")
    for used in (edges.select(F.col("src").alias("file")), edges.select(F.col("dst").alias("file")), uncertain.select("file")):
        out = out.join(used, "file", "left_anti")
    return out.orderBy("file")


def build_graph(files: DataFrame, edges: DataFrame) -> tuple[DataFrame, int, bool]:
    """The GRAPH table of ``edges`` (EDGES) over ``files`` (path)."""
    nodes = files.select(F.col("path").alias("file")).distinct()
    own = inside(edges.where("status = 'resolved'").select(F.col("from").alias("src"), F.col("target").alias("dst")), nodes)
    unsure = edges.where("status <> 'resolved'").select(F.col("from").alias("file"), F.lit(True).alias("uncertain")).distinct()
    ranks, rounds, converged = pagerank(nodes, own)
    table = degrees(nodes, own).join(ranks, "file").join(unsure, "file", "left").withColumn("uncertain", F.coalesce("uncertain", F.lit(False)))
    alone = (F.col("indegree") == 0) & (F.col("outdegree") == 0) & ~F.col("uncertain")
    return table.select("file", "indegree", "outdegree", "rank", "uncertain", alone.alias("is_orphan")), rounds, converged


def _told(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    return rows.join(contexts, "file", "left").select("file", "indegree", "rank", F.coalesce("context", F.lit(NO_CONTEXT)).alias("context"))


def hotspots(graph: DataFrame, contexts: DataFrame) -> DataFrame:
    return _told(graph.where("indegree > 0"), contexts).orderBy(F.desc("indegree"), F.desc("rank"), "file")


def orphan_rows(graph: DataFrame, contexts: DataFrame) -> DataFrame:
    return _told(graph.where("is_orphan"), contexts).orderBy("file")


def neighbours(edges: DataFrame, file: str, direction: str = "in") -> DataFrame:
    """Edges out of ``file``, or the resolved ones into it, by place."""
    if direction not in ("in", "out"):
        raise ValueError("direction must be in or out")
    own = edges.where(F.col("from") == file) if direction == "out" else edges.where((F.col("status") == "resolved") & (F.col("target") == file))
    return own.orderBy("from", "line", "seq")
