from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom import schemas
from textloom.functions import json_keys
from textloom.operators import graph, ledger, snapshot, symbols
from textloom.sources import jsonl


def test_golden_pagerank(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "hub"), ("b", "c"), ("c", "a"), ("d", "hub")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", "e", "hub")], "file string")
    ranks, rounds, converged = graph.pagerank(nodes, edges)
    got = {r["file"]: round(r["rank"], 6) for r in ranks.collect()}
    assert converged and rounds == 26
    assert got == {"a": 0.249006, "hub": 0.229912, "c": 0.214037, "b": 0.172899, "d": 0.067073, "e": 0.067073}


def test_partitions_of_pagerank_follow_the_edges(spark, monkeypatch):
    edges = spark.range(1000).selectExpr("concat('a', id % 37) as src", "concat('b', id % 91) as dst")
    told = lambda: {r["file"]: r["rank"] for r in graph.pagerank(graph.endpoints(edges), edges)[0].collect()}
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes")
    before, few = [spark.conf.get(k) for k in keys], told()
    seen, real = set(), graph.checkpointed
    monkeypatch.setattr(graph, "EDGES_A_TASK", 50)
    monkeypatch.setattr(graph, "checkpointed", lambda df: (seen.add(tuple(spark.conf.get(k) for k in keys)), real(df))[1])
    many = told()
    assert seen == {("20", "false", "8m")} and [spark.conf.get(k) for k in keys] == before
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-12 for k in few)


def test_parallel_edges_weigh_and_orphans_are_certain(spark):
    rows = [("a", "b", "resolved", "b"), ("a", "b", "resolved", "b"), ("a", "c", "resolved", "c"), ("u", "react", "external", None)]
    edges = spark.createDataFrame([(f, s, st, t, t or s, i, "", i) for i, (f, s, st, t) in enumerate(rows)], schemas.EDGES)
    files = spark.createDataFrame([(x,) for x in "abcuz"], "path string")
    table, _, converged = graph.build_graph(files, edges)
    got = {r["file"]: r for r in table.collect()}
    assert converged and got["b"]["indegree"] == 2 and got["a"]["outdegree"] == 3 and got["b"]["rank"] > got["c"]["rank"]
    assert [f for f, r in got.items() if r["is_orphan"]] == ["z"] and got["u"]["uncertain"]
    contexts = spark.createDataFrame([("b", "ctx")], "file string, context string")
    assert [(r["file"], r["context"]) for r in graph.hotspots(table, contexts).collect()] == [("b", "ctx"), ("c", graph.NO_CONTEXT)]
    assert [r["from"] for r in graph.neighbours(edges, "b", "in").collect()] == ["a", "a"]


def test_empty_graph(spark):
    nodes, edges = spark.createDataFrame([], "file string"), spark.createDataFrame([], "src string, dst string")
    ranks, rounds, converged = graph.pagerank(nodes, edges)
    assert ranks.count() == 0 and converged and rounds == 0


LEDGER = [(1, "r", "find", "h1", 40, 400, 90, False), (2, "r", "find", "h1", 40, 400, 90, False), (3, "q", "read", "", 4, 0, 0, True), (4, "q", "read", "", 4, 0, 0, False)]


def test_ledger(spark):
    rows = spark.createDataFrame(LEDGER, schemas.LEDGER)
    got = ledger.totals(rows).first()
    assert (got["calls"], got["failures"], got["dup_calls"], got["saved_tokens"], got["saved_percent"]) == (4, 1, 3, 180, 90.0)
    assert ledger.totals(rows.where("false")).first()["saved_percent"] == 0.0
    assert [r["key"] for r in ledger.grouped(rows, "tool").collect()] == ["find", "read"]
    assert [r["ts"] for r in ledger.newest(rows, 2, "ts").collect()] == [3, 4]
    assert sorted(r["ts"] for r in ledger.older(rows, 2, "ts").collect()) == [1, 2]
    assert ledger.retained(rows, 3, "ts").count() == 4 and ledger.retained(rows, 2, "ts").count() == 2
    assert ledger.retained_bytes(rows, 4, 5, "naive_bytes", "ts").count() == 2
    assert ledger.filtered(rows, "r/", "find").count() == 2


def test_trend(spark):
    rows = spark.createDataFrame([(1, 10), (2, 25), (3, 5)], "ts long, n long")
    assert tuple(ledger.trend(rows, ["n"], 10, "ts").first()) == (-20, 3)
    assert tuple(ledger.trend(rows, ["n"], 1, "ts").first()) == (0, 1)
    assert tuple(ledger.trend(rows.where("false"), ["n"], 1, "ts").first()) == (0, 0)


def test_corrupt_lines(spark):
    lines = ['{"ts":1,"tool":"t","chars":1,"naive_bytes":2,"saved_tokens":0}', "", "  ", "{", '{"ts":"x","tool":"t","chars":1,"naive_bytes":2,"saved_tokens":0}', '{"tool":"t"}', "[1]"]
    rows, bad = jsonl.parsed(spark.createDataFrame([(x,) for x in lines], "value string"), schemas.LEDGER, ["ts", "tool", "chars", "naive_bytes", "saved_tokens"])
    assert rows.count() == 1 and bad.count() == 4


def test_symbol_order_and_pages(spark):
    data = [("run", "b", 1, "f", "", 0), ("runner", "a", 1, "f", "", 0), ("rerun", "a", 2, "f", "", 1), ("r", "c", 1, "f", "", 0)]
    rows = symbols.matching(spark.createDataFrame(data, schemas.SYMBOLS), "RUN")
    assert rows.count() == 4  # the query contains 'r'
    ranks = spark.createDataFrame([("a", 0.1), ("c", 0.9)], "file string, rank double")
    out, order = symbols.with_order(rows, "run", ranks, ["a"])
    assert [r["name"] for r in out.orderBy(*order).collect()] == ["run", "runner", "rerun", "r"]
    plain, order = symbols.with_order(rows, "run")
    first, rest = symbols.page(plain, order, 3)
    assert [r["file"] for r in first.collect()] == ["a", "a", "b"] and rest.count() == 1


def test_snapshot(spark):
    old = spark.createDataFrame([("a", 1.0, 1, False), ("b", 1.0, 1, False), ("c", 1.0, 1, True), ("d", 1.0, 1, False)], schemas.FILES)
    new = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1), ("c", 1.0, 1), ("e", 1.0, 5)], "path string, mtime_ms double, size long")
    states = snapshot.diff(old, new)
    assert {r["path"]: r["state"] for r in states.collect()} == {"a": "unchanged", "b": "changed", "c": "changed", "d": "dropped", "e": "added"}
    assert snapshot.report(states).first().asDict() == {"scanned_bytes": 7, "rescanned": 3, "added": 1, "dropped": 1, "total_files": 4}


def test_violations(spark):
    files = spark.createDataFrame([("a/b", 1.0, 1, False), ("../x", 1.0, 1, False)], schemas.FILES)
    names = spark.createDataFrame([("", "a/b", 1, "f", "", 0)], schemas.SYMBOLS)
    edges = spark.createDataFrame([("a/b", "s", "resolved", "gone", "gone", 1, "", 0), ("a/b", "s", "odd", None, "s", 1, "", 0)], schemas.EDGES)
    assert {r["rule"] for r in snapshot.violations(files, names, edges).collect()} == {"file", "symbol", "edge_status", "edge_file"}


@pytest.mark.parametrize("path, ok", [("a/b.ts", True), ("", False), ("/a", False), ("a//b", False), ("a/../b", False), ("./a", False), ("a\\b", False), (".hidden/..x", True)])
def test_paths(spark, path, ok):
    from textloom.functions.scalar import valid_relative

    assert spark.range(1).select(valid_relative(F.lit(path)).alias("v")).first()["v"] == ok


def test_rows_of_one_file_are_dealt_out_before_scanning(spark, tmp_path):
    path = str(tmp_path / "texts")
    spark.range(2000).selectExpr("id", """concat('{"a":', id, ',"b":[1],"c":null}') as text""").coalesce(1).write.parquet(path)
    told = json_keys.json_keys(spark.read.parquet(path), "id", "text", page_number=0, limit=2)
    parts = {r["p"]: r["n"] for r in told.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(parts) >= spark.sparkContext.defaultParallelism and max(parts.values()) < 1000
    assert {(r["id"], r["ordinal"], r["key"], r["validation"]) for r in told.collect()} == {(i, k, "ab"[k], "incomplete") for i in range(2000) for k in (0, 1)}
