"""Every query with SQL agrees with DuckDB on a small scale."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    tell = lambda x: "" if x is None or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple("" if str(x) == "<NA>" else tell(x) for x in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    ours, theirs = entry.queries()[name](spark, str(DATA)).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_pagerank_multi(spark):
    import pandas as pd

    lines = pd.read_parquet(DATA / "lineitem.parquet")
    src, dst = "s" + lines["l_suppkey"].astype(str), "p" + lines["l_partkey"].astype(str)
    nodes = sorted({*src, *dst})
    rank, out = dict.fromkeys(nodes, 1 / len(nodes)), src.value_counts()
    for _ in range(100):
        loose = sum(rank[n] for n in nodes if n not in out.index)
        new = dict.fromkeys(nodes, 0.15 / len(nodes) + 0.85 * loose / len(nodes))
        for s, d in zip(src, dst):
            new[d] += 0.85 * rank[s] / out[s]
        change = sum(abs(new[n] - rank[n]) for n in nodes)
        rank = new
        if change < len(nodes) * 1e-6:
            break
    got = {r["file"]: r["rank"] for r in entry.queries()["pagerank_multi"](spark, str(DATA)).collect()}
    assert got.keys() == rank.keys() and all(math.isclose(got[n], rank[n], abs_tol=1e-9) for n in nodes)
