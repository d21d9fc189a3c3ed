"""Reconciling a new listing of files with the one before, and reusing what did not change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state, mtime_ms, size) of both listings: added, changed, unchanged or dropped. A file that is pending
    counts as changed, whatever its time."""
    old = previous.select("path", F.struct("mtime_ms", "size").alias("old"), F.col("pending").alias("was_pending"))
    new = current.select("path", F.struct("mtime_ms", "size").alias("new"))
    both = old.join(new, "path", "full_outer")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "dropped").when(F.coalesce("was_pending", F.lit(False)) | ~F.col("old").eqNullSafe(F.col("new")), "changed").otherwise("unchanged")
    now = F.coalesce("new", "old")
    return both.select("path", state.alias("state"), now["mtime_ms"].alias("mtime_ms"), now["size"].alias("size"))


def merged(previous_rows: DataFrame, fresh_rows: DataFrame, states: DataFrame, file_col: str) -> DataFrame:
    """Rows of unchanged files from before, and the fresh rows of the others."""
    same = states.where("state = 'unchanged'").select(F.col("path").alias(file_col))
    return previous_rows.join(same, file_col, "left_semi").unionByName(fresh_rows)


def report(states: DataFrame) -> DataFrame:
    """One row of counts over a diff."""
    read = F.col("state").isin("added", "changed")
    return states.agg(
        F.coalesce(F.sum(F.when(read, F.col("size"))), F.lit(0)).cast("long").alias("scanned_bytes"),
        F.count_if(read).alias("rescanned"),
        F.count_if(F.col("state") == "added").alias("added"),
        F.count_if(F.col("state") == "dropped").alias("dropped"),
        F.count_if(F.col("state") != "dropped").alias("total_files"),
    )


def status(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, pending_files, symbols, imports, and whether all of them obey the index rules."""
    one = files.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.coalesce("pending", F.lit(False))).alias("pending_files"))
    for rows, name in ((symbols, "symbols"), (edges, "imports")):
        one = one.crossJoin(rows.agg(F.count(F.lit(1)).alias(name)))  # one row each
    return one.crossJoin(violations(files, symbols, edges).agg((F.count(F.lit(1)) == 0).alias("consistent")))


def pending(files: DataFrame) -> DataFrame:
    """(path, size) of the files that the last refresh could not read."""
    return files.where(F.coalesce("pending", F.lit(False))).select("path", "size")


def staleness(verified_ms: Column, now_ms: Column) -> Column:
    """Milliseconds since the index was last verified, 0 where it never was or time ran backwards."""
    return F.coalesce(F.greatest(F.lit(0).cast("long"), now_ms - verified_ms), F.lit(0).cast("long"))


def of_known_files(rows: DataFrame, files: DataFrame, file_col: str = "file") -> DataFrame:
    """``rows`` whose file is one of ``files`` (path)."""
    return rows.join(files.select(F.col("path").alias(file_col)), file_col, "left_semi").select(*rows.columns)


def violations(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, rows) of the index rules that rows break; none, if the index is sound."""
    from textloom.functions.scalar import valid_relative

    known = files.select("path").distinct()
    whole = lambda c: F.coalesce(F.col(c) >= 0, F.lit(False))
    bad = [
        ("file", files.where(~(valid_relative(F.col("path")) & whole("mtime_ms") & whole("size")))),
        ("symbol", symbols.where(~(F.col("name") != "") | F.col("name").isNull() | ~whole("line"))),
        ("symbol_file", symbols.join(known, symbols["file"] == known["path"], "left_anti")),
        ("edge_status", edges.where(~F.coalesce(F.col("status").isin("resolved", "external", "outside", "unresolved"), F.lit(False)))),
        ("edge_target", edges.where(~F.coalesce(F.when(F.col("status") == "resolved", F.col("target").isNotNull() & (F.col("to") == F.col("target"))).otherwise(F.col("target").isNull() & (F.col("to") == F.col("specifier"))), F.lit(False)))),
        ("edge_file", edges.where("target is not null").join(known, F.col("target") == known["path"], "left_anti")),
    ]
    out = None
    for rule, rows in bad:
        one = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(rule).alias("rule"), "rows").where("rows > 0")
        out = one if out is None else out.unionByName(one)
    return out
