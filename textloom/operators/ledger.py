"""The usage ledger and the refresh history: totals, groups, newest rows, retention, trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.scalar import saved_percent


def filtered(ledger: DataFrame, root: str | None = None, tool: str | None = None) -> DataFrame:
    out = ledger.where(F.col("root") == root.rstrip("/")) if root else ledger
    return out.where(F.col("tool") == tool) if tool else out


def of_root(rows: DataFrame, root: str) -> DataFrame:
    return rows.where(F.col("root") == root)


def totals(ledger: DataFrame) -> DataFrame:
    """One row: calls, failures, sums, duplicate calls (an empty hash is never the first of its kind) and the saved
    share of the estimate of all bytes."""
    sums = ledger.agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if("failed").alias("failures"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"),
        F.coalesce(F.sum("naive_bytes"), F.lit(0)).alias("naive_bytes"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"),
        F.countDistinct(F.nullif(F.col("args_hash"), F.lit(""))).alias("kinds"),
    )
    return sums.select("calls", "failures", "chars", "naive_bytes", "saved_tokens", (F.col("calls") - F.col("kinds")).alias("dup_calls"), saved_percent(F.col("saved_tokens"), F.col("naive_bytes")).alias("saved_percent"))


def grouped(ledger: DataFrame, key: str) -> DataFrame:
    """(key, calls, saved_tokens), the most saved first."""
    out = ledger.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("calls"), F.sum("saved_tokens").alias("saved_tokens"))
    return out.orderBy(F.desc("saved_tokens"), F.desc("calls"), "key")


def newest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The last ``n`` rows in ``order``, oldest first."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def older(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """What ``newest`` leaves out: the rows before the bound that the last ``n`` begin with."""
    bound = rows.orderBy(*[F.desc(c) for c in order]).limit(n).agg(F.min(F.struct(*order)).alias("bound"))
    return rows.join(F.broadcast(bound), F.struct(*order) < F.col("bound")).drop("bound")  # one row


def retained(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """Retention with slack: nothing goes until there are twice ``most`` rows; then the newest ``most`` stay."""
    return rows if rows.limit(2 * most).count() < 2 * most else newest(rows, most, *order)


def retained_bytes(rows: DataFrame, most: int, most_bytes: int, size: str, *order: str) -> DataFrame:
    """The newest rows, at most ``most`` and at most ``most_bytes`` of ``size`` together, but one at least."""
    last = rows.orderBy(*[F.desc(c) for c in order]).limit(most)  # so the window sees no more than that
    down = W.orderBy(*[F.desc(c) for c in order])
    kept = last.withColumns({"__sum": F.sum(size).over(down.rowsBetween(W.unboundedPreceding, 0)), "__n": F.row_number().over(down)})
    return kept.where((F.col("__n") == 1) | (F.col("__sum") <= most_bytes)).drop("__sum", "__n").orderBy(*order)


def trend(rows: DataFrame, counters: list[str], n: int, *order: str) -> DataFrame:
    """The last row's counters less those of the one before, 0 with fewer than two rows, and the rows in the window."""
    last = rows.orderBy(*[F.desc(c) for c in order]).limit(n)
    newest_first = F.sort_array(F.collect_list(F.struct(*order, *counters)), asc=False)  # of n rows
    both = last.agg(newest_first.alias("r"))
    delta = [F.when(F.size("r") >= 2, F.col("r")[0][c] - F.get("r", F.lit(1))[c]).otherwise(F.lit(0).cast("long")).cast("long").alias(f"{c}_delta") for c in counters]
    return both.select(*delta, F.size("r").cast("long").alias("window_count"))
