"""Session, path and ranking helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom.session import prepare, shared_path

__all__ = ["hash32", "materialise", "null_safe_join", "prepare", "ranked", "shared_dir", "table", "trimmed"]

shared_dir = shared_path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def trimmed(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on Arrow batches, after which its worker, which Spark keeps, gives back the memory that is free."""

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash32(*cols: Column) -> Column:
    """A hash of 0 to 2^32 - 1 that any SQL engine can repeat: the first eight hex digits of md5."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def ranked(df: DataFrame, group: list[str], lead: list[Column], tie: list[Column], out: str, per_bucket: int = 512) -> DataFrame:
    """Add ``out``: each row's gapless 0-based place within ``group``, in order of ``lead`` (coarse), the hash of
    ``tie``, and ``tie``.

    No task sees a whole group: the hash range is cut into buckets, of about ``per_bucket`` rows over all, bucket
    totals are summed over two levels, and only the rows of one bucket are sorted together. The order does not
    depend on the number of buckets. Rows that are equal in all columns are one row with a count until their places
    are told, so that repeats don't crowd a bucket.
    """
    columns = df.columns
    df = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__c"))
    side = max(1, round((df.agg(F.coalesce(F.sum("__c"), F.lit(0))).first()[0] / per_bucket) ** 0.5))
    bucket = F.floor(F.col("__hash") * F.lit(side * side) / F.lit(float(1 << 32))).cast("long")
    keyed = df.withColumn("__hash", hash32(*tie)).withColumn("__lead", F.struct(*[x.alias(f"k{i}") for i, x in enumerate(lead)]) if lead else F.lit(0))
    keyed = keyed.withColumn("__hi", F.floor(bucket / side).cast("long")).withColumn("__lo", bucket % side)
    coarse_key = [*group, "__lead", "__hi"]
    fine_key = [*coarse_key, "__lo"]
    counts = keyed.groupBy(*fine_key).agg(F.sum("__c").alias("__n"))
    coarse = counts.groupBy(*coarse_key).agg(F.sum("__n").alias("__m"))
    before = W.partitionBy(*group).orderBy("__lead", "__hi").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*coarse_key).orderBy("__lo").rowsBetween(W.unboundedPreceding, -1)
    start = coarse.withColumn("__base", F.coalesce(F.sum("__m").over(before), F.lit(0))).drop("__m")
    places = counts.withColumn("__within", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    places = null_safe_join(places, start, coarse_key).select(*fine_key, (F.col("__base") + F.col("__within")).alias("__from"))
    above = W.partitionBy(*fine_key).orderBy("__hash", *tie, *columns).rowsBetween(W.unboundedPreceding, -1)
    local = keyed.withColumn("__row", F.coalesce(F.sum("__c").over(above), F.lit(0)))
    joined = null_safe_join(local, places, fine_key)
    first = (F.col("__from") + F.col("__row")).cast("long")
    return joined.withColumn(out, F.explode(F.sequence(first, first + F.col("__c") - 1))).select(*columns, out)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` where nulls equal nulls; the right side's keys go."""
    other = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        on = same if on is None else on & same
    return left.join(other, on).drop(*[f"__r_{k}" for k in keys])
