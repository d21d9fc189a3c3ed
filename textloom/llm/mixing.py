"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.common import hash32, materialise, null_safe_join, ranked

#: What parts words (a fixed value of the contract): space, tab, newline, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\f\r"
CAP = 3.0
#: Rows of a hash bucket before its split by source and size class, of which there are hundreds.
PER_BUCKET = 7500


def word_count(text: Column) -> Column:
    """Runs of characters other than ``BLANKS``; null: 0. """
    flat = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * (len(BLANKS) - 1))
    inner = F.trim(flat)
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, " +"))).cast("long")


def source_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, of sources by code point, null last."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    return sources.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))


def capped_targets(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """Share the sum of all sizes by weight; a target stops at ``cap`` times its source's size and the excess is
    shared anew by weight. A source is capped iff its ratio ``cap * size / weight`` is under the final level, so
    one pass in order of that ratio finds the level.

    ``sizes``: a row per source (source, source_size, weight).
    """
    total = F.sum("source_size").over(W.partitionBy(F.lit(0)))
    first = W.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    place = F.row_number().over(first)
    before = first.rowsBetween(W.unboundedPreceding, -1)
    after = first.rowsBetween(0, W.unboundedFollowing)
    rated = sizes.withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("weight")).withColumns({"total": total})
    rated = rated.withColumn("place", place)
    rated = rated.withColumn("level", (F.col("total") - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # The first source whose ratio is not under the level left for it and those after it sets the level of all.
    free = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("place", "level"))).over(W.partitionBy(F.lit(0)))
    level = rated.withColumn("final", free["level"])
    target = F.when(F.col("final").isNull(), F.lit(cap) * F.col("source_size")).otherwise(F.least(F.col("weight") * F.col("final"), F.lit(cap) * F.col("source_size")))
    return level.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, cap: float = CAP, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row of ``docs`` with how often the mix takes it (``copies``) and the words that makes (``taken``).

    Within a source each document's expected copies are target / source_size. Documents stand in order of size
    class, hash and id; place times expected copies is the prefix sum; one offset per source is added; and a copy
    is emitted at each integer boundary that is crossed. Size: words; a null or empty text has 0, and takes 0
    words whatever its copies. Null is a source of its own, last. Sources without any word have target 0.
    Repeated rows are documents of their own; an empty table gives no rows. Reruns agree.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    return mix_sized(materialise(rows, "mix"), cap, seed)  # thin rows: the texts are read once


def mix_sized(rows: DataFrame, cap: float = CAP, seed: int = 1, extra: list[str] | None = None) -> DataFrame:
    """``mix`` over rows (doc_id, source, size, and any ``extra`` columns to keep)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = capped_targets(source_weights(sizes), cap)
    offset = hash32(F.lit(seed), F.col("source")) / F.lit(float(1 << 32))
    targets = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(F.lit(0.0))).withColumn("offset", offset)
    # Documents of like size follow each other, so whole copies come near the target.
    size_class = F.floor(F.sqrt(F.col("size").cast("double")) * 2)
    placed = ranked(rows, ["source"], [size_class], [F.col("doc_id"), F.col("size")], "__place", PER_BUCKET)
    mixed = null_safe_join(placed, targets, ["source"])
    upto = lambda place: F.floor(place * F.col("rate") + F.col("offset"))
    copies = (upto(F.col("__place") + 1) - upto(F.col("__place"))).cast("long")
    mixed = mixed.withColumn("copies", F.least(copies, F.lit(int(cap)).cast("long")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies", *(extra or []))
