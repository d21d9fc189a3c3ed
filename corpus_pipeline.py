"""From raw documents to packed sequences: toxicity, near duplicates, source mixing, packing.

Each stage takes all rows that the one before it kept, written as Parquet and read again; all but the last return
the columns of ``documents``. Rows with a null id, repeated rows and null texts pass through every stage under the
rules of its operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import minhash, mixing, packing, toxicity
from textloom.llm.common import materialise, table


#: Rows of a stretch of numbered rows, whose decisions are one array; and the rows, a byte each, whose arrays are shared
#: with all tasks, so that texts stay where they are. The texts of a larger table are shuffled to their decisions.
STRETCH, SHARED = 1 << 12, 1 << 24


def _free(name: str, docs: DataFrame) -> str:
    """``name``, or a longer one that no column of ``docs`` has, whatever the case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written once, so that every later read agrees on it; and its name."""
    row = _free("row_number", docs)
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _repeated(numbered: DataFrame, row: str, counts: DataFrame) -> DataFrame:
    """Each row of ``numbered`` as often as ``counts`` (key, n: one for each row, n up to 127) tells, without ``row``.
    Row numbers have no gap within a partition, so a stretch's counts are an array by place."""
    columns, n = [c for c in numbered.columns if c != row], _free("n", numbered)
    if numbered.count() > SHARED:
        told = numbered.join(counts.where("n > 0").select(F.col("key").alias(row), F.col("n").alias(n)), row)
    else:
        stretch = F.floor(F.col("key") / STRETCH).alias("stretch")
        placed = F.sort_array(F.collect_list(F.struct("key", F.col("n").cast("byte").alias("n"))))
        arrays = materialise(counts.groupBy(stretch).agg(placed["n"].alias("n")), "counts").toDF(first := _free("stretch", numbered), n)
        at = (F.col(row) % STRETCH).cast("int")
        told = numbered.join(F.broadcast(arrays), F.floor(F.col(row) / STRETCH) == F.col(first)).withColumn(n, F.col(n)[at]).where(F.col(n) > 0)
    return told.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain, fitted on a bounded sample of this input's labelled documents, does not reject."""
    chain, _, _ = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    flag = _free("rejected", docs)
    return toxicity.score(docs, chain, prefix=_free("probability_of_", docs), flag=flag).where(~F.col(flag)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the least id; rows without an id stand behind all others in
    their order. Rows are told apart by a number of their own, so rows that share an id go only where their texts are
    similar. Rows without any word stay."""
    keyed, row = _numbered(docs)
    told = minhash.near_duplicates(keyed, id_col=row).select(F.col("doc_id").alias("key"), "n_shingles", "component_id")
    told = materialise(told.join(keyed.select(F.col(row).alias("key"), F.col("doc_id").cast("long").alias("id")), "key"), "told")
    best = told.where("n_shingles > 0").groupBy("component_id").agg(F.min_by("key", F.struct(F.col("id").isNull(), "id", "key")).alias("key")).select("key")
    kept = best.union(told.where("n_shingles = 0").select("key")).withColumn("n", F.lit(1))
    counts = told.select("key").join(kept, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))
    return _repeated(keyed, row, counts).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three times."""
    numbered, row = _numbered(docs)
    rows = numbered.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), mixing.word_count(F.col("text")).alias("size"), F.col(row).alias("row"))
    copies = mixing.mix_sized(materialise(rows, "mix"), extra=["row"])
    return _repeated(numbered, row, copies.select(F.col("row").alias("key"), F.coalesce("copies", F.lit(0)).alias("n"))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages' models and hashes have no SQL form; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
