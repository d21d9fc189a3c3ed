"""The subpackage's queries over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table
from textloom.llm.lm_scoring import score_texts
from textloom.llm.minhash import near_duplicates
from textloom.llm.mixing import mix
from textloom.llm.nearest import nearest
from textloom.llm.packing import pack
from textloom.llm.sharding import assign_shards
from textloom.llm.token_counts import count_tokens
from textloom.llm.token_output import round_trip
from textloom.llm.toxicity import toxicity
from textloom.llm.vector_dedup import near_vectors


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), 8)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sharding, op2_nearest, op3_mixing, op4_minhash, op5_toxicity, op6_token_counts, op7_packing, op8_token_output, op9_lm_scoring, op10_vector_dedup)}

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
r AS (SELECT *, 3.0::DOUBLE * source_size / weight AS ratio, (SELECT CAST(sum(source_size) AS DOUBLE) FROM s) AS total FROM w),
l AS (SELECT *, row_number() OVER o AS place, (total - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST)),
f AS (SELECT *, (SELECT arg_min(level, place) FROM l WHERE ratio >= level) AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN 3.0::DOUBLE * source_size ELSE least(weight * final, 3.0::DOUBLE * source_size) END AS target,
  CAST(('0x' || substr(md5('1|' || coalesce(source, '\N')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS "offset" FROM f),
u AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0 END AS rate FROM t),
p AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY floor(sqrt(CAST(size AS DOUBLE)) * 2), CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '\N') || '|' || size), 1, 8)) AS BIGINT), doc_id, size) - 1 AS place FROM d),
c AS (SELECT p.*, source_size, target, least(CAST(floor((p.place + 1) * rate + "offset") - floor(p.place * rate + "offset") AS BIGINT), 3) AS copies FROM p JOIN u ON p.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, copies FROM c
"""

ORACLES: dict[str, str] = {"op3_mixing": MIX_SQL}
