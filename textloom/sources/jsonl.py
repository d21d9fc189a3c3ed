"""Append-only JSON lines: reading with corrupt lines told apart, appending, and overflow files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def parsed(lines: DataFrame, schema: T.StructType, required: list[str], column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt): blank lines are skipped; a line is corrupt if it is no JSON object of the schema's types or
    lacks a required field. The corrupt count covers all roots, as it is taken before any filter."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    text = lines.where(F.trim(column) != "").select(F.col(column).alias("__line"))
    read = text.select("__line", F.from_json("__line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad: Column = F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()
    for name in required:
        bad = bad | F.col(f"r.{name}").isNull()
    bad = F.coalesce(bad, F.lit(True))
    return read.where(~bad).select(*[F.col(f"r.{f.name}") for f in schema.fields]), read.where(bad).select(F.col("__line").alias("line"))


def read(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    return parsed(spark.read.text(path), schema, required)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def spill(rows: DataFrame, path: str) -> dict[str, object]:
    """Write what a page leaves out; where it is, and how many rows."""
    rows.write.json(path)
    return {"spill_path": path, "spill_count": rows.sparkSession.read.schema(rows.schema).json(path).count()}
