"""Token counts of whole texts: Arrow batches go in, lengths only come out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import prepare, trimmed
from textloom.llm.encoding import encoder, vocabulary

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, UTF-8 bytes, tokens, and whether these exceed ``limit``.

    A null or empty text has 0 bytes and 0 tokens; null ids and repeated rows are kept as they are; an empty
    table gives no rows; other columns are not read. Arrow batches are bounded by bytes; their texts are
    cut at spaces that no token spans, long ones a part at a time, and each distinct segment is encoded once.
    """
    prepare(docs.sparkSession)
    path = path or vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_batch
        for batch in batches:
            _, tokens = encode(batch.column(1), lengths_only=True)
            n_bytes = pc.binary_length(batch.column(1)).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(tokens, pa.int64()), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.col(text_col).cast("string").alias("text")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text).mapInArrow(trimmed(count), SCHEMA)
