"""Periodic reconciliation as a stream: each trigger is a batch that refreshes every corpus once."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from textloom.plans.corpus import Corpus

# The least, usual and greatest time between two rounds.
LEAST_MS, USUAL_MS, MOST_MS = 5_000, 300_000, 86_400_000
# End of the fixed values.


class Reconciler:
    """Refreshes its corpora one by one. A corpus whose root has gone is let go; one that fails is tried again in
    the next round; a batch that Spark runs a second time does nothing."""

    def __init__(self, corpora: Iterable[Corpus]):
        self.corpora = {c.root: c for c in corpora}
        self.done = -1
        self.reports: dict[str, dict | str] = {}

    def round(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.done:
            return
        for root, corpus in list(self.corpora.items()):
            if not os.path.isdir(root):
                del self.corpora[root]
                continue
            try:
                self.reports[root] = corpus.refresh()
                corpus.compact()
            except Exception as e:
                self.reports[root] = f"{type(e).__name__}: {e}"
        self.done = batch_id

    def start(self, spark: SparkSession, checkpoint: str, every_ms: int = USUAL_MS) -> StreamingQuery:
        """Rounds that would overlap are skipped: a trigger waits for the batch before it."""
        if not LEAST_MS <= every_ms <= MOST_MS:
            raise ValueError("every_ms out of range")
        ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
        return ticks.writeStream.foreachBatch(self.round).option("checkpointLocation", checkpoint).trigger(processingTime=f"{every_ms} milliseconds").start()
