"""A session with the settings that the operators are tuned for; a cluster's own settings win."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch, where the session sets none: bounds what a Python worker holds at once.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "textloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """This package as an archive for the executors' Python workers; made and sent once an application."""
    if spark.sparkContext.applicationId in _shipped:
        return
    _shipped.add(spark.sparkContext.applicationId)
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="textloom-")) / "textloom.zip"
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def prepare(spark: SparkSession) -> None:
    """Give Python workers this package, and bound Arrow batches unless the session sets their bounds itself."""
    _ship(spark)
    own = spark.conf.getAll
    for key, value in ARROW.items():
        if key not in own:
            spark.conf.set(key, value)


#: Partitions of each core, for rows that are much work, and bytes of one in a table that has as many by itself.
DEALT, SPLIT = 4, 128 << 20


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out evenly over the cores before work in Python, as a file of few row groups keeps few cores
    busy; a table that is large enough to come in as many parts stays as it is."""
    parts = DEALT * rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows if size >= parts * SPLIT else rows.repartition(parts)


#: Bytes of a file that a task reads within ``partitions``.
PARTS = "8m"


@contextlib.contextmanager
def partitions(spark: SparkSession, least: int) -> Iterator[None]:
    """What is run within shuffles to ``least`` partitions, or to the session's if they are more, and if ``least`` are
    more they are not merged, as merging goes by packed bytes and not by what a task holds of them; and files are
    read in parts of PARTS, as a sum before a shuffle holds what a part has."""
    if least <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        yield
        return
    given = {"spark.sql.shuffle.partitions": str(least), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": PARTS}
    before = {key: spark.conf.get(key) for key in given}
    try:
        for key, value in given.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@functools.cache
def _own_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix="textloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def _base(spark: SparkSession) -> str:
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder(context.applicationId)
    return f"{base.rstrip('/')}/textloom/{context.applicationId}"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the session names in spark.checkpoint.dir, or else in the context's own
    checkpoint folder. Where neither is set a local one serves a local master; on a cluster that is an error.

    What is written there stays until the application ends, or ``release`` is called.
    """
    _release_at_exit(spark.sparkContext.applicationId)
    return f"{_base(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Delete all that this application has written to ``shared_path``; frames that read it can't be used after."""
    discard(spark, _base(spark))


@functools.cache
def _release_at_exit(application: str) -> None:
    def clean() -> None:
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == application:
            with contextlib.suppress(Exception):  # the context may be stopping
                release(spark)

    atexit.register(clean)
