"""A Spark data source for file trees: ``spark.read.format("textloom_tree")``.

Options: ``path`` (a folder that driver and executors share), ``exts`` and ``skip`` (comma lists), ``maxbytes``,
``texts`` (false: no text is read). Spark's own file readers leave out names that begin with '_' or '.', which
a source tree needs. Directories are walked on the driver, pruned by name before any file is looked at; files
are read by the executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, mtime_ms double, size long, text string, error string"
FILES_PER_PARTITION = 500


def walk(root: str, exts: tuple[str, ...], skip: tuple[str, ...]) -> list[str]:
    """Relative paths of the regular files admitted, sorted. Links are left out; a folder that can't be read fails
    the walk, so that its files do not look dropped."""
    found, stack = [], [""]
    while stack:
        here = stack.pop()
        with os.scandir(os.path.join(root, here)) as entries:
            for e in entries:
                path = f"{here}/{e.name}" if here else e.name
                if e.is_dir(follow_symlinks=False):
                    if e.name not in skip:
                        stack.append(path)
                elif e.is_file(follow_symlinks=False) and (not exts or os.path.splitext(e.name)[1].lower() in exts):
                    found.append(path)
    return sorted(found)


def read_file(root: str, path: str, max_bytes: int, texts: bool) -> tuple:
    """(path, mtime, size, text, error): a file that changes while it is read, or can't be, has an error."""
    full = os.path.join(root, path)
    try:
        before = os.stat(full)
        text = None
        if texts and before.st_size <= max_bytes:
            with open(full, "rb") as f:
                text = f.read().decode("utf-8", "replace")
            after = os.stat(full)
            if (after.st_mtime_ns, after.st_size) != (before.st_mtime_ns, before.st_size):
                return path, before.st_mtime_ns / 1e6, before.st_size, None, "changed_while_read"
        return path, before.st_mtime_ns / 1e6, before.st_size, text, None
    except OSError as e:
        return path, None, None, None, type(e).__name__


class Share(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        split = lambda k: tuple(x for x in options.get(k, "").split(",") if x)
        self.exts, self.skip = split("exts"), split("skip")
        self.max_bytes = int(options.get("maxbytes", 512 << 10))
        self.texts = options.get("texts", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        paths = walk(self.root, self.exts, self.skip)
        return [Share(paths[s : s + FILES_PER_PARTITION]) for s in range(0, len(paths), FILES_PER_PARTITION)] or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        for path in partition.paths:
            yield read_file(self.root, path, self.max_bytes, self.texts)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "textloom_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)
