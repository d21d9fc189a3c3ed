"""The index on disk: generations of Parquet tables, and one small file that names the current one.

A generation is written whole before the name moves to it, so readers see the old or the new one, never a mix.
Files are reached through Hadoop's file system, so the folder may be in any store that Spark reads.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from textloom import schemas
from textloom.operators.snapshot import of_known_files, violations

VERSION = 1
TABLES = {"files": schemas.FILES, "symbols": schemas.SYMBOLS, "edges": schemas.EDGES, "graph": schemas.GRAPH}


class Cancelled(RuntimeError):
    pass


class IndexStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._sound: set[str] = set()
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        path = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        """Write beside the name and rename over it."""
        temporary, final = self._path(f"{self.folder}/{name}.{uuid.uuid4().hex}"), self._path(f"{self.folder}/{name}")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        # Renamed over in one step, so that readers find the old or the new one.
        jvm = self.spark.sparkContext._jvm
        kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename", True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        over = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        over[0] = next(x for x in kind.getEnumConstants() if x.name() == "OVERWRITE")
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(temporary), self._fs.makeQualified(final), over)

    def meta(self) -> tuple[dict | None, str]:
        """The current generation's record, and missing, corrupt, stale or ok."""
        try:
            text = self._read("current.json")
            if text is None:
                return None, "missing"
            got = json.loads(text)
            assert isinstance(got["generation"], str) and isinstance(got["version"], int)
        except (ValueError, KeyError, TypeError, AssertionError, Py4JJavaError):  # the last: a checksum differs
            return None, "corrupt"
        return (got, "ok") if got["version"] == VERSION else (None, "stale")

    def load(self, fingerprint: str) -> tuple[dict[str, DataFrame], dict, str]:
        """Tables, record and state. Anything but ``ok`` gives empty tables: the caller builds anew."""
        got, state = self.meta()
        if got and got.get("fingerprint") != fingerprint:
            got, state = None, "stale"
        if got:
            try:
                tables = {n: self.spark.read.schema(s).parquet(f"{self.folder}/{got['generation']}/{n}") for n, s in TABLES.items()}
                if got["generation"] not in self._sound:  # once a generation: the rules that its rows must obey
                    broken = violations(tables["files"], tables["symbols"], tables["edges"]).limit(1).collect()
                    if broken:
                        raise ValueError(f"rows break the rule {broken[0]['rule']}")
                    self._sound.add(got["generation"])
                return tables, got | self._verified(got), state
            except Exception:  # a table is gone or no Parquet: rebuilt like any other corrupt index
                state = "corrupt"
        return {n: self.spark.createDataFrame([], s) for n, s in TABLES.items()}, {}, state

    def _verified(self, got: dict) -> dict:
        """The later verification record, if it is of this very generation."""
        try:
            seen = json.loads(self._read("verified.json") or "{}")
        except ValueError:
            return {}
        return {"verified_ms": seen["verified_ms"]} if seen.get("generation") == got["generation"] else {}

    def commit(self, tables: dict[str, DataFrame], fingerprint: str, root: str, verified_ms: int | None, cancelled: Callable[[], bool] | None = None) -> dict:
        """Write a generation and move the name to it. Nothing moves if ``cancelled`` says so between the tables.
        Symbols of unknown files are left out. Of the older generations the last stays, for its readers."""
        generation = f"g{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        tables = tables | {"symbols": of_known_files(tables["symbols"], tables["files"])}
        for name, schema in TABLES.items():
            if cancelled and cancelled():
                self._fs.delete(self._path(f"{self.folder}/{generation}"), True)
                raise Cancelled("the refresh was cancelled; the index is as it was")
            tables[name].to(schema).write.parquet(f"{self.folder}/{generation}/{name}")
        record = {"generation": generation, "version": VERSION, "fingerprint": fingerprint, "root": root, "updated_ms": int(time.time() * 1000), "verified_ms": verified_ms}
        self._put("current.json", json.dumps(record))
        old = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)) if s.isDirectory() and s.getPath().getName().startswith("g"))
        for name in [x for x in old if x != generation][:-1]:
            self._fs.delete(self._path(f"{self.folder}/{name}"), True)
        return record

    def verify(self, record: dict, now_ms: int) -> None:
        """A clean refresh writes this alone."""
        self._put("verified.json", json.dumps({"generation": record["generation"], "verified_ms": now_ms}))
