"""Schemas of the corpus index, the usage ledger and the refresh history."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}


def _schema(text: str) -> T.StructType:
    """Without a session, which a DDL parser would need."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in text.split(", "))])


FILES = _schema("path string, mtime_ms double, size long, pending boolean")
SYMBOLS = _schema("name string, file string, line int, kind string, context string, seq int")
EDGES = _schema("from string, specifier string, status string, target string, to string, line int, context string, seq int")
GRAPH = _schema("file string, indegree long, outdegree long, rank double, uncertain boolean, is_orphan boolean")
META = _schema("version int, fingerprint string, root string, verified_ms long, updated_ms long")
LEDGER = _schema("ts long, root string, tool string, args_hash string, chars long, naive_bytes long, saved_tokens long, failed boolean")
HISTORY = _schema("ts long, root string, scanned_bytes long, rescanned long, added long, dropped long, total_files long, symbols long, imports long, failed_files long, scan_errors array<string>")
