"""The query surface over one root: refresh, status, symbols, edges, files, slices, JSON keys, cost, usage."""

from __future__ import annotations

import contextlib
import functools
import json
import os
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import schemas
from textloom.functions import extract, json_keys, scalar, slices
from textloom.operators import graph as graphs
from textloom.operators import ledger as ledgers
from textloom.operators import snapshot
from textloom.operators import symbols as finding
from textloom.sources import jsonl, listing
from textloom.sources.index_store import Cancelled, IndexStore

PARSER = "patterns-1"
# The defaults of a corpus.
EXTS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".py", ".go", ".rs", ".md", ".json", ".yaml", ".yml"]
SKIP = ["node_modules", ".git", "dist", "build", "__pycache__"]
MOST_HITS, MOST_SCAN, MOST_CONTEXT, HISTORY_ROWS, HISTORY_BYTES, LEDGER_ROWS, LOG_BYTES = 120, 512 << 10, 240, 200, 1 << 20, 500, 1 << 20
# End of the fixed values.
#: Failures that a report names; it counts all.
MOST_ERRORS = 100
COUNTERS = ["scanned_bytes", "rescanned", "symbols", "imports"]


class RefreshFailed(RuntimeError):
    pass


class Corpus:
    """One root's index. ``refresh`` reconciles it with the tree; queries refresh first and fail where a file did."""

    def __init__(self, spark: SparkSession, root: str, cache: str, exts: list[str] | None = None, skip: list[str] | None = None, max_scan: int = MOST_SCAN, max_context: int = MOST_CONTEXT, max_hits: int = MOST_HITS, measured: bool = True, read: Callable[[str, int, int], bytes] | None = None):
        """``read(path, start, stop)`` gives bytes of a file for slices and JSON pages, if not the local file system."""
        self.spark, self.root, self.cache = spark, os.path.abspath(root), cache.rstrip("/")
        self.exts, self.skip = scalar.normal_options(exts or EXTS, skip or SKIP)
        self.max_scan, self.max_context, self.max_hits, self.measured = max_scan, max_context, max_hits, measured
        self.fingerprint = scalar.fingerprint(PARSER, self.exts, self.skip, max_scan, max_context)
        self.store = IndexStore(spark, f"{self.cache}/index-{scalar.root_hash(root)}")
        self._lock = threading.Lock()
        self._read = read or _read_range
        self.last_report: dict | None = None
        listing.register(spark)

    # Refresh

    def _listing(self, texts: bool) -> DataFrame:
        return self.spark.read.format("textloom_tree").options(path=self.root, exts=",".join(self.exts), skip=",".join(self.skip), maxbytes=str(self.max_scan), texts=str(texts).lower()).load()

    @staticmethod
    def _told(failed: DataFrame) -> list[str]:
        """The first failures by path, as messages."""
        return [f"{r['path']}: {r['error']}" for r in failed.orderBy("path").limit(MOST_ERRORS).collect()]

    def refresh(self, cancelled: Callable[[], bool] | None = None) -> dict:
        """Reconcile with the tree; one refresh of a root runs at a time. The new generation shows only when it is
        whole; a clean one writes its verification alone. One that ``cancelled`` stops, while it waits for another or
        before its generation shows, leaves the index as it was."""
        while not self._lock.acquire(timeout=0.2):
            if cancelled and cancelled():
                raise Cancelled("the refresh was cancelled while it waited")
        try:
            if cancelled and cancelled():
                raise Cancelled("the refresh was cancelled")
            report = self._reconcile(cancelled)
        except Exception as e:
            self.log(f"refresh failed: {e}")
            raise
        finally:
            self._lock.release()
        return report

    def _reconcile(self, cancelled: Callable[[], bool] | None) -> dict:
        tables, record, _ = self.store.load(self.fingerprint)
        seen = self._listing(False)
        failed = graphs.checkpointed(seen.where("error is not null").select("path", "error"))
        unseen = failed.count()
        previous = tables["files"]
        current = seen.where("error is null").select("path", "mtime_ms", "size")
        if unseen:  # what can't be looked at stays as it was, to be tried again
            current = current.unionByName(previous.join(failed, "path", "left_semi").select("path", "mtime_ms", "size"))
        states = graphs.checkpointed(snapshot.diff(previous, current))
        counts = snapshot.report(states).first().asDict()
        now = int(time.time() * 1000)
        report = counts | {"failed_files": unseen, "scan_errors": self._told(failed)}
        if record and not counts["rescanned"] and not counts["dropped"] and not unseen:
            self.store.verify(record, now)
            self.last_report = report
            return report
        changed = states.where("state in ('added', 'changed')").select("path")
        read = graphs.checkpointed(self._listing(True).join(changed, "path", "left_semi"))
        failed = graphs.checkpointed(failed.unionByName(read.where("error is not null").select("path", "error")))
        good = read.where("error is null").select("path", "text")
        fresh_symbols = extract.symbols_of(good, self.max_context, self.max_scan)
        fresh_imports = extract.imports_of(good, self.max_context, self.max_scan)
        symbols = graphs.checkpointed(snapshot.merged(tables["symbols"], fresh_symbols, states, "file"))
        old = tables["edges"].join(states.where("state = 'unchanged'").select(F.col("path").alias("from")), "from", "left_semi")
        again = extract.with_candidates(old)
        files = states.where("state <> 'dropped'").join(failed.select("path", F.lit(True).alias("pending")).distinct(), "path", "left")
        files = graphs.checkpointed(files.select("path", "mtime_ms", "size", F.coalesce("pending", F.lit(False)).alias("pending")))
        edges = graphs.checkpointed(extract.resolve(again.unionByName(fresh_imports), files))
        graph, _, _ = graphs.build_graph(files, edges)
        report["failed_files"] = failed.count()
        report["scan_errors"] = self._told(failed)
        if report["failed_files"] > unseen:
            lost = files.join(read.where("error is not null").select("path"), "path", "left_semi").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
            report["scanned_bytes"] -= lost
        clean = not report["failed_files"]
        self.store.commit({"files": files, "symbols": symbols, "edges": edges, "graph": graph}, self.fingerprint, self.root, now if clean else record.get("verified_ms"), cancelled)
        report |= {"symbols": symbols.count(), "imports": edges.count()}
        self._append_history(report, now)
        self.last_report = report
        return report

    def _append_history(self, report: dict, now: int) -> None:
        row = {"ts": now, "root": self.root, **report}
        jsonl.append(self.spark.createDataFrame([tuple(row.get(n) for n in schemas.HISTORY.names)], schemas.HISTORY), f"{self.cache}/history")

    def compact(self) -> dict[str, int]:
        """Retention: the newest history rows within rows and bytes, and the ledger once it has twice its rows.
        What is kept is written beside the files before these are replaced."""
        gone = {}
        for name, (rows, _), keep in (("history", self.history(every_root=True), self._kept_history), ("ledger", self.ledger(), lambda r: ledgers.retained(r, LEDGER_ROWS, "ts"))):
            kept = graphs.checkpointed(keep(rows))
            gone[name] = rows.count() - kept.count()
            if gone[name]:
                kept.coalesce(1).write.mode("overwrite").json(f"{self.cache}/{name}")  # bounded by the retention
        return gone

    @staticmethod
    def _kept_history(rows: DataFrame) -> DataFrame:
        sized = rows.withColumn("__bytes", F.octet_length(F.to_json(F.struct(*rows.columns))) + 1)
        return ledgers.retained_bytes(sized, HISTORY_ROWS, HISTORY_BYTES, "__bytes", "ts").drop("__bytes")

    def tables(self, refresh: bool = True) -> dict[str, DataFrame]:
        if refresh and self.refresh()["failed_files"]:
            raise RefreshFailed("; ".join(self.last_report["scan_errors"][:5]))
        return self.store.load(self.fingerprint)[0]

    # Queries

    def status(self, refresh: bool = False, history: int = 10) -> dict:
        _, record, state = self.store.load(self.fingerprint)
        if refresh or state != "ok":
            self.refresh()
        tables, record, state = self.store.load(self.fingerprint)
        counts = snapshot.status(tables["files"], tables["symbols"], tables["edges"]).first()
        rows, corrupt = self.history()
        last = ledgers.newest(rows, history, "ts")
        return {
            "state": state, **counts.asDict(), "pending": [r["path"] for r in snapshot.pending(tables["files"]).orderBy("path").limit(MOST_ERRORS).collect()],
            "stale_ms": max(0, int(time.time() * 1000) - record["verified_ms"]) if record.get("verified_ms") else 0, "last_report": self.last_report,
            "history": [r.asDict() for r in last.collect()], "corrupt_lines": corrupt.count(), "trend": ledgers.trend(rows, COUNTERS, history, "ts").first().asDict(),
        }

    def history(self, every_root: bool = False) -> tuple[DataFrame, DataFrame]:
        path = f"{self.cache}/history"
        if not os.path.isdir(path) and ":" not in path:
            return self.spark.createDataFrame([], schemas.HISTORY), self.spark.createDataFrame([], "line string")
        rows, corrupt = jsonl.read(self.spark, path, schemas.HISTORY, ["ts", "root", "scanned_bytes", "symbols"])
        return rows if every_root else ledgers.of_root(rows, self.root), corrupt

    def _contexts(self, tables: dict[str, DataFrame]) -> DataFrame:
        named = finding.first_context(tables["symbols"], scalar.symbol_text(F.col("file"), F.col("line"), F.col("kind"), F.col("name"), F.col("context")))
        imported = finding.first_context(tables["edges"].withColumn("file", F.col("from")), scalar.edge_text(F.col("from"), F.col("line"), F.col("to"), F.col("context")))
        both = imported.withColumnRenamed("context", "other").join(named, "file", "full_outer")
        return both.select("file", F.coalesce("context", "other").alias("context"))

    def _limited(self, rows: DataFrame, order: list, limit: int | None, kind: str) -> dict:
        limit = scalar.positive(limit, self.max_hits, "limit")
        rows = graphs.checkpointed(rows)
        total = rows.count()
        first, rest = finding.page(rows, order, limit)
        out = {"total": total, "rows": [r.asDict() for r in first.collect()], "spill_path": None, "spill_count": 0}
        return out | jsonl.spill(rest, f"{self.cache}/spill/{kind}-{time.time_ns()}") if total > limit else out

    def find_symbols(self, name: str, kind: str | None = None, limit: int | None = None, ranking: bool = False, boost: list[str] | None = None) -> dict:
        tables = self.tables()
        hits = finding.matching(tables["symbols"], name, kind)
        ranked, order = finding.with_order(hits, name, tables["graph"] if ranking else None, scalar.boost_paths(self.root, boost) if boost else None)
        return self._limited(ranked, order, limit, "symbols") | {"matched_bytes": finding.matched_bytes(hits, tables["files"]).first()["bytes"]}

    def edges(self, file: str, direction: str = "in", limit: int | None = None) -> dict:
        path = scalar.inside_root(self.root, file)
        rows = graphs.neighbours(self.tables()["edges"], path if path is not None else "\x00", direction)
        return self._limited(rows, [F.col("from"), F.col("line"), F.col("seq")], limit, "edges") | self._naive(rows.select(F.col("from").alias("file")))

    def _naive(self, rows: DataFrame) -> dict:
        """The bytes of the files that an answer speaks of, which a reader without the index would read."""
        return {"naive_bytes": finding.matched_bytes(rows, self.store.load(self.fingerprint)[0]["files"]).first()["bytes"]}

    def hotspots(self, limit: int | None = None) -> dict:
        tables = self.tables()
        rows = graphs.hotspots(tables["graph"], self._contexts(tables))
        return self._limited(rows, [F.desc("indegree"), F.desc("rank"), F.col("file")], limit, "hotspots") | self._naive(rows)

    def orphans(self, limit: int | None = None) -> dict:
        tables = self.tables()
        rows = graphs.orphan_rows(tables["graph"], self._contexts(tables))
        return self._limited(rows, [F.col("file")], limit, "orphans") | self._naive(rows)

    def files(self, pattern: str | None = None, limit: int | None = None) -> dict:
        return self._limited(finding.list_files(self.tables()["files"], pattern), [F.col("path")], limit, "files")

    def _inside(self, path: str) -> str:
        rel = scalar.inside_root(self.root, path)
        if rel is None:
            raise ValueError("path_outside_root")
        return os.path.join(self.root, rel)

    def read_slice(self, path: str, **request) -> dict:
        """A window of a file; only the bytes that it and a search need are read."""
        full = self._inside(path)
        return slices.read_slice(slices.FileBytes(lambda a, b: self._read(full, a, b), os.stat(full).st_size), **request)

    def read_json(self, path: str, **request) -> dict:
        full = self._inside(path)
        stat = os.stat(full)
        mark = f"{stat.st_size}-{stat.st_mtime_ns}-{stat.st_ctime_ns}-{stat.st_ino}-{stat.st_dev}"
        out = json_keys.scan_file(lambda a, b: self._read(full, a, b), stat.st_size, os.path.realpath(full), mark, **request)
        again = os.stat(full)
        if (again.st_size, again.st_mtime_ns) != (stat.st_size, stat.st_mtime_ns):
            out |= {"validation": "invalid", "code": "changed_while_read", "entries": [], "next_cursor": None, "has_more": False}
        return out

    def cost_probe(self, symbol: str) -> dict:
        tables = self.tables()
        hits = finding.matching(tables["symbols"], symbol)
        chars = hits.agg(F.coalesce(F.sum(scalar.utf16_length(F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "context"))), F.lit(0))).first()[0]
        return finding.cost(tables["files"], hits, chars).first().asDict() | {"hits": hits.count()}

    # Usage

    def ledger(self) -> tuple[DataFrame, DataFrame]:
        path = f"{self.cache}/ledger"
        if not os.path.isdir(path) and ":" not in path:
            return self.spark.createDataFrame([], schemas.LEDGER), self.spark.createDataFrame([], "line string")
        return jsonl.read(self.spark, path, schemas.LEDGER, ["ts", "tool", "chars", "naive_bytes", "saved_tokens"])

    def savings(self, root: str | None = None, tool: str | None = None, recent: int = 20) -> dict:
        """Totals, groups and the ``recent`` rows; the older ones are written to a spill."""
        rows, corrupt = self.ledger()
        own = graphs.checkpointed(ledgers.filtered(rows, os.path.abspath(root) if root else None, tool))
        calls = own.count()
        spilled = {"spill_path": None, "spill_count": 0}
        if calls > recent:
            spilled = jsonl.spill(ledgers.older(own, recent, "ts", "tool", "args_hash"), f"{self.cache}/spill/savings-{time.time_ns()}")
        return spilled | {"aggregate": ledgers.totals(own).first().asDict(), "by_tool": [r.asDict() for r in ledgers.grouped(own, "tool").collect()], "by_root": [r.asDict() for r in ledgers.grouped(own, "root").collect()], "recent": [r.asDict() for r in ledgers.newest(own, recent, "ts", "tool", "args_hash").collect()], "corrupt_lines": corrupt.count()}

    def measure(self, tool: str, call: Callable[..., dict], naive_bytes: Callable[[dict], int], defaults: dict | None = None, relevant: set[str] | None = None) -> Callable[..., dict]:
        """``call`` with a ledger row for each run, failed ones too; the same function where measuring is off. Calls
        hash alike if they are equal once ``defaults`` are filled in and arguments that aren't ``relevant`` are gone."""
        if not self.measured:
            return call

        @functools.wraps(call)
        def wrapped(*args, **kwargs):
            hashed = scalar.args_hash(tool, self.root, {"args": list(args), **scalar.effective_args(kwargs, defaults or {}, relevant)})
            try:
                out = call(*args, **kwargs)
            except Exception:
                self._record(tool, hashed, 0, 0, True)
                raise
            text = json.dumps(out, ensure_ascii=False, default=str)
            self._record(tool, hashed, json_keys.utf16(text), naive_bytes(out), False)
            return out

        return wrapped

    def log(self, line: str) -> None:
        """Append a line to the log, which keeps its newer half once it has LOG_BYTES. Logging never fails a call."""
        with contextlib.suppress(OSError):
            os.makedirs(self.cache, exist_ok=True)
            path = f"{self.cache}/textloom.log"
            with open(path, "a", encoding="utf-8") as f:
                f.write(f"{time.strftime('%Y-%m-%dT%H:%M:%S', time.gmtime())}Z {line}\n")
            if os.path.getsize(path) > LOG_BYTES:
                with open(path, "rb") as f:
                    f.seek(-LOG_BYTES // 2, os.SEEK_END)
                    kept = f.read().split(b"\n", 1)[-1]
                with open(f"{path}.new", "wb") as f:
                    f.write(kept)
                os.replace(f"{path}.new", path)

    def _record(self, tool: str, hashed: str, chars: int, naive: int, failed: bool) -> None:
        estimate = lambda n: max(1, -(-max(0, n) // 4))
        row = (int(time.time() * 1000), self.root, tool, hashed, chars, naive, max(0, estimate(naive) - estimate(chars)), failed)
        jsonl.append(self.spark.createDataFrame([row], schemas.LEDGER), f"{self.cache}/ledger")


def _read_range(path: str, start: int, stop: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(start)
        return f.read(stop - start)
