"""Token ids written as Re-Pair grammars and read back.

File format: a folder of Parquet files whose rows are segments (shard, segment, n_ids, doc_ids, payload). Shards
are ranges of doc_id, segments follow each other within a shard. ``payload`` is little-endian: magic, the counts
(terminals, rules, rounds, symbols, documents) as u32, the first rule of each round, both sides of each rule, the
expansion length of each rule and the ids of each document as u32 arrays, then the symbols, three bytes each.
Symbols under ``terminals`` are ids; symbol ``terminals + k`` stands for rule k.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.common import prepare, shared_dir, trimmed
from textloom.llm.encoding import encoder, vocabulary

MAGIC = b"RPG1"
#: Ids of a segment, about: what a task holds at once. A longer document is a segment of its own.
SEGMENT = 1_000_000
#: Times that a pair must be seen to become a rule, which takes some three symbols.
LEAST = 8
TABLE_BITS = 18
FILES = "shard int, segment int, n_ids long, doc_ids array<long>, payload binary"
DOCS = "shard int, segment int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def _counted(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pairs, count of each, number of each place's pair), exactly: most by a table with a pair a slot, in
    which the last writer stands; what other pairs have taken the slots of is sorted."""
    slot = ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)
    holder = np.full(1 << TABLE_BITS, -1, np.int64)
    holder[slot] = pairs
    own = holder[slot] == pairs
    count = np.bincount(slot[own], minlength=1 << TABLE_BITS)
    used = np.flatnonzero(count)
    number = np.empty(1 << TABLE_BITS, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    which = number[slot]
    rest = np.flatnonzero(~own)
    distinct, other, more = np.unique(pairs[rest], return_inverse=True, return_counts=True)
    which[rest] = len(used) + other
    return np.concatenate([holder[used], distinct]), np.concatenate([count[used], more]), which


def repair(ids: np.ndarray, least: int = LEAST) -> tuple[int, list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds, until no pair is seen ``least`` times: all pairs seen so often become nonterminals at once;
    where chosen pairs overlap, every other one of the run is replaced. Returns terminals, the first rule of each
    round, left, right, symbols.

    A pair that is seen less often stays so until one of its sides is replaced, so each round counts only the places
    that the one before it changed or chose.
    """
    terminals = int(ids.max()) + 1 if len(ids) else 1
    symbols, firsts, left, right, made = ids.astype(np.int64), [], [], [], 0
    active = np.arange(max(0, len(symbols) - 1))
    while len(active):
        pairs, count, which = _counted(symbols[active] << 24 | symbols[active + 1])
        chosen = np.flatnonzero(count >= least)
        chosen = chosen[: (1 << 24) - terminals - made]
        if not len(chosen):
            break
        rule = np.full(len(pairs), -1, np.int64)
        rule[chosen] = np.arange(made, made + len(chosen))
        hit = rule[which] >= 0
        at, rules = active[hit], rule[which[hit]]
        # Runs of neighbouring hits, of which the first, third, fifth ... are replaced.
        place = np.arange(len(at))
        begins = np.diff(at, prepend=-2) != 1
        odd = (place - np.maximum.accumulate(np.where(begins, place, 0))) & 1
        take, over = at[odd == 0], at[odd == 1]
        firsts.append(made)
        left.append(pairs[chosen] >> 24)
        right.append(pairs[chosen] & 0xFFFFFF)
        made += len(chosen)
        symbols[take] = terminals + rules[odd == 0]
        keep = np.ones(len(symbols), bool)
        keep[take + 1] = False
        # What may now be seen often: pairs beside a new symbol, and chosen ones that are still there.
        changed = np.zeros(len(symbols), bool)
        changed[take] = True
        changed[over[keep[over] & keep[np.minimum(over + 1, len(symbols) - 1)]]] = True
        new = np.zeros(len(symbols), bool)
        new[take] = True
        symbols, changed, new = symbols[keep], changed[keep], new[keep]
        changed[:-1] |= new[1:]
        active = np.flatnonzero(changed[:-1])
    none = np.zeros(0, np.int64)
    return terminals, firsts, np.concatenate(left) if left else none, np.concatenate(right) if right else none, symbols


def expansion_lengths(terminals: int, firsts: list[int], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    length = np.ones(len(left), np.int64)
    for a, b in zip(firsts, [*firsts[1:], len(left)]):
        for side in (left, right):
            deep = side[a:b] >= terminals
            length[a:b] += np.where(deep, length[np.where(deep, side[a:b] - terminals, 0)], 1)
        length[a:b] -= 1
    return length


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ranges ``start``, ``length`` of ``pool``, one after the other."""
    return pool[gather_places(start, length)]


def gather_places(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of the ranges ``start``, ``length``, one after the other."""
    return np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)


def write_segment(ids: np.ndarray, doc_lengths: list[int]) -> bytes:
    terminals, firsts, left, right, symbols = repair(ids)
    length = expansion_lengths(terminals, firsts, left, right)
    head = np.array([terminals, len(left), len(firsts), len(symbols), len(doc_lengths)], "<u4")
    arrays = [head, firsts, left, right, length, doc_lengths]
    return MAGIC + b"".join(np.asarray(a).astype("<u4").tobytes() for a in arrays) + symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


class Segment:
    """A payload, of which any range of ids can be decoded without expanding the rest."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a segment of this format")
        self.terminals, rules, rounds, n, docs = (int(x) for x in np.frombuffer(payload, "<u4", 5, 4))
        at, parts = 24, []
        for k in (rounds, rules, rules, rules, docs):
            parts.append(np.frombuffer(payload, "<u4", k, at).astype(np.int64))
            at += 4 * k
        self.firsts, self.left, self.right, self.length, self.doc_lengths = parts
        wide = np.zeros((n, 4), np.uint8)
        wide[:, :3] = np.frombuffer(payload, np.uint8, 3 * n, at).reshape(n, 3)
        self.symbols = wide.view("<u4").ravel()
        self._pool = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rules' expansions, where each begins), made once, a round after the other."""
        if self._pool is None:
            start = np.cumsum(self.length) - self.length
            pool = np.empty(int(self.length.sum()), np.uint32)
            for a, b in zip(self.firsts.tolist(), [*self.firsts[1:].tolist(), len(self.left)]):
                at = start[a:b].copy()
                for side in (self.left[a:b], self.right[a:b]):
                    deep = side >= self.terminals
                    pool[at[~deep]] = side[~deep]
                    own = side[deep] - self.terminals
                    n = self.length[own]
                    pool[gather_places(at[deep], n)] = gather(pool, start[own], n)
                    at += np.where(deep, self.length[np.where(deep, side - self.terminals, 0)], 1)
            self._pool = pool, start
        return self._pool

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        deep = symbols >= self.terminals
        if not deep.any():
            return symbols.astype(np.uint32)
        pool, start = self._expansions()
        rule = np.where(deep, symbols - self.terminals, 0)
        n = np.where(deep, self.length[rule], 1)
        first = np.where(deep, start[rule], len(pool) + np.arange(len(symbols)))
        return gather(np.concatenate([pool, symbols.astype(np.uint32)]), first, n)

    def ids(self) -> np.ndarray:
        return self.expand(self.symbols)

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the segment, through the expansion lengths."""
        symbols = self.symbols.astype(np.int64)
        deep = symbols >= self.terminals
        ends = np.cumsum(np.where(deep, self.length[np.where(deep, symbols - self.terminals, 0)] if len(self.length) else 1, 1))
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.expand(self.symbols[a:b])[start - skipped : stop - skipped]


def write_tokens(docs: DataFrame, out: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Write every row's ids and ``end_id`` to the folder ``out``, in ascending order of id (nulls first).

    A null or empty text is the end id alone; repeated rows are written each; an empty table makes an empty
    folder; other columns are not read.
    """
    prepare(docs.sparkSession)
    path = path or vocabulary()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, shard = encoder(path).encode_batch, np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        segment, doc_ids, held, size = 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, doc_ids, held, size
            payload = write_segment(np.frombuffer(b"".join(held), "<u4"), [len(x) // 4 for x in held])
            row = [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([size], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([payload], pa.binary())]
            segment, doc_ids, held, size = segment + 1, [], [], 0
            return pa.RecordBatch.from_arrays(row, ["shard", "segment", "n_ids", "doc_ids", "payload"])

        for batch in batches:
            whole, counts = encode(batch.column(1))
            raw, at = whole.astype("<u4").tobytes(), 0
            for doc, count in zip(batch.column(0).to_pylist(), counts.tolist()):
                if size and size + count + 1 > SEGMENT:
                    yield flush()
                doc_ids.append(doc)
                held.append(raw[4 * at : 4 * (at + count)] + end)
                size += count + 1
                at += count
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    by_id = rows.repartitionByRange(shards, "doc_id") if shards else rows.repartitionByRange("doc_id")
    by_id.sortWithinPartitions("doc_id").mapInArrow(trimmed(make), FILES).write.option("compression", "zstd").parquet(out)


def read_tokens(spark, out: str) -> DataFrame:
    """From the files of ``out``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    prepare(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, doc_ids, payload in zip(*(batch.column(i) for i in range(4))):
                segment = Segment(payload.as_py())
                raw, n = memoryview(segment.ids().astype("<u4").tobytes()), segment.doc_lengths
                starts = np.cumsum(n) - n
                crc = [zlib.crc32(raw[4 * s : 4 * (s + k)]) for s, k in zip(starts.tolist(), n.tolist())]
                fixed = [pa.array([x.as_py()] * len(n), pa.int32()) for x in (shard, number)]
                columns = [*fixed, pa.array(doc_ids.as_py(), pa.int64()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "segment", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    files = spark.read.schema(FILES).parquet(out)
    sizes = files.select("shard", "segment", "n_ids")
    shard_base = sizes.groupBy("shard").agg(F.sum("n_ids").alias("m"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row per shard
    inside = W.partitionBy("shard").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    shard_base = shard_base.select("shard", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    bases = sizes.select("shard", "segment", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("within")).join(shard_base, "shard")
    bases = bases.select("shard", "segment", (F.col("base") + F.col("within")).alias("before"))
    rows = files.select("shard", "segment", "doc_ids", "payload").mapInArrow(trimmed(decode), DOCS)
    return rows.join(bases, ["shard", "segment"]).select("doc_id", (F.col("before") + F.col("local_start")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = 2, **columns: str) -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and return what the files say of each document."""
    spark = docs.sparkSession
    out = shared_dir(spark, "tokens")
    write_tokens(docs, out, path, end_id, **columns)
    return read_tokens(spark, out)
