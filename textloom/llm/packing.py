"""Best-fit packing of documents into token sequences by hierarchical residual packing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.llm.common import materialise, prepare, trimmed
from textloom.llm.encoding import encoder, vocabulary

CAPACITY = 2048
#: Bins with no more free tokens than this are done.
NEARLY_FULL = 32
#: Pieces that are packed at once in a partition; so a task's memory is bounded.
LOCAL = 200_000
#: Pieces that a partition packs, about. They are dealt out in turn, so that each partition has short and long ones,
#: however the table is laid out.
DEALT = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: ``sequence_id`` and ``offset`` of the pieces in nearly full bins; of the others the partition and the place among
#: its open pieces of that length.
LOCALLY = f"{PIECES}, sequence_id long, offset long, part int, place long"
PLACED = f"{PIECES}, sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, but for the first, which takes what is over."""
    over = n % capacity
    starts = [*([0] if over else []), *range(over, n, capacity)]
    return [(s, over if over and s == 0 else capacity) for s in starts]


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode_batch, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            ids, counts = encode(batch.column(1))
            raw, at = ids.astype("<u4").tobytes(), 0
            for doc, count in zip(batch.column(0).to_pylist(), counts.tolist()):
                own = memoryview(raw[4 * at : 4 * (at + count)] + end)
                rows += [(doc, k, s, n, zlib.crc32(own[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(count + 1, capacity))]
                at += count
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(make), PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and the fill of each bin: items by falling length, each into the fullest bin that has
    room. Bins stand in stacks by free room; a bit mask of the stacks in use finds the least sufficient one."""
    at, fills = np.empty(len(lengths), np.int64), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fit = used >> n
        if fit:
            room = ((fit & -fit).bit_length() - 1) + n
            b = stacks[room].pop()
            if not stacks[room]:
                used ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        at[i] = b
        fills[b] += n
        room -= n
        if room:
            if not stacks[room]:
                used |= 1 << room
            stacks[room].append(b)
    return at, np.array(fills, np.int64)


def fit_counts(counts: np.ndarray, capacity: int) -> np.ndarray:
    """``best_fit`` of ``counts[n]`` items of each length n, told in runs: rows of (length, first item, first bin,
    items a bin, offset), by length and first item. Bins of one history stand together, so a length parts two groups
    at most, and memory depends on ``capacity`` alone."""
    runs, bins = [], 0
    stacks: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    used = 0

    def put(room: int, first: int, n: int) -> None:
        nonlocal used
        if n and room:
            used |= 1 << room
            stacks[room].append((first, n))

    for length in np.flatnonzero(counts)[::-1].tolist():
        at, left = 0, int(counts[length])
        while left:
            fit = used >> length
            if fit:
                room = ((fit & -fit).bit_length() - 1) + length
                first, n = stacks[room].pop()
                if not stacks[room]:
                    used ^= 1 << room
                each = room // length
            else:
                room, each, first = capacity, capacity // length, bins
                n = -(-left // each)
                bins += n
            runs.append((length, at, first, each, capacity - room))
            whole, over = divmod(min(left, n * each), each)
            put(room, first + whole + bool(over), n - whole - bool(over))
            put(room - over * length, first + whole, int(over > 0))
            put(room - each * length, first, whole)
            taken = whole * each + over
            at, left = at + taken, left - taken
    out = np.array(runs, np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def _local(capacity: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        base, made, held, size, open_pieces = (part + 1) << 36, 0, [], 0, np.zeros(capacity, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, held, size, open_pieces
            rows = pa.Table.from_batches(held)
            held, size = [], 0
            length = rows["length"].to_numpy()
            at, fills = best_fit(length, capacity)
            final = (fills >= capacity - NEARLY_FULL)[at]
            by_bin = np.argsort(at, kind="stable")
            before = np.cumsum(length[by_bin]) - length[by_bin]
            offset = np.empty(len(at), np.int64)
            offset[by_bin] = before - (np.cumsum(fills) - fills)[at[by_bin]]
            by_length = np.argsort(length + final * capacity, kind="stable")[: int((~final).sum())]
            n = np.bincount(length[by_length], minlength=capacity)
            place = np.zeros(len(at), np.int64)
            place[by_length] = np.arange(len(by_length)) - (np.cumsum(n) - n - open_pieces)[length[by_length]]
            open_pieces += n
            columns = {"sequence_id": pa.array(base + made + at, mask=~final), "offset": pa.array(offset, mask=~final), "part": pa.array(np.full(len(at), part, np.int32)), "place": pa.array(place, mask=final)}
            for name, column in columns.items():
                rows = rows.append_column(name, column)
            made += len(fills)
            yield from rows.to_batches()

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= LOCAL:
                yield from flush()
        if size:
            yield from flush()

    return pack


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (the columns of ``PIECES``) with sequence_id and offset.

    Pieces are dealt out to partitions; each packs its own by best fit and emits the nearly full bins. All other bins are taken apart and
    their pieces packed once more, by best fit over all partitions: the pieces of each length are counted, the
    counts are packed, and each piece goes where its place among those of its length is. Only counts are gathered,
    ``capacity`` at most.
    """
    full = rows.where(F.col("length") >= capacity)
    short = rows.where(F.col("length") < capacity)
    dealt = short.repartition(max(1, -(-short.count() // DEALT)))
    packed = materialise(dealt.mapInArrow(_local(capacity), LOCALLY), "packed")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    done = packed.where("place is null").select(*columns, "sequence_id", "offset")
    rest = packed.where("place is not null").select(*columns, "part", "place")
    parts = materialise(rest.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "parts")
    counts = np.zeros(capacity, np.int64)
    for length, n in parts.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    runs = rows.sparkSession.sparkContext.broadcast(fit_counts(counts, capacity))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, bins, each, offsets = runs.value.T
        keys = lengths << 48 | firsts
        for batch in batches:
            length, place = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = np.searchsorted(keys, length << 48 | place, "right") - 1
            beyond, inside = np.divmod(place - firsts[run], each[run])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins[run] + beyond), pa.array(offsets[run] + inside * length)], [*columns, "sequence_id", "offset"])

    # One row a partition in each window; a partition's open pieces of one length are the most that share a key.
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = parts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = rest.join(bases, ["part", "length"]).select(*columns, (F.col("base") + F.col("place")).alias("place")).mapInArrow(settle, PLACED)
    whole = full.select("*", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return done.unionByName(placed).unionByName(whole)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. A document longer than ``capacity`` is cut into full pieces, the
    first of which takes what is over. Repeated rows are packed as documents of their own; null ids stay null;
    an empty table gives no rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    # Thin rows are written once: texts are encoded once, and packing tasks that run again see the same splits.
    return pack_pieces(materialise(pieces(docs, path or vocabulary(), end_id, capacity, id_col, text_col), "pieces"), capacity)
