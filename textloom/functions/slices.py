"""Exact UTF-8 byte windows of texts and bounded searches in them."""

from __future__ import annotations

import time
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.session import prepare

# The limits of a read.
MOST_WINDOW, MOST_SEARCH, LONGEST_LITERAL, LONGEST_REGEX = 16 << 20, 64 << 20, 65536, 256
WINDOW, CONTEXT, REGEX_SCAN, BUDGET_MS, MOST_BUDGET_MS = 4096, 256, 16 << 20, 1000, 10000
# End of the fixed values.


def window_columns(data: Column, start: Column, length: Column, tail: bool = False) -> Column:
    """struct(byte_offset, length_bytes, total_bytes, snippet, next_offset, may_truncate, range_adjusted) of a
    binary column: both ends move forward to the next character, so that following windows join up. For whole
    columns; it stays inside generated code."""
    total = F.octet_length(data).cast("long")
    asked = F.greatest(F.lit(0), total - length) if tail else F.least(start, total)

    def forward(at: Column) -> Column:
        """The first of the four bytes from ``at`` that continues no character."""
        inside = lambda k: F.hex(F.substring(data, (at + 1 + k).cast("int"), F.lit(1))).between("80", "BF")
        return F.least(total, at + F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3))

    begin = forward(asked)
    end = forward(F.least(total, begin + length))
    size = end - begin
    text = F.try_validate_utf8(F.substring(data, (begin + 1).cast("int"), size.cast("int")).cast("string"))
    return F.struct(begin.alias("byte_offset"), size.alias("length_bytes"), total.alias("total_bytes"), text.alias("snippet"), end.alias("next_offset"), (end < total).alias("may_truncate"), ((begin != asked) | (size > length)).alias("range_adjusted"))


class FileBytes:
    """A file as a sequence of bytes, of which only what is asked for is read, a page at a time for single bytes."""

    PAGE = 1 << 16

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size, self.page, self.held = read, size, -1, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        if isinstance(at, slice):
            start, stop, _ = at.indices(self.size)
            return self.read(start, stop) if stop > start else b""
        page = at // self.PAGE
        if page != self.page:
            self.page, self.held = page, self.read(page * self.PAGE, min(self.size, (page + 1) * self.PAGE))
        return self.held[at - page * self.PAGE]


@dataclass
class Found:
    """hit: byte offset; status: matched, not_found, byte_budget, time_budget, cancelled or not_requested."""

    hit: int | None = None
    status: str = "not_requested"
    complete: bool = False
    scanned: int = 0
    begin: int | None = None
    end: int | None = None
    next_from: int | None = None


def forward(data: bytes, at: int) -> int:
    """The next place at or after ``at`` where a character begins, four bytes on at most."""
    at = min(at, len(data))
    stop = min(len(data), at + 4)
    while at < stop and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def backward(data: bytes, begin: int, end: int) -> int:
    """``end`` without a character that it would cut."""
    lead = end
    while lead > begin and lead > end - 4 and (lead == len(data) or data[lead] & 0xC0 == 0x80):
        lead -= 1
        if data[lead] & 0xC0 != 0x80:
            width = 1 if data[lead] < 0x80 else 2 if data[lead] < 0xE0 else 3 if data[lead] < 0xF0 else 4
            return end if lead + width <= end else lead
    return lead if lead < len(data) and data[lead] & 0xC0 != 0x80 else end


def folded(text: str) -> tuple[str, Sequence[int]]:
    """The text with each character lower-cased by itself, and where each of its characters begins in the result."""
    low = text.lower()
    if text.isascii():
        return low, range(len(text))
    parts = [c.lower() for c in text]
    starts, at = [], 0
    for p in parts:
        starts.append(at)
        at += len(p)
    return "".join(parts), starts


def find_literal(data: bytes | FileBytes, needle: str, begin: int = 0, most: int = MOST_SEARCH, budget_ms: int = BUDGET_MS, chunk: int = 65536, cancelled: Callable[[], bool] | None = None) -> Found:
    """The first place, as a byte offset, where ``needle`` occurs without regard to case. Chunks overlap by what
    may still begin a match; a search that its bytes end says where to go on."""
    if len(needle) > LONGEST_LITERAL:
        raise ValueError("slice_find_literal_too_long")
    until = time.monotonic() + budget_ms / 1000
    begin = forward(data, begin)
    limit = min(len(data), begin + most)
    want = folded(needle)[0]
    at, held, base = begin, "", begin
    out = Found(begin=begin, end=begin, status="not_found")
    while at < limit:
        if cancelled and cancelled():
            out.status = "cancelled"
            return out
        stop = min(limit, at + chunk)
        safe = backward(data, at, stop) if stop < len(data) else stop
        held += data[at:safe].decode("utf-8")
        text, starts = folded(held)
        k = text.find(want)
        out.scanned, out.end = stop - begin, safe
        if k >= 0:
            out.hit = base + len(held[: bisect_right(starts, k) - 1].encode())
            out.status = "matched"
            return out
        keep = next((n for n in range(min(len(want) - 1, len(text)), 0, -1) if text.endswith(want[:n])), 0)
        cut = bisect_right(starts, len(text) - keep) - 1 if keep else len(held)
        base += len(held[:cut].encode())
        held = held[cut:]
        if safe == at or stop == limit:
            break
        at = safe
        if time.monotonic() > until:
            out.status, out.next_from = "time_budget", base if base > begin else None
            return out
    if limit < len(data):
        out.status, out.next_from = "byte_budget", base if base > begin else None
    out.complete = out.status == "not_found"
    return out


def find_regex(data: bytes | FileBytes, pattern: str, begin: int = 0, most: int = REGEX_SCAN, budget_ms: int = BUDGET_MS, cancelled: Callable[[], bool] | None = None) -> Found:
    """The first match in one continuous window, whose edges anchors see; a runaway match ends with its budget."""
    import regex

    if len(pattern) > LONGEST_REGEX:
        raise ValueError("slice_find_regex_too_long")
    compiled = regex.compile(pattern, regex.IGNORECASE)
    begin = forward(data, begin)
    stop = min(len(data), begin + most)
    end = backward(data, begin, stop) if stop < len(data) else stop
    text = data[begin:end].decode("utf-8")
    out = Found(begin=begin, end=end, scanned=stop - begin)
    if cancelled and cancelled():
        out.status = "cancelled"
        return out
    try:
        m = compiled.search(text, timeout=budget_ms / 1000)
    except TimeoutError:
        out.status = "time_budget"
        return out
    if m:
        out.hit, out.status = begin + len(text[: m.start()].encode()), "matched"
    else:
        out.status = "not_found" if stop >= len(data) else "byte_budget"
        out.complete = out.status == "not_found"
    return out


def first_match(text: str, pattern: str, budget_ms: int = 250) -> int | None:
    """The character offset of the first match; raises ``slice_find_regex_timeout`` when time runs out."""
    import regex

    try:
        m = regex.compile(pattern).search(text, timeout=budget_ms / 1000)
    except TimeoutError as e:
        raise ValueError("slice_find_regex_timeout") from e
    return m.start() if m else None


def _whole(value: int | None, default: int, name: str, least: int, most: int) -> int:
    out = default if value is None else value
    if isinstance(out, bool) or not isinstance(out, int) or not least <= out <= most:
        raise ValueError(f"slice_invalid_{name}")
    return out


def read_slice(data: bytes | FileBytes, start: int | None = None, length: int | None = None, find: str | None = None, find_from: int | None = None, context_before: int | None = None, mode: str = "window", regex: bool = False, search_bytes: int | None = None, budget_ms: int | None = None, cancelled: Callable[[], bool] | None = None) -> dict:
    """A window of ``data``, placed by ``start``, at its tail, or around what ``find`` finds."""
    length = _whole(length, WINDOW, "length", 1, MOST_WINDOW)
    start = _whole(start, 0, "start", 0, 1 << 53)
    before = _whole(context_before, CONTEXT, "context", 0, MOST_WINDOW)
    find_from = _whole(find_from, 0, "find_from", 0, 1 << 53)
    if mode not in ("window", "tail"):
        raise ValueError("slice_invalid_mode")
    found = Found()
    asked = min(start, len(data))
    if mode == "tail":
        asked = max(0, len(data) - length)
    elif find:
        most = _whole(search_bytes, REGEX_SCAN if regex else MOST_SEARCH, "search_bytes", 1, MOST_SEARCH)
        ms = _whole(budget_ms, BUDGET_MS, "budget", 1, MOST_BUDGET_MS)
        found = (find_regex if regex else find_literal)(data, find, find_from, most, ms, cancelled=cancelled)
        asked = min(find_from, len(data)) if found.hit is None else max(0, found.hit - before)
    begin = forward(data, asked)
    end = forward(data, min(len(data), begin + length))
    try:
        snippet = data[begin:end].decode("utf-8")
    except UnicodeDecodeError as e:
        raise ValueError("slice_invalid_utf8") from e
    scope = "none" if found.status == "not_requested" else "bounded_regex_window" if regex else "remaining_file"
    return {"byte_offset": begin, "length_bytes": end - begin, "total_bytes": len(data), "snippet": snippet, "next_offset": end, "may_truncate": end < len(data), "range_adjusted": begin != asked or end - begin > length, "scope": scope, **{f"search_{k}": v for k, v in asdict(found).items()}}


AROUND = "id long, byte_offset long, length_bytes long, snippet string, status string"


def slices_around(rows: DataFrame, find: str, before: int, length: int, id_col: str = "doc_id", text_col: str = "text", **request) -> DataFrame:
    """(id, byte_offset, length_bytes, snippet, status): of each row's text the window around what is found in it."""
    prepare(rows.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [read_slice(x.encode() if x else b"", length=length, find=find, context_before=before, **request) for x in batch.column(1).to_pylist()]
            columns = [pa.array([g[k] for g in got], kind) for k, kind in (("byte_offset", pa.int64()), ("length_bytes", pa.int64()), ("snippet", pa.string()), ("search_status", pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "byte_offset", "length_bytes", "snippet", "status"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, AROUND)


def paged(texts: DataFrame, length: int, id_col: str = "doc_id", data_col: str = "data") -> DataFrame:
    """(id, page, byte_offset, piece): each binary text in windows that begin at every ``length``-th byte, moved
    forward to a character, in one pass over it."""
    prepare(texts.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = data or b""
                starts = [forward(data, at) for at in range(0, len(data) + 1, length)]
                out += [(row, k, a, data[a:b].decode("utf-8")) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(data)]))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 4, kinds)], ["id", "page", "byte_offset", "piece"])

    return texts.select(F.col(id_col).cast("long").alias("id"), data_col).mapInArrow(cut, "id long, page int, byte_offset long, piece string")


FOUND = "hit_byte long, status string, complete boolean, scanned long, next_from long"


def search_texts(rows: DataFrame, find: str, regex: bool = False, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """(id, hit_byte, status, complete, scanned, next_from) of each row's text; a null text is an empty one."""
    prepare(rows.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = find_regex if regex else find_literal
        for batch in batches:
            found = [look(x.encode() if x else b"", find, **limits) for x in batch.column(1).to_pylist()]
            kinds = [pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
            columns = [[f.hit for f in found], [f.status for f in found], [f.complete for f in found], [f.scanned for f in found], [f.next_from for f in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", "hit_byte", "status", "complete", "scanned", "next_from"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(search, f"id long, {FOUND}")
