"""The top-level keys of JSON texts, a page at a time, with exact byte ranges and strict validation.

The scanner is a tokeniser over bytes: one pattern per token of the strict grammar. It never builds the values.
"""

from __future__ import annotations

import base64
import hmac
import json
import os
import re
import time
from collections.abc import Callable, Iterator
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.scalar import positive, signature
from textloom.session import dealt, prepare

# The limits of a scan.
LIMITS = {"limit": (40, 1000), "max_preview": (240, 4096), "max_key_bytes": (4096, 65536), "max_depth": (128, 512), "max_scan_bytes": (16 << 20, None), "max_time_ms": (2000, 60000), "max_output_bytes": (65536, 1 << 20)}
RESERVED, VERSION = 8192, 1
# End of the fixed values.

_BLANK = re.compile(rb"[ \t\r\n]*")
_STRING = re.compile(rb'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_NUMBER = re.compile(rb"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![0-9.eE+-])")
_WORD = re.compile(rb"(?:true|false|null)(?![A-Za-z0-9_])")
_secret = os.urandom(32)
#: Containers in one another, and items of each, of an entry that one pattern takes at once.
PLAIN_DEPTH, PLAIN_ITEMS = 3, 64


def _plain_entry() -> re.Pattern[bytes]:
    """A whole entry of the strict grammar, up to the comma or brace behind it; what it does not match goes token by
    token."""
    blank, string = rb"[ \t\r\n]*+", rb'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
    scalar = string + rb"|-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+(?![0-9.eE+-])|" + _WORD.pattern
    value = scalar
    for _ in range(PLAIN_DEPTH):
        item = lambda x, end: rb"(?>(?:" + x + rb")" + blank + rb"(?:," + blank + rb"(?!" + end + rb")|(?=" + end + rb"))){0,%d}+" % PLAIN_ITEMS
        value = scalar + rb"|\[" + blank + item(value, rb"\]") + rb"\]|\{" + blank + item(string + blank + rb":" + blank + rb"(?:" + value + rb")", rb"\}") + rb"\}"
    return re.compile(blank + rb"(" + string + rb")" + blank + rb":" + blank + rb"(" + value + rb")" + blank + rb"([,}])")


_PLAIN = _plain_entry()


class Stop(Exception):
    def __init__(self, code: str, validation: str, at: int):
        super().__init__(f"{code} @byte {at}")
        self.code, self.validation, self.at = code, validation, at


def utf16(text: str) -> int:
    return len(text.encode("utf-16-le", "surrogatepass")) // 2


def shorten(text: str, most: int) -> str:
    return text.encode("utf-16-le", "surrogatepass")[: 2 * most].decode("utf-16-le", "ignore")


def encode_cursor(secret: bytes, path: str, mark: str, offset: int, count: int) -> str:
    body = json.dumps({"v": VERSION, "path": path, "mark": mark, "offset": offset, "count": count}, separators=(",", ":")).encode()
    return b".".join(base64.urlsafe_b64encode(x).rstrip(b"=") for x in (body, signature(secret, body))).decode()


def decode_cursor(secret: bytes, cursor: str, path: str, mark: str) -> tuple[int, int]:
    try:
        body, sign = (base64.urlsafe_b64decode(x + "=" * (-len(x) % 4)) for x in cursor.split("."))
        if not hmac.compare_digest(sign, signature(secret, body)):
            raise ValueError
        got = json.loads(body)
    except ValueError as e:
        raise ValueError("invalid_cursor") from e
    if got["v"] != VERSION or got["path"] != path or got["mark"] != mark:
        raise ValueError("stale_cursor")
    return got["offset"], got["count"]


class _Scan:
    def __init__(self, data: bytes, depth: int, stop: int, until: float, cancelled: Callable[[], bool] | None = None):
        self.data, self.depth, self.stop, self.until, self.at, self.ticks, self.cancelled = data, depth, stop, until, 0, 0, cancelled

    def blank(self) -> None:
        self.at = _BLANK.match(self.data, self.at).end()
        self.ticks += 1
        if self.at > self.stop or (self.at >= self.stop and self.stop < len(self.data)):
            raise Stop("scan_budget_exhausted", "budget_exhausted", min(self.at, self.stop))
        if self.cancelled and self.ticks % 64 == 1 and self.cancelled():
            raise Stop("cancelled", "cancelled", self.at)
        self.clock()

    def clock(self) -> None:
        if self.ticks % 256 == 0 and time.monotonic() > self.until:
            raise Stop("time_budget_exhausted", "budget_exhausted", self.at)

    def tick(self) -> None:
        self.ticks += 1
        self.clock()

    def byte(self) -> int:
        return self.data[self.at] if self.at < len(self.data) else -1

    def string(self, code: str) -> bytes:
        m = _STRING.match(self.data, self.at)
        if not m:
            raise Stop("unexpected_end" if self.byte() < 0 else code, "invalid", self.at)
        try:
            m[0].decode("utf-8")
        except UnicodeDecodeError as e:
            raise Stop("invalid_utf8", "invalid", self.at + e.start) from e
        self.at = m.end()
        return m[0]

    def scalar(self) -> None:
        if self.byte() == 34:
            self.string("invalid_string")
            return
        m = _NUMBER.match(self.data, self.at) or _WORD.match(self.data, self.at)
        if not m:
            raise Stop("unexpected_end" if self.byte() < 0 else "invalid_value", "invalid", self.at)
        self.at = m.end()

    def value(self, level: int) -> None:
        """Step over one value, with a stack of closing bytes in place of recursion."""
        closers: list[int] = []
        while True:
            b = self.byte()
            if b in (123, 91):
                if level + len(closers) >= self.depth:
                    raise Stop("depth_budget_exhausted", "budget_exhausted", self.at)
                closers.append(b + 2)
                self.at += 1
                self.blank()
                if self.byte() != closers[-1]:
                    self.member(closers)
                    continue
            else:
                self.scalar()
            # A value has ended, or an empty container stands at its closing byte.
            while closers:
                self.blank()
                b = self.byte()
                if b == closers[-1]:
                    closers.pop()
                    self.at += 1
                    continue
                if b != 44:
                    raise Stop("unexpected_end" if b < 0 else "missing_separator", "invalid", self.at)
                self.at += 1
                self.blank()
                self.member(closers)
                break
            else:
                return

    def member(self, closers: list[int]) -> None:
        """The key and colon before a value of an object."""
        if closers[-1] == 125:
            self.string("invalid_object_key")
            self.colon()

    def colon(self) -> None:
        self.blank()
        if self.byte() != 58:
            raise Stop("unexpected_end" if self.byte() < 0 else "missing_colon", "invalid", self.at)
        self.at += 1
        self.blank()


class MoreNeeded(Exception):
    """The part of a text that was given ends too soon."""


def scan_keys(data: bytes, path: str = "", mark: str = "", cursor: str | None = None, secret: bytes | None = None, base: int = 0, total: int | None = None, last: bool = False, cancelled: Callable[[], bool] | None = None, **limits: int) -> dict:
    """A page of the top-level entries: key, byte_start, byte_end (half open) and a preview, in source order with
    repeats. ``validation`` is complete only when the rest of the text was read and obeys the grammar.

    ``data`` may be a part of a text of ``total`` bytes that begins at ``base``; where its end stops the scan,
    ``MoreNeeded`` is raised, or, of the ``last`` part that the scan's budget allows, the budget is exhausted.
    ``cancelled`` is asked now and then; a cancelled scan says so."""
    lim = _limits(limits)
    secret = secret or _secret
    start, count = decode_cursor(secret, cursor, path, mark) if cursor else (0, 0)
    out, boundary = _page(data, lim, start if cursor else None, count, base, total, last, cancelled)
    if boundary is not None:
        out["next_cursor"] = encode_cursor(secret, path, mark, boundary, count + len(out["entries"]))
    return out


def _limits(given: dict) -> dict[str, int]:
    return {k: positive(given.get(k), default, k, most) for k, (default, most) in LIMITS.items()}


def _size(key_json: str, begin: int, end: int, preview: str) -> int:
    """The bytes of an entry as JSON."""
    text = f'{{"key":{key_json},"byteStart":{begin},"byteEnd":{end},"preview":{encode_basestring(preview)}}}'
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def _valid(data: bytes) -> bool:
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _page(data: bytes, lim: dict[str, int], resume: int | None, count: int, base: int = 0, total: int | None = None, last: bool = False, cancelled: Callable[[], bool] | None = None) -> tuple[dict, int | None]:
    """``scan_keys`` from the byte ``resume``, or from the beginning, with ``count`` keys before; and where the next
    page begins, if there is one."""
    start = (resume or 0) - base
    partial = total is not None and base + len(data) < total
    if resume is not None and data[start - 1 : start] != b",":
        raise ValueError("stale_cursor")
    scan = _Scan(data, lim["max_depth"], min(len(data), start + lim["max_scan_bytes"]), time.monotonic() + lim["max_time_ms"] / 1000, cancelled)
    scan.at = start
    room, most, most_key, most_preview = lim["max_output_bytes"] - RESERVED, lim["limit"], lim["max_key_bytes"], lim["max_preview"]
    plain = cancelled is None and lim["max_depth"] > PLAIN_DEPTH
    fence = len(data) if scan.stop == len(data) else scan.stop - 1  # where a plain entry ends at most
    out = {"top_level": "error" if resume is None else "object", "entries": [], "has_more": False, "validation": "incomplete", "total_keys": None, "next_cursor": None, "code": None, "resume_offset": None, "value_start": None, "top_preview": ""}
    entries, used, value_start = out["entries"], 0, None

    def page_end(boundary: int) -> tuple[dict, int]:
        out["has_more"] = True
        out["scanned_bytes"] = boundary - start
        return out, base + boundary

    try:
        boundary, first = start, resume is None
        if first:
            scan.blank()
            b = scan.byte()
            if b < 0:
                raise Stop("unexpected_end", "invalid", scan.at)
            out["top_level"] = "object" if b == 123 else "array" if b == 91 else "primitive"
            if b != 123:
                begin = scan.at
                scan.value(0)
                out["code"] = "unsupported_top_level"
                out["top_preview"] = shorten(data[begin : scan.at].decode("utf-8", "ignore"), most_preview)
            else:
                scan.at += 1
        while out["top_level"] == "object":
            whole = _PLAIN.match(data, scan.at) if plain else None
            if whole and (whole.end() > fence or not (whole[0].isascii() or _valid(whole[0]))):
                whole = None
            if whole:
                scan.tick()
                raw = whole[1]
                scan.at = whole.end(1)
            else:
                scan.blank()
                if first and scan.byte() == 125:
                    scan.at += 1
                    break
                raw = scan.string("invalid_object_key")
            first = False
            if len(raw) - 2 > most_key:
                raise Stop("key_budget_exhausted", "budget_exhausted", scan.at)
            key = json.loads(raw) if b"\\" in raw else raw[1:-1].decode()
            key_json = encode_basestring(key)
            if 6 * len(raw) + 100 > room - used and _size(key_json, (1 << 53) - 1, (1 << 53) - 1, "") + 1 > room - used:
                if not entries:
                    raise Stop("output_budget_exhausted", "budget_exhausted", scan.at)
                return page_end(boundary)
            if whole:
                begin, end = whole.span(2)
            else:
                scan.colon()
                begin = value_start = scan.at
                scan.value(1)
                value_start = None
                end = scan.at
            shown = data[begin : min(end, begin + 4 * most_preview + 4)]
            preview = shown[:most_preview].decode() if shown.isascii() else shorten(shown.decode("utf-8", "ignore"), most_preview)
            if len(preview if preview.isascii() else preview.encode()) < end - begin:
                preview += "…"
            while (size := _size(key_json, base + begin, base + end, preview)) > room - used - 1 and preview:
                preview = shorten(preview, utf16(preview) * 3 // 4)
            entry = {"key": key, "byte_start": base + begin, "byte_end": base + end, "preview": preview}
            if whole:
                scan.at = whole.end() - 1
                b = data[scan.at]
            else:
                scan.blank()
                b = scan.byte()
                if b not in (44, 125):
                    raise Stop("unexpected_end" if b < 0 else "missing_separator", "invalid", scan.at)
            entries.append(entry)
            used += size + 1
            count += 1
            scan.at += 1
            if b == 125:
                break
            boundary = scan.at
            if len(entries) >= most:
                return page_end(boundary)
        scan.blank()
        if scan.at < len(data):
            raise Stop("trailing_content", "invalid", scan.at)
        if partial:
            raise Stop("unexpected_end", "invalid", scan.at)
        out["validation"] = "complete"
        out["total_keys"] = count if out["top_level"] == "object" else None
    except Stop as e:
        # A token that the part's end cuts may look wrong; only what the whole text says counts.
        if partial and e.validation != "cancelled" and e.code not in ("time_budget_exhausted", "depth_budget_exhausted", "output_budget_exhausted", "key_budget_exhausted"):
            if not last:
                raise MoreNeeded from e
            e = Stop("scan_budget_exhausted", "budget_exhausted", start + lim["max_scan_bytes"])
        out |= {"validation": e.validation, "code": e.code}
        if e.validation == "budget_exhausted":
            out |= {"resume_offset": base + e.at, "value_start": None if value_start is None else base + value_start}
    out["scanned_bytes"] = scan.at - start
    return out, None


#: Bytes that are read of a file at first; each further part has eight times as many.
FIRST_PART = 1 << 16


def scan_file(read: Callable[[int, int], bytes], total: int, path: str, mark: str, cursor: str | None = None, secret: bytes | None = None, **limits) -> dict:
    """``scan_keys`` of a file that ``read(start, stop)`` gives in parts: no more is read than the page needs, nor than
    its budget lets it scan."""
    start = max(0, decode_cursor(secret or _secret, cursor, path, mark)[0] - 1) if cursor else 0
    most = positive(limits.get("max_scan_bytes"), LIMITS["max_scan_bytes"][0], "max_scan_bytes") + 1
    size = FIRST_PART
    while True:
        stop = min(total, start + min(size, most))
        try:
            return scan_keys(read(start, stop), path, mark, cursor, secret, base=start, total=total, last=size >= most, **limits) | {"total_bytes": total}
        except MoreNeeded:
            size *= 8


KEYS = "id long, ordinal int, key string, byte_start long, byte_end long, preview string, validation string, total_keys long"


def json_keys(rows: DataFrame, id_col: str, text_col: str, page_number: int | None = None, **limits: int) -> DataFrame:
    """A row per top-level key of each row's text, all pages or the one of ``page_number`` (from 0); a text, or page,
    without any gives one row of nulls."""
    prepare(rows.sparkSession)
    lim = _limits(limits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data, resume, count, entries, number = (text or "").encode(), None, 0, [], 0
                while True:
                    page, resume = _page(data, lim, resume, count)
                    entries += page["entries"] if page_number in (None, number) else []
                    if resume is None or number == page_number:
                        break
                    count += len(page["entries"])
                    number += 1
                end = (page["validation"], page["total_keys"])
                rows += [(row, i, e["key"], e["byte_start"], e["byte_end"], e["preview"], *end) for i, e in enumerate(entries)] or [(row, None, None, None, None, None, *end)]
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 8, kinds)], [x.split()[0] for x in KEYS.split(", ")])

    return dealt(rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))).mapInArrow(scan, KEYS)
