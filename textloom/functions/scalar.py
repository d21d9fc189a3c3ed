"""Scalar functions as columns: they stay inside generated code."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(path: Column) -> Column:
    """The lower-cased last extension with its dot; '' for none and for dot files."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def directory_parts(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def valid_relative(path: Column) -> Column:
    """Not empty, not absolute, no backslash, no NUL, no empty, '.' or '..' segment."""
    return F.coalesce((path != "") & ~F.contains(path, F.lit("\\")) & ~F.contains(path, F.lit("\x00")) & ~path.rlike(r"(^|/)(\.{0,2})(/|$)"), F.lit(False))


def tokens(chars: Column) -> Column:
    """An estimate of four characters a token, at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(chars / 4).cast("long"))


def saved_tokens(naive_bytes: Column, chars: Column) -> Column:
    whole = lambda x: F.floor(F.greatest(F.lit(0), x))
    return F.greatest(F.lit(0).cast("long"), tokens(whole(naive_bytes)) - tokens(whole(chars)))


def saved_percent(saved: Column, naive_bytes: Column) -> Column:
    """Per cent with one decimal, halves up, of the estimate of the summed bytes."""
    return F.floor(F.lit(1000.0) * saved / tokens(naive_bytes) + 0.5) / 10


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def match_tier(name: Column, query: str) -> Column:
    """0: equal, 1: begins with, 2: otherwise; without regard to case."""
    low = F.lower(name)
    return F.when(low == query.lower(), 0).when(F.startswith(low, F.lit(query.lower())), 1).otherwise(2)


def name_matches(name: Column, query: str) -> Column:
    """Either contains the other, without regard to case; an empty query matches all."""
    low, q = F.lower(name), F.lit(query.lower())
    return F.contains(low, q) | F.contains(q, low)


def line_of(text: Column, offset: Column) -> Column:
    """The 1-based line of a 0-based character offset; only newlines count."""
    prefix = F.substring(text, F.lit(1), offset.cast("int"))
    return (F.length(prefix) - F.length(F.translate(prefix, "\n", "")) + 1).cast("int")


def symbol_text(file: Column, line: Column, kind: Column, name: Column, context: Column) -> Column:
    return F.concat(file, F.lit(":"), line.cast("string"), F.lit(" ("), kind, F.lit(") "), name, F.lit(" — "), context)


def edge_text(file: Column, line: Column, to: Column, context: Column) -> Column:
    return F.concat(file, F.lit(":"), line.cast("string"), F.lit(" → "), to, F.lit(" — "), context)


def sha1_prefix(text: Column, digits: int) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, digits)


# Plain Python helpers, for values that a query is given rather than rows.


def canonical(value: object) -> str:
    """JSON with object keys sorted at all depths, arrays in order, no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def args_hash(tool: str, root: str, args: dict) -> str:
    return hashlib.sha1(f"{tool}|{root}|{canonical(args)}".encode()).hexdigest()[:16]


def root_hash(root: str) -> str:
    return hashlib.sha1(os.path.abspath(root).encode()).hexdigest()[:12]


def effective_args(args: dict, defaults: dict, relevant: set[str] | None = None) -> dict:
    """Defaults filled in, irrelevant arguments gone, so that equal calls hash alike."""
    full = defaults | {k: v for k, v in args.items() if v is not None}
    return {k: v for k, v in full.items() if relevant is None or k in relevant}


def normal_options(include_exts: list[str], skip_dirs: list[str]) -> tuple[list[str], list[str]]:
    """Extensions lower-cased with a dot, both lists distinct and sorted, blanks gone."""
    dotted = {e if e.startswith(".") else f".{e}" for e in (x.strip().lower() for x in include_exts)}
    return sorted(dotted - {"."}), sorted({s.strip() for s in skip_dirs} - {""})


def fingerprint(parser: str, include_exts: list[str], skip_dirs: list[str], max_scan_bytes: int, max_context: int) -> str:
    exts, skips = normal_options(include_exts, skip_dirs)
    return hashlib.sha256(canonical({"parser": parser, "exts": exts, "skip": skips, "scan": max_scan_bytes, "context": max_context}).encode()).hexdigest()


def inside_root(root: str, path: str) -> str | None:
    """``path`` (absolute or relative, either slash) relative to ``root`` with forward slashes; None outside it."""
    full = posixpath.normpath(posixpath.join(root, path.replace("\\", "/")))
    rel = posixpath.relpath(full, posixpath.normpath(root))
    return None if rel == ".." or rel.startswith("../") else rel


def boost_paths(root: str, paths: list[str]) -> list[str]:
    """Lower-cased relative forms of the paths that lie inside ``root``."""
    return [p.lower() for p in (inside_root(root, x) for x in paths) if p]


def positive(value: int | None, default: int, name: str, most: int | None = None) -> int:
    """``value`` or ``default``: a whole number from 1 to ``most``."""
    out = default if value is None else value
    if isinstance(out, bool) or not isinstance(out, int) or out < 1 or out >= 1 << 53 or (most is not None and out > most):
        raise ValueError(f"{name} must be a whole number from 1" + (f" to {most}" if most else ""))
    return out


def signature(secret: bytes, body: bytes) -> bytes:
    return hmac.new(secret, body, hashlib.sha256).digest()
