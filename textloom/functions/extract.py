"""Declarations and imports of source texts by pattern families, and how an import's target is found."""

from __future__ import annotations

import posixpath
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.schemas import EDGES, SYMBOLS
from textloom.session import prepare

# The file families and the forms that count as declarations and imports.
SCRIPT = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts")
TYPED = (".ts", ".tsx", ".mts", ".cts")
DECLARATIONS = {
    "script": [
        ("function", r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"),
        ("class", r"^[ \t]*(?:export\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
        ("const", r"^[ \t]*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?:=|\:)"),
        ("type", r"^[ \t]*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*="),
        ("interface", r"^[ \t]*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)"),
    ],
    "python": [("function", r"^[ \t]*(?:async\s+)?def\s+(\w+)"), ("class", r"^[ \t]*class\s+(\w+)")],
    "go": [("func", r"^[ \t]*func\s*(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"), ("type", r"^[ \t]*type\s+([A-Za-z_]\w*)\s+(?:struct|interface)")],
    "rust": [("fn", r"^[ \t]*(?:pub(?:\s*\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("type", r"^[ \t]*(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)")],
    "other": [
        ("function", r"^[ \t]*(?:export\s+|public\s+|private\s+|protected\s+)?(?:static\s+|async\s+)?(?:function|def|fn)\s+([A-Za-z_]\w*)"),
        ("class", r"^[ \t]*(?:export\s+|public\s+|abstract\s+)?class\s+([A-Za-z_]\w*)"),
    ],
}
IMPORTS = {
    "script": [
        r"""^[ \t]*import\s+(?:[\w$*{},\s\n/]+\s+from\s+)?['"]([^'"]+)['"]""",
        r"""^[ \t]*export\s+(?:type\s+)?(?:\*(?:\s+as\s+[\w$]+)?|\{[^}]*\})\s+from\s+['"]([^'"]+)['"]""",
        r"""\bimport\s*\(\s*['"]([^'"]+)['"]\s*\)""",
        r"""\brequire\s*\(\s*['"]([^'"]+)['"]\s*\)""",
    ],
    "python": [r"^[ \t]*from\s+(\S+)\s+import\b", r"^[ \t]*import\s+(\S+)"],
}
ORDER = {
    True: [".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", ".json"],
    False: [".js", ".jsx", ".ts", ".tsx", ".d.ts", ".mjs", ".cjs", ".mts", ".cts", ".json"],
}
COUNTERPARTS = {
    ".js": [".ts", ".tsx", ".d.ts", ".js", ".jsx"],
    ".jsx": [".tsx", ".d.ts", ".jsx"],
    ".mjs": [".mts", ".d.mts", ".mjs"],
    ".cjs": [".cts", ".d.cts", ".cjs"],
}
# End of the fixed values.

MODULE = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*", re.ASCII)


def _compiled(pattern: str) -> re.Pattern:
    """``\\w`` is ASCII and ``\\s`` is not: spelled so, as the flags of a pattern hold for both."""
    blank = "\\s\ufeff"
    return re.compile(pattern.replace(r"[\w$*{},\s\n/]", f"[A-Za-z0-9_$*{{}},{blank}\\n/]").replace(r"[\w$]", "[A-Za-z0-9_$]").replace(r"\w", "[A-Za-z0-9_]").replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"), re.MULTILINE)


_declarations = {k: [(kind, _compiled(p)) for kind, p in v] for k, v in DECLARATIONS.items()}
_imports = {k: [_compiled(p) for p in v] for k, v in IMPORTS.items()}


def family(ext: str) -> str:
    return "script" if ext in SCRIPT else {".py": "python", ".go": "go", ".rs": "rust"}.get(ext, "other")


def ext_of(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[1].lower()


class Lines:
    """Line numbers of offsets in one text."""

    def __init__(self, text: str):
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def at(self, offset: int) -> int:
        return bisect_left(self.breaks, offset) + 1


def utf16_cut(text: str, most: int) -> str:
    """At most ``most`` UTF-16 units; half a pair is left out."""
    return text if len(text) <= most and text.isascii() else text.encode("utf-16-le")[: 2 * most].decode("utf-16-le", "ignore")


def find_symbols(text: str, ext: str, max_context: int = 240) -> Iterator[tuple[str, int, str, str]]:
    """(name, line, kind, context), a pattern after the other; a name counts once per kind and line."""
    lines, seen = Lines(text), set()
    for kind, pattern in _declarations[family(ext)]:
        for m in pattern.finditer(text):
            name = m[1]
            row = (name, kind, lines.at(m.start() + m[0].rindex(name)))
            if row not in seen:
                seen.add(row)
                yield name, row[2], kind, utf16_cut(m[0].strip(), max_context)


def find_imports(text: str, ext: str, max_context: int = 240) -> list[tuple[str, int, str]]:
    """(specifier, line, context) by line; within a line in the order of the patterns."""
    lines, found = Lines(text), {}
    for pattern in _imports.get(family(ext), []):
        for m in pattern.finditer(text):
            spec, line = m[1].strip() if ext == ".py" else m[1], lines.at(m.start())
            if spec and (spec, line) not in found:
                end = text.find("\n", m.start())
                begin = text.rfind("\n", 0, max(0, m.start())) + 1
                found[spec, line] = utf16_cut(text[begin : end if end >= 0 else len(text)].strip(), max_context)
    return sorted(((s, n, c) for (s, n), c in found.items()), key=lambda x: x[1])


def targets(file: str, specifier: str) -> tuple[str, list[str]]:
    """('', candidate paths in order of preference), or the status of a specifier that can't be a file here."""
    ext, spec = ext_of(file), specifier.replace("\\", "/")
    here = posixpath.dirname(file)
    if ext == ".py":
        level = len(spec) - len(spec.lstrip("."))
        if not MODULE.fullmatch(spec[level:]):
            return "unresolved", []
        base = posixpath.join("/root", here) if level else "/root"
        for _ in range(level - 1):
            base = posixpath.dirname(base)
        rel = posixpath.relpath(posixpath.join(base, spec[level:].replace(".", "/")), "/root")
        return ("outside", []) if rel.startswith("../") else ("", [f"{rel}.py", f"{rel}/__init__.py"])
    if spec.startswith(("@/", "~/", "#")):
        return "unresolved", []
    if spec not in (".", "..") and not spec.startswith(("./", "../", "/")):
        return "external", []
    depth = "/".join(f"d{i}" for i in range(spec.count("..") + 1))  # so that no parent of the root is met
    top = f"/{depth}/root"
    rel = posixpath.relpath(posixpath.normpath(posixpath.join(top, here, spec)), top)
    if rel == ".." or rel.startswith("../"):
        return "outside", []
    rel = "" if rel == "." else rel
    order, suffix = ORDER[ext in TYPED], ext_of(rel)
    index = [f"{rel}/index{e}" if rel else f"index{e}" for e in order]
    if ext in TYPED and suffix in COUNTERPARTS:
        return "", [rel[: -len(suffix)] + e for e in COUNTERPARTS[suffix]] + index
    if suffix:
        return "", [rel, *index]
    return "", [rel, *(rel + e for e in order), *index]


def symbols_of(files: DataFrame, max_context: int = 240, max_bytes: int | None = None) -> DataFrame:
    """Symbols of ``files`` (path, text). A null text has none; a text over ``max_bytes`` is not searched."""
    prepare(files.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, path, line, kind, context, seq) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for seq, (name, line, kind, context) in enumerate(find_symbols(text, ext_of(path), max_context))]
            yield _batch(rows, SYMBOLS)

    return _texts(files, max_bytes).mapInArrow(extract, SYMBOLS)


def imports_of(files: DataFrame, max_context: int = 240, max_bytes: int | None = None) -> DataFrame:
    """(from, specifier, line, context, seq, status, candidates) of ``files`` (path, text)."""
    prepare(files.sparkSession)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for seq, (spec, line, context) in enumerate(find_imports(text, ext_of(path), max_context)):
                    status, candidates = targets(path, spec)
                    rows.append((path, spec, line, context, seq, status or None, candidates))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string())]
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["from", "specifier", "line", "context", "seq", "status", "candidates"])

    return _texts(files, max_bytes).mapInArrow(extract, CANDIDATES)


CANDIDATES = "from string, specifier string, line int, context string, seq int, status string, candidates array<string>"


def with_candidates(edges: DataFrame) -> DataFrame:
    """Edges (from, specifier, line, context, seq) with the candidates of their targets, as the set of files may have
    changed."""
    prepare(edges.sparkSession)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [targets(f, s) for f, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s or None for s, _ in told], pa.string()), pa.array([c for _, c in told], pa.list_(pa.string()))], [*batch.schema.names, "status", "candidates"])

    return edges.select("from", "specifier", F.col("line").cast("int").alias("line"), "context", F.col("seq").cast("int").alias("seq")).mapInArrow(found, CANDIDATES)


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges: each import with the first of its candidates that is a file; parallel edges stay."""
    keyed = imports.withColumn("edge", F.struct("from", "line", "seq", "specifier"))
    tried = keyed.where("status is null").select("edge", F.posexplode("candidates").alias("prio", "path"))
    hit = tried.join(files.select("path").distinct(), "path").groupBy("edge").agg(F.min_by("path", "prio").alias("target"))
    out = keyed.join(hit, "edge", "left")
    status = F.coalesce("status", F.when(F.col("target").isNotNull(), F.lit("resolved")).otherwise(F.lit("unresolved")))
    return out.select("from", "specifier", status.alias("status"), "target", F.coalesce("target", "specifier").alias("to"), "line", "context", "seq").to(EDGES)


def _texts(files: DataFrame, max_bytes: int | None) -> DataFrame:
    texts = files.where("path is not null and text is not null").select("path", "text")
    return texts.where(F.octet_length("text") <= max_bytes) if max_bytes is not None else texts


def _batch(rows: list[tuple], schema) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows)) or [[]] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], arrow.names)
