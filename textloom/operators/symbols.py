"""Symbol and file searches: matching, ranking, boosts, pages and what lies beyond them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.scalar import directory_parts, extension, match_tier, name_matches
from textloom.operators.graph import checkpointed


def matching(symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    out = symbols.where(name_matches(F.col("name"), name))
    return out.where(F.col("kind") == kind) if kind else out


def with_order(hits: DataFrame, name: str, ranks: DataFrame | None = None, boosted: list[str] | None = None) -> tuple[DataFrame, list[Column]]:
    """``hits`` with tier, boost and file rank, and the order: quality, boost, rank, place. Without ``ranks`` the
    order is the place alone. Ranks join by file; Spark broadcasts them when they are small."""
    place = [F.col("file"), F.col("line"), F.col("seq")]
    if ranks is None and boosted is None:
        return hits, place
    out = hits.withColumn("tier", match_tier(F.col("name"), name))
    out = out.withColumn("boost", F.lower("file").isin(boosted) if boosted else F.lit(False))
    out = out.join(ranks.select("file", "rank"), "file", "left").withColumn("rank", F.coalesce("rank", F.lit(0.0))) if ranks is not None else out.withColumn("rank", F.lit(0.0))
    return out, [F.col("tier"), F.desc("boost"), F.desc("rank"), *place]


def matched_bytes(hits: DataFrame, files: DataFrame) -> DataFrame:
    """The bytes of the distinct files that have a hit."""
    own = files.select(F.col("path").alias("file"), "size")
    return own.join(hits.select("file").distinct(), "file", "left_semi").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.count(F.lit(1)).alias("files"))


def numbered(rows: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """``rows`` with their 1-based places in ``order``. No task has all rows: they are sorted by ranges, written, and
    each range's count, a row each, tells where the next one begins."""
    placed = checkpointed(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, within = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(before.drop("__n")), part == F.col("__part")).withColumn(out, F.col("__before") + within + 1).drop("__at", "__part", "__before")


def page(rows: DataFrame, order: list[Column], limit: int) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` rows, and the rest. The page is a top-k; the rest is told by its places."""
    place = "__place"
    return rows.orderBy(*order).limit(limit), numbered(rows, order, place).where(F.col(place) > limit).drop(place)


def first_context(symbols: DataFrame, text: Column) -> DataFrame:
    """(file, context) of each file's first symbol in extraction order: a partial minimum, no window."""
    return symbols.groupBy("file").agg(F.min_by(text, F.col("seq")).alias("context"))


def list_files(files: DataFrame, pattern: str | None = None) -> DataFrame:
    """(path, lines, size) by path; ``lines`` is 0, as no text is read."""
    out = files.where(F.contains(F.lower("path"), F.lit(pattern.lower()))) if pattern else files
    return out.select("path", F.lit(0).cast("long").alias("lines"), "size").orderBy("path")


def admitted(files: DataFrame, exts: list[str], skip_dirs: list[str], max_bytes: int | None = None) -> DataFrame:
    """Files of an allowed extension outside all skipped directories; ``extract`` where the text is to be read."""
    out = files.where(extension(F.col("path")).isin(exts))
    if skip_dirs:
        out = out.where(~F.arrays_overlap(directory_parts(F.col("path")), F.array(*map(F.lit, skip_dirs))))
    return out.withColumn("extract", F.col("size") <= max_bytes if max_bytes is not None else F.lit(True))


def deduplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key that was found first."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.col("seq")).alias("r")).select("r.*")


def cost(files: DataFrame, hits: DataFrame, output_chars: int) -> DataFrame:
    """Tokens of an answer against those of reading the matched files, or, with no hit, all files."""
    from textloom.functions.scalar import saved_percent, saved_tokens, tokens

    both = matched_bytes(hits, files).crossJoin(files.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("all_bytes")))  # one row each
    naive = F.when(F.col("files") > 0, F.col("bytes")).otherwise(F.col("all_bytes"))
    out = both.select("files", naive.alias("naive_bytes"), F.lit(output_chars).cast("long").alias("chars"))
    saved = saved_tokens(F.col("naive_bytes"), F.col("chars"))
    return out.select("files", "naive_bytes", tokens(F.col("naive_bytes")).alias("naive_tokens"), tokens(F.col("chars")).alias("out_tokens"), saved.alias("saved_tokens"), saved_percent(saved, F.col("naive_bytes")).alias("saved_percent"))
