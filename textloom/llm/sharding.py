"""Sharding by a hierarchical weighted hash tree: regions, racks, shards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialise, ranked

REGION, RACK = 4, 2


@dataclass(frozen=True)
class Node:
    """``name`` seeds the node's draws; a leaf carries ``shard``, an inner node ``children``."""

    name: str
    weight: float
    shard: int | None = None
    children: tuple["Node", ...] = ()


def inner(name: str, children: list[Node]) -> Node:
    return Node(name, sum(c.weight for c in children), None, tuple(children))


def topology(shards: int, weights: dict[int, float] | None = None) -> Node:
    """Shards in racks of two and regions of four; the last region takes what is over.

    From a multiple of four to one more shard, the new one is a region of its own, so rows move into it only.
    """
    leaf = lambda s: Node(f"s{s}", float((weights or {}).get(s, 1.0)), s)
    regions = []
    for r in range(0, shards, REGION):
        racks = [inner(f"k{k}", [leaf(s) for s in range(k, min(k + RACK, r + REGION, shards))]) for k in range(r, min(r + REGION, shards), RACK)]
        regions.append(inner(f"r{r}", racks))
    return inner("root", regions)


def _draw(key: list[Column], node: Node) -> Column:
    """An exponential draw of rate ``weight``: the least of several falls on a node in proportion to its weight."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(node.name), *key), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(node.weight)


def descend(key: list[Column], node: Node) -> Column:
    """The shard of a row: at each level go to the child with the least draw. A change of one weight moves rows
    only into or out of the subtrees on its path."""
    if node.shard is not None:
        return F.lit(node.shard).cast("int")
    live = [c for c in node.children if c.weight > 0]
    if len(live) == 1:
        return descend(key, live[0])
    draws = F.array(*[_draw(key, c) for c in live])
    at = F.array_position(draws, F.array_min(draws))
    choice = None
    for i, c in enumerate(live, 1):
        choice = F.when(at == i, descend(key, c)) if choice is None else choice.when(at == i, descend(key, c))
    return choice


def assign_shards(docs: DataFrame, shards: int = 8, weights: dict[int, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its shard under the law ``key``: id and topology decide, nothing else.

    size: UTF-8 bytes plus 1 (null text: 1). text_crc32: unsigned crc32 of the UTF-8 bytes (null text: that of
    no bytes, 0). slot: gapless place in the shard, by id hash, id, crc and size, found without gathering a
    shard in one task. grown_shard: the shard with one more. Rows with equal id share a shard, a null id is an
    id like any other; repeated rows have slots of their own; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = [F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))]
    rows = rows.withColumns({"law": F.lit("key"), "shard": descend(key, topology(shards, weights)), "grown_shard": descend(key, topology(shards + 1, weights))})
    rows = materialise(rows, "shards")  # thin rows: the texts are read once
    placed = ranked(rows, ["shard"], [], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
