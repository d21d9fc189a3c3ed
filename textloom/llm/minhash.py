"""Near-duplicate documents by HyperMinHash: compressed registers, banding, corrected estimates, verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialise, prepare, trimmed
from textloom.llm.components import components
from textloom.llm.words import mix64, shingles, words_of

#: Words of a shingle and the least similarity, in hundredths, unless a contract says otherwise.
WIDTH, PERCENT = 5, 80
#: Registers of a signature, and of a band. The bands part the registers among them, so each register stands in one
#: (the last band takes two more from the first). At similarity 0.8 a pair of long texts shares no band with
#: probability (1 - 0.8^6)^43 = 2e-6; documents that have half their text in common rarely share one.
REGISTERS, BAND = 256, 6
_drawn = np.random.default_rng(4).permutation(REGISTERS)
MEMBERS = np.append(_drawn, _drawn[: -REGISTERS % BAND]).reshape(-1, BAND)
BANDS = len(MEMBERS)
#: A register holds the count of leading zeros (6 bits) and the bits after the first one (10) of its bucket's least hash.
MANTISSA, EMPTY = 10, 0xFFFF
VALUE_BITS = 64 - REGISTERS.bit_length() + 1
#: Accidental agreement of two registers whose least hashes differ: the sum over equal zero counts of 2^-MANTISSA.
COLLISION = 2.0**-MANTISSA / 3
#: Standard errors, and similarity beside them, by which an estimate may fall short before a pair is let go.
SLACK, MARGIN = 3.5, 0.02
#: Pairs whose smaller set has up to this size are found without fail: these sets, and all that may be similar to
#: one, travel whole with their registers and meet in the buckets of their rarest shingles.
SMALL = 48
#: Members of a bucket that meet in one row. In larger buckets, sets meet by their rarest shingles.
BLOCK = 64
#: Members of a block where all pairs of blocks meet, so that a member is copied to few of them: by registers, and in
#: the comparison of whole sets as a matrix of members and shingles.
LAST_BLOCK, EXACT_BLOCK = 512, 128
#: Shingles (8 bytes each) of the sets of a part of a block. The pairs of two parts are confirmed together, by one task
#: that has each of their sets once.
PART_SHINGLES = 1 << 15
#: A shingle is frequent if it stands in so many sets of a batch; the counts of up to so many of them are shared (8 MB).
FREQUENT, COUNTED = 4, 1 << 19
#: Bits of the map of ids whose texts are to be read again, for each id and at most.
MAP_SHARE, MOST_BITS = 16, 1 << 27


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, REGISTERS) of uint16. The top bits of a hash choose its bucket; as sets are sorted, the first of
    each bucket is the least."""
    out = np.full((len(sets), REGISTERS), EMPTY, np.uint16)
    edges = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(VALUE_BITS)
    least = np.zeros((len(sets), REGISTERS), np.uint64)
    filled = np.zeros((len(sets), REGISTERS), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, edges)
            inside = np.append(at[1:], len(s)) > at
            least[i, inside] = s[at[inside]]
            filled[i] = inside
    value = least & np.uint64((1 << VALUE_BITS) - 1)
    fraction, bits = np.frexp(value.astype(np.float64))
    zeros = np.clip(VALUE_BITS - bits, 0, 62)
    mantissa = np.minimum(((fraction * 2 - 1) * (1 << MANTISSA)).clip(0).astype(np.int64), (1 << MANTISSA) - 1)
    code = (zeros.astype(np.int64) << MANTISSA | mantissa).astype(np.uint16)
    out[filled] = code[filled]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(documents, BANDS) of int64: a hash of the band's registers; 0 for a band without any hash."""
    keys = np.empty((len(regs), BANDS), np.uint64)
    for band, at in enumerate(MEMBERS):
        own = regs[:, at].astype(np.uint64)
        key = mix64(np.full(len(regs), band + 1, np.uint64))
        for k in range(BAND):
            key = mix64(key ^ (own[:, k] + np.uint64(k << 16)))
        key[(own == EMPTY).all(1)] = 0
        keys[:, band] = key
    return keys.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of registers, and how many registers each rests on."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(1)
    same = ((a == b) & (a != EMPTY)).sum(1)
    rate = same / np.maximum(used, 1)
    return (rate - COLLISION) / (1 - COLLISION), used


def hopeful(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of sets of ``n`` and ``m`` shingles that may reach ``percent``: those whose estimate does not fall
    further short than chance allows. The registers in use are a sample, without repeats, of the union."""
    at = percent / 100
    rate, used = estimate(a, b)
    union = np.maximum((n + m) / (1 + at), 2)
    spread = np.sqrt(at * (1 - at) / np.maximum(used, 1) * np.clip(1 - (used - 1) / (union - 1), 0, 1))
    return rate >= at - SLACK * spread - MARGIN


def fewest_equal(used: np.ndarray, percent: int) -> np.ndarray:
    """How many equal registers a ``hopeful`` pair has at least, of which one uses ``used``."""
    at = percent / 100
    return np.ceil(used * np.maximum(0, at - SLACK * np.sqrt(at * (1 - at) / np.maximum(used, 1)) - MARGIN))


def sizes_fit(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar at all."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exact test on full sets: 100 * intersection >= percent * union, for sets that aren't empty."""
    small, large = sorted((len(x), len(y)))
    if not small or 100 * small < percent * large:
        return False
    both = np.concatenate((x, y))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _utf8(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def _digest(shingle_set: np.ndarray) -> bytes | None:
    """What names a set: two sums over its hashes, and its size. An empty set has none."""
    return shingle_set.sum(dtype=np.uint64).tobytes() + mix64(shingle_set).sum(dtype=np.uint64).tobytes() + len(shingle_set).to_bytes(4, "little") if len(shingle_set) else None


def _frequent(sets: list[np.ndarray]) -> bytes:
    """The values that stand in FREQUENT of the sets, and in how many, as pairs of 64 bits."""
    value, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
    often = n >= FREQUENT
    return np.stack([value[often], n[often].astype(np.uint64)], 1).tobytes()


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, digest, regs, small, often) of ``docs`` (doc_id, text): copies have one digest, empty sets
    none. small: the whole set, if it is SMALL or may be similar to one that is. often: in a batch's first row, the
    shingles that stand in FREQUENT of its sets, and in how many."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(w, width) for w in words_of(_utf8(batch.column(1)))]
            regs = registers(sets)
            digests = list(map(_digest, sets))
            often = _frequent(list({d: s for d, s in zip(digests, sets) if d}.values()))
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary()), pa.array([s.tobytes() if percent * len(s) <= 100 * SMALL else None for s in sets], pa.binary()), pa.array([often if i == 0 else None for i in range(len(sets))], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "regs", "small", "often"])

    return docs.mapInArrow(trimmed(sign), "doc_id long, n_shingles long, digest binary, regs binary, small binary, often binary")


PAIRS = "id long, other long, rate double, sure boolean"
#: Pairs that are confirmed together, likeliest first: places x and y in ``ids``. The lists are small beside the sets.
CELLS = "cell long, sure boolean, ids array<long>, x array<int>, y array<int>"


def _top(root: list[int], v: int) -> int:
    while root[v] != v:
        root[v] = root[root[v]]
        v = root[v]
    return v


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the links x, y among ``n`` nodes join two trees, as they come; and the tree of each node."""
    root, keep = list(range(n)), np.zeros(len(x), bool)
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
        i, j = _top(root, a), _top(root, b)
        if i != j:
            root[j], keep[k] = i, True
    return keep, np.array([_top(root, v) for v in range(n)], np.int64)


def _similar_forest(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs x, y of ``sets`` are similar and join two trees, as they come; those inside a tree are not
    compared."""
    root, found = list(range(len(sets))), np.zeros(len(x), bool)
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
        i, j = _top(root, a), _top(root, b)
        if i != j and similar(sets[a], sets[b], percent):
            root[j], found[k] = i, True
    return found


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _with_bands(sets: DataFrame) -> DataFrame:
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_regs(batch.column(2)))
                row, band = np.nonzero(keys)
                ids, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array(sizes[row], pa.int32()), pa.array(keys[row, band], pa.int64())], ["id", "size", "key"])

    return sets.select("id", "size", "regs").mapInArrow(trimmed(explode), "id long, size int, key long")


def _with_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(id, size, key): of each set that came whole its rarest shingles, so many that sets without one in common have
    less than ``percent`` of a union in common; those that stand in one set alone are left out."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes), pa.int64()), pa.array(np.repeat(sizes, sizes), pa.int32()), pa.array(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64))], ["id", "size", "key"])

    rows = sets.where("small is not null").select("id", "size", "small").mapInArrow(trimmed(explode), "id long, size int, key long")
    met = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    own = rows.join(met, "key").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("by_n"))
    first = F.slice("by_n", 1, F.expr(f"size - cast(({percent} * size + 99) div 100 as int) + 1"))
    return own.select("id", "size", F.explode(first).alias("x")).where("x.n > 1").select("id", "size", F.col("x.key").alias("key"))


def _frequent_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts) of the most frequent shingles, COUNTED at most, by value, from what batches told."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(told[:, 0].copy()), pa.array(told[:, 1].copy())], ["value", "n"])

    counts = rows.where("often is not null").select("often").mapInArrow(tell, "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "frequent")
    # The least count whose values are no more than COUNTED; counts are told apart by their logarithm.
    level = F.floor(F.log2("n") * 16).alias("level")
    least, seen = 0, 0
    for row in counts.groupBy(level).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("level")).collect():
        seen += row["m"]
        if seen > COUNTED:
            least = row["level"] + 1
            break
    table = counts.where(level >= least).toArrow()
    value, n = table["value"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(value)
    return value[order], n[order]


def _map_of(ids: DataFrame, n: int) -> np.ndarray:
    """A map of ``n`` ids in bits, of bounded size: if it fills up, it lets other ids pass."""
    bits = min(MOST_BITS, max(1 << 12, 1 << (MAP_SHARE * n).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _slot(batch.column(0), bits)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6, pa.int64()), pa.array((np.uint64(1) << (slot & 63).astype(np.uint64)).view(np.int64), pa.int64())], ["word", "bits"])

    marks = ids.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    flags = np.zeros(bits >> 6, np.int64)
    flags[marks["word"].to_numpy()] = marks["bits"].to_numpy()
    return flags


def _passes(flags: np.ndarray, ids: pa.Array) -> pa.Array:
    slot = _slot(ids, 64 * len(flags))
    return pa.array(flags[slot >> 6] >> (slot & 63) & 1 == 1)


def _with_rarest(rows: DataFrame, texts: DataFrame, hot: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, size, key): of each of the sets ``hot`` (id, least, digest, size) its rarest shingles, so many that two
    sets without one in common have less than ``percent`` of a union in common. All sets put their shingles in one
    order: by how often batches have met them, as far as they have, and by hash."""
    spark = texts.sparkSession
    often, flags = spark.sparkContext.broadcast(_frequent_shingles(rows)), spark.sparkContext.broadcast(_map_of(hot.select("least"), hot.count()))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, n = often.value
        for batch in batches:
            batch = batch.filter(_passes(flags.value, batch.column(0)))
            for s in range(0, batch.num_rows, 200):
                sets = [x for x in (shingles(w, width) for w in words_of(_utf8(batch.column(1).slice(s, 200)))) if len(x)]
                if not sets:
                    continue
                size = np.array([len(x) for x in sets])
                flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
                place = np.minimum(np.searchsorted(value, flat), max(len(value) - 1, 0))
                met = np.where(value[place] == flat, n[place], 0) if len(value) else np.zeros(len(flat), np.int64)
                order = np.lexsort((flat, met, row))
                rank = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
                first = rank < np.repeat(size - -(-percent * size // 100) + 1, size)
                kept = order[first]
                ends = np.append(0, np.cumsum(np.bincount(row[kept], minlength=len(sets)))).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[kept].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in sets], pa.binary()), keys], ["digest", "keys"])

    found = texts.mapInArrow(trimmed(tell), "digest binary, keys array<long>").groupBy("digest").agg(F.first("keys").alias("keys"))
    own = materialise(found.join(hot.select("id", "size", "digest"), "digest").select("id", "size", "keys"), "rarest")
    return own.select("id", "size", F.explode("keys").alias("key"))


def _confirmed(small: list[bytes | None], other: list[bytes | None], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(keep, sure) for pairs whose registers allow a link: where both sets came whole, they tell."""
    sure = np.array([x is not None and y is not None for x, y in zip(small, other)], bool)
    keep = ~sure
    for i in np.flatnonzero(sure).tolist():
        keep[i] = similar(np.frombuffer(small[i], np.uint64), np.frombuffer(other[i], np.uint64), percent)
    return keep, sure


def _promising(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (id, other) whose registers let the similarity be ``percent``, with the estimate; sure: the
    sets came whole and are similar."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
                a, b = _regs(batch.column(2)), _regs(batch.column(3))
                at = np.flatnonzero(hopeful(a, b, n, m, percent))
                keep, sure = _confirmed(*(batch.column(k).take(pa.array(at)).to_pylist() for k in (6, 7)), percent)
                at = at[keep]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at)) for k in (0, 1)), pa.array(estimate(a[at], b[at])[0]), pa.array(sure[keep])], ["id", "other", "rate", "sure"])

    own = sets.select("id", "regs", "size", "small")
    others = own.toDF("other", "regs2", "size2", "small2")
    both = pairs.join(own, "id").join(others, "other")
    return both.select("id", "other", "regs", "regs2", "size", "size2", "small", "small2").mapInArrow(trimmed(weigh), PAIRS)


def _cells(pairs: DataFrame) -> DataFrame:
    """A cell for each of ``pairs``."""
    return pairs.select(F.xxhash64("id", "other").alias("cell"), "sure", F.array("id", "other").alias("ids"), F.array(F.lit(0)).alias("x"), F.array(F.lit(1)).alias("y"))


def _listed(cells: DataFrame) -> DataFrame:
    """(id, other, sure): the pairs of ``cells`` one by one."""
    pairs = cells.select("sure", "ids", F.explode(F.arrays_zip("x", "y")).alias("p")).select("sure", F.col("ids")[F.col("p.x")].alias("a"), F.col("ids")[F.col("p.y")].alias("b"))
    return pairs.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("other"), "sure")


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` the likeliest of each id; written."""
    best = F.max_by(F.struct("other", "sure"), F.struct("rate", -F.col("other"))).alias("best")
    return materialise(pairs.groupBy("id").agg(best).select("id", "best.*"), "likeliest")


def _slot(ids: pa.Array, bits: int) -> np.ndarray:
    ids = ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return (mix64(ids) & np.uint64(bits - 1)).astype(np.int64)


def _whole_sets(texts: DataFrame, wanted: DataFrame, n: int, width: int) -> DataFrame:
    """(id, whole) for the ``n`` sets ``wanted`` (id, least, digest), from the texts whose id is a ``least``. A map of ids,
    of bounded size, tells which texts to look at; if it fills up, it lets more pass, which their digests stop."""
    shared = texts.sparkSession.sparkContext.broadcast(_map_of(wanted.select("least"), n))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(_passes(shared.value, batch.column(0)))
            sets = [shingles(w, width) for w in words_of(_utf8(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([pa.array(map(_digest, sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["digest", "whole"])

    found = texts.mapInArrow(trimmed(keep), "digest binary, whole binary").join(wanted.select("id", "digest"), "digest")
    one = found.groupBy("digest").agg(F.first("id").alias("id"), F.first("whole").alias("whole"))  # a repeated row counts once
    return materialise(one.select("id", "whole"), "whole")


class _Judge:
    """Confirms pairs of sets on the full sets, and remembers which sets it has fetched."""

    def __init__(self, docs: DataFrame, sets: DataFrame, width: int, percent: int):
        self.docs, self.sets, self.width, self.percent = docs, sets, width, percent
        self.whole: DataFrame | None = None

    def fetch(self, cells: DataFrame) -> None:
        """The whole sets that ``cells`` need and that aren't at hand."""
        wanted = cells.select(F.explode("ids").alias("id")).distinct().join(self.sets.select("id", "least", "digest"), "id")
        if self.whole is not None:
            wanted = wanted.join(self.whole.select("id"), "id", "left_anti")
        wanted = materialise(wanted, "wanted")
        n = wanted.count()
        if n:
            more = _whole_sets(self.docs, wanted, n, self.width)
            self.whole = more if self.whole is None else self.whole.unionByName(more)

    def links(self, cells: DataFrame) -> DataFrame:
        """(id, other): links that join all that the similar pairs of ``cells`` join. A set comes once to each cell,
        and of a cell's links those are told that join two trees."""
        percent = self.percent

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for own, x, y, held in zip(*(batch.column(k) for k in range(4))):
                    own, x, y = (c.values.to_numpy(zero_copy_only=False) for c in (own, x, y))
                    place = {i: k for k, i in enumerate(held.values.field(0).to_pylist())}
                    whole = held.values.field(1)
                    sets = [np.frombuffer(whole[place[i]].as_py(), np.uint64) for i in own.tolist()]
                    found = _similar_forest(sets, x, y, percent)
                    yield pa.RecordBatch.from_arrays([pa.array(own[x[found]], pa.int64()), pa.array(own[y[found]], pa.int64())], ["id", "other"])

        sure, unsure = _listed(cells.where("sure")).select("id", "other"), cells.where("not sure")
        self.fetch(unsure)
        if self.whole is None:
            return sure
        held = unsure.select("cell", F.explode("ids").alias("id")).join(self.whole, "id").groupBy("cell").agg(F.collect_list(F.struct("id", "whole")).alias("held"))
        return unsure.join(held, "cell").select("ids", "x", "y", "held").mapInArrow(trimmed(verify), "id long, other long").unionByName(sure)

    def settle(self, cells: DataFrame, labels: DataFrame | None) -> DataFrame | None:
        """``labels`` (node, component; None: no link yet) after the links among ``cells``."""
        return labels if cells.isEmpty() else _joined(labels, self.links(cells))


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` after ``links`` (id, other) as well."""
    known = None if labels is None else labels.select(F.col("node").alias("id"), F.col("component").alias("other"))
    return components(links if known is None else known.unionByName(links), "id", "other")


def _apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Those of ``pairs`` whose sets are of two components."""
    if labels is None:
        return pairs
    named = pairs.join(labels.select(F.col("node").alias("id"), F.col("component").alias("a")), "id", "left").join(labels.select(F.col("node").alias("other"), F.col("component").alias("b")), "other", "left")
    return named.where(F.coalesce("a", "id") != F.coalesce("b", "other")).select(*pairs.columns)


def _crowded(members: DataFrame) -> DataFrame:
    """``members`` (id, size, key) of the buckets of two members or more, with the count ``n``; written."""
    crowded = members.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1")
    return materialise(members.join(crowded, "key"), "members")


def _stars(members: DataFrame, percent: int) -> DataFrame:
    """(id, other): each member of a bucket and the bucket's most central one, whose buckets are the fullest."""
    central = members.groupBy("id").agg(F.sum("n").alias("shared"))
    leaders = members.join(central, "id").groupBy("key").agg(F.max_by(F.struct("id", "size"), F.struct("shared", -F.col("id"))).alias("leader"))
    stars = members.join(leaders, "key").where(F.col("id") != F.col("leader.id")).where(100 * F.least("size", F.col("leader.size")) >= percent * F.greatest("size", F.col("leader.size")))
    return stars.select(F.greatest("id", F.col("leader.id")).alias("id"), F.least("id", F.col("leader.id")).alias("other")).distinct()


def _chance_stars(mixed: DataFrame, percent: int) -> DataFrame:
    """(id, other): each member of a mixed bucket and one that the bucket's key draws, of another component. A set
    meets as many of them as it has buckets, so a group of near copies that have no centre becomes one component."""
    drawn = mixed.groupBy("key").agg(F.max_by(F.struct("id", "size", "component"), F.xxhash64("key", "id")).alias("leader"))
    stars = mixed.join(drawn, "key").where(F.col("component") != F.col("leader.component")).where(100 * F.least("size", F.col("leader.size")) >= percent * F.greatest("size", F.col("leader.size")))
    return stars.select("id", F.col("leader.id").alias("other")).distinct()


def _mixed(members: DataFrame, labels: DataFrame | None, sets: DataFrame, *content: str) -> DataFrame:
    """(key, n, id, size, component, ``content``) of the buckets whose members are not yet of one component."""
    told = members.select("key", "n", "id", "size", F.col("id").alias("component"))
    if labels is not None:
        told = members.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "n", "id", "size", F.coalesce("component", "id").alias("component"))
    mixed = told.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a != b").select("key")
    told = told.join(mixed, "key")
    return materialise(told, "mixed").join(sets.select("id", *content), "id") if content else told


def _blocks(mixed: DataFrame, all_pairs: bool, block: int, *content: str) -> DataFrame:
    """(key, i, j, rows, n): buckets of more than ``block`` members are cut into blocks by id hash. With ``all_pairs`` each
    two blocks meet in a row; without, a block is by itself."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    rest = mixed.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("id"), blocks).cast("int")})
    one = rest.withColumns({"i": F.col("own"), "j": F.col("own")})
    if all_pairs:
        several = rest.where("blocks > 1").withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        several = several.withColumns({"i": F.least("own", "peer"), "j": F.greatest("own", "peer")})
        one = one.where("blocks = 1").unionByName(several.drop("peer"))
    return one.groupBy("key", "i", "j").agg(F.first("n").alias("n"), F.collect_list(F.struct("own", "id", "component", "size", *content)).alias("rows")).where(F.size("rows") > 1).select("key", "i", "j", "rows", "n")


def _exact_links(mixed: DataFrame, percent: int) -> DataFrame:
    """The similar pairs among the members of a bucket, whose sets came whole, that no link joins yet."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[np.ndarray] = []
            for i, j, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                flat = rows.values
                own, ids, comp, size = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                a, b = np.triu_indices(len(ids), 1)
                want = (comp[a] != comp[b]) & sizes_fit(size[a], size[b], percent)
                if i != j:
                    want &= own[a] != own[b]
                a, b = a[want], b[want]
                if len(a):
                    shingle = np.unique(np.frombuffer(b"".join(flat.field(4).to_pylist()), np.uint64), return_inverse=True)[1]
                    holds = np.zeros((len(ids), int(shingle.max()) + 1), np.float32)
                    holds[np.repeat(np.arange(len(ids)), size), shingle] = 1
                    common = (holds @ holds.T)[a, b].astype(np.int64)
                    good = 100 * common >= percent * (size[a] + size[b] - common)
                    found.append(ids[np.stack([a[good], b[good]])])
            if found:
                x, y = np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y), pa.int64()), pa.array(np.minimum(x, y), pa.int64())], ["id", "other"])

    return _blocks(mixed, True, EXACT_BLOCK, "small").mapInArrow(trimmed(compare), "id long, other long")


def _pairs_in_blocks(mixed: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    return _listed(_cells_in_blocks(mixed, percent, all_pairs))


def _cells_in_blocks(mixed: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """``CELLS`` with the pairs of a bucket's members that no link joins yet and whose sizes and registers allow one. Without
    ``all_pairs``, the blocks of a bucket of several are by themselves, and each member names only its likeliest
    partner there. A pair is told by the first alone of the buckets where all pairs meet, if it has such; and of the
    sure links of a block those that join two trees, with the others between unlike trees."""
    whole = F.lit(True) if all_pairs else F.col("n") <= BLOCK
    met = mixed.where(whole).groupBy("id").agg(F.collect_list("key").alias("met")).where(F.size("met") > 1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list[tuple] = []
            for key, i, j, rows, n in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), batch.column(3), batch.column(4).to_pylist()):
                flat = rows.values
                own, ids, comp, size = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                a, b = np.triu_indices(len(ids), 1)
                want = (comp[a] != comp[b]) & sizes_fit(size[a], size[b], percent)
                if i != j:
                    want &= own[a] != own[b]
                a, b = a[want], b[want]
                if not len(a):
                    continue
                regs = _regs(flat.field(4))
                used = (regs != EMPTY).sum(1)
                close, rates = [], []
                for s in range(0, len(a), 16384):
                    x, y = a[s : s + 16384], b[s : s + 16384]
                    # Of registers that are hopeful as a whole, the first half has so many equal ones.
                    need = fewest_equal(np.maximum(used[x], used[y]), percent) - REGISTERS // 2
                    half = (regs[x, : REGISTERS // 2] == regs[y, : REGISTERS // 2]).sum(1) >= need
                    x, y = x[half], y[half]
                    good = hopeful(regs[x], regs[y], size[x], size[y], percent)
                    close.append(np.stack([x[good], y[good]]))
                    rates.append(estimate(regs[x[good]], regs[y[good]])[0])
                pair, rate = np.concatenate(close, axis=1), np.concatenate(rates)
                if not all_pairs and n > BLOCK and len(rate):
                    order = np.argsort(-rate, kind="stable")
                    pair, rate = pair[:, order], rate[order]
                    first = np.unique(np.concatenate([np.unique(pair[k], return_index=True)[1] for k in (0, 1)]))
                    pair, rate = pair[:, first], rate[first]
                first = key if all_pairs or n <= BLOCK else None
                lists = [set(x or [first]) for x in flat.field(6).to_pylist()] if len(rate) else []
                own = np.array([min((lists[x] & lists[y]) - {None}, default=None) == first for x, y in pair.T.tolist()], bool)
                pair, rate = pair[:, own], rate[own]
                order = np.argsort(-rate, kind="stable")
                pair, rate = pair[:, order], rate[order]
                keep, sure = _confirmed(*(flat.field(5).take(pa.array(pair[k])).to_pylist() for k in (0, 1)), percent)
                pair, rate, sure = pair[:, keep], rate[keep], sure[keep]
                node = np.unique(comp, return_inverse=True)[1]
                joins, tree = _forest(*node[pair[:, sure]], int(node.max()) + 1)
                keep = tree[node[pair[0]]] != tree[node[pair[1]]]
                keep[np.flatnonzero(sure)[joins]] = True
                pair, sure = pair[:, keep], sure[keep]
                part = np.zeros(len(ids), np.int64)
                unsure = np.unique(pair[:, ~sure])
                part[unsure] = np.cumsum(size[unsure].astype(np.int64)) // PART_SHINGLES
                groups = np.stack([sure, *np.where(sure, 0, np.sort(part[pair], axis=0))])
                for group in np.unique(groups, axis=1).T:
                    x, y = pair[:, (groups == group[:, None]).all(0)]
                    used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                    cell = np.full(1, key, np.int64).view(np.uint64)
                    for k in (i, j, *group.tolist()):
                        cell = mix64(cell + np.uint64(k))
                    cells.append((int(cell.view(np.int64)[0]), bool(group[0]), ids[used], at[: len(x)], at[len(x) :]))
            if cells:
                kinds = (pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*cells), kinds)], ["cell", "sure", "ids", "x", "y"])

    rows = mixed.join(met, "id", "left")
    return _blocks(rows, all_pairs, LAST_BLOCK if all_pairs else BLOCK, "regs", "small", "met").mapInArrow(trimmed(compare), CELLS)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of other characters than blanks, A-Z as a-z; rows whose sets of ``width``-word shingles have
    100 * intersection >= ``percent`` * union are linked, whatever their ids; component_id is the least id
    reachable. A null or empty text has no shingle and no link. Rows with equal sets are one class, so copies cost
    nothing. Rows that share an id are rows of their own. A row with a null id has links as any other and is never
    kept; a component without any id is told as null. An empty table gives no rows; other columns are not read.

    Sets meet in the buckets of their bands. First all of a bucket meet its most central member, the one whose
    bands are shared most: in a group of near copies that is what they were copied from. Then, where a bucket's
    members are still of several components, all pairs of a bucket of up to BLOCK members meet, and in larger
    buckets each member meets its likeliest partner of a block. The sets of larger buckets that are still mixed meet
    anew in the buckets of their rarest registers, where a passage that many texts share does not bring them together:
    first one that the bucket draws, then all pairs of those that are still of several components. A pair whose registers are hopeful shares one of its rarest registers for sure, so
    a pair that shares a band is verified, joined by other links, or not similar as far as its registers tell.
    Pairs with a SMALL set don't rest on bands: what no link joins yet meets in the buckets of its rarest shingles
    and is compared in full.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialise(signatures(texts, width, percent), "signatures")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n_shingles").cast("int").alias("size"), F.first("regs").alias("regs"), F.first("small").alias("small"))
    sets = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "sets")  # numbers of their own, settled by the writing
    judge = _Judge(texts, sets, width, percent)
    members = _crowded(_with_bands(sets))
    stars = materialise(_promising(_stars(members, percent), sets, percent), "likely")
    labels = judge.settle(_cells(_likeliest(stars)), None)
    mixed = _mixed(members.where("n > 2"), labels, sets, "regs", "small")
    more = _cells_in_blocks(mixed, percent, False).unionByName(_cells(_apart(stars, labels)))
    labels = judge.settle(materialise(more, "likely"), labels)
    hot = materialise(_mixed(members.where(f"n > {BLOCK}"), labels, sets).select("id").distinct(), "hot")
    if not hot.isEmpty():
        named = materialise(sets.join(hot, "id").select("id", "least", "digest", "size"), "hot")
        rare = _crowded(_with_rarest(rows, texts, named, width, percent))
        chance = materialise(_promising(_chance_stars(_mixed(rare, labels, sets), percent), sets, percent), "likely")
        labels = judge.settle(_cells(_likeliest(chance)), labels)
        labels = judge.settle(materialise(_cells_in_blocks(_mixed(rare, labels, sets, "regs", "small"), percent, True), "likely"), labels)
    exact = materialise(_exact_links(_mixed(_crowded(_with_prefixes(sets, percent)), labels, sets, "small"), percent), "exact")
    if not exact.isEmpty():
        labels = _joined(labels, exact)
    named = sets.select("digest", "id", "least").withColumn("component", F.col("id"))
    if labels is not None:
        named = sets.select("digest", "id", "least").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = materialise(named, "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    told = rows.select("doc_id", "n_shingles", "digest").join(named.join(least, "component").select("digest", "component_id"), "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return told.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
