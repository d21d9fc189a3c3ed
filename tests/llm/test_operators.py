"""The operators against brute force on small tables, and their edge cases."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import encoding, lm_scoring, minhash, mixing, nearest, packing, sharding, token_counts, token_output, toxicity, vector_dedup, words
from textloom.llm.common import shared_dir

SCHEMA = "doc_id long, text string, source string, size int, shard string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ODD = [(1, "a b  c\n\n d", "s", 1, "x"), (1, "a b  c\n\n d", "s", 1, "x"), (2, None, None, 2, "y"), (3, "", "t", 3, "z"), (None, "a b c d e f", "t", 4, "z"), (5, LONG, "s", 5, "q"), (6, "<|endoftext|> x 😀  y", None, 6, "q"), (7, "A B c d", "u", 7, "r")]
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encoding.vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_segments_encode_as_whole_texts_do(library, monkeypatch):
    rng = np.random.default_rng(3)
    parts = [" ", "  ", "\n", " \n", "\n ", "a", "Bc", "'s", "'", "12", "é", "。", "日本", "\x1c", "\x85", "<|endoftext|>", "!", "..", "\t", "😀", "²", "क्", ",", "word,", " ?"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.integers(0, 12))) for _ in range(4000)]
    texts += [" ".join(f"w{j}" * 3 for j in range(400)), "x" * 5000, "y " * 3000 + "z", "\U0001fae8 new"]
    for most in (encoding.PART, 200):  # long texts, a part at a time
        monkeypatch.setattr(encoding, "PART", most)
        ids, counts = encoding.TextEncoder(encoding.vocabulary()).encode_batch(pa.array([*texts, None]))
        assert np.split(ids, np.cumsum(counts))[-1].size == 0 and counts[-1] == 0
        for text, own in zip(texts, np.split(ids, np.cumsum(counts))):
            assert own.tolist() == ids_of(library, text), text


def test_what_an_encoder_remembers_is_bounded(library, monkeypatch):
    monkeypatch.setattr(encoding, "REMEMBERED", 50)
    encode = encoding.TextEncoder(encoding.vocabulary())
    for k in range(5):
        text = " ".join(f"w{i % 90}" for i in range(40 * k, 40 * k + 120))
        assert encode.encode(text).tolist() == ids_of(library, text) and len(encode.words) <= 50


def test_token_counts(odd, none, library):
    got = sorted(map(tuple, token_counts.count_tokens(odd).collect()), key=str)
    want = sorted(((d, len((t or "").encode()), len(ids_of(library, t)), len(ids_of(library, t)) > 512) for d, t, *_ in ODD), key=str)
    assert got == want
    assert token_counts.count_tokens(none).count() == 0


def test_sharding(spark, odd, none):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("text"))
    rows = sharding.assign_shards(docs, 8).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) < 1.3 * min(sizes.values())
    assert all(r["grown_shard"] in (8, r["shard"]) for r in rows) and any(r["grown_shard"] == 8 for r in rows)
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    heavy = Counter(r["shard"] for r in sharding.assign_shards(docs, 8, {0: 4.0}).collect())
    assert heavy[0] > 2.5 * heavy[5]
    moved = [(a["shard"], b["shard"]) for a, b in zip(sorted(rows, key=lambda r: r["doc_id"]), sorted(sharding.assign_shards(docs, 8, {0: 4.0}).collect(), key=lambda r: r["doc_id"])) if a["shard"] != b["shard"]]
    assert all(b in (0, 1, 2, 3) for _, b in moved)  # a weight's change moves rows into its own region only
    # Sizes and checksums by a loop; rows that repeat have a place each, whatever their number.
    many = spark.createDataFrame([(d, t) for d, t, *_ in ODD for _ in range(40 if d == 1 else 1)], "doc_id long, text string")
    got = sharding.assign_shards(many, 3).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in ODD for _ in range(40 if d == 1 else 1))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want and {r["law"] for r in got} == {"key"}
    for s in range(3):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    got = sharding.assign_shards(odd, 3).collect()
    assert len(got) == len(ODD) and {r["size"] for r in got if r["doc_id"] in (2, 3)} == {1}
    assert len({r["shard"] for r in got if r["doc_id"] == 1}) == 1 and sharding.assign_shards(none, 3).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), set(sizes), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def test_mixing(spark, odd, none):
    rng = np.random.default_rng(8)
    docs = [(i, "w " * int(rng.integers(1, 60)), str(rng.choice(["a", "b", "c", "d", "tiny"], p=[0.5, 0.3, 0.1, 0.09, 0.01]))) for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(frame).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(frame.repartition(3)).collect()))
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(BLANKS.findall(text))
    want, taken = brute_targets(sizes), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9) and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert math.isclose(sum(want.values()), sum(sizes.values()), rel_tol=1e-9) and all(abs(taken[s] - want[s]) <= 130 for s in want)
    got = {(r["doc_id"], r["source"]): r for r in mixing.mix(odd).collect()}
    assert got[2, None]["taken"] == 0 and got[5, "s"]["size"] == 30_000
    assert mixing.mix(none).count() == 0


def brute_components(sets):
    link = {i: i for i in sets}

    def find(x):
        while link[x] != x:
            x = link[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                link[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def word_sets(rows, width):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    return out


def test_minhash(spark, odd, none):
    rng = np.random.default_rng(5)
    base = [[f"w{x}" for x in rng.integers(0, 4000, rng.integers(3, 220))] for _ in range(120)]
    texts = [" ".join(b) for b in base]
    for b in base[:40]:
        for _ in range(4):
            c = list(b)
            for k in rng.integers(0, len(c), rng.integers(0, 1 + len(c) // 12)):
                c[k] = f"e{rng.integers(9999)}"
            texts.append(" ".join(c))
    texts += [" ".join([*base[7][:60], *map(str, rng.integers(0, 9999, 20))]) for _ in range(150)]  # a passage in many
    hot = [f"h{i}" for i in range(150)]
    for _ in range(300):  # a large group of near copies without its original
        c = list(hot)
        for k in rng.integers(0, 150, 5):
            c[k] = f"x{rng.integers(9999)}"
        texts.append(" ".join(c))
    texts += [texts[0]] * 50 + ["", "a", "A", "a b"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    sets = word_sets(rows, 4)
    want = brute_components(sets)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())
    told = minhash.near_duplicates(odd).collect()
    assert len(told) == len(ODD) and [r["kept"] for r in told if r["doc_id"] == 3] == [True] and [r["component_id"] for r in told if r["doc_id"] is None] == [None]
    assert minhash.near_duplicates(none).count() == 0


def test_minhash_on_repeated_ids(spark):
    """Rows are told apart by their texts: an id's other text inherits nothing. A row without an id links others."""
    text = lambda mark, n, more="": " ".join(f"{mark}{i}" for i in range(n)) + more
    rows = [(1, text("a", 300)), (2, text("a", 300, " x")), (2, text("b", 300)), (2, text("b", 300)), (3, text("b", 300, " y")), (None, text("c", 300)), (9, text("c", 290)), (8, text("c", 310)), (None, text("d", 50)), (None, text("d", 50, " z"))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    told = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in got)
    assert told == [(0, 47, 0, False), (0, 48, 0, False), (0, 297, 8, False), (1, 297, 1, True), (2, 297, 2, True), (2, 297, 2, True), (2, 298, 1, False), (3, 298, 2, False), (8, 307, 8, True), (9, 287, 8, False)]


def test_minhash_in_crowded_buckets(spark, monkeypatch):
    """Half of each text is one passage, so all bands of it are crowded; near copies are found among them, and no
    pair of blocks is needed for the others."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = np.random.default_rng(7)
    passage = " ".join(f"p{i}" for i in range(160))
    texts = [passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 100)) for _ in range(300)]
    copies = [t.rsplit(" ", 12)[0] + " " + " ".join(f"n{x}" for x in rng.integers(0, 1 << 40, 12)) for t in texts[:60]]
    rows = list(enumerate(texts + copies))
    met = []
    own = minhash._blocks
    monkeypatch.setattr(minhash, "_blocks", lambda mixed, all_pairs, *a: met.append((all_pairs, mixed.count())) or own(mixed, all_pairs, *a))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == brute_components(word_sets(rows, 4))
    assert sum(n for all_pairs, n in met if all_pairs) < 20 * len(rows)


def test_bands_use_every_register():
    assert set(minhash.MEMBERS.ravel()) == set(range(minhash.REGISTERS))
    assert all(len(set(x)) == minhash.BAND for x in minhash.MEMBERS.tolist())


def test_short_texts_need_no_band(spark, monkeypatch):
    """4 against 5 shingles and 48 against 60 are linked, 47 against 60 are not, with no band at all."""
    monkeypatch.setattr(minhash, "_with_bands", lambda sets: sets.select("id", "size", F.lit(0).cast("long").alias("key")).where("false"))
    text = lambda mark, n: " ".join(f"{mark}{i}" for i in range(n + 3))  # n shingles
    rows = [(1, text("a", 4)), (2, text("a", 5)), (3, text("b", 48)), (4, text("b", 60)), (5, text("c", 47)), (6, text("c", 60)), (7, text("a", 4) + " " + text("d", 48))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 7}


def test_one_common_band_is_enough(spark):
    """Long sets whose registers agree but for one of every other band than the first."""
    a = np.random.default_rng(6).integers(0, 60_000, minhash.REGISTERS).astype(np.uint16)
    b = a.copy()
    b[np.setdiff1d(minhash.MEMBERS[1:, 0], minhash.MEMBERS[0])] ^= 1
    keys = minhash.band_keys(np.stack([a, b]))
    key, common = int(keys[0, 0]), (keys[0] == keys[1]).sum()
    rows = [(key, 3, i, 400, i, bytearray(x.tobytes()), None) for i, x in ((1, a), (2, b))]
    mixed = spark.createDataFrame(rows, "key long, n int, id long, size int, component long, regs binary, small binary")
    assert common == 1 and [tuple(r)[:2] for r in minhash._pairs_in_blocks(mixed, 80, True).collect()] == [(2, 1)]


def test_a_pair_of_many_buckets_is_told_once(spark, monkeypatch):
    """Ten unlike sets of equal registers that meet in thirty buckets make 45 pairs, not 1,350; of short similar sets
    only the links of a tree are told."""
    regs = np.random.default_rng(6).integers(0, 60_000, minhash.REGISTERS).astype(np.uint16).tobytes()
    kind = "key long, n int, id long, size int, component long, regs binary, small binary"
    rows = [(key, 10, i, 400, i, bytearray(regs), None) for key in range(30) for i in range(10)]
    for all_pairs in (True, False):
        for name in ("distinct", "dropDuplicates"):  # what the blocks themselves tell
            monkeypatch.setattr(type(spark.range(0)), name, lambda frame, *a: frame)
        told = minhash._pairs_in_blocks(spark.createDataFrame(rows, kind), 80, all_pairs).count()
        monkeypatch.undo()
        assert told == 45
    whole = bytearray(np.arange(40, dtype=np.uint64).tobytes())
    mixed = spark.createDataFrame([(key, 10, i, 40, i, bytearray(regs), whole) for key in range(30) for i in range(10)], kind)
    assert minhash._pairs_in_blocks(mixed, 80, True).count() == 9


def test_pairs_are_confirmed_by_cells(spark):
    """A set comes once to a cell, and only links that join two trees are told; pairs that aren't similar give none."""
    sets = [np.arange(100 * (i // 10) + i % 10, 100 * (i // 10) + i % 10 + 90, dtype=np.uint64) for i in range(20)]
    x, y = np.triu_indices(20, 1)
    found = minhash._similar_forest(sets, x, y, 80)
    assert found.sum() == 18 and all(minhash.similar(sets[a], sets[b], 80) for a, b in zip(x[found], y[found]))
    judge = minhash._Judge(None, None, 4, 80)
    judge.fetch = lambda pairs: None
    judge.whole = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, whole binary")
    links = judge.links(spark.createDataFrame([(7, False, list(range(20)), x.tolist(), y.tolist())], minhash.CELLS))
    assert links.count() == 18
    assert {r["component"] for r in minhash.components(links, "id", "other").collect()} == {0, 10}


def test_similar_pairs_share_a_rare_shingle(spark):
    """Whatever the counts: two texts at similarity 0.8 or more have one of their rarest shingles in common, and texts
    that share but a passage meet nowhere."""
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(100)]
    texts = [passage + [f"w{x}" for x in rng.integers(0, 1 << 40, 60)] for _ in range(60)]
    texts += [t[:-6] + [f"n{x}" for x in rng.integers(0, 1 << 40, 6)] for t in texts[:20]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    rows = minhash.materialise(minhash.signatures(docs, 4, 80), "test")
    hot = rows.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("least"), "digest", F.col("n_shingles").cast("int").alias("size"))
    keys: dict[int, set] = {}
    for r in minhash._with_rarest(rows, docs, hot, 4, 80).collect():
        keys.setdefault(r["id"], set()).add(r["key"])
    sets = word_sets(list(docs.toLocalIterator()), 4)
    for i in range(80):
        for j in range(i):
            near = 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
            assert bool(keys[i] & keys[j]) == near, (i, j)


def test_registers_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    a, b = np.sort(pool[:2500]), np.sort(pool[500:])
    rate, _ = minhash.estimate(minhash.registers([a]), minhash.registers([b]))
    assert abs(rate[0] - 2000 / 3000) < 0.12
    assert minhash.similar(a, a, 80) and not minhash.similar(a, b, 80) and not minhash.similar(a[:0], a[:0], 80)


def test_words_hash_by_content():
    x, y = words.words_of([b"Hello  World\thello", b"", b"x" * (words.PART + 5) + b" world"][:3])[::2]
    assert x[0] == x[2] and x[1] == y[1] and len(y) == 2


def test_toxicity(spark, none):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(900):
        text = [f"v{x}" for x in rng.integers(0, 300, 60)]
        toxic = i % 6 == 0
        if toxic:
            for k in rng.integers(0, 60, 4):
                text[k] = str(rng.choice(["vile", "nasty", "scummy"]))
        rows.append((i, " ".join(text)))
        if i % 2 == 0:
            labels.append((i, int(i % 7 != 0), int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, marks).collect()}
    wrong = sum(got[i]["rejected"] != (i % 6 == 0) for i in range(1, 900, 2))  # those without a label
    assert wrong <= 4 and all(0 <= r["p_severe"] <= 1 for r in got.values())
    # Repeated ids and very long texts: of an id's texts the least is fitted on, within the sample's bytes.
    twice = spark.createDataFrame([(0, "vile " * 40_000), (0, "nasty"), (0, "nasty"), (2, None), (4, "b " * 40_000)], "doc_id long, text string")
    frame = toxicity.labelled_sample(twice, marks, "doc_id", "text", 10_000, 1000).toPandas().sort_values("id")
    assert [(i, t) for i, t in zip(frame["id"], frame["text"])][0] == (0, "nasty") and frame["id"].tolist() == [0, 2]
    told = toxicity.score(twice, toxicity.fit(docs, marks)[0]).collect()
    assert len(told) == 5 and [r["rejected"] for r in told if r["text"] and r["text"].startswith("vile")] == [True]
    # Features of a fold are chosen without its labels: with labels by chance, out-of-fold probabilities tell nothing.
    chance = spark.createDataFrame([(i, 1, int(x)) for i, x in enumerate(rng.integers(0, 2, 900))], "doc_id long, quality int, toxic int")
    _, held, frame = toxicity.fit(docs, chance)
    toxic = frame["toxic"].to_numpy() == 1
    assert abs((held[:, 1][toxic][:, None] > held[:, 1][~toxic][None]).mean() - 0.5) < 0.08
    edge = spark.createDataFrame([(None, None), (1, ""), (1, "vile " * 50)], "doc_id long, text string")
    assert toxicity.toxicity(edge, marks.where("false")).where("rejected").count() == 0
    assert toxicity.toxicity(none, marks).count() == 0


def test_packing(spark, odd, none, library):
    got = packing.pack(odd).collect()
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    want = Counter()
    for d, t, *_ in ODD:
        ids = np.array([*ids_of(library, t), 0], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), packing.CAPACITY)):
            want[d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert packing.pack(none).count() == 0


def test_packing_is_tight():
    rng = np.random.default_rng(4)
    lengths = np.minimum(rng.lognormal(5.5, 1.2, 20_000).astype(int) + 1, 2047)
    at, fills = packing.best_fit(lengths, 2048)
    assert (np.bincount(at, lengths) == fills).all() and fills.max() <= 2048
    assert len(fills) <= 1.01 * lengths.sum() / 2048 + 1
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(2048, 2048) == [(0, 2048)]


def test_counts_pack_as_items_do():
    rng = np.random.default_rng(2)
    for top in (3, 40, 199):
        lengths = rng.integers(1, top + 1, 3000)
        counts = np.bincount(lengths, minlength=200)
        _, fills = packing.best_fit(lengths, 200)
        bins, at = Counter(), {}
        for n, first, b, each, offset in packing.fit_counts(counts, 200).tolist():
            at.setdefault(n, []).append((first, b, each, offset))
        for n, runs in sorted(at.items(), reverse=True):
            for (first, b, each, offset), stop in zip(runs, [*[r[0] for r in runs[1:]], counts[n]]):
                for k in range(stop - first):
                    assert bins[b + k // each] == offset + k % each * n
                    bins[b + k // each] += n
        assert sorted(bins.values()) == sorted(fills.tolist())
    assert len(packing.fit_counts(np.zeros(200, np.int64), 200)) == 0


def test_unlike_partitions_pack_together(spark):
    """Pieces of 1100 in one partition, of 900 in the other: a bin holds one of each."""
    n = 500
    lengths = F.when(F.col("id") < n, 1100).otherwise(900).cast("long")
    rows = spark.range(0, 2 * n, 1, 2).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), lengths.alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    got = packing.pack_pieces(rows).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(2 * n))
    taken: dict[int, list] = {}
    for r in got:
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(taken) == n and all(sorted(x) == [(0, 1100), (1100, 900)] for x in taken.values())


def test_partitions_by_length_pack_as_one(spark):
    """Pieces sorted by length over 8 partitions need hardly more sequences than best fit over all of them."""
    rng = np.random.default_rng(1)
    for lengths in (np.repeat([1500, 500], 1000), np.sort(rng.integers(1, 2048, 4000))):
        rows = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES).repartitionByRange(8, "doc_id")
        used = packing.pack_pieces(rows).select("sequence_id").distinct().count()
        assert used <= 1.01 * len(packing.best_fit(lengths, 2048)[1])


def test_token_output(spark, odd, none, library):
    rows = [r for r in ODD if r[0] is not None]
    got = sorted(map(tuple, token_output.round_trip(odd.where("doc_id is not null")).collect()))
    start, want = 0, []
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*ids_of(library, t), 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == sorted(want)
    assert token_output.round_trip(none).count() == 0
    out = shared_dir(spark, "test")
    token_output.write_tokens(odd, out)
    segment = token_output.Segment(bytes(spark.read.parquet(out).orderBy(F.desc("n_ids")).first()["payload"]))
    whole = segment.ids()
    for a, b in ((0, 1), (5, 900), (12_345, 12_399), (len(whole) - 3, len(whole))):
        assert (segment.range(a, b) == whole[a:b]).all()
    assert len(segment.symbols) < len(whole) / 3


def test_grammars_expand_to_what_they_were():
    rng = np.random.default_rng(6)
    words = [rng.integers(0, 300, rng.integers(2, 9)) for _ in range(200)]
    for ids in (np.zeros(1000, "<u4"), rng.integers(0, 5, 5000).astype("<u4"), rng.integers(0, 50_000, 3000).astype("<u4"), np.tile(np.arange(7, dtype="<u4"), 400), np.zeros(0, "<u4"), np.concatenate([words[i] for i in rng.integers(0, 200, 4000)]).astype("<u4")):
        segment = token_output.Segment(token_output.write_segment(ids, [len(ids)]))
        assert (segment.ids() == ids).all()
        # No pair that does not overlap itself is left so often that it would pay.
        left = Counter(zip(segment.symbols[:-1].tolist(), segment.symbols[1:].tolist()))
        assert all(n < token_output.LEAST for (a, b), n in left.items() if a != b)
        assert all(segment.length[k] == len(segment.expand(np.array([segment.terminals + k]))) for k in range(len(segment.length)))


def test_pairs_are_counted_exactly(monkeypatch):
    monkeypatch.setattr(token_output, "TABLE_BITS", 4)
    pairs = np.random.default_rng(1).integers(0, 60, 2000)
    distinct, count, which = token_output._counted(pairs)
    assert (distinct[which] == pairs).all() and dict(zip(distinct.tolist(), count.tolist())) == Counter(pairs.tolist())


def test_language_model(spark, odd, none):
    rng = np.random.default_rng(9)
    follow = {f"w{i}": [f"w{(i * 7 + k) % 60}" for k in range(3)] for i in range(60)}
    rows = []
    for d in range(400):
        w = ["w0"]
        for _ in range(80):
            w.append(str(rng.choice(follow[w[-1]])))
        rows.append((d, " ".join([*w, f"rare{d}"])))
    got = {r["doc_id"]: r for r in lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    tokens = {d: [*t.lower().split(), "\n"] for d, t in rows}
    counts = Counter(w for d, t in tokens.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in t)
    total, distinct = sum(counts.values()), len(counts)
    for d, t in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        assert math.isclose(got[d]["base_score"], base, rel_tol=1e-9) and got[d]["n_known"] == sum(counts[w] > 0 for w in t)
        assert got[d]["train_tokens"] == total and got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 1)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 20 * len(held)  # it has learnt the order
    assert got[0]["train_tokens"] < lm_scoring.LEAST_LEARNT
    told = lm_scoring.score_texts(odd).collect()
    assert len(told) == len(ODD) and all(math.isfinite(r["score"]) for r in told)
    assert lm_scoring.score_texts(none).count() == 0


def test_tails_in_sql_are_those_of_the_workers(spark):
    words_ = ["a", "ab", "xyz", "é", "naïve", "日", "中文", "x\U0001f600\U0001f600", "ß", "éa", "\x00"]
    told = spark.createDataFrame([(w,) for w in words_], "word string").selectExpr("word", f"{lm_scoring.TAIL} as k").collect()
    assert {r["word"]: r["k"] for r in told} == dict(zip(words_, lm_scoring.tails(pa.array(words_)).tolist()))


def test_scores_of_words_beyond_ascii(spark):
    rng = np.random.default_rng(2)
    letters = list("éßΩ中文日本語ж😀")
    rows = [(d, " ".join("".join(rng.choice(letters, 3)) for _ in range(40))) for d in range(80)]
    told = lm_scoring.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(told) == 80 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in told)
    held = [r for r in told if r["held_out"]]
    assert held and sum(r["score"] - r["base_score"] for r in held) > -0.1 * sum(r["n_tokens"] for r in held)


def test_scores_of_few_texts(spark):
    """A model of few tokens stays near their counts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for most in (20, 60):
        held = [r for r in lm_scoring.score_texts(docs.orderBy("doc_id").limit(most)).collect() if r["held_out"]]
        assert held and sum(r["score"] - r["base_score"] for r in held) > -0.1 * sum(r["n_tokens"] for r in held)


def vocabulary_of(texts):
    counts = Counter(w for t in texts for w in [*t.split(), "\n"])
    table = pa.table({"word": list(counts), "c": list(counts.values())}).sort_by([("c", "descending"), ("word", "ascending")])
    in_tail = np.zeros((lm_scoring.TAILS, 2))
    for word, c in counts.items():
        if word != "\n":
            in_tail[lm_scoring.tails(pa.array([word]))[0]] += (c, 1)
    return lm_scoring.Vocabulary(table, sum(counts.values()), len(counts), in_tail), counts


def test_model_is_normalised():
    v, _ = vocabulary_of([" ".join(f"w{i % k}" for i in range(k * 9)) for k in (5, 30, 70)])
    rng = np.random.default_rng(0)
    p = {k: x + rng.normal(0, 0.3, x.shape).astype(np.float32) * (x > -1e8) for k, x in lm_scoring.start(v).items()}
    for a, b in ((0, 1), (v.end, v.end), (v.n - 1, 3)):
        logs = lm_scoring.log_probabilities(v, p, np.full(v.n, a), np.full(v.n, b), np.arange(v.n))
        assert math.isclose((10.0**logs).sum(), 1, rel_tol=1e-5)


def test_scores_against_a_loop(spark, monkeypatch):
    """Word by word, from the same parameters: the model's symbol, and a tail's word by its share."""
    rng = np.random.default_rng(4)
    texts = {d: " ".join(f"w{int(x)}" for x in rng.zipf(1.6, 50) % 400) for d in range(60)} | {99: "", 98: "NEVER seen W1"}
    made = {}
    real = lm_scoring.train
    monkeypatch.setattr(lm_scoring, "HELD", 40)
    monkeypatch.setattr(lm_scoring, "train", lambda rows, v, known: made.setdefault("p", (v, real(rows, v, known)))[1])
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    v, p = made["p"]
    training = [t.lower() for d, t in texts.items() if zlib.crc32(str(d).encode()) % 5 != 1]
    counts = Counter(w for t in training for w in [*t.split(), "\n"])
    own = {w: int(v.symbol[i]) for i, w in enumerate(v.word.to_pylist())}
    tail_of = lambda w: int.from_bytes(w.encode()[-2:], "big") % lm_scoring.TAILS
    modelled = {w for w in own if not v.is_tail[own[w]]}
    for d, text in texts.items():
        total, before, last = 0.0, v.end, v.end
        for w in [*text.lower().split(), "\n"]:
            symbol = v.end if w == "\n" else own[w] if w in modelled else int(v.tail_symbol[tail_of(w)])
            context = p["before"][before] @ p["turn1"] + p["before"][last] @ p["turn2"]
            k, m = divmod(symbol, v.width)
            for logits, at in ((p["class"] @ context + p["class_bias"], k), (p["after"].reshape(v.classes, v.width, -1)[k] @ context + p["bias"].reshape(v.classes, -1)[k], m)):
                e = np.exp((logits - logits.max()).astype(float))
                total += math.log10(e[at] / e.sum())
            if w != "\n" and w not in modelled:
                members = [x for x in counts if x != "\n" and x not in modelled and tail_of(x) == tail_of(w)]
                total += math.log10((counts[w] + 0.5) / (sum(counts[x] for x in members) + 0.5 * (len(members) + 1)))
            before, last = last, symbol
        assert math.isclose(got[d], total, rel_tol=1e-4), d


def test_words_of_a_batch():
    texts = ["A b\x0bC\x1cd  e\t", None, "", "  ", "é É\x85x\n b"]
    distinct, code, text = lm_scoring.words(pa.array(texts))
    got = [[] for _ in texts]
    for c, t in zip(code.tolist(), text.tolist()):
        got[t].append(distinct[c].as_py())
    lower = lambda w: "".join(c.lower() if c.isascii() else c for c in w)
    assert got == [[lower(w) for w in BLANKS.findall(t or "")] for t in texts]
    v, _ = vocabulary_of(["a b", "", "c"])
    first, last, line = v.lines(3, np.array([0, 0, 2]), np.array([5, 6, 7]))
    e = v.end
    assert line.tolist() == [5, 6, e, e, 7, e] and last.tolist() == [e, 5, 6, e, e, 7] and first.tolist() == [e, e, 5, e, e, e]


def test_parameters_are_averaged_by_tokens(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "FAN_IN", 2)
    parts = [(k, piece, float(k + 1), bytearray((np.full(3, 10.0 * k + piece, np.float32) * (k + 1)).tobytes())) for k in range(5) for piece in range(2)]
    like = {"a": np.zeros(2, np.float32), "b": np.zeros((2, 2), np.float32)}
    flat = lm_scoring._average(spark.createDataFrame(parts, lm_scoring.AVERAGED), like)
    mean = sum(10.0 * k * (k + 1) for k in range(5)) / 15
    assert np.allclose(flat, [mean] * 3 + [mean + 1] * 3)


VECTORS = "vec_id long, embedding array<float>, label int"
BAD = [(10_001, None, 1), (10_002, [], 1), (10_003, [0.0] * 16, 1), (10_004, [float("nan")] * 16, 1), (10_005, [1.0, None] + [1.0] * 14, 1), (10_006, [float("inf")] * 16, 1), (None, [1.0] * 16, 1), (10_007, [1.0] * 4, 1)]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[300:420] = x[300] + 0.05 * rng.standard_normal((120, 16))  # a cluster
    x[500:540] = x[500]  # copies
    return x, rng.integers(0, 3, 1500)


def test_nearest(spark, vectors):
    x, _ = vectors
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + BAD
    got = nearest.nearest(spark.createDataFrame(rows, VECTORS), F.col("id") % 50 == 0, k=10).collect()
    hit, by = 0, {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 1500, 50))  # 10_007's width has no other vector, and it is no query
    wide = x.astype(float)
    for q, found in by.items():
        d = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 11)) and all(math.isclose(r["score"], d[r["vec_id"]], rel_tol=1e-12) for r in found)
        hit += len({r["vec_id"] for r in found} & set(best.tolist()))
    assert hit >= 0.95 * 10 * len(by)
    # Rows that repeat a query, or share its id, are queries and candidates of their own.
    again = [(i, v.tolist(), 0) for i, v in enumerate(x[:40])] + [(0, x[0].tolist(), 0), (20, x[0].tolist(), 0), (0, x[7].tolist(), 0)]
    same = nearest.nearest(spark.createDataFrame(again, VECTORS), F.col("id") == 0).orderBy("rank", "vec_id").collect()
    assert len(same) == 30 and sorted((r["vec_id"], r["score"]) for r in same if r["rank"] == 1) == [(0, 0.0), (0, 0.0), (7, 0.0)]
    assert sorted((r["vec_id"], r["score"]) for r in same if r["rank"] == 2)[:2] == [(20, 0.0)] * 2
    few = nearest.nearest(spark.createDataFrame(rows[:4], VECTORS), F.col("id") == 0).collect()
    assert len(few) == 3
    assert nearest.nearest(spark.createDataFrame([], VECTORS), F.col("id") == 0).count() == 0
    assert abs(float(nearest.chi_square(nearest._STOP)) - nearest.CONFIDENCE) < 1e-9


def test_nearest_in_many_cells_and_blocks(spark, monkeypatch):
    """Recall over 64 cells and several blocks of queries, in clusters and in uniform vectors; one vector is in a
    third of all rows."""
    for name, most in (("LEAST_CELL", 64), ("MOST_CELL", 64), ("QUERY_BLOCK", 7), ("LEAF", 16)):
        monkeypatch.setattr(nearest, name, most)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 24))
    x = np.concatenate([centres[rng.integers(0, 40, 2000)] + 0.2 * rng.standard_normal((2000, 24)), rng.standard_normal((700, 24)), np.repeat(centres[:1], 1300, axis=0)])
    x = x[rng.permutation(len(x))]
    got = nearest.nearest(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"), F.col("id") % 40 == 0).collect()
    hit, by = 0.0, {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert len(by) == 100 and all(len(v) == 10 for v in by.values())
    for q, found in by.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len(set(np.lexsort((np.arange(len(d)), d))[:10].tolist()) & {i for _, i in found})
    assert hit >= 0.95 * 1000


def test_vector_dedup_on_repeated_ids(spark, vectors):
    """An id's rows of other labels and vectors are rows of their own."""
    x, _ = vectors
    a, b, c = (x[i].tolist() for i in (0, 1, 2))
    rows = [(1, a, 0), (1, a, 1), (2, a, 0), (3, a, 0), (3, b, 0), (1, b, 0), (9, c, 1), (8, c, 1)]
    got = sorted(map(tuple, vector_dedup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()))
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (3, 2, 1, False), (8, 1, 8, True), (9, 1, 8, False)]


def test_vector_dedup_in_blocks(spark, monkeypatch):
    """Lists of several blocks, many pivots: every link of a dense cluster and nearly all at the threshold."""
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    monkeypatch.setattr(vector_dedup, "LEAST_PIVOTS", 256)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 32))
    x[:200] = x[0] + 0.1 * rng.standard_normal((200, 32))
    for i in range(200, 800, 2):  # cosine 0.93 to 0.95
        n = rng.standard_normal(32)
        n -= (n @ x[i]) / (x[i] @ x[i]) * x[i]
        k = rng.uniform(0.931, 0.95)
        x[i + 1] = k * x[i] + np.sqrt(1 - k * k) * n / np.linalg.norm(n) * np.linalg.norm(x[i])
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_vectors(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    want = near.sum(1)
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.99 * want.sum() and sum(got[i] for i in range(200, 800)) >= 0.97 * want[200:800].sum()


def test_vector_dedup(spark, vectors):
    x, label = vectors
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))]
    rows[7] = (7, rows[7][1], None)
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(spark.createDataFrame(rows + BAD, VECTORS)).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None])
    near[7] = near[:, 7] = False
    np.fill_diagonal(near, False)
    links = sum(r["n_links"] for i, r in got.items() if i is not None and i < 1500)
    assert links >= 0.97 * near.sum() and links <= near.sum()
    component = np.arange(1500)
    for _ in range(50):
        component = np.minimum(component, np.where(near, component[None], 9999).min(1))
    assert np.mean([got[i]["component_id"] == component[i] for i in range(1500)]) > 0.99
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(10_001, 10_007)) and got[7]["kept"] and not got[None]["kept"]
    assert vector_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
