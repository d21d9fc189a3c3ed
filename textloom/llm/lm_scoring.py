"""Language-model scores: a log-bilinear model trained in numpy with noise-contrastive estimation.

Symbols are the end of a text, up to MODELLED of the most frequent words, and TAILS tails, which hold all other words
by their last two bytes. A context is the two symbols before; its vector is the sum of their vectors, each turned by
a matrix of its place. Symbols stand in classes of like frequency: p(symbol | context) is p(class | context) times
p(symbol | class, context), both the softmax of products with the context's vector, so a batch takes a few matrix
products and no sum over the whole vocabulary. For a word of a tail, the word's smoothed share of the tail comes in,
where one unknown word stands for all that training did not meet. So the probabilities of all words sum to 1.

Training runs on the executors. In each round every task trains on its share of that round's texts, starting
from the same parameters, and the tasks' parameters are averaged by their tokens. The rounds part the training texts
among them, so each token is learnt from once, or several times where there are few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialise, prepare, trimmed

MODELLED, TAILS, DIMS = 8192, 251, 24
#: A word has a vector of its own if it is seen so often.
LEAST_SEEN = 5
#: The end of a text as a word: a blank can't be one.
END = "\n"
#: Words, the most frequent first, whose counts every worker holds (some 3 MB); those of the others come by a join.
HELD = 131_072
ROUNDS, NOISE, NOISE_IN_CLASS = 3, 32, 12
#: Tokens to learn from, at least: of fewer, each is seen several times, PASSES at most.
LEAST_LEARNT, PASSES = 3_000_000, 40
#: Where tokens are seen several times: the weight of a normal prior around the start, whose biases are the words'
#: counts, so a model of few tokens stays near them.
PRIOR = 16.0
BATCH, LEAST_BATCH, RATE = 8192, 512, 0.12
#: Tokens whose probabilities are computed at once.
SCORED_AT_ONCE = 1 << 15
#: Bytes of a part of the parameters, and tasks whose parts are averaged at once.
PART, FAN_IN = 1 << 18, 32
BLANKS = pa.scalar("")


def held_out(doc_id: Column) -> Column:
    """Of five parts of all ids, the one that training leaves out; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 1


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word in them, text of each word) of a batch, A-Z as a-z, without ends."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    coded = parts.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    edges = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(edges))
    empty = pc.index(coded.dictionary, BLANKS).as_py()  # before a text's first word and after its last one
    if empty >= 0:
        keep = code != empty
        code, text = code[keep], text[keep]
    return coded.dictionary, code, text


def tails(distinct: pa.Array) -> np.ndarray:
    """The tail of each word: its last two bytes as a number, by TAILS."""
    edges = np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1, 4 * distinct.offset).astype(np.int64)
    raw = np.frombuffer(distinct.buffers()[2], np.uint8) if len(distinct) and distinct.buffers()[2] else np.zeros(1, np.uint8)
    n = np.diff(edges)
    last, second = (np.where(n > k, raw[np.maximum(edges[1:] - 1 - k, 0)], 0).astype(np.int64) for k in (0, 1))
    return (last + 256 * second) % TAILS


#: ``tails`` in SQL. Not by right(), which takes the last two characters even of binary.
TAIL = f"cast(conv(hex(substring(cast(word as binary), -2, 2)), 16, 10) as long) % {TAILS}"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def count_words(rows: DataFrame) -> DataFrame:
    """(word, c) over the training texts, ends included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                distinct, code, _ = words(batch.column(0))
                n = np.bincount(code, minlength=len(distinct))
                seen = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([distinct.filter(seen), pa.array([END])]), pa.array(np.append(n[n > 0], batch.num_rows), pa.int64())], ["word", "c"])

    return rows.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(trimmed(count), "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What each worker needs of the counts: the HELD most frequent words with their counts, the symbols in order of
    their counts, their classes, and the totals of the tails."""

    def __init__(self, held: pa.Table, total: int, distinct: int, in_tail: np.ndarray):
        """``held``: (word, c), most frequent first; ``in_tail``: (words' counts, distinct words) of each tail."""
        self.total, self.distinct = total, distinct
        self.word = held["word"].combine_chunks().cast(pa.string()) if held.num_rows else pa.array([], pa.string())
        self.count = held["c"].to_numpy().astype(np.float64)
        own = (self.count >= LEAST_SEEN) & (np.arange(len(self.count)) < MODELLED)
        end = pc.index(self.word, pa.scalar(END)).as_py()
        tail = tails(self.word)
        if end >= 0:
            own[end] = True
        left = np.array(in_tail, np.float64)
        inside = own & (np.arange(len(own)) != end)  # words of their own are no members of their tail
        np.subtract.at(left, tail[inside], np.stack([self.count[inside], np.ones(inside.sum())], 1))
        self.tail_total = np.log10(left[:, 0] + 0.5 * (left[:, 1] + 1))
        self.base_total = math.log10(total + 0.5 * (distinct + 1))
        # Symbols: words of their own, the end (where training has none, too), tails; by falling count.
        mine = np.flatnonzero(own)
        counts = np.concatenate([self.count[mine], [] if end >= 0 else [0.0], left[:, 0]])
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.seen = counts[order] + 1.0
        self.n = len(order)
        self.tail_symbol = rank[len(rank) - TAILS :]
        self.end = int(rank[np.flatnonzero(mine == end)[0]] if end >= 0 else rank[len(mine)])
        self.symbol = self.tail_symbol[tail]
        self.symbol[mine] = rank[: len(mine)]
        self.is_tail = np.zeros(self.n, bool)
        self.is_tail[self.tail_symbol] = True
        self.width = math.isqrt(2 * self.n - 1) + 1  # symbols of a class
        self.classes = -(-self.n // self.width)
        # The laws of the noise: of the classes, and of the symbols in their classes; no draw falls on a place beyond
        # the symbols.
        full = np.zeros((self.classes, self.width))
        full.ravel()[: self.n] = self.seen
        self.class_law = full.sum(1) / full.sum()
        self.law = full / full.sum(1, keepdims=True)
        self.class_sums, self.sums = np.cumsum(self.class_law), (np.cumsum(self.law, axis=1) + np.arange(self.classes)[:, None]).ravel()
        self.class_expected = np.log(NOISE * self.class_law).astype(np.float32)
        self.expected = np.log(NOISE_IN_CLASS * self.law + 1e-30).ravel().astype(np.float32)

    def of(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number among the held words or -1, symbol, tail) of each distinct word."""
        number = pc.index_in(distinct, value_set=self.word).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        tail = tails(distinct)
        symbol = self.tail_symbol[tail]
        known = number >= 0
        symbol[known] = self.symbol[number[known]]
        return number, symbol, tail

    def lines(self, n: int, text: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(before the last, last, symbol) at each place of ``n`` texts, ends included; an end stands before each."""
        at = np.arange(len(text)) + text
        line = np.full(len(text) + n, self.end, np.int64)
        line[at] = symbol
        last = np.empty_like(line)
        last[1:], last[:1] = line[:-1], self.end
        first = np.empty_like(line)
        first[2:], first[:2] = line[:-2], self.end
        begins = np.concatenate([[0], np.flatnonzero(line[:-1] == self.end) + 1]) if len(line) else np.zeros(0, np.int64)
        first[begins] = self.end
        return first, last, line


Parameters = dict[str, np.ndarray]


def start(v: Vocabulary, seed: int = 7) -> Parameters:
    """Small random vectors; biases by the words' counts."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    bias = np.log(np.maximum(v.law, 1e-300))
    bias[v.law == 0] = -1e9
    return {"before": draw(v.n, DIMS), "turn1": np.eye(DIMS, dtype=np.float32), "turn2": np.eye(DIMS, dtype=np.float32), "class": draw(v.classes, DIMS), "class_bias": np.log(v.class_law).astype(np.float32), "after": draw(v.classes * v.width, DIMS), "bias": bias.ravel().astype(np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sum_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray, by_place: bool = False) -> None:
    """out[at] += rows, where places repeat; ``by_place``: they are in order."""
    if not by_place:
        order = np.argsort(at, kind="stable")
        at, rows = at[order], rows[order]
    begins = np.flatnonzero(np.diff(at, prepend=-1))
    out[at[begins]] += np.add.reduceat(rows, begins, axis=0)


def gradients(v: Vocabulary, p: Parameters, first: np.ndarray, last: np.ndarray, symbol: np.ndarray, rng: np.random.Generator) -> Parameters:
    """The gradient of the noise-contrastive objective, summed over the tokens: seen classes are told from draws of
    the classes' law, and seen symbols from draws of their class's law, which all its tokens share."""
    g = {k: np.zeros_like(x) for k, x in p.items()}
    order = np.argsort(symbol, kind="stable")
    first, last, symbol = first[order], last[order], symbol[order]
    group = symbol // v.width
    before, more = p["before"][first], p["before"][last]
    context = before @ p["turn1"] + more @ p["turn2"]
    back = np.zeros_like(context)  # the gradient by context
    for at, vectors, bias, expected in ((symbol, "after", "bias", v.expected), (group, "class", "class_bias", v.class_expected)):
        own = p[vectors][at]
        pull = _sigmoid(expected[at] - np.einsum("ij,ij->i", context, own) - p[bias][at])[:, None]
        back += pull * own
        _sum_rows(g[vectors], at, pull * context, by_place=True)
        g[bias] += np.bincount(at, pull[:, 0], len(g[bias])).astype(np.float32)
    noise = np.searchsorted(v.class_sums, rng.random(NOISE) * v.class_sums[-1] * (1 - 1e-12), "right")
    push = -_sigmoid(context @ p["class"][noise].T + (p["class_bias"] - v.class_expected)[noise])
    back += push @ p["class"][noise]
    np.add.at(g["class"], noise, push.T @ context)
    np.add.at(g["class_bias"], noise, push.sum(0))
    edges = np.searchsorted(group, np.arange(v.classes + 1))
    noise = np.searchsorted(v.sums, np.arange(v.classes)[:, None] + rng.random((v.classes, NOISE_IN_CLASS)) * (1 - 1e-9), "right")
    shift, others = (p["bias"] - v.expected)[noise], p["after"][noise]
    push_sums, push_rows = np.zeros(noise.shape, np.float32), np.zeros((*noise.shape, DIMS), np.float32)
    for k in np.flatnonzero(np.diff(edges)).tolist():
        rows = slice(edges[k], edges[k + 1])
        push = -_sigmoid(context[rows] @ others[k].T + shift[k])
        back[rows] += push @ others[k]
        push_rows[k], push_sums[k] = push.T @ context[rows], push.sum(0)
    _sum_rows(g["after"], noise.ravel(), push_rows.reshape(-1, DIMS))
    g["bias"] += np.bincount(noise.ravel(), push_sums.ravel(), len(g["bias"])).astype(np.float32)
    g["turn1"], g["turn2"] = before.T @ back, more.T @ back
    _sum_rows(g["before"], first, back @ p["turn1"].T)
    _sum_rows(g["before"], last, back @ p["turn2"].T)
    return g


class Trainer:
    """Adagrad over minibatches, from given parameters."""

    def __init__(self, v: Vocabulary, p: Parameters, seed: int, rate: float = RATE, hold: float = 0.0):
        """``hold``: the pull of each token back to the given parameters."""
        self.v, self.p, self.rng, self.rate = v, {k: x.copy() for k, x in p.items()}, np.random.default_rng(seed), rate
        self.given, self.hold = p, hold
        self.squares = {k: np.full_like(x, 1e-6) for k, x in p.items()}

    def learn(self, first: np.ndarray, last: np.ndarray, symbol: np.ndarray) -> None:
        g = gradients(self.v, self.p, first, last, symbol, self.rng)
        for k, x in g.items():
            if self.hold:
                x -= self.hold * len(symbol) * (self.p[k] - self.given[k])
            x /= len(symbol) ** 0.5
            self.squares[k] += x * x
            self.p[k] += self.rate * x / np.sqrt(self.squares[k])


def _flat(p: Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unflat(flat: np.ndarray, like: Parameters) -> Parameters:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def train(rows: DataFrame, v: Vocabulary, known) -> Parameters:
    """The averaged parameters after all rounds; see the module. ``known``: the broadcast vocabulary."""
    spark = rows.sparkSession
    p = start(v)
    if not v.total:
        return p
    rounds = ROUNDS if v.total >= LEAST_LEARNT else 1
    passes = max(1, min(PASSES, -(-LEAST_LEARNT // v.total)))
    texts = rows.where(~held_out(F.col("doc_id")))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(p)
        rate = RATE / (1 + turn)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, part = known.value, TaskContext.get().partitionId()
            trainer, tokens, kept = Trainer(own, shared.value, 1000 * turn + part, rate), 0, []
            for batch in batches:
                if not batch.num_rows:
                    continue
                distinct, code, text = words(batch.column(0))
                _, symbol, _ = own.of(distinct)
                line = own.lines(batch.num_rows, text, symbol[code])
                tokens += len(line[0])
                if passes > 1:  # a small corpus, of LEAST_LEARNT tokens at most
                    kept.append(line)
                else:
                    _one_pass(trainer, line)
            if kept:
                line = tuple(np.concatenate(x) for x in zip(*kept))
                trainer.hold = PRIOR / tokens
                for _ in range(passes):
                    _one_pass(trainer, line)
            if tokens:
                raw = (_flat(trainer.p) * np.float32(tokens)).tobytes()
                pieces = [raw[i : i + PART] for i in range(0, len(raw), PART)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(pieces), pa.int64()), pa.array(range(len(pieces)), pa.int32()), pa.array([float(tokens)] * len(pieces)), pa.array(pieces, pa.binary())], ["part", "piece", "weight", "value"])

        mine = texts.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(rounds)) == turn) if rounds > 1 else texts
        p = _unflat(_average(mine.select("text").mapInArrow(trimmed(learn), AVERAGED), p), p)
        shared.unpersist()
    return p


def _one_pass(trainer: Trainer, line: tuple[np.ndarray, ...]) -> None:
    n = len(line[0])
    size = int(np.clip(n // 64, LEAST_BATCH, BATCH))
    order = trainer.rng.permutation(n)
    for s in range(0, n, size):
        trainer.learn(*(x[order[s : s + size]] for x in line))


AVERAGED = "part long, piece int, weight double, value binary"


def _average(made: DataFrame, like: Parameters) -> np.ndarray:
    """The weighted mean of all tasks' parameters, summed in a tree of FAN_IN, so no task holds them all."""

    def add(key, frame: pd.DataFrame) -> pd.DataFrame:
        value = np.sum([np.frombuffer(x, np.float32) for x in frame["value"]], axis=0, dtype=np.float32)
        return pd.DataFrame({"part": [key[0]], "piece": [key[1]], "weight": [frame["weight"].sum()], "value": [value.tobytes()]})

    made = materialise(made, "trained")
    top = made.agg(F.max("part")).first()[0]
    if top is None:
        return _flat(like)
    while top > 0:
        made = materialise(made.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part", "piece").applyInPandas(add, AVERAGED), "averaged")
        top //= FAN_IN
    rows = made.toArrow().sort_by("piece")  # the parameters once
    flat = np.frombuffer(b"".join(rows["value"].to_pylist()), np.float32)
    return flat / np.float32(rows["weight"][0].as_py())


def log_probabilities(v: Vocabulary, p: Parameters, first: np.ndarray, last: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """log10 p(symbol | context) at each place."""
    out = np.empty(len(symbol))
    turned = p["before"] @ p["turn1"], p["before"] @ p["turn2"]
    after, bias = p["after"].reshape(v.classes, v.width, DIMS), p["bias"].reshape(v.classes, v.width)
    for s in range(0, len(symbol), SCORED_AT_ONCE):
        own = symbol[s : s + SCORED_AT_ONCE]
        context = turned[0][first[s : s + SCORED_AT_ONCE]] + turned[1][last[s : s + SCORED_AT_ONCE]]
        group, member = np.divmod(own, v.width)
        told = _chosen(context @ p["class"].T + p["class_bias"], group)
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order], np.arange(v.classes + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            rows = order[edges[k] : edges[k + 1]]
            told[rows] += _chosen(context[rows] @ after[k].T + bias[k], member[rows])
        out[s : s + SCORED_AT_ONCE] = told
    return out / math.log(10)


def _chosen(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log of the softmax of each row at one place."""
    top = logits.max(1)
    logits -= top[:, None]
    chosen = logits[np.arange(len(at)), at].astype(np.float64)
    return chosen - np.log(np.exp(logits, out=logits).sum(1))


def _vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.select(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # The least count whose words are no more than HELD: counts stand in some hundred steps of their logarithm.
    level = F.floor(F.log2("c") * 16).alias("level")
    least, seen = 0, 0
    for row in counts.groupBy(level).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():
        seen += row["n"]
        if seen > HELD:
            least = row["level"] + 1
            break
    held = counts.where((level >= least) | (F.col("word") == F.lit(END))).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    in_tail = np.zeros((TAILS, 2))
    for row in counts.where(F.col("word") != F.lit(END)).groupBy(F.expr(TAIL).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        in_tail[row["k"]] = row["c"], row["v"]
    return Vocabulary(held, total, distinct, in_tail)


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word:string,tf:bigint>>"


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words: runs of other characters than the six ASCII blanks, A-Z as a-z, then one end. Training texts are those
    whose id's crc32 leaves another remainder than 1 by 5. base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))),
    score is the model's log10 probability. A null or empty text is its end alone; a null id counts as an empty
    text; repeated rows are scored each; an empty table gives no rows; with no training text all words are
    unknown. Other columns are not read.

    Word counts cover all training texts and are summed by a shuffle. Workers hold the HELD most frequent words;
    the others of each document meet their counts in a join on the word.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = _rows(docs, id_col, text_col)
    counts = materialise(count_words(rows), "words")
    vocabulary = _vocabulary(counts)
    known = spark.sparkContext.broadcast(vocabulary)
    model = spark.sparkContext.broadcast(train(rows, vocabulary, known))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = known.value, model.value
        row = TaskContext.get().partitionId() << 33
        log_count = np.append(np.log10(v.count + 0.5), 0.0)
        end = pc.index(v.word, pa.scalar(END)).as_py()
        end_log = log_count[end] if end >= 0 else math.log10(0.5)  # without any training text
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            distinct, code, text = words(batch.column(1))
            number, symbol, tail = v.of(distinct)
            place = number[code]
            first, last, line = v.lines(n, text, symbol[code])
            of = np.empty(len(line), np.int64)  # the text of each place
            of[np.arange(len(text)) + text] = text
            of[np.arange(n) + np.cumsum(np.bincount(text, minlength=n))] = np.arange(n)
            tokens = np.bincount(of, minlength=n)
            sums = lambda at, x: np.bincount(at, x, n)  # noqa: E731, B023
            rare = place < 0
            logs = log_count[place]
            known_words = tokens - sums(text, rare) - (end < 0)
            base = sums(text, logs) + end_log - tokens * v.base_total
            in_tail = v.is_tail[symbol[code]]
            model_score = sums(of, log_probabilities(v, p, first, last, line)) + sums(text[in_tail], (logs - v.tail_total[tail[code]])[in_tail])
            # Of each text the words that aren't held, and how often.
            pair, tf = np.unique(text[rare] * len(distinct) + code[rare], return_counts=True)
            offsets = np.searchsorted(pair, np.arange(n + 1) * len(distinct))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([distinct.take(pa.array(pair % max(1, len(distinct)))), pa.array(tf, pa.int64())], ["word", "tf"]))
            columns = [pa.array(row + np.arange(n)), batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array(known_words.astype(np.int64)), pa.array(base), pa.array(model_score), lists]
            row += n
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])

    scored = materialise(rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(trimmed(score), SCORED), "scored")
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", F.col("x.word").alias("word"), F.col("x.tf").alias("tf"))
    met = rare.join(counts, "word", "left")
    sums = met.groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("more"))
    both = scored.drop("rare").join(sums, "row", "left")
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + more).cast("long").alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))
