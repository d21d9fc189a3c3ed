"""Toxicity by a classifier chain of linear models over selected words and word beginnings.

The chain predicts its categories in order; each model sees the probabilities of the categories before it. In
training these are out-of-fold, so that a model meets them as uncertain as they will be on other texts.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import hash32, materialise, prepare, trimmed

#: The chain, in order.
NAMES = ("unfit", "toxic", "severe")
REJECTED = "toxic"
#: Labelled texts that the chain is fitted on, at most: those with the least hashes of their ids.
SAMPLE = 5000
#: Bytes of the texts of that sample, at most.
SAMPLE_BYTES = 64 << 20
#: Features kept for a category, and labelled texts that must have one.
KEPT, LEAST_TEXTS = 350, 4
#: Lengths of the word beginnings that are features beside the word itself.
BEGINNINGS = (4, 5, 6, 7, 8)
#: A text counts a feature this often at most when features are chosen.
CHOICE_CAP = 3
FOLDS, STEPS, L2 = 4, 150, 0.3
DENSE = 7
#: Words that a worker remembers the features of, some 10 MB.
REMEMBERED = 60_000
_EDGE = re.compile(r"^\W+|\W+$")


def categories(quality: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """unfit: of low quality; toxic; severe: both at once."""
    return {"unfit": quality == 0, "toxic": toxic == 1, "severe": (toxic == 1) & (quality == 0)}


def features(word: str) -> list[str]:
    """A word's features: itself, and its beginnings where it is longer than they are."""
    bare = _EDGE.sub("", word)
    return [f"={bare}", *(bare[:k] for k in BEGINNINGS if len(bare) > k)] if bare else []


def dense(text: str, words: list[str], counts: Counter) -> list[float]:
    """What is known of a text beside its features; all of the size of 1."""
    n, chars = len(words), max(1, len(text))
    mark = sum(text.count(c) for c in "!$%&*#|")
    return [1.0, np.sqrt(n) / 30, np.log1p(n) / 7, len(counts) / max(1, n), sum(map(str.isupper, words)) / max(1, n), 5 * mark / chars, max(counts.values(), default=0) / max(1, n)]


def tokens(text: str | None) -> list[str]:
    return (text or "").split()


class Vectoriser:
    """Counts of the chosen features over the root of the words, and the dense part.

    A class's rate of a feature is Poisson, so its evidence is linear in the count and in the words; over their
    root, both have the same spread in short and in long texts.
    """

    def __init__(self, chosen: list[str]):
        self.number = {f: i for i, f in enumerate(chosen)}
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            got = tuple(self.number[f] for f in features(word.lower()) if f in self.number)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = got
        return got

    def row(self, text: str | None) -> tuple[list[int], list[float], list[float]]:
        words = tokens(text)
        counts = Counter(words)
        sums: dict[int, int] = {}
        for word, k in counts.items():
            for i in self.of_word(word):
                sums[i] = sums.get(i, 0) + k
        root = np.sqrt(len(words) + 1.0)
        return list(sums), [k / root for k in sums.values()], dense(text or "", words, counts)

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.number) + DENSE), np.float32)
        for i, text in enumerate(texts):
            at, value, rest = self.row(text)
            out[i, at] = value
            out[i, len(self.number) :] = rest
        return out


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Logistic regression with an L2 penalty (the first dense column, a constant, goes free), by Adam over all rows."""
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    bias = np.log(rate / (1 - rate))
    free = np.ones(x.shape[1])
    for t in range(1, steps + 1):
        p = sigmoid(x @ w.astype(np.float32) + bias)
        g = ((p - y).astype(np.float32) @ x + L2 * free * w) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return np.append(w, bias)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Chain:
    chosen: list[str]
    weights: list[np.ndarray]  # of each category: features, earlier categories' probabilities, bias
    threshold: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.weights)))
        for k, w in enumerate(self.weights):
            n = x.shape[1]
            out[:, k] = sigmoid(x @ w[:n].astype(np.float32) + out[:, :k] @ w[n : n + k] + w[-1])
        return out


def fit_chain(chosen: list[str], x: np.ndarray, labels: dict[str, np.ndarray], fold: np.ndarray, columns: np.ndarray, of_fold: list[np.ndarray]) -> tuple[Chain, np.ndarray]:
    """The chain, and its out-of-fold probabilities. ``columns``: those of ``x`` that the chain uses, which are
    ``chosen`` and the dense ones; ``of_fold``: those that were chosen without the labels of each fold. The threshold
    is where the out-of-fold probabilities reject most of the toxic texts for the fewest clean ones (the F of
    precision weighed twice)."""
    earlier = np.zeros((len(x), 0))
    weights = []
    for name in NAMES:
        y = labels[name].astype(float)
        held = np.zeros(len(x))
        for k, own_columns in enumerate(of_fold):
            own = fold == k
            if own.any():
                full = np.concatenate([x[:, own_columns], earlier.astype(np.float32)], axis=1)
                w = fit_linear(full[~own], y[~own]) if (~own).any() else np.zeros(full.shape[1] + 1)
                held[own] = sigmoid(full[own] @ w[:-1].astype(np.float32) + w[-1])
        weights.append(fit_linear(np.concatenate([x[:, columns], earlier.astype(np.float32)], axis=1), y))
        earlier = np.column_stack([earlier, held])
    at = NAMES.index(REJECTED)
    order = np.argsort(-earlier[:, at], kind="stable")
    hits = np.cumsum(labels[REJECTED][order])
    rejected = np.arange(1, len(x) + 1)
    f = 1.25 * hits / (rejected + 0.25 * max(1, labels[REJECTED].sum()))
    best = int(f.argmax())
    p = earlier[order, at]
    threshold = (p[best] + (p[best + 1] if best + 1 < len(p) else 0.0)) / 2 if hits[-1] else 2.0
    return Chain(chosen, weights, max(threshold, 0.3)), earlier


class FeatureTable:
    """How often each text of the sample has each feature, capped, as triples (text, feature, count)."""

    def __init__(self, texts: list[str | None]):
        self.number: dict[str, int] = {}
        known: dict[str, list[int]] = {}
        text_of, feature, count = array("i"), array("i"), array("b")
        for i, text in enumerate(texts):
            sums: dict[int, int] = {}
            for word, k in Counter(w.lower() for w in tokens(text)).items():
                if word not in known:
                    known[word] = [self.number.setdefault(f, len(self.number)) for f in features(word)]
                for f in known[word]:
                    sums[f] = sums.get(f, 0) + k
            text_of.extend([i] * len(sums))
            feature.extend(sums)
            count.extend(min(k, CHOICE_CAP) for k in sums.values())
        self.text, self.feature, self.count = (np.array(x) for x in (text_of, feature, count))

    def choose(self, labels: dict[str, np.ndarray], use: np.ndarray) -> list[str]:
        """For each category but the last the KEPT features that tell it best in the texts to ``use``, by the
        log-likelihood ratio of capped counts."""
        inside = use[self.text]
        text, feature, count = self.text[inside], self.feature[inside], self.count[inside]
        often = np.bincount(feature, minlength=len(self.number)) >= LEAST_TEXTS
        names = np.array(list(self.number), object)
        out: dict[str, None] = {}
        for category in NAMES[:2]:
            has = labels[category][text]
            high, low = (np.bincount(feature[x], count[x], len(self.number)) for x in (has, ~has))
            share = high.sum() / max(1.0, high.sum() + low.sum())
            high, low = high[often], low[often]
            total = high + low
            gain = high * np.log(np.maximum(high, 1e-9) / np.maximum(total * share, 1e-9)) + low * np.log(np.maximum(low, 1e-9) / np.maximum(total * (1 - share), 1e-9))
            gain[high <= total * share] *= 0.25  # what speaks for a category says more than what speaks against it
            own = names[often]
            for i in sorted(np.argsort(-gain, kind="stable")[: 4 * KEPT].tolist(), key=lambda i: (-gain[i], own[i]))[:KEPT]:
                out[own[i]] = None
        return list(out)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(id, quality, toxic, text) of up to ``sample`` labelled texts, of ``sample_bytes`` in all; labels that are null
    or no 0 or 1 are left out. Of an id's texts the least serves."""
    own = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").where("id is not null and quality in (0, 1) and toxic in (0, 1)")
    own = own.groupBy("id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    picked = materialise(own.orderBy(hash32(F.col("id")), "id").limit(sample), "labels")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(picked), "id")  # bounded by ``sample``
    found = materialise(found.groupBy("id", "quality", "toxic").agg(F.min("text").alias("text")), "labelled")
    size = found.select("id", hash32(F.col("id")).alias("place"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).toArrow().to_pandas().sort_values(["place", "id"])
    # Longer texts than the rest have room for are passed over, the sample's other texts stay.
    kept, room = [], sample_bytes
    for doc, n in zip(size["id"].tolist(), size["n"].tolist()):
        if n <= room:
            kept.append(doc)
            room -= n
    if len(kept) < len(size):
        found = found.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in kept], "id long")), "id")
    return found


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[Chain, np.ndarray, pd.DataFrame]:
    """The chain fitted on at most ``sample`` labelled texts, its out-of-fold probabilities, and the sample.

    Out-of-fold means the features, too: they are chosen without the fold's labels. Without any labelled text, or
    without a toxic one, the chain rejects nothing.
    """
    prepare(docs.sparkSession)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [pa.Table.from_batches([b]) for b in batches]
        if held:
            frame = pa.concat_tables(held).to_pandas().sort_values("id").reset_index(drop=True)
            chain, told = fit_frame(frame)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((chain, told, frame.drop(columns="text")))], pa.binary())], ["fitted"])

    # One task fits, as the sample is bounded; its texts don't come to the driver.
    sampled = labelled_sample(docs, labels, id_col, text_col, sample)
    fitted = sampled.repartition(1).mapInArrow(trimmed(train), "fitted binary").toArrow()["fitted"].to_pylist()
    return pickle.loads(fitted[0]) if fitted else (*fit_frame(pd.DataFrame({"quality": [], "toxic": [], "text": []})), pd.DataFrame({"id": [], "quality": [], "toxic": []}))


def fit_frame(frame: pd.DataFrame) -> tuple[Chain, np.ndarray]:
    """The chain fitted on (quality, toxic, text), and its out-of-fold probabilities."""
    if not len(frame):
        return Chain([], [np.append(np.zeros(DENSE + k), -40.0) for k in range(len(NAMES))], 2.0), np.zeros((0, len(NAMES)))
    texts = [None if t != t else t for t in frame["text"].tolist()]
    kinds = categories(frame["quality"].to_numpy(), frame["toxic"].to_numpy())
    fold = np.random.default_rng(11).permutation(len(frame)) % FOLDS
    table = FeatureTable(texts)
    chosen = table.choose(kinds, np.ones(len(frame), bool))
    by_fold = [table.choose(kinds, fold != k) for k in range(FOLDS)]
    del table
    every = list(dict.fromkeys(f for names in (chosen, *by_fold) for f in names))
    x = Vectoriser(every).matrix(texts)
    place, rest = {f: i for i, f in enumerate(every)}, list(range(len(every), len(every) + DENSE))
    columns = [np.array([place[f] for f in names] + rest) for names in (chosen, *by_fold)]
    return fit_chain(chosen, x, kinds, fold, columns[0], columns[1:])


def score(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "p_", flag: str = "rejected") -> DataFrame:
    """``docs`` with a probability per category and ``flag``; these replace columns of the same names.

    A null or empty text has its dense features alone; every row, repeated or not, is judged by its whole text.
    """
    spark = docs.sparkSession
    prepare(spark)
    added = [*(f"{prefix}{n}" for n in NAMES), flag]
    kept = [c for c in docs.columns if c not in added]
    shipped = spark.sparkContext.broadcast(chain)
    at = NAMES.index(REJECTED)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        vectoriser = Vectoriser(own.chosen)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            made = [np.zeros((0, len(NAMES)))]
            for s in range(0, batch.num_rows, 256):
                made.append(own.predict(vectoriser.matrix(column.slice(s, 256).to_pylist())))
            p = np.concatenate(made)
            columns = [*batch.columns[:-1], *(pa.array(p[:, k]) for k in range(len(NAMES))), pa.array(p[:, at] >= own.threshold)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *added])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, T.DoubleType()) for n in added[:-1]] + [T.StructField(flag, T.BooleanType())])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("string").alias("__text")).mapInArrow(trimmed(judge), schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Every row of ``docs``: doc_id, p_unfit, p_toxic, p_severe, rejected (see ``fit`` and ``score``)."""
    chain, _, _ = fit(docs, labels, id_col, text_col, sample)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return score(rows, chain).drop("text")
