"""Toxicity by multiple-instance learning.

A document is a bag of sentences of which only the bag has a label. Each sentence gets a probability from a
linear model of its words; the document's is the noisy-or of them, so training from document labels
finds out which sentences make a document toxic, and scoring says where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.jobs import annotate

#: Hashed features: words and the first four and five bytes of a word.
FEATURES = 1 << 18
#: Labelled documents of each class that a model is fitted on, about; chosen by hash of the id.
SAMPLE = 6000
#: Longer documents are left out of the fit (never out of scoring): bytes.
LONGEST = 32_000
#: Features of fewer sampled documents get no weight.
FEW = 5
EPOCHS, BATCH, STEP, DECAY = 14, 128, 1.0, 2e-5

#: Bytes inside a word: letters, digits and all bytes of other scripts.
_INNER = np.zeros(256, bool)
_INNER[48:58] = _INNER[65:91] = _INNER[97:123] = True
_INNER[128:] = True
_INNER[39] = True
#: Bytes that end a sentence.
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def features(buf: np.ndarray, offsets: np.ndarray):
    """Features; first feature of every sentence; first sentence of every row; sentence spans.

    Every distinct feature counts once in a sentence.
    """
    low = words.LOWER[buf]
    begin, finish, row_at = words.spans(~_STOP[low], offsets)
    start, end, _ = words.spans(_INNER[low], offsets)
    if not len(start):
        empty = np.zeros(len(begin) + 1, np.int64)
        return np.zeros(0, np.int64), empty, row_at, begin, finish
    running = words.prefix(low)
    length = end - start
    shift = np.uint64(64 - 16)
    half = FEATURES >> 2
    bag = np.searchsorted(begin, start, "right") - 1
    parts, bags = [(words.span_hashes(running, start, end) >> np.uint64(47)).astype(np.int64)], [bag]
    for i, size in enumerate((4, 5)):
        long = length >= size
        parts.append((words.span_hashes(running, start[long], start[long] + size) >> shift).astype(np.int64) + half * (2 + i))
        bags.append(bag[long])
    code = np.unique(np.concatenate(bags) * FEATURES + np.concatenate(parts))
    return code & (FEATURES - 1), np.searchsorted(code >> 18, np.arange(len(begin) + 1)), row_at, begin, finish


def crowd(row_at: np.ndarray) -> np.ndarray:
    """What each sentence starts with: the more sentences a text has, the less is a single one suspected."""
    n = np.diff(row_at)
    return np.repeat(-np.log(np.maximum(n, 1)), n)


def sentence_scores(model: Model, found: np.ndarray, at: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    """Logit of every sentence."""
    return words.sums(model.weights[found], at).astype(float) + model.bias + crowd(row_at)


def noisy_or(logits: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    """1 - the chance that no sentence is toxic; 0 for a text without sentences."""
    return -np.expm1(-words.sums(np.logaddexp(0, logits), row_at))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> DataFrame:
    """(text, label) of about ``most`` labelled documents of each class, by hash of the key.

    Of several labels of one key the largest counts. The chosen keys are broadcast: about 2 ``most`` rows.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    count = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    spread = F.xxhash64("key", F.lit(11)).cast("double") / float(1 << 63)  # -1 to 1
    chosen = F.lit(False)
    for kind, n in count.items():
        chosen = chosen | (F.col("label") == kind) & (spread <= 2.0 * most / n - 1.0)
    chosen = known.where(chosen) if count else known
    few = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.octet_length("text") <= LONGEST).join(F.broadcast(chosen), "key")
    # A key with many rows gives one of them
    return few.groupBy("key", "label").agg(F.min("text").alias("text")).select("text", "label")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE) -> Model:
    """A model of a bounded sample of the labelled documents; no labels, or one class only, give a constant model."""

    def run(batches):
        for batch in batches:
            buf, offsets = words.texts(batch.column(0))
            for lo, hi, b, o in words.pieces(buf, offsets):
                found, at, row_at, _, _ = features(b, o)
                doc_at = at[row_at]
                sizes = np.diff(at)
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(lo, hi - lo),
                    pa.ListArray.from_arrays(pa.array(doc_at.astype(np.int32)), pa.array(found.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(row_at.astype(np.int32)), pa.array(sizes.astype(np.int32))),
                ], names=["label", "found", "sizes"])

    got = sample(docs, labels, key, text, label, most).mapInArrow(run, "label int, found array<int>, sizes array<int>").toArrow().combine_chunks()
    if not got.num_rows:
        return Model(np.zeros(FEATURES, np.float32), -3.0)
    flat = lambda c: (got[c].combine_chunks().flatten().to_numpy(), np.concatenate([[0], np.cumsum(got[c].combine_chunks().value_lengths().to_numpy())]))
    found, found_at = flat("found")
    sizes, sizes_at = flat("sizes")
    label_of = got["label"].to_numpy()
    return fit(label_of, found, found_at, sizes, sizes_at)


def fit(label: np.ndarray, found: np.ndarray, found_at: np.ndarray, sizes: np.ndarray, sizes_at: np.ndarray) -> Model:
    """Adaptive gradient steps on the noisy-or likelihood of the bags, each class with half the weight."""
    weights, squares = np.zeros(FEATURES), np.full(FEATURES, 0.3)
    bias, bias_square = -4.0, 1e-3
    share = label.mean()
    if share in (0.0, 1.0):
        return Model(weights.astype(np.float32), -8.0 if share == 0 else 4.0)
    # The rarer class counts more, but not so much that a document is called toxic on a hint
    cost = np.where(label == 1, min(20.0, (1 - share) / share), 1.0)
    # What few documents have would only be learned by heart
    doc = np.repeat(np.arange(len(label)), np.diff(found_at))
    seen = np.bincount(np.unique(doc * FEATURES + found) & (FEATURES - 1), minlength=FEATURES) >= FEW
    sentence_at = np.concatenate([[0], np.cumsum(sizes)])
    kept = np.concatenate([[0], np.cumsum(seen[found])])
    sizes, found_at, found = np.diff(kept[sentence_at]), kept[found_at], found[seen[found]]
    # Rows come in no fixed order from Spark
    start_order = np.lexsort((found[np.minimum(found_at[:-1], len(found) - 1)] if len(found) else sizes_at[:-1], np.diff(found_at), label))
    random = np.random.default_rng(5)
    for epoch in range(EPOCHS):
        step = STEP / (1 + 0.3 * epoch)
        order = random.permutation(len(label))
        for lo in range(0, len(order), BATCH):
            docs = start_order[order[lo : lo + BATCH]]
            n_found, n_sizes = found_at[docs + 1] - found_at[docs], sizes_at[docs + 1] - sizes_at[docs]
            f, _ = words.gather(found, found_at[docs], n_found)
            s, row_at = words.gather(sizes, sizes_at[docs], n_sizes)
            at = np.concatenate([[0], np.cumsum(s)])
            logit = words.sums(weights[f], at) + bias + crowd(row_at)
            p = 1 / (1 + np.exp(-logit))
            none = np.exp(-words.sums(np.logaddexp(0, logit), row_at))  # chance that no sentence is toxic
            y = label[docs]
            pull = np.where(y == 1, -none / np.maximum(1 - none, 1e-6), 1.0) * cost[docs]
            d = p * np.repeat(pull, n_sizes) / len(docs)
            slope = np.bincount(f, weights=np.repeat(d, s), minlength=FEATURES) + DECAY * weights
            squares += slope * slope
            weights -= step * slope / np.sqrt(squares)
            bias_slope = d.sum()
            bias_square += bias_slope**2
            bias -= step * bias_slope / np.sqrt(bias_square)
    return Model(weights.astype(np.float32), float(bias))


def detect(docs: DataFrame, model: Model, text: str = "text", least: float = 0.7) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (score >= ``least``) and ``offending``: byte spans of sentences that reach 0.5 alone.

    The whole text counts. A null or empty text has no sentence and scores 0. Equal texts score alike. Columns of
    the same names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def step(buf, offsets):
            found, at, row_at, begin, finish = features(buf, offsets)
            logit = sentence_scores(m, found, at, row_at)
            score = noisy_or(logit, row_at)
            bad = np.flatnonzero(logit - crowd(row_at) >= 0)
            row = np.searchsorted(row_at, bad, "right") - 1
            span = pa.StructArray.from_arrays([pa.array(begin[bad] - offsets[row]), pa.array(finish[bad] - offsets[row])], ["start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(bad, row_at).astype(np.int32)), span)
            return pa.array(score), pa.array((score >= least).astype(np.int32)), lists

        return step

    return annotate(docs, text, "score double, predicted int, offending array<struct<start:long,end:long>>", make)
