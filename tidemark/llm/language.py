"""Language identification with error-correcting output codes.

Every language has a codeword. One binary n-gram classifier per bit gives a margin; the language whose
codeword loses least over all bits is chosen, and a small lead over the runner-up is flagged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.jobs import annotate

#: Hashed features: byte trigrams in the lower half, whole words in the upper half.
FEATURES = 1 << 17
#: Languages a model may have; their features are counted on all rows, and codes and weights are kept on the driver.
MOST_LANGUAGES = 500
#: A lead below this marks a text as ambiguous.
AMBIGUOUS = 0.02


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # features x bits


def codewords(n: int) -> np.ndarray:
    """+1/-1 words of ``n`` classes: every split for up to five classes, else random columns at 10 log2 n bits."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        splits = np.arange(1, 1 << (n - 1))
        bits = (splits[None, :] >> np.arange(n - 1)[:, None]) & 1
        return np.where(np.vstack([np.zeros((1, len(splits)), int), bits]) == 1, 1, -1).astype(np.int8)
    random, best = np.random.default_rng(n), None
    for _ in range(50):
        code = random.choice(np.array([-1, 1], np.int8), (n, math.ceil(10 * math.log2(n))))
        code = code[:, np.abs(code.sum(0)) < n]
        apart = (code[:, None, :] != code[None, :, :]).sum(2) + 10_000 * np.eye(n, dtype=int)
        if best is None or apart.min() > best[0]:
            best = apart.min(), code
    return best[1]


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of the text with letters of A-Z in lower case and runs inside words, then its words; row offsets of each."""
    low = words.LOWER[buf]
    start, end, first = words.words(low, offsets)
    whole = (words.span_hashes(words.prefix(low), start, end) >> np.uint64(48)).astype(np.int64) + (FEATURES >> 1)
    n = max(0, len(low) - 2)
    wide = low.astype(np.uint32)
    tri = (wide[:n] * np.uint32(0x9E3779B1) + wide[1 : n + 1] * np.uint32(0x85EBCA77) + wide[2 : n + 2] * np.uint32(0xC2B2AE3D))
    tri ^= tri >> np.uint32(15)
    tri = ((tri * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.int64)
    # Trigrams that reach into the next row are left out
    ok = words.in_row(offsets, 3, len(low))
    at = np.minimum(offsets, n)
    kept = np.zeros(n + 1, np.int64)
    np.cumsum(ok, out=kept[1:])
    return tri[ok], kept[at], whole, first


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of all rows whose text and language are not null.

    Feature counts per language are summed by Spark over all rows; the driver gets at most
    ``FEATURES`` numbers for each language. No rows give a model without languages.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))

    def count(batches):
        table: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_numpy(zero_copy_only=False)
            buf, offsets = words.texts(batch.column(0))
            for lo, hi, b, o in words.pieces(buf, offsets):
                tri, tri_at, whole, whole_at = features(b, o)
                for name in set(langs[lo:hi]):
                    mine = langs[lo:hi] == name
                    got = np.bincount(np.concatenate([tri[np.repeat(mine, np.diff(tri_at))], whole[np.repeat(mine, np.diff(whole_at))]]), minlength=FEATURES)
                    table[name] = table[name] + got if name in table else got
        for name, counts in table.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "feature", "n"])

    counted = rows.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    languages = sorted(set(got["lang"].unique().to_pylist()))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; a model holds at most {MOST_LANGUAGES}")
    counts = np.zeros((len(languages), FEATURES))
    if languages:
        place = {x: i for i, x in enumerate(languages)}
        index = np.array([place[x] for x in got["lang"].to_pylist()])
        counts[index, got["feature"].to_numpy()] = got["n"].to_numpy()
    code = codewords(len(languages))
    # A frequent language must not outweigh the others of its side of a split
    share = np.zeros_like(counts)
    for half in (slice(0, FEATURES >> 1), slice(FEATURES >> 1, FEATURES)):
        total = counts[:, half].sum(1, keepdims=True)
        share[:, half] = (counts[:, half] + 0.05) / (total + 0.05 * (FEATURES >> 1))
    weights = np.zeros((FEATURES, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        one, two = code[:, bit] == 1, code[:, bit] == -1
        if one.any() and two.any():
            weights[:, bit] = np.log(share[one].mean(0)) - np.log(share[two].mean(0))
    return Model(languages, code, weights)


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best codeword of every row, its share of the evidence and its lead over the second."""
    loss = np.logaddexp(0, -margins[:, None, :] * code[None, :, :]).mean(2)
    weight = np.exp(-(loss - loss.min(1, keepdims=True)))
    weight /= weight.sum(1, keepdims=True)
    order = np.sort(weight, axis=1)
    lead = order[:, -1] - order[:, -2] if code.shape[0] > 1 else order[:, -1]
    return weight.argmax(1), order[:, -1], lead


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``.

    ``und`` with score 0 if the text is null, has no letter, or the model knows no language. The whole text
    counts, however long. Equal texts get equal results; of equally good languages the first by name is taken.
    Columns of the same names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def step(buf, offsets):
            tri, tri_at, whole, whole_at = features(buf, offsets)
            n = np.diff(tri_at) + np.diff(whole_at)
            total = words.sums(m.weights[tri], tri_at) + words.sums(m.weights[whole], whole_at)
            best, score, lead = decode(total / np.sqrt(n + 1.0)[:, None], m.code)
            names = pa.array(m.languages, pa.string()).take(pa.array(best))
            return names, pa.array(score.astype(float)), pa.array(lead < AMBIGUOUS)

        def nothing(buf, offsets):
            n = len(offsets) - 1
            return pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n)), pa.array(np.ones(n, bool))

        return step if m.languages else nothing

    said = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = annotate(docs, text, "lang_pred string, score double, ambiguous boolean", make)
    return out.withColumns({
        "lang_pred": F.when(said, F.col("lang_pred")).otherwise("und"),
        "score": F.when(said, F.col("score")).otherwise(0.0),
        "ambiguous": F.when(said, F.col("ambiguous")).otherwise(True),
    })


def rejected() -> Column:
    """Texts without a language: no letters, or no lead of one language over the others."""
    return (F.col("lang_pred") == "und") | F.col("ambiguous")
