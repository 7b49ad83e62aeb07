"""Importance resampling towards a target: hashed n-grams weigh every document, and noisy scores draw a share of them."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.interning import intern
from tidemark.llm.jobs import annotate, stored
from tidemark.operators.ordered import By, row_number

BUCKETS = 10_000
#: Lengths of the n-grams, from and to.
SIZES = (1, 1)
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def grams(buf: np.ndarray, offsets: np.ndarray, sizes: tuple[int, int] = SIZES):
    """Bytes with the words of every row joined by one space, starts, ends and rows of all n-grams in them, and words per row."""
    buf = words.LOWER[buf]
    start, end, first = words.spans(_WORD[buf], offsets)
    n = len(start)
    # A word is taken with the byte behind it, which then becomes the space
    joined, at = words.gather(np.append(buf, np.uint8(32)), start, end - start + 1)
    if n:
        joined[at[1:] - 1] = 32
    row = words.row_of(first)
    starts, ends, rows = [], [], []
    for k in range(sizes[0], sizes[1] + 1):
        ok = np.flatnonzero(words.in_row(first, k, n))
        starts.append(at[ok])
        ends.append(at[ok + k] - 1)
        rows.append(row[ok])
    return joined, np.concatenate(starts), np.concatenate(ends), np.concatenate(rows), np.diff(first)


def bucket_table(buf: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of every n-gram, and bucket and count of every slot; an n-gram is hashed to its bucket once a batch."""
    slot, first = intern(buf, start, end)
    raw = buf.tobytes()
    bucket = np.fromiter((zlib.crc32(raw[a:b]) % buckets for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)), np.int64, len(first))
    return slot, bucket, np.bincount(slot, minlength=len(first))


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, sizes: tuple[int, int] = SIZES) -> np.ndarray:
    """Occurrences of n-grams per bucket over all rows: ``buckets`` numbers, whatever the input; null texts have none."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            buf, offsets = words.texts(batch.column(0))
            for _, _, b, o in words.pieces(buf, offsets):
                joined, start, end, _, _ = grams(b, o, sizes)
                _, bucket, count = bucket_table(joined, start, end, buckets)
                np.add.at(total, bucket, count)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    found = df.select(F.col(text)).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of every bucket's share of the target to its share of the source, one added to each count."""
    n, wide, narrow = len(source), float(source.sum()) + len(source), float(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((float(target[i]) + 1) * wide / ((float(source[i]) + 1) * narrow))) for i in range(n)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text: str = "text", sizes: tuple[int, int] = SIZES, carry: bool = True) -> DataFrame:
    """``docs`` with n_words, n_features and weight, the sum of the gains of all n-grams of the whole text, repeats counted.

    A null or empty text has none, and weight 0. Rows are independent: repeated ones are weighed each, ids may be null, and
    columns of these names are replaced. A very long text is handled on its own. ``gain``: see ``gains``.
    """
    buckets = len(gain)

    def make():
        def step(buf, offsets):
            joined, start, end, row, n_words = grams(buf, offsets, sizes)
            slot, bucket, _ = bucket_table(joined, start, end, buckets)
            rows = len(offsets) - 1
            weight = np.zeros(rows, np.int64)
            np.add.at(weight, row, gain[bucket][slot])
            return [pa.array(n_words.astype(np.int64)), pa.array(np.bincount(row, minlength=rows).astype(np.int64)), pa.array(weight)]

        return step

    return annotate(docs, text, "n_words long, n_features long, weight long", make, carry)


def noise(key: str | Column, seed: int) -> Column:
    """Gumbel noise in thousandths, fixed by seed and id; a null id counts as empty text."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(weighed: DataFrame, key: str = "doc_id", percent: int = 10, least_words: int = LEAST_WORDS, seed: int = 2024) -> DataFrame:
    """All rows of ``weigh`` with score, and rank from 1 where drawn.

    Of the N rows with at least ``least_words`` words, floor(``percent`` * N / 100) with the highest scores are drawn; ties go to the
    smaller id, null ids first, then to fewer features. Equal rows take neighbouring ranks. Ranks are counted over slices of the sorted
    rows, so no task holds them all. Columns called score or rank are replaced.
    """
    weighed = weighed.drop("score", "rank")
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(key, seed)))
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    ranked = row_number(scored.where(able), [], [By("score", desc=True), By(key, nulls_first=True), "n_features"], "rank", group_rows=0)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS,
    sizes: tuple[int, int] = SIZES, percent: int = 10, least_words: int = LEAST_WORDS, seed: int = 2024, carry: bool = True,
) -> DataFrame:
    """Documents weighed by how much more their n-grams belong to ``target`` than to ``docs``, and a share of them drawn.

    Words are runs of digits, letters a to z after lower-casing A to Z, and characters beyond ASCII. Counts cover all texts of both
    tables; an empty table on either side gives gains from the other alone.
    """
    gain = gains(bucket_counts(target, target_text, buckets, sizes), bucket_counts(docs, text, buckets, sizes))
    return draw(weigh(docs, gain, text, sizes, carry), key, percent, least_words, seed)
