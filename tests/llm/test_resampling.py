"""Interning of byte spans, and importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import resampling
from tidemark.llm.interning import intern, xxhash64

SCHEMA = "doc_id long, text string"


def spans(parts):
    end = np.cumsum([len(p) for p in parts], dtype=np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), end - np.array([len(p) for p in parts], np.int64), end


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=70) | st.text("ab", max_size=40).map(str.encode), min_size=1, max_size=60))
def test_equal_spans_share_a_number(parts):
    buf, start, end = spans(parts)
    assert xxhash64(buf, start, end).tolist() == [xxhash.xxh64_intdigest(p) for p in parts]
    number, first = intern(buf, start, end)
    assert len(first) == len(set(parts))
    assert [parts[first[i]] for i in number] == parts
    assert all(parts.index(parts[f]) == f for f in first)


def test_spans_with_one_hash_stay_apart(monkeypatch):
    """Bytes decide, not the hash: with a constant hash all spans meet in one place."""
    from tidemark.llm import interning

    monkeypatch.setattr(interning, "xxhash64", lambda buf, start, end, lane: np.zeros(len(start), np.uint64))
    parts = [b"one", b"two", b"one", b"", b"three and more", b"three and mora", b"two"]
    number, first = intern(*spans(parts))
    assert [parts[first[i]] for i in number] == parts and len(first) == 5


def test_no_spans():
    number, first = intern(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(number) == len(first) == 0


def features(text, sizes):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return ws, [" ".join(ws[i : i + k]) for k in range(sizes[0], sizes[1] + 1) for i in range(len(ws) - k + 1)]


def plain(docs, target, sizes, buckets, percent, least, seed):
    """The result by dictionaries and one sort."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, sizes)[1])
    t = Counter(bucket(f) for x in target for f in features(x, sizes)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for i, x in docs:
        ws, fs = features(x, sizes)
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(ws), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    rank = {id(r): n + 1 for n, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r, rank.get(id(r))) for r in rows), key=repr)


DOCS = [
    (1, "The Cat sat on the mat; the cat SAT."), (2, "zebra 42 crossing 42 über straße"), (3, None), (4, ""), (5, " \t\n.,;"),
    (6, "the cat sat on the mat; the cat sat"), (6, "the cat sat on the mat; the cat sat"), (None, "a cat on a mat of its own here"),
    (7, "x" * 100 + " cat " * 3000), (8, "İstanbul ÀÉ   nbsp space"), (9, "a\x00b\x7fc`d{e|f~g"), (-10, "mat cat on the sat"),
]
TARGET = ["the cat on a mat", None, "", "cat mat", "über alles"]


@pytest.mark.parametrize("sizes,buckets,percent", [((1, 1), 10_000, 50), ((1, 2), 64, 100), ((2, 3), 500, 34)])
def test_resample_equals_plain_version(spark, sizes, buckets, percent):
    df = spark.createDataFrame(DOCS, SCHEMA).repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resampling.resample(df, target, buckets=buckets, sizes=sizes, percent=percent, least_words=3, seed=7)
    got = sorted(map(tuple, got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert got == plain(DOCS, TARGET, sizes, buckets, percent, 3, 7)


def test_other_columns_stay_and_own_names_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b", "x", 9, 9, 9), (2, "c", "y", 9, 9, 9)], "doc_id long, text string, rank string, score int, weight int, bucket int")
    got = resampling.resample(df, df.select("text"), percent=100, least_words=1)
    assert got.columns.count("rank") == got.columns.count("score") == got.columns.count("weight") == 1
    assert {(r.doc_id, r.text, r.bucket) for r in got.collect()} == {(1, "a b", 9), (2, "c", 9)}
    assert sorted(r["rank"] for r in got.collect()) == [1, 2]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "a b c")], SCHEMA)
    assert resampling.resample(none, some).collect() == []
    assert [tuple(r) for r in resampling.resample(some, none, percent=100, least_words=1).select("n_features", "rank").collect()] == [(3, 1)]
    assert resampling.resample(none, none).columns == ["doc_id", "text", "n_words", "n_features", "weight", "score", "rank"]
