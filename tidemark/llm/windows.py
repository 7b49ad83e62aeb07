"""Substring dedup: words covered by a window of consecutive words that an earlier document has too.

Super-k-mers: consecutive windows that share a minimiser (the smallest hash of a short run of words inside the
window) travel as one packed string to the minimiser's bucket, so equal windows meet there however the
strings around them differ. A bucket sorts its windows and tells each block of documents which of
its windows occur in more than one document, and the smallest id among these.

A minimiser that stands in one document only can hold no shared window. So blocks first send five bytes of each
minimiser's hash, learn by one bit which ones others have too, and pack the strings of those. (Hashes that
meet by chance only make some strings travel in vain.)

Blocks send each different string once, with the smallest id that has it. So a passage or a text with very
many copies arrives at its bucket once per block, and no list of the documents that have it exists anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tidemark.llm import words
from tidemark.llm.jobs import blocks

WINDOW, MINIMISER = 13, 3
#: Bytes of text in a block of documents, and about as much of packed strings in a bucket.
BLOCK = 4 << 20
LAST = np.iinfo(np.int64).max


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` consecutive values."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the two spans of each pair hold the same bytes."""
    one, at = words.gather(buf, a, length)
    two, _ = words.gather(buf, b, length)
    return words.sums((one != two).astype(np.int64), at) == 0


class Index:
    """The words, windows and super-k-mers of some documents, whose order is fixed by (id, text)."""

    def __init__(self, table: pa.Table, key: str, text: str, k: int, m: int):
        table = table.combine_chunks()
        self.order = pc.sort_indices(pa.table({"k": table[key], "t": table[text]}), sort_keys=[("k", "ascending"), ("t", "ascending")])
        table = self.table = table.take(self.order)
        self.k = k
        doc = table[key].combine_chunks().cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
        buf, offsets = words.texts(table[text])
        start, end, self.first = words.words(buf, offsets)
        flat, self.at = words.gather(np.append(buf, np.uint8(32)), start, end - start + 1)
        flat[self.at[1:] - 1] = 32
        self.flat, n = flat, len(start)
        running = words.prefix(flat)
        h = words.span_hashes(running, self.at[:-1], self.at[1:] - 1)
        ok = words.in_row(self.first, k, n)
        low = sliding_min(words.run_hashes(h, m), k - m + 1)
        change = low[1:] != low[:-1]
        begins, ends = ok.copy(), ok.copy()
        begins[1:] &= ~ok[:-1] | change
        ends[:-1] &= ~ok[1:] | change
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.start, self.count = s, e - s  # windows of each super-k-mer
        self.low = low[s]
        self.doc = doc[np.searchsorted(self.first, s, "right") - 1] if len(s) else s
        lo, hi = self.at[s], self.at[np.minimum(e + k - 1, n)] - 1
        name = words.span_hashes(running, lo, hi)
        by = np.lexsort((self.doc, name))
        lead = np.ones(len(by), bool)
        lead[1:] = name[by][1:] != name[by][:-1]
        head = by[np.maximum.accumulate(np.where(lead, np.arange(len(by)), 0))]
        twin = np.flatnonzero(~lead)
        if len(twin):
            a, b = by[twin], head[twin]
            size = (hi - lo)[a]
            same = size == (hi - lo)[b]
            same[same] = same_bytes(flat, lo[a][same], lo[b][same], size[same])
            lead[twin[~same]] = True  # another string with the same hash stands alone
        number = np.cumsum(lead) - 1
        self.string = np.empty(len(by), np.int64)  # which different string each super-k-mer is
        self.string[by] = number
        self.leaders = by[lead]
        self.first_doc = self.doc[self.leaders]
        self.several = np.zeros(len(self.leaders), bool)
        self.several[number[self.doc[by] != self.first_doc[number]]] = True
        self.spans = lo[self.leaders], hi[self.leaders] - lo[self.leaders]

        self.minimisers = np.unique(self.low)

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The minimisers' order by bucket, the buckets, and where each begins in that order."""
        bucket = (self.minimisers % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        found, at = np.unique(bucket[order], return_index=True)
        return order, found, np.append(at, len(order))

    def asked(self, block: int, buckets: int) -> pa.Table:
        """Five bytes of each minimiser, and whether several documents of the block have it."""
        order, found, at = self.by_bucket(buckets)
        low, high = np.full(len(order), LAST), np.full(len(order), -LAST)
        place = np.searchsorted(self.minimisers, self.low)
        np.minimum.at(low, place, self.doc)
        np.maximum.at(high, place, self.doc)
        names = np.ascontiguousarray((self.minimisers[order] >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5])
        several = (low != high)[order]
        return pa.table({
            "bucket": pa.array(found.astype(np.int32)), "block": pa.array(np.full(len(found), block, np.int32)),
            "names": pa.array([names[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
            "several": pa.array([np.packbits(several[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
        })

    def packed(self, block: int, buckets: int, answers: pa.Table, askers: int) -> pa.Table:
        """Strings whose minimiser is shared, as the answers say."""
        order, found, at = self.by_bucket(askers)
        told = dict(zip(answers["bucket"].to_pylist(), answers["shared"].to_pylist(), strict=True))
        shared = np.zeros(len(order), bool)
        for b, lo, hi in zip(found.tolist(), at[:-1], at[1:], strict=True):
            shared[order[lo:hi]] = np.unpackbits(np.frombuffer(told[b], np.uint8), count=hi - lo).astype(bool)
        sent = np.flatnonzero(shared[np.searchsorted(self.minimisers, self.low[self.leaders])])
        data, offsets = words.gather(self.flat, self.spans[0][sent], self.spans[1][sent])
        return pa.table({
            "bucket": pa.array((self.low[self.leaders[sent]] % np.uint64(buckets)).astype(np.int32)),
            "block": pa.array(np.full(len(sent), block, np.int32)),
            "string": pa.array(sent.astype(np.int32)),
            "first_doc": pa.array(self.first_doc[sent]),
            "several": pa.array(self.several[sent]),
            "packed": words.string_array(data, offsets, pa.binary()),
        })

    def kept(self, runs: np.ndarray) -> pa.Table:
        """The documents with what is left of them; runs: (string, offset, windows, smallest document)."""
        n = len(self.at) - 1
        counts = self.count[self.leaders]
        place = np.cumsum(counts) - counts
        smallest = np.full(int(counts.sum()), LAST)
        if len(runs):
            string, offset, length, doc = runs.T
            at, _ = words.gather(np.arange(len(smallest)), place[string] + offset, length)
            np.minimum.at(smallest, at, np.repeat(doc, length))
        window, _ = words.gather(np.arange(n), self.start, self.count)
        known, _ = words.gather(smallest, place[self.string], self.count)
        hit = window[known < np.repeat(self.doc, self.count)]
        edge = np.zeros(n + 1, np.int64)
        edge[hit] += 1
        np.subtract.at(edge, hit + self.k, 1)
        gone = np.cumsum(edge[:n]) > 0
        stay = np.flatnonzero(~gone)
        text, at = words.gather(self.flat, self.at[stay], np.diff(self.at)[stay])
        row_at = np.searchsorted(stay, self.first)
        lo, hi = at[row_at[:-1]], at[row_at[1:]]
        text, offsets = words.gather(text, lo, np.maximum(hi - lo - 1, 0))
        total = np.diff(self.first)
        return self.table.append_column("kept", words.string_array(text, offsets)).append_column("n_words", pa.array(total)).append_column(
            "n_removed", pa.array(total - np.diff(row_at)))


def shared_minimisers(table: pa.Table) -> pa.Table:
    """For each block's list of minimisers, which ones other blocks or several of its documents have."""
    lists = [np.frombuffer(x, np.uint8).reshape(-1, 5) for x in table["names"].to_pylist()]
    size = np.array([len(x) for x in lists])
    wide = np.zeros((int(size.sum()), 8), np.uint8)
    wide[:, :5] = np.concatenate(lists)
    name = wide.view(np.uint64)[:, 0]
    shared = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table["several"].to_pylist(), size, strict=True)]).astype(bool)
    order = np.argsort(name)
    same = name[order][1:] == name[order][:-1]
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    at = np.concatenate([[0], np.cumsum(size)])
    bits = [np.packbits(shared[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.table({"bucket": table["bucket"], "block": table["block"], "shared": pa.array(bits, pa.binary())})


def repeats(table: pa.Table, k: int) -> pa.Table:
    """What a bucket answers: for each block, runs of windows that several documents have, with the smallest of these."""
    table = table.combine_chunks()
    buf, offsets = words.texts(table["packed"])
    start, end, first = words.words(buf, offsets)
    n = len(start)
    name = words.run_hashes(words.span_hashes(words.prefix(buf), start, end), k)
    window = np.flatnonzero(words.in_row(first, k, n))
    name = name[window]
    row = np.searchsorted(first, window, "right") - 1
    by = np.argsort(name, kind="stable")
    lead = np.ones(len(by), bool)
    lead[1:] = name[by][1:] != name[by][:-1]
    head = by[np.maximum.accumulate(np.where(lead, np.arange(len(by)), 0))]
    twin = np.flatnonzero(~lead)
    group = np.cumsum(lead) - 1
    lo, hi = start[window], end[window + k - 1]
    if len(twin):
        a, b = by[twin], head[twin]
        size = (hi - lo)[a]
        same = size == (hi - lo)[b]
        same[same] = same_bytes(buf, lo[a][same], lo[b][same], size[same])
        if not same.all():  # hashes of different windows have met: their bytes decide
            mixed = np.isin(group, group[twin[~same]])
            text = {i: bytes(buf[lo[i] : hi[i]]) for i in by[mixed]}
            by[mixed] = sorted(by[mixed], key=lambda i: (name[i], text[i]))
            lead[mixed] = [j == 0 or by[j - 1] not in text or text[by[j - 1]] != text[by[j]] for j in np.flatnonzero(mixed)]
    doc = table["first_doc"].to_numpy()[row][by]
    several = table["several"].to_numpy(zero_copy_only=False)[row][by]
    at = np.flatnonzero(lead)
    none = pa.table({"block": pa.array([], pa.int32()), "runs": pa.array([], pa.binary())})
    if not len(at):
        return none
    low, high = np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)
    shared = (low != high) | np.logical_or.reduceat(several, at)
    group = np.cumsum(lead) - 1
    mine = shared[group]
    found, low = by[mine], low[group][mine]
    if not len(found):
        return none
    block, string = table["block"].to_numpy()[row[found]], table["string"].to_numpy()[row[found]]
    offset = window[found] - first[row[found]]
    by = np.lexsort((offset, string, block))
    block, string, offset, low = block[by], string[by], offset[by], low[by]
    new = np.ones(len(by), bool)
    new[1:] = (block[1:] != block[:-1]) | (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1) | (low[1:] != low[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(new)))
    runs = np.ascontiguousarray(np.stack([string[at], offset[at], length, low[at]], axis=1).astype(np.int64))
    edge = np.flatnonzero(np.diff(block[at], prepend=-1))
    data = [runs[a:b].tobytes() for a, b in zip(edge, np.append(edge[1:], len(at)), strict=True)]
    return pa.table({"block": pa.array(block[at][edge], pa.int32()), "runs": pa.array(data, pa.binary())})


def dedup_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """``docs`` with ``kept`` (the words left, joined by one space), ``n_words`` and ``n_removed``.

    A word goes if a window of ``k`` words that covers it also starts in a document with a smaller id; windows
    are judged on the input. Ids are whole numbers; rows with one id never remove from each other, and a null id
    comes after all others. A null text has no words. Columns with the names of the new ones, or ``block``,
    are replaced.
    """
    names = {"kept", "n_words", "n_removed", "block"}
    plain = docs.select([c for c in docs.columns if c.lower() not in names])
    dealt, n = blocks(plain, key, text, BLOCK)
    buckets = 3 * n

    # Millions of minimisers make a bucket, but as many tasks as others have get some
    askers = max(n // 40, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def ask(group, table):
        return Index(table, key, text, k, m).asked(group[0].as_py(), askers)

    def pack(group, left, right):
        return Index(left.select(columns), key, text, k, m).packed(group[0].as_py(), buckets, right, askers)

    def answer(group, table):
        return repeats(table, k)

    columns = plain.columns

    def drop(group, left, right):
        found = [np.frombuffer(x, np.int64).reshape(-1, 4) for x in right["runs"].to_pylist()]
        return Index(left.select(columns), key, text, k, m).kept(np.concatenate(found) if found else np.zeros((0, 4), np.int64))

    asked = dealt.groupBy("block").applyInArrow(ask, "bucket int, block int, names binary, several binary")
    told = asked.groupBy("bucket").applyInArrow(shared_minimisers, "bucket int, block int, shared binary")
    packed = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(pack, "bucket int, block int, string int, first_doc long, several boolean, packed binary")
    runs = packed.groupBy("bucket").applyInArrow(answer, "block int, runs binary")
    out = StructType(plain.schema.fields + StructType.fromDDL("kept string, n_words long, n_removed long").fields)
    return dealt.groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(drop, out)
