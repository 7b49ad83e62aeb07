"""N-gram Jaccard join: pairs of texts whose sets of word n-grams overlap by at least a threshold.

MinHash bands propose; documents that share a band form a suspicion group, found as linear chains of links.
Only these are read again. Inside a group MinHash values are compared some at a time, a pair is dropped as soon
as the posterior probability that it reaches the threshold falls below a tolerance, and what is left is verified
on the sets themselves. Large groups are cut into tiles whose pairs are groups of their own, and links are counted
where they are found, so neither a task nor a table holds all pairs of a group.

Texts with the same set are one class with a count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.jobs import components, stored
from tidemark.llm.lattice import roots
from tidemark.session import settle

N, LEAST = 5, 0.8
#: 48 bands of 8 values: a pair at 0.8 shares none with a chance of 0.00015, at 0.85 of 0.0000003.
BANDS, ROWS = 48, 8
#: A pair is dropped when it reaches the threshold with less than this probability; looked at after so many values.
TOLERANCE, STEP = 1e-5, 32
TILE = 256

_FACTOR = (words._mixed(BANDS * ROWS, 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (words._mixed(BANDS * ROWS, 22) >> np.uint64(32)).astype(np.uint32)


def shingles(buf: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Different n-gram hashes of every text, sorted, and their row offsets. A text of fewer than ``n`` words, but not of none, is one n-gram."""
    start, end, first = words.words(buf, offsets)
    h = words.span_hashes(words.prefix(buf), start, end)
    run, row = words.run_hashes(h, n), words.row_of(first)
    ok = np.flatnonzero(words.in_row(first, n, len(h)))
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < n))
    whole = np.zeros(len(short), np.uint64)
    for i in range(n - 1):
        more = size[short] > i
        whole[more] = whole[more] * np.uint64(words.BASE) + h[first[short[more]] + i]
    value = np.concatenate([run[ok], words.mix(whole + np.uint64(1))])
    row = np.concatenate([row[ok], short])
    by = np.lexsort((value, row))
    value, row = value[by], row[by]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(offsets)))


def signatures(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash values of every row that has n-grams."""
    full = np.flatnonzero(np.diff(at))
    out = np.empty((len(full), BANDS * ROWS), np.uint32)
    if len(full):
        x, begin = (value >> np.uint64(32)).astype(np.uint32) ^ value.astype(np.uint32), at[:-1][full]
        for i in range(BANDS * ROWS):
            out[:, i] = np.minimum.reduceat(x * _FACTOR[i] + _SHIFT[i], begin)
    return out


def band_cells(signature: np.ndarray) -> np.ndarray:
    """A 64-bit name of every band's values."""
    name = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(signature), 1), np.uint64)
    for i in range(ROWS):
        name = words.mix(name * np.uint64(words.BASE) + signature[:, i::ROWS][:, :BANDS])
    return name.astype(np.int64)


def fewest(least: float = LEAST, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After how many values, how many equal ones a pair needs to stay.

    With an even prior, P(similarity >= t | m of n equal) = P(Binomial(n + 1, t) <= m).
    """
    out = {}
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(least) + (n + 1 - m) * math.log1p(-least)) if least < 1 else float(m == n)
            if total >= tolerance:
                out[n] = m
                break
    return out


def overlaps(value: np.ndarray, at: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Numbers of n-grams that the rows ``one`` and the rows ``two`` have in common."""
    row = words.row_of(at)
    place = np.full((2, len(at) - 1), -1)
    place[0, one], place[1, two] = np.arange(len(one)), np.arange(len(two))
    keep = (place[0, row] >= 0) | (place[1, row] >= 0)
    value, row = value[keep], row[keep]
    by = np.argsort(value, kind="stable")
    value, row = value[by], row[by]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    term = np.cumsum(new) - 1
    many = np.bincount(term) > 1
    mine = many[term]
    term, row = (np.cumsum(many) - 1)[term[mine]], row[mine]
    out = np.zeros((len(one), len(two)), np.float32)
    for lo in range(0, int(many.sum()), 4096):
        a, b = np.searchsorted(term, [lo, lo + 4096])
        x, y = np.zeros((len(one), 4096), np.float32), np.zeros((len(two), 4096), np.float32)
        for m, p in ((x, place[0]), (y, place[1])):
            i = p[row[a:b]]
            m[i[i >= 0], (term[a:b] - lo)[i >= 0]] = 1
        out += x @ y.T
    return out


def compare(table: pa.Table, least: float, needed: dict[int, int], n: int) -> pa.Table:
    """Links inside a tile of a suspicion group, or between two tiles."""
    table = table.combine_chunks()
    _, first = np.unique(table["class"].to_numpy(), return_index=True)
    table = table.take(pa.array(first))
    name, copies, tile = (table[c].to_numpy() for c in ("class", "copies", "tile"))
    buf, offsets = words.texts(table["text"])
    value, at = shingles(buf, offsets, n)
    size = np.diff(at)
    sign = signatures(value, at)
    left, right = table["left"][0].as_py(), table["right"][0].as_py()
    one, two = np.flatnonzero((tile == left) & (size > 0)), np.flatnonzero((tile == right) & (size > 0))
    row = np.cumsum(size > 0) - 1
    alive = None
    seen = np.zeros(0, np.int64)
    for done, enough in needed.items():
        part = slice(done - STEP, done)
        if alive is None:
            equal = np.zeros((len(one), len(two)), np.int64)
            for i in range(part.start, part.stop):
                equal += sign[row[one], i][:, None] == sign[row[two], i][None, :]
            if left == right:
                equal[np.tril_indices(len(one))] = -1
            alive = np.nonzero(equal >= enough)
            seen = equal[alive]
        else:
            for lo in range(0, len(seen), 1 << 15):
                some = slice(lo, lo + (1 << 15))
                seen[some] += (sign[row[one[alive[0][some]]], part] == sign[row[two[alive[1][some]]], part]).sum(1)
            stay = seen >= enough
            alive, seen = (alive[0][stay], alive[1][stay]), seen[stay]
    a, b = one[alive[0]], two[alive[1]]
    if len(a):
        some, more = np.unique(a), np.unique(b)
        common = overlaps(value, at, some, more)[np.searchsorted(some, a), np.searchsorted(more, b)].astype(float)
        linked = common >= least * (size[a] + size[b] - common) - 1e-9
        a, b = a[linked], b[linked]
    links = np.bincount(a, copies[b], len(name)) + np.bincount(b, copies[a], len(name))
    root = roots(len(name), a, b)
    found = np.flatnonzero(links > 0)
    return pa.table({"class": pa.array(name[found]), "links": pa.array(links[found].astype(np.int64)), "root": pa.array(name[root[found]])})


def near_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, n: int = N) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_links (other rows with Jaccard >= ``least``), class_id (smallest id reachable by links).

    Ids are whole numbers; equal rows are copies of each other, and a row with a null id links with nothing and has a
    null class. A null text, or one without words, links with nothing. Ids should tell texts apart: rows with one id
    are one node. Hashes of n-grams have 64 bits. Other columns are ignored.
    """
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    needed = fewest(least)

    def sign(batches):
        for batch in batches:
            buf, offsets = words.texts(batch.column(1))
            for lo, hi, b, o in words.pieces(buf, offsets):
                value, at = shingles(b, o, n)
                size = np.diff(at)
                full = np.flatnonzero(size)
                cell = band_cells(signatures(value, at))
                cells_at = np.cumsum(np.concatenate([[0], np.where(size > 0, BANDS, 0)])).astype(np.int32)
                first = words.sums(value, at) if len(value) else np.zeros(hi - lo, np.int64)
                second = words.sums(words.mix(value ^ np.uint64(0xABCDEF)), at) if len(full) else np.zeros(hi - lo, np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(first.astype(np.int64)), pa.array(second.astype(np.int64)), pa.array(size.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(cells_at), pa.array(cell.ravel())),
                ], names=["doc_id", "one", "two", "size", "cells"])

    signed = stored(plain.mapInArrow(sign, "doc_id long, one long, two long, size long, cells array<long>"))
    same = ["one", "two", "size"]
    sound = signed.where("size > 0 and doc_id is not null")
    classes = settle(sound.groupBy(*same).agg(F.min(F.struct("doc_id", "cells")).alias("first"), F.count("*").alias("copies"))
                     .select(*same, F.col("first.doc_id").alias("class"), "first.cells", "copies"))
    entries = classes.select("class", F.explode("cells").alias("cell"))
    shared = entries.groupBy("cell").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("cell", "low")
    edges = entries.join(shared, "cell").where("class > low").select(F.col("class").alias("a"), F.col("low").alias("b"))
    groups = components(edges)
    sizes = groups.groupBy("root").agg(F.count("*").alias("members"))
    tiles = F.ceil(F.col("members") / F.lit(TILE)).cast("int")
    dealt = groups.join(sizes, "root").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    dealt = dealt.join(classes.select(F.col("class").alias("node"), "copies"), "node")
    full = plain.join(dealt, F.col("doc_id") == F.col("node")).select("root", F.col("node").alias("class"), "copies", "tiles", "tile", "text")
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    full = full.select("root", "class", "copies", "tile", "text", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"))
    found = settle(full.groupBy("root", "left", "right").applyInArrow(lambda t: compare(t, least, needed, n), "class long, links long, root long"))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    known = classes.select(*same, "class", "copies").join(links, "class", "left").join(joined.withColumnRenamed("node", "class"), "class", "left")
    known = known.select(*same, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "class").alias("class_id"))
    rest = signed.where("size = 0 or doc_id is null").select("doc_id", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"))
    return sound.select("doc_id", *same).join(known, same).select("doc_id", "n_links", "class_id").unionByName(rest)
