"""Benchmark decontamination by latent semantic retrieval.

A candidate counts if the longest common subsequence of words, weighted by rarity, covers most of the item, or about
half of it and the item's answer stands there too, which finds paraphrases. Postings of the items' words bound that
weight for every window of every document, so nothing that could count is left out, however many items there are,
however long they are and however often they occur.

Windows of about the item's own length are checked whenever the bound allows it. Wider surroundings of a passage are
checked if the passage is near the item in a latent space as well: passages are TF-IDF vectors over hashed words, and
a randomised SVD of a group of items and all of the corpus's passages gives the space. Spark sums up once how the items'
words occur together in the passages; the SVD multiplies by that matrix, whose size the items limit.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.jobs import annotate, hashed_counts, stored

#: Places of hashed words.
TERMS = 1 << 18
#: A passage is three consecutive segments of so many words, from every segment on.
SEGMENT, SEGMENTS = 16, 3
#: Dimensions of a latent space, and items that share one, fewer than there are dimensions.
RANK, GROUP = 192, 128
#: Pairs of words in a passage that are sorted at once, those summed at once, and those sent in one row.
PAIRS, SUMMED, SENT = 1 << 21, 3 << 19, 1 << 16
#: Segments times items that are bounded at once, about, segments bounded together first, and how far sums of small numbers may be off.
CELLS, BLOCK, SLACK = 1 << 20, 8, 1e-3
#: Words of windows that are looked up, rows of a matrix multiplied, and bytes of text read, at once.
LOOKED, ROWS, PIECE = 1 << 18, 32, 1 << 17
#: Items compared in one pass over the documents; more make more passes.
ITEMS = 2000
#: Latent cosine of a candidate; share of an item's weight in order that counts alone; the share that counts with its answer, and that of the answer.
NEAR, COVERED, PARTLY, ANSWERED = 0.27, 0.8, 0.5, 0.8

_INNER = np.zeros(256, bool)
_INNER[48:58] = _INNER[65:91] = _INNER[97:123] = True
_INNER[128:] = True
_IS_INNER = _INNER.tobytes()
#: Numbers of bytes for hashes that do not tell A-Z from a-z.
_BYTE = words.BYTE[words.LOWER]


def terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of letters and digits, without case of A-Z), first word of every row, starts."""
    start, end, first = words.spans(np.frombuffer(buf.tobytes().translate(_IS_INNER), bool), offsets)
    return words.span_hashes(words.prefix(buf, _BYTE), start, end), first, start


def places(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def _term_places(column: pa.Array):
    for _, _, b, o in words.pieces(*words.texts(column)):
        yield places(terms(b, o)[0])


def segments(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the segments of all rows (and the end), and the first segment of every row."""
    size = np.diff(first)
    count = -(-size // SEGMENT)
    at = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(size)), count)
    return np.append(first[row] + (np.arange(at[-1]) - at[row]) * SEGMENT, n), at


@dataclass
class Space:
    """The latent space of a group of items."""

    column: np.ndarray  # of every hashed word its place among the group's words, or -1
    cosine: np.ndarray  # group's words x items: what a word of weight 1 adds to the product with the item's vector of length 1


@dataclass
class Index:
    """What a task needs to find one set of items."""

    ids: list
    weight: np.ndarray  # of every hashed word
    spaces: list[Space]  # of GROUP items each
    items: list[np.ndarray]  # word hashes of each item
    answers: list[np.ndarray]
    sizes: np.ndarray  # words of each item
    least: np.ndarray  # share of an item's weight that words of the postings must have
    column: np.ndarray  # of every hashed word its place among the postings, or -1
    first: np.ndarray  # first posting of every place
    item: np.ndarray
    share: np.ndarray  # of the item's weight, that the word has each time it stands there

    @cached_property
    def keys(self) -> np.ndarray:
        """Place and item of every posting as one number, in order."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * len(self.items) + self.item

    @cached_property
    def whole(self) -> np.ndarray:
        """Share of the item's weight that the word of every posting has in all its places there."""
        col = self.column[places(np.concatenate(self.items))]
        key = (col.astype(np.int64) * len(self.items) + np.repeat(np.arange(len(self.items)), self.sizes))[col >= 0]
        at, there = self.postings(key)
        return self.share * np.bincount(at[there], minlength=len(self.keys))

    def postings(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The posting of every key, and whether there is one."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, self.keys[at] == key


def answer_of(text: str) -> str:
    """The last sentence, or the second half of a single one."""
    parts = [x for x in text.replace("?", ".").replace("!", ".").replace("\n", ".").split(".") if x.strip()]
    if len(parts) > 1:
        return parts[-1]
    split = text.split()
    return " ".join(split[len(split) // 2 :])


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    h, first, _ = terms(*words.texts(pa.array(texts, pa.string())))
    return [h[first[i] : first[i + 1]] for i in range(len(texts))]


def summed(code: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order and the sums of their values. Runs in order are merged."""
    by = np.argsort(code, kind="stable")
    code = code[by]
    first = np.flatnonzero(np.append(np.ones(min(1, len(code)), bool), code[1:] != code[:-1]))
    return code[first], np.add.reduceat(value[by], first) if len(first) else value


def occurring(docs: DataFrame, text: str, total: int, weight: np.ndarray, column: np.ndarray, size: int) -> DataFrame:
    """(i, j, v): A'A for the matrix A of all passages, side by side, of all documents and the ``size`` words that have a ``column``.

    Each passage has length 1 over all of its words. One more row ``size`` holds the number of passages. ``total``: words of all documents.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((weight, column))
    parts = max(16, total >> 20)
    width = -(-(size * size + 1) // parts)

    def products(at, first, weight, column):
        """Codes of the pairs of words in each passage, and what they add, in 64 bits: 36 and 28."""
        start, row = segments(first, len(at))
        begin = start[:-1][(np.arange(row[-1]) - np.repeat(row[:-1], np.diff(row))) % SEGMENTS == 0]
        cut = np.append(begin, len(at))
        norm = np.sqrt(np.maximum(words.sums(weight[at].astype(float) ** 2, cut), 1e-9))
        mine = np.flatnonzero(column[at] >= 0)
        edge = np.searchsorted(mine, cut)
        passage = np.repeat(np.arange(len(cut) - 1), np.diff(edge))
        col, value = column[at[mine]].astype(np.int64), (weight[at[mine]] / norm[passage]).astype(np.float32)
        # By word inside each passage, each word once, so that the smaller word of a pair comes first
        word = passage * size + col
        by = np.argsort(word, kind="stable")
        word, value = word[by], value[by]
        once = np.flatnonzero(np.append(np.ones(min(1, len(word)), bool), word[1:] != word[:-1]))
        if not len(once):
            return
        value = np.add.reduceat(value, once)
        passage, col = np.divmod(word[once], size)
        length = np.searchsorted(passage, passage, "right") - np.arange(len(once))
        high, low = col * size << 28, col << 28
        for lo in range(0, len(once), 1 << 13):
            hi = min(lo + (1 << 13), len(once))
            each = length[lo:hi]
            own = np.cumsum(each) - each
            b = np.arange(each.sum()) + np.repeat(np.arange(lo, hi) - own, each)
            v = np.repeat(value[lo:hi], each) * value[b]
            code = np.repeat(high[lo:hi], each)
            code += low[b]
            code |= v.view(np.int32) >> 3
            yield code.view(np.uint64)

    def added(packed):
        x = np.concatenate(packed)
        x.sort()
        code = x >> np.uint64(28)
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        # The shifts leave the lower 28 bits, in their place
        value = (x.astype(np.uint32) << np.uint32(4) >> np.uint32(1)).view(np.float32)
        return code[first].astype(np.int64), np.add.reduceat(value, first, dtype=float)

    def run(batches):
        weight, column = shared.value
        held, n, packed, waiting, passages = [], 0, [], 0, 0

        def close(code, value):
            at = np.searchsorted(code, np.arange(parts + 1) * width)
            for i in np.flatnonzero(np.diff(at)).tolist():
                for lo in range(at[i], at[i + 1], SENT):
                    data = [x[lo : min(lo + SENT, at[i + 1])].tobytes() for x in (code, value)]
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], names=["part", "code", "value"])

        for batch in batches:
            for _, _, b, o in words.pieces(*words.texts(batch.column(0)), PIECE):
                h, first, _ = terms(b, o)
                passages += int((-(-np.diff(first) // (SEGMENT * SEGMENTS))).sum())
                for x in products(places(h), first, weight, column) if len(h) else ():
                    packed.append(x)
                    waiting += len(x)
                    if waiting > PAIRS:
                        held.append(added(packed))
                        n += len(held[-1][0])
                        packed, waiting = [], 0
                        if n > SUMMED:
                            held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                            n = len(held[0][0])
                            if n > SUMMED * 2 // 3:
                                yield from close(*held[0])
                                held, n = [], 0
        if waiting:
            held.append(added(packed))
        held.append((np.array([size * size]), np.array([float(passages)])))
        yield from close(*summed(*(np.concatenate(x) for x in zip(*held, strict=True))))

    def add(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for i, code, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(i, []).append((np.frombuffer(code, np.int64), np.frombuffer(value)))
        for i in list(held):
            code, value = summed(*(np.concatenate(x) for x in zip(*held.pop(i), strict=True)))
            for lo in range(0, len(code), SENT):
                c = code[lo : lo + SENT]
                yield pa.RecordBatch.from_arrays([pa.array(c // max(size, 1)), pa.array(c % max(size, 1)), pa.array(value[lo : lo + SENT])], names=["i", "j", "v"])

    # Sums are sent per task, so a task takes much text
    few = docs.select(text).coalesce(max(spark.sparkContext.defaultParallelism, total >> 23))
    half = stored(few.mapInArrow(run, "part int, code binary, value binary").repartition(parts, "part").mapInArrow(add, "i long, j long, v double"))
    mirrored = half.where((F.col("i") != F.col("j")) & (F.col("i") < size)).select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return stored(half.union(mirrored).repartition(16, "i").sortWithinPartitions("i"))


def product(pairs: DataFrame, place: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'AX for the columns X of ``basis``; ``pairs``: see ``occurring``; ``place``: of each of its rows the one in ``basis``, or -1."""
    shared = pairs.sparkSession.sparkContext.broadcast((place, basis.astype(np.float32)))
    columns = basis.shape[1]

    def multiplied(i, j, v, basis):
        """(i, row) of the entries' products: some rows at once as a matrix of the columns that they have."""
        first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(i))))
        at = np.zeros(len(basis), np.int64)
        for lo in range(0, len(first), ROWS):
            rows = min(ROWS, len(first) - lo)
            some = slice(first[lo], first[lo + rows] if lo + rows < len(first) else len(i))
            mine = np.zeros(len(basis), bool)
            mine[j[some]] = True
            col = np.flatnonzero(mine)
            at[col] = np.arange(len(col))
            matrix = np.bincount((row[some] - lo) * len(col) + at[j[some]], v[some], rows * len(col)).reshape(rows, len(col))
            out = matrix.astype(np.float32) @ basis[col]
            yield pa.RecordBatch.from_arrays([pa.array(i[first[lo : lo + rows]], pa.int32()), pa.array([x.tobytes() for x in out.astype(float)], pa.binary())], names=["i", "data"])

    def run(batches):
        place, basis = shared.value
        held, n = [], 0
        for batch in batches:
            i, j, v = (c.to_numpy() for c in batch.columns)
            i, j = place[i], place[j]
            mine = (i >= 0) & (j >= 0)
            held.append((i[mine], j[mine], v[mine]))
            n += len(held[-1][0])
            if n > LOOKED:
                yield from multiplied(*(np.concatenate(x) for x in zip(*held, strict=True)), basis)
                held, n = [], 0
        if n:
            yield from multiplied(*(np.concatenate(x) for x in zip(*held, strict=True)), basis)

    out = np.zeros((len(basis), columns))
    got = pairs.where(F.col("i") < len(place)).mapInArrow(run, "i int, data binary").toArrow()
    for i, data in zip(got["i"].to_pylist(), got["data"].to_pylist(), strict=True):
        out[i] += np.frombuffer(data)
    shared.unpersist()
    return out


def fit(pairs: DataFrame, n: int, known: np.ndarray, weight: np.ndarray, items: list[np.ndarray]) -> Space:
    """The latent space of some items and all ``n`` passages, each with half of the weight; ``known``: words that ``pairs`` are of."""
    term = np.unique(np.concatenate([places(x) for x in items]))
    column = np.full(TERMS, -1, np.int32)
    column[term] = np.arange(len(term))
    matrix = np.zeros((len(items), len(term)), np.float32)
    for i, x in enumerate(items):
        np.add.at(matrix[i], column[places(x)], weight[places(x)])
    matrix /= np.maximum(np.sqrt((matrix**2).sum(1, keepdims=True)), 1e-9)
    scale = len(items) / max(n, 1)
    # Randomised range finder with one power step, then the small eigenproblem inside that range
    rank = min(RANK + 8, len(term))
    basis = np.random.default_rng(3).standard_normal((len(term), rank))
    image = lambda x: matrix.T @ (matrix @ x) + scale * product(pairs, column[known], x)
    for _ in range(2):
        basis = np.linalg.qr(image(basis))[0]
    small = basis.T @ image(basis)
    _, vectors = np.linalg.eigh((small + small.T) / 2)
    loadings = basis @ vectors[:, ::-1][:, :RANK]
    latent = matrix @ loadings
    latent /= np.maximum(np.sqrt((latent**2).sum(1, keepdims=True)), 1e-9)
    return Space(column, (loadings @ latent.T).astype(np.float32))


def weights_of(weight: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Weight of every word of an item; none is without any."""
    return weight[places(item)].astype(float) + 1e-6


def build(docs: DataFrame, text: str, total: int, weight: np.ndarray, ids: list, texts: list[str]) -> Index:
    items, answers = word_hashes(texts), word_hashes([answer_of(t) for t in texts])
    place, item, share, least = [], [], [], np.zeros(len(items))
    for i, x in enumerate(items):
        at, one = np.unique(places(x), return_index=True)
        each = weights_of(weight, x)
        # Words without weight are left out, unless the item has no others
        heavy = weight[at] > 0 if (weight[at] > 0).any() else np.ones(len(at), bool)
        place.append(at[heavy])
        share.append(each[one][heavy] / each.sum())
        item.append(np.full(int(heavy.sum()), i))
        least[i] = PARTLY * (1 - SLACK) - each[~np.isin(places(x), at[heavy])].sum() / each.sum()
    place, item, share = np.concatenate(place), np.concatenate(item), np.concatenate(share)
    by = np.argsort(place, kind="stable")
    term, first = np.unique(place[by], return_index=True)
    column = np.full(TERMS, -1, np.int32)
    column[term] = np.arange(len(term))
    known = np.unique(np.concatenate([places(x) for x in items]))
    known = known[weight[known] > 0]
    numbers = np.full(TERMS, -1, np.int32)
    numbers[known] = np.arange(len(known))
    pairs = occurring(docs, text, total, weight, numbers, len(known))
    n = int(pairs.where(F.col("i") == len(known)).agg(F.sum("v")).first()[0] or 0)
    spaces = [fit(pairs, n, known, weight, items[lo : lo + GROUP]) for lo in range(0, len(items), GROUP)]
    return Index(ids, weight, spaces, items, answers, np.array([len(x) for x in items]), least, column, np.append(first, len(by)), item[by].astype(np.int32), share[by])


def common_length(masks: dict[int, int], passage: list[int], n: int) -> int:
    """Length of the longest common subsequence; masks: the places of each word in the item."""
    row = (1 << n) - 1
    for word in passage:
        m = masks.get(word)
        if m is not None:
            u = row & m
            row = (row + u) | (row - u)
    return n - bin(row & ((1 << n) - 1)).count("1")


def common_weight(item: np.ndarray, weight: np.ndarray, passage: np.ndarray) -> float:
    """Largest weight of a common subsequence."""
    best = np.zeros(len(item) + 1)
    for word in passage:
        hit = np.flatnonzero(item == word)
        if len(hit):
            fresh = best.copy()
            fresh[hit + 1] = np.maximum(fresh[hit + 1], best[hit] + weight[hit])
            best = np.maximum.accumulate(fresh)
    return float(best[-1])


def windows(index: Index) -> np.ndarray:
    """Segments that hold any 1.5 times the words of each item."""
    return -(-(index.sizes + index.sizes // 2 - 1) // SEGMENT) + 1


def bounds(index: Index, col: np.ndarray, start: np.ndarray, at: np.ndarray):
    """(segment, item, bound, wide) where an item could be, of windows of its own length and of a passage's surroundings.

    ``bound`` is the largest share of the item's weight that can stand in order from that segment on: what all the words
    there would have together. ``col``: the words' places among the postings; ``start``, ``at``: see ``segments``.
    """
    m, n = at[-1], len(index.items)
    row = words.row_of(at)
    begin, end = at[:-1][row], at[1:][row]
    # Items by size, so that those with windows of one kind are next to each other
    order = np.argsort(index.sizes, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    own, side, least = windows(index)[order], -(-index.sizes[order] // SEGMENT), index.least[order]
    most = int(max(own.max(), side.max() + SEGMENTS))
    span = lambda of, k: slice(*np.searchsorted(of, [k, k + 1]))
    kinds = [(span(own, k), 0, k, False) for k in np.unique(own)]
    kinds += [(span(side, k), k, k + SEGMENTS, True) for k in np.unique(side)]
    mine = np.flatnonzero(col >= 0)
    segment = np.searchsorted(start[1:], mine, "right")
    step = max(most, CELLS // n)
    line = rank[index.item]
    for lo in range(0, m, step):
        hi = min(m, lo + step)
        # Segments of the part and of all windows that begin in it, in blocks; a line for every item
        count, margin = -(-(hi - lo) // BLOCK), -(-most // BLOCK) + 1
        width = count + 2 * margin
        some = slice(*np.searchsorted(segment, [lo - most, hi + most]))
        c = col[mine[some]]
        length = index.first[c + 1] - index.first[c]
        posting = np.arange(length.sum()) + np.repeat(index.first[c] - np.cumsum(length) + length, length)
        place, share = np.repeat(segment[some] - lo + margin * BLOCK, length), index.share[posting]
        cell = line[posting] * width + place // BLOCK
        total = np.zeros((n, width + 1))
        np.cumsum(np.bincount(cell, share, n * width).reshape(n, width), axis=1, out=total[:, 1:])
        # Whole blocks around have no less than a window, whatever text they are of; the few that could do are summed by segment
        need, where = np.zeros((n, width), bool), []
        for which, before, after, _ in kinds:
            back, on = -(-before // BLOCK), (BLOCK - 2 + after) // BLOCK + 1
            bound = total[which, margin + on : margin + on + count] - total[which, margin - back : margin - back + count]
            i, block = np.nonzero(bound >= least[which, None] - 1e-9)
            where.append((i + which.start, block + margin))
            for k in range(-back, on):
                need[where[-1][0], where[-1][1] + k] = True
        number = np.cumsum(need) - 1
        mark = np.flatnonzero(need.ravel()[cell])
        total = np.bincount(number[cell[mark]] * BLOCK + place[mark] % BLOCK, share[mark], (number[-1] + 1) * BLOCK)
        total = np.append(0, np.cumsum(total))
        for (i, block), (_, before, after, wide) in zip(where, kinds, strict=True):
            s = ((block - margin)[:, None] * BLOCK + np.arange(lo, lo + BLOCK)).ravel()
            here = (number[i * width + block][:, None] * BLOCK + np.arange(BLOCK)).ravel()[s < hi]
            i, s = np.repeat(i, BLOCK)[s < hi], s[s < hi]
            bound = total[here + np.minimum(after, end[s] - s)] - total[here - np.minimum(before, s - begin[s])]
            hit = bound >= least[i]
            yield s[hit], order[i[hit]], bound[hit], wide


def looked(length: np.ndarray):
    """Slices of windows of so many words that have about ``LOOKED`` words together."""
    total, at = np.append(0, np.cumsum(length)), 0
    while at < len(length):
        end = max(at + 1, int(np.searchsorted(total, total[at] + LOOKED, "right")) - 1)
        yield slice(at, end)
        at = end


def cosines(index: Index, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Latent cosine of the words from ``lo`` to ``hi`` and the items."""
    out = np.zeros(len(lo))
    for g, space in enumerate(index.spaces):
        group = np.flatnonzero(item // GROUP == g)
        for some in looked((hi - lo)[group]):
            who = group[some]
            part, first = words.gather(h, lo[who], (hi - lo)[who])
            part = places(part)
            weight = index.weight[part]
            length = np.sqrt(np.maximum(words.sums(weight.astype(float) ** 2, first), 1e-9))
            mine = np.flatnonzero((space.column[part] >= 0) & (weight > 0))
            passage = np.searchsorted(first[1:], mine, "right")
            near = space.cosine[space.column[part[mine]], item[who][passage] - g * GROUP] * weight[mine]
            out[who] = np.bincount(passage, near, len(who)) / length
    return out


def there(index: Index, col: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Share of the items' weight that all of their words have that stand from ``lo`` to ``hi``; ``col``: see ``bounds``."""
    out = np.zeros(len(lo))
    for some in looked(hi - lo):
        part, first = words.gather(col, lo[some], (hi - lo)[some])
        mine = np.flatnonzero(part >= 0)
        window = np.searchsorted(first[1:], mine, "right")
        at, known = index.postings(part[mine].astype(np.int64) * len(index.items) + item[some][window])
        # A word counts once in a window
        both = np.sort(window[known] * len(index.keys) + at[known])
        window, at = np.divmod(both[np.append(np.ones(min(1, len(both)), bool), both[1:] != both[:-1])], len(index.keys))
        out[some] = np.bincount(window, index.whole[at], len(first) - 1)
    return out


def candidates(index: Index, h: np.ndarray, first: np.ndarray):
    """(row, item, first and end word, bound) of all windows and surroundings of passages that could hold an item."""
    start, at = segments(first, len(h))
    row = words.row_of(at)
    out = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0),)]
    if not at[-1]:
        return out[0]
    col = index.column[places(h)]
    end = first[1:][row]
    last = at[1:][row]
    own = windows(index)
    for s, item, bound, wide in bounds(index, col, start, at):
        if wide:
            # Segments of one row are next to each other
            near = cosines(index, h, start[s], np.minimum(start[s] + SEGMENT * SEGMENTS, end[s]), item) >= NEAR
            s, item, bound = s[near], item[near], bound[near]
            lo = np.maximum(first[:-1][row[s]], start[s] - index.sizes[item])
            hi = np.minimum(end[s], start[s] + SEGMENT * SEGMENTS + index.sizes[item])
        else:
            lo, hi = start[s], np.minimum(start[s] + SEGMENT * np.minimum(own[item], last[s] - s), end[s])
        held = there(index, col, lo, hi, item) >= index.least[item]
        out.append(tuple(x[held] for x in (row[s], item, lo, hi, bound)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def check(index: Index, h: np.ndarray, first: np.ndarray, masks: list[dict[int, int]]):
    """Per row and item that the row contains: (row, item, cosine, covered, answered, first and end word)."""
    found: dict[tuple[int, int], tuple] = {}
    known: dict[int, tuple] = {}
    row, item, lo, hi, bound = candidates(index, h, first)
    by = np.lexsort((lo, -bound, item, row))
    for row, item, lo, hi, bound in zip(*(x[by].tolist() for x in (row, item, lo, hi, bound)), strict=True):
        old = found.get((row, item))
        if old is not None and old[0] >= min(1.0, bound) - 1e-6:
            continue
        if item not in known:
            weight = weights_of(index.weight, index.items[item])
            known[item] = index.items[item].tolist(), weight, weight.sum()
        passage, mine, answer = h[lo:hi], index.items[item], index.answers[item]
        listed, weight, whole = known[item]
        there = set(passage.tolist())
        if (weight * np.array([x in there for x in listed])).sum() < PARTLY * whole:
            continue
        of = weights_of(index.weight, answer)
        answered = float((of * np.array([x in there for x in answer.tolist()])).sum() / of.sum()) if len(answer) else 0.0
        # So few words in order cannot be enough, were they the heaviest
        enough = (PARTLY if answered >= ANSWERED else COVERED) * whole
        least = int(np.searchsorted(np.cumsum(np.sort(weight)[::-1]), enough * (1 - 1e-9))) + 1
        if common_length(masks[item], passage.tolist(), len(mine)) < least:
            continue
        covered = common_weight(mine, weight, passage) / whole
        if covered >= COVERED or covered >= PARTLY and answered >= ANSWERED:
            if old is None or covered > old[0]:
                found[row, item] = (covered, answered, lo, hi)
    pairs = sorted(found)
    if not pairs:
        return []
    cosine = cosines(index, h, *(np.array(x) for x in zip(*(found[k][2:] for k in pairs), strict=True)), np.array([k[1] for k in pairs]))
    return [(*k, c, *found[k][:2], *(int(x - first[k[0]]) for x in found[k][2:])) for k, c in zip(pairs, cosine.tolist(), strict=True)]


FIELDS = "matches array<struct<item_id:{kind},cosine:double,covered:double,answered:double,first_word:long,end_word:long>>"


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", carry: bool = True) -> DataFrame:
    """``docs`` with ``matches``, the benchmark items that a text contains as a whole or paraphrased, by item.

    Whole texts are searched. A null or empty text matches nothing, nor does an item that is null or has no word; items
    with equal ids are separate. Word frequencies come from all documents. A column ``matches`` is replaced; unless
    ``carry``, the text is dropped.
    """
    spark = docs.sparkSession
    kind = next(f.dataType.simpleString() for f in benchmark.schema if f.name == item)
    counts = hashed_counts(docs, text, TERMS, _term_places)
    total = int(counts.sum())
    # Words much more frequent than every 300th weigh nothing
    weight = np.log1p((total + 1.0) / (300.0 * (counts + 1.0))).astype(np.float32)
    weight[weight < 0.05 * weight.max()] = 0
    known = benchmark.select(F.col(item).alias("id"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    out, block, done = docs, [], False

    def search(out: DataFrame, block: list, last: bool) -> DataFrame:
        sized = [(r.id, r.t) for r in block if len(word_hashes([r.t])[0])]
        index = build(docs, text, total, weight, [x for x, _ in sized], [t for _, t in sized]) if sized else None
        shared = spark.sparkContext.broadcast(index)

        def make():
            index = shared.value
            masks = []
            for x in index.items if index else []:
                m: dict[int, int] = {}
                for i, w in enumerate(x.tolist()):
                    m[w] = m.get(w, 0) | 1 << i
                masks.append(m)

            def step(buf, offsets):
                h, first, _ = terms(buf, offsets)
                found = check(index, h, first, masks) if index else []
                at = np.searchsorted([x[0] for x in found], np.arange(len(offsets))) if found else np.zeros(len(offsets))
                columns = list(zip(*found, strict=True)) or [()] * 7
                kinds = [pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                values = [pa.array([index.ids[i] for i in columns[1]], arrow_kind)] + [pa.array(c, k) for c, k in zip(columns[2:], kinds, strict=True)]
                span = pa.StructArray.from_arrays(values, ["item_id", "cosine", "covered", "answered", "first_word", "end_word"])
                return (pa.ListArray.from_arrays(pa.array(np.asarray(at, np.int32)), span),)

            return step

        return annotate(out, text, FIELDS.format(kind=kind), make, carry or not last, PIECE)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(benchmark.schema[item].dataType)
    rows = known.toLocalIterator()
    earlier = None
    while not done:
        block = []
        for r in rows:
            block.append(r)
            if len(block) == ITEMS:
                break
        done = len(block) < ITEMS
        if block or earlier is None:
            out = search(out if earlier is None else out.withColumnRenamed("matches", "_earlier"), block, done)
            if earlier is not None:
                out = out.withColumn("matches", F.concat("_earlier", "matches")).drop("_earlier")
            earlier = True
        elif not carry:
            out = out.drop(text)
    return out
