"""Language-model scoring by online logistic context mixing.

Texts are byte streams of their words. Each bit of a byte is predicted by several tables of bit counts, one per kind
of context, found under a hash of the context and the bits before. The predictions, as logits, are summed with
weights that two gates choose, and an adaptive map refines the result. Counts, weights and map come from all training
texts. Spark merges their different contexts into slices by hash, each with how often it occurs; the slices learn online
side by side from the same start, and the mean of what they have learnt starts the next round. The finished model is
fixed, so a text's score does not depend on the order in which texts are read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.jobs import SLICES, blocks, per_process, stored

#: Longest context in bytes; kinds of context: the last 1 to ORDER bytes, and the word so far.
ORDER = 5
KINDS = ORDER + 1
#: Places of hashed (context, bits before) for each kind.
SLOTS = 1 << 21
#: Contexts that a task merges at once, those sent in one row, and bytes of text whose contexts make a slice, about.
MERGED, SENT, SHARE = 3 << 19, 1 << 16, 8 << 20
EPOCHS, BATCH, RATE = 2, 2048, 0.03
#: Levels of the adaptive map.
LEVELS = 33
#: Costs of bytes, and of words after what is before them, that a worker remembers.
CACHE = 1 << 21
BLOCK = 8 << 20
END, GAP = 10, 32


def stream(buf: np.ndarray, offsets: np.ndarray):
    """Bytes to be predicted: words in lower case (A-Z), a space between two, a line end after the last; row offsets."""
    low = np.append(words.LOWER[buf], np.uint8(GAP))
    start, end, first = words.words(low[:-1], offsets)
    count = np.diff(first)
    row = np.concatenate([words.row_of(first), np.flatnonzero(count == 0)])
    by = np.argsort(row, kind="stable")
    start = np.concatenate([start, np.zeros(int((count == 0).sum()), np.int64)])[by]
    length = np.concatenate([end, np.zeros(int((count == 0).sum()), np.int64)])[by] - start
    flat, at = words.gather(low, start, length + 1)
    flat[at[1:] - 1] = GAP
    row_at = np.concatenate([[0], np.cumsum(np.maximum(count, 1))])
    flat[at[row_at[1:]] - 1] = END
    return flat, at[row_at], at


def keys(flat: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    """For every byte, a number made of the ORDER bytes before it and itself."""
    n = len(flat)
    padded = np.concatenate([np.zeros(7, np.uint8), flat])
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64) & np.uint64((1 << 8 * (ORDER + 1)) - 1)
    for j in range(ORDER):  # nothing is known from before the text
        at = row_at[:-1] + j
        at = at[at < row_at[1:]]
        unknown = sum(END << 8 * k for k in range(j + 1, ORDER + 1))
        key[at] = key[at] & np.uint64((1 << 8 * (j + 1)) - 1) | np.uint64(unknown)
    return key


def expand(key: np.ndarray, running: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Keys of the bytes of some words, hashes of their words so far, and the first byte of each word."""
    at, first = words.gather(np.arange(len(key)), start, end - start)
    return key[at], words.span_hashes(running, np.repeat(start, end - start), at), first


def contexts(flat: np.ndarray, row_at: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte, a number made of the ORDER bytes before it and itself, and a hash of its word so far."""
    return expand(keys(flat, row_at), words.prefix(flat), word_at[:-1], word_at[1:])[:2]


def placed(key: np.ndarray, running: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    """64-bit name of every word with its end and the ORDER bytes before it, which all contexts of its bytes follow from."""
    return together(key[word_at[:-1]] >> np.uint64(8), words.span_hashes(running, word_at[:-1], word_at[1:]))


def together(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One 64-bit name of both."""
    return words.mix(key * np.uint64(0xD6E8FEB86659FD93) + word)


def groups(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the names, and where each of them begins in it.

    Numbers sort faster than places do, so each place takes the low bits of its name; names that share all others are put in order after that.
    """
    if not len(name):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.uint64((1 << len(name).bit_length()) - 1)
    packed = np.sort(name & ~low | np.arange(len(name), dtype=np.uint64))
    by = (packed & low).view(np.int64)
    name = name[by]
    differ = name[1:] != name[:-1]
    mixed = np.flatnonzero(differ & (packed[1:] ^ packed[:-1] <= low))
    if len(mixed):
        high = packed & ~low
        lo, hi = np.searchsorted(high, np.unique(high[mixed])), np.searchsorted(high, np.unique(high[mixed]), "right")
        at, _ = words.gather(np.arange(len(by)), lo, hi - lo)
        by[at] = by[at][np.argsort(name[at], kind="stable")]
        name[at] = np.sort(name[at])
        differ = name[1:] != name[:-1]
    return by, np.flatnonzero(np.append(True, differ))


def distinct(key: np.ndarray, word: np.ndarray, n: np.ndarray):
    """Different contexts with their byte, by name, and how often each is there."""
    by, first = groups(together(key, word))
    one = by[first]
    return key[one], word[one], np.add.reduceat(n[by], first) if len(first) else n


def counted(buf: np.ndarray, offsets: np.ndarray):
    """Different contexts of some texts, and how often each is there; words in the same place are taken together first."""
    flat, row_at, word_at = stream(buf, offsets)
    key, running = keys(flat, row_at), words.prefix(flat)
    by, first = groups(placed(key, running, word_at))
    one, n = by[first], np.diff(np.append(first, len(by)))
    key, word, at = expand(key, running, word_at[:-1][one], word_at[1:][one])
    return distinct(key, word, np.repeat(n, np.diff(at)))


def kinds(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of every kind of context of some keys: KINDS x keys."""
    context = key >> np.uint64(8)
    out = np.empty((KINDS, len(key)), np.uint64)
    for i in range(ORDER):
        out[i] = words.mix((context & np.uint64((1 << 8 * (i + 1)) - 1)) * np.uint64(words.BASE) + np.uint64(i))
    out[ORDER] = words.mix(word + np.uint64(ORDER))
    return out


def bits(hashes: np.ndarray, byte: np.ndarray):
    """(node, bit, places) for each of the eight bits, highest first; ``hashes``: see ``kinds``.

    A node is 1 and the bits before; places are those of (context, bits before) in the tables of all kinds, one after the other.
    Those of half a byte lie among 16 next to each other, so that memory is fetched twice a byte and not eight times.
    """
    byte = byte.astype(np.int64)
    table = np.arange(KINDS)[:, None] * SLOTS
    for half in (0, 4):
        if half:
            hashes = (hashes + ((byte >> 4) + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
        run = (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).view(np.int64)
        run += table
        for j in range(4):
            left = 8 - half - j
            node = byte >> left | 1 << half + j
            yield node, byte >> left - 1 & 1, run ^ (node & (1 << j) - 1 | 1 << j)


def logits() -> tuple[np.ndarray, np.ndarray]:
    """Of every pair of small counts (zeros, ones * 256) its logit, and how sure the larger count makes, in four steps.

    Then of all pairs less a zero of their own, and of all pairs less a one; what is more than 32 stays.
    """
    log = np.log(words.COUNT + 0.4).astype(np.float32)
    sure = np.digitize(words.COUNT, [1, 4, 32]).astype(np.uint8)
    pair = np.arange(1 << 16)
    zeros, ones = pair & 255, pair >> 8
    less = lambda n: np.where((n > 0) & (n <= 32), n - 1, n)
    cases = [(zeros, ones), (less(zeros), ones), (zeros, less(ones))]
    return np.concatenate([log[o] - log[z] for z, o in cases]), np.concatenate([sure[np.maximum(z, o)] for z, o in cases])


@dataclass
class Model:
    tables: np.ndarray  # kinds x slots x (zeros, ones), small counts
    by_node: np.ndarray = field(default_factory=lambda: np.full((256, KINDS + 1), 0.15))
    by_trust: np.ndarray = field(default_factory=lambda: np.full((4**3, KINDS + 1), 0.15))
    refined: np.ndarray = field(default_factory=lambda: np.tile(np.linspace(-8, 8, LEVELS), (256, 1)))
    name: str = field(default_factory=lambda: uuid4().hex)

    def __post_init__(self):
        self.logit, self.sure = logits()

    def __getstate__(self):
        state = {k: v for k, v in self.__dict__.items() if k not in ("logit", "sure")}
        return state | {"tables": (self.tables.shape, zlib.compress(self.tables.tobytes(), 1))}

    def __setstate__(self, state):
        shape, data = state["tables"]
        self.__dict__ |= state | {"tables": np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape)}
        self.__post_init__()

    def inputs(self, places: np.ndarray, own: np.ndarray | None = None):
        """Logits of all kinds and a constant, and the gate chosen by how much the longest contexts have seen; own: bits not to count."""
        at = self.tables.view("<u2").ravel().take(places)
        if own is not None:
            at = at + (own + 1 << 16)
        x = np.empty((KINDS + 1, places.shape[1]), np.float32)
        x[:KINDS] = self.logit.take(at)
        x[KINDS] = 0.3
        first, second, third = self.sure.take(at[ORDER - 2 :])
        return x, first << 4 | second << 2 | third

    def gates(self) -> np.ndarray:
        """Weights of all inputs for every (node, trust)."""
        return np.ascontiguousarray((self.by_node[:, None] + self.by_trust[None]).reshape(-1, KINDS + 1).T.astype(np.float32))

    def mixed(self, x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        weight *= x
        return np.clip(weight.sum(0), -12, 12)

    def level(self, logit: np.ndarray):
        at = np.clip((logit + 8) * ((LEVELS - 1) / 16), 0, LEVELS - 1.001)
        low = at.astype(np.int64)
        return low, at - low

    def refine(self, logit: np.ndarray, node: np.ndarray, refined: np.ndarray):
        low, part = self.level(logit)
        low += node * LEVELS
        left = refined.take(low)
        low += 1
        return 0.5 * (logit + left + (refined.take(low) - left) * part)

    def learn(self, key: np.ndarray, word: np.ndarray, count: np.ndarray, epoch: int) -> np.ndarray:
        """What contexts that stand ``count`` times each teach, one online step per batch of bits; this model stays as it is.

        The gates and the map, each cell times the weight of what it has seen, and then these weights.
        """
        gates = self.by_node.T.copy(), self.by_trust.T.copy()
        mine = Model(self.tables, self.by_node, self.by_trust, self.refined.copy(), self.name)
        squares = [np.ones(g.shape) for g in gates]
        seen = [np.zeros(g.shape[1]) for g in gates] + [np.zeros(self.refined.shape)]
        rate = RATE / (1 + epoch)
        order = np.random.default_rng(9 + epoch).permutation(len(key))
        mean = count.sum() / max(len(count), 1)
        every = np.arange(KINDS + 2)[:, None]
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            hashes, weight = kinds(key[some], word[some]), count[some] / mean
            step = np.empty((KINDS + 2, len(some)))
            step[KINDS + 1] = weight
            for where, bit, places in bits(hashes, key[some] & np.uint64(255)):
                x, trust = self.inputs(places, bit)
                logit = self.mixed(x, gates[0].take(where, 1) + gates[1].take(trust, 1))
                np.multiply((bit - 1 / (1 + np.exp(-logit))) * weight, x, out=step[: KINDS + 1])
                for gate, at, square, of in zip(gates, (where, trust), squares, seen):
                    width = len(of)
                    total = np.bincount((every * width + at).ravel(), step.ravel(), len(step) * width).reshape(-1, width)
                    steep = total[:-1]
                    square += steep * steep
                    gate += rate * steep / np.sqrt(square)
                    of += total[-1]
                low, part = mine.level(logit)
                cell = where * LEVELS + np.where(part < 0.5, low, low + 1)
                off = bit - 1 / (1 + np.exp(-mine.refined.take(cell)))
                heavy, far = np.bincount(cell, weight, mine.refined.size), np.bincount(cell, weight * off, mine.refined.size)
                at = np.flatnonzero(heavy)
                # However often a context stands, a cell goes no farther than it is off
                mine.refined.ravel()[at] += far[at] / heavy[at] * -np.expm1(-rate * heavy[at])
                seen[2].ravel()[at] += heavy[at]
        learnt = [gate.T * of[:, None] for gate, of in zip(gates, seen)] + [mine.refined * seen[2]]
        return np.concatenate([x.ravel() for x in learnt + seen])

    def take(self, total: np.ndarray) -> None:
        """Goes on with the mean of what was learnt, from sums of ``learn``; cells that saw nothing stay."""
        own = self.by_node, self.by_trust, self.refined
        sizes = [x.size for x in own] + [len(self.by_node), len(self.by_trust)]
        parts = np.split(total, np.cumsum(sizes))
        for x, learnt, seen in zip(own, parts[:3], parts[3:], strict=True):
            seen = seen.reshape(x.shape) if seen.size == x.size else np.repeat(seen[:, None], x.shape[1], 1)
            x[:] = np.where(seen > 0, learnt.reshape(x.shape) / np.maximum(seen, 1e-300), x)

    def costs(self, key: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log10 of the probability of each key's byte after its context."""
        gates, refined = self.gates(), self.refined.astype(np.float32)
        some = [slice(lo, lo + 8192) for lo in range(0, len(key), 8192)]
        return np.concatenate([self.cost(key[x], word[x], gates, refined) for x in some] or [np.zeros(0)])

    def cost(self, key: np.ndarray, word: np.ndarray, gates: np.ndarray, refined: np.ndarray) -> np.ndarray:
        hashes = kinds(key, word)
        total = np.ones(len(key))
        for node, bit, places in bits(hashes, key & np.uint64(255)):
            x, trust = self.inputs(places)
            logit = self.refine(self.mixed(x, gates.take(node * len(self.by_trust) + trust, 1)), node, refined)
            # Logits are at most 12, so the product of eight is no larger than exp(97)
            total *= 1 + np.exp(np.where(bit == 1, -logit, logit).astype(float))
        return -np.log10(total)


class Memory:
    """Costs found under 64-bit names; of names that want one place, the last has it."""

    def __init__(self):
        self.name, self.cost = np.zeros(CACHE, np.uint64), np.zeros(CACHE)

    def get(self, name: np.ndarray, make) -> np.ndarray:
        """Costs of all names; ``make`` finds those of some places in ``name``."""
        at = (name & np.uint64(CACHE - 1)).astype(np.int64)
        cost = self.cost[at]
        missing = np.flatnonzero(self.name[at] != name)
        if len(missing):
            by, first = groups(name[missing])
            one = missing[by[first]]
            fresh = make(one)
            cost[missing[by]] = np.repeat(fresh, np.diff(np.append(first, len(by))))
            self.name[at[one]], self.cost[at[one]] = name[one], fresh
        return cost


class Scorer:
    """Costs of texts with a memory; the same word after the same bytes costs the same everywhere."""

    def __init__(self, model: Model):
        self.model, self.words, self.bytes = model, Memory(), Memory()

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        flat, row_at, word_at = stream(buf, offsets)
        key, running = keys(flat, row_at), words.prefix(flat)

        def cost(some):
            k, w, first = expand(key, running, word_at[:-1][some], word_at[1:][some])
            new = lambda one: self.model.costs(k[one], w[one])
            return words.sums(self.bytes.get(together(k, w), new), first)

        return words.sums(self.words.get(placed(key, running, word_at), cost), np.searchsorted(word_at, row_at))


def merge(texts: DataFrame, size: int) -> DataFrame:
    """All different contexts of the column ``text`` and how often each stands there, by slice and name.

    ``size``: bytes of text. The slices do not depend on how the texts are partitioned.
    """
    slices = max(1, size // SHARE)
    border = np.array([(i << 64) // slices for i in range(1, slices)], np.uint64)
    names = ["slice", "key", "word", "n"]

    def together_of(held):
        return distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def run(batches):
        held, n = [], 0
        per_process("mixing", "", lambda: None)  # an earlier model's scorer is not needed any more

        def close():
            at = np.concatenate([[0], np.searchsorted(together(*held[0][:2]), border), [len(held[0][0])]])
            for i in np.flatnonzero(np.diff(at)).tolist():
                for lo in range(at[i], at[i + 1], SENT):
                    data = [x[lo : min(lo + SENT, at[i + 1])].tobytes() for x in held[0]]
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], names=names)

        for batch in batches:
            for _, _, b, o in words.pieces(*words.texts(batch.column(0)), 1 << 20):
                held.append(counted(b, o))
                n += len(held[-1][0])
                if n > MERGED:
                    held = [together_of(held)]
                    n = len(held[0][0])
                    if n > MERGED * 2 // 3:
                        yield from close()
                        held, n = [], 0
        if held:
            held = [together_of(held)]
            yield from close()

    def add(batches):
        now, held = None, []

        def close():
            contexts = together_of(held)
            for lo in range(0, len(contexts[0]), SENT):
                some = [pa.array(x[lo : lo + SENT].view(np.int64)) for x in contexts]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some[0]), now, np.int32)), *some], names=names)

        for batch in batches:
            for i, *contexts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and i != now:
                    yield from close()
                    held = []
                now = i
                held.append([np.frombuffer(x, k) for x, k in zip(contexts, (np.uint64, np.uint64, np.int64), strict=True)])
        if now is not None:
            yield from close()

    few = texts.select("text").coalesce(max(texts.sparkSession.sparkContext.defaultParallelism, size >> 26))
    sent = few.mapInArrow(run, "slice int, key binary, word binary, n binary").repartition(slices, "slice")
    return stored(sent.sortWithinPartitions("slice").mapInArrow(add, "slice int, key long, word long, n long"))


def contexts_of(batches):
    """(key, word, n) of every slice of ``merge``, whose rows follow each other."""
    now, held = None, []
    close = lambda: [np.concatenate(x).view(k) for x, k in zip(zip(*held, strict=True), (np.uint64, np.uint64, np.int64), strict=True)]
    for batch in batches:
        i, *columns = (c.to_numpy() for c in batch.columns)
        cuts = np.flatnonzero(i[1:] != i[:-1]) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)], strict=True):
            if hi > lo:
                if held and i[lo] != now:
                    yield close()
                    held = []
                now = i[lo]
                held.append([c[lo:hi] for c in columns])
    if held:
        yield close()


def tabulate(merged: DataFrame, size: int) -> np.ndarray:
    """The tables of all kinds, in small counts: 2 x KINDS x SLOTS bytes whatever the corpus.

    Every task fills tables of its own and sends them in one byte a place.
    """
    cells = 2 * SLOTS
    width = cells // SLICES

    def run(batches):
        table = np.zeros((KINDS, cells), np.float32)
        for key, word, n in contexts_of(batches):
            n = n.astype(np.float32)
            for lo in range(0, len(key), 8192):
                some = slice(lo, lo + 8192)
                times = np.tile(n[some], KINDS)
                for _, bit, places in bits(kinds(key[some], word[some]), key[some] & np.uint64(255)):
                    np.add.at(table.ravel(), (places * 2 + bit).ravel(), times)
        for kind in range(KINDS):
            for i in range(SLICES):
                mine = table[kind, i * width : (i + 1) * width]
                if mine.any():
                    yield pa.RecordBatch.from_arrays([pa.array([kind * SLICES + i], pa.int32()), pa.array([words.small(mine).tobytes()], pa.binary())], names=["slice", "n"])

    def add(batches):
        now, total = None, np.zeros(width)

        def close():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([words.small(total).tobytes()], pa.binary())], names=["slice", "n"])

        for batch in batches:
            for i, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is not None and i != now:
                    yield close()
                    total[:] = 0
                now = i
                total += words.COUNT[np.frombuffer(n, np.uint8)]
        if now is not None:
            yield close()

    # Tables are sent per task, so a task takes many contexts
    few = merged.coalesce(max(merged.sparkSession.sparkContext.defaultParallelism, size >> 28))
    parts = few.mapInArrow(run, "slice int, n binary")
    summed = parts.repartition(SLICES // 4, "slice").sortWithinPartitions("slice").mapInArrow(add, "slice int, n binary").toArrow()
    out = np.zeros(KINDS * cells, np.uint8)
    for i, n in zip(summed["slice"].to_pylist(), summed["n"].to_pylist(), strict=True):
        out[i * width : (i + 1) * width] = np.frombuffer(n, np.uint8)
    return out.reshape(KINDS, SLOTS, 2)


def learn(merged: DataFrame, model: Model, epoch: int) -> None:
    """One round over all contexts: every slice learns from where ``model`` is, which then takes the mean of all."""
    shared = merged.sparkSession.sparkContext.broadcast(model)

    def total(arrays):
        out = None
        for x in arrays:
            out = x if out is None else out + x
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["learnt"])

    def run(batches):
        yield from total(shared.value.learn(*x, epoch) for x in contexts_of(batches))

    def add(batches):
        yield from total(np.frombuffer(x) for batch in batches for x in batch.column(0).to_pylist())

    got = merged.mapInArrow(run, "learnt binary").repartition(4).mapInArrow(add, "learnt binary").toArrow()["learnt"]
    shared.unpersist()
    if len(got):
        model.take(sum(np.frombuffer(x) for x in got.to_pylist()))


def train(texts: DataFrame, text: str = "text") -> Model:
    """A model of all texts. A null text counts as empty; no texts give a model that knows nothing."""
    plain = texts.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = plain.select(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    merged = merge(plain, size)
    model = Model(tabulate(merged, size))
    for epoch in range(EPOCHS):
        learn(merged, model, epoch)
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", held: str = "held_out") -> DataFrame:
    """Per row of ``docs``: its id and ``held``, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the model's log10 probability of the text's words and its end, ``base_score`` that of single words with
    their add-half frequencies in the rows of ``docs`` that are not ``held``. Words are told apart by 64-bit hashes. Whole texts count; a null text is empty, and
    has its end only. Rows may repeat. Other columns are dropped.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(held).alias(held))
    dealt, _ = blocks(plain, key, "_text", BLOCK)

    def vocabulary(table: pa.Table):
        """Texts of a block, a 64-bit hash of each word, and the first word of each row."""
        buf, offsets = words.texts(table["_text"])
        name, first, done = [], [np.zeros(1, np.int64)], 0
        for _, _, b, o in words.pieces(buf, offsets):
            low = words.LOWER[b]
            start, end, at = words.words(low, o)
            name.append(words.span_hashes(words.prefix(low), start, end))
            first.append(at[1:] + done)
            done += len(start)
        return buf, offsets, np.concatenate(name), np.concatenate(first)

    def numbered(name):
        """Different names in their order, and the number of each name among them."""
        by, at = groups(name)
        which = np.empty(len(name), np.int32)
        which[by] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.append(at, len(by))))
        return name[by[at]], which

    def emit(group, table):
        _, _, name, first = vocabulary(table)
        learnt = ~table[held].combine_chunks().to_numpy(zero_copy_only=False)
        different, which = numbered(name)
        n = np.bincount(which, weights=np.repeat(learnt, np.diff(first)).astype(float), minlength=len(different))
        return pa.table({
            "token": pa.array(different.view(np.int64)), "block": pa.array(np.full(len(different), group[0].as_py(), np.int32)),
            "number": pa.array(np.arange(len(different), dtype=np.int32)), "n": pa.array(n.astype(np.int64))})

    # A word has one row per block at most, however frequent it is
    tokens = dealt.groupBy("block").applyInArrow(emit, "token long, block int, number int, n long")
    by = Window.partitionBy("token")
    counted = tokens.withColumn("c", F.sum("n").over(by)).where("c > 0").withColumn("lead", F.row_number().over(by.orderBy("block")) == 1)
    totals = Observation()
    counted = stored(counted.observe(totals, F.sum("n").alias("n"), F.count_if("lead").alias("v")).select("block", "number", "c"))
    learnt = plain.where(~F.col(held)).count()
    n, v = (totals.get["n"] or 0) + learnt, (totals.get["v"] or 0) + (learnt > 0)
    shared = spark.sparkContext.broadcast(model)
    columns = plain.columns

    def finish(group, left, right):
        scorer = per_process("mixing", shared.value.name, lambda: Scorer(shared.value))
        left = left.select(columns).combine_chunks()
        buf, offsets, name, first = vocabulary(left)
        different, which = numbered(name)
        c = np.zeros(len(different), np.int64)
        c[right["number"].to_numpy()] = right["c"].to_numpy()
        below = math.log10(n + 0.5 * (v + 1))
        base = words.sums((np.log10(c + 0.5) - below)[which], first) + math.log10(learnt + 0.5) - below
        n_tokens = np.diff(first) + 1
        known = words.sums((c > 0).astype(np.int64)[which], first) + (learnt > 0)
        del name, different, which
        own = np.concatenate([scorer.score(b, o) for _, _, b, o in words.pieces(buf, offsets)])
        rows = left.num_rows
        return pa.table({
            columns[0]: left[columns[0]], held: left[held], "n_tokens": pa.array(n_tokens),
            "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(rows, n)), "base_score": pa.array(base), "score": pa.array(own)})

    kind = next(f.dataType.simpleString() for f in plain.schema if f.name == columns[0])
    return dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(
        finish, f"{columns[0]} {kind}, {held} boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
