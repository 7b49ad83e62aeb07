"""Packing token sequences: documents are tokenised, cut where longer than a sequence, and placed by sums of squares."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.jobs import per_process, stored
from tidemark.llm.pieces import Generations

CAPACITY = 2048
#: Words whose ids a worker remembers, in each of two generations.
CACHE = 300_000
#: Documents packed by one task.
GROUP = 40_000
#: Bytes of texts that are tokenised at once.
PIECE = 1 << 20
#: Bytes of one text that are tokenised at once; a longer text is cut at white space.
STRETCH = 4 << 20


#: Bytes after which a word may be cut if a letter stands before: no tokenizer here joins a letter and these.
_MARK = np.zeros(256, bool)
_MARK[[33, 44, 46, 58, 59, 63]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Second bytes of the letters U+00C0 to U+00FF.
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False


class WordTokenizer:
    """Token ids of whole texts, word by word.

    For tokenizers that drop white space, never join words across it, and part letters from the marks behind
    them: a text's ids are then those of its words, without the marks, and of the marks. The ids of a word come
    from the tokenizer itself and are remembered. Words of one piece of text are told apart by 64-bit hashes,
    those of different pieces by their bytes.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # A special token between words keeps their ids apart, at a third of the time that single words take
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized]
        self.between, self.fence = special[-1] if special else (None, "")
        self.known = Generations(cache)

    def ids_of(self, new: list[bytes]) -> list[np.ndarray]:
        if self.between is None or any(b"<|" in x for x in new):
            return [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch([w.decode() for w in new], add_special_tokens=False)]
        out = []
        for lo in range(0, len(new), 2000):
            text = self.fence.join(w.decode() for w in new[lo : lo + 2000])
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
            at = np.flatnonzero(ids == self.between)
            out += [x[1:] if i else x for i, x in enumerate(np.split(ids, at))]
        return out

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the offsets of the texts in them."""
        raw = buf.tobytes()
        if b"<|" not in raw:  # capitals only make more different words, but can keep a text from naming a special token
            buf = words.LOWER[buf]
            raw = buf.tobytes()
        letter = np.zeros(len(buf), bool)
        letter[1:] = _LETTER[buf[:-1]]
        letter[2:] |= _SECOND[buf[1:-1]] & (buf[:-2] == 0xC3)
        start, end, first = words.spans(~words.SPACE[buf], offsets, np.flatnonzero(_MARK[buf] & letter))
        name = words.span_hashes(words.prefix(buf), start, end)
        _, one, which = np.unique(name, return_index=True, return_inverse=True)
        different = [raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
        ids = [self.known.get(x) for x in different]
        new = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(new, self.ids_of([different[i] for i in new]) if new else (), strict=True):
            ids[i] = x.tobytes()
            self.known.put(different[i], ids[i])
        size = np.array([len(x) // 4 for x in ids], np.int64)
        at = np.cumsum(size) - size
        out, id_at = words.gather(np.frombuffer(b"".join(ids), np.int32), at[which], size[which])
        return out, id_at[first]


def stretches(text: bytes):
    """A text in parts of about ``STRETCH`` bytes that end at white space."""
    lo = 0
    while lo < len(text):
        hi = lo + STRETCH
        while hi < len(text) and text[hi] not in b" \t\n\v\f\r":
            hi += 1
        yield text[lo:hi]
        lo = hi


def tokenize(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ends: int = 0, carry_ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, row, piece, start, length, ids_crc32 and, if asked, ids (little-endian unsigned 32-bit).

    A document is its ids and then ``ends``; a null or empty text is that one id. ``row`` tells documents
    with one id apart.
    """
    kind = next(f.dataType.simpleString() for f in docs.select(F.col(key)).schema)
    fields = f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * carry_ids

    def run(batches):
        tokenizer = per_process("words", path, lambda: WordTokenizer(path))
        row = TaskContext.get().partitionId() << 33
        last = np.array([ends], np.int32)
        for batch in batches:
            ids_of, column = batch.column(0), batch.column(1)
            buf, offsets = words.texts(column)
            for lo, hi, b, o in words.pieces(buf, offsets, PIECE):
                out: list[tuple] = []

                def cut(which: int, number: int, piece: int, start: int, ids: np.ndarray, whole: bool):
                    """Pieces of what is known of a document; the rest, unless it is whole."""
                    at = 0
                    while len(ids) - at >= capacity or whole and at < len(ids):
                        data = ids[at : at + capacity].tobytes()
                        out.append((which, number, piece, start + at, len(data) // 4, zlib.crc32(data), data))  # noqa: B023
                        piece, at = piece + 1, at + len(data) // 4
                    return piece, start + at, ids[at:]

                if hi - lo == 1 and len(b) > STRETCH:
                    piece, start, rest = 0, 0, np.zeros(0, np.int32)
                    for part in stretches(b.tobytes()):
                        ids, _ = tokenizer.encode(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
                        piece, start, rest = cut(lo, row, piece, start, np.concatenate([rest, ids]), False)
                    cut(lo, row, piece, start, np.concatenate([rest, last]), True)
                else:
                    ids, at = tokenizer.encode(b, o)
                    for i in range(hi - lo):
                        cut(lo + i, row + i, 0, 0, np.concatenate([ids[at[i] : at[i + 1]], last]), True)
                row += hi - lo
                which, number, piece, start, length, crc, data = zip(*out, strict=True)
                arrays = [ids_of.take(pa.array(which)), pa.array(number, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if carry_ids:
                    arrays.append(pa.array(data, pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in fields.split(", ")])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, fields)


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length, placed from long to short.

    A length goes into the open bin whose use leaves the sum of squared counts of open bins per residual gap
    smallest, and among those into the smallest gap; a new bin is opened only when none has room.
    """
    count = np.zeros(capacity + 1, np.int64)  # open bins by residual gap; full bins aren't open
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    which, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        here = count[size:capacity]
        gap = -1
        if here.any():
            # (n-1)^2 - n^2 for the gap left and (m+1)^2 - m^2 for the gap made
            change = -2 * here + 2 * count[: capacity - size]
            change[0] -= 1  # a filled bin leaves the sum
            gap = size + int(np.where(here > 0, change, np.iinfo(np.int64).max).argmin())
        if gap < 0:
            chosen, gap = made, capacity
            made += 1
        else:
            chosen = bins[gap].pop()
            count[gap] -= 1
        which[i], at[i] = chosen, capacity - gap
        if gap > size:
            bins[gap - size].append(chosen)
            count[gap - size] += 1
    return which, at


def pack(pieces: DataFrame, documents: int, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` in it.

    Full pieces are sequences of their own. The others, at most one for each document, are dealt over tasks of
    about ``GROUP`` documents by hash, and each task packs its own; that costs less than one sequence in a
    task. Sequence numbers only tell sequences apart.
    """
    groups = max(1, math.ceil(documents / GROUP))
    pieces = stored(pieces)  # read twice, and row numbers must not change
    names = pieces.columns
    full, short = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    alone = full.select("*", (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    dealt = short.withColumn("dealt", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))

    def run(group, table):
        order = np.lexsort((table["piece"].to_numpy(), table["row"].to_numpy()))
        table = table.take(pa.array(order))
        which, at = place(table["length"].to_numpy(), capacity)
        base = group[0].as_py() << 32
        return table.select(names).append_column("sequence_id", pa.array(which + base)).append_column("offset", pa.array(at))

    packed = dealt.groupBy("dealt").applyInArrow(run, alone.schema)
    return packed.unionByName(alone)
