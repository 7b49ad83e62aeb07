"""SentencePiece encoding and decoding of merge-type (BPE) models, exact and without the library in tasks.

A text is cut where no piece of the vocabulary has the two neighbouring characters side by side: nothing is ever merged
there. Every different segment of a batch is encoded once, by backtracking. Aho-Corasick gives the longest piece from each
place on; a piece is taken if it fits the one before, that is, if merging the characters of both again gives these two. If
no shorter one fits either, the place is marked as failed in a bitfield and the piece before it is shortened. Pieces that
fit pairwise are the model's own encoding, because the first merge across a boundary would also happen in that pair alone;
and as that encoding is unique, a place that failed once fails whatever comes before.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm import words
from tidemark.llm.interning import intern
from tidemark.llm.jobs import per_process

#: How models write a space.
SPACE = "▁"
#: Bytes of texts encoded at once; of a longer text so many at a time, up to the next place where it may be cut.
PIECE = 1 << 20
#: Characters in which longest matches are sought at once.
WINDOW = 1 << 18
#: Segments, and pairs of pieces, that a worker remembers in each of two generations, and the longest remembered segment.
CACHE, LONGEST = 200_000, 64

NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def vocabulary(path: str) -> dict:
    """What encoding and decoding need of a model file, as plain lists and numbers.

    Refuses models that are no merge-type model with byte fallback, or that change texts beyond writing spaces and one
    space in front: those would need another normalisation.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    train, rule = model.trainer_spec, model.normalizer_spec
    if train.model_type != train.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix:
        raise ValueError("not a merge-type model with byte fallback and spaces in front")
    if rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix or not rule.escape_whitespaces:
        raise ValueError("a model that rewrites its texts")
    kinds = [p.type for p in model.pieces]
    if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("a model with user-defined or unused pieces")
    found = {
        "pieces": [p.piece.replace(SPACE, " ") for p in model.pieces], "scores": [p.score for p in model.pieces], "kinds": kinds,
        "begin": train.bos_id, "end": train.eos_id, "unknown": train.unk_surface,
    }
    found["name"] = hashlib.sha256(repr(sorted(found.items())).encode()).hexdigest()
    return found


class Generations:
    """A dictionary that forgets what was not asked for during the last ``size`` new entries."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Windows:
    """Longest pieces of a long text, sought in windows of which the last two are kept."""

    def __init__(self, encoder: Encoder, text: str):
        self.encoder, self.text, self.kept = encoder, text, {}

    def __getitem__(self, place: int) -> int:
        size = self.encoder.window
        w = place // size
        if w not in self.kept:
            if len(self.kept) > 1:
                del self.kept[min(self.kept)]
            self.kept[w] = self.encoder.longest_in(self.text[w * size : (w + 1) * size + self.encoder.longest])[:size].tolist()
        return self.kept[w][place - w * size]


class Encoder:
    """Ids of whole texts. Characters that are no piece are numbers beyond the pieces until their bytes replace them."""

    def __init__(self, vocabulary: dict, cache: int = CACHE, window: int = WINDOW):
        import ahocorasick

        pieces, kinds = vocabulary["pieces"], vocabulary["kinds"]
        self.pieces, self.window = pieces, window
        self.score = {p: s for p, s, k in zip(pieces, vocabulary["scores"], kinds, strict=True) if k == NORMAL}
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == BYTE}
        normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
        # A piece that its own characters do not merge to is in no encoding
        self.id = {p: i for p, i in normal.items() if len(p) == 1 or self.merge(p) == [p]}
        self.size = [len(p) for p in pieces]
        self.sizes = np.array(self.size)
        self.longest = max(map(len, self.id), default=1)
        self.shorter = [-1] * len(pieces)
        self.machine = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.machine.add_word(p, i)
            self.shorter[i] = next((self.id[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.id), -1)
        self.machine.make_automaton()
        self.ends = np.array([vocabulary["begin"], vocabulary["end"]], np.int32)
        self.joint = np.zeros((256, 256), bool)
        for p in normal:
            spelt = [c.encode() for c in p]
            for a, b in itertools.pairwise(spelt):
                self.joint[a[-1], b[0]] = True
        self.joint[:, 0x80:0xC0] = True  # inside a character
        self.joint = self.joint.ravel()
        between = next(c for c in map(chr, itertools.count()) if not any(c in p for p in normal))
        self.between = between
        self.known, self.pairs = Generations(cache), Generations(cache)

    def merge(self, text: str, fence: int = 0) -> list[str] | None:
        """Parts that merging leaves of a short text: best score first, then leftmost. None as soon as a part crosses ``fence``."""
        parts, score, never = list(text), self.score, -float("inf")
        gain = [score.get(a + b, never) for a, b in itertools.pairwise(parts)]
        across = fence - 1  # the pair that the fence parts
        while gain:
            best = max(gain)
            if best == never:
                break
            at = gain.index(best)
            if at == across:
                return None
            across -= at < across
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gain[at]
            if at:
                gain[at - 1] = score.get(parts[at - 1] + parts[at], never)
            if at < len(gain):
                gain[at] = score.get(parts[at] + parts[at + 1], never)
        return parts

    def spelt(self, token: int) -> str:
        return self.pieces[token] if token < len(self.pieces) else chr(token - len(self.pieces))

    def fits(self, a: int, b: int) -> bool:
        """Whether merging both again gives ``a`` and ``b``."""
        key = a * (len(self.pieces) + 0x110000) + b
        found = self.pairs.get(key)
        if found is None:
            x, y = self.spelt(a), self.spelt(b)
            found = self.merge(x + y, len(x)) is not None
            self.pairs.put(key, found)
        return found

    def longest_in(self, text: str) -> np.ndarray:
        """The longest piece from every place of ``text`` on."""
        found = np.fromiter(self.machine.iter(text), np.dtype([("last", np.int64), ("id", np.int32)]))
        size = self.sizes[found["id"]]
        start = found["last"] - size + 1
        order = np.argsort(size, kind="stable")
        longest = len(self.pieces) + np.frombuffer(text.encode("utf-32-le"), np.int32).astype(np.int64)
        longest[start[order]] = found["id"][order]  # the last of a place is its longest
        return longest

    def solve(self, longest, lo: int, hi: int) -> list[int]:
        """Pieces of the characters ``lo`` to ``hi``, by backtracking."""
        n, size, shorter, base = len(self.pieces), self.size, self.shorter, len(self.pieces) + 0x110000
        failed = bytearray((hi - lo >> 3) + 1)
        tokens: list[int] = []
        place, token, last = lo, longest[lo], -1
        while True:
            end = place + (size[token] if token < n else 1)
            gap = end - lo
            fits = not failed[gap >> 3] >> (gap & 7) & 1
            if fits and last >= 0:
                fits = self.pairs.new.get(last * base + token)
                if fits is None:
                    fits = self.fits(last, token)
            if fits:
                tokens.append(token)
                if end == hi:
                    return tokens
                place, last, token = end, token, longest[end]
                continue
            token = shorter[token] if token < n else -1
            if token < 0:
                gap = place - lo
                failed[gap >> 3] |= 1 << (gap & 7)
                token = tokens.pop()  # never empty: the first characters of a text have an encoding
                place -= size[token] if token < n else 1
                last = tokens[-1] if tokens else -1

    def learn(self, segments: list[bytes]) -> list[bytes]:
        """Ids of different segments, as little-endian 32-bit numbers."""
        texts = [s.decode() for s in segments]
        hard = [i for i, text in enumerate(texts) if text not in self.id]
        short = [i for i in hard if len(texts[i]) <= self.window]
        longest, lo, n = self.longest_in(self.between.join(texts[i] for i in short)).tolist(), 0, len(self.pieces)
        found = {}
        for i in short:
            found[i] = self.solve(longest, lo, lo + len(texts[i]))
            lo += len(texts[i]) + 1
        for i in hard:
            if i not in found:
                found[i] = self.solve(Windows(self, texts[i]), 0, len(texts[i]))
        out = []
        for i, text in enumerate(texts):
            ids = found.get(i)
            if ids is None:
                ids = (self.id[text],)
            elif max(ids) >= n:
                ids = [x for t in ids for x in ((t,) if t < n else [self.bytes[x] for x in chr(t - n).encode()])]
            out.append(np.array(ids, np.int32).tobytes())
        return out

    def parted(self, buf: np.ndarray) -> np.ndarray:
        """Whether nothing is merged across the two bytes at each place and the next."""
        pair = buf[:-1].astype(np.uint16) << 8
        pair |= buf[1:]
        return ~self.joint[pair]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, without begin and end, and the offsets of the rows in them; no spaces are added."""
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        inner = offsets[1:-1]
        parted = self.parted(buf)
        parted[inner[(inner > 0) & (inner < len(buf))] - 1] = True
        cut = np.flatnonzero(parted) + 1
        start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(buf)]])
        which, one = intern(buf, start, end)
        raw = buf.tobytes()
        different = [raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
        ids = [self.known.get(x) for x in different]
        new = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(new, self.learn([different[i] for i in new]), strict=True):
            ids[i] = x
            if len(different[i]) <= LONGEST:
                self.known.put(different[i], x)
        size = np.array([len(x) // 4 for x in ids], np.int64)
        at = np.cumsum(size) - size
        out, segment_at = words.gather(np.frombuffer(b"".join(ids), np.int32), at[which], size[which])
        return out, segment_at[np.searchsorted(start, offsets)]

    def stretches(self, buf: np.ndarray, most: int):
        """A long text in parts that may be encoded one by one."""
        lo = 0
        while lo < len(buf):
            hi = min(len(buf), lo + most)
            while hi < len(buf):
                cut = np.flatnonzero(self.parted(buf[hi - 1 : hi + 4096]))
                if len(cut):
                    hi += int(cut[0])
                    break
                hi = min(len(buf), hi + 4096)
            yield buf[lo:hi]
            lo = hi

    def rows(self, buf: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts with begin and end, and the offsets of the texts in them."""
        full = np.diff(offsets) > 0
        buf = np.insert(buf, offsets[:-1][full], 32)  # the space in front
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        if len(full) == 1 and len(buf) > most:
            parts = [self.encode(x, np.array([0, len(x)]))[0] for x in self.stretches(buf, most)]
            ids = np.concatenate(parts)
            at = np.array([0, len(ids)])
        else:
            ids, at = self.encode(buf, offsets)
        ids = np.insert(ids, np.repeat(at, 2)[1:-1], np.tile(self.ends, len(full)))
        return ids, at + 2 * np.arange(len(at))


def encode(docs: DataFrame, path: str, text: str = "text", carry: bool = True, most: int = PIECE) -> DataFrame:
    """``docs`` with ``ids`` (little-endian 32-bit numbers, begin and end included) and n_tokens of the whole ``text``.

    A null or empty text is begin and end alone. Rows are independent, so repeated rows, null keys and other columns do not
    matter; columns with the names of the new ones are replaced. Without ``carry`` the text itself is left out. A text beyond
    ``most`` bytes is encoded part by part.
    """
    model = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    kept = [f for f in docs.schema if f.name.lower() not in ("ids", "n_tokens") and (carry or f.name != text)]
    keep, at = [docs.columns.index(f.name) for f in kept], docs.columns.index(text)
    schema = StructType([*kept, *StructType.fromDDL("ids binary, n_tokens long")])

    def run(batches):
        encoder = per_process("pieces", model.value["name"], lambda: Encoder(model.value))
        for batch in batches:
            column = pc.replace_substring(batch.column(at).fill_null(""), SPACE, " ")
            buf, offsets = words.texts(column)
            for lo, hi, b, o in words.pieces(buf, offsets, most):
                ids, row_at = encoder.rows(b, o, most)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(lo, hi - lo) for i in keep]
                    + [words.string_array(np.frombuffer(ids.tobytes(), np.uint8), 4 * row_at, pa.binary()), pa.array(np.diff(row_at))],
                    names=schema.names)

    return docs.mapInArrow(run, schema)


def decode_bytes(raw: bytes) -> str:
    """Text of a run of byte pieces; every byte that starts no character becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in range(1, 5):
            try:
                out.append(raw[i : i + n].decode())
            except UnicodeDecodeError:
                continue
            i += n
            break
        else:
            out.append("�")
            i += 1
    return "".join(out)


class Decoder:
    """Texts of ids: control pieces say nothing, and the first piece loses the space in front."""

    def __init__(self, vocabulary: dict):
        said = []
        for p, k in zip(vocabulary["pieces"], vocabulary["kinds"], strict=True):
            said.append(b"" if k == CONTROL else bytes([int(p[1:-1], 16)]) if k == BYTE else vocabulary["unknown"].encode() if k == UNKNOWN else p.encode())
        self.said = said
        self.kind = np.array(vocabulary["kinds"])
        self.size = np.array([len(x) for x in said], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.table = np.frombuffer(b"".join(said), np.uint8)
        self.leads = np.array([k == NORMAL and p.startswith(" ") for p, k in zip(vocabulary["pieces"], vocabulary["kinds"], strict=True)])

    def rows(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and their offsets."""
        start, size = self.start[ids], self.size[ids]
        speaks = np.flatnonzero(self.kind[ids] != CONTROL)
        first = np.searchsorted(speaks, offsets[:-1])
        first = speaks[first[first < np.searchsorted(speaks, offsets[1:])]]
        first = first[self.leads[ids[first]]]
        start[first] += 1
        size[first] -= 1
        buf, at = words.gather(self.table, start, size)
        at = at[offsets]
        try:
            buf.tobytes().decode()
            whole = at[:-1][np.diff(at) > 0]
            kind = self.kind[ids]
            parted = np.flatnonzero((kind[:-1] == CONTROL) & (kind[1:] == BYTE))  # bytes do not meet across a control piece
            if not len(np.setdiff1d(parted + 1, offsets)) and not (buf[whole] & 0xC0 == 0x80).any():
                return buf, at
        except UnicodeDecodeError:
            pass
        # Byte pieces that are no characters
        said = []
        for a, b in itertools.pairwise(offsets.tolist()):
            text = ""
            for is_byte, run in itertools.groupby(range(a, b), lambda i: self.kind[ids[i]] == BYTE):
                raw = b"".join(self.table[start[i] : start[i] + size[i]].tobytes() for i in run)
                text += decode_bytes(raw) if is_byte else raw.decode()
            said.append(text.encode())
        return np.frombuffer(b"".join(said), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in said], dtype=np.int64)])


def decode(encoded: DataFrame, path: str, ids: str = "ids", name: str = "decoded", carry: bool = True) -> DataFrame:
    """``encoded`` with the text that its ids stand for, as ``name``; null ids are an empty text, and an unknown id fails.

    Bytes that form no character become U+FFFD each. A column called ``name`` is replaced; without ``carry`` the ids are left out.
    """
    model = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))
    kept = [f for f in encoded.schema if f.name.lower() != name.lower() and (carry or f.name != ids)]
    keep, at = [encoded.columns.index(f.name) for f in kept], encoded.columns.index(ids)
    schema = StructType([*kept, *StructType.fromDDL(f"`{name}` string")])

    def run(batches):
        decoder = per_process("said", model.value["name"], lambda: Decoder(model.value))
        for batch in batches:
            buf, offsets = words.texts(batch.column(at))
            for lo, hi, b, o in words.pieces(buf, offsets, PIECE):
                said, row_at = decoder.rows(np.frombuffer(b.tobytes(), np.int32), o // 4)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in keep] + [words.string_array(said, row_at)], names=schema.names)

    return encoded.mapInArrow(run, schema)
