"""Line dedup: an exact set-similarity join of all lines on their words.

A line is the set of its words, ordered by rarity. Two lines whose sets overlap by the threshold share a word
among the first few of each (prefix filter); of the pairs that share one, those go that differ too much in
length, whose shared word stands too far back (positional filter), or whose bit maps differ in more bits than their
lines may in words. Lines left in pairs form suspicion groups, sent on as chains of links, and only inside these
are the sets compared. A line goes if an earlier one is the same set or overlaps by the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.jaccard import overlaps
from tidemark.llm.jobs import components, hashed_counts, stored
from tidemark.llm.lattice import roots
from tidemark.session import settle

LEAST = 0.8
#: Places of the table of word frequencies. Any order of words gives right results; this one puts rare words first.
RARITY = 1 << 20
#: Lines with a word among their first that are compared by one task; a more frequent word is cut into tiles.
CROWD = 40_000
#: Lines in a tile of a suspicion group.
TILE = 256
#: Entries in a bucket of words, and lines of small suspicion groups that are compared together, about.
BUCKET, TOGETHER = 400_000, 128
#: Largest map of a line's words: 2 to this many times 64 bits.
WIDEST = 7
#: Pairs that a task looks at together.
CHUNK = 1 << 18
#: Bits of the map that tells which suspicious lines to read again; it only saves work.
SEEN = 1 << 24


def in_lines(line: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Order by line, then hash. Line, hash and place share one number where they fit, whose sorting is much faster."""
    n = len(h)
    low, high = max(1, (n - 1).bit_length()), max(1, int(line[-1]).bit_length()) if n else 1
    left = 64 - low - high
    if n and left >= 28:
        key = np.sort(line.astype(np.uint64) << np.uint64(64 - high) | h >> np.uint64(64 - left) << np.uint64(low) | np.arange(n, dtype=np.uint64))
        by = (key & np.uint64((1 << low) - 1)).astype(np.int64)
        key >>= np.uint64(low)
        tied = key[1:] == key[:-1]
        if (h[by[1:][tied]] == h[by[:-1][tied]]).all():  # else different words look alike so far
            return by
    return np.lexsort((h, line))


def line_sets(buf: np.ndarray, offsets: np.ndarray):
    """(words of all lines, sorted in each; line offsets into them; first line of every row; line number of every line).

    A text has one line more than line ends; an empty or null text has one, empty line.
    """
    ends = np.flatnonzero(buf == 10)
    first = np.searchsorted(ends, offsets) + np.arange(len(offsets))
    first[-1] = len(ends) + len(offsets) - 1
    begin = np.empty(first[-1], np.int64)
    is_first = np.zeros(first[-1], bool)
    is_first[first[:-1]] = True
    begin[is_first], begin[~is_first] = offsets[:-1], ends + 1
    number = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
    start, end, _ = words.words(buf, offsets)
    h = words.span_hashes(words.prefix(buf), start, end)
    line = np.searchsorted(begin, start, "right") - 1
    # Of lines that begin at one byte, all but the last are empty
    by = in_lines(line, h)
    h, line = h[by], line[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    h, line = h[new], line[new]
    return h, np.searchsorted(line, np.arange(first[-1] + 1)), first, number


def places(h: np.ndarray) -> np.ndarray:
    return (h & h.dtype.type(RARITY - 1)).astype(np.int64)


def _word_places(column: pa.Array):
    for _, _, b, o in words.pieces(*words.texts(column)):
        yield places(line_sets(b, o)[0])


def _first_places(column: pa.Array):
    yield places(column.flatten().to_numpy().view(np.uint32))


def need(n: np.ndarray, least: float) -> np.ndarray:
    """Words that a line of ``n`` must share with any line it matches."""
    return np.ceil(least * n - 1e-9).astype(np.int64)


def first_names(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of every set."""
    return words.sums(words.mix(h).view(np.int64), at)


def names(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of every set."""
    return first_names(h, at), words.sums(words.mix(h ^ np.uint64(0x5DEECE66D)).view(np.int64), at)


def classes(size: np.ndarray) -> np.ndarray:
    """Powers of two of 64-bit words in a line's map: about a bit for each of its words."""
    return np.minimum(np.ceil(np.log2(np.maximum(size, 64) / 64)), WIDEST).astype(np.int64)


def bit_maps(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity maps of the lines' words, one after the other, and their offsets.

    Two maps differ in no more bits than their lines in words. Halves laid over each other give the smaller map.
    """
    size = np.diff(at)
    kind = classes(size)
    offsets = np.concatenate([[0], np.cumsum(1 << kind)])
    out = np.zeros(offsets[-1], np.uint64)
    line = words.row_of(at)
    place = offsets[line] + ((h >> np.uint64(40)).astype(np.int64) & ((1 << kind) - 1)[line])
    np.bitwise_xor.at(out, place, np.uint64(1) << (h >> np.uint64(58)))
    return out, offsets


class Maps:
    """Maps of some entries, to be compared at the smaller of two sizes."""

    def __init__(self, flat: np.ndarray, offsets: np.ndarray):
        kind = np.log2(np.diff(offsets)).astype(np.int64)
        self.kind = kind
        self.at, self.level = {}, {}
        above, folded = np.zeros(0, np.int64), None
        for k in range(int(kind.max()), -1, -1):
            mine = np.flatnonzero(kind == k)
            own = flat[offsets[mine][:, None] + np.arange(1 << k)] if len(mine) else np.zeros((0, 1 << k), np.uint64)
            if folded is not None:
                half = folded.shape[1] // 2
                own = np.concatenate([own, folded[:, :half] ^ folded[:, half:]])
            above = np.concatenate([mine, above])
            place = np.full(len(kind), -1)
            place[above] = np.arange(len(above))
            self.at[k], self.level[k], folded = place, own, own

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which the maps of each pair differ."""
        out = np.zeros(len(a), np.int64)
        small = np.minimum(self.kind[a], self.kind[b])
        for k in np.unique(small):
            mine = np.flatnonzero(small == k)
            x, place = self.level[k], self.at[k]
            for lo in range(0, len(mine), CHUNK >> int(k)):  # wide maps, fewer pairs
                some = mine[lo : lo + (CHUNK >> int(k))]
                out[some] = np.bitwise_count(x[place[a[some]]] ^ x[place[b[some]]]).sum(1)
        return out


def prefixes(h: np.ndarray, at: np.ndarray, rarity: np.ndarray, least: float):
    """(line, word) of the words that the prefix filter needs, rarest first; words by 32 bits, as these only find candidates."""
    n = np.diff(at)
    line = words.row_of(at)
    place = np.arange(len(h)) - np.repeat(at[:-1], n)
    rare = np.minimum(rarity[places(h)], (1 << 24) - 1)
    if len(h) and n.max() < 1 << 20 and len(n) < 1 << 20:  # one number holds line, rarity and place, and the words of a line are in order
        key = np.sort(line.astype(np.uint64) << np.uint64(44) | rare.astype(np.uint64) << np.uint64(20) | place.astype(np.uint64))
        by = np.repeat(at[:-1], n) + (key & np.uint64((1 << 20) - 1)).astype(np.int64)
    else:
        by = np.lexsort((h, rare, line))
    mine = place < np.repeat(n - need(n, least) + 1, n)
    return line[mine], h[by][mine].astype(np.uint32)


def suspects(word: np.ndarray, tile: np.ndarray, name: np.ndarray, size: np.ndarray, place: np.ndarray, seen: Maps, least: float):
    """Pairs of lines in one word's lists that no filter can part; entries sorted by (word, pair of tiles, size)."""
    n = len(word)
    group = np.zeros(n, np.int64)
    group[1:] = np.cumsum((word[1:] != word[:-1]) | (tile[1:] != tile[:-1]))
    # Partners are a run behind each entry: what stands behind its place must be enough to share with one so long, so a
    # partner is at most 1 / least times as long, and the longer the place is down the list, the shorter
    wide = int(size.max()) + 2
    farthest = np.clip(np.floor((size - place) * ((1 + least) / least) - size + 1e-6).astype(np.int64), 0, wide - 1)
    stop = np.searchsorted(group * wide + size, group * wide + farthest, "right")
    count = np.maximum(0, stop - np.arange(n) - 1)
    total = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + CHUNK, "right")) - 1)
        a = np.repeat(np.arange(lo, hi), count[lo:hi])
        b = a + 1 + np.arange(len(a)) - np.repeat(total[lo:hi] - total[lo], count[lo:hi])
        share = np.ceil(least / (1 + least) * (size[a] + size[b]) - 1e-9)
        ok = (name[a] != name[b]) & (1 + np.minimum(size[a] - place[a], size[b] - place[b]) - 1 >= share)
        a, b, share = a[ok], b[ok], share[ok]
        ok = seen.differ(a, b) <= size[a] + size[b] - 2 * share
        yield a[ok], b[ok]
        lo = hi


def together(root: np.ndarray, held: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``root``, the smallest node known of each node's group, after links between roots."""
    if not sum(len(a) for a, _ in held):
        return root
    a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    return roots(len(root), a, b)[root]


def match(table: pa.Table, least: float) -> pa.Table:
    """Links that hold the suspicious lines of a bucket's lists together."""
    joined = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
    word, tiles, name = joined("word", np.int32), joined("tiles", np.int64), joined("name", np.int64)
    size, place = joined("size", np.int32).astype(np.int64), joined("place", np.int32).astype(np.int64)
    flat = joined("seen", np.uint64)
    width = 1 << classes(size)
    by = np.lexsort((size, tiles, word))
    flat, at = words.gather(flat, (np.cumsum(width) - width)[by], width[by])
    word, tiles, name, size, place = word[by], tiles[by], name[by], size[by], place[by]
    seen = Maps(flat, at)
    # Only pairs that join what was apart are held: the pairs of a group grow with the square of its lines
    near, at = np.unique(name, return_inverse=True)
    root, held, n = np.arange(len(near)), [], 0
    for a, b in suspects(word, tiles, name, size, place, seen, least):
        a, b = root[at[a]], root[at[b]]
        held.append((a[a != b], b[a != b]))
        n += len(held[-1][0])
        if n >= CHUNK:
            root, held, n = together(root, held), [], 0
    root = together(root, held)
    apart = np.flatnonzero(root != np.arange(len(near)))
    return pa.table({"a": pa.array(near[apart]), "b": pa.array(near[root[apart]])})


def verify(table: pa.Table, least: float) -> pa.Table:
    """Lines of a tile, or of some small groups together, that have an earlier match in the other tile or in their group."""
    table = table.combine_chunks()
    left, right = table["left"][0].as_py(), table["right"][0].as_py()
    tile = table["tile"].to_numpy()
    sets = table["words"].combine_chunks()
    value = sets.flatten().to_numpy().view(np.uint64)
    size = sets.value_lengths().to_numpy().astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    # Lines of different groups have no words in common
    value = words.mix(value + np.repeat(table["root"].to_numpy().view(np.uint64), size) * np.uint64(words.BASE))
    one, two = np.flatnonzero(tile == left), np.flatnonzero(tile == right)
    common = overlaps(value, at, one, two).astype(float)
    linked = common >= least * (size[one][:, None] + size[two][None, :] - common) - 1e-9
    doc, line = table["first_doc"].to_numpy(), table["first_line"].to_numpy()
    before = (doc[one][:, None] < doc[two][None, :]) | (doc[one][:, None] == doc[two][None, :]) & (line[one][:, None] < line[two][None, :])
    after = (doc[one][:, None] > doc[two][None, :]) | (doc[one][:, None] == doc[two][None, :]) & (line[one][:, None] > line[two][None, :])
    late = np.unique(np.concatenate([one[(linked & after).any(1)], two[(linked & before).any(0)]]))
    return table.take(pa.array(late)).select(["one", "two", "size"])


def line_matches(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """All lines of all texts: row, doc_id, mark (hash of the text), line (from 0), size (different words), gone.

    ``row`` tells rows of ``docs`` apart. A line goes if an earlier one, by (doc_id, line), has the same words or
    overlaps with Jaccard ``least`` or more, whether that one goes itself or not. A line without words stays. Ids are whole
    numbers, a null id is after all others; equal lines at one place (repeated rows) aren't later than each other. Words are
    compared by 64-bit hashes, sets by 128 bits.
    """
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"), F.col(text).alias("text"))
    rarity = spark.sparkContext.broadcast(hashed_counts(plain, "text", RARITY, _word_places, rough=True).astype(np.int32))

    def split(batches):
        order = rarity.value
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            buf, offsets = words.texts(batch.column(1))
            for lo, hi, b, o in words.pieces(buf, offsets):
                h, at, first, number = line_sets(b, o)
                size = np.diff(at)
                one, two = names(h, at)
                line, word = prefixes(h, at, order, least)
                # A line that this piece has already is in the lists already
                _, lead = np.unique(one, return_index=True)
                leads = np.zeros(len(size), bool)
                leads[lead] = True
                mine = leads[line]
                line, word = line[mine], word[mine]
                list_at = pa.array(np.searchsorted(line, np.arange(len(size) + 1)).astype(np.int32))
                of = words.row_of(first)
                maps, maps_at = bit_maps(h, at)
                maps, maps_at = words.gather(maps, maps_at[:-1], np.where(leads, np.diff(maps_at), 0))
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + of), batch.column(0).slice(lo, hi - lo).take(pa.array(of)), batch.column(2).slice(lo, hi - lo).take(pa.array(of)),
                    pa.array(number), pa.array(one), pa.array(two), pa.array(size.astype(np.int32)), words.string_array(maps.view(np.uint8), 8 * maps_at, pa.binary()),
                    pa.ListArray.from_arrays(list_at, pa.array(word.view(np.int32))),
                ], names=["row", "doc_id", "mark", "line", "one", "two", "size", "seen", "entries"])
                row += hi - lo

    every = stored(plain.withColumn("mark", F.xxhash64("text")).mapInArrow(
        split, "row long, doc_id long, mark long, line long, one long, two long, size int, seen binary, entries array<int>"))
    listed = every.where(F.size("entries") > 0)
    length = spark.sparkContext.broadcast(hashed_counts(listed, "entries", RARITY, _first_places, rough=True))

    known = length.value
    total = int(known.sum())
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET)

    def spread(batches):
        """An entry for each word of a line's prefix; one in a crowded list goes to every pair of tiles that has its own.

        Entries of a batch that go to one bucket are packed into one row.
        """
        known = length.value
        for batch in batches:
            entries = batch.column(3)
            n = entries.value_lengths().to_numpy()
            of = np.repeat(np.arange(len(entries)), n)
            word, place = entries.flatten().to_numpy(), np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            tiles = np.maximum(1, -(-known[places(word.view(np.uint32))] // CROWD))
            name = batch.column(0).to_numpy()[of]
            tile = (words.mix(name.view(np.uint64)) % tiles.astype(np.uint64)).astype(np.int64)
            again = np.repeat(np.arange(len(of)), tiles)
            other = np.arange(len(again)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
            tile, of, word, place, name = tile[again], of[again], word[again], place[again], name[again]
            pair = np.minimum(tile, other) << 32 | np.maximum(tile, other)
            bucket = (words.mix(word.view(np.uint32).astype(np.uint64) * np.uint64(words.BASE) + pair.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            of, word, place, name, pair, bucket = of[by], word[by], place[by], name[by], pair[by], bucket[by]
            size = batch.column(1).to_numpy()[of]
            maps, maps_at = words.texts(batch.column(2))
            maps, maps_at = words.gather(maps, maps_at[:-1][of], np.diff(maps_at)[of])
            found, at = np.unique(bucket, return_index=True)
            at = np.append(at, len(bucket))
            cut = lambda x, at=at: pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            bytes_at = maps_at[at]
            yield pa.RecordBatch.from_arrays([
                pa.array(found.astype(np.int32)), cut(word), cut(pair), cut(name), cut(size.astype(np.int32)), cut(place.astype(np.int32)), cut(maps, bytes_at),
            ], names=["bucket", "word", "tiles", "name", "size", "place", "seen"])

    entries = listed.select(F.col("one").alias("name"), "size", "seen", "entries").mapInArrow(
        spread, "bucket int, word binary, tiles binary, name binary, size binary, place binary, seen binary")
    groups = components(entries.groupBy("bucket").applyInArrow(lambda t: match(t, least), "a long, b long"))
    groups = settle(groups)

    # What the suspicious lines are made of, and where each first stands
    bits = _suspicious_bits(groups)
    shared = spark.sparkContext.broadcast(bits)

    def reread(batches):
        known = shared.value
        for batch in batches:
            buf, offsets = words.texts(batch.column(0))
            for _, _, b, o in words.pieces(buf, offsets):
                h, at, _, _ = line_sets(b, o)
                one = first_names(h, at)
                size = np.diff(at)
                lead = np.flatnonzero((size > 0) & known[_bit(one)])
                _, some = np.unique(one[lead], return_index=True)
                lead = lead[some]
                data, list_at = words.gather(h, at[lead], size[lead])
                one, two = names(data, list_at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(one), pa.array(two), pa.array(size[lead].astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(list_at.astype(np.int32)), pa.array(data.view(np.int64))),
                ], names=["one", "two", "size", "words"])

    same = ["one", "two", "size"]
    firsts = every.where("size > 0").groupBy(*same).agg(F.min(F.struct("doc_id", "line")).alias("first"))
    firsts = stored(firsts.select(*same, F.col("first.doc_id").alias("first_doc"), F.col("first.line").alias("first_line")))
    counted = groups.groupBy("root").agg(F.count("*").alias("members"))
    tiles = F.ceil(F.col("members") / F.lit(TILE)).cast("int")
    dealt = groups.join(counted, "root").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    members = dealt.join(firsts.withColumn("node", F.col("one")), "node").select(*same, "root", "tile", "tiles", "first_doc", "first_line")
    found = plain.select("text").mapInArrow(reread, "one long, two long, size int, words array<long>")
    found = members.join(found.dropDuplicates(same), same)
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    found = found.select(*same, "root", "tile", "tiles", "first_doc", "first_line", "words", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"))
    bins = max(1, groups.count() // TOGETHER)
    bin_of = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.lit(-1) - F.pmod(F.xxhash64("root"), F.lit(1 << 40)))
    late = found.withColumn("bin", bin_of).groupBy("bin", F.when(F.col("tiles") > 1, F.col("root")).alias("big"), "left", "right").applyInArrow(lambda t: verify(t, least), "one long, two long, size int")
    verdicts = firsts.join(late.distinct().withColumn("late", F.lit(True)), same, "left")
    out = every.drop("seen", "entries").join(verdicts, same, "left")
    later = (F.col("doc_id") > F.col("first_doc")) | (F.col("doc_id") == F.col("first_doc")) & (F.col("line") > F.col("first_line"))
    return out.select("row", "doc_id", "mark", "line", "size", F.coalesce(F.col("late") | later, F.lit(False)).alias("gone"))


def _bit(name: np.ndarray) -> np.ndarray:
    return (words.mix(name.view(np.uint64)) & np.uint64(SEEN - 1)).astype(np.int64)


def _suspicious_bits(groups: DataFrame) -> np.ndarray:
    """Which hashed places hold a suspicious line: ``SEEN`` bits from any number of lines."""

    def run(batches):
        held = np.zeros(SEEN, bool)
        for batch in batches:
            held[_bit(batch.column(0).to_numpy())] = True
        packed = np.packbits(held)
        width = len(packed) // 64
        for i in range(64):
            mine = packed[i * width : (i + 1) * width]
            if mine.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([mine.tobytes()], pa.binary())], names=["slice", "bits"])

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, bits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bits = np.frombuffer(bits, np.uint8)
                held[i] = held[i] | bits if i in held else bits
        for i, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["slice", "bits"])

    got = groups.select("node").mapInArrow(run, "slice int, bits binary").repartition(16, "slice").mapInArrow(merge, "slice int, bits binary").toArrow()
    out = np.zeros(SEEN // 8, np.uint8)
    width = len(out) // 64
    for i, bits in zip(got["slice"].to_pylist(), got["bits"].to_pylist(), strict=True):
        out[i * width : (i + 1) * width] = np.frombuffer(bits, np.uint8)
    return np.unpackbits(out).astype(bool)


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """Per row of ``docs``: doc_id, mark (hash of the text), n_lines, n_removed and removed, the numbers of its lines that go."""
    found = line_matches(docs, key, text, least).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("mark").alias("mark"), F.count("*").alias("n_lines"),
        F.count_if("gone").alias("n_removed"), F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("line")))).alias("removed"))
    return found.withColumn("doc_id", F.when(F.col("doc_id") < (1 << 63) - 1, F.col("doc_id"))).drop("row")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """``docs`` without the lines that go; a text that loses all lines becomes empty, a null text stays null. All columns stay."""
    found = removed_lines(docs, key, text, least).where("n_removed > 0").groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.first("removed").alias("_gone"))
    marked = docs.withColumn("_at", F.xxhash64(text))
    joined = marked.join(found, F.col(key).cast("long").eqNullSafe(F.col("_id")) & (F.col("_at") == F.col("_mark")), "left").select(*docs.columns, "_gone")
    at = docs.columns.index(text)

    def drop(batches):
        for batch in batches:
            kept = [
                x if gone is None or x is None else "\n".join(line for i, line in enumerate(x.split("\n")) if i not in gone)
                for x, gone in zip(batch.column(at).to_pylist(), (g if g is None else set(g) for g in batch.column(len(docs_columns)).to_pylist()), strict=True)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(kept, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_columns)

    docs_columns = docs.columns
    return joined.mapInArrow(drop, docs.schema)
