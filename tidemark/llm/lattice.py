"""Embedding near-dedup by lattice hashing.

Unit vectors are projected at random to eight dimensions, scaled, and decoded to the nearest point of the E8
lattice, in several tables. A vector is at home in its own cell and probes the neighbouring cells nearest to it;
two vectors are compared where one is at home and the other at home or probing. Close vectors meet in some
table, and the cosine of those that meet is computed in double precision.

Equal vectors are one class with a count. A crowded cell is cut into tiles, and every pair of tiles is a
group of its own, so no task holds a whole cell; pairs are counted where they are found and never written out.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.jobs import components, stored
from tidemark.session import settle

LEAST = 0.98
#: Tables, probed cells in each, and the size of a lattice step: pairs at ``LEAST`` meet with a chance over 0.9999.
TABLES, PROBES, CELL, SIZE = 5, 12, 0.1, 64
#: Classes in a tile of a crowded cell.
TILE = 1024


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, in halves: all (+-1, +-1, 0...) and all (+-1/2)^8 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((2, -2), repeat=2):
            v = np.zeros(8, np.int64)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in itertools.product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out, np.int64)


SHORTEST = shortest()


def nearest_even(y: np.ndarray) -> np.ndarray:
    """Nearest whole points with an even sum."""
    out = np.rint(y)
    off = y - out
    odd = np.flatnonzero(out.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    out[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return out


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest E8 point of every row, in halves: the better of an even whole point and one shifted by a half."""
    a, b = nearest_even(y), nearest_even(y - 0.5) + 0.5
    closer = ((y - b) ** 2).sum(1) < ((y - a) ** 2).sum(1)
    return np.rint(2 * np.where(closer[:, None], b, a)).astype(np.int64)


def projection(table: int, size: int) -> np.ndarray:
    """Eight fixed orthonormal random directions, scaled so that ``CELL`` is one lattice step at ``SIZE`` dimensions.

    Eight of n dimensions hold a share of 8 / n of a squared distance, so the step shrinks with the root of n.
    """
    random = np.random.default_rng([table, size])
    rows = max(size, 8)
    return np.linalg.qr(random.standard_normal((rows, 8)))[0][:size] / (CELL * np.sqrt(SIZE / rows))


_FACTORS = words._mixed(8, 3) | np.uint64(1)


def cell_names(points: np.ndarray, table: int) -> np.ndarray:
    """64-bit names of lattice points."""
    return words.mix((points.astype(np.uint64) * _FACTORS).sum(-1, dtype=np.uint64) + np.uint64(table + 1)).astype(np.int64)


def cells(unit: np.ndarray) -> np.ndarray:
    """Names of the home cell and of the probed cells: vectors x tables x (1 + PROBES)."""
    out = np.empty((len(unit), TABLES, 1 + PROBES), np.int64)
    for t in range(TABLES):
        y = unit @ projection(t, unit.shape[1])
        home = decode(y)
        near = (y - home / 2) @ (SHORTEST.T / 2)
        chosen = np.argpartition(-near, PROBES, axis=1)[:, :PROBES]
        out[:, t, 0] = cell_names(home, t)
        out[:, t, 1:] = cell_names(home[:, None, :] + SHORTEST[chosen], t)
    return out


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long vectors as rows, in double precision and of length 1."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def meeting(mine: np.ndarray, yours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First table in which the two vectors of each pair meet, and the smallest cell in which they do there."""
    n = len(mine)
    table, cell = np.full(n, TABLES), np.zeros(n, np.int64)
    top = np.iinfo(np.int64).max
    for t in reversed(range(TABLES)):
        a = np.where((yours[:, t, :] == mine[:, t, :1]).any(1), mine[:, t, 0], top)
        b = np.where((mine[:, t, :] == yours[:, t, :1]).any(1), yours[:, t, 0], top)
        low = np.minimum(a, b)
        met = low < top
        table[met], cell[met] = t, low[met]
    return table, cell


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node that each of ``n`` nodes reaches along the links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def compare(table: pa.Table, least: float) -> pa.Table:
    """Links within a cell's tile, or between two: per class the vectors linked and one class it is joined to."""
    table = table.combine_chunks()
    order = np.lexsort((table["class"].to_numpy(),))
    table = table.take(pa.array(order))
    name, copies = table["class"].to_numpy(), table["copies"].to_numpy()
    home, tile = table["home"].to_numpy(zero_copy_only=False), table["tile"].to_numpy()
    left, right = table["left"][0].as_py(), table["right"][0].as_py()
    where, cell = table["table"][0].as_py(), table["cell"][0].as_py()
    unit = matrix(table["embedding"])
    one, two = np.flatnonzero(tile == left), np.flatnonzero(tile == right)
    cosine = unit[one] @ unit[two].T
    ok = (cosine >= least) & (home[one][:, None] | home[two][None, :])
    if left == right:
        ok &= np.arange(len(one))[:, None] < np.arange(len(two))[None, :]
    a, b = np.nonzero(ok)
    a, b = one[a], two[b]
    apart = name[a] != name[b]
    a, b = a[apart], b[apart]
    if len(a):
        near = np.unique(np.concatenate([a, b]))
        at = np.searchsorted(near, np.arange(len(name)))
        known = cells(unit[near])
        keep = np.zeros(len(a), bool)
        for lo in range(0, len(a), 1 << 14):
            some = slice(lo, lo + (1 << 14))
            t, c = meeting(known[at[a[some]]], known[at[b[some]]])
            keep[some] = (t == where) & (c == cell)
        a, b = a[keep], b[keep]
    n = len(name)
    links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
    root = roots(n, a, b)
    found = np.flatnonzero(links > 0)
    return pa.table({"class": pa.array(name[found]), "links": pa.array(links[found].astype(np.int64)), "root": pa.array(name[root[found]])})


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """``vectors`` with ``n_links``, ``component_id`` and ``kept``.

    Vectors are compared only if their labels are equal and not null and they have the same size. One that
    is null, empty, zero, or holds a null or non-finite number links with nothing. Rows with the same id and vector
    are copies and link with each other; ids are whole numbers, and rows that share an id are one node. A null id
    links with nothing and has a null component. ``kept``: the row's id is its component's smallest. Columns with
    the new names are replaced.
    """
    names = {"n_links", "component_id", "kept", "_sound"}
    plain = vectors.select([c for c in vectors.columns if c.lower() not in names])
    e = F.col(embedding)
    sound = F.coalesce(
        F.col(key).isNotNull() & F.col(label).isNotNull() & (F.size(e) > 0)
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0),
        F.lit(False))
    marked = plain.withColumn("_sound", sound)
    classes = stored(
        marked.where("_sound").groupBy(F.col(label).alias("label"), e.alias("embedding"))
        .agg(F.min(key).cast("long").alias("class"), F.count("*").alias("copies")))

    def enter(batches):
        for batch in batches:
            column = batch.column("embedding")
            size = column.value_lengths().to_numpy()
            for s in np.unique(size):
                rows = np.flatnonzero(size == s)
                for lo in range(0, len(rows), 4096):
                    mine = rows[lo : lo + 4096]
                    name = cells(matrix(column.take(pa.array(mine))))
                    n, each = len(mine), TABLES * (1 + PROBES)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(batch.column("class").to_numpy()[mine], each)),
                        batch.column("label").take(pa.array(np.repeat(mine, each))),
                        pa.array(np.full(n * each, s, np.int32)),
                        pa.array(np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), 1 + PROBES), n)),
                        pa.array(name.ravel()),
                        pa.array(np.tile(np.arange(1 + PROBES) == 0, n * TABLES)),
                    ], names=["class", "label", "size", "table", "cell", "home"])

    kind = next(f.dataType.simpleString() for f in classes.schema if f.name == "label")
    entries = classes.select("class", "label", "embedding").mapInArrow(enter, f"class long, label {kind}, size int, table int, cell long, home boolean")
    at = ["label", "size", "table", "cell"]
    entries = stored(entries)
    # Only cells with somebody at home and somebody else matter
    crowded = entries.groupBy(*at).agg(F.count("*").alias("n"), F.max("home").alias("lived")).where("n > 1 and lived").drop("lived")
    tiles = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    met = entries.join(crowded, at).withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("class"), "tiles").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = met.select("class", *at, "home", "tile", F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"))
    full = met.join(classes.select("class", "label", "embedding", "copies", F.size("embedding").alias("size")), ["class", "label", "size"])
    found = full.groupBy(*at, "left", "right").applyInArrow(lambda t: compare(t, least), "class long, links long, root long")
    found = settle(found)
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    known = classes.join(links, "class", "left").join(joined.withColumnRenamed("node", "class"), "class", "left")
    known = known.select(
        F.col("label").alias("_label"), F.col("embedding").alias("_embedding"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "class").alias("component_id"))
    hit = marked.where("_sound").join(known, (F.col(label) == F.col("_label")) & (e == F.col("_embedding"))).drop("_label", "_embedding")
    rest = marked.where("not _sound").withColumn("n_links", F.lit(0).cast("long")).withColumn("component_id", F.col(key).cast("long"))
    return hit.unionByName(rest).drop("_sound").withColumn("kept", F.col(key).cast("long").eqNullSafe(F.col("component_id")))
