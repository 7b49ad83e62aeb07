"""Near-duplicate operators against brute force, with hot groups, nulls, repeats and clashing columns."""

import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import jaccard, lattice, lines, windows

SCHEMA = "doc_id long, text string, kept string, n_links long, block int, row long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 5, 7, 9) for i, t in rows], SCHEMA).repartition(parts)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def nonsense(seed, docs, vocabulary=12, longest=60):
    r = random.Random(seed)
    return [(i, " ".join(r.choice("abcdefghijklmnop"[:vocabulary]) for _ in range(r.randrange(longest)))) for i in range(docs)]


# Substring dedup


def brute_windows(rows, k):
    first = {}
    for i, t in rows:
        w = split(t)
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p : p + k])] < i:
                gone |= set(range(p, p + k))
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


@pytest.mark.parametrize("k, m, vocabulary", [(13, 3, 2), (5, 2, 3), (3, 1, 4)])
def test_windows_brute_force(spark, monkeypatch, k, m, vocabulary):
    monkeypatch.setattr(windows, "BLOCK", 600)  # many blocks and buckets
    rows = nonsense(k, 60, vocabulary)
    rows += [(100 + i, rows[7][1] + "  " + rows[9][1].replace(" ", "\n\t")) for i in range(20)] + [(200, None), (201, ""), (202, " \n ")]
    got = windows.dedup_windows(frame(spark, rows), k=k, m=m)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == brute_windows(rows, k)


def test_windows_edges(spark):
    text = " ".join(f"w{i}" for i in range(20))
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(5, text), (5, text), (None, text), (9, long), (10, long)]
    got = {(r.doc_id, r.n_words, r.n_removed) for r in windows.dedup_windows(frame(spark, rows)).collect()}
    assert got == {(5, 20, 0), (None, 20, 20), (9, 60_000, 0), (10, 60_000, 60_000)}
    empty = windows.dedup_windows(frame(spark, []))
    assert empty.count() == 0 and {"kept", "n_words", "n_removed", "row"} <= set(empty.columns)


def test_equal_hashes_are_parted_by_bytes(monkeypatch):
    monkeypatch.setattr(windows.words, "run_hashes", lambda h, k: np.zeros(max(0, len(h) - k + 1), np.uint64))
    t = pa.table({"packed": pa.array([b"a b c", b"a b c", b"a b d"], pa.binary()), "first_doc": pa.array([1, 2, 3]), "several": pa.array([False] * 3),
                  "block": pa.array([0, 1, 2], pa.int32()), "string": pa.array([0, 0, 0], pa.int32())})
    got = windows.repeats(t, 3)
    assert got["block"].to_pylist() == [0, 1]
    assert [np.frombuffer(x, np.int64).tolist() for x in got["runs"].to_pylist()] == [[0, 0, 1, 1]] * 2


# N-gram Jaccard join


def grams(text, n):
    w = split(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_links(sets, least):
    n = len(sets)
    links = {i: 0 for i in range(n)}
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(n), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return links, find


def changed(r, text, times):
    w = text.split(" ")
    for _ in range(times):
        w[r.randrange(len(w))] = f"new{r.random()}"
    return " ".join(w)


@pytest.mark.parametrize("tile", [256, 16])
def test_jaccard_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    r = random.Random(4)
    base = [" ".join(f"w{r.randrange(500)}" for _ in range(150)) for _ in range(6)]
    texts = list(base)
    for b in base[:3]:
        texts += [changed(r, b, r.randrange(1, 6)) for _ in range(30)] + [b, b]
    texts += ["short one", "short one", "short  one", "x", None, "", " "]
    rows = list(enumerate(texts))
    got = {d.doc_id: (d.n_links, d.class_id) for d in jaccard.near_texts(frame(spark, rows)).collect()}
    links, find = brute_links([grams(t, 5) for t in texts], 0.8)
    want = {i: (links[i], find(i)) for i in range(len(texts))}
    assert got == want


def test_jaccard_edges(spark):
    assert jaccard.near_texts(frame(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f")]
    got = sorted(((r.doc_id, r.n_links, r.class_id) for r in jaccard.near_texts(frame(spark, rows)).collect()), key=repr)
    assert got == [(1, 2, 1), (1, 2, 1), (3, 2, 1), (None, 0, None)]


def test_posterior_keeps_pairs_at_the_threshold():
    needed = jaccard.fewest(0.8, 1e-5)
    r = np.random.default_rng(0)
    for n, m in needed.items():
        assert (r.binomial(n, 0.8, 20_000) < m).mean() < 1e-3
        assert m > 0.4 * n


# Line dedup


def brute_lines(rows, least=0.8):
    all_lines = [(i, p, frozenset(split(line))) for i, t in rows for p, line in enumerate((t or "").split("\n"))]
    out = {}
    for i, p, s in all_lines:
        gone = bool(s) and any(
            (j, q) < (i, p) and o and (o == s or len(o & s) >= least * len(o | s) - 1e-9) for j, q, o in all_lines)
        out.setdefault(i, []).append(gone)
    return sorted((i, len(g), sum(g), [p for p, x in enumerate(g) if x]) for i, g in out.items())


@pytest.mark.parametrize("tile, crowd", [(256, 40_000), (4, 3)])
def test_lines_brute_force(spark, monkeypatch, tile, crowd):
    monkeypatch.setattr(lines, "TILE", tile)
    monkeypatch.setattr(lines, "CROWD", crowd)
    r = random.Random(8)
    pool = [" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(3)) for _ in range(r.randrange(1, 14))) for _ in range(60)]
    pool += [changed(r, x, 1) for x in pool[:30]] + ["", " ", "\t"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 6)))) for i in range(50)] + [(60, None), (61, ""), (62, "\n\n")]
    got = lines.removed_lines(frame(spark, rows))
    assert sorted((d.doc_id, d.n_lines, d.n_removed, d.removed) for d in got.collect()) == brute_lines(rows)
    kept = {d.doc_id: d.text for d in lines.dedup_lines(frame(spark, rows)).collect()}
    for i, _, _, gone in brute_lines(rows):
        text = dict(rows)[i]
        assert kept[i] == (None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone))


def test_lines_edges(spark):
    assert lines.removed_lines(frame(spark, [])).count() == 0
    long = "\n".join(f"line {i} of a very long text" for i in range(20_000))
    rows = [(1, "a b c"), (1, "a b c"), (2, "c b a\nx"), (None, "a b c"), (3, long)]
    got = sorted(((d.doc_id, d.n_lines, d.n_removed) for d in lines.removed_lines(frame(spark, rows)).collect()), key=repr)
    # All lines of the long text but the first overlap with one before by five of seven words: less than 0.8
    assert got == [(1, 1, 0), (1, 1, 0), (2, 2, 1), (3, 20_000, 0), (None, 1, 1)]
    assert sorted(lines.dedup_lines(frame(spark, rows)).columns) == sorted(frame(spark, []).columns)


def bucket(entries):
    """A bucket's table; ``entries``: (word, name, size, place, map)."""
    word, name, size, place, seen = zip(*entries, strict=True)
    column = lambda x, kind: pa.array([np.array(x, kind).tobytes()], pa.binary())
    return pa.table({"word": column(word, np.int32), "tiles": column([0] * len(word), np.int64), "name": column(name, np.int64),
                     "size": column(size, np.int32), "place": column(place, np.int32), "seen": column(seen, np.uint64)})


def test_lines_of_a_large_group_need_no_memory_for_their_pairs():
    n = 4000
    table = bucket([(1, 7 * i - n, 30, 0, 5) for i in range(n)] + [(2, 7 * n + i, 30, 0, (1 << (i * 20)) - 1) for i in range(3)])
    tracemalloc.start()
    try:
        got = lines.match(table, 0.8)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sorted(zip(*got.to_pydict().values(), strict=True)) == [(7 * i - n, -n) for i in range(1, n)]
    assert peak < 64 << 20  # its 8 million pairs alone are twice as much


@pytest.mark.parametrize("least", [0.5, 0.8, 0.9])
def test_lines_that_no_filter_can_part(least):
    r = random.Random(3)
    entries = sorted({(r.randrange(3), i, r.randrange(1, 40)): 0 for i in range(300)}, key=lambda e: (e[0], e[2]))
    entries = [(w, i, size, r.randrange(size - int(np.ceil(least * size - 1e-9)) + 1), 0) for w, i, size in entries]
    word, name, size, place, seen = (np.array(x) for x in zip(*entries, strict=True))
    maps = lines.Maps(seen.astype(np.uint64), np.arange(len(seen) + 1))
    got = {(int(x), int(y)) for a, b in lines.suspects(word, np.zeros_like(word), name, size, place, maps, least) for x, y in zip(a, b, strict=True)}
    share = lambda a, b: np.ceil(least / (1 + least) * (size[a] + size[b]) - 1e-9)
    assert got == {(a, b) for a in range(len(word)) for b in range(a + 1, len(word)) if word[a] == word[b]
                   and min(size[a] - place[a], size[b] - place[b]) >= share(a, b)}


# Lattice near-dedup


def test_decoded_points_are_nearest():
    y = np.random.default_rng(1).uniform(-2, 2, (300, 8))
    got = lattice.decode(y)
    assert ((got % 2 == 0).all(1) | (got % 2 == 1).all(1)).all()
    assert (np.where((got % 2 == 0).all(1), got.sum(1) % 4 == 0, got.sum(1) % 4 == 0)).all()
    near = ((y - got / 2) ** 2).sum(1)
    for v in lattice.SHORTEST:
        assert (near <= ((y - (got + v) / 2) ** 2).sum(1) + 1e-9).all()


@pytest.mark.parametrize("tile", [1024, 8])
def test_vectors_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(lattice, "TILE", tile)
    r = np.random.default_rng(2)
    base = r.standard_normal((12, 64))
    near = np.concatenate([base] + [base[:4] + r.standard_normal((4, 64)) * s for s in np.linspace(0.02, 0.3, 12)]).astype(np.float32)
    rows = [(i, x.tolist(), int(i % 2)) for i, x in enumerate(near)]
    rows += [(100 + i, (near[0] * 2).tolist(), 0) for i in range(6)]
    bad = [(200, None, 0), (201, [], 0), (202, [0.0] * 64, 0), (203, [float("nan")] + [1.0] * 63, 0), (204, [None] + [1.0] * 63, 0),
           (205, [float("inf")] * 64, 0), (206, near[0].tolist(), None), (207, [1.0, 2.0], 0)]
    df = spark.createDataFrame([(i, v, c, "k", 3) for i, v, c in rows + bad], "vec_id long, embedding array<float>, label int, kept string, table int")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in lattice.near_vectors(df).collect()}
    u = np.array([v for _, v, _ in rows], float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    cosine = u @ u.T
    ids = [i for i, _, _ in rows]
    label = np.array([c for _, _, c in rows])
    linked = (cosine >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(ids), dtype=bool)
    root = np.array(ids)
    for _ in ids:
        root = np.minimum(root, np.where(linked, root[None, :], 10**6).min(1))
    want = {i: (int(linked[k].sum()), int(root[k]), i == root[k]) for k, i in enumerate(ids)} | {i: (0, i, True) for i, _, _ in bad}
    assert got == want


def test_vectors_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert lattice.near_vectors(df).count() == 0


def test_recall_of_the_cells():
    r = np.random.default_rng(3)
    u = r.standard_normal((2000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = r.standard_normal((2000, 64))
    w -= (w * u).sum(1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    a, b = lattice.cells(u), lattice.cells(0.98 * u + np.sqrt(1 - 0.98**2) * w)
    table, _ = lattice.meeting(a, b)
    assert (table < lattice.TABLES).mean() > 0.999


@pytest.mark.parametrize("size", [2, 8, 16, 32, 64, 768])
def test_close_vectors_meet_at_any_size(size):
    r = np.random.default_rng(size)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    u = unit(r.standard_normal((3000, size)))
    w = r.standard_normal(u.shape)
    w = unit(w - (w * u).sum(1, keepdims=True) * u)
    table, _ = lattice.meeting(lattice.cells(u), lattice.cells(0.98 * u + np.sqrt(1 - 0.98**2) * w))
    assert (table < lattice.TABLES).mean() > 0.999
