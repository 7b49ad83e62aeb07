"""Scoring, classifying, formatting, packing and retrieval: brute force, round trips, held-out accuracy and edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, contamination, language, mixing, packing, toxicity, words
from tidemark.llm.jobs import components, hashed_counts, held_out

SCHEMA = "doc_id long, text string, lang string, score string, matches int, offending long, row int"
PATH = public_tokenizers.path("word_bpe_49k.json")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2, 3) for i, t in rows], SCHEMA)


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "12 34 ..."), (5, "Zürich, ÀÉ!   x\x1cy"), (6, "same"), (6, "same"), (None, "same"), (8, "word " * 120_000)]


# Shared helpers


def test_word_spans_and_hashes():
    texts = ["ab cd", None, "", "x  ab\ncd ", "cd", "\x0b\x0cq\xa0r"]
    buf, offsets = words.texts(pa.array(texts))
    start, end, first = words.words(buf, offsets)
    raw = buf.tobytes()
    found = [[raw[start[i] : end[i]] for i in range(first[r], first[r + 1])] for r in range(len(texts))]
    assert found == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    h = words.span_hashes(words.prefix(buf), start, end)
    assert len(set(zip(h.tolist(), sum(found, []), strict=True))) == len(set(h.tolist())) == len(set(sum(found, [])))


def test_components_and_counts(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 100), (7, 7), (50, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in [*range(1, 41), 50]} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    df = spark.createDataFrame([("a a b",), (None,), ("b",)], "t string").repartition(3)

    def count(column):
        buf, offsets = words.texts(column)
        start, _, _ = words.words(buf, offsets)
        yield buf[start].astype(np.int64)

    got = hashed_counts(df, "t", 128, count)
    assert got[97] == 2 and got[98] == 2 and got.sum() == 4


def test_empty_text_may_come_first():
    assert len(words.powers(0x1234567, 0)) == 0 and words.powers(0x1234567, 2).tolist() == [1, 0x1234567]


# 1 Context mixing


def test_probabilities_sum_to_one(spark):
    r = random.Random(0)
    rows = [(i, " ".join(r.choice(["the", "then", "cat", "dog", "ÄB"]) for _ in range(30))) for i in range(40)]
    model = mixing.train(frame(spark, rows))
    key, word = mixing.contexts(*mixing.stream(*words.texts(pa.array(["the cat", "zzz"]))))
    for k, w in zip(key[::2], word[::2], strict=True):
        every = (k & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** model.costs(every, np.full(256, w))).sum() - 1) < 1e-6


def test_names_in_order():
    r = np.random.default_rng(0)
    for high, low in ((1 << 60, 1 << 3), (4, 1 << 3), (1, 1 << 9), (1, 1)):  # names that differ in few high or in few low bits
        name = r.integers(0, high, 999, np.uint64) * np.uint64(16) + r.integers(0, low, 999, np.uint64)
        by, first = mixing.groups(name)
        assert np.array_equal(name[by], np.sort(name)) and np.array_equal(np.sort(by), np.arange(999))
        assert np.array_equal(name[by[first]], np.unique(name))
    assert [len(x) for x in mixing.groups(np.zeros(0, np.uint64))] == [0, 0]


def test_places_of_half_a_byte_lie_together():
    key, word = mixing.contexts(*mixing.stream(*words.texts(pa.array(["The cat sat on the mat", "ÄB"]))))
    got = list(mixing.bits(mixing.kinds(key, word), key & np.uint64(255)))
    byte = (key & np.uint64(255)).astype(int)
    for j, (node, bit, at) in enumerate(got):
        assert (node == (256 + byte) >> 8 - j).all() and (bit == byte >> 7 - j & 1).all()
        assert (at // 16 == got[j // 4 * 4][2] // 16).all() and (at // mixing.SLOTS == np.arange(mixing.KINDS)[:, None]).all()
    # Places of one context differ from bit to bit
    assert all((got[a][2] != got[b][2]).all() for half in (0, 4) for a in range(half, half + 4) for b in range(half, a))


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 400)
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["The", "then", "cat", "dog", "ab\ncd"]) for _ in range(30))) for i in range(60)] + EDGES[:-1]
    docs = frame(spark, rows).withColumn("held_out", held_out("doc_id", 5, 1))
    got = mixing.score(docs, mixing.train(docs.where("not held_out"))).collect()
    assert len(got) == len(rows)
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [b"\n"]
    count = Counter(w for i, t in rows if not held[i] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = Counter((i, held[i], len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n,
                    round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    unseen = [x for x in got if x.held_out and x.n_tokens > 10]
    assert unseen and all(x.score < 0 for x in got)
    assert sum(x.score for x in unseen) > 2.0 * sum(x.base_score for x in unseen)


def test_all_texts_teach_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARE", 4000)
    monkeypatch.setattr(mixing, "MERGED", 600)
    r = random.Random(2)
    text = lambda n: " ".join(r.choice(["The", "then", "cat", "dog", "ab"]) + str(r.randrange(30)) for _ in range(n))
    long = [(i, text(7000)) for i in range(3)]  # each is longer than 32,000 bytes
    model = mixing.train(frame(spark, long))
    assert not np.allclose(model.by_node[1], 0.15) and not np.allclose(model.by_trust, 0.15)
    many = [(i, text(5)) for i in range(1500)] + long[:1]
    key, word = mixing.contexts(*mixing.stream(*words.texts(pa.array([t for _, t in many]))))
    want = Counter(zip(key.tolist(), word.tolist(), strict=True))
    for parts in (1, 5):
        docs = frame(spark, many).repartition(parts).select("text")
        rows = mixing.merge(docs, sum(len(t) for _, t in many)).collect()
        got = {(x.key % (1 << 64), x.word % (1 << 64)): x.n for x in rows}
        assert len({x.slice for x in rows}) > 5 and len(got) == len(rows) and got == want


def test_scores_of_nothing(spark):
    docs = frame(spark, []).withColumn("held_out", F.lit(False))
    assert mixing.score(docs, mixing.train(docs)).count() == 0
    text = frame(spark, [(1, "a b")]).withColumn("held_out", F.lit(True))
    row = mixing.score(text, mixing.train(docs)).first()
    assert row.n_known == 0 and row.train_tokens == 0 and row.score == pytest.approx(4 * 8 * math.log10(0.5), rel=0.2)


# 2 Chat formatting


def test_round_trip(spark):
    marks = ["</s>[INST] ok [/INST]", r"<\/s> [\INST]", "<|turn|>user\nhi<|end|>\n", r"<\\|end|>", "", None, "plain\n", "<<SYS>>", "é" * 5]
    r = random.Random(2)
    rows = [(c, t, r.choice(["user", "assistant", "system", "a\nb<|end|>", None]), r.choice(marks)) for c in range(12) for t in range(r.randrange(1, 9))]
    rows += [(77, i // 2, "assistant", f"hot {i} </s>") for i in range(3000)] + [(None, 0, "user", "x"), (5, None, "assistant", "y")]
    rows += rows[:3]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, part string")
    formatted = chat.format_chats(df)
    assert formatted.where("conv_id = 77").count() > 1  # a hot conversation lies in several parts
    for x in formatted.collect():
        body = re.sub(r"<\|turn\|>[^\n]*\n|<\|end\|>\n", "", x.formatted)
        assert not re.search(r"</?s>|\[/?INST\]|<\|", body)
    got = {x.conv_id: x for x in chat.read_back(formatted).collect()}
    import hashlib

    order = lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")
    for c in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == c), key=order)
        said = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        turns = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine)
        assert got[c].n_turns == len(mine)
        assert got[c].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


# 5 Packing


def test_word_tokenizer_is_the_tokenizer():
    from tokenizers import Tokenizer

    plain, mine = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH, cache=50)
    texts = ["a,b <|endoftext|> X", "İstanbul ΣΑΣ, é, é, ×, x'S, it's, don't!! …, ５,6  b\x1cc <|STARTOFTEXT|>, <|startoftext|>.", "", "  ",
             "日本語, テスト! ǅ, ß; Å. K", "Hello, world... (really?) foo_bar; #tag a.b.c !? 12:30", "mot, mot x"] + [f"word{i}, next." for i in range(100)]
    for batch in (texts, texts[:1], texts[1:3], texts[4:5]):
        ids, at = mine.encode(*words.texts(pa.array(batch)))
        for i, t in enumerate(batch):
            assert ids[at[i] : at[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_packing_round_trip(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "GROUP", 40)
    monkeypatch.setattr(packing, "STRETCH", 10_000)
    r = random.Random(5)
    rows = EDGES + [(100 + i, " ".join(r.choice(["alpha", "beta,", "gamma."]) for _ in range(r.randrange(3000)))) for i in range(120)]
    pieces = packing.tokenize(frame(spark, rows), PATH)
    got = [x.asDict() for x in packing.pack(pieces, len(rows)).collect()]
    plain = Tokenizer.from_file(PATH)
    docs = {}
    for x in got:
        docs.setdefault((x["doc_id"], x["row"]), []).append(x)
    built = Counter()
    for (i, _), parts in docs.items():
        parts.sort(key=lambda x: x["piece"])
        assert [x["piece"] for x in parts] == list(range(len(parts)))
        assert all(x["length"] == 2048 for x in parts[:-1]) and [x["start"] for x in parts] == [2048 * k for k in range(len(parts))]
        assert all(zlib.crc32(bytes(x["ids"])) == x["ids_crc32"] and len(x["ids"]) == 4 * x["length"] for x in parts)
        built[i, b"".join(bytes(x["ids"]) for x in parts)] += 1
    assert built == Counter((i, np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, t in rows)
    bins = {}
    for x in got:
        bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(x["length"] for x in got)
    assert len(bins) <= 1.03 * total / 2048 + 4
    assert packing.pack(packing.tokenize(frame(spark, []), PATH, carry_ids=False), 0).count() == 0


def test_sum_of_squares():
    which, at = packing.place(np.array([6, 4, 5, 5, 10, 3, 3, 4]), 10)
    assert len(set(which.tolist())) == 4  # 40 of 40
    for b in set(which.tolist()):
        assert sorted(at[which == b])[0] == 0


# 6 Decontamination


def brute_common(a, b, weight):
    best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + weight[i] if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_subsequences():
    r = random.Random(6)
    for _ in range(100):
        a, b = ([r.randrange(5) for _ in range(r.randrange(1, 12))] for _ in range(2))
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert contamination.common_length(masks, b, len(a)) == brute_common(a, b, [1] * len(a))
        weight = [r.choice([1.0, 2.0, 5.0]) for _ in a]
        assert contamination.common_weight(np.array(a), np.array(weight), np.array(b)) <= sum(weight) + 1e-9


def test_items_are_found(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("bcdfg") + r.choice("aeiou") for _ in range(4))
    common = [word() for _ in range(50)]
    text = lambda n: [r.choice(common) if r.random() < 0.4 else word() for _ in range(n)]
    items = [" ".join(text(n)) + ". " + " ".join(text(8)) + "." for n in (10, 20, 30, 40)]
    clean = [(i, " ".join(text(200))) for i in range(60)]
    planted = [(100 + i, " ".join(text(70)) + "\n" + x.upper() + "\n" + " ".join(text(90))) for i, x in enumerate(items)]
    loose = []
    for i, x in enumerate(items):  # every fourth word of the question is another one, the answer stands
        w = x.split()
        w[: len(w) - 8] = [word() if k % 4 == 3 else y for k, y in enumerate(w[: len(w) - 8])]
        loose.append((200 + i, " ".join(text(33)) + " " + " ".join(w) + " " + " ".join(text(40))))
    docs = frame(spark, clean + planted + loose + EDGES[:-1] + [(300, " ".join(text(30_000)) + " " + items[0])])
    bench = spark.createDataFrame([(i, x, 0) for i, x in enumerate(items)] + [(8, None, 0), (9, "", 0), (9, "...", 0)], "item_id long, text string, doc_id int")
    got = {x.doc_id: [m.item_id for m in x.matches] for x in contamination.find_items(docs, bench).collect()}
    assert {i: m for i, m in got.items() if m} == {100 + i: [i] for i in range(4)} | {200 + i: [i] for i in range(4)} | {300: [0]}
    assert contamination.find_items(docs.limit(0), bench).count() == 0
    assert contamination.find_items(docs, bench.limit(0)).where(F.size("matches") > 0).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(contamination, "ITEMS", 2)
    items = [" ".join(f"q{i}x{k}" for k in range(25)) for i in range(5)]
    docs = frame(spark, [(i, "before " + x + " after") for i, x in enumerate(items)] + [(50, items[0] + " " + items[3]), (51, "nothing of it")])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {x.doc_id: sorted(m.item_id for m in x.matches) for x in contamination.find_items(docs, bench, carry=False).collect()}
    assert got == {i: [i] for i in range(5)} | {50: [0, 3], 51: []}


def test_all_passages_are_counted(spark, monkeypatch):
    monkeypatch.setattr(contamination, "PAIRS", 500)
    monkeypatch.setattr(contamination, "SUMMED", 300)
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(40)}" for _ in range(r.choice([0, 1, 47, 48, 49, 130]))) for _ in range(150)] * 2 + [None]
    docs = frame(spark, list(enumerate(texts))).repartition(5)
    weight = np.random.default_rng(1).random(contamination.TERMS).astype(np.float32) + 0.1
    known = np.unique(contamination.places(contamination.word_hashes([" ".join(f"w{i}" for i in range(30))])[0]))
    column = np.full(contamination.TERMS, -1, np.int32)
    column[known] = np.arange(len(known))
    want, n = np.zeros((len(known), len(known))), 0
    for t in texts:
        at = contamination.places(contamination.word_hashes([t or ""])[0])
        for lo in range(0, len(at), 48):
            row = np.bincount(at[lo : lo + 48], minlength=contamination.TERMS) * weight
            row = row[known] / np.sqrt((weight[at[lo : lo + 48]].astype(float) ** 2).sum())
            want, n = want + np.outer(row, row), n + 1
    rows = contamination.occurring(docs, "text", 20_000, weight, column, len(known))
    got = np.zeros_like(want)
    for x in rows.where(F.col("i") < len(known)).collect():
        got[x.i, x.j] += x.v
    assert rows.where(F.col("i") == len(known)).agg(F.sum("v")).first()[0] == n
    assert np.allclose(got, want, rtol=1e-5)
    basis = np.random.default_rng(2).standard_normal((len(known), 4))
    assert np.allclose(contamination.product(rows, np.arange(len(known)), basis), want @ basis, rtol=1e-3, atol=1e-3)


def test_products_of_few_rows_at_once(spark, monkeypatch):
    monkeypatch.setattr(contamination, "LOOKED", 40)
    monkeypatch.setattr(contamination, "ROWS", 3)
    rng = np.random.default_rng(4)
    matrix = rng.random((30, 30)) * (rng.random((30, 30)) < 0.4)
    rows = spark.createDataFrame([(i, j, float(matrix[i, j])) for i, j in zip(*(x.tolist() for x in np.nonzero(matrix)), strict=True)], "i long, j long, v double")
    rows = rows.repartition(3, "i").sortWithinPartitions("i")
    place = np.where(np.arange(30) % 4 == 0, -1, np.cumsum(np.arange(30) % 4 != 0) - 1)
    some = np.flatnonzero(place >= 0)
    basis = rng.standard_normal((len(some), 5))
    assert np.allclose(contamination.product(rows, place, basis), matrix[np.ix_(some, some)] @ basis, atol=1e-4)


def planted(spark, sizes, copies, seed, size=150):
    """Texts of frequent and rare words, of which some hold an item verbatim: documents, benchmark and the pairs (document, item)."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randrange(2, 5))) for _ in range(3000)]
    share = [1 / (i + 3) for i in range(len(vocabulary))]
    text = lambda n: r.choices(vocabulary, share, k=n)
    items = [text(n - n // 4) + ["."] + text(n // 4) for n in sizes]
    rows, pairs = [], set()
    for item, doc in enumerate(x for x, n in enumerate(copies) for _ in range(n)):
        rows.append((item, " ".join(text(r.randrange(size)) + items[doc] + text(r.randrange(size)))))
        pairs.add((item, doc))
    rows += [(len(rows) + i, " ".join(text(size))) for i in range(200)]
    return frame(spark, rows), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"), pairs


def found_items(docs, bench):
    return {(x.doc_id, m.item_id) for x in contamination.find_items(docs, bench, carry=False).collect() for m in x.matches}


def index_of(texts, weight, share_least):
    items, answers = contamination.word_hashes(texts), contamination.word_hashes([contamination.answer_of(t) for t in texts])
    place, item, share, column = [], [], [], np.full(contamination.TERMS, -1, np.int32)
    for i, x in enumerate(items):
        at, one = np.unique(contamination.places(x), return_index=True)
        each = contamination.weights_of(weight, x)
        place, item, share = [*place, *at], [*item, *[i] * len(at)], [*share, *each[one] / each.sum()]
    place, item, share = np.array(place), np.array(item), np.array(share)
    by = np.argsort(place, kind="stable")
    term, first = np.unique(place[by], return_index=True)
    column[term] = np.arange(len(term))
    index = contamination.Index(list(range(len(texts))), weight, [], items, answers, np.array([len(x) for x in items]), np.full(len(texts), share_least), column, np.append(first, len(by)), item[by], share[by])
    return index, [dict(zip(place[item == i].tolist(), share[item == i].tolist(), strict=True)) for i in range(len(texts))]


def test_weights_of_an_item_are_looked_up_once(monkeypatch):
    index, _ = index_of([" ".join(f"w{i}" for i in range(20))], np.ones(contamination.TERMS, np.float32), 0.5)
    docs = [" ".join(["w3"] * 30)] * 40 + [" ".join(f"w{i}" for i in range(20))]  # the first bound an item, and do not hold it
    h, first, _ = contamination.terms(*words.texts(pa.array(docs)))
    calls, real = [], contamination.weights_of
    monkeypatch.setattr(contamination, "weights_of", lambda *x: calls.append(1) or real(*x))
    found = contamination.check(index, h, first, [{w: 1 << i for i, w in enumerate(index.items[0].tolist())}])
    assert [x[:2] for x in found] == [(40, 0)] and found[0][3] == pytest.approx(1) and len(calls) < 10


def test_windows_are_bounded_by_all_their_words():
    r = random.Random(4)
    sizes = [30, 3, 70, 16, 17, 700, 30, 5]  # not by size, with windows of several kinds
    texts = [" ".join(f"w{r.randrange(400)}" for _ in range(n)) for n in sizes]
    index, of = index_of(texts, np.random.default_rng(2).random(contamination.TERMS).astype(np.float32) + 0.1, 0.3)
    column = index.column
    docs = [" ".join(f"w{r.randrange(800)}" for _ in range(n)) for n in (300, 1, 0, 90)] + [texts[2], texts[5]]
    h, rows, _ = contamination.terms(*words.texts(pa.array(docs)))
    start, at = contamination.segments(rows, len(h))
    got = {(s, i, bool(w)): b for s_, i_, b_, w in contamination.bounds(index, column[contamination.places(h)], start, at) for s, i, b in zip(s_.tolist(), i_.tolist(), b_.tolist(), strict=True)}
    want = {}
    for row in range(len(docs)):
        for s in range(at[row], at[row + 1]):
            for i in range(8):
                side = -(-sizes[i] // contamination.SEGMENT)
                for wide, lo, hi in ((False, s, s + contamination.windows(index)[i]), (True, s - side, s + side + contamination.SEGMENTS)):
                    some = h[start[max(lo, at[row])] : start[min(hi, at[row + 1])]]
                    bound = sum(of[i].get(p, 0.0) for p in contamination.places(some).tolist())
                    if bound >= 0.3:
                        want[s, i, wide] = bound
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("cells", [1, 4000])
def test_windows_in_parts(monkeypatch, cells):
    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(300)}" for _ in range(n)) for n in (30, 3, 70, 200, 17)]
    index, _ = index_of(texts, np.random.default_rng(3).random(contamination.TERMS).astype(np.float32) + 0.1, 0.3)
    docs = [" ".join(f"w{r.randrange(400)}" for _ in range(r.randrange(300))) for _ in range(20)] + texts
    h, rows, _ = contamination.terms(*words.texts(pa.array(docs)))
    start, at = contamination.segments(rows, len(h))

    def bounded():
        return sorted((s, i, w, round(b, 9)) for s_, i_, b_, w in contamination.bounds(index, index.column[contamination.places(h)], start, at) for s, i, b in zip(s_.tolist(), i_.tolist(), b_.tolist(), strict=True))

    whole = bounded()
    monkeypatch.setattr(contamination, "CELLS", cells)
    monkeypatch.setattr(contamination, "BLOCK", 3)  # sums of blocks do not change what is found
    assert bounded() == whole and len(whole) > 20


def test_windows_without_enough_different_words_are_no_candidates(monkeypatch):
    monkeypatch.setattr(contamination, "LOOKED", 50)
    item = " ".join(f"w{i}" for i in range(20))
    index, _ = index_of([item], np.ones(contamination.TERMS, np.float32), 0.5)
    docs = [" ".join(["w3"] * 30)] * 40 + [item, " ".join(f"w{i}" for i in range(9)), " ".join(f"w{i}" for i in range(11))]
    h, first, _ = contamination.terms(*words.texts(pa.array(docs)))
    assert set(contamination.candidates(index, h, first)[0].tolist()) == {40, 42}


def test_cosines_by_sums_over_words(monkeypatch):
    monkeypatch.setattr(contamination, "LOOKED", 30)
    r, rng = random.Random(9), np.random.default_rng(9)
    h = contamination.word_hashes([" ".join(f"w{r.randrange(60)}" for _ in range(400))])[0]
    weight = rng.random(contamination.TERMS).astype(np.float32)
    weight[contamination.places(h[:5])] = 0
    term = np.unique(contamination.places(h[::7]))
    column = np.full(contamination.TERMS, -1, np.int32)
    column[term] = np.arange(len(term))
    index, _ = index_of(["w1", "w2", "w3"], weight, 0.5)
    index.spaces.append(contamination.Space(column, rng.standard_normal((len(term), 3)).astype(np.float32)))
    lo = np.array([r.randrange(300) for _ in range(50)] + [7])
    hi, item = lo + np.array([r.randrange(1, 90) for _ in range(50)] + [0]), np.array([r.randrange(3) for _ in range(51)])
    want = []
    for a, b, i in zip(lo, hi, item, strict=True):
        at = contamination.places(h[a:b])
        mine = at[column[at] >= 0]
        want.append((weight[mine] * index.spaces[0].cosine[column[mine], i]).sum() / np.sqrt(max((weight[at].astype(float) ** 2).sum(), 1e-9)))
    assert np.allclose(contamination.cosines(index, h, lo, hi, item), want, atol=1e-5)



@pytest.mark.parametrize("n", [200, 1000, 2000])
def test_recall_does_not_fall_with_items(spark, n):
    sizes = [16 + i % 44 for i in range(n)]
    docs, bench, pairs = planted(spark, sizes, [1] * n, n)
    assert pairs <= found_items(docs, bench)


@pytest.mark.parametrize("size", [4, 6, 8, 16, 48, 700, 1500])
def test_items_of_any_length(spark, size):
    docs, bench, pairs = planted(spark, [size] * 12, [5] * 12, size)
    assert pairs <= found_items(docs, bench)


def test_widely_leaked_items(spark):
    r = random.Random(5)
    rare = lambda n: " ".join(f"w{r.randrange(1 << 30)}" for _ in range(n))
    items = [rare(n - 4) + " . " + rare(4) for n in (16, 18, 24)]
    docs = frame(spark, [(i, rare(70) + " " + items[i % 3] + " " + rare(70) if i < 300 else rare(150)) for i in range(330)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert found_items(docs, bench) == {(i, i % 3) for i in range(300)}


def test_few_heavy_words_can_be_enough(spark):
    r = random.Random(8)
    common = [f"c{i}" for i in range(40)]
    rare = [f"rare{i}" for i in range(9)]
    item = sum(([x, *r.sample(common, 4)] for x in rare), []) + ["."] + ["answer", "stands"]
    other = [x if not x.startswith("c") else r.choice(common) for x in item]
    docs = frame(spark, [(0, " ".join(other))] + [(1 + i, " ".join(r.choices(common, k=300))) for i in range(300)])
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert found_items(docs, bench) == {(0, 7)}


# 9 Toxicity


def test_offending_sentences(spark):
    r = random.Random(9)
    plain = lambda: " ".join(r.choice(["sun", "rain", "field", "house", "tree", "bird"]) for _ in range(6))
    bad = lambda: "you " + r.choice(["grumbo", "zorkel", "fnarp"]) + " there"
    rows, labels = [], []
    for i in range(600):
        s = [plain() for _ in range(r.randrange(1, 30))]
        if i % 4 == 0:
            s.insert(r.randrange(len(s) + 1), bad())
        rows.append((i, ". ".join(s) + "."))
        labels += [(i, int(i % 4 == 0), "x")] * (1 + (i % 50 == 0))
    docs = frame(spark, rows)
    known = spark.createDataFrame(labels + [(None, 1, "x"), (3, None, "x")], "doc_id long, toxic int, text string")
    model = toxicity.train(docs.where(~held_out("doc_id", 3, 1)), known)
    got = toxicity.detect(docs.where(held_out("doc_id", 3, 1)), model).collect()
    assert len(got) > 100 and sum((x.doc_id % 4 == 0) == (x.predicted == 1) for x in got) >= 0.99 * len(got)
    for x in got:
        raw = x.text.encode()
        said = [raw[s.start : s.end].decode() for s in x.offending]
        assert all(re.search("grumbo|zorkel|fnarp", s) for s in said) and len(said) == (x.doc_id % 4 == 0)


def test_toxicity_edges(spark):
    model = toxicity.train(frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    got = toxicity.detect(frame(spark, EDGES), model).collect()
    assert len(got) == len(EDGES) and all(0 <= x.score <= 1 for x in got)
    assert all(x.score == 0 and x.offending == [] for x in got if x.doc_id in (1, 2))
    one = spark.createDataFrame([(6, 1)], "doc_id long, toxic int")
    assert toxicity.detect(frame(spark, EDGES), toxicity.train(frame(spark, EDGES), one)).count() == len(EDGES)


def test_toxicity_held_out(spark):
    from tidemark.llm.queries import QUERIES, table

    sf = "/root/testdata/sf0.1"
    got = QUERIES["op9_toxicity"](spark, sf).where("held_out").join(table(spark, sf, "labels"), "doc_id").select("predicted", "toxic").collect()
    hits = sum(x.predicted for x in got if x.toxic == 1) / sum(x.toxic for x in got)
    false = sum(x.predicted for x in got if x.toxic == 0) / sum(x.toxic == 0 for x in got)
    assert hits > 0.7 and false < 0.03


# 10 Language ID


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_lie_apart(n):
    code = language.codewords(n)
    apart = (code[:, None, :] != code[None, :, :]).sum(2) + 1000 * np.eye(n, dtype=int)
    assert apart.min() >= (code.shape[1] + 1) // 2 if n <= 5 else apart.min() >= code.shape[1] // 4
    best, share, lead = language.decode(3.0 * code, code)
    assert best.tolist() == list(range(n)) and (share > 1 / n).all() and (lead > 0).all()


def test_language_held_out(spark):
    from tidemark.llm.queries import QUERIES, table

    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_language_id"](spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(x.lang == x.lang_pred for x in got) >= 0.99 * len(got)


def test_language_edges(spark):
    train = frame(spark, [(i, "the cat and the dog") for i in range(5)]).union(frame(spark, [(9, "der hund und die katze")]).withColumn("lang", F.lit("de")))
    train = train.union(frame(spark, [(10, "nulls")]).withColumn("lang", F.lit(None).cast("string"))).union(frame(spark, [(11, None)]))
    model = language.train(train)
    assert model.languages == ["de", "en"]
    got = {x.doc_id: x for x in language.identify(frame(spark, [*EDGES, (20, "und die katze"), (21, "and the cat")]), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4 and all(got[i].score == 0 and got[i].ambiguous for i in (1, 2, 3, 4))
    assert (got[20].lang_pred, got[21].lang_pred) == ("de", "en") and all(0 <= x.score <= 1 for x in got.values())
    assert language.identify(frame(spark, []), model).count() == 0
    nothing = language.identify(frame(spark, EDGES), language.train(frame(spark, []))).collect()
    assert {x.lang_pred for x in nothing} == {"und"}
    alone = language.identify(frame(spark, EDGES), language.train(train.where("lang = 'de'"))).where("doc_id = 5").first()
    assert (alone.lang_pred, alone.score) == ("de", 1.0)
