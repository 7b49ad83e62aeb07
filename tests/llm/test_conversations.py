"""Conversation repair against exhaustive search and a plain version over whole conversations."""

import hashlib
import random
import re
from collections import defaultdict, deque

import pytest

from tidemark.llm import conversations
from tidemark.llm.conversations import Repair, Survivors, Ways, after, chain, kept

WHITE = "\x20\t\n\v\f\r"


def exhaustive(rows):
    """(cost, edits) of the cheapest, then ASCII-least of all ways, each written out; ``rows``: initial, must go, truncated."""
    best = [(10**9, "")]

    def go(i, state, cost, edits, inserted):
        if cost > 4 * len(rows):  # deleting everything costs that
            return
        if i == len(rows) and state in (0, 3):
            best[0] = min(best[0], (cost, edits))
        if inserted < 3:
            go(i, after(state)[1], cost + 3, edits + "I", inserted + 1)
        if i < len(rows):
            initial, gone, open_end = rows[i]
            go(i + 1, state, cost + 4, edits + "D", 0)
            if not gone:
                go(i + 1, after(state)[1], cost + 3 + 3 * open_end, edits + "R", 0)
                if kept(state, initial) is not None:
                    go(i + 1, kept(state, initial), cost + 3 * open_end, edits + "K", 0)

    go(0, 0, 0, "", 0)
    return best[0]


def told(repair, rows):
    out = []
    for i, (initial, gone, open_end) in enumerate(rows):
        out += repair.row((i,), i, initial, False, open_end, 1, gone)
    out += repair.end()
    assert [o[0] for o in out] == list(range(len(rows)))
    return out


def some_rows(r, n, deleted=0.2):
    return [(r.choice("suauaua-"), r.random() < deleted, r.random() < 0.2) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_cheapest_and_least_edits(seed):
    r = random.Random(seed)
    for _ in range(250):
        rows = some_rows(r, r.randrange(1, 7), r.choice([0, 0.2, 0.7]))
        out = told(Repair(), rows)
        assert (sum(o[3] for o in out), "".join(o[1] for o in out)) == exhaustive(rows)


@pytest.mark.parametrize("seed", range(3))
def test_parts_solved_apart_and_chained(seed):
    r = random.Random(100 + seed)
    ways = Ways()
    for _ in range(120):
        rows = some_rows(r, r.randrange(2, 40))
        cuts = [0, *sorted(r.sample(range(1, len(rows)), min(len(rows) - 1, r.randrange(1, 5)))), len(rows)]
        parts, summaries = [rows[a:b] for a, b in zip(cuts, cuts[1:])], []
        for part in parts:
            trees = [Survivors(s) for s in range(4)]
            for code in part:
                for t in trees:
                    t.step(ways[code])
                    deque(t.final(), 0)
            each = [t.summary() for t in trees]
            summaries.append(([c for c, _ in each], [k for _, k in each]))
        states = chain(summaries)
        out = [o for i, (part, (s, e)) in enumerate(zip(parts, states)) for o in told(Repair(s, e if i + 1 < len(parts) else None), part)]
        whole = told(Repair(), rows)
        assert [o[1:4] for o in out] == [o[1:4] for o in whole]


def test_memory_follows_the_unresolved_part():
    r = random.Random(1)
    repair, most = Repair(), 0

    def size(node):
        return 1 + sum(size(c) for c in node[2])

    for i, (initial, gone, open_end) in enumerate(some_rows(r, 20_000)):
        deque(repair.row((i,), i, initial, False, open_end, 1, gone), 0)
        most = max(most, len(repair.waiting), size(repair.tree.root) if i % 50 == 0 else 0)
    assert most < 100


def plain(rows):
    """Report over rows (conv, turn, role, text) by whole strings per state."""
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t, " " if role is None else role, " " if text is None else text))
    out = []
    for c, rs in convs.items():
        digest = lambda x: hashlib.md5(f"{len(x[1])}:{x[1]}:{x[2]}".encode()).digest()
        rs.sort(key=lambda x: (x[0] is not None, x[0] or 0, digest(x)))
        seen, faults, illegal = set(), [], 0
        for i, (_, role, text) in enumerate(rs):
            fault = "blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WHITE)[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            illegal += i > 0 and rs[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        best = {0: (0, "", [])}
        for (_, role, text), fault in zip(rs, faults):
            new = {}
            # Inserted turns belong to the edit after them, so all three numbers of them are tried from every state
            for s, (cost, edits, said) in best.items():
                state, more, put = s, "", []
                for n in range(3):
                    ways = [(state, 4, "D", [])]
                    if fault in ("", "truncated"):
                        stays = 3 * (fault == "truncated")
                        a, e = after(state)
                        ways.append((e, 3 + stays, "R", [("user:" if a == "u" else "assistant:") + text]))
                        k = kept(state, role[:1])
                        if k is not None:
                            ways.append((k, stays, "K", [f"{role}:{text}"]))
                    for e, paid, letter, add in ways:
                        way = (cost + 3 * n + paid, edits + more + letter, said + put + add)
                        if e not in new or way[:2] < new[e][:2]:
                            new[e] = way
                    a, state = after(state)
                    more, put = more + "I", [*put, "user:" if a == "u" else "assistant:"]
            best = new
        close = {0: [], 1: ["user:", "assistant:"], 2: ["assistant:"], 3: []}
        cost, audit, said = min((c + 3 * len(close[s]), e + "I" * len(close[s]), x + close[s]) for s, (c, e, x) in best.items())
        turns = [t for t, _, _ in rs if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, slice string, edits int, conv string, cut int"


def made(r, convs, longest):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "Assistant"]
    texts = ["Yes.", "No!", "open", "What?  ", "é.", "", " \n", None, "a: b\nc.", "日本。", "end.\x0b\f"]
    rows = []
    for c in convs:
        turn = 0
        for _ in range(r.randrange(1, longest)):
            turn += r.choice([0, 1, 1, 1, 1, 3])
            text = r.choice([*texts, *[f"line {r.random()}."] * 20])
            rows += [(c, r.choice([turn, turn, turn, turn, None]), r.choice(roles), text)] * r.choice([1, 1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("slice_rows", [1_000_000, 7])
def test_report_equals_plain_version(spark, slice_rows):
    r = random.Random(slice_rows)
    rows = made(r, [*range(30), None], 12) + made(r, [100], 150) + [(101, None, "user", None), (102, -5, "user", "Long. " * 50_000)]
    df = spark.createDataFrame([(*x, "s", 1, "c", 2) for x in r.sample(rows, len(rows))], SCHEMA).repartition(4)
    got = conversations.report(df, slice_rows=slice_rows)
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=repr) == plain(rows)


def test_one_conversation_in_many_slices_and_one_row_many_times(spark):
    rows = made(random.Random(3), [1], 400) + [(1, 5, "user", "Again and again.")] * 500 + [(1, t, "assistant", "The same.") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = conversations.report(df, slice_rows=20)
    assert [tuple(x) for x in got.select(*COLUMNS).collect()] == plain(rows)


@pytest.mark.parametrize("slice_rows", [1000, 4])
def test_repaired_turns(spark, slice_rows):
    rows = made(random.Random(9), range(12), 14)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = defaultdict(list)
    for t in sorted(conversations.repair(df, slice_rows=slice_rows).collect(), key=lambda t: (t.conv, t.slice, t.place)):
        turns[t.conv].append(t)
    want = {x[0]: x for x in plain(rows)}
    assert turns.keys() == want.keys()
    for c, ts in turns.items():
        assert "".join(t.edit for t in ts) == want[c][7]
        said = [t for t in ts if t.edit != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in said))
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in said).encode()).hexdigest() == want[c][8]
        assert all(t.role is None and t.text is None for t in ts if t.edit == "D")


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(5)] + [(None, None, None, None), (None, 7, "user", "x.")]
    got = conversations.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        want += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert conversations.report(none).collect() == [] and conversations.repair(none).collect() == []
