"""Conversation structure repair: the cheapest edits after which roles alternate, found by survivor-coalescence Viterbi.

A repaired conversation has an optional system turn and then user and assistant turns in pairs, or nothing. Reading it, one of
four states holds: nothing yet, system, user, assistant. Every row moves each state on by one edit of its own (Keep, Rerole,
Delete), after inserted turns if any. For each state the cheapest way there survives; of equally cheap ones that whose
edits, read from the first on, come first in ASCII.

Survivors are leaves of a tree of backpointers. A node that nothing refers to is given up, and where the root has one child
left, all survivors share it: its edits are final and leave the tree. So memory follows the unresolved part, not the
conversation. Two ways to one place never have one as the beginning of the other, because each ends with an edit of the same
row; so the order of the survivors' complete unresolved edits is known from the order they had before and the edits added, and
is kept as a rank instead of being compared anew.

Conversations may be larger than a task. Rows without their texts are sorted and cut into slices. Of a conversation cut in
two or more, each slice is solved from every state first; the results are chained, and say in which states the
conversation crosses the slices. Then every slice is solved once more, from its state.
"""

from __future__ import annotations

import hashlib
import math
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.jobs import stored
from tidemark.session import settle

#: States while reading a repaired conversation.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What edits cost; a truncated row that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Inserted turns that end a conversation in each state.
CLOSING = ("", "II", "I", "")
#: Any state can follow what another does at no more than this above it: one turn inserted, and a kept system row deleted.
SLACK = INSERT + DELETE
#: Rows in a slice.
SLICE_ROWS = 200_000
#: One (conversation, role, text) with rows in many turns is spread over so many tasks.
SALTS = 16

WHITE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")


def after(state: int) -> tuple[str, int]:
    """The role that may follow other than a kept system turn, and the state then."""
    return ("a", ASSISTANT) if state == USER else ("u", USER)


def kept(state: int, initial: str) -> int | None:
    """State after a turn with this initial, if it may stand here."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    role, then = after(state)
    return then if initial == role else None


def moves(initial: str, gone: bool, truncated: bool) -> list[list[tuple[int, int, str]]]:
    """For every state after a row, the ways there: (state before, cost, edits), the best of each pair of states."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        state, inserted = start, ""
        for _ in range(3):  # a third inserted turn would come back to a state that one reaches
            paid = INSERT * len(inserted)
            ways = [(state, paid + DELETE, inserted + "D")]
            if not gone:
                stays = TRUNCATED if truncated else 0
                ways.append((after(state)[1], paid + REROLE + stays, inserted + "R"))
                if kept(state, initial) is not None:
                    ways.append((kept(state, initial), paid + stays, inserted + "K"))
            for end, cost, edits in ways:
                best[start, end] = min(best.get((start, end), (cost, edits)), (cost, edits))
            state, inserted = after(state)[1], inserted + "I"
    return [[(start, *best[start, end]) for start in range(4) if (start, end) in best] for end in range(4)]


class Survivors:
    """Cheapest edits to each state from one state on; final edits are handed out row by row."""

    def __init__(self, start: int = NOTHING):
        self.root: list = [None, "", []]  # parent, edits of one row, children
        self.alive: dict[int, tuple[int, int, list]] = {start: (0, 0, self.root)}  # state: cost, rank, node

    def step(self, ways: list[list[tuple[int, int, str]]]) -> None:
        """One row on; ``ways`` as ``moves`` gives them."""
        alive, found = self.alive, []
        for end in range(4):
            best = None
            for start, cost, edits in ways[end]:
                if start in alive:
                    paid, rank, node = alive[start]
                    way = (paid + cost, rank, edits)
                    if best is None or way < best[0]:
                        best = (way, end, node)
            if best is not None:
                found.append(best)
        cheapest = min(f[0][0] for f in found)
        found = sorted((f for f in found if f[0][0] <= cheapest + SLACK), key=lambda f: f[0][1:])
        before = [node for _, _, node in alive.values()]
        self.alive = {}
        for rank, ((cost, _, edits), end, parent) in enumerate(found):
            node = [parent, edits, []]
            parent[2].append(node)
            self.alive[end] = (cost, rank, node)
        for node in before:
            self.give_up(node)

    def give_up(self, node: list) -> None:
        """Frees what no survivor descends from."""
        while not node[2] and node is not self.root:
            parent = node[0]
            parent[2] = [child for child in parent[2] if child is not node]
            node = parent

    def final(self):
        """Edits that all survivors share, in order; they leave the tree."""
        while len(self.root[2]) == 1:
            self.root = self.root[2][0]
            self.root[0] = None
            yield self.root[1]

    def end(self, state: int | None) -> tuple[int, str, list[str]]:
        """Cost, closing edits and the edits still held, for the way to ``state`` or, if None, for the best end of a conversation."""
        if state is None:
            cost, _, closing, node = min(
                ((cost + INSERT * len(CLOSING[s]), rank, CLOSING[s], node) for s, (cost, rank, node) in self.alive.items()), key=lambda x: x[:3])
        else:
            (cost, _, node), closing = self.alive[state], ""
        held = []
        while node is not self.root:
            held.append(node[1])
            node = node[0]
        return cost, closing, held[::-1]

    def summary(self) -> tuple[list[int | None], list[int | None]]:
        """Costs and ranks by state."""
        return [self.alive[s][0] if s in self.alive else None for s in range(4)], [self.alive[s][1] if s in self.alive else None for s in range(4)]


def chain(parts: list[tuple[list[list[int | None]], list[list[int | None]]]]) -> list[tuple[int, int]]:
    """State before and after every part of a conversation, from what each part costs from and to every state, and in what order."""
    alive, back = {NOTHING: (0, 0)}, []
    for costs, ranks in parts:
        found = []
        for end in range(4):
            ways = [(paid + costs[start][end], rank, start) for start, (paid, rank) in alive.items() if costs[start][end] is not None]
            if ways:
                cost, rank, start = min(ways)
                found.append(((rank, ranks[start][end]), end, cost, start))
        found.sort()
        alive = {end: (cost, place) for place, (_, end, cost, _) in enumerate(found)}
        back.append({end: start for _, end, _, start in found})
    state = min((cost + INSERT * len(CLOSING[s]), rank, CLOSING[s], s) for s, (cost, rank) in alive.items())[-1]
    out = []
    for step in reversed(back):
        out.append((step[state], state))
        state = step[state]
    return out[::-1]


def roles_of(state: int, edits: str, initial: str) -> tuple[str, int]:
    """What every edit leaves, and the state then: u or a for a new role, = for a kept one, - for nothing."""
    said = []
    for e in edits:
        if e == "D":
            said.append("-")
        elif e == "K":
            said.append("=")
            state = kept(state, initial)
        else:
            role, state = after(state)
            said.append(role)
    return "".join(said), state


class Repair:
    """Edits of one slice of a conversation, row by row as they become final."""

    def __init__(self, start: int = NOTHING, goal: int | None = None, before: str | None = None, passed: int | None = None):
        """``goal``: state to reach, None at the end of the conversation; ``before``, ``passed``: initial and turn of the row before."""
        self.tree, self.state, self.goal, self.before, self.passed = Survivors(start), start, goal, before, passed
        self.waiting: deque = deque()  # rows not all of whose copies are resolved
        self.done: list = []  # the last row that is; closing edits would follow its own
        self.ways = Ways()

    def row(self, key, turn: int | None, initial: str, blank: bool, truncated: bool, n: int, again: bool):
        """One row, ``n`` times; yields what is known of rows by then."""
        illegal = n - 1 + int(self.before is not None and self.before + initial not in LEGAL)
        fresh = int(turn is not None and turn != self.passed)
        self.before, self.passed = initial, turn if turn is not None else self.passed
        faults = (n if blank else 0, 0 if blank else n if again else n - 1, int(truncated and not blank and not again), illegal, fresh)
        self.waiting.append([n, key, [], [], initial, truncated, faults])
        for i in range(n):
            self.tree.step(self.ways[initial, blank or again or i > 0, truncated])
            for edits in self.tree.final():
                yield from self.resolve(edits)

    def resolve(self, edits: str):
        """The edits of one more copy of the first waiting row."""
        row = self.waiting[0]
        roles, self.state = roles_of(self.state, edits, row[4])
        row[0] -= 1
        row[2].append(edits)
        row[3].append(roles)
        if not row[0]:
            self.done.append(self.waiting.popleft())
            if len(self.done) > 1:
                yield self.result(self.done.pop(0))

    def end(self):
        """The slice ends; yields what is left of it."""
        _, closing, held = self.tree.end(self.goal)
        for edits in held:
            yield from self.resolve(edits)
        last = self.done.pop()
        roles, self.state = roles_of(self.state, closing, "")
        last[2].append(closing)
        last[3].append(roles)
        yield self.result(last)

    @staticmethod
    def result(row: list) -> tuple:
        _, key, edits, roles, _, truncated, faults = row
        edits, roles = "".join(edits), "".join(roles)
        stays = edits.count("K") + edits.count("R") if truncated else 0
        cost = REROLE * edits.count("R") + INSERT * edits.count("I") + DELETE * edits.count("D") + TRUNCATED * stays
        return (*key, edits, roles, cost, *faults)


class Ways(dict):
    """``moves`` by kind of row, each computed once."""

    def __missing__(self, code):
        self[code] = moves(*code)
        return self[code]


def bare(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text and ``said``, a digest of role and text; null roles and texts are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"))
    return plain.withColumn("said", F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"))))


def light(plain: DataFrame) -> DataFrame:
    """Different rows without texts: conv, turn, said, initial, blank, truncated, n (copies), again (its role and text came in an earlier turn)."""
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    ends = trimmed.endswith(".") | trimmed.endswith("!") | trimmed.endswith("?")
    initial = F.substring("role", 1, 1)
    coded = plain.select("conv", "turn", "said", F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"),
                         (trimmed == "").alias("blank"), (~ends).alias("truncated"))
    once = stored(coded.groupBy("conv", "turn", "said", "initial", "blank", "truncated").agg(F.count("*").alias("n")))
    # Nulls are the smallest in a struct, as in the order of turns
    several = once.groupBy("conv", "said").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    copied = several.select(F.col("conv").alias("c"), F.col("said").alias("s"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("copy"))
    salt = F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int")  # rows of one (conv, said) differ in their turns
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")) & (F.col("salt") == F.col("copy"))
    found = once.withColumn("salt", salt).join(copied, same, "left")
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return found.select(*once.columns, again.alias("again"))


ORDER = ["conv", "turn", "said"]


def sliced(rows: DataFrame, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows in order with the number of their slice, and the conversations that lie in more than one, at most one for each slice."""
    rows = stored(rows)
    n = max(1, math.ceil(rows.count() / slice_rows))
    rows = settle(rows.repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER).withColumn("slice", F.spark_partition_id()))
    spans = rows.groupBy("conv").agg(F.min("slice").alias("lo"), F.max("slice").alias("hi")).where("lo < hi")
    return rows, settle(spans.select(F.col("conv").alias("cut")))


ROW = ["slice", "conv", "turn", "said", "initial", "blank", "truncated", "n", "again"]


def by_python(batches, columns: list[str], schema_of, fill):
    """Runs ``fill(row, out)`` on every row, None at the end, and yields what it has put into the list ``out``, batch by batch."""
    schema, out = None, []
    for batch in batches:
        schema = schema or schema_of(batch.schema)
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            fill(row, out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
    if schema is not None:
        fill(None, out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def crossings(rows: DataFrame, spans: DataFrame, kind: str) -> DataFrame:
    """Per slice of a conversation that crosses slices: at, cut, state at its start and end, whether it is the last, and the row before."""
    costs = pa.list_(pa.list_(pa.int32()))

    def solve(batches):
        ways, now = Ways(), []

        def fill(row, out):
            if now and (row is None or now[0] != row[:2]):
                key, trees, tail, high = now
                each = [t.summary() for t in trees]
                out.append((*key, [c for c, _ in each], [r for _, r in each], tail, high))
                now.clear()
            if row is None:
                return
            at, conv, turn, _, initial, blank, truncated, n, again = row
            if not now:
                now[:] = [(at, conv), [Survivors(s) for s in range(4)], None, None]
            for i in range(n):
                for tree in now[1]:
                    tree.step(ways[initial, blank or again or i > 0, truncated])
                    deque(tree.final(), 0)
            now[2:] = [initial, turn]

        def schema_of(given):
            return pa.schema([("at", pa.int32()), ("cut", given.field("conv").type), ("costs", costs), ("ranks", costs), ("tail", pa.string()), ("high", pa.int64())])

        return by_python(batches, ROW, schema_of, fill)

    cut = rows.join(spans, F.col("conv").eqNullSafe(F.col("cut")), "left_semi").sortWithinPartitions("slice", *ORDER)
    parts = cut.mapInArrow(solve, f"at int, cut {kind}, costs array<array<int>>, ranks array<array<int>>, tail string, high long")

    def join(part: pa.Table) -> pa.Table:
        part = part.sort_by("at")
        states = chain(list(zip(part["costs"].to_pylist(), part["ranks"].to_pylist(), strict=True)))
        n = len(states)
        return pa.table({
            "at": part["at"], "cut": part["cut"], "start": pa.array([s for s, _ in states], pa.int32()), "goal": pa.array([e for _, e in states], pa.int32()),
            "last": pa.array([i == n - 1 for i in range(n)]), "before": pa.array([None, *part["tail"].to_pylist()[:-1]], pa.string()),
            "passed": pa.array([None, *part["high"].to_pylist()[:-1]], pa.int64())})

    # A group has one row for each slice that the conversation lies in
    return parts.groupBy("cut").applyInArrow(join, f"at int, cut {kind}, start int, goal int, last boolean, before string, passed long")


def solved(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Per different row its edits, the roles they leave, and what it adds to the cost and counts of its conversation; ``crosses`` if that is in ``spans``."""
    kind = next(f.dataType.simpleString() for f in rows.schema if f.name == "conv")
    crossing = crossings(rows, spans, kind)
    known = rows.join(crossing, (F.col("slice") == F.col("at")) & F.col("conv").eqNullSafe(F.col("cut")), "left").drop("at", "cut")
    fields = f"slice int, conv {kind}, turn long, said binary, crosses boolean, edits string, roles string, cost long, blank long, duplicate long, truncated long, illegal long, fresh long"

    def run(batches):
        now = []

        def fill(row, out):
            if now and (row is None or now[0] != row[:2]):
                out.extend(now[1].end())
                now.clear()
            if row is None:
                return
            at, conv, turn, said, initial, blank, truncated, n, again, start, goal, last, before, passed = row
            if not now:
                now[:] = [(at, conv), Repair() if start is None else Repair(start, None if last else goal, before, passed)]
            out.extend(now[1].row((at, conv, turn, said, start is not None), turn, initial, blank, truncated, n, again))

        def schema_of(given):
            types = [pa.int32(), given.field("conv").type, pa.int64(), pa.binary(), pa.bool_(), pa.string(), pa.string()] + [pa.int64()] * 6
            return pa.schema([(f.split()[0], t) for f, t in zip(fields.split(", "), types, strict=True)])

        return by_python(batches, [*ROW, "start", "goal", "last", "before", "passed"], schema_of, fill)

    return known.sortWithinPartitions("slice", *ORDER).mapInArrow(run, fields)


def turns_of(edited: DataFrame) -> DataFrame:
    """One row per edit, in the order of the sorted rows of ``edited``, whose edits come with their text or before it."""
    kind = next(f.dataType.simpleString() for f in edited.schema if f.name == "conv")
    fields = f"conv {kind}, slice int, place long, edit string, role string, text string"
    full = {"u": "user", "a": "assistant"}

    def run(batches):
        # What waits for its text; conversation and slice; place in it
        now = [None, None, 0]

        def say(edits, roles, role, text, out):
            conv, at = now[1]
            for e, r in zip(edits, roles, strict=True):
                said = None if r == "-" else role if r == "=" else full[r]
                out.append((conv, at, now[2], e, said, text if e in "KR" else "" if e == "I" else None))
                now[2] += 1

        def fill(row, out):
            if row is None:
                return
            conv, at, edits, roles, role, text = row
            if edits is not None:
                if now[1] != (conv, at):
                    now[1:] = [(conv, at), 0]
                now[0] = (edits, roles)
                if "K" not in edits and "R" not in edits:
                    say(edits, roles, None, None, out)
                    now[0] = None
            if text is not None and now[0] is not None:
                say(*now[0], role, text, out)
                now[0] = None

        def schema_of(given):
            return pa.schema([("conv", given.field("conv").type), ("slice", pa.int32()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

        return by_python(batches, ["conv", "slice", "edits", "roles", "role", "text"], schema_of, fill)

    return edited.mapInArrow(run, fields)


def digests(turns: DataFrame) -> DataFrame:
    """conv, audit and repaired_sha256 of sorted turns; a conversation's digest has to see it in sequence, but in no memory."""
    kind = next(f.dataType.simpleString() for f in turns.schema if f.name == "conv")

    def run(batches):
        now = []

        def fill(row, out):
            if now and (row is None or now[0] != row[0]):
                out.append((now[0], "".join(now[1]), now[2].hexdigest()))
                now.clear()
            if row is None:
                return
            conv, edit, role, text = row
            if not now:
                now[:] = [conv, [], hashlib.sha256(), False]
            now[1].append(edit)
            if role is not None:
                now[2].update(f"{chr(10) if now[3] else ''}{role}:{text}".encode())
                now[3] = True

        def schema_of(given):
            return pa.schema([("conv", given.field("conv").type), ("audit", pa.string()), ("repaired_sha256", pa.string())])

        return by_python(batches, ["conv", "edit", "role", "text"], schema_of, fill)

    return turns.select("conv", "edit", "role", "text").mapInArrow(run, f"conv {kind}, audit string, repaired_sha256 string")


class Repaired:
    """``repair`` as far as both its results need: solved rows, and turns of conversations within a slice and across slices."""

    def __init__(self, rows: DataFrame, conv: str, turn: str, role: str, text: str, slice_rows: int):
        plain = bare(rows, conv, turn, role, text)
        ordered, spans = sliced(light(plain), slice_rows)
        self.solved = stored(solved(ordered, spans))
        crosses = F.col("conv").eqNullSafe(F.col("cut"))
        edits = self.solved.where(~F.col("crosses")).select(*ORDER, "slice", "edits", "roles", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
        texts = plain.join(spans, crosses, "left_anti").select(*ORDER, *[F.lit(None).cast(edits.schema[c].dataType).alias(c) for c in ("slice", "edits", "roles")], "role", "text")
        # A conversation within a slice meets its texts where it is put together
        together = edits.unionByName(texts).repartition("conv").sortWithinPartitions(*ORDER, F.col("edits").isNull())
        self.whole = turns_of(together)
        # One across slices meets them by row, so that no task gets all of it
        apart = plain.join(spans, crosses, "left_semi").dropDuplicates(ORDER)
        both = apart.withColumnsRenamed({"conv": "c", "turn": "t", "said": "s"}).join(
            self.solved.where("crosses"), F.col("c").eqNullSafe(F.col("conv")) & F.col("t").eqNullSafe(F.col("turn")) & (F.col("s") == F.col("said")))
        both = both.select(*ORDER, "slice", "edits", "roles", "role", "text").repartition("slice", "conv").sortWithinPartitions("slice", *ORDER)
        self.cut = turns_of(both)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per edit: conv, slice, place (order within a slice, slices in order), edit (K, R, D or I), role and text, both null where deleted.

    The repaired conversation is what is not deleted, in that order. Rows follow by turn, nulls first, and then by a digest of role
    and text, so repeated rows stand together. Null roles and texts are one space; an empty text or one of white space is
    blank and goes, and so does one whose role and text came before. A null id is a conversation of its own. Other columns are
    ignored, and an empty table gives none. Conversations of any size and texts of any length are handled; see the module's text.
    """
    made = Repaired(rows, conv, turn, role, text, slice_rows)
    return made.whole.unionByName(made.cut)


def report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per conversation with rows: conv, gaps, blank, duplicate, truncated, illegal, cost, audit (its edits) and repaired_sha256; rows as in ``repair``."""
    made = Repaired(rows, conv, turn, role, text, slice_rows)
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.sum("fresh"), F.lit(0)).alias("gaps")
    counts = made.solved.groupBy("conv").agg(gaps, *sums)
    said = digests(made.whole).unionByName(digests(made.cut.repartition("conv").sortWithinPartitions("conv", "slice", "place")))
    found = said.withColumnRenamed("conv", "c")
    return counts.join(found, F.col("conv").eqNullSafe(F.col("c"))).drop("c")


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults, by crc32 of ``conv:turn`` modulo 20: 0 drops, 1 empties, 2 loses its full stops, 3 repeats, 4 speaks as user; nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % 20
    spoken = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(said(text), ".!?", "")).otherwise(said(text))
    rows = rows.withColumn("fault", fault).where("fault <> 0")
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(conv, turn, F.when(F.col("fault") == 4, "user").otherwise(said(role)).alias(role), spoken.alias(text), copies.alias("copy")).drop("copy")
