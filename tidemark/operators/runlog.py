"""Analytics over run logs: status, roll-up, conditions, capacity, retries, gates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tidemark.operators.aggregates import latest_per_key
from tidemark.operators.contraction import Levels, contract
from tidemark.operators.ordered import GROUP_ROWS, By, row_number, running_sum, shift
from tidemark.operators.predicates import all_of
from tidemark.operators.skew import lookup
from tidemark.session import settle

# Run statuses in the order of the tables below.
STATUSES = ["submitted", "running", "failed", "suspended", "succeeded", "skipped"]
FINAL = ["succeeded", "skipped"]

# Status of "A -> B", a row per status of A and a column per status of B.
# None marks pairs that cannot occur.
IN_SEQUENCE = {
    "submitted": ["submitted", None, None, "submitted", None, None],
    "running": ["running", None, None, "running", None, None],
    "failed": ["running", None, None, "failed", None, None],
    "suspended": ["suspended", None, None, "suspended", None, None],
    "succeeded": ["running", "running", "failed", "suspended", "succeeded", "succeeded"],
    "skipped": ["running", "running", "failed", "suspended", "succeeded", "skipped"],
}

# Transitions a run log may show; None is the state before the first entry.
TRANSITIONS = [
    (None, "submitted"),
    ("submitted", "running"),
    ("submitted", "skipped"),
    ("submitted", "suspended"),
    ("running", "succeeded"),
    ("running", "failed"),
    ("running", "suspended"),
    ("failed", "submitted"),
    ("failed", "succeeded"),
    ("failed", "skipped"),
    ("failed", "suspended"),
    ("suspended", "submitted"),
    ("suspended", "succeeded"),
    ("suspended", "skipped"),
    ("succeeded", "submitted"),
    ("skipped", "submitted"),
]

# Verdicts in ascending order; "and" is the minimum, "or" the maximum.
VERDICTS = ["skip", "wait", "run"]


def current_status(log: DataFrame, run: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Newest log entry of every run."""
    return latest_per_key(log, run, order, columns)


def condition_verdict(required: str | Column, actual: str | Column) -> Column:
    """run when the status is as required, skip when it can no longer be, else wait."""
    required = F.col(required) if isinstance(required, str) else required
    actual = F.col(actual) if isinstance(actual, str) else actual
    return F.when(actual == required, "run").when(actual.isin(*FINAL), "skip").otherwise("wait")


def timed_verdict(required: Column, actual: Column, since: Column, as_of: Column, longer_than: Column) -> Column:
    """Time variant of a condition on a status: met once the status has lasted long enough."""
    lasted = as_of > since + longer_than
    return (
        F.when((actual == required) & lasted, "run").when(actual.isin(*FINAL) & ~required.isin(*FINAL), "skip").otherwise("wait")
    )


def eval_condition_tree(nodes: DataFrame, key: str, parent: str, connective: str, verdict: str) -> DataFrame:
    """Verdicts of all nodes of and/or trees from those of the leaves."""
    level = F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col(verdict)).cast("int")
    coded = nodes.withColumn(verdict, F.when(F.col(verdict).isNotNull(), level))
    out = contract(coded, key, parent, verdict, Levels(len(VERDICTS), lambda worst, best: F.when(F.col(connective) == "or", best).otherwise(worst)))
    names = F.array(*[F.lit(v) for v in VERDICTS])
    return out.withColumn(verdict, F.get(names, F.col(verdict) - 1))


def eval_boolean_tree(nodes: DataFrame, key: str, parent: str, connective: str, result: str) -> DataFrame:
    """and / or / not trees; a leaf without a run counts as false."""
    level = F.when(F.col(result), 2).otherwise(1)  # false and NULL are 1
    fold = Levels(2, lambda worst, best: F.when(F.col(connective) == "or", best).when(F.col(connective) == "not", 3 - worst).otherwise(worst))
    out = contract(nodes.withColumn(result, level), key, parent, result, fold)
    return out.withColumn(result, F.col(result) == 2)


def parallel_status(status: str | Column) -> Column:
    """Aggregate: status of ``A || B || ...``; NULL when there is no run at all."""
    s = F.col(status) if isinstance(status, str) else status
    any_ = {name: F.coalesce(F.some(s == name), F.lit(False)) for name in STATUSES}
    others = F.coalesce(F.some(s != "submitted"), F.lit(False))
    out = F.when(any_["running"] | (any_["submitted"] & others), "running").when(any_["submitted"], "submitted")
    for name in STATUSES[2:]:
        out = out.when(any_[name], name)
    return out


def rollup_parallel(runs: DataFrame, group: Sequence[str], status: str, name: str = "status") -> DataFrame:
    return runs.groupBy(*group).agg(parallel_status(status).alias(name))


def rollup_sequence(
    runs: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    status: str,
    name: str = "status",
    block: int = 4096,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Status of ``A -> B -> ...`` in member order, folded from the right.

    The table is not associative, but it makes every member a function of the status
    to its right, and composing functions is.  So blocks of neighbours are composed
    first, then blocks of blocks: no task ever holds more than ``block`` members.
    """
    group = list(group)
    undefined = len(STATUSES)  # a pair that cannot occur, and whatever it is combined with
    table = F.array(
        *[F.array(*[F.lit(STATUSES.index(b) if b else undefined) for b in [*IN_SEQUENCE[a], None]]) for a in STATUSES]
    )
    names = F.array(*[F.lit(s) for s in STATUSES])
    code = F.array_position(names, F.col(status)).cast("int") - 1
    numbered = row_number(runs.where(F.col(status).isNotNull()), group, [By(c, desc=True) for c in order], "__rn", group_rows)
    # Numbered from the right: member 1 is the last one, whose status is a constant.
    own = F.when(F.col("__rn") == 1, F.array_repeat(code, undefined + 1)).otherwise(F.get(table, code))
    level = numbered.select(*group, "__rn", own.alias("__f"))
    identity = F.array(*[F.lit(i) for i in range(undefined + 1)])

    def composed(parts: Column) -> Column:
        inner = lambda acc, p: F.transform(acc, lambda x: F.get(p["__f"], x))
        return F.aggregate(F.array_sort(parts), identity, inner)

    longest = level.agg(F.max("__rn").alias("m")).first()["m"] or 0
    while True:
        at = (F.floor((F.col("__rn") - 1) / block) + 1).alias("__rn")
        level = level.groupBy(*group, at).agg(composed(F.collect_list(F.struct("__rn", "__f"))).alias("__f"))
        longest = -(-longest // block)
        if longest <= 1:
            break
    return level.select(*group, F.get(names, F.get("__f", F.lit(0))).alias(name))


def _with_free(
    waiting: DataFrame, capacity: DataFrame, resource: str, load: str, limit: str, used: DataFrame | None
) -> DataFrame:
    """``waiting`` with what is free of each run's resource; NULL where there is no limit."""
    free = capacity.select(F.col(resource).alias("__r"), F.col(limit).alias("__free"))
    if used is not None:
        taken = used.groupBy(F.col(resource).alias("__u")).agg(F.sum(load).alias("__taken"))
        free = free.join(taken, F.col("__r") == F.col("__u"), "left").select(
            "__r", (F.col("__free") - F.coalesce("__taken", F.lit(0))).alias("__free")
        )
    return lookup(waiting, free, {resource: "__r"}, ["__free"])


def admit_by_capacity(
    waiting: DataFrame,
    capacity: DataFrame,
    resource: str,
    run: str,
    importance: str,
    load: str,
    limit: str = "capacity",
    used: DataFrame | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Runs admitted per resource, most important first, while their loads add up to what is free.

    A load that is not given counts 1 and a missing capacity means no limit.  ``used``
    has the load already running per resource.
    """
    known = _with_free(waiting, capacity, resource, load, limit, used)
    loaded = known.withColumn("__load", F.coalesce(F.col(load), F.lit(1)))
    order = [By(importance, desc=True), By(load, nulls_first=True), By(run)]
    summed = running_sum(loaded, [resource], order, "__load", "load_sum", group_rows)
    fits = F.col("__free").isNull() | (F.col("load_sum") <= F.col("__free"))
    return summed.where(fits).select(*waiting.columns, "load_sum")


#: Runs of a resource that are tried one after the other inside one row.
GREEDY_BLOCK = 16_384
_CHUNK = 128


def _greedy_fold(free: Column, members: Column, kind: DataType) -> Column:
    """(free, taken): what is left after each member was taken if it still fitted, and the numbers of those taken.

    ``members`` are structs (n, load) in order.  Taken numbers are gathered chunk by chunk, as appending copies an array.
    """
    none = F.array().cast("array<bigint>")

    def one(acc: Column, m: Column) -> Column:
        fits = m["load"] <= acc["free"]
        left = F.when(fits, acc["free"] - m["load"]).otherwise(acc["free"]).cast(kind)
        return F.struct(left.alias("free"), F.when(fits, F.concat(acc["taken"], F.array(m["n"]))).otherwise(acc["taken"]).alias("taken"))

    def chunk(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["free"].alias("free"), none.alias("taken")), one)
        return F.struct(done["free"].alias("free"), F.concat(acc["taken"], done["taken"]).alias("taken"))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(members) - 1) / _CHUNK).cast("int")), lambda i: F.slice(members, i * _CHUNK + 1, _CHUNK))
    return F.aggregate(chunks, F.struct(free.cast(kind).alias("free"), none.alias("taken")), chunk)


def admit_greedy(
    waiting: DataFrame,
    capacity: DataFrame,
    resource: str,
    run: str,
    importance: str,
    load: str,
    limit: str = "capacity",
    used: DataFrame | None = None,
    block: int = GREEDY_BLOCK,
) -> DataFrame:
    """Runs admitted per resource when each is tried in turn, most important first, and admitted if it still fits.

    Unlike ``admit_by_capacity``, a run that does not fit does not end the resource: smaller ones behind it are tried.
    ``load_sum`` is what has been admitted of the resource up to the run.  A load that is not given counts 1, a missing
    capacity means no limit, a NULL resource has none either, and a negative load fails the job.

    What is free only shrinks, so a load above it is out for good.  The runs of a resource are numbered and cut into
    blocks.  In one round a resource admits whole blocks of loads that can still fit, as long as their sums do, and the
    block that is too much for it is folded run by run inside one row.  A round is a join by (resource, block), and blocks
    whose smallest load no longer fits are passed over unread, so there are as many rounds as blocks in which something
    is admitted and something else is not.  Loads should be integers or decimals: sums of doubles depend on their order.
    """
    known = _with_free(waiting, capacity, resource, load, limit, used).withColumn("__load", F.coalesce(F.col(load), F.lit(1)))
    kind = known.select(F.sum("__load").alias("s")).schema["s"].dataType
    checked = F.when(F.col("__load") < 0, F.raise_error(F.lit("negative load"))).otherwise(F.col("__load").cast(kind))
    order = [By(importance, desc=True), By(load, nulls_first=True), By(run)]
    limited = known.where(F.col("__free").isNotNull()).withColumn("__load", checked)
    rows = row_number(limited, [resource], order, "__n", group_rows=0)
    rows = settle(rows.withColumn("__block", F.floor((F.col("__n") - 1) / block)))
    key = F.col(resource)
    sizes = rows.groupBy(key.alias("r"), F.col("__block").alias("b")).agg(
        F.min("__load").alias("least"), F.max("__load").alias("most"), F.sum("__load").alias("total"), F.first("__free").cast(kind).alias("free"))
    sizes = settle(sizes)
    # What is free of a resource, and its next block
    state = settle(sizes.groupBy("r").agg(F.first("free").alias("free"), F.lit(0).cast("bigint").alias("at")))
    sizes = sizes.drop("free")
    decided = []
    while True:
        ahead = sizes.join(state.withColumnRenamed("r", "__s"), (F.col("r") == F.col("__s")) & (F.col("b") >= F.col("at")) & (F.col("least") <= F.col("free")))
        ahead = settle(ahead.drop("__s"))
        if ahead.isEmpty():
            break
        # Sums without the loads that are out; only blocks that have some are read
        mixed = ahead.where(F.col("most") > F.col("free")).select(F.col("r").alias("mr"), F.col("b").alias("mb"), F.col("free").alias("bound"))
        live = rows.join(mixed, (key == F.col("mr")) & (F.col("__block") == F.col("mb"))).where(F.col("__load") <= F.col("bound"))
        live = live.groupBy("mr", "mb").agg(F.sum("__load").alias("live"))
        summed = ahead.join(live, (F.col("r") == F.col("mr")) & (F.col("b") == F.col("mb")), "left").drop("mr", "mb")
        summed = running_sum(summed.withColumn("live", F.coalesce("live", "total")), ["r"], ["b"], "live", "upto", group_rows=0)
        summed = settle(summed.withColumn("left", (F.col("free") - F.col("upto") + F.col("live")).cast(kind)))
        whole = summed.where(F.col("upto") <= F.col("free")).select("r", "b", "free", F.lit(None).cast("array<bigint>").alias("taken"))
        over = summed.where(F.col("upto") > F.col("free")).groupBy("r").agg(F.min(F.struct("b", "left")).alias("first")).select("r", "first.b", "first.left")
        members = rows.join(over.select(F.col("r").alias("mr"), F.col("b").alias("mb"), "left"), (key == F.col("mr")) & (F.col("__block") == F.col("mb")))
        members = members.where(F.col("__load") <= F.col("left")).groupBy("mr", "mb", "left").agg(
            F.sort_array(F.collect_list(F.struct(F.col("__n").alias("n"), F.col("__load").alias("load")))).alias("members"))
        folded = members.select(F.col("mr").alias("r"), F.col("mb").alias("b"), _greedy_fold(F.col("left"), F.col("members"), kind).alias("f"))
        folded = settle(folded.select("r", "b", "f.free", "f.taken"))
        decided += [whole, folded]
        state = settle(folded.select("r", "free", (F.col("b") + 1).alias("at")))
    unlimited = known.where(F.col("__free").isNull()).select(*waiting.columns, "__load")
    admitted = unlimited.withColumn("__load", checked)
    if decided:
        verdict = reduce(DataFrame.unionByName, decided).select(F.col("r").alias("mr"), F.col("b").alias("mb"), F.col("free").alias("bound"), "taken")
        tried = rows.join(verdict, (key == F.col("mr")) & (F.col("__block") == F.col("mb")))
        fits = F.when(F.col("taken").isNull(), F.col("__load") <= F.col("bound")).otherwise(F.array_contains("taken", F.col("__n")))
        admitted = admitted.unionByName(tried.where(fits).select(*waiting.columns, "__load"))
    summed = running_sum(admitted, [resource], order, "__load", "load_sum", group_rows=0)
    return summed.select(*waiting.columns, "load_sum")


def overdue(current: DataFrame, limits: DataFrame, status: str, since: str, as_of: Column) -> DataFrame:
    """Runs that have been in their status longer than the limit set for it, in minutes."""
    bound = limits.select(F.col("status").alias("__s"), F.col("minutes").alias("limit_minutes"))
    joined = current.join(bound, F.col(status) == F.col("__s")).drop("__s")
    lasted = F.timestamp_diff("SECOND", F.col(since), as_of)
    over = F.timestamp_diff("MICROSECOND", F.col(since), as_of) > F.col("limit_minutes").cast("bigint") * 60_000_000
    return joined.withColumn("seconds", lasted).where(over)


def illegal_transitions(
    log: DataFrame, run: Sequence[str], order: Sequence[str], status: str, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Log entries that do not follow from the entry before them; a NULL status never does, and nothing follows from it."""
    entry = F.struct(F.col(status).alias("s"))
    stepped = shift(log.withColumn("__entry", entry), run, order, {"__before": "__entry"}, 1, group_rows)
    first, previous = F.col("__before").isNull(), F.col("__before.s")
    ok = F.lit(False)
    for before, after in TRANSITIONS:
        left = first if before is None else previous == before
        ok = ok | (F.coalesce(left, F.lit(False)) & F.coalesce(F.col(status) == after, F.lit(False)))
    return stepped.where(~ok).withColumn("previous", previous).drop("__entry", "__before")


@dataclass(frozen=True)
class Retry:
    """Up to ``times`` attempts with ``action``, each after a wait in minutes."""

    times: int
    action: str
    wait: int


def retry_state(
    log: DataFrame,
    run: Sequence[str],
    order: Sequence[str],
    failed: Column,
    at: str,
    policy: Sequence[Retry],
    final: str,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """For every failure its number, the action the policy takes, and when a retry is due."""
    failures = row_number(log.where(failed), run, order, "attempt", group_rows)
    action, wait = F.lit(final), F.lit(None).cast("int")
    upto = 0
    steps = []
    for step in policy:
        upto += step.times
        steps.append((upto, step))
    for upto, step in reversed(steps):
        within = F.col("attempt") <= upto
        action = F.when(within, step.action).otherwise(action)
        wait = F.when(within, step.wait).otherwise(wait)
    due = F.col(at) + F.make_dt_interval(mins=wait)
    return failures.withColumns({"action": action, "retry_at": due})


def prefix_gate(
    runs: DataFrame, sequence: Sequence[str], slot: str, member: str, start: str, end: str, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Runs that started before the last member of their sequence had finished the slot before.

    A last member without an end has not finished: every run of the next slot is too early, and its ``gate`` is NULL.
    """
    last = runs.groupBy(*sequence, slot).agg(F.max_by(F.struct(F.col(end).alias("e")), member).alias("__end"))
    gates = shift(last, sequence, [slot], {"__gate": "__end"}, 1, group_rows).drop("__end")
    gated = runs.join(gates.where(F.col("__gate").isNotNull()), [*sequence, slot]).withColumn("gate", F.col("__gate.e")).drop("__gate")
    return gated.where(F.col("gate").isNull() | (F.col(start) < F.col("gate")))


def pattern_matches(identifiers: DataFrame, patterns: DataFrame) -> DataFrame:
    """(i_name, identifier, i_pattern) for every identifier and pattern of one name and length that agree element by element, ``*`` with any.

    The patterns of a name and length are a trie: a node is the beginning that some of them share.  Identifiers go down it
    together, one equi join per element, along the edge of their own element and along the star's.  Work follows the
    nodes that identifiers reach, not the number of patterns or of arrangements of stars.
    """
    patterns = patterns.where(F.col("pattern").isNotNull()).select("name", "pattern", F.size("pattern").alias("size")).distinct()
    edge = patterns.select("name", "size", "pattern", F.posexplode_outer("pattern").alias("depth", "token"))
    edges = edge.select(F.col("name").alias("e_name"), F.col("size").alias("e_size"), "depth",
                        F.slice("pattern", F.lit(1), F.coalesce("depth", F.lit(0))).alias("e_node"), F.col("token").alias("e_token"))
    edges = settle(edges.distinct())  # a pattern without elements has one, of no depth
    longest = edges.agg(F.max("e_size").alias("n")).first()["n"] or 0
    roots = edges.select("e_name", "e_size").distinct()
    start = identifiers.where(F.col("identifier").isNotNull()).select(F.col("name").alias("i_name"), "identifier").distinct()
    front = start.join(roots, (F.col("i_name") == F.col("e_name")) & (F.size("identifier") == F.col("e_size"))).select(
        "i_name", "identifier", F.array().cast("array<string>").alias("i_pattern"))
    for depth in range(longest):
        # Identifiers that are through pass by
        more = F.size("identifier") > depth
        own = F.array_distinct(F.array(F.get("identifier", F.lit(depth)), F.lit("*")))
        probes = front.select("*", F.explode(F.when(more, own).otherwise(F.array(F.lit(None).cast("string")))).alias("token"))
        on = (F.col("i_name") == F.col("e_name")) & (F.size("identifier") == F.col("e_size")) & (F.col("i_pattern") == F.col("e_node"))
        reached = probes.join(edges.where(F.col("depth") == depth), on & F.col("token").eqNullSafe(F.col("e_token")), "left")
        reached = reached.where(~more | F.col("e_name").isNotNull())
        front = reached.select("i_name", "identifier", F.when(more, F.concat("i_pattern", F.array("token"))).otherwise(F.col("i_pattern")).alias("i_pattern"))
        if depth % 8 == 7:
            front = settle(front)  # keeps the plan short
    return front


def eval_pattern_condition(instances: DataFrame, conditions: DataFrame) -> DataFrame:
    """Conditions over all instances whose identifier matches a pattern.

    ``instances``: name, identifier, status; ``conditions``: id, name, pattern, status,
    negated.  ``*`` in a pattern stands for any element.  Instances are counted per
    identifier and status, and identifiers find their patterns by ``pattern_matches``.  Negated: no instance has the
    status.  Otherwise all have it and there is at least one.
    """
    counts = instances.groupBy("name", "identifier", "status").agg(F.count("*").alias("n"))
    matched = pattern_matches(counts, conditions).withColumnRenamed("identifier", "m_identifier")
    counted = matched.join(counts, (F.col("i_name") == F.col("name")) & (F.col("m_identifier") == F.col("identifier")))
    offered = counted.groupBy("i_name", "i_pattern", F.col("status").alias("i_status")).agg(F.sum("n").alias("n"))
    joined = conditions.join(offered, all_of([F.col("name") == F.col("i_name"), F.col("pattern") == F.col("i_pattern")]), "left")
    same = F.coalesce(F.sum(F.when(F.col("i_status") == F.col("status"), F.col("n"))), F.lit(0))
    total = F.coalesce(F.sum("n"), F.lit(0))
    verdict = F.when(F.first("negated"), same == 0).otherwise((total > 0) & (same == total))
    return joined.groupBy("id").agg(total.alias("matches"), verdict.alias("holds"))
