"""Change detection, valid-time history and surrogate keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import dense_keys
from tidemark.operators.predicates import (
    OPEN_END,
    all_of,
    changed,
    comparable,
    keys_match,
    ntz,
    require,
    require_keys,
    valid,
    valid_at,
)
from tidemark.operators.skew import HOT_ROWS, lookup
from tidemark.session import settle

HIST = ("start_ts", "end_ts")


def one_row_per_key(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Fail the job when a key is NULL or occurs twice.

    The window hashes and sorts by the key, which is the layout the join that
    follows needs, so the check costs neither a shuffle nor a sort of its own.
    """
    nth = F.count("*").over(Window.partitionBy(*ids).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = require_keys(df, ids).withColumn("__nth", nth)
    repeated = F.raise_error(F.lit(f"key {list(ids)} occurs more than once in one image")).cast("boolean")
    return numbered.where(F.when(F.col("__nth") == 1, F.lit(True)).otherwise(repeated)).drop("__nth")


def diff_deletes(target: DataFrame, new: DataFrame, ids: Sequence[str], ts: str, hist=HIST) -> DataFrame:
    """Keys valid in the target and absent from the new image."""
    return valid_at(target, ts, *hist).select(*ids).join(require_keys(new.select(*ids), ids), list(ids), "left_anti")


def diff_inserts(target: DataFrame, new: DataFrame, ids: Sequence[str], ts: str, hist=HIST) -> DataFrame:
    """Rows of the new image whose key is not valid in the target."""
    known = require_keys(valid_at(target, ts, *hist).select(*ids), ids)
    return one_row_per_key(new, ids).join(known, list(ids), "left_anti")


def diff_updates(target: DataFrame, new: DataFrame, ids: Sequence[str], ts: str, hist=HIST) -> DataFrame:
    """Rows of the new image whose key is valid and any compared column differs."""
    old = valid_at(target, ts, *hist).alias("old")
    differs = changed("old", "new", comparable(new, ids, hist))
    return old.join(one_row_per_key(new, ids).alias("new"), keys_match("old", "new", ids)).where(differs).select("new.*")


def classify_changes(target: DataFrame, new: DataFrame, ids: Sequence[str], ts: str, hist=HIST) -> DataFrame:
    """One full outer join: ``op`` is I, U, D or ``=``, with both images as structs."""
    data = [c for c in new.columns if c not in hist]
    old_side = valid_at(target, ts, *hist)
    old_side = one_row_per_key(old_side, ids).select(*ids, F.struct(*target.columns).alias("old"))
    new_side = one_row_per_key(new.select(*data), ids).select(*ids, F.struct(*data).alias("new"))
    differs = changed("old", "new", comparable(new, ids, hist))
    op = (
        F.when(F.col("old").isNull(), "I")
        .when(F.col("new").isNull(), "D")
        .when(differs, "U")
        .otherwise("=")
    )
    return old_side.join(new_side, list(ids), "full_outer").withColumn("op", op)


def _versions(target: DataFrame, changes: DataFrame, ts: str, max_ts: str, hist) -> DataFrame:
    """Turn classified keys into their resulting versions, one or two rows each."""
    start, end = hist
    kept = F.struct(
        *[
            (
                F.when(F.col("op").isin("D", "U"), ntz(ts)).otherwise(F.col(f"old.{end}"))
                if c == end
                else F.col(f"old.{c}")
            ).alias(c)
            for c in target.columns
        ]
    )
    opened = F.struct(
        *[(ntz(ts) if c == start else ntz(max_ts) if c == end else F.col(f"new.{c}")).alias(c) for c in target.columns]
    )
    rows = F.array(
        F.when(F.col("old").isNotNull(), kept),
        F.when(F.col("op").isin("I", "U"), opened),
    )
    return changes.select(F.inline(F.array_compact(rows)))


def scd2_apply(
    target: DataFrame, new: DataFrame, ids: Sequence[str], ts: str, max_ts: str = OPEN_END, hist=HIST
) -> DataFrame:
    """Close deleted and changed versions at ``ts`` and open inserted and changed ones.

    A load that was applied before is undone first: what started at ``ts`` goes, what ended there is open again.
    A version that starts later fails the job; reload from there instead.  Versions not valid at ``ts`` pass
    through without a shuffle.
    """
    start, end = hist
    target = require(target, F.col(start).isNull() | (F.col(start) <= ntz(ts)), f"versions start after {ts}")
    target = target.where(F.coalesce(F.col(start) < ntz(ts), F.lit(True)))
    target = target.withColumn(end, F.when(F.col(end) == ntz(ts), ntz(max_ts)).otherwise(F.col(end)))
    rest = target.where(~F.coalesce(valid(ts, *hist), F.lit(False)))
    changes = classify_changes(target, new, ids, ts, hist)
    return rest.unionByName(_versions(target, changes, ts, max_ts, hist))


def scd2_insert(
    target: DataFrame, image: DataFrame, ids: Sequence[str], ts: str, until: str | None, max_ts: str = OPEN_END, hist=HIST
) -> DataFrame:
    """History in which ``image`` holds from ``ts`` to ``until``, the next load applied before; None if there is none.

    For a load that comes after later ones, and for one that comes again with other content.  Nothing has to be replayed:
    the image at ``until`` is what is valid then.  So one full outer join of ``image`` with the versions valid just before ``ts``
    and those valid at ``until`` decides every version that begins or ends between, and neighbours with
    equal values become one.  Versions that ended before ``ts`` or start after ``until`` pass through without a shuffle, as
    do those without start or end.  The result is the same as if all loads had come in order.
    """
    start, end = hist
    data = [c for c in target.columns if c not in hist]
    begins, ends, at = F.col(start), F.col(end), ntz(ts)
    later = F.lit(False) if until is None else begins > ntz(until)
    aside = F.coalesce((ends < at) | later, F.lit(True))
    touched = target.where(~aside)

    # Both images of the stored history from one grouping, whose layout the join with the new one needs too
    is_a = (begins < at) & (ends >= at)
    is_q = F.lit(False) if until is None else (begins <= ntz(until)) & (ends > ntz(until))
    version_row = F.struct(*target.columns)
    known = require_keys(touched.where(is_a | is_q), ids).groupBy(*ids).agg(
        F.first(F.when(is_a, version_row), ignorenulls=True).alias("a"), F.first(F.when(is_q, version_row), ignorenulls=True).alias("q"),
        F.greatest(F.count_if(is_a), F.count_if(is_q)).alias("__most"))
    known = require(known, F.col("__most") <= 1, f"key {list(ids)} has overlapping versions").drop("__most")
    now = one_row_per_key(image.select(*data), ids).select(*ids, F.struct(*data).alias("n"))
    joined = known.join(now, list(ids), "full_outer")
    stop = ntz(max_ts) if until is None else ntz(until)
    compared = comparable(target, ids, hist)

    def same(x: str, y: str) -> Column:
        equal = all_of(F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in compared)
        return F.col(x).isNotNull() & F.col(y).isNotNull() & equal

    stays, goes_on = same("a", "n"), same("n", "q")
    over = F.when(goes_on, F.col(f"q.{end}")).otherwise(stop)

    def version(of: str, first: Column, last: Column) -> Column:
        return F.struct(*[(first if c == start else last if c == end else F.col(f"{of}.{c}")).alias(c) for c in target.columns])

    rows = F.array(
        F.when(F.col("a").isNotNull(), version("a", F.col(f"a.{start}"), F.when(stays, over).otherwise(at))),
        F.when(F.col("n").isNotNull() & ~stays, version("n", at, over)),
        F.when(F.col("q").isNotNull() & ~goes_on, version("q", stop, F.col(f"q.{end}"))),
    )
    return target.where(aside).unionByName(joined.select(F.inline(F.array_compact(rows))).select(*target.columns))


def close_versions(target: DataFrame, gone: DataFrame, ids: Sequence[str], ts: str, hist=HIST) -> DataFrame:
    """Set the end of the version valid at ``ts`` for every key in ``gone``."""
    _, end = hist
    keys = gone.select(*ids).distinct().withColumn("__gone", F.lit(True))
    out = target.join(keys, list(ids), "left")
    closing = F.col("__gone").isNotNull() & valid(ts, *hist)
    return out.withColumn(end, F.when(closing, ntz(ts)).otherwise(F.col(end))).select(*target.columns)


def scd1_apply(target: DataFrame, new: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Overwrite matching rows, add new ones, keep the rest; no history."""
    rest = [c for c in target.columns if c not in ids]
    old_side = target.select(*ids, F.struct(*rest).alias("old"))
    new_side = one_row_per_key(new, ids).select(*ids, F.struct(*rest).alias("new"))
    row = F.coalesce("new", "old").alias("row")
    return old_side.join(new_side, list(ids), "full_outer").select(*ids, row).select(*ids, "row.*").select(*target.columns)


def load_increment(target: DataFrame, feed: DataFrame, ids: Sequence[str], seq: str) -> DataFrame:
    """Append rows newer than the last loaded sequence; of repeats in the feed the last stays.

    Rows at the mark count as loaded, also with a new key: a sequence number is handed out once. A row without
    one fails the job.
    """
    mark = target.agg(F.max(seq).alias("m")).first()["m"]
    newer = F.lit(True) if mark is None else F.col(seq) > F.lit(mark)
    # One expression: of two filters the optimiser may run the comparison first
    missing = F.raise_error(F.lit(f"NULL in {seq}")).cast("boolean")
    fresh = feed.where(F.when(F.col(seq).isNull(), missing).otherwise(newer))
    return target.unionByName(last_operation(fresh, ids, seq).select(*target.columns))


def last_operation(feed: DataFrame, ids: Sequence[str], seq: str) -> DataFrame:
    """The final row of each key in an ordered feed; combined map-side before the shuffle."""
    rest = [c for c in feed.columns if c not in ids]
    newest = F.max_by(F.struct(*rest), F.col(seq)).alias("row")
    return feed.groupBy(*ids).agg(newest).select(*ids, "row.*")


def load_delta(target: DataFrame, feed: DataFrame, ids: Sequence[str], op: str, seq: str) -> DataFrame:
    """Apply ordered INSERT, UPDATE and DELETE rows to a keyed table; a row without sequence, or with another operation, fails the job."""
    feed = require(feed, F.col(seq).isNotNull(), f"NULL in {seq}")
    feed = require(feed, F.col(op).isin("INSERT", "UPDATE", "DELETE"), f"unknown operation in {op}")
    rest = [c for c in target.columns if c not in ids]
    last = last_operation(feed, ids, seq)
    old_side = target.select(*ids, F.struct(*rest).alias("old"))
    new_side = last.select(*ids, F.col(op).alias("__op"), F.struct(*rest).alias("new"))
    joined = old_side.join(new_side, list(ids), "full_outer")
    joined = joined.where(F.col("__op").isNull() | (F.col("__op") != "DELETE"))
    row = F.coalesce("new", "old").alias("row")
    return joined.select(*ids, row).select(*ids, "row.*").select(*target.columns)


def assign_surrogate(rows: DataFrame, known: DataFrame, natural: Sequence[str], key: str) -> DataFrame:
    """Keep the surrogate of a known natural key, number the unknown ones after the largest.

    The different natural keys are counted and joined to the known ones once, and written; numbering, the
    frequent keys and the way back to the rows all start from there.  A natural key with several surrogates keeps the largest.
    """
    top = known.agg(F.max(key).alias("m")).first()["m"] or 0
    counted = rows.groupBy(*natural).agg(F.count("*").alias("__rows"))
    joined = counted.join(known.select(*natural, key), list(natural), "left")
    seen = settle(joined.groupBy(*natural).agg(F.first("__rows").alias("__rows"), F.max(key).alias(key)))
    fresh = dense_keys(seen.where(F.col(key).isNull()).select(*natural), natural, key, int(top))
    mapping = seen.where(F.col(key).isNotNull()).select(*natural, key).unionByName(fresh.withColumn(key, F.col(key).cast(known.schema[key].dataType)))
    hot = seen.where(F.col("__rows") > HOT_ROWS).select(*natural).collect()  # one in so many rows at most
    return lookup(rows, mapping, {c: c for c in natural}, [key], hot=hot)


def load_reference_entity(
    stage: DataFrame,
    target: DataFrame,
    natural: str,
    key: str,
    columns: dict[str, str],
    ts: str,
    source_validity: tuple[str, str],
    max_ts: str = OPEN_END,
) -> DataFrame:
    """Stage rows current at ``ts`` as a target image with surrogate and validity columns.

    ``columns`` maps target columns to stage columns.
    """
    current = valid_at(stage, ts, *source_validity)
    image = current.select(F.col(natural).alias("source_id"), *[F.col(s).alias(t) for t, s in columns.items()])
    keyed = assign_surrogate(image, target, ["source_id"], key)
    return keyed.select(
        key, ntz(ts).alias("start_ts"), ntz(max_ts).alias("end_ts"), "source_id", *columns
    )


def join_as_of_version(
    rows: DataFrame, versions: DataFrame, on: dict[str, str], ts: str, how: str = "inner", hist=HIST
) -> DataFrame:
    """Equi join to the versions valid at one timestamp; ``on`` maps row to version columns."""
    open_rows = valid_at(versions, ts, *hist)
    cond = all_of(rows[a] == open_rows[b] for a, b in on.items())
    return rows.join(open_rows, cond, how)


def join_version_range(
    rows: DataFrame, versions: DataFrame, on: dict[str, str], at: str, how: str = "left", hist=HIST
) -> DataFrame:
    """Equi join to the version valid at each row's own timestamp.

    A key has at most one version per load, so the range test sees few candidates.
    """
    start, end = hist
    cond = all_of(rows[a] == versions[b] for a, b in on.items())
    return rows.join(versions, cond & (rows[at] >= versions[start]) & (rows[at] < versions[end]), how)


def load_relationship(
    items: DataFrame, left: DataFrame, right: DataFrame, on_left: str, on_right: str,
    left_key: str, right_key: str, ts: str, max_ts: str = OPEN_END,
) -> DataFrame:
    """Link rows from numbered list items through two lookups as of ``ts``."""
    lefts = valid_at(left, ts).select(F.col("source_id").alias(on_left), left_key)
    rights = valid_at(right, ts).select(F.col("source_id").alias(on_right), right_key)
    linked = items.join(lefts, on_left).join(rights, on_right)
    return linked.select(left_key, "order_num", right_key, ntz(ts).alias("start_ts"), ntz(max_ts).alias("end_ts"))


def reload_from(
    target: DataFrame,
    snapshots: Sequence[tuple[str, DataFrame]],
    ids: Sequence[str],
    ts: str,
    max_ts: str = OPEN_END,
    hist=HIST,
) -> DataFrame:
    """Forget history from ``ts`` on and replay the retained snapshots from there, in order."""
    start, end = hist
    kept = target.where(F.col(start) < ntz(ts))
    state = kept.withColumn(end, F.when(F.col(end) >= ntz(ts), ntz(max_ts)).otherwise(F.col(end)))
    return fold_snapshots(state, [s for s in snapshots if s[0] >= ts], ids, max_ts, hist)


def fold_snapshots(
    target: DataFrame, snapshots: Sequence[tuple[str, DataFrame]], ids: Sequence[str], max_ts: str = OPEN_END, hist=HIST
) -> DataFrame:
    """Apply snapshots one after another.

    Versions that ended before a snapshot can no longer change: they leave the fold,
    so that a step costs what is open plus one image, however long the history is.
    """
    end, ended, live = hist[1], [], target
    for ts, image in sorted(snapshots, key=lambda s: s[0]):
        over = F.coalesce(F.col(end) <= ntz(ts), F.lit(False))
        ended.append(live.where(over))
        live = settle(scd2_apply(live.where(~over), image, ids, ts, max_ts, hist))
    return reduce(DataFrame.unionByName, ended, live)


def load_by_method(
    target: DataFrame, sources: dict[str, DataFrame], control: Sequence[dict[str, str]], ts: str
) -> DataFrame:
    """Run the load method each control row names over the history of its own source.

    A control row has Source, Method and IdList.  SCD1 keeps one open version per key.
    A source that no row names keeps its history as it is; one named twice is an error.
    """
    named = [row["Source"] for row in control]
    if len(set(named)) < len(named):
        raise ValueError(f"a source is named twice: {sorted(named)}")
    methods: dict[str, Callable[..., DataFrame]] = {
        "SCD2": lambda t, n, ids: scd2_apply(t, n, ids, ts),
        "SCD1": lambda t, n, ids: scd1_apply(t, n.select(*t.columns), ids),
    }
    loaded = target.where(~F.coalesce(F.col("source").isin(named), F.lit(False))) if named else target
    for row in control:
        source = row["Source"]
        ids = [c for c in row["IdList"].split(",") if c not in HIST]
        mine = target.where(F.col("source") == source).drop("source")
        out = methods[row["Method"]](mine, sources[source], ids).withColumn("source", F.lit(source))
        loaded = loaded.unionByName(out)
    return loaded
