"""Chat formatting: turns are assembled into one text per conversation, column by column.

A turn is ``<|turn|>role`` + line end + text + ``<|end|>`` + line end. Control strings inside a text get a
backslash after their first character, one more than they already have, so that reading back is exact.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words

TURN, END = "<|turn|>", "<|end|>\n"
#: What a text must not contain raw: marks of this template and of common others.
CONTROL = r"(?:\|(?:turn|end)\|>|/?s>|<?/?SYS>>?|/?INST\])"
GUARD = rf"([<\[])(\\*)({CONTROL})"
_GUARDED = re.compile(rf"([<\[])\\(\\*{CONTROL})")
_READ = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)


def guard(texts: pa.Array) -> pa.Array:
    """Texts with their control strings defused."""
    return pc.replace_substring_regex(texts, GUARD, r"\1\\\2\3")


def unguard(text: str) -> str:
    return _GUARDED.sub(r"\1\2", text)


def role_mark(role: str | None) -> bytes:
    """A role as it stands in a header: no line end, no mark."""
    return (role or "").replace("\\", "\\\\").replace("\n", "\\n").replace("<", "\\l").encode()


def role_of(mark: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "l": "<"}.get(m[1], m[1]), mark)


def scatter(out: np.ndarray, to: np.ndarray, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copies the span at ``start`` of ``source`` to ``to`` in ``out``, for all segments at once."""
    before = np.cumsum(length) - length
    step = np.arange(int(length.sum()))
    out[np.repeat(to - before, length) + step] = source[np.repeat(start - before, length) + step]


def assemble(roles: pa.Array, contents: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns; offsets of the turns, and where each content starts and ends."""
    coded = roles.fill_null("").dictionary_encode()
    heads = [TURN.encode() + role_mark(x) + b"\n" for x in coded.dictionary.to_pylist()]
    kind = coded.indices.to_numpy(zero_copy_only=False)
    head_size = np.array([len(x) for x in heads], np.int64)
    head_at = np.cumsum(head_size) - head_size
    body, body_at = words.texts(guard(contents.fill_null("")))
    foot = np.frombuffer(END.encode(), np.uint8)
    head_length, body_length = head_size[kind], np.diff(body_at)
    turn_at = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(head_length + body_length + len(foot), out=turn_at[1:])
    out = np.empty(int(turn_at[-1]), np.uint8)
    start = turn_at[:-1] + head_length
    end = start + body_length
    scatter(out, turn_at[:-1], np.frombuffer(b"".join(heads), np.uint8), head_at[kind], head_length)
    scatter(out, start, body, body_at[:-1], body_length)
    out[(end[:, None] + np.arange(len(foot))).ravel()] = np.tile(foot, len(end))
    return out, turn_at, start, end


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formatted conversations: conv_id, part (place in the conversation), formatted, loss (byte spans of what an assistant says).

    Turns follow by (turn, role, text), nulls first, so repeated rows stay and ties have one order. A null
    role or text is empty, and a null id is one conversation of its own. Other columns are ignored. A conversation
    is cut into parts where a partition or an Arrow batch ends, so one that holds a large part of all rows is
    spread over tasks and no task holds it whole; a part ends after a whole turn.
    """
    plain = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = plain.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("slice", F.spark_partition_id())
    kind = next(f.dataType.simpleString() for f in plain.schema if f.name == "conv_id")

    def run(batches):
        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            same = ids.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change = np.flatnonzero(same[1:] != same[:-1]) + 1
            first = np.concatenate([[0], change, [batch.num_rows]]).astype(np.int64)
            out, turn_at, start, end = assemble(batch.column(2), batch.column(3))
            speaks = pc.equal(batch.column(2).fill_null(""), "assistant").to_numpy(zero_copy_only=False)
            origin = np.repeat(turn_at[first[:-1]], np.diff(first))
            spoken = np.zeros(len(speaks) + 1, np.int64)
            np.cumsum(speaks, out=spoken[1:])
            span = pa.StructArray.from_arrays([pa.array((start - origin)[speaks]), pa.array((end - origin)[speaks])], ["start", "end"])
            size = len(first) - 1
            base = batch.column(4)[0].as_py() << 33
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(first[:-1])),
                pa.array(base + part + np.arange(size)),
                words.string_array(out, turn_at[first]),
                pa.ListArray.from_arrays(pa.array(spoken[first].astype(np.int32)), span),
            ], names=["conv_id", "part", "formatted", "loss"])
            part += size

    return dealt.mapInArrow(run, f"conv_id {kind}, part long, formatted string, loss array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, read from the formatted texts and their loss spans alone.

    Parts arrive in order and are hashed as they come; a digest over a whole conversation has to see
    it in sequence, but only one Arrow batch of it is in memory.
    """
    kind = next(f.dataType.simpleString() for f in formatted.schema if f.name == "conv_id")
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches):
        now, found = None, None

        def close():
            key, turns, all_turns, loss, chars, total = found
            return [key, turns, all_turns.hexdigest(), chars, loss.hexdigest(), total]

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            done = []
            for key, text, spans in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if found is None or key != now:
                    if found is not None:
                        done.append(close())
                    now, found = key, [key, 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                for role, said in _READ.findall(text):
                    found[1] += 1
                    found[2].update(f"{role_of(role)}\n{unguard(said)}\n".encode())
                raw = text.encode()
                for span in spans:
                    said = unguard(raw[span["start"] : span["end"]].decode())
                    found[3].update(said.encode())
                    found[4] += len(said)
                found[5] += len(text)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) if i else pa.array(x, batch.column(0).type) for i, x in enumerate(map(list, zip(*done, strict=True)))], names=names)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) if i else pa.array([x], batch.column(0).type) for i, x in enumerate(close())], names=names)

    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
