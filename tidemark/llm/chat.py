"""Chat formatting in budgeted windows.

Prefix sums of turn tokens choose turn-aligned spans. A window holds the conversation's system turn, a
limited stretch of turns it has seen before, and its own new turns; only the assistant texts among the
new turns are under the loss mask, so a target that is repeated as history is masked there. Control
strings inside texts are escaped reversibly, and windows can be read back to the turns they came from.

Rows of a conversation are brought together in turn order and streamed: a task holds one window of
turns at a time, whatever the conversation's length.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.mixing import token_count

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 512, 128
#: Tokens a turn takes besides its text.
OVERHEAD = 4
WINDOWS = "conv_id long, window long, text string, repeated int, loss_from array<int>, loss_to array<int>"

_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + "\n", re.DOTALL)


def escape(text: str) -> str:
    """One backslash more between each ``<`` and ``|``: the result holds no ``<|``, so no control string."""
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _window(number, system, history, fresh):
    """(number, text, repeated turns, mask starts, mask ends) of one window; turns are (role, text, end of prefix)."""
    kept = ([system] if system else []) + history
    out, at, starts, ends = [], 0, [], []
    for i, (role, text, _) in enumerate(kept + fresh):
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role == "assistant" and i >= len(kept):
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        out.append(f"{head}{body}{CLOSE}\n")
        at += len(out[-1])
    return number, "".join(out), len(kept), starts, ends


def _windows(turns, budget: int, history: int):
    """Windows of one conversation; ``turns`` yields (role, text, prefix sum of tokens up to and with the turn)."""
    number, system, system_cost, kept, fresh, before = 0, None, 0, [], [], 0
    for turn in turns:
        begin = kept[0][3] if kept else fresh[0][3] if fresh else before
        cost = turn[2] - begin + (system_cost if number else 0)
        if fresh and cost > budget:
            yield _window(number, system if number else None, [t[:3] for t in kept], [t[:3] for t in fresh])
            number += 1
            room = history
            stretch = []
            for t in reversed(fresh):  # whole turns only, the latest that fit
                if before - t[3] > room or t[3] == 0 and system:
                    break
                stretch.append(t)
            kept, fresh = stretch[::-1], []
        while kept and not fresh and turn[2] - kept[0][3] + system_cost > budget:
            kept.pop(0)
        if number == 0 and not fresh and turn[0] == "system":
            system, system_cost = turn, turn[2]
        fresh.append((*turn, before))
        before = turn[2]
    if fresh:
        yield _window(number, system if number else None, [t[:3] for t in kept], [t[:3] for t in fresh])


def _grouped(batches):
    """(conversation, iterator of its rows) of rows that come conversation by conversation."""
    from itertools import groupby

    rows = ((r["conv_id"], r) for b in batches for at in range(0, b.num_rows, 512) for r in b.slice(at, 512).to_pylist())
    return groupby(rows, key=lambda x: x[0])


def _emitted(rows, schema, size: int = 256):
    import pyarrow as pa

    group = []
    for row in rows:
        group.append(row)
        if len(group) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*group), schema)], schema=schema)
            group = []
    if group:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*group), schema)], schema=schema)


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of ``turns(conv_id, turn, role, text)``: conv_id, window, text, repeated, loss_from, loss_to.

    ``repeated`` is the number of leading turns that an earlier window held; [loss_from, loss_to) are the code
    points under the loss. A window exceeds ``budget`` tokens (words plus OVERHEAD a turn) only where the
    system turn, or one turn, does by itself. Turns are ordered by turn, ties by role and text, null turns first;
    null roles and texts are empty; repeated rows are repeated turns; a null conv_id is a conversation; other
    columns are not read; an empty table has no windows. Rows of one conversation are sorted and read by one task, as
    its windows and digests are one sequence.
    """
    named = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    summed = named.withColumn("upto", F.sum(token_count(F.col("text")) + OVERHEAD).over(order)).sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("repeated", pa.int32()), ("loss_from", pa.list_(pa.int32())), ("loss_to", pa.list_(pa.int32()))])
        yield from _emitted(((conv, *w) for conv, rows in _grouped(batches) for w in _windows(((r["role"], r["text"], r["upto"]) for _, r in rows), budget, history)), schema)

    return summed.mapInArrow(run, WINDOWS)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a window's text."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def read_back(windows: DataFrame, ordered: bool = False) -> DataFrame:
    """One row per conversation from its windows, in any order; ``ordered`` saves the shuffle where they are as
    format_windows left them, and raises an error where they are not.

    conv_id, n_turns, turns_sha256 (role, \\n, text, \\n per turn), loss_chars and loss_sha256 of all text under
    the mask, unescaped, formatted_chars (code points of all windows), n_windows.
    """

    def run(batches):
        import pyarrow as pa

        def read():
            for conv, rows in _grouped(batches):
                turns, loss, n, chars, size, count = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                for _, w in rows:
                    if w["window"] != count:
                        raise ValueError(f"window {w['window']} of conversation {conv} comes in place of window {count}")
                    for role, text in read_turns(w["text"])[w["repeated"] :]:
                        turns.update(f"{role}\n{text}\n".encode())
                        n += 1
                    for a, b in zip(w["loss_from"], w["loss_to"]):
                        part = unescape(w["text"][a:b])
                        loss.update(part.encode())
                        chars += len(part)
                    size += len(w["text"])
                    count += 1
                yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, count

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])
        yield from _emitted(read(), schema)

    if not ordered:
        windows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    probe = f"{CLOSE}{OPEN}assistant ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(1).select(F.explode(F.array(F.struct(F.lit(-1).cast("long"), F.lit(0).cast("long"), F.lit("user"), F.lit(probe)), F.struct(F.lit(-1).cast("long"), F.lit(1).cast("long"), F.lit("assistant"), F.lit(probe)))).alias("r")).select("r.*")
    return read_back(format_windows(turns.union(more.toDF("conv_id", "turn", "role", "text"))), ordered=True)

