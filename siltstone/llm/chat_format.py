r"""Operator 1: chat formatting by columnar byte assembly.

A turn becomes `<turn ROLE>\nTEXT</turn>\n`. Every control string starts with `<`, so inside texts
a backslash goes before each `<` and each backslash (and before `>` in roles); dropping those
backslashes gives the text back.

Turns are dealt by ranges of (conversation, turn), so a conversation of any length is spread over
tasks. Each Arrow batch is assembled at once: lengths of all segments, their cumulative offsets and
scatter indices are numpy arrays, and headers and contents are copied into one preallocated buffer
that becomes the output column. A row of the output is the part of a conversation that lies in one
batch; parts are numbered in order.

Defined cases: turns are ordered by (turn, role, text), nulls first, so ties have one order; a null
role or text is empty; a null conversation id is a conversation of its own; repeated rows are
repeated turns; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm._common import by_bytes, flat

OPEN, MID, CLOSE = b"<turn ", b">\n", b"</turn>\n"
#: Fixed form of a turn in the output.
TURN = re.compile(rb"<turn ((?:[^\\>]|\\.)*+)>\n((?:[^\\<]|\\.)*+)</turn>\n", re.S)
ESCAPE = re.compile(rb"\\(.)", re.S)
PARTS = "conv_id bigint, part bigint, n_turns bigint, formatted string, loss array<struct<start:bigint,stop:bigint>>"


def unescape(text: bytes) -> bytes:
    return ESCAPE.sub(rb"\1", text)


def escape(data: np.ndarray, offsets: np.ndarray, marks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A backslash before every byte of `marks`; ASCII bytes only occur as themselves in UTF-8."""
    hit = np.isin(data, np.frombuffer(marks, np.uint8))
    shift = np.cumsum(hit)
    out = np.full(len(data) + (int(shift[-1]) if len(data) else 0), ord("\\"), np.uint8)
    out[np.arange(len(data)) + shift] = data
    before = np.concatenate([[0], shift])
    return out, offsets + before[offsets]


def scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy segment k of data to out, from at[k] on."""
    lengths = np.diff(offsets)
    out[np.arange(len(data)) + np.repeat(at - offsets[:-1], lengths)] = data


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The turns' bytes in one buffer, their n + 1 offsets, and where each turn's content starts and stops."""
    roles, role_at = escape(*flat(role), b"\\<>")
    texts, text_at = escape(*flat(text), b"\\<")
    n = len(role_at) - 1
    lengths = np.stack([np.full(n, len(OPEN)), np.diff(role_at), np.full(n, len(MID)), np.diff(text_at), np.full(n, len(CLOSE))])
    starts = np.concatenate([[0], np.cumsum(lengths.T.ravel())])
    segment = starts[:-1].reshape(n, 5)
    out = np.empty(int(starts[-1]), np.uint8)
    for k, mark in ((0, OPEN), (2, MID), (4, CLOSE)):
        scatter(out, segment[:, k], np.tile(np.frombuffer(mark, np.uint8), n), np.arange(n + 1) * len(mark))
    scatter(out, segment[:, 1], roles, role_at)
    scatter(out, segment[:, 3], texts, text_at)
    return out, starts[::5], segment[:, 3], segment[:, 4]


def format_conversations(df: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Parts of formatted conversations; loss: byte ranges of assistants' contents within the part, escapes included."""
    rows = df.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 40
        for whole in batches:
            for a, b in by_bytes(whole.column(3)):
                batch = whole.slice(a, b - a)
                out, offsets, begin, stop = assemble(batch.column(2), batch.column(3))
                null = np.asarray(batch.column(0).is_null())
                ids = batch.column(0).fill_null(0).to_numpy()  # beside a null too, ids stay whole numbers
                first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]))
                until = np.append(first[1:], len(ids))
                spoken = np.asarray(batch.column(2).fill_null("").cast(pa.string()).to_pylist(), object) == "assistant"
                chosen = np.flatnonzero(spoken)
                base = offsets[first][np.searchsorted(first, chosen, "right") - 1]
                spans = pa.StructArray.from_arrays([pa.array(begin[chosen] - base), pa.array(stop[chosen] - base)], ["start", "stop"])
                bounds = np.searchsorted(chosen, np.append(first, len(ids)))
                text_offsets = np.append(offsets[first], offsets[-1])
                formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(text_offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first)), pa.array(part + np.arange(len(first))), pa.array((until - first).astype(np.int64)), formatted, pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans)],
                    ["conv_id", "part", "n_turns", "formatted", "loss"],
                )
                part += len(first)

    return dealt.mapInArrow(run, PARTS)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted parts; the parts stream by in order and only hash states are held."""
    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows = None, []

        def close():
            conv, n, turns, loss_chars, loss, chars = state
            rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def out():
            done, rows[:] = list(rows), []
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 6, kinds)], names)

        for batch in batches:
            for conv, formatted, loss in zip(batch.column("conv_id").to_pylist(), batch.column("formatted"), batch.column("loss")):
                if state is None or state[0] != conv:
                    if state is not None:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = formatted.as_py()
                data = text.encode()
                state[5] += len(text)
                end = 0
                for m in TURN.finditer(data):
                    if m.start() != end:
                        raise ValueError(f"conversation {conv}: the output can't be parsed at byte {end}")
                    end = m.end()
                    state[1] += 1
                    state[2].update(unescape(m[1]) + b"\n" + unescape(m[2]) + b"\n")
                if end != len(data):
                    raise ValueError(f"conversation {conv}: the output can't be parsed at byte {end}")
                for span in loss.as_py():
                    said = unescape(data[span["start"] : span["stop"]])
                    state[3] += len(said.decode())
                    state[4].update(said)
            yield out()
        if state is not None:
            close()
        yield out()

    return dealt.mapInArrow(run, DIGESTS)
