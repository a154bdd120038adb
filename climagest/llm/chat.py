"""Chat formatting by columnar byte assembly.

A turn becomes ``### role: text</turn>`` and a line break. Inside texts, backslashes and
the strings that open or close a turn get a backslash in front, in roles backslashes and
colons do, so the output can be read back. A batch is put together without touching
single turns: lengths of all segments, running offsets and scatter indices in numpy, and
every header, text and footer copied into one buffer allocated beforehand, which then is
the Arrow column.

Rows are range-partitioned by conversation and turn, so a conversation of any length is cut
over tasks; it comes out as numbered parts, each of whole turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
IN_TEXT, IN_ROLE = r"(\\|### |</turn>)", r"(\\|:)"
TURN = re.compile(rb"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
ESCAPED = re.compile(rb"\\(.)", re.DOTALL)
TRAINED = ("assistant",)
#: A part holds at most so many bytes, save for a single longer turn.
PART_BYTES = 64 << 20

PARTS = "conv_id long, part long, formatted binary, loss array<long>"


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, starts and lengths of a binary column without nulls."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), offsets[:-1], np.diff(offsets)


def _scatter(out: np.ndarray, to: np.ndarray, column: pa.Array) -> None:
    """Copies the strings of ``column`` to the places ``to``."""
    data, starts, lengths = _bytes(column)
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(to, lengths) + within] = data[np.repeat(starts, lengths) + within]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer, where each turn starts (and the last ends), and the two ends of each text."""
    roles, texts = (pc.fill_null(x, "").cast(pa.large_string()) for x in (roles, texts))
    roles = pc.replace_substring_regex(roles, IN_ROLE, r"\\\1")
    texts = pc.replace_substring_regex(texts, IN_TEXT, r"\\\1")
    before, after, none = (pa.scalar(x, pa.large_string()) for x in (OPEN, AFTER_ROLE, ""))
    heads = pc.binary_join_element_wise(before, roles, after, none).cast(pa.large_binary())
    texts, foots = texts.cast(pa.large_binary()), pa.array([CLOSE.encode()] * len(texts), pa.large_binary())
    lengths = np.stack([_bytes(x)[2] for x in (heads, texts, foots)], axis=1)
    ends = np.cumsum(lengths.ravel())
    starts = (ends - lengths.ravel()).reshape(lengths.shape)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for i, column in enumerate((heads, texts, foots)):
        _scatter(out, starts[:, i], column)
    return out, np.append(starts[:, 0], len(out)), np.stack([starts[:, 1], starts[:, 2]], axis=1)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of about PART_BYTES."""
    sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(sizes.astype(np.int64)) // PART_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for start, stop in zip(cuts, cuts[1:]):
        if stop > start:
            yield batch.slice(start, stop - start)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for whole in batches:
        for batch in _slices(whole):
            ids, roles, texts = batch.columns
            out, turns, ends = assemble(roles, texts)
            keys = pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate(([True], (np.diff(keys[0]) != 0) | (np.diff(keys[1].view(np.int8)) != 0))))
            bounds = np.append(turns[first], len(out)).astype(np.int32)
            trained = pc.is_in(pc.fill_null(roles, ""), pa.array(TRAINED)).to_numpy(zero_copy_only=False)
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, batch.num_rows)))
            spans = (ends - turns[first][run][:, None])[trained]
            counts = np.bincount(run[trained], minlength=len(first)) * 2
            loss = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(spans.ravel(), pa.int64())
            )
            formatted = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(out)])
            parts = pa.array(np.arange(number, number + len(first)), pa.int64())
            number += len(first)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(first)), parts, formatted, loss], names=["conv_id", "part", "formatted", "loss"]
            )


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, part, formatted, loss`` of rows ``conv_id, turn, role, text``.

    Turns come in the order of ``turn`` (nulls first), ties by role and text; repeated rows are repeated turns.
    A null role or text counts as empty; rows without ``conv_id`` are one conversation of
    their own. ``formatted`` is UTF-8; ``loss`` lists starts and ends, in bytes of the part, of the texts
    to be learned (those of the assistant). Ordered by ``part``, the parts of a conversation are the whole of it.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    keys = ["conv_id", "turn", "role", "text"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.select("conv_id", "role", "text").mapInArrow(_format, PARTS)


def read_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """Roles and texts of a part, with the escapes taken away."""
    found, at = [], 0
    while at < len(formatted):
        turn = TURN.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn at byte {at}")
        found.append((unescaped(turn[1]), unescaped(turn[2])))
        at = turn.end()
    return found


def unescaped(text: bytes) -> bytes:
    return ESCAPED.sub(rb"\1", text) if b"\\" in text else text


class _Totals:
    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: bytes, loss: list[int]) -> None:
        for role, text in read_turns(formatted):
            self.turns += 1
            self.all.update(role + b"\n" + text + b"\n")
        for start, end in zip(loss[::2], loss[1::2]):
            text = unescaped(formatted[start:end])
            self.learned.update(text)
            self.loss_chars += len(text.decode("utf-8", "replace"))
        self.chars += len(formatted.decode("utf-8", "replace"))

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars


DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Goes through the parts in order; holds one conversation's digests, never its texts."""
    now = None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), DIGEST.types)], schema=DIGEST)

    for batch in batches:
        done = []
        for conv_id, formatted, loss in zip(*(batch.column(i) for i in range(3))):
            if now is None or now.conv_id != conv_id.as_py():
                done += [now.row()] if now else []
                now = _Totals(conv_id.as_py())
            now.add(formatted.as_py(), loss.as_py())
        if done:
            yield out(done)
    if now:
        yield out([now.row()])


def chat_digest(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted parts: turns, learned text and their digests."""
    parts = format_chats(turns).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return parts.select("conv_id", "formatted", "loss").mapInArrow(_read_back, schema)
