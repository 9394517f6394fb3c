r"""Operator 9: conversations to training text, assembled as one Arrow buffer per block.

A turn becomes `### role: ` + text + `</turn>\n`. Inside texts and roles a backslash, `###` and `</turn>`
are written `\\`, `\h` and `\t` (and in roles `:` as `\c`), so no control string can occur there and reading back is exact. The
loss mask covers the assistants' texts.

A block of conversations is laid out by columns: the lengths of all segments, their cumulative offsets, and one scatter of
headers and contents into a preallocated buffer; conversations are slices of it by offsets.

Scale: one shuffle by conversation, rows sorted inside partitions, blocks cut where a conversation ends. Only the
rows of one conversation must be in one task, since they become one value.

Defined cases: a null text or role is empty; rows of one conversation are ordered by turn (nulls first), then role, then text; a
null conv_id is a conversation of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"


def escaped(text: pa.Array) -> pa.Array:
    for plain, coded in (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t")):
        text = pc.replace_substring(text, plain, coded)
    return text


def unescaped(text: str) -> str:
    if "\\" not in text:
        return text
    return "\\".join(p.replace("\\h", "###").replace("\\t", "</turn>").replace("\\c", ":") for p in text.split("\\\\"))


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data and the offsets of a string array without nulls."""
    a = a.cast(pa.large_string())
    a = pa.concat_arrays([a]) if a.offset else a
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def assemble(table: pa.Table) -> pa.RecordBatch:
    """Rows of whole conversations (conv_id, role, text in order) to one row each: conv_id, formatted, loss."""
    conv, role = table.column("conv_id").combine_chunks(), table.column("role").combine_chunks()
    text = escaped(table.column("text").combine_chunks())
    head = pc.binary_join_element_wise("### ", pc.replace_substring(escaped(role), ":", "\\c"), ": ", "")
    tail = pa.array([END] * len(conv), pa.string())
    columns = [_bytes(x) for x in (head, text, tail)]
    # lengths of all segments, row by row, three a row; where each begins
    size = np.stack([np.diff(off) for _, off in columns], 1)
    begin = np.concatenate(([0], np.cumsum(size.reshape(-1))))
    out = np.empty(int(begin[-1]), np.uint8)
    for k, (data, off) in enumerate(columns):
        n = size[:, k]
        lines = begin[:-1].reshape(-1, 3)[:, k]
        flat = np.arange(n.sum())
        inside = np.repeat(np.cumsum(n) - n, n)
        # scatter: byte i of segment j goes to the segment's begin plus i
        out[np.repeat(lines, n) + flat - inside] = data[off[0] : off[-1]]
    plain = conv.cast(pa.string())
    new = pc.or_(pc.not_equal(plain[1:], plain[:-1]).fill_null(True), pc.xor(plain[1:].is_null(), plain[:-1].is_null())) if len(conv) > 1 else None
    if len(conv) > 1:
        both_null = pc.and_(plain[1:].is_null(), plain[:-1].is_null())
        new = pc.and_not(new, both_null)
    first = np.concatenate(([0], np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1)) if len(conv) > 1 else np.array([0])
    cut = np.concatenate((begin[:-1].reshape(-1, 3)[first, 0], begin[-1:]))
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(np.ascontiguousarray(cut, np.int64)), pa.py_buffer(out)])
    # loss spans in code points: lengths in characters add up like those in bytes
    chars = np.stack([pc.utf8_length(x).to_numpy() for x in (head, text, tail)], 1).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(chars.reshape(-1))))[:-1].reshape(-1, 3)
    owner = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(conv))))
    mask = np.flatnonzero(pc.equal(role, "assistant").to_numpy(zero_copy_only=False))
    start = at[mask, 1] - at[first[owner[mask]], 0]
    spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(start + chars[mask, 1], pa.int64())], ["start", "end"])
    counts = np.bincount(owner[mask], minlength=len(first))
    loss = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), spans)
    return pa.RecordBatch.from_arrays([conv.take(pa.array(first)), formatted.cast(pa.string()), loss], ["conv_id", "formatted", "loss"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []  # rows of the conversation that may go on
    for batch in batches:
        if not len(batch):
            continue
        ids = batch.column(0).to_pylist()
        k = len(ids)
        while k and ids[k - 1] == ids[-1]:
            k -= 1
        if k == 0 and held and held[-1].column(0)[-1].as_py() == ids[-1]:
            held.append(batch)
            continue
        if k == 0:
            if held:
                yield assemble(pa.Table.from_batches(held))
            held = [batch]
            continue
        yield assemble(pa.Table.from_batches([*held, batch.slice(0, k)]))
        held = [batch.slice(k)]
    if held:
        yield assemble(pa.Table.from_batches(held))


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss array<struct<start,end>> in code points) per conversation."""
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.select("conv_id", "role", "text").mapInArrow(_blocks, f"conv_id {kind}, formatted string, loss array<struct<start:bigint,end:bigint>>")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out = []
    for turn in formatted.split(END)[:-1]:
        role, _, text = turn.removeprefix("### ").partition(": ")
        out.append((unescaped(role), unescaped(text)))
    return out
