"""Chat formatting by columnar byte assembly.

A turn becomes `### <role>: <text> </turn>` and a line feed. Inside roles and texts a
backslash goes before every backslash, `#` and `<` (and `:` in roles), so no marker can
occur in content and the template reads back exactly. A batch's output is one
preallocated Arrow buffer: segment lengths give offsets by a cumulative sum, headers,
contents and ends are scattered to computed places, and no string is built per turn.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import read_table, shuffle_width

OPEN, SPLIT, CLOSE = b"### ", b": ", b" </turn>\n"
SPECIAL = np.zeros(256, bool)
SPECIAL[list(b"\\#<")] = True
MOST_BYTES = 1 << 30  #: formatted bytes of a buffer that holds more than one conversation
SCHEMA = "conv_id long, n_turns long, formatted string, loss_starts array<int>, loss_ends array<int>"

_BODY = rb"[^\\#<]*(?:\\.[^\\#<]*)*"
_ROLE = rb"[^\\#<:]*(?:\\.[^\\#<:]*)*"
TURN = re.compile(rb"### (" + _ROLE + rb"): (" + _BODY + rb") </turn>\n", re.S)
_ESCAPED = re.compile(rb"\\(.)", re.S)


def _bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; nulls are empty."""
    flat = column.cast(pa.large_string()).combine_chunks().fill_null("")
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0) if flat.num_chunks else pa.array([], pa.large_string())
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _put(out: np.ndarray, at: np.ndarray, piece: bytes) -> None:
    if len(at) and piece:
        out[at[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)


def role_header(role: str) -> bytes:
    return OPEN + re.sub(rb"([\\#<:])", rb"\\\1", role.encode("utf-8", "surrogatepass")) + SPLIT


def _first_turns(conv: pa.Array) -> np.ndarray:
    """Where a conversation begins, in rows that lie conversation by conversation; nulls are one id."""
    ids = conv.fill_null(0).to_numpy(zero_copy_only=False)
    null = conv.is_null().to_numpy(zero_copy_only=False)
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])
    return np.flatnonzero(new)


def _one(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    return column


def bounded(table: pa.Table, most: int = MOST_BYTES):
    """table in slices of whole conversations, each of `most` formatted bytes at the outside (escapes double a text) or one conversation."""
    size = 2 * (pc.binary_length(_one(table["text"]).fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))
    size += 2 * pc.binary_length(_one(table["role"]).fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64) + len(OPEN + SPLIT + CLOSE)
    first = _first_turns(_one(table["conv_id"]))
    whole, start, run = np.add.reduceat(size, first), 0, 0
    for k, n in enumerate(whole):
        if run and run + n > most:
            yield table.slice(first[start], first[k] - first[start])
            start, run = k, 0
        run += n
    yield table.slice(first[start])


def assemble(table: pa.Table) -> pa.RecordBatch:
    """One row per conversation of a table whose rows lie conversation by conversation, in turn order."""
    n = table.num_rows
    data, at = _bytes_of(table["text"])
    special = SPECIAL[data]
    extra = np.concatenate([[0], np.cumsum(special)])
    body = at[1:] - at[:-1] + extra[at[1:]] - extra[at[:-1]]
    codes = table["role"].combine_chunks().fill_null("").dictionary_encode()
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.unify_dictionaries().combine_chunks()
    role = codes.indices.to_numpy(zero_copy_only=False)
    names = codes.dictionary.to_pylist()
    headers = [role_header(r) for r in names]
    head = np.array([len(h) for h in headers], np.int64)[role]
    start = np.concatenate([[0], np.cumsum(head + body + len(CLOSE))])
    out = np.empty(start[-1], np.uint8)
    for k, h in enumerate(headers):
        _put(out, start[:-1][role == k], h)
    text_at = start[:-1] + head
    _put(out, text_at + body, CLOSE)
    # a byte's place: its text's start, its offset in the text, and the escapes up to it
    place = np.arange(len(data)) + np.repeat(text_at - at[:-1] - extra[at[:-1]], at[1:] - at[:-1]) + extra[1:]
    out[place] = data
    out[place[special] - 1] = ord("\\")
    if start[-1] >= 2**31:
        raise ValueError("a conversation of 2 GiB or more does not fit a cell")
    conv = _one(table["conv_id"])
    first = _first_turns(conv)
    conv_at = start[:-1][first]
    ends = np.append(conv_at, start[-1])
    which = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    loss = np.flatnonzero(np.array([r == "assistant" for r in names], bool)[role])
    loss_at = np.concatenate([[0], np.cumsum(np.bincount(which[loss], minlength=len(first)))]).astype(np.int32)
    lists = [
        pa.ListArray.from_arrays(pa.array(loss_at), pa.array((x[loss] - conv_at[which[loss]]).astype(np.int32)))
        for x in (text_at, text_at + body)
    ]
    text = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out))
    turns = np.diff(np.append(first, n))
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(first)), pa.array(turns), text, *lists], names=["conv_id", "n_turns", "formatted", "loss_starts", "loss_ends"]
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_starts, loss_ends) per conversation.

    turns: conv_id, turn, role, text; more columns are not read. Turns are ordered by
    turn, ties by role, then text; repeated rows stay. Null texts and roles are empty,
    rows with a null conv_id form one conversation of that null id, null turns come
    first. The loss mask holds byte ranges of the escaped texts of role `assistant`.
    Conversations spread over all tasks by their id; one conversation is one cell and so
    one task, and one of 2 GiB or more when formatted, which no cell can hold, is an
    error. Buffers are cut between conversations before their 32-bit offsets run out. No
    rows give no rows.
    """

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            ids = held["conv_id"]
            last = ids[len(ids) - 1]
            same = ids.is_null() if not last.is_valid else pc.fill_null(pc.equal(ids, last), False)
            cut = len(ids) - pc.sum(same).as_py()
            if cut:
                yield from map(assemble, bounded(held.slice(0, cut).combine_chunks()))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from map(assemble, bounded(held.combine_chunks()))

    dealt = (
        turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
        .repartition(shuffle_width(turns.sparkSession), "conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return dealt.select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


def unescape(raw: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", raw)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; an error if anything but whole turns is there."""
    raw, at, out = formatted.encode("utf-8", "surrogatepass"), 0, []
    while at < len(raw):
        m = TURN.match(raw, at)
        if m is None:
            raise ValueError(f"no turn at byte {at}")
        out.append(tuple(unescape(g).decode("utf-8", "surrogatepass") for g in m.groups()))
        at = m.end()
    return out


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted conversations say when read back: digests of their turns and of the text under the loss mask."""

    def run(batches):
        for pdf in batches:
            rows = []
            for conv, text, starts, ends in zip(pdf["conv_id"], pdf["formatted"], pdf["loss_starts"], pdf["loss_ends"], strict=True):
                turns = read_back(text)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                raw = text.encode("utf-8", "surrogatepass")
                loss = b"".join(unescape(raw[a:b]) for a, b in zip(starts, ends, strict=True))
                rows.append(
                    (
                        conv,
                        len(turns),
                        hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(),
                        len(loss.decode("utf-8", "surrogatepass")),
                        hashlib.sha256(loss).hexdigest(),
                        len(text),
                    )
                )
            yield pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.mapInPandas(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    """Query: digests, read back from the formatted output, of every conversation and of conversation -7."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(turns.unionByName(extra)))


ORACLE_SQL = r"""
WITH said AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, role AS r, text AS x, coalesce(role, '') AS role, coalesce(text, '') AS text FROM said),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST) FILTER (role = 'assistant'), '') AS loss,
  sum(length('### ') + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(': ') + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + length(' </turn>') + 1) AS chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM c
"""
