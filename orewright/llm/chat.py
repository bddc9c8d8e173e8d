"""Chat formatting by columnar byte assembly.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts, ``<``, any number of ``\\`` and ``|`` get one ``\\`` more, so no control
string can come from a text, and taking one away gives the text back. In roles, a line feed and ``\\`` are also written as ``\\n`` and ``\\\\``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewright.llm.pieces import slices
from orewright.llm.tasks import tasks_for

START, END = b"<|im_start|>", b"<|im_end|>\n"
FORMATTED = "conv_id long, block long, seq long, formatted string, loss_start array<long>, loss_end array<long>, n_turns long"
_CONTROL = re.compile(r"<\\(\\*)\|")


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def unescape(text: str) -> str:
    return _CONTROL.sub(r"<\1|", text)


def escape_roles(roles: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each."""
    texts = texts.cast(pa.large_string())
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """One buffer with all turns, the offset of each turn in it, and where each text starts and ends there.

    Lengths of the five segments of a turn give all places at once; fixed segments are written for all turns together, contents by one scatter.
    """
    n = len(roles)
    role, role_at = _bytes(escape_roles(pc.fill_null(roles, "")))
    text, text_at = _bytes(escape(pc.fill_null(texts, "")))
    sizes = np.column_stack([np.full(n, len(START)), np.diff(role_at), np.ones(n, np.int64), np.diff(text_at), np.full(n, len(END))]).astype(np.int64)
    place = np.concatenate([[0], np.cumsum(sizes.reshape(-1))])
    buffer = pa.allocate_buffer(int(place[-1]))
    out = np.frombuffer(buffer, np.uint8) if place[-1] else np.zeros(0, np.uint8)
    starts = place[:-1].reshape(n, 5)
    for k, fixed in ((0, START), (2, b"\n"), (4, END)):
        out[starts[:, k, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    for k, data, at in ((1, role, role_at), (3, text, text_at)):
        out[np.repeat(starts[:, k] - at[:-1], np.diff(at)) + np.arange(len(data))] = data
    return buffer, np.append(starts[:, 0], place[-1]), np.column_stack([starts[:, 3], starts[:, 4]])


def format_chats(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), part_bytes: int = 8 << 20, partitions: int | None = None) -> DataFrame:
    """The formatted text of each conversation, its turns by ``turn`` (null first; equals by role and text), with the byte ranges that count for the loss.

    Null roles and texts are empty; a null ``conv_id`` is a conversation. A conversation is one row, but where it's longer than ``part_bytes`` or has turns
    that differ by 1024 or more, it's several rows in order of ``block, seq``: each whole turns, together the conversation. So a conversation with a
    large share of all rows is formatted by many tasks. A task assembles about ``part_bytes`` at once, a longer text on its own. ``loss_start`` and ``loss_end`` are offsets in the UTF-8 of the row's ``formatted``.
    """
    n = partitions or tasks_for(conversations, "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.floor(F.col("turn") / 1024).cast("long").alias("block"), "turn", "role", "text")

    def emit(table: pa.Table, seq: dict):
        roles, texts = (table.column(c).combine_chunks() if table.num_rows else pa.array([], pa.string()) for c in ("role", "text"))
        buffer, at, spans = assemble(roles, texts)
        key = [(c, b) for c, b in zip(table.column("conv_id").to_pylist(), table.column("block").to_pylist(), strict=True)]
        loss = pc.fill_null(pc.is_in(roles, pa.array(list(loss_roles), roles.type)), False).to_numpy(zero_copy_only=False)
        cuts = [0]
        for i in range(1, len(key)):
            if key[i] != key[i - 1] or at[i + 1] - at[cuts[-1]] > part_bytes:
                cuts.append(i)
        out: dict[str, list] = {k: [] for k in ("conv_id", "block", "seq", "loss_start", "loss_end", "n_turns")}
        for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
            if seq.get("key") != key[a]:
                seq["key"], seq["next"] = key[a], 0
            own = spans[a:b][loss[a:b]] - at[a]
            for k, v in zip(out, (*key[a], seq["next"], own[:, 0].tolist(), own[:, 1].tolist(), b - a), strict=True):
                out[k].append(v)
            seq["next"] += 1
        offsets = at[[*cuts, len(key)]]
        text = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(offsets.astype(np.int64)), buffer)
        kinds = {"conv_id": pa.int64(), "block": pa.int64(), "seq": pa.int64(), "loss_start": pa.list_(pa.int64()), "loss_end": pa.list_(pa.int64()), "n_turns": pa.int64()}
        columns = {k: pa.array(v, kinds[k]) for k, v in out.items()} | {"formatted": text.cast(pa.string())}
        return pa.RecordBatch.from_pydict({k: columns[k] for k in ("conv_id", "block", "seq", "formatted", "loss_start", "loss_end", "n_turns")})

    def run(batches):
        held, seq = None, {}
        for batch in (piece for batch in batches for piece in slices(batch, "text", part_bytes, batch.num_rows)):
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            # the last conversation may go on in the next batch
            c, b, i = table.column("conv_id"), table.column("block"), table.num_rows - 1
            last = (c[i].as_py(), b[i].as_py())
            while i > 0 and (c[i - 1].as_py(), b[i - 1].as_py()) == last:
                i -= 1
            if table.num_rows - i > 1 and table.slice(i).nbytes > part_bytes:
                i = table.num_rows
            if i:
                yield emit(table.slice(0, i), seq)
            held = table.slice(i) if i < table.num_rows else None
        if held is not None and held.num_rows:
            yield emit(held, seq)

    first = lambda *c: [F.col(x).asc_nulls_first() for x in c]
    return rows.repartitionByRange(n, *first("conv_id", "block")).sortWithinPartitions(*first("conv_id", "block", "turn", "role", "text")).mapInArrow(run, FORMATTED)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted text."""
    out = []
    for turn in formatted.split(END.decode())[:-1]:
        role, _, text = turn.removeprefix(START.decode()).partition("\n")
        out.append((unescape_role(role), unescape(text)))
    return out


def digest_chats(formatted: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per conversation, read back from the formatted rows: number and hash of its turns, characters and hash of the text under the loss mask, and formatted characters.

    Rows of a conversation pass one task in order, as one hash of all of them asks for; it keeps the hash's state, not the rows.
    """
    n = partitions or int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        state: dict = {}
        out: list[tuple] = []

        def close():
            if state:
                out.append((state["id"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["formatted"]))

        def take():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.clear()
            return batch

        for batch in (piece for batch in batches for piece in slices(batch, "formatted", 8 << 20, batch.num_rows)):
            for conv, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if not state or state["id"] != conv:
                    close()
                    state = {"id": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                for role, turn in parse_turns(text):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{turn}\n".encode())
                raw = text.encode()
                for a, b in zip(starts, ends, strict=True):
                    own = unescape(raw[a:b].decode())
                    state["chars"] += len(own)
                    state["loss"].update(own.encode())
                state["formatted"] += len(text)
            if out:
                yield take()
        close()
        if out:
            yield take()

    first = [F.col(x).asc_nulls_first() for x in ("conv_id", "block", "seq")]
    return formatted.repartitionByRange(n, first[0]).sortWithinPartitions(*first).select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
