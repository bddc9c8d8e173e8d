"""SentencePiece encoding and decoding, and token counts, over the shared-prefix forward pass of :mod:`orewright.llm.pieces`."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orewright.llm.pieces import BYTE, CONTROL, MARK, UNKNOWN, PieceModel, WordTable, slices
from orewright.llm.tasks import arrow_map, once


def _shared_model(df: DataFrame, model_path: str):
    with open(model_path, "rb") as f:
        data = f.read()
    PieceModel.parse(data)  # an unsupported model fails here, not in a task
    return df.sparkSession.sparkContext.broadcast(data), hashlib.sha1(data).hexdigest()


def _table(data, key: str, modes: tuple[str, ...], with_ids: bool, scored: bool = False) -> WordTable:
    model = once(("model", key), lambda: PieceModel.parse(data.value))
    return once(("words", key, modes, with_ids, scored), lambda: WordTable(model, modes, with_ids, scored=scored))


class Decoder:
    """Bytes of ids, in numpy: each id's bytes lie in one pool."""

    def __init__(self, model: PieceModel):
        own = []
        for p, k in zip(model.pieces, model.kinds, strict=True):
            own.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode())
        self.size = np.array([len(x) for x in own], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.pool = np.frombuffer(b"".join(own), np.uint8)
        self.cut = model.dummy_prefix

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 of all texts and their offsets; the blank that the encoder puts before a text is gone."""
        n = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = self.pool[np.repeat(self.start[ids] - ends[:-1], n) + np.arange(ends[-1])]
        at = ends[offsets]
        if self.cut and len(out):
            first = np.zeros(len(at) - 1, bool)
            full = at[1:] > at[:-1]
            first[full] = out[at[:-1][full]] == 32
            keep = np.ones(len(out), bool)
            keep[at[:-1][first]] = False
            out = out[keep]
            at = at - np.concatenate([[0], np.cumsum(first)])
        return out, at


def encode(docs: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None, check: bool = False) -> DataFrame:
    """Adds ``ids array<int>`` and ``n_tokens long``: the segmentation of each whole text that the model file stands for.

    ``check`` also adds ``ids_crc32`` (of the ids as little-endian 32-bit integers), ``decoded_sha256`` (of the text that the
    ids decode to) and ``round_trip`` (whether that is the text), and of the segmentation with the highest sum of scores, which is the model's own only for
    unigram files, ``viterbi_tokens`` and ``viterbi_score``. Null and empty texts have no ids. Rows stay as they are,
    repeated ones too; columns of the input with an added name are replaced. A lone surrogate can't occur in a Spark string.
    """
    data, key = _shared_model(docs, model_path)
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if check:
        added += [T.StructField("ids_crc32", T.LongType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType()), T.StructField("viterbi_tokens", T.LongType()), T.StructField("viterbi_score", T.DoubleType())]

    def run(batch):
        table = _table(data, key, (), True, check)
        decoder = once(("decoder", key), lambda: Decoder(table.model)) if check else None
        for part in slices(batch, text):
            found = table.look_up(part.column(text))
            ids, offsets = table.ids_of(*found)
            out = {"n_tokens": pa.array(np.diff(offsets)), "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))}
            if check:
                raw, view = ids.astype("<u4"), memoryview
                out["viterbi_tokens"], out["viterbi_score"] = (pa.array(x) for x in table.best_of(*found))
                made, at = decoder.texts(ids, offsets)
                whole = pc.fill_null(part.column(text), "").cast(pa.large_binary())
                buffers = whole.buffers()
                ends = np.frombuffer(buffers[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
                own = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
                out["ids_crc32"] = pa.array([zlib.crc32(view(raw[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64())
                out["decoded_sha256"] = pa.array([hashlib.sha256(view(made[a:b])).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)])
                out["round_trip"] = pa.array([bool(np.array_equal(made[a:b], own[c:d])) for a, b, c, d in zip(at[:-1], at[1:], ends[:-1], ends[1:], strict=True)])
            yield part, out

    return arrow_map(docs, run, added, keep, (text,))


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds the text ``out`` that each array of ids stands for. Null ids give a null text; bytes that aren't UTF-8 become U+FFFD; ids outside the vocabulary fail."""
    data, key = _shared_model(encoded, model_path)

    def run(batch):
        model = once(("model", key), lambda: PieceModel.parse(data.value))
        decoder = once(("decoder", key), lambda: Decoder(model))
        column = batch.column(batch.schema.get_field_index(ids))
        flat = pc.fill_null(column.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(flat) and (flat.min() < 0 or flat.max() >= len(model.pieces)):
            raise ValueError("an id outside the vocabulary, or a null among the ids")
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        made, at = decoder.texts(flat, np.concatenate([[0], np.cumsum(sizes)]))
        null = column.is_null().to_pylist()
        yield batch, {out: pa.array([None if gone else made[a:b].tobytes().decode("utf-8", "replace") for a, b, gone in zip(at[:-1], at[1:], null, strict=True)], pa.string())}

    return arrow_map(encoded, run, [T.StructField(out, T.StringType())], keep, (ids,))


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None, unigram: bool = True) -> DataFrame:
    """Adds ``n_tokens long``, the number of ids of each whole text, and with ``unigram`` also ``n_tokens_unigram long``.

    A worker puts the distinct words of its texts into one trie, runs the forward pass once for each prefix and keeps the
    count at the word's end. ``n_tokens`` follows the model's own kind, as its library does; ``n_tokens_unigram`` takes the
    pieces and scores as a unigram model: the segmentation with the highest sum of scores. Null and empty texts have none.
    """
    data, key = _shared_model(docs, model_path)
    names = ["n_tokens", "n_tokens_unigram"][: 1 + unigram]
    modes = (PieceModel.load(model_path).mode, "unigram")[: 1 + unigram]

    def run(batch):
        table = _table(data, key, modes, False)
        for part in slices(batch, text):
            yield part, {n: pa.array(c, pa.int64()) for n, c in zip(names, table.counts(part.column(text)), strict=True)}

    return arrow_map(docs, run, [T.StructField(n, T.LongType()) for n in names], keep, (text,))
