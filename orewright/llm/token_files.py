"""Token ids as flat unsigned integer files with 64-bit document offsets.

A dataset is a folder. For each partition it has ``<name>.bin`` (ids, little-endian, unsigned, of 16 bits where the vocabulary
allows, else 32), ``<name>.idx`` (int64: where each document starts, in ids, and the end) and ``<name>.doc`` (int64: document
ids). A file name belongs to one attempt of one task; the ``manifest`` table names those that count, so attempts that were
lost or ran twice leave nothing behind that is read. The base of a partition is the sum of the ids before it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orewright.llm.pieces import WordTable, _Index, gather, slices
from orewright.llm.tasks import once, tasks_for
from orewright.plans.shared import fresh_path

NULL_ID = -(1 << 63)
MANIFEST = "part long, name string, bits int, n_docs long, n_tokens long"
#: A blank beside other white space, at an end, or a control character that marks a text's start below.
_ODD = "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}] | [\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]|^ | $|\\x00|^$"

#: A word of Latin letters and marks after it, at a text's start (\\x00) or not: the pattern parts the word from the marks and nothing else.
_PLAIN = r"^(?P<first>\x00?)(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,!?;:#$%&*]*)$"
#: A blank between two characters that aren't white space: the pattern always parts there.
_CUT = re.compile(r"(?<=[^\s\x00])(?= [^\s\x00])")


def byte_level(raw: str) -> bool:
    """Whether a tokenizer file is one that this module can take apart: byte-level BPE with the usual pattern, and nothing that changes texts or reaches over blanks."""
    spec = json.loads(raw)
    model, level = spec["model"], spec.get("pre_tokenizer") or {}
    added = [(t["content"], t.get("lstrip"), t.get("rstrip"), t.get("single_word")) for t in spec.get("added_tokens") or []]
    return (
        model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space", True)
        and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")
        and not any(left or right or single or re.search(r"\s", text) or re.fullmatch(r"[A-Za-zÀ-ÖØ-öø-ÿ.,!?;:#$%&*]+", text) for text, left, right, single in added)
    )


class LibraryTable(WordTable):
    """Ids by the ``tokenizers`` library. The pattern of byte-level BPE never joins what a single blank parts, so each distinct stretch from a blank to the next is encoded once.

    Of a stretch that is a word with marks after it, word and marks are known on their own, and the library's model alone encodes them. Texts of other
    tokenizer files (see :func:`byte_level`) are encoded whole.
    """

    def __init__(self, data: bytes, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.whole = Tokenizer.from_str(data.decode()), not byte_level(data.decode())
        if not self.whole:
            spec = json.loads(data)
            self.bare = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "added_tokens": []}))  # takes words in the alphabet of bytes
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.alphabet = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(32, 256)}
            self.blank = self.alphabet[32]
            names = self.library.get_vocab()
            self.leads = np.zeros(max(names.values()) + 1, bool)
            self.leads[[i for name, i in names.items() if name.startswith(self.blank)]] = True
        super().__init__(None, ("library",), True, most)

    @property
    def odd(self) -> str:
        return "" if self.whole else _ODD

    def split(self, texts: pa.Array) -> pa.Array:
        return pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\x00", pa.large_string()), texts, pa.scalar("", pa.large_string())), " ")

    def words(self, text: str) -> list[str]:
        return ["\x01" + x for x in ([text] if self.whole else _CUT.split(text))]

    def clear(self) -> None:
        super().clear()
        self.parts, self.part_ids, self.part_sizes = _Index(), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def forget(self) -> None:
        kept = self.parts, self.part_ids, self.part_sizes
        super().forget()
        self.parts, self.part_ids, self.part_sizes = kept
        if len(self.parts) > self.most:
            self.parts, self.part_ids, self.part_sizes = _Index(), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        got = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), np.int32), np.fromiter(map(len, got), np.int32, len(got))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words with a blank in front, many in a call: of a word's pieces the first alone begins with the blank."""
        words = "\n".join(words).translate(self.alphabet).split("\n") if words else []
        got = self.bare.encode_batch_fast([words[i : i + 1000] for i in range(0, len(words), 1000)], is_pretokenized=True, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, np.int32) for e in got)])
        return ids, np.diff(np.append(np.flatnonzero(self.leads[ids]), len(ids))).astype(np.int32)

    def _numbers(self, texts: pa.Array) -> np.ndarray:
        """Numbers of words or marks, whose ids the model alone gives."""
        coded = texts.dictionary_encode()
        found = np.fromiter(map(self.parts.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
        new, self.parts.new = self.parts.new, []
        if new:
            led = np.fromiter((w[:1] == " " for w in new), bool, len(new))
            (a, n), (b, m) = self._words([w for w in new if w[:1] == " "]), self._each([w for w in new if w[:1] != " "])
            starts, sizes = np.zeros(len(new), np.int64), np.zeros(len(new), np.int32)
            starts[led], sizes[led], starts[~led], sizes[~led] = np.cumsum(n) - n, n, len(a) + np.cumsum(m) - m, m
            self.part_ids, self.part_sizes = np.concatenate([self.part_ids, gather(np.concatenate([a, b]), starts, sizes)]), np.concatenate([self.part_sizes, sizes])
        return found[coded.indices.to_numpy()]

    def _learn(self) -> None:
        if not self.index.new:
            return
        new = pa.array(self.index.new, pa.large_string())
        found = pc.extract_regex(new, _PLAIN)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        known, rest = found.filter(found.is_valid()), [w[1:] if w[:1] in ("\x00", "\x01") else " " + w for w in new.filter(found.is_null()).to_numpy(zero_copy_only=False)]
        first, word, marks = (known.field(i) for i in range(3))
        blank = pc.if_else(pc.equal(first, "\x00"), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
        pair = np.column_stack([self._numbers(pc.binary_join_element_wise(blank, word, pa.scalar("", pa.large_string()))), self._numbers(marks)])
        ids, sizes = self._each(rest)
        # the ids of parts and of the rest side by side, then those of each stretch in order
        starts = np.concatenate([[0], np.cumsum(self.part_sizes, dtype=np.int64)])
        begin, n = np.zeros((len(new), 2), np.int64), np.zeros((len(new), 2), np.int64)
        begin[plain], n[plain] = starts[pair], self.part_sizes[pair]
        begin[~plain, 0], n[~plain, 0] = starts[-1] + np.cumsum(sizes, dtype=np.int64) - sizes, sizes
        self.flat = np.concatenate([self.flat, gather(np.concatenate([self.part_ids, ids]), begin.reshape(-1), n.reshape(-1))])
        self.lengths[0] = np.concatenate([self.lengths[0], n.sum(1).astype(np.int32)])
        self.index.new = []


@lru_cache(maxsize=64)
def _fs(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root)


def _size(root: str, name: str, dtype: str) -> int:
    fs, base = _fs(root)
    return fs.get_file_info(f"{base}/{name}").size // np.dtype(dtype).itemsize


def _range(root: str, name: str, dtype: str, a: int, b: int) -> np.ndarray:
    """Values ``a`` to ``b`` of a file: memory-mapped where the store is a local folder, else that range is read."""
    fs, base = _fs(root)
    path, width = f"{base}/{name}", np.dtype(dtype).itemsize
    if b <= a:
        return np.zeros(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r", a * width, (b - a,))
    with fs.open_input_file(path) as f:
        f.seek(a * width)
        return np.frombuffer(f.read((b - a) * width), dtype)


def write_token_files(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, root: str | None = None, partitions: int | None = None, part_bytes: int = 64 << 20) -> str:
    """Write the ids of all documents, in ascending ``doc_id`` order (null first), each followed by ``end_id``; gives the folder.

    Null and empty texts have the end id alone. Repeated ids keep all their rows, side by side, in no set order. A doc_id of
    -2**63 is read back as null. Partitions are ranges of doc_id of about ``part_bytes`` of text (at least ``spark.sql.shuffle.partitions`` of them), so no task
    gets more than its share unless one id repeats.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    from tokenizers import Tokenizer

    bits = 16 if max(Tokenizer.from_str(raw.decode()).get_vocab_size(), end_id + 1) <= 65536 else 32
    data, key = spark.sparkContext.broadcast(raw), hashlib.sha1(raw).hexdigest()
    root = root or fresh_path(spark, "tokens")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = partitions or tasks_for(rows, "text", part_bytes)

    def write(batches):
        from pyspark import TaskContext

        table = once(("library", key), lambda: LibraryTable(data.value))
        fs, base = _fs(root)
        fs.create_dir(base)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        docs = tokens = 0
        with fs.open_output_stream(f"{base}/{name}.bin") as ids_to, fs.open_output_stream(f"{base}/{name}.idx") as starts_to, fs.open_output_stream(f"{base}/{name}.doc") as docs_to:
            starts_to.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                for piece in slices(batch):
                    ids, offsets = table.ids(piece.column("text"))
                    rows = len(piece)
                    out = np.full(len(ids) + rows, end_id, f"<u{bits // 8}")
                    out[np.arange(len(ids)) + np.repeat(np.arange(rows), np.diff(offsets))] = ids
                    ids_to.write(memoryview(out))
                    starts_to.write((tokens + offsets[1:] + np.arange(1, rows + 1)).astype("<i8").tobytes())
                    docs_to.write(pc.fill_null(piece.column("doc_id"), NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    docs, tokens = docs + rows, tokens + len(out)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "name": [name], "bits": pa.array([bits], pa.int32()), "n_docs": pa.array([docs], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    nulls_first = F.col("doc_id").asc_nulls_first()
    rows.repartitionByRange(n, nulls_first).sortWithinPartitions(nulls_first).mapInArrow(write, MANIFEST).write.parquet(f"{root}/manifest")
    return root


def read_token_files(spark: SparkSession, root: str) -> DataFrame:
    """Per document: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` (with the end id) and ``ids_crc32`` (of its ids as unsigned little-endian 32-bit integers)."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))

    def read(batches, most=4_000_000):
        for batch in batches:
            for row in batch.to_pylist():
                name, kind = row["name"], f"<u{row['bits'] // 8}"
                total, a = _size(root, f"{name}.doc", "<i8"), 0
                while a < total:  # up to 20,000 documents and ``most`` ids at once; a longer document on its own
                    at = np.asarray(_range(root, f"{name}.idx", "<i8", a, min(a + 20_000, total) + 1))
                    n = max(1, int(np.searchsorted(at, at[0] + most, "right")) - 1)
                    at = at[: n + 1]
                    own = np.asarray(_range(root, f"{name}.doc", "<i8", a, a + n))
                    ids, low = _range(root, f"{name}.bin", kind, int(at[0]), int(at[-1])).astype("<u4"), at - at[0]
                    crc = [zlib.crc32(memoryview(ids[x:y])) for x, y in zip(low[:-1].tolist(), low[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(own, pa.int64(), mask=own == NULL_ID), "start": pa.array(row["base"] + at[:-1]), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64())})
                    a += n

    n = max(1, files.count())  # a task for each file
    return files.repartitionByRange(n, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
