"""Near-duplicate documents: improved consistent weighted sampling of TF-IDF word shingles, banded and verified.

A shingle is five words in a row (a shorter text is one shingle). Its weight in a document is its count there times its inverse document
frequency, ``log((1 + documents) / (1 + those that have it)) + 1``. A single pass over all documents counts those that have a shingle, in a sketch of
:data:`CELLS` counters: each distinct shingle of each document adds one to the counter of its hash. Counters are sums, so neither the order nor the
partitions of the table matter. A counter is the shingle's documents and those of others of the same counter, the mean of all counters
more on average: where a corpus has few shingles for its counters, frequencies are exact, and in any corpus of mean length ``m``, shingles of well over
``m / CELLS`` of all documents are told apart, and rarer ones weigh about alike.

Every shingle competes in one of 64 bins, by its hash, and each bin keeps the consistent sample of its shingles' weights, so the
work is linear in the text. Two documents agree in a bin about as often as their weighted Jaccard similarity; a band is the
samples of four bins. Documents that share a band with each other are compared by their exact weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewright.llm.pieces import slices
from orewright.plans.components import connected_components
from orewright.plans.shared import Scratch, materialize, scratch

SIZE, BINS, ROWS = 5, 64, 4
#: Counters of document frequencies, by the first bits of a hash, and how many of them are a row of the sketch.
BITS, RUN = 22, 4096
CELLS = 1 << BITS
#: Texts lighter than so many of the rarest shingles are sampled as a whole.
LIGHT = 128
#: Members of a bucket up to which each is compared with each; all of a larger one are compared too, in the way described at :func:`_links`.
FEW = 32
#: About as many texts, and characters, are in a block of a larger bucket.
BLOCK, BLOCK_CHARS = 512, 4_000_000
#: Stands for a null id.
NO_ID = -(1 << 63)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P, _Q, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = np.multiply.accumulate(np.full(max(n, 1) - 1, base, np.uint64))
    return out


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and hash of every shingle, sorted by both, and two numbers for each text that stand for its words in order."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    rows = len(texts)
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + rows + 1]
    data = np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]] if buffers[2] and rows else np.zeros(0, np.uint8)
    at = ends - ends[0]
    solid = ~_SPACE[data]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    start[heads] = solid[heads]
    first = np.flatnonzero(start)
    row = np.searchsorted(at, first, "right") - 1
    keys = np.zeros((rows, 2), np.uint64)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), keys
    length = np.diff(np.append(first, len(data)))
    place = np.arange(first[0], len(data)) - np.repeat(first, length)
    value = (data[first[0] :].astype(np.uint64) + np.uint64(1)) * _powers(_P, int(length.max()))[place]
    value[~solid[first[0] :]] = 0
    word = _mix(np.add.reduceat(value, first - first[0]))
    n = np.bincount(row, minlength=rows)
    begin = np.concatenate([[0], np.cumsum(n)])[:-1]
    index = np.arange(len(word)) - np.repeat(begin, n)
    full = n > 0
    for k, base in enumerate((_Q, _R)):
        keys[full, k] = _mix(np.add.reduceat(word * _powers(base, int(n.max()))[index], begin[full]) + n[full].astype(np.uint64), k + 1)
    hashes = word.copy()
    for k in range(1, SIZE):
        hashes[: len(word) - k] += word[k:] * _powers(_Q, SIZE)[k]
    keep = index <= np.repeat(n, n) - SIZE
    short = (n > 0) & (n < SIZE)
    hashes, row = np.concatenate([_mix(hashes[keep], 3), keys[short, 0]]), np.concatenate([row[keep], np.flatnonzero(short)])
    order = np.argsort(hashes, kind="stable")
    order = order[np.argsort(row[order].astype(np.uint16) if rows < 65536 else row[order], kind="stable")]
    return row[order], hashes[order], keys


@dataclass
class Rarity:
    """Inverse document frequencies by counter, as 1/2048 each, and the largest of any shingle."""

    cells: np.ndarray
    top: float

    def of(self, h: np.ndarray) -> np.ndarray:
        return self.cells[(h >> np.uint64(64 - BITS)).astype(np.int64)] / 2048.0


def weighted(texts: pa.Array, rarity: Rarity) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of each text's distinct shingles, sorted by the first two, and the texts' keys."""
    row, h, keys = shingles(texts)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    row, distinct = row[first], h[first]
    return row, distinct, np.diff(np.append(first, len(h))) * rarity.of(distinct), keys


def _samples(h: np.ndarray, weight: np.ndarray, group: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups (runs of equal numbers) and the consistent sample of each: the shingle and its quantised weight, as one number."""
    x, y = _mix(h, salt), _mix(h, salt + 1)
    half = lambda v: (v & np.uint64(0xFFFFFFFF)).astype(float) + 0.5
    high = lambda v: (v >> np.uint64(32)).astype(float) + 0.5
    r, c = -np.log(half(x) * high(x) * 2.0**-64), -np.log(half(y) * high(y) * 2.0**-64)
    t = np.floor(np.log(weight) / r + high((x ^ y) * _R) * 2.0**-32)
    a = np.log(c) - r * (t - high((x ^ y) * _R) * 2.0**-32 + 1)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    best = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, first), np.diff(np.append(first, len(h)))))
    best = best[np.append(True, group[best][1:] != group[best][:-1])]  # of equals, the least hash
    return group[best], _mix(h[best] + t[best].astype(np.int64).astype(np.uint64) * _R, 5) | np.uint64(1)


def bands(row: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int, threshold: float = 0.8, least: float = 0.0) -> list[np.ndarray]:
    """The band values of each text; bands in which all bins are empty are left out.

    Texts that weigh ``least`` or more have a sample for each bin. In lighter ones too few shingles meet in a bin, so 64 samples are taken of all of
    them. Similar texts weigh alike, so those a little heavier than ``least`` get both kinds, and any two similar texts have one kind in common.
    """
    total = np.bincount(row, weights=weight, minlength=rows)
    out: list[list[np.ndarray]] = [[] for _ in range(rows)]
    for kind, mine in enumerate((total >= least, total < least / threshold)):
        sig = np.zeros((rows, BINS), np.uint64)
        own = mine[row]
        if not own.any():
            continue
        x, w, at = h[own], weight[own], row[own]
        if kind == 0:
            group, value = _samples(x, w, at * BINS + (x >> np.uint64(58)).astype(np.int64), 11)
            sig.reshape(-1)[group] = value
        else:
            for k in range(BINS):
                group, value = _samples(x, w, at, 21 + 2 * k)
                sig[group, k] = value
        parts = sig.reshape(rows, BINS // ROWS, ROWS)
        value = np.zeros((rows, BINS // ROWS), np.uint64)
        for k in range(ROWS):
            value = _mix(value * _Q + parts[:, :, k], 6)
        value = _mix(value + np.arange(1 + 100 * kind, BINS // ROWS + 1 + 100 * kind, dtype=np.uint64) * _P, 7).view(np.int64)
        filled = parts.any(2)
        for i in np.flatnonzero(mine & filled.any(1)):
            out[i].append(value[i][filled[i]])
    none = np.zeros(0, np.int64)
    return [np.concatenate(x) if x else none for x in out]


def count_into(sums: np.ndarray, cells: np.ndarray) -> None:
    """Add the occurrences of ``cells`` to ``sums``, in memory that goes with ``cells`` alone."""
    cell, n = np.unique(cells, return_counts=True)
    sums[cell] += n.astype(sums.dtype)


def document_frequencies(docs: DataFrame, own: Scratch, text: str = "text", held_most: int = CELLS // 8) -> Rarity:
    """The sketch of all documents (see above) as the weights that it stands for, 8 MB whatever the table is. A task holds about ``held_most`` hashes before it counts them."""
    runs = CELLS // RUN

    def count(batches):
        sums, held, size, number = np.zeros(CELLS, np.uint32), [], 0, 0

        def add():
            if not held:
                return
            count_into(sums, np.concatenate(held))
            held.clear()

        def rows(first: int, values: np.ndarray):
            kind = np.min_scalar_type(int(values.max()))
            return pa.RecordBatch.from_pydict({"run": pa.array(range(first, first + len(values)), pa.int32()), "width": pa.array([kind.itemsize] * len(values), pa.int32()), "counts": pa.array([v.tobytes() for v in values.astype(kind)], pa.binary())})

        for batch in batches:
            for piece in slices(batch, text, 1_000_000):
                row, h, _ = shingles(piece.column(text))
                new = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
                held.append((h[new] >> np.uint64(64 - BITS)).astype(np.uint32))
                size, number = size + len(held[-1]), number + len(piece)
                if size > held_most:
                    add()
                    size = 0
        if number:
            add()
            for a in range(0, runs, 64):
                yield rows(a, sums.reshape(runs, RUN)[a : a + 64])
            yield rows(-1, np.array([[number]]))

    def total(batches):
        run, sums = None, None
        done = lambda: pa.RecordBatch.from_pydict({"run": pa.array([run], pa.int32()), "counts": pa.array([sums.tobytes()], pa.binary())})
        for batch in batches:
            for r, width, counts in zip(batch.column("run").to_pylist(), batch.column("width").to_pylist(), batch.column("counts"), strict=True):
                if r != run:
                    if run is not None:
                        yield done()
                    run, sums = r, 0
                sums = sums + np.frombuffer(counts.as_buffer(), f"<u{width}").astype(np.int64)
        if run is not None:
            yield done()

    parts = docs.select(text).mapInArrow(count, "run int, width int, counts binary").repartition("run").sortWithinPartitions("run")
    found = own.keep(parts.mapInArrow(total, "run int, counts binary"), "sketch")
    first = found.where("run = -1").first()
    n = int(np.frombuffer(first["counts"], "<i8")[0]) if first else 0

    def weigh(batches):
        for batch in batches:
            for r, counts in zip(batch.column("run").to_pylist(), batch.column("counts"), strict=True):
                idf = np.log((1 + n) / (1 + np.minimum(np.frombuffer(counts.as_buffer(), "<i8"), n))) + 1
                there = np.frombuffer(counts.as_buffer(), "<i8") > 0
                yield pa.RecordBatch.from_pydict({"run": pa.array([r], pa.int32()), "top": pa.array([int((np.round(idf * 2048) * there).max())], pa.int32()), "cells": pa.array([np.round(idf * 2048).astype("<u2").tobytes()], pa.binary())})

    cells, top = np.full((runs, RUN), 2048, np.uint16), 2048
    for r in found.where("run >= 0").mapInArrow(weigh, "run int, top int, cells binary").collect():  # 1024 rows of 8 KB
        cells[r["run"]], top = np.frombuffer(r["cells"], "<u2"), max(top, r["top"])
    own.drop("sketch")
    return Rarity(cells.reshape(-1), top / 2048)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``class_id`` (the least doc_id of its class) and ``kept`` (one row of each class).

    Texts of the same words in the same order are copies and share a class; different texts are linked where their weighted Jaccard
    similarity is at least ``threshold``, and classes are the connected components. Null texts count as empty, and all empty texts are copies of
    each other. A null doc_id is the least. Rows of one doc_id with different texts each take part; of several kept rows of one id all stay.
    """
    signed, known = _labelled(docs, threshold, doc_id, text)
    classes = known.groupBy("label").agg(F.min("least").alias("class_id"))
    known = known.join(classes, "label").select("k1", "k2", "class_id")
    out = signed.select("doc_id", "k1", "k2").join(known, ["k1", "k2"])
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(back("doc_id").alias("doc_id"), back("class_id").alias("class_id"), (F.col("doc_id") == F.col("class_id")).alias("kept"))


def representatives(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` (:data:`NO_ID` for null) and ``x``, the ``xxhash64`` of the text, of one document of each class: the least id, and of equals the least ``x``."""
    signed, known = _labelled(docs, threshold, doc_id, text)
    least = signed.join(known, ["k1", "k2"]).groupBy("label").agg(F.min(F.struct("doc_id", "x")).alias("first"))
    return least.select(F.col("first.doc_id").alias("id"), "first.x")


def _labelled(docs: DataFrame, threshold: float, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Each row's id, text hash and keys, and ``label`` and least id of each distinct text."""
    with scratch(docs.sparkSession, "near") as own:
        signed, known = _label(docs, threshold, doc_id, text, own)
        return materialize(signed, "signed"), materialize(known, "known")


def _label(docs: DataFrame, threshold: float, doc_id: str, text: str, own: Scratch) -> tuple[DataFrame, DataFrame]:
    state = docs.sparkSession.sparkContext.broadcast(document_frequencies(docs, own, text))

    def sign(batches):
        for batch in batches:
            for piece in slices(batch, "text", 1_000_000):
                row, hashes, weight, keys = weighted(piece.column("text"), state.value)
                found = bands(row, hashes, weight, len(piece), threshold, LIGHT * state.value.top)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "x": piece.column("x"), "k1": pa.array(keys[:, 0].view(np.int64)), "k2": pa.array(keys[:, 1].view(np.int64)), "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))})

    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"))
    signed = own.keep(rows.withColumn("x", F.xxhash64("text")).mapInArrow(sign, "doc_id long, x long, k1 long, k2 long, bands array<long>"), "signatures")
    # one row for each distinct text; its number is the least id, made unique where one id has several texts
    texts = own.keep(signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands")), "texts")
    repeated = signed.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    texts = texts.select("k1", "k2", "least", (F.xxhash64("k1", "k2") if repeated else F.col("least")).alias("t"), "bands")
    links = _links(rows, texts, threshold, state, repeated, own)
    labels = connected_components(links.where(F.col("similarity") >= threshold), "a", "b")
    known = texts.select("k1", "k2", "least", "t").join(labels.withColumnRenamed("node", "t"), "t", "left")
    return signed.select("doc_id", "x", "k1", "k2"), known.select("k1", "k2", "least", F.coalesce("label", "t").alias("label"))


def _bodies(rows: DataFrame, texts: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """``t`` and ``text`` of the wanted text numbers, each once."""
    named = texts.select("t", "least", "k1", "k2").join(wanted, "t", "left_semi")
    if not repeated:
        return named.select("t", F.col("least").alias("doc_id")).join(rows, "doc_id").select("t", "text")

    def key(batches):
        for batch in batches:
            for piece in slices(batch, "text", 1_000_000):
                keys = shingles(piece.column("text"))[2].view(np.int64)
                yield pa.RecordBatch.from_pydict({"k1": pa.array(keys[:, 0]), "k2": pa.array(keys[:, 1]), "text": piece.column("text")})

    return rows.mapInArrow(key, "k1 long, k2 long, text string").join(named, ["k1", "k2"]).groupBy("t").agg(F.min("text").alias("text"))


def _links(rows: DataFrame, texts: DataFrame, threshold: float, state, repeated: bool, own: Scratch) -> DataFrame:
    """Compared pairs ``a < b`` of text numbers and their similarity, enough of them for the connected components.

    In a bucket of few texts each is compared with each. In a larger one, its least and its greatest number are compared with all others,
    which settles a group of near copies with two comparisons each. The texts that this leaves outside the component of its bucket's least are
    compared with each other and with all of the bucket, see :func:`_blocks`.
    """
    similar = lambda done: done.where(F.col("similarity") >= threshold).select("a", "b")
    pairs = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    first = texts.select("t", F.explode("bands").alias("key"))
    ends = lambda df: df.groupBy("key").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count("*").alias("n")).where("n > 1")
    rest = own.keep(first.join(ends(first), "key"), "buckets")
    bodies = own.keep(_bodies(rows, texts, rest.select("t").distinct(), repeated), "bodies")
    few, many = rest.where(F.col("n") <= FEW).select("key", "t"), rest.where(F.col("n") > FEW)
    each = few.withColumnRenamed("t", "a").join(few.withColumnRenamed("t", "b"), "key").where("a < b").select("a", "b")
    star = many.where("t <> low").select(*pairs("low", "t")).unionAll(many.where("t <> high").select(*pairs("high", "t")))
    done = _compare(each.unionAll(star).distinct(), bodies, state, own)
    if many.limit(1).count() == 0:
        return done
    labels = connected_components(similar(done), "a", "b")
    label = lambda df, t, name: df.join(labels.select(F.col("node").alias(t), F.col("label").alias(name)), t, "left").withColumn(name, F.coalesce(name, t))
    many = own.keep(label(label(many, "t", "own"), "low", "theirs").select("key", "t", (F.col("own") != F.col("theirs")).alias("far")), "outside")
    return done.unionByName(_blocks(many, bodies, threshold, state, own))


def _blocks(many: DataFrame, bodies: DataFrame, threshold: float, state, own: Scratch) -> DataFrame:
    """Similar pairs that tie together all similar texts of one ``key``, of which one at least is ``far``.

    The far texts of a key are dealt to blocks by a hash, and so are the others. Each two blocks, one of far texts at least, are a task of their own
    with the exact similarity of all its pairs, so no task grows with the bucket.
    """
    sized = many.join(many.where("far").select("key").distinct(), "key", "left_semi").join(bodies.select("t", F.length("text").alias("size")), "t")
    number = lambda of: F.greatest(F.ceil(F.count(F.when(of, 1)) / BLOCK), F.ceil(F.sum(F.when(of, F.col("size")).otherwise(0)) / BLOCK_CHARS)).cast("int")
    counts = sized.groupBy("key").agg(number(F.col("far")).alias("outer"), number(~F.col("far")).alias("inner"))
    dealt = sized.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("t", "key"), F.when(F.col("far"), F.col("outer")).otherwise(F.col("inner"))).cast("int"))
    # a task is a key and two blocks: i of the far texts, and j of the far texts (up from 0) or of the others (down from -1)
    task = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    both = F.concat(F.transform(upto(F.col("outer")), lambda o: task(F.least(o, "block"), F.greatest(o, "block"))), F.transform(upto(F.col("inner")), lambda o: task(F.col("block"), -1 - o)))
    alone = F.transform(upto(F.col("outer")), lambda o: task(o, -1 - F.col("block")))
    tasks = own.keep(dealt.select("key", "t", "block", "far", F.explode(F.when(F.col("far"), both).otherwise(alone)).alias("task")).select("key", "task.i", "task.j", "t", F.when(F.col("far"), F.col("block")).otherwise(-1 - F.col("block")).alias("side")), "tasks")

    def judge(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        t, side = table.column("t").to_numpy(), table.column("side").to_numpy()
        like = similarities(table.column("text").combine_chunks(), state.value)
        linked = like >= threshold
        if i != j:
            linked &= side[:, None] != side[None, :]
        a, b = forest(linked)
        return pa.table({"a": pa.array(np.minimum(t[a], t[b])), "b": pa.array(np.maximum(t[a], t[b])), "similarity": pa.array(like[a, b])})

    found = tasks.join(bodies, "t").groupBy("key", "i", "j").applyInArrow(judge, "a long, b long, similarity double")
    return own.keep(found, "blocks")


def similarities(texts: pa.Array, rarity: Rarity) -> np.ndarray:
    """The weighted Jaccard similarity of each two of some texts."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    row, h, _ = shingles(texts)
    n = len(texts)
    factor = rarity.of(h)
    total = np.bincount(row, weights=factor, minlength=n)
    # the second copy of a shingle in a text is an item of its own, so the lesser of two weights is a sum over items that both have
    head = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))[: len(h)]
    copy = np.arange(len(h)) - np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
    item = np.where(copy > 0, _mix(h + copy.astype(np.uint64) * _R, 9), h)
    order = np.argsort(item, kind="stable")
    item, row, factor = item[order], row[order], factor[order]
    first = np.flatnonzero(np.append(True, item[1:] != item[:-1])[: len(item)])
    count = np.diff(np.append(first, len(item)))
    shared = np.zeros(n * n)
    for k in range(2, 17):  # items of few texts: their pairs
        at = first[count == k]
        for a in range(0, len(at), 4096):
            own = row[at[a : a + 4096, None] + np.arange(k)]
            cell = own[:, :, None] * n + own[:, None, :]
            shared += np.bincount(cell.ravel(), np.repeat(factor[at[a : a + 4096]], k * k), n * n)
    shared = shared.reshape(n, n)
    at, size = first[count > 16], count[count > 16]
    for a in range(0, len(at), 1024):  # items of more: a product
        held = np.zeros((n, len(at[a : a + 1024])))
        for c, (f, k) in enumerate(zip(at[a : a + 1024], size[a : a + 1024], strict=True)):
            held[row[f : f + k], c] = 1
        shared += (held * factor[at[a : a + 1024]]) @ held.T
    np.fill_diagonal(shared, total)
    return shared / np.maximum(total[:, None] + total[None, :] - shared, 1e-300)


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links enough to tie together what ``linked`` ties."""
    new, a, b = np.ones(len(linked), bool), [], []
    for i in range(len(linked)):
        if not new[i]:
            continue
        new[i], queue = False, [i]
        for x in queue:
            found = np.flatnonzero(linked[x] & new)
            new[found] = False
            queue.extend(found.tolist())
            a.extend([x] * len(found))
            b.extend(found.tolist())
    return np.array(a, np.int64), np.array(b, np.int64)


def _compare(pairs: DataFrame, bodies: DataFrame, state, keep: Scratch) -> DataFrame:
    """The ``similarity`` of each of ``pairs``, from the texts themselves."""
    pairs = keep.keep(pairs, "pairs")
    number = pairs.count()

    def judge(batches):
        last: list = [None, None]

        def own(column: pa.Array):
            row, h, w, _ = weighted(column, state.value)
            return h, w, np.searchsorted(row, np.arange(len(column) + 1))

        for batch in batches:
            for piece in slices(batch, "tb", 1_000_000):
                h, w, cut = own(piece.column("tb"))
                a, ta = piece.column("a").to_pylist(), piece.column("ta")
                out = []
                for i, name in enumerate(a):
                    if last[0] != name:
                        x, y, _ = own(ta.slice(i, 1))
                        last[:] = name, (x, y, y.sum())
                    x, y, total = last[1]
                    p, q = h[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]]
                    if not len(x) or not len(p):
                        out.append(float(len(x) == len(p)))
                        continue
                    place = np.minimum(np.searchsorted(x, p), len(x) - 1)
                    both = x[place] == p
                    low = np.minimum(y[place[both]], q[both]).sum()
                    out.append(float(low / (total + q.sum() - low)))
                yield pa.RecordBatch.from_pydict({"a": piece.column("a"), "b": piece.column("b"), "similarity": pa.array(out, pa.float64())})

    if number <= 20_000:  # few pairs: only their texts are moved
        bodies = bodies.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct()), "t", "left_semi")
    left, right = bodies.select(F.col("t").alias("a"), F.col("text").alias("ta")), bodies.select(F.col("t").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return keep.keep(both.mapInArrow(judge, "a long, b long, similarity double"), "compared")
