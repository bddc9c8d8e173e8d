"""Quality scores of documents by Bradley-Terry pairwise ranking.

A document's strength is linear in features of its whole text; of two documents, the better one wins with the logistic
probability of the difference of their strengths. Pairs are a preferred and a rejected labelled document. The threshold is the
quantile of the strengths at the share of rejected labels, and a score is the logistic of the distance from it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orewright.llm.pieces import slices
from orewright.llm.tasks import arrow_map
from orewright.plans.shared import scratch

#: By byte: 0 other, 1 lower-case letter or part of a character over 127, 2 upper-case letter, 3 digit, 4 white space, 5 full stop or comma, 6 other mark.
_KIND = np.array([4 if b in (9, 10, 11, 12, 13, 32) else 1 if 97 <= b <= 122 or b > 127 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 5 if b in b".," else 6 if 33 <= b < 127 else 0 for b in range(256)], np.uint8)
BASE = 20
FEATURES = 3 * BASE
#: Bytes of text whose features are counted at once, as counting takes many times their memory.
SLICE = 1_000_000


def _repeats(texts: pa.Array, mark: str, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pieces of each text between marks: how many, how many distinct, how many equal the one before, and the share of the commonest."""
    parts = pc.split_pattern(texts, mark)
    n = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    codes, row = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(rows), n)
    same = np.bincount(row[1:][(codes[1:] == codes[:-1]) & (row[1:] == row[:-1])], minlength=rows)
    key, count = np.unique(row * (len(coded.dictionary) + 1) + codes, return_counts=True)
    own = key // (len(coded.dictionary) + 1)
    top = np.zeros(rows)
    np.maximum.at(top, own, count)
    return n, np.bincount(own, minlength=rows), same, top / np.maximum(n, 1)


def features(texts: pa.Array) -> np.ndarray:
    """A row of :data:`FEATURES` numbers for each text, from all its bytes; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    rows = len(texts)
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + rows + 1]
    data = np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]] if buffers[2] and rows else np.zeros(0, np.uint8)
    size = np.diff(ends)
    row = np.repeat(np.arange(rows), size)
    kind = _KIND[data]
    counts = np.bincount(row * 7 + kind, minlength=rows * 7).reshape(rows, 7).astype(float)
    n = np.maximum(size, 1)[:, None]
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    inside = row[1:] == row[:-1]
    runs = np.bincount(row[1:][(data[1:] == data[:-1]) & inside & (kind[1:] != 4)], minlength=rows)
    marks = np.bincount(row[1:][(kind[1:] == 6) & (kind[:-1] == 6) & inside], minlength=rows)
    lines, distinct_lines, same_lines, top_line = _repeats(texts, "\n", rows)
    words, distinct_words, same_words, top_word = _repeats(texts, " ", rows)
    base = np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(lines), size / words, words / lines,
        counts[:, [3, 4, 5, 6, 0]] / n, counts[:, 2] / letters, runs / n[:, 0], marks / n[:, 0],
        distinct_words / np.sqrt(words), distinct_words / words, same_words / words, top_word,
        distinct_lines / lines, same_lines / lines, top_line,
    ])
    return np.column_stack([base, np.sqrt(np.abs(base)), base * base])


@dataclass
class PairwiseModel:
    """Strength ``(x - mean) / spread @ weight``; ``cut`` is the strength at which a score is ``at``."""

    mean: np.ndarray
    spread: np.ndarray
    weight: np.ndarray
    cut: float
    at: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        strength = self.strength(x) - self.cut
        return 1 / (1 + np.exp(-np.clip(strength + np.log(self.at / (1 - self.at)), -40, 40)))


def fit_pairs(x: np.ndarray, y: np.ndarray, at: float = 0.3, pairs: int = 20_000, steps: int = 400, penalty: float = 1e-3, seed: int = 7) -> PairwiseModel:
    """Weights from ``pairs`` pairs drawn from the sampled rows. With one label alone, all documents are on its side of the cut."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / spread, -8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if len(good) and len(bad):
        rng = np.random.default_rng(seed)
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        first, second = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            g = -(d * (1 / (1 + np.exp(np.clip(d @ w, -40, 40))))[:, None]).mean(0) + penalty * w
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    cut = 0.0 if len(good) and len(bad) else 1e9 if len(bad) else -1e9
    return PairwiseModel(mean, spread, w, cut, at)


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id doesn't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows_per_label: int = 5000, at: float = 0.3) -> PairwiseModel:
    """Learn weights from about ``rows_per_label`` distinct rows of each label, chosen by a hash, so the driver holds a bounded table of features; the cut is the quantile of the
    strengths of all documents with a label, at the share of those that are rejected.

    Rows whose label is null, or that are held out, teach nothing. Of repeated labels the mean counts, rejected where it is under a half. With one label alone, all
    documents score that label. Rows of one id are chosen each on its own, and equal ones count once.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    number = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    untaught = PairwiseModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), -1e9, at)
    if not number:
        return untaught
    u = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20))
    limit = lambda n: F.when(F.col("_y") == 1, rows_per_label * (1 << 20) / max(n.get(1, 1), 1)).otherwise(rows_per_label * (1 << 20) / max(n.get(0, 1), 1))
    chosen = known.where(u < limit(number))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ids: at most about twice rows_per_label
    there = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("n")).collect()}
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(12)), F.lit(1 << 20)) < limit(there)).dropDuplicates(["doc_id", "text"])

    def run(batch):
        for part in slices(batch, most=SLICE):
            yield part, {"_x": pa.array(list(features(part.column("text"))), pa.list_(pa.float64()))}

    got = arrow_map(sample, run, [T.StructField("_x", T.ArrayType(T.DoubleType()))], ["doc_id", "_y"], ("text",)).orderBy("doc_id", F.hash("_x")).toPandas()
    if not len(got):
        return untaught
    model = fit_pairs(np.stack(got["_x"]), got["_y"].to_numpy(), at)
    if abs(model.cut) < 1e9:
        model.cut = _quantile(docs, known, model)
    return model


def _quantile(docs: DataFrame, known: DataFrame, model: PairwiseModel) -> float:
    """Half way between the strength at the share of rejected documents, of all that have a label, and the next above it."""

    def run(batch):
        for part in slices(batch, most=SLICE):
            yield part, {"_s": pa.array(model.strength(features(part.column("text"))))}

    with scratch(docs.sparkSession, "strengths") as own:
        strengths = arrow_map(docs.select("doc_id", "text").where("doc_id is not null"), run, [T.StructField("_s", T.DoubleType())], ["doc_id"], ("text",))
        found = own.keep(strengths.join(known, "doc_id"), "labelled")
        share = found.agg(F.avg(1 - F.col("_y"))).first()[0]
        at = found.agg(F.percentile_approx("_s", share, 100_000)).first()[0]
        below, above = found.agg(F.max(F.when(F.col("_s") <= at, F.col("_s"))), F.min(F.when(F.col("_s") > at, F.col("_s")))).first()
    return (below + (below if above is None else above)) / 2


def score_quality(docs: DataFrame, model: PairwiseModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``score double`` (0 to 1) and ``predicted int`` (1 where the score is at least ``model.at``) from each whole text; null counts as empty."""

    def run(batch):
        for part in slices(batch, text, SLICE):
            score = model.score(features(part.column(text)))
            yield part, {"score": pa.array(score), "predicted": pa.array((score >= model.at).astype(np.int32))}

    return arrow_map(docs, run, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], keep, (text,))
