"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orewright.llm.pieces import slices
from orewright.llm.quality import held_out
from orewright.llm.tasks import arrow_map

#: Families of closely related languages; a language that isn't here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "bg", "pl", "cs", "sk", "sr", "hr", "sl"),
}
DIMS = 4096
_CODE = np.array([b - 96 if 97 <= b <= 122 else b - 101 if b > 127 else 0 for b in range(256)], np.int64)


def trigrams(texts: pa.Array) -> np.ndarray:
    """Unit rows of hashed counts of three bytes within lower-cased words; what isn't a letter parts words."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    rows = len(texts)
    buffers = texts.buffers()
    ends = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + rows + 1]
    data = np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]] if buffers[2] and rows else np.zeros(0, np.uint8)
    row = np.repeat(np.arange(rows), np.diff(ends))
    out = np.zeros((rows, DIMS), np.float32)
    if len(data) > 2:
        c = _CODE[data]
        code = (c[:-2] * 160 + c[1:-1]) * 160 + c[2:]
        keep = (row[2:] == row[:-2]) & (c[1:-1] > 0)
        slot = ((code[keep] * 2654435761) >> 12) % DIMS
        out = np.bincount(row[2:][keep] * DIMS + slot, minlength=rows * DIMS).reshape(rows, DIMS).astype(np.float32)
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _svm(x: np.ndarray, y: np.ndarray, epochs: int = 12, penalty: float = 1e-4, seed: int = 3) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine for labels -1 and 1, by averaged stochastic steps on batches."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    w, mean, t, n = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0, 0
    balance = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 64):
            t += 1
            rows = order[a : a + 64]
            wrong = y[rows] * (x[rows] @ w) < 1
            rate = 1 / (penalty * (t + 1000))
            w = (1 - rate * penalty) * w + rate * ((y[rows] * balance[rows] * wrong) @ x[rows]) / len(rows)
            if epoch * 2 >= epochs:
                mean, n = mean + w, n + 1
    return (mean / max(n, 1)).astype(np.float32)


@dataclass
class LanguageModel:
    """Weights for each pair of families, and for each pair of languages in a family."""

    families: dict[str, list[str]]
    between: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    within: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    @staticmethod
    def _vote(x: np.ndarray, names: list[str], machines: dict) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner of most pairs (of equals, the one with the larger sum of margins) and its least certain win."""
        votes, sums, least = np.zeros((len(x), len(names))), np.zeros((len(x), len(names))), np.ones((len(x), len(names)))
        for (i, a), (j, b) in combinations(enumerate(names), 2):
            m = x @ machines[a, b]
            p = 1 / (1 + np.exp(-np.clip(3 * m, -40, 40)))
            votes[:, i], votes[:, j] = votes[:, i] + (m >= 0), votes[:, j] + (m < 0)
            sums[:, i], sums[:, j] = sums[:, i] + np.tanh(m), sums[:, j] - np.tanh(m)
            least[:, i], least[:, j] = np.minimum(least[:, i], p), np.minimum(least[:, j], 1 - p)
        best = np.argmax(votes + sums / (4 * len(names)), 1)
        return best, least[np.arange(len(x)), best]

    def predict(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and their scores."""
        x = np.column_stack([features, np.ones(len(features), np.float32)])
        names = sorted(self.families)
        family, sure = self._vote(x, names, self.between)
        out = np.full(len(x), "und", object)
        for k, name in enumerate(names):
            rows = np.flatnonzero(family == k)
            if len(rows):
                own = self.families[name]
                best, p = self._vote(x[rows], own, self.within)
                out[rows] = np.array(own, object)[best]
                sure[rows] *= p
        return out, sure


def fit_languages(x: np.ndarray, langs: np.ndarray, families: dict[str, tuple[str, ...]] | None = None) -> LanguageModel:
    of = {lang: name for name, own in (families or FAMILIES).items() for lang in own}
    found: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        found.setdefault(of.get(lang, f"only {lang}"), []).append(lang)
    model = LanguageModel(found)
    family = np.array([of.get(lang, f"only {lang}") for lang in langs], object)
    for labels, groups, machines in [(family, [sorted(found)], model.between), (langs, list(found.values()), model.within)]:
        for group in groups:
            for a, b in combinations(group, 2):
                rows = np.flatnonzero((labels == a) | (labels == b))
                machines[a, b] = _svm(x[rows], np.where(labels[rows] == a, 1.0, -1.0))
    return model


def train_language(docs: DataFrame, rows_per_language: int = 800, most_languages: int = 200, families: dict[str, tuple[str, ...]] | None = None) -> LanguageModel:
    """Learn from at most about ``rows_per_language`` distinct documents of each language, chosen by a hash of id and text among those that aren't held out and name a language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 4, 2))
    number = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("doc_id", "text")).alias("n")).limit(most_languages + 1).collect()}
    if len(number) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not number:
        return LanguageModel({})
    limit = F.create_map(*[F.lit(v) for lang, n in number.items() for v in (lang, rows_per_language * (1 << 20) / n)])
    sample = known.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 20)) < limit[F.col("lang")]).select("doc_id", "lang", "text").distinct()

    def run(batch):
        for part in slices(batch, most=1_000_000, rows=256):
            yield part, {"_x": pa.array([v.astype(np.float16).tobytes() for v in trigrams(part.column("text"))], pa.binary())}

    got = arrow_map(sample, run, [T.StructField("_x", T.BinaryType())], ["doc_id", "lang"], ("text",)).orderBy("doc_id", "lang", F.xxhash64("_x")).toPandas()
    langs, x = got["lang"].to_numpy(), np.empty((len(got), DIMS), np.float32)
    for i, v in enumerate(got.pop("_x")):
        x[i] = np.frombuffer(v, np.float16)
    return fit_languages(x, langs, families)


def predict_language(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``lang_pred string`` and ``score double`` (0 to 1). Texts that are null or have no letter (of a Unicode category L), and all texts where nothing was learnt, are ``und`` with score 0."""

    def run(batch):
        for part in slices(batch, text, 1_000_000, 256):
            texts = part.column(text)
            there = np.array([any(map(str.isalpha, t or "")) for t in texts.to_pylist()], bool)
            lang, score = model.predict(trigrams(texts)) if model.families else (np.full(len(part), "und", object), np.zeros(len(part)))
            lang[~there], score[~there] = "und", 0.0
            yield part, {"lang_pred": pa.array(list(lang), pa.string()), "score": pa.array(score.astype(float))}

    return arrow_map(docs, run, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], keep, (text,))
