"""SentencePiece vocabularies and the shared-prefix forward pass over sorted words.

A model file is read once on the driver; its pieces and scores (bounded by the vocabulary) travel to the tasks.
Words are runs of the word mark followed by other characters, so no piece crosses from one word into the next. A task
sorts the distinct words that it hasn't met, which lays them out as a trie in depth-first order: two neighbours share
the path of their common prefix, and the forward states of that prefix are reused.

* ``unigram`` models: the state of a prefix is its best sum of scores, the last piece on that path and the piece count.
* ``bpe`` models: the best sum of scores is not what such a model means. A prefix has exactly one segmentation in which
  every two neighbouring pieces come out of their own merges unchanged, and it's the one that the merges give. The state is
  the last piece of that segmentation; it too depends on the prefix alone, so the trie shares it in the same way.
"""

from __future__ import annotations

import heapq
import re
import struct
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message; groups don't occur."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class PieceModel:
    """Pieces, scores and kinds by id, and how the model segments."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    mode: str
    dummy_prefix: bool = True
    unk: int = 0
    _ready: dict = field(default_factory=dict, repr=False)

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        """From the bytes of a ``.model`` file. Raises ValueError for normalisation rules that aren't built."""
        pieces, scores, kinds, mode, dummy = [], [], [], 1, True
        for n, v in _fields(data):
            if n == 1:
                own = dict(_fields(v))
                pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif n == 2:
                mode = dict(_fields(v)).get(3, 1)
            elif n == 3:
                norm = dict(_fields(v))
                dummy = bool(norm.get(3, 1))
                if norm.get(2) or norm.get(4, 1) or not norm.get(5, 1):
                    raise ValueError("models that rewrite characters or white space are not supported")
        if mode not in (1, 2):
            raise ValueError("only unigram and bpe models are supported")
        if USER in kinds:
            raise ValueError("models with user-defined pieces are not supported")
        if any(MARK in p.lstrip(MARK) or "\n" in p for p, k in zip(pieces, kinds, strict=True) if k == NORMAL):
            raise ValueError("a piece reaches over the end of a word")
        return cls(pieces, scores, kinds, "unigram" if mode == 1 else "bpe", dummy, kinds.index(UNKNOWN))

    def __getstate__(self):
        return {**self.__dict__, "_ready": {}}

    def _get(self, name: str, make):
        if name not in self._ready:
            self._ready[name] = make()
        return self._ready[name]

    @property
    def vocab(self) -> dict[str, int]:
        return self._get("vocab", lambda: {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL})

    @property
    def byte_ids(self) -> list[int]:
        """Ids of the 256 byte pieces; empty where the model has none."""
        return self._get("bytes", lambda: [i for i, k in enumerate(self.kinds) if k == BYTE])

    @property
    def automaton(self) -> tuple[dict[str, int], list[str], list[dict[str, int]], list[tuple]]:
        """Longest prefixes of pieces that a word read so far ends with: numbers, strings, known steps, and (length, id) of the pieces that end there, longest first."""

        def make():
            return {"": 0}, [""], [{}], [()]

        return self._get("automaton", make)

    def _step(self, state: int, char: str) -> int:
        numbers, strings, steps, ends = self.automaton
        prefixes = self._get("prefixes", lambda: {p[:n] for p in self.vocab for n in range(len(p) + 1)})
        s = strings[state] + char
        while s not in prefixes:
            s = s[1:]
        if s not in numbers:
            numbers[s] = len(strings)
            strings.append(s)
            steps.append({})
            ends.append(tuple((len(s) - k, self.vocab[s[k:]]) for k in range(len(s)) if s[k:] in self.vocab))
        steps[state][char] = numbers[s]
        return numbers[s]

    def merge(self, word: str) -> list[str]:
        """Pieces of ``word`` by the merges themselves: the best-scored neighbours first, the leftmost of equals."""
        vocab, scores = self.vocab, self.scores
        part: list[str | None] = list(word)
        left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (k := vocab.get(both := part[i] + part[j])) is not None:
                heapq.heappush(heap, (-scores[k], i, both))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i] if part[i] is not None else -1
            if j < 0 or part[i] + part[j] != both:
                continue
            part[i], part[j], right[i] = both, None, right[j]
            if right[i] >= 0:
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in part if p is not None]

    def _fallback(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unk]

    def viterbi(self, words: list[str]) -> tuple[list[int], list[float]]:
        """The number of ids of the segmentation with the highest sum of scores, and that sum, of each of the sorted ``words``."""
        sums: list[float] = []
        return self._forward_unigram(words, False, sums), sums

    def forward(self, words: list[str], mode: str, with_ids: bool) -> list[list[int] | int]:
        """Ids, or with ``with_ids`` False their number, of each of the sorted ``words``."""
        return (self._forward_bpe if mode == "bpe" else self._forward_unigram)(words, with_ids)

    def _ids(self, word: str, back: list[int], last: list[int], with_ids: bool, count: int):
        if not with_ids:
            return count
        out, d = [], len(word)
        while d:
            if last[d] >= 0:
                out.append(last[d])
            else:
                out.extend(reversed(self._fallback(word[d - 1])))
            d -= back[d]
        out.reverse()
        return out

    def _fit(self, p: int, i: int) -> bool:
        """Whether piece ``i`` after piece ``p`` (-1: after none) comes out of the merges of both together."""
        own = [self.pieces[i]] if p < 0 else [self.pieces[p], self.pieces[i]]
        return self.merge("".join(own)) == own

    def _forward_bpe(self, words: list[str], with_ids: bool) -> list:
        vocab = self.vocab
        _, _, steps, ends = self.automaton
        fits: list[dict[int, bool]] = self._get("fits", lambda: [{} for _ in range(len(self.pieces) + 1)])
        state, back, last, count = [0], [0], [-1], [0]  # by depth: the automaton's, length and id (-1: none) of the last piece, ids so far
        out, before = [], ""
        double = MARK * 2
        for word in words:
            if word.startswith(double):  # runs of marks have pieces of equal score, for which only the merges decide
                ids = [i for p in self.merge(word) for i in ([vocab[p]] if p in vocab else self._fallback(p))]
                out.append(ids if with_ids else len(ids))
                continue
            d, most = 0, min(len(word), len(before))
            while d < most and word[d] == before[d]:
                d += 1
            del state[d + 1 :], back[d + 1 :], last[d + 1 :], count[d + 1 :]
            at = state[d]
            for char in word[d:]:
                d += 1
                now = steps[at].get(char)
                at = self._step(at, char) if now is None else now
                state.append(at)
                for n, i in ends[at]:
                    p = last[d - n]
                    ok = fits[p].get(i)  # -1 is the list's last entry
                    if ok is None:
                        ok = fits[p][i] = self._fit(p, i)
                    if ok:
                        back.append(n)
                        last.append(i)
                        count.append(count[d - n] + 1)
                        break
                else:
                    back.append(1)
                    last.append(-1)
                    count.append(count[d - 1] + len(self._fallback(char)))
            before = word
            out.append(self._ids(word, back, last, with_ids, count[d]))
        return out

    def _forward_unigram(self, words: list[str], with_ids: bool, sums: list[float] | None = None) -> list:
        scores = self.scores
        _, _, steps, ends = self.automaton
        unknown = min((s for s, k in zip(scores, self.kinds, strict=True) if k == NORMAL), default=0.0) - 10.0
        state, back, last, count, best = [0], [0], [-1], [0], [0.0]
        out, before = [], ""
        for word in words:
            d, most = 0, min(len(word), len(before))
            while d < most and word[d] == before[d]:
                d += 1
            del state[d + 1 :], back[d + 1 :], last[d + 1 :], count[d + 1 :], best[d + 1 :]
            at = state[d]
            for char in word[d:]:
                d += 1
                now = steps[at].get(char)
                at = self._step(at, char) if now is None else now
                state.append(at)
                n0, i0, top = 0, -1, 0.0
                for n, i in ends[at]:
                    s = best[d - n] + scores[i]
                    if not n0 or s > top:
                        n0, i0, top = n, i, s
                if (not n0 or ends[at][-1][0] > 1) and (not n0 or best[d - 1] + unknown > top):  # no piece is this one character
                    n0, i0, top = 1, -1, best[d - 1] + unknown
                back.append(n0)
                last.append(i0)
                best.append(top)
                count.append(count[d - n0] + (1 if i0 >= 0 else len(self._fallback(char))))
            before = word
            if sums is not None:
                sums.append(best[d])
            out.append(self._ids(word, back, last, with_ids, count[d]))
        return out


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` from each of ``starts``, of the given sizes, one after another."""
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class _Index(dict):
    """Numbers words as they come; ``new`` has those without a value yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i


class WordTable:
    """What a worker knows of the words that it has met. Beyond ``most`` words those of one slice alone are forgotten, so its memory is bounded."""

    def __init__(self, model: PieceModel, modes: tuple[str, ...] = (), with_ids: bool = True, most: int = 400_000, scored: bool = False):
        self.model, self.modes, self.with_ids, self.most, self.scored = model, modes or (model.mode,), with_ids, most, scored
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.lengths = [np.zeros(0, np.int32) for _ in self.modes]
        self.flat = np.zeros(0, np.int32)
        self.seen = np.zeros(0, np.uint8)
        self.best = [np.zeros(0, np.int32), np.zeros(0)]  # with ``scored``: ids and sum of scores of the best segmentation

    def forget(self) -> None:
        """Keep the words that were in more than one slice, or nothing where these are more than half of ``most``."""
        stay = np.flatnonzero(self.seen > 1)
        if len(stay) * 2 > self.most:
            self.clear()
            return
        names = list(self.index)
        starts = np.concatenate([[0], np.cumsum(self.lengths[0], dtype=np.int64)])[stay]
        if self.with_ids:
            self.flat = gather(self.flat, starts, self.lengths[0][stay])
        self.lengths, self.seen = [x[stay] for x in self.lengths], np.ones(len(stay), np.uint8)
        self.best = [x[stay] for x in self.best] if self.scored else self.best
        self.index = _Index()
        self.index.update(zip([names[i] for i in stay.tolist()], range(len(stay)), strict=True))

    @property
    def odd(self) -> str:
        """Texts in which blanks run together, or that start without a mark, must be split slowly."""
        return f"^ | $|  |{MARK}|^$" if self.model.dummy_prefix else ""

    def split(self, texts: pa.Array) -> pa.Array:
        return pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), texts, pa.scalar("", pa.large_string())), " ", f" {MARK}"), " ")

    def words(self, text: str) -> list[str]:
        return WORD.findall((MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK))

    def _learn(self) -> None:
        new = self.index.new
        if not new:
            return
        parts = [[w] if "\n" not in w and MARK not in w[1:] else WORD.findall(w) for w in new]
        words = sorted({w for p in parts for w in p})
        for m, mode in enumerate(self.modes):
            known = dict(zip(words, self.model.forward(words, mode, self.with_ids), strict=True))
            if self.with_ids:
                got = [known[p[0]] if len(p) == 1 else [i for w in p for i in known[w]] for p in parts]
                self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), np.int32)])
                got = [len(x) for x in got]
            else:
                got = [known[p[0]] if len(p) == 1 else sum(known[w] for w in p) for p in parts]
            self.lengths[m] = np.concatenate([self.lengths[m], np.array(got, np.int32)])
        if self.scored:
            counts, sums = (dict(zip(words, x, strict=True)) for x in self.model.viterbi(words))
            self.best = [np.concatenate([self.best[0], np.array([sum(counts[w] for w in p) for p in parts], np.int32)]), np.concatenate([self.best[1], np.array([sum(sums[w] for w in p) for p in parts], float)])]
        self.index.new = []

    def look_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, one after another, and how many each text has. A word here ends at a blank; its lines are parted when it's learnt."""
        if len(self.index) > self.most:
            self.forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        words = self.split(texts.filter(pa.array(~odd)))
        sizes = np.zeros(len(texts), np.int64)
        sizes[~odd] = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        distinct = np.fromiter(map(self.index.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
        plain = distinct[coded.indices.to_numpy()] if len(distinct) else np.zeros(0, np.int64)
        if odd.any():
            runs, others, at = [], [], 0
            for i, (strange, n) in enumerate(zip(odd, sizes, strict=True)):
                if strange:
                    text = texts[i].as_py()
                    found = self.words(text) if text else []
                    sizes[i] = len(found)
                    runs.append(np.fromiter((self.index[w] for w in found), np.int64, len(found)))
                    others.append(runs[-1])
                else:
                    runs.append(plain[at : at + n])
                    at += n
            distinct = np.concatenate([distinct, *others])
            plain = np.concatenate(runs)
        self._learn()
        self.seen = np.concatenate([self.seen, np.zeros(len(self.index) - len(self.seen), np.uint8)])
        self.seen[distinct] = np.minimum(self.seen[distinct] + 1, 2)
        return plain, sizes

    def counts(self, texts: pa.Array) -> list[np.ndarray]:
        """Number of ids of each text, under each mode."""
        words, sizes = self.look_up(texts)
        ends = np.cumsum(sizes)
        out = []
        for lengths in self.lengths:
            total = np.concatenate([[0], np.cumsum(lengths[words], dtype=np.int64)])
            out.append(total[ends] - total[ends - sizes])
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the offset of each text's first (one more offset at the end)."""
        return self.ids_of(*self.look_up(texts))

    def best_of(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sum of scores of the best segmentation of each text, of what :meth:`look_up` gave."""
        row = np.repeat(np.arange(len(sizes)), sizes)
        return np.bincount(row, self.best[0][words], len(sizes)).astype(np.int64), np.bincount(row, self.best[1][words], len(sizes))

    def ids_of(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.concatenate([[0], np.cumsum(self.lengths[0], dtype=np.int64)])
        n = self.lengths[0][words]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        return gather(self.flat, starts[words], n), ends[np.concatenate([[0], np.cumsum(sizes)])]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 2_500_000, rows: int = 2000):
    """The batch in runs of at most ``rows`` rows whose texts sum to about ``most`` bytes; a longer text is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (total + n > most or i - start >= rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield batch.slice(start)
