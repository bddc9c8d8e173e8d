"""Repair of the structure of conversations: the cheapest edits after which turns alternate, by block tables in the way of the Four Russians.

A repaired conversation is empty, or has turns of a user and an assistant in turns, after at most one turn of the system. What the turns behind a place
still cost is a vector over four states (nothing yet, after ``s``, after ``u``, after ``a``). Its entries differ by little, so there are few vectors once the
least entry is taken off, and what a block of :data:`BLOCK` turns does to each of them is a table. Blocks are looked up from the last to the first;
then each is expanded into the vectors between its turns, and the edits are read from the first turn to the last, where of all edits that keep the cost the ASCII-least letter is taken.
"""

from __future__ import annotations

import hashlib
import itertools
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orewright.llm.line_dedup import BLANKS
from orewright.llm.pieces import slices
from orewright.llm.tasks import tasks_for

#: Turns in a block of the tables; up to so many conversations are walked one by one.
BLOCK, FEW = 4, 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Symbols: a turn's initial (``s``, ``u``, ``a``, another), 4 more if it is truncated; a turn that must go; no turn.
GONE, PAD, SYMBOLS = 8, 9, 10
NOTHING, S, U, A = range(4)
#: The state after an initial where it is allowed, and the state after the turn that may be put in.
_NEXT = {(NOTHING, 0): S, (NOTHING, 1): U, (S, 1): U, (A, 1): U, (U, 2): A}
_PUT = (U, U, A, U)
_AT_END = (0, 2 * INSERT, INSERT, 0)


def _step(after: tuple, symbol: int) -> tuple:
    """What it costs from before a turn, by state, when ``after`` is what it costs from behind it."""
    if symbol == PAD:
        return after
    extra = TRUNCATED * (symbol // 4 % 2)
    costs = []
    for q in range(4):
        ways = [DELETE + after[q]]
        if symbol != GONE:
            ways.append(REROLE + extra + after[_PUT[q]])
            if (q, symbol % 4) in _NEXT:
                ways.append(KEEP + extra + after[_NEXT[q, symbol % 4]])
        costs.append(min(ways))
    for _ in range(3):  # turns put in before it
        costs = [min(c, INSERT + costs[_PUT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


def _letters(after: tuple, symbol: int, q: int) -> tuple[str, int]:
    """The letters up to and with the one that takes the turn, and the state then: at each place the least letter that keeps the cost."""
    if symbol == PAD:
        return "", q
    now, letters, extra = _step(after, symbol), "", TRUNCATED * (symbol // 4 % 2)
    while True:
        if DELETE + after[q] == now[q]:
            return letters + "D", q
        if INSERT + now[_PUT[q]] == now[q]:
            letters, q = letters + "I", _PUT[q]
            continue
        kept = _NEXT.get((q, symbol % 4)) if symbol != GONE else None
        if kept is not None and KEEP + extra + after[kept] == now[q]:
            return letters + "K", kept
        return letters + "R", _PUT[q]


class Tables:
    """Vectors that occur, and what each symbol and each block does to them."""

    def __init__(self):
        vectors, number = [_AT_END], {_AT_END: 0}
        step, cost = [], []
        for v in vectors:  # grows while new ones come up
            row = []
            for symbol in range(SYMBOLS):
                w = _step(v, symbol)
                least = min(w)
                w = tuple(x - least for x in w)
                if w not in number:
                    number[w] = len(vectors)
                    vectors.append(w)
                row.append((number[w], least))
            step.append([n for n, _ in row])
            cost.append([c for _, c in row])
        self.vectors, self.step, self.cost = np.array(vectors), np.array(step, np.int16), np.array(cost, np.int64)
        self.block_step, self.block_cost = self.step, self.cost
        for _ in range(BLOCK - 1):  # one more symbol in front of each block
            first = self.step[self.block_step]
            more = self.cost[self.block_step] + self.block_cost[:, :, None]
            size = first.shape[1] * SYMBOLS
            self.block_step, self.block_cost = (x.transpose(0, 2, 1).reshape(len(vectors), size) for x in (first, more))
        words: dict[str, int] = {}
        self.word, self.state = (np.zeros((len(vectors), SYMBOLS, 4), np.int16) for _ in range(2))
        for v, symbol, q in itertools.product(range(len(vectors)), range(SYMBOLS), range(4)):
            letters, then = _letters(vectors[v], symbol, q)
            self.word[v, symbol, q], self.state[v, symbol, q] = words.setdefault(letters, len(words)), then
        self.next, self.block_next = self.state.reshape(-1, 4).tolist(), self.block_step.tolist()
        self.ends = np.array([words.setdefault("I" * (c // INSERT), len(words)) for c in _AT_END], np.int16)
        self.words = pa.array(list(words))


@cache
def tables() -> Tables:
    return Tables()


def cheapest_edits(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The cost and the letters of the edits of conversations that stand one behind the other in ``symbols``."""
    t, lengths = tables(), np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")  # long ones first, so those that still have blocks are a head of the array
    sizes = lengths[order]
    blocks = -(-sizes // BLOCK)
    base = np.concatenate([[0], np.cumsum(blocks)])
    starts = (np.cumsum(lengths) - lengths)[order]
    padded = np.full((int(base[-1]), BLOCK), PAD, np.uint8)
    if len(symbols):
        padded.reshape(-1)[np.repeat(base[:-1] * BLOCK, sizes) + _ranges(sizes)] = np.asarray(symbols, np.uint8)[np.repeat(starts, sizes) + _ranges(sizes)]
    codes = padded.astype(np.int64) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))
    vector, cost, behind = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(codes), np.int16)
    k = n = 0
    for k in range(int(blocks.max(initial=0)) + 1):
        n = int(np.searchsorted(-blocks, -k, side="left"))
        if n <= FEW:
            break
        at = base[1 : n + 1] - 1 - k
        behind[at] = vector[:n]
        cost[:n] += t.block_cost[vector[:n], codes[at]]
        vector[:n] = t.block_step[vector[:n], codes[at]]
    for c in range(n):  # the few long ones one by one
        v, seen = int(vector[c]), []
        for code in codes[base[c] : base[c + 1] - k][::-1].tolist():
            seen.append(v)
            v = t.block_next[v][code]
        vector[c], part = v, np.array(seen[::-1], np.int64)
        behind[base[c] : base[c + 1] - k] = part
        cost[c] += t.block_cost[part, codes[base[c] : base[c + 1] - k]].sum()
    cost += t.vectors[vector, NOTHING]
    between = np.zeros(padded.shape, np.int16)
    between[:, -1] = behind
    for j in range(BLOCK - 1, 0, -1):
        between[:, j - 1] = t.step[between[:, j], padded[:, j]]
    flat, between = padded.reshape(-1), between.reshape(-1)
    state, words = np.zeros(len(sizes), np.int64), np.zeros(len(flat) + len(sizes), np.int16)
    place = base * BLOCK + np.arange(len(base))  # a conversation's words, and one for its end
    i = n = 0
    for i in range(int(sizes.max(initial=0)) + 1):
        n = int(np.searchsorted(-sizes, -i, side="left"))
        if n <= FEW:
            break
        at = base[:n] * BLOCK + i
        words[place[:n] + i] = t.word[between[at], flat[at], state[:n]]
        state[:n] = t.state[between[at], flat[at], state[:n]]
    for c in range(n):
        a, b, q, seen = base[c] * BLOCK + i, base[c] * BLOCK + sizes[c], int(state[c]), []
        for row in (between[a:b].astype(np.int64) * SYMBOLS + flat[a:b]).tolist():
            seen.append(q)
            q = t.next[row][q]
        words[place[c] + i : place[c] + sizes[c]] = t.word[between[a:b], flat[a:b], np.array(seen, np.int64)]
        state[c] = q
    none = t.words.index("").as_py()
    for i in range(BLOCK):  # what pads the last block has no letters
        pad = place[:-1] + sizes + i
        words[pad[i < blocks * BLOCK - sizes]] = none
    words[place[1:] - 1] = t.ends[state]
    audits = pc.binary_join(pa.ListArray.from_arrays(pa.array(place, pa.int32()), t.words.take(pa.array(words))), "")
    back = np.argsort(order, kind="stable")
    return cost[back], audits.take(pa.array(back))


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0, 1 ... below each size."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, n``: rows damaged by the CRC of ``conv_id:turn``. ``n`` is how often a row is there: 0 where it is dropped, 2 where it is repeated."""
    by = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), by.alias("by"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("by") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("by") == 0, 0).when(F.col("by") == 3, 2).otherwise(1).alias("n"),
    )


def find_faults(rows: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text, n`` (null roles and texts are one blank), equal ones as one with the sum of their ``n``, and the first fault of
    each: ``blank`` and ``duplicate`` (numbers of rows), ``truncated``, ``kind`` (initial of the role), ``symbol`` (of the first of its ``n``; the others must go).

    A row is a duplicate if its role and text stand before it by turn (null first). All of it is grouping: equal rows and the first turn of equal texts are
    found by aggregates and a join on the conversation and 128 bits of hash, so a conversation with most of all rows meets in no task.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "n")
    folded = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").cast("long").alias("n"))
    folded = folded.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit(1), "role", "text")})
    there = folded.where("n > 0")
    first = there.groupBy("conv_id", "a", "b").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("null_first")).withColumnsRenamed({"conv_id": "c", "a": "a2", "b": "b2"})
    both = folded.join(first, folded["conv_id"].eqNullSafe(F.col("c")) & (folded["a"] == F.col("a2")) & (folded["b"] == F.col("b2")), "left")
    is_first = F.when(F.col("null_first"), F.col("turn").isNull()).otherwise(F.coalesce(F.col("turn") == F.col("least"), F.lit(False)))
    blank = F.btrim("text", F.lit(BLANKS)) == ""
    cut = ~F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1).isin(*".!?")
    initial = F.substring("role", 1, 1)
    stays = ~blank & is_first & (F.col("n") > 0)
    marked = both.select("conv_id", "turn", "role", "text", "n", blank.alias("is_blank"), stays.alias("stays"), (stays & cut).alias("cut"), F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("kind"))
    return marked.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "n",
        F.when(F.col("is_blank"), F.col("n")).otherwise(0).alias("blank"),
        F.when(F.col("is_blank"), 0).otherwise(F.col("n") - F.col("stays").cast("long")).alias("duplicate"),
        F.col("cut").cast("long").alias("truncated"),
        "kind",
        F.when(F.col("stays"), F.col("kind") + 4 * F.col("cut").cast("int")).otherwise(GONE).alias("symbol"),
    )


def _by_conversation(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """Rows of a conversation in one task and in order, null before all."""
    first = [F.col(c).asc_nulls_first() for c in ("conv_id", *order)]
    return rows.repartitionByRange(n, first[0]).sortWithinPartitions(*first)


def plan_repairs(faults: DataFrame, partitions: int | None = None) -> DataFrame:
    """``conv_id, illegal, cost, audit`` of each conversation of :func:`find_faults`, its rows by turn, role and text (null first).

    A task holds two bytes for each row of the conversations of a batch, about as much as their audits.
    """
    n = partitions or int(faults.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def emit(parts: list[tuple]):
        """Whole conversations: (id, kinds, symbols) of runs, in order."""
        ids, starts = [], []
        for k, (conv, kinds, _) in enumerate(parts):
            if not k or conv != ids[-1]:
                ids.append(conv)
                starts.append(0)
            starts[-1] += len(kinds)
        kinds, symbols = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint8) for i in (1, 2))
        lengths = np.array(starts, np.int64)
        owner = np.repeat(np.arange(len(ids)), lengths)
        legal = np.zeros(16, bool)
        legal[[0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]] = True
        odd = ~legal[kinds[:-1] * 4 + kinds[1:]] & (owner[:-1] == owner[1:])
        illegal = np.bincount(owner[:-1][odd], minlength=len(ids)) if len(kinds) > 1 else np.zeros(len(ids), np.int64)
        cost, audits = cheapest_edits(symbols, lengths)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(illegal, pa.int64()), pa.array(cost, pa.int64()), audits], names=["conv_id", "illegal", "cost", "audit"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            ids = batch.column("conv_id").to_pylist()
            copies = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(copies)])
            kinds = np.repeat(batch.column("kind").to_numpy(zero_copy_only=False).astype(np.uint8), copies)
            symbols = np.full(len(kinds), GONE, np.uint8)
            real = copies > 0
            symbols[ends[:-1][real]] = batch.column("symbol").to_numpy(zero_copy_only=False)[real]
            a = 0
            for i in range(1, len(ids) + 1):
                if i == len(ids) or ids[i] != ids[a]:
                    if held and a == 0 and held[-1][0] != ids[a]:
                        yield emit(held)
                        held = []
                    held.append((ids[a], kinds[ends[a] : ends[i]], symbols[ends[a] : ends[i]]))
                    a = i
            done = next(k for k in range(len(held), -1, -1) if not k or held[k - 1][0] != held[-1][0]) if held else 0
            if done:
                yield emit(held[:done])
                held = held[done:]
        if held:
            yield emit(held)

    return _by_conversation(faults, n, "turn", "role", "text").select("conv_id", "n", "kind", "symbol").mapInArrow(run, "conv_id long, illegal long, cost long, audit string")


def apply_repairs(faults: DataFrame, plans: DataFrame, partitions: int | None = None, part_bytes: int = 8 << 20) -> DataFrame:
    """The turns of the repaired conversations: ``conv_id, position`` (from 0), ``edit`` (``K``, ``R`` or ``I``), ``role, text``; those of a conversation stand together in order.

    Each conversation's audit comes in front of its rows, which stream past it; a task holds the audit and one batch. A conversation without turns has no row.
    """
    n = partitions or int(faults.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = faults.select("conv_id", F.lit(1).alias("part"), "turn", "role", "text", "n")
    heads = plans.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("n"))
    names = ["conv_id", "position", "edit", "role", "text"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        out: list[list] = [[] for _ in names]
        own = {"audit": "", "at": 0, "id": None, "position": 0, "last": ""}

        def put(edit: str, role: str, text: str) -> None:
            for column, v in zip(out, (own["id"], own["position"], edit, role, text), strict=True):
                column.append(v)
            own["position"] += 1
            own["last"] = role[:1]

        def fitting() -> str:
            return "assistant" if own["last"] == "u" else "user"

        def inserts() -> None:
            while own["audit"][own["at"] : own["at"] + 1] == "I":
                own["at"] += 1
                put("I", fitting(), "")

        def take():
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
            for column in out:
                column.clear()
            return batch

        for batch in (piece for batch in batches for piece in slices(batch, "text", part_bytes, batch.num_rows)):
            for conv, part, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text", "n")), strict=True):
                if part == 0:
                    inserts()
                    own = {"audit": text, "at": 0, "id": conv, "position": 0, "last": ""}
                    continue
                for _ in range(copies):
                    inserts()
                    edit = own["audit"][own["at"]]
                    own["at"] += 1
                    if edit != "D":
                        put(edit, role if edit == "K" else fitting(), text)
            if out[0]:
                yield take()
        inserts()
        if out[0]:
            yield take()

    ordered = _by_conversation(rows.unionByName(heads), n, "part", "turn", "role", "text")
    return ordered.select("conv_id", "part", "role", "text", "n").mapInArrow(run, "conv_id long, position long, edit string, role string, text string")


def digest_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of the lines ``role:text`` of each conversation, whose turns stand together in order; a task keeps the state of one hash."""

    def run(batches):
        own, digest, out = None, None, []

        def take():
            ids, digests = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names=["conv_id", "sha256"])

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if digest is None or conv != own:
                    if digest is not None:
                        out.append((own, digest.hexdigest()))
                    own, digest = conv, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    digest.update(f"\n{role}:{text}".encode())
            if out:
                yield take()
        if digest is not None:
            out.append((own, digest.hexdigest()))
            yield take()

    return turns.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, sha256 string")


def fault_counts(faults: DataFrame) -> DataFrame:
    """``gaps`` in the turns and the numbers of ``blank, duplicate, truncated`` rows of each conversation; dropped rows (``n`` of 0) name it only."""
    turn = F.when(F.col("n") > 0, F.col("turn"))
    counts: list[Column] = [F.coalesce(F.max(turn) - F.min(turn) + 1 - F.countDistinct(turn), F.lit(0)).cast("long").alias("gaps")]
    return faults.groupBy("conv_id").agg(*counts, *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])


def repair_conversations(rows: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """For rows of ``conv_id, turn, role, text, n``: a row for each conversation (``gaps, blank, duplicate, truncated, illegal, cost, audit``), and the repaired turns.

    ``keep(df, name)`` writes a table in the shared folder and reads it back. A null ``conv_id`` is a conversation; rows of one turn go by role and text. An empty table gives empty ones.
    """
    n = tasks_for(rows, "text")
    faults = keep(find_faults(rows), "faults")
    plans = keep(plan_repairs(faults, n), "plans")
    counts = fault_counts(faults).withColumnRenamed("conv_id", "c")
    audits = plans.join(counts, plans["conv_id"].eqNullSafe(F.col("c"))).drop("c")
    return audits.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"), apply_repairs(faults, plans, n)


#: DuckDB SQL for the digest of :func:`damage` and :func:`repair_conversations`: the costs from behind by recursion over the turns, then the letters from the front.
REPAIR_SQL = """
WITH RECURSIVE bytes AS (
  SELECT list(list_reduce(list_prepend(b, [1, 2, 3, 4, 5, 6, 7, 8]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crcs
  FROM (SELECT unnest(range(256)) AS b)
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint)) AS key
  FROM conversations
), dealt AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(key, lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS fate FROM keyed, bytes
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM dealt WHERE fate <> 0)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare,
         CASE left(role, 1) WHEN 's' THEN 's' WHEN 'u' THEN 'u' WHEN 'a' THEN 'a' ELSE 'x' END AS initial
  FROM damaged
), repeats AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM numbered
), faults AS (
  SELECT *, bare = '' AS blank, bare <> '' AND again AS duplicate, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
         initial || lead(initial) OVER (PARTITION BY conv_id ORDER BY i) NOT IN ('su', 'ua', 'au') AS illegal
  FROM repeats
), steps AS (
  SELECT conv_id, i, role, text, initial, blank OR duplicate AS gone, truncated::int AS extra FROM faults
), costs AS (
  SELECT conv_id, max(i) + 1 AS i, 0 AS e, 4 AS s, 2 AS u, 0 AS a FROM steps GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, least(e, 2 + u, 4 + a) AS e, least(s, 2 + u, 4 + a) AS s, least(u, 2 + a) AS u, least(a, 2 + u) AS a
  FROM (
    SELECT f.conv_id, f.i, least(3 + e, CASE WHEN gone THEN 9999 ELSE extra + least(2 + u, CASE initial WHEN 's' THEN s WHEN 'u' THEN u ELSE 9999 END) END) AS e,
           least(3 + s, CASE WHEN gone THEN 9999 ELSE extra + least(2 + u, CASE initial WHEN 'u' THEN u ELSE 9999 END) END) AS s,
           least(3 + u, CASE WHEN gone THEN 9999 ELSE extra + least(2 + a, CASE initial WHEN 'a' THEN a ELSE 9999 END) END) AS u,
           least(3 + a, CASE WHEN gone THEN 9999 ELSE extra + least(2 + u, CASE initial WHEN 'u' THEN u ELSE 9999 END) END) AS a
    FROM costs c JOIN steps f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = c.i - 1
  )
), trace AS (
  SELECT conv_id, 1::bigint AS i, 'e' AS q, '' AS audit, []::varchar[] AS lines, e AS cost, false AS done FROM costs WHERE i = 1
  UNION ALL
  SELECT conv_id, CASE WHEN letter IN ('', 'I') THEN i ELSE i + 1 END, CASE WHEN letter IN ('', 'D') THEN q WHEN letter = 'K' THEN initial ELSE put END, audit || letter,
         CASE letter WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'R' THEN list_append(lines, CASE put WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text)
                     WHEN 'I' THEN list_append(lines, CASE put WHEN 'u' THEN 'user:' ELSE 'assistant:' END) ELSE lines END, cost, letter = ''
  FROM (
    SELECT t.*, f.initial, f.role, f.text, CASE q WHEN 'u' THEN 'a' ELSE 'u' END AS put,
           CASE WHEN f.i IS NULL AND q IN ('e', 'a') THEN ''
                WHEN f.i IS NOT NULL AND 3 + CASE q WHEN 'e' THEN b.e WHEN 's' THEN b.s WHEN 'u' THEN b.u ELSE b.a END = now THEN 'D'
                WHEN 2 + CASE q WHEN 'u' THEN c.a ELSE c.u END = now THEN 'I'
                WHEN NOT gone AND (q IN ('e', 's', 'a') AND initial = 'u' AND extra + b.u = now OR q = 'u' AND initial = 'a' AND extra + b.a = now OR q = 'e' AND initial = 's' AND extra + b.s = now) THEN 'K'
                ELSE 'R' END AS letter
    FROM (SELECT *, CASE q WHEN 'e' THEN c0.e WHEN 's' THEN c0.s WHEN 'u' THEN c0.u ELSE c0.a END AS now FROM trace, LATERAL (SELECT x.e, x.s, x.u, x.a FROM costs x WHERE x.conv_id IS NOT DISTINCT FROM trace.conv_id AND x.i = trace.i) c0 WHERE NOT done) t
    JOIN costs c ON c.conv_id IS NOT DISTINCT FROM t.conv_id AND c.i = t.i
    LEFT JOIN steps f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.i = t.i
    LEFT JOIN costs b ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND b.i = t.i + 1
  )
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::bigint AS gaps, count(CASE WHEN blank THEN 1 END) AS blank, count(CASE WHEN duplicate THEN 1 END) AS duplicate,
         count(CASE WHEN truncated THEN 1 END) AS truncated, count(CASE WHEN illegal THEN 1 END) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0)::bigint AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN (SELECT * FROM trace WHERE done) t ON t.conv_id IS NOT DISTINCT FROM o.conv_id"""
