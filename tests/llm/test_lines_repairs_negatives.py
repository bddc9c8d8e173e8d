"""Line dedup, conversation repair and hard negatives against plain Python, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import functools
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orewright.llm import line_dedup, negatives, queries, repairs
from orewright.plans.shared import materialize

BLANKS = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


# lines -------------------------------------------------------------------------------------------------------------

LONG = "A line that stands in Many documents, É and all of it counts"
DOCS = [(i, f"own {i}\n {LONG.upper() if i % 2 else LONG}\t\n{'x' * 39}\nlast\n") for i in range(1, 6)] + [
    (6, None), (7, ""), (8, "\n\n"), (None, LONG), (None, "none\n" + LONG), (9, (LONG + "\n") * 3000 + "z" * 50), (9, (LONG + "\n") * 3000 + "z" * 50), (9, "another text of nine\n" + LONG),
    (10, "z" * 50), (11, "z" * 50 + "\r"), (12, "Z" * 50), (13, "\x0b" + "z" * 50), (14, " é" * 25), (2, "second text of two\n" + LONG),
]


def brute_lines(docs, least=5):
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            key = lower(line.strip(BLANKS))
            if len(key) >= 40:
                holders[key].add((doc is not None, doc or 0))
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        keys = [lower(line.strip(BLANKS)) for line in lines]
        kept = [line for line, key in zip(lines, keys, strict=True) if not (len(holders.get(key, ())) >= least and max(holders[key]) != (doc is not None, doc or 0))]
        out.append((doc, text, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_equal_brute_force(spark):
    rows = [(d, t, "clash", i) for i, (d, t) in enumerate(DOCS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Kept string, other int").repartition(3)
    found = line_dedup.dedup_lines(docs)
    assert found.columns == ["doc_id", "text", "other", "n_lines", "n_dropped", "kept"]
    assert sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"], r["kept"]) for r in found.collect()), key=repr) == brute_lines(DOCS)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_lines_at_random_equal_brute_force(spark):
    r = random.Random(3)
    pool = [c * 40 + str(i) for i, c in enumerate("abcdefgh")] + ["short", "", " "]
    docs = [(i, "\n".join(r.choice(["", " ", "\t"]) + r.choice(pool) for _ in range(r.randrange(6)))) for i in range(60)]
    found = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), least_docs=20, keep=["doc_id", "text"])
    assert sorted((tuple(x) for x in found.collect()), key=repr) == brute_lines(docs, 20)


# conversations -----------------------------------------------------------------------------------------------------


def cheapest(rows):
    """Least cost, then ASCII-least letters, by trying all edits; rows: initial, must go, truncated. At most three turns are put in at a place."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @functools.cache
    def best(i, q, left):
        put = "a" if q == "u" else "u"
        ways = [(0, "")] if i == len(rows) and q in ("", "a") else []
        if left:
            c, a = best(i, put, left - 1)
            ways.append((c + 2, "I" + a))
        if i < len(rows):
            initial, gone, cut = rows[i]
            c, a = best(i + 1, q, 3)
            ways.append((c + 3, "D" + a))
            if not gone:
                c, a = best(i + 1, put, 3)
                ways.append((c + 2 + cut, "R" + a))
                if (q, initial) in after:
                    c, a = best(i + 1, after[q, initial], 3)
                    ways.append((c + cut, "K" + a))
        return min(ways, default=(10**9, ""))

    return best(0, "", 3)


def brute_repairs(conversations, damaged=True):
    groups = {c: [] for c, *_ in conversations}
    for conv, turn, role, text in conversations:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 19
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        groups[conv] += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1].encode(), r[2].encode()))
        turns = [t for t, *_ in rows if t is not None]
        counts, symbols, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set()
        for _, role, text in rows:
            bare = text.strip(BLANKS)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            counts[fault] = counts.get(fault, 0) + 1
            symbols.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
        cost, audit = cheapest(tuple(symbols))
        repaired, at, last = [], 0, ""
        for letter in audit:
            put = "assistant" if last == "u" else "user"
            turn = ("", "") if letter == "I" else rows[at][1:]
            at += letter != "I"
            if letter != "D":
                repaired.append((turn[0] if letter == "K" else put, turn[1]))
                last = repaired[-1][0][:1]
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return sorted(out, key=repr)


def test_edits_equal_trying_all():
    r = np.random.default_rng(5)
    talks = [r.integers(0, 9, r.integers(0, 12)) for _ in range(400)]
    cost, audits = repairs.cheapest_edits(np.concatenate(talks), [len(t) for t in talks])
    for talk, c, a in zip(talks, cost, audits.to_pylist(), strict=True):
        assert (c, a) == cheapest(tuple(("suax"[s % 4] if s < 8 else "u", s == 8, int(s // 4 == 1)) for s in talk.tolist()))
    # one long conversation costs what its turns cost one by one, whatever the blocks
    long = r.integers(0, 9, 5001)
    behind, total = repairs._AT_END, 0
    for s in long[::-1].tolist():
        behind = repairs._step(behind, s)
    cost, audits = repairs.cheapest_edits(long, [len(long)])
    assert cost[0] == behind[repairs.NOTHING] and sum(audits[0].as_py().count(x) for x in "KRD") == len(long)
    total = sum({"K": 0, "I": 2, "R": 2, "D": 3}[x] for x in audits[0].as_py())
    assert total <= cost[0]
    assert repairs.cheapest_edits(np.zeros(0, np.uint8), [])[1].to_pylist() == [] and repairs.cheapest_edits(np.zeros(0, np.uint8), [0])[1].to_pylist() == [""]


@pytest.fixture(scope="module")
def talks():
    r = random.Random(11)
    texts = ["Yes.", "No!", "", " \t", "cut off", "Why? ", "é…", None, "<|x|>.", "a\nb."]
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system", "tool", None, "", "u"]), r.choice(texts)) for c in range(60) for t in range(r.randrange(1, 12)) if r.random() < 0.9]
    rows += [(None, None, "user", "Hi."), (None, None, "user", "Hi."), (None, 3, "assistant", "Hello."), (100, None, "system", "S."), (100, 7, "user", "same"), (100, 7, "assistant", "x" * 30_000 + "."), (100, 7, "user", "same")]
    return rows + [(200, t, "user" if t % 2 == 0 else "assistant", f"Turn {t % 50}.") for t in range(3000)] + [(300, 0, "user", "")]


def test_repairs_equal_brute_force(spark, talks, tmp_path):
    import sys

    sys.setrecursionlimit(40_000)
    talks = [t for t in talks if t[0] != 200 or t[1] < 300]
    rows = spark.createDataFrame([(*t, "c") for t in talks], "conv_id long, turn long, role string, text string, symbol string").repartition(3)
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    found = queries.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_repairs(talks)


def test_repaired_turns_are_legal_and_reparable_for_free(spark, talks):
    rows = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).repartition(3)
    found, turns = repairs.repair_conversations(rows, materialize)
    assert found.where("conv_id = 200").first()["audit"].startswith("KKK")
    initials = defaultdict(str)
    for r in sorted(turns.collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"], r["position"])):
        assert r["position"] == len(initials[r["conv_id"]])
        initials[r["conv_id"]] += r["role"][:1]
    assert all(v.removeprefix("s") == "ua" * (len(v) // 2) for v in initials.values())
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string, n int")
    assert [x.count() for x in repairs.repair_conversations(none, materialize)] == [0, 0]


# negatives ---------------------------------------------------------------------------------------------------------


def brute_negatives(rows, anchors):
    out = []
    x = {i: np.array(v, object) for i, _, v in rows}
    label = {i: c for i, c, _ in rows}

    def score(a, b):
        n = min(len(x[a]), len(x[b]))
        return int(sum(x[a][:n] * x[b][:n])) if n else 0

    for a in anchors:
        scored = sorted((-score(a, b), b) for b in x if b != a)
        for p, own in [(-s, b) for s, b in scored if label[b] == label[a]][:5]:
            fit = [(-s, b) for s, b in scored if label[b] != label[a] and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(a, own, rank, b, p, s) for rank, (s, b) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    ready = negatives.comparable(df)
    return sorted(tuple(r) for r in negatives.mine_hard_negatives(ready, F.col("vec_id") % every == 0, materialize).collect()), ready


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TREE", 90)
    monkeypatch.setattr(negatives, "BLOCK", 7)
    monkeypatch.setattr(negatives, "HEADS", 3)
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 5))
    rows = [(i, int(r.integers(4)), (centres[i % 6] + 0.2 * r.normal(size=5)).tolist()) for i in range(400)]
    rows += [(400 + i, i % 2, [0.5, 0.25, 0.0, 0.0, 0.0]) for i in range(150)]  # ties of a third of all rows
    rows += [(600, 1, []), (601, 2, [0.3, -0.1]), (602, None, [1.0] * 5), (603, 1, None), (604, 1, [float("nan")] * 5), (605, 1, [1.0, None, 0.0, 0.0, 0.0]), (606, 1, [float("inf")] * 5), (None, 1, [1.0] * 5), (3, 9, [9.0] * 5), (3, *rows[3][1:])]
    found, ready = mined(spark, rows, 20)
    kept = [(x["vec_id"], x["label"], x["v"]) for x in ready.collect()]
    assert len(kept) == 552 and dict((i, c) for i, c, _ in kept)[3] == rows[3][1]
    assert found == brute_negatives(kept, [i for i, *_ in kept if i % 20 == 0]) and len(found) > 100


def test_negatives_of_odd_tables(spark):
    assert mined(spark, [], 5)[0] == []
    assert mined(spark, [(0, 1, [1.0])], 5)[0] == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])], 5)[0] == [(0, 1, 1, 2, 65536, 256 * 230)]
    assert mined(spark, [(0, 1, [0.0]), (1, 1, [0.0]), (2, 2, [0.0])], 5)[0] == [(0, 1, 1, 2, 0, 0)]
    with pytest.raises(Exception, match="2\\^53"):
        mined(spark, [(0, 1, [1e9]), (1, 1, [1e9]), (2, 2, [1e9])], 5)


def test_a_tree_skips_what_bounds_exclude():
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 16)) * 300
    x = np.floor(np.repeat(centres, 50, 0) + r.normal(size=(2000, 16))).astype(np.int64)
    ids = r.permutation(2000)
    tree = negatives.build_tree(ids, x)
    depth = tree["counts"][0]
    assert 10 <= depth and (tree["angles"] >= 0).all()
    q = x[:25]
    scores = q @ x.T
    owner, low, high = np.arange(25), np.full(25, -np.inf), np.full(25, np.inf)
    high[10:] = 0.8 * scores.max(1)[10:]
    got = negatives.search(tree, q, owner, low, high, 4, np.full(25, -1))
    for k in range(25):
        want = sorted((-s, i) for s, i in zip(scores[k].tolist(), ids.tolist(), strict=True) if s <= high[k])[:4]
        assert [(-s, i) for i, s in zip(got[1][got[0] == k].tolist(), got[2][got[0] == k].tolist(), strict=True)] == want
    # bounds hold for all that a node covers
    upper, lower = negatives._bounds(q, negatives.lengths(q), tree["x"][tree["middles"]], tree["norm"], tree["angles"])
    for node, (a, b) in enumerate(zip(tree["starts"], tree["stops"], strict=True)):
        if not tree["counts"][node]:
            own = q @ tree["x"][a:b].T
            assert (own.max(1) <= upper[:, node]).all() and (own.min(1) >= lower[:, node]).all()
