"""The nearest vectors against a plain comparison of all, for spread, clustered and odd vectors."""

import numpy as np

from orewright.operators import vectors


def frame(spark, v, start=0):
    return spark.createDataFrame([(start + i, None if x is None else [float(y) for y in x]) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)


def brute(v, queries, k, least=-1.0):
    u = np.array(v, float)
    u = u / np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    s = np.round(u[queries] @ u.T, 9) + 0.0
    out = set()
    for row, q in zip(s, queries, strict=True):
        best = sorted((-x, i) for i, x in enumerate(row) if i != q and x >= least)[:k]
        out |= {(q, i, -x, n) for n, (x, i) in enumerate(best, 1)}
    return out


def test_pruned_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SAMPLE", 100)
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 6))
    clustered = np.concatenate([centres[i % 12] + 0.02 * r.normal(size=6) for i in range(360)]).reshape(-1, 6)
    for v in (r.normal(size=(300, 6)), np.concatenate([clustered, np.zeros((3, 6)), np.tile(centres[0], (100, 1))])):
        df, queries = frame(spark, v), list(range(0, len(v), 20))
        asked = df.where("id % 20 = 0")
        for k, least in ((5, -1.0), (40, 0.5)):
            got = {(x["query"], x["id"], round(x["score"], 9), x["rank"]) for x in vectors.vector_topk(df, asked, k, least, query_block=7, corpus_block=50).collect()}
            assert got == brute(v, queries, k, least)
    assert vectors.pairs_seen(frame(spark, clustered), frame(spark, clustered).where("id % 20 = 0"), 5) < 0.25
    zero = frame(spark, [[0.0, 0.0], [0.0, 0.0], None])
    assert {tuple(x) for x in vectors.vector_topk(zero, zero, 2).collect()} == {(0, 1, 0.0, 1), (1, 0, 0.0, 1)}
    assert vectors.vector_topk(zero.where("id > 5"), zero, 2).count() == 0
