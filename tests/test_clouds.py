"""Nearest points, order statistics and their summary against numpy, near, far, dense and odd."""

import numpy as np
import pytest

from orewright.operators import clouds
from orewright.plans.ranks import percentile
from orewright.plans.shared import materialize, scratch

SCHEMA = "id long, x double, y double, z double"


def frame(spark, points, start=0):
    return spark.createDataFrame([(start + i, *map(float, p)) for i, p in enumerate(points)], SCHEMA).repartition(3)


def brute(a, b):
    d = np.sqrt(((np.asarray(a, float)[:, None] - np.asarray(b, float)[None]) ** 2).sum(2))
    return d.min(1)


def test_nearest_of_sparse_far_and_dense_clouds(spark, monkeypatch):
    monkeypatch.setattr(clouds, "FEW", 8)
    r = np.random.default_rng(3)
    dense = np.concatenate([r.normal(size=(200, 3)) * 0.01, r.normal(size=(150, 3)) + [1e4, 0, 0], [[5.0, 5, 5]] * 60])
    for a, b in (([(0, 0, 0)], [(100, 0, 0)]), (r.normal(size=(120, 3)), r.normal(size=(300, 3)) + [500, -800, 20]), (dense, r.normal(size=(90, 3)) * [3000, 1, 1])):
        found = clouds.nearest_points(frame(spark, a), frame(spark, b, 10_000)).collect()
        want = dict(zip(map(tuple, np.asarray(a, float).tolist()), brute(a, b), strict=True))
        assert len(found) == len(want)
        for x in found:
            assert x["d"] == pytest.approx(want[x["x"], x["y"], x["z"]], rel=1e-12)
            assert np.sqrt(((np.asarray(b[x["nearest"] - 10_000], float) - [x["x"], x["y"], x["z"]]) ** 2).sum()) == pytest.approx(x["d"], rel=1e-12)


def test_deviation_has_no_reach(spark):
    two = clouds.cloud_deviation(frame(spark, [(0, 0, 0)]), frame(spark, [(100, 0, 0)]), 1.0).collect()
    assert [tuple(x) for x in two] == [(way, 1, 100.0, 100.0, 100.0, 100.0, 1, 1.0) for way in ("a to b", "b to a")]
    r = np.random.default_rng(4)
    a, b = np.concatenate([r.normal(size=(70, 3)), [[0.0, 0, 0]] * 30]), r.normal(size=(40, 3)) * 2
    odd = spark.createDataFrame([(900, None, 0.0, 0.0), (901, float("nan"), 0.0, 0.0), (902, float("inf"), 0.0, 0.0)], SCHEMA)
    stats = {x["way"]: x for x in clouds.cloud_deviation(frame(spark, a).unionAll(odd), frame(spark, b), 0.7).collect()}
    for way, d in (("a to b", brute(a, b)), ("b to a", brute(b, a))):
        x = stats[way]
        assert (x["n"], x["over"]) == (len(d), (d > 0.7).sum())
        assert [x["high"], x["mean"], x["rms"], x["p95"], x["share"]] == pytest.approx([d.max(), d.mean(), np.sqrt((d * d).mean()), np.percentile(d, 95), (d > 0.7).mean()], abs=2e-6)
    worst = [x for x in clouds.worst_points(frame(spark, a), frame(spark, b), 0.7).collect() if x["way"] == "a to b"]
    d = brute(a, b)
    assert [x["id"] for x in sorted(worst, key=lambda x: x["rank"])] == [i for i in np.argsort(-np.round(d, 12), kind="stable")[:8] if d[i] > 0.7]
    empty = clouds.cloud_deviation(frame(spark, a), spark.createDataFrame([], SCHEMA), 1.0).collect()
    assert [(x["n"], x["high"], x["p95"], x["share"]) for x in empty] == [(0, None, None, None)] * 2


def test_percentile_of_ties_and_nulls(spark):
    r = np.random.default_rng(5)
    v = np.concatenate([np.full(500, 2.5), r.normal(size=400), [7.0]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)] * 5, "v double").repartition(5)
    with scratch(spark, "t") as own:
        for share in (0, 0.05, 0.5, 0.95, 1):
            assert percentile(df, "v", share, own) == pytest.approx(np.percentile(v, 100 * share), abs=1e-12)
        assert percentile(df.limit(0), "v", 0.5, own) is None


def test_points_meet_their_best_cell_first(spark, monkeypatch):
    """each point used to meet all points of some twenty cells; now it meets rows of cells, also where the deepest cells hold more than a few points."""
    monkeypatch.setattr(clouds, "FEW", 8)
    monkeypatch.setattr(clouds, "LEVELS", 2)
    monkeypatch.setattr(clouds, "PARTS", 3)
    kept, keep = {}, clouds.Scratch.keep
    monkeypatch.setattr(clouds.Scratch, "keep", lambda self, df, name: kept.setdefault(name, keep(self, df, name)))
    monkeypatch.setattr(clouds, "materialize", lambda df, name: kept.update(sizes=[r[0] for r in kept["others"].selectExpr("size(p)").collect()]) or materialize(df, name))
    r = np.random.default_rng(5)
    a, b = np.round(r.normal(size=(150, 3)), 1), np.round(r.normal(size=(200, 3)), 1)
    with scratch(spark, "test") as own:
        trees = clouds._both_trees(frame(spark, a), frame(spark, b, 10_000), own)
        monkeypatch.setattr(clouds.Scratch, "keep", lambda self, df, name: kept.__setitem__(name, keep(self, df, name)) or kept[name])
        found = clouds._descend(*trees, own).collect()
    d = {tuple(p): sorted((float(np.sqrt(((p - q) ** 2).sum())), 10_000 + i) for i, q in enumerate(b)) for p in a}
    assert len(found) == len(d) and all(abs(x["d"] - d[x["x"], x["y"], x["z"]][0][0]) < 1e-12 for x in found)
    assert max(kept["sizes"]) > 8 and sum(kept["sizes"]) == len({tuple(p) for p in b})
