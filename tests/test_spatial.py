import random

import numpy as np
from pyspark.sql import functions as F

from orewright.operators import network, polygons, shapes, spatial


def test_suppressed_peaks_equal_one_by_one(spark):
    random.seed(4)
    peaks = [(random.randrange(40), random.randrange(40), float(random.randrange(12))) for _ in range(120)]
    peaks = list({(r, c): (r, c, z) for r, c, z in peaks}.values())
    kept = []
    for r, c, z in sorted(peaks, key=lambda p: (-p[2], p[0], p[1])):
        if all(abs(r - a) > 4 or abs(c - b) > 4 for a, b, _ in kept):
            kept.append((r, c, z))
    got = spatial.suppress_peaks(spark.createDataFrame(peaks, "row int, col int, z double"), 4).collect()
    assert sorted(map(tuple, got)) == sorted(kept)


def test_greedy_sites_on_the_worked_example(spark):
    """Total weight 58: two sites serve 50 of it, which is over 80 %, and three serve all."""
    weights = {1: 12.0, 2: 15.0, 3: 10.0, 4: 13.0, 5: 8.0}
    covers = {"7": [1, 2], "1": [3, 4], "2": [4, 5], "3": [5], "4": [1, 3]}
    reach = spark.createDataFrame([(int(s), d, 1.0) for s, own in covers.items() for d in own], "site long, demand long, cost double")
    demand = spark.createDataFrame(list(weights.items()), "demand long, weight double")
    assert [(r["site"], r["gain"]) for r in network.max_coverage(reach, demand, 2).orderBy("step").collect()] == [(7, 27.0), (1, 23.0)]
    costs = spark.createDataFrame([(int(s), 1.0) for s in covers], "site long, cost double")
    assert network.min_sites(reach, demand, costs, 0.8).count() == 2
    rows = network.min_sites(reach, demand, costs, 1.0).orderBy("step").collect()
    assert len(rows) == 3 and rows[-1]["served"] == 58.0
    chosen = spark.createDataFrame([(7, 1), (1, 2)], "site long, `order` int")
    assert {r["demand"]: r["site"] for r in network.assign(reach, chosen).collect()} == {1: 7, 2: 7, 3: 1, 4: 1}


def test_clustered_mesh_drops_what_collapses(spark):
    names = [f"{p}{c}" for p in "abc" for c in "xyz"]
    faces = spark.createDataFrame([(1, 0.1, 0.0, 0.0, 5.0, 0.0, 0.0, 0.0, 5.0, 0.0), (1, 0.2, 0.1, 0.0, 0.0, 5.1, 0.0, 5.2, 0.0, 0.0), (1, 0.1, 0.0, 0.0, 0.2, 0.1, 0.0, 5.0, 0.0, 0.0)], "model_id long, " + ", ".join(f"{n} double" for n in names))
    rows = spatial.cluster_mesh(faces, 1.0).collect()
    assert len(rows) == 1 and rows[0]["model_id"] == 1
    assert {round(rows[0][n], 2) for n in ("ax", "bx", "cx")} == {0.15, 5.1, 0.0}


def test_there_are_24_rotations():
    assert len(set(shapes.rotations())) == 24


def test_null_and_empty_inputs(spark):
    cells = spark.createDataFrame([(0, 0, None), (0, 1, 2.0)], "row int, col int, z double")
    assert [r["slope"] for r in spatial.slope_pct(cells, 1.0, 1.0).orderBy("col").collect()] == [None, None]
    assert spatial.focal(cells, "mean", 1).agg(F.max("focal")).first()[0] == 2.0
    none = spark.createDataFrame([], "id long, x double, y double")
    assert spatial.within_distance(none, none, 5.0).count() == 0


def test_shared_areas_of_turned_and_concave_polygons(spark):
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    diamond = np.array([(2, -1), (5, 2), (2, 5), (-1, 2)], float)  # its four corners stand out by a triangle of area 1 each
    notch = np.array([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)], float)
    assert polygons.common_area(square, square) == 16 and polygons.common_area(square, square + 10) == 0
    assert abs(polygons.common_area(square, diamond) - (18 - 4)) < 1e-9 and abs(polygons.common_area(diamond[::-1], square) - 14) < 1e-9
    assert abs(polygons.common_area(square, notch) - 10) < 1e-9
    rng = np.random.default_rng(3)
    for _ in range(10):  # against a count of points
        p, q = (np.column_stack([np.cos(t), np.sin(t)]) * rng.uniform(0.3, 1, (7, 1)) for t in (np.sort(rng.uniform(0, 2 * np.pi, 7)) for _ in range(2)))
        x, y = rng.uniform(-1, 1, (2, 40000))
        held = [np.sum([((a[1] > y) != (b[1] > y)) & (x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1] + (a[1] == b[1])) + a[0]) for a, b in zip(r, np.roll(r, -1, 0))], 0) % 2 == 1 for r in (p, q)]
        assert abs(polygons.common_area(p, q) - 4 * np.mean(held[0] & held[1])) < 0.03
    ring = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
    areas = spark.createDataFrame([(1, ring(notch)), (2, ring(diamond + 20))], f"id long, ring array<{polygons.POINT}>")
    row = areas.select("id", polygons.ring_area(F.col("ring")).alias("area"), polygons.middle_point(F.col("ring")).alias("m"), polygons.ring_distance(F.col("ring"), F.lit(2.0), F.lit(4.0)).alias("d"), polygons.segment_distance(F.col("ring"), F.lit(-1.0), F.lit(3.5), F.lit(5.0), F.lit(3.5)).alias("s")).orderBy("id").first()
    assert row["area"] == 10 and abs(row["d"] - 3 * 2 / np.sqrt(13)) < 1e-9 and row["s"] == 0 and row["m"]["y"] == 2.0
    extra = spark.createDataFrame([(7, ring(square)), (8, ring(diamond + 21))], f"id long, ring array<{polygons.POINT}>").withColumn("height", F.lit(9.0)).withColumn("estimated", F.lit(False))
    base = areas.withColumn("height", F.lit(3.0)).withColumn("estimated", F.col("id") == 1)
    assert {(r["id"], r["height"]) for r in spatial.conflate_fill(base, extra).collect()} == {(1, 9.0), (2, 3.0)}
    assert {r["id"] for r in spatial.conflate_prefer(base.withColumn("special", F.lit(True)), extra).collect()} == {1, 2, 7}  # the middle of 7 lies in the notch of 1
    parts = base.withColumn("part", F.lit(True)).drop("height", "estimated").unionByName(extra.withColumn("part", F.lit(False)).drop("height", "estimated"))
    assert {r["id"] for r in spatial.drop_covered_outlines(parts).collect()} == {1, 2}


def test_screening_reasons_have_values_and_limits(spark):
    rows = spark.createDataFrame([("P1", 9000.0, 2.0, 50.0, 0.0, "", "industrial"), ("P2", 9000.0, 15.0, 50.0, 0.0, "", "industrial"), ("P4", 9000.0, 2.0, 50.0, 50.0, "Zona inundable", "industrial"), ("P5", 9000.0, 2.0, 50.0, 0.0, "", "rustico"), ("P6", 400.0, None, 50.0, 0.0, "", "industrial")], "id string, area double, slope double, access double, share double, names string, zoning string")
    limits = {"min_area_m2": 5000, "max_slope_pct": 10, "max_access_distance_m": 100, "exclusion_max_overlap_pct": 10}
    got = {r["id"]: r for r in spatial.screen_parcels(rows, limits, (("zoning", "in", ["industrial"]),)).collect()}
    why = {k: {q["rule"]: q for q in r["reasons"]} for k, r in got.items()}
    assert got["P1"]["accepted"] and (why["P2"]["max_slope_pct"]["measured"], why["P2"]["max_slope_pct"]["threshold"], why["P2"]["max_slope_pct"]["unit"]) == ("15.0", "10", "%")
    assert "Zona inundable" in why["P4"]["exclusion_max_overlap_pct"]["detail"] and why["P5"]["attribute:zoning in"]["measured"] == "rustico" and why["P6"]["min_area_m2"]["measured"] == "400.0" and why["P6"]["max_slope_pct"]["measured"] is None
    lenient = {r["id"]: r for r in spatial.screen_parcels(rows, limits, unknown="accept").collect()}
    assert [q["rule"] for q in lenient["P6"]["reasons"]] == ["min_area_m2"] and lenient["P6"]["flags"] == ["max_slope_pct is unknown"] and lenient["P5"]["accepted"]


def test_locked_borders_stay(spark):
    names = [f"{p}{c}" for p in "abc" for c in "xyz"]
    grid = lambda i, j: (float(i), float(j), 0.0)
    faces = [(1, *grid(i, j), *grid(i + 1, j), *grid(i, j + 1)) for i in range(4) for j in range(4)] + [(1, *grid(i + 1, j), *grid(i + 1, j + 1), *grid(i, j + 1)) for i in range(4) for j in range(4)]
    table = spark.createDataFrame(faces, "model_id long, " + ", ".join(f"{n} double" for n in names))
    corners = lambda rows: {(r[f"{p}x"], r[f"{p}y"]) for r in rows for p in "abc"}
    border = {(float(i), float(j)) for i in range(5) for j in range(5) if i in (0, 4) or j in (0, 4)}
    assert not border <= corners(spatial.cluster_mesh(table, 2.0).collect())
    kept = corners(spatial.cluster_mesh(table, 2.0, lock=True).collect())
    assert border <= kept and len(kept) < 25


def test_lines_through_a_polygon(spark):
    ring = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 2.0, "y": 1.0}, {"x": 0.0, "y": 4.0}]
    lines = [((-1.0, 2.0, 5.0, 2.0), True), ((1.9, 3.0, 2.1, 3.0), False), ((0.0, 0.0, 4.0, 0.0), False), ((1.0, 0.5, 1.2, 0.6), True), ((-1.0, 4.0, 5.0, 4.0), False), ((2.0, 0.5, 2.0, 9.0), True)]
    rows = spark.createDataFrame([(ring, *line, want) for line, want in lines], f"ring array<{polygons.POINT}>, x0 double, y0 double, x1 double, y1 double, want boolean")
    got = rows.select("want", polygons.crosses_inside(F.col("ring"), *[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_union_of_turned_and_concave_rings(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    diamond = [(5.0, 0.0), (10.0, 5.0), (5.0, 10.0), (0.0, 5.0)]
    hook = [(0.0, 0.0), (10.0, 0.0), (10.0, 2.0), (2.0, 2.0), (2.0, 10.0), (0.0, 10.0)]
    far = [(900.0, 900.0), (901.0, 900.0), (901.0, 901.0)]
    rows = lambda rings: spark.createDataFrame([(i, [{"x": x + d, "y": y + d} for x, y in r]) for i, (r, d) in enumerate(rings)], "id long, ring array<struct<x: double, y: double>>")
    for at in (0.0, 495.0, -3.0):  # also across the squares' borders
        for rings, area in (([diamond], 50.0), ([hook], 36.0), ([diamond, hook], None), ([diamond, diamond, far], 50.0), ([square, hook, diamond], 100.0), ([far], 0.0)):
            got = spatial.overlap_share(rows([(square, at)]), rows([(r, at) for r in rings])).first()
            if rings == [diamond, hook]:
                # of the hook's two arms, each as two by ten, the diamond holds two trapezia of heights two
                area = 50 + 36 - shared(diamond, hook)
            assert abs(got["share"] - area / 100) < 1e-6, (at, rings)
    r = np.random.default_rng(1)
    from orewright.operators.polygons import union_area

    p = np.array(square)
    rings = [np.array([(x, y), (x + w, y + 1), (x + w - 1, y + h), (x - 1, y + h - 1)]) for x, y, w, h in r.uniform(0, 6, (40, 4)) + [0, 0, 1, 1]]
    whole = union_area(p, rings, (0, 0, 10, 10), most=10_000)
    assert abs(whole - union_area(p, rings, (0, 0, 10, 10), most=30)) < 1e-6
    dots = r.uniform(0, 10, (20_000, 2))

    def within(ring, q):
        a, b = ring, np.roll(ring, -1, 0)
        met = (a[:, None, 1] > q[None, :, 1]) != (b[:, None, 1] > q[None, :, 1])
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (b[:, None, 0] - a[:, None, 0]) * (q[None, :, 1] - a[:, None, 1]) / (b[:, None, 1] - a[:, None, 1]) + a[:, None, 0]
        return (met & (x > q[None, :, 0])).sum(0) % 2 == 1

    assert abs(whole / 100 - np.any([within(ring, dots) for ring in rings], 0).mean()) < 0.015


def shared(p, q):
    from orewright.operators.polygons import common_area

    return common_area(np.array(p), np.array(q))


def test_shape_similarity_equals_all_rotations(spark, monkeypatch):
    """pairs don't carry 24 turned copies of their voxels, and a pair asked twice isn't counted twice. Small and large models, copies, a moved and a turned one, and one without voxels."""
    random.seed(7)
    models = {k: {(random.randrange(-3, 1), random.randrange(5, 8), random.randrange(3)) for _ in range(4 + k)} for k in range(8)}
    models[8] = {(x + 40, y - 9, z) for x, y, z in models[3]}
    models[9] = {(y, -x, z) for x, y, z in models[5]}
    pairs = [(a, b) for a in models for b in models if a != b]

    def best(a, b):
        def placed(p, turn):
            at = [tuple(q[i] * s for i, s in turn) for q in p]
            low = [min(q[i] for q in at) for i in range(3)]
            return {tuple(q[i] - low[i] for i in range(3)) for q in at}

        still = placed(models[b], ((0, 1), (1, 1), (2, 1)))
        k = max(len(placed(models[a], turn) & still) for turn in shapes.rotations())
        return k / (len(models[a]) + len(models[b]) - k)

    voxels = spark.createDataFrame([(m, *q) for m, p in models.items() for q in p] + [(10, None, 1, 1)], "model_id long, vx int, vy int, vz int")
    want = {(a, b): round(best(a, b), 6) for a, b in pairs if best(a, b) >= 0.3}
    assert want[3, 8] == want[5, 9] == 1
    got = shapes.shape_similarity(voxels, spark.createDataFrame([*pairs, (0, 1), (5, 9), (10, 1), (1, 10), (77, 1)], "a long, b long"), 0.3)
    assert {(r["a"], r["b"]): r["score"] for r in got.collect()} == want and got.count() == len(want)
    # models too large for a table of all rotations are compared one rotation at a time
    codes = {m: np.sort(np.array([(x + 9) << 2 * shapes.BITS | (y + 9) << shapes.BITS | z for x, y, z in p])) for m, p in models.items()}
    tabled = [shapes._overlap(codes[a])(codes[b]) for a, b in pairs]
    monkeypatch.setattr(shapes, "TABLE", 6)
    assert [shapes._overlap(codes[a])(codes[b]) for a, b in pairs] == tabled
