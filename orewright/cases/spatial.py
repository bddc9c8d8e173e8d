from pyspark.sql import functions as F

from orewright.cases import case
from orewright.operators import clouds
from orewright.operators import network as n
from orewright.operators import polygons as poly
from orewright.operators import spatial as s

GRAD = """g AS (SELECT row, col, z, class, CASE WHEN col = 0 THEN (lead(z) OVER h - z) / 10 WHEN col = (SELECT max(col) FROM cells) THEN (z - lag(z) OVER h) / 10 ELSE (lead(z) OVER h - lag(z) OVER h) / 20 END AS gx, CASE WHEN row = 0 THEN (lead(z) OVER v - z) / 10 WHEN row = 24 THEN (z - lag(z) OVER v) / 10 ELSE (lead(z) OVER v - lag(z) OVER v) / 20 END AS gy
 FROM cells WINDOW h AS (PARTITION BY row ORDER BY col), v AS (PARTITION BY col ORDER BY row))"""
case("w02_slope_pct", lambda v: s.slope_pct(v.cells, 10.0, 10.0).select("row", "col", F.round("slope", 6).alias("slope")), f"WITH {GRAD} SELECT row, col, round(100 * sqrt(gx * gx + gy * gy), 6) AS slope FROM g")


def near(stat, r):
    return f"SELECT a.row, a.col, a.z, {stat} FROM cells a, range({-r}, {r} + 1) i(i), range({-r}, {r} + 1) j(j) LEFT JOIN cells b ON b.row = a.row + i.i AND b.col = a.col + j.j GROUP BY a.row, a.col, a.z"


case("w03_focal", lambda v: s.focal(s.focal(v.cells, "mean", 2, "mean"), "max", 2, "high").select("row", "col", F.round("mean", 6).alias("mean"), "high"), f"SELECT row, col, mean, high FROM ({near('round(avg(b.z), 6) AS mean, max(b.z) AS high', 2)})")
case("w03_height_above_ground", lambda v: s.height_above_ground(v.cells, 2).select("row", "col", F.round("height", 6).alias("height")),
     f"WITH low AS ({near('min(b.z) AS low', 2)}) SELECT a.row, a.col, round(a.z - avg(b.low), 6) AS height FROM low a, range(-2, 3) i(i), range(-2, 3) j(j) JOIN low b ON b.row = a.row + i.i AND b.col = a.col + j.j GROUP BY a.row, a.col, a.z")
case("w04_local_peaks", lambda v: s.local_peaks(v.cells, 1, 20.0), f"SELECT row, col, z FROM ({near('max(b.z) AS top', 1)}) WHERE z = top AND z >= 20")
case("w05_suppress_peaks", lambda v: s.suppress_peaks(s.local_peaks(v.cells, 1, 5.0), 3),
     f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY z DESC, row, col) AS k FROM ({near('max(b.z) AS top', 1)}) WHERE z = top AND z >= 5), 
     nb AS (SELECT a.k AS k, list(b.k) AS above FROM p a JOIN p b ON b.k < a.k AND abs(a.row - b.row) <= 3 AND abs(a.col - b.col) <= 3 GROUP BY a.k),
     -- in order of height, a peak stays unless one that stays is near it
     o AS (SELECT list({{'k': p.k, 'above': coalesce(nb.above, []), 'kept': CAST([] AS BIGINT[])}} ORDER BY p.k) AS l FROM p LEFT JOIN nb ON nb.k = p.k),
     w AS (SELECT list_reduce(l, lambda s, x: {{'k': x.k, 'above': x.above, 'kept': CASE WHEN list_has_any(x.above, s.kept) THEN s.kept ELSE list_append(s.kept, x.k) END}}, {{'k': CAST(0 AS BIGINT), 'above': CAST([] AS BIGINT[]), 'kept': CAST([] AS BIGINT[])}}).kept AS kept FROM o)
     SELECT row, col, z FROM p WHERE k IN (SELECT unnest(kept) FROM w)""")
case("w06_terrain_mask", lambda v: s.terrain_mask(v.cells, 10.0, 10.0, 40.0).groupBy("band").agg(F.count("*").alias("n")),
     f"WITH {GRAD} SELECT CASE WHEN z IS NULL OR sqrt(gx * gx + gy * gy) IS NULL THEN NULL WHEN 100 * sqrt(gx * gx + gy * gy) > 60 THEN 'rock' WHEN z >= 40 THEN 'snow' WHEN z >= 36 THEN 'mixed' ELSE 'low' END AS band, count(*) AS n FROM g GROUP BY 1")
case("w06_snow_mask", lambda v: s.snow_mask(v.cells, 10.0, 42.0, 40.0).select("row", "col", "snow"),
     f"""WITH {GRAD}, e AS (SELECT max(z) AS hi, greatest(60, 0.35 * (max(z) - 40)) AS wide FROM cells), k AS (SELECT *, sqrt(gx * gx + gy * gy) AS fall FROM g) SELECT row, col, CASE WHEN z IS NULL OR fall IS NULL THEN NULL ELSE hi > 40 AND ((z >= 40 AND degrees(atan(fall)) < 40) OR (z >= 40 - wide AND z < 40 AND gy > 0.15 * fall + 0.02 AND degrees(atan(fall)) < 35)) END AS snow FROM k, e""")
case("a09_class_area", lambda v: s.class_area(v.cells, 0.001, 42.0).withColumn("m2", F.round("m2", 3)), "SELECT class, count(*) AS cells, round(sum(111.32e0 * 111.32e0 * cos(radians(42.0e0 - row * 0.001e0))), 3) AS m2 FROM cells GROUP BY class")
TWO = "SELECT row, col, z, 1 AS priority FROM cells WHERE col < 15 UNION ALL SELECT row, col, z + CASE WHEN (row + col) % 3 = 0 THEN 2 ELSE -2 END, 2 FROM cells WHERE col >= 10"
case("a11_mosaic", lambda v: s.mosaic(v.sql(TWO)), f"SELECT row, col, max(z) AS z FROM ({TWO}) GROUP BY row, col")
case("a11_mosaic_priority", lambda v: s.mosaic(v.sql(TWO), "priority"), f"SELECT row, col, arg_max(z, priority) FILTER (z IS NOT NULL) AS z FROM ({TWO}) GROUP BY row, col")
POINTS = "SELECT p_partkey AS id, (p_partkey * 37 % 2400) / 10.0e0 + 240 * floor(p_partkey / 200) AS x, (p_partkey * 53 % 2500) / 10.0e0 AS y FROM part"
case("j22_sample_grid", lambda v: s.sample_grid(v.sql(POINTS), v.cells, 10.0).select("id", F.round("z", 6).alias("z")),
     f"""WITH p AS (SELECT id, y / 10 - floor(y / 10) AS fy, x / 10 - floor(x / 10) AS fx, CAST(floor(y / 10) AS INT) AS r, CAST(floor(x / 10) AS INT) AS c FROM ({POINTS})), k AS (SELECT id, r + a AS row, c + b AS col, (CASE WHEN a = 1 THEN fy ELSE 1 - fy END) * (CASE WHEN b = 1 THEN fx ELSE 1 - fx END) AS w FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(a, b))
     SELECT id, round(CASE WHEN count_if(z IS NULL) > 0 THEN 0 ELSE sum(w * z) END, 6) AS z FROM k LEFT JOIN cells USING (row, col) WHERE w > 0 GROUP BY id""")
COARSE = "SELECT row, col, CASE WHEN row % 7 = 3 THEN NULL ELSE coalesce(z, 5) + 1 END AS z FROM cells"
case("j22_sample_with_fallback", lambda v: s.sample_grid(v.sql(POINTS), v.cells, 10.0, v.sql(COARSE)).select("id", F.round("z", 6).alias("z")),
     f"""WITH p AS (SELECT id, y / 10 - floor(y / 10) AS fy, x / 10 - floor(x / 10) AS fx, CAST(floor(y / 10) AS INT) AS r, CAST(floor(x / 10) AS INT) AS c FROM ({POINTS})), k AS (SELECT id, r + a AS row, c + b AS col, (CASE WHEN a = 1 THEN fy ELSE 1 - fy END) * (CASE WHEN b = 1 THEN fx ELSE 1 - fx END) AS w FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(a, b)),
     g AS (SELECT id, CASE WHEN count_if(f.z IS NULL) = 0 THEN sum(w * f.z) END AS fine, CASE WHEN count_if(o.z IS NULL) = 0 THEN sum(w * o.z) END AS coarse FROM k LEFT JOIN cells f USING (row, col) LEFT JOIN ({COARSE}) o USING (row, col) WHERE w > 0 GROUP BY id) SELECT id, round(coalesce(fine, coarse, 0), 6) AS z FROM g""")
case("a07_zonal_stats", lambda v: s.zonal_stats(v.parcels, v.cells, 100.0).select("id", "n", "high", F.round("mean", 6).alias("mean"), F.round("p90", 6).alias("p90"), "reason"),
     """WITH i AS (SELECT p.id, count(z) AS n, max(z) AS high, round(avg(z), 6) AS mean, round(quantile_cont(z, 0.9), 6) AS p90 FROM parcels p JOIN cells c ON c.row * 100 BETWEEN y0 AND y1 AND c.col * 100 BETWEEN x0 AND x1 AND z IS NOT NULL GROUP BY p.id), o AS (SELECT p.id, z FROM parcels p JOIN cells c ON c.row = round((y0 + y1) / 200) AND c.col = round((x0 + x1) / 200) WHERE z IS NOT NULL)
     SELECT p.id, coalesce(n, CASE WHEN z IS NULL THEN 0 ELSE 1 END) AS n, coalesce(high, z) AS high, coalesce(mean, z) AS mean, coalesce(p90, z) AS p90, CASE WHEN n IS NULL AND z IS NULL THEN 'no data' END AS reason FROM parcels p LEFT JOIN i USING (id) LEFT JOIN o USING (id)""")
case("j09_reach_straight", lambda v: s.within_distance(v.geo_candidates, v.geo_demand, 600.0).withColumn("distance", F.round("distance", 6)),
     "SELECT a.id AS a, b.id AS b, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), 6) AS distance FROM geo_candidates a JOIN geo_demand b ON sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 600")
case("j10_snap_points", lambda v: s.snap_points(v.geo_demand, v.geo_nodes, 40.0).select("id", "node", F.round("access", 6).alias("access")),
     "WITH d AS (SELECT p.id, node, round(sqrt(power(p.x - g.x, 2) + power(p.y - g.y, 2)), 9) AS d FROM geo_demand p JOIN geo_nodes g ON sqrt(power(p.x - g.x, 2) + power(p.y - g.y, 2)) <= 40), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, node) AS k FROM d) SELECT p.id, node, round(d, 6) AS access FROM geo_demand p LEFT JOIN r ON r.id = p.id AND k = 1")
case("j11_points_in_polygons", lambda v: s.points_in_polygons(v.sql("SELECT c_custkey AS id, (c_custkey * 41 % 2300) + 0.5e0 AS x, (c_custkey * 59 % 2300) + 0.25e0 AS y FROM customer"), v.parcels.select("id", F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y0").alias("y")), F.struct(((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("y1").alias("y"))).alias("ring"))),
     """WITH p AS (SELECT c_custkey AS point, (c_custkey * 41 % 2300) + 0.5e0 AS x, (c_custkey * 59 % 2300) + 0.25e0 AS y FROM customer) SELECT point, id AS polygon FROM p JOIN parcels ON y > y0 AND y < y1 AND abs(x - (x0 + x1) / 2) < (x1 - x0) / 2 * (y1 - y) / (y1 - y0)""")
SEGMENTS = "SELECT row_number() OVER (ORDER BY l.a, l.b) AS id, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1 FROM geo_lines l JOIN geo_nodes p ON p.node = l.a JOIN geo_nodes q ON q.node = l.b"
case("j12_nearest_segment", lambda v: s.nearest_segment(v.sql("SELECT id, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM parcels"), v.sql(SEGMENTS), 400.0),
     f"""WITH s AS ({SEGMENTS}), p AS (SELECT id AS pid, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM parcels), d AS (SELECT pid, id, round(sqrt(power(greatest(least(x0, x1) - x, 0, x - greatest(x0, x1)), 2) + power(greatest(least(y0, y1) - y, 0, y - greatest(y0, y1)), 2)), 6) AS distance FROM p, s),
     r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY distance, id) AS k FROM d WHERE distance <= 400) SELECT p.pid AS id, r.id AS segment, distance FROM p LEFT JOIN r ON r.pid = p.pid AND k = 1""")
case("j12_segment_of_polygons", lambda v: s.nearest_segment(v.parcels.select("id", poly.box_ring().alias("ring")), v.sql(SEGMENTS), 400.0),
     f"""WITH s AS ({SEGMENTS}), d AS (SELECT p.id AS pid, s.id, round(sqrt(power(greatest(least(s.x0, s.x1) - p.x1, 0, p.x0 - greatest(s.x0, s.x1)), 2) + power(greatest(least(s.y0, s.y1) - p.y1, 0, p.y0 - greatest(s.y0, s.y1)), 2)), 6) AS distance FROM parcels p, s),
     r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY distance, id) AS k FROM d WHERE distance <= 400) SELECT p.id, r.id AS segment, distance FROM parcels p LEFT JOIN r ON r.pid = p.id AND k = 1""")
#: Restricted areas that reach into their neighbours to the east.
WIDER = "SELECT id, x0, y0, x1 + 200 AS x1, y1 FROM restricted"
case("j13_overlap_share", lambda v: s.overlap_share(v.parcels, v.sql(WIDER)),
     f"""WITH q AS (SELECT p.id, r.id AS rid, r.y0 AS band, greatest(p.x0, r.x0) AS x0, greatest(p.y0, r.y0) AS y0, least(p.x1, r.x1) AS x1, least(p.y1, r.y1) AS y1 FROM parcels p JOIN ({WIDER}) r ON least(p.x1, r.x1) > greatest(p.x0, r.x0) AND least(p.y1, r.y1) > greatest(p.y0, r.y0)),
     e AS (SELECT *, max(x1) OVER (PARTITION BY id, band ORDER BY x0, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM q), c AS (SELECT id, sum((x1 - greatest(x0, coalesce(reached, x0))) * (y1 - y0)) AS covered FROM e WHERE reached IS NULL OR x1 > reached GROUP BY id),
     m AS (SELECT id, string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid) AS names FROM q GROUP BY id) SELECT p.id, round(coalesce(covered, 0) / ((x1 - x0) * (y1 - y0)), 6) AS share, coalesce(names, '') AS names FROM parcels p LEFT JOIN c USING (id) LEFT JOIN m USING (id)""")
AREA = "(least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))"
MEET = "least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)"
case("j14_overlay_stat", lambda v: s.overlay_stat(v.parcels, v.restricted.withColumn("value", (F.col("id") % 20).cast("double"))),
     f"""WITH o AS (SELECT a.id, {AREA} AS area, CAST(b.id % 20 AS DOUBLE) AS value FROM parcels a JOIN restricted b ON {MEET}), g AS (SELECT id, sum(area * value) / sum(area) AS mean, max(value) AS high, sum(area) AS area FROM o GROUP BY id)
     SELECT p.id, round(mean, 6) AS mean, high, round(coalesce(area, 0) / ((x1 - x0) * (y1 - y0)), 6) AS cover, CASE WHEN coalesce(area, 0) / ((x1 - x0) * (y1 - y0)) < 0.99e0 THEN 'partly covered' END AS note FROM parcels p LEFT JOIN g USING (id)""")


def triangles(v):
    """The lower left half of each parcel."""
    corner = lambda a, b: F.struct(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    return v.parcels.select("id", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x0", "y1")).alias("ring"))


#: What a right triangle of legs 1 has left of u and below v.
PIECE = lambda u, v: f"CASE WHEN {u} <= 0 OR {v} <= 0 THEN 0 WHEN least({u}, 1) + least({v}, 1) <= 1 THEN least({u}, 1) * least({v}, 1) ELSE least({v}, 1) * (1 - least({v}, 1)) + (power(least({v}, 1), 2) - power(1 - least({u}, 1), 2)) / 2 END"
CUT = " ".join(f"{sign} {PIECE(f'((b.x{i} - a.x0) / (a.x1 - a.x0))', f'((b.y{j} - a.y0) / (a.y1 - a.y0))')}" for sign, i, j in (("+", 1, 1), ("-", 0, 1), ("-", 1, 0), ("+", 0, 0)))
HALF = f"o AS (SELECT a.id, b.id AS rid, ({CUT}) * (a.x1 - a.x0) * (a.y1 - a.y0) AS area, CAST(b.id % 20 AS DOUBLE) AS value FROM parcels a JOIN restricted b ON {MEET})"
case("j14_overlay_polygons", lambda v: s.overlay_stat(triangles(v), v.restricted.withColumn("value", (F.col("id") % 20).cast("double"))).select("id", F.round("mean", 4).alias("mean"), "high", F.round("cover", 4).alias("cover")),
     f"WITH {HALF}, g AS (SELECT id, sum(area * value) / sum(area) AS mean, max(value) AS high, sum(area) AS area FROM o WHERE area > 1e-9 GROUP BY id) SELECT p.id, round(mean, 4) AS mean, high, round(coalesce(area, 0) * 2 / ((x1 - x0) * (y1 - y0)), 4) AS cover FROM parcels p LEFT JOIN g USING (id)")
case("j13_share_of_polygons", lambda v: s.overlap_share(triangles(v), v.restricted),
     f"""WITH {HALF}, q AS (SELECT * FROM o WHERE area > 1e-9), c AS (SELECT id, sum(area) AS covered FROM q GROUP BY id), m AS (SELECT id, string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid) AS names FROM q GROUP BY id)
     SELECT p.id, round(coalesce(covered, 0) * 2 / ((x1 - x0) * (y1 - y0)), 6) AS share, coalesce(names, '') AS names FROM parcels p LEFT JOIN c USING (id) LEFT JOIN m USING (id)""")
case("a07_zonal_polygons", lambda v: s.zonal_stats(triangles(v), v.cells, 10.0).where("n > 1").select("id", "n", "high", F.round("mean", 6).alias("mean"), F.round("p90", 6).alias("p90")),
     """WITH i AS (SELECT p.id, count(z) AS n, max(z) AS high, round(avg(z), 6) AS mean, round(quantile_cont(z, 0.9), 6) AS p90 FROM parcels p JOIN cells c ON c.row * 10 >= y0 AND c.col * 10 >= x0 AND (c.col * 10 - x0) / (x1 - x0) + (c.row * 10 - y0) / (y1 - y0) < 1 AND z IS NOT NULL GROUP BY p.id) SELECT * FROM i WHERE n > 1""")
BASE = "SELECT id, x0, y0, x1, y1, 3.0e0 + id % 9 AS height, id % 4 = 0 AS estimated FROM parcels WHERE id % 2 = 0"
EXTRA = "SELECT id, x0 + 5 AS x0, y0 AS y0, x1 + 5 AS x1, y1 AS y1, CASE WHEN id % 5 = 0 THEN NULL ELSE 10.0e0 + id % 7 END AS height, false AS estimated FROM parcels WHERE id % 2 = 1"
case("j15_conflate_fill", lambda v: s.conflate_fill(v.sql(BASE), v.sql(EXTRA)),
     f"""WITH ba AS ({BASE}), ex AS ({EXTRA}), o AS (SELECT a.id AS e, b.id AS b, {AREA} AS area, a.height AS h, (a.x1 - a.x0) * (a.y1 - a.y0) AS whole FROM ex a JOIN ba b ON {MEET}), u AS (SELECT e FROM o GROUP BY e HAVING sum(area) >= any_value(whole) / 3),
     k AS (SELECT b, h, row_number() OVER (PARTITION BY b ORDER BY area DESC, e) AS k FROM o WHERE h IS NOT NULL) SELECT id, CASE WHEN estimated AND h IS NOT NULL THEN h ELSE height END AS height, estimated AND h IS NULL AS estimated, 'base' AS origin FROM ba LEFT JOIN k ON k.b = ba.id AND k.k = 1
     UNION ALL SELECT id, height, estimated, 'extra' FROM ex WHERE id NOT IN (SELECT e FROM u)""")
CLOUD = "SELECT col * 25 + row AS id, col * 1.0e0 AS x, row * 1.0e0 AS y, z{0} AS z FROM cells WHERE z IS NOT NULL"
OTHER_CLOUD = CLOUD.format(" + CASE WHEN row = 3 AND col = 4 THEN 30.5e0 ELSE 0.1e0 END")
NEAREST = f"""a AS ({CLOUD.format("")}), b AS ({OTHER_CLOUD}), pr AS (SELECT a.id AS a, b.id AS b, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) AS d FROM a, b),
 n AS (SELECT 'a to b' AS way, a AS id, min(struct_pack(d := d, b := b)) AS m FROM pr GROUP BY a UNION ALL SELECT 'b to a', b, min(struct_pack(d := d, b := a)) FROM pr GROUP BY b), near AS (SELECT way, id, m.d AS d, m.b AS nearest FROM n)"""
case("j24_cloud_deviation", lambda v: clouds.cloud_deviation(v.sql(CLOUD.format("")), v.sql(OTHER_CLOUD), 0.5),
     f"""WITH {NEAREST} SELECT way, count(*) AS n, round(max(d), 6) AS high, round(avg(d), 6) AS mean, round(sqrt(avg(d * d)), 6) AS rms, round(quantile_cont(d, 0.95), 6) AS p95, count_if(d > 0.5) AS "over", count_if(d > 0.5) / count(*) AS share FROM near GROUP BY way""")
case("j24_worst_points", lambda v: clouds.worst_points(v.sql(CLOUD.format("")), v.sql(OTHER_CLOUD), 0.05),
     f"""WITH {NEAREST} SELECT way, CAST(row_number() OVER (PARTITION BY way ORDER BY d DESC, id) AS INT) AS rank, id, nearest, round(d, 6) AS d FROM near WHERE d > 0.05 QUALIFY row_number() OVER (PARTITION BY way ORDER BY d DESC, id) <= 8""")
LONLAT = "SELECT c_custkey AS id, -4.7e0 + (c_custkey % 101) * 0.001e0 AS lon, 41.6e0 + (c_custkey % 97) * 0.001e0 AS lat FROM customer"
case("g11_project_local", lambda v: s.project_local(v.sql(LONLAT), -4.7, 41.6).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y")),
     f"""WITH k AS (SELECT 6378137.0e0 AS a, (1 / 298.257223563e0) * (2 - 1 / 298.257223563e0) AS e2, sin(radians(41.6e0)) AS s) SELECT id, round(radians(lon + 4.7e0) * a / sqrt(1 - e2 * s * s) * cos(radians(41.6e0)), 4) AS x, round(radians(lat - 41.6e0) * a * (1 - e2) / power(1 - e2 * s * s, 1.5e0), 4) AS y FROM ({LONLAT}), k""")
case("g11_tile_keys", lambda v: s.tile_keys(v.sql(LONLAT), 14).groupBy("tx", "ty").agg(F.count("*").alias("n"), F.min("quadkey").substr(1, 3).alias("head")),
     f"WITH t AS (SELECT CAST(floor((lon + 180) / 360 * 16384) AS BIGINT) AS tx, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384) AS BIGINT) AS ty FROM ({LONLAT})) SELECT tx, ty, count(*) AS n, any_value(concat(((tx >> 13) & 1) + 2 * ((ty >> 13) & 1), ((tx >> 12) & 1) + 2 * ((ty >> 12) & 1), ((tx >> 11) & 1) + 2 * ((ty >> 11) & 1))) AS head FROM t GROUP BY tx, ty")
case("g11_mercator", lambda v: s.from_mercator(s.to_mercator(v.sql(LONLAT)).drop("lon", "lat")).select("id", F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), s.utm_code(F.col("lon"), F.col("lat")).alias("zone")),
     f"SELECT id, round(6378137.0e0 * radians(lon), 3) AS mx, round(6378137.0e0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS my, round(lon, 6) AS lon, round(lat, 6) AS lat, 'EPSG:32630' AS zone FROM ({LONLAT})")
case("g13_frame_tracks", lambda v: s.frame_tracks(v.sql(LONLAT).withColumn("path", F.col("id") % 7)).select("path", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("width_m", 2).alias("width_m"), F.round("height_m", 2).alias("height_m")),
     f"WITH b AS (SELECT id % 7 AS path, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM ({LONLAT}) GROUP BY 1) SELECT path, round((x0 + x1) / 2, 6) AS lon, round((y0 + y1) / 2, 6) AS lat, round(greatest(500, (x1 - x0) * radians(6378137.0e0) * cos(radians((y0 + y1) / 2)) * 1.3), 2) AS width_m, round(greatest(500, (y1 - y0) * radians(6378137.0e0) * 1.3), 2) AS height_m FROM b")
case("g13_within_area", lambda v: s.within_area(v.sql(LONLAT), -4.6905, 41.6105, -4.6505, 41.6505, 0.0).select("id"), f"SELECT id FROM ({LONLAT}) WHERE lon BETWEEN -4.6905e0 AND -4.6505e0 AND lat BETWEEN 41.6105e0 AND 41.6505e0")
EDGES = """e AS (SELECT src, dst, min(seconds) AS seconds FROM (SELECT a AS src, b AS dst, 1000 / (speed_kmh / 3.6e0) AS seconds FROM geo_lines UNION ALL SELECT b, a, 1000 / (speed_kmh / 3.6e0) FROM geo_lines WHERE NOT oneway) GROUP BY src, dst)"""


def edges(v):
    return n.build_network(v.geo_lines.withColumn("length_m", F.lit(1000.0)))


def reach(v, most=400.0):
    access = lambda df: s.snap_points(df, v.geo_nodes, 60.0).withColumn("access_s", F.col("access") / 1.25)
    return n.reach_network(edges(v), access(v.geo_candidates), access(v.geo_demand), most)


REACH = f"""{EDGES}, near(kind, id, node, access) AS (SELECT kind, id, node, round(sqrt(power(p.x - g.x, 2) + power(p.y - g.y, 2)), 9) / 1.25e0 FROM (SELECT 's' AS kind, id, x, y FROM geo_candidates UNION ALL SELECT 'd', id, x, y FROM geo_demand) p JOIN geo_nodes g ON sqrt(power(p.x - g.x, 2) + power(p.y - g.y, 2)) <= 60),
 walk(site, node, s) AS (SELECT id, node, access FROM near WHERE kind = 's' UNION SELECT site, e.dst, s + e.seconds FROM walk w JOIN e ON e.src = w.node WHERE s + e.seconds <= 400), best AS (SELECT site, node, min(s) AS s FROM walk GROUP BY site, node),
 reach AS (SELECT site, d.id AS demand, s + access AS cost FROM best JOIN near d ON d.kind = 'd' AND d.node = best.node WHERE s + access <= 400)"""
case("g01_build_network", lambda v: edges(v).withColumn("seconds", F.round("seconds", 6)), f"WITH {EDGES} SELECT src, dst, round(seconds, 6) AS seconds FROM e")
STREETS = "SELECT l.a * 10 + l.b - l.a AS id, p.x + CASE WHEN l.a % 3 = 0 THEN 0.1e0 ELSE 0.0e0 END AS x0, p.y AS y0, q.x AS x1, q.y AS y1, CASE WHEN l.a % 4 = 0 THEN 77.0e0 END AS travel_time_s, l.speed_kmh, CASE WHEN l.a % 7 = 3 THEN 'yes' WHEN l.a % 7 = 4 THEN 'reverse' END AS oneway, l.bridge FROM geo_lines l JOIN geo_nodes p ON p.node = l.a JOIN geo_nodes q ON q.node = l.b"
BLOCKS = "SELECT node AS id, x + 450 AS x0, y - 50 AS y0, x + 550 AS x1, y + 50 AS y1 FROM geo_nodes WHERE node % 25 IN (2, 6, 12)"
case("g01_network_of_lines", lambda v: n.network_of_lines(v.sql(STREETS), v.sql(BLOCKS))[0].withColumn("seconds", F.round("seconds", 4)),
     f"""WITH s AS ({STREETS}), b AS ({BLOCKS}), k AS (SELECT s.*, concat(CAST(round(x0 * 2) AS BIGINT), ',', CAST(round(y0 * 2) AS BIGINT)) AS p, concat(CAST(round(x1 * 2) AS BIGINT), ',', CAST(round(y1 * 2) AS BIGINT)) AS q, coalesce(travel_time_s, sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) / (speed_kmh / 3.6)) AS t FROM s WHERE bridge OR NOT EXISTS (SELECT 1 FROM b WHERE b.x0 < greatest(s.x0, s.x1) AND b.x1 > least(s.x0, s.x1) AND b.y0 < greatest(s.y0, s.y1) + 0.001 AND b.y1 > least(s.y0, s.y1) - 0.001))
     SELECT src, dst, round(min(t), 4) AS seconds FROM (SELECT p AS src, q AS dst, t FROM k WHERE coalesce(oneway, '') <> 'reverse' UNION ALL SELECT q, p, t FROM k WHERE coalesce(oneway, '') <> 'yes') GROUP BY src, dst""")
case("g02_reach_network", lambda v: reach(v).withColumn("cost", F.round("cost", 6)), f"WITH RECURSIVE {REACH} SELECT site, demand, round(cost, 6) AS cost FROM reach")
CHOSEN = "SELECT * FROM (VALUES (CAST(3 AS BIGINT), 1), (CAST(17 AS BIGINT), 2), (CAST(8 AS BIGINT), 3)) AS c(site, \"order\")"
SPARK_CHOSEN = CHOSEN.replace('"', "`")
case("g04_assign", lambda v: n.assign(reach(v), v.sql(SPARK_CHOSEN)).withColumn("cost", F.round("cost", 6)),
     f"WITH RECURSIVE {REACH}, c AS ({CHOSEN}), r AS (SELECT demand, site, cost, row_number() OVER (PARTITION BY demand ORDER BY round(cost, 9), \"order\") AS k FROM reach JOIN c USING (site)) SELECT demand, site, round(cost, 6) AS cost FROM r WHERE k = 1")
WIDE = REACH.replace("<= 400", "<= 600")
case("g08_unserved_reasons", lambda v: n.unserved_reasons(s.snap_points(v.geo_demand, v.geo_nodes, 60.0), reach(v), v.sql(SPARK_CHOSEN), reach(v, 600.0)).withColumn("minutes", F.round("minutes", 3)),
     f"""WITH RECURSIVE {WIDE}, d AS (SELECT d.id, min(cost) FILTER (site IN (3, 17, 8)) AS best, EXISTS (SELECT 1 FROM near WHERE kind = 'd' AND near.id = d.id) AS on_road, coalesce(bool_or(cost <= 400), false) AS possible FROM geo_demand d LEFT JOIN reach ON demand = d.id GROUP BY d.id)
     SELECT id, CASE WHEN NOT on_road THEN 'no node near' WHEN best IS NOT NULL THEN 'too far' WHEN possible THEN 'another site would reach it' ELSE 'no site reaches it' END AS reason, round(best / 60, 3) AS minutes FROM d WHERE best IS NULL OR best > 400""")


def weights(v):
    return v.geo_demand.select(F.col("id").alias("demand"), "weight")


case("g05_max_coverage", lambda v: n.max_coverage(reach(v), weights(v), 1), f"WITH RECURSIVE {REACH}, g AS (SELECT site, round(sum(weight), 6) AS gain FROM reach JOIN geo_demand d ON d.id = demand GROUP BY site) SELECT 1 AS step, site, gain, gain AS served FROM g ORDER BY gain DESC, site LIMIT 1")
GREEDY = ", ".join(f"""s{k} AS (SELECT site, round(sum(weight), 6) AS gain FROM reach JOIN geo_demand d ON d.id = demand WHERE true {"".join(f"AND demand NOT IN (SELECT demand FROM reach WHERE site IN (SELECT site FROM b{i}))" for i in range(1, k))} GROUP BY site),
 b{k} AS (SELECT * FROM s{k} WHERE gain > 0 ORDER BY gain DESC, site LIMIT 1)""" for k in (1, 2, 3))
case("g05_max_coverage_k3", lambda v: n.max_coverage(reach(v), weights(v), 3).withColumn("served", F.round("served", 4)),
     f"WITH RECURSIVE {REACH}, {GREEDY}, u AS (SELECT 1 AS step, * FROM b1 UNION ALL SELECT 2, * FROM b2 UNION ALL SELECT 3, * FROM b3) SELECT step, site, gain, round(sum(gain) OVER (ORDER BY step), 4) AS served FROM u")
PRICED = ", ".join(f"""s{k} AS (SELECT site, round(sum(weight), 6) AS gain, round(round(sum(weight), 6) / any_value(cost), 9) AS score FROM r JOIN geo_demand d ON d.id = demand WHERE true {"".join(f"AND demand NOT IN (SELECT demand FROM r WHERE site IN (SELECT site FROM b{i}))" for i in range(1, k))} GROUP BY site),
 b{k} AS (SELECT site, gain FROM s{k} WHERE gain > 0 {"".join(f"AND (SELECT coalesce(sum(gain), 0) FROM ({' UNION ALL '.join(f'SELECT gain FROM b{i}' for i in range(1, k))})) < (SELECT goal FROM t)" for _ in range(k > 1))} ORDER BY score DESC, site LIMIT 1)""" for k in range(1, 11))
case("g06_min_sites", lambda v: n.min_sites(reach(v), weights(v), v.geo_candidates.select(F.col("id").alias("site"), F.col("cost").cast("double").alias("cost")), 0.04).withColumn("served", F.round("served", 4)),
     f"WITH RECURSIVE {REACH}, t AS (SELECT 0.04e0 * sum(weight) - 1e-9 AS goal FROM geo_demand), r AS (SELECT site, demand, c.cost AS cost FROM reach JOIN geo_candidates c ON c.id = site), {PRICED}, u AS ({' UNION ALL '.join(f'SELECT {k} AS step, site, gain FROM b{k}' for k in range(1, 11))}) SELECT step, site, gain, round(sum(gain) OVER (ORDER BY step), 4) AS served FROM u")
case("g07_cross_check", lambda v: n.cross_check(reach(v), s.within_distance(v.geo_candidates, v.geo_demand, 1500.0)),
     f"WITH RECURSIVE {REACH}, st AS (SELECT a.id AS site, count(*) AS straight FROM geo_candidates a JOIN geo_demand b ON sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 1500 GROUP BY a.id) SELECT site, straight, coalesce((SELECT count(*) FROM reach r WHERE r.site = st.site), 0) AS network FROM st")
