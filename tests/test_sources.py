import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from orewright.sources import files as f


def box(path, text=False):
    corners = [(x, y, z) for x in (0, 2) for y in (0, 3) for z in (0, 4)]
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    faces = [(q[0], q[1], q[2]) for q in quads] + [(q[0], q[2], q[3]) for q in quads]
    if text:
        path.write_text("solid box\n" + "".join("facet normal 0 0 0\nouter loop\n" + "".join(f"vertex {' '.join(map(str, corners[k]))}\n" for k in t) + "endloop\nendfacet\n" for t in faces) + "endsolid\n")
    else:
        path.write_bytes(b" " * 80 + struct.pack("<I", len(faces)) + b"".join(struct.pack("<12fH", 0, 0, 0, *[c for k in t for c in corners[k]], 0) for t in faces))


@pytest.fixture
def tree(tmp_path):
    for p in ("a/b", ".git", "c d"):
        (tmp_path / "lib" / p).mkdir(parents=True)
    box(tmp_path / "lib/a/one.stl")
    box(tmp_path / "lib/a/b/two.STL", text=True)
    box(tmp_path / "lib/.git/hidden.stl")
    (tmp_path / "lib/c d/bad.stl").write_bytes(b"not a mesh at all")
    (tmp_path / "lib/notes.txt").write_text("x")
    return tmp_path / "lib"


def test_scan_and_fingerprint(spark, tree):
    rows = f.scan_files(spark, str(tree), exclude=[".git/**"])
    assert {r["rel_path"] for r in rows.collect()} == {"a/one.stl", "a/b/two.STL", "c d/bad.stl"}
    assert {r["rel_path"] for r in f.scan_files(spark, str(tree), include=["a/*"]).collect()} == {"a/one.stl"}
    assert f.scan_files(spark, str(tree), min_bytes=100_000).count() == 0
    hashes = {r["rel_path"]: r["sha256"] for r in f.fingerprint(spark, rows, str(tree)).collect()}
    assert hashes["a/one.stl"] == hashlib.sha256((tree / "a/one.stl").read_bytes()).hexdigest()


def test_stl_faces_and_errors(spark, tree):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{stl,STL}").load(str(tree))
    rows = f.read_stl(files)
    count = {r["name"]: (r["n"], r["bad"]) for r in rows.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.count("face").alias("n"), F.count("error").alias("bad")).collect()}
    assert count["one.stl"] == (12, 0) and count["two.STL"] == (12, 0) and count["bad.stl"] == (0, 1)
    assert rows.agg(F.max("az")).first()[0] == 4.0


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -9\n1 2 3\n4 -9 6\n")
    cells = {(r["row"], r["col"]): r for r in f.read_ascii_grid(spark, str(tmp_path / "g.asc")).collect()}
    assert len(cells) == 6 and cells[1, 1]["z"] is None and (cells[0, 2]["x"], cells[0, 2]["y"], cells[0, 2]["z"]) == (15.0, 23.0, 3.0)
    (tmp_path / "bad.asc").write_text("ncols 3\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\n1 2 3\n")
    with pytest.raises(Exception, match="number of rows"):
        f.read_ascii_grid(spark, str(tmp_path / "bad.asc")).collect()


def test_geojson_layer_and_tracks(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"w":2,"n":"x"},"geometry":{"type":"Point","coordinates":[1,2]}},{"type":"Feature","properties":{},"geometry":null},{"type":"Feature","properties":null,"geometry":{"type":"LineString","coordinates":[]}},{"type":"Feature","properties":{},"geometry":{"type":"LineString","coordinates":[[1,2,3],[4,5]]}}]}')
    rows = f.read_layer(spark, str(tmp_path / "l.json"), "demand", "EPSG:4326", source="survey").orderBy("n").collect()
    assert [r["warning"] for r in rows] == [None, "no geometry", "empty geometry", None] and rows[0]["properties"]["w"] == "2" and rows[0]["source"] == "survey"
    assert [(r["lon"], r["ele"]) for r in f.read_tracks(spark, str(tmp_path / "l.json"), "geojson").orderBy("n").collect()] == [(1.0, 3.0), (4.0, None)]
    (tmp_path / "p.json").write_text('{"type":"Point","coordinates":[1,2]}')
    assert f.read_layer(spark, str(tmp_path / "p.json"), "demand", "EPSG:4326").first()["kind"] == "Point"
    (tmp_path / "t.gpx").write_text('<?xml version="1.0"?><gpx><trk><trkseg><trkpt lat="41.5" lon="-4.7"><ele>700</ele></trkpt><trkpt lat="41.6" lon="-4.8"></trkpt></trkseg></trk></gpx>')
    assert [(r["lat"], r["ele"]) for r in f.read_tracks(spark, str(tmp_path / "t.gpx"), "gpx").orderBy("n").collect()] == [(41.5, 700.0), (41.6, None)]
    (tmp_path / "k.kml").write_text('<?xml version="1.0"?><kml><Document><Placemark><LineString><coordinates>\n-4.7,41.5,700 -4.8,41.6\n x,1 </coordinates></LineString></Placemark><Placemark><LineString><coordinates>1,2</coordinates></LineString></Placemark></Document></kml>')
    assert [(r["line"], r["lon"], r["ele"]) for r in f.read_tracks(spark, str(tmp_path / "k.kml"), "kml").orderBy("line", "n").collect()] == [(0, -4.7, 700.0), (0, -4.8, None), (1, 1.0, None)]


def test_feed_and_journal(spark, tmp_path):
    items = "".join(f"<item><guid>g{i}</guid><title> T{i} </title><link>http://x/{i}</link><pubDate>Mon, {i + 1} Jan 2024 10:00:00 +0100</pubDate></item>" for i in range(5))
    (tmp_path / "feed.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    rows = f.read_feed_items(spark, str(tmp_path / "feed.xml"), most=3).collect()
    assert {r["id"] for r in rows} == {"g2", "g3", "g4"} and str(max(r["published"] for r in rows)) == "2024-01-05 09:00:00"
    (tmp_path / "atom.xml").write_text('<feed><entry><id>e1</id><title>T</title><link href="http://x/e1"/><link rel="edit" href="http://x/edit"/><updated>2024-01-02T10:00:00+02:00</updated><summary> s </summary></entry></feed>')
    entry = f.read_feed_items(spark, str(tmp_path / "atom.xml")).first()
    assert (entry["id"], entry["link"], str(entry["published"]), entry["summary"]) == ("e1", "http://x/e1", "2024-01-02 08:00:00", "s")
    for name, lines in (("journal.jsonl.1", '{"seq":1}\n{oops\n'), ("journal.jsonl", '{"seq":2}\n')):
        (tmp_path / "j").mkdir(exist_ok=True)
        (tmp_path / "j" / name).write_text(lines)
    rows = f.read_journal(spark, str(tmp_path / "j"), "seq long").orderBy(F.desc("age"), "seq").collect()
    assert [(r["seq"], r["broken"], r["age"]) for r in rows] == [(None, "{oops", 1), (1, None, 1), (2, None, 0)]


def test_list_export(spark, tmp_path):
    from orewright.operators import listings

    rows = spark.createDataFrame([(1, "a", "T, 1", 'say "x"', ["p", "q"], "draft"), (1, "b", "U", "d", ["r"], "approved")], "root_id long, folder string, title string, description string, tags array<string>, status string")
    listings.export_listings(rows, str(tmp_path / "csv"), "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).orderBy("folder").collect()
    assert [(r["title"], r["description"], r["tags"]) for r in back] == [("T, 1", 'say "x"', "p|q"), ("U", "d", "r")]
    listings.export_listings(rows, str(tmp_path / "md"), "markdown", status="draft")
    assert "# T, 1" in "".join(p.read_text() for p in (tmp_path / "md").glob("part-*"))
    listings.export_listings(rows, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 2
