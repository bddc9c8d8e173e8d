"""Readers of files and folders: inventories, meshes, grids, layers, tracks, feeds, journals."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Endings of known asset files.
FORMATS = ("stl", "obj", "3mf", "glb", "gltf", "ply")


def glob_regex(glob: str) -> str:
    """A case-insensitive pattern of a glob: ``**`` is any depth, ``*`` and ``?`` stay in a segment."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"(?i)^{out}$"


def select_paths(files: DataFrame, include: list[str], exclude: list[str], min_bytes: int = 0, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """Rows (``rel_path, size_bytes``) of known formats that an include glob takes (none: all) and no exclude glob."""
    path = F.col("rel_path")
    known = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(list(formats))

    def any_of(globs: list[str]) -> Column:
        hit = F.lit(False)
        for g in globs:
            hit = hit | path.rlike(glob_regex(g))
        return hit

    return files.where(known & (F.col("size_bytes") >= min_bytes) & (any_of(include) if include else F.lit(True)) & ~any_of(exclude))


def scan_files(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, min_bytes: int = 0) -> DataFrame:
    """``path, rel_path, size_bytes, modified`` of the asset files under ``root``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    base = re.sub(r"^[a-z]+:/+", "/", root).rstrip("/") + "/"
    rel = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^(?:[a-z]+:)?/+" + re.escape(base.lstrip("/")), "")
    return select_paths(files.withColumn("rel_path", rel), include or [], exclude or [], min_bytes)


def fingerprint(spark: SparkSession, paths: DataFrame, root: str) -> DataFrame:
    """Adds ``sha256`` of each file's content to rows of :func:`scan_files`; only those files' contents are hashed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.join(paths.select("path"), "path", "left_semi").select("path", F.sha2("content", 256).alias("sha256")).join(paths, "path")


def sniff_kind(content: Column) -> Column:
    """What a file is by its first bytes."""
    head = F.hex(F.substring(content, 1, 16))
    text = F.decode(F.substring(content, 1, 16), "ISO-8859-1")
    return (
        F.when(F.startswith(head, F.lit("504B0304")), "zip").when(F.startswith(head, F.lit("676C5446")), "glb").when(F.startswith(head, F.lit("89504E47")), "png").when(F.startswith(head, F.lit("FFD8FF")), "jpeg")
        .when(F.startswith(head, F.lit("25504446")), "pdf").when(F.startswith(head, F.lit("1F8B")), "gzip").when(text.rlike(r"^solid\b"), "stl text").when(text.rlike(r"^ply\b"), "ply").when(text.rlike(r"^\s*[\[{]"), "json").when(text.rlike(r"^\s*<"), "markup").otherwise("unknown")
    )


def sniff_census(files: DataFrame) -> DataFrame:
    """``ending, kind, n`` of files (``path, content``)."""
    return files.groupBy(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ending"), sniff_kind(F.col("content")).alias("kind")).agg(F.count("*").alias("n"))


FACE = "path string, face long, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz") + ", error string"


def parse_stl(data: bytes) -> np.ndarray:
    """Corners of each triangle (n, 9) of a binary or text STL file; ValueError if it's neither."""
    if len(data) >= 84 and len(data) == 84 + 50 * struct.unpack("<I", data[80:84])[0]:
        faces = np.frombuffer(data, np.dtype([("n", "<f4", 3), ("v", "<f4", 9), ("a", "<u2")]), offset=84)
        return faces["v"].astype(float)
    if data[:5] == b"solid":
        numbers = re.findall(rb"vertex\s+(\S+)\s+(\S+)\s+(\S+)", data)
        if numbers and len(numbers) % 3 == 0:
            return np.array(numbers, float).reshape(-1, 9)
    raise ValueError("not an STL file")


def read_stl(files: DataFrame) -> DataFrame:
    """One row for each triangle of files (``path, content``); an unreadable file is one row with ``error``."""
    def run(batches):
        names = [f"{p}{c}" for p in "abc" for c in "xyz"]
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    v, error = parse_stl(content or b""), None
                except ValueError as e:
                    v, error = np.full((1, 9), np.nan), str(e)
                for a in range(0, len(v), 50_000):
                    part = v[a : a + 50_000]
                    gone = np.full(len(part), error is not None)
                    columns = [pa.array([path] * len(part)), pa.array(np.arange(a, a + len(part)), pa.int64(), mask=gone), *[pa.array(part[:, k], mask=gone) for k in range(9)], pa.array([error] * len(part), pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "face", *names, "error"])

    return files.select("path", "content").mapInArrow(run, FACE)


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """``path, row, col, x, y, z`` of ESRI ASCII grids, cell centres as ``x, y``; no-data is null. A grid whose lines aren't those of its header fails the job."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    head = lambda *names: F.coalesce(*[F.nullif(F.regexp_extract("value", rf"(?im)^\s*{n}\s+(\S+)", 1), F.lit("")).try_cast("double") for n in names])
    rows = files.select("path", head("ncols").cast("int").alias("nc"), head("nrows").cast("int").alias("nr"), head("xllcorner").alias("xc"), head("xllcenter").alias("xm"), head("yllcorner").alias("yc"), head("yllcenter").alias("ym"), head("cellsize", "dx").alias("dx"), head("cellsize", "dy").alias("dy"), head("nodata_value").alias("nd"), F.regexp_extract_all("value", F.lit(r"(?m)^\s*([-+.\d][^\n]*\S)\s*$"), F.lit(1)).alias("lines"))
    rows = rows.withColumn("lines", F.when(F.size("lines") == F.col("nr"), F.col("lines")).otherwise(F.raise_error(F.lit("the grid has another number of rows"))))
    cells = rows.select("*", F.posexplode("lines").alias("row", "line")).withColumn("v", F.split(F.trim("line"), r"\s+"))
    cells = cells.withColumn("v", F.when(F.size("v") == F.col("nc"), F.col("v")).otherwise(F.raise_error(F.lit("a row has another number of cells")))).select("*", F.posexplode("v").alias("col", "text"))
    z = F.col("text").cast("double")
    x = F.coalesce(F.col("xc") + F.col("dx") / 2, F.col("xm")) + F.col("col") * F.col("dx")
    y = F.coalesce(F.col("yc") + F.col("dy") / 2, F.col("ym")) + (F.col("nr") - 1 - F.col("row")) * F.col("dy")
    return cells.select("path", "row", "col", x.alias("x"), y.alias("y"), F.when(z == F.col("nd"), None).otherwise(z).alias("z"))


_FEATURE = "struct<type: string, id: string, geometry: string, properties: map<string,string>>"


def read_layer(spark: SparkSession, path: str, role: str, crs: str, source: str | None = None, date: str | None = None) -> DataFrame:
    """``role, n, kind, geometry, properties, warning`` of GeoJSON files, with the declared system, source and date; a bare feature or geometry counts as one, and null or empty geometries are rows with a warning."""
    doc = "struct<type: string, features: array<" + _FEATURE + ">, geometry: string, properties: map<string,string>, coordinates: string>"
    files = spark.read.text(path, wholetext=True).select("value", F.from_json("value", doc).alias("d"))
    bare = F.struct(F.lit("Feature").alias("type"), F.lit(None).cast("string").alias("id"), F.coalesce("d.geometry", F.when(F.col("d.type") != "Feature", F.col("value"))).alias("geometry"), F.col("d.properties").alias("properties"))
    rows = files.select(F.posexplode(F.when(F.col("d.type") == "FeatureCollection", F.col("d.features")).otherwise(F.array(bare))).alias("n", "f"))
    kind = F.get_json_object("f.geometry", "$.type")
    coordinates = F.get_json_object("f.geometry", "$.coordinates")
    warning = F.when(F.col("f.geometry").isNull() | kind.isNull(), "no geometry").when(F.coalesce(coordinates, F.lit("[]")).rlike(r"^[\[\]\s]*$"), "empty geometry")
    lit = lambda v: F.lit(v).cast("string")
    return rows.select(lit(role).alias("role"), "n", kind.alias("kind"), coordinates.alias("coordinates"), F.col("f.properties").alias("properties"), lit(crs).alias("crs"), lit(source).alias("source"), lit(date).alias("date"), warning.alias("warning"))


def read_tracks(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """``path, line, n, lon, lat, ele`` of GPX tracks and routes, KML lines, or GeoJSON lines, points in order; ``line`` is the segment's number in its file."""
    def points(tag: str, child: str) -> DataFrame:
        rows = spark.read.format("xml").option("rowTag", tag).schema(f"{child} array<struct<_lat: double, _lon: double, ele: double>>").load(path).withColumn("path", F.input_file_name())
        return rows.select("path", F.col(child).alias("p"))

    if fmt == "gpx":
        lines = points("trkseg", "trkpt").unionAll(points("rte", "rtept")).select("path", F.transform("p", lambda q: F.struct(q["_lon"].alias("lon"), q["_lat"].alias("lat"), q["ele"].alias("ele"))).alias("p"))
    elif fmt == "kml":
        rows = spark.read.format("xml").option("rowTag", "LineString").schema("coordinates string").load(path)
        number = lambda t, i: F.get(F.split(t, ","), F.lit(i)).try_cast("double")
        triples = F.transform(F.filter(F.split(F.trim("coordinates"), r"\s+"), lambda t: t.contains(",")), lambda t: F.struct(number(t, 0).alias("lon"), number(t, 1).alias("lat"), number(t, 2).alias("ele")))
        lines = rows.select(F.input_file_name().alias("path"), triples.alias("p"))
    elif fmt == "geojson":
        rows = read_layer(spark, path, "track", "EPSG:4326").where("kind = 'LineString'")
        lines = rows.select(F.lit(path).alias("path"), F.transform(F.from_json("coordinates", "array<array<double>>"), lambda q: F.struct(q[0].alias("lon"), q[1].alias("lat"), F.get(q, F.lit(2)).alias("ele"))).alias("p"))
    else:
        raise ValueError(f"unknown format {fmt}")
    lines = lines.withColumn("line", F.row_number().over(Window.partitionBy("path").orderBy(F.monotonically_increasing_id())) - 1)  # a row for each line of a file
    out = lines.select("path", "line", F.posexplode("p").alias("n", "q")).select("path", "line", "n", "q.lon", "q.lat", "q.ele")
    return out.where("lon is not null and lat is not null")


def read_feed_items(spark: SparkSession, path: str, most: int = 200) -> DataFrame:
    """``feed, id, title, link, published, summary`` of RSS items and Atom entries, dates in UTC, the first ``most`` of each feed."""
    rss = spark.read.format("xml").option("rowTag", "item").schema("guid string, title string, link string, pubDate string, description string").load(path)
    rss = rss.select(F.input_file_name().alias("feed"), F.coalesce("guid", "link", "title").alias("id"), F.trim("title").alias("title"), "link", F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")).alias("published"), F.trim("description").alias("summary"))
    atom = spark.read.format("xml").option("rowTag", "entry").schema("id string, title string, link array<struct<_href: string, _rel: string>>, published string, updated string, summary string").load(path)
    href = F.get(F.transform(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), lambda x: x["_href"]), F.lit(0))
    atom = atom.select(F.input_file_name().alias("feed"), F.coalesce("id", href, "title").alias("id"), F.trim("title").alias("title"), href.alias("link"), F.try_to_timestamp(F.coalesce("published", "updated")).alias("published"), F.trim("summary").alias("summary"))
    order = Window.partitionBy("feed").orderBy(F.desc_nulls_last("published"), "id")
    return rss.unionByName(atom).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a rotated chain (``journal.jsonl.2`` is older than ``.1``, that than ``journal.jsonl``); ``broken`` has lines that don't parse. ``age`` is the file's number, so oldest first is by ``age`` falling."""
    rows = spark.read.schema(f"{schema}, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    return rows.withColumn("age", F.coalesce(F.nullif(F.regexp_extract(F.input_file_name(), r"\.(\d+)$", 1), F.lit("")).cast("int"), F.lit(0)))


def write_footprints(rows: DataFrame, path: str) -> None:
    """Footprints (``id, x0, y0, x1, y1, height``) as gzip JSON lines in a folder for each ``quadkey``."""
    rows.write.partitionBy("quadkey").option("compression", "gzip").json(path)


def read_footprints(spark: SparkSession, path: str, quadkeys: list[str], box: tuple[float, float, float, float]) -> DataFrame:
    """Footprints whose first corner lies in ``box``; only the folders of ``quadkeys`` are read. A height under 0 is unknown: null."""
    x0, y0, x1, y1 = box
    rows = spark.read.schema("id long, x0 double, y0 double, x1 double, y1 double, height double, quadkey string").json(path).where(F.col("quadkey").isin(quadkeys))
    return rows.where(F.col("x0").between(x0, x1) & F.col("y0").between(y0, y1)).withColumn("height", F.when(F.col("height") >= 0, F.col("height")))


def export_cover_instance(reach: DataFrame) -> DataFrame:
    """``site, covers`` (ids, in order) of a set-covering instance and its JSON line."""
    rows = reach.groupBy("site").agg(F.array_sort(F.collect_set("demand")).alias("covers"))
    return rows.select("site", F.to_json(F.struct("site", "covers")).alias("line"))


def export_cover_decision(reach: DataFrame, demand: DataFrame, sites: DataFrame, chosen: DataFrame) -> DataFrame:
    """``part, id, line``: the whole hand-off as JSON lines: each ``demand`` (``id, weight``), each candidate (``id, cost``) with what it covers, none too, and the solution: each
    chosen site (``step, site, gain, served``) with the share of all weight that is served by then."""
    covers = reach.groupBy(F.col("site").alias("id")).agg(F.array_sort(F.collect_set("demand")).alias("covers"))
    candidates = sites.select("id", "cost").join(covers, "id", "left").withColumn("covers", F.coalesce("covers", F.array().cast("array<bigint>")))
    total = demand.agg(F.sum("weight").alias("all"))  # one row
    solution = chosen.join(F.broadcast(total)).select(F.col("site").alias("id"), "step", "gain", F.round(100 * F.col("served") / F.col("all"), 4).alias("served_pct"))
    parts = [("demand", demand, ("id", "weight")), ("candidate", candidates, ("id", "cost", "covers")), ("solution", solution, ("id", "step", "gain", "served_pct"))]
    lines = [df.select(F.lit(name).alias("part"), "id", F.to_json(F.struct(*c)).alias("line")) for name, df, c in parts]
    return lines[0].unionByName(lines[1]).unionByName(lines[2])
