"""Filters, duplicates, rollups and pages over a catalogue of assets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orewright.plans.components import connected_components


@dataclass
class Filters:
    """Every given condition must hold; bounds are inclusive and never hold for a null extent."""

    root_id: int | None = None
    formats: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    collection: str | None = None
    album_id: int | None = None
    watertight: bool | None = None
    has_listing: bool | None = None
    dupes_only: bool = False
    status: str | None = None
    min_bytes: int | None = None
    max_bytes: int | None = None
    min_extent: float | None = None
    max_extent: float | None = None
    min_triangles: int | None = None
    max_triangles: int | None = None
    ids: list[int] = field(default_factory=list)


def longest_extent(x: str = "bbox_x", y: str = "bbox_y", z: str = "bbox_z") -> Column:
    """The largest of three extents; null if one is."""
    there = F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()
    return F.when(there, F.greatest(x, y, z))


def has_tags(tags: Column, wanted: list[str]) -> Column:
    """Whether an array holds every wanted tag."""
    distinct = list(dict.fromkeys(wanted))
    return F.size(F.array_intersect(tags, F.array(*[F.lit(t) for t in distinct]))) == len(distinct) if distinct else F.lit(True)


def in_album(assets: DataFrame, members: DataFrame, album_id: int) -> DataFrame:
    return assets.join(members.where(F.col("album_id") == album_id).select(F.col("model_id").alias("id")), "id", "left_semi")


def with_listing_flag(assets: DataFrame, listings: DataFrame) -> DataFrame:
    """Adds ``has_listing``."""
    return assets.join(listings.select(F.col("model_id").alias("id"), F.lit(True).alias("has_listing")).distinct(), "id", "left").withColumn("has_listing", F.coalesce("has_listing", F.lit(False)))


def filter_assets(assets: DataFrame, listings: DataFrame, members: DataFrame, f: Filters) -> DataFrame:
    """Rows of ``assets`` (``tags`` an array) that meet all conditions; scan predicates come first, semi joins after. ``dupes_only`` keeps what has a copy anywhere in the library."""
    extent, everything = longest_extent(), assets
    formats, tags = [x.strip().lower().lstrip(".") for x in f.formats], [x.strip().lower() for x in f.tags]
    plain = [
        (f.root_id, F.col("root_id") == f.root_id), (f.formats, F.col("format").isin(formats)), (f.tags, has_tags(F.col("tags"), tags)), (f.collection, F.col("collection") == f.collection),
        (f.watertight, F.col("watertight") == f.watertight), (f.status, F.col("status") == f.status), (f.min_bytes, F.col("size_bytes") >= f.min_bytes), (f.max_bytes, F.col("size_bytes") <= f.max_bytes),
        (f.min_extent, extent >= f.min_extent), (f.max_extent, extent <= f.max_extent), (f.min_triangles, F.col("triangles") >= f.min_triangles), (f.max_triangles, F.col("triangles") <= f.max_triangles), (f.ids, F.col("id").isin(f.ids)),
    ]
    for given, condition in plain:
        if given is not None and given != []:
            assets = assets.where(condition)
    if f.album_id is not None:
        assets = in_album(assets, members, f.album_id)
    if f.has_listing is not None:
        assets = assets.join(listings.select(F.col("model_id").alias("id")), "id", "left_semi" if f.has_listing else "left_anti")
    if f.dupes_only:
        assets = assets.join(exact_dupes(everything), "sha256", "left_semi")
    return assets


def exact_dupes(assets: DataFrame) -> DataFrame:
    """Groups of more than one asset with the same non-empty hash: ``sha256``, ``lowest``, ``n``."""
    return assets.where(F.coalesce("sha256", F.lit("")) != "").groupBy("sha256").agg(F.min("id").alias("lowest"), F.count("*").alias("n")).where("n > 1")


def assign_dupe_of(assets: DataFrame) -> DataFrame:
    """Adds ``dupe_of``: the lowest id of the same hash, null for that asset itself and without a hash. An aggregate and a join, so a hash that many assets share stays spread."""
    lowest = exact_dupes(assets).select("sha256", "lowest")
    return assets.join(lowest, "sha256", "left").withColumn("dupe_of", F.when(F.col("id") != F.col("lowest"), F.col("lowest"))).drop("lowest")


def near_pairs(assets: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Pairs ``a < b`` of assets that aren't copies of a lower id: equal triangle counts, other hash, and volume, largest, smallest and summed extent within the tolerance.

    The volume's tolerance is relative to the larger of both, the extents' to asset ``a``, the lower id. A geometric bucket of the largest extent
    joins its neighbours only, so assets of one triangle count aren't all compared.
    """
    rows = _measured(assets)
    return _near(rows, rows, tolerance)


def _measured(assets: DataFrame) -> DataFrame:
    """What :func:`near_pairs` compares: one asset of each hash, those with measures."""
    there = F.col("volume_cm3").isNotNull() & longest_extent().isNotNull() & F.col("triangles").isNotNull()
    return assign_dupe_of(assets).where("dupe_of is null").where(there).select(
        "id", "sha256", "triangles", F.col("volume_cm3").alias("v"), longest_extent().alias("big"), F.least("bbox_x", "bbox_y", "bbox_z").alias("small"), (F.col("bbox_x") + F.col("bbox_y") + F.col("bbox_z")).alias("total")
    )


def _near(lower: DataFrame, higher: DataFrame, tolerance: float) -> DataFrame:
    bucket = F.floor(F.log(F.greatest("big", F.lit(1e-12))) / F.log(F.lit(1 + 2 * tolerance))).cast("long")
    left = lower.withColumn("k", bucket)
    right = higher.withColumn("k", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    a, b = left.alias("a"), right.alias("b")
    near = lambda c, base: F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= tolerance * base
    return a.join(b, (F.col("a.triangles") == F.col("b.triangles")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.id") < F.col("b.id"))).where(
        (F.coalesce(F.col("a.sha256"), F.lit("")) != F.coalesce(F.col("b.sha256"), F.lit(""))) & near("v", F.greatest(F.abs("a.v"), F.abs("b.v"))) & near("big", F.col("a.big")) & near("small", F.col("a.small")) & near("total", F.col("a.total"))
    ).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def near_groups(assets: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """``node`` and ``label`` (the lowest id) of the components of :func:`near_pairs`."""
    return connected_components(near_pairs(assets, tolerance))


def dupes_for(assets: DataFrame, asset_id: int, tolerance: float = 0.01) -> DataFrame:
    """``id`` and ``kind`` (``exact`` or ``near``) of what is like one asset; near ones leave out exact ones."""
    own = assets.where(F.col("id") == asset_id).select("sha256").where(F.coalesce("sha256", F.lit("")) != "")
    exact = assets.join(own, "sha256", "left_semi").where(F.col("id") != asset_id).select("id", F.lit("exact").alias("kind"))
    rows = _measured(assets)
    one = rows.where(F.col("id") == asset_id)  # so the joins meet this asset's triangle count and buckets alone
    near = _near(one, rows, tolerance).select(F.col("b").alias("id")).unionAll(_near(rows, one, tolerance).select("a")).select("id", F.lit("near").alias("kind"))
    return exact.unionAll(near.join(exact, "id", "left_anti"))


def shape_candidates(assets: DataFrame, queries: DataFrame, most: float = 0.25, k: int = 200) -> DataFrame:
    """For each query id the ``k`` nearest closed, canonical assets of another hash, by the L1 distance of their sorted extents over the largest.

    Both ratios lie in 0 to 1; a grid cell of the bound's size joins its 3 by 3 neighbours.
    """
    extents = F.array_sort(F.array("bbox_x", "bbox_y", "bbox_z"))
    rows = assign_dupe_of(assets).where(longest_extent() > 0).select("id", "sha256", "watertight", "dupe_of", (extents[0] / extents[2]).alias("p"), (extents[1] / extents[2]).alias("q"))
    cell = lambda c: F.floor(F.col(c) / most).cast("int")
    near = lambda c: F.explode(F.array(cell(c) - 1, cell(c), cell(c) + 1))
    asked = rows.join(queries.select("id"), "id", "left_semi").select(F.col("id").alias("query"), F.col("sha256").alias("h"), F.col("p").alias("p0"), F.col("q").alias("q0"), near("p").alias("i"), F.col("q"))
    asked = asked.select("query", "h", "p0", "q0", "i", near("q").alias("j"))
    found = rows.where("watertight and dupe_of is null").withColumn("i", cell("p")).withColumn("j", cell("q")).join(asked, ["i", "j"])
    found = found.withColumn("distance", F.abs(F.col("p") - F.col("p0")) + F.abs(F.col("q") - F.col("q0"))).where((F.col("distance") <= most) & (F.col("sha256") != F.col("h")) & (F.col("id") != F.col("query")))
    order = Window.partitionBy("query").orderBy(F.round("distance", 9), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "id", F.round("distance", 6).alias("distance"), "rank")


def normalise_tags(tags: Column) -> Column:
    """Trimmed, lower-cased, inner spaces single, no empty ones, each once in the order of its first place."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))), lambda t: t != ""))


def edit_tags(current: Column, add: Column, remove: Column) -> Column:
    """(current and add) without remove, in order."""
    return F.array_except(F.array_union(current, add), remove)


def catalog_columns(files: DataFrame) -> DataFrame:
    """Adds ``pretty`` (the file name without its ending, ``_`` and ``-`` as spaces), ``folder`` (the first path segment; empty at the root) and ``unit_guess`` by the largest extent (under 0.5: m, under 20: inch, else mm; null without one)."""
    name = F.element_at(F.split("rel_path", "/"), -1)
    pretty = F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), r"[_\-]+", " "))
    longest = longest_extent()
    guess = F.when(longest.isNull() | (longest <= 0), None).when(longest < 0.5, "m").when(longest < 20, "inch").otherwise("mm")
    return files.withColumn("pretty", pretty).withColumn("folder", F.when(F.instr("rel_path", "/") > 0, F.split("rel_path", "/")[0]).otherwise("")).withColumn("unit_guess", guess)


def library_totals(assets: DataFrame) -> DataFrame:
    """One row of counts and sums."""
    when = lambda c: F.count_if(F.expr(c))
    duplicates = assign_dupe_of(assets)
    return duplicates.agg(
        F.count("*").alias("models"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("triangles"), F.lit(0)).alias("triangles"), when("status = 'error'").alias("errors"), when("status = 'skipped'").alias("skipped"),
        when("watertight").alias("closed"), when("not watertight").alias("open"), when("watertight is null").alias("unknown"), when("dupe_of is not null").alias("duplicates"), F.count_distinct("format").alias("formats"),
    )


def facets(assets: DataFrame, most_tags: int = 200) -> DataFrame:
    """``facet, value, n`` of formats, the commonest tags (ties by tag) and non-empty collections."""
    count = lambda df, facet, c: df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(facet).alias("facet"), "value", "n")
    tags = count(assets.select(F.explode("tags").alias("t")), "tag", "t").orderBy(F.desc("n"), "value").limit(most_tags)
    return count(assets, "format", "format").unionAll(tags).unionAll(count(assets.where(F.coalesce("collection", F.lit("")) != ""), "collection", "collection"))


def rollups(assets: DataFrame) -> DataFrame:
    """Counts, bytes and triangles by format and by collection: both from one pass, as grouping sets."""
    sets = assets.groupingSets([["format"], ["collection"]], "format", "collection")
    return sets.agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), F.sum("triangles").alias("triangles"), F.grouping("format").alias("by_collection")).select("format", "collection", F.col("by_collection").cast("int").alias("by_collection"), "n", "bytes", "triangles")


def folder_sheets(assets: DataFrame, first: int = 15) -> DataFrame:
    """Facts of each folder: formats, the largest part by triangles (ties to the lower id), sums, counts of closed and measured parts, its first files and tag candidates."""
    rows = catalog_columns(assets)
    join = lambda c: F.array_join(c, ",")
    return rows.groupBy("root_id", "folder").agg(
        F.count("*").alias("n"), join(F.array_sort(F.collect_set("format"))).alias("formats"), F.max_by("id", F.struct("triangles", (-F.col("id")).alias("i"))).alias("largest"), F.sum("triangles").alias("triangles"),
        F.count_if(F.col("watertight")).alias("closed"), F.count("volume_cm3").alias("measured"), join(F.slice(F.array_sort(F.collect_list("rel_path")), 1, first)).alias("files"), join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags"))))).alias("tag_candidates"),
    )


def root_summary(roots: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets and bytes of each root; roots without assets have none."""
    per = assets.groupBy(F.col("root_id").alias("id")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))
    return roots.join(per, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def album_overview(albums: DataFrame, members: DataFrame) -> DataFrame:
    """Each album with its number of members and their ids in the order they were added (ties by id); empty albums stay. ``position`` is by name without regard to case."""
    per = members.groupBy(F.col("album_id").alias("id")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("added_at", "model_id"))), lambda x: x["model_id"].cast("string")), ",").alias("members"))
    out = albums.join(per, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("members", F.lit("")).alias("members"))
    return out.withColumn("position", F.row_number().over(Window.orderBy(F.lower("name"), "id")))  # a row for each album


def asset_detail(assets: DataFrame, listings: DataFrame, members: DataFrame) -> DataFrame:
    """Each asset with its listing's title, albums, and counts of exact copies and near matches."""
    albums = members.groupBy(F.col("model_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("album_id")), ",").alias("albums"))
    copies = exact_dupes(assets).select("sha256", (F.col("n") - 1).alias("copies"))
    pairs = near_pairs(assets)
    near = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("near"))
    out = assets.join(listings.select(F.col("model_id").alias("id"), "title"), "id", "left").join(albums, "id", "left").join(copies, "sha256", "left").join(near, "id", "left")
    return out.select("id", "name", "title", F.coalesce("albums", F.lit("")).alias("albums"), F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("near", F.lit(0)).alias("near"))


#: Sort orders: columns, and whether each falls. Ascending has nulls first, descending last; names compare by lower case.
SORTS = {
    "name": [("lower(name)", False)], "-name": [("lower(name)", True)], "size": [("size_bytes", False)], "-size": [("size_bytes", True)], "triangles": [("triangles", False)], "-triangles": [("triangles", True)],
    "modified": [("file_modified_at", False)], "-modified": [("file_modified_at", True)], "volume": [("volume_cm3", False)], "-volume": [("volume_cm3", True)], "extent": [("bbox_z", False)], "-extent": [("bbox_z", True)], "id": [],
}


def sort_columns(sort: str) -> list[Column]:
    return [F.expr(c).desc_nulls_last() if falls else F.expr(c).asc_nulls_first() for c, falls in SORTS[sort]] + [F.col("id").asc()]


def sort_assets(assets: DataFrame, sort: str) -> DataFrame:
    """By one of :data:`SORTS`, ties by id."""
    return assets.orderBy(*sort_columns(sort))


def page(rows: DataFrame, sort: str, limit: int, offset: int = 0) -> DataFrame:
    """A page in order, with the ``total`` of all rows in each of its rows."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    return sort_assets(rows, sort).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def largest(assets: DataFrame, n: int = 5) -> DataFrame:
    """The assets with most triangles, ties by id."""
    return sort_assets(assets, "-triangles").limit(n)


def recent(assets: DataFrame, n: int) -> DataFrame:
    """The newest assets by file date, ties by id."""
    return sort_assets(assets, "-modified").limit(n)


def fold_distinct(assets: DataFrame, sort: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of the first asset of each content hash in sort order, with ``copies``: how many assets share it, itself left out. Assets without a hash stand alone."""
    key = F.when(F.coalesce("sha256", F.lit("")) == "", F.concat(F.lit("id "), F.col("id").cast("string"))).otherwise(F.col("sha256"))
    rows = assets.withColumn("_key", key)
    # the first of each key is found before rows are moved, and copies are an aggregate, so a hash that many assets share stays spread
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*sort_columns(sort)))).where("_n = 1").drop("_n")
    copies = rows.groupBy("_key").agg((F.count("*") - 1).alias("copies"))
    return sort_assets(first.join(copies, "_key"), sort).offset(offset).limit(limit).drop("_key")
