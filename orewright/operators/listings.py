"""Listings of folders and assets: rules, validation, unions, snapshots."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orewright.operators.catalogue import normalise_tags

TITLE_MAX, DESCRIPTION_MIN, TAG_COUNT = 120, 200, 20
_OPS = {"==": "eq", "=": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge", "nin": "not_in"}


def apply_attribute_rules(rows: DataFrame, rules: list[tuple[str, str, object]], unknown: str = "reject") -> DataFrame:
    """Adds ``verdict`` (pass, fail or unknown), ``failed`` (the rules that fail) and ``accepted``. ``rules`` are column, operator (``== != < <= > >= in not_in``) and value.

    A missing or incomparable attribute is unknown; ``unknown`` says whether such rows are rejected or accepted.
    """
    checks: list[tuple[str, Column]] = []
    for name, op, value in rules:
        kind, col = _OPS.get(op, op), F.col(name)
        if kind in ("in", "not_in"):
            ok = col.isin(list(value)) if kind == "in" else ~col.isin(list(value))
        elif kind in ("eq", "ne"):
            ok = (col == F.lit(value)) if kind == "eq" else (col != F.lit(value))
        else:
            number = F.expr(f"try_cast(`{name}` AS double)")
            ok = {"lt": number < value, "le": number <= value, "gt": number > value, "ge": number >= value}[kind]
        checks.append((f"{name} {op} {value}", ok))
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(label)) for label, ok in checks]))
    missing = F.array_compact(F.array(*[F.when(ok.isNull(), F.lit(label)) for label, ok in checks]))
    verdict = F.when(F.size(failed) > 0, "fail").when(F.size(missing) > 0, "unknown").otherwise("pass")
    out = rows.withColumn("failed", failed).withColumn("verdict", verdict)
    return out.withColumn("accepted", (F.col("verdict") == "pass") | ((F.col("verdict") == "unknown") & F.lit(unknown == "accept")))


def evaluate_profile(measures: DataFrame, rules: DataFrame) -> DataFrame:
    """One check for each id and rule. ``measures`` is long (``id, measure, value``), ``rules`` (``rule, measure, low, high``, null: no bound) few rows.

    ``outcome`` is ``not_evaluated`` without a measured value, else ``pass`` within the inclusive bounds, else ``fail``.
    """
    ids = measures.select("id").distinct()
    checks = ids.crossJoin(F.broadcast(rules)).join(measures, ["id", "measure"], "left")
    ok = (F.col("low").isNull() | (F.col("value") >= F.col("low"))) & (F.col("high").isNull() | (F.col("value") <= F.col("high")))
    return checks.select("id", "rule", "measure", "value", F.when(F.col("value").isNull(), "not_evaluated").when(ok, "pass").otherwise("fail").alias("outcome"))


@dataclass
class Template:
    required_tags: list[str] = field(default_factory=list)
    forbidden_words: list[str] = field(default_factory=list)
    title_patterns: list[str] = field(default_factory=list)


def validate_listings(rows: DataFrame, template: Template | None = None, keys: str | None = None) -> DataFrame:
    """Adds ``issues`` and ``checked_status`` (``approved`` where an approved listing has none, else ``checked``; ``none`` stays). ``tags`` is an array; ``keys`` names a column with the keys that the listing came with, which must be title, description and tags; a title that another folder of the root has, regardless of case, is an issue of all but the first folder."""
    t = template or Template()
    title, text, tags = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("description", F.lit(""))), F.coalesce("tags", F.array().cast("array<string>"))
    clean = normalise_tags(tags)
    issue = lambda when, what: F.when(when, F.lit(what))
    own = Window.partitionBy("root_id", F.lower(title)).orderBy("folder")
    both = F.lower(F.concat_ws("\n", "title", "description"))
    checks = [
        issue(title == "", "title is empty"), issue(F.length("title") > TITLE_MAX, "title is too long"), issue(text == "", "description is empty"), issue((text != "") & (F.length("description") < DESCRIPTION_MIN), "description is too short"),
        issue((F.size(tags) != F.size(clean)) | (F.size(clean) != TAG_COUNT), "tags are not exactly the wanted number of unique ones"), issue((title != "") & (F.row_number().over(own) > 1), "title is used twice"),
    ]
    if keys:
        own_keys, three = F.array_distinct(F.col(keys)), F.array(*[F.lit(k) for k in ("description", "tags", "title")])
        extra, gone = F.array_sort(F.array_except(own_keys, three)), F.array_sort(F.array_except(three, own_keys))
        checks = [F.when(F.size(extra) > 0, F.concat(F.lit("unexpected keys "), F.array_join(extra, ", "))), F.when(F.size(gone) > 0, F.concat(F.lit("missing keys "), F.array_join(gone, ", "))), *checks]
    if t.required_tags:
        wanted = normalise_tags(F.array(*[F.lit(x) for x in t.required_tags]))
        checks.append(issue(F.size(F.array_except(wanted, clean)) > 0, "required tags are missing"))
    checks += [issue(F.contains(both, F.lit(w.strip().lower())), f"forbidden word {w.strip().lower()}") for w in t.forbidden_words if w.strip()]
    if t.title_patterns:
        hit = F.lit(False)
        for p in t.title_patterns:
            hit = hit | F.col("title").rlike(p)
        checks.append(issue((title != "") & ~hit, "title matches no pattern"))
    out = rows.withColumn("issues", F.array_compact(F.array(*checks)))
    status = F.when(F.col("status") == "none", "none").when((F.col("status") == "approved") & (F.size("issues") == 0), "approved").otherwise("checked")
    return out.withColumn("checked_status", status)


def export_catalog(folders: DataFrame, listings: DataFrame, assets: DataFrame, root_id: int | None = None, prefix: str | None = None) -> DataFrame:
    """``kind, key, title, members``: folder listings with a status and a title, with the ids of their assets, and asset listings with a title."""
    where = assets.withColumn("folder", F.split("rel_path", "/")[0])
    kept = folders.where((F.col("status") != "none") & (F.trim(F.coalesce("title", F.lit(""))) != ""))
    if root_id is not None:
        where, kept = where.where(F.col("root_id") == root_id), kept.where(F.col("root_id") == root_id)
    if prefix is not None:
        where, kept = where.where(F.startswith("folder", F.lit(prefix))), kept.where(F.startswith("folder", F.lit(prefix)))
    ids = where.groupBy("root_id", "folder").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members"))
    of_folders = kept.join(ids, ["root_id", "folder"], "left").select(F.lit("folder").alias("kind"), F.concat_ws("/", F.col("root_id").cast("string"), "folder").alias("key"), "title", F.coalesce("members", F.lit("")).alias("members"))
    own = listings.where(F.trim(F.coalesce("title", F.lit(""))) != "").join(where.select(F.col("id").alias("model_id")), "model_id", "left_semi")
    return of_folders.unionByName(own.select(F.lit("asset").alias("kind"), F.col("model_id").cast("string").alias("key"), "title", F.col("model_id").cast("string").alias("members")))


def prune(listings: DataFrame, assets: DataFrame) -> DataFrame:
    """Listings whose folder still has an asset."""
    return listings.join(assets.select("root_id", F.split("rel_path", "/")[0].alias("folder")), ["root_id", "folder"], "left_semi")


def approved_examples(folders: DataFrame, k: int = 3) -> DataFrame:
    """For each folder, the ``k`` newest other approved listings of its root (ties by folder)."""
    newest = Window.partitionBy("root_id").orderBy(F.desc("updated_at"), "folder")
    best = folders.where("status = 'approved'").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= k + 1).select("root_id", F.col("folder").alias("example"), F.col("updated_at").alias("at"))
    pairs = folders.select("root_id", "folder").join(best, "root_id").where("folder <> example")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("root_id", "folder").orderBy(F.desc("at"), "example"))).where(F.col("rank") <= k).select("root_id", "folder", "example", "rank")


def listing_worklist(folders: DataFrame) -> DataFrame:
    """Folders by what is missing: without a listing first, then drafts, checked, approved."""
    order = F.array_position(F.array(*[F.lit(s) for s in ("none", "draft", "checked", "approved")]), F.col("status"))
    return folders.withColumn("step", order.cast("int")).orderBy("step", "root_id", "folder")


def scan_diff(known: DataFrame, current: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``rel_path`` and ``change``: new, changed, touched (other time, same hash), unchanged (same size, times within a microsecond), retry (it failed before), skipped (over the limit) or removed."""
    k, c = known.alias("k"), current.alias("c")
    same = (F.col("k.size_bytes") == F.col("c.size_bytes")) & (F.abs(F.col("k.mtime") - F.col("c.mtime")) < 1e-6)
    big = F.col("c.size_bytes") > max_bytes if max_bytes is not None else F.lit(False)
    change = (
        F.when(F.col("c.rel_path").isNull(), "removed").when(big, "skipped").when(F.col("k.rel_path").isNull(), "new").when(F.col("k.status") == "error", "retry").when(same, "unchanged")
        .when(F.col("k.sha256") == F.col("c.sha256"), "touched").otherwise("changed")
    )
    return k.join(c, F.col("k.rel_path") == F.col("c.rel_path"), "full").select(F.coalesce("c.rel_path", "k.rel_path").alias("rel_path"), change.alias("change"))


def upsert_snapshot(table: DataFrame, current: DataFrame, owned: list[str]) -> DataFrame:
    """The next version of ``table``: measured columns of ``current``, and for the columns that users own those of ``table``. Removed rows go."""
    keep = table.select("rel_path", *[F.col(c).alias(f"_{c}") for c in owned], F.lit(True).alias("_known"))
    out = current.join(keep, "rel_path", "left")
    for c in owned:
        out = out.withColumn(c, F.when(F.col("_known"), F.col(f"_{c}")).otherwise(F.col(c)) if c in current.columns else F.col(f"_{c}"))
    return out.drop("_known", *[f"_{c}" for c in owned])


def json_or_default(col: Column, schema: T.DataType | str, default: Column) -> Column:
    """The parsed JSON, or the default where it's null or broken."""
    parsed = F.from_json(col, schema)
    return F.when(F.try_parse_json(col).isNull(), default).otherwise(F.coalesce(parsed, default))


def listing_markdown(rows: DataFrame) -> DataFrame:
    """One Markdown text for each listing: heading, description, tags."""
    return rows.select("root_id", "folder", F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("title")), "description", F.concat(F.lit("Tags: "), F.array_join("tags", ", "))).alias("markdown"))


def export_listings(rows: DataFrame, path: str, fmt: str, status: str | None = None) -> None:
    """Write listings as ``csv``, ``json`` or ``markdown`` (texts), many files in one folder."""
    rows = rows if status is None else rows.where(F.col("status") == status)
    if fmt == "markdown":
        listing_markdown(rows).select("markdown").write.text(path, lineSep="\n\n---\n\n")
    elif fmt == "json":
        rows.write.json(path)
    elif fmt == "csv":
        rows.withColumn("tags", F.array_join("tags", "|")).write.csv(path, header=True, escape='"')
    else:
        raise ValueError(f"unknown format {fmt}")
