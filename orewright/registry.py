"""Names, queries and SQL of the library's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def register(name: str, query: Query, oracle: str | None = None) -> None:
    """Add a query under a new name; ``oracle`` is its DuckDB SQL."""
    if name in _queries:
        raise ValueError(f"{name} is registered twice")
    _queries[name] = query
    if oracle is not None:
        _oracles[name] = oracle


def _load() -> None:
    from orewright.cases import catalogue, entities, extract, records, shapes, sources, spatial, text  # noqa: F401  they register their queries


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest distinct assets with copies, near-duplicate group, and how many assets share their format."""
    from pyspark.sql import functions as F

    from orewright.fixtures import Inputs
    from orewright.operators import catalogue as c

    assets = Inputs(spark, sf_dir).assets
    top = c.fold_distinct(assets, "-size", 10)
    groups = c.near_groups(assets).select(F.col("node").alias("id"), F.col("label").alias("near_group"))
    formats = assets.groupBy("format").agg(F.count("*").alias("of_format"))
    return top.join(groups, "id", "left").join(formats, "format").select("id", "name", "format", "size_bytes", "copies", "near_group", "of_format")
