"""Each operator over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from orewright.fixtures import Inputs, oracle
from orewright.registry import register


def case(name: str, build: Callable[[Inputs], DataFrame], sql: str | None = None) -> None:
    """Register ``build`` over the inputs of a folder; ``sql`` may name the views of :mod:`orewright.fixtures`."""
    register(name, lambda spark, sf_dir: build(Inputs(spark, sf_dir)), oracle(sql) if sql else None)
