"""Names every query of the package and its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import curation, evaluation, export, filtering, manifests, masking, photos, sweeps

FLAGSHIP = "grid_metrics"
MODULES = (evaluation, curation, sweeps, masking, photos, filtering, export, manifests)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
