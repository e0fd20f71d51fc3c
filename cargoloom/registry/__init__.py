"""Named queries over a star-schema directory, each with its DuckDB counterpart.

A query is a function of ``Tables``; its oracle is SQL over the same views,
written independently of the DataFrame code.  Dates and timestamps leave both
sides as ISO text so that the two engines' values compare byte for byte.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.erp_views import plain_names, with_views
from ..sources.tables import StarSchemaTables, Tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, build: Callable[[Tables], DataFrame], oracle: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name] = build
    if oracle is not None:
        _ORACLES[name] = plain_names(with_views(oracle))


def portable(df: DataFrame) -> DataFrame:
    """Dates, timestamps and decimals as text; everything else as is."""
    def out(f):
        kind = f.dataType.typeName()
        return F.col(f"`{f.name}`").cast("string").alias(f.name) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(f"`{f.name}`")
    return df.select(*[out(f) for f in df.schema.fields])


_OPEN: dict[tuple[str, str], StarSchemaTables] = {}


def _tables(spark: SparkSession, directory: str) -> StarSchemaTables:
    """The tables of a directory; a view is parsed once per application, not once per query."""
    key = (spark.sparkContext.applicationId, directory)
    if key not in _OPEN:
        _OPEN[key] = StarSchemaTables(spark, directory)
    return _OPEN[key]


def _runner(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, directory: portable(build(_tables(spark, directory)))


def _load() -> None:
    from importlib import import_module
    from pkgutil import iter_modules
    for module in iter_modules(__path__):
        import_module(f"{__name__}.{module.name}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: _runner(build) for name, build in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
