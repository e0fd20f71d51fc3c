"""Named-table access shared by every operator.

An operator takes a ``Tables`` and never cares whether a table is a Parquet
file, a derived view or a hand-made frame.  Tables resolve lazily, so a query
scans only what it touches.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .erp_views import DRIVER_TABLES, VIEWS, with_views

_schemas: dict[str, StructType] = {}


class Tables:
    """Case-insensitive attribute access to named DataFrames."""

    def __init__(self, frames: Mapping[str, DataFrame]):
        self._frames = {k.lower(): v for k, v in frames.items()}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.get(name)

    def get(self, name: str) -> DataFrame:
        try:
            return self._frames[name.lower()]
        except KeyError:
            raise KeyError(f"no table named {name}") from None

    def replace(self, **frames: DataFrame) -> "Tables":
        """The same tables with some of them exchanged."""
        return Overlay(self, frames)


class Overlay(Tables):
    """Tables laid over other tables."""

    def __init__(self, base: Tables, frames: Mapping[str, DataFrame]):
        super().__init__(frames)
        self._base = base

    def get(self, name: str) -> DataFrame:
        return self._frames[name.lower()] if name.lower() in self._frames else self._base.get(name)


class StarSchemaTables(Tables):
    """The order-to-shipment tables over a directory of star-schema Parquet files."""

    def __init__(self, spark: SparkSession, directory: str):
        super().__init__({})
        self._spark, self._dir = spark, directory.rstrip("/")
        self._canonical = {n.lower(): n for n in VIEWS}

    def get(self, name: str) -> DataFrame:
        key = name.lower()
        if key not in self._frames:
            self._frames[key] = self._read(key) if key in DRIVER_TABLES else self._derive(key)
        return self._frames[key]

    def _read(self, name: str) -> DataFrame:
        path = f"{self._dir}/{name}.parquet"
        reader = self._spark.read
        # a file's columns are looked up once; later plans are built without a job
        if path not in _schemas:
            _schemas[path] = reader.parquet(path).schema
        return reader.schema(_schemas[path]).parquet(path)

    def _derive(self, key: str) -> DataFrame:
        if key not in self._canonical:
            raise KeyError(f"no table named {key}")
        return self.sql(f"SELECT * FROM {self._canonical[key]}")

    def sql(self, text: str) -> DataFrame:
        """Run a text over the views and the ``{driver}`` tables."""
        text = with_views(text)
        used = {t: self.get(t) for t in DRIVER_TABLES if "{" + t + "}" in text}
        return self._spark.sql(text, **used)
