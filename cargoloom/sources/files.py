"""Staged upload files in, file-shaped exports and published table versions out."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_staged(spark: SparkSession, path: str, columns: list[str], file_column: str = "fileLoaded") -> DataFrame:
    """CSV upload files as text columns plus the name of the file each row came from."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.schema(schema).option("header", True).csv(path)
    return rows.withColumn(file_column, F.element_at(F.split(F.input_file_name(), "/"), -1))


def write_template(df: DataFrame, path: str) -> None:
    """File-shaped export: CSV with a header line."""
    df.write.mode("overwrite").option("header", True).csv(path)


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def publish(spark: SparkSession, root: str, outputs: Mapping[str, DataFrame], version: str | None = None) -> str:
    """Write all outputs of one operation as a new version, then point readers at it.

    Readers see the old version until every table is written; a job that fails
    or is repeated leaves the pointer as it was.
    """
    version = version or uuid.uuid4().hex
    for name, df in outputs.items():
        df.write.mode("overwrite").parquet(f"{root}/versions/{version}/{name}")
    fs, path = _filesystem(spark, root)
    fresh, current = path(f"{root}/CURRENT.{version}"), path(f"{root}/CURRENT")
    stream = fs.create(fresh, True)
    stream.write(bytearray(version, "utf-8"))
    stream.close()
    # one rename that replaces the pointer, so there is no moment without one
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(options, 1)
    how[0] = options.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fresh, current, how)
    return version


def current_version(spark: SparkSession, root: str) -> str | None:
    fs, path = _filesystem(spark, root)
    return spark.read.text(f"{root}/CURRENT").first()[0] if fs.exists(path(f"{root}/CURRENT")) else None


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of the published version."""
    return spark.read.parquet(f"{root}/versions/{current_version(spark, root)}/{name}")
