"""Sort by a chosen column, number the rows and cut one page."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import Falling, all_true, computed_once, directed, value_of


def sort_columns(df: DataFrame, sort_map: Mapping[int, str], sort_by: int, direction: str, key: Sequence[str]) -> list[Column | Falling]:
    """Chosen column in the chosen direction, then the unique key; text sorts case-insensitively."""
    name = sort_map[sort_by]
    is_text = df.schema[name].dataType.typeName() == "string"
    c = F.lower(F.col(name)) if is_text else F.col(name)
    return [Falling(c) if direction.upper() == "DESC" else c, *[F.col(k) for k in key]]


def _page(df: DataFrame, order: Sequence[Column | Falling], row_start: int, page_rows: int) -> DataFrame:
    """The page with ``rowNo`` and ``totalRecord``.

    The columns of the order alone are dealt out by range and counted; only ranges that hold the page are sorted and numbered, and
    their rows are looked up by the order's columns.  A page costs the same wherever it stands.  Rows that are equal in the whole
    order follow each other by their contents.
    """
    last = row_start + page_rows - 1
    names = [f"__o{i}" for i in range(len(order))]
    sort = [directed(c, F.col(n)) for c, n in zip(order, names)]
    ranged = computed_once(df.select(*[value_of(c).alias(n) for c, n in zip(order, names)]).repartitionByRange(*sort).withColumn("__part", F.spark_partition_id()))
    # one row: a count per range
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).agg(F.array_sort(F.collect_list(F.struct("__part", "n"))).alias("c"))
    upto = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    ranges = counts.select(F.inline(F.transform("c", lambda x, i: F.struct(
        x["__part"].alias("__at"), upto(F.slice("c", F.lit(1), i)).alias("__before"), x["n"].alias("__rows"), upto(F.col("c")).alias("totalRecord")))))
    holding = ranges.where((F.col("__before") < last) & (F.col("__before") + F.col("__rows") >= row_start))
    keys = ranged.join(holding, F.col("__part") == F.col("__at")).groupBy("__part", "__before", "totalRecord", *names).agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy("__part").orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("__first", F.col("__before") + F.coalesce(F.sum("__n").over(along), F.lit(0)))
    keys = keys.where((F.col("__first") < last) & (F.col("__first") + F.col("__n") >= row_start)).select(*names, "__first", "totalRecord")
    rows = df.join(keys, all_true([value_of(c).eqNullSafe(F.col(n)) for c, n in zip(order, names)]))
    twins = Window.partitionBy(*names).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return rows.withColumn("rowNo", F.col("__first") + F.row_number().over(twins)).where(F.col("rowNo").between(row_start, last)).select(*df.columns, "rowNo", "totalRecord")


def cut_page(df: DataFrame, order: Sequence[Column | Falling], row_start: int = 1, page_rows: int = 50) -> DataFrame:
    """Rows ``row_start .. row_start + page_rows - 1`` with their ``rowNo``."""
    return _page(df, order, row_start, page_rows).drop("totalRecord")


def paged_listing(df: DataFrame, sort_map: Mapping[int, str], sort_by: int, direction: str, key: Sequence[str],
                  row_start: int = 1, page_rows: int = 50) -> DataFrame:
    """One page of ``df`` plus ``rowNo`` and the count of all listed rows as ``totalRecord``."""
    return _page(df, sort_columns(df, sort_map, sort_by, direction, key), row_start, page_rows)
