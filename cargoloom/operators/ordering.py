"""Global and per-group numbering and running totals without a single-task window.

A plain window puts a whole group (or the whole table) into one task.  Here only the columns that
numbering needs are range-partitioned on (group, order), so a hot group spreads over as
many ranges as its size needs; each range is numbered on its own, the totals of
earlier ranges, one row per group and range, are added, and the result is joined back by those columns.  The
narrow rows are written to the shared checkpoint folder first, by a job of their own: range borders come from sampling, so
they must be computed once only, also when an executor is lost later, and a plan that numbers several times would
otherwise hold its input as many times over.  What is written does not grow with the width of the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_kept: list[DataFrame] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, one in the warehouse, which all executors reach as well."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def computed_once(df: DataFrame) -> DataFrame:
    """``df`` for several readers: computed when the first of them runs, and again in part when an executor is lost.

    A mark of its own keeps Spark from taking these rows for a later query over files that have changed.
    """
    once = df.withColumn("_once", F.lit(uuid.uuid4().hex)).persist()
    _kept.append(once)
    return once.drop("_once")


#: Spark's setting for dropping the shuffle files of a query when it ends, instead of when the driver collects its garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries made within go when they end; for rows that are read back from the shared folder alone."""
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_END) if before is None else spark.conf.set(SHUFFLES_END, before)


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``; for a few narrow columns."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_root(spark))
    with shuffles_dropped(spark):
        return df.select(*[F.col(f"`{c}`") for c in df.columns]).checkpoint(eager=True)  # a query of its own: those made before don't drop theirs


def shared_rows(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder as compressed columns and read back, for wide rows with several readers.

    The files know the columns by place, as names may differ by case alone; a column without a type can't be written
    so, and such rows are checkpointed.
    """
    if any("void" in f.dataType.simpleString() for f in df.schema):
        return shared_checkpoint(df)
    path, places = f"{shared_root(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}", StructType()
    for i, f in enumerate(df.schema):
        places.add(f"c{i}", f.dataType)
    with shuffles_dropped(df.sparkSession):
        df.toDF(*places.names).write.parquet(path)
    return df.sparkSession.read.schema(places).parquet(path).toDF(*df.columns)


def removed_rows(*spent: DataFrame) -> None:
    """Delete what ``shared_rows`` has written, when all that is made from it has been written too."""
    for df in spent:
        for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Forget what ``computed_once`` has kept; to be called when the results are written."""
    while _kept:
        _kept.pop().unpersist()


def all_true(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _running(df: DataFrame, order_by: Sequence[str | Column], within: Sequence[str], columns: dict[str, Column],
             fold: Callable[[str], Column], combine: Callable[[Column, Column], Column], apart: bool = False) -> DataFrame:
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    groups, orders, n = [f"__g{i}" for i in range(len(within))], [f"__o{i}" for i in range(len(order))], range(len(columns))
    # rows that are equal in all these columns share their total, so each of them is one row here
    narrow = df.select(*[F.col(c).alias(g) for c, g in zip(within, groups)], *[value_of(c).alias(o) for c, o in zip(order, orders)], *[c.alias(f"_v{i}") for i, c in enumerate(columns.values())]) \
        .groupBy(*groups, *orders).agg(*[fold(f"_v{i}").alias(f"_v{i}") for i in n])
    sort = [*groups, *[directed(c, F.col(o)) for c, o in zip(order, orders)]]
    ranged = shared_rows(narrow.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_pos", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_pos", 33))

    upto = Window.partitionBy("_part", *groups).orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumns({f"_l{i}": fold(f"_v{i}").over(upto) for i in n})

    # One row per (group, range): a group has at most as many rows here as there are
    # ranges, and only groups that cross a border carry anything over.
    chunk = ranged.groupBy("_part", *groups).agg(*[fold(f"_v{i}").alias(f"_s{i}") for i in n])
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = (chunk.withColumns({**{f"_c{i}": fold(f"_s{i}").over(before) for i in n}, "_earlier": F.count(F.lit(1)).over(before)})
             .where(F.col("_earlier") > 0)
             .select(F.col("_part").alias("_cpart"), *[F.col(g).alias(f"__c{g}") for g in groups], *[f"_c{i}" for i in n]))
    met = all_true([F.col("_part") == F.col("_cpart")] + [F.col(g).eqNullSafe(F.col(f"__c{g}")) for g in groups])
    ties = apart and not ranged.where("_v0 > 1").isEmpty()
    ranks = local.join(carry, met, "left").select(*groups, *orders, *[combine(F.col(f"_l{i}"), F.col(f"_c{i}")).alias(f"__r{i}") for i in n], *([F.col("_v0").alias("__same")] if ties else []))
    back = all_true([F.col(c).eqNullSafe(F.col(g)) for c, g in zip(within, groups)] + [value_of(c).eqNullSafe(F.col(o)) for c, o in zip(order, orders)])
    joined = df.join(ranks, back)
    if ties:  # rows that are equal in the whole order follow each other by their contents
        twins = Window.partitionBy(*groups, *orders).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
        joined = joined.withColumn("__r0", F.col("__r0") - F.col("__same") + F.row_number().over(twins))
    return joined.select(*df.columns, *[F.col(f"__r{i}").alias(name) for i, name in enumerate(columns)])


class Falling:
    """Order by a column from its largest value down, nulls last."""

    def __init__(self, column: str | Column) -> None:
        self.column = F.col(column) if isinstance(column, str) else column


def value_of(order: Column | Falling) -> Column:
    return order.column if isinstance(order, Falling) else order


def directed(order: Column | Falling, column: Column) -> Column:
    return column.desc() if isinstance(order, Falling) else column.asc()


def running_totals(df: DataFrame, order_by: Sequence[str | Column | Falling], within: Sequence[str] = (), **sums: Column) -> DataFrame:
    """Add running sums in ``order_by`` order, restarting per ``within`` group.

    ``order_by`` ends in a unique key, so that the order is total; rows that are equal in all of it get the sum with all of them.
    """
    return _running(df, order_by, within, sums, F.sum, lambda here, earlier: here + F.coalesce(earlier, F.lit(0)))


def running_max(df: DataFrame, order_by: Sequence[str | Column | Falling], within: Sequence[str] = (), **values: Column) -> DataFrame:
    """Add running maxima (of any orderable column, structs included); NULLs are skipped."""
    return _running(df, order_by, within, values, F.max, lambda here, earlier: F.greatest(here, earlier))


def ordinal(df: DataFrame, order_by: Sequence[str | Column | Falling], within: Sequence[str] = (), name: str = "rowNo") -> DataFrame:
    """Gap-free 1-based position of each row, per group when ``within`` is given."""
    return _running(df, order_by, within, {name: F.lit(1).cast("long")}, F.sum, lambda here, earlier: here + F.coalesce(earlier, F.lit(0)), apart=True)
