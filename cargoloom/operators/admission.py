"""Which requests a stock can serve, taken one after the other, without a loop over requests.

A request needs quantities of several keys and is accepted only if each of them fits what the accepted requests before it have
left; a rejected one holds nothing.  Taken literally that is one request at a time.  Here all requests are judged
in rounds: a request is accepted for sure if it fits even when everything undecided before it is accepted, and rejected for sure if it
doesn't fit even when all of that is rejected.  The first undecided request of all is always settled, so rounds end, and each round settles
whole runs of requests of all keys at once.  What stands before a request is a running total, so a key that
much of the demand wants is spread over tasks.  Keys whose whole demand fits leave before the first round.

The rounds are jobs: this is the one operator that runs while a plan is built.  Its rows are (request, key, quantity) of contested keys, written to the
shared folder after each round.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import running_totals, shared_root, shuffles_dropped


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_root(df.sparkSession)}/admission-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _remove(df: DataFrame, path: str) -> None:
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def unserved(demand: DataFrame, request: str, order: str, key: Sequence[str], need: str, limit: str, barred: DataFrame | None = None) -> DataFrame:
    """(request, key ...) of what is short when its request's turn comes; a request with any such row is rejected.

    ``demand`` has any number of rows per request and key; ``order`` is a number per request (the smallest of its rows counts,
    ties go by request), ``limit`` what the key has, null counting as nothing.  A negative ``need`` gives back.  Requests in ``barred`` (column
    ``request``) are rejected for another reason: they hold nothing, and are still told what they lack.
    """
    key = list(key)
    first = demand.groupBy(request).agg(F.min(order).alias("_order"))
    rows = demand.groupBy(request, *key).agg(F.sum(need).cast("long").alias("_need"), F.max(F.coalesce(limit, F.lit(0))).cast("long").alias("_limit")).join(first, request)
    if barred is None:
        rows = rows.withColumn("_ok", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(barred.select(F.col(request).alias("_barred")).distinct(), F.col(request) == F.col("_barred"), "left") \
            .withColumn("_ok", F.when(F.col("_barred").isNotNull(), False)).drop("_barred")
    most = F.sum(F.greatest(F.col("_need"), F.lit(0)))
    contested = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg((most > F.max("_limit")).alias("_contested")).where("_contested")
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    state, path = _written(rows.join(contested, same, "left_semi"))
    left = state.where("_ok IS NULL").count()
    before = lambda total, own: F.col(total) - F.col(own)
    while left:
        yes, undecided = F.coalesce("_ok", F.lit(False)), F.col("_ok").isNull()
        sized = state.withColumns({"_most": F.when(yes, F.col("_need")).when(undecided, F.greatest("_need", F.lit(0))).otherwise(0),
                                   "_fewest": F.when(yes, F.col("_need")).when(undecided, F.least("_need", F.lit(0))).otherwise(0)})
        laid = running_totals(sized, ["_order", request], key, _hi=F.col("_most"), _lo=F.col("_fewest"))
        fits, fails = F.col("_need") + before("_hi", "_most") <= F.col("_limit"), F.col("_need") + before("_lo", "_fewest") > F.col("_limit")
        verdict = laid.where(undecided).groupBy(F.col(request).alias("_r")).agg(F.when(F.bool_or(fails), False).when(F.bool_and(fits), True).alias("_verdict"))
        moved, new = _written(state.join(verdict, F.col(request) == F.col("_r"), "left").withColumn("_ok", F.coalesce("_ok", "_verdict")).drop("_r", "_verdict"))
        _remove(state, path)
        state, path = moved, new
        left = state.where("_ok IS NULL").count()
    taken = state.withColumn("_used", F.when(F.col("_ok"), F.col("_need")).otherwise(0))
    laid = running_totals(taken, ["_order", request], key, _upto=F.col("_used"))
    return laid.where(F.col("_need") + before("_upto", "_used") > F.col("_limit")).select(request, *key)
