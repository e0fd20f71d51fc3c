"""Running numbers and item codes, allocated for all documents at once.

One job is the single writer of a counter: it numbers its documents from the
counter's next value and returns the advanced counters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import lookup
from ..operators.ordering import ordinal, running_max


def padded(number: Column, width: int) -> Column:
    """At least ``width`` digits; longer numbers keep all their digits."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def allocate_numbers(documents: DataFrame, sequences: DataFrame, key: str, company: str, order_by: list[str], as_of, out: str) -> DataFrame:
    """Give each document the next running number of its company; NULL where no counter is set up."""
    counters = sequences.where(F.col("condition") == key)
    placed = ordinal(documents, order_by, within=[company], name="_n")
    placed = lookup(placed, counters, {company: "csID"}, _next="NextNum", _format="ItemFormat")
    number = padded(F.col("_next") + F.col("_n") - 1, 5)
    year = F.date_format(F.lit(as_of).cast("date"), "yy")
    return placed.withColumn(out, F.replace(F.replace("_format", F.lit("yy"), year), F.lit("xxxxx"), number)).drop("_n", "_next", "_format")


def advance_counters(documents: DataFrame, sequences: DataFrame, key: str, company: str) -> DataFrame:
    """Counters after ``documents`` took their numbers."""
    used = documents.groupBy(company).agg(F.count(F.lit(1)).alias("_used"))
    own = F.col("condition") == key
    return lookup(sequences, used, {"csID": company}, _used="_used") \
        .withColumn("NextNum", F.when(own, F.col("NextNum") + F.coalesce("_used", F.lit(0))).otherwise(F.col("NextNum"))).drop("_used")


def dated_numbers(documents: DataFrame, sequences: DataFrame, key: str, company: str, name: str, order_by: list[str], as_of, out: str) -> DataFrame:
    """Numbers with yyMMdd at the end; a name holding ')' passes on its prefix up to three characters after it."""
    placed = ordinal(documents, order_by, within=[company], name="_n")
    placed = lookup(placed, sequences.where(F.col("condition") == key), {company: "csID"}, _next="NextNum", _format="ItemFormat", _max="MaxNum")
    number = F.col("_next") + F.col("_n") - 1
    width = F.length(F.col("_max").cast("string"))
    text = F.when(number > F.col("_max"), number.cast("string")).otherwise(F.lpad(number.cast("string"), width, F.lit("0")))
    day = F.date_format(F.lit(as_of).cast("date"), "yyMMdd")
    bracket = F.instr(F.col(name), ")")
    prefix = F.when(bracket > 0, F.left(F.col(name), bracket + 3))
    plain = F.concat("_format", text, day)
    reused = F.concat(prefix, F.lit("-"), text, F.lit("-"), day)
    return placed.withColumn(out, F.when(prefix.isNull(), plain).otherwise(reused)).drop("_n", "_next", "_format", "_max")


def allocate_codes(requests: DataFrame, used: DataFrame, code: str, prefix: str, order_by: list[str], width: int,
                   counters: DataFrame | None = None, out: str = "newCode") -> DataFrame:
    """Free codes ``prefix.number`` for requests, skipping the codes in ``used``.

    Counting starts at 1, or at the ``NextNum`` that ``counters`` holds for the
    prefix.  The k-th request of a prefix takes its k-th free number.  How many
    used numbers lie below that is found by a running maximum over requests and
    used numbers laid out together, instead of testing numbers one by one.
    """
    shape = r"^(.*)\.([0-9]+)$"
    numbers = used.select(F.regexp_extract(code, shape, 1).alias("_p"), F.regexp_extract(code, shape, 2).try_cast("int").alias("_num")) \
        .where(F.col("_num").isNotNull()).distinct()
    asked = ordinal(requests.withColumn("_p", F.col(prefix)), order_by, within=["_p"], name="_k")
    if counters is not None:
        numbers = lookup(numbers, counters, {"_p": prefix}, _from="NextNum")
        asked = lookup(asked, counters, {"_p": prefix}, _from="NextNum")
    else:
        numbers, asked = numbers.withColumn("_from", F.lit(1)), asked.withColumn("_from", F.lit(1))
    numbers = numbers.withColumn("_from", F.coalesce("_from", F.lit(1))).where(F.col("_num") >= F.col("_from"))
    asked = asked.withColumn("_from", F.coalesce("_from", F.lit(1)))
    taken = ordinal(numbers, ["_num"], within=["_p"], name="_j")
    # (num - from) - (j - 1) numbers below the j-th used one are free: requests up to that position stay below it
    free_below = (F.col("_num") - F.col("_from") - F.col("_j") + 1).cast("long")
    shape_of_request = asked.select(F.struct("*").alias("s")).schema["s"].dataType
    marks = taken.select("_p", free_below.alias("_at"), F.lit(1).alias("_side"), F.col("_j").alias("_step"), F.lit(None).cast(shape_of_request).alias("_request"))
    asks = asked.select("_p", F.col("_k").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("long").alias("_step"), F.struct("*").alias("_request"))
    laid = running_max(marks.unionByName(asks), ["_at", "_side", "_step"], ["_p"], _skipped=F.col("_step"))
    got = laid.where(F.col("_side") == 0).select("_request.*", F.coalesce("_skipped", F.lit(0)).alias("_skipped"))
    number = F.col("_from") + F.col("_k") - 1 + F.col("_skipped")
    return got.withColumn(out, F.concat(F.col(prefix), F.lit("."), padded(number, width))).drop("_k", "_skipped", "_from", "_p")
