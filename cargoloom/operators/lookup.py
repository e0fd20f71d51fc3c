"""Look-ups: code -> name, name -> id, rate on a date, setting with fallback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_key


# Copies of each rate that the rows it applies to are dealt out over.
RATE_COPIES = 512


def keep_if(df: DataFrame, column: str, value) -> DataFrame:
    """Equality filter applied only when the value is set (None, 0 and '' mean all rows)."""
    return df if value in (None, 0, "") else df.where(F.col(column) == F.lit(value))


def between_if(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Closed range on a column; each bound applies only when set, so it can reach the scan."""
    if low is not None:
        df = df.where(F.col(column) >= F.lit(low).cast(df.schema[column].dataType))
    if high is not None:
        df = df.where(F.col(column) <= F.lit(high).cast(df.schema[column].dataType))
    return df


def lookup(df: DataFrame, dim: DataFrame, on: dict[str, str], how: str = "left", **out: str | Column) -> DataFrame:
    """Add ``out`` columns of ``dim`` (unique on its ``on`` columns) to ``df``.

    No broadcast hint: the optimizer broadcasts a side only below its measured
    size threshold and sort-merges (with skew splitting) above it.
    """
    keys = [F.col(dc).alias(f"_on{i}") for i, dc in enumerate(on.values())]
    vals = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in out.items()]
    side = dim.select(*keys, *vals)
    cond = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_on{i}") for i, c in enumerate(on)])
    return df.join(side, cond, how).drop(*[f"_on{i}" for i in range(len(on))])


def code_name(df: DataFrame, codes: DataFrame, code: str, out: str, how: str = "left") -> DataFrame:
    """Name of a dictionary code."""
    return lookup(df, codes, {code: "categoryId"}, how, **{out: "categoryName"})


def resolve(df: DataFrame, dim: DataFrame, on: dict[str, str], pick: str, **out: str) -> DataFrame:
    """Name -> id look-up: case-insensitive on text keys, one match per row.

    When several dimension rows share the key, the one with the lowest ``pick``
    wins.  The choice is an aggregate (combined map-side), so a key shared by
    a large part of the dimension is not collected into one task.
    """
    text = {f.name for f in dim.schema.fields if f.dataType.typeName() == "string"}

    def key(c: str, is_text: bool) -> Column:
        return text_key(c) if is_text else F.col(c)

    dim_keys = [key(dc, dc in text).alias(f"_on{i}") for i, dc in enumerate(on.values())]
    vals = F.struct(*[F.col(v).alias(k) for k, v in out.items()])
    side = (dim.select(*dim_keys, F.col(pick).alias("_pick"), vals.alias("_vals"))
            .groupBy(*[f"_on{i}" for i in range(len(on))])
            .agg(F.min_by("_vals", "_pick").alias("_vals")))
    cond = reduce(lambda a, b: a & b,
                  [key(c, dc in text) == F.col(f"_on{i}") for i, (c, dc) in enumerate(on.items())])
    joined = df.join(side, cond, "left").drop(*[f"_on{i}" for i in range(len(on))])
    return joined.select("*", *[F.col(f"_vals.{k}").alias(k) for k in out]).drop("_vals")


def config_value(df: DataFrame, config: DataFrame, company: str, name: str, out: str) -> DataFrame:
    """Company setting, or the company-0 setting where the company has none."""
    named = config.where(text_key("configName") == name.lower())
    own = named.where(F.col("companyId") != 0).groupBy("companyId").agg(F.min_by("configValue", "configId").alias("v"))
    common = named.where(F.col("companyId") == 0).agg(F.min_by("configValue", "configId").alias("v"))
    df = lookup(df, own, {company: "companyId"}, _own="v")
    return df.withColumn(out, F.coalesce(F.col("_own"), common.scalar())).drop("_own")


def rate_at(df: DataFrame, rates: DataFrame, company: str, home: str, foreign: str, on_date: str, out: str = "rate") -> DataFrame:
    """Rate valid on a date for the company and currency pair; newest rate id when periods overlap.

    The (company, pair, date) combinations are de-duplicated before the range
    join, so the join works on distinct dates of a pair rather than on rows; the
    result is an equi-join back.  Few combinations may have all rows, so the rows of one
    are dealt out over RATE_COPIES copies of its rate.  NULL means no valid rate.
    """
    active = rates.where(F.col("status") == 1).select(
        F.col("companyId").alias("_c"), F.col("homeCurrency").alias("_h"), F.col("foreignCurrency").alias("_f"),
        "startDate", "endDate", "foreignRate", "rateId")
    combos = df.select(F.col(company).alias("_qc"), F.col(home).alias("_qh"), F.col(foreign).alias("_qf"),
                       F.col(on_date).alias("_qd")).distinct()
    chosen = (combos.join(active, (F.col("_qc") == F.col("_c")) & (text_key("_qh") == text_key("_h"))
                          & (text_key("_qf") == text_key("_f"))
                          & F.col("_qd").between(F.col("startDate"), F.col("endDate")))
              .groupBy("_qc", "_qh", "_qf", "_qd").agg(F.max_by("foreignRate", "rateId").alias(out))
              .withColumn("_qn", F.explode(F.sequence(F.lit(0), F.lit(RATE_COPIES - 1)))))
    turn = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(RATE_COPIES)).cast("int")
    same = ((F.col(company) == F.col("_qc")) & (F.col(home) == F.col("_qh"))
            & (F.col(foreign) == F.col("_qf")) & (F.col(on_date) == F.col("_qd")) & (turn == F.col("_qn")))
    return df.join(chosen, same, "left").drop("_qc", "_qh", "_qf", "_qd", "_qn")


def pivot_attributes(attributes: DataFrame, item: str, name: str, value: str, names: list[str]) -> DataFrame:
    """Attribute rows -> one row per item with a column per fixed name (matched case-insensitively)."""
    return attributes.groupBy(item).agg(*[F.max(F.when(text_key(name) == n.lower(), F.col(value))).alias(n) for n in names])
