"""Stock ledger, balances, locks and quantity roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running_totals

BALANCE_KEY = ["warehouseId", "companyId", "invId"]


def signed_qty(action: str = "action", qty: str = "qty", out_actions: tuple[str, ...] = ("SHIP",)) -> Column:
    """Quantity with the sign it has on stock."""
    return F.when(F.upper(action).isin(*out_actions), -F.col(qty)).otherwise(F.col(qty))


def ledger_apply(movements: DataFrame, balances: DataFrame, locks: DataFrame | None = None) -> DataFrame:
    """Balances after signed movements (``qty``) and lock changes (``lockQty``); missing pairs are added.

    Movements are summed per pair before they meet the balances (map-side first),
    so a hot item costs one row in the join.
    """
    delta = movements.groupBy(*BALANCE_KEY).agg(F.sum("qty").alias("_qty"))
    if locks is not None:
        lock = locks.groupBy(*BALANCE_KEY).agg(F.sum("lockQty").alias("_lock"))
        delta = delta.join(lock, BALANCE_KEY, "full_outer")
    else:
        delta = delta.withColumn("_lock", F.lit(0).cast("long"))
    zero = F.lit(0)
    merged = balances.select(*BALANCE_KEY, "balanceQty", "lockQty").join(delta, BALANCE_KEY, "full_outer")
    return merged.select(*BALANCE_KEY, (F.coalesce("balanceQty", zero) + F.coalesce("_qty", zero)).alias("balanceQty"),
                         (F.coalesce("lockQty", zero) + F.coalesce("_lock", zero)).alias("lockQty"))


def balances_of(movements: DataFrame) -> DataFrame:
    """Balance per warehouse, company and item as the sum of the ledger."""
    return movements.groupBy(*BALANCE_KEY).agg(F.sum("qty").alias("balanceQty"))


def running_balance(movements: DataFrame, at: str = "enterDate", key: str = "inventoryMovementId") -> DataFrame:
    """Balance of the pair after each movement, as ``whBalanceQty``; a pair of any size is spread over tasks."""
    return running_totals(movements, [at, key], BALANCE_KEY, whBalanceQty=F.col("qty").cast("long"))


def roll_up_qty(lines: DataFrame, changes: DataFrame, key: str, column: str, delta: str, sign: int = 1, changes_key: str | None = None) -> DataFrame:
    """Add (or take off) the summed change per line on a quantity column; other lines stay as they are."""
    sums = changes.groupBy(F.col(changes_key or key).alias("_rk")).agg(F.sum(delta).alias("_delta"))
    return lines.join(sums, F.col(key) == F.col("_rk"), "left") \
        .withColumn(column, (F.col(column) + sign * F.coalesce("_delta", F.lit(0))).cast(lines.schema[column].dataType)).drop("_rk", "_delta")


def all_lines_in(lines: DataFrame, key: str, status: str, states: tuple[int, ...], out: str = "complete") -> DataFrame:
    """Per header: every line is in one of the states."""
    return lines.groupBy(key).agg(F.bool_and(F.col(status).isin(*states)).alias(out))


def reserve(locks: DataFrame, requests: DataFrame) -> DataFrame:
    """Locks after requests: each request states the new locked quantity, the difference is what is added."""
    key = ["companyId", "soLineItemId", "warehouseId", "invId"]
    old = locks.groupBy(*key).agg(F.sum(F.col("lockQty") - F.col("releaseQty")).alias("_old"))
    return requests.join(old, key, "left").withColumn("lockDelta", F.col("newLockQty") - F.coalesce("_old", F.lit(0))).drop("_old")


def release(locks: DataFrame, shipped: DataFrame) -> DataFrame:
    """Locks released by shipped quantity per order line, never beyond what is locked."""
    used = shipped.groupBy(F.col("soLineItemId").alias("_line")).agg(F.sum("qty").alias("_qty"))
    return locks.join(used, F.col("soLineItemId") == F.col("_line"), "left") \
        .withColumn("releaseQty", F.least(F.col("lockQty"), F.col("releaseQty") + F.coalesce("_qty", F.lit(0)))).drop("_line", "_qty")
