"""Change sets (add, update, delete, reactivate) applied to keyed tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, text_key
from .validate import Rule, validate

ADD, UPDATE, DELETE, REACTIVATE = "Add", "Update", "Delete", "Reactivate"


@dataclass(frozen=True)
class ChangeSpec:
    """How changes meet a table.

    ``unique`` columns may not collide with another row (an active one when
    ``status`` is set); ``status`` makes Delete and Reactivate soft.
    """

    key: str
    columns: tuple[str, ...]
    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    unique_on_update: bool = True
    status: str | None = None
    sets: dict[str, Column] = field(default_factory=dict)


class Applied(NamedTuple):
    added: DataFrame
    changed: DataFrame
    deleted: DataFrame
    errors: DataFrame


def action_is(*names: str) -> Column:
    return F.lower(F.trim("actionType")).isin(*[n.lower() for n in names])


def _key(df: DataFrame, column: str) -> Column:
    return text_key(column) if df.schema[column].dataType.typeName() == "string" else F.col(column)


def flag_taken(changes: DataFrame, target: DataFrame, spec: ChangeSpec, bad: Column) -> DataFrame:
    """``_taken``: the unique columns belong to another row, or to an earlier change of the same batch.

    Only changes that no other rule rejects (``bad``) and that don't meet a stored row claim their key; the
    earliest claim has it, and later changes of another row are taken.
    """
    live = target if spec.status is None else target.where(F.col(spec.status).cast("int") == 1)
    names = [f"_u{i}" for i in range(len(spec.unique))]
    known = live.groupBy(*[_key(target, c).alias(n) for c, n in zip(spec.unique, names)]).agg(
        F.min(spec.key).alias("_lowKey"), F.max(spec.key).alias("_highKey"))

    def same(*columns: str) -> Column:
        return reduce(lambda a, b: a & b, [_key(changes, c) == F.col(n) for c, n in zip(spec.unique, columns)])
    add, update = action_is(ADD), action_is(UPDATE) & F.lit(spec.unique_on_update)
    other = (F.col("_lowKey") != F.col(spec.key)) | (F.col("_highKey") != F.col(spec.key))
    rows = changes.join(known, same(*names), "left").withColumn("_stored", F.coalesce(F.col("_lowKey").isNotNull() & (add | (update & other)), F.lit(False)))
    claims = rows.where((add | update) & ~F.coalesce(bad, F.lit(False)) & ~F.col("_stored"))
    claim = F.struct("changeId", F.when(update, F.col(spec.key)).alias("row"))
    claimed = [f"_v{i}" for i in range(len(spec.unique))]
    first = claims.groupBy(*[_key(changes, c).alias(n) for c, n in zip(spec.unique, claimed)]).agg(F.min(claim).alias("_first"))
    later = (add | update) & (F.col("_first.changeId") < F.col("changeId")) & ~F.coalesce(update & (F.col("_first.row") == F.col(spec.key)), F.lit(False))
    return rows.join(first, same(*claimed), "left").withColumn("_taken", F.col("_stored") | F.coalesce(later, F.lit(False))) \
        .drop(*names, *claimed, "_lowKey", "_highKey", "_stored", "_first")


def apply_changes(target: DataFrame, changes: DataFrame, spec: ChangeSpec, rules: list[Rule] = []) -> Applied:
    """Check and apply changes (changeId, actionType, key, columns ...).

    Rejected changes come back as errors.  When a batch changes a row more than
    once, the last change (highest changeId) counts.
    """
    have = {c.lower() for c in target.columns}
    columns = [c for c in spec.columns if c.lower() in have and c in changes.columns]
    exists = target.select(F.col(spec.key).alias("_tk"), F.lit(True).alias("_known"))
    rows = changes.join(exists, F.col(spec.key) == F.col("_tk"), "left").drop("_tk")
    checks = [Rule("Action {} is unknown", ~action_is(ADD, UPDATE, DELETE, REACTIVATE), F.col("actionType"))]
    if spec.required:
        missing = None
        for c in spec.required:
            missing = blank(c) if missing is None else missing | blank(c)
        checks.append(Rule(", ".join(spec.required) + " are required", action_is(ADD, UPDATE) & missing))
    missing_row = Rule("Row {} does not exist", ~action_is(ADD) & F.col("_known").isNull(), F.col(spec.key))
    if spec.unique:
        others = [F.coalesce(r.failed, F.lit(False)) for r in [*checks, missing_row, *rules]]
        rows = flag_taken(rows, target, spec, reduce(lambda a, b: a | b, others))
        checks.append(Rule("{} exists already", F.col("_taken"), F.concat_ws(" / ", *[F.col(c).cast("string") for c in spec.unique])))
    checks.append(missing_row)
    checked = validate(rows, [*checks, *rules], "changeId", ["changeId"])
    errors = checked.errors.select("changeId", "ruleNo", "rule", "key")
    good = checked.accepted
    added = good.where(action_is(ADD)).select("changeId", *columns, *[c.alias(n) for n, c in spec.sets.items()],
                                              *([F.lit(1).alias(spec.status)] if spec.status else []))
    packed = F.struct(F.col("actionType").alias("_action"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    last = good.where(~action_is(ADD)).groupBy(F.col(spec.key).alias("_tk")).agg(F.max_by(packed, F.col("changeId")).alias("_c"))
    hit = target.join(last, F.col(spec.key) == F.col("_tk")).select(*target.columns, "_c.*")
    action = F.lower("_action")
    new = {c: F.when(action == UPDATE.lower(), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in columns}
    if spec.status:
        kind = target.schema[spec.status].dataType
        new[spec.status] = F.when(action == DELETE.lower(), F.lit(0).cast(kind)).when(action == REACTIVATE.lower(), F.lit(1).cast(kind)).otherwise(F.col(spec.status))
        changed, deleted = hit, hit.limit(0)
    else:
        changed, deleted = hit.where(action != DELETE.lower()), hit.where(action == DELETE.lower())
    return Applied(added, changed.withColumns(new).select(*target.columns), deleted.select(*target.columns), errors)
