"""Rule checks over staged rows: accepted rows, errors, messages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, text_key
from .ordering import ordinal, shared_rows

# A message lists at most this many keys; further keys go to further parts of the message.
KEYS_PER_MESSAGE = 100


@dataclass(frozen=True)
class Rule:
    """A row fails when ``failed`` is true; ``{}`` in the message stands for the failing keys."""

    message: str
    failed: Column
    key: Column | None = None


class Checked(NamedTuple):
    accepted: DataFrame
    errors: DataFrame


def required(label: str, *columns: str) -> Rule:
    failed = blank(columns[0])
    for c in columns[1:]:
        failed = failed | blank(c)
    return Rule(f"{label} is required", failed)


def validate(df: DataFrame, rules: list[Rule], row_id: str, scope: list[str], strict: bool = True, carry: Sequence[str] = (), spent: Sequence[str] = ()) -> Checked:
    """All failing (row, rule) pairs in one pass over the rows.

    ``scope`` identifies a file.  Strict mode keeps no row of a file with an
    error; otherwise only the failing rows are left out.  ``ruleNo`` is the
    order in which the rules are listed.  Errors have the columns ``carry`` too; columns ``spent`` are
    for the rules alone and not among the accepted rows.
    """
    checks = F.array(*[F.struct(F.lit(i + 1).alias("ruleNo"), (r.key if r.key is not None else F.lit("")).cast("string").alias("key"), F.coalesce(r.failed, F.lit(False)).alias("failed")) for i, r in enumerate(rules)])
    # errors, accepted rows and all that is made from them start from these rows, so they are computed once; messages are not written with them
    failing = F.transform(F.filter(checks, lambda c: c["failed"]), lambda c: F.struct(c["ruleNo"].alias("ruleNo"), c["key"].alias("key")))
    flagged = shared_rows(df.withColumn("_failures", failing).drop(*spent))
    message = F.element_at(F.array(*[F.lit(r.message) for r in rules]), F.col("_f.ruleNo")).alias("rule")
    errors = flagged.select(*scope, row_id, *carry, F.explode("_failures").alias("_f")) \
        .select(*scope, row_id, *carry, "_f.ruleNo", message, "_f.key")
    clean = flagged.where(F.size("_failures") == 0).drop("_failures")
    if strict and scope != [row_id]:  # a row that is a scope of its own has nobody to fail for
        bad = flagged.where(F.size("_failures") > 0).select(*scope).distinct()
        clean = clean.join(bad, scope, "left_anti")
    return Checked(clean, errors)


def error_summary(errors: DataFrame, scope: list[str], first_rule_only: bool = False) -> DataFrame:
    """Messages per file and rule with the distinct keys.

    The keys of one rule may be a large part of the data, so a message is cut
    into numbered parts of ``KEYS_PER_MESSAGE`` keys; no key is left out.
    """
    keys = errors.select(*scope, "ruleNo", "rule", F.coalesce("key", F.lit("")).alias("key")).distinct()
    if first_rule_only:
        first = errors.groupBy(*scope).agg(F.min("ruleNo").alias("ruleNo"))
        keys = keys.join(first, [*scope, "ruleNo"], "left_semi")
    placed = ordinal(keys, ["key"], within=[*scope, "ruleNo"], name="_n")
    part = F.floor((F.col("_n") - 1) / KEYS_PER_MESSAGE).cast("int") + 1
    listed = F.array_join(F.array_sort(F.collect_list("key")), ",")
    return placed.groupBy(*scope, "ruleNo", "rule", part.alias("part")) \
        .agg(F.count(F.lit(1)).alias("keyCount"), listed.alias("_keys")) \
        .withColumn("message", F.replace("rule", F.lit("{}"), F.col("_keys"))).drop("_keys", "rule")


def first_errors(errors: DataFrame, scope: list[str]) -> DataFrame:
    """The message a load stops with: the first failing rule of each file."""
    return error_summary(errors, scope, first_rule_only=True)


def nested_error_summary(errors: DataFrame, scope: list[str], document: str) -> DataFrame:
    """Messages per file, rule and document with the distinct keys: 'keys (document)'.

    One document may hold a large part of the keys, so its message is cut into
    numbered parts of ``KEYS_PER_MESSAGE`` keys like those of ``error_summary``.
    """
    keys = errors.select(*scope, "ruleNo", "rule", F.coalesce(document, F.lit("")).alias(document), F.coalesce("key", F.lit("")).alias("key")).distinct()
    placed = ordinal(keys, ["key"], within=[*scope, "ruleNo", document], name="_n")
    part = F.floor((F.col("_n") - 1) / KEYS_PER_MESSAGE).cast("int") + 1
    listed = F.concat(F.array_join(F.array_sort(F.collect_list("key")), ","), F.lit(" ("), F.col(document), F.lit(")"))
    return placed.groupBy(*scope, "ruleNo", "rule", document, part.alias("part")) \
        .agg(F.count(F.lit(1)).alias("keyCount"), listed.alias("_keys")) \
        .withColumn("message", F.replace("rule", F.lit("{}"), F.col("_keys"))).drop("_keys", "rule")


def _keys(df: DataFrame, columns: list[str]) -> list[Column]:
    return [text_key(c) if df.schema[c].dataType.typeName() == "string" else F.col(c) for c in columns]


def repeats() -> Column:
    """Aggregate test: the key occurs more than once."""
    return F.count(F.lit(1)) > 1


def differs(column: str) -> Column:
    """Aggregate test: more than one distinct value (min and max need no distinct shuffle)."""
    return F.min(column) != F.max(column)


def exceeds(requested: str, open_qty: str) -> Column:
    """Aggregate test: asked for more, in all, than is open."""
    return F.sum(requested) > F.max(open_qty)


def flag_groups(df: DataFrame, checks: list[tuple[list[str], dict[str, Column]]], written: bool = False) -> DataFrame:
    """Mark rows whose group fails a test; ``checks`` are (group columns, {flag: aggregate test}).

    The rows are read once more per grouping; ``written`` writes them to the
    shared folder first, for rows that are costly to make.

    Each grouping is one map-side-combined aggregate over ``df`` itself, and only
    failing groups come back to be joined, so a large clean input joins with
    little, and a very large group is one row.
    """
    df = shared_rows(df) if written else df
    out = df
    for n, (group, tests) in enumerate(checks):
        keys = _keys(df, group)
        names = [f"_g{n}_{i}" for i in range(len(keys))]
        failing = df.groupBy(*[k.alias(g) for k, g in zip(keys, names)]).agg(*[F.coalesce(c, F.lit(False)).alias(f) for f, c in tests.items()])
        any_flag = reduce(lambda a, b: a | b, [F.col(f) for f in tests])
        cond = reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(g)) for k, g in zip(keys, names)])
        out = out.join(failing.where(any_flag), cond, "left").drop(*names) \
            .withColumns({f: F.coalesce(F.col(f), F.lit(False)) for f in tests})
    return out


def flag_rows(df: DataFrame, keys: DataFrame, on: list[str], out: str) -> DataFrame:
    """Mark the rows whose key is listed."""
    listed = keys.select(*[F.col(c).alias(f"_f{i}") for i, c in enumerate(on)]).distinct().withColumn(out, F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_f{i}")) for i, c in enumerate(on)])
    return df.join(listed, same, "left").withColumn(out, F.coalesce(out, F.lit(False))).drop(*[f"_f{i}" for i in range(len(on))])


def in_file_duplicates(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Mark rows whose key occurs more than once."""
    return flag_groups(df, [(columns, {out: repeats()})])


def single_value_per_group(df: DataFrame, group: list[str], column: str, out: str) -> DataFrame:
    """Mark rows of groups that hold more than one distinct value of ``column``."""
    return flag_groups(df, [(group, {out: differs(column)})])


def open_qty_guard(df: DataFrame, target: str, requested: str, open_qty: str, out: str, scope: list[str] | None = None) -> DataFrame:
    """Mark rows whose target is asked for more, in all, than is open."""
    return flag_groups(df, [([*(scope or []), target], {out: exceeds(requested, open_qty)})])
