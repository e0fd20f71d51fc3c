"""Rows from JSON payload text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_payload(df: DataFrame, column: str, fields: dict[str, str], path: str | None = None, nested: dict[str, dict[str, str]] | None = None,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed rows of a JSON list at ``path``, of a bare list, or of one bare object.

    ``fields`` maps names to Spark types.  Values are read as text and then
    cast, so a quoted number counts as a number and a bad one becomes NULL.
    ``nested`` names list fields inside each row; they are exploded in turn.
    """
    nested = nested or {}

    def fields_of(names: dict[str, str]) -> str:
        return ", ".join(f"`{n}`: string" for n in names)

    lists = "".join(f", `{n}`: array<struct<{fields_of(f)}>>" for n, f in nested.items())
    row = f"struct<{fields_of(fields)}{lists}>"
    text = F.trim(F.col(column))
    as_list = F.from_json(text, f"array<{row}>")
    as_object = F.array(F.from_json(text, row))
    rows = F.when(text.startswith("["), as_list).otherwise(as_object)
    if path is not None:
        rows = F.coalesce(F.from_json(text, f"struct<`{path}`: array<{row}>>")[path], rows)
    out = df.select(*keep, F.explode(rows).alias("_r"))

    def typed(prefix: str, names: dict[str, str]) -> list[Column]:
        return [F.col(f"{prefix}.{n}").try_cast(t).alias(n) for n, t in names.items()]

    for n in nested:
        out = out.withColumn(f"_n_{n}", F.explode(F.col(f"_r.{n}")))
    return out.select(*keep, *typed("_r", fields), *[c for n, f in nested.items() for c in typed(f"_n_{n}", f)])


def id_list(df: DataFrame, column: str, path: str, name: str, type_: str = "bigint") -> DataFrame:
    """Distinct ids of a ``{"path": [{"name": ...}]}`` payload."""
    return parse_payload(df, column, {name: type_}, path).where(F.col(name).isNotNull()).distinct()


def payload_text(df: DataFrame, by: list[str], columns: list[str], path: str, out: str = "payload") -> DataFrame:
    """One JSON list per group: ``{"path": [{...}, ...]}`` with rows in column order.

    A payload is one text value, so group by something the size of a request
    or a document, never by a status, a company or another unbounded key.
    """
    rows = F.array_sort(F.collect_list(F.struct(*columns)))
    return df.groupBy(*by).agg(F.to_json(F.struct(rows.alias(path))).alias(out))
