"""Guarded status changes of documents and their lines.

Requests are rows (``requestId``, document key, optional ``notes``); one request
may name many documents and is rejected as a whole when any of them fails a
rule.  Only changed rows come back; ``merge_rows`` puts them into the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validate import Rule, validate


@dataclass(frozen=True)
class LineSpec:
    """How lines follow their document: which states move, what is set."""

    key: str
    status: str
    allowed: tuple[int, ...] | None
    excluded: tuple[int, ...] = ()
    sets: dict[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class TransitionSpec:
    """States a document may leave, the state it enters, and the states that have their own message."""

    key: str
    name: str
    status: str
    allowed: tuple[int, ...]
    to: int
    rejects: tuple[tuple[int, str], ...] = ()
    other: str | None = "{} cannot change"
    sets: dict[str, Column] = field(default_factory=dict)


class Transition(NamedTuple):
    accepted: DataFrame
    headers: DataFrame
    errors: DataFrame


def status_transition(headers: DataFrame, requests: DataFrame, spec: TransitionSpec, rules: Sequence[Rule] = ()) -> Transition:
    """Check the requested documents and move those of clean requests.

    ``rules`` are extra checks over the joined rows and come first.  ``accepted``
    holds the documents before the change, ``headers`` after it.
    """
    picked = requests.join(headers, spec.key)
    status, name = F.col(spec.status), F.col(spec.name)
    state_rules = [Rule(message, status == state, name) for state, message in spec.rejects]
    if spec.other is not None:
        state_rules.append(Rule(spec.other, ~status.isin(*spec.allowed), name))
    checked = validate(picked, [*rules, *state_rules], spec.key, ["requestId"])
    accepted = checked.accepted.where(status.isin(*spec.allowed))
    changed = accepted.withColumns({**spec.sets, spec.status: F.lit(spec.to)})
    own = [c for c in headers.columns]
    return Transition(accepted, changed.select(*own), checked.errors)


def move_lines(lines: DataFrame, documents: DataFrame, spec: LineSpec, to: int, document_key: str | None = None) -> DataFrame:
    """Lines of the given documents in a state that may move, after the change."""
    keys = documents.select(F.col(document_key or spec.key).alias(spec.key)).distinct()
    picked = lines.join(keys, spec.key, "left_semi")
    if spec.allowed is not None:
        picked = picked.where(F.col(spec.status).isin(*spec.allowed))
    if spec.excluded:
        picked = picked.where(~F.col(spec.status).isin(*spec.excluded))
    return picked.withColumns({**spec.sets, spec.status: F.lit(to)}).select(*lines.columns)


def append_note(note: str, reason: str = "notes") -> Column:
    """Old note, '|', reason."""
    return F.concat(F.when(F.length(F.rtrim(F.coalesce(note, F.lit("")))) > 0, F.concat(F.col(note), F.lit("|"))).otherwise(""), F.col(reason))


def merge_rows(target: DataFrame, changed: DataFrame, key: Sequence[str], deleted: DataFrame | None = None) -> DataFrame:
    """The table with changed rows put in place of the old ones (and deleted rows left out)."""
    key = list(key)
    gone = changed.select(*key) if deleted is None else changed.select(*key).unionByName(deleted.select(*key))
    return target.join(gone, key, "left_anti").unionByName(changed.select(*target.columns))
