"""Aggregation, lookup and update requests, and their checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from .filters import Filter

UNITS = ("minute", "hour", "day", "week", "month", "quarter", "year")
CUSTOM_UNITS = ("minute", "hour", "day", "week", "month")
MEASURES = ("count", "countDistinct", "sum", "avg", "min", "max", "percentile", "stddev", "stddevPop")
TIES = ("rank", "dense_rank", "row_number")


@dataclass(frozen=True)
class Measure:
    """``accuracy`` makes a percentile approximate (its error is 1 / accuracy of the rows), in bounded memory."""

    op: str
    field: str | None = None
    where: Filter | Mapping[str, Any] | None = None
    p: float | None = None
    accuracy: int | None = None


@dataclass(frozen=True)
class Bucket:
    """A date label: a named unit, or bins of ``every`` units, with boundaries in ``timezone``."""

    field: str
    interval: str
    every: int | None = None
    timezone: str | None = None


@dataclass(frozen=True)
class TopN:
    partition_by: str | Sequence[str]
    sort_by: Mapping[str, int]
    limit: int
    ties: str = "rank"


@dataclass(frozen=True)
class Lookup:
    """A single-level left equi-join. ``single`` unwraps to one object (or null)."""

    from_: str
    local: str
    foreign: str
    as_: str | None = None
    single: bool = False
    select: Sequence[str] | Mapping[str, int] | None = None
    where: Filter | Mapping[str, Any] | None = None

    @property
    def name(self) -> str:
        return self.as_ or self.from_


@dataclass(frozen=True)
class Aggregate:
    measures: Mapping[str, Measure]
    group_by: str | Sequence[str] | None = None
    buckets: Mapping[str, Bucket] = field(default_factory=dict)
    filter: Filter | Mapping[str, Any] | None = None
    lookups: Sequence[Lookup] = ()
    having: Filter | Mapping[str, Any] | None = None
    top: TopN | None = None
    sort: Mapping[str, int] = field(default_factory=dict)
    limit: int | None = None
    offset: int | None = None
    hints: Mapping[str, Any] = field(default_factory=dict)

    @property
    def groups(self) -> list[str]:
        g = self.group_by
        return [] if g is None else [g] if isinstance(g, str) else list(g)

    @property
    def keys(self) -> list[str]:
        """Group fields, then bucket aliases."""
        return [*self.groups, *self.buckets]

    def check(self) -> Aggregate:
        if not self.measures:
            raise ValueError("an aggregate needs at least one measure")
        for alias, m in self.measures.items():
            if m.op not in MEASURES:
                raise ValueError(f'unknown measure operator "{m.op}" for "{alias}"')
            if m.field is None and m.op != "count":
                raise ValueError(f'measure "{alias}" ({m.op}) needs a field')
            if m.op == "percentile" and not (isinstance(m.p, (int, float)) and 0 <= m.p <= 1):
                raise ValueError(f'percentile "{alias}": p must lie between 0 and 1')
        for alias, b in self.buckets.items():
            if alias in self.groups or alias in self.measures:
                raise ValueError(f'bucket alias "{alias}" is already a group field or measure')
            if b.every is None and b.interval not in UNITS:
                raise ValueError(f'unknown bucket interval "{b.interval}"')
            if b.every is not None and (b.interval not in CUSTOM_UNITS or not _positive(b.every)):
                raise ValueError(f'bucket "{alias}": every must be a positive integer of {", ".join(CUSTOM_UNITS)}')
        if self.top:
            by = [self.top.partition_by] if isinstance(self.top.partition_by, str) else list(self.top.partition_by)
            for name in by:
                if name not in self.keys:
                    raise ValueError(f'topN.partitionBy "{name}" is not a group field or bucket')
            if not _positive(self.top.limit):
                raise ValueError("topN.limit must be a positive integer")
            if self.top.ties not in TIES:
                raise ValueError(f'topN.ties "{self.top.ties}" is not one of {", ".join(TIES)}')
            if not self.top.sort_by:
                raise ValueError("topN.sortBy must not be empty")
        return self


def _positive(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x > 0


class Unset:
    """A value that was not given."""


@dataclass(frozen=True)
class Update:
    set: Mapping[str, Any] = field(default_factory=dict)
    unset: tuple[str, ...] = ()
    set_on_insert: Mapping[str, Any] = field(default_factory=dict)
    inc: Mapping[str, float] = field(default_factory=dict)

    def plan(self) -> dict[str, Any]:
        """The tabular form: assignments, columns to null, increments, defaults of an insert."""
        return {"data": dict(self.set), "unset": list(self.unset), "inc": dict(self.inc), "insert_defaults": dict(self.set_on_insert)}

    def document_plan(self) -> dict[str, Any]:
        """The document form; empty parts are left out."""
        parts = {"$set": dict(self.set), "$unset": {k: "" for k in self.unset}, "$setOnInsert": dict(self.set_on_insert), "$inc": dict(self.inc)}
        return {k: v for k, v in parts.items() if v}


def update(set: Mapping[str, Any] | None = None, unset: str | Sequence[str] = (), set_on_insert: Mapping[str, Any] | None = None, inc: Mapping[str, float] | None = None) -> Update:
    given = lambda m: {k: v for k, v in (m or {}).items() if v is not Unset}
    out = Update(given(set), tuple(dict.fromkeys([unset] if isinstance(unset, str) else unset)), given(set_on_insert), given(inc))
    if not (out.set or out.unset or out.set_on_insert or out.inc):
        raise ValueError("an update must change something")
    return out


def set_fields(**values: Any) -> Update:
    return update(set=values)


def unset_fields(*names: str) -> Update:
    return update(unset=names)


def inc_fields(**values: float) -> Update:
    return update(inc=values)


def set_on_insert_fields(**values: Any) -> Update:
    return update(set_on_insert=values)


def combine_updates(*updates: Update) -> Update:
    """Later updates win, field by field, also for increments."""
    merged: dict[str, dict] = {"set": {}, "set_on_insert": {}, "inc": {}}
    unset: list[str] = []
    for u in updates:
        for part, values in merged.items():
            values.update(getattr(u, part))
        unset += u.unset
    return update(merged["set"], unset, merged["set_on_insert"], merged["inc"])


def is_update(x: Any) -> bool:
    return isinstance(x, Update)


def is_pipeline(x: Any) -> bool:
    return isinstance(x, (list, tuple))
