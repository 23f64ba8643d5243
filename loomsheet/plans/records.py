"""Filters written as plain records: the bare-operator dialect and the ``$`` policy dialect."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from datetime import datetime
from typing import Any

from . import filters as f
from .filters import Filter

ISO = re.compile(r"\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}:?\d{2})?)?")


class InvalidFilter(ValueError):
    """A record that is not a filter."""


def parse_iso(text: str) -> datetime | None:
    """A strict ISO-8601 date or date-time; None for any look-alike."""
    if not isinstance(text, str) or not ISO.fullmatch(text):
        return None
    try:
        return datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text.replace("Z", "+00:00")))
    except ValueError:
        return None


BARE: dict[str, Callable[[str, Any], Filter]] = {
    "eq": f.eq, "ne": f.ne, "gt": f.gt, "gte": f.gte, "lt": f.lt, "lte": f.lte,
    "in": f.in_, "nin": f.nin, "like": f.like, "contains": f.contains,
    "startsWith": f.starts_with, "endsWith": f.ends_with, "exists": f.exists,
}
MISSING = object()


def _one(field: str, value: Any) -> Filter:
    if value is None:
        return f.is_null(field)
    if isinstance(value, (list, tuple, set)):
        return f.in_(field, value)
    if isinstance(value, Mapping) and value and all(k in BARE for k in value):
        return f.and_(*(f.is_null(field) if v is None and k == "eq" else f.is_not_null(field) if v is None and k == "ne" else BARE[k](field, v) for k, v in value.items()))
    return f.eq(field, value)


def record_to_filter(record: Filter | Mapping[str, Any] | None) -> Filter:
    """Keys are ANDed; null is a null test, a list membership; a map of operators applies them.

    A map with any unknown key is a literal value.  Filters pass unchanged.
    """
    if record is None:
        return f.TRUE
    if f.is_filter(record):
        return record
    if not isinstance(record, Mapping):
        raise InvalidFilter(f"not a filter: {type(record).__name__}")
    return f.and_(*(_one(k, v) for k, v in record.items() if v is not MISSING))


def _members(field: str, values: Any, negate: bool) -> Filter:
    """Members may be null (a null test) or compiled patterns (a search)."""
    if not isinstance(values, (list, tuple, set)):
        raise InvalidFilter(f"$in on {field!r} needs a list")
    plain = [v for v in values if v is not None and not isinstance(v, re.Pattern)]
    parts = [f.in_(field, plain)] if plain or not values else []
    parts += [f.is_null(field)] if any(v is None for v in values) else []
    parts += [_pattern(field, v) for v in values if isinstance(v, re.Pattern)]
    found = f.or_(*parts)
    return f.not_(found) if negate else found


def _pattern(field: str, p: re.Pattern | str, options: str = "") -> Filter:
    if isinstance(p, re.Pattern):
        flags = "".join(c for c, bit in (("i", re.I), ("m", re.M), ("s", re.S)) if p.flags & bit)
        return f.regex(field, p.pattern, flags + options)
    return f.regex(field, p, options)


def _policy_field(field: str, value: Any) -> Filter:
    if isinstance(value, re.Pattern):
        return _pattern(field, value)
    if not (isinstance(value, Mapping) and any(str(k).startswith("$") for k in value)):
        return f.is_null(field) if value is None else f.eq(field, value)
    parts = []
    for op, v in value.items():
        if op == "$eq":
            parts.append(f.is_null(field) if v is None else f.eq(field, v))
        elif op == "$ne":
            parts.append(f.is_not_null(field) if v is None else f.ne(field, v))
        elif op in ("$gt", "$gte", "$lt", "$lte"):
            parts.append(BARE[op[1:]](field, v))
        elif op in ("$in", "$nin"):
            parts.append(_members(field, v, op == "$nin"))
        elif op == "$exists":
            parts.append(f.exists(field, bool(v)))
        elif op == "$regex":
            parts.append(_pattern(field, v, value.get("$options", "")))
        elif op == "$not":
            parts.append(f.not_(_policy_field(field, v)))
        elif op == "$options" and "$regex" in value:
            continue
        else:
            raise InvalidFilter(f"unknown operator {op!r} on {field!r}")
    return f.and_(*parts)


def policy_to_filter(record: Mapping[str, Any]) -> Filter:
    """The ``$`` dialect; anything it does not know is an error, so no rule is silently lost."""
    if not isinstance(record, Mapping):
        raise InvalidFilter("a policy must be a record")
    parts = []
    for key, value in record.items():
        if key in ("$and", "$or", "$nor"):
            if not isinstance(value, (list, tuple)):
                raise InvalidFilter(f"{key} needs a list")
            inner = [policy_to_filter(v) for v in value]
            parts.append(f.and_(*inner) if key == "$and" else f.or_(*inner) if key == "$or" else f.not_(f.or_(*inner)))
        elif key == "$not":
            parts.append(f.not_(policy_to_filter(value)))
        elif str(key).startswith("$"):
            raise InvalidFilter(f"unknown operator {key!r}")
        else:
            parts.append(_policy_field(key, value))
    return f.and_(*parts)


def coerce_dates(record: Mapping[str, Any], is_date: Callable[[str], bool | None] | None = None) -> dict[str, Any]:
    """ISO strings under range operators become datetimes, never those under equality.

    ``is_date`` answers for a field: True (any parseable string), False (never), None (by shape).
    """
    ranges = {"$gt", "$gte", "$lt", "$lte", "gt", "gte", "lt", "lte"}

    def value(field: str, op: str, v: Any) -> Any:
        if op not in ranges or not isinstance(v, str) or (known := is_date(field) if is_date else None) is False:
            return v
        return v if known is None and not ISO.fullmatch(v) else parse_iso(v) or v

    out: dict[str, Any] = {}
    for k, v in record.items():
        if k in ("$and", "$or", "$nor"):
            out[k] = [coerce_dates(x, is_date) for x in v]
        elif k == "$not":
            out[k] = coerce_dates(v, is_date)
        elif isinstance(v, Mapping):
            out[k] = {op: coerce_dates({k: x}, is_date)[k] if op == "$not" else value(k, op, x) for op, x in v.items()}
        else:
            out[k] = v
    return out


SCOPE_ANY = object()


def tenant_scope(existing: Filter | Mapping[str, Any] | None, field: str, tenant: Any) -> Filter:
    """``existing`` AND the tenant; a flat record's own value for the field is overwritten."""
    if isinstance(existing, Mapping):
        existing = {k: v for k, v in existing.items() if k != field}
    return f.and_(f.eq(field, tenant), record_to_filter(existing))


def merge_scope(existing: Filter | Mapping[str, Any] | None, scope: Any) -> Filter:
    return record_to_filter(existing) if scope is SCOPE_ANY else f.and_(record_to_filter(existing), record_to_filter(scope))
