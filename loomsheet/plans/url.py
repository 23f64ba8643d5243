"""URL query strings to requests."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import parse_qsl

from . import filters as f
from .filters import Filter
from .records import parse_iso

#: Fixed values of the grammar.
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "nin", "like", "contains", "startsWith", "endsWith", "ieq", "regex", "between", "exists")
RESERVED = frozenset(("page", "limit", "after", "sort", "select", "populate", "search", "_count", "_distinct", "_exists"))
DEFAULT_LIMIT, MAX_LIMIT, MAX_KEY, MAX_REGEX, MAX_SEARCH = 20, 200, 256, 500, 200
KEY = re.compile(r"([^\[\]]+)(?:\[([^\[\]]*)\])?")
RELATION = re.compile(r"populate\[([^\[\]]+)\](?:\[(\w+)\](?:\[([^\[\]]+)\])?)?")


@dataclass
class Populate:
    path: str
    select: list[str] | None = None
    match: dict[str, str] = field(default_factory=dict)


@dataclass
class Parsed:
    filter: Filter = f.TRUE
    sort: dict[str, int] | None = None
    select: dict[str, int] | None = None
    populate: list[Populate] | None = None
    page: int | None = None
    after: str | None = None
    limit: int = DEFAULT_LIMIT
    search: str | None = None


def pairs_of(given: str | Mapping[str, Any] | Iterable[tuple[str, Any]]) -> list[tuple[str, str]]:
    if isinstance(given, str):
        return parse_qsl(given.lstrip("?"), keep_blank_values=True)
    items = given.items() if isinstance(given, Mapping) else given
    return [(str(k), str(x)) for k, v in items for x in (v if isinstance(v, (list, tuple)) else [v]) if x is not None]


def coerce(text: str, hint: str | None = None) -> Any:
    """By hint, else by shape: booleans, null, ISO dates and dotted numbers; whole numbers stay text."""
    if text == "null":
        return None
    if hint == "string":
        return text
    if hint == "number":
        try:
            return float(text) if re.search(r"[.eE]", text) else int(text)
        except ValueError:
            return text
    if hint == "boolean":
        return {"true": True, "1": True, "false": False, "0": False}.get(text, text)
    if hint == "date":
        return parse_iso(text) or text
    if text in ("true", "false"):
        return text == "true"
    if (date := parse_iso(text)) is not None:
        return date
    return float(text) if re.fullmatch(r"-?\d+\.\d+", text) else text


def _leaf(name: str, op: str, text: str, hint: str | None) -> Filter | None:
    value = lambda t: coerce(t, hint)
    if op in ("eq", "ne"):
        v = value(text)
        return f.exists(name, op == "ne") if v is None else (f.eq if op == "eq" else f.ne)(name, v)
    if op in ("gt", "gte", "lt", "lte"):
        return {"gt": f.gt, "gte": f.gte, "lt": f.lt, "lte": f.lte}[op](name, value(text))
    if op in ("in", "nin"):
        return (f.in_ if op == "in" else f.nin)(name, [value(t.strip()) for t in text.split(",") if t.strip()])
    if op == "regex":
        return f.regex(name, text, "i") if len(text) <= MAX_REGEX else None
    if op == "between":
        parts = [t.strip() for t in text.split(",")]
        return f.between(name, value(parts[0]), value(parts[1])) if len(parts) >= 2 else None
    if op == "exists":
        return f.exists(name, text in ("true", "1"))
    return {"like": f.like, "contains": f.contains, "startsWith": f.starts_with, "endsWith": f.ends_with, "ieq": f.i_eq}[op](name, text)


def _signed(text: str, minus: int, allowed: Sequence[str] | None = None) -> dict[str, int] | None:
    out = {}
    for part in text.split(","):
        name = part.strip().lstrip("+-")
        if name and (allowed is None or name in allowed):
            out[name] = minus if part.strip().startswith("-") else 1
    return out or None


def parse_url(
    given: str | Mapping[str, Any] | Iterable[tuple[str, Any]],
    fields: Sequence[str] | None = None,
    operators: Sequence[str] = OPERATORS,
    sortable: Sequence[str] | None = None,
    types: Mapping[str, str] | None = None,
    default_limit: int = DEFAULT_LIMIT,
    max_limit: int = MAX_LIMIT,
) -> Parsed:
    """Fields and operators outside the allow-lists are dropped; predicates AND together."""
    out, leaves, relations = Parsed(limit=min(default_limit, max_limit)), [], {}
    for key, text in pairs_of(given):
        if len(key) > MAX_KEY:
            continue
        if key == "page" or key == "limit":
            n = int(text) if re.fullmatch(r"\s*\+?\d{1,15}\s*", text) else 0
            if n > 0:
                setattr(out, key, min(n, max_limit) if key == "limit" else n)
        elif key == "after":
            out.after = text or None
        elif key == "sort":
            out.sort = _signed(text, -1, sortable)
        elif key == "select":
            out.select = _signed(text, 0)
        elif key == "search":
            out.search = text.strip()[:MAX_SEARCH] or None
        elif key == "populate":
            for path in filter(None, map(str.strip, text.split(","))):
                relations.setdefault(path, Populate(path))
        elif m := RELATION.fullmatch(key):
            r = relations.setdefault(m[1], Populate(m[1]))
            if m[2] == "select":
                r.select = [x.strip() for x in text.split(",") if x.strip()]
            elif m[2] == "match" and m[3]:
                r.match[m[3]] = text
        elif key not in RESERVED and (m := KEY.fullmatch(key)) and m[1] not in RESERVED:
            name, op = m[1], m[2] or "eq"
            if op in OPERATORS and op in operators and (fields is None or name in fields):
                leaf = _leaf(name, op, text, (types or {}).get(name))
                leaves += [leaf] if leaf is not None else []
    out.filter = f.and_(*leaves)
    out.populate = list(relations.values()) or None
    return out
