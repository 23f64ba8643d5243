"""Filter trees: seventeen node kinds, builders that simplify, and traversal."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace
from typing import Any

LEAVES = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "nin", "like", "regex", "exists")
OPS = (*LEAVES, "and", "or", "not", "true", "false", "raw")


@dataclass(frozen=True)
class Filter:
    """One node. Leaves use ``field`` and ``value``; ``parts`` holds children."""

    op: str
    field: str | None = None
    value: Any = None
    parts: tuple[Filter, ...] = ()
    #: like: case-sensitive; regex: flags; raw: parameters
    option: Any = None

    def __and__(self, other: Filter) -> Filter:
        return and_(self, other)

    def __or__(self, other: Filter) -> Filter:
        return or_(self, other)

    def __invert__(self) -> Filter:
        return not_(self)


TRUE, FALSE = Filter("true"), Filter("false")


def _leaf(op: str) -> Callable[[str, Any], Filter]:
    def build(field: str, value: Any) -> Filter:
        return Filter(op, field, tuple(value) if op in ("in", "nin") else value)

    build.__name__ = op
    return build


eq, ne, gt, gte, lt, lte = map(_leaf, ("eq", "ne", "gt", "gte", "lt", "lte"))
in_ = any_of = _leaf("in")
nin = none_of = _leaf("nin")


def like(field: str, pattern: str, case_sensitive: bool = False) -> Filter:
    """SQL LIKE on the whole string; a backslash makes ``%`` and ``_`` literal."""
    return Filter("like", field, pattern, option=case_sensitive)


def regex(field: str, pattern: str, flags: str = "") -> Filter:
    return Filter("regex", field, pattern, option=flags)


def exists(field: str, present: bool = True) -> Filter:
    """Present and not null."""
    return Filter("exists", field, present)


def raw(sql: str, params: Iterable[Any] = ()) -> Filter:
    """A native fragment with ``?`` markers, for trusted callers only."""
    return Filter("raw", None, sql, option=tuple(params))


def _joined(op: str, parts: Iterable[Filter], neutral: Filter, absorbing: Filter) -> Filter:
    flat: list[Filter] = []
    for p in parts:
        if p == absorbing:
            return absorbing
        if p != neutral:
            flat += p.parts if p.op == op else (p,)
    if absorbing in flat:
        return absorbing
    return neutral if not flat else flat[0] if len(flat) == 1 else Filter(op, parts=tuple(flat))


def and_(*parts: Filter) -> Filter:
    return _joined("and", parts, TRUE, FALSE)


def or_(*parts: Filter) -> Filter:
    return _joined("or", parts, FALSE, TRUE)


def not_(part: Filter) -> Filter:
    if part.op == "not":
        return part.parts[0]
    return FALSE if part == TRUE else TRUE if part == FALSE else Filter("not", parts=(part,))


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def between(field: str, low: Any, high: Any) -> Filter:
    return and_(gte(field, low), lte(field, high))


def starts_with(field: str, text: str, case_sensitive: bool = False) -> Filter:
    return like(field, f"{escape_like(text)}%", case_sensitive)


def ends_with(field: str, text: str, case_sensitive: bool = False) -> Filter:
    return like(field, f"%{escape_like(text)}", case_sensitive)


def contains(field: str, text: str, case_sensitive: bool = False) -> Filter:
    return like(field, f"%{escape_like(text)}%", case_sensitive)


def i_eq(field: str, text: str) -> Filter:
    return like(field, escape_like(text))


def is_null(field: str) -> Filter:
    return exists(field, False)


def is_not_null(field: str) -> Filter:
    return exists(field, True)


def is_filter(x: Any) -> bool:
    return isinstance(x, Filter) and x.op in OPS


def walk(node: Filter, visit: Callable[[Filter], Any]) -> None:
    """Pre-order; a visit that returns False prunes the node's children."""
    if visit(node) is not False:
        for p in node.parts:
            walk(p, visit)


def rewrite(node: Filter, change: Callable[[Filter], Filter]) -> Filter:
    """Post-order; untouched subtrees keep their identity."""
    parts = tuple(rewrite(p, change) for p in node.parts)
    if any(a is not b for a, b in zip(parts, node.parts, strict=True)):
        node = {"and": and_, "or": or_, "not": not_}[node.op](*parts)
    return change(node)


def fields_of(node: Filter) -> list[str]:
    """Distinct fields, in the order they are met."""
    found: dict[str, None] = {}
    walk(node, lambda n: found.setdefault(n.field) if n.field is not None else None)
    return list(found)


def rename(node: Filter, names: Mapping[str, str]) -> Filter:
    return rewrite(node, lambda n: replace(n, field=names[n.field]) if n.field in names else n)
