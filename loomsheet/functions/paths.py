"""Dotted paths to columns, by the schema: structs, maps, array fan-out and positions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Segments that never resolve.
FORBIDDEN = frozenset(("__proto__", "constructor", "prototype"))


@dataclass
class Place:
    """A value (or, with ``many``, an array of values) that a path leads to."""

    column: Column
    type: T.DataType
    many: bool


def _follow(column: Column, kind: T.DataType, rest: list[str]) -> list[Place]:
    if not rest:
        return [Place(column, kind.elementType, True)] if isinstance(kind, T.ArrayType) else [Place(column, kind, False)]
    head, tail = rest[0], rest[1:]
    if head in FORBIDDEN:
        return []
    if isinstance(kind, T.StructType):
        return _follow(column.getField(head), kind[head].dataType, tail) if head in kind.fieldNames() else []
    if isinstance(kind, T.MapType):
        return _follow(F.try_element_at(column, F.lit(head)), kind.valueType, tail)
    if isinstance(kind, T.ArrayType):
        found = _follow(F.get(column, F.lit(int(head))), kind.elementType, tail) if head.isdecimal() else []
        shapes: list[Place] = []
        F.transform(column, lambda x: _note(shapes, _follow(x, kind.elementType, rest)))
        for i, p in enumerate(shapes):
            each = _each(column, kind.elementType, rest, i)
            found.append(Place(F.flatten(each) if p.many else each, p.type, True))
        return found
    return []


def _note(into: list[Place], found: list[Place]) -> Column:
    into += found
    return F.lit(None)


def _each(column: Column, kind: T.DataType, rest: list[str], i: int) -> Column:
    return F.transform(column, lambda x: _follow(x, kind, rest)[i].column)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def resolve(schema: T.StructType, path: str) -> list[Place]:
    """Everything that ``path`` may mean; an empty list if nothing. A column of that very name wins."""
    if path in schema.fieldNames():
        return _follow(F.col(quoted(path)), schema[path].dataType, [])
    parts = path.split(".")
    for k in range(len(parts) - 1, 0, -1):
        if (head := ".".join(parts[:k])) in schema.fieldNames():
            return _follow(F.col(quoted(head)), schema[head].dataType, parts[k:])
    return []


def column(schema: T.StructType, path: str) -> Column:
    """The single column of a path, for grouping, measures and sorting; null if unknown."""
    if path in schema.fieldNames():
        return F.col(quoted(path))
    found = resolve(schema, path)
    return found[0].column if found else F.lit(None)


def type_of(schema: T.StructType, path: str) -> T.DataType | None:
    found = resolve(schema, path)
    return found[0].type if found else None
