"""Filter trees to boolean columns.

Two modes.  ``query`` follows SQL: a null value satisfies no comparison, negated or not.
``document`` is two-valued: a null or missing value differs from every other value.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from datetime import date, datetime, timezone
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import filters as f
from ..plans.filters import Filter
from ..plans.records import parse_iso, record_to_filter
from . import paths

#: Longer strings never match a regular expression.
MAX_REGEX_INPUT = 64 * 1024
#: From so many members on, membership is a semi join.
MANY = 10_000


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "binary" if isinstance(kind, T.BinaryType) else "other"


def family_of(value: Any) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float, Decimal)):
        return "number"
    if isinstance(value, (datetime, date)):
        return "date"
    return "string" if isinstance(value, str) else "binary" if isinstance(value, (bytes, bytearray)) else "other"


def literal(value: Any, kind: T.DataType) -> Column | None:
    """The value as a literal comparable with a column of that type; None across type families."""
    own, other = family(kind), family_of(value)
    if own == "date" and other == "string":
        value = parse_iso(value)
        if value is None:
            return None
        other = "date"
    if own == "string" and other == "date":
        value, other = value.isoformat(), "string"
    if own != other:
        return None
    if own == "date":
        if not isinstance(value, datetime):
            value = datetime(value.year, value.month, value.day)
        if isinstance(kind, T.TimestampType):
            aware = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
            return F.lit(aware)
        if value.tzinfo:
            value = value.astimezone(timezone.utc).replace(tzinfo=None)
        text = value.isoformat(sep=" ")
        return F.expr(f"TIMESTAMP_NTZ '{text}'")
    if own == "binary":
        return F.lit(bytes(value))
    return F.lit(value)


def like_pattern(pattern: str) -> str:
    r"""Keep ``\%``, ``\_`` and ``\\``; a backslash before anything else stands for itself."""
    return re.sub(r"\\([%_\\])|\\", lambda m: m[0] if m[1] else r"\\", pattern)


def sql_literal(value: Any) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, Decimal)):
        return str(value)
    if isinstance(value, float):
        return f"DOUBLE '{value!r}'"
    if isinstance(value, datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _raw(node: Filter) -> Column:
    values = iter(node.option or ())
    text = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|\?", lambda m: sql_literal(next(values)) if m[0] == "?" else m[0], node.value)
    return F.expr(text)


def _compare(op: str, c: Column, kind: T.DataType, value: Any) -> Column | None:
    """Three-valued result for one scalar; None if the types cannot compare."""
    v = literal(value, kind)
    if v is None:
        return None
    if op == "eq":
        return c == v
    if isinstance(value, float) and math.isnan(value):
        return F.lit(False)
    out = {"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]
    return out & ~F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else out


def _member(c: Column, kind: T.DataType, values: tuple) -> Column | None:
    fit = [v for v in (literal(x, kind) for x in values) if v is not None]
    return c.isin(*fit) if fit else None


def _any(schema: T.StructType, node: Filter, test: Callable[[Column, T.DataType], Column | None]) -> Column:
    """Whether any value of the field passes; null if the field itself is null (scalars only)."""
    out = []
    for p in paths.resolve(schema, node.field):
        if p.many:
            probe: list = []
            F.exists(p.column, lambda x: _keep(probe, test(x, p.type)))
            if probe[0] is not None:
                out.append(F.coalesce(F.exists(p.column, lambda x: test(x, p.type)), F.lit(False)))
        elif (t := test(p.column, p.type)) is not None:
            out.append(t)
    return _all(out, lambda a, b: a | b) if out else F.lit(False)


def _keep(into: list, value: Column | None) -> Column:
    into.append(value)
    return F.lit(False)


def _all(columns: list[Column], join: Callable[[Column, Column], Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = join(out, c)
    return out


def _present(schema: T.StructType, path: str) -> Column:
    tests = []
    for p in paths.resolve(schema, path):
        found = F.exists(p.column, lambda x: x.isNotNull()) if p.many and "." in path else p.column.isNotNull()
        tests.append(F.coalesce(found, F.lit(False)))
    return _all(tests, lambda a, b: a | b) if tests else F.lit(False)


def compile_filter(node: Filter | dict | None, schema: T.StructType, mode: str = "query") -> Column:
    node = record_to_filter(node)
    two = mode == "document"
    settle = lambda c: F.coalesce(c, F.lit(False)) if two else c

    def go(n: Filter) -> Column:
        op, field, value = n.op, n.field, n.value
        if op in ("true", "false"):
            return F.lit(op == "true")
        if op in ("and", "or"):
            return _all([go(p) for p in n.parts], (lambda a, b: a & b) if op == "and" else (lambda a, b: a | b))
        if op == "not":
            return ~go(n.parts[0])
        if op == "raw":
            return settle(_raw(n))
        if op == "exists":
            return _present(schema, field) if value else ~_present(schema, field)
        if op in ("eq", "ne") and value is None:
            return go(f.exists(field, op == "ne"))
        if op == "ne":
            same = _any(schema, n, lambda c, k: _compare("eq", c, k, value))
            return ~F.coalesce(same, F.lit(False)) if two else ~same & _present(schema, field)
        if op == "in":
            plain = tuple(v for v in value if v is not None)
            found = settle(_any(schema, n, lambda c, k: _member(c, k, plain))) if plain else F.lit(False)
            return found | ~_present(schema, field) if len(plain) < len(value) else found
        if op == "nin":
            if not value:
                return F.lit(True)
            inside = F.coalesce(go(f.in_(field, value)), F.lit(False))
            return ~inside if two else ~inside & _present(schema, field)
        if op == "like":
            pattern = like_pattern(value)
            return settle(_any(schema, n, lambda c, k: (c.like(pattern) if n.option else c.ilike(pattern)) if family(k) == "string" else None))
        if op == "regex":
            flags = "".join(x for x in "ims" if x in (n.option or ""))
            pattern = f"(?{flags}){value}" if flags else value
            return settle(_any(schema, n, lambda c, k: (F.length(c) <= MAX_REGEX_INPUT) & c.rlike(pattern) if family(k) == "string" else None))
        return settle(_any(schema, n, lambda c, k: _compare(op, c, k, value)))

    return go(node)


def fit_literals(node: Filter, schema: T.StructType) -> Filter:
    """Texts of a query string as values of their column's type; unreadable ones stay as they are."""

    def one(kind: T.DataType | None, v: Any) -> Any:
        own = family(kind) if kind is not None else "string"
        if own == "string" and isinstance(v, (bool, float)):
            return str(v).lower() if isinstance(v, bool) else str(v)
        if not isinstance(v, str):
            return v
        if own == "number":
            try:
                return int(v) if re.fullmatch(r"[+-]?\d+", v) else float(v)
            except ValueError:
                return v
        return {"true": True, "false": False}.get(v, v) if own == "boolean" else (parse_iso(v) or v) if own == "date" else v

    def change(n: Filter) -> Filter:
        if n.op not in ("eq", "ne", "gt", "gte", "lt", "lte", "in", "nin"):
            return n
        kind = paths.type_of(schema, n.field)
        value = tuple(one(kind, v) for v in n.value) if n.op in ("in", "nin") else one(kind, n.value)
        return Filter(n.op, n.field, value, option=n.option)

    return f.rewrite(node, change)


def apply_filter(df: DataFrame, node: Filter | dict | None, mode: str = "query") -> DataFrame:
    """``df`` filtered; memberships of very many values become semi joins."""
    node = record_to_filter(node)
    if node == f.TRUE:
        return df
    parts = node.parts if node.op == "and" else (node,)
    big = [p for p in parts if p.op == "in" and len(p.value) >= MANY and p.field in df.columns and None not in p.value]
    rest = f.and_(*(p for p in parts if p not in big))
    if rest != f.TRUE:
        df = df.filter(compile_filter(rest, df.schema, mode))
    for p in big:
        kind = df.schema[p.field].dataType
        keys = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(p.value)], T.StructType([T.StructField(p.field, kind)]))
        df = df.join(keys, p.field, "left_semi")
    return df
