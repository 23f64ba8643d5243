"""Pages by offset and by keyset, cursor tokens, and their envelopes."""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from ..functions.predicates import family, literal
from .ordering import project, sorted_by

#: Fixed limits.
DEFAULT_LIMIT, MAX_LIMIT, MAX_PAGE, DEEP_PAGE, VERSION = 10, 100, 10_000, 100, 1
#: Rows before a page that are sorted with it; pivots of each round that narrows a page with more rows before it.
SKIPPED, PIVOTS = 5_000, 32


class InvalidCursor(ValueError):
    """A token that cannot be used for this request."""


def valid_limit(limit: Any, default: int = DEFAULT_LIMIT, cap: int = MAX_LIMIT) -> int:
    """Whole and at least 1, else the default; at most ``cap`` (0: no cap)."""
    try:
        n = float(limit)
    except (TypeError, ValueError):
        return default
    if not math.isfinite(n) or n < 1:
        return default
    return min(int(n), cap) if cap else int(n)


def valid_page(page: Any, most: int = MAX_PAGE) -> int:
    """Whole and at least 1, else 1; beyond ``most`` (0: no cap) it is refused."""
    try:
        n = float(page)
    except (TypeError, ValueError):
        return 1
    if not math.isfinite(n) or n < 1:
        return 1
    if most and n > most:
        raise ValueError(f"page {int(n)} is beyond the last allowed page {most}")
    return int(n)


def skip(page: int, limit: int) -> int:
    return (page - 1) * limit


def page_count(total: int, limit: int) -> int:
    return math.ceil(total / limit) if limit > 0 else 0


def is_deep(page: int, threshold: int = DEEP_PAGE) -> bool:
    return page > threshold


def normal_sort(sort: Mapping[str, int], key: str) -> dict[str, int]:
    """The key last; it follows the direction of the others."""
    out = {k: v for k, v in sort.items() if k != key}
    way = sort.get(key) or next(iter(out.values()), 1)
    return out | {key: way}


def inverted(sort: Mapping[str, int]) -> dict[str, int]:
    return {k: -v for k, v in sort.items()}


def primary_field(sort: Mapping[str, int], key: str) -> str:
    return next((k for k in sort if k != key), key)


def valid_keyset_sort(sort: Mapping[str, int], key: str | None, allowed: Sequence[str] | None = None) -> dict[str, int]:
    if key is None:
        raise ValueError("keyset pages need a table with a primary key")
    if not sort:
        raise ValueError("keyset pages need a sort")
    for name, way in sort.items():
        if way not in (1, -1):
            raise ValueError(f'sort direction of "{name}" must be 1 or -1')
        if allowed is not None and name != key and name not in allowed:
            raise ValueError(f'sort field "{name}" is not allowed')
    if len(set(sort.values())) > 1:
        raise ValueError("keyset sorts must all run in one direction")
    return normal_sort(sort, key)


def _tag(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (datetime, date)):
        return "date"
    return "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "unknown"


def _pack(v: Any) -> Any:
    return v.isoformat() if isinstance(v, (datetime, date)) else v if isinstance(v, (bool, int, float, str, type(None))) else str(v)


def _unpack(v: Any, tag: str) -> Any:
    wrong = InvalidCursor(f"cursor value does not fit its type {tag!r}")
    if tag == "date":
        try:
            return datetime.fromisoformat(v)
        except (TypeError, ValueError):
            raise wrong from None
    fits = {"null": v is None, "boolean": isinstance(v, bool), "number": isinstance(v, (int, float)) and not isinstance(v, bool), "string": isinstance(v, str)}
    if not fits.get(tag, True):
        raise wrong
    return v


def _token(payload: Any) -> str:
    return base64.urlsafe_b64encode(json.dumps(payload, separators=(",", ":")).encode()).decode().rstrip("=")


def _payload(token: str, what: str) -> dict:
    try:
        text = token.replace("+", "-").replace("/", "_").rstrip("=")
        out = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except (ValueError, AttributeError, TypeError):
        raise InvalidCursor(f"{what}: not a cursor") from None
    if not isinstance(out, dict):
        raise InvalidCursor(f"{what}: not a cursor")
    return out


def encode_cursor(row: Mapping[str, Any], sort: Mapping[str, int], key: str, version: int = VERSION) -> str:
    first = primary_field(sort, key)
    # fixed names: the token is a wire format
    values = {k: row[k] for k in sort}
    payload = {
        "v": _pack(row[first]), "t": _tag(row[first]), "id": _pack(row[key]), "idType": _tag(row[key]), "sort": dict(sort), "ver": version,
        "vals": {k: _pack(v) for k, v in values.items()}, "types": {k: _tag(v) for k, v in values.items()},
    }
    return _token(payload)


@dataclass
class Cursor:
    values: dict[str, Any]
    sort: dict[str, int]
    version: int
    id: Any


def decode_cursor(token: str) -> Cursor:
    p = _payload(token, "cursor")
    if not isinstance(p.get("sort"), dict) or not isinstance(p.get("ver"), int) or not isinstance(p.get("t"), str) or "v" not in p or "id" not in p:
        raise InvalidCursor("cursor: incomplete")
    if any(way not in (1, -1) for way in p["sort"].values()):
        raise InvalidCursor("cursor: bad sort")
    row_id = _unpack(p["id"], p.get("idType", "unknown"))
    values, types = p.get("vals"), p.get("types") or {}
    if values is None:
        names = list(p["sort"])
        values, types = {names[0]: p["v"], names[-1]: p["id"]}, {names[0]: p["t"], names[-1]: p.get("idType", "unknown")}
    return Cursor({k: _unpack(v, types.get(k, "unknown")) for k, v in values.items()}, p["sort"], p["ver"], row_id)


def check_cursor(cursor: Cursor, sort: Mapping[str, int], version: int = VERSION, least: int = 1) -> Cursor:
    if list(cursor.sort.items()) != list(sort.items()):
        raise InvalidCursor("cursor: made for another sort")
    if cursor.version > version:
        raise InvalidCursor("cursor: made by a newer version")
    if cursor.version < least:
        raise InvalidCursor("cursor: too old")
    return cursor


def encode_group_cursor(row: Mapping[str, Any], keys: Sequence[str]) -> str:
    return _token({k: [_tag(row[k]), _pack(row[k])] for k in keys})


def decode_group_cursor(token: str) -> dict[str, Any]:
    p = _payload(token, "aggregate cursor")
    try:
        return {k: _unpack(v, tag) for k, (tag, v) in p.items()}
    except (TypeError, ValueError) as e:
        raise InvalidCursor(f"aggregate cursor: {e}") from None


def after(schema: T.StructType, sort: Mapping[str, int], values: Mapping[str, Any]) -> Column:
    """Rows past the cursor, spelled out term by term so that it reaches the scan.

    Ascending nulls come first, descending nulls last.
    """
    out, same = F.lit(False), F.lit(True)
    for name, way in sort.items():
        c, v = paths.column(schema, name), values.get(name)
        if v is None:
            past, equal = (c.isNotNull() if way > 0 else F.lit(False)), c.isNull()
        else:
            bound = literal(v, paths.type_of(schema, name))
            if bound is None:
                raise InvalidCursor(f'cursor: the value of "{name}" does not fit its column')
            past, equal = (c > bound if way > 0 else (c < bound) | c.isNull()), c == bound
        out, same = out | (same & past), same & equal
    return F.coalesce(out, F.lit(False))


@dataclass
class OffsetPage:
    data: list[Row]
    page: int
    limit: int
    total: int
    pages: int
    has_next: bool
    has_prev: bool
    warning: str | None = None


@dataclass
class KeysetPage:
    data: list[Row]
    limit: int
    has_more: bool
    next: str | None
    kind: str = field(default="keyset")


def offset_plan(df: DataFrame, sort: Mapping[str, int] | None, page: int, limit: int) -> DataFrame:
    return sorted_by(df, sort).offset(skip(page, limit)).limit(limit)


def deep_rows(df: DataFrame, sort: Mapping[str, int], start: int, n: int, select: Sequence[str] | Mapping[str, int] | None = None) -> list[Row]:
    """Rows ``start`` to ``start + n`` of the sorted rows, where many stand before them.

    Rounds of random pivots and counts between them narrow down where the page stands, so
    neither the driver nor a task holds the rows before it.  A hash of the whole row (but
    its maps) breaks ties, so pages neither lose nor repeat rows; equal rows are alike.
    """
    names, tie = df.columns, "__tie"
    while tie in names:
        tie += "_"
    hashed = [F.col(paths.quoted(x.name)) for x in df.schema if "map<" not in x.dataType.simpleString()]
    df = df.withColumn(tie, F.xxhash64(*hashed) if hashed else F.lit(0).cast("long"))
    schema, sort = df.schema, dict(sort) | {tie: 1}
    kinds = {name: paths.type_of(schema, name) for name in sort}

    def equal(values: Mapping[str, Any]) -> Column:
        out = F.lit(True)
        for name, v in values.items():
            c = paths.column(schema, name)
            out = out & (c.isNull() if v is None else c.eqNullSafe(literal(v, kinds[name])))
        return out

    def pivots(part: DataFrame) -> list[dict[str, Any]]:
        some = part.select([paths.column(schema, name).alias(str(i)) for i, name in enumerate(sort)]).orderBy(F.rand()).limit(PIVOTS).distinct()
        found = sorted_by(some, {str(i): way for i, way in enumerate(sort.values())}).collect()
        # timestamps are collected in the driver's zone
        moment = lambda v, kind: v.astimezone(timezone.utc) if v is not None and isinstance(kind, T.TimestampType) else v
        return [{name: moment(v, kinds[name]) for name, v in zip(sort, r, strict=True)} for r in found]

    def shown(part: DataFrame) -> list[Row]:
        return project(part.select([F.col(paths.quoted(c)) for c in names]), select).collect()

    def rows(part: DataFrame, start: int, n: int) -> list[Row]:
        if start <= SKIPPED:
            return shown(sorted_by(part, sort).offset(start).limit(n))
        at = pivots(part)
        past, same = [after(schema, sort, v) for v in at], [equal(v) for v in at]
        # even regions lie between two pivots, odd ones are the rows equal to one
        region = F.lit(0)
        for p, s in zip(past, same, strict=True):
            region = region + F.when(p, 2).when(s, 1).otherwise(0)
        held = {r[0]: r[1] for r in part.groupBy(region.alias("region")).count().collect()}
        out, before = [], 0
        for k in range(2 * len(at) + 1):
            first, last = max(start - before, 0), min(start + n - before, held.get(k, 0))
            before += held.get(k, 0)
            if first >= last:
                continue
            i = k // 2
            if k % 2:
                out += shown(part.filter(same[i]).limit(last - first))
            else:
                inside = part.filter(past[i - 1]) if i else part
                out += rows(inside.filter(~(past[i] | same[i])) if i < len(at) else inside, first, last - first)
        return out

    return rows(df, start, n)


def offset_page(df: DataFrame, sort: Mapping[str, int] | None, page: Any, limit: int, count: str = "exact", most: int = MAX_PAGE, select: Sequence[str] | Mapping[str, int] | None = None) -> OffsetPage:
    """``count="none"`` skips the count and looks one row ahead; ``select`` trims the rows, after they are sorted."""
    page = valid_page(page, most)
    ahead = count == "none"
    total = 0 if ahead else df.count()
    start, n = skip(page, limit), limit + ahead
    if not ahead and start >= total:
        rows = []
    elif start > SKIPPED and sort and all(family(paths.type_of(df.schema, name)) != "other" for name in sort):
        rows = deep_rows(df, sort, start, n, select)
    else:
        rows = project(sorted_by(df, sort), select).offset(start).limit(n).collect()
    pages = page_count(total, limit)
    more = len(rows) > limit if ahead else page < pages
    return OffsetPage(rows[:limit], page, limit, total, pages, more, page > 1, f"page {page} is deep; a keyset page is cheaper" if is_deep(page) else None)


def keyset_plan(df: DataFrame, sort: Mapping[str, int], key: str | None, token: str | None, limit: int, allowed: Sequence[str] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """At most limit + 1 rows past the cursor, and the whole sort."""
    sort = valid_keyset_sort(sort, key, allowed)
    if token:
        df = df.filter(after(df.schema, sort, check_cursor(decode_cursor(token), sort).values))
    return sorted_by(df, sort).limit(limit + 1), sort


def keyset_page(df: DataFrame, sort: Mapping[str, int], key: str | None, token: str | None, limit: int, allowed: Sequence[str] | None = None, select: Sequence[str] | Mapping[str, int] | None = None) -> KeysetPage:
    """``select`` trims the rows; what the cursor needs is read beside them."""
    plan, sort = keyset_plan(df, sort, key, token, limit, allowed)
    if not select:
        rows = plan.collect()
        place = lambda r: r.asDict()
    else:
        names = project(plan, select).columns
        shown = F.struct(*[paths.column(plan.schema, n).alias(n) for n in names]).alias("row")
        rows = plan.select(shown, F.struct(*[paths.column(plan.schema, n).alias(n) for n in sort]).alias("place")).collect()
        place = lambda r: r["place"].asDict()
    more = len(rows) > limit
    last = encode_cursor(place(rows[limit - 1]), sort, key) if more else None
    return KeysetPage([r["row"] for r in rows[:limit]] if select else rows[:limit], limit, more, last)


def group_keyset_page(groups: DataFrame, sort: Mapping[str, int], keys: Sequence[str], token: str | None, limit: int) -> KeysetPage:
    """Pages over groups. The remaining group keys break ties, so no group is lost or repeated."""
    if not sort:
        raise ValueError("keyset pages of an aggregate need a sort")
    sort = dict(sort) | {k: 1 for k in keys if k not in sort}
    if token:
        values = decode_group_cursor(token)
        if list(values) != list(sort):
            raise InvalidCursor("aggregate cursor: made for another sort")
        groups = groups.filter(after(groups.schema, sort, values))
    rows = sorted_by(groups, sort).limit(limit + 1).collect()
    more = len(rows) > limit
    return KeysetPage(rows[:limit], limit, more, encode_group_cursor(rows[limit - 1].asDict(), list(sort)) if more else None)


def canonical(x: Any) -> dict[str, Any]:
    """Any result as one envelope."""
    if isinstance(x, OffsetPage):
        return {"kind": "offset", "data": x.data, "page": x.page, "limit": x.limit, "total": x.total, "pages": x.pages, "hasNext": x.has_next, "hasPrev": x.has_prev}
    if isinstance(x, KeysetPage):
        return {"kind": "keyset", "data": x.data, "limit": x.limit, "hasMore": x.has_more, "next": x.next}
    return {"kind": "bare", "data": list(x)}


def is_page(x: Any) -> bool:
    return isinstance(x, (OffsetPage, KeysetPage))
