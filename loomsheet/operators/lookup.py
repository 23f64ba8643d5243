"""Lookups: left equi-joins that keep one row per base row, or flat ones for aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from ..functions.predicates import apply_filter
from ..plans.requests import Lookup
from .ordering import project

KEY = "__key"


def _foreign(lookup: Lookup, table: Callable[[str], DataFrame]) -> tuple[DataFrame, list[str]]:
    """The other side, filtered and pruned before the join, with its join key apart."""
    side = apply_filter(table(lookup.from_), lookup.where)
    key = paths.column(side.schema, lookup.foreign)
    wanted = project(side, lookup.select).columns
    return side.select(key.alias(KEY), *[paths.column(side.schema, c).alias(c) for c in wanted]).filter(F.col(KEY).isNotNull()), wanted


def _one_per_key(side: DataFrame, columns: list[str]) -> DataFrame:
    """The least row of each key, so that a lookup never multiplies rows."""
    return side.groupBy(KEY).agg(F.min(F.struct(*columns)).alias("__row"))


def _found(side: DataFrame, columns: list[str], single: bool) -> DataFrame:
    if single:
        return _one_per_key(side, columns).withColumnRenamed("__row", "__found")
    return side.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("__found"))


def embed(base: DataFrame, lookup: Lookup, table: Callable[[str], DataFrame]) -> DataFrame:
    """Adds ``lookup.name``: an array of structs (empty on a miss), or one struct or null."""
    side, columns = _foreign(lookup, table)
    local = paths.column(base.schema, lookup.local)
    found = _found(side, columns, lookup.single)
    out = base.join(found, local == F.col(KEY), "left").drop(KEY)
    value = F.col("__found") if lookup.single else F.coalesce("__found", F.array())
    return out.withColumn(lookup.name, value).drop("__found")


def embed_all(base: DataFrame, lookups: Sequence[Lookup], table: Callable[[str], DataFrame]) -> DataFrame:
    for lookup in lookups:
        base = embed(base, lookup, table)
    return base


def _at(row: Row, path: str) -> Any:
    value: Any = row
    for part in path.split("."):
        value = None if value is None else value[part]
    return value


def embed_page(rows: Sequence[Row], schema: T.StructType, lookups: Sequence[Lookup], table: Callable[[str], DataFrame]) -> tuple[list[Row], T.StructType]:
    """``embed_all`` for one page of rows that the driver holds: (rows, schema), in the page's order.

    The foreign side is filtered by the page's keys at its scan, so only rows that the page
    asks for are grouped and sent; a lookup may use what an earlier one found.
    """
    rows, todo, done = list(rows), list(lookups), []

    def find(lookup: Lookup) -> tuple[dict[Any, Any], T.DataType, list[Any]]:
        keys = [_at(r, lookup.local) for r in rows]
        side, columns = _foreign(lookup, table)
        wanted = [k for k in dict.fromkeys(keys) if k is not None]
        found = _found(side.filter(F.col(KEY).isin(*wanted)) if wanted else side.limit(0), columns, lookup.single)
        return {r[KEY]: r["__found"] for r in found.collect()} if wanted else {}, found.schema["__found"].dataType, keys

    while todo:
        # those that use nothing another one has yet to find are asked at once
        late = {x.name for x in todo}
        wave = [x for x in todo if x.local.split(".")[0] not in late - {x.name}] or todo[:1]
        carry = inheritable_thread_target(table(wave[0].from_).sparkSession)  # a read that is stopped stops these too
        with ThreadPoolExecutor(len(wave)) as pool:
            answers = list(pool.map(carry(find), wave))
        for lookup, (by_key, kind, keys) in zip(wave, answers, strict=True):
            names = [x.name for x in schema if x.name != lookup.name]
            make, miss = Row(*names, lookup.name), None if lookup.single else []
            rows = [make(*(r[n] for n in names), by_key.get(k, miss)) for r, k in zip(rows, keys, strict=True)]
            schema = T.StructType([x for x in schema if x.name != lookup.name] + [T.StructField(lookup.name, kind, True)])
        done += [x.name for x in wave]
        todo = [x for x in todo if x not in wave]
    # lookups in the order they were asked for
    names = [x.name for x in schema if x.name not in done] + list(dict.fromkeys(x.name for x in lookups))
    make = Row(*names)
    return [make(*(r[n] for n in names)) for r in rows], T.StructType([schema[n] for n in names])


def join_flat(base: DataFrame, lookups: Sequence[Lookup], table: Callable[[str], DataFrame]) -> DataFrame:
    """For aggregation: columns ``name.column``; many matches multiply rows unless ``single``."""
    for lookup in lookups:
        side, columns = _foreign(lookup, table)
        if lookup.single:
            side = _one_per_key(side, columns).select(KEY, *[F.col("__row").getField(c).alias(c) for c in columns])
        side = side.select(F.col(KEY), *[F.col(paths.quoted(c)).alias(f"{lookup.name}.{c}") for c in columns])
        base = base.join(side, paths.column(base.schema, lookup.local) == F.col(KEY), "left").drop(KEY)
    return base
