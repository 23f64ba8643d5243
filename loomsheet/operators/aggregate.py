"""Aggregations: filter, joins, groups, measures, having, top-N, sort, page, in that order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths
from ..functions.buckets import bucket
from ..functions.predicates import apply_filter, compile_filter
from ..plans.requests import Aggregate, Measure
from .lookup import join_flat
from .ordering import nest, orders, sorted_by

RANK = "__rank"


def argument(m: Measure, schema: T.StructType) -> Column:
    """What an aggregate sees: rows outside its own filter are null to it."""
    c = paths.column(schema, m.field) if m.field else F.lit(1)
    return c if m.where is None else F.when(compile_filter(m.where, schema), c)


def measure(m: Measure, schema: T.StructType) -> Column:
    c = argument(m, schema)
    return {
        "count": F.count,
        "countDistinct": F.count_distinct,
        "sum": F.sum,
        "avg": F.avg,
        "min": F.min,
        "max": F.max,
        "percentile": lambda x: F.percentile_approx(x, float(m.p), m.accuracy),
        "stddev": F.stddev_samp,
        "stddevPop": F.stddev_pop,
    }[m.op](c)


def measures(request: Aggregate, schema: T.StructType) -> tuple[list[Column], dict[str, Column]]:
    """(aggregates, what each alias is made of). Exact percentiles of one column share one buffer of its values."""
    columns, out, shared = [], {}, {}
    for alias, m in request.measures.items():
        if m.op == "percentile" and m.accuracy is None:
            shared.setdefault((m.field, repr(m.where)), []).append((alias, m))
        else:
            columns.append(measure(m, schema).alias(alias))
            out[alias] = F.col(paths.quoted(alias))
    for i, ms in enumerate(shared.values()):
        columns.append(F.percentile(argument(ms[0][1], schema), F.array(*[F.lit(float(m.p)) for _, m in ms])).alias(f"__percentiles{i}"))
        out |= {alias: F.col(f"__percentiles{i}")[k].alias(alias) for k, (alias, _) in enumerate(ms)}
    return columns, {alias: out[alias] for alias in request.measures}


def top_n(df: DataFrame, request: Aggregate) -> DataFrame:
    top = request.top
    by = [top.partition_by] if isinstance(top.partition_by, str) else list(top.partition_by)
    order = dict(top.sort_by)
    if top.ties == "row_number":
        order |= {k: 1 for k in request.keys if k not in order}  # a total order decides ties
    window = W.partitionBy(*[paths.column(df.schema, k) for k in by]).orderBy(*orders(df.schema, order))
    rank = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number}[top.ties]()
    return df.withColumn(RANK, rank.over(window)).filter(F.col(RANK) <= top.limit).drop(RANK)


def grouped(df: DataFrame, request: Aggregate, table: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """Up to top-N, with flat column names; no sort and no page yet."""
    request.check()
    df = apply_filter(df, request.filter)
    df = join_flat(df, request.lookups, table)
    schema = df.schema
    keys = [paths.column(schema, g).alias(g) for g in request.groups]
    for alias, b in request.buckets.items():
        kind = paths.type_of(schema, b.field)
        keys.append((bucket(paths.column(schema, b.field), kind, b) if kind is not None else F.lit(None).cast("string")).alias(alias))
    names = [*request.groups, *request.buckets]
    columns, parts = measures(request, schema)
    out = df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)
    if any(c.startswith("__percentiles") for c in out.columns):
        out = out.select(*[F.col(paths.quoted(n)) for n in names], *parts.values())
    out = apply_filter(out, request.having)
    return top_n(out, request) if request.top else out


def aggregate(df: DataFrame, request: Aggregate, table: Callable[[str], DataFrame] | None = None, nested: bool = False) -> DataFrame:
    out = sorted_by(grouped(df, request, table), request.sort)
    if request.offset:
        out = out.offset(request.offset)
    if request.limit is not None:
        out = out.limit(request.limit)
    return nest(out) if nested else out
