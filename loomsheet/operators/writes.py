"""Writes as plans from a table's rows to its next rows (copy on write)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import compile_filter
from ..plans import filters as f
from ..plans.requests import Update, is_pipeline
from .ordering import orders


def matching(schema: T.StructType, node: Any) -> Column:
    """Never null, so that its negation keeps the rows it cannot judge."""
    return F.coalesce(compile_filter(node, schema), F.lit(False))


def value_of(v: Any, kind: T.DataType) -> Column:
    return v if isinstance(v, Column) else F.lit(v).cast(kind)


def changed(df: DataFrame, hit: Column, change: Update) -> DataFrame:
    """Rows where ``hit`` holds get the update; unset is null, an increment of null starts at 0."""
    if is_pipeline(change):
        raise ValueError("update pipelines are not supported")
    plan, schema, new = change.plan(), df.schema, {}
    for name, v in plan["data"].items():
        kind = schema[name].dataType if name in schema.fieldNames() else None
        new[name] = v if isinstance(v, Column) else F.lit(v) if kind is None else value_of(v, kind)
    for name in plan["unset"]:
        if name in schema.fieldNames():
            new[name] = F.lit(None).cast(schema[name].dataType)
    for name, by in plan["inc"].items():
        c = F.col(name) if name in schema.fieldNames() else F.lit(None).cast("double")
        new[name] = F.coalesce(c, F.lit(0)) + F.lit(by)
        if name in schema.fieldNames():
            new[name] = new[name].cast(schema[name].dataType)
    old = {n: F.col(n) if n in schema.fieldNames() else F.lit(None) for n in new}
    return df.withColumns({n: F.when(hit, c).otherwise(old[n]) for n, c in new.items()})


def rows_of(df: DataFrame, docs: Sequence[Mapping[str, Any]]) -> DataFrame:
    """New rows in the table's own schema; missing fields are null."""
    names = df.columns
    return df.sparkSession.createDataFrame([tuple(d.get(n) for n in names) for d in docs], T.StructType([T.StructField(x.name, x.dataType, True) for x in df.schema]))


def inserted(df: DataFrame, docs: Sequence[Mapping[str, Any]]) -> DataFrame:
    return df.unionByName(rows_of(df, docs))


def updated(df: DataFrame, node: Any, change: Update) -> DataFrame:
    return changed(df, matching(df.schema, node), change)


def deleted(df: DataFrame, node: Any) -> DataFrame:
    return df.filter(~matching(df.schema, node))


def first_match(df: DataFrame, node: Any, sort: Mapping[str, int], key: str) -> DataFrame:
    """At most one row: the first match in sort order, the key breaking ties."""
    order = dict(sort) | ({key: 1} if key not in sort else {})
    return df.filter(matching(df.schema, node)).orderBy(*orders(df.schema, order)).limit(1)


def updated_one(df: DataFrame, node: Any, sort: Mapping[str, int], key: str, change: Update) -> DataFrame:
    """Updates only the first match: found by a top-1, joined back by its key."""
    chosen = first_match(df, node, sort, key).select(F.col(key).alias("__chosen"))
    marked = df.join(F.broadcast(chosen), F.col(key).eqNullSafe(F.col("__chosen")), "left")  # one row
    return changed(marked, F.col("__chosen").isNotNull(), change).drop("__chosen")


def insert_document(node: Any, change: Update) -> dict[str, Any]:
    """What an upsert inserts: the filter's equalities, then the update on an empty row."""
    doc: dict[str, Any] = {}

    def equal(n: f.Filter) -> bool:
        if n.op == "eq":
            doc[n.field] = n.value
        return n.op == "and"

    f.walk(node, equal)
    plan = change.plan()
    return doc | plan["insert_defaults"] | plan["data"] | {k: v for k, v in plan["inc"].items()}


def upserted(df: DataFrame, source: DataFrame, keys: Sequence[str], change: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows of ``source`` replace those with equal keys, or are added: one full join on the keys."""
    rest = [c for c in df.columns if c not in keys]
    new = source.select(*keys, F.struct(*rest).alias("__new"))
    joined = df.select(*keys, F.struct(*rest).alias("__old")).join(new, list(keys), "full")
    row = F.coalesce("__new", "__old")
    return joined.select(*keys, *[row.getField(c).alias(c) for c in rest]).select(*df.columns)


def claim_filter(key: str, key_value: Any, field: str, states: Any, where: Any = None) -> f.Filter:
    """Compare and set on a state: one of ``states`` (null: is null), and ``where``."""
    from ..plans.records import record_to_filter

    many = states if isinstance(states, (list, tuple, set)) else [states]
    return f.and_(f.eq(key, key_value), f.in_(field, many), record_to_filter(where))


def claimed(df: DataFrame, node: f.Filter, field: str, to: Any, patch: Update | None = None) -> DataFrame:
    from ..plans.requests import combine_updates, set_fields

    change = set_fields(**{field: to})
    return updated(df, node, combine_updates(patch, change) if patch else change)


def version_claimed(df: DataFrame, key: str, key_value: Any, version: Any, by: int = 1, field: str = "version", patch: Update | None = None) -> DataFrame:
    from ..plans.requests import combine_updates, inc_fields

    same = f.is_null(field) if version is None else f.eq(field, version)
    step = inc_fields(**{field: by})
    return updated(df, f.and_(f.eq(key, key_value), same), combine_updates(patch, step) if patch else step)


def purged(df: DataFrame, node: Any, mode: str, fields: Mapping[str, Any] | None = None, deleted_field: str = "deleted") -> DataFrame:
    """hard: rows go; soft: they are marked; anonymize: fields get a constant or an expression; skip: nothing."""
    if mode == "skip":
        return df
    if mode == "hard":
        return deleted(df, node)
    if mode == "soft":
        change = {deleted_field: True}
        if f"{deleted_field}At" in df.columns:
            change[f"{deleted_field}At"] = F.current_timestamp().cast(df.schema[f"{deleted_field}At"].dataType)
        return updated(df, node, Update(set=change))
    if mode == "anonymize":
        if not fields:
            raise ValueError("anonymize needs fields")
        return updated(df, node, Update(set={k: v(df) if callable(v) and not isinstance(v, Column) else v for k, v in fields.items()}))
    raise ValueError(f"unknown purge mode {mode!r}")


def per_row(function: Callable[[Any], Any], kind: str | T.DataType, *columns: str) -> Callable[[DataFrame], Column]:
    """An anonymiser that is called with each row (or these columns of it): a Python function, sent in Arrow batches."""

    def build(df: DataFrame) -> Column:
        return F.udf(function, kind, useArrow=True)(F.struct(*(columns or df.columns)))

    return build


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def violations(df: DataFrame, rules: Mapping[str, Mapping[str, Any]], key: str) -> DataFrame:
    """(key, field, rule) of every value that breaks a rule of its field, in one pass."""
    found = []
    for name, rule in rules.items():
        c = F.col(name)
        tests = {
            "nullable": c.isNull() if rule.get("nullable") is False else None,
            "min": c < rule["min"] if "min" in rule else None,
            "max": c > rule["max"] if "max" in rule else None,
            "minLength": F.length(c) < rule["minLength"] if "minLength" in rule else None,
            "maxLength": F.length(c) > rule["maxLength"] if "maxLength" in rule else None,
            "enum": ~c.isin(*rule["enum"]) if "enum" in rule else None,
            "pattern": ~c.rlike(rule["pattern"]) if "pattern" in rule else None,
        }
        found += [F.when(t, F.struct(F.lit(name).alias("field"), F.lit(k).alias("rule"))) for k, t in tests.items() if t is not None]
    if not found:
        return df.select(key, F.lit("").alias("field"), F.lit("").alias("rule")).limit(0)
    broken = F.filter(F.array(*found), lambda x: x.isNotNull())
    return df.select(F.col(key), F.explode(broken).alias("x")).select(key, "x.field", "x.rule")
