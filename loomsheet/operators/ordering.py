"""Sort orders with stated null order: ascending nulls first, descending nulls last."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths


def orders(schema: T.StructType, sort: Mapping[str, int]) -> list[Column]:
    out = []
    for name, way in sort.items():
        c = paths.column(schema, name)
        out.append(c.asc_nulls_first() if way >= 0 else c.desc_nulls_last())
    return out


def sorted_by(df: DataFrame, sort: Mapping[str, int] | None) -> DataFrame:
    return df.orderBy(*orders(df.schema, sort)) if sort else df


def project(df: DataFrame, select: Sequence[str] | Mapping[str, int] | None) -> DataFrame:
    """Inclusions minus exclusions; exclusions alone drop."""
    if not select:
        return df
    if not isinstance(select, Mapping):
        select = dict.fromkeys(select, 1)
    wanted = [k for k, v in select.items() if v]
    gone = {k for k, v in select.items() if not v}
    if wanted:
        return df.select(*[paths.column(df.schema, k).alias(k) for k in wanted if k not in gone and paths.resolve(df.schema, k)])
    return df.drop(*gone)


def nest(df: DataFrame) -> DataFrame:
    """Dotted column names become structs: ``d.code`` is field ``code`` of ``d``."""
    if not any("." in c for c in df.columns):
        return df

    def build(names: list[tuple[list[str], str]]) -> list[Column]:
        tree: dict[str, list] = {}
        for parts, full in names:
            tree.setdefault(parts[0], []).append((parts[1:], full))
        out = []
        for head, rest in tree.items():
            leaf = [full for parts, full in rest if not parts]
            inner = [(parts, full) for parts, full in rest if parts]
            out.append(F.struct(*build(inner)).alias(head) if inner else F.col(paths.quoted(leaf[0])).alias(head))
        return out

    return df.select(*build([(c.split("."), c) for c in df.columns]))
