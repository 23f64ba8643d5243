"""Change logs, mutation verdicts and usage counters as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cursors sort as text.
CURSOR_DIGITS, PAGE = 20, 500


def cursor_of(sequence: Column) -> Column:
    return F.lpad(sequence.cast("string"), CURSOR_DIGITS, "0")


def since(log: DataFrame, cursor: str | None, scope: str | None = None, tenant: str | None = None) -> DataFrame:
    """Entries after the cursor, oldest first."""
    if scope is not None:
        log = log.filter(F.col("scope") == scope)
    if tenant is not None:
        log = log.filter(F.col("tenantId") == tenant)
    if cursor is not None:
        log = log.filter(F.col("cursor") > cursor)
    return log.orderBy("cursor")


def snapshot(log: DataFrame) -> DataFrame:
    """The newest entry of each document, unless it is a tombstone.

    An aggregate with a partial step: long histories are not gathered.
    """
    rest = [c for c in log.columns if c not in ("scope", "docId")]
    last = F.max_by(F.struct(*rest), "cursor").alias("__last")
    return log.groupBy("scope", "docId").agg(last).select("scope", "docId", "__last.*").filter("op <> 'delete'")


def applied(base: DataFrame, log: DataFrame, key: str = "docId") -> DataFrame:
    """``base`` after all entries: last writer wins, tombstones delete."""
    docs = [c for c in base.columns if c != key]
    last = log.groupBy("docId").agg(F.max_by(F.struct("op", "doc"), "cursor").alias("__last"))
    joined = base.join(last.withColumnRenamed("docId", key), key, "full").filter(F.coalesce(F.col("__last.op") != "delete", F.lit(True)))
    return joined.select(key, *[F.when(F.col("__last").isNotNull(), F.col(f"__last.doc.{c}")).otherwise(F.col(c)).alias(c) for c in docs])


def verdicts(mutations: DataFrame, current: DataFrame, done: DataFrame) -> DataFrame:
    """(mutationId, verdict): already_applied, rejected (no such document), conflict, or applied."""
    m = mutations.join(done.select("mutationId", F.lit(True).alias("__done")).dropDuplicates(["mutationId"]), "mutationId", "left")
    m = m.join(current.select("docId", F.col("version").alias("__version")), "docId", "left")
    verdict = (
        F.when(F.col("__done"), "already_applied")
        .when(F.col("__version").isNull() & (F.col("op") != "create"), "rejected")
        .when(F.coalesce("__version", F.lit(0)) != F.coalesce("baseVersion", F.lit(0)), "conflict")
        .otherwise("applied")
    )
    return m.select("mutationId", verdict.alias("verdict"))


def period_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def usage_totals(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("actor", "period", "kind").agg(F.sum("n").alias("n"))


def usage_summary(deltas: DataFrame, actor: str, period: str) -> DataFrame:
    return usage_totals(deltas.filter((F.col("actor") == actor) & (F.col("period") == period))).select("kind", "n")


def content_hash(df: DataFrame, *columns: str) -> Column:
    """sha-256 of the row as JSON with its fields in name order."""
    names = sorted(columns or df.columns)
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
