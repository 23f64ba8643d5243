"""A repository: the verbs of one table, with hooks, tenancy, caching and versioned writes.

Reads are lazy DataFrame plans until rows are asked for.  Writes compute the table's next
rows and publish them as one new version.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.predicates import apply_filter, family, family_of, fit_literals
from .operators import paging, writes
from .operators.aggregate import aggregate as aggregate_plan
from .operators.aggregate import grouped
from .operators.lookup import embed_page
from .operators.ordering import project, sorted_by
from .plans import filters as f
from .plans.filters import Filter
from .plans.records import record_to_filter
from .plans.requests import Aggregate, Lookup, Update, combine_updates, is_update, set_fields, update
from .plans.url import MAX_LIMIT, Parsed, parse_url
from .runtime.cache import Cache, CacheOptions, cache_key, content_hash
from .runtime.control import Aborted, Capabilities, RetryPolicy, StateMachine, Tenancy, guard_distribution, retry
from .runtime.errors import Conflict, DuplicateKey, IllegalTransition, Invalid, NotFound, RepositoryError, TimedOut, VersionConflict
from .runtime.hooks import OPERATIONS, VALIDATION, Hooks, Sealed
from .sources.tables import SnapshotTable

NOTHING = Tenancy("none")


class Repository:
    """``source`` is a DataFrame (read only) or a ``SnapshotTable``."""

    def __init__(
        self,
        name: str,
        source: DataFrame | SnapshotTable,
        key: str | None = None,
        catalog: Mapping[str, Any] | None = None,
        tenancy: Tenancy = NOTHING,
        soft_delete: str | None = None,
        unique: Sequence[Sequence[str]] = (),
        version_field: str = "version",
        cache: Cache | None = None,
        text_fields: Sequence[str] | None = None,
        distribution_key: str | None = None,
        distribution_mode: str = "warn",
        validate: Callable[[dict], dict] | None = None,
        max_page: int = paging.MAX_PAGE,
    ):
        """``max_page``: offset pages beyond it are refused (0: none is)."""
        self.name, self.source, self.key = name, source, key or getattr(source, "key", None)
        self.catalog, self.tenancy, self.soft_delete, self.unique = catalog or {}, tenancy, soft_delete, unique
        self.version_field, self.cache, self.text_fields = version_field, cache, text_fields
        self.distribution_key, self.distribution_mode = distribution_key, distribution_mode
        self.max_page = max_page
        self.hooks, self.capabilities = Hooks(), Capabilities()
        self._staged: DataFrame | None = None
        if validate:
            self.hooks.on("before:create", lambda c: c.update(data=validate(c["data"])), VALIDATION)
            self.hooks.on("before:createMany", lambda c: c.update(data=[validate(d) for d in c["data"]]), VALIDATION)

    # ---- reads -------------------------------------------------------------

    def read(self) -> DataFrame:
        """The current rows, unscoped."""
        if self._staged is not None:
            return self._staged
        return self.source.read() if isinstance(self.source, SnapshotTable) else self.source

    @property
    def schema(self) -> T.StructType:
        return self.read().schema

    @property
    def spark(self) -> SparkSession:
        return self.read().sparkSession

    def sealed(self) -> Sealed:
        return Sealed(self)

    def table(self, name: str) -> DataFrame:
        t = self.catalog[name]
        return t.read() if isinstance(t, (Repository, SnapshotTable)) else t

    def _scope(self, node: Any, context: Mapping[str, Any]) -> Filter:
        """The request's filter, after tenancy and soft delete."""
        node = f.and_(self.tenancy.scope(context), record_to_filter(node))
        if self.soft_delete and not context.get("include_deleted"):
            node = f.and_(node, f.or_(f.is_null(self.soft_delete), f.eq(self.soft_delete, False)))
        if self.distribution_key:
            guard_distribution(node, self.distribution_key, self.distribution_mode)
        return node

    def rows(self, node: Any = None, **context: Any) -> DataFrame:
        return apply_filter(self.read(), self._scope(node, context))

    def _run(self, op: str, context: Mapping[str, Any], body: Callable[[dict], Any]) -> Any:
        """Hooks around a write; the cache forgets what it read of this table."""
        result = self.hooks.run(op, dict(context), body)
        if self.cache and OPERATIONS[op][1] and self._staged is None:
            self.cache.bump(self.name)
            self.cache.invalidate_tags(self.name)
        return result

    def _target(self, c: Mapping[str, Any]) -> Filter:
        """The row an operation names by its id, as far as the hooks' policy lets it."""
        return self._scope(f.and_(f.eq(self.key, c["id"]), record_to_filter(c["query"])), c)

    def _read(self, op: str, context: Mapping[str, Any], node: Any, body: Callable[[Filter], Any], **params: Any) -> Any:
        """Hooks, then policy, tenancy and soft delete, then the cache, then ``body`` of the final filter.

        What is cached is named by the final filter and by all that ``body`` depends on, so no
        reader is served what another may see.  Nothing is cached inside a transaction.  A
        ``signal`` (an event) stops the read, before it starts or while its jobs run; a
        ``retry`` policy repeats it.
        """
        context = dict(context)
        options: CacheOptions | None = context.pop("cache", None)
        signal, policy, limit = context.pop("signal", None), context.pop("retry", None), context.pop("max_time_ms", None)
        key = OPERATIONS[op][0]

        def answer(c: dict) -> Any:
            scoped = self._target(c) if "id" in c and OPERATIONS[op][2] else self._scope(c[key], c)
            work = lambda: self._stoppable(lambda: body(scoped), signal, limit)
            if not (self.cache and options) or self._staged is not None:
                return work()
            at = self.source.version if isinstance(self.source, SnapshotTable) else 0
            named = params | {"filter": repr(scoped), "at": [at, self.cache.version(self.name)], "key": options.key}
            return self.cache.fetch(cache_key(op, self.name, at, named, content_hash(repr(scoped))[:16]), work, replace(options, key=None))

        call = lambda: self.hooks.run(op, context | {key: node}, answer)
        if policy is None:
            return call()
        return retry(call, policy, lambda e: not isinstance(e, (RepositoryError, ValueError, Aborted)), signal)

    def _stoppable(self, body: Callable[[], Any], signal: threading.Event | None, ms: float | None) -> Any:
        """``body``; its jobs are cancelled when the signal is set or the time has passed."""
        if signal is not None and signal.is_set():
            raise Aborted("aborted before the read")
        if signal is None and not ms:
            return body()
        jobs, tag, over = self.spark.sparkContext, f"loomsheet-{uuid.uuid4().hex}", threading.Event()
        why: list[Exception] = []

        def watch() -> None:
            until = None if not ms else time.monotonic() + ms / 1000
            while not over.wait(0.02):
                if signal is not None and signal.is_set():
                    why.append(Aborted("aborted during the read"))
                elif until is not None and time.monotonic() > until:
                    why.append(TimedOut(f"the read took longer than {ms} ms"))
                if why:
                    jobs.cancelJobsWithTag(tag)
                    return

        watcher = threading.Thread(target=watch, daemon=True)
        jobs.addJobTag(tag)
        watcher.start()
        try:
            return body()
        except Exception as e:
            raise why[0] from e if why else e
        finally:
            over.set()
            jobs.removeJobTag(tag)

    def _filtered(self, scoped: Filter) -> DataFrame:
        return apply_filter(self.read(), scoped)

    def get_by_id(self, value: Any, **context: Any) -> Row | None:
        return self._read("getById", context | {"id": value}, f.TRUE, lambda s: self._filtered(s).head())

    def get_one(self, node: Any, sort: Mapping[str, int] | None = None, **context: Any) -> Row | None:
        return self._read("getOne", context, node, lambda s: sorted_by(self._filtered(s), sort).head(), sort=sort)

    get_by_query = get_one

    def get_by_ids(self, values: Sequence[Any], **context: Any) -> dict[str, Row]:
        """Found rows by their id as text, under the policy of single reads; an empty request asks nothing."""
        kind = family(self.schema[self.key].dataType)
        wanted = []
        for v in dict.fromkeys(v for v in values if v is not None):
            try:
                wanted.append(int(v) if kind == "number" else v)
            except (TypeError, ValueError):
                continue
        if not wanted:
            return {}
        among = f.in_(self.key, wanted)
        return self._read("getByIds", context, f.TRUE, lambda s: {str(r[self.key]): r for r in self._filtered(f.and_(among, s)).collect()}, ids=wanted)

    def find_all(self, node: Any = None, sort: Mapping[str, int] | None = None, limit: int | None = None, select: Any = None, **context: Any) -> list[Row]:
        def body(scoped: Filter) -> list[Row]:
            df = project(sorted_by(self._filtered(scoped), sort), select)
            return (df.limit(limit) if limit is not None else df).collect()

        return self._read("findAll", context, node, body, sort=sort, limit=limit, select=select)

    def count(self, node: Any = None, **context: Any) -> int:
        return self._read("count", context, node, lambda s: self._filtered(s).count())

    def exists(self, node: Any = None, **context: Any) -> bool:
        return self._read("exists", context, node, lambda s: not self._filtered(s).isEmpty())

    def distinct(self, field: str, node: Any = None, **context: Any) -> list[Any]:
        return self._read("distinct", context, node, lambda s: [r[0] for r in self._filtered(s).select(field).distinct().collect()], field=field)

    def cursor(self, node: Any = None, sort: Mapping[str, int] | None = None, **context: Any) -> Iterator[Row]:
        """Rows one by one, a partition at a time; by key unless a sort is given."""
        order = sort or ({self.key: 1} if self.key else None)
        context.pop("cache", None)
        return self._read("cursor", context, node, lambda s: sorted_by(self._filtered(s), order).toLocalIterator(prefetchPartitions=True))

    def get_deleted(self, node: Any = None, **context: Any) -> list[Row]:
        gone = f.eq(self.soft_delete, True)
        return self._read("getDeleted", context | {"include_deleted": True}, node, lambda s: self._filtered(f.and_(s, gone)).collect())

    def search_filter(self, text: str | None) -> Filter:
        if not text:
            return f.TRUE
        names = self.text_fields or [x.name for x in self.schema if family(x.dataType) == "string"]
        return f.or_(*(f.contains(n, text) for n in names))

    def get_all(self, node: Any = None, *, page: int | None = None, after: str | None = None, sort: Mapping[str, int] | None = None, limit: int | None = None, search: str | None = None, select: Any = None, count: str = "exact", most: int = paging.MAX_LIMIT, **context: Any) -> Any:
        """``page``: an offset page; ``sort`` or ``after``: a keyset page; neither: all rows."""
        n = paging.valid_limit(limit, cap=most)

        def body(scoped: Filter) -> Any:
            df = self._filtered(f.and_(scoped, self.search_filter(search)))
            if page is not None:
                return paging.offset_page(df, sort, page, n, count, self.max_page, select)
            if after is not None or sort:
                return paging.keyset_page(df, sort or {self.key: 1}, self.key, after, n, select=select)
            return project(df, select).collect()

        return self._read("getAll", context, node, body, page=page, after=after, sort=sort, limit=n, search=search, select=select, count=count)

    def query(self, request: str | Mapping[str, Any] | Parsed, **context: Any) -> Any:
        """A URL query string, answered page by page."""
        p = request if isinstance(request, Parsed) else parse_url(request)
        node = fit_literals(p.filter, self.schema)
        given = {"sort": p.sort, "after": p.after, "limit": p.limit, "select": p.select, "search": p.search, **context}
        if p.populate:
            match = lambda x: fit_literals(record_to_filter(x.match), self.table(x.path).schema) if x.match else None
            lookups = [Lookup(x.path, x.path, "id", single=True, select=x.select, where=match(x)) for x in p.populate]
            return self.lookup_populate(lookups, node, page=p.page, **given)
        keyset = p.after or (p.sort and p.page is None and self.key)
        return self.get_all(node, page=None if keyset else p.page or 1, most=MAX_LIMIT, **given)

    # ---- aggregation and lookups -------------------------------------------

    def aggregate_frame(self, request: Aggregate, nested: bool = False, **context: Any) -> DataFrame:
        return aggregate_plan(self.rows(**context), request, self.table, nested)

    def aggregate(self, request: Aggregate, **context: Any) -> list[Row]:
        """Rows with dotted keys nested. A hint ``max_time_ms`` cancels the jobs when it has passed."""
        hints = {"max_time_ms": request.hints["max_time_ms"]} if request.hints.get("max_time_ms") else {}
        body = lambda s: aggregate_plan(self._filtered(s), request, self.table, nested=True).collect()
        return self._read("aggregate", hints | context, None, body, request=repr(request))

    def aggregate_paginate(self, request: Aggregate, page: int = 1, limit: int = 20, after: str | None = None, pagination: str = "offset", count: str = "exact", **context: Any) -> Any:
        hints = {"max_time_ms": request.hints["max_time_ms"]} if request.hints.get("max_time_ms") else {}

        def body(scoped: Filter) -> Any:
            groups = grouped(self._filtered(scoped), request, self.table)
            if pagination == "keyset" or after:
                return paging.group_keyset_page(groups, request.sort, request.keys, after, paging.valid_limit(limit))
            whole = dict(request.sort) | {k: 1 for k in request.keys if k not in request.sort}
            return paging.offset_page(groups, whole, page, paging.valid_limit(limit), count, self.max_page)

        return self._read("aggregatePaginate", hints | context, None, body, request=repr(request), page=page, after=after, limit=limit, pagination=pagination, count=count)

    def lookup_populate(self, lookups: Sequence[Lookup], node: Any = None, *, sort: Mapping[str, int] | None = None, page: int | None = None, after: str | None = None, limit: int = 20, select: Any = None, search: str | None = None, count: str = "exact", **context: Any) -> Any:
        """Pages the base rows first, then looks up what the page's keys ask for."""
        n = paging.valid_limit(limit, 20, 1000)

        def body(scoped: Filter) -> Any:
            base = self._filtered(f.and_(scoped, self.search_filter(search)))
            keep = {k: 1 for k, v in (select or {}).items() if v} if isinstance(select, Mapping) else select
            roots = {x.local.split(".")[0] for x in lookups} - {x.name for x in lookups}
            wanted = [*keep, *sorted(roots - set(keep))] if keep else select
            if after is not None:
                got = paging.keyset_page(base, sort or {self.key: 1}, self.key, after, n, select=wanted)
            else:
                whole = dict(sort or ({self.key: 1} if self.key else {}))
                got = paging.offset_page(base, whole, page or 1, n, count, self.max_page, wanted)
            got.data, _ = embed_page(got.data, project(base, wanted).schema, lookups, self.table)
            return got

        return self._read("lookupPopulate", context, node, body, lookups=repr(list(lookups)), page=page, after=after, limit=n, sort=sort, select=select, search=search, count=count)

    # ---- writes ------------------------------------------------------------

    def _publish(self, plan: Callable[[DataFrame], DataFrame], hit: Filter) -> None:
        """The next version; only files that hold a row of ``hit`` are written anew."""
        if self._staged is not None:
            self._staged = plan(self._staged)
            return
        if not isinstance(self.source, SnapshotTable):
            raise Invalid(f'"{self.name}" is read only')
        self.source.rewrite(lambda schema: writes.matching(schema, hit), plan, self.source.version)

    def _insert(self, docs: Sequence[Mapping[str, Any]]) -> None:
        self._check_unique(docs)
        if self._staged is not None:
            self._staged = writes.inserted(self._staged, docs)
        elif not isinstance(self.source, SnapshotTable):
            raise Invalid(f'"{self.name}" is read only')
        else:
            expected = self.source.version
            self.source.append(writes.rows_of(self.source.read(), docs), expected)

    def _guard_unique(self, hit: Filter, change: Update) -> None:
        """An update may not give a row a unique key that another row holds, or give two rows one."""
        touched = {*change.set, *change.inc, *change.unset}
        for keys in [(self.key,), *self.unique] if self.key else self.unique:
            if not touched & set(keys):
                continue
            df, many = self.read(), f"duplicate key {tuple(keys)}"
            there = writes.matching(df.schema, hit)
            new = writes.changed(df.filter(there), F.lit(True), change).select(*keys).dropna()
            twice = not writes.duplicates(new, keys).isEmpty()
            if twice or not df.filter(~there).join(new, list(keys), "left_semi").isEmpty():
                raise DuplicateKey(many, {"fields": list(keys)})

    def _check_unique(self, docs: Sequence[Mapping[str, Any]]) -> None:
        for keys in [(self.key,), *self.unique] if self.key else self.unique:
            values = [tuple(d.get(k) for k in keys) for d in docs]
            if len(set(values)) < len(values):
                raise DuplicateKey(f"duplicate key {keys}", {"fields": list(keys)})
            node = f.or_(*(f.and_(*(f.eq(k, v) for k, v in zip(keys, x, strict=True))) for x in values if None not in x))
            if node != f.FALSE and not apply_filter(self.read(), node).isEmpty():
                raise DuplicateKey(f"duplicate key {keys}", {"fields": list(keys)})

    def _stamp(self, docs: Sequence[Mapping[str, Any]], context: Mapping[str, Any]) -> list[dict]:
        if self.tenancy.strategy != "field":
            return [dict(d) for d in docs]
        self.tenancy.scope(context)
        return [dict(d) | {self.tenancy.field: context.get("tenant", d.get(self.tenancy.field))} for d in docs]

    def create_many(self, docs: Sequence[Mapping[str, Any]], **context: Any) -> list[dict]:
        def body(c: dict) -> list[dict]:
            new = self._stamp(c["data"], c)
            self._insert(new)
            return new

        return self._run("createMany", context | {"data": list(docs)}, body)

    def create(self, doc: Mapping[str, Any], **context: Any) -> dict:
        def body(c: dict) -> dict:
            new = self._stamp([c["data"]], c)
            self._insert(new)
            return new[0]

        return self._run("create", context | {"data": dict(doc)}, body)

    def update_many(self, node: Any, change: Update | Mapping[str, Any], **context: Any) -> dict[str, int]:
        change = change if is_update(change) else update(set=change)

        def body(c: dict) -> dict[str, int]:
            scoped = self._scope(c["query"], c)
            self._guard_unique(scoped, change)
            before = apply_filter(self.read(), scoped)
            same = writes.changed(before, F.lit(True), change)
            names = [n for n in same.columns if n in before.columns and n in {**change.set, **change.inc, **dict.fromkeys(change.unset)}]
            differs = F.lit(len(same.columns) > len(before.columns))
            marked = before.withColumns({f"__{n}": F.col(n) for n in names})
            after = writes.changed(marked, F.lit(True), change)
            for n in names:
                differs = differs | ~F.col(n).eqNullSafe(F.col(f"__{n}"))
            n, m = after.agg(F.count(F.lit(1)), F.count(F.when(differs, 1))).first()
            if m:
                self._publish(lambda df: writes.updated(df, scoped, change), scoped)
            return {"matchedCount": n, "modifiedCount": m}

        return self._run("updateMany", context | {"query": node}, body)

    def update(self, value: Any, change: Update | Mapping[str, Any], if_version: Any = None, **context: Any) -> Row | None:
        change = change if is_update(change) else update(set=change)

        def body(c: dict) -> Row | None:
            node = self._target(c)
            row = apply_filter(self.read(), node).head()
            if row is None:
                return None
            step = change
            if if_version is not None:
                if row[self.version_field] != if_version:
                    raise VersionConflict(f"version {row[self.version_field]} is not {if_version}", {"id": value})
                step = combine_updates(change, update(inc={self.version_field: 1}))
            self._guard_unique(node, step)
            self._publish(lambda df: writes.updated(df, node, step), node)
            return apply_filter(self.read(), f.eq(self.key, step.set.get(self.key, c["id"]))).head()

        return self._run("update", context | {"id": value, "query": f.TRUE}, body)

    def _delete(self, scoped: Filter, mode: str | None) -> int:
        n = apply_filter(self.read(), scoped).count()
        kind = mode or ("soft" if self.soft_delete else "hard")
        if n:
            self._publish(lambda df: writes.purged(df, scoped, kind, deleted_field=self.soft_delete or "deleted"), scoped)
        return n

    def delete_many(self, node: Any, mode: str | None = None, **context: Any) -> dict[str, int]:
        return self._run("deleteMany", context | {"query": node}, lambda c: {"deletedCount": self._delete(self._scope(c["query"], c), mode)})

    def delete(self, value: Any, mode: str | None = None, **context: Any) -> Any:
        return self._run("delete", context | {"id": value, "query": f.TRUE}, lambda c: {"id": c["id"]} if self._delete(self._target(c), mode) else None)

    def restore(self, value: Any, **context: Any) -> Row | None:
        change = set_fields(**{self.soft_delete: False})

        def body(c: dict) -> Row | None:
            node = self._target(c | {"include_deleted": True})
            if apply_filter(self.read(), node).isEmpty():
                return None
            self._publish(lambda df: writes.updated(df, node, change), node)
            return apply_filter(self.read(), f.eq(self.key, c["id"])).head()

        return self._run("restore", context | {"id": value, "query": f.TRUE}, body)

    def find_one_and_update(self, node: Any, change: Update, sort: Mapping[str, int] | None = None, image: str = "after", upsert: bool = False, **context: Any) -> Any:
        def body(c: dict) -> Any:
            scoped = self._scope(c["query"], c)
            row = writes.first_match(self.read(), scoped, sort or {}, self.key).head()
            if row is None:
                if not upsert:
                    return None
                doc = self._stamp([writes.insert_document(record_to_filter(c["query"]), change)], c)[0]
                self._insert([doc])
                return doc if image == "after" else None
            one = f.eq(self.key, row[self.key])
            self._guard_unique(one, change)
            self._publish(lambda df: writes.updated(df, one, change), one)
            return row if image == "before" else apply_filter(self.read(), f.eq(self.key, change.set.get(self.key, row[self.key]))).head()

        return self._run("findOneAndUpdate", context | {"query": node}, body)

    def get_or_create(self, node: Any, defaults: Mapping[str, Any], **context: Any) -> dict[str, Any]:
        def body(c: dict) -> dict[str, Any]:
            row = apply_filter(self.read(), self._scope(c["query"], c)).head()
            if row is not None:
                return {"doc": row, "created": False}
            doc = writes.insert_document(record_to_filter(node), update(set=dict(defaults)))
            return {"doc": self.create(doc, **context), "created": True}

        return self._run("getOrCreate", context | {"query": node}, body)

    def bulk_write(self, operations: Sequence[Mapping[str, Any]], **context: Any) -> dict[str, int]:
        """insertOne, updateOne, updateMany, deleteOne, deleteMany, replaceOne; in order, one version."""
        counts = dict.fromkeys(("inserted", "matched", "modified", "deleted", "upserted"), 0)

        def one(name: str, x: Mapping[str, Any]) -> None:
            if name == "insertOne":
                self.create(x["document"], **context)
                counts["inserted"] += 1
            elif name == "updateMany":
                r = self.update_many(x["filter"], x["update"], **context)
                counts["matched"] += r["matchedCount"]
                counts["modified"] += r["modifiedCount"]
            elif name in ("updateOne", "replaceOne"):
                change = x["update"] if name == "updateOne" else update(set={n: x["replacement"].get(n) for n in self.schema.fieldNames() if n != self.key})
                change = change if is_update(change) else update(set=change)
                hit = self.exists(x["filter"], **context)
                out = self.find_one_and_update(x["filter"], change, upsert=bool(x.get("upsert")), **context)
                counts["matched" if hit else "upserted"] += out is not None
                counts["modified"] += hit
            elif name == "deleteOne":
                row = writes.first_match(self.read(), self._scope(x["filter"], context), {}, self.key).head()
                counts["deleted"] += bool(row and self.delete_many(f.eq(self.key, row[self.key]), **context)["deletedCount"])
            elif name == "deleteMany":
                counts["deleted"] += self.delete_many(x["filter"], **context)["deletedCount"]
            else:
                raise Invalid(f"unknown bulk operation {name!r}")

        def body(c: dict) -> dict[str, int]:
            if (by_key := self._bulk_by_key(c["operations"], c)) is not None:
                return by_key
            with_tx = self._staged is None
            steps = lambda _=None: [one(k, v) for op in c["operations"] for k, v in op.items()]
            self.transaction(steps) if with_tx else steps()
            return counts

        return self._run("bulkWrite", context | {"operations": operations}, body)

    def _bulk_by_key(self, operations: Sequence[Mapping[str, Any]], context: Mapping[str, Any]) -> dict[str, int] | None:
        """Bulk operations that all name rows by their key, as one read of those rows and one merge.

        None if some operation does not, or if hooks, soft deletes or expressions ask for
        them one by one.  Unique keys are checked on the outcome.
        """
        inner = ("create", "updateMany", "findOneAndUpdate", "deleteMany", "exists", "getOne")
        if self.key is None or self.soft_delete or any(self.hooks.listens(op) for op in inner):
            return None
        kinds = {x.name: x.dataType for x in self.schema}
        steps = []
        for name, x in ((k, v) for op in operations for k, v in op.items()):
            if name == "insertOne":
                doc = self._stamp([x["document"]], context)[0]
                steps.append((name, doc.get(self.key), Update(set={k: v for k, v in doc.items() if k in kinds}), False))
                continue
            if name not in ("updateOne", "updateMany", "replaceOne", "deleteOne", "deleteMany"):
                return None
            node = record_to_filter(x["filter"])
            if node.op != "eq" or node.field != self.key or family(kinds[self.key]) != family_of(node.value):
                return None
            if name == "replaceOne":
                change = Update(set={n: x["replacement"].get(n) for n in kinds if n != self.key})
            else:
                change = x.get("update", Update())
                change = change if is_update(change) else update(set=change)
            if self.key in {*change.set, *change.inc, *change.unset} or not {*change.set, *change.inc, *change.set_on_insert} <= set(kinds):
                return None
            steps.append((name, node.value, change, bool(x.get("upsert"))))
        values = [v for _, _, change, _ in steps for part in (change.set, change.inc, change.set_on_insert) for v in part.values()]
        if any(k is None for _, k, _, _ in steps) or any(isinstance(v, Column) or callable(v) for v in values):
            return None
        keys = list(dict.fromkeys(k for _, k, _, _ in steps))
        among = f.in_(self.key, keys)
        taken = {r[0] for r in apply_filter(self.read(), among).select(self.key).collect()}
        rows = {r[self.key]: r.asDict() for r in apply_filter(self.read(), f.and_(among, self._scope(None, context))).collect()}
        hidden, counts = taken - rows.keys(), dict.fromkeys(("inserted", "matched", "modified", "deleted", "upserted"), 0)
        for name, k, change, upsert in steps:
            row = rows.get(k)
            if name == "insertOne" or (row is None and upsert):
                if row is not None or k in hidden:
                    raise DuplicateKey(f"duplicate key ({self.key!r},)", {"fields": [self.key]})
                new = change.set if name == "insertOne" else self._stamp([writes.insert_document(f.eq(self.key, k), change)], context)[0]
                rows[k] = dict.fromkeys(kinds) | {n: v for n, v in new.items() if n in kinds}
                counts["inserted" if name == "insertOne" else "upserted"] += 1
            elif row is not None and name.startswith("delete"):
                del rows[k]
                counts["deleted"] += 1
            elif row is not None:
                after = row | dict(change.set) | dict.fromkeys(n for n in change.unset if n in kinds) | {n: (row[n] or 0) + by for n, by in change.inc.items()}
                counts["matched"] += 1
                counts["modified"] += after != row or name != "updateMany"
                rows[k] = after
        if not any(counts.values()):
            return counts
        final = [{n: self._fit(v, kinds[n]) for n, v in row.items()} for row in rows.values()]
        for fields in self.unique:
            held = [x for x in (tuple(r[n] for n in fields) for r in final) if None not in x]
            clash = f.or_(*(f.and_(*(f.eq(n, v) for n, v in zip(fields, x, strict=True))) for x in held))
            others = f.and_(clash, f.not_(among))
            if len(set(held)) < len(held) or (held and not apply_filter(self.read(), others).isEmpty()):
                raise DuplicateKey(f"duplicate key {tuple(fields)}", {"fields": list(fields)})
        gone = f.and_(among, f.nin(self.key, list(hidden)))
        merged = lambda df: writes.inserted(writes.deleted(df, gone), final)
        if self._staged is not None or (taken - hidden):
            self._publish(merged, gone)
        else:
            expected = self.source.version
            self.source.append(writes.rows_of(self.source.read(), final), expected)
        return counts

    @staticmethod
    def _fit(value: Any, kind: T.DataType) -> Any:
        """Numbers as their column's type holds them."""
        if isinstance(kind, (T.DoubleType, T.FloatType)) and isinstance(value, int) and not isinstance(value, bool):
            return float(value)
        return int(value) if isinstance(kind, T.IntegralType) and isinstance(value, float) and value == int(value) else value

    def claim(self, value: Any, field: str, from_: Any, to: Any, where: Any = None, patch: Update | None = None, **context: Any) -> Row | None:
        """Compare and set; None if another was first."""

        def body(c: dict) -> Row | None:
            node = f.and_(self._target(c), writes.claim_filter(self.key, c["id"], field, from_, where))
            if apply_filter(self.read(), node).isEmpty():
                return None
            self._guard_unique(node, combine_updates(patch or Update(), set_fields(**{field: to})))
            self._publish(lambda df: writes.claimed(df, node, field, to, patch), node)
            return apply_filter(self.read(), f.eq(self.key, c["id"])).head()

        return self._run("claim", context | {"id": value, "query": f.TRUE}, body)

    def claim_version(self, value: Any, version: Any, by: int = 1, patch: Update | None = None, **context: Any) -> Row | None:
        def body(c: dict) -> Row | None:
            same = f.is_null(self.version_field) if version is None else f.eq(self.version_field, version)
            node = f.and_(self._target(c), same)
            if apply_filter(self.read(), node).isEmpty():
                return None
            self._publish(lambda df: writes.version_claimed(df, self.key, c["id"], version, by, self.version_field, patch), node)
            return apply_filter(self.read(), f.eq(self.key, c["id"])).head()

        return self._run("claimVersion", context | {"id": value, "query": f.TRUE}, body)

    def apply_transition(self, value: Any, machine: StateMachine, to: str, history: str | None = None, patch: Update | None = None, **context: Any) -> Row:
        """A checked state change with an entry in the row's history; says why if it cannot be."""
        row = self.get_by_id(value, **context)
        if row is None:
            raise NotFound(f'"{value}" does not exist')
        before = row[machine.field]
        machine.check(before, to)
        if history:
            entry = F.struct(F.lit(before).alias("from"), F.lit(to).alias("to"), F.current_timestamp().alias("at"))
            entry = entry.cast(self.schema[history].dataType.elementType)
            grown = F.array_append(F.coalesce(F.col(history), F.array().cast(self.schema[history].dataType)), entry)
            patch = combine_updates(patch or Update(), set_fields(**{history: grown}))
        got = self.claim(value, machine.field, before, to, patch=patch, **context)
        if got is None:
            raise IllegalTransition(f'"{value}" changed meanwhile', {"from": before, "to": to})
        return got

    def transaction(self, body: Callable[[Repository], Any]) -> Any:
        """All writes of ``body`` become one version, or none; its reads see its writes."""
        if self._staged is not None:
            return body(self)
        expected = self.source.version
        self._staged = self.source.read()
        try:
            result = body(self)
            staged = self._staged
        finally:
            self._staged = None
        self.source.publish(staged, expected)
        if self.cache:
            self.cache.bump(self.name)
            self.cache.invalidate_tags(self.name)
        return result

    def retrying_transaction(self, body: Callable[[Repository], Any], policy: RetryPolicy = RetryPolicy()) -> Any:
        return retry(lambda: self.transaction(body), policy, lambda e: type(e) is Conflict)

    # ---- lifecycle ---------------------------------------------------------

    def purge(self, node: Any, mode: str = "hard", fields: Mapping[str, Any] | None = None, reason: str | None = None, batch: int | None = None, progress: Callable[[int], Any] | None = None, aborted: threading.Event | None = None, **context: Any) -> dict[str, Any]:
        """One rewrite; with ``batch``, ranges of the key, each a version, reported as they are done.

        Ranges follow the key, so rows that still match after they are changed are not met again.
        """
        if mode == "skip":
            return {"ok": True, "processed": 0, "skipped": True, "reason": reason}
        if batch is not None and batch < 1:
            raise Invalid("batch must be positive")

        def body(c: dict) -> dict[str, Any]:
            scoped = self._scope(c["query"], c | {"include_deleted": True})
            plan = lambda part: lambda df: writes.purged(df, part, mode, fields, self.soft_delete or "deleted")
            done, last = 0, None
            try:
                if batch is None:
                    done = apply_filter(self.read(), scoped).count()
                    self._publish(plan(scoped), scoped)
                    if progress:
                        progress(done)
                    return {"ok": True, "processed": done}
                while True:
                    if aborted is not None and aborted.is_set():
                        raise Aborted("aborted between chunks")
                    ahead = scoped if last is None else f.and_(scoped, f.gt(self.key, last))
                    keys = self._keys(ahead, batch)
                    if keys:
                        part = f.and_(ahead, f.lte(self.key, keys[-1]))
                        self._publish(plan(part), part)
                        done, last = done + len(keys), keys[-1]
                        if progress:
                            progress(done)
                    if len(keys) < batch:
                        return {"ok": True, "processed": done}
            except Invalid:
                raise
            except Exception as e:
                return {"ok": False, "processed": done, "error": str(e) if isinstance(e, Aborted) else f"{type(e).__name__}: {e}"}

        return self._run("purge", context | {"query": node}, body)

    def _keys(self, node: Filter, n: int) -> list[Any]:
        """The least n keys of the rows."""
        return [r[0] for r in apply_filter(self.read(), node).select(self.key).orderBy(self.key).limit(n).collect()]

    def archive(self, node: Any, sink: Any, batch: int | None = None, progress: Callable[[int], Any] | None = None, aborted: threading.Event | None = None, **context: Any) -> dict[str, Any]:
        """Rows are written to the sink before they are deleted; a failing sink deletes nothing.

        Each batch has a name of its own, so runs never overwrite each other.  A batch that
        was written but not deleted is written again by the next run; sinks take rows by their
        primary key, so it is stored once.
        """
        if batch is not None and batch < 1:
            raise Invalid("batch must be positive")
        if getattr(sink, "key", "") is None:
            sink.key = self.key

        def body(c: dict) -> dict[str, Any]:
            scoped = self._scope(c["query"], c | {"include_deleted": True})
            run, done, number, phase = uuid.uuid4().hex[:12], 0, 0, "read"
            try:
                while True:
                    if aborted is not None and aborted.is_set():
                        raise Aborted("aborted between batches")
                    phase, part = "read", scoped
                    if batch is not None:
                        keys = self._keys(scoped, batch)
                        if not keys:
                            break
                        part = f.and_(scoped, f.lte(self.key, keys[-1]))
                    rows = apply_filter(self.read(), part)
                    n = rows.count()
                    if n:
                        phase = "write"
                        sink.write(rows, f"{run}-{number}")
                        phase = "delete"
                        self._publish(lambda df, part=part: writes.deleted(df, part), part)
                    done, number = done + n, number + 1
                    if progress:
                        progress(done)
                    if batch is None or n < batch:
                        break
                phase = "flush"
                sink.flush()
                return {"ok": True, "archived": done}
            except Exception as e:
                return {"ok": False, "archived": done, "phase": phase, "error": f"{type(e).__name__}: {e}"}

        return self._run("archive", context | {"query": node}, body)

    def purge_step(self, node: Any, mode: str = "hard", fields: Mapping[str, Any] | None = None, remaining: Any = None, **options: Any) -> dict[str, Callable[[], Any]]:
        """blockers, estimate, execute and verify of one clean-up.

        Without a scope (no filter, or a null value in it) it is blocked: nothing is purged.
        ``verify`` asks the table again, in every mode: no row of the scope may still match
        ``remaining``.  By default that is any row (hard), one not marked (soft), or one that
        lacks a constant of ``fields`` (anonymize; with other fields, ``remaining`` must be given).
        """
        values = list(node.values()) if isinstance(node, Mapping) else None
        missing = node is None or (values is not None and (not values or any(v is None for v in values))) or record_to_filter(node) == f.TRUE
        context = {"include_deleted": True} | {k: v for k, v in options.items() if k in ("tenant", "skip_tenant")}
        count = lambda more=f.TRUE: apply_filter(self.read(), self._scope(f.and_(record_to_filter(node), more), context)).count()

        def left() -> Filter | None:
            if remaining is not None:
                return record_to_filter(remaining)
            if mode == "soft":
                marked = self.soft_delete or "deleted"
                return f.or_(f.is_null(marked), f.eq(marked, False))
            if mode == "anonymize":
                if not fields or any(callable(v) or isinstance(v, Column) for v in fields.values()):
                    return None
                return f.or_(*(f.is_not_null(k) if v is None else f.or_(f.is_null(k), f.ne(k, v)) for k, v in fields.items()))
            return f.TRUE

        def verify() -> bool:
            if missing or mode == "skip":
                return not missing
            rest = left()
            return rest is not None and count(rest) == 0

        def execute() -> dict[str, Any]:
            if missing:
                return {"ok": False, "processed": 0, "error": "the scope is missing"}
            return self.purge(node, mode, fields, **options)

        return {"blockers": lambda: ["scope_required"] if missing else [], "estimate": lambda: 0 if missing else count(), "execute": execute, "verify": verify}
