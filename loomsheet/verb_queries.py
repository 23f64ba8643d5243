"""Queries that run the verbs of a repository, and checks whose results are rows; each with its SQL.

Tables that are written stand in the shared folder until the driver ends.
"""

from __future__ import annotations

import json
import threading
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import paging
from .plans import filters as f
from .plans.requests import Aggregate, Bucket, Lookup, Measure, TopN, Unset, combine_updates, inc_fields, is_pipeline, is_update, set_fields, set_on_insert_fields, unset_fields, update
from .plans.url import parse_url
from .queries import query, rounded
from .repository import Repository
from .runtime import control, errors
from .runtime.cache import Cache, CacheOptions, MemoryAdapter, TimeoutAdapter, cache_key, stable
from .runtime.hooks import OPERATIONS, Hooks, check_plugin_order, emit_events
from .sources.tables import AppendLog, ParquetSink, SnapshotTable, read_table, scratch

ACCOUNTS = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def stored(spark, df: DataFrame, key: str, **options) -> Repository:
    return Repository("stored", SnapshotTable(spark, scratch(spark, "table"), key).create(df), **options)


def accounts(spark, d, *columns: str, **options) -> Repository:
    return stored(spark, read_table(spark, d, "customer").select(*(columns or ACCOUNTS)), "c_custkey", **options)


def listed(spark, found: dict[str, object], kind: str = "string") -> DataFrame:
    return spark.createDataFrame([(k, str(v) if kind == "string" and v is not None else v) for k, v in found.items()], f"what string, value {kind}")


def values(found: dict[str, object], kind: str = "varchar") -> str:
    """SQL of the rows that ``listed`` makes."""
    text = lambda v: "null" if v is None else "'" + str(v).replace("'", "''") + "'"
    return " union all ".join(f"select '{k}' as what, {text(v)}::{kind} as value" for k, v in found.items())


def refused(call) -> bool:
    try:
        call()
    except (ValueError, errors.RepositoryError):
        return True
    return False


# ---- filters ---------------------------------------------------------------


@query("select o_orderkey, 'o_orderstatus,o_totalprice,o_custkey' as fields, 'and,or,eq,gte,not,eq' as kinds from orders where (o_orderstatus = 'F' or o_totalprice >= 150000) and not (o_custkey = 7)")
def filter_traversal(spark, d):
    """A tree is walked, its fields are renamed and listed, and it is told from other objects."""
    node = f.and_(f.or_(f.eq("status", "F"), f.gte("total", 150000)), f.not_(f.eq("owner", 7)))
    node = f.rename(node, {"status": "o_orderstatus", "total": "o_totalprice", "owner": "o_custkey"})
    kinds: list[str] = []
    f.walk(node, lambda n: kinds.append(n.op))
    assert f.is_filter(node) and not f.is_filter({"op": "eq"}) and f.rewrite(node, lambda n: n) is node
    orders = Repository("orders", read_table(spark, d, "orders"), "o_orderkey")
    return orders.rows(node).select("o_orderkey", F.lit(",".join(f.fields_of(node))).alias("fields"), F.lit(",".join(kinds)).alias("kinds"))


# ---- requests that are refused ---------------------------------------------

_GOOD = {"n": Measure("count")}
_REQUESTS = {
    "plain": (Aggregate(_GOOD), False),
    "no measures": (Aggregate({}), True),
    "unknown measure": (Aggregate({"x": Measure("median", "o_totalprice")}), True),
    "measure without a field": (Aggregate({"x": Measure("sum")}), True),
    "percentile beyond 1": (Aggregate({"x": Measure("percentile", "o_totalprice", p=1.5)}), True),
    "bucket named as a measure": (Aggregate(_GOOD, buckets={"n": Bucket("o_orderdate", "day")}), True),
    "bucket named as a group": (Aggregate(_GOOD, "k", {"k": Bucket("o_orderdate", "day")}), True),
    "unknown unit": (Aggregate(_GOOD, buckets={"b": Bucket("o_orderdate", "decade")}), True),
    "bins of quarters": (Aggregate(_GOOD, buckets={"b": Bucket("o_orderdate", "quarter", 2)}), True),
    "bins of no width": (Aggregate(_GOOD, buckets={"b": Bucket("o_orderdate", "day", 0)}), True),
    "bins of weeks": (Aggregate(_GOOD, buckets={"b": Bucket("o_orderdate", "week", 2)}), False),
    "top by no group": (Aggregate(_GOOD, "k", top=TopN("other", {"n": -1}, 1)), True),
    "top of none": (Aggregate(_GOOD, "k", top=TopN("k", {"n": -1}, 0)), True),
    "top in no order": (Aggregate(_GOOD, "k", top=TopN("k", {}, 1)), True),
    "top with odd ties": (Aggregate(_GOOD, "k", top=TopN("k", {"n": -1}, 1, "ntile")), True),
    "top by a bucket": (Aggregate(_GOOD, "k", {"b": Bucket("o_orderdate", "day")}, top=TopN("b", {"n": -1}, 1)), False),
}


@query(values({k: str(v).lower() for k, (_, v) in _REQUESTS.items()}, "boolean"))
def agg_requests_refused(spark, d):
    return listed(spark, {k: refused(r.check) for k, (r, _) in _REQUESTS.items()}, "boolean")


_DIRECTIONS = {"both up": ({"a": 1, "id": 1}, False), "mixed": ({"a": 1, "b": -1}, True), "no sort": ({}, True), "no direction": ({"a": 2}, True)}
_CURSORS = {"same sort": False, "another sort": True, "newer version": True, "too old": True, "not a cursor": True, "torn": True, "wrong type": True}


@query(values({k: str(v).lower() for k, (_, v) in _DIRECTIONS.items()} | {k: str(v).lower() for k, v in _CURSORS.items()}, "boolean"))
def page_cursors_refused(spark, d):
    sort = {"a": 1, "id": 1}
    row = {"a": 3, "id": "x"}
    token = paging.encode_cursor(row, sort, "id")
    check = lambda t, s=sort, **k: lambda: paging.check_cursor(paging.decode_cursor(t), s, **k)
    wrong = paging._token(paging._payload(token, "") | {"types": {"a": "date", "id": "string"}})
    cursors = {
        "same sort": check(token), "another sort": check(token, {"a": -1, "id": -1}), "newer version": check(paging.encode_cursor(row, sort, "id", 9)),
        "too old": check(token, least=2), "not a cursor": check("***"), "torn": check(token[:10]), "wrong type": check(wrong),
    }
    found = {k: refused(lambda s=s: paging.valid_keyset_sort(s, "id")) for k, (s, _) in _DIRECTIONS.items()}
    return listed(spark, found | {k: refused(c) for k, c in cursors.items()}, "boolean")


# ---- reads -----------------------------------------------------------------


def _orders(spark, d, **options) -> Repository:
    return Repository("orders", read_table(spark, d, "orders"), "o_orderkey", **options)


def _as_frame(spark, rows, schema, *names: str) -> DataFrame:
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {schema[n].dataType.simpleString()}" for n in names))


@query("select o_orderkey, o_totalprice from orders where o_orderkey in (5, 33)")
def read_by_id(spark, d):
    """One row by its key each; a key that nobody has gives none."""
    r = _orders(spark, d)
    rows = [x for x in (r.get_by_id(5), r.get_by_id(33), r.get_by_id(-1)) if x is not None]
    return _as_frame(spark, rows, r.schema, "o_orderkey", "o_totalprice")


@query("select * from (select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey limit 1) union all select * from (select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 1)")
def read_one(spark, d):
    r = _orders(spark, d)
    rows = [r.get_one({"o_orderstatus": "F"}, {"o_totalprice": -1, "o_orderkey": 1}), r.get_by_query(f.eq("o_orderstatus", "O"), {"o_orderdate": 1, "o_orderkey": 1})]
    return _as_frame(spark, rows, r.schema, "o_orderkey", "o_totalprice")


@query("select o_orderkey, o_orderpriority from orders where o_totalprice > 200000 order by o_totalprice desc, o_orderkey limit 25")
def read_find_all(spark, d):
    r = _orders(spark, d)
    return _as_frame(spark, r.find_all(f.gt("o_totalprice", 200000), {"o_totalprice": -1, "o_orderkey": 1}, 25, ["o_orderkey", "o_orderpriority"]), r.schema, "o_orderkey", "o_orderpriority")


@query("select o_orderkey, row_number() over (order by o_orderkey) as place from orders where o_totalprice > 250000")
def read_cursor(spark, d):
    """Row by row in key order."""
    rows = [(x["o_orderkey"], i) for i, x in enumerate(_orders(spark, d).cursor(f.gt("o_totalprice", 250000)), 1)]
    return spark.createDataFrame(rows, "o_orderkey long, place long")


@query("select o_orderkey, o_totalprice from orders where o_orderkey in (1, 5, 33, 70, 999999999) and o_orderstatus <> 'P'")
def read_by_ids_under_a_policy(spark, d):
    r = _orders(spark, d)
    r.hooks.on("before:getByIds", lambda c: c.update(query=f.ne("o_orderstatus", "P")), 100)
    found = r.get_by_ids([1, "5", 33, 70, 5, 999999999, "no number", None])
    return _as_frame(spark, found.values(), r.schema, "o_orderkey", "o_totalprice")


@query("select c_mktsegment as segment from customer group by 1")
def read_distinct(spark, d):
    r = Repository("customer", read_table(spark, d, "customer"), "c_custkey")
    return spark.createDataFrame([(x,) for x in r.distinct("c_mktsegment")], "segment string")


@query("select 'live' as what, count(*) as value from customer where c_acctbal >= 0 union all select 'deleted', count(*) from customer where c_acctbal < 0 union all select 'all', count(*) from customer union all select 'live of nation 3', count(*) from customer where c_acctbal >= 0 and c_nationkey = 3 union all select 'all of nation 3', count(*) from customer where c_nationkey = 3")
def read_deleted_and_options(spark, d):
    """Soft deletes are left out unless asked for, with and without a tenant."""
    df = read_table(spark, d, "customer").withColumn("deleted", F.col("c_acctbal") < 0)
    r = Repository("customer", df, "c_custkey", soft_delete="deleted", tenancy=control.Tenancy(field="c_nationkey", required=False))
    found = {"live": r.count(), "deleted": len(r.get_deleted()), "all": r.count(include_deleted=True), "live of nation 3": r.count(tenant=3), "all of nation 3": r.count(tenant=3, include_deleted=True)}
    return listed(spark, found, "long")


_PAGES = {
    "first": (1, 10, "F", 10), "second": (2, 10, "F", 10), "last": ("last", 50, "F", 50), "beyond": (5000, 10, "F", 10), "no rows": (1, 10, "none", 10),
    "page 0": (0, 10, "F", 10), "odd page": ("x", 10, "F", 10), "limit 1000": (1, 1000, "F", 100), "limit 0": (1, 0, "F", 10), "odd limit": (1, "x", "F", 10), "fraction": (1.9, 10.7, "F", 10),
}


def _page_sql() -> str:
    out = []
    for what, (page, _, status, n) in _PAGES.items():
        pages = f"cast(ceil(c / {n}.0) as bigint)"
        at = pages if page == "last" else str(int(page) if isinstance(page, (int, float)) and page >= 1 else 1)
        out.append(f"select '{what}' as what, ({at})::bigint as page, {n}::bigint as \"limit\", c as total, {pages} as pages, ({at}) < {pages} as has_next, ({at}) > 1 as has_prev, greatest(0, least({n}, c - (({at}) - 1) * {n}))::bigint as n, (({at}) > 100) as deep from (select count(*) c from orders where o_orderstatus = '{status}')")
    return " union all ".join(out)


@query(_page_sql())
def page_envelopes(spark, d):
    """Pages by number: limits and page numbers made valid, totals, edges; the last page, however many there are."""
    r, rows = _orders(spark, d, max_page=0), []
    last = {"F": -(-r.count({"o_orderstatus": "F"}) // 50)}
    for what, (page, limit, status, _) in _PAGES.items():
        p = r.get_all({"o_orderstatus": status}, page=last[status] if page == "last" else page, limit=limit, sort={"o_orderkey": 1})
        assert paging.canonical(p)["kind"] == "offset" and paging.is_page(p)
        rows.append((what, p.page, p.limit, p.total, p.pages, p.has_next, p.has_prev, len(p.data), p.warning is not None))
    return spark.createDataFrame(rows, "what string, page long, limit long, total long, pages long, has_next boolean, has_prev boolean, n long, deep boolean")


@query("select 'uncounted' as what, 0::bigint as total, (count(*) > 10) as has_next, least(10, count(*))::bigint as n from orders where o_orderstatus = 'F' union all select 'populated', 0, (count(*) > 7), least(7, count(*)) from orders where o_orderstatus = 'F' union all select 'bare', count(*), false, count(*) from orders where o_orderstatus = 'F' and o_totalprice > 300000 union all select 'groups', 0, (count(distinct o_custkey) > 5), least(5, count(distinct o_custkey)) from orders")
def page_without_a_count(spark, d):
    """No total is asked for: one row more is read instead; without paging all rows come."""
    r = _orders(spark, d)
    first = r.get_all({"o_orderstatus": "F"}, page=1, limit=10, count="none")
    some = r.lookup_populate([], {"o_orderstatus": "F"}, limit=7, count="none")
    bare = r.get_all({"o_orderstatus": "F", "o_totalprice": {"gt": 300000}})
    groups = r.aggregate_paginate(Aggregate(_GOOD, "o_custkey"), limit=5, count="none")
    assert paging.canonical(bare)["kind"] == "bare"
    rows = [("uncounted", first.total, first.has_next, len(first.data)), ("populated", some.total, some.has_next, len(some.data)), ("bare", len(bare), False, len(bare)), ("groups", groups.total, groups.has_next, len(groups.data))]
    return spark.createDataFrame(rows, "what string, total long, has_next boolean, n long")


@query("select o_orderkey, o_orderpriority from orders where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey desc limit 45")
def page_keyset_selected(spark, d):
    """Keyset pages that show other columns than those they are sorted by."""
    r, rows, token = _orders(spark, d), [], None
    for _ in range(3):
        page = r.query(f"o_orderstatus=O&sort=-o_orderdate&select=o_orderkey,o_orderpriority&limit=15{f'&after={token}' if token else ''}")
        rows, token = rows + page.data, page.next
    return _as_frame(spark, rows, r.schema, "o_orderkey", "o_orderpriority")


@query("select o_custkey, n, total_rows, (select count(distinct o_custkey) from orders) as groups from (select o_custkey, count(*) n, count(*) as total_rows from orders group by 1 order by n desc, o_custkey limit 20 offset 20)")
def agg_paginate_offset(spark, d):
    page = _orders(spark, d).aggregate_paginate(Aggregate({"n": Measure("count"), "total_rows": Measure("count", "o_orderkey")}, "o_custkey", sort={"n": -1}), page=2, limit=20)
    return spark.createDataFrame([(*r, page.total) for r in page.data], "o_custkey long, n long, total_rows long, groups long")


@query("select o_custkey, n from (select o_custkey, count(*) n from orders group by 1) order by n desc, o_custkey limit 50")
def agg_paginate_keyset(spark, d):
    r, rows, token = _orders(spark, d), [], None
    for _ in range(5):
        page = r.aggregate_paginate(Aggregate(_GOOD, "o_custkey", sort={"n": -1}), limit=10, pagination="keyset", after=token)
        rows, token = rows + page.data, page.next
    return spark.createDataFrame(rows, "o_custkey long, n long")


@query("select o_orderpriority, count(*) n, round(sum(o_totalprice), 2) total from orders where o_orderstatus <> 'P' group by 1")
def agg_within_time(spark, d):
    """An aggregate with a time limit that it keeps, under a policy set by a hook."""
    r = _orders(spark, d)
    r.hooks.on("before:aggregate", lambda c: c.update(query={"o_orderstatus": {"ne": "P"}}), 100)
    rows = r.aggregate(Aggregate(_GOOD | {"total": Measure("sum", "o_totalprice")}, "o_orderpriority", hints={"max_time_ms": 600_000}))
    return rounded(spark.createDataFrame(rows, "o_orderpriority string, n long, total double"), "total", digits=2)


@query("select l_returnflag, median(l_quantity) between 20 and 30 as middle, count(*) n from lineitem group by 1")
def agg_percentile_approximate(spark, d):
    m = {"p": Measure("percentile", "l_quantity", p=0.5, accuracy=10_000), "n": Measure("count")}
    rows = Repository("lineitem", read_table(spark, d, "lineitem")).aggregate_frame(Aggregate(m, "l_returnflag"))
    return rows.select("l_returnflag", F.col("p").between(20, 30).alias("middle"), "n")


@query("select o_orderkey, c_name, n_name from (select * from orders where o_orderstatus = 'F' order by o_orderdate, o_orderkey limit 40) left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey")
def lookup_keyset_pages(spark, d):
    """Populated keyset pages, each from the cursor of the one before."""
    r = _orders(spark, d, catalog={n: read_table(spark, d, n) for n in ("customer", "nation")})
    lookups = [Lookup("customer", "o_custkey", "c_custkey", single=True, select=["c_name", "c_nationkey"]), Lookup("nation", "customer.c_nationkey", "n_nationkey", single=True, select=["n_name"])]
    rows, token = [], ""
    for _ in range(2):
        page = r.lookup_populate(lookups, {"o_orderstatus": "F"}, sort={"o_orderdate": 1}, after=token, limit=20)
        rows, token = rows + [(x["o_orderkey"], x["customer"]["c_name"], x["nation"]["n_name"]) for x in page.data], page.next
    return spark.createDataFrame(rows, "o_orderkey long, c_name string, n_name string")


@query("select c_custkey, n_name as nation from (select c_custkey, c_nationkey from customer where c_name ilike '%0001%' or c_mktsegment ilike '%0001%' order by c_acctbal desc, c_custkey desc limit 15) left join (select * from nation where n_regionkey = 1) on n_nationkey = c_nationkey")
def url_populate(spark, d):
    """A relation in a query string, with its own columns and match, beside a search."""
    customers = read_table(spark, d, "customer").withColumnRenamed("c_nationkey", "nation")
    nations = read_table(spark, d, "nation").withColumnRenamed("n_nationkey", "id")
    r = Repository("customer", customers, "c_custkey", catalog={"nation": nations}, text_fields=["c_name", "c_mktsegment"])
    page = r.query("search=0001&sort=-c_acctbal,-c_custkey&limit=15&page=1&populate=nation&populate[nation][select]=n_name&populate[nation][match][n_regionkey]=1")
    return spark.createDataFrame([(x["c_custkey"], x["nation"]["n_name"] if x["nation"] else None) for x in page.data], "c_custkey long, nation string")


_URLS = {
    "eq": ("o_orderstatus=F", "o_orderstatus = 'F'"), "eq named": ("o_orderstatus[eq]=F", "o_orderstatus = 'F'"), "eq null": ("o_orderstatus=null", "o_orderstatus is null"),
    "ne": ("o_orderstatus[ne]=F", "o_orderstatus <> 'F'"), "gt": ("o_totalprice[gt]=1000.5", "o_totalprice > 1000.5"), "gte": ("o_custkey[gte]=70", "o_custkey >= 70"),
    "lt": ("o_orderdate[lt]=1996-01-01", "o_orderdate < timestamp '1996-01-01'"), "lte": ("o_orderdate[lte]=1996-01-01T00:00:00Z", "o_orderdate <= timestamp '1996-01-01'"),
    "in": ("o_orderstatus[in]=F, P,", "o_orderstatus in ('F', 'P')"), "nin": ("o_custkey[nin]=1,2,3", "o_custkey not in (1, 2, 3)"),
    "like": ("o_orderpriority[like]=_-%25O%25", "o_orderpriority ilike '_-%o%'"), "contains": ("o_orderpriority[contains]=URG", "o_orderpriority ilike '%urg%'"),
    "startsWith": ("o_orderpriority[startsWith]=1-u", "o_orderpriority ilike '1-u%'"), "endsWith": ("o_orderpriority[endsWith]=low", "o_orderpriority ilike '%low'"),
    "ieq": ("o_orderpriority[ieq]=5-low", "lower(o_orderpriority) = '5-low'"), "regex": ("o_orderpriority[regex]=^[12]-", "regexp_matches(o_orderpriority, '^[12]-')"),
    "between": ("o_totalprice[between]=1000,90000.5", "o_totalprice between 1000 and 90000.5"), "exists": ("o_orderstatus[exists]=true", "o_orderstatus is not null"),
    "not exists": ("o_orderstatus[exists]=0", "o_orderstatus is null"), "anded": ("o_custkey[gt]=5&o_custkey[lt]=90&o_orderstatus=O", "o_custkey > 5 and o_custkey < 90 and o_orderstatus = 'O'"),
}


@query(" union all ".join(f"select '{k}' as what, count(*) as value from orders where {c}" for k, (_, c) in _URLS.items()))
def url_operators(spark, d):
    r = _orders(spark, d)
    return listed(spark, {k: r.query(f"{u}&page=1&limit=1").total for k, (u, _) in _URLS.items()}, "long")


_FORMS = {
    "text": "a eq 1", "mapping": "a eq 1", "pairs": "a eq 1, b eq 2", "lists in a mapping": "a eq 1, a eq 2", "reserved keys": "", "unknown operator": "", "fields allowed": "a eq 1", "operators allowed": "a eq 1",
    "sort allowed": "{'a': -1}", "limit above the cap": "200", "limit of the caller": "30", "no limit": "20", "odd limit": "20", "very long key": "", "very long pattern": "", "long search": "200",
    "number hint": "7", "string hint": "7", "boolean hint": "True", "date hint": "2026-01-05 00:00:00", "by shape": "True", "dotted number": "1.5", "whole number": "7", "date by shape": "2026-01-05 00:00:00",
    "one bound": "", "inclusions": "{'a': 1, 'b': 1}", "exclusions": "{'a': 0}", "relations": "r,s",
}


@query(values(_FORMS))
def url_forms(spark, d):
    """What a query string is read as: forms of the input, reserved keys, allow-lists, caps, hints."""

    def leaves(*a, **k) -> str:
        found: list[str] = []
        f.walk(parse_url(*a, **k).filter, lambda n: found.append(f"{n.field} {n.op} {n.value}") if n.field else None)
        return ", ".join(found)

    one = lambda text, hint=None: parse_url(f"a={text}", types={"a": hint} if hint else None).filter.value
    found = {
        "text": leaves("?a=1"), "mapping": leaves({"a": "1", "b": None}), "pairs": leaves([("a", "1"), ("b", 2)]), "lists in a mapping": leaves({"a": ["1", "2"]}),
        "reserved keys": leaves("page=1&limit=5&after=x&sort=a&select=a&populate=r&search=q&_count=1&_distinct=a&_exists=1"), "unknown operator": leaves("a[near]=1"),
        "fields allowed": leaves("a=1&b=2", fields=["a"]), "operators allowed": leaves("a=1&b[gt]=2", operators=["eq"]), "sort allowed": parse_url("sort=-a,b", sortable=["a"]).sort,
        "limit above the cap": parse_url("limit=5000").limit, "limit of the caller": parse_url("limit=50", max_limit=30).limit, "no limit": parse_url("a=1").limit, "odd limit": parse_url("limit=-3").limit,
        "very long key": leaves({"a" * 300: "1"}), "very long pattern": leaves({"a[regex]": "x" * 600}), "long search": len(parse_url({"search": "x" * 900}).search),
        "number hint": one("7", "number"), "string hint": one("7", "string"), "boolean hint": one("1", "boolean"), "date hint": one("2026-01-05", "date"), "by shape": one("true"),
        "dotted number": one("1.5"), "whole number": one("7"), "date by shape": one("2026-01-05"), "one bound": leaves("a[between]=1"),
        "inclusions": parse_url("select=a,b").select, "exclusions": parse_url("select=-a").select, "relations": ",".join(x.path for x in parse_url("populate=r,s").populate),
    }
    return listed(spark, found)


@query("select event_type as kind, strftime(ts, '%Y-%m-%d') as day, count(*) n from events group by 1, 2")
def bucket_epoch_millis(spark, d):
    """Epoch milliseconds give the labels that timestamps give."""
    df = read_table(spark, d, "events").select(F.col("event_type").alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    return Repository("events", df).aggregate_frame(Aggregate(_GOOD, "kind", {"day": Bucket("at", "day")}))


# ---- writes ----------------------------------------------------------------

_CUSTOMER = "select c_custkey, c_name, c_acctbal from customer"


@query(f"{_CUSTOMER} union all select -1, 'one', null union all select -2, 'two', 2.5 union all select -3, 'three', null")
def write_create(spark, d):
    """Rows are added; a taken key, also within a call, is refused and adds nothing."""
    r = accounts(spark, d, "c_custkey", "c_name", "c_acctbal")
    r.create({"c_custkey": -1, "c_name": "one"})
    r.create_many([{"c_custkey": -2, "c_name": "two", "c_acctbal": 2.5}, {"c_custkey": -3, "c_name": "three"}])
    assert refused(lambda: r.create({"c_custkey": -1})) and refused(lambda: r.create_many([{"c_custkey": -9}, {"c_custkey": -9}]))
    return r.read()


@query("select c_custkey, case when c_custkey = 5 then 'five' when c_custkey = 6 then null else c_name end as c_name, case when c_custkey = 5 then c_acctbal + 10 else c_acctbal end as c_acctbal from customer")
def write_update(spark, d):
    r = accounts(spark, d, "c_custkey", "c_name", "c_acctbal", unique=[("c_name",)])
    r.update(5, combine_updates(set_fields(c_name="five"), inc_fields(c_acctbal=10)))
    r.update(6, unset_fields("c_name"))
    assert r.update(-5, {"c_name": "nobody"}) is None and refused(lambda: r.update(7, {"c_name": "five"}))
    return r.read()


@query("select c_custkey, case when c_mktsegment = 'BUILDING' then 'B' else c_mktsegment end as c_mktsegment, (select count(*) from customer where c_mktsegment in ('BUILDING')) as matched, (select count(*) from customer where c_mktsegment = 'BUILDING') as modified from customer")
def write_update_many(spark, d):
    r = accounts(spark, d)
    n = r.update_many({"c_mktsegment": "BUILDING"}, {"c_mktsegment": "B"})
    again = r.update_many({"c_mktsegment": "B"}, {"c_mktsegment": "B"})
    assert again == {"matchedCount": n["modifiedCount"], "modifiedCount": 0}
    return r.read().select("c_custkey", "c_mktsegment", F.lit(n["matchedCount"]).cast("long").alias("matched"), F.lit(n["modifiedCount"]).cast("long").alias("modified"))


@query("select c_custkey, c_name, c_nationkey from customer union all select -1, 'new', 7")
def write_get_or_create(spark, d):
    r = accounts(spark, d, "c_custkey", "c_name", "c_nationkey")
    assert r.get_or_create({"c_custkey": -1}, {"c_name": "new", "c_nationkey": 7})["created"]
    assert not r.get_or_create({"c_custkey": -1}, {"c_name": "other"})["created"] and not r.get_or_create({"c_custkey": 3}, {"c_name": "other"})["created"]
    return r.read()


@query("select c_custkey, c_name from customer where c_custkey not in (1, 2) and c_nationkey <> 4 union all select c_custkey, case when c_custkey = 1 then 'first' else c_name end from customer where c_custkey = 1 and c_nationkey <> 4 union all select -1, 'inserted' union all select -2, 'upserted'")
def write_bulk(spark, d):
    r = accounts(spark, d, "c_custkey", "c_name", "c_nationkey")
    before = r.source.version
    n = r.bulk_write([
        {"insertOne": {"document": {"c_custkey": -1, "c_name": "inserted"}}}, {"updateOne": {"filter": {"c_custkey": 1}, "update": {"c_name": "first"}}},
        {"updateOne": {"filter": {"c_custkey": -2}, "update": set_on_insert_fields(c_name="upserted"), "upsert": True}}, {"deleteOne": {"filter": {"c_custkey": 2}}}, {"deleteMany": {"filter": {"c_nationkey": 4}}},
    ])
    assert n["inserted"] == n["upserted"] == 1 and r.source.version == before + 1
    return r.read().select("c_custkey", "c_name")


@query("select c_custkey, case when c_custkey in (3, 4) then 2 else 1 end::bigint as version, case when c_custkey = 4 then 'patched' else c_name end as c_name from customer")
def write_claim_version(spark, d):
    """Only the holder of the current version may write."""
    df = read_table(spark, d, "customer").select("c_custkey", F.lit(1).cast("long").alias("version"), "c_name")
    r = stored(spark, df, "c_custkey")
    assert r.claim_version(3, 1) and r.claim_version(3, 1) is None and r.claim_version(4, 1, patch=set_fields(c_name="patched")) and r.claim_version(-1, 1) is None
    return r.read()


@query("select o_orderkey, case when o_orderkey = k then 'C' else o_orderstatus end as status, case when o_orderkey = k then 'O>C' end as history from (select *, (select min(o_orderkey) from orders where o_orderstatus = 'O') k from orders)")
def write_transition(spark, d):
    """A state change that the machine allows, with an entry in the row's history."""
    history = F.array().cast("array<struct<from:string,to:string,at:timestamp>>")
    r = stored(spark, read_table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), history.alias("history")), "o_orderkey")
    machine = control.StateMachine("status", {"O": ["C"], "F": []})
    first = r.get_one({"status": "O"}, {"o_orderkey": 1})["o_orderkey"]
    r.apply_transition(first, machine, "C", history="history")
    assert refused(lambda: r.apply_transition(first, machine, "O")) and refused(lambda: r.apply_transition(-1, machine, "C")) and machine.sources("C") == ["O"]
    entry = F.transform("history", lambda x: F.concat(x["from"], F.lit(">"), x["to"]))
    return r.read().select("o_orderkey", "status", F.when(F.size("history") > 0, F.array_join(entry, ",")).alias("history"))


@query("select c_custkey, c_nationkey = 2 and c_custkey <> (select min(c_custkey) from customer where c_nationkey = 2) as deleted from customer")
def write_delete_and_restore(spark, d):
    """Soft deletes of many, one of which is taken back."""
    df = read_table(spark, d, "customer").select("c_custkey", "c_nationkey", F.lit(False).alias("deleted"))
    r = stored(spark, df, "c_custkey", soft_delete="deleted")
    n = r.delete_many({"c_nationkey": 2})["deletedCount"]
    back = min((x["c_custkey"] for x in r.get_deleted()), default=None)
    assert len(r.get_deleted()) == n and r.delete(back) is None
    assert r.restore(back)["deleted"] is False and r.restore(-1) is None
    return r.read().select("c_custkey", "deleted")


@query("select c_custkey, c_acctbal, c_name from customer where c_custkey <> 9 union all select -1, 0.5, 'kept'")
def write_transactions(spark, d):
    """One transaction holds, one is rolled back, one is tried again after a conflict."""
    r = accounts(spark, d, "c_custkey", "c_acctbal", "c_name")

    def fails(t):
        t.delete_many({})
        assert t.count() == 0
        raise RuntimeError

    def both(t):
        t.create({"c_custkey": -1, "c_acctbal": 0.5, "c_name": "kept"})
        assert t.exists({"c_custkey": -1})

    r.transaction(both)
    try:
        r.transaction(fails)
    except RuntimeError:
        pass
    tries = []

    def contested(t):
        t.delete_many({"c_custkey": 9})
        if not tries.append(1) and len(tries) == 1:  # another writer is first
            r.source.publish(r.source.read(), r.source.version)

    r.retrying_transaction(contested, control.RetryPolicy(attempts=3, base=0.01))
    assert len(tries) == 2
    return r.read()


_DOCUMENT = combine_updates(set_fields(a=1), unset_fields("b"), inc_fields(c=2), set_on_insert_fields(e=5))
_UPDATES = {
    "document": '{"$inc": {"c": 2}, "$set": {"a": 1}, "$setOnInsert": {"e": 5}, "$unset": {"b": ""}}', "left out": '{"$set": {"a": 1}}', "tabular": '{"data": {"a": 1}, "inc": {"c": 2}, "insert_defaults": {"e": 5}, "unset": ["b"]}',
    "is update": "True", "is no update": "False", "pipeline": "True", "empty refused": "True", "not given": '{"$set": {"b": 2}}',
}


@query(values(_UPDATES))
def write_update_plans(spark, d):
    text = lambda x: json.dumps(x, sort_keys=True)
    found = {
        "document": text(_DOCUMENT.document_plan()), "left out": text(set_fields(a=1).document_plan()), "tabular": text(_DOCUMENT.plan()), "is update": is_update(_DOCUMENT), "is no update": is_update({"$set": {}}),
        "pipeline": is_pipeline([{"$set": {}}]), "empty refused": refused(update), "not given": text(update(set={"a": Unset, "b": 2}).document_plan()),
    }
    return listed(spark, found)


@query("select o_orderkey, o_totalprice, case when o_custkey < 30 then 'gone' else o_orderpriority end as o_orderpriority, (select count(*) from orders where o_custkey < 30) as processed from orders")
def purge_in_chunks(spark, d):
    """Chunk by chunk in key order; rows that still match are not met again; progress adds up."""
    r = stored(spark, read_table(spark, d, "orders"), "o_orderkey")
    n = max(1, -(-r.count(f.lt("o_custkey", 30)) // 3))
    progress: list[int] = []
    out = r.purge(f.lt("o_custkey", 30), "anonymize", {"o_orderpriority": "gone"}, batch=n, progress=progress.append)
    assert out["ok"] and progress[-1] == out["processed"] and progress == sorted(progress) and len(progress) <= 4
    stop = threading.Event()
    stop.set()
    assert not r.purge({}, "hard", batch=5, aborted=stop)["ok"] and r.purge({}, "skip")["processed"] == 0
    return r.read().select("o_orderkey", "o_totalprice", "o_orderpriority", F.lit(out["processed"]).cast("long").alias("processed"))


@query("select c_custkey, c_name, case when c_nationkey = 3 then 'n3-' || length(c_name) else c_mktsegment end as c_mktsegment from customer")
def purge_by_function(spark, d):
    """Anonymised by a function that is called with each row."""
    from .operators.writes import per_row

    r = accounts(spark, d)
    hide = per_row(lambda x: f"n{x['c_nationkey']}-{len(x['c_name'])}", "string", "c_nationkey", "c_name")
    r.purge({"c_nationkey": 3}, "anonymize", {"c_mktsegment": hide})
    return r.read().select("c_custkey", "c_name", "c_mktsegment")


@query("select 'blocked' as what, 'scope_required' as value union all select 'estimate', count(*)::varchar from customer where c_nationkey = 5 union all select 'before', (count(*) = 0)::varchar from customer where c_nationkey = 5 union all select 'processed', count(*)::varchar from customer where c_nationkey = 5 union all select 'after', 'true' union all select 'left', count(*)::varchar from customer where c_nationkey <> 5 union all select 'without a scope', 'false'")
def purge_steps(spark, d):
    r = accounts(spark, d)
    none, step = r.purge_step({"c_nationkey": None}), r.purge_step({"c_nationkey": 5})
    yes = lambda x: str(bool(x)).lower()
    found = {"blocked": none["blockers"]()[0], "without a scope": yes(none["execute"]()["ok"]), "estimate": step["estimate"](), "before": yes(step["verify"]())}
    found |= {"processed": step["execute"]()["processed"], "after": yes(step["verify"]()), "left": r.count()}
    return listed(spark, found)


@query("select o_orderkey, o_custkey, case when o_orderdate < timestamp '1998-01-01' then 'archived' else 'kept' end as part from orders")
def archive_runs(spark, d):
    """Two runs into one archive, one in batches, and one that fails after its batch is stored: every row stands once."""
    r = stored(spark, read_table(spark, d, "orders"), "o_orderkey")
    folder = scratch(spark, "archive")
    before = lambda year: f.lt("o_orderdate", datetime(year, 1, 1))

    class Late(ParquetSink):
        def flush(self) -> None:
            pass

        def write(self, rows, batch):
            super().write(rows, batch)
            raise OSError("after it was stored")

    assert r.archive(before(1996), ParquetSink(folder))["ok"]
    assert not r.archive(before(1997), Late(folder))["ok"]
    n = max(1, -(-r.count(before(1998)) // 3))
    assert r.archive(before(1998), ParquetSink(folder), batch=n)["ok"]
    cold = spark.read.parquet(folder).select("o_orderkey", "o_custkey", F.lit("archived").alias("part"))
    return cold.union(r.read().select("o_orderkey", "o_custkey", F.lit("kept").alias("part")))


_GUARDS = {"named": "true", "nested": "true", "not named": "false", "refused": "true", "all sides": "a,b"}


@query(values(_GUARDS))
def guard_partition_key(spark, d):
    yes = lambda x: str(bool(x)).lower()
    found = {
        "named": yes(control.guard_distribution(f.eq("a", 1), "a", "off")), "nested": yes(control.guard_distribution(f.or_(f.eq("b", 1), f.and_(f.eq("a", 1), f.gt("c", 2))), "a", "off")),
        "not named": yes(control.guard_distribution(f.eq("b", 1), "a", "off")), "refused": yes(refused(lambda: control.guard_distribution(f.TRUE, "a", "throw"))),
        "all sides": ",".join(sorted(control.fields_required(f.and_(f.eq("a", 1), f.or_(f.eq("b", 1), f.and_(f.eq("b", 2), f.eq("c", 3))))))),
    }
    return listed(spark, found)


@query("select n_nationkey::varchar as docId, case when n_regionkey = 1 then 'delete' else 'update' end as op, lpad((row_number() over (order by n_nationkey))::varchar, 20, '0') as cursor from nation")
def changelog_append(spark, d):
    """Entries get their numbers in the order they are appended, over several calls."""
    rows = read_table(spark, d, "nation").orderBy("n_nationkey").collect()
    log = AppendLog(spark, scratch(spark, "log"))
    entries = [{"scope": "nations", "docId": str(r["n_nationkey"]), "op": "delete" if r["n_regionkey"] == 1 else "update", "doc": {"name": r["n_name"]}} for r in rows]
    log.append(entries[:10])
    log.append(entries[10:])
    page = log.since(None, limit=500)
    assert not page["hasMore"] and log.latest() == page["cursor"]
    return spark.createDataFrame([(e["docId"], e["op"], e["cursor"]) for e in page["entries"]], "docId string, op string, cursor string")


_LOCKS = {"taken": "true", "second": "false", "renewed": "true", "late release": "false", "after its time": "true", "token grows": "true", "released": "true", "within": "ok", "holder": "none"}


@query(values(_LOCKS))
def locks(spark, d):
    now = [0.0]
    held = control.MemoryLocks(lambda: now[0])
    yes = lambda x: str(bool(x)).lower()
    a = held.acquire("x", 5)
    found = {"taken": yes(a), "second": yes(held.acquire("x", 5)), "renewed": yes(held.renew(a, 5))}
    now[0] = 6
    b = held.acquire("x", 5)
    found |= {"after its time": yes(b), "token grows": yes(b.token > a.token), "late release": yes(held.release(a)), "released": yes(held.release(b)), "within": held.with_lock("x", 1, lambda lease: "ok"), "holder": held.holder("x") and "some" or "none"}
    return listed(spark, found)


# ---- cache, hooks, tenancy -------------------------------------------------

_CACHE = {"first": "miss", "again": "fresh", "later": "stale", "gone": "miss", "bypass": "bypass", "off": "disabled", "loads": "4", "stale while renewed": "1", "tagged": "1", "key": "same", "other hints": "same", "stable": '{"a":[1,2],"b":null}', "late adapter": None, "oldest": None, "one flight": "1", "version": "1"}


@query(values(_CACHE))
def cache_states(spark, d):
    """Freshness, tags, versions, keys, single flight, bounded adapters."""
    import time

    now, calls = [0.0], []
    cache = Cache(now=lambda: now[0])
    load = lambda: calls.append(1) or len(calls)
    o = CacheOptions(stale_time=10, gc_time=10, tags=("t",))
    found = {"first": cache.state("k", o)[0]}
    cache.fetch("k", load, o)
    found["again"] = cache.state("k", o)[0]
    now[0] = 11
    found["later"] = cache.state("k", o)[0]
    now[0] = 30
    found["gone"] = cache.state("k", o)[0]
    found |= {"bypass": cache.state("k", CacheOptions(bypass=True))[0], "off": cache.state("k", CacheOptions(enabled=False))[0]}
    cache.fetch("k", load, o)
    cache.fetch("k", load, CacheOptions(enabled=False))
    cache.fetch("k", load, CacheOptions(bypass=True, stale_time=10, tags=("t",)))
    found["loads"] = len(calls)
    cache.put("s", 1, CacheOptions(stale_time=1, gc_time=60, swr=True))
    now[0] += 5
    found["stale while renewed"] = cache.fetch("s", lambda: 2, CacheOptions(stale_time=1, gc_time=60, swr=True))
    found["tagged"] = cache.invalidate_tags("t")
    key = cache_key("op", "m", 1, {"a": 1, "b": 2})
    found["key"] = "same" if key == cache_key("op", "m", 1, {"b": 2, "a": 1}) != cache_key("op", "m", 2, {"a": 1, "b": 2}) else "other"
    found["other hints"] = "same" if key == cache_key("op", "m", 1, {"a": 1, "b": 2, "hints": 3}) else "other"
    found["stable"] = stable({"b": float("nan"), "a": {2, 1}})
    found["late adapter"] = TimeoutAdapter(type("Slow", (), {"get": lambda self, k: time.sleep(0.5)})(), 0.05).get("x")
    small = MemoryAdapter(2)
    for k in "abc":
        small.set(k, k)
    found["oldest"] = small.get("a")
    flights, gate = [], threading.Event()
    threads = [threading.Thread(target=lambda: cache.fetch("one", lambda: gate.wait(5) and flights.append(1), o)) for _ in range(4)]
    for t in threads:
        t.start()
    time.sleep(0.1)
    gate.set()
    for t in threads:
        t.join()
    found |= {"one flight": len(flights), "version": cache.bump("m")}
    return listed(spark, found)


@query("select 'all' as what, count(*) as value from customer union all select 'nation 1', count(*) from customer where c_nationkey = 1 union all select 'nation 2', count(*) from customer where c_nationkey = 2 union all select 'guest', count(*) from customer where c_nationkey = 1 and c_acctbal > 0 union all select 'all again', count(*) from customer union all select 'inside', 0 union all select 'rolled back', count(*) from customer where c_nationkey = 1 union all select 'after a write', count(*) + 1 from customer where c_nationkey = 1")
def cache_keeps_readers_apart(spark, d):
    """Cached counts of several tenants and policies, within and after transactions and writes."""
    r = accounts(spark, d, tenancy=control.Tenancy(field="c_nationkey"), cache=Cache())
    o = CacheOptions(stale_time=600)
    found = {"all": r.count(cache=o, skip_tenant=True), "nation 1": r.count(cache=o, tenant=1), "nation 2": r.count(cache=o, tenant=2)}
    off = r.hooks.on("before:count", lambda c: c.update(query=f.gt("c_acctbal", 0)), 100)
    found["guest"] = r.count(cache=o, tenant=1)
    off()
    found["all again"] = r.count(cache=o, skip_tenant=True)

    def body(t):
        t.delete_many({}, tenant=1)
        found["inside"] = t.count(cache=o, tenant=1)
        raise RuntimeError

    try:
        r.transaction(body)
    except RuntimeError:
        found["rolled back"] = r.count(cache=o, tenant=1)
    r.create({"c_custkey": -1}, tenant=1)
    found["after a write"] = r.count(cache=o, tenant=1)
    return listed(spark, found, "long")


@query("select 'policy' as what, count(*)::varchar as value from nation where n_regionkey = 1 union all select 'by id', null union all select 'order', 'policy,cache,default' union all select 'events', 'nation.created,nation.updated,nation.deleted' union all select 'failing listener', '1' union all select 'error hook', 'DuplicateKey' union all select 'answered by a hook', '42' union all select 'plugin order', 'refused' union all select 'sealed', 'refused' union all select 'sealed read', count(*)::varchar from nation union all select 'query operations', 'delete,getById,restore,update'")
def hooks_and_policies(spark, d):
    r = stored(spark, read_table(spark, d, "nation"), "n_nationkey")
    r.name = "nation"
    found, order, sent, failed = {}, [], [], []
    offs = [r.hooks.on(f"before:{op}", lambda c: c.update(query=f.eq("n_regionkey", 1)), 100) for op in ("count", "getById")]
    found["policy"] = r.count()
    found["by id"] = r.get_by_id(0)["n_name"] if r.get_by_id(0) and r.get_by_id(0)["n_regionkey"] != 1 else None
    for off in offs:
        off()
    for name, priority in (("default", 500), ("policy", 100), ("cache", 200)):
        r.hooks.on("before:exists", lambda c, name=name: order.append(name), priority)
    r.exists({})
    found["order"] = ",".join(order)
    emit_events(r.hooks, "nation", lambda e: sent.append(e["type"]))
    r.create({"n_nationkey": 99, "n_name": "new", "n_regionkey": 1})
    r.update(99, {"n_name": "newer"})
    r.delete(99)
    found["events"] = ",".join(sent)
    emit_events(r.hooks, "x", lambda e: 1 / 0, failed.append)
    r.update(1, {"n_name": "other"})
    found["failing listener"] = len(failed)
    seen: list[str] = []
    r.hooks.on("error:create", lambda c: seen.append(type(c["error"]).__name__))
    assert refused(lambda: r.create({"n_nationkey": 1}))
    found["error hook"] = ",".join(seen)
    own = Hooks()
    own.on("before:count", lambda c: c.update(cached=42))
    found["answered by a hook"] = own.run("count", {}, lambda c: 0)
    found["plugin order"] = "refused" if refused(lambda: check_plugin_order(["cache", "tenant"])) and not refused(lambda: check_plugin_order(["tenant", "cache"])) else "taken"
    found["sealed"] = "refused" if refused(lambda: r.sealed().create) and refused(lambda: r.sealed().purge) else "taken"
    found["sealed read"] = r.sealed().count()
    found["query operations"] = ",".join(sorted(k for k, (key, _, by_id) in OPERATIONS.items() if key == "query" and by_id and not k.startswith("claim")))
    return listed(spark, found)


@query("select 'required' as what, 'refused' as value union all select 'tenant 3', count(*)::varchar from customer where c_nationkey = 3 union all select 'skipped', count(*)::varchar from customer union all select 'custom', count(*)::varchar from customer where c_nationkey in (1, 2) union all select 'stamped', '3' union all select 'foreign row', null union all select 'by tenant', count(*)::varchar from customer where c_nationkey = 4 and c_acctbal > 0")
def tenancy(spark, d):
    r = accounts(spark, d, tenancy=control.Tenancy(field="c_nationkey"))
    found = {"required": "refused" if refused(r.count) else "taken", "tenant 3": r.count(tenant=3), "skipped": r.count(skip_tenant=True)}
    found["by tenant"] = r.aggregate(Aggregate(_GOOD, filter=f.gt("c_acctbal", 0)), tenant=4)[0]["n"]
    found["stamped"] = r.create({"c_custkey": -1, "c_nationkey": 9}, tenant=3)["c_nationkey"]
    found["foreign row"] = r.update(-1, {"c_name": "x"}, tenant=4)
    custom = Repository("customer", read_table(spark, d, "customer"), "c_custkey", tenancy=control.Tenancy("custom", resolve=lambda c: f.in_("c_nationkey", c["nations"])))
    found["custom"] = custom.count(nations=[1, 2])
    return listed(spark, found)


_RETRIES = {"third try": "ok", "tries": "3", "not transient": "1", "given up": "2", "aborted": "true", "stopped read": "true"}


@query(values(_RETRIES))
def retries_and_aborts(spark, d):
    tries: list[int] = []

    def flaky(n: int, error: Exception):
        def call() -> str:
            tries.append(1)
            if len(tries) < n:
                raise error
            return "ok"

        tries.clear()
        return call

    calm = {"sleep": lambda s: None}
    found = {"third try": control.retry(flaky(3, errors.Conflict("x")), **calm), "tries": len(tries)}
    assert refused(lambda: control.retry(flaky(3, errors.Invalid("x")), **calm))
    found["not transient"] = len(tries)
    assert refused(lambda: control.retry(flaky(9, errors.Conflict("x")), control.RetryPolicy(attempts=2), **calm))
    found["given up"] = len(tries)
    stop = threading.Event()
    stop.set()

    def aborted(call) -> str:
        try:
            call()
        except control.Aborted:
            return "true"
        return "false"

    found["aborted"] = aborted(lambda: control.retry(lambda: 1, aborted=stop))
    found["stopped read"] = aborted(lambda: _orders(spark, d).count(signal=stop))
    return listed(spark, found)


_ERRORS = {"NotFound": "not_found 404", "Invalid": "validation_error 422", "Conflict": "conflict 409", "DuplicateKey": "conflict 409", "VersionConflict": "conflict 409", "IllegalTransition": "conflict 409", "ReadOnly": "forbidden 403", "PreconditionFailed": "precondition_failed 412", "TimedOut": "timeout 504", "Unsupported": "validation_error 400", "RepositoryError": "internal_error 500", "KeyError": "internal_error 500", "ValueError": "validation_error 400", "unavailable": "service_unavailable 503"}


@query(values(_ERRORS))
def error_contract(spark, d):
    def wire(e: BaseException) -> str:
        c = errors.to_wire(e)
        return f"{c['code']} {c['status']}"

    found = {k: wire(getattr(errors, k)("x")) for k in _ERRORS if hasattr(errors, k)}
    found |= {"KeyError": wire(KeyError("x")), "ValueError": wire(ValueError("x")), "unavailable": wire(errors.RepositoryError("x", status=503))}
    return listed(spark, found)


_CAPABILITIES = {"percentile": "true", "top_n": "true", "transactions": "true", "archive": "true", "timezone_buckets": "true", "nested_lookups": "false", "update_pipelines": "false", "concurrent_writers": "false", "unheard_of": "false"}


@query(values(_CAPABILITIES, "boolean"))
def capabilities(spark, d):
    own = _orders(spark, d).capabilities
    return listed(spark, {k: own.supports(k) for k in _CAPABILITIES}, "boolean")
