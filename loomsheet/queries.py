"""One query per operator of the request engine, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.predicates import apply_filter, compile_filter, fit_literals
from .operators import changes, paging, writes
from .operators.aggregate import aggregate, grouped
from .operators.lookup import embed, embed_page
from .operators.ordering import project, sorted_by
from .plans import filters as f
from .plans.records import coerce_dates, merge_scope, policy_to_filter, record_to_filter, tenant_scope
from .plans.requests import Aggregate, Bucket, Lookup, Measure, TopN, Update, combine_updates, inc_fields, set_fields, unset_fields
from .plans.url import parse_url
from .sources.tables import read_table, scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(call: Query) -> Query:
        QUERIES[call.__name__] = call
        if sql:
            SQL[call.__name__] = sql
        return call

    return add


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


# ---- filters ---------------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' and o_totalprice >= 1000 and o_totalprice < 200000 and o_custkey > 10 and o_orderkey <= 100000 and o_totalprice between 1500 and 150000")
def filter_eq_and_range(spark, d):
    node = f.and_(f.eq("o_orderstatus", "O"), f.gte("o_totalprice", 1000), f.lt("o_totalprice", 200000), f.gt("o_custkey", 10), f.lte("o_orderkey", 100000), f.between("o_totalprice", 1500, 150000))
    return apply_filter(read_table(spark, d, "orders"), node).select("o_orderkey", "o_totalprice")


@query("select o_orderkey from orders where o_orderstatus in ('F', 'P') and o_orderpriority not in ('1-URGENT', '5-LOW')")
def filter_in_nin(spark, d):
    node = f.and_(f.in_("o_orderstatus", ["F", "P"]), f.nin("o_orderpriority", ["1-URGENT", "5-LOW"]), f.nin("o_orderstatus", []), f.not_(f.in_("o_orderstatus", [])))
    return apply_filter(read_table(spark, d, "orders"), node).select("o_orderkey")


@query("select o_orderkey from orders where o_custkey % 3 = 0")
def filter_in_many(spark, d):
    """Membership of more values than an expression should hold: a semi join."""
    orders = read_table(spark, d, "orders")
    low, high = orders.agg(F.min("o_custkey"), F.max("o_custkey")).first()
    # all multiples of 3 that the table may hold, and never so few that the list is an expression
    members = range(min(0, low or 0) // 3 * 3, max(60_000, (high or 0) + 1), 3)
    return apply_filter(orders, f.in_("o_custkey", members)).select("o_orderkey")


@query("select p_partkey from part where p_name ilike '%a%' and p_brand ilike 'brand#1_' and p_type not ilike '%copper' and p_type ilike '%' and lower(p_brand) <> 'brand#11'")
def filter_like_contains(spark, d):
    node = f.and_(f.contains("p_name", "A"), f.like("p_brand", "brand#1_"), f.not_(f.ends_with("p_type", "COPPER")), f.starts_with("p_type", ""), f.not_(f.i_eq("p_brand", "BRAND#11")))
    return apply_filter(read_table(spark, d, "part"), node).select("p_partkey")


@query("select p_partkey from part where regexp_matches(p_brand, '#[1-3][24]') and regexp_matches(lower(p_type), '^(small|large|standard|economy|promo|medium)')")
def filter_regex(spark, d):
    return apply_filter(read_table(spark, d, "part"), f.and_(f.regex("p_brand", "#[1-3][24]"), f.regex("p_type", "^(SMALL|large|Standard|ECONOMY|promo|medium)", "i"))).select("p_partkey")


def _with_nulls(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"))


NULLS = "(select o_orderkey, o_totalprice, nullif(o_orderstatus, 'P') status from orders)"


@query(f"select o_orderkey from {NULLS} where status <> 'F' and status not in ('X') and not (status = 'F')")
def filter_null_query_mode(spark, d):
    return apply_filter(_with_nulls(spark, d), f.and_(f.ne("status", "F"), f.nin("status", ["X"]), f.not_(f.eq("status", "F")))).select("o_orderkey")


@query(f"select o_orderkey from {NULLS} where status is distinct from 'F'")
def filter_null_document_mode(spark, d):
    return apply_filter(_with_nulls(spark, d), f.and_(f.ne("status", "F"), f.nin("status", ["X"]), f.not_(f.eq("status", "F"))), "document").select("o_orderkey")


@query(f"select o_orderkey, status is null as missing from {NULLS} where status is null or (status in ('F') and o_totalprice > 100000)")
def filter_exists_null_members(spark, d):
    df = _with_nulls(spark, d)
    node = f.or_(f.is_null("status"), f.and_(f.in_("status", ["F", None]), f.is_not_null("status"), f.gt("o_totalprice", 100000)))
    return apply_filter(df, node).select("o_orderkey", compile_filter(f.is_null("status"), df.schema).alias("missing"))


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where not (l_quantity < 10 or l_returnflag = 'N') and (l_linestatus = 'F' or (l_discount >= 0.05 and not l_tax > 0.04))")
def filter_or_not_nested(spark, d):
    node = f.and_(f.not_(f.or_(f.lt("l_quantity", 10), f.eq("l_returnflag", "N"))), f.or_(f.eq("l_linestatus", "F"), f.and_(f.gte("l_discount", 0.05), f.not_(f.gt("l_tax", 0.04)))), f.TRUE)
    return apply_filter(read_table(spark, d, "lineitem"), node).select("l_orderkey", "l_linenumber", "l_quantity")


@query("select o_orderkey from orders where o_totalprice % 2 < 1 and o_orderstatus = 'O'")
def filter_raw(spark, d):
    return apply_filter(read_table(spark, d, "orders"), f.raw("o_totalprice % ? < ? and o_orderstatus = ?", [2, 1, "O"])).select("o_orderkey")


@query("select distinct o_orderkey from orders join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R' and o_orderkey in (select l_orderkey from lineitem where l_quantity > 45)")
def filter_array_fanout(spark, d):
    """A path through an array holds if any element matches."""
    items = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_returnflag", "l_quantity")).alias("items"))
    orders = read_table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return apply_filter(orders, f.and_(f.eq("items.l_returnflag", "R"), f.gt("items.l_quantity", 45)), "document").select("o_orderkey")


@query("select event_id from events where (event_type = 'click' or value > 50) and not (user_id < 3) and (event_type in ('click', 'view') or event_type is null or regexp_matches(event_type, '^p')) and value >= 5")
def record_policy_filter(spark, d):
    import re

    policy = {
        "$or": [{"event_type": "click"}, {"value": {"$gt": 50}}],
        "$nor": [{"user_id": {"$lt": 3}}],
        "event_type": {"$in": ["click", "view", None, re.compile("^p")]},
        "value": {"$not": {"$lt": 5}},
    }
    return apply_filter(read_table(spark, d, "events"), policy_to_filter(policy), "document").select("event_id")


@query("select o_orderkey from orders where o_orderstatus in ('O', 'F') and o_totalprice >= 5000 and o_orderpriority ilike '%high%' and o_orderdate >= timestamp '1995-01-01'")
def record_filter(spark, d):
    record = {"o_orderstatus": ["O", "F"], "o_totalprice": {"gte": 5000}, "o_orderpriority": {"contains": "high"}, "o_orderdate": {"gte": "1995-01-01"}}
    return apply_filter(read_table(spark, d, "orders"), record_to_filter(coerce_dates(record))).select("o_orderkey")


@query("select c_custkey from customer where c_nationkey = 3 and c_acctbal > 0 and c_mktsegment <> 'BUILDING'")
def tenant_scoped(spark, d):
    node = merge_scope(tenant_scope({"c_acctbal": {"gt": 0}, "c_nationkey": 99}, "c_nationkey", 3), {"c_mktsegment": {"ne": "BUILDING"}})
    return apply_filter(read_table(spark, d, "customer"), node).select("c_custkey")


@query("select o_orderkey, o_totalprice from orders where o_orderstatus <> 'P' and o_totalprice between 1000 and 90000.5 and o_custkey >= 50 and o_orderpriority ilike '%u%' order by o_totalprice desc, o_orderkey desc limit 50 offset 0")
def url_query(spark, d):
    p = parse_url("o_orderstatus[ne]=P&o_totalprice[between]=1000,90000.5&o_custkey[gte]=50&o_orderpriority[contains]=U&sort=-o_totalprice,-o_orderkey&page=1&limit=50&select=o_orderkey,o_totalprice")
    orders = read_table(spark, d, "orders")
    hits = apply_filter(orders, fit_literals(p.filter, orders.schema))
    return project(paging.offset_plan(hits, p.sort, p.page, p.limit), p.select)


# ---- aggregates ------------------------------------------------------------


@query("select count(*) n, count(l_tax) n_tax, count(distinct l_suppkey) suppliers, round(sum(l_quantity), 4) qty, round(avg(l_extendedprice), 4) avg_price, min(l_quantity) low, max(l_quantity) high from lineitem")
def agg_scalar(spark, d):
    m = {"n": Measure("count"), "n_tax": Measure("count", "l_tax"), "suppliers": Measure("countDistinct", "l_suppkey"), "qty": Measure("sum", "l_quantity"), "avg_price": Measure("avg", "l_extendedprice"), "low": Measure("min", "l_quantity"), "high": Measure("max", "l_quantity")}
    return rounded(aggregate(read_table(spark, d, "lineitem"), Aggregate(m)), "qty", "avg_price")


@query("select l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 4) qty, round(sum(l_extendedprice), 2) price, round(avg(l_discount), 6) disc from lineitem where l_shipdate <= timestamp '1998-09-02' group by all")
def agg_group(spark, d):
    m = {"n": Measure("count"), "qty": Measure("sum", "l_quantity"), "price": Measure("sum", "l_extendedprice"), "disc": Measure("avg", "l_discount")}
    out = aggregate(read_table(spark, d, "lineitem"), Aggregate(m, ["l_returnflag", "l_linestatus"], filter=f.lte("l_shipdate", datetime(1998, 9, 2)), sort={"l_returnflag": 1, "l_linestatus": 1}))
    return rounded(rounded(rounded(out, "qty"), "price", digits=2), "disc", digits=6)


@query("select o_orderstatus, count(*) n, count(*) filter (o_totalprice > 100000) n_big, round(sum(o_totalprice) filter (o_orderpriority = '1-URGENT'), 2) urgent, round(avg(o_totalprice) filter (o_custkey < 100), 2) early, count(*) filter (o_totalprice < 0) n_none from orders group by 1")
def agg_filtered_measures(spark, d):
    m = {
        "n": Measure("count"),
        "n_big": Measure("count", where=f.gt("o_totalprice", 100000)),
        "urgent": Measure("sum", "o_totalprice", where={"o_orderpriority": "1-URGENT"}),
        "early": Measure("avg", "o_totalprice", where=f.lt("o_custkey", 100)),
        "n_none": Measure("count", where=f.lt("o_totalprice", 0)),
    }
    return rounded(aggregate(read_table(spark, d, "orders"), Aggregate(m, "o_orderstatus")), "urgent", "early", digits=2)


@query("select l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) p50, round(quantile_cont(l_extendedprice, 0.95), 4) p95, round(quantile_cont(l_extendedprice, 0.99), 4) p99 from lineitem group by 1")
def agg_percentile(spark, d):
    m = {f"p{p}": Measure("percentile", "l_extendedprice", p=p / 100) for p in (50, 95, 99)}
    return rounded(aggregate(read_table(spark, d, "lineitem"), Aggregate(m, "l_returnflag")), *m)


@query("select l_linestatus, round(stddev_samp(l_quantity), 6) s, round(stddev_pop(l_quantity), 6) p from lineitem group by 1")
def agg_stddev(spark, d):
    return rounded(aggregate(read_table(spark, d, "lineitem"), Aggregate({"s": Measure("stddev", "l_quantity"), "p": Measure("stddevPop", "l_quantity")}, "l_linestatus")), "s", "p", digits=6)


@query("select o_custkey, count(*) n, round(sum(o_totalprice), 2) total from orders group by 1 having count(*) >= 3 and o_custkey > 5 order by n desc, o_custkey limit 25 offset 5")
def agg_having_sort_limit(spark, d):
    r = Aggregate({"n": Measure("count"), "total": Measure("sum", "o_totalprice")}, "o_custkey", having=f.and_(f.gte("n", 3), f.gt("o_custkey", 5)), sort={"n": -1, "o_custkey": 1}, limit=25, offset=5)
    return rounded(aggregate(read_table(spark, d, "orders"), r), "total", digits=2)


def _top(ties: str) -> Query:
    def run(spark, d):
        customers = read_table(spark, d, "customer")
        r = Aggregate({"n": Measure("count")}, ["customer.c_mktsegment", "o_custkey"], lookups=[Lookup("customer", "o_custkey", "c_custkey", single=True, select=["c_mktsegment"])], top=TopN("customer.c_mktsegment", {"n": -1}, 3, ties))
        out = aggregate(read_table(spark, d, "orders"), r, {"customer": customers}.get)
        return out.withColumnRenamed("customer.c_mktsegment", "segment")

    run.__name__ = {"rank": "agg_topn_rank", "dense_rank": "agg_topn_dense", "row_number": "agg_topn_rownum"}[ties]
    extra = ", o_custkey asc" if ties == "row_number" else ""
    return query(f"select segment, o_custkey, n from (select *, {ties}() over (partition by segment order by n desc nulls last{extra}) r from (select c_mktsegment segment, o_custkey, count(*) n from orders left join customer on c_custkey = o_custkey group by 1, 2)) where r <= 3")(run)


for _ties in ("rank", "dense_rank", "row_number"):
    _top(_ties)


@query("select n_name nation, count(*) n, round(sum(l_quantity), 2) qty from lineitem left join orders on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey where l_quantity > 10 group by 1 having count(*) > 0")
def agg_lookup(spark, d):
    """Chained flat lookups before the groups; output keys are nested, then flattened here."""
    tables = {n: read_table(spark, d, n) for n in ("orders", "customer", "nation")}
    r = Aggregate(
        {"n": Measure("count"), "qty": Measure("sum", "l_quantity")},
        "nation.n_name",
        filter=f.gt("l_quantity", 10),
        lookups=[Lookup("orders", "l_orderkey", "o_orderkey", select=["o_custkey"]), Lookup("customer", "orders.o_custkey", "c_custkey", select=["c_nationkey"]), Lookup("nation", "customer.c_nationkey", "n_nationkey", select=["n_name"])],
        having=f.gt("n", 0),
    )
    out = aggregate(read_table(spark, d, "lineitem"), r, tables.get, nested=True)
    return out.select(F.col("nation.n_name").alias("nation"), "n", F.round("qty", 2).alias("qty"))


# ---- date buckets ----------------------------------------------------------


def _bucket(name: str, table: str, field: str, b: Bucket, label: str) -> None:
    def run(spark, d):
        return aggregate(read_table(spark, d, table), Aggregate({"n": Measure("count")}, buckets={"bucket": b}))

    run.__name__ = name
    query(f"select {label} as bucket, count(*) n from {table} group by 1")(run)


_FORMATS = {"minute": "strftime({}, '%Y-%m-%dT%H:%M')", "hour": "strftime({}, '%Y-%m-%dT%H:00')", "day": "strftime({}, '%Y-%m-%d')", "week": "strftime({}, '%G-W%V')", "month": "strftime({}, '%Y-%m')", "quarter": "concat(year({0}), '-Q', quarter({0}))", "year": "strftime({}, '%Y')"}
for _unit, _label in _FORMATS.items():
    _table, _field = ("events", "ts") if _unit in ("minute", "hour", "day") else ("orders", "o_orderdate")
    _bucket(f"bucket_{_unit}", _table, _field, Bucket(_field, _unit), _label.format(_field))
for _name, _every, _unit, _width, _origin in (("15m", 15, "minute", "15 minutes", "1970-01-01"), ("6h", 6, "hour", "6 hours", "1970-01-01"), ("7d", 7, "day", "7 days", "1970-01-01"), ("2w", 2, "week", "14 days", "1970-01-05"), ("3mo", 3, "month", "3 months", "1970-01-01")):
    _table, _field = ("orders", "o_orderdate") if _unit in ("week", "month") else ("events", "ts")
    _bucket(f"bucket_{_name}", _table, _field, Bucket(_field, _unit, _every), _FORMATS[_unit].format(f"time_bucket(interval '{_width}', {_field}, timestamp '{_origin}')"))
_bucket("bucket_tz", "events", "ts", Bucket("ts", "hour", timezone="America/New_York"), _FORMATS["hour"].format("(ts at time zone 'UTC' at time zone 'America/New_York')"))


@query("select strftime(o_orderdate, '%Y-%m') as month, o_orderstatus, count(*) n, round(sum(o_totalprice), 2) total from orders group by 1, 2")
def bucket_and_group(spark, d):
    r = Aggregate({"n": Measure("count"), "total": Measure("sum", "o_totalprice")}, "o_orderstatus", {"month": Bucket("o_orderdate", "month")})
    return rounded(aggregate(read_table(spark, d, "orders"), r), "total", digits=2)


@query("select strftime(o_orderdate, '%Y-%m-%d') as bucket, count(*) n from orders group by 1")
def bucket_inputs(spark, d):
    """ISO text and epoch milliseconds give the labels that timestamps give."""
    orders = read_table(spark, d, "orders")
    text = orders.select(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    return aggregate(text, Aggregate({"n": Measure("count")}, buckets={"bucket": Bucket("at", "day")}))


# ---- lookups ---------------------------------------------------------------


@query("select o_orderkey, c_name as customer_name, c_custkey is null as missing from orders left join (select * from customer where c_mktsegment = 'BUILDING') on c_custkey = o_custkey")
def lookup_single(spark, d):
    out = embed(read_table(spark, d, "orders"), Lookup("customer", "o_custkey", "c_custkey", single=True, select=["c_custkey", "c_name"], where=f.eq("c_mktsegment", "BUILDING")), lambda n: read_table(spark, d, n))
    return out.select("o_orderkey", F.col("customer.c_name").alias("customer_name"), F.col("customer").isNull().alias("missing"))


@query("select o_orderkey, count(l_orderkey) n_items, coalesce(round(sum(l_quantity), 2), 0) qty from orders left join (select * from lineitem where l_returnflag = 'R') on l_orderkey = o_orderkey group by 1")
def lookup_many(spark, d):
    out = embed(read_table(spark, d, "orders"), Lookup("lineitem", "o_orderkey", "l_orderkey", as_="items", select={"l_linenumber": 1, "l_quantity": 1}, where={"l_returnflag": "R"}), lambda n: read_table(spark, d, n))
    qty = F.aggregate("items", F.lit(0.0), lambda a, x: a + x["l_quantity"])
    return out.select("o_orderkey", F.size("items").cast("long").alias("n_items"), F.round(qty, 2).alias("qty"))


@query("select o_orderkey, c_name, n_name, n_items from (select * from orders order by o_totalprice desc, o_orderkey limit 30 offset 30) left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey left join (select l_orderkey, count(*) n_items from lineitem group by 1) on l_orderkey = o_orderkey".replace("n_items from (select *", "coalesce(n_items, 0) n_items from (select *"))
def lookup_populate_page(spark, d):
    """The base is paged before it is joined; lookups run in order, by the page's keys, and may use each other."""
    page = paging.offset_plan(read_table(spark, d, "orders"), {"o_totalprice": -1, "o_orderkey": 1}, 2, 30)
    lookups = [Lookup("customer", "o_custkey", "c_custkey", single=True), Lookup("nation", "customer.c_nationkey", "n_nationkey", single=True), Lookup("lineitem", "o_orderkey", "l_orderkey")]
    rows, schema = embed_page(page.collect(), page.schema, lookups, lambda n: read_table(spark, d, n))  # one page
    return spark.createDataFrame(rows, schema).select("o_orderkey", "customer.c_name", "nation.n_name", F.size("lineitem").cast("long").alias("n_items"))


# ---- pages and reads -------------------------------------------------------


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' order by o_totalprice desc, o_orderkey desc limit 40 offset 80")
def page_offset(spark, d):
    df = apply_filter(read_table(spark, d, "orders"), f.eq("o_orderstatus", "F"))
    return paging.offset_plan(df, {"o_totalprice": -1, "o_orderkey": -1}, 3, 40).select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_orderdate from orders where o_orderstatus = 'O' order by o_orderdate desc, o_orderkey desc limit 60")
def page_keyset_walk(spark, d):
    """Three pages of twenty, each from the cursor of the one before."""
    df = apply_filter(read_table(spark, d, "orders"), f.eq("o_orderstatus", "O")).select("o_orderkey", "o_orderdate")
    rows, token = [], None
    for _ in range(3):
        page = paging.keyset_page(df, {"o_orderdate": -1}, "o_orderkey", token, 20)
        rows, token = rows + page.data, page.next
    return spark.createDataFrame(rows, df.schema)


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 100000 or (o_totalprice = 100000 and o_orderkey > 7) order by o_totalprice, o_orderkey limit 101")
def page_keyset_plan(spark, d):
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    sort = {"o_totalprice": 1, "o_orderkey": 1}
    token = paging.encode_cursor({"o_orderkey": 7, "o_totalprice": 100000.0}, sort, "o_orderkey")
    return paging.keyset_plan(orders, sort, "o_orderkey", token, 100)[0]


@query("select o_custkey, count(*) n from orders group by 1 order by n desc, o_custkey limit 60")
def agg_keyset_walk(spark, d):
    """Many groups tie on the sort key; none is lost or repeated."""
    r = Aggregate({"n": Measure("count")}, "o_custkey", sort={"n": -1})
    groups = grouped(read_table(spark, d, "orders"), r)
    rows, token = [], None
    for _ in range(3):
        page = paging.group_keyset_page(groups, r.sort, r.keys, token, 20)
        rows, token = rows + page.data, page.next
    return spark.createDataFrame(rows, groups.schema)


@query("select 'segments' as what, count(distinct c_mktsegment) n from customer union all select 'rich', count(*) from customer where c_acctbal > 5000 union all select 'exists', max((c_custkey = 1)::int) from customer")
def distinct_count_exists(spark, d):
    c = read_table(spark, d, "customer")
    rows = [("segments", c.select("c_mktsegment").distinct().count()), ("rich", apply_filter(c, f.gt("c_acctbal", 5000)).count()), ("exists", int(not apply_filter(c, f.eq("c_custkey", 1)).isEmpty()))]
    return spark.createDataFrame(rows, "what string, n long")


@query("select o_orderkey, o_totalprice from orders where o_orderkey in (1, 5, 33, 70, 999999999)")
def get_by_ids(spark, d):
    return apply_filter(read_table(spark, d, "orders"), f.in_("o_orderkey", [1, 5, 33, 70, 5, 999999999])).select("o_orderkey", "o_totalprice")


@query("select c_custkey, c_name from customer where c_name ilike '%00012%' or c_mktsegment ilike '%00012%'")
def text_search(spark, d):
    node = f.or_(*(f.contains(n, "00012") for n in ("c_name", "c_mktsegment")))
    return project(apply_filter(read_table(spark, d, "customer"), node), {"c_custkey": 1, "c_name": 1})


# ---- writes and lifecycle --------------------------------------------------


@query("select c_custkey, case when c_acctbal < 0 then c_acctbal + 100 else c_acctbal end c_acctbal, case when c_acctbal < 0 then null else c_mktsegment end c_mktsegment, case when c_acctbal < 0 then 'checked' else c_name end c_name from customer")
def update_inc_unset(spark, d):
    change = combine_updates(set_fields(c_name="unchecked"), inc_fields(c_acctbal=100), unset_fields("c_mktsegment"), set_fields(c_name="checked"))
    return writes.updated(read_table(spark, d, "customer"), f.lt("c_acctbal", 0), change).select("c_custkey", "c_acctbal", "c_mktsegment", "c_name")


@query(f"select o_orderkey, status from {NULLS} where status is null or status <> 'F'")
def delete_many(spark, d):
    return writes.deleted(_with_nulls(spark, d), f.eq("status", "F")).select("o_orderkey", "status")


@query("select c_custkey, case when c_custkey <= 100 then 'new' else c_name end c_name, case when c_custkey <= 100 then 1.5 else c_acctbal end c_acctbal from customer union all select -1, 'new', 1.5")
def upsert(spark, d):
    base = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    source = base.filter("c_custkey <= 100").select("c_custkey").union(spark.range(-1, 0).toDF("c_custkey")).select("c_custkey", F.lit("new").alias("c_name"), F.lit(1.5).alias("c_acctbal"))
    return writes.upserted(base, source, ["c_custkey"])


@query("select o_orderkey, case when o_orderkey = (select o_orderkey from orders where o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 1) then 'X' else o_orderstatus end o_orderstatus from orders")
def find_one_and_update(spark, d):
    orders = read_table(spark, d, "orders")
    return writes.updated_one(orders, f.eq("o_orderstatus", "O"), {"o_orderdate": 1}, "o_orderkey", set_fields(o_orderstatus="X")).select("o_orderkey", "o_orderstatus")


@query("select o_orderkey, case when o_orderkey = 7 and o_orderstatus in ('O', 'F', 'P') then 'C' else o_orderstatus end o_orderstatus, case when o_orderkey = 3 and o_custkey is not null then o_totalprice + 1 else o_totalprice end o_totalprice from orders")
def claim_cas(spark, d):
    orders = read_table(spark, d, "orders")
    out = writes.claimed(orders, writes.claim_filter("o_orderkey", 7, "o_orderstatus", ["O", "F", "P"], {"o_custkey": {"gte": 0}}), "o_orderstatus", "C")
    out = writes.claimed(out, writes.claim_filter("o_orderkey", 9, "o_orderstatus", "nothing"), "o_orderstatus", "C")
    return writes.updated(out, f.and_(f.eq("o_orderkey", 3), f.is_not_null("o_custkey")), inc_fields(o_totalprice=1)).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("select o_orderkey, case when o_custkey < 50 then 'gone' else o_orderpriority end o_orderpriority, case when o_custkey < 50 then -1 else o_custkey end o_custkey, o_totalprice from orders")
def purge_anonymize(spark, d):
    return writes.purged(read_table(spark, d, "orders"), f.lt("o_custkey", 50), "anonymize", {"o_orderpriority": "gone", "o_custkey": -1}).select("o_orderkey", "o_orderpriority", "o_custkey", "o_totalprice")


@query("select o_orderkey, o_custkey < 50 as deleted from orders")
def purge_soft(spark, d):
    orders = read_table(spark, d, "orders").withColumn("deleted", F.lit(False))
    return writes.purged(orders, f.lt("o_custkey", 50), "soft").select("o_orderkey", "deleted")


@query("select 'archived' as part, count(*) n, round(sum(o_totalprice), 2) total from orders where o_orderdate < timestamp '1996-01-01' union all select 'kept', count(*), round(sum(o_totalprice), 2) from orders where not o_orderdate < timestamp '1996-01-01'")
def archive_split(spark, d):
    orders, cold = read_table(spark, d, "orders"), f.lt("o_orderdate", datetime(1996, 1, 1))
    measures = {"n": Measure("count"), "total": Measure("sum", "o_totalprice")}
    parts = [aggregate(x, Aggregate(measures)).select(F.lit(n).alias("part"), "n", F.round("total", 2).alias("total")) for n, x in (("archived", apply_filter(orders, cold)), ("kept", writes.deleted(orders, cold)))]
    return parts[0].union(parts[1])


@query("select o_custkey, o_orderpriority, count(*) n from orders group by 1, 2 having count(*) > 1")
def duplicate_keys(spark, d):
    return writes.duplicates(read_table(spark, d, "orders"), ["o_custkey", "o_orderpriority"])


@query("select o_orderkey, 'o_totalprice' as field, 'max' as rule from orders where o_totalprice > 300000 union all select o_orderkey, 'o_orderstatus', 'enum' from orders where o_orderstatus not in ('O', 'F') union all select o_orderkey, 'o_orderpriority', 'pattern' from orders where not regexp_matches(o_orderpriority, '^[1-4]')")
def field_rules(spark, d):
    rules = {"o_totalprice": {"min": 0, "max": 300000, "nullable": False}, "o_orderstatus": {"enum": ["O", "F"]}, "o_orderpriority": {"pattern": "^[1-4]"}}
    return writes.violations(read_table(spark, d, "orders"), rules, "o_orderkey")


def _log(spark, d):
    """Events as a change log: a user is a document, purchases delete."""
    e = read_table(spark, d, "events")
    return e.select(F.lit("users").alias("scope"), F.col("user_id").cast("string").alias("docId"), F.when(F.col("event_type") == "purchase", "delete").otherwise("update").alias("op"), "value", changes.cursor_of(F.col("event_id")).alias("cursor"))


LOG = "(select user_id::varchar docId, case when event_type = 'purchase' then 'delete' else 'update' end op, value, event_id from events)"


@query(f"select docId, op, value from (select *, row_number() over (partition by docId order by event_id desc) r from {LOG}) where r = 1 and op <> 'delete'")
def changelog_snapshot(spark, d):
    return changes.snapshot(_log(spark, d)).select("docId", "op", "value")


@query(f"select docId, op, value from {LOG} where event_id > 100 order by event_id limit 500")
def changelog_since(spark, d):
    return changes.since(_log(spark, d), f"{100:020d}", "users").limit(changes.PAGE).select("docId", "op", "value")


@query("select o_orderkey::varchar as mutationId, case when o_orderkey % 5 = 0 then 'already_applied' when c_custkey is null then 'rejected' when o_custkey % 2 <> 1 then 'conflict' else 'applied' end as verdict from orders left join (select * from customer where c_custkey % 3 <> 0) on c_custkey = o_custkey")
def push_verdicts(spark, d):
    orders = read_table(spark, d, "orders")
    m = orders.select(F.col("o_orderkey").cast("string").alias("mutationId"), F.col("o_custkey").alias("docId"), F.lit("update").alias("op"), (F.col("o_custkey") % 2).alias("baseVersion"))
    current = read_table(spark, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("docId"), F.lit(1).cast("long").alias("version"))
    done = orders.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").cast("string").alias("mutationId"))
    return changes.verdicts(m, current, done)


@query("select user_id::varchar as actor, strftime(ts, '%Y-%m') as period, event_type as kind, round(sum(value), 4) n from events group by 1, 2, 3")
def usage_summary(spark, d):
    e = read_table(spark, d, "events")
    deltas = e.select(F.col("user_id").cast("string").alias("actor"), changes.period_of(F.col("ts")).alias("period"), F.col("event_type").alias("kind"), F.col("value").alias("n"))
    return rounded(changes.usage_totals(deltas), "n")


@query("""select c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') as hash from customer""")
def content_hashes(spark, d):
    c = read_table(spark, d, "customer")
    return c.select("c_custkey", changes.content_hash(c, "c_name", "c_custkey").alias("hash"))


@query(f"select op as operation, docId as id, value, lpad(event_id::varchar, 20, '0') as cursor from {LOG} where op <> 'delete' and event_id > 10")
def watch_stream(spark, d):
    """The change feed over the events folder, drained once into parquet."""
    from .streaming.watch import change_stream, drain

    root = scratch(spark, "watch")
    log = _log(spark, d).select("docId", "op", F.to_json(F.struct("value")).alias("doc"), F.current_timestamp().alias("at"), "cursor")
    log.write.parquet(f"{root}/log")
    feed = change_stream(spark, f"{root}/log", log.schema, f.ne("op", "delete"), resume_after=f"{10:020d}")
    drain(feed, f"{root}/checkpoint", f"{root}/out")
    value = F.get_json_object("doc", "$.value").cast("double")
    return spark.read.parquet(f"{root}/out").select("operation", "id", value.alias("value"), "cursor")


from . import verb_queries  # noqa: E402, F401  adds the queries of the repository's verbs
