import math
import re
from datetime import datetime

import pytest

from loomsheet.functions.predicates import apply_filter, compile_filter, fit_literals, like_pattern
from loomsheet.plans import filters as f
from loomsheet.plans.records import InvalidFilter, coerce_dates, merge_scope, parse_iso, policy_to_filter, record_to_filter, tenant_scope
from loomsheet.plans.url import parse_url


@pytest.fixture(scope="module")
def notes(spark):
    rows = [("plain", "a", 1, "hello world"), ("pct", "a", 5, "50% off"), ("under", "b", 3, "file_name.txt"), ("back", "b", 1, "back\\slash"), ("none", None, 2, None)]
    return spark.createDataFrame(rows, "name string, category string, count long, notes string")


def names(df, node, mode="query"):
    return sorted(r["name"] for r in apply_filter(df, node, mode).collect())


def test_parity_cases(notes):
    assert names(notes, f.in_("category", [])) == []
    assert names(notes, f.nin("category", [])) == ["back", "none", "pct", "plain", "under"]
    assert names(notes, f.ne("category", "a")) == ["back", "under"]
    assert names(notes, f.ne("category", "a"), "document") == ["back", "none", "under"]
    assert names(notes, f.like("notes", r"50\% off")) == ["pct"]
    assert names(notes, f.like("notes", r"file\_name.txt")) == ["under"]
    assert names(notes, f.contains("notes", "50% OFF")) == ["pct"]
    assert names(notes, f.contains("notes", "k\\s")) == ["back"]
    assert names(notes, f.i_eq("notes", "HELLO WORLD")) == ["plain"]
    assert names(notes, f.starts_with("notes", "file_n")) == ["under"]
    assert names(notes, f.or_(f.and_(f.eq("category", "a"), f.gt("count", 1)), f.eq("name", "back"))) == ["back", "pct"]
    assert names(notes, f.in_("category", ["a", None])) == ["none", "pct", "plain"]
    assert names(notes, f.nin("category", ["a", None]), "document") == ["back", "under"]
    assert names(notes, f.not_(f.eq("category", "a"))) == ["back", "under"]
    assert names(notes, f.not_(f.eq("category", "a")), "document") == ["back", "none", "under"]
    assert names(notes, f.regex("notes", "^HELLO", "i")) == ["plain"]
    assert names(notes, f.raw("count = ? and name <> ?", [1, "it's"])) == ["back", "plain"]
    assert names(notes, f.eq("missing", 1)) == [] and names(notes, f.is_null("missing")) == ["back", "none", "pct", "plain", "under"]


def test_types_are_bracketed(notes):
    assert names(notes, f.eq("count", "1")) == [] and names(notes, f.gt("name", 5)) == []
    assert names(notes, f.ne("count", "1"), "document") == ["back", "none", "pct", "plain", "under"]
    assert names(notes, fit_literals(f.eq("count", "5"), notes.schema)) == ["pct"]


def test_nan_infinity_and_dates(spark):
    df = spark.createDataFrame([("nan", math.nan, datetime(2026, 1, 1)), ("inf", math.inf, datetime(2026, 1, 2)), ("one", 1.0, None)], "name string, n double, at timestamp_ntz")
    assert names(df, f.gt("n", 0)) == ["inf", "one"] and names(df, f.gte("n", math.nan)) == []
    assert names(df, f.eq("n", math.nan)) == ["nan"] and names(df, f.eq("n", math.inf)) == ["inf"]
    assert names(df, f.gte("at", "2026-01-02")) == ["inf"] and names(df, f.eq("at", "2026-01-01")) == ["nan"]
    assert names(df, f.gt("at", "not a date")) == []


def test_paths_through_structs_arrays_and_positions(spark):
    df = spark.createDataFrame(
        [("x", [("s1",), ("s2",)], ["red"], [1.0, None], ({"c": 7},)), ("y", [], None, [], ({"c": None},)), ("z", [(None,)], ["blue", "red"], [9.0], (None,))],
        "name string, items array<struct<sku:string>>, tags array<string>, scores array<double>, a struct<b:struct<c:long>>",
    )
    d = "document"
    assert names(df, f.eq("items.sku", "s2"), d) == ["x"] and names(df, f.eq("items.0.sku", "s1"), d) == ["x"]
    assert names(df, f.eq("tags", "red"), d) == ["x", "z"] and names(df, f.eq("tags.1", "red"), d) == ["z"]
    assert names(df, f.gt("scores", 5), d) == ["z"] and names(df, f.eq("a.b.c", 7), d) == ["x"]
    assert names(df, f.ne("items.sku", "s1"), d) == ["y", "z"]
    assert names(df, f.eq("items.__proto__", "s1"), d) == [] and names(df, f.exists("items.sku"), d) == ["x"]
    nested = spark.createDataFrame([("g", [([(1,), (2,)],)])], "name string, groups array<struct<members:array<struct<id:long>>>>")
    assert names(nested, f.eq("groups.members.id", 2), d) == ["g"]


def test_long_strings_never_match_a_regex(spark):
    df = spark.createDataFrame([("long", "a" * 70_000), ("short", "a")], "name string, t string")
    assert names(df, f.regex("t", "a")) == ["short"]


def test_large_membership_is_a_semi_join(spark):
    df = spark.range(50_000).withColumnRenamed("id", "k")
    out = apply_filter(df, f.in_("k", range(0, 40_000, 2)))
    assert out.count() == 20_000 and "LeftSemi" in out._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    df = apply_filter(spark.read.parquet(f"{sf}/orders.parquet"), f.and_(f.gte("o_orderdate", "1996-01-01"), f.eq("o_orderstatus", "O"))).select("o_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "EqualTo(o_orderstatus,O)" in plan and "o_totalprice" not in plan


def test_algebra():
    a, b = f.eq("a", 1), f.eq("b", 2)
    assert f.and_() == f.TRUE and f.or_() == f.FALSE and f.and_(a) is a
    assert f.and_(a, f.and_(b, f.TRUE)).parts == (a, b) and f.and_(a, f.FALSE) == f.FALSE and f.or_(a, f.TRUE) == f.TRUE
    assert f.not_(f.not_(a)) is a and f.not_(f.TRUE) == f.FALSE and (a & b).op == "and" and (~a).op == "not"
    tree = f.or_(f.and_(a, b), f.not_(f.gt("c", 3)))
    seen = []
    f.walk(tree, lambda n: (seen.append(n.op), n.op != "not")[1])
    assert seen == ["or", "and", "eq", "eq", "not"]
    assert f.fields_of(tree) == ["a", "b", "c"] and f.rewrite(tree, lambda n: n) is tree
    assert f.fields_of(f.rename(tree, {"c": "d"})) == ["a", "b", "d"]
    assert f.is_filter(a) and not f.is_filter({"op": "eq"})
    assert like_pattern(r"a\b\%\\") == r"a\\b\%\\"


def test_records():
    assert record_to_filter({"a": None, "b": [1, 2], "c": {"gt": 1, "lte": 5}}) == f.and_(f.is_null("a"), f.in_("b", [1, 2]), f.gt("c", 1), f.lte("c", 5))
    assert record_to_filter({"a": {"gt": 1, "x": 2}}) == f.eq("a", {"gt": 1, "x": 2}) and record_to_filter(None) == f.TRUE
    node = policy_to_filter({"$or": [{"a": 1}, {"b": {"$in": [1, None, re.compile("^x", re.I)]}}], "c": {"$regex": "y", "$options": "i"}, "$nor": [{"d": {"$exists": True}}]})
    assert node.op == "and" and f.fields_of(node) == ["a", "b", "c", "d"]
    for bad in ({"$where": 1}, {"a": {"$near": 1}}, {"$or": 1}, {"a": {"$in": 3}}, [1]):
        with pytest.raises(InvalidFilter):
            policy_to_filter(bad)
    assert tenant_scope({"org": 5, "x": 1}, "org", 7) == f.and_(f.eq("org", 7), f.eq("x", 1))
    assert merge_scope(f.eq("x", 1), {"y": {"gt": 2}}) == f.and_(f.eq("x", 1), f.gt("y", 2))


def test_dates():
    for good in ("2026-01-02", "2026-01-02T03:04", "2026-01-02T03:04:05", "2026-01-02T03:04:05.123Z", "2026-01-02T03:04:05+02:00", "2026-01-02T03:04:05.123456", "2026-01-02T03:04Z"):
        assert parse_iso(good) is not None
    for bad in ("2026", "2026-1-2", "20260102", "2026-13-01", "x2026-01-02"):
        assert parse_iso(bad) is None
    out = coerce_dates({"at": {"$gte": "2026-01-02", "$eq": "2026-01-02"}, "$or": [{"at": {"$lt": "2026-02-01"}}], "n": {"$gt": "2026-01-02"}}, lambda n: n == "at" or None if n != "n" else False)
    assert out["at"] == {"$gte": datetime(2026, 1, 2), "$eq": "2026-01-02"} and out["$or"][0]["at"]["$lt"] == datetime(2026, 2, 1) and out["n"]["$gt"] == "2026-01-02"


def test_url():
    p = parse_url("status=open&age[gte]=18&age[lt]=65&sort=-createdAt,name&page=2&limit=500&select=a,-b&search=x&_id=5&junk[zz]=1")
    assert p.filter == f.and_(f.eq("status", "open"), f.gte("age", "18"), f.lt("age", "65"), f.eq("_id", "5"))
    assert p.sort == {"createdAt": -1, "name": 1} and p.page == 2 and p.limit == 200 and p.select == {"a": 1, "b": 0} and p.search == "x"
    assert parse_url("a[between]=1,2,3").filter == f.between("a", "1", "2") and parse_url("a[between]=1").filter == f.TRUE
    assert parse_url("a[exists]=1&b[exists]=no").filter == f.and_(f.exists("a"), f.exists("b", False))
    assert parse_url("a=null&b=true&c=1.5&d=7").filter == f.and_(f.is_null("a"), f.eq("b", True), f.eq("c", 1.5), f.eq("d", "7"))
    assert parse_url("d=7", types={"d": "number"}).filter == f.eq("d", 7)
    assert parse_url({"a": ["1", "2"]}).filter == f.and_(f.eq("a", "1"), f.eq("a", "2"))
    assert parse_url("a=1&b=2", fields=["b"]).filter == f.eq("b", "2") and parse_url("a[regex]=" + "x" * 501).filter == f.TRUE
    assert parse_url("a[gt]=1", operators=["eq"]).filter == f.TRUE and parse_url("page=0&limit=-1").page is None
    r = parse_url("populate=dept&populate[owner][select]=name,age&populate[owner][match][active]=true").populate
    assert [x.path for x in r] == ["dept", "owner"] and r[1].select == ["name", "age"] and r[1].match == {"active": "true"}
    assert len(parse_url("search=" + "x" * 300).search) == 200


def test_not_of_any_value():
    for leaf in (f.eq("a", [1]), f.eq("a", {"b": 1}), f.in_("a", [[1], {}])):
        assert f.not_(leaf).op == "not" and f.not_(f.not_(leaf)) == leaf
    assert f.not_(f.TRUE) == f.FALSE and f.not_(f.FALSE) == f.TRUE
