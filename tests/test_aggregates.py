from datetime import datetime

import pytest

from loomsheet.operators.aggregate import aggregate, grouped
from loomsheet.operators.lookup import embed
from loomsheet.operators import paging
from loomsheet.operators.ordering import sorted_by
from loomsheet.plans import filters as f
from loomsheet.plans.requests import Aggregate, Bucket, Lookup, Measure, TopN
from loomsheet.repository import Repository


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("a", "reader", 10, True), ("b", "reader", 20, True), ("c", "admin", 30, False), ("d", "admin", 40, False)], "name string, category string, count long, active boolean")


def out(df, request, *names):
    return sorted(tuple(r[n] for n in names) for r in aggregate(df, request).collect())


def test_groups_and_measures(people):
    total = {"total": Measure("sum", "count")}
    assert out(people, Aggregate(total, "category"), "category", "total") == [("admin", 70), ("reader", 30)]
    assert out(people, Aggregate(total | {"n": Measure("count")}), "total", "n") == [(100, 4)]
    assert out(people, Aggregate(total, "category", having=f.gt("total", 50)), "category") == [("admin",)]
    assert out(people.limit(0), Aggregate(total, "category"), "category") == []
    assert [tuple(r) for r in aggregate(people.limit(0), Aggregate(total)).collect()] == [(None,)]
    m = {"on": Measure("count", where={"active": True}), "off": Measure("count", where={"active": False}), "sum_on": Measure("sum", "count", where=f.eq("active", True)), "avg_off": Measure("avg", "count", where=f.eq("name", "d"))}
    assert out(people, Aggregate(m, "category"), "category", "on", "off", "sum_on", "avg_off") == [("admin", 0, 2, None, 40.0), ("reader", 2, 0, 30, None)]


def test_percentile_and_stddev(spark):
    df = spark.range(1, 101).toDF("count")
    r = aggregate(df, Aggregate({f"p{p}": Measure("percentile", "count", p=p / 100) for p in (50, 95, 99)})).first()
    assert 48 <= r["p50"] <= 52 and 93 <= r["p95"] <= 97 and 97 <= r["p99"] <= 100
    s = aggregate(spark.createDataFrame([(x,) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "x int"), Aggregate({"s": Measure("stddev", "x"), "p": Measure("stddevPop", "x")})).first()
    assert s["s"] == pytest.approx(2.138, abs=0.001) and s["p"] == pytest.approx(2.0)


def test_top_n(people):
    total = {"total": Measure("sum", "count")}
    top = lambda **k: Aggregate(total, ["category", "name"], top=TopN("category", **k))
    assert out(people, top(sort_by={"total": -1}, limit=1), "category", "name", "total") == [("admin", "d", 40), ("reader", "b", 20)]
    assert out(people, top(sort_by={"name": 1}, limit=1, ties="row_number"), "category", "name") == [("admin", "c"), ("reader", "a")]
    with pytest.raises(ValueError, match='topN.partitionBy "does-not-exist"'):
        grouped(people, Aggregate(total, "category", top=TopN("does-not-exist", {"total": 1}, 1)))


@pytest.mark.parametrize(
    "bad",
    [
        Aggregate({}),
        Aggregate({"x": Measure("median", "count")}),
        Aggregate({"x": Measure("percentile", "count", p=2)}),
        Aggregate({"x": Measure("sum")}),
        Aggregate({"x": Measure("count")}, "category", {"category": Bucket("at", "day")}),
        Aggregate({"x": Measure("count")}, buckets={"b": Bucket("at", "quarter", 2)}),
        Aggregate({"x": Measure("count")}, buckets={"b": Bucket("at", "day", 0)}),
        Aggregate({"x": Measure("count")}, "category", top=TopN("category", {"x": 1}, 0)),
    ],
)
def test_bad_requests(people, bad):
    with pytest.raises(ValueError):
        aggregate(people, bad)


def test_buckets(spark):
    rows = [("2026-01-15T00:00:00Z", 100), ("2026-01-22T00:00:00Z", 200), ("2026-02-05T00:00:00Z", 300), ("2026-04-10T00:00:00Z", 400), ("2026-07-20T00:00:00Z", 500), (None, 1), ("nonsense", 1)]
    df = spark.createDataFrame(rows, "at string, n int")
    labels = lambda df, b: {r["b"]: r["t"] for r in aggregate(df, Aggregate({"t": Measure("sum", "n")}, buckets={"b": b})).collect()}
    assert labels(df, Bucket("at", "month")) == {"2026-01": 300, "2026-02": 300, "2026-04": 400, "2026-07": 500, None: 2}
    assert labels(df, Bucket("at", "quarter"))["2026-Q1"] == 600 and labels(df, Bucket("at", "year"))["2026"] == 1500
    times = spark.createDataFrame([(datetime(2026, 1, 1, *t), 1) for t in ((10, 0), (10, 14), (10, 15), (10, 29), (10, 30))] + [(datetime(1969, 12, 31, 23, 50), 1)], "at timestamp, n int")
    assert labels(times, Bucket("at", "minute", 15)) == {"2026-01-01T10:00": 2, "2026-01-01T10:15": 2, "2026-01-01T10:30": 1, "1969-12-31T23:45": 1}
    assert labels(times, Bucket("at", "hour"))["2026-01-01T10:00"] == 5
    assert labels(times, Bucket("at", "day", timezone="Asia/Dhaka")) == {"2026-01-01": 5, "1970-01-01": 1}
    assert labels(times, Bucket("at", "week"))["2026-W01"] == 5
    millis = spark.createDataFrame([(1_767_261_600_000, 3)], "at long, n int")
    assert labels(millis, Bucket("at", "hour")) == {"2026-01-01T10:00": 3}


def test_lookups_keep_rows(spark, people):
    roles = spark.createDataFrame([(1, "reader", "r"), (2, "reader", "r2")], "id int, role string, label string")
    many = {r["name"]: r["roles"] for r in embed(people, Lookup("roles", "category", "role"), {"roles": roles}.get).collect()}
    assert len(many["a"]) == 2 and many["c"] == []
    one = {r["name"]: r["roles"] for r in embed(people, Lookup("roles", "category", "role", single=True, select=["label"], where={"id": 2}), {"roles": roles}.get).collect()}
    assert one["a"]["label"] == "r2" and one["c"] is None
    r = Aggregate({"n": Measure("count")}, "roles.label", lookups=[Lookup("roles", "category", "role", single=True)])
    nested = aggregate(people, r, {"roles": roles}.get, nested=True).collect()
    assert sorted((x["roles"]["label"] or "", x["n"]) for x in nested) == [("", 2), ("r", 2)]


def test_group_keyset_covers_ties(spark):
    df = spark.createDataFrame([(i % 37,) for i in range(111)], "k int")
    r = Aggregate({"n": Measure("count")}, "k", sort={"n": -1})
    seen, token = [], None
    while True:
        page = paging.group_keyset_page(grouped(df, r), r.sort, r.keys, token, 5)
        seen += [x["k"] for x in page.data]
        token = page.next
        if not page.has_more:
            break
    assert sorted(seen) == list(range(37))
    with pytest.raises(paging.InvalidCursor):
        paging.group_keyset_page(grouped(df, r), {"n": 1, "x": 1}, r.keys, paging.encode_group_cursor({"n": 1}, ["n"]), 5)


def test_offset_and_keyset_pages(spark):
    df = spark.createDataFrame([(i, i // 3 if i != 4 else None, datetime(2026, 1, 1, 0, 0, 0, i)) for i in range(10)], "id int, g int, at timestamp_ntz")
    p = paging.offset_page(df, {"id": 1}, 99, 3)
    assert (p.data, p.total, p.pages) == ([], 10, 4) and paging.offset_page(df.limit(0), None, 1, 3).pages == 0
    p = paging.offset_page(df, {"id": 1}, 2, 4, "none")
    assert p.has_next and p.total == 0 and [r["id"] for r in p.data] == [4, 5, 6, 7]
    for way in (1, -1):
        for field in ("g", "at"):
            seen, token = [], None
            while True:
                k = paging.keyset_page(df, {field: way}, "id", token, 4)
                seen += [r["id"] for r in k.data]
                token = k.next
                if not k.has_more:
                    break
            assert sorted(seen) == list(range(10))
    token = paging.keyset_page(df, {"at": 1}, "id", None, 2).next
    with pytest.raises(paging.InvalidCursor):
        paging.keyset_page(df, {"g": 1}, "id", token, 2)
    for bad in ("", "x", "e30", "bnVsbA"):
        with pytest.raises(paging.InvalidCursor):
            paging.decode_cursor(bad)
    with pytest.raises(ValueError):
        paging.valid_keyset_sort({"a": 1, "b": -1}, "id")
    with pytest.raises(ValueError):
        paging.valid_keyset_sort({"a": 1}, None)
    assert paging.valid_limit("abc") == 10 and paging.valid_limit(1e9) == 100 and paging.valid_limit(7.9) == 7 and paging.valid_limit(500, cap=0) == 500
    assert paging.valid_page(-1) == 1 and paging.page_count(0, 5) == 0 and paging.canonical(p)["kind"] == "offset" and paging.is_page(k)
    with pytest.raises(ValueError):
        paging.valid_page(10_001)
    assert paging.normal_sort({"id": -1, "a": 1}, "id") == {"a": 1, "id": -1} and paging.inverted({"a": 1}) == {"a": -1} and paging.primary_field({"id": 1}, "id") == "id"


def test_deep_offset_pages_are_narrowed_down(spark, monkeypatch):
    monkeypatch.setattr(paging, "SKIPPED", 60)
    monkeypatch.setattr(paging, "PIVOTS", 4)
    rows = [(i, [None, "b", "é", "z"][i % 4], None if i % 9 == 0 else float(i // 30), datetime(2026, 1, 1 + i % 5, i % 24)) for i in range(300)]
    df = spark.createDataFrame(rows + [(999, "same", 1.0, datetime(2026, 2, 1))] * 60, "id int, g string, x double, at timestamp").coalesce(2)
    for sort in ({"g": -1, "id": -1}, {"x": 1, "at": -1, "id": 1}):
        want = [tuple(r) for r in sorted_by(df, sort).select("id", "g").collect()]
        for page in (14, 33):
            p = paging.offset_page(df, sort, page, 10, select=["id", "g"])
            assert [tuple(r) for r in p.data] == want[10 * page - 10 : 10 * page] and (p.total, p.pages) == (360, 36)
    pages = [paging.offset_page(df, {"g": 1}, page, 100) for page in (2, 3, 4)]  # ties
    seen = [r["id"] for p in pages for r in p.data]
    assert len(seen) == 260 and len(set(seen) - {999}) == len([i for i in seen if i != 999])
    assert not paging.offset_page(df, {"id": 1}, 36, 10, "none").has_next


def test_the_last_allowed_page_is_set_by_the_repository(spark):
    df = spark.range(10_050)
    with pytest.raises(ValueError):
        Repository("r", df, "id").get_all(page=10_050, limit=1, sort={"id": 1})
    p = Repository("r", df, "id", max_page=0).get_all(page=10_050, limit=1, sort={"id": 1})
    assert [r["id"] for r in p.data] == [10_049] and (p.pages, p.has_next) == (10_050, False)


def test_text_without_an_offset_is_utc_in_any_session_zone(spark):
    texts = ["2026-01-05T10:00:00", "2026-01-05 10:00:00", "2026-01-05T10:00:00Z", "2026-01-05T12:00:00+02:00", "2026-01-05T05:00:00.5-0500", "2026-01-05", "no date"]
    df = spark.createDataFrame([(t,) for t in texts], "at string")
    millis = spark.createDataFrame([(1767607200000,)], "at long")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("Asia/Tokyo", "America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            rows = aggregate(df, Aggregate({"n": Measure("count")}, buckets={"hour": Bucket("at", "hour")})).collect()
            assert {r["hour"]: r["n"] for r in rows} == {"2026-01-05T10:00": 5, "2026-01-05T00:00": 1, None: 1}
            assert aggregate(millis, Aggregate({"n": Measure("count")}, buckets={"hour": Bucket("at", "hour")})).first()["hour"] == "2026-01-05T10:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_percentiles_of_one_column_share_a_buffer(spark, capsys):
    df = spark.range(1, 101).selectExpr("id % 2 g", "cast(id as double) x")
    m = {f"p{p}": Measure("percentile", "x", p=p / 100) for p in (50, 95)} | {"big": Measure("percentile", "x", p=0.5, where=f.gt("x", 50)), "n": Measure("count"), "near": Measure("percentile", "x", p=0.5, accuracy=1000)}
    out = aggregate(df, Aggregate(m, "g", sort={"g": 1}))
    assert out.columns == ["g", "p50", "p95", "big", "n", "near"]
    assert [tuple(r) for r in out.collect()] == [(0, 51.0, 95.1, 76.0, 50, 50.0), (1, 50.0, 94.1, 75.0, 50, 49.0)]
    out.explain()
    assert capsys.readouterr().out.count("percentile(x#") <= 4  # two aggregates, partial and final
