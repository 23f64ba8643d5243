import threading
import time

import pytest
from pyspark.sql import functions as F

from loomsheet.operators.writes import per_row
from loomsheet.plans import filters as f
from loomsheet.plans.records import record_to_filter
from loomsheet.plans.requests import Aggregate, Lookup, Measure, TopN, combine_updates, inc_fields, set_fields, set_on_insert_fields, unset_fields, update
from loomsheet.repository import Repository
from loomsheet.runtime import control, errors
from loomsheet.runtime.cache import Cache, CacheOptions, MemoryAdapter, TimeoutAdapter, cache_key, content_hash, stable
from loomsheet.runtime.hooks import Hooks, check_plugin_order, emit_events
from loomsheet.sources.tables import AppendLog, ParquetSink, SnapshotTable

SCHEMA = "id string, name string, category string, count long, active boolean, deleted boolean, version long, organizationId string"


@pytest.fixture
def repo(spark, tmp_path):
    rows = [(f"u{i}", f"n{i}", ["reader", "admin", None][i % 3], i, i % 2 == 0, False, 1 if i else None, "org-a" if i < 6 else "org-b") for i in range(10)]
    table = SnapshotTable(spark, f"{tmp_path}/t", "id").create(spark.createDataFrame(rows, SCHEMA))
    return Repository("users", table, unique=[("name",)])


def test_reads(repo):
    assert repo.get_by_id("u3")["name"] == "n3" and repo.get_by_id("zz") is None
    assert repo.get_one({"category": "admin"}, {"count": -1})["id"] == "u7"
    assert set(repo.get_by_ids(["u1", "u1", "u2", "nope", None])) == {"u1", "u2"} and repo.get_by_ids([]) == {}
    assert repo.count({"category": "admin"}) == 3 and repo.exists({"count": 9}) and not repo.exists({"count": 99})
    assert sorted(repo.distinct("category"), key=str) == [None, "admin", "reader"]
    assert [r["id"] for r in repo.cursor(f.lt("count", 4))] == ["u0", "u1", "u2", "u3"]
    assert [r["id"] for r in repo.find_all(sort={"count": -1}, limit=2)] == ["u9", "u8"]
    assert repo.query("count[gte]=4&sort=-count&limit=3&page=1").total == 6
    walk = repo.query("category[ne]=admin&sort=count&limit=3")
    assert [r["id"] for r in walk.data] == ["u0", "u3", "u6"] and repo.get_all({"category": {"ne": "admin"}}, sort={"count": 1}, after=walk.next, limit=3).data[0]["id"] == "u9"
    assert len(repo.get_all(search="N3")) == 1


def test_create_and_duplicates(repo):
    before = repo.source.version
    repo.create({"id": "x", "name": "new"})
    assert repo.get_by_id("x")["category"] is None and repo.source.version == before + 1
    with pytest.raises(errors.DuplicateKey):
        repo.create({"id": "x", "name": "other"})
    with pytest.raises(errors.DuplicateKey):
        repo.create_many([{"id": "y", "name": "n1"}])
    assert repo.source.read(before).count() == 10


def test_updates(repo):
    assert repo.update_many({"category": "admin"}, set_fields(category="admin", active=True)) == {"matchedCount": 3, "modifiedCount": 2}
    assert repo.update("u1", combine_updates(inc_fields(count=5), unset_fields("category")))["count"] == 6
    assert repo.get_by_id("u1")["category"] is None and repo.update("none", {"name": "q"}) is None
    assert repo.update("u2", {"name": "z"}, if_version=1)["version"] == 2
    with pytest.raises(errors.VersionConflict):
        repo.update("u2", {"name": "zz"}, if_version=1)
    assert repo.find_one_and_update({"category": "reader"}, set_fields(name="first"), {"count": 1})["id"] == "u0"
    assert repo.find_one_and_update({"id": "u5"}, set_fields(name="after"), image="before")["name"] == "n5"
    assert repo.find_one_and_update({"id": "new"}, combine_updates(set_fields(name="up"), set_on_insert_fields(count=7)), upsert=True)["count"] == 7
    assert repo.get_or_create({"id": "goc"}, {"name": "made"})["created"] and not repo.get_or_create({"id": "goc"}, {"name": "x"})["created"]
    with pytest.raises(ValueError):
        update()


def test_deletes_keep_unknown_rows(repo):
    assert repo.delete_many(f.eq("category", "admin")) == {"deletedCount": 3} and repo.count() == 7
    assert repo.delete("u0") == {"id": "u0"} and repo.delete("u0") is None


def test_bulk_and_transactions(repo):
    version = repo.source.version
    n = repo.bulk_write([{"insertOne": {"document": {"id": "b", "name": "b"}}}, {"updateMany": {"filter": {"id": "b"}, "update": {"count": 1}}}, {"updateOne": {"filter": {"id": "c"}, "update": {"name": "c"}, "upsert": True}}, {"deleteOne": {"filter": {"category": "admin"}}}, {"deleteMany": {"filter": {"category": "reader"}}}, {"replaceOne": {"filter": {"id": "b"}, "replacement": {"name": "bb"}}}])
    assert n == {"inserted": 1, "matched": 2, "modified": 2, "deleted": 5, "upserted": 1} and repo.source.version == version + 1
    assert repo.get_by_id("b")["name"] == "bb" and repo.get_by_id("b")["count"] is None

    def broken(r):
        r.create({"id": "t", "name": "t"})
        assert r.exists({"id": "t"})
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        repo.transaction(broken)
    assert not repo.exists({"id": "t"}) and repo.source.version == version + 1
    repo.retrying_transaction(lambda r: r.create({"id": "t", "name": "t"}))
    with pytest.raises(errors.Conflict):
        repo.source.publish(repo.read(), 1)
    assert repo.source.vacuum(1) >= 1 and repo.count() > 0


def test_claims(repo):
    assert repo.claim("u1", "category", ["admin"], "busy")["category"] == "busy" and repo.claim("u1", "category", "admin", "busy") is None
    assert repo.claim("u2", "category", None, "busy", where={"count": 2})["category"] == "busy"
    assert repo.claim_version("u3", 1)["version"] == 2 and repo.claim_version("u3", 1) is None and repo.claim_version("u0", None)["version"] == 1
    machine = control.StateMachine("category", {"reader": ["admin"]})
    assert repo.apply_transition("u6", machine, "admin")["category"] == "admin"
    with pytest.raises(errors.IllegalTransition):
        repo.apply_transition("u6", machine, "reader")
    with pytest.raises(errors.NotFound):
        repo.apply_transition("none", machine, "admin")


def test_soft_delete_tenancy_and_hooks(spark, repo):
    soft = Repository("users", repo.source, soft_delete="deleted", tenancy=control.Tenancy())
    assert soft.count(tenant="org-a") == 6
    with pytest.raises(errors.Invalid):
        soft.count()
    soft.delete("u1", tenant="org-a")
    assert soft.get_by_id("u1", tenant="org-a") is None and len(soft.get_deleted(tenant="org-a")) == 1 and soft.count(tenant="org-a", include_deleted=True) == 6
    assert soft.restore("u1", tenant="org-a")["id"] == "u1" and soft.get_by_id("u1", tenant="org-b") is None
    assert soft.create({"id": "q", "name": "q", "organizationId": "other", "deleted": False}, tenant="org-a")["organizationId"] == "org-a"
    seen = []
    soft.hooks.on("before:count", lambda c: c.update(query={"id": "u2"}), 100)
    soft.hooks.on("after:count", lambda c: seen.append(c["result"]))
    assert soft.count(tenant="org-a") == 1 and seen == [1]
    emit_events(soft.hooks, "user", lambda e: seen.append(e["type"]))
    soft.update("u2", {"name": "new"}, tenant="org-a")
    assert "user.updated" in seen
    with pytest.raises(errors.ReadOnly):
        soft.sealed().create({"id": "z"})
    assert soft.sealed().exists({"id": "u2"}, tenant="org-a")
    check_plugin_order(["tenant", "cache"])
    with pytest.raises(ValueError):
        check_plugin_order(["cache", "tenant"])


def test_aggregate_and_populate(spark, repo):
    cats = spark.createDataFrame([("reader", "R"), ("admin", "A")], "id string, label string")
    r = Repository("users", repo.source, catalog={"category": cats})
    out = r.aggregate(Aggregate({"n": Measure("count")}, "category.label", lookups=[Lookup("category", "category", "id", single=True)], sort={"n": -1}, hints={"max_time_ms": 60_000}))
    assert {(x["category"]["label"], x["n"]) for x in out} == {("R", 4), ("A", 3), (None, 3)}
    page = r.aggregate_paginate(Aggregate({"n": Measure("count")}, "category"), page=1, limit=2)
    assert page.total == 3 and page.has_next
    page = r.lookup_populate([Lookup("category", "category", "id", as_="c", single=True)], sort={"id": 1}, page=2, limit=4)
    assert [x["id"] for x in page.data] == ["u4", "u5", "u6", "u7"] and page.data[0]["c"]["label"] == "A" and page.total == 10
    page = r.query("populate=category&sort=id&limit=3")
    assert [x["category"]["label"] if x["category"] else None for x in page.data] == ["R", "A", None]


def test_purge_modes_and_chunks(repo):
    progress = []
    assert repo.purge({"organizationId": "org-a"}, "anonymize", {"name": "gone", "count": lambda df: F.col("count") * 0}, batch=4, progress=progress.append) == {"ok": True, "processed": 6}
    assert progress == [4, 6] and repo.count({"name": "gone", "count": 0}) == 6 and repo.count({"organizationId": "org-b"}) == 4
    assert repo.purge({}, "skip", reason="law")["processed"] == 0
    assert repo.purge({"id": "u9"}, "soft")["processed"] == 1 and repo.get_by_id("u9")["deleted"]
    stop = threading.Event()
    stop.set()
    assert not repo.purge({}, "hard", batch=2, aborted=stop)["ok"] and repo.count() == 10
    step = repo.purge_step({"organizationId": "org-a"})
    assert step["estimate"]() == 6 and step["execute"]()["ok"] and step["verify"]()


def test_archive_writes_before_it_deletes(spark, repo, tmp_path):
    class Broken:
        def write(self, rows, batch):
            raise OSError("full")

    bad = repo.archive(f.lt("count", 3), Broken())
    assert not bad["ok"] and bad["phase"] == "write" and repo.count() == 10
    sink = ParquetSink(f"{tmp_path}/archive")
    assert repo.archive(f.lt("count", 5), sink, batch=2) == {"ok": True, "archived": 5}
    assert sink.flushed == 1 and repo.count() == 5 and spark.read.parquet(f"{tmp_path}/archive").count() == 5


def test_change_log_and_stream(spark, tmp_path):
    from loomsheet.operators import changes
    from loomsheet.streaming.watch import change_stream, drain

    log = AppendLog(spark, f"{tmp_path}/log")
    assert log.latest() is None and log.since(None)["entries"] == []
    first = log.append([{"scope": "s", "docId": "a", "op": "create", "doc": {"n": 1}}, {"scope": "s", "docId": "b", "op": "create", "doc": {"n": 2}, "tenantId": "t"}])
    log.append([{"scope": "s", "docId": "a", "op": "delete"}, {"scope": "s", "docId": "b", "op": "update", "doc": {"n": 3}}])
    assert [e["op"] for e in log.since(first)["entries"]] == ["delete", "update"] and log.since(None, limit=3)["hasMore"]
    assert len(log.since(None, tenant="t")["entries"]) == 1
    assert [(r["docId"], r["doc"]) for r in changes.snapshot(log.read()).collect()] == [("b", '{"n": 3}')]
    feed = lambda: change_stream(spark, f"{tmp_path}/log", AppendLog.SCHEMA, f.ne("op", "create"))
    drain(feed(), f"{tmp_path}/cp", f"{tmp_path}/out")
    log.append([{"scope": "s", "docId": "c", "op": "update", "doc": {"n": 9}}])
    drain(feed(), f"{tmp_path}/cp", f"{tmp_path}/out")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]
    log.prune(first)
    assert log.read().count() == 3


def test_cache():
    now = [0.0]
    cache = Cache(now=lambda: now[0])
    calls = []
    load = lambda: calls.append(1) or len(calls)
    o = CacheOptions(stale_time=10, gc_time=10, tags=("t",))
    assert [cache.fetch("k", load, o) for _ in range(2)] == [1, 1]
    now[0] = 11
    assert cache.state("k", o)[0] == "stale" and cache.fetch("k", load, o) == 2
    assert cache.fetch("k", load, CacheOptions(enabled=False)) == 3 and cache.fetch("k", load, CacheOptions(bypass=True, stale_time=10)) == 4
    assert cache.invalidate_tags("t") >= 1 and cache.state("k", o)[0] == "miss"
    assert cache.bump("m") == 1 and cache.version("m") == 1
    assert cache_key("op", "m", 1, {"a": 1, "b": 2, "hints": 3}) == cache_key("op", "m", 1, {"b": 2, "a": 1})
    assert stable({"b": float("nan"), "a": {2, 1}}) == '{"a":[1,2],"b":null}' and len(content_hash({})) == 64
    slow = TimeoutAdapter(type("S", (), {"get": lambda self, k: time.sleep(1)})(), 0.05)
    assert slow.get("x") is None
    lru = MemoryAdapter(2)
    for k in "abc":
        lru.set(k, k)
    assert lru.get("a") is None and lru.get("c") == "c"
    flights, gate = [], threading.Event()
    threads = [threading.Thread(target=lambda: flights.append(cache.fetch("one", lambda: gate.wait(5) and calls.append(1) or 7, o))) for _ in range(4)]
    before = len(calls)
    [t.start() for t in threads]
    time.sleep(0.1)
    gate.set()
    [t.join() for t in threads]
    assert flights == [7] * 4 and len(calls) == before + 1


def test_repository_cache_follows_writes(repo):
    r = Repository("users", repo.source, cache=Cache())
    o = CacheOptions(stale_time=60)
    assert r.count(cache=o) == 10
    r.create({"id": "x", "name": "x"})
    assert r.count(cache=o) == 11


def test_locks_retries_guards():
    now = [0.0]
    locks = control.MemoryLocks(lambda: now[0])
    a = locks.acquire("x", 5)
    assert locks.acquire("x", 5) is None and locks.renew(a, 5)
    now[0] = 6
    b = locks.acquire("x", 5)
    assert b.token > a.token and not locks.release(a) and locks.release(b) and locks.with_lock("x", 1, lambda l: l.token) > b.token
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise errors.Conflict("again")
        return "ok"

    assert control.retry(flaky, sleep=lambda s: None) == "ok" and len(tries) == 3
    with pytest.raises(ValueError):
        control.retry(lambda: int("x"), sleep=lambda s: None)
    assert control.guard_distribution(f.or_(f.eq("org", 1), f.eq("a", 2)), "org")
    with pytest.warns(UserWarning):
        assert not control.guard_distribution(f.eq("a", 1), "org")
    with pytest.raises(errors.Invalid):
        control.guard_distribution(f.TRUE, "org", "throw")
    assert control.fields_required(f.and_(f.eq("a", 1), f.or_(f.eq("b", 1), f.and_(f.eq("b", 2), f.eq("c", 3))))) == {"a", "b"}
    assert control.Capabilities().supports("percentile") and not control.Capabilities().supports("nested_lookups")
    assert errors.to_contract(errors.NotFound("x")) == {"code": "NOT_FOUND", "message": "x", "status": 404}
    h = Hooks()
    order = []
    h.on("before:x", lambda c: order.append(2), 300)
    off = h.on("before:x", lambda c: order.append(1), 100)
    h.emit("before:x", {})
    off()
    h.emit("before:x", {})
    assert order == [1, 2, 2]


def test_archive_runs_to_one_sink_lose_nothing(spark, repo, tmp_path):
    sink = ParquetSink(f"{tmp_path}/archive")
    assert repo.archive(f.lt("count", 3), sink)["archived"] == 3 and repo.archive(f.lt("count", 6), sink, batch=2)["archived"] == 3
    stored = lambda: sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/archive").collect())
    assert repo.count() == 4 and stored() == [f"u{i}" for i in range(6)]


def test_a_batch_written_but_not_deleted_is_stored_once(spark, repo, tmp_path):
    class Late(ParquetSink):
        """Fails after its second batch is stored."""

        calls = 0

        def write(self, rows, batch):
            super().write(rows, batch)
            self.calls += 1
            if self.calls == 2:
                raise OSError("gone")

    sink = Late(f"{tmp_path}/archive")
    out = repo.archive(f.lt("count", 6), sink, batch=2)
    assert not out["ok"] and out["phase"] == "write" and out["archived"] == 2 and repo.count() == 8
    repo.update("u2", {"category": "changed"})
    assert repo.archive(f.lt("count", 6), sink, batch=3) == {"ok": True, "archived": 4}
    rows = spark.read.parquet(f"{tmp_path}/archive").collect()
    assert sorted(r["id"] for r in rows) == [f"u{i}" for i in range(6)] and repo.count() == 4
    assert {r["category"] for r in rows if r["id"] == "u2"} == {"changed"}


def test_cache_keeps_readers_apart(repo):
    o = CacheOptions(stale_time=60)
    r = Repository("users", repo.source, cache=Cache(), soft_delete="deleted", tenancy=control.Tenancy())
    assert r.count(cache=o, skip_tenant=True) == 10 and r.count(cache=o, tenant="org-a") == 6 and r.count(cache=o, tenant="org-b") == 4
    r.delete("u1", tenant="org-a")
    assert r.count(cache=o, tenant="org-a", include_deleted=True) == 6 and r.count(cache=o, tenant="org-a") == 5
    assert r.get_all(page=1, count="none", cache=o, tenant="org-a").total == 0 and r.get_all(page=1, cache=o, tenant="org-a").total == 5
    # a policy set by a hook takes part
    guest = r.hooks.on("before:count", lambda c: c.update(query={"id": "u2"}))
    assert r.count(cache=o, tenant="org-a") == 1
    guest()
    assert r.count(cache=o, tenant="org-a") == 5
    custom = Repository("users", repo.source, cache=r.cache, tenancy=control.Tenancy("custom", resolve=lambda c: f.eq("category", c["who"])))
    assert [custom.count(cache=o, who=w) for w in ("admin", "reader", "admin")] == [3, 4, 3]
    calls = []
    r.hooks.on("after:count", lambda c: calls.append(c["result"]))
    version = r.source.version
    assert r.count(cache=o, tenant="org-b") == r.count(cache=o, tenant="org-b") == 4 and calls == [4, 4] and r.source.version == version


def test_rolled_back_reads_are_not_kept(repo):
    r, o = Repository("users", repo.source, cache=Cache()), CacheOptions(stale_time=60)

    def body(t):
        t.delete_many({"category": "admin"})
        assert t.count(cache=o) == 7
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        r.transaction(body)
    assert r.count(cache=o) == 10
    r.transaction(lambda t: t.delete_many({"category": "admin"}))
    assert r.count(cache=o) == 7


def test_unique_keys_on_every_write(repo):
    for write in (
        lambda: repo.update("u1", {"name": "n2"}),
        lambda: repo.update("u1", {"id": "u2"}),
        lambda: repo.update_many({"category": "admin"}, {"name": "same"}),
        lambda: repo.update_many({"id": "u1"}, {"name": "n2"}),
        lambda: repo.find_one_and_update({"id": "u1"}, set_fields(name="n2")),
        lambda: repo.find_one_and_update({"id": "new"}, set_fields(name="n2"), upsert=True),
        lambda: repo.get_or_create({"id": "new"}, {"name": "n2"}),
        lambda: repo.claim("u1", "name", "n1", "n2"),
        lambda: repo.bulk_write([{"updateOne": {"filter": {"id": "c"}, "update": {"name": "n2"}, "upsert": True}}]),
    ):
        with pytest.raises(errors.DuplicateKey):
            write()
    assert repo.count() == 10 and len(repo.distinct("name")) == 10
    assert repo.update("u1", {"name": "n1", "count": 3})["count"] == 3 and repo.update("u1", {"name": None})["name"] is None
    assert repo.update("u2", {"name": None})["name"] is None  # nulls are no keys


def test_policies_reach_every_verb(spark, repo, tmp_path):
    r = Repository("users", repo.source, soft_delete="deleted", key="id")
    for op in ("getById", "getByIds", "cursor", "update", "delete", "restore", "claim", "claimVersion", "purge", "archive", "aggregate", "aggregatePaginate", "lookupPopulate", "getDeleted", "getOrCreate", "updateMany", "findOneAndUpdate"):
        key = "filters" if op in ("aggregatePaginate", "lookupPopulate") else "query"
        r.hooks.on(f"before:{op}", lambda c, key=key: c.update({key: f.and_(f.eq("organizationId", "org-a"), record_to_filter(c[key]))}), 100)
    assert r.get_by_id("u7") is None and r.get_by_id("u1")["id"] == "u1" and set(r.get_by_ids(["u1", "u7"])) == {"u1"}
    assert len(list(r.cursor())) == 6 and r.update("u7", {"name": "x"}) is None and r.delete("u7") is None
    assert r.claim("u7", "category", "admin", "x") is None and r.claim_version("u7", 1) is None
    assert r.update_many({}, {"active": True})["matchedCount"] == 6 and r.find_one_and_update({"id": "u8"}, set_fields(name="x")) is None
    assert r.aggregate(Aggregate({"n": Measure("count")}))[0]["n"] == 6
    assert r.aggregate_paginate(Aggregate({"n": Measure("count")}, "organizationId")).total == 1
    assert r.lookup_populate([], limit=50).total == 6
    assert r.delete("u1") == {"id": "u1"} and [x["id"] for x in r.get_deleted()] == ["u1"] and r.restore("u7") is None and r.restore("u1")["id"] == "u1"
    assert r.archive({"id": ["u6", "u0"]}, ParquetSink(f"{tmp_path}/a"))["archived"] == 1 and r.purge({}, "hard")["processed"] == 5
    assert repo.count() == 4
    with pytest.raises(errors.ReadOnly):
        r.sealed().get_or_create


def test_purge_step_needs_a_scope_and_asks_again(repo):
    for node in (None, {}, f.TRUE, {"organizationId": None}):
        step = repo.purge_step(node)
        assert step["blockers"]() and step["estimate"]() == 0 and not step["execute"]()["ok"] and not step["verify"]()
    assert repo.count() == 10
    scope = {"organizationId": "org-a"}
    soft = repo.purge_step(scope, "soft")
    assert not soft["verify"]() and soft["execute"]()["ok"] and soft["verify"]()
    anonymous = repo.purge_step(scope, "anonymize", {"category": "gone", "version": None})
    assert not anonymous["verify"]() and anonymous["execute"]()["ok"] and anonymous["verify"]()
    assert not repo.purge_step(scope, "anonymize", {"name": lambda df: F.lit("x")})["verify"]()  # cannot be judged
    assert repo.purge_step(scope, "anonymize", {"name": lambda df: F.lit("x")}, remaining={"category": {"ne": "gone"}})["verify"]()


def test_anonymize_by_a_function_of_the_row(repo):
    hide = per_row(lambda r: f"{r['organizationId']}-{len(r['name'])}-{r['id'][-1]}", "string", "organizationId", "name", "id")
    assert repo.purge({"organizationId": "org-b"}, "anonymize", {"name": hide})["processed"] == 4
    assert repo.get_by_id("u9")["name"] == "org-b-2-9" and repo.get_by_id("u1")["name"] == "n1"


def test_url_answers_what_was_asked(spark, repo):
    assert [tuple(r.asDict()) for r in repo.query("sort=-id&select=id").data][0] == ("id",)
    page = repo.query("sort=-count&select=-name,-category&limit=3")
    assert "name" not in page.data[0].asDict() and [r["id"] for r in repo.query(f"sort=-count&select=id&limit=3&after={page.next}").data] == ["u6", "u5", "u4"]
    r = Repository("users", repo.source, catalog={"category": spark.createDataFrame([("reader", "R")], "id string, label string")})
    assert [x["id"] for x in r.query("populate=category&search=N3").data] == ["u3"]
    assert r.lookup_populate([], limit=3, count="none").total == 0 and r.lookup_populate([], limit=3, count="none").has_next
    assert repo.query(f"page={'9' * 5000}").page == 1
    many = Repository("many", spark.range(300).withColumnRenamed("id", "n"), key="n")
    assert len(many.query("limit=150").data) == 150 and len(many.query("limit=150&sort=n").data) == 150 and len(many.query("limit=999").data) == 200


def test_reads_can_be_stopped_and_repeated(spark, repo):
    stop = threading.Event()
    stop.set()
    with pytest.raises(control.Aborted):
        repo.count(signal=stop)
    slow = Repository("slow", spark.range(8, numPartitions=8).select(F.udf(lambda x: time.sleep(6) or x, "long")("id").alias("x")), key="x")
    start, stop = time.monotonic(), threading.Event()
    threading.Timer(1, stop.set).start()
    with pytest.raises(control.Aborted):
        slow.find_all(signal=stop)
    for call in (lambda r: slow.aggregate(r), lambda r: slow.aggregate_paginate(r)):
        with pytest.raises(errors.TimedOut):
            call(Aggregate({"n": Measure("max", "x")}, "x", hints={"max_time_ms": 500}))
    assert time.monotonic() - start < 18
    tries = []

    def flaky(c):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("again")

    repo.hooks.on("before:count", flaky)
    assert repo.count(retry=control.RetryPolicy(attempts=3, base=0.01)) == 10


def test_writes_touch_only_files_with_matches(spark, repo, tmp_path):
    rows = spark.range(100).selectExpr("cast(id as string) id", "id n").repartitionByRange(10, "n")
    table = SnapshotTable(spark, f"{tmp_path}/files", "id").create(rows)
    r = Repository("files", table)
    names = lambda v=None: {f"{k}/{x}" for k, xs in (table.manifest() if v is None else next(h for h in table.manifest()["history"] if h["version"] == v))["files"].items() for x in xs}
    first = names()
    assert r.update("50", {"n": -1})["n"] == -1 and len(first - names()) == 1 and r.count() == 100
    assert r.update("none", {"n": 0}) is None and r.create({"id": "new", "n": 7})["n"] == 7 and r.count() == 101
    assert r.delete_many(f.lt("n", 5))["deletedCount"] == 6 and r.count() == 95 and table.read(1).count() == 100
    assert len(first & names()) == 8
    table.compact()
    assert table.vacuum(1) > 0 and r.count() == 95 and r.get_by_id("99")["n"] == 99
    split = SnapshotTable(spark, f"{tmp_path}/split", "id", partition_by="k").create(rows.selectExpr("*", "concat('a b%', n % 3) k"))
    s = Repository("split", split)
    assert s.update("4", {"n": -4})["n"] == -4 and s.count() == 100 and s.count({"k": "a b%1"}) == 33


def test_one_writer_of_a_log_at_a_time(spark, tmp_path):
    log = AppendLog(spark, f"{tmp_path}/log")
    entry = {"scope": "s", "docId": "a", "op": "create", "doc": {}}
    log.append([entry] * 3)
    other = AppendLog(spark, f"{tmp_path}/log")
    assert log._store.claim(log._lock)
    with pytest.raises(errors.Conflict):
        other.append([entry])
    log._store.delete(log._lock)
    last = other.append([entry])
    log.prune(last)
    assert log.read().count() == 0 and int(log.append([entry])) == 5 and other.latest() == log.latest()


def test_codes_on_the_wire():
    wire = lambda e: errors.to_wire(e)["code"]
    assert [wire(e) for e in (errors.NotFound("x"), errors.Conflict("x"), errors.Invalid("x"), errors.PreconditionFailed("x"), errors.TimedOut("x"), errors.ReadOnly("x"), KeyError("x"), ValueError("x"))] == ["not_found", "conflict", "validation_error", "precondition_failed", "timeout", "forbidden", "internal_error", "validation_error"]
    own = errors.Conflict("x")
    own.code = "idempotency_conflict"
    assert wire(own) == "idempotency_conflict"


def test_bulk_by_key_is_one_merge_and_equals_the_steps(spark, repo, tmp_path):
    steps = [
        {"insertOne": {"document": {"id": "b", "name": "b", "count": 1}}}, {"updateOne": {"filter": {"id": "b"}, "update": inc_fields(count=4)}},
        {"updateMany": {"filter": {"id": "u1"}, "update": {"category": None}}}, {"updateMany": {"filter": {"id": "u2"}, "update": {"count": 2}}},
        {"deleteOne": {"filter": {"id": "u3"}}}, {"insertOne": {"document": {"id": "u3", "name": "again"}}}, {"deleteMany": {"filter": {"id": "nobody"}}},
        {"updateOne": {"filter": {"id": "c"}, "update": set_on_insert_fields(name="c"), "upsert": True}}, {"replaceOne": {"filter": {"id": "u4"}, "replacement": {"name": "r"}}},
    ]
    other = Repository("users", SnapshotTable(spark, f"{tmp_path}/other", "id").create(repo.read()), unique=[("name",)])
    other.hooks.on("after:create", lambda c: None)  # one by one
    version = repo.source.version
    assert repo.bulk_write(steps) == other.bulk_write(steps) and repo.source.version == version + 1
    assert sorted(map(str, repo.read().collect())) == sorted(map(str, other.read().collect()))
    for bad in ({"insertOne": {"document": {"id": "u5"}}}, {"updateOne": {"filter": {"id": "u5"}, "update": {"name": "n6"}}}):
        with pytest.raises(errors.DuplicateKey):
            repo.bulk_write([{"deleteOne": {"filter": {"id": "u9"}}}, bad])
    assert repo.exists({"id": "u9"})
    assert repo.bulk_write([{"insertOne": {"document": {"id": "new", "name": "new"}}}])["inserted"] == 1 and repo.get_by_id("new")["count"] is None
    tenant = Repository("users", repo.source, tenancy=control.Tenancy())
    assert tenant.bulk_write([{"deleteOne": {"filter": {"id": "u9"}}}], tenant="org-a")["deleted"] == 0 and repo.exists({"id": "u9"})
    with pytest.raises(errors.DuplicateKey):
        tenant.bulk_write([{"insertOne": {"document": {"id": "u9"}}}], tenant="org-a")
