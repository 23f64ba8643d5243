"""Parquet tables, and snapshot tables for the write verbs.

A snapshot table is a folder of immutable parquet files and a manifest that names those of
the current version.  A write stores new files, then replaces the manifest by a rename in
one step; readers of an older version are not disturbed.  Inserts only add files; updates
and deletes rewrite only the files that hold a match.  The rename goes through Hadoop's
file system, so any store that Spark can reach will do.  One writer at a time is assumed
and checked: a manifest that moved since the write began is a conflict.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime.errors import Conflict


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session may go without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "loomsheet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is stored there is deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    Store(spark, path).delete_at_exit(path)
    return path


class Store:
    """Files through Hadoop's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.hadoop = spark, spark._jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.hadoop.Path(root).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.hadoop.Path(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.hadoop.Path(path), True)

    def delete_at_exit(self, path: str) -> None:
        self.fs.deleteOnExit(self.hadoop.Path(path))

    def read(self, path: str) -> dict:
        where = self.hadoop.Path(path)
        stream = self.fs.open(where)
        try:
            return json.loads(bytes(stream.readNBytes(int(self.fs.getFileStatus(where).getLen()))).decode())
        finally:
            stream.close()

    def replace(self, path: str, value: dict) -> None:
        """Store a small file anew, in one step."""
        folder = path.rsplit("/", 1)[0]
        draft = f"{folder}/_draft-{uuid.uuid4().hex}"
        out = self.fs.create(self.hadoop.Path(draft), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        self.rename(draft, path)

    def rename(self, source: str, target: str) -> None:
        kind = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark._sc._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        self.hadoop.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.hadoop.Path(source), self.hadoop.Path(target), options)

    def claim(self, path: str) -> bool:
        """Create the file; False if it is there."""
        try:
            self.fs.create(self.hadoop.Path(path), False).close()
            return True
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise

    def files(self, folder: str) -> list[str]:
        """The data files below a folder, by their paths within it."""
        found, it = [], self.fs.listFiles(self.hadoop.Path(folder), True)
        start = f"/{folder.rstrip('/').rsplit('/', 1)[-1]}/"
        while it.hasNext():
            path = it.next().getPath().toString()
            name = path[path.rindex(start) + len(start) :]
            if not any(part.startswith(("_", ".")) for part in name.split("/")):
                found.append(name)
        return sorted(found)


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, key: str, partition_by: str | None = None):
        self.spark, self.path, self.key, self.partition_by = spark, path.rstrip("/"), key, partition_by
        self._store, self._manifest = Store(spark, self.path), f"{self.path}/_manifest.json"

    def exists(self) -> bool:
        return self._store.exists(self._manifest)

    def manifest(self) -> dict:
        return self._store.read(self._manifest) if self.exists() else {"version": 0, "files": {}, "schema": None, "history": []}

    @property
    def version(self) -> int:
        return self.manifest()["version"]

    def _frame(self, entry: dict, only: dict[str, list[str]] | None = None, named: bool = False) -> DataFrame:
        """The rows of these files; ``named`` adds each row's file."""
        schema = T.StructType.fromJson(entry["schema"])
        add = lambda df: df.select("*", F.col("_metadata.file_path").alias("__file")) if named else df
        folders = {f"{self.path}/{k}": v for k, v in (entry["files"] if only is None else only).items() if v}
        if not folders:
            return self.spark.createDataFrame([], schema if not named else schema.add("__file", "string"))
        if not self.partition_by:
            return add(self.spark.read.schema(schema).parquet(*[f"{k}/{x}" for k, v in folders.items() for x in v]))
        parts = [add(self.spark.read.schema(schema).option("basePath", k).parquet(*[f"{k}/{x}" for x in v])) for k, v in folders.items()]
        return reduce(DataFrame.unionByName, parts)

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest()
        return self._frame(m if version is None else next(h for h in m["history"] if h["version"] == version))

    def create(self, rows: DataFrame) -> SnapshotTable:
        self.publish(rows, 0)
        return self

    def _stored(self, rows: DataFrame, version: int) -> tuple[str, list[str]]:
        folder = f"v{version}-{uuid.uuid4().hex[:8]}"
        writer = rows.write
        if self.partition_by:
            writer = writer.partitionBy(self.partition_by)
        writer.parquet(f"{self.path}/{folder}")
        return folder, self._store.files(f"{self.path}/{folder}")

    def _commit(self, files: dict[str, list[str]], schema: T.StructType, expected: int, new: str | None = None) -> int:
        before = self.manifest()
        if before["version"] != expected:
            if new:
                self._store.delete(f"{self.path}/{new}")
            raise Conflict(f"{self.path}: version {before['version']} is not the expected {expected}")
        entry = {"version": expected + 1, "files": {k: v for k, v in files.items() if v}, "schema": json.loads(schema.json())}
        self._store.replace(self._manifest, entry | {"history": [*before["history"], entry]})
        return expected + 1

    def publish(self, rows: DataFrame, expected: int) -> int:
        """Store ``rows`` as the whole version after ``expected``."""
        folder, files = self._stored(rows, expected + 1)
        return self._commit({folder: files}, rows.schema, expected, folder)

    def append(self, rows: DataFrame, expected: int) -> int:
        """The version after ``expected``: its rows and ``rows``; no file is rewritten."""
        m = self.manifest()
        folder, files = self._stored(rows, expected + 1)
        return self._commit(m["files"] | {folder: files}, rows.schema, expected, folder)

    def rewrite(self, hit: Callable[[T.StructType], Column], plan: Callable[[DataFrame], DataFrame], expected: int) -> int:
        """The version after ``expected``: ``plan`` of the rows of those files that hold a hit, and all others as they are.

        ``plan`` must leave rows that are no hit as they are, whatever else it is given.
        """
        m = self.manifest()
        df = self._frame(m)
        found = self._frame(m, named=True).filter(hit(df.schema)).select("__file").distinct().collect()  # as many as files
        held: dict[str, list[str]] = {}
        for path in (unquote(r[0]) for r in found):
            folder = next(k for k in m["files"] if f"/{k}/" in path)
            held.setdefault(folder, []).append(path.split(f"/{folder}/", 1)[1])
        if not any(held.values()):
            return self._commit(m["files"], df.schema, expected)
        rows = plan(self._frame(m, held))
        if rows.schema.fieldNames() != df.schema.fieldNames():  # a new column concerns all files
            return self.publish(plan(df), expected)
        folder, files = self._stored(rows, expected + 1)
        rest = {k: [x for x in v if x not in held.get(k, ())] for k, v in m["files"].items()}
        return self._commit(rest | {folder: files}, rows.schema, expected, folder)

    def compact(self) -> int:
        """All rows in one folder of evenly sized files, as a new version."""
        return self.publish(self.read(), self.version)

    def vacuum(self, keep: int = 2) -> int:
        """Delete the files of all versions but the last ``keep``; readers of those must be gone."""
        history = self.manifest()["history"]
        folders: Iterable[str] = dict.fromkeys(f for h in history[:-keep] for f in h["files"])
        live = {f: {x for h in history[-keep:] for x in h["files"].get(f, ())} for f in folders}
        gone = 0
        for folder, kept in live.items():
            if not self._store.exists(f"{self.path}/{folder}"):
                continue
            if not kept:
                self._store.delete(f"{self.path}/{folder}")
                gone += 1
                continue
            for x in self._store.files(f"{self.path}/{folder}"):
                if x not in kept:
                    self._store.delete(f"{self.path}/{folder}/{x}")
                    gone += 1
        return gone


class ParquetSink:
    """Archive target, one folder a batch.

    A batch written twice under one name is stored once.  With a ``key`` (``archive`` sets
    its table's), rows whose key is stored already replace the stored ones, so a run that is
    repeated after a failure neither loses nor doubles a row: the new batch is stored first,
    then the older batches that hold such keys are stored anew without them.
    """

    def __init__(self, path: str, key: str | None = None):
        self.path, self.key, self.flushed = path.rstrip("/"), key, 0

    def write(self, rows: DataFrame, batch: int | str = 0) -> None:
        store, name = Store(rows.sparkSession, self.path), f"batch={batch}"
        older = [b for b in self.batches(store) if b != name]
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        if not self.key or not older:
            return
        spark = rows.sparkSession
        keys = spark.read.parquet(f"{self.path}/{name}").select(self.key)
        stored = spark.read.parquet(*[f"{self.path}/{b}" for b in older])
        again = stored.select(self.key, F.regexp_extract(F.col("_metadata.file_path"), "/batch=([^/]+)/[^/]*$", 1).alias("__batch")).join(keys, self.key, "left_semi")
        for (b,) in again.select("__batch").distinct().collect():
            b = unquote(b)
            rest = f"batch={b}-{uuid.uuid4().hex[:8]}"
            spark.read.parquet(f"{self.path}/batch={b}").join(keys, self.key, "left_anti").write.parquet(f"{self.path}/{rest}")
            store.delete(f"{self.path}/batch={b}")

    def batches(self, store: Store) -> list[str]:
        if not store.exists(self.path):
            return []
        return sorted({x.split("/")[0] for x in store.files(self.path) if x.startswith("batch=")})

    def flush(self) -> None:
        self.flushed += 1


class AppendLog:
    """An append-only change log in parquet; sequence numbers are dealt by the driver in blocks.

    The last number stands in a small file of its own, raised before entries are stored, so
    no number is dealt twice.  Two writers at once: the second gets a conflict.
    """

    SCHEMA = "scope string, docId string, op string, version long, doc string, tenantId string, at timestamp, cursor string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._store = Store(spark, self.path)
        self._last, self._lock, self._old = f"{self.path}/_last.json", f"{self.path}/_lock", f"{self.path}.old"

    def _recover(self) -> None:
        """A prune that ended between its two renames is undone."""
        if not self._store.exists(self.path) and self._store.exists(self._old):
            self._store.rename(self._old, self.path)

    def read(self) -> DataFrame:
        self._recover()
        if not self._store.exists(self.path) or not self._store.files(self.path):
            return self.spark.createDataFrame([], T._parse_datatype_string(self.SCHEMA))
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def latest(self) -> str | None:
        self._recover()
        if self._store.exists(self._last):
            return self._store.read(self._last)["cursor"]
        return self.read().agg({"cursor": "max"}).first()[0]

    def _alone(self, body: Callable[[], str | None]) -> str | None:
        self._recover()
        if not self._store.claim(self._lock):
            raise Conflict(f"{self.path}: another writer is at work")
        try:
            return body()
        finally:
            self._store.delete(self._lock)

    def append(self, entries: list[dict]) -> str | None:
        from datetime import datetime, timezone

        if not entries:
            return self.latest()

        def store() -> str:
            start = int(self.latest() or 0)
            rows = []
            for i, e in enumerate(entries, start + 1):
                doc = json.dumps(e["doc"], sort_keys=True) if e.get("doc") is not None else None
                rows.append((e["scope"], e["docId"], e["op"], e.get("version"), doc, e.get("tenantId"), e.get("at") or datetime.now(timezone.utc), f"{i:020d}"))
            self._store.replace(self._last, {"cursor": rows[-1][-1]})
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
            return rows[-1][-1]

        return self._alone(store)

    def since(self, cursor: str | None, limit: int = 500, scope: str | None = None, tenant: str | None = None) -> dict:
        from ..operators.changes import since

        rows = since(self.read(), cursor, scope, tenant).limit(limit + 1).collect()
        page = rows[:limit]
        return {"entries": page, "cursor": page[-1]["cursor"] if page else cursor, "hasMore": len(rows) > limit}

    def prune(self, before: str) -> None:
        """Forget entries up to ``before``: the rest is stored beside the old, which goes last; numbers go on."""

        def store() -> None:
            new = f"{self.path}.new"
            self.read().filter(F.col("cursor") > before).write.mode("overwrite").parquet(new)
            self._store.replace(f"{new}/_last.json", {"cursor": self.latest()})
            self._store.claim(f"{new}/_lock")
            self._store.delete(self._old)
            self._store.fs.rename(self._store.hadoop.Path(self.path), self._store.hadoop.Path(self._old))
            self._store.fs.rename(self._store.hadoop.Path(new), self._store.hadoop.Path(self.path))
            self._store.delete(self._old)

        self._alone(store)
