"""Helpers shared by the operators: sizing, checkpoints, vectorised hashing, Arrow batches."""

from __future__ import annotations

import contextlib
import gc
import math
import os
import tempfile
import time

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers of the two independent polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Rows that one task may hold in any case; rows under one key from which it may be a hub; the most hubs that are told to all tasks.
FEW, HUB, HUBS = 10_000, 64, 100_000
#: Links that the driver joins itself (its Python holds them, some 50 MB); beyond, rounds of shuffles do.
FEW_LINKS = 100_000
#: Seconds between two calls to free unread shuffles.
CLEAN_EVERY = 4.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the plan's output (for files: their size)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, bytes_each: int, factor: int = 1) -> int:
    """Partitions that hold about ``bytes_each`` of input; never below the session's own number.

    Where Catalyst does not know the size, the texts' bytes are summed.
    """
    spark = df.sparkSession
    base = int(spark.conf.get("spark.sql.shuffle.partitions")) * factor
    size = input_bytes(df)
    if size >= 1 << 58:
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(base, min(size // bytes_each, 200_000))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may go without one (a temp folder then)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "loomsheet-checkpoints")


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """The folder is deleted when the driver's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def trim(spark: SparkSession) -> None:
    """The driver's JVM gives freed native memory back to the system, where it can (Linux, from 17.0.9 on)."""
    java, array = spark._jvm.java.lang, spark.sparkContext._gateway.new_array
    kinds, given = array(java.Class, 4), array(java.Object, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = java.Class.forName(name)
    given[0], given[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with contextlib.suppress(Py4JJavaError):  # no such command
        java.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(java.management.ManagementFactory.getPlatformMBeanServer(), given)


_cleaned = 0.0


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder named by the session; what was written goes when the driver ends."""
    global _cleaned
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
        forget_at_exit(spark, sc._jsc.sc().getCheckpointDir().get())
    out = df.checkpoint(eager=True)
    if time.monotonic() - _cleaned > CLEAN_EVERY:
        # shuffles and checkpoints that nothing reads any more go now, not when the driver next needs memory
        gc.collect()
        sc._jvm.System.gc()
        trim(spark)
        _cleaned = time.monotonic()
    return out


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches of whole texts small; only ever lowers the session's setting."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def held_out(col="doc_id"):
    """The fixed fold: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def within_bytes(rows: DataFrame, most: int, *order) -> DataFrame:
    """The first of a bounded number of rows, in this order, whose texts together hold ``most`` bytes at most."""
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("__bytes", size).filter(F.col("__bytes") <= most).drop("__bytes")


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Rabin-Karp hashes modulo 2**64 of every window of a token array, by prefix sums.

    Tokens are 64-bit values.  Bases are odd, hence invertible, so the hash of tokens
    [i, i+k) is (prefix[i+k] - prefix[i]) * base**-i, free of its position.
    """

    def __init__(self, base: int = BASES[0]):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0
        self.grow(1 << 14)

    def grow(self, n: int) -> None:
        if n > self.n:
            n = max(n, 2 * self.n)
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(n, b, U64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=U64))
            self.n = n

    def prefix(self, tokens: np.ndarray) -> np.ndarray:
        self.grow(len(tokens) + 1)
        out = np.zeros(len(tokens) + 1, U64)
        np.cumsum(tokens * self.up[: len(tokens)], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, k: int) -> np.ndarray:
        n = len(prefix) - k
        return (prefix[k:] - prefix[:-k]) * self.down[:n] if n > 0 else np.empty(0, U64)

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, in log2(w) vector passes."""
    if len(a) < w:
        return a[:0]
    span = 1
    while span * 2 <= w:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (w - span)], a[w - span :]) if span < w else a


class WordHashes(dict):
    """Memo of 64-bit word hashes; emptied when full, so its memory is bounded."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        import xxhash

        self.limit, self.hash = limit, xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        v = self[word] = self.hash(word)
        return v

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's values as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def chunks_by_size(texts: list[bytes], limit: int = 2_000_000):
    """Index ranges of about ``limit`` bytes, one long text at least."""
    i, n = 0, 0
    for j, x in enumerate(texts):
        if n and n + len(x) > limit:
            yield i, j
            i, n = j, 0
        n += len(x)
    if i < len(texts):
        yield i, len(texts)


def carried(columns: list[str]) -> Column:
    """The columns in one struct, after a null of a name that none of them has: their names cannot clash with others."""
    free = "_"
    while free in columns:
        free += "_"
    return F.struct(F.lit(None).cast("string").alias(free), *[F.col("`" + c.replace("`", "``") + "`") for c in columns])


def hub_join(df: DataFrame, values: DataFrame, key: str | list[str], n: int, spread: str, how: str = "inner", counted: str | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``df`` (of about n rows) joined with ``values`` (one row a key); the rows of one key go to many tasks.

    A hub, a key of more than one ``HUBS``-th of the rows (and ``HUB``), is dealt by the column
    ``spread`` to as many parts as it holds that many rows, and its value to each of them.
    Only the hubs' keys and parts are broadcast: ``HUBS`` rows at most, whatever the values.
    ``counted`` names the column of ``values`` that holds each key's rows, if one does;
    ``counts`` gives them (``__n``) where counting ``df`` itself costs more.
    """
    key = [key] if isinstance(key, str) else key
    if n <= FEW:
        return df.join(values, key, how)
    many = max(HUB, math.ceil(n / HUBS))
    if counts is None:
        counts = values.select(*key, F.col(counted).alias("__n")) if counted else df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    hubs = F.broadcast(counts.filter(F.col("__n") > many).select(*key, F.ceil(F.col("__n") / many).cast("int").alias("__parts")))
    dealt = df.join(hubs, key, "left").withColumn("__part", F.pmod(F.xxhash64(spread), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    return dealt.join(values.join(hubs, key, "left").withColumn("__part", parts).drop("__parts"), [*key, "__part"], how).drop("__part")


def with_least(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """``df`` (of about n rows) with ``m``, the least ``value`` of the row's ``key``; as in ``hub_join``."""
    least = df.groupBy(key).agg(F.min(value).alias("m"), F.count(F.lit(1)).alias("__n"))
    if n <= FEW:
        return df.join(least.drop("__n"), key)
    many = max(HUB, math.ceil(n / HUBS))
    hubs = F.broadcast(least.filter(F.col("__n") > many).drop("__n"))  # HUBS rows at most
    rest = df.join(hubs, key, "left_anti").join(least.filter(F.col("__n") <= many).drop("__n"), key)
    return df.join(hubs, key).unionByName(rest)


def hashable(x):
    """The value in a form that can be hashed and has Spark's order: structs and arrays as tuples, nulls in them first, NaN last."""
    if isinstance(x, (dict, list)):
        return tuple((v is not None, hashable(v)) for v in (x.values() if isinstance(x, dict) else x))
    return (x != x, 0.0 if x != x else x) if isinstance(x, float) else x


def joined(links: pa.Table) -> pa.Table:
    """(node, component = least node) of the links (u, v)."""
    ends = pa.concat_arrays([*links["u"].chunks, *links["v"].chunks])
    names = lambda: (hashable(x) for i in range(0, len(ends), FEW) for x in ends.slice(i, FEW).to_pylist())
    number = {x: i for i, x in enumerate(sorted(set(names())))}
    at = [number[x] for x in names()]
    root = list(range(len(number)))

    def find(i: int) -> int:
        while (up := root[i]) != i:
            root[i] = i = root[up]
        return i

    for u, v in zip(at[: len(links)], at[len(links) :], strict=True):
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    place = {n: i for i, n in enumerate(at)}
    return pa.table({c: ends.take(pa.array([place[n] for n in of], pa.int64())) for c, of in (("node", range(len(root))), ("component", map(find, range(len(root)))))})


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components (node, component = least node) of undirected links.

    Few links (``FEW_LINKS``) are joined on the driver, since each round is some twenty
    shuffles however small.  Beyond, large-star and small-star steps alternate; every step is a shuffle of at most the
    links, aggregated by minimum before it, and the links of a hub of any degree stay
    spread over all tasks.  Each round is checkpointed to the shared folder.  Nodes without
    links are absent.  Nodes may be of any type that has an order.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u is not null and u < v").distinct()
    e = checkpoint(e)
    state = lambda: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    last = state()
    if 0 < last[0] <= FEW_LINKS:
        return e.sparkSession.createDataFrame(joined(e.select("u", "v").toArrow()))
    for _ in range(rounds if last[0] else 0):
        # large star: neighbours above a node move to its least neighbour
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        large = with_least(both, "u", "v", 2 * last[0]).filter("v > u").select(F.least("u", "m").alias("u"), "v").filter("u < v").distinct()
        # small star: neighbours below a node, and the node, move to the least of them
        j = with_least(large, "v", "u", last[0])
        small = j.select(F.col("m").alias("u"), F.col("u").alias("v")).union(j.select(F.col("m").alias("u"), "v"))
        e = checkpoint(small.filter("u < v").distinct())
        now = state()
        if now == last:
            break
        last = now
    else:
        if last[0]:
            raise RuntimeError("components did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)
