"""Near-duplicate vectors by collision-counting projections.

Vectors of one label are projected on random lines.  The signs on the first lines deal them
to cells, in several tables, so that a pair at the threshold shares a cell of some table
with the asked recall.  Within a cell the projections on one line are sorted; the window
around each vector there gives its candidates, and the windows on all other lines are
counted per candidate pair.  Pairs that reach the count are verified by their cosine in
double precision.  The widths, the count and the number of tables are calibrated from the
threshold and the recall alone; the table's size only sets how fine the cells are, so the
pairs looked at for each vector stay about as many at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import checkpoint, components, table

COSINE, RECALL, LINES, BLOCK = 0.98, 0.999, 16, 512
#: Vectors that a cell of evenly spread vectors holds, the most signs that name a cell, and the share of misses on a counted line.
CELL, MOST_SIGNS, MISS = 256, 48, 0.05
#: Rows and candidate pairs that a task holds at once; cells (in rows) that are told to all tasks.
HELD, PAIRS, TOLD = 8192, 1 << 19, 100_000


def half_width(cosine: float, miss: float) -> float:
    """h such that a pair at the threshold misses one line with probability ``miss`` (normal quantile by bisection)."""
    apart = math.sqrt(2 - 2 * cosine)
    lo, hi = 0.0, 10.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erfc(mid / math.sqrt(2)) > miss else (lo, mid)
    return hi * apart


def least_count(lines: int, miss: float, lost: float) -> int:
    """The greatest count that a pair at the threshold falls short of with probability ``lost`` at most."""
    below = 0.0
    for c in range(lines + 1):
        below += math.comb(lines, c) * (1 - miss) ** c * miss ** (lines - c)
        if below > lost:
            return c
    return lines


def tables_for(cosine: float, signs: int, lost: float) -> int:
    """Tables after which a pair at the threshold has shared no cell with probability ``lost`` at most."""
    together = (1 - math.acos(cosine) / math.pi) ** signs
    return 1 if together >= 1 else max(1, math.ceil(math.log(lost) / math.log(1 - together)))


def directions(dim: int, lines: int, seed: int = 12) -> np.ndarray:
    return np.random.default_rng((seed, dim)).standard_normal((dim, lines))


def cell_codes(v: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """One code per vector and table: the signs of its projections. Fewer signs are a start of more."""
    out = np.zeros((len(v), tables), np.int64)
    for t in range(tables):
        lines = np.random.default_rng((11, v.shape[1], t)).standard_normal((MOST_SIGNS, v.shape[1]))[:signs].T
        out[:, t] = (v @ lines > 0) @ (1 << np.arange(signs, dtype=np.int64))
    return out


def unit(vectors: list[bytes], kind: type) -> np.ndarray:
    v = np.stack([np.frombuffer(x, kind) for x in vectors]).astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def window_pairs(group: np.ndarray, along: np.ndarray, h: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (positions) of one group whose places on a line are within h: each vector's window in the sorted line."""
    wide = 2 * (np.abs(along).max() + h) + 1
    key = group * wide + along
    order = np.argsort(key, kind="stable")
    key = key[order]
    ahead = np.searchsorted(key, key + h, "right") - np.arange(len(key)) - 1
    ends = np.cumsum(ahead)
    a = 0
    while a < len(key):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        n = ahead[a:b]
        i = np.repeat(np.arange(a, b), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        if len(i):
            yield order[i], order[j]
        a = b


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For n positions the least that each reaches by the links."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[i], root[j])
        for at in (i, j, root[i], root[j]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_links(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, lines: int = LINES, block: int = BLOCK, grid: int | None = None) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Identical vectors of one label are compared once and count with their vec_ids.  Vectors
    without a label, null, zero, empty, or with a null or non-finite component link with
    nothing; so do vectors of different length, and rows with a null vec_id (their component
    is null and they are kept).  A row that repeats both vec_id and vector is that vector
    again and no link of it; different vectors under one vec_id are vectors of their own,
    each with its links, and a link of both counts twice.  Very long vectors need memory
    for ``HELD`` of them.  Other columns are not read, so their names cannot clash.  An
    empty table gives no rows.  Only the number of signs (``grid``) follows from the
    table's size.  Cells beyond ``block`` rows are split; every two of their blocks meet in
    one task.
    """
    rows = vectors.select("vec_id", "label", "embedding")
    single = dict(rows.dtypes)["embedding"] == "array<float>"
    kind = np.float32 if single else np.float64
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    length2 = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & (length2 > 0), F.lit(False))
    keyed = rows.withColumn("k1", F.when(fit, F.xxhash64("label", "embedding"))).withColumn("k2", F.when(fit, F.xxhash64(F.lit(1), "embedding", "label")))
    # a vector is named by its least vec_id and its hash, in this order: components take the least
    classes = checkpoint(
        keyed.filter("k1 is not null")
        .groupBy("k1", "k2", "vec_id")
        .agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        .groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    )
    if grid is None:
        largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        grid = max(0, min(MOST_SIGNS, math.ceil(math.log2(max(1, largest / CELL)))))
    tables = tables_for(cosine, grid, (1 - recall) / 2)
    first_h, h = half_width(cosine, (1 - recall) / 4), half_width(cosine, MISS)
    need = least_count(lines, MISS, (1 - recall) / 4)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "rep", "k1", "copies", "dim", "vector", "codes"]
        for batch in batches:
            raw = [np.asarray(v.values.to_numpy(zero_copy_only=False), kind).tobytes() for v in batch.column("embedding")]
            dim = np.asarray([len(x) // np.dtype(kind).itemsize for x in raw])
            codes = np.zeros((len(raw), tables), np.int64)
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                codes[at] = cell_codes(unit([raw[i] for i in at.tolist()], kind), grid, tables)
            offsets = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * tables)
            own = [batch.column(c) for c in ("label", "rep", "k1", "copies")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(dim.astype(np.int32)), pa.array(raw, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(codes.reshape(-1)))], names=names)

    label_type = dict(classes.dtypes)["label"]
    coded = classes.select("label", "rep", "k1", "copies", "embedding").mapInArrow(code, f"label {label_type}, rep long, k1 long, copies long, dim int, vector binary, codes array<long>")
    dealt = coded.select("label", "rep", "k1", "copies", "dim", "vector", F.posexplode("codes").alias("t", "code"))
    dealt = dealt.withColumn("cell", F.xxhash64("label", "dim", "t", "code")).drop("code")
    # cells that are too large for one task; all others stay whole
    large = checkpoint(dealt.groupBy("cell").count().filter(F.col("count") > block).select("cell", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    n_large = large.count()
    if n_large <= TOLD:
        placed = dealt.join(F.broadcast(large), "cell", "left")  # TOLD rows at most
    else:
        placed = dealt.withColumn("salt", F.pmod(F.hash("rep", "k1"), F.lit(16)))
        placed = placed.join(large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["cell", "salt"], "left").drop("salt")
    placed = placed.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("k1", "rep"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "label", "t", "rep", "k1", "copies", "dim", "vector")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def settle(t: pa.Table) -> pa.RecordBatch:
            get = lambda c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
            rep, k1, copies, own, at_table, dim = map(get, ("rep", "k1", "copies", "own", "t", "dim"))
            label = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
            cell, a, b = get("cell"), get("a"), get("b")
            new = np.ones(len(cell), bool)
            new[1:] = (cell[1:] != cell[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            group, within = np.cumsum(new) - 1, a == b
            raw = t.column("vector").to_pylist()
            links = [(np.empty(0, np.int64),) * 2]
            for d in np.unique(dim).tolist():
                rows_d = np.flatnonzero(dim == d)
                v = unit([raw[i] for i in rows_d.tolist()], kind)
                at = v @ directions(d, lines + 1)
                for i, j in window_pairs(group[rows_d], at[:, 0], first_h):
                    p, q = rows_d[i], rows_d[j]
                    # of two blocks that meet only the pairs across; hashes of cells may clash over labels
                    ok = (within[p] | (own[p] != own[q])) & (label[p] == label[q])
                    i, j = i[ok], j[ok]
                    misses = np.zeros(len(i), np.int8)
                    for line in range(1, lines + 1):
                        misses += np.abs(at[i, line] - at[j, line]) > h
                        if line > lines - need:
                            ok = misses <= lines - need
                            i, j, misses = i[ok], j[ok], misses[ok]
                    for s in range(0, len(i), 1 << 15):
                        x, y = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
                        ok = np.einsum("ij,ij->i", v[x], v[y]) >= cosine
                        x, y = x[ok], y[ok]
                        if len(x):
                            # a pair is counted in the first table that brings it together
                            used, back = np.unique(np.concatenate((x, y)), return_inverse=True)
                            codes = cell_codes(v[used], grid, int(at_table[rows_d[x]].max()) + 1)
                            same = codes[back[: len(x)]] == codes[back[len(x) :]]
                            ok = same.argmax(1) == at_table[rows_d[x]]
                            links.append((rows_d[x[ok]], rows_d[y[ok]]))
            i, j = (np.concatenate(x) for x in zip(*links, strict=True))
            n = np.bincount(i, copies[j], len(rep)).astype(np.int64) + np.bincount(j, copies[i], len(rep)).astype(np.int64)
            root = spanning(i, j, len(rep))
            some = n > 0
            cols = (rep[some], k1[some], n[some], rep[root[some]], k1[root[some]])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["rep", "k1", "n", "rep_to", "k1_to"])

        def whole(t: pa.Table, last: bool) -> tuple[pa.Table, pa.Table]:
            """The rows of finished groups, and those of the group that may go on."""
            if last or not len(t):
                return t, t.slice(len(t))
            keys = [t.column(c).to_numpy() for c in ("cell", "a", "b")]
            same = np.all([k == k[-1] for k in keys], axis=0)
            cut = len(t) - int(np.argmin(same[::-1])) if not same.all() else 0
            return t.slice(0, cut), t.slice(cut)

        for batch in batches:
            kept.append(batch)
            if sum(map(len, kept)) >= HELD:
                done, rest = whole(pa.Table.from_batches(kept), False)
                if len(done):
                    yield settle(done.combine_chunks())
                    kept = rest.to_batches()
        if kept and (t := pa.Table.from_batches(kept)).num_rows:
            yield settle(t.combine_chunks())

    sorted_ = met.repartition("cell", "a", "b").sortWithinPartitions("cell", "a", "b")
    found = checkpoint(sorted_.mapInArrow(count, "rep long, k1 long, n long, rep_to long, k1_to long"))
    linked = found.groupBy("rep", "k1").agg(F.sum("n").alias("n"))
    ends = found.select(F.struct("rep", "k1").alias("a"), F.struct(F.col("rep_to").alias("rep"), F.col("k1_to").alias("k1")).alias("b"))
    roots = components(ends).select("node.rep", "node.k1", F.col("component.rep").alias("component"))
    stats = classes.select("k1", "k2", "rep", "copies").join(linked, ["rep", "k1"], "left").join(roots, ["rep", "k1"], "left")
    stats = stats.select("k1", "k2", "copies", "n", F.coalesce("component", "rep").alias("component"))
    out = keyed.select("vec_id", "k1", "k2").join(stats, ["k1", "k2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


#: For tables without repeated vec_ids.
OP5_SQL = f"""
with recursive e as (select vec_id, label, embedding::double[] as v from embeddings),
    good as (select * from e where label is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(v, lambda x: x * x)) > 0),
    link as (select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id where list_cosine_similarity(a.v, b.v) >= {COSINE}),
    reach as (select vec_id as a, vec_id as b from e union select reach.a, link.b from reach join link on reach.b = link.a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from e left join (select a as vec_id, count(*) as n from link group by a) using (vec_id) join (select a as vec_id, min(b) as component_id from reach group by a) using (vec_id)"""


def op5_collision_counting_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_links(table(spark, sf_dir, "embeddings"))
