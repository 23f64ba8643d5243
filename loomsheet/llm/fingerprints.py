"""Winnowed document fingerprints, and their likeness under edits.

Rolling k-gram hashes over code points; in every window of ``w`` consecutive hashes the
least is kept, the rightmost of ties.  Any shared run of at least w + k - 1 code points
therefore yields a common hash, and its kept positions tell where.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BASES, U64, Rolling, input_bytes, mix64, partitions_for, sliding_min, small_batches, table

K, W = 8, 16
#: Ids drawn for each bucket to place its end.
POINTS = 50
SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
LOWEST = -(1 << 63)


def winnow(text: str, rolling: Rolling, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hashes, positions), by position. A text below k code points is one gram; an empty one none."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(a):
        return a, a
    tokens = mix64(a.astype(U64) + U64(1))
    h = mix64(rolling.windows(rolling.prefix(tokens), min(k, len(a)))) >> U64(32)
    # the low half counts down, so of equal hashes the rightmost is least
    key = (h << U64(32)) | (U64(0xFFFFFFFF) - np.arange(len(h), dtype=U64))
    low = sliding_min(key, min(w, len(key)))
    low = low[np.concatenate(([True], low[1:] != low[:-1]))]
    return (low >> U64(32)).astype(np.uint32), (U64(0xFFFFFFFF) - (low & U64(0xFFFFFFFF))).astype(np.uint32)


def as_string(fp: tuple[np.ndarray, np.ndarray]) -> str:
    """``hash:position`` in hexadecimal, comma-joined, by position."""
    return ",".join(map("%x:%x".__mod__, zip(fp[0].tolist(), fp[1].tolist(), strict=True)))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted sets of distinct hashes; two empty sets are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint_with_edits(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every whole text and of its edited text (its end replaced by the next text's start).

    One shuffle of the texts: rows go to buckets of consecutive ids; the first row of each
    bucket is sent to the bucket before it too, so each task streams its sorted rows and
    holds two texts at a time.  Null text is empty; a null doc_id sorts first; rows of equal
    doc_id sort by text; a single document is followed by itself; an empty table stays empty.
    Equal hashes of one window: the rightmost holds.  Repeated rows are answered each, the
    first followed by the second.  Other columns are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    n = partitions_for(docs, 4 << 20, factor=8)
    ids = docs.select(F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_id"))
    # ids are drawn in proportion to their texts' bytes, so that buckets are of even size, not of even rows;
    # only where buckets end depends on the draw
    size = input_bytes(docs)
    rate = POINTS * n / max(1, size if size < 1 << 58 else docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    share = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    drawn = docs.filter(share < (F.coalesce(F.octet_length("text"), F.lit(0)) + 64) * rate).select(F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_id"))
    cuts = drawn.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n))
    cuts = np.unique(np.asarray([int(x) for x in cuts], np.int64))

    def bucket_of(values: np.ndarray) -> np.ndarray:
        return np.searchsorted(cuts, values, side="right")

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            v = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for b, x in zip(bucket_of(v).tolist(), v.tolist(), strict=True):
                if x < found.get(b, 1 << 63):
                    found[b] = x
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["bucket", "first"]
        )

    # one row per bucket and input split, then one per bucket
    firsts = sorted(
        tuple(r) for r in ids.mapInArrow(lowest, "bucket long, first long").groupBy("bucket").agg(F.min("first")).collect()
    )
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "ahead", "key", "doc_id", "text"]
        for batch in batches:
            key = batch.column("doc_id").fill_null(LOWEST)
            v = key.to_numpy(zero_copy_only=False)
            own = [pa.array(bucket_of(v)), pa.array(np.zeros(len(v), bool)), key, batch.column("doc_id"), batch.column("text")]
            yield pa.RecordBatch.from_arrays(own, names=names)
            again = [(i, before[x]) for i, x in enumerate(v.tolist()) if x in before]
            if again:
                at = pa.array([i for i, _ in again])
                cols = [pa.array([b for _, b in again], pa.int64()), pa.array([True] * len(again)), *(x.take(at) for x in own[2:])]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, held, skip, rows = Rolling(), None, None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 7
            rows.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("bucket", "ahead", "doc_id", "text"))
            for bucket, ahead, doc, text in zip(*cols, strict=True):
                if bucket == skip:  # a further row of the id that stood ahead
                    continue
                text = text or ""
                fp = winnow(text, rolling, k, w)
                hashes = np.unique(fp[0])
                if held:
                    _, d, t, f, own = held
                    cut = len(t) // 4
                    new = t[: len(t) - cut] + text[:cut]
                    g = winnow(new, rolling, k, w)
                    sha = hashlib.sha256(new.encode()).hexdigest()
                    rows.append((d, len(t), sha, as_string(f), as_string(g), likeness(own, np.unique(g[0])), likeness(own, hashes)))
                held = None if ahead else (bucket, doc, text, fp, hashes)
                skip = bucket if ahead else None
                if len(rows) >= 256:
                    yield flush()
        yield flush()

    routed = docs.mapInArrow(route, "bucket long, ahead boolean, key long, doc_id long, text string")
    dealt = routed.repartition(max(1, n // 8), "bucket").sortWithinPartitions("bucket", "ahead", "key", "text")
    return dealt.mapInArrow(stream, SCHEMA)


def _mixed(name: str, source: str, keep: str) -> str:
    """CTEs that add ``x``: ``mix64`` of the column ``y`` (unsigned, modulo 2**64)."""
    times = lambda c: f"((x::uhugeint * {c}::uhugeint) % 18446744073709551616::uhugeint)::ubigint"
    return f"""{name}_a as (select {keep}, xor(y, y >> 30) as x from {source}),
    {name}_b as (select {keep}, {times(0xBF58476D1CE4E5B9)} as x from {name}_a),
    {name}_c as (select {keep}, xor(x, x >> 27) as x from {name}_b),
    {name}_d as (select {keep}, {times(0x94D049BB133111EB)} as x from {name}_c),
    {name} as (select {keep}, xor(x, x >> 31) as x from {name}_d)"""


def _sql() -> str:
    ahead = "partition by doc_id, side order by i"
    terms = " + ".join(f"(coalesce(lead(x, {j}) over ({ahead}), 0)::uhugeint * {pow(BASES[0], j, 1 << 64)}::uhugeint) % 18446744073709551616::uhugeint" for j in range(K))
    like = lambda a, b, c: f"case when {a} + {b} = 0 then 1.0::double else {c}::double / ({a} + {b} - {c}) end"
    return f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
    n as (select doc_id, text, length(text) as n, coalesce(lead(doc_id) over (order by doc_id), min(doc_id) over ()) as next from t),
    d as (select n.doc_id, n.text, n.n, next, substr(n.text, 1, n.n - n.n // 4) || substr(m.text, 1, n.n // 4) as edited from n join t m on m.doc_id = n.next),
    u as (select doc_id, 0 as side, text from d union all select doc_id, 1, edited from d),
    c as (select doc_id, side, len(p) as n, unnest(p) as ch, unnest(range(0, len(p))) as i from (select doc_id, side, regexp_extract_all(text, '(?s).') as p from u)),
    point as (select distinct ch, (unicode(ch) + 1)::ubigint as y from c),
    {_mixed("token", "point", "ch")},
    gram as (select doc_id, side, n, i, (({terms}) % 18446744073709551616::uhugeint)::ubigint as y from c join token using (ch)),
    whole as (select doc_id, side, greatest(n - {K} + 1, 1) as grams, i, y from gram where i <= greatest(n - {K}, 0)),
    {_mixed("hash", "whole", "doc_id, side, grams, i")},
    low as (select doc_id, side, grams, i, min(((x >> 32) << 32) | (4294967295 - i)::ubigint) over ({ahead} rows between current row and {W - 1} following) as least from hash),
    kept as (select distinct doc_id, side, least >> 32 as h, 4294967295 - (least & 4294967295::ubigint) as pos from low where i <= grams - least({W}, grams)),
    print as (select doc_id, side, string_agg(format('{{:x}}:{{:x}}', h, pos), ',' order by pos) as fp from kept group by 1, 2),
    one as (select distinct doc_id, side, h from kept),
    size as (select doc_id, side, count(*) as n from one group by 1, 2),
    with_edited as (select a.doc_id, count(*) as n from one a join one b on a.doc_id = b.doc_id and a.h = b.h where a.side = 0 and b.side = 1 group by 1),
    with_next as (select d.doc_id, count(*) as n from d join one a on a.doc_id = d.doc_id and a.side = 0 join one b on b.doc_id = d.next and b.side = 0 and b.h = a.h group by 1)
select d.doc_id, d.n as n_chars, sha256(edited) as edited_sha256, coalesce(p.fp, '') as fingerprint, coalesce(q.fp, '') as edited_fingerprint,
    {like("coalesce(s0.n, 0)", "coalesce(s1.n, 0)", "coalesce(we.n, 0)")} as near_edited, {like("coalesce(s0.n, 0)", "coalesce(s2.n, 0)", "coalesce(wn.n, 0)")} as near_next
from d left join print p on p.doc_id = d.doc_id and p.side = 0 left join print q on q.doc_id = d.doc_id and q.side = 1
    left join size s0 on s0.doc_id = d.doc_id and s0.side = 0 left join size s1 on s1.doc_id = d.doc_id and s1.side = 1 left join size s2 on s2.doc_id = d.next and s2.side = 0
    left join with_edited we on we.doc_id = d.doc_id left join with_next wn on wn.doc_id = d.doc_id"""


#: For tables without null or repeated doc_ids.
OP3_SQL = _sql()


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_with_edits(table(spark, sf_dir, "documents"))
