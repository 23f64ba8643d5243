"""Near-duplicate documents by BagMinHash signatures, banding, and verified multiset overlap.

A document is the multiset of its five-word shingles.  Every shingle carries Poisson
processes over its discretised weight: one on [0, 1) and, for each doubling, one on
[2**(j-1), 2**j).  A point has a time, a signature component and a place in its interval;
it counts if that place lies below the shingle's count.  The least time per component is
the signature: two signatures agree in a component with probability equal to the weighted
Jaccard similarity of the multisets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import U64, Rolling, carried, checkpoint, chunks_by_size, components, hub_join, mix64, small_batches, table, text_bytes
from .repeats import WordTokens

SHINGLE, SIMILARITY, BANDS, ROWS, BLOCK = 5, 0.8, 25, 5, 512
#: Compressed bytes of texts in a block.
BLOCK_BYTES = 16 << 20


class Shingles:
    """Multisets of word shingles. A text of fewer words is one shingle; one without words has none."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.tokens, self.rolling = size, WordTokens(), Rolling()

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text's index, shingle hash, count), sorted by both."""
        tokens, ends = self.tokens.of(texts)
        begin = np.concatenate(([0], ends[:-1]))
        many = np.where(ends > begin, np.maximum(ends - begin - self.size + 1, 1), 0)
        doc = np.repeat(np.arange(len(texts)), many)
        start = begin[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        stop = np.minimum(start + self.size, ends[doc])
        h = mix64(self.rolling.spans(self.rolling.prefix(tokens), start, stop) + (stop - start).astype(U64))
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        first = np.flatnonzero(new)
        return doc[first], h[first], np.diff(np.append(first, len(doc)))


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, m: int) -> np.ndarray:
    """n x m least times; rows of documents without shingles stay infinite."""
    sig = np.full(n * m, np.inf)
    # an interval of the weight axis for each shingle and doubling its count reaches into
    parts, j = [(np.arange(len(doc)), 0, 1)], 1
    while (some := np.flatnonzero(count > 1 << (j - 1))).size:
        parts.append((some, 1 << (j - 1), 1 << (j - 1)))
        j += 1
    at = np.concatenate([p[0] for p in parts])
    low = np.concatenate([np.full(len(p[0]), p[1], np.int64) for p in parts])
    width = np.concatenate([np.full(len(p[0]), p[2], np.int64) for p in parts])
    d, weight = doc[at], count[at]
    seed = mix64(shingle[at] + mix64(low.astype(U64) + U64(77)))
    time, limit, r = np.zeros(len(at)), np.full(n, np.inf), 0
    while len(d):
        r += 1
        x = mix64(seed + U64(r * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log(((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        y = mix64(x)
        place = low + ((y >> U64(32)) * width.astype(U64) >> U64(32)).astype(np.int64)
        hit = place < weight
        np.minimum.at(sig, d[hit] * m + ((y & U64(0xFFFFFFFF)) % U64(m)).astype(np.int64)[hit], time[hit])
        # a full signature ends the processes that are beyond its greatest time
        limit = sig.reshape(n, m).max(1)
        on = time < limit[d]
        d, weight, seed, time, low, width = (v[on] for v in (d, weight, seed, time, low, width))
    return sig.reshape(n, m)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sig.view(U64).reshape(len(sig), bands, rows)
    h = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=U64)), (len(sig), bands))
    for i in range(rows):
        h = mix64(h * U64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return h


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets (sorted hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - low
    return low / total if total else 0.0


def compared(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The n pairs (a, b) with ``sim``, the weighted Jaccard of their texts' shingle multisets.

    ``texts``: (node, z), the compressed text.  ``b`` may be in very many pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held = Shingles(), (None, None)

        def split(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
            doc, h, c = shingles.of(texts)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
            return [(h[i:j], c[i:j]) for i, j in zip(cut, cut[1:], strict=False)]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = ([zstandard.decompress(x) for x in batch.column(c).to_pylist()] for c in ("za", "zb"))
            sim = []
            for i, j in chunks_by_size(ta):
                for k, mine in enumerate(split(ta[i:j]), i):
                    if held[0] != b[k]:  # rows come sorted by b
                        held = (b[k], split(tb[k : k + 1])[0])
                    sim.append(similarity(mine, held[1]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sim, pa.float64())], names=["a", "b", "sim"])

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("z").alias("za")), "a")
    both = hub_join(both, texts.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b", n, "a", counts=pairs.groupBy("b").agg(F.count(F.lit(1)).alias("__n")))
    return both.sortWithinPartitions("b").select("a", "b", "za", "zb").mapInArrow(run, "a long, b long, sim double")


def block_links(own: DataFrame, cross: DataFrame, texts: DataFrame, n: int, least: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between parts that ``cross`` holds alike but no link connects yet.

    ``own``: (node, part) of all n nodes.  The nodes of a group of parts are dealt to
    blocks of bounded rows and bytes; a task gets two blocks and computes all overlaps
    between their multisets, of which only links that connect come out.
    """
    groups = components(cross).select(F.col("node").alias("part"), F.col("component").alias("group"))
    placed = checkpoint(hub_join(own, groups, "part", n, "node").join(texts, "node"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum(F.length("z")) / BLOCK_BYTES)).cast("int")
    sizes = placed.groupBy("group").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("nodes"))
    placed = hub_join(placed, sizes, "group", n, "node", counted="nodes").drop("nodes")
    placed = placed.withColumn("own", F.pmod(F.when(F.col("blocks") > 1, F.hash("node")).otherwise(0), F.col("blocks")))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.select("group", "own", each.alias("other"), "node", "part", "z")
    dealt = dealt.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "part", "z")

    def span(t: pa.Table) -> pa.Table:
        node, part = t.column("node").to_numpy(), t.column("part").to_numpy()
        root = part.copy()
        if (part != part[0]).any():
            doc, h, c = Shingles().of([zstandard.decompress(x) for x in t.column("z").to_pylist()])
            # a shingle that stands k times is k elements
            again = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            element, owner = mix64(np.repeat(h, c) + mix64(again.astype(U64))), np.repeat(doc, c)
            weight = np.bincount(owner, minlength=len(node))
            values, at, n = np.unique(element, return_inverse=True, return_counts=True)
            shared = n > 1
            column = np.cumsum(shared) - 1
            keep = shared[at]
            owner, at = owner[keep], column[at[keep]]
            order = np.argsort(at, kind="stable")
            owner, at = owner[order], at[order]
            both = np.zeros((len(node), len(node)), np.float32)
            for low in range(0, int(shared.sum()), 4096):
                s = slice(*np.searchsorted(at, (low, low + 4096)))
                x = np.zeros((len(node), 4096), np.float32)
                x[owner[s], at[s] - low] = 1
                both += x @ x.T
            link = both >= least * (weight[:, None] + weight[None, :] - both) - 1e-3
            exact = link & (both > 0)
            a, b = np.nonzero(exact & (part[:, None] != part[None, :]))
            fits = both[a, b].astype(np.float64) / (weight[a] + weight[b] - both[a, b].astype(np.float64)) >= least
            a, b = a[fits], b[fits]
            while True:  # least part that each part reaches
                new = root.copy()
                np.minimum.at(new, a, root[b])
                by_part = {}
                for p, r in zip(part.tolist(), new.tolist(), strict=True):
                    by_part[p] = min(r, by_part.get(p, r))
                new = np.asarray([by_part[p] for p in part.tolist()])
                if (new == root).all():
                    break
                root = new
        moved = root != part
        return pa.table({"a": part[moved], "b": root[moved]})

    # dealt by block pair, or the partitioning by group would be kept
    return dealt.repartition("group", "i", "j").groupBy("group", "i", "j").applyInArrow(span, "a long, b long").distinct()


def near_classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, settle: float = 0.6, rounds: int = 2) -> DataFrame:
    """Per document: doc_id, class_id (least doc_id of its class), copies (documents of the same text), kept.

    Classes are the components of all candidate pairs that verify.  Equal texts are one node.
    In each bucket all nodes are held against the least, its leader; those less alike than
    ``settle`` are held against the least of themselves, for a few ``rounds``; nodes left
    then stay together.  1 - Jaccard is a metric:
    of two nodes that link, when the first settles with a leader the other is at least
    ``settle`` - (1 - ``least``) like it.  So the components of the pairs that are that alike, or left
    together, hold every link; where those lead from one part of what the links found connect to another, the parts are compared in blocks
    of bounded size, by matrix products, of which only spanning links come out.
    Rows that repeat a doc_id are one document (its text: that of least hash).  Null, empty
    or blank texts and null doc_ids link with nothing.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    m = bands * rows
    docs = docs.select("doc_id", "text").withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(1), "text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in batches:
            texts, lists, empty = text_bytes(batch), [], []
            for i, j in chunks_by_size(texts, 4_000_000):
                doc, h, c = shingles.of(texts[i:j])
                sig = signatures(doc, h, c, j - i, m)
                lists.append(band_hashes(sig, bands, rows).view(np.int64).reshape(-1))
                empty.append(np.isinf(sig).any(1))
            flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
            mask = np.append(np.concatenate(empty) if empty else np.empty(0, bool), False)
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * bands, mask=mask)
            cols = [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.ListArray.from_arrays(offsets, pa.array(flat))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "k1", "k2", "bands"])

    signed = docs.mapInArrow(sign, "doc_id long, k1 long, k2 long, bands array<long>")
    signed = checkpoint(signed.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "bands")).alias("s")).select("doc_id", "s.*"))
    nodes = checkpoint(signed.filter("bands is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")))
    banded = nodes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    banded = checkpoint(hub_join(banded, buckets, "band", nodes.count() * bands, "node", counted="n").select("band", "node", "leader"))
    # the texts of nodes that share a bucket, compressed; the rest is compared with nothing
    met = nodes.join(banded.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("doc_id"), "k1", "k2")
    texts = docs.join(met, ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = pa.array([zstandard.compress(x, 3) for x in text_bytes(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), z], names=["node", "z"])

    texts = checkpoint(texts.select("doc_id", "text").mapInArrow(squeeze, "node long, z binary"))
    tested, open_, left_over = None, banded, banded.count()
    for _ in range(rounds):
        pairs = open_.filter("node > leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti").select("a", "b")
        pairs = checkpoint(pairs)
        new = checkpoint(compared(pairs, texts, left_over))
        tested = new if tested is None else checkpoint(tested.union(new))
        # nodes far from their bucket's leader get another: the least of those left
        known = open_.join(tested.select(F.col("a").alias("node"), F.col("b").alias("leader"), "sim"), ["node", "leader"], "left")
        left = known.filter((F.col("node") > F.col("leader")) & (F.col("sim") < settle)).select("band", "node")
        leaders = left.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        open_ = checkpoint(hub_join(left, leaders, "band", left_over, "node", counted="n").select("band", "node", "leader"))
        left_over = open_.count()
        if not left_over:
            break
    links = tested.filter(F.col("sim") >= least).select("a", "b")
    alike = tested.filter((F.col("sim") < least) & (F.col("sim") >= settle - (1 - least))).select("a", "b")
    alike = alike.union(open_.filter("node > leader").select("node", "leader").distinct())
    linked = components(links).select("node", F.col("component").alias("part"))
    own = checkpoint(texts.select("node").join(linked, "node", "left").select("node", F.coalesce("part", "node").alias("part")))
    n_met, n_alike = own.count(), alike.count()
    ends = hub_join(alike.withColumnRenamed("b", "node"), own, "node", n_alike, "a").select(F.col("a").alias("node"), F.col("part").alias("b"))
    cross = checkpoint(ends.join(own, "node").select(F.col("part").alias("a"), "b").filter("a <> b").distinct())
    roots = own.select("node", F.col("part").alias("component"))
    if not cross.isEmpty():
        further = components(checkpoint(block_links(own, cross, texts, n_met, least))).select(F.col("node").alias("part"), F.col("component").alias("whole"))
        roots = hub_join(own, further, "part", n_met, "node", "left").select("node", F.coalesce("whole", "part").alias("component"))
    node_of = signed.filter("bands is not null").join(nodes.select("k1", "k2", "node", "copies"), ["k1", "k2"])
    found = node_of.join(roots, "node", "left").select("doc_id", F.coalesce("component", "node").alias("class_id"), "copies")
    alone = signed.filter("bands is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("copies"))
    return found.union(alone).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def one_of_each(docs: DataFrame, every_text: bool = False) -> DataFrame:
    """The rows of one document of each class, the least doc_id; all columns as they are.

    Rows with a null doc_id stay.  Of rows that repeat a doc_id the one with the least text
    hash stays (the text that stood for the document).  With ``every_text`` each further
    text under a taken doc_id is a document of its own, after all others in the order, and
    stays unless it is like one of them; of rows that repeat both, one stays.  Null, empty
    and blank texts stay (each such text once an id).  Other columns are carried, whatever
    their names; an empty table gives no rows.
    """
    columns = docs.columns
    wide = docs.select(
        "doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"),
        carried([c for c in columns if c not in ("doc_id", "text")]).alias("rest"),
    )
    back = [F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in columns]
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        gone = near_classes(docs).filter("not kept").select("doc_id")
        return wide.join(gone, "doc_id", "left_anti").select(back)
    # one row for each text of an id; its rank among them
    by_text = W.partitionBy("doc_id", "k1", "k2").orderBy(F.xxhash64("rest"))
    by_id = W.partitionBy("doc_id").orderBy("k1", "k2")
    named = wide.filter("doc_id is not null").withColumn("row", F.row_number().over(by_text)).filter("row = 1").drop("row")
    named = named.withColumn("rank", F.row_number().over(by_id))
    if every_text:
        last = docs.agg(F.max("doc_id")).first()[0]
        named = checkpoint(named.withColumn("key", F.when(F.col("rank") == 1, F.col("doc_id")).otherwise(F.lit(last + 1) + F.monotonically_increasing_id())))
    else:
        named = named.filter("rank = 1").withColumn("key", F.col("doc_id"))
    gone = near_classes(named.select(F.col("key").alias("doc_id"), "text")).filter("not kept").select(F.col("doc_id").alias("key"))
    return named.join(gone, "key", "left_anti").select(back).union(wide.filter("doc_id is null").select(back))


#: For tables without null or repeated doc_ids.
OP8_SQL = rf"""
with recursive d as (select doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    node as (select text, min(doc_id) as node, count(*) as copies, any_value(w) as w from d where len(w) > 0 group by text),
    shingle as (select node, array_to_string(w[i + 1 : i + {SHINGLE}], ' ') as s, count(*) as c from (select *, unnest(range(0, greatest(1, len(w) - {SHINGLE - 1}))) as i from node) group by 1, 2),
    size as (select node, sum(c) as n from shingle group by 1),
    met as (select a.node as a, b.node as b, sum(least(a.c, b.c)) as low from shingle a join shingle b on a.s = b.s and a.node < b.node group by 1, 2),
    pair as (select a, b from met join size x on x.node = a join size y on y.node = b where low / (x.n + y.n - low)::double >= {SIMILARITY}),
    link as (select a, b from pair union all select b, a from pair),
    reach as (select node as a, node as b from node union select reach.a, link.b from reach join link on reach.b = link.a),
    root as (select a as node, min(b) as class_id from reach group by a)
select doc_id, coalesce(class_id, doc_id) as class_id, coalesce(copies, 1)::bigint as copies, doc_id = coalesce(class_id, doc_id) as kept
from d left join node using (text) left join root using (node)"""


def op8_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
