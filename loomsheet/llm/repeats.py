"""Exact removal of long repeats across documents, for token windows and for bytes.

Both operators find every window of L tokens that also starts in a document with a smaller
id.  They share a first step that rules out most text: each window is represented by its
least k-gram hash (its anchor), so equal windows have equal anchors and only windows whose
anchor occurs in two documents can repeat.  Consecutive windows with one anchor form a run;
about one run is kept per (L - k + 2) / 2 tokens.

Within a task, repeats are decided at once: of equal entries only those of the least
document travel to the entry's bucket, the rest are marked and travel spread out.  A
passage or a copy that a third of all rows share therefore reaches its bucket once per
task, not once per row.  Nothing is dropped, and nothing is gathered on the driver.

Anchors only rule out: they travel as 40 bits beside their bucket, and rows that repeat a
doc_id share their hits.  What is removed is decided by whole windows, and told apart by
doc_id and a 32-bit hash of the text.  Rows with a null doc_id are kept whole and remove
nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import BASES, U64, Rolling, carried, chunks_by_size, forget_at_exit, input_bytes, mix64, partitions_for, shared_folder, sliding_min, small_batches, table, text_bytes
from .suffix_arrays import repeated_windows

#: Window lengths, and the anchors' gram lengths.
WORDS, WORD_GRAM = 50, 20
BYTES, BYTE_GRAM = 50, 20
#: Entries and bytes that a task holds before it sends them off.
FLUSH, FLUSH_BYTES = 1_000_000, 16 << 20
#: An anchor in more documents than this, and than one for so many bytes of input, is hot: its runs
#: would fill a shard. Of 100 TB (6.5e12 anchors at most) two million are at most, 16 MB.
HOT, HOT_BYTES = 25_000, 32_000_000


class ByteTokens:
    """Documents as bytes."""

    def __init__(self):
        self.values = mix64(np.arange(1, 257, dtype=U64))

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit token values, end of each document) of the texts laid end to end."""
        return self.values[np.frombuffer(b"".join(texts), np.uint8)], np.cumsum([len(x) for x in texts])


class WordTokens:
    """Documents as words ``[^\\x20\\x09-\\x0D]+``, each a 64-bit hash of its bytes."""

    def __init__(self):
        self.values, self.rolling = mix64(np.arange(1, 257, dtype=U64)), Rolling(BASES[1])
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        gap = self.space[flat]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        prefix = self.rolling.prefix(self.values[flat])
        tokens = mix64(self.rolling.spans(prefix, start, end) + (end - start).astype(U64))
        return tokens, np.searchsorted(start, np.cumsum([len(x) + 1 for x in texts]))


class Runs:
    """Maximal runs of window starts with one anchor."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.rolling = length, gram, Rolling()

    def of(self, tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, document's index, first window start, number of starts) of each run."""
        n = len(tokens) - self.length + 1
        if n <= 0:
            e = np.empty(0, np.int64)
            return e.astype(U64), e, e, e
        grams = mix64(self.rolling.windows(self.rolling.prefix(tokens), self.gram))
        anchor = sliding_min(grams, self.length - self.gram + 1)
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        valid = doc[:n] == doc[self.length - 1 :]
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:n] != doc[: n - 1])
        first = np.flatnonzero(valid & new)
        closing = np.flatnonzero(np.concatenate((~valid[1:] | new[1:], [True])) & valid)
        return anchor[first], doc[first], first, closing - first + 1


def least_and_rest(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by keys then doc, least doc of the entry's group, whether the group has two docs), in that order."""
    order = np.lexsort((doc, *keys))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    group = np.cumsum(new) - 1
    d = doc[order]
    low = d[new][group]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(d) - 1) if len(d) else np.empty(0, np.int64)
    return order, low, (d[last] > d[new])[group]


def packed(a: np.ndarray, ascending: bool = False) -> bytes:
    """An integer array, byte plane by byte plane (of its differences), compressed."""
    if ascending:
        a = np.diff(a, prepend=a.dtype.type(0))
    return zstandard.compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes(), 1)


def unpacked(data: bytes, kind: type, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    a = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(a, dtype=kind) if ascending else a


def blobs(bucket: np.ndarray, n: int, sure: int, doc: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[dict, np.ndarray]]:
    """A row for each bucket that has entries, sorted by document, and the entries' places."""
    order = np.lexsort((doc, bucket))
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(ends)).tolist():
        at = order[ends[b] : ends[b + 1]]
        yield {"bucket": b, "sure": sure, "c0": packed(doc[at], True)} | {f"c{i}": packed(c[at]) for i, c in enumerate(columns, 1)}, at


def as_batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "sure": pa.int8()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds.get(c, pa.binary())) for c in names], names=names)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.hash("text").alias("th"), "text")


#: Kinds of entries: to be compared; settled within a task; a count that tells other tasks of an anchor settled there.
OPEN, SURE, TOLD = 0, 1, 2
LOW_BITS = U64((1 << 40) - 1)


def repeated_anchors(docs: DataFrame, tokens: Callable, length: int, gram: int, n: int, hot: int | None = None) -> DataFrame:
    """(doc_id, anchor): the low 40 bits of every anchor that also occurs in another document.

    With ``hot``, anchors that stand in more documents than that are also given once with a
    null doc_id (counted task by task; texts met in two tasks count twice).
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, runs, held, size = tokens(), Runs(length, gram), [], 0
        spread = TaskContext.get().partitionId()
        names = ["bucket", "sure", "c0", "c1"]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal spread
            anchor, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, _, many = least_and_rest((anchor,), doc)
            anchor, doc = anchor[order], doc[order]
            bucket = ((anchor >> U64(40)) % U64(n)).astype(np.int64)
            low = (anchor & LOW_BITS).view(np.uint8).reshape(-1, 8)[:, :5]
            # shared within this task: certain; one entry with their number still tells other tasks
            first = np.ones(len(anchor), bool)
            first[1:] = anchor[1:] != anchor[:-1]
            told = many & first
            number = np.diff(np.append(np.flatnonzero(first), len(anchor)))[many[first]]
            spread += 1
            parts = [
                (bucket[~many], OPEN, doc[~many], low[~many]),
                (bucket[told], TOLD, number, low[told]),
                ((np.arange(many.sum()) // 4096 + spread * 7919) % n, SURE, doc[many], low[many]),
            ]
            rows = [r for b, sure, d, x in parts for r, _ in blobs(b, n, sure, d, [np.ascontiguousarray(x)])]
            for i in range(0, len(rows), 2048):
                yield as_batch(rows[i : i + 2048], names)

        for batch in batches:
            texts, ids = text_bytes(batch), batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, j in chunks_by_size(texts):
                anchor, doc, _, _ = runs.of(*read.of(texts[i:j]))
                order = np.lexsort((anchor, doc))
                anchor, doc = anchor[order], doc[order]
                new = np.ones(len(doc), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                anchor, doc = anchor[new], doc[new] + i
                held.append((anchor, ids[doc].astype(np.int64)))
                size += len(anchor)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(anchor: np.ndarray, doc: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(anchor), 50_000):
                s = slice(i, i + 50_000)
                ids = pa.nulls(len(anchor[s]), pa.int64()) if doc is None else pa.array(doc[s])
                yield pa.RecordBatch.from_arrays([ids, pa.array(anchor[s].view(np.int64))], names=["doc_id", "anchor"])

        entries: dict[int, list] = {}
        for batch in batches:
            for bucket, sure, c0, c1 in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sure", "c0", "c1")), strict=True):
                low = unpacked(c1, np.dtype("V5")).view(np.uint8).reshape(-1, 5)
                anchor = np.zeros((len(low), 8), np.uint8)
                anchor[:, :5] = low
                pair = anchor.reshape(-1).view(U64), unpacked(c0, np.int64, True)
                if sure == SURE:
                    yield from out(*pair)
                else:
                    entries.setdefault(bucket, []).append((*pair, np.full(len(pair[0]), sure == TOLD)))
        for parts in entries.values():
            anchor, doc, told = (np.concatenate(x) for x in zip(*parts, strict=True))
            some = np.unique(anchor[told])
            one, docs_of = anchor[~told], doc[~told]
            order, _, many = least_and_rest((one,), docs_of)
            # an anchor that some task found in two documents counts for all
            pick = order[many | np.isin(one[order], some)]
            yield from out(one[pick], docs_of[pick])
            if hot is not None:
                values, at = np.unique(anchor, return_inverse=True)
                counts = np.bincount(at, np.where(told, doc, 1))
                yield from out(values[counts > hot], None)

    sent = docs.filter("doc_id is not null and text is not null").mapInArrow(send, "bucket int, sure tinyint, c0 binary, c1 binary")
    return sent.repartitionById(n, F.col("bucket")).mapInArrow(meet, "doc_id long, anchor long")


def by_doc(hits: DataFrame, *columns: str) -> DataFrame:
    return hits.groupBy("doc_id").agg(*[F.collect_list(c).alias(f"hit_{c}") for c in columns])


def with_hits(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Documents, and for each the list of its hits (null: none)."""
    return docs.join(hits.hint("merge"), "doc_id", "left")


def own_hits(batch: pa.RecordBatch, *columns: str) -> Iterator[list[np.ndarray] | None]:
    """Each row's lists, without those of other texts under its doc_id."""
    for th, of, *lists in zip(batch.column("th").to_pylist(), batch.column("hit_th"), *(batch.column(f"hit_{c}") for c in columns), strict=True):
        if not of.is_valid:
            yield None
            continue
        own = of.values.to_numpy() == th
        yield [x.values.to_numpy(zero_copy_only=False)[own] for x in lists]


def candidate_runs(batch: pa.RecordBatch, read, runs: Runs) -> Iterator[tuple]:
    """(rows, tokens, ends, document's index, start, starts) of the runs whose anchor is among the document's hits."""
    hit = batch.column("hit_anchor")
    rows = np.flatnonzero(hit.is_valid().to_numpy(zero_copy_only=False))
    if not len(rows):
        return
    part = batch.take(pa.array(rows))
    texts, wanted = text_bytes(part), part.column("hit_anchor")
    for i, j in chunks_by_size(texts):
        tokens, ends = read.of(texts[i:j])
        anchor, doc, start, count = runs.of(tokens, ends)
        some = wanted.slice(i, j - i)
        flat = some.flatten().to_numpy(zero_copy_only=False).view(U64)
        owner = np.repeat(np.arange(j - i), np.asarray(pa.compute.list_value_length(some)))
        # (document, anchor) pairs as one key; a rare false hit only costs work
        key = lambda d, a: a ^ mix64(d.astype(U64) + U64(1))
        keep = np.isin(key(doc, anchor & LOW_BITS), key(owner, flat))
        yield texts[i:j], rows[i:j], tokens, ends, anchor[keep], doc[keep], start[keep], count[keep]


def remove_repeated_words(docs: DataFrame, length: int = WORDS, gram: int = WORD_GRAM) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (see the module for what is removed).

    Windows of candidate runs get two Rabin-Karp hashes; Spark takes each pair's least
    document; the repeated windows of a row are merged into maximal intervals.  A task
    sends a window once for each text at most, with all its places there, however often it
    stands in a very long text.  Null or blank text has no words and keeps the empty
    string.  Rows that repeat a doc_id never remove from each other; repeated rows are
    answered each.  A null doc_id keeps all and removes nothing.  An empty table gives no
    rows.  Other columns are not read, so their names cannot clash.
    """
    small_batches(docs.sparkSession)
    n = partitions_for(docs, 16 << 20)
    docs = keyed(docs)
    hits = repeated_anchors(docs, WordTokens, length, gram, n)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, runs, second, held, size = WordTokens(), Runs(length, gram), Rolling(BASES[1]), [], 0
        alone = mix64(np.asarray([TaskContext.get().partitionId() + 1], U64) << U64(32))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal alone
            h1, h2, doc, th, at = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((at, th, doc, h1, h2))
            h1, h2, doc, th, at = (x[order] for x in (h1, h2, doc, th, at))
            new = np.ones(len(doc), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            # of equal windows in this task only those of the least document need to be compared further,
            # and those of one text share their fate
            sure = doc > doc[new][np.cumsum(new) - 1]
            new[1:] |= (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
            loose = ~sure
            first, places = starts(new[loose]), at[loose]
            yield from sent((h1[loose][first], h2[loose][first], doc[loose][first], th[loose][first]), first, places, False)
            if sure.any():
                alone = mix64(alone)
                doc, th, at = doc[sure], th[sure], at[sure]
                order = np.lexsort((at, th, doc))
                doc, th, at = doc[order], th[order], at[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
                first = starts(new)
                spread = mix64(np.arange(len(first), dtype=U64) + alone)
                yield from sent((spread, spread, doc[first], th[first]), first, at, True)

        def starts(new: np.ndarray) -> np.ndarray:
            return np.flatnonzero(new)

        def sent(columns: tuple, first: np.ndarray, at: np.ndarray, sure: bool) -> Iterator[pa.RecordBatch]:
            """Rows with the places of each: one binary value of int32."""
            h1, h2, doc, th = columns
            offsets = (np.append(first, len(at)) * 4).astype(np.int32)
            data = pa.py_buffer(np.ascontiguousarray(at, np.int32))
            places = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), data])
            for i in range(0, len(first), 50_000):
                s = slice(i, i + 50_000)
                cols = [pa.array(c) for c in (h1[s].view(np.int64), h2[s].view(np.int64), doc[s], th[s])]
                yield pa.RecordBatch.from_arrays([*cols, places[s], pa.array(np.full(len(doc[s]), sure))], names=["h1", "h2", "doc_id", "th", "at", "sure"])

        for batch in batches:
            ids, hashes = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("th").to_numpy()
            for _, rows, tokens, ends, _, doc, start, count in candidate_runs(batch, read, runs):
                at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
                row, d = rows[np.repeat(doc, count)], np.repeat(doc, count)
                h = [mix64(r.windows(r.prefix(tokens), length)[at]) for r in (runs.rolling, second)]
                begin = np.concatenate(([0], ends[:-1]))
                held.append((*h, ids[row].astype(np.int64), hashes[row], (at - begin[d]).astype(np.int32)))
                size += len(at)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    found = with_hits(docs, by_doc(hits, "anchor")).mapInArrow(windows, "h1 long, h2 long, doc_id long, th int, at binary, sure boolean")
    # a key holds one row for each task that met its window
    least = F.min("doc_id").over(W.partitionBy("h1", "h2"))
    repeated = found.withColumn("least", least).filter("sure or doc_id > least").select("doc_id", "th", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, hit in zip(text_bytes(batch), own_hits(batch, "at"), strict=True):
                words = text.split()
                total = len(words)
                if hit and len(hit[0]):
                    gone = covered(np.frombuffer(b"".join(hit[0].tolist()), np.int32), length, total)
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((total, total - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            a, b, c = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return with_hits(docs, by_doc(repeated, "th", "at")).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def covered(starts: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n tokens lie in an interval [start, start + length)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:n]) > 0


def repeated_spans(docs: DataFrame, length: int = BYTES, gram: int = BYTE_GRAM) -> DataFrame:
    """(doc_id, th, at, size): byte spans to remove from ``keyed`` documents; spans may overlap.

    The text of candidate runs goes to shards by anchor; each shard builds suffix arrays
    (see ``suffix_arrays``) and compares them by binary search.  The runs of an anchor that
    stands in very many documents (a line that a third of them share, in unlike
    surroundings) are sent window by window, dealt by the window's hash, so a task settles
    all but one of equal windows and no shard gathers the runs of one anchor.
    """
    spark = docs.sparkSession
    n = partitions_for(docs, 2 << 20)
    total = input_bytes(docs)
    most = max(HOT, (total if total < 1 << 58 else 0) // HOT_BYTES)
    # kept in the shared folder, for the anchors of very many documents must be known before texts are sent
    folder = f"{shared_folder(spark)}/anchors-{uuid.uuid4().hex}"
    forget_at_exit(spark, folder)
    by_doc(repeated_anchors(docs, ByteTokens, length, gram, n, most), "anchor").write.parquet(folder)
    hits = spark.read.parquet(folder)
    told = hits.filter("doc_id is null").select(F.explode("hit_anchor").alias("anchor")).collect()  # bounded: see HOT_BYTES
    hot = np.unique(np.asarray([r["anchor"] for r in told], np.int64)).view(U64)
    hits = hits.filter("doc_id is not null")
    kinds = (np.int64, np.int32, np.int32, np.int32)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, runs, held, size = ByteTokens(), Runs(length, gram), [], 0
        spread = TaskContext.get().partitionId()
        names = ["bucket", "sure", "c0", "c1", "c2", "c3", "c4", "texts"]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal spread
            texts = [t for x in held for t in x[0]]
            anchor, whole, doc, th, at, count = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
            held.clear()
            order, low, _ = least_and_rest((anchor, whole), doc)
            sure = doc[order] > low
            # the first entry of each group is of its least document; bytes decide, not the hash
            new = np.ones(len(order), bool)
            new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (whole[order][1:] != whole[order][:-1])
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            sure[sure] = [texts[a] == texts[b] for a, b in zip(order[sure].tolist(), first[sure].tolist(), strict=True)]
            rest, gone = order[~sure], order[sure]
            # settled runs of one text that go on into each other are one
            gone = gone[np.lexsort((at[gone], th[gone], doc[gone]))]
            new = np.ones(len(gone), bool)
            new[1:] = (doc[gone][1:] != doc[gone][:-1]) | (th[gone][1:] != th[gone][:-1]) | (at[gone][1:] != (at[gone] + count[gone])[:-1])
            head = np.flatnonzero(new)
            joined = np.add.reduceat(count[gone], head).astype(np.int32) if len(gone) else count[gone]
            gone = gone[head]
            rows = []
            # three bytes of an entry's anchor: entries of others need not be compared
            near = anchor.view(np.uint8).reshape(-1, 8)[:, :3]
            for row, places in blobs(((anchor[rest] >> U64(40)) % U64(n)).astype(np.int64), n, OPEN, doc[rest], [x[rest] for x in (th, at, count, near)]):
                row["texts"] = zstandard.compress(b"".join([texts[k] for k in rest[places].tolist()]), 3)
                rows.append(row)
            spread += 1
            rows += [r for r, _ in blobs((np.arange(len(gone)) // 4096 + spread * 7919) % n, n, SURE, doc[gone], [th[gone], at[gone], joined])]  # (no c4)
            for i in range(0, len(rows), 256):
                yield as_batch(rows[i : i + 256], names)

        for batch in batches:
            ids, hashes = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("th").to_numpy()
            for texts, rows, tokens, ends, anchor, doc, start, count in candidate_runs(batch, read, runs):
                flat = b"".join(texts)
                prefix = runs.rolling.prefix(tokens)
                single = np.isin(anchor & LOW_BITS, hot) if len(hot) else np.zeros(len(anchor), bool)
                if single.any():
                    # runs of such anchors become their windows, each its own anchor
                    n_of = np.where(single, count, 1)
                    step = np.arange(n_of.sum()) - np.repeat(np.cumsum(n_of) - n_of, n_of)
                    anchor, doc, start, count, single = (np.repeat(x, n_of) for x in (anchor, doc, start, count, single))
                    start, count = start + step, np.where(single, 1, count)
                    anchor = np.where(single, mix64(runs.rolling.spans(prefix, start, start + length) ^ U64(BASES[1])), anchor)
                stop = start + count + length - 1
                whole = mix64(runs.rolling.spans(prefix, start, stop) + count.astype(U64))
                begin = np.concatenate(([0], ends[:-1]))[doc]
                cut = [flat[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
                held.append((cut, anchor, whole, ids[rows[doc]].astype(np.int64), hashes[rows[doc]], (start - begin).astype(np.int32), count.astype(np.int32)))
                size += int((stop - start).sum())
                if size >= FLUSH_BYTES:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda doc, th, at, size: pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, th, at.astype(np.int32), size.astype(np.int32))], names=["doc_id", "th", "at", "size"])
        entries, texts = [], []
        for batch in batches:
            for sure, blob, near, *cols in zip(*(batch.column(c).to_pylist() for c in ("sure", "texts", "c4", "c0", "c1", "c2", "c3")), strict=True):
                doc, th, at, count = (unpacked(c, t, not i) for i, (c, t) in enumerate(zip(cols, kinds, strict=True)))
                if sure == SURE:
                    yield out(doc, th, at, count + length - 1)
                    continue
                three = unpacked(near, np.dtype("V3")).view(np.uint8).reshape(-1, 3).astype(np.int64)
                entries.append((doc, th, at, count, three @ np.asarray([1, 1 << 8, 1 << 16])))
                blob = zstandard.decompress(blob)
                ends = np.cumsum(count.astype(np.int64) + length - 1).tolist()
                texts += [blob[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if entries:
            doc, th, at, count, anchor = (np.concatenate(x) for x in zip(*entries, strict=True))
            # where an anchor stands in one text only (in copies) there is nothing to compare: the least document keeps it
            number: dict[bytes, int] = {}
            of = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
            least = np.full(len(number), np.iinfo(np.int64).max)
            np.minimum.at(least, of, doc)
            _, anchor = np.unique(anchor, return_inverse=True)
            different = np.bincount(np.unique(anchor * len(number) + of) // len(number))[anchor]
            copy = (different == 1) & (doc > least[of])
            yield out(doc[copy], th[copy], at[copy], count[copy] + length - 1)
            rest = np.flatnonzero(different > 1)
            which, first, starts = repeated_windows([texts[i] for i in rest.tolist()], doc[rest], length)
            which = rest[which]
            yield out(doc[which], th[which], at[which] + first, starts + length - 1)

    fields = "bucket int, sure tinyint, c0 binary, c1 binary, c2 binary, c3 binary, c4 binary, texts binary"
    sent = with_hits(docs, hits).mapInArrow(send, fields)
    return sent.repartitionById(n, F.col("bucket")).mapInArrow(meet, "doc_id long, th int, at int, size int")


def cut_spans(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes]]:
    """(bytes, bytes removed, maximal removed runs, remaining bytes) of each row."""
    for text, hit in zip(text_bytes(batch), own_hits(batch, "at", "size"), strict=True):
        if not hit:
            yield len(text), 0, 0, text
            continue
        gone = covered(*hit, len(text))
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        yield len(text), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), kept


def remove_repeated_bytes(docs: DataFrame, length: int = BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text is empty.  Very long and repetitive texts need memory for a few copies of
    one text.  Rows that repeat a doc_id never remove from each other; repeated rows are
    answered each.  A null doc_id keeps all and removes nothing.  An empty table gives no
    rows.  Other columns are not read, so their names cannot clash.
    """
    small_batches(docs.sparkSession)
    docs = keyed(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(a, b, c, hashlib.sha256(kept).hexdigest()) for a, b, c, kept in cut_spans(batch)]
            cols = list(zip(*done, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    marked = with_hits(docs, by_doc(repeated_spans(docs, length), "th", "at", "size"))
    return marked.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean_documents(docs: DataFrame, length: int = BYTES) -> DataFrame:
    """The same rows and columns, repeated bytes cut from the texts and ``n_chars`` (if there) counted anew.

    A character of which only some bytes go is left out.  Null text stays null; a text that
    goes whole is empty.  Repeated rows stay each, cut alike; a null doc_id is left whole.
    Other columns travel in one struct, so their names cannot clash; an empty table stays so.
    """
    small_batches(docs.sparkSession)
    columns, schema = docs.columns, docs.schema
    others = [c for c in columns if c not in ("doc_id", "text")]
    wide = docs.select("doc_id", F.hash("text").alias("th"), "text", carried(others).alias("rest"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [x[3].decode("utf-8", "ignore") for x in cut_spans(batch)]
            null = batch.column("text").is_null().to_pylist()
            kept = [None if n else x for x, n in zip(kept, null, strict=True)]
            rest = dict(zip([f.name for f in batch.column("rest").type], batch.column("rest").flatten(), strict=True))
            cols = {"doc_id": batch.column("doc_id"), "text": pa.array(kept, pa.string())} | {c: rest[c] for c in others}
            if "n_chars" in others:
                cols["n_chars"] = pa.array([None if x is None else len(x) for x in kept], rest["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cols[c] for c in columns], names=columns)

    hits = repeated_spans(keyed(docs), length)
    return with_hits(wide, by_doc(hits, "th", "at", "size")).mapInArrow(cut, schema)


#: What both queries do with window starts that are hits: runs of starts whose windows touch or overlap.
RUNS_SQL = """
    hit as (select r, i from win join (select s, min(doc_id) as least from win group by s) using (s) where doc_id > least),
    part as (select r, i, sum(case when i <= before + 50 then 0 else 1 end) over (partition by r order by i) as g from (select r, i, lag(i) over (partition by r order by i) as before from hit)),
    run as (select r, min(i) as a, max(i) + 50 as e from part group by r, g),
    gap as (select *, coalesce(lag(e) over (partition by r order by a), 0) as open from run)"""
OP2_SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    win as (select r, doc_id, i, array_to_string(w[i + 1 : i + 50], ' ') as s from (select *, unnest(range(0, len(w) - 49)) as i from d)),{RUNS_SQL},
    kept as (select r, sum(e - a) as gone, max(e) as last, string_agg(array_to_string(w[open + 1 : a], ' '), ' ' order by a) filter (a > open) as before from gap join d using (r) group by r)
select doc_id, len(w) as n_words, coalesce(gone, 0)::bigint as n_removed,
    sha256(concat_ws(' ', before, case when len(w) > coalesce(last, 0) then array_to_string(w[coalesce(last, 0) + 1 :], ' ') end)) as kept_sha256
from d left join kept using (r)"""
#: On hexadecimal digits, in pieces of 1,000 bytes, for a slice of a long text costs its length.
OP10_SQL = f"""
with d as (select row_number() over () as r, doc_id, hex(coalesce(text, '')) as h, length(hex(coalesce(text, ''))) // 2 as n from documents),
    piece as (select r, doc_id, n, b, substr(h, 2 * b + 1, 2 * 1049) as x from (select *, unnest(range(0, greatest(n - 49, 0), 1000)) as b from d)),
    win as (select r, doc_id, b + j as i, substr(x, 2 * j + 1, 100) as s from (select *, unnest(range(0, least(1000, n - 49 - b))) as j from piece)),{RUNS_SQL},
    kept as (select r, sum(e - a) as gone, count(*) as spans, max(e) as last, string_agg(substr(h, 2 * open + 1, 2 * (a - open)), '' order by a) as before from gap join d using (r) group by r)
select doc_id, n as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
    sha256(unhex(coalesce(before, '') || substr(h, 2 * coalesce(last, 0)::bigint + 1))) as kept_sha256
from d left join kept using (r)"""


def op2_rabin_karp_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(table(spark, sf_dir, "documents"))


def op10_suffix_array_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))
