"""Encoding and decoding with a SentencePiece vocabulary by streaming Viterbi.

The best segmentation is the one whose pieces' scores have the greatest sum.  A text is fed
to the search in parts; the search keeps only as many positions as the longest piece and
commits ids as soon as the paths of all of them run through one boundary.  Characters outside the vocabulary become byte
pieces, so every text comes back exactly.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import chunks_by_size, small_batches, table, text_bytes

VOCABULARY = "piece_bpe_32k.model"
#: What a byte-coded character scores below the lowest piece.
PENALTY = 10.0
LOWEST = float("-inf")
#: Characters that are fed at once, and those of the longest run that is held back or remembered.
PART, LONG_RUN = 1 << 16, 40
#: Bytes of texts whose ids are put into one Arrow batch: their offsets fit 32 bits.
BATCH_BYTES = 64 << 20
SPACE = "▁"


class Vocabulary:
    """Pieces with a plain space for the vocabulary's space mark, so that mark itself is byte-coded in texts."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.score: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                piece = piece.replace(SPACE, " ")
                self.score[piece], self.bytes_of[i] = (i, sp.get_score(i)), piece.encode()
        self.longest = max(map(len, self.score))
        #: Every start of a piece: its (id, score), or None if it is no piece itself.
        self.starts = {p[:k]: None for p in self.score for k in range(1, len(p) + 1)} | self.score
        self.fallback = min((s for _, s in self.score.values() if s > -1e8), default=0.0) - PENALTY
        #: No piece runs from a word into a space: words can be searched one by one.
        self.by_word = not any(" " in p.lstrip(" ") for p in self.score)
        # the letters and digits that no piece joins to other characters, directly or through others
        inner = [set(p.lstrip(" ")) for p in self.score]
        free = {c for p in inner for c in p if c.isalnum()}
        while bound := {c for p in inner if not p <= free for c in p & free}:
            free -= bound
        bound = re.escape("".join(sorted({c for p in inner for c in p if c.isalnum()} - free)))
        #: No piece runs from these into the others or back: runs of either kind can be searched apart.
        self.runs = re.compile(rf" *[^\W_{bound}]+| *[\W_{bound}]+?(?= |[^\W_{bound}]|\Z)")


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class Memo(dict):
    """Ids (int32 bytes) of the runs met; a run that is not there is searched.

    When it is full it becomes the old one, from which runs still in use come back; so it
    holds ``limit`` short runs twice at most.
    """

    def __init__(self, search: Callable[[str], list[int]], limit: int):
        super().__init__()
        self.search, self.limit = search, limit
        self.old: dict[str, bytes] = {}

    def __missing__(self, run: str) -> bytes:
        ids = self.old.get(run)
        if ids is None:
            ids = packed(self.search(run))
        if len(run) <= LONG_RUN:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[run] = ids
        return ids


class StreamingViterbi:
    """Feed text in parts; ``feed`` and ``finish`` return the ids committed so far.

    Surviving paths always converge where no piece of the vocabulary can run across (the
    ends of the vocabulary's runs): there all is committed, and the ids of a run depend on
    the run alone, so those of short runs are remembered.  Within a run the search holds a
    window of positions bounded by the longest piece and commits whenever the backpointer
    paths of all live positions meet in one boundary.

    ``width`` is the greatest number of positions ever held beyond the committed boundary
    and the part being read.
    """

    def __init__(self, vocabulary: Vocabulary, limit: int = 200_000):
        self.v, self.memo = vocabulary, Memo(self._whole, limit)
        self.reset()

    def reset(self) -> None:
        self.text, self.base, self.width = "", 0, 0  # text from the committed boundary on
        self.best, self.back, self.ids = [0.0], [0], [0]  # ids: the piece that ends here, -1: bytes
        self.done = 0  # positions of ``text`` whose outgoing pieces are all entered
        self.open = ""  # what may go on as a run; its last character if that run is already being searched
        self.within = False  # whether the search stands inside a run

    def feed(self, part: str) -> list[int]:
        return list(array("i", b"".join(self.feed_packed(part))))

    def finish(self) -> list[int]:
        return list(array("i", self.finish_packed()))

    def feed_packed(self, part: str) -> list[bytes]:
        if not self.v.by_word:
            return [packed(self._search(part))]
        out: list[bytes] = []
        known = len(self.open) if self.within else 0  # what the search has seen
        runs = self.v.runs.findall(self.open + part)
        if not runs:
            return out
        last = runs.pop()  # may go on in the next part
        if known and runs:
            out.append(packed(self._search(runs.pop(0)[known:]) + self._end()))
            known, self.within = 0, False
        out.extend(map(self.memo.__getitem__, runs))
        if self.within or len(last) > LONG_RUN:
            out.append(packed(self._search(last[known:])))
            self.within, self.open = True, last[-1]
        else:
            self.open = last
        return out

    def finish_packed(self) -> bytes:
        if self.v.by_word and self.open and not self.within:
            out = self.memo[self.open]
        else:
            out = packed(self._end())
        self.reset()
        return out

    def _whole(self, run: str) -> list[int]:
        """From one boundary to the next."""
        return self._search(run) + self._end()

    def _extend(self, until: int) -> None:
        text, best, back, ids = self.text, self.best, self.back, self.ids
        find, longest, fallback = self.v.starts.get, self.v.longest, self.v.fallback
        n = len(text)
        more = n + 1 - len(best)
        best += [LOWEST] * more
        back += [0] * more
        ids += [0] * more
        for i in range(self.done, until):
            here, j, last = best[i], i + 1, min(i + longest, n)
            found = find(text[i:j], 0)
            if not found and here + fallback > best[j]:  # the character is no piece
                best[j], back[j], ids[j] = here + fallback, i, -1
            while True:
                if found:
                    s = here + found[1]
                    if s > best[j]:
                        best[j], back[j], ids[j] = s, i, found[0]
                elif found is not None or j == last:
                    break
                if j == last:
                    break
                j += 1
                found = find(text[i:j], 0)
        self.done = max(self.done, until)

    def _commit(self, at: int) -> list[int]:
        """Ids of the best path up to ``at``, which becomes the new start."""
        out, i, whole = [], at, at == len(self.text)
        while i:
            before = self.back[i]
            if self.ids[i] >= 0:
                out.append(self.ids[i])
            else:
                out += [self.v.byte_id[b] for b in reversed(self.text[before].encode())]
            i = before
        if whole:
            self.text, self.best, self.back, self.ids = "", [0.0], [0], [0]
            self.base, self.done = self.base + at, 0
            out.reverse()
            return out
        self.text, self.best, self.base = self.text[at:], self.best[at:], self.base + at
        self.back, self.ids, self.done = [b - at for b in self.back[at:]], self.ids[at:], self.done - at
        self.back[0] = self.ids[0] = 0
        out.reverse()
        return out

    def _search(self, part: str) -> list[int]:
        out: list[int] = []
        for k in range(0, len(part), 4 * self.v.longest):
            self.text += part[k : k + 4 * self.v.longest]
            until = len(self.text) - self.v.longest  # beyond, pieces may still grow
            if until <= self.done:
                continue
            self._extend(until)
            self.width = max(self.width, len(self.text))
            # later pieces start at done or after; earlier ones reach no further than done + longest
            alive = {i for i in range(self.done, len(self.best)) if self.best[i] > LOWEST}
            while len(alive) > 1:
                last = max(alive)
                alive.remove(last)
                alive.add(self.back[last])
            if (at := alive.pop()) > 0:
                out += self._commit(at)
        return out

    def _end(self) -> list[int]:
        """The text ends here, or no piece runs across: all is committed."""
        self._extend(len(self.text))
        return self._commit(len(self.text))


class Encoder:
    """Ids (int32 bytes) of whole texts, each fed to one streaming search in parts."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 200_000):
        self.v, self.search = vocabulary, StreamingViterbi(vocabulary, limit)
        self.cut = vocabulary.runs.findall if vocabulary.by_word else None

    def encode(self, text: str) -> bytes:
        out: list[bytes] = []
        for k in range(0, len(text), PART):
            out += self.search.feed_packed(text[k : k + PART])
        out.append(self.search.finish_packed())
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, ids))


def by_bytes(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``BATCH_BYTES`` of text, one long text at least."""
    for batch in batches:
        for i, j in chunks_by_size(text_bytes(batch, text), BATCH_BYTES):
            yield batch.slice(i, j - i)


@functools.cache
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(Vocabulary(path))


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds ``into`` array<int>. Null text gives null, empty text an empty array; other columns stay.

    A column already named ``into`` is replaced.  Of equal scores the path found first
    stays: the one whose last piece starts first, so ids are the same on every run.
    Repeated rows are encoded each; an empty table gives no rows.  Of a very long text the
    search holds a bounded window; its ids are held whole, at most 2**31 a text.
    """
    kept = docs.drop(into) if into != text else docs
    small_batches(docs.sparkSession)
    schema = kept.withColumn(into, F.lit(None).cast("array<int>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in by_bytes(batches, text):
            parts = [encoder.encode(x.decode()) for x in text_bytes(batch, text)]
            ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in parts]))).astype(np.int32)
            null = batch.column(text).is_null().to_numpy(zero_copy_only=False)
            offsets = pa.array(ends, mask=np.append(null, False))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, into])

    return kept.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds ``into`` string, the exact text of the ids.

    Null ids give null, an empty list the empty text.  A column already named ``into`` is
    replaced; repeated rows are decoded each; an empty table gives no rows.
    """
    kept = rows.drop(into) if into != ids else rows
    small_batches(rows.sparkSession)
    schema = kept.withColumn(into, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            col = batch.column(ids)
            flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum([n or 0 for n in pa.compute.list_value_length(col).to_pylist()])))
            null = col.is_null().to_pylist()
            texts = [None if null[i] else encoder.decode(flat[ends[i] : ends[i + 1]].tolist()) for i in range(len(col))]
            for i, j in chunks_by_size([x or b"" for x in texts], BATCH_BYTES):
                own = pa.array(texts[i:j], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, own], names=[*batch.schema.names, into])

    return kept.mapInArrow(run, schema)


def op6_streaming_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, their digest, and the digest of the text decoded from them."""
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in by_bytes(batches):
            texts = text_bytes(batch)
            parts = [encoder.encode(x.decode()) for x in texts]
            ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in parts]))).astype(np.int32)
            flat = np.frombuffer(b"".join(parts), np.int32)
            back = [encoder.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            cols = [
                batch.column("doc_id"),
                pa.array(np.diff(ends).astype(np.int64)),
                pa.array([hashlib.sha256(x).hexdigest() for x in parts]),
                pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                pa.array([x == y for x, y in zip(texts, back, strict=True)]),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_ids", "ids_sha256", "decoded_sha256", "round_trip", "ids"])

    return docs.mapInArrow(run, "doc_id long, n_ids long, ids_sha256 string, decoded_sha256 string, round_trip boolean, ids array<int>")
