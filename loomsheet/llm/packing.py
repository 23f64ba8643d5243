"""Sum-of-squares online packing of token sequences into fixed windows.

Each Spark task packs its own stream of documents, so packing needs no shuffle and no
driver step; a sequence id is the task's partition number in the high bits and a counter
in the low bits.  A task that is retried reads the same input split and repeats its ids.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ._common import small_batches, table, text_bytes

CAPACITY, END_ID, VOCABULARY = 2048, 1, "word_bpe_49k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds(dict):
    """Token ids (little-endian uint32 bytes) by whitespace-free chunk; emptied when full.

    The tokenizer drops ASCII white space before its merges, so a text's ids are those of
    its chunks, one after the other.  A chunk of precomposed Latin letters, then plain
    punctuation, is two words to its splitter: these go straight to its merge model.
    Every other chunk goes through the whole tokenizer.
    """

    PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:;=?@\[-`{}~]*)")

    def __init__(self, path: str, limit: int = 300_000):
        super().__init__()
        from tokenizers import Tokenizer

        self.limit, self.tokenizer = limit, Tokenizer.from_file(path)
        self.split, self.words = self.tokenizer.model.tokenize, {"": b""}
        # the printable character of each byte in byte-level vocabularies
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def merged(self, word: str) -> bytes:
        if (ids := self.words.get(word)) is None:
            shown = word if word.isascii() else "".join(map(self.shown.__getitem__, word.encode()))
            if len(self.words) >= self.limit:
                self.words = {"": b""}
            ids = self.words[word] = array("I", [t.id for t in self.split(shown)]).tobytes()
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if m := self.PLAIN.fullmatch(text.lower()):
            ids = self.merged(m[1]) + self.merged(m[2])
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) >= self.limit:
            self.clear()
        self[chunk] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


class SumOfSquaresPacker:
    """Places items into open windows so that the sum of squared level counts stays least.

    ``count[h]`` is the number of open windows filled to level h.  An item of length r goes
    to the level h (0: a new window) with the least change of sum(count**2); ties take the
    fullest level.  Full windows leave at once.  While more than ``most_open`` windows are
    open, which bounds memory, and at the end for all that are still open, the emptiest is
    cut up to fill the fullest: without cuts each open window would be padding.
    """

    def __init__(self, capacity: int = CAPACITY, most_open: int = 2048):
        self.capacity, self.most_open = capacity, most_open
        self.count = np.zeros(capacity + 1, np.int64)
        self.windows: dict[int, list[list]] = {}
        self.open = 0

    def level(self, r: int) -> int:
        """The level whose choice changes sum(count**2) least, 0 for a new window."""
        top, n = self.capacity - r, self.count
        levels = np.flatnonzero(n[: top + 1])  # count[0] stays 0
        if not len(levels):
            return 0
        change = 2 * (n[levels + r] - n[levels]) + 2
        change[levels == top] -= 1  # a full window is no longer counted
        best = change.min()
        return int(levels[change == best][-1]) if best <= 2 * n[r] + 1 else 0

    def place(self, piece: tuple) -> list | None:
        """piece: (doc, start, ids as bytes, doc tokens). Returns a window that became full."""
        r = len(piece[2]) // 4
        if r == self.capacity:
            return [piece]
        h = self.level(r)
        if h:
            window = self.windows[h].pop()
            self.count[h] -= 1
        else:
            window = []
            self.open += 1
        window.append(piece)
        if h + r == self.capacity:
            self.open -= 1
            return window
        self.count[h + r] += 1
        self.windows.setdefault(h + r, []).append(window)
        return None

    def _take(self, h: int) -> list:
        self.count[h] -= 1
        return self.windows[h].pop()

    def _put(self, h: int, window: list) -> None:
        self.count[h] += 1
        self.windows.setdefault(h, []).append(window)

    def consolidate(self, until: int) -> Iterator[list]:
        """Fill the fullest window with cuts of the emptiest, until so many are open; yields those that became full.

        Each step closes a window: a full one (with one cut at most), or an emptied one.
        """
        while self.open > max(1, until):
            levels = np.flatnonzero(self.count)
            high, low = int(levels[-1]), int(levels[0])
            window, source = self._take(high), self._take(low)
            while high < self.capacity and source:
                doc, start, ids, total = source.pop()
                n = len(ids) // 4
                take = min(n, self.capacity - high)
                window.append((doc, start + n - take, ids[4 * (n - take) :], total))
                if take < n:
                    source.append((doc, start, ids[: 4 * (n - take)], total))
                high, low = high + take, low - take
            self.open -= 1
            if source:
                self._put(low, source)
            if high < self.capacity:
                self._put(high, window)
            else:
                self.open -= not source
                yield window

    def finish(self) -> Iterator[list]:
        """Close all: windows still open are cut up to fill each other, the last one into powers of two, which need no padding."""
        yield from self.consolidate(1)
        for window in [w for x in self.windows.values() for w in x]:
            left = sum(len(p[2]) for p in window) // 4
            while left:
                size, out = 1 << (left.bit_length() - 1), []
                left -= size
                while size:
                    doc, start, ids, total = window.pop(0)
                    n = min(size, len(ids) // 4)
                    out.append((doc, start, ids[: 4 * n], total))
                    if 4 * n < len(ids):
                        window.insert(0, (doc, start + n, ids[4 * n :], total))
                    size -= n
                yield out
        self.windows, self.open = {}, 0
        self.count[:] = 0


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack every row's whole text; one output row per piece (see ``SCHEMA``).

    Null and empty texts are the end id alone; repeated rows are packed each; an empty
    table gives no rows; other columns of the input are not read, so their names cannot
    clash.  A very long text fills windows of its own and its rest is placed.  Ties between
    levels take the fullest, then the window opened last, so a retried task packs alike.
    Per task, windows that placement left open are cut up at the end (see
    ``SumOfSquaresPacker``): about one cut for each of them.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        words, packer, rows = WordIds(tokenizer_path), SumOfSquaresPacker(capacity), []
        end = array("I", [end_id]).tobytes()

        def emit(window: list) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in window:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, sequence, offset))
                offset += n
            sequence += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 7
            rows.clear()
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch), strict=True):
                ids = words.encode(text) + end
                total = len(ids) // 4
                for at in range(0, total, capacity):
                    if (full := packer.place((doc, at, ids[4 * at : 4 * (at + capacity)], total))) is not None:
                        emit(full)
                for window in packer.consolidate(packer.most_open):
                    emit(window)
            if len(rows) > 5000:
                yield flush()
        for window in packer.finish():
            emit(window)
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op7_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
