"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are counted over the whole text: densities of two learned lexicons, how close
their words stand to the second person, capitals, punctuation, and disguised spellings.
The labelled training rows are split by a hash in three: one part finds the lexicon, one
grows the trees, one calibrates.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import held_out, small_batches, table, text_bytes, within_bytes

#: Bounds of the training sample (labelled rows, bytes of their texts) and of the learned lexicon.
SAMPLE, SAMPLE_BYTES, LEXICON = 9000, 64 << 20, 200
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes ti tus".split())
#: Look-alikes that stand for letters in disguised words.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
PUNCTUATION = "\"#%&'()+,/:;<=>?[\\]^`{|}~…–—«»¿¡"
NAMES = (
    "log_words severe_hits severe_rate mild_rate weight_mean weight_top near_you you_rate capitals shouted_rate "
    "exclaim_rate question_rate punctuation_rate disguised_rate disguised_hits stretched_rate"
).split()
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass
class Lexicon:
    weight: dict[str, float] = field(default_factory=dict)
    severe: frozenset = frozenset()


CLEAN = str.maketrans({c: " " for c in PUNCTUATION})
THRICE = re.compile(r"([^\W\d_])\1\1")


def tokens(text: str) -> list[str]:
    return text.translate(CLEAN).split()


def bare(word: str) -> str:
    return word.strip("!.*-_@$").lower()


def learn_lexicon(texts: list[str], toxic: np.ndarray, most: int = LEXICON) -> Lexicon:
    """Words whose document frequency differs most between the classes, by the z-score of log odds."""
    by: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in zip(texts, toxic.tolist(), strict=True):
        by[y].update({w for w in map(bare, tokens(text)) if w})
    n0, n1 = max(1, int((toxic == 0).sum())), max(1, int((toxic == 1).sum()))
    scored = []
    for w, a in by[1].items():
        if a < 3:
            continue
        b = by[0][w]
        odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
        z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if odds > 0.7 and z > 2.5:
            scored.append((float(z), float(odds), w))
    scored.sort(reverse=True)
    weight = {w: o for _, o, w in scored[:most]}
    return Lexicon(weight, frozenset(w for z, o, w in scored[:most] if o > 2 and z > 4))


def features(text: str, lexicon: Lexicon) -> list[float]:
    """One dense row (``NAMES``); an empty text is all zeros."""
    words = tokens(text)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    chars = len(text)
    plain = [bare(w) for w in words]
    weight, severe = lexicon.weight, lexicon.severe
    hit = [i for i, w in enumerate(plain) if w in weight]
    worst = [i for i in hit if plain[i] in severe]
    odd = [i for i, w in enumerate(words) if not w.isalpha() and any(map(str.isalpha, w))]
    disguised = [i for i in odd if plain[i] not in weight and words[i].lower().translate(DISGUISE) in severe] if odd else []
    bad = sorted({*worst, *disguised})
    you = [i for i, w in enumerate(plain) if w in SECOND_PERSON]
    near = 0
    if bad and you:
        at, where = np.asarray(you), np.asarray(bad)
        after = np.searchsorted(at, where)
        gap = np.minimum(np.abs(at[np.maximum(after - 1, 0)] - where), np.abs(at[np.minimum(after, len(at) - 1)] - where))
        near = int((gap <= 5).sum())
    weights = sorted((weight[plain[i]] for i in hit), reverse=True)
    shouted = sum(map(str.isupper, words))
    letters = sum(map(str.isupper, text))
    return [
        float(np.log1p(n)), float(len(bad)), len(bad) / n, (len(hit) - len(worst)) / n, sum(weights) / n, sum(weights[:3]),
        near / n, len(you) / n, letters / chars, shouted / n, text.count("!") / chars, text.count("?") / chars,
        sum(map(text.count, ".,;:")) / chars, len(odd) / n, float(len(disguised)), sum(1 for _ in THRICE.finditer(text)) / n,
    ]


@dataclass
class Trees:
    """Boosted depth-limited trees on binned features (logistic loss, Newton leaves)."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    depth: int = 3

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, rate: float = 0.15, bins: int = 32, ridge: float = 2.0, least: int = 8) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, k = self.binned(x), x.shape[1]
        prior = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(prior / (1 - prior)))
        score = np.full(len(y), self.base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(y), np.int64)  # the node of each row, heap order
            column, cut = np.full((1 << self.depth) - 1, -1), np.zeros((1 << self.depth) - 1, np.int64)
            for level in range(self.depth):
                for node in range((1 << level) - 1, (2 << level) - 1):
                    rows = np.flatnonzero(at == node)
                    if len(rows) < 2 * least:
                        continue
                    best, total_g, total_h = 1e-3, g[rows].sum(), h[rows].sum()
                    for j in range(k):
                        m = len(self.edges[j]) + 1
                        cg = np.cumsum(np.bincount(b[rows, j], g[rows], m))[:-1]
                        ch = np.cumsum(np.bincount(b[rows, j], h[rows], m))[:-1]
                        cn = np.cumsum(np.bincount(b[rows, j], minlength=m))[:-1]
                        gain = cg**2 / (ch + ridge) + (total_g - cg) ** 2 / (total_h - ch + ridge) - total_g**2 / (total_h + ridge)
                        gain[(cn < least) | (len(rows) - cn < least)] = -1
                        if len(gain) and gain.max() > best:
                            best, column[node], cut[node] = gain.max(), j, int(gain.argmax())
                at = self._step(b, at, column, cut)
            leaf = at - ((1 << self.depth) - 1)
            value = rate * np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + ridge)
            score += value[leaf]
            self.trees.append((column, cut, value))
        return self

    @staticmethod
    def _step(b: np.ndarray, at: np.ndarray, column: np.ndarray, cut: np.ndarray) -> np.ndarray:
        j = column[at]
        right = (j >= 0) & (b[np.arange(len(at)), np.maximum(j, 0)] > cut[at])
        return 2 * at + 1 + right

    def score(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.base)
        for column, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = self._step(b, at, column, cut)
            out += value[at - ((1 << self.depth) - 1)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the non-decreasing fit of y on the score, kept off 0 and 1."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, least score, greatest score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, hi = blocks.pop()
            top = blocks[-1]
            blocks[-1] = [(top[0] * top[1] + m * w) / (top[1] + w), top[1] + w, top[2], hi]
    xs = np.asarray([v for b in blocks for v in (b[2], b[3])])
    ys = np.asarray([(b[0] * b[1] + 0.5) / (b[1] + 1) for b in blocks for _ in (0, 1)])
    return xs, np.maximum.accumulate(ys)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(x))
        raw = self.trees.score(x)
        fine = 1 / (1 + np.exp(-raw))  # a little of the raw score orders rows within a calibrated step
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 * fine, 0, 1)


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Lexicon on a third, trees on a third, calibration on a third (all on each if rows are few)."""
    if len(texts) < 30 or len(set(toxic.tolist())) < 2:
        return Model(Lexicon(), None, None)
    part = np.arange(len(texts)) % 3
    if min(int(toxic[part == k].sum()) for k in range(3)) < 5:
        part = None
    pick = lambda k: np.arange(len(texts)) if part is None else np.flatnonzero(part == k)
    lexicon = learn_lexicon([texts[i] for i in pick(0)], toxic[pick(0)])
    x = np.asarray([features(t, lexicon) for t in texts])
    trees = Trees().fit(x[pick(1)], toxic[pick(1)])
    return Model(lexicon, trees, isotonic(trees.score(x[pick(2)]), toxic[pick(2)]))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """The ``most`` labelled rows outside the held-out fold with the least hash of the id.

    The ids are chosen from the labels alone, so only their texts leave the executors; of
    these, in the order of the hash, as many as hold ``most_bytes`` at most.
    """
    chosen = (
        labels.filter(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")  # ``most`` rows
    rows = within_bytes(rows, most_bytes, F.xxhash64("doc_id"), "doc_id", "text").collect()
    rows.sort(key=lambda r: ((r["doc_id"] * 0x9E3779B97F4A7C15) % (1 << 64), r["text"] or ""))
    return [r["text"] or "" for r in rows], np.asarray([r["toxic"] for r in rows], np.int64)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score of every whole text, in place: no shuffle.

    Null text is empty; an empty text has the score of a row of zeros; repeated rows are
    scored each, equal texts alike; very long texts are counted whole; an empty table gives
    no rows; without training rows every score is 0.  Other columns are not read, so their
    names cannot clash.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray([features(t.decode(), model.lexicon) for t in text_bytes(batch)]).reshape(-1, len(NAMES))
            p = model.predict(x)
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(p, pa.float64()), pa.array(p >= 0.5).cast(pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, SCHEMA)


def clean_documents(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows, all columns as they are, whose score is below ``limit``; null text is scored as empty, repeated rows each."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray([features(t.decode(), model.lexicon) for t in text_bytes(batch)]).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(model.predict(x) < limit, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, fit(*sample(docs, labels)))
