"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword of +-1 bits.  One binary n-gram classifier per bit predicts
it from hashed byte n-grams of the lower-cased text; a text gets the language whose
codeword has the least weighted logistic loss, each bit weighted by how well its
classifier did on training rows it had not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import U64, chunks_by_size, held_out, mix64, small_batches, table, text_bytes, within_bytes

#: n-gram orders, hashed features, training texts per language and their bytes in all (the bounds of the sample).
ORDERS, FEATURES, PER_LANGUAGE, SAMPLE_BYTES = (1, 2, 3), 1 << 13, 1000, 64 << 20
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, margin double, ambiguous boolean"


def code_matrix(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +-1 bits, far apart: all splits for few languages, else the best of random codes."""
    if n <= 5:
        bits = [[1 if (c >> (n - 1 - i)) & 1 else -1 for c in range(1, 1 << (n - 1))] for i in range(n)]
        code = np.asarray(bits, np.int8).reshape(n, -1)
        return code if n > 1 else np.ones((1, 1), np.int8)
    width = max(15, int(np.ceil(10 * np.log2(n))))
    rng, best, score = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.asarray([-1, 1], np.int8), (n, width))
        apart = (width - code.astype(int) @ code.T.astype(int)) // 2
        worst = apart[~np.eye(n, dtype=bool)].min()
        mixed = (np.abs(code.sum(0)) < n).all()
        if mixed and worst > score:
            best, score = code, worst
    return best


def counts(texts: list[bytes], features: int = FEATURES) -> np.ndarray:
    """Hashed n-gram counts, one float row per text; n-grams never cross texts."""
    n = len(texts)
    sizes = np.fromiter((len(x) for x in texts), np.int64, n)
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(U64)
    doc = np.repeat(np.arange(n), sizes)
    out = np.zeros(n * features, np.float32)
    gram = np.zeros(len(flat), U64)
    for order in range(1, max(ORDERS) + 1):
        m = len(flat) - order + 1
        if m <= 0:
            break
        gram = gram[:m] * U64(257) + flat[order - 1 :] + U64(1)
        if order in ORDERS:
            same = doc[:m] == doc[order - 1 :]
            at = doc[:m] * features + (mix64(gram + U64(order << 40)) % U64(features)).astype(np.int64)
            out += np.bincount(at[same], minlength=n * features).astype(np.float32)
    return out.reshape(n, features)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # features x bits: log likelihood ratios
    scale: np.ndarray  # per bit: slope of the margin
    trust: np.ndarray  # per bit: weight of its loss

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest codeword, its probability, lead over the second)."""
        margin = (x @ self.weights) / np.maximum(x.sum(1, keepdims=True), 1) * self.scale
        loss = np.log1p(np.exp(-np.clip(margin[:, None, :] * self.code[None], -30, 30))) @ self.trust
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        order = np.sort(p, 1)
        best = p.argmax(1)
        lead = order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0)
        return best, order[:, -1], lead


def fit(texts: list[bytes], langs: list[str]) -> Model | None:
    """Learn the bit classifiers; a fifth of the rows sets the slopes and the bits' weights.

    Counts are summed by language as they are made, so no row of them is kept.
    """
    if not texts:
        return None
    languages = sorted(set(langs))
    code = code_matrix(len(languages))
    number = {x: i for i, x in enumerate(languages)}
    y = np.asarray([number[x] for x in langs])
    aside = np.arange(len(y)) % 5 == 4 if len(y) >= 10 * len(languages) else np.zeros(len(y), bool)
    for k in range(len(languages)):  # a language that would only be aside is learned from too
        aside[y == k] &= not aside[y == k].all()
    by_language = np.zeros((len(languages), FEATURES))
    for i, j in chunks_by_size(texts, 1_000_000):
        np.add.at(by_language, y[i:j][~aside[i:j]], counts(texts[i:j])[~aside[i:j]])
    rate = (by_language + 0.5) / (by_language + 0.5).sum(1, keepdims=True)  # each language weighs the same
    weights = np.stack([np.log(rate[c > 0].mean(0)) - np.log(rate[c < 0].mean(0)) if (c > 0).any() and (c < 0).any() else np.zeros(FEATURES) for c in code.T], 1)
    test = np.flatnonzero(aside if aside.any() else ~aside)
    apart, parts = [texts[i] for i in test.tolist()], []
    for i, j in chunks_by_size(apart, 1_000_000):
        x = counts(apart[i:j])
        parts.append((x @ weights) / np.maximum(x.sum(1, keepdims=True), 1))
    raw = np.concatenate(parts)
    right = raw * code[y[test]]
    scale = 4 / np.maximum(np.median(np.abs(raw), 0), 1e-9)
    error = np.clip(((right <= 0).mean(0) * len(right) + 1) / (len(right) + 2), 1e-3, 0.499)
    trust = np.log((1 - error) / error)
    return Model(languages, code, weights.astype(np.float32), scale, trust / trust.sum() * min(4, code.shape[1]))


def sample(docs: DataFrame, per_language: int, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list[str]]:
    """At most ``per_language`` training texts of each language, those with the least hash of the id.

    Of all of them, in the order of the hash, as many as hold ``most_bytes`` at most.
    """
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("h"))
    each = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not each:
        return [], []
    # a share by hash with some to spare, so that few rows are ranked
    share = F.create_map(*[F.lit(v) for k, n in each.items() for v in (k, min(1.0, (1.2 * per_language + 100) / n))])
    some = rows.filter(F.pmod("h", F.lit(1 << 20)) / float(1 << 20) < share[F.col("lang")])
    order = ("h", "doc_id", "text")
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= per_language)
    got = within_bytes(ranked, most_bytes, *order).orderBy(*order).select("text", "lang").collect()
    return [r["text"].lower().encode() for r in got], [r["lang"] for r in got]


def identify(docs: DataFrame, model: Model | None, ambiguous_below: float = 0.2) -> DataFrame:
    """Language of every whole text.

    ``und`` with score 0 if the text is null, empty or without a letter, or if there was
    nothing to learn from.  Of languages with equal loss the first by name is taken, and
    the row is ambiguous.  Very long texts are counted whole.  Repeated rows are answered
    each; an empty table gives no rows.  Other columns are not read, so their names cannot
    clash.
    """
    small_batches(docs.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in batches:
            texts = [x.decode() for x in text_bytes(batch)]
            n = len(texts)
            lang, score, lead = [UNKNOWN] * n, np.zeros(n), np.zeros(n)
            known = [i for i, x in enumerate(texts) if model and letter.search(x)]
            lower = [texts[i].lower().encode() for i in known]
            for a, b in chunks_by_size(lower, 500_000):
                best, p, d = model.decode(counts(lower[a:b]))
                score[known[a:b]], lead[known[a:b]] = p, d
                for i, k in zip(known[a:b], best.tolist(), strict=True):
                    lang[i] = model.languages[k]
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(np.clip(score, 0, 1)), pa.array(lead), pa.array(lead < ambiguous_below)]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, SCHEMA)


def op1_error_correcting_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(*sample(docs, PER_LANGUAGE)))
