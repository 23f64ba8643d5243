import hashlib
import random

import numpy as np
import pytest

from loomsheet.llm import repeats, suffix_arrays
from loomsheet.llm.suffix_arrays import kasai, repeated_windows, suffix_array

from . import fixtures


def covered(tokens, i, low, length):
    gone = np.zeros(len(tokens), bool)
    for k in range(len(tokens) - length + 1):
        if i is not None and low[tuple(tokens[k : k + length])] < i:
            gone[k : k + length] = True
    return gone


def least(rows, split, length):
    low = {}
    for i, t, *_ in rows:
        x = split(t)
        for k in range(len(x) - length + 1):
            if i is not None:
                low[tuple(x[k : k + length])] = min(i, low.get(tuple(x[k : k + length]), 1 << 62))
    return low


def split_words(t):
    return (t or "").encode().split()


def split_bytes(t):
    return (t or "").encode()


def test_words_against_brute_force(spark):
    rows = fixtures.rows()
    low = least(rows, split_words, 50)
    want = []
    for i, t, *_ in rows:
        x = split_words(t)
        gone = covered(x, i, low, 50)
        kept = b" ".join(w for w, g in zip(x, gone, strict=True) if not g)
        want.append((i, len(x), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in repeats.remove_repeated_words(fixtures.docs(spark)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[2] for x in want) > 200


def test_bytes_against_brute_force(spark):
    rows = fixtures.rows()
    low = least(rows, split_bytes, 50)
    want = []
    for i, t, *_ in rows:
        x = split_bytes(t)
        gone = covered(x, i, low, 50)
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        want.append((i, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in repeats.remove_repeated_bytes(fixtures.docs(spark)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_small_flushes_and_shards_change_nothing(spark, monkeypatch):
    whole = sorted(map(tuple, repeats.remove_repeated_bytes(fixtures.docs(spark)).collect()), key=str)
    monkeypatch.setattr(repeats, "FLUSH", 50)
    monkeypatch.setattr(repeats, "FLUSH_BYTES", 500)
    assert sorted(map(tuple, repeats.remove_repeated_bytes(fixtures.docs(spark)).collect()), key=str) == whole


def very_repetitive(spark):
    long = ("na " * 4000).strip()
    line = "a line of thirty bytes or so"
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, f"{noise(90)}{line}{noise(90)}") for i in range(60)] + [(70, long), (71, "x " + long), (72, long[:900]), (-(1 << 63), long[:600])]
    rows += [(80 + i, f"{noise(60)}{line} {line}{noise(60)}") for i in range(40)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("hot", [5, 10**9])
def test_hot_anchors_and_long_repetitive_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows, df = very_repetitive(spark)
    low = least(rows, split_bytes, 50)
    want = []
    for i, t in rows:
        gone = covered(t.encode(), i, low, 50)
        want.append((i, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum())))
    got = [tuple(r)[:4] for r in repeats.remove_repeated_bytes(df).collect()]
    assert sorted(got) == sorted(want)
    low = least(rows, split_words, 50)
    want = [(i, len(t.split()), int(covered(t.encode().split(), i, low, 50).sum())) for i, t in rows]
    assert sorted(tuple(r)[:3] for r in repeats.remove_repeated_words(df).collect()) == sorted(want)


def test_merging_in_ranges_changes_nothing(monkeypatch):
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(10, 90))) for _ in range(80)]
    doc = np.asarray([rng.randint(0, 30) for _ in texts])
    whole = [x.tolist() for x in repeated_windows(texts, doc, 12, 1 << 20)]
    monkeypatch.setattr(suffix_arrays, "RANGE", 40)
    pairs = lambda got: {(e, a + k) for e, a, n in zip(*got, strict=True) for k in range(n)}
    assert pairs(x.tolist() for x in repeated_windows(texts, doc, 12, 200)) == pairs(whole)


def test_runs_of_equal_hash_are_compared_by_bytes(spark, monkeypatch):
    whole = sorted(map(tuple, repeats.remove_repeated_bytes(fixtures.docs(spark).coalesce(1)).collect()), key=str)
    monkeypatch.setattr(repeats, "mix64", lambda x: np.zeros(len(x), np.uint64))  # every run of an anchor collides
    assert sorted(map(tuple, repeats.remove_repeated_bytes(fixtures.docs(spark).coalesce(1)).collect()), key=str) == whole


def test_stage_keeps_rows_columns_and_valid_text(spark):
    df = fixtures.docs(spark)
    out = repeats.clean_documents(df)
    assert out.schema == df.schema
    rows = out.collect()
    assert len(rows) == df.count()
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
    assert sum(r["text"] is None for r in rows) == 1


def test_empty_table(spark):
    assert repeats.remove_repeated_words(fixtures.empty(spark)).count() == 0
    assert repeats.remove_repeated_bytes(fixtures.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_suffix_array_and_prefixes(seed):
    rng = random.Random(seed)
    text = bytes(rng.choice(b"ab" if seed % 2 else b"abc\0\xff") for _ in range(rng.randint(1, 600)))
    symbols = np.frombuffer(text, np.uint8).astype(np.uint16) + 1
    symbols[rng.sample(range(len(symbols)), len(symbols) // 50)] = 0
    sa = suffix_array(symbols)
    x = symbols.tolist()
    assert sa.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
    lcp = kasai(symbols, sa, 40)
    for k in range(1, len(sa)):
        a, b, n = x[sa[k - 1] :], x[sa[k] :], 0
        while n < min(len(a), len(b), 40) and a[n] == b[n] and a[n]:
            n += 1
        assert lcp[k] == n


@pytest.mark.parametrize("seed", range(6))
def test_terminators_of_their_own(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 5, 9, 40]))) for _ in range(30)]
    x, left, plain = [], [], []
    for k, t in enumerate(texts):
        x += [b + 1 for b in t] + [0]
        left += range(len(t), -1, -1)
        plain += [b + 100 for b in t] + [k]  # terminators in the order of the texts
    symbols = np.asarray(x, np.uint16)
    sa = suffix_array(symbols, np.asarray(left))
    assert sa.tolist() == sorted(range(len(x)), key=lambda i: plain[i:])
    lcp = kasai(symbols, sa, 8)
    for k in range(1, len(sa)):
        a, b, n = x[sa[k - 1] :], x[sa[k] :], 0
        while n < min(len(a), len(b), 8) and a[n] == b[n] and a[n]:
            n += 1
        assert lcp[k] == n


@pytest.mark.parametrize("shard", [60, 400, 1 << 20])
def test_windows_over_shards(shard):
    rng = random.Random(shard)
    base = [bytes(rng.choice(b"abc") for _ in range(40)) for _ in range(5)]
    texts = [b"".join(rng.choice(base) for _ in range(rng.randint(0, 3))) for _ in range(40)]
    doc = np.asarray([rng.randint(0, 15) for _ in texts])
    low = {}
    for t, i in zip(texts, doc.tolist(), strict=True):
        for k in range(len(t) - 19):
            low[t[k : k + 20]] = min(i, low.get(t[k : k + 20], 99))
    want = {(e, k) for e, t in enumerate(texts) for k in range(len(t) - 19) if low[t[k : k + 20]] < doc[e]}
    which, first, starts = repeated_windows(texts, doc, 20, shard)
    assert {(e, a + k) for e, a, n in zip(which.tolist(), first.tolist(), starts.tolist(), strict=True) for k in range(n)} == want
