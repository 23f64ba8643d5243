"""Packing, fingerprints, pieces, language and toxicity on the awkward documents."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomsheet.llm import fingerprints, language_id, packing, sentencepieces, toxicity

from . import fixtures

WORD_BPE = public_tokenizers.path(packing.VOCABULARY)
PIECES = public_tokenizers.path(sentencepieces.VOCABULARY)
ODD = ["l’été ÇA ẞ straße x\x1c y", "it's I'M <|endoftext|> a<|startoftext|>b", "Σας ½ ² ª 10.5% a_b `x` ~", "\x85 hi ́ a", "don't 'tis rock'n'roll", "", "梦 emoji 🙂▁x  y", "ÀÉ! ß."]


def test_word_ids_are_the_tokenizers():
    words, whole = packing.WordIds(WORD_BPE, limit=20), Tokenizer.from_file(WORD_BPE)
    for t in ODD + [r[1] or "" for r in fixtures.rows()]:
        assert np.frombuffer(words.encode(t.encode()), np.uint32).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_pieces_cover_every_document_once(spark):
    whole = Tokenizer.from_file(WORD_BPE)
    got = packing.pack(fixtures.docs(spark), WORD_BPE).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows] == np.cumsum([0, *(r["length"] for r in rows[:-1])]).tolist()
        total = sum(r["length"] for r in rows)
        assert total == packing.CAPACITY or total & (total - 1) == 0
    want = Counter()
    for i, t, *_ in fixtures.rows():
        want[i] += len(whole.encode(t or "", add_special_tokens=False).ids) + 1
    have = Counter()
    for r in got:
        have[r["doc_id"]] += r["length"]
    assert have == want
    ids = np.asarray([*whole.encode(fixtures.rows(n=40)[0][1] or "", add_special_tokens=False).ids, 1], np.uint32)
    doc = fixtures.rows()[0][0]
    if sum(r[0] == doc for r in fixtures.rows()) == 1:
        for r in got:
            if r["doc_id"] == doc:
                assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]


def test_each_id_lies_in_exactly_one_piece(spark):
    whole = Tokenizer.from_file(WORD_BPE)
    texts = {}
    for i, t, *_ in fixtures.rows():
        texts.setdefault(i, t)
    ids = {i: np.asarray([*whole.encode(t or "", add_special_tokens=False).ids, 1], np.uint32) for i, t in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    got, filled = {}, {}
    for r in packing.pack(df, WORD_BPE).collect():
        got.setdefault(r["doc_id"], []).append(r)
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got.keys() == ids.keys()
    for i, rows in got.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids[i])) and r["length"] > 0
            assert zlib.crc32(ids[i][at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids[i])
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


@pytest.mark.parametrize("most_open", [1, 4, 2048])
def test_few_open_windows_and_few_cuts(most_open):
    rng, packer = random.Random(4), packing.SumOfSquaresPacker(64, most_open)
    windows, sizes = [], [rng.randint(1, 60) for _ in range(700)]
    for k, n in enumerate(sizes):
        if (full := packer.place((k, 0, np.arange(n, dtype=np.uint32).tobytes(), n))) is not None:
            windows.append(full)
        windows += packer.consolidate(most_open)
        assert packer.open == sum(map(len, packer.windows.values())) == packer.count.sum() <= most_open
    still, whole = packer.open, sum(map(len, windows))
    closed = list(packer.finish())
    pieces = [p for w in [*windows, *closed] for p in w]
    for k, n in enumerate(sizes):
        own = sorted((start, len(ids) // 4) for doc, start, ids, _ in pieces if doc == k)
        assert own[0][0] == 0 and sum(x for _, x in own) == n and all(a + x == b for (a, x), (b, _) in zip(own, own[1:], strict=False))
    assert all(sum(len(p[2]) for p in w) // 4 == 64 for w in windows)
    if most_open == 2048:
        assert whole <= len(sizes) and len(pieces) <= len(sizes) + still + 7  # one cut for each window left open, and the last one's


def test_packer_chooses_the_least_sum_of_squares():
    rng, packer = random.Random(1), packing.SumOfSquaresPacker(64)
    for _ in range(500):
        r = rng.randint(1, 64)
        if r < 64:
            n = packer.count.copy()

            def cost(h, n=n, r=r):
                m = n.copy()
                if h:
                    m[h] -= 1
                if h + r < 64:
                    m[h + r] += 1
                return int((m**2).sum())

            options = [0, *[h for h in range(1, 65 - r) if n[h]]]
            assert cost(packer.level(r)) == min(map(cost, options))
        packer.place((0, 0, b"\0" * 4 * r, r))


def test_fingerprints(spark):
    rows = [r for r in fixtures.rows() if r[0] is not None]
    by_id = {}
    for i, t, *_ in rows:
        by_id.setdefault(i, t or "")
    df = spark.createDataFrame([(i, t) for i, t in by_id.items()], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_with_edits(df).collect()}
    ids = sorted(by_id)
    for k, i in enumerate(ids):
        t, after = by_id[i], by_id[ids[(k + 1) % len(ids)]]
        cut = len(t) // 4
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()
        rolling = fingerprints.Rolling()
        mine, edited, theirs = (set(fingerprints.winnow(x, rolling)[0].tolist()) for x in (t, t[: len(t) - cut] + after[:cut], after))
        alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert got[i]["near_next"] == pytest.approx(alike(mine, theirs)) and got[i]["near_edited"] == pytest.approx(alike(mine, edited))
    assert got[7]["fingerprint"] == got[3]["fingerprint"] and got[7]["fingerprint"] != got[4]["fingerprint"]
    with_rest = fingerprints.fingerprint_with_edits(fixtures.docs(spark))
    assert with_rest.count() == len(fixtures.rows())
    assert fingerprints.fingerprint_with_edits(fixtures.empty(spark)).count() == 0
    one = fingerprints.fingerprint_with_edits(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()


def test_winnowing_by_brute_force_and_its_guarantee():
    rolling, rng = fingerprints.Rolling(), random.Random(2)
    for _ in range(30):
        t = "".join(rng.choice("ab") for _ in range(rng.randint(1, 120)))
        k, w = 5, 7
        h, at = fingerprints.winnow(t, rolling, k, w)
        grams = {t[i : i + k]: int(fingerprints.winnow(t[i : i + k], rolling, k, w)[0][0]) for i in range(max(1, len(t) - k + 1))}
        values = [grams[t[i : i + k]] for i in range(max(1, len(t) - k + 1))]
        span = min(w, len(values))
        want = []
        for i in range(len(values) - span + 1):
            low = min(values[i : i + span])
            p = max(j for j in range(i, i + span) if values[j] == low)
            if not want or want[-1][1] != p:
                want.append((low, p))
        assert list(zip(h.tolist(), at.tolist(), strict=True)) == want
    shared = "".join(rng.choice("abcdef") for _ in range(fingerprints.K + fingerprints.W - 1))
    a, b = (fingerprints.winnow(f"{x * 30}{shared}{x * 30}", rolling)[0] for x in "yz")
    assert set(a.tolist()) & set(b.tolist())


def test_pieces_round_trip_and_best_score():
    v = sentencepieces.Vocabulary(PIECES)
    encoder = sentencepieces.Encoder(v, limit=50)
    for t in ODD + [r[1] or "" for r in fixtures.rows()]:
        ids = np.frombuffer(encoder.encode(t), np.int32).tolist()
        assert encoder.decode(ids).decode() == t

    def score(ids, t):
        return sum(v.score.get(v.bytes_of[i].decode("utf-8", "replace"), (0, 0))[1] for i in ids)

    for t in ["hello world", "  two  spaces ", "internationalisation", "aaaaabbbb", "the theatre"]:
        best = [0.0] + [-np.inf] * len(t)
        for i in range(len(t)):
            for j in range(i + 1, min(len(t), i + v.longest) + 1):
                if t[i:j] in v.score:
                    best[j] = max(best[j], best[i] + v.score[t[i:j]][1])
        ids = np.frombuffer(encoder.encode(t), np.int32).tolist()
        assert score(ids, t) == pytest.approx(best[-1])


def test_streaming_commits_early_within_a_bounded_window():
    v = sentencepieces.Vocabulary(PIECES)
    s = sentencepieces.StreamingViterbi(v)
    text = "the quick brown fox " * 500
    parts = [s.feed(text[i : i + 37]) for i in range(0, len(text), 37)]
    early = sum(map(len, parts))
    assert s.width <= 8 * v.longest and early > 1000
    whole = [x for p in parts for x in p] + s.finish()
    assert whole == np.frombuffer(sentencepieces.Encoder(v).encode(text), np.int32).tolist()


def test_cutting_at_runs_loses_no_score():
    v = sentencepieces.Vocabulary(PIECES)
    encoder, search = sentencepieces.Encoder(v, limit=5), sentencepieces.StreamingViterbi(v)

    def score(ids):  # bytes stand for characters outside the vocabulary
        return len([i for i in ids if i in v.byte_id.values()]), sum(v.score[p][1] for i in ids if (p := v.bytes_of[i].decode("utf-8", "replace")) in v.score)

    rng = random.Random(5)
    mixed = ["".join(rng.choice("ab e.,!²(\n'₹é-_▁9") for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    for t in ODD + mixed + [(r[1] or "")[:3000] for r in fixtures.rows()]:
        assert "".join(encoder.cut(t)) == t
        whole = search.feed(t) + search.finish()
        got = np.frombuffer(encoder.encode(t), np.int32).tolist()
        assert score(got) == (score(whole)[0], pytest.approx(score(whole)[1]))


def plain_viterbi(v, text):
    """Ids of the best segmentation, whole text at once; of equal scores the first found."""
    best, back = [0.0] + [-np.inf] * len(text), [None] * (len(text) + 1)
    for i in range(len(text)):
        if text[i] not in v.score:
            if best[i] + v.fallback > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + v.fallback, (i, None)
        for j in range(i + 1, min(len(text), i + v.longest) + 1):
            if (found := v.score.get(text[i:j])) and best[i] + found[1] > best[j]:
                best[j], back[j] = best[i] + found[1], (i, found[0])
    out, j = [], len(text)
    while j:
        i, piece = back[j]
        out += [piece] if piece is not None else [v.byte_id[b] for b in reversed(text[i:j].encode())]
        j = i
    return out[::-1]


def test_stream_in_parts_of_any_size_is_the_plain_search():
    v = sentencepieces.Vocabulary(PIECES)
    rng = random.Random(11)
    mixed = ["".join(rng.choice("abcde e.,!²(\n'₹é-_▁9") for _ in range(rng.randrange(1, 150))) for _ in range(60)]
    long = ["x" * 300 + " " * 90 + "the" * 100, "." * 200 + "a b" + "internationalisation" * 20, "  lead", "trail  "]
    for t in ODD + mixed + long + [(r[1] or "")[:2000] for r in fixtures.rows()]:
        want = plain_viterbi(v, t)
        score = lambda ids: sum(v.score[p][1] if (p := v.bytes_of[i].decode("utf-8", "replace")) in v.score else 0 for i in ids)
        for part in (1, 7, 64, 1 << 20):
            s = sentencepieces.StreamingViterbi(v, limit=9)
            got = [x for k in range(0, len(t), part) for x in s.feed(t[k : k + part])] + s.finish()
            assert b"".join(v.bytes_of[i] for i in got).decode() == t
            # equal, but for ties whose sums round otherwise
            assert got == want or score(got) == pytest.approx(score(want), abs=1e-6)
            assert s.width <= 8 * v.longest + sentencepieces.LONG_RUN


def test_the_pieces_query(spark, sf):
    v = sentencepieces.Vocabulary(PIECES)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sentencepieces.op6_streaming_viterbi_pieces(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["round_trip"] and b"".join(v.bytes_of[i] for i in r["ids"]).decode() == (texts[r["doc_id"]] or "")
        assert r["n_ids"] == len(r["ids"]) and r["ids_sha256"] == hashlib.sha256(np.asarray(r["ids"], np.int32).tobytes()).hexdigest()


def test_long_texts_are_split_over_batches(spark, monkeypatch):
    monkeypatch.setattr(sentencepieces, "BATCH_BYTES", 500)
    df = fixtures.docs(spark)
    rows = sentencepieces.decode(sentencepieces.encode(df, PIECES), PIECES).collect()
    assert len(rows) == df.count() and all(r["decoded"] == r["text"] for r in rows)


def test_encode_and_decode_frames(spark):
    df = fixtures.docs(spark).withColumnRenamed("anchor", "ids")
    out = sentencepieces.decode(sentencepieces.encode(df, PIECES), PIECES).collect()
    assert len(out) == df.count() and all(r["decoded"] == r["text"] for r in out)
    assert sentencepieces.encode(fixtures.empty(spark), PIECES).count() == 0


def test_language_codes_and_training(spark):
    code = language_id.code_matrix(9)
    apart = [(code[i] != code[j]).sum() for i in range(9) for j in range(i)]
    assert min(apart) >= 5
    texts, langs = [], []
    rng = random.Random(4)
    for lang, alphabet in (("aa", "abcde"), ("bb", "fghij"), ("cc", "klmno")):
        for _ in range(60):
            texts.append("".join(rng.choice(alphabet + " ") for _ in range(50)).encode())
            langs.append(lang)
    model = language_id.fit(texts, langs)
    best, p, lead = model.decode(language_id.counts([b"abc edc bca", b"klm onk", b"fgh ijf"]))
    assert [model.languages[i] for i in best] == ["aa", "cc", "bb"] and (p <= 1).all() and (lead >= 0).all()
    rows = language_id.identify(fixtures.docs(spark), model).collect()
    assert len(rows) == len(fixtures.rows())
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (11, 12, 13))
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in rows if r["doc_id"] is not None)
    assert language_id.identify(fixtures.empty(spark), None).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(fixtures.docs(spark), language_id.fit([], [])).collect()} == {"und"}


def test_decoding_against_brute_force():
    """Counts by plain slices, margins bit by bit, the loss of every codeword."""
    rng = random.Random(6)
    texts = ["".join(rng.choice(a + " ") for _ in range(rng.randint(3, 60))).encode() for a in ("abcd", "cdef", "efgh", "ghij") * 30]
    langs = ["p", "q", "r", "s"] * 30
    model = language_id.fit(texts, langs)

    def plain(text):
        out = np.zeros(language_id.FEATURES)
        for order in language_id.ORDERS:
            for i in range(len(text) - order + 1):
                gram = 0
                for b in text[i : i + order]:
                    gram = (gram * 257 + b + 1) % (1 << 64)
                h = language_id.mix64(np.asarray([(gram + (order << 40)) % (1 << 64)], np.uint64))[0]
                out[int(h) % language_id.FEATURES] += 1
        return out

    for text in [*texts[:12], b"a", "é".encode(), b"zzz cd"]:
        x = plain(text)
        assert (language_id.counts([text])[0] == x).all()
        margin = [float(x @ model.weights[:, b]) / x.sum() * model.scale[b] for b in range(model.code.shape[1])]
        loss = [sum(model.trust[b] * np.log1p(np.exp(-np.clip(m * c[b], -30, 30))) for b, m in enumerate(margin)) for c in model.code]
        p = np.exp(-np.asarray(loss))
        p /= p.sum()
        best, score, lead = model.decode(language_id.counts([text]))
        assert best[0] == p.argmax() and score[0] == pytest.approx(p.max(), rel=1e-4)
        assert lead[0] == pytest.approx(np.sort(p)[-1] - np.sort(p)[-2], abs=1e-4)


def test_samples_are_bounded_in_rows_and_bytes(spark):
    rows = [(i, "x" * 100, "en" if i % 3 else "fr") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    texts, langs = language_id.sample(df, 50)
    assert Counter(langs) == {"en": 50, "fr": 50}
    assert len(language_id.sample(df, 50, most_bytes=1250)[0]) == 12
    labels = df.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic")
    assert len(toxicity.sample(df, labels, most=80)[0]) == 80 and len(toxicity.sample(df, labels, most=80, most_bytes=999)[0]) == 9


def test_held_out_language(spark, sf):
    from loomsheet.llm._common import table

    rows = language_id.op1_error_correcting_language_id(spark, sf).collect()
    truth = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert np.mean(held) > 0.95


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] > 0.5)).astype(int)
    t = toxicity.Trees().fit(x[:1500], y[:1500])
    assert ((t.score(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    xs, ys = toxicity.isotonic(np.asarray([1, 2, 3, 4, 5.0]), np.asarray([0, 1, 0, 1, 1]))
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()


def test_isotonic_fit_against_brute_force():
    """The fit is the greatest of the least means of all stretches around a row."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(1, 25))
        score, y = np.sort(rng.choice(1000, n, replace=False)).astype(float), rng.integers(0, 2, n).astype(float)
        want = [max(min(y[i : j + 1].mean() for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        xs, ys = toxicity.isotonic(score, y)
        # kept off 0 and 1 by half a row of the block
        size = [sum(abs(w - v) < 1e-12 for w in want) for v in want]
        assert np.interp(score, xs, ys).tolist() == pytest.approx(np.maximum.accumulate([(v * s + 0.5) / (s + 1) for v, s in zip(want, size, strict=True)]).tolist())


def test_trees_choose_the_best_cut_and_newton_leaves():
    rng = np.random.default_rng(5)
    x = rng.random((120, 3)).round(1)
    y = (x[:, 1] + rng.normal(0, 0.2, 120) > 0.5).astype(int)
    t = toxicity.Trees(depth=1).fit(x, y, rounds=1, rate=1.0, ridge=2.0, least=8)
    p = y.mean()
    g, h = y - p, np.full(120, p * (1 - p))
    best = (-np.inf, None)
    for j in range(3):
        for edge in t.edges[j]:
            left = x[:, j] < edge
            if 8 <= left.sum() <= 112:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 2) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 2)
                best = max(best, (gain, j, edge), key=lambda b: b[0])
    _, j, edge = best
    left = x[:, j] < edge
    want = np.log(p / (1 - p)) + np.where(left, g[left].sum() / (h[left].sum() + 2), g[~left].sum() / (h[~left].sum() + 2))
    assert t.score(x) == pytest.approx(want)


def test_capitals_are_counted_over_the_whole_text():
    row = toxicity.features("yOu iDiOt", toxicity.Lexicon({}, frozenset()))
    assert row[toxicity.NAMES.index("capitals")] == 3 / 9


def test_toxicity_learns_words_and_disguises(spark):
    rng = random.Random(0)
    words = [f"w{chr(97 + i)}{chr(98 + i % 20)}x" for i in range(25)]
    texts, y = [], []
    for i in range(600):
        bad = i % 4 == 0
        t = [rng.choice(words) for _ in range(30)]
        if bad:
            t[5:5] = ["you", rng.choice(["scoundrel", "villain", "dolt"])]
        texts.append(" ".join(t))
        y.append(int(bad))
    model = toxicity.fit(texts, np.asarray(y))
    p = model.predict(np.asarray([toxicity.features(t, model.lexicon) for t in (texts[1], texts[0], "you sc0undrel " + texts[1], "")]))
    assert p[0] < 0.5 <= p[1] and p[2] > p[0] and 0 <= p[3] < 0.5
    df = fixtures.docs(spark)
    rows = toxicity.score(df, model).collect()
    assert len(rows) == df.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert toxicity.clean_documents(df, model).schema == df.schema
    assert toxicity.score(fixtures.empty(spark), toxicity.fit([], np.asarray([], int))).count() == 0


def test_held_out_toxicity(spark):
    from loomsheet.llm._common import table

    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    rows = [(r["score"], labels[r["doc_id"]]) for r in toxicity.op9_boosted_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in rows if not y], [s for s, y in rows if y]
    assert np.mean([(b > g) + (b == g) / 2 for b in bad for g in good]) > 0.7
