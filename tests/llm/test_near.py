"""Near-duplicate vectors and documents, personal data, and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from loomsheet.llm import _common, embeddings, minhash, pii
from loomsheet.llm._common import components

from . import fixtures


def closed(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(400, k) for k in range(401, 450)]
    want = closed({x for l in links for x in l}, links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(n, n) == c for n, c in want.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(_common, "FEW", 10)
    monkeypatch.setattr(_common, "HUB", 5)
    rng = random.Random(2)
    links = [(500, k) for k in range(100, 180)] + [(7, k) for k in range(150, 260)] + [(rng.randint(600, 900), rng.randint(600, 900)) for _ in range(150)]
    want = closed({x for l in links for x in l}, links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(n, n) == c for n, c in want.items())
    rows = spark.createDataFrame(links, "a long, b long")
    values = spark.createDataFrame([(500, "x"), (7, "y"), (601, "z")], "a long, v string")
    for how in ("inner", "left"):
        assert sorted(map(str, _common.hub_join(rows, values, "a", 1000, "b", how).collect())) == sorted(map(str, rows.join(values, "a", how).collect()))
    counted = rows.groupBy("a").count()
    assert sorted(map(str, _common.hub_join(rows, counted, "a", 1000, "b", counted="count").collect())) == sorted(map(str, rows.join(counted, "a").collect()))


def vectors(seed=5):
    rng = np.random.default_rng(seed)
    out, i = [], 0
    for label in (1, 2, None):
        for _ in range(60):
            v = rng.standard_normal(16)
            for _ in range(rng.integers(1, 4)):
                out.append((i, label, [float(x) for x in v + rng.normal(0, 0.05, 16)]))
                i += 1
    hub = rng.standard_normal(16)
    out += [(i + k, 1, [float(x) for x in hub + rng.normal(0, 0.02, 16)]) for k in range(150)]
    i += 150
    out += [(i, 1, [0.0] * 16), (i + 1, 1, None), (i + 2, 1, [float("nan")] + [1.0] * 15), (i + 3, 1, [None] + [1.0] * 15), (i + 4, 1, [1.0] * 3), (i + 5, 1, [])]
    out += [(i + 6, 2, out[70][2]), (i + 7, 2, out[70][2]), (i + 8, 2, [2 * x for x in out[70][2]])]
    return out


def test_vectors_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("vec_id", "label", "cast(embedding as array<float>) embedding").repartition(3)
    rows = [tuple(r) for r in df.collect()]
    good = [(i, l, np.asarray(v, float)) for i, l, v in rows if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a[0], b[0]) for k, a in enumerate(good) for b in good[:k] if a[1] == b[1] and len(a[2]) == len(b[2]) and a[2] @ b[2] / np.linalg.norm(a[2]) / np.linalg.norm(b[2]) >= 0.98]
    n = Counter(x for l in links for x in l)
    want = closed([r[0] for r in rows], links)
    for block in (1024, 32):
        got = embeddings.near_links(df, block=block).collect()
        assert len(got) == len(rows)
        right = sum(r["n_links"] == n[r["vec_id"]] for r in got)
        assert right >= 0.99 * len(rows)
        assert sum(r["component_id"] == want[r["vec_id"]] and r["kept"] == (r["vec_id"] == want[r["vec_id"]]) for r in got) >= 0.99 * len(rows)
    assert embeddings.near_links(df.limit(0)).count() == 0


def test_more_cell_lines_only_lose_at_cells(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, label int, embedding array<double>").filter("label = 1 and size(embedding) = 16")
    df = df.selectExpr("vec_id", "label", "cast(embedding as array<float>) embedding")
    # at a low recall many pairs are lost; a pair found with more cell lines is found with fewer
    few, more = ({r["vec_id"]: r["n_links"] for r in embeddings.near_links(df, recall=0.3, grid=g).collect()} for g in (1, 3))
    assert sum(few.values()) > 0 and all(more[i] <= n for i, n in few.items())


def brute_links(rows):
    """(vec_id, n_links, component_id) of every row; rows that repeat both are one vector."""
    good = lambda r: r[0] is not None and r[1] is not None and r[2] and None not in r[2] and np.isfinite(r[2]).all() and np.any(r[2])
    nodes = sorted({(r[0], r[1], tuple(r[2])) for r in rows if good(r)})
    unit = [np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) for _, _, v in nodes]
    links = [(a, b) for a in range(len(nodes)) for b in range(a) if nodes[a][1] == nodes[b][1] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    n, root = Counter(x for l in links for x in l), closed(range(len(nodes)), links)  # nodes are sorted: the least has the least vec_id
    at = {k: i for i, k in enumerate(nodes)}
    out = []
    for r in rows:
        i = at[r[0], r[1], tuple(r[2])] if good(r) else None
        out.append((r[0], 0, r[0]) if i is None else (r[0], n[i], nodes[root[i]][0]))
    return out


def test_vectors_have_exactly_their_links(spark):
    rng = np.random.default_rng(9)
    centre = rng.standard_normal((40, 16))
    rows = [(i, int(rng.integers(1, 4)), [float(x) for x in centre[i % 40] + rng.normal(0, 0.03, 16)]) for i in range(900)]
    rows += [(9000 + i, 2, [float(x) for x in rng.standard_normal(16)]) for i in range(200)]
    # repeated ids: other vectors, the same vector again, a copy under another id
    rows += [(5, 1, rows[44][2]), (5, 2, [1.0] + [0.0] * 15), (5, 2, [0.0, 1.0] + [0.0] * 14), rows[7], rows[7], (-3, rows[7][1], rows[7][2]), (None, 1, rows[0][2]), (9999, 1, None)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_links(df, recall=0.999999).collect()]
    assert sorted(got, key=str) == sorted(brute_links(rows), key=str)


@pytest.mark.parametrize("told", [0, 100_000])
def test_split_cells_and_small_tasks_change_nothing(spark, monkeypatch, told):
    monkeypatch.setattr(embeddings, "TOLD", told)
    df = spark.createDataFrame(vectors(), "vec_id long, label int, embedding array<double>").repartition(3)
    whole = sorted(map(tuple, embeddings.near_links(df, grid=1).collect()))
    assert sorted(map(tuple, embeddings.near_links(df, grid=1, block=20).collect())) == whole


def test_unlike_vectors_of_one_id_are_apart(spark):
    rows = [(1, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 1, [1.0, 0.01]), (2, 1, [1.0, 0.01])]
    got = embeddings.near_links(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False)]


def test_windows_on_a_line_meet_every_near_pair():
    rng = np.random.default_rng(3)
    group, along = rng.integers(0, 7, 300), rng.standard_normal(300)
    want = {(a, b) for a in range(300) for b in range(a) if group[a] == group[b] and abs(along[a] - along[b]) <= 0.1}
    got = [(max(p), min(p)) for i, j in embeddings.window_pairs(group, along, 0.1) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def multiset(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    a = {int(k): int(c) for k, c in zip(rng.integers(1, 1 << 62, 60), rng.integers(1, 9, 60), strict=True)}
    b = {k: max(1, c + int(rng.integers(-2, 3))) for k, c in list(a.items())[:45]} | {int(k): 2 for k in rng.integers(1, 1 << 62, 10)}
    doc = np.asarray([0] * len(a) + [1] * len(b))
    sig = minhash.signatures(doc, np.asarray([*a, *b], np.uint64), np.asarray([*a.values(), *b.values()]), 2, 6000)
    keys = {*a, *b}
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.03)


def test_classes_against_brute_force(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(120)) for _ in range(12)]
    rows = []
    for i in range(150):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "too few"), (204, "too few"), (205, "na " * 500), (206, "na " * 410), (None, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: multiset(t) for i, t in rows if i is not None}
    links = []
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            low = sum((sets[a] & sets[b]).values())
            total = sum(sets[a].values()) + sum(sets[b].values()) - low
            if low and low / total >= 0.8:
                links.append((a, b))
    want = closed(ids, links)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(df).collect()}
    assert got == want
    kept = minhash.one_of_each(df).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(want.values()))
    assert sum(r["doc_id"] is None for r in kept) == 1
    assert minhash.near_classes(fixtures.empty(spark)).count() == 0


def test_repeated_rows_are_one_document(spark):
    df = fixtures.docs(spark)
    out = minhash.one_of_each(df)
    ids = [r["doc_id"] for r in out.collect()]
    assert out.schema.fieldNames() == df.schema.fieldNames() and len(set(ids)) == len(ids)
    assert 7 not in ids and 3 in ids


def test_every_text_under_a_taken_id_stays(spark):
    df = fixtures.docs(spark)
    out = minhash.one_of_each(df, every_text=True).collect()
    plain = minhash.one_of_each(df).collect()
    texts = lambda rows: Counter((r["doc_id"], r["text"]) for r in rows)
    under_6 = {r[1] for r in fixtures.rows() if r[0] == 6}
    assert len(under_6) == 2 and {t for i, t in texts(out) if i == 6} == under_6
    assert texts(plain) <= texts(out) and len(out) == len(plain) + 1
    assert {r["anchor"] for r in out} == {"a"}  # other columns are carried


def test_what_is_alike_but_unlinked_is_compared_in_blocks(spark):
    """Texts that share six tenths of their words with a leader: some link with each other, none with it."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    common = [word() for _ in range(300)]
    rows = [(0, " ".join(common))]
    for i in range(60):
        tail = [word() for _ in range(70)]
        rows += [(1 + 2 * i, " ".join(common + tail)), (2 + 2 * i, " ".join(common + tail[:60] + [word() for _ in range(10)]))]
    sets = {i: multiset(t) for i, t in rows}
    link = lambda a, b: sum((sets[a] & sets[b]).values()) / sum((sets[a] | sets[b]).values()) >= 0.8
    want = closed(list(sets), [(a, b) for a in sets for b in sets if b < a and link(a, b)])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(df, settle=0.9).collect()}
    assert got == want


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(n if k % 2 == 0 else n * 2 - 9 * (n > 4) for k, n in enumerate(map(int, reversed(d)))) % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()


def base_spans(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m.group())]


def test_base_spans_against_re(spark):
    rng = random.Random(6)
    bits = ["a@b.c", "x.y_@z.co.uk", "a@b.c_d@e.f", "@", "a@b", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "010.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111111111111112", "+1 (743) 555-3824", "+12", "+1234567890123456", "++49 170 1234567", " ", "é", "🙂", "\n", "12 ", "-", "a", "..", "00000000000000000000", "%"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "1.1.1.1 " * 700), (1003, "a" * 20_000), (1004, "1 " * 20_000), (1005, "a." * 5000 + "@" + "b." * 5000), (1006, "+1" + " 2" * 9000)]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, email int, term string, rest string")
    got = {r["doc_id"]: r for r in pii.digest(pii.sanitised(df)).collect()}
    for i, t in rows:
        want = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, t)
        assert got[i]["spans"].startswith(",".join(want))
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(w.startswith(k + ":") for w in want) for k in PATTERNS]
    assert pii.sanitised(fixtures.empty(spark)).count() == 0


def test_terms_that_reveal_are_found_and_others_left(spark):
    rng = random.Random(7)
    filler = lambda: " ".join(rng.choice(["Common", "Plain", "word", "text", "House"]) for _ in range(20))
    rows = [(i, filler()) for i in range(200)]
    rows += [(300 + k, f"{filler()} Zebulon writes from zeb@mail.example {k} {filler()}") for k in range(4)]
    rows += [(400, f"{filler()} Zebulon alone {filler()}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.sanitised(df)).collect()}
    for k in range(4):
        t = dict(rows)[300 + k]
        terms = [s.split(":") for s in got[300 + k]["spans"].split(",") if s.startswith("term")]
        assert [t[int(a) : int(b)] for _, a, b in terms] == ["Zebulon"]
    assert all(got[i]["spans"] == "" for i in range(200)) and got[400]["spans"] == ""
    # share = 1 + log(4 / 5) / log(205 / 4) = 0.943
    out = {r["doc_id"]: r["text"] for r in pii.clean_documents(df).collect()}
    assert "<EMAIL>" in out[300] and "<NAME>" in out[300] and "Zebulon" not in out[300] and out[5] == dict(rows)[5]


def test_terms_of_entities_in_one_text_or_in_copies_are_judged(spark):
    filler = lambda i: f"Common Plain words of House number {i} in some longer text"
    rows = [(i, filler(i)) for i in range(200)]
    rows += [(300, "Common text by Zebulon of Quartzite at zeb@mail.example"), (301, "Common text that names Quartzite alone")]
    rows += [(400 + k, "Plain text by Yolanda of Obsidian at yol@mail.example") for k in range(30)]
    rows += [(500, "Plain text that names Obsidian alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = {(r["entity"], r["term"]): r["share"] for r in pii.disclosing(pii.analysed(df)).collect()}
    # one text: 1 + log(1.5 / 2) / log(233); in two texts, 1.5 / 3 is too little; copies: 1 + log(30 / 31) / log(233 / 30)
    assert marks[("email:zeb@mail.example", "Zebulon")] == pytest.approx(1 + np.log(0.75) / np.log(233))
    assert marks[("email:yol@mail.example", "Yolanda")] == 1
    assert marks[("email:yol@mail.example", "Obsidian")] == pytest.approx(1 + np.log(30 / 31) / np.log(233 / 30))
    assert len(marks) == 3
    out = {r["doc_id"]: r["text"] for r in pii.clean_documents(df).collect()}
    assert out[300] == "Common text by <NAME> of Quartzite at <EMAIL>"
    assert {out[400 + k] for k in range(30)} == {"Plain text by  of <NAME> at <EMAIL>"}
    assert all(out[i] == t for i, t in rows if i < 200 or i in (301, 500))


def test_words_in_failing_matches_and_short_ones_are_judged(spark):
    rows = [(i, f"Common Plain words of House number {i} in some longer text") for i in range(200)]
    rows += [(300, "Common text by Zebulon77 of Bob at zeb@mail.example, 4111 1111 1111 1112 or 999.1.1.10"), (301, "Common text that names Obsidian42 and Ann")]
    rows += [(302, "Plain text by Ann77 of Zoë at +49 170 1234567 not é5@mail.example")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.clean_documents(df).collect()}
    assert out[300] == "Common text by <CODE> of <NAME> at <EMAIL>, <CODE> <CODE> <CODE> <CODE> or <CODE>.1.1.10"
    # a word that a base span cuts is none
    assert out[302] == "Plain text by <CODE> of <NAME> at <PHONE> not é<EMAIL>"
    assert all(out[i] == t for i, t in rows if i not in (300, 302))


def test_clean_documents_keeps_columns(spark):
    df = fixtures.docs(spark)
    out = pii.clean_documents(df)
    assert out.schema.fieldNames() == df.schema.fieldNames() and out.count() == df.count()
    assert [r["text"] for r in out.filter("doc_id = 11").collect()] == [None]


def test_columns_of_any_name_are_carried(spark):
    rows = [(1, "mail a@b.c now", 5, "u", "n", "o"), (2, None, 6, "u", "n", "o"), (1, "mail a@b.c now", 5, "u", "n", "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `_` int, `__null` string, null string, others string")
    out = pii.clean_documents(df)
    assert out.columns == df.columns
    assert sorted(map(str, (r[1:] for r in out.collect()))) == sorted(map(str, [("mail <EMAIL> now", 5, "u", "n", "o")] * 2 + [(None, 6, "u", "n", "o")]))
    kept = minhash.one_of_each(df, every_text=True)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[:2], key=str)


def test_no_python_in_the_plan(spark, capsys):
    pii.op4_information_theoretic_pii(spark, "/root/testdata/sf0.001").explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_pipeline(spark, sf):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, sf).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in pieces}
    assert kept <= docs and len(kept) > 0.5 * len(docs)


def test_stage_columns(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() <= docs.count()


def plain_spans(t):
    return [(m.start(), m.end(), k, m.group()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m.group())]


def plain_sanitised(texts):
    """The texts (of ASCII) by id, with personal data and the terms that reveal it replaced."""
    term = r"(?<!\w)(?=[A-Z]|[A-Za-z]*[0-9_])\w{4,}"
    entities = {i: {(k, v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v)) for *_, k, v in plain_spans(t)} for i, t in texts.items()}
    terms = {}
    for i, t in texts.items():
        for p in PATTERNS.values() if entities[i] else ():
            t = re.sub(p, " ", t)
        terms[i] = set(re.findall(term, t))
    shares = Counter()
    for once in (True, False):  # distinct texts, documents
        ids = list({t: i for i, t in texts.items()}.values()) if once else list(texts)
        n_e, n_t = Counter(e for i in ids for e in entities[i]), Counter(x for i in ids for x in terms[i])
        for (e, x), n in Counter((e, x) for i in ids for e in entities[i] for x in terms[i]).items():
            p = n / n_t[x] if n >= 2 else (n + 0.5) / (n_t[x] + 1)
            shares[e, x] = max(shares[e, x], 1 + np.log(p) / np.log(len(ids) / n_e[e]))
    out = {}
    for i, t in texts.items():
        spans = [(a, b, f"<{k.upper()}>") for a, b, k, _ in plain_spans(t)]
        base = list(spans)
        for m in re.finditer(term, t):
            share = max((shares[e, m.group()] for e in entities[i]), default=0)
            if share >= 0.9 and not any(a < m.end() and m.start() < b for a, b, _ in base):
                spans.append((m.start(), m.end(), "" if share >= 0.999 else "<CODE>" if re.search("[0-9]", m.group()) else "<NAME>"))
        for a, b, tag in sorted(spans, reverse=True):
            t = t[:a] + tag + t[b:]
        out[i] = t
    return out


def test_pipeline_against_a_plain_version(spark, tmp_path):
    import glob
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from loomsheet.llm import packing, toxicity

    from .test_repeats import covered, least, split_bytes

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, bad = {i: text(rng.randint(15, 120)) for i in range(300)}, set(range(0, 300, 4))
    for i in bad:
        rows[i] = f"{text(5)} you {rng.choice(['scoundrel', 'villain', 'dolt'])} {rows[i]}"
    long = text(100).split()
    for k in range(3):
        rows[400 + k] = " ".join([*long[: 40 + k], "changed", *long[41 + k :]])  # near copies
    rows[410], rows[411] = rows[1], rows[2]  # exact copies
    passage = text(15)
    for k in range(3):
        rows[420 + k] = f"{text(20)} {passage} {text(20)}"
    rows[430] = f"{text(12)} Zebulon at Zeb@mail.example and 10.0.0.7 {text(12)}"
    for k in range(3):
        rows[431 + k] = f"{text(12)} Yolanda of b{k}rd writes from yol@mail.example {text(12)}"
    rows[440] = f"{text(12)} call +49 (170) 123-4567 or pay 4111 1111 1111 1111 {text(12)}"
    docs = [(i, t, len(t)) for i, t in rows.items()]
    table = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i in bad)) for i in range(300)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(glob.glob(f"{shared}/pipeline-*"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    (root,) = set(glob.glob(f"{shared}/pipeline-*")) - before
    after = lambda stage: {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{root}/{stage}").collect()}

    model = toxicity.fit(*toxicity.sample(table, labels))
    rejected = {i for i, t in rows.items() if model.predict(np.asarray([toxicity.features(t, model.lexicon)]))[0] >= 0.5}
    assert len(bad & rejected) >= 0.95 * len(bad) and len(rejected - bad) <= 0.05 * len(rows)
    want = {i: t for i, t in rows.items() if i not in rejected}
    assert after("toxicity") == want
    sets = {i: multiset(t) for i, t in want.items()}
    ids, links = sorted(sets), []
    for k, a in enumerate(ids):
        for b in ids[:k]:
            low = sum((sets[a] & sets[b]).values())
            if low and low / (sum(sets[a].values()) + sum(sets[b].values()) - low) >= 0.8:
                links.append((a, b))
    classes = closed(ids, links)
    want = {i: want[i] for i in ids if classes[i] == i}
    assert after("minhash") == want and 400 in want and not {401, 402, 410, 411} & want.keys()
    low = least(list(want.items()), split_bytes, 50)
    cut = {i: bytes(b for b, g in zip(t.encode(), covered(t.encode(), i, low, 50), strict=True) if not g).decode() for i, t in want.items()}
    assert after("suffix_arrays") == cut and passage in cut[420] and all(passage not in cut[i] for i in (421, 422))
    clean = plain_sanitised(cut)
    assert after("pii") == clean
    assert "<NAME>" in clean[430] and "Yolanda" not in clean[431] and "<CARD>" in clean[440] and "<PHONE>" in clean[440]
    whole, at = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY)), Counter()
    tokens = {i: np.asarray([*whole.encode(t, add_special_tokens=False).ids, packing.END_ID], np.uint32) for i, t in clean.items()}
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        i, start = r["doc_id"], r["start"]
        assert start == at[i] and r["doc_tokens"] == len(tokens[i])
        assert r["ids_crc32"] == zlib.crc32(tokens[i][start : start + r["length"]].tobytes())
        at[i] += r["length"]
    assert at == {i: len(x) for i, x in tokens.items()}


def test_pipeline_with_nulls_copies_and_nothing(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from loomsheet.llm import packing

    rows = fixtures.rows()
    fixtures.docs(spark).write.parquet(f"{tmp_path}/some/documents.parquet")
    labels = spark.createDataFrame([(i, 1, i % 7 == 0) for i in range(40)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "cast(toxic as int) toxic")
    for name in ("some", "none"):
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    ids = {r["doc_id"] for r in pieces}
    # null, empty and blank texts, the row without an id, and both texts under id 6 are there; copies are not
    assert {11, 12, 13, None, 3} <= ids and 7 not in ids and ids <= {r[0] for r in rows}
    whole = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    per_id = Counter()
    for r in pieces:
        per_id[r["doc_id"]] += r["length"]
    assert per_id[11] == per_id[12] == 1 and sum(r["start"] == 0 for r in pieces if r["doc_id"] == 6) == 2
    alone = next(r[1] for r in rows if r[0] == 8)  # shares nothing
    assert per_id[8] == len(whole.encode(alone, add_special_tokens=False).ids) + 1 and sum(r["start"] == 0 for r in pieces if r["doc_id"] == 5) == 1
    fixtures.empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("few", [0, 10_000])
def test_marks_by_shuffle_are_those_told_to_all(spark, monkeypatch, few):
    monkeypatch.setattr(pii, "TOLD", 0)
    monkeypatch.setattr(_common, "FEW", few)
    monkeypatch.setattr(_common, "HUB", 3)
    rows = [(i, f"Plain text of House number {i}") for i in range(50)] + [(100 + k, "Plain text by Yolanda of Obsidian at yol@mail.example") for k in range(30)] + [(200, None)]
    out = {r["doc_id"]: r["text"] for r in pii.clean_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {out[100 + k] for k in range(30)} == {"Plain text by  of  at <EMAIL>"} and out[200] is None and out[7] == rows[7][1]


def test_few_links_are_joined_without_rounds(spark, monkeypatch):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(50)] + [(7, k) for k in range(300, 380)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    names = df.selectExpr("concat('n', a) a", "concat('n', b) b")
    with monkeypatch.context() as m:
        for name, n in (("FEW_LINKS", 0), ("FEW", 10), ("HUB", 5)):  # rounds, with hubs
            m.setattr(_common, name, n)
        want = {tuple(r) for r in _common.components(df).collect()}
        by_name = {tuple(r) for r in _common.components(names).collect()}
    monkeypatch.delattr(_common, "with_least")  # a round would need it
    found = _common.components(df)
    assert found.columns == ["node", "component"] and sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 200
    assert {tuple(r) for r in _common.components(names).collect()} == by_name


def test_few_links_of_structs_and_other_values_are_joined(spark, monkeypatch):
    rng = random.Random(8)
    links = [(rng.randint(-90, 90), rng.randint(-90, 90)) for _ in range(110)] + [(-5, k) for k in range(60, 80)]
    df = spark.createDataFrame(links, "a long, b long")
    forms = ["named_struct('rep', {0} div 3, 'k1', {0})", "named_struct('x', nullif({0} div 3, 0), 'y', array(cast({0} as string)))", "cast(cast({0} as string) as binary)", "if({0} = 7, double('NaN'), double({0}))"]
    for form in forms:
        of = df.selectExpr(f"{form.format('a')} a", f"{form.format('b')} b")
        with monkeypatch.context() as m:
            m.setattr(_common, "FEW_LINKS", 0)
            want = sorted(map(str, _common.components(of).collect()))
        with monkeypatch.context() as m:
            m.delattr(_common, "with_least")  # a round would need it
            found = _common.components(of)
        assert sorted(map(str, found.collect())) == want and len(want) > 50
        assert [t for _, t in found.dtypes] == [dict(of.dtypes)["a"]] * 2
