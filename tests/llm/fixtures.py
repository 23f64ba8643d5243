"""Small documents with the awkward cases: nulls, blanks, copies, ties, repeated rows, long texts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchor string, bucket int, th int, email string, term string"


def rows(seed: int = 3, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, line = text(70), text(12)
    out = []
    for i in range(n):
        t = text(rng.randint(1, 150))
        if i % 4 == 1:
            t = f"{t} {passage}\n{text(5)}"
        if i % 5 == 2:
            t = f"{line}\n{t}"
        out.append(t)
    out[7] = out[3]  # an exact copy
    near = out[9].split()
    out[20] = " ".join(["changed", *near[1:]])  # a near copy
    out[11], out[12], out[13], out[14] = None, "", " \t\n ", "é" * 60 + "ß" * 60
    out[15] = "é" * 60 + "ß" * 50 + "x"
    out[16] = "ab" * 400  # one long word, repeated within
    out[17] = ("na " * 300).strip()
    out[18] = f"{text(3000)} {passage}"
    found = [(i, t, ["en", "fr", None][i % 3], "s", len(t) if t is not None else None, "a", 1, 2, "e", "t") for i, t in enumerate(out)]
    found.append(found[5])  # a repeated row
    found.append((6, f"{passage} other text under a taken id", "en", "s", 1, "a", 1, 2, "e", "t"))
    found.append((None, passage, "en", "s", 1, "a", 1, 2, "e", "t"))
    rng.shuffle(found)
    return found


def docs(spark, **kw):
    return spark.createDataFrame(rows(**kw), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
