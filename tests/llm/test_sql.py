"""The queries that have SQL against it, on whole tables and on the awkward documents."""

import random

import duckdb
import pytest

from loomsheet.llm import pii, queries, repeats

from . import fixtures


def rows_of(found):
    return sorted((tuple(sorted(zip(found.columns, r, strict=True))) for r in found.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_whole_tables(name, spark, sf):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    want = rows_of(c.sql(queries.oracle_sql()[name]))
    got = queries.queries()[name](spark, sf)
    assert sorted((tuple(sorted(r.asDict().items())) for r in got.collect()), key=str) == want and len(want) > 100


@pytest.mark.parametrize("sql, call", [(repeats.OP2_SQL, repeats.remove_repeated_words), (repeats.OP10_SQL, repeats.remove_repeated_bytes)])
def test_awkward_documents(spark, tmp_path, sql, call):
    df = fixtures.docs(spark)
    df.write.parquet(f"{tmp_path}/documents")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents/*.parquet')")
    assert sorted((tuple(sorted(r.asDict().items())) for r in call(df).collect()), key=str) == rows_of(c.sql(sql))


def test_personal_data_of_all_shapes(spark, tmp_path):
    rng = random.Random(13)
    bits = ["a@b.c", "x.y_@z.co.uk", "a@b.c_d@e.f", "1.2.3.4", "010.0.0.1", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (743) 555-3824", "++49 170 1234567", "Zebulon", "Émile", "b4rd", "_x_y", "Common", " ", " ", " é ", "🙂", "\n", "12 ", "-", ". "]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    rows += [(500 + k, f"Yolanda of Obsidian writes from yol@mail.example {k % 2}") for k in range(20)] + [(600, None), (601, ""), (602, "Yolanda")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df.write.parquet(f"{tmp_path}/documents")
    c = duckdb.connect()
    c.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents/*.parquet')")
    want = rows_of(c.sql(pii.OP4_SQL))
    assert sorted((tuple(sorted(r.asDict().items())) for r in pii.digest(pii.sanitised(df)).collect()), key=str) == want
    assert sum("term" in dict(r)["spans"] for r in want) >= 20
