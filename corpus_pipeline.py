"""The corpus pipeline: toxicity, near copies, repeated passages, personal data, packing.

Each stage takes all that the one before it kept, read again from Parquet.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomsheet.llm import minhash, packing, pii, repeats, toxicity
from loomsheet.llm._common import forget_at_exit, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay, unchanged; null and empty texts are scored as empty, repeated rows each."""
    model = toxicity.fit(*toxicity.sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.clean_documents(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, unchanged.

    Documents are told apart by doc_id and text, so no text is lost under a repeated id; of
    rows that repeat both, one stays.  Rows with a null doc_id stay, as do null and empty texts.
    """
    return minhash.one_of_each(docs, every_text=True)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; passages that an earlier document holds are cut out.

    Null texts stay null; a text that goes whole stays as an empty one; rows with a null doc_id stay whole.
    """
    return repeats.clean_documents(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; personal data and the terms that reveal it are replaced; null texts stay null."""
    return pii.clean_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in fixed windows; null and empty texts are their end id alone."""
    return packing.pack(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_copies),
    ("suffix_arrays", cut_repeats),
    ("pii", sanitise),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table gives no rows.

    The results between them are kept in the shared folder until the driver ends.
    """
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    forget_at_exit(spark, root)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
