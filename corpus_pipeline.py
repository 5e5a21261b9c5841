"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Every stage works on all that its predecessor kept and returns the columns of
documents; the last writes the token files and returns their records.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import decontaminate, mixing, simhash, tokenfiles, toxicity
from driftline.llm.shared import remainder, table
from driftline.session import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what scores below the threshold; the model learns from labelled documents of this stage's input.

    Null and empty texts are scored like texts without a toxic word and stay;
    repeated rows are judged alike; an empty table stays empty.
    """
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=~held_out)
    return toxicity.below(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of every group.

    Texts without words, null ones too, are one group; of rows that repeat a
    doc_id one stays; an empty table stays empty.
    """
    return simhash.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what shares no window of words with the benchmark.

    Null texts stay; an empty benchmark keeps all; an empty table stays empty.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass over a document, holding the words taken in it.

    Texts without words have no row; a null source is a source of its own; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return a row per record; texts without words hold the end id alone."""
    return tokenfiles.token_records(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_records", write_token_files),
]
ORACLE_SQL = None  # a trained field decides in the first stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents of ``sf_dir``."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
