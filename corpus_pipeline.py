"""A corpus pipeline over the table `documents`: language, near-duplicates, secrets, source mix, pieces.

Each stage reads the Parquet that the one before it wrote, whole, and all but the last return the columns of
`documents`. Empty tables give empty ones in every stage; nulls and repeated rows are treated as the operators say:
null and letterless texts go in the first stage, rows with a null id or source are kept, and repeated rows of a kept id
stay rows of their own until the mix, which takes each by itself. Columns beyond those of `documents` pass through.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import language_id, mixing, ngram_join, secrets, sentencepiece_scan
from sparkloom.llm.components import checkpoint_dir, shrink_executors, tidy
from sparkloom.llm.queries import table, tokenizer_path

#: SQL can't express these stages (trained models, iterations); tests hold them against plain versions.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language, with `lang` as predicted; those without a letter go.

    Where no row outside the held-out fold has a language, nothing can be learned and every document is rejected.
    """
    model = language_id.train(docs, ~language_id.held_out())
    found = language_id.identify(docs, model, pred_col="__pred", score_col="__score").filter("__pred <> 'und'")
    return found.withColumn("lang", F.col("__pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates."""
    return ngram_join.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with found secrets masked."""
    forest = secrets.train(secrets.labelled_findings(spark))
    return secrets.redact(docs, forest).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks."""
    return mixing.take(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document, and whether they decode to its text."""
    return sentencepiece_scan.encode(docs, tokenizer_path())


def tidied(stage):
    """`stage` on a driver and executors that have given back what the stages before it left."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tidy(spark)
        shrink_executors(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", tidied(language)),
    ("ngram_join", tidied(near_duplicates)),
    ("secret_scan", tidied(secret_scan)),
    ("mix_to_weights", tidied(source_mix)),
    ("sentencepiece", tidied(pieces)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = os.path.join(checkpoint_dir(spark), f"corpus-{uuid.uuid4().hex}")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
