"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.language_id import held_out, identify, train
from sparkloom.llm import mixing, ngram_join, pages
from sparkloom.llm import quality as quality_rules
from sparkloom.llm import search, secrets, sentencepiece_scan, toxicity
from sparkloom.llm.token_counts import token_counts


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out())
    return identify(docs.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.encode(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op4_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(mod=5, fold=0))
    return toxicity.score(docs, model).select("doc_id", held_out(mod=5, fold=0).alias("held_out"), "score", "predicted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.search(docs, docs.filter("doc_id % 20 = 0"), query_id="doc_id")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.train(secrets.labelled_findings(spark))
    return secrets.scan(table(spark, sf_dir, "documents"), forest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_language_id": op2_language_id,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_mix_to_weights": op4_mix_to_weights,
        "op5_toxicity": op5_toxicity,
        "op6_quality_rules": op6_quality_rules,
        "op7_topk_search": op7_topk_search,
        "op8_html_text": op8_html_text,
        "op9_token_counts": op9_token_counts,
        "op10_secret_scan": op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": ngram_join.ORACLE,
        "op6_quality_rules": quality_rules.ORACLE,
        "op7_topk_search": search.ORACLE,
    }
