"""A cleaning pipeline over ``documents``: each stage is an operator of :mod:`thetaloom.llm` whose decisions take effect."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thetaloom.llm import bpe, decontaminate, near_dedup, quality, secrets
from thetaloom.llm.scratch import written
from thetaloom.llm.workers import LONG_ROWS


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality rules reject go: the base rules, and the bands by language from the table itself. A null
    text has no words and goes."""
    _long_rows(spark)
    return quality.kept_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    _long_rows(spark)
    return near_dedup.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Passages of benchmark items are cut from the texts; a text of which more than half is such passages goes."""
    _long_rows(spark)
    return _counted(decontaminate.decontaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet")))


def secret_scans(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Live-looking secrets are masked; examples that many sources copy stay."""
    _long_rows(spark)
    return _counted(secrets.redacted(docs, "doc_id", "text", "source", F.concat_ws("/", "source", "lang")))


def bpe_encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Each document's token ids as little-endian unsigned 32-bit integers, and the text decoded from them."""
    _long_rows(spark)
    coded = bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", "decoded")


def _long_rows(spark: SparkSession) -> None:
    """Rows are whole documents here, so that the default of 10,000 a batch makes batches that are too large for a small
    executor: the session goes on with smaller ones. It changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", LONG_ROWS)


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars`` as the text now has it."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("bpe_encoding", bpe_encoding),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if at + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs


ORACLE_SQL = None
"""The quality rules rest on a subword vocabulary, which SQL doesn't have."""
