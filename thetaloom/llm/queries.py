"""The queries of this subpackage: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thetaloom.llm import bpe, decontaminate, divergence, fill_middle, licenses, lm_score, near_dedup, quality, secrets, simhash, suffix_dedup, toxicity, url_filter
from thetaloom.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def digest(text) -> F.Column:
    return F.sha2(text.cast("binary"), 256)


@query
def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Three-word shingles, similarity 0.85."""
    found = near_dedup.similar_documents(table(spark, folder, "documents"), size=3, percent=85)
    return found.withColumnRenamed("id", "doc_id")


@query
def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    judged = decontaminate.contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    found = F.col("contamination")
    return judged.select(
        "doc_id", found.n_words.alias("n_words"), found.n_hit.alias("n_hit"), F.size(found["items"]).cast("bigint").alias("n_items"),
        digest(F.array_join(found["items"], ",")).alias("items_sha256"), (found.n_hit > 0).alias("contaminated"),
    )


@query
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.judged(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query
def op1_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of 50 bytes and more that an earlier document has go."""
    left = suffix_dedup.without_repeats(table(spark, folder, "documents"))
    spans = F.arrays_zip("removed_from", "removed_to")
    removed = F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, x: n + x.removed_to - x.removed_from)
    return left.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size(spans).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_bpe_encoding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"))
    tokens = F.octet_length("ids") / 4
    return coded.select("doc_id", tokens.cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


@query
def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """A source is an owner, a source's documents of one language a repository."""
    docs = table(spark, folder, "documents")
    found = secrets.scanned(docs, "doc_id", "text", "source", F.concat_ws("/", "source", "lang"))
    base = F.filter("spans", lambda x: x["rank"] < len(secrets.BASE))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of_kind = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        F.col("id").alias("doc_id"), *[of_kind(kind).alias(f"n_{kind}") for kind, *_ in secrets.BASE],
        digest(listed(base)).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("bigint").alias("n_live"),
    )


def part_of(id: str, parts: int) -> F.Column:
    return F.crc32(F.col(id).cast("string").cast("binary")) % parts


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"), part_of("doc_id", 4) == 2)
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("segments").cast("bigint").alias("n_segments"), "evidence")


@query
def op8_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return lm_score.scored(table(spark, folder, "documents"), part_of("doc_id", 7) == 2, vocabulary).withColumnRenamed("id", "doc_id")


#: (action, host, path) of the listed URLs.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query
def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    labelled = url_filter.labelled_table(spark)
    found = url_filter.judged(table(spark, folder, "pages"), labelled, URL_RULES)
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")


@query
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select("doc_id", licenses.licenses(F.col("text")).alias("found"))
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x.license, x.first_word, x.end_word)), ",")
    names = F.array_join(F.array_sort(F.array_distinct("found.license")), ",")
    return found.select("doc_id", F.size("found").cast("bigint").alias("n_notices"), names.alias("licenses"), spans.alias("spans"), F.array_max("found.coverage").alias("best_coverage"))

@query
def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Half of the texts are cut, four in five of these with the suffix first."""
    found = fill_middle.ordered(table(spark, folder, "documents").select("doc_id", "text"))
    fim = F.col("fim")
    return found.select(
        "doc_id", fim["n"].alias("n"), fim.form.alias("form"), fim.prefix_chars.alias("prefix_chars"), fim.middle_chars.alias("middle_chars"),
        digest(fim.output).alias("output_sha256"), digest(fill_middle.restored(fim.output, fim.form)).alias("restored_sha256"),
    )


@query
def op12_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Three-word shingles, three bits."""
    found = simhash.similar_documents(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hexadecimal("fingerprint").alias("fingerprint"), "component_id")


@query
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Every two sources of a language, and the terms that tell a source from its language."""
    return divergence.audited(table(spark, folder, "documents"))
