"""The registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casekit.llm.decontamination import contamination
from casekit.llm.html import extract
from casekit.llm.licenses import license_scan
from casekit.llm.oracle import ORACLE  # noqa: F401
from casekit.llm.packing import pack
from casekit.llm.pii import pseudonymize
from casekit.llm.quality import fit_rules, quality_scores
from casekit.llm.quality import THRESHOLD as QUALITY_THRESHOLD
from casekit.llm.repetition import repetition_measures, repetition_verdict
from casekit.llm.simhash import near_duplicates
from casekit.llm.spelling import spelling_variants
from casekit.llm.token_counts import token_counts
from casekit.llm.toxicity import THRESHOLD as TOXICITY_THRESHOLD
from casekit.llm.toxicity import fit_machine, toxicity_scores
from casekit.llm.url_filter import url_verdicts
from casekit.llm.whitening import whiten

VOCABULARY = "word_bpe_49k.json"
KEY = "a key for tests; a deployment passes its own"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(of: int) -> Column:
    """The remainder that decides which documents are held out."""
    return F.crc32(F.col("doc_id").cast("string")) % of


def _judged(scores: DataFrame, held_out: Column, threshold: float) -> DataFrame:
    predicted = (F.col("score") >= threshold).cast("int")
    return scores.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(5) == 0
    model = fit_rules(docs, table(spark, sf_dir, "labels"), "quality", held_out)
    return _judged(quality_scores(docs, model), held_out, QUALITY_THRESHOLD)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.array_join("licenses", ",").alias("licenses"), F.array_join("sentence_ids", ",").alias("sentence_ids"), "n_unknown"
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY, counts_column="found")
    replaced = F.aggregate(F.map_values("found"), F.lit(0).cast("long"), lambda a, n: a + n)
    return done.select("doc_id", "text", replaced.alias("n_replaced"), F.array_join(F.array_sort(F.map_keys("found")), ",").alias("kinds"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(4) == 2
    model = fit_machine(docs, table(spark, sf_dir, "labels"), "toxic", held_out)
    return _judged(toxicity_scores(docs, model), held_out, TOXICITY_THRESHOLD)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition_verdict(repetition_measures(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


# The rules of the URL query, as host, path and action.
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, action string")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_licenses, op3_decontamination, op4_pii, op5_html, op6_tokens, op7_toxicity, op8_packing,
        op9_repetition, op10_simhash, op11_spelling, op12_urls, op13_whitening,
    )
}
