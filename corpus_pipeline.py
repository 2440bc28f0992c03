"""From raw documents to packed training sequences: five stages, each written before the next one reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from casekit.llm.decontamination import remove_contamination
from casekit.llm.packing import pack
from casekit.llm.pii import pseudonymize
from casekit.llm.quality import fit_rules, keep_good
from casekit.llm.registry import KEY, VOCABULARY, fold
from casekit.llm.simhash import keep_firsts
from casekit.sources.files import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs.select(*COLUMNS), fit_rules(docs, labels, "quality", fold(5) == 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return keep_firsts(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return remove_contamination(docs, items, length_column="n_chars")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for what is personal."""
    return pseudonymize(docs, KEY, length_column="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its sequence and its place there."""
    return pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

# A trained model, fingerprints and tokens are beyond SQL; a test holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
