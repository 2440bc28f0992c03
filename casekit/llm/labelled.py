"""Bounded samples of labelled documents, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
PARTS = 1_000_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, rows: int) -> DataFrame:
    """(text, label) of at most `rows` labelled documents that are not held out, chosen by a hash of their id.

    Rows without a label or an id are passed over; of several labels for one id the largest counts. Only the
    ids and labels are broadcast, and there are at most `rows` of them. Counting the labels is a job.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out)
    known = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    # A share by hash first, a fifth more than wanted, so that the ordered cut sees a bounded number of rows.
    share = -(-PARTS * 6 * rows // (5 * max(1, known.count())))
    near = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) < share)
    chosen = near.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "label")
