"""Toxicity: a factorization machine over hashed terms.

A text's terms are its distinct words and the first four and five letters of each longer one. All of them are hashed
into a fixed number of buckets, and every bucket is a feature: a lasso, not a choice beforehand, silences those that
tell nothing. The machine gives every bucket a weight and a vector of
factors; the interaction of two terms is the product of their vectors, so two terms together can say what neither
says alone: an insult with a group's name, or a harsh word that another one makes harmless. It is fitted by
AdaGrad on a bounded sample of labelled texts; scoring is a scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.llm.labelled import SAMPLE_ROWS, labelled_sample
from casekit.llm.text import Words, byte_class, map_batches, mix, raw_texts, reachable, slices
from casekit.sources.files import stage

THRESHOLD = 0.3
BUCKETS = 1 << 20
HEADS = (4, 5)
FACTORS = 4
EPOCHS = 10
BATCH = 64
ROW_LENGTH = 8.0
RATE, FACTOR_RATE = 0.5, 0.05
PAST = 1.0  # where sums of squared gradients start: what a term says once moves it little
SPARSITY = 0.02
FACTOR_START = 0.01
SAMPLE_TERMS = 20_000_000
LETTER = byte_class([*range(65, 91), *range(97, 123), *range(128, 256)])


def hashed_terms(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text's terms, one text after the other, and how many each text has.

    Capitals count as small letters. Letters are A to Z and all that is not ASCII.
    """
    words = Words([t.decode().lower().encode() for t in texts], LETTER)
    if not len(words):
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    spans = [words.hashes]
    owners = [words.owner]
    letters = np.cumsum((words.buffer & 0xC0) != 0x80)
    for n in HEADS:
        ends = np.searchsorted(letters, letters[words.starts] + n)
        longer = ends < words.ends
        spans.append(mix(words.hashed(words.starts[longer], ends[longer]) + np.uint64(n)))
        owners.append(words.owner[longer])
    keys = np.concatenate(owners) * buckets + (np.concatenate(spans) % np.uint64(buckets)).astype(np.int64)
    keys = np.unique(keys)
    return keys % buckets, np.bincount(keys // buckets, minlength=len(texts))


@dataclass(frozen=True)
class Machine:
    """A factorization machine: `weights` (bucket), `factors` (bucket, factor) and a constant.

    A row has the same value for each of its terms, such that its length is `ROW_LENGTH`.
    """

    constant: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Constant, weights and pairwise interactions of each row; its terms lie one row after the other."""
        owner = np.repeat(np.arange(len(counts)), counts)
        x = _values(counts)
        out = self.constant + x * np.bincount(owner, self.weights[terms], len(counts))
        for f in range(self.factors.shape[1]):
            v = self.factors[terms, f].astype(np.float64)
            out += x * x * (np.bincount(owner, v, len(counts)) ** 2 - np.bincount(owner, v * v, len(counts))) / 2
        return out


def _values(counts: np.ndarray) -> np.ndarray:
    return ROW_LENGTH / np.sqrt(np.maximum(counts, 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _moved(old: np.ndarray, gradient: np.ndarray, past: np.ndarray, rate: float) -> np.ndarray:
    """One AdaGrad step, then as much towards zero as the sparsity asks for."""
    step = rate / np.sqrt(past)
    new = old - step * gradient
    return np.sign(new) * np.maximum(np.abs(new) - step * SPARSITY, 0)


def fitted(terms: list[np.ndarray], labels: np.ndarray, buckets: int, factors: int, seed: int) -> Machine:
    """Logistic loss with a lasso, by AdaGrad over batches in a seeded order; a bucket moves only when a batch has it."""
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6))
    constant, constant_past = float(np.log(share / (1 - share))), PAST
    weights, weight_past = np.zeros(buckets), np.full(buckets, PAST)
    v, v_past = rng.normal(0, FACTOR_START, (buckets, factors)), np.full((buckets, factors), PAST)
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for first in range(0, len(order), BATCH):
            rows = order[first : first + BATCH]
            counts = np.array([len(terms[r]) for r in rows])
            known, at = np.unique(np.concatenate([terms[r] for r in rows]), return_inverse=True)
            owner = np.repeat(np.arange(len(rows)), counts)
            x = _values(counts)
            mine = Machine(constant, weights[known], v[known])
            off = _sigmoid(mine.margins(at, counts)) - labels[rows]
            constant_past += off.sum() ** 2
            constant -= RATE * off.sum() / np.sqrt(constant_past)
            gradient = np.bincount(at, (off * x)[owner], len(known))
            weight_past[known] += gradient**2
            weights[known] = _moved(mine.weights, gradient, weight_past[known], RATE)
            for f in range(factors):
                own = mine.factors[at, f]
                sums = np.bincount(owner, own, len(rows))
                gradient = np.bincount(at, (off * x * x)[owner] * (sums[owner] - own), len(known))
                v_past[known, f] += gradient**2
                v[known, f] = _moved(mine.factors[:, f], gradient, v_past[known, f], FACTOR_RATE)
    return Machine(constant, weights.astype(np.float32), v.astype(np.float32))


def _terms(texts: DataFrame, buckets: int) -> DataFrame:
    """(label, terms) of the texts."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            terms, counts = hashed_terms(raw_texts(batch, "text"), buckets)
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), terms.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("label"), lists], ["label", "terms"])

    return map_batches(texts.select("text", "label"), hashed, "label double, terms array<int>")


def fit_machine(
    docs: DataFrame, labels: DataFrame, label: str, held_out: Column, sample_rows: int = SAMPLE_ROWS,
    sample_terms: int = SAMPLE_TERMS, buckets: int = BUCKETS, factors: int = FACTORS, seed: int = 7,
) -> Machine:
    """Learns from at most `sample_rows` labelled documents with at most `sample_terms` terms in all.

    If the sampled texts have more terms, those with more than their part take no part in the fit. The fit is one task
    over that bounded sample; the driver gets the machine, of `buckets` times `factors` + 1 numbers. Without
    labelled rows, or with one label only, the machine is a constant.
    """
    known = stage(_terms(labelled_sample(docs, labels, label, held_out, sample_rows), buckets), "toxicity-sample")
    n, toxic, size = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    if not n or toxic in (0, n):
        return Machine(np.inf if n and toxic else -np.inf, np.zeros(buckets, np.float32), np.zeros((buckets, factors), np.float32))
    if size > sample_terms:
        known = known.where(F.size("terms") <= sample_terms // n)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        terms = [np.asarray(t, np.int64) for t in rows["terms"]]
        order = sorted(range(len(terms)), key=lambda k: (terms[k].tobytes(), rows["label"].iloc[k]))
        machine = fitted([terms[k] for k in order], rows["label"].to_numpy()[order], buckets, factors, seed)
        return pd.DataFrame({"constant": [machine.constant], "weights": [machine.weights.tobytes()], "factors": [machine.factors.tobytes()]})

    reachable(docs.sparkSession)
    row = known.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(fit, "constant double, weights binary, factors binary").first()
    weights = np.frombuffer(row["weights"], np.float32)
    return Machine(row["constant"], weights, np.frombuffer(row["factors"], np.float32).reshape(buckets, factors))


def toxicity_scores(docs: DataFrame, model: Machine, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and score (0 to 1), one row per document. Null texts count as empty; these get the constant's score.

    Ids may be null or repeat. Only the named columns are read; all terms of whole texts count. The machine is broadcast:
    its size is fixed by its number of buckets.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    buckets = len(model.weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in slices(batches, "text"):
            terms, counts = hashed_terms(raw_texts(batch, "text"), buckets)
            scores = _sigmoid(machine.margins(terms, counts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(texts, scored, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, score double")
