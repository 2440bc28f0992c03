"""Helpers of the text operators: bounded slices of Arrow batches, and numpy hashes of words and n-grams."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SLICE_BYTES = 1 << 20
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACES = b" \t\n\x0b\x0c\r"


def byte_class(members: bytes | range) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


SPACE = byte_class(SPACES)


def reachable(spark: SparkSession) -> None:
    """Puts this library on the Python path of the workers, from wherever the application was started.

    Where executors have it elsewhere, as an installed package or a shipped file, theirs is found as well.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, ROOT)))


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    reachable(df.sparkSession)
    return df.mapInArrow(function, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows whose texts have about `most` bytes; a longer text is a run of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(first, last - first)
            first = last


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(batch.column(column).type) else pa.binary()
    return pc.fill_null(batch.column(column).cast(kind), b"").to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of several texts: where they lie in one buffer, whose they are, and a 64-bit hash of each."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray):
        self.data = b"\n".join([*texts, b""])
        self.buffer = np.frombuffer(self.data, np.uint8)
        inside = np.concatenate(([False], is_word[self.buffer], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(texts)), self.counts)
        self.hashes = self.hashed(self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def hashed(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sum over a span's bytes of a mixed (place, byte): a tabulation hash, taken in bounded blocks. No span is empty."""
        sizes = ends - starts
        out = np.empty(len(sizes), np.uint64)
        totals = np.cumsum(sizes)
        first = 0
        while first < len(sizes):
            before = totals[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(totals, before + SLICE_BYTES, side="right")))
            n = sizes[first:last]
            heads = np.concatenate(([0], np.cumsum(n)[:-1]))
            place = np.arange(int(n.sum())) - np.repeat(heads, n)
            byte = self.buffer[np.repeat(starts[first:last], n) + place].astype(np.uint64)
            values = mix((place.astype(np.uint64) << np.uint64(8)) + byte + np.uint64(0x9E3779B97F4A7C15))
            out[first:last] = mix(np.add.reduceat(values, heads))
            first = last
        return out

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and rolling hash of every window of n words within one text."""
        count = max(0, len(self) - n + 1)
        starts = np.flatnonzero(self.owner[:count] == self.owner[n - 1 :][:count]) if count else np.arange(0)
        total = np.zeros(count, np.uint64)
        for k in range(n):  # Horner: the newest word has the lowest power
            total = total * np.uint64(0xD6E8FEB86659FD93) + self.hashes[k : k + count]
        return starts, mix(total[starts] + np.uint64(n))

    def covered(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Which words lie in one of these windows."""
        steps = np.zeros(len(self) + 1, np.int64)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + n, -1)
        return np.cumsum(steps[:-1]) > 0

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value of each word, by text."""
        sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return sums[self.first[1:]] - sums[self.first[:-1]]


def repeated(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes occur twice or more within their text."""
    keys = hashes ^ mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    bounds = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1]))) if len(keys) else np.arange(0)
    sizes = np.diff(bounds, append=len(keys))
    twice = np.empty(len(keys), bool)
    twice[order] = np.repeat(sizes > 1, sizes)
    return twice
