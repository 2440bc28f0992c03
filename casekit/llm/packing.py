"""Best-fit packing with certified bin counts.

Documents are tokenised and cut to pieces where they lie. Pieces of full length are sequences of their own. The
others are dealt evenly to partitions of bounded size; each is packed by best-fit decreasing, and a lower bound
by dual feasible functions is set against its number of bins. Where they meet, the partition is proven optimal.
Partitions with a gap exchange their documents (all but those in bins without waste) and are packed again, as
long as that saves bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.llm.text import map_batches, raw_texts, reachable, slices
from casekit.llm.tokens import word_tokens
from casekit.sources.files import stage

CAPACITY = 2048
END_ID = b"\0\0\0\0"
PARTITION_ITEMS = 8192
MOST_ROUNDS = 4


def pieces(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the end id 0, cut only where longer than a sequence.

    Null texts count as empty: one piece that holds the end id. Each row gives its own pieces; ids may be null or
    repeat. Only the named columns are read.
    """
    kind = docs.select(id_column).schema[0].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens(vocabulary).encode
        for batch in slices(batches, "text"):
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for d, text in enumerate(raw_texts(batch, "text")):
                ids = encode(text) + END_ID
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append(d)
                    numbers.append(k)
                    starts.append(at // 4)
                    lengths.append(len(own) // 4)
                    sums.append(zlib.crc32(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(texts, cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Largest of several dual-feasible-function bounds on the number of bins of `capacity`.

    A dual feasible function maps sizes so that what fits in a bin maps to at most 1; the mapped sum then bounds
    the bins. Used: the identity; those that round sizes above capacity - e up and drop sizes below e, for each
    e; and those that round to steps of 1/k. All sums are in whole numbers.
    """
    counts = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    sizes = np.arange(capacity + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * sizes)
    e = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - e]
    middle = total[capacity - e] - np.where(e > 0, total[np.maximum(e, 1) - 1], 0)
    best = int(np.max(large - (-middle // capacity)))
    for k in range(1, 33):
        steps = (k + 1) * sizes
        mapped = np.where(steps % capacity == 0, sizes * k, steps // capacity * capacity)  # in parts of k * capacity
        best = max(best, -(-int((counts * mapped).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin, offset in it and number of bins by best-fit decreasing; the tightest gap is the lowest set bit of a mask."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps, used = 0, 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[at])
        fitting = open_gaps >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            own = free[gap].pop()
            if not free[gap]:
                open_gaps &= ~(1 << gap)
        else:
            gap, own = capacity, used
            used += 1
        bins[at], offsets[at] = own, capacity - gap
        rest = gap - size
        free[rest].append(own)
        if rest:
            open_gaps |= 1 << rest
    return bins, offsets, used


def _packed(items: DataFrame, parts: int, salt: int, capacity: int) -> DataFrame:
    """Items dealt to `parts` partitions by a salted hash of their number, each packed and certified."""

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("item", ignore_index=True)
        lengths = part["length"].to_numpy()
        part["bin"], part["offset"], used = best_fit(lengths, capacity)
        part["gap"] = used - lower_bound(lengths, capacity)
        part["used"] = np.where(part["bin"].duplicated(), 0, 1)
        filled = np.bincount(part["bin"], weights=lengths, minlength=used)
        part["waste"] = capacity - filled[part["bin"]].astype(np.int64)
        return part[["item", "length", "part", "bin", "offset", "gap", "used", "waste"]]

    reachable(items.sparkSession)
    dealt = items.select("item", "length", F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInPandas(
        pack, "item long, length long, part long, bin long, offset long, gap long, used int, waste long"
    )


def pack(
    docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY,
    partition_items: int = PARTITION_ITEMS, rounds: int = MOST_ROUNDS,
) -> DataFrame:
    """Every piece of every document with its sequence and its place there, gapless from 0.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and gap: bins above the lower bound in
    the partition that last packed the piece (0: proven as few as can be for what lies there); above 0 it says that
    the exchanges ended, by `rounds` or because one saved nothing, before all was certified. An empty table gives no rows; for nulls
    and repeated rows see `pieces`. Jobs run while the plan is built; what comes to the driver is two numbers.
    """
    numbered = stage(
        pieces(docs, vocabulary, id_column, text_column, capacity).withColumn("item", F.monotonically_increasing_id()), "pieces"
    )
    full = F.col("length") == capacity
    pool = numbered.where(~full).select("item", "length")
    count = pool.count()
    done = None
    best = None
    for k in range(rounds):
        if not count:
            break
        parts = -(-count // partition_items)
        packed = stage(_packed(pool, parts, k, capacity).withColumn("round", F.lit(k)), "packed")
        used = packed.agg(F.sum("used")).first()[0]
        if best is not None and used >= best:
            break
        if best is not None:  # the exchange saved bins: what it started from is replaced
            # What stays lay in certified partitions or in bins without waste, which are as few as can be by themselves.
            stays = done.join(packed.select("item"), "item", "left_anti").withColumn("gap", F.lit(0).cast("long"))
            done = stage(stays.unionByName(packed), "packed")
        else:
            done = packed
        loose = packed.where((F.col("gap") > 0) & (F.col("waste") > 0))
        pool = loose.select("item", "length")
        count, best = loose.agg(F.count("*"), F.coalesce(F.sum("used"), F.lit(0))).first()
    own = numbered.where(full).select("*", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("gap"))
    if done is not None:
        sequence = F.shiftleft(F.col("round").cast("long"), 56) + F.shiftleft("part", 24) + F.col("bin")
        placed = done.select("item", sequence.alias("sequence_id"), "offset", "gap")
        own = own.unionByName(numbered.where(~full).join(placed, "item"))
    return own.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap")
