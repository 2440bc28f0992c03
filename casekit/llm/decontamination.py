"""Benchmark decontamination.

The windows of all benchmark items become a broadcast set of 64-bit hashes with the window texts beside them;
the windows of every document are looked up in it, hits are verified by their text, and the words hit are
cut out or the document is dropped. Documents are never shuffled. A benchmark of more windows than `block`
is worked through in blocks of about that many, one after the other, so that what is broadcast stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.llm.text import LOWER, Words, byte_class, map_batches, raw_texts, slices
from casekit.sources.files import stage

WORDS_PER_WINDOW = 10
WINDOW_BLOCK = 200_000
WORD = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])  # of lower-cased bytes
GATE_BITS = 20


def _words(texts: list[bytes]) -> Words:
    return Words([t.translate(LOWER) for t in texts], WORD)


def _window_text(words: Words, first: int, n: int) -> bytes:
    return b" ".join(words.data[a:b] for a, b in zip(words.starts[first : first + n], words.ends[first : first + n]))


def item_windows(items: DataFrame, item_id: str, item_text: str, n: int) -> DataFrame:
    """Distinct (item, words, hash, text) windows; an item of fewer than n words is one window, of none it has none."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = batch.column("item").to_pylist()
            for item, text in zip(ids, raw_texts(batch, "text")):
                words = _words([text])
                size = min(n, len(words))
                if size:
                    starts, hashes = words.windows(size)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "item": pa.array([item] * len(starts), pa.string()),
                            "size": pa.array([size] * len(starts), pa.int32()),
                            "hash": pa.array(hashes.view(np.int64)),
                            "words": pa.array([_window_text(words, s, size) for s in starts], pa.binary()),
                        }
                    )

    texts = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text")
    )
    return map_batches(texts, windows, "item string, size int, hash long, words binary").distinct()


class WindowSet:
    """One block of windows, as tasks use it: per window size a bit table, sorted hashes, and what lies behind."""

    def __init__(self, rows: list):
        self.tables = {}
        for size in sorted({r["size"] for r in rows}):
            found: dict[int, dict[bytes, list[str]]] = {}
            for r in rows:
                if r["size"] == size:
                    found.setdefault(r["hash"] & (2**64 - 1), {}).setdefault(bytes(r["words"]), []).append(r["item"])
            keys = np.array(sorted(found), np.uint64)
            gate = np.zeros(1 << GATE_BITS, bool)
            gate[keys & np.uint64((1 << GATE_BITS) - 1)] = True
            self.tables[size] = (gate, keys, found)

    def hits(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """First word, number of words and items of every window that occurs."""
        for size, (gate, keys, found) in self.tables.items():
            starts, hashes = words.windows(size)
            likely = np.flatnonzero(gate[hashes & np.uint64((1 << GATE_BITS) - 1)])
            place = np.minimum(np.searchsorted(keys, hashes[likely]), len(keys) - 1)
            for at in likely[keys[place] == hashes[likely]]:
                first = int(starts[at])
                items = found[int(hashes[at])].get(_window_text(words, first, size))
                if items:
                    yield first, size, items


def _window_blocks(items: DataFrame, item_id: str, item_text: str, n: int, block: int) -> list[DataFrame]:
    """The windows in blocks of about `block` rows, at least one.

    These are the only rows that come to the driver, a block at a time.
    """
    windows = stage(item_windows(items, item_id, item_text, n), "benchmark-windows")
    parts = max(1, -(-windows.count() // block))
    return [windows.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == k) for k in range(parts)]


def _runs(size: int, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs of words, of a text of `size` words, that lie in any of these [first, end) spans."""
    mark = np.zeros(size, bool)
    for a, b in spans:
        mark[a:b] = True
    edges = np.flatnonzero(np.diff(np.concatenate(([False], mark, [False])).astype(np.int8)))
    return [{"first": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def contamination(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id",
    item_text: str = "text", n: int = WORDS_PER_WINDOW, block: int = WINDOW_BLOCK,
) -> DataFrame:
    """Per document its words, the runs of words hit as [first, end) word numbers, and the items hit.

    Null and empty texts have no words and no hits. Ids of documents may be null or repeat; each row gives one
    row. An item without an id counts as item ''. Items with equal ids count as one item, equal items as many.
    Only the named columns are read. Counting the windows is a job that runs while the plan is built.
    """
    spark = docs.sparkSession
    kind = docs.select(F.col(id_column)).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_words long, runs array<struct<first:long,end:long>>, items array<string>"
    found = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        F.expr("CAST(array() AS array<struct<first:long,end:long>>)").alias("runs"),
        F.expr("CAST(array() AS array<string>)").alias("items"),
    )

    def scan(found: DataFrame, rows: list, last: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(WindowSet(rows))

        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                words = _words(raw_texts(batch, "text"))
                known_runs, known_items = batch.column("runs").to_pylist(), batch.column("items").to_pylist()
                spans: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str]] = {}
                for first, size, names in shared.value.hits(words):
                    d = int(words.owner[first])
                    if d not in spans:
                        spans[d] = [(run["first"], run["end"]) for run in known_runs[d]]
                        items[d] = set(known_items[d])
                    spans[d].append((first - words.first[d], first - words.first[d] + size))
                    items[d].update(names)
                for d, own in spans.items():
                    known_runs[d] = _runs(int(words.counts[d]), own)
                    known_items[d] = sorted(items[d])
                text = pa.nulls(len(batch), pa.string()) if last else batch.column("text")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), text, pa.array(words.counts.astype(np.int64)),
                        pa.array(known_runs, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
                        pa.array(known_items, pa.list_(pa.string())),
                    ],
                    ["doc_id", "text", "n_words", "runs", "items"],
                )

        return map_batches(found, scanned, schema)

    parts = _window_blocks(items, item_id, item_text, n, block)
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        found = scan(found, part.collect(), last)
        found = found if last else stage(found, "benchmark-hits")
    return found.drop("text")


def remove_contamination(
    docs: DataFrame, items: DataFrame, text_column: str = "text", item_id: str = "item_id", item_text: str = "text",
    n: int = WORDS_PER_WINDOW, block: int = WINDOW_BLOCK, length_column: str | None = None, drop: bool = False,
) -> DataFrame:
    """The documents with every word hit cut out, or without the documents hit if `drop`.

    Each run of hit words goes with what stands between them, up to a line break in its place; the text is then
    scanned again until no window occurs, as a cut may bring one together. Hits of all blocks are gathered on the
    uncut text and cut at once, so the result does not depend on `block`; with more than one, the texts that were
    cut go through all blocks again, each pass a written table. All other columns, whatever their names, stay as
    they are; null texts stay null; a text that is all hit becomes its remaining marks. `length_column` is set to
    the new number of characters of a text that was cut.
    """
    spark = docs.sparkSession
    names = docs.columns
    at = names.index(text_column)
    parts = _window_blocks(items, item_id, item_text, n, block)
    no_runs = F.expr("CAST(array() AS array<struct<first:long,end:long>>)")

    def cut(text: bytes, words: Words, runs: list[dict[str, int]]) -> bytes:
        rest, last = [], 0
        for run in runs:
            rest.append(text[last : words.starts[run["first"]]])
            last = int(words.ends[run["end"] - 1])
        return b"\n".join([*rest, text[last:]])

    def clean(packed: DataFrame, rows: list, last: bool) -> DataFrame:
        """Adds the runs of this block; after the last one the runs are cut out, and mark the texts to scan again."""
        shared = spark.sparkContext.broadcast(WindowSet(rows))
        alone = len(parts) == 1

        def cut_up(text: bytes, runs: list[dict[str, int]]) -> bytes:
            """The text without these runs and, if this block is the only one, without what hits it then."""
            while runs:
                text = cut(text, _words([text]), runs)
                words = _words([text])
                runs = _runs(len(words), [(a, a + size) for a, size, _ in shared.value.hits(words)]) if alone else []
            return text

        def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                texts = raw_texts(batch, "text")
                words = _words(texts)
                spans: dict[int, list[tuple[int, int]]] = {}
                for first, size, _ in shared.value.hits(words):
                    d = int(words.owner[first])
                    spans.setdefault(d, []).append((first - words.first[d], first - words.first[d] + size))
                if drop:
                    yield batch.take(pa.array([d for d in range(len(texts)) if d not in spans], pa.int64())) if spans else batch
                    continue
                runs = batch.column("runs").to_pylist()
                for d, own in spans.items():
                    runs[d] = _runs(int(words.counts[d]), own + [(run["first"], run["end"]) for run in runs[d]])
                if spans or last and any(runs):
                    own = batch.schema  # all batches of a task must have one schema
                    text, marks = batch.column("text"), batch.column("cut")
                    if last:
                        old = text.to_pylist()
                        new = [cut_up(t, runs[d]).decode() if runs[d] else old[d] for d, t in enumerate(texts)]
                        text = pa.array(new, own.field("text").type)
                        marks = pa.array([was or bool(runs[d]) for d, was in enumerate(marks.to_pylist())])
                    batch = pa.RecordBatch.from_arrays(
                        [batch.column(0), text, marks, pa.array(runs, own.field("runs").type)], schema=own
                    )
                yield batch

        return map_batches(packed, cleaned, packed.schema)

    def unpacked(done: DataFrame) -> DataFrame:
        columns = []
        for i, c in enumerate(names):
            column = F.col("text") if i == at else F.col(f"row.c{i}")
            if c == length_column:
                column = F.when(F.col("cut"), F.char_length("text").cast(docs.schema[c].dataType)).otherwise(column)
            columns.append(column.alias(c))
        return done.select(*columns)

    # The other columns travel as one struct, so that their names never meet ours.
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if i != at], F.lit(0).alias("c")).alias("row"),
        F.col(f"`{text_column}`").alias("text"), F.lit(False).alias("cut"), no_runs.alias("runs"),
    )
    if len(parts) == 1:
        return unpacked(clean(packed, parts[0].collect(), True))
    settled = None
    while True:
        for k, part in enumerate(parts):
            packed = stage(clean(packed, part.collect(), k == len(parts) - 1), "benchmark-clean")
        clear = packed.where(F.size("runs") == 0)
        settled = clear if settled is None else settled.union(clear)
        packed = packed.where(F.size("runs") > 0).withColumn("runs", no_runs)
        if packed.isEmpty():
            return unpacked(settled)
