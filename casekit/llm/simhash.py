"""SimHash near-duplicates by anchor-point covering.

The 64 bits of a fingerprint hold two blocks of 31 bits, and two spare ones. If two fingerprints differ in at
most 3 bits, they differ in at most one bit of some block. The anchors of a block are the words of the Hamming
code of length 31, whose covering radius is 1: a fingerprint has its home at the one anchor within distance 1,
and visits every anchor within radius plus threshold, that is 2. So of two linked fingerprints each visits the
home of the other in some block. Fingerprints meet at their anchors only, are compared there on all 64 bits,
and an anchor gives a spanning forest of its links, never all pairs. Equal fingerprints are one from the start.

Where many fingerprints meet at one anchor, the 33 bits outside its block split them again: of six parts of those bits
at least three are the same in two linked fingerprints, so all linked ones meet under one of the twenty choices of
three parts. Anchors that a sample shows to be crowded are split so before the shuffle, so no task gets all of one;
others in the task that compares them. The sample only decides where the splitting is done.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.llm.text import LOWER, map_batches, mix, raw_texts, slices
from casekit.sources.files import stage

SHINGLE = 3
SEED = 42
MOST_BITS = 3
BLOCK_BITS = 31
SMALL_RUN = 32
LARGE_RUN = 4096  # rows at an anchor that are split again in their task
CROWD = 50_000  # rows at an anchor, as a sample tells, that are split before the shuffle
SAMPLE_SHARE = 64
PARTS = 6
SPLIT = np.uint64(1 << 63)  # marks the keys of split anchors
BYTE_PLACES = 256 * np.arange(8)
BITS = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles: a bit is 1 if it is set in over half of their hashes; 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - shingle + 1)
    lasts = ends[min(shingle, len(words)) - 1 :]
    heads = (ends - sizes)[:n]
    shingles = map(joined.__getitem__, map(slice, heads.tolist(), lasts.tolist()))
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), np.uint8)  # big-endian
    counts = np.bincount((hashes.reshape(-1, 8)[:, ::-1] + BYTE_PLACES).ravel(), minlength=2048)
    ones = (counts.reshape(8, 256, 1) * BITS).sum(axis=1).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the 64-bit fingerprint as a long. Null texts count as empty: fingerprint 0."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints = np.array([fingerprint(t) for t in raw_texts(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(texts, hashed, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, print long")


def _syndromes(blocks: np.ndarray) -> np.ndarray:
    """Exclusive or of the numbers (1 to 31) of the bits set: 0 for the words of the Hamming code."""
    out = np.zeros(len(blocks), np.uint64)
    for bit in range(BLOCK_BITS):
        out ^= ((blocks >> np.uint64(bit)) & np.uint64(1)) * np.uint64(bit + 1)
    return out


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor and whether it is the home, for every anchor within distance 2 in either block."""
    rows, places, homes = [], [], []
    flip = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(BLOCK_BITS, dtype=np.uint64)))
    for block in range(2):
        bits = (prints >> np.uint64(BLOCK_BITS * block)) & np.uint64(2**BLOCK_BITS - 1)
        tag = np.uint64(block << BLOCK_BITS)
        wrong = _syndromes(bits)
        rows.append(np.arange(len(prints)))
        places.append((bits ^ flip[wrong]) | tag)
        homes.append(np.ones(len(prints), bool))
        for i in range(1, BLOCK_BITS + 1):  # two bits whose numbers cancel the syndrome
            other = wrong ^ np.uint64(i)
            pair = np.flatnonzero((wrong != 0) & (other > np.uint64(i)))
            rows.append(pair)
            places.append(bits[pair] ^ flip[i] ^ flip[other[pair]] | tag)
            homes.append(np.zeros(len(pair), bool))
    return np.concatenate(rows), np.concatenate(places), np.concatenate(homes)


def split(places: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and finer key, for every choice of half the parts of the bits outside an anchor's block."""
    low = (prints & np.uint64(2**BLOCK_BITS - 1)) | ((prints >> np.uint64(2 * BLOCK_BITS)) << np.uint64(BLOCK_BITS))
    high = prints >> np.uint64(BLOCK_BITS)
    others = np.where(places >> np.uint64(BLOCK_BITS) & np.uint64(1), low, high)  # 33 bits
    bounds = np.linspace(0, 64 - BLOCK_BITS, PARTS + 1).astype(np.uint64)
    parts = [(others >> a) & np.uint64(2 ** int(b - a) - 1) for a, b in zip(bounds[:-1], bounds[1:])]
    rows, keys = [], []
    for k, chosen in enumerate(combinations(range(PARTS), PARTS // 2)):
        key = mix(places + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
        for c in chosen:
            key = mix(key ^ parts[c])
        rows.append(np.arange(len(places)))
        keys.append(key | SPLIT)
    return np.concatenate(rows), np.concatenate(keys)


def _forest(prints: np.ndarray) -> tuple[list[int], list[int]]:
    """Spanning links (from, to) of one large run: breadth first, so a dense group is left after a few steps."""
    ones, twos = [], []
    left = np.arange(len(prints))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]) <= MOST_BITS
            found = left[near]
            ones += [int(at)] * len(found)
            twos += found.tolist()
            queue += found.tolist()
            left = left[~near]
    return ones, twos


def _links(places: np.ndarray, prints: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within each run of equal anchors. Rows are sorted by anchor."""
    bounds = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1], [True])))
    sizes = np.diff(bounds)
    ones: list[int] = []
    twos: list[int] = []
    finer: list[tuple[np.ndarray, np.ndarray]] = []
    for k in np.flatnonzero(sizes > SMALL_RUN):
        own = slice(bounds[k], bounds[k + 1])
        if sizes[k] > LARGE_RUN and places[bounds[k]] < SPLIT:
            rows, keys = split(places[own], prints[own])
            order = np.argsort(keys, kind="stable")
            finer.append(_links(keys[order], prints[own][rows[order]], np.ones(len(order), bool)))
            continue
        a, b = _forest(prints[own])
        ones += [x + int(bounds[k]) for x in a]
        twos += [x + int(bounds[k]) for x in b]
    run = np.repeat(np.arange(len(sizes)), sizes)
    small = np.repeat((sizes > 1) & (sizes <= SMALL_RUN), sizes)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    at = np.flatnonzero(small)
    for lag in range(1, SMALL_RUN):
        at = at[at + lag < len(places)]
        at = at[run[at] == run[at + lag]]
        if not len(at):
            break
        met = at[homes[at] | homes[at + lag]]
        for x in met[np.bitwise_count(prints[met] ^ prints[met + lag]) <= MOST_BITS].tolist():
            a, b = root(x), root(x + lag)
            if a != b:
                parent[b] = a
                ones.append(x)
                twos.append(x + lag)
    whole = [(prints[np.array(ones, np.int64)], prints[np.array(twos, np.int64)]), *finer]
    return np.concatenate([a for a, _ in whole]), np.concatenate([b for _, b in whole])


def print_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints of a column `print` that span every group of linked ones."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 14):
                own = batch.column("print").slice(k, 1 << 14).to_numpy(zero_copy_only=False).view(np.uint64)
                rows, places, homes = anchors(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places.view(np.int64)), pa.array(own[rows].view(np.int64)), pa.array(homes)],
                    ["anchor", "print", "home"],
                )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; the last run of a batch waits for the next batch."""
        kept = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, bool))

        def links(part: tuple) -> pa.RecordBatch:
            a, b = _links(*part)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            own = (
                batch.column("anchor").to_numpy(zero_copy_only=False).view(np.uint64),
                batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64),
                batch.column("home").to_numpy(zero_copy_only=False),
            )
            kept = tuple(np.concatenate(pair) for pair in zip(kept, own))
            if not len(kept[0]):
                continue
            last = int(np.searchsorted(kept[0].view(np.int64), kept[0].view(np.int64)[-1]))  # Spark sorts them as signed
            if last:
                yield links(tuple(x[:last] for x in kept))
                kept = tuple(x[last:] for x in kept)
        if len(kept[0]):
            yield links(kept)

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows at crowded anchors under their finer keys; every row is at home there, as any two may be linked."""
        for batch in batches:
            for k in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(k, 1 << 14)
                crowded = part.column("crowded").to_numpy(zero_copy_only=False)
                places, prints = (part.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("anchor", "print"))
                rows, keys = split(places[crowded], prints[crowded])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([places[~crowded], keys]).view(np.int64)),
                        pa.array(np.concatenate([prints[~crowded], prints[crowded][rows]]).view(np.int64)),
                        pa.array(np.concatenate([part.column("home").to_numpy(zero_copy_only=False)[~crowded], np.ones(len(rows), bool)])),
                    ],
                    ["anchor", "print", "home"],
                )

    form = "anchor long, print long, home boolean"
    some = distinct.select("print").where(F.pmod(F.xxhash64("print"), F.lit(SAMPLE_SHARE)) == 0)
    seen = map_batches(some, dealt, form).groupBy("anchor").count().where(F.col("count") * SAMPLE_SHARE > CROWD)
    crowds = stage(seen.select("anchor", F.lit(True).alias("crowded")), "crowds")  # few: each stands for many rows
    places = map_batches(distinct.select("print"), dealt, form)
    if not crowds.isEmpty():
        marked = places.join(F.broadcast(crowds), "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
        places = map_batches(marked.select("anchor", "print", "home", "crowded"), parted, form)
    met = places.repartition("anchor").sortWithinPartitions("anchor")
    return map_batches(met, compared, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of the links, as (node, root), by large-star and small-star.

    Each round halves the distances; the links between rounds are a written table. Rounds end when a round
    changes nothing, judged by the number and the sum of hashes of the links.
    """

    def mark(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def centred(sides: DataFrame) -> DataFrame:
        return sides.join(sides.groupBy("a").agg(F.min("b").alias("m")), "a")

    table = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while (now := mark(table)) != before and now[0]:
        before = now
        both = table.union(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = centred(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        small = centred(large.distinct())
        small = small.select("b", "m").union(small.select("a", "m")).toDF("a", "b")
        table = stage(small.where("a <> b").distinct(), "links")
    roots = table.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(table.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per row of the documents.

    component_id is the smallest id reachable over fingerprints that differ in 3 bits or fewer. Texts without
    words, null ones too, have fingerprint 0 and are linked like any other. Repeated rows and equal ids give
    equal rows. Null ids are no candidates for component_id, which is null if a component has no other. Only the
    named columns are read. Fingerprints, links and labels are never collected; jobs run while the plan is built.
    """
    prints = stage(fingerprints(docs, id_column, text_column), "prints")
    firsts = stage(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "distinct-prints")
    roots = components(print_links(firsts))
    owned = firsts.join(roots.withColumnRenamed("node", "print"), "print", "left")
    owned = stage(owned.select("print", "first", F.coalesce("root", "print").alias("root")), "rooted-prints")
    ids = owned.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = owned.join(ids, "root").select("print", "component_id")
    return prints.join(labels, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_firsts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component: that with the smallest id, a null id last, and of equal ids the first row.

    Repeated rows are copies of each other, so one stays; of different texts with one id each stays unless it has an
    earlier copy. All columns stay as they are. The documents are written once with a number for each row.
    """
    row = next(name for k in count() if (name := f"__row{k}") not in docs.columns)
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
    groups = near_duplicates(numbered, row, text_column).select(F.col("doc_id").alias(row), "component_id")
    own = numbered.select(row, F.col(f"`{id_column}`").alias("id"))
    ranked = groups.join(own, row).withColumn("rank", F.struct(F.col("id").isNull(), "id", row))
    best = ranked.groupBy("component_id").agg(F.min("rank").alias("best")).select(F.col("best").getField(row).alias(row))
    gone = groups.join(best, row, "left_anti").select(row)  # by row, so that a large component is no one task's
    return numbered.join(gone, row, "left_anti").drop(row)
