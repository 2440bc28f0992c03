"""Token counts with overlap resynchronisation.

A huge text is encoded by the library in overlapping chunks cut anywhere, also within words, each with the offsets of
its tokens. Where two chunks overlap, they are spliced at the first place from which both have the same tokens at the
same offsets for a stated number of tokens. That place is stable: within a word, a byte-pair encoding is right exactly
if each two neighbouring tokens are, so a sequence whose first part and second part come from right encodings that
share tokens at the seam is the encoding of the whole; and the split into words goes on alike from tokens that agree.
What a cut has spoiled, a word cut short or begun in its middle, a composed character, half a special token, has other
tokens or offsets on the two sides, so it never agrees. If nothing agrees, as when two chunks pair a run of one letter
differently, the overlap is doubled, and at last both chunks are encoded as one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casekit.llm.text import map_batches, raw_texts, slices
from casekit.llm.tokens import WordTokens, word_tokens

CHUNK = 65_536
OVERLAP = 256
AGREEING = 3
TOKEN_LIMIT = 2048


@dataclass(frozen=True)
class Piece:
    """The tokens of a chunk that begins at `low`: ids and offsets in the whole text."""

    low: int
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def since(self, k: int) -> Piece:
        return Piece(self.low, self.ids[k:], self.starts[k:], self.ends[k:])


def _encoded(tokenizer: Tokenizer, text: str, low: int, high: int) -> Piece:
    found = tokenizer.encode(text[low:high], add_special_tokens=False)
    offsets = np.array(found.offsets, np.int64).reshape(-1, 2) + low
    return Piece(low, np.array(found.ids, np.uint32), offsets[:, 0], offsets[:, 1])


def _seam(left: Piece, right: Piece, agreeing: int) -> tuple[int, int] | None:
    """Places in both from which `agreeing` tokens are the same, at the beginning of a character."""
    n = len(right.ids) - agreeing + 1
    first = int(np.searchsorted(left.starts, right.low))
    if n <= 0 or len(left.ids) - first < agreeing:
        return None
    news = np.flatnonzero(np.diff(left.starts[first:], prepend=-1) > 0) + first
    news = news[news <= len(left.ids) - agreeing]
    at = np.searchsorted(right.starts, left.starts[news])  # the first token at that start
    both = (at < n) & (right.starts[np.minimum(at, n - 1)] == left.starts[news])
    news, at = news[both], at[both]
    for k in range(agreeing):
        same = (left.ids[news + k] == right.ids[at + k]) & (left.starts[news + k] == right.starts[at + k]) & (left.ends[news + k] == right.ends[at + k])
        news, at = news[same], at[same]
    return (int(news[0]), int(at[0])) if len(news) else None


def spliced_ids(tokenizer: Tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, agreeing: int = AGREEING) -> Iterator[np.ndarray]:
    """The ids of a text in order, a part at a time; `chunk` and `overlap` count characters."""
    end = min(len(text), chunk + overlap)
    left = _encoded(tokenizer, text, 0, end)
    known = 0  # tokens of `left` before this character have been given out
    while end < len(text):
        reach, further = overlap, min(len(text), end + chunk)
        while end - reach > left.low:
            right = _encoded(tokenizer, text, end - reach, further)
            seam = _seam(left, right, agreeing)
            if seam:
                yield left.ids[: seam[0]]
                left, known, end = right.since(seam[1]), int(right.starts[seam[1]]), further
                break
            reach *= 2
        else:  # nothing proves a seam: both chunks as one, twice as long each time, so that the work stays linear
            end = min(len(text), end + max(chunk, end - left.low))
            left = _encoded(tokenizer, text, left.low, end)
            left = left.since(int(np.searchsorted(left.starts, known)))
    yield left.ids


def count_tokens(
    tokens: WordTokens, text: bytes, chunk: int = CHUNK, overlap: int = OVERLAP, agreeing: int = AGREEING
) -> int:
    """Number of tokens of a text, encoded in overlapping chunks if it is longer than one chunk and its overlap."""
    if len(text) <= chunk + overlap:
        return len(tokens.encode(text)) // 4
    return sum(len(ids) for ids in spliced_ids(tokens.tokenizer, text.decode(), chunk, overlap, agreeing))


def token_counts(
    docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text", limit: int = TOKEN_LIMIT,
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit, one row per document; nothing is shuffled.

    Null and empty texts have 0 bytes and 0 tokens. Ids may be null or repeat. Only the named columns are read.
    A huge text is encoded a chunk at a time; only where nothing proves a seam do several chunks become one.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(vocabulary)
        for batch in slices(batches, "text"):
            texts = raw_texts(batch, "text")
            counts = np.array([count_tokens(tokens, t, chunk, overlap) for t in texts], np.int64)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(counts), pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return map_batches(texts, counted, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
