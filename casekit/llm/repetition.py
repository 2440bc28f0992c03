"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find the words of a text that lie in an n-gram which the text has twice
or more. A text is kept if the characters in such words, and in lines that it has twice or more, stay under a limit
for each length; the first of its kind counts like the others, and the limits leave room for a short text that quotes
itself once. Every text is looked at whole and on its own, so nothing is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casekit.llm.text import SPACE, SPACES, Words, byte_class, map_batches, raw_texts, repeated, slices

WORD = ~SPACE
SYMBOL = byte_class(b"#*$%&|<>")
# Most characters, as a share of all characters in words, that may lie in repeated n-grams of a length.
GRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
# Most lines that equal an earlier one, as a share of all lines, and most characters in lines that occur twice or more.
LINE_LIMIT = 0.34
LINE_CHARS_LIMIT = 0.40


def _lines(text: bytes) -> tuple[int, int, int]:
    """Lines with a word; those equal to an earlier one; the characters of all lines that occur twice or more."""
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    counts = Counter(lines)
    chars = sum(n * sum((b & 0xC0) != 0x80 and b not in SPACES for b in line) for line, n in counts.items() if n > 1)
    return len(lines), len(lines) - len(counts), chars


def repetition_measures(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lengths: tuple[int, ...] = tuple(GRAM_LIMITS)
) -> DataFrame:
    """Counts of words, symbols, repeated lines and characters in repeated n-grams, one row per document.

    `n_repeat_words` are words in 3-word windows that the text has twice or more, `dup_chars_<n>` the characters of
    words in such n-word windows, `dup_line_chars` those of words in such lines; the first of a kind is included in
    all three. `n_dup_lines` are lines equal to an earlier one.

    Null and empty texts have no words: every count is 0. Ids may be null or repeat; each row gives one row.
    Other columns are not read, so their names do not matter. Counts are over the whole text, however long.
    """
    schema = (
        f"{docs.select(F.col(id_column).alias('doc_id')).schema['doc_id'].simpleString().replace('doc_id:', 'doc_id ')}"
        ", n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, dup_line_chars long"
        ", n_repeat_words long, " + ", ".join(f"dup_chars_{n} long" for n in lengths)
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = raw_texts(batch, "text")
            words = Words(texts, WORD)
            heads = np.concatenate(([0], np.cumsum((words.buffer & 0xC0) != 0x80)))
            chars = heads[words.ends] - heads[words.starts]
            symbols = np.concatenate(([0], np.cumsum(SYMBOL[words.buffer])))[words.offsets]
            lines = np.array([_lines(t) for t in texts], np.int64).reshape(-1, 3)
            columns = [words.counts, words.by_text(chars), np.diff(symbols), *lines.T]
            for n in (3, *lengths):
                starts, hashes = words.windows(n)
                inside = words.covered(starts[repeated(words.owner[starts], hashes)], n)
                columns.append(words.by_text(inside if n == 3 else np.where(inside, chars, 0)))
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars"]
            names += ["n_repeat_words", *(f"dup_chars_{n}" for n in lengths)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in columns)], names
            )

    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(texts, measure, schema)


def repetition_verdict(
    measures: DataFrame, limits: Mapping[int, float] = GRAM_LIMITS, line_limit: float = LINE_LIMIT,
    line_chars_limit: float = LINE_CHARS_LIMIT,
) -> DataFrame:
    """Adds base_failed (under 50 words, or over half of them in repeated 3-word windows) and kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    within = [F.col(f"dup_chars_{n}") <= limit * F.col("word_chars") for n, limit in limits.items()]
    within.append(F.col("n_dup_lines") <= line_limit * F.col("n_lines"))
    within.append(F.col("dup_line_chars") <= line_chars_limit * F.col("word_chars"))
    kept = ~base
    for rule in within:
        kept = kept & rule
    return measures.withColumns({"base_failed": base, "kept": kept})
