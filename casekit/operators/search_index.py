"""Text search over a written table: trigrams say which blocks of rows can hold a needle, only those are read."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casekit.operators.filters import text_search
from casekit.sources.files import staging_path, write_parquet

BLOCK = "__block"
GRAM = 3
ROWS_PER_BLOCK = 1 << 16
# A block number is 8 bytes: up to this many are broadcast, more are joined by a shuffle.
BROADCAST_BLOCKS = 2_000_000


def _grams(signs: Column) -> Column:
    """Distinct trigrams of a text given as its characters; none if it has fewer than three."""
    size = F.greatest(F.size(signs) - (GRAM - 1), F.lit(0))
    later = [F.slice(signs, F.lit(k + 1), size) for k in range(GRAM)]
    return F.array_distinct(F.transform(F.arrays_zip(*[part.alias(f"s{k}") for k, part in enumerate(later)]),
                                        lambda z: F.concat(*[z[f"s{k}"] for k in range(GRAM)])))


@dataclass(frozen=True)
class SearchIndex:
    """A table in folders of `__block` and the trigrams that each block has in each column."""

    rows: DataFrame
    grams: DataFrame
    columns: tuple[str, ...]
    blocks: int

    def candidates(self, needle: str, columns: Sequence[str]) -> DataFrame | None:
        """Blocks where some column has all trigrams of the needle; None if the needle is too short to have any."""
        low = needle.lower()
        wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        if not wanted:
            return None
        met = self.grams.where(F.col("gram").isin(wanted) & F.col("column").isin(list(columns)))
        return met.groupBy("column", BLOCK).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select(BLOCK).distinct()

    def search(self, needle: str, columns: Sequence[str] | None = None) -> DataFrame:
        """The rows that `filters.text_search` finds.

        Columns outside the index raise ValueError. Needles of fewer than three characters read the whole table.
        """
        asked = list(columns or self.columns)
        if set(asked) - set(self.columns):
            raise ValueError(f"not in the index: {sorted(set(asked) - set(self.columns))}")
        blocks = self.candidates(needle, asked)
        rows = self.rows
        if blocks is not None:
            # The list prunes the folders that are read, besides dropping their rows.
            rows = rows.join(F.broadcast(blocks) if self.blocks <= BROADCAST_BLOCKS else blocks, BLOCK, "left_semi")
        return text_search(rows, needle, asked).drop(BLOCK)


def build_search_index(df: DataFrame, columns: Sequence[str], rows_per_block: int = ROWS_PER_BLOCK) -> SearchIndex:
    """Writes the table in blocks and the index beside it.

    Blocks are runs of at most `rows_per_block` rows (a power of two) of one task, so the table itself is not
    shuffled. The index has a row for each trigram of a block, however often it occurs; it is sorted by trigram, so
    that a search reads few of its row groups. Null cells have no trigrams; cells are read as text without capitals.
    """
    if rows_per_block < 1 or rows_per_block & (rows_per_block - 1):
        raise ValueError("rows_per_block must be a power of two")
    spark = df.sparkSession
    place, index = staging_path(spark, "blocks"), staging_path(spark, "trigrams")
    in_blocks = df.withColumn(BLOCK, F.shiftright(F.monotonically_increasing_id(), rows_per_block.bit_length() - 1))
    write_parquet(in_blocks, place, partition_by=[BLOCK])
    fields = [T.StructField(f.name, f.dataType) for f in df.schema.fields]
    stored = spark.read.schema(T.StructType([*fields, T.StructField(BLOCK, T.LongType())])).parquet(place)

    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lower(F.col(f"`{c}`").cast("string")).alias("cell")) for c in columns])
    each = stored.select(BLOCK, F.explode(cells).alias("c")).select(BLOCK, "c.column", F.split("c.cell", "").alias("signs"))
    found = each.where("signs IS NOT NULL").select("column", F.explode(_grams(F.col("signs"))).alias("gram"), BLOCK).distinct()
    write_parquet(found.repartitionByRange("gram", "column", BLOCK).sortWithinPartitions("gram", "column"), index)
    grams = spark.read.schema(f"column string, gram string, {BLOCK} bigint").parquet(index)
    blocks = grams.select(F.count_distinct(BLOCK)).first()[0]
    return SearchIndex(stored, grams, tuple(columns), blocks)
