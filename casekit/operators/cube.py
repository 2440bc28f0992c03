"""Additive cells of a case table: written once for each batch of files, added up for any figure.

A cell is a month × the named places × the state of its cases, with the number of rows. Counts, rates, trends and
hierarchies are sums over cells, so none of them reads the cases again, and new files add cells without a look at the
old ones. Distinct consumers are kept as sketches by month and place, which unite to an estimate for any roll-up.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casekit.functions.expressions import month_label, period_start, rate
from casekit.operators import kpis
from casekit.operators.aggregates import hierarchy_rollup
from casekit.plans import roles as R
from casekit.plans.roles import Roles
from casekit.sources.files import write_parquet

MONTH = "month_start"
SKETCH = "consumers"
# 2^12 registers: a standard error of 1.04 / sqrt(2^12), about 1.6 %, at no more than some 4 KB a cell.
SKETCH_BITS = 12
LEDGER_SCHEMA = "file string, length bigint, modified timestamp, batch string"


def _month(roles: Roles) -> Column:
    if roles.has(R.REGISTRATION_DATE):
        return period_start(R.REGISTRATION_DATE, "M").alias(MONTH)
    return F.lit(None).cast("date").alias(MONTH)


def case_cells(view: DataFrame, roles: Roles, places: Sequence[str]) -> DataFrame:
    """Rows (`n`) by month, place and state; a missing date or place is a cell of its own."""
    states = {name: F.coalesce(c, F.lit(False)).alias(name) for name, c in kpis.conditions(roles).items()}
    rows = view.select(_month(roles), *places, *states.values())
    return rows.groupBy(MONTH, *places, *states).agg(F.count(F.lit(1)).alias("n"))


def consumer_cells(view: DataFrame, roles: Roles, places: Sequence[str]) -> DataFrame:
    """A sketch of the distinct consumers by month and place; cells without consumers are left out."""
    rows = view.select(_month(roles), *places, F.col(R.CONSUMER_ID).cast("string").alias("who")).where("who IS NOT NULL")
    return rows.groupBy(MONTH, *places).agg(F.hll_sketch_agg("who", SKETCH_BITS).alias(SKETCH))


class StaleCube(ValueError):
    """A file whose rows are in the cells is gone or has changed, so the cells have to be made anew."""


@dataclass(frozen=True)
class CaseCube:
    """Cells under a folder, for the Parquet files (or files that `read` reads) under a source folder.

    `refresh` adds the cells of files that are not in the ledger yet. A batch counts once its ledger is written, which
    happens last: a refresh that broke off leaves nothing behind that is read, and can be repeated. Refreshes of one
    cube run one after the other. A table without files has no cells, counts of 0 and null rates.
    """

    spark: SparkSession
    folder: str
    roles: Roles
    places: tuple[str, ...] = ()
    read: Callable[[SparkSession, list[str]], DataFrame] = lambda spark, files: spark.read.parquet(*files)

    def _ledger(self) -> DataFrame:
        path = f"{self.folder}/ledger"
        if not self._exists(path):
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).parquet(path)

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def refresh(self, source: str) -> int:
        """Adds the files that came since the last call; the number of files read."""
        # Only names, sizes and times are asked for, so that the listing opens no file.
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
        listed = listed.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))
        known = self._ledger()
        if known.join(listed, ["file", "length", "modified"], "left_anti").limit(1).count():
            raise StaleCube(source)
        fresh = listed.join(known, "file", "left_anti").collect()  # paths, as any scan of these files has
        if not fresh:
            return 0
        batch = uuid.uuid4().hex
        view = self.roles.view(self.read(self.spark, [r["file"] for r in fresh]))
        write_parquet(case_cells(view, self.roles, self.places), f"{self.folder}/cases/batch={batch}")
        if self.roles.has(R.CONSUMER_ID):
            write_parquet(consumer_cells(view, self.roles, self.places), f"{self.folder}/consumers/batch={batch}")
        entries = [(r["file"], r["length"], r["modified"], batch) for r in fresh]
        write_parquet(self.spark.createDataFrame(entries, LEDGER_SCHEMA), f"{self.folder}/ledger", mode="append")
        return len(fresh)

    def _batches(self, table: str) -> DataFrame | None:
        batches = [r["batch"] for r in self._ledger().select("batch").distinct().collect()]
        if not batches:
            return None
        return self.spark.read.parquet(*[f"{self.folder}/{table}/batch={b}" for b in sorted(batches)])

    def cells(self) -> DataFrame:
        """The cells of all finished batches; those of one key in several batches add up."""
        stored = self._batches("cases")
        if stored is not None:
            return stored
        types = ", ".join([f"{MONTH} date", *[f"{p} string" for p in self.places]])
        return self.spark.createDataFrame([], f"{types}, {', '.join(f'{s} boolean' for s in kpis.conditions(self.roles))}, n bigint")

    def counts(self) -> DataFrame:
        """Counts and rates, as `kpis.count_measures` gives them over the cases."""
        return kpis.counts_of(self.cells(), self.roles)

    def monthly_trend(self) -> DataFrame:
        """As `breakdowns.monthly_trend`."""
        total, closed = F.sum("n"), F.sum(F.when(F.col("status_closed"), F.col("n")).otherwise(0))
        months = self.cells().where(F.col(MONTH).isNotNull()).groupBy(MONTH).agg(
            total.alias("total"), closed.alias("closed"), (total - closed).alias("pending"),
            rate(closed, total, 1).alias("closure_rate"),
        )
        return months.orderBy(MONTH).select(
            month_label(MONTH).alias("period"), F.year(MONTH).alias("year"), F.month(MONTH).alias("month"),
            "total", "closed", "pending", "closure_rate",
        )

    def hierarchy(self, path: Sequence[str]) -> DataFrame:
        """Rows of every node on a path of places, as `aggregates.hierarchy_rollup`."""
        return hierarchy_rollup(self.cells(), path, "n", "sum")

    def distinct_consumers(self, keys: Sequence[str] = ()) -> DataFrame:
        """Estimated distinct consumers by any of `month_start` and the places, or of all."""
        stored = self._batches("consumers")
        if stored is None:
            raise ValueError("no batch has been written")
        united = F.hll_sketch_estimate(F.hll_union_agg(SKETCH)).alias("unique_consumers")
        return stored.groupBy(*keys).agg(united) if keys else stored.agg(united)
