"""Group aggregates, top-N, distribution statistics, hierarchies and crosstabs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casekit.functions.expressions import all_of, attach_row, numeric, share_pct
from casekit.functions.order_stats import Quantile, quantiles_of
from casekit.plans.roles import groupable, ineligible
from casekit.sources.files import settle

AGGREGATIONS = ("count", "sum", "mean", "median", "min", "max", "nunique")
OTHER = "(Other)"


def _named(name: str) -> Column:
    return F.col(f"`{name}`")


def _measure(df: DataFrame, value: str | None, agg: str) -> Column:
    if value is None or agg not in AGGREGATIONS or agg == "count":
        return F.count(F.lit(1))
    if agg == "nunique":
        return F.count_distinct(_named(value))
    return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}[agg](numeric(df, value))


def group_measures(
    df: DataFrame, keys: Sequence[str], measures: Mapping[str, tuple[str | None, str]]
) -> DataFrame:
    """Several `name: (value column, aggregation)` measures per key combination from one grouping.

    Rows with a missing key are left out. `count` counts rows whatever the value column holds,
    and unknown aggregations count. Medians are exact and found without gathering a group.
    """
    values = [value for value, _ in measures.values() if value]
    bad = groupable(df, *keys, *values)
    if bad or not keys:
        raise ValueError(f"cannot group by or aggregate: {bad or 'no key given'}")
    medians = {name: value for name, (value, agg) in measures.items() if agg == "median" and value}
    plain = {name: m for name, m in measures.items() if name not in medians}
    kept = df.where(all_of(_named(k).isNotNull() for k in keys))
    if plain:
        table = kept.groupBy(*[_named(k) for k in keys]).agg(*[_measure(df, *m).alias(name) for name, m in plain.items()])
    else:
        # Groups without any number stay, with a missing median.
        table = kept.select(*keys).distinct()
    for name, value in medians.items():
        rows = df.select(*keys, numeric(df, value).alias("__y"))
        middle = quantiles_of(rows, "__y", [Quantile(name, 0.5)], keys).select(*keys, name)
        table = table.join(middle, list(keys), "left")
    return table.select(*keys, *measures)


def group_aggregate(
    df: DataFrame, keys: Sequence[str], value: str | None = None, agg: str = "count", out: str = "value"
) -> DataFrame:
    """One aggregate per key combination."""
    return group_measures(df, keys, {out: (value, agg)})


def order_by_value(value: str, keys: Sequence[str], order: str = "desc") -> list[Column]:
    first = F.col(value).asc_nulls_last() if order == "asc" else F.col(value).desc_nulls_last()
    return [first, *[F.col(k).asc() for k in keys]]


def top_n(table: DataFrame, value: str, keys: Sequence[str], n: int, order: str = "desc") -> DataFrame:
    """Sorted head of an aggregated table; ties are settled by the keys."""
    ordered = table.orderBy(*order_by_value(value, keys, order))
    return ordered.limit(n) if n > 0 else ordered


def top_n_with_groups(table: DataFrame, x: str, value: str, n: int) -> DataFrame:
    """All rows of the N keys with the largest totals."""
    if n <= 0:
        return table
    totals = table.groupBy(x).agg(F.sum(value).alias("__total"))
    # n is the caller's: Spark decides by the head's size whether to broadcast it.
    return table.join(top_n(totals, "__total", [x], n).select(x), x, "left_semi")


def share_of_group(table: DataFrame, x: str | Sequence[str], value: str, out: str = "share_pct") -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(*([x] if isinstance(x, str) else x)))
    return table.withColumn(out, share_pct(F.col(value), total, isinstance(table.schema[value].dataType, T.IntegralType)))


def clip_to_other(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """Keeps the N most frequent values of each column; everything else becomes `(Other)`.

    The kept values, at most N per column, travel as one row of arrays.
    """
    if n <= 0:
        return df
    pairs = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), _named(c).cast("string").alias("v")) for i, c in enumerate(columns)])
    )
    counts = (
        df.select(pairs.alias("p"))
        .select("p.i", "p.v")
        .where("v IS NOT NULL")
        .groupBy("i", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("n"), "v"))
    top = counts.withColumn("r", rank).where(F.col("r") <= n)
    kept = top.agg(*[F.collect_list(F.when(F.col("i") == i, F.col("v"))).alias(f"c{i}") for i in range(len(columns))])
    clipped = {
        c: F.when(F.array_contains(f"__kept.c{i}", _named(c).cast("string")), _named(c).cast("string")).otherwise(OTHER)
        for i, c in enumerate(columns)
    }
    return attach_row(df, kept, "__kept").withColumns(clipped).drop("__kept")


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int = 42) -> DataFrame:
    """Repeatable sample of a fixed size: the rows with the smallest seeded hashes."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), _named(key).cast("string"))), _named(key)).limit(rows)


DESCRIBE = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def describe(df: DataFrame, value: Column | str, keys: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles, for the table or per group."""
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, v.alias("__v")).where(all_of([F.col("__v").isNotNull(), *[F.col(k).isNotNull() for k in keys]]))
    quartiles = quantiles_of(rows, "__v", [Quantile("p25", 0.25), Quantile("p50", 0.5), Quantile("p75", 0.75)], keys)
    moments = rows.groupBy(*keys).agg(
        F.count("__v").alias("count"),
        F.avg("__v").alias("mean"),
        F.stddev_samp("__v").alias("std"),
        F.min("__v").alias("min"),
        F.max("__v").alias("max"),
    )
    if keys:
        joined = moments.join(quartiles.drop("n"), list(keys))
    else:
        joined = attach_row(moments, quartiles, "__q").withColumns({p: F.col("__q")[p] for p in ("p25", "p50", "p75")})
    rounded = [F.col("count"), *[F.round(F.col(s).cast("double"), digits).alias(s) for s in DESCRIBE[1:]]]
    return joined.select(*keys, *rounded)


def hierarchy_rollup(
    df: DataFrame, path: Sequence[str], value: str | None = None, agg: str = "count"
) -> DataFrame:
    """Totals of every node on the path; leaves must be positive, parents add up their leaves."""
    leaves = group_aggregate(df, path, value, agg).where("value > 0")
    tree = leaves.rollup(*path).agg(F.sum("value").alias("value"), F.grouping_id().alias("gid"))
    depth = len(path)
    return tree.withColumn("level", F.lit(depth) - F.bit_count("gid")).drop("gid")


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    """Pearson correlations of all numeric column pairs in long form, from one aggregate."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if len(columns) < 2:
        return ineligible(df.sparkSession, "correlation", ["two numeric columns"])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(numeric(df, a), numeric(df, b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("column_x"), F.lit(y).alias("column_y"), F.col(f"r{i}").alias("r")))
    return row.select(F.explode(F.array(*cells)).alias("c")).select(
        "c.column_x", "c.column_y", F.round("c.r", digits).alias("correlation")
    )


def crosstab(df: DataFrame, y: str, x: str, value: str | None = None, agg: str = "count",
             x_values: Sequence | None = None) -> DataFrame:
    """Aggregate per `y` × `x` combination in long form.

    Combinations that no row has are left out, unless `x_values` names the values across: then every `y` has a
    cell for each of them, absent ones 0.
    """
    cells = group_aggregate(df, [y, x], value, agg)
    if x_values is None:
        return cells
    cells = settle(cells.where(_named(x).isin(*x_values)), "cells")
    rows = df.select(y).where(_named(y).isNotNull()).distinct()
    spine = rows.withColumn(x, F.explode(F.array(*[F.lit(v) for v in x_values])))
    return spine.join(cells, [y, x], "left").fillna(0, ["value"])


def crosstab_wide(df: DataFrame, y: str, x: str, x_values: Sequence[str]) -> DataFrame:
    """Wide crosstab of counts for known `x` values."""
    kept = df.where(_named(y).isNotNull() & _named(x).isNotNull())
    return kept.groupBy(y).pivot(x, list(x_values)).count().fillna(0)
