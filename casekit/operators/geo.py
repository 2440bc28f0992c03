"""Coordinates for cases: exact positions, else a key lookup, else boundary centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casekit.functions.expressions import attach_row, numeric, text
from casekit.plans import roles as R
from casekit.plans.roles import Roles, ineligible
from casekit.sources.files import settle

# A lookup of more keys is joined by salted keys instead of being sent to all tasks.
BROADCAST_ROWS = 100_000
SALTS = 16
EXACT = "Resolved (Exact GPS)"
BY_KEY = "Resolved (Key Lookup)"
BY_BOUNDARY = "Resolved (Boundary Centroid)"
DROPPED = "Dropped"


def valid_position(lat: Column, lon: Column) -> Column:
    """Both present, in range, and not the (0, 0) filler."""
    inside = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.coalesce(inside & ~((lat == 0.0) & (lon == 0.0)), F.lit(False))


def _lookup(lookup: DataFrame) -> DataFrame:
    """`(key, lat, lon)` with trimmed keys; of repeated keys the smallest position is taken."""
    keyed = lookup.select(text("key").alias("__key"), F.struct(
        F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).alias("__p"))
    return keyed.where("__key IS NOT NULL").groupBy("__key").agg(F.min("__p").alias("__p"))


def lookup_from_json(df: DataFrame, column: str) -> DataFrame:
    """Lookup rows from JSON text of the form `{"key": [lat, lon]}`."""
    parsed = F.from_json(F.col(column), "map<string,array<double>>")
    pairs = df.select(F.explode(parsed).alias("key", "p"))
    return pairs.select("key", F.get("p", F.lit(0)).alias("lat"), F.get("p", F.lit(1)).alias("lon"))


def _joined(view: DataFrame, column: str, lookup: DataFrame) -> DataFrame:
    """Rows with the position of their key.

    A lookup of at most BROADCAST_ROWS keys is sent to all tasks; a larger one is repeated for each of SALTS, by
    which rows of a hot key are split. Counting its keys is a job that runs while the plan is built.
    """
    known = settle(_lookup(lookup), "positions")
    keyed = view.withColumn("__key", text(column))
    if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        joined = keyed.join(F.broadcast(known), "__key", "left")
    else:
        salts = known.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        salted = keyed.withColumn("__salt", F.pmod(F.xxhash64(*[f"`{c}`" for c in view.columns]), F.lit(SALTS)).cast("int"))
        joined = salted.join(salts, ["__key", "__salt"], "left").drop("__salt")
    return joined.withColumns({"__lat": F.col("__p.lat"), "__lon": F.col("__p.lon")})


def _tier(view: DataFrame, roles: Roles, keys: DataFrame | None, boundaries: DataFrame | None,
          key_role: str | None = None) -> str | None:
    """First tier with any valid row, from one job over all that are possible."""
    found: dict[str, DataFrame] = {}
    if not roles.missing([R.LATITUDE, R.LONGITUDE]):
        found["exact"] = _with_exact(view)
    key, boundary = _key_column(roles, key_role), boundary_column(roles)
    for tier, column, lookup in (("key", key, keys), ("boundary", boundary, boundaries)):
        if lookup is not None and column:
            # A key that any row has is enough: the table is cut to its distinct keys first.
            found[tier] = _joined(view.select(column).distinct(), column, lookup)
    if not found:
        return None
    any_row = [
        F.coalesce(df.agg(F.max(valid_position(F.col("__lat"), F.col("__lon")))).scalar(), F.lit(False)).alias(tier)
        for tier, df in found.items()
    ]
    row = view.sparkSession.range(1).select(*any_row).first()
    return next((tier for tier in found if row[tier]), None)


def _with_exact(view: DataFrame) -> DataFrame:
    return view.withColumns({"__lat": numeric(view, R.LATITUDE), "__lon": numeric(view, R.LONGITUDE)})


def _key_column(roles: Roles, key_role: str | None = None) -> str | None:
    return next(iter(roles.mapped((key_role,) if key_role else (R.FEEDER, R.TRANSFORMER))), None)


def boundary_column(roles: Roles) -> str | None:
    return next(iter(roles.mapped((R.SUBDIVISION, R.DIVISION, R.CIRCLE, R.ZONE))), None)


def resolve_positions(
    view: DataFrame,
    roles: Roles,
    keys: DataFrame | None = None,
    boundaries: DataFrame | None = None,
    tier: str | None = None,
    key_role: str | None = None,
) -> DataFrame:
    """Adds `resolved_latitude`, `resolved_longitude` and `geo_status`.

    The first tier with any valid row serves the whole table. `keys` and `boundaries` are `(key, lat, lon)`
    tables joined to the rows; keys stand in the column of `key_role`, else of the feeder or transformer.
    """
    tier = tier or _tier(view, roles, keys, boundaries, key_role)
    if tier == "exact":
        placed, label = _with_exact(view), EXACT
    elif tier == "key":
        placed, label = _joined(view, _key_column(roles, key_role), keys), BY_KEY
    elif tier == "boundary":
        placed, label = _joined(view, boundary_column(roles), boundaries), BY_BOUNDARY
    else:
        nowhere = F.lit(None).cast("double")
        return view.withColumns(
            {"resolved_latitude": nowhere, "resolved_longitude": nowhere, "geo_status": F.lit(DROPPED)}
        )
    ok = valid_position(F.col("__lat"), F.col("__lon"))
    return placed.withColumns(
        {
            "resolved_latitude": F.when(ok, F.col("__lat")),
            "resolved_longitude": F.when(ok, F.col("__lon")),
            "geo_status": F.when(ok, label).otherwise(DROPPED),
        }
    ).select(*view.columns, "resolved_latitude", "resolved_longitude", "geo_status")


def concentration(view: DataFrame, roles: Roles, boundaries: DataFrame | None = None) -> DataFrame:
    """Cases per boundary at its centroid, marker radius 6 to 30, and the centre of the map.

    Rows are counted per boundary before the lookup is joined. Without a boundary column or centroids the answer
    is an ineligible row.
    """
    if boundaries is None or boundary_column(roles) is None:
        lacking = [R.ZONE] if boundary_column(roles) is None else ["boundaries"]
        return ineligible(view.sparkSession, "geo_concentration", lacking)
    counts = (
        view.select(text(boundary_column(roles)).alias("__key"))
        .where("__key IS NOT NULL")
        .groupBy("__key")
        .agg(F.count(F.lit(1)).alias("case_count"))
    )
    placed = counts.join(_lookup(boundaries), "__key").select(
        F.col("__key").alias("boundary"), F.col("__p.lat").alias("lat"), F.col("__p.lon").alias("lon"), "case_count"
    )
    placed = placed.where(valid_position(F.col("lat"), F.col("lon")))
    whole = placed.agg(F.max("case_count").alias("top"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return attach_row(placed, whole, "whole").withColumns(
        {
            "radius": F.round(6.0 + 24.0 * F.col("case_count") / F.col("whole.top"), 4),
            "center_lat": F.round("whole.lat", 4),
            "center_lon": F.round("whole.lon", 4),
        }
    ).drop("whole")
