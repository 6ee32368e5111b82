"""Air-quality station-days: from raw monitor rows to one row per station and day, with field means."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeframe.functions.scalars import (
    expected_hours,
    local_day,
    missing_to_null,
    parse_mixed_date,
    station_key,
    unquote,
    zero_fill,
)
from plumeframe.scale import top_rows

# Columns of the daily monitor files and their names in the table.
RAW_COLUMNS = {
    "State Code": "state_code",
    "County Code": "county_code",
    "Site Num": "site_num",
    "POC": "poc",
    "Latitude": "latitude",
    "Longitude": "longitude",
    "Parameter Name": "parameter_name",
    "Sample Duration": "sample_duration",
    "Pollutant Standard": "pollutant_standard",
    "Date Local": "date_local_raw",
    "Units of Measure": "units",
    "Event Type": "event_type",
    "Observation Count": "observation_count",
    "Observation Percent": "observation_percent",
    "Arithmetic Mean": "arithmetic_mean",
    "AQI": "aqi",
    "Method Code": "method_code",
    "Method Name": "method_name",
    "State Name": "state_name",
    "County Name": "county_name",
    "City Name": "city_name",
    "CBSA Name": "cbsa_name",
    "Date of Last Change": "date_last_change_raw",
}
NUMBERS = ("latitude", "longitude", "observation_count", "observation_percent", "arithmetic_mean", "aqi")

# Columns of the station-day table.
OBSERVATION_COLUMNS = (
    "state_code", "county_code", "site_num", "station_id", "date_local", "latitude", "longitude", "arithmetic_mean",
    "units", "observation_count", "observation_percent", "aqi", "event_type", "state_name", "county_name", "city_name",
    "cbsa_name", "pm_source_code", "pm_source_poc", "pm_source_method", "pm_source_parameter_name",
    "pollutant_standard", "sample_duration", "date_last_change",
)


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"Missing expected columns: {missing}")


def rename_required(df: DataFrame, names: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Select and rename; a missing column raises before anything runs."""
    require_columns(df, list(names))
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()], *keep)


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows in which none of the numbers is NULL or NaN."""
    for name in columns:
        df = df.filter(missing_to_null(name).isNotNull())
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise when a key occurs twice."""
    extra = duplicate_keys(df, keys).agg(F.sum(F.col("n") - 1).alias("n")).first()["n"]
    if extra:
        raise ValueError(f"{extra} duplicate {'/'.join(keys)} keys; expected one row each")
    return df


def normalize_observations(raw: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """All-text monitor rows to typed rows inside the run dates; rows without place or value go."""
    out = rename_required(raw, RAW_COLUMNS, [c for c in ("pm_source_code", "seq") if c in raw.columns])
    out = out.withColumn("station_id", station_key("state_code", "county_code", "site_num"))
    for name, width in (("state_code", 2), ("county_code", 3), ("site_num", 4)):
        out = out.withColumn(name, zero_fill(unquote(F.coalesce(F.col(name), F.lit(""))), width))
    out = out.withColumn("date_local", parse_mixed_date("date_local_raw")).filter(
        F.col("date_local").between(F.lit(start), F.lit(end))
    )
    for name in NUMBERS:
        out = out.withColumn(name, missing_to_null(F.trim(F.col(name)).try_cast("double")))
    changed = F.coalesce(
        F.try_to_timestamp("date_last_change_raw", F.lit("yyyy-MM-dd")), F.try_to_timestamp("date_last_change_raw")
    )
    return (
        out.withColumn("poc_numeric", missing_to_null(F.trim("poc").try_cast("double")))
        .withColumn("date_last_change", changed)
        .filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("arithmetic_mean").isNotNull())
    )


def _monitor_order() -> list:
    return [
        F.col("observation_percent").desc_nulls_last(),
        F.col("poc_numeric").asc_nulls_last(),
        F.col("date_last_change").desc_nulls_last(),
    ]


def best_monitor(rows: DataFrame, tie: Sequence[str] = ("seq",)) -> DataFrame:
    """One row per station-day: most complete, lowest monitor number, latest change, then input order."""
    return top_rows(rows, ["station_id", "date_local"], [*_monitor_order(), *[F.col(c) for c in tie]])


def best_source(primary: DataFrame, fallback: DataFrame, tie: Sequence[str] = ("seq",)) -> DataFrame:
    """Primary rows beat fallback rows of the same station-day, then the monitor order."""
    both = primary.withColumn("_source", F.lit(0)).unionByName(fallback.withColumn("_source", F.lit(1)))
    order = [F.col("_source"), *_monitor_order(), *[F.col(c) for c in tie]]
    return top_rows(both, ["station_id", "date_local"], order).drop("_source")


def observation_table(rows: DataFrame) -> DataFrame:
    """Final column set of the station-day table."""
    named = rows.withColumns(
        {
            "pm_source_poc": F.col("poc").cast("string"),
            "pm_source_method": F.col("method_name"),
            "pm_source_parameter_name": F.col("parameter_name"),
        }
    )
    return named.select(*OBSERVATION_COLUMNS).withColumnRenamed("arithmetic_mean", "pm25_value")


def distinct_stations(observations: DataFrame, limit: int | None = None) -> DataFrame:
    """Stations with place and state, one row each (smallest row wins), optionally the first n by id."""
    place = F.struct("latitude", "longitude", *[c for c in ("state_name", "timezone") if c in observations.columns])
    out = observations.groupBy("station_id").agg(F.min(place).alias("_p")).select("station_id", "_p.*")
    return out.orderBy("station_id").limit(limit) if limit is not None else out


def station_day_sums(samples: DataFrame, stations: DataFrame) -> DataFrame:
    """Hourly station samples to sums per local day; hours in which either value is missing do not count."""
    zones = stations.select("station_id", "timezone")
    both = samples.filter(F.col("value0").isNotNull() & F.col("value1").isNotNull())
    return (
        both.join(zones, "station_id")
        .groupBy("station_id", local_day("hour_utc", "timezone").alias("date_local"))
        .agg(F.sum("value0").alias("sum0"), F.sum("value1").alias("sum1"), F.count("*").alias("n"))
    )


def attach_day_means(
    observations: DataFrame, sums: DataFrame, stations: DataFrame, names: tuple[str, str] = ("massden_daily_mean", "colmd_daily_mean")
) -> DataFrame:
    """Station-days with daily means (NULL without hours), hours found and expected, completeness."""
    zones = stations.select("station_id", "timezone")
    n = F.coalesce(F.col("n"), F.lit(0))
    return (
        observations.drop("timezone")
        .join(sums, ["station_id", "date_local"], "left")
        .join(zones, "station_id", "left")
        .withColumn("timezone", F.coalesce("timezone", F.lit("UTC")))
        .withColumn(names[0], F.col("sum0") / F.nullif(n, F.lit(0)))
        .withColumn(names[1], F.col("sum1") / F.nullif(n, F.lit(0)))
        .withColumn("hrrr_hours_found", n.cast("int"))
        .withColumn("hrrr_hours_expected", expected_hours("date_local", "timezone"))
        .withColumn("hrrr_day_complete", F.col("hrrr_hours_found") == F.col("hrrr_hours_expected"))
        .drop("sum0", "sum1", "n")
    )
