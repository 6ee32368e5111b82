"""From monitor files and gridded fields to station-days and their accuracy."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from plumeframe.config import GridSpec
from plumeframe.functions import geo
from plumeframe.operators import grids, metrics, spatial
from plumeframe.operators import observations as obs
from plumeframe.scale import stage


def ingest_observations(
    primary: DataFrame, fallback: DataFrame, start: dt.date, end: dt.date
) -> tuple[DataFrame, dict[str, Observation]]:
    """Raw monitor rows of two sources to one row per station and day.

    The second value counts rows at five stages while the table is written; read ``.get`` after an action.
    """
    counts = {name: Observation(name) for name in ("primary_raw", "fallback_raw", "primary_dedup", "fallback_dedup", "final")}
    best = {}
    for name, raw in (("primary", primary), ("fallback", fallback)):
        counted = raw.observe(counts[f"{name}_raw"], F.count(F.lit(1)).alias("rows"))
        clean = obs.normalize_observations(counted, start, end)
        if "seq" not in clean.columns:
            clean = clean.withColumn("seq", F.struct("poc", "method_code", "arithmetic_mean", "observation_count"))
        best[name] = obs.best_monitor(clean).observe(counts[f"{name}_dedup"], F.count(F.lit(1)).alias("rows"))
    final = obs.observation_table(obs.best_source(best["primary"], best["fallback"]))
    return final.observe(counts["final"], F.count(F.lit(1)).alias("rows")), counts


def station_daily(
    observations: DataFrame,
    fields: DataFrame,
    grid: GridSpec,
    first: tuple[str, str],
    second: tuple[str, str],
    station_limit: int | None = None,
    max_hours: int | None = None,
    run: tuple[dt.date, dt.date] | None = None,
    check_unique: bool = True,
) -> DataFrame:
    """Station-days with the local-day means of two sampled variables."""
    if check_unique:
        obs.require_unique(observations, ["station_id", "date_local"])
    stations = obs.distinct_stations(observations, station_limit)
    if station_limit is not None:
        observations = observations.join(stations.select("station_id"), "station_id", "left_semi")
    x, y = geo.project("longitude", "latitude")
    if run is not None:
        first_hour = F.date_sub(F.lit(run[0]), 1).cast("timestamp")
        last_hour = F.date_add(F.lit(run[1]), 2).cast("timestamp")
        fields = fields.filter((F.col("run_time") >= first_hour) & (F.col("run_time") < last_hour))
        if "run_date" in fields.columns:
            # The folders of a written table; the same days, so that others are not opened.
            fields = fields.filter(F.col("run_date").between(F.date_sub(F.lit(run[0]), 1), F.date_add(F.lit(run[1]), 1)))
        if max_hours is not None:
            fields = fields.filter(F.unix_seconds("run_time") < F.unix_seconds(first_hour) + max_hours * 3600)
    samples = grids.sample_two_fields(stations.withColumn("x", x).withColumn("y", y), fields, grid, first, second)
    return obs.attach_day_means(observations, obs.station_day_sums(samples, stations), stations)


def evaluate_accuracy(
    station_days: DataFrame, incidents: DataFrame, predictors: list[str], truth: str = "pm25_value"
) -> dict[str, DataFrame]:
    """Stratified metrics, raw and log metrics, distributions; the input must not be empty.

    The joined table is read by several aggregates, so it is staged once.
    """
    obs.require_rows(station_days, "station-day table")
    near = stage(metrics.add_strata(spatial.proximity_bins(station_days, incidents)))
    return {
        "summary": metrics.stratified_metrics(near, truth, predictors),
        "overall": metrics.overall_metrics(station_days, truth, predictors),
        "distribution": metrics.distribution(station_days, truth, predictors),
    }
