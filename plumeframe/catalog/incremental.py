"""Queries that run the incremental forms to completion and read their tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumeframe.catalog import tables as t
from plumeframe.catalog.models import sample_index
from plumeframe.catalog.observations import observations, stations, two_fields
from plumeframe.catalog.overpass import GAP
from plumeframe.catalog.registry import query
from plumeframe.functions.scalars import sample_key_daily
from plumeframe.operators import spatial
from plumeframe.scale import stage
from plumeframe.streaming import incremental as live


def _station_state(spark, sf):
    """Station hours arriving in three files, the second one with repeated hours."""
    source = t.scratch(spark, "hours")
    places = stage(stations(spark, sf))
    hours = stage(two_fields(spark, sf, places).select("station_id", "hour_utc", "value0", "value1"))
    parts = ["hour(hour_utc) < 8", "hour(hour_utc) < 16 and hour(hour_utc) >= 6", "hour(hour_utc) >= 16"]
    state = live.state_path(t.scratch(spark, "state"), places, first="MASSDEN", second="COLMD")
    for part in parts:
        # One arrival, one run: the second run skips the hours of the first.
        hours.filter(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(hours.schema).parquet(source)
        live.run_hours(stream, places, state)
    return hours, places, state


@query(
    "incremental_station_sums",
    "K1",
    t.with_tables("day_sums", "select station_id, date_local, round(sum0/n,5) as mean0, round(sum1/n,5) as mean1, n from day_sums"),
)
def incremental_station_sums(spark, sf):
    _, _, state = _station_state(spark, sf)
    out = live.current_sums(spark, state)
    return t.rounded(out.selectExpr("station_id", "date_local", "sum0/n as mean0", "sum1/n as mean1", "n"), 5)


@query(
    "station_snapshot",
    "K2 J3 K3",
    t.with_tables(
        "station_daily sample0",
        """select station_id, date_local, round(massden,5) as massden_daily_mean, found as hrrr_hours_found, complete as hrrr_day_complete, h as processed_hours from station_daily,
        (select count(distinct run_time) as h from (select run_time from sample0 union select run_time from sample1))""",
    ),
)
def station_snapshot(spark, sf):
    hours, places, state = _station_state(spark, sf)
    done = live.progress(spark, state, hours).select("processed_hours").scalar()
    rows = live.station_snapshot(observations(spark, sf), places, state)
    out = rows.select("station_id", "date_local", "massden_daily_mean", "hrrr_hours_found", "hrrr_day_complete", done.alias("processed_hours"))
    return t.rounded(out, 5)


@query(
    "incremental_samples",
    "K4 K5 F12 D24",
    t.with_tables("index", "select sample_id, fire_id||'|daily|'||strftime(run_date,'%Y-%m-%d')||'|0,6' as sample_key, split from index"),
)
def incremental_samples(spark, sf):
    """Two overlapping arrivals of samples; each sample is stored once."""
    source, table = t.scratch(spark, "arrivals"), t.scratch(spark, "samples")
    rows = sample_index(spark, sf).select(
        "sample_id", sample_key_daily("fire_id", "run_date", (0, 6)).alias("sample_key"), "split", F.lit("daily_4h_mean").alias("aggregation_mode"),
        F.lit("0,6").alias("source_hours_utc"), F.lit(0).cast("bigint").alias("seq"),
    )
    for part in ("sample_id % 3 <> 0", "sample_id % 3 <> 1"):
        rows.filter(part).write.mode("append").parquet(source)
        live.run_samples(spark.readStream.schema(rows.schema).parquet(source), table)
    out = live.sample_table(spark, table)
    live.check_resume(out, "daily_4h_mean", (0, 6))
    return out.select("sample_id", "sample_key", "split")


@query(
    "live_overpasses",
    "K6 F8",
    t.with_tables("overpasses", "select *, make_timestamp(event_mid_minute*60000000) as event_time_utc from overpasses"),
)
def live_overpasses(spark, sf):
    """A feed that comes in three arrivals: the first half, the second, and detections of both that were late."""
    source, state = t.scratch(spark, "feed"), t.scratch(spark, "overpasses")
    points = spatial.assign_points(t.detections(spark, sf), t.incidents(spark, sf), None, "area").select("det_id", "incident_id", "acq_ts")
    late, early = F.col("det_id") % 7 == 3, F.dayofmonth("acq_ts") <= 15
    for arrived in (early & ~late, ~early & ~late, late):
        points.filter(arrived).write.mode("append").parquet(source)
        live.run_detections(spark.readStream.schema("det_id bigint, incident_id bigint, acq_ts timestamp").parquet(source), state, GAP)
    return t.plain_times(live.live_overpasses(spark, state, GAP, ended=True).drop("open"))
