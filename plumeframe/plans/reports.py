"""Composite reports: tables a user asks for in one call, each a lazy plan over the same operators.

Tables read by several parts of a report are staged once with a reliable checkpoint.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeframe.functions import geo
from plumeframe.functions import scalars as s
from plumeframe.operators import detections as det
from plumeframe.operators import grids, incidents, linkage, models, overpass, spatial, stability, temporal
from plumeframe.scale import stage, top_rows, with_quantiles


def incident_detection_report(detections: DataFrame, fires: DataFrame, pad_days: int = 2) -> dict[str, DataFrame]:
    """Detections per incident, grouped pixel statistics, summary and top lists."""
    assigned = stage(spatial.assign_points(detections, fires, pad_days, "size"))
    stats = stage(det.incident_stats(assigned, fires))
    pixels = det.in_window_pixels(assigned)
    out = {"incidents": stats, "pixels": pixels, "overall": det.overall_summary(stats, pixels)}
    for name, column in (("cause", "cause_general"), ("size_bucket", "size_bucket"), ("state", "state")):
        out[f"by_{name}"] = det.grouped_pixel_stats(pixels, [column])
    out["by_progress"] = det.grouped_pixel_stats(pixels, ["rel_bin"], False, False)
    out["by_year"] = det.grouped_pixel_stats(pixels, ["year"], False, False)
    out["top_by_pixels"] = det.top_incidents(stats, "pixels_in_window_anyconf")
    out["top_by_density"] = det.top_incidents(stats, "pixels_per_1000_acres")
    out["top_by_mean_frp"] = det.top_incidents(stats, "frp_mean_in_window", min_pixels=50)
    return out


def stability_tables(fires: DataFrame, pixels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Panel with transitions, pixel drops, FRP drops."""
    panel = temporal.daily_panel(fires, det.daily_series(pixels))
    rows = stage(stability.add_transitions(stability.add_transitions(panel, "pixel_count", "pix"), "frp_total", "frp"))
    return (
        rows,
        stability.drop_events(rows, "pixel_count", "pix", "pixel_count"),
        stability.drop_events(rows, "frp_total", "frp", "frp_total"),
    )


def stability_report(fires: DataFrame, pixels: DataFrame) -> dict[str, DataFrame]:
    rows, pixel_drops, frp_drops = stability_tables(fires, pixels)
    drops = pixel_drops.unionByName(frp_drops)
    streaks = stability.drop_streaks(rows, "pixel_count", "pix", "pixel_count").unionByName(
        stability.drop_streaks(rows, "frp_total", "frp", "frp_total")
    )
    return {
        "daily": rows,
        "pixel_drops": pixel_drops,
        "frp_drops": frp_drops,
        "drop_summary": stability.summarize_drops(drops),
        "rebound_summary": stability.summarize_rebounds(drops),
        "transition_mix": stability.transition_mix(rows),
        "streaks": streaks,
        "streak_summary": stability.summarize_streaks(streaks),
        "day_of_fire_curve": stability.day_of_fire_curve(rows),
        "relative_curve": stability.relative_curve(rows),
    }


def continuous_size_report(fires: DataFrame, pixels: DataFrame, metric: str = "pixel_drop_rate") -> dict[str, DataFrame]:
    rows, pixel_drops, frp_drops = stability_tables(fires, pixels)
    behaviour = stage(stability.incident_behaviour(rows, pixel_drops, frp_drops))
    sized = rows.filter("pix_prev is not null").withColumn("log10_size", F.log10("size_acres"))
    rebounds = pixel_drops.withColumn("log10_size", F.log10("size_acres"))
    return {
        "behaviour": behaviour,
        "profile": stability.progress_profile(rows),
        "smooth": stability.rolling_smooth(behaviour, "log10_size", metric),
        "drop_probability": stability.binned_mean(sized, "rel_progress", "log10_size", F.col("pix_is_drop").cast("int"), 1 / 38, 0.1, 20),
        "rebound_probability": stability.binned_mean(
            rebounds, "rel_progress", "log10_size", F.col("rebound_within_7d").cast("int"), 1 / 38, 0.1, 10
        ),
    }


def coherence_report(
    detections: DataFrame,
    providers: dict[str, DataFrame],
    pad_days: int = 5,
    link: tuple[str, str] | None = None,
    windows: tuple[int, int] | None = None,
) -> dict[str, DataFrame]:
    """Metrics per provider, their summary and profiles, and optionally the linked pairs of two providers.

    ``windows`` (pad days, end cap days) applies the per-provider window rules first.
    """
    metrics, profiles, frp_years, frp_bins, spans = None, None, None, None, {}
    for name, fires in providers.items():
        # A missing end counts as the start.
        fires = fires.withColumn("provider", F.lit(name)).withColumn("end_date", F.coalesce("end_date", "start_date"))
        if windows is not None:
            fires = incidents.custom_windows(fires, *windows)
        spans[name] = fires
        # Neither names nor the other columns that no table of the report reads are carried through the assignment.
        shapes = fires.select("incident_id", "size_acres", "start_date", "end_date", "min_lon", "min_lat", "max_lon", "max_lat", "rings")
        points = detections.select("det_id", "acq_day", "lon", "lat", "frp", "confidence")
        assigned = spatial.assign_points(points, shapes, pad_days, "window")
        assigned = stage(assigned.drop("lon", "lat", "min_lon", "min_lat", "max_lon", "max_lat"))
        pixels = det.in_window_pixels(assigned)
        parts = [
            det.coherence_metrics(assigned, fires),
            det.relative_profile(assigned),
            det.frp_by(pixels, "year"),
            det.frp_by(pixels, "rel_bin", dense=10),
        ]
        parts[1:] = [p.withColumn("provider", F.lit(name)) for p in parts[1:]]
        if metrics is None:
            metrics, profiles, frp_years, frp_bins = parts
        else:
            metrics, profiles, frp_years, frp_bins = (
                a.unionByName(b, allowMissingColumns=True) for a, b in zip((metrics, profiles, frp_years, frp_bins), parts)
            )
    metrics = stage(metrics)
    out = {
        "metrics": metrics, "summary": det.provider_summary(metrics), "profiles": profiles, "frp_by_year": frp_years,
        "frp_by_progress": frp_bins,
    }
    if link is not None:
        left, right = spans[link[0]], spans[link[1]]
        matches = stage(linkage.link_incidents(left, right))
        pairs = linkage.pair_differences(matches, left, right)
        # Metric tables of both sides ride along, prefixed.
        for side, name in (("left", link[0]), ("right", link[1])):
            keep = [c for c in metrics.columns if c.endswith(("detections", "share")) or c.startswith("pct_")]
            one = metrics.filter(F.col("provider") == name).select(
                F.col("incident_id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in keep]
            )
            pairs = pairs.join(one, f"{side}_id", "left")
        out["matches"] = pairs
        out["match_summary"] = linkage.match_summary(pairs, left, right)
    return out


# ---- clouds ----------------------------------------------------------------------------------


def attach_cloud(
    events: DataFrame, fires: DataFrame, granules: DataFrame, pixels: DataFrame, max_minutes: float
) -> DataFrame:
    """Drop-rebound events with granule, time distance, cloud percentage and pixels for their three times."""
    out = stage(events)
    for slot in ("prev", "drop", "next"):
        found = temporal.covering_granule(out.select(f"{slot}_time_utc").distinct(), granules, f"{slot}_time_utc", max_minutes)
        found = found.withColumnsRenamed({"granule_key": f"{slot}_cloud_key", "time_diff_min": f"{slot}_cloud_time_diff_min"})
        out = out.join(found, f"{slot}_time_utc", "left")
    out = stage(out)
    requests = overpass.request_set(out, [f"{slot}_cloud_key" for slot in ("prev", "drop", "next")])
    values = stage(overpass.cloud_fraction(pixels, fires, requests))
    columns = {"pct": F.col("cloud_frac") * 100.0, "pixels": F.col("cloud_pixels")}
    return overpass.attach_slots(out, values, {f"{p}_cloud": f"{p}_cloud_key" for p in ("prev", "drop", "next")}, columns)


def drop_rebound_cloud_report(
    detections: DataFrame,
    fires: DataFrame,
    granules: DataFrame,
    pixels: DataFrame,
    gap_minutes: int = 45,
    max_minutes: float = 30.0,
    max_incidents: int = 0,
    per_incident: int = 0,
    max_events: int = 0,
    **rules: float,
) -> dict[str, DataFrame]:
    nearby = spatial.envelope_filter(detections, fires)
    minutes = det.minute_counts(spatial.assign_points(nearby, fires, None, "area"))
    events = stage(overpass.overpass_events(minutes, gap_minutes))
    candidates = stage(overpass.drop_rebound_triplets(events, **rules))
    chosen = overpass.select_events(candidates, max_incidents, per_incident, max_events)
    meta = fires.select("incident_id", "name", "state", "size_acres", "start_date", "end_date")
    selected = stage(attach_cloud(chosen, fires, granules, pixels, max_minutes).join(meta, "incident_id", "left"))
    return {
        "events": events, "candidates": candidates, "selected": overpass.spike_metrics(selected),
        "summary": overpass.spike_summary(selected),
    }


def panel_clouds(
    panel: DataFrame, fires: DataFrame, granules: DataFrame, pixels: DataFrame, max_minutes: float = 45.0,
    round_minutes: int | None = None, not_before=None,
) -> DataFrame:
    """Panel rows (``incident_id, day, centroid_lon``) with cloud fractions at the day and night overpass."""
    day, night = s.overpass_hours("centroid_lon")
    out = panel
    for slot, hours in (("day", day), ("night", night)):
        target = s.day_plus_hours("day", hours)
        target = s.round_to_step(target, round_minutes) if round_minutes else target
        out = out.withColumn(f"{slot}_overpass_utc", target)
        out = temporal.nearest_granule(out, granules, f"{slot}_overpass_utc", max_minutes, not_before=not_before, prefix=f"{slot}_")
    out = stage(out)
    requests = overpass.request_set(out, ["day_granule_key", "night_granule_key"])
    values = overpass.cloud_fraction(pixels, fires, requests, skip_invalid=False)
    out = overpass.attach_slots(
        out, values, {"cloud_day": "day_granule_key", "cloud_night": "night_granule_key"}, {"frac": F.col("cloud_frac")}
    )
    return models.cloud_columns(out)


def cloud_panel(
    detections: DataFrame, fires: DataFrame, granules: DataFrame, pixels: DataFrame, rows: int, start: dt.date, end: dt.date,
    max_minutes: float = 50.0, seed: int = 42,
) -> DataFrame:
    """Sampled incident-days with detection counts by class and cloud percentages."""
    clon, clat = (F.col("min_lon") + F.col("max_lon")) / 2, (F.col("min_lat") + F.col("max_lat")) / 2
    near = fires.filter(geo.in_footprint(clon, clat))
    panel = models.sample_incident_days(near.drop("rings"), rows, start, end, seed).withColumn("centroid_lon", clon)
    panel = stage(panel.withColumn("centroid_lat", clat))
    assigned = spatial.assign_points(detections, near, None, "area", panel.select("incident_id", "day"))
    counted = det.panel_counts(panel, assigned)
    out = panel_clouds(counted, near, granules, pixels, max_minutes, 15, dt.datetime(2022, 3, 1))
    return out.withColumns({f"cloud_{p}_pct": F.col(f"cloud_{p}_frac") * 100.0 for p in ("day", "night")})


def missing_cause_report(
    detections: DataFrame, fires: DataFrame, granules: DataFrame, pixels: DataFrame, sample: int | None = None,
    max_days: int | None = None, max_minutes: float = 45.0, seed: int = 42,
) -> dict[str, object]:
    """Why days have no detections: cloud at the overpasses or age of the incident. All days unless ``max_days`` is given."""
    clon, clat = (F.col("min_lon") + F.col("max_lon")) / 2, (F.col("min_lat") + F.col("max_lat")) / 2
    near = fires.filter(geo.in_footprint(clon, clat))
    if sample is not None:
        near = models.stratified_sample(near, sample, seed).drop("size_bucket")
    near = stage(near)
    last = F.col("end_date") if max_days is None else F.least(F.col("end_date"), F.date_add("start_date", max_days - 1))
    days = F.sequence(F.col("start_date"), last)
    panel = near.drop("rings").withColumn("day", F.explode(days)).withColumn("centroid_lon", clon)
    panel = panel.withColumn("days_since_start", F.datediff("day", "start_date"))
    windows = near.withColumn("end_date", last)
    assigned = spatial.assign_points(detections, windows, 0, "rounded")
    counted = det.panel_counts(panel, assigned)
    panel = stage(panel_clouds(counted, near, granules, pixels, max_minutes))
    rows = panel.filter(F.col("cloud_day_frac").isNotNull() & F.col("cloud_night_frac").isNotNull())
    columns = ["days_since_start", "cloud_day_frac", "cloud_night_frac"]
    scaled = stage(models.standardize(rows, columns))
    z = [f"{c}_z" for c in columns]
    fit = models.fit_logistic(scaled, "no_viirs", z)
    scored = scaled.withColumn("p_missing", models.logistic_score(fit, z))
    from plumeframe.operators.metrics import rank_auc

    causes = models.attribute_missing(scaled, fit, z[0], z[1:])
    return {
        "panel": panel, "model_rows": rows, "coefficients": fit, "odds_ratios": models.odds_ratios(fit),
        "auc": rank_auc(scored, [], "no_viirs", "p_missing"), "rates": models.missing_rates(rows), "attribution": causes,
        "cause_shares": causes.groupBy("dominant_cause").agg(F.count("*").alias("rows")),
    }


def two_sensor_timeline(
    frames: DataFrame, granules: DataFrame, mask: DataFrame, lattice: DataFrame, points: DataFrame, slots: int, max_minutes: float
) -> DataFrame:
    """Cells seen now and so far by the imager (granule nearest to each frame) and by the point sensor."""
    fire = grids.mask_on_lattice(mask, lattice, ["granule_key"])
    fire = fire.filter(s.is_fire_pixel("mask", "quality")).select("granule_key", "gx", "gy").distinct()
    near = temporal.nearest_granule(frames, granules, "frame_ts", max_minutes, later_wins=True)
    imager = near.join(fire, "granule_key").select("slot", "gx", "gy")
    named = lambda df, p: df.select("slot", F.col("cells").alias(f"{p}_cells"), F.col("cells_so_far").alias(f"{p}_cells_so_far"))
    return named(temporal.slot_growth(imager, slots), "imager").join(named(temporal.slot_growth(points, slots), "point"), "slot")


# ---- coverage --------------------------------------------------------------------------------


def window_hours(fires: DataFrame) -> DataFrame:
    """Incident windows in whole hours (``start_ts``, ``end_ts``)."""
    start, end = s.hour_floor("start_ts"), s.hour_floor("end_ts")
    hours = (F.unix_seconds(end) - F.unix_seconds(start)) / 3600 + 1
    return fires.withColumns({"start_hour": start, "end_hour": end}).withColumn(
        "duration_hours", F.greatest(hours, F.lit(0.0))
    )


def temporal_coverage(fires: DataFrame, detections: DataFrame) -> DataFrame:
    """How much of each incident window lies inside the time range of the detections."""
    span = detections.agg(F.struct(F.min("hour_utc").alias("lo"), F.max("hour_utc").alias("hi")).alias("r")).scalar()
    low, high = F.greatest(F.col("start_hour"), span["lo"]), F.least(F.col("end_hour"), span["hi"])
    hours = F.greatest(F.floor((F.unix_seconds(high) - F.unix_seconds(low)) / 3600) + 1, F.lit(0))
    return window_hours(fires).withColumns(
        {
            "window_fully_covered": (F.col("start_hour") >= span["lo"]) & (F.col("end_hour") <= span["hi"]),
            "overlap_hours": hours,
        }
    ).withColumn("overlap_fraction", F.col("overlap_hours") / F.greatest(F.col("duration_hours"), F.lit(1.0)))


def _day_overlap(detections: DataFrame, days: DataFrame) -> DataFrame:
    """``incident_id, _day, n, s, m, h``: number, sum and maximum of FRP and a bit per hour of the detections in a box's day.

    Detections of one place are added up before they meet the boxes: by day where a window holds the whole day, by hour on
    the days that it cuts.
    """
    at = ["lon", "lat", "_day"]
    hourly = detections.groupBy("lon", "lat", F.to_date("hour_utc").alias("_day"), "hour_utc").agg(
        F.count("*").alias("n"), F.sum("frp").alias("s"), F.max("frp").alias("m")
    )
    hourly = hourly.withColumn("h", F.expr("shiftleft(1L, hour(hour_utc))"))
    sums = [F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("m").alias("m"), F.bit_or("h").alias("h")]
    midnight = F.col("_day").cast("timestamp")
    whole = (F.col("start_hour") <= midnight) & (F.col("end_hour") >= midnight + F.expr("interval 23 hours"))
    inside = F.col("hour_utc").between(F.col("start_hour"), F.col("end_hour"))
    held = spatial.places_in_boxes(hourly.groupBy(*at).agg(*sums), days.filter(whole))
    cut = spatial.places_in_boxes(hourly, days.filter(~whole)).filter(inside)
    keep = ["incident_id", "_day", "n", "s", "m", "h"]
    return held.select(*keep).unionByName(cut.select(*keep)).groupBy("incident_id", "_day").agg(*sums)


def incident_overlap(fires: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections in each incident's box and window hours; incidents without any stay with zero."""
    windows = window_hours(fires)
    days = windows.select("incident_id", "min_lon", "min_lat", "max_lon", "max_lat", "start_hour", "end_hour").withColumn(
        "_day", F.explode(F.sequence(F.to_date("start_hour"), F.to_date("end_hour")))
    )
    per_day = _day_overlap(detections, days).withColumn("_first", F.col("h").bitwiseAND(-F.col("h")))
    # The place of the lowest and of the highest bit of a day's hours.
    hour = lambda bits: F.timestamp_seconds(F.unix_date("_day").cast("bigint") * 86400 + (F.length(F.bin(bits)) - 1) * 3600)
    per = per_day.groupBy("incident_id").agg(
        F.sum("n").alias("points"), F.sum(F.bit_count("h")).alias("hours"), F.sum("s").alias("total_frp"), F.max("m").alias("max_frp"),
        F.min(hour(F.col("_first"))).alias("first_hour"), F.max(hour(F.col("h"))).alias("last_hour"),
    )
    gap = lambda a, b: (F.unix_seconds(a) - F.unix_seconds(b)) / 3600
    return (
        windows.drop("rings").join(per, "incident_id", "left")
        .fillna(0, ["points", "hours"]).fillna(0.0, ["total_frp"])
        .withColumn("hours_to_first", gap("first_hour", "start_hour"))
        .withColumn("hours_from_last_to_end", gap("end_hour", "last_hour"))
    )


def overlap_summary(overlap: DataFrame) -> DataFrame:
    out = overlap.agg(
        F.count("*").alias("fires_total"),
        F.count_if(F.col("points") > 0).alias("fires_with_overlap"),
        F.count_if(F.col("points") == 0).alias("fires_without_overlap"),
    )
    wanted = {"median_points": "points", "median_hours": "hours", "median_hours_to_first": "hours_to_first", "median_hours_from_last_to_end": "hours_from_last_to_end"}
    return with_quantiles(out, overlap, [], {name: (c, 0.5) for name, c in wanted.items()})


def sample_overlap(samples: DataFrame, detections: DataFrame) -> DataFrame:
    """Detections at each sample's hours inside its box; samples without any stay with zero.

    Samples of one box, run date and hours are one class, detections of one place and hour are added up; only classes and
    places meet, and every sample looks up its class.
    """
    box = ["bbox_min_lon", "bbox_min_lat", "bbox_max_lon", "bbox_max_lat"]
    of_class = [*box, "run_date", "_hours"]
    listed = samples.withColumn("_hours", spatial.sample_hours())
    # A checkpoint, not a table: its few bytes would have all its boxes' cells sent to every task.
    classes = stage(listed.select(*of_class).distinct().withColumn("_class", F.monotonically_increasing_id()))
    hours = classes.select("_class", *box, "run_date", F.explode("_hours").alias("_hour"))
    hours = hours.select("_class", *box, spatial.hour_of_day("run_date", "_hour").alias("hour_utc"))
    places = detections.groupBy("lon", "lat", "hour_utc").agg(F.count("*").alias("n"), F.sum("frp").alias("s"), F.max("frp").alias("m"))
    # An hour has few places: wider cells than those of points, so that a box is in fewer of them.
    pairs = spatial.places_in_sample_hours(places, hours, box, 0.5)
    hourly = pairs.groupBy("_class", "hour_utc").agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"), F.max("m").alias("_m"))
    per = hourly.groupBy("_class").agg(
        F.sum("_n").alias("points"), F.count("*").alias("matched_hours"), F.sum("_s").alias("total_frp"), F.max("_m").alias("max_frp")
    )
    out = listed.join(classes.join(per, "_class").drop("_class"), of_class, "left").drop("_hours").select(*samples.columns, *per.columns[1:])
    out = out.fillna(0, ["points", "matched_hours"]).fillna(0.0, ["total_frp"])
    return out.withColumn("sample_has_detections", F.col("points") > 0).withColumn("run_year", F.year("run_date"))


def sample_overlap_by(overlap: DataFrame, group: str) -> DataFrame:
    has = F.col("sample_has_detections").cast("int")
    out = overlap.groupBy(group).agg(
        F.count("*").alias("samples"), F.sum(has).alias("samples_with_detections"), F.avg(has).alias("pct_with_detections")
    )
    return with_quantiles(out, overlap, [group], {"median_points": ("points", 0.5), "median_matched_hours": ("matched_hours", 0.5)})


QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


def incident_profile(fires: DataFrame) -> dict[str, DataFrame]:
    """Incidents by state, by start year, and quantiles of size and duration."""
    rows = window_hours(fires).withColumn("duration_days", F.col("duration_hours") / 24.0).withColumn("start_year", F.year("start_ts"))
    medians = {"median_size_acres": ("size_acres", 0.5), "median_duration_days": ("duration_days", 0.5)}
    counted = lambda g: rows.groupBy(g).agg(F.count_distinct("incident_id").alias("fires"))
    quantiles = None
    for column in ("size_acres", "duration_days"):
        from plumeframe.scale import exact_quantiles

        wide = exact_quantiles(rows, [], {f"q{int(q * 100)}": (column, q) for q in QUANTILES})
        wide = wide.withColumn("measure", F.lit(column))
        quantiles = wide if quantiles is None else quantiles.unionByName(wide)
    return {
        "by_state": with_quantiles(counted("state"), rows, ["state"], medians),
        "by_year": with_quantiles(counted("start_year"), rows, ["start_year"], {"median_size_acres": ("size_acres", 0.5)}),
        "quantiles": quantiles,
    }


def detection_profile(detections: DataFrame) -> dict[str, DataFrame]:
    rows = detections.withColumn("date_utc", F.to_date("hour_utc")).withColumn("year_utc", F.year("hour_utc"))
    return {
        "by_day": rows.groupBy("date_utc").agg(F.count("*").alias("points"), F.sum("frp").alias("total_frp")),
        "by_year": with_quantiles(
            rows.groupBy("year_utc").agg(F.count("*").alias("points")), rows, ["year_utc"],
            {"median_frp": ("frp", 0.5), "frp_p95": ("frp", 0.95)},
        ),
    }


def coverage_report(fires: DataFrame, detections: DataFrame, samples: DataFrame | None = None) -> dict[str, DataFrame]:
    covered = stage(temporal_coverage(fires, detections))
    overlap = stage(incident_overlap(fires, detections))
    out = {"coverage": covered, "incidents": overlap, "summary": overlap_summary(overlap)}
    out.update({f"incidents_{k}": v for k, v in incident_profile(fires).items()})
    out.update({f"detections_{k}": v for k, v in detection_profile(detections).items()})
    if samples is not None:
        rows = stage(sample_overlap(samples, detections))
        out.update({"samples": rows, "samples_by_split": sample_overlap_by(rows, "split"), "samples_by_year": sample_overlap_by(rows, "run_year")})
    return out


# ---- case studies ----------------------------------------------------------------------------


def projected(detections: DataFrame) -> DataFrame:
    x, y = geo.project("lon", "lat")
    return detections.withColumn("x", x).withColumn("y", y)


def incident_grids(fires: DataFrame, buffer_km: float, pixel_m: float, max_dim: int | None = None) -> DataFrame:
    """Incidents with their buffered projected box and fixed grid."""
    xmin, ymin, xmax, ymax = geo.projected_box("min_lon", "min_lat", "max_lon", "max_lat", buffer_km)
    boxed = fires.withColumn("xmin", xmin).withColumn("ymin", ymin).withColumn("xmax", xmax).withColumn("ymax", ymax)
    return grids.fixed_grid(boxed, pixel_m, max_dim)


BOX_METRES = 100_000.0


def boxed_detections(points: DataFrame, boxes: DataFrame, extra_days: int = 0, hourly: bool = True) -> DataFrame:
    """Projected points inside each incident's projected box on the days of its window (plus some).

    Points of one place and hour, or without ``hourly`` of one place and day, are one row with their number ``n`` and their
    summed FRP: every table made of the pairs adds them up, so they are added before they meet the boxes.
    """
    size = BOX_METRES
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size).cast("int"), F.floor(F.col(b) / size).cast("int")))
    days = F.explode(F.sequence(F.col("start_date"), F.date_add("end_date", extra_days)))
    spread = boxes.drop("rings").withColumn("_gx", span("xmin", "xmax")).withColumn("_gy", span("ymin", "ymax")).withColumn("_day", days)
    at = ["x", "y", *(["hour_utc"] if hourly else []), F.col("acq_day").alias("_day")]
    placed = points.groupBy(*at).agg(F.sum("frp").alias("frp"), F.count("*").alias("n")).select(
        "*",
        F.floor(F.col("x") / size).cast("int").alias("_gx"), F.floor(F.col("y") / size).cast("int").alias("_gy"),
    )
    from plumeframe.scale import skew_join

    pairs = skew_join(placed, spread, ["_gx", "_gy", "_day"], ["x", "y"])
    inside = F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    return pairs.filter(inside).drop("_gx", "_gy").withColumnRenamed("_day", "day")


def in_sample_hours(points: DataFrame, sample_hours: Sequence[int]) -> DataFrame:
    """Rows of the sample hours; rows that are gathered by day have no hours left to choose from."""
    return points.filter(F.hour("hour_utc").isin(list(sample_hours))) if "hour_utc" in points.columns else points


def small_growth_case(
    pairs: DataFrame, sample_hours: Sequence[int], min_daily: int, max_growth: float, target_growth: float = 0.15,
) -> DataFrame:
    """The pair of consecutive days with a small growth of detections, best score first, one row.

    ``pairs`` comes from ``boxed_detections`` with one extra day; without hours they hold the sample hours already.
    """
    daily = in_sample_hours(pairs, sample_hours).groupBy("incident_id", "day").agg(F.sum("n").alias("today_count"))
    after = daily.select("incident_id", F.date_sub("day", 1).alias("day"), F.col("today_count").alias("next_count"))
    both = daily.join(after, ["incident_id", "day"])
    growth = (F.col("next_count") - F.col("today_count")) / F.col("today_count")
    score = F.abs(F.col("growth_ratio") - target_growth) + 0.0004 * (F.col("today_count") + F.col("next_count"))
    kept = both.withColumn("growth_ratio", growth).filter(
        (F.col("today_count") >= min_daily) & (F.col("next_count") >= min_daily) & (F.col("growth_ratio") > 0)
        & (F.col("growth_ratio") <= max_growth)
    )
    return kept.withColumn("score", score).orderBy("score", "incident_id", "day").limit(1)


def late_stage_examples(
    pairs: DataFrame, fires: DataFrame, min_daily: int = 20, target: float = 0.10, max_rel: float = 0.25, n: int | None = 3, window_days: int = 5,
    late: tuple[float, float] = (0.70, 0.98),
) -> DataFrame:
    """Days late in an incident's life with little power left, best one per incident; the ``n`` best incidents, or all."""
    meta = fires.select("incident_id", "start_date", "end_date", "size_acres").withColumn("duration_days", F.datediff("end_date", "start_date") + 1)
    daily = pairs.groupBy("incident_id", "day").agg(F.sum("frp").alias("day_frp"), F.sum("n").alias("day_count"))
    totals = daily.groupBy("incident_id").agg(F.max("day_frp").alias("peak_frp"))
    rows = daily.join(totals, "incident_id").join(meta, "incident_id").filter("peak_frp > 0")
    last = F.col("duration_days") - 1
    idx = F.datediff("day", "start_date")
    first_idx, last_idx = F.floor(last * late[0]), F.greatest(F.floor(last * late[1]), F.floor(last * late[0]))
    rel = F.col("day_frp") / F.col("peak_frp")
    to_end = F.datediff("end_date", "day") / F.greatest(last, F.lit(1))
    score = F.abs(F.col("rel_peak") - target) + 0.75 * to_end - 0.000004 * F.col("size_acres")
    kept = rows.withColumn("rel_peak", rel).filter(
        idx.between(first_idx, last_idx) & (F.col("day_count") >= min_daily) & (F.col("rel_peak") > 0) & (F.col("rel_peak") <= max_rel)
    )
    best = top_rows(kept.withColumn("score", score), ["incident_id"], [F.col("score"), F.col("day")])
    start = F.greatest(F.date_sub("anchor_day", max(0, window_days - 1)), F.col("start_date"))
    best = best.withColumnRenamed("day", "anchor_day").withColumn("window_start", start)
    return best if n is None else best.orderBy("score", "incident_id").limit(n)


def cumulative_and_recent(pairs: DataFrame, boxes: DataFrame, examples: DataFrame, pixel_m: float, window_days: int) -> dict[str, DataFrame]:
    """Per example: raster over the whole window, latest hit day per cell of the recent window, and totals."""
    chosen = pairs.join(examples.select("incident_id", "window_start", "anchor_day"), "incident_id")
    cumulative = grids.rasterize_fixed(chosen, ["incident_id"], pixel_m)
    recent = chosen.filter(F.col("day").between(F.col("window_start"), F.col("anchor_day"))).withColumn(
        "day_index", F.datediff("day", "window_start")
    )
    hits = grids.rasterize_fixed(recent, ["incident_id", "day_index"], pixel_m)
    per_day = hits.groupBy("incident_id", "day_index").agg(F.count("*").alias("pixels"))
    totals = (
        examples.select("incident_id")
        .join(cumulative.groupBy("incident_id").agg(F.sum("value").alias("cumulative_total_frp"), F.count("*").alias("cells")), "incident_id", "left")
        .join(recent.groupBy("incident_id").agg(F.sum("frp").alias("recent_window_total_frp")), "incident_id", "left")
        .fillna(0.0, ["cumulative_total_frp", "recent_window_total_frp"])
    )
    return {"cumulative": cumulative, "latest": grids.latest_hit_day(hits, ["incident_id"]), "per_day": per_day, "totals": totals}


def late_stage_report(
    detections: DataFrame, fires: DataFrame, pixel_m: float = 375.0, max_dim: int | None = None, buffer_km: float = 30.0, window_days: int = 5,
    min_acres: float = 50_000.0, min_days: int = 18, **search,
) -> dict[str, DataFrame]:
    eligible = incidents.eligible_incidents(fires, min_acres=min_acres, min_days=min_days)
    boxes = incident_grids(eligible, buffer_km, pixel_m, max_dim)
    pairs = stage(boxed_detections(projected(detections), boxes, hourly=False))
    examples = stage(late_stage_examples(pairs, boxes, window_days=window_days, **search))
    return {"examples": examples, **cumulative_and_recent(pairs, boxes, examples, pixel_m, window_days)}


def smoothing_scores(
    pairs: DataFrame, case: DataFrame, wind: DataFrame, pixel_m: float, sample_hours: Sequence[int], lead_hours: float = 24.0,
    gain: float = 0.35, sigma_truth: float = 1.8, clip: float = 0.35,
) -> DataFrame:
    """Scores of the spread baseline for a day pair, before and after the clipped residual."""
    key = "incident_id"
    rows = in_sample_hours(pairs, sample_hours).join(case.select(key, F.col("day").alias("_today")), key)
    sides = [key, "nx", "ny"]

    def binary(shift: int) -> DataFrame:
        day = rows.filter(F.col("day") == F.date_add("_today", shift))
        cells = grids.rasterize_fixed(day, sides, pixel_m)
        return cells.filter("value > 0").withColumn("value", F.lit(1.0)).drop("hits")

    today, truth = stage(binary(0)), stage(binary(1))
    smooth = grids.normalize_cells(grids.gaussian_blur(truth, sides, ("ny", "nx"), sigma_truth), sides)
    baseline = grids.spread_baseline(today, wind, key, ("ny", "nx"), pixel_m, lead_hours, gain)
    return grids.residual_scores(baseline, smooth, truth, sides, F.col("nx") * F.col("ny"), clip)


def smoothing_case_report(
    detections: DataFrame, fires: DataFrame, wind: DataFrame | None = None, sample_hours: Sequence[int] = (0, 6, 12, 18),
    pixel_m: float = 375.0, max_dim: int | None = None, buffer_km: float = 30.0, min_daily: int = 25, max_growth: float = 0.35, **scoring,
) -> dict[str, DataFrame]:
    """Find the day pair, then score the baseline; without ``wind`` (incident_id, u, v) the air is still."""
    boxes = incident_grids(incidents.eligible_incidents(fires), buffer_km, pixel_m, max_dim)
    pairs = stage(boxed_detections(projected(in_sample_hours(detections, sample_hours)), boxes, extra_days=1, hourly=False))
    case = stage(small_growth_case(pairs, sample_hours, min_daily, max_growth))
    if wind is None:
        wind = case.select("incident_id", F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))
    return {"case": case, "scores": smoothing_scores(pairs, case, wind, pixel_m, sample_hours, **scoring)}


# ---- point baseline --------------------------------------------------------------------------


def train_point_baseline(index: DataFrame, features: DataFrame, target: DataFrame, mass_channels: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Clean splits, log-space features and target, ridge fit, metrics per split.

    ``features`` has ``sample_id`` and one column per channel statistic, ``target`` has ``sample_id, y``.
    """
    meta = models.incident_meta(index)
    splits = stage(models.temporal_geo_split(meta))
    rows = index.select("sample_id", "fire_id", "run_date").join(splits.select("fire_id", F.col("split_clean").alias("split")), "fire_id")
    rows = rows.join(features, "sample_id").join(target, "sample_id")
    columns = [c for c in features.columns if c != "sample_id"]
    for c in columns:
        if c.split("__")[0] in mass_channels:
            rows = rows.withColumn(c, s.to_log_space(s.harmonize_units(c, "run_date")))
    rows = rows.withColumn("y_raw", s.harmonize_units("y", "run_date")).withColumn("y_log", s.to_log_space("y_raw"))
    rows = stage(rows)
    scored, metrics = models.ridge(rows, "split", columns, "y_log", "y_raw")
    return {"splits": splits, "split_summary": models.split_summary(splits), "scored": scored, "metrics": metrics}
