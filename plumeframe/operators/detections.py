"""Per-incident and per-group statistics of assigned detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeframe.functions.scalars import confidence_class, progress_bin, ratio, relative_progress, size_bucket
from plumeframe.scale import beside, with_quantiles


def active_window_days():
    return F.greatest(F.datediff("end_date", "start_date") + 1, F.lit(1))


def valid_detections(detections: DataFrame, min_day=None, max_day=None) -> DataFrame:
    """World-range coordinates, FRP present and not negative, day present and inside the range."""
    keep = (
        F.col("acq_day").isNotNull()
        & F.col("lat").between(-90.0, 90.0)
        & F.col("lon").between(-180.0, 180.0)
        & (F.col("frp") >= 0)
        & ~F.isnan("frp")
    )
    if min_day is not None:
        keep = keep & (F.col("acq_day") >= F.lit(min_day))
    if max_day is not None:
        keep = keep & (F.col("acq_day") <= F.lit(max_day))
    return detections.filter(keep)


def run_window(detections: DataFrame, run_start, run_end) -> DataFrame:
    """Detections from two days before the run to 64 days after it, to the minute."""
    first = F.date_sub(F.lit(run_start), 2).cast("timestamp")
    last = F.date_add(F.lit(run_end), 64).cast("timestamp") + F.expr("INTERVAL '23:59' HOUR TO MINUTE")
    return detections.filter(F.col("acq_ts").between(first, last))


def incident_stats(assigned: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row per incident with counts, FRP and extent of its assigned detections."""
    inside = F.col("phase") == "in"
    # Days first, so the distinct-day count needs no wide shuffle of detections.
    daily = assigned.groupBy("incident_id", "acq_day").agg(
        F.count_if(inside).alias("_n"),
        F.count_if(F.col("phase") == "pre").alias("_pre"),
        F.count_if(F.col("phase") == "post").alias("_post"),
        F.sum(F.when(inside, F.col("frp"))).alias("_frp"),
        F.min(F.when(inside, F.col("frp"))).alias("_lo"),
        F.max(F.when(inside, F.col("frp"))).alias("_hi"),
        F.min(F.when(inside, F.col("lon"))).alias("_w"),
        F.max(F.when(inside, F.col("lon"))).alias("_e"),
        F.min(F.when(inside, F.col("lat"))).alias("_s"),
        F.max(F.when(inside, F.col("lat"))).alias("_nn"),
    )
    per_incident = daily.groupBy("incident_id").agg(
        F.sum("_n").alias("pixels_in_window_anyconf"),
        F.sum("_frp").alias("frp_sum_in_window"),
        F.min("_lo").alias("frp_min_in_window"),
        F.max("_hi").alias("frp_max_in_window"),
        F.sum("_pre").alias("pre_start_pixels_pad"),
        F.sum("_post").alias("post_end_pixels_pad"),
        F.count_if(F.col("_n") > 0).alias("days_with_pixels_anyconf"),
        (F.max("_e") - F.min("_w")).alias("det_bbox_lon_span_deg"),
        (F.max("_nn") - F.min("_s")).alias("det_bbox_lat_span_deg"),
    )
    counts = ["pixels_in_window_anyconf", "pre_start_pixels_pad", "post_end_pixels_pad", "days_with_pixels_anyconf"]
    pixels, frp = F.col("pixels_in_window_anyconf"), F.col("frp_sum_in_window")
    return (
        incidents.drop("rings")
        .join(per_incident, "incident_id", "left")
        .fillna(0, counts)
        .fillna(0.0, ["frp_sum_in_window"])
        .withColumn("size_bucket", size_bucket("size_acres"))
        .withColumn("active_window_days", active_window_days())
        .withColumn("frp_mean_in_window", ratio(frp, pixels))
        .withColumn(
            "pct_active_days_with_pixels_anyconf", ratio(F.col("days_with_pixels_anyconf"), F.col("active_window_days"))
        )
        .withColumn("pixels_per_1000_acres", ratio(pixels, F.col("size_acres") / 1000.0))
        .withColumn("frp_per_acre", ratio(frp, F.col("size_acres")))
    )


def in_window_pixels(assigned: DataFrame) -> DataFrame:
    """Assigned detections inside their window, with bucket, year and tenth of the window."""
    offset = F.datediff("acq_day", "start_date")
    return (
        assigned.filter(F.col("phase") == "in")
        .withColumn("size_bucket", size_bucket("size_acres"))
        .withColumn("active_window_days", active_window_days())
        .withColumn("rel_bin", progress_bin(relative_progress(offset, F.col("active_window_days")), 10))
        .withColumn("year", F.year("acq_day"))
    )


def grouped_pixel_stats(pixels: DataFrame, groups: Sequence[str], count_incidents: bool = True, share: bool = True) -> DataFrame:
    """Pixel count, FRP mean / median / p90, distinct incidents and share of all pixels per group."""
    groups = list(groups)
    per_incident = pixels.groupBy(*groups, "incident_id").agg(F.count("*").alias("_n"), F.sum("frp").alias("_frp"))
    aggs = [F.sum("_n").alias("pixel_count"), (F.sum("_frp") / F.sum("_n")).alias("frp_mean")]
    if count_incidents:
        aggs.append(F.count("*").alias("fire_count"))
    out = per_incident.groupBy(*groups).agg(*aggs)
    out = with_quantiles(out, pixels, groups, {"frp_median": ("frp", 0.5), "frp_p90": ("frp", 0.9)})
    if share:
        # A handful of group rows: the total is a window over the aggregate.
        out = out.withColumn("pixel_share", F.col("pixel_count") / F.sum("pixel_count").over(Window.partitionBy(F.lit(0))))
    return out


def overall_summary(stats: DataFrame, pixels: DataFrame) -> DataFrame:
    """One row over all incidents and all in-window pixels."""
    per_incident = stats.agg(
        F.count("*").alias("fire_count"),
        F.count_if(F.col("pixels_in_window_anyconf") > 0).alias("fires_with_any_pixels"),
        F.avg("pixels_in_window_anyconf").alias("mean_pixels_per_fire"),
        (F.sum("days_with_pixels_anyconf") / F.greatest(F.sum("active_window_days"), F.lit(1))).alias(
            "weighted_pct_active_days_with_pixels_anyconf"
        ),
    )
    per_incident = with_quantiles(
        per_incident,
        stats,
        [],
        {
            "median_pixels_per_fire": ("pixels_in_window_anyconf", 0.5),
            "p90_pixels_per_fire": ("pixels_in_window_anyconf", 0.9),
        },
    )
    per_pixel = with_quantiles(
        pixels.agg(
            F.count("*").alias("total_pixels_in_window_anyconf"),
            F.avg("frp").alias("frp_mean_pixel"),
            F.avg((F.col("daynight") == "D").cast("int")).alias("day_fraction"),
            F.avg((F.col("daynight") == "N").cast("int")).alias("night_fraction"),
        ),
        pixels,
        [],
        {"frp_median_pixel": ("frp", 0.5), "frp_p90_pixel": ("frp", 0.9), "frp_p99_pixel": ("frp", 0.99)},
    )
    return beside(per_incident, per_pixel)


def top_incidents(stats: DataFrame, by: str, k: int = 25, min_pixels: int = 0) -> DataFrame:
    """The k highest incidents by a column; ties by id."""
    kept = stats.filter(F.col("pixels_in_window_anyconf") >= min_pixels) if min_pixels else stats
    return kept.orderBy(F.col(by).desc_nulls_last(), F.col("incident_id")).limit(k)


def coherence_daily(assigned: DataFrame) -> DataFrame:
    """Per incident and day: all detections, high or nominal ones, low ones, phase."""
    klass = confidence_class("confidence")
    return assigned.groupBy("incident_id", "acq_day", "phase").agg(
        F.count("*").alias("n"),
        F.count_if(klass.isin("h", "n")).alias("hn"),
        F.count_if(klass == "l").alias("low"),
    )


def coherence_metrics(assigned: DataFrame, incidents: DataFrame) -> DataFrame:
    """How well the detections of an incident fill its window, one row per incident."""
    daily = coherence_daily(assigned)
    inside = F.col("phase") == "in"
    day = F.col("acq_day")
    per = daily.groupBy("incident_id").agg(
        F.sum("n").alias("total_window_detections"),
        F.sum(F.when(inside, F.col("n"))).alias("in_window_detections"),
        F.sum(F.when(F.col("phase") == "pre", F.col("n"))).alias("pre_start_detections"),
        F.sum(F.when(F.col("phase") == "post", F.col("n"))).alias("post_end_detections"),
        F.sum("hn").alias("high_nom_total_window"),
        F.sum(F.when(inside, F.col("hn"))).alias("high_nom_in_window"),
        F.sum("low").alias("low_total_window"),
        F.count_if(inside).alias("days_with_any_detection_in_window"),
        F.count_if(inside & (F.col("hn") > 0)).alias("days_with_any_hn_in_window"),
        F.count_if(inside & (F.col("hn") > 3)).alias("_gt3"),
        F.count_if(inside & F.col("hn").between(1, 3)).alias("_one_to_three"),
        F.min(day).alias("first_detection_date"),
        F.max(day).alias("last_detection_date"),
        F.min(F.when(inside, day)).alias("first_in_window_detection_date"),
        F.max(F.when(inside, day)).alias("last_in_window_detection_date"),
        F.max_by(day, F.when(inside, F.struct("n", -F.unix_date(day)))).alias("_peak"),
    )
    counts = [
        "total_window_detections", "in_window_detections", "pre_start_detections", "post_end_detections",
        "high_nom_total_window", "high_nom_in_window", "low_total_window", "days_with_any_detection_in_window",
        "days_with_any_hn_in_window", "_gt3", "_one_to_three",
    ]
    out = incidents.drop("rings").join(per, "incident_id", "left").fillna(0, counts)
    out = out.withColumn("active_window_days", active_window_days())
    active, total = F.col("active_window_days"), F.col("total_window_detections")
    first, last = F.col("first_in_window_detection_date"), F.col("last_in_window_detection_date")
    any_in = F.col("in_window_detections") > 0
    lead = F.datediff("start_date", "first_detection_date")
    lag = F.datediff("last_detection_date", "end_date")
    span = F.coalesce(F.datediff(last, first) + 1, F.lit(0))
    return (
        out.withColumn("in_window_share", ratio(F.col("in_window_detections"), total))
        .withColumn("noise_share", ratio(F.col("pre_start_detections") + F.col("post_end_detections"), total))
        .withColumn("pct_active_days_with_any_detection", F.col("days_with_any_detection_in_window") / active)
        .withColumn("pct_active_days_with_any_hn", F.col("days_with_any_hn_in_window") / active)
        .withColumn("pct_active_days_few_hn_le3", (active - F.col("_gt3")) / active)
        .withColumn("pct_active_days_hn_1to3", F.col("_one_to_three") / active)
        .withColumn("days_before_start_first_detection", F.greatest(F.coalesce(lead, F.lit(0)), F.lit(0)))
        .withColumn("days_after_end_last_detection", F.greatest(F.coalesce(lag, F.lit(0)), F.lit(0)))
        .withColumn("in_window_detection_span_days", span)
        .withColumn("in_window_detection_span_frac", F.when(any_in, span / active))
        .withColumn(
            "in_window_peak_relative_position",
            F.when(any_in, relative_progress(F.datediff("_peak", "start_date"), active)),
        )
        .drop("_gt3", "_one_to_three", "_peak")
    )


def relative_profile(assigned: DataFrame) -> DataFrame:
    """Share of an incident's high or nominal detections per tenth of its window, averaged over incidents."""
    klass = confidence_class("confidence")
    kept = assigned.filter((F.col("phase") == "in") & klass.isin("h", "n"))
    offset = F.datediff("acq_day", "start_date")
    binned = (
        kept.withColumn("bin_index", progress_bin(relative_progress(offset, active_window_days()), 10))
        .groupBy("incident_id", "bin_index")
        .agg(F.count("*").alias("_n"))
        .withColumn("_share", F.col("_n") / F.sum("_n").over(Window.partitionBy("incident_id")))
    )
    incidents = F.coalesce(binned.agg(F.count_distinct("incident_id")).scalar(), F.lit(0))
    sums = binned.groupBy("bin_index").agg(F.sum("_share").alias("_sum"))
    return (
        sums.sparkSession.range(10)
        .select(F.col("id").cast("int").alias("bin_index"))
        .join(sums, "bin_index", "left")
        .select(
            "bin_index",
            (F.col("bin_index") / 10).alias("bin_start_rel"),
            ((F.col("bin_index") + 1) / 10).alias("bin_end_rel"),
            F.coalesce(ratio(F.col("_sum"), incidents), F.lit(0.0)).alias("avg_profile_share"),
        )
    )


def provider_summary(metrics: DataFrame) -> DataFrame:
    """One row per provider: counts, totals, weighted shares, medians."""
    total = F.greatest(F.sum("total_window_detections"), F.lit(1))
    days = F.greatest(F.sum("active_window_days"), F.lit(1))
    noise = F.sum("pre_start_detections") + F.sum("post_end_detections")
    out = metrics.groupBy("provider").agg(
        F.count("*").alias("fire_count"),
        F.avg("size_acres").alias("mean_size_acres"),
        F.avg("active_window_days").alias("mean_active_window_days"),
        F.count_if(F.col("total_window_detections") > 0).alias("fires_with_any_window_detection"),
        F.count_if(F.col("in_window_detections") > 0).alias("fires_with_any_in_window_detection"),
        F.sum("total_window_detections").alias("total_window_detections"),
        F.sum("in_window_detections").alias("total_in_window_detections"),
        F.sum("pre_start_detections").alias("total_pre_start_detections"),
        F.sum("post_end_detections").alias("total_post_end_detections"),
        (F.sum("in_window_detections") / total).alias("in_window_detection_share_total"),
        (noise / total).alias("noise_share_total"),
        F.avg("in_window_share").alias("mean_in_window_share_per_fire"),
        F.avg("noise_share").alias("mean_noise_share_per_fire"),
        (F.sum("days_with_any_detection_in_window") / days).alias("pct_active_days_with_any_detection_weighted"),
        (F.sum("days_with_any_hn_in_window") / days).alias("pct_active_days_with_any_hn_weighted"),
        (F.sum(F.col("pct_active_days_few_hn_le3") * F.col("active_window_days")) / days).alias(
            "pct_active_days_few_hn_le3_weighted"
        ),
    )
    medians = {
        "median_size_acres": "size_acres",
        "median_active_window_days": "active_window_days",
        "median_days_before_start_first_detection": "days_before_start_first_detection",
        "median_days_after_end_last_detection": "days_after_end_last_detection",
        "median_in_window_detection_span_frac": "in_window_detection_span_frac",
        "median_in_window_peak_relative_position": "in_window_peak_relative_position",
    }
    return with_quantiles(out, metrics, ["provider"], {name: (column, 0.5) for name, column in medians.items()})


def frp_by(pixels: DataFrame, group: str, dense: int | None = None) -> DataFrame:
    """Count, mean, median, p90 of FRP per year or per bin; ``dense`` keeps empty bins 0..dense-1."""
    out = pixels.groupBy(group).agg(F.count("*").alias("detection_count"), F.avg("frp").alias("mean_frp"))
    out = with_quantiles(out, pixels, [group], {"median_frp": ("frp", 0.5), "p90_frp": ("frp", 0.9)})
    if dense is None:
        return out
    bins = pixels.sparkSession.range(dense).select(F.col("id").cast("int").alias(group))
    return bins.join(out, group, "left").fillna(0, ["detection_count"])


def daily_series(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("incident_id", F.col("acq_day").alias("day")).agg(
        F.count("*").alias("pixel_count"), F.sum("frp").alias("frp_total"), F.avg("frp").alias("frp_mean_pixel")
    )


def panel_counts(panel: DataFrame, assigned: DataFrame) -> DataFrame:
    """Counts by class and by day or night, FRP sum and mean on every panel row; zero where none."""
    klass = confidence_class("confidence", numeric=False)
    names = [
        "viirs_pixels_total", "viirs_pixels_conf_h", "viirs_pixels_conf_n", "viirs_pixels_conf_l",
        "viirs_pixels_conf_u", "viirs_pixels_day", "viirs_pixels_night",
    ]
    counted = assigned.groupBy("incident_id", F.col("acq_day").alias("day")).agg(
        F.count("*").alias(names[0]),
        *[F.count_if(klass == c).alias(f"viirs_pixels_conf_{c}") for c in "hnlu"],
        F.count_if(F.col("daynight") == "D").alias("viirs_pixels_day"),
        F.count_if(F.col("daynight") == "N").alias("viirs_pixels_night"),
        F.sum("frp").alias("viirs_frp_sum_mw"),
    )
    total = F.col("viirs_pixels_total")
    return (
        panel.join(counted, ["incident_id", "day"], "left")
        .fillna(0, names)
        .fillna(0.0, ["viirs_frp_sum_mw"])
        .withColumn("viirs_frp_mean_mw", ratio(F.col("viirs_frp_sum_mw"), total))
        .withColumn("has_viirs", (total > 0).cast("int"))
        .withColumn("no_viirs", (total == 0).cast("int"))
    )


def minute_counts(assigned: DataFrame) -> DataFrame:
    from plumeframe.functions.scalars import epoch_minute

    return assigned.groupBy("incident_id", epoch_minute("acq_ts").alias("minute_int")).agg(
        F.count("*").alias("pixel_count")
    )
