"""Day-to-day behaviour of an incident's detections: drops, rebounds, streaks, curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeframe.functions.scalars import progress_bin, ratio
from plumeframe.scale import positions, prefix_sums, with_quantiles

META = ("size_acres", "size_bucket", "active_window_days")


def stability_inputs(incidents: DataFrame, pixels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Incidents once each with usable dates, pixels with FRP that belong to them."""
    one = incidents.groupBy("incident_id").agg(F.min(F.struct(*[c for c in incidents.columns if c != "incident_id"])).alias("_r"))
    kept = (
        one.select("incident_id", "_r.*")
        .withColumns({"start_date": F.col("start_date").try_cast("date"), "end_date": F.col("end_date").try_cast("date")})
        .filter(F.col("end_date") >= F.col("start_date"))
    )
    length = F.datediff("end_date", "start_date") + 1
    given = F.col("active_window_days").try_cast("int") if "active_window_days" in kept.columns else F.lit(None)
    kept = kept.withColumn("active_window_days", F.coalesce(given, length))
    frp = F.col("frp").try_cast("double")
    good = pixels.withColumn("frp", frp).filter(F.col("frp").isNotNull() & ~F.isnan("frp") & (F.col("frp") >= 0))
    good = good.filter(F.col("acq_day").isNotNull())
    return kept, good.join(kept.select("incident_id"), "incident_id", "left_semi")


def _by_day() -> Window:
    # One row per incident and day: a partition is as long as one incident's window.
    return Window.partitionBy("incident_id").orderBy("day")


def add_transitions(panel: DataFrame, value: str, prefix: str) -> DataFrame:
    """Previous value, change, relative change, drop and increase flags; the first day has none."""
    prev, cur = F.col(f"{prefix}_prev"), F.col(value)
    return (
        panel.withColumn(f"{prefix}_prev", F.lag(value).over(_by_day()))
        .withColumn(f"{prefix}_delta", cur - prev)
        .withColumn(f"{prefix}_pct_change", F.when(prev > 0, ratio(cur - prev, prev)))
        .withColumn(f"{prefix}_is_drop", F.coalesce((prev > 0) & (cur < prev), F.lit(False)))
        .withColumn(f"{prefix}_is_increase", F.coalesce(cur > prev, F.lit(False)))
    )


def transition_class(prev: str = "pix_prev", cur: str = "pixel_count") -> Column:
    p, c = F.col(prev), F.col(cur)
    return (
        F.when(p.isNull(), "first_day")
        .when((p == 0) & (c == 0), "zero_to_zero")
        .when((p == 0) & (c > 0), "start_from_zero")
        .when((p > 0) & (c == 0), "drop_to_zero")
        .when((p > 0) & (c < p), "partial_drop")
        .when((p > 0) & (c > p), "increase_positive")
        .otherwise("stable_positive")
    )


def drop_events(panel: DataFrame, value: str, prefix: str, label: str) -> DataFrame:
    """Drop days with size of the drop and what follows in the next 1, 3 and 7 days."""
    ahead = {k: F.max(value).over(_by_day().rowsBetween(1, k)) for k in (1, 3, 7)}
    to, start = F.col("drop_to"), F.col("drop_from")
    out = panel.withColumns({f"_next{k}": c.cast("double") for k, c in ahead.items()}).filter(F.col(f"{prefix}_is_drop"))
    out = (
        out.withColumn("metric", F.lit(label))
        .withColumn("drop_from", F.col(f"{prefix}_prev").cast("double"))
        .withColumn("drop_to", F.col(value).cast("double"))
        .withColumn("drop_amount", start - to)
        .withColumn("drop_pct", ratio(start - to, start))
        .withColumn("drop_to_zero", to == 0)
    )
    for cut in (25, 50, 75):
        out = out.withColumn(f"steep_drop_{cut}", F.col("drop_pct") >= cut / 100)
    rebounds = {"rebound_next_day": F.coalesce(F.col("_next1") > to, F.lit(False))}
    for k in (3, 7):
        best = F.col(f"_next{k}")
        rebounds[f"rebound_within_{k}d"] = F.coalesce(best > to, F.lit(False))
        rebounds[f"recover_pre_drop_within_{k}d"] = F.coalesce(best >= start, F.lit(False))
        rebounds[f"best_rebound_amount_{k}d"] = F.coalesce(best - to, F.lit(0.0))
    out = out.withColumns(rebounds)
    keep = [
        "metric", "incident_id", *META, "day", "day_of_fire", "rel_progress", "rel_bin20", "drop_from", "drop_to",
        "drop_amount", "drop_pct", "drop_to_zero", "steep_drop_25", "steep_drop_50", "steep_drop_75", *rebounds,
    ]
    return out.select(*keep)


def drop_streaks(panel: DataFrame, value: str, prefix: str, label: str) -> DataFrame:
    """Maximal runs of consecutive drop days: from the value before the run to its last value."""
    drops = panel.filter(F.col(f"{prefix}_is_drop"))
    island = F.col("day_of_fire") - F.row_number().over(_by_day())
    runs = drops.withColumn("_run", island).groupBy("incident_id", "size_bucket", "_run").agg(
        F.min("day").alias("streak_start_day"),
        F.max("day").alias("streak_end_day"),
        F.min("day_of_fire").alias("streak_start_day_of_fire"),
        F.max("day_of_fire").alias("streak_end_day_of_fire"),
        F.min("rel_progress").alias("streak_start_rel_progress"),
        F.max("rel_progress").alias("streak_end_rel_progress"),
        F.count("*").alias("streak_len_days"),
        F.min_by(f"{prefix}_prev", "day").cast("double").alias("drop_from"),
        F.max_by(value, "day").cast("double").alias("drop_to"),
    )
    amount = F.col("drop_from") - F.col("drop_to")
    return (
        runs.drop("_run")
        .withColumn("metric", F.lit(label))
        .withColumn("streak_drop_amount", amount)
        .withColumn("streak_drop_pct", ratio(amount, F.col("drop_from")))
        .withColumn("streak_ends_at_zero", F.col("drop_to") == 0)
    )


def _pct(flag: str) -> Column:
    return (F.avg(F.col(flag).cast("int")) * 100.0).alias(f"{flag}_pct")


GROUPS = ["metric", "size_bucket"]


def summarize_drops(events: DataFrame) -> DataFrame:
    out = events.groupBy(*GROUPS).agg(
        F.count("*").alias("drop_events"),
        *[_pct(c) for c in ("drop_to_zero", "steep_drop_25", "steep_drop_50", "steep_drop_75")],
        F.avg("drop_amount").alias("drop_amount_mean"),
        (F.avg("drop_pct") * 100.0).alias("drop_pct_mean"),
    )
    scaled = events.withColumn("_pct", F.col("drop_pct") * 100.0)
    return with_quantiles(
        out, scaled, GROUPS,
        {
            "drop_amount_median": ("drop_amount", 0.5), "drop_amount_p90": ("drop_amount", 0.9),
            "drop_pct_median": ("_pct", 0.5), "drop_pct_p90": ("_pct", 0.9),
        },
    )


def summarize_rebounds(events: DataFrame) -> DataFrame:
    flags = (
        "rebound_next_day", "rebound_within_3d", "rebound_within_7d", "recover_pre_drop_within_3d",
        "recover_pre_drop_within_7d",
    )
    return events.groupBy(*GROUPS).agg(
        F.count("*").alias("drop_events"),
        *[_pct(c) for c in flags],
        *[F.avg(f"best_rebound_amount_{k}d").alias(f"best_rebound_amount_{k}d_mean") for k in (3, 7)],
    )


def summarize_streaks(streaks: DataFrame) -> DataFrame:
    out = streaks.groupBy(*GROUPS).agg(
        F.count("*").alias("streaks"),
        F.avg("streak_len_days").alias("streak_len_mean"),
        _pct("streak_ends_at_zero"),
        F.avg("streak_drop_amount").alias("streak_drop_amount_mean"),
        (F.avg("streak_drop_pct") * 100.0).alias("streak_drop_pct_mean"),
    )
    scaled = streaks.withColumn("_pct", F.col("streak_drop_pct") * 100.0)
    wanted = {}
    for name, column in (("streak_len", "streak_len_days"), ("streak_drop_amount", "streak_drop_amount"), ("streak_drop_pct", "_pct")):
        wanted[f"{name}_median"], wanted[f"{name}_p90"] = (column, 0.5), (column, 0.9)
    return with_quantiles(out, scaled, GROUPS, wanted)


def transition_mix(panel: DataFrame) -> DataFrame:
    """Days per transition class and their share of the size bucket, first days left out."""
    counts = (
        panel.filter(F.col("pix_prev").isNotNull())
        .groupBy("size_bucket", transition_class().alias("transition"))
        .agg(F.count("*").alias("days"))
    )
    total = F.sum("days").over(Window.partitionBy("size_bucket"))
    return counts.withColumn("total_days", total).withColumn("pct_days", F.col("days") / F.col("total_days") * 100.0)


def _curve_aggs() -> list[Column]:
    found = F.col("pixel_count") > 0
    return [
        F.count("*").alias("fire_days"),
        F.count_if(found).alias("days_with_detections"),
        F.avg("pixel_count").alias("mean_pixels"),
        F.avg("frp_total").alias("mean_frp_total"),
        F.avg(F.col("pix_is_drop").cast("int")).alias("drop_rate_pixels"),
        F.avg(F.col("frp_is_drop").cast("int")).alias("drop_rate_frp_total"),
    ]


def day_of_fire_curve(panel: DataFrame) -> DataFrame:
    groups = ["size_bucket", "day_of_fire"]
    on_hits = F.coalesce(F.avg(F.when(F.col("pixel_count") > 0, F.col("frp_mean_pixel"))), F.lit(0.0))
    out = panel.groupBy(*groups).agg(*_curve_aggs(), on_hits.alias("mean_frp_pixel_on_detect_days"))
    out = with_quantiles(
        out, panel, groups,
        {
            "median_pixels": ("pixel_count", 0.5), "p90_pixels": ("pixel_count", 0.9),
            "median_frp_total": ("frp_total", 0.5),
        },
    )
    return out.withColumn("pct_days_with_detections", F.col("days_with_detections") / F.col("fire_days") * 100.0)


def relative_curve(panel: DataFrame) -> DataFrame:
    groups = ["size_bucket", "rel_bin20"]
    positive = F.coalesce(F.avg(F.when(F.col("frp_mean_pixel") > 0, F.col("frp_mean_pixel"))), F.lit(0.0))
    out = panel.groupBy(*groups).agg(*_curve_aggs(), positive.alias("mean_frp_pixel"))
    out = with_quantiles(out, panel, groups, {"median_pixels": ("pixel_count", 0.5)})
    return (
        out.withColumn("pct_days_with_detections", F.col("days_with_detections") / F.col("fire_days") * 100.0)
        .withColumn("bin_start_rel", F.col("rel_bin20") / 20)
        .withColumn("bin_end_rel", (F.col("rel_bin20") + 1) / 20)
    )


def progress_profile(panel: DataFrame) -> DataFrame:
    """The same over hundredths of the window, all incidents together."""
    binned = panel.withColumn("prog_bin", progress_bin(F.col("rel_progress"), 100))
    out = binned.groupBy("prog_bin").agg(*_curve_aggs())
    out = out.withColumnsRenamed({"drop_rate_pixels": "pixel_drop_rate", "drop_rate_frp_total": "frp_drop_rate"})
    out = with_quantiles(out, binned, ["prog_bin"], {"p90_pixels": ("pixel_count", 0.9), "p90_frp_total": ("frp_total", 0.9)})
    return out.withColumn("pct_with_detections", F.col("days_with_detections") / F.col("fire_days") * 100.0).withColumn(
        "progress_mid", (F.col("prog_bin") + 0.5) / 100.0
    )


RATES = {"rebound7_rate": "rebound_within_7d", "recover7_rate": "recover_pre_drop_within_7d", "drop_to_zero_rate": "drop_to_zero"}


def _event_rates(events: DataFrame, prefix: str) -> DataFrame:
    # Groups are the drop days of one incident, so the exact median is bounded by its window.
    return events.groupBy("incident_id").agg(
        F.count("*").alias(f"{prefix}_drop_events"),
        *[F.avg(F.col(c).cast("int")).alias(f"{prefix}_{n}") for n, c in RATES.items()],
        F.percentile("drop_pct", F.lit(0.5)).alias(f"{prefix}_drop_pct_median"),
    )


def incident_behaviour(panel: DataFrame, pixel_drops: DataFrame, frp_drops: DataFrame) -> DataFrame:
    """One row per incident: level, drop and increase rates on comparable days, rebound rates, log size."""

    def on_hits(c: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))

    def comparable(c: str) -> Column:
        return F.coalesce(F.avg(F.when(F.col("pix_prev").isNotNull(), F.col(c).cast("int"))), F.lit(0.0))

    base = panel.groupBy("incident_id", "size_acres", "active_window_days").agg(
        F.avg("pixel_count").alias("mean_pixels_per_day"),
        on_hits("pixel_count").alias("mean_pixels_on_detect_days"),
        F.avg("frp_total").alias("mean_frp_total_per_day"),
        on_hits("frp_total").alias("mean_frp_total_on_detect_days"),
        comparable("pix_is_drop").alias("pixel_drop_rate"),
        comparable("frp_is_drop").alias("frp_drop_rate"),
        comparable("pix_is_increase").alias("pixel_increase_rate"),
        comparable("frp_is_increase").alias("frp_increase_rate"),
    )
    return assemble_metrics(base, [_event_rates(pixel_drops, "pixel"), _event_rates(frp_drops, "frp")])


def assemble_metrics(base: DataFrame, parts: Sequence[DataFrame]) -> DataFrame:
    """Left-join metric tables by incident; what a table does not have is zero."""
    out = base
    for part in parts:
        names = [c for c in part.columns if c != "incident_id"]
        out = out.join(part, "incident_id", "left").fillna(0, names)
    return out.filter(F.col("size_acres") > 0).withColumn("log10_size", F.log10("size_acres"))


def rolling_smooth(
    rows: DataFrame, x: str, y: str, identity: str = "incident_id", frac: float = 0.08, min_window: int = 75
) -> DataFrame:
    """Centred rolling means of x and y along sorted x, window a share of the rows (odd, at least 75).

    A window mean is a difference of two running totals, found by position, so the sorted table is
    never in one task.
    """
    kept = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        identity, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    )
    placed = positions(kept, [], "x", identity)
    n = F.col("n")
    window = F.greatest(F.lit(min_window), F.floor(n * frac).cast("int"))
    window = window + F.when(window % 2 == 0, 1).otherwise(0)
    window = F.when(window > n, F.when(n % 2 == 1, n).otherwise(F.greatest(n - 1, F.lit(1)))).otherwise(window)
    placed = placed.withColumn("_win", window.cast("bigint")).withColumn("_half", F.floor((F.col("_win") - 1) / 2))
    totals = prefix_sums(placed, "pos", ["x", "y"])

    def at(name: str) -> DataFrame:
        return totals.select(F.col("pos").alias(f"_{name}"), *[F.col(f"_sum_{c}").alias(f"_{name}_{c}") for c in "xy"])

    out = (
        placed.withColumn("_hi", F.least(F.col("pos") + F.col("_half"), n - 1))
        .withColumn("_lo", F.greatest(F.col("pos") - F.col("_half"), F.lit(0)) - 1)
        .join(at("hi"), "_hi")
        .join(at("lo"), "_lo", "left")
        .fillna(0.0, ["_lo_x", "_lo_y"])
        .withColumn("_cnt", F.col("_hi") - F.col("_lo"))
    )
    raw = F.col("_win") <= 3
    enough = F.col("_cnt") >= F.greatest(F.lit(5), F.floor(F.col("_win") / 5))
    means = {c: F.when(raw, F.col(c)).otherwise((F.col(f"_hi_{c}") - F.col(f"_lo_{c}")) / F.col("_cnt")) for c in "xy"}
    return out.filter(raw | enough).select(identity, "pos", means["x"].alias("x_smooth"), means["y"].alias("y_smooth"))


def binned_mean(rows: DataFrame, x: str, y: str, value: Column, width_x: float, width_y: float, min_count: int) -> DataFrame:
    """Mean of a value per rectangular bin of two columns; bins with few rows go."""
    return (
        rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.floor(F.col(x) / width_x).cast("int").alias("bin_x"), F.floor(F.col(y) / width_y).cast("int").alias("bin_y"))
        .agg(F.count("*").alias("rows"), F.avg(value.cast("double")).alias("mean_value"))
        .filter(F.col("rows") >= min_count)
    )
