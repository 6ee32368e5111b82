"""Time: axes, panels, nearest and covering granules, slots."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeframe.functions.scalars import hour_floor, progress_bin, relative_progress, size_bucket
from plumeframe.scale import skew_join, top_rows, value_steps

#: Distinct times of one hour that meet its granules in one task.
TIMES_PER_TASK = 100_000


def hour_axis(spark, start: dt.date, end: dt.date) -> DataFrame:
    """UTC hours of a run: from 00:00 the day before its start to 23:00 the day after its end."""
    row = spark.range(1).select(F.lit(start).alias("s"), F.lit(end).alias("e"))
    return row.select(_hours(F.col("s"), F.col("e")).alias("hour_utc"))


def hour_axis_of(df: DataFrame, ts: str) -> DataFrame:
    """The same axis around the days a table covers."""
    return df.agg(F.to_date(F.min(ts)).alias("s"), F.to_date(F.max(ts)).alias("e")).select(
        _hours(F.col("s"), F.col("e")).alias("hour_utc")
    )


def _hours(start: Column, end: Column) -> Column:
    first = F.date_sub(start, 1).cast("timestamp")
    last = F.date_add(end, 1).cast("timestamp") + F.expr("INTERVAL 23 HOURS")
    return F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR")))


def hour_steps(
    cadence_after_72h: int = 1, cap: int | None = None, sample_hours: Sequence[int] | None = None, max_scanned: int | None = None
) -> Column:
    """Kept hour offsets of an incident window (``start_ts``, ``end_ts``) as an array."""
    start, end = hour_floor("start_ts"), hour_floor("end_ts")
    count = F.greatest(F.floor((F.unix_seconds(end) - F.unix_seconds(start)) / 3600) + 1, F.lit(0))
    if max_scanned is not None:
        count = F.least(count, F.lit(max_scanned))
    count = count.cast("bigint")
    steps = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1)).otherwise(F.array().cast("array<bigint>"))
    if cadence_after_72h == 2:
        steps = F.filter(steps, lambda i: (i <= 72) | (i % 2 == 0))
    if sample_hours is not None:
        allowed = [int(h) for h in sample_hours]
        steps = F.filter(steps, lambda i: ((F.hour(start) + i) % 24).isin(allowed))
    return F.slice(steps, 1, cap) if cap is not None else steps


def incident_hours(
    incidents: DataFrame,
    cadence_after_72h: int = 1,
    cap: int | None = None,
    sample_hours: Sequence[int] | None = None,
    max_scanned: int | None = None,
) -> DataFrame:
    """Hours of every incident window, thinned and capped.

    After hour 72 of a window a cadence of 2 keeps even hours only; ``sample_hours`` keeps these
    hours of day; ``max_scanned`` looks at the first hours only; ``cap`` keeps the first kept ones.
    The axis is a row-local array, so a long window costs one row's sequence, not a shuffle.
    """
    steps = hour_steps(cadence_after_72h, cap, sample_hours, max_scanned)
    return incidents.withColumn("hour_index", F.explode(steps)).withColumn(
        "run_time", F.timestamp_seconds(F.unix_seconds(hour_floor("start_ts")) + F.col("hour_index") * 3600)
    )


def day_steps(
    run_start: dt.date, run_end: dt.date, require_next_day: bool, cap: int | None = None, max_days: int | None = None
) -> Column:
    """Kept days of an incident (``start_date``, ``end_date``) inside the run as an array."""
    last = F.least(F.col("end_date"), F.lit(run_end))
    if require_next_day:
        last = F.least(last, F.date_sub(F.lit(run_end), 1))
    first = F.greatest(F.col("start_date"), F.lit(run_start))
    days = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))
    limits = [x for x in (cap, max_days) if x is not None]
    return F.slice(days, 1, min(limits)) if limits else days


def incident_days(
    incidents: DataFrame,
    run_start: dt.date,
    run_end: dt.date,
    require_next_day: bool,
    cap: int | None = None,
    max_days: int | None = None,
) -> DataFrame:
    """Days of every incident inside the run; without the run's last day when a next-day label is needed."""
    return incidents.withColumn("day", F.explode(day_steps(run_start, run_end, require_next_day, cap, max_days)))


def daily_panel(incidents: DataFrame, daily: DataFrame, max_days: int | None = None) -> DataFrame:
    """Every day of every incident with its detections, zero where none, and its position in the window.

    The position is arithmetic on the dates, so no window over the incident is needed.
    """
    last = F.col("end_date")
    if max_days is not None:
        last = F.least(last, F.date_add("start_date", max_days - 1))
    full = (
        incidents.drop("rings")
        .filter(F.col("end_date") >= F.col("start_date"))
        .withColumn("day", F.explode(F.sequence(F.col("start_date"), last)))
    )
    progress = F.least(F.greatest(relative_progress(F.col("day_of_fire"), F.col("active_window_days")), F.lit(0.0)), F.lit(1.0))
    return (
        full.join(daily, ["incident_id", "day"], "left")
        .fillna(0, ["pixel_count"])
        .fillna(0.0, ["frp_total", "frp_mean_pixel"])
        .withColumn("size_bucket", size_bucket("size_acres"))
        .withColumn("active_window_days", F.datediff("end_date", "start_date") + 1)
        .withColumn("day_of_fire", F.datediff("day", "start_date"))
        .withColumn("rel_progress", progress)
        .withColumn("rel_bin20", progress_bin(F.col("rel_progress"), 20))
        .withColumn("day_pos", F.col("day_of_fire"))
    )


# ---- granules --------------------------------------------------------------------------------


def granules_between(granules: DataFrame, start, end) -> DataFrame:
    """One row per key with its start in [start, end]."""
    kept = granules.filter(F.col("start_ts").between(F.lit(start), F.lit(end)))
    return kept.groupBy("granule_key").agg(F.min("start_ts").alias("start_ts"))


def nearest_granule(
    targets: DataFrame,
    granules: DataFrame,
    target_ts: str,
    max_minutes: float,
    later_wins: bool = False,
    not_before=None,
    prefix: str = "",
) -> DataFrame:
    """Adds the granule nearest in time within a tolerance; targets without one stay, with NULLs.

    Distinct target times and granule starts are laid into time buckets as wide as the tolerance.
    The neighbours of a time are the last granule before and the first after it in its own bucket,
    else the end of the bucket next to it, so no pairs are formed at all.
    """
    width = max(int(max_minutes * 60), 1)
    times = targets.select(F.col(target_ts).alias("_t")).filter(F.col("_t").isNotNull()).distinct()
    if not_before is not None:
        times = times.filter(F.col("_t") >= F.lit(not_before))
    bucket = F.floor(F.unix_micros("_t") / 1_000_000 / width).cast("bigint")
    # Granules of equal start: the smallest key stands for all of them.
    starts = (
        granules.groupBy(F.col("start_ts").alias("_t"))
        .agg(F.min("granule_key").alias("_key"))
        .withColumn("_b", bucket)
        .withColumn("_g", F.struct(F.col("_t").alias("ts"), F.col("_key").alias("key")))
        .select("_b", "_t", "_g")
    )
    both = times.withColumn("_b", bucket).withColumn("_g", F.lit(None).cast(starts.schema["_g"].dataType)).select("_b", "_t", "_g").unionByName(starts)
    granule_first = F.col("_g").isNull()
    up = Window.partitionBy("_b").orderBy(F.col("_t"), granule_first).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_b").orderBy(F.col("_t").desc(), granule_first).rowsBetween(Window.unboundedPreceding, 0)
    inside = (
        both.withColumn("_before", F.last("_g", ignorenulls=True).over(up))
        .withColumn("_after", F.last("_g", ignorenulls=True).over(down))
        .filter(F.col("_g").isNull())
        .drop("_g")
    )
    ends = starts.groupBy("_b").agg(F.min("_g").alias("_first"), F.max("_g").alias("_last"))
    placed = (
        inside.join(ends.select((F.col("_b") + 1).alias("_b"), "_last"), "_b", "left")
        .join(ends.select((F.col("_b") - 1).alias("_b"), "_first"), "_b", "left")
        .withColumn("_before", F.coalesce("_before", "_last"))
        .withColumn("_after", F.coalesce("_after", "_first"))
    )
    away = lambda g: F.abs(F.unix_micros(g["ts"]) - F.unix_micros("_t")) / 60_000_000
    before, after = F.col("_before"), F.col("_after")
    closer = (away(after) <= away(before)) if later_wins else (away(after) < away(before))
    choice = F.when(before.isNull() | closer, after).otherwise(before)
    best = placed.withColumn("_c", choice).withColumn("_d", away(F.col("_c"))).filter(F.col("_d") <= max_minutes)
    best = best.select(
        F.col("_t").alias(target_ts),
        F.col("_c")["key"].alias(f"{prefix}granule_key"),
        F.col("_d").alias(f"{prefix}time_diff_min"),
    )
    return targets.join(best, target_ts, "left")


def covering_granule(
    targets: DataFrame, granules: DataFrame, target_ts: str, max_minutes: float, prefix: str = ""
) -> DataFrame:
    """Granule covering the time (nearest middle first), else nearest middle among all; the tolerance
    on the distance to the middle holds for both. Candidates start a day before to a day after."""
    middle = (F.unix_micros("start_ts") + F.unix_micros("end_ts")) / 2
    times = targets.select(F.col(target_ts).alias("_t")).filter(F.col("_t").isNotNull()).distinct()
    hours = lambda c: F.floor(c / 3_600_000_000).cast("bigint")
    near = int(max_minutes // 60) + 1
    # A covering granule out of tolerance must hide a nearer one that does not cover, so granules
    # are spread over every hour they cover as well as the hours around their middle.
    spread = granules.withColumn("_mid", middle).withColumn(
        "_h",
        F.explode(
            F.array_distinct(
                F.concat(
                    F.sequence(hours(F.col("_mid")) - near, hours(F.col("_mid")) + near),
                    F.sequence(hours(F.unix_micros("start_ts")), hours(F.unix_micros("end_ts"))),
                )
            )
        ),
    )
    pairs = skew_join(times.withColumn("_h", hours(F.unix_micros("_t"))), spread, ["_h"], ["_t"], rows_per_task=TIMES_PER_TASK)
    pairs = pairs.withColumn("_covers", F.col("_t").between(F.col("start_ts"), F.col("end_ts"))).withColumn(
        "_d", F.abs(F.col("_mid") - F.unix_micros("_t")) / 60_000_000
    )
    day = lambda c: F.unix_date(F.to_date(c))
    pairs = pairs.filter(F.abs(day(F.col("start_ts")) - day(F.col("_t"))) <= 1)
    best = top_rows(pairs, ["_t"], [F.col("_covers").desc(), F.col("_d"), F.col("granule_key")]).filter(F.col("_d") <= max_minutes)
    best = best.select(
        F.col("_t").alias(target_ts),
        F.col("granule_key").alias(f"{prefix}granule_key"),
        F.col("_d").alias(f"{prefix}time_diff_min"),
    )
    return targets.join(best, target_ts, "left")


def channel_sets(granules: DataFrame, channels: Sequence[str], time: str = "start_ts") -> DataFrame:
    """Times at which every channel is present, one key column per channel."""
    keys = [F.max(F.when(F.col("channel") == c, F.col("granule_key"))).alias(f"key_{c}") for c in channels]
    out = granules.filter(F.col("channel").isin(*channels)).groupBy(time).agg(*keys)
    for c in channels:
        out = out.filter(F.col(f"key_{c}").isNotNull())
    return out


def granule_families(
    granules: DataFrame, products: Sequence[str], target, max_hours: float, min_bytes: int, anchor: str | None = None
) -> DataFrame:
    """Stems for which every product exists and is large enough, within hours of a time, nearest first."""
    anchor = anchor or products[0]
    kept = granules.filter(F.col("size_bytes") >= min_bytes)
    families = kept.groupBy("stem", F.to_date("start_ts").alias("_day")).agg(
        *[F.max(F.when(F.col("product") == p, F.col("granule_key"))).alias(f"key_{p}") for p in products],
        F.max(F.when(F.col("product") == anchor, F.col("start_ts"))).alias("start_ts"),
    )
    for p in products:
        families = families.filter(F.col(f"key_{p}").isNotNull())
    diff = F.abs(F.unix_seconds("start_ts") - F.unix_seconds(F.lit(target)))
    return (
        families.withColumn("diff_sec", diff).filter(F.col("diff_sec") <= max_hours * 3600).drop("_day").orderBy("diff_sec", "stem")
    )


# ---- slots -----------------------------------------------------------------------------------


def schedule(spark, start: dt.datetime, end: dt.datetime, step_minutes: int, max_frames: int = 0) -> DataFrame:
    """Regular times from start to end, thinned evenly to at most ``max_frames``."""
    if step_minutes <= 0:
        raise ValueError("step must be > 0")
    count = int((end - start).total_seconds() // (step_minutes * 60)) + 1
    frames = count if not 0 < max_frames < count else max_frames
    position = F.col("id")
    if frames != count:
        step = (count - 1) / max(frames - 1, 1)
        position = F.when(F.col("id") == frames - 1, count - 1).otherwise(F.floor(F.col("id") * step)).cast("bigint")
    first = F.unix_seconds(F.lit(start).cast("timestamp"))
    return spark.range(frames).select(
        F.col("id").cast("int").alias("frame"),
        F.timestamp_seconds(first + position * step_minutes * 60).alias("frame_ts"),
    )


def slot_of(ts: Column | str, start, hold_hours: int, slots: int) -> Column:
    """Slot of a time: hold-wide bins from the start, ends clipped."""
    seconds = F.unix_micros(ts) / 1_000_000 - F.unix_micros(F.lit(start).cast("timestamp")) / 1_000_000
    return F.least(F.greatest(F.floor(seconds / (hold_hours * 3600)), F.lit(0)), F.lit(slots - 1)).cast("int")


def slot_growth(cells: DataFrame, slots: int, by: Sequence[str] = ()) -> DataFrame:
    """Cells hit per slot and cells hit so far, for slots 0..slots-1.

    ``cells`` has ``slot`` and the cell columns. A cell counts as new in its first slot, so the
    running union is a running sum over slots.
    """
    by = list(by)
    cell_columns = [c for c in cells.columns if c not in ("slot", *by)]
    current = cells.distinct().groupBy(*by, "slot").agg(F.count("*").alias("cells"))
    new = (
        cells.groupBy(*by, *cell_columns).agg(F.min("slot").alias("slot")).groupBy(*by, "slot").agg(F.count("*").alias("_new"))
    )
    base = cells.select(*by).distinct() if by else cells.sparkSession.range(1).select(F.lit(1).alias("_one"))
    axis = base.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    out = axis.join(current, [*by, "slot"], "left").join(new, [*by, "slot"], "left").fillna(0, ["cells", "_new"])
    window = Window.partitionBy(*(by or [F.lit(0)])).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cells_so_far", F.sum("_new").over(window)).select(*by, "slot", "cells", "cells_so_far")


def carry_forward(slots: DataFrame, value: str, by: Sequence[str] = (), order: str = "slot") -> DataFrame:
    """Fill a missing slot value with the last known one; one row per slot, so the window is short."""
    window = Window.partitionBy(*(list(by) or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return slots.withColumn(value, F.last(value, ignorenulls=True).over(window))


def slot_targets(detections: DataFrame, start: dt.datetime, end: dt.datetime, hold_hours: int, slots: int) -> DataFrame:
    """Target time of every slot: its middle daytime detection, else its middle.

    The middle one is found by running counts over distinct times, spread over tasks within a slot.
    """
    begin_us = F.unix_micros(F.lit(start).cast("timestamp")) + F.col("slot") * hold_hours * 3_600_000_000
    day = (
        detections.filter(F.col("daynight") == "D")
        .withColumn("slot", slot_of(F.col("acq_ts"), start, hold_hours, slots))
        .withColumn("_off", F.unix_micros("acq_ts") - begin_us)
    )
    steps = value_steps(day, ["slot"], "_off")
    place = F.floor(F.col("n") / 2)
    middle = steps.filter((F.col("before") <= place) & (place < F.col("before") + F.col("cnt"))).select(
        "slot", F.timestamp_micros(begin_us + F.col("_off")).alias("_mid")
    )
    hold = hold_hours * 3600
    first = F.unix_seconds(F.lit(start).cast("timestamp"))
    last = F.unix_seconds(F.lit(end).cast("timestamp"))
    begin = first + F.col("slot") * hold
    axis = detections.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    midpoint = F.timestamp_micros(((begin + F.least(last, begin + hold)) * 500_000).cast("bigint"))
    return axis.join(middle, "slot", "left").select("slot", F.coalesce("_mid", midpoint).alias("target_ts"))
