"""Raster sample sets of incidents: tasks, patches, labels, baselines, index."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeframe.config import Channel, ReductionRules, SampleSettings
from plumeframe.functions import geo
from plumeframe.functions import scalars as s
from plumeframe.operators import grids, incidents, temporal
from plumeframe.scale import skew_join, stage

BYTES_PER_VALUE = 2  # Fixed value: half-precision storage of the budget rule.
SPACING_M = 3000.0
#: Least width of the cells on which hotspots meet the boxes of samples.
HOTSPOT_CELL_M = 100_000.0


# ---- budget ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class ReductionPlan:
    include_upper_air: bool
    cadence_after_72h: int
    cap_samples: int | None
    actions: tuple[str, ...]
    samples: int
    bytes: int


def sample_bytes(samples: Column | int, channels: int, labels: int, patch: tuple[int, int]):
    return samples * ((channels + labels) * patch[0] * patch[1] * BYTES_PER_VALUE)


def is_upper_air(channel: Channel) -> bool:
    return channel.level.lower().endswith("mb") or channel.variable.upper() == "DZDT"


def count_samples(fires: DataFrame, states: Sequence[tuple[int, int | None]], hours: Sequence[int] | None, daily: tuple | None) -> list[int]:
    """Number of samples under each (cadence, cap) in one pass over the incidents."""
    if daily is not None:
        sizes = [F.size(temporal.day_steps(daily[0], daily[1], daily[2], cap)) for _, cap in states]
    else:
        sizes = [F.size(temporal.hour_steps(cadence, cap, hours)) for cadence, cap in states]
    row = fires.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(f"s{i}") for i, n in enumerate(sizes)]).first()
    return [int(row[f"s{i}"]) for i in range(len(states))]


def plan_reduction(
    fires: DataFrame, channels: Sequence[Channel], labels: int, patch: tuple[int, int], rules: ReductionRules,
    sample_hours: Sequence[int] | None = None, daily: tuple[dt.date, dt.date, bool] | None = None,
) -> ReductionPlan:
    """Steps that would bring a sample set under its byte budget, in a fixed order: a report. ``build_samples`` takes them only when asked to.

    Drop upper-air channels; keep every second hour after 72 h (hourly sets only); cap the samples
    per incident. ``daily`` is (run start, run end, next-day label needed). All states are counted in
    one aggregate, the choice among them is made on those few numbers.
    """
    budget = int(rules.budget_gb * 1024**3)
    steps: list[tuple[bool, int, int | None, str | None]] = [(True, 1, None, None)]
    if rules.drop_upper_air:
        steps.append((False, 1, None, "drop_upper_air_and_dzdt"))
    upper, cadence = steps[-1][0], 1
    if daily is None and rules.two_hour_cadence_after_72h:
        cadence = 2
        steps.append((upper, cadence, None, "two_hour_cadence_after_72h"))
    cap = rules.cap_samples_per_incident
    steps.append((upper, cadence, cap, f"cap_samples_per_fire={cap}"))
    counts = count_samples(fires, [(c, k) for _, c, k, _ in steps], sample_hours, daily)
    actions: list[str] = []
    for (include, cadence, limit, action), samples in zip(steps, counts):
        if action:
            actions.append(action)
        # One more channel: the hotspot raster.
        kept = len([c for c in channels if include or not is_upper_air(c)]) + 1
        size = sample_bytes(samples, kept, labels, patch)
        if size <= budget:
            break
    return ReductionPlan(include, cadence, limit, tuple(actions), samples, size)


# ---- tasks -----------------------------------------------------------------------------------


def skip_done(tasks: DataFrame, done: DataFrame | None, key: str = "sample_key") -> DataFrame:
    return tasks if done is None else tasks.join(done.select(key).distinct(), key, "left_anti")


def complete_tasks(tasks: DataFrame, required: DataFrame, available: DataFrame, key: str = "sample_key") -> DataFrame:
    """Tasks for which every required (run_time, variable, level) exists."""
    at = ["run_time", "variable", "level"]
    have = available.select(*at).distinct().withColumn("_have", F.lit(1))
    missing = (
        required.select(key, *at).join(have, at, "left").groupBy(key).agg(F.count_if(F.col("_have").isNull()).alias("_missing"))
    )
    return tasks.join(missing.filter("_missing = 0").select(key), key, "left_semi")


def label_time(run_time: Column | str, lead_hours: Column | int) -> Column:
    run_time = F.col(run_time) if isinstance(run_time, str) else run_time
    lead = F.lit(lead_hours) if isinstance(lead_hours, int) else lead_hours
    return F.timestamp_seconds(F.unix_seconds(run_time) + lead * 3600)


def label_alignment(fields: DataFrame, leads: Sequence[int]) -> DataFrame:
    """Field cells at run time next to the same cells at run time + lead."""
    later = fields.select("variable", "level", "iy", "ix", F.col("run_time").alias("label_time"), F.col("value").alias("label"))
    spread = fields.withColumn("lead_hours", F.explode(F.array(*[F.lit(n) for n in leads])))
    return spread.withColumn("label_time", label_time("run_time", F.col("lead_hours"))).join(
        later, ["variable", "level", "iy", "ix", "label_time"]
    )


def hourly_tasks(fires: DataFrame, settings: SampleSettings, plan: ReductionPlan) -> DataFrame:
    tasks = temporal.incident_hours(fires, plan.cadence_after_72h, plan.cap_samples, settings.sample_hours)
    return tasks.withColumn("run_date", F.to_date("run_time")).withColumn(
        "sample_key", s.sample_key_hourly("incident_id", "run_time")
    )


def daily_tasks(fires: DataFrame, settings: SampleSettings, plan: ReductionPlan) -> DataFrame:
    hours = settings.sample_hours or (0, 6, 12, 18)
    days = temporal.incident_days(fires, settings.run_start, settings.run_end, True, plan.cap_samples)
    return days.withColumnRenamed("day", "run_date").withColumn(
        "run_time", F.timestamp_seconds(F.unix_date("run_date").cast("bigint") * 86400 + min(hours) * 3600)
    ).withColumn("sample_key", s.sample_key_daily("incident_id", "run_date", hours))


def source_times(tasks: DataFrame, settings: SampleSettings, channels: Sequence[Channel], leads: Sequence[int], hours: Sequence[int] | None) -> DataFrame:
    """Every field a task needs: (sample_key, kind, channel, lead_hours) x source time."""
    entries = [
        F.struct(
            F.lit("input").alias("kind"), F.lit(c.name).alias("channel"), F.lit(0).alias("lead_hours"),
            F.lit(c.variable).alias("variable"), F.lit(c.level).alias("level"),
        )
        for c in channels
    ]
    entries += [
        F.struct(
            F.lit("label").alias("kind"), F.lit(settings.label.name).alias("channel"), F.lit(lead).alias("lead_hours"),
            F.lit(settings.label.variable).alias("variable"), F.lit(settings.label.level).alias("level"),
        )
        for lead in leads
    ]
    base = tasks.select("sample_key", "incident_id", "run_time", "run_date", F.inline(F.array(*entries)))
    if hours is None:
        at = label_time("run_time", F.col("lead_hours"))
        return base.withColumn("run_time", at)
    midnight = F.unix_date("run_date").cast("bigint") * 86400
    offset = F.explode(F.array(*[F.lit(h) for h in sorted(hours)]))
    return base.withColumn("_h", offset).withColumn(
        "run_time", F.timestamp_seconds(midnight + (F.col("_h") + F.col("lead_hours")) * 3600)
    ).drop("_h")


# ---- patches ---------------------------------------------------------------------------------


def with_boxes(fires: DataFrame, buffer_km: float) -> DataFrame:
    xmin, ymin, xmax, ymax = geo.projected_box("min_lon", "min_lat", "max_lon", "max_lat", buffer_km)
    return fires.withColumn("xmin", xmin).withColumn("ymin", ymin).withColumn("xmax", xmax).withColumn("ymax", ymax)


def with_patches(needed: DataFrame, boxes: DataFrame, fields: DataFrame, settings: SampleSettings) -> DataFrame:
    """Rows of ``needed`` with the resampled ``patch`` of their field in the box of their incident; without a whole one they are left out.

    Incidents whose boxes touch the same cells of the grid share their patches, so these are cut once per window of
    cells and field, however many incidents lie there.
    """
    window, at = ["ix0", "ix1", "iy0", "iy1"], ["_window", "run_time", "variable", "level"]
    windows = grids.subset_window(boxes.select("incident_id", "xmin", "ymin", "xmax", "ymax"), settings.grid)
    windows = windows.select("incident_id", *window, F.struct(*window).alias("_window"))
    placed = needed.join(windows, "incident_id")
    gathered = grids.gather_windows(placed.select(*at, *window).distinct(), fields, at, ["run_time", "variable", "level"])
    patches = grids.resample_patch(gathered, settings.patch).select(*at, F.col("patch").cast("array<float>").alias("patch"))
    return placed.drop(*window).join(patches, at).drop("_window")


def field_patches(needed: DataFrame, boxes: DataFrame, fields: DataFrame, settings: SampleSettings) -> DataFrame:
    """One resampled patch per distinct (incident, run time, variable, level).

    A patch that is one day's label and the next day's input is given once.
    """
    at = ["incident_id", "run_time", "variable", "level"]
    return with_patches(needed.select(*at).distinct(), boxes, fields, settings).select(*at, "patch")


def hotspot_patches(times: DataFrame, boxes: DataFrame, detections: DataFrame, settings: SampleSettings) -> DataFrame:
    """Dense hotspot raster per (sample, source time); a sample without hotspots is all zero.

    Samples of one box and hour share their raster. Points meet the boxes on cells of half their mean width.
    """
    h, w = settings.patch
    x, y = geo.project("lon", "lat")
    points = detections.withColumn("x", x).withColumn("y", y).select("det_id", "x", "y", "frp", "hour_utc")
    sides = ["xmin", "ymin", "xmax", "ymax"]
    numbered = stage(boxes.select(*sides).distinct().withColumn("_box", F.monotonically_increasing_id()))
    mean = numbered.agg(F.avg(F.col("xmax") - F.col("xmin")).alias("w")).first()["w"]
    size = max(HOTSPOT_CELL_M, (mean or 0.0) / 2)
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size).cast("int"), F.floor(F.col(b) / size).cast("int")))
    wanted = times.select("sample_key", "incident_id", F.col("run_time").alias("hour_utc"))
    wanted = wanted.join(boxes.join(numbered, sides).select("incident_id", "_box"), "incident_id").drop("incident_id")
    spread = wanted.select("_box", "hour_utc").distinct().join(numbered.withColumn("_gx", span("xmin", "xmax")).withColumn("_gy", span("ymin", "ymax")), "_box")
    placed = points.withColumn("_gx", F.floor(F.col("x") / size).cast("int")).withColumn("_gy", F.floor(F.col("y") / size).cast("int"))
    pairs = skew_join(placed, spread, ["hour_utc", "_gx", "_gy"], ["det_id"])
    at = ["_box", "hour_utc"]
    cells = grids.rasterize_lattice(pairs, at, settings.patch)
    # A raster holds at most h * w cells, so the map per raster is bounded.
    packed = cells.groupBy(*at).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("iy") * w + F.col("ix")).alias("k"), F.col("value").alias("v")))).alias("_m")
    )
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0)).cast("float")
    )
    empty = F.array_repeat(F.lit(0.0).cast("float"), h * w)
    return wanted.join(packed.select(*at, dense.alias("patch")), at, "left").select(
        "sample_key", F.col("hour_utc").alias("run_time"), F.coalesce("patch", empty).alias("patch")
    )


def array_squares(a: Column, b: Column) -> Column:
    """Squared differences of two arrays, missing cells skipped."""
    return F.filter(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), lambda v: v.isNotNull() & ~F.isnan(v))


def mean_of(kept: Column) -> Column:
    """Mean of an array without missing cells; NULL for none."""
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda acc, v: acc + v) / F.size(kept))


def array_mean(a: Column) -> Column:
    kept = F.filter(a, lambda v: v.isNotNull() & ~F.isnan(v))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda acc, v: acc + v.cast("double")) / F.size(kept))


def array_shift(a: Column, dy: Column, dx: Column, shape: tuple[int, int]) -> Column:
    """Row-major patch moved by (dy, dx) with zero fill."""
    h, w = shape

    def moved(i: Column) -> Column:
        y, x = F.floor(i / w) - dy, i % w - dx
        inside = y.between(0, h - 1) & x.between(0, w - 1)
        return F.when(inside, F.get(a, (y * w + x).cast("int"))).otherwise(F.lit(0.0).cast("float"))

    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), moved)


def baseline_scores(tensors: DataFrame, settings: SampleSettings, leads: Sequence[int], mass="MASSDEN_8m", u="UGRD_10m", v="VGRD_10m") -> DataFrame:
    """Persistence and advection errors per sample and lead; NULL where a channel or lead is absent."""
    pick = lambda kind, channel, lead=0: F.max_by("patch", F.when(
        (F.col("kind") == kind) & (F.col("channel") == channel) & (F.col("lead_hours") == lead), F.lit(1)
    ))
    label = settings.label.name
    wide = tensors.groupBy("sample_key").agg(
        pick("input", mass).alias("_m"), pick("input", u).alias("_u"), pick("input", v).alias("_v"),
        *[pick("label", label, lead).alias(f"_l{lead}") for lead in leads],
    )
    # In steps: inside one expression the means of the wind would be taken again for every cell of every shifted patch.
    wide = wide.withColumns({"_mean_u": array_mean(F.col("_u")), "_mean_v": array_mean(F.col("_v"))})
    out = ["sample_key"]
    for lead in (12, 24):
        if lead in leads:
            metres = lead * 3600.0 / SPACING_M
            by = {f"_d{c}{lead}": F.rint(F.col(f"_mean_{c}") * metres).cast("int") for c in ("u", "v")}
            moved = array_shift(F.col("_m"), F.col(f"_dv{lead}"), F.col(f"_du{lead}"), settings.patch)
            truth = F.col(f"_l{lead}")
            wide = wide.withColumns(by).withColumns({f"_p{lead}": array_squares(F.col("_m"), truth), f"_a{lead}": array_squares(moved, truth)})
            there = F.col("_u").isNotNull() & F.col("_v").isNotNull()
            out.append(mean_of(F.col(f"_p{lead}")).alias(f"persistence_mse_t_plus_{lead}h"))
            out.append(F.when(there, mean_of(F.col(f"_a{lead}"))).alias(f"advection_mse_t_plus_{lead}h"))
        else:
            out += [F.lit(None).cast("double").alias(f"{n}_mse_t_plus_{lead}h") for n in ("persistence", "advection")]
    return wide.select(*out)


def number_samples(rows: DataFrame) -> DataFrame:
    """``sample_id`` by (run time, incident): offset of the run hour plus position inside it.

    A run hour holds one row per active incident, so the windows stay short however long the run is.
    """
    per_hour = rows.groupBy("run_time").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(F.lit(0)).orderBy("run_time").rowsBetween(Window.unboundedPreceding, -1)
    per_hour = per_hour.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    inside = Window.partitionBy("run_time").orderBy("fire_id", "sample_key")
    return rows.join(per_hour, "run_time").withColumn("sample_id", F.col("_before") + F.row_number().over(inside) - 1).drop("_before")


@dataclass(frozen=True)
class SampleSet:
    index: DataFrame
    tensors: DataFrame
    plan: ReductionPlan
    dropped_by_state: DataFrame


def build_samples(
    fires: DataFrame,
    fields: DataFrame,
    detections: DataFrame,
    settings: SampleSettings,
    daily: bool = False,
    done: DataFrame | None = None,
    plan: ReductionPlan | None = None,
    max_samples: int | None = None,
    next_day_only: bool = True,
    domain=geo.GRID_DOMAIN,
    catalog: DataFrame | None = None,
) -> SampleSet:
    """Samples of incident windows: field and hotspot patches, labels, split, baselines, index.

    ``daily`` means over the sample hours of a day with the next day's mean as label; otherwise one
    sample per hour with labels at the configured leads. Samples with any missing field are left out;
    samples in ``done`` are skipped. All channels, hours and days are built, whatever their size; ``plan`` (such as that
    of ``plan_reduction``) leaves some out, ``max_samples`` builds the first ones of a set that ``done`` continues.
    ``catalog`` (see ``readers.field_catalog``) says which fields exist; without it the cells are looked through.
    """
    if daily and not next_day_only:
        raise ValueError("daily samples need next-day labels")
    hours = s.check_hours(settings.sample_hours if settings.sample_hours is not None else ((0, 6, 12, 18) if daily else None))
    leads = (24,) if daily else settings.leads
    kept, dropped = incidents.domain_split(fires, settings.buffer_km, domain)
    kept = with_boxes(kept.drop("rings"), settings.buffer_km)
    span = (settings.run_start, settings.run_end, True) if daily else None
    if plan is None:
        total = count_samples(kept, [(1, None)], hours, span)[0]
        plan = ReductionPlan(True, 1, None, (), total, sample_bytes(total, len(settings.channels) + 1, len(leads), settings.patch))
    channels = [c for c in settings.channels if plan.include_upper_air or not is_upper_air(c)]
    tasks = (daily_tasks if daily else hourly_tasks)(kept, settings, plan)
    tasks = skip_done(tasks, done)
    needed = source_times(tasks, settings, channels, leads, hours if daily else None)
    tasks = complete_tasks(tasks, needed, fields if catalog is None else catalog)
    if max_samples is not None:
        tasks = tasks.orderBy("run_time", "incident_id").limit(max_samples)
    tasks = stage(tasks)
    needed = source_times(tasks, settings, channels, leads, hours if daily else None)
    group = ["sample_key", "kind", "channel", "lead_hours"]
    boxes = tasks.select("incident_id", "xmin", "ymin", "xmax", "ymax").distinct()
    cut = with_patches(needed, boxes, fields, settings)
    times = needed.filter((F.col("kind") == "input") & (F.col("channel") == channels[0].name))
    spots = hotspot_patches(times, boxes, detections, settings)
    spots = spots.select(
        "sample_key", F.lit("input").alias("kind"), F.lit(settings.hotspot_channel).alias("channel"), F.lit(0).alias("lead_hours"), "patch"
    )
    patches = cut.select(*group, "patch").unionByName(spots)
    per_tensor = len(hours) if daily else 1
    if per_tensor > 1:
        tensors = grids.mean_patches(patches, group, per_tensor).withColumn("patch", F.col("patch").cast("array<float>"))
    else:
        tensors = patches
    expected = len(channels) + 1 + len(leads)
    whole = tensors.groupBy("sample_key").agg(F.count("*").alias("_n")).filter(F.col("_n") == expected).select("sample_key")
    tensors = stage(tensors.join(whole, "sample_key", "left_semi"))
    index = sample_index(tasks.join(whole, "sample_key", "left_semi"), tensors, settings, leads, hours if daily else None)
    ids = index.select("sample_key", "sample_id", "split")
    return SampleSet(index, tensors.join(ids, "sample_key"), plan, dropped)


def sample_index(tasks: DataFrame, tensors: DataFrame, settings: SampleSettings, leads: Sequence[int], hours: Sequence[int] | None) -> DataFrame:
    """Index row per sample with split, label availability and baseline errors."""
    listed = ",".join(str(h) for h in hours) if hours else None
    source = F.lit(listed) if listed else F.hour("run_time").cast("string")
    rows = tasks.select(
        "sample_key", F.col("incident_id").alias("fire_id"), F.col("name").alias("incident_name"), "state", "run_time", "run_date",
        F.lit("daily_4h_mean" if hours else "hourly").alias("aggregation_mode"), source.alias("source_hours_utc"),
        F.col("min_lon").alias("bbox_min_lon"), F.col("min_lat").alias("bbox_min_lat"), F.col("max_lon").alias("bbox_max_lon"),
        F.col("max_lat").alias("bbox_max_lat"), "size_acres", s.date_split("run_date", settings.splits).alias("split"),
        *[F.lit(lead in leads).alias(f"label_t_plus_{lead}h_available") for lead in (12, 24)],
    )
    scored = number_samples(rows).join(baseline_scores(tensors, settings, leads), "sample_key")
    return scored.withColumnRenamed("run_time", "run_time_utc")
