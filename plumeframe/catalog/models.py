"""Queries for splits, models, coverage and missing-detection causes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumeframe.catalog import tables as t
from plumeframe.catalog.detections import stats
from plumeframe.catalog.grids import cells, channel, timed_incidents
from plumeframe.catalog.overpass import cloud_granules, cloud_pixels
from plumeframe.catalog.registry import query
from plumeframe.operators import grids, models
from plumeframe.plans import reports
from plumeframe.scale import stage

# ---- sample index ----------------------------------------------------------------------------


def sample_index(spark, sf):
    """One sample per incident-day, some without an hour list."""
    return t.incidents(spark, sf).drop("rings").withColumn("run_date", F.explode(F.sequence("start_date", "end_date"))).selectExpr(
        "incident_id*100+datediff(run_date, start_date) as sample_id", "incident_id as fire_id", "run_date",
        "timestamp_seconds(unix_seconds(cast(run_date as timestamp)) + (incident_id%24)*3600) as run_time_utc",
        "case when incident_id%5<>0 then '0,6, 12,18' end as source_hours_utc",
        "min_lon as bbox_min_lon", "min_lat as bbox_min_lat", "max_lon as bbox_max_lon", "max_lat as bbox_max_lat",
        "case when run_date<=date'2024-01-14' then 'train' when run_date<=date'2024-01-20' then 'val' else 'test' end as split",
    )


t.define(
    "index",
    """select incident_id*100+(run_date-start_date) as sample_id, incident_id as fire_id, run_date, incident_id, min_lon, min_lat, max_lon, max_lat,
  case when run_date<=date '2024-01-14' then 'train' when run_date<=date '2024-01-20' then 'val' else 'test' end as split
  from (select *, start_date+cast(unnest(range(end_date-start_date+1)) as integer) as run_date from incidents)""",
    ["incidents"],
)
t.define(
    "meta",
    """select fire_id, min(run_date) as fire_start, max(run_date) as fire_end, count(*) as n_samples,
  cast(round_even(avg((min_lat+max_lat)/2)/2e0,0) as integer)||'_'||cast(round_even(avg((min_lon+max_lon)/2)/2e0,0) as integer) as geo_cell from index group by 1""",
    ["index"],
)
t.define(
    "raw_split",
    """select *, case when fire_start-date '1970-01-01'<=(select quantile_cont(fire_start-date '1970-01-01',0.7) from meta) then 'train'
  when fire_start-date '1970-01-01'<=(select quantile_cont(fire_start-date '1970-01-01',0.85) from meta) then 'val' else 'test' end as s from meta""",
    ["meta"],
)
t.define(
    "clean_split",
    """select * from raw_split r where s='train' or (s='val' and geo_cell not in (select geo_cell from raw_split where s='train'))
  or (s='test' and geo_cell not in (select geo_cell from raw_split where s='train') and geo_cell not in (select geo_cell from raw_split where s='val'))""",
    ["raw_split"],
)


def splits(spark, sf):
    return models.temporal_geo_split(models.incident_meta(sample_index(spark, sf), step=2.0))


@query("temporal_geo_split", "I7 G4 B41", t.with_tables("clean_split", "select fire_id, fire_start, geo_cell, s as split_clean from clean_split"))
def temporal_geo_split(spark, sf):
    return splits(spark, sf).select("fire_id", "fire_start", "geo_cell", "split_clean")


@query(
    "split_summary",
    "I7 G4",
    t.with_tables(
        "clean_split",
        """select s as split_clean, cast(sum(n_samples) as bigint) as samples, count(*) as fires, count(distinct geo_cell) as geo_cells, min(fire_start) as run_date_min, max(fire_end) as run_date_max
        from clean_split group by 1""",
    ),
)
def split_summary(spark, sf):
    return models.split_summary(splits(spark, sf))


@query(
    "split_overlaps",
    "G5",
    t.with_tables(
        "clean_split raw_split",
        """select 'geo_cell' as key, count(*) as shared from (select geo_cell from clean_split group by 1 having count(distinct s)>1)
        union all select 'fire_id', count(*) from (select fire_id from clean_split group by 1 having count(distinct s)>1)""",
    ),
)
def split_overlaps(spark, sf):
    return models.split_overlaps(splits(spark, sf), "split_clean", ["geo_cell", "fire_id"])


@query(
    "standardized_sizes",
    "I1",
    t.with_tables(
        "incidents",
        """select incident_id, round((size_acres-m)/s,6) as size_acres_z, 0.0::double as flat_z, round((size_acres-mt)/(st+1e-6),6) as train_z from incidents,
        (select avg(size_acres) as m, stddev_pop(size_acres) as s, avg(size_acres) filter (incident_id%3=0) as mt, stddev_pop(size_acres) filter (incident_id%3=0) as st from incidents)""",
    ),
)
def standardized_sizes(spark, sf):
    rows = t.incidents(spark, sf).select("incident_id", "size_acres", F.lit(5.0).alias("flat"))
    plain = models.standardize(rows, ["size_acres", "flat"])
    trained = models.standardize(rows, ["size_acres"], F.col("incident_id") % 3 == 0, 1e-6)
    out = plain.join(trained.select("incident_id", F.col("size_acres_z").alias("train_z")), "incident_id")
    return t.rounded(out.select("incident_id", "size_acres_z", "flat_z", "train_z"))


# ---- missing detections ----------------------------------------------------------------------

MODEL_ROWS = """incident_id, cast(datediff(day, start_date) as double) as age, cast((incident_id*13+datediff(day, start_date)*29)%101 as double)/100 as cloud_day_frac,
  cast((incident_id*31+datediff(day, start_date)*7)%101 as double)/100 as cloud_night_frac, case when (incident_id*17+datediff(day, start_date)*5)%101 < 30+40*((incident_id*13+datediff(day, start_date)*29)%101)/100 then 1 else 0 end as no_viirs"""


def model_rows(spark, sf):
    rows = t.incidents(spark, sf).withColumn("day", F.explode(F.sequence("start_date", "end_date"))).selectExpr(*t._columns(MODEL_ROWS))
    return models.cloud_columns(rows)


t.define(
    "model_rows",
    "select *, cloud_day_frac>=0.5 and cloud_night_frac>=0.5 as cloudy from (select "
    + MODEL_ROWS.replace("datediff(day, start_date)", "(day-start_date)")
    + " from (select *, start_date+cast(unnest(range(end_date-start_date+1)) as integer) as day from incidents))",
    ["incidents"],
)


@query(
    "missing_rates",
    "E25",
    t.with_tables(
        "model_rows",
        """select count(*) as model_rows, round(avg(no_viirs),6) as no_viirs_rate, round(avg(no_viirs) filter (cloudy),6) as no_viirs_rate_cloudy,
        round(avg(no_viirs) filter (not cloudy),6) as no_viirs_rate_not_cloudy from model_rows""",
    ),
)
def missing_rates(spark, sf):
    return t.rounded(models.missing_rates(model_rows(spark, sf)))


@query(
    "cloud_row_statistics",
    "E25",
    t.with_tables(
        "model_rows",
        """select incident_id, age, round(case when age<>1 then (cloud_day_frac+cloud_night_frac)/2 else cloud_night_frac end,6) as cloud_mean_frac,
        round(case when age<>1 then greatest(cloud_day_frac,cloud_night_frac) else cloud_night_frac end,6) as cloud_max_frac, cast(cloudy and age<>1 as integer) as both_overpasses_cloudy_50pct from model_rows""",
    ),
)
def cloud_row_statistics(spark, sf):
    rows = model_rows(spark, sf).drop("cloud_mean_frac", "cloud_max_frac", "both_overpasses_cloudy_50pct")
    gaps = rows.withColumn("cloud_day_frac", F.expr("case when age<>1 then cloud_day_frac end"))
    out = models.cloud_columns(gaps)
    return t.rounded(out.select("incident_id", "age", "cloud_mean_frac", "cloud_max_frac", "both_overpasses_cloudy_50pct"))


Z = ["age_z", "cloud_day_frac_z", "cloud_night_frac_z"]


def fitted(spark, sf):
    scaled = stage(models.standardize(model_rows(spark, sf), ["age", "cloud_day_frac", "cloud_night_frac"]))
    return scaled, models.fit_logistic(scaled, "no_viirs", Z)


@query("logistic_coefficients", "I2")
def logistic_coefficients(spark, sf):
    scaled, fit = fitted(spark, sf)
    names = F.explode(F.create_map(*[x for k, v in fit.items() for x in (F.lit(k), F.lit(v))]))
    return scaled.agg(F.count("*").alias("rows")).select("rows", names.alias("term", "coefficient"))


@query("missing_attribution", "I4")
def missing_attribution(spark, sf):
    scaled, fit = fitted(spark, sf)
    return models.attribute_missing(scaled, fit, Z[0], Z[1:]).select("incident_id", "age", "cloud_contrib", "burnout_contrib", "dominant_cause")


# ---- ridge -----------------------------------------------------------------------------------


def training_rows(spark, sf):
    features = grids.channel_features(cells(spark, sf), "sample", ["MASSDEN", "UGRD", "VGRD"])
    target = channel(spark, sf, "LABEL").groupBy("sample").agg((F.avg("value") * 10 + 3).alias("y_raw"))
    split = F.expr("case when sample%10<7 then 'train' when sample%10<9 then 'val' else 'test' end")
    return features.join(target, "sample").withColumn("y_log", F.log1p("y_raw")).withColumn("split", split)


@query("ridge_split_metrics", "I5")
def ridge_split_metrics(spark, sf):
    rows = stage(training_rows(spark, sf))
    names = [c for c in rows.columns if "__" in c]
    return models.ridge(rows, "split", names, "y_log", "y_raw")[1]


def image_rows(spark, sf):
    vectors = t.read(spark, sf, "embeddings").selectExpr("cast(floor(vec_id/4) as bigint) as sample", "vec_id%4 as c", "embedding")
    mass = vectors.filter("c = 0").select("sample", F.col("embedding").alias("image"))
    return mass.join(training_rows(spark, sf).select("sample", "y_log", "y_raw", "split"), "sample")


@query("image_ridge_metrics", "I6 E31")
def image_ridge_metrics(spark, sf):
    return models.image_ridge(stage(image_rows(spark, sf)), "split", "image", "y_log", "y_raw")[1]


@query("model_comparison", "I10 J16")
def model_comparison(spark, sf):
    rows = stage(training_rows(spark, sf))
    names = [c for c in rows.columns if "__" in c]
    point = models.ridge(rows, "split", names, "y_log", "y_raw")[1]
    image = models.image_ridge(stage(image_rows(spark, sf)), "split", "image", "y_log", "y_raw")[1]
    return models.compare_models({"point_ridge": point, "image_ridge": image})


@query(
    "split_errors",
    "I5 E2",
    t.with_tables(
        "incidents",
        """select split, count(*) as n, round(sqrt(avg((p-y)*(p-y))),6) as rmse, round(avg(abs(p-y)),6) as mae, round(1-sum((p-y)*(p-y))/(var_pop(y)*count(*)),6) as r2,
        round(sqrt(avg((ln(1+p)-ln(1+y))*(ln(1+p)-ln(1+y)))),6) as rmse_log, round(avg(abs(ln(1+p)-ln(1+y))),6) as mae_log, round(1-sum((ln(1+p)-ln(1+y))*(ln(1+p)-ln(1+y)))/(var_pop(ln(1+y))*count(*)),6) as r2_log
        from (select cast(incident_id%3 as varchar) as split, size_acres/1000 as y, cast((incident_id*37)%150 as double) as p from incidents) group by 1""",
    ),
)
def split_errors(spark, sf):
    rows = t.incidents(spark, sf).selectExpr(
        "cast(incident_id%3 as string) as split", "size_acres/1000 as y", "cast((incident_id*37)%150 as double) as p"
    ).selectExpr("*", "log1p(y) as yl", "log1p(p) as pl")
    return t.rounded(models.split_metrics(rows, "split", "y", "p", "yl", "pl"))


# ---- samples of incidents --------------------------------------------------------------------


@query(
    "stratified_incident_sample",
    "I8",
    t.with_tables(
        "incidents",
        """, f as (select *, case when size_acres<5000 then '1k-5k' when size_acres<20000 then '5k-20k' when size_acres<100000 then '20k-100k' else '100k+' end as size_bucket from incidents),
        b as (select size_bucket, count(*) as n, 120.0e0*count(*)/sum(count(*)) over () as exact from f group by 1), c as (select *, cast(greatest(1, floor(exact)) as bigint) as base from b),
        d as (select *, 120-sum(base) over () as left_ from c), r as (select *, row_number() over (order by n>base desc, exact-base desc, size_bucket) as by_rest, row_number() over (order by base desc, size_bucket) as by_size from d),
        q as (select size_bucket, greatest(1, base+(n>base and by_rest<=left_)::int-case when by_size=1 then greatest(0,-left_) else 0 end) as quota from r),
        k as (select *, row_number() over (partition by size_bucket order by md5(concat('42|', incident_id)), incident_id) as rn from f)
        select incident_id, name, size_acres, k.size_bucket from k join q using (size_bucket) where rn<=quota""",
    ).replace("\n, f as", ", f as"),
)
def stratified_incident_sample(spark, sf):
    return models.stratified_sample(t.incidents(spark, sf).drop("rings"), 120).select("incident_id", "name", "size_acres", "size_bucket")


@query(
    "incident_day_sample",
    "I9",
    t.with_tables(
        "incidents",
        """select incident_id, day, cast(day-start_date as integer) as days_since_start from (select incident_id, start_date, start_date+cast(unnest(range(end_date-start_date+1)) as integer) as day from incidents)
        where day between date '2024-01-03' and date '2024-01-25' order by md5(concat('42|', incident_id, '|', day-date '1970-01-01')), incident_id, day limit 500""",
    ),
)
def incident_day_sample(spark, sf):
    days = models.sample_incident_days(t.incidents(spark, sf).drop("rings"), 500, dt.date(2024, 1, 3), dt.date(2024, 1, 25))
    return days.select("incident_id", "day", "days_since_start")


# ---- coverage --------------------------------------------------------------------------------

t.define(
    "covered",
    """select *, greatest(h0, lo) as a, least(h1, hi) as b, (epoch(h1)-epoch(h0))/3600+1 as hours from (select *, date_trunc('hour',start_ts) as h0, date_trunc('hour',end_ts) as h1 from timed),
  (select min(hour_utc) as lo, max(hour_utc) as hi from detections)""",
    ["timed", "detections"],
)


@query(
    "window_coverage",
    "E33 J15",
    t.with_tables(
        "covered",
        """select incident_id, h0>=lo and h1<=hi as window_fully_covered, cast(greatest(floor((epoch(b)-epoch(a))/3600)+1,0) as bigint) as overlap_hours,
        round(greatest(floor((epoch(b)-epoch(a))/3600)+1,0)/greatest(hours,1),6) as overlap_fraction from covered""",
    ),
)
def window_coverage(spark, sf):
    out = reports.temporal_coverage(timed_incidents(spark, sf), t.detections(spark, sf))
    return t.rounded(out.select("incident_id", "window_fully_covered", "overlap_hours", "overlap_fraction"))


t.define(
    "overlap",
    """select incident_id, h0, h1, coalesce(n,0) as points, coalesce(h,0) as hours, fh, lh from (select incident_id, date_trunc('hour',start_ts) as h0, date_trunc('hour',end_ts) as h1 from timed) left join
  (select incident_id, count(*) as n, count(distinct hour_utc) as h, min(hour_utc) as fh, max(hour_utc) as lh from detections d join timed i on d.lon between min_lon and max_lon and d.lat between min_lat and max_lat
    and hour_utc between date_trunc('hour',start_ts) and date_trunc('hour',end_ts) group by 1) using (incident_id)""",
    ["timed", "detections"],
)


@query(
    "incident_overlap_summary",
    "E33 D21 J15",
    t.with_tables(
        "overlap",
        """select count(*) as fires_total, count(*) filter (points>0) as fires_with_overlap, count(*) filter (points=0) as fires_without_overlap, round(quantile_cont(points,0.5),6) as median_points,
        round(quantile_cont(hours,0.5),6) as median_hours, round(quantile_cont((epoch(fh)-epoch(h0))/3600,0.5),6) as median_hours_to_first, round(quantile_cont((epoch(h1)-epoch(lh))/3600,0.5),6) as median_hours_from_last_to_end from overlap""",
    ),
)
def incident_overlap_summary(spark, sf):
    return t.rounded(reports.overlap_summary(reports.incident_overlap(timed_incidents(spark, sf), t.detections(spark, sf))))


t.define(
    "sample_hits",
    """select sample_id, count(*) as points, count(distinct hour_utc) as matched_hours, sum(frp) as total_frp from (select sample_id, min_lon, min_lat, max_lon, max_lat, cast(run_date as timestamp)+to_hours(h) as hour_utc
  from (select *, unnest(case when incident_id%5<>0 then [0,6,12,18] else [incident_id%24] end) as h from index)) s join detections d using (hour_utc) where d.lon between min_lon and max_lon and d.lat between min_lat and max_lat group by 1""",
    ["index", "detections"],
)


@query(
    "detections_at_sample_hours",
    "D22 E33",
    t.with_tables("sample_hits", "select sample_id, points, matched_hours, round(total_frp,6) as total_frp from sample_hits"),
)
def detections_at_sample_hours(spark, sf):
    out = reports.sample_overlap(sample_index(spark, sf), t.detections(spark, sf)).filter("points > 0")
    return t.rounded(out.select("sample_id", "points", "matched_hours", "total_frp"))


for _group, _expr in (("split", "split"), ("run_year", "cast(year(run_date) as integer) as run_year")):

    def _by(spark, sf, group=_group):
        rows = stage(reports.sample_overlap(sample_index(spark, sf), t.detections(spark, sf)))
        return t.rounded(reports.sample_overlap_by(rows, group))

    query(
        f"sample_overlap_by_{_group}",
        "E33 J15",
        t.with_tables(
            "index sample_hits",
            f"""select {_expr}, count(*) as samples, cast(count(points) as bigint) as samples_with_detections, round(count(points)/count(*),6) as pct_with_detections,
            round(quantile_cont(coalesce(points,0),0.5),6) as median_points, round(quantile_cont(coalesce(matched_hours,0),0.5),6) as median_matched_hours from index left join sample_hits using (sample_id) group by 1""",
        ),
    )(_by)

_DAYS = "(epoch(date_trunc('hour',end_ts))-epoch(date_trunc('hour',start_ts)))/3600+1"
_PROFILE = {
    "by_state": f"""select state, count(distinct incident_id) as fires, round(quantile_cont(size_acres,0.5),6) as median_size_acres, round(quantile_cont(greatest({_DAYS},0)/24,0.5),6) as median_duration_days from timed group by 1""",
    "by_year": "select cast(year(start_ts) as integer) as start_year, count(distinct incident_id) as fires, round(quantile_cont(size_acres,0.5),6) as median_size_acres from timed group by 1",
    "quantiles": " union all ".join(
        "select "
        + ", ".join(f"round(quantile_cont({e},{q}),6) as q{int(q * 100)}" for q in reports.QUANTILES)
        + f", '{n}' as measure from timed"
        for n, e in (("size_acres", "size_acres"), ("duration_days", f"greatest({_DAYS},0)/24"))
    ),
}
for _name, _sql in _PROFILE.items():

    def _profile(spark, sf, name=_name):
        return t.rounded(reports.incident_profile(timed_incidents(spark, sf))[name])

    query(f"incident_profile_{_name}", "E34 J15", t.with_tables("timed", _sql))(_profile)

_SEEN = {
    "by_day": "select cast(hour_utc as date) as date_utc, count(*) as points, round(sum(frp),6) as total_frp from detections group by 1",
    "by_year": "select cast(year(hour_utc) as integer) as year_utc, count(*) as points, round(quantile_cont(frp,0.5),6) as median_frp, round(quantile_cont(frp,0.95),6) as frp_p95 from detections group by 1",
}
for _name, _sql in _SEEN.items():

    def _seen(spark, sf, name=_name):
        return t.rounded(reports.detection_profile(t.detections(spark, sf))[name])

    query(f"detection_profile_{_name}", "E34 J15", t.with_tables("detections", _sql))(_seen)


# ---- composite reports -----------------------------------------------------------------------


@query("cloud_panel", "J12 I9 E14")
def cloud_panel(spark, sf):
    out = reports.cloud_panel(
        t.detections(spark, sf), t.incidents(spark, sf), cloud_granules(spark, sf), cloud_pixels(spark, sf), 400, dt.date(2024, 1, 2), dt.date(2024, 1, 28), 300.0
    )
    return out.select("incident_id", "day", "viirs_pixels_total", "viirs_frp_sum_mw", "cloud_day_pct", "cloud_night_pct")


@query("missing_cause_shares", "J11 I2 I3 I4")
def missing_cause_shares(spark, sf):
    out = reports.missing_cause_report(
        t.detections(spark, sf), t.incidents(spark, sf), cloud_granules(spark, sf), cloud_pixels(spark, sf), max_minutes=300.0
    )
    return out["cause_shares"]


@query("point_baseline_metrics", "J16 I5 I7 B37 E30")
def point_baseline_metrics(spark, sf):
    # One vector sample per incident-day sample of the same rank in the hash order of its id.
    features = grids.channel_features(cells(spark, sf), "sample", ["MASSDEN", "UGRD", "VGRD"])
    total = features.agg(F.count("*")).scalar()
    keyed = sample_index(spark, sf).withColumn("sample", F.pmod(F.xxhash64("sample_id"), total))
    named = keyed.select("sample_id", "sample").join(features, "sample").drop("sample")
    target = stats(spark, sf).select(F.col("incident_id").alias("fire_id"), (F.col("size_acres") / 1000).alias("y"))
    y = sample_index(spark, sf).select("sample_id", "fire_id").join(target, "fire_id").select("sample_id", "y")
    return reports.train_point_baseline(sample_index(spark, sf), named, y, ["MASSDEN"])["metrics"]
