"""Queries over detections assigned to incidents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumeframe.catalog import tables as t
from plumeframe.catalog.registry import query
from plumeframe.functions import geo
from plumeframe.operators import detections as det
from plumeframe.operators import spatial

BUCKET_SQL = "case when size_acres<5000 then '1k-5k' when size_acres<20000 then '5k-20k' when size_acres<100000 then '20k-100k' else '100k+' end"


def assigned(spark, sf, pad_days=2, policy="size"):
    return spatial.assign_points(t.detections(spark, sf), t.incidents(spark, sf), pad_days, policy)


def pixels(spark, sf):
    return det.in_window_pixels(assigned(spark, sf))


@query(
    "points_in_polygons",
    "D1",
    t.with_tables("pairs", "select det_id, incident_id from pairs"),
)
def points_in_polygons(spark, sf):
    pairs = spatial.points_in_polygons(t.detections(spark, sf), t.incidents(spark, sf), None)
    return pairs.select("det_id", "incident_id")


@query(
    "points_in_polygons_in_window",
    "D2",
    t.with_tables("pairs", "select det_id, incident_id, off_days from pairs where off_days <= 3"),
)
def points_in_window(spark, sf):
    pairs = spatial.points_in_polygons(t.detections(spark, sf), t.incidents(spark, sf), 3)
    off = F.greatest(F.datediff("start_date", "acq_day"), F.datediff("acq_day", "end_date"), F.lit(0))
    return pairs.select("det_id", "incident_id", off.cast("bigint").alias("off_days"))


def _policy_sql(where: str, order: str) -> str:
    return t.with_tables(
        "pairs",
        f"""select det_id, incident_id from (select det_id, incident_id,
        row_number() over (partition by det_id order by {order}) as rn from pairs where {where}) where rn=1""",
    )


def _policy(pad, policy):
    def build(spark, sf):
        return assigned(spark, sf, pad, policy).select("det_id", "incident_id")

    return build


query("assign_smaller_then_shorter", "D3", _policy_sql("off_days<=2", "size_acres, duration, incident_id"))(
    _policy(2, "size")
)
query(
    "assign_by_window_distance",
    "D3",
    _policy_sql("off_days<=5", "off_days*10000+least(duration,9999), start_date, size_acres desc, incident_id"),
)(_policy(5, "window"))
query(
    "assign_by_rounded_size",
    "D3",
    _policy_sql("off_days<=0", "cast(round_even(size_acres,0) as bigint)*10000+duration, incident_id"),
)(_policy(0, "rounded"))
query("assign_by_area_any_time", "D3 J13", _policy_sql("true", "size_acres, incident_id"))(_policy(None, "area"))


@query(
    "assign_within_panel_days",
    "D3",
    t.with_tables(
        "pairs",
        """select det_id, incident_id from (select p.det_id, p.incident_id,
        row_number() over (partition by p.det_id order by size_acres, p.incident_id) as rn
        from pairs p where off_days = 0 and (acq_day - start_date) < 3) where rn=1""",
    ),
)
def assign_within_panel(spark, sf):
    incidents = t.incidents(spark, sf)
    panel = incidents.select(
        "incident_id",
        F.explode(F.sequence("start_date", F.least(F.col("end_date"), F.date_add("start_date", 2)))).alias("day"),
    )
    out = spatial.assign_points(t.detections(spark, sf), incidents, None, "area", panel)
    return out.select("det_id", "incident_id")


@query(
    "phase_counts",
    "D4",
    t.with_tables("assigned", "select incident_id, phase, count(*) as n from assigned group by all"),
)
def phase_counts(spark, sf):
    return assigned(spark, sf).groupBy("incident_id", "phase").agg(F.count("*").alias("n"))


STATS_SQL = """select i.incident_id, i.name, i.state, i.cause_general, i.size_acres, i.start_date, i.end_date,
  {bucket} as size_bucket, cast(greatest(i.end_date-i.start_date+1,1) as integer) as active_window_days,
  coalesce(n,0) as pixels_in_window_anyconf, round(coalesce(s,0),6) as frp_sum_in_window,
  round(s/n,6) as frp_mean_in_window, round(lo,6) as frp_min_in_window, round(hi,6) as frp_max_in_window,
  coalesce(pre,0) as pre_start_pixels_pad, coalesce(post,0) as post_end_pixels_pad,
  coalesce(days,0) as days_with_pixels_anyconf,
  round(coalesce(days,0)/greatest(i.end_date-i.start_date+1,1),6) as pct_active_days_with_pixels_anyconf,
  round(coalesce(n,0)/(i.size_acres/1000),6) as pixels_per_1000_acres,
  round(coalesce(s,0)/i.size_acres,6) as frp_per_acre,
  round(we,6) as det_bbox_lon_span_deg, round(sn,6) as det_bbox_lat_span_deg
  from incidents i left join (select incident_id, count(*) filter (phase='in') as n,
    sum(frp) filter (phase='in') as s, min(frp) filter (phase='in') as lo, max(frp) filter (phase='in') as hi,
    count(*) filter (phase='pre') as pre, count(*) filter (phase='post') as post,
    count(distinct acq_day) filter (phase='in') as days,
    max(lon) filter (phase='in')-min(lon) filter (phase='in') as we,
    max(lat) filter (phase='in')-min(lat) filter (phase='in') as sn
    from assigned group by 1) a using (incident_id)""".format(bucket=BUCKET_SQL.replace("size_acres", "i.size_acres"))
t.define("stats", STATS_SQL, ["assigned", "incidents"])


def stats(spark, sf):
    incidents = t.incidents(spark, sf)
    return det.incident_stats(spatial.assign_points(t.detections(spark, sf), incidents, 2, "size"), incidents)


@query("incident_detection_stats", "E6 D26 B46", t.with_tables("stats", "select * from stats"))
def incident_detection_stats(spark, sf):
    out = stats(spark, sf).drop("min_lon", "min_lat", "max_lon", "max_lat")
    return t.rounded(out)


def _grouped_sql(group: str, incidents: bool = True, share: bool = True) -> str:
    extra = ", count(distinct incident_id) as fire_count" if incidents else ""
    extra += ", round(count(*)/sum(count(*)) over (),6) as pixel_share" if share else ""
    return t.with_tables(
        "pixels",
        f"""select {group}, count(*) as pixel_count, round(avg(frp),6) as frp_mean,
        round(quantile_cont(frp,0.5),6) as frp_median, round(quantile_cont(frp,0.9),6) as frp_p90{extra}
        from pixels group by 1""",
    )


for _name, _column in [("cause", "cause_general"), ("size_bucket", "size_bucket"), ("state", "state")]:

    def _build(spark, sf, column=_column):
        return t.rounded(det.grouped_pixel_stats(pixels(spark, sf), [column]))

    query(f"pixel_stats_by_{_name}", "E7", _grouped_sql(_column))(_build)


@query("pixel_stats_by_progress", "E7 B31", _grouped_sql("rel_bin", False, False))
def pixel_stats_by_progress(spark, sf):
    return t.rounded(det.grouped_pixel_stats(pixels(spark, sf), ["rel_bin"], False, False))


@query("pixel_stats_by_year", "E7", _grouped_sql("cast(year(acq_day) as integer) as year", False, False))
def pixel_stats_by_year(spark, sf):
    return t.rounded(det.grouped_pixel_stats(pixels(spark, sf), ["year"], False, False))


@query(
    "overall_detection_summary",
    "E8",
    t.with_tables(
        "stats pixels",
        """select * from (select count(*) as fire_count, count(*) filter (pixels_in_window_anyconf>0) as fires_with_any_pixels,
        round(avg(pixels_in_window_anyconf),6) as mean_pixels_per_fire,
        round(quantile_cont(pixels_in_window_anyconf,0.5),6) as median_pixels_per_fire,
        round(quantile_cont(pixels_in_window_anyconf,0.9),6) as p90_pixels_per_fire,
        round(sum(days_with_pixels_anyconf)/greatest(sum(active_window_days),1),6) as weighted_pct_active_days_with_pixels_anyconf
        from stats) cross join (select count(*) as total_pixels_in_window_anyconf, round(avg(frp),6) as frp_mean_pixel,
        round(quantile_cont(frp,0.5),6) as frp_median_pixel, round(quantile_cont(frp,0.9),6) as frp_p90_pixel,
        round(quantile_cont(frp,0.99),6) as frp_p99_pixel, round(avg((daynight='D')::int),6) as day_fraction,
        round(avg((daynight='N')::int),6) as night_fraction from pixels)""",
    ),
)
def overall_detection_summary(spark, sf):
    incidents = t.incidents(spark, sf)
    points = spatial.assign_points(t.detections(spark, sf), incidents, 2, "size")
    return t.rounded(det.overall_summary(det.incident_stats(points, incidents), det.in_window_pixels(points)))


for _name, _by, _min in [
    ("pixels", "pixels_in_window_anyconf", 0),
    ("density", "pixels_per_1000_acres", 0),
    ("mean_frp", "frp_mean_in_window", 3),
]:

    def _top(spark, sf, by=_by, low=_min):
        out = det.top_incidents(t.rounded(stats(spark, sf)), by, 25, low)
        return out.select("incident_id", by)

    query(
        f"top_incidents_by_{_name}",
        "F13",
        t.with_tables(
            "stats",
            f"""select incident_id, {_by} from stats where pixels_in_window_anyconf >= {_min}
            order by {_by} desc nulls last, incident_id limit 25""",
        ),
    )(_top)


KLASS_SQL = "case when confidence in ('l','n','h') then confidence when confidence='85' then 'h' else 'u' end"
t.define(
    "wide",
    f"""select * exclude (rn), {KLASS_SQL} as klass,
  case when acq_day < start_date then 'pre' when acq_day > end_date then 'post' else 'in' end as phase from (
  select *, row_number() over (partition by det_id order by off_days*10000+least(duration,9999), start_date,
    size_acres desc, incident_id) as rn from pairs where off_days <= 5) where rn = 1""",
    ["pairs"],
)
COHERENCE_SQL = """select i.incident_id, i.size_acres, cast(greatest(i.end_date-i.start_date+1,1) as integer) as active_window_days,
  coalesce(tot,0) as total_window_detections, coalesce(inw,0) as in_window_detections,
  coalesce(pre,0) as pre_start_detections, coalesce(post,0) as post_end_detections,
  coalesce(hn,0) as high_nom_total_window, coalesce(hnin,0) as high_nom_in_window, coalesce(low,0) as low_total_window,
  inw/tot as in_window_share, (pre+post)/tot as noise_share,
  coalesce(dany,0) as days_with_any_detection_in_window, coalesce(dhn,0) as days_with_any_hn_in_window,
  coalesce(dany,0)/greatest(i.end_date-i.start_date+1,1) as pct_active_days_with_any_detection,
  coalesce(dhn,0)/greatest(i.end_date-i.start_date+1,1) as pct_active_days_with_any_hn,
  (greatest(i.end_date-i.start_date+1,1)-coalesce(gt3,0))/greatest(i.end_date-i.start_date+1,1) as pct_active_days_few_hn_le3,
  coalesce(d13,0)/greatest(i.end_date-i.start_date+1,1) as pct_active_days_hn_1to3,
  first_detection_date, last_detection_date, first_in as first_in_window_detection_date, last_in as last_in_window_detection_date,
  cast(greatest(coalesce(i.start_date-first_detection_date,0),0) as integer) as days_before_start_first_detection,
  cast(greatest(coalesce(last_detection_date-i.end_date,0),0) as integer) as days_after_end_last_detection,
  cast(coalesce(last_in-first_in+1,0) as integer) as in_window_detection_span_days,
  (last_in-first_in+1)/greatest(i.end_date-i.start_date+1,1) as in_window_detection_span_frac,
  (peak-i.start_date)/greatest(i.end_date-i.start_date,1) as in_window_peak_relative_position
  from incidents i left join (select incident_id, cast(sum(n) as bigint) as tot, cast(coalesce(sum(n) filter (phase='in'),0) as bigint) as inw,
    cast(coalesce(sum(n) filter (phase='pre'),0) as bigint) as pre, cast(coalesce(sum(n) filter (phase='post'),0) as bigint) as post,
    cast(sum(hn) as bigint) as hn, cast(coalesce(sum(hn) filter (phase='in'),0) as bigint) as hnin, cast(sum(low) as bigint) as low,
    count(*) filter (phase='in') as dany, count(*) filter (phase='in' and hn>0) as dhn,
    count(*) filter (phase='in' and hn>3) as gt3, count(*) filter (phase='in' and hn between 1 and 3) as d13,
    min(acq_day) as first_detection_date, max(acq_day) as last_detection_date,
    min(acq_day) filter (phase='in') as first_in, max(acq_day) filter (phase='in') as last_in,
    arg_max(acq_day, n*1000000-(acq_day-date '1970-01-01')) filter (phase='in') as peak
    from (select incident_id, acq_day, phase, count(*) as n, count(*) filter (klass in ('h','n')) as hn,
      count(*) filter (klass='l') as low from wide group by all) group by 1) a using (incident_id)"""
t.define("coherence", COHERENCE_SQL, ["wide", "incidents"])


def coherence(spark, sf):
    incidents = t.incidents(spark, sf)
    return det.coherence_metrics(spatial.assign_points(t.detections(spark, sf), incidents, 5, "window"), incidents)


_SHARES = [
    "in_window_share", "noise_share", "pct_active_days_with_any_detection", "pct_active_days_with_any_hn",
    "pct_active_days_few_hn_le3", "pct_active_days_hn_1to3", "in_window_detection_span_frac",
    "in_window_peak_relative_position",
]


@query(
    "coherence_metrics",
    "E9",
    t.with_tables(
        "coherence",
        "select * replace (" + ", ".join(f"round({c},6) as {c}" for c in _SHARES) + ") from coherence",
    ),
)
def coherence_metrics(spark, sf):
    out = coherence(spark, sf)
    drop = ["name", "state", "cause_general", "start_date", "end_date", "min_lon", "min_lat", "max_lon", "max_lat"]
    return t.rounded(out.drop(*drop))


@query(
    "relative_profile",
    "E10",
    t.with_tables(
        "wide",
        """select cast(b.range as integer) as bin_index, b.range/10 as bin_start_rel, (b.range+1)/10 as bin_end_rel,
        round(coalesce(s,0)/(select count(distinct incident_id) from wide where phase='in' and klass in ('h','n')),6) as avg_profile_share
        from range(10) b left join (select bin, sum(share) as s from (select incident_id, bin, n/sum(n) over (partition by incident_id) as share
          from (select incident_id, cast(greatest(least(floor((acq_day-start_date)/greatest(duration-1,1)*10),9),0) as integer) as bin,
            count(*) as n from wide where phase='in' and klass in ('h','n') group by all)) group by 1) x on x.bin=b.range""",
    ),
)
def relative_profile(spark, sf):
    return t.rounded(det.relative_profile(assigned(spark, sf, 5, "window")))


_MEDIANS = {
    "median_size_acres": "size_acres", "median_active_window_days": "active_window_days",
    "median_days_before_start_first_detection": "days_before_start_first_detection",
    "median_days_after_end_last_detection": "days_after_end_last_detection",
    "median_in_window_detection_span_frac": "in_window_detection_span_frac",
    "median_in_window_peak_relative_position": "in_window_peak_relative_position",
}


@query(
    "provider_summary",
    "E11",
    t.with_tables(
        "coherence",
        """select case when incident_id%2=1 then 'A' else 'B' end as provider, count(*) as fire_count,
        round(avg(size_acres),6) as mean_size_acres, round(avg(active_window_days),6) as mean_active_window_days,
        count(*) filter (total_window_detections>0) as fires_with_any_window_detection,
        count(*) filter (in_window_detections>0) as fires_with_any_in_window_detection,
        cast(sum(total_window_detections) as bigint) as total_window_detections,
        cast(sum(in_window_detections) as bigint) as total_in_window_detections,
        cast(sum(pre_start_detections) as bigint) as total_pre_start_detections,
        cast(sum(post_end_detections) as bigint) as total_post_end_detections,
        round(sum(in_window_detections)/greatest(sum(total_window_detections),1),6) as in_window_detection_share_total,
        round((sum(pre_start_detections)+sum(post_end_detections))/greatest(sum(total_window_detections),1),6) as noise_share_total,
        round(avg(in_window_share),6) as mean_in_window_share_per_fire, round(avg(noise_share),6) as mean_noise_share_per_fire,
        round(sum(days_with_any_detection_in_window)/sum(active_window_days),6) as pct_active_days_with_any_detection_weighted,
        round(sum(days_with_any_hn_in_window)/sum(active_window_days),6) as pct_active_days_with_any_hn_weighted,
        round(sum(pct_active_days_few_hn_le3*active_window_days)/sum(active_window_days),6) as pct_active_days_few_hn_le3_weighted, """
        + ", ".join(f"round(quantile_cont({c},0.5),6) as {n}" for n, c in _MEDIANS.items())
        + " from coherence group by 1",
    ),
)
def provider_summary(spark, sf):
    metrics = coherence(spark, sf).withColumn("provider", F.when(F.col("incident_id") % 2 == 1, "A").otherwise("B"))
    return t.rounded(det.provider_summary(metrics))


@query(
    "frp_by_year",
    "E12",
    t.with_tables(
        "pixels",
        """select cast(year(acq_day) as integer) as year, count(*) as detection_count, round(avg(frp),6) as mean_frp,
        round(quantile_cont(frp,0.5),6) as median_frp, round(quantile_cont(frp,0.9),6) as p90_frp from pixels group by 1""",
    ),
)
def frp_by_year(spark, sf):
    return t.rounded(det.frp_by(pixels(spark, sf), "year"))


@query(
    "frp_by_progress",
    "E12",
    t.with_tables(
        "pixels",
        """select cast(b.range as integer) as rel_bin, count(incident_id) as detection_count, round(avg(frp),6) as mean_frp,
        round(quantile_cont(frp,0.5),6) as median_frp, round(quantile_cont(frp,0.9),6) as p90_frp
        from range(10) b left join pixels p on p.rel_bin=b.range group by 1""",
    ),
)
def frp_by_progress(spark, sf):
    return t.rounded(det.frp_by(pixels(spark, sf), "rel_bin", dense=10))


@query(
    "daily_detection_series",
    "E13",
    t.with_tables(
        "pixels",
        """select incident_id, acq_day as day, count(*) as pixel_count, round(sum(frp),6) as frp_total,
        round(avg(frp),6) as frp_mean_pixel from pixels group by all""",
    ),
)
def daily_detection_series(spark, sf):
    return t.rounded(det.daily_series(pixels(spark, sf)))


@query(
    "panel_detection_counts",
    "E14 B17",
    t.with_tables(
        "pairs",
        """, panel as (select incident_id, start_date + cast(unnest(range(least(end_date-start_date+1,3))) as integer) as day from incidents),
        hit as (select * from (select p.*, row_number() over (partition by det_id order by size_acres, p.incident_id) as rn
          from pairs p join panel on panel.incident_id=p.incident_id and panel.day=p.acq_day) where rn=1),
        c as (select incident_id, acq_day as day, count(*) as tot, count(*) filter (confidence='h') as h,
          count(*) filter (confidence='n') as n, count(*) filter (confidence='l') as l,
          count(*) filter (confidence='85') as u, count(*) filter (daynight='D') as d, count(*) filter (daynight='N') as nn,
          sum(frp) as s from hit group by all)
        select incident_id, day, coalesce(tot,0) as viirs_pixels_total, coalesce(h,0) as viirs_pixels_conf_h,
          coalesce(n,0) as viirs_pixels_conf_n, coalesce(l,0) as viirs_pixels_conf_l, coalesce(u,0) as viirs_pixels_conf_u,
          coalesce(d,0) as viirs_pixels_day, coalesce(nn,0) as viirs_pixels_night, round(coalesce(s,0),6) as viirs_frp_sum_mw,
          round(s/tot,6) as viirs_frp_mean_mw, cast(coalesce(tot,0)>0 as integer) as has_viirs,
          cast(coalesce(tot,0)=0 as integer) as no_viirs from panel left join c using (incident_id, day)""".replace(", panel as", "PANEL as", 1),
    ).replace("\nPANEL as", ", panel as"),
)
def panel_detection_counts(spark, sf):
    incidents = t.incidents(spark, sf)
    panel = incidents.select(
        "incident_id",
        F.explode(F.sequence("start_date", F.least(F.col("end_date"), F.date_add("start_date", 2)))).alias("day"),
    )
    points = spatial.assign_points(t.detections(spark, sf), incidents, None, "area", panel)
    return t.rounded(det.panel_counts(panel, points))


@query(
    "minute_counts",
    "E15",
    t.with_tables(
        "assigned",
        """select incident_id, cast(epoch_us(date_trunc('minute', acq_ts))//60000000 as bigint) as minute_int,
        count(*) as pixel_count from assigned group by all""",
    ),
)
def minute_counts(spark, sf):
    return det.minute_counts(assigned(spark, sf))


@query(
    "valid_detections",
    "C4 A3",
    t.with_tables(
        "detections",
        """select det_id, frp, acq_day from detections where lat between -90 and 90 and lon between -180 and 180
        and frp>=0 and acq_day between date '2024-01-04' and date '2024-01-20'""",
    ),
)
def valid_detections(spark, sf):
    out = det.valid_detections(t.detections(spark, sf), dt.date(2024, 1, 4), dt.date(2024, 1, 20))
    return out.select("det_id", "frp", "acq_day")


@query(
    "run_window_detections",
    "C5",
    t.with_tables(
        "detections",
        """select cast(hour_utc as timestamp) as hour_utc, count(*) as n from detections
        where acq_ts between timestamp '2024-01-08 00:00:00' and timestamp '2024-03-24 23:59:00' group by 1""",
    ),
)
def run_window_detections(spark, sf):
    out = det.run_window(t.detections(spark, sf), dt.date(2024, 1, 10), dt.date(2024, 1, 20))
    return t.plain_times(out.groupBy("hour_utc").agg(F.count("*").alias("n")))


@query(
    "envelope_prefilter",
    "C6",
    t.with_tables(
        "detections incidents",
        """, b as (select min(min_lon)-0.2e0 as w, max(max_lon)+0.2e0 as e, min(min_lat)-0.2e0 as s, max(max_lat)+0.2e0 as n
          from incidents where size_acres > 150000) select det_id from detections, b where lon between w and e and lat between s and n""".replace(
            ", b as", "BB as", 1
        ),
    ).replace("\nBB as", ", b as"),
)
def envelope_prefilter(spark, sf):
    large = t.incidents(spark, sf).filter("size_acres > 150000")
    return spatial.envelope_filter(t.detections(spark, sf), large).select("det_id")


t.define(
    "boxed",
    """select d.det_id, d.frp, d.hour_utc, i.incident_id from detections d join incidents i
  on d.lon between i.min_lon and i.max_lon and d.lat between i.min_lat and i.max_lat
  and d.hour_utc between cast(i.start_date as timestamp) and cast(i.end_date as timestamp) + interval 5 hour""",
    ["detections", "incidents"],
)


def boxed(spark, sf):
    windows = t.incidents(spark, sf).drop("rings").selectExpr(
        "incident_id", "min_lon", "min_lat", "max_lon", "max_lat", "cast(start_date as timestamp) as start_hour",
        "cast(end_date as timestamp) + interval 5 hour as end_hour",
    )
    return windows, spatial.points_in_boxes(t.detections(spark, sf), windows)


@query(
    "detections_in_incident_boxes",
    "D21",
    t.with_tables(
        "boxed",
        """select incident_id, count(*) as points, count(distinct hour_utc) as hours, round(sum(frp),6) as total_frp,
        round(max(frp),6) as max_frp, min(hour_utc) as first_hour, max(hour_utc) as last_hour from boxed group by 1""",
    ),
)
def detections_in_incident_boxes(spark, sf):
    _, pairs = boxed(spark, sf)
    hourly = pairs.groupBy("incident_id", "hour_utc").agg(
        F.count("*").alias("n"), F.sum("frp").alias("s"), F.max("frp").alias("m")
    )
    return t.rounded(
        hourly.groupBy("incident_id").agg(
            F.sum("n").alias("points"), F.count("*").alias("hours"), F.sum("s").alias("total_frp"),
            F.max("m").alias("max_frp"), F.min("hour_utc").alias("first_hour"), F.max("hour_utc").alias("last_hour"),
        )
    )


@query(
    "detections_in_one_box",
    "D23",
    t.with_tables(
        "detections",
        """select det_id, acq_ts, frp from detections where lon between -120 and -112 and lat between 35 and 41
        and acq_ts between timestamp '2024-01-05 06:00:00' and timestamp '2024-01-18 18:30:00'""",
    ),
)
def detections_in_one_box(spark, sf):
    out = spatial.select_points(
        t.detections(spark, sf), -120.0, 35.0, -112.0, 41.0, dt.datetime(2024, 1, 5, 6), dt.datetime(2024, 1, 18, 18, 30)
    )
    return t.plain_times(out.select("det_id", "acq_ts", "frp"))


@query(
    "imager_footprint_incidents",
    "C8",
    t.with_tables(
        "incidents",
        "select incident_id from incidents where cx-30 between -140.7e0 and -49e0 and cy+12 between 14e0 and 53e0",
    ),
)
def imager_footprint_incidents(spark, sf):
    centre_lon, centre_lat = (F.col("min_lon") + F.col("max_lon")) / 2, (F.col("min_lat") + F.col("max_lat")) / 2
    return t.incidents(spark, sf).filter(geo.in_footprint(centre_lon - 30, centre_lat + 12)).select("incident_id")
