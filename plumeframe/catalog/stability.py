"""Queries for daily behaviour of incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumeframe.catalog import tables as t
from plumeframe.catalog.detections import BUCKET_SQL
from plumeframe.catalog.registry import query
from plumeframe.operators import detections as det
from plumeframe.operators import spatial, stability, temporal

t.define(
    "panel",
    f"""select i.incident_id, size_acres, {BUCKET_SQL} as size_bucket, start_date, end_date, day, coalesce(n,0) as pixel_count, coalesce(s,0) as frp_total,
  coalesce(s/n,0) as frp_mean_pixel, cast(end_date-start_date+1 as integer) as active_window_days, cast(day-start_date as integer) as day_of_fire,
  (day-start_date)/greatest(end_date-start_date,1) as rel_progress,
  cast(least(floor((day-start_date)/greatest(end_date-start_date,1)*20),19) as integer) as rel_bin20
  from (select *, start_date+cast(unnest(range(end_date-start_date+1)) as integer) as day from incidents) i
  left join (select incident_id, acq_day as day, count(*) as n, round(sum(frp),6) as s from pixels group by all) p using (incident_id, day)""",
    ["incidents", "pixels"],
)
t.define(
    "trans",
    """select *, coalesce(pix_prev>0 and pixel_count<pix_prev, false) as pix_is_drop, coalesce(pixel_count>pix_prev, false) as pix_is_increase,
  coalesce(frp_prev>0 and frp_total<frp_prev, false) as frp_is_drop, coalesce(frp_total>frp_prev, false) as frp_is_increase,
  max(pixel_count) over (partition by incident_id order by day rows between 1 following and 1 following) as pn1,
  max(pixel_count) over (partition by incident_id order by day rows between 1 following and 3 following) as pn3,
  max(pixel_count) over (partition by incident_id order by day rows between 1 following and 7 following) as pn7,
  max(frp_total) over (partition by incident_id order by day rows between 1 following and 1 following) as fn1,
  max(frp_total) over (partition by incident_id order by day rows between 1 following and 3 following) as fn3,
  max(frp_total) over (partition by incident_id order by day rows between 1 following and 7 following) as fn7
  from (select *, lag(pixel_count) over (partition by incident_id order by day) as pix_prev, lag(frp_total) over (partition by incident_id order by day) as frp_prev from panel)""",
    ["panel"],
)


def _drop_table(value: str, prefix: str, nxt: str, label: str) -> str:
    return f"""select '{label}' as metric, *, drop_from-drop_to as drop_amount, (drop_from-drop_to)/drop_from as drop_pct, drop_to=0 as drop_to_zero,
      coalesce({nxt}1>drop_to,false) as up1, coalesce({nxt}3>drop_to,false) as up3, coalesce({nxt}7>drop_to,false) as up7,
      coalesce({nxt}3>=drop_from,false) as rec3, coalesce({nxt}7>=drop_from,false) as rec7,
      coalesce({nxt}3-drop_to,0) as best3, coalesce({nxt}7-drop_to,0) as best7
      from (select *, cast({prefix}_prev as double) as drop_from, cast({value} as double) as drop_to from trans where {prefix}_is_drop)"""


t.define("pixel_drops", _drop_table("pixel_count", "pix", "pn", "pixel_count"), ["trans"])
t.define("frp_drops", _drop_table("frp_total", "frp", "fn", "frp_total"), ["trans"])
t.define(
    "drops",
    """select metric, incident_id, size_bucket, day, drop_from, drop_to, drop_amount, drop_pct, drop_to_zero, up1, up3, up7, rec3, rec7, best3, best7 from pixel_drops
  union all select metric, incident_id, size_bucket, day, drop_from, drop_to, drop_amount, drop_pct, drop_to_zero, up1, up3, up7, rec3, rec7, best3, best7 from frp_drops""",
    ["pixel_drops", "frp_drops"],
)


def panel(spark, sf):
    incidents = t.incidents(spark, sf)
    points = spatial.assign_points(t.detections(spark, sf), incidents, 2, "size")
    daily = det.daily_series(det.in_window_pixels(points)).withColumn("frp_total", F.round("frp_total", 6))
    daily = daily.withColumn("frp_mean_pixel", F.col("frp_total") / F.col("pixel_count"))
    return temporal.daily_panel(incidents, daily)


def transitions(spark, sf):
    return stability.add_transitions(stability.add_transitions(panel(spark, sf), "pixel_count", "pix"), "frp_total", "frp")


def drops(spark, sf):
    rows = transitions(spark, sf)
    return stability.drop_events(rows, "pixel_count", "pix", "pixel_count").unionByName(
        stability.drop_events(rows, "frp_total", "frp", "frp_total")
    )


@query(
    "stability_inputs",
    "A16 G3",
    t.with_tables(
        "detections incidents",
        """select i.incident_id, cast(end_date-start_date+1 as integer) as active_window_days, count(det_id) as n, round(coalesce(sum(frp),0),6) as frp
        from incidents i left join (select *, cast((det_id*31)%(select max(incident_id)+1 from incidents) as bigint) as incident_id from detections where det_id%9<>0 and frp>=2) d using (incident_id)
        where incident_id%11<>0 group by all""",
    ),
)
def stability_inputs(spark, sf):
    rows = t.incidents(spark, sf).drop("rings").withColumn(
        "end_date", F.expr("case when incident_id%11=0 then 'never' else cast(end_date as string) end")
    ).withColumn("start_date", F.col("start_date").cast("string")).withColumn("active_window_days", F.lit(""))
    doubled = rows.unionByName(rows)
    ids = t.incidents(spark, sf).agg(F.max("incident_id") + 1).scalar()
    pixels = t.detections(spark, sf).withColumn("incident_id", F.col("det_id") * 31 % ids).selectExpr(
        "incident_id", "acq_day",
        "case when det_id%9=0 then 'x' when frp<2 then cast(-frp as string) else cast(frp as string) end as frp",
    )
    incidents, good = stability.stability_inputs(doubled, pixels)
    counts = good.groupBy("incident_id").agg(F.count("*").alias("n"), F.sum("frp").alias("frp"))
    out = incidents.select("incident_id", "active_window_days").join(counts, "incident_id", "left").fillna(0, ["n"]).fillna(0.0, ["frp"])
    return t.rounded(out)


@query(
    "daily_panel",
    "F17 D7 E13",
    t.with_tables(
        "panel",
        """select incident_id, day, pixel_count, round(frp_total,6) as frp_total, round(frp_mean_pixel,6) as frp_mean_pixel, size_bucket, active_window_days,
        day_of_fire, round(rel_progress,6) as rel_progress, rel_bin20, day_of_fire as day_pos from panel""",
    ),
)
def daily_panel(spark, sf):
    out = panel(spark, sf).select(
        "incident_id", "day", "pixel_count", "frp_total", "frp_mean_pixel", "size_bucket", "active_window_days", "day_of_fire",
        "rel_progress", "rel_bin20", "day_pos",
    )
    return t.rounded(out)


@query(
    "transitions",
    "F3 F4",
    t.with_tables(
        "trans",
        """select incident_id, day, pix_prev, pixel_count-pix_prev as pix_delta, round(case when pix_prev>0 then (pixel_count-pix_prev)/pix_prev end,6) as pix_pct_change,
        pix_is_drop, pix_is_increase, frp_is_drop, case when pix_prev is null then 'first_day' when pix_prev=0 and pixel_count=0 then 'zero_to_zero'
        when pix_prev=0 then 'start_from_zero' when pixel_count=0 then 'drop_to_zero' when pixel_count<pix_prev then 'partial_drop'
        when pixel_count>pix_prev then 'increase_positive' else 'stable_positive' end as transition from trans""",
    ),
)
def transitions_query(spark, sf):
    out = transitions(spark, sf).withColumn("transition", stability.transition_class())
    return t.rounded(
        out.select("incident_id", "day", "pix_prev", "pix_delta", "pix_pct_change", "pix_is_drop", "pix_is_increase", "frp_is_drop", "transition")
    )


@query(
    "drop_events",
    "F5",
    t.with_tables(
        "drops",
        """select metric, incident_id, day, round(drop_from,6) as drop_from, round(drop_to,6) as drop_to, round(drop_amount,6) as drop_amount, round(drop_pct,6) as drop_pct,
        drop_to_zero, drop_pct>=0.25e0 as steep_drop_25, drop_pct>=0.5e0 as steep_drop_50, drop_pct>=0.75e0 as steep_drop_75 from drops""",
    ),
)
def drop_events(spark, sf):
    return t.rounded(
        drops(spark, sf).select(
            "metric", "incident_id", "day", "drop_from", "drop_to", "drop_amount", "drop_pct", "drop_to_zero", "steep_drop_25",
            "steep_drop_50", "steep_drop_75",
        )
    )


@query(
    "rebound_metrics",
    "F6",
    t.with_tables(
        "drops",
        """select metric, incident_id, day, up1 as rebound_next_day, up3 as rebound_within_3d, up7 as rebound_within_7d, rec3 as recover_pre_drop_within_3d,
        rec7 as recover_pre_drop_within_7d, round(best3,6) as best_rebound_amount_3d, round(best7,6) as best_rebound_amount_7d from drops""",
    ),
)
def rebound_metrics(spark, sf):
    out = drops(spark, sf)
    names = [c for c in out.columns if c.startswith(("rebound", "recover", "best"))]
    return t.rounded(out.select("metric", "incident_id", "day", *names))


t.define(
    "streaks",
    """select 'frp_total' as metric, incident_id, size_bucket, min(day) as s, max(day) as e, count(*) as len, arg_min(frp_prev, day) as drop_from, arg_max(frp_total, day) as drop_to
  from (select *, day_of_fire - row_number() over (partition by incident_id order by day) as run from trans where frp_is_drop) group by incident_id, size_bucket, run""",
    ["trans"],
)


def streaks(spark, sf):
    return stability.drop_streaks(transitions(spark, sf), "frp_total", "frp", "frp_total")


@query(
    "drop_streaks",
    "F7",
    t.with_tables(
        "streaks",
        """select incident_id, s as streak_start_day, e as streak_end_day, len as streak_len_days, round(drop_from,6) as drop_from, round(drop_to,6) as drop_to,
        round(drop_from-drop_to,6) as streak_drop_amount, round((drop_from-drop_to)/drop_from,6) as streak_drop_pct, drop_to=0 as streak_ends_at_zero from streaks""",
    ),
)
def drop_streaks(spark, sf):
    return t.rounded(
        streaks(spark, sf).select(
            "incident_id", "streak_start_day", "streak_end_day", "streak_len_days", "drop_from", "drop_to", "streak_drop_amount",
            "streak_drop_pct", "streak_ends_at_zero",
        )
    )


@query(
    "drop_summary",
    "E16 J9",
    t.with_tables(
        "drops",
        """select metric, size_bucket, count(*) as drop_events, round(avg(drop_to_zero::int)*100,6) as drop_to_zero_pct, round(avg((drop_pct>=0.25e0)::int)*100,6) as steep_drop_25_pct,
        round(avg((drop_pct>=0.5e0)::int)*100,6) as steep_drop_50_pct, round(avg((drop_pct>=0.75e0)::int)*100,6) as steep_drop_75_pct, round(avg(drop_amount),6) as drop_amount_mean,
        round(quantile_cont(drop_amount,0.5),6) as drop_amount_median, round(quantile_cont(drop_amount,0.9),6) as drop_amount_p90, round(avg(drop_pct)*100,6) as drop_pct_mean,
        round(quantile_cont(drop_pct*100,0.5),6) as drop_pct_median, round(quantile_cont(drop_pct*100,0.9),6) as drop_pct_p90 from drops group by 1,2""",
    ),
)
def drop_summary(spark, sf):
    return t.rounded(stability.summarize_drops(drops(spark, sf)))


@query(
    "rebound_summary",
    "E17 J9",
    t.with_tables(
        "drops",
        """select metric, size_bucket, count(*) as drop_events, round(avg(up1::int)*100,6) as rebound_next_day_pct, round(avg(up3::int)*100,6) as rebound_within_3d_pct,
        round(avg(up7::int)*100,6) as rebound_within_7d_pct, round(avg(rec3::int)*100,6) as recover_pre_drop_within_3d_pct, round(avg(rec7::int)*100,6) as recover_pre_drop_within_7d_pct,
        round(avg(best3),6) as best_rebound_amount_3d_mean, round(avg(best7),6) as best_rebound_amount_7d_mean from drops group by 1,2""",
    ),
)
def rebound_summary(spark, sf):
    return t.rounded(stability.summarize_rebounds(drops(spark, sf)))


@query(
    "transition_mix",
    "E18 J9",
    t.with_tables(
        "trans",
        """select size_bucket, transition, days, cast(sum(days) over (partition by size_bucket) as bigint) as total_days, round(days/sum(days) over (partition by size_bucket)*100,6) as pct_days
        from (select size_bucket, case when pix_prev=0 and pixel_count=0 then 'zero_to_zero' when pix_prev=0 then 'start_from_zero' when pixel_count=0 then 'drop_to_zero'
        when pixel_count<pix_prev then 'partial_drop' when pixel_count>pix_prev then 'increase_positive' else 'stable_positive' end as transition, count(*) as days
        from trans where pix_prev is not null group by all)""",
    ),
)
def transition_mix(spark, sf):
    return t.rounded(stability.transition_mix(transitions(spark, sf)))


@query(
    "streak_summary",
    "E19 J9",
    t.with_tables(
        "streaks",
        """select metric, size_bucket, count(*) as streaks, round(avg(len),6) as streak_len_mean, round(quantile_cont(len,0.5),6) as streak_len_median,
        round(quantile_cont(len,0.9),6) as streak_len_p90, round(avg((drop_to=0)::int)*100,6) as streak_ends_at_zero_pct, round(avg(drop_from-drop_to),6) as streak_drop_amount_mean,
        round(quantile_cont(drop_from-drop_to,0.5),6) as streak_drop_amount_median, round(quantile_cont(drop_from-drop_to,0.9),6) as streak_drop_amount_p90,
        round(avg((drop_from-drop_to)/drop_from)*100,6) as streak_drop_pct_mean, round(quantile_cont((drop_from-drop_to)/drop_from*100,0.5),6) as streak_drop_pct_median,
        round(quantile_cont((drop_from-drop_to)/drop_from*100,0.9),6) as streak_drop_pct_p90 from streaks group by 1,2""",
    ),
)
def streak_summary(spark, sf):
    return t.rounded(stability.summarize_streaks(streaks(spark, sf)))


_CURVE = """count(*) as fire_days, count(*) filter (pixel_count>0) as days_with_detections, round(avg(pixel_count),6) as mean_pixels, round(avg(frp_total),6) as mean_frp_total,
  round(avg(pix_is_drop::int),6) as {a}, round(avg(frp_is_drop::int),6) as {b}"""
_RATES = _CURVE.format(a="drop_rate_pixels", b="drop_rate_frp_total")


@query(
    "day_of_fire_curve",
    "E20 J9",
    t.with_tables(
        "trans",
        f"""select size_bucket, day_of_fire, {_RATES}, round(quantile_cont(pixel_count,0.5),6) as median_pixels, round(quantile_cont(pixel_count,0.9),6) as p90_pixels,
        round(quantile_cont(frp_total,0.5),6) as median_frp_total, round(coalesce(avg(frp_mean_pixel) filter (pixel_count>0),0),6) as mean_frp_pixel_on_detect_days,
        round(count(*) filter (pixel_count>0)/count(*)*100,6) as pct_days_with_detections from trans group by 1,2""",
    ),
)
def day_of_fire_curve(spark, sf):
    return t.rounded(stability.day_of_fire_curve(transitions(spark, sf)))


@query(
    "relative_curve",
    "E21 J9",
    t.with_tables(
        "trans",
        f"""select size_bucket, rel_bin20, {_RATES}, round(quantile_cont(pixel_count,0.5),6) as median_pixels,
        round(coalesce(avg(frp_mean_pixel) filter (frp_mean_pixel>0),0),6) as mean_frp_pixel, round(count(*) filter (pixel_count>0)/count(*)*100,6) as pct_days_with_detections,
        rel_bin20/20 as bin_start_rel, (rel_bin20+1)/20 as bin_end_rel from trans group by 1,2""",
    ),
)
def relative_curve(spark, sf):
    return t.rounded(stability.relative_curve(transitions(spark, sf)))


@query(
    "progress_profile",
    "E21 J14",
    t.with_tables(
        "trans",
        f"""select cast(least(floor(rel_progress*100),99) as integer) as prog_bin, {_CURVE.format(a="pixel_drop_rate", b="frp_drop_rate")},
        round(quantile_cont(pixel_count,0.9),6) as p90_pixels, round(quantile_cont(frp_total,0.9),6) as p90_frp_total,
        round(count(*) filter (pixel_count>0)/count(*)*100,6) as pct_with_detections, round((least(floor(rel_progress*100),99)+0.5)/100,6) as progress_mid
        from trans group by prog_bin, progress_mid""",
    ),
)
def progress_profile(spark, sf):
    return t.rounded(stability.progress_profile(transitions(spark, sf)))


def _event_sql(table: str, p: str) -> str:
    return f"""(select incident_id, count(*) as {p}_drop_events, avg(up7::int) as {p}_rebound7_rate, avg(rec7::int) as {p}_recover7_rate, avg(drop_to_zero::int) as {p}_drop_to_zero_rate,
      quantile_cont(drop_pct,0.5) as {p}_drop_pct_median from {table} group by 1)"""


_FILLED = ["rebound7_rate", "recover7_rate", "drop_to_zero_rate", "drop_pct_median"]
t.define(
    "behaviour",
    f"""select incident_id, size_acres, active_window_days, mean_pixels_per_day, mean_pixels_on_detect_days, mean_frp_total_per_day, mean_frp_total_on_detect_days,
  pixel_drop_rate, frp_drop_rate, pixel_increase_rate, frp_increase_rate, coalesce(pixel_drop_events,0) as pixel_drop_events, coalesce(frp_drop_events,0) as frp_drop_events,
  {', '.join(f'coalesce({p}_{c},0) as {p}_{c}' for p in ('pixel', 'frp') for c in _FILLED)}, log10(size_acres) as log10_size
  from (select incident_id, size_acres, active_window_days, avg(pixel_count) as mean_pixels_per_day, coalesce(avg(pixel_count) filter (pixel_count>0),0) as mean_pixels_on_detect_days,
    avg(frp_total) as mean_frp_total_per_day, coalesce(avg(frp_total) filter (frp_total>0),0) as mean_frp_total_on_detect_days,
    coalesce(avg(pix_is_drop::int) filter (pix_prev is not null),0) as pixel_drop_rate, coalesce(avg(frp_is_drop::int) filter (pix_prev is not null),0) as frp_drop_rate,
    coalesce(avg(pix_is_increase::int) filter (pix_prev is not null),0) as pixel_increase_rate, coalesce(avg(frp_is_increase::int) filter (pix_prev is not null),0) as frp_increase_rate
    from trans group by 1,2,3) left join {_event_sql("pixel_drops", "pixel")} using (incident_id) left join {_event_sql("frp_drops", "frp")} using (incident_id)""",
    ["trans", "pixel_drops", "frp_drops"],
)
_BEHAVIOUR = [
    "mean_pixels_per_day", "mean_pixels_on_detect_days", "mean_frp_total_per_day", "mean_frp_total_on_detect_days", "pixel_drop_rate", "frp_drop_rate",
    "pixel_increase_rate", "frp_increase_rate", *[f"{p}_{c}" for p in ("pixel", "frp") for c in _FILLED], "log10_size",
]


def behaviour(spark, sf):
    rows = transitions(spark, sf)
    return stability.incident_behaviour(
        rows,
        stability.drop_events(rows, "pixel_count", "pix", "pixel_count"),
        stability.drop_events(rows, "frp_total", "frp", "frp_total"),
    )


@query(
    "incident_behaviour",
    "E22 D27 J14",
    t.with_tables("behaviour", "select * replace (" + ", ".join(f"round({c},6) as {c}" for c in _BEHAVIOUR) + ") from behaviour"),
)
def incident_behaviour(spark, sf):
    return t.rounded(behaviour(spark, sf))


@query(
    "rolling_smooth",
    "F19 J14",
    t.with_tables(
        "incidents",
        """, v as (select log10(size_acres) as x, cast(incident_id%17 as double) as y, incident_id, count(*) over () as n from incidents),
        w as (select *, case when win%2=0 then win+1 else win end as wn from (select *, greatest(75, cast(floor(n*0.08e0) as integer)) as win from v)),
        k as (select *, case when wn>n then (case when n%2=1 then n else greatest(1,n-1) end) else wn end as size, row_number() over (order by x, incident_id)-1 as pos from w)
        select a.incident_id, round(avg(b.x),6) as x_smooth, round(avg(b.y),6) as y_smooth from k a join k b on b.pos between a.pos-(a.size-1)//2 and a.pos+(a.size-1)//2
        group by a.incident_id, a.size having count(*) >= greatest(5, a.size//5)""".replace(", v as", "VV as", 1),
    ).replace("\nVV as", ", v as"),
)
def rolling_smooth(spark, sf):
    rows = t.incidents(spark, sf).select(
        "incident_id", F.log10("size_acres").alias("log_size"), (F.col("incident_id") % 17).alias("level")
    )
    out = stability.rolling_smooth(rows, "log_size", "level")
    return t.rounded(out.select("incident_id", "x_smooth", "y_smooth"))


@query(
    "binned_drop_probability",
    "E23 J14",
    t.with_tables(
        "trans",
        """select cast(floor(rel_progress/0.125e0) as integer) as bin_x, cast(floor(log10(size_acres)/0.25e0) as integer) as bin_y, count(*) as rows, round(avg(pix_is_drop::int),6) as mean_value
        from trans where pix_prev is not null group by 1,2 having count(*)>=5""",
    ),
)
def binned_drop_probability(spark, sf):
    rows = transitions(spark, sf).filter("pix_prev is not null").withColumn("log10_size", F.log10("size_acres"))
    return t.rounded(stability.binned_mean(rows, "rel_progress", "log10_size", F.col("pix_is_drop").cast("int"), 0.125, 0.25, 5))


