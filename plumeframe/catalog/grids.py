"""Queries for patches, rasters and sample sets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumeframe.catalog import tables as t
from plumeframe.catalog.observations import G, fields
from plumeframe.catalog.registry import query
from plumeframe.catalog.scalars import project_sql
from plumeframe.config import Channel, ReductionRules, SampleSettings, SplitDates
from plumeframe.operators import grids, temporal
from plumeframe.plans import reports, samples
from plumeframe.sources import readers, sinks

BUFFER = 300.0


def written_catalog(spark, sf):
    """The catalog of the fields once they are written."""
    path = t.scratch(spark, "fields")
    sinks.write_fields(fields(spark, sf), path)
    return readers.field_catalog(spark, path)


def timed_incidents(spark, sf):
    """Incidents with times of day."""
    return t.incidents(spark, sf).withColumn(
        "start_ts", F.expr("timestamp_seconds(unix_seconds(cast(start_date as timestamp)) + (incident_id%24)*3600 + 120)")
    ).withColumn("end_ts", F.expr("timestamp_seconds(unix_seconds(cast(end_date as timestamp)) + (incident_id%17)*3600 + 1800)"))


t.define(
    "timed",
    """select *, cast(start_date as timestamp)+to_hours(incident_id%24)+to_minutes(2) as start_ts, cast(end_date as timestamp)+to_hours(incident_id%17)+to_minutes(30) as end_ts from incidents""",
    ["incidents"],
)
_HOURS = "cast(greatest(floor((epoch(date_trunc('hour',end_ts))-epoch(date_trunc('hour',start_ts)))/3600)+1,0) as bigint)"
t.define(
    "window_hours",
    f"select incident_id, date_trunc('hour',start_ts) as h0, unnest(range({_HOURS})) as i, state, size_acres from timed",
    ["timed"],
)


@query(
    "incident_hour_axis",
    "F15",
    t.with_tables(
        "window_hours",
        """select incident_id, i as hour_index, h0 + to_hours(i) as run_time from (select *, row_number() over (partition by incident_id order by i) as rn from window_hours
        where (i<=72 or i%2=0) and hour(h0 + to_hours(i)) in (0,3,6,9,12,15,18,21))""",
    ),
)
def incident_hour_axis(spark, sf):
    out = temporal.incident_hours(timed_incidents(spark, sf), 2, sample_hours=(0, 3, 6, 9, 12, 15, 18, 21))
    return t.plain_times(out.select("incident_id", "hour_index", "run_time"))


@query(
    "incident_day_axis",
    "F16",
    t.with_tables(
        "incidents",
        """select incident_id, day from (select *, row_number() over (partition by incident_id order by day) as rn from (select incident_id, start_date+cast(unnest(range(end_date-start_date+1)) as integer) as day from incidents)
        where day between date '2024-01-05' and date '2024-01-27')""",
    ),
)
def incident_day_axis(spark, sf):
    out = temporal.incident_days(t.incidents(spark, sf), dt.date(2024, 1, 5), dt.date(2024, 1, 28), True)
    return out.select("incident_id", "day")


@query(
    "storage_estimates",
    "E28 J7",
    t.with_tables(
        "window_hours",
        """select state, count(*) as samples, cast(count(*)*(12+2)*256*256*2 as bigint) as bytes from window_hours where i<=72 or i%2=0 group by 1""",
    ),
)
def storage_estimates(spark, sf):
    steps = temporal.hour_steps(2)
    out = timed_incidents(spark, sf).groupBy("state").agg(F.sum(F.size(steps)).alias("samples"))
    return out.withColumn("bytes", samples.sample_bytes(F.col("samples"), 12, 2, (256, 256)))


CHANNELS = (
    Channel("MASSDEN", "8m_above_ground"), Channel("UGRD", "10m_above_ground"), Channel("VGRD", "10m_above_ground"),
    Channel("TMP", "700mb"), Channel("DZDT", "850mb"),
)


@query(
    "reduction_plan",
    "J7 E28 B38",
    t.with_tables(
        "window_hours",
        """, a as (select count(*) as s0, count(*) filter (i<=72 or i%2=0) as s1 from window_hours), c as (select count(*) as s2 from (select row_number() over (partition by incident_id order by i) as rn
          from window_hours where i<=72 or i%2=0) where rn<=60), x as (select *, s0*(6+2)*256*256*2 as b0, s0*(4+2)*256*256*2 as bu, s1*(4+2)*256*256*2 as b1, s2*(4+2)*256*256*2 as b2, cast(0.00003e0*1073741824*s0*30 as bigint) as budget from a, c)
        select cast(s2 as bigint) as samples, cast(b2 as bigint) as bytes, 'drop_upper_air_and_dzdt,two_hour_cadence_after_72h,cap_samples_per_fire=60' as actions from x""".replace(", a as", "AA as", 1),
    ).replace("\nAA as", ", a as"),
)
def reduction_plan(spark, sf):
    fires = timed_incidents(spark, sf)
    plan = samples.plan_reduction(fires, CHANNELS, 2, (256, 256), ReductionRules(budget_gb=0.001, cap_samples_per_incident=60))
    # The chosen numbers are counts over the whole incident table.
    return spark.range(1).select(
        F.lit(plan.samples).cast("bigint").alias("samples"), F.lit(plan.bytes).cast("bigint").alias("bytes"), F.lit(",".join(plan.actions)).alias("actions")
    )


# ---- patches ---------------------------------------------------------------------------------

_BOX = f"""select *, least(x0,x1)-{BUFFER * 1000} as xmin, least(y0,y1)-{BUFFER * 1000} as ymin, greatest(x0,x1)+{BUFFER * 1000} as xmax, greatest(y0,y1)+{BUFFER * 1000} as ymax
  from (select *, {project_sql("min_lon", "min_lat")[0]} as x0, {project_sql("min_lon", "min_lat")[1]} as y0, {project_sql("max_lon", "max_lat")[0]} as x1, {project_sql("max_lon", "max_lat")[1]} as y1 from incidents)"""
t.define("boxes", _BOX, ["incidents"])
t.define(
    "subsets",
    f"""select * from (select *, cast(greatest(ceil((xmin-({G.x0}))/{G.dx}),0) as integer) as ix0, cast(least(floor((xmax-({G.x0}))/{G.dx}),{G.nx - 1}) as integer) as ix1,
  cast(greatest(ceil((ymin-({G.y0}))/{G.dy}),0) as integer) as iy0, cast(least(floor((ymax-({G.y0}))/{G.dy}),{G.ny - 1}) as integer) as iy1 from boxes) where ix1-ix0>=1 and iy1-iy0>=1""",
    ["boxes"],
)


def lattice_sql(cells: str) -> str:
    """Bilinear values at (px, py) positions of a window; cells(incident_id, gy, gx, px, py, ix0, ix1, iy0, iy1, run_time)."""
    return f"""select incident_id, gy as iy, gx as ix, round(sum(w*value),5) as value from (select incident_id, run_time, gy, gx, ix0+bx+dx as ix, iy0+by_+dy as iy,
      (case dy when 0 then 1-(py-by_) else py-by_ end)*(case dx when 0 then 1-(px-bx) else px-bx end) as w
      from (select *, cast(least(floor(px),ix1-ix0-1) as integer) as bx, cast(least(floor(py),iy1-iy0-1) as integer) as by_ from {cells}),
      (select unnest([0,1]) as dx), (select unnest([0,1]) as dy)) join (select * from fields where variable='COLMD') using (run_time, iy, ix) group by 1,2,3 having count(*)=4"""


def boxed(spark, sf):
    return samples.with_boxes(t.incidents(spark, sf).drop("rings"), BUFFER).withColumn(
        "run_time", F.col("start_date").cast("timestamp")
    )


def windows(spark, sf):
    wanted = grids.subset_window(boxed(spark, sf), G)
    field = grids.read_field(fields(spark, sf), None, "COLMD", "entire_atmosphere")
    keep = ["incident_id", "run_time", "xmin", "ymin", "xmax", "ymax"]
    return grids.gather_windows(wanted, field, keep, ["run_time"])


@query(
    "field_patches",
    "D10",
    t.with_tables(
        "subsets fields",
        lattice_sql(
            """(select incident_id, cast(start_date as timestamp) as run_time, ix0, ix1, iy0, iy1, cast(gx as integer) as gx, cast(gy as integer) as gy, gx*(ix1-ix0)/5 as px, gy*(iy1-iy0)/4 as py
            from subsets, (select range as gx from range(6)), (select range as gy from range(5)))"""
        ),
    ),
)
def field_patches(spark, sf):
    patches = grids.resample_patch(windows(spark, sf), (5, 6))
    return t.rounded(grids.patch_cells(patches, 6).select("incident_id", "iy", "ix", "value"), 5)


PIXEL, TILE = 60_000.0, 8


@query(
    "fixed_pixel_patches",
    "D11",
    t.with_tables(
        "subsets fields",
        lattice_sql(
            f"""(select * from (select incident_id, cast(start_date as timestamp) as run_time, ix0, ix1, iy0, iy1, cast(gx as integer) as gx, cast(gy as integer) as gy,
              (xmin+(gx+0.5e0)*{PIXEL}-({G.x0}))/{G.dx}-ix0 as px, (ymin+(gy+0.5e0)*{PIXEL}-({G.y0}))/{G.dy}-iy0 as py
              from (select *, cast(ceil(greatest(xmax-xmin,{PIXEL})/{PIXEL}) as bigint) as nx, cast(ceil(greatest(ymax-ymin,{PIXEL})/{PIXEL}) as bigint) as ny from subsets),
              lateral (select unnest(range(nx)) as gx), lateral (select unnest(range(ny)) as gy) where nx>=2 and ny>=2)
              where px between 0 and ix1-ix0 and py between 0 and iy1-iy0)"""
        ),
    ),
)
def fixed_pixel_patches(spark, sf):
    keep = ["incident_id", "run_time", "xmin", "ymin", "xmax", "ymax"]
    wanted = grids.fixed_grid(grids.subset_window(boxed(spark, sf), G).select(*keep, "ix0", "ix1", "iy0", "iy1"), PIXEL)
    tiles = grids.fixed_tiles(wanted, G, PIXEL, TILE)
    field = grids.read_field(fields(spark, sf), None, "COLMD", "entire_atmosphere")
    held = grids.gather_windows(tiles, field, [c for c in tiles.columns if c not in ("ix0", "ix1", "iy0", "iy1")], ["run_time"])
    cells = grids.resample_tiles(held, G, PIXEL, TILE).filter("value is not null")
    return t.rounded(cells.select("incident_id", "iy", "ix", "value"), 5)


# ---- point rasters ---------------------------------------------------------------------------

_DX, _DY = project_sql("lon", "lat")
t.define(
    "boxpoints",
    f"""select b.*, d.det_id, d.frp, d.hour_utc, d.acq_day as day, d.x, d.y from (select *, {_DX} as x, {_DY} as y from detections) d join
  (select *, xmin+270000 as bx0, ymin+270000 as by0, xmax-270000 as bx1, ymax-270000 as by1 from boxes) b
  on d.x between b.bx0 and b.bx1 and d.y between b.by0 and b.by1 and d.acq_day between b.start_date and b.end_date""",
    ["detections", "boxes"],
)


def box_points(spark, sf, extra=0, hours=None, hourly=False):
    boxes = samples.with_boxes(t.incidents(spark, sf).drop("rings"), 30.0)
    points = t.detections(spark, sf) if hours is None else reports.in_sample_hours(t.detections(spark, sf), hours)
    return reports.boxed_detections(reports.projected(points), boxes, extra, hourly)


@query(
    "hotspot_rasters",
    "H1",
    t.with_tables(
        "boxpoints",
        """select incident_id, hour_utc, cast(least(greatest(round_even((y-by0)/(by1-by0)*7,0),0),7) as integer) as iy, cast(least(greatest(round_even((x-bx0)/(bx1-bx0)*9,0),0),9) as integer) as ix,
        round(sum(frp),6) as value from boxpoints group by all""",
    ),
)
def hotspot_rasters(spark, sf):
    return t.rounded(grids.rasterize_lattice(box_points(spark, sf, hourly=True), ["incident_id", "hour_utc"], (8, 10)))


PX = 20_000.0
_FIXED = f"cast(least(floor((y-by0)/{PX}), ceil((by1-by0)/{PX})-1) as integer) as iy, cast(least(floor((x-bx0)/{PX}), ceil((bx1-bx0)/{PX})-1) as integer) as ix"
_FIXED_IN = f"x < bx0+ceil((bx1-bx0)/{PX})*{PX} and y < by0+ceil((by1-by0)/{PX})*{PX} and ceil((bx1-bx0)/{PX})>=2 and ceil((by1-by0)/{PX})>=2"


def fixed_pairs(spark, sf, extra=0):
    return grids.fixed_grid(box_points(spark, sf, extra), PX)


@query(
    "fixed_pixel_rasters",
    "H2",
    t.with_tables("boxpoints", f"select incident_id, {_FIXED}, round(sum(frp),6) as value, count(*) as hits from boxpoints where {_FIXED_IN} group by all"),
)
def fixed_pixel_rasters(spark, sf):
    return t.rounded(grids.rasterize_fixed(fixed_pairs(spark, sf), ["incident_id"], PX))


@query(
    "latest_hit_days",
    "H3",
    t.with_tables(
        "boxpoints",
        f"select incident_id, {_FIXED}, cast(max(day-start_date)+1 as integer) as latest_day from boxpoints where {_FIXED_IN} group by all",
    ),
)
def latest_hit_days(spark, sf):
    rows = fixed_pairs(spark, sf).withColumn("day_index", F.datediff("day", "start_date"))
    return grids.latest_hit_day(grids.rasterize_fixed(rows, ["incident_id", "day_index"], PX), ["incident_id"])


@query(
    "cumulative_and_recent",
    "H12",
    t.with_tables(
        "boxpoints",
        f"""select incident_id, round(sum(frp),6) as cumulative_total_frp, count(distinct (iy,ix)) as cells, round(coalesce(sum(frp) filter (day between end_date-1 and end_date),0),6) as recent_window_total_frp
        from (select *, {_FIXED} from boxpoints where {_FIXED_IN}) group by 1""",
    ),
)
def cumulative_and_recent(spark, sf):
    pairs = fixed_pairs(spark, sf)
    examples = t.incidents(spark, sf).select(
        "incident_id", F.date_sub("end_date", 1).alias("window_start"), F.col("end_date").alias("anchor_day")
    )
    out = reports.cumulative_and_recent(pairs, None, examples, PX, 2)["totals"].filter("cells is not null")
    return t.rounded(out.select("incident_id", "cumulative_total_frp", "cells", "recent_window_total_frp"))


@query(
    "band_means",
    "H4",
    """select l_suppkey, cast(floor((lat-32)/16*19) as integer) as iy, cast(floor((lon+124)/20*19) as integer) as ix, round(avg(r),6) as r, round(avg(g),6) as g, round(avg(b),6) as b from (
    select l_suppkey, -124+((l_partkey*7919+l_orderkey*13)%2000)/1e2 as lon, 32+((l_partkey*104729+l_orderkey*7)%1600)/1e2 as lat, l_discount as r, l_tax as g, case when l_partkey%7<>0 then l_quantity end as b from lineitem)
    where b is not null and lon between -124 and -104 and lat between 32 and 48 group by 1,2,3""",
)
def band_means(spark, sf):
    pixels = t.read(spark, sf, "lineitem").selectExpr(
        "l_suppkey", "-124+((l_partkey*7919+l_orderkey*13)%2000)/1e2 as lon", "32+((l_partkey*104729+l_orderkey*7)%1600)/1e2 as lat",
        "l_discount as r", "l_tax as g", "case when l_partkey%7<>0 then l_quantity end as b",
    )
    cells, _ = grids.band_means(pixels, ["l_suppkey"], ["r", "g", "b"], (-124.0, 32.0, -104.0, 48.0), 20, 20)
    return t.rounded(cells)


# ---- sample cells from the embedding tensors -------------------------------------------------

NAMES = "case vec_id%4 when 0 then 'MASSDEN' when 1 then 'UGRD' when 2 then 'VGRD' else 'LABEL' end"


def cells(spark, sf):
    """Eight-row patches: four consecutive vectors are the channels of one sample."""
    return t.read(spark, sf, "embeddings").selectExpr(
        "vec_id", "cast(floor(vec_id/4) as bigint) as sample", f"{NAMES} as channel", "posexplode(embedding) as (_i, v)"
    ).selectExpr(
        "vec_id", "sample", "channel", "cast(floor(_i/8) as int) as iy", "cast(_i%8 as int) as ix", "cast(v as double) as value"
    )


t.define(
    "cells",
    f"""select vec_id, vec_id//4 as sample, {NAMES} as channel, cast((i-1)//8 as integer) as iy, cast((i-1)%8 as integer) as ix, cast(embedding[i] as double) as value
  from (select *, unnest(range(1, len(embedding)+1)) as i from embeddings)""",
)
t.define("shape", "select cast(max(iy)+1 as integer) as h from cells", ["cells"])


def shape(spark, sf):
    rows = cells(spark, sf).agg(F.max("iy").alias("h")).first()
    return rows["h"] + 1, 8


def channel(spark, sf, name):
    return cells(spark, sf).filter(F.col("channel") == name).select("sample", "iy", "ix", "value")


def wind(spark, sf, gain=2.0):
    mean = lambda c, n: channel(spark, sf, c).groupBy("sample").agg((F.avg("value") * gain).alias(n))
    return mean("UGRD", "u").join(mean("VGRD", "v"), "sample")


t.define(
    "wind",
    "select sample, 2*avg(value) filter (channel='UGRD') as u, 2*avg(value) filter (channel='VGRD') as v from cells group by 1 having u is not null and v is not null",
    ["cells"],
)


@query(
    "hourly_cell_means",
    "H5",
    t.with_tables(
        "cells",
        """select sample//2 as pair, iy, ix, case when count(value)=count(*) then round(avg(value),6) end as value from (select sample, vec_id, iy, ix, case when (iy+ix+vec_id)%37<>0 then value end as value from cells)
        where sample//2 in (select sample//2 from cells group by 1 having count(distinct vec_id)=8) group by 1,2,3""",
    ),
)
def hourly_cell_means(spark, sf):
    rows = cells(spark, sf).selectExpr(
        "cast(floor(sample/2) as bigint) as pair", "vec_id as run_time", "iy", "ix", "case when (iy+ix+vec_id)%37<>0 then value end as value"
    )
    return t.rounded(grids.mean_cells(rows, ["pair"], 8))


@query(
    "shifted_patches",
    "H6",
    t.with_tables(
        "cells shape",
        """select vec_id, cast(iy+vec_id%5-2 as integer) as iy, cast(ix+vec_id%3-1 as integer) as ix, value from cells, shape where iy+vec_id%5-2 between 0 and h-1 and ix+vec_id%3-1 between 0 and 7""",
    ),
)
def shifted_patches(spark, sf):
    dy, dx = (F.col("vec_id") % 5 - 2).cast("int"), (F.col("vec_id") % 3 - 1).cast("int")
    return grids.shift_cells(cells(spark, sf).select("vec_id", "iy", "ix", "value"), dy, dx, shape(spark, sf))


t.define(
    "advected",
    """select c.sample, cast(iy+round_even(v*43200/3000,0) as integer) as iy, cast(ix+round_even(u*43200/3000,0) as integer) as ix, value from cells c join wind using (sample), shape
  where channel='MASSDEN' and iy+round_even(v*43200/3000,0) between 0 and h-1 and ix+round_even(u*43200/3000,0) between 0 and 7""",
    ["cells", "wind", "shape"],
)


@query("advected_patches", "H7", t.with_tables("advected", "select * from advected"))
def advected_patches(spark, sf):
    return grids.advect(channel(spark, sf, "MASSDEN"), wind(spark, sf), ["sample"], 12, shape(spark, sf))


@query(
    "baseline_errors",
    "E29 H7",
    t.with_tables(
        "cells advected",
        """select sample, round(avg(power(m.value-l.value,2)),6) as persistence_mse, round(avg(power(coalesce(a.value,0)-l.value,2)),6) as advection_mse from cells l join cells m using (sample, iy, ix)
        left join advected a using (sample, iy, ix) where l.channel='LABEL' and m.channel='MASSDEN' group by 1""",
    ),
)
def baseline_errors(spark, sf):
    mass, label = channel(spark, sf, "MASSDEN"), channel(spark, sf, "LABEL")
    moved = grids.advect(mass, wind(spark, sf), ["sample"], 12, shape(spark, sf))
    out = grids.patch_mse(mass, label, ["sample"], "persistence_mse").join(grids.patch_mse(moved, label, ["sample"], "advection_mse"), "sample")
    return t.rounded(out)


@query(
    "channel_features",
    "E30",
    t.with_tables(
        "cells",
        "select sample, "
        + ", ".join(f"round(avg(value) filter (channel='{c}'),6) as {c}__mean, round(stddev_pop(value) filter (channel='{c}'),6) as {c}__std" for c in ("MASSDEN", "UGRD", "VGRD"))
        + " from cells where channel<>'LABEL' group by 1",
    ),
)
def channel_features(spark, sf):
    return t.rounded(grids.channel_features(cells(spark, sf), "sample", ["MASSDEN", "UGRD", "VGRD"]))


@query(
    "pooled_patches",
    "E31",
    t.with_tables("cells", "select vec_id, iy//2 as iy, ix//2 as ix, round(avg(value),6) as value from cells group by 1,2,3"),
)
def pooled_patches(spark, sf):
    return t.rounded(grids.pool_mean(cells(spark, sf), ["vec_id"], shape(spark, sf), 2))


@query(
    "mean_wind",
    "H10",
    t.with_tables(
        "cells",
        """select s.sample, round(coalesce(avg(u.m),0),6) as u, round(coalesce(avg(v.m),0),6) as v from (select distinct sample from cells) s left join
        (select sample, vec_id//8 as r, avg(value) as m from cells where channel='UGRD' and sample%3<>0 group by 1,2) u using (sample) left join
        (select sample, vec_id//8 as r, avg(value) as m from cells where channel='VGRD' group by 1,2) v on v.sample=s.sample and v.r=u.r group by s.sample having true""".replace("coalesce(avg(v.m),0)", "coalesce(avg(v.m) filter (u.m is not null),0)"),
    ),
)
def mean_wind(spark, sf):
    runs = cells(spark, sf).withColumn("run_time", F.floor(F.col("vec_id") / 8))
    u = runs.filter("channel = 'UGRD' and sample % 3 <> 0")
    return t.rounded(grids.mean_wind(u, runs.filter("channel = 'VGRD'"), runs.select("sample").distinct(), "sample"))


def _blur_sql(source: str, axis: str, size: str) -> str:
    """One pass of the blur: every cell and its two mirror images hand their weighted value to the cells around."""
    other = "ix" if axis == "iy" else "iy"
    return f"""select sample, cast(j+k as integer) as {axis}, {other}, sum(value*w) as value from (select *, unnest([{axis}, -1-{axis}, 2*n-1-{axis}]) as j from (select *, {size} as n from {source}))
      cross join kernel where j+k between 0 and n-1 group by all"""


@query(
    "smoothed_patches",
    "H8",
    t.with_tables(
        "cells shape",
        f""", kernel as (select k, exp(-0.5e0*power(k/0.7e0,2))/(select sum(exp(-0.5e0*power(x/0.7e0,2))) from (select unnest(range(-3,4)) as x)) as w from (select unnest(range(-3,4)) as k)),
        seed as (select sample, iy, ix, value from cells where channel='MASSDEN'), down as ({_blur_sql("seed", "iy", "(select h from shape)")}), across as ({_blur_sql("down", "ix", "8")})
        select sample, iy, ix, round(value,6) as value from across""",
    ).replace("\n, kernel as", ", kernel as"),
)
def smoothed_patches(spark, sf):
    return t.rounded(grids.gaussian_blur(channel(spark, sf, "MASSDEN"), ["sample"], shape(spark, sf), 0.7).select("sample", "iy", "ix", "value"))


@query("spread_baselines", "H9")
def spread_baselines(spark, sf):
    seed = channel(spark, sf, "MASSDEN").filter("value > 0.05").withColumn("value", F.lit(1.0))
    return grids.spread_baseline(seed, wind(spark, sf, 0.05), "sample", shape(spark, sf), 3000.0, 24.0, 0.0)


@query(
    "residual_scores",
    "H11",
    t.with_tables(
        "cells shape",
        """, j as (select sample, greatest(least(m.value*3,1),0) as b, greatest(least(u.value*3,1),0) as t, l.value>0.1e0 as hit from cells m join cells u using (sample, iy, ix) join cells l using (sample, iy, ix)
          where m.channel='MASSDEN' and u.channel='UGRD' and l.channel='LABEL'), k as (select *, greatest(least(b+greatest(least(t-b,0.35e0),-0.35e0),1),0) as f from j)
        select sample, round(case when count(*) filter (b>=0.3e0 or hit)=0 then 1 else count(*) filter (b>=0.3e0 and hit)/count(*) filter (b>=0.3e0 or hit) end,6) as baseline_iou,
        round(case when count(*) filter (f>=0.3e0 or hit)=0 then 1 else count(*) filter (f>=0.3e0 and hit)/count(*) filter (f>=0.3e0 or hit) end,6) as constrained_iou,
        round(sum(power(b-t,2))/max(h*8),6) as baseline_mse, round(sum(power(f-t,2))/max(h*8),6) as constrained_mse from k, shape group by 1""".replace(", j as", "JJ as", 1),
    ).replace("\nJJ as", ", j as"),
)
def residual_scores(spark, sf):
    unit = F.greatest(F.least(F.col("value") * 3, F.lit(1.0)), F.lit(0.0))
    whole = channel(spark, sf, "LABEL").select("sample").distinct()
    base = channel(spark, sf, "MASSDEN").withColumn("value", unit).join(whole, "sample", "left_semi")
    smooth = channel(spark, sf, "UGRD").withColumn("value", unit).join(whole, "sample", "left_semi")
    truth = channel(spark, sf, "LABEL").filter("value > 0.1")
    h, w = shape(spark, sf)
    return t.rounded(grids.residual_scores(base, smooth, truth, ["sample"], F.lit(h * w), 0.35))


@query(
    "label_alignment",
    "H13",
    t.with_tables(
        "fields",
        """select a.variable, a.run_time, l as lead_hours, round(avg(power(a.value-b.value,2)),6) as mse, count(*) as cells from fields a, (select cast(unnest([12,24]) as integer) as l) join fields b
        on b.variable=a.variable and b.iy=a.iy and b.ix=a.ix and b.run_time=a.run_time+to_hours(l) group by 1,2,3""",
    ),
)
def label_alignment(spark, sf):
    pairs = samples.label_alignment(fields(spark, sf), (12, 24))
    out = pairs.groupBy("variable", "run_time", "lead_hours").agg(
        F.avg(F.pow(F.col("value") - F.col("label"), F.lit(2.0))).alias("mse"), F.count("*").alias("cells")
    )
    return t.rounded(out)


@query(
    "frame_statistics",
    "E32",
    t.with_tables(
        "fields",
        """select run_time, count(*) as cells, round(avg(value),6) as mean_value, max(value) as max_value, round(quantile_cont(value,0.99),6) as p99_value
        from fields where variable='MASSDEN' and iy%2=0 and ix%2=0 and value>0 group by 1""",
    ),
)
def frame_statistics(spark, sf):
    field = grids.read_field(fields(spark, sf), None, "MASSDEN", "8m_above_ground")
    return t.rounded(grids.frame_statistics(field, 2, (-180.0, -80.0, 180.0, 80.0)))


@query(
    "display_range",
    "E32",
    t.with_tables(
        "fields",
        """select round(quantile_cont(value,0.2),6) as vmin, round(quantile_cont(value,0.9995),6) as vmax from fields where variable='MASSDEN' and iy%2=0 and ix%2=0 and value>0""",
    ),
)
def display_range(spark, sf):
    field = grids.read_field(fields(spark, sf), None, "MASSDEN", "8m_above_ground")
    return t.rounded(grids.display_range(field, 2, (-180.0, -80.0, 180.0, 80.0)))


# ---- sample sets -----------------------------------------------------------------------------


def model_fields(spark, sf):
    """The two fields plus two wind components on the same grid and hours."""
    base = fields(spark, sf)
    mass = base.filter("variable = 'MASSDEN'").withColumn("value", F.coalesce("value", F.lit(1.0)))
    h = "cast(unix_seconds(run_time)/3600 as bigint)"
    parts = [mass]
    for name, expr in (("UGRD", f"cast((ix+{h})%7-3 as double)/9"), ("VGRD", f"cast((iy+2*{h})%5-2 as double)/9")):
        parts.append(mass.withColumn("variable", F.lit(name)).withColumn("level", F.lit("10m_above_ground")).withColumn("value", F.expr(expr)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def settings(hours) -> SampleSettings:
    splits = SplitDates(dt.date(2024, 1, 1), dt.date(2024, 1, 14), dt.date(2024, 1, 15), dt.date(2024, 1, 20), dt.date(2024, 1, 21), dt.date(2024, 1, 31))
    return SampleSettings(
        run_start=t.RUN_START, run_end=t.RUN_END, splits=splits, grid=G, channels=CHANNELS[:3], label=CHANNELS[0], patch=(4, 4), leads=(12, 24),
        buffer_km=BUFFER, sample_hours=hours,
    )


@query("hourly_samples", "J5 D24 D25 F15 B39 B20 E29 H1 H13")
def hourly_samples(spark, sf):
    out = samples.build_samples(timed_incidents(spark, sf), model_fields(spark, sf), t.detections(spark, sf), settings(tuple(range(24))))
    return out.index.drop("incident_name", "state")


@query("daily_samples", "J6 D24 D25 F16 B39 H5 E29")
def daily_samples(spark, sf):
    out = samples.build_samples(timed_incidents(spark, sf), model_fields(spark, sf), t.detections(spark, sf), settings((0, 12)), daily=True)
    return out.index.drop("incident_name", "state")


t.define(
    "tasks",
    """select incident_id, day, incident_id||'|daily|'||strftime(day,'%Y-%m-%d')||'|0,12' as sample_key from (select incident_id, start_date+cast(unnest(range(end_date-start_date+1)) as integer) as day from incidents) where day<=date '2024-01-30'""",
    ["incidents"],
)


@query(
    "pending_tasks",
    "D24",
    t.with_tables("tasks", "select sample_key from tasks where (incident_id*7+(day-date '2024-01-01'))%3<>0"),
)
def pending_tasks(spark, sf):
    from plumeframe.functions.scalars import sample_key_daily

    rows = temporal.incident_days(t.incidents(spark, sf), t.RUN_START, t.RUN_END, True)
    rows = rows.withColumn("sample_key", sample_key_daily("incident_id", "day", (0, 12)))
    done = rows.filter("(incident_id*7+datediff(day, date'2024-01-01'))%3=0").select("sample_key")
    return samples.skip_done(rows, done).select("sample_key")


@query(
    "complete_tasks",
    "D25",
    t.with_tables(
        "tasks fields",
        """, have as (select distinct run_time, variable from fields), need as (select sample_key, cast(day as timestamp)+to_hours(h) as run_time, 'COLMD' as variable from tasks, (select unnest([0,12,24,36]) as h))
        select sample_key from need left join (select *, 1 as ok from have) using (run_time, variable) group by 1 having count(ok)=4""".replace(", have as", "HV as", 1),
    ).replace("\nHV as", ", have as"),
)
def complete_tasks(spark, sf):
    from plumeframe.functions.scalars import sample_key_daily

    rows = temporal.incident_days(t.incidents(spark, sf), t.RUN_START, t.RUN_END, True)
    rows = rows.withColumn("sample_key", sample_key_daily("incident_id", "day", (0, 12)))
    needed = rows.withColumn("_h", F.explode(F.array(*[F.lit(h) for h in (0, 12, 24, 36)]))).select(
        "sample_key", F.timestamp_seconds(F.unix_date("day").cast("bigint") * 86400 + F.col("_h") * 3600).alias("run_time"),
        F.lit("COLMD").alias("variable"), F.lit("entire_atmosphere").alias("level"),
    )
    return samples.complete_tasks(rows, needed, written_catalog(spark, sf)).select("sample_key")


# ---- case searches ---------------------------------------------------------------------------

@query(
    "small_growth_pairs",
    "F25 J17",
    t.with_tables(
        "detections boxes",
        f""", dc as (select incident_id, day, count(*) as c from (select b.incident_id, d.acq_day as day from (select *, {_DX} as x, {_DY} as y from detections where hour(acq_ts) in (0,1,2,3,6,7,8,9,12,13,14,15,18,19,20,21)) d join
          (select *, xmin+270000 as bx0, ymin+270000 as by0, xmax-270000 as bx1, ymax-270000 as by1 from boxes) b on d.x between bx0 and bx1 and d.y between by0 and by1 and d.acq_day between start_date and end_date+1) group by 1,2)
        select a.incident_id, a.day, a.c as today_count, b.c as next_count, round((b.c-a.c)/a.c,6) as growth_ratio, round(abs((b.c-a.c)/a.c-0.15e0)+0.0004e0*(a.c+b.c),6) as score
        from dc a join dc b on b.incident_id=a.incident_id and b.day=a.day+1 where a.c>=2 and b.c>=2 and b.c>a.c and (b.c-a.c)/a.c<=0.9 order by abs((b.c-a.c)/a.c-0.15e0)+0.0004e0*(a.c+b.c), 1, 2 limit 1""".replace(", dc as", "DC as", 1),
    ).replace("\nDC as", ", dc as"),
)
def small_growth_pairs(spark, sf):
    hours = (0, 1, 2, 3, 6, 7, 8, 9, 12, 13, 14, 15, 18, 19, 20, 21)
    out = reports.small_growth_case(box_points(spark, sf, 1, hours), hours, 2, 0.9)
    return t.rounded(out)


@query(
    "late_stage_examples",
    "F24 J17",
    t.with_tables(
        "boxpoints",
        """, d as (select incident_id, day, start_date, end_date, size_acres, sum(frp) as f, count(*) as c, end_date-start_date+1 as n from boxpoints group by all), p as (select *, max(f) over (partition by incident_id) as peak from d),
        k as (select *, f/peak as rel, abs(f/peak-0.10e0)+0.75e0*(end_date-day)/greatest(n-1,1)-0.000004e0*size_acres as score from p where (day-start_date) between floor((n-1)*0.7e0) and floor((n-1)*0.98e0) and c>=1 and f/peak<=0.6 and n>=4)
        select incident_id, day as anchor_day, round(rel,6) as rel_peak, round(score,6) as score, greatest(day-4, start_date) as window_start from (select *, row_number() over (partition by incident_id order by score, day) as rn from k) where rn=1 order by score, incident_id limit 5""".replace(
            ", d as", "D0 as", 1
        ),
    ).replace("\nD0 as", ", d as"),
)
def late_stage_examples(spark, sf):
    from plumeframe.operators.incidents import eligible_incidents

    fires = eligible_incidents(t.incidents(spark, sf), min_days=4)
    pairs = box_points(spark, sf).join(fires.select("incident_id"), "incident_id", "left_semi").drop("size_acres", "start_date", "end_date")
    out = reports.late_stage_examples(pairs, fires, min_daily=1, max_rel=0.6, n=5)
    return t.rounded(out.select("incident_id", "anchor_day", "rel_peak", "score", "window_start"))


@query("smoothing_case_scores", "J17 H8 H9 H11")
def smoothing_case_scores(spark, sf):
    hours = tuple(range(24))
    out = reports.smoothing_case_report(
        t.detections(spark, sf), t.incidents(spark, sf), sample_hours=hours, pixel_m=5000.0, min_daily=1, max_growth=5.0
    )
    return out["scores"]
