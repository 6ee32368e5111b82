"""Queries for granule matching, slots and the two-sensor timeline."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumeframe.catalog import tables as t
from plumeframe.catalog.overpass import cloud_granules, cloud_pixels
from plumeframe.catalog.registry import query
from plumeframe.functions import scalars as s
from plumeframe.operators import grids, overpass, spatial, temporal

START = "2024-01-01"


def granules(spark, sf):
    """Imager granules from orders: start on whole minutes, a channel, a product, a stem, a size."""
    return t.read(spark, sf, "orders").selectExpr(
        "concat('G', o_orderkey) as granule_key",
        f"timestamp_seconds(unix_seconds(timestamp'{START} 00:00:00') + ((o_orderkey*37)%44640)*60) as start_ts",
        "concat('0', o_orderkey%4 + 1) as channel", "concat('P', o_orderkey%3) as product", "concat('S', o_custkey) as stem",
        "cast(o_totalprice as bigint) as size_bytes", "o_orderkey", "o_custkey",
    )


t.define(
    "granules",
    f"""select 'G'||o_orderkey as granule_key, timestamp '{START}' + to_minutes((o_orderkey*37)%44640) as start_ts, '0'||(o_orderkey%4+1) as channel, 'P'||(o_orderkey%3) as product,
  'S'||o_custkey as stem, cast(floor(o_totalprice) as bigint) as size_bytes, o_orderkey, o_custkey from orders""",
)
# Targets: the two overpass times of every incident's first day, and the same rounded to 15 minutes.
t.define(
    "targets",
    """select incident_id, slot, make_timestamp(cast(epoch_us(cast(start_date as timestamp)) + round_even(h*3600000000,0) as bigint)) as t
  from (select incident_id, start_date, unnest(['day','night']) as slot, unnest([(13.5e0-cx/15+240)%24, (1.5e0-cx/15+240)%24]) as h from incidents)""",
    ["incidents"],
)
_ROUNDED = "make_timestamp(cast(floor((floor(epoch_us(t)/1000000)+450)/900)*900*1000000 as bigint))"


def targets(spark, sf):
    day, night = s.overpass_hours((F.col("min_lon") + F.col("max_lon")) / 2)
    entries = F.array(
        F.struct(F.lit("day").alias("slot"), s.day_plus_hours("start_date", day).alias("t")),
        F.struct(F.lit("night").alias("slot"), s.day_plus_hours("start_date", night).alias("t")),
    )
    return t.incidents(spark, sf).select("incident_id", F.inline(entries))


def nearest_sql(minutes: int, later: bool, where: str = "true") -> str:
    tie = "start_ts desc" if later else "start_ts"
    return f"""select t, granule_key, d from (select t, granule_key, abs(epoch_us(start_ts)-epoch_us(t))/60000000 as d,
      row_number() over (partition by t order by abs(epoch_us(start_ts)-epoch_us(t)), {tie}, granule_key) as rn
      from (select distinct t from wanted where {where}) join granules on start_ts between t - interval {minutes} minute and t + interval {minutes} minute) where rn=1"""


for _name, _minutes, _later, _round in [
    ("nearest_granules", 45, False, False),
    ("nearest_granules_rounded", 50, False, True),
    ("nearest_granules_late_ties", 25, True, True),
]:

    def _nearest(spark, sf, minutes=_minutes, later=_later, rounded=_round):
        rows = targets(spark, sf)
        if rounded:
            rows = rows.withColumn("t", s.round_to_step("t"))
        out = temporal.nearest_granule(rows, granules(spark, sf), "t", minutes, later)
        return t.rounded(out.select("incident_id", "slot", "t", "granule_key", "time_diff_min"))

    _t = _ROUNDED if _round else "t"
    query(
        _name,
        "D12" + (" B33" if _round else " B32"),
        t.with_tables(
            "targets granules",
            f""", wanted as (select incident_id, slot, {_t} as t from targets)
            select incident_id, slot, t, granule_key, round(d,6) as time_diff_min from wanted left join ({nearest_sql(_minutes, _later)}) using (t)""".replace(
                ", wanted as", "WW as", 1
            ),
        ).replace("\nWW as", ", wanted as"),
    )(_nearest)


@query(
    "nearest_granules_from_date",
    "D12",
    t.with_tables(
        "targets granules",
        f""", wanted as (select * from targets) select incident_id, slot, granule_key from wanted left join ({nearest_sql(50, False, "t >= timestamp '2024-01-12'")}) using (t)""".replace(
            ", wanted as", "WW as", 1
        ),
    ).replace("\nWW as", ", wanted as"),
)
def nearest_granules_from_date(spark, sf):
    out = temporal.nearest_granule(targets(spark, sf), granules(spark, sf), "t", 50, not_before=dt.datetime(2024, 1, 12))
    return out.select("incident_id", "slot", "granule_key")


@query(
    "granules_between",
    "C15",
    t.with_tables(
        "granules",
        "select granule_key, min(start_ts) as start_ts from granules where start_ts between timestamp '2024-01-03 06:00:00' and timestamp '2024-01-20 12:30:00' group by 1",
    ),
)
def granules_between(spark, sf):
    out = temporal.granules_between(granules(spark, sf), dt.datetime(2024, 1, 3, 6), dt.datetime(2024, 1, 20, 12, 30))
    return t.plain_times(out)


@query(
    "channel_triplets",
    "D15",
    t.with_tables(
        "granules",
        """select date_trunc('hour', start_ts) as slot_ts, max(granule_key) filter (channel='01') as key_01, max(granule_key) filter (channel='02') as key_02,
        max(granule_key) filter (channel='03') as key_03 from granules group by 1 having key_01 is not null and key_02 is not null and key_03 is not null""",
    ),
)
def channel_triplets(spark, sf):
    rows = granules(spark, sf).withColumn("slot_ts", F.date_trunc("hour", "start_ts"))
    return t.plain_times(temporal.channel_sets(rows, ["01", "02", "03"], "slot_ts"))


@query(
    "granule_families",
    "D16",
    t.with_tables(
        "granules",
        """select *, abs(cast(epoch(start_ts)-epoch(timestamp '2024-01-15 12:00:00') as bigint)) as diff_sec from (select stem, max(granule_key) filter (product='P0') as key_P0, max(granule_key) filter (product='P1') as key_P1,
        max(granule_key) filter (product='P2') as key_P2, timestamp '2024-01-01' + to_minutes((o_custkey*91)%43200) as start_ts from granules where size_bytes>=40000 group by stem, o_custkey)
        where key_P0 is not null and key_P1 is not null and key_P2 is not null and abs(epoch(start_ts)-epoch(timestamp '2024-01-15 12:00:00'))<=200*3600""",
    ),
)
def granule_families(spark, sf):
    rows = granules(spark, sf).withColumn(
        "start_ts", F.timestamp_seconds(F.unix_seconds(F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")) + (F.col("o_custkey") * 91) % 43200 * 60)
    )
    out = temporal.granule_families(rows, ["P0", "P1", "P2"], dt.datetime(2024, 1, 15, 12), 200, 40000)
    return t.plain_times(out)


# ---- slots and timeline ----------------------------------------------------------------------

HOLD, SLOTS = 12, 60
T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 30, 23, 59)


@query(
    "scheduled_granules",
    "F21 D12",
    t.with_tables(
        "granules",
        f""", cnt as (select cast(floor(epoch(mx-mn)/600) as bigint)+1 as c, mn from (select cast(cast(min(start_ts) as date) as timestamp) as mn, max(start_ts) as mx from granules)),
        f as (select cast(range as integer) as frame, mn + to_minutes(10*case when frame=499 then c-1 else cast(floor(range*((c-1)/499::double)) as bigint) end) as frame_ts from range(500), cnt),
        wanted as (select frame, frame_ts as t from f) select frame, t as frame_ts, granule_key from wanted left join ({nearest_sql(25, True)}) using (t)""".replace(", cnt as", "CN as", 1),
    ).replace("\nCN as", ", cnt as"),
)
def scheduled_granules(spark, sf):
    source = granules(spark, sf)
    span = source.agg(F.to_date(F.min("start_ts")).alias("lo"), F.max("start_ts").alias("hi")).first()
    first = dt.datetime.combine(span["lo"], dt.time())
    frames = temporal.schedule(spark, first, span["hi"], 10, 500)
    out = temporal.nearest_granule(frames, source, "frame_ts", 25, later_wins=True)
    return t.plain_times(out.select("frame", "frame_ts", "granule_key"))


_SLOT = f"cast(least(greatest(floor((epoch_us(acq_ts)-epoch_us(timestamp '2024-01-01'))/1000000/{HOLD * 3600}),0),{SLOTS - 1}) as integer)"
t.define("slotted", f"select {_SLOT} as slot, cast(floor(lon) as integer) as gx, cast(floor(lat) as integer) as gy, acq_ts, daynight from detections", ["detections"])


def slotted(spark, sf):
    slot = temporal.slot_of(F.col("acq_ts"), T0, HOLD, SLOTS)
    return t.detections(spark, sf).select(
        slot.alias("slot"), F.floor("lon").cast("int").alias("gx"), F.floor("lat").cast("int").alias("gy")
    )


@query(
    "slot_growth",
    "F20 J18",
    t.with_tables(
        "slotted",
        f"""select slot, coalesce(cells,0) as cells, cast(sum(coalesce(fresh,0)) over (order by slot) as bigint) as cells_so_far
        from (select cast(range as integer) as slot from range({SLOTS})) left join (select slot, count(distinct (gx,gy)) as cells from slotted group by 1) using (slot)
        left join (select slot, count(*) as fresh from (select gx, gy, min(slot) as slot from slotted group by 1,2) group by 1) using (slot)""",
    ),
)
def slot_growth(spark, sf):
    return temporal.slot_growth(slotted(spark, sf), SLOTS)


@query(
    "carried_slots",
    "F22",
    t.with_tables(
        "slotted granules",
        f"""select slot, last_value(k ignore nulls) over (order by slot rows unbounded preceding) as granule_key from (select cast(range as integer) as slot from range({SLOTS}))
        left join (select cast(least(floor((epoch(start_ts)-epoch(timestamp '2024-01-01'))/{HOLD * 3600}),{SLOTS - 1}) as integer) as slot, max(granule_key) as k from granules where size_bytes>495000 and channel='01' group by 1) using (slot)""",
    ),
)
def carried_slots(spark, sf):
    found = (
        granules(spark, sf)
        .filter("size_bytes > 495000 and channel = '01'")
        .groupBy(temporal.slot_of(F.col("start_ts"), T0, HOLD, SLOTS).alias("slot"))
        .agg(F.max("granule_key").alias("granule_key"))
    )
    axis = spark.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    return temporal.carry_forward(axis.join(found, "slot", "left"), "granule_key")


@query(
    "slot_targets",
    "F23",
    t.with_tables(
        "slotted",
        f"""select slot, coalesce(mid, timestamp '2024-01-01' + (least(to_hours((slot+1)*{HOLD}), timestamp '2024-01-30 23:59:00'-timestamp '2024-01-01') + to_hours(slot*{HOLD}))/2) as target_ts
        from (select cast(range as integer) as slot from range({SLOTS})) left join (select slot, acq_ts as mid from (select slot, acq_ts, row_number() over (partition by slot order by acq_ts)-1 as i,
          count(*) over (partition by slot)//2 as m from slotted where daynight='D') where i=m) using (slot)""",
    ),
)
def slot_targets(spark, sf):
    return t.plain_times(temporal.slot_targets(t.detections(spark, sf), T0, T1, HOLD, SLOTS))


# ---- mask granules on a lattice --------------------------------------------------------------

AXIS = (-124.0, 0.05, 400, 48.0, -0.05, 320)  # x origin, step, size; y origin, step (falling), size


@query(
    "nearest_axis_cells",
    "D13 H14",
    t.with_tables(
        "detections",
        """select det_id, cast(least(greatest(floor((lon+124)/0.05e0+0.5e0),0),399) as integer) as ix, cast(least(greatest(ceil((lat-48)/-0.05e0-0.5e0),0),319) as integer) as iy from detections""",
    ),
)
def nearest_axis_cells(spark, sf):
    x0, dx, nx, y0, dy, ny = AXIS
    return t.detections(spark, sf).select(
        "det_id",
        grids.nearest_index_regular(F.col("lon"), x0, dx, nx).alias("ix"),
        grids.nearest_index_regular(F.col("lat"), y0, dy, ny).alias("iy"),
    )


@query(
    "nearest_irregular_axis",
    "D13",
    t.with_tables(
        "detections",
        """, ax as (select s_suppkey as axis_index, -124+power(s_suppkey,1.5e0)/50 as axis_value from supplier)
        select det_id, axis_index from (select det_id, axis_index, row_number() over (partition by det_id order by abs(lon-axis_value), axis_value desc) as rn from detections, ax) where rn=1""".replace(
            ", ax as", "AX as", 1
        ),
    ).replace("\nAX as", ", ax as"),
)
def nearest_irregular_axis(spark, sf):
    axis = t.read(spark, sf, "supplier").selectExpr("s_suppkey as axis_index", "-124+power(s_suppkey,1.5e0)/50 as axis_value")
    out = grids.nearest_index(t.detections(spark, sf).select("det_id", "lon"), "lon", axis)
    return out.select("det_id", "axis_index")


t.define(
    "mask_pixels",
    """select 'C'||cast(l_suppkey as varchar) as granule_key, cast(l_partkey%40 as integer) as ix, cast(l_orderkey%32 as integer) as iy, cast(max(l_partkey%40+l_linenumber) as integer) as mask,
  cast(min(l_linenumber%3) as integer) as quality from lineitem group by 1,2,3""",
)


def mask_pixels(spark, sf):
    return (
        t.read(spark, sf, "lineitem")
        .selectExpr(
            "concat('C', l_suppkey) as granule_key", "cast(l_partkey%40 as int) as ix", "cast(l_orderkey%32 as int) as iy",
            "cast(l_partkey%40+l_linenumber as int) as m", "l_linenumber%3 as q",
        )
        .groupBy("granule_key", "ix", "iy")
        .agg(F.max("m").cast("int").alias("mask"), F.min("q").cast("int").alias("quality"))
    )


_FIRE = "mask in (10,11,12,13,14,15,30,31,32,33,34,35) and quality<=1"
t.define(
    "lattice",
    """select cast(gx.range as integer) as gx, cast(gy.range as integer) as gy, cast(floor((gx.range*0.5e0)/0.5e0+0.5e0) as integer) as ix, cast(31-ceil(gy.range-0.5e0) as integer) as iy from range(40) gx, range(32) gy""",
)


def lattice(df):
    """Display lattice looked up on the granule axes; derived per granule table, no fixed input alone."""
    size = df.agg(F.max("ix").alias("nx"), F.max("iy").alias("ny"))
    cells = size.select(F.explode(F.sequence(F.lit(0), F.col("nx"))).alias("gx"), "ny").select(
        "gx", F.explode(F.sequence(F.lit(0), F.col("ny"))).alias("gy")
    )
    return cells.select(
        "gx", "gy",
        grids.nearest_index_regular(F.col("gx") * 0.5, 0.0, 0.5, 40).alias("ix"),
        grids.nearest_index_regular(F.col("gy").cast("double"), 31.0, -1.0, 32).alias("iy"),
    )


@query(
    "mask_on_lattice",
    "H14 C12",
    t.with_tables(
        "mask_pixels lattice",
        f"select granule_key, gx, gy from mask_pixels join lattice using (ix, iy) where {_FIRE}",
    ),
)
def mask_on_lattice(spark, sf):
    pixels = mask_pixels(spark, sf)
    out = grids.mask_on_lattice(pixels, lattice(pixels), ["granule_key"])
    return out.filter(s.is_fire_pixel("mask", "quality")).select("granule_key", "gx", "gy")


@query(
    "two_sensor_timeline",
    "J18 F20 D12 H14",
    t.with_tables(
        "mask_pixels lattice slotted cgranules",
        f""", fire as (select distinct granule_key, gx, gy from mask_pixels join lattice using (ix, iy) where {_FIRE}),
        frames as (select cast(range as integer) as slot, timestamp '2024-01-01' + to_hours(range*{HOLD}) as t from range({SLOTS})),
        near as (select slot, granule_key from (select slot, granule_key, row_number() over (partition by slot order by abs(epoch(start_ts)-epoch(t)), start_ts desc, granule_key) as rn,
          abs(epoch(start_ts)-epoch(t)) as d from frames, cgranules) where rn=1 and d<=400*60),
        seen as (select slot, gx, gy from near join fire using (granule_key)),
        imager as (select slot, count(distinct (gx,gy)) as c from seen group by 1), imager_new as (select slot, count(*) as c from (select gx, gy, min(slot) as slot from seen group by 1,2) group by 1),
        points as (select slot, count(distinct (gx,gy)) as c from slotted group by 1), points_new as (select slot, count(*) as c from (select gx, gy, min(slot) as slot from slotted group by 1,2) group by 1)
        select f.slot, coalesce(a.c,0) as imager_cells, cast(sum(coalesce(an.c,0)) over (order by f.slot) as bigint) as imager_cells_so_far, coalesce(b.c,0) as point_cells,
        cast(sum(coalesce(bn.c,0)) over (order by f.slot) as bigint) as point_cells_so_far from frames f left join imager a using (slot) left join imager_new an using (slot)
        left join points b using (slot) left join points_new bn using (slot)""".replace(", fire as", "FI as", 1),
    ).replace("\nFI as", ", fire as"),
)
def two_sensor_timeline(spark, sf):
    from plumeframe.plans.reports import two_sensor_timeline as timeline

    pixels = mask_pixels(spark, sf)
    frames = spark.range(SLOTS).select(
        F.col("id").cast("int").alias("slot"),
        F.timestamp_seconds(F.unix_seconds(F.lit(T0).cast("timestamp")) + F.col("id") * HOLD * 3600).alias("frame_ts"),
    )
    return timeline(frames, cloud_granules(spark, sf), pixels, lattice(pixels), slotted(spark, sf), SLOTS, 400)


# ---- cloud panel -----------------------------------------------------------------------------

t.define(
    "panel_targets",
    f"""select incident_id, day, slot, {_ROUNDED} as t from (select incident_id, day, slot, make_timestamp(cast(epoch_us(cast(day as timestamp)) + round_even(h*3600000000,0) as bigint)) as t
  from (select incident_id, day, unnest(['day','night']) as slot, unnest([(13.5e0-cx/15+240)%24, (1.5e0-cx/15+240)%24]) as h
  from (select incident_id, cx, start_date+cast(unnest(range(end_date-start_date+1)) as integer) as day from incidents)))""",
    ["incidents"],
)


@query(
    "panel_cloud_fractions",
    "D28 E24 E25 J12 B32 B33 D12",
    t.with_tables(
        "panel_targets cgranules cpixels incidents",
        """, near as (select t, granule_key from (select t, granule_key, row_number() over (partition by t order by abs(epoch(start_ts)-epoch(t)), start_ts, granule_key) as rn,
          abs(epoch(start_ts)-epoch(t)) as d from (select distinct t from panel_targets), cgranules) where rn=1 and d<=300*60),
        m as (select * from panel_targets left join near using (t)),
        fr as (select r.granule_key, r.incident_id, avg(cloud::int) as frac from (select distinct granule_key, incident_id from m where granule_key is not null) r join incidents i using (incident_id)
          left join cpixels p on p.granule_key=r.granule_key and lon between min_lon and max_lon and lat between min_lat and max_lat
          and ((is_diamond and abs(lon-cx)+abs(lat-cy) < hs) or (not is_diamond and abs(lon-cx) < hs and abs(lat-cy) < hs)) group by 1,2),
        w as (select incident_id, day, max(frac) filter (slot='day') as d, max(frac) filter (slot='night') as n from m left join fr using (granule_key, incident_id) group by 1,2)
        select incident_id, day, round(d,6) as cloud_day_frac, round(n,6) as cloud_night_frac, round(case when d is not null and n is not null then (d+n)/2 else coalesce(d,n) end,6) as cloud_mean_frac,
        round(greatest(d,n),6) as cloud_max_frac, cast(coalesce(d>=0.5 and n>=0.5,false) as integer) as both_overpasses_cloudy_50pct from w""".replace(", near as", "NN as", 1),
    ).replace("\nNN as", ", near as"),
)
def panel_cloud_fractions(spark, sf):
    from plumeframe.plans.reports import panel_clouds

    incidents = t.incidents(spark, sf)
    panel = incidents.select(
        "incident_id", ((F.col("min_lon") + F.col("max_lon")) / 2).alias("centroid_lon"), F.explode(F.sequence("start_date", "end_date")).alias("day")
    )
    out = panel_clouds(panel, incidents, cloud_granules(spark, sf), cloud_pixels(spark, sf), 300.0, round_minutes=15)
    names = ["cloud_day_frac", "cloud_night_frac", "cloud_mean_frac", "cloud_max_frac", "both_overpasses_cloudy_50pct"]
    return t.rounded(out.select("incident_id", "day", *names))


POINTS, POINT_CELL, LINES = 12, 0.0237, 64


@query(
    "points_in_perimeter_cells",
    "H15 D13",
    t.with_tables(
        "incidents",
        f""", line as (select *, cy-hs+(k+0.5e0)*(2*hs/{LINES}) as y, 2*hs/{LINES} as step from incidents cross join (select unnest(range({LINES})) as k)),
        span as (select *, case when is_diamond then hs-abs(y-cy) else hs end as half from line),
        sums as (select incident_id, k, y, cx-half as x0, cx+half as x1, 2*half*step as share, sum(2*half*step) over (partition by incident_id order by k) as upto, sum(2*half*step) over (partition by incident_id) as total from span),
        held as (select *, coalesce(lag(upto) over w, 0) as begin_, case when lead(upto) over w is null then 'infinity'::double else upto end as end_ from sums window w as (partition by incident_id order by k)),
        pick as (select incident_id, i, cast(('0x' || substr(md5(concat(incident_id, '|', i)), 1, 8)) as bigint)/4294967296e0 as u from incidents cross join (select unnest(range(1, {POINTS})) as i)),
        pts as (select incident_id, cx as lon, cy as lat from incidents union all select h.incident_id, x0+least(greatest((u*total-begin_)/share, 1e-6), 1-1e-6)*(x1-x0), y
          from held h join pick p on p.incident_id=h.incident_id and u*total>=begin_ and u*total<end_)
        select distinct incident_id, cast(floor(lon/{POINT_CELL}) as integer) as ix, cast(floor(lat/{POINT_CELL}) as integer) as iy from pts""",
    ).replace("\n, line as", ", line as"),
)
def points_in_perimeter_cells(spark, sf):
    return spatial.cells_of_points_inside(t.incidents(spark, sf), POINTS, POINT_CELL, LINES)


@query(
    "cloud_requests",
    "D28 G2",
    t.with_tables(
        "targets granules",
        f""", wanted as (select * from targets), m as (select * from wanted join ({nearest_sql(45, False)}) using (t)) select distinct granule_key, incident_id from m""".replace(
            ", wanted as", "WW as", 1
        ),
    ).replace("\nWW as", ", wanted as"),
)
def cloud_requests(spark, sf):
    rows = temporal.nearest_granule(targets(spark, sf), granules(spark, sf), "t", 45)
    wide = rows.groupBy("incident_id").agg(
        F.max(F.when(F.col("slot") == "day", F.col("granule_key"))).alias("day_key"),
        F.max(F.when(F.col("slot") == "night", F.col("granule_key"))).alias("night_key"),
    )
    return overpass.request_set(wide, ["day_key", "night_key"]).select("granule_key", "incident_id")
