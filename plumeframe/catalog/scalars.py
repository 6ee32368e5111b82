"""Queries for scalar columns, predicates and incident rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumeframe.catalog import tables as t
from plumeframe.catalog.registry import query
from plumeframe.config import SplitDates
from plumeframe.functions import geo
from plumeframe.functions import scalars as s
from plumeframe.operators import incidents as inc


@query("parse_mixed_date", "B1", "select o_orderkey, cast(o_orderdate as date) as day from orders")
def parse_mixed_date(spark, sf):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
        F.concat(F.lit(' "'), F.date_format("o_orderdate", "M/d/yyyy"), F.lit('"'))
    )
    return t.read(spark, sf, "orders").select("o_orderkey", s.parse_mixed_date(text).alias("day"))


def _time_texts():
    k, ts = F.col("event_id"), F.col("ts")
    rfc = F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    us12 = F.date_format(ts, "M/d/yyyy h:mm:ss a")
    us24 = F.date_format(ts, "MM/dd/yyyy HH:mm:ss")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(k % 5 == 0, rfc).when(k % 5 == 1, us12).when(k % 5 == 2, us24).when(k % 5 == 3, iso)


@query(
    "parse_datetime_strict",
    "B2",
    "select event_id, case when event_id%5<>4 then date_trunc('second', ts) end as ts from events",
)
def parse_datetime_strict(spark, sf):
    text = F.coalesce(_time_texts(), F.lit("  "))
    return t.plain_times(t.read(spark, sf, "events").select("event_id", s.parse_datetime(text).alias("ts")))


@query(
    "parse_datetime_lenient",
    "B3",
    "select event_id, case when event_id%5<>4 then date_trunc('second', ts) end as ts from events",
)
def parse_datetime_lenient(spark, sf):
    text = F.coalesce(_time_texts(), F.lit("not a time"))
    return t.plain_times(t.read(spark, sf, "events").select("event_id", s.parse_datetime(text, strict=False).alias("ts")))


@query(
    "season_of_day",
    "B4",
    """select o_orderkey, case when month(o_orderdate) in (12,1,2) then 'winter' when month(o_orderdate) in (3,4,5) then 'spring'
    when month(o_orderdate) in (6,7,8) then 'summer' else 'fall' end as season from orders""",
)
def season_of_day(spark, sf):
    return t.read(spark, sf, "orders").select("o_orderkey", s.season("o_orderdate").alias("season"))


STATE_OF_KEY = "case k%6 when 0 then 'Oregon' when 1 then 'Texas' when 2 then 'New York' when 3 then 'Ohio' when 4 then 'Atlantis' end"


@query(
    "epa_region",
    "B5",
    f"""select k, case {STATE_OF_KEY} when 'Oregon' then 'EPA-10' when 'Texas' then 'EPA-6' when 'New York' then 'EPA-2'
    when 'Ohio' then 'EPA-5' else 'EPA-unknown' end as region from (select c_custkey as k from customer)""",
)
def epa_region(spark, sf):
    keys = t.read(spark, sf, "customer").selectExpr("c_custkey as k")
    return keys.select("k", s.epa_region(F.expr(STATE_OF_KEY)).alias("region"))


@query(
    "station_key",
    "B6",
    """select p_partkey, lpad(cast(p_partkey%60 as varchar),2,'0')||'-'||lpad(cast(p_partkey%200 as varchar),3,'0')||'-'||
    case when p_partkey<10000 then lpad(cast(p_partkey as varchar),4,'0') else cast(p_partkey as varchar) end as station_id from part""",
)
def station_key(spark, sf):
    quoted = [F.concat(F.lit(' "'), (F.col("p_partkey") % m).cast("string"), F.lit('" ')) for m in (60, 200)]
    site = F.col("p_partkey").cast("string")
    return t.read(spark, sf, "part").select("p_partkey", s.station_key(*quoted, site).alias("station_id"))


@query(
    "number_with_separators",
    "B7",
    "select o_orderkey, case when o_orderkey%7=0 then null else round(o_totalprice,2) end as value from orders",
)
def number_with_separators(spark, sf):
    text = F.when(F.col("o_orderkey") % 14 == 0, "n/a").when(F.col("o_orderkey") % 7 == 0, "nan")
    text = F.coalesce(text, F.concat(F.lit(" "), F.format_number("o_totalprice", 2)))
    return t.read(spark, sf, "orders").select("o_orderkey", s.number_from_text(text).alias("value"))


@query(
    "select_required_columns",
    "B8 L1",
    "select l_orderkey as record, l_suppkey as station, l_extendedprice as mean from lineitem",
)
def select_required_columns(spark, sf):
    from plumeframe.operators.observations import rename_required

    names = {"l_orderkey": "record", "l_suppkey": "station", "l_extendedprice": "mean"}
    return rename_required(t.read(spark, sf, "lineitem"), names)


@query(
    "incident_size_choice",
    "B9",
    """select c_custkey, case when c_acctbal>0 then c_acctbal when c_custkey%3>0 then cast(c_custkey%3 as double) end as strict_size,
    case when c_acctbal>0 then c_acctbal else cast(c_custkey%3 as double) end as analytic_size from customer""",
)
def incident_size_choice(spark, sf):
    primary, fallback = F.col("c_acctbal"), (F.col("c_custkey") % 3).cast("double")
    return t.read(spark, sf, "customer").select(
        "c_custkey",
        s.incident_size(primary, fallback).alias("strict_size"),
        s.incident_size(primary, fallback, False).alias("analytic_size"),
    )


def _stamp(ts):
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))


@query(
    "incident_end_choice",
    "B10",
    """select o_orderkey, case o_orderkey%5 when 0 then o_orderdate when 1 then o_orderdate + interval 1 day
    when 2 then o_orderdate + interval 2 day when 3 then o_orderdate + interval 3 day end as end_ts from orders""",
)
def incident_end_choice(spark, sf):
    k = F.col("o_orderkey") % 5
    fields = [F.when(k <= i, _stamp(F.col("o_orderdate") + F.expr(f"interval {i} day"))) for i in range(4)]
    fields = [F.when(k == i, f) if i < 3 else F.when(k == 3, f) for i, f in enumerate(fields)]
    out = t.read(spark, sf, "orders").select("o_orderkey", inc.incident_end(fields, strict=True).alias("end_ts"))
    return t.plain_times(out)


@query(
    "incident_id_choice",
    "B11 B12",
    """select c_custkey, case c_custkey%4 when 0 then 'U'||c_custkey when 1 then 'P'||c_custkey when 2 then 'L'||c_custkey end as id,
    case when c_custkey%3=0 then 'Unknown' else c_mktsegment end as cause from customer""",
)
def incident_id_choice(spark, sf):
    k = F.col("c_custkey")
    texts = [
        F.when(k % 4 == 0, F.concat(F.lit(" U"), k)).otherwise("  "),
        F.when(k % 4 == 1, F.concat(F.lit("P"), k)),
        F.when(k % 4 == 2, F.concat(F.lit("L"), k, F.lit(" "))).otherwise(""),
    ]
    cause = F.when(k % 6 == 0, " ").when(k % 3 != 0, F.concat(F.col("c_mktsegment"), F.lit(" ")))
    return t.read(spark, sf, "customer").select(
        "c_custkey", s.first_nonblank(*texts).alias("id"), s.clean_text(cause).alias("cause")
    )


@query(
    "normalized_names",
    "B13 B14",
    """select c_custkey, lower(replace(c_name,'#','-')) as irwin_id,
    trim(regexp_replace(lower(c_name||' / '||c_mktsegment),'[^a-z0-9]+',' ','g')) as name from customer""",
)
def normalized_names(spark, sf):
    wrapped = F.concat(F.lit(" {"), F.regexp_replace("c_name", "#", "-"), F.lit("} "))
    both = F.concat_ws(" / ", "c_name", "c_mktsegment")
    return t.read(spark, sf, "customer").select(
        "c_custkey", s.normalize_id(wrapped).alias("irwin_id"), s.normalize_name(both).alias("name")
    )


@query(
    "trailing_date_of_id",
    "B15",
    "select o_orderkey, case when o_orderkey%3<>0 then cast(o_orderdate as date) end as day from orders",
)
def trailing_date_of_id(spark, sf):
    digits = F.when(F.col("o_orderkey") % 3 == 0, "20219931").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    text = F.concat(F.col("o_orderkey").cast("string"), F.lit("_"), digits)
    return t.read(spark, sf, "orders").select("o_orderkey", s.trailing_date(text).alias("day"))


@query(
    "confidence_classes",
    "B16 B17 B18",
    """select event_id, case event_type when 'error' then 'l' when 'click' then 'n' when 'view' then 'n' when 'signup' then 'h'
    else case when event_id%100>=80 then 'h' when event_id%100>=30 then 'n' else 'l' end end as mixed,
    case event_type when 'error' then 'l' when 'click' then 'n' when 'view' then 'n' when 'signup' then 'h' else 'u' end as letters,
    case when event_id%2=0 then 'D' else 'N' end as daynight from events""",
)
def confidence_classes(spark, sf):
    text = F.expr(
        "case event_type when 'error' then ' Low' when 'click' then 'nominal' when 'view' then 'N' when 'signup' then 'HIGH'"
        " else cast(event_id%100 as string) end"
    )
    flag = F.when(F.col("event_id") % 2 == 0, " day").otherwise("night")
    return t.read(spark, sf, "events").select(
        "event_id",
        s.confidence_class(text).alias("mixed"),
        s.confidence_class(text, numeric=False).alias("letters"),
        s.day_night(flag).alias("daynight"),
    )


@query(
    "size_buckets",
    "B19",
    """select p_partkey, b as bucket, cast(case b when '1k-5k' then 0 when '5k-20k' then 1 when '20k-100k' then 2 else 3 end as integer) as bucket_order
    from (select p_partkey, case when p_retailprice*40<5000 then '1k-5k' when p_retailprice*40<20000 then '5k-20k'
    when p_retailprice*40<100000 then '20k-100k' else '100k+' end as b from (select p_partkey, p_retailprice*(p_partkey%90) as p_retailprice from part))""",
)
def size_buckets(spark, sf):
    acres = F.col("p_retailprice") * (F.col("p_partkey") % 90) * 40
    bucket = s.size_bucket(acres)
    return t.read(spark, sf, "part").select(
        "p_partkey", bucket.alias("bucket"), s.size_bucket_order(bucket).alias("bucket_order")
    )


SPLITS = SplitDates(
    dt.date(1995, 1, 1), dt.date(1998, 12, 31), dt.date(1999, 1, 1), dt.date(1999, 12, 31), dt.date(2000, 3, 1),
    dt.date(2000, 12, 31),
)


@query(
    "date_splits",
    "B20",
    """select o_orderkey, case when cast(o_orderdate as date) between date '1995-01-01' and date '1998-12-31' then 'train'
    when cast(o_orderdate as date) between date '1999-01-01' and date '1999-12-31' then 'val'
    when cast(o_orderdate as date) between date '2000-03-01' and date '2000-12-31' then 'test' else 'outside' end as split from orders""",
)
def date_splits(spark, sf):
    day = F.to_date("o_orderdate")
    return t.read(spark, sf, "orders").select("o_orderkey", s.date_split(day, SPLITS).alias("split"))


@query(
    "acquisition_times",
    "B21",
    """select event_id, case when event_id%11<>0 then date_trunc('minute', ts) end as acq_ts,
    case when event_id%11<>0 then cast(date_trunc('hour', ts) as timestamp) end as hour_utc,
    case when event_id%11<>0 then cast(epoch_us(ts)//60000000 as bigint) end as minute_int,
    cast(cast(ts as date)-date '1970-01-01' as integer) as day_int from events""",
)
def acquisition_times(spark, sf):
    hhmm = F.when(F.col("event_id") % 11 == 0, "9999").otherwise((F.hour("ts") * 100 + F.minute("ts")).cast("string"))
    out = t.read(spark, sf, "events").select(
        "event_id", s.acquisition_time(F.to_date("ts"), hhmm).alias("acq_ts"), s.day_number("ts").alias("day_int")
    )
    out = out.withColumn("hour_utc", s.hour_floor("acq_ts")).withColumn("minute_int", s.epoch_minute("acq_ts"))
    return t.plain_times(out)


@query(
    "ring_bounds",
    "B22 B45",
    t.with_tables(
        "incidents",
        """select incident_id, cx-hs as min_lon, cy-hs as min_lat, cx+hs as max_lon, cy+hs as max_lat,
        ((cx-hs)+(cx+hs))/2 as center_lon, ((cy-hs)+(cy+hs))/2 as center_lat from incidents""",
    ),
)
def ring_bounds(spark, sf):
    west, south, east, north = geo.ring_bounds("rings")
    out = t.incidents(spark, sf).select(
        "incident_id", west.alias("min_lon"), south.alias("min_lat"), east.alias("max_lon"), north.alias("max_lat")
    )
    return out.selectExpr("*", "(min_lon+max_lon)/2 as center_lon", "(min_lat+max_lat)/2 as center_lat")


HAVERSINE = "2*6371.0088e0*asin(sqrt(power(sin(radians(({b})-({a}))/2),2)+cos(radians({a}))*cos(radians({b}))*power(sin(radians(({d})-({c}))/2),2)))"


def haversine_sql(lat1, lon1, lat2, lon2):
    return HAVERSINE.format(a=lat1, b=lat2, c=lon1, d=lon2)


@query(
    "distances_to_box",
    "B23 B24 B25",
    t.with_tables(
        "incidents",
        f"""select incident_id, round({haversine_sql("40e0", "-115e0", "cy", "cx")},6) as center_km,
        round({haversine_sql("40e0", "-115e0", "least(greatest(40e0,min_lat),max_lat)", "least(greatest(-115e0,min_lon),max_lon)")},6) as box_km,
        round({haversine_sql("min_lat", "min_lon", "max_lat", "max_lon")}/2,6) as radius_km from incidents""",
    ),
)
def distances_to_box(spark, sf):
    lat, lon = F.lit(40.0), F.lit(-115.0)
    center = ((F.col("min_lat") + F.col("max_lat")) / 2, (F.col("min_lon") + F.col("max_lon")) / 2)
    box = ("min_lon", "min_lat", "max_lon", "max_lat")
    return t.rounded(
        t.incidents(spark, sf).select(
            "incident_id",
            geo.haversine_km(lat, lon, *center).alias("center_km"),
            geo.bbox_distance_km(lat, lon, *box).alias("box_km"),
            geo.bbox_radius_km(*box).alias("radius_km"),
        )
    )


N = "sin(radians(38.5e0))"
RHO = "6371229e0*cos(radians(38.5e0))*pow(tan(pi()/4+radians(38.5e0)/2),{n})/{n}/pow(tan(pi()/4+radians({lat})/2),{n})"


def project_sql(lon: str, lat: str) -> tuple[str, str]:
    """Projected x and y of a lon/lat pair, for the oracle."""
    rho, rho0 = RHO.format(n=N, lat=lat), RHO.format(n=N, lat="38.5e0")
    angle = f"{N}*radians({lon}+97.5e0)"
    return f"({rho}*sin({angle}))", f"({rho0}-{rho}*cos({angle}))"


_PX, _PY = project_sql("lon", "lat")


@query(
    "projected_points",
    "B26",
    t.with_tables(
        "detections",
        f"select det_id, round({_PX},3) as x, round({_PY},3) as y, round(lon,6) as lon, round(lat,6) as lat from detections",
    ),
)
def projected_points(spark, sf):
    x, y = geo.project("lon", "lat")
    out = t.detections(spark, sf).select("det_id", x.alias("x"), y.alias("y"))
    lon, lat = geo.unproject("x", "y")
    return out.select(
        "det_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon, 6).alias("lon"),
        F.round(lat, 6).alias("lat"),
    )


_X0, _Y0 = project_sql("min_lon", "min_lat")
_X1, _Y1 = project_sql("max_lon", "max_lat")
t.define(
    "projected",
    f"""select *, least(x0,x1)-30000 as bxmin, least(y0,y1)-30000 as bymin, greatest(x0,x1)+30000 as bxmax, greatest(y0,y1)+30000 as bymax
  from (select *, {_X0} as x0, {_Y0} as y0, {_X1} as x1, {_Y1} as y1 from incidents)""",
    ["incidents"],
)


@query(
    "buffered_projected_boxes",
    "B27 B28",
    t.with_tables(
        "projected",
        """select incident_id, round(bxmin,3) as xmin, round(bymin,3) as ymin, round(bxmax,3) as xmax, round(bymax,3) as ymax,
        not (bxmax < -2000000 or bxmin > -1000000 or bymax < -300000 or bymin > 500000) as meets from projected""",
    ),
)
def buffered_projected_boxes(spark, sf):
    xmin, ymin, xmax, ymax = geo.projected_box("min_lon", "min_lat", "max_lon", "max_lat", 30.0)
    out = t.incidents(spark, sf).select(
        "incident_id", xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax")
    )
    meets = geo.boxes_intersect(("xmin", "ymin", "xmax", "ymax"), (-2000000.0, -300000.0, -1000000.0, 500000.0))
    return t.rounded(out.withColumn("meets", meets), 3)


@query(
    "polygon_acres",
    "B29",
    t.with_tables(
        "incidents",
        """select incident_id, round(abs(case when is_diamond then
          radians(hs)*((sin(radians(cy-hs))+sin(radians(cy)))+(sin(radians(cy))+sin(radians(cy+hs)))*-1
            +(sin(radians(cy+hs))+sin(radians(cy)))*-1+(sin(radians(cy))+sin(radians(cy-hs))))
          else radians(2*hs)*2*(sin(radians(cy-hs))-sin(radians(cy+hs))) end)*power(6371008.8e0,2)/2/4046.8564224e0, 2) as acres from incidents""",
    ),
)
def polygon_acres(spark, sf):
    return t.incidents(spark, sf).select("incident_id", F.round(geo.polygon_acres("rings"), 2).alias("acres"))


@query(
    "provider_window_rules",
    "B30",
    t.with_tables(
        "incidents",
        """select incident_id, p as provider, start_date - cast(case when p in ('B','C') then 2 else 0 end as integer) as start_date,
        (case when p='B' then greatest(least(end_date, start_date+4), start_date) else end_date end)
          + cast(case when p in ('B','C') then 2 else 0 end as integer) as end_date
        from (select *, case incident_id%3 when 0 then 'A' when 1 then 'B' else 'C' end as p from incidents)""",
    ),
)
def provider_window_rules(spark, sf):
    rows = t.incidents(spark, sf).withColumn("provider", F.expr("case incident_id%3 when 0 then 'A' when 1 then 'B' else 'C' end"))
    return inc.custom_windows(rows, 2, 4).select("incident_id", "provider", "start_date", "end_date")


@query(
    "progress_bins",
    "B31",
    t.with_tables(
        "incidents",
        """select incident_id, d as offset_days, round(d/greatest(n-1,1),6) as progress, cast(greatest(least(floor(d/greatest(n-1,1)*10),9),0) as integer) as b10,
        cast(greatest(least(floor(d/greatest(n-1,1)*20),19),0) as integer) as b20, cast(greatest(least(floor(d/greatest(n-1,1)*100),99),0) as integer) as b100
        from (select incident_id, n, cast(unnest(range(-1, n+1)) as integer) as d from (select incident_id, end_date-start_date+1 as n from incidents))""",
    ),
)
def progress_bins(spark, sf):
    days = F.datediff("end_date", "start_date") + 1
    rows = t.incidents(spark, sf).select("incident_id", days.alias("n"))
    rows = rows.withColumn("offset_days", F.explode(F.sequence(F.lit(-1), F.col("n"))))
    progress = s.relative_progress(F.col("offset_days"), F.col("n"))
    bins = [s.progress_bin(progress, b).alias(f"b{b}") for b in (10, 20, 100)]
    return t.rounded(rows.select("incident_id", "offset_days", progress.alias("progress"), *bins))


@query(
    "overpass_times",
    "B32 B33",
    t.with_tables(
        "incidents",
        """, o as (select incident_id, start_date, (13.5e0-cx/15+240)%24 as d, (1.5e0-cx/15+240)%24 as n from incidents)
        select incident_id, round(d,6) as day_hour, round(n,6) as night_hour,
        make_timestamp(cast(floor((epoch(cast(start_date as timestamp))+floor(d*3600)+450)/900)*900*1000000 as bigint)) as day_target,
        make_timestamp(cast(floor((epoch(cast(start_date as timestamp))+floor(n*3600)+450)/900)*900*1000000 as bigint)) as night_target from o""".replace(
            ", o as", "OO as", 1
        ),
    ).replace("\nOO as", ", o as"),
)
def overpass_times(spark, sf):
    day, night = s.overpass_hours((F.col("min_lon") + F.col("max_lon")) / 2)
    out = t.incidents(spark, sf).select(
        "incident_id",
        day.alias("day_hour"),
        night.alias("night_hour"),
        s.round_to_step(s.day_plus_hours("start_date", day)).alias("day_target"),
        s.round_to_step(s.day_plus_hours("start_date", night)).alias("night_target"),
    )
    return t.rounded(out)


ZONE = "case k%4 when 0 then 'America/Los_Angeles' when 1 then 'America/Denver' when 2 then 'America/Chicago' else 'America/Phoenix' end"


@query(
    "local_day_of_hour",
    "B34",
    f"""select k, cast(timezone({ZONE}, timezone('UTC', ts)) as date) as local_day from (select event_id as k, ts from events)""",
)
def local_day_of_hour(spark, sf):
    rows = t.read(spark, sf, "events").selectExpr("event_id as k", "ts")
    return rows.select("k", s.local_day("ts", F.expr(ZONE)).alias("local_day"))


@query(
    "expected_local_hours",
    "B35 D6",
    f"""select k, day, cast(date_diff('hour', timezone({ZONE}, cast(day as timestamp)), timezone({ZONE}, cast(day+1 as timestamp))) as integer) as hours
    from (select o_orderkey as k, cast(o_orderdate as date) as day from orders)""",
)
def expected_local_hours(spark, sf):
    rows = t.read(spark, sf, "orders").selectExpr("o_orderkey as k", "cast(o_orderdate as date) as day")
    return rows.select("k", "day", s.expected_hours("day", F.expr(ZONE)).alias("hours"))


@query(
    "run_hour_axis",
    "B36",
    """select unnest(range(cast(min(cast(ts as date)) as timestamp) - interval 1 day, cast(max(cast(ts as date)) as timestamp) + interval 48 hour, interval 1 hour)) as hour_utc from events""",
)
def run_hour_axis(spark, sf):
    from plumeframe.operators.temporal import hour_axis_of

    return t.plain_times(hour_axis_of(t.read(spark, sf, "events"), "ts"))


@query(
    "unit_harmonized",
    "B37",
    """select o_orderkey, v as value, round(ln(1+greatest(v,0)),6) as log_value, round(ln(1+greatest(v,0)),6) as back
    from (select o_orderkey, case when d < date '2021-12-21' then x else x*1e9 end as v from
    (select o_orderkey, cast(o_orderdate as date) + 8000 as d, (o_totalprice-200000)/1e5 as x from orders))""",
)
def unit_harmonized(spark, sf):
    rows = t.read(spark, sf, "orders").selectExpr(
        "o_orderkey", "date_add(cast(o_orderdate as date), 8000) as d", "(o_totalprice-200000)/1e5 as x"
    )
    rows = rows.withColumn("value", s.harmonize_units("x", "d"))
    logged = s.to_log_space("value")
    return rows.select(
        "o_orderkey", "value", F.round(logged, 6).alias("log_value"), F.round(F.log1p(s.from_log_space(logged)), 6).alias("back")
    )


@query(
    "upper_air_channels",
    "B38",
    """select p_partkey, (p_partkey%3=0 or p_type='ECONOMY') as upper_air from part""",
)
def upper_air_channels(spark, sf):
    level = F.when(F.col("p_partkey") % 3 == 0, "700MB").otherwise("2m_above_ground")
    variable = F.when(F.col("p_type") == "ECONOMY", "dzdt").otherwise("TMP")
    return t.read(spark, sf, "part").select("p_partkey", s.is_upper_air(variable, level).alias("upper_air"))


@query(
    "sample_keys",
    "B39",
    """select event_id, user_id||'|hourly|'||strftime(ts,'%Y-%m-%dT%H:%M:%S')||'+00:00' as hourly,
    user_id||'|daily|'||strftime(ts,'%Y-%m-%d')||'|0,6,12,18' as daily,
    case event_id%3 when 0 then 'kept' when 1 then user_id||'|daily|'||strftime(ts,'%Y-%m-%d')||'|0,12' else user_id||'|hourly|x' end as rebuilt from events""",
)
def sample_keys(spark, sf):
    k, user = F.col("event_id") % 3, F.col("user_id").cast("string")
    day = F.to_date("ts")
    rebuilt = s.sample_key_of_row(
        F.when(k == 0, "kept").otherwise(" "), user, F.when(k == 1, "daily_4h_mean"), day.cast("string"), F.lit("0,12"), F.lit("x")
    )
    return t.read(spark, sf, "events").select(
        "event_id",
        s.sample_key_hourly("user_id", "ts").alias("hourly"),
        s.sample_key_daily("user_id", day, (18, 0, 6, 12)).alias("daily"),
        rebuilt.alias("rebuilt"),
    )


@query(
    "hour_lists",
    "B40",
    """select k, list_sort(list_distinct([k%24, (k*7)%24, 5, (k*7)%24])) as hours from (select cast(event_id as integer) as k from events)""",
)
def hour_lists(spark, sf):
    k = F.col("event_id")
    text = F.concat_ws(",", k % 24, (k * 7) % 24, F.lit(" 5"), (k * 7) % 24)
    return t.read(spark, sf, "events").select(k.cast("int").alias("k"), s.hour_list(text).alias("hours"))


@query(
    "geo_cells",
    "B41",
    t.with_tables(
        "detections",
        """select det_id, cast(round_even(lat/0.25e0,0) as integer)||'_'||cast(round_even(lon/0.25e0,0) as integer) as cell from detections""",
    ),
)
def geo_cells(spark, sf):
    return t.detections(spark, sf).select("det_id", s.geo_cell("lat", "lon").alias("cell"))


@query(
    "granule_key_times",
    "B42",
    """select event_id, date_trunc('second', ts) as a, date_trunc('second', ts) as b, date_trunc('second', ts) as c,
    cast(null as timestamp) as none from events""",
)
def granule_key_times(spark, sf):
    ts = F.col("ts")
    forms = {
        "a": ("year_day", F.concat(F.lit("G18_s"), F.date_format(ts, "yyyyDDDHHmmss"), F.lit("7_e2"))),
        "b": ("digits15", F.concat(F.lit("JRR_s"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("4_e1"))),
        "c": ("split", F.concat(F.lit("SVM03_j01_d"), F.date_format(ts, "yyyyMMdd"), F.lit("_t"), F.date_format(ts, "HHmmss"), F.lit("2_e9"))),
        "none": ("year_day", F.lit("no time here")),
    }
    cols = [s.granule_time(text, form).alias(name) for name, (form, text) in forms.items()]
    return t.plain_times(t.read(spark, sf, "events").select("event_id", *cols))


@query(
    "pixel_scaling",
    "B43",
    """select l_orderkey, l_linenumber, l_partkey, case when raw>0 and raw<65528 then round(raw*0.0004e0+0.1e0,6) end as reflectance,
    case when raw<>1023 and raw>=0 then round(raw*0.0004e0-0.01e0,6) end as counts
    from (select l_orderkey, l_linenumber, l_partkey, case when l_partkey%10=0 then 65530 when l_partkey%10=1 then 1023 when l_partkey%10=2 then -3 else l_partkey end as raw from lineitem)""",
)
def pixel_scaling(spark, sf):
    k = F.col("l_partkey")
    raw = F.when(k % 10 == 0, 65530).when(k % 10 == 1, 1023).when(k % 10 == 2, -3).otherwise(k)
    scale = F.lit(0.0004)
    return t.rounded(
        t.read(spark, sf, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey",
            s.scale_counts(raw, scale, F.lit(0.1)).alias("reflectance"),
            s.scale_counts(raw, scale, F.lit(-0.01), F.lit(1023)).alias("counts"),
        )
    )


@query(
    "band_arithmetic",
    "B44",
    """select l_orderkey, l_linenumber, l_partkey, round(0.45e0*l_discount+0.10e0*l_tax+0.45e0*l_quantity/50,6) as green,
    round(case when cos(radians(l_quantity*2))>0.15e0 then l_discount/cos(radians(l_quantity*2)) end,6) as sunny,
    coalesce(cast(round_even(power(least(greatest(least(greatest(case when cos(radians(l_quantity*2))>0.15e0 then l_discount/cos(radians(l_quantity*2)) end,0),1)*1.6e0,0),1),1/2.2e0)*255,0) as integer),0) as shade
    from lineitem""",
)
def band_arithmetic(spark, sf):
    sunny = s.sun_normalize(F.col("l_discount"), F.col("l_quantity") * 2)
    green = s.synthetic_green(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50)
    out = t.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", green.alias("green"), sunny.alias("sunny"),
        F.when(sunny.isNull(), 0).otherwise(s.display_byte(sunny)).alias("shade"),
    )
    return t.rounded(out)


@query(
    "guarded_ratios",
    "B46",
    "select l_orderkey, l_linenumber, l_partkey, round(l_quantity/nullif(l_discount,0),6) as value from lineitem",
)
def guarded_ratios(spark, sf):
    value = s.ratio(F.col("l_quantity"), F.col("l_discount"))
    return t.rounded(t.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", value.alias("value")))


# ---- incident rules --------------------------------------------------------------------------


def features(spark, sf):
    """Provider features: text attributes with gaps, ring arrays, an arrival order."""
    shapes = t.incidents(spark, sf)
    k = F.col("incident_id")
    start, end = F.col("start_date").cast("timestamp"), F.col("end_date").cast("timestamp")
    return shapes.select(
        k.alias("seq"),
        F.when(k % 10 == 3, "RX").otherwise("WF ").alias("attr_IncidentTypeCategory"),
        _stamp(start + F.expr("interval 5 hours")).alias("attr_FireDiscoveryDateTime"),
        F.when(k % 4 == 0, _stamp(end + F.expr("interval 20 hours"))).alias("attr_FireOutDateTime"),
        F.when(k % 4 == 1, _stamp(end)).otherwise("").alias("attr_ContainmentDateTime"),
        F.lit(None).cast("string").alias("attr_ControlDateTime"),
        F.when(k % 8 == 2, _stamp(end)).alias("poly_PolygonDateTime"),
        F.when(k % 5 != 0, F.format_number("size_acres", 1)).otherwise("0").alias("attr_IncidentSize"),
        F.col("size_acres").cast("string").alias("poly_GISAcres"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("U-"), (k / 2).cast("int"))).alias("attr_UniqueFireIdentifier"),
        F.when(k % 7 != 0, F.concat(F.lit("P-"), k)).alias("poly_IRWINID"),
        F.when(k % 2 == 0, F.concat(F.lit("L-"), k)).otherwise(" ").alias("attr_LocalIncidentIdentifier"),
        F.concat(F.lit("{"), F.upper("name"), F.lit("}")).alias("attr_IrwinID"),
        F.when(k % 6 == 0, "").otherwise(F.col("name")).alias("attr_IncidentName"),
        F.lit(None).cast("string").alias("poly_IncidentName"),
        F.when(k % 9 == 0, " ").otherwise(F.col("state")).alias("attr_POOState"),
        F.when(k % 4 == 0, None).otherwise(F.col("cause_general")).alias("attr_FireCauseGeneral"),
        F.lit("").alias("attr_FireCauseSpecific"),
        F.lit("kind").alias("attr_IncidentTypeKind"),
        F.lit(None).cast("string").alias("attr_PredominantFuelGroup"),
        "rings",
    )


t.define(
    "feature",
    """select incident_id as k, *, cast(start_date as timestamp) + interval 5 hour as start_ts,
  case when incident_id%4=0 then cast(end_date as timestamp)+interval 20 hour when incident_id%4=1 or incident_id%8=2 then cast(end_date as timestamp) end as end_ts,
  coalesce(case when incident_id%3<>0 then 'U-'||(incident_id//2) end, case when incident_id%7<>0 then 'P-'||incident_id end,
    case when incident_id%2=0 then 'L-'||incident_id end) as fid,
  case when incident_id%6=0 then 'Unknown' else name end as fname from incidents where incident_id%10<>3""",
    ["incidents"],
)


@query(
    "strict_incidents",
    "C1 J5",
    t.with_tables(
        "feature",
        """select fid as incident_id, fname as name, case when k%9=0 then '' else state end as state, start_ts, end_ts, size_acres,
        min_lon, min_lat, max_lon, max_lat from feature where start_date between date '2024-01-03' and date '2024-01-20'
        and end_ts >= start_ts and size_acres >= 5000 and fid is not null""",
    ),
)
def strict_incidents(spark, sf):
    out = inc.strict_incidents(features(spark, sf), dt.date(2024, 1, 3), dt.date(2024, 1, 20), 5000.0)
    return t.plain_times(out.drop("type", "start_date", "end_date", "rings"))


@query(
    "analytic_incidents",
    "C2",
    t.with_tables(
        "feature",
        """select fid as incident_id, fname as name, case when k%9=0 then 'Unknown' else state end as state, lower(name) as irwin_id, start_date,
        greatest(coalesce(cast(end_ts as date), start_date), start_date) as end_date, size_acres,
        case when k%4=0 then 'Unknown' else cause_general end as cause_general from feature where size_acres >= 5000 and fid is not null""",
    ),
)
def analytic_incidents(spark, sf):
    out = inc.analytic_incidents(features(spark, sf), 2024, 2024, 5000.0)
    return out.select("incident_id", "name", "state", "irwin_id", "start_date", "end_date", "size_acres", "cause_general")


@query(
    "burned_area_incidents",
    "C3 A6",
    t.with_tables(
        "incidents",
        """select 'E'||incident_id as incident_id, name, substr('E'||incident_id,1,2) as state, start_date,
        case when incident_id%5 not in (0,1) then end_date end as end_date, size_acres
        from incidents where incident_id%6<>0 and size_acres>=20000""",
    ),
)
def burned_area_incidents(spark, sf):
    k = F.col("incident_id")
    image = F.when(k % 5 == 1, F.date_sub("start_date", 9)).otherwise(F.col("end_date"))
    rows = t.incidents(spark, sf).select(
        F.when(k % 6 == 0, "Prescribed").otherwise(" Wildfire").alias("Incid_Type"),
        F.col("start_date").alias("Ig_Date"),
        F.col("size_acres").alias("BurnBndAc"),
        F.concat(F.lit("E"), k).alias("Event_ID"),
        F.when(k % 5 == 0, "x").otherwise(F.concat(F.lit("8_"), F.date_format(image, "yyyyMMdd"))).alias("Post_ID"),
        F.lit("").alias("irwinID"),
        F.col("name").alias("Incid_Name"),
    )
    out = inc.burned_area_incidents(rows, 2024, 2024, 20000.0)
    return out.select("incident_id", "name", "state", "start_date", "end_date", "size_acres")


@query(
    "global_incidents",
    "C3 B29 A6",
    t.with_tables(
        "incidents",
        """select cast(incident_id as varchar) as incident_id, start_date, greatest(end_date - cast(incident_id%4 as integer), start_date) as end_date
        from incidents where cx+hs-50 >= -170 and cx-hs-50 <= -65 and hs*hs*cos(radians(cy))*(case when is_diamond then 2 else 4 end) > 0.5e0""",
    ),
)
def global_incidents(spark, sf):
    shifted = F.transform(
        "rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] - 50).alias("x"), p["y"].alias("y")))
    )
    rows = t.incidents(spark, sf).select(
        F.col("incident_id").alias("Id"),
        F.col("start_date").alias("IDate"),
        F.expr("date_sub(end_date, cast(incident_id%4 as int))").alias("FDate"),
        shifted.alias("rings"),
    )
    # 0.5 square degrees at the equator, in acres
    limit = 0.5 * (geo.EARTH_RADIUS_KM * 1000 * 3.141592653589793 / 180) ** 2 / geo.SQUARE_M_PER_ACRE
    return inc.global_incidents(rows, 2024, limit).select("incident_id", "start_date", "end_date")


t.define(
    "twice",
    """select incident_id//3 as id, incident_id as seq, case when incident_id%4=0 then 'Unknown' else state end as state, repeat('n', cast(incident_id%5+1 as integer)) as name,
  start_date, end_date, floor(size_acres/20000)*1000 as size, cx from incidents""",
    ["incidents"],
)


@query(
    "folded_incidents",
    "E35",
    t.with_tables(
        "twice",
        """select id as incident_id, arg_max(name, length(name)*100000+seq) as name,
        coalesce(arg_max(state, seq) filter (state<>'Unknown'),'Unknown') as state, min(start_date) as start_date, max(end_date) as end_date,
        max(size) as size_acres, round(arg_max(cx, size*100000+seq),6) as later, round(arg_max(cx, size*100000-seq),6) as earlier from twice group by 1""",
    ),
)
def folded_incidents(spark, sf):
    rows = t.incidents(spark, sf).selectExpr(
        "cast(floor(incident_id/3) as bigint) as incident_id", "incident_id as seq",
        "case when incident_id%4=0 then 'Unknown' else state end as state",
        "repeat('n', cast(incident_id%5+1 as int)) as name", "start_date", "end_date",
        "cast(floor(size_acres/20000)*1000 as double) as size_acres", "(min_lon+max_lon)/2 as min_lon",
    )
    later = inc.fold_duplicates(rows).withColumnRenamed("min_lon", "later")
    earlier = inc.fold_duplicates(rows, larger_wins_ties=False).selectExpr("incident_id", "min_lon as earlier")
    out = later.join(earlier, "incident_id")
    return t.rounded(out)


@query(
    "grid_domain_incidents",
    "C7",
    t.with_tables(
        "projected",
        "select state, count(*) as dropped from projected where bxmax < -1900000 or bxmin > -1100000 or bymax < -200000 or bymin > 300000 group by 1",
    ),
)
def grid_domain_incidents(spark, sf):
    _, dropped = inc.domain_split(t.incidents(spark, sf), 30.0, (-1900000.0, -200000.0, -1100000.0, 300000.0))
    return dropped


@query(
    "eligible_incidents",
    "C9",
    t.with_tables(
        "incidents",
        "select incident_id from incidents where state not in ('NATION_3','NATION_7') and size_acres>=30000 and end_date-start_date+1>=4",
    ),
)
def eligible_incidents(spark, sf):
    return inc.eligible_incidents(t.incidents(spark, sf), ("NATION_3", "NATION_7"), 30000.0, 4).select("incident_id")


@query(
    "complete_numeric_rows",
    "C10",
    "select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey%7<>0 and l_quantity<=40",
)
def complete_numeric_rows(spark, sf):
    from plumeframe.operators.observations import drop_missing

    rows = t.read(spark, sf, "lineitem").withColumn("a", F.expr("case when l_partkey%7<>0 then 1.0e0 end")).withColumn(
        "b", F.expr("case when l_quantity<=40 then l_quantity else double('nan') end")
    )
    return drop_missing(rows, ["a", "b", "l_tax"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "local_daytime",
    "C11",
    t.with_tables(
        "detections",
        """select det_id, ((hour(acq_ts)+minute(acq_ts)/60.0e0+lon/15+240)%24) between 7 and 18 as daytime from detections""",
    ),
)
def local_daytime(spark, sf):
    return t.detections(spark, sf).select("det_id", s.is_local_daytime("acq_ts", "lon").alias("daytime"))


@query(
    "mask_pixels",
    "C12 C13",
    """select l_orderkey, l_linenumber, l_partkey, l_partkey%40 in (10,11,12,13,14,15,30,31,32,33,34,35) and l_linenumber<=1 as fire,
    case when l_partkey%9<>0 then l_partkey%2=1 end as cloud, l_partkey%4>=2 as cloud4 from lineitem""",
)
def mask_pixels(spark, sf):
    k = F.col("l_partkey")
    quality = F.when(k % 9 == 0, 255).otherwise(0)
    return t.read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        s.is_fire_pixel((k % 40).cast("int"), "l_linenumber").alias("fire"),
        s.is_cloud_pixel((k % 2).cast("int"), quality).alias("cloud"),
        s.is_cloud_pixel((k % 4).cast("int"), levels=4).alias("cloud4"),
    )


@query(
    "find_incident",
    "F26",
    t.with_tables(
        "incidents",
        """(select 'id' as how, incident_id from incidents where incident_id=17)
        union all (select 'name', incident_id from incidents where contains(lower(name),'00012') order by size_acres desc, incident_id limit 1)
        union all (select 'center', incident_id from incidents order by sqrt(power(cy-40,2)+power(cx+112,2))
          + case when date '2024-01-12' between start_date and end_date then 0 else least(abs(date '2024-01-12'-start_date),abs(date '2024-01-12'-end_date))/100e0 end, incident_id limit 1)
        union all (select 'largest', incident_id from incidents order by size_acres desc, incident_id limit 1)""",
    ),
)
def find_incident(spark, sf):
    rows = t.incidents(spark, sf)
    found = {
        "id": inc.find_incident(rows, incident_id=17),
        "name": inc.find_incident(rows, name="00012"),
        "center": inc.find_incident(rows, center=(40.0, -112.0), date_hint=dt.date(2024, 1, 12)),
        "largest": inc.find_incident(rows),
    }
    out = None
    for how, df in found.items():
        part = df.select(F.lit(how).alias("how"), "incident_id")
        out = part if out is None else out.unionByName(part)
    return out
