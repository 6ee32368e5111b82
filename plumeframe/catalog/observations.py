"""Queries for station-days, their field means and their accuracy."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumeframe.catalog import tables as t
from plumeframe.catalog.registry import ENTRIES, query
from plumeframe.catalog.scalars import haversine_sql, project_sql
from plumeframe.functions import geo
from plumeframe.operators import grids, metrics, spatial
from plumeframe.operators import observations as obs
from plumeframe.scale import stage
from plumeframe.sources import readers, sinks

RAW = """l_suppkey as station_id, n_name as nation,
  case s_suppkey%5 when 0 then 'Oregon' when 1 then 'Texas' when 2 then 'Ohio' when 3 then 'California' else 'Nowhere' end as state_name,
  -124+((s_suppkey*7919)%2000)/1e2 as longitude, 32+((s_suppkey*104729)%1600)/1e2 as latitude,
  case s_suppkey%4 when 0 then 'America/Los_Angeles' when 1 then 'America/Denver' when 2 then 'America/Chicago' else 'America/Phoenix' end as timezone,
  case when l_partkey%13<>0 then l_quantity*2 end as observation_percent, cast(l_linenumber as double) as poc_numeric,
  case when l_partkey%17<>0 then l_shipdate end as date_last_change, l_extendedprice/1e3 as pm25_value,
  case when l_returnflag='A' then 0 else 1 end as source, l_orderkey, l_linenumber, l_partkey, l_extendedprice"""


def raw_rows(spark, sf):
    """Monitor rows: several per station-day, with ties and gaps."""
    line, supplier, nation = (t.read(spark, sf, n) for n in ("lineitem", "supplier", "nation"))
    joined = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    )
    return joined.selectExpr(
        *t._columns(RAW),
        "date_add(date'2024-01-01', cast(datediff(cast(l_shipdate as date), date'1995-01-01')%40 as int)) as date_local",
    )


t.define(
    "raw_rows",
    f"""select {RAW}, date '2024-01-01' + cast((cast(l_shipdate as date)-date '1995-01-01')%40 as integer) as date_local
  from lineitem join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey""",
)
TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
ORDER = "observation_percent desc nulls last, poc_numeric nulls last, date_last_change desc nulls last, " + ", ".join(TIE)
t.define(
    "observations",
    f"""select * exclude (rn) from (select *, row_number() over (partition by station_id, date_local order by source, {ORDER}) as rn from raw_rows) where rn=1""",
    ["raw_rows"],
)
KEEP = ["station_id", "date_local", "observation_percent", "poc_numeric", "pm25_value", "source", *TIE]


@query(
    "best_monitor_per_station_day",
    "F1",
    t.with_tables(
        "raw_rows",
        f"""select {', '.join(KEEP)} from (select *, row_number() over (partition by station_id, date_local order by {ORDER}) as rn
        from raw_rows where source=0) where rn=1""",
    ),
)
def best_monitor(spark, sf):
    return obs.best_monitor(raw_rows(spark, sf).filter("source = 0"), TIE).select(*KEEP)


def observations(spark, sf):
    raw = raw_rows(spark, sf)
    return obs.best_source(raw.filter("source = 0"), raw.filter("source = 1"), TIE)


@query("best_source_per_station_day", "F2 G1", t.with_tables("observations", f"select {', '.join(KEEP)} from observations"))
def best_source(spark, sf):
    return observations(spark, sf).select(*KEEP)


@query(
    "ingest_observations",
    "J1 A1 A2 B1 B6 B7 C10",
    t.with_tables(
        "raw_rows",
        f"""select station_id, date_local, pm25_value, pm_source_code, pm_source_poc, observation_percent from (select *,
          row_number() over (partition by station_id, date_local order by pm_source_code, observation_percent desc nulls last, poc_numeric, {", ".join(TIE)}) as rn from (
          select lpad(cast(r.station_id%90 as varchar),2,'0')||'-'||lpad(cast(r.station_id%800 as varchar),3,'0')||'-'||case when r.station_id<10000 then lpad(cast(r.station_id as varchar),4,'0') else cast(r.station_id as varchar) end as station_id,
            date_local, l_extendedprice/1e3 as pm25_value, case when source=0 then '88101' else '88502' end as pm_source_code,
            cast(l_linenumber as varchar) as pm_source_poc, observation_percent, poc_numeric, {", ".join(TIE)}
          from raw_rows r where date_local<=date '2024-01-31' and l_partkey%19<>0)) where rn=1""",
    ),
)
def ingest_observations(spark, sf):
    from plumeframe.plans.station import ingest_observations as ingest

    raw = raw_rows(spark, sf)
    frames = []
    for source, code in ((0, "88101"), (1, "88502")):
        named = [c.alias(n) for n, c in monitor_columns().items()]
        frames.append(
            raw.filter(F.col("source") == source).select(*named, F.lit(code).alias("pm_source_code"), F.struct(*TIE).alias("seq"))
        )
    out, _ = ingest(frames[0], frames[1], dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    return out.select("station_id", "date_local", "pm25_value", "pm_source_code", "pm_source_poc", "observation_percent")


@query("ingest_archives", "J1 A1 A2 B1 B6 B7 C10", ENTRIES["ingest_observations"].sql)
def ingest_archives(spark, sf):
    """The same rows from zip archives per thousand orders: the first member in the usual column order, the second turned round, the third no table."""
    from plumeframe.plans.station import ingest_observations as ingest

    # The method code carries the order of rows that are equal in all that counts.
    tie = F.concat_ws("-", *[F.lpad(F.col(c).cast("string"), 12, "0") for c in ("l_orderkey", "l_linenumber", "l_partkey")], F.lpad(F.format_string("%.2f", F.col("l_extendedprice").cast("double")), 14, "0"))
    raw = raw_rows(spark, sf).select(
        *[c.alias(n) for n, c in (monitor_columns() | {"Method Code": tie}).items()], F.when(F.col("source") == 0, "88101").otherwise("88502").alias("Parameter Code"),
        "source", "l_orderkey", F.floor(F.col("l_orderkey") / 4000).alias("archive"),
    )
    names = [*monitor_columns(), "Parameter Code"]
    frames = []
    for source, code in ((0, "88101"), (1, "88502")):
        rows = raw.filter(F.col("source") == source)
        path = F.concat_ws("_", F.lit(code), F.col("archive"))
        # Every archive has a first member that holds the table, if only its header and rows of one half of the orders.
        members = t.csv_lines(rows.filter("l_orderkey % 2 = 0"), path, "a.csv", names).unionByName(t.csv_lines(rows.filter("l_orderkey % 2 = 1"), path, "b.csv", names[::-1]))
        other = rows.select(path.alias("path")).distinct().select("path", F.lit("c.csv").alias("member"), F.lit("x").alias("header"), F.lit("1").alias("line"))
        frames.append(readers.observations_of(t.zipped(members.unionByName(other)), code))
    out, _ = ingest(frames[0], frames[1], dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    return out.select("station_id", "date_local", "pm25_value", "pm_source_code", "pm_source_poc", "observation_percent")


def monitor_columns() -> dict:
    """Columns of the monitor files, by header name."""
    sid = F.col("station_id")
    quoted = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    day = F.when(F.col("l_partkey") % 2 == 0, F.col("date_local").cast("string")).otherwise(F.date_format("date_local", "M/d/yyyy"))
    blank = F.lit("")
    columns = {
        "State Code": quoted(sid % 90), "County Code": (sid % 800).cast("string"), "Site Num": sid.cast("string"),
        "POC": F.col("l_linenumber").cast("string"), "Latitude": F.col("latitude").cast("string"),
        "Longitude": F.col("longitude").cast("string"), "Parameter Name": F.lit("PM"), "Sample Duration": F.lit("24 HOUR"),
        "Pollutant Standard": blank, "Date Local": day, "Units of Measure": F.lit("ug/m3"), "Event Type": F.lit("None"),
        "Observation Count": F.lit("1"), "Observation Percent": F.coalesce(F.col("observation_percent").cast("string"), blank),
        "Arithmetic Mean": F.when(F.col("l_partkey") % 19 == 0, "n/a").otherwise(F.col("pm25_value").cast("string")),
        "AQI": blank, "Method Code": F.lit("1"), "Method Name": F.lit("M"), "State Name": F.col("state_name"),
        "County Name": blank, "City Name": blank, "CBSA Name": blank, "Date of Last Change": F.lit("2024-01-01"),
    }
    return columns


@query(
    "distinct_stations",
    "G2",
    t.with_tables("raw_rows", "select distinct station_id, latitude, longitude, state_name, timezone from raw_rows"),
)
def distinct_stations(spark, sf):
    return obs.distinct_stations(raw_rows(spark, sf))


@query(
    "duplicate_station_days",
    "L2 G2",
    t.with_tables("raw_rows", "select station_id, date_local, count(*) as n from raw_rows group by 1,2 having count(*)>1"),
)
def duplicate_station_days(spark, sf):
    return obs.duplicate_keys(raw_rows(spark, sf), ["station_id", "date_local"])


# ---- fields ----------------------------------------------------------------------------------

G = t.GRID


def fields(spark, sf):
    """Two variables on a coarse grid at every hour that has events; cells depend on the hour's events."""
    hours = t.read(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("run_time")).agg(F.count("*").alias("events"))
    cells = (
        hours.withColumn("h", (F.unix_seconds("run_time") / 3600).cast("bigint"))
        .withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(G.ny - 1))))
        .withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(G.nx - 1))))
    )
    named = cells.selectExpr(
        "run_time", "cast(run_time as date) as run_date", "iy", "ix",
        f"{G.x0}e0 + ix*{G.dx}e0 as x", f"{G.y0}e0 + iy*{G.dy}e0 as y",
        "inline(array(named_struct('variable','MASSDEN','level','8m_above_ground','value', case when (ix+iy+h)%29<>0 then cast((13*ix+7*iy+3*h+events)%97 as double) end),"
        " named_struct('variable','COLMD','level','entire_atmosphere','value', case when h%31<>0 then cast((5*ix+11*iy+2*h)%89 as double) end)))",
    )
    return named.filter("not (variable='COLMD' and value is null)")


t.define(
    "fields",
    f"""select * from (select run_time, cast(run_time as date) as run_date, iy, ix, {G.x0}e0+ix*{G.dx}e0 as x, {G.y0}e0+iy*{G.dy}e0 as y, variable,
    case variable when 'MASSDEN' then '8m_above_ground' else 'entire_atmosphere' end as level,
    case when variable='MASSDEN' then case when (ix+iy+h)%29<>0 then cast((13*ix+7*iy+3*h+events)%97 as double) end
      else case when h%31<>0 then cast((5*ix+11*iy+2*h)%89 as double) end end as value
  from (select date_trunc('hour', ts) as run_time, count(*) as events, cast(epoch(date_trunc('hour', ts))/3600 as bigint) as h from events group by all),
    (select cast(range as integer) as iy from range({G.ny})), (select cast(range as integer) as ix from range({G.nx})),
    (select unnest(['MASSDEN','COLMD']) as variable)) where not (variable='COLMD' and value is null)""",
)

_SX, _SY = project_sql("longitude", "latitude")
t.define(
    "stations",
    f"""select *, (x-({G.x0}))/{G.dx} as px, (y-({G.y0}))/{G.dy} as py from (select distinct station_id, latitude, longitude, timezone, {_SX} as x, {_SY} as y from raw_rows)""",
    ["raw_rows"],
)


def stations(spark, sf):
    x, y = geo.project("longitude", "latitude")
    return obs.distinct_stations(raw_rows(spark, sf)).withColumn("x", x).withColumn("y", y)


def bilinear_sql(points: str, key: str, field: str, inside: str) -> str:
    """Four-corner bilinear sample in SQL: points(key, px, py) on field(run_time, iy, ix, value)."""
    return f"""select {key}, run_time, sum(w*value) as value from (select {key}, by_+dy as iy, bx+dx as ix,
      (case dy when 0 then 1-fy else fy end)*(case dx when 0 then 1-fx else fx end) as w
      from (select {key}, cast(least(floor(px),{G.nx - 2}) as integer) as bx, cast(least(floor(py),{G.ny - 2}) as integer) as by_,
        px-least(floor(px),{G.nx - 2}) as fx, py-least(floor(py),{G.ny - 2}) as fy from {points} where {inside}),
      (select unnest([0,1]) as dx), (select unnest([0,1]) as dy)) c
      join (select * from fields where {field}) f using (iy, ix) where value is not null group by all having count(*)=4"""


INSIDE = f"px between 0 and {G.nx - 1} and py between 0 and {G.ny - 1}"
t.define("sample0", bilinear_sql("stations", "station_id", "variable='MASSDEN'", INSIDE), ["stations", "fields"])
t.define("sample1", bilinear_sql("stations", "station_id", "variable='COLMD'", INSIDE), ["stations", "fields"])


@query(
    "field_at_stations",
    "D9 A7",
    t.with_tables("sample0", "select station_id, run_time, round(value,5) as value from sample0"),
)
def field_at_stations(spark, sf):
    field = grids.read_field(fields(spark, sf), None, "MASSDEN", "8m_above_ground")
    return t.rounded(grids.bilinear_sample(stations(spark, sf), field, G), 5)


@query(
    "field_with_grid_coords",
    "A7",
    t.with_tables("fields", "select run_time, iy, ix, x, y, value from fields where variable='COLMD' and run_time=timestamp '2024-01-05 06:00:00'"),
)
def field_with_grid_coords(spark, sf):
    source = fields(spark, sf)
    coords = source.select("level", "iy", "ix", "x", "y").distinct()
    bare = source.withColumn("x", F.lit(None).cast("double")).withColumn("y", F.lit(None).cast("double"))
    out = grids.read_field(bare, coords, "COLMD", "entire_atmosphere", dt.datetime(2024, 1, 5, 6))
    return t.plain_times(out.select("run_time", "iy", "ix", "x", "y", "value"))


@query(
    "missing_field_runs",
    "A8",
    t.with_tables(
        "fields",
        """select r as run_time, v as variable from (select distinct run_time as r from fields), (select unnest(['MASSDEN','COLMD']) as v)
        where not exists (select 1 from fields where run_time=r and variable=v)""",
    ),
)
def missing_field_runs(spark, sf):
    path = t.scratch(spark, "fields")
    sinks.write_fields(fields(spark, sf), path)
    source = readers.field_catalog(spark, path)
    wanted = source.select("run_time").distinct().selectExpr(
        "run_time",
        "inline(array(named_struct('variable','MASSDEN','level','8m_above_ground'), named_struct('variable','COLMD','level','entire_atmosphere')))",
    )
    _, missing = grids.split_by_availability(wanted, source)
    return t.plain_times(missing.select("run_time", "variable"))


t.define(
    "day_sums",
    """select a.station_id, cast(timezone(s.timezone, timezone('UTC', a.run_time)) as date) as date_local, sum(a.value) as sum0, sum(b.value) as sum1, count(*) as n
  from sample0 a join sample1 b using (station_id, run_time) join stations s using (station_id) group by all""",
    ["sample0", "sample1", "stations"],
)
_EXPECTED = "cast(date_diff('hour', timezone(timezone, cast(date_local as timestamp)), timezone(timezone, cast(date_local+1 as timestamp))) as integer)"
t.define(
    "station_daily",
    f"""select *, coalesce(found=expected, false) as complete from (select o.*, sum0/n as massden, sum1/n as colmd, cast(coalesce(n,0) as integer) as found, {_EXPECTED} as expected
  from observations o left join day_sums using (station_id, date_local))""",
    ["observations", "day_sums"],
)


def two_fields(spark, sf, places=None):
    return grids.sample_two_fields(
        stations(spark, sf) if places is None else places, fields(spark, sf), G, ("MASSDEN", "8m_above_ground"), ("COLMD", "entire_atmosphere")
    )


@query(
    "station_day_sums",
    "D5 E1 C14",
    t.with_tables("day_sums", "select station_id, date_local, round(sum0/n,5) as mean0, round(sum1/n,5) as mean1, n from day_sums"),
)
def station_day_sums(spark, sf):
    sums = obs.station_day_sums(two_fields(spark, sf), stations(spark, sf))
    return t.rounded(sums.selectExpr("station_id", "date_local", "sum0/n as mean0", "sum1/n as mean1", "n"), 5)


def station_daily(spark, sf):
    from plumeframe.plans.station import station_daily as build

    return build(
        observations(spark, sf), fields(spark, sf), G, ("MASSDEN", "8m_above_ground"), ("COLMD", "entire_atmosphere"),
        check_unique=False,
    )


@query(
    "station_daily",
    "J2 D6",
    t.with_tables(
        "station_daily",
        """select station_id, date_local, round(pm25_value,5) as pm25_value, round(massden,5) as massden_daily_mean, round(colmd,5) as colmd_daily_mean, found as hrrr_hours_found,
        expected as hrrr_hours_expected, timezone, complete as hrrr_day_complete from station_daily""",
    ),
)
def station_daily_query(spark, sf):
    out = station_daily(spark, sf).select(
        "station_id", "date_local", "pm25_value", "massden_daily_mean", "colmd_daily_mean", "hrrr_hours_found",
        "hrrr_hours_expected", "timezone", "hrrr_day_complete",
    )
    return t.rounded(out, 5)


# ---- accuracy --------------------------------------------------------------------------------

_DIST = haversine_sql("s.latitude", "s.longitude", "i.clat", "i.clon")
_RADIUS = haversine_sql("i.min_lat", "i.min_lon", "i.max_lat", "i.max_lon")
t.define(
    "active",
    """select i.*, start_date + cast(unnest(range(end_date-start_date+1)) as integer) as day from incidents i""",
    ["incidents"],
    once=True,
)
t.define("day_lat", "select day, cos(radians(avg((min_lat+max_lat)/2))) as scale from active group by 1", ["active"], once=True)
t.define("station_days", "select distinct station_id, date_local, latitude, longitude from observations", ["observations"], once=True)
t.define(
    "centres",
    f"select incident_id, day, (min_lon+max_lon)/2 as clon, (min_lat+max_lat)/2 as clat, {_RADIUS}/2 as r, scale from active i join day_lat using (day)",
    ["active", "day_lat"],
    once=True,
)
t.define(
    "near_pairs",
    f"""select s.station_id, s.date_local, i.incident_id, greatest({_DIST}-r,0) as km, power((s.longitude-clon)*scale,2)+power(s.latitude-clat,2) as planar
  from station_days s join centres i on i.day=s.date_local""",
    ["station_days", "centres"],
    once=True,
)
t.define(
    "proximity",
    """select station_id, date_local, min(km) as km, min(km) filter (rn<=8) as km8 from (
  select *, row_number() over (partition by station_id, date_local order by planar, incident_id) as rn from near_pairs) group by 1,2""",
    ["near_pairs"],
    once=True,
)
t.define("proximity_exact", "select station_id, date_local, min(km) as km from near_pairs group by 1,2", ["near_pairs"])
_BIN = "case when {c}<=30 then '<=30' when {c}<=100 then '30-100' else '>100' end"


@query(
    "proximity_bins",
    "D8 D7",
    t.with_tables(
        "proximity",
        f"select station_id, date_local, {_BIN.format(c='km8')} as fire_proximity_bin from observations left join proximity using (station_id, date_local)",
    ),
)
def proximity_bins(spark, sf):
    out = spatial.proximity_bins(observations(spark, sf), t.incidents(spark, sf), k=8)
    return out.select("station_id", "date_local", "fire_proximity_bin")


@query(
    "proximity_bins_exact",
    "D8",
    t.with_tables(
        "proximity_exact observations",
        f"select station_id, date_local, {_BIN.format(c='km')} as fire_proximity_bin from observations left join proximity_exact using (station_id, date_local)",
    ),
)
def proximity_bins_exact(spark, sf):
    out = spatial.proximity_bins(observations(spark, sf), t.incidents(spark, sf), k=None)
    return out.select("station_id", "date_local", "fire_proximity_bin")


@query(
    "active_incident_days",
    "D7",
    t.with_tables("active", "select day, count(*) as incidents, round(avg((min_lat+max_lat)/2),6) as mean_lat from active group by 1"),
)
def active_incident_days(spark, sf):
    days = spatial.active_days(t.incidents(spark, sf))
    out = days.groupBy("day").agg(F.count("*").alias("incidents"), F.avg((F.col("min_lat") + F.col("max_lat")) / 2).alias("mean_lat"))
    return t.rounded(out)


# Predictors for the metrics: arithmetic on the observation, missing on every 11th row.
PREDICTORS = "case when l_partkey%11<>0 then pm25_value*0.8e0+l_linenumber*2 end as pred_a, cast((l_partkey*37)%100 as double) as pred_b"
t.define(
    "judged",
    f"""select *, {PREDICTORS}, year(date_local) as yr, case when month(date_local) in (12,1,2) then 'winter' else 'spring' end as season,
  case state_name when 'Oregon' then 'EPA-10' when 'Texas' then 'EPA-6' when 'Ohio' then 'EPA-5' when 'California' then 'EPA-9' else 'EPA-unknown' end as epa_region,
  {_BIN.format(c='km8')} as fire_proximity_bin from observations left join proximity using (station_id, date_local)""",
    ["observations", "proximity"],
)
t.define(
    "long_judged",
    """select 'pred_a' as predictor, pm25_value as y, pred_a as p, yr, season, state_name, epa_region, fire_proximity_bin from judged where pred_a is not null
  union all select 'pred_b', pm25_value, pred_b, yr, season, state_name, epa_region, fire_proximity_bin from judged where pred_b is not null""",
    ["judged"],
)


def metric_sql(source: str, groups: str) -> str:
    """Regression metrics in SQL over source(groups, y, p)."""
    over = f"partition by {groups}" if groups else ""
    by = f"group by {groups}" if groups else ""
    head = f"{groups}, " if groups else ""
    return f"""select {head}count(*) as n, round(avg(abs(p-y)),5) as mae, round(sqrt(avg((p-y)*(p-y))),5) as rmse, round(avg(p-y),5) as bias,
      round(case when count(*)>=2 then covar_pop(y,p)/nullif(sqrt(var_pop(y)*var_pop(p)),0) end,5) as pearson_r,
      round(case when count(*)>=2 then covar_pop(ry,rp)/nullif(sqrt(var_pop(ry)*var_pop(rp)),0) end,5) as spearman_r,
      round(case when var_pop(y)*count(*)>=1e-12 then 1-sum((p-y)*(p-y))/nullif(var_pop(y)*count(*),0) end,5) as r2,
      round(case when var_pop(y)*count(*)>=1e-12 then covar_pop(y,p)/nullif(var_pop(y),0) end,5) as slope,
      round(case when var_pop(y)*count(*)>=1e-12 then avg(p)-covar_pop(y,p)/nullif(var_pop(y),0)*avg(y) end,4) as intercept
      from (select *, rank() over ({over} order by y) + (count(*) over (partition by {head}y)-1)/2 as ry,
        rank() over ({over} order by p) + (count(*) over (partition by {head}p)-1)/2 as rp from {source}) {by}"""


def rounded_metrics(df):
    fine = ["mae", "rmse", "bias", "pearson_r", "spearman_r", "r2", "slope"]
    out = df.select(*[(F.round(c, 5) + 0.0).alias(c) if c in fine else F.col(c) for c in df.columns])
    return out.withColumn("intercept", F.round("intercept", 4) + 0.0)


def judged(spark, sf):
    near = spatial.proximity_bins(observations(spark, sf), t.incidents(spark, sf), k=8)
    return metrics.add_strata(near.selectExpr("*", *t._columns(PREDICTORS)))


@query("regression_metrics", "E2 F11", t.with_tables("observations", metric_sql(f"(select pm25_value as y, pred_a as p from (select *, {PREDICTORS} from observations) where pred_a is not null)", "")))
def regression_metrics(spark, sf):
    rows = observations(spark, sf).selectExpr("*", *t._columns(PREDICTORS))
    return rounded_metrics(metrics.regression_metrics(rows, [], "pm25_value", "pred_a"))


t.define(
    "stacked",
    """select predictor, 'overall' as group_name, 'overall' as group_value, y, p from long_judged
  union all select predictor, 'year', cast(yr as varchar), y, p from long_judged union all select predictor, 'season', season, y, p from long_judged
  union all select predictor, 'state', state_name, y, p from long_judged union all select predictor, 'epa_region', epa_region, y, p from long_judged
  union all select predictor, 'fire_proximity_bin', fire_proximity_bin, y, p from long_judged""",
    ["long_judged"],
)


@query("stratified_metrics", "E3 J4 B4 B5", t.with_tables("stacked", metric_sql("stacked", "predictor, group_name, group_value")))
def stratified_metrics(spark, sf):
    return rounded_metrics(metrics.stratified_metrics(stage(judged(spark, sf)), "pm25_value", ["pred_a", "pred_b"]))


@query(
    "raw_and_log_metrics",
    "E4 J4",
    t.with_tables(
        "long_judged",
        metric_sql(
            """(select predictor, 'raw' as transform, y, p from long_judged union all
            select predictor, 'log1p', ln(1+y), ln(1+p) from long_judged where y>-0.999999 and p>-0.999999)""",
            "predictor, transform",
        ),
    ),
)
def raw_and_log_metrics(spark, sf):
    rows = observations(spark, sf).selectExpr("*", *t._columns(PREDICTORS))
    return rounded_metrics(metrics.overall_metrics(rows, "pm25_value", ["pred_a", "pred_b"]))


def _dist_sql():
    parts = ["predictor", "count(*) as n"]
    for name, c in (("pm25", "y"), ("pred", "p"), ("residual", "p-y")):
        parts += [f"round(avg({c}),5) as {name}_mean", f"round(stddev_pop({c}),5) as {name}_std"]
        parts += [f"round(quantile_cont({c},{q / 100}),5) as {name}_p{q}" for q in (50, 90, 95, 99)]
    for level in (35, 55):
        parts += [f"round(avg(({c}>{level})::int),5) as {n}_over_{level}_frac" for n, c in (("pm25", "y"), ("pred", "p"))]
    return "select " + ", ".join(parts) + " from long_judged group by 1"


@query("prediction_distribution", "E5 J4", t.with_tables("long_judged", _dist_sql()))
def prediction_distribution(spark, sf):
    rows = observations(spark, sf).selectExpr("*", *t._columns(PREDICTORS))
    return t.rounded(metrics.distribution(rows, "pm25_value", ["pred_a", "pred_b"]), 5)


@query(
    "rank_auc",
    "I3",
    """select source, cast(sum(quality) as bigint) as n_pos, cast(count(*)-sum(quality) as bigint) as n_neg,
    round((sum(r) filter (quality=1) - sum(quality)*(sum(quality)+1)/2)/nullif(sum(quality)*(count(*)-sum(quality)),0),6) as auc
    from (select source, quality, rank() over (partition by source order by n_chars) + (count(*) over (partition by source, n_chars)-1)/2 as r
    from labels join documents using (doc_id)) group by 1""",
)
def rank_auc(spark, sf):
    rows = t.read(spark, sf, "labels").join(t.read(spark, sf, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return t.rounded(metrics.rank_auc(rows, ["source"], "quality", "n_chars"))
