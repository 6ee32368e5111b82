"""Domain tables derived from the driver's tables, once for Spark and once as SQL for the oracle.

Every row and every column value comes from the given tables; the sizes of all domain tables grow
with them.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeframe.config import GridSpec
from plumeframe.scale import ensure_checkpoint_dir

GRID = GridSpec(x0=-2400000.0, y0=-900000.0, dx=200000.0, dy=200000.0, nx=14, ny=12)
RUN_START, RUN_END = dt.date(2024, 1, 1), dt.date(2024, 1, 31)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table with zone-less times read as UTC instants."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.select(*[F.col(c).cast("timestamp").alias(c) if c in zoneless else F.col(c) for c in df.columns])


def plain_times(df: DataFrame) -> DataFrame:
    """Times without zone for the comparison with the other engine."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show; times without zone."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return plain_times(
        df.select(*[(F.round(c, digits) + 0.0).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, for queries that write and read back."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def zipped(members: DataFrame) -> DataFrame:
    """``path, content`` of zip archives: ``members`` has ``path, member, header, line``; a member is its header and its lines."""
    import io
    import zipfile

    import pandas as pd

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        body = io.BytesIO()
        with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("readme.txt", "no table")
            for name, part in rows.groupby("member"):
                archive.writestr(name, "\n".join([part["header"].iloc[0], *part["line"]]) + "\n")
        return pd.DataFrame({"path": [rows["path"].iloc[0]], "content": [body.getvalue()]})

    return members.groupBy("path").applyInPandas(pack, "path string, content binary")


def csv_lines(df: DataFrame, path, member: str, columns: list[str]) -> DataFrame:
    """Rows as CSV lines of a member, columns in the given order, all quoted."""
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    header = ",".join(f'"{c}"' for c in columns)
    return df.select(path.cast("string").alias("path"), F.lit(member).alias("member"), F.lit(header).alias("header"), F.concat_ws(",", *cells).alias("line"))


# ---- detections ------------------------------------------------------------------------------

CONFIDENCE = (
    "case event_type when 'error' then 'l' when 'click' then 'n' when 'view' then 'n' when 'signup' then 'h' else '85' end"
)


def detections(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").selectExpr(
        "event_id as det_id",
        "ts as acq_ts",
        "cast(ts as date) as acq_day",
        "date_trunc('hour', ts) as hour_utc",
        "value as frp",
        "-124+((event_id*7919)%2000)/1e2 as lon",
        "32+((event_id*104729)%1600)/1e2 as lat",
        f"{CONFIDENCE} as confidence",
        "case when hour(ts) between 6 and 17 then 'D' else 'N' end as daynight",
    )


INCIDENT_SHAPE = """c_custkey as incident_id, c_name as name, n_name as state, c_mktsegment as cause_general,
  -124+((c_custkey*6151)%2000)/1e2 as cx, 32+((c_custkey*3079)%1600)/1e2 as cy, 0.2037e0+(c_custkey%7)/1e1 as hs,
  cast(1000+(c_custkey*3571)%150000 as double) as size_acres, c_custkey%2=1 as is_diamond"""


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Perimeters around customers: odd keys are diamonds, even keys are boxes."""
    customer, nation = read(spark, sf, "customer"), read(spark, sf, "nation")
    base = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        *_columns(INCIDENT_SHAPE),
        "date_add(date'2024-01-01', cast(c_custkey%25 as int)) as start_date",
        "date_add(date'2024-01-01', cast(c_custkey%25+c_custkey%9 as int)) as end_date",
    )

    def corner(x: str, y: str) -> str:
        return f"named_struct('x', {x}, 'y', {y})"

    box = [corner("cx-hs", "cy-hs"), corner("cx+hs", "cy-hs"), corner("cx+hs", "cy+hs"), corner("cx-hs", "cy+hs")]
    diamond = [corner("cx", "cy-hs"), corner("cx+hs", "cy"), corner("cx", "cy+hs"), corner("cx-hs", "cy")]
    rings = "case when is_diamond then array(array({})) else array(array({})) end"
    return base.selectExpr(
        "incident_id", "name", "state", "cause_general", "size_acres", "start_date", "end_date",
        "cx-hs as min_lon", "cy-hs as min_lat", "cx+hs as max_lon", "cy+hs as max_lat",
        rings.format(", ".join([*diamond, diamond[0]]), ", ".join([*box, box[0]])) + " as rings",
    )


def _columns(text: str) -> list[str]:
    out, depth, current = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(current.strip())
            current = ""
        else:
            current += ch
    return [*out, current.strip()]


SQL = {
    "detections": f"""select event_id as det_id, ts as acq_ts, cast(ts as date) as acq_day,
  date_trunc('hour', ts) as hour_utc, value as frp, -124+((event_id*7919)%2000)/1e2 as lon,
  32+((event_id*104729)%1600)/1e2 as lat, {CONFIDENCE} as confidence,
  case when hour(ts) between 6 and 17 then 'D' else 'N' end as daynight from events""",
    "incidents": f"""select *, cx-hs as min_lon, cy-hs as min_lat, cx+hs as max_lon, cy+hs as max_lat from (
  select {INCIDENT_SHAPE}, date '2024-01-01' + cast(c_custkey%25 as integer) as start_date,
  date '2024-01-01' + cast(c_custkey%25+c_custkey%9 as integer) as end_date
  from customer join nation on c_nationkey=n_nationkey)""",
    "pairs": """select d.*, i.*, greatest(i.end_date-i.start_date+1, 1) as duration,
  greatest(i.start_date-d.acq_day, d.acq_day-i.end_date, 0) as off_days
  from detections d join incidents i on d.lon between i.min_lon and i.max_lon and d.lat between i.min_lat and i.max_lat
  and ((i.is_diamond and abs(d.lon-i.cx)+abs(d.lat-i.cy) < i.hs)
       or (not i.is_diamond and abs(d.lon-i.cx) < i.hs and abs(d.lat-i.cy) < i.hs))""",
    "assigned": """select * exclude (rn),
  case when acq_day < start_date then 'pre' when acq_day > end_date then 'post' else 'in' end as phase from (
  select *, row_number() over (partition by det_id order by size_acres, duration, incident_id) as rn
  from pairs where off_days <= 2) where rn = 1""",
    "pixels": """select *, case when size_acres<5000 then '1k-5k' when size_acres<20000 then '5k-20k'
  when size_acres<100000 then '20k-100k' else '100k+' end as size_bucket,
  cast(greatest(least(floor((acq_day-start_date)/greatest(duration-1,1)*10),9),0) as integer) as rel_bin
  from assigned where phase='in'""",
}

DEPENDS = {
    "pairs": ["detections", "incidents"],
    "assigned": ["pairs"],
    "pixels": ["assigned"],
}


#: Tables that an engine should compute once, also where it would rather repeat them.
ONCE: set[str] = set()


def define(name: str, sql: str, depends: list[str] | None = None, once: bool = False) -> None:
    if once:
        ONCE.add(name)
    SQL[name] = sql
    DEPENDS[name] = depends or []


def with_tables(names: str, body: str) -> str:
    """SQL that defines the named domain tables (and what they need) before ``body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in DEPENDS.get(name, []):
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    return "with " + ",\n".join(f"{n} as {'materialized ' if n in ONCE else ''}({SQL[n]})" for n in order) + "\n" + body
