"""Queries for set operations, files and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumeframe.catalog import tables as t
from plumeframe.catalog.detections import pixels, stats
from plumeframe.catalog.grids import cells, shape
from plumeframe.catalog.models import sample_index
from plumeframe.catalog.registry import query
from plumeframe.catalog.scalars import features
from plumeframe.functions import geo
from plumeframe.operators import incidents as inc
from plumeframe.operators import spatial
from plumeframe.sources import readers, sinks


@query(
    "union_by_name",
    "G1",
    t.with_tables(
        "incidents",
        """select incident_id, 'A' as provider, size_acres, state, null::varchar as irwin_id from incidents where incident_id%2=0
        union all select incident_id, 'B', size_acres, null, 'i'||incident_id from incidents where incident_id%2=1""",
    ),
)
def union_by_name(spark, sf):
    rows = t.incidents(spark, sf)
    a = rows.filter("incident_id%2=0").selectExpr("incident_id", "'A' as provider", "size_acres", "state")
    b = rows.filter("incident_id%2=1").selectExpr("'B' as provider", "size_acres", "concat('i', incident_id) as irwin_id", "incident_id")
    return a.unionByName(b, allowMissingColumns=True)


@query("distinct_incident_days", "G2", t.with_tables("pixels", "select distinct incident_id, acq_day from pixels"))
def distinct_incident_days(spark, sf):
    return pixels(spark, sf).select("incident_id", "acq_day").distinct()


@query(
    "kept_incident_pixels",
    "G3",
    t.with_tables("pixels", "select det_id, incident_id from pixels where incident_id in (select incident_id from incidents where size_acres > 50000)"),
)
def kept_incident_pixels(spark, sf):
    kept = t.incidents(spark, sf).filter("size_acres > 50000").select("incident_id")
    return pixels(spark, sf).join(kept, "incident_id", "left_semi").select("det_id", "incident_id")


# ---- logs and indexes ------------------------------------------------------------------------

t.define(
    "log",
    "select event_id as seq, event_id%(select count(*)//3 from events) as sample_id, 's'||(event_id%(select count(*)//4 from events)) as sample_key, value from events",
)


def log_rows(spark, sf):
    events = t.read(spark, sf, "events")
    n = events.agg(F.count("*")).scalar()
    return events.select(
        F.col("event_id").alias("seq"),
        (F.col("event_id") % F.floor(n / 3)).alias("sample_id"),
        F.concat(F.lit("s"), F.col("event_id") % F.floor(n / 4)).alias("sample_key"),
        F.col("value").alias("size_acres"),
    )


_LATEST = """select sample_id, sample_key, seq, value as size_acres from (select *, row_number() over (partition by sample_key order by seq desc) as b from
  (select *, row_number() over (partition by sample_id order by seq desc) as a from log) where a=1) where b=1"""


@query("latest_index_rows", "F12", t.with_tables("log", _LATEST))
def latest_index_rows(spark, sf):
    return inc.latest_index(log_rows(spark, sf)).select("sample_id", "sample_key", "seq", "size_acres")


@query("sample_log_index", "A9 A10 A12 F12", t.with_tables("log", _LATEST))
def sample_log_index(spark, sf):
    """Appends a log twice, with broken lines in between, then loads the index from it."""
    path = t.scratch(spark, "log")
    rows = log_rows(spark, sf)
    sinks.append_log(rows.filter("seq%2=0"), path)
    broken = rows.filter("seq%50=0").select(F.concat(F.lit('{"sample_id": '), F.col("seq"), F.lit(', "sample_k')).alias("value"))
    broken.unionByName(rows.filter("seq%70=0").select(F.lit("[1, 2]").alias("value"))).write.mode("append").text(path)
    sinks.append_log(rows.filter("seq%2=1"), path)
    return readers.read_index(spark, f"{path}-table", path).select("sample_id", "sample_key", "seq", "size_acres")


@query(
    "hotspot_csv",
    "A3 B21 C10",
    t.with_tables(
        "detections",
        """select date_trunc('minute', acq_ts) as acq_ts, acq_day, cast(hour_utc as timestamp) as hour_utc, frp, lon, lat, confidence, daynight from detections where det_id%13<>0 and det_id%17<>0""",
    ),
)
def hotspot_csv(spark, sf):
    """Detections written as the text files they come in, read back with types."""
    path = t.scratch(spark, "archive")
    text = t.detections(spark, sf).select(
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("acq_day").alias("acq_date"),
        F.when(F.col("det_id") % 13 == 0, "2561").otherwise((F.hour("acq_ts") * 100 + F.minute("acq_ts")).cast("string")).alias("acq_time"),
        F.when(F.col("det_id") % 17 == 0, "nan").otherwise(F.col("frp").cast("string")).alias("frp"), "confidence", "daynight",
    )
    text.write.option("header", True).csv(path)
    return t.plain_times(readers.read_detections(spark, path, name_part="part"))


@query(
    "hotspot_archives",
    "A3 B21 C10",
    t.with_tables(
        "detections",
        """select date_trunc('minute', acq_ts) as acq_ts, acq_day, cast(hour_utc as timestamp) as hour_utc, frp, lon, lat, confidence, daynight from detections where det_id%13<>0""",
    ),
)
def hotspot_archives(spark, sf):
    """Zip archives of some thousand detections: two archive members in different column order, and one of another name with copies that do not count."""
    text = t.detections(spark, sf).select(
        F.floor(F.col("det_id") / 4000).alias("archive"), "det_id", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("acq_day").alias("acq_date"),
        F.when(F.col("det_id") % 13 == 0, "2561").otherwise((F.hour("acq_ts") * 100 + F.minute("acq_ts")).cast("string")).alias("acq_time"), "frp", "confidence", "daynight",
    )
    names = readers.DETECTION_SCHEMA.fieldNames()
    members = (
        t.csv_lines(text.filter("det_id % 2 = 0"), F.col("archive"), "fire_archive_a.csv", names)
        .unionByName(t.csv_lines(text.filter("det_id % 2 = 1"), F.col("archive"), "fire_archive_b.CSV", [*names[::-1], "det_id"]))
        .unionByName(t.csv_lines(text.filter("det_id % 2 = 1"), F.col("archive"), "fire_nrt_b.csv", names))
    )
    return t.plain_times(readers.detections_of(t.zipped(members), name_part="archive"))


@query(
    "cached_points",
    "A4 A11",
    t.with_tables("detections", "select acq_day, count(*) as n, round(sum(frp),6) as frp from detections group by 1"),
)
def cached_points(spark, sf):
    path = t.scratch(spark, "points")
    build = lambda: t.detections(spark, sf).select("acq_day", "frp")
    readers.load_or_build(spark, path, build)
    again = readers.load_or_build(spark, path, lambda: build().limit(0))
    return t.rounded(again.groupBy("acq_day").agg(F.count("*").alias("n"), F.sum("frp").alias("frp")))


@query(
    "perimeter_features",
    "A5 B22 C2",
    t.with_tables(
        "feature",
        """select fid as incident_id, start_date, size_acres, round(min_lon,9) as min_lon, round(max_lat,9) as max_lat from feature where size_acres >= 5000 and fid is not null""",
    ),
)
def perimeter_features(spark, sf):
    """Features written as one collection, odd ones as multi-polygons, read back in pieces and filtered."""
    path = t.scratch(spark, "features")
    rows = features(spark, sf)
    names = [c for c in readers.PROPERTIES if c in rows.columns]
    rings = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    multi = F.col("seq") % 2 == 1
    text = F.when(multi, F.to_json(F.array(rings))).otherwise(F.to_json(rings))
    line = F.concat(
        F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*names)), F.lit(',"geometry":{"type":"'),
        F.when(multi, "MultiPolygon").otherwise("Polygon"), F.lit('","coordinates":'), text, F.lit("}}"),
    )
    # The collection's head and end are rows of their own; one task writes one file.
    ends = spark.createDataFrame([(0, '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"x"}},"features":['), (2, "]}")], "at int, value string")
    first = rows.agg(F.min("seq")).scalar()
    body = rows.select(F.lit(1).alias("at"), F.concat(F.when(F.col("seq") == first, "").otherwise(","), line).alias("value"), "seq")
    ordered = ends.withColumn("seq", F.lit(None).cast("bigint")).unionByName(body).coalesce(1).sortWithinPartitions("at", "seq")
    ordered.select("value").write.text(path)
    out = inc.analytic_incidents(readers.read_perimeters(spark, path), 2024, 2024, 5000.0)
    return t.rounded(out.select("incident_id", "start_date", "size_acres", "min_lon", "max_lat"), 9)


@query(
    "report_files",
    "A13 F27",
    t.with_tables("stats", "select incident_id, pixels_in_window_anyconf, round(frp_sum_in_window,3) as frp_sum_in_window from stats where pixels_in_window_anyconf>0"),
)
def report_files(spark, sf):
    folder = t.scratch(spark, "report")
    table = stats(spark, sf).select("incident_id", "pixels_in_window_anyconf", F.round("frp_sum_in_window", 6).alias("frp_sum_in_window"))
    table = table.filter("pixels_in_window_anyconf > 0")
    summary = table.agg(F.count("*").alias("incidents"))
    sinks.write_report({"incidents": table, "summary": summary}, folder, ["summary"], {"incidents": ["incident_id"]})
    schema = "incident_id bigint, pixels_in_window_anyconf bigint, frp_sum_in_window double"
    rows = spark.read.schema(schema).option("header", True).csv(f"{folder}/incidents")
    count = spark.read.schema("incidents bigint").json(f"{folder}/summary").agg(F.sum("incidents")).scalar()
    return t.rounded(rows.filter(count > 0), 3)


@query(
    "tensor_table",
    "A14 A15 L6",
    t.with_tables(
        "cells shape",
        """select split, sample, channel, cast(max(h*8) as integer) as size, round(sum(value),4) as total from (select *, case when sample%10<7 then 'train' else 'test' end as split from cells), shape
        where channel<>'VGRD' and sample%4<>3 group by 1,2,3""",
    ),
)
def tensor_table(spark, sf):
    """Cells packed to dense tensors, written in two appends, aligned with an index of some samples."""
    path = t.scratch(spark, "tensors")
    rows = cells(spark, sf).filter("channel <> 'VGRD'")
    packed = sinks.pack_cells(rows, ["sample", "channel"], shape(spark, sf)).selectExpr(
        "sample", "case when channel='LABEL' then 'label' else 'input' end as kind", "channel", "cast(0 as int) as lead_hours", "patch",
        "case when sample%10<7 then 'train' else 'test' end as split",
    )
    sinks.write_tensors(packed.filter("sample%2=0"), path)
    sinks.write_tensors(packed.filter("sample%2=1"), path, append=True)
    stored = spark.read.parquet(path)
    index = rows.filter("sample%4<>3").select("sample").distinct()
    total = F.aggregate("patch", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    out = sinks.align_tensors(stored, index, "sample").select("split", "sample", "channel", F.size("patch").alias("size"), total.alias("total"))
    return t.rounded(out, 4)


@query(
    "pooled_index_days",
    "A10 J15",
    t.with_tables("index", "select split, count(*) as samples, count(distinct fire_id) as fires, min(run_date) as first_day, max(run_date) as last_day from index group by 1"),
)
def pooled_index_days(spark, sf):
    path = t.scratch(spark, "index")
    sinks.write_table(sample_index(spark, sf), path, ["split"])
    return readers.read_index(spark, path, f"{path}-log").groupBy("split").agg(
        F.count("*").alias("samples"), F.count_distinct("fire_id").alias("fires"), F.min("run_date").alias("first_day"), F.max("run_date").alias("last_day")
    )


@query(
    "incident_centres_in_footprint",
    "C8 B45",
    t.with_tables("incidents", "select count(*) as n, round(avg(cx),6) as lon, round(avg(cy),6) as lat from incidents where cx between -120 and -110"),
)
def incident_centres(spark, sf):
    west, south, east, north = geo.ring_bounds("rings")
    rows = t.incidents(spark, sf).select(((west + east) / 2).alias("lon"), ((south + north) / 2).alias("lat"))
    rows = rows.filter(F.round("lon", 9).between(-120, -110))
    return t.rounded(rows.agg(F.count("*").alias("n"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat")))


@query(
    "detections_near_large_incidents",
    "C6 D1 J13",
    t.with_tables("pairs", "select count(distinct det_id) as points, count(*) as pairs from pairs where size_acres > 100000"),
)
def detections_near_large(spark, sf):
    large = t.incidents(spark, sf).filter("size_acres > 100000")
    near = spatial.envelope_filter(t.detections(spark, sf), large)
    pairs = spatial.points_in_polygons(near, large, None).groupBy("det_id").agg(F.count("*").alias("n"))
    return pairs.agg(F.count("*").alias("points"), F.sum("n").alias("pairs"))
