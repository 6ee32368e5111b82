"""Files, resumable state and streams."""

from __future__ import annotations

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from plumeframe.config import Channel, GridSpec, SampleSettings, SplitDates
from plumeframe.functions import geo
from plumeframe.operators import detections, grids, overpass
from plumeframe.operators.observations import RAW_COLUMNS
from plumeframe.plans import samples, station
from plumeframe.sources import readers, sinks
from plumeframe.streaming import incremental as live

HEADER = [*RAW_COLUMNS, "Parameter Code"]
ROW = {
    "State Code": "01", "County Code": "001", "Site Num": "0001", "Parameter Code": "88101", "POC": "1", "Latitude": "38.0", "Longitude": "-120.0",
    "Parameter Name": "PM", "Sample Duration": "24 HOUR", "Pollutant Standard": "std", "Date Local": "2021-01-01", "Units of Measure": "ug/m3",
    "Event Type": "None", "Observation Count": "1", "Observation Percent": "100", "Arithmetic Mean": "10", "AQI": "20", "Method Code": "1",
    "Method Name": "M", "State Name": "Alabama", "County Name": "X", "City Name": "Y", "CBSA Name": "Z", "Date of Last Change": "2024-01-01",
}


def archive(folder, code, year, rows):
    path = folder / f"daily_{code}_{year}.zip"
    text = "\n".join([",".join(f'"{h}"' for h in HEADER), *[",".join({**ROW, "Parameter Code": code, **r}[h] for h in HEADER) for r in rows]])
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("readme.txt", "no table")
        z.writestr("first.csv", text)
        z.writestr("second.csv", "x\n1")
    return path


def test_ingest_from_archives(spark, tmp_path):
    archive(tmp_path, "88101", 2021, [{}, {"Observation Percent": "90", "POC": "2"}, {"Date Local": "1/2/2021"}, {"Parameter Code": "99999"}])
    archive(tmp_path, "88502", 2021, [{"Arithmetic Mean": "99"}, {"Site Num": "2"}])
    archive(tmp_path, "88101", 1999, [{}])
    frames = []
    for code in ("88101", "88502"):
        files = readers.select_year_files(spark, str(tmp_path), f"daily_{code}_*.zip", dt.date(2021, 1, 1), dt.date(2022, 1, 1))
        assert len(files) == 1
        frames.append(readers.read_observation_archives(spark, files, code))
    table, counts = station.ingest_observations(*frames, dt.date(2021, 1, 1), dt.date(2021, 12, 31))
    got = {(r["station_id"], r["date_local"].day): (r["pm25_value"], r["pm_source_code"]) for r in table.collect()}
    assert got == {("01-001-0001", 1): (10.0, "88101"), ("01-001-0001", 2): (10.0, "88101"), ("01-001-0002", 1): (10.0, "88502")}
    assert counts["primary_raw"].get["rows"] == 3 and counts["primary_dedup"].get["rows"] == 2 and counts["final"].get["rows"] == 3
    with pytest.raises(FileNotFoundError):
        readers.select_year_files(spark, str(tmp_path), "daily_88101_*.zip", dt.date(2010, 1, 1), dt.date(2011, 1, 1))


def test_feature_collection(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 1], [0, 0]]
    doc = {"type": "FeatureCollection", "features": [
        {"properties": {"attr_IncidentName": "One", "other": 1}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"properties": {"attr_IncidentName": "Two"}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}},
    ]}
    (tmp_path / "p.geojson").write_text(json.dumps(doc, indent=1))
    rows = {r["attr_IncidentName"]: r["rings"] for r in readers.read_perimeters(spark, str(tmp_path / "p.geojson")).collect()}
    assert len(rows["One"]) == 1 and len(rows["Two"]) == 3
    assert (rows["One"][0][1]["x"], rows["One"][0][1]["y"]) == (2.0, 0.0)


def test_csv_scan_is_pruned(spark, tmp_path):
    (tmp_path / "archive_1.csv").write_text("latitude,longitude,acq_date,acq_time,frp,confidence,daynight\n1,2,2024-01-01,5,3.5,n,D\n91,2,2024-01-01,2500,3.5,n,D\n")
    (tmp_path / "recent_1.csv").write_text("latitude,longitude,acq_date,acq_time,frp,confidence,daynight\n1,2,2024-01-01,5,3.5,n,D\n")
    rows = readers.read_detections(spark, str(tmp_path), name_part="archive")
    assert rows.count() == 1
    ids = readers.add_detection_id(rows.union(rows)).select("det_id").distinct().count()
    assert ids == 2


def test_parquet_filters_reach_the_scan(spark):
    from plumeframe.catalog import tables as t
    from plumeframe.operators import grids

    plan = t.read(spark, "/root/testdata/sf0.001", "lineitem").filter("l_quantity > 40").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    assert grids.__doc__


def test_tensor_layout_is_checked(spark, tmp_path):
    schema = "sample_key string, kind string, channel string, lead_hours int, patch array<float>, split string"
    one = spark.createDataFrame([("a", "input", "A", 0, [1.0, 2.0], "train")], schema)
    sinks.write_tensors(one, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="layout"):
        sinks.write_tensors(one.withColumn("channel", F.lit("B")), str(tmp_path / "t"), append=True)
    index = spark.createDataFrame([("a",), ("b",)], "sample_key string")
    with pytest.raises(ValueError, match="without tensors"):
        sinks.align_tensors(one, index)


# ---- state -----------------------------------------------------------------------------------


def test_station_state_resumes(spark, tmp_path):
    places = spark.createDataFrame([("s", "UTC")], "station_id string, timezone string")
    hours = [(dt.datetime(2021, 1, 1, h), 1.0, 2.0 if h != 2 else None) for h in range(4)]
    frame = lambda part: spark.createDataFrame([("s", *p) for p in part], "station_id string, hour_utc timestamp, value0 double, value1 double")
    state = live.state_path(str(tmp_path), places, run="a")
    assert state == live.state_path(str(tmp_path), places, run="a") != live.state_path(str(tmp_path), places, run="b")
    live.add_hours(frame(hours[:2]), 0, places, state)
    assert live.current_sums(spark, state).first()["n"] == 2
    # the second batch repeats an hour and is itself run twice
    for _ in range(2):
        live.add_hours(frame(hours[1:]), 1, places, state)
    got = live.current_sums(spark, state).first()
    assert (got["n"], got["sum0"], got["sum1"]) == (3, 3.0, 6.0)
    # the hour with a missing value counts as processed
    done = live.progress(spark, state, frame(hours)).first()
    assert (done["processed_hours"], done["total_hours"]) == (4, 4)


def test_resume_rules(spark):
    log = spark.createDataFrame([("k", "daily_4h_mean", "0,6")], "sample_key string, aggregation_mode string, source_hours_utc string")
    live.check_resume(log, "daily_4h_mean", (6, 0))
    with pytest.raises(ValueError, match="mode"):
        live.check_resume(log, "hourly", None)
    with pytest.raises(ValueError, match="hours"):
        live.check_resume(log, "daily_4h_mean", (0, 12))


def test_samples_resume(spark, tmp_path):
    """One incident of three days: daily samples need the next day, a second run adds only what is new."""
    grid = GridSpec(-2_400_000.0, -900_000.0, 200_000.0, 200_000.0, 14, 12)
    ring = [(-120.1, 37.9), (-119.9, 37.9), (-119.9, 38.1), (-120.1, 38.1), (-120.1, 37.9)]
    fires = spark.createDataFrame(
        [("F1", "One", "US-CA", dt.datetime(2021, 1, 1), dt.datetime(2021, 1, 3), dt.date(2021, 1, 1), dt.date(2021, 1, 3), 70.0, [ring])],
        "incident_id string, name string, state string, start_ts timestamp, end_ts timestamp, start_date date, end_date date, size_acres double,"
        " rings array<array<struct<x:double,y:double>>>",
    )
    w, so, e, n = geo.ring_bounds("rings")
    fires = fires.withColumns({"min_lon": w, "min_lat": so, "max_lon": e, "max_lat": n})
    days = spark.range(4 * 24).selectExpr("timestamp_seconds(1609459200 + id*3600) as run_time")
    cells = days.withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(13))))
    fields = cells.selectExpr("run_time", "cast(run_time as date) as run_date", "'MASSDEN' as variable", "'8m_above_ground' as level", "iy", "ix", "cast(hour(run_time) + 1 as double) as value")
    spots = spark.createDataFrame([(1, -120.0, 38.0, 5.0, dt.datetime(2021, 1, 1, 6))], "det_id bigint, lon double, lat double, frp double, hour_utc timestamp")
    splits = SplitDates(dt.date(2021, 1, 1), dt.date(2021, 1, 1), dt.date(2021, 1, 2), dt.date(2021, 1, 2), dt.date(2021, 1, 3), dt.date(2021, 1, 31))
    mass = Channel("MASSDEN", "8m_above_ground")
    settings = SampleSettings(dt.date(2021, 1, 1), dt.date(2021, 1, 31), splits, grid, (mass,), mass, patch=(4, 4), buffer_km=300.0)
    build = lambda **k: samples.build_samples(fires, fields, spots, settings, daily=True, **k)
    first = build(max_samples=1)
    assert first.index.count() == 1
    whole = build()
    rows = whole.index.orderBy("sample_id").collect()
    # the fields end on January 4, so all three days have their next day
    assert [r["sample_id"] for r in rows] == [0, 1, 2]
    assert [r["split"] for r in rows] == ["train", "val", "test"]
    assert {r["persistence_mse_t_plus_24h"] for r in rows} == {0.0} and rows[0]["advection_mse_t_plus_24h"] is None
    tensors = {(r["sample_id"], r["kind"], r["channel"]): r["patch"] for r in whole.tensors.collect()}
    assert len(tensors) == 9
    # mean of hours 0, 6, 12, 18 of value hour + 1
    assert tensors[(0, "input", "MASSDEN_8m")] == [10.0] * 16
    assert sum(tensors[(0, "input", "FRP")]) == pytest.approx(5.0 / 4) and sum(tensors[(1, "input", "FRP")]) == 0.0
    rest = build(done=first.index).index
    assert {r["sample_key"] for r in rest.collect()} == {r["sample_key"] for r in rows[1:]}
    table = str(tmp_path / "index")
    live.add_samples(first.index, 0, table)
    live.add_samples(whole.index, 1, table)
    live.add_samples(whole.index, 2, table)
    assert live.sample_table(spark, table).count() == 3
    with pytest.raises(ValueError, match="next-day"):
        build(next_day_only=False)


def test_station_daily_integration(spark):
    grid = GridSpec(-2_400_000.0, -900_000.0, 200_000.0, 200_000.0, 14, 12)
    obs = spark.createDataFrame(
        [("s", dt.date(2021, 1, 1), 38.0, -120.0, "CA", "America/Los_Angeles", 10.0)],
        "station_id string, date_local date, latitude double, longitude double, state_name string, timezone string, pm25_value double",
    )
    cells = spark.range(72).selectExpr("timestamp_seconds(1609372800 + id*3600) as run_time", "explode(sequence(0, 11)) as iy").withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(13))))
    fields = cells.selectExpr(
        "run_time", "cast(run_time as date) as run_date", "iy", "ix",
        "inline(array(named_struct('variable','MASSDEN','level','8m','value',1.0d), named_struct('variable','COLMD','level','ea','value',2.0d)))",
    )
    args = (grid, ("MASSDEN", "8m"), ("COLMD", "ea"))
    row = station.station_daily(obs, fields, *args).first()
    assert (row["massden_daily_mean"], row["colmd_daily_mean"], row["hrrr_hours_found"], row["hrrr_day_complete"]) == (1.0, 2.0, 24, True)
    part = station.station_daily(obs, fields, *args, run=(dt.date(2021, 1, 1), dt.date(2021, 1, 1)), max_hours=34).first()
    assert part["hrrr_hours_found"] == 2 and not part["hrrr_day_complete"]
    with pytest.raises(ValueError, match="duplicate"):
        station.station_daily(obs.union(obs), fields, *args)
    out = station.evaluate_accuracy(
        station.station_daily(obs, fields, *args), spark.createDataFrame([], "incident_id int, start_date date, end_date date, min_lon double, min_lat double, max_lon double, max_lat double"),
        ["massden_daily_mean"],
    )
    assert out["summary"].count() > 0 and out["distribution"].first()["n"] == 1


def test_files_with_other_headers_are_read_by_name(spark, tmp_path):
    from plumeframe.sources.readers import RAW_COLUMNS, read_detections, read_observations

    for year, names in ((2021, list(RAW_COLUMNS)), (2022, list(reversed(RAW_COLUMNS)))):
        (tmp_path / f"daily_{year}.csv").write_text(",".join(names) + "\n" + ",".join(f"{n[:3]}{year}" for n in names) + "\n")
    rows = read_observations(spark, [str(tmp_path / f"daily_{y}.csv") for y in (2021, 2022)], "88101").collect()
    assert len(rows) == 2
    assert all(r[n][:3] == n[:3] for r in rows for n in RAW_COLUMNS)
    folder = tmp_path / "spots"
    folder.mkdir()
    head = "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti5,frp,daynight,type"
    (folder / "a.csv").write_text(f"{head}\n40.5,-120.25,300,1,1,2021-07-04,0930,N,VIIRS,n,2,290,5.5,D,0\n")
    found = read_detections(spark, str(folder)).collect()
    assert [(r["lat"], r["lon"], r["frp"]) for r in found] == [(40.5, -120.25, 5.5)]


def test_station_hours_of_a_later_batch_count(spark, tmp_path):
    import datetime as dt

    from plumeframe.streaming import incremental as live

    places = spark.createDataFrame([("a", "UTC"), ("b", "UTC")], "station_id string, timezone string")
    hour = dt.datetime(2021, 7, 4, 5)
    for batch, station in enumerate("ab"):
        live.add_hours(spark.createDataFrame([(station, hour, 1.0, 2.0)], "station_id string, hour_utc timestamp, value0 double, value1 double"), batch, places, str(tmp_path))
    assert {r["station_id"]: r["n"] for r in live.current_sums(spark, str(tmp_path)).collect()} == {"a": 1, "b": 1}


def test_late_detections_reopen_their_overpass(spark, tmp_path):
    minute = lambda m: dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=m)
    arrivals = [
        [(1, 0), (1, 10), (1, 10), (1, 200), (2, 5)],
        [(1, 300), (1, 230), (2, 400), (None, 3)],
        # Late: one joins two sessions of both arrivals, one lies before all, one is a session of its own, one extends an end.
        [(1, 50), (1, 265), (2, -40), (2, 200), (1, 340), (3, 7)],
    ]
    source, state = str(tmp_path / "feed"), str(tmp_path / "state")
    schema = "incident_id bigint, acq_ts timestamp"
    seen = []
    for batch in arrivals:
        seen += batch
        spark.createDataFrame([(i, minute(m)) for i, m in batch], schema).write.mode("append").parquet(source)
        live.run_detections(spark.readStream.schema(schema).parquet(source), state)
        points = spark.createDataFrame([(i, minute(m)) for i, m in seen if i is not None], schema)
        want = overpass.overpass_events(detections.minute_counts(points))
        got = live.live_overpasses(spark, state)
        assert sorted(map(tuple, got.drop("open").select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    # The newest minute is 400: what ended before 400 - 30 - 45 is closed, at the end of the feed all is.
    assert {(r["incident_id"], r["event_idx"]) for r in got.filter("open").collect()} == {(1, 1), (2, 2)}
    assert live.live_overpasses(spark, state, ended=True).filter("open").count() == 0
    # A batch that is repeated overwrites itself.
    before = sorted(map(tuple, got.collect()))
    live.add_detections(spark.createDataFrame([(i, minute(m)) for i, m in arrivals[2]], schema), 2, state)
    assert sorted(map(tuple, live.live_overpasses(spark, state).collect())) == before


def test_detections_from_archives(spark, tmp_path):
    head = "latitude,longitude,acq_date,acq_time,frp,confidence,daynight"
    for i in range(2):
        with zipfile.ZipFile(tmp_path / f"hot_{i}.zip", "w", zipfile.ZIP_DEFLATED if i else zipfile.ZIP_STORED) as z:
            z.writestr("notes.txt", "no table")
            z.writestr(f"fire_archive_{i}a.csv", f"{head}\n" + "".join(f"1,{i},2024-01-01,5,{k},n,D\n" for k in range(3000)))
            z.writestr(f"FIRE_ARCHIVE_{i}b.CSV", "﻿extra," + ",".join(head.split(",")[::-1]) + f'\n"x, ""y""",N,h,7.5,0130,2024-01-02,{i},2\n,D,n,,5,2024-01-01,0,1\n')
            z.writestr(f"fire_nrt_{i}.csv", f"{head}\n1,2,2024-01-01,5,3.5,n,D\n")
    paths = sorted(str(p) for p in tmp_path.iterdir())
    rows = readers.read_detection_archives(spark, paths, "archive")
    assert rows.count() == 6002 and rows.filter("frp = 7.5 and confidence = 'h' and daynight = 'N' and lat = 2").count() == 2
    assert readers.archive_members(readers.archives(spark, paths)).count() == 6
    with pytest.raises(Exception, match="No other CSV found"):
        readers.read_detection_archives(spark, paths, "other").count()
    with pytest.raises(Exception, match="Missing expected columns"):
        readers.read_observation_archives(spark, paths, "88101").count()


@pytest.mark.parametrize("order", [("properties", "geometry"), ("geometry", "properties")])
def test_a_collection_is_read_by_many_tasks(spark, tmp_path, order):
    names = ["plain", 'with "quotes" and }], {', '"properties', "geometry", "é漢"]
    features = []
    for i in range(500):
        ring = [[i, 0], [i + 2, 0], [i + 2, 1], [i, 0]]
        content = {"properties": {"attr_IncidentName": names[i % 5] + str(i), "other": {"deep": [1, 2]}}, "geometry": {"type": "Polygon", "coordinates": [ring]} if i % 50 else None}
        features.append({"type": "Feature", "id": i, **{k: content[k] for k in order}})
    doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "features": features}
    path = tmp_path / "p.geojson"
    path.write_text(json.dumps(doc, ensure_ascii=False, indent=1 if order[0] == "geometry" else None))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = readers.read_perimeters(spark, str(path))
        assert rows.rdd.getNumPartitions() > 4
        got = {r["attr_IncidentName"]: r["rings"] for r in rows.collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert set(got) == {names[i % 5] + str(i) for i in range(500)}
    assert sum(r is None for r in got.values()) == 10 and got["plain10"][0][0]["x"] == 10.0


def test_availability_reads_the_catalog(spark, tmp_path):
    hour = lambda h: dt.datetime(2024, 1, 1, h, tzinfo=dt.timezone.utc)
    rows = [(hour(h), v, "8m", i, 0, float(i)) for h in range(3) for v in ("A", "B") for i in range(50) if not (h == 1 and v == "B")]
    schema = "run_time timestamp, variable string, level string, iy int, ix int, value double"
    path = str(tmp_path / "fields")
    sinks.write_fields(spark.createDataFrame(rows, schema), path)
    catalog = readers.field_catalog(spark, path)
    assert {(r["run_time"].hour, r["variable"], r["cells"]) for r in catalog.collect()} == {(h, v, 50) for h in range(3) for v in "AB" if (h, v) != (1, "B")}
    wanted = spark.createDataFrame([(hour(h), v, "8m") for h in range(4) for v in "AB"], "run_time timestamp, variable string, level string")
    have, missing = grids.split_by_availability(wanted, catalog)
    assert have.count() == 5 and {(r["run_time"].hour, r["variable"]) for r in missing.collect()} == {(1, "B"), (3, "A"), (3, "B")}
    # Runs that are written again replace themselves; others stay.
    sinks.write_fields(spark.createDataFrame([(hour(1), "B", "8m", 0, 0, 1.0), (hour(0), "A", "8m", 0, 0, 1.0)], schema), path)
    cells = {(r["run_time"].hour, r["variable"]): r["cells"] for r in readers.field_catalog(spark, path).collect()}
    assert cells == {(0, "A"): 1, (0, "B"): 50, (1, "A"): 50, (1, "B"): 1, (2, "A"): 50, (2, "B"): 50}
    assert readers.read_fields(spark, path).filter("variable = 'A'").count() == 101
