"""Rules on small literal rows, worked out by hand."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumeframe.config import Channel, GridSpec, ReductionRules, SampleSettings, SplitDates
from plumeframe.functions import geo
from plumeframe.functions import scalars as s
from plumeframe.operators import graph, grids, incidents, linkage, metrics, models, observations, overlays, overpass, spatial, stability, temporal
from plumeframe.plans import reports, samples


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_dates(spark):
    iso, us = (value(spark, s.parse_mixed_date(F.lit(x))) for x in ("2021-07-04", "7/4/2021"))
    assert iso == us == dt.date(2021, 7, 4)
    rfc = value(spark, s.parse_datetime(F.lit("Sat, 19 Nov 2022 00:52:20 GMT")))
    twelve = value(spark, s.parse_datetime(F.lit("7/1/2022 1:30:00 PM")))
    assert rfc == dt.datetime(2022, 11, 19, 0, 52, 20) and twelve == dt.datetime(2022, 7, 1, 13, 30)
    assert value(spark, s.parse_datetime(F.lit("soon"), strict=False)) is None
    with pytest.raises(Exception, match="Unable to parse datetime"):
        value(spark, s.parse_datetime(F.lit("soon")))


def test_local_day_hours(spark):
    zone = F.lit("America/Los_Angeles")
    for day, hours in ((dt.date(2021, 3, 14), 23), (dt.date(2021, 11, 7), 25), (dt.date(2021, 7, 4), 24)):
        assert value(spark, s.expected_hours(F.lit(day), zone)) == hours


def test_numbers_and_codes(spark):
    assert value(spark, s.number_from_text(F.lit(" 1,234.5 "))) == 1234.5
    assert value(spark, s.number_from_text(F.lit("nan"))) is None
    assert value(spark, s.zero_fill(F.lit("12345"), 4)) == "12345"
    assert value(spark, s.epa_region(F.lit("Oregon"))) == "EPA-10"
    assert value(spark, s.epa_region(F.lit(None).cast("string"))) == "EPA-unknown"
    assert value(spark, s.confidence_class(F.lit("79"))) == "n"
    assert value(spark, s.acquisition_time(F.lit("2024-01-02"), F.lit("7"))) == dt.datetime(2024, 1, 2, 0, 7)
    with pytest.raises(ValueError):
        s.check_hours([24])
    with pytest.raises(ValueError):
        s.check_hours([])


def test_projection_corner(spark):
    x, y = geo.project(F.lit(-122.719528), F.lit(21.138123))
    assert value(spark, x) == pytest.approx(geo.GRID_DOMAIN[0], abs=1e-3)
    assert value(spark, y) == pytest.approx(geo.GRID_DOMAIN[1], abs=1e-3)
    lon, lat = geo.unproject(x, y)
    assert value(spark, lon) == pytest.approx(-122.719528, abs=1e-9)
    assert value(spark, lat) == pytest.approx(21.138123, abs=1e-9)


SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0), (1.0, 1.0)]
RINGS = "array<array<struct<x:double,y:double>>>"


def fire(spark, rows):
    """rows of (id, rings, start, end, acres)"""
    schema = f"incident_id bigint, rings {RINGS}, start_date date, end_date date, size_acres double"
    df = spark.createDataFrame(rows, schema)
    w, so, e, n = geo.ring_bounds("rings")
    return df.withColumns({"min_lon": w, "min_lat": so, "max_lon": e, "max_lat": n, "name": F.concat(F.lit("n"), "incident_id"), "state": F.lit("OR")})


DAY = dt.date(2024, 1, 5)


def points(spark, rows):
    return spark.createDataFrame([(i, x, y, d) for i, (x, y, d) in enumerate(rows)], "det_id bigint, lon double, lat double, acq_day date")


def test_edge_and_hole_are_outside(spark):
    fires = fire(spark, [(1, [SQUARE, HOLE], DAY, DAY, 10.0)])
    pts = points(spark, [(0.5, 0.5, DAY), (0.0, 2.0, DAY), (4.0, 4.0, DAY), (2.0, 2.0, DAY), (1.0, 2.0, DAY), (3.5, 2.0, DAY), (2.0, 4.0, DAY), (9.0, 9.0, DAY)])
    got = {r["det_id"] for r in spatial.points_in_polygons(pts, fires, 0).collect()}
    assert got == {0, 5}


def test_salted_assignment_is_the_same(spark):
    rng = random.Random(3)
    fires = fire(spark, [(i, [[(x + rng.random(), y + rng.random()) for x, y in SQUARE[:4]]], DAY, DAY + dt.timedelta(i % 4), float(i % 5)) for i in range(12)])
    fires = fires.withColumn("rings", F.transform("rings", lambda r: F.concat(r, F.slice(r, 1, 1))))
    # A third of all points in one cell.
    pts = points(spark, [((2.01, 2.01) if i % 3 == 0 else (rng.uniform(0, 5), rng.uniform(0, 5))) + (DAY,) for i in range(300)])
    plain = {(r["det_id"], r["incident_id"]) for r in spatial.points_in_polygons(pts, fires, 1).collect()}
    salted = {(r["det_id"], r["incident_id"]) for r in spatial.points_in_polygons(pts, fires, 1, rows_per_task=10).collect()}
    assert plain and plain == salted
    once = spatial.assign_points(pts, fires, 1).groupBy("det_id").count().filter("count > 1").count()
    assert once == 0


def test_incident_rules(spark):
    props = {
        "attr_IncidentTypeCategory": "WF", "attr_FireDiscoveryDateTime": "Fri, 01 Jul 2022 00:00:00 GMT", "attr_FireOutDateTime": None,
        "attr_ContainmentDateTime": "", "attr_ControlDateTime": None, "poly_PolygonDateTime": "Sat, 02 Jul 2022 00:00:00 GMT",
        "attr_IncidentSize": "70", "poly_GISAcres": None, "attr_UniqueFireIdentifier": "U1", "poly_IRWINID": None,
        "attr_LocalIncidentIdentifier": None, "attr_IncidentName": "One", "poly_IncidentName": None, "attr_POOState": "US-CA",
    }
    schema = ", ".join(f"{k} string" for k in props) + f", rings {RINGS}"
    rows = spark.createDataFrame([(*props.values(), [[(-120.1, 37.9), (-119.9, 37.9), (-119.9, 38.1), (-120.1, 37.9)]])], schema)
    out = incidents.strict_incidents(rows, dt.date(2022, 1, 1), dt.date(2022, 12, 31), 50.0).collect()
    assert len(out) == 1 and out[0]["end_ts"] == dt.datetime(2022, 7, 2) and out[0]["max_lat"] == 38.1
    assert incidents.strict_incidents(rows, dt.date(2022, 1, 1), dt.date(2022, 12, 31), 71.0).isEmpty()


def test_dedupe(spark):
    schema = "station_id string, date_local date, observation_percent double, poc_numeric double, date_last_change timestamp, arithmetic_mean double, seq int"
    rows = [("s", DAY, 90.0, 2.0, None, 1.0, 1), ("s", DAY, 95.0, 5.0, None, 2.0, 2), ("s", DAY, 95.0, 1.0, None, 12.0, 3), ("s", DAY, None, 0.0, None, 4.0, 4)]
    primary = observations.best_monitor(spark.createDataFrame(rows, schema))
    assert [r["poc_numeric"] for r in primary.collect()] == [1.0]
    fallback = spark.createDataFrame([("s", DAY, 100.0, 1.0, None, 99.0, 1), ("t", DAY, 1.0, 1.0, None, 7.0, 2)], schema)
    both = {r["station_id"]: r["arithmetic_mean"] for r in observations.best_source(primary, fallback).collect()}
    assert both == {"s": 12.0, "t": 7.0}
    with pytest.raises(ValueError, match="duplicate"):
        observations.require_unique(spark.createDataFrame(rows, schema), ["station_id", "date_local"])
    with pytest.raises(ValueError, match="empty"):
        observations.require_rows(fallback.limit(0), "table")
    with pytest.raises(ValueError, match="Missing"):
        observations.rename_required(fallback, {"nope": "x"})


def test_day_axis(spark):
    fires = spark.createDataFrame([(1, dt.date(2021, 1, 1), dt.date(2021, 1, 3))], "incident_id int, start_date date, end_date date")
    days = lambda **k: [r["day"].day for r in temporal.incident_days(fires, dt.date(2021, 1, 1), dt.date(2021, 1, 3), **k).orderBy("day").collect()]
    assert days(require_next_day=True) == [1, 2]
    assert days(require_next_day=False) == [1, 2, 3]
    assert days(require_next_day=False, cap=2) == [1, 2] and days(require_next_day=False, max_days=1) == [1]


def test_stability_of_a_hand_series(spark):
    counts = [0, 4, 2, 0, 3, 3, 5]
    first = dt.date(2024, 1, 1)
    rows = [(1, first + dt.timedelta(i), c, i) for i, c in enumerate(counts)]
    panel = spark.createDataFrame(rows, "incident_id int, day date, pixel_count long, day_of_fire int").withColumns(
        {"size_acres": F.lit(6000.0), "size_bucket": F.lit("5k-20k"), "active_window_days": F.lit(7), "rel_progress": F.lit(0.0), "rel_bin20": F.lit(0)}
    )
    panel = stability.add_transitions(panel, "pixel_count", "pix")
    classes = [r["c"] for r in panel.orderBy("day").select(stability.transition_class().alias("c")).collect()]
    assert classes == ["first_day", "start_from_zero", "partial_drop", "drop_to_zero", "start_from_zero", "stable_positive", "increase_positive"]
    drops = stability.drop_events(panel, "pixel_count", "pix", "pixels").orderBy("day").collect()
    assert [r["day_of_fire"] for r in drops] == [2, 3]
    assert [r["rebound_next_day"] for r in drops] == [False, True]
    assert [r["rebound_within_3d"] for r in drops] == [True, True]
    assert [r["recover_pre_drop_within_3d"] for r in drops] == [False, True]
    assert [r["recover_pre_drop_within_7d"] for r in drops] == [True, True]
    streak = stability.drop_streaks(panel, "pixel_count", "pix", "pixels").collect()
    assert [(r["streak_len_days"], r["drop_from"], r["drop_to"]) for r in streak] == [(2, 4.0, 0.0)]


def test_overpass_gap(spark):
    week = overpass.MINUTES_PER_CHUNK
    minutes = [0, 45, 91, week - 10, week + 20, week + 66]
    rows = spark.createDataFrame([(1, m, 1) for m in minutes], "incident_id int, minute_int bigint, pixel_count bigint")
    out = overpass.overpass_events(rows, 45).orderBy("event_idx").collect()
    assert [(r["event_start_minute"], r["event_end_minute"]) for r in out] == [(0, 45), (91, 91), (week - 10, week + 20), (week + 66, week + 66)]
    assert [r["event_idx"] for r in out] == [0, 1, 2, 3]


def test_auc_and_metrics(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, 0.3)], "y int, p double")
    # pairs won 4.5 of 6
    assert metrics.rank_auc(rows, [], "y", "p").first()["auc"] == pytest.approx(0.75)
    flat = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "y double, p double")
    got = metrics.regression_metrics(flat, [], "y", "p").first()
    assert got["mae"] == 1.0 and got["r2"] is None and got["pearson_r"] is None and got["spearman_r"] is None
    line = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(6)], "y double, p double")
    got = metrics.regression_metrics(line, [], "y", "p").first()
    assert got["slope"] == pytest.approx(2.0) and got["intercept"] == pytest.approx(1.0) and got["spearman_r"] == pytest.approx(1.0)


GRID = GridSpec(0.0, 0.0, 1.0, 1.0, 3, 3)


def test_bilinear(spark):
    cells = [("r", iy, ix, None if (iy, ix) == (2, 2) else float(10 * iy + ix)) for iy in range(3) for ix in range(3)]
    fields = spark.createDataFrame(cells, "run_time string, iy int, ix int, value double")
    pts = spark.createDataFrame([("a", 0.5, 0.5), ("b", 2.0, 0.25), ("c", 2.1, 0.0), ("d", 1.5, 1.5)], "station_id string, x double, y double")
    got = {r["station_id"]: r["value"] for r in grids.bilinear_sample(pts, fields, GRID).collect()}
    assert got == {"a": 5.5, "b": 4.5}


def test_raster_sum_and_rounding(spark):
    pts = spark.createDataFrame(
        [(0.0, 0.0, 1.0), (10.0, 10.0, 2.0), (5.0, 5.0, 4.0), (10.1, 0.0, 8.0), (2.5, 0.0, 16.0)], "x double, y double, frp double"
    ).selectExpr("1 as k", "*", "0.0d as xmin", "0.0d as ymin", "10.0d as xmax", "10.0d as ymax")
    got = {(r["iy"], r["ix"]): r["value"] for r in grids.rasterize_lattice(pts, ["k"], (3, 3)).collect()}
    # 2.5 of 10 on three columns is 0.5, which rounds to the even 0
    assert got == {(0, 0): 17.0, (2, 2): 2.0, (1, 1): 4.0}


def test_shift_and_mse(spark):
    cells = spark.createDataFrame([(1, iy, ix, float(iy * 2 + ix)) for iy in range(2) for ix in range(2)], "k int, iy int, ix int, value double")
    moved = {(r["iy"], r["ix"]): r["value"] for r in grids.shift_cells(cells, 1, 0, (2, 2)).collect()}
    assert moved == {(1, 0): 0.0, (1, 1): 1.0}
    error = grids.patch_mse(grids.shift_cells(cells, 1, 0, (2, 2)), cells, ["k"], "e").first()["e"]
    assert error == pytest.approx((0 + 1 + 4 + 4) / 4)


def reflected_blur(a: np.ndarray, sigma: float) -> np.ndarray:
    w = np.array(grids.gaussian_weights(sigma))
    r = len(w) // 2
    for axis in (0, 1):
        padded = np.pad(a, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="symmetric")
        a = np.apply_along_axis(lambda v: np.convolve(v, w[::-1], mode="valid"), axis, padded)
    return a


def test_gaussian_equals_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.random((9, 11))
    cells = spark.createDataFrame([(1, i, j, float(a[i, j])) for i in range(9) for j in range(11)], "k int, iy int, ix int, value double")
    want = reflected_blur(a, 1.0)
    for sigma in (1.0, F.lit(1.0)):
        got = np.zeros_like(a)
        for row in grids.gaussian_blur(cells, ["k"], (9, 11), sigma).collect():
            got[row["iy"], row["ix"]] = row["value"]
        assert np.allclose(got, want)


def test_mean_patches(spark):
    rows = [("a", [1.0, 2.0, 3.0, 4.0]), ("a", [3.0, 4.0, 5.0, 6.0]), ("b", [1.0, 1.0, 1.0, 1.0])]
    out = grids.mean_patches(spark.createDataFrame(rows, "k string, patch array<double>"), ["k"], 2).collect()
    assert [(r["k"], r["patch"]) for r in out] == [("a", [2.0, 3.0, 4.0, 5.0])]


def test_reduction_order(spark):
    fires = spark.createDataFrame([(i, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9)) for i in range(5)], "incident_id int, start_ts timestamp, end_ts timestamp")
    channels = [Channel("MASSDEN", "8m_above_ground"), Channel("TMP", "700mb")]
    plan = lambda gb: samples.plan_reduction(fires, channels, 1, (256, 256), ReductionRules(budget_gb=gb, cap_samples_per_incident=10))
    assert plan(100).actions == () and plan(100).samples == 5 * 193
    assert plan(0.36).actions == ("drop_upper_air_and_dzdt",)
    tight = plan(0.001)
    assert tight.cap_samples == 10 and tight.samples == 50 and len(tight.actions) == 3


def test_reports_keep_the_widest_incidents(spark):
    ring = [[(-110.0, 40.0), (-104.0, 40.0), (-104.0, 41.0), (-110.0, 41.0), (-110.0, 40.0)]]
    fires = fire(spark, [(1, ring, DAY, DAY + dt.timedelta(19), 90_000.0)])
    hits = [(1, 0, -109.9, 100.0), (2, 16, -104.1, 5.0)]
    rows = [(i, x, 40.5, frp, dt.datetime(2024, 1, 5, 6) + dt.timedelta(day), DAY + dt.timedelta(day)) for i, day, x, frp in hits]
    found = spark.createDataFrame(rows, "det_id bigint, lon double, lat double, frp double, hour_utc timestamp, acq_day date")
    out = reports.late_stage_report(found, fires, min_daily=1)
    totals = [(r["incident_id"], r["cumulative_total_frp"], r["recent_window_total_frp"]) for r in out["totals"].collect()]
    assert totals == [(1, 105.0, 5.0)]
    (a, b) = sorted(r["ix"] for r in out["cumulative"].collect())
    assert b - a > 768 and reports.incident_grids(fires, 30.0, 375.0, 768).count() == 0


# ---- linkage ---------------------------------------------------------------------------------


def greedy_ids(left, right):
    """left, right: (id, key, day, size) - the sequential rule."""
    order = lambda r: (r[2], -r[3], r[0])
    free, out = sorted(right, key=order), set()
    for row in sorted(left, key=order):
        near = [r for r in free if r[1] == row[1]]
        if near:
            pick = min(near, key=lambda r: abs(r[2] - row[2]))
            free.remove(pick)
            out.add((row[0], pick[0]))
    return out


def test_exact_ids_against_the_sequential_rule(spark):
    rng = random.Random(7)
    side = lambda base, n: [(base + i, f"g{rng.choice([0, 0, 1, 2])}", rng.randrange(12), float(base + i)) for i in range(n)]
    left, right = side(0, 60), side(1000, 50)
    frame = lambda rows: spark.createDataFrame(
        [(i, k, dt.date(2024, 1, 1) + dt.timedelta(d), z) for i, k, d, z in rows], "incident_id bigint, irwin_id string, start_date date, size_acres double"
    )
    got = {(r["left_id"], r["right_id"]) for r in linkage.match_exact_ids(frame(left), frame(right)).collect()}
    assert got == greedy_ids(left, right)


def test_greedy_matching_against_the_sequential_rule(spark):
    rng = random.Random(5)
    edges = {(f"l{rng.randrange(15)}", f"r{rng.randrange(15)}"): (rng.randrange(40) / 40, 0.5, rng.randrange(3)) for _ in range(90)}
    n_left, n_right = ({f"{p}{i}": rng.randrange(1, 4) for i in range(15)} for p in "lr")
    rows = [(a, b, *e) for (a, b), e in edges.items()]
    left, right, want = dict(n_left), dict(n_right), {}
    for a, b, score, overlap, diff in sorted(rows, key=lambda r: (-r[2], -r[3], r[4], r[0], r[1])):
        m = min(left[a], right[b])
        if m:
            want[(a, b)] = m
            left[a] -= m
            right[b] -= m
    sizes = [spark.createDataFrame(list(n.items()), "key string, n bigint") for n in (n_left, n_right)]
    df = spark.createDataFrame(rows, "left_key string, right_key string, match_score double, overlap_ratio double, start_diff int")
    for fold_rows in (40, 1000):
        found = linkage.match_greedy(df, *sizes, fold_rows=fold_rows).collect()
        assert {(r["left_key"], r["right_key"]): r["m"] for r in found} == want
        for side in ("left", "right"):
            spans = sorted((r[f"{side}_key"], r[f"{side}_from"], r["m"]) for r in found)
            assert all(k != a or f + m <= b for (k, f, m), (a, b, _) in zip(spans, spans[1:]))


def test_a_chain_of_falling_scores_needs_no_more_jobs(spark):
    tracker = spark.sparkContext.statusTracker()

    def jobs(n):
        rows = [(f"n{i // 2}", f"n{(i + 1) // 2}", 1.0 - i / 10_000, 0.5, 0) for i in range(n)]
        df = spark.createDataFrame(rows, "left_key string, right_key string, match_score double, overlap_ratio double, start_diff int")
        sizes = [df.select(F.col(f"{s}_key").alias("key")).distinct().withColumn("n", F.lit(1).cast("bigint")) for s in ("left", "right")]
        spark.sparkContext.setJobGroup(f"chain{n}", "")
        got = linkage.match_greedy(df, *sizes).collect()
        spark.sparkContext.setJobGroup("", "")
        assert {(r["left_key"], r["right_key"]) for r in got} == {(a, b) for a, b, *_ in rows[::2]}
        return len(tracker.getJobIdsForGroup(f"chain{n}"))

    assert jobs(1000) <= jobs(10)


def test_components_of_chains_stars_and_odd_links(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3), (500, 499), (499, 500)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {499: 499, 500: 499}
    star = spark.range(1, 50).selectExpr("0 as a", "id as b")
    assert graph.components(star, rows_per_task=5).filter("root = 0").count() == 50
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(1, 90))) for _ in range(2))
        assert linkage.common_subsequence(a, b) == slow_subsequence(a, b)


def test_copies_link_one_to_one(spark):
    """Many identical perimeters on both sides: as many pairs as the smaller side has rows."""
    ring = [[(0.01, 0.01), (1.01, 0.01), (1.01, 1.01), (0.01, 1.01), (0.01, 0.01)]]
    left = fire(spark, [(i, ring, DAY, DAY, 5.0) for i in range(30)]).withColumn("irwin_id", F.lit(None).cast("string")).withColumn("name", F.lit("same"))
    right = left.filter("incident_id < 20").withColumn("incident_id", F.col("incident_id") + 100)
    out = linkage.link_incidents(left, right, cell=0.1)
    rows = out.collect()
    assert len(rows) == 20 == len({r["left_id"] for r in rows}) == len({r["right_id"] for r in rows})
    assert {r["overlap_ratio"] for r in rows} == {1.0}


KEYED_RINGS = "key string, rings array<array<struct<x: double, y: double>>>"


def closed(*rings):
    return [[(float(x), float(y)) for x, y in [*ring, ring[0]]] for ring in rings]


def common_by_slabs(a, b) -> float:
    """Area inside both of two shapes by slabs between all corners and crossings (even-odd)."""

    def edges(rings):
        return [(*p, *q) for ring in rings for p, q in zip(ring, ring[1:]) if p[1] != q[1]]

    both = [edges(a), edges(b)]
    heights = {y for side in both for e in side for y in (e[1], e[3])}
    lines = [*both[0], *both[1]]
    for i, (x1, y1, x2, y2) in enumerate(lines):
        for x3, y3, x4, y4 in lines[i + 1 :]:
            s, t = (x2 - x1) / (y2 - y1), (x4 - x3) / (y4 - y3)
            if s != t:
                heights.add(((x3 - t * y3) - (x1 - s * y1)) / (s - t))
    heights = sorted(heights)
    area = 0.0
    for low, high in zip(heights, heights[1:]):
        y = (low + high) / 2
        cuts = sorted((x1 + (y - y1) * (x2 - x1) / (y2 - y1), side) for side in (0, 1) for x1, y1, x2, y2 in both[side] if min(y1, y2) < y < max(y1, y2))
        inside = [0, 0]
        for (x, side), (after, _) in zip(cuts, cuts[1:]):
            inside[side] ^= 1
            area += (high - low) * (after - x) * (inside[0] & inside[1])
    return area


def overlay_pairs(spark, shapes_a, shapes_b, cell):
    left, right = (spark.createDataFrame(list(s.items()), KEYED_RINGS) for s in (shapes_a, shapes_b))
    strips = [overlays.shape_strips(df, "key", cell).withColumnRenamed("key", f"{side}_key") for df, side in ((left, "left"), (right, "right"))]
    out = overlays.common_areas(*strips, ["cx", "cy"], ["left_key", "right_key"], ["left_key"], cell)
    areas = {r["key"]: r["area"] for df in (left, right) for r in overlays.shape_areas(df, "key").collect()}
    return {(r["left_key"], r["right_key"]): r["common"] for r in out.collect()}, areas


def test_common_area_whatever_the_cell_and_the_direction_of_rings(spark):
    rng = random.Random(11)
    box = lambda x, y, h: [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]
    diamond = lambda x, y, h: [(x, y - h), (x + h, y), (x, y + h), (x - h, y)]

    def star(x, y, r, n):
        turns = [(2 * math.pi * i / n, r * rng.uniform(0.3, 1)) for i in range(n)]
        ring = [(x + d * math.cos(t), y + d * math.sin(t)) for t, d in turns]
        return ring if rng.random() < 0.5 else ring[::-1]

    a = {
        "box": closed(box(-120, 40, 1)), "holed": closed(box(-120, 40, 2), box(-120, 40, 1)), "island": closed(box(-120, 40, 2), box(-120, 40, 1)[::-1], diamond(-120, 40, 0.5)),
        "tiny": closed(box(-119.99, 40.013, 0.01)), "two": closed(box(-121, 40, 0.3), diamond(-119, 40.5, 0.4)[::-1]),
        **{f"s{i}": closed(star(-120 + rng.uniform(-1, 1), 40 + rng.uniform(-1, 1), rng.uniform(0.02, 1.5), 17)) for i in range(6)},
    }
    b = {
        "box": closed(box(-119.5, 41, 1)[::-1]), "same": closed(box(-120, 40, 1)), "diamond": closed(diamond(-120, 40, 1.5)), "far": closed(box(-100, 40, 1)),
        "touch": closed(box(-118, 40, 1)), "flat": [[(-120.0, 40.0), (-119.0, 40.0), (-120.0, 40.0)]],
        **{f"t{i}": closed(star(-120 + rng.uniform(-1, 1), 40 + rng.uniform(-1, 1), rng.uniform(0.02, 1.5), 23)) for i in range(6)},
    }
    want = {(i, j): common_by_slabs(p, q) for i, p in a.items() for j, q in b.items() if j != "flat"}
    for cell in (0.05, 0.3, 7.0):
        got, areas = overlay_pairs(spark, a, b, cell)
        assert {k: got.get(k, 0.0) for k in want} == pytest.approx(want, abs=1e-9)
        assert not any(k[1] == "flat" for k in got)
    assert areas == pytest.approx({k: common_by_slabs(r, r) for k, r in {**a, **b}.items()}, abs=1e-9)


def test_a_cell_inside_a_shape_is_one_strip(spark):
    shape = {"k": closed([(0.05, 0.05), (9.95, 0.05), (9.95, 9.95), (0.05, 9.95)])}
    strips = overlays.shape_strips(spark.createDataFrame(list(shape.items()), KEYED_RINGS), "key", 1.0)
    counts = {(r["cx"], r["cy"]): r["count"] for r in strips.groupBy("cx", "cy").count().collect()}
    assert len(counts) == 100 and all(counts[x, y] == 1 for x in range(1, 9) for y in range(1, 9))


def test_shapes_below_a_lattice_cell_are_linked(spark):
    def shape(x, y, h):
        return [[(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]]

    kind = "incident_id string, key string, irwin_id string, name string, start_date date, size_acres double, rings array<array<struct<x: double, y: double>>>"
    day = dt.date(2024, 6, 1)
    # Squares of 0.02 degrees, far apart, anywhere in their cells; the last two lie in a large one and half beside each other.
    places = [(-120 + 0.37 * i, 40 + 0.113 * i, 0.01) for i in range(20)]
    a = [(f"a{i}", f"a{i}", None if i % 2 else f"i{i}", f"f{i}", day, 9.0, shape(*p)) for i, p in enumerate([*places, (-100.0, 35.0, 1.0), (-90.005, 35.0, 0.01)])]
    b = [(f"b{i}", f"b{i}", None if i % 2 else f"i{i}", f"f{i}", day, 9.0, shape(*p)) for i, p in enumerate([*places, (-100.02, 35.0, 0.01), (-89.995, 35.0, 0.01)])]
    left, right = (spark.createDataFrame(rows, kind) for rows in (a, b))
    got = {(r["left_key"], r["right_key"]): r["overlap_ratio"] for r in linkage.overlap_ratios(left, right, 10).collect()}
    want = {(f"a{i}", f"b{i}"): 0.5 if i == 21 else 1.0 for i in range(22)}
    assert got == pytest.approx(want)
    linked = linkage.link_incidents(left, right).collect()
    assert {(r["left_id"], r["right_id"]): r["overlap_ratio"] for r in linked} == pytest.approx(want)
    assert sum(r["match_method"] == "irwin_exact" for r in linked) == 11


def test_copies_of_a_shape_are_overlaid_once(spark):
    kind = "key string, start_date date, rings array<array<struct<x: double, y: double>>>"
    square = lambda x: closed([(x, 40), (x + 1, 40), (x + 1, 41), (x, 41)])
    day = dt.date(2024, 6, 1)
    a = [(f"a{i}", day, square(-120.0)) for i in range(30)] + [("late", dt.date(2024, 6, 9), square(-120.0))]
    b = [(f"b{i}", day, square(-119.5)) for i in range(20)]
    left, right = (spark.createDataFrame(rows, kind) for rows in (a, b))
    members, classes = linkage._shape_days(left, "left")
    assert classes.count() == 2 and members.count() == 31
    got = {(r["left_key"], r["right_key"]): (r["start_diff"], r["overlap_ratio"]) for r in linkage.overlap_ratios(left, right, 2).collect()}
    assert set(got) == {(f"a{i}", f"b{j}") for i in range(30) for j in range(20)} and set(got.values()) == {(0, 0.5)}


def test_wide_shapes_of_few_edges_are_cut_by_wide_cells(spark):
    ring = lambda n, r: closed([(r * math.cos(2 * math.pi * i / n), r * math.sin(2 * math.pi * i / n)) for i in range(n)])
    fit = lambda *rings: overlays.fitting_cell(spark.createDataFrame([(str(i), r) for i, r in enumerate(rings)], KEYED_RINGS), 0.05)
    assert fit(ring(4, 1.0)) == 1.6 and fit(ring(4, 0.01)) == 0.05
    assert fit(ring(2500, 1.0)) == 0.05


def test_points_inside_thin_and_scattered_perimeters(spark):
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    shapes = {
        **{i: closed([(-120, 40), (-119, 41), (-119 - 1e-4 * (i + 1), 41 + 1e-4)]) for i in range(20)},
        20: closed(box(-120, 40, 1e-4, 1e-4), box(-110, 44.9, 1e-4, 1e-4)[::-1], box(-100, 50, 1e-5, 1e-5)),
        21: closed(box(-120, 40, 4, 4), box(-119.99, 40.01, 3.98, 3.98)),
        22: closed([(0, 0), (2, 0), (2, 2), (1.9, 2), (1.9, 0.1), (0, 0.1)]),
        23: [[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0), (0.0, 0.0)]],
    }
    rows = [(i, [[(float(x), float(y)) for x, y in r] for r in rings]) for i, rings in shapes.items()]
    fires = spark.createDataFrame(rows, "incident_id long, rings array<array<struct<x: double, y: double>>>")
    for n in (1, 12):
        points = spatial.points_inside(fires, n)
        assert {r["incident_id"]: r["count"] for r in points.groupBy("incident_id").count().collect()} == {i: n for i in range(23)}
        placed = points.join(fires, "incident_id").withColumn("_e", geo.ring_edges("rings"))
        assert placed.filter(~geo.strictly_inside("lon", "lat", "_e")).count() == 0
    firsts = {r["incident_id"]: (r["lon"], r["lat"]) for r in points.filter("i = 0").collect()}
    assert firsts[0] == pytest.approx(((-120 - 119 - 119.0001) / 3, (40 + 41 + 41.0001) / 3))
    # Points follow the area: two of the scattered parts hold nearly all of them.
    many = spatial.points_inside(fires.filter("incident_id = 20"), 400).groupBy((F.col("lon") < -115).alias("west")).count().collect()
    assert all(150 < r["count"] < 250 for r in many) and sum(r["count"] for r in many) == 400


def test_wide_boxes_are_copied_into_few_cells(spark):
    rng = random.Random(6)
    begin = dt.datetime(2024, 7, 1)
    windows = [(i, x, y, x + w, y + w, begin, begin + dt.timedelta(hours=30)) for i in range(40) for x, y, w in [(rng.uniform(-120, -117), rng.uniform(38, 40), rng.choice([0.5, 1.0, 3.0]))]]
    boxes = spark.createDataFrame(windows, "box long, min_lon double, min_lat double, max_lon double, max_lat double, start_hour timestamp, end_hour timestamp")
    rows = [(i, rng.uniform(-121, -113), rng.uniform(37, 44), begin + dt.timedelta(hours=rng.randrange(-3, 40))) for i in range(400)]
    points = spark.createDataFrame(rows, "det_id long, lon double, lat double, hour_utc timestamp")
    want = {(p, b) for p, x, y, t in rows for b, w, s, e, n, t0, t1 in windows if w <= x <= e and s <= y <= n and t0 <= t <= t1}
    bounds = ("min_lon", "min_lat", "max_lon", "max_lat")
    for cell in (None, 0.25, 8.0):
        got = [(r["det_id"], r["box"]) for r in spatial.points_in_boxes(points, boxes, cell=cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    wide = spatial._box_wide_cell(boxes, bounds)
    assert wide == 2.0 or wide == 1.0
    assert spatial._box_wide_cell(boxes.filter("box < 0"), bounds) == spatial.CELL_DEGREES
    # No cell width in the call: a box of the mean width lies in a handful of cells, not in dozens.
    plan = spatial.points_in_boxes(points, boxes)._jdf.queryExecution().optimizedPlan().toString()
    assert f"/ {wide}" in plan and f"/ {spatial.CELL_DEGREES}" not in plan


def test_first_edges_come_from_a_sort_not_from_a_heap(spark, monkeypatch):
    rows = spark.createDataFrame([(i, (i * 37) % 1000 // 2) for i in range(1000)], "id int, score int").repartition(5)
    order = [F.desc("score"), F.asc("id")]
    want = sorted(((r["id"], r["score"]) for r in rows.collect()), key=lambda r: (-r[1], r[0]))
    for n in (1, 300, 999, 5000):
        got = linkage._first_rows(rows, order, n)
        assert sorted((r["id"], r["score"]) for r in got.collect()) == sorted(want[:n])
    # No step of the matching plans a limit, whose heap holds all of its rows.
    plans, staged = [], linkage.stage
    monkeypatch.setattr(linkage, "stage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or staged(df))
    edges = spark.createDataFrame([(f"n{i // 2}", f"n{(i + 1) // 2}", 1.0 - i / 100, 0.5, 0) for i in range(60)], "left_key string, right_key string, match_score double, overlap_ratio double, start_diff int")
    sizes = [edges.select(F.col(f"{s}_key").alias("key")).distinct().withColumn("n", F.lit(1).cast("bigint")) for s in ("left", "right")]
    linkage.match_greedy(edges, *sizes, fold_rows=25).count()
    assert len(plans) > 3 and not any("TakeOrderedAndProject" in p for p in plans)


def test_spans_of_one_shape_are_those_of_the_scan_and_points_need_no_window(spark):
    rings = closed([(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 3), (3, 3), (3, 1)], [(10, 10), (10.5, 10), (10, 10.5)])
    shape = spark.createDataFrame([(1, rings)], "incident_id long, rings array<array<struct<x: double, y: double>>>")
    want = sorted(tuple(r)[1:] for r in spatial.scan_spans(shape, "incident_id", 50).collect())
    x, y = (np.array([p[c] for r in rings for p in r]) for c in (0, 1))
    got = spatial._spans(x, y, np.cumsum([len(r) for r in rings]), 50)
    assert sorted((r, k, y, a, b) for (r, k, y, a, b, _) in want) == sorted(zip(*(c.tolist() for c in got[:5])))
    # Spans of all incidents were sorted twice, and each hashed every place.
    assert "Window" not in spatial.points_inside(shape, 12)._jdf.queryExecution().executedPlan().toString()
    # Rows of one id share its places, each with its own centre.
    twice = spatial.points_inside(shape.unionByName(shape), 12)
    assert sorted(r["i"] for r in twice.collect()) == [0, *range(12)]


def test_scan_spans_add_up_to_the_area(spark):
    rings = closed([(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 3), (3, 3), (3, 1)], [(10, 10), (10.5, 10), (10, 10.5)])
    rows = [(1, [[(float(x), float(y)) for x, y in r] for r in rings])]
    shape = spark.createDataFrame(rows, "incident_id long, rings array<array<struct<x: double, y: double>>>")
    spans = spatial.scan_spans(shape, "incident_id", 200)
    # Each ring's lines see their own parts: the frame of 12 and the triangle of 0.125.
    assert spans.agg(F.sum("share")).first()[0] == pytest.approx(12.125, rel=1e-9)


def test_a_hot_cell_is_quartered_and_gives_the_same_pairs(spark):
    rng = random.Random(9)
    day = dt.date(2024, 7, 1)
    points = [(i, rng.uniform(-120.24, -120.01) if i % 3 else -120.1, rng.uniform(40.01, 40.24) if i % 3 else 40.1, day) for i in range(1500)]
    points += [(5000 + i, -121 + i / 10, 39 + i / 10, day) for i in range(20)]
    places = [(rng.uniform(-120.3, -119.95), rng.uniform(39.95, 40.3), rng.choice([0.004, 0.01, 0.2])) for _ in range(80)]
    boxes = [(i, x - h, y - h, x + h, y + h, day, day, closed([(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)])) for i, (x, y, h) in enumerate(places)]
    detections = spark.createDataFrame(points, "det_id long, lon double, lat double, acq_day date")
    shapes = "incident_id long, min_lon double, min_lat double, max_lon double, max_lat double, start_date date, end_date date, rings array<array<struct<x: double, y: double>>>"
    fires = spark.createDataFrame(boxes, shapes)
    want = {(p, f) for p, x, y, _ in points for f, (cx, cy, h) in enumerate(places) if abs(x - cx) < h and abs(y - cy) < h}
    for rows, pairs in ((10**6, 10**6), (10**6, 500), (100, 2000)):
        for pad in (0, None):
            found = spatial.points_in_polygons(detections, fires, pad, rows_per_task=rows, pairs_per_task=pairs)
            got = [(r["det_id"], r["incident_id"]) for r in found.collect()]
            assert len(got) == len(set(got)) and set(got) == want
    # Quarters leave each task a share of the hot cell's pairs.
    cells = spatial.incident_cells(fires, None)
    located = detections.withColumn("_cx", F.floor(F.col("lon") / 0.25).cast("int")).withColumn("_cy", F.floor(F.col("lat") / 0.25).cast("int"))
    formed = [spatial.quartered_join(located, cells, ["_cx", "_cy"], ["det_id"], 0.25, pairs_per_task=p).count() for p in (10**9, 2000)]
    assert formed[1] < formed[0] / 2


def test_cells_of_few_and_of_many_edges_give_the_pairs_of_a_plain_test(spark):
    day = dt.date(2024, 7, 1)
    circle = lambda x, y, r, n: [(x + r * math.cos(2 * math.pi * k / n), y + r * math.sin(2 * math.pi * k / n)) for k in range(n)]
    box = lambda x, y, h: [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]
    outlines = [[circle(-110, 40, 0.7, 60)], [box(-110, 40, 0.5)], [box(-110.25, 40.25, 0.5), box(-110.25, 40.25, 0.25)], [[(-110, 39.5), (-109.5, 40), (-110, 40.5), (-110.5, 40)]], [circle(-110, 40, 0.01, 5)]]
    shapes = "incident_id long, min_lon double, min_lat double, max_lon double, max_lat double, start_date date, end_date date, rings array<array<struct<x: double, y: double>>>"
    rows = []
    for i, rings in enumerate(outlines):
        xs, ys = zip(*[p for r in rings for p in r])
        rows.append((i, min(xs), min(ys), max(xs), max(ys), day, day, [closed(r)[0] for r in rings]))
    fires = spark.createDataFrame(rows, shapes)
    # A lattice of points, so that many lie on corners, on edges and on the borders of cells.
    points = spark.createDataFrame([(i * 100 + j, -111 + i / 32, 39 + j / 32, day) for i in range(70) for j in range(70)], "det_id long, lon double, lat double, acq_day date")
    plain = points.crossJoin(fires.withColumn("_e", geo.ring_edges("rings"))).filter(geo.strictly_inside("lon", "lat", "_e"))
    want = {(r["det_id"], r["incident_id"]) for r in plain.select("det_id", "incident_id").collect()}
    for pad in (None, 0):
        got = [(r["det_id"], r["incident_id"]) for r in spatial.points_in_polygons(points, fires, pad).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    # Cells beside a shape are gone, those that it holds whole and those of few edges carry no list.
    cells = spatial._prepared_cells(fires, 0.25)
    assert cells.count() < spatial.incident_cells(fires, None).count()
    assert cells.filter("_whole").count() > 10 and cells.filter("_whole and _edges is not null").count() == 0
    assert {r[0] for r in cells.filter("_edges is not null").select("incident_id").distinct().collect()} == {0, 2}


def test_proximity_with_incidents_of_all_sizes(spark):
    rng = random.Random(3)
    day = dt.date(2024, 7, 1)
    fires = [(i, day, day, x - h, y - h, x + h, y + h) for i in range(60) for x, y, h in [(rng.uniform(-124, -104), rng.uniform(32, 48), rng.choice([0.01, 0.01, 0.2, 1.5]))]]
    fires.append((99, day, day, -116.0, 36.0, -108.0, 42.0))
    stations = [(f"s{i}", day, rng.uniform(30, 50), rng.uniform(-126, -100)) for i in range(300)]
    boxes = spark.createDataFrame(fires, "incident_id long, start_date date, end_date date, min_lon double, min_lat double, max_lon double, max_lat double")
    observations = spark.createDataFrame(stations, "station_id string, date_local date, latitude double, longitude double")

    def km(lat1, lon1, lat2, lon2):
        a, b = math.radians(lat1), math.radians(lat2)
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
        return 2 * geo.EARTH_RADIUS_KM * math.asin(math.sqrt(h))

    for chosen in (fires, fires[:-1]):
        got = spatial.proximity_bins(observations, boxes.filter(F.col("incident_id").isin([f[0] for f in chosen])))
        want = {}
        for name, _, lat, lon in stations:
            nearest = min(max(km(lat, lon, (s + n) / 2, (w + e) / 2) - km(s, w, n, e) / 2, 0) for _, _, _, w, s, e, n in chosen)
            want[name] = "<=30" if nearest <= 30 else "30-100" if nearest <= 100 else ">100"
        assert {r["station_id"]: r["fire_proximity_bin"] for r in got.collect()} == want


# ---- models ----------------------------------------------------------------------------------


def test_ridge_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = np.abs(x @ [0.3, 0.1, 1.0] + 2) + rng.random(60)
    split = ["train" if i % 3 else "test" for i in range(60)]
    rows = spark.createDataFrame([(*map(float, x[i]), [float(v) for v in x[i]], float(y[i]), float(np.log1p(y[i])), split[i], i) for i in range(60)],
                                 "a double, b double, c double, vec array<double>, y double, yl double, split string, i int")
    train = np.array([p == "train" for p in split])

    def predictions(l2):
        mu, sd = x[train].mean(0), x[train].std(0) + 1e-6
        z, t = (x - mu) / sd, np.log1p(y)
        w = np.linalg.solve(z[train].T @ z[train] + l2 * np.eye(3), z[train].T @ (t[train] - t[train].mean()))
        return z @ w + t[train].mean()

    scored, table = models.ridge(rows, "split", ["a", "b", "c"], "yl", "y", 1.0)
    assert np.allclose([r["pred_log"] for r in scored.orderBy("i").collect()], predictions(1.0))
    assert {r["split"]: r["n"] for r in table.collect()} == {"train": 40, "test": 20}
    image, _ = models.image_ridge(rows, "split", "vec", "yl", "y", 10.0)
    assert np.allclose([r["pred_log"] for r in image.orderBy("i").collect()], predictions(10.0), atol=1e-4)


def test_logistic_recovers_direction(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 2))
    p = 1 / (1 + np.exp(-(0.5 + 1.5 * x[:, 0] - x[:, 1])))
    rows = spark.createDataFrame([(float(a), float(b), int(rng.random() < q)) for (a, b), q in zip(x, p)], "a double, b double, no_viirs int")
    fit = models.fit_logistic(rows, "no_viirs", ["a", "b"])
    assert fit["a"] == pytest.approx(1.5, abs=0.4) and fit["b"] == pytest.approx(-1.0, abs=0.4)


def test_quotas(spark):
    def quotas(sizes, wanted):
        rows = models.bucket_quotas(spark.createDataFrame(list(sizes.items()), "size_bucket string, n long"), wanted).collect()
        return {r["size_bucket"]: r["quota"] for r in rows}

    assert quotas({"a": 90, "b": 9, "c": 1}, 10) == {"a": 8, "b": 1, "c": 1}
    assert quotas({"a": 5, "b": 5}, 7) == {"a": 4, "b": 3}
    assert quotas({"a": 2, "b": 50}, 40) == {"a": 2, "b": 38}


def _many_perimeters(spark, n):
    draw = random.Random(7)
    rows = []
    for i in range(n):
        x, y, h = draw.uniform(0, 2), draw.uniform(0, 2), draw.choice([0.05, 0.3, 0.75, 1.5])
        ring = [(x, y - h), (x + h, y), (x, y + h), (x - h, y), (x, y - h)] if i % 2 else [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]
        start = dt.date(2024, 1, 1) + dt.timedelta(days=draw.randrange(6))
        size = None if i % 17 == 0 else float(draw.randrange(4))
        rows.append((i, size, start, start + dt.timedelta(days=draw.randrange(4)), x - h, y - h, x + h, y + h, [[{"x": a, "y": b} for a, b in ring]]))
    schema = "incident_id int, size_acres double, start_date date, end_date date, min_lon double, min_lat double, max_lon double, max_lat double, rings array<array<struct<x:double,y:double>>>"
    points = [(i, draw.choice([draw.uniform(0, 2), 0.25 * draw.randrange(8)]), draw.uniform(0, 2), dt.date(2024, 1, 1) + dt.timedelta(days=draw.randrange(12)) if i % 9 else None) for i in range(400)]
    return spark.createDataFrame(points, "det_id int, lon double, lat double, acq_day date"), spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("policy, pad", [("size", 2), ("window", 3), ("rounded", 0), ("area", None), ("area", "panel")])
def test_assignment_by_cells_equals_the_first_of_all_pairs(spark, policy, pad):
    points, fires = _many_perimeters(spark, 150)
    panel = None
    if pad == "panel":
        pad, panel = None, fires.filter("incident_id % 3 > 0").select("incident_id", F.explode(F.sequence("start_date", "end_date")).alias("day"))
    pairs = spatial.points_in_polygons(points, fires, pad)
    if panel is not None:
        pairs = pairs.join(panel.withColumnRenamed("day", "acq_day"), ["incident_id", "acq_day"], "left_semi")
    best = Window.partitionBy("det_id").orderBy(*spatial.overlap_order(policy))
    want = pairs.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1")
    got = spatial.assign_points(points, fires, pad, policy, panel)
    rows = lambda df: sorted((r["det_id"], r["incident_id"]) for r in df.select("det_id", "incident_id").collect())
    assert rows(got) == rows(want) and len(rows(got)) > 50


def test_copies_of_an_outline_and_points_of_one_place_meet_once(spark, monkeypatch):
    """Every copy of an outline was cut into cells and every point was paired."""
    ring = lambda x: [[{"x": a, "y": b} for a, b in [(x, 0.1), (x + 0.8, 0.1), (x + 0.8, 0.9), (x, 0.9), (x, 0.1)]]]
    first = dt.date(2024, 1, 1)
    schema = "incident_id int, name string, size_acres double, start_date date, end_date date, min_lon double, min_lat double, max_lon double, max_lat double, rings array<array<struct<x:double,y:double>>>"
    rows = [(i, f"n{i}", float(50 - i // 2), first + dt.timedelta(i % 4), first + dt.timedelta(i % 4 + 2), x, 0.1, x + 0.8, 0.9, ring(x)) for i in range(100) for x in [0.1 + i % 2]]
    # An id with two outlines, a row given twice, a row without id.
    rows += [(0, "other", 0.0, first, first, 5.1, 0.1, 5.9, 0.9, ring(5.1)), rows[7], (None, "none", 0.0, first, first, 1.1, 0.1, 1.1 + 0.8, 0.9, ring(1.1))]
    fires = spark.createDataFrame(rows, schema)
    # 300 points at two places and a third one, on five days; one detection is given twice.
    at = [(i, [0.5, 1.5, 5.5][i % 3], 0.5, first + dt.timedelta(i % 5)) for i in range(300)]
    points = spark.createDataFrame([*at, at[0]], "det_id int, lon double, lat double, acq_day date")
    cut, met = [], []
    box_of_cells, quartered = spatial._box_of_cells, spatial.quartered_join
    monkeypatch.setattr(spatial, "_box_of_cells", lambda shapes, *a, **k: (cut.append(shapes.count()), box_of_cells(shapes, *a, **k))[1])
    monkeypatch.setattr(spatial, "quartered_join", lambda left, *a, **k: (met.append(left.count()), quartered(left, *a, **k))[1])
    got = [(p, r["det_id"], r["incident_id"], r["name"], r["phase"]) for p in ("size", "window") for r in spatial.assign_points(points, fires, 1, p).collect()]
    assert cut == [3, 3] and met == [15, 15]
    monkeypatch.undo()
    want = []
    for p in ("size", "window"):
        best = Window.partitionBy("det_id").orderBy(*spatial.overlap_order(p))
        pairs = spatial.points_in_polygons(points, fires, 1).withColumn("_rn", F.row_number().over(best)).filter("_rn = 1")
        want += [(p, r["det_id"], r["incident_id"], r["name"], r["phase"]) for r in pairs.withColumn("phase", spatial.phase()).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {r[3] for r in got} >= {"other", "none"}


def test_minutes_of_overpasses_are_computed_once(spark):
    """The weeks, their borders and their counts each ran the assignment behind the minutes again."""
    minutes = spark.createDataFrame([(1, m, c) for m, c in ((0, 2), (30, 1), (200, 4), (30 * 1440, 5))], "incident_id long, minute_int long, pixel_count long")
    out = overpass.overpass_events(minutes, 45)
    got = sorted((r["event_idx"], r["event_start_minute"], r["event_end_minute"], r["event_pixel_count"]) for r in out.collect())
    assert got == [(0, 0, 30, 3), (1, 200, 200, 4), (2, 43200, 43200, 5)]
    assert "LogicalRDD" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_cell_keeps_few_of_the_perimeters_that_hold_it(spark):
    """All pairs of points and overlapping perimeters filled disks and hours (F1 and the findings that share its step)."""
    ring = [[{"x": a, "y": b} for a, b in [(0.1, 0.1), (0.9, 0.1), (0.9, 0.9), (0.1, 0.9), (0.1, 0.1)]]]
    day = dt.date(2024, 1, 1)
    schema = "incident_id int, size_acres double, start_date date, end_date date, min_lon double, min_lat double, max_lon double, max_lat double, rings array<array<struct<x:double,y:double>>>"
    fires = spark.createDataFrame([(i, 5.0, day, day, 0.1, 0.1, 0.9, 0.9, ring) for i in range(200)], schema)
    points = spark.createDataFrame([(1, 0.3, 0.3, day)], "det_id int, lon double, lat double, acq_day date")
    held = spatial.first_in_cells(fires, points, 0, "window").filter("_cx = 1 and _cy = 1").collect()
    assert [r["incident_id"] for r in held] == [0]


def test_nearest_centres_are_the_first_k_of_all_pairs(spark):
    """Every centre of a day within the widest reach was paired with every station before (F2)."""
    draw = random.Random(3)
    day = dt.date(2024, 1, 1)
    where = [(draw.gauss(0, 0.2), draw.gauss(0, 0.2)) for _ in range(150)] + [(draw.uniform(-9, 9), draw.uniform(-9, 9)) for _ in range(150)]
    centres = [(day, i, *where[i % 300], 1.0, 0.8, 1.5) for i in range(600)]
    stations = [(f"s{i}", day, draw.uniform(-1, 1) if i % 2 else draw.uniform(-12, 12), draw.uniform(-1, 1)) for i in range(80)]
    left = spark.createDataFrame(stations, "station_id string, date_local date, latitude double, longitude double")
    right = spark.createDataFrame(centres, "day date, incident_id int, _clon double, _clat double, _radius double, _scale double, _reach double")
    got = {}
    for r in spatial._nearest_centres(left, right, 5).collect():
        got.setdefault(r["station_id"], set()).add(r["incident_id"])
    for name, _, lat, lon in stations:
        near = sorted(((lon - x) * 0.8 * ((lon - x) * 0.8) + (lat - y) * (lat - y), i) for _, i, x, y, *_ in centres)
        assert got.get(name, set()) == {i for d, i in near[:5] if d <= 1.5 * 1.5}
    assert any(len(v) == 5 for v in got.values()) and any(f"s{i}" not in got for i in range(80))


def test_local_daytime_holds_its_bounds(spark):
    """Quotients of minutes and degrees rounded below seven o'clock."""
    at = lambda text, lon: value(spark, s.is_local_daytime(F.lit(text).cast("timestamp"), F.lit(lon)))
    assert at("2024-01-05 13:57:00", -104.25) and at("2024-01-05 13:59:00", -104.75) and at("2024-01-05 14:08:00", -107.0)
    assert not at("2024-01-05 13:56:00", -104.25) and at("2024-01-05 00:57:00", -104.25) and not at("2024-01-05 00:58:00", -104.25)


def test_points_of_one_place_and_day_meet_a_box_once(spark):
    """Every detection met every box before, however often a place was hit (F27 and the findings that share its step)."""
    day = dt.date(2024, 1, 2)
    rows = [(i, 5.0 + 10 * (i % 2), 5.0, 2.0, day, dt.datetime(2024, 1, 2, i % 24)) for i in range(60)]
    points = spark.createDataFrame(rows, "det_id int, x double, y double, frp double, acq_day date, hour_utc timestamp")
    boxes = spark.createDataFrame([(1, day, day, 0.0, 0.0, 20.0, 20.0)], "incident_id int, start_date date, end_date date, xmin double, ymin double, xmax double, ymax double")
    pairs = reports.boxed_detections(points, boxes, hourly=False)
    assert sorted((r["x"], r["n"], r["frp"]) for r in pairs.collect()) == [(5.0, 30, 60.0), (15.0, 30, 60.0)]
    cells = grids.rasterize_fixed(grids.fixed_grid(pairs, 10.0), ["incident_id"], 10.0)
    assert sorted((r["iy"], r["ix"], r["value"], r["hits"]) for r in cells.collect()) == [(0, 0, 60.0, 30), (0, 1, 60.0, 30)]


def test_overlap_adds_up_places_and_keeps_cut_days(spark):
    """Every detection met every box of its hour before."""
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [(0.5, 0.5, 1.0, at(1, 4)), (0.5, 0.5, 1.0, at(1, 6)), (0.5, 0.5, 2.0, at(2, 3)), (0.5, 0.5, 3.0, at(2, 3)), (0.7, 0.5, None, at(2, 23)), (0.5, 0.5, 9.0, at(3, 2)), (0.5, 0.5, 9.0, at(3, 3)), (2.5, 0.5, 9.0, at(2, 3))]
    points = spark.createDataFrame(rows, "lon double, lat double, frp double, hour_utc timestamp")
    fires = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, at(1, 5), at(3, 2)), (2, 5.0, 5.0, 6.0, 6.0, at(1, 5), at(3, 2))], "incident_id int, min_lon double, min_lat double, max_lon double, max_lat double, start_ts timestamp, end_ts timestamp")
    one, none = reports.incident_overlap(fires, points).orderBy("incident_id").collect()
    assert (one["points"], one["hours"], one["total_frp"], one["max_frp"]) == (5, 4, 15.0, 9.0)
    assert (one["first_hour"], one["last_hour"], one["hours_to_first"], one["hours_from_last_to_end"]) == (at(1, 6), at(3, 2), 1.0, 0.0)
    assert (none["points"], none["hours"], none["total_frp"], none["first_hour"]) == (0, 0, 0.0, None)
    days = fires.select("incident_id", "min_lon", "min_lat", "max_lon", "max_lat", F.date_trunc("day", "start_ts").alias("start_hour"), F.lit(at(3, 23)).alias("end_hour"))
    days = days.withColumn("_day", F.explode(F.sequence(F.to_date("start_hour"), F.to_date("end_hour"))))
    assert {(r["_day"].day, r["n"], bin(r["h"])) for r in reports._day_overlap(points, days).collect()} == {(1, 2, bin(1 << 4 | 1 << 6)), (2, 3, bin(1 << 3 | 1 << 23)), (3, 2, bin(1 << 2 | 1 << 3))}


def test_samples_of_one_window_or_box_share_their_patches(spark):
    grid = GridSpec(-2_400_000.0, -900_000.0, 200_000.0, 200_000.0, 14, 12)
    day = dt.date(2024, 1, 1)
    plan = SampleSettings(day, day, SplitDates(day, day, day, day, day, day), grid, (Channel("MASSDEN", "8m_above_ground"),), Channel("MASSDEN", "8m_above_ground"), patch=(3, 3))
    at = dt.datetime(2024, 1, 1, 6)
    # The first two boxes hold the same grid cells, the last two are one box.
    sides = {1: (-610_000.0, -110_000.0, 210_000.0, 510_000.0), 2: (-650_000.0, -150_000.0, 250_000.0, 550_000.0), 3: (0.0, 0.0, 900_000.0, 900_000.0), 4: (0.0, 0.0, 900_000.0, 900_000.0)}
    boxes = spark.createDataFrame([(i, *b) for i, b in sides.items()], "incident_id long, xmin double, ymin double, xmax double, ymax double")
    field = [("MASSDEN", "8m", at, iy, ix, float(iy * 100 + ix * ix)) for iy in range(12) for ix in range(14)]
    fields = spark.createDataFrame(field, "variable string, level string, run_time timestamp, iy int, ix int, value double")
    needed = spark.createDataFrame([(f"k{i}", i, at, "MASSDEN", "8m") for i in sides], "sample_key string, incident_id long, run_time timestamp, variable string, level string")
    got = {r["sample_key"]: r["patch"] for r in samples.with_patches(needed, boxes, fields, plan).collect()}
    assert len(got) == 4 and got["k1"] == got["k2"] and got["k3"] == got["k4"] and got["k1"] != got["k3"]

    rng = random.Random(5)
    spots = [(i, rng.uniform(-103, -85), rng.uniform(36, 48), float(rng.randint(1, 9)), at) for i in range(300)]
    points = spark.createDataFrame(spots, "det_id long, lon double, lat double, frp double, hour_utc timestamp")
    x, y = geo.project("lon", "lat")
    placed = points.select(x.alias("x"), y.alias("y"), "frp").collect()
    rasters = {r["sample_key"]: r["patch"] for r in samples.hotspot_patches(needed, boxes, points, plan).collect()}
    assert len(rasters) == 4
    for i, (xmin, ymin, xmax, ymax) in sides.items():
        inside = sum(p["frp"] for p in placed if xmin <= p["x"] <= xmax and ymin <= p["y"] <= ymax)
        assert inside > 0 and sum(rasters[f"k{i}"]) == inside
    assert rasters["k3"] == rasters["k4"]


def test_baseline_scores_of_shifted_patches(spark):
    rng = random.Random(8)
    day = dt.date(2024, 1, 1)
    plan = SampleSettings(day, day, SplitDates(day, day, day, day, day, day), GRID, (), Channel("MASSDEN", "8m_above_ground"), patch=(4, 4), leads=(12, 24))
    speed = samples.SPACING_M / (12 * 3600.0)
    patch = lambda v=None: [float(rng.randint(0, 9)) if v is None else v * speed for _ in range(16)]
    parts = {("input", "MASSDEN_8m", 0): patch(), ("input", "UGRD_10m", 0): patch(1.0), ("input", "VGRD_10m", 0): patch(-1.0), ("label", "MASSDEN_8m", 12): patch(), ("label", "MASSDEN_8m", 24): patch()}
    rows = [("k", *name, values) for name, values in parts.items()]
    tensors = spark.createDataFrame(rows, "sample_key string, kind string, channel string, lead_hours int, patch array<float>")
    scores = samples.baseline_scores(tensors, plan, (12, 24))
    got = scores.first()
    mass = np.array(parts["input", "MASSDEN_8m", 0]).reshape(4, 4)
    for lead, step in ((12, 1), (24, 2)):
        truth = np.array(parts["label", "MASSDEN_8m", lead]).reshape(4, 4)
        moved = np.zeros((4, 4))
        moved[: 4 - step, step:] = mass[step:, : 4 - step]
        assert got[f"persistence_mse_t_plus_{lead}h"] == pytest.approx(((mass - truth) ** 2).mean())
        assert got[f"advection_mse_t_plus_{lead}h"] == pytest.approx(((moved - truth) ** 2).mean())
    # The means of the wind are columns of their own, not written out inside the shifts.
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("AS _mean_u") == 1


def test_only_incidents_of_the_panel_are_cut_into_cells(spark):
    box = lambda x0, y0, x1, y1: [[{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]]
    day = dt.date(2024, 1, 3)
    # The second box has more cells than a row can list.
    rows = [(1, 5.0, day, day, 0.0, 0.0, 1.0, 1.0, box(0.0, 0.0, 1.0, 1.0)), (2, 1.0, day, day, -1e9, 0.0, 1e9, 1.0, box(-1e9, 0.0, 1e9, 1.0))]
    fires = spark.createDataFrame(
        rows,
        "incident_id long, size_acres double, start_date date, end_date date, min_lon double, min_lat double, max_lon double, max_lat double, rings array<array<struct<x:double,y:double>>>",
    )
    points = spark.createDataFrame([(7, day, 0.5, 0.5), (8, dt.date(2024, 1, 4), 0.5, 0.5)], "det_id long, acq_day date, lon double, lat double")
    panel = spark.createDataFrame([(1, day)], "incident_id long, day date")
    out = spatial.assign_points(points, fires, None, "area", panel)
    assert [tuple(r) for r in out.select("det_id", "incident_id").collect()] == [(7, 1)]


def test_cloud_pixels_outside_requested_cells_stay(spark):
    ring = [[{"x": x, "y": y} for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0))]]
    fires = spark.createDataFrame(
        [(1, 0.0, 0.0, 1.0, 1.0, ring)],
        "incident_id long, min_lon double, min_lat double, max_lon double, max_lat double, rings array<array<struct<x:double,y:double>>>",
    )
    pixels = spark.createDataFrame(
        [("a", 0.5, 0.5, True), ("a", 0.6, 0.5, False), ("a", 9.5, 0.5, True), ("b", 0.5, 0.5, True)], "granule_key string, lon double, lat double, cloud boolean"
    )
    requests = spark.createDataFrame([("a", 1), ("c", 1)], "granule_key string, incident_id long")
    out = overpass.cloud_fraction(pixels, fires, requests)
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["granule_key"], r["cloud_frac"], r["cloud_pixels"]) for r in out.collect()) == [("a", 0.5, 2), ("c", None, 0)]


def test_copies_of_samples_and_detections_meet_once(spark, monkeypatch):
    """Every sample met every detection of its hours."""
    day, hour = dt.date(2024, 1, 3), dt.datetime(2024, 1, 3, 6)
    text = "sample_id int, run_date date, run_time_utc timestamp, source_hours_utc string, bbox_min_lon double, bbox_min_lat double, bbox_max_lon double, bbox_max_lat double"
    rows = [(i, day, hour, "0, 6,6", 0.1, 0.1, 0.3, 0.3) for i in range(30)] + [(30, day, hour, None, 0.1, 0.1, 0.3, 0.3), (31, day, hour, "7", 0.1, 0.1, 0.3, 0.3)]
    points = [(i, hour, 2.0, 0.3 if i % 2 else 0.2, 0.2) for i in range(40)] + [(40, hour.replace(hour=0), 5.0, 0.2, 0.1), (41, hour, 9.0, 0.31, 0.2)]
    met = []
    join = spatial.quartered_join
    monkeypatch.setattr(spatial, "quartered_join", lambda left, right, *a, **k: met.append((left.count(), right.count())) or join(left, right, *a, **k))
    out = reports.sample_overlap(spark.createDataFrame(rows, text), spark.createDataFrame(points, "det_id int, hour_utc timestamp, frp double, lon double, lat double"))
    got = {r["sample_id"]: (r["points"], r["matched_hours"], r["total_frp"], r["max_frp"]) for r in out.collect()}
    assert all(got[i] == (41, 2, 85.0, 5.0) for i in range(30)) and got[30] == (40, 1, 80.0, 2.0) and got[31] == (0, 0, 0.0, None) and len(got) == 32
    assert len(met) == 1 and met[0][0] <= 4 and met[0][1] <= 4 * 4


def test_windows_are_gathered_once(spark):
    """Field cells were gathered for every request, however many shared a window."""
    run = dt.datetime(2024, 1, 1)
    fields = spark.createDataFrame([(run, y, x, float(10 * y + x)) for y in range(4) for x in range(4)], "run_time timestamp, iy int, ix int, value double")
    requests = spark.createDataFrame([(i, run, 1, 2, 0, 1 + i % 2) for i in range(6)] + [(9, run, 2, 4, 0, 1)], "incident_id int, run_time timestamp, ix0 int, ix1 int, iy0 int, iy1 int")
    out = grids.gather_windows(requests, fields, ["incident_id", "run_time"], ["run_time"])
    collects = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in line]
    assert collects and not any("incident_id" in line for line in collects)
    # The window of 9 is not whole in the fields.
    assert {r["incident_id"]: r["window"] for r in out.collect()} == {i: [1.0, 2.0, 11.0, 12.0] + ([21.0, 22.0] if i % 2 else []) for i in range(6)}


def test_stations_meet_one_row_per_hour(spark):
    """Each station and hour was grouped from its four corners of two variables."""
    hours = [dt.datetime(2024, 1, 1, h) for h in range(2)]
    rows = [(h, v, "l", y, x, float(y * 10 + x) if (v, h.hour, y, x) != ("b", 1, 1, 1) else None) for h in hours for v in "ab" for y in range(3) for x in range(3)]
    fields = spark.createDataFrame(rows, "run_time timestamp, variable string, level string, iy int, ix int, value double")
    grid = GridSpec(x0=0.0, y0=0.0, dx=1.0, dy=1.0, nx=3, ny=3)
    points = spark.createDataFrame([("s", 0.25, 0.5), ("t", 2.0, 0.0), ("u", 2.5, 0.0)], "station_id string, x double, y double")
    out = grids.sample_two_fields(points, fields, grid, ("a", "l"), ("b", "l"))
    assert not any("Aggregate" in line and "station_id" in line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines())
    got = {(r["station_id"], r["hour_utc"].hour): (r["value0"], r["value1"]) for r in out.collect()}
    assert got == {("s", 0): (5.25, 5.25), ("s", 1): (5.25, None), ("t", 0): (2.0, 2.0), ("t", 1): (2.0, None)}


def test_coherence_carries_what_its_tables_read(spark, monkeypatch):
    """Every column of detections and incidents went through the assignment and its stages."""
    day = dt.date(2024, 1, 3)
    ring = [[{"x": x, "y": y} for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0))]]
    text = "incident_id int, name string, size_acres double, start_date date, end_date date, min_lon double, min_lat double, max_lon double, max_lat double, rings array<array<struct<x:double,y:double>>>"
    fires = spark.createDataFrame([(1, "a long name", 5.0, day, day, 0.0, 0.0, 1.0, 1.0, ring)], text)
    points = spark.createDataFrame([(i, day, "a note", 0.5, 0.5, 2.0, "h") for i in range(3)], "det_id int, acq_day date, note string, lon double, lat double, frp double, confidence string")
    seen = []
    assign = spatial.assign_points
    monkeypatch.setattr(spatial, "assign_points", lambda left, right, *a, **k: seen.append({*left.columns, *right.columns}) or assign(left, right, *a, **k))
    out = reports.coherence_report(points, {"A": fires}, 5)
    assert seen and not any({"name", "note", "provider"} & columns for columns in seen)
    row = out["metrics"].first()
    assert (row["name"], row["total_window_detections"], row["in_window_share"]) == ("a long name", 3, 1.0)
    assert [r["provider"] for r in out["summary"].collect()] == ["A"]
    for name in ("profiles", "frp_by_year", "frp_by_progress"):
        assert out[name].count() > 0
