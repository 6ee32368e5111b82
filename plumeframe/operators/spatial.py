"""Points to incidents: polygons in space and time, nearest incidents, boxes with hours."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from plumeframe.functions import geo
from plumeframe.operators import overlays
from plumeframe.scale import ROWS_PER_TASK, null_safe_join, skew_join, stored, top_rows

CELL_DEGREES = 0.25
DAYS_PER_BUCKET = 8
KM_PER_DEGREE = 111.19
#: Pairs of points and shapes that one task should test, and how often a cell is quartered at most.
PAIRS_PER_TASK = 50_000_000
MAX_QUARTERINGS = 8
#: Meetings of lines and edges that a shape tests at a time.
CROSSINGS = 4_000_000


def _bucket(day_number: Column) -> Column:
    return F.floor(day_number / DAYS_PER_BUCKET).cast("int")


def _box_of_cells(incidents: DataFrame, cell: float, spread_by: Sequence[str] = ("incident_id",)) -> DataFrame:
    """One row per incident and lon/lat cell of its box.

    Each row keeps the edges a ray running east from the cell can meet, so a large perimeter is
    not carried whole into every cell.
    """
    # Perimeters come from few files; spread them before they are cut into cells.
    tasks = int(incidents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = (
        incidents.repartition(tasks, *spread_by)
        .withColumn("_edges", geo.ring_edges("rings"))
        .withColumn(
            "_cx",
            F.explode(F.sequence(F.floor(F.col("min_lon") / cell).cast("int"), F.floor(F.col("max_lon") / cell).cast("int"))),
        )
        .withColumn(
            "_cy",
            F.explode(F.sequence(F.floor(F.col("min_lat") / cell).cast("int"), F.floor(F.col("max_lat") / cell).cast("int"))),
        )
    )
    west, south, north = F.col("_cx") * cell, F.col("_cy") * cell, (F.col("_cy") + 1) * cell
    reachable = F.filter(
        "_edges",
        lambda e: (F.greatest(e["y1"], e["y2"]) >= south)
        & (F.least(e["y1"], e["y2"]) <= north)
        & (F.greatest(e["x1"], e["x2"]) >= west),
    )
    return out.withColumn("_edges", reachable).drop("rings")


def incident_cells(incidents: DataFrame, pad_days: int | None, cell: float = CELL_DEGREES) -> DataFrame:
    """One row per incident, lon/lat cell of its box and (with ``pad_days``) day bucket of its window."""
    return _with_buckets(_box_of_cells(incidents, cell).filter(F.size("_edges") > 0), pad_days)


def _with_buckets(cells: DataFrame, pad_days: int | None) -> DataFrame:
    if pad_days is None:
        return cells
    first = _bucket(F.unix_date("start_date") - pad_days)
    last = _bucket(F.unix_date("end_date") + pad_days)
    return cells.withColumn("_bucket", F.explode(F.sequence(first, last)))


def _box_holds_cell(cell: float) -> Column:
    west, south, east, north = F.col("_cx") * cell, F.col("_cy") * cell, (F.col("_cx") + 1) * cell, (F.col("_cy") + 1) * cell
    return (F.col("min_lon") <= west) & (F.col("min_lat") <= south) & (F.col("max_lon") >= east) & (F.col("max_lat") >= north)


def _cell_state(cell: float) -> Column:
    """1 where the shape holds the whole cell, 0 where its outline may run through it, NULL where it lies beside it.

    The cell counts a little larger than it is, so rounding can turn a 1 or a NULL into a 0, never the reverse.
    """
    half = cell * (0.5 + 1e-6)
    x, y = (F.col("_cx") + 0.5) * cell, (F.col("_cy") + 0.5) * cell

    def meets(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        in_box = (
            (F.greatest(e["x1"], e["x2"]) >= x - half)
            & (F.least(e["x1"], e["x2"]) <= x + half)
            & (F.greatest(e["y1"], e["y2"]) >= y - half)
            & (F.least(e["y1"], e["y2"]) <= y + half)
        )
        return in_box & (F.abs(dx * (y - e["y1"]) - dy * (x - e["x1"])) <= (F.abs(dx) + F.abs(dy)) * half)

    return F.when(F.exists("_edges", meets), 0).when(geo.strictly_inside(x, y, "_edges"), _box_holds_cell(cell).cast("int"))


#: Edges that a cell keeps as plain columns, whose test is compiled; the fold over a longer list is interpreted.
FEW_EDGES = 4
_EDGE_COLUMNS = [f"_{c}_{i}" for i in range(FEW_EDGES) for c in ("x1", "y1", "x2", "y2")]


def _prepared_cells(incidents: DataFrame, cell: float) -> DataFrame:
    """The cells of a shape with what the test of a point needs there.

    A cell that lies beside the shape is left out, one that it holds whole (``_whole``) needs no test, and few edges are plain columns.
    """
    cells = _box_of_cells(incidents, cell).filter(F.size("_edges") > 0)
    # As a generated column the state is computed once.
    cells = cells.withColumn("_whole", F.explode(F.array(_cell_state(cell)))).filter("_whole is not null").withColumn("_whole", F.col("_whole") == 1)
    few = ~F.col("_whole") & (F.size("_edges") <= FEW_EDGES)
    columns = {f"_{c}_{i}": F.when(few, F.get("_edges", F.lit(i))[c]) for i in range(FEW_EDGES) for c in ("x1", "y1", "x2", "y2")}
    return cells.withColumns(columns).withColumn("_edges", F.when(~few & ~F.col("_whole"), F.col("_edges")))


def _in_few_edges(lon: str, lat: str) -> Column:
    """``geo.strictly_inside`` for a point of a prepared cell that is whole or has few edges."""
    x, y = F.col(lon), F.col(lat)

    def mark(i: int) -> Column:
        x1, y1, x2, y2 = (F.col(f"_{c}_{i}") for c in ("x1", "y1", "x2", "y2"))
        cross = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
        touches = (cross == 0) & x.between(F.least(x1, x2), F.greatest(x1, x2))
        crosses = (y < F.greatest(y1, y2)) & ((y2 > y1) == (cross > 0))
        beside = (y < F.least(y1, y2)) | (y > F.greatest(y1, y2))
        # An edge touched outweighs all that are crossed; a missing one is neither.
        return F.when(beside, 0).when(touches, 2 * FEW_EDGES).when(crosses, 1).otherwise(0)

    few = reduce(lambda a, b: a + b, [mark(i) for i in range(FEW_EDGES)]).isin(*range(1, FEW_EDGES + 1, 2))
    return F.col("_whole") | few


def quartered_join(
    points: DataFrame,
    shapes: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    cell: float,
    lon: str = "lon",
    lat: str = "lat",
    bounds: Sequence[str] = ("min_lon", "min_lat", "max_lon", "max_lat"),
    rows_per_task: int = ROWS_PER_TASK,
    pairs_per_task: int = PAIRS_PER_TASK,
    sized: DataFrame | None = None,
) -> DataFrame:
    """Inner join of points and boxed shapes on ``keys``, the lon/lat cell ``_cx, _cy`` among them.

    The work of a cell is its points times its shapes. Cells above ``pairs_per_task`` are quartered as often as it takes,
    and both sides take the quarter's number into their key: points lie in one quarter, shapes in those that their
    box touches. Points that are too many for a task wherever they lie are salted besides. Pairs whose
    box does not touch the point's quarter are not formed; they could not hold the point. ``sized`` has the keys of ``shapes``,
    or somewhat more of them, at less cost; it is counted in their place.
    """
    keys = list(keys)
    here = points.groupBy(*keys).agg(F.count("*").alias("_p"))
    there = (shapes if sized is None else sized).groupBy(*keys).agg(F.count("*").alias("_s"))
    work = F.col("_p").cast("double") * F.col("_s")
    depth = F.least(F.ceil(F.log(4.0, work / pairs_per_task)), F.lit(MAX_QUARTERINGS))
    hot = (
        here.join(there, keys)
        .filter((work > pairs_per_task) | (F.col("_p") > rows_per_task))
        .select(*keys, F.pow(F.lit(2), F.greatest(depth, F.lit(0))).cast("int").alias("_n"), F.ceil(F.col("_p") / rows_per_task).cast("int").alias("_salts"))
    )
    n, salts = F.coalesce("_n", F.lit(1)), F.coalesce("_salts", F.lit(1))
    # Quarters count from the cell's corner; both sides use the same expression, which never falls along the axis.
    quarter = lambda c, corner: F.least(F.greatest(F.floor((F.col(c) - F.col(corner) * cell) / cell * n), F.lit(0)), n - 1).cast("int")
    west, south, east, north = bounds
    left = points.join(hot, keys, "left").withColumns(
        {"_qx": quarter(lon, "_cx"), "_qy": quarter(lat, "_cy"), "_salt": F.pmod(F.xxhash64(*spread_by), salts.cast("bigint")).cast("int")}
    )
    right = (
        shapes.join(hot, keys, "left")
        .withColumn("_qx", F.explode(F.sequence(quarter(west, "_cx"), quarter(east, "_cx"))))
        .withColumn("_qy", F.explode(F.sequence(quarter(south, "_cy"), quarter(north, "_cy"))))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    )
    return left.drop("_n", "_salts").join(right.drop("_n", "_salts"), [*keys, "_qx", "_qy", "_salt"]).drop("_qx", "_qy", "_salt")


def points_in_polygons(
    points: DataFrame,
    incidents: DataFrame,
    pad_days: int | None = 0,
    point_id: str = "det_id",
    lon: str = "lon",
    lat: str = "lat",
    day: str = "acq_day",
    rows_per_task: int = ROWS_PER_TASK,
    pairs_per_task: int = PAIRS_PER_TASK,
) -> DataFrame:
    """Every (point, incident) pair with the point strictly inside the perimeter.

    With ``pad_days`` the point's day must fall in [start - pad, end + pad]; None ignores time.
    Equi join on (cell, day bucket), then box, then polygon. Cells with very many pairs are quartered, such with
    very many points salted.
    """
    keys = ["_cx", "_cy"]
    located = points.withColumn("_cx", F.floor(F.col(lon) / CELL_DEGREES).cast("int")).withColumn(
        "_cy", F.floor(F.col(lat) / CELL_DEGREES).cast("int")
    )
    if pad_days is not None:
        keys.append("_bucket")
        located = located.withColumn("_bucket", _bucket(F.unix_date(day)))
    cells = stored(_with_buckets(_prepared_cells(incidents, CELL_DEGREES), pad_days))
    boxes = _with_buckets(_box_cells(incidents, "min_lon", "min_lat", "max_lon", "max_lat", CELL_DEGREES), pad_days)
    keep = F.col(lon).between(F.col("min_lon"), F.col("max_lon")) & F.col(lat).between(F.col("min_lat"), F.col("max_lat"))
    if pad_days is not None:
        keep = keep & (F.col(day) >= F.date_sub("start_date", pad_days)) & (F.col(day) <= F.date_add("end_date", pad_days))

    def held(cells: DataFrame, inside: Column) -> DataFrame:
        met = quartered_join(located, cells, keys, [point_id], CELL_DEGREES, lon, lat, rows_per_task=rows_per_task, pairs_per_task=pairs_per_task, sized=boxes)
        return met.filter(keep).filter(inside).drop("_edges", "_whole", *_EDGE_COLUMNS, *keys)

    # Apart, as an interpreted test in a join's condition keeps the whole join from being compiled.
    few = held(cells.filter("_edges is null").drop("_edges"), _in_few_edges(lon, lat))
    many = held(cells.filter("_edges is not null").drop(*_EDGE_COLUMNS), geo.strictly_inside(lon, lat, "_edges"))
    return few.unionByName(many)


def _duration() -> Column:
    return F.greatest(F.datediff("end_date", "start_date") + 1, F.lit(1))


def overlap_order(policy: str) -> list[Column]:
    """Which incident wins a point that lies in several.

    ``size``        smaller, then shorter
    ``window``      fewer days outside the window, then shorter, then incident order
    ``rounded``     size rounded to whole acres, then shorter
    ``area``        smaller
    Every policy ends on the incident id, so that results do not depend on arrival order.
    """
    off = F.greatest(F.datediff("start_date", "acq_day"), F.datediff("acq_day", "end_date"), F.lit(0))
    size = F.col("size_acres")
    orders = {
        "size": [size, _duration()],
        "window": [off * 10_000 + F.least(_duration(), F.lit(9_999)), F.col("start_date"), -size],
        "rounded": [F.rint(size).cast("bigint") * 10_000 + _duration()],
        "area": [size],
    }
    return [*orders[policy], F.col("incident_id")]


def assign_points(
    points: DataFrame,
    incidents: DataFrame,
    pad_days: int | None = 0,
    policy: str = "size",
    panel_days: DataFrame | None = None,
    point_id: str = "det_id",
) -> DataFrame:
    """At most one incident per point, with the phase (pre / in / post) of its day.

    ``panel_days`` (incident_id, day) keeps only pairs whose day is in the panel.
    """
    by_day = pad_days is not None or panel_days is not None
    if policy == "window" and not by_day:
        # Without days in its cells the order of this policy is not one order per cell.
        pairs = points_in_polygons(points, incidents, pad_days, point_id=point_id)
        return top_rows(pairs, [point_id], overlap_order(policy)).withColumn("phase", phase())
    place = ["lon", "lat", "acq_day"] if by_day else ["lon", "lat"]
    keys = ["_cx", "_cy", "acq_day"] if by_day else ["_cx", "_cy"]
    # Points of one place (and day) have one winner: places meet the incidents, points meet the winner.
    places = _with_cell(points.select(*place).distinct(), CELL_DEGREES)
    firsts = first_in_cells(incidents, points, pad_days, policy, panel_days)
    near = F.col("lon").between(F.col("min_lon"), F.col("max_lon")) & F.col("lat").between(F.col("min_lat"), F.col("max_lat"))
    pairs = quartered_join(places, firsts, keys, ["lon", "lat"], CELL_DEGREES).filter(near)
    pairs = pairs.filter(geo.strictly_inside("lon", "lat", "_edges"))
    won = top_rows(pairs, place, overlap_order(policy)).select(*place, "incident_id", "_copy")
    copies = incidents.withColumn("_copy", _copy()).drop("rings")
    named = stored(null_safe_join(won, copies, ["incident_id", "_copy"]).drop("_copy"))
    return top_rows(points.join(named, place), [point_id], overlap_order(policy)).withColumn("phase", phase())


def _leading(policy: str) -> Column:
    """A number that never falls along the order of a policy; equal for few incidents of a cell and day."""
    first = overlap_order(policy)[0]
    if policy == "window":
        first = first.cast("bigint") * 1_000_000 + F.least(F.greatest(F.unix_date("start_date"), F.lit(0)), F.lit(999_999))
    return first.cast("double")


def _outline() -> list[Column]:
    """Two hashes that name an outline: 128 bits, equal for copies of a box and its rings."""
    shape = ["min_lon", "min_lat", "max_lon", "max_lat", "rings"]
    return [F.xxhash64(F.lit(seed), *shape).alias(f"_shape{seed}") for seed in (1, 2)]


def _copy() -> Column:
    """Tells rows of one incident id apart."""
    return F.xxhash64("min_lon", "min_lat", "max_lon", "max_lat", "rings", "start_date", "end_date", "size_acres")


def first_in_cells(
    incidents: DataFrame,
    points: DataFrame,
    pad_days: int | None,
    policy: str,
    panel_days: DataFrame | None = None,
    cell: float = CELL_DEGREES,
) -> DataFrame:
    """The incidents that can win a point, by cell and (with ``pad_days`` or ``panel_days``) day ``acq_day``.

    Of copies of an outline only the first of a day can win, so an outline is cut into cells once, with the first of every day.
    The first incident in the order of the policy that holds a cell whole wins every point of it against all incidents
    behind it. So a cell keeps that one and those before it whose outline runs through the cell, however many
    incidents overlap there. The bound is a hash aggregate over outlines, cells and days; only what it leaves is ordered.
    """
    by_day = pad_days is not None or panel_days is not None
    keys = ["_cx", "_cy", "acq_day"] if by_day else ["_cx", "_cy"]
    outline, dates = ["_shape1", "_shape2"], ["start_date", "end_date"]
    box = ["min_lon", "min_lat", "max_lon", "max_lat"]
    if panel_days is not None:
        panel = stored(panel_days.select("incident_id", F.col("day").alias("acq_day")).distinct())
        # Only incidents of the panel are cut into cells.
        incidents = incidents.join(panel.select("incident_id").distinct(), "incident_id", "left_semi")
    named = incidents.select("*", *_outline()).withColumn("_copy", _copy())
    firsts = named.select(*outline, "incident_id", "_copy", "size_acres", *dates)
    if panel_days is None and by_day:
        # Copies with the same window have one order on all of its days, whichever day is put in.
        firsts = top_rows(firsts.withColumn("acq_day", F.col("start_date")), [*outline, *dates], overlap_order(policy)).drop("acq_day")
    if pad_days is not None:
        low, high = points.agg(F.min("acq_day"), F.max("acq_day")).first()
        begin = F.greatest(F.date_sub("start_date", pad_days), F.lit(low).cast("date"))
        end = F.least(F.date_add("end_date", pad_days), F.lit(high).cast("date"))
        # A window without both of its ends holds no day.
        known = F.col("start_date").isNotNull() & F.col("end_date").isNotNull() & (begin <= end)
        firsts = firsts.withColumn("acq_day", F.explode(F.when(known, F.sequence(begin, end))))
    if panel_days is not None:
        firsts = firsts.join(panel, ["incident_id", "acq_day"] if pad_days is not None else ["incident_id"])
    firsts = top_rows(firsts, [*outline, "acq_day"] if by_day else outline, overlap_order(policy)).withColumn("_lead", _leading(policy))
    entry = ["incident_id", "_copy", "size_acres", *dates, "_lead", *(["acq_day"] if by_day else [])]
    held_by = firsts.groupBy(*outline).agg(F.collect_list(F.struct(*entry)).alias("_firsts"))
    shapes = stored(named.select(*outline, *box, "rings").dropDuplicates(outline).join(held_by, outline))

    def spread(cells: DataFrame) -> DataFrame:
        # As a generated column the state is computed once, whatever filters follow.
        out = cells.withColumn("_full", F.explode(F.array(_cell_state(cell)))).filter(F.col("_full").isNotNull())
        return out.select("_cx", "_cy", "_full", "_edges", *box, F.inline("_firsts"))

    cells = _box_of_cells(shapes, cell, outline)
    whole = spread(cells.filter(_box_holds_cell(cell))).filter("_full = 1")
    bound = stored(whole.groupBy(*keys).agg(F.min("_lead").alias("_bound")))
    reached = spread(cells).join(bound, keys, "left").filter("_bound is null or _lead is null or _lead <= _bound")
    ahead = Window.partitionBy(*keys).orderBy(*overlap_order(policy)).rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.sum("_full").over(ahead), F.lit(0))
    return stored(reached.withColumn("_held", held).filter("_held = 0").drop("_held", "_bound", "_lead", "_full"))


def phase(day: str = "acq_day") -> Column:
    return F.when(F.col(day) < F.col("start_date"), "pre").when(F.col(day) > F.col("end_date"), "post").otherwise("in")


def envelope_filter(points: DataFrame, incidents: DataFrame, margin: float = 0.2) -> DataFrame:
    """Points inside the common envelope of all incidents, widened by a margin."""
    box = incidents.agg(
        F.struct(
            (F.min("min_lon") - margin).alias("w"),
            (F.min("min_lat") - margin).alias("s"),
            (F.max("max_lon") + margin).alias("e"),
            (F.max("max_lat") + margin).alias("n"),
        ).alias("box")
    ).scalar()
    return points.filter(F.col("lon").between(box["w"], box["e"]) & F.col("lat").between(box["s"], box["n"]))


def active_days(incidents: DataFrame, day: str = "day") -> DataFrame:
    """One row per incident and active day."""
    return incidents.withColumn(day, F.explode(F.sequence("start_date", "end_date")))


def _within_reach(stations: DataFrame, spread: DataFrame) -> DataFrame:
    """Pairs of stations and centres of a day within the reach of the centre."""
    # Cells double with the reach, so an incident covers few of them however large it is, and leaves the others alone.
    level = F.greatest(F.ceil(F.log2("_reach")), F.lit(0)).cast("int")
    spread = spread.withColumn("_level", level).withColumn("_cell", F.pow(F.lit(2.0), F.col("_level")))
    lon_reach = F.col("_reach") / F.col("_scale")
    cells = lambda c, r: F.explode(F.sequence(F.floor((F.col(c) - r) / F.col("_cell")).cast("int"), F.floor((F.col(c) + r) / F.col("_cell")).cast("int")))
    spread = (
        spread.withColumn("_gx", cells("_clon", lon_reach))
        .withColumn("_gy", cells("_clat", F.col("_reach")))
        .select("day", "_level", "_gx", "_gy", "incident_id", "_clon", "_clat", "_radius", "_scale", "_reach")
    )
    levels = spread.groupBy("day").agg(F.collect_set("_level").alias("_levels"))
    place = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level"))).cast("int")
    placed = (
        stations.withColumnRenamed("date_local", "day")
        .join(levels, "day")
        .select("station_id", "day", "latitude", "longitude", F.explode("_levels").alias("_level"))
        .withColumn("_gx", place("longitude"))
        .withColumn("_gy", place("latitude"))
    )
    dx = (F.col("longitude") - F.col("_clon")) * F.col("_scale")
    dy = F.col("latitude") - F.col("_clat")
    return (
        skew_join(placed, spread, ["day", "_level", "_gx", "_gy"], ["station_id"])
        .withColumn("_planar", dx * dx + dy * dy)
        .filter(F.col("_planar") <= F.col("_reach") * F.col("_reach"))
    )


def _nearest_centres(stations: DataFrame, centres: DataFrame, k: int, levels: int = 10) -> DataFrame:
    """Pairs of every station-day and its ``k`` nearest centres on the day's plane, none beyond the day's reach.

    The plane is cut into cells of the reach, halved ``levels`` times. A cell of k centres or more that holds the station
    has the nearest k within its diagonal, so a station looks no farther than the diagonal of its smallest such cell.
    """
    days = stored(centres.select("day", "_scale", "_reach").distinct())
    at = lambda c: F.floor(c / F.col("_reach") * F.pow(F.lit(2.0), F.col("_level"))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("_level")
    placed = stored(
        centres.select("day", "incident_id", "_clon", "_clat", "_radius", "_scale", "_reach", (F.col("_clon") * F.col("_scale")).alias("_x"))
    )
    cells = ["day", "_level", "_gx", "_gy"]
    full = (
        placed.select("*", every)
        .select("day", "_level", at(F.col("_x")).alias("_gx"), at(F.col("_clat")).alias("_gy"))
        .groupBy(*cells)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") >= k)
    )
    here = stations.withColumnRenamed("date_local", "day").join(days, "day").withColumn("_x", F.col("longitude") * F.col("_scale"))
    looks = here.select("*", every).withColumn("_gx", at(F.col("_x"))).withColumn("_gy", at(F.col("latitude")))
    # A left join, so that a station without such a cell keeps its reach, in cells of that size.
    smallest = looks.join(full, cells, "left").groupBy("station_id", "day", "latitude", "longitude", "_scale", "_reach", "_x")
    smallest = smallest.agg(F.coalesce(F.max(F.when(F.col("_n").isNotNull(), F.col("_level"))), F.lit(-1)).alias("_smallest"))
    diagonal = F.col("_reach") / F.pow(F.lit(2.0), F.col("_smallest")) * (2**0.5 * 1.0001)
    bounded = smallest.withColumn("_far", F.when(F.col("_smallest") < 0, F.col("_reach")).otherwise(F.least(diagonal, F.col("_reach"))))
    bounded = stored(bounded.withColumn("_level", F.greatest("_smallest", F.lit(0))))
    span = lambda c: F.explode(F.sequence(at(c - F.col("_far")), at(c + F.col("_far"))))
    visits = bounded.withColumn("_gx", span(F.col("_x"))).withColumn("_gy", span(F.col("latitude")))
    visits = visits.select(*cells, "station_id", "latitude", "longitude", "_far", "_reach")
    used = bounded.select("day", "_level").distinct()
    found = placed.join(used, "day").withColumn("_gx", at(F.col("_x"))).withColumn("_gy", at(F.col("_clat")))
    found = found.select(*cells, "incident_id", "_clon", "_clat", "_radius", "_scale")
    dx = (F.col("longitude") - F.col("_clon")) * F.col("_scale")
    dy = F.col("latitude") - F.col("_clat")
    pairs = skew_join(visits, found, cells, ["station_id"]).withColumn("_planar", dx * dx + dy * dy)
    near = (F.col("_planar") <= F.col("_far") * F.col("_far") * 1.0001) & (F.col("_planar") <= F.col("_reach") * F.col("_reach"))
    return top_rows(pairs.filter(near), ["station_id", "day"], [F.col("_planar"), F.col("incident_id")], k)


def proximity_bins(
    observations: DataFrame,
    incidents: DataFrame,
    k: int | None = None,
    near_km: float = 30.0,
    far_km: float = 100.0,
) -> DataFrame:
    """Adds ``fire_proximity_bin``: <=30, 30-100 or >100 km to the nearest active perimeter.

    The distance is haversine to the centre less the half diagonal, not below zero. Every incident is
    looked at, or with ``k`` only the k centres nearest on a plane scaled by the cosine of the day's
    mean centre latitude. Only pairs within the planar reach that can still give a distance of ``far_km`` are
    formed. Incidents fall into classes by their reach, each doubling the one before, and are spread over cells of their
    class; stations look at a cell of every class of the day. With ``k`` any centre may push another out, so all
    incidents of a day share the reach of its largest one.
    """
    centre_lon, centre_lat = (F.col("min_lon") + F.col("max_lon")) / 2, (F.col("min_lat") + F.col("max_lat")) / 2
    daily = (
        active_days(incidents.select("incident_id", "start_date", "end_date", "min_lon", "min_lat", "max_lon", "max_lat"))
        .withColumn("_clon", centre_lon)
        .withColumn("_clat", centre_lat)
        .withColumn("_radius", geo.bbox_radius_km("min_lon", "min_lat", "max_lon", "max_lat"))
    )
    stations = observations.select("station_id", "date_local", "latitude", "longitude").distinct()
    scales = daily.groupBy("day").agg(F.cos(F.radians(F.avg("_clat"))).alias("_scale"), F.max("_radius").alias("_max_radius"))
    # Of incidents with one centre only the first k, or without k the widest one, can decide.
    centres = ["day", "_clon", "_clat"]
    if k is None:
        kept = daily.groupBy(*centres).agg(F.max("_radius").alias("_radius"), F.min("incident_id").alias("incident_id"))
    else:
        kept = top_rows(daily.select(*centres, "incident_id", "_radius"), centres, [F.col("incident_id")], k)
    # A relevant centre is within far_km + radius of the station. A great circle of that length spans
    # no more than that in latitude and, at the highest latitude in play, its ratio in longitude; the
    # day's plane stretches longitude by at most the ratio of the two cosines.
    radius = F.col("_radius") if k is None else F.col("_max_radius")
    degrees = (F.lit(far_km) + radius) / KM_PER_DEGREE
    highest = stations.agg(F.max(F.abs("latitude"))).scalar()
    narrow = F.cos(F.radians(F.least(highest + degrees, F.lit(85.0))))
    spread = kept.join(scales, "day").withColumn("_reach", degrees * F.greatest(F.col("_scale") / narrow, F.lit(1.0)) * 1.05)
    pairs = _within_reach(stations, spread) if k is None else _nearest_centres(stations, spread, k)
    distance = F.greatest(geo.haversine_km("latitude", "longitude", "_clat", "_clon") - F.col("_radius"), F.lit(0.0))
    nearest = pairs.groupBy("station_id", F.col("day").alias("date_local")).agg(F.min(distance).alias("_km"))
    label = F.when(F.col("_km") <= near_km, "<=30").when(F.col("_km") <= far_km, "30-100").otherwise(">100")
    return (
        observations.join(nearest, ["station_id", "date_local"], "left")
        .withColumn("fire_proximity_bin", label)
        .drop("_km")
    )


def _box_cells(df: DataFrame, west: str, south: str, east: str, north: str, cell: float) -> DataFrame:
    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / cell).cast("int"), F.floor(F.col(high) / cell).cast("int")))

    return df.withColumn("_cx", span(west, east)).withColumn("_cy", span(south, north))


def _with_cell(points: DataFrame, cell: float) -> DataFrame:
    return points.withColumn("_cx", F.floor(F.col("lon") / cell).cast("int")).withColumn(
        "_cy", F.floor(F.col("lat") / cell).cast("int")
    )


def _box_wide_cell(boxes: DataFrame, bounds: Sequence[str]) -> float:
    """The power of two nearest to the mean width of boxes, ``CELL_DEGREES`` at least and 8 degrees at most."""
    west, south, east, north = bounds
    width = boxes.agg(F.avg(F.greatest(F.col(east) - F.col(west), F.col(north) - F.col(south)))).first()[0]
    return min(max(2.0 ** round(math.log2(width)), CELL_DEGREES), 8.0) if width and 0 < width < math.inf else CELL_DEGREES


def points_in_boxes(
    points: DataFrame,
    boxes: DataFrame,
    bounds: Sequence[str] = ("min_lon", "min_lat", "max_lon", "max_lat"),
    start: str = "start_hour",
    end: str = "end_hour",
    cell: float | None = None,
) -> DataFrame:
    """(point, box) pairs with the point's hour in [start, end]; boxes and windows are closed.

    Without ``cell`` cells are about as wide as the boxes, so a box is copied into few of them; this changes the work only.
    """
    west, south, east, north = bounds
    cell = cell or _box_wide_cell(boxes, bounds)
    days = F.explode(F.sequence(F.to_date(start), F.to_date(end)))
    spread = _box_cells(boxes, west, south, east, north, cell).withColumn("_day", days)
    placed = _with_cell(points, cell).withColumn("_day", F.to_date("hour_utc"))
    pairs = quartered_join(placed, spread, ["_cx", "_cy", "_day"], ["det_id"], cell, bounds=bounds)
    inside = (
        F.col("lon").between(F.col(west), F.col(east))
        & F.col("lat").between(F.col(south), F.col(north))
        & F.col("hour_utc").between(F.col(start), F.col(end))
    )
    return pairs.filter(inside).drop("_cx", "_cy", "_day")


def places_in_boxes(
    places: DataFrame, boxes: DataFrame, bounds: Sequence[str] = ("min_lon", "min_lat", "max_lon", "max_lat"), cell: float = CELL_DEGREES
) -> DataFrame:
    """(place, box) pairs of one ``_day``; boxes are closed."""
    west, south, east, north = bounds
    spread = _box_cells(boxes, west, south, east, north, cell)
    pairs = quartered_join(_with_cell(places, cell), spread, ["_cx", "_cy", "_day"], ["lon", "lat"], cell, bounds=bounds)
    inside = F.col("lon").between(F.col(west), F.col(east)) & F.col("lat").between(F.col(south), F.col(north))
    return pairs.filter(inside).drop("_cx", "_cy")


def sample_hours() -> Column:
    """Distinct hours of a sample in order, from ``source_hours_utc``; no list means its run hour."""
    listed = F.filter(
        F.transform(F.split(F.coalesce(F.col("source_hours_utc"), F.lit("")), ","), lambda s: F.trim(s).try_cast("int")),
        lambda h: h.isNotNull(),
    )
    hours = F.when(F.size(listed) > 0, listed).otherwise(F.array(F.hour("run_time_utc")))
    return F.sort_array(F.filter(F.array_distinct(hours), lambda h: h.isNotNull()))


def hour_of_day(day: Column | str, hour: Column | str) -> Column:
    return F.timestamp_seconds(F.unix_date(day).cast("bigint") * 86400 + (F.col(hour) if isinstance(hour, str) else hour) * 3600)


def points_in_sample_hours(
    points: DataFrame,
    samples: DataFrame,
    bounds: Sequence[str] = ("bbox_min_lon", "bbox_min_lat", "bbox_max_lon", "bbox_max_lat"),
    cell: float = CELL_DEGREES,
) -> DataFrame:
    """(point, sample) pairs at the sample's own hours of its run date; no list means its run hour."""
    wanted = (
        samples.withColumn("_hour", F.explode(sample_hours()))
        .withColumn("hour_utc", hour_of_day("run_date", "_hour"))
        .drop("_hour")
    )
    return _in_boxes_of_the_hour(points, wanted, ["det_id"], bounds, cell)


def places_in_sample_hours(
    places: DataFrame, boxes: DataFrame, bounds: Sequence[str] = ("bbox_min_lon", "bbox_min_lat", "bbox_max_lon", "bbox_max_lat"), cell: float = CELL_DEGREES
) -> DataFrame:
    """(place, box) pairs of one ``hour_utc``; boxes are closed."""
    return _in_boxes_of_the_hour(places, boxes, ["lon", "lat"], bounds, cell)


def _in_boxes_of_the_hour(points: DataFrame, boxes: DataFrame, spread_by: Sequence[str], bounds: Sequence[str], cell: float) -> DataFrame:
    west, south, east, north = bounds
    spread = _box_cells(boxes, west, south, east, north, cell)
    pairs = quartered_join(_with_cell(points, cell), spread, ["hour_utc", "_cx", "_cy"], spread_by, cell, bounds=bounds)
    inside = F.col("lon").between(F.col(west), F.col(east)) & F.col("lat").between(F.col(south), F.col(north))
    return pairs.filter(inside).drop("_cx", "_cy")


def select_points(points: DataFrame, west: float, south: float, east: float, north: float, start, end) -> DataFrame:
    """Points of one box and time range, ends included; plain predicates, so the scan prunes them."""
    return points.filter(
        F.col("lon").between(west, east)
        & F.col("lat").between(south, north)
        & F.col("acq_ts").between(F.lit(start), F.lit(end))
    )


def scan_spans(shapes: DataFrame, key: str, lines: int = 64) -> DataFrame:
    """``key, ring, k, y, x0, x1, share``: inside spans of ``lines`` level lines through every ring of a shape.

    A span belongs to the ring that bounds it on the left, and only that ring's lines give it. So every part of a shape,
    however small or thin, has spans, and ``share`` (length times the distance of the ring's lines) adds up to the area.
    """
    named = lambda **fields: F.named_struct(*[v for name, c in fields.items() for v in (F.lit(name), c)])
    edge = lambda e, i: named(x1=e["x1"], y1=e["y1"], x2=e["x2"], y2=e["y2"], ring=i)
    edges = F.flatten(F.transform("rings", lambda r, i: F.transform(geo.ring_edges(F.array(r)), lambda e: edge(e, i))))

    def levels(ring: Column, i: Column) -> Column:
        ys = F.transform(ring, lambda p: p["y"])
        low, step = F.array_min(ys), (F.array_max(ys) - F.array_min(ys)) / lines
        return F.transform(
            F.sequence(F.lit(0), F.lit(lines - 1)), lambda k: named(ring=i, k=k, y=low + (k + 0.5) * step, step=step)
        )

    at = shapes.select(key, edges.alias("_edges"), F.explode(F.flatten(F.transform("rings", levels))).alias("_line")).filter("_line.step > 0")
    y = F.col("_line.y")
    crossed = F.filter("_edges", lambda e: (F.least(e["y1"], e["y2"]) <= y) & (y < F.greatest(e["y1"], e["y2"])))
    place = lambda e: e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
    cuts = F.array_sort(F.transform(crossed, lambda e: F.struct(place(e).alias("x"), e["ring"].alias("ring"))))
    crossings = at.select(key, "_line", cuts.alias("_cuts")).filter(F.size("_cuts") >= 2)
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("_cuts") / 2).cast("int") - 1),
        lambda j: F.struct(F.get("_cuts", 2 * j)["x"].alias("x0"), F.get("_cuts", 2 * j + 1)["x"].alias("x1"), F.get("_cuts", 2 * j)["ring"].alias("owner")),
    )
    spans = crossings.select(key, "_line", F.inline(pairs)).filter((F.col("owner") == F.col("_line.ring")) & (F.col("x0") < F.col("x1")))
    return spans.select(key, F.col("_line.ring").alias("ring"), F.col("_line.k").alias("k"), y.alias("y"), "x0", "x1", ((F.col("x1") - F.col("x0")) * F.col("_line.step")).alias("share"))


def _centre(rings: str) -> tuple[Column, Column]:
    """Centre of mass of a shape's oriented rings."""
    x0, y0 = F.col(rings)[0][0]["x"], F.col(rings)[0][0]["y"]
    edges = geo.ring_edges(rings)
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, e: Column) -> Column:
        ax, ay, bx, by = e["x1"] - x0, e["y1"] - y0, e["x2"] - x0, e["y2"] - y0
        cross = ax * by - bx * ay
        return F.struct((acc["a"] + cross).alias("a"), (acc["x"] + (ax + bx) * cross).alias("x"), (acc["y"] + (ay + by) * cross).alias("y"))

    total = F.aggregate(edges, zero, add)
    return x0 + total["x"] / F.nullif(total["a"] * 3, F.lit(0.0)), y0 + total["y"] / F.nullif(total["a"] * 3, F.lit(0.0))


def hashed_unit(key: Column | str, i: Column | str) -> Column:
    """Number in [0, 1) from a key and a counter; the same wherever MD5 is."""
    text = F.concat_ws("|", F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.col(i).cast("string") if isinstance(i, str) else i)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def points_inside(incidents: DataFrame, n: int, lines: int = 64) -> DataFrame:
    """``incident_id, i, lon, lat``: exactly ``n`` points strictly inside every perimeter that has an area.

    Point 0 is the centre of mass, or the middle of the longest span where the centre lies outside. The others are
    spread evenly: a hash of (incident, i) picks a place in the running total of the spans' shares. So a perimeter that fills
    little of its box loses no point, and the work does not depend on the shape of the box.
    """
    # Perimeters come from few files; spread them before they are worked on.
    tasks = int(incidents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = incidents.select("incident_id", "rings").repartition(tasks, "incident_id")
    shapes = spread.select("incident_id", overlays.oriented("rings").alias("rings")).filter(F.size("rings") > 0)
    shapes = shapes.withColumn("_edges", geo.ring_edges("rings"))
    # As generated columns the centre is computed once.
    shapes = shapes.select("*", F.inline(F.array(F.struct(*[c.alias(a) for c, a in zip(_centre("rings"), ("_lon", "_lat"))]))))
    within = F.coalesce(geo.strictly_inside("_lon", "_lat", "_edges"), F.lit(False))
    shape = F.struct("rings", F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), within.alias("within"))
    # The hash of a place is taken once per incident, not once per span.
    units = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: hashed_unit("incident_id", i.cast("string"))) if n > 1 else F.array().cast("array<double>")
    held = shapes.groupBy("incident_id").agg(F.collect_list(shape).alias("_shapes")).withColumn("_units", units)
    kind = held.schema["incident_id"].dataType
    schema = StructType([StructField("incident_id", kind), StructField("i", IntegerType()), StructField("lon", DoubleType()), StructField("lat", DoubleType())])
    return held.mapInArrow(lambda batches: _placed(batches, lines), schema)


def _spans(x: np.ndarray, y: np.ndarray, ends: np.ndarray, lines: int) -> tuple[np.ndarray, ...]:
    """``ring, k, y, x0, x1, share`` of ``scan_spans`` for one shape, in the order of ring, line and place.

    ``ends`` are where its closed rings end in ``x, y``. Lines meet the edges in blocks, so a shape of many rings takes no more memory.
    """
    begins = np.concatenate([[0], ends[:-1]])
    first = np.ones(len(x), bool)
    first[ends - 1] = False
    at = np.flatnonzero(first)
    x1, y1, x2, y2 = x[at], y[at], x[at + 1], y[at + 1]
    owner = np.searchsorted(ends, at, side="right")
    # A missing coordinate is NaN here, which bounds leave out and no line meets.
    low = np.fmin.reduceat(y, begins)
    step = (np.fmax.reduceat(y, begins) - low) / lines
    rings = np.flatnonzero(step > 0)
    ring, k = np.repeat(rings, lines), np.tile(np.arange(lines), len(rings))
    level = low[ring] + (k + 0.5) * step[ring]
    bottom, top = np.minimum(y1, y2), np.maximum(y1, y2)
    block, parts = max(1, CROSSINGS // max(1, len(at))), []
    for start in range(0, len(level), block):
        here = level[start : start + block, None]
        line, e = np.nonzero((bottom <= here) & (here < top))
        line += start
        cut = x1[e] + (level[line] - y1[e]) * (x2[e] - x1[e]) / (y2[e] - y1[e])
        order = np.lexsort((owner[e], cut, line))
        line, cut, own = line[order], cut[order], owner[e][order]
        # Cuts of a line come in pairs; an odd last one has no partner.
        place = np.arange(len(line)) - np.searchsorted(line, line)
        left = np.flatnonzero((place[:-1] % 2 == 0) & (line[:-1] == line[1:])) if len(line) else np.empty(0, int)
        left = left[(own[left] == ring[line[left]]) & (cut[left] < cut[left + 1])]
        parts.append((ring[line[left]], k[line[left]], level[line[left]], cut[left], cut[left + 1], (cut[left + 1] - cut[left]) * step[ring[line[left]]]))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else tuple(np.empty(0) for _ in range(6))


def _placed(batches: Iterator[pa.RecordBatch], lines: int) -> Iterator[pa.RecordBatch]:
    """Points of incidents with their shapes and the hashes of their places."""
    for batch in batches:
        ids, held, hashes = (batch[c] for c in ("incident_id", "_shapes", "_units"))
        shapes = held.flatten()
        rings = shapes.field("rings")
        points = rings.flatten()
        corners = points.flatten()
        x, y = (c.to_numpy(zero_copy_only=False) for c, _ in sorted(zip(corners.flatten(), corners.type), key=lambda c: c[1].name))
        centre = [shapes.field(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat", "within")]
        base = lambda a: a.offsets.to_numpy() - a.offsets[0].as_py()
        to_shape, to_ring, to_point, to_unit = base(held), base(rings), base(points), base(hashes)
        units = hashes.flatten().to_numpy(zero_copy_only=False)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        out: list[tuple[np.ndarray, ...]] = []
        for row in range(batch.num_rows):
            parts = []
            for s in range(to_shape[row], to_shape[row + 1]):
                cuts = to_point[to_ring[s] : to_ring[s + 1] + 1]
                parts.append(_spans(x[cuts[0] : cuts[-1]], y[cuts[0] : cuts[-1]], cuts[1:] - cuts[0], lines))
            spans = [np.concatenate(c) for c in zip(*parts)]
            if not len(spans[0]):
                continue
            if len(parts) > 1:
                along = np.lexsort((spans[3], spans[1], spans[0]))
                spans = [c[along] for c in spans]
            _, _, level, x0, x1, share = spans
            # Neighbours share their bound; a place beyond the last rounding of the total falls into the last span.
            upto = np.cumsum(share)
            place = units[to_unit[row] : to_unit[row + 1]] * upto[-1]
            at = np.searchsorted(upto[:-1], place, side="right")
            inside = (place - np.where(at > 0, upto[at - 1], 0.0)) / share[at]
            lon = x0[at] + np.clip(inside, 1e-6, 1 - 1e-6) * (x1[at] - x0[at])
            out.append((np.full(len(at), row), np.arange(1, len(at) + 1), lon, level[at]))
            if known[row]:
                here, longest = slice(to_shape[row], to_shape[row + 1]), share.argmax()
                within = centre[2][here].astype(bool)
                lon = np.where(within, centre[0][here], (x0[longest] + x1[longest]) / 2)
                out.append((np.full(len(lon), row), np.zeros(len(lon), int), lon, np.where(within, centre[1][here], level[longest])))
        if out:
            row, i, lon, lat = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(i, pa.int32()), pa.array(lon, pa.float64()), pa.array(lat, pa.float64())], names=["incident_id", "i", "lon", "lat"])


def cells_of_points_inside(incidents: DataFrame, n: int, cell: float, lines: int = 64) -> DataFrame:
    """Distinct grid cells ``incident_id, ix, iy`` of ``n`` points inside every perimeter, its centre among them."""
    points = points_inside(incidents, n, lines)
    return points.select("incident_id", F.floor(F.col("lon") / cell).cast("int").alias("ix"), F.floor(F.col("lat") / cell).cast("int").alias("iy")).distinct()
