"""Gridded fields: sampling at points, patches on a lattice, raster cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeframe.config import GridSpec
from plumeframe.functions import geo
from plumeframe.scale import stored


# ---- fields ----------------------------------------------------------------------------------


def read_field(fields: DataFrame, grid_coords: DataFrame | None, variable: str, level: str, run_time=None) -> DataFrame:
    """One variable at one level (and one run), with coordinates filled from the level's grid table."""
    out = fields.filter((F.col("variable") == variable) & (F.col("level") == level))
    if run_time is not None:
        stamp = F.lit(run_time).cast("timestamp")
        out = out.filter((F.col("run_time") == stamp) & (F.col("run_date") == F.to_date(stamp)))
    if grid_coords is not None:
        coords = grid_coords.select("level", "iy", "ix", F.col("x").alias("_x"), F.col("y").alias("_y"))
        out = out.join(coords, ["level", "iy", "ix"], "left").withColumns(
            {"x": F.coalesce("x", "_x"), "y": F.coalesce("y", "_y")}
        ).drop("_x", "_y")
    return out


def available_runs(fields: DataFrame) -> DataFrame:
    """Distinct (run_time, variable, level). Give the catalog of written fields, which has one row each, where there is one."""
    return fields.select("run_time", "variable", "level").distinct()


def split_by_availability(wanted: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (run_time, variable, level) that exist, and those that do not."""
    keys = ["run_time", "variable", "level"]
    have = available_runs(fields)
    return wanted.join(have, keys, "left_semi"), wanted.join(have, keys, "left_anti")


def _axis(position: Column, size: int) -> tuple[Column, Column]:
    """Lower cell and fraction of a position on an axis; the last edge uses the last cell."""
    base = F.least(F.floor(position), F.lit(size - 2)).cast("int")
    return base, position - base


def _corner_sample(points: DataFrame, fields: DataFrame, grid: GridSpec, keys: Sequence[str], slots: int) -> DataFrame:
    """``keys, station_id, value0..``: bilinear value at every point of each ``_slot`` of the fields, NULL where a corner is missing.

    The distinct cells that points lie in meet the fields first, by their four corners, so the fields are filtered to needed
    cells where they are read. Their corner values become one row per cell and key; a point then meets one row per key and
    is computed in place. Few points make many rows, so they are spread over tasks first.
    """
    px = (F.col("x") - grid.x0) / grid.dx
    py = (F.col("y") - grid.y0) / grid.dy
    inside = px.between(0, grid.nx - 1) & py.between(0, grid.ny - 1)
    (bx, fx), (by, fy) = _axis(px, grid.nx), _axis(py, grid.ny)
    located = points.filter(inside).select("station_id", by.alias("_cy"), bx.alias("_cx"), fy.alias("_fy"), fx.alias("_fx"))
    sides = [(dy, dx) for dy in (0, 1) for dx in (0, 1)]
    corner = lambda i, dy, dx: F.struct((F.col("_cy") + dy).alias("iy"), (F.col("_cx") + dx).alias("ix"), F.lit(i).alias("_corner"))
    corners = located.select("_cy", "_cx").distinct().select("_cy", "_cx", F.inline(F.array(*[corner(i, *d) for i, d in enumerate(sides)])))
    found, values = [], []
    for slot in range(slots):
        here = F.col("_slot") == slot
        found.append(F.count_if(here).alias(f"_n{slot}"))
        found += [F.max(F.when(here & (F.col("_corner") == i), F.col("value"))).alias(f"_v{slot}_{i}") for i in range(4)]
        weighted = [
            (F.col("_fy") if dy else 1 - F.col("_fy")) * (F.col("_fx") if dx else 1 - F.col("_fx")) * F.col(f"_v{slot}_{i}")
            for i, (dy, dx) in enumerate(sides)
        ]
        values.append(F.when(F.col(f"_n{slot}") == 4, sum(weighted[1:], weighted[0])).alias(f"value{slot}"))
    cells = fields.select(*keys, "_slot", "iy", "ix", "value").filter(F.col("value").isNotNull())
    # Read back with its size: where it is small Spark sends it to the points, which stay spread.
    around = stored(cells.join(corners, ["iy", "ix"]).groupBy(*keys, "_cy", "_cx").agg(*found))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return located.repartition(tasks, "station_id").join(around, ["_cy", "_cx"]).select(*keys, "station_id", *values)


def bilinear_sample(points: DataFrame, fields: DataFrame, grid: GridSpec, keys: Sequence[str] = ("run_time",)) -> DataFrame:
    """Bilinear value of every field at every point (``station_id, x, y``); outside the grid there is none.

    A missing corner makes the value missing.
    """
    sampled = _corner_sample(points, fields.withColumn("_slot", F.lit(0)), grid, keys, 1)
    return sampled.filter(F.col("value0").isNotNull()).withColumnRenamed("value0", "value")


def sample_two_fields(points: DataFrame, fields: DataFrame, grid: GridSpec, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Two variables at every point and run hour in one pass over the fields; NULL where one is missing."""
    chosen = [((F.col("variable") == v) & (F.col("level") == lv)) for v, lv in (first, second)]
    kept = fields.filter(chosen[0] | chosen[1]).withColumn("_slot", F.when(chosen[0], 0).otherwise(1))
    sampled = _corner_sample(points, kept, grid, ["run_time"], 2)
    some = sampled.filter(F.col("value0").isNotNull() | F.col("value1").isNotNull())
    return some.select("station_id", F.col("run_time").alias("hour_utc"), "value0", "value1")


def nearest_index_regular(value: Column, origin: float, step: float, size: int) -> Column:
    """Nearest index on a regular axis, rising or falling; ties go to the larger axis value, ends clip."""
    position = (value - origin) / step
    index = F.floor(position + 0.5) if step > 0 else F.ceil(position - 0.5)
    return F.least(F.greatest(index, F.lit(0)), F.lit(size - 1)).cast("int")


def nearest_index(points: DataFrame, value: str, axis: DataFrame, name: str = "axis_index", steps: int = 256) -> DataFrame:
    """Nearest index on any axis table (``axis_index, axis_value``); ties go to the larger value.

    The axis becomes half-open intervals between midpoints; intervals and points meet on a coarse
    bin of the value, the bin width coming from the axis itself. Only the axis (one row per grid
    line) is ordered in one place.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("axis_value")
    ends = axis.agg(F.struct(F.min("axis_value").alias("lo"), F.max("axis_value").alias("hi")).alias("e")).scalar()
    width = F.greatest((ends["hi"] - ends["lo"]) / steps, F.lit(1e-9))

    def bin_of(c: Column) -> Column:
        return F.floor((F.least(F.greatest(c, ends["lo"]), ends["hi"]) - ends["lo"]) / width).cast("int")

    lower = (F.lag("axis_value").over(w) + F.col("axis_value")) / 2
    upper = (F.lead("axis_value").over(w) + F.col("axis_value")) / 2
    parts = (
        axis.withColumn("_lo", lower)
        .withColumn("_hi", upper)
        .withColumn("_bin", F.explode(F.sequence(bin_of(F.coalesce("_lo", ends["lo"])), bin_of(F.coalesce("_hi", ends["hi"])))))
        .select("_bin", "_lo", "_hi", F.col("axis_index").alias(name))
    )
    v = F.col(value)
    fits = (F.col("_lo").isNull() | (v >= F.col("_lo"))) & (F.col("_hi").isNull() | (v < F.col("_hi")))
    return points.withColumn("_bin", bin_of(v)).join(parts, "_bin").filter(fits).drop("_bin", "_lo", "_hi")


# ---- patches ---------------------------------------------------------------------------------


def subset_window(df: DataFrame, grid: GridSpec, box: Sequence[str] = ("xmin", "ymin", "xmax", "ymax")) -> DataFrame:
    """Index range of the grid coordinates inside a projected box; fewer than two per axis drops the row."""
    xmin, ymin, xmax, ymax = (F.col(c) for c in box)

    def first(v: Column, origin: float, step: float) -> Column:
        return F.greatest(F.ceil((v - origin) / step), F.lit(0)).cast("int")

    def last(v: Column, origin: float, step: float, size: int) -> Column:
        return F.least(F.floor((v - origin) / step), F.lit(size - 1)).cast("int")

    return df.withColumns(
        {
            "ix0": first(xmin, grid.x0, grid.dx),
            "ix1": last(xmax, grid.x0, grid.dx, grid.nx),
            "iy0": first(ymin, grid.y0, grid.dy),
            "iy1": last(ymax, grid.y0, grid.dy, grid.ny),
        }
    ).filter((F.col("ix1") - F.col("ix0") >= 1) & (F.col("iy1") - F.col("iy0") >= 1))


def gather_windows(requests: DataFrame, fields: DataFrame, keys: Sequence[str], match: Sequence[str], block: int = 16) -> DataFrame:
    """Field values of every request's index window as one dense row-major array.

    ``requests`` carries ``ix0..iy1`` and the columns in ``match``. Each distinct (match, window) is gathered once: fields and
    windows meet on (match, block of the grid), the blocks a window touches being exploded on the window side. One
    group is one window, so its size is set by the box of an incident, not by the data. Requests then look up
    their window, spread over tasks, as what is done with it makes many rows of one.
    """
    window = ["ix0", "ix1", "iy0", "iy1"]
    wanted = [*match, *window]
    spread = requests.select(*wanted).distinct().withColumn(
        "_by", F.explode(F.sequence(F.floor(F.col("iy0") / block).cast("int"), F.floor(F.col("iy1") / block).cast("int")))
    ).withColumn(
        "_bx", F.explode(F.sequence(F.floor(F.col("ix0") / block).cast("int"), F.floor(F.col("ix1") / block).cast("int")))
    )
    cells = fields.select(
        *match, "iy", "ix", "value",
        F.floor(F.col("iy") / block).cast("int").alias("_by"), F.floor(F.col("ix") / block).cast("int").alias("_bx"),
    )
    inside = F.col("iy").between(F.col("iy0"), F.col("iy1")) & F.col("ix").between(F.col("ix0"), F.col("ix1"))
    joined = spread.join(cells, [*match, "_by", "_bx"]).filter(inside)
    grouped = joined.groupBy(*wanted).agg(F.sort_array(F.collect_list(F.struct("iy", "ix", "value"))).alias("_cells"))
    full = (F.col("ix1") - F.col("ix0") + 1) * (F.col("iy1") - F.col("iy0") + 1)
    held = grouped.filter(F.size("_cells") == full).withColumn("window", F.transform("_cells", lambda c: c["value"])).drop("_cells")
    kept = [*keys, *[c for c in wanted if c not in keys]]
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return requests.select(*kept).repartition(tasks, *keys).distinct().join(held, wanted).select(*kept, "window")


def _interpolate(window: Column, px: Column, py: Column, width: Column, height: Column) -> Column:
    bx = F.least(F.floor(px), width - 2)
    by = F.least(F.floor(py), height - 2)
    fx, fy = px - bx, py - by

    def at(dy: int, dx: int) -> Column:
        return F.get(window, ((by + dy) * width + bx + dx).cast("int"))

    return (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy


def resample_patch(windows: DataFrame, shape: tuple[int, int], name: str = "patch") -> DataFrame:
    """Bilinear h x w patch of each window; the lattice spans the window's own first to last coordinate."""
    h, w = shape
    width = F.col("ix1") - F.col("ix0") + 1
    height = F.col("iy1") - F.col("iy0") + 1

    def value(i: Column) -> Column:
        px = (i % w) * (width - 1) / (w - 1)
        py = F.floor(i / w) * (height - 1) / (h - 1)
        return _interpolate(F.col("window"), px, py, width, height)

    lattice = F.sequence(F.lit(0), F.lit(h * w - 1))
    return windows.withColumn(name, F.transform(lattice, value)).drop("window", "ix0", "ix1", "iy0", "iy1")


def fixed_grid(df: DataFrame, pixel_m: float, max_dim: int | None = None, box: Sequence[str] = ("xmin", "ymin", "xmax", "ymax")) -> DataFrame:
    """Cells of fixed size over a box: ``nx, ny``; smaller than 2, or larger than a given ``max_dim``, drops the row."""
    xmin, ymin, xmax, ymax = (F.col(c) for c in box)
    nx = F.ceil(F.greatest(xmax - xmin, F.lit(pixel_m)) / pixel_m).cast("int")
    ny = F.ceil(F.greatest(ymax - ymin, F.lit(pixel_m)) / pixel_m).cast("int")
    kept = df.withColumn("nx", nx).withColumn("ny", ny).filter((F.col("nx") >= 2) & (F.col("ny") >= 2))
    return kept if max_dim is None else kept.filter((F.col("nx") <= max_dim) & (F.col("ny") <= max_dim))


def resample_fixed(windows: DataFrame, grid: GridSpec, pixel_m: float, name: str = "patch") -> DataFrame:
    """Bilinear values at the centres of fixed-size cells (``xmin, ymin, nx, ny``); NULL outside the window."""
    width = F.col("ix1") - F.col("ix0") + 1
    height = F.col("iy1") - F.col("iy0") + 1

    def value(i: Column) -> Column:
        x = F.col("xmin") + (i % F.col("nx") + 0.5) * pixel_m
        y = F.col("ymin") + (F.floor(i / F.col("nx")) + 0.5) * pixel_m
        px = (x - grid.x0) / grid.dx - F.col("ix0")
        py = (y - grid.y0) / grid.dy - F.col("iy0")
        inside = px.between(0, width - 1) & py.between(0, height - 1)
        return F.when(inside, _interpolate(F.col("window"), px, py, width, height))

    lattice = F.sequence(F.lit(0), F.col("nx") * F.col("ny") - 1)
    return windows.withColumn(name, F.transform(lattice, value)).drop("window", "ix0", "ix1", "iy0", "iy1")


def fixed_tiles(boxes: DataFrame, grid: GridSpec, pixel_m: float, tile: int = 256) -> DataFrame:
    """Boxes of fixed-size cells (``xmin, ymin, nx, ny`` and their index window) cut into tiles of at most ``tile`` cells a side.

    A tile asks only for the field cells that its own cells lie between: its window is its part of the box's
    window and one cell more on each side, so a box of any width is resampled in pieces of bounded size. ``wx0..wy1`` keep the
    window of the whole box, which decides what is outside. Tiles outside the window have no values and are left out.
    """
    whole = boxes.withColumnsRenamed({"ix0": "wx0", "ix1": "wx1", "iy0": "wy0", "iy1": "wy1"})
    count = lambda n: F.sequence(F.lit(0), F.floor((F.col(n) - 1) / tile).cast("int"))
    out = whole.withColumn("ty", F.explode(count("ny"))).withColumn("tx", F.explode(count("nx")))

    def part(axis: str, n: str, low: str, origin: float, step: float) -> tuple[Column, Column]:
        first = F.col(f"t{axis}") * tile
        last = F.least(F.col(n), first + tile) - 1
        at = lambda g: F.floor((F.col(low) + (g + 0.5) * pixel_m - origin) / step)
        begin, end = F.col(f"w{axis}0"), F.col(f"w{axis}1")
        start = F.least(F.greatest(at(first), begin), end - 1)
        return start.cast("int"), F.least(F.greatest(at(last) + 1, start + 1), end).cast("int")

    (x0, x1), (y0, y1) = part("x", "nx", "xmin", grid.x0, grid.dx), part("y", "ny", "ymin", grid.y0, grid.dy)
    return out.withColumns({"ix0": x0, "ix1": x1, "iy0": y0, "iy1": y1})


def resample_tiles(tiles: DataFrame, grid: GridSpec, pixel_m: float, tile: int = 256) -> DataFrame:
    """Bilinear values of the tiles' cells as long rows ``iy, ix, value`` (numbered in the whole box); NULL outside its window."""
    def along(axis: str, low: str, origin: float, step: float) -> Column:
        """Cells of a tile on one axis with their lower field cell in the tile's window (none outside) and their place behind it."""
        cells = F.sequence(F.col(f"t{axis}") * tile, F.least(F.col(f"n{axis}"), (F.col(f"t{axis}") + 1) * tile) - 1)

        def cell(i: Column) -> Column:
            place = (F.col(low) + (i + 0.5) * pixel_m - origin) / step
            inside = place.between(F.col(f"w{axis}0"), F.col(f"w{axis}1"))
            here = place - F.col(f"i{axis}0")
            base = F.least(F.floor(here), F.col(f"i{axis}1") - F.col(f"i{axis}0") - 1).cast("int")
            return F.struct(i.alias("i"), F.when(inside, base).alias("base"), (here - base).alias("f"))

        return F.explode(F.transform(cells, cell))

    # Per row and per column of a tile, not per cell: the expression of a cell stays short.
    cells = tiles.withColumn("_y", along("y", "ymin", grid.y0, grid.dy)).withColumn("_x", along("x", "xmin", grid.x0, grid.dx))
    width, fx, fy = F.col("ix1") - F.col("ix0") + 1, F.col("_x.f"), F.col("_y.f")
    at = lambda dy, dx: F.get("window", (F.col("_y.base") + dy) * width + F.col("_x.base") + dx)
    value = (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy
    out = cells.withColumns({"iy": F.col("_y.i"), "ix": F.col("_x.i"), "value": value})
    return out.drop("window", "ix0", "ix1", "iy0", "iy1", "wx0", "wx1", "wy0", "wy1", "tx", "ty", "_x", "_y")


def patch_cells(patches: DataFrame, width: int | str, patch: str = "patch") -> DataFrame:
    """Dense patches as long cells (iy, ix, value)."""
    w = F.col(width) if isinstance(width, str) else F.lit(width)
    keep = [c for c in patches.columns if c != patch]
    long = patches.select(*keep, F.posexplode(patch).alias("_i", "value"))
    return long.withColumn("iy", F.floor(F.col("_i") / w).cast("int")).withColumn("ix", (F.col("_i") % w).cast("int")).drop("_i")


def mean_patches(patches: DataFrame, keys: Sequence[str], expected: int, patch: str = "patch") -> DataFrame:
    """Cell-wise mean of a sample's hourly patches; a missing hour drops the sample, a missing cell stays missing.

    A group holds at most one patch per source hour, so the collected arrays are bounded.
    """
    grouped = patches.groupBy(*keys).agg(F.collect_list(patch).alias("_p")).filter(F.size("_p") == expected)
    size = F.size(F.col("_p")[0])

    def mean(i: Column) -> Column:
        return F.aggregate(F.col("_p"), F.lit(0.0), lambda acc, p: acc + p[i].cast("double")) / expected

    return grouped.withColumn(patch, F.transform(F.sequence(F.lit(0), size - 1), mean)).drop("_p")


def mean_cells(cells: DataFrame, keys: Sequence[str], expected: int) -> DataFrame:
    """Long form of the same: mean over hours; a cell missing in one hour is missing, an hour missing drops the sample."""
    keys = list(keys)
    hours = cells.groupBy(*keys).agg(F.count_distinct("run_time").alias("_h")).filter(F.col("_h") == expected).drop("_h")
    full = cells.join(hours, keys, "left_semi")
    present = F.count("value") == F.count("*")
    return full.groupBy(*keys, "iy", "ix").agg(F.when(present, F.avg("value")).alias("value"))


# ---- rasters of points -----------------------------------------------------------------------


def rasterize_lattice(pairs: DataFrame, keys: Sequence[str], shape: tuple[int, int]) -> DataFrame:
    """FRP per lattice cell of a box (``xmin..ymax``), closed bounds, half-even index; empty cells are absent."""
    h, w = shape
    x, y = F.col("x"), F.col("y")
    xmin, ymin, xmax, ymax = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    kept = pairs.filter((xmax > xmin) & (ymax > ymin) & x.between(xmin, xmax) & y.between(ymin, ymax))
    return kept.groupBy(
        *keys, geo.gridded_index(y, ymin, ymax, h).alias("iy"), geo.gridded_index(x, xmin, xmax, w).alias("ix")
    ).agg(F.sum("frp").alias("value"))


def rasterize_fixed(pairs: DataFrame, keys: Sequence[str], pixel_m: float, extra: Sequence[Column] = ()) -> DataFrame:
    """FRP and hits per fixed-size cell (``xmin, ymin, nx, ny``), half-open bounds, floor index; a row with ``n`` is ``n`` hits."""
    ix = F.floor((F.col("x") - F.col("xmin")) / pixel_m).cast("int")
    iy = F.floor((F.col("y") - F.col("ymin")) / pixel_m).cast("int")
    inside = (
        (F.col("x") >= F.col("xmin")) & (F.col("y") >= F.col("ymin"))
        & (F.col("x") < F.col("xmin") + F.col("nx") * pixel_m) & (F.col("y") < F.col("ymin") + F.col("ny") * pixel_m)
    )
    clipped = [F.least(F.greatest(i, F.lit(0)), F.col(n) - 1).alias(a) for i, n, a in ((iy, "ny", "iy"), (ix, "nx", "ix"))]
    hits = F.sum("n") if "n" in pairs.columns else F.count("*")
    return pairs.filter(inside).groupBy(*keys, *clipped).agg(F.sum("frp").alias("value"), hits.alias("hits"), *extra)


def latest_hit_day(hits: DataFrame, keys: Sequence[str], day: str = "day_index") -> DataFrame:
    """Last day (1-based) on which each cell was hit."""
    return hits.groupBy(*keys, "iy", "ix").agg((F.max(day) + 1).cast("int").alias("latest_day"))


def band_means(pixels: DataFrame, keys: Sequence[str], bands: Sequence[str], box: tuple, nx: int, ny: int) -> tuple[DataFrame, DataFrame]:
    """Mean of several bands per lattice cell, and the share of cells hit."""
    west, south, east, north = box
    ix = F.floor((F.col("lon") - west) / (east - west) * (nx - 1)).cast("int")
    iy = F.floor((F.col("lat") - south) / (north - south) * (ny - 1)).cast("int")
    kept = pixels.filter(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    for band in bands:
        kept = kept.filter(F.col(band).isNotNull())
    cells = kept.groupBy(*keys, iy.alias("iy"), ix.alias("ix")).agg(*[F.avg(b).alias(b) for b in bands])
    return cells, cells.groupBy(*keys).agg((F.count("*") / (nx * ny)).alias("coverage"))


def shift_cells(cells: DataFrame, dy: Column | int, dx: Column | int, shape: tuple[int, int]) -> DataFrame:
    """Move cells by (dy, dx); what leaves the lattice is gone, what enters is zero (absent cell)."""
    h, w = shape
    dy = F.lit(dy) if isinstance(dy, int) else dy
    dx = F.lit(dx) if isinstance(dx, int) else dx
    moved = cells.withColumn("iy", F.col("iy") + dy).withColumn("ix", F.col("ix") + dx)
    return moved.filter(F.col("iy").between(0, h - 1) & F.col("ix").between(0, w - 1))


def advect(mass: DataFrame, wind: DataFrame, keys: Sequence[str], lead_hours: int, shape: tuple[int, int], spacing_m: float = 3000.0) -> DataFrame:
    """Shift a mass patch by its sample's mean wind times the lead; ``wind`` has ``u`` and ``v`` per sample."""
    metres = lead_hours * 3600.0 / spacing_m
    moved = mass.join(wind, list(keys))
    dx, dy = F.rint(F.col("u") * metres).cast("int"), F.rint(F.col("v") * metres).cast("int")
    return shift_cells(moved, dy, dx, shape).drop("u", "v")


def patch_mse(prediction: DataFrame, truth: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Mean squared difference per sample over the cells of the truth; an absent prediction cell is zero."""
    keys = list(keys)
    guess = prediction.select(*keys, "iy", "ix", F.col("value").alias("_p"), F.lit(True).alias("_there"))
    joined = truth.join(guess, [*keys, "iy", "ix"], "left")
    value = F.when(F.col("_there"), F.col("_p")).otherwise(0.0)
    return joined.groupBy(*keys).agg(F.avg(F.pow(value - F.col("value"), F.lit(2.0))).alias(name))


def channel_features(cells: DataFrame, key: str, channels: Sequence[str]) -> DataFrame:
    """Spatial mean and population spread per sample and channel, one column each."""
    aggs = []
    for c in channels:
        value = F.when(F.col("channel") == c, F.coalesce("value", F.lit(0.0)))
        aggs += [F.avg(value).alias(f"{c}__mean"), F.stddev_pop(value).alias(f"{c}__std")]
    return cells.filter(F.col("channel").isin(*channels)).groupBy(key).agg(*aggs)


def pool_mean(cells: DataFrame, keys: Sequence[str], shape: tuple[int, int], factor: int) -> DataFrame:
    """Mean of factor x factor blocks; the shape must divide."""
    h, w = shape
    if h % factor or w % factor:
        raise ValueError(f"Cannot pool shape {shape} by factor {factor}")
    return cells.groupBy(
        *keys, F.floor(F.col("iy") / factor).cast("int").alias("iy"), F.floor(F.col("ix") / factor).cast("int").alias("ix")
    ).agg(F.avg(F.coalesce("value", F.lit(0.0))).alias("value"))


# ---- smoothing -------------------------------------------------------------------------------


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [r / total for r in raw]


def _blur_axis(cells: DataFrame, keys: Sequence[str], axis: str, size: int | str, weights: Column, radius: Column) -> DataFrame:
    """One pass: every cell and its two mirror images hand their weighted value to the cells around."""
    n = F.col(size) if isinstance(size, str) else F.lit(size)
    other = "ix" if axis == "iy" else "iy"
    j = F.col(axis)
    carry = [c for c in cells.columns if c not in ("iy", "ix", "value", *keys)]
    images = cells.withColumn("_w", weights).withColumn("_r", radius).withColumn(
        "_j", F.explode(F.array(j, -1 - j, 2 * n - 1 - j))
    )
    reach = images.filter((F.col("_j") + F.col("_r") >= 0) & (F.col("_j") - F.col("_r") < n))
    low = F.greatest(F.col("_j") - F.col("_r"), F.lit(0))
    high = F.least(F.col("_j") + F.col("_r"), n - 1)
    spread = reach.filter(low <= high).withColumn("_i", F.explode(F.sequence(low, high)))
    part = F.col("value") * F.get(F.col("_w"), F.col("_i") - F.col("_j") + F.col("_r"))
    return (
        spread.withColumn("value", part)
        .groupBy(*keys, *carry, F.col("_i").cast("int").alias(axis), F.col(other))
        .agg(F.sum("value").alias("value"))
    )


def gaussian_blur(cells: DataFrame, keys: Sequence[str], shape: tuple, sigma: float | Column) -> DataFrame:
    """Separable Gaussian, cut at four sigma, mirrored edges; a sparse input stays sparse.

    ``sigma`` may be a column (one width per sample). A patch must be at least as wide as the radius.
    """
    if isinstance(sigma, Column):
        radius = F.floor(sigma * 4.0 + 0.5).cast("int")
        raw = F.transform(F.sequence(-radius, radius), lambda k: F.exp(-0.5 * F.pow(k / sigma, F.lit(2.0))))
        total = F.aggregate(raw, F.lit(0.0), lambda acc, v: acc + v)
        weights = F.transform(raw, lambda v: v / total)
    else:
        values = gaussian_weights(sigma)
        radius, weights = F.lit(len(values) // 2), F.array(*[F.lit(v) for v in values])
    out = _blur_axis(cells, keys, "iy", shape[0], weights, radius)
    return _blur_axis(out, keys, "ix", shape[1], weights, radius)


def normalize_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values over the sample's maximum, clipped to 0..1; a sample without positive cells is all zero."""
    peak = cells.groupBy(*keys).agg(F.max("value").alias("_peak"))
    scaled = F.when(F.col("_peak") > 0, F.least(F.greatest(F.col("value") / F.col("_peak"), F.lit(0.0)), F.lit(1.0)))
    return cells.join(peak, list(keys)).withColumn("value", F.coalesce(scaled, F.lit(0.0))).drop("_peak")


def mean_wind(u: DataFrame, v: DataFrame, samples: DataFrame, key: str) -> DataFrame:
    """Mean wind per sample over its hours: mean per hour, then over hours with both; without any, zero."""
    hourly = (
        u.groupBy(key, "run_time").agg(F.avg("value").alias("u"))
        .join(v.groupBy(key, "run_time").agg(F.avg("value").alias("v")), [key, "run_time"])
    )
    means = hourly.groupBy(key).agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    return samples.select(key).join(means, key, "left").fillna(0.0, ["u", "v"])


def spread_baseline(
    seed: DataFrame, wind: DataFrame, key: str, shape: tuple, pixel_m: float, lead_hours: float, gain: float
) -> DataFrame:
    """Next-day likelihood: blurred current cells, moved by the wind and spread by its speed, mixed, scaled.

    ``shape`` is (rows, columns), numbers or column names carried by ``seed``.
    """
    sides = [c for c in shape if isinstance(c, str)]
    keys = [key, *sides]
    soft = gaussian_blur(seed, keys, shape, 1.0).join(wind, key)
    metres = lead_hours * 3600.0 / pixel_m

    def clipped(c: str) -> Column:
        return F.least(F.greatest(F.rint(F.col(c) * metres), F.lit(-48.0)), F.lit(48.0)).cast("int")

    h, w = (F.col(c) if isinstance(c, str) else F.lit(c) for c in shape)
    moved = (
        soft.withColumn("iy", F.col("iy") + clipped("v"))
        .withColumn("ix", F.col("ix") + clipped("u"))
        .filter((F.col("iy") >= 0) & (F.col("iy") < h) & (F.col("ix") >= 0) & (F.col("ix") < w))
    )
    speed = F.hypot("u", "v")
    sigma = F.least(F.greatest(1.2 + gain * speed, F.lit(1.0)), F.lit(8.0))
    wide = gaussian_blur(soft, keys, shape, sigma)
    parts = wide.select(*keys, "iy", "ix", (F.col("value") * 0.6).alias("value")).unionByName(
        moved.select(*keys, "iy", "ix", (F.col("value") * 0.4).alias("value"))
    )
    mixed = parts.groupBy(*keys, "iy", "ix").agg(F.sum("value").alias("value"))
    return normalize_cells(gaussian_blur(mixed, keys, shape, 1.0), keys)


def residual_scores(
    baseline: DataFrame, truth_smooth: DataFrame, truth: DataFrame, keys: Sequence[str], cells_per_sample: Column, clip: float,
    level: float = 0.30,
) -> DataFrame:
    """Intersection over union at a level, and squared error to the smoothed truth, before and after a
    residual clipped to +-``clip``. Cells absent everywhere are zero in all of them."""
    keys = list(keys)
    at = [*keys, "iy", "ix"]
    both = (
        baseline.select(*at, F.col("value").alias("b"))
        .join(truth_smooth.select(*at, F.col("value").alias("t")), at, "full")
        .join(truth.select(*at, F.lit(1).alias("hit")), at, "full")
        .fillna(0.0, ["b", "t"])
        .fillna(0, ["hit"])
    )
    delta = F.least(F.greatest(F.col("t") - F.col("b"), F.lit(-clip)), F.lit(clip))
    fixed = F.least(F.greatest(F.col("b") + delta, F.lit(0.0)), F.lit(1.0))
    both = both.withColumn("f", fixed)

    def iou(c: str) -> Column:
        on, hit = F.col(c) >= level, F.col("hit") == 1
        union = F.count_if(on | hit)
        return F.when(union == 0, 1.0).otherwise(F.count_if(on & hit) / F.greatest(union, F.lit(1)))

    def mse(c: str) -> Column:
        return F.sum(F.pow(F.col(c) - F.col("t"), F.lit(2.0))) / F.first(cells_per_sample)

    return both.groupBy(*keys).agg(
        iou("b").alias("baseline_iou"), iou("f").alias("constrained_iou"),
        mse("b").alias("baseline_mse"), mse("f").alias("constrained_mse"),
    )


def frame_statistics(fields: DataFrame, stride: int, box=(-130.0, 20.0, -60.0, 56.0)) -> DataFrame:
    """Positive cells of a strided field inside a lon/lat box: mean, p99, max per run."""
    from plumeframe.scale import with_quantiles

    positive = positive_cells(fields, stride, box)
    out = positive.groupBy("run_time").agg(
        F.count("*").alias("cells"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value")
    )
    return with_quantiles(out, positive, ["run_time"], {"p99_value": ("value", 0.99)})


def positive_cells(fields: DataFrame, stride: int, box) -> DataFrame:
    west, south, east, north = box
    lon, lat = geo.unproject("x", "y")
    return fields.filter((F.col("iy") % stride == 0) & (F.col("ix") % stride == 0) & (F.col("value") > 0)).filter(
        lon.between(west, east) & lat.between(south, north)
    )


def display_range(fields: DataFrame, stride: int, box=(-130.0, 20.0, -60.0, 56.0)) -> DataFrame:
    """Pooled p20 and p99.95 of the positive cells of all runs."""
    from plumeframe.scale import exact_quantiles

    pooled = exact_quantiles(positive_cells(fields, stride, box), [], {"vmin": ("value", 0.20), "vmax": ("value", 0.9995)})
    return pooled


def mask_on_lattice(pixels: DataFrame, lattice: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Categorical pixels (``iy, ix, mask, quality``) looked up at lattice cells (``gy, gx, iy, ix``)."""
    return pixels.join(lattice, ["iy", "ix"]).select(*keys, "gy", "gx", "mask", "quality")


