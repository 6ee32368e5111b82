"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative per group.

1. Equal vectors of a label become one class with a count.
2. Per label (and length), spherical k-means on a bounded sample gives cells of about ``cell_rows`` classes.
3. A class lives in the cell of its nearest centroid A. It also visits each later cell B that can hold
   a partner. A partner in B lies beyond the border of B with A, and with every other cell C;
   x.(C-B)/|C-B| is the sine of the angle of x to that border, and the partner lies within
   acos(threshold) of x. B is left out where one of the ``NEAREST`` cells C is further than that from
   its border with B, so every pair is found whatever the data. ``reach`` scales the bound; less than
   the default of 1 loses pairs.
4. Cells and their visitors are cut into packs of at most about ``pack_rows`` classes; a row of the pair table is one
   product of two packs. It returns link counts and one link to its local root per class, never pairs. Each pair of
   classes meets in one product only.
5. Links become components; the smallest vec_id of a component is its representative.

Counting the links of a dense group takes the square of its size in products, in bounded blocks; rows moved and
returned stay in proportion to packs.

Cases. Vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows with a NULL label or NULL
vec_id, link with nothing: 0 links, their own component. Vectors of different lengths are never compared. Repeated
rows are vectors of their own and link with each other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeframe.llm.common import schema_with, staged
from plumeframe.llm.components import components
from plumeframe.llm.vectors import finite, matrix
from plumeframe.scale import skew_join

KEY = ["label", "dim"]
#: Cells whose borders are looked at for each row; more leave out more visits and cost more comparisons.
NEAREST = 8


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def spherical_kmeans(units: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Unit centroids; a cell left empty takes the vector furthest from its centroid."""
    rng = np.random.default_rng(seed)
    centres = units[rng.permutation(len(units))[:cells]].copy()
    for _ in range(rounds):
        near = units @ centres.T
        at = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, units)
        norms = np.linalg.norm(sums, axis=1)
        empty = norms < 1e-12
        sums[empty] = units[near.max(axis=1).argsort()[: empty.sum()]]
        centres = sums / np.where(empty, 1.0, norms)[:, None]
    return centres


def _visits(units: np.ndarray, centres: np.ndarray, sine: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row, and the later cells that are within the sine of the borders of its nearest cells."""
    near = units @ centres.T
    home = near.argmax(axis=1)
    apart = np.linalg.norm(centres[:, None, :] - centres[None, :, :], axis=2)
    close = np.arange(len(centres))[None, :] > home[:, None]
    rows = np.arange(len(units))
    some = min(NEAREST, len(centres))
    for c in np.vstack([home, np.argpartition(-near, some - 1, axis=1)[:, :some].T]):
        close &= near[rows, c][:, None] - near <= sine * apart[c] + 1e-9  # rounding
    return home, close


def fit_cells(classes: DataFrame, cell_rows: int, max_cells: int, sample_rows: int, rounds: int, seed: int) -> DataFrame:
    """``label, dim, cells, centre`` rows from about ``sample_rows`` classes of each label."""
    sizes = classes.groupBy(*KEY).agg(F.count("*").alias("classes"))
    sizes = sizes.withColumn("cells", F.least(F.ceil(F.col("classes") / cell_rows), F.lit(max_cells)).cast("int"))
    share = F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.col("classes"))
    drawn = classes.join(sizes, KEY).filter(F.pmod(F.xxhash64(F.lit(seed), "rep"), F.lit(1 << 30)) < share * (1 << 30))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        units = unit_rows(matrix(table["vector"].combine_chunks()))
        centres = spherical_kmeans(units, min(table["cells"][0].as_py(), len(units)), rounds, seed)
        head = {k: pa.array([table[k][0].as_py()] * len(centres), table.schema.field(k).type) for k in KEY}
        return pa.table({**head, "cell": pa.array(range(len(centres)), pa.int32()), "centre": pa.array(list(centres), pa.list_(pa.float64()))})

    kind = dict(classes.dtypes)["label"]
    return drawn.select(*KEY, "rep", "vector", "cells").groupBy(*KEY).applyInArrow(fit, f"label {kind}, dim int, cell int, centre array<double>")


def _assign(classes: DataFrame, centres: DataFrame, threshold: float, reach: float, chunk_rows: int) -> DataFrame:
    """Classes with their home ``cell`` and the cells they ``visit``; a label is dealt over chunks that each get its centroids."""
    sizes = classes.groupBy(*KEY).agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    rows = classes.join(sizes, KEY).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).drop("chunks")
    spread = centres.join(sizes, KEY).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    schema = schema_with(classes, cell="int", visits="array<int>")

    def place(rows: pa.Table, centres: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["chunk"])
        if centres.num_rows == 0 or rows.num_rows == 0:
            home, visits = np.zeros(rows.num_rows, np.int32), [[]] * rows.num_rows
        else:
            centres = centres.sort_by("cell")
            points = matrix(centres["centre"].combine_chunks())
            home, close = _visits(unit_rows(matrix(rows["vector"].combine_chunks())), points, reach * np.sqrt(1 - max(threshold, 0.0) ** 2))
            visits = [np.flatnonzero(c).astype(np.int32) for c in close]
        return rows.append_column("cell", pa.array(home.astype(np.int32))).append_column("visits", pa.array(visits, pa.list_(pa.int32())))

    keys = [*KEY, "chunk"]
    return rows.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(place, schema)


def _packs(placed: DataFrame, pack_rows: int) -> DataFrame:
    """Rows of at most about ``pack_rows`` classes: the residents of a cell, or its visitors."""
    cell = [*KEY, "cell", "resident"]
    rows = placed.select(*KEY, "cell", F.lit(True).alias("resident"), "rep", "n", "vector").unionByName(
        placed.select(*KEY, F.explode("visits").alias("cell"), F.lit(False).alias("resident"), "rep", "n", "vector")
    )
    sizes = rows.groupBy(*cell).agg(F.ceil(F.count("*") / pack_rows).alias("packs"))
    return (
        rows.join(sizes, cell)
        .withColumn("pack", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("packs")).cast("int"))
        .groupBy(*cell, "pack")
        .agg(F.collect_list(F.struct("rep", "n", "vector")).alias("rows"))
    )


def local_roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id reachable inside a block of links, for its rows and for its columns."""
    a, b = left.copy(), right.copy()
    high = np.iinfo(np.int64).max
    while True:
        down = np.minimum(a, np.where(linked, b[None, :], high).min(axis=1, initial=high))
        across = np.minimum(b, np.where(linked, down[:, None], high).min(axis=0, initial=high))
        if (down == a).all() and (across == b).all():
            return a, b
        a, b = down, across


def _products(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            sides = []
            for name in ("rows", "others"):
                rows = batch[name][i].values
                sides.append((rows.field("rep").to_numpy(), rows.field("n").to_numpy(), unit_rows(matrix(rows.field("vector")))))
            (a, na, va), (b, nb, vb) = sides
            linked = va @ vb.T >= threshold
            same = batch["same"][i].as_py()
            if same:  # the second list may come in another order
                linked &= a[:, None] != b[None, :]
            ia, ib = linked.any(axis=1), linked.any(axis=0)
            linked = linked[np.ix_(ia, ib)]
            ra, rb = local_roots(linked, a[ia], b[ib])
            out = [(a[ia], linked @ nb[ib], ra)]
            if not same:
                out.append((b[ib], na[ia] @ linked, rb))
            for rep, links, root in out:
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links.astype(np.int64)), pa.array(root)], names=["rep", "links", "root"])


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.93,
    reach: float = 1.0,
    cell_rows: int = 2_000,
    max_cells: int = 256,
    sample_rows: int = 20_000,
    pack_rows: int = 2_000,
    rounds: int = 8,
    seed: int = 11,
    rows_per_task: int = 50_000,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id, embedding, label``)."""
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("vector"))
    part = finite("vector") & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    part = F.coalesce(part, F.lit(False))
    valid = rows.filter(part).withColumn("dim", F.size("vector"))
    # A number of its own for each class, so that an id under two labels is no bridge between them.
    counted = valid.groupBy(*KEY, "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    every = staged(counted.withColumn("rep", F.monotonically_increasing_id()), "classes")
    classes = every.drop("least")
    centres = staged(fit_cells(classes, cell_rows, max_cells, sample_rows, rounds, seed), "centres")
    placed = staged(_assign(classes, centres, threshold, reach, chunk_rows=4_000), "placed")
    packs = staged(_packs(placed, pack_rows), "packs")

    cell = [*KEY, "cell"]
    names = packs.select(*cell, "resident", "pack")
    here = names.filter("resident").select(*cell, "pack")
    others = names.select(*cell, F.col("resident").alias("resident_"), F.col("pack").alias("pack_"))
    pairs = here.join(others, cell).filter(~F.col("resident_") | (F.col("pack_") <= F.col("pack")))
    left = packs.filter("resident").select(*cell, "pack", "rows")
    right = packs.select(*cell, F.col("resident").alias("resident_"), F.col("pack").alias("pack_"), F.col("rows").alias("others"))
    met = pairs.join(left, [*cell, "pack"]).join(right, [*cell, "resident_", "pack_"])
    met = met.select("rows", "others", (F.col("resident_") & (F.col("pack") == F.col("pack_"))).alias("same"))
    found = staged(met.mapInArrow(lambda batches: _products(batches, threshold), "rep long, links long, root long"), "links")

    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    grouped = every.join(links, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    outcome = skew_join(grouped, smallest, ["root"], ["rep"], rows_per_task=rows_per_task).select(
        "label", "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    linked = skew_join(valid, outcome, ["label", "vector"], ["vec_id"], rows_per_task=rows_per_task).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
