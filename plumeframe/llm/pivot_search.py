"""Exact top-k search by integer inner product, with elimination by a pivot table.

Components are turned into integers floor(scale * x). The pivot table holds each vector's distance to
every pivot. For a query q and a candidate c, the largest |d(q,p) - d(c,p)| bounds their distance
from below, so (|q|^2 + |c|^2 - bound^2) / 2 bounds their inner product from above. Candidates are
evaluated in the order of that bound; a query stops when the next bound is below its k-th score, so
the result is exact whatever the pivots are.

Candidates and queries are dealt to lanes of bounded size. A lane works pack by pack and gives at most k rows per query and
pack; a query's best k-th score so far prunes the next packs. Within a pack, candidates that lie near one pivot form blocks
that share a bound, and a block is evaluated as one product for all queries it can still count for.
Pivots are chosen far apart from each other, from a bounded sample; lengths of vectors without pivots fall back on
the bound by norms.

Cases. Vectors that are NULL, empty or hold NULL or non-finite components, and rows with a NULL vec_id, take no
part. Only vectors of the same length are compared. Rows that repeat vec_id and vector count once; a row with the
query's own vec_id is not its candidate. Fewer than k candidates: all of them. Ties go to the smaller vec_id. Scores
beyond a 64-bit integer are out of range. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeframe.llm.common import schema_with, staged
from plumeframe.llm.vectors import finite, matrix

EXACT = 1 << 53
#: Packs of candidates that one lane takes at most.
LANE_PACKS = 8


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Vectors far from each other: each next one is the furthest from those chosen."""
    chosen = [int(np.linalg.norm(sample - sample.mean(axis=0), axis=1).argmax())]
    away = np.linalg.norm(sample - sample[chosen[0]], axis=1)
    while len(chosen) < min(pivots, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def pivot_table(
    vectors: DataFrame, pivots: int = 32, sample_rows: int = 2_000, scale: int = 1024, lengths: int = 16, seed: int = 5
) -> DataFrame:
    """``vec_id, dim, vector`` (integers) and ``away``, the distances to the pivots; the reusable index of all vectors."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    usable = vectors.filter(finite("embedding") & F.col("vec_id").isNotNull())
    rows = staged(usable.select("vec_id", F.size("embedding").alias("dim"), whole.alias("vector")).distinct(), "vectors")
    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(lengths).collect()
    chosen = {}
    for d in dims:
        share = min(1.0, sample_rows / d["count"])
        drawn = rows.filter((F.col("dim") == d["dim"]) & (F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) < share * (1 << 30)))
        sample = sorted((r["vec_id"], r["vector"]) for r in drawn.select("vec_id", "vector").collect())
        if sample:
            chosen[d["dim"]] = choose_pivots(np.array([v for _, v in sample], dtype=np.float64), pivots)
    shared = vectors.sparkSession.sparkContext.broadcast(chosen)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away: list = [[]] * batch.num_rows
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                points = shared.value.get(int(dim))
                if points is not None:
                    at = np.flatnonzero(dims == dim)
                    x = matrix(batch["vector"].take(pa.array(at)))
                    distance = np.stack([np.linalg.norm(x - p, axis=1) for p in points], axis=1)
                    for i, row in zip(at, distance):
                        away[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away, pa.list_(pa.float64()))], names=[*batch.schema.names, "away"])

    return staged(rows.mapInArrow(measure, schema_with(rows, away="array<double>")), "pivots")


def _blocks(away: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of candidates by their nearest pivot and its distance, and where blocks of it start."""
    n = len(away)
    order = np.arange(n)
    if away.shape[1]:
        near = away.argmin(axis=1)
        order = np.lexsort((away[order, near], near))
    return order, np.arange(0, n, rows)


def _bounds(q_norm: np.ndarray, c_norm: np.ndarray, q_away: np.ndarray, c_away: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Query x block: no candidate of the block has a larger inner product with the query."""
    longest = np.maximum.reduceat(c_norm, starts)
    squares = q_norm[:, None] ** 2 + longest[None, :] ** 2
    bound = np.outer(q_norm, longest)
    if q_away.shape[1]:
        lower = np.zeros_like(bound)
        for p in range(q_away.shape[1]):
            least, most = np.minimum.reduceat(c_away[:, p], starts), np.maximum.reduceat(c_away[:, p], starts)
            np.maximum(lower, least[None, :] - q_away[:, p, None], out=lower)
            np.maximum(lower, q_away[:, p, None] - most[None, :], out=lower)
        np.minimum(bound, (squares - lower**2) / 2, out=bound)
    # Room for the rounding of distances: an upper bound must never fall below a true score.
    return bound + 1 + 1e-9 * squares


def best_of_pack(
    query: tuple, candidates: tuple, k: int, floors: np.ndarray, block_rows: int = 128
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the query, ids and scores of its best k candidates in a pack, in bound order until no other can count.

    ``floors`` holds a score per query that k candidates are known to reach; it is raised in place. A block of candidates
    near one pivot shares a bound. Every query starts with the block of its highest bound; the others
    follow in the order of their bounds, each for the queries it can still count for.
    """
    qid, q, q_away = query
    order, starts = _blocks(candidates[2], block_rows)
    cid, c, c_away = (part[order] for part in candidates)
    q_norm, c_norm = (np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) for x in (q, c))
    bound = _bounds(q_norm, c_norm, q_away, c_away, starts)
    exact = np.float64 if float(q_norm.max(initial=0)) * float(c_norm.max(initial=0)) < EXACT else np.int64
    q, c = q.astype(exact), c.astype(exact)
    entry = floors.copy()
    rows, ids, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def meet(block: int, asked: np.ndarray) -> None:
        nonlocal rows, ids, scores
        here = slice(starts[block], starts[block] + block_rows)
        found = q[asked] @ c[here].T
        at, which = np.nonzero(found >= floors[asked, None])
        other = qid[asked[at]] != cid[here][which]
        at, which = at[other], which[other]
        if not len(at):
            return
        touched = np.zeros(len(qid), bool)
        touched[asked[at]] = True
        again = touched[rows]
        r = np.concatenate([rows[again], asked[at]])
        i = np.concatenate([ids[again], cid[here][which]])
        s = np.concatenate([scores[again], found[at, which].astype(np.int64)])
        ranked = np.lexsort((i, -s, r))
        r, i, s = r[ranked], i[ranked], s[ranked]
        first = np.searchsorted(r, r)
        rank = np.arange(len(r)) - first
        last = rank == k - 1
        floors[r[last]] = np.maximum(floors[r[last]], s[last])
        kept = rank < k
        rows = np.concatenate([rows[~again], r[kept]])
        ids = np.concatenate([ids[~again], i[kept]])
        scores = np.concatenate([scores[~again], s[kept]])

    highest = bound.argmax(axis=1)
    for block in np.unique(highest):
        asked = np.flatnonzero((highest == block) & (bound[:, block] >= floors))
        if len(asked):
            meet(block, asked)
    bound[np.arange(len(qid)), highest] = -np.inf
    for block in np.argsort(-bound.max(axis=0), kind="stable"):
        asked = np.flatnonzero((bound[:, block] >= floors) & (bound[:, block] > -np.inf))
        if len(asked):
            meet(block, asked)
    keep = scores >= entry[rows]
    return rows[keep], ids[keep], scores[keep]


def _unpack(rows: pa.Table, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = rows.combine_chunks()
    column = lambda name: rows[f"{prefix}{name}"].chunk(0)
    return column("vec_id").to_numpy(), matrix(column("vector"), np.int64), matrix(column("away"))


def _search(asked: pa.Table, offered: pa.Table, k: int, query_rows: int, pack_rows: int) -> pa.Table:
    """The best k of a lane's candidates for each of its queries, one pack against one pack."""
    parts = []
    for at in range(0, asked.num_rows if offered.num_rows else 0, query_rows):
        query = _unpack(asked.slice(at, query_rows), "q_")
        floors = np.full(len(query[0]), -np.inf)
        for start in range(0, offered.num_rows, pack_rows):
            rows, ids, scores = best_of_pack(query, _unpack(offered.slice(start, pack_rows)), k, floors)
            parts.append((query[0][rows], ids, scores))
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * 3
    return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns))))


def _lanes(index: DataFrame, queries: Column, pack_rows: int) -> DataFrame:
    """Per length: into how many lanes the candidates and the queries are dealt, ``lanes`` and ``sides``.

    A lane meets its candidates with the queries of a side, so rows are copied once per lane or side of the other kind: the lanes
    that copy least, no more than cores can use or lanes of ``LANE_PACKS`` packs need.
    """
    wanted = 4.0 * index.sparkSession.sparkContext.defaultParallelism
    counts = index.groupBy("dim").agg(F.count("*").alias("_c"), F.count_if(queries).alias("_q")).filter("_q > 0")
    least = F.ceil(F.col("_c") / (pack_rows * LANE_PACKS))
    lanes = F.greatest(least, F.least(F.ceil(F.sqrt(F.lit(wanted) * F.col("_c") / F.col("_q"))), F.lit(wanted), F.ceil(F.col("_c") / 64)))
    lanes = lanes.cast("int")
    sides = F.least(F.ceil(F.lit(wanted) / lanes), F.ceil(F.col("_q") / 64)).cast("int")
    return counts.select("dim", lanes.alias("lanes"), sides.alias("sides"))


def top_k(index: DataFrame, queries: Column, k: int = 10, query_rows: int = 512, pack_rows: int = 4_096) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows of the index for which ``queries`` holds, against all rows."""
    # Far more tasks than cores, so lanes that share one do not weigh; most tasks are empty where lanes are few.
    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16 * index.sparkSession.sparkContext.defaultParallelism)
    lanes = staged(_lanes(index, queries, pack_rows), "lanes")
    place = lambda name: F.pmod(F.xxhash64("vec_id"), F.col(name)).cast("int").alias(name[:-1])
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1)).alias(name[:-1])
    rows, keys = ["vec_id", "vector", "away"], ["dim", "lane", "side"]
    offered = index.join(lanes, "dim").select("dim", place("lanes"), every("sides"), *rows)
    asked = index.filter(queries).join(lanes, "dim").select("dim", place("sides"), every("lanes"), *rows)
    # Other names on the two sides of the same table; the work of a lane does not show in its bytes, so its tasks are not left to them.
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in (*keys, *rows)]).repartition(tasks, *[f"q_{c}" for c in keys])
    met = asked.groupBy(*[f"q_{c}" for c in keys]).cogroup(offered.repartition(tasks, *keys).groupBy(*keys))
    found = met.applyInArrow(lambda a, b: _search(a, b, k, query_rows, pack_rows), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
