"""Embedding whitening with a covariance weighted by multiplicity.

1. Components are made whole numbers, ``floor(scale * c)``, and equal vectors become one class with a count.
2. The classes are the fit list; a class weighs one, or its count (``weights``). Tasks sum the weighted vectors exactly, then
   multiply the weighted centred blocks (GEMM); their partial sums meet entry by entry.
3. The eigenvectors of the d x d covariance give the components. The driver holds, for each length of vector, its sums
   and the matrix: a size that depends on the vectors' length, not on their number.
4. Every class is whitened once and joined back to its rows; classes with very many rows are joined in salted parts.

Cases. Vectors that are NULL, hold NULL or non-finite entries or entries beyond ``2^62`` once scaled, give no rows; so do
empty ones. Vectors of different lengths are fitted apart, each length as a table of its own. Components without variance
(an eigenvalue below 1e-12 of the largest, as with one class only) have a NULL ``whitened`` and take no part in
``identity_error``, which is NULL if none is left. Eigenvectors point to where their largest entry is positive. Equal
eigenvalues leave the choice of axes open. A ``deviation`` beyond a long is NULL. Repeated rows, ids or not, each
get their rows. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeframe.llm.common import staged
from plumeframe.llm.vectors import finite, matrix

ROWS_PER_TASK = 100_000
MOST = 1 << 62


@dataclass(frozen=True)
class Fit:
    """What one length of vectors is whitened with: list weight, exact sums, component vectors, their eigenvalues and shares."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    shares: np.ndarray


def whole_vectors(vectors: DataFrame, scale: float, column: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the vectors that take part."""
    scaled = vectors.select("vec_id", F.col(column).alias("_v")).filter(finite("_v"))
    scaled = scaled.withColumn("_v", F.transform("_v", lambda c: c.cast("double") * F.lit(float(scale))))
    return scaled.filter(F.forall("_v", lambda c: F.abs(c) < float(MOST))).select("vec_id", F.transform("_v", lambda c: F.floor(c)).alias("x"))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = batch["x"].value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        yield int(dim), batch.filter(pa.array(lengths == dim))


def _exact_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for dim, part in _by_length(batch):
            x, w = matrix(part["x"], np.int64), part["w"].to_numpy()
            total = int(w.sum())
            sums = (x * w[:, None]).sum(axis=0) if int(np.abs(x).max()) * total < MOST else (x.astype(object) * w[:, None]).sum(axis=0)
            n, before = found.get(dim, (0, np.zeros(dim, object)))
            found[dim] = n + total, before + sums.astype(object)
    kind = pa.decimal128(38, 0)
    for dim, (n, sums) in found.items():
        ints = [pa.array([v] * dim, t) for v, t in ((dim, pa.int32()), (n, pa.int64()))]
        yield pa.RecordBatch.from_arrays([*ints, pa.array(range(dim), pa.int32()), pa.array([int(s) for s in sums], kind)], names=["dim", "n", "i", "s"])


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    return x.astype(np.float64) - np.array([s / n for s in sums])


def _products(batches: Iterator[pa.RecordBatch], moments: dict[int, tuple[int, tuple[int, ...]]]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, part in _by_length(batch):
            x = _centred(matrix(part["x"], np.int64), *moments[dim])
            found[dim] = found.get(dim, 0.0) + x.T @ (x * part["w"].to_numpy()[:, None])
    for dim, product in found.items():
        i, j = np.indices(product.shape)
        arrays = [pa.array(np.full(dim * dim, dim, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(product.ravel())]
        yield pa.RecordBatch.from_arrays(arrays, names=["dim", "i", "j", "v"])


def principal(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors (rows) by falling eigenvalue, the eigenvalues, and their shares of the trace."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1].T[:components]
    heads = vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]
    trace = float(np.trace(covariance))
    shares = values / trace if trace > 0 else np.zeros(len(values))
    return vectors * np.where(heads < 0, -1.0, 1.0)[:, None], values, shares


def fit(classes: DataFrame, components: int) -> dict[int, Fit]:
    """The fit of each length from ``x`` and weight ``w``."""
    partial = classes.mapInArrow(_exact_sums, "dim int, n long, i int, s decimal(38,0)")
    rows = partial.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    moments = {}
    for dim in {r["dim"] for r in rows}:
        mine = sorted((r for r in rows if r["dim"] == dim), key=lambda r: r["i"])
        moments[dim] = int(mine[0]["n"]), tuple(int(r["s"]) for r in mine)
    partial = classes.mapInArrow(lambda batches: _products(batches, moments), "dim int, i int, j int, v double")
    entries: dict[int, np.ndarray] = {dim: np.zeros((dim, dim)) for dim in moments}
    for r in partial.groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():
        entries[r["dim"]][r["i"], r["j"]] = r["v"]
    fits = {}
    for dim, (n, sums) in moments.items():
        vectors, values, shares = principal(entries[dim] / n, components)
        fits[dim] = Fit(n, sums, vectors, values, shares)
    return fits


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Exact sums of (n * x - S)^2; None where a long cannot hold one."""
    most = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    kind = np.int64 if x.shape[1] * most * most < (1 << 63) else object
    gaps = x.astype(kind) * n - np.array(sums, kind)
    return [d if d < (1 << 63) else None for d in map(int, (gaps * gaps).sum(axis=1))]


def _whiten(batches: Iterator[pa.RecordBatch], fits: dict[int, Fit]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, part in _by_length(batch):
            known = fits[dim]
            x = matrix(part["x"], np.int64)
            projected = _centred(x, known.n, known.sums) @ known.vectors.T
            varied = known.values > 1e-12 * max(float(known.values.max(initial=0.0)), 0.0)
            white = projected / np.sqrt(np.where(varied, known.values, 1.0))
            cells = pa.array(white.ravel(), mask=np.broadcast_to(~varied, white.shape).ravel())
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1])
            arrays = [pa.array(np.full(len(x), dim, np.int32)), part["x"], part["w"], pa.array(deviations(x, known.n, known.sums), pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(offsets, cells)], names=["dim", "x", "w", "deviation", "white"])


def identity_errors(whitened: DataFrame, fits: dict[int, Fit], components: int) -> dict[int, float | None]:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, by length."""
    at = [F.get("white", F.lit(k)) for k in range(components)]
    sums = whitened.groupBy("dim").agg(F.sum("w").alias("n"), *[F.sum(F.col("w") * c).alias(f"s{k}") for k, c in enumerate(at)])
    means = {r["dim"]: [None if r[f"s{k}"] is None else r[f"s{k}"] / r["n"] for k in range(components)] for r in sums.collect()}
    if not means:
        return {}
    entries = []
    for k in range(components):
        for j in range(k + 1):
            mean = F.create_map(*[F.lit(v) for dim, m in means.items() for v in (dim, (m[k] or 0.0))])
            other = F.create_map(*[F.lit(v) for dim, m in means.items() for v in (dim, (m[j] or 0.0))])
            product = (at[k] - F.element_at(mean, F.col("dim"))) * (at[j] - F.element_at(other, F.col("dim")))
            entries.append((F.sum(F.col("w") * product) / F.sum("w")).alias(f"c{k}_{j}"))
    out: dict[int, float | None] = {}
    for r in whitened.groupBy("dim").agg(*entries).collect():
        gaps = [abs(r[f"c{k}_{j}"] - (k == j)) for k in range(components) for j in range(k + 1) if r[f"c{k}_{j}"] is not None]
        out[r["dim"]] = max(gaps, default=None)
    return out


def _joined(rows: DataFrame, classes: DataFrame, hot: DataFrame) -> DataFrame:
    """Each row with what its class has; the classes in ``hot`` are repeated once per salt."""
    salts = F.coalesce("salts", F.lit(1))
    left = rows.join(hot, "x", "left").withColumn("salt", F.pmod(F.xxhash64("vec_id"), salts.cast("long")).cast("int"))
    right = classes.join(hot, "x", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.drop("salts").join(right.drop("salts"), ["x", "salt"])


def whiten(
    vectors: DataFrame, scale: float = 256.0, components: int = 4, weights: str = "one", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each vector and component.

    ``weights`` is "one" (each distinct vector counts once in the fit) or "count" (as often as it occurs).
    """
    if weights not in ("one", "count"):
        raise ValueError(f"weights must be 'one' or 'count', not {weights!r}")
    rows = whole_vectors(vectors, scale)
    counted = staged(rows.groupBy("x").agg(F.count("*").alias("rows")), "classes")
    classes = counted.select("x", (F.lit(1).cast("long") if weights == "one" else F.col("rows")).alias("w"))
    fits = fit(classes, components)
    whitened = staged(
        classes.mapInArrow(lambda batches: _whiten(batches, fits), "dim int, x array<long>, w long, deviation long, white array<double>"), "whitened"
    )
    errors = identity_errors(whitened, fits, components)
    hot = staged(counted.filter(F.col("rows") > rows_per_task).select("x", F.ceil(F.col("rows") / rows_per_task).cast("int").alias("salts")), "hot")
    known = [F.struct(F.lit(f.n).cast("long").alias("n"), F.array(*map(F.lit, map(float, f.shares))).alias("shares"), F.lit(errors.get(d)).cast("double").alias("error")) for d, f in fits.items()]
    of = F.element_at(F.create_map(*[v for d, s in zip(fits, known, strict=True) for v in (F.lit(d), s)]), F.col("dim")) if fits else None
    joined = _joined(rows, whitened.select("dim", "x", "deviation", "white"), hot)
    if of is None:
        blank = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<double>").alias("shares"), F.lit(None).cast("double").alias("error"))
        of = blank
    spread = joined.select("vec_id", "deviation", of.alias("of"), F.posexplode("white").alias("at", "whitened"))
    return spread.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.col("of.n").alias("n"),
        "deviation",
        "whitened",
        F.get("of.shares", F.col("at")).alias("explained"),
        F.col("of.error").alias("identity_error"),
    )
