"""Building blocks that keep operators whole and balanced on skewed data.

* ``skew_join``   equi join whose hot keys are split over many tasks.
* ``top_rows``    first k rows per key; Spark trims each partition to k rows per key before it
                  shuffles (WindowGroupLimit), so a hot key never moves as a whole.
* ``value_steps`` running counts over the ordered distinct values of a group without ever putting
                  the group into one task; ranks and exact quantiles are read off it. Its ranges are cut at
                  quantiles of the group's own values, so they are balanced however the values lie.
* ``stage``       reliable checkpoint in the shared folder of the cluster.
* ``stored``      the same as a table, whose size Spark knows when it plans its readers.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_TASK = 2_000_000
#: Ranges of a group are RANGE_STEPS squared; their bounds come from one in SAMPLED of its distinct values.
RANGE_STEPS = 16
SAMPLED = 8


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; only a local master may fall back to its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumeframe-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a shared folder")


def stage(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint that survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: readers know the size, so Spark's own check can broadcast it."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def skew_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join on ``keys``; a key with more than ``rows_per_task`` rows in ``big`` is salted.

    The row of ``big`` picks its salt from a hash of ``spread_by``; the rows of ``small`` that carry
    a hot key are repeated once per salt. Keys below the bound keep one salt, so nothing is
    repeated for them. ``how`` may be inner or left (seen from ``big``).
    """
    keys = list(keys)
    hot = (
        big.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > rows_per_task)
        .select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts"))
    )
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = (
        big.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts.cast("bigint")).cast("int"))
        .drop("_salts")
    )
    right = (
        small.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key in the given order (make the order total)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= k)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def _range_of(value: Column, bounds: Column) -> Column:
    """Number of the range of a value: how many of the sorted bounds do not exceed it, found in two looks."""
    n = RANGE_STEPS
    upto = lambda part: F.size(F.filter(part, lambda b: b <= value))
    heads = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.element_at(bounds, i * n))
    coarse = upto(heads)
    return F.when(bounds.isNull(), 0).otherwise(coarse * n + upto(F.slice(bounds, coarse * n + 1, n)))


def value_ranges(counts: DataFrame, groups: Sequence[str], value: str, counted: str | None = None) -> DataFrame:
    """Adds ``_step``: ranges of the values of a group that hold about equally many of its distinct values.

    ``counts`` has one row per (group, value). The bounds of a group are quantiles of a hash sample of its values, from
    mergeable sketches; a group of few values stays in one range. Equal values share a range, and ranges follow the
    order of the values, whatever the bounds are: they only set the balance. ``counted`` names a column that was aggregated
    for the value: with it in its hash the sample is taken behind the aggregate, whose exchange then serves both uses.
    """
    number = F.col(value).cast("double")
    # Never a constant key: the optimizer would turn the join into a product.
    place = F.struct(*groups) if groups else F.pmod(F.xxhash64(value), F.lit(1))
    keyed = counts.withColumn("_group", place)
    n = RANGE_STEPS * RANGE_STEPS
    shares = [i / n for i in range(1, n)]
    sample = keyed.filter(F.pmod(F.xxhash64(value, F.lit(7), *([counted] if counted else [])), F.lit(SAMPLED)) == 0)
    bounds = (
        sample.groupBy("_group")
        .agg(F.percentile_approx(number, shares).alias("_bounds"), F.count("*").alias("_n"))
        .filter(F.col("_n") >= n)
        .drop("_n")
    )
    return keyed.join(bounds, "_group", "left").withColumn("_step", _range_of(number, F.col("_bounds"))).drop("_group", "_bounds")


def value_steps(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    weight: Column | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per (group, distinct value): ``cnt`` rows hold it, ``before`` rows lie below it.

    ``n`` is the group size. ``extra`` adds more sums per distinct value. Rows are pre-aggregated to
    distinct values; these are spread by (group, range) and the running total over ranges is a
    window over the few ranges of a group, never over its rows.
    """
    groups = list(groups)
    weight = F.lit(1) if weight is None else weight
    sums = [F.sum(weight).cast("bigint").alias("cnt")]
    sums += [F.sum(column).alias(name) for name, column in (extra or {}).items()]
    # One struct as key: NULL group values stay comparable, and join and window share one shuffle.
    place = F.struct(*groups, "_step").alias("_place")
    counts = value_ranges(df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(*sums), groups, value, "cnt")
    by_group = Window.partitionBy(*(groups or [F.lit(0)]))
    offsets = (
        counts.groupBy(*groups, "_step")
        .agg(F.sum("cnt").alias("_total"))
        .withColumn("n", F.sum("_total").over(by_group))
        .withColumn("_offset", F.sum("_total").over(by_group.orderBy("_step")) - F.col("_total"))
        .select(place, "n", "_offset")
    )
    inside = Window.partitionBy("_place").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        counts.withColumn("_place", place)
        .join(offsets, "_place")
        .withColumn("before", F.col("_offset") + F.sum("cnt").over(inside) - F.col("cnt"))
        .drop("_offset", "_step", "_place")
    )


def ranked_rows(rows: DataFrame, groups: Sequence[str], ranks: dict[str, str], weight: str, salts: int = 64) -> DataFrame:
    """``rows`` with the average rank of several of their values in the group, and the group's weight ``n``.

    ``ranks`` maps a value column to its rank column; a row counts ``weight`` times. The rows keep their place in the
    pipeline: per value they move once, to the range that their value lies in, and are ranked there by a window. Ranges
    follow quantiles of the rows, sketched for all values in one pass. A value so frequent that quantiles repeat it is a
    range of its own: its rank follows from counts, so its rows are spread by a hash. ``rows`` are read several times;
    stage what is dear to compute.
    """
    groups, n = list(groups), RANGE_STEPS * RANGE_STEPS
    place = F.struct(*groups) if groups else F.pmod(F.xxhash64(*ranks), F.lit(1))
    keyed = rows.withColumn("_group", place)
    shares = [i / n for i in range(1, n)]
    sample = keyed.filter(F.pmod(F.xxhash64(*ranks, weight), F.lit(SAMPLED)) == 0)
    sketches = [F.percentile_approx(F.col(c).cast("double"), shares).alias(f"_bounds_{i}") for i, c in enumerate(ranks)]
    bounds = sample.groupBy("_group").agg(*sketches, F.count("*").alias("_n")).filter(F.col("_n") >= n).drop("_n")
    out = keyed.join(bounds, "_group", "left")
    for i, c in enumerate(ranks):
        cuts, value = F.col(f"_bounds_{i}"), F.col(c).cast("double")
        step = F.col(f"_step_{i}")
        out = out.withColumn(f"_step_{i}", _range_of(value, cuts))
        repeated = (step >= 2) & (F.try_element_at(cuts, step) == value) & (F.try_element_at(cuts, step - 1) == value)
        out = out.withColumn(f"_own_{i}", F.coalesce(repeated, F.lit(False)))
    out = out.drop(*[f"_bounds_{i}" for i in range(len(ranks))])
    by_group, located = Window.partitionBy("_group"), out
    for i, (c, name) in enumerate(ranks.items()):
        at = ["_group", f"_step_{i}", f"_own_{i}"]
        ahead = by_group.orderBy(f"_step_{i}", F.desc(f"_own_{i}")).rowsBetween(Window.unboundedPreceding, -1)
        totals = located.groupBy(*at).agg(F.sum(weight).alias("_total"))
        totals = totals.withColumn("_ahead", F.coalesce(F.sum("_total").over(ahead), F.lit(0)))
        if i == 0:
            totals = totals.withColumn("n", F.sum("_total").over(by_group))
        salt = F.when(F.col(f"_own_{i}"), F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).otherwise(0)
        placed = out.join(totals, at).withColumn("_salt", salt.cast("int"))
        here = Window.partitionBy(*at, "_salt")
        upto = F.sum(weight).over(here.orderBy(c).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        same = F.sum(weight).over(Window.partitionBy(*at, "_salt", c))
        rank = F.col("_ahead") + F.when(F.col(f"_own_{i}"), (F.col("_total") + 1) / 2).otherwise(upto - same + (same + 1) / 2)
        out = placed.withColumn(name, rank.cast("double")).drop("_total", "_ahead", "_salt", f"_step_{i}", f"_own_{i}")
    return out.drop("_group")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which a NULL key matches a NULL key."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(right, condition, how).drop(*[f"_r_{k}" for k in keys])


def average_ranks(
    df: DataFrame, groups: Sequence[str], value: str, rank: str = "avg_rank", weight: Column | None = None
) -> DataFrame:
    """Rank of every distinct value (ties share the mean rank), one row per (group, value)."""
    steps = value_steps(df, groups, value, weight)
    return steps.select(
        *groups, value, "cnt", "n", (F.col("before") + (F.col("cnt") + 1) / 2).cast("double").alias(rank)
    )


def exact_quantiles(df: DataFrame, groups: Sequence[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact linear-interpolated quantiles per group, for any number of rows per group.

    ``wanted`` maps an output column to (value column, probability).
    """
    groups = list(groups)
    values = sorted({column for column, _ in wanted.values()})
    entries = [F.struct(F.lit(v).alias("_metric"), F.col(v).cast("double").alias("_value")) for v in values]
    long = df.select(*groups, F.inline(F.array(*entries)))
    steps = value_steps(long, [*groups, "_metric"], "_value")
    first, after = F.col("before"), F.col("before") + F.col("cnt")
    aggs: list[Column] = []
    outs: list[Column] = []
    for name, (metric, p) in wanted.items():
        here = F.col("_metric") == metric
        position = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.floor(position), F.ceil(position)
        aggs += [
            F.max(F.when(here & (low >= first) & (low < after), F.col("_value"))).alias(f"_lo_{name}"),
            F.max(F.when(here & (high >= first) & (high < after), F.col("_value"))).alias(f"_hi_{name}"),
            F.max(F.when(here, position - low)).alias(f"_f_{name}"),
        ]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((lo + (hi - lo) * F.col(f"_f_{name}")).alias(name))
    return steps.groupBy(*groups).agg(*aggs).select(*groups, *outs)


def with_quantiles(
    aggregated: DataFrame, rows: DataFrame, groups: Sequence[str], wanted: dict[str, tuple[str, float]]
) -> DataFrame:
    """Add exact quantile columns to an aggregate over the same groups."""
    quantiles = exact_quantiles(rows, groups, wanted)
    if groups:
        return null_safe_join(aggregated, quantiles, list(groups), "left")
    return beside(aggregated, quantiles)


def beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Columns of a one-row table next to those of another: stacked, then the value of each column."""
    both = one.unionByName(other, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def positions(
    df: DataFrame, groups: Sequence[str], order: str, identity: str, name: str = "pos", split: int = 64
) -> DataFrame:
    """0-based position of every row in its group, in the order (value, hash part of the id, id), and
    the group size ``n``.

    Rows of one value are split by a hash of their id, so neither a long group nor a value shared by
    very many rows ends up in one task.
    """
    groups = list(groups)
    part = F.pmod(F.xxhash64(identity), F.lit(split)).cast("int")
    placed = df.filter(F.col(order).isNotNull()).withColumn("_part", part)
    at = [*groups, order]
    steps = value_steps(placed, groups, order).select(*at, "before", "n")
    parts = placed.groupBy(*at, "_part").agg(F.count("*").alias("_c"))
    ahead = Window.partitionBy(*at).orderBy("_part")
    parts = parts.withColumn("_ahead", F.sum("_c").over(ahead) - F.col("_c")).drop("_c")
    inside = Window.partitionBy(*at, "_part").orderBy(identity)
    numbered = placed.withColumn("_rn", F.row_number().over(inside))
    return (
        numbered.join(parts, [*at, "_part"])
        .join(steps, at)
        .withColumn(name, F.col("before") + F.col("_ahead") + F.col("_rn") - 1)
        .drop("_part", "_rn", "_ahead", "before")
    )


def prefix_sums(df: DataFrame, pos: str, columns: Sequence[str], block: int = 100_000) -> DataFrame:
    """Running totals of ``columns`` up to each position, by blocks of positions: ``pos, _sum_<column>``."""
    blocked = df.select(pos, *columns, F.floor(F.col(pos) / block).alias("_block"))
    totals = blocked.groupBy("_block").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    ahead = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_block", *[F.coalesce(F.sum(f"_t_{c}").over(ahead), F.lit(0.0)).alias(f"_o_{c}") for c in columns])
    inside = Window.partitionBy("_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocked.withColumns({f"_i_{c}": F.sum(c).over(inside) for c in columns})
    return summed.join(totals, "_block").select(
        pos, *[(F.col(f"_i_{c}") + F.col(f"_o_{c}")).alias(f"_sum_{c}") for c in columns]
    )
