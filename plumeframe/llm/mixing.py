"""Mixing sources to target weights with a splitting tree of exact block quotas.

Each source's documents lie in a random order (a seeded hash of the id), cut into blocks of about
``block_words`` words. Its target says how many whole passes over the source and how many further
words the mix takes; the further words are whole blocks in order and, from the block in which the
target falls, the documents that fit (largest first). The blocks so taken are the source's quota.

A binary tree over the output shards splits the quotas: each node hands its left half an exact
number of blocks, drawn from its quotas by a multivariate hypergeometric law, and the rest to the
right half. A leaf's quotas are runs of each source's random block order, so shards draw disjoint
blocks; inside a shard the documents are ordered by a hash.

Only numbers of bounded size reach the driver: a few sums per reshare round, and the quotas of at
most ``GROUPS`` groups of sources (a group is one source as long as there are no more than that).
Sources are met by a null-safe join with one row per source; a source of any size is never gathered.

Cases. A NULL source is a source of its own, last in order. NULL or empty texts have size 0 and are
taken 0 words. A source without words has target 0. An empty table gives no rows. Rows with a NULL
id are ordered by hash like others. Input columns named like outputs are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeframe.llm.common import staged, without

WORD = r"[^\x20\x09-\x0D]+"
GROUPS = 4096
MAX_BLOCKS = 1 << 16
BLOCK_WORDS = 100_000
OUTPUTS = ("size", "source_size", "target", "taken")
_INNER = ("_position", "_epochs", "_blocks", "_cut", "_left", "_base", "_starts", "_hash", "_block", "_source", "_extra")


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """``_position`` of each source in code-point order, NULL last; ranges of sources are counted, not gathered."""
    ranged = staged(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "sources"
    )
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())
    return (
        ranged.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(starts, "_range")
        .select("source", "source_size", (F.col("_rank") + F.col("_start")).cast("long").alias("_position"))
    )


def source_targets(sized: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """One row per source: its size, weight and target in words.

    The sources share ``share`` times all words by weight; a target stops at ``ceiling`` times the
    source and the excess is shared again by weight until none is above.
    """
    sources = _ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_position") % len(weights) + 1).cast("int"))
    table = staged(sources.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(ceiling)), "weights")
    words, every = table.agg(F.sum("source_size"), F.sum("_weight")).first()
    level, full = (share * words / every if every else 0.0), -1
    while every:
        capped = F.col("_cap") <= F.lit(level) * F.col("_weight")
        n, used, free = table.agg(
            F.count(F.when(capped, 1)), F.sum(F.when(capped, F.col("_cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("_weight")))
        ).first()
        if n == full or not free:
            break
        level, full = max(level, (share * words - used) / free), n
    return table.withColumn("target", F.least("_cap", F.lit(level) * F.col("_weight"))).drop("_cap", "_weight")


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas of each shard (one row per shard): exact in both sums, multivariate hypergeometric at each node of the tree."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def descend(first: int, last: int, have: np.ndarray) -> None:
        if last - first == 1:
            out[first] = have
            return
        middle = (first + last) // 2
        rng = np.random.default_rng([seed, first, last])
        want, rest = int(have.sum()) * (middle - first) // (last - first), int(have.sum())
        left = np.zeros_like(have)
        for i, n in enumerate(have.tolist()):
            rest -= n
            left[i] = rng.hypergeometric(n, rest, want) if n and want else 0
            want -= int(left[i])
        descend(first, middle, left)
        descend(middle, last, have - left)

    descend(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


def _order(seed: int) -> Column:
    """31 random bits of a document; its size parts documents without an id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "size"), 33)


def _block(order: Column, blocks: Column) -> Column:
    return F.shiftright(order * blocks, 31)


def mixture_plan(sized: DataFrame, shards: int, seed: int, block_words: int, weights: tuple, share: float, ceiling: float) -> DataFrame:
    """One row per source of ``sized`` (doc_id, source, size): target, passes, blocks, cut, and where each shard's run of blocks starts."""
    targets = source_targets(sized, weights, share, ceiling)
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    block_words = max(block_words, total // 200_000_000)
    size = F.col("source_size")
    targets = targets.withColumn("_epochs", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int"))
    targets = targets.withColumn("_rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("_epochs") * size)).cast("long"))
    targets = staged(targets.withColumn("_blocks", F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(size / block_words))).cast("long")), "targets")
    blocks = (
        sized.join(targets.select(F.col("source").alias("_source"), "_position", "_blocks", "_rest"), F.col("source").eqNullSafe(F.col("_source")))
        .groupBy("_position", "_rest", _block(_order(seed), F.col("_blocks")).alias("_block"))
        .agg(F.sum("size").alias("_words"))
    )
    upto = F.sum("_words").over(Window.partitionBy("_position").orderBy("_block"))
    # The first block that does not fit whole; past the last block when all fit.
    cut = (
        blocks.withColumn("_upto", upto)
        .groupBy("_position", "_rest")
        .agg(F.min(F.when(F.col("_upto") > F.col("_rest"), F.struct("_block", (F.col("_rest") - F.col("_upto") + F.col("_words")).alias("left")))).alias("_at"))
        .select("_position", F.col("_at._block").alias("_cut"), F.col("_at.left").alias("_left"))
    )
    planned = targets.join(cut, "_position", "left").withColumn("_cut", F.coalesce("_cut", F.when(F.col("_rest") > 0, F.col("_blocks")).otherwise(0)))
    planned = planned.withColumn("_left", F.coalesce("_left", F.lit(0)).cast("long"))
    quota = F.col("_epochs") * F.col("_blocks") + F.least(F.col("_blocks"), F.col("_cut") + 1)
    planned = planned.withColumn("_quota", quota.cast("long")).withColumn("_group", (F.col("_position") % GROUPS).cast("int"))
    ahead = Window.partitionBy("_group").orderBy("_position").rowsBetween(Window.unboundedPreceding, -1)
    planned = staged(planned.withColumn("_base", F.coalesce(F.sum("_quota").over(ahead), F.lit(0))), "plan")
    groups = planned.groupBy("_group").agg(F.sum("_quota").alias("q")).orderBy("_group").collect()
    runs = np.cumsum(split_quotas(np.array([g["q"] for g in groups]), shards, seed), axis=0)
    starts = [(g["_group"], [0, *runs[:-1, i].tolist()]) for i, g in enumerate(groups)]
    leaves = sized.sparkSession.createDataFrame(starts, "_group int, _starts array<long>")
    return planned.join(leaves, "_group").select(
        F.col("source").alias("_source"), "source_size", "target", "_position", "_epochs", "_blocks", "_cut", "_left", "_base", "_starts"
    )


def planned_documents(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 7,
    block_words: int = BLOCK_WORDS,
    weights: tuple = (3, 1, 2),
    share: float = 1.5,
    ceiling: float = 2.0,
) -> DataFrame:
    """Every document with its ``size``, its source's ``source_size`` and ``target``, and the words ``taken`` from it.

    ``docs`` has doc_id, source and text, or a ready ``size`` in place of the text.
    """
    ready = "size" in docs.columns and "text" not in docs.columns
    columns = without(docs, (*OUTPUTS, *_INNER), keep=("size",) if ready else ())
    sized = columns if ready else columns.withColumn("size", word_count())
    small = staged(sized.select("doc_id", "source", "size"), "sizes")
    plan = mixture_plan(small, shards, seed, block_words, weights, share, ceiling)
    placed = (
        (small if ready and len(columns.columns) == 3 else sized)
        .join(plan, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("_hash", _order(seed))
        .withColumn("_block", _block(F.col("_hash"), F.col("_blocks")))
    )
    at_cut = (F.col("_block") == F.col("_cut")) & (F.col("_left") > 0) & (F.col("size") > 0)
    whole = placed.filter(~at_cut).withColumn("_extra", (F.col("_block") < F.col("_cut")).cast("int"))

    def fit(table: pa.Table) -> pa.Table:
        """Whole documents of the cut block, largest first, as long as they fit."""
        size, left = table["size"].to_numpy(), table["_left"][0].as_py()
        order = np.lexsort((table["doc_id"].to_pandas().fillna(-1).to_numpy(), table["_hash"].to_numpy(), -size))
        extra = np.zeros(len(size), dtype=np.int32)
        for i in order:
            if size[i] <= left:
                extra[i], left = 1, left - size[i]
        return table.append_column("_extra", pa.array(extra))

    cut = placed.filter(at_cut).groupBy("_position").applyInArrow(fit, whole.schema)
    return whole.unionByName(cut).withColumn("taken", F.col("size") * (F.col("_epochs") + F.col("_extra")))


def _shard(copy: Column) -> Column:
    """The shard whose run of the source's block quotas, as the tree dealt them, holds the block of a copy."""
    number = F.col("_base") + copy * F.col("_blocks") + F.col("_block")
    return F.size(F.filter("_starts", lambda start: start <= number)) - 1


def with_shards(planned: DataFrame) -> DataFrame:
    """``planned`` with ``mix_shards``: the shard of every copy that the mix takes of a document, none if it takes none."""
    copies = F.when(F.col("taken") > 0, F.col("_epochs") + F.col("_extra")).otherwise(0)
    shards = F.transform(F.sequence(F.lit(0), copies - 1), _shard)
    return planned.withColumn("mix_shards", F.when(copies > 0, shards).otherwise(F.array().cast("array<int>")))


def mixture(planned: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: a row per copy taken, with its ``mix_shard`` and the ``mix_order`` that shuffles the shard."""
    copies = planned.filter(F.col("taken") > 0).withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("_epochs") + F.col("_extra") - 1)))
    return (
        copies.withColumn("mix_shard", _shard(F.col("mix_copy")))
        .withColumn("mix_order", F.xxhash64(F.lit(seed), "mix_shard", "doc_id", "mix_copy"))
        .drop(*_INNER)
    )


def write_mixture(mixed: DataFrame, path: str) -> None:
    """Write the shards as folders, each in its random order."""
    mixed.repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order").write.partitionBy("mix_shard").parquet(path)
