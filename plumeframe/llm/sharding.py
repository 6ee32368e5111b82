"""Sharding by a two-pass external shuffle.

Pass one scatters the records by a seeded hash of id and text into buckets that fit in memory; pass
two shuffles each bucket by Fisher-Yates and numbers it from the bucket's offset on. The buckets
in their order make one random order of all records, which is cut into runs: the shards. So each
bucket touches one or two shards and is written without a second exchange. Law ``rows``: the sizes
of any two shards differ by one record at most.

Cases. NULL and empty texts count 16 bytes of size and are dealt like any others; NULL ids are
spread by their text. Rows that repeat id and text are interchangeable. Copies of a text under
different ids fall into different buckets. An empty table gives no rows. An input column named like
an output is replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumeframe.llm.common import schema_with, without

OVERHEAD = 16
BUCKET_BYTES = 32 << 20
SUPER = 4096
_INNER = ("_key", "_bucket", "_offset")


def record_size(text: str = "text"):
    """UTF-8 bytes of the text (NULL: none) plus a fixed overhead."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def _offsets(counts: DataFrame) -> DataFrame:
    """Records before each bucket. Two levels, so that no task orders more than a few thousand rows."""
    counts = counts.withColumn("_super", F.floor(F.col("_bucket") / SUPER))
    inner = Window.partitionBy("_super").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    supers = counts.groupBy("_super").agg(F.sum("count").alias("_t")).select("_super", F.coalesce(F.sum("_t").over(outer), zero).alias("_ahead"))
    return (
        counts.withColumn("_in", F.coalesce(F.sum("count").over(inner), zero))
        .join(supers, "_super")
        .select("_bucket", (F.col("_in") + F.col("_ahead")).alias("_offset"))
    )


def shuffled_shards(docs: DataFrame, shards: int = 40, seed: int = 20_240_601, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every record of ``docs`` (``doc_id``, ``text`` and others) with its ``size``, ``shard`` and gapless ``slot``."""
    columns = without(docs, ("size", "shard", "slot", *_INNER))
    schema = schema_with(columns, size="long", shard="int", slot="long")
    sized = columns.withColumn("size", record_size())
    rows, volume = sized.agg(F.count("*"), F.sum("size")).first()
    buckets = max(1, math.ceil((volume or 0) / bucket_bytes))
    keyed = sized.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "text")).withColumn("_bucket", F.pmod("_key", F.lit(buckets)))
    offsets = _offsets(keyed.groupBy("_bucket").count())

    def fisher_yates(table: pa.Table) -> pa.Table:
        # A fixed start order makes the outcome independent of how the rows arrived.
        start = pc.sort_indices(table, sort_keys=[("_key", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        bucket, offset = table["_bucket"][0].as_py(), table["_offset"][0].as_py()
        order = start.to_numpy()[np.random.default_rng([seed, bucket]).permutation(table.num_rows)]
        position = offset + np.arange(table.num_rows, dtype=np.int64)
        shard = position * shards // rows
        slot = position + (-shard * rows // shards)
        table = table.take(pa.array(order)).drop_columns(list(_INNER))
        return table.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot))

    return keyed.join(offsets, "_bucket").groupBy("_bucket").applyInArrow(fisher_yates, schema)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the shards as folders ``shard=N``; the records of a bucket stay in slot order in one file."""
    sharded.write.partitionBy("shard").parquet(path)
