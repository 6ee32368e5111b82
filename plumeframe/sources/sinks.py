"""Writers: replaced tables, appended logs, report folders, sample tensors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a table; the commit protocol shows the new files only when the job is complete."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_fields(fields: DataFrame, path: str) -> None:
    """Field cells by variable, level and run, and beside them a catalog with one row for each of these.

    The catalog counts the rows of the files just written; only folder names and row counts are read for it, no cell. A
    later write of the same runs replaces them and their catalog rows.
    """
    spark = fields.sparkSession
    stamp = F.date_format("run_time", "yyyy-MM-dd'T'HH")
    (
        fields.withColumn("run", stamp)
        .repartition("variable", "level", "run")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("variable", "level", "run")
        .parquet(f"{path}/cells")
    )
    names = ["variable", "level", "run"]
    schema = StructType([f for f in fields.schema.fields if f.name not in names] + [StructField(n, StringType()) for n in names])
    counted = spark.read.schema(schema).parquet(f"{path}/cells").groupBy(*names).agg(F.count("*").alias("cells"))
    catalog = counted.select("variable", "level", F.to_timestamp("run", "yyyy-MM-dd'T'HH").alias("run_time"), "cells")
    write_table(catalog, f"{path}/catalog")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(tables: dict[str, DataFrame], folder: str, summaries: Sequence[str] = (), order: dict[str, Sequence[str]] | None = None) -> None:
    """Tables as CSV with header, one-row summaries as JSON; tables are ordered only here."""
    for name, df in tables.items():
        keys = (order or {}).get(name)
        if keys:
            df = df.orderBy(*keys)
        if name in summaries:
            df.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


# ---- tensors ---------------------------------------------------------------------------------


def tensor_layout(tensors: DataFrame) -> DataFrame:
    """Channels, leads and patch size of a tensor table, one row per tensor."""
    return tensors.groupBy("kind", "channel", "lead_hours").agg(
        F.min(F.size("patch")).alias("min_size"), F.max(F.size("patch")).alias("max_size")
    )


def check_layout(tensors: DataFrame, written: DataFrame) -> None:
    """Raise when new tensors do not fit those already written. A layout has a row per channel and lead."""
    new = {tuple(r) for r in tensor_layout(tensors).toLocalIterator()}
    old = {tuple(r) for r in tensor_layout(written).toLocalIterator()}
    if old and new and new != old:
        raise ValueError(f"tensor layout differs from what is written: {sorted(new ^ old)}")


def write_tensors(tensors: DataFrame, path: str, append: bool = False) -> None:
    """Dense patches, one row per sample, kind, channel and lead, partitioned by split."""
    if append:
        try:
            check_layout(tensors, tensors.sparkSession.read.parquet(path))
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    tensors.write.mode("append" if append else "overwrite").partitionBy("split").parquet(path)


def pack_cells(cells: DataFrame, keys: Sequence[str], shape: tuple[int, int]) -> DataFrame:
    """Long cells to dense row-major patches, absent cells zero; a group is one patch, h * w cells at most."""
    h, w = shape
    entry = F.struct((F.col("iy") * w + F.col("ix")).alias("k"), F.col("value").cast("float").alias("v"))
    packed = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0).cast("float"))
    )
    return packed.withColumn("patch", dense).drop("_m")


def align_tensors(tensors: DataFrame, index: DataFrame, key: str = "sample_key") -> DataFrame:
    """Tensors of indexed samples; raises when an indexed sample has none."""
    lost = index.select(key).distinct().join(tensors.select(key).distinct(), key, "left_anti")
    if not lost.isEmpty():
        raise ValueError("index rows without tensors; rebuild the sample set")
    return tensors.join(index.select(key).distinct(), key, "left_semi")


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
