"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType

from plumeframe.scale import ensure_checkpoint_dir


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder that spark.checkpoint.dir names."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder and read from there; survives lost executors."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, taken: Iterable[str], keep: Sequence[str] = ()) -> DataFrame:
    """Drop input columns that carry the name of an output (names compare without case)."""
    reserved = {c.lower() for c in taken} - {c.lower() for c in keep}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in reserved])


def schema_with(df: DataFrame, **added: str) -> StructType:
    """The schema of ``df`` with further columns, given by their type's DDL."""
    return StructType([*df.schema.fields, *[StructField(name, DataType.fromDDL(kind)) for name, kind in added.items()]])
