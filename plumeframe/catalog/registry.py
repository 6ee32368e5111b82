"""Registered queries: a Spark builder, the same result in SQL, and the inventory ids it covers."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "detections", "scalars", "observations", "stability", "overpass", "granules", "linkage", "grids", "models", "sets",
    "incremental", "reports",
)


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    covers: tuple[str, ...]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    def register(build):
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(name, build, tuple(covers.split()), sql)
        return build

    return register


def load() -> dict[str, Entry]:
    for module in MODULES:
        importlib.import_module(f"plumeframe.catalog.{module}")
    return ENTRIES
