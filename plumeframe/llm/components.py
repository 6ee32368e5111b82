"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is two joins on one end of the links. A node with very many links only ever meets one
minimum, so no neighbourhood is gathered; the driver sees two numbers per round. Rounds grow with
the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeframe.llm.common import staged


def _oriented(links: DataFrame) -> DataFrame:
    return (
        links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .filter(F.col("hi") > F.col("lo"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("lo").alias("at"), F.col("hi").alias("other")).unionByName(
        edges.select(F.col("hi").alias("at"), F.col("lo").alias("other"))
    )
    least = both.groupBy("at").agg(F.min("other").alias("m")).select(F.col("at").alias("lo"), F.least("at", "m").alias("m"))
    return edges.join(least, "lo").select("hi", F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    joined = edges.join(least, "hi")
    down = joined.filter(F.col("lo") > F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return down.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node that is an end of a link ``(a, b)``; root is the smallest node.

    Links of a node with itself or with NULL say nothing and are ignored; an empty table gives an empty table.
    """
    edges = staged(_oriented(links), "links")
    mark = _mark(edges)
    while mark[0]:
        edges = staged(_small_star(_large_star(edges)), "links")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
