"""Skew-safe building blocks against plain computations."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumeframe.operators import metrics
from plumeframe.scale import average_ranks, exact_quantiles, positions, prefix_sums, ranked_rows, skew_join, top_rows, value_ranges


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one key and one value."""
    return spark.range(900).selectExpr(
        "id", "case when id%3=0 then 'hot' else concat('k', id%7) end as k", "case when id%3=0 then 1.5d else (id*37%101)/10.0d - 3 end as v"
    )


def test_quantiles_equal_numpy(skewed):
    wanted = {"a": ("v", 0.0), "b": ("v", 0.5), "c": ("v", 0.9), "d": ("v", 1.0)}
    got = {r["k"]: r for r in exact_quantiles(skewed, ["k"], wanted).collect()}
    rows = skewed.toPandas()
    for key, part in rows.groupby("k"):
        assert np.allclose([got[key][c] for c in "abcd"], np.quantile(part["v"], [0, 0.5, 0.9, 1.0]))
    whole = exact_quantiles(skewed, [], wanted).first()
    assert np.allclose([whole[c] for c in "abcd"], np.quantile(rows["v"], [0, 0.5, 0.9, 1.0]))


def test_ranks_share_ties(skewed):
    got = {(r["k"], r["v"]): r["avg_rank"] for r in average_ranks(skewed, ["k"], "v").collect()}
    rows = skewed.toPandas()
    rows["r"] = rows.groupby("k")["v"].rank()
    for row in rows.itertuples():
        assert got[(row.k, row.v)] == row.r


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_join(spark, skewed, how):
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("k2", 4)], "k string, w int")
    salted = skew_join(skewed, small, ["k"], ["id"], how, rows_per_task=20)
    plain = skewed.join(small, "k", how)
    key = ["id", "k", "v", "w"]
    assert sorted(map(str, salted.select(*key).collect())) == sorted(map(str, plain.select(*key).collect()))


def test_skew_join_spreads_the_hot_key(spark, skewed):
    small = spark.createDataFrame([("hot", 1)], "k string, w int")
    plan = skew_join(skewed, small, ["k"], ["id"], rows_per_task=20)._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_positions_number_every_row_once(skewed):
    rows = positions(skewed, ["k"], "v", "id", split=4).orderBy("k", "pos").collect()
    for key in {r["k"] for r in rows}:
        part = [r for r in rows if r["k"] == key]
        assert [r["pos"] for r in part] == list(range(len(part)))
        assert [r["v"] for r in part] == sorted(r["v"] for r in part)
        assert {r["n"] for r in part} == {len(part)}


def test_prefix_sums_over_blocks(spark):
    rows = spark.range(250).selectExpr("id as pos", "cast(id%13 as double) as x")
    got = {r["pos"]: r["_sum_x"] for r in prefix_sums(rows, "pos", ["x"], block=32).collect()}
    want = np.cumsum([i % 13 for i in range(250)])
    assert [got[i] for i in range(250)] == list(want)


def test_top_rows_trims_before_the_shuffle(skewed):
    out = top_rows(skewed, ["k"], [F.col("v"), F.col("id")], 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert out.filter("k = 'hot'").count() == 2


VALUES = {
    "small": "id * 5e-13",
    "narrow": "1.7e9 + id * 1e-4",
    "times": "1.7e9 + pmod(xxhash64(id), 31536000)",
    "wide": "pow(10.0, (id % 6000) / 10.0 - 300) * (1 + id)",
    "outlier": "if(id = 7, 1e300, if(id = 9, -1e300, id / 7.0))",
    "bursts": "floor(id / 1000) * 86400 + (id % 1000) * 1e-6",
}


@pytest.mark.parametrize("values", VALUES)
def test_ranges_are_balanced_whatever_the_values(spark, values):
    n = 100_000
    counts = spark.range(n).selectExpr("id % 2 as g", f"cast({VALUES[values]} as double) as v").distinct()
    for groups, size in ((["g"], counts.count() / 2), ([], counts.count())):
        placed = value_ranges(counts.select("v").distinct() if not groups else counts, groups, "v")
        spans = placed.groupBy(*groups, "_step").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        rows = sorted((tuple(r[c] for c in groups), r["_step"], r["low"], r["high"], r["n"]) for r in spans.collect())
        assert max(r[4] for r in rows) <= 2 * size / 256
        assert all(a[3] < b[2] for a, b in zip(rows, rows[1:]) if a[0] == b[0])


def test_ranks_over_many_ranges_equal_plain_ranks(spark):
    rows = spark.range(20_000).selectExpr("id", "cast(id % 3 as string) as g", "1.7e9 + pmod(xxhash64(id), 9000) * 1e-3 as v")
    got = {(r["g"], r["v"]): r["avg_rank"] for r in average_ranks(rows, ["g"], "v").collect()}
    plain = rows.toPandas()
    plain["r"] = plain.groupby("g")["v"].rank()
    assert all(got[r.g, r.v] == r.r for r in plain.itertuples())


@pytest.mark.parametrize("groups", [["g"], []])
def test_ranked_rows_equal_plain_ranks(spark, groups):
    """Narrow values, a value that a third of the rows share, a NULL group, weights."""
    rows = spark.range(12_000).selectExpr(
        "id", "if(id % 4 = 0, null, cast(id % 4 as string)) as g", "if(id % 3 = 0, 5.0, 1.7e9 + pmod(xxhash64(id), 4000) * 1e-3) as y", "pmod(xxhash64(id, 1), 50) / 7 as p",
        "id % 5 + 1 as w",
    )
    found = ranked_rows(rows, groups, {"y": "ry", "p": "rp"}, "w").toPandas()
    assert len(found) == 12_000 and found["id"].is_unique
    plain = found.loc[found.index.repeat(found["w"])].fillna({"g": ""})
    by = plain.groupby("g") if groups else plain.groupby(plain["w"] > 0)
    for value, rank in (("y", "ry"), ("p", "rp")):
        assert (by[value].rank() == plain[rank]).all()
    assert (by["y"].transform("size") == plain["n"]).all()


def test_rank_correlation_of_a_null_group(spark):
    rows = [(None, float(i), float(i * i)) for i in range(6)] + [("a", float(i), float(-i)) for i in range(6)]
    found = metrics.rank_correlation(spark.createDataFrame(rows, "g string, y double, p double"), ["g"], "y", "p").collect()
    assert {r["g"]: round(r["spearman_r"], 9) for r in found} == {None: 1.0, "a": -1.0}
