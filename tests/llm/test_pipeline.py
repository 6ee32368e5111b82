"""The pipeline's stages against what they promise, and the queries that have SQL against it."""

from __future__ import annotations

import pytest

import corpus_pipeline
from plumeframe.catalog.registry import Entry
from plumeframe.llm.queries import QUERIES, SQL
from tests.harness import compare, connect
from tests.llm.test_operators import brute_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    kept = corpus_pipeline.identify_languages(spark, docs, SF)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in before.items() if any(c.isalpha() for c in r["text"] or "")}
    alone = corpus_pipeline.drop_near_duplicates(spark, kept, SF).select("doc_id", "text").collect()
    groups = brute_groups([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert {r["doc_id"] for r in alone} == set(groups.values())
    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) == {"doc_id", "lang", "source", "n_chars", "n_ids", "ids", "round_trip"}
    rows = out.select("doc_id", "round_trip").collect()
    assert all(r["round_trip"] for r in rows) and {r["doc_id"] for r in rows} <= set(groups.values())


def test_stages_take_hard_rows(spark, tmp_path):
    """NULLs, repeated ids and rows, long texts, clashing extra columns; and no rows at all."""
    plain = "the cat sat on the mat and looked at the dog with great care while it rained outside"
    rows = [(i, f"{plain} {i} " * 6, "en", f"s{i % 2}", 1, [1], 2, 3) for i in range(20)]
    rows += [(None, f"{plain} nobody " * 3, "en", None, None, None, None, None)] * 3 + [(5, "some other words under an id that is taken " * 5, "en", "s1", 1, [1], 2, 3), (5, None, None, None, 1, [1], 2, 3)]
    rows += [(30, "", "en", "s0", 0, [1], 2, 3), (31, plain + " again" * 50_000, "en", "s0", 0, [1], 2, 3), (31, plain + " again" * 50_000, "en", "s0", 0, [1], 2, 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids array<int>, Size long, _chunk int"
    docs = spark.createDataFrame(rows, schema)
    for name, table in (("some", docs), ("none", docs.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_ids", "ids", "round_trip"]
        found = out.select("doc_id", "round_trip", "n_ids").collect()
        assert all(r["round_trip"] for r in found) and (len(found) > 0) == (name == "some")
    kept = {r["doc_id"] for r in found} if name == "some" else None
    assert kept is None or 30 not in kept


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(Entry(name, QUERIES[name], (), SQL[name]), spark, connect(SF), SF) is None
