"""Every query of the catalogue against its SQL twin, and what the twins can't say."""

from __future__ import annotations

import random
import re

import pytest

from foliomine.plans import catalog, records  # noqa: F401  (records registers its queries)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(name, spark, data, same):
    same(catalog.QUERIES[name](spark, data), catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(name, spark, data):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "doc_id", "hit_rank", "rrf"]


def test_natural_order_numbers_every_id(spark, tmp_path):
    rows = [(f"doc{d}", i) for d in (1, 2, 10) for i in range(0, 480, 2)] * 2 + [(None, 1), ("doc1", None)]
    random.Random(7).shuffle(rows)
    spark.createDataFrame(rows, "doc string, block_index int").repartition(3).write.parquet(str(tmp_path / "blocks.parquet"))
    ids = {f"{d}_b{i}" for d, i in rows if d is not None and i is not None}
    wanted = sorted(ids, key=lambda x: [int(t) if t.isdigit() else t for t in re.split(r"(\d+)", x)])
    got = {r["place"]: r["id"] for r in catalog.QUERIES["natural_order"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(wanted, 1))


def test_questions_without_a_vector_are_ranked_by_words(spark, tmp_path):
    docs = [(i, f"alpha{i} beta", f"alpha{i} " + "long enough to be kept whatever else it says " * 3, "guideline", "s") for i in range(20, 121, 10)]
    spark.createDataFrame(docs, "doc_id long, title string, text string, doc_kind string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, [float(i), 1.0], 1) for i in (20, 30, 40)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    asked = {20, 40, 60, 80, 100, 120}
    rows = catalog.QUERIES["rrf_fusion"](spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in rows} == asked
    assert {r["query_id"] for r in rows if r["dense_rank"] is not None} == {20, 40}
    assert all(r["doc_id"] == r["query_id"] for r in rows if r["sparse_rank"] == 0)
    hits = catalog.QUERIES["hybrid_topk"](spark, str(tmp_path)).collect()
    assert {r["query_id"] for r in hits} == asked
    groups = {q // 60 for q in asked}
    for name in ("quota_reserve_fill", "context_render", "passage_list"):
        assert {r["group_id"] for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()} == groups
